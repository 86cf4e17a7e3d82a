"""A message log as a streaming source with offsets that can be replayed.

A log is a folder with one folder ``part=<n>`` for each partition, in which segments are appended to, named by the offset of
their first line (``00000000000000000000.jsonl``). A line is a JSON object (topic, payload, t, event_id). A partition's offset is its number of whole
lines: a line that is still being written has none yet. A micro-batch is a range of offsets of each
partition, cut into tasks of at most ``rowsPerTask`` lines, so that a restart reads just what the checkpoint says.
Lines that aren't messages come out as rows with ``malformed`` set and are counted by ``messages``.

Files are opened through pyarrow's file systems (local, HDFS, object stores), as tasks can't use Spark's readers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

NAME = "message_log"
SCHEMA = "part int, offset long, topic string, payload string, t double, event_id long, malformed boolean"
CHUNK = 1 << 20


@dataclass
class Lines(InputPartition):
    """Offsets ``first`` to ``end`` - 1 of a partition."""

    part: int
    first: int
    end: int


class Log:
    """The folder of a log."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[int]:
        there = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(int(f.base_name[5:]) for f in there if f.base_name.startswith("part="))

    def segments(self, part: int) -> list[tuple[int, str]]:
        """Offsets and paths of a partition's segments."""
        there = self.files.get_file_info(fs.FileSelector(f"{self.root}/part={part}", allow_not_found=True))
        return sorted((int(f.base_name.split(".")[0]), f.path) for f in there if f.base_name.endswith(".jsonl"))

    def end(self, part: int) -> int:
        """The offset after the last whole line; only the last segment is read."""
        segments = self.segments(part)
        if not segments:
            return 0
        base, path = segments[-1]
        with self.files.open_input_stream(path, compression=None) as f:
            while data := f.read(CHUNK):
                base += data.count(b"\n")
        return base

    def lines(self, part: int, first: int, end: int) -> Iterator[tuple[int, bytes]]:
        """Whole lines by offset."""
        segments = self.segments(part)
        for i, (base, path) in enumerate(segments):
            if base >= end or (i + 1 < len(segments) and segments[i + 1][0] <= first):
                continue
            with self.files.open_input_stream(path, compression=None) as f:
                at, rest = base, b""
                while at < end and (data := f.read(CHUNK)):
                    *full, rest = (rest + data).split(b"\n")
                    for line in full:
                        if first <= at < end:
                            yield at, line
                        at += 1


def _row(part: int, offset: int, line: bytes) -> tuple:
    try:
        m = json.loads(line)
        if isinstance(m, dict) and isinstance(m["topic"], str) and isinstance(m["payload"], str):
            t, number = m.get("t"), m.get("event_id")
            return part, offset, m["topic"], m["payload"], None if t is None else float(t), None if number is None else int(number), False
    except (ValueError, KeyError, TypeError):
        pass
    return part, offset, None, line.decode("utf-8", "replace"), None, None, True


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, rows: int, latest: bool):
        self.path, self.rows, self.latest = path, rows, latest

    def initialOffset(self) -> dict:  # noqa: N802
        """The beginning, or the end where only new messages are wanted."""
        return self.latestOffset() if self.latest else {}

    def latestOffset(self) -> dict:  # noqa: N802
        log = Log(self.path)
        return {str(p): log.end(p) for p in log.partitions()}

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for part, last in end.items():
            first = start.get(part, 0)
            out += [Lines(int(part), a, min(a + self.rows, last)) for a in range(first, last, self.rows)]
        return out

    def read(self, partition: Lines) -> Iterator[tuple]:
        for offset, line in Log(self.path).lines(partition.part, partition.first, partition.end):
            yield _row(partition.part, offset, line)


class MessageLog(DataSource):
    """Options: ``path``; ``rowsPerTask`` (100000); ``startingOffsets`` (earliest or latest)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LogReader:  # noqa: N802
        return LogReader(self.options["path"], int(self.options.get("rowspertask", 100_000)), self.options.get("startingoffsets", "earliest") == "latest")


def messages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Messages (event_id, topic, payload, t) of a log as a stream; an offset stands for the number of a message that has none.

    Malformed lines are counted in the query's progress (``malformed``) and dropped.
    """
    spark.dataSource.register(MessageLog)
    rows = spark.readStream.format(NAME).options(path=path, **options).load()
    rows = rows.observe(NAME, F.count(F.lit(1)).alias("lines"), F.count_if("malformed").alias("malformed")).where("NOT malformed")
    number = F.coalesce("event_id", F.shiftleft(F.col("part").cast("long"), 48) + F.col("offset"))
    return rows.select(number.alias("event_id"), "topic", "payload", "t")


def malformed(query: StreamingQuery) -> int:
    """Malformed lines in the batches whose progress the query keeps."""
    seen = (p.observedMetrics.get(NAME) for p in query.recentProgress)
    return sum(int(m["malformed"]) for m in seen if m is not None)
