"""Readings as points of line protocol, written once for each batch.

Tasks write hidden files; the driver's commit moves them into the batch's folder and marks it whole. An aborted
batch leaves nothing, and a batch that is run again replaces what it wrote, so each point is there once. Writes that fail
are tried again after growing pauses.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

NAME = "line_protocol"
WHOLE = "whole.mark"


@dataclass
class Written(WriterCommitMessage):
    path: str
    points: int


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace(",", "\\,").replace("=", "\\=").replace(" ", "\\ ")


def point(row: dict, measurement: str, tags: list[str], t: str) -> str | None:
    """A line: measurement, tags, fields and nanoseconds (from seconds). Nulls are left out; without any field there is no point."""

    def value(v: object) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int):
            return f"{v}i"
        return repr(v) if isinstance(v, float) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

    fields = [f"{_escaped(k)}={value(v)}" for k, v in row.items() if k not in tags and k != t and v is not None]
    if not fields or row[t] is None:
        return None
    own = "".join(f",{_escaped(k)}={_escaped(str(row[k]))}" for k in tags if row[k] is not None and str(row[k]) != "")
    return f"{_escaped(measurement)}{own} {','.join(fields)} {round(row[t] * 1_000_000) * 1000}"


def again(act: Callable[[], None], tries: int, pause: float) -> None:
    """Do ``act``; after an error of input or output wait, twice as long each time, and try again."""
    for n in range(tries):
        try:
            return act()
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(pause * 2**n)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class LineWriter(DataSourceStreamWriter):
    def __init__(self, path: str, measurement: str, tags: list[str], t: str, tries: int, pause: float):
        self.path, self.measurement, self.tags, self.t, self.tries, self.pause = path, measurement, tags, t, tries, pause

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _at(self.path)
        at, n = f"{root}/_pending/{uuid.uuid4().hex}.lp", 0
        again(lambda: files.create_dir(f"{root}/_pending", recursive=True), self.tries, self.pause)
        try:
            with files.open_output_stream(at, compression=None) as f:
                for row in iterator:
                    line = point(row.asDict(), self.measurement, self.tags, self.t)
                    if line is not None:
                        again(lambda line=line: f.write(line.encode("utf-8") + b"\n"), self.tries, self.pause)
                        n += 1
        except BaseException:
            self._delete(files, at)
            raise
        return Written(at, n)

    @staticmethod
    def _delete(files: fs.FileSystem, at: str) -> None:
        if files.get_file_info(at).type != fs.FileType.NotFound:
            files.delete_file(at)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        files, root = _at(self.path)
        to = f"{root}/batch={batchId}"

        def move() -> None:
            done = files.get_file_info(f"{to}/{WHOLE}").type != fs.FileType.NotFound
            pending = [m for m in messages if isinstance(m, Written) and files.get_file_info(m.path).type != fs.FileType.NotFound]
            if done and not pending:
                return  # a commit that is tried again
            if done and files.get_file_info(to).type != fs.FileType.NotFound:
                files.delete_dir(to)  # the batch is run again
            files.create_dir(to, recursive=True)
            for m in pending:
                if m.points:
                    files.move(m.path, f"{to}/{m.path.rsplit('/', 1)[1]}")
                else:
                    self._delete(files, m.path)
            with files.open_output_stream(f"{to}/{WHOLE}", compression=None) as f:
                f.write(f"{sum(m.points for m in pending)}\n".encode())

        again(move, self.tries, self.pause)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        files, _ = _at(self.path)
        for m in messages:
            if isinstance(m, Written):
                self._delete(files, m.path)


class LineProtocol(DataSource):
    """Options: ``path``, ``measurement`` (rssi), ``tags`` (comma-joined columns), ``time`` (column of seconds), ``tries`` (4), ``pause`` (0.5 seconds)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamWriter(self, schema: StructType, overwrite: bool) -> LineWriter:  # noqa: N802
        o = self.options
        return LineWriter(o["path"], o.get("measurement", "rssi"), [x for x in o.get("tags", "").split(",") if x], o.get("time", "t"), int(o.get("tries", 4)), float(o.get("pause", 0.5)))


def into(readings: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Write a stream of readings (beacon, anchor_id, t, rssi, distance) as points; starts and returns the query."""
    readings.sparkSession.dataSource.register(LineProtocol)
    rows = readings.select(F.col("beacon").cast("string").alias("beacon"), "anchor_id", "t", *(c for c in ("rssi", "distance", "x") if c in readings.columns))
    return rows.writeStream.format(NAME).options(path=path, tags="beacon,anchor_id", **options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Points (batch, line) of whole batches."""
    rows = spark.read.text(f"{path}/batch=*/*.lp").select(F.regexp_extract(F.col("_metadata.file_path"), "batch=(\\d+)/", 1).cast("long").alias("batch"), F.col("value").alias("line"))
    whole = spark.read.format("binaryFile").load(f"{path}/batch=*/{WHOLE}").select(F.regexp_extract("path", "batch=(\\d+)/", 1).cast("long").alias("batch"))
    return rows.join(whole, "batch", "left_semi")
