"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation, and pieces into overlapping chunks: a chunk ends with a run of OVERLAP words
whose hash is a multiple of ``period``, and the next one starts with that run. Where the text is cut depends on
the words alone, so equal passages give equal chunks. The chunks are a dictionary with
the number of times each was parsed (``parsed``). Phrases are counted inside distinct chunks, weighted; an occurrence belongs to
the chunk that it starts in before the chunk's last OVERLAP words, so each one counts once.

Blocks of the dictionary name their words and phrases by exact numbers. Before phrases are
counted as text, rare ones are put aside: blocks send short hashes of their phrases with counts to shards, and a shard answers
with a bit for each, whether the hash is frequent in all. Phrases of three and four words are only sent where all
their neighbouring pairs are frequent. A hash of several phrases can only let more through; the text's own counts decide.

Defined results: a null text is empty and has no words; a null language is "und"; rows that repeat an id, or have none, count like others;
an empty table gives no rows; other columns are ignored; texts of any length are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavefix.llm.common import bounded_batches, gram_hashes, mix, partitions, routed, saved, scratch, squeezed, unsqueezed, word_hashes

LONGEST = 4
OVERLAP = LONGEST - 1
LEAST = 30
#: Words between cuts, on average.
PERIOD = 16
#: Bytes of texts whose chunks are counted together, of those parsed at once, and of chunks in a block of the dictionary.
BATCH, SLICE, BLOCK = 1 << 22, 1 << 18, 4 << 20
#: Blocks are written a page each and a few to a row group: Parquet would otherwise hold a hundred rows before it looks at their size.
PAGES = {"compression": "zstd", "parquet.block.size": str(1 << 22), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Bits of the hashes that put rare phrases aside.
BITS = 48

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

CHUNK = "lang string, chunk binary, last boolean, times long"


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    edge = np.diff(np.concatenate(([1], _KIND[data] > 0, [1])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ranges laid end to end, and where each range starts in them."""
    base = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - base, sizes), base


def _chunks(texts: pa.Array, period: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Chunks of a batch of texts, the text that each is of, and whether it ends its piece."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    data = _LOWER[data]
    # A line feed between texts, so that no word or piece goes across.
    at, base = _gathered(offsets[:-1] - offsets[0], np.diff(offsets))
    joined = np.full(len(data) + len(texts), 0x0A, np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = data[at]
    starts, ends = _words(joined)
    n = len(starts)
    if not n:
        return pa.array([], pa.large_binary()), np.empty(0, np.int64), np.empty(0, bool)
    cuts = np.cumsum(_KIND[joined] == 2)
    piece = cuts[starts]
    begins = np.concatenate(([True], piece[1:] != piece[:-1]))
    first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))  # of the word's piece
    runs = gram_hashes(word_hashes(joined, starts, ends), OVERLAP)
    trigger = np.zeros(n, bool)
    whole = np.flatnonzero(runs % np.uint64(period) == 0) if len(runs) else np.empty(0, np.int64)
    trigger[whole] = piece[whole] == piece[whole + OVERLAP - 1]
    opens = np.flatnonzero(begins | (trigger & (np.arange(n) > first)))
    following = np.concatenate((opens[1:], [n]))
    last = np.concatenate((begins[opens[1:]], [True]))
    size = following - opens + np.where(last, 0, OVERLAP)
    # The chunks' words, one separator after each.
    word, at = _gathered(opens, size)
    length = ends[word] - starts[word] + 1
    byte, base = _gathered(starts[word], length)
    out = joined[np.minimum(byte, len(joined) - 1)]
    out[base + length - 1] = 0x20
    edges = np.concatenate((base[at], [len(out)]))
    text = np.searchsorted(offsets[1:] - offsets[0] + np.arange(len(texts)), starts[opens], "right")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(opens), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]), text, last


def parsed(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """The dictionary of documents (text, lang): (lang, chunk, last, times); a chunk's words are each followed by a blank."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            until = lambda at, size: max(at + 1, int(np.searchsorted(sizes, size + (sizes[at - 1] if at else 0), "right")))  # noqa: E731, B023  (a longer text comes alone)
            at = 0
            while at < len(texts):
                end, parts = min(until(at, BATCH), len(texts)), []
                while at < end:
                    to = min(until(at, SLICE), end)
                    chunk, text, last = _chunks(texts.slice(at, to - at), period)
                    parts.append(pa.table({"lang": batch.column("lang").slice(at, to - at).take(pa.array(text)), "chunk": chunk, "last": last, "times": np.ones(len(chunk), np.int64)}))
                    at = to
                for part in pa.concat_tables(parts).group_by(["lang", "chunk", "last"]).aggregate([("times", "sum")]).to_batches(20_000):
                    yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("chunk").cast(pa.binary()), part.column("last"), part.column("times_sum")], names=["lang", "chunk", "last", "times"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(parse, CHUNK).groupBy("lang", "chunk", "last").agg(F.sum("times").alias("times"))


BLOCKS = "block long, langs array<string>, lang binary, chunks binary, sizes binary, last binary, times binary"


def blocks(dictionary: DataFrame) -> DataFrame:
    """The dictionary in rows of about BLOCK bytes of chunks; to be written, as the numbers of the blocks hold for one run."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lang = t.column("lang").combine_chunks().dictionary_encode()
            text = t.column("chunk").combine_chunks().cast(pa.large_binary())
            row = {
                "block": (part << 32) + seq, "langs": lang.dictionary.to_pylist(), "lang": lang.indices.to_numpy().astype(np.int32).tobytes(), "chunks": b"".join(text.to_pylist()),
                "sizes": pa.compute.binary_length(text).to_numpy().astype(np.int64).tobytes(), "last": t.column("last").to_numpy().astype(np.uint8).tobytes(), "times": t.column("times").to_numpy().astype(np.int64).tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), *((n, pa.binary()) for n in ("lang", "chunks", "sizes", "last", "times"))]))

        for batch in batches:
            held.append(batch)
            size += batch.column("chunk").nbytes
            if size >= BLOCK:
                yield block()
                held, size, seq = [], 0, seq + 1
        if sum(b.num_rows for b in held):
            yield block()

    return dictionary.mapInArrow(gather, BLOCKS)


def _first(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each code from 0 to n - 1 is first."""
    out = np.empty(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out


class Block:
    """Phrases of a block by exact numbers: for each length the distinct phrases, where each is first, its count and its hash."""

    def __init__(self, row: dict):
        self.langs, self.data = row["langs"], np.frombuffer(row["chunks"], np.uint8)
        sizes, lang = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["lang"], np.int32)
        last, times = np.frombuffer(row["last"], np.uint8), np.frombuffer(row["times"], np.int64)
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ends), [None, pa.py_buffer(np.append(self.starts, len(self.data)).tobytes()), pa.py_buffer(self.data)]).dictionary_encode()
        count = np.diff(np.searchsorted(self.ends, np.concatenate(([0], np.cumsum(sizes)))))
        place = np.arange(len(self.ends)) - np.repeat(np.cumsum(count) - count, count)
        # Where phrases start that belong to the chunk, how many words follow, and how often the chunk was parsed.
        self.left = (np.repeat(count, count) - place).astype(np.int32)
        self.owned = place < np.repeat(count - np.where(last, 0, OVERLAP), count)
        del place
        self.times, self.lang = np.repeat(times, count), np.repeat(lang, count)
        self.units, first = pd.factorize(words.indices.to_numpy().astype(np.int64) * len(self.langs) + self.lang)
        own = word_hashes(np.frombuffer(words.dictionary.buffers()[2], np.uint8), (edges := np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1])[:-1], edges[1:])
        names = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8"), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        self.hash = mix(own[first // len(self.langs)] + names[first % len(self.langs)])[self.units]
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sent: dict[int, np.ndarray] = {}
        self.codes = {1: self.units}
        self._count(1, np.flatnonzero(self.owned))
        # Pairs are numbered wherever they are, so that those in an overlap can be looked up.
        self.codes[2] = self._numbered(2, np.flatnonzero(self.left >= 2))
        self._count(2, np.flatnonzero(self.owned & (self.left >= 2)))

    def _numbered(self, n: int, where: np.ndarray) -> np.ndarray:
        """Exact numbers of the phrases of n words that start at ``where``, by those of n - 1 words."""
        width = int(self.units.max(initial=0)) + 1
        codes = np.zeros(len(self.units), np.int32)
        codes[where] = pd.factorize(self.codes[n - 1][where].astype(np.int64) * width + self.units[where + n - 1])[0]
        return codes

    def _count(self, n: int, where: np.ndarray) -> None:
        """Distinct phrases of n words that start at ``where``: where each is first, and its count."""
        codes, distinct = pd.factorize(self.codes[n][where])
        first = where[_first(codes, len(distinct))]
        self.levels[n] = first, np.bincount(codes, self.times[where], len(distinct)).astype(np.int64)
        hashes = gram_hashes(self.hash, n)[first] if len(first) else np.empty(0, np.uint64)
        self.sent[n] = mix(hashes + np.uint64(n)) >> np.uint64(64 - BITS)

    def longer(self, n: int, at: np.ndarray) -> None:
        """Number and count the phrases of n words where ``at`` says."""
        where = np.flatnonzero(at & (self.left >= n))
        self.codes[n] = self._numbered(n, where)
        self._count(n, where)

    def submitted(self, *lengths: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and counts of the distinct phrases of some lengths by rising hash, and the order they come in."""
        hashes, counts = np.concatenate([self.sent[n] for n in lengths]), np.concatenate([self.levels[n][1] for n in lengths])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], counts[order], order

    def frequent(self, bits: np.ndarray, *lengths: int) -> dict[int, np.ndarray]:
        """By length, the distinct phrases whose submission was answered by a one."""
        order = self.submitted(*lengths)[2]
        flags = np.empty(len(order), bool)
        flags[order] = bits
        return dict(zip(lengths, np.split(flags, np.cumsum([len(self.sent[n]) for n in lengths])[:-1]), strict=True))

    def starting(self, n: int, flags: np.ndarray) -> np.ndarray:
        """Which words start a phrase of n words that is flagged (a chunk's overlap included)."""
        known = np.zeros(int(self.codes[n].max(initial=0)) + 1, bool)
        known[self.codes[n][self.levels[n][0][flags]]] = True
        return known[self.codes[n]] & (self.left >= n)

    def phrases(self, n: int, flags: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, words, times) of the flagged phrases of n words."""
        first = self.levels[n][0][flags]
        a, b = self.starts[first], self.ends[first + n - 1]
        at, base = _gathered(a, b - a)
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(base, len(at)).astype(np.int64).tobytes()), pa.py_buffer(self.data[at].tobytes())).cast(pa.string())
        return pa.RecordBatch.from_pydict({"lang": pa.array(self.langs, pa.string()).take(pa.array(self.lang[first])), "phrase": text, "words": pa.array(np.full(len(first), n), pa.int32()), "times": self.levels[n][1][flags]})


def _target(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards by ranges of the hash."""
    return (hashes >> np.uint64(BITS - 32)).astype(np.int64) * shards >> 32


def _bits(answers: list[dict] | None, hashes: np.ndarray, shards: int) -> np.ndarray:
    """A block's answers in the order of its submissions."""
    sizes = np.bincount(_target(hashes, shards), minlength=shards)
    out = np.zeros(len(hashes), bool)
    ends = np.cumsum(sizes)
    for a in answers if answers is not None else ():
        t = a["target"]
        out[ends[t] - sizes[t] : ends[t]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=sizes[t])
    return out


ANSWERS = "array<struct<target: int, bits: binary>>"


def _answered(sent: DataFrame, least: int, shards: int) -> DataFrame:
    """For each block the shards' answers to (target, block, hashes, counts): which hashes have ``least`` occurrences in all."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for pdf in batches for r in pdf.itertuples(index=False)]  # one shard
        if not rows:
            return
        hashes = [np.cumsum(unsqueezed([r.hashes], "<u8"), dtype=np.uint64) for r in rows]
        codes, distinct = pd.factorize(np.concatenate(hashes))
        much = np.bincount(codes, unsqueezed([r.counts for r in rows], "<i8"), len(distinct)) >= least
        bits = [np.packbits(flags).tobytes() for flags in np.split(much[codes], np.cumsum([len(h) for h in hashes])[:-1])]
        yield pd.DataFrame({"block": [r.block for r in rows], "target": [r.target for r in rows], "bits": bits})

    said = routed(sent, shards, "block").mapInPandas(answer, "block long, target int, bits binary")
    return said.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("target", "bits"))).alias("answers"))


def _submissions(block: Block, number: int, shards: int, *lengths: int) -> pd.DataFrame:
    """A row for each shard that gets hashes of the block."""
    hashes, counts, _ = block.submitted(*lengths)
    target = _target(hashes, shards)
    cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True]))) if len(target) else np.zeros(1, np.int64)
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pd.DataFrame({"target": target[cuts[:-1]].astype(np.int32), "block": np.full(len(parts), number, np.int64), "hashes": [squeezed(np.diff(hashes[a:b], prepend=np.uint64(0))) for a, b in parts], "counts": [squeezed(counts[a:b]) for a, b in parts]})


SENT = "target int, block long, hashes binary, counts binary"


def counted(spark: SparkSession, dictionary: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of 1 to LONGEST words that occur ``least`` times."""
    shards = partitions(spark)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield _submissions(Block(row), row["block"], shards, 1, 2)

    def extended(row: dict) -> tuple[Block, dict[int, np.ndarray]]:
        """The block with those longer phrases whose pairs are all frequent."""
        block = Block(row)
        often = block.frequent(_bits(row["pairs"], block.submitted(1, 2)[0], shards), 1, 2)
        # Pairs that start in a chunk's overlap are another chunk's; one that is not counted here may be frequent there.
        known = block.starting(2, often[2]) | (~block.owned & (block.left >= 2) & ~block.starting(2, np.ones(len(block.levels[2][0]), bool)))
        at = block.owned & known
        for n in (3, 4):
            at = at & np.concatenate((known[n - 2 :], np.zeros(min(n - 2, len(known)), bool)))[: len(known)]
            block.longer(n, at)
        return block, often

    def longer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield _submissions(extended(row)[0], row["block"], shards, 3, 4)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, often = extended(row)
                often |= block.frequent(_bits(row["longer"], block.submitted(3, 4)[0], shards), 3, 4)
                for n, flags in often.items():
                    out = block.phrases(n, flags)
                    for at in range(0, out.num_rows, 20_000):
                        yield out.slice(at, 20_000)

    with scratch(spark, "phrases") as kept, bounded_batches(spark):
        cut = kept(blocks(dictionary), **PAGES)
        one = kept(_answered(cut.mapInPandas(pairs, SENT), least, shards)).withColumnRenamed("answers", "pairs")
        both = cut.join(one, "block", "left")
        two = kept(_answered(both.mapInPandas(longer, SENT), least, shards)).withColumnRenamed("answers", "longer")
        found = both.join(two, "block", "left").mapInArrow(texts, "lang string, phrase string, words int, times long")
        return saved(spark, found.groupBy("lang", "phrase", "words").agg(F.sum("times").alias("f")).where(F.col("f") >= least), "phrase_counts", compression="zstd")


def totals(dictionary: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences."""
    blanks = F.length("chunk") - F.length(F.replace(F.col("chunk").cast("string"), F.lit(" ")).cast("binary"))
    return dictionary.groupBy("lang").agg(F.sum((blanks - F.when(F.col("last"), 0).otherwise(OVERLAP)) * F.col("times")).alias("n"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of several words, by their lowest-scoring cut."""
    long = counts.where("words > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    f = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(f("first", "l"), ["lang", "first"]).join(f("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 AS decimal(7,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))"))
    lowest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "words", "a", "c.l", "c.r", "c.score")


def independent(candidates: DataFrame, share: int = 80) -> DataFrame:
    """Candidates that lie in no longer one with ``share`` percent of their occurrences."""
    long = candidates.where("words > 2").withColumn("w", F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: F.array_join(F.slice("w", at, n), " "))))
    inside = long.select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    out = candidates.join(inside, ["lang", "phrase"], "left")
    return out.where(F.col("_longer").isNull() | (100 * wide("_longer") < share * wide("a"))).drop("_longer")


def ranked(candidates: DataFrame, most: int, groups: int) -> DataFrame:
    """Each language's first ``most``: first of hashed groups, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    out = candidates.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    out = out.withColumn("_rank", F.row_number().over(W.partitionBy("lang", "_group").orderBy(*order))).where(F.col("_rank") <= most)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_group", "_rank")


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, most: int = 2000, period: int = PERIOD) -> DataFrame:
    """Each language's first phrases of documents (text, lang): (lang, rank, phrase, a, l, r, n, score)."""
    with scratch(spark, "parse") as kept, bounded_batches(spark):
        dictionary = kept(parsed(docs, period), compression="zstd")
        counts = counted(spark, dictionary, least)
        n = saved(spark, totals(dictionary), "totals")
    found = ranked(independent(scored(counts)), most, min(1024, partitions(spark)))
    return found.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_collocations: each language's first 2000 phrases."""
    return collocations(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, unnest(range(1, 5)) AS k, w FROM p WHERE len(w) > 0),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM g WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
x AS (SELECT *, unnest(range(1, words)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.words, a, cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:words], ' ')),
m AS (SELECT lang, phrase, words, a, min({{'score': score, 'cut': cut, 'l': l, 'r': r}}) AS c FROM s GROUP BY ALL),
b AS (SELECT lang, phrase, words, a, c.l AS l, c.r AS r, c.score AS score FROM m),
d AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT c.lang, c.a, unnest(flatten(list_transform(range(2, words), lambda n: list_transform(range(1, words - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS phrase FROM c WHERE words > 2) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b LEFT JOIN d USING (lang, phrase) JOIN n USING (lang)
WHERE longer IS NULL OR 100 * longer < 80 * a QUALIFY rank <= 2000"""
