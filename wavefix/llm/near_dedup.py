"""Near-duplicate detection: MinHash bands with sequential Bayesian verification.

1. Each document's set of five-word shingles is hashed and signed (``BANDS`` x ``ROWS``
   MinHash values). Documents of equal sets collapse to the one of least id.
2. Documents that agree in all rows of a band share a bucket. Buckets of one member are
   dropped; in an input batch a bucket's members are found at once and only
   one goes on, so a hot bucket reaches its task as a row for each batch.
3. Candidate pairs come from buckets in rounds, so that a group of n copies costs
   about n pairs, not n * n: first the least id of a bucket against the
   others, then the greatest of those left against those in other components. Members that
   are in different components even then are compared inside each bucket: first inside its blocks,
   then, where it has several, two blocks at a time. Every pair that shares a bucket is
   therefore compared or already connected, and no other pair is compared.
4. A pair's signatures are compared a batch at a time. After each batch the posterior
   of the similarity (uniform prior) is known; the pair is pruned when similarity
   at or above the threshold has less than ``MISS`` probability. Survivors are
   verified exactly on their full shingle sets; in blocks the texts of survivors alone are
   read, and a task joins components as it goes and returns only the links that joined some.
5. Components of the verified links: hooks to the least neighbour, doubled and contracted.

A pair at the threshold misses all bands with probability (1 - 0.75 ** 4) ** 40 = 2.5e-7.

Defined results: a null or empty text has no shingles and is linked with nothing,
not even with another empty one; a null id counts as the largest id; rows that repeat an
id are one node, linked by any of their texts; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm.common import chunks, gram_hashes, keyed, mix, packed, partitions, routed, saved, scratch, unkeyed, unpacked, unsqueezed, word_hashes, word_spans

#: Writes a table and reads it back (see ``scratch``).
Keep = Callable[..., DataFrame]

WORDS = 5
BANDS, ROWS = 40, 4
#: Signature values compared before each look at the posterior.
BATCH = 32
#: Chance that pruning drops a pair at the threshold, at each look.
MISS = 1e-7
#: Similarity, in hundredths.
LEAST = 75
#: Pairs verified beside one copy of their common document's text.
STAR = 64
#: Documents, and shingles, in a block of those compared with each other.
BLOCK, SHINGLES = 512, 1 << 20

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_MUL, _ADD = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (lower-cased here)."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts), np.uint8)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds)
    grams = gram_hashes(words, WORDS)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, a row each."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    if sets:
        sizes = [len(s) for s in sets]
        all_, cuts = np.concatenate(sets), np.cumsum([0, *sizes[:-1]])
        for i in range(BANDS * ROWS):
            out[:, i] = np.minimum.reduceat(all_ * _MUL[i] + _ADD[i], cuts) >> np.uint64(32)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each document and band."""
    rows = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = mix((h ^ rows[:, :, r]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(r))
    return h


def fewest_matches() -> dict[int, int]:
    """For each number of compared values the least matches with which a pair goes on.

    With m of n matches and a uniform prior the posterior chance of similarity >= t is
    P(Binomial(n + 1, t) <= m).
    """
    t, out = LEAST / 100, {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < MISS:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(key, n_shingles, same, sig): ``same`` tells equal sets; both are null for an empty set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
            for keys, part in chunks(pdf["key"].to_numpy(), texts):
                sets = shingle_sets(part)
                sigs = signatures([s for s in sets if len(s)])
                rows = iter(sigs)
                yield pd.DataFrame({
                    "key": keys,
                    "n_shingles": [len(s) for s in sets],
                    "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sig": [next(rows).tobytes() if len(s) else None for s in sets],
                })

    return docs.mapInPandas(sign, "key long, n_shingles long, same binary, sig binary")


def members(spark: SparkSession, sigs: DataFrame, keep: Keep) -> DataFrame:
    """(bucket, key) of every bucket with two members or more."""
    n = partitions(spark)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = np.repeat(pdf["key"].to_numpy(), BANDS)
            buckets = band_keys(unpacked(pdf["sig"], "<u4").reshape(len(pdf), -1)).ravel()
            order = np.lexsort((keys, buckets))
            keys, buckets = keys[order], buckets[order]
            new = np.concatenate(([True], buckets[1:] != buckets[:-1]))
            shared = ~new | ~np.concatenate((new[1:], [True]))
            target = (buckets % np.uint64(n)).astype(np.int32)
            for kind, pick in ((0, new), (1, shared & ~new)):
                # The first member of a bucket in this batch looks for others elsewhere; the rest are known already.
                rows = list(packed(target[pick], {"buckets": buckets[pick], "keys": keys[pick], "known": shared[pick]}))
                if rows:
                    yield pd.DataFrame(rows).assign(kind=kind)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, bytes, bytes]] = []

        def tell(buckets: np.ndarray, keys: np.ndarray) -> Iterator[pd.DataFrame]:
            for a in range(0, len(keys), 100_000):
                yield pd.DataFrame({"bucket": buckets[a : a + 100_000].view(np.int64), "key": keys[a : a + 100_000]})

        for pdf in batches:
            for kind, buckets, keys, known in zip(pdf["kind"], pdf["buckets"], pdf["keys"], pdf["known"], strict=True):
                if kind:
                    yield from tell(unsqueezed([buckets], "<u8"), unsqueezed([keys], "<i8"))
                else:
                    held.append((buckets, keys, known))
        if held:
            buckets, keys, known = (unsqueezed(x, k) for x, k in zip(zip(*held, strict=True), ("<u8", "<i8", "?"), strict=True))
            order = np.argsort(buckets, kind="stable")
            buckets, keys, known = buckets[order], keys[order], known[order]
            new = np.concatenate(([True], buckets[1:] != buckets[:-1]))
            shared = known | ~new | ~np.concatenate((new[1:], [True]))
            yield from tell(buckets[shared], keys[shared])

    dealt = sigs.select("key", "sig").mapInPandas(deal, "target int, kind int, buckets binary, keys binary, known binary")
    return keep(dealt.repartitionById(n, F.col("target")).mapInPandas(meet, "bucket long, key long"))


def likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that the Bayesian comparison of their signatures doesn't prune."""
    least = fewest_matches()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = (unpacked(pdf[c], "<u4").reshape(len(pdf), -1) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
            for n, m in least.items():
                matches = matches + (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                alive, matches = alive[matches >= m], matches[matches >= m]
            yield pdf.iloc[alive][["a", "b"]]

    both = pairs.join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInPandas(compare, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < LEAST * len(large):
        return False
    where = np.searchsorted(large, small)
    where[where == len(large)] = 0
    shared = int((large[where] == small).sum())
    return 100 * shared >= LEAST * (len(small) + len(large) - shared)


def linked(spark: SparkSession, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    n = partitions(spark)
    # A document with many partners is dealt to several tasks, each with its own copy of its text.
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).alias("salt"))
    left = dealt.select("a", "salt").distinct().join(texts, F.col("a") == F.col("key")).select("a", "salt", F.lit(0).alias("kind"), "key", "text")
    right = dealt.join(texts, F.col("b") == F.col("key")).select("a", "salt", F.lit(1).alias("kind"), "key", "text")
    rows = left.unionByName(right).withColumn("target", F.pmod(F.xxhash64("a", "salt"), F.lit(n)).cast("int"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine = None, []
        for pdf in batches:
            texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
            sets = (s for _, part in chunks(pdf["key"].to_numpy(), texts) for s in shingle_sets(part))
            out = []
            for a, salt, kind, key, own in zip(pdf["a"], pdf["salt"], pdf["kind"], pdf["key"], sets, strict=True):
                if kind == 0:
                    mine = [*mine, own] if at == (a, salt) else [own]  # several texts of one id
                    at = a, salt
                elif at == (a, salt) and any(similar(own, x) for x in mine):
                    out.append((a, key))
            yield pd.DataFrame(out, columns=["a", "b"])

    return routed(rows, n, "a", "salt", "kind").mapInPandas(verify, "a long, b long")


def opened(held: DataFrame, names: DataFrame, keep: Keep) -> DataFrame:
    """(bucket, key, comp) of the buckets in ``held`` that still hold several components of ``names`` (key, comp)."""
    named = held.join(names, "key")
    several = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return keep(named.join(several, "bucket", "left_semi").select("bucket", "key", "comp"))


def placed(open_: DataFrame, few: DataFrame) -> DataFrame:
    """(bucket, key, comp, block) of the members (bucket, key, comp) of open buckets.

    A bucket's large components have blocks of their own, its small ones share blocks. A block has about
    ``BLOCK`` documents or ``SHINGLES`` shingles at most; a document of more has one with few others.
    """
    weight = few.groupBy("key").agg((F.count(F.lit(1)) / BLOCK + F.sum("n_shingles") / SHINGLES).alias("weight"))
    docs = open_.distinct().join(weight, "key")
    sizes = docs.groupBy("bucket", "comp").agg(F.sum("weight").alias("own"))
    rest = sizes.groupBy("bucket").agg(F.sum(F.when(F.col("own") <= 0.5, F.col("own"))).alias("rest"))
    large = F.col("own") > 0.5
    pieces = F.ceil(F.when(large, F.col("own")).otherwise(F.col("rest")))
    part = F.pmod(F.when(large, F.xxhash64("key")).otherwise(F.xxhash64("comp")), pieces)
    block = F.struct(F.when(large, F.col("comp")).otherwise(-1).alias("of"), part.alias("part")).alias("block")
    return docs.join(sizes, ["bucket", "comp"]).join(rest, "bucket").select("bucket", "key", "comp", block)


def crossed(spark: SparkSession, docs: DataFrame, units: DataFrame, few: DataFrame, texts: DataFrame, keep: Keep) -> DataFrame:
    """Links (a, b) between different components in ``units`` (bucket, block_x, block_y) of ``placed`` documents.

    Signatures alone say which documents of a unit have a likely pair that no other bucket answers for; only these meet
    again with their texts. A task joins components as it finds links and returns only the links that joined two.
    """
    sides = F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block")
    n = partitions(spark)
    unit = F.xxhash64("bucket", "block_x", "block_y")
    rows = units.select("bucket", unit.alias("unit"), F.col("block_x"), F.col("block_y"), sides).join(docs, ["bucket", "block"])
    rows = rows.select("unit", "bucket", (F.col("block") == F.col("block_x")).alias("x"), (F.col("block") == F.col("block_y")).alias("y"), "key", "comp")
    rows = rows.join(few.select("key", "sig"), "key").withColumn("target", F.pmod("unit", F.lit(n)).cast("int"))
    likely_ = keep(routed(rows, n, "unit").mapInPandas(_by_unit(_likely), "unit long, x boolean, y boolean, key long, comp long, sig binary"))
    wide = likely_.join(texts, "key").withColumn("target", F.pmod(F.xxhash64("unit"), F.lit(n)).cast("int"))
    return routed(wide, n, "unit").mapInPandas(_by_unit(_compared), "a long, b long")


def _by_unit(work: Callable[[pd.DataFrame, dict[int, int]], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``work`` on the rows of each unit; a task's rows come in order of their units."""
    least = fewest_matches()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for _, g in pdf.groupby("unit", sort=False):
                if held and held[0]["unit"].iloc[0] != g["unit"].iloc[0]:
                    yield work(pd.concat(held), least)
                    held = []
                held.append(g)
        if held:
            yield work(pd.concat(held), least)

    return run


def _likely(rows: pd.DataFrame, least: dict[int, int]) -> pd.DataFrame:
    """The documents of a unit with a likely partner in another component, ``unit`` renamed so that partners share it.

    A pair that shares several buckets is answered for by that of its first band: there it has been compared or
    connected before, or is compared now.
    """
    sigs = unpacked(rows["sig"], "<u4").reshape(len(rows), -1)
    buckets = band_keys(sigs)
    at = buckets == rows["bucket"].to_numpy()[:, None].astype(np.uint64)
    here = at.any(axis=1)  # an id may have other texts, of other buckets
    rows, sigs, buckets, band = rows[here], sigs[here], buckets[here], at[here].argmax(axis=1)
    comps, x, y = (rows[c].to_numpy() for c in ("comp", "x", "y"))
    same = bool((x & y).any())
    cluster, found = np.arange(len(rows)), np.zeros(len(rows), bool)
    for i in np.flatnonzero(x).tolist():
        alive = np.flatnonzero(y & (comps != comps[i]) & (cluster != cluster[i]))
        if same:
            alive = alive[alive > i]
        matches = np.zeros(len(alive), np.int64)
        for n, m in least.items():
            matches = matches + (sigs[alive, n - BATCH : n] == sigs[i, n - BATCH : n]).sum(axis=1)
            alive, matches = alive[matches >= m], matches[matches >= m]
        alive = alive[(buckets[alive] == buckets[i]).argmax(axis=1) == band[i]]
        if len(alive):
            found[i] = found[alive] = True
            cluster[np.isin(cluster, cluster[alive])] = cluster[i]
    unit = mix(rows["unit"].to_numpy().astype(np.uint64) + mix(cluster.astype(np.uint64))).view(np.int64)
    return rows.assign(unit=unit)[found][["unit", "x", "y", "key", "comp", "sig"]]


def _compared(unit: pd.DataFrame, least: dict[int, int]) -> pd.DataFrame:
    """Links (components a, b) between the two sides of a unit that join its components."""
    keys, comps = unit["key"].to_numpy(), unit["comp"].to_numpy()
    sides = unit["x"].to_numpy(), unit["y"].to_numpy()
    sigs = unpacked(unit["sig"], "<u4").reshape(len(unit), -1)
    texts = [t.encode("utf-8", "replace") for t in unit["text"]]
    sets = [s for _, part in chunks(keys, texts) for s in shingle_sets(part)]
    sizes = np.array([len(s) for s in sets])
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(at, kind="stable")
    doc, bounds = doc[order], np.searchsorted(at[order], np.arange(len(grams) + 1))
    own = np.split(at, np.cumsum(sizes)[:-1])
    same = bool((sides[0] & sides[1]).any())
    now = np.unique(comps, return_inverse=True)[1]  # components as they are joined
    out = []
    for i in np.flatnonzero(sides[0]).tolist():
        alive = np.flatnonzero(sides[1] & (now != now[i]))
        if same:
            alive = alive[alive > i]
        matches = np.zeros(len(alive), np.int64)
        for n, m in least.items():
            matches = matches + (sigs[alive, n - BATCH : n] == sigs[i, n - BATCH : n]).sum(axis=1)
            alive, matches = alive[matches >= m], matches[matches >= m]
        if len(alive):
            mine = own[i]
            holders = np.concatenate([doc[a:b] for a, b in zip(bounds[mine].tolist(), bounds[mine + 1].tolist(), strict=True)])
            shared = np.bincount(holders, minlength=len(sets))[alive]
            for j in alive[100 * shared >= LEAST * (sizes[i] + sizes[alive] - shared)].tolist():
                if now[j] != now[i]:
                    out.append((comps[i], comps[j]))
                    now[now == now[j]] = now[i]
    return pd.DataFrame(out, columns=["a", "b"])


def components(spark: SparkSession, links: DataFrame, kept: Keep | None = None) -> DataFrame:
    """(key, comp): the least key reachable over ``links`` (a, b), for every key that is not itself the least.

    A pass hooks each node to its least smaller neighbour, follows the hooks to their ends by doubling
    (a chain of n in log2(n) steps) and contracts the links. Of the nodes of a pass only those without a smaller
    neighbour are left; after two passes at most half, so the passes are logarithmic and the work shrinks with the links.
    """
    with scratch(spark, "components") as keep:
        names = None
        edges = keep(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x > y").distinct())
        while not edges.isEmpty():
            hooks = keep(edges.groupBy("x").agg(F.min("y").alias("to")))
            while True:
                doubled = keep(hooks.join(hooks.select(F.col("x").alias("to"), F.col("to").alias("up")), "to", "left"))
                hooks = doubled.select("x", F.coalesce("up", "to").alias("to"))
                if doubled.where("up IS NOT NULL").isEmpty():
                    break
            moved = hooks.select(F.col("x").alias("key"), F.col("to").alias("comp"))
            names = moved if names is None else keep(renamed(names, moved).unionByName(moved))
            ends = edges.join(hooks.withColumnRenamed("to", "tx"), "x").join(hooks.select(F.col("x").alias("y"), F.col("to").alias("ty")), "y", "left")
            ends = ends.select("tx", F.coalesce("ty", "y").alias("ty"))
            edges = keep(ends.select(F.greatest("tx", "ty").alias("x"), F.least("tx", "ty").alias("y")).where("x > y").distinct())
        if names is None:
            names = edges.select(F.col("x").alias("key"), F.col("y").alias("comp"))
        return saved(spark, names, "joined") if kept is None else kept(names)


def renamed(names: DataFrame, moved: DataFrame) -> DataFrame:
    """``names`` (key, comp) after components moved (key, comp)."""
    return names.join(moved.select(F.col("key").alias("comp"), F.col("comp").alias("_to")), "comp", "left").select("key", F.coalesce("_to", "comp").alias("comp"))


def _joined(spark: SparkSession, docs: DataFrame, full: DataFrame, groups: DataFrame, keep: Keep) -> DataFrame:
    """(key, comp) of the heads of equal sets that share a bucket with another."""
    heads = groups.select(F.col("head").alias("key"))
    alone = keep(full.join(heads.distinct(), "key", "left_semi").select("key", "n_shingles", "sig").dropDuplicates(["key", "sig"]))
    held = members(spark, alone, keep)
    inside = held.select("key").distinct()
    few = keep(alone.join(inside, "key", "left_semi"))
    texts = keep(docs.join(inside, "key", "left_semi").dropDuplicates(["key", "text"]), compression="zstd")

    names = inside.withColumn("comp", F.col("key"))

    def joined(links: DataFrame) -> DataFrame:
        return keep(renamed(names, components(spark, links, keep)))

    open_ = opened(held, names, keep)
    for turn in ("min", "max"):
        if open_.isEmpty():
            break
        pick = open_.groupBy("bucket").agg(getattr(F, f"{turn}_by")(F.struct("key", "comp"), "key").alias("hub"))
        pairs = open_.join(pick, "bucket").where("hub.comp <> comp").select(F.least("hub.key", "key").alias("a"), F.greatest("hub.key", "key").alias("b")).distinct()
        new = keep(linked(spark, keep(likely(pairs, few)), texts))
        if turn == "max":  # links of components from here on
            new = new.join(names.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a").join(names.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b")
            new = new.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        names = joined(new)
        # The hub has met all its bucket, or is connected with it: what is left are pairs of the others.
        open_ = opened(open_.join(pick, "bucket").where("key <> hub.key").select("bucket", "key"), names, keep)
    if not open_.isEmpty():
        docs_ = keep(placed(open_, few))
        blocks = docs_.groupBy("bucket", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        inner = blocks.where("lo < hi").select("bucket", F.col("block").alias("block_x"), F.col("block").alias("block_y"))
        names = joined(keep(crossed(spark, docs_, inner, few, texts, keep)))
        wide = blocks.groupBy("bucket").count().where("count > 1").select("bucket")
        docs_ = keep(docs_.drop("comp").join(wide, "bucket", "left_semi").join(names, "key"))
        blocks = docs_.groupBy("bucket", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        x, y = (blocks.select("bucket", *(F.col(c).alias(f"{c}_{i}") for c in ("block", "lo", "hi"))) for i in "xy")
        units = keep(x.join(y, "bucket").where("block_x < block_y AND (lo_x <> hi_y OR hi_x <> lo_y)").select("bucket", "block_x", "block_y"))
        if not units.isEmpty():  # buckets of several blocks: what is joined by now needs no comparison, the rest meets two blocks at a time
            names = joined(keep(crossed(spark, docs_, units, few, texts, keep)))
    return names


def near_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(key, n_shingles, comp) for each row of ``docs`` (key, text)."""
    sigs = saved(spark, signed(docs), "signatures")
    full = sigs.where("same IS NOT NULL")
    groups = saved(spark, full.groupBy("same").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")), "equal")
    with scratch(spark, "near") as keep:
        names = saved(spark, _joined(spark, docs, full, groups, keep), "components")

    heads = groups.join(names.select(F.col("key").alias("head"), "comp"), "head", "left").select("same", F.coalesce("comp", "head").alias("comp"), "n")
    out = sigs.select("key", "n_shingles", "same").join(heads.where("n > 1 OR comp IS NOT NULL"), "same", "left")
    return out.select("key", "n_shingles", F.coalesce("comp", "key").alias("comp"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(spark, keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select(unkeyed().alias("doc_id"), "n_shingles", unkeyed("comp").alias("component_id"), (F.col("key") == F.col("comp")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
