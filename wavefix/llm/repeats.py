"""Routing shared by the two repeated-passage operators.

Every window of a document is assigned to the least-hashed gram inside it (its
anchor), so equal windows are assigned to equal grams at equal offsets. Then

1. ``gathered``: anchors meet by their gram's hash, as packed numbers; those that recur go
   back to their documents' blocks;
2. ``cut``: there the text around each recurring anchor, as far as its windows reach,
   is cut out and sent to the shard of its gram;
3. ``judged``: a shard compares the passages of each of its grams (this is what the
   operators differ in) and tells what it has found: ranges to remove, or confirmed passages;
4. ``finished``, or an operator's own last step: that returns to the blocks of the documents and
   is applied to the whole texts.

Hot passages: the anchors of equal grams in one input batch, and equal passages in one
block, meet where they are. Only the first goes on; the others are settled. So a gram
reaches a shard at most once for each batch or block, however many rows hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefix.llm.common import anchors, block_of, chunks, gram_hashes, packed, routed, squeezed, unsqueezed, window_minima

#: Packed columns of an anchor: hash, document, position, how far before it its first and last window start.
FIELDS = {"h": "<u8", "keys": "<i8", "pos": "<u4", "lo": "<u2", "hi": "<u2"}
#: Bytes of passages that a task gathers before it sends them on.
FLUSH = 1 << 25
#: Bits of the hash that are kept: a chance agreement costs a comparison, no wrong result.
KEPT = np.uint64(0xFFFFFFFFFFFF0000)
_PACKED = ", ".join(f"{k} binary" for k in FIELDS)
TOLD = ["target", "keys", "froms", "tos", "size", "data"]


@dataclass(frozen=True)
class Rule:
    """What makes passages repeats."""

    window: int
    gram: int
    #: Unit hashes of documents' bytes and the bounds of each document in them.
    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    #: Splits a text into what positions count, and joins a slice of that.
    split: Callable[[bytes], bytes | list[bytes]]
    join: Callable[[bytes | list[bytes]], bytes]
    #: Only repeats in another document count.
    across: bool
    #: What is told of a passage (document, position, distances to the first and last window) that an earlier document
    #: of the block holds too (its id comes last), and how what is told is packed by block.
    settled: Callable[[int, int, int, int, bytes, int], tuple]
    told: Callable[[list[tuple], int], Iterator[dict[str, object]]]


def chunk_anchors(units: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Hash, document's index, position, and the two distances of all anchors in several documents."""
    if len(bounds) == 2:
        h, pos, lo, hi = anchors(units, rule.window, rule.gram)
        return h, np.zeros(len(h), np.int64), pos, lo, hi
    h = gram_hashes(units, rule.gram)
    best = window_minima(h, rule.window - rule.gram + 1)
    room = np.maximum(np.diff(bounds) - rule.window + 1, 0)
    total = int(room.sum())
    if not total:
        empty = np.empty(0, np.int64)
        return np.empty(0, np.uint64), empty, empty, empty, empty
    doc = np.repeat(np.arange(len(room)), room)
    start = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + bounds[:-1][doc]
    best = best[start]
    first = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    last = np.concatenate((first[1:], [total])) - 1
    pos, doc = best[first], doc[first]
    return h[pos], doc, pos - bounds[doc], pos - start[first], pos - start[last]


def _rows(rows: Iterator[dict[str, object]], **also: object) -> Iterator[pd.DataFrame]:
    made = list(rows)
    if made:
        yield pd.DataFrame(made).assign(**also)


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(16)) % np.uint64(n)).astype(np.int32)


def gathered(docs: DataFrame, n: int, rule: Rule) -> DataFrame:
    """Anchors that recur, packed by the block of their document."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[list[np.ndarray]] = [[] for _ in FIELDS]
            texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
            for keys, part in chunks(pdf["key"].to_numpy(), texts):
                h, doc, *rest = chunk_anchors(*rule.units(part), rule)
                for x, y in zip(found, (h & KEPT, keys[doc], *rest), strict=True):
                    x.append(y)
            cols = {k: np.concatenate(x).astype(kind) if x else np.empty(0, kind) for (k, kind), x in zip(FIELDS.items(), found, strict=True)}
            order = np.lexsort((cols["keys"], cols["h"]))
            cols = {k: x[order] for k, x in cols.items()}
            if not len(order):
                continue
            new, settled = _recurring(cols["h"], cols["keys"], None, rule.across)
            ask = new | ~settled
            yield from _rows(packed(_shard(cols["h"], n)[ask], {**{k: x[ask] for k, x in cols.items()}, "known": settled[ask]}), kind=0)
            told = settled & ~new
            block = block_of(cols["keys"], n)
            yield from _rows(packed(block[told], {k: x[told] for k, x in cols.items()}), kind=1, known=b"")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[bytes]] = [[] for _ in range(len(FIELDS) + 1)]
        for pdf in batches:
            passed = pdf[pdf["kind"] == 1]
            if len(passed):
                yield passed[["target", *FIELDS]]
            for x, name in zip(held, [*FIELDS, "known"], strict=True):
                x += pdf.loc[pdf["kind"] == 0, name].tolist()
        if held[0]:
            cols = {k: unsqueezed(x, kind) for (k, kind), x in zip({**FIELDS, "known": "?"}.items(), held, strict=True)}
            order = np.lexsort((cols["keys"], cols["h"]))
            cols = {k: x[order] for k, x in cols.items()}
            _, keep = _recurring(cols["h"], cols["keys"], cols.pop("known"), rule.across)
            yield from _rows(packed(block_of(cols["keys"], n)[keep], {k: x[keep] for k, x in cols.items()}))

    dealt = docs.mapInPandas(deal, f"target int, kind int, {_PACKED}, known binary")
    return dealt.repartitionById(n, F.col("target")).mapInPandas(meet, f"target int, {_PACKED}")


def _recurring(h: np.ndarray, keys: np.ndarray, known: np.ndarray | None, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """For anchors sorted by hash and document: which is the first of its hash, and which belong to a hash that recurs."""
    new = np.concatenate(([True], h[1:] != h[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(h)])) - 1
    many = keys[first] != keys[last] if across else first != last
    if known is not None:
        many = many | np.logical_or.reduceat(known, first)
    return new, np.repeat(many, last - first + 1)


def beside(docs: DataFrame, rows: DataFrame, n: int, names: list[str]) -> DataFrame:
    """Texts and packed rows of the same block in one partition, packed rows first."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            blocks, keys = block_of(pdf["key"].to_numpy(), n), pdf["key"].to_numpy()
            order = np.argsort(blocks, kind="stable")
            texts = [t.encode("utf-8", "replace") for t in pdf["text"]]
            yield from _rows(with_data(blocks[order], {"keys": keys[order]}, [texts[i] for i in order.tolist()]))

    empty = F.lit(None).cast("binary")
    texts = docs.mapInPandas(pack, "target int, keys binary, size binary, data binary")
    texts = texts.select("target", F.lit(1).alias("kind"), "size", "data", *(F.col(c) if c == "keys" else empty.alias(c) for c in names))
    notes = rows.select("target", F.lit(0).alias("kind"), *(F.col(c) if c in rows.columns else empty.alias(c) for c in ("size", "data")), *names)
    return routed(notes.unionByName(texts), n, "kind")


def with_data(targets: np.ndarray, columns: dict[str, np.ndarray], data: list[bytes]) -> Iterator[dict[str, object]]:
    """``packed`` with pieces of text; everything is sorted by target already."""
    cuts = np.flatnonzero(np.concatenate(([True], targets[1:] != targets[:-1], [True]))).tolist() if len(targets) else [0]
    press = zstandard.ZstdCompressor(level=3)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sizes = np.array([len(x) for x in data[a:b]], "<u4")
        yield {"target": int(targets[a]), **{k: squeezed(v[a:b]) for k, v in columns.items()}, "size": squeezed(sizes), "data": press.compress(b"".join(data[a:b]))}


def pieces(size: bytes, data: bytes) -> list[bytes]:
    """The pieces of text of one ``with_data`` row."""
    ends = np.cumsum(unsqueezed([size], "<u4").astype(np.int64)).tolist()
    whole = zstandard.ZstdDecompressor().decompress(data)
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def by_document(batches: Iterator[pd.DataFrame], kinds: dict[str, str]) -> Iterator[Iterator[tuple[int, bytes, dict[str, np.ndarray], int, int]]]:
    """For each pack of texts: (key, text, columns, from, to), the last three its block's notes sorted by ``keys`` and this document's slice."""
    held: dict[str, list[bytes]] = {k: [] for k in kinds}
    notes: dict[str, np.ndarray] | None = None
    for pdf in batches:
        first = pdf["kind"] == 0
        if first.any():
            notes = None
            for k, x in held.items():
                x += pdf.loc[first, k].tolist()
        for _, row in pdf[~first].iterrows():
            if notes is None:
                notes = {k: unsqueezed(x, kinds[k]) for k, x in held.items()}
                order = np.argsort(notes["keys"], kind="stable")
                notes = {k: x[order] for k, x in notes.items()}
            keys = unsqueezed([row["keys"]], "<i8")
            a, b = np.searchsorted(notes["keys"], keys), np.searchsorted(notes["keys"], keys, "right")
            yield zip(keys.tolist(), pieces(row["size"], row["data"]), repeat(notes), a.tolist(), b.tolist(), strict=False)


def cut(docs: DataFrame, found: DataFrame, n: int, rule: Rule) -> DataFrame:
    """Passages around recurring anchors by the shard of their gram (kind 0), and what is settled at once (kind 1)."""

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, tuple[int, int]] = {}
        out: list[tuple[int, int, int, int, int]] = []
        data: list[bytes] = []
        gone: list[tuple] = []
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal held
            if out:
                cols = {k: np.array(x, kind) for (k, kind), x in zip(FIELDS.items(), zip(*out, strict=True), strict=True)}
                target = _shard(cols["h"], n)
                order = np.argsort(target, kind="stable")
                yield from _rows(with_data(target[order], {k: x[order] for k, x in cols.items()}, [data[i] for i in order.tolist()]), kind=0, froms=b"", tos=b"")
            yield from _rows(rule.told(gone, n), kind=1, h=b"", pos=b"", lo=b"", hi=b"")
            out.clear(), data.clear(), gone.clear()
            held = 0

        for docs_ in by_document(batches, FIELDS):
            for key, text, notes, i, j in docs_:
                if i == j:
                    continue
                units = rule.split(text)
                h, pos, lo, hi = (notes[c][i:j].tolist() for c in ("h", "pos", "lo", "hi"))
                for h_, p, a, b in sorted(set(zip(h, pos, lo, hi, strict=True)), key=lambda x: x[1]):
                    if p - b + rule.window > len(units) or p < a:
                        continue
                    passage = rule.join(units[p - a : p - b + rule.window])
                    mark = hashlib.blake2b(passage, digest_size=16, salt=a.to_bytes(8, "little"), person=h_.to_bytes(8, "little")).digest()
                    was = seen.get(mark)
                    if was is None or (key, p) < was:
                        seen[mark] = key, p
                    elif was == (key, p):
                        continue
                    elif not rule.across or was[0] < key:
                        gone.append(rule.settled(key, p, a, b, passage, was[0]))
                        continue
                    out.append((h_, key, p, a, b))
                    data.append(passage)
                    held += len(passage)
            if held > FLUSH:
                yield from flush()
        yield from flush()

    names = list(FIELDS)
    return beside(docs, found, n, names).mapInPandas(slices, f"target int, kind int, {_PACKED}, size binary, data binary, froms binary, tos binary")


def ranges(rows: list[tuple[int, int, int]], n: int) -> Iterator[dict[str, object]]:
    """Ranges (document, from, to) packed by block."""
    if rows:
        keys, a, b = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        for row in packed(block_of(keys, n), {"keys": keys, "froms": a.astype("<u4"), "tos": b.astype("<u4")}):
            yield {**row, "size": b"", "data": b""}


def judged(passages: DataFrame, n: int, rule: Rule, judge: Callable[[list[np.ndarray], list[bytes]], list[tuple]]) -> DataFrame:
    """What ``judge`` finds, packed by block. It gets [h, keys, pos, lo, hi] and the passages of one shard."""

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[bytes]] = {k: [] for k in [*FIELDS, "size", "data"]}
        for pdf in batches:
            passed = pdf[pdf["kind"] == 1]
            if len(passed):
                yield passed[TOLD]
            for k, x in held.items():
                x += pdf.loc[pdf["kind"] == 0, k].tolist()
        if held["h"]:
            parts = [x for size, data in zip(held["size"], held["data"], strict=True) for x in pieces(size, data)]
            yield from _rows(rule.told(judge([unsqueezed(held[k], kind) for k, kind in FIELDS.items()], parts), n))

    return passages.repartitionById(n, F.col("target")).mapInPandas(shard, "target int, keys binary, froms binary, tos binary, size binary, data binary")


def finished(docs: DataFrame, ranges: DataFrame, n: int, make: Callable[[int, bytes, np.ndarray, np.ndarray], dict[str, object]], schema: str) -> DataFrame:
    """``make(key, text, froms, tos)`` for every document."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs_ in by_document(batches, {"keys": "<i8", "froms": "<u4", "tos": "<u4"}):
            yield pd.DataFrame([make(key, text, notes["froms"][i:j].astype(np.int64), notes["tos"][i:j].astype(np.int64)) for key, text, notes, i, j in docs_])

    return beside(docs, ranges, n, ["keys", "froms", "tos"]).mapInPandas(apply, schema)


def found(docs: DataFrame, n: int, rule: Rule, judge: Callable) -> DataFrame:
    """The first three steps over ``docs`` (key, text)."""
    return judged(cut(docs, gathered(docs, n, rule), n, rule), n, rule, judge)
