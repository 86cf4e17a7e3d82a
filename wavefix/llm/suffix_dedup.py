"""Substring deduplication over bytes by deep-shallow suffix sorting.

The suffixes that can share ``LENGTH`` bytes with another are those around recurring
anchors (see ``repeats``); each shard sorts the suffixes that start at its anchors.

Shallow: multikey quicksort, a machine word (8 bytes) of all suffixes at a time, each
word ordering only suffixes still tied, down to the gram's depth. Deep: the
suffixes of a group still tied there are put one by one, in document order,
into a blind trie (only branching bytes are compared on the way down, then one
stored suffix tells the real common prefix). The nodes on a suffix's path give its
common prefixes with all earlier suffixes, and each node keeps the bytes before
its suffixes in order, so the nearest neighbours tell how far a match reaches back.
Reaches in both directions give the windows that occurred before.

Defined results: a null or empty text has no bytes and keeps none; texts shorter than
the window are kept whole; a null id counts as the largest id; rows that repeat an
id are one document: what is found in any of them is cut from all; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from wavefix.llm.common import byte_units, keyed, merged, partitions, unkeyed
from wavefix.llm.repeats import Rule, finished, found, ranges

LENGTH, GRAM = 100, 40


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return byte_units(b"".join(texts)), np.cumsum([0, *map(len, texts)])


def _settled(key: int, pos: int, lo: int, hi: int, passage: bytes, owner: int) -> tuple[int, int, int]:
    return key, pos - lo, pos - hi + LENGTH


RULE = Rule(LENGTH, GRAM, _units, bytes, bytes, False, _settled, ranges)


def shallow_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of rows of 64-bit words and, for the ordered rows, whether each differs from the one before.

    Each round orders by one more word the rows that are still tied.
    """
    order = np.arange(len(words))
    new = np.zeros(len(words), bool)
    new[:1] = True
    for k in range(words.shape[1]):
        tied = ~new | ~np.concatenate((new[1:], [True]))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        word = words[order[at], k]
        inner = np.lexsort((word, group))
        order[at] = order[at][inner]
        word, group = word[inner], group[inner]
        new[at[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
    return order, new


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((x & -x).bit_length() - 1) >> 3


class _Node:
    __slots__ = ("depth", "kids", "sample", "lefts")

    def __init__(self, depth: int, sample: bytes, lefts: list[bytes]):
        self.depth, self.sample, self.lefts, self.kids = depth, sample, lefts, {}


class BlindTrie:
    """Suffixes by their first bytes; ``add`` tells how far the new one agrees with those before it."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def add(self, right: bytes, left: bytes) -> list[tuple[int, int]]:
        """Pairs (bytes after, bytes before) in which ``right`` and ``left`` (reversed) agree with an earlier suffix, deepest last."""
        if self.root is None:
            self.root = _Node(len(right), right, [left])
            return []
        node, path = self.root, []
        while True:  # blind: only the branching bytes are looked at
            path.append(node)
            if node.depth >= len(right):
                break
            kid = node.kids.get(right[node.depth])
            if kid is None:
                break
            node = kid
        real = common(right, node.sample)
        while len(path) > 1 and path[-2].depth >= real:
            path.pop()
        out = []
        for v in path:
            out.append((min(v.depth, real), self._before(v.lefts, left)))
        last = path[-1]
        if last.depth > real:  # the edge to ``last`` splits, or the new suffix ends on it
            upper = _Node(real, last.sample, last.lefts.copy())
            upper.kids[last.sample[real]] = last
            if len(path) > 1:
                path[-2].kids[last.sample[path[-2].depth]] = upper
            else:
                self.root = upper
            path[-1] = last = upper
        if len(right) > last.depth:
            last.kids[right[last.depth]] = _Node(len(right), right, [left])
        for v in path:
            at = bisect_left(v.lefts, left)
            if at == len(v.lefts) or v.lefts[at] != left:
                v.lefts.insert(at, left)
        return out

    @staticmethod
    def _before(lefts: list[bytes], left: bytes) -> int:
        at = bisect_left(lefts, left)
        return max(common(left, lefts[at]) if at < len(lefts) else 0, common(left, lefts[at - 1]) if at else 0)


def judge(cols: list[np.ndarray], passages: list[bytes]) -> list[tuple[int, int, int]]:
    """Ranges (document, from, to) of windows that start earlier elsewhere, among the passages of a shard."""
    _, keys, pos, lo, hi = cols
    order = np.lexsort((pos, keys))
    words = np.frombuffer(b"".join([passages[i][lo[i] : lo[i] + GRAM] for i in order.tolist()]), ">u8").reshape(-1, GRAM // 8).astype(np.uint64)
    inner, new = shallow_order(words)
    order = order[inner]
    cuts = np.flatnonzero(np.concatenate((new, [True])))
    out: list[tuple[int, int, int]] = []
    many = np.flatnonzero(np.diff(cuts) > 1)
    for first, end in zip(cuts[many].tolist(), cuts[many + 1].tolist(), strict=True):
        trie = BlindTrie()
        seen: set[tuple[int, bytes]] = set()
        for i in order[first:end].tolist():
            text, a, b, p, key = passages[i], int(lo[i]), int(hi[i]), int(pos[i]), int(keys[i])
            if (a, text) in seen:
                out.append((key, p - a, p - b + LENGTH))
                continue
            seen.add((a, text))
            for after, before in trie.add(text[a + GRAM :], text[:a][::-1]):
                far, near = min(a, before), max(b, LENGTH - GRAM - after)
                if far >= near:
                    out.append((key, p - far, p - near + LENGTH))
    return out


def applied(key: int, text: bytes, froms: np.ndarray, tos: np.ndarray) -> dict[str, object]:
    a, b = merged(froms, np.minimum(tos, len(text)))
    edges = [0, *np.column_stack((a, b)).ravel().tolist(), len(text)]
    kept = b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
    return {"key": key, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(a), "kept": kept}


def _digested(*args: object) -> dict[str, object]:
    row = applied(*args)
    row["kept_sha256"] = hashlib.sha256(row.pop("kept")).hexdigest()
    return row


def _removed(spark: SparkSession, docs: DataFrame, make: Callable, schema: str) -> DataFrame:
    n = partitions(spark)
    return finished(docs, found(docs, n, RULE, judge), n, make, schema)


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) with the bytes that stay."""
    rows = _removed(spark, keyed(docs), applied, "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return rows.select(unkeyed().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = _removed(spark, keyed(docs), _digested, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.select(unkeyed().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), win AS (
  SELECT doc_id, unnest(range(0, CAST(len(x) // 2 - 99 AS BIGINT))) AS i, unnest(list_transform(range(0, CAST(len(x) // 2 - 99 AS BIGINT)), lambda i: md5_number(substr(x, 2 * i + 1, 200)))) AS s FROM b WHERE len(x) >= 200
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), marked AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM hit)
), runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM marked GROUP BY doc_id, run), edges AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a FROM runs
  UNION ALL SELECT doc_id, coalesce((SELECT max(z) FROM runs r WHERE r.doc_id = b.doc_id), 0), len(x) // 2 FROM b
), kept AS (
  SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY p, a) AS k FROM edges JOIN b USING (doc_id) GROUP BY doc_id
), n AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY 1)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST((len(x) - len(k)) // 2 AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
