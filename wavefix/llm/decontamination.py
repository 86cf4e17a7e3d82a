"""Benchmark decontamination by a generalised suffix automaton of the test items.

The words of the items make a suffix automaton. A document's words stream through
it; the automaton's state and the matched length tell at each word the longest
run of words ending there that occurs in an item. A matched length of ``window``
words or more hits the last ``window`` words, and so does a shorter item matched whole.

The automaton is sent to every task. Its size is bounded: items are dealt into shards
of at most ``shard_words`` words (a longer item is a shard of its own). Documents pass through
one shard after another; between two they are written with what was found, and the shard is given up,
so that driver and tasks hold one at a time.

Defined results: a null or empty text has no words; an item without words is
ignored; items of equal id count once; a null item id counts as the id ''; other
columns of either table are ignored; repeated documents give repeated rows; an empty
table of documents gives no rows, without items nothing is hit.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm.common import removed, shared_dir, written

#: What is found in a document: runs of hit words, items, and its number of words.
HITS = "struct<spans: array<struct<a: int, b: int>>, items: array<string>, n_words: bigint>"
#: Words once A-Z are lower-cased; UTF-8 bytes above 7F belong to words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


#: No symbol leads on from a state, or several do.
_NONE, _SEVERAL = -1, -2


class ItemAutomaton:
    """Generalised suffix automaton over words, with the items of each state that matters.

    States are numbers into flat arrays. Nearly all have one way on, which two of the arrays hold; the others have
    a dictionary. Items are kept where the state's window is met first: one as its number, several as a set.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.symbol, self.only = array("i", [_NONE]), array("i", [0])
        self.several: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.ids = [x for x, _ in items]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        # States may be cloned while others are added: only now are the states that each item passes final.
        n = len(self.link)
        self.owner, self.owners = array("i", [-1]) * n, []
        own: dict[int, list[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(items):
            v = 0
            for k, w in enumerate(words, 1):
                v = self._way(v, self.vocabulary[w])
                if k >= window:
                    self._own(v, i)
            if 0 < len(words) < window:
                own.setdefault(v, []).append((len(words), i))
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.shorts: dict[int, tuple[tuple[int, int], ...]] = {}
        self.top = array("i", [0]) * n
        for v in order:
            up = self.link[v]
            short = (*own.get(v, ()), *self.shorts.get(up, ()))
            if short:
                self.shorts[v] = short
            if self.length[v] >= window:
                self.top[v] = v if self.length[up] < window else self.top[up]
        for v in reversed(order):
            if self.top[v] not in (0, v):
                for i in self.items_of(v):
                    self._own(self.link[v], i)
                self._disown(v)

    def _way(self, v: int, c: int) -> int | None:
        if self.symbol[v] == c:
            return self.only[v]
        return self.several[v].get(c) if self.symbol[v] == _SEVERAL else None

    def _lead(self, v: int, c: int, to: int) -> None:
        was = self.symbol[v]
        if was == _SEVERAL:
            self.several[v][c] = to
        elif was in (_NONE, c):
            self.symbol[v], self.only[v] = c, to
        else:
            self.several[v] = {was: self.only[v], c: to}
            self.symbol[v] = _SEVERAL

    def _state(self, link: int, length: int) -> int:
        self.symbol.append(_NONE)
        self.only.append(0)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self._way(last, c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._state(0, self.length[last] + 1), last
        while p != -1 and (q := self._way(p, c)) is None:
            self._lead(p, c, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.link[q], self.length[p] + 1)
        self.symbol[copy], self.only[copy] = self.symbol[q], self.only[q]
        if q in self.several:
            self.several[copy] = dict(self.several[q])
        self.link[q] = copy
        while p != -1 and self._way(p, c) == q:
            self._lead(p, c, copy)
            p = self.link[p]
        return copy

    def _own(self, v: int, item: int) -> None:
        was = self.owner[v]
        if was == -1:
            self.owner[v] = item
        elif was < -1:
            self.owners[-2 - was].add(item)
        elif was != item:
            self.owner[v] = -2 - len(self.owners)
            self.owners.append({was, item})

    def _disown(self, v: int) -> None:
        if self.owner[v] < -1:
            self.owners[-2 - self.owner[v]] = set()
        self.owner[v] = -1

    def items_of(self, v: int) -> set[int]:
        """Items (numbers) whose windows end in state ``v``."""
        x = self.owner[v]
        return set() if x == -1 else {x} if x >= 0 else self.owners[-2 - x]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of words in occurring windows, not merged, and the items that own the windows."""
        symbol, only, several, link, length, shorts, window = self.symbol, self.only, self.several, self.link, self.length, self.shorts, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = n = seen = 0
        for i, c in enumerate(map(self.vocabulary.get, words), 1):
            if c is None:
                v = n = 0
                continue
            while True:
                to = only[v] if symbol[v] == c else several[v].get(c) if symbol[v] == _SEVERAL else None
                if to is not None or not v:
                    break
                v = link[v]
                n = length[v]
            if to is None:
                continue
            v = to
            n += 1
            if n >= window:
                spans.append((i - window, i))
                u = self.top[v]
                if u and u != seen:
                    seen = u
                    found |= self.items_of(u)
            if v in shorts:
                for k, item in shorts[v]:
                    if k <= n:
                        spans.append((i - k, i))
                        found.add(item)
        return spans, {self.ids[x] for x in found}


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(items: DataFrame, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in lists of at most ``shard_words`` words each, read one list at a time."""
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        words = words_of(row.text)
        if words:
            if held and size + len(words) > shard_words:
                yield held
                held, size = [], 0
            held.append((row.i, words))
            size += len(words)
    yield held


def scored(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 13, coverage: float = 0.05, shard_words: int = 1 << 20) -> DataFrame:
    """``docs`` with spans, items, n_words, n_hit and contaminated (columns of these names are replaced).

    ``spans`` are maximal runs of hit words (from, to); ``items`` the sorted ids of the items with
    windows in the document; it is contaminated if hit words are at least ``coverage`` of all, and any.
    """
    least = Fraction(str(coverage))
    name = "_hits"
    while name in docs.columns:
        name += "_"
    out, table = docs.withColumn(name, F.lit(None).cast(HITS)), None
    parts = shards(items, shard_words)
    part = next(parts)
    while part is not None:
        sent = spark.sparkContext.broadcast(ItemAutomaton(part, window))
        out = out.withColumn(name, _step(sent)(F.col("text"), F.col(name)))
        part = next(parts, None)
        if part is not None:  # written, so that no task ever holds two shards
            before, table = table, shared_dir(spark, "decontamination")
            out = written(spark, out, table)
            sent.destroy()
            if before:
                removed(spark, before)
    n_hit = F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda n, x: n + (x["b"] - x["a"]))
    return out.withColumns({"spans": F.col(f"{name}.spans"), "items": F.col(f"{name}.items"), "n_words": F.col(f"{name}.n_words"), "n_hit": n_hit}).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least.denominator >= F.col("n_words") * least.numerator)).drop(name)


def _step(sent: Broadcast) -> Callable[[Column, Column], Column]:
    """Add what one automaton finds to what those before it have found."""

    @F.pandas_udf(HITS)
    def step(text: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        automaton = sent.value
        spans, ids, counts = [], [], []
        for t, was, had in zip(text, before["spans"], before["items"], strict=True):
            words = words_of(t)
            hit, names = automaton.match(words)
            hit += [(x["a"], x["b"]) for x in was] if was is not None else []
            spans.append([{"a": a, "b": b} for a, b in joined(hit)])
            ids.append(sorted(names.union(had if had is not None else ())))
            counts.append(len(words))
        return pd.DataFrame({"spans": spans, "items": ids, "n_words": counts})

    return step


def cleaned(rows: DataFrame, longest: int = 13) -> DataFrame:
    """Add ``clean_text`` to the rows of ``scored``: without each span of at least ``longest`` words (and the text between its words)."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            gone = [(x["a"], x["b"]) for x in found if x["b"] - x["a"] >= longest] if found is not None else []
            if not t or not gone:
                out.append(t)
                continue
            data = t.encode("utf-8", "replace")
            at = [m.span() for m in WORD.finditer(data.lower())]
            kept, last = [], 0
            for a, b in gone:
                kept.append(data[last : at[a][0]])
                last = at[b - 1][1]
            out.append(b"".join([*kept, data[last:]]).decode())
        return pd.Series(out, dtype=object)

    return rows.withColumn("clean_text", cut("text", "spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s, least(len(w), 13) AS n
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win), pos AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS s
  FROM low, sizes WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.i, p.n, v.item FROM pos p JOIN win v ON v.s = p.s AND v.n = p.n
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY 1
), named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
