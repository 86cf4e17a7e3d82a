"""Passage deduplication over words by repeated-phrase automata.

1. Confirm: phrases of ``GRAM`` words that recur in several documents (see ``repeats``) are dealt to
   shards by their hash, with the passages of at most ``LENGTH`` words on either side that can be removed
   with them. A shard compares the windows of ``LENGTH`` words of a phrase's passages as text. Runs of windows
   that a document of smaller id holds too are confirmed passages; each knows the greatest of its windows' least
   documents.
2. Compile: confirmed passages go to the blocks of documents in which they were seen. A block compiles
   its phrases into Aho-Corasick automata of at most ``PHRASES`` phrases, over words: each distinct word of the
   phrases is a letter, every other word another one.
3. Stream: each block sends the words of all its documents through its automata. Wherever a phrase occurs, the
   words around it are compared with the phrase's confirmed passages, and the words of an occurrence go if the passage is
   known from a document of smaller id. Nothing is removed that no automaton locates.

Sharding the automata by block of documents, not by phrase alone, sends each document through the
phrases of its block only: the work grows with the text, not with text times phrases.

Defined results: a null or empty text has no words and keeps none; texts with fewer
words than the window keep all of them; a null id counts as the largest id; rows that
repeat an id are no repeats of each other, whatever their texts; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from wavefix.llm.common import block_of, chunks, keyed, merged, partitions, powers, unkeyed, unsqueezed, word_hashes, word_spans
from wavefix.llm.repeats import Rule, beside, found, pieces, with_data

LENGTH, GRAM = 50, 16
#: Phrases in one automaton; their words must have fewer distinct values than Unicode has letters.
PHRASES = 50_000
_MASK = (1 << 64) - 1


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_spans(data)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return word_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def _settled(key: int, pos: int, lo: int, hi: int, passage: bytes, owner: int) -> tuple[int, int, int, bytes]:
    """A passage that ``owner`` of the same block holds whole: (document, owner, phrase's place, words)."""
    return key, owner, lo, passage


def _told(rows: list[tuple[int, int, int, bytes]], n: int) -> Iterator[dict[str, object]]:
    """Confirmed passages (document, owner, phrase's place, words) packed by block, each once with its least owner."""
    least: dict[tuple[int, int, bytes], int] = {}
    if rows:
        blocks = block_of(np.array([x[0] for x in rows], np.int64), n).tolist()
        for block, (_, owner, place, words) in zip(blocks, rows, strict=True):
            at = block, place, words
            least[at] = min(owner, least.get(at, owner))
    order = sorted(least)
    columns = {"keys": np.array([least[x] for x in order], "<i8"), "froms": np.array([x[1] for x in order], "<u4")}
    for row in with_data(np.array([x[0] for x in order], np.int32), columns, [x[2] for x in order]) if order else ():
        yield {**row, "tos": b""}


RULE = Rule(LENGTH, GRAM, _units, bytes.split, b" ".join, True, _settled, _told)


class Passage:
    """A passage's text between blanks, and where its words start in it."""

    __slots__ = ("key", "lo", "text", "at")

    def __init__(self, key: int, lo: int, text: bytes):
        self.key, self.lo, self.text = key, lo, text
        at, out = 0, []
        for w in text.split(b" "):
            out.append(at)
            at += len(w) + 1
        self.at = [*out, at]

    def words(self, first: int, end: int) -> bytes:
        return self.text[self.at[first] : self.at[end] - 1]


def judge(cols: list[np.ndarray], passages: list[bytes]) -> list[tuple[int, int, int, bytes]]:
    """Confirmed passages (document, owner, phrase's place, words): runs of windows that also start in a document of smaller id."""
    h, keys, pos, lo, hi = cols
    out: list[tuple[int, int, int, bytes]] = []
    order = np.lexsort((pos, keys, h))
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0, [True]))).tolist()
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        here: dict[bytes, list[Passage]] = {}
        for i in order[first:end].tolist():
            x = Passage(int(keys[i]), int(lo[i]), passages[i])
            here.setdefault(x.words(x.lo, x.lo + GRAM), []).append(x)
        for same in here.values():
            if same[0].key != same[-1].key:
                out += _confirmed(same)
    return out


def _confirmed(same: list[Passage]) -> Iterator[tuple[int, int, int, bytes]]:
    """The runs among passages of one phrase in order of their documents."""
    first: dict[bytes, int] = {}
    for x in same:
        begin, owner, last = -1, -1, len(x.at) - LENGTH
        for w in range(last):
            least = first.setdefault(x.words(w, w + LENGTH), x.key)
            if least < x.key:
                begin, owner = (w, least) if begin < 0 else (begin, max(owner, least))
            if begin >= 0 and (least == x.key or w == last - 1):
                end = w + LENGTH - (least == x.key)
                yield x.key, owner, x.lo - begin, x.words(begin, end)
                begin = -1


#: The inverse of the base of ``powers``.
_BACK = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))


class Sums:
    """Hashes of any run of words, from running sums of the words' hashes; equal runs have equal hashes anywhere."""

    def __init__(self, units: np.ndarray):
        back = np.full(len(units) + 1, _BACK)
        back[0] = 1
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units * powers(len(units)), dtype=np.uint64)))
        self.back = np.multiply.accumulate(back)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]

    def lists(self) -> tuple[list[int], list[int]]:
        return self.sums.tolist(), self.back.tolist()


#: Confirmed passages of a phrase by place and number of words, then by hash: texts and their owners.
Known = dict[tuple[int, int], dict[int, list[tuple[bytes, int]]]]


class Phrases:
    """An automaton over words that locates phrases, and the confirmed passages of each."""

    def __init__(self, words: np.ndarray, found_: list[list[Known]]):
        """``words`` has the word hashes of each phrase as a row."""
        self.known = np.unique(words)
        self.find = ahocorasick.Automaton()
        for row, at in zip(self._letters(np.searchsorted(self.known, words)), found_, strict=True):
            phrase = row.tobytes().decode("utf-32-le")
            have = self.find.get(phrase, None)
            self.find.add_word(phrase, at if have is None else [*have, *at])
        self.find.make_automaton()

    @staticmethod
    def _letters(i: np.ndarray) -> np.ndarray:
        """Letters for numbers from 0 on, without the range that stands for no letters; the letter 0 is left for other words."""
        return np.where(i + 1 < 0xD800, i + 1, i + 0x801).astype("<u4")

    def located(self, units: np.ndarray) -> Iterator[tuple[int, list]]:
        """Of word hashes: where a phrase starts, and its passages."""
        i = np.minimum(np.searchsorted(self.known, units), len(self.known) - 1)
        text = np.where(self.known[i] == units, self._letters(i), 0).astype("<u4").tobytes().decode("utf-32-le")
        for end, at in self.find.iter(text):
            yield end - GRAM + 1, at


def compiled(owners: np.ndarray, places: np.ndarray, passages: list[bytes], most: int = PHRASES) -> list[Phrases]:
    """Automata of confirmed passages, each of at most ``most`` phrases."""
    by: dict[bytes, Known] = {}
    for a in range(0, len(passages), most):
        part = passages[a : a + most]
        units, bounds = _units(part)
        hashes = Sums(units).of(bounds[:-1], bounds[1:]).tolist()
        for owner, place, text, h in zip(owners[a : a + most].tolist(), places[a : a + most].tolist(), part, hashes, strict=True):
            words = text.split(b" ")
            by.setdefault(b" ".join(words[place : place + GRAM]), {}).setdefault((place, len(words)), {}).setdefault(h, []).append((text, owner))
    phrases, out = list(by), []
    for a in range(0, len(phrases), most):
        part = phrases[a : a + most]
        out.append(Phrases(_units(part)[0].reshape(len(part), GRAM), [[by[x]] for x in part]))
    return out


def occurrences(automata: list[Phrases], keys: list[int], texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each document the word ranges that hold a confirmed passage of a document of smaller id."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    units, bounds = _units(texts)
    ends, split = bounds.tolist(), {}
    sums, back = Sums(units).lists() if automata else ([], [])
    for x in automata:
        for at, found_ in x.located(units):
            d = bisect_right(ends, at) - 1
            first, last, key = ends[d], ends[d + 1], keys[d]
            for phrase in found_:
                for (place, n), same in phrase.items():
                    a = at - place
                    if a < first or a + n > last:
                        continue
                    had = same.get((sums[a + n] - sums[a]) * back[a] & _MASK)
                    if had is None or had[0][1] >= key and all(owner >= key for _, owner in had):
                        continue
                    if d not in split:
                        split[d] = texts[d].split()
                    words = b" ".join(split[d][a - first : a - first + n])
                    if any(owner < key and text == words for text, owner in had):
                        out[d].append((a - first, a - first + n))
    return out


def applied(key: int, text: bytes, spans: list[tuple[int, int]]) -> dict[str, object]:
    words = text.split()
    froms, tos = np.array(spans, np.int64).reshape(-1, 2).T
    kept: list[bytes] = []
    last = 0
    for x, y in zip(*(v.tolist() for v in merged(froms, tos)), strict=True):
        kept += words[last:x]
        last = y
    kept += words[last:]
    return {"key": key, "n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept)}


def _digested(*args: object) -> dict[str, object]:
    row = applied(*args)
    row["kept_sha256"] = hashlib.sha256(row.pop("kept")).hexdigest()
    return row


def streamed(docs: DataFrame, confirmed: DataFrame, n: int, make: Callable[[int, bytes, list[tuple[int, int]]], dict[str, object]], schema: str) -> DataFrame:
    """``make(key, text, ranges)`` for every document, streamed through the automata of its block."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, bytes, bytes, bytes]] = []
        automata: list[Phrases] | None = None
        for pdf in batches:
            first = pdf["kind"] == 0
            held += pdf.loc[first, ["keys", "froms", "size", "data"]].itertuples(index=False, name=None)
            for packed_keys, size, data in pdf.loc[~first, ["keys", "size", "data"]].itertuples(index=False, name=None):
                if automata is None:
                    passages = [x for _, _, s, d in held for x in pieces(s, d)]
                    automata = compiled(unsqueezed([x[0] for x in held], "<i8"), unsqueezed([x[1] for x in held], "<u4"), passages)
                    held.clear()
                for keys, part in chunks(unsqueezed([packed_keys], "<i8"), pieces(size, data)):
                    ids = keys.tolist()
                    yield pd.DataFrame([make(*x) for x in zip(ids, part, occurrences(automata, ids, part), strict=True)])

    return beside(docs, confirmed, n, ["keys", "froms", "tos"]).mapInPandas(stream, schema)


def _removed(spark: SparkSession, docs: DataFrame, make: Callable, schema: str) -> DataFrame:
    n = partitions(spark)
    return streamed(docs, found(docs, n, RULE, judge), n, make, schema)


def phrase_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) with the words that stay."""
    rows = _removed(spark, keyed(docs), applied, "key long, n_words long, n_removed long, kept binary")
    return rows.select(unkeyed().alias("doc_id"), "n_words", "n_removed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _removed(spark, keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")), _digested, "key long, n_words long, n_removed long, kept_sha256 string")
    return rows.select(unkeyed().alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' ')))) AS s FROM w WHERE len(w) >= 50
), least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s), gone AS (
  SELECT DISTINCT doc_id, k FROM win JOIN least USING (s), unnest(range(i, i + 50)) AS t(k) WHERE m < doc_id
), words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM w), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS x FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
