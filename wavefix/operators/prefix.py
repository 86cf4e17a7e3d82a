"""Ordered recurrences as prefix products, so that one key's series runs in many tasks.

A recurrence whose steps compose associatively (a Kalman filter, a hidden Markov model, exponential
smoothing) needs no fold over rows. A series is cut into blocks of time; each block's steps are
composed on their own; the blocks' products are composed along each key, a row for each block; then every
block starts from the product before it. Inside a block products are taken pair by pair, whole arrays at a time.

A block is held in memory by its task, and a key's block products by one task: ``block_s`` is to be chosen so that
both are small. Rows of equal time are in one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a block.
BLOCK_S = 60.0

type Columns = dict[str, np.ndarray]


class Algebra(Protocol):
    """Steps as rows of numbers: how to make them of values, compose them, and read results off products that begin with a fresh step."""

    values: dict[str, str]
    out: dict[str, str]
    def lift(self, now: Columns, before: Columns, fresh: np.ndarray) -> np.ndarray: ...

    def combine(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def identity(self) -> np.ndarray: ...

    def read(self, products: np.ndarray) -> Columns: ...


def scan(steps: np.ndarray, first: np.ndarray, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Products of each row with all before it since the last ``first`` one; twice as many compositions as rows."""
    n = len(steps)
    if n < 2:
        return steps
    join = lambda a, b, cut: np.where(cut[:, None], b, combine(a, b))
    halves = n // 2
    pairs = join(steps[0 : 2 * halves : 2], steps[1::2], first[1::2])
    done = scan(pairs, first[0 : 2 * halves : 2] | first[1::2], combine)
    out = np.empty_like(steps)
    out[1::2], out[0] = done, steps[0]
    rest = steps[2::2]
    if len(rest):
        out[2::2] = join(done[: len(rest)], rest, first[2::2])
    return out


def whole(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew, so that no group of ``keys`` is split; a group that spans batches is put together."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        at = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if at:
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held = [pdf.iloc[at:]]
        elif held and (held[-1][keys].iloc[-1] != pdf[keys].iloc[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where a group of ``keys`` begins."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _shifted(now: Columns) -> Columns:
    return {c: np.concatenate((v[:1], v[:-1])) for c, v in now.items()}


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _types(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def _after(rows: DataFrame, before: DataFrame, mark: str) -> DataFrame:
    """Rows and, ahead of them, what comes before their blocks (``mark`` is null in rows); numbers are never null, lest they lose digits."""
    kinds = dict(rows.dtypes)
    led = before.select(*before.columns, *(F.lit(0).cast(kinds[c]).alias(c) for c in rows.columns if c not in before.columns))
    return rows.withColumn(mark, F.lit(None).cast(dict(before.dtypes)[mark])).unionByName(led)


def blocks(df: DataFrame, t: str, block_s: float) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(t) / block_s).cast("long"))


def prefixed(df: DataFrame, keys: list[str], order: list[str], algebra: Algebra, keep: list[str], block_s: float = BLOCK_S) -> DataFrame:
    """For each row ``keep`` and what ``algebra`` reads off the product of its key's rows up to it; ``order`` begins with the time in seconds."""
    names = list(algebra.values)
    rows = blocks(df.select(*dict.fromkeys([*keys, *order, *names, *keep])), order[0], block_s)
    kinds = ", ".join(f"{n} {k}" for n, k in algebra.values.items())

    def columns(pdf: pd.DataFrame, mark: str = "") -> Columns:
        return {n: pdf[f"{mark}{n}"].to_numpy() for n in names}

    def composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each block: its first and last values, and the product of its steps but the first."""
        for pdf in whole(batches, [*keys, "_block"]):
            first = starts(pdf, [*keys, "_block"])
            now = columns(pdf)
            steps = algebra.lift(now, _shifted(now), np.zeros(len(pdf), bool))
            steps[first] = algebra.identity()
            begin = np.flatnonzero(first)
            end = np.append(begin[1:], len(pdf)) - 1
            product = scan(steps, first, algebra.combine)[end]
            out = pdf.iloc[begin][[*keys, "_block", *names]].reset_index(drop=True)
            yield out.assign(**{f"last_{n}": v[end] for n, v in now.items()}, _step=[p.tobytes() for p in product])

    lasts = ", ".join(f"last_{n} {k}" for n, k in algebra.values.items())
    per = _dealt(rows, [*keys, "_block"], order).mapInPandas(composed, f"{_types(rows, [*keys, '_block'])}, {kinds}, {lasts}, _step binary")

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each block but a key's first: the values and the product before it."""
        for pdf in whole(batches, keys):
            first = starts(pdf, keys)
            rest = np.stack([np.frombuffer(s) for s in pdf["_step"]])
            lead = algebra.lift(columns(pdf), _shifted(columns(pdf, "last_")), first)
            done = scan(algebra.combine(lead, rest), first, algebra.combine)
            after = np.flatnonzero(~first)
            out = pdf.iloc[after][[*keys, "_block"]].reset_index(drop=True)
            yield out.assign(**{n: v[after - 1] for n, v in columns(pdf, "last_").items()}, _step=[p.tobytes() for p in done[after - 1]])

    before = _dealt(per, keys, ["_block"]).mapInPandas(along, f"{_types(rows, [*keys, '_block'])}, {kinds}, _step binary")

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole(batches, [*keys, "_block"]):
            first, given = starts(pdf, [*keys, "_block"]), pdf["_step"].notna().to_numpy()
            now = columns(pdf)
            steps = algebra.lift(now, _shifted(now), first & ~given)
            if given.any():
                steps[given] = np.stack([np.frombuffer(s) for s in pdf["_step"][given]])
            products = scan(steps, first, algebra.combine)[~given]
            yield pdf[~given][keep].reset_index(drop=True).assign(**algebra.read(products))

    # A block's start leads its rows.
    both = _after(rows, before, "_step")
    lead = F.col("_step").isNull()
    both = both.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", lead, *order)
    results = ", ".join(f"{n} {k}" for n, k in algebra.out.items())
    return both.select(*dict.fromkeys([*keys, "_block", *names, *keep, "_step"])).mapInPandas(finished, f"{_types(rows, keep)}, {results}")


# --- rows at least so far apart ----------------------------------------------------


def _next(t: np.ndarray, block: np.ndarray, least: float) -> np.ndarray:
    """For each row the first later row of its block at least ``least`` after it; the number of rows if there is none."""
    n, end = len(t), np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(t))
    until = np.repeat(end, np.diff(end, prepend=0))
    at = np.arange(n)
    out, high = at + 1, until.copy()
    while (open_ := out < high).any():  # sorted search, for all rows at once
        mid = (out + high) // 2
        near = open_ & (t[np.minimum(mid, n - 1)] - t < least)
        out, high = np.where(near, mid + 1, out), np.where(open_ & ~near, mid, high)
    return np.where(out < until, out, n)


def throttled(df: DataFrame, key: str, t: str, order: str, least: float, block_s: float = BLOCK_S) -> DataFrame:
    """Rows (key, order, t) at least ``least`` seconds after the last one kept.

    In a block every row points to the next one kept after it. Only rows in the first ``least`` seconds, or the first one after, can be
    the block's first kept; where the chain of each ends is known by doubling the pointers. So blocks are followed along a key one
    at a time, without their rows, and the rows kept are marked by doubling again.
    """
    rows = blocks(df.select(key, t, order), t, block_s)
    both = [key, "_block"]

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole(batches, both):
            first, at = starts(pdf, both), pdf[t].to_numpy()
            block = np.cumsum(first)
            to = _next(at, block, least)
            ends = np.where(to < len(at), to, np.arange(len(at)))
            while (again := ends[ends] != ends).any():
                ends = np.where(again, ends[ends], ends)
            begin = np.flatnonzero(first)
            lead = at[begin][block - 1]
            can = (at - lead < least) | (np.append(False, block[1:] == block[:-1]) & np.append(False, (at - lead < least)[:-1]))
            out = [(at[c := np.flatnonzero(can[a:b]) + a].tolist(), at[ends[c]].tolist()) for a, b in zip(begin, np.append(begin[1:], len(at)), strict=True)]
            yield pdf.iloc[begin][both].reset_index(drop=True).assign(at=[o[0] for o in out], ends=[o[1] for o in out])

    per = _dealt(rows, both, [t, order]).mapInPandas(summed, f"{_types(rows, both)}, at array<double>, ends array<double>")

    def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole(batches, [key]):
            out, last = [], 0.0
            for new, at, ends in zip(starts(pdf, [key]), pdf["at"], pdf["ends"], strict=True):
                out.append(np.nan if new else last)
                i = 0 if new else int(np.argmax(at - last >= least)) if (at - last >= least).any() else len(at)
                last = ends[i] if i < len(at) else last
            yield pdf[both].assign(last=out)

    before = _dealt(per, [key], ["_block"]).mapInPandas(followed, f"{_types(rows, both)}, last double").where("last IS NOT NULL AND NOT isnan(last)")

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole(batches, both):
            lead = pdf["last"].notna().to_numpy()
            first = starts(pdf, both)
            last = np.where(lead, pdf["last"], np.nan)[np.flatnonzero(first)][np.cumsum(first) - 1][~lead]
            pdf = pdf[~lead].reset_index(drop=True)
            at, block = pdf[t].to_numpy(), np.cumsum(starts(pdf, both))
            free = np.flatnonzero(np.isnan(last) | (at - last >= least))
            kept = np.zeros(len(at) + 1, bool)
            kept[free[np.unique(block[free], return_index=True)[1]]] = True
            to = np.append(_next(at, block, least), len(at))
            while (to[:-1] < len(at)).any():
                kept[to[kept]] = True
                to = to[to]
            yield pdf[kept[:-1]][[key, order, t]]

    return _after(rows, before, "last").repartition(*both).sortWithinPartitions(*both, F.col("last").isNull(), t, order).mapInPandas(marked, _types(rows, [key, order, t]))
