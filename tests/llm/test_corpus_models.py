"""Whitening, piece encoding and collocations against plain versions, and on odd rows and tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wavefix.llm import collocations, piece_encoding, whitening
from wavefix.llm.common import bounded_batches
from wavefix.llm.tokens import vocabulary

CLASH = ("key", "x", "digest", "weight", "times", "chunk", "n", "dims", "phrase", "ids", "part")


def clashing(df):
    return df.withColumns({c: F.lit("z") for c in CLASH})


# Whitening


def vectors(n=120, d=6, seed=2):
    rng = np.random.default_rng(seed)
    rows = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * [1, 2, 3, 1, 1, 5][:d]).round(3)
    return [*rows.tolist(), *[rows[0].tolist()] * 40, *[rows[1].tolist()] * 3]


def plain_whitening(rows, weight):
    """Means, covariance and whitened components with NumPy alone; exact sums with Python's integers."""
    x = np.floor(256 * np.array(rows)).astype(np.int64)
    u, count = np.unique(x, axis=0, return_counts=True)
    w = np.ones(len(u), np.int64) if weight == "one" else count
    n, s = int(w.sum()), [sum(int(a) * int(b) for a, b in zip(w, u[:, j], strict=True)) for j in range(u.shape[1])]
    y = u - np.array(s) / n
    v = (y * w[:, None]).T @ y / n
    e, m = np.linalg.eigh(v)
    e, m = e[::-1][:4], m[:, ::-1][:, :4]
    deviation = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, (x - np.array(s) / n) @ m / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("weight", ["one", "count"])
def test_whitening_equals_plain_version(spark, weight):
    rows = vectors()
    df = clashing(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(5))
    got = {r["vec_id"]: r for r in whitening.whitened(spark, df, weight=weight).collect()}
    n, deviation, white, explained = plain_whitening(rows, weight)
    assert got.keys() == set(range(len(rows)))
    sign = np.sign(np.array(got[5]["whitened"]) * white[5])
    for i, r in got.items():
        assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert np.allclose(np.array(r["whitened"]) * sign, white[i], atol=1e-8) and np.allclose(r["explained"], explained, rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = vectors(30, 3)
    rows = [*enumerate(good), (100, None), (101, [1.0, None, 2.0]), (102, [1.0, nan, 2.0]), (103, [1.0, -inf, 2.0]), (104, []), (None, good[0]), (3, good[3]), (105, [0.5, 1.5]), (106, [-0.5, 0.25])]
    out = whitening.whitened(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert Counter(r["vec_id"] for r in out if r["dims"] == 3) == Counter([*range(len(good)), None, 3])
    two = [r for r in out if r["dims"] == 2]  # two distinct vectors of another length: one component
    assert {r["vec_id"] for r in two} == {105, 106} and all(len(r["whitened"]) == 1 and abs(abs(r["whitened"][0]) - 1) < 1e-12 for r in two)
    assert not any(r["vec_id"] in (100, 101, 102, 103, 104) for r in out)
    one = whitening.whitened(spark, spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert [list(r["whitened"]) for r in one] == [[], [], []]  # no variance, no components
    assert whitening.whitened(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_exact_sums_of_large_entries(spark):
    big = [[2.0**40, 3.0], [-(2.0**40) + 1, 5.0], [7.0, 2.0**44]]
    out = {r["vec_id"]: r for r in whitening.whitened(spark, spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>")).collect()}
    n, deviation, _, _ = plain_whitening(big, "one")
    assert all(r["deviation"] == (deviation[i] if deviation[i] < 1 << 63 else None) for i, r in out.items())


# Piece encoding


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def odd_texts():
    rng = random.Random(4)
    alphabet = "abcdefghijklmnoprstuv  éñ\n.-=/▁日0123́"
    some = ["", " ", "   ", "\n\t", "a\x00b", "▁▁x ▁", "ééÀ ﬁ 日本語テキスト", "𝒳🙂🙂a", "a" * 50, "-" * 1000, " " * 300, "</s> <s> <unk> <0x41>", "x" * 20_000, "word " * 5_000]
    return some + ["".join(rng.choices(alphabet, k=rng.randrange(1, 80))) for _ in range(500)] + ["".join(rng.choices("ab -", k=rng.randrange(1, 60))) for _ in range(500)]


def test_encoding_equals_the_library(spark, library):
    texts = [None, *odd_texts(), "again", "again"]
    rows = [(None if i == 7 else min(i, 900), t) for i, t in enumerate(texts)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    path = vocabulary("piece_bpe_32k.model")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or ""), library.eos_id()]
        want[i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))] += 1
    assert Counter(map(tuple, piece_encoding.digests(df, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want
    back = piece_encoding.decoded(piece_encoding.encoded(df, path), path).collect()
    assert Counter((r["doc_id"], len(r["ids"]), digest(" ".join(map(str, r["ids"]))), digest(r["text"])) for r in back) == want
    assert piece_encoding.digests(df.limit(0), path).count() == 0


def test_every_piece_and_pairs_of_pieces(library):
    use = piece_encoding.PrefixEncoder(vocabulary("piece_bpe_32k.model"))
    pieces, rng = sorted(use.id), random.Random(6)
    some = pieces[::7] + ["".join(rng.choices(pieces, k=rng.randrange(2, 6))) for _ in range(4000)]
    assert all(use.ids(t).tolist() == library.encode(t) for t in some)


def test_full_memories_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_encoding, "PARTS", 3)
    monkeypatch.setattr(piece_encoding, "PAIRS", 5)
    use = piece_encoding.PrefixEncoder(vocabulary("piece_bpe_32k.model"))
    assert all(use.ids(t).tolist() == library.encode(t) for t in odd_texts())
    assert len(use.parts) <= 3 and len(use.fits) <= 5


# Collocations


def plain_counts(docs):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, n


def plain_collocations(docs, least, most):
    f, n = plain_counts(docs)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cand.items():
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        inside = any(x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= 80 * a for (x, v), b in cand.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    seen, rows = Counter(), set()
    for lang, s, a, p, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= most:
            rows.add((lang, seen[lang], p.decode(), -a, l, r, n[lang], -s))
    return rows


def talk(seed=1, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "new", "york", "New", "ß\x1c", "日本"]
    common = ["in new york city today", "w1 w2 w3 w4 w5 w6 w7 w8", "one two three four five six"]
    docs = [(None, "en"), ("", None), (" \t\n.,", "en"), ("one", None), ("A  a\tA", "fr"), ("x " * 5000, "fr")]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            parts += rng.choice([[rng.choice(common)], rng.choices(words, k=rng.randrange(1, 40))])
            parts += rng.choice([[], [rng.choice([". ", ",", "\n", "!?", "\x0b"])]])
        docs.append((" ".join(parts), rng.choice(["en", "en", "fr", None])))
    return docs + docs[20:60] * 3


@pytest.mark.parametrize("period", [1, 3, 16, 10**9])
def test_counts_whatever_the_chunks(spark, period):
    docs = talk()
    df = clashing(spark.createDataFrame(docs, "text string, lang string").withColumn("doc_id", F.lit(1)).repartition(3))
    dictionary = collocations.parsed(df, period)
    f, n = plain_counts(docs)
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in collocations.counted(spark, dictionary, 5).collect()}
    assert got == {k: v for k, v in f.items() if v >= 5}
    assert {r["lang"]: r["n"] for r in collocations.totals(dictionary).collect()} == {k: v for k, v in n.items() if v}


def test_collocations_equal_plain_version(spark):
    docs = talk(3)
    got = {tuple(r) for r in collocations.collocations(spark, spark.createDataFrame(docs, "text string, lang string"), 5, 40).collect()}
    assert got == plain_collocations(docs, 5, 40) and len(got) > 60


def test_many_blocks_and_batches(spark, monkeypatch):
    docs = talk(7, 60)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(2)
    monkeypatch.setattr(collocations, "BATCH", 300)
    monkeypatch.setattr(collocations, "BLOCK", 2000)
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in collocations.counted(spark, collocations.parsed(df, 4), 6).collect()}
    assert got == {k: v for k, v in plain_counts(docs)[0].items() if v >= 6}


def test_arithmetic_beyond_64_bits(spark):
    a = 6_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, a + 1), ("en", "b", 1, a + 7)], "lang string, phrase string, words int, f long")
    (r,) = collocations.scored(counts).collect()
    assert r["score"] == 2000000 * a // (2 * a + 8)
    inside = spark.createDataFrame([("en", "a b", 2, a), ("en", "a b c", 3, a * 8 // 10), ("en", "x y", 2, a), ("en", "x y z", 3, a * 8 // 10 - 1)], "lang string, phrase string, words int, a long")
    assert {x["phrase"] for x in collocations.independent(inside).collect()} == {"a b c", "x y", "x y z"}


def test_no_documents(spark):
    assert collocations.collocations(spark, spark.createDataFrame([], "text string, lang string")).count() == 0


def test_collocations_blocks_are_met_one_by_one(spark, monkeypatch, tmp_path):
    """Blocks of the dictionary are read a few at a time, and a block sends one frame to any number of shards."""
    monkeypatch.setattr(collocations, "BLOCK", 1 << 20)
    texts = [(" ".join(f"w{i * 7919 % 50021}x{j}" for j in range(400)), "en") for i in range(2500)]
    cut = collocations.blocks(collocations.parsed(spark.createDataFrame(texts, "text string, lang string")).coalesce(1))
    cut.write.options(**{**collocations.PAGES, "parquet.block.size": str(1 << 20)}).parquet(str(tmp_path / "cut"))
    (file,) = (tmp_path / "cut").glob("*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_rows >= 5 and groups.num_row_groups >= 2

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    with bounded_batches(spark, 1 << 20):
        assert {r["n"] for r in spark.read.parquet(str(tmp_path / "cut")).mapInPandas(sizes, "n long").collect()} <= {1, 2}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    row = pq.read_table(file).slice(0, 1).to_pylist()[0]
    sent = collocations._submissions(collocations.Block(row), row["block"], 600, 1, 2)
    assert sorted(sent["target"]) == list(sent["target"]) and sent["target"].nunique() == len(sent) > 500 and set(sent["block"]) == {row["block"]}


def test_collocations_slices_of_a_batch_count_together(spark, monkeypatch):
    docs = [("a b c d e f g h. " * 20, "en"), (None, "en"), ("a b c " * 50, None), ("x", "de")] * 3
    df = spark.createDataFrame(docs, "text string, lang string").coalesce(1)
    want = sorted(map(tuple, collocations.parsed(df, 2).collect()))
    monkeypatch.setattr(collocations, "SLICE", 40)
    assert sorted(map(tuple, collocations.parsed(df, 2).collect())) == want and want
