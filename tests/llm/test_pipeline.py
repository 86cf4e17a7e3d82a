"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SPACE, brute_hits, shingles
from wavefix.llm import quality

DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_plain_versions_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        docs.write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "exact_dedup":
            best: dict[str, tuple] = {}
            for d, t in before.items():
                best[SPACE.sub("", t)] = min(best.get(SPACE.sub("", t), (1, 0)), (-len(t), d))
            assert kept == {d for _, d in best.values()}
        if name == "near_dedup":
            names, sets = list(before), [shingles(t) for t in before.values()]
            root = {d: d for d in names}
            for i_, a in enumerate(names):
                for j_ in range(i_):
                    if sets[i_] and 100 * len(sets[i_] & sets[j_]) >= 75 * len(sets[i_] | sets[j_]):
                        x, y = root[a], root[names[j_]]
                        root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
            assert kept == {d for d in names if root[d] == d}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            texts = list(before.values())
            hits = brute_hits([*texts[:1], None, *texts[1:]], items)
            clean = {d for n, d in enumerate(before) if not hits[n if n == 0 else n + 1][3]}
            assert kept == clean
        assert kept <= before.keys() and kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == kept


def test_quality_stage_rejects_by_score(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    score = quality.scorer(quality.trained(docs, spark.read.parquet(f"{DATA}/labels.parquet")))
    want = {r["doc_id"] for r in docs.where(score(F.col("text")) >= 0.3).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, DATA).collect()} == want


def test_run_over_odd_rows_and_no_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeats, ties and columns with names that the operators use."""
    fields = "doc_id long, text string, lang string, key string, spans string, n_hit string, score string, sequence_id string"
    long = prose(7, 20_000)
    texts = [None, "", " ", prose(1), prose(1), prose(1) + " x", long, long + " y", prose(2), None]
    rows = [(None if i in (3, 9) else i, t, None, *"abcde") for i, t in enumerate(texts)]
    for n, some in enumerate((rows + rows, [])):
        at = str(tmp_path / str(n))
        spark.createDataFrame(some, fields).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([("a", prose(2)), ("b", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, at).collect()
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces[0].asDict() if pieces else {"doc_id", "start", "length", "sequence_id", "offset"})
        if not some:
            assert pieces == []
        else:
            # One empty text, one of the near copies of each of two texts; the contaminated text is gone.
            assert len({r["doc_id"] for r in pieces}) == 3 and 8 not in {r["doc_id"] for r in pieces}


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_rows_are_dropped_by_id_and_text(spark):
    a, b, c, d = (prose(i) for i in range(4))
    rows = [(1, a), (None, a), (None, b), (2, c), (2, d), (3, c + " "), (None, b), (2, d), (4, None), (None, "")]
    docs = spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.exact_copies_removed(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in out.collect()))
    assert got == sorted([(1, a), (0, b), (2, d), (3, c + " "), (4, "")])
    near = [(1, a), (None, a + " more"), (None, b), (None, b + " more"), (2, c), (2, d), (5, d + " more"), (None, prose(9)), (6, c + " more")]
    docs = spark.createDataFrame([(i, x, "en") for i, x in near], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_copies_removed(spark, docs, DATA)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert {(1, a), (2, c), (2, d), (None, prose(9))} <= set(got) and len(got) == 5
    assert sum(x in (b, b + " more") for _, x in got) == 1
