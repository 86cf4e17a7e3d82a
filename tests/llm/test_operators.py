"""The text operators against brute force and on edge cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import zlib
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavefix.llm import decontamination, exact_dedup, near_dedup, packing, phrase_dedup, quality, suffix_dedup, token_output, tokens
from wavefix.llm.common import keyed, window_minima
from wavefix.llm.tokens import PieceEncoder, vocabulary

SPACE = re.compile("[\x20\x09-\x0d]+")
ODD = [None, "", " ", "\n\t ", "one", "A a A a", "É́ ΣΑΣ ﬁ ½ \x85\xa0x y", "a's  b\r\n\n  c'd"]


def documents(spark, texts, extra=True):
    """doc_id (one null), text, and columns whose names operators use inside."""
    rows = [(None if i == 1 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.withColumns({c: F.lit("z") for c in ("key", "target", "kind", "digest", "n_words", "spans", "score", "comp", "_hits")})
    return df


def corpus(seed=1, n=60):
    """Texts that share passages: whole copies, edited copies, common passages, repeats inside a text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "ß", "THE", "the"]
    make = lambda k: rng.choices(words, k=k)
    common = [make(70), make(55), make(30)]
    out: list[list[str]] = []
    for i in range(n):
        t = make(rng.choice([3, 20, 60, 150, 400]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at:at] = rng.choice(common)
        if i % 7 == 3 and out:
            t = list(rng.choice(out))
            for _ in range(rng.choice([0, 0, 1, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
        if i % 11 == 5:
            t = t[:40] * 4
        out.append(t)
    return [" ".join(t) if i % 2 else "\n".join([" ".join(t[:5]), " ".join(t[5:])]) for i, t in enumerate(out)]


TEXTS = [*ODD, *corpus(), "x " * 30_000]


def ids(n):
    return [None if i == 1 else i for i in range(n)]


def order(i):
    return (i is None, i or 0)


# --- op4 ----------------------------------------------------------------------------


def brute_exact(texts):
    rows = list(zip(ids(len(texts)), [t or "" for t in texts], strict=True))
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t), []).append((-len(t), order(i), i))
    out = {}
    for i, t in rows:
        g = groups[SPACE.sub("", t)]
        keep = min(g)[2]
        out[i] = (keep, len(g), i == keep)
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """A digest of one hexadecimal digit forces texts to collide; byte verification keeps them apart."""
    texts = [*TEXTS, *TEXTS[10:30], "A  b", "Ab"]
    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1).cast("binary")) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(spark, documents(spark, texts), digest).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == brute_exact(texts)


def test_index_levels_keep_the_least_and_answer_lookups(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(40)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    runs = exact_dedup.flushed(spark, docs)
    assert runs.agg(F.max("run")).first()[0] >= exact_dedup.FANOUT  # so that several levels are merged
    got = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.compacted(spark, runs).collect()}
    of = lambda t: hashlib.sha256(t.encode()).digest()
    want = {of(t): (min(i for i, u in rows if u == t), sum(u == t for _, u in rows)) for _, t in rows}
    assert got == want
    some = [of("x" * 3), of("xx"), of("absent")]
    assert sorted(r["id"] for r in exact_dedup.found(runs, some).collect()) == sorted(i for i, t in rows if len(t) in (2, 3))
    probe = spark.createDataFrame([(of(f"y{i}"),) for i in range(2000)] + [(x,) for x in want], "digest binary")
    bits = exact_dedup.filter_bits(len(want))
    passed = {bytes(r["digest"]) for r in exact_dedup.passing(probe, exact_dedup.filter_of(runs, bits), bits).collect()}
    assert want.keys() <= passed and len(passed) < len(want) + 20
    assert exact_dedup.passing(probe, exact_dedup.filter_of(runs.where("false"), bits), bits).count() == 0


def test_filter_grows_with_the_hits(spark):
    """At any number of hits few others pass; a filter that is too small lets more pass and loses none."""
    assert [exact_dedup.filter_bits(n) for n in (0, 2048, 2049, 1 << 40)] == [1 << 15, 1 << 15, 1 << 16, exact_dedup.MOST]
    own = spark.range(40_000).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"), "id")
    other = spark.range(40_000, 80_000).select(exact_dedup.sha256(F.col("id").cast("string")).alias("digest"), "id")
    shares = []
    for bits in (exact_dedup.filter_bits(40_000), exact_dedup.ROW):
        held = exact_dedup.filter_of(own, bits)
        assert held.count() <= bits // exact_dedup.ROW and exact_dedup.passing(own, held, bits).count() == 40_000
        shares.append(exact_dedup.passing(other, held, bits).count() / 40_000)
    assert shares[0] < 0.01 and shares[1] > 0.5


def test_exact_dedup_with_more_hits_than_filter_bits(spark):
    n = 40_000  # digests in two rows each, past the 32,768 bits of the least filter
    docs = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("t"), F.col("id") % n).alias("text"))
    rows = exact_dedup.exact_dedup(spark, docs, most=exact_dedup.ROW)
    assert rows.where("keep_id <> doc_id % 40000 OR group_size <> 2 OR kept <> (doc_id < 40000)").count() == 0 and rows.count() == 2 * n


# --- op3 ----------------------------------------------------------------------------


def brute_hits(texts, items):
    out = {}
    windows = [(i, tuple(w[k : k + min(13, len(w))])) for i, t in items for w in [decontamination.words_of(t)] if w for k in range(max(len(w) - 12, 1))]
    for d, t in zip(ids(len(texts)), texts, strict=True):
        w = decontamination.words_of(t)
        hit, names = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    names.add("" if i is None else str(i))
        out[d] = (len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("shard_words", [1 << 20, 20])
def test_decontamination(spark, shard_words):
    texts = TEXTS[:-1]
    items = [(1, " ".join(texts[20].split()[:30])), (2, "one"), (3, "W5 w6"), (None, " ".join(texts[25].split()[:13])), (10, ""), (11, None), (4, " ".join(texts[20].split()[5:25])), (2, "é THE")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    rows = decontamination.scored(spark, documents(spark, texts), bench, shard_words=shard_words)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows.collect()}
    assert got == brute_hits(texts, items)


def test_tasks_hold_one_shard_at_a_time(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=200)) for _ in range(30)]
    items = [(i, " ".join(rng.choice(texts).split()[at : at + 40])) for i, at in enumerate(range(0, 160, 8))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    before = set(Path(spark.conf.get("spark.checkpoint.dir")[7:]).glob("wavefix/decontamination-*"))
    rows = decontamination.scored(spark, documents(spark, texts), bench, shard_words=40)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows.collect()}
    assert got == brute_hits(texts, items) and any(x[1] for x in got.values())
    assert len(set(Path(spark.conf.get("spark.checkpoint.dir")[7:]).glob("wavefix/decontamination-*")) - before) == 1

    def alive(batches):
        import gc

        for _ in batches:
            yield pd.DataFrame({"n": [sum(type(x).__name__ == "ItemAutomaton" for x in gc.get_objects())]})

    assert max(r["n"] for r in spark.range(0, 64, 1, 16).mapInPandas(alive, "n long").collect()) <= 1


def test_automaton_of_items_that_share_windows():
    rng = random.Random(8)
    for window in (1, 2, 4):
        items = [(str(i), [b"%d" % rng.randrange(4) for _ in range(rng.randrange(9))]) for i in range(12)]
        automaton = decontamination.ItemAutomaton(items, window)
        for _ in range(200):
            doc = [b"%d" % rng.randrange(5) for _ in range(rng.randrange(20))]
            spans, names = set(), set()
            for name, w in items:
                n = min(window, len(w))
                for k in range(len(w) - n + 1 if n else 0):
                    at = [(i, i + n) for i in range(len(doc) - n + 1) if doc[i : i + n] == w[k : k + n]]
                    spans.update(at)
                    names.update([name] if at else [])
            got = automaton.match(doc)
            assert (set(got[0]), got[1]) == (spans, names)


def test_automaton_is_small():
    rng = random.Random(7)
    words = [b"w%d" % i for i in range(5000)]
    items = [(str(i), rng.choices(words, k=500)) for i in range(80)]
    assert len(pickle.dumps(decontamination.ItemAutomaton(items, 13), protocol=5)) < 60 * 40_000


def test_spans_are_cut_out(spark):
    words = [f"v{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "Start, " + "; ".join(words[5:25]) + " end."), (2, "v1 v2"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r["clean_text"] for r in decontamination.cleaned(decontamination.scored(spark, docs, bench)).collect()}
    assert got == {1: "Start,  end.", 2: "v1 v2", 3: None}


# --- op6 and op9 ----------------------------------------------------------------------


def brute_bytes(texts):
    seen, out = set(), {}
    data = sorted(zip(ids(len(texts)), [(t or "").encode() for t in texts], strict=True), key=lambda x: order(x[0]))
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            x = t[k : k + 100]
            if x in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(x)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.substring_dedup(spark, documents(spark, TEXTS)).collect()}
    assert got == brute_bytes(TEXTS)


def brute_words(texts):
    first: dict[tuple, int] = {}
    data = sorted(((order(i), i, (t or "").encode().split()) for i, t in zip(ids(len(texts)), texts, strict=True)), key=lambda x: x[0])
    for n, (_, _, w) in enumerate(data):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), n)
    out = {}
    for n, (_, i, w) in enumerate(data):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < n:
                gone.update(range(k, k + 50))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_phrase_dedup(spark):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], bytes(r["kept"])) for r in phrase_dedup.phrase_dedup(spark, documents(spark, TEXTS)).collect()}
    assert got == brute_words(TEXTS)


def test_phrases_are_removed_where_the_automata_find_them(spark):
    """Confirmed passages alone remove nothing, any number of phrases to an automaton finds the same, ids may be equal."""
    rng = random.Random(6)
    line = [[f"p{i}{k}" for k in range(60)] for i in range(7)]
    texts = [" ".join(sum(([*rng.choices("abc", k=5), *rng.choice(line)] for _ in range(3)), [])) for _ in range(30)]
    keys = list(range(30))
    passages = [(0, 5, " ".join(x[:55]).encode()) for x in line]
    owners, places, words = (list(x) for x in zip(*passages, strict=True))
    data = [t.encode() for t in texts]
    whole = phrase_dedup.occurrences(phrase_dedup.compiled(np.array(owners), np.array(places), words), keys, data)
    for most in (1, 3):
        parts = phrase_dedup.occurrences(phrase_dedup.compiled(np.array(owners), np.array(places), words, most), keys, data)
        assert [sorted(x) for x in parts] == [sorted(x) for x in whole]
    for key, text, spans in zip(keys, texts, whole, strict=True):
        w = text.split()
        assert sorted(spans) == [(i, i + 55) for i in range(len(w)) if w[i : i + 55] in [x[:55] for x in line] and key > 0]
    assert phrase_dedup.occurrences([], keys, data) == [[]] * 30


def test_phrase_dedup_tells_texts_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, f"{a} {b}"), (2, c), (None, f"{c} z"), (None, b), (None, f"{b} y")]
    got = phrase_dedup.phrase_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 9, bytes(r["kept"]).decode()) for r in got) == sorted([(1, a), (2, b), (2, c), (9, "z"), (9, ""), (9, "y")])


def test_window_minima_are_the_least_of_each_window():
    h = np.random.default_rng(3).integers(0, 1 << 63, 500).astype(np.uint64)
    for w in (1, 2, 3, 8, 61):
        assert [int(h[i : i + w].argmin()) + i for i in range(500 - w + 1)] == window_minima(h, w).tolist()


def test_blind_trie_finds_the_longest_agreement():
    rng = random.Random(5)
    trie, seen = suffix_dedup.BlindTrie(), []
    for _ in range(300):
        right, left = bytes(rng.choices(b"ab", k=rng.randrange(3, 9))), bytes(rng.choices(b"ab", k=rng.randrange(6)))
        found = trie.add(right, left)
        for far in range(9):
            want = max((suffix_dedup.common(left, x) for r, x in seen if suffix_dedup.common(right, r) >= far), default=-1)
            assert max((b for a, b in found if a >= far), default=-1) == want
        seen.append((right, left))


def test_shallow_order_sorts_and_marks():
    x = np.random.default_rng(1).integers(0, 3, (400, 4)).astype(np.uint64)
    got, new = suffix_dedup.shallow_order(x)
    assert x[got].tolist() == sorted(x.tolist())
    assert new.tolist() == [i == 0 or x[got][i].tolist() != x[got][i - 1].tolist() for i in range(400)]


# --- op10 ---------------------------------------------------------------------------


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_near(texts):
    names, sets = ids(len(texts)), [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: order(names[k]))
                root[b] = a
    return {names[i]: (len(sets[i]), names[find(i)]) for i in range(len(texts))}


def near(spark, texts):
    rows = near_dedup.near_groups(spark, keyed(documents(spark, texts))).collect()
    null = lambda k: None if k == (1 << 63) - 1 else k
    return {null(r["key"]): (r["n_shingles"], null(r["comp"])) for r in rows}


def test_near_dedup(spark):
    base = [f"b{i}" for i in range(120)]
    rng, group = random.Random(2), []
    for _ in range(40):  # copies of one text whose mutual similarity lies around the threshold
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        group.append(" ".join(t))
    texts = [*TEXTS, *group, *group[:3]]
    assert near(spark, texts) == brute_near(texts)


def test_components_of_a_chain_take_few_passes(spark, monkeypatch):
    made, scratch = [], near_dedup.scratch

    @contextmanager
    def counted(*args):
        with scratch(*args) as keep:
            yield lambda df: made.append(1) or keep(df)

    monkeypatch.setattr(near_dedup, "scratch", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")
    assert {r["key"]: r["comp"] for r in near_dedup.components(spark, links).collect()} == {i: 0 for i in range(1, 1001)}
    assert len(made) <= 16  # ten doublings
    rng = random.Random(4)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    root = list(range(900))
    for _ in range(900):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    got = {r["key"]: r["comp"] for r in near_dedup.components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: x for i, x in enumerate(root) if i != x}


def test_a_unit_returns_a_forest(spark):
    rng, base = random.Random(3), [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(100)] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    sets = near_dedup.shingle_sets([t.encode() for t in texts])
    unit = pd.DataFrame({"key": range(90), "comp": range(90), "x": True, "y": True, "sig": [x.tobytes() for x in near_dedup.signatures(sets)], "text": texts})
    links = near_dedup._compared(unit, near_dedup.fewest_matches())
    root = list(range(90))
    for a, b in links.itertuples(index=False):
        x, y = root[a], root[b]
        assert x != y
        root = [x if r == y else r for r in root]
    want = brute_near(["", "", *texts])
    assert len(set(root)) == len({want[i + 2][1] for i in range(90)})


@pytest.mark.parametrize("block", [512, 8])
def test_blocks_compare_only_pairs_of_a_bucket(spark, monkeypatch, block):
    rng = random.Random(9)
    passages = [" ".join(f"p{i}q{rng.randrange(10**6)}" for _ in range(40)) for i in range(120)]
    texts = ["", ""] + [" ".join(rng.sample(passages, 2)) for _ in range(600)]
    core = [f"k{i}" for i in range(200)]  # pairs of a hub's far members
    for _ in range(60):
        t = list(core)
        for _ in range(rng.randrange(3, 8)):
            t[rng.randrange(200)] = f"m{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    made, was = [], near_dedup.crossed

    def counted(spark, docs, units, *rest):
        sizes = {(r["bucket"], r["block"]): r["n"] for r in docs.groupBy("bucket", "block").agg(F.countDistinct("key").alias("n")).collect()}
        for u in units.collect():
            n, m = sizes[u["bucket"], u["block_x"]], sizes[u["bucket"], u["block_y"]]
            made.append(n * (n - 1) // 2 if u["block_x"] == u["block_y"] else n * m)
        return was(spark, docs, units, *rest)

    monkeypatch.setattr(near_dedup, "crossed", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    assert near(spark, texts) == brute_near(texts)
    keys = near_dedup.band_keys(near_dedup.signatures(near_dedup.shingle_sets([t.encode() for t in sorted(set(texts[2:]))])))
    shared = sum(n * (n - 1) // 2 for n in np.unique(keys, return_counts=True)[1].tolist())
    assert 0 < sum(made) < shared


def test_a_pair_is_answered_for_by_its_first_bucket():
    rng, base = random.Random(5), [f"b{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(f"z{rng.random()}" for _ in range(50))]
    sigs = near_dedup.signatures(near_dedup.shingle_sets([t.encode() for t in texts]))
    keys = near_dedup.band_keys(sigs)
    shared = np.flatnonzero(keys[0] == keys[1])
    assert len(shared) > 1
    for b in shared.tolist():
        rows = pd.DataFrame({"unit": 1, "bucket": keys.view(np.int64)[0, b], "x": True, "y": True, "key": range(3), "comp": range(3), "sig": [x.tobytes() for x in sigs]})
        got = near_dedup._likely(rows, near_dedup.fewest_matches())
        assert sorted(got["key"]) == ([0, 1] if b == shared[0] else [])
        assert near_dedup._likely(rows.assign(comp=0), near_dedup.fewest_matches()).empty


def test_near_dedup_links_every_text_of_an_id(spark):
    rng = random.Random(12)
    a, b = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} more"), (3, f"{b} more"), (4, "else where is a text of other words")]
    got = near_dedup.near_groups(spark, keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {(r["key"], r["comp"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_pruning_never_drops_what_it_must_keep():
    least = near_dedup.fewest_matches()
    assert all(m <= 0.75 * n for n, m in least.items()) and least[160] > 80


# --- op1 and op7 ----------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = PieceEncoder(vocabulary(name))
        for t in [*[t for t in TEXTS[:40] if t], "<|endoftext|> a <|startoftext|>", "ÀÉ İ ǅ ̈́ K 한국 ½²"]:
            assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def odd_texts(n=300, seed=5):
    """Texts of marks, cases, blanks, combining and long words, in which words recur."""
    rng = random.Random(seed)
    bits = ["A", "it", "It's", "'s", "don't,", "x'S", "..'re", "J\u030c", "E\u0301,", "e\u0301", "É", "ΣΑΣ,", "12", "3,4", "a1!b", "\x00", "\x7f", "w" * 23, "w" * 24, "w" * 25, "W" * 60 + "!", "한국,", "I\u0307", "İ!", "_", "(K)"]
    return ["".join(rng.choice([*bits, " ", " ", "\n", "  ", " \n", "\t\t"]) for _ in range(rng.randrange(1, 80))) for _ in range(n)]


def test_encoder_of_many_texts_equals_the_tokenizer(monkeypatch):
    """Together, with and without what is remembered, and when no more is."""
    texts = [*odd_texts(), "", " ", "\n\n", "a\u2003b", "<|endoftext|>!", *[t or "" for t in TEXTS[:30]]]
    for most in (1 << 20, 40):
        monkeypatch.setattr(tokens, "WORDS", most)
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            e = PieceEncoder(vocabulary(name))
            e.words.new.most = 30
            want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            for _ in range(3):
                assert [x.tolist() for x in e.all_ids(texts)] == want
                assert [x.tolist() for t in texts for x in e.all_ids([t])] == want
            assert len(e.words.h) >= 30


def test_words_are_encoded_once_whatever_their_marks_and_case():
    for name, text, want in (
        ("word_bpe_49k.json", "alpha beta, ALPHA; Beta. Alpha! (beta", [b"!", b"(beta", b",", b".", b";", b"alpha", b"beta"]),
        ("byte_bpe_50k.json", " alpha beta, alpha; beta. alpha!\nbeta", [b"\nbeta", b" alpha", b" beta", b"!", b",", b".", b";"]),
    ):
        e, asked = PieceEncoder(vocabulary(name)), []
        e.words.new.make = lambda word, asked=asked, e=e: asked.append(word) or e.encode(word)
        for _ in range(2):
            assert [x.tolist() for x in e.all_ids([text, text])] == [e.tokenizer.encode(text, add_special_tokens=False).ids] * 2
        assert sorted(asked) == want


def test_encoder_remembers_little():
    """A worker's memory of a million words and the newest takes under 100 bytes each; long words are never kept."""
    e = PieceEncoder(vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    for _ in range(12):
        words = ["".join(map(chr, 97 + rng.integers(0, 26, 9))) for _ in range(20_000)]
        list(e.all_ids([" ".join(words), " ".join(w * 5 for w in words[:2000])]))
    held = [e.words.h, *e.words.keys, e.words.begin, e.words.count, e.words.flat]
    assert len(e.words.h) > 150_000 and sum(x.nbytes for x in held) < 100 * len(e.words.h)
    assert max(e.words.keys[0]) <= tokens.LONGEST and all(len(x) <= tokens.LONGEST for x in e.words.new)
    assert len(e.words.new) <= e.words.new.most <= max(1 << 14, len(e.words.h) // 8)


def test_packing(spark):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.packed(spark, documents(spark, TEXTS), path).collect()
    e = PieceEncoder(path)
    want = {i: [*e.ids(t or "").tolist(), 1] for i, t in zip(ids(len(TEXTS)), TEXTS, strict=True)}
    by_doc: dict = {}
    by_seq: dict = {}
    for r in rows:
        part = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, whole in ((by_doc, {k: len(v) for k, v in want.items()}), (by_seq, None)):
        for k, v in parts.items():
            at = 0
            for a, n in sorted(v):
                assert a == at
                at += n
            assert at == whole[k] if whole else at <= 2048
    assert by_doc.keys() == want.keys()


def test_histogram_packing_is_complete_and_tight():
    rng = random.Random(4)
    counts = {rng.randrange(1, 2048): rng.randrange(1, 50) for _ in range(600)}
    patterns = packing.pack_histogram(counts, 2048)
    got: dict[int, int] = {}
    for lengths, n in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            got[x] = got.get(x, 0) + n
    assert got == counts
    assert sum(k * n for k, n in counts.items()) > 0.97 * 2048 * sum(n for _, n in patterns)
    assert len(patterns) <= 2 * len(counts)


def test_token_files(spark):
    path = vocabulary("word_bpe_49k.json")
    shards = token_output.written(spark, documents(spark, TEXTS), path, shard_tokens=500)
    got = {r["doc_id"]: r[1:] for r in token_output.read(shards).select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
    e, at = PieceEncoder(path), 0
    for i, t in sorted(zip(ids(len(TEXTS)), TEXTS, strict=True), key=lambda x: order(x[0])):
        x = np.append(e.ids(t or ""), 1).astype("<u4")
        assert tuple(got[i]) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    ends = token_output.token_counts(shards, token_output.END).agg(F.sum("n")).first()[0]
    assert ends >= len(TEXTS) and shards.count() > 3


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(6)
    for n, top in ((0, 5), (1, 5), (1000, 7), (1500, 49408)):
        v = rng.integers(0, top, n)
        m = token_output.WaveletMatrix.build(v, 16)
        m = token_output.from_file(token_output.to_file(np.arange(2), np.array([1, 2]), m))[2]
        assert m.values().tolist() == v.tolist()
        assert [m.access(i) for i in range(0, n, 37)] == v[::37].tolist()
        for c in set(v[:5].tolist()) | {3}:
            assert m.occurrences(c) == np.flatnonzero(v == c).tolist()
            assert m.rank(c, n // 2) == int((v[: n // 2] == c).sum()) and m.count(c) == int((v == c).sum())


# --- op2 ----------------------------------------------------------------------------


def test_quality_learns_from_positives_and_unlabelled_text(spark):
    data = "/root/testdata/sf0.01"
    rows = quality.query(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 40 and (rows["predicted"] == rows["quality"]).mean() > 0.93
    assert rows["score"].between(0, 1).all()


def test_quality_without_labels(spark):
    docs = documents(spark, TEXTS[:9])
    model = quality.trained(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = docs.select(quality.scorer(model)(F.col("text")).alias("s")).collect()
    assert [r["s"] for r in got] == [0.5] * 9


def test_whole_risk_covers_every_document_not_held_out(spark):
    docs = documents(spark, [*TEXTS[:40], *TEXTS[8:12]])
    x = quality.features([(t or "").encode() for t in TEXTS[8:30]])
    model = quality.fit(x, np.arange(len(x)) < 9, 0.5, np.zeros(quality.WIDTH + 2))
    own = [r["text"] or "" for r in docs.collect() if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    z = (quality.features([t.encode() for t in own]) - model[1, :-1]) / model[2, :-1]
    at = z @ model[0, :-1] + model[0, -1]
    slope = 1 / (1 + np.exp(-at))
    want = np.concatenate(([np.log1p(np.exp(at)).sum()], slope @ z, [slope.sum(), len(own)]))
    assert np.allclose(quality.whole_risk(docs, model), want, rtol=1e-3, atol=1e-2)


def test_small_unlabelled_sample_is_led_by_all_documents(spark, monkeypatch):
    """Held-out accuracy with an unlabelled sample of a tenth of the documents."""
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    monkeypatch.setattr(quality, "UNLABELLED", 80)
    model = quality.trained(docs, labels)
    got = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h"), quality.scorer(model)(F.col("text")).alias("s")).join(labels, "doc_id").where("h").toPandas()
    assert ((got["s"] >= quality.THRESHOLD) == got["quality"]).mean() > 0.93


def test_quality_of_odd_tables(spark):
    """Null and repeated ids and labels, labels without a document, empty and repeated texts, clashing columns, no rows."""
    docs = documents(spark, TEXTS[:40])
    docs = docs.union(docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (4, None), (None, 1), (10**9, 1)], "doc_id long, quality int")
    got = docs.select("doc_id", quality.scorer(quality.trained(docs, labels))(F.col("text")).alias("s")).collect()
    assert len(got) == 80 and all(0 <= r["s"] <= 1 for r in got) and len({(r["doc_id"], r["s"]) for r in got}) == 40
    none = docs.where("false")
    assert none.select(quality.scorer(quality.trained(none, labels))(F.col("text")).alias("s")).count() == 0
    only = spark.createDataFrame([(10**9 + 1, 1)], "doc_id long, quality int")
    assert {r["s"] for r in docs.select(quality.scorer(quality.trained(docs, only))(F.col("text")).alias("s")).collect()} == {0.5}


def test_score_does_not_depend_on_neighbours():
    x = [t.encode() for t in TEXTS[8:30]]
    whole = quality.features(x)
    for i, t in enumerate(x):
        assert np.allclose(quality.features([t])[0], whole[i])


# --- all ----------------------------------------------------------------------------


def test_empty_table(spark):
    docs = documents(spark, TEXTS[:3]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(spark, docs).count() == 0
    assert decontamination.scored(spark, docs, bench).count() == 0
    assert suffix_dedup.substring_dedup(spark, docs).count() == 0
    assert phrase_dedup.phrase_dedup(spark, docs).count() == 0
    assert near_dedup.near_groups(spark, keyed(docs)).count() == 0
    assert packing.packed(spark, docs, vocabulary("byte_bpe_50k.json")).count() == 0
    assert token_output.read(token_output.written(spark, docs, vocabulary("word_bpe_49k.json"))).count() == 0


def test_repeated_rows(spark):
    """Rows that repeat an id and its text get one result each, and the same."""
    docs = documents(spark, TEXTS[:30])
    twice = docs.union(docs)
    once = {r["doc_id"]: r["kept"] for r in suffix_dedup.substring_dedup(spark, docs).collect()}
    got = suffix_dedup.substring_dedup(spark, twice).collect()
    assert len(got) == 60 and all(once[r["doc_id"]] == r["kept"] for r in got)
    got = phrase_dedup.phrase_dedup(spark, twice).collect()
    once = {r["doc_id"]: r["kept"] for r in phrase_dedup.phrase_dedup(spark, docs).collect()}
    assert len(got) == 60 and all(once[r["doc_id"]] == r["kept"] for r in got)
    assert len({(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_dedup(spark, twice).collect()}) == 30
    hits = lambda d: sorted(map(str, decontamination.scored(spark, d, spark.createDataFrame([("a", "w1 w2"), ("b", "the")], "item_id string, text string")).select("doc_id", "n_words", "n_hit").collect()))
    assert hits(twice) == sorted(2 * hits(docs))
