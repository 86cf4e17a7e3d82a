"""Line deduplication against brute force, secret scanning on planted findings."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from wavefix.llm import line_dedup, secret_scan


def page(lines):
    return "<html><script>var x='<p>';</script>" + "".join(f"<p>{x}</p>" for x in lines) + "<!-- c --></html>"


def brute(pages):
    def host(u):
        m = re.match(r"[a-z][a-z0-9+.-]*://([^/:?#]+)", (u or "").lower())
        return m[1] if m else ""

    def lines(h):
        t = re.sub(r"<[^>]*>", "\n", re.sub(line_dedup.NOT_TEXT, "\n", h or ""))
        return [x for x in (y.strip(" \t") for y in re.split(r"[\n\r]+", t)) if x]

    rows = [(i, host(u), lines(h)) for i, u, h in pages]
    out = {}
    for i, s, own in rows:
        site = [set(x) for _, t, x in rows if t == s]
        out[i] = [x for x in own if not (sum(x in y for y in site) - 1 > 0.3 * (len(site) - 1))]
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    pages = []
    for i in range(120):
        own = [f"unique {i} {k}" for k in range(rng.randrange(5))] + rng.choices(["menu", "  footer\t", "ad & co", "rare"], weights=[6, 5, 2, 1], k=4)
        pages.append((i, f"https://{rng.choice(['A.example', 'b.example', 'hot.example', 'hot.example'])}:80/x?y={i}", page(own)))
    pages += [(200, None, page(["menu"])), (201, "not a url", None), (202, "https://b.example", ""), (203, "https://solo.example", page(["menu", "menu"]))]
    pages += [(i, f"https://{h}.example/{i}", page(["same", f"own {i}"])) for h, of in (("two", (301, 302)), ("eleven", range(310, 321))) for i in of]
    pages += [(330, "https://b.example", page([f"long {k % 5000}" for k in range(20_000)]))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("z"), "line": F.lit(1), "total": F.lit(2)})
    got = {r["page_id"]: list(r["kept"]) for r in line_dedup.line_dedup(spark, df).collect()}
    assert got == brute(pages)
    assert got[203] == ["menu", "menu"] and got[301] == ["own 301"] and got[310] == ["own 310"]
    assert line_dedup.line_dedup(spark, df.where("false")).count() == 0
    twice = line_dedup.line_dedup(spark, df.where("page_id = 203").union(df.where("page_id = 203"))).collect()
    assert [list(r["kept"]) for r in twice] == [[], []]  # a repeated row is a page of its own


def texts():
    rng = random.Random(8)
    out = []
    for i in range(80):
        words = rng.choices(["lorem", "ipsum", "internationalisation", "incomprehensibilities", "dolor", "sit"], k=30)
        if i % 4 == 0:
            words[10:10] = ["token", "=", '"' + "".join(rng.choices("0123456789abcdef", k=40)) + '"']
        if i % 4 == 1:
            words[10:10] = ["commit", "".join(rng.choices("0123456789abcdef", k=40))]
        out.append((i, " ".join(words), f"src{i % 3}"))
    return out


def test_secret_scan_learns_the_labels(spark):
    docs = spark.createDataFrame([*texts(), (100, None, None), (101, "", "x")], "doc_id long, text string, source string").withColumn("score", F.lit(1))
    found = secret_scan.findings(docs).cache()
    assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} <= set(range(80))
    rows = secret_scan.scored(found, secret_scan.labelled(found.where("doc_id % 5 <> 0"))).collect()
    assert len(rows) == found.count()
    for r in rows:
        assert r["secret"] == r["word"].startswith('"'), r
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs, secret_scan.scored(found, secret_scan.labelled(found))).collect()}
    assert all('"<secret>"' in clean[i] for i in range(0, 80, 4)) and clean[100] is None and clean[1] == texts()[1][1]


def test_secret_scan_without_labels(spark):
    docs = spark.createDataFrame(texts()[:6], "doc_id long, text string, source string")
    found = secret_scan.findings(docs)
    none = spark.createDataFrame([], "doc_id long, at int, secret boolean")
    assert {r["score"] for r in secret_scan.scored(found, none).collect()} == {0.0}
    assert secret_scan.scored(found.where("false"), none).count() == 0


def test_secret_labels_look_at_the_value(spark):
    key = "0f" * 20
    secret = [f'token = "{key}"###', f'TOKEN = "{key}"!!', f'{{"token":"{key}"}}', f'{{"token": "{key}"}},', f"API_KEY={key}", f'auth_token="{key}";', f"curl https://x.example/a?token={key}", f"password: {key}"]
    clean = [f"commit {key}", f'id = "{key}"', "an internationalisation of"]
    unknown = ["token = internationalisation", f"the token {key} is", "auth = getTokenFromRequestHeader(x)"]
    rows = [(i, x, "a") for i, x in enumerate([*secret, *clean, *unknown])]
    found = secret_scan.findings(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r["doc_id"]: r["secret"] for r in secret_scan.labelled(found).collect()}
    assert [got[i] for i in range(len(rows))] == [True] * len(secret) + [False] * len(clean) + [None] * len(unknown)


def test_secret_scan_keeps_secrets_with_noise_after_the_quote(spark):
    noisy = [(i, x.replace('" ', '"### ' if i % 8 else '"!! '), s) for i, x, s in texts()]
    found = secret_scan.findings(spark.createDataFrame(noisy, "doc_id long, text string, source string")).cache()
    for r in secret_scan.scored(found, secret_scan.labelled(found.where("doc_id % 5 <> 0"))).collect():
        assert r["secret"] == r["word"].startswith('"'), r


def test_every_candidate_of_a_word_is_scored_and_redacted(spark):
    rng = random.Random(4)
    new = lambda: "".join(rng.choices("0123456789abcdef", k=32))
    docs, want = [], {}
    for i in range(60, 90):
        a, b, c = new(), new(), new()
        docs.append((i, f'{{"token":"{a}","secret":"{b}","commit_of_repository":"{c}"}}', "src"))
        want[i] = [a, b, "commit_of_repository", c]
    docs.append((90, 'token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"', "src"))
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = secret_scan.findings(df).cache()
    got = {}
    for r in found.orderBy("doc_id", "at", "n").collect():
        got.setdefault(r["doc_id"], []).append(r["candidate"])
    assert {i: got[i] for i in want} == want and len(got[90]) == 3
    labels = secret_scan.labelled(found)
    assert [r["secret"] for r in labels.where("doc_id = 90").collect()] == [True] * 3
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(df, secret_scan.scored(found, labels)).collect()}
    assert all(clean[i] == f'{{"token":"<secret>","secret":"<secret>","commit_of_repository":"{w[3]}"}}' for i, w in want.items())
    assert clean[90] == 'token = "<secret>.<secret>.<secret>"'


def test_dictionary_has_all_frequent_words(spark):
    words = ["".join(x) for x in zip("abcdefghij" * 200, *(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=2000) for k in range(7)), strict=True)]
    docs = spark.createDataFrame([(" ".join(words),), (", ".join(words) + " once",), (None,)], "text string")
    assert {r["run"] for r in secret_scan.dictionary(docs).collect()} == set(words)


def test_findings_against_plain_python(spark):
    rng = random.Random(11)
    parts = ["a" * 20, "0123456789abcdef" * 2, "x", ".", '"', ":", "(", "é", "Az09+/_=-" * 2, "{", ",", "short"]
    texts = [None, "", " \n", *(" ".join("".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(150)), "k=" + "b" * 100_000]
    texts = [t if i % 3 else t and t.replace(" ", "\n\t") for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None if i % 5 == 0 else f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumns({"n": F.lit(1), "word": F.lit(2)})
    want = set()
    for i, t in enumerate(texts):
        words = re.split(r"[\x20\x09-\x0D]+", t or "")
        for at, w in enumerate(words):
            near = [words[at + d] if 0 <= at + d < len(words) else "" for d in (-2, -1, 1)]
            for n, m in enumerate(re.finditer(r"[A-Za-z0-9+/_=-]{16,}", w)):
                want.add((i, "" if i % 5 == 0 else f"s{i % 2}", at, n, m[0], w[: m.start()], w[m.end() :], *near))
    rows = secret_scan.findings(df).select("doc_id", "path", "at", "n", "candidate", "lead", "tail", "name", "before", "after").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want


def plain_features(r, known):
    """The features of one finding, by plain Python."""
    c, classes = r["candidate"], {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "sign": "[+/_=-]"}
    per = lambda p: len(re.findall(p, c)) / len(c)
    out = {"length": len(c), "digits": per("[0-9]"), "upper": per("[A-Z]"), "hex": per("[0-9a-fA-F]"), "vowels": per("[aeiouAEIOU]"), "repeats": len(re.findall(r"(.)\1", c)) / len(c)}
    out |= {"dictionary": sum(len(x) for x in re.findall("[a-z]{4,}", c.lower()) if x in known) / len(c), "path_length": len(r["path"]), "path_example": float(bool(re.search("test|example|sample|doc|mock", r["path"].lower())))}
    out |= {f"{a}_{b}": per(f"{classes[a]}(?={classes[b]})") for a in classes for b in classes}
    for w in ("name", "before", "tail", "after"):
        n = min(len(r[w]), 64)
        out |= {f"{w}_length": n, f"{w}_letters": len(re.findall("[A-Za-z]", r[w][-64:])) / max(n, 1)}
    return out


def test_features_against_plain_python(spark):
    rng = random.Random(5)
    parts = ["internationalisation", "Az09+/_=-", "0123456789abcdef", "zzTOKEN", '":', "é", "aaaa1111", "x" * 70]
    rows = [(i, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(8)), rng.choice([None, "", "docs/a", "Test", "src"])) for i in range(60)]
    found = secret_scan.findings(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    known = {"internationalisation", "abcdef", "token"}
    got = secret_scan.described(found, spark.createDataFrame([(x,) for x in known], "run string")).collect()
    assert len(got) == found.count() > 100
    for r in got:
        want = plain_features(r, known)
        assert {f"f_{k}" for k in want} == set(secret_scan.FEATURES)
        assert all(abs(r[f"f_{k}"] - v) < 1e-12 for k, v in want.items()), r


def test_labels_are_drawn_alike_from_any_layout(spark):
    rows = [(i, i % 7, i % 3 == 0) for i in range(3000)] + [(5, 5, True), (5, 5, False), (9, 2, None)]
    labels = spark.createDataFrame(rows, "doc_id long, at int, secret boolean")
    draw = lambda df, n: sorted(tuple(r) for r in secret_scan.drawn(df, ["doc_id", "at"], n).collect())
    some = draw(labels, 300)
    assert len(some) == 300 and some == draw(labels.repartition(17, "at"), 300)
    everything = draw(labels, 5000)
    assert len(everything) == 3000 and (5, 5, True) in everything and set(some) <= set(everything)
    assert draw(labels.where("false"), 5) == []


def test_repeated_rows_repeat_their_findings(spark):
    docs = spark.createDataFrame(texts()[:8], "doc_id long, text string, source string")
    once, twice = (secret_scan.scored(f, secret_scan.labelled(f)).groupBy("doc_id", "at", "n", "secret").count().collect() for f in (secret_scan.findings(docs), secret_scan.findings(docs.union(docs))))
    assert {(*r[:4], 2 * r["count"]) for r in once} == {tuple(r) for r in twice}
