"""Secret scanning: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``SHORTEST`` characters of base 64, hexadecimal or
identifiers inside a word. The forest sees its length, the table of its characters' transitions between
classes, how much of it a dictionary covers (the corpus's words of at least a millionth of all),
the document's path (its source), and the shape of the words around it and of what its own word holds beside it. It is trained on labelled findings, of which at most ``LABELLED`` (those
of least hash) are used, with classes weighted alike; every candidate is scored.

DataFrame functions and Spark's own forest only; no row meets Python.

The tables hold no labelled findings, so the query labels them itself. A value that is assigned to a
credential's name, with or without blanks, is a secret if it is in quotes (whatever follows them) or mixes
letters and digits; a candidate far from such names or in the place of a name is none; any other has no label. What the rule looks at (names,
assignments, quotes) is no feature, so the forest has to find secrets by other signs. The operator takes any labels.

Defined results: a null or empty text has no candidates; a word with several gives them
all, numbered by ``n``; a finding labelled both ways counts as a secret; labels without ``n`` hold for all candidates of a word; without labels of both classes the score is the share of secrets among the labels
(0 without any); rows that repeat a document repeat its findings; an empty table gives
no rows; a null path counts as empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefix.llm.common import saved

SHORTEST = 16
LABELLED = 20_000
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
#: A letter run is in the dictionary if it is so often a word of the corpus, and such a share of all its words.
SEEN, SHARE = 2, 1e-6

#: Fixed patterns: a candidate, names of credentials, signs of assignment, paths of examples.
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
NAME = r"(?i)(token|secret|password|passwd|pwd|api_?key|access_?key|auth|credential)"
#: What stands before a value that is assigned to a credential's name, or to any; a candidate that holds both itself.
OWNED = NAME + r"[A-Za-z0-9_.-]*[\"'`\])]*\x20?[:=]+>?\x20?[\"'`]*$"
OTHER = r"[A-Za-z0-9_.-][\"'`\])]*\x20?[:=]+>?\x20?[\"'`]*$"
INLINE = r"^[A-Za-z0-9+/_-]*?" + NAME + r"[A-Za-z0-9_-]*=+(?=[^=])"
#: Characters kept on each side of a candidate inside its word.
AROUND = 256
#: Characters of a neighbouring word that its shape counts.
LONGEST = 64
EXAMPLE = r"(?i)(test|example|sample|doc|mock)"


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, path, at, n, word, candidate, lead, tail, before, name, after): one row for each candidate in ``docs`` (doc_id, text, source).

    ``n`` counts the candidates of a word; ``lead`` and ``tail`` are what it holds before and after this one
    (four candidates and ``AROUND`` characters at most), ``word`` is all three.
    """
    words = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+").alias("w"))
    w = F.col("w")
    long = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(w[i]) >= SHORTEST) & w[i].rlike(CANDIDATE))
    near = lambda i, d: F.coalesce(F.get(w, i + d), F.lit(""))
    out = words.select("doc_id", "path", F.explode(F.transform(long, lambda i: F.struct(i.alias("at"), w[i].alias("w"), near(i, -1).alias("before"), near(i, -2).alias("name"), near(i, 1).alias("after")))).alias("s"))
    out = out.select("doc_id", "path", "s.at", F.regexp_extract_all("s.w", F.lit(CANDIDATE), 0).alias("c"), F.split("s.w", CANDIDATE, -1).alias("g"), "s.before", "s.name", "s.after")

    # The gaps and candidates around a candidate, so that a long word isn't copied for each of its candidates.
    c, g = F.col("c"), F.col("g")
    mixed = lambda i: F.concat(F.coalesce(F.get(g, i), F.lit("")), F.coalesce(F.get(c, i), F.lit("")))
    lead = lambda i: F.right(F.concat(*(mixed(i - d) for d in (4, 3, 2, 1)), g[i]), F.lit(AROUND))
    tail = lambda i: F.left(F.concat(*(mixed(i + d) for d in (1, 2, 3, 4))), F.lit(AROUND))
    each = F.transform("c", lambda x, i: F.struct(x.alias("candidate"), lead(i).alias("lead"), tail(i).alias("tail")))
    out = out.select("doc_id", "path", "at", F.posexplode(each).alias("n", "s"), "before", "name", "after")
    return out.select("doc_id", "path", "at", "n", F.concat("s.lead", "s.candidate", "s.tail").alias("word"), "s.candidate", "s.lead", "s.tail", "before", "name", "after")


def _context() -> Column:
    """What stands before a value: two words and its own word's start, without earlier parts of a dotted value."""
    return F.concat_ws(" ", "name", "before", F.regexp_replace("lead", r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]+\.)+$", ""))


def _key() -> Column:
    """The context's last part, which a separator begins: the name that a value belongs to, if any."""
    return F.trim(F.regexp_extract(_context(), "[^,;&?{}]*$", 0))


def _quoted() -> Column:
    return F.col("lead").rlike("[\"'`][A-Za-z0-9+/_.-]*$") & F.col("tail").rlike("^[A-Za-z0-9+/_=.-]*[\"'`]")


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), 0)


def dictionary(docs: DataFrame) -> DataFrame:
    """(run): the letter runs (of four letters or more) that are words of ``docs`` (text) at least ``SEEN`` times and in a share of ``SHARE``.

    A word is a run that nothing but blanks or punctuation stands around. At most 1 / ``SHARE`` runs can be that frequent.
    """
    plain = r"(?<![^\x20\x09-\x0D\"'(])[a-z]{4,}(?=[.,;:!?)\"']*(?:[\x20\x09-\x0D]|$))"
    counts = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(plain), 0)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    total = docs.select(F.sum(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(plain))).alias("total"))
    return counts.where(F.col("n") >= SEEN).crossJoin(F.broadcast(total)).where(F.col("n") >= SHARE * F.col("total")).select("run")


def covered(found: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, covered): the characters of runs in the dictionary ``known``, for candidates that have any."""
    runs = found.select("candidate").distinct().select("candidate", F.explode(_runs(F.col("candidate"))).alias("run"))
    return runs.join(known, "run").groupBy("candidate").agg(F.sum(F.length("run")).cast("double").alias("covered"))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """Add the features' columns; ``known`` (run) is the dictionary."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    size = lambda x: F.least(F.length(x), F.lit(LONGEST)).cast("double")
    features = {
        "f_length": n, "f_digits": _count(c, "[0-9]") / n, "f_upper": _count(c, "[A-Z]") / n, "f_hex": _count(c, "[0-9a-fA-F]") / n, "f_vowels": _count(c, "[aeiouAEIOU]") / n,
        "f_repeats": _count(c, "(.)\\1") / n, "f_dictionary": F.coalesce("covered", F.lit(0.0)) / n, "f_path_length": F.length("path").cast("double"), "f_path_example": F.col("path").rlike(EXAMPLE).cast("double"),
    }
    features |= {f"f_{a}_{b}": _count(c, f"{CLASSES[a]}(?={CLASSES[b]})") / n for a in CLASSES for b in CLASSES}
    for w in BESIDE:
        x = F.col(w)
        features |= {f"f_{w}_length": size(x), f"f_{w}_letters": _count(F.right(x, F.lit(LONGEST)), "[A-Za-z]") / F.greatest(size(x), F.lit(1.0))}
    return found.join(covered(found, known), "candidate", "left").select(*found.columns, *(v.alias(k) for k, v in features.items()))


#: Classes of characters, and the words whose shape counts.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "sign": "[+/_=-]"}
BESIDE = ("name", "before", "tail", "after")
FEATURES = [
    *(f"f_{x}" for x in ("length", "digits", "upper", "hex", "vowels", "repeats", "dictionary", "path_length", "path_example")),
    *(f"f_{a}_{b}" for a in CLASSES for b in CLASSES), *(f"f_{w}_{x}" for w in BESIDE for x in ("length", "letters")),
]


def labelled(found: DataFrame) -> DataFrame:
    """(doc_id, at, n, secret): the query's own labels of findings (see above); null where it can't tell."""
    c = F.col("candidate")
    owned = _key().rlike(OWNED) | c.rlike(INLINE)
    value = F.regexp_replace(c, INLINE, "")
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~F.col("tail").rlike(r"^[(\[]")
    near = c.rlike(NAME) | F.when(_key().rlike(OTHER), _key().rlike(NAME)).otherwise(_context().rlike(NAME))
    names = F.col("tail").rlike("^[\"'`][\\x20]?[:=]")  # the candidate is a key itself
    return found.select("doc_id", "at", "n", F.when(names, False).when(owned & (_quoted() | mixed), True).when(~near, False).alias("secret"))


def drawn(labels: DataFrame, key: list[str], bound: int) -> DataFrame:
    """(key, secret): at most ``bound`` labelled findings, those of least hash; a finding with labels of both kinds is a secret.

    Where there are more than twice as many, hashes beyond a threshold are left out first, so that a task sends few rows whatever the number of tasks.
    """
    own = labels.where("secret IS NOT NULL").groupBy(*key).agg(F.max("secret").alias("secret"))
    n, steps = own.count(), 1 << 40
    if n > 2 * bound:
        own = own.where(F.pmod(F.xxhash64(*key), F.lit(steps)) < int(steps * (bound + 8 * bound**0.5 + 64) / n))
    return own.orderBy(F.pmod(F.xxhash64(*key), F.lit(steps)), *key).limit(bound)


def scored(found: DataFrame, labels: DataFrame, bound: int = LABELLED, known: DataFrame | None = None) -> DataFrame:
    """Findings with score and secret; ``labels`` are (doc_id, at, n, secret); ``known`` is the dictionary, by default of the findings' own words."""
    rows = described(found, dictionary(found.select(F.col("candidate").alias("text"))) if known is None else known)
    key = [x for x in ("doc_id", "at", "n") if x in labels.columns]
    sample = drawn(labels, key, bound)
    counts = {r["secret"]: r["n"] for r in sample.groupBy("secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        out = rows.withColumn("score", F.lit(1.0 if True in counts else 0.0))
    else:
        weight = F.when(F.col("secret"), 0.5 / counts[True]).otherwise(0.5 / counts[False]) * sum(counts.values())
        vector = VectorAssembler(inputCols=FEATURES, outputCol="_x")
        train = vector.transform(rows.join(F.broadcast(sample), key).withColumn("_y", F.col("secret").cast("double")).withColumn("_weight", weight))
        forest = RandomForestClassifier(labelCol="_y", featuresCol="_x", weightCol="_weight", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(train)
        out = forest.transform(vector.transform(rows)).withColumn("score", vector_to_array("_p")[1])
    return out.withColumn("secret", F.col("score") >= THRESHOLD)


def redacted(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with every secret of ``rows`` replaced by a mark, longer ones first; documents without any are unchanged."""
    per = rows.where("secret").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set(F.struct((-F.length("candidate")).alias("n"), "candidate")).alias("_secrets"))
    out = docs.join(per, docs["doc_id"].eqNullSafe(per["_doc"]), "left")
    text = F.aggregate(F.coalesce(F.transform(F.array_sort("_secrets"), lambda s: s["candidate"]), F.array().cast("array<string>")), F.col("text"), lambda t, s: F.replace(t, s, F.lit("<secret>")))
    return out.withColumn("text", text).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = saved(spark, findings(docs), "findings")
    known = found.where(F.crc32(F.col("candidate").cast("binary")) % 5 != 0)  # by value: copies of a held-out one are held out too
    rows = scored(found, labelled(known), known=saved(spark, dictionary(docs), "dictionary"))
    return rows.select("doc_id", F.col("at").cast("long").alias("word_index"), F.col("n").cast("long").alias("candidate_index"), F.length("candidate").cast("long").alias("n_chars"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "score", "secret")
