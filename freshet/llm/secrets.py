"""Secret scans with a random forest that removes false positives.

Candidates are found by one pattern: values after a credential word, keys of known providers, private
key blocks and long unbroken strings.  The forest sees a candidate's length, its character classes
and the transitions between them, how much of it the corpus's own dictionary covers, the
neighbouring words and the path.  All of it is DataFrame functions and Spark's JVM forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sample_by_hash, written

#: Words before a credential, formats of public providers, words near harmless strings.
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
PROVIDERS = (
    "AKIA[0-9A-Z]{16}", "ASIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36}", "xox[abprs]-[A-Za-z0-9-]{10,}",
    "AIza[0-9A-Za-z_-]{35}", "sk_live_[0-9a-zA-Z]{16,}", "glpat-[0-9A-Za-z_-]{20}",
)
HARMLESS = "example|sample|test|dummy|placeholder|commit|sha1|sha256|md5|checksum|digest|uuid|isbn"
_ASSIGN = rf"(?i:(?:{NAMES})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)"
_KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = rf"(?:{_KEY_BLOCK}|{_ASSIGN}[^\s\"',;]{{6,}}|{'|'.join(PROVIDERS)}|[A-Za-z0-9+/_-]{{16,}}={{0,2}})"
#: Share of the distinct texts, and their least number, that hold a word of the corpus's dictionary.
DICTIONARY, LEAST = 0.001, 2
#: Labelled findings that the forest is fitted on, per label.
SAMPLE = 2000
FEATURES = (
    "size", "digits", "uppers", "lowers", "others", "changes", "distinct", "covered", "assigned", "provider",
    "named_before", "harmless_near", "harmless_path", "path_depth", "block",
)
MASK = "[SECRET]"


def _near(piece: Column, last: bool) -> Column:
    part = F.when(F.length(piece) > 40, F.right(piece, F.lit(40)) if last else F.left(piece, F.lit(40))).otherwise(piece)
    return F.lower(part)


def findings(docs: DataFrame) -> DataFrame:
    """One row per candidate: ``key, doc_id, path, nth, start, length, before, value, after``.

    ``start`` (code points, from 0) and ``length`` span the value without the credential word before it.
    ``key`` stands for (doc_id, text): rows that repeat both are scanned once.
    """
    rows = docs.select(
        F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), "text").alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.lower(F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("path"),
    )
    found = rows.withColumn("hits", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    found = found.where(F.size("hits") > 0).withColumn("gaps", F.split("text", CANDIDATE, -1))
    # hits and the gaps around them, in turn, make up the text
    sizes = F.transform("hits", lambda h, i: F.length(F.element_at("gaps", i + 1)) + F.length(h))
    found = found.withColumn("sizes", sizes)
    row = F.transform(
        "hits",
        lambda h, i: F.struct(
            i.alias("nth"), h.alias("hit"), F.element_at("sizes", i + 1).alias("span"),
            _near(F.element_at("gaps", i + 1), True).alias("before"), _near(F.element_at("gaps", i + 2), False).alias("after"),
        ),
    )
    out = found.select("key", "doc_id", "path", F.explode(row).alias("c")).select("key", "doc_id", "path", "c.*")
    out = out.dropDuplicates(["key", "nth"])
    upto = Window.partitionBy("key").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("span").over(upto)
    value = F.regexp_replace("hit", rf"^{_ASSIGN}(?=[^\s\"',;]{{6,}})", "")
    out = out.withColumns({"end": end, "value": value})
    return out.select(
        "key", "doc_id", "path", "nth", (F.col("end") - F.length("value")).cast("long").alias("start"),
        F.length("value").cast("long").alias("length"), "before", "value", "after",
        F.col("hit").rlike(rf"^{_ASSIGN}[^\s\"',;]{{6,}}").alias("assigned"),
    )


def dictionary(docs: DataFrame) -> DataFrame:
    """Words of three letters or more that a share ``DICTIONARY`` of the distinct texts hold outside candidates.

    Every text counts; exact copies count as one text and a word once in it.
    """
    # n copies of a text weigh 1 / n each: no text has to move to make them one
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    texts = texts.select("text", F.xxhash64("text").alias("digest"), F.octet_length("text").alias("bytes"))
    copies = written(texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n")), "copies")
    bar = max(float(LEAST), DICTIONARY * copies.count())
    plain = F.lower(F.regexp_replace("text", CANDIDATE, " "))
    words = F.array_distinct(F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    rows = texts.join(copies.where("n > 1"), ["digest", "bytes"], "left").select(
        (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("weight"), F.explode(words).alias("word")
    )
    # sums of n parts of 1 / n, in any order, are whole up to rounding
    return rows.groupBy("word").agg(F.sum("weight").alias("held")).where(F.col("held") >= bar - 1e-6).select("word")


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """Add the columns ``FEATURES``."""
    value = F.col("value")
    share = lambda p: F.regexp_count(value, F.lit(p)) / F.greatest(F.length(value), F.lit(1))
    kinds = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[0-9]", "\u0001"), r"\p{Lu}", "\u0002"), r"\p{L}", "\u0003"),
        "[^\u0001\u0002\u0003]", "\u0004",
    )
    changes = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1
    out = found.withColumns(
        {
            "size": F.least(F.length(value), F.lit(200)).cast("double"),
            "digits": share("[0-9]"), "uppers": share(r"\p{Lu}"), "lowers": share(r"\p{Ll}"),
            "others": share(r"[^\p{L}0-9]"), "changes": changes / F.greatest(F.length(value), F.lit(1)),
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
            "provider": value.rlike(f"^(?:{'|'.join(PROVIDERS)})$").cast("double"),
            "named_before": F.col("before").rlike(f"(?:{NAMES})[^a-z0-9]{{0,8}}$").cast("double"),
            "harmless_near": (F.col("before").rlike(HARMLESS) | F.col("after").rlike(HARMLESS)).cast("double"),
            "harmless_path": F.col("path").rlike(HARMLESS).cast("double"),
            "path_depth": F.size(F.split("path", "[/.]")).cast("double"),
            "block": value.startswith("-----BEGIN").cast("double"),
            "assigned": F.col("assigned").cast("double"),
        }
    )
    parts = F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    own = out.select("key", "nth", F.explode(parts).alias("word"))
    hits = own.join(known, "word").groupBy("key", "nth").agg(F.sum(F.length("word")).alias("letters"))
    out = out.join(hits, ["key", "nth"], "left")
    covered = F.least(F.coalesce("letters", F.lit(0)) / F.greatest(F.length(value), F.lit(1)), F.lit(1.0))
    return out.withColumn("covered", covered).drop("letters")


def format_labels(found: DataFrame) -> Column:
    """Labels where no reviewed findings are given: 1 for a provider's format, a key block or a mixed
    value after a credential word; 0 for plain words, numbers and dictionary words; else null."""
    mixed = (F.col("digits") > 0) & (F.col("lowers") + F.col("uppers") > 0)
    sure = (F.col("provider") > 0) | (F.col("block") > 0) | ((F.col("assigned") > 0) & mixed & (F.col("harmless_near") == 0))
    plain = (F.col("digits") == 0) | (F.col("lowers") + F.col("uppers") == 0) | (F.col("covered") >= 0.5)
    return F.when(sure, 1.0).when(plain & (F.col("assigned") == 0), 0.0)


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """Fit on ``FEATURES`` and ``label``; at most ``SAMPLE`` findings of a label, the least by hash.

    None without both labels: then every candidate of a sure format counts (see ``classify``).
    """
    rows = sample_by_hash(labelled.where("label is not null"), "label", ["key", "nth"], SAMPLE)
    rows = written(rows.select("label", *FEATURES), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=20, maxDepth=5, seed=5, subsamplingRate=0.8
    )
    return forest.fit(vector.transform(rows))


def classify(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` and ``is_secret``; without a model a provider's format, a block or an assigned value."""
    if model is None:
        score = F.greatest("provider", "block", "assigned")
        return found.withColumn("score", score).withColumn("is_secret", score >= threshold)
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(found))
    return scored.withColumn("score", vector_to_array("probability")[1]).withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``key, doc_id, nth, start, length, value, score, is_secret`` of every candidate in ``docs``.

    ``docs`` has doc_id, text and, as path, source; null or empty texts hold no candidate.  ``labelled``
    holds reviewed findings (``key, nth, label``); without it labels come from ``format_labels``.
    """
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(None).cast("string"))
    # the pattern is dear: it runs over the texts once
    found = written(findings(docs), "candidates")
    found = written(featured(found, dictionary(docs)), "features")
    reviewed = found.withColumn("label", format_labels(found)) if labelled is None else found.join(
        labelled.select("key", "nth", F.col("label").cast("double").alias("label")), ["key", "nth"]
    )
    scored = classify(found, train(reviewed))
    return scored.select("key", "doc_id", "nth", "start", "length", "value", "score", "is_secret")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret's value replaced by ``MASK``; all rows and columns stay.

    ``n_chars``, where present, becomes the new length of a changed text.
    """
    found = written(scan(docs).where("is_secret"), "secrets")
    spans = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    # the row as a whole: no column of its own can clash with the names used here
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), F.col("text").cast("string")).alias("key"),
    )
    joined = keyed.join(spans, "key", "left").withColumn("ends", F.transform("spans", lambda s: s["start"] + s["length"]))
    # the text between secrets, each part followed by the mask
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("ends", i))
    kept = F.transform(
        "spans", lambda s, i: F.concat(F.substring("text", (begin(i) + 1).cast("int"), (s["start"] - begin(i)).cast("int")), F.lit(MASK))
    )
    tail = F.substring("text", (F.element_at("ends", -1) + 1).cast("int"), F.length("text"))
    new = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(kept, ""), tail))
    joined = joined.withColumn("new", new)
    out = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == "text":
            value = F.coalesce("new", value)
        elif c == "n_chars":
            value = F.coalesce(F.length("new").cast(docs.schema[c].dataType), value)
        out.append(value.alias(c))
    return joined.select(*out)
