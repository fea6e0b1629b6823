"""Mixing sources to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document posteriors over domains, so a document
belongs to several domains in part.  Rates r (how often a document is wanted, 0 or more) are fitted by
projected gradient from r = 1, so that the expected domain token totals, sums of r * tokens * posterior, come as
near to the targets as they can in least squares.  A step moves every rate against the gradient, by the sum over
domains of posterior times the domain's residual as a share of its tokens still wanted, so a rare domain
moves as fast as a large one, and projects it to 0 or more.  The step's length is the spectral one, from the
last step's change of the totals.  A step is one aggregate over the posteriors table; no rate is stored, for a row's rate is
the fold of the steps so far over its posterior.  Steps go on until every total is within ``FLAT`` of its present
total from the target, ``IDLE`` passes bring nothing, or ``STEPS`` passes are made; the best step's rates count.  Targets that the posteriors
do not allow (a domain unwanted though all rows hold a part of it) are missed, with a warning that names the
misses.  All of it is DataFrame functions and Spark's JVM logistic regression.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash, written

#: Hash space of the words, and labelled rows fitted per domain.
WORDS, SAMPLE = 1 << 15, 4000
#: A total's greatest miss, and the miss that counts as none, both as shares of a domain's present total.
TOLERANCE, FLAT = 0.05, 0.05
#: Passes over the posteriors at most, those without a gain of a twentieth after which the fit ends, and the shortest and
#: longest step.
STEPS, IDLE, SHORT, LONG = 32, 8, 0.5, 16.0
#: Cuts that may part the rows taken from the others.
CUTS = tuple(i / 10 for i in range(1, 11))
#: L1 penalty: few words tell domains apart.
PENALTY = 0.003


def tokens(text: str = "text") -> Column:
    """Lower-cased letter runs; null and wordless texts give an empty array."""
    words = F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}]+")
    return F.filter(words, lambda w: w != "")


def _features(rows: DataFrame) -> DataFrame:
    """Word presence, each document's vector; the words themselves are dropped."""
    hashed = HashingTF(inputCol="words", outputCol="features", numFeatures=WORDS, binary=True)
    return hashed.transform(rows.withColumn("words", tokens()))


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE):
    """(model, domains) from ``labelled`` (doc_id, domain); at most ``sample`` rows of a domain are fitted.

    An id with labels of several domains teaches nothing.  Rows of equal id and text count once, and the bound is on rows,
    so an id with very many texts fills no more than the sample; those with the least hash of id and text are taken.
    Without a labelled text the model is None and there is one domain, the empty name; with a single
    domain the model is None as well.
    """
    named = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.col("domain").cast("string")).alias("domain"), F.max(F.col("domain").cast("string")).alias("_other")
    ).where("domain = _other").drop("_other")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))
    here = texts.select("doc_id", "mark").distinct().join(named, "doc_id")
    # bounded by the sample and the number of domains
    chosen = F.broadcast(sample_by_hash(here, "domain", ["doc_id", "mark"], sample))
    fitted = texts.join(chosen, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    rows = written(_features(fitted).select("doc_id", "domain", "features"), "labelled")
    domains = [r.domain for r in rows.select("domain").distinct().orderBy("domain").collect()]
    if len(domains) < 2:
        return None, domains or [""]
    index = F.element_at(F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(float(i)))]), F.col("domain"))
    fit = rows.withColumn("label", index).repartition(4)
    return LogisticRegression(maxIter=40, regParam=PENALTY, elasticNetParam=1.0, labelCol="label").fit(fit), domains


def posteriors(docs: DataFrame, model, domains: list[str], whole: bool = False) -> DataFrame:
    """``doc_id, tokens, posterior`` (an array in the order of ``domains``) of every row.

    With ``whole`` the row itself comes along as ``row``, so that none of its names can clash.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    if model is None:
        posterior = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(len(domains))])
        scored = rows.withColumn("words", tokens())
    else:
        posterior = vector_to_array("probability")
        scored = model.transform(_features(rows))
    out = ["doc_id", F.size("words").cast("long").alias("tokens"), posterior.alias("posterior")]
    return scored.select(*out, *(["row"] if whole else []))


def rate(posterior: Column, steps: list[list[float]]) -> Column:
    """A document's rate: from 1 each step takes off its domains' parts, never below 0."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.array(*map(F.lit, map(float, step))) for step in steps])
    def pulled(r, move):
        parts = sum((posterior[i] * move[i] for i in range(len(steps[0]))), F.lit(0.0))
        return F.greatest(F.lit(0.0), r - parts)

    return F.aggregate(moves, F.lit(1.0), pulled)


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float]) -> list[list[float]]:
    """The steps that bring expected token totals to ``targets`` (tokens per domain).

    A domain without a target keeps its expected total at rate 1.  Warns if a total misses its target by more than
    ``TOLERANCE``.
    """
    size = len(domains)

    def at(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals, and those of the rows still wanted at rate 1."""
        # the rate is a column of its own, computed once a row and not once a sum
        rated = table.select("tokens", "posterior", F.explode(F.array(rate(F.col("posterior"), steps))).alias("y"))
        p = [F.col("posterior")[i] for i in range(size)]
        sums = [F.sum(F.col("tokens") * F.col("y") * p[i]) for i in range(size)]
        sums += [F.sum(F.when(F.col("y") > 0, F.col("tokens")).otherwise(F.lit(0)) * p[i]) for i in range(size)]
        got = [float(v or 0.0) for v in rated.agg(*[v.alias(f"s{n}") for n, v in enumerate(sums)]).first()]
        return np.array(got[:size]), np.array(got[size:])

    steps: list[list[float]] = []
    totals, wanted = at(steps)
    aim = np.array([float(targets.get(d, n)) for d, n in zip(domains, totals, strict=True)])
    # a domain that holds nothing cannot be moved
    scale = np.where(totals > 0, totals, max(1.0, totals.sum()))
    best, taken, length, last, mark, idle = np.inf, 0, 1.0, None, np.inf, 0
    for _ in range(STEPS):
        residual = totals - aim
        missed = np.abs(residual / scale)
        if missed.max(initial=0) < best:
            best, taken, misses = missed.max(initial=0), len(steps), missed
        mark, idle = (best, 0) if best <= 0.95 * mark else (mark, idle + 1)
        if best <= FLAT or idle >= IDLE:
            break
        if last is not None:
            move, before, weight = last
            curve = move @ (before - residual)
            length = float(np.clip((move * weight) @ move / curve, SHORT, LONG)) if curve > 0 else 1.0
        weight = np.maximum(wanted, 1e-3 * scale)
        move = length * residual / weight
        if not np.abs(move).max() > 0:
            break
        last = (move, residual, weight)
        steps.append(move.tolist())
        totals, wanted = at(steps)
    if best > TOLERANCE:
        names = ", ".join(f"{d!r} by {v:.3f}" for d, v in zip(domains, misses, strict=True) if v > TOLERANCE)
        warnings.warn(f"targets missed, as shares of the present totals: {names}", stacklevel=2)
    return steps[:taken]


def _fitted(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], whole: bool = False):
    """(domains, posteriors table, present totals, steps) for targets of ``weights`` times the present totals."""
    model, domains = train(docs, labelled)
    table = written(posteriors(docs, model, domains, whole), "posteriors")
    sums = [F.sum(F.col("tokens") * F.col("posterior")[i]) for i in range(len(domains))]
    now = np.array([float(v or 0.0) for v in table.agg(*sums).first()])
    targets = {d: n * weights.get(d, 1.0) for d, n in zip(domains, now, strict=True)}
    return domains, table, now, fit_rates(table, domains, targets)


def _cut(table: DataFrame, now: np.ndarray, aim: np.ndarray, steps: list[list[float]]) -> tuple[list[list[float]], float, np.ndarray]:
    """The steps made and the rate from which on rows are taken, so that the domains' totals come nearest to their targets.

    Rates that meet the totals in parts need not meet them in whole rows: late steps raise some rates far above 1 to make up for
    others, so the rates after fewer steps are tried too.  Returns the totals as well.
    """
    size = len(now)
    made = sorted({min(k, len(steps)) for k in (1, 2, 4, 8, 16, len(steps))})
    rates = F.array(*[rate(F.col("posterior"), steps[:k]) for k in made])
    tenths = F.floor(F.least(F.col("y"), F.lit(1.0)) * len(CUTS) + 1e-9).cast("int")
    rated = table.select("tokens", "posterior", F.posexplode(rates).alias("k", "y")).groupBy("k", tenths.alias("b"))
    got = np.zeros((len(made), len(CUTS) + 1, size))
    for r in rated.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(size)]).collect():
        got[r.k, r.b] = [r[f"s{i}"] or 0.0 for i in range(size)]
    # totals of the rows from each cut on
    got = got[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    far = (((got - aim) / np.where(now > 0, now, 1.0)) ** 2).sum(axis=2)
    k = int(far.min(axis=1).argmin())
    # the middle one of equally good cuts
    good = np.flatnonzero(far[k] <= far[k].min() + 1e-9)
    best = int(good[len(good) // 2])
    return steps[: made[k]], CUTS[best], got[k, best]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``doc_id, tokens, posterior, domain, rate`` for every row of ``docs`` (doc_id, text, ...).

    ``weights`` gives each domain's wanted share of the token total it now holds: 1 keeps its expected
    total, 0 asks for none of it.  Null and empty texts have 0 tokens and the posteriors of an empty
    text.  Repeated rows are documents of their own.  Other columns are ignored.
    """
    domains, table, _, steps = _fitted(docs, labelled, weights)
    names = F.array(*map(F.lit, domains))
    best = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return table.select("doc_id", "tokens", "posterior", best.alias("domain"), rate(F.col("posterior"), steps).alias("rate"))


def take(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` with the highest rates, once each, with their columns as they are.

    A row is wholly in or out and none is repeated, so no draw drops a clean text or lets an unwanted one pass; the cut is
    the one for which what is taken comes nearest to the targets.  ``totals`` tells how near.
    """
    # texts are scored once: the steps read the numbers of the stored table, the last pass its rows
    domains, table, now, steps = _fitted(docs, labelled, weights, whole=True)
    steps, cut, _ = _cut(table, now, now * [weights.get(d, 1.0) for d in domains], steps)
    return table.where(rate(F.col("posterior"), steps) >= cut - 1e-9).select("row.*")


def totals(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``domain, present, target, fitted, taken``: expected tokens now, wanted, at the fitted rates and in the rows of ``take``."""
    domains, table, now, steps = _fitted(docs, labelled, weights)
    aim = now * [weights.get(d, 1.0) for d in domains]
    rated = table.select("tokens", "posterior", rate(F.col("posterior"), steps).alias("y"))
    fitted = rated.agg(*[F.sum(F.col("tokens") * F.col("y") * F.col("posterior")[i]) for i in range(len(domains))]).first()
    got = _cut(table, now, aim, steps)[2]
    rows = [(d, *map(float, (n, a, f or 0.0, g))) for d, n, a, f, g in zip(domains, now, aim, fitted, got, strict=True)]
    return docs.sparkSession.createDataFrame(rows, "domain string, present double, target double, fitted double, taken double")


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domains of the labels table: toxic, else by quality; null where either is missing."""
    return F.when(toxic == 1, "toxic").when((toxic == 0) & (quality == 1), "good").when((toxic == 0) & (quality == 0), "poor")
