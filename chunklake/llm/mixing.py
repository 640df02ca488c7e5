"""Mixing to target weights with soft membership, with DataFrame functions only.

A naive Bayes classifier, fitted on a bounded sample of labelled documents, gives every document a posterior over domains:
each distinct word is drawn from the domain's telling words or from all others together, and marks of the text's shape are
drawn beside them. Document rates r >= least then minimise the sum over domains of (sum_d r_d t_d p_dk - T_k)^2 / S_k, t being
tokens, p posteriors, T targets and S the tokens at rate 1, and among equals the rates nearest to 1, by projected
gradient steps. Projection is lazy: a document's rate is its starting rate less its posteriors times the sum of all steps so
far, cut at its least and most, so that a few numbers hold the state of all rates. A step is the residual preconditioned by
the Gram sums of the rows that are not cut, and takes one distributed aggregate of some K * K numbers; where the objective
doesn't fall enough, one more aggregate tries shorter and damped steps, down to plain gradient steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, unused

#: Labelled documents of the sample, taken by the hash of their id: the bound of what the classifier is fitted on, and so of its features.
SAMPLE_DOCS = 20_000
#: Features up to which the classifier's table is sent to every worker; beyond, it meets the documents in a shuffled join.
SENT = 500_000
#: Likelihood ratio statistic below which a feature is taken as chance.
TELLING = 24.0
#: Posterior of all other domains together from which an unlabelled row isn't spared.
CLEAR = 0.99
#: The fit ends once the gradient, as a share of all tokens, is no more than this in any domain.
ENOUGH = 1e-6
#: Weight of the distance of rates from 1 beside the least squares.
NEAR_ONE = 1e-8
#: Where a step isn't good: shares of all tokens by domain that are added to the Gram sums (1: a plain step at most), and parts of such steps; all are tried at once.
DAMPS, PARTS = (0.0, 1e-8, 1e-6, 1e-4, 1e-2, 1.0), (1.0, 0.25, 0.0625, 0.015625)
#: Steps after which a fit ends, if targets that can't be reached keep it from settling before; `gap` says what is left.
STEPS = 60
#: How often resample() gives a row at most, and how many times its tokens it asks of a domain at most: a domain with next to no tokens can't have a share by repeating a few rows without end.
MOST = 16.0
_SPLIT = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>!]"
#: A feature of every document that tells nothing: it keeps documents without others, and counts equal rows.
_ALWAYS = ""


def words_of(text: Column) -> Column:
    """Lower-cased words of a whole text; null has none.

    A higher-order function on purpose: with array_remove, all up to the sums becomes one generated method, too long to be compiled.
    """
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != "")


def _share(part: Column, whole: Column) -> Column:
    """A share of `whole` in eighths, as a small integer."""
    return F.least(F.lit(8), F.floor(part * 8 / F.greatest(whole, F.lit(1))))


def featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (a key of the row), doc_id, n_tokens, n_distinct and features: distinct words, marks of the text's shape, which hold a space, and _ALWAYS."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("body"), words_of(body).alias("words"))
    n, distinct = F.size("words"), F.array_distinct("words")
    upper = F.regexp_count("body", F.lit("[A-Z]"))
    marks = F.array(
        F.lit(_ALWAYS),
        F.concat(F.lit("symbols "), _share(F.regexp_count("body", F.lit(_SYMBOLS)), n).cast("string")),
        F.concat(F.lit("distinct "), _share(F.size("distinct"), n).cast("string"), F.lit(" "), F.least(F.lit(12), F.floor(F.log2(n + F.lit(1)))).cast("string")),
        F.concat(F.lit("upper "), _share(upper, F.length("body")).cast("string")),
    )
    return rows.withColumn("distinct", distinct).select("doc_id", F.xxhash64("doc_id", "body").alias("doc"), n.cast("long").alias("n_tokens"), F.size("distinct").alias("n_distinct"), F.concat("distinct", marks).alias("features"))


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labelled rows: toxic; else good or poor by quality. Null labels count as 0, rows with a null id are left out, and of repeated ids the first domain by name holds."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(domain).alias("domain"))


def classifier(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[list[str], dict[str, float], dict[str, float], DataFrame | None]:
    """Domains, the log of their priors and of a word that isn't telling, and the table (feature, what its presence adds for each domain) of the telling features.

    labelled has doc_id and domain. A word counts once a document, and equal texts of a domain count once. Without labelled documents: no domains.
    """
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    own = unused(docs, "__id")
    texts = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", own)), F.col(f"`{key}`") == F.col(own))
    seen = featured(texts, key, text).join(F.broadcast(sample), "doc_id").select("domain", "features", "n_distinct", F.xxhash64("features").alias("h")).dropDuplicates(["domain", "h"])
    seen = keep(seen, "mixing-sample", rows=SAMPLE_DOCS)
    totals = {r["domain"]: (r["n"], r["w"]) for r in seen.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("n_distinct").alias("w")).collect()}
    if not totals:
        return [], {}, {}, None
    domains, everything = sorted(totals), sum(n for n, _ in totals.values())
    counts = seen.select("domain", F.explode("features").alias("feature")).where(F.col("feature") != _ALWAYS)
    counts = counts.groupBy("feature").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in domains], F.count(F.lit(1)).alias("__n"))
    overall = F.log((F.col("__n") + 0.5) / F.lit(everything + 1.0))
    tells = sum((2 * F.col(d) * (F.log((F.col(d) + 0.5) / F.lit(totals[d][0] + 1.0)) - overall) for d in domains), F.lit(0.0))  # the likelihood ratio statistic
    mark = F.col("feature").contains(" ")
    best = counts.where(tells > TELLING).select("feature", mark.alias("mark"), *[((F.col(d) + 0.5) / F.when(mark, totals[d][0] + 1.0).otherwise(totals[d][1] + 1.0)).alias(d) for d in domains])
    best = keep(best, "mixing-telling", rows=SENT)
    told = best.where("not mark").agg(*[F.coalesce(F.sum(d), F.lit(0.0)).alias(d) for d in domains]).first()
    rest = {d: math.log(max(1.0 - told[d], 0.5 / (totals[d][1] + 1.0))) for d in domains}
    nothing = docs.sparkSession.createDataFrame([(_ALWAYS, *[0.0] * len(domains))], "feature string, " + ", ".join(f"`{d}` double" for d in domains))
    table = best.select("feature", *[(F.log(d) - F.when(F.col("mark"), 0.0).otherwise(rest[d])).alias(d) for d in domains]).unionByName(nothing)
    table = keep(table, "mixing-weights", rows=SENT)
    forget(seen, best)
    return domains, {d: math.log((totals[d][0] + 0.5) / (everything + 1.0)) for d in domains}, rest, table


def posteriors(docs: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, doc_id, n_tokens and p_<domain> of every row."""
    domains, priors, rest, table = model
    rows = featured(docs, key, text)
    if not domains:
        return rows.select("doc", "doc_id", "n_tokens", F.lit(1.0).alias("p_all"))
    keyed = table.select(F.xxhash64("feature").alias("feature"), *domains)  # 64 bits of a feature: none of so few share them
    sent = F.broadcast(keyed) if table.count() <= SENT else keyed
    found = rows.select("doc", "doc_id", "n_tokens", "n_distinct", F.explode(F.transform("features", lambda x: F.xxhash64(x))).alias("feature")).join(sent, "feature")
    # All features of a row come from one task, so partial sums leave one row a document for the exchange.
    always = F.col("feature") == F.xxhash64(F.lit(_ALWAYS))
    sums = found.groupBy("doc", "doc_id", "n_tokens", "n_distinct").agg(F.count(F.when(always, 1)).alias("copies"), *[F.sum(d).alias(f"s_{d}") for d in domains])
    logs = {d: F.col(f"s_{d}") / F.col("copies") + F.lit(priors[d]) + F.col("n_distinct") * F.lit(rest[d]) for d in domains}  # equal rows have been summed together
    top = F.greatest(*logs.values()) if len(domains) > 1 else logs[domains[0]]
    odds = sums.select("doc", "doc_id", "n_tokens", "copies", *[F.exp(logs[d] - top).alias(f"e_{d}") for d in domains])
    total = sum((F.col(f"e_{d}") for d in domains), F.lit(0.0))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return odds.select("doc", "doc_id", "n_tokens", *[F.round(F.col(f"e_{d}") / total, 9).alias(f"p_{d}") for d in domains], each).drop("copy")


def rates(members: DataFrame, weights: dict[str, float], growth: float = 1.0, most: float | None = None) -> DataFrame:
    """members with a rate for each row, fitted so that expected tokens of domain k are near weights[k] * growth * all tokens, and `gap`: the largest distance from a target that is left, as a share of all tokens.

    gap is next to 0 where the targets can be reached; where they can't, the rates are those of the least sum of squares. weights are
    brought to sum 1; domains without one have weight 0. Rows without tokens keep rate 1 where their posteriors are those
    of others. Where members have a column __least, no rate falls below it. With `most`, no rate rises above it, and no
    domain is asked for more than so many times its tokens; gap then still counts from the target of the weights. An empty table
    stays empty. Repeated rows and ties have equal rates. The sums of a step (a few numbers a domain) are all that reaches the driver.
    """
    names = [c[2:] for c in members.columns if c.startswith("p_")]
    given = np.array([weights.get(d, 0.0) for d in names])
    given = given / given.sum() if given.sum() > 0 else np.full(len(names), 1 / len(names))
    least = F.col("__least") if "__least" in members.columns else F.lit(0.0)
    p, t = [F.col(f"p_{d}") for d in names], F.col("n_tokens")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    def rate_of(by: np.ndarray) -> tuple[Column, Column]:
        free = F.lit(1.0) - sum((q * F.lit(float(x)) for q, x in zip(p, by, strict=True)), F.lit(0.0))
        rate = F.greatest(least, free)
        return free, rate if most is None else F.least(F.lit(float(most)), rate)

    def worth(by: np.ndarray) -> Column:
        free, rate = rate_of(by)
        return F.sum(t * (rate * free - rate * rate / 2))

    def sums(by: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens of each domain at these rates, the Gram sums of the rows that aren't cut, and the rows' part of the objective."""
        free, rate = rate_of(by)
        own = F.when(free == rate, t).otherwise(0.0)
        got = members.agg(*[F.sum(t * q * rate) for q in p], *[F.sum(own * p[i] * p[j]) for i, j in pairs], worth(by)).first()
        gram = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, got[len(names) : -1], strict=True):
            gram[i, j] = gram[j, i] = v or 0.0
        return np.array([v or 0.0 for v in got[: len(names)]]), gram, got[-1] or 0.0

    by = np.zeros(len(names))
    now, gram, value = sums(by)
    everything = now.sum()
    if not everything:
        return members.withColumns({"rate": F.lit(1.0), "gap": F.lit(0.0)}).drop("__least")
    share = np.maximum(now, 1e-12 * everything)
    wanted, near = given * growth * everything, NEAR_ONE * share
    target = wanted if most is None else np.minimum(wanted, most * now)
    objective = lambda by, value: value + float(by @ target + (near * by * by).sum() / 2)
    for _ in range(STEPS):
        slope, best = target - now + near * by, objective(by, value)
        if np.abs(slope).max() <= ENOUGH * everything:
            break
        quick = np.linalg.solve(gram + np.diag(near), -slope)
        to = by + quick
        got = sums(to)
        if not objective(to, got[2]) <= best + 1e-4 * float(quick @ slope):
            tried = [by + part * np.linalg.solve(gram + np.diag(near + damp * share), -slope) for damp in DAMPS for part in PARTS]
            found = members.agg(*[worth(x).alias(f"v{i}") for i, x in enumerate(tried)]).first()
            to = min(zip(tried, found, strict=True), key=lambda x: objective(*x))[0]
            got = sums(to)
        fine = objective(to, got[2]) >= best - 1e-14 * abs(best)  # nothing is left that doubles can tell apart
        by, (now, gram, value) = to, got
        if fine:
            break
    return members.withColumns({"rate": F.round(rate_of(by)[1], 6), "gap": F.lit(float(np.abs(now - wanted).max() / everything))}).drop("__least")


def floored(members: DataFrame, domains: DataFrame, spared: str) -> DataFrame:
    """members with __least: 1 where the row is labelled as `spared`, or has no label and isn't clearly of other domains; else 0."""
    other = F.lit(1.0) - F.col(f"p_{spared}") if f"p_{spared}" in members.columns else F.lit(0.0)
    named = domains.select(F.col("doc_id").alias("__id"), F.col("domain").alias("__domain"))
    spare = F.when(F.col("__domain").isNotNull(), F.col("__domain") == spared).otherwise(other < CLEAR)
    return members.join(named, F.col("doc_id") == F.col("__id"), "left").withColumn("__least", spare.cast("double")).drop("__id", "__domain")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], growth: float = 1.0, key: str = "doc_id", text: str = "text", spared: str | None = None, most: float | None = None) -> DataFrame:
    """doc, doc_id, n_tokens, p_<domain>, rate and gap (as rates() gives it) of every row of docs.

    A null text has no tokens. Repeated rows are rows of their own with equal rates. Without usable labels there is one domain, `all`.
    Extra columns of docs are not read, so their names can't clash. Rows of the domain `spared`, by label or else by
    posterior, have a rate of 1 at least; `most` is as in rates().
    """
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    domains = domain_of(labels)
    members = posteriors(own, classifier(own, domains))
    members = keep(floored(members, domains, spared) if spared else members, "mixing-members")
    return rates(members, weights, growth, most)


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], growth: float = 1.0, key: str = "doc_id", text: str = "text", spared: str | None = None, most: float = MOST) -> DataFrame:
    """docs, with all their columns, each row as often as its rate says: the whole part, and once more where a hash of the id, as a number in [0, 1), lies below the rest.

    Rows with equal id and text have one rate and one draw, so all of them come back alike; a null id draws like any other, and a
    null text is an empty one. Without usable labels, every row has the rate `growth`. No rate is above `most`. An empty table stays empty.
    """
    one, rate, mine, times, copy = (unused(docs, n) for n in ("__rated", "__rate", "__doc", "__times", "__copy"))
    rated = mix(docs, labels, weights, growth, key, text, spared, most).groupBy(F.col("doc").alias(one)).agg(F.max("rate").alias(rate))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    doc = F.xxhash64(F.col(f"`{key}`").alias("doc_id"), body.alias("body"))
    draw = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("draw")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = docs.withColumn(mine, doc).join(rated, F.col(mine) == F.col(one)).withColumn(times, F.floor(F.col(rate) + draw).cast("int")).where(F.col(times) > 0)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
