"""Soft-membership mixing: document rates whose expected domain token totals match target weights.

A naive Bayes classifier with normal features, fitted to the labelled table by one aggregate, gives every
document a posterior over the domains (the values of a label column). With n tokens in document i and
posterior p, the rates r >= 0 solve

    minimise  1/2 sum_k ((sum_i r_i n_i p_ik - t_k) / t_k)^2     from r = 1

by projected gradient steps in the token-weighted norm: r_i <- max(0, r_i - step * sum_k g_k p_ik) with the
relative misses g. A step needs the K totals only, one aggregate without a shuffle of documents; the misses
go into the next step's expression as constants. The smallest total for which no domain has to shrink is
used, so that mixing repeats documents rather than discards them.

Where posteriors overlap these steps become too slow. Newton steps take over then: the rates nearest to 1 that
match the targets are max(0, 1 - sum_k m_k p_ik) for K multipliers m, which solve T_k(m) = t_k. A step needs
the K totals and the K x K sums of n_i p_ik p_il over the rates that are not at the bound, one aggregate again.
With a bound at which no rates match, a small multiple of m is added to the misses and made smaller until they
no longer shrink; the remaining miss is logged and kept in ``Mixture.miss``.

Everything is DataFrame expressions. The features are a handful of numbers per document; they are written
once, because every step reads them. Applying the rates to documents is a map over their rows.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import doc_key, packed, table, unpacked
from secstream.session import materialise

LABEL = "quality"
TARGETS = {1: 0.9, 0: 0.1}
#: Largest relative miss of a domain's total at which the steps end, and the most gradient steps.
TOLERANCE = 1e-4
MOST_STEPS = 200
#: Gradient steps in a row at whose pace MOST_STEPS would not do, after which Newton steps follow.
SLOW_STEPS = 3
#: Weights of the multipliers beside the misses, one after the other, and the share of the squared misses that a
#: smaller weight has to take away for the next to be tried.
WEIGHTS = tuple(10.0**-k for k in range(1, 9))
LEAST_GAIN = 0.1
#: Newton steps at one weight, the share of the miss at which they end, and the parts of a step that are tried
#: when the whole makes the misses larger.
NEWTON_STEPS, INNER_SHARE, HALVED = 20, 0.02, tuple(2.0**-k for k in range(1, 9))
#: Steps after which the rates are written, so that expressions stay short.
CUT_EVERY = 10
FEATURES = ("length", "symbols", "capitals", "distinct", "word_length")
SEED = 7
#: Added to a rate before it is rounded: what the steps left short of a whole number is not a reason to drop.
SLACK = 1e-3


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with _key, _n (words, the tokens that are mixed) and the features."""
    text = F.coalesce("text", F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda kinds: (F.length(text) - F.length(F.translate(text, kinds, ""))) / size
    words = docs.withColumns({"_key": doc_key(F.col("doc_id"), F.col("text")), "_words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")})
    n = F.size("_words").cast("long")
    return words.withColumns(
        {
            "_n": n,
            "_length": F.log1p(F.length(text).cast("double")),
            "_symbols": F.log(share("#*$%&|<>!") + 1e-3),
            "_capitals": F.log(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") + 1e-2),
            "_distinct": F.size(F.array_distinct("_words")) / F.greatest(n, F.lit(1)),
            "_word_length": F.log1p(F.length(text) / F.greatest(n, F.lit(1))),
        }
    ).drop("_words")


@dataclass
class Mixture:
    """The classifier and the steps taken; turns feature columns into posteriors and rates."""

    domains: list[int]
    priors: dict[int, float]
    moments: dict[int, list[tuple[float, float]]]  # (mean, variance) of each feature
    steps: list[dict[int, float]] = field(default_factory=list)
    least: float = 0.0  # no rate falls below it
    miss: dict[int, float] = field(default_factory=dict)  # relative, of each domain's total, after the last step

    def posteriors(self, df: DataFrame) -> DataFrame:
        """``df`` with _p0, _p1, ..., one for each domain, adding up to 1."""
        score = {}
        for k, d in enumerate(self.domains):
            s = F.lit(0.0) + F.log(F.lit(self.priors[d]))
            for name, (mean, var) in zip(FEATURES, self.moments[d], strict=True):
                s = s - (F.col(f"_{name}") - mean) ** 2 / (2 * var) - F.log(F.lit(var)) / 2
            score[f"_s{k}"] = s
        names = list(score)
        top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
        weights = {f"_w{k}": F.exp(F.col(n) - F.col("_top")) for k, n in enumerate(names)}
        out = df.withColumns(score).withColumn("_top", top).withColumns(weights)
        total = sum((F.col(w) for w in weights), F.lit(0.0))
        return out.withColumns({f"_p{k}": F.col(f"_w{k}") / total for k in range(len(names))}).drop(*names, *weights, "_top")

    def stepped(self, rate: Column, step: dict[int, float]) -> Column:
        down = sum((F.lit(g) * F.col(f"_p{self.domains.index(d)}") for d, g in step.items()), F.lit(0.0))
        return F.greatest(rate - down, F.lit(self.least))

    def rates(self, df: DataFrame) -> DataFrame:
        """``df`` with _rate; ``df`` has the posteriors."""
        rate: Column = F.lit(1.0)
        for k, step in enumerate(self.steps):
            rate = self.stepped(rate, step)
            if k % CUT_EVERY == CUT_EVERY - 1:
                df = df.withColumn("_rate", rate)
                rate = F.col("_rate")
        return df.withColumn("_rate", rate)


def classifier(features: DataFrame, labels: DataFrame, label: str) -> Mixture:
    """Class shares and moments of the features over all labelled rows of ``features``."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_key")).agg(F.max(F.col(label).cast("long")).alias("_domain"))
    sums = [x for f in FEATURES for x in (F.avg(f"_{f}").alias(f"m_{f}"), F.var_pop(f"_{f}").alias(f"v_{f}"))]
    rows = features.join(known, "_key").groupBy("_domain").agg(F.count("*").alias("n"), *sums).collect()
    total = sum(r.n for r in rows)
    rows.sort(key=lambda r: r._domain)
    return Mixture(
        [r._domain for r in rows],
        {r._domain: r.n / total for r in rows},
        {r._domain: [(r[f"m_{f}"], r[f"v_{f}"] + 1e-3) for f in FEATURES] for r in rows},
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = LABEL, targets: dict[int, float] | None = None, least: float = 0.0) -> Mixture:
    """Fit the classifier, then step until the expected totals match. Without labels all rates stay 1.

    ``least`` bounds the rates from below; where posteriors overlap so much that the targets cannot be met
    within it, the nearest totals are fitted.

    Domains without a target weight, or without a labelled document, take no part in the match.
    """
    targets = TARGETS if targets is None else targets
    features = materialise(with_features(docs.select("doc_id", "text")), "mix-features")
    mix = classifier(features, labels, label)
    mix.least = least
    if not mix.domains:
        return mix
    own = materialise(mix.posteriors(features).select("_key", "_n", *(f"_p{k}" for k in range(len(mix.domains)))), "mix-posteriors")
    wanted = {d: w for d, w in targets.items() if d in mix.domains and w > 0}

    def totals(rate: Column) -> dict[int, float]:
        sums = own_now.agg(*(F.sum(rate * F.col("_n") * F.col(f"_p{mix.domains.index(d)}")).alias(str(d)) for d in wanted)).first()
        return {d: float(sums[str(d)] or 0.0) for d in wanted}

    own_now, rate = own, F.lit(1.0)
    now = totals(rate)
    wanted = {d: w for d, w in wanted.items() if now[d] > 0}
    if not wanted:
        return mix
    whole = max(now[d] / w for d, w in wanted.items())
    goal = {d: w * whole for d, w in wanted.items()}
    # the largest change of a relative total for a unit of change in the misses
    both = own.agg(*(F.sum(F.col("_n") * F.col(f"_p{mix.domains.index(a)}") * F.col(f"_p{mix.domains.index(b)}")).alias(f"{a},{b}") for a in wanted for b in wanted)).first()
    step = 1.0 / max(sum(float(both[f"{a},{b}"] or 0.0) for b in wanted) / goal[a] for a in wanted)
    misses = lambda now: {d: (now[d] - goal[d]) / goal[d] for d in wanted}
    largest = lambda miss: max(map(abs, miss.values()))
    mix.miss, slow = misses(now), 0
    for k in range(MOST_STEPS):
        if largest(mix.miss) <= TOLERANCE or slow >= SLOW_STEPS:
            break
        mix.steps.append({d: step * g for d, g in mix.miss.items()})
        rate = mix.stepped(rate, mix.steps[-1])
        if k % CUT_EVERY == CUT_EVERY - 1:
            own_now = materialise(own_now.withColumn("_rate", rate), "mix-rates")
            rate = F.col("_rate")
        before, mix.miss = largest(mix.miss), misses(totals(rate))
        too_slow = largest(mix.miss) * min(1.0, largest(mix.miss) / before) ** (MOST_STEPS - k - 1) > TOLERANCE
        slow = slow + 1 if too_slow else 0
    if largest(mix.miss) > TOLERANCE:
        multipliers, mix.miss = newton(own, mix, goal)
        mix.steps = [multipliers]
    if largest(mix.miss) > TOLERANCE:
        logging.getLogger(__name__).warning("rates of %s or more cannot match the targets; relative misses left: %s", least, mix.miss)
    return mix


def newton(own: DataFrame, mix: Mixture, goal: dict[int, float]) -> tuple[dict[int, float], dict[int, float]]:
    """Multipliers m for which the rates max(least, 1 - sum_k m_k p_ik) match ``goal``, and the misses left."""
    names = list(goal)
    p = [F.col(f"_p{mix.domains.index(d)}") for d in names]
    t = np.array([goal[d] for d in names])

    def at(*tried: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``tried`` the relative misses, and how fast they fall with each multiplier; one aggregate."""
        n, sums = len(names), []
        for m in tried:
            rate = mix.stepped(F.lit(1.0), dict(zip(names, map(float, m), strict=True)))
            free = F.when(rate > mix.least, F.col("_n")).otherwise(0)
            sums += [F.sum(rate * F.col("_n") * x) for x in p] + [F.sum(free * p[a] * p[b]) for a in range(n) for b in range(n)]
        row = np.array([float(x or 0.0) for x in own.agg(*(x.alias(f"s{k}") for k, x in enumerate(sums))).first()])
        return [(x[:n] / t - 1, x[n:].reshape(n, n) / t[:, None]) for x in row.reshape(len(tried), n + n * n)]

    m = np.zeros(len(names))
    [(miss, falls)] = at(m)
    best, reached, size = m, miss, lambda g: float((t * g**2).sum())
    for weight in WEIGHTS:
        for _ in range(NEWTON_STEPS):
            error = miss - weight * m
            if abs(error).max() <= max(TOLERANCE / 4, INNER_SHARE * abs(miss).max()):
                break
            move = np.linalg.solve(falls + weight * np.eye(len(m)), error)
            found = None
            for shares in ((1.0,), HALVED):
                tried = [m + share * move for share in shares]
                results = list(zip(tried, at(*tried), strict=True))
                found = min(results, key=lambda x: size(x[1][0] - weight * x[0]))
                if size(found[1][0] - weight * found[0]) < size(error):
                    break
                found = None
            if found is None:
                break
            m, (miss, falls) = found
        before = size(reached)
        if size(miss) < before:
            best, reached = m, miss
        if abs(reached).max() <= TOLERANCE or (weight < WEIGHTS[0] and size(reached) > (1 - LEAST_GAIN) * before):
            break
    return dict(zip(names, map(float, best), strict=True)), dict(zip(names, map(float, reached), strict=True))


def applied(docs: DataFrame, mix: Mixture) -> DataFrame:
    """``docs`` with _key, _n, the posteriors and _rate; 1 for all rows if there were no labels."""
    df = with_features(docs)
    if not mix.domains:
        return df.withColumn("_rate", F.lit(1.0))
    return mix.rates(mix.posteriors(df))


def mixing_rates(docs: DataFrame, labels: DataFrame, label: str = LABEL, targets: dict[int, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for every domain, rate; a row for every row of ``docs``.

    Null and empty texts have 0 tokens and a posterior like any other. Rows with a null id are never
    labelled but get their rate; repeated rows get the same rate; other columns are ignored.
    """
    mix = fit(docs, labels, label, targets)
    return applied(docs.select("doc_id", "text"), mix).select(
        "doc_id", F.col("_n").alias("n_tokens"), *(F.col(f"_p{k}").alias(f"p_{d}") for k, d in enumerate(mix.domains)), F.col("_rate").alias("rate")
    )


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: each document as often as its rate says, all columns unchanged.

    The fractional part is decided by a hash of the document's key, so the result is the same each time.
    No rate is below 1: every document stays, those of a domain below its weight are repeated.
    """
    mix = fit(docs, table(spark, sf_dir, "labels"), least=1.0)
    chance = F.pmod(F.xxhash64("_key", F.lit(SEED)), F.lit(1_000_000)) / 1_000_000
    times = applied(packed(docs), mix).select("_row", F.floor(F.col("_rate") + SLACK + chance).cast("int").alias("_times"))
    return unpacked(times.select("_row", F.explode(F.array_repeat(F.lit(True), F.col("_times")))))


def op9_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
