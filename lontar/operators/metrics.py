"""Evaluation of rankings and of annotators, as aggregates and windows over long tables.

Rankings are (model, query_id, doc_id, rank), judgements (query_id, doc_id, relevance). Unjudged documents count as not
relevant. Windows are always partitioned by query and model; nothing is gathered on the driver but results with one row
a model or pair of models.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

KEYS = ["model", "query_id"]


def last_votes(labels: DataFrame, grades: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(query_id, doc_id, annotator, vote): the last valid label of each annotator; the greater one at equal times."""
    good = labels.where(F.col("relevance").isin(*grades)).dropna(subset=["query_id", "listing_id", "annotator"])
    return good.groupBy("query_id", F.col("listing_id").alias("doc_id"), F.lower(F.trim("annotator")).alias("annotator")).agg(F.max_by("relevance", F.struct("labelled_at", "relevance")).alias("vote"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance): the most frequent vote, the greatest among equals."""
    counted = votes.groupBy("query_id", "doc_id", "vote").agg(F.count("*").alias("n"))
    return counted.groupBy("query_id", "doc_id").agg(F.max_by("vote", F.struct("n", "vote")).alias("relevance"))


def middle_vote(votes: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevance): the most frequent vote if any repeats (the smaller among equals), else the upper middle one."""
    counted = votes.groupBy("query_id", "doc_id", "vote").agg(F.count("*").alias("n"))
    seen = counted.groupBy("query_id", "doc_id").agg(F.max("n").alias("most"), F.max_by("vote", F.struct("n", -F.col("vote"))).alias("mode"), F.sort_array(F.collect_list("vote")).alias("all"))
    middle = F.element_at("all", (F.floor(F.size("all") / 2) + 1).cast("int"))
    return seen.select("query_id", "doc_id", F.when(F.col("most") > 1, F.col("mode")).otherwise(middle).alias("relevance"))


def rankings_of_votes(votes: DataFrame) -> DataFrame:
    """Each annotator as a model that ranks what it labelled, by grade and then document id."""
    order = W.partitionBy("annotator", "query_id").orderBy(F.desc("vote"), "doc_id")
    return votes.select(F.col("annotator").alias("model"), "query_id", "doc_id", F.row_number().over(order).alias("rank"))


def ranking_metrics(rankings: DataFrame, judged: DataFrame, threshold: int = 1) -> DataFrame:
    """(model, query_id, p_at_5, p_at_10, ap, ndcg_at_10, rr) of every ranked query.

    Precision divides by k even where fewer documents came back; average precision by all relevant documents, 0 if there
    are none; NDCG has linear gains and an ideal of all judged grades, 0 if that is 0.
    """
    joined = rankings.join(judged, ["query_id", "doc_id"], "left").na.fill(0, ["relevance"])
    hit = (F.col("relevance") >= threshold).cast("int")
    so_far = F.sum(hit).over(W.partitionBy(*KEYS).orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    seen = joined.withColumn("hit", hit).withColumn("precision", so_far / F.col("rank"))
    gain = F.col("relevance") / F.log2(F.col("rank") + 1.0)
    found = seen.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("h5"),
        F.sum(F.when(F.col("rank") <= 10, F.col("hit")).otherwise(0)).alias("h10"),
        F.sum(F.when(F.col("hit") == 1, F.col("precision")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(F.col("rank") <= 10, gain).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
    )
    best = judged.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= 10, F.col("relevance") / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("idcg"), F.sum((F.col("relevance") >= threshold).cast("int")).alias("relevant"))
    both = found.join(ideal, "query_id", "left").na.fill(0, ["idcg", "relevant"])
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select(*KEYS, (F.col("h5") / 5).alias("p_at_5"), (F.col("h10") / 10).alias("p_at_10"), safe("precisions", "relevant").alias("ap"), safe("dcg", "idcg").alias("ndcg_at_10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def summary(metrics: DataFrame) -> DataFrame:
    """Means per model and the number of its queries."""
    names = ["p_at_5", "p_at_10", "ap", "ndcg_at_10", "rr"]
    return metrics.groupBy("model").agg(*(F.avg(n).alias(n if n != "ap" else "map") for n in names), F.count("*").alias("queries"))


def difficulty(metrics: DataFrame) -> DataFrame:
    """(query_id, mean_ap, band): hard under 0.1, medium under 0.3, else easy."""
    mean = metrics.groupBy("query_id").agg(F.avg("ap").alias("mean_ap"))
    return mean.withColumn("band", F.when(F.col("mean_ap") < 0.1, "hard").when(F.col("mean_ap") < 0.3, "medium").otherwise("easy"))


def constraint_satisfaction(hits: DataFrame, k: int = 5) -> DataFrame:
    """(model, query_id, cs): the share of the returned top k that meets all constraints (column ok); none returned: no row."""
    return hits.where(F.col("rank") <= k).groupBy(*KEYS).agg(F.avg(F.col("ok").cast("double")).alias("cs"))


def paired(metrics: DataFrame, value: str = "ap") -> DataFrame:
    """(a, b, query_id, x, y): the values of every two models, a < b, on the queries that both have."""
    left = metrics.select("query_id", F.col("model").alias("a"), F.col(value).alias("x"))
    right = metrics.select("query_id", F.col("model").alias("b"), F.col(value).alias("y"))
    return left.join(right, "query_id").where("a < b")


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """(a, b, n, n_nonzero, w_plus, w_minus, ties): Wilcoxon's rank sums; zeros dropped, ties share their mean rank.

    ties is the sum of t^3 - t over groups of t equal differences. Differences are compared at twelve decimals.
    """
    d = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 12))
    total = d.groupBy("a", "b").agg(F.count("*").alias("n"))
    size = F.abs("d")
    same = W.partitionBy("a", "b", size)
    ranked = d.where("d <> 0").withColumn("r", F.rank().over(W.partitionBy("a", "b").orderBy(size)) + (F.count("*").over(same) - 1) / 2).withColumn("t", F.count("*").over(same))
    sums = ranked.groupBy("a", "b").agg(F.count("*").alias("n_nonzero"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1.0).alias("ties"))
    return total.join(sums, ["a", "b"], "left").na.fill(0)


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(a, b, n, statistic, z, p_value, rank_biserial): two-sided signed-rank test by the normal approximation without
    continuity correction; rank-biserial correlation (W+ - W-) / (W+ + W-), 0 without differences."""
    s = signed_ranks(pairs)
    m = F.col("n_nonzero")
    variance = m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48
    z = F.when(variance > 0, (F.least("w_plus", "w_minus") - m * (m + 1) / 4) / F.sqrt(variance)).otherwise(0.0)
    both = F.col("w_plus") + F.col("w_minus")
    erfc = F.pandas_udf(lambda x: x.map(lambda v: math.erfc(abs(v) / math.sqrt(2))), "double")
    effect = F.when(both > 0, (F.col("w_plus") - F.col("w_minus")) / both).otherwise(0.0)
    return s.select("a", "b", "n", F.least("w_plus", "w_minus").alias("statistic"), z.alias("z"), erfc(z).alias("p_value"), effect.alias("rank_biserial"))


def paired_t(pairs: DataFrame) -> DataFrame:
    """(a, b, n, t, cohens_d) of paired differences; both 0 where they do not vary."""
    d = pairs.withColumn("d", F.col("x") - F.col("y")).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    effect = F.when(F.col("sd") > 1e-15, F.col("mean") / F.col("sd")).otherwise(0.0)
    return d.select("a", "b", "n", (effect * F.sqrt("n")).alias("t"), effect.alias("cohens_d"))


def holm(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, key: str = "test") -> DataFrame:
    """Holm's step-down correction of a table of tests (key, p): adds p_holm, threshold and significant.

    Ranks need one window over all tests: a table of tests is small.
    """
    order = W.partitionBy(F.lit("all")).orderBy(p, key)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    m = F.count("*").over(W.partitionBy(F.lit("all")))
    left = m - F.row_number().over(order) + 1
    staged = tests.withColumn("left", left).withColumn("step", F.least(F.lit(1.0), F.col("left") * F.col(p))).withColumn("threshold", alpha / F.col("left"))
    passed = (F.col(p) <= F.col("threshold")).cast("int")
    return staged.withColumn("p_holm", F.max("step").over(upto)).withColumn("significant", F.min(passed).over(upto) == 1).drop("left", "step")


def bootstrap_mean(metrics: DataFrame, value: str = "ap", resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(model, mean, low, high): percentile bootstrap of the mean, queries in order of their id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("query_id")[value].to_numpy()
        rng = np.random.default_rng(seed)
        means = x[rng.integers(0, len(x), (resamples, len(x)))].mean(axis=1)
        low, high = np.percentile(means, [50 * (1 - level), 50 * (1 + level)])
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "mean": [x.mean()], "low": [low], "high": [high]})

    return metrics.select("model", "query_id", value).groupBy("model").applyInPandas(run, "model string, mean double, low double, high double")


def vote_pairs(votes: DataFrame) -> DataFrame:
    """(a, b, x, y): the votes of every two annotators, a < b, on the items that both labelled."""
    left = votes.select("query_id", "doc_id", F.col("annotator").alias("a"), F.col("vote").alias("x"))
    right = votes.select("query_id", "doc_id", F.col("annotator").alias("b"), F.col("vote").alias("y"))
    return left.join(right, ["query_id", "doc_id"]).where("a < b").select("a", "b", "x", "y")


def confusion(pairs: DataFrame) -> DataFrame:
    """(a, b, x, y, n): how often two annotators gave which labels."""
    return pairs.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))


def kappa(pairs: DataFrame, labels: tuple[int, ...] = (0, 1, 2), weights: str | None = None) -> DataFrame:
    """(a, b, n, kappa) of every two annotators: Cohen's, or weighted (linear, quadratic) by the labels' positions.

    Where chance alone would agree always, 1 if they do and 0 if not.
    """
    cells = confusion(pairs)
    spread = max(len(labels) - 1, 1)
    at = F.create_map(*(F.lit(v) for i, x in enumerate(labels) for v in (x, i)))

    def off(x: Column, y: Column) -> Column:
        gap = F.abs(at[x] - at[y]) / spread
        return (x != y).cast("double") if weights is None else gap if weights == "linear" else gap * gap

    total = cells.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * off(F.col("x"), F.col("y"))).alias("observed"))
    left = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("nx"))
    right = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    chance = left.join(right, ["a", "b"]).groupBy("a", "b").agg(F.sum(F.col("nx") * F.col("ny") * off(F.col("x"), F.col("y"))).alias("expected"))
    po, pe = F.col("observed") / F.col("n"), F.col("expected") / (F.col("n") * F.col("n"))
    return total.join(chance, ["a", "b"]).select("a", "b", "n", F.when(pe > 0, 1 - po / pe).otherwise(F.when(po > 0, 0.0).otherwise(1.0)).alias("kappa"))


def interpret_kappa(k: Column) -> Column:
    """The usual words for a kappa."""
    return F.when(k < 0, "less than chance").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost perfect")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): rank correlation, ties sharing their mean rank.

    Ranks come from counts of distinct values, so that only those, not the rows, pass through one window.
    """

    def ranks(c: str) -> DataFrame:
        counted = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(c).agg(F.count("*").alias("m"))
        below = F.sum("m").over(W.partitionBy(F.lit("all")).orderBy(c).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("m")
        return counted.select(c, (below + (F.col("m") + 1) / 2).alias(f"r_{c}"))

    both = df.select(x, y).dropna().join(ranks(x), x).join(ranks(y), y)
    return both.agg(F.count("*").alias("n"), F.corr(f"r_{x}", f"r_{y}").alias("rho"))
