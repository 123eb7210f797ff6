"""Consensus of several annotators' labels by the triplet moment method.

1. One vote per annotator and item: the last valid label; names are compared trimmed and in lower case.
2. For every two annotators, the rate at which they agree, corrected for chance: with K labels, ``m = (K agree - 1) / (K - 1)``
   estimates the product of their skills ``u = (K accuracy - 1) / (K - 1)``. Any three then solve for each of them,
   ``u_i^2 = m_ij m_ik / m_jk``; the median over all triplets is the annotator's skill, its sign that of the mean
   agreement with the others.
3. Votes are combined with log-odds weights, ``log((K - 1) accuracy / (1 - accuracy))``.
4. ``rounds`` of the consensus, 0 unless asked for, go on from there: annotators err in their own ways (one rates a grade
   too high, one always the same), so the weights of each single vote are read off the step before, as the log-odds of a
   true label given annotator and vote. That is another method, and a result of its own.

Annotators are people: tables with one row an annotator, pair or triplet of annotators are small. The votes, however
many, are only ever grouped by item or by (annotator, vote).

Invalid and null labels, and rows of null item or annotator, are no votes. Equal times: the greater label counts; a
null time is before all others. Equal weights: the smaller label wins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.runtime import bounded_broadcast, cut_lineage

#: Items that two annotators must share before their rate of agreement counts.
SHARED = 5
LEAST, MOST = 0.02, 0.98


def votes(labels: DataFrame, grades: tuple[int, ...] = (0, 1, 2), item: tuple[str, ...] = ("query_id", "listing_id")) -> DataFrame:
    """(*item, annotator, vote): the one vote of each annotator on each item."""
    name = F.lower(F.regexp_replace("annotator", r"(?U)^\s+|\s+$", ""))
    good = labels.where(F.col("relevance").isin(*grades) & (name != "")).dropna(subset=list(item))
    return good.groupBy(*item, name.alias("annotator")).agg(F.max_by("relevance", F.struct("labelled_at", "relevance")).alias("vote"))


def agreement(ballots: DataFrame, item: tuple[str, ...] = ("query_id", "listing_id")) -> DataFrame:
    """(a, b, n, agree), a < b: how many items two annotators share, and the rate at which they agree."""
    left = ballots.select(*item, F.col("annotator").alias("a"), F.col("vote").alias("x"))
    right = ballots.select(*item, F.col("annotator").alias("b"), F.col("vote").alias("y"))
    both = left.join(right, list(item)).where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agree"))


def reliability(ballots: DataFrame, grades: tuple[int, ...] = (0, 1, 2), item: tuple[str, ...] = ("query_id", "listing_id")) -> DataFrame:
    """(annotator, votes, shared, mean_agreement, accuracy, weight), one row an annotator.

    accuracy is the triplet estimate, kept within 0.02 and 0.98; annotators without a triplet get the median of the
    others, or, if there is none, the middle between chance and certainty.
    """
    k = len(grades)
    pairs = cut_lineage(agreement(ballots, item))
    m = (k * F.col("agree") - 1) / (k - 1)
    edge = pairs.select("a", "b", "n", "agree", m.alias("m"))
    edge = cut_lineage(edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "agree", "m")))
    solid = edge.where(F.col("n") >= SHARED)
    one = solid.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("m").alias("ij"))
    two = solid.select(F.col("a").alias("i"), F.col("b").alias("k"), F.col("m").alias("ik"))
    three = solid.where("m != 0").select(F.col("a").alias("j"), F.col("b").alias("k"), F.col("m").alias("jk"))
    triplets = one.join(two, "i").where("j < k").join(three, ["j", "k"])
    skill = triplets.groupBy(F.col("i").alias("annotator")).agg(F.median(F.col("ij") * F.col("ik") / F.col("jk")).alias("square"))
    met = edge.groupBy(F.col("a").alias("annotator")).agg(F.sum("n").alias("shared"), (F.sum(F.col("n") * F.col("agree")) / F.sum("n")).alias("mean_agreement"), F.sum(F.col("n") * F.col("m")).alias("sign"))
    u = F.when(F.col("square").isNotNull(), F.sqrt(F.greatest("square", F.lit(0.0)))) * F.when(F.col("sign") < 0, -1).otherwise(1)
    known = ballots.groupBy("annotator").agg(F.count("*").alias("votes")).join(met, "annotator", "left").join(skill, "annotator", "left")
    raw = cut_lineage(known.withColumn("raw", F.when(u.isNotNull(), F.least(F.greatest((1 + (k - 1) * u) / k, F.lit(LEAST)), F.lit(MOST)))))
    middle = raw.agg(F.coalesce(F.median("raw"), F.lit((1 + 1 / k) / 2)).alias("middle"))
    told = raw.crossJoin(F.broadcast(middle))  # one row, one number
    accuracy = F.coalesce("raw", "middle")
    return told.select("annotator", "votes", F.coalesce("shared", F.lit(0)).alias("shared"), "mean_agreement", accuracy.alias("accuracy"), F.log((k - 1) * accuracy / (1 - accuracy)).alias("weight"))


def consensus(labels: DataFrame, grades: tuple[int, ...] = (0, 1, 2), item: tuple[str, ...] = ("query_id", "listing_id"), rounds: int = 0) -> DataFrame:
    """(*item, relevance, n_annotators, agreement, confidence): one row an item with a valid label.

    agreement is the share of the item's annotators who voted for the consensus, confidence its probability under the
    weights, at nine decimals, as they are compared.
    """
    keys = list(item)
    ballots = cut_lineage(votes(labels, grades, item))
    trust = reliability(ballots, grades, item).select("annotator", "weight")
    told = F.array(*(F.when(F.col("vote") == g, F.col("weight")).otherwise(0.0) for g in grades))
    scored = ballots.join(bounded_broadcast(cut_lineage(trust)), "annotator").select(*keys, "annotator", "vote", told.alias("w"))

    def shares(scored: DataFrame, prior: list[float]) -> DataFrame:
        total = scored.groupBy(*keys).agg(*(F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(grades))), F.count("*").alias("n"), F.collect_list("vote").alias("given"))
        logs = [F.col(f"s{k}") + F.lit(math.log(max(p, 1e-9))) for k, p in enumerate(prior)]
        top = F.greatest(*logs)
        odds = [F.exp(x - top) for x in logs]
        return total.select(*keys, "n", "given", F.array(*[o / sum(odds[1:], odds[0]) for o in odds]).alias("p"))

    flat = [1 / len(grades)] * len(grades)
    found = cut_lineage(shares(scored, flat))
    for _ in range(rounds):
        voted = ballots.join(found.select(*keys, "p"), keys)
        seen = voted.groupBy("annotator", "vote").agg(*(F.sum(F.col("p")[k]).alias(f"t{k}") for k in range(len(grades))))
        seen = cut_lineage(seen)
        truths = seen.groupBy("annotator").agg(*(F.sum(f"t{k}").alias(f"all{k}") for k in range(len(grades))))
        k_ = float(len(grades))
        chances = F.array(*(F.log((F.col(f"t{k}") + 1) / (F.col(f"all{k}") + k_)) for k in range(len(grades))))
        weights = cut_lineage(seen.join(truths, "annotator").select("annotator", "vote", chances.alias("w")))
        mean = found.agg(*(F.avg(F.col("p")[k]) for k in range(len(grades)))).first()
        prior = [x or p for x, p in zip(mean, flat)]
        found = cut_lineage(shares(ballots.join(bounded_broadcast(weights), ["annotator", "vote"]), prior))
    level = F.transform("p", lambda x: F.round(x, 9))  # so that equal weights, summed in any order, are equal
    best = F.array_position(level, F.array_max(level))
    relevance = F.array(*(F.lit(g) for g in grades))[(best - 1).cast("int")]
    for_it = F.size(F.filter("given", lambda v: v == relevance))
    return found.select(*keys, relevance.alias("relevance"), F.col("n").alias("n_annotators"), (for_it / F.col("n")).alias("agreement"), F.array_max(level).alias("confidence"))
