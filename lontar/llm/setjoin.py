"""Prefix-filter set-similarity join (exact Jaccard), on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.runtime import bounded_broadcast, cut_lineage


def grams(text: Column, q: int = 2) -> Column:
    """The q-grams of a text between two boundary marks, as a set: the second occurrence of a gram is another token."""
    padded = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - q + 1, F.lit(1))), lambda i: F.substring(padded, i, q))
    # an array of one holds the grams, so that they are cut once and not again for each of them
    return F.transform(F.array(cut), lambda c: F.transform(c, lambda g, i: F.concat(g, F.size(F.filter(F.slice(c, F.lit(1), i + 1), lambda h: h == g)).cast("string"))))[0]


def prefix_filter_join(left: DataFrame, right: DataFrame, least: float, may: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(l, r, jaccard) of all pairs with Jaccard similarity of at least ``least``, or of those whose sizes ``may`` allows.

    ``left`` (l, tokens) and ``right`` (r, tokens) hold token sets under unique keys. Tokens are ordered by global
    rarity. Two sets that similar share one of the first ``|x| - ceil(least |x|) + 1`` tokens of each, so only these
    rare prefixes are joined; the length filter and the positional filter (how much overlap can still follow the first
    shared token) drop most candidates before the exact count. Empty sets match nothing.
    """
    exploded = [df.select(key, F.explode("tokens").alias("token")) for df, key in ((left, "l"), (right, "r"))]
    rarity = cut_lineage(exploded[0].select("token").unionAll(exploded[1].select("token")).groupBy("token").agg(F.count("*").alias("n")))

    def ordered(df: DataFrame, key: str) -> DataFrame:
        ranked = df.join(bounded_broadcast(rarity), "token")
        sets = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))
        return sets.select(key, F.transform("ranked", lambda x: x.token).alias(f"{key}_tokens"), F.size("ranked").alias(f"{key}_size"))

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        size = F.col(f"{key}_size")
        return df.select(key, f"{key}_size", F.posexplode(F.slice(f"{key}_tokens", F.lit(1), size - F.ceil(size * least - 1e-9).cast("int") + 1)).alias(f"{key}_at", "token"))

    sets = [cut_lineage(ordered(df, key)) for df, key in zip(exploded, "lr")]
    short, long = F.least("l_size", "r_size"), F.greatest("l_size", "r_size")
    met = prefixes(sets[0], "l").join(bounded_broadcast(cut_lineage(prefixes(sets[1], "r"))), "token").where(short >= least * long - 1e-9)
    met = met.where(may(F.col("l_size"), F.col("r_size"))) if may else met
    # the two places as one number, which is aggregated without a sort
    at = F.shiftleft(F.col("l_at").cast("bigint"), 32) + F.col("r_at")
    first = met.groupBy("l", "r", "l_size", "r_size").agg(F.min(at).alias("at")).withColumns({"l_at": F.shiftright("at", 32), "r_at": F.col("at").bitwiseAND((1 << 32) - 1)})
    needed = F.ceil(least / (1 + least) * (F.col("l_size") + F.col("r_size")) - 1e-9)
    possible = 1 + F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at")) - 1
    pairs = first.where(possible >= needed).select("l", "r")
    both = pairs.join(sets[0], "l").join(bounded_broadcast(sets[1]), "r")
    shared = F.size(F.array_intersect("l_tokens", "r_tokens"))
    return both.select("l", "r", (shared / (F.col("l_size") + F.col("r_size") - shared)).alias("jaccard")).where(F.col("jaccard") >= least - 1e-9)
