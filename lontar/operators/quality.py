"""Data quality: deduplication, validation, audits, digests and key-wise writes, as plain relational plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: str | Sequence[str], *order: str) -> DataFrame:
    """One row per key: the last by ``order`` (nulls first). An aggregate with map-side combine, so no window sorts a hot key."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row per value of ``key``: the first by ``order`` (nulls first)."""
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def missing(column: str, kind: str) -> Column:
    """Whether a value is absent: null, the empty text, or the empty list."""
    c = F.col(column)
    return c.isNull() | (F.size(c) == 0) if kind.startswith("array") else c.isNull() | (c == "") if kind == "string" else c.isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """(field, n_missing) of every column, in one aggregate."""
    kinds = dict(df.dtypes)
    one = df.agg(*(F.sum(missing(c, kinds[c]).cast("bigint")).alias(c) for c in df.columns))
    return one.unpivot([], df.columns, "field", "n_missing").select("field", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def surplus_rows(df: DataFrame, *keys: str) -> DataFrame:
    """(surplus): rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def first_failure(gates: Mapping[str, Column]) -> Column:
    """The name of the first gate whose condition holds, null for rows that pass all."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in gates.items()))


def audit(df: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """(reason, n): rows by the first gate they fail; passed rows under "accepted"."""
    return df.groupBy(F.coalesce(first_failure(gates), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def digest(df: DataFrame, line: Column) -> DataFrame:
    """(n, digest): a SHA-256 of the sorted lines of all rows, whatever their order.

    Each partition's rows are hashed into buckets by their own hash, sorted there, and the buckets' hashes hashed in order:
    the same rows give the same digest, and no task holds more than one bucket.
    """
    hashed = df.select(F.sha2(F.coalesce(line, F.lit("None")), 256).alias("h"))
    buckets = hashed.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return buckets.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x.h), "\n"), 256).alias("digest"))


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``target`` with the rows of the same key replaced and new keys added; nothing is deleted. ``rows`` must have one row a key."""
    return target.join(rows.select(key), key, "left_anti").unionByName(rows)


def replace_group(target: DataFrame, rows: DataFrame, column: str, value: object) -> DataFrame:
    """``target`` with all rows of one group replaced by ``rows``, others untouched."""
    return target.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(rows)


def truncate_plan(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(current, kept, removed, added): what replacing ``target`` by ``rows`` would do."""
    a, b = target.select(key).distinct().withColumn("a", F.lit(1)), rows.select(key).distinct().withColumn("b", F.lit(1))
    both = a.join(b, key, "full")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return both.agg(n(F.col("a").isNotNull()).alias("current"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"), n(F.col("b").isNull()).alias("removed"), n(F.col("a").isNull()).alias("added"))


def refuse_empty(rows: DataFrame) -> DataFrame:
    """``rows``, if there are any; a full replacement by nothing is an error."""
    if rows.isEmpty():
        raise ValueError("refusing to replace a table by no rows")
    return rows


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n): equal-width bins 0..bins-1 between the least and greatest value, which belongs to the last bin."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    placed = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return placed.groupBy(F.when(F.col("hi") > F.col("lo"), F.least(x, F.lit(bins - 1))).otherwise(0).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of a column, exactly."""
    c = F.col(column).cast("double")
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).alias("most")).select("n", "mean", "std", "least", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "most")


def trailing_count(events: DataFrame, client: str, ts: str, seconds: int) -> DataFrame:
    """Each event with the number of the client's events in the trailing window, itself included."""
    order = W.partitionBy(client).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(order))
