"""Writers. Each states what it replaces; none reads what it is overwriting after it began to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.operators import quality as Q
from lontar.runtime import cut_lineage
from lontar.sources.readers import new_rows


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # nothing was written there yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, characters beyond ASCII as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_corpus(rows: DataFrame, path: str, *, id: str = "id", text: str = "text") -> None:
    """The corpus as JSON lines {id, text, metadata}: whatever else a row has goes into metadata. Null ids are left out."""
    rest = [c for c in rows.columns if c not in (id, text)]
    meta = F.struct(*rest) if rest else F.create_map().cast("map<string,string>")
    write_jsonl(rows.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"), meta.alias("metadata")), path)


def upsert(rows: DataFrame, path: str, key: str = "id", *order: str) -> int:
    """Replaces rows of the same key (the last by ``order`` of repeated ones), adds new ones, deletes none; returns how many."""
    fresh = cut_lineage(Q.keep_last(rows, key, *order) if order else rows.dropDuplicates([key]))
    n = fresh.count()
    if n:
        old = _read(rows.sparkSession, path)
        merged = fresh if old is None else cut_lineage(Q.upsert(old, fresh.select(*old.columns), key))
        merged.write.mode("overwrite").parquet(path)
    return n


def reseed(rows: DataFrame, path: str) -> None:
    """Replaces the whole table; refuses no rows."""
    Q.refuse_empty(rows).write.mode("overwrite").parquet(path)


def sync(rows: DataFrame, path: str, line) -> bool:
    """Reseeds only if the number of rows or the digest of their lines differs; returns whether it wrote."""
    old = _read(rows.sparkSession, path)
    if old is not None and Q.digest(old, line).first() == Q.digest(rows, line).first():
        return False
    reseed(cut_lineage(rows), path)
    return True


def replace_model(rows: DataFrame, path: str, model: str) -> None:
    """Replaces one model's rows of a table partitioned by model; others stay where they are."""
    rows.where(rows["model"] == model).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def append_new(rows: DataFrame, path: str, key: str = "url_source") -> int:
    """Appends the rows whose key is not there yet; returns how many."""
    old = _read(rows.sparkSession, path)
    fresh = cut_lineage(rows if old is None else new_rows(rows, old, key))
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n
