"""Readers of the semi-structured inputs. Schemas are declared, never inferred; every reader is a lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = (
    "id string, judul string, deskripsi string, harga_per_bulan bigint, tipe string, fasilitas array<string>, alamat string, kecamatan string, "
    "koordinat array<double>, jarak_kampus_km double, url_source string, scrape_date string, source string"
)
QUERY_SET = ("metadata map<string,string>, queries array<struct<id string, query string, context string, expected_tipe string>>")
CORPUS = ("id string, text string, raw_text string, metadata struct<judul string, harga_per_bulan bigint, tipe string, fasilitas array<string>, alamat string, kecamatan string, jarak_kampus_km double, extracted_prices array<bigint>>")
PLACES = ("name string, lat double, lng double, aliases array<string>, source string")


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON lines, blank ones left out, with ``corrupt``: the line itself where it is no JSON object, else null."""
    marked = f"{schema}, corrupt string"
    filled = lines.where(F.trim(column) != "")
    return filled.select(F.from_json(column, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r")).select("r.*")


def tolerant_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The rows of JSON lines; blank and malformed lines are dropped."""
    return parse_lines(lines, schema, column).where("corrupt is null").drop("corrupt")


def read_jsonl(spark: SparkSession, path: str, schema: str = LISTING, strict: bool = False) -> DataFrame:
    """JSON lines; ``strict`` fails on a malformed one, else it is dropped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return tolerant_lines(spark.read.text(path), schema)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file, one JSON array; raw_text falls back to text, metadata may be missing."""
    rows = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    return rows.withColumn("raw_text", F.coalesce("raw_text", "text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_text, context, expected_tipe) of a query set file."""
    rows = spark.read.schema(QUERY_SET).option("multiLine", True).json(path)
    return rows.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), F.col("q.query").alias("query_text"), "q.context", "q.expected_tipe")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer file, one JSON array."""
    return spark.read.schema(PLACES).option("multiLine", True).json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of a CSV file; of a repeated pair, the last row of the file counts."""
    rows = spark.read.schema("query_id string, doc_id string, relevance int").option("header", True).csv(path)
    at = rows.withColumn("at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return at.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "at").alias("relevance"))


def read_annotation_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The valid labels (query_id, doc_id, relevance) of a sheet, and one row (skipped) of how many were not 0, 1 or 2.

    A byte order mark before the header is ignored.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    good = F.trim("relevance").isin("0", "1", "2")
    valid = rows.where(good).select("query_id", "doc_id", F.trim("relevance").cast("int").alias("relevance"))
    return valid, rows.agg(F.sum((~F.coalesce(good, F.lit(False))).cast("bigint")).alias("skipped"))


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id) of a file that maps queries to lists of document ids."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id"))


def read_urls(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(url): the lines of a list but blanks and # comments, at most ``most`` of them (a feature of the list)."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")
    return lines if most is None else lines.limit(most)


def unpivot_models(wide: DataFrame, prefix: str = "cs_at_5_") -> DataFrame:
    """(model, mean) of a wide table with a column per model."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot([], [F.col(c).cast("double").alias(c[len(prefix) :]) for c in columns], "model", "value")
    return long.groupBy("model").agg(F.avg("value").alias("mean"))


def read_significance(spark: SparkSession, path: str) -> DataFrame:
    """A table of tests: numbers, empty as null, yes as true."""
    rows = spark.read.option("header", True).csv(path)
    number = lambda c: F.nullif(F.col(c), F.lit("")).try_cast("double").alias(c)
    flags = [c for c in rows.columns if c.startswith("significant")]
    return rows.select("pair", *(number(c) for c in rows.columns if c not in ("pair", *flags)), *((F.col(c) == "yes").alias(c) for c in flags))


def to_listing(raw: DataFrame) -> DataFrame:
    """Raw rows in the table's shape: two coordinates or none, ISO dates or null, no facilities as the empty list, source
    "unknown" by default."""
    pair = F.size("koordinat") == 2
    return raw.select(
        "id", "judul", "deskripsi", "harga_per_bulan", "tipe", F.coalesce("fasilitas", F.array().cast("array<string>")).alias("fasilitas"), "alamat", "kecamatan",
        F.when(pair, F.get("koordinat", 0)).alias("koordinat_lat"), F.when(pair, F.get("koordinat", 1)).alias("koordinat_lng"), "jarak_kampus_km", "url_source",
        F.try_to_date("scrape_date", "yyyy-MM-dd").alias("scrape_date"), F.coalesce("source", F.lit("unknown")).alias("source"),
    )


def flatten_corpus(corpus: DataFrame) -> DataFrame:
    """Corpus items with their metadata as columns."""
    return corpus.select("id", "text", F.coalesce("raw_text", "text").alias("raw_text"), "metadata.*")


def new_rows(rows: DataFrame, seen: DataFrame, key: str = "url_source") -> DataFrame:
    """The rows whose key was not written before; rows without a key are new. For an append that can be resumed."""
    return rows.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*rows.columns)
