"""The engine's surface: search, details, statistics, traces and evaluation over one folder of tables, all lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.functions.pipeline import PipelineConfig, process
from lontar.operators import metrics as M
from lontar.operators import quality as Q
from lontar.operators import ranking as R
from lontar.operators import search as S
from lontar.runtime import table

MODELS = ("smart", "bm25", "tfidf", "dense", "hybrid")
#: Hits that are fetched for every result wanted when a filter will drop some: it bounds the candidates, by definition.
OVERSHOOT = 3


class Engine:
    """Queries over the tables listings, gazetteer, queries and relevance_labels of ``folder``.

    ``vectors`` (doc_id, vector) and ``encode``, which maps queries (query_id, query_text) to (query_id, vector), enable
    the dense and hybrid models; without them these are not available.
    """

    def __init__(self, spark: SparkSession, folder: str, vectors: DataFrame | None = None, encode=None, config: PipelineConfig | None = None) -> None:
        self.spark, self.folder, self.vectors, self.encode = spark, folder, vectors, encode
        self.config = config or PipelineConfig(stem=False)

    def listings(self) -> DataFrame:
        """The last scrape of every listing."""
        return Q.keep_last(table(self.spark, self.folder, "listings"), "id", "inserted_at", "scrape_date", "harga_per_bulan", "batch_id")

    def _words(self, text: Column) -> Column:
        return process(text, self.config)["tokens"]

    def corpus(self) -> DataFrame:
        """(doc_id, tokens) of every listing, fields weighted by repetition."""
        return self.listings().select(F.col("id").alias("doc_id"), self._words(X.compose_lexical("judul", "kecamatan", "fasilitas", "deskripsi")).alias("tokens"))

    def rank(self, queries: DataFrame, model: str = "smart", k: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank) of queries (query_id, query_text) by one of ``MODELS``."""
        if model not in MODELS:
            raise ValueError(f"no model {model!r}; there are {', '.join(MODELS)}")
        if model == "smart":
            return S.smart_rank(queries, self.listings(), table(self.spark, self.folder, "gazetteer"), k, preprocess=self._words)
        asked = queries.select("query_id", self._words(F.col("query_text")).alias("tokens"))
        if model in ("bm25", "tfidf"):
            return (R.bm25 if model == "bm25" else R.tfidf)(self.corpus(), asked, k)
        if self.vectors is None or self.encode is None:
            raise LookupError("this engine has no vectors: give it vectors and an encoder")
        neural = R.dense(self.vectors, self.encode(queries), k if model == "dense" else None)
        return neural if model == "dense" else R.hybrid(R.bm25(self.corpus(), asked, None), neural, k)

    def search(self, queries: DataFrame, model: str = "smart", k: int = 10, where: Column | None = None) -> DataFrame:
        """Ranked listings with their columns; at most ``k`` of 1 to 50 a query. A filter is applied after ranking."""
        if not 1 <= k <= 50:
            raise ValueError("k must be between 1 and 50")
        hits = self.rank(queries, model, k * OVERSHOOT if where is not None and model != "smart" else k)
        return S.search(hits, self.listings(), k, where)

    def get(self, id_: str) -> DataFrame:
        """The row of one listing; none if there is no such id."""
        return Q.keep_last(table(self.spark, self.folder, "listings").where(F.col("id") == id_), "id", "inserted_at", "scrape_date", "harga_per_bulan", "batch_id")

    def statistics(self) -> DataFrame:
        """Listings and prices per sub-district and type; null and empty values count under "?"."""
        label = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("?")).alias(c)
        return self.listings().groupBy(label("kecamatan"), label("tipe")).agg(F.count("*").alias("n"), F.min("harga_per_bulan").alias("least"), F.max("harga_per_bulan").alias("most"), F.avg("harga_per_bulan").cast("bigint").alias("mean"))

    def status(self) -> DataFrame:
        """(name, n): rows of the engine's tables."""
        counts = [table(self.spark, self.folder, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("listings", "gazetteer", "queries", "relevance_labels")]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out

    def trace(self, texts: DataFrame, column: str = "text") -> DataFrame:
        """``texts`` with what each stage of the pipeline makes of ``column``."""
        return texts.withColumn("trace", process(column, PipelineConfig(), trace=True)["trace"])

    def judged(self) -> DataFrame:
        return M.majority_vote(M.last_votes(table(self.spark, self.folder, "relevance_labels")))

    def evaluate(self, models: tuple[str, ...] = ("smart", "bm25", "tfidf"), k: int = 10) -> DataFrame:
        """(model, query_id, metrics ...) of all queries of the folder."""
        queries, out = table(self.spark, self.folder, "queries").select(F.col("id").alias("query_id"), "query_text"), None
        for m in models:
            one = self.rank(queries, m, k).select(F.lit(m).alias("model"), "query_id", "doc_id", "rank")
            out = one if out is None else out.unionByName(one)
        return M.ranking_metrics(out, self.judged())

    def sheet(self, rankings: DataFrame, seed: int = 42) -> DataFrame:
        """An annotation sheet: the union of rankings' documents of each query, in an order that depends on the seed alone."""
        pool = rankings.select("query_id", "doc_id").distinct()
        rows = self.listings().select(F.col("id").alias("doc_id"), "judul", "tipe", "harga_per_bulan", "kecamatan", F.coalesce(F.array_join(F.slice("fasilitas", 1, 8), ", "), F.lit("")).alias("fasilitas"), F.substring(F.regexp_replace(F.coalesce("deskripsi", F.lit("")), "[\r\n]", " "), 1, 400).alias("deskripsi"))
        return pool.join(rows, "doc_id").withColumn("place", F.xxhash64("doc_id", F.lit(seed))).orderBy("query_id", "place", "doc_id").drop("place")
