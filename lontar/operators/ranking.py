"""Rankers: BM25, TF-IDF cosine, dense cosine and their fusion, for a batch of queries against a corpus.

Statistics of the corpus (document frequencies, lengths) are aggregates in the JVM. Scoring is map-side: the queries of a
block (``BLOCK`` at most) go to every task as a matrix over their own terms, each Arrow batch of documents becomes a
matrix over the same terms, and a product gives all scores. A task keeps the best k of each query, so that a query moves
k rows per task, whatever share of the corpus its words hit; joining postings would move a row for every hit.

Scores are compared at six decimals, ties go to the smaller document id, so ranks do not depend on the order of sums.
Null texts are empty documents; a query without known words scores 0 everywhere and still gets k documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lontar.runtime import bounded_broadcast

#: Queries that are scored together.
BLOCK = 2048
ROWS = 2000
DIGITS = 6


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query: rounded score first, smaller id among equals."""
    s = np.round(scores, DIGITS)
    if len(s) > k:
        edge = np.partition(s, len(s) - k)[len(s) - k]
        pool = np.nonzero(s >= edge)[0]
    else:
        pool = np.arange(len(s))
    return pool[np.lexsort((ids[pool], -s[pool]))][:k]


def top_ranks(hits: DataFrame, k: int | None) -> DataFrame:
    """(query_id, doc_id, score, rank) of hits (query_id, doc_id, score), ranked within each query."""
    order = W.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), F.col("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def score_blocks(docs: DataFrame, query_ids: list, scorer: Callable, k: int | None) -> DataFrame:
    """Ranks documents (doc_id, and what the scorer reads) for queries in blocks.

    ``scorer(block)`` makes, on the driver, a function from an Arrow batch to the matrix documents x queries of a block.
    """
    kind = dict(docs.dtypes)["doc_id"]
    out = None
    for at in range(0, len(query_ids), BLOCK):
        names = query_ids[at : at + BLOCK]
        told = names, scorer(range(at, at + len(names)))  # Spark broadcasts a large closure by itself

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            names, score = told
            kept = [(np.zeros(0), np.zeros(0, dtype=object))] * len(names)
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    b = whole.slice(start, ROWS)
                    ids, s = b.column("doc_id").to_numpy(zero_copy_only=False), np.ascontiguousarray(score(b).T)
                    for q in range(len(names)):
                        a, i = kept[q]
                        may = np.arange(len(ids))
                        if k and len(a) >= k and not np.isnan(a[-1]):  # only what takes a place: more than the last, or as much and a smaller id
                            may = np.nonzero(s[q] > a[-1] - 2 * 10.0**-DIGITS)[0]
                            ahead, last = np.round(s[q][may], DIGITS), np.round(a[-1], DIGITS)
                            equal = np.nonzero(ahead == last)[0]
                            ahead = ahead > last
                            ahead[equal] = ids[may[equal]] < i[-1]
                            may = may[ahead]
                        if len(may):
                            a, i = np.concatenate([a, s[q][may]]), np.concatenate([i, ids[may]])
                            top = slice(None) if k is None else best(a, i, k)
                            kept[q] = (a[top], i[top])
            q = np.repeat(np.arange(len(names)), [len(a) for a, _ in kept])
            frame = pd.DataFrame({"query_id": [names[x] for x in q], "doc_id": np.concatenate([i for _, i in kept]) if len(kept) else [], "score": np.concatenate([a for a, _ in kept]) if len(kept) else []})
            yield from pa.Table.from_pandas(frame, preserve_index=False, schema=pa.schema([("query_id", pa.string()), ("doc_id", whole_type), ("score", pa.float64())])).to_batches()

        whole_type = pa.int64() if kind == "bigint" else pa.string()
        hits = docs.mapInArrow(run, f"query_id string, doc_id {kind}, score double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"query_id string, doc_id {kind}, score double, rank int")
    return top_ranks(out, k)


def _term_matrix(b: pa.RecordBatch, column: str, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts (documents x vocabulary) and the number of all tokens of each document."""
    lists = b.column(column)
    lengths = np.diff(lists.offsets.to_numpy())
    at = pc.index_in(lists.flatten(), value_set=vocabulary)
    hit = at.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)[hit]
    flat = row * len(vocabulary) + at.drop_null().to_numpy()
    return np.bincount(flat, minlength=len(lengths) * len(vocabulary)).reshape(len(lengths), len(vocabulary)).astype(float), lengths


def document_frequencies(docs: DataFrame, column: str = "tokens") -> DataFrame:
    """(term, df, n): in how many documents (doc_id, ``column``) a term is, and how often in all. One
    aggregate with map-side combine counts both, so no document is shuffled."""
    once = F.transform(F.array_distinct(column), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t")))
    each = F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t")))
    return docs.select(F.explode(F.concat(once, each)).alias("m")).groupBy("m.term").agg(F.sum("m.d").alias("df"), F.sum("m.t").alias("n"))


def bm25_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The BM25 statistics of documents (doc_id, tokens): terms (term, df, idf), and one row (n, avgdl).

    A negative idf, of a term in more than half of the documents, becomes a quarter of the mean raw idf.
    """
    spread = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    one = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    raw = spread.crossJoin(F.broadcast(one)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), one


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = 1.5, b: float = 0.75, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 (Okapi) of documents (doc_id, tokens) for queries (query_id, tokens).

    Repeated words of a query count again. ``index`` takes ready statistics, as of a saved index or of a larger corpus.
    """
    terms, one = index or bm25_index(docs)
    asked = queries.select("query_id", "tokens").toPandas()  # a query set
    words = queries.select(F.explode("tokens").alias("term")).distinct()
    known = terms.join(F.broadcast(words), "term").select("term", "idf").toPandas().sort_values("term")
    told = one.first()
    average = float(told["avgdl"] or 0) or 1.0
    vocabulary, idf = pa.array(known["term"], pa.string()), known["idf"].to_numpy(dtype=float)
    place = {t: i for i, t in enumerate(known["term"])}
    wanted = np.zeros((len(place), len(asked)))
    for q, tokens in enumerate(asked["tokens"]):
        for t in tokens:
            if t in place:
                wanted[place[t], q] += 1

    def scorer(block: range) -> Callable:
        part = wanted[:, block.start : block.stop]

        def score(batch: pa.RecordBatch) -> np.ndarray:
            tf, length = _term_matrix(batch, "tokens", vocabulary)
            weight = idf * tf * (k1 + 1) / (tf + (k1 * (1 - b + b * length / average))[:, None])
            return weight @ part

        return score

    clean = docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    return score_blocks(clean, list(asked["query_id"]), scorer, k)


def bm25_pairs(docs: DataFrame, queries: DataFrame, pairs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score): BM25 of the pairs (query_id, doc_id) alone, with the statistics of all documents.

    Documents and queries are those of ``bm25``; a pair without a common word scores 0, one whose query or document does
    not exist is left out. The work is in proportion to the documents and the pairs, not to documents times queries.
    """
    terms, one = bm25_index(docs)
    pool = pairs.select("query_id", "doc_id").distinct().join(queries.select("query_id").distinct(), "query_id", "left_semi")
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    known = bounded_broadcast(terms.join(F.broadcast(asked.select("term").distinct()), "term").select("term", "idf"))  # words of a query set
    pooled = docs.join(pool.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "tokens")
    told = pooled.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(known, "term").groupBy("doc_id", "dl", "term", "idf").agg(F.count("*").alias("tf"))
    met = pool.join(asked, "query_id").join(told, ["doc_id", "term"]).crossJoin(F.broadcast(one))  # one row
    weight = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    zeros = pool.join(pooled.select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", F.lit(0.0).alias("w"))
    return met.select("query_id", "doc_id", weight.alias("w")).unionByName(zeros).groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))


def one_and_two_grams(tokens):
    """Single tokens, and neighbours joined by a blank."""
    last = F.size(tokens) - 1
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(2)), " "))
    return F.concat(tokens, F.when(last >= 1, pairs).otherwise(F.array().cast("array<string>")))


def tfidf_index(docs: DataFrame, min_df: int = 2, max_features: int = 10_000) -> DataFrame:
    """(term, df, idf) of the features of documents (doc_id, tokens): one- and two-word terms in at least ``min_df``
    documents, the most frequent ``max_features`` of them, the first by code point among equals."""
    grams = docs.select("doc_id", one_and_two_grams(F.col("tokens")).alias("grams"))
    total = docs.agg(F.count("*").alias("all"))
    ranked = document_frequencies(grams, "grams").where(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(max_features)
    return ranked.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("all")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, queries: DataFrame, k: int | None = 10, index: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): cosine of sublinear TF-IDF vectors of documents and queries (id, tokens)."""
    features = (index or tfidf_index(docs)).select("term", "idf").toPandas().sort_values("term")  # max_features at most
    vocabulary, idf = pa.array(features["term"], pa.string()), features["idf"].to_numpy(dtype=float)
    asked = queries.select("query_id", one_and_two_grams(F.col("tokens")).alias("grams")).toPandas()
    place = {t: i for i, t in enumerate(features["term"])}
    wanted = np.zeros((len(place), len(asked)))
    for q, grams in enumerate(asked["grams"]):
        for g in grams:
            if g in place:
                wanted[place[g], q] += 1
    np.log(wanted, out=wanted, where=wanted > 0)
    for q, grams in enumerate(asked["grams"]):
        for g in {g for g in grams if g in place}:
            wanted[place[g], q] += 1
    wanted *= idf[:, None]
    norm = np.sqrt((wanted**2).sum(axis=0))
    wanted /= np.where(norm > 0, norm, 1)

    def scorer(block: range) -> Callable:
        part = wanted[:, block.start : block.stop]
        used = np.nonzero(part.any(axis=1))[0]
        slot = np.full(len(idf), -1)
        slot[used] = np.arange(len(used))
        part = part[used]

        def score(batch: pa.RecordBatch) -> np.ndarray:
            lists = batch.column("grams")
            lengths = np.diff(lists.offsets.to_numpy())
            at = pc.index_in(lists.flatten(), value_set=vocabulary)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            flat, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths)[hit] * len(idf) + at.drop_null().to_numpy(), return_counts=True)
            row, term = flat // max(len(idf), 1), flat % max(len(idf), 1)
            w = (1 + np.log(tf)) * idf[term]
            norm = np.sqrt(np.bincount(row, w**2, minlength=len(lengths)))
            ours = slot[term] >= 0
            m = np.zeros((len(lengths), len(used)))
            m[row[ours], slot[term[ours]]] = w[ours]
            return (m @ part) / np.where(norm > 0, norm, 1)[:, None]

        return score

    return score_blocks(docs.select("doc_id", one_and_two_grams(F.col("tokens")).alias("grams")), list(asked["query_id"]), scorer, k)


def dense(docs: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): inner product of normalised vectors (id, vector); exhaustive, in blocks.

    A vector of length 0 stays as it is. Null vectors score 0. The query vectors of one block at a time are in memory.
    """
    ids = [r[0] for r in queries.select("query_id").orderBy("query_id").collect()]
    vectors = queries.orderBy("query_id").select("vector").toPandas()["vector"]
    matrix = np.array([np.asarray(v, dtype=float) for v in vectors]) if len(ids) else np.zeros((0, 0))
    norm = np.sqrt((matrix**2).sum(axis=1, keepdims=True)) if len(ids) else 1
    matrix = matrix / np.where(norm > 0, norm, 1) if len(ids) else matrix

    def scorer(block: range) -> Callable:
        part = matrix[block.start : block.stop].T

        def score(batch: pa.RecordBatch) -> np.ndarray:
            lists = batch.column("vector")
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(there.sum()), part.shape[0])
            n = np.sqrt((flat**2).sum(axis=1, keepdims=True))
            out = np.zeros((len(lists), part.shape[1]))
            out[there] = (flat / np.where(n > 0, n, 1)) @ part
            return out

        return score

    return score_blocks(docs.select("doc_id", "vector"), ids, scorer, k)


def min_max(scores: DataFrame, column: str, by: str = "query_id"):
    """``column`` scaled to 0..1 within each query; all 0 where its range is under 1e-9."""
    w = W.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high - low < 1e-9, 0.0).otherwise((F.col(column) - low) / (high - low))


def hybrid(lexical: DataFrame, neural: DataFrame, k: int | None = 10, alpha: float = 0.9) -> DataFrame:
    """(query_id, doc_id, score, rank): alpha times the scaled lexical score plus the rest of the scaled dense one.

    The candidates are the lexical hits given (query_id, doc_id, score); a missing dense score counts as 0.
    """
    both = lexical.select("query_id", "doc_id", F.col("score").alias("l")).join(neural.select("query_id", "doc_id", F.col("score").alias("d")), ["query_id", "doc_id"], "left").na.fill(0.0, ["d"])
    scaled = both.withColumn("ls", min_max(both, "l")).withColumn("ds", min_max(both, "d"))
    return top_ranks(scaled.select("query_id", "doc_id", (alpha * F.col("ls") + (1 - alpha) * F.col("ds")).alias("score")), k)


def rank_pool(hits: DataFrame, pool: DataFrame) -> DataFrame:
    """Ranks within the judged pool (query_id, doc_id) of full-corpus hits: statistics stay those of the whole corpus."""
    return top_ranks(hits.select("query_id", "doc_id", "score").join(pool.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi"), None)


def popularity_blend(hits: DataFrame, views: DataFrame, weight: float = 0.2) -> DataFrame:
    """Scores blended with log(1 + views) over the query's greatest; documents without views count 0."""
    joined = hits.join(views.select("doc_id", F.log1p("views").alias("v")), "doc_id", "left").na.fill(0.0, ["v"])
    most = F.max("v").over(W.partitionBy("query_id"))
    return joined.select("query_id", "doc_id", ((1 - weight) * F.col("score") + weight * F.when(most > 0, F.col("v") / most).otherwise(0.0)).alias("score"))


def save_index(index: tuple[DataFrame, ...], path: str) -> None:
    """The parts of an index as Parquet folders under ``path``."""
    for n, part in enumerate(index):
        part.write.mode("overwrite").parquet(f"{path}/part{n}")


def load_index(spark, path: str, parts: int) -> tuple[DataFrame, ...]:
    """The parts of a saved index."""
    return tuple(spark.read.parquet(f"{path}/part{n}") for n in range(parts))

