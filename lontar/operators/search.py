"""Query understanding and constraint-aware ranking of listings, for a batch of queries in one plan.

``parse_queries`` reads tenants, facilities, prices and an anchor place out of free text; ``smart_rank`` unites text and
distance candidates, applies hard constraints with staged relaxation, and fuses text, distance and facilities. Decisions
about a whole query (does any candidate survive, is there any text signal) are windowed aggregates, never a driver loop.
The queries are a small set; listings may be many, and pass through map-side scoring and one join with the candidates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.functions import vocabulary as V
from lontar.operators import ranking as R
from lontar.operators.spatial import haversine_km, usable, within_radius

# Weights of text, distance and facilities; candidates a result; radius of the distance candidates.
WEIGHTS = (0.2, 0.4, 0.4)
OVERSHOOT = 5
RADIUS_KM = 3.0
CHEAP = 1_000_000
FUZZY_ALIAS, FUZZY_TOKEN, FUZZY_RATIO = 5, 4, 0.84


def _word(text: Column, word: str) -> Column:
    return text.rlike(rf"\b{re.escape(word)}\b")


def aliases(gazetteer: DataFrame) -> DataFrame:
    """(alias, name, lat, lng): every name and alias of a place with a usable position, in lower case."""
    good = gazetteer.where(usable(F.col("lat"), F.col("lng")))
    return good.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), "name", "lat", "lng").select(F.lower("alias").alias("alias"), "name", "lat", "lng").where("alias <> ''").distinct()


def _trie(words: list[str]) -> str:
    """A pattern of the longest of ``words`` at a position, by shared beginnings."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        ways = [re.escape(c) + write(n) for c, n in sorted(node.items()) if c]
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return one + ("?" if "" in node else "")

    return write(root)


def mention_counts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(name, n): how many rows of ``texts`` (text) contain the name or any alias of a place (name, aliases), anywhere and
    in any letter case. A row counts once for a name; an alias that several places share counts for each of them.

    The forms (a reference list) go to every task as one trie; it is tried at every position, and a form that it finds
    brings along the forms that begin it. So a text is read once, however many places there are, and no text is shuffled.
    """
    forms = places.where(F.col("name").isNotNull()).select(F.lower("name").alias("name"), F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("form"))
    owners: dict[str, set[str]] = {}
    for r in forms.select("name", F.lower("form").alias("form")).where("form <> ''").distinct().collect():
        owners.setdefault(r["form"], set()).add(r["name"])
    meant = {f: frozenset().union(*(owners.get(f[:n], ()) for n in range(1, len(f) + 1))) for f in owners}
    pattern = f"(?=({_trie(sorted(owners))}))" if owners else r"(?!)()"
    shared = texts.sparkSession.sparkContext.broadcast((pattern, meant))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern, meant = shared.value
        find = re.compile(pattern).findall
        for pdf in batches:
            n = Counter()
            for text in pdf["text"]:
                n.update(set().union(*(meant[f] for f in set(find(text)))))
            yield pd.DataFrame({"name": list(n.keys()), "n": list(n.values())}).astype({"n": "int64"})

    low = texts.where(F.col("text").isNotNull()).select(F.lower("text").alias("text"))
    return low.mapInPandas(run, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))


def anchors(queries: DataFrame, gazetteer: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(query_id, anchor, anchor_lat, anchor_lng): the place a query names, by its longest alias between blanks; the place
    first by name among equals. Else, with ``fuzzy``, the best match of a word to a one-word alias by the ratio of
    matching blocks, over 0.84. Queries that name no place have no row."""
    known = aliases(gazetteer)
    low = queries.select("query_id", F.concat(F.lit(" "), F.lower("query_text"), F.lit(" ")).alias("low"))
    best = F.min(F.struct((-F.length("alias")).alias("n"), F.col("name").alias("anchor"), F.col("lat").alias("anchor_lat"), F.col("lng").alias("anchor_lng"))).alias("m")
    exact = low.join(known, F.contains("low", F.concat(F.lit(" "), F.col("alias"), F.lit(" ")))).groupBy("query_id").agg(best).select("query_id", "m.anchor", "m.anchor_lat", "m.anchor_lng")
    if not fuzzy:
        return exact

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    words = low.join(exact, "query_id", "left_anti").select("query_id", F.explode(F.regexp_extract_all("low", F.lit("[a-z]+"), F.lit(0))).alias("word")).where(F.length("word") >= FUZZY_TOKEN)
    single = known.where(~F.contains("alias", F.lit(" ")) & (F.length("alias") >= FUZZY_ALIAS))
    # a ratio over 0.84 bounds the lengths, which makes this an equi-join on the length with a small fan-out
    near = words.withColumn("n", F.explode(F.sequence(F.ceil(F.length("word") * 0.72).cast("int"), F.floor(F.length("word") * 1.39).cast("int")))).join(single.withColumn("n", F.length("alias")), "n")
    scored = near.withColumn("ratio", F.pandas_udf(ratio, "double")("word", "alias")).where(F.col("ratio") > FUZZY_RATIO)
    close = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("ratio")).alias("r"), F.col("name").alias("anchor"), F.col("lat").alias("anchor_lat"), F.col("lng").alias("anchor_lng"))).alias("m"))
    return exact.unionByName(close.select("query_id", "m.anchor", "m.anchor_lat", "m.anchor_lng"))


def parse_queries(queries: DataFrame, gazetteer: DataFrame, genders: Mapping[str, str] = V.GENDER_WORDS, facilities: Mapping[str, str] = V.QUERY_FACILITIES, fuzzy: bool = True) -> DataFrame:
    """Queries (query_id, query_text) with gender, facilities, price_max, anchor, anchor_lat, anchor_lng and residual.

    Conflicting tenant words give no gender; the price is the greatest named, else a million for "murah"; the residual
    is the text without the understood words and numbers, in which a place's name stays. A null text is understood as
    nothing.
    """
    low = F.concat(F.lit(" "), F.lower(F.coalesce("query_text", F.lit(""))), F.lit(" "))
    kinds = F.array_distinct(F.array_compact(F.array(*(F.when(_word(low, w), kind) for w, kind in genders.items()))))
    order = sorted(facilities, key=len, reverse=True)
    found = F.array_distinct(F.array_compact(F.array(*(F.when(_word(low, w), facilities[w]) for w in order))))
    prices = X.extract_prices(low)
    residual = low
    for w in [*genders, *order]:
        residual = F.regexp_replace(residual, rf"\b{re.escape(w)}\b", " ")
    residual = F.regexp_replace(residual, r"\b(murah|maksimal|max|rp|deket|dekat)\b", " ")
    residual = F.regexp_replace(residual, r"\d+[.,]?\d*\s*(jt|juta|rb|ribu|k)?\b", " ")
    parsed = queries.select("query_id", "query_text", F.when(F.size(kinds) == 1, kinds[0]).alias("gender"), found.alias("facilities"), F.coalesce(F.array_max(prices), F.when(_word(low, "murah"), CHEAP)).cast("bigint").alias("price_max"), X.normalize_whitespace(residual).alias("residual"))
    return parsed.join(anchors(queries, gazetteer, fuzzy), "query_id", "left")


def relax(candidates: DataFrame) -> DataFrame:
    """The candidates that survive the hard constraints, with ``relaxed``, the list of constraints given up.

    Stated filters (filter_min, filter_max, filter_type, filter_place) always hold. Parsed gender and price hold together,
    else the gender alone, else neither: the first level at which the query keeps a candidate. Unknown values of a
    listing pass, but for the place.
    """
    c = F.col
    price, kind = c("harga_per_bulan"), c("tipe")
    stated = (
        (F.coalesce(c("filter_min"), F.lit(0)) == 0) | price.isNull() | (price == 0) | (price >= c("filter_min"))
    ) & ((F.coalesce(c("filter_max"), F.lit(0)) == 0) | price.isNull() | (price == 0) | (price <= c("filter_max"))) & (
        (F.coalesce(c("filter_type"), F.lit("")) == "") | (F.coalesce(kind, F.lit("")) == "") | (kind == c("filter_type"))
    ) & ((F.coalesce(c("filter_place"), F.lit("")) == "") | F.coalesce(F.contains(F.lower("kecamatan"), F.lower("filter_place")), F.lit(False)))
    asks_gender = c("gender").isNotNull() & (F.coalesce(c("filter_type"), F.lit("")) == "")
    asks_price = (F.coalesce(c("price_max"), F.lit(0)) > 0) & (F.coalesce(c("filter_max"), F.lit(0)) == 0)
    gender = ~asks_gender | (F.coalesce(kind, F.lit("")) == "") | (kind == c("gender"))
    cheap = ~asks_price | (F.coalesce(price, F.lit(0)) == 0) | (price <= c("price_max"))
    level = F.when(stated & gender & cheap, 0).when(stated & gender, 1).when(stated, 2)
    kept = candidates.withColumn("_level", level).withColumn("_least", F.min("_level").over(W.partitionBy("query_id"))).where(F.col("_level") <= F.col("_least"))
    gone = F.array_compact(F.array(F.when((c("_least") >= 1) & asks_price, "harga"), F.when((c("_least") >= 2) & asks_gender, "gender")))
    return kept.withColumn("relaxed", gone).drop("_level", "_least")


def fuse(kept: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """``kept`` with score: the weighted sum of text, nearness and facility scores, each scaled within its query."""
    km = haversine_km(F.col("koordinat_lat"), F.col("koordinat_lng"), F.col("anchor_lat"), F.col("anchor_lng"))
    geo = F.coalesce(F.when(F.col("anchor").isNotNull() & usable(F.col("koordinat_lat"), F.col("koordinat_lng")), 1 / (1 + km)), F.lit(0.0))
    have = F.transform(F.coalesce("fasilitas", F.array().cast("array<string>")), lambda f: F.lower(f))
    hits = F.size(F.filter("facilities", lambda w: F.exists(have, lambda f: F.contains(f, w))))
    attr = F.when(F.size("facilities") > 0, hits / F.size("facilities")).otherwise(0.0)
    raw = kept.withColumns({"_geo": geo, "_attr": attr})
    parts = [R.min_max(raw, n) for n in ("text_score", "_geo", "_attr")]
    scaled = raw.withColumns({f"_s{i}": p for i, p in enumerate(parts)})
    return scaled.withColumn("score", sum((w * F.col(f"_s{i}") for i, w in enumerate(weights)), F.lit(0.0))).drop("_geo", "_attr", "_s0", "_s1", "_s2")


def smart_rank(queries: DataFrame, listings: DataFrame, gazetteer: DataFrame, k: int = 10, *, weights: tuple[float, float, float] = WEIGHTS, preprocess: Callable[[Column], Column] | None = None, fuzzy: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank, relaxed): the best ``k`` listings of every query.

    ``queries``: query_id, query_text, and optionally filter_min, filter_max, filter_type, filter_place. ``listings``: one
    row an id, with judul, kecamatan, fasilitas, deskripsi, tipe, harga_per_bulan, koordinat_lat, koordinat_lng.
    Candidates are the best 5k by text and, with an anchor, all listings within three kilometres of it; a query without
    any text signal takes every listing, each once, by fused score. Ties: the cheaper first, unknown prices last, then id.
    """
    words = preprocess or (lambda t: X.tokenize(X.lowercase(t)))
    for name, kind in (("filter_min", "bigint"), ("filter_max", "bigint"), ("filter_type", "string"), ("filter_place", "string")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    parsed = parse_queries(queries, gazetteer, fuzzy=fuzzy).join(queries.select("query_id", "filter_min", "filter_max", "filter_type", "filter_place"), "query_id")
    asked = parsed.select("query_id", words(F.when(F.col("residual") != "", F.col("residual")).otherwise(F.coalesce("query_text", F.lit("")))).alias("tokens"))
    docs = listings.select(F.col("id").alias("doc_id"), words(X.compose_lexical("judul", "kecamatan", "fasilitas", "deskripsi")).alias("tokens"))
    hits = R.bm25(docs, asked, k * OVERSHOOT).select("query_id", "doc_id", "score")
    signal = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    told = parsed.join(signal, "query_id", "left").withColumn("silent", F.coalesce(F.col("best") <= 0, F.lit(True)))
    text = hits.join(told.where("not silent").select("query_id"), "query_id", "left_semi")
    near = within_radius(listings.select("id", F.col("koordinat_lat").alias("lat"), F.col("koordinat_lng").alias("lng")), told.where("not silent and anchor is not null").select(F.col("query_id").alias("name"), F.col("anchor_lat").alias("lat"), F.col("anchor_lng").alias("lng"), F.lit(RADIUS_KM).alias("radius_km")))
    everything = listings.select(F.col("id").alias("doc_id")).join(F.broadcast(told.where("silent").select("query_id")))
    pool = text.unionByName(near.select(F.col("name").alias("query_id"), F.col("id").alias("doc_id"), F.lit(0.0).alias("score"))).unionByName(everything.select("query_id", "doc_id", F.lit(0.0).alias("score")))
    united = pool.groupBy("query_id", "doc_id").agg(F.sum("score").alias("text_score"))
    rows = listings.select(F.col("id").alias("doc_id"), "tipe", "harga_per_bulan", "fasilitas", "kecamatan", "koordinat_lat", "koordinat_lng")
    full = united.join(rows, "doc_id").join(F.broadcast(told.drop("query_text", "best", "silent")), "query_id")
    fused = fuse(relax(full), weights)
    order = W.partitionBy("query_id").orderBy(F.round("score", R.DIGITS).desc(), F.coalesce("harga_per_bulan", F.lit(10**12)), "doc_id")
    return fused.select("query_id", "doc_id", "score", "relaxed", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def search(hits: DataFrame, listings: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Ranked hits with their listing's row, those that fail ``where`` left out, the first ``k`` a query, ranks kept."""
    rows = listings.withColumnRenamed("id", "doc_id")
    kept = hits.join(rows if where is None else rows.where(where), "doc_id")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)
