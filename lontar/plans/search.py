"""Registered queries of query understanding and constraint-aware ranking."""

from pyspark.sql import functions as F

from lontar.functions import vocabulary as V
from lontar.operators import quality as Q
from lontar.operators import search as S
from lontar.runtime import table


def _queries(spark, folder):
    return table(spark, folder, "queries").select(F.col("id").alias("query_id"), "query_text")


def _latest(spark, folder):
    columns = ("id", "judul", "deskripsi", "harga_per_bulan", "tipe", "fasilitas", "kecamatan", "koordinat_lat", "koordinat_lng", "inserted_at", "scrape_date", "batch_id")
    return Q.keep_last(table(spark, folder, "listings").select(*columns), "id", "inserted_at", "scrape_date", "harga_per_bulan", "batch_id")


def r05_parse(spark, folder):
    p = S.parse_queries(_queries(spark, folder), table(spark, folder, "gazetteer"))
    return p.select("query_id", "gender", F.array_join("facilities", ",").alias("facilities"), "price_max", "residual")


def j10_anchor(spark, folder):
    return S.anchors(_queries(spark, folder), table(spark, folder, "gazetteer"), fuzzy=False).select("query_id", "anchor")


def r06_fuzzy_anchor(spark, folder):
    return S.anchors(_queries(spark, folder), table(spark, folder, "gazetteer")).select("query_id", "anchor")


def r09_smart(spark, folder):
    hits = S.smart_rank(_queries(spark, folder), _latest(spark, folder), table(spark, folder, "gazetteer"))
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), F.array_join("relaxed", ",").alias("relaxed"))


def e06_constraints(spark, folder):
    """Share of the five best that meet the tenant type and price understood from the query."""
    parsed = S.parse_queries(_queries(spark, folder), table(spark, folder, "gazetteer"))
    rows = _latest(spark, folder).select(F.col("id").alias("doc_id"), "tipe", "harga_per_bulan")
    hits = S.smart_rank(_queries(spark, folder), _latest(spark, folder), table(spark, folder, "gazetteer")).where("rank <= 5").join(rows, "doc_id").join(F.broadcast(parsed.select("query_id", "gender", "price_max")), "query_id")
    ok = (F.col("gender").isNull() | F.coalesce(F.col("tipe") == F.col("gender"), F.lit(False))) & (F.col("price_max").isNull() | (F.coalesce("harga_per_bulan", F.lit(0)) <= F.col("price_max")))
    return hits.groupBy("query_id").agg(F.round(F.avg(ok.cast("double")), 6).alias("cs_at_5"))


QUERIES = {f.__name__: f for f in (r05_parse, j10_anchor, r06_fuzzy_anchor, r09_smart, e06_constraints)}

_WORDS = [*V.GENDER_WORDS, *sorted(V.QUERY_FACILITIES, key=len, reverse=True)]


def _residual():
    x = "low"
    for w in _WORDS:
        x = f"regexp_replace({x}, '\\b{w.replace('-', '\\-')}\\b', ' ', 'g')"
    x = f"regexp_replace({x}, '\\b(murah|maksimal|max|rp|deket|dekat)\\b', ' ', 'g')"
    x = f"regexp_replace({x}, '\\d+[.,]?\\d*\\s*(jt|juta|rb|ribu|k)?\\b', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _found(words):
    return ", ".join(f"case when regexp_matches(low, '\\b{w.replace('-', '\\-')}\\b') then '{kind}' end" for w, kind in words)


_AMOUNT = "list_transform(regexp_extract_all(low, '(\\d+(?:[.,]\\d+)?)\\s*(?:{})\\b', 1), lambda x: cast(trunc(cast(replace(x, ',', '.') as double) * {}) as bigint))"
_RP = "list_filter(list_transform(regexp_extract_all(low, 'rp\\s*([\\d.,]+)', 1), lambda x: try_cast(regexp_replace(x, '[.,]', '', 'g') as bigint)), lambda x: x >= 10000)"
_FAC = [(w, V.QUERY_FACILITIES[w]) for w in sorted(V.QUERY_FACILITIES, key=len, reverse=True)]

ORACLE = {
    "r05_parse": f"""with l as (select id as query_id, ' ' || lower(coalesce(query_text, '')) || ' ' as low from queries),
        g as (select *, list_distinct(list_filter([{_found(V.GENDER_WORDS.items())}], lambda x: x is not null)) as kinds, list_filter([{_found(_FAC)}], lambda x: x is not null) as f,
              list_max(list_concat({_AMOUNT.format('jt|juta', 1000000)}, {_AMOUNT.format('k|rb|ribu', 1000)}, {_RP})) as p from l)
        select query_id, case when len(kinds) = 1 then kinds[1] end as gender, array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') as facilities,
          coalesce(p, case when regexp_matches(low, '\\bmurah\\b') then 1000000 end) as price_max, {_residual()} as residual from g""",
    "j10_anchor": """with k as (select distinct lower(alias) as alias, name from (select unnest(list_concat([name], coalesce(aliases, []))) as alias, name from gazetteer where lat is not null and lng is not null and abs(lat) <= 90) where alias <> '')
        select q.id as query_id, arg_min(k.name, struct_pack(n := -length(k.alias), m := k.name)) as anchor from queries q join k on contains(' ' || lower(q.query_text) || ' ', ' ' || k.alias || ' ') group by q.id""",
}
