"""Registered queries of the rankers: all queries against all documents."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.operators import ranking as R
from lontar.runtime import table


def _docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.tokenize(X.lowercase("text")).alias("tokens"))


def _queries(spark, folder):
    return table(spark, folder, "queries").select(F.col("id").alias("query_id"), X.tokenize(X.lowercase("query_text")).alias("tokens"))


def _shown(hits):
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def r01_bm25(spark, folder):
    return _shown(R.bm25(_docs(spark, folder), _queries(spark, folder), 10))


def r02_tfidf(spark, folder):
    return _shown(R.tfidf(_docs(spark, folder), _queries(spark, folder), 10))


def r03_dense(spark, folder):
    """Every vector whose id is divisible by 20 against all vectors."""
    v = table(spark, folder, "embeddings")
    docs = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    return _shown(R.dense(docs, asked, 10))


def r04_hybrid(spark, folder):
    """All vectors, in the order of their ids, are dealt to the documents by id; a query's vector is that of its number."""
    v = table(spark, folder, "embeddings")
    ids = v.select("vec_id").distinct()
    count = ids.count()
    # ids only, without their vectors, pass through the single partition of this window
    place = ids.select("vec_id", (F.row_number().over(W.orderBy("vec_id")) - 1).cast("bigint").alias("place"))
    dealt = v.join(place, "vec_id").select("place", F.col("embedding").alias("vector"))
    docs = _docs(spark, folder).withColumn("place", F.pmod(F.col("doc_id"), F.lit(max(count, 1)))).join(dealt, "place")
    asked = _queries(spark, folder).withColumn("vec_id", F.regexp_extract("query_id", "[0-9]+", 0).cast("bigint"))
    vectors = asked.join(v, "vec_id").select("query_id", F.col("embedding").alias("vector"))
    lexical = R.bm25(docs, asked, None, index=R.bm25_index(_docs(spark, folder)))
    return _shown(R.hybrid(lexical, R.dense(docs, vectors, None), 10))


def a05_index_statistics(spark, folder):
    """Document frequency and idf of every term."""
    terms, _ = R.bm25_index(_docs(spark, folder))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def w02_min_max(spark, folder):
    hits = R.bm25(_docs(spark, folder), _queries(spark, folder), 20)
    return hits.select("query_id", "doc_id", F.round(R.min_max(hits, "score"), 6).alias("scaled"))


def r13_popularity(spark, folder):
    hits = R.bm25(_docs(spark, folder), _queries(spark, folder), 20)
    views = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("views")).na.fill(0)
    return _shown(R.top_ranks(R.popularity_blend(hits, views), 10))


QUERIES = {f.__name__: f for f in (r01_bm25, r02_tfidf, r03_dense, r04_hybrid, a05_index_statistics, w02_min_max, r13_popularity)}

_BM25 = """docs as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+') as t from documents),
  post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from docs) group by all),
  lens as (select doc_id, len(t) as dl from docs), one as (select count(*) as n, avg(dl) as avgdl from lens),
  dfs as (select term, count(*) as df from post group by term),
  raws as (select term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) as raw from dfs, one),
  idfs as (select term, df, case when raw < 0 then 0.25e0 * (select avg(raw) from raws) else raw end as idf from raws),
  asked as (select id as query_id, unnest(regexp_extract_all(lower(coalesce(query_text, '')), '[a-zA-Z0-9_]+')) as term from queries),
  parts as (select a.query_id, p.doc_id, i.idf * p.tf * (@k1@ + 1) / (p.tf + @k1@ * (1 - @b@ + @b@ * l.dl / o.avgdl)) as w
            from asked a join post p using (term) join idfs i using (term) join lens l using (doc_id), one o),
  scores as (select q.id as query_id, d.doc_id, coalesce(s.w, 0e0) as score from queries q cross join docs d
             left join (select query_id, doc_id, sum(w) as w from parts group by all) s on s.query_id = q.id and s.doc_id = d.doc_id)"""


def _bm25(k1="1.5e0", b="0.75e0"):
    return _BM25.replace("@k1@", k1).replace("@b@", b)


_TOP = "select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from {} qualify rank <= {}"

ORACLE = {
    "r01_bm25": f"with {_bm25()} {_TOP.format('scores', 10)}",
    "r02_tfidf": f"""with toks as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+') as t from documents),
        grams as (select doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from toks),
        tf as (select doc_id, term, count(*) as tf from grams group by all),
        feats as (select term, count(*) as df, sum(tf) as n from tf group by term having count(*) >= 2 order by n desc, term limit 10000),
        idfs as (select term, ln((1e0 + (select count(*) from documents)) / (1e0 + df)) + 1 as idf from feats),
        dw as (select doc_id, term, (1 + ln(tf)) * idf as w from tf join idfs using (term)),
        dn as (select doc_id, sqrt(sum(w * w)) as norm from dw group by doc_id),
        qt as (select id as query_id, regexp_extract_all(lower(coalesce(query_text, '')), '[a-zA-Z0-9_]+') as t from queries),
        qg as (select query_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from qt),
        qw as (select query_id, term, (1 + ln(count(*))) * any_value(idf) as w from qg join idfs using (term) group by all),
        qn as (select query_id, sqrt(sum(w * w)) as norm from qw group by query_id),
        s as (select query_id, doc_id, sum(qw.w * dw.w) / any_value(qn.norm) / any_value(dn.norm) as w from qw join dw using (term) join qn using (query_id) join dn using (doc_id) group by all),
        scores as (select q.id as query_id, d.doc_id, coalesce(s.w, 0e0) as score from queries q cross join documents d left join s on s.query_id = q.id and s.doc_id = d.doc_id)
        {_TOP.format('scores', 10)}""",
    "r03_dense": f"""with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
        n as (select vec_id, e, sqrt(list_dot_product(e, e)) as l from v),
        scores as (select cast(a.vec_id as varchar) as query_id, b.vec_id as doc_id, list_dot_product(a.e, b.e) / a.l / b.l as score from n a, n b where a.vec_id % 20 = 0)
        {_TOP.format('scores', 10)}""",
    "r04_hybrid": f"""with {_bm25()},
        v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
        n as (select vec_id, e, sqrt(list_dot_product(e, e)) as l from v),
        placed as (select e, l, row_number() over (order by vec_id) - 1 as place from n),
        d as (select q.id as query_id, b.vec_id as doc_id, list_dot_product(a.e, b.e) / a.l / b.l as d from queries q join n a on a.vec_id = cast(regexp_extract(q.id, '[0-9]+') as bigint) cross join (select x.doc_id as vec_id, p.e, p.l from documents x join placed p on p.place = x.doc_id % (select count(*) from n)) b),
        m as (select s.query_id, s.doc_id, score as l, coalesce(d, 0e0) as d from scores s left join d using (query_id, doc_id)),
        r as (select *, min(l) over w as l0, max(l) over w as l1, min(d) over w as d0, max(d) over w as d1 from m window w as (partition by query_id)),
        f as (select query_id, doc_id, 0.9e0 * case when l1 - l0 < 1e-9 then 0 else (l - l0) / (l1 - l0) end + (1 - 0.9e0) * case when d1 - d0 < 1e-9 then 0 else (d - d0) / (d1 - d0) end as score from r)
        {_TOP.format('f', 10)}""",
    "a05_index_statistics": f"with {_bm25()} select term, df, round(idf, 6) as idf from idfs",
    "w02_min_max": f"""with {_bm25()}, top as ({_TOP.format('scores', 20)}), full_ as (select t.query_id, t.doc_id, s.score from top t join scores s using (query_id, doc_id)),
        m as (select *, min(score) over w as lo, max(score) over w as hi from full_ window w as (partition by query_id))
        select query_id, doc_id, round(case when hi - lo < 1e-9 then 0 else (score - lo) / (hi - lo) end, 6) as scaled from m""",
    "r13_popularity": f"""with {_bm25()}, top as ({_TOP.format('scores', 20)}),
        m as (select t.query_id, t.doc_id, s.score, ln(1e0 + coalesce(d.n_chars, 0)) as v from top t join scores s using (query_id, doc_id) join documents d on d.doc_id = t.doc_id),
        f as (select query_id, doc_id, (1 - 0.2e0) * score + 0.2e0 * case when max(v) over (partition by query_id) > 0 then v / max(v) over (partition by query_id) else 0 end as score from m)
        {_TOP.format('f', 10)}""",
}
