"""Registered queries of the pipeline and of the experiments, on listings judged by majority."""

from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.functions.pipeline import PipelineConfig, process
from lontar.operators import experiments as E
from lontar.operators import metrics as M
from lontar.operators import quality as Q
from lontar.operators import ranking as R
from lontar.plans.evaluation import _V
from lontar.plans.quality import _LAST
from lontar.plans.text import _strip
from lontar.runtime import cut_lineage, spread, table


def _docs(spark, folder):
    rows = Q.keep_last(table(spark, folder, "listings").select("id", "judul", "kecamatan", "fasilitas", "deskripsi", "inserted_at", "scrape_date"), "id", "inserted_at", "scrape_date")
    return rows.select(F.col("id").alias("doc_id"), X.compose_lexical("judul", "kecamatan", "fasilitas", "deskripsi").alias("text"))


def _queries(spark, folder):
    return table(spark, folder, "queries").select(F.col("id").alias("query_id"), F.col("query_text").alias("text"))


def _judged(spark, folder):
    return M.majority_vote(M.last_votes(table(spark, folder, "relevance_labels")))


def x12_pipeline(spark, folder):
    """The pipeline without stemming over all documents."""
    p = process("text", PipelineConfig(stem=False))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", p.alias("p")).select("doc_id", "p.processed", F.size("p.stages_applied").cast("bigint").alias("stages"))


def x11_stemmed(spark, folder):
    p = process("text")
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", p["processed"].alias("processed"))


def x12_trace(spark, folder):
    """What every stage makes of every query."""
    p = process("text", trace=True)
    return _queries(spark, folder).select("query_id", F.explode(p["trace"]).alias("t")).select("query_id", "t.stage", "t.output")


def r12_pool(spark, folder):
    """BM25 within the judged pool, with the statistics of the whole corpus."""
    words = lambda df, key: df.select(key, X.tokenize(X.lowercase("text")).alias("tokens"))
    docs = cut_lineage(words(_docs(spark, folder), "doc_id"))  # read for the statistics and for the pool
    hits = R.bm25_pairs(docs, words(_queries(spark, folder), "query_id"), _judged(spark, folder))
    return R.top_ranks(hits, None).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


#: The settings of the grid.
K1, B = (0.6, 0.9, 1.2, 1.5, 1.8, 2.1), (0.3, 0.5, 0.75, 0.9, 1.0)


def e17_bm25_grid(spark, folder):
    """Mean average precision of BM25 in the judged pool, for thirty settings of k1 and b."""
    words = lambda df, key: df.select(key, X.tokenize(X.lowercase("text")).alias("tokens"))
    found = E.bm25_grid(words(_docs(spark, folder), "doc_id"), words(_queries(spark, folder), "query_id"), _judged(spark, folder), list(K1), list(B))
    return found.select("model", F.round("map", 6).alias("map"), "queries")


def e20_ablation(spark, folder):
    """BM25 with all nine stages, and with each stage that changes words left out in turn, stemming among them."""
    return E.ablation(_docs(spark, folder), _queries(spark, folder), _judged(spark, folder), PipelineConfig())


def r15_r16_learning(spark, folder):
    """Learning to rank on text score and length of judged pairs."""
    pool = r12_pool(spark, folder).join(_judged(spark, folder), ["query_id", "doc_id"])
    sized = pool.join(_docs(spark, folder).select("doc_id", F.log1p(X.word_count("text").cast("double")).alias("length")), "doc_id")
    return E.learn_to_rank(sized.select("query_id", "doc_id", "relevance", "score", "length"), ["score", "length"])


QUERIES = {f.__name__: f for f in (x11_stemmed, x12_pipeline, x12_trace, r12_pool, e17_bm25_grid, e20_ablation, r15_r16_learning)}
_LEXICAL = f"concat_ws(' . ', nullif({_strip('judul')}, ''), nullif({_strip('judul')}, ''), nullif({_strip('kecamatan')}, ''), nullif(array_to_string(fasilitas, ' '), ''), nullif({_strip('deskripsi')}, ''))"
_GRID = f"""with {_LAST}, {_V}, docs as (select id as doc_id, regexp_extract_all(lower({_LEXICAL}), '[a-zA-Z0-9_]+') as t from last),
  post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from docs) group by all),
  one as (select count(*) as n, avg(len(t)) as avgdl from docs), dfs as (select term, count(*) as df from post group by term),
  raws as (select term, ln(n - df + 0.5e0) - ln(df + 0.5e0) as raw from dfs, one),
  idfs as (select term, case when raw < 0 then 0.25e0 * (select avg(raw) from raws) else raw end as idf from raws),
  asked as (select id as query_id, unnest(regexp_extract_all(lower(coalesce(query_text, '')), '[a-zA-Z0-9_]+')) as term from queries),
  grid as (select k1, b from (select unnest([{', '.join(f'{k}e0' for k in K1)}]) as k1), (select unnest([{', '.join(f'{b}e0' for b in B)}]) as b)),
  met as (select m.query_id, m.doc_id, p.tf, len(d.t) / o.avgdl as long, i.idf from maj m join docs d using (doc_id) join asked a using (query_id) join post p on p.doc_id = m.doc_id and p.term = a.term join idfs i on i.term = a.term, one o),
  sums as (select k1, b, query_id, doc_id, sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * long))) as score from met, grid group by all),
  scored as (select g.k1, g.b, m.query_id, m.doc_id, m.relevance as rel, coalesce(s.score, 0e0) as score from maj m semi join docs using (doc_id) cross join grid g left join sums s on s.k1 = g.k1 and s.b = g.b and s.query_id = m.query_id and s.doc_id = m.doc_id),
  ranked as (select *, row_number() over (partition by k1, b, query_id order by round(score, 6) desc, doc_id) as rank from scored),
  cum as (select *, sum((rel >= 1)::int) over (partition by k1, b, query_id order by rank rows unbounded preceding) as c from ranked),
  tots as (select query_id, sum((relevance >= 1)::int) as tot from maj group by query_id),
  aps as (select k1, b, query_id, case when any_value(tot) > 0 then sum(case when rel >= 1 then c * 1e0 / rank else 0 end) / any_value(tot) else 0 end as ap from cum join tots using (query_id) group by k1, b, query_id)
  select cast(k1 as varchar) || '/' || cast(b as varchar) as model, round(avg(ap), 6) as map, count(*) as queries from aps group by k1, b"""

ORACLE = {"e17_bm25_grid": _GRID}
