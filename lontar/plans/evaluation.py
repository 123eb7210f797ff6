"""Registered queries of the evaluation: annotators as models, judged by their majority."""

from pyspark.sql import functions as F

from lontar.operators import metrics as M
from lontar.runtime import table


def _votes(spark, folder):
    return M.last_votes(table(spark, folder, "relevance_labels"))


def _metrics(spark, folder):
    votes = _votes(spark, folder)
    return M.ranking_metrics(M.rankings_of_votes(votes), M.majority_vote(votes))


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def a10_majority(spark, folder):
    return M.majority_vote(_votes(spark, folder))


def a11_middle_vote(spark, folder):
    return M.middle_vote(_votes(spark, folder))


def a12_confusion(spark, folder):
    return M.confusion(M.vote_pairs(_votes(spark, folder)))


def a21_agreement(spark, folder):
    pairs = M.vote_pairs(_votes(spark, folder))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("double")), 6).alias("agree"))


def a25_label_distribution(spark, folder):
    return M.majority_vote(_votes(spark, folder)).groupBy("relevance").agg(F.count("*").alias("n"))


def a26_pool_sizes(spark, folder):
    per = _votes(spark, folder).groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), F.sum((F.col("n") < 20).cast("bigint")).alias("small"))


def e01_e05_metrics(spark, folder):
    return _rounded(_metrics(spark, folder), "p_at_5", "p_at_10", "ap", "ndcg_at_10", "rr")


def a01_model_means(spark, folder):
    return _rounded(M.summary(_metrics(spark, folder)), "p_at_5", "p_at_10", "map", "ndcg_at_10", "rr")


def a23_difficulty(spark, folder):
    d = M.difficulty(_metrics(spark, folder))
    return _rounded(d, "mean_ap")


def a24_pivot(spark, folder):
    """Average precision, queries by all models. Models are people, so their names are few."""
    m = _metrics(spark, folder)
    names = sorted(r["model"] for r in _votes(spark, folder).select(F.col("annotator").alias("model")).distinct().collect())
    return m.groupBy("query_id").pivot("model", names).agg(F.round(F.first("ap"), 6))


def t04_worst_queries(spark, folder):
    return _rounded(M.difficulty(_metrics(spark, folder)), "mean_ap").orderBy("mean_ap", "query_id").limit(10).select("query_id", "mean_ap")


def e07_kappa(spark, folder):
    k = _rounded(M.kappa(M.vote_pairs(_votes(spark, folder))), "kappa")
    return k.withColumn("meaning", M.interpret_kappa(F.col("kappa")))


def e08_weighted_kappa(spark, folder):
    pairs = M.vote_pairs(_votes(spark, folder))
    linear = M.kappa(pairs, weights="linear").withColumnRenamed("kappa", "linear")
    return _rounded(linear.join(M.kappa(pairs, weights="quadratic").select("a", "b", F.col("kappa").alias("quadratic")), ["a", "b"]), "linear", "quadratic")


def e09_paired_t(spark, folder):
    return _rounded(M.paired_t(M.paired(_metrics(spark, folder))), "t", "cohens_d")


def e10_signed_ranks(spark, folder):
    return _rounded(M.signed_ranks(M.paired(_rounded(_metrics(spark, folder), "ap"))), "w_plus", "w_minus").select("a", "b", "n", "n_nonzero", "w_plus", "w_minus")


def e10_e12_significance(spark, folder):
    """Signed-rank tests of every two models, corrected by Holm."""
    tests = M.wilcoxon(M.paired(_metrics(spark, folder))).withColumn("test", F.concat_ws("-", "a", "b"))
    return M.holm(tests)


def e12_holm(spark, folder):
    """Holm's correction on values between 0 and 1: the share of each query's pairs that are not relevant, cubed."""
    shares = M.majority_vote(_votes(spark, folder)).groupBy(F.col("query_id").alias("test")).agg(F.pow(F.avg((F.col("relevance") == 0).cast("double")), 3).alias("p_value"))
    return _rounded(M.holm(_rounded(shares, "p_value")), "p_holm", "threshold")


def e13_bootstrap(spark, folder):
    return M.bootstrap_mean(_metrics(spark, folder))


def e24_spearman(spark, folder):
    """Rank correlation of a listing's price with its grade."""
    prices = table(spark, folder, "listings").groupBy(F.col("id").alias("doc_id")).agg(F.min("harga_per_bulan").alias("price"))
    return _rounded(M.spearman(M.majority_vote(_votes(spark, folder)).join(prices, "doc_id"), "price", "relevance"), "rho")


def u01_pool(spark, folder):
    """The union of every annotator's five best of each query."""
    return M.rankings_of_votes(_votes(spark, folder)).where("rank <= 5").select("query_id", "doc_id").distinct()


def j14_orphans(spark, folder):
    """Labels whose listing or query does not exist."""
    labels = table(spark, folder, "relevance_labels")
    no_listing = labels.join(table(spark, folder, "listings").select(F.col("id").alias("listing_id")).distinct(), "listing_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("listing").alias("missing"), "n")
    no_query = labels.join(table(spark, folder, "queries").select(F.col("id").alias("query_id")), "query_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("query").alias("missing"), "n")
    return no_listing.unionByName(no_query)


def s05_keep_last_label(spark, folder):
    """One judgement a pair: the last by time, the greater at equal times."""
    rows = table(spark, folder, "relevance_labels").where("relevance in (0, 1, 2)")
    return rows.groupBy("query_id", "listing_id").agg(F.max_by("relevance", F.struct("labelled_at", "relevance")).alias("relevance"))


def j04_three_way(spark, folder):
    """Agreement of every three annotators on the items that all of them labelled."""
    votes = _votes(spark, folder)
    one = lambda n, c: votes.select("query_id", "doc_id", F.col("annotator").alias(n), F.col("vote").alias(c))
    two = one("a", "x").join(one("b", "y"), ["query_id", "doc_id"]).where("a < b")
    three = two.join(one("c", "z"), ["query_id", "doc_id"]).where("b < c")
    same = ((F.col("x") == F.col("y")) & (F.col("y") == F.col("z"))).cast("bigint")
    return three.groupBy("a", "b", "c").agg(F.count("*").alias("n"), F.sum(same).alias("agree"))


def a27_out_of_range(spark, folder):
    """Metric values that are null or outside 0..1."""
    m = _metrics(spark, folder)
    bad = lambda c: F.sum((F.col(c).isNull() | ~F.col(c).between(0, 1)).cast("bigint")).alias(c)
    return m.agg(*(bad(c) for c in ("p_at_5", "p_at_10", "ap", "ndcg_at_10", "rr")))


def e29_drill_down(spark, folder):
    """One query's metrics by model."""
    return _rounded(_metrics(spark, folder).where("query_id = 'q001'"), "ap", "rr").select("model", "ap", "rr")


def s07_unpivot(spark, folder):
    """Means per model of a wide table of average precisions, all models."""
    from lontar.sources.readers import unpivot_models

    wide = a24_pivot(spark, folder)
    wide = wide.select(*(F.col(c).alias(c if c == "query_id" else f"cs_at_5_{c}") for c in wide.columns))
    return _rounded(unpivot_models(wide), "mean")


def u02_candidates(spark, folder):
    """The union of two candidate sets, the greater score kept: votes and the published consensus."""
    a = _votes(spark, folder).select("query_id", "doc_id", F.col("vote").alias("score"))
    b = table(spark, folder, "relevance_consensus").select("query_id", F.col("listing_id").alias("doc_id"), F.col("relevance").alias("score"))
    return a.unionByName(b).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


QUERIES = {f.__name__: f for f in (a01_model_means, a10_majority, a11_middle_vote, a12_confusion, a21_agreement, a23_difficulty, a24_pivot, a25_label_distribution, a26_pool_sizes, t04_worst_queries, e01_e05_metrics, e07_kappa, e08_weighted_kappa, e09_paired_t, e10_signed_ranks, e10_e12_significance, e12_holm, e13_bootstrap, e24_spearman, u01_pool, u02_candidates, j04_three_way, j14_orphans, a27_out_of_range, e29_drill_down, s05_keep_last_label, s07_unpivot)}

_V = """votes as (select query_id, listing_id as doc_id, lower(trim(annotator)) as annotator, arg_max(relevance, struct_pack(t := labelled_at, r := relevance)) as vote
  from relevance_labels where relevance in (0, 1, 2) group by all),
  tally as (select query_id, doc_id, vote, count(*) as n from votes group by all),
  maj as (select query_id, doc_id, arg_max(vote, struct_pack(n := n, v := vote)) as relevance from tally group by all),
  pairs as (select a.annotator as a, b.annotator as b, a.vote as x, b.vote as y from votes a join votes b using (query_id, doc_id) where a.annotator < b.annotator)"""
_M = f"""with {_V}, ranked as (select annotator as model, query_id, doc_id, row_number() over (partition by annotator, query_id order by vote desc, doc_id) as rank from votes),
  j as (select r.*, coalesce(m.relevance, 0) as rel from ranked r left join maj m using (query_id, doc_id)),
  s as (select *, sum((rel >= 1)::int) over (partition by model, query_id order by rank rows unbounded preceding) as c from j),
  ideal as (select query_id, sum(case when p <= 10 then relevance / log2(p + 1) else 0 end) as idcg, sum((relevance >= 1)::int) as tot from (select *, row_number() over (partition by query_id order by relevance desc, doc_id) as p from maj) group by query_id),
  m as (select model, query_id, sum((rank <= 5 and rel >= 1)::int) / 5e0 as p_at_5, sum((rank <= 10 and rel >= 1)::int) / 10e0 as p_at_10,
    case when any_value(tot) > 0 then sum(case when rel >= 1 then c * 1e0 / rank else 0 end) / any_value(tot) else 0 end as ap,
    case when any_value(idcg) > 0 then sum(case when rank <= 10 then rel / log2(rank + 1) else 0 end) / any_value(idcg) else 0 end as ndcg_at_10,
    coalesce(1e0 / min(case when rel >= 1 then rank end), 0) as rr from s join ideal using (query_id) group by model, query_id),
  two as (select x.model as a, y.model as b, x.query_id, x.ap as x, y.ap as y from m x join m y using (query_id) where x.model < y.model)"""
_K = """(select a, b, sum(n) as n, sum(n * {w}) as o from cells group by a, b), e as (select l.a, l.b, sum(l.nx * r.ny * {w}) as e from (select a, b, x, sum(n) as nx from cells group by all) l join (select a, b, y, sum(n) as ny from cells group by all) r using (a, b) group by all)"""

ORACLE = {
    "a10_majority": f"with {_V} select * from maj",
    "a11_middle_vote": f"""with {_V}, s as (select query_id, doc_id, max(n) as most, arg_max(vote, struct_pack(n := n, v := -vote)) as mode, list_sort(list(vote)) as l from tally group by all)
        select query_id, doc_id, case when most > 1 then mode else l[len(l) // 2 + 1] end as relevance from s""",
    "a12_confusion": f"with {_V} select a, b, x, y, count(*) as n from pairs group by all",
    "a21_agreement": f"with {_V} select a, b, count(*) as n, round(avg((x = y)::int), 6) as agree from pairs group by all",
    "a25_label_distribution": f"with {_V} select relevance, count(*) as n from maj group by all",
    "a26_pool_sizes": f"with {_V}, p as (select query_id, count(distinct doc_id) as n from votes group by all) select round(avg(n), 6) as mean, min(n) as least, median(n) as middle, max(n) as most, cast(sum((n < 20)::int) as bigint) as small from p",
    "e01_e05_metrics": f"{_M} select model, query_id, round(p_at_5, 6) as p_at_5, round(p_at_10, 6) as p_at_10, round(ap, 6) as ap, round(ndcg_at_10, 6) as ndcg_at_10, round(rr, 6) as rr from m",
    "a01_model_means": f"{_M} select model, round(avg(p_at_5), 6) as p_at_5, round(avg(p_at_10), 6) as p_at_10, round(avg(ap), 6) as map, round(avg(ndcg_at_10), 6) as ndcg_at_10, round(avg(rr), 6) as rr, count(*) as queries from m group by model",
    "a23_difficulty": f"{_M} select query_id, round(avg(ap), 6) as mean_ap, case when avg(ap) < 0.1e0 then 'hard' when avg(ap) < 0.3e0 then 'medium' else 'easy' end as band from m group by query_id",
    # one column a model: the tables have eighteen, numbered through
    "a24_pivot": f"{_M} select query_id, " + ", ".join(f"round(max(ap) filter (model = 'penilai_{k:02}'), 6) as penilai_{k:02}" for k in range(1, 19)) + " from m group by query_id",
    "t04_worst_queries": f"{_M} select query_id, round(avg(ap), 6) as mean_ap from m group by query_id order by 2, 1 limit 10",
    "e07_kappa": f"""with {_V}, cells as (select a, b, x, y, count(*) as n from pairs group by all), t as {_K.format(w='(x <> y)::int')},
        k as (select a, b, n, round(case when e > 0 then 1 - (o * 1e0 / n) / (e * 1e0 / (n * n)) when o > 0 then 0 else 1 end, 6) as kappa from t join e using (a, b))
        select *, case when kappa < 0 then 'less than chance' when kappa < 0.2e0 then 'slight' when kappa < 0.4e0 then 'fair' when kappa < 0.6e0 then 'moderate' when kappa < 0.8e0 then 'substantial' else 'almost perfect' end as meaning from k""",
    "e08_weighted_kappa": f"""with {_V}, cells as (select a, b, x, y, count(*) as n from pairs group by all), t as {_K.format(w='(abs(x - y) / 2e0)')},
        t2 as {_K.replace('e as (', 'e2 as (').format(w='((x - y) * (x - y) / 4e0)')}
        select a, b, t.n, round(case when e > 0 then 1 - (t.o / t.n) / (e / (t.n * t.n)) when t.o > 0 then 0 else 1 end, 6) as linear,
          round(case when e2.e > 0 then 1 - (t2.o / t.n) / (e2.e / (t.n * t.n)) when t2.o > 0 then 0 else 1 end, 6) as quadratic from t join e using (a, b) join t2 using (a, b) join e2 using (a, b)""".replace("case when e >", "case when e.e >").replace("/ (e / (", "/ (e.e / ("),
    "e09_paired_t": f"{_M} select a, b, n, round(d * sqrt(n), 6) as t, round(d, 6) as cohens_d from (select a, b, count(*) as n, case when stddev_samp(x - y) > 1e-15 then avg(x - y) / stddev_samp(x - y) else 0 end as d from two group by all)",
    "e10_signed_ranks": f"""{_M}, d as (select a, b, round(round(x, 6) - round(y, 6), 12) as d from two), nz as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2e0 as r from d where d <> 0)
        select a, b, n, coalesce(k, 0) as n_nonzero, coalesce(p, 0) as w_plus, coalesce(q, 0) as w_minus from (select a, b, count(*) as n from d group by all)
        left join (select a, b, count(*) as k, sum(case when d > 0 then r else 0 end) as p, sum(case when d < 0 then r else 0 end) as q from nz group by all) using (a, b)""",
    "e12_holm": f"""with {_V}, t as (select query_id as test, round(pow(avg((relevance = 0)::int), 3), 6) as p_value from maj group by all),
        l as (select *, count(*) over () - row_number() over (order by p_value, test) + 1 as m from t)
        select test, p_value, round(max(least(1e0, m * p_value)) over w, 6) as p_holm, round(0.05e0 / m, 6) as threshold, min((p_value <= 0.05e0 / m)::int) over w = 1 as significant from l
        window w as (order by p_value, test rows unbounded preceding)""",
    "e24_spearman": f"""with {_V}, z as (select p.price, m.relevance from maj m join (select id as doc_id, min(harga_per_bulan) as price from listings group by id) p using (doc_id) where p.price is not null),
        r as (select rank() over (order by price) + (count(*) over (partition by price) - 1) / 2e0 as rx, rank() over (order by relevance) + (count(*) over (partition by relevance) - 1) / 2e0 as ry from z)
        select count(*) as n, round(corr(rx, ry), 6) as rho from r""",
    "u01_pool": f"{_M} select distinct query_id, doc_id from ranked where rank <= 5",
    "j14_orphans": """select 'listing' as missing, count(*) as n from relevance_labels where listing_id not in (select id from listings)
        union all select 'query', count(*) from relevance_labels where query_id not in (select id from queries)""",
    "s05_keep_last_label": "select query_id, listing_id, arg_max(relevance, struct_pack(t := labelled_at, r := relevance)) as relevance from relevance_labels where relevance in (0, 1, 2) group by all",
    "j04_three_way": f"""with {_V} select a.annotator as a, b.annotator as b, c.annotator as c, count(*) as n, count(*) filter (a.vote = b.vote and b.vote = c.vote) as agree
        from votes a join votes b using (query_id, doc_id) join votes c using (query_id, doc_id) where a.annotator < b.annotator and b.annotator < c.annotator group by all""",
    "a27_out_of_range": f"{_M} select " + ", ".join(f"count(*) filter ({c} is null or not {c} between 0 and 1) as {c}" for c in ("p_at_5", "p_at_10", "ap", "ndcg_at_10", "rr")) + " from m",
    "e29_drill_down": f"{_M} select model, round(ap, 6) as ap, round(rr, 6) as rr from m where query_id = 'q001'",
    "s07_unpivot": f"{_M} select model, round(avg(round(ap, 6)), 6) as mean from m group by model",
    "u02_candidates": f"with {_V} select query_id, doc_id, max(s) as score from (select query_id, doc_id, vote as s from votes union all select query_id, listing_id, relevance from relevance_consensus) group by all",
}
