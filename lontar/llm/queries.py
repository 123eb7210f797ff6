"""Registered queries of the operators for training-data pipelines, over whole tables with production parameters."""

from pyspark.sql import functions as F

from lontar.llm import addresses, canonical, consensus, listings, mixing, splitting, templates, tokens
from lontar.runtime import cut_lineage, table


def p1_found(spark, folder):
    """Listings whose description holds template residue, an error page or a script notice."""
    return templates.residue_ids(table(spark, folder, "listings"), "deskripsi")


def p1_templates(spark, folder):
    """The residue itself: each flagged template and kind, with the number of rows that hold it."""
    found = templates.flagged_segments(table(spark, folder, "listings"), "deskripsi")
    return found.groupBy("template", "kind").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_segments"))


def p1_leaks(spark, folder):
    """Listings with residue per batch, beside the count of the audit report."""
    rows = table(spark, folder, "listings")
    found = rows.select("id", "batch_id").distinct().join(templates.residue_ids(rows), "id").groupBy("batch_id").agg(F.count("*").alias("n_found"))
    told = table(spark, folder, "audit_report").select("batch_id", F.col("maps_readiness.template_leak").alias("template_leak"))
    return told.join(found, "batch_id", "left").select("batch_id", "template_leak", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def p2_found(spark, folder):
    """The consensus of every pair with valid labels of two annotators or more."""
    return consensus.consensus(table(spark, folder, "relevance_labels")).where(F.col("n_annotators") >= 2).select("query_id", "listing_id", "relevance")


def p2_refined(spark, folder):
    """The consensus after two rounds of weights for each single vote, which the triplets start but do not decide."""
    return consensus.consensus(table(spark, folder, "relevance_labels"), rounds=2).where(F.col("n_annotators") >= 2)


def p2_agreement(spark, folder):
    """Consensus, agreement and confidence of every labelled pair, beside the consensus published earlier."""
    earlier = table(spark, folder, "relevance_consensus").groupBy("query_id", "listing_id").agg(F.max("relevance").alias("published"))
    found = consensus.consensus(table(spark, folder, "relevance_labels")).withColumns({c: F.round(c, 6) for c in ("agreement", "confidence")})
    return found.join(earlier, ["query_id", "listing_id"], "left")


def p2_annotators(spark, folder):
    """Reliability of every annotator."""
    found = consensus.reliability(consensus.votes(table(spark, folder, "relevance_labels")))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_agreement", "accuracy", "weight")})


def p3_found(spark, folder):
    """Pairs of listings at one address."""
    districts = table(spark, folder, "canonical_values").where(F.col("field_name") == "kecamatan").select("entry")
    return addresses.address_pairs(table(spark, folder, "listings"), districts)


def p3_houses(spark, folder):
    """The house of each listing whose address denotes one, and how many listings stand there."""
    districts = table(spark, folder, "canonical_values").where(F.col("field_name") == "kecamatan").select("entry")
    found = cut_lineage(addresses.houses(table(spark, folder, "listings"), districts))
    return found.join(found.groupBy("house").agg(F.count("*").alias("n_listings")), "house").select("id", "house", "n_listings")


def _districts(spark, folder):
    return table(spark, folder, "canonical_values").where(F.col("field_name") == "kecamatan").select("entry", "aliases")


def p4_found(spark, folder):
    """Pairs of listings of one room."""
    return listings.room_pairs(table(spark, folder, "listings"), _districts(spark, folder))


def p4_rooms(spark, folder):
    """The room that each listing offers."""
    return listings.room_clusters(table(spark, folder, "listings"), _districts(spark, folder))


def p5_found(spark, folder):
    """The entry meant by each freely typed sub-district and facility."""
    return canonical.canonical_entries(table(spark, folder, "listings"), table(spark, folder, "canonical_values"))


def p7_ids(spark, folder):
    """The ids of every document."""
    return tokens.encode(table(spark, folder, "documents"), "byte_bpe_50k")


def p8_mix(spark, folder):
    """The documents of the mixture, and how often each is used."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark, folder):
    """The share that each source reaches, beside its target."""
    return mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def _limits(spark, folder):
    return table(spark, folder, "split_limits").first()


def p9_pieces(spark, folder):
    """The pieces of the documents beyond the limit."""
    limit = _limits(spark, folder)
    return splitting.split(table(spark, folder, "documents"), limit.max_tokens, limit.overlap_tokens, limit.tokenizer)


def p9_found(spark, folder):
    """Documents beyond the limit: those that come out in pieces, of which every one has two at least."""
    limit = _limits(spark, folder)
    return splitting.oversized_ids(table(spark, folder, "documents"), limit.max_tokens, limit.tokenizer, limit.overlap_tokens)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_templates, p1_leaks, p2_found, p2_refined, p2_agreement, p2_annotators, p3_found, p3_houses, p4_found, p4_rooms, p5_found, p7_ids, p8_mix, p8_shares, p9_found, p9_pieces)
}

_TRIPLETS = """with votes as (select query_id, listing_id, lower(trim(annotator)) as annotator, arg_max(relevance, struct_pack(t := coalesce(labelled_at, timestamp '1000-01-01'), r := relevance)) as vote
    from relevance_labels where relevance in (0, 1, 2) and trim(annotator) <> '' and query_id is not null and listing_id is not null group by all),
  edge as (select a.annotator as a, b.annotator as b, count(*) as n, avg((a.vote = b.vote)::int) as agree, (3 * avg((a.vote = b.vote)::int) - 1) / 2e0 as m
    from votes a join votes b using (query_id, listing_id) where a.annotator <> b.annotator group by all),
  solid as (select * from edge where n >= 5),
  skill as (select x.a as annotator, median(x.m * y.m / z.m) as square from solid x join solid y on x.a = y.a and x.b < y.b join solid z on z.a = x.b and z.b = y.b where z.m <> 0 group by x.a),
  met as (select a as annotator, sum(n) as shared, sum(n * agree) / sum(n) as mean_agreement, sum(n * m) as sign from edge group by a),
  raw as (select v.annotator, v.votes, coalesce(shared, 0) as shared, mean_agreement,
      case when square is not null then least(greatest((1 + 2 * sqrt(greatest(square, 0e0)) * case when sign < 0 then -1 else 1 end) / 3e0, 0.02e0), 0.98e0) end as raw
    from (select annotator, count(*) as votes from votes group by annotator) v left join met using (annotator) left join skill using (annotator)),
  trust as (select *, coalesce(raw, (select median(raw) from raw), 2e0 / 3) as accuracy, ln(2 * coalesce(raw, (select median(raw) from raw), 2e0 / 3) / (1 - coalesce(raw, (select median(raw) from raw), 2e0 / 3))) as weight from raw),
  total as (select query_id, listing_id, count(*) as n, sum(weight * (vote = 0)::int) as s0, sum(weight * (vote = 1)::int) as s1, sum(weight * (vote = 2)::int) as s2,
      count(*) filter (vote = 0) as n0, count(*) filter (vote = 1) as n1, count(*) filter (vote = 2) as n2 from votes join trust using (annotator) group by all),
  odds as (select *, exp(s0 - greatest(s0, s1, s2)) as e0, exp(s1 - greatest(s0, s1, s2)) as e1, exp(s2 - greatest(s0, s1, s2)) as e2 from total),
  shares as (select *, round(e0 / (e0 + e1 + e2), 9) as p0, round(e1 / (e0 + e1 + e2), 9) as p1, round(e2 / (e0 + e1 + e2), 9) as p2 from odds),
  best as (select *, case when p0 >= greatest(p1, p2) then 0 when p1 >= p2 then 1 else 2 end as relevance from shares)"""

ORACLE = {
    "p2_found": f"{_TRIPLETS} select query_id, listing_id, relevance from best where n >= 2",
    "p2_agreement": f"""{_TRIPLETS}, earlier as (select query_id, listing_id, max(relevance) as published from relevance_consensus group by all)
        select query_id, listing_id, relevance, n as n_annotators, round(case relevance when 0 then n0 when 1 then n1 else n2 end * 1e0 / n, 6) as agreement, round(greatest(p0, p1, p2), 6) as confidence, published
        from best left join earlier using (query_id, listing_id)""",
    "p2_annotators": f"{_TRIPLETS} select annotator, votes, shared, round(mean_agreement, 6) as mean_agreement, round(accuracy, 6) as accuracy, round(weight, 6) as weight from trust",
}
