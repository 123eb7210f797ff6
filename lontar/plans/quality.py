"""Registered queries of data quality, joins, sets and writes."""

from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.operators import quality as Q
from lontar.operators.search import mention_counts
from lontar.operators.spatial import haversine_km, nearest_place, usable, within_radius
from lontar.runtime import table

_CORE = ("id", "judul", "harga_per_bulan", "tipe", "kecamatan", "source")


def _listings(spark, folder):
    return table(spark, folder, "listings")


def _latest(spark, folder):
    """The last scrape of every id."""
    return Q.keep_last(_listings(spark, folder).select("id", "judul", "deskripsi", "harga_per_bulan", "tipe", "fasilitas", "alamat", "kecamatan", "koordinat_lat", "koordinat_lng", "source", "inserted_at", "scrape_date", "batch_id"), "id", "inserted_at", "scrape_date", "harga_per_bulan", "batch_id")


def w08_keep_last(spark, folder):
    return _latest(spark, folder).select("id", "harga_per_bulan", "inserted_at", "scrape_date", "batch_id")


def w09_keep_first_title(spark, folder):
    rows = _listings(spark, folder).where("judul is not null").select("id", "judul", "batch_id")
    return Q.keep_first(rows, F.lower(X.strip("judul")), "batch_id", "id", "judul").select("id", "judul", "batch_id")


def p03_detail(spark, folder):
    """One listing by its key: the first by code point."""
    rows = _latest(spark, folder)
    first = rows.agg(F.min("id").alias("id"))
    return rows.join(F.broadcast(first), "id").select("id", "judul", "harga_per_bulan", "tipe", "kecamatan")


def p02_search_projection(spark, folder):
    spot = F.when(F.col("koordinat_lat").isNotNull() & F.col("koordinat_lng").isNotNull(), F.concat_ws(",", F.format_string("%.5f", "koordinat_lat"), F.format_string("%.5f", "koordinat_lng")))
    return _latest(spark, folder).select("id", "judul", spot.alias("spot"))


def p05_cards(spark, folder):
    fields = (F.coalesce(F.array_join(F.slice("fasilitas", 1, 8), ", "), F.lit("")).alias("facilities"), F.substring(F.regexp_replace(F.coalesce("deskripsi", F.lit("")), "[\r\n]", " "), 1, 400).alias("text"))
    return _latest(spark, folder).select("id", *fields)


def f01_quality_filter(spark, folder):
    return _latest(spark, folder).where((X.word_count("deskripsi") >= 1) & (X.strip("judul") != "")).select("id")


def f02_filters(spark, folder):
    rows = _latest(spark, folder).where((F.col("harga_per_bulan") >= 500_000) & (F.col("harga_per_bulan") <= 1_500_000) & (F.col("tipe") == "putri") & F.col("kecamatan").ilike("%rawa%"))
    return rows.select("id", "harga_per_bulan", "kecamatan")


def _gates():
    return {
        "title": F.coalesce(X.strip("judul"), F.lit("")) == "",
        "description": X.word_count("deskripsi") < 5,
        "type": ~F.lower(F.coalesce("tipe", F.lit(""))).isin("putra", "putri", "campur"),
        "position": ~usable(F.col("koordinat_lat"), F.col("koordinat_lng")),
    }


def f05_gates(spark, folder):
    return _latest(spark, folder).select("id", Q.first_failure(_gates()).alias("reason"))


def a28_audit(spark, folder):
    return Q.audit(_latest(spark, folder), _gates())


def f06_shared_aliases(spark, folder):
    """Aliases that more than one place has."""
    pairs = table(spark, folder, "gazetteer").select("name", F.explode("aliases").alias("alias"))
    return pairs.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("name").alias("places")).where("places > 1")


def f09_domain_flags(spark, folder):
    bad = {"type": ~F.lower("tipe").isin("putra", "putri", "campur"), "distance": ~F.col("jarak_kampus_km").between(0, 50), "latitude": F.abs("koordinat_lat") > 90}
    rows = _listings(spark, folder)
    return rows.agg(*(F.sum(F.coalesce(b, F.lit(False)).cast("bigint")).alias(f"bad_{n}") for n, b in bad.items()))


def j01_hydrate(spark, folder):
    """Judged pairs with the listing's row, of listings that exist."""
    pairs = table(spark, folder, "relevance_consensus").distinct()
    return pairs.join(_latest(spark, folder).select(F.col("id").alias("listing_id"), "judul", "tipe"), "listing_id")


def j02_semi(spark, folder):
    labelled = table(spark, folder, "relevance_labels").select(F.col("listing_id").alias("id"))
    return _latest(spark, folder).join(labelled, "id", "left_semi").select("id", "source")


def j03_anti(spark, folder):
    labelled = table(spark, folder, "relevance_labels").select(F.col("listing_id").alias("id"))
    return _latest(spark, folder).join(labelled, "id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def _located(spark, folder):
    return _latest(spark, folder).select("id", "koordinat_lat", "koordinat_lng")


def j08_nearest(spark, folder):
    """The nearest of all places for every listing, by name among equals."""
    near = nearest_place(_located(spark, folder), table(spark, folder, "gazetteer"), lat="koordinat_lat", lng="koordinat_lng")
    return near.select("id", "name", F.round("km", 2).alias("km"))


def j09_within(spark, folder):
    """Listings within 2 km of every place that has any."""
    places = table(spark, folder, "gazetteer").withColumn("radius_km", F.lit(2.0))
    return within_radius(_located(spark, folder), places, lat="koordinat_lat", lng="koordinat_lng").groupBy("name").agg(F.count("*").alias("n"))


def x24_haversine(spark, folder):
    km = haversine_km(F.col("koordinat_lat"), F.col("koordinat_lng"), F.lit(-5.3645), F.lit(105.2434))
    return _latest(spark, folder).where(usable(F.col("koordinat_lat"), F.col("koordinat_lng"))).select("id", F.round(km, 6).alias("km"), F.round(1 / (1 + km), 6).alias("nearness"))


def a02_statistics(spark, folder):
    rows = _latest(spark, folder)
    by = rows.groupBy(F.coalesce(F.nullif("kecamatan", F.lit("")), F.lit("?")).alias("district")).agg(F.count("*").alias("n"), F.min("harga_per_bulan").alias("least"), F.max("harga_per_bulan").alias("most"), F.avg("harga_per_bulan").cast("bigint").alias("mean"))
    return by


def a06_top_facilities(spark, folder):
    values = _latest(spark, folder).select(F.explode("fasilitas").alias("facility"))
    return values.groupBy("facility").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "facility").limit(20)


def a07_mentions(spark, folder):
    """Listings whose description names a place, by its name or any alias; a place needs no position for that."""
    return mention_counts(_latest(spark, folder).select(F.col("deskripsi").alias("text")), table(spark, folder, "gazetteer"))


def a08_describe(spark, folder):
    d = Q.describe(_latest(spark, folder), "harga_per_bulan")
    return d.select("n", *(F.round(c, 3).alias(c) for c in d.columns[1:]))


def a09_histogram(spark, folder):
    return Q.histogram(_latest(spark, folder).where("harga_per_bulan between 100000 and 5000000"), "harga_per_bulan", 25)


def a13_null_counts(spark, folder):
    return Q.null_counts(_listings(spark, folder).select("id", "judul", "deskripsi", "harga_per_bulan", "tipe", "fasilitas", "alamat", "kecamatan", "koordinat_lat", "url_source"))


def a14_duplicates(spark, folder):
    return Q.duplicate_keys(_listings(spark, folder), "id")


def a14_surplus(spark, folder):
    return Q.surplus_rows(table(spark, folder, "relevance_labels"), "query_id", "listing_id", "annotator")


def a15_mean_std(spark, folder):
    return _latest(spark, folder).groupBy("source").agg(F.round(F.avg("koordinat_lat"), 6).alias("mean"), F.round(F.when(F.count("koordinat_lat") >= 2, F.stddev_samp("koordinat_lat")), 6).alias("std"))


def a17_distinct(spark, folder):
    return _listings(spark, folder).agg(F.count_distinct("id").alias("ids"), F.count_distinct("source").alias("sources"), F.count_distinct("alamat").alias("addresses"))


def a18_quality_score(spark, folder):
    """Weighted shares of complete, valid, consistent and unique rows."""
    rows = _listings(spark, folder)
    kinds = dict(rows.dtypes)
    fields = ("judul", "deskripsi", "harga_per_bulan", "tipe", "fasilitas", "alamat", "kecamatan", "url_source")
    complete = sum(((~Q.missing(c, kinds[c])).cast("double") for c in fields), F.lit(0.0)) / len(fields)
    valid = F.lower(F.coalesce("tipe", F.lit(""))).isin("putra", "putri", "campur").cast("double")
    consistent = usable(F.col("koordinat_lat"), F.col("koordinat_lng")).cast("double")
    d = rows.agg(F.avg(complete).alias("c"), F.avg(valid).alias("v"), F.avg(consistent).alias("k"), (F.count_distinct("id") / F.count("*")).alias("u"))
    score = 100 * (0.30 * F.col("c") + 0.20 * F.col("v") + 0.25 * F.col("k") + 0.25 * F.col("u"))
    return d.select(*(F.round(x, 6).alias(n) for x, n in (("c", "complete"), ("v", "valid"), ("k", "consistent"), ("u", "unique_ids"))), F.round(score, 4).alias("score"))


def a20_presence(spark, folder):
    """Presence of positions and addresses per batch, beside the audit report."""
    rows = _latest(spark, folder)
    share = lambda c: F.round(100 * F.avg(F.col(c).isNotNull().cast("double")), 4)
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), share("koordinat_lat").alias("lat_pct"), share("alamat").alias("address_pct"))


def a22_digest(spark, folder):
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("id", "harga_per_bulan", "tipe")), F.coalesce(F.array_join("fasilitas", ","), F.lit("")))
    return Q.digest(_listings(spark, folder), line)


def a29_reasons(spark, folder):
    first = F.element_at(F.split(F.coalesce("notes", F.lit("none")), " "), 1)
    return table(spark, folder, "relevance_labels").groupBy(first.alias("word")).agg(F.count("*").alias("n"))


def t02_tie_break(spark, folder):
    """The 50 listings nearest the town's middle, the cheaper first among equals at two decimals, unknown prices last."""
    km = F.round(haversine_km(F.col("koordinat_lat"), F.col("koordinat_lng"), F.lit(-5.3645), F.lit(105.2434)), 2)
    rows = _latest(spark, folder).where(usable(F.col("koordinat_lat"), F.col("koordinat_lng"))).select("id", km.alias("km"), "harga_per_bulan")
    return rows.orderBy("km", F.coalesce("harga_per_bulan", F.lit(10**12)), "id").limit(50)


def u03_intersection(spark, folder):
    return table(spark, folder, "relevance_labels").select("query_id", "listing_id").intersect(table(spark, folder, "relevance_consensus").select("query_id", "listing_id"))


def u04_difference(spark, folder):
    return table(spark, folder, "relevance_labels").select("query_id", "listing_id").subtract(table(spark, folder, "relevance_consensus").select("query_id", "listing_id"))


def j15_alignment(spark, folder):
    """How the ids of two tables overlap."""
    a = table(spark, folder, "documents").where("listing_id is not null").select(F.col("listing_id").alias("id"))
    return Q.truncate_plan(_listings(spark, folder), a, "id")


def u06_union_sources(spark, folder):
    one = _listings(spark, folder).select("source", F.lit("listings").alias("kind"))
    two = table(spark, folder, "documents").select("source", F.lit("documents").alias("kind"))
    return one.unionByName(two).groupBy("kind", "source").agg(F.count("*").alias("n"))


def s14_replace_group(spark, folder):
    rows = _latest(spark, folder).select("id", "source", "harga_per_bulan")
    new = rows.where("source = 'kostara'").withColumn("harga_per_bulan", F.lit(1).cast("bigint"))
    return Q.replace_group(rows, new, "source", "kostara")


def s15_upsert(spark, folder):
    rows = _latest(spark, folder).select("id", "source", "harga_per_bulan")
    fresh = rows.where("source = 'staynest'").select("id", F.lit("staynest-2").alias("source"), "harga_per_bulan")
    added = rows.where("source = 'hunimuda'").select(F.concat("id", F.lit("-copy")).alias("id"), "source", "harga_per_bulan")
    return Q.upsert(rows, fresh.unionByName(added), "id")


def s17_truncate_plan(spark, folder):
    keep = _listings(spark, folder).where("source <> 'koskita'")
    return Q.truncate_plan(_listings(spark, folder), keep, "id")


def s19_counts(spark, folder):
    out = None
    for name in ("listings", "relevance_labels", "queries"):
        one = table(spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def st1_trailing_count(spark, folder):
    """Events of the same user in the hour up to each event."""
    return Q.trailing_count(table(spark, folder, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600).select("event_id", "in_window")


QUERIES = {f.__name__: f for k, f in list(globals().items()) if k[0] in "pfjwxatus" and "_" in k and k.split("_")[0][-1].isdigit() and callable(f)}

_LAST = """last as (select id, unnest(arg_max(struct_pack(judul, deskripsi, harga_per_bulan, tipe, fasilitas, alamat, kecamatan, koordinat_lat, koordinat_lng, source, inserted_at, scrape_date, batch_id),
  {'a': coalesce(inserted_at, timestamp '1000-01-01'), 'b': coalesce(scrape_date, date '1000-01-01'), 'c': coalesce(harga_per_bulan, -1), 'd': batch_id})) from listings group by id)"""
_OK = "koordinat_lat is not null and koordinat_lng is not null and abs(koordinat_lat) <= 90"
_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_JUDUL = f"regexp_replace(judul, '^{_WS}+|{_WS}+$', '', 'g')"
_WORDS = f"len(list_filter(regexp_split_to_array(coalesce(deskripsi, ''), '{_WS}+'), lambda x: x <> ''))"
_KM = "2 * 6371e0 * asin(least(1e0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_HERE = _KM.format(a="koordinat_lat", b="koordinat_lng", c="-5.3645e0", d="105.2434e0")
_THERE = _KM.format(a="koordinat_lat", b="koordinat_lng", c="lat", d="lng")
_PLACES = "places as (select name, lat, lng from gazetteer where lat is not null and lng is not null and abs(lat) <= 90)"
_REASON = f"""case when coalesce({_JUDUL}, '') = '' then 'title' when {_WORDS} < 5 then 'description' when lower(coalesce(tipe, '')) not in ('putra', 'putri', 'campur') then 'type' when not ({_OK}) then 'position' end"""
_HAVE = "select count(*) filter (in_a) as current, count(*) filter (in_a and in_b) as kept, count(*) filter (not in_b) as removed, count(*) filter (not in_a) as added from (select a.id is not null as in_a, b.id is not null as in_b from a full join b using (id))"

ORACLE = {
    "w08_keep_last": f"with {_LAST} select id, harga_per_bulan, inserted_at, scrape_date, batch_id from last",
    "w09_keep_first_title": f"select r.id, r.judul, r.batch_id from (select arg_min(struct_pack(id, judul, batch_id), struct_pack(a := batch_id, b := id, c := judul)) as r from listings where judul is not null group by lower({_JUDUL}))",
    "p03_detail": f"with {_LAST} select id, judul, harga_per_bulan, tipe, kecamatan from last where id = (select min(id) from last)",
    "p02_search_projection": f"with {_LAST} select id, judul, case when koordinat_lat is not null and koordinat_lng is not null then printf('%.5f', koordinat_lat) || ',' || printf('%.5f', koordinat_lng) end as spot from last",
    "p05_cards": f"with {_LAST} select id, coalesce(array_to_string(fasilitas[1:8], ', '), '') as facilities, substr(regexp_replace(coalesce(deskripsi, ''), '[\\r\\n]', ' ', 'g'), 1, 400) as text from last",
    "f01_quality_filter": f"with {_LAST} select id from last where {_WORDS} >= 1 and {_JUDUL} <> ''",
    "f02_filters": f"with {_LAST} select id, harga_per_bulan, kecamatan from last where harga_per_bulan between 500000 and 1500000 and tipe = 'putri' and kecamatan ilike '%rawa%'",
    "f05_gates": f"with {_LAST} select id, {_REASON} as reason from last",
    "a28_audit": f"with {_LAST} select coalesce({_REASON}, 'accepted') as reason, count(*) as n from last group by 1",
    "f06_shared_aliases": "select lower(alias) as alias, count(distinct name) as places from (select name, unnest(aliases) as alias from gazetteer) group by 1 having count(distinct name) > 1",
    "f09_domain_flags": "select count(*) filter (lower(tipe) not in ('putra', 'putri', 'campur')) as bad_type, count(*) filter (not (jarak_kampus_km between 0 and 50)) as bad_distance, count(*) filter (abs(koordinat_lat) > 90) as bad_latitude from listings",
    "j01_hydrate": f"with {_LAST} select distinct c.query_id, c.listing_id, c.relevance, l.judul, l.tipe from relevance_consensus c join last l on l.id = c.listing_id",
    "j02_semi": f"with {_LAST} select id, source from last where id in (select listing_id from relevance_labels)",
    "j03_anti": f"with {_LAST} select source, count(*) as n from last where id not in (select listing_id from relevance_labels where listing_id is not null) group by source",
    "j08_nearest": f"with {_LAST}, {_PLACES}, f as (select id, name, round({_THERE}, 6) as km from last, places where {_OK}) select id, arg_min(name, struct_pack(k := km, n := name)) as name, round(min(km), 2) as km from f group by id",
    "j09_within": f"with {_LAST}, {_PLACES} select name, count(*) as n from last, places where {_OK} and {_THERE} <= 2 group by name",
    "x24_haversine": f"with {_LAST} select id, round({_HERE}, 6) as km, round(1 / (1 + {_HERE}), 6) as nearness from last where {_OK}",
    "a02_statistics": f"with {_LAST} select coalesce(nullif(kecamatan, ''), '?') as district, count(*) as n, min(harga_per_bulan) as least, max(harga_per_bulan) as most, cast(trunc(avg(harga_per_bulan)) as bigint) as mean from last group by 1",
    "a06_top_facilities": f"with {_LAST} select facility, count(*) as n from (select unnest(fasilitas) as facility from last) group by 1 order by 2 desc, 1 limit 20",
    "a07_mentions": f"with {_LAST}, forms as (select name, lower(name) as form from gazetteer union select name, lower(a) from (select name, unnest(aliases) as a from gazetteer)) select name, count(distinct id) as n from last join forms on form <> '' and contains(lower(deskripsi), form) group by 1",
    "a08_describe": f"with {_LAST}, p as (select cast(harga_per_bulan as double) as x from last) select count(x) as n, round(avg(x), 3) as mean, round(stddev_samp(x), 3) as std, round(min(x), 3) as least, round(quantile_cont(x, 0.25), 3) as q1, round(quantile_cont(x, 0.5), 3) as q2, round(quantile_cont(x, 0.75), 3) as q3, round(max(x), 3) as most from p",
    "a09_histogram": f"with {_LAST}, p as (select cast(harga_per_bulan as double) as x from last where harga_per_bulan between 100000 and 5000000), e as (select min(x) as lo, max(x) as hi from p) select cast(least(floor((x - lo) / ((hi - lo) / 25)), 24) as bigint) as bin, count(*) as n from p, e group by 1",
    "a13_null_counts": " union all ".join(f"select '{c}' as field, count(*) filter ({c} is null{t}) as n_missing from listings" for c, t in (("id", " or id = ''"), ("judul", " or judul = ''"), ("deskripsi", " or deskripsi = ''"), ("harga_per_bulan", ""), ("tipe", " or tipe = ''"), ("fasilitas", " or len(fasilitas) = 0"), ("alamat", " or alamat = ''"), ("kecamatan", " or kecamatan = ''"), ("koordinat_lat", ""), ("url_source", " or url_source = ''"))),
    "a14_duplicates": "select id, count(*) as n from listings group by id having count(*) > 1",
    "a14_surplus": "select cast(sum(n - 1) as bigint) as surplus from (select count(*) as n from relevance_labels group by query_id, listing_id, annotator)",
    "a15_mean_std": f"with {_LAST} select source, round(avg(koordinat_lat), 6) as mean, round(case when count(koordinat_lat) >= 2 then stddev_samp(koordinat_lat) end, 6) as std from last group by source",
    "a17_distinct": "select count(distinct id) as ids, count(distinct source) as sources, count(distinct alamat) as addresses from listings",
    "a18_quality_score": f"""with d as (select avg(((judul <> '' and judul is not null)::int + (deskripsi <> '' and deskripsi is not null)::int + (harga_per_bulan is not null)::int + (tipe <> '' and tipe is not null)::int + (fasilitas is not null and len(fasilitas) > 0)::int
        + (alamat <> '' and alamat is not null)::int + (kecamatan <> '' and kecamatan is not null)::int + (url_source <> '' and url_source is not null)::int) / 8e0) as c, avg((lower(coalesce(tipe, '')) in ('putra', 'putri', 'campur'))::int) as v, avg(({_OK})::int) as k, count(distinct id) * 1e0 / count(*) as u from listings)
        select round(c, 6) as complete, round(v, 6) as valid, round(k, 6) as consistent, round(u, 6) as unique_ids, round(100 * (0.30e0 * c + 0.20e0 * v + 0.25e0 * k + 0.25e0 * u), 4) as score from d""",
    "a20_presence": f"with {_LAST} select batch_id, count(*) as n, round(100 * avg((koordinat_lat is not null)::int), 4) as lat_pct, round(100 * avg((alamat is not null)::int), 4) as address_pct from last group by batch_id",
    "a22_digest": """with l as (select sha256(concat_ws('|', coalesce(id, 'None'), coalesce(cast(harga_per_bulan as varchar), 'None'), coalesce(tipe, 'None'), coalesce(array_to_string(fasilitas, ','), ''))) as h from listings),
        b as (select substr(h, 1, 3) as b, sha256(string_agg(h, chr(10) order by h)) as s, count(*) as n from l group by 1) select cast(sum(n) as bigint) as n, sha256(string_agg(s, chr(10) order by b)) as digest from b""",
    "a29_reasons": "select string_split(coalesce(notes, 'none'), ' ')[1] as word, count(*) as n from relevance_labels group by 1",
    "t02_tie_break": f"with {_LAST} select id, round({_HERE}, 2) as km, harga_per_bulan from last where {_OK} order by 2, coalesce(harga_per_bulan, 1000000000000), id limit 50",
    "u03_intersection": "select query_id, listing_id from relevance_labels intersect select query_id, listing_id from relevance_consensus",
    "u04_difference": "select query_id, listing_id from relevance_labels except select query_id, listing_id from relevance_consensus",
    "j15_alignment": f"with a as (select distinct id from listings), b as (select distinct listing_id as id from documents where listing_id is not null) {_HAVE}",
    "u06_union_sources": "select 'listings' as kind, source, count(*) as n from listings group by all union all select 'documents', source, count(*) from documents group by all",
    "s14_replace_group": f"with {_LAST} select id, source, case when source = 'kostara' then 1 else harga_per_bulan end as harga_per_bulan from last",
    "s15_upsert": f"with {_LAST} select id, case when source = 'staynest' then 'staynest-2' else source end as source, harga_per_bulan from last union all select id || '-copy', source, harga_per_bulan from last where source = 'hunimuda'",
    "s17_truncate_plan": f"with a as (select distinct id from listings), b as (select distinct id from listings where source <> 'koskita') {_HAVE}",
    "s19_counts": "select 'listings' as name, count(*) as n from listings union all select 'relevance_labels', count(*) from relevance_labels union all select 'queries', count(*) from queries",
    "st1_trailing_count": "select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as in_window from events",
}
