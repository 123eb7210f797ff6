"""Registered queries of readers, pages and the limiter, on inputs derived from whole tables."""

from pyspark.sql import functions as F

from lontar.runtime import table
from lontar.sources import pages as P
from lontar.sources import readers as S
from lontar.streaming.limiter import limit_batch


def _raw(spark, folder):
    """Distinct listings as raw rows, coordinates in a list."""
    columns = ("id", "judul", "harga_per_bulan", "tipe", "fasilitas", "kecamatan", "koordinat_lat", "koordinat_lng", "url_source", "scrape_date", "source")
    return table(spark, folder, "listings").select(*columns).distinct()


def _json(spark, folder):
    """Distinct listings as JSON lines; those of one source are cut short, so they are malformed."""
    line = F.to_json(F.struct("id", "judul", "harga_per_bulan", "tipe", "fasilitas", F.array("koordinat_lat", "koordinat_lng").alias("koordinat"), "url_source", F.col("scrape_date").cast("string").alias("scrape_date"), "source"))
    return _raw(spark, folder).select(F.when(F.col("source") == "kostara", F.substring(line, 1, 20)).otherwise(line).alias("value"))


def s01_tolerant_lines(spark, folder):
    return S.tolerant_lines(_json(spark, folder), S.LISTING).select("id", "judul", "harga_per_bulan", F.col("koordinat")[0].alias("lat"))


def s01_malformed(spark, folder):
    return S.parse_lines(_json(spark, folder), S.LISTING).agg(F.count("*").alias("n"), F.count("corrupt").alias("malformed"))


def p01_to_listing(spark, folder):
    rows = S.to_listing(S.tolerant_lines(_json(spark, folder), S.LISTING))
    return rows.select("id", "koordinat_lat", "koordinat_lng", "scrape_date", F.size("fasilitas").cast("bigint").alias("n_facilities"), "source")


def s33_new_rows(spark, folder):
    rows = _raw(spark, folder)
    return S.new_rows(rows, rows.where("source in ('koskita', 'rumahsewa')")).groupBy("source").agg(F.count("*").alias("n"))


def _pages(spark, folder):
    """A category page per source, linking to its listings."""
    rows = _raw(spark, folder).where("url_source is not null").select("source", "id").distinct()
    links = rows.select("source", F.concat(F.lit('<a class="x" href="/room/'), "id", F.lit('">'), "id", F.lit("</a>")).alias("a"))
    body = F.array_join(F.array_sort(F.collect_list("a")), "\n")
    return links.groupBy("source").agg(body.alias("body"), F.count("*").alias("n")).select(F.concat(F.lit("https://portal.example/"), "source").alias("url"), F.concat(F.lit("<html><head><title>Kos "), "source", F.lit("</title></head><body><h1>Tersedia "), "n", F.lit(" Kost</h1>"), "body", F.lit("</body></html>")).alias("html"))


def s29_listing_urls(spark, folder):
    return _pages(spark, folder).select("url", F.explode(P.listing_urls(F.col("html"), "https://portal.example")).alias("link"))


def s34_category(spark, folder):
    return P.category(_pages(spark, folder)).select("url", "title", "n_available", "h1")


def s31_s32_details(spark, folder):
    """Rows read back from objects embedded in pages."""
    rows = _raw(spark, folder).groupBy("id").agg(F.min("judul").alias("judul"), F.min("koordinat_lat").alias("lat"), F.min("koordinat_lng").alias("lng"))
    thing = F.to_json(F.struct(F.col("id").alias("_id"), F.col("judul").alias("room_title"), F.lit(1).alias("gender"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))
    page = rows.select(F.concat(F.lit("https://portal.example/room/"), "id").alias("url"), F.concat(F.lit("<script>var detail = "), thing, F.lit("; var other = {};</script>")).alias("html"))
    return P.details(page).select("id", "judul", "tipe", "koordinat_lat", "koordinat_lng")


def st1_limiter(spark, folder):
    """At most two events of a user in an hour."""
    events = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("client"), "event_id", "ts")
    return limit_batch(events, 2, 3600).select("event_id", "accepted")


QUERIES = {f.__name__: f for f in (s01_tolerant_lines, s01_malformed, p01_to_listing, s33_new_rows, s29_listing_urls, s34_category, s31_s32_details, st1_limiter)}

_RAW = "raw as (select distinct id, judul, harga_per_bulan, tipe, fasilitas, kecamatan, koordinat_lat, koordinat_lng, url_source, scrape_date, source from listings)"
ORACLE = {
    "s01_tolerant_lines": f"with {_RAW} select id, judul, harga_per_bulan, koordinat_lat as lat from raw where source <> 'kostara'",
    "s01_malformed": f"with {_RAW} select count(*) as n, count(*) filter (source = 'kostara') as malformed from raw",
    "p01_to_listing": f"with {_RAW} select id, koordinat_lat, koordinat_lng, scrape_date, coalesce(len(fasilitas), 0) as n_facilities, source from raw where source <> 'kostara'",
    "s33_new_rows": f"with {_RAW} select source, count(*) as n from raw where url_source is null or url_source not in (select url_source from raw where source in ('koskita', 'rumahsewa') and url_source is not null) group by source",
    "s29_listing_urls": f"with {_RAW} select distinct 'https://portal.example/' || source as url, 'https://portal.example/room/' || id as link from raw where url_source is not null",
    "s34_category": f"with {_RAW} select 'https://portal.example/' || source as url, 'Kos ' || source as title, count(distinct id) as n_available, 'Tersedia ' || count(distinct id) || ' Kost' as h1 from raw where url_source is not null group by source",
    "s31_s32_details": f"with {_RAW}, g as (select id, min(judul) as judul, min(koordinat_lat) as a, min(koordinat_lng) as b from raw group by id) select 'page-' || id as id, judul, 'putra' as tipe, case when b is not null then a end as koordinat_lat, case when a is not null then b end as koordinat_lng from g",
}
