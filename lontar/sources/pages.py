"""Extraction from crawled pages (url, html), as column expressions; an Arrow function only where braces must be balanced."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions import text as X

# Fixed value: tenant types by their code in embedded objects.
GENDERS = {0: "campur", 1: "putra", 2: "putri", 3: "campur"}


def is_shell(html: Column) -> Column:
    """Whether a page has so little text that it is an empty shell to be filled by scripts."""
    return F.length(X.strip_html(html)) < 500


def listing_urls(html: Column, base: str, part: str = "/room/") -> Column:
    """The addresses of a page's links that contain ``part``, absolute, each once, in order."""
    links = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    wanted = F.filter(links, lambda u: F.contains(u, F.lit(part)))
    return F.array_distinct(F.transform(wanted, lambda u: F.when(F.startswith(u, F.lit("/")), F.concat(F.lit(base.rstrip("/")), u)).otherwise(u)))


def sitemap_urls(xml: Column, pattern: str) -> Column:
    """The locations of a sitemap that match ``pattern``; a document that is no XML has none."""
    return F.filter(F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)), lambda u: u.rlike(pattern))


def slugs(urls: Column) -> Column:
    """Addresses without query and fragment, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(urls, lambda u: F.substring_index(F.substring_index(u, "?", 1), "#", 1))))


def category(pages: DataFrame) -> DataFrame:
    """(url, title, n_available, description, h1, breadcrumb): what a category page says of itself."""
    def first(pattern: str) -> Column:
        return F.nullif(X.strip_html(F.regexp_extract("html", pattern, 1)), F.lit(""))

    data = F.regexp_extract("html", r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    crumbs = F.from_json(data, "itemListElement array<struct<position int, name string>>")
    return pages.select(
        "url", first(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), F.regexp_extract("html", r"(?i)tersedia\s+([0-9]+)\s+kos", 1).try_cast("bigint").alias("n_available"),
        first(r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""").alias("description"), first(r"(?is)<h1[^>]*>(.*?)</h1>").alias("h1"),
        F.array_join(F.transform(F.array_sort(crumbs.itemListElement), lambda c: c["name"]), " > ").alias("breadcrumb"),
    )


def balanced(text: str, start: int = 0) -> str | None:
    """The object that opens at ``start``, up to its matching brace; quotes and escapes are respected. None if it has no end."""
    depth, quote, k = 0, None, start
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = None
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : k + 1]
        k += 1
    return None


def embedded_object(html: Column, name: str = "detail") -> Column:
    """The JSON text assigned to ``var name`` in a page, null if there is none or it does not end."""

    @F.pandas_udf("string")
    def cut(tails: pd.Series) -> pd.Series:
        return tails.map(lambda s: balanced(s) if s and s.startswith("{") else None)

    return cut(F.regexp_extract(html, rf"(?s)var\s+{name}\s*=\s*(\{{.*)", 1))


_NAMED = ("fac_room", "fac_share", "fac_bath", "fac_park", "fac_near")


def _names(v: Column, field: str) -> Column:
    """Strings or the names of objects in an array of a variant."""
    plain = F.try_variant_get(v, f"$.{field}", "array<string>")
    named = F.try_variant_get(v, f"$.{field}", "array<struct<name string>>")
    return F.coalesce(F.transform(named, lambda x: x["name"]), plain, F.array().cast("array<string>"))


def details(pages: DataFrame) -> DataFrame:
    """Rows of the embedded objects of detail pages: id, title, tenant type, position, size, facilities, verified.

    Missing fields are null; coordinates count only if both are numbers; pages without an object have no row.
    """
    rows = pages.select("url", F.try_parse_json(embedded_object(F.col("html"))).alias("v")).where("v is not null")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kinds = F.create_map(*(F.lit(x) for k in GENDERS.items() for x in k))
    lat, lng = get("$.latitude", "double"), get("$.longitude", "double")
    flags = [F.coalesce(get(f"$.verification_status.{f}", "boolean"), F.lit(False)) for f in ("is_verified_address", "is_verified_phone", "is_visited")]
    facilities = F.array_distinct(F.filter(F.transform(F.concat(*(_names(F.col("v"), f) for f in _NAMED)), lambda f: F.lower(F.trim(f))), lambda f: f.isNotNull() & (f != "")))
    width, length = get("$.room_type.width", "string"), get("$.room_type.length", "string")
    return rows.select(
        F.concat(F.lit("page-"), get("$._id", "string")).alias("id"), get("$.room_title", "string").alias("judul"), kinds[get("$.gender", "int")].alias("tipe"),
        F.when(lat.isNotNull() & lng.isNotNull(), lat).alias("koordinat_lat"), F.when(lat.isNotNull() & lng.isNotNull(), lng).alias("koordinat_lng"),
        F.when(width.isNotNull() & length.isNotNull(), F.concat_ws(" ", width, F.lit("x"), length, F.lit("meter"))).alias("room_size"),
        facilities.alias("fasilitas"), (flags[0] | flags[1] | flags[2]).alias("verified"), F.col("url").alias("url_source"),
    )


def card(text: Column, districts: list[str]) -> Column:
    """A category card's text as struct(tipe, kecamatan, harga, judul): badge, longest known district, price, and the title
    before any price."""
    low = F.lower(text)
    place = F.lit(None).cast("string")
    for d in sorted(districts, key=len):
        place = F.when(F.contains(low, F.lit(d.lower())), d).otherwise(place)
    price = F.regexp_replace(F.regexp_extract(text, r"(?i)rp ?([\d.,]+)", 1), "[.,]", "").try_cast("bigint")
    title = X.normalize_whitespace(F.regexp_replace(text, r"(?is)\brp ?[\d.,]+.*$", ""))
    return F.struct(X.detect_tenant(text).alias("tipe"), place.alias("kecamatan"), price.alias("harga"), title.alias("judul"))


def crawl(pages: DataFrame, seeds: list[str], base: str, most: int | None = None) -> DataFrame:
    """(url, html): the detail pages that the seed pages link to, each once, at most ``most`` by address."""
    links = pages.where(F.col("url").isin(*seeds)).select(F.explode(listing_urls(F.col("html"), base)).alias("url")).distinct()
    found = pages.join(links, "url", "left_semi")
    return found if most is None else found.orderBy("url").limit(most)
