"""Registered queries of the text functions, over all listings or documents."""

from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.functions import vocabulary as V
from lontar.runtime import table


def _listings(spark, folder, *columns):
    """Distinct rows of listings, projected."""
    return table(spark, folder, "listings").select("id", *columns).distinct()


def _documents(spark, folder, *columns):
    return table(spark, folder, "documents").select("doc_id", *columns)


def x01_strip_html(spark, folder):
    return _documents(spark, folder, X.strip_html("text").alias("plain"))


def x02_normalize_whitespace(spark, folder):
    return _documents(spark, folder, X.normalize_whitespace("text").alias("clean"))


def x03_lowercase(spark, folder):
    return _listings(spark, folder, X.lowercase("judul").alias("low"))


def x04_prices(spark, folder):
    return _listings(spark, folder, F.concat_ws(",", X.extract_prices("deskripsi").cast("array<string>")).alias("prices"))


def x05_first_price(spark, folder):
    return _listings(spark, folder, X.extract_price("deskripsi").alias("price"))


def x07_jargon(spark, folder):
    return _listings(spark, folder, X.apply_jargon(X.lowercase("judul")).alias("written_out"))


def x08_spelling(spark, folder):
    return _listings(spark, folder, X.correct_spelling(X.lowercase("deskripsi")).alias("corrected"))


def x09_tokens(spark, folder):
    return _documents(spark, folder, F.concat_ws(" ", X.tokenize("text")).alias("tokens"))


def x10_stopwords(spark, folder):
    return _documents(spark, folder, F.concat_ws(" ", X.remove_stopwords(X.tokenize(X.lowercase("text")))).alias("kept"))


def x13_lexical_text(spark, folder):
    return _listings(spark, folder, X.compose_lexical("judul", "kecamatan", "fasilitas", "deskripsi").alias("lexical"))


def x14_natural_text(spark, folder):
    return _listings(spark, folder, X.compose_natural("judul", "kecamatan", "fasilitas", "deskripsi").alias("natural"))


def x15_tenant(spark, folder):
    return _listings(spark, folder, X.detect_tenant("judul").alias("tenant"))


def x16_facilities(spark, folder):
    return _listings(spark, folder, F.concat_ws("|", X.normalize_facilities("fasilitas")).alias("facilities"))


def x17_clean_facilities(spark, folder):
    return _listings(spark, folder, F.concat_ws("|", X.clean_facilities("fasilitas")).alias("facilities"))


def x20_clean_lines(spark, folder):
    return _documents(spark, folder, X.clean_lines("text").alias("clean"))


def x21_word_count(spark, folder):
    return _documents(spark, folder, X.word_count("text").cast("bigint").alias("words"))


def x22_truncate(spark, folder):
    return _documents(spark, folder, X.truncate("text", 200).alias("short"))


def x23_district(spark, folder):
    return _listings(spark, folder, X.strip_district("kecamatan").alias("district"))


def x33_rupiah(spark, folder):
    return _listings(spark, folder, X.format_rupiah("harga_per_bulan").alias("shown"))


def x34_id_from_url(spark, folder):
    return _listings(spark, folder, X.id_from_url("url_source").alias("url_id"))


def s26_cache_key(spark, folder):
    return _listings(spark, folder, X.cache_key("portal", "url_source").alias("key"))


def x37_short_shell(spark, folder):
    return _documents(spark, folder, (F.length(X.strip_html("text")) < 500).alias("shell"))


def a03_vocabulary(spark, folder):
    """Distinct terms of the corpus."""
    return _documents(spark, folder, F.explode(X.tokenize(X.lowercase("text"))).alias("term")).agg(F.count_distinct("term").alias("terms"))


def a04_token_counts(spark, folder):
    n = F.size(X.tokenize("text")).cast("bigint")
    return _documents(spark, folder, n.alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] in "xsa" and k[1:3].isdigit()}

_L = "(select distinct id, {} from listings)"
_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _clean(x):
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"


def _strip(x):
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _chain(x, rules):
    for a, b in rules:
        x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'g')"
    return x


def _plain(x):
    bare = f"regexp_replace(coalesce({x}, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')"
    bare = f"regexp_replace({bare}, '<[a-zA-Z/!?][^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return _clean(bare)


def _listed(words):
    return ", ".join(f"'{w}'" for w in words)


def _facility(v):
    cases = " ".join("when " + " or ".join(f"contains({v}, '{w}')" for w in words) + f" then '{name}'" for name, words in V.FACILITY_ALIASES.items())
    return f"case {cases} else {v} end"


def _once(x):
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_MONEY = r"list_transform(regexp_extract_all(d, '(?i)(\d+(?:[.,]\d+)?)\s*(?:{})\b', 1), lambda x: cast(trunc(cast(replace(x, ',', '.') as double) * {}) as bigint))"
_RP = r"list_transform(regexp_extract_all(d, '(?i)rp\s*([\d.,]+)', 1), lambda x: try_cast(regexp_replace(x, '[.,]', '', 'g') as bigint))"
_ESC = str.maketrans({"-": "\\-"})

ORACLE = {
    "x01_strip_html": f"select doc_id, {_plain('text')} as plain from documents",
    "x02_normalize_whitespace": f"select doc_id, {_clean('text')} as clean from documents",
    "x03_lowercase": "select distinct id, lower(coalesce(judul, '')) as low from listings",
    "x04_prices": f"""with t as (select distinct id, coalesce(deskripsi, '') as d from listings),
        p as (select id, list_concat({_MONEY.format('jt|juta', 1000000)}, {_MONEY.format('k|rb|ribu', 1000)}, list_filter({_RP}, lambda x: x >= 10000)) as a from t)
        select distinct id, array_to_string({_once('a')}, ',') as prices from p""",
    "x05_first_price": r"""with t as (select distinct id, deskripsi as d from listings), f as (
        select id, d, regexp_extract(d, '(?i)rp\s*([\d.,]+)', 1) as a, regexp_extract(d, '(?i)(\d+(?:[.,]\d+)?)\s*jt\b', 1) as b,
               regexp_extract(d, '(?i)(\d+(?:[.,]\d+)?)\s*(?:k|rb|ribu)\b', 1) as c from t)
        select distinct id, coalesce(try_cast(regexp_replace(nullif(a, ''), '[.,]', '', 'g') as bigint),
          cast(trunc(cast(replace(nullif(b, ''), ',', '.') as double) * 1000000) as bigint),
          cast(trunc(cast(replace(nullif(c, ''), ',', '.') as double) * 1000) as bigint)) as price from f""",
    "x07_jargon": f"select distinct id, {_chain('lower(coalesce(judul, \'\'))', [(w.translate(_ESC), V.JARGON[w]) for w in sorted(V.JARGON, key=len, reverse=True)])} as written_out from listings",
    "x08_spelling": f"select distinct id, {_chain('lower(coalesce(deskripsi, \'\'))', [(w.translate(_ESC), c) for w, c in V.SPELLING.items()])} as corrected from listings",
    "x09_tokens": "select doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+'), ' ') as tokens from documents",
    "x10_stopwords": f"select doc_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+'), lambda t: not list_contains([{_listed(dict.fromkeys([*V.FUNCTION_WORDS, *V.DOMAIN_STOPWORDS]))}], t)), ' ') as kept from documents",
    "x13_lexical_text": f"select distinct id, concat_ws(' . ', nullif({_strip('judul')}, ''), nullif({_strip('judul')}, ''), nullif({_strip('kecamatan')}, ''), nullif(array_to_string(fasilitas, ' '), ''), nullif({_strip('deskripsi')}, '')) as lexical from listings",
    "x14_natural_text": f"select distinct id, concat_ws('. ', nullif({_strip('judul')}, ''), nullif({_strip('kecamatan')}, ''), nullif(array_to_string(fasilitas, ' '), ''), nullif({_strip('deskripsi')}, '')) as natural from listings",
    "x15_tenant": "select distinct id, case when regexp_matches(lower(judul), 'putra|pria|cowo|laki') then 'putra' when regexp_matches(lower(judul), 'putri|wanita|cewe|perempuan') then 'putri' when regexp_matches(lower(judul), 'campur|mix|umum') then 'campur' end as tenant from listings",
    "x16_facilities": f"""with v as (select distinct id, list_filter(list_transform(coalesce(fasilitas, []), lambda x: {_strip('lower(x)')}), lambda x: x is not null and length(x) >= 2 and not regexp_matches(x, '^[0-9]+$')) as f from listings),
        c as (select id, list_transform(f, lambda x: {_facility('x')}) as g from v) select distinct id, array_to_string({_once('g')}, '|') as facilities from c""",
    "x17_clean_facilities": f"""with v as (select distinct id, list_filter(list_transform(coalesce(fasilitas, []), lambda x: {_strip('x')}), lambda x: x is not null and length(x) >= 2 and not regexp_matches(x, '^[0-9]+$')) as g from listings)
        select distinct id, array_to_string({_once('g')}, '|') as facilities from v""",
    "x20_clean_lines": f"select doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_clean('x')}), lambda x: x <> ''), chr(10)) as clean from documents",
    "x21_word_count": f"select doc_id, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '')) as bigint) as words from documents",
    "x22_truncate": "select doc_id, case when length(text) > 200 then rtrim(substr(text, 1, 197)) || '...' else text end as short from documents",
    "x23_district": "select distinct id, nullif(" + _strip(f"regexp_replace({_strip('kecamatan')}, '(?i)^kecamatan\\s+', '')") + ", '') as district from listings",
    "x33_rupiah": "select distinct id, 'Rp ' || replace(format('{:,}', harga_per_bulan), ',', '.') as shown from listings",
    "x34_id_from_url": "select distinct id, coalesce(nullif(regexp_extract(url_source, '/room/([A-Za-z0-9_-]+)', 1), ''), url_source) as url_id from listings",
    "s26_cache_key": "select distinct id, 'portal_' || substr(sha256(url_source), 1, 16) as key from listings",
    "x37_short_shell": f"select doc_id, length({_plain('text')}) < 500 as shell from documents",
    "a03_vocabulary": "select count(distinct t) as terms from (select unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z0-9_]+')) as t from documents)",
    "a04_token_counts": "select min(n) as least, max(n) as most, avg(n) as mean from (select len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9_]+')) as n from documents)",
}
