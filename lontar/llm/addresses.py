"""Same postal address written differently: a set-containment join over address components.

Plan
----
1. ``parse_addresses`` reads each *distinct* address once (Arrow batches) into components: street, street
   numeral, block, house number with its letter, neighbourhood unit, ward, sub-district, postcode.
2. ``resolve_components`` corrects the name parts against the corpus itself: a spelling maps to a far more frequent one
   at edit distance one or two (deletion-neighbourhood join, verified), sub-districts map to the reference list, and
   wards, postcodes and streets that point to one sub-district fill in a missing one.
3. ``same_house``: an address is a set of tokens (street, number, the two with numeral and block as one token, unit, ward,
   postcode, sub-district), each weighted by its rarity over all addresses. Addresses that miss the sub-district are
   indexed under their rarest tokens, as many as a containment of ``CONTAINED`` needs; the fuller addresses, merged by
   house and sub-district, probe that index with all their tokens. A candidate counts if no component contradicts and
   the weight of the shared tokens is ``CONTAINED`` of the weight of the poorer address; the greatest containment wins.
4. ``houses`` gives every listing its house, ``address_pairs`` expands houses into listing pairs.

Nulls, blank addresses and addresses without street and number denote no house. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lontar.runtime import bounded_broadcast, cut_lineage

# Words that mark a part of an Indonesian address.
STREET = r"jalan|jln|jl|gang|gg|perumahan|perum|prm|komplek|kompleks|komp"
WARD = r"kelurahan|kel|desa"
DISTRICT = r"kecamatan|kec"
NUMBER = r"nomor|nomer|no"
BLOCK = r"blok|blk|block"
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}

_PAREN = re.compile(r"\([^)]*\)")
_POST = re.compile(r"\b\d{5}\b")
_RT = re.compile(r"\brt\W*(\d{1,3})\W*(?:rw)?\W*(\d{1,3})")
_BLOCK = re.compile(rf"\b(?:{BLOCK})\b[\s.:]*([a-z]{{1,2}})[\s.-]*(\d*)[\s,.]*(?:/|(?:{NUMBER})\b|#)[\s.:]*(\d+)(?:\s*[-/]?\s*([a-z])\b)?")
_NO_BLOCK = re.compile(rf"(?:\b(?:{NUMBER})(?=[\s.:\d])|#)[\s.:]*(\d+)(?:\s*[-/]?\s*([a-z])\b)?[\s,./-]*\b(?:{BLOCK})\b[\s.:]*([a-z]{{1,2}})\b[\s.-]*(\d*)")
_NO = re.compile(rf"(?:\b(?:{NUMBER})(?=[\s.:\d])|#)[\s.:]*(\d+)(?:\s*[-/]?\s*([a-z])\b(?![.]))?")
_SEP = re.compile(r"\s*[,;\n\r]+\s*|\s+-+\s+")
_STREET = re.compile(rf"^(?:{STREET})(?=[\s.:])[\s.:]*")
_WARD = re.compile(rf"^(?:{WARD})(?=[\s.:])[\s.:]*")
_DIST = re.compile(rf"^(?:{DISTRICT})(?=[\s.:])[\s.:]*")
_BARE = re.compile(r"^(.*?[a-z])\s+(\d+)\s*[-/]?\s*([a-z])?$")
_NUM = re.compile(r"\s+(x|ix|iv|v?i{1,3}|v|\d{1,2})$")
_SIGNS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"[ \t ]+")

PARSED = "alamat string, street string, numeral string, block string, number string, unit string, ward string, district string, bare array<string>, postcode string"


def parse_address(text: str, city: str = "") -> tuple | None:
    """Components of one address: (street, numeral, block, number, unit, ward, district, bare parts, postcode).

    Names come lower-cased with their blanks removed, for blanks get lost in typing; numerals are Arabic.
    None where the address has no street or no number.
    """
    s = _SPACE.sub(" ", text.lower()).replace("\r", "\n")
    s = _PAREN.sub(" ", s) if "(" in s else s
    post = None
    if m := _POST.findall(s):
        post, s = m[-1], _POST.sub(" ", s)
    unit = block = number = None
    if "rt" in s and (m := _RT.search(s)):
        unit = f"{int(m[1])}/{int(m[2])}"
        s = s[: m.start()] + "," + s[m.end() :]
    block_word = "blok" in s or "blk" in s or "block" in s
    if block_word and (m := _BLOCK.search(s)):
        block, number = m[1] + str(int(m[2] or 0)), str(int(m[3])) + (m[4] or "")
        s = s[: m.start()] + " \x01," + s[m.end() :]
    elif block_word and (m := _NO_BLOCK.search(s)):
        block, number = m[3] + str(int(m[4] or 0)), str(int(m[1])) + (m[2] or "")
        s = s[: m.start()] + " \x01," + s[m.end() :]
    elif m := _NO.search(s):
        number = str(int(m[1])) + (m[2] or "")
        s = s[: m.start()] + " \x01 " + s[m.end() :]
    street = numeral = ward = district = None
    fallback, bare, at = None, [], None
    for part in _SEP.split(s):
        marked, part = "\x01" in part, part.replace("\x01", " ").strip(" .:-/")
        part = _SPACE.sub(" ", part)
        if not part:
            at = len(bare) if marked else at
            continue
        if street is None and _STREET.match(part + " "):
            street = _STREET.sub("", part + " ").strip()
        elif ward is None and _WARD.match(part):
            ward = _letters(_WARD.sub("", part))
        elif district is None and _DIST.match(part):
            district = _letters(_DIST.sub("", part))
        elif marked and fallback is None:
            fallback = part
        else:
            bare.append(part)
    if street is None:
        street = fallback
        if street is None and at is not None and bare:  # the number stands in a part of its own, after the street
            street = bare.pop(max(at - 1, 0))
        elif street is None:
            k = next((k for k, part in enumerate(bare) if _BARE.match(part)), None)
            street = bare.pop(k) if k is not None else None
    elif fallback:
        bare.append(fallback)
    if not street:
        return None
    if number is None:
        if not (m := _BARE.match(street)):
            return None
        street, number = m[1], str(int(m[2])) + (m[3] or "")
    if m := _NUM.search(street):
        numeral, street = ROMAN.get(m[1]) or str(int(m[1])), street[: m.start()]
    street = _letters(street)
    if not street:
        return None
    return street, numeral or "", block or "", number, unit, ward, district, [x for x in map(_letters, bare) if x], post


def _letters(s: str) -> str:
    return _SIGNS.sub("", s)


def parse_addresses(df: DataFrame, column: str = "alamat") -> DataFrame:
    """The components of every distinct non-blank value of ``column`` that has a street and a number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        for pdf in batches:
            rows = [(a, *p) for a in pdf["alamat"] if (p := parse_address(a))]
            yield pd.DataFrame(rows, columns=names)

    distinct = df.select(F.col(column).alias("alamat")).where(F.length(F.trim("alamat")) > 0).distinct()
    return distinct.mapInPandas(run, PARSED)


#: A spelling is taken for an error if another is this many times as frequent, and if it has no more than two uses and
#: this share of the other's: some errors of frequent names are frequent themselves.
TIMES, SHARE = 5, 0.02


def deletions(name: Column) -> Column:
    """Search keys of a name: itself less one letter at every place, and its two halves.

    Two names one edit apart (a letter added, lost or changed, or two swapped) share a key; so do names with two
    edits in one half. Halves come in two lengths, since an edit changes the length.
    """
    n = F.length(name)
    half = F.greatest(F.floor(n / 2).cast("int"), F.lit(3))
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(name, 1, i - 1), F.substr(name, i + 1)))
    ends = [F.concat(F.lit(mark), F.substr(name, start, size)) for size in (half, half - 1) for mark, start in (("<", F.lit(1)), (">", F.greatest(n - size + 1, F.lit(1))))]
    return F.array_distinct(F.concat(F.array(name, *ends), less))


def spelling_map(names: DataFrame, entries: DataFrame, most: int = 2) -> DataFrame:
    """(name, entry) for each row (name, n) of ``names`` that is taken for a spelling of an entry (entry, n): the nearest
    within ``most`` edits, the more frequent among equals, then the first by code point. How frequent the name is itself
    does not protect it, only the ratio does (``TIMES``, ``SHARE``), so that the result is the same for any table size."""
    left = names.select("name", F.col("n").alias("n"), F.explode(deletions(F.col("name"))).alias("key"))
    right = entries.select("entry", F.col("n").alias("m"), F.explode(deletions(F.col("entry"))).alias("key"))
    near = F.levenshtein("name", "entry", most)
    rare = (F.col("m") >= TIMES * F.col("n")) & (F.col("n") <= 2 + SHARE * F.col("m"))
    pairs = left.join(right, "key").where(rare & (near >= 0))
    best = F.min_by("entry", F.struct(near, -F.col("m"), F.col("entry")))
    return pairs.groupBy("name").agg(best.alias("entry"))


def _pointing(df: DataFrame, by: list[str], purity: float) -> DataFrame:
    """Values of ``by`` nearly all of whose addresses name one district, with that district."""
    counts = df.where(F.col("district").isNotNull()).dropna(subset=by).groupBy(*by, "district").agg(F.sum("n").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("district", F.struct("n", "district")).alias("points"))
    return total.where(F.col("most") >= purity * F.col("all")).select(*by, "points")


def resolve_components(parsed: DataFrame, districts: DataFrame, purity: float = 0.97) -> DataFrame:
    """``parsed`` with street spelling corrected and the district filled in where ward, postcode or street tell it.

    ``districts`` (entry) is the reference list of sub-district names. Columns: alamat, street, numeral, block,
    number, unit, ward, postcode, district (an entry, or null).
    """
    tight = F.regexp_replace(F.lower("entry"), "[^a-z0-9]", "")
    entries = districts.select(tight.alias("entry"), F.lit(1 << 40).cast("bigint").alias("n")).distinct()

    streets = cut_lineage(parsed.groupBy(F.col("street").alias("name")).agg(F.count("*").alias("n")))
    one = cut_lineage(spelling_map(streets, streets.select(F.col("name").alias("entry"), "n").where(F.col("n") >= TIMES)))
    # an error of an error: follow the entry once more
    two = bounded_broadcast(one.select(F.col("name").alias("entry"), F.col("entry").alias("further")))
    street_map = cut_lineage(one.join(two, "entry", "left").select("name", F.coalesce("further", "entry").alias("entry")))
    parts = F.array_compact(F.concat(F.array("district"), F.col("bare")))
    named = parsed.select(F.explode(F.array_compact(F.concat(F.array("district", "ward"), F.col("bare")))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    named = cut_lineage(named)
    place_map = spelling_map(named, entries).withColumn("kind", F.lit("d"))
    place_map = cut_lineage(place_map)
    left = cut_lineage(named.join(place_map, "name", "left_anti"))
    wards = cut_lineage(spelling_map(left, left.where(F.col("n") >= TIMES).select(F.col("name").alias("entry"), "n")))
    own = left.where(F.col("n") >= TIMES).join(wards, "name", "left_anti").select("name", F.col("name").alias("entry"))
    place_map = cut_lineage(place_map.unionByName(wards.unionByName(own).withColumn("kind", F.lit("w"))))

    # one row per named part, joined to what it means, and folded back into the address
    keyed = parsed.withColumn("ward", F.array_compact(F.array("ward"))).withColumn("part", F.explode_outer(F.array_union(parts, F.col("ward"))))
    joined = keyed.join(bounded_broadcast(place_map.withColumnRenamed("name", "part")), "part", "left")
    fixed = ["alamat", "street", "numeral", "block", "number", "unit", "postcode"]
    folded = joined.groupBy(*fixed).agg(
        F.min(F.when(F.col("kind") == "d", F.col("entry"))).alias("district"),
        F.min(F.when(F.col("kind") == "w", F.col("entry"))).alias("ward"),
    )
    street = bounded_broadcast(street_map.select(F.col("name").alias("street"), F.col("entry").alias("right_street")))
    folded = folded.join(street, "street", "left").withColumn("street", F.coalesce("right_street", "street")).drop("right_street")
    folded = cut_lineage(folded)

    counted = folded.groupBy("street", "ward", "postcode", "district").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted)
    for by, name in (["ward"], "by_ward"), (["postcode"], "by_post"), (["street"], "by_street"):
        points = bounded_broadcast(cut_lineage(_pointing(counted, by, purity).withColumnRenamed("points", name)))
        folded = folded.join(points, by, "left")
    return folded.withColumn("district", F.coalesce("district", "by_ward", "by_post", "by_street")).drop("by_ward", "by_post", "by_street")


IDENTITY = ["street", "numeral", "block", "number"]
#: Share of the poorer address's weight that the fuller one must hold.
CONTAINED = 0.5
_PARTS = ("unit", "ward", "postcode")


def _tokens() -> Column:
    """The tokens of a resolved address; missing parts give none."""
    house = F.concat(F.lit("h|"), F.concat_ws("|", *IDENTITY))
    parts = [F.concat(F.lit(f"{c[0]}|"), F.col(c)) for c in (*_PARTS, "district")]
    return F.array_compact(F.array(house, F.concat(F.lit("s|"), "street"), F.concat(F.lit("n|"), "number"), *parts))


def same_house(resolved: DataFrame) -> DataFrame:
    """(alamat, house): addresses of one house share the value of ``house``.

    Addresses that name the sub-district (or have it from ward, postcode or street) are of one house if street with
    numeral, block and number are the same there. One that does not is joined by containment to the fuller addresses,
    and has the house of the one that contains most of it; of none if two contain it equally, or if its unit, ward or
    postcode contradicts. Missing units, wards and postcodes on either side contradict nothing.
    """
    house = F.concat_ws("|", *IDENTITY)
    df = resolved.select("alamat", house.alias("token"), *IDENTITY, *_PARTS, "district")
    kinds = cut_lineage(df.groupBy("token", *IDENTITY, *_PARTS, "district").agg(F.count("*").alias("n")).withColumn("tokens", _tokens()))
    rarity = kinds.select("n", F.explode("tokens").alias("t")).groupBy("t").agg(F.sum("n").alias("df"))
    lack = kinds.where("district is null").select("token", *_PARTS, F.explode("tokens").alias("t"))
    total = F.lit(float(max(kinds.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0], 1)))
    weighed = lack.join(bounded_broadcast(cut_lineage(rarity)), "t").withColumn("w", F.log(1 + total / F.col("df")))
    poor = weighed.groupBy("token", *_PARTS).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("order"), "t", "w"))).alias("ranked"))
    poor = cut_lineage(poor.withColumn("all", F.aggregate("ranked", F.lit(0.0), lambda a, x: a + x.w)).withColumn("poor", F.monotonically_increasing_id()))

    # prefix filter: what is left after the indexed tokens weighs less than a containment needs
    before = F.transform("ranked", lambda x, i: F.struct(x.t.alias("t"), F.aggregate(F.slice("ranked", F.lit(1), i), F.lit(0.0), lambda a, y: a + y.w).alias("sum")))
    index = poor.select("poor", F.explode(F.filter(before, lambda x: x.sum <= (1 - CONTAINED) * F.col("all") + 1e-9)).alias("x")).select("poor", F.col("x.t").alias("t"))
    profiles = kinds.where("district is not null").groupBy("token", "district").agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"), *(F.collect_set(c).alias(f"{c}s") for c in _PARTS))
    profiles = cut_lineage(profiles.withColumn("full", F.monotonically_increasing_id()))
    probes = profiles.select("full", F.col("token").alias("of"), "district", F.explode("tokens").alias("t"))
    # identity is never missing in either, so a probe under another token of a different house contradicts at once
    met = probes.join(index.join(poor.select("poor", "token"), "poor"), (probes["t"] == index["t"]) & (probes["of"] == F.col("token"))).select("poor", "full").distinct()
    both = met.join(poor, "poor").join(profiles.drop("token"), "full")
    fits = F.lit(True)
    for c in _PARTS:
        fits &= F.col(c).isNull() | (F.size(f"{c}s") == 0) | F.array_contains(f"{c}s", F.col(c))
    held = F.aggregate(F.filter("ranked", lambda x: F.array_contains("tokens", x.t)), F.lit(0.0), lambda a, x: a + x.w)
    found = both.where(fits).withColumn("share", F.round(held / F.col("all"), 9)).where(F.col("share") >= CONTAINED)
    best = found.groupBy("poor", "token", *_PARTS).agg(F.max_by("district", "share").alias("to"), F.max("share").alias("top"), F.collect_list("share").alias("shares"))
    unique = best.where(F.size(F.filter("shares", lambda x: x == F.col("top"))) == 1).select("token", *_PARTS, "to")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("token", *_PARTS)]
    on = same[0] & same[1] & same[2] & same[3]
    rest = df.where("district is null").alias("a").join(bounded_broadcast(cut_lineage(unique)).alias("b"), on, "left").select("a.alamat", "a.token", F.col("b.to").alias("district"))
    placed = df.where("district is not null").select("alamat", "token", "district").unionByName(rest)
    return placed.select("alamat", F.concat_ws("|", "token", F.coalesce("district", F.lit("?"))).alias("house"))


def houses(listings: DataFrame, districts: DataFrame) -> DataFrame:
    """(id, house): each id and the house that its address denotes, if it denotes one; ids may repeat, and an id with
    several addresses may have several houses."""
    placed = cut_lineage(same_house(resolve_components(parse_addresses(listings), districts)))
    return listings.select("id", "alamat").join(placed, "alamat").select("id", "house").where(F.col("id").isNotNull()).distinct()


def address_pairs(listings: DataFrame, districts: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids whose addresses denote one house.

    ``listings`` needs id and alamat, other columns do not matter; ids may repeat. A house shared by very many
    listings gives that many pairs, as asked; its join is split by AQE like any skewed key.
    """
    placed = cut_lineage(houses(listings, districts))
    a, b = placed.withColumnRenamed("id", "id_a"), placed.withColumnRenamed("id", "id_b")
    return a.join(b, "house").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
