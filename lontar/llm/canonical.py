"""Mapping free-entered values to a canonical list.

Plan
----
1. Distinct values only: whatever the number of rows, each spelling is worked on once.
2. A value is read in several ways: as typed, and without leading or trailing decoration. What is decoration is told by
   the values: words that stand before or after ``ENTRIES`` different entries. The list is read under entries, their
   aliases and abbreviations of one word.
3. ``prefix_filter_join`` on character bigrams: rare prefixes, length and positional filters, exact Jaccard.
4. An exact check follows on the candidates: the edit distance (swaps count one) may be about a quarter of the
   length. The greatest Jaccard wins, then the least distance, then a spelled-out form over an abbreviation, then the
   entry first by code point. Values without a candidate that passes mean no entry: UNMATCHED.

Null and blank values (white space of any script) are left out; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.setjoin import grams, prefix_filter_join
from lontar.runtime import bounded_broadcast, cut_lineage

UNMATCHED = "UNMATCHED"

# Words that mark a sub-district, decoration without evidence.
MARKS = ("kecamatan", "kec")
#: Different entries that words must stand before, or after, to be decoration.
ENTRIES = 3
#: Least Jaccard similarity of bigrams for a candidate: two letters swapped in a word of five leave 1/3.
CANDIDATE = 0.3


_SIGNS = re.compile(r"[\W_]+")


def blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"(?U)^[\s\p{Z}\p{C}]*$")


def edits(a: str, b: str) -> int:
    """Edit distance where a swap of neighbouring letters counts one."""
    if a == b:
        return 0
    most, n = min(len(a), len(b)), 0  # what both begin and end with takes no edit
    while n < most and a[n] == b[n]:
        n += 1
    a, b, most = a[n:], b[n:], most - n
    n = 0
    while n < most and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        two, one = one, now
    return one[-1]


def within(a: str, b: str, most: int) -> bool:
    """Whether no more than ``most`` edits lie between the two. A letter that only one of them has takes an edit, so most
    pairs need no table."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    x, y = set(a), set(b)
    return len(x - y) <= most and len(y - x) <= most and edits(a, b) <= most


def allowed(length: int) -> int:
    """Edits that a spelling of so many letters may have."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 11 else 3 if length < 16 else 4


def _few_edits(size: Column, other: Column) -> Column:
    """Whether two spellings of so many letters may be apart by ``allowed`` edits: one takes a letter more or less."""
    n = F.least(size, other)
    most = F.when(n < 3, 0).when(n < 6, 1).when(n < 11, 2).when(n < 16, 3).otherwise(4)
    return F.abs(size - other) <= most


def tight(value: str) -> str:
    return "".join(c for c in value.lower() if c.isalnum())


def decoration(value: str, forms: dict[str, str]) -> list[tuple[str, str, str]]:
    """(side, words, entry): what stands before (up to two words) or after (up to three) a form of an entry in ``value``."""
    words, found = [x for x in _SIGNS.split(value.lower()) if x], []
    for side, most in (("before", 2), ("after", 3)):
        for n in range(1, min(most, len(words) - 1) + 1):
            part, rest = (words[:n], words[n:]) if side == "before" else (words[-n:], words[:-n])
            if entry := forms.get("".join(rest)):
                found.append((side, "".join(part), entry))
    return found


@lru_cache(1 << 16)
def _decorates(part: str, words: str, slack: int) -> bool:
    """Whether ``part`` is decoration with typing errors; the same ends stand in many values."""
    return within(part, words, slack)


def readings(value: str, before: list[str], after: list[str]) -> set[str]:
    """The value without blanks and signs, and what remains when decoration is taken off its ends."""
    whole = tight(value)
    found = {whole}
    for _ in range(2):  # one word off each end, or two off one
        for s in list(found):
            for words, front in ((before, True), (after, False)):
                for w in words:
                    slack = 0 if len(w) < 4 else 1 if len(w) < 9 else 2
                    for n in range(len(w) - slack, len(w) + slack + 1):
                        part, rest = (s[:n], s[n:]) if front else (s[-n:], s[:-n])
                        if len(rest) >= 2 and len(part) == n and (part == w or slack and _decorates(part, w, slack)):
                            found.add(rest)
    return {x for x in found if x}


def abbreviations(entry: str) -> set[str]:
    """The entry with one of its words cut to two or three letters in their order, the first kept."""
    words, found = [tight(w) for w in entry.split()], set()
    for k, w in enumerate(words if len(words) > 1 else ()):
        tails = {w[i] for i in range(1, len(w))} | {w[i] + w[j] for i in range(1, len(w)) for j in range(i + 1, len(w))}
        found |= {"".join([*words[:k], w[0] + t, *words[k + 1 :]]) for t in tails if len(w) > 3}
    return found


def entered_values(listings: DataFrame) -> DataFrame:
    """(id, field_name, raw_value): the non-blank values of kecamatan and of the elements of fasilitas."""
    one = F.struct(F.lit("kecamatan").alias("field_name"), F.col("kecamatan").alias("raw_value"))
    many = F.transform(F.coalesce("fasilitas", F.array().cast("array<string>")), lambda v: F.struct(F.lit("fasilitas").alias("field_name"), v.alias("raw_value")))
    rows = listings.where(F.col("id").isNotNull()).select("id", F.explode(F.array_distinct(F.concat(F.array(one), many))).alias("v"))
    return rows.select("id", "v.*").where(~blank(F.col("raw_value")))


def map_values(values: DataFrame, canonical: DataFrame, candidate: float = CANDIDATE) -> DataFrame:
    """(field_name, raw_value, entry) for distinct ``values`` (field_name, raw_value), by the list ``canonical``
    (field_name, entry, aliases). ``canonical`` is a reference list and may have null or empty aliases. ``candidate`` is the
    least similarity of bigrams at which an entry is considered; long names need less leeway than short ones."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, e, aliases in zip(pdf["field_name"], pdf["entry"], pdf["aliases"]):
                full = {tight(e), *(tight(a) for a in (aliases if aliases is not None else ()) if a)} - {""}
                rows += [(f, e, x, 0) for x in full] + [(f, e, x, 1) for x in abbreviations(e) - full]
            yield pd.DataFrame(rows, columns=["field_name", "entry", "form", "short"])

    shape = "field_name string, raw_value string, form string"
    entries = cut_lineage(canonical.select("field_name", "entry", "aliases").dropna(subset=["field_name", "entry"]).distinct().mapInPandas(spell, "field_name string, entry string, form string, short int"))
    # the reference list itself goes to the tasks: what people have entered by hand, entry by entry
    full = {(r["field_name"], r["form"]): r["entry"] for r in entries.where("short = 0").select("field_name", "form", "entry").collect()}

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, dict[str, str]] = {}
        for (f, form), e in full.items():
            by.setdefault(f, {})[form] = e
        for pdf in batches:
            rows = [(f, *x) for f, v in zip(pdf["field_name"], pdf["raw_value"]) for x in decoration(v, by.get(f, {}))]
            yield pd.DataFrame(rows, columns=["field_name", "side", "words", "entry"])

    around = values.mapInPandas(look, "field_name string, side string, words string, entry string").groupBy("field_name", "side", "words").agg(F.count_distinct("entry").alias("k")).where(F.col("k") >= ENTRIES)
    # bounded: each stands beside three entries, and none is longer than three words
    taken: dict[tuple[str, str], list[str]] = {}
    for r in around.collect():
        taken.setdefault((r["field_name"], r["side"]), []).append(r["words"])
    taken = {k: sorted(v) for k, v in taken.items()}
    taken["kecamatan", "before"] = sorted({*taken.get(("kecamatan", "before"), []), *MARKS})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, v, x) for f, v in zip(pdf["field_name"], pdf["raw_value"]) for x in readings(v, taken.get((f, "before"), []), taken.get((f, "after"), []))]
            yield pd.DataFrame(rows, columns=["field_name", "raw_value", "form"])

    # sets of very different size are never that similar: what is far longer than any entry needs no bigrams
    longest = entries.agg(F.coalesce(F.max(F.length("form")), F.lit(0))).first()[0]
    forms = cut_lineage(values.mapInPandas(read, shape).where((F.length("form") + 1) * candidate <= longest + 1))

    key = F.struct("field_name", "form")
    left = forms.select(key.alias("l")).distinct().select("l", F.transform(grams(F.col("l.form")), lambda g: F.concat("l.field_name", F.lit(":"), g)).alias("tokens"))
    right = entries.select(key.alias("r")).distinct().select("r", F.transform(grams(F.col("r.form")), lambda g: F.concat("r.field_name", F.lit(":"), g)).alias("tokens"))
    # a form has one gram more than letters
    near = prefix_filter_join(left, right, candidate, lambda l, r: _few_edits(l - 1, r - 1))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            most = [allowed(min(len(a), len(b))) for a, b in zip(pdf["form"], pdf["near"])]
            # a letter that only one of them has takes an edit, so most pairs need no table
            may = [abs(len(a) - len(b)) <= k and max(len(set(a) - set(b)), len(set(b) - set(a))) <= k for k, a, b in zip(most, pdf["form"], pdf["near"])]
            pdf = pdf.assign(most=most)[np.array(may, dtype=bool)]
            pdf = pdf.assign(d=[edits(a, b) for a, b in zip(pdf["form"], pdf["near"])])
            yield pdf[pdf["d"] <= pdf["most"]].drop(columns="most")

    flat = near.select(F.col("l.field_name").alias("field_name"), F.col("l.form").alias("form"), F.col("r.form").alias("near"), "jaccard")
    close = flat.mapInPandas(verify, "field_name string, form string, near string, jaccard double, d int")
    meant = close.join(bounded_broadcast(entries.withColumnRenamed("form", "near")), ["field_name", "near"])
    best = forms.join(meant, ["field_name", "form"]).groupBy("field_name", "raw_value").agg(F.min_by("entry", F.struct(-F.col("jaccard"), "d", "short", "entry")).alias("entry"))
    return values.join(best, ["field_name", "raw_value"], "left").withColumn("entry", F.coalesce("entry", F.lit(UNMATCHED)))


def canonical_entries(listings: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, field_name, raw_value, entry): one row per id and entered value that is not, character for character, an
    entry of its field."""
    entries = canonical.select("field_name", F.col("entry").alias("raw_value")).distinct()
    entered = entered_values(listings)
    values = cut_lineage(entered.select("field_name", "raw_value").distinct().join(bounded_broadcast(entries), ["field_name", "raw_value"], "left_anti"))
    mapped = cut_lineage(map_values(values, canonical))
    return entered.join(bounded_broadcast(mapped), ["field_name", "raw_value"]).select("id", "field_name", "raw_value", "entry").distinct()
