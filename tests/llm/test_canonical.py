import itertools
import random

import pytest
from pyspark.sql import functions as F

from lontar.llm import canonical as C
from lontar.llm.setjoin import grams, prefix_filter_join

LIST = [("kecamatan", "Wanaseruni Barat", None), ("kecamatan", "Karang Tirtasa", []), ("kecamatan", "Karang Tirtasa Utara", []), ("fasilitas", "AC", ["air conditioner"]), ("fasilitas", "Kursi", ["bangku"]), ("fasilitas", "Kasur", []), ("fasilitas", "Dapur Bersama", []), ("fasilitas", "Jendela", [None])]


def test_prefix_filter_join_is_exact(spark):
    rng = random.Random(3)
    sets = {k: sorted({str(rng.randint(0, 12)) for _ in range(rng.randint(0, 8))}) for k in range(60)}
    df = spark.createDataFrame(list(sets.items()), "k int, tokens array<string>")
    got = {(r.l, r.r): r.jaccard for r in prefix_filter_join(df.select(F.col("k").alias("l"), "tokens"), df.select(F.col("k").alias("r"), "tokens"), 0.4).collect()}
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in itertools.product(sets.items(), repeat=2) if x and y}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.4 - 1e-9})


def test_candidates_are_cut_by_length_and_found_without_a_sort(spark):
    """Pairs that edits rule out by their lengths are not compared; all others are, as before."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 18))) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "k string").withColumn("tokens", grams(F.col("k")))
    left, right = (df.select(F.col("k").alias(side), "tokens") for side in "lr")
    near = prefix_filter_join(left, right, 0.3, lambda l, r: C._few_edits(l - 1, r - 1))
    alike = lambda a, b: abs(len(a) - len(b)) <= C.allowed(min(len(a), len(b)))
    whole = {(r.l, r.r): r.jaccard for r in prefix_filter_join(left, right, 0.3).collect()}
    assert {(r.l, r.r): r.jaccard for r in near.collect()} == {k: v for k, v in whole.items() if alike(*k)} != whole
    assert "SortAggregate" not in near._jdf.queryExecution().executedPlan().toString()


def test_few_edits_and_what_tables_they_need(monkeypatch):
    """Two words are within so many edits if the table says so, which is made for few pairs, and once for the ends that values share."""
    words = ["".join(x) for n in range(5) for x in itertools.product("abc", repeat=n)]
    for a, b in itertools.product(words, repeat=2):
        assert [C.within(a, b, k) for k in range(3)] == [C.edits(a, b) <= k for k in range(3)]
    assert [C.edits(a, b) for a, b in (("xaby", "xbay"), ("abcd", "ad"), ("ab", "ba"), ("abab", "ab"), ("", "ab"), ("ca", "abc"))] == [1, 2, 1, 2, 2, 3]
    table, tried = C.edits, []
    monkeypatch.setattr(C, "edits", lambda a, b: tried.append((a, b)) or table(a, b))
    for k in "abcdefghij":
        assert f"wanaseruni{k}" in C.readings(f"Wanaseruni {k}, Bandar Serunadi", ["kec", "kecamatan"], ["bandarserundai", "kotabandarserundai"])
    assert len(tried) == len(set(tried)) and not any(C.within(a, b, 2) for a, b in (("kotabandar", "wanaseruni"), ("q" * 9, "bandarser")))


def test_grams_are_a_set(spark):
    assert spark.range(1).select(grams(F.lit("aaa")).alias("g")).first().g == ["\x02a1", "aa1", "aa2", "a\x031"]


def values(spark, rows):
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows] * 2, "id string, kecamatan string, fasilitas array<string>, entry string, form string, field_name string")
    canonical = spark.createDataFrame(LIST, "field_name string, entry string, aliases array<string>")
    return {(r.id, r.raw_value): r.entry for r in C.canonical_entries(df, canonical).collect()}


#: What other rows say: each decoration beside three entries.
AROUND = [("9", k, [f"{b}{e}{a}" for e in ("ac", "jendela", "kasur", "kursi") for b, a in (("plus ", ""), ("free ", ""), ("", " (baru)"), ("", " bersama"), ("", " 1unit"))]) for k in ("Kec. Karang Tirtasa", "kec. wanaseruni barat", "Kec Karang Tirtasa Utara", "Karang Tirtasa - Bandar Serundai", "Wanaseruni Barat, Bandar Serundai", "Karang Tirtasa Utara Bandar Serundai", "karang tirtasa utara kota", "wanaseruni barat kota", "karang tirtasa kota")]


def test_decoration_needs_evidence(spark):
    alone = values(spark, [("1", "karang tirtasa seberang", ["hadiah kursi"])])
    assert set(alone.values()) == {"UNMATCHED"}
    more = values(spark, [("1", f"{e} seberang", None) for e in ("karang tirtasa", "wanaseruni barat", "karang tirtasa utara")])
    assert more["1", "karang tirtasa seberang"] == "Karang Tirtasa"


def test_values(spark):
    typed = {"plus kursi": "Kursi", "KUSRI": "Kursi", "bngku (baru)": "Kursi", "Air  Conditioner;": "AC", "dapur bersama": "Dapur Bersama", "Jendela Bersama": "Jendela", "mesin fotokopi": "UNMATCHED", "tv": "UNMATCHED", "freeKasur1unit": "Kasur"}
    got = values(spark, [("1", "Kec. Wanaseruni Brt - Bandar Serundai", [*typed, "AC", "  ", "\xa0", None]), *AROUND])
    got = {k: v for k, v in got.items() if k[0] == "1"}
    assert got == {("1", "Kec. Wanaseruni Brt - Bandar Serundai"): "Wanaseruni Barat"} | {("1", k): v for k, v in typed.items()}
    got = values(spark, [("1", "karang tirtasa kota", None), *AROUND])
    assert {k: v for k, v in got.items() if k[0] == "1"} == {("1", "karang tirtasa kota"): "Karang Tirtasa"}


@pytest.mark.parametrize("rows", [[], [(None, "x", ["y"])], [("1", None, None)], [("1", "", [])]])
def test_edges(spark, rows):
    assert values(spark, rows) == {}


def test_long_values_stay_unmatched(spark):
    assert set(values(spark, [("1", "q" * 5000, ["kursi " * 500])]).values()) == {"UNMATCHED"}
