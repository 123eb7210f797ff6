import pytest

from lontar.llm import addresses as A

DISTRICTS = ["Rawa Kencanti", "Gunung Pelitasi", "Randu Alasan"]
SCHEMA = "id string, alamat string, street string, house string, token string, entry string"


def pairs(spark, texts):
    df = spark.createDataFrame([(f"{i:03}", t, "c", "c", "c", "c") for i, t in enumerate(texts)] * 2, SCHEMA)
    entries = spark.createDataFrame([(d,) for d in DISTRICTS], "entry string")
    return {(r.id_a, r.id_b) for r in A.address_pairs(df, entries).collect()}


def test_parts():
    p = A.parse_address
    assert p("no 2C Jl. Canmemur Tennoran; RT.3 RW.3; kec Rawa Kencanti 39424")[:5] == ("canmemurtennoran", "", "", "2c", "3/3")
    assert p("Prm. Datijun Blok H-5/28, Kel. X")[:4] == ("datijun", "", "h5", "28")
    assert p("Gg. Pinetur II No.40/A")[:4] == p("gang PINETUR 2 Nomor 40-A")[:4] == ("pinetur", "2", "", "40a")
    assert p("Jadilim Sempijun, No 302, kel A")[:4] == ("jadilimsempijun", "", "", "302")
    assert p("Kec. Rawa Kencanti") is None and p("") is None


def test_same_house_in_other_words(spark):
    full = "Jl. Canmemur Tennoran No. 94, RT 02/RW 03, Kec. Rawa Kencanti, 39411"
    texts = [full, "jalan canmemur tennoran 94 - rt.2 rw.3 - rawa kencanti", "No 94 Jln Canmemur Tennoran (depan pasar)", "Jl. Canmemur Tennoran No. 95, Kec. Rawa Kencanti", "Jl. Canmemur Tennoran II No. 94, Kec. Rawa Kencanti", None, "", "Kec. Rawa Kencanti"]
    assert pairs(spark, texts) == {("000", "001"), ("000", "002"), ("001", "002")}


def test_typing_errors_and_districts(spark):
    many = [f"Jl. Binpajun Semmanil No. {k}, Kec. Gunung Pelitasi" for k in range(10, 20)] + [f"Jl. Binpajun Semmanil No. {k}, Kec. Randu Alasan" for k in range(30, 40)]
    texts = [*many, "Jl. Binpajun Semmanil No. 12, Kec. Randu Alasan", "Jl. Binpajn Semmanil No. 15, Gunung Pelitsai"]
    assert pairs(spark, texts) == {("005", "021")}


def test_any_part_may_be_missing_or_elsewhere(spark):
    parts = ["Jl. Kenanga Putih II", "Blok C No. 7", "RT 01/RW 02", "Kel. Sawah", "Kec. Randu Alasan", "39411"]
    full = ", ".join(parts)
    same = [full, "Kec. Randu Alasan, Kel. Sawah, No 7 Blok C, Kenanga Putih II"] + [", ".join(p for p in parts if p != gone) for gone in parts[2:]]
    other = ["Jl. Kenanga Putih II, Blok D No. 7, Kec. Randu Alasan", "Jl. Kenanga Putih III, Blok C No. 7, Kec. Randu Alasan", "Jl. Kenanga Putih II, Blok C No. 7a, Kec. Randu Alasan", "Jl. Kenanga Putih II, Blok C No. 7, Kec. Rawa Kencanti"]
    filler = [f"Jl. Kenanga Putih II No. {k}, Kec. Rawa Kencanti" for k in range(40, 46)]
    found = pairs(spark, same + other + filler)
    assert found == {(f"{a:03}", f"{b:03}") for a in range(len(same)) for b in range(a + 1, len(same))}


def test_a_contradicting_part_is_no_house(spark):
    texts = ["Jl. Melur No. 7, RT 01/RW 02, Kec. Randu Alasan", "Jl. Melur No. 7, RT 05/RW 02", "Jl. Melur No. 8, Kec. Rawa Kencanti"]
    assert pairs(spark, texts) == set()


def test_frequent_errors_are_still_errors(spark):
    names = spark.createDataFrame([("kenangaputih", 1000), ("kenangaputi", 6), ("mawar", 900), ("mawas", 700), ("kenangaptui", 1)], "name string, n bigint")
    found = {r.name: r.entry for r in A.spelling_map(names, names.withColumnRenamed("name", "entry")).collect()}
    assert found["kenangaputi"] == "kenangaputih" and "mawas" not in found and "kenangaputih" not in found


@pytest.mark.parametrize("texts", [[], [None], [""], ["x" * 200_000], ["Jl. A No. 1, " + "Kel. B, " * 20_000]])
def test_edges(spark, texts):
    assert pairs(spark, texts) == set()
