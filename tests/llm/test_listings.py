import numpy as np
import pandas as pd
import pytest

from lontar.llm import listings as L

SCHEMA = "id string, judul string, deskripsi string, alamat string, kecamatan string, tipe string, harga_per_bulan bigint, room string, street string, a string"
COUNT_WORDS = L.generic_words
DISTRICTS = [("Rawa Kencanti", ["rawa"]), ("Gunung Pelitasi", None)]


@pytest.fixture(autouse=True)
def generic(monkeypatch):
    """Small tables have no statistics of words."""
    monkeypatch.setattr(L, "generic_words", lambda df: {"griya", "kost", "putra", "putri", "cowok", "pria", "murah", "deluxe"})


def found(spark, rows):
    df = spark.createDataFrame([(f"{i:03}", *r, "c", "c", "c") for i, r in enumerate(rows)] * 2, SCHEMA)
    return {(r.id_a, r.id_b) for r in L.room_pairs(df, spark.createDataFrame(DISTRICTS, "entry string, aliases array<string>")).collect()}


def test_reading():
    assert L.read_room("kost std putra", "luas 4x3 m.", "") == (1, L.CLASS_CODES["standard"], 300400)
    assert L.read_room("kos", "kamar v.i.p untuk wanita. 3,5 kali 4 meter", "") == (2, L.CLASS_CODES["vip"], 350400)
    assert L.room_price(900, "") == 900_000 and L.room_price(1, "biaya 1,25 jt") == 1_250_000 and L.room_price(None, "rp 950.000") == 950_000
    assert L._words_alike("tilonilwi jaretur", "jaretur paviluin tilonilwii") and not L._words_alike("talukansi jemdidar", "ratogunda jemsisar")


def test_each_different_sentence_is_read_once(monkeypatch):
    """What descriptions share is read once, and what is read is what the whole texts say, also where they are cut."""
    read, tried = L.told_name, []
    monkeypatch.setattr(L, "told_name", lambda s, generic: tried.append(s) or read(s, generic))
    parts = ["kos tilonilwi jaretur", "kolam renang\numum", "bebas. jam malam", "luas 3 x 4.5 m", "2. x 4", "rp. 500.000", "biaya rp 1.250.000", "kamar v.i.p", "bebas jam malam", "untuk\nwanita"]
    texts = [f"{a}. {b}{end}{c}" for a in parts for b in parts for c in parts for end in (". ", "\n", " ")]
    tell = L.Descriptions({"untuk", "kamar"})
    for text in texts:
        tenant, room, size, price, told = tell(text)
        assert (tenant or 0, room or 0, size or 0) == L.read_room("", text, "") and (price or 0) == L.room_price(None, text) and told == read(text, {"untuk", "kamar"})
    assert sorted(tried) == sorted({s for text in texts for s in L.sentences(text)})


@pytest.mark.parametrize("kept", [1, L.KEPT])
def test_generic_words_are_counted_whatever_is_kept(spark, monkeypatch, kept):
    monkeypatch.setattr(L, "KEPT", kept)
    texts = [("Kos nyaman", "Harga murah\nKamar rapi-rapi. Satu kamar", f"No. {k % 13}") for k in range(26)] + [("Kos", "sering. sering sering", "No. 5")] * 40 + [(None, None, None), ("Kos", "", "Jl. Lain")]
    assert COUNT_WORDS(spark.createDataFrame(texts, "judul string, deskripsi string, alamat string")) == {"nyaman", "harga", "murah", "kamar", "rapi", "satu"}


def test_one_room_in_other_words(spark):
    rawa, jl = "Rawa Kencanti", "Jl. Canmemur No. 9"
    rows = [
        ("Kos putra Griya Tilonilwi Jaretur std", "Luas 3x4 m.", jl, rawa, "putra", 800_000),
        ("Kost cowok Tilonilwii Jaretur", "Kamar kelas standard.", None, "kec rawa kencanti", None, 810_000),
        ("Kos pria murah", "Biaya 800rb. Luas 4x3 m.", "jalan canmemur 9", rawa, "putra", None),
        ("Kos putra Tilonilwi Jaretur deluxe", "Luas 4x4 m.", jl, rawa, "putra", 1_200_000),
        ("Kos putri Tilonilwi Jaretur std", "Luas 3x4 m.", jl, rawa, "putri", 800_000),
        ("Kos putra Griya Tilonilwi Jaretur std", "Luas 3x4 m.", "Jl. Lain No. 2", "Gunung Pelitasi", "putra", 800_000),
    ]
    assert found(spark, rows) == {("000", "001"), ("000", "002"), ("001", "002")}


def test_abbreviated_districts_are_places(spark):
    """A sub-district is read however it is shortened, with no other text to name it: houses of one name stay apart."""
    listings = spark.createDataFrame([(str(i), "Kos", "", None, k, None, None) for i, k in enumerate(("gn. pelitasi", "Gng Pelitasi", "Rwa Kencanti", "Kec. gn pelitasi"))], "id string, judul string, deskripsi string, alamat string, kecamatan string, tipe string, harga_per_bulan bigint")
    read = {r.id: r.place for r in L.features(listings, spark.createDataFrame(DISTRICTS, "entry string, aliases array<string>")).collect()}
    assert read == {"0": "Gunung Pelitasi", "1": "Gunung Pelitasi", "2": "Rawa Kencanti", "3": "Gunung Pelitasi"}
    same = ("Kos putra Tilonilwi Jaretur std", "Luas 3x4 m.", None)
    assert found(spark, [(*same, "gn. pelitasi", "putra", 800_000), (*same, "Rawa Kencanti", "putra", 800_000)]) == set()


def test_many_copies_are_one_row(spark):
    rows = [("Kos putra Tilonilwi Jaretur std", "Luas 3x4 m.", None, "Rawa Kencanti", "putra", 800_000)] * 60
    assert len(found(spark, rows)) == 60 * 59 // 2


def test_listings_without_name_and_street_stay_alone(spark):
    assert found(spark, [(None, None, None, None, "putra", 800_000)] * 2 + [("Kos putra", "Luas 3x4 m.", "", "Rawa Kencanti", "putra", 800_000)] * 2) == set()


def test_a_crowded_house_is_compared_beyond_the_window(spark):
    """Sixty different rows of one name: rooms of three classes come out whole, though most lie farther apart than a window."""
    rows = [("Kos putra Tilonilwi Jaretur " + ("std", "vip", "deluxe")[k % 3], f"Luas {3 + k % 3}x4 m.", f"Jl. Canmemur No. 9, RT {k // 3 + 1}" if k % 2 else None, ("Rawa Kencanti", None)[k % 4 == 0], "putra", (800_000, 1_000_000, 1_300_000)[k % 3] + 100 * k) for k in range(60)]
    want = {(f"{a:03}", f"{b:03}") for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3}
    assert found(spark, rows) == want


def test_a_key_of_many_states_is_compared_in_bounded_groups(monkeypatch):
    """The pairs are those of all states and rows farther off than the window that do not contradict, few at a time."""
    n, reps, first = 300, 20, 30
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({c: rng.integers(0, 4, n) for c in ("place_code", "tenant", "number_code", "class", "size")} | {"key_code": np.where(np.arange(n) < 250, 7, np.arange(n)), "price": np.full(n, 800_000)})
    told, heads = rows[["place_code", "tenant", "number_code"]].to_numpy(), L._states(rows).index
    near = lambda a, b: ((told[a] == told[b]) | (told[a] == 0) | (told[b] == 0)).all()
    want = sorted((h, r) for h in heads if h < 250 for r in range(first, 250) if r > h + (L.WINDOW if h >= reps else 0) and near(h, r))
    monkeypatch.setattr(L, "PAIRS", 64)
    groups = list(L._together(L._with_states(rows, first, reps)))
    assert max(len(i) for i, _ in groups) <= 64
    assert sorted((int(a), int(b)) for i, j in groups for a, b in zip(i, j)) == want


def test_windows_cross_partition_borders(spark):
    wide = spark.createDataFrame([(f"{i:05}{s}", f"Kos putra Tilo{i:05}".replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") + " Jaretur std", text, None, "Rawa Kencanti", "putra", 800_000, "", "", "") for i in range(300) for s, text in (("x", "Luas 3x4 m."), ("y", "Kamar."))], SCHEMA)
    got = {(r.id_a[:5], r.id_b[:5]) for r in L.room_pairs(wide, spark.createDataFrame(DISTRICTS, "entry string, aliases array<string>")).collect()}
    assert {(f"{i:05}", f"{i:05}") for i in range(300)} <= got


@pytest.mark.parametrize("rows", [[], [(None,) * 6], [("", "", "", "", "", 0)], [("x" * 100_000, "y" * 100_000, "z" * 100_000, None, None, None)]])
def test_edges(spark, rows):
    assert found(spark, rows) == set()
