import random
import re
from collections import Counter

import pytest

from lontar.llm import templates as T

SCHEMA = "id string, deskripsi string, segment string, n int, template string"
ORDINARY = [
    "Ke kampus <10 menit jalan kaki. Parkir $ gratis $ untuk motor.", "Penghuni banyak yang kursus JavaScript di sebelah kos.", "Kamar nomor 404 ada di lantai empat.",
    "[Khusus karyawati] tersedia diskon 10%.", "Harga 100% sudah termasuk air.", "Lemari model template pabrik, rapi.", "Halaman depan luas.", "Kamar kosong.", "Banjir tidak pernah ditemukan di gang ini.",
]
RESIDUE = [
    "Kos tenang. Hubungi {{kontak}} untuk survei.", "Hubungi %kontak% untuk survei", "Hubungi [kontak?] untuk survei", "Nama kos {nama_kos} beralamat di #alamat#.", "Harga Rp NaN per bulan.", "Dekat {}, {} menit.",
    "Lorem ipsum dolor sit amet consectetur.", "Error 503: Service Unavailable", "asdf asdf ASDF asdfasdf asd", '{"status":404,"error":"Not Found"}',
]
#: Pages that several ids give whole, in wording that the package does not know; then variants and parts of them.
OUTAGE = ["Mohon bersabar, peladen penuh sesak siang ini. Nomor rujukan 7f3a", "Gunakan penjelajah yang dapat menjalankan program laman"]
VARIANTS = ["Mohon bersabar, peladen penuh sesak siang ini.", "Gunakan penjelajah yg dapat mnejalankan program laman", "Kamar luas dan bersih, dekat pasar sore. Mohon bersabar, peladen penuh sesak siang ini. Nomor rujukan 19"]
SHORT = ["Kamar kosong.", "Chat saja."]


def rows(texts):
    return [(f"{i:03}", t, "clash", 1, "clash") for i, t in enumerate(texts)]


def test_residue_is_found_and_ordinary_text_is_not(spark):
    df = spark.createDataFrame(rows(RESIDUE + ORDINARY) * 2, SCHEMA)
    found = {r.id for r in T.residue_ids(df).collect()}
    assert found == {f"{i:03}" for i in range(len(RESIDUE))}
    assert T.without_residue(df).count() == 2 * len(ORDINARY)


def test_pages_that_repeat_are_found_whatever_their_wording(spark):
    things = "ac wifi kasur lemari kursi meja dapur".split()
    ads = [f"Kamar kosong di lantai tiga, chat pemilik untuk survei. Saja {v} dan {w}." for v in things for w in things]
    texts = OUTAGE * 4 + VARIANTS + SHORT * 3 + ads
    found = {int(r.id) for r in T.residue_ids(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert found == set(range(8 + len(VARIANTS)))


def test_slots_that_keep_their_names_are_found_by_alignment(spark):
    names = ["Melati Asri", "Puri Indah", "Griya Teduh", "Omah Sejuk", "Wisma Rapi"]
    full = [f"Kos {n} harga {400 + k} ribu, telp {k}12345. Nomor {'AC' if k % 2 else 'TV'}." for k, n in enumerate(names)]
    kept = ["Kos NAMA_KOS harga 500 ribu, telp 812.", "Kos Melati Asri harga HARGA ribu, telp 812.", "Kos Puri Indah harga 450 ribu, telp TELP.", "Kos ____ harga 450 ribu, telp 812."]
    found = {int(r.id) for r in T.residue_ids(spark.createDataFrame(rows(full + kept), SCHEMA)).collect()}
    assert found == set(range(len(full), len(full) + len(kept)))


def test_a_bracketed_filler_needs_evidence(spark):
    one = spark.createDataFrame(rows(["Kamar [dekat kampus] bersih."]), SCHEMA)
    assert T.residue_ids(one).count() == 0
    more = spark.createDataFrame(rows(["Hubungi [nama] untuk survei.", "Nama kos #nama# saja.", "Hubungi [ikaln] untuk survei."]), SCHEMA)
    assert T.residue_ids(more).count() == 3  # the third shares the template of the first


class Never:
    def search(self, text):
        raise AssertionError(text)

    finditer = search


def test_expressions_are_tried_only_where_their_parts_stand(monkeypatch):
    plain = ["Kamar luas dan bersih, dekat pasar sore.", "Harga Rp 0.000 per bulan", "Parkir (motor", "AC, TV, wifi ...", ""]
    kept = {"Kos NAMA_KOS": 1, "kos ____": 1, "kos .....": 1, "kos ……": 1, "Kos HARGA ribu": 1, "__nama__": 1, "[nama]": 1, "Hubungi $kontak$ atau &alamat;": 2}
    assert {s: len(T.spans_of(s)) for s in kept} == kept
    assert all(T._missing(f"Harga {x} saja") for x in ("NaN", "undefined", "null", ": None", "[object Kos]", "#N/A", "#DIV/0!", "{ }", "%s")) and not T._missing("Nonest #0 0%s {a}")
    for name in ("MARKED", "BARE", "MISSING"):
        monkeypatch.setattr(T, name, Never())
    assert not any(T.spans_of(s) or T._missing(s) for s in plain)


def test_words_typed_over_are_told_by_their_roots():
    """As every root against every other tells it, whatever letters the words begin with."""

    def by_roots(words):
        words = [w for w in words if w != "0"]
        roots = Counter(re.sub(r"^(.+?)\1+$", r"\1", w) for w in words)
        alike = lambda w, v: v == w or len(w) >= 3 and v.startswith(w) or len(v) >= 3 and w.startswith(v)
        most = max((sum(n for v, n in roots.items() if alike(w, v)) for w in roots if len(w) >= 2 or roots[w] > 1), default=0)
        return len(words) >= 3 and (most >= 3 and most >= 0.5 * len(words) or len(words) >= 6 and len(roots) <= 0.4 * len(words))

    some = random.Random(5)
    cases = [some.choices(["asd", "asdf", "asdasd", "a", "aa", "tes", "test", "kos", "x", "0", "b", "qwe"], k=some.randint(0, 9)) for _ in range(3000)]
    assert {by_roots(c) for c in cases} == {True, False}
    assert [T.typed_over(c) for c in cases] == [by_roots(c) for c in cases]


def test_texts_are_cut_once(spark, monkeypatch):
    """Distinct segments are counted from the segments kept for each row."""
    cut, tried = T.segments, []
    monkeypatch.setattr(T, "segments", lambda text: tried.append(text) or cut(text))
    df = spark.createDataFrame(rows(RESIDUE + ORDINARY) * 2, SCHEMA)
    assert T.residue_ids(df).count() == len(RESIDUE) and len(tried) == 1


@pytest.mark.parametrize("texts", [[], [None], [""], ["  \n "], ["x" * 300_000], ["kos " * 50_000 + "{{harga}}"]])
def test_edges(spark, texts):
    df = spark.createDataFrame(rows(texts), SCHEMA)
    assert T.residue_ids(df).count() == sum(bool(t) and "{{" in t for t in texts)


def test_null_ids_are_no_case(spark):
    df = spark.createDataFrame([(None, RESIDUE[0], "", 1, "")], SCHEMA)
    assert T.residue_ids(df).count() == 0 and T.without_residue(df).count() == 1
