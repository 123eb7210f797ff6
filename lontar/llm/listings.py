"""Product listings describing the same item: multi-pass sorted neighbourhood, soft token alignment, correlation clustering.

Plan
----
1. ``features`` reads each advertisement once (Arrow batches): the house's name from the title and from the description
   (the words that are not generic: offer, tenants, marketing, places; in the description, the first two or more of them
   in a row), the street address, sub-district, tenant type, room class, size in centimetres, price.
2. Rows with the same features are copies: one stands for all, however many there are, under the hash of the features.
3. ``PASSES`` sort the representatives by differently ordered keys (title name, description name with its words turned
   round, street and number, number and street turned round) with a range partitioning, and compare each row with its
   ``WINDOW`` predecessors. Where more rows than that share a key, each is also compared with the first row of every
   state (place, tenant, class, size, price step) under the key: so no block is too large, and none is compared pair by
   pair. Borders of partitions are compared in a small second step, each under its own key.
4. Two rows describe one room if the house is the same (equal names or names whose words align softly, or equal or
   softly aligned streets with equal number; no contradicting sub-district), nothing stated contradicts, and class,
   size or price agree. Weights add up the evidence.
5. ``clusters``: correlation clustering by parallel pivots. The most complete rows become pivots first; the others join
   the neighbouring pivot of greatest weight; clusters are clustered again until no link is left between two that do not
   contradict.

Null and empty fields are unknown, which contradicts nothing and supports nothing. Rows without name and street stay
alone. Repeated rows of an id count once; ids with differing rows are placed by each of them.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm import canonical
from lontar.llm.addresses import parse_address
from lontar.runtime import bounded_broadcast, cut_lineage

#: A word is generic if this share of titles or descriptions uses it, at ``FEW`` different house numbers or more: a house
#: has one, however many advertisements it has.
GENERIC = 0.004
FEW = 12
WINDOW = 16

# How advertisements state room class, tenants, and size.
CLASSES = {"vip": r"v\.i\.p|vip", "suite": r"suite", "deluxe": r"deluxe|dlx", "economy": r"ekonomi|eko|hemat", "standard": r"standar[dt]?|std"}
_CLASS = re.compile(r"\b(?:" + "|".join(f"(?P<{a}>{b})" for a, b in CLASSES.items()) + r")(?![a-z])")
_SIZE = re.compile(r"\b(\d{1,3}(?:[.,]\d)?) ?(?:m|cm)? ?(?:x|×|kali) ?(\d{1,3}(?:[.,]\d)?)")
_TENANT = re.compile(r"(?P<campur>putra ?/ ?putri|campur|bebas(?! (?:banjir|jam))|(?<!renang )(?<!pantry )umum|male or female)|(?P<putra>putra|cowok|laki-laki|pria|(?<!fe)male)|(?P<putri>putri|cewek|wanita|perempuan|female)")
_PRICE = re.compile(r"\b(?:rp|idr) ?(\d{1,3}(?:[.,]\d{3})+)|\b(\d+(?:[.,]\d+)?) ?(jt|juta|rb|ribu|k)\b")
_WORD = re.compile(r"[a-z]{4,}")
_RUN = re.compile(r"[a-z]+|[.!?\n;:]")
TENANTS = {"putra": 1, "putri": 2, "campur": 3}
CLASS_CODES = {name: k for k, name in enumerate(CLASSES, 1)}

FEATURES = "id string, title_name string, text_name string, street string, number string, place string, tenant int, class int, size int, price bigint"


# What a text must hold for the expressions above to be tried: looking for a part costs far less than they do.
_DIGIT = re.compile(r"\d")
_TENANT_START = re.compile(r"putr|campur|bebas|umum|male|female|cowok|laki-laki|pria|cewek|wanita|perempuan")
_CLASS_PARTS = ("v.i.p", "vip", "suite", "deluxe", "dlx", "eko", "hemat", "std", "standar")


def _any(parts: tuple[str, ...], text: str) -> bool:
    for x in parts:
        if x in text:
            return True
    return False


def _tenant(text: str) -> int | None:
    start = _TENANT_START.search(text)
    return TENANTS[m.lastgroup] if start and (m := _TENANT.search(text, start.start())) else None


def _class(text: str) -> int | None:
    return CLASS_CODES[m.lastgroup] if _any(_CLASS_PARTS, text) and (m := _CLASS.search(text)) else None


def _size(text: str) -> int | None:
    if not (_any(("x", "×", "kali"), text) and _DIGIT.search(text) and (m := _SIZE.search(text))):
        return None
    a, b = (float(x.replace(",", ".")) for x in m.groups())
    a, b = sorted(round(x if x >= 20 else x * 100) for x in (a, b))
    return a * 1000 + b


def _price(text: str) -> int | None:
    if not (_DIGIT.search(text) and (m := _PRICE.search(text))):
        return None
    if m[1]:
        return int(re.sub(r"\D", "", m[1]))
    return int(round(float(m[2].replace(",", ".")) * (1_000_000 if m[3].startswith("j") else 1000)))


def _first(*found: int | None) -> int | None:
    """The first that is known."""
    return next((x for x in found if x is not None), None)


def room_price(stated: float | None, text: str) -> int:
    """Monthly price in rupiah, 0 if unknown: as the text says, else the field, read as thousands if it is small."""
    return _stated_price(stated, _price(text))


def _stated_price(stated: float | None, told: int | None) -> int:
    if told is not None:
        return told
    if stated is not None and stated == stated:
        p = int(stated) * (1000 if 100 <= stated < 10_000 else 1)
        return p if 100_000 <= p <= 20_000_000 else 0
    return 0


def read_room(title: str, text: str, kind: str) -> tuple[int, int, int]:
    """Codes of tenant type, class and size (width * 1000 + length in centimetres) as stated in lower-case texts; 0 where
    they are not. The shorter side of a size comes first."""
    return _codes_of(title, (_tenant(text), _class(text), _size(text)), kind)


def _codes_of(title: str, told: tuple[int | None, int | None, int | None], kind: str) -> tuple[int, int, int]:
    """What a room is by its title and by what its description tells of tenant, class and size."""
    tenant, room, size = told
    tenant = _first(_tenant(title), tenant)
    size = _size(title) if size is None else size
    return TENANTS.get(kind.strip().lower(), 0) if tenant is None else tenant, _first(_class(title), room) or 0, size or 0


def told_name(text: str, generic: set[str]) -> list[str]:
    """The words that may be the house's name in a lower-case description: the first two or more in a row, in one
    sentence, that are not generic."""
    if len([w for w in _WORD.findall(text) if w not in generic]) < 2:
        return []
    run: list[str] = []
    for w in [*_RUN.findall(text), "."]:
        if len(w) >= 4 and w not in generic:
            run.append(w)
        elif len(run) >= 2:
            return run
        else:
            run = []
    return []


#: Letters of different sentences that a task keeps at once.
KEPT = 1 << 24


def sentences(text: str) -> list[str]:
    """``text`` cut at line ends and after full stops: no word, size, price or other statement that is read goes across."""
    return text.replace("\n", ". ").split(". ")


class Descriptions:
    """Lower-case descriptions read by sentences, each different one once: most stand in many advertisements."""

    def __init__(self, generic: set[str]) -> None:
        self.generic, self.seen, self.letters = generic, {}, 0

    def __call__(self, text: str) -> tuple[int | None, int | None, int | None, int | None, list[str]]:
        """Tenant, class, size, price and the words of the name: of each, what the first sentence that tells it says."""
        tenant = room = size = price = None
        told: list[str] = []
        seen = self.seen
        for s in sentences(text):
            known = seen.get(s, 0)
            if known == 0:
                known = self._read(s)
            if known is not None:
                tenant = known[0] if tenant is None else tenant
                room = known[1] if room is None else room
                size = known[2] if size is None else size
                price = known[3] if price is None else price
                told = told or known[4]
        return tenant, room, size, price, told

    def _read(self, s: str):
        if self.letters > KEPT:
            self.seen.clear()
            self.letters = 0
        found = _tenant(s), _class(s), _size(s), _price(s), told_name(s, self.generic)
        self.seen[s] = found = found if found != (None, None, None, None, []) else None
        self.letters += len(s) + 100
        return found


_DIGITS = re.compile(r"[0-9]{1,9}")


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(field, word, n, bits) of titles and descriptions, added up over the different sentences of many rows."""
    names = ("judul", "deskripsi")
    kept: tuple[dict, dict] = ({}, {})
    letters = 0

    def counted() -> pd.DataFrame:
        rows = []
        for name, uses in zip(names, kept):
            words: dict[str, list[int]] = {}
            for s, (n, bits) in uses.items():
                for w in _WORD.findall(s):
                    if (known := words.get(w)) is None:
                        words[w] = [n, bits]
                    else:
                        known[0] += n
                        known[1] |= bits
            rows += [(name, w, n, bits) for w, (n, bits) in words.items()]
            uses.clear()
        return pd.DataFrame(rows, columns=["field", "word", "n", "bits"])

    for pdf in batches:
        for title, text, address in zip(pdf["judul"], pdf["deskripsi"], pdf["alamat"]):
            m = _DIGITS.search(address) if address else None
            bit = 1 << int(m[0]) % 61 if m else 0
            for uses, value in zip(kept, (title, text)):
                for s in sentences(value.lower()) if value else ():
                    if (known := uses.get(s)) is None:
                        uses[s] = [1, bit]
                        letters += len(s) + 100
                    else:
                        known[0] += 1
                        known[1] |= bit
            if letters > KEPT:
                yield counted()
                letters = 0
    yield counted()


def generic_words(listings: DataFrame) -> set[str]:
    """The words used at least ``GENERIC`` times as often as there are titles, or descriptions, at ``FEW`` different first numbers of the
    address (told apart modulo 61, a bit each): at most 1 / GENERIC times the length of a title and a description of them."""
    totals = listings.agg(F.count("judul").alias("judul"), F.count("deskripsi").alias("deskripsi")).first()
    words = listings.select("judul", "deskripsi", "alamat").mapInPandas(_word_counts, "field string, word string, n bigint, bits bigint")
    counted = words.groupBy("field", "word").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits")).where(F.bit_count("bits") >= FEW)
    enough = F.lit(False)
    for name in ("judul", "deskripsi"):
        enough |= (F.col("field") == name) & (F.col("n") >= max(FEW, GENERIC * totals[name]))
    return {r["word"] for r in counted.where(enough).select("word").distinct().collect()}


def features(listings: DataFrame, districts: DataFrame) -> DataFrame:
    """One row per advertisement, columns ``FEATURES``; place is an entry of ``districts`` (entry, aliases)."""
    fields = ["id", "judul", "deskripsi", "alamat", "kecamatan", "tipe", "harga_per_bulan"]
    rows = listings.where(F.col("id").isNotNull()).select(*fields)
    raw = rows.select(F.lit("kecamatan").alias("field_name"), F.col("kecamatan").alias("raw_value")).where(~canonical.blank(F.col("raw_value"))).distinct()
    places = cut_lineage(canonical.map_values(cut_lineage(raw), districts.select(F.lit("kecamatan").alias("field_name"), "entry", "aliases")))
    places = places.where(F.col("entry") != canonical.UNMATCHED).select(F.col("raw_value").alias("kecamatan"), F.col("entry").alias("place"))
    known = [r["entry"] for r in districts.select("entry").dropna().distinct().collect()]  # the reference list
    generic = generic_words(rows)
    shared = rows.sparkSession.sparkContext.broadcast((generic, known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generic, known = shared.value
        named = re.compile("|".join(re.escape(x.lower()) for x in sorted(known, key=len, reverse=True)) or r"(?!)")
        proper = {x.lower(): x for x in known}
        tell = Descriptions(generic)
        for pdf in batches:
            out = []
            for id_, title, text, address, place, kind, price in zip(pdf["id"], pdf["judul"], pdf["deskripsi"], pdf["alamat"], pdf["place"], pdf["tipe"], pdf["harga_per_bulan"]):
                title, text = (title or "").lower(), (text or "").lower()
                called = [w for w in _WORD.findall(title) if w not in generic]
                *codes, told_price, told = tell(text)
                where = parse_address(address) if address else None
                if not place and (m := named.search((address or "").lower()) or named.search(title) or named.search(text)):
                    place = proper[m[0]]
                tenant, room, size = _codes_of(title, codes, kind or "")
                street, number = (where[0], "|".join(where[1:4])) if where else ("", "")
                out.append((id_, " ".join(called), " ".join(told), street, number, place or "", tenant, room, size, _stated_price(price, told_price)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return rows.join(bounded_broadcast(places), "kecamatan", "left").select("id", "judul", "deskripsi", "alamat", "place", "tipe", "harga_per_bulan").mapInPandas(run, FEATURES)


#: Two prices of one room may differ by this much, as a logarithm.
PRICE = 0.12
PASSES = ("title", "text", "street", "number")
#: Pairs of rows that are compared at once, which bounds what a comparison holds, whatever rows share a key.
PAIRS = 1 << 18
_TOLD = ("place_code", "tenant", "number_code")
_READ = ("title_name", "text_name", "street", "number", "place", "tenant", "class", "size", "price")
_MATCH = "a bigint, b bigint, weight double, border binary, at int"


def _words_alike(a: str, b: str) -> bool:
    """Soft alignment: every word of the shorter name has its own near word (a fifth of its letters off) in the other."""
    x, y = sorted((a.split(), b.split()), key=len)
    y = list(y)
    for w in x:
        near = next((v for v in y if abs(len(v) - len(w)) <= 2 and canonical.within(w, v, max(1, len(w) // 5))), None)
        if near is None:
            return False
        y.remove(near)
    return len(x) >= 2 or (len(x) == 1 and len(y) == 0)


def _same_name(a: tuple[str, str], b: tuple[str, str]) -> bool | None:
    """Whether the names (title, text) of two rows agree in some pair; None if either row has none."""
    left, right = [x for x in a if x], [x for x in b if x]
    return any(_words_alike(x, y) for x in left for y in right) if left and right else None


def _compare(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """The pairs (a, b, weight) of rows i and j that describe one room."""
    c = {n: rows[n].to_numpy() for n in rows.columns}
    for n in _TOLD:  # most neighbours differ in one of these
        x, y = c[n][i], c[n][j]
        may = (x == y) | (x == 0) | (y == 0)
        i, j = i[may], j[may]
    agree = {n: (c[n][i] == c[n][j]) & (c[n][i] != 0) for n in ("tenant", "class", "size", "place_code", "street_code", "number_code")}
    open_ = {n: (c[n][i] == 0) | (c[n][j] == 0) for n in ("tenant", "class", "size", "place_code", "street_code", "number_code")}
    ok = np.ones(len(i), dtype=bool)
    for n in ("tenant", "class", "size", "place_code", "number_code"):
        ok &= agree[n] | open_[n]
    p, q = c["price"][i].astype(float), c["price"][j].astype(float)
    priced = (p > 0) & (q > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.abs(np.log(p / q))
    near = priced & (gap <= PRICE)
    ok &= agree["class"] | near | (agree["size"] & ~priced)
    t, x = c["title_code"], c["text_code"]
    named = sum(((u[i] == v[j]) & (u[i] != 0)).astype(int) for u, v in ((t, t), (t, x), (x, t), (x, x))) > 0
    address = agree["number_code"] & agree["street_code"]
    maybe = named | agree["number_code"] | (((t[i] != 0) | (x[i] != 0)) & ((t[j] != 0) | (x[j] != 0)))
    out = []
    for k in np.nonzero(ok & maybe)[0]:
        a, b = i[k], j[k]
        weight = agree["class"][k] + agree["size"][k] + (1 - gap[k] / PRICE if near[k] else 0)
        if named[k]:
            name = True
        else:
            name = _same_name((c["title_name"][a], c["text_name"][a]), (c["title_name"][b], c["text_name"][b]))
            if name is False:
                continue
        street = bool(address[k]) or bool(agree["number_code"][k]) and canonical.within(c["street"][a], c["street"][b], 2)
        if not name and not street:
            continue
        weight += (3 if named[k] else 2 if name else 0) + (3 if address[k] else 2 if street else 0)
        if c["id"][a] != c["id"][b]:
            out.append((*sorted((int(c["id"][a]), int(c["id"][b]))), float(weight)))
    return _links(out)


def _links(rows: list[tuple[int, int, float]]) -> pd.DataFrame:
    """A table of (a, b, weight), typed also when it is empty."""
    return pd.DataFrame({"a": np.array([r[0] for r in rows], dtype=np.int64), "b": np.array([r[1] for r in rows], dtype=np.int64), "weight": np.array([r[2] for r in rows], dtype=float)})


def _windows(n: int, first: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of each of rows first..n-1 and each of its WINDOW predecessors, none before ``start``."""
    later = np.arange(first, n)
    i = np.concatenate([later - d for d in range(1, WINDOW + 1)])
    j = np.tile(later, WINDOW)
    return i[i >= start], j[i >= start]


_STATE = ("key_code", "place_code", "tenant", "class", "size", "number_code")


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """The first row of every state under every key."""
    step = np.floor(np.log(np.maximum(rows["price"].to_numpy(dtype=float), 1)) / PRICE).astype(int)
    return rows[~rows.assign(step=step)[[*_STATE, "step"]].duplicated()]


def _not_apart(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows ``left`` and ``right`` that state no different place, tenant or number, of ``PAIRS`` at a time;
    a row on the left meets those on the right whose number is greater than its ``after``."""
    place, *told = (rows[n].to_numpy() for n in _TOLD)
    for p in np.unique(place[right]):  # most states are of other places, and not met one by one
        here, meets = right[place[right] == p], (place[left] == p) | (place[left] == 0) | (p == 0)
        near, past = left[meets], after[meets]
        for start in range(0, len(here), PAIRS):
            some = here[start : start + PAIRS]
            step = max(1, PAIRS // len(some))
            for at in range(0, len(near), step):
                part = near[at : at + step]
                may = some[None, :] > past[at : at + step, None]
                for c in told:
                    x, y = c[part][:, None], c[some][None, :]
                    may &= (x == y) | (x == 0) | (y == 0)
                a, b = np.nonzero(may)
                yield part[a], some[b]


def _together(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in groups of ``PAIRS`` at most: few, as each costs a call."""
    kept, n = [], 0
    for left, right in pairs:
        for start in range(0, len(left), PAIRS):
            i, j = left[start : start + PAIRS], right[start : start + PAIRS]
            if kept and n + len(i) > PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*kept))
                kept, n = [], 0
            kept.append((i, j))
            n += len(i)
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept))


def _with_states(rows: pd.DataFrame, first: int, reps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """States, and the rows first.. that share a key with them farther back than the window. The first ``reps`` rows
    are states of the key that the batch begins with."""
    codes, sizes = np.unique(rows["key_code"].to_numpy(), return_counts=True)
    if not (sizes > WINDOW).any():
        return
    key = rows["key_code"].to_numpy()
    heads = _states(rows).index.to_numpy()
    for k in codes[sizes > WINDOW]:
        own, hs = np.nonzero(key == k)[0], heads[key[heads] == k]
        yield from _not_apart(rows, hs, own[own >= first], hs + np.where(hs >= reps, WINDOW, 0))


def _name_code(c: str) -> Column:
    words = F.split(c, " ")
    return F.when(F.size(words) >= 2, F.xxhash64(F.array_join(F.array_sort(words), " "))).otherwise(F.lit(0).cast("bigint"))


def _code(c: str) -> Column:
    return F.when(F.col(c) == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(c))


def _codes() -> dict[str, Column]:
    """Integers for names (whatever the order of their words) and places, 0 for unknown, computed after the shuffle."""
    return {"title_code": _name_code("title_name"), "text_code": _name_code("text_name"), "place_code": _code("place"), "street_code": _code("street"), "number_code": _code("number"), "key_code": _code("key")}


def _pass_key(name: str) -> Column:
    """The leading sort key of a pass; empty for rows that it leaves out."""

    def words(c: str, other: str, ascending: bool) -> Column:
        return F.array_join(F.sort_array(F.split(F.when(F.col(c) != "", F.col(c)).otherwise(F.col(other)), " "), ascending), " ")

    house = F.col("street") != ""
    return {
        "title": words("title_name", "text_name", True),
        "text": words("text_name", "title_name", False),
        "street": F.when(house, F.concat_ws("|", "street", "number")).otherwise(""),
        "number": F.when(house, F.concat_ws("|", "number", F.reverse("street"))).otherwise(""),
    }[name]


def sorted_neighbours(rows: DataFrame, name: str) -> DataFrame:
    """(a, b, weight): the matches among each row and its ``WINDOW`` predecessors in the order of the pass ``name``, whose
    key stands in the column ``key_`` and its name."""

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, carry, reps, opening = None, None, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            parts = [x for x in (reps, carry) if x is not None] + [pdf]
            both = pd.concat(parts, ignore_index=True) if len(parts) > 1 else pdf.reset_index(drop=True)
            n, known = 0 if reps is None else len(reps), len(both) - len(pdf)
            for i, j in _together(chain([_windows(len(both), known, n)], _with_states(both, known, n))):
                found = _compare(both, i, j)
                if len(found):
                    yield found.assign(border=None, at=None)
            head = both.iloc[n : n + WINDOW].reset_index(drop=True) if head is None or len(head) < WINDOW else head
            carry = both.iloc[n:].iloc[-WINDOW:].reset_index(drop=True)
            key = both["key_code"].to_numpy()
            firsts = _states(both[key == key[n]])
            if opening is None or len(firsts) and opening["key_code"].iloc[0] == key[n]:
                opening = firsts if opening is None else _states(pd.concat([opening, firsts], ignore_index=True))
            # states of the last key that the carried rows do not hold themselves
            reps = _states(both[key == key[-1]]).reset_index(drop=True)
        if carry is not None:
            border = pickle.dumps((head, carry, opening.reset_index(drop=True), reps))
            yield pd.DataFrame({"a": [0], "b": [0], "weight": [0.0], "border": [border], "at": [TaskContext.get().partitionId()]})

    keyed = rows.select("id", *_READ, F.col(f"key_{name}").alias("key")).where(F.col("key") != "")
    order = ("key", "place", "tenant", "class", "size", "id")
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(_codes()).drop("key", "place", "number")
    slid = cut_lineage(ordered.mapInPandas(slide, _MATCH))

    # each partition meets those before it, as far back as the window reaches: numbers of partitions, not rows
    filled = sorted(r["at"] for r in slid.where("border is not null").select("at").collect())
    meets = [(at, k) for n, at in enumerate(filled) for k in filled[max(0, n - 1) : n + 1]]
    frame = slid.where("border is not null").select("at", "border")
    turns = rows.sparkSession.createDataFrame(meets or [(-1, -1)], "turn int, at int")

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        """The end of one partition and the beginning of the next."""
        two = [pickle.loads(raw) for raw in pdf.sort_values("at")["border"]]
        if len(two) < 2:
            return _links([])
        (_, tail, _, last), (head, _, opening, _) = two
        both = pd.concat([tail, head], ignore_index=True)
        i, j = _windows(len(both), len(tail))
        crossing = i < len(tail)
        out = [_compare(both, i[crossing], j[crossing])]
        if len(last) and len(opening) and last["key_code"].iloc[0] == opening["key_code"].iloc[0]:
            states = pd.concat([last, opening], ignore_index=True)
            a, b = np.arange(len(last)), np.arange(len(last), len(states))
            out += [_compare(states, i, j) for i, j in _together(_not_apart(states, a, b, a))]
        return pd.concat(out, ignore_index=True)

    at_borders = frame.join(F.broadcast(turns), "at").groupBy("turn").applyInPandas(borders, "a bigint, b bigint, weight double")
    return slid.where("border is null").select("a", "b", "weight").unionByName(at_borders)


_STATED = ("tenant", "class", "size", "number_code")


def _pivots(edges: DataFrame) -> DataFrame | None:
    """(node, pivot) of the nodes of ``edges`` (a, b, weight, rank_a, rank_b), each link given in both directions.

    In every round the nodes that rank before all their open neighbours become pivots, and their neighbours join the
    one with the greatest weight. None if there are no edges.
    """
    found = []
    while not edges.isEmpty():
        first = edges.groupBy("a").agg(F.min("rank_b").alias("ahead"), F.first("rank_a").alias("rank_a"))
        pivots = cut_lineage(first.where(F.col("rank_a") < F.col("ahead")).select(F.col("a").alias("b")))
        joined = edges.join(pivots, "b").groupBy("a").agg(F.min_by("b", F.struct(-F.col("weight"), F.col("rank_b"))).alias("pivot"))
        closed = cut_lineage(joined.select(F.col("a").alias("node"), "pivot").unionByName(pivots.select(F.col("b").alias("node"), F.col("b").alias("pivot"))))
        found.append(closed)
        gone = closed.select("node")
        edges = cut_lineage(edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    out = found[0] if found else None
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cluster) by correlation clustering; nodes without links do not appear.

    ``nodes`` (id, rank, and the columns that may contradict: 0 is unknown), ``links`` (a, b, weight), a < b. After the
    first pivots, clusters that are still linked and whose stated columns, taken together, do not contradict are
    clustered again until no such link is left: the chain from a row known by name only over one with both to one known by
    address only is closed that way.
    """
    placed, states, open_ = None, nodes.select("id", "rank", *_STATED), links
    while True:  # every turn merges clusters, or is the last
        left = states.select(F.col("id").alias("a"), F.col("rank").alias("rank_a"), *(F.col(c).alias(f"{c}_a") for c in _STATED))
        right = states.select(F.col("id").alias("b"), F.col("rank").alias("rank_b"), *(F.col(c).alias(f"{c}_b") for c in _STATED))
        agree = F.lit(True)
        for c in _STATED:
            agree &= (F.col(f"{c}_a") == F.col(f"{c}_b")) | (F.col(f"{c}_a") == 0) | (F.col(f"{c}_b") == 0)
        good = open_.join(left, "a").join(right, "b").where(agree).select("a", "b", "weight", F.struct("rank_a", "a").alias("rank_a"), F.struct("rank_b", "b").alias("rank_b"))
        swapped = good.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight", F.col("rank_b").alias("rank_a"), F.col("rank_a").alias("rank_b"))
        swapped = swapped.select("a", "b", "weight", F.struct(F.col("rank_a.rank_b").alias("rank_a"), F.col("rank_a.b").alias("a")).alias("rank_a"), F.struct(F.col("rank_b.rank_a").alias("rank_b"), F.col("rank_b.a").alias("b")).alias("rank_b"))
        step = _pivots(cut_lineage(good.unionByName(swapped)))
        if step is None:
            break
        if placed is None:
            placed = step.withColumnRenamed("pivot", "cluster")
        else:
            moved = placed.join(step.select(F.col("node").alias("cluster"), "pivot"), "cluster", "left").select("node", F.coalesce("pivot", "cluster").alias("cluster"))
            alone = step.join(placed.select("node"), "node", "left_anti").select("node", F.col("pivot").alias("cluster"))
            placed = moved.unionByName(alone)
        placed = cut_lineage(placed)
        home = placed.select(F.col("node").alias("id"), "cluster")
        merged = nodes.join(home, "id", "left").groupBy(F.coalesce("cluster", "id").alias("id")).agg(F.min("rank").alias("rank"), *(F.max_by(c, F.struct((F.col(c) != 0).cast("int"), -F.col("rank"))).alias(c) for c in _STATED))
        states = cut_lineage(merged)
        ends = open_.join(home.select(F.col("id").alias("a"), F.col("cluster").alias("x")), "a", "left").join(home.select(F.col("id").alias("b"), F.col("cluster").alias("y")), "b", "left")
        ends = ends.select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "weight").where("x != y")
        open_ = cut_lineage(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("weight").alias("weight")))
    if placed is None:
        return nodes.select(F.col("id").alias("node"), F.col("id").alias("cluster")).limit(0)
    return placed


def room_clusters(listings: DataFrame, districts: DataFrame) -> DataFrame:
    """(id, room): listings of one room share the value of ``room``; every id that has an advertisement is there."""
    read = features(listings, districts).withColumn("node", F.xxhash64(*_READ))
    read = cut_lineage(read.withColumn("alone", F.concat_ws("", "title_name", "text_name", "street") == ""))
    rooms = read.where("not alone").select(F.col("node").alias("id"), *_READ).distinct()
    rooms = cut_lineage(rooms.select("*", *(_pass_key(p).alias(f"key_{p}") for p in PASSES)))
    found = None
    for p in PASSES:
        step = sorted_neighbours(rooms, p)
        found = step if found is None else found.unionByName(step)
    links = cut_lineage(found.groupBy("a", "b").agg(F.max("weight").alias("weight")))
    linked = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = lambda c: F.when(F.col(c) != 0, 1).otherwise(0)
    named = F.when((F.col("title_name") != "") | (F.col("text_name") != ""), 2).otherwise(0)
    rank = 10 - (named + F.when(F.col("street") != "", 2).otherwise(0) + known("class") + known("size") + known("price"))
    nodes = rooms.join(linked, "id", "left_semi").select("id", rank.alias("rank"), "tenant", "class", "size", _code("number").alias("number_code"))
    placed = clusters(cut_lineage(nodes), links)
    home = read.where("not alone").select("id", "node").distinct().join(placed, "node", "left")
    housed = home.select("id", F.concat(F.lit("room "), F.coalesce("cluster", "node")).alias("room"))
    # rows that say nothing of the house: a room of their own, unless another row of the id says more
    rest = read.where("alone").select("id").distinct().join(read.where("not alone").select("id").distinct(), "id", "left_anti")
    return housed.unionByName(rest.select("id", F.concat(F.lit("only "), "id").alias("room"))).distinct()


def room_pairs(listings: DataFrame, districts: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids that offer one room."""
    placed = cut_lineage(room_clusters(listings, districts))
    a, b = placed.withColumnRenamed("id", "id_a"), placed.withColumnRenamed("id", "id_b")
    return a.join(b, "room").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
