"""Template residue and error-page text: unfilled placeholders, filler, error pages and script notices.

Nothing here knows the wording of any page. What is residue is induced from the records themselves:

Plan
----
1. Every text is cut into segments (lines and sentences, digits masked); the *distinct* segments are counted, and each
   row keeps the hashes of its segments. Texts of any length and sentences shared by any number of rows cost the same.
2. Repeated whole pages. A text that many ids give, whole, word for word (case, digits and signs aside), is not written
   for a listing. It is an error page, notice or default if its wording is its own: half of its pairs of words are
   seldom used by texts that do not repeat (a page of one or two words: all its words). Sentences of such pages are
   templates; ``spread_templates`` adds the sentences that share mostly pages made of templates.
3. Aligned slots. Within a segment, a span between signs, an identifier, a word in capitals or a blank is aligned with
   the other segments of the same template, which have the same two words before and after it. A name that stands
   between signs of two kinds and in two templates, or that is written as an identifier, is a variable; a slot that
   retains a variable, or a blank or a capitalised label where other records have a value, is residue. Values that
   programs print for something missing (null, NaN, %s, {} ...) are residue wherever they stand.
4. Filler: words typed over and over, and the passage of typesetters' Latin.
5. Distinct segments are held against the templates, each word to one edit, a fifth of the words may be missing; rows
   are found through the hashes of their segments.

A null, empty or short text without such a segment is no case. Repeated rows count once. Extra columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from http import HTTPStatus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.runtime import bounded_broadcast, cut_lineage

#: Ids that must give a text before it counts as repeated.
REPEATED = 3
#: A pair of words, or a sentence, belongs to repeated pages if this share of its uses is there.
OWN = 0.1
#: Templates that one pass over the distinct segments holds in memory; more are taken in several passes.
TEMPLATES = 50_000

# What programs print for a missing value, and the classical passage of filler text.
MISSING = re.compile(r"\bNaN\b|\bundefined\b|\bnull\b|[:,=]\s*None\b|\[object \w+\]|#(?:N/A|REF!|VALUE!|NAME\?|DIV/0!)|\{\s*\}|(?<![\d%])%[sdf]\b")
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in
reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
in culpa qui officia deserunt mollit anim id est laborum"""

_WORD = re.compile(r"[^\W_]+")
_OPEN = r"(?:[{\[<(%#@«&$\\|*~^=]+(?:\d+;)?[=%$]*|__)"
_CLOSE = r"(?:[?%$\\=]*[}\])>»%#@&;|*~^$]+(?:#?\d+;|[sd]\b)?|__)"
MARKED = re.compile(rf"(?<![^\W_])({_OPEN})\s*([A-Za-z$][\w.$ -]*?)\s*({_CLOSE})(?!\w)")
BARE = re.compile(r"(?<![\w@./-])(?:(?P<identifier>[A-Za-z]+(?:_[A-Za-z0]+)+)|(?P<blank>_{3,}|\.{5,}|…{2,})|(?P<capitals>[A-Z]{4,}))(?![\w@/-])")
#: Two signs of program code before a name: no prose opens a bracket so.
CODE = re.compile(r"[{\[<%#@$\\&]{2}|[%$]\(")
# What a segment must hold for the expressions above to be tried: looking for a part costs far less than they do.
_MISSING_PARTS = ("NaN", "undefined", "null", "None", "[object", "#", "{", "%")
_OPENS = re.compile(r"[{\[<(%#@«&$\\|*~^=_]")
_CLOSES = re.compile(r"[}\])>»%#@&;|*~^$_]")
_CAPITALS = re.compile(r"[A-Z][A-Z][A-Z][A-Z]")
IDENTIFIER = re.compile(r"^(?:\$?\w+[_.]\w[\w.]*|\$?[a-z]+[A-Z]\w*)$")


def segments(text: Column) -> Column:
    """The lines and sentences of a text, trimmed, each run of digits masked as 0."""
    parts = F.split(F.regexp_replace(text, r"\d+", "0"), r"(?<=[.!?])\s+|[\r\n]+")
    return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda s: s != ""))


def plain(text: Column) -> Column:
    """A text as its words: lower case, without tags, every run of other signs one blank, words with digits masked."""
    bare = F.regexp_replace(F.lower(text), r"</?[a-z]\w{0,9}/?>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b[^\W\d]*+\d\w*", "0"), r"[^\p{L}\p{N}]+", " "))


def _grams(words: Column) -> Column:
    """The pairs of neighbouring words of a text given as its words; of one or two words, the words."""
    w = F.split(words, " ")
    two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    return F.array_distinct(F.when(F.size(w) <= 2, w).otherwise(two))


def repeated_pages(df: DataFrame, column: str, key: str, rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(words, page, ids): whole texts that ``REPEATED`` ids or more give and whose wording is their own.

    ``rows`` has id and page (a hash of the text's words), ``counted`` words and n of the distinct segments. What shuffles
    is two hashes a row; texts follow for repeated pages only.
    """
    often = rows.groupBy("page").agg(F.count_distinct(F.xxhash64("id")).alias("ids"), F.min(F.xxhash64("id")).alias("one")).where(F.col("ids") >= REPEATED)
    often = bounded_broadcast(cut_lineage(often))
    some = df.where(F.col(column).isNotNull()).select(F.xxhash64(key).alias("one"), F.col(column).alias("text")).join(often.select("one").distinct(), "one", "left_semi")
    words = plain(F.col("text"))
    texts = cut_lineage(cut_lineage(some).select(words.alias("words"), F.xxhash64(words).alias("page")).where("words != ''").join(often, "page").select("words", "page", "ids").distinct())
    grams = texts.select("words", "page", "ids", F.explode(_grams(F.col("words"))).alias("gram"))
    here = cut_lineage(grams.groupBy("gram").agg(F.sum("ids").alias("here")))
    everywhere = _uses(counted, here.select("gram"))
    known = cut_lineage(here.join(everywhere, "gram", "left").select("gram", (F.col("here") >= OWN * F.greatest("here", F.coalesce("n", "here"))).cast("int").alias("own")))
    judged = grams.join(bounded_broadcast(known), "gram").groupBy("words", "page", "ids").agg(F.avg("own").alias("share"))
    short = F.size(F.split("words", " ")) <= 2
    return judged.where((short & (F.col("share") == 1)) | (~short & (F.col("share") >= 0.5))).select("words", "page", "ids")


def _uses(counted: DataFrame, wanted: DataFrame, *, pairs: bool = True) -> DataFrame:
    """(gram, n): how many rows' segments use each of the ``wanted`` words and pairs of words (gram); without ``pairs``,
    only words are wanted."""
    words = F.split("words", " ")
    both = F.concat(words, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))
    used = counted.where("words != ''").select("n", F.explode(F.array_distinct(F.when(F.size(words) > 1, both).otherwise(words) if pairs else words)).alias("gram"))
    return used.join(bounded_broadcast(wanted), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("n"))


def spread_templates(rows: DataFrame, counted: DataFrame, templates: DataFrame) -> DataFrame:
    """(words): sentences that are no templates yet but stand on pages mostly made of them, on at least two ids and in
    ``OWN`` of their uses. ``rows`` has id and hashes (of its segments), ``counted`` hash, words and n, ``templates`` words."""
    known = bounded_broadcast(cut_lineage(counted.join(bounded_broadcast(templates), "words", "left_semi").select("hash")))
    some = rows.select("id", "hashes", F.explode("hashes").alias("hash")).join(known, "hash", "left_semi")
    pages = some.groupBy("id", "hashes").agg(F.collect_set("hash").alias("known")).where(F.size("known") * 2 >= F.size("hashes"))
    others = pages.select("id", F.explode(F.array_except("hashes", "known")).alias("hash"))
    words = cut_lineage(counted.join(bounded_broadcast(cut_lineage(others.select("hash").distinct())), "hash").select("hash", "words"))
    there = others.join(bounded_broadcast(words), "hash").groupBy("words").agg(F.count_distinct("id").alias("there")).where((F.col("there") >= 2) & (F.col("words") != ""))
    uses = counted.select("words", "n").join(bounded_broadcast(cut_lineage(there)), "words").groupBy("words").agg(F.sum("n").alias("n"), F.max("there").alias("there"))
    return uses.where(F.col("there") >= OWN * F.col("n")).select("words")


def constant_parts(templates: DataFrame) -> DataFrame:
    """(words): what templates that begin alike, in four words, have in common: the rest is a slot.

    The common beginning of any number of texts is that of the first and the last of them, so no group is collected."""
    words = F.split("words", " ")
    begun = templates.where(F.size(words) >= 5).groupBy(F.array_join(F.slice(words, 1, 4), " ").alias("begin")).agg(F.min("words").alias("a"), F.max("words").alias("z"), F.count("*").alias("k"))
    a, z = F.split("a", " "), F.split("z", " ")
    alike = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(z))), lambda i: F.slice(a, F.lit(1), i) == F.slice(z, F.lit(1), i))
    return begun.where("k >= 3").select(F.array_join(F.slice(a, F.lit(1), F.array_max(alike)), " ").alias("words"))


#: What error pages call themselves: the reason phrases of the HTTP standard, after words and numbers such as "error 0".
PREFIX = re.compile(r"^(?:(?:http|error|status|code|0) )+")
REASONS = r"^(?:(?:http|error|status|code|0) )*(?:" + "|".join(sorted({re.sub(r"[^a-z]+", " ", s.phrase.lower()).strip() for s in HTTPStatus if s >= 400})) + r")$"


class Templates:
    """Segments held against templates (words, weights), each word to one edit by deletion neighbourhoods.

    A word weighs as much as its uses belong to templates. A segment matches with four fifths of the weight, half of that
    spelled as it is, and six tenths of the words; a template of ordinary words, or of one or two words, must be the whole segment.
    """

    def __init__(self, templates: list[tuple[str, dict[str, float]]]) -> None:
        self.weights, self.need, self.of, self.whole, self.known = [], [], {}, set(), set()
        for words, weight in templates:
            unique = list(dict.fromkeys(words.split()))
            heavy = sum(weight.get(w, 0.0) for w in unique)
            self.whole.add(words)
            self.known.update(unique)
            if len(unique) > 2 and heavy >= 1:
                self.weights.append({w: weight.get(w, 0.0) for w in unique})
                self.need.append((0.8 * heavy - 1e-9, max(2, 0.6 * len(unique))))
                for w in unique:
                    self.of.setdefault(w, []).append(len(self.need) - 1)
        self.latin = set(LATIN.split())
        self.reasons = re.compile(REASONS)
        self.known |= self.latin
        self.index: dict[str, str] = {}
        for w in sorted(self.known):
            for v in self._less(w) if len(w) >= 5 else ():
                self.index.setdefault(v, w)
        self.longest = 1 + max(map(len, self.known), default=0)
        self.seen: dict[str, str | None] = {}

    @staticmethod
    def _less(w: str) -> list[str]:
        return [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]

    def meant(self, w: str) -> str | None:
        if w in self.known:
            return w
        if not 4 <= len(w) <= self.longest:
            return None
        if w not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[w] = next((x for v in self._less(w) if (x := self.index.get(v)) and abs(len(x) - len(w)) <= 1), None)
        return self.seen[w]

    def kind(self, words: str) -> str | None:
        """template, error or filler; None for ordinary text."""
        raw = words.split()
        if not raw:
            return None
        if words in self.whole:
            return "template"
        if self.reasons.match(words):
            return "error"
        if (m := PREFIX.match(words)) and len((rest := words[m.end() :]).split()) > 1 and rest in self.whole:
            return "error"
        near = [x for w in raw if (x := self.meant(w))]
        if len(near) == len(raw) and " ".join(near) in self.whole:
            return "template"
        as_is, hits = set(raw), {}
        for w in set(near):
            for k in self.of.get(w, ()):
                hit = hits.setdefault(k, [0.0, 0.0, 0])
                hit[0] += self.weights[k][w]
                hit[1] += self.weights[k][w] if w in as_is else 0.0
                hit[2] += 1
        if any(x >= self.need[k][0] and exact >= x / 2 and n >= self.need[k][1] for k, (x, exact, n) in hits.items()):
            return "template"
        latin = [w for w in near if w in self.latin]
        if len(set(latin)) >= 3 and (len(latin) >= 0.6 * len(raw) or len({w for w in latin if len(w) >= 5}) >= 2):
            return "filler"
        return "filler" if typed_over(raw) else None


def typed_over(words: list[str]) -> bool:
    """Three words or more of which most are one word over and over, or beginnings of it, or few words in turn."""
    words = [w for w in words if w != "0"]
    if len(words) < 3:
        return False
    begin = [w[0] for w in words]  # words of one root begin with one letter, and most texts do not
    if max(map(begin.count, begin)) < max(3, 0.5 * len(words)) and (len(words) < 6 or len(set(begin)) > 0.4 * len(words)):
        return False
    base = [re.sub(r"^(.+?)\1+$", r"\1", w) for w in words]
    roots = Counter(base)
    stem = Counter()
    for w in roots:
        if len(w) >= 2 or roots[w] > 1:
            stem[w] = sum(n for v, n in roots.items() if v == w or len(w) >= 3 and v.startswith(w) or len(v) >= 3 and w.startswith(v))
    top = stem.most_common(1)
    return bool(top) and top[0][1] >= 3 and top[0][1] >= 0.5 * len(words) or len(words) >= 6 and len(roots) <= 0.4 * len(words)


SPANS = "hash bigint, segment string, n bigint, kind string, spans array<struct<style:string, name:string, context:string, label:boolean>>"


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+|[^\w\s]", text.lower())


def _context(before: str, after: str) -> str:
    left, right = ["^", "^", *_tokens(before)[-2:]][-2:], [*_tokens(after.rstrip(" .!?"))[:2], "$", "$"][:2]
    return "\x01".join([*left, *right])


def spans_of(segment: str) -> list[tuple[str, str, str, bool]]:
    """(style, name, context, label) of every span of a segment that may be an unfilled slot. style is the pair of signs
    around it, or identifier, blank or capitals; label tells that the word before it is the same."""
    found, covered = [], []
    marks = _OPENS.search(segment) and _CLOSES.search(segment)
    for m in MARKED.finditer(segment) if marks else ():
        name = m[2].strip()
        found.append((m[1] + " " + m[3], ("=" if IDENTIFIER.match(name) or CODE.match(m[1]) else "") + name.lower(), _context(segment[: m.start()], segment[m.end() :]), False))
        covered.append(m.span())
    bare = "_" in segment or "....." in segment or "……" in segment or _CAPITALS.search(segment)
    for m in BARE.finditer(segment) if bare else ():
        if any(a <= m.start() < b for a, b in covered) or m.lastgroup == "capitals" and segment.isupper():
            continue
        if m.lastgroup == "capitals" and (re.search(r"[A-Z]{2}\W*$", segment[: m.start()]) or re.match(r"\W*[A-Z]{2}", segment[m.end() :])):
            continue  # a name in capitals
        before = _tokens(segment[: m.start()])
        label = any(t == m[0].lower() for t in before[-2:])
        found.append((m.lastgroup, m[0].lower(), _context(segment[: m.start()], segment[m.end() :]), label))
    return found


def _missing(segment: str) -> bool:
    """Whether a value that programs print for something missing stands in the segment."""
    return any(x in segment for x in _MISSING_PARTS) and MISSING.search(segment) is not None


def _read(templates: list[tuple[str, dict[str, float]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Templates(templates)
        for pdf in batches:
            rows = []
            for h, segment, words, n in zip(pdf["hash"], pdf["segment"], pdf["words"], pdf["n"]):
                kind = "default" if _missing(segment) else held.kind(words)
                spans = [] if kind else spans_of(segment)
                if kind or spans:
                    rows.append((h, segment, n, kind, spans))
            yield pd.DataFrame(rows, columns=["hash", "segment", "n", "kind", "spans"])

    return run


def _aligned(contexts: list[str]):
    """What other records have in the given contexts: up to four words between the same two words before and after."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted: dict[tuple, dict[tuple, str]] = {}
        for c in contexts:
            a, b, x, y = c.split("\x01")
            wanted.setdefault((a, b), {})[x, y] = c
        for pdf in batches:
            rows = []
            for segment in pdf["segment"]:
                t = ["^", "^", *_tokens(segment.rstrip(" .!?")), "$", "$"]
                for i in range(2, len(t) - 2):
                    if rights := wanted.get((t[i - 2], t[i - 1])):
                        for j in range(i + 1, min(i + 5, len(t) - 1)):
                            if c := rights.get((t[j], t[j + 1])):
                                rows.append((c, " ".join(t[i:j])))
            yield pd.DataFrame(rows, columns=["context", "value"])

    return run


def _blocks(df: DataFrame, *columns: str) -> Iterator[list]:
    """The values of ``columns``, at most about ``TEMPLATES`` rows at a time."""
    blocks = -(-df.count() // TEMPLATES)
    for k in range(blocks):
        part = df.where(F.pmod(F.xxhash64(columns[0]), F.lit(blocks)) == k).select(*columns).collect()
        yield [r[0] if len(columns) == 1 else tuple(r) for r in part]


def _retained(read: DataFrame, counted: DataFrame) -> DataFrame:
    """(hash, segment, n): segments of which a slot retains a variable name or a blank."""
    spans = cut_lineage(read.where("kind is null").select("hash", "segment", "n", F.explode("spans").alias("s")).select("hash", "segment", "n", "s.*"))
    marked = spans.where(~F.col("style").isin("identifier", "blank", "capitals")).withColumns({"sure": F.startswith("name", F.lit("=")), "name": F.ltrim("name", F.lit("="))})
    found = marked.groupBy("name").agg(F.count_distinct("style").alias("styles"), F.count_distinct("context").alias("contexts"), F.bool_or("sure").alias("sure"))
    variables = cut_lineage(found.where("sure or (styles >= 2 and contexts >= 2)").select(F.col("name").alias("part")))
    # a name may stand within a phrase, such as an instruction to fill it in: every one or two of its words
    words = F.split("name", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    parts = F.array_distinct(F.concat(F.array("name"), words, F.when(F.size(words) > 1, pairs).otherwise(F.array())))
    holding = cut_lineage(marked.withColumn("part", F.explode(parts)).join(bounded_broadcast(variables), "part", "left_semi").select("hash", "segment", "n", "context"))
    # where a template keeps a variable, what other records have between signs there is a slot too
    slots = bounded_broadcast(cut_lineage(holding.select("context").distinct()))
    same = marked.join(slots, "context", "left_semi").select("hash", "segment", "n")

    bare = spans.where(F.col("style").isin("identifier", "blank", "capitals"))
    contexts = cut_lineage(bare.select("context").distinct())
    values = None
    for block in _blocks(contexts, "context"):
        step = counted.select("segment").mapInPandas(_aligned(block), "context string, value string")
        values = step if values is None else values.unionByName(step)
    if values is None:
        return holding.select("hash", "segment", "n").unionByName(same).distinct()
    number = F.col("value").rlike(r"^[^\p{L}]*\d[^\p{L}]*$")
    slot = values.groupBy("context").agg(F.count_distinct("value").alias("values"), F.avg(number.cast("int")).alias("numeric"), F.count("*").alias("records"))
    slot = bounded_broadcast(cut_lineage(slot))
    met = bare.join(slot, "context", "left")
    others = F.coalesce("records", F.lit(0)) >= 2
    left = ((F.col("style") == "identifier") & (F.coalesce("values", F.lit(0)) >= 2)) | ((F.col("style") == "blank") & others) | ((F.col("style") == "capitals") & (F.col("label") & others | (F.col("numeric") >= 0.3) & others))
    return holding.select("hash", "segment", "n").unionByName(same).unionByName(met.where(left).select("hash", "segment", "n")).distinct()


def _rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """(id, page, segments, hashes) of every text: a hash of its words, its segments, and a hash of each of them."""
    some = df.where(F.col(column).isNotNull())
    cut = some.select(F.col(key).alias("id"), F.xxhash64(plain(F.col(column))).alias("page"), segments(F.col(column)).alias("segments"))
    return cut.withColumn("hashes", F.transform("segments", lambda s: F.xxhash64(s)))


def page_templates(df: DataFrame, column: str, key: str, rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(words, weights): the templates of pages that are no listing's own text, and what each of their words weighs."""
    pages = cut_lineage(repeated_pages(df, column, key, rows, counted))
    on_pages = rows.join(bounded_broadcast(pages.select("page")), "page", "left_semi").select(F.explode("hashes").alias("hash")).distinct()
    first = counted.join(bounded_broadcast(cut_lineage(on_pages)), "hash", "left_semi").select("words")
    known = cut_lineage(first.unionByName(counted.where(F.col("words").rlike(REASONS)).select("words")).where("words != ''").distinct())
    for _ in range(2):
        known = cut_lineage(known.unionByName(spread_templates(rows, counted, known)).distinct())
    known = cut_lineage(known.unionByName(constant_parts(known)).distinct())
    held = known.select("words", F.explode(F.array_distinct(F.split("words", " "))).alias("gram"))
    inside = counted.join(bounded_broadcast(known), "words", "left_semi")
    wanted = cut_lineage(held.select("gram").distinct())
    share = _uses(inside, wanted, pairs=False).withColumnRenamed("n", "own").join(_uses(counted, wanted, pairs=False), "gram").select("gram", (F.col("own") / F.col("n")).alias("weight"))
    weighed = held.join(bounded_broadcast(cut_lineage(share)), "gram", "left")
    folded = weighed.groupBy("words").agg(F.map_from_entries(F.collect_list(F.struct("gram", F.coalesce("weight", F.lit(0.0))))).alias("weights"))
    return folded.where(F.array_max(F.map_values("weights")) >= OWN)


def flagged_segments(df: DataFrame, column: str, *, key: str = "id") -> DataFrame:
    """(segment, hash, n, template, kind): the segments of ``column`` that are residue, how many rows hold each, and their
    template (what stands between signs as U+0001). kind is placeholder, default, template, error or filler."""
    return _flagged(df, column, key)[0]


def _flagged(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    rows = cut_lineage(_rows(df, column, key))
    counted = rows.select(F.explode("segments").alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted.select("segment", "n", F.xxhash64("segment").alias("hash"), plain(F.col("segment")).alias("words")))
    known = cut_lineage(page_templates(df, column, key, rows, counted))

    read = None
    for block in [*_blocks(known, "words", "weights")] or [[]]:
        step = counted.select("hash", "segment", "words", "n").mapInPandas(_read(block), SPANS)
        read = step if read is None else read.unionByName(step)
    read = cut_lineage(read)
    sure = read.where("kind is not null").select("hash", "segment", "n", "kind")
    found = sure.unionByName(_retained(read, counted).withColumn("kind", F.lit("placeholder"))).groupBy("segment", "hash", "n").agg(F.min("kind").alias("kind"))
    template = F.regexp_replace("segment", r"[{\[<(%#@«&$\\|*~^=]+[^{}\[\]<>()%#@«»]*[}\])>»%#@&;|*~^$]+|_{2,}\w*_*", "\x01")
    return found.select("segment", "hash", "n", F.lower(F.regexp_replace(template, r"[\s.]+$", "")).alias("template"), "kind"), rows


def residue_ids(listings: DataFrame, column: str = "deskripsi", *, key: str = "id") -> DataFrame:
    """(id): the ids of rows whose ``column`` holds template residue anywhere."""
    flagged, rows = _flagged(listings, column, key)
    hashes = bounded_broadcast(cut_lineage(flagged.select("hash").distinct()))
    parts = rows.where(F.col("id").isNotNull()).select(F.col("id").alias(key), F.explode("hashes").alias("hash"))
    return parts.join(hashes, "hash", "left_semi").select(key).distinct()


def without_residue(listings: DataFrame, column: str = "deskripsi", *, key: str = "id") -> DataFrame:
    """``listings`` without the rows that hold residue; rows of null id stay."""
    return listings.join(residue_ids(listings, column, key=key), key, "left_anti")
