"""Scalar functions on text, as Column expressions: they stay in the JVM and inside code generation.

Patterns keep to the syntax that Java and RE2 read alike; white space is spelled out, since Java's ``\\s`` is ASCII.
Null behaves as each function's docstring says.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions import vocabulary as V

# Fixed value: the characters that count as white space.
SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WHITE = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_whitespace(text: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(_c(text), F.lit("")), f"{SPACE}+", " "))


def strip(text: Column | str) -> Column:
    """Without white space at the ends; null stays null."""
    return F.trim(_c(text), F.lit(WHITE))


# What is no text in HTML, and the entities that are decoded, in order.
_UNSEEN = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_TAG = "<[a-zA-Z/!?][^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_html(text: Column | str) -> Column:
    """The text nodes joined by blanks, entities decoded; scripts, styles and comments go. Null becomes the empty text."""
    bare = F.regexp_replace(F.coalesce(_c(text), F.lit("")), _UNSEEN, " ")
    bare = F.regexp_replace(bare, _TAG, " ")
    for entity, char in _ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return normalize_whitespace(bare)


def normalize_text(text: str) -> str:
    """``normalize_whitespace`` for Python workers: ``str.split`` cuts at the characters of ``SPACE``."""
    return " ".join(text.split())


def bare_text(text: str) -> str:
    """``strip_html`` for Python workers."""
    if "<" in text:
        text = re.sub(_TAG, " ", re.sub(_UNSEEN, " ", text, flags=re.ASCII))
    if "&" in text:
        for entity, char in _ENTITIES:
            text = text.replace(entity, char)
    return normalize_text(text)


def lowercase(text: Column | str) -> Column:
    """Lower case; null becomes the empty text."""
    return F.lower(F.coalesce(_c(text), F.lit("")))


def _amount(number: Column, factor: int) -> Column:
    return (F.replace(number, F.lit(","), F.lit(".")).cast("double") * factor).cast("bigint")


def extract_prices(text: Column | str) -> Column:
    """All prices in rupiah: millions, then thousands, then plain amounts of ten thousand or more, each once. Null gives none."""
    t = F.coalesce(_c(text), F.lit(""))

    def amounts(unit: str, factor: int) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(rf"(?i)(\d+(?:[.,]\d+)?)\s*(?:{unit})\b"), F.lit(1)), lambda x: _amount(x, factor))

    found = [amounts("jt|juta", 1_000_000), amounts("k|rb|ribu", 1_000)]
    plain = F.transform(F.regexp_extract_all(t, F.lit(r"(?i)rp\s*([\d.,]+)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]", "").try_cast("bigint"))
    return F.array_distinct(F.concat(*found, F.filter(plain, lambda x: x >= 10_000)))


def extract_price(text: Column | str) -> Column:
    """The first price: the first plain amount, else the first in millions, else in thousands; null if there is none."""
    t = _c(text)

    def first(pattern: str) -> Column:
        hit = F.regexp_extract(t, pattern, 1)
        return F.when(hit != "", hit)

    plain = F.regexp_replace(first(r"(?i)rp\s*([\d.,]+)"), "[.,]", "").try_cast("bigint")
    return F.coalesce(plain, _amount(first(r"(?i)(\d+(?:[.,]\d+)?)\s*jt\b"), 1_000_000), _amount(first(r"(?i)(\d+(?:[.,]\d+)?)\s*(?:k|rb|ribu)\b"), 1_000))


#: Rules up to which a chain of expressions is compiled; longer lists run in Arrow batches.
CHAIN = 24


def _rules(words: Mapping[str, str], longest_first: bool) -> list[tuple[str, str, str]]:
    """(word, expression, what takes its place) in the order of use; words that stand for themselves are left out."""
    order = sorted(words, key=len, reverse=True) if longest_first else list(words)
    return [(w, rf"\b{re.escape(w)}\b", words[w]) for w in order if words[w] != w]


def substitution(words: Mapping[str, str], longest_first: bool, any_case: bool = False) -> Callable[[str], str]:
    """What ``substitute`` does to a text, as a function for Python workers. Of short lists, which ``substitute`` leaves to
    Java, letters beyond ASCII also belong to words, as they do there up to version 18.

    A rule is only tried if the first word of what it looks for is in the text, or in what an earlier rule wrote. That
    needs rules that begin and end with letters or digits on both sides; in a list with any other, all are tried.
    """
    rules = _rules(words, longest_first)
    case = str.lower if any_case else str
    whole = all(re.fullmatch(r"(?s)\w(.*\w)?", x, re.ASCII) and "\\" not in x for w, _, new in rules for x in (w, new))

    def expression(word: str) -> str:
        """Whole words ``word``; letters come first where they can, since a search for them is fast."""
        letters = "".join(f"[{c.lower()}{c.upper()}]" if any_case and c.isascii() and c.isalpha() else re.escape(c) for c in word)
        return rf"{letters}(?<!\w{letters})\b" if whole else rf"\b{letters}\b"

    steps = [(re.compile(expression(w), re.ASCII if len(rules) > CHAIN else 0), new, frozenset(tokens(case(new)))) for w, _, new in rules]
    starts: dict[str, list[int]] = {}  # rules by the first word of what they look for
    for n, (w, _, _) in enumerate(rules):
        starts.setdefault(tokens(case(w))[0] if whole else "", []).append(n)
    firsts = frozenset(starts)

    def chain(s: str) -> str:
        hit = firsts.intersection(tokens(case(s))) if whole else firsts
        if not hit:
            return s
        todo, last = [n for w in hit for n in starts[w]], -1
        heapify(todo)
        while todo:
            n = heappop(todo)
            if n == last:
                continue
            last = n
            pattern, new, written = steps[n]
            s, times = pattern.subn(new, s)
            if times and not firsts.isdisjoint(written):
                for later in (x for w in firsts & written for x in starts[w] if x > n):
                    heappush(todo, later)
        return s

    return chain


def substitute(text: Column | str, words: Mapping[str, str], longest_first: bool, any_case: bool = False) -> Column:
    """Whole words replaced one rule after the other, so that later rules see what earlier ones wrote; in ``any_case``,
    upper and lower case (of ASCII letters) are the same.

    Of short lists, one alternation finds the few texts with any of the words; only those go through the rules.
    """
    t = _c(text)
    rules = _rules(words, longest_first)
    if not rules:
        return t
    if len(rules) <= CHAIN:
        case, out = "(?i)" if any_case else "", t
        for _, pattern, new in rules:
            out = F.regexp_replace(out, case + pattern, new)
        return F.when(t.rlike(case + "|".join(p for _, p, _ in rules)), out).otherwise(t)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chain = substitution(words, longest_first, any_case)
        for batch in batches:
            yield batch.map(lambda s: s if s is None else chain(s))

    return run(t)


def apply_jargon(text: Column | str, words: Mapping[str, str] = V.JARGON, any_case: bool = False) -> Column:
    """Short forms and slang written out, longest first; for lower-case text, or in any case."""
    return substitute(text, words, longest_first=True, any_case=any_case)


def correct_spelling(text: Column | str, words: Mapping[str, str] = V.SPELLING, any_case: bool = False) -> Column:
    """Common misspellings corrected, in the order of the list; for lower-case text, or in any case."""
    return substitute(text, words, longest_first=False, any_case=any_case)


def tokenize(text: Column | str) -> Column:
    """Runs of ASCII letters, digits and underscores. Null gives no token."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit("[a-zA-Z0-9_]+"), F.lit(0))


_BLANKS = bytes(n if re.match(r"\w", chr(n), re.ASCII) else 32 for n in range(256))
_RUNS = re.compile("[a-zA-Z0-9_]+").findall


@lru_cache(8)
def tokens(text: str) -> list[str]:
    """``tokenize`` for Python workers, with a short memory; the lists are shared."""
    return text.encode().translate(_BLANKS).decode().split() if text.isascii() else _RUNS(text)


def remove_stopwords(tokens: Column | str, custom: Sequence[str] | None = None, function_words: Sequence[str] = V.FUNCTION_WORDS) -> Column:
    """Tokens that are no stopwords in lower case. ``custom``, if not empty, takes the place of the domain's list."""
    stop = F.array(*(F.lit(w) for w in dict.fromkeys([*function_words, *(custom or V.DOMAIN_STOPWORDS)])))
    return F.filter(_c(tokens), lambda t: ~F.array_contains(stop, F.lower(t)))


def compose_lexical(title: Column | str, place: Column | str, facilities: Column | str, text: Column | str, title_weight: int = 2) -> Column:
    """Fielded text: the title ``title_weight`` times, sub-district, facilities, text; empty fields left out."""
    parts = [F.nullif(strip(x), F.lit("")) for x in (title, place)]
    rest = [F.nullif(F.array_join(_c(facilities), " "), F.lit("")), F.nullif(strip(text), F.lit(""))]
    return F.concat_ws(" . ", *[parts[0]] * title_weight, parts[1], *rest)


def compose_natural(title: Column | str, place: Column | str, facilities: Column | str, text: Column | str) -> Column:
    """The fields as sentences, for encoders."""
    parts = [F.nullif(strip(x), F.lit("")) for x in (title, place)]
    return F.concat_ws(". ", *parts, F.nullif(F.array_join(_c(facilities), " "), F.lit("")), F.nullif(strip(text), F.lit("")))


def detect_tenant(text: Column | str, keywords: Mapping[str, Sequence[str]] = V.TENANT_KEYWORDS) -> Column:
    """The first tenant type one of whose keywords is part of the text; null if none is."""
    low, out = F.lower(_c(text)), F.lit(None).cast("string")
    for kind, words in reversed(keywords.items()):
        out = F.when(low.rlike("|".join(map(re.escape, words))), kind).otherwise(out)
    return out


def normalize_facilities(values: Column | str, aliases: Mapping[str, Sequence[str]] = V.FACILITY_ALIASES) -> Column:
    """Facilities under their canonical name, each once, in order; unknown ones in lower case; one letter or digits only: dropped."""

    def canonical(v: Column) -> Column:
        out = v
        for name, words in reversed(aliases.items()):
            hit = F.lit(False)
            for w in words:
                hit |= F.contains(v, F.lit(w))
            out = F.when(hit, name).otherwise(out)
        return out

    low = F.transform(F.coalesce(_c(values), F.array().cast("array<string>")), lambda v: strip(F.lower(v)))
    good = F.filter(low, lambda v: v.isNotNull() & (F.length(v) >= 2) & ~v.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(good, canonical))


def clean_facilities(values: Column | str) -> Column:
    """Trimmed facilities, each once, case kept; one letter or digits only: dropped."""
    trimmed = F.transform(F.coalesce(_c(values), F.array().cast("array<string>")), strip)
    return F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (F.length(v) >= 2) & ~v.rlike("^[0-9]+$")))


def clean_lines(text: Column | str) -> Column:
    """Each line's blanks collapsed, empty lines dropped."""
    lines = F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n"), normalize_whitespace)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def word_count(text: Column | str) -> Column:
    """Words between white space; null has none."""
    return F.size(F.filter(F.split(F.coalesce(_c(text), F.lit("")), f"{SPACE}+"), lambda x: x != ""))


def truncate(text: Column | str, most: int = 200) -> Column:
    """At most ``most`` characters, the last three of which are dots if something was cut."""
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def strip_district(text: Column | str) -> Column:
    """A sub-district without the word before it; empty becomes null."""
    return F.nullif(strip(F.regexp_replace(strip(text), "(?i)^kecamatan\\s+", "")), F.lit(""))


def id_from_url(url: Column | str) -> Column:
    """The id in a listing's address, else the address itself."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(url), "/room/([A-Za-z0-9_-]+)", 1), F.lit("")), _c(url))


def cache_key(name: str, url: Column | str) -> Column:
    """A source's name and 16 hexadecimal digits of the address's SHA-256."""
    return F.concat(F.lit(f"{name}_"), F.substring(F.sha2(_c(url), 256), 1, 16))


def format_rupiah(amount: Column | str) -> Column:
    """Rp and the amount in groups of three, by dots; null stays null."""
    return F.concat(F.lit("Rp "), F.replace(F.format_number(_c(amount), 0), F.lit(","), F.lit(".")))


def first_forwarded(header: Column | str) -> Column:
    """The first address of a forwarding header."""
    return F.trim(F.element_at(F.split(_c(header), ","), 1))
