"""A confix-stripping stemmer for Indonesian, rule-based, with an optional dictionary of roots.

Rules follow the published description of confix stripping: particles, possessives, derivational suffixes, then up to
three prefixes with the letters they replace. Without a dictionary a form is only cut if four letters and two vowels remain;
with one, cuts stop at a known root and are undone if none is reached.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTICLE = re.compile(r"(lah|kah|tah|pun)$")
_POSSESSIVE = re.compile(r"(ku|mu|nya)$")
_SUFFIX = re.compile(r"(kan|an|i)$")
# Prefixes, what a following vowel may restore, and the suffixes that do not go with them.
_PREFIXES = [
    (re.compile(r"^(di|ke|se)"), ""), (re.compile(r"^(ber|ter|per)"), ""), (re.compile(r"^(bel|pel)(?=ajar)"), ""), (re.compile(r"^(be|te)(?=[^aiueor]+er)"), ""),
    (re.compile(r"^(meng|peng)(?=[aiueo])"), "k"), (re.compile(r"^(meng|peng)"), ""), (re.compile(r"^(meny|peny)(?=[aiueo])"), "s"),
    (re.compile(r"^(mem|pem)(?=[aiueo])"), "p"), (re.compile(r"^(mem|pem)"), ""), (re.compile(r"^(men|pen)(?=[aiueo])"), "t"), (re.compile(r"^(men|pen)"), ""), (re.compile(r"^(me|pe)"), ""),
]
_FORBIDDEN = {("be", "i"), ("di", "an"), ("ke", "i"), ("ke", "kan"), ("me", "an"), ("se", "i"), ("se", "kan")}
LEAST = 4
_TWO_VOWELS = re.compile("[aiueo][^aiueo]*[aiueo]").search


def _enough(w: str) -> bool:
    """Whether a cut may leave this much: four letters and two vowels."""
    return len(w) >= LEAST and _TWO_VOWELS(w) is not None


def stem(word: str, roots: Collection[str] = ()) -> str:
    """The stem of a lower-case word; words of three letters or less stay as they are."""
    if len(word) <= 3 or word in roots:
        return word
    w = word
    for rule in (_PARTICLE, _POSSESSIVE):
        cut = rule.sub("", w)
        if _enough(cut):
            w = cut
    if w in roots:
        return w
    m = _SUFFIX.search(w)
    suffix = m[1] if m and _enough(w[: m.start()]) and (w[:2], m[1]) not in _FORBIDDEN else ""
    for ending in dict.fromkeys((suffix, "")):
        s = w[: len(w) - len(ending)]
        if s in roots:
            return s
        for _ in range(3):
            for rule, restored in _PREFIXES:
                if m := rule.match(s):
                    bare = s[m.end() :]
                    choices = [bare, restored + bare] if roots else [restored + bare if restored and m[1] not in ("meng", "peng") else bare]
                    good = next((c for c in choices if c in roots), None)
                    if good:
                        return good
                    if not roots and _enough(choices[0]):
                        s = choices[0]
                    elif roots and _enough(bare):
                        s = bare
                    else:
                        continue
                    break
            else:
                break
        if not roots:
            return s
    return word


def stem_tokens(tokens: Column, roots: Collection[str] = ()) -> Column:
    """Every token stemmed, in lower case; each distinct word is worked on once in a worker."""
    known = frozenset(roots)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, str] = {}
        for lists in batches:
            out = []
            for words in lists:
                if words is None:
                    out.append(None)
                    continue
                for w in words:
                    if w not in memo:
                        if len(memo) > 500_000:
                            memo.clear()
                        memo[w] = stem(w.lower(), known)
                out.append([memo[w] for w in words])
            yield pd.Series(out)

    return run(tokens)
