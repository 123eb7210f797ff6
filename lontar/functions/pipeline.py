"""The configurable nine-stage text pipeline, as one struct of columns; stages not asked for leave no trace in the plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lontar.functions import text as X
from lontar.functions import vocabulary as V
from lontar.functions.stemming import stem, stem_tokens


@dataclass(frozen=True)
class PipelineConfig:
    """Which stages run, and the words they use. A non-empty ``custom_stopwords`` takes the place of the domain's list."""

    strip_html: bool = True
    normalize_whitespace: bool = True
    extract_prices: bool = True
    lowercase: bool = True
    apply_jargon_dict: bool = True
    correct_spelling: bool = True
    tokenize: bool = True
    remove_stopwords: bool = True
    stem: bool = True
    custom_stopwords: Sequence[str] = ()
    jargon: Mapping[str, str] = field(default_factory=lambda: V.JARGON)
    roots: Sequence[str] = ()


STAGES = ("strip_html", "normalize_whitespace", "extract_prices", "lowercase", "apply_jargon_dict", "correct_spelling", "tokenize", "remove_stopwords", "stem")


def process(text: Column | str, config: PipelineConfig | None = None, trace: bool = False) -> Column:
    """struct(raw, processed, tokens, extracted_prices, stages_applied[, trace]) of a text.

    ``trace`` adds an array of struct(stage, output), outputs as JSON. Null and empty texts give empty results without
    stages.
    """
    c = config or PipelineConfig()
    raw = F.col(text) if isinstance(text, str) else text
    now, prices, snaps = F.coalesce(raw, F.lit("")), F.array().cast("array<bigint>"), []

    def snap(stage: str, output: Column, array: bool = False) -> None:
        shown = F.to_json(output) if array else F.to_json(F.array(output))
        snaps.append(F.struct(F.lit(stage).alias("stage"), (shown if array else F.regexp_extract(shown, r"(?s)^\[(.*)\]$", 1)).alias("output")))

    if c.strip_html:
        now = X.strip_html(now)
        snap("strip_html", now)
    if c.normalize_whitespace:
        now = X.normalize_whitespace(now)
        snap("normalize_whitespace", now)
    if c.extract_prices:
        prices = X.extract_prices(now)
        snap("extract_prices", prices, True)
    for stage, step in (("lowercase", X.lowercase), ("apply_jargon_dict", lambda t: X.apply_jargon(t, c.jargon, not c.lowercase)), ("correct_spelling", lambda t: X.correct_spelling(t, any_case=not c.lowercase))):
        if getattr(c, stage):
            now = step(now)
            snap(stage, now)
    tokens = X.tokenize(now) if c.tokenize else F.filter(F.split(now, f"{X.SPACE}+"), lambda x: x != "")
    if c.tokenize:
        snap("tokenize", tokens, True)
    if c.remove_stopwords:
        tokens = X.remove_stopwords(tokens, list(c.custom_stopwords))
        snap("remove_stopwords", tokens, True)
    if c.stem:
        tokens = stem_tokens(tokens, c.roots)
        snap("stem", tokens, True)
    some = F.coalesce(raw, F.lit("")) != ""
    none = F.array().cast("array<string>")
    applied = F.array(*(F.lit(s) for s in STAGES if getattr(c, s)))
    fields = [raw.alias("raw"), F.when(some, F.array_join(tokens, " ")).otherwise("").alias("processed"), F.when(some, tokens).otherwise(none).alias("tokens"), F.when(some, prices).otherwise(F.array().cast("array<bigint>")).alias("extracted_prices"), F.when(some, applied).otherwise(none).alias("stages_applied")]
    if trace:
        fields.append(F.when(some, F.array(*snaps)).alias("trace"))
    return F.struct(*fields)


def rewriting(config: PipelineConfig) -> dict[tuple, Callable[[str], str]]:
    """The stages up to ``tokenize`` that change the text, in order, for Python workers. Equal keys do the same."""
    any_case, out = not config.lowercase, {}
    for stage, step in (("strip_html", X.bare_text), ("normalize_whitespace", X.normalize_text), ("lowercase", str.lower)):
        if getattr(config, stage):
            out[(stage,)] = step
    if config.apply_jargon_dict:
        out["jargon", any_case, tuple(config.jargon.items())] = X.substitution(config.jargon, True, any_case)
    if config.correct_spelling:
        out["spelling", any_case] = X.substitution(V.SPELLING, False, any_case)
    return out


def splitting(config: PipelineConfig) -> Callable[[str], list[str]]:
    """The tokens of a rewritten text, for Python workers. ``str.split`` cuts at the characters of ``X.SPACE``."""
    return X.tokens if config.tokenize else str.split


@lru_cache
def _stemmer(roots: frozenset[str]) -> Callable[[str], str]:
    """``stem`` with a memory, one a process and list of roots."""
    return lru_cache(200_000)(lambda word: stem(word, roots))


def finishing(config: PipelineConfig) -> Callable[[str], str | None]:
    """What the stages after ``tokenize`` make of a token, None if they drop it, for Python workers."""
    stop = {*V.FUNCTION_WORDS, *(config.custom_stopwords or V.DOMAIN_STOPWORDS)} if config.remove_stopwords else set()
    stemmed = _stemmer(frozenset(config.roots))

    def finish(token: str) -> str | None:
        low = token.lower()
        return None if low in stop else stemmed(low) if config.stem else token

    return finish
