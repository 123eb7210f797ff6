"""Splitting oversized texts at natural boundaries, in tokens.

A text becomes one letter a token: the strength of the place after it (``tokens.CLASSES``). Cutting is then a
bounded-quantifier regular expression over that string, evaluated by Spark's own ``regexp_extract_all``: its
alternatives, strongest boundary first, consume from half the limit up to the limit; the last ones take whatever
remains, or up to the limit and end at any character. Cumulative lengths give where pieces end, and looking back from
the previous end gives where they start: overlap_tokens before it, or up to three more where that place lies inside a
character. Pieces are slices of the text's own ids, decoded by joining raw bytes.

A piece that starts or ends inside a word may encode to a few tokens more when read alone: the limit leaves ``SLACK``
tokens for that, and a piece that still exceeds it gives up overlap until it fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from lontar.llm.tokens import CHUNK, FOLDER, OVERLAP, decode, encode, tokenizer
from lontar.runtime import cut_lineage

#: Tokens that a piece may gain when it is encoded alone.
SLACK = 4


def cut_pattern(max_tokens: int, overlap_tokens: int) -> str:
    """The expression that consumes one piece's own tokens: up to max_tokens for the first, else less the overlap."""
    most, rest = max_tokens - SLACK, max_tokens - overlap_tokens - SLACK
    if rest < 4:
        raise ValueError("the limit must leave room for the overlap and for one character")

    def ways(start: str, n: int) -> list[str]:
        least = max(n // 2, 1) - 1
        strong = [f"{start}.{{{least},{n - 1}}}[{c}]" for c in ("P", "PL", "PLS", "PLSC", "PLSCW")]
        return [f"{start}.{{0,{n - 1}}}E", *strong, f"{start}.{{0,{n - 1}}}[^o]"]

    return "|".join([*ways("^", most), *ways("", rest)])


def _spans(long: DataFrame, overlap: int) -> DataFrame:
    """``long`` (row, own, classes and more) with spans, array<struct<start, stop, fresh>>, zero-based: the tokens of each
    piece and where its own, not shared ones begin. Running sums go over one row a piece, without the texts."""
    sizes = long.select("row", F.posexplode(F.transform("own", F.length)).alias("k", "n"))
    stop = F.sum("n").over(W.partitionBy("row").orderBy("k"))
    ends = sizes.select("row", "k", stop.alias("stop"), (stop - F.col("n")).alias("fresh")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "fresh", "stop"))).alias("ends"))

    def back(f: Column) -> Column:
        at = F.greatest(f - overlap, F.lit(0)).cast("int")
        return at - F.length(F.regexp_extract(F.substr("classes", F.greatest(at - 3, F.lit(1)), F.least(at, F.lit(4))), "o*$", 0))

    spans = F.transform("ends", lambda x: F.struct(F.greatest(back(x.fresh), F.lit(0)).cast("int").alias("start"), x.stop.cast("int").alias("stop"), x.fresh.cast("int").alias("fresh")))
    return long.join(ends, "row").withColumn("spans", spans)


def oversized(df: DataFrame, max_tokens: int, name: str, *, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """The rows whose text could exceed the limit: every token of a byte-level vocabulary takes a byte at least."""
    return df.where(F.octet_length(text) > max_tokens) if name.startswith("byte_") else df


def split(df: DataFrame, max_tokens: int, overlap_tokens: int, name: str, *, key: str = "doc_id", text: str = "text", folder: str = FOLDER, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every text longer than ``max_tokens`` as consecutive pieces.

    Columns: key, piece_no (from 0), start_token, n_tokens (of the piece alone), shared_tokens (with the piece before),
    text. Texts within the limit, null and empty ones do not appear. Without the shared tokens, the pieces' bytes
    joined are the text. Needs a byte-level vocabulary.
    """
    coded = encode(oversized(df, max_tokens, name, text=text), name, key=key, text=text, folder=folder, want="classes", chunk=chunk, overlap=overlap)
    long = cut_lineage(coded.where(F.size("ids") > max_tokens).withColumn("row", F.monotonically_increasing_id()))
    long = long.withColumn("own", F.regexp_extract_all("classes", F.lit(cut_pattern(max_tokens, overlap_tokens)), F.lit(0)))
    spans = _spans(long, overlap_tokens).select(key, "ids", F.posexplode("spans").alias("piece_no", "s"))
    parts = spans.select(key, "piece_no", F.slice("ids", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("ids"), F.col("s.start").alias("start_token"), (F.col("s.fresh") - F.col("s.start")).alias("shared_tokens"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(name, folder)
        for pdf in batches:
            rows = []
            for ids, start, shared in zip(pdf["ids"], pdf["start_token"], pdf["shared_tokens"]):
                ids = list(ids)
                while True:
                    s = decode(ids, name, folder)
                    n = len(t.encode(s))
                    if n <= max_tokens or shared <= 0:
                        break
                    drop = min(max(n - max_tokens, 1), shared)
                    while drop < shared and (t.token_bytes[ids[drop]][0] & 0xC0) == 0x80:
                        drop += 1
                    ids, start, shared = ids[drop:], start + drop, shared - drop
                rows.append((start, n, shared, s))
            out = pd.DataFrame(rows, columns=["start_token", "n_tokens", "shared_tokens", "text"])
            yield pd.concat([pdf[[key, "piece_no"]].reset_index(drop=True), out], axis=1)

    return parts.mapInPandas(read, f"{key} {dict(df.dtypes)[key]}, piece_no int, start_token int, n_tokens int, shared_tokens int, text string")


def oversized_ids(df: DataFrame, max_tokens: int, name: str, overlap_tokens: int = 0, *, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """(key): the rows that come out in pieces, of which every one has two at least. Null and empty texts have none."""
    return split(df, max_tokens, overlap_tokens, name, key=key, text=text, folder=folder).where("piece_no = 1").select(key).distinct()
