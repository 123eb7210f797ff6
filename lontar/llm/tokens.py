"""Encoding a corpus with a public tokenizer.

Overlapping chunk encoding: a text longer than ``CHUNK`` characters is cut into chunks that reach ``OVERLAP``
characters into the next. Chunks are pre-tokenised apart, wherever they lie. A chunk that begins inside a word has
wrong boundaries at first; from the first boundary that it shares with its left neighbour (whose view is right there)
both agree for good, since the pre-token pattern looks forward only. Cutting there gives pieces whose encodings are
just parts of the text's encoding, so they are encoded apart too, and their ids joined in order. Where two neighbours
share no boundary in the overlap (a pre-token longer than it), the chunks are joined and read as one.

Tokenizers whose pre-tokens are not given by such a pattern (sentencepiece, and BPE with normalisation) encode whole
texts. Null and empty texts get the empty list. Each row in gives one row out.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator, and never part of this package.
FOLDER = "/opt/tokenizers"
CHUNK = 1 << 16
OVERLAP = 1 << 10

# Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


class Tokenizer:
    """One of the vocabularies, loaded once a process: encode(text) -> int32 array, token_bytes (byte-level ones)."""

    def __init__(self, name: str, folder: str = FOLDER) -> None:
        self.byte_level = name.startswith("byte_")
        if self.byte_level:
            import tiktoken

            with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            core = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.token_bytes = {i: b for b, i in ranks.items()}
            self.lengths = np.zeros(max(self.token_bytes) + 1, dtype=np.int64)
            for i, b in self.token_bytes.items():
                self.lengths[i] = len(b)
            self.encode = lambda text: np.asarray(core.encode_ordinary(text), dtype=np.int32)
        elif name.endswith(".model") or name.startswith("piece_"):
            import sentencepiece

            core = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
            self.encode = lambda text: np.asarray(core.encode(text, num_threads=1), dtype=np.int32)
        else:
            from tokenizers import Tokenizer as Core

            core = Core.from_file(os.path.join(folder, f"{name}.json"))
            core.encode_special_tokens = True
            self.encode = lambda text: np.asarray(core.encode(text, add_special_tokens=False).ids, dtype=np.int32)


def tokenizer(name: str, folder: str = FOLDER) -> Tokenizer:
    if (name, folder) not in _loaded:
        _loaded[name, folder] = Tokenizer(name, folder)
    return _loaded[name, folder]


def boundaries(text: str) -> list[int]:
    """Where the pre-tokens of a text start."""
    return [m.start() for m in regex.finditer(PATTERN, text)]


#: Classes of the place after a token, strongest first: end of text, paragraph, line, sentence, clause, word, any
#: character; and o within a character of several tokens, where no cut is possible.
CLASSES = "EPLSCWxo"


def boundary_classes(ids: np.ndarray, raw: bytes, after: bytes, lengths: np.ndarray) -> str:
    """One letter of ``CLASSES`` for the place after each token. ``raw`` are the bytes of the ids, ``after`` what follows."""
    if not len(ids):
        return ""
    at = np.cumsum(lengths[ids])
    b = np.frombuffer(raw + after[:4] + b"\0\0\0\0", dtype=np.uint8)
    before, one, two, three, four = b[at - 1], b[at], b[at + 1], b[at + 2], b[at + 3]
    space = np.isin(before, list(b" \t\n\r\v\f"))
    wide = np.zeros(len(at), dtype=bool)
    k = at >= 3
    wide[k] = (b[at[k] - 3] == 0xE3) & (b[at[k] - 2] == 0x80) & (before[k] == 0x82)  # the ideographic full stop
    line = ~space & ((one == 10) | (one == 13))
    para = line & ((two == 10) | ((one == 13) & (two == 10) & (three == 13) & (four == 10)))
    blank = ~space & ((one == 32) | (one == 9))
    code = np.full(len(at), ord("x"), dtype=np.uint8)
    code[blank] = ord("W")
    code[blank & np.isin(before, list(b",;:"))] = ord("C")
    code[blank & np.isin(before, list(b".!?")) | wide & (one != 0)] = ord("S")
    code[line], code[para] = ord("L"), ord("P")
    code[(one & 0xC0) == 0x80] = ord("o")
    if not after:
        code[-1] = ord("E")
    return code.tobytes().decode()


def _pieces(df: DataFrame, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """(row, key, k, piece, after): long texts cut where the pre-tokens of neighbouring chunks agree."""
    spark_rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col(text).alias("text"))
    count = F.ceil(F.length("text") / chunk).cast("int")
    cut = spark_rows.select("row", key, F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substr("text", k * chunk + 1, F.lit(chunk + overlap)))).alias("k", "chunk"))
    cut = cut.repartition("row", "k")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for s in b.column("chunk").to_pylist():
                starts = boundaries(s)
                head.append([x for x in starts if x <= overlap])
                sure = starts[:-1] if len(s) == chunk + overlap else [*starts, len(s)]
                # not after white space: a run of it ends differently where the text ends
                tail.append([x - chunk for x in sure if x >= chunk and not s[x - 1].isspace()])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, kind), pa.array(tail, kind)], [*b.schema.names, "head", "tail"])

    shape = f"row bigint, {key} {dict(df.dtypes)[key]}, k int, chunk string, head array<int>, tail array<int>"
    marked = cut.mapInArrow(mark, shape)
    # stitch: a chunk ends where it and the next one agree; a chunk that agrees nowhere is read on with the next
    order = W.partitionBy("row").orderBy("k")
    common = F.array_intersect(F.col("tail"), F.lead("head").over(order))
    met = marked.withColumn("meet", F.when(F.lead("k").over(order).isNotNull(), F.coalesce(F.array_min(common), F.lit(-1))))
    met = met.withColumn("enter", F.lag("meet").over(order)).withColumn("run", F.sum(F.when(F.coalesce(F.lag("meet").over(order), F.lit(0)) >= 0, 1).otherwise(0)).over(order))
    last = F.col("meet").isNull() | (F.col("meet") >= 0)
    own = F.when(last, F.col("chunk")).otherwise(F.substring("chunk", 1, chunk))
    joined = met.groupBy("row", key, "run").agg(F.array_sort(F.collect_list(F.struct("k", own.alias("s"), F.col("meet").alias("meet"), F.col("enter").alias("enter")))).alias("c"))
    whole, enter = F.array_join(F.transform("c", lambda c: c.s), ""), F.coalesce(F.col("c")[0].enter, F.lit(0))
    stop = F.when(F.element_at("c", -1).meet.isNull(), F.length(whole)).otherwise((F.size("c") - 1) * chunk + chunk + F.element_at("c", -1).meet)
    return joined.select("row", key, F.col("run").alias("k"), F.substr(whole, enter + 1, stop - enter).alias("piece"), F.substr(whole, stop + 1, F.lit(4)).alias("after"))


def encode(df: DataFrame, name: str = "byte_bpe_50k", *, key: str = "doc_id", text: str = "text", folder: str = FOLDER, want: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The encoding of every row's text: columns ``key`` and, by ``want``,

    * ``ids``: ids (array<int>), the token ids without special tokens;
    * ``count``: n_tokens (bigint);
    * ``classes``: ids, and classes (string) with one letter of ``CLASSES`` for the place after each token.
    """
    fields = {"ids": "ids array<int>", "count": "n_tokens bigint", "classes": "ids array<int>, classes string"}[want]
    kind = dict(df.dtypes)[key]
    chunked = name.startswith("byte_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            kept = [i for i, n in enumerate(b.schema.names) if n not in ("text", "after")]
            texts = b.column("text").to_pylist()
            ids = [t.encode(s) if s else np.zeros(0, dtype=np.int32) for s in texts]
            columns, names = [b.column(i) for i in kept], [b.schema.names[i] for i in kept]
            if want == "count":
                columns.append(pa.array([len(x) for x in ids], pa.int64()))
                names.append("n_tokens")
            else:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, dtype=np.int32), *ids])))
                names.append("ids")
            if want == "classes":
                columns.append(pa.array([boundary_classes(x, (s or "").encode(), (a or "").encode(), t.lengths) for x, s, a in zip(ids, texts, b.column("after").to_pylist())]))
                names.append("classes")
            yield pa.RecordBatch.from_arrays(columns, names)

    is_long = F.coalesce(F.length(text) > chunk, F.lit(False)) if chunked else F.lit(False)
    short = df.where(~is_long).select(key, F.col(text).alias("text"), F.lit("").alias("after")).mapInArrow(run, f"{key} {kind}, {fields}")
    if not chunked:
        return short
    pieces = _pieces(df.where(is_long), key, text, chunk, overlap).withColumnRenamed("piece", "text")
    coded = pieces.mapInArrow(run, f"row bigint, {key} {kind}, k bigint, {fields}")
    names = [f.split()[0] for f in fields.split(", ")]
    if want == "count":
        long = coded.groupBy("row", key).agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        parts = coded.groupBy("row", key).agg(F.array_sort(F.collect_list(F.struct("k", *names))).alias("p"))
        long = parts.select(key, F.flatten(F.transform("p", lambda p: p.ids)).alias("ids"), *([F.array_join(F.transform("p", lambda p: p.classes), "").alias("classes")] if want == "classes" else []))
    return short.unionByName(long.select(key, *names))


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    """The text of token ids of a byte-level vocabulary: their raw bytes joined; bytes that are no text become U+FFFD."""
    t = tokenizer(name, folder)
    return b"".join(t.token_bytes[i] for i in ids).decode("utf-8", "replace")
