"""Mixing sources to target weights by cube-method balanced sampling.

Sizes are tokens. From the targets follow, per source, how many times its tokens are wanted (``rate``): every document
is used ``floor(rate)`` times, and once more with the remaining probability. Those extra uses are drawn by the cube
method, balanced within each source on token and document totals:

* flight: three undecided documents at a time move along the null space of the two constraints, (t2-t3, t3-t1, t1-t2)
  for token counts t, by one of the two steps that bring one of them to 0 or 1, chosen so that the expectation stays.
  Triples are disjoint, so all of a block move at once, in arrays. The last few
  hundred move together, along the projection of the largest document on the null space, so that large documents
  are decided first and balanced by many small ones; both totals stay exact. A source is dealt out in
  blocks of bounded size that fly apart and leave two undecided documents each; these form the next level's blocks,
  until a source has one;
* landing: of the last two documents of a source the token constraint alone is kept, then chance decides.

Shares are exact up to that landing, of at most two documents a source.

Total size, if not given: the largest at which the sources that cannot give their share even at max_repeats hold at
most ``SHORT`` of the weight of all sources that have tokens. Those give all they may, and the report shows what they,
and sources without any token, miss.

Targets of null or non-positive weight, and sources without targets, are left out; a repeated target keeps its row
first by (weight, repeats). Documents of null source, without tokens, or null id are never drawn.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lontar.llm.tokens import FOLDER, encode
from lontar.runtime import cut_lineage

SHORT = 0.05
#: Documents of a source that fly together.
BLOCK = 50_000
#: Undecided documents of a block from which on all move together, led by the largest.
LAST = 300


def token_sizes(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, n_tokens), n_tokens of 0 for null and empty texts."""
    packed = documents.select(F.struct("doc_id", "source").alias("key"), "text")
    return encode(packed, name, key="key", folder=folder, want="count").select("key.doc_id", "key.source", "n_tokens")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, documents, rate, short): what each source has to give."""
    have = sizes.where((F.col("n_tokens") > 0) & F.col("source").isNotNull() & F.col("doc_id").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"))
    good = targets.where((F.col("target_weight") > 0) & F.col("source").isNotNull() & ~F.isnan("target_weight"))
    one = good.groupBy("source").agg(F.min(F.struct("target_weight", "max_repeats")).alias("t")).select("source", "t.*")
    everything = W.partitionBy()  # one row a source: a small table
    share = one.withColumn("target_share", F.col("target_weight") / F.sum("target_weight").over(everything))
    joined = share.join(have, "source", "left").na.fill(0, ["available", "documents"]).withColumn("max_repeats", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)))
    reach = joined.withColumn("reach", F.col("available") * F.col("max_repeats") / F.col("target_share"))
    if total_tokens is None:
        able = reach.withColumn("able", F.when(F.col("reach") > 0, F.col("target_share")).otherwise(0.0))
        below = able.withColumn("below", F.sum("able").over(everything.orderBy("reach").rangeBetween(W.unboundedPreceding, W.currentRow)))
        total = F.coalesce(F.min(F.when((F.col("below") > SHORT * F.sum("able").over(everything)) & (F.col("able") > 0), F.col("reach"))).over(everything), F.lit(0.0))
        reach = below.withColumn("total", total)
    else:
        reach = reach.withColumn("total", F.lit(float(total_tokens)))
    wanted = F.when(F.col("available") > 0, F.col("total") * F.col("target_share") / F.col("available")).otherwise(0.0)
    out = reach.withColumn("rate", F.least(wanted, F.col("max_repeats").cast("double")))
    return out.select("source", "target_share", "max_repeats", "available", "documents", "rate", ((F.col("reach") < F.col("total") * (1 - 1e-12)) | (F.col("available") == 0)).alias("short"))


def flight(p: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1, and sum(p) and sum(p * t) are what they were."""
    p, eps = p.astype(float).copy(), 1e-9
    while True:
        open_ = np.nonzero((p > eps) & (p < 1 - eps))[0]
        if len(open_) <= 2:
            p[p <= eps], p[p >= 1 - eps] = 0, 1
            return p
        if len(open_) <= LAST:  # the largest, balanced by all others
            group, size = open_[None, :], t[open_].astype(float)
            lead = np.zeros(len(open_))
            lead[np.argmax(size)] = 1
            bound = np.stack([np.ones(len(open_)), size / max(size.max(), 1)])
            u = lead - bound.T @ np.linalg.lstsq(bound @ bound.T, bound @ lead, rcond=None)[0]
            if np.abs(u).max() < 1e-7:  # the only one of its size: balance the two smallest kinds instead
                u = np.zeros(len(open_))
                order = np.argsort(size, kind="stable")[:3]
                a, b, c = size[order]
                u[order] = (b - c, c - a, a - b) if len({a, b, c}) > 1 else (1, -1, 0)
            u = (u / np.abs(u).max())[None, :]
            u[np.abs(u) < 1e-12] = 0
        else:
            group = open_[: len(open_) // 3 * 3].reshape(-1, 3)
            a, b, c = t[group[:, 0]], t[group[:, 1]], t[group[:, 2]]
            u = np.stack([b - c, c - a, a - b], axis=1).astype(float)
            u[(u == 0).all(axis=1)] = (1.0, -1.0, 0.0)  # three alike: any direction of sum 0 will do
        q = p[group]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, q / -u, np.inf)).min(axis=1)
            down = np.where(u > 0, q / u, np.where(u < 0, (1 - q) / -u, np.inf)).min(axis=1)
        step = np.where(rng.random(len(group)) < down / (up + down), up, -down)
        p[group] = np.clip(q + step[:, None] * u, 0, 1)


def landing(p: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the at most two documents that the flight left: first along the token constraint alone, then by chance."""
    p, eps = p.copy(), 1e-9
    open_ = np.nonzero((p > eps) & (p < 1 - eps))[0]
    if len(open_) == 2:
        u = np.array([t[open_[1]], -t[open_[0]]], dtype=float)
        q = p[open_]
        up, down = min((1 - q[0]) / u[0], q[1] / -u[1]), min(q[0] / u[0], (1 - q[1]) / -u[1])
        p[open_] = np.clip(q + (up if rng.random() < down / (up + down) else -down) * u, 0, 1)
        open_ = open_[(p[open_] > eps) & (p[open_] < 1 - eps)]
    for k in open_:
        p[k] = float(rng.random() < p[k])
    return np.rint(p)


def mixture(documents: DataFrame, targets: DataFrame, *, name: str = "byte_bpe_50k", folder: str = FOLDER, total_tokens: int | None = None, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, copies) and its report.

    ``documents`` has doc_id, text, source; ``targets`` source, target_weight, max_repeats. The report has one row a
    target: source, target_share, actual_share, tokens, uses, documents_used, most_copies, short.
    """
    sizes = cut_lineage(token_sizes(documents, name, folder))
    wants = cut_lineage(plan(sizes, targets, total_tokens))
    # one row a target, each named by hand: a table of bounded size
    told = F.broadcast(wants.select("source", "rate", F.ceil(F.col("documents") / block).cast("int").alias("blocks")))
    drawn = sizes.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull()).join(told.where("rate > 0"), "source")
    whole = F.floor(F.col("rate") + 1e-9)
    rows = drawn.select("doc_id", "source", "n_tokens", whole.cast("int").alias("base"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    shape = "doc_id bigint, source string, n_tokens bigint, base int, p double, block int"

    def fly(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
            entropy = int.from_bytes(str(pdf["source"][0]).encode()[:64].ljust(1, b"\0"), "little")
            rng = np.random.default_rng([seed, entropy, int(pdf["block"][0]), int(last)])
            p, t = pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy()
            p = flight(p, t, rng)
            return pdf.assign(p=landing(p, t, rng) if last else p)

        return run

    most = wants.agg(F.max(F.ceil(F.col("documents") / block))).first()[0] or 0
    decided = []
    while most > 1:
        flown = cut_lineage(rows.groupBy("source", "block").applyInPandas(fly(False), shape))
        decided.append(flown.where("p in (0, 1)"))
        most = -(-2 * most // block)
        rows = flown.where("p not in (0, 1)").withColumn("block", F.pmod(F.col("block"), F.lit(int(most))))
    decided.append(rows.withColumn("block", F.lit(0)).groupBy("source", "block").applyInPandas(fly(True), shape))
    chosen = decided[0]
    for more in decided[1:]:
        chosen = chosen.unionByName(more)
    mix = cut_lineage(chosen.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).where("copies > 0"))
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("uses"), F.count("*").alias("documents_used"), F.max("copies").alias("most_copies"))
    report = wants.join(used, "source", "left").na.fill(0, ["tokens", "uses", "documents_used", "most_copies"])
    total = F.sum("tokens").over(W.partitionBy())
    report = report.select("source", "target_share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)).alias("actual_share"), "tokens", "uses", "documents_used", "most_copies", "short")
    return mix, report
