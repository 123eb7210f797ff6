"""Experiments: parameter grids, ablation of pipeline stages, and learning to rank."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.functions.pipeline import STAGES, PipelineConfig, finishing, rewriting, splitting
from lontar.operators import metrics as M
from lontar.operators import ranking as R
from lontar.operators.search import fuse
from lontar.runtime import cut_lineage, discard

#: Different words that a task holds before it hands over what it has counted.
WORDS = 400_000


def simplex(step: float = 0.1, least_text: float = 0.1) -> list[tuple[float, float, float]]:
    """Weights of text, distance and facilities that sum to one, in steps, text at least ``least_text``."""
    n = round(1 / step)
    return [(a * step, b * step, (n - a - b) * step) for a in range(round(least_text / step), n + 1) for b in range(n - a + 1)]


def alpha_grid(lexical: DataFrame, neural: DataFrame, judged: DataFrame, steps: int = 10) -> DataFrame:
    """(model, map ...) of the hybrid for every alpha: all settings score the same joined candidates in one plan."""
    both = lexical.select("query_id", "doc_id", F.col("score").alias("l")).join(neural.select("query_id", "doc_id", F.col("score").alias("d")), ["query_id", "doc_id"], "left").na.fill(0.0, ["d"])
    scaled = both.withColumn("ls", R.min_max(both, "l")).withColumn("ds", R.min_max(both, "d"))
    grid = scaled.withColumn("alpha", F.explode(F.array(*(F.lit(i / steps) for i in range(steps + 1)))))
    hits = grid.select(F.col("query_id").alias("q"), F.concat_ws("|", "query_id", F.col("alpha").cast("string")).alias("query_id"), "doc_id", F.col("alpha").cast("string").alias("model"), (F.col("alpha") * F.col("ls") + (1 - F.col("alpha")) * F.col("ds")).alias("score"))
    ranked = R.top_ranks(hits, None).select("model", F.col("q").alias("query_id"), "doc_id", "rank")
    return M.summary(M.ranking_metrics(ranked, judged))


def weight_grid(kept: DataFrame, judged: DataFrame, settings: list[tuple[float, float, float]]) -> DataFrame:
    """Mean metrics of the constraint-aware ranking for every setting of its weights, over the same candidates."""
    out = None
    for w in settings:
        name = "/".join(f"{x:.1f}" for x in w)
        one = R.top_ranks(fuse(kept, w).select("query_id", "doc_id", "score"), 10).select(F.lit(name).alias("model"), "query_id", "doc_id", "rank")
        out = one if out is None else out.unionByName(one)
    return M.summary(M.ranking_metrics(out, judged))


def bm25_grid(docs: DataFrame, queries: DataFrame, judged: DataFrame, k1s: list[float], bs: list[float]) -> DataFrame:
    """(model, map ...) of BM25 within the judged pool for every k1 and b; model is "k1/b".

    docs (doc_id, tokens), queries (query_id, tokens). Statistics are those of all documents. The settings are a small
    table joined to the matches of the pool, so that one plan scores all of them; a judged document without a match
    scores 0, one that does not exist is not ranked.
    """
    index, one = R.bm25_index(docs)
    pool = judged.select("query_id", "doc_id").distinct()
    pooled = docs.join(pool.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.size("tokens").alias("dl"), "tokens")
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    told = pooled.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    met = pool.join(asked, "query_id").join(told, ["doc_id", "term"]).join(index.select("term", "idf"), "term")
    met = met.crossJoin(F.broadcast(one)).select("query_id", "doc_id", "tf", (F.col("dl") / F.col("avgdl")).alias("long"), (F.col("times") * F.col("idf")).alias("idf"))  # one row
    settings = F.explode(F.array(*(F.struct(F.lit(f"{k1}/{b}").alias("model"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for k1 in k1s for b in bs)))
    weight = F.col("idf") * F.col("tf") * (F.col("s.k1") + 1) / (F.col("tf") + F.col("s.k1") * (1 - F.col("s.b") + F.col("s.b") * F.col("long")))
    scored = met.withColumn("s", settings).select("s.model", "query_id", "doc_id", weight.alias("w"))
    zeros = pool.join(pooled.select("doc_id"), "doc_id", "left_semi").withColumn("s", settings).select("s.model", "query_id", "doc_id", F.lit(0.0).alias("w"))
    total = scored.unionByName(zeros).groupBy("model", "query_id", "doc_id").agg(F.sum("w").alias("score"))
    # ranked as one query a setting, so that no window holds all settings of a query
    hits = total.select(F.struct("model", "query_id").alias("query_id"), "doc_id", "score")
    ranked = R.top_ranks(hits, None).select("query_id.model", "query_id.query_id", "doc_id", "rank")
    return M.summary(M.ranking_metrics(ranked, judged))


def _words_told(docs: DataFrame, configs: list[PipelineConfig], wanted: list[dict[str, int]]) -> DataFrame:
    """The words of documents (doc_id, text) under every setting, counted in one pass over the texts.

    A row without a term has, in the order of the settings, the number of words of a document (lengths), and of the
    ``wanted`` words in it, numbered over all settings, the numbers (places) and how often each is there (counts). A row
    with a term has, in the order of the settings, in how many documents of a task it is (dfs).

    Settings share what they have in common: a text is rewritten and cut once for all settings that make the same of it,
    and the stages after the cut work on each different word once a task.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: defaultdict[str, int] = defaultdict()  # of every word as it was cut
        number.default_factory = number.__len__
        terms: dict[str, int] = {}
        # every beginning of a list of steps has a register of its own: (step, register that it reads), by beginnings
        program, register, steps, ends = [], {(): 0}, {}, {}
        last_of, end_of = [], []
        for c in configs:
            cut = ("cut", c.tokenize), lambda text, cut=splitting(c): array("i", [number[w] for w in cut(text)])
            before = ()
            for key, step in [*rewriting(c).items(), cut]:
                if (now := (*before, key)) not in register:
                    program.append((steps.setdefault(key, step), register[before]))
                    register[now] = len(program)
                before = now
            last_of.append(register[before])
            end_of.append((c.remove_stopwords, c.stem))
            ends.setdefault(end_of[-1], finishing(c))
        final = {key: np.zeros(0, np.int64) for key in ends}  # the term of every word, -1 for none
        place = [np.zeros(0, np.int64) for _ in configs]
        dfs = np.zeros((len(configs), 0), np.int64)
        types = None

        def row(n: int, **parts: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([parts.get(f.name, pa.nulls(n, f.type)) for f in types], schema=types)

        def told_terms() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(terms), 10_000):
                part = list(islice(terms, at, at + 10_000))
                of = dfs[:, at : at + len(part)].T
                yield row(len(part), term=pa.array(part, pa.string()), dfs=pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * len(configs), pa.array(of.ravel(), pa.int64())))

        for whole in batches:
            types = pa.schema([("doc_id", whole.schema.field("doc_id").type), ("lengths", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("term", pa.string()), ("dfs", pa.list_(pa.int64()))])
            for start in range(0, whole.num_rows, R.ROWS):
                b = whole.slice(start, R.ROWS)
                n = b.num_rows
                streams, lengths = [array("i") for _ in configs], [[] for _ in configs]
                for text in b.column("text").to_pylist():
                    made, values = {}, [text or ""]
                    for step, source in program:
                        key = step, values[source]
                        if (value := made.get(key)) is None:
                            value = made[key] = step(key[1])
                        values.append(value)
                    for last, stream, length in zip(last_of, streams, lengths):
                        stream.extend(values[last])
                        length.append(len(values[last]))
                for key, finish in ends.items():
                    new = [finish(w) for w in islice(number, len(final[key]), None)]
                    final[key] = np.concatenate([final[key], np.array([-1 if t is None else terms.setdefault(t, len(terms)) for t in new], np.int64)])
                dfs = np.pad(dfs, ((0, 0), (0, len(terms) - dfs.shape[1])))
                sizes, found, done = np.zeros((n, len(configs)), np.int32), [], []
                number_type = np.int32 if n * len(terms) < 2**31 else np.int64
                for s, slots in enumerate(wanted):
                    place[s] = np.concatenate([place[s], np.array([slots.get(t, -1) for t in islice(terms, len(place[s]), None)], np.int64)])
                    same = next((x for x in range(s) if end_of[x] == end_of[s] and streams[x] == streams[s] and lengths[x] == lengths[s]), s)
                    if same == s:
                        term = final[end_of[s]].astype(number_type)[np.array(streams[s])]
                        at, kept = np.repeat(np.arange(n, dtype=number_type), lengths[s]), term >= 0
                        at, term = at[kept], term[kept]
                        size = np.bincount(at, minlength=n)
                        pairs, often = np.unique(at * number_type(len(terms)) + term, return_counts=True)
                        at = pairs // number_type(max(len(terms), 1))
                        term = pairs - at * number_type(len(terms))
                        done.append((size, at, term, often, np.bincount(term, minlength=len(terms))))
                    else:
                        done.append(done[same])
                    sizes[:, s], at, term, often, df = done[s]
                    dfs[s] += df
                    slot = place[s][term]
                    hit = slot >= 0
                    found.append((at[hit], slot[hit], often[hit]))
                at, slot, often = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(at, kind="stable")
                ends_at = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
                lists = {name: pa.ListArray.from_arrays(ends_at, pa.array(x[order], pa.int32())) for name, x in (("places", slot), ("counts", often))}
                yield row(n, doc_id=b.column("doc_id"), lengths=pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(configs), pa.array(sizes.ravel(), pa.int32())), **lists)
                if len(number) + len(terms) > WORDS:
                    yield from told_terms()
                    number.clear()
                    terms.clear()
                    final = {key: np.zeros(0, np.int64) for key in ends}
                    place = [np.zeros(0, np.int64) for _ in configs]
                    dfs = np.zeros((len(configs), 0), np.int64)
        if types is not None:
            yield from told_terms()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lengths array<int>, places array<int>, counts array<int>, term string, dfs array<bigint>")


def ablation(docs: DataFrame, queries: DataFrame, judged: DataFrame, base: PipelineConfig | None = None, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(model, map, delta, p_at_5) of BM25 with every stage of the pipeline left out in turn; docs (doc_id, text), queries (query_id, text).

    Left out is each stage that is on in ``base``, by default all but stemming; ``PipelineConfig()`` has stemming too.
    Finding prices changes no word, so there is no row without it. The ranking is that of ``R.bm25`` over the tokens of
    ``process``; all settings are counted in one pass over the texts and scored in another over the counts.
    """
    base = base or PipelineConfig(stem=False)
    settings = {"full": base} | {f"no_{stage}": replace(base, **{stage: False}) for stage in STAGES if getattr(base, stage) and stage != "extract_prices"}
    names, configs = list(settings), list(settings.values())

    # the words of the queries, a query set
    rows = queries.select("query_id", "text").collect()
    asked = []
    for c in configs:
        steps, cut, finish = list(rewriting(c).values()), splitting(c), finishing(c)
        asked.append([[f for w in cut(reduce(lambda text, step: step(text), steps, r.text or "")) if (f := finish(w)) is not None] for r in rows])
    wanted, first = [], [0]
    for lists in asked:
        wanted.append({w: first[-1] + n for n, w in enumerate(sorted({w for words in lists for w in words}))})
        first.append(first[-1] + len(wanted[-1]))

    told = cut_lineage(_words_told(docs, configs, wanted))
    texts, terms = told.where("term is null"), told.where("term is not null")
    total = texts.agg(F.count("*").alias("n"), *(F.avg(F.get("lengths", F.lit(i))).alias(f"long{i}") for i in range(len(configs)))).first()
    each = terms.groupBy("term").agg(*(F.sum(F.get("dfs", F.lit(i))).alias(f"df{i}") for i in range(len(configs))))
    each = cut_lineage(each)
    rarity = lambda df: F.log(F.lit(total["n"]) - df + 0.5) - F.log(df + 0.5)
    mean = each.agg(*(F.avg(F.when(F.col(f"df{i}") > 0, rarity(F.col(f"df{i}")))).alias(f"mean{i}") for i in range(len(configs)))).first()
    words = queries.sparkSession.createDataFrame([(w,) for w in sorted(set().union(*wanted))], "term string")
    known = each.join(F.broadcast(words), "term", "left_semi").select("term", *(F.when(F.col(f"df{i}") > 0, rarity(F.col(f"df{i}"))).alias(f"raw{i}") for i in range(len(configs)))).collect()  # words of a query set

    idf, weights = np.zeros(first[-1]), []
    for i, (slots, lists) in enumerate(zip(wanted, asked)):
        for r in known:
            raw = r[f"raw{i}"]
            if raw is not None and r.term in slots:
                idf[slots[r.term]] = raw if raw >= 0 else 0.25 * mean[f"mean{i}"]
        times = np.zeros((len(slots), len(lists)))
        for q, tokens in enumerate(lists):
            for w in tokens:
                times[slots[w] - first[i], q] += 1
        weights.append(times)
    average = np.array([float(total[f"long{i}"] or 0) or 1.0 for i in range(len(configs))])

    def scorer(block: range) -> Callable:
        parts = []
        for i in range(len(configs)):
            at = range(max(block.start, i * len(rows)), min(block.stop, (i + 1) * len(rows)))
            if at:
                parts.append((i, slice(at.start - block.start, at.stop - block.start), weights[i][:, at.start - i * len(rows) : at.stop - i * len(rows)]))

        def score(batch: pa.RecordBatch) -> np.ndarray:
            flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
            n = batch.num_rows
            at, slot, tf = np.repeat(np.arange(n), np.diff(batch.column("places").offsets.to_numpy())), flat("places"), flat("counts").astype(float)
            norm = k1 * (1 - b + b * flat("lengths").reshape(n, len(configs)) / average)
            setting = np.searchsorted(first, slot, side="right") - 1
            weight = idf[slot] * tf * (k1 + 1) / (tf + norm[at, setting])
            out = np.zeros((n, len(block)))
            for i, columns, part in parts:
                ours = setting == i
                m = np.zeros((n, len(part)))
                m[at[ours], slot[ours] - first[i]] = weight[ours]
                out[:, columns] = m @ part
            return out

        return score

    ids = [f"{name}|{r.query_id}" for name in names for r in rows]
    hits = R.score_blocks(texts.select("doc_id", "lengths", "places", "counts"), ids, scorer, k)
    parts = F.split("query_id", r"\|", 2)
    ranked = hits.select(parts[0].alias("model"), parts[1].alias("query_id"), "doc_id", "rank")
    means = cut_lineage(M.summary(M.ranking_metrics(ranked, judged)).select("model", "map", "p_at_5"))
    discard(told)
    discard(each)
    full = means.where("model = 'full'").select(F.col("map").alias("full"))
    return means.join(F.broadcast(full)).select("model", "map", (F.col("map") - F.col("full")).alias("delta"), "p_at_5")


def learn_to_rank(features: DataFrame, columns: list[str], folds: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank) by logistic regression on ``features`` (query_id, doc_id, relevance, columns).

    Folds are by query, so no query is scored by a model that saw it; classes are weighted to balance, features scaled
    within the training folds.
    """
    # written once: every fold reads it for its share, its scaler, its model and its scores
    data = cut_lineage(features.withColumn("fold", F.pmod(F.xxhash64("query_id"), F.lit(folds))).withColumn("label", (F.col("relevance") >= 1).cast("double")))
    out = None
    for fold in range(folds):
        train, test = data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)
        share = train.agg(F.avg("label")).first()[0]
        if share in (None, 0.0, 1.0):
            continue
        weighted = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
        stages = VectorAssembler(inputCols=columns, outputCol="raw")
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(stages.transform(weighted))
        model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight").fit(scaler.transform(stages.transform(weighted)))
        scored = model.transform(scaler.transform(stages.transform(test))).select("query_id", "doc_id", vector_to_array("probability")[1].alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return R.top_ranks(out, None)
