import os

import pytest

from lontar.llm import mixing, splitting, tokens

if not os.path.exists(f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"):
    pytest.skip("no vocabularies here", allow_module_level=True)

NAME = "byte_bpe_50k"
TEXTS = [None, "", " ", "kos", "don't  stop\n\n\nnow ", "a" * 3000, " \t\r\n" * 300, "日本語のテキスト。" * 200, "é🙂👩‍👩‍👧 " * 200, "<|endoftext|> x", "kos putri murah, dekat kampus. " * 400, "1234567890" * 300]
SCHEMA = "doc_id bigint, text string, source string, row int, k int, chunk string, ids string"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s", 1, 1, "c", "c") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (100, 20), (37, 5)])
def test_chunks_change_nothing(spark, chunk, overlap):
    t = tokens.tokenizer(NAME)
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs(spark), NAME, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: t.encode(s).tolist() if s else [] for i, s in enumerate(TEXTS)}
    assert all(tokens.decode(got[i]) == (s or "") for i, s in enumerate(TEXTS))
    counts = {r.doc_id: r.n_tokens for r in tokens.encode(docs(spark), NAME, want="count", chunk=chunk, overlap=overlap).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_vocabularies(spark, name):
    t = tokens.tokenizer(name)
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs(spark, TEXTS[:5]), name).collect()}
    assert got == {i: t.encode(s).tolist() if s else [] for i, s in enumerate(TEXTS[:5])}


def test_repeated_rows_and_no_rows(spark):
    assert tokens.encode(docs(spark).unionAll(docs(spark)), NAME, chunk=50, overlap=10).count() == 2 * len(TEXTS)
    assert tokens.encode(docs(spark, []), NAME).count() == 0


@pytest.mark.parametrize("most, shared, chunk", [(40, 8, 1 << 16), (40, 8, 90), (25, 0, 1 << 16)])
def test_pieces(spark, most, shared, chunk):
    t = tokens.tokenizer(NAME)
    rows = splitting.split(docs(spark), most, shared, NAME, chunk=chunk, overlap=20).orderBy("doc_id", "piece_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, s in enumerate(TEXTS) if s and len(t.encode(s)) > most} == {r.doc_id for r in splitting.oversized_ids(docs(spark), most, NAME).collect()}
    for i, pieces in by.items():
        ids, out = t.encode(TEXTS[i]), b""
        for n, p in enumerate(pieces):
            assert p.piece_no == n and p.n_tokens == len(t.encode(p.text)) <= most
            assert n == 0 or p.shared_tokens <= shared + 3
            out += p.text.encode()[sum(len(t.token_bytes[x]) for x in ids[p.start_token : p.start_token + p.shared_tokens]) :]
        assert out.decode() == TEXTS[i]


def test_pieces_end_at_sentences(spark):
    text = "Kamar bersih dan nyaman untuk mahasiswa. " * 60
    pieces = splitting.split(docs(spark, [text]), 100, 10, NAME).orderBy("piece_no").collect()
    assert all(p.text.endswith(".") for p in pieces[:-1])
    with pytest.raises(ValueError):
        splitting.cut_pattern(10, 8)


def test_mixture(spark):
    rows = [(i, "kata " * (1 + i % 37), "big" if i % 3 else "small", 1, 1, "", "") for i in range(3000)] + [(9000, None, "big", 1, 1, "", ""), (9001, "", "small", 1, 1, "", ""), (9002, "x", None, 1, 1, "", "")]
    targets = spark.createDataFrame([("big", 3.0, 1), ("small", 3.0, 3), ("none", 0.1, 2), ("off", None, 1)], "source string, target_weight double, max_repeats int")
    for block in (50_000, 400):
        mix, report = mixing.mixture(spark.createDataFrame(rows, SCHEMA), targets, block=block)
        told = {r.source: r for r in report.collect()}
        assert abs(told["big"].tokens - told["small"].tokens) <= 80 and told["none"].short and told["none"].tokens == 0
        copies = mix.collect()
        assert len({r.doc_id for r in copies}) == len(copies) and all(r.copies <= (1 if r.source == "big" else 3) for r in copies)
        assert sum(r.copies * r.n_tokens for r in copies) == sum(r.tokens for r in told.values())


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_weight double, max_repeats int")
    mix, report = mixing.mixture(docs(spark, []), targets)
    assert mix.count() == 0 and report.first().short
    mix, report = mixing.mixture(docs(spark), targets.limit(0))
    assert mix.count() == 0 and report.count() == 0


def test_flight_keeps_both_totals():
    import numpy as np

    rng = np.random.default_rng(1)
    p, t = rng.random(2000), rng.integers(1, 5000, 2000)
    q = mixing.flight(p, t, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-5 and abs((q * t).sum() - (p * t).sum()) < 1e-2
    assert set(mixing.landing(q, t, rng)) <= {0.0, 1.0}
