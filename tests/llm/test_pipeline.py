"""The pipeline's stages, each on its own input, against plain versions."""

import weakref

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillmesh.llm.common import table, written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    w = brute.WORD.findall((text or "").translate(brute.ASCII_LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, inputs = docs.columns, []
    for name, stage in P.STAGES:
        inputs.append([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
        docs = written(stage(spark, docs, SF))
        if name != "token ids":
            assert docs.columns == columns, name
    raw, good, single, clean, mixed = inputs
    failed = {w[0] for w in brute.op5([x[:2] for x in raw]) if w[-1]}
    assert {x[0] for x in good} <= {x[0] for x in raw} - failed
    sets = {i: shingle_set(t) for i, t, _ in good}
    kept = {x[0] for x in single}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i in set(sets) - kept:  # whatever goes has a near copy
        assert any(jaccard(sets[i], sets[j]) >= 0.8 - 1e-9 for j in sets if j != i)
    survivors = sorted(kept)
    for n, i in enumerate(survivors):  # and of two that are alike one goes
        assert all(jaccard(sets[i], sets[j]) < 0.8 for j in survivors[:n])
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    dirty = {w[0] for w in brute.op2([x[:2] for x in single], items) if w[-1]}
    assert {x[0] for x in clean} == kept - dirty
    assert {x[0] for x in mixed} == {x[0] for x in clean} and len(mixed) >= len(clean)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(docs.collect(), key=lambda r: r["start"])
    plain = {d: (n, c) for d, _, n, c in brute.op1([x[:2] for x in mixed], tokenizer)}
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [plain[r["doc_id"]] for r in got]
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert [r["doc_id"] for r in got] == [x[0] for x in mixed] != sorted(x[0] for x in mixed)  # in the order of the mix


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def odd_rows():
    good = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcde"]
    long = " ".join(f"n{i}" for i in range(150_000))
    return [(1, None), (None, good[0]), (None, None), (2, ""), (3, good[1]), (3, good[1]), (3, good[2]), (4, good[1]), (5, good[3] + " " + ITEM), (6, long), (7, "a " * 500), (8, good[4])]


ITEM = "these ten words stand in an item of the benchmark"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and columns that the stages use themselves."""
    spark.createDataFrame([(1, ITEM), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(i, t, "en", None if i == 8 else "s", "d", "n", 1, 2.0, "h", b"r") for i, t in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest string, node string, rank int, epochs double, __text_hash string, row binary").repartition(3)
    columns, left = docs.columns, []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, f"file://{tmp_path}"))
        if name != "token ids":
            assert docs.columns == columns, name
        left.append(sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str))
    assert left[0] == sorted([None, 3, 3, 3, 4, 5, 6, 8], key=str)  # quality
    assert left[1] == sorted([None, 3, 3, 5, 6, 8], key=str)  # (4 and one 3 are copies)
    assert left[2] == sorted([None, 3, 3, 6, 8], key=str)  # decontamination
    assert set(left[3]) == {None, 3, 6, 8} and left[4] == left[3]


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, f"file://{tmp_path}"))
        assert docs.count() == 0


def test_a_worker_can_drop_its_encoders():
    from quillmesh.llm import bitplanes

    encoder = bitplanes.encoder_for(public_tokenizers.path(P.TOKENIZER))
    gone = weakref.ref(encoder)
    del encoder
    bitplanes.forget_encoders()
    assert gone() is None and not bitplanes._ENCODERS
