"""The pipeline, stage by stage, against plain versions."""

import itertools
import sys

import pyarrow as pa
import pytest

from quillon.llm import bpe
from quillon.llm.shared import written
from tests.llm import test_dedup as plain
from tests.llm.test_tokens import check_packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    return out


def test_quality_stages_keep_clean_documents(spark, stages):
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in stages["documents"]}
    from tests.llm.test_quality import brute

    passing = {d for d in clean if (c := brute(texts[d]))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    kept = {r.doc_id for r in stages["quality classifier"]}
    assert len(passing - kept) <= 0.03 * len(passing) + 1


def test_near_duplicates(stages):
    before = {r.doc_id: r.text for r in stages["quality classifier"]}
    want = plain.brute_components(before, 5, 80, 100)
    assert {r.doc_id for r in stages["near duplicates"]} == {root for _, root in want.values()}


def test_repeated_substrings(stages):
    before = {r.doc_id: r.text for r in stages["near duplicates"]}
    flags = plain.covered([t.encode() for t in before.values()], 200)
    want = {d: bytes(b for b, x in zip(t.encode(), f) if not x).decode("utf-8", "ignore") for (d, t), f in zip(before.items(), flags)}
    assert {r.doc_id: r.text for r in stages["repeated substrings"]} == want
    assert all(r.n_chars == len(r.text) for r in stages["repeated substrings"])


def test_packing_takes_all(stages):
    tokenizers = pytest.importorskip("tokenizers")
    from quillon.llm.queries import vocabulary

    library = tokenizers.Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in stages["repeated substrings"]}
    check_packing(stages["packing"], ids)


NAMES = ["kept", "predicted", "kept_text", "score", "n_bytes", "row", "chars", "class", "n", "k1", "quillon_0", "own_0", "anomaly", "held_out"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows, ties, a long text, and columns named like the operators' own."""
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND length(text) BETWEEN 800 AND 3000").orderBy("doc_id").limit(6).collect()]
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (None, good[0]), (3, good[1]), (None, good[2]), (None, good[3]), (4, None), (5, ""), (None, None), (6, " \n\t"), (7, " ".join(good) * 20), (8, good[4])]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[f"{c}{n}" for c in NAMES]) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in NAMES))


def test_filtering_stages_keep_rows_whole(spark, odd):
    rows = {tuple(r) for r in odd.collect()}
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and {tuple(r) for r in out.collect()} <= rows


def test_rules_and_classifier_of_odd_rows(spark, odd):
    for stage in (corpus_pipeline.rules, corpus_pipeline.classifier):
        kept = [r.text for r in stage(spark, odd, SF).collect()]
        assert all(t and t.strip() for t in kept) and len(kept) >= 5
        # equal texts share their fate, and repeated rows are not dropped
        assert all(kept.count(t) in (0, sum(r.text == t for r in odd.collect())) for t in kept)


def test_near_duplicates_of_odd_rows(spark, odd):
    kept = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    named = [(r.doc_id, (r.text or "")[:20]) for r in kept if (r.text or "").strip()]
    assert sorted(d for d, _ in named if d is not None) == [1, 3, 7, 8] and sum(d is None for d, _ in named) == 2
    # texts without words stay, once for each doc_id and text
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept if not (r.text or "").strip()) == [(False, 4), (False, 5), (False, 6), (True, 0)]


def test_repeated_substrings_of_odd_rows(spark, odd):
    rows, out = odd.collect(), corpus_pipeline.repeated_substrings(spark, odd, SF)
    flags = plain.covered([(r.text or "").encode() for r in rows], 200)
    want = [bytes(b for b, x in zip((r.text or "").encode(), f) if not x).decode("utf-8", "ignore") for r, f in zip(rows, flags)]
    assert out.columns == odd.columns
    own = {r.kept: r for r in out.collect()}
    assert len(own) == len(rows)
    for r, text in zip(rows, want):
        got = own[r.kept]
        assert (got.text, got.n_chars) == (text, len(text)) and all(got[c] == r[c] for c in odd.columns if c not in ("text", "n_chars"))


def test_packing_of_odd_rows(spark, odd):
    rows = corpus_pipeline.packing(spark, odd, SF).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8} and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_packing_remembers_little(spark, odd, monkeypatch):
    """What a Python worker remembers of 450,000 different words; with op6's generations it was 113 MB."""

    class Caught(Exception):
        pass

    def catch(self, function, schema):
        raise Caught(function)

    with monkeypatch.context() as m:
        m.setattr(type(odd), "mapInArrow", catch)
        with pytest.raises(Caught) as caught:
            corpus_pipeline.packing(spark, odd, SF)
    monkeypatch.setattr(bpe, "_kept", {})
    words = map("".join, itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=4))
    texts = [" ".join(itertools.islice(words, 5000)) for _ in range(90)]
    batches = (pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(texts))
    assert sum(sum(b["length"].to_pylist()) for b in caught.value.args[0](batches)) > 450_000
    (model,) = bpe._kept.values()
    assert sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for c in (model.words, model.parts) for d in (c, c.old)) < 90e6


def test_stages_of_an_empty_table(spark, odd):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_is_the_stages_in_a_row(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages["packing"])
