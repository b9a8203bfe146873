"""Quality rules by brute force; the classifier by held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality_rules
from quillon.llm.quality_classifier import NEIGHBOURS, SHARPNESS, _features, fit, quality_classifier
from quillon.llm.quality_rules import IsolationForest


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    flags = [0] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            flags[i : i + 8] = [1] * 8
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(flags))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_match_brute_force(documents, labels, texts):
    rows = quality_rules.quality_rules(documents, labels).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in rows} == {d: brute(t) for d, t in texts.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    clean = [r for r in rows if marks.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if marks.get(r.doc_id) == 0]
    assert sum(not r.kept for r in clean) <= 0.03 * len(clean) + 1 and sum(not r.kept for r in junk) >= 0.6 * len(junk)


def test_line_edges():
    texts = [None, "", "\n", "a\n", "a\na", "\n\n a\n a\n", "a", "\n a", "x" * 10 + "\n" + "x" * 10]
    counts, _ = quality_rules._counted(pa.record_batch({"text": pa.array(texts, pa.string())}))
    assert [tuple(c) for c in counts.tolist()] == [brute(t) for t in texts]


def test_forest_isolates_what_it_never_saw():
    rng = np.random.default_rng(1)
    rows = rng.normal(0, 0.05, (400, 3))
    forest = IsolationForest(rows, np.full(3, -1.0), np.full(3, 1.0))
    assert forest.score(np.array([[0.9, 0.9, -0.9]]))[0] > forest.score(rows).max()


def plain_path(forest, tree, row):
    """Steps down one tree, and the expected rest of the path where it ends early."""
    node = 1
    for _ in range(forest.depth):
        node = 2 * node + (row[forest.feature[tree, node]] > forest.split[tree, node])
    return forest.path[tree, node]


def test_verdicts_match_plain_path_lengths(documents, labels, texts):
    forest, limit = quality_rules.fit(documents, labels)
    rows = quality_rules.quality_rules(documents, labels).collect()
    ids = sorted(texts)
    _, stats = quality_rules._counted(pa.record_batch({"text": pa.array([texts[d] for d in ids], pa.string())}))
    n = min(quality_rules.SUBSAMPLE, len(labels.where("quality = 1").collect()))
    assert forest.depth <= np.ceil(np.log2(n)) + 1e-9
    got = {r.doc_id: (r.kept, r.anomaly) for r in rows}
    for d, row in zip(ids, stats):
        anomaly = 2.0 ** (-np.mean([plain_path(forest, t, row) for t in range(len(forest.path))]) / forest.expected)
        c = brute(texts[d])
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert got[d][1] == pytest.approx(anomaly, rel=1e-12) and got[d][0] == (not failed and got[d][1] <= limit)


def test_fit_counts_every_labelled_document(spark):
    # 6,600 labelled documents; by the hash of their ids the last 400 are of a style of their own
    ids = [r.id for r in spark.range(6600).orderBy(F.xxhash64("id")).collect()]
    rare = set(ids[-400:])
    texts = {d: " ".join(f"{(d * 31 + i * i) % 997:05d}" if d in rare else f"word{'abcdefgh'[(d + i * i) % 8]}{'.' * (i % 5 == 0)}" for i in range(24 + d % 9)) for d in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, int(d % 11 > 0)) for d in ids], "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    clean = {d for d in rare if d % 11}
    assert len(clean & kept) >= 0.9 * len(clean)
    # the same by hand, from all rows at once
    forest, limit = quality_rules.fit(docs, labels)
    _, stats = quality_rules._counted(pa.record_batch({"text": pa.array([texts[d] for d in ids])}))
    half = {r.id: r.h for r in spark.range(6600).select("id", (F.xxhash64("id") % 2 != 0).cast("int").alias("h")).collect()}
    grown, calibrated = (stats[[i for i, d in enumerate(ids) if d % 11 and half[d] == h]] for h in (0, 1))
    plain = IsolationForest(grown, stats.min(0), stats.max(0))
    assert (plain.split == forest.split).all() and plain.path == pytest.approx(forest.path) and plain.expected == forest.expected
    good = sorted(plain.score(calibrated))
    assert limit == pytest.approx(good[int(np.ceil(len(good) * (1 - quality_rules.CLEAN_LOSS)))], abs=1e-8)


def test_paths_are_those_of_trees_that_count_all_rows():
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 0.2, (700, 4)) ** 3
    forest = IsolationForest(rows, rows.min(0), rows.max(0))
    for tree in range(0, len(forest.path), 17):
        for row in rng.uniform(rows.min(0), rows.max(0), (60, 4)):
            node, depth, inside = 1, 0, rows
            while len(inside) > 1 and depth < forest.depth:
                f, split = forest.feature[tree, node], forest.split[tree, node]
                right = row[f] > split
                node, depth, inside = 2 * node + right, depth + 1, inside[(inside[:, f] > split) == right]
            n = len(inside)
            rest = 0 if n <= 1 else 1 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
            assert plain_path(forest, tree, row) == pytest.approx(depth + rest)


def test_lines_of_structured_text_are_told_apart():
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one}\n{two}", f"{one}\n{one}"]
    counts, _ = quality_rules._counted(pa.record_batch({"text": pa.array(texts)}))
    assert [tuple(c) for c in counts.tolist()] == [brute(t) for t in texts] and counts[0][3] == 0


def test_votes_match_a_plain_neighbour_search(documents, labels, texts):
    model = fit(documents, labels)
    got = {r.doc_id: r.score for r in quality_classifier(documents, labels).collect()}
    ids = sorted(texts)[:60]
    batch = pa.record_batch({"text": pa.array([texts[d] for d in ids], pa.string())})
    (terms, stats, words), *more = list(_features(batch))
    assert not more
    vectors = model.vectors.astype(float)
    for d, t, s, w in zip(ids, terms, stats, words):
        x = model.weighted(t[None], s[None])[0] @ model.axes
        x = x / np.sqrt((x * x).sum())
        cosines = [float(sum(a * b for a, b in zip(x, v))) for v in vectors]
        near = sorted(range(len(cosines)), key=lambda i: -cosines[i])[:NEIGHBOURS]
        weight = [max(cosines[i], 1e-6) ** SHARPNESS for i in near]
        vote = sum(a * model.labels[i] for a, i in zip(weight, near)) / sum(weight)
        assert got[d] == pytest.approx(vote if w else 0.0, abs=1e-3)


def test_hostile_rows(hostile, nothing, labels, spark):
    rows = quality_rules.quality_rules(hostile, labels).collect()
    assert len(rows) == 13 and all(r.base_failed for r in rows if r.n_words == 0)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 7)], "doc_id bigint, quality int")
    for table in (none, odd):
        assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(hostile, table).collect())
        scored = quality_classifier(hostile, table).collect()
        assert {r.score for r in scored} == {0.0, 0.5}
    assert quality_rules.quality_rules(nothing, labels).count() == 0 and quality_classifier(nothing, labels).count() == 0


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier(documents, labels).collect()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    pairs = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    good, bad = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    assert good and bad and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
