from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import corpus, near_components, spans_removed, table, windows_removed

from tapeloom.llm import neardup, repeats, substrings, suffixes


def test_deep_shallow_sorts_and_finds_equal_prefixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    starts = np.arange(2700)
    seg = np.zeros(len(starts), np.int64)
    order, same = suffixes.deep_shallow(data, starts, seg, 100, 16)
    text = data.tobytes()
    prefixes = [text[s : s + 100] for s in starts[order]]
    assert prefixes == sorted(prefixes)
    assert [False, *[a == b for a, b in zip(prefixes[:-1], prefixes[1:])]] == same.tolist()
    assert same.sum() >= 301  # the copied stretch, and what agrees by chance at its ends


@pytest.mark.parametrize("hot", [20_000, 1])
def test_bytes_against_brute_force(spark, hot):
    texts = corpus()
    rows = suffixes.removed_bytes(table(spark, texts), hot=hot).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == windows_removed(texts, "byte", 200)
    assert {r.doc_id: r.n_spans for r in rows} == dict(enumerate(spans_removed(texts, 200)))


def test_words_against_brute_force(spark):
    texts = corpus(6)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed_words(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == windows_removed(texts, "word", 35)


def test_paths_glue_pieces_that_always_follow_each_other(spark):
    rows = [(c, f, 0, lo, lo + 9, 1, (3 - f, 0, lo)) for f in (1, 2) for c, lo in ((10, 0), (11, 10), (12, 20), (13, 30))] + [(11, 3, 0, 50, 59, 1, (1, 0, 10))]
    pieces = spark.createDataFrame(rows, "c long, f1 long, f2 long, lo int, hi int, w int, source struct<f1:long,f2:long,lo:int>")
    got = {(r.f1, r.lo, r.hi, r.pieces, r.source.f1, r.source.lo) for r in repeats.paths(pieces).collect()}
    # 11 occurs once more than its neighbours, so the path branches there; 12 and 13 are one.
    assert got == {(1, 0, 9, 1, 2, 0), (1, 10, 19, 1, 2, 10), (1, 20, 39, 2, 2, 20), (2, 0, 9, 1, 1, 0), (2, 10, 19, 1, 1, 10), (2, 20, 39, 2, 1, 20), (3, 50, 59, 1, 1, 10)}


@pytest.mark.parametrize("unit, spec", [("word", repeats.Windows(4, 2, "word")), ("byte", repeats.Windows(12, 4, "byte"))])
def test_spans_are_held_against_their_source(spark, unit, spec):
    """A span whose fingerprints would agree by chance stays: only equal units count, at the coordinates that are named."""
    texts = spark.createDataFrame([(1, 0, "x a b  c\td e f "), (2, 0, "a b c d e g"), (3, 0, "a b")], "f1 long, f2 long, text string")
    span = lambda f, lo, hi, s, slo: (f, 0, lo, hi, (s, 0, slo))
    words = [span(1, 1, 2, 2, 0), span(1, 1, 3, 2, 0), span(2, 0, 1, 1, 0), span(2, 0, 1, 1, 2), span(2, 1, 1, 3, 0), span(2, 2, 2, 2, 2)]
    chars = [span(2, 0, 0, 1, 2), span(1, 2, 2, 2, 0)]
    spans = spark.createDataFrame(words if unit == "word" else chars, "f1 long, f2 long, lo int, hi int, source struct<f1:long,f2:long,lo:int>")
    got = sorted(tuple(r) for r in repeats.verified(texts, spans, spec).collect())
    assert got == ([(1, 0, 1, 2), (2, 0, 2, 2)] if unit == "word" else [])


def test_near_duplicates_against_brute_force(spark):
    texts = corpus(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == near_components(texts)


def test_empty_tables(spark):
    empty = table(spark, ["x"]).filter("false")
    assert suffixes.removed_bytes(empty).count() == 0
    assert substrings.removed_words(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    from tapeloom.llm.common import mixed

    ids = mixed(np.arange(1, 60, dtype=np.uint64)).view(np.int64).tolist()
    edges = spark.createDataFrame(list(zip(ids[:-1], ids[1:])), "a long, b long")
    assert {r.comp for r in neardup.components(edges).collect()} == {min(ids)}


def test_near_duplicates_among_many_alike_and_short_texts(spark):
    """A group whose members are alike, some linked and most not, and short texts: recall against brute force is whole."""
    import random

    rng = random.Random(13)
    base = [f"w{i}" for i in range(120)]
    texts: list = [" ".join(base)]
    for _ in range(90):
        mine = list(base)
        for k in rng.sample(range(120), rng.randint(1, 12)):
            mine[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(mine[: rng.choice([120, 120, 110])]))
    texts += [" ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    want = near_components(texts)
    assert 10 < sum(c == i for i, (_, c) in enumerate(want[:91])) < 85  # both linked and unlinked members
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_of_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (None, long + " z"), (5, long), (5, long), (9, None), (None, None), (None, "alone here"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, (-1 if r.component_id is None else r.component_id), r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, 0, -1, True), (-1, 1, -1, True), (-1, 46, 5, False), (-1, 47, 5, False), (3, 0, 3, True), (5, 46, 5, True), (5, 46, 5, True), (9, 0, 9, True)]
    assert neardup.near_duplicates(docs.withColumn("text", F.lit(None).cast("string"))).filter("n_shingles <> 0").count() == 0


def test_bucket_members_of_sorted_rows_whatever_the_batches():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 40, 200):
        keys = sorted(rng.choice([rng.randrange(5), rng.randrange(-(1 << 62), 1 << 62)]) for _ in range(n))
        rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(n), pa.int64())], ["key", "id"])
        many = Counter(keys)
        for size in (1, 2, 3, 7, 1000):
            got = [tuple(r.values()) for b in neardup._shared(rows.slice(at, size) for at in range(0, n + 1, size)) for r in b.to_pylist()]
            assert got == [(k, i) for i, k in enumerate(keys) if many[k] > 1]


def test_bucket_rows_are_moved_once_and_meet_no_table_of_keys(spark, monkeypatch):
    plans, saved = [], neardup.saved

    def kept(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return saved(df)

    monkeypatch.setattr(neardup, "saved", kept)
    neardup.near_duplicates(table(spark, corpus())).count()
    met = [plan for columns, plan in plans if columns[:2] == ["key", "id"]][0]
    assert met.count("_index(") == met.count("_shared(") == 1 and met.count("hashpartitioning(key") == 1
    assert not re.search(r"Join|keys?=\[key", met)
