"""The queries that SQL can't state, against plain versions over whole tables."""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import WORDS, near_components, table

from tapeloom.llm import outliers, personal, pieces, quality
from tapeloom.llm.common import repository_of_tokenizers

pipeline = pytest.importorskip("corpus_pipeline")
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def quantile(x, q):
    return np.sort(x)[max(math.ceil(q * len(x)) - 1, 0)]


class Estimate:
    """Mean and covariance of vectors, floors added."""

    def __init__(self, mean, cov, n=0):
        self.mean, self.cov, self.n = mean, cov, n

    @classmethod
    def of(cls, x):
        return cls(x.mean(0), np.cov(x.T, bias=True) + np.diag(np.square(outliers.FLOORS)), len(x))

    def distance(self, x):
        off = x - self.mean
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(self.cov), off)

    def scale(self, x):
        return max(quantile(self.distance(x), 0.5) / outliers.CHI_HALF, 1.0)

    def drawn(self, prior):
        mix = lambda a, b: (self.n * a + outliers.PRIOR * b) / (self.n + outliers.PRIOR)
        return Estimate(mix(self.mean, prior.mean), mix(self.cov, prior.cov), self.n)


def covariance_determinant(x):
    """The reweighted minimum covariance determinant of one group, by concentration steps."""
    middle = np.array([quantile(c, 0.5) for c in x.T])
    floors = np.array(outliers.FLOORS)
    spread = np.maximum(1.4826 * np.array([quantile(c, 0.5) for c in np.abs(x - middle).T]), floors)
    found = []
    for width in (spread, floors):
        e = Estimate(middle, np.diag(width**2))
        for _ in range(outliers.STEPS):
            d = e.distance(x)
            e = Estimate.of(x[d <= quantile(d, outliers.SHARE) + 1e-12])
        found.append(e)
    best = min(found, key=lambda e: round(np.linalg.slogdet(e.cov)[1], 9))
    inner = Estimate.of(x[best.distance(x) <= outliers.CHI_REWEIGHT * best.scale(x)])
    return Estimate(inner.mean, inner.cov * inner.scale(x), inner.n)


def test_quality_verdicts_against_a_plain_estimate(spark):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang", "source").join(outliers.op4_quality_rules(spark, MIDDLE), "doc_id").collect()
    per = lambda r: [math.log(max(r.word_chars, 1) / max(r.n_words, 1)), *[math.log1p(100 * k / max(r.n_words, 1)) for k in (r.n_symbols, r.n_dup_lines, r.n_repeat_words)]]
    x = {r.doc_id: np.array(per(r)) for r in rows}
    groups = defaultdict(list)
    for r in rows:
        if not r.base_failed:
            for g in ((), (r.lang,), (r.lang, r.source)):
                groups[g].append(x[r.doc_id])
    final = {g: covariance_determinant(np.array(v)) for g, v in groups.items()}
    nothing = Estimate(np.zeros(4), np.zeros((4, 4)))
    judged = 0
    for r in rows:
        language = final.get((r.lang,), nothing).drawn(final[()])
        distance = final.get((r.lang, r.source), nothing).drawn(language).distance(x[r.doc_id][None])[0]
        assert r.distance == pytest.approx(distance, rel=1e-6, abs=1e-9)
        assert r.kept == (not r.base_failed and distance <= outliers.CHI_REJECT)
        judged += not r.base_failed and not r.kept
    assert judged


def test_classifier_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = quality.op6_quality_classifier(spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert len(held) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def test_classifier_takes_repeated_ids_ties_and_empty_tables(spark):
    texts = ["good plain words %d" % (i // 4) if i % 2 else "### $$$ %d" % (i // 4) for i in range(80)] + ["", None, "x" * 300_000]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    machine = quality.trained(docs.unionAll(docs).repartition(3), labels.unionAll(labels))
    same = quality.trained(docs, labels)
    a, b = ({(r.doc_id, r.score) for r in quality.scored(d, m).collect()} for d, m in ((docs.unionAll(docs), machine), (docs, machine)))
    assert a == b and len(b) == len(texts)
    assert quality.scored(docs, same).count() == len(texts)
    assert quality.scored(docs.filter("false"), machine).count() == quality.accepted(docs.filter("false"), machine).count() == 0


def water(sizes, weights, most=3):
    """Targets by filling sources in turn until none is above its cap."""
    goal, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        level = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if level[s] >= most * sizes[s]}
        if not full:
            return goal | level
        for s in full:
            goal[s] = most * sizes[s]
            left -= goal[s]
        open_ -= full
    return goal


def test_pipeline_against_plain_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    every = docs.orderBy("doc_id").collect()
    accepted = {r.doc_id for r in quality.scored(docs, quality.trained(docs, labels)).collect() if r.score >= 0.5}
    first = [r for r in every if r.doc_id in accepted]
    least = [k for _, k in near_components([r.text for r in first])]
    alone = [r for i, r in enumerate(first) if least[i] == i]
    assert 0 < len(alone) < len(first) < len(every)
    hidden = {r.doc_id: r.text for r in personal.masked(docs.filter(F.col("doc_id").isin([r.doc_id for r in alone]))).collect()}
    assert any(hidden[r.doc_id] != r.text for r in alone)
    size = {r.doc_id: len(WORDS.findall(hidden[r.doc_id] or "")) for r in alone}
    sources = Counter()
    for r in alone:
        sources[r.source] += size[r.doc_id]
    rank = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    target = water(dict(sources), rank)

    out = pipeline.run(spark, SMALL).collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) <= set(size) and max(times.values()) <= 3
    by = {r.doc_id: r.source for r in alone}
    for s in sources:
        mine = [i for i in size if by[i] == s]
        whole = math.floor(target[s] / sources[s] + 1e-9)
        assert {times[i] - whole for i in mine} <= {0, 1}
        assert abs(sum(times[i] * size[i] for i in mine) - target[s]) <= max(size[i] for i in mine)
    library = sentencepiece.SentencePieceProcessor(model_file=repository_of_tokenizers(pieces.MODEL))
    assert all(list(r.ids or []) == library.encode(hidden[r.doc_id] or "") and r.n_pieces == len(r.ids or []) for r in out)
