from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_texts import CLASHING

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
        assert docs.columns == names
        if k < 2:
            assert docs.count() < n
            n = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.filter("n_pieces <> size(ids)").count() == 0


def test_deduplication_keeps_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = text(1) + " more"
    rows = [(1, text(1)), (1, text(1)), (1, near), (2, near), (None, text(1)), (None, near)]  # one group
    rows += [(None, text(2)), (None, text(2)), (None, text(3)), (4, text(2) + " more"), (5, text(4)), (5, text(5))]
    rows += [(None, ""), (6, None), (6, " "), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.deduplicated(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted([(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect()])
    assert [i for i, _ in kept] == [-1, -1, 1, 4, 5, 5, 6, 7]
    assert {t for i, t in kept if i == -1} == {"", text(3)} and {t for i, t in kept if i == 5} == {text(4), text(5)}


def odd_rows(spark, tmp_path):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties, and extra columns of clashing names;
    labels beside them."""
    good, bad = (lambda k: " ".join(f"word{k}x{i}" for i in range(40)) + "."), (lambda k: "### $$$ " * 20 + str(k))
    rows = [(i, good(i) if i % 2 else bad(i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(None, good(100), None, None), (None, None, None, None), (70, None, "en", "s1"), (71, "", "en", None), (72, " \n ", None, "s2"), (73, "mail a@b.co " + good(73), "de", "s0")]
    rows += [(74, good(74) * 500, "en", "s0"), (75, good(75), "en", "s1"), (75, good(75), "en", "s1"), (76, good(75), "en", "s2"), (77, "日本語" * 3000, "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (75, None, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages_take_odd_rows_and_clashing_names(spark, tmp_path):
    docs = odd_rows(spark, tmp_path)
    names = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == names, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.filter(" or ".join(f"`{c}` <> 'own {c}'" for c in CLASHING)).count() == 0
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    kept = [i for i, _ in seen["quality classifier"]]
    assert all(i in kept for i in range(1, 60, 2)) and not any(i in kept for i in range(0, 60, 2)) and kept.count(75) == 2
    alone = [i for i, _ in seen["near-dedup"]]
    assert alone.count(75) == 1 and 76 not in alone and all(alone.count(i) == 1 for i in range(1, 60, 2))
    assert dict(seen["personal data"])[73].startswith("mail [email] ") and len(seen["personal data"]) == len(alone)
    last = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == docs.count() and all((r.n_pieces == 0) == (not r.ids) for r in last)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_an_empty_table(spark, tmp_path, k):
    docs = odd_rows(spark, tmp_path)
    assert pipeline.STAGES[k][1](spark, docs.filter("false"), str(tmp_path)).count() == 0
