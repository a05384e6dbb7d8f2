from __future__ import annotations

import pytest

from tapeloom.functions import tests as S
from tapeloom.operators import joins as J
from tapeloom.operators.bars import Walk, assigned, checkpoints, walk_of
from tapeloom.plugins import Provider, enriched
from tapeloom.sources import trades as T
from tapeloom.sources.paged import Circuit, generated, retried


def test_retries_wait_longer_each_time_and_give_up():
    waits, tries = [], []

    def fail():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        retried(fail, sleep=waits.append)
    assert len(tries) == 5 and waits == [1, 2, 4, 8]


def test_circuit_opens_and_closes_again():
    now = [0.0]
    c = Circuit(clock=lambda: now[0])
    bad = lambda: 1 / 0
    for _ in range(10):
        with pytest.raises(ZeroDivisionError):
            c(bad)
    assert c.state == "open"
    with pytest.raises(RuntimeError):
        c(lambda: 1)
    now[0] = 31
    assert c.state == "half-open" and c(lambda: 1) == 1 and c.state == "closed"


def test_csv_with_and_without_header_and_milliseconds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,p,q,f,l,t,m\n1,0.5,2,1,2,1704067200000,True\n2,-0.5,1,3,3,1704067200000001,false\n")
    rows = T.read_csv(spark, str(tmp_path), "x").orderBy("agg_trade_id").collect()
    assert [(r.price_fp, r.ts_us, r.is_buyer_maker) for r in rows] == [(50_000_000, 1704067200000000, True), (-50_000_000, 1704067200000001, False)]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="price"):
        T.canonical(spark.createDataFrame([(1, 2.0)], "timestamp long, volume double"), "x")


def test_asof_ties_and_misses(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 1), ("a", 5, 3), ("a", 5, 2)], "k string, t long, v long")
    assert {(r.k, r.t, r.v) for r in J.asof(left, right, "t", "t", ["k"], ["v"]).collect()} == {("a", 1, None), ("a", 5, 3), ("b", 5, None)}
    assert {(r.k, r.t, r.v) for r in J.next_match(left, right, "t", "t", ["k"], ["v"]).collect()} == {("a", 1, 1), ("a", 5, None), ("b", 5, None)}


def test_restored_walk_goes_on(spark):
    rows = [("s", i, (100 + (i * 7) % 11) * 10**8, 1, i, i, i * 10, False) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, agg_trade_id long, price_fp long, volume_fp long, first_trade_id long, last_trade_id long, ts_us long, is_buyer_maker boolean")
    whole = [r.bar_id for r in assigned(df, (3000,)).orderBy("agg_trade_id").collect()]
    state = checkpoints(assigned(df.filter("agg_trade_id < 25"), (3000,))).first()
    import numpy as np

    rest, _ = walk_of(state).take(np.array([r[2] for r in rows[25:]]), np.array([r[6] for r in rows[25:]]))
    assert rest.tolist() == whole[25:] and isinstance(walk_of(state), Walk)


def test_failing_provider_is_passed_over(spark):
    df = spark.createDataFrame([(1,)], "x int")
    bad = Provider("bad", "1", ["y"], lambda b: b.select("missing"))
    good = Provider("good", "1", ["z"], lambda b: b.withColumn("z", b.x + 1))
    assert enriched(df, [bad, good]).columns == ["x", "z"]


def test_bonferroni_and_pages():
    assert abs(S.bonferroni(1) - 1.959964) < 1e-5
    assert [t["agg_trade_id"] for t in generated("a", 5, 3)] == [5, 6, 7] and generated("a", 5, 3) == generated("a", 5, 3)
