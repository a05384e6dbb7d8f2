"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame operations only. Source statistics are small aggregates; nothing is ever collected, and no task sees a whole
source: the fractional repetition of a source is a cut in the order of a seeded hash, found by three rounds of histograms
(12 bits of the hash, 12 more, then the single values of one remaining bucket, a 16-millionth of the source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, looked_up, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
_TOP, _MID = 1 << 48, 1 << 36  # of 60 bits of hash: the width of a first and of a second bucket


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Null is a source of its own, after all others."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _luck(doc_id: Column, seed: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def source_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """One row for each source: _key, source_size, target, whole (repetitions of every document) and cut (documents whose
    hash is at most this are repeated once more). `sized` has _key, _size and _luck."""
    totals = sized.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    ranked = totals.withColumn("_i", F.row_number().over(Window.orderBy("_key")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", max_epochs * F.col("source_size"))
    # Water level: sources fill up to their caps in the order of cap / weight; the level is what is left over the open weights.
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    levels = ranked.select(
        "*",
        F.row_number().over(filling).alias("_n"),
        F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_full"),
        F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
        F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    ).withColumn("_level", (F.col("_all") * share - F.col("_full")) / F.col("_open"))
    level = F.min(F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.struct("_n", "_level"))).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["_level"]
    goal = F.when(level.isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_w") * level))
    plan = levels.select("_key", "source_size", goal.alias("target")).withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs).cast("long"))).otherwise(F.lit(0).cast("long")))
    plan = saved(plan.withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size")))

    def boundary(rows: DataFrame, open_sources: DataFrame) -> DataFrame:
        """Of each source, the bucket in which the cumulated sizes pass the rest, and what stands before it. Sizes are summed
        by bucket before anything meets by source."""
        grouped = looked_up(rows.groupBy("_key", "_b").agg(F.sum("_size").alias("_sum")), open_sources, ["_key"])
        up = grouped.withColumn("_upto", F.col("_before") + F.sum("_sum").over(Window.partitionBy("_key").orderBy("_b")))
        at = up.filter((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_sum") <= F.col("_rest")))
        return at.groupBy("_key", "_rest").agg(F.min("_b").alias("_b"), F.min_by(F.col("_upto") - F.col("_sum"), "_b").alias("_before"))

    top = F.floor(F.col("_luck") / _TOP).cast("long")
    mid = F.floor(F.col("_luck") / _MID).cast("long")
    first = saved(boundary(sized.select("_key", "_size", top.alias("_b")), plan.filter("_rest > 0").select("_key", "_rest", F.lit(0).cast("long").alias("_before"))))
    within = saved(looked_up(sized.select("_key", "_size", "_luck", top.alias("_b")), first.select("_key", F.col("_b").alias("_at")), ["_key"]).filter("_b = _at").drop("_at"))
    second = saved(boundary(within.select("_key", "_size", mid.alias("_b")), first.select("_key", "_rest", "_before")))
    last = within.select("_key", "_size", "_luck", mid.alias("_b")).join(second, ["_key", "_b"]).withColumnsRenamed({"_b": "_b2", "_before": "_before2"})
    single = last.groupBy("_key", "_luck").agg(F.sum("_size").alias("_size"), F.first("_rest").alias("_rest"), F.first("_before2").alias("_before2"), F.first("_b2").alias("_b2"))
    upto = F.col("_before2") + F.sum("_size").over(Window.partitionBy("_key").orderBy("_luck"))
    cut = single.withColumn("_upto", upto).groupBy("_key").agg(F.coalesce(F.max(F.when(F.col("_upto") - F.col("_size") / 2 <= F.col("_rest"), F.col("_luck"))), F.max("_b2") * _MID - 1).alias("cut"))
    return saved(plan.join(cut, "_key", "left")).select("_key", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"))


def planned(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """`docs` with size (words), source_size, target and copies (how often the mix takes the row).

    Sources rank by code point, null last, and carry the repeating weights. Targets share `share` of all words by weight,
    stop at `max_epochs` times the source's size, and what is over goes to the others by weight until none is above. Every
    document of a source is taken floor(target / size) times; those first in the order of a seeded hash once more, until the
    target is met to half a document. Null text has size 0; a source without words has target 0; repeated ids share their
    hash and so their fate; an empty table gives an empty mix. Columns of the input with names of the output are replaced.
    """
    rows = _taken(docs, weights, max_epochs, share, seed, id_col, source_col, text_col)
    return rows.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "copies")], F.col("_size").alias("size"), "source_size", "target", "copies")


def _taken(docs: DataFrame, weights: Sequence[int], max_epochs: int, share: float, seed: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """_row (the whole row, so that no name of its columns clashes), _size, source_size, target and copies."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", n_words(F.col(f"_row.`{text_col}`")).alias("_size"), _key(F.col(f"_row.`{source_col}`")).alias("_key"), _luck(F.col(f"_row.`{id_col}`"), seed).alias("_luck"))
    plan = source_plan(saved(keyed.select("_key", "_size", "_luck")), weights, max_epochs, share)
    copies = F.col("whole") + F.when(F.col("_luck") <= F.col("cut"), 1).otherwise(0)
    return looked_up(keyed, plan, ["_key"]).select("_row", "_size", "source_size", "target", copies.cast("int").alias("copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of the mix as `planned` plans it, each as often as it is taken, with the columns of `docs`, whatever their
    names. Rows of no words and of sources without words are as often in it as their source's documents are."""
    rows = _taken(docs, weights, max_epochs, share, seed, id_col, source_col, text_col).filter("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = saved(docs.select("doc_id", n_words(F.col("text")).alias("_size"), _key(F.col("source")).alias("_key"), _luck(F.col("doc_id"), SEED).alias("_luck")))
    plan = source_plan(sized)
    taken = F.col("_size") * (F.col("whole") + F.when(F.col("_luck") <= F.col("cut"), 1).otherwise(0))
    return looked_up(sized, plan, ["_key"]).select("doc_id", F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


OP1_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 15))::BIGINT AS luck FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER f AS n, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW f AS (ORDER BY cap / w, i)),
v AS (SELECT arg_min(level, n) AS level FROM l WHERE cap > w * level),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(w * (SELECT level FROM v), cap::DOUBLE)) AS target FROM w),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT d.source, luck, sum(size) AS size FROM d GROUP BY ALL),
c AS (SELECT g.source, max(luck) FILTER (upto - g.size / 2.0 <= target - whole * source_size) AS cut
      FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY luck) AS upto FROM g) g JOIN p ON g.source IS NOT DISTINCT FROM p.source
      WHERE target - whole * source_size > 0 GROUP BY g.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN luck <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
