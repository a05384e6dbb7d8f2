"""Quality rules: base counts of each text, and robust multivariate outliers by minimum covariance determinant (MCD).

DataFrame operations only. A text's statistics become a vector of four transformed ratios. For each language and source the
MCD estimate is the mean and covariance of the three quarters of texts whose covariance determinant is least, found by
concentration steps from two starts: each step takes the texts nearest under the last estimate and estimates anew. All of a
step are aggregates that combine before the shuffle; only estimates (one row for each group and start) meet the texts again.

Languages, and the table as a whole, are estimated in the same way from all their texts, and every group's estimate is drawn
towards its language's, as that is towards the table's, by the weight of PRIOR texts: a group of thousands is judged by its
own texts, one of three by its language's in the main, without a size at which this changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, looked_up, saved

MIN_WORDS = 50
MOST_REPEATED = 50  # percent
D = 4
SHARE = 0.75
STEPS = 3
#: Quantiles of chi-square with 4 degrees: 0.5, 0.975 (reweighting), and 1 - 1e-6 (rejection).
CHI_HALF, CHI_REWEIGHT, CHI_REJECT = 3.3567, 11.1433, 33.3768
#: The least standard deviation of each component that counts; natural spread below it is no ground for rejection.
FLOORS = (0.08, 0.6, 0.6, 0.6)
#: How many texts a language's estimate counts for in that of its sources, and the table's in that of its languages.
PRIOR = 100
X = [f"_x{i}" for i in range(D)]

_REPEATED = """
aggregate(
  transform(array(transform(sequence(0, size(_w) - 3), i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS i))), t -> array_sort(t)),
  0L,
  (acc, s) -> acc + aggregate(
    array_sort(transform(filter(s, (e, k) -> (k > 0 AND element_at(s, greatest(k, 1)).h = e.h) OR (k + 1 < size(s) AND element_at(s, least(k + 2, size(s))).h = e.h)), e -> e.i)),
    named_struct('n', 0L, 'upto', 0),
    (a, i) -> named_struct('n', a.n + i + 3 - greatest(i, a.upto), 'upto', i + 3),
    a -> a.n))
"""


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, of whole texts (null: empty)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    split = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split(blank, " "), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    counted = (
        split.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", F.aggregate(F.array(lines), F.lit(0).cast("long"), lambda acc, x: acc + F.size(x) - F.size(F.array_distinct(x))))
        .withColumn("n_repeat_words", F.when(F.size("_w") >= 4, F.expr(_REPEATED)).otherwise(F.lit(0).cast("long")))
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).drop("_t", "_w")


def vector() -> list[Column]:
    """Word length and the counts by word, on logarithmic scales."""
    n = F.greatest("n_words", F.lit(1))
    return [F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n)]


def _levels(rows: DataFrame) -> DataFrame:
    """Adds _pair, _language and _table, the names of the groups that a text is in; null is a value of its own."""
    lang, source = (F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(c))) for c in ("_lang", "_source"))
    return rows.withColumn("_language", F.to_json(F.struct(lang.alias("l")))).withColumn("_pair", F.to_json(F.struct(lang.alias("l"), source.alias("s")))).withColumn("_table", F.lit("{}")).drop("_lang", "_source")


def _distance() -> Column:
    """Squared Mahalanobis distance under the estimate's mean (_m) and inverse Cholesky factor (_c, by rows)."""
    total = None
    for i in range(D):
        part = sum((F.col("_c")[i * (i + 1) // 2 + j] * (F.col(X[j]) - F.col("_m")[j]) for j in range(i + 1)), F.lit(0.0))
        total = part * part if total is None else total + part * part
    return total


_LOWER = [(i, j) for i in range(D) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Texts (_n), mean (_m) and covariance (_v, by rows of its lower half), the floor variances added, for each of `keys`."""
    sums = [F.avg(x).alias(f"_a{i}") for i, x in enumerate(X)] + [F.avg(F.col(X[i]) * F.col(X[j])).alias(f"_b{i}{j}") for i, j in _LOWER]
    cov = [F.col(f"_b{i}{j}") - F.col(f"_a{i}") * F.col(f"_a{j}") for i, j in _LOWER]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums).select(*keys, "_n", F.array(*[F.col(f"_a{i}") for i in range(D)]).alias("_m"), F.array(*[F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else c for c, (i, j) in zip(cov, _LOWER)]).alias("_v"))


def _factored(estimates: DataFrame) -> DataFrame:
    """With the inverse Cholesky factor of the covariance (_c, by rows) and the logarithm of its determinant's root (_det)."""
    kept, out = estimates.columns, estimates
    for k, (i, j) in enumerate(_LOWER):
        done = sum((F.col(f"_l{i}{h}") * F.col(f"_l{j}{h}") for h in range(j)), F.lit(0.0))
        out = out.withColumn(f"_l{i}{j}", F.sqrt(F.col("_v")[k] - done) if i == j else (F.col("_v")[k] - done) / F.col(f"_l{j}{j}"))
    for i in range(D):
        out = out.withColumn(f"_i{i}{i}", 1 / F.col(f"_l{i}{i}"))
        for j in range(i - 1, -1, -1):
            out = out.withColumn(f"_i{i}{j}", -sum((F.col(f"_l{i}{k}") * F.col(f"_i{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"_l{i}{i}"))
    logdet = sum((F.log(f"_l{i}{i}") for i in range(D)), F.lit(0.0))
    return out.select(*kept, F.array(*[F.col(f"_i{i}{j}") for i, j in _LOWER]).alias("_c"), logdet.alias("_det"))


def _drawn(own: str, prior: str) -> list[Column]:
    """Mean and covariance of the estimate `own`, which may be missing, drawn towards `prior` by the weight of PRIOR texts."""
    n = F.coalesce(F.col(f"{own}._n"), F.lit(0))
    mix = lambda name, size: F.array(*[(n * F.coalesce(F.col(f"{own}.{name}")[i], F.lit(0.0)) + PRIOR * F.col(f"{prior}.{name}")[i]) / (n + PRIOR) for i in range(size)])
    return [n.alias("_n"), mix("_m", D).alias("_m"), mix("_v", len(_LOWER)).alias("_v")]


def _median(c, q: float = 0.5) -> Column:
    return F.percentile_approx(c, q, 2000)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of each row.

    kept is false if base_failed, or if the squared robust distance is over the 1 - 1e-6 quantile. Estimates come from the
    texts that pass the base rules: those of one language and source (null is a value of its own), drawn towards the
    language's by the weight of PRIOR texts, and that towards the table's. Null and empty texts have no words and fail.
    Repeated rows count as often as they are. A table in which no text passes keeps none. Other columns aren't read.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), F.col(f"`{source_col}`").cast("string").alias("_source"))
    counted = statistics(narrow, "_text").drop("_text")
    rows = saved(_levels(counted.select("*", *[v.alias(x) for v, x in zip(vector(), X)])))
    good = rows.filter("not base_failed").select(F.explode(F.array("_pair", "_language", "_table")).alias("_g"), *X)
    # Two starts: distance from medians in units of the spread about them, and in units of the floors.
    middle = saved(good.groupBy("_g").agg(*[_median(x).alias(f"_m{i}") for i, x in enumerate(X)]))
    off = [F.abs(F.col(x) - F.col(f"_m{i}")) for i, x in enumerate(X)]
    spread = looked_up(good, middle, ["_g"]).groupBy("_g").agg(*[F.first(f"_m{i}").alias(f"_m{i}") for i in range(D)], *[_median(o).alias(f"_s{i}") for i, o in enumerate(off)])
    # Laid out like estimates: a row for each group, with an array of starts.
    starts = saved(spread.select("_g", *[F.struct(F.array(*[F.col(f"_m{i}") for i in range(D)]).alias("_m"), F.array(*[(1 / (F.greatest(1.4826 * F.col(f"_s{i}"), F.lit(FLOORS[i])) if k == 0 else F.lit(FLOORS[i]))) if i == j else F.lit(0.0) for i, j in _LOWER]).alias("_c")).alias(f"_e{k}") for k in (0, 1)]))

    def apart(both: DataFrame) -> DataFrame:
        """A row for each text, group and start, with the distance."""
        pairs = looked_up(good, both, ["_g"]).select("_g", *X, F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.col(f"_e{k}._m").alias("_m"), F.col(f"_e{k}._c").alias("_c")) for k in (0, 1)])).alias("_e"))
        return pairs.select("_g", F.col("_e.start").alias("start"), *X, F.col("_e._m").alias("_m"), F.col("_e._c").alias("_c")).select("_g", "start", *X, _distance().alias("_d"))

    for step in range(STEPS):
        far = apart(starts)
        near = saved(far.groupBy("_g").agg(*[F.percentile_approx(F.when(F.col("start") == k, F.col("_d")), SHARE, 2000).alias(f"_h{k}") for k in (0, 1)]))
        found = saved(_factored(_moments(looked_up(far, near, ["_g"]).filter(F.col("_d") <= F.when(F.col("start") == 0, F.col("_h0")).otherwise(F.col("_h1"))), ["_g", "start"])))
        if step < STEPS - 1:
            starts = saved(found.groupBy("_g").agg(*[F.max(F.when(F.col("start") == k, F.struct("_m", "_c"))).alias(f"_e{k}") for k in (0, 1)]))
    best = saved(found.groupBy("_g").agg(F.min_by(F.struct("_m", "_v", "_c"), F.struct("_det", "start")).alias("_e")).select("_g", "_e.*"))

    def scale(estimate: DataFrame) -> DataFrame:
        """What makes the median squared distance that of a normal distribution; never under 1, as floors already widen."""
        return looked_up(good, estimate, ["_g"]).groupBy("_g").agg(F.greatest(_median(_distance()) / CHI_HALF, F.lit(1.0)).alias("_k"))

    first = saved(best.join(scale(best), "_g"))
    inner = looked_up(good, first, ["_g"]).filter(_distance() <= CHI_REWEIGHT * F.col("_k")).select("_g", *X)
    again = saved(_factored(_moments(inner, ["_g"])))
    final = saved(again.join(scale(again), "_g").select("_g", F.struct("_n", "_m", F.transform("_v", lambda v: v * F.col("_k")).alias("_v")).alias("_e")))

    def named(name: str, alias: str) -> DataFrame:
        return final.select(F.col("_g").alias(name), F.col("_e").alias(alias))

    groups = saved(rows.select("_pair", "_language", "_table").distinct())
    languages = looked_up(looked_up(groups.select("_language", "_table").distinct(), named("_language", "_own"), ["_language"], "left"), named("_table", "_prior"), ["_table"])
    languages = saved(languages.select("_language", F.struct(*_drawn("_own", "_prior")).alias("_prior")))
    pairs = looked_up(looked_up(groups, named("_pair", "_own"), ["_pair"], "left"), languages, ["_language"])
    pairs = saved(_factored(pairs.select("_pair", *_drawn("_own", "_prior"))).select("_pair", "_m", "_c"))
    judged_ = looked_up(rows, pairs, ["_pair"], "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI_REJECT, F.lit(False))
    return judged_.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))
