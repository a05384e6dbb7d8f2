"""MinHash near-dedup: signatures in a multi-index Hamming join, links confirmed on full shingle sets.

A signature has CHUNKS * CHUNK symbols of 16 bits. By the pigeonhole principle two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS differences; with ERRORS = 1 each chunk is indexed under
its CHUNK deletion variants, so every such pair meets in a bucket. That guarantees 39 of 120 differences; at similarity 0.75
(30 expected) a pair with more still meets with all but 3e-7 probability, as each chunk is a chance of its own.

Buckets aren't expanded into pairs. First each document is compared with the heads of its buckets, one at a time (as many
rows as documents), links are confirmed and components contracted. Members of buckets that still hold several components are
then joined by an exact prefix test (`meeting`): a pair is made only if the full sets can still have the similarity. So a
group of thousands of copies, or of texts that are alike without being linked, costs rows in proportion to it, and no link is
lost that a bucket shows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Rolling, buffers, documents, lower_ascii, mixed, parts, saved, ship, word_codes, words

SHINGLE = 5
PERCENT = 75
CHUNKS, CHUNK, ERRORS = 20, 6, 1
SYMBOLS = CHUNKS * CHUNK
#: Heads that each document is compared with before pairs are.
HEADS = 2
_rng = np.random.default_rng(75)
_FACTORS = (_rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64) | U64(1)).astype(np.uint32)
_SHIFTS = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
_CODES = mixed(np.arange(1, SYMBOLS + 1, dtype=U64))


def shingle_sets(texts, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct fingerprints, ascending, of each text's word shingles, A-Z lower-cased; of fewer words, one for all."""
    data, offsets = buffers(texts)
    data = lower_ascii(data)
    starts, ends, bounds = words(data, offsets)
    codes = word_codes(data, starts, ends)
    roll = Rolling(codes)
    at = np.arange(max(len(codes) - shingle + 1, 0))
    rolled = roll(at, at + shingle)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        elif b > a:
            out.append(roll(np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, U64))
    return out


def signature(found: np.ndarray) -> np.ndarray:
    """The least of each permutation over a set, 16 bits of it."""
    x = (found >> U64(32)).astype(np.uint32)
    least = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[None, at : at + 1024] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=least)
    return least.astype(np.uint16)


def _signed_sets(shingle: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, most=1 << 20):
                sets = shingle_sets(part.column(1), shingle)
                n = np.array([len(x) for x in sets], np.int64)
                one = np.array([int(x.sum(dtype=U64)) if len(x) else 0 for x in sets], U64)
                two = np.array([int(mixed(x).sum(dtype=U64)) if len(x) else 0 for x in sets], U64)
                sig = np.array([signature(x) if len(x) else np.zeros(SYMBOLS, np.uint16) for x in sets]).reshape(len(sets), SYMBOLS)
                same = mixed(one ^ mixed(two + n.astype(U64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(same.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "f", "n_shingles", "id", "signature"])

    return run


def _index(batches):
    """The deletion variants of each chunk."""
    variant = mixed(np.arange(CHUNKS * CHUNK, dtype=U64) + U64(1 << 20)).reshape(CHUNKS, CHUNK)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            codes = mixed(sig.astype(U64) + _CODES).reshape(-1, CHUNKS, CHUNK)
            keys = mixed(codes.sum(axis=2, dtype=U64)[:, :, None] - codes + variant)
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])


def _shared(batches):
    """Of rows (key, id) sorted by key, those whose key another row has too. One row is held back from each batch to the next,
    so that most rows, alone in their bucket, are moved once and never stand in a table of keys."""
    key, ids, again = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        ids = np.concatenate([ids, batch.column(1).to_numpy(zero_copy_only=False)])
        same = key[1:] == key[:-1]
        found = np.append(False, same) | np.append(same, False)
        found[0] |= again
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][found[:-1]]) for x in (key, ids)], ["key", "id"])
        key, ids, again = key[-1:], ids[-1:], found[-1]
    if again:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], ["key", "id"])


def _bags(shingle: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, most=1 << 20):
                sets = shingle_sets(part.column(1), shingle)
                size = np.array([len(x) for x in sets], np.int64)
                at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.ListArray.from_arrays(at, pa.array(np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)))], ["id", "n", "shingles"])

    return run


def _confirm(percent: int):
    """From rows sorted by (a, salt, b), the first of each group being the set of `a` itself (b null): the linked pairs."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            lists = batch.column(3)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            items = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i, other in enumerate(b):
                mine = items[at[i] : at[i + 1]]
                if other is None:
                    key, own = (a[i], salt[i]), mine
                elif key == (a[i], salt[i]):
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        found.append(i)
            found = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(found), batch.column(2).take(found)], ["a", "b"])

    return run


#: Members compared with one set in a task.
SALT = 400


def confirmed(pairs: DataFrame, bags: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have the similarity. `bags`: id, shingles. A set of very many pairs is copied
    to several groups, so that none is large."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("_s"))
    owners = groups.join(bags, groups["a"] == bags["id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_s")).cast("int").alias("salt"), "b").join(bags, F.col("b") == bags["id"]).select("a", "salt", "b", "shingles")
    rows = owners.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return saved(rows.mapInArrow(_confirm(percent), "a long, b long"))


def meeting(bags: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose sets may have the similarity: all that have it, and few others. `bags`: id,
    comp, n, shingles.

    Sets x and y have it only if they share p / (100 + p) * (n_x + n_y) shingles, and what sets of different components share
    are shingles of several components. Put these in one order, the rarest first: if the first that x and y share has r_x
    (r_y) such shingles of x (y) from it on, they share min(r_x, r_y) at most. So r_x bounds the partner's size (`reach`), and
    a pair is made only where each is within the other's reach. A text whose own words rule a link out makes no row.
    """
    exploded = bags.select("id", "comp", "n", F.explode("shingles").alias("s"))
    shared = exploded.groupBy("s").agg(F.count(F.lit(1)).alias("_df"), (F.min("comp") != F.max("comp")).alias("_several")).filter("_several").select("s", "_df")
    ordered = exploded.join(shared, "s").groupBy("id").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("_df", "s"))).alias("_found"))  # of one set
    short = ordered.withColumn("m", F.size("_found")).filter(F.col("m") * 100 >= F.col("n") * percent)
    ahead = F.slice(F.transform("_found", lambda e: e["s"]), F.lit(1), (F.col("m") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    rows = short.select("id", "comp", "n", "m", F.posexplode(ahead).alias("_k", "s"))
    rows = saved(rows.select("s", "id", "comp", "n", F.floor((F.col("m") - F.col("_k")) * (100 + percent) / percent - F.col("n")).alias("reach")))
    # Rows that are within reach of no other component of their shingle go, by the least size and the farthest reach of each
    # component but its own.
    each = rows.groupBy("s", "comp").agg(F.min("n").alias("_n"), F.max("reach").alias("_r"))
    ends = each.groupBy("s").agg(F.min(F.struct("_n", "comp")).alias("_least"), F.max(F.struct("_r", "comp")).alias("_far"), F.count(F.lit(1)).alias("_c")).filter("_c >= 2")
    next_ = each.join(ends, "s").groupBy("s").agg(F.first("_least").alias("_least"), F.first("_far").alias("_far"), F.min(F.when(F.col("comp") != F.col("_least.comp"), F.col("_n"))).alias("_least2"), F.max(F.when(F.col("comp") != F.col("_far.comp"), F.col("_r"))).alias("_far2"))
    least = F.when(F.col("comp") == F.col("_least.comp"), F.col("_least2")).otherwise(F.col("_least._n"))
    far = F.when(F.col("comp") == F.col("_far.comp"), F.col("_far2")).otherwise(F.col("_far._r"))
    fit = saved(rows.join(next_, "s").filter((F.col("reach") >= least) & (F.col("n") <= far)).select("s", "id", "comp", "n", "reach"))
    x, y = fit.alias("x"), fit.alias("y")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    both = (F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") <= F.col("x.reach")) & (small * 100 >= large * percent)
    return x.join(y, both).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, comp (the least id reachable) of each id on an edge (a, b): every round hangs each node on its least neighbour,
    follows twice what hangs on what, and contracts the edges. Ids are fingerprints, so their order is random and few nodes
    of any graph are least among their neighbours: rounds grow with the logarithm of the nodes."""
    label, edges = None, saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hang = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        up = hang.select(F.col("a").alias("to"), F.col("to").alias("_to2"))
        step = saved(hang.join(up, "to").select("a", F.col("_to2").alias("to")))
        now = step.select(F.col("a").alias("comp"), F.col("to").alias("_to"))
        label = step.select(F.col("a").alias("id"), F.col("to").alias("comp")) if label is None else label.join(now, "comp", "left").select("id", F.coalesce("_to", "comp").alias("comp"))
        label = saved(label)
        moved = edges.join(step.withColumnRenamed("to", "_a"), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("_b")), "b")
        edges = saved(moved.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return label


def _judged(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates, with f (a hash of the text) and comp (the component, whatever its ids)."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    signed = saved(narrow.select("doc_id", "text", F.xxhash64("text").alias("f")).mapInArrow(_signed_sets(shingle), "doc_id long, f long, n_shingles long, id long, signature binary"))
    some = signed.filter("n_shingles > 0")
    sets = some.groupBy("id").agg(F.first(F.struct("n_shingles", "signature")).alias("s")).select("id", F.col("s.n_shingles").alias("n"), "s.signature")
    keys = sets.select("id", "signature").mapInArrow(_index, "key long, id long")
    # Members of buckets of two and more; from here on only those count. Of a bucket, the member that meets most others in all
    # its buckets stands for it: the original that copies were made from is nearer to each than they are to each other.
    met = saved(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, id long"))
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    weight = met.join(shared, "key").groupBy("id").agg(F.sum(F.col("_n") - 1).alias("weight"))
    heads = met.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", "id")).alias("_h")).select("key", F.col("_h.id").alias("rep"), F.col("_h.weight").alias("rep_weight"))
    members = saved(met.join(heads, "key"))
    nodes = members.select("id").distinct()
    one = some.groupBy("id").agg(F.min(F.struct("f", "doc_id")).alias("s")).join(nodes, "id").select("id", F.col("s.f").alias("_f"), F.col("s.doc_id").alias("_d"))
    # The set of each node, from the text of one of its documents.
    texts = narrow.join(one, (F.xxhash64("text") == F.col("_f")) & F.col("doc_id").eqNullSafe(F.col("_d"))).groupBy("id").agg(F.first("text").alias("text"))
    bags = saved(texts.mapInArrow(_bags(shingle), "id long, n long, shingles array<long>"))

    tested, links, label = None, None, None

    def linked(x: str, y: str, rows: DataFrame) -> bool:
        """Tests pairs of columns x and y that haven't been tested and follows the links; false if there are none."""
        nonlocal tested, links, label
        pairs = rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if label is not None and pairs.isEmpty():
            return False
        found = confirmed(pairs, bags, percent)
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        label = components(links)
        return True

    def in_component(rows: DataFrame) -> DataFrame:
        return rows.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    # Each document with the weightiest head of its buckets that it isn't connected to yet: a row for each document.
    linked("id", "_h.rep", members.filter("id <> rep").groupBy("id").agg(F.max(F.struct("rep_weight", "rep")).alias("_h")))
    for _ in range(HEADS - 1):
        comps = label.select(F.col("id").alias("rep"), F.col("comp").alias("_c"))
        apart = in_component(members.filter("id <> rep")).join(comps, "rep", "left").filter(F.col("comp") != F.coalesce("_c", "rep")).withColumns({"a": F.least("id", "rep"), "b": F.greatest("id", "rep")})
        if not linked("id", "_h.rep", apart.join(tested, ["a", "b"], "left_anti").groupBy("id").agg(F.max(F.struct("rep_weight", "rep")).alias("_h"))):
            break
    # Last, the members of buckets that hold several components.
    left = in_component(members.select("key", "id"))
    several = left.groupBy("key").agg(F.min("comp").alias("_c"), F.max("comp").alias("_d")).filter("_c <> _d").select("key")
    apart = left.join(several, "key").groupBy("id").agg(F.first("comp").alias("comp"))
    linked("a", "b", meeting(bags.join(apart, "id"), percent))
    named = in_component(signed.select("doc_id", "f", "n_shingles", "id"))
    least = named.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    several = named.filter("n_shingles > 0").join(least, "comp").select("doc_id", "f", "n_shingles", "comp", "component_id")
    alone = named.filter("n_shingles = 0").select("doc_id", "f", "n_shingles", "comp", F.col("doc_id").alias("component_id"))
    return several.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `docs`.

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct word shingles (fewer words
    than `shingle`: the whole as one). component_id is the least doc_id reachable over links. Null and empty texts, and texts
    of white space, have no shingles, no links, and stay. Rows of one doc_id are one document. A null doc_id never is the
    least if any other is there. Columns other than id and text aren't read.
    """
    return _judged(docs, percent, shingle, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def unique(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each component, of its least doc_id; of texts without shingles one for each doc_id (null is a
    value of its own). Its columns, whatever their names, stay."""
    rows = _judged(docs, PERCENT, SHINGLE, "doc_id", "text").filter("kept")
    keys = lambda i, f: (i.isNull().alias("null"), F.coalesce(i.cast("long"), F.lit(0).cast("long")).alias("id"), f.alias("f"))
    one = rows.groupBy("comp", F.when(F.col("n_shingles") == 0, F.struct("doc_id")).alias("_alone")).agg(F.min(F.struct("doc_id", "f")).alias("_one")).select("_one.doc_id", "_one.f")
    chosen = saved(one.select(*keys(F.col("doc_id"), F.col("f"))))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no name of its columns clashes
    keyed = row.select("row", *keys(F.col("row.doc_id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))))
    same = ["null", "id", "f"]
    return keyed.join(chosen, same).dropDuplicates(same).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
