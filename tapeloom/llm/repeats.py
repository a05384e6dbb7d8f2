"""Which windows of a corpus occur more than once: the common part of substring removal over bytes and over words.

A text is a sequence of units (bytes, or fingerprints of words); a window is `window` consecutive units of one text. Equal
windows have equal content, so they have the same minimizer (the least fingerprint among their stretches of `gram` units) at
the same place. Consecutive windows with one minimizer form a *block*, about 2 for every window - gram + 1 units, so a
corpus is compared by its blocks, never by all its windows:

1. blocks are counted by minimizer `a`; those whose `a` occurs once are unlike all others and go;
2. the rest are counted by (a, c), where c is the fingerprint of the block's whole content. A block that occurs twice has
   all its windows repeated. If all blocks of `a` are one content, that settles them;
3. only blocks of an `a` with several contents are compared window by window, each content once, however often it occurs.

What fingerprints have found is a candidate with a source, another place that it should equal. Pieces that always follow each
other compact into paths (`paths`), and every path is held against the units at its source (`verified`).

All counts combine before the shuffle and all joins are plain equi-joins, which adaptive execution may split at hot keys.
Equal texts are merged first and carry a count, so a group of copies costs one text. Nothing is dropped or capped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _IS_WS, BYTE_CODES, U64, Rolling, buffers, parts, saved, shuffle_partitions, ship, table_of, word_codes, words

PART_BYTES = 512 << 10
TEXT_KEY = ("f1", "f2")


@dataclass(frozen=True)
class Windows:
    window: int
    gram: int
    unit: str  # "byte" or "word"

    def units(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all units in a row, and the index of each text's first."""
        data, offsets = buffers(texts)
        if self.unit == "byte":
            return BYTE_CODES[data], offsets
        starts, ends, bounds = words(data, offsets)
        return word_codes(data, starts, ends), bounds

    def plain(self, texts) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all units in a row, words of one text joined by one blank; where each unit begins and ends there; and
        the index of each text's first."""
        data, offsets = buffers(texts)
        if self.unit == "byte":
            at = np.arange(len(data))
            return data.tobytes(), at, at + 1, offsets
        starts, ends, bounds = words(data, offsets)
        step = np.zeros(len(data) + 1, np.int64)
        step[starts] += 1
        joined = np.ones(len(ends), np.int64)
        joined[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = 0  # no blank after a text's last word
        np.add.at(step, ends + joined, -1)
        mask = np.cumsum(step[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(mask)])
        return np.where(_IS_WS[data], 32, data).astype(np.uint8)[mask].tobytes(), before[starts], before[ends], bounds


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def blocks(codes: np.ndarray, bounds: np.ndarray, spec: Windows):
    """Text index, first and last window start (in units of the text), how far after the first the minimizer stands, its
    fingerprint, and that of the whole content, of each block."""
    n, w, k = len(codes), spec.window, spec.gram
    if n < w:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64), none.astype(U64)
    roll = Rolling(codes)
    at = np.arange(n - k + 1)
    grams = roll(at, at + k)
    low = U64((1 << n.bit_length()) - 1)
    least = sliding_min((grams & ~low) | at.astype(U64), w - k + 1)  # of equal grams, the leftmost
    ends = np.repeat(bounds[1:], np.diff(bounds))
    valid = np.arange(len(least)) + w <= ends[: len(least)]
    turn = np.empty(len(least) + 1, bool)
    turn[0] = turn[-1] = True
    turn[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(turn[:-1] & valid)
    last = np.flatnonzero(turn[1:] & valid)
    text = np.searchsorted(bounds, first, "right") - 1
    place = (least[first] & low).astype(np.int64)
    return text, first - bounds[text], last - bounds[text], place - first, grams[place], roll(first, last + w)


def texts_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with f1 and f2, a 128-bit fingerprint of the text (null: empty)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select("*", text.alias("_text"), F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(20240229), text).alias("f2"))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """f1, f2, text, copies: each text once."""
    keyed = texts_of(docs, text_col).select("f1", "f2", "_text")
    grouped = keyed.groupBy("f1", "f2").agg(F.first("_text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return table_of(grouped, TEXT_KEY, shuffle_partitions(docs.sparkSession))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks_of(spec: Windows):
    def run(batches):
        for batch in batches:
            for part in parts(batch, most=PART_BYTES):
                text, first, last, anchor, a, c = blocks(*spec.units(part.column(2)), spec)
                f1, f2, copies = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                yield pa.RecordBatch.from_arrays([_signed(a), _signed(c), pa.array(f1[text]), pa.array(f2[text]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(np.minimum(copies[text], 2).astype(np.int32))], ["a", "c", "f1", "f2", "lo", "hi", "anchor", "w"])

    return run


def _open_windows(spec: Windows):
    """Fingerprints of single windows of the blocks in `open`."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, most=PART_BYTES):
                codes, bounds = spec.units(part.column(2))
                lists = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                items = lists.flatten()
                lo, hi, w, full = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi", "w", "full"))
                many = hi - lo + 1
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                owner = np.repeat(owner, many)
                start = bounds[owner] + at
                e = Rolling(codes)(start, start + spec.window)
                f1, f2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([_signed(e), pa.array(f1[owner]), pa.array(f2[owner]), pa.array(at.astype(np.int32)), pa.array(np.repeat(w, many).astype(np.int32)), pa.array(np.repeat(full, many) > 0)], ["e", "f1", "f2", "lo", "w", "full"])

    return run


def repeated_blocks(texts: DataFrame, spec: Windows) -> DataFrame:
    """Blocks whose minimizer occurs again: a, c, f1, f2, lo, hi, anchor, w (copies of the text, 2 at most), and several (whether the
    minimizer has more than one content)."""
    ship(texts.sparkSession)
    rows = saved(texts.select("f1", "f2", "text", "copies").mapInArrow(_blocks_of(spec), "a long, c long, f1 long, f2 long, lo int, hi int, anchor int, w int"))
    # Saved, so that both sides of the join are shuffled for it alone and adaptive execution can split hot minimizers.
    again = saved(rows.groupBy("a").agg(F.sum("w").alias("_n"), (F.min("c") != F.max("c")).alias("several")).filter("_n >= 2").select("a", "several"))
    return saved(rows.join(again, "a"))


def _place():
    return F.struct("f1", "f2", "lo")


def _source(least: str, last: str):
    """Another place of the same content, or the place itself if it is the only one (of a text of several copies)."""
    return F.when(_place() == F.col(least), F.col(last)).otherwise(F.col(least))


def judged(found: DataFrame) -> DataFrame:
    """Blocks with `full` (all windows repeated), `open` (its windows must be compared singly; of equal contents one only),
    `contents` (how many its minimizer has) and `source` (f1, f2, lo of another place of the content)."""
    settled = found.filter("not several").groupBy("a", "c").agg(F.lit(2).cast("long").alias("_n"), F.min(_place()).alias("_rep"), F.max(_place()).alias("_last")).withColumn("contents", F.lit(1).cast("long"))
    counts = found.filter("several").groupBy("a", "c").agg(F.sum("w").alias("_n"), F.min(_place()).alias("_rep"), F.max(_place()).alias("_last"))
    contents = counts.groupBy("a").agg(F.count(F.lit(1)).alias("contents"))
    # Saved, so that adaptive execution can split hot contents in the join.
    each = saved(settled.unionByName(counts.join(contents, "a")))
    several = (F.col("contents") > 1) & (_place() == F.col("_rep"))
    return found.select("a", "c", "f1", "f2", "lo", "hi", "anchor").join(each, ["a", "c"]).select("a", "c", "f1", "f2", "lo", "hi", "anchor", F.least("_n", F.lit(2)).cast("int").alias("w"), (F.col("_n") >= 2).alias("full"), several.alias("open"), "contents", _source("_rep", "_last").alias("source"))


def repeated_windows(texts: DataFrame, open_blocks: DataFrame, spec: Windows) -> DataFrame:
    """Pieces of one window (c, f1, f2, lo, hi = lo, w, source) whose fingerprint occurs twice within `open_blocks` (f1, f2,
    lo, hi, w, full); those of `full` blocks are pieces already and only serve as sources."""
    lists = open_blocks.groupBy("f1", "f2").agg(F.collect_list(F.struct("lo", "hi", "w", "full")).alias("open"))
    singles = saved(texts.select("f1", "f2", "text").join(lists, ["f1", "f2"]).mapInArrow(_open_windows(spec), "e long, f1 long, f2 long, lo int, w int, full boolean"))
    again = saved(singles.groupBy("e").agg(F.sum("w").alias("_n"), F.min(_place()).alias("_rep"), F.max(_place()).alias("_last")).filter("_n >= 2").drop("_n"))
    return singles.filter("not full").join(again, "e").select(F.col("e").alias("c"), "f1", "f2", "lo", F.col("lo").alias("hi"), "w", _source("_rep", "_last").alias("source"))


def paths(pieces: DataFrame) -> DataFrame:
    """Unbranched repeated paths: f1, f2, lo, hi (window starts), source (that of the first piece), path (its fingerprint) and
    pieces (how many). `pieces`: repeated pieces (c, f1, f2, lo, hi, w, source). A piece is glued to the next one of its text if
    both and their pair occur equally often, and so do their sources follow each other; so all places of a path and its source
    run alike to its end."""
    order = Window.partitionBy("f1", "f2").orderBy("lo")
    ahead = F.lead(F.struct("lo", "c", "source")).over(order)
    after = F.struct(F.col("source.f1").alias("f1"), F.col("source.f2").alias("f2"), (F.col("source.lo") + F.col("hi") - F.col("lo") + 1).alias("lo"))
    follows = (F.col("_next.lo") == F.col("hi") + 1) & (F.col("_next.source") == after)
    linked = pieces.select("c", "f1", "f2", "lo", "hi", "w", "source", ahead.alias("_next")).withColumn("_to", F.when(follows, F.col("_next.c"))).drop("_next")
    linked = saved(linked)
    nodes = saved(linked.groupBy("c").agg(F.sum("w").alias("_n")))
    pairs = linked.filter("_to is not null").groupBy("c", "_to").agg(F.sum("w").alias("_m"))
    single = saved(pairs.join(nodes, "c").filter("_m = _n").drop("_n").join(nodes.withColumnRenamed("c", "_to"), "_to").filter("_m = _n").select("c", "_to", F.lit(True).alias("_glued")))
    glued = linked.join(single, ["c", "_to"], "left").withColumn("_glued", F.coalesce("_glued", F.lit(False)))
    heads = F.sum(F.when(F.coalesce(F.lag("_glued").over(order), F.lit(False)), 0).otherwise(1)).over(order)
    first = F.min_by(F.struct("c", "source"), "lo").alias("_first")
    return glued.withColumn("_run", heads).groupBy("f1", "f2", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), first, F.count(F.lit(1)).alias("pieces")).select("f1", "f2", "lo", "hi", "_first.source", F.col("_first.c").alias("path"), "pieces")


def _digests(spec: Windows):
    """A digest of the units that each of the asked ranges of window starts covers."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, most=PART_BYTES):
                data, begin, end, bounds = spec.plain(part.column(2))
                lists = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                items = lists.flatten()
                lo, hi = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
                last = bounds[owner] + hi + spec.window - 1
                inside = last < bounds[owner + 1]  # a source that is too short is none
                a, b = begin[np.where(inside, bounds[owner] + lo, 0)], end[np.where(inside, last, 0)]
                found = [hashlib.blake2b(data[x:y], digest_size=16).digest() if ok else b"" for x, y, ok in zip(a.tolist(), b.tolist(), inside.tolist())]
                f1, f2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(f1[owner]), pa.array(f2[owner]), items.field("lo"), items.field("hi"), pa.array(found, pa.binary())], ["f1", "f2", "lo", "hi", "digest"])

    return run


def verified(texts: DataFrame, spans: DataFrame, spec: Windows) -> DataFrame:
    """f1, f2, lo, hi of those `spans` (f1, f2, lo, hi, source) whose units, all of them, are those at the source."""
    spans = saved(spans.select("f1", "f2", "lo", "hi", F.col("source.f1").alias("s1"), F.col("source.f2").alias("s2"), F.col("source.lo").alias("slo"), (F.col("source.lo") + F.col("hi") - F.col("lo")).alias("shi")))
    own = (F.col("f1") == F.col("s1")) & (F.col("f2") == F.col("s2")) & (F.col("lo") == F.col("slo"))
    other = spans.filter(~own)
    asked = other.select("f1", "f2", "lo", "hi").unionByName(other.select(F.col("s1").alias("f1"), F.col("s2").alias("f2"), F.col("slo").alias("lo"), F.col("shi").alias("hi"))).distinct()
    lists = asked.groupBy("f1", "f2").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))  # spans of one text
    digests = saved(texts.select("f1", "f2", "text").join(lists, ["f1", "f2"]).mapInArrow(_digests(spec), "f1 long, f2 long, lo int, hi int, digest binary"))
    sources = digests.select(F.col("f1").alias("s1"), F.col("f2").alias("s2"), F.col("lo").alias("slo"), F.col("hi").alias("shi"), F.col("digest").alias("_there"))
    held = other.join(digests, ["f1", "f2", "lo", "hi"]).join(sources, ["s1", "s2", "slo", "shi"]).filter((F.col("digest") == F.col("_there")) & (F.length("digest") > 0))
    return held.select("f1", "f2", "lo", "hi").unionByName(spans.filter(own).select("f1", "f2", "lo", "hi"))


def covered(bounds: np.ndarray, lists, window: int) -> np.ndarray:
    """Whether each unit is in a window that starts in one of its text's ranges."""
    owner = np.repeat(np.arange(len(bounds) - 1), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    items = lists.flatten()
    lo, hi = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi"))
    step = np.zeros(bounds[-1] + 1, np.int64)
    np.add.at(step, bounds[owner] + lo, 1)
    np.add.at(step, bounds[owner] + hi + window, -1)
    return np.cumsum(step[:-1]) > 0


def removed(docs: DataFrame, texts: DataFrame, ranges: DataFrame, spec: Windows, digest, columns: str, id_col: str = "doc_id") -> DataFrame:
    """For each row of `docs`: its id and what `digest(part, covered)` returns for its text. `ranges`: repeated window
    starts (f1, f2, lo, hi); a text of several copies is repeated as a whole."""
    lists = ranges.groupBy("f1", "f2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def run(batches):
        for batch in batches:
            for part in parts(batch, most=PART_BYTES):
                f1, f2, texts_, copies, ranges_ = (part.column(i) for i in range(5))
                yield pa.RecordBatch.from_arrays([f1, f2, *digest(texts_, copies.to_numpy(zero_copy_only=False) > 1, ranges_)], ["f1", "f2", *[c.split()[0] for c in columns.split(", ")]])

    done = texts.select("f1", "f2", "text", "copies").join(lists, ["f1", "f2"], "left").mapInArrow(run, f"f1 long, f2 long, {columns}")
    ids = texts_of(docs).select(F.col(f"`{id_col}`").alias("doc_id"), "f1", "f2")
    return ids.join(done, ["f1", "f2"]).drop("f1", "f2")
