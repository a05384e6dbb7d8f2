"""Substring dedup over bytes: suffix sorting of the stretches that may repeat, by deep-shallow sorting.

`repeats` finds the blocks of window starts whose content may occur again. Where the blocks of a minimizer differ, their
stretches of text are gathered, each content once, and their suffixes sorted: multikey quicksort on 8 bytes a time down to a
shallow depth, then blind tries for the groups that are still together. Suffixes that agree on a whole window are neighbours
then. The suffixes of a minimizer with very many contents are dealt over several tasks, equal windows to the same one, and
sorted there. Blocks that occur again as a whole, the only content of their minimizer, need no sorting; their bytes are
compared with those of another place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODES, U64, Rolling, buffers, documents, parts, saved
from .repeats import PART_BYTES, Windows, covered, distinct_texts, judged, paths, removed, repeated_blocks, verified

BYTES = 200
GRAM = 40
SHALLOW = 32
#: Contents of one minimizer whose suffixes are sorted as one group: about 6 MB of text and 1.6 million suffixes. Those of a
#: minimizer with more are dealt over groups of a sixteenth of as many suffixes, as each then carries its own bytes.
HOT = 20_000


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number that sorts like them."""
    return data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def _split(seg: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order by (seg, key), and a mark where a new pair begins."""
    order = np.lexsort((key, seg))
    s, k = seg[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    return order, new


def deep_shallow(data: np.ndarray, starts: np.ndarray, seg: np.ndarray, depth: int = BYTES, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes by their first `depth` bytes within each segment; every suffix has at least so many.

    Returns the order (segments ascending) and, for each place in it, whether that suffix has the segment and the first
    `depth` bytes of the one before.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    order, new = _split(seg, np.zeros(len(seg), np.int8))
    at = np.zeros(len(order), np.int64)  # how deep each place's group agrees

    def groups():
        """Places of groups of two and more, with the first place of each one's group."""
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(new)))
        big = np.repeat(size > 1, size)
        return big, np.repeat(head, size), np.repeat(size, size)

    shallow = min(shallow, depth) // 8 * 8
    while True:  # multikey quicksort: three ways about a pivot, the middle one goes on 8 bytes deeper
        big, head, size = groups()
        here = np.flatnonzero(big & (at < shallow))
        if not len(here):
            break
        key = _eight(data, starts[order[here]] + at[here])
        pivot = np.searchsorted(here, head[here] + size[here] // 2)
        way = np.where(key < key[pivot], 0, np.where(key == key[pivot], 1, 2)).astype(np.int8)
        moved, marks = _split(head[here], way)
        order[here], at[here], new[here] = order[here][moved], (at[here] + 8 * (way == 1))[moved], marks
    while True:  # blind tries: a group hangs on the path of its first suffix, each other one at the depth where it leaves it
        big, head, size = groups()
        here = np.flatnonzero(big & (at < depth))
        if not len(here):
            break
        mine, path = starts[order[here]], starts[order[head[here]]]
        common = at[here].copy()
        on = np.flatnonzero(here != head[here])
        common[here == head[here]] = depth
        while len(on):
            a, b = _eight(data, mine[on] + common[on]), _eight(data, path[on] + common[on])
            differ = a ^ b
            same = differ == 0
            lead = np.zeros(len(on), np.int64)
            for byte in range(1, 8):  # equal leading bytes
                lead += (differ >> np.uint64(64 - 8 * byte)) == 0
            common[on] = np.minimum(common[on] + np.where(same, 8, lead), depth)
            on = on[same & (common[on] < depth)]
        leaves = common < depth
        own = np.where(leaves, data[mine + np.minimum(common, depth - 1)], 0).astype(np.int64)
        other = np.where(leaves, data[path + np.minimum(common, depth - 1)], 0).astype(np.int64)
        # Left of the path the earliest to leave come first, right of it the last.
        rank = np.where(~leaves, 0, np.where(own < other, (common - depth - 1) * 256 + own, (depth + 1 - common) * 256 + own))
        moved, marks = _split(head[here], rank)
        order[here], new[here] = order[here][moved], marks
        at[here] = np.where(leaves, common + 1, depth)[moved]
    return order, ~new


def _contexts(window: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, most=PART_BYTES):
                data, offsets = buffers(part.column(2))
                lists = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                items = lists.flatten()
                a = items.field("a")
                lo, hi, anchor, split = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "hi", "anchor", "split"))
                many = np.where(split > 1, hi - lo + 1, 1)  # of a block whose minimizer is split, each window stands alone
                of = np.repeat(np.arange(len(lo)), many)
                ahead = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                owner, alone = owner[of], split[of] > 1
                lo, anchor, hi = lo[of] + ahead, anchor[of] - ahead, np.where(alone, lo[of] + ahead, hi[of])
                begin, end = offsets[owner] + lo, offsets[owner] + hi + window
                group = np.zeros(len(of), np.int64)
                group[alone] = (Rolling(BYTE_CODES[data])(begin[alone], end[alone]) % split[of][alone].astype(U64)).astype(np.int64)
                size = end - begin
                stop = np.cumsum(size)
                take = np.repeat(begin - (stop - size), size) + np.arange(size.sum())
                body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes())]).cast(pa.binary())
                f1, f2 = (part.column(i).to_numpy(zero_copy_only=False)[owner] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([a.take(pa.array(of)), pa.array(group.astype(np.int32)), pa.array(f1), pa.array(f2), pa.array(lo.astype(np.int32)), pa.array(anchor.astype(np.int32)), items.field("w").take(pa.array(of)), body], ["a", "part", "f1", "f2", "lo", "anchor", "w", "body"])

    return run


def _begins(table: pa.Table) -> np.ndarray:
    """Whether each row begins a group."""
    a, part = (table.column(k).to_numpy() for k in ("a", "part"))
    return np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])


def _sorted_groups(window: int):
    """From contexts sorted by `a` and `part`: ranges of window starts that occur twice."""

    def repeated(table: pa.Table):
        data, offsets = _bytes(table.column("body"))
        f1, f2, lo, anchor, w = (table.column(k).to_numpy() for k in ("f1", "f2", "lo", "anchor", "w"))
        many = np.diff(offsets) - window + 1
        owner = np.repeat(np.arange(len(f1)), many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        # Equal windows have their minimizer at the same place, so suffixes are sorted for each place of it apart.
        group = np.cumsum(_begins(table)) - 1
        seg = group[owner] * (1 << 20) + (anchor[owner] - within)
        order, same = deep_shallow(data, offsets[owner] + within, seg, window)
        classes = np.cumsum(~same) - 1
        twice = np.bincount(classes, weights=w[owner[order]]) >= 2
        hit = np.zeros(len(order), bool)
        hit[order] = twice[classes]
        turn = np.ones(len(hit) + 1, bool)
        turn[1:-1] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
        first, last = np.flatnonzero(turn[:-1] & hit), np.flatnonzero(turn[1:] & hit)
        o = owner[first]
        return pa.RecordBatch.from_arrays([pa.array(f1[o]), pa.array(f2[o]), pa.array((lo[o] + within[first]).astype(np.int32)), pa.array((lo[o] + within[last]).astype(np.int32))], ["f1", "f2", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in parts(batch, "body", PART_BYTES):
                held.append(part)
                size += part.column("body").nbytes
                if size < 2 * PART_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                whole = int(np.flatnonzero(_begins(table))[-1])  # the last group may go on
                if whole:
                    yield repeated(table.slice(0, whole))
                held, size = table.slice(whole).combine_chunks().to_batches(), table.slice(whole).nbytes
        if held and sum(x.num_rows for x in held):
            yield repeated(pa.Table.from_batches(held))

    return run


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    chunks = [x.cast(pa.large_binary()) for x in column.chunks]
    body = pa.concat_arrays(chunks)
    _, offsets, data = body.buffers()
    offsets = np.frombuffer(offsets, np.int64)[body.offset : body.offset + len(body) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sorted_windows(texts: DataFrame, open_blocks: DataFrame, window: int = BYTES) -> DataFrame:
    """Ranges of window starts (f1, f2, lo, hi) in `open_blocks` (a, f1, f2, lo, hi, anchor, w, split) that occur twice there."""
    lists = open_blocks.groupBy("f1", "f2").agg(F.collect_list(F.struct("a", "lo", "hi", "anchor", "w", "split")).alias("open"))
    contexts = texts.select("f1", "f2", "text").join(lists, ["f1", "f2"]).mapInArrow(_contexts(window), "a long, part int, f1 long, f2 long, lo int, anchor int, w int, body binary")
    return contexts.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(_sorted_groups(window), "f1 long, f2 long, lo int, hi int")


def repeated_spans(texts: DataFrame, window: int = BYTES, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """f1, f2, lo, hi: ranges of window starts whose windows occur elsewhere too, of distinct texts."""
    spec = Windows(window, gram, "byte")
    verdict = saved(judged(repeated_blocks(texts, spec)))
    whole = verified(texts, paths(verdict.filter("full").select("c", "f1", "f2", "lo", "hi", "w", "source")), spec)
    split = F.when(F.col("contents") > hot, F.ceil(16 * F.col("contents") / hot)).otherwise(1).cast("int")
    return whole.unionByName(sorted_windows(texts, verdict.filter("open").select("a", "f1", "f2", "lo", "hi", "anchor", "w", split.alias("split")), window))


def _digest(window: int):
    def run(texts, copied, ranges):
        data, offsets = buffers(texts)
        n = np.diff(offsets)
        gone = covered(offsets, ranges, window) | np.repeat(copied & (n >= window), n)
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][n > 0]
        begins[inner] = gone[inner]
        total = np.concatenate([[0], np.cumsum(gone)])
        runs = np.concatenate([[0], np.cumsum(begins)])
        sha = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        return [pa.array(n), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])), pa.array(sha, pa.string())]

    return run


def removed_bytes(docs: DataFrame, window: int = BYTES, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of `docs`.

    Each UTF-8 byte covered by a string of `window` bytes that also starts anywhere else, in the same text too, goes, judged
    on the input; strings never cross texts. Null and empty texts have no bytes; texts under `window` bytes lose none; equal
    texts of `window` bytes and more, repeated rows included, lose all; columns other than id and text aren't read, and null
    ids are kept. The digest is of the bytes that stay, which need not be valid UTF-8.
    """
    spec = Windows(window, gram, "byte")
    texts = distinct_texts(docs, text_col)
    return removed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), texts, repeated_spans(texts, window, gram, hot), spec, _digest(window), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(documents(spark, sf_dir))
