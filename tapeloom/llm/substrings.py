"""Substring dedup over words: a de Bruijn graph whose edges are the windows of `window` words.

Blocks of consecutive edges with a common minimizer (see `repeats`) are the unbranched pieces that a single text shows; equal
blocks are one piece of the graph, and where blocks differ single edges are its pieces. Repeated pieces that always follow each
other compact into paths by Spark joins: a piece joins the next one of a text if both and their pair occur equally often. Each
path has a source, another place that shows it, and is removed if its words, one by one, are those at the source's coordinates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _IS_WS, buffers, documents, saved, words
from .repeats import Windows, covered, distinct_texts, judged, paths, removed, repeated_blocks, repeated_windows, verified

WORDS = 35
GRAM = 10


def repeated_spans(texts: DataFrame, window: int = WORDS, gram: int = GRAM) -> DataFrame:
    """f1, f2, lo, hi: ranges of window starts whose windows occur elsewhere too, of distinct texts."""
    spec = Windows(window, gram, "word")
    verdict = saved(judged(repeated_blocks(texts, spec)))
    pieces = ["c", "f1", "f2", "lo", "hi", "w", "source"]
    single = repeated_windows(texts, verdict.filter("open").select("f1", "f2", "lo", "hi", "w", "full"), spec)
    return verified(texts, paths(verdict.filter("full").select(*pieces).unionByName(single.select(*pieces))), spec)


def _digest(window: int):
    def run(texts, copied, ranges):
        data, offsets = buffers(texts)
        starts, ends, bounds = words(data, offsets)
        n = np.diff(bounds)
        gone = covered(bounds, ranges, window) | np.repeat(copied & (n >= window), n)
        kept = ~gone
        before = np.concatenate([[0], np.cumsum(kept)])
        first = kept & (before[:-1] == np.repeat(before[bounds[:-1]], n))
        step = np.zeros(len(data) + 1, np.int64)
        step[starts[kept] - ~first[kept]] += 1
        np.add.at(step, ends[kept], -1)
        mask = np.cumsum(step[:-1]) > 0
        plain = np.where(_IS_WS[data], 32, data).astype(np.uint8)
        sha = [hashlib.sha256(plain[a:b][mask[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        return [pa.array(n), pa.array(n - np.diff(before[bounds])), pa.array(sha, pa.string())]

    return run


def removed_words(docs: DataFrame, window: int = WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of `docs`.

    Each word that a window of `window` words covers goes if the same word sequence starts anywhere else, in the same text
    too, judged on the input. Null and empty texts have no words and the digest of nothing; texts under `window` words lose
    none; equal texts of `window` words and more, repeated rows included, lose all; columns other than id and text aren't
    read, and null ids are kept.
    """
    spec = Windows(window, gram, "word")
    texts = distinct_texts(docs, text_col)
    return removed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), texts, repeated_spans(texts, window, gram), spec, _digest(window), "n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(documents(spark, sf_dir))
