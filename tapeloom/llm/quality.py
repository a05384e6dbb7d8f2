"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is half of the difference between the
square of sums and the sum of squares, so a text is scored in time linear in its features. Trained on the driver from at most
MAX_LABELLED labelled rows (the least by a hash of their id), which bounds what is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, buffers, documents, mixed, parts, ship, word_codes, words

HASHED = 1 << 14
BINS = 16
FACTORS = 8
MAX_LABELLED = 4000
EPOCHS = 12
_SYMBOLS, _UPPER, _DIGITS, _ENDS, _MARKS = (np.zeros(256, bool) for _ in range(5))
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGITS[48:58] = True
_ENDS[list(b".?\n")] = True
_MARKS[list(b"!;:=(){}[]/\\_+-@\"")] = True
STATS = ("length", "word length", "symbols", "capitals", "digits", "ends", "marks", "distinct words", "repeats", "n_chars")
SIZE = HASHED + len(STATS) * BINS


def features(texts, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row index, feature and value of each entry. Words are hashed and their counts scaled to length 1; each
    statistic falls in one of BINS bins, a feature of value 1."""
    data, offsets = buffers(texts)
    starts, ends, bounds = words(data, offsets)
    n = np.diff(bounds)
    rows = len(n)
    owner = np.repeat(np.arange(rows), n)
    codes = word_codes(data, starts, ends)
    # Marks at either end of a word don't change its bucket's meaning, so whole words are hashed as they stand.
    slot = owner * HASHED + (codes >> U64(50)).astype(np.int64)
    entry, count = np.unique(slot, return_counts=True)
    row, feature = entry // HASHED, entry % HASHED
    norm = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=rows))
    value = count / np.maximum(norm[row], 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return np.diff(total[offsets]) / np.maximum(np.diff(offsets), 1)

    pairs = mixed(codes[:-1] * U64(3) + codes[1:]) if len(codes) > 1 else codes[:0]
    inside = owner[:-1] == owner[1:] if len(owner) > 1 else np.zeros(0, bool)
    seen = np.unique(np.stack([owner[:-1][inside].astype(U64), pairs[inside]]), axis=1)[0].astype(np.int64) if inside.any() else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[bounds])
    each = np.maximum(n, 1)
    stats = [
        np.log1p(n) / 10, size / each / 16, np.sqrt(share(_SYMBOLS)), np.sqrt(share(_UPPER)), np.sqrt(share(_DIGITS)), np.sqrt(share(_ENDS)), np.sqrt(share(_MARKS)),
        np.bincount(row, minlength=rows) / each, np.bincount(seen, minlength=rows) / np.maximum(n - 1, 1), np.log1p(np.maximum(n_chars, 0)) / 14,
    ]
    binned = [HASHED + k * BINS + np.minimum((np.nan_to_num(s) * BINS).astype(np.int64), BINS - 1) for k, s in enumerate(stats)]
    row = np.concatenate([row, *[np.arange(rows)] * len(stats)])
    feature = np.concatenate([feature, *binned])
    value = np.concatenate([value, np.ones(rows * len(stats))])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


class Machine:
    def __init__(self, bias: float = 0.0, seed: int = 6, spread: float = 0.01):
        self.bias, self.w = bias, np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, spread, (SIZE, FACTORS))

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum before the sigmoid, and sum_i v_i x_i, of each row."""
        linear = np.bincount(row, weights=self.w[feature] * value, minlength=rows)
        sums, squares = np.zeros((rows, FACTORS)), np.zeros(rows)
        for f in range(FACTORS):
            x = self.v[feature, f] * value
            sums[:, f] = np.bincount(row, weights=x, minlength=rows)
            squares += np.bincount(row, weights=x * x, minlength=rows)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, *sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*sparse)[0], -30, 30)))

    def fit(self, row, feature, value, label, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 6) -> "Machine":
        """Adam on the logistic loss."""
        rng, rows = np.random.default_rng(seed), len(label)
        begin = np.searchsorted(row, np.arange(rows + 1))
        params = [self.w, self.v]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(rows)
            for at in range(0, rows, batch):
                mine = order[at : at + batch]
                many = begin[mine + 1] - begin[mine]
                take = np.repeat(begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                r, f, x = np.repeat(np.arange(len(mine)), many), feature[take], value[take]
                raw, sums = self.raw(r, f, x, len(mine))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[mine]) / len(mine)
                touched, place = np.unique(f, return_inverse=True)
                ex = error[r] * x
                grads = [np.bincount(place, weights=ex), np.stack([np.bincount(place, weights=ex * (sums[r, k] - self.v[f, k] * x)) for k in range(FACTORS)], axis=1)]
                step += 1
                self.bias -= rate * error.sum()
                for p, g, (m, s) in zip(params, grads, moments):
                    g = g + decay * p[touched]
                    m[touched] = 0.9 * m[touched] + 0.1 * g
                    s[touched] = 0.999 * s[touched] + 0.001 * g * g
                    p[touched] -= rate * (m[touched] / (1 - 0.9**step)) / (np.sqrt(s[touched] / (1 - 0.999**step)) + 1e-8)
        return self


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def _sparse(batches):
    for batch in batches:
        for part in parts(batch, most=1 << 20):
            row, feature, value = features(part.column(1), part.column(2).to_numpy(zero_copy_only=False))
            at = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32))), part.column(3)], ["feature", "value", "label"])


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Machine:
    """A machine from labelled rows whose crc32 of the id, as text, isn't 1 modulo 3; of more than `most`, those least by a
    hash of the id. Of rows with one id, the least text counts, so that no more than `most` texts reach the driver. Rows without
    id or label don't count. With labels of one value or none, every score is its share (0.5)."""
    ship(docs.sparkSession)
    usable = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("label")).filter("doc_id is not null and label is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "label").limit(most)
    labelled = _narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # broadcast: `most` rows at most
    found = labelled.groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("d")).select("doc_id", "d.text", "d.n_chars", "label")
    rows = found.mapInArrow(_sparse, "feature array<int>, value array<float>, label double").toArrow()
    if not rows.num_rows:
        return Machine(spread=0.0)
    rows = rows.combine_chunks()
    label = rows.column("label").to_numpy()
    mean = float(np.clip(label.mean(), 0.01, 0.99))
    bias = float(np.log(mean / (1 - mean)))
    if label.min() == label.max():
        return Machine(bias, spread=0.0)
    machine = Machine(bias)
    lists = rows.column("feature").combine_chunks()
    row = np.repeat(np.arange(len(label)), lists.value_lengths().to_numpy(zero_copy_only=False))
    # The order of rows depends on the cluster; training doesn't.
    feature, value = lists.flatten().to_numpy().astype(np.int64), rows.column("value").combine_chunks().flatten().to_numpy().astype(float)
    total = np.bincount(row, weights=feature * value, minlength=len(label))
    rank = np.argsort(np.lexsort((label, total)))
    order = np.argsort(rank[row], kind="stable")
    return machine.fit(rank[row][order], feature[order], value[order], label[np.lexsort((label, total))])


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row; null texts score as empty ones, ids and other columns don't matter."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in parts(batch, most=1 << 20):
                score = machine.scores(*features(part.column(1), part.column(2).to_numpy(zero_copy_only=False)), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score 0.5 and more, as they are."""
    ship(docs.sparkSession)
    index = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in parts(batch, text_col, 1 << 20):
                text = part.column(index)
                n_chars = pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield part.filter(pa.array(machine.scores(*features(text, n_chars), part.num_rows) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
