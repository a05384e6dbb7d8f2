"""SentencePiece encoding and decoding, in numpy batches.

A text becomes words (a run of the space mark and what follows it; no piece of a vocabulary with this property spans two).
Distinct words of equal length advance together: fingerprints of their substrings probe the sorted fingerprints of the pieces.
For unigram models a Viterbi search follows, whose vectorised maxima store backpointers. A BPE model's result isn't the path
of the best sum of scores, so for those the vectorised maximum picks, in every word at once, the adjacent pair of the best
score, leftmost of equals, until no pair is a piece. Characters outside the vocabulary become byte pieces, or unknown.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, U64, documents, mixed, parts, powers, repository_of_tokenizers, ship

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words over this many characters are encoded one by one, each step in time of its length's logarithm.
LONG = 48
MEMORY = 400_000  # distinct words that a worker remembers
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_models: dict = {}


class Model:
    """Pieces and scores of a .model file with the identity normaliser."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.pieces = [p for p, _, _ in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        usable = [(i, p, s) for i, (p, s, t) in enumerate(pieces) if t in (NORMAL, USER) and p]
        self.longest = max((len(p) for _, p, _ in usable), default=1)
        self.power = powers(self.longest + 1)
        keys = np.array([self._key(p) for _, p, _ in usable], U64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array([i for i, _, _ in usable], np.int64)[order], np.array([s for _, _, s in usable], float)[order]
        self.of = {p: (i, s) for i, p, s in usable}
        self.least = float(self.scores.min()) if len(usable) else 0.0
        self.fallback_bytes = bool((self.bytes >= 0).all())
        self.table = self.bytes_of()

    @classmethod
    def read(cls, path: str) -> "Model":
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normaliser are read")
        return cls([(p.piece, p.score, p.type) for p in proto.pieces], proto.trainer_spec.model_type, spec.add_dummy_prefix)

    def bytes_of(self) -> list[bytes]:
        """What each id stands for in a text; control pieces for nothing."""
        out = []
        for i, p in enumerate(self.pieces):
            b = int(p[3:5], 16) if re.fullmatch("<0x[0-9A-F]{2}>", p) and self.bytes[int(p[3:5], 16)] == i else None
            out.append(bytes([b]) if b is not None else b"" if re.fullmatch("</?s>|<pad>", p) else " ⁇ ".encode() if i == self.unknown else p.replace(SPACE, " ").encode())
        return out

    def _key(self, piece: str) -> int:
        codes = mixed(np.array([ord(c) for c in piece], U64) + U64(1))
        return (int((codes * self.power[: len(codes)]).sum(dtype=U64)) + len(codes) * (BASE >> 3)) % (1 << 64)

    # ------------------------------------------------------------ words of equal length

    def _prefixes(self, chars: np.ndarray) -> np.ndarray:
        """Sums from which every substring's fingerprint follows."""
        codes = mixed(chars.astype(U64) + U64(1))
        sums = np.zeros((len(chars), chars.shape[1] + 1), U64)
        np.cumsum(codes * powers(chars.shape[1]), axis=1, out=sums[:, 1:])
        return sums

    def _probe(self, sums: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score (minus infinity: no piece) and id of substrings [start, end) of words."""
        back = powers(sums.shape[1], pow(BASE, -1, 1 << 64))
        key = (sums[row, end] - sums[row, start]) * back[start] + (end - start).astype(U64) * U64(BASE >> 3)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (end - start <= self.longest)
        return np.where(hit, self.scores[at], -np.inf), np.where(hit, self.ids[at], -1)

    def merged(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and ids of the pieces of each word (BPE); id -1: a character of no piece."""
        n, width = chars.shape
        sums, rows = self._prefixes(chars), np.arange(n)
        nxt = np.tile(np.arange(1, width + 1), (n, 1))  # the start of the symbol after; at `width` none
        prev = np.tile(np.arange(-1, width - 1), (n, 1))
        alive = np.ones((n, width), bool)
        score = np.full((n, width), -np.inf)  # of the symbol from here joined with the next
        r, c = np.divmod(np.arange(n * max(width - 1, 0)), max(width - 1, 1))
        if len(r):
            score[r, c] = self._probe(sums, r, c, c + 2)[0]
        active = rows
        while len(active) and width > 1:
            best = score[active].argmax(axis=1)
            go = score[active, best] > -np.inf
            active, best = active[go], best[go]
            if not len(active):
                break
            gone = nxt[active, best]
            after = nxt[active, gone]
            alive[active, gone] = False
            score[active, gone] = -np.inf
            nxt[active, best] = after
            inner = after < width
            prev[active[inner], after[inner]] = best[inner]
            score[active, best] = -np.inf
            if inner.any():
                a, b = active[inner], best[inner]
                score[a, b] = self._probe(sums, a, b, nxt[a, after[inner]])[0]
            left = prev[active, best]
            has = left >= 0
            if has.any():
                a, l = active[has], left[has]
                score[a, l] = self._probe(sums, a, l, after[has])[0]
        r, c = np.nonzero(alive)
        ids = self._probe(sums, r, c, nxt[r, c])[1]
        cut = np.searchsorted(r, np.arange(n + 1))
        return [(c[a:b], ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]

    def best_paths(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and ids of the pieces of each word (unigram), by Viterbi; a character of no piece costs 10 under the least score."""
        n, width = chars.shape
        sums, rows = self._prefixes(chars), np.arange(n)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, taken = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1)
        for end in range(1, width + 1):
            starts = np.arange(max(0, end - self.longest), end)
            r, s = np.repeat(rows, len(starts)), np.tile(starts, n)
            score, ids = (x.reshape(n, -1) for x in self._probe(sums, r, s, np.full(len(s), end)))
            score[:, -1] = np.where(ids[:, -1] < 0, self.least - 10, score[:, -1])
            total = best[:, starts] + score
            pick = total.argmax(axis=1)
            best[:, end], back[:, end], taken[:, end] = total[rows, pick], starts[pick], ids[rows, pick]
        out = []
        for k in range(n):
            at, starts, ids = width, [], []
            while at:
                starts.append(back[k, at])
                ids.append(taken[k, at])
                at = back[k, at]
            out.append((np.array(starts[::-1], np.int64), np.array(ids[::-1], np.int64)))
        return out

    def merged_long(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """As `merged`, of one long word, with a heap of pairs."""
        import heapq

        n = len(word)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def push(a: int) -> None:
            if a >= 0 and end[a] < n:
                found = self.of.get(word[a : end[end[a]]]) if end[end[a]] - a <= self.longest else None
                if found:
                    heapq.heappush(heap, (-found[1], a, end[a], end[end[a]]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, a, middle, stop = heapq.heappop(heap)
            if not alive[a] or end[a] != middle or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle] = False
            end[a] = stop
            if stop < n:
                prev[stop] = a
            push(a)
            push(prev[a])
        starts = [i for i in range(n) if alive[i]]
        return np.array(starts), np.array([self.of.get(word[i : end[i]], (-1, 0))[0] for i in starts], np.int64)

    # ------------------------------------------------------------ texts

    def words(self, text: str) -> list[str]:
        return _WORD.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)) if text else []

    def encoded_words(self, distinct: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list = [None] * len(distinct)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(distinct):
            by_length.setdefault(len(word), []).append(k)
        for n, members in by_length.items():
            step = max(1, 200_000 // n)
            for at in range(0, len(members), step):
                mine = members[at : at + step]
                if self.kind == BPE and n > LONG:
                    found = [self.merged_long(distinct[k]) for k in mine]
                else:
                    chars = np.frombuffer("".join(distinct[k] for k in mine).encode("utf-32-le"), np.uint32).reshape(len(mine), n)
                    found = self.merged(chars) if self.kind == BPE else self.best_paths(chars)
                for k, (starts, ids) in zip(mine, found):
                    out[k] = ids if (ids >= 0).all() else self._filled(distinct[k], starts, ids)
        return out

    def _filled(self, word: str, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        done: list[int] = []
        for s, i in zip(starts.tolist(), ids.tolist()):
            if i >= 0:
                done.append(i)
            elif self.fallback_bytes:
                done += self.bytes[list(word[s].encode())].tolist()
            elif not (done and done[-1] == self.unknown and self.kind == UNIGRAM):
                done.append(self.unknown)
        return np.array(done, np.int64)

    def decoded(self, ids: np.ndarray) -> str:
        data = b"".join([self.table[i] for i in ids])
        text = data.decode("utf-8", errors="replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Coder:
    """A model with the words that it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        if len(self.place) > MEMORY:
            self.forget()
        place, new, rows = self.place, [], []
        for text in texts:
            found = self.model.words(text) if text else []
            for w in set(found).difference(place):
                place[w] = len(place)
                new.append(w)
            rows.append([place[w] for w in found])
        if new:
            more = self.model.encoded_words(new)
            self.flat = np.concatenate([self.flat, *more])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(m) for m in more])])
        index = np.array([k for row in rows for k in row], np.int64)
        size = self.begin[index + 1] - self.begin[index]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[index] - (upto - size), size) + np.arange(size.sum())]
        words_before = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return ids, np.concatenate([[0], upto])[words_before]


def coder(path: str) -> Coder:
    """Loaded once in each worker."""
    if path not in _models:
        _models[path] = Coder(Model.read(path))
    return _models[path]


def encoded(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """`docs` with `ids`, the pieces of the text: as the SentencePiece library gives them without added begin or end.

    Null texts have null ids, empty ones none. Whole texts, however long; repeated rows and other columns stay as they are
    (a column called ids is replaced).
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != "ids"]
    index = kept.index(text_col)

    def run(batches):
        made = coder(repository_of_tokenizers(model))
        for batch in batches:
            for part in parts(batch, text_col):
                ids, bounds = made.encode(part.column(index).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=part.column(index).is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*kept, "ids"])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """`rows` with `decoded`, the text of the ids; null ids give null."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != "decoded"]
    index = kept.index(ids_col)

    def run(batches):
        made = coder(repository_of_tokenizers(model)).model
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if x is None else made.decoded(x) for x in part.column(index).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    picked = rows.select(*[F.col(f"`{c}`") for c in kept])
    return picked.mapInArrow(run, T.StructType([*picked.schema, T.StructField("decoded", T.StringType())]))


def coded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and round_trip (whether the decoded
    ids are the text, blanks for space marks) of each row; null counts as empty."""
    ship(docs.sparkSession)

    def run(batches):
        made = coder(repository_of_tokenizers(model))
        for batch in batches:
            for part in parts(batch, most=2 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, bounds = made.encode(texts)
                each = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                sha = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in each]
                same = [made.model.decoded(x) == t.replace(SPACE, " ") for x, t in zip(each, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(np.diff(bounds)), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "round_trip"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir))
