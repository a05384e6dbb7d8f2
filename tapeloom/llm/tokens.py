"""Token counts of whole texts under a byte-level BPE vocabulary.

Ordinary texts are encoded at once. A huge text is cut into overlapping chunks that are encoded on their own, with the byte
offset of every token; in the overlap of two neighbours the encodings are spliced at a boundary that is proven stable. If no
such boundary is in the overlap, the overlap is doubled, in the end up to the whole rest of the text.

What proves a boundary: the pattern of the vocabulary cuts a text into pre-tokens from left to right, and merges never leave
a pre-token. Whatever stands to the left, it ends a pre-token at a single blank between two ASCII letters, so all that
follows such a blank's left side depends on the right alone. A splice needs such a byte, at which both encodings have a
token boundary, and the next `AGREE` tokens of both to be the same.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, repository_of_tokenizers, ship

HUGE_BYTES = 64 << 10
CHUNK_BYTES = 32 << 10
OVERLAP_BYTES = 1 << 10
AGREE = 4
LIMIT = 512
VOCABULARY = "byte_bpe_50k"
END = "<|endoftext|>"

_encoders: dict = {}


class Encoder:
    """The vocabulary of a .tiktoken file of ranks; gives the ids that the .json file of the same vocabulary gives."""

    def __init__(self, path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = special
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)
        for piece, i in special.items():
            self.lengths[i] = len(piece.encode())

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.int64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """The byte after each token."""
        return np.cumsum(self.lengths[ids])


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """Loaded once in each worker."""
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders[vocabulary] = Encoder(repository_of_tokenizers(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN, {END: 50256} if vocabulary == VOCABULARY else {})
    return _encoders[vocabulary]


def _stable(data: bytes, at: int) -> bool:
    """Whether the pre-tokens right of byte `at` are the same for any left context that has a pre-token end there: a single
    blank between two ASCII letters stands there. The pattern always ends the word before the blank, and always takes the
    blank into the word after it. No special token holds a blank."""
    return 0 < at < len(data) - 1 and data[at] == 0x20 and chr(data[at - 1]).isalpha() and data[at - 1] < 128 and data[at + 1] < 128 and chr(data[at + 1]).isalpha()


def _text(data: bytes, start: int, end: int) -> tuple[str, int]:
    """The characters that begin in bytes [start, end), and where the first begins."""
    while start < len(data) and data[start] & 0xC0 == 0x80:
        start += 1
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return data[start:end].decode("utf-8"), start


def spliced(data: bytes, enc: Encoder, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> np.ndarray:
    """The ids of a text of any length, from overlapping chunks."""
    text, at = _text(data, 0, chunk)
    ids = enc.ids(text)
    done = [ids]
    begin, end = 0, len(text.encode())  # of what the last encoding in `done` covers
    while end < len(data):
        width, cut = overlap, None
        while cut is None:
            text, start = _text(data, max(begin, end - width), end + chunk)
            right, left = enc.ids(text), done[-1]
            stop = start + len(text.encode())
            # No boundary in the last tokens of the left chunk counts: its end may have cut a pre-token short.
            both, i, j = np.intersect1d(begin + enc.ends(left)[:-1], start + enc.ends(right)[:-1], assume_unique=True, return_indices=True)
            cut = next((k for k in range(len(both) - 1, -1, -1) if i[k] + AGREE < len(left) - 1 and _stable(data, int(both[k])) and np.array_equal(left[i[k] + 1 : i[k] + 1 + AGREE], right[j[k] + 1 : j[k] + 1 + AGREE])), None)
            if cut is None and start <= begin:
                break
            width *= 2
        if cut is None:  # the right chunk begins where the left one does: it takes its place
            done[-1] = right
            chunk *= 2
        else:
            done[-1] = left[: i[cut] + 1]
            done.append(right[j[cut] + 1 :])
            begin = int(both[cut])
        end = stop
    return np.concatenate(done)


def counted(texts: list[str | None], vocabulary: str = VOCABULARY, huge: int = HUGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text; null is empty."""
    enc = encoder(vocabulary)
    size, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    encode = enc.encoding._core_bpe.encode if hasattr(enc.encoding, "_core_bpe") else None
    special = set(enc.special)
    for k, text in enumerate(texts):
        if text:
            data = text.encode()
            size[k] = len(data)
            if len(data) > huge:
                tokens[k] = len(spliced(data, enc))
            else:
                tokens[k] = len(encode(text, special)) if encode else len(enc.ids(text))
    return size, tokens


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row, repeated rows included.

    Counts equal the library's for the .json file of the vocabulary, special strings in texts recognised, none added. Null
    and empty texts have 0 of both; the whole text counts however long; columns other than id and text aren't read.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            size, tokens = counted(batch.column(1).to_pylist(), vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
