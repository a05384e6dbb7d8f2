"""Personal data: exact patterns, and a linear-chain conditional random field (CRF) over word shapes that adds spans.

Only words with a digit or an @ may carry a label; all others are tagged O by construction. So the chain of a text falls
apart, exactly, into runs of such words, and runs of equal length are decoded together by Viterbi in numpy; a word's features
look at its shape, its neighbours' and the words before it. The CRF is trained on the driver from the small labelled table
that `labelled_table` makes. What it finds is added where it touches no span of the patterns and has what its kind must have:
telephone numbers without a +, cards in other groupings, addresses of IP version 6, and a kind of its own, `secret` (keys and
tokens). Every step takes time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, ship

KINDS = ("email", "ip", "card", "phone")
#: The kinds of all spans: the patterns', and what only the CRF finds.
ALL_KINDS = (*KINDS, "secret")
LABELS = ("O", *ALL_KINDS)
FEATURES = 1 << 12
EXAMPLES = 1200

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of four numbers starts where digits start: from within a run of digits the same parts would follow.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_NOT_DIGIT = re.compile(r"[^0-9]")
_BETWEEN = re.compile(r"[\x20\x09]{1,2}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            last = found.end()
            yield begin, last
            at = text.find("@", last)
        else:
            last = at + 1  # no local part reaches over this @
            at = text.find("@", at + 1)


def _four_parts(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as an index, end), leftmost and non-overlapping for each kind; failing matches are passed over."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _four_parts(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- word shapes

_RUNS = re.compile(r"(.)\1+")
_CLASS = {**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "d" for c in "0123456789"}}
_SHAPES = str.maketrans(_CLASS)
_NO_DIGITS = str.maketrans("", "", "0123456789")


def shape(word: str) -> str:
    """Letters and digits by class, runs of one class once."""
    return _RUNS.sub(r"\1", re.sub(r"[^\x00-\x7f]", "x", word).translate(_SHAPES))


_EDGE = ".,;:!?\"'()[]{}<>*#%&$|"
_LAST = re.compile(r"[^\x20\x09-\x0D]+")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_CREDENTIAL = re.compile(r"[A-Za-z0-9_+/-]{16,}={0,2}")
_NAME = re.compile(r"[A-Za-z_]+(?=[\"']?[=:])")
#: Characters before a run in which the words before it are looked for.
CONTEXT = 48


def _remembered(f):
    """`f` with the results for short strings kept."""
    kept = lru_cache(1 << 16)(f)
    return lambda x: kept(x) if len(x) <= 64 else f(x)


@_remembered
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


@_remembered
def _alone(word: str) -> tuple[str, str, tuple[int, ...]]:
    """Shape and bare lower-case form of a word, and the features that its neighbours don't matter for."""
    own, core = shape(word), word.strip(_EDGE)
    digits, name = len(word) - len(word.translate(_NO_DIGITS)), _NAME.match(core)
    parts = f"t:{min(core.count('.'), 9)}{min(core.count('-'), 9)}{'@' in core}{min(core.count(':'), 9)}"
    long, coded = f"l:{min(len(core) // 4, 16)}:{min(len(own) // 3, 9)}", f"h:{bool(_HEX.fullmatch(core))}{bool(_CREDENTIAL.fullmatch(core))}"
    return own, core.lower(), tuple(map(_slot, (f"s:{own}", f"c:{shape(core)}", f"d:{min(digits, 20)}", parts, long, coded, f"a:{name[0].lower() if name else ''}", "1")))


def word_features(words: list[str], before: str = "") -> list[list[int]]:
    """Hashed features of each word of a run, `before` being the text before it: its shape and its neighbours' in the run, how
    many digits, parts and changes of class, and the words before."""
    alone = [_alone(w) for w in words]
    names = [x.strip(_EDGE).lower() for x in _LAST.findall(before)[-2:]]
    names = [*[""] * (2 - len(names)), *names, *[name for _, name, _ in alone]]
    out = []
    for i, (own, _, slots) in enumerate(alone):
        left, right = alone[i - 1][0] if i else "^", alone[i + 1][0] if i + 1 < len(alone) else "$"
        out.append([*slots, _slot(f"p:{left}"), _slot(f"n:{right}"), _slot(f"w:{names[i + 1]}"), _slot(f"v:{names[i]}:{names[i + 1]}"), _slot(f"b:{own}:{left if i else names[1]}")])
    return out


def labelled_table(examples: int = EXAMPLES, seed: int = 9) -> list[tuple[str, list[str], list[int]]]:
    """Runs of words with what stands before and a label each: personal data and credentials as people write them, and other
    words with digits."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(int(rng.integers(1, 4))))
    some = lambda alphabet, n: "".join(alphabet[int(k)] for k in rng.integers(0, len(alphabet), n))
    base64 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def card() -> str:
        digits = pick("4", "5", "3") + number(14)
        return next(digits + c for c in "0123456789" if luhn(digits + c))

    def phone() -> list[str]:
        a, b, c = number(3), number(3), number(4)
        return pick([f"+{pick('1', '44', '49', '33')}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"({a}){b}-{c}"], [f"00{pick('1', '44', '49')}-{a}-{b}-{c}"], [f"{a}.{b}.{c}"])

    def credential() -> str:
        return pick(some("0123456789abcdef", int(rng.integers(16, 65))), some(base64, int(rng.integers(20, 50))), "AKIA" + some(base64[26:], 16), "ghp_" + some(base64, 36), "sk-" + some(base64, 40), some("0123456789ABCDEF", 40))

    def other() -> list[str]:
        return pick([f"{rng.integers(1800, 2100)}"], [f"{rng.integers(1, 99)}.{number(2)}"], [f"{rng.integers(1, 24)}:{number(2)}"], [f"20{number(2)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"], [f"v{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}"], [f"#{number(5)}"], [f"@{name()}"], [f"{number(int(rng.integers(1, 19)))}"], [f"{rng.integers(1, 999)},{number(3)}"], [f"{name()}{number(2)}"], [f"\"{number(6)}{name()}{number(4)}\""], [number(3), number(4)], [f"{rng.integers(1, 99)}-{rng.integers(1, 99)}"], [f"${number(3)}.{number(2)}"], [f"({number(4)})"], [f"{number(2)}%"], [f"{rng.integers(1, 24)}:{number(2)}:{number(2)}"], [f"https://{name()}.org/{name()}/{number(4)}"], [f"{name()}_{number(3)}.txt"])

    out = []
    secret_names = ("token", "key", "secret", "password", "passwd", "api_key", "apikey", "access_key", "secret_key", "auth_token", "bearer", "credential")
    for _ in range(examples):
        before = " ".join(name() for _ in range(2))
        words: list[str] = []
        labels: list[int] = []
        for _ in range(int(rng.integers(1, 3))):
            kind = pick(0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 5)
            made = other()
            if kind == 0 and not words and rng.random() < 0.25:  # digests and names of things look like credentials
                before, made = f"{name()} {pick('commit', 'sha256', 'md5', 'checksum', 'build', 'revision', 'file', 'id', name())}", [pick(some("0123456789abcdef", int(rng.integers(16, 65))), "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)))]
            elif kind == 1:
                made = [f"{name()}{pick('', '.', '_')}{number(pick(0, 2))}@{name()}{pick('.', '-')}{name()}.{pick('com', 'org', 'de', 'example')}"]
            elif kind == 2:
                made = [pick(".".join(str(rng.integers(0, 256)) for _ in range(4)) + pick("", "", f":{number(4)}"), ":".join(some("0123456789abcdef", int(rng.integers(1, 5))) for _ in range(8)), f"2001:db8:{some('0123456789abcdef', 4)}::{some('0123456789abcdef', 2)}", f"fe80::{some('0123456789abcdef', 4)}:{some('0123456789abcdef', 4)}")]
            elif kind == 3:
                digits, sign = card(), pick("", " ", "-", ".")
                made = sign.join(digits[i : i + 4] for i in range(0, 16, 4)).split(" ") if sign else [digits]
            elif kind == 4:
                made = phone()
            elif kind == 5:
                title, quote = pick(*secret_names), pick("", '"', "'")
                title = pick(title, title.upper(), title.capitalize())
                if words or rng.random() < 0.4:
                    made = [f"{title}{pick('=', ':', '=')}{quote}{credential()}{quote}"]
                else:
                    before, made = f"{name()} {title}{pick(' =', ' :', ':', ' is')}", [f"{quote}{credential()}{quote}"]
            if rng.random() < 0.3:
                made = [*made[:-1], made[-1] + pick(".", ",", ";", ")", "!", "!!", "###", "$$$", "|")]
            words += made
            labels += [kind] * len(made)
        out.append((before, words, labels))
    return out


class Field:
    """A linear-chain CRF with one weight for each hashed feature and label, and for each pair of labels."""

    def __init__(self):
        n = len(LABELS)
        self.emit, self.pair = np.zeros((FEATURES, n)), np.zeros((n, n))
        self.begin, self.end = np.zeros(n), np.zeros(n)

    def scores(self, batch: np.ndarray) -> np.ndarray:
        """batch: sequences x words x features."""
        return self.emit[batch].sum(axis=2)

    def viterbi(self, batch: np.ndarray) -> np.ndarray:
        """The best labels of sequences of equal length, all advancing together; vectorised maxima keep the way back."""
        score = self.scores(batch)
        best, back = score[:, 0] + self.begin, []
        for t in range(1, batch.shape[1]):
            ways = best[:, :, None] + self.pair
            back.append(ways.argmax(axis=1))
            best = ways.max(axis=1) + score[:, t]
        out = np.empty(batch.shape[:2], np.int8)
        out[:, -1] = (best + self.end).argmax(axis=1)
        for t in range(batch.shape[1] - 2, -1, -1):
            out[:, t] = back[t][np.arange(len(batch)), out[:, t + 1]]
        return out

    def fit(self, table: list[tuple[str, list[str], list[int]]], rounds: int = 60, rate: float = 0.1, decay: float = 1e-4) -> "Field":
        """Adam on the log-likelihood; expectations by the forward-backward recursion over sequences of equal length."""
        groups = defaultdict(list)
        for before, words, labels in table:
            groups[len(words)].append((word_features(words, before), labels))
        groups = {n: (np.array([f for f, _ in rows]), np.array([y for _, y in rows])) for n, rows in groups.items()}
        total = sum(len(y) for _, y in groups.values())
        params = (self.emit, self.pair, self.begin, self.end)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for step in range(1, rounds + 1):
            grads = [-decay * p for p in params]
            for n, (x, y) in groups.items():
                score = self.scores(x)
                ahead = [score[:, 0] + self.begin]
                for t in range(1, n):
                    ahead.append(lse(ahead[-1][:, :, None] + self.pair, 1) + score[:, t])
                behind = [np.broadcast_to(self.end, ahead[0].shape)]
                for t in range(n - 1, 0, -1):
                    behind.insert(0, lse(self.pair + (score[:, t] + behind[0])[:, None, :], 2))
                z = lse(ahead[-1] + self.end, 1)
                for t in range(n):
                    error = np.eye(len(LABELS))[y[:, t]] - np.exp(ahead[t] + behind[t] - z[:, None])
                    for k in range(x.shape[2]):
                        np.add.at(grads[0], x[:, t, k], error / total)
                    if t == 0:
                        grads[2] += error.sum(axis=0) / total
                    if t == n - 1:
                        grads[3] += error.sum(axis=0) / total
                    if t:
                        expected = np.exp(ahead[t - 1][:, :, None] + self.pair + (score[:, t] + behind[t])[:, None, :] - z[:, None, None]).sum(axis=0)
                        np.add.at(expected, (y[:, t - 1], y[:, t]), -1)
                        grads[1] -= expected / total
            for p, g, (m, s) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def _address(found: str) -> bool:
    if found.count(":") < 2 or len(found) > 45:
        return False
    try:
        return ipaddress.ip_address(found).version == 6
    except ValueError:
        return False


def _held(kind: int, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The part of text[a:b] that has what its kind must have, if any."""
    while a < b and text[a] in _MARKS:
        a += 1
    while b > a and text[b - 1] in _MARKS:
        b -= 1
    found = text[a:b]
    if kind == 0:
        at = found.find("@")
        good = at > 0 and found.count("@") == 1 and "." in found[at:]
    elif kind == 1:
        good = _address(found) or bool(_IP.fullmatch(found.split(":")[0])) and _four_parts(found.split(":")[0])
    elif kind == 2:
        digits = _NOT_DIGIT.sub("", found)
        good = 12 <= len(digits) <= 19 and luhn(digits)
    elif kind == 3:
        good = 9 <= len(_NOT_DIGIT.sub("", found)) <= 15 and any(c in found for c in "()-.") and not re.search(r"[A-Za-z]", found)
    else:
        inner = max(_CREDENTIAL.finditer(found), key=lambda m: m.end() - m.start(), default=None)
        good = inner is not None and bool(_DIGIT.search(inner[0])) and bool(re.search(r"[A-Za-z]", inner[0]))
        if good:
            a, b = a + inner.start(), a + inner.end()
    return (a, b) if good else None


#: What is trimmed at the ends of a span.
_MARKS = ".,;:!?\"'[]{}<>*#%&$|"


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans of the CRF that touch no base span."""
    runs = []
    for i, text in enumerate(texts):
        run: list[tuple[int, int]] = []
        for m in _MARKED.finditer(text):
            if run and not _BETWEEN.fullmatch(text, run[-1][1], m.start()):
                runs.append((i, run))
                run = []
            run.append(m.span())
        if run:
            runs.append((i, run))
    by_length = defaultdict(list)
    for i, run in runs:
        # Runs of patterns alone need no decoding: whatever the field says touches a base span.
        if not all(any(a < e and s < b for s, _, e in base[i]) for a, b in run):
            by_length[len(run)].append((i, run))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for n, rows in by_length.items():
        step = max(1, 20_000 // n)
        for at in range(0, len(rows), step):
            mine = rows[at : at + step]
            tags = field.viterbi(np.array([word_features([texts[i][a:b] for a, b in run], texts[i][max(0, run[0][0] - CONTEXT) : run[0][0]]) for i, run in mine]))
            for (i, run), tag in zip(mine, tags):
                k = 0
                while k < n:
                    j = k + 1
                    while j < n and tag[j] == tag[k]:
                        j += 1
                    if tag[k]:
                        held = _held(int(tag[k]) - 1, texts[i], run[k][0], run[j - 1][1])
                        if held and not any(held[0] < e and b < held[1] for b, _, e in base[i]):
                            out[i].append((held[0], int(tag[k]) - 1, held[1]))
                    k = j
    return out


def _written(spans) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (by the patterns), base_sha256, spans (the patterns' and the CRF's, whose kinds
    include `secret`), n_added.

    Places are code points of the whole text, ends exclusive. Null and empty texts have no spans (an empty string, and the
    digest of one); rows are judged alone, so repeated rows get equal values; other columns aren't read.
    """
    ship(docs.sparkSession)
    field = field or Field().fit(labelled_table())

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, field)
                counts = np.array([np.bincount([k for _, k, _ in b], minlength=4) for b in base], np.int64).reshape(len(texts), 4)
                sha = [hashlib.sha256(_written(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(counts[:, k]) for k in range(4)], pa.array(sha, pa.string()), pa.array([_written(b + m) for b, m in zip(base, more)], pa.string()), pa.array([len(m) for m in more], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with every span of personal data in the text replaced by its kind in brackets; null texts stay null."""
    ship(docs.sparkSession)
    field = field or Field().fit(labelled_table())
    index = docs.columns.index(text_col)

    def cover(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, k, b in sorted(spans):
            if a >= at:
                out += [text[at:a], f"[{ALL_KINDS[k]}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            for part in parts(batch, text_col):
                texts = part.column(index).to_pylist()
                plain = [t or "" for t in texts]
                base = [base_spans(t) for t in plain]
                more = added_spans(plain, base, field)
                new = [None if t is None else cover(t, b + m) for t, b, m in zip(texts, base, more)]
                yield part.set_column(index, part.schema.field(index).name, pa.array(new, part.schema.field(index).type))

    return docs.mapInArrow(run, docs.schema)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
