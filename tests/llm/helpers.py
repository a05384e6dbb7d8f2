"""Small tables, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, a long, w long"


def table(spark, texts, sources=None):
    """documents with odd extra columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 3 else None, (sources[i] if sources else f"s{i % 4}"), len(t or ""), "x", "y", 7, 8) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed: int = 5) -> list:
    """Texts with copies, near copies, a shared passage, repeats within a text, long ones, empty ones and nulls."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstlnäé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    passage, base = prose(60), prose(120)
    out: list = [None, "", " \n ", "one", prose(20), base, base]
    for _ in range(6):
        w = base.split(" ")
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(5):
        out.append(prose(30) + " " + passage + " " + prose(25))
    out += [passage + " " + passage, "ab " * 300, prose(3000), prose(40) + "\n" + prose(40)]
    return out


def windows_removed(texts, unit: str, width: int) -> list[tuple[int, int, str]]:
    seqs = [(t or "").encode() if unit == "byte" else WORDS.findall(t or "") for t in texts]
    key = bytes if unit == "byte" else tuple
    count = Counter(key(q[i : i + width]) for q in seqs for i in range(len(q) - width + 1))
    out = []
    for q in seqs:
        gone = [False] * len(q)
        for i in range(len(q) - width + 1):
            if count[key(q[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(q, gone) if not g]
        out.append((len(q), sum(gone), hashlib.sha256(bytes(kept) if unit == "byte" else " ".join(kept).encode()).hexdigest()))
    return out


def spans_removed(texts, width: int) -> list[int]:
    """How many maximal runs of bytes go from each text."""
    seqs = [(t or "").encode() for t in texts]
    count = Counter(q[i : i + width] for q in seqs for i in range(len(q) - width + 1))
    out = []
    for q in seqs:
        gone = ["0"] * len(q)
        for i in range(len(q) - width + 1):
            if count[q[i : i + width]] > 1:
                gone[i : i + width] = ["1"] * width
        out.append(len(re.findall("1+", "".join(gone))))
    return out


def near_components(texts, percent: int = 75) -> list[tuple[int, int]]:
    """(set size, least id reachable) of each text."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").translate(lower))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = defaultdict(set)
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                links[i].add(j)
                links[j].add(i)
    least = {}
    for i in range(len(sets)):
        if i not in least:
            todo, seen = [i], {i}
            while todo:
                for k in links[todo.pop()] - seen:
                    seen.add(k)
                    todo.append(k)
            least |= dict.fromkeys(seen, min(seen))
    return [(len(s), least[i]) for i, s in enumerate(sets)]
