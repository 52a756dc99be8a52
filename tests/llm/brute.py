"""Plain versions of the operators, straight from their contracts, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    k = min(3, len(words))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(n: int, linked) -> list[int]:
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def lines(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept text) for rows with distinct ids."""
    key = lambda x: lower(x.strip(SPACE))
    held = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def substrings(rows: list[tuple[int, str | None]], window: int = 35) -> list[tuple]:
    """(id, n_words, n_removed, kept text) for each row."""
    words = [WORD.findall(t or "") for _, t in rows]
    starts = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for s in range(len(w) - window + 1) if starts[tuple(w[s:s + window])] > 1
                for k in range(s, s + window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words, windows = WORD.findall(text), defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {k for at in windows.values() if len(at) > 1 for s in at for k in range(s, s + 8)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)),
            len(covered), failed)
