"""Plain versions of the operators' contracts, over Python lists."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base entities."""
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


def repeats(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if first.get(w, doc_id + 1) > doc_id:
                first[w] = doc_id
    out = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < doc_id:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[doc_id] = (len(data), sum(gone), spans, sha(kept))
    return out


def words_and_end(text: str | None) -> list[str]:
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + ["\n"]


def unigrams(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    counts = Counter(w for d, t in docs if not held[d] for w in words_and_end(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs:
        tokens = words_and_end(t)
        out[d] = (held[d], len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    return out


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    words = [w for w in WORD.findall((text or "").lower())]
    if not words:
        return frozenset()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_groups(docs: list[tuple[int, str | None]], similarity: float = 0.8):
    """doc_id -> (class_id, group_id, number of links)."""
    sets = {d: shingle_set(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common: Counter = Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                common[(a, b)] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links: Counter = Counter()
    for (a, b), c in common.items():
        if c >= similarity * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    first: dict = {}
    for d in sorted(sets):
        if sets[d]:
            first.setdefault(sets[d], d)
    return {d: (first.get(s, d), find(d), links[d]) for d, s in sets.items()}


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
