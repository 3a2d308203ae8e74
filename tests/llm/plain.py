"""Plain versions of the operators' definitions, and small tables with the odd cases in them."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import xxhash

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents(seed: int = 1) -> list[tuple]:
    """Nulls, empty, white and very long texts, ties, repeated rows, copies, shared passages."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(1, 90)), "en", "s", 1) for i in range(30)]
    rows += [(100 + i, f"{prose(rng, 15)} {shared}\n{prose(rng, 9)}", "en", None, None) for i in range(6)]
    rows += [(200 + i, rows[3][1], "en", "s", 3) for i in range(4)]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, " \t\n ", "de", "s", 4), (303, "One", "de", "s", 3),
             (304, "again " * 70, "en", "s", 9), (305, prose(rng, 4000), "en", "s", 9), (306, f"É À\x0b{shared} \x1cz", "fr", "s", 9),
             (307, "x" * 50_000, "en", "s", 9), (308, "日本 語 " * 30, "ja", "s", 9), (None, prose(rng, 40), "en", "s", 1),
             (None, shared, "en", "s", 1)]
    return [*rows, rows[5], rows[5], rows[-1]]


def repeats(rows: list[tuple], size: int = 20) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept) by op1's definition."""
    first: dict[tuple, tuple] = {}
    texts = [(d, SPACED.findall(t or "")) for d, t, *_ in rows]
    place = lambda d, i: (d is not None, d or 0, i)
    for d, w in texts:
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            first[key] = min(first.get(key, place(d, i)), place(d, i))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < place(d, i):
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def fingerprint(text: str | None) -> int:
    words = SPACED.findall(lower_ascii(text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: list[int], most: int = 2) -> list[int]:
    """The class of each fingerprint: links are at most ``most`` differing bits."""
    distinct = sorted(set(prints))
    up = {p: p for p in distinct}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= most:
                a, b = sorted((top(p), top(q)))
                up[b] = a
    return [top(p) for p in prints]


def shingle_set(text: str | None, size: int = 5) -> set[tuple]:
    w = SPACED.findall(lower_ascii(text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def near_copy_groups(rows: list[tuple], alike: float = 0.8) -> list[list[tuple]]:
    """The rows of each group linked by the Jaccard similarity of 5-word shingles, by all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= alike:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    groups: dict[int, list[tuple]] = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r)
    return list(groups.values())


def edited(rng: random.Random, text: str, edits: int) -> str:
    """The text with that many words replaced by new ones."""
    w = text.split()
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"new{rng.randrange(10_000)}"
    return " ".join(w)


def contamination(rows: list[tuple], items: list[tuple], size: int = 10) -> list[tuple]:
    """(doc_id, n_words, n_hit, item ids) by op9's definition."""
    windows = []
    for item, text in items:
        w = WORD.findall(lower_ascii(text or ""))
        n = min(size, len(w))
        windows += [(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for d, text, *_ in rows:
        w = WORD.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for item, seq in windows:
            for i in range(len(w) - len(seq) + 1):
                if tuple(w[i:i + len(seq)]) == seq:
                    hit |= set(range(i, i + len(seq)))
                    found.add(item)
        out.append((d, len(w), len(hit), sorted(str(x) for x in found - {None})))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
