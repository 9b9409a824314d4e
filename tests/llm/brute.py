"""Plain versions of the operators, one document at a time."""

from __future__ import annotations

import collections
import fractions
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def secrets(text: str) -> list[tuple[int, int, int, str]]:
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def bytes_removed(docs: list[tuple[int | None, str]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - 49):
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def words_removed(docs: list[tuple[int | None, str]], size: int = 35) -> list[tuple]:
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    seen = collections.Counter(tuple(w[k : k + size]) for _, w in words for k in range(len(w) - size + 1))
    out = []
    for i, w in words:
        gone: set[int] = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def tokens(docs: list[tuple[int | None, str]], path: str) -> list[tuple]:
    from tokenizers import Tokenizer

    coder, out, at = Tokenizer.from_file(path), [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def shingles(text: str) -> set[tuple[str, ...]]:
    w = WORD.findall(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(docs: list[tuple[int, str]]) -> list[tuple]:
    """doc_id, size, component, kept; ids must not repeat."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    both = collections.Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [(i, len(sets[i]), root(i), root(i) == i) for i in sets]


def contamination(docs: list[tuple[int, str]], items: list[tuple[int, str]], size: int = 10) -> list[tuple]:
    found = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found[tuple(w[k : k + n])].add(str(i))
    sizes, out = {len(k) for k in found}, []
    for i, t in docs:
        w, hit, ids = ALNUM.findall(lower(t or "")), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in found:
                    hit |= set(range(k, k + n))
                    ids |= found[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def shares(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Targets of sources by filling up, one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def best_rows(rows: list[tuple[int | None, list | None]], k: int = 5) -> list[tuple]:
    """query_id, rank, vec_id, score; rows must not repeat."""
    fine = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, q in fine:
        if i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def collocations(rows: list[tuple[str | None, str | None]], longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> list[tuple]:
    found, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    found["und" if lang is None else lang, tuple(words[k : k + n])] += 1
    many = {p: a for p, a in found.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), f in many.items():
        for n in range(2, len(p)):
            gone |= {(lang, p[k : k + n]) for k in range(len(p) - n + 1) if 100 * f >= covered * found[lang, p[k : k + n]]}
    ranked = collections.defaultdict(list)
    for (lang, p), a in many.items():
        if (lang, p) not in gone:
            cut = min((1_000_000 * a * a // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
            l, r = found[lang, p[: cut[1]]], found[lang, p[cut[1] :]]
            ranked[lang].append((-cut[0], -a, " ".join(p).encode(), l, r))
    return [
        (lang, place + 1, p.decode(), -a, l, r, totals[lang], -s)
        for lang, own in ranked.items() for place, (s, a, p, l, r) in enumerate(sorted(own)[:top])
    ]


def planted_words(doc_id: int | None, text: str | None) -> list[str]:
    words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def runs(w: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """start, length, period, period by period."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(q % d == 0 and w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_digest(doc_id: int | None, words: list[str]) -> tuple:
    found = runs(words)
    gone = {k for s, z, q in found for k in range(s + q, s + z)}
    best = max(found, key=lambda r: (fractions.Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{z},{q}\n" for s, z, q in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(kept)
