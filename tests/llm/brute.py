"""Plain versions of the operators, pair by pair and word by word."""

from __future__ import annotations

import re
from itertools import combinations

from quarrylake.llm.textkit import WORD


def words(text: str | None) -> list[str]:
    return re.findall(WORD, (text or "").lower())


def local_score(item: list[str], text: list[str]) -> tuple[int, int]:
    """Best Smith-Waterman score and the first word at which it is reached."""
    best, end, above = 0, 0, [0] * (len(text) + 1)
    tops: dict[int, int] = {}
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, row[j] - 1))
            tops[j] = max(tops.get(j, 0), row[-1])
        above = row
    if tops:
        best = max(tops.values())
        end = min(j for j, s in tops.items() if s == best)
    return best, end


def contaminated(docs: list[tuple], items: list[tuple], least: float = 0.5) -> set[tuple]:
    out = []
    for d, t in docs:
        for i, x in items:
            w = words(x)
            if len(w) >= 3:
                s, e = local_score(w, words(t))
                if s / (2 * len(w)) >= least:
                    out.append((d, i, round(s / (2 * len(w)), 6), e))
    return sorted(out, key=str)


def edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def repeated_lines(docs: list[tuple], least: int = 20, most: int = 2) -> set[tuple]:
    """(doc_id, line, first_doc_id, first_line, edits); ids are different and not null."""
    places: dict[bytes, list[tuple]] = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for n, line in enumerate((t or "").split("\n")):
            if len(line.encode()) >= least:
                places.setdefault(line.encode(), []).append((d, n))
    order = sorted(places, key=lambda x: places[x][0])
    out = set()
    for k, b in enumerate(order):
        near = next(((a, e) for a in order[:k] if abs(len(a) - len(b)) <= most and (e := edits(a, b)) <= most), None)
        if near:
            out |= {(*p, *places[near[0]][0], near[1]) for p in places[b]}
        else:
            out |= {(*p, *places[b][0], 0) for p in places[b][1:]}
    return out


def without_lines(docs: list[tuple]) -> list[tuple]:
    gone = {(d, n) for d, n, *_ in repeated_lines(docs)}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for n, x in enumerate(lines) if (d, n) not in gone]
        if len(kept) == len(lines):
            out.append((d, t))
        elif "\n".join(kept).strip():
            out.append((d, "\n".join(kept)))
    return out


def repeats(text: str | None, n: int = 5) -> tuple[int, int, int]:
    """Words, covered words, longest repeat."""
    w = words(text)
    covered, longest = set(), 0
    for i, j in combinations(range(len(w)), 2):
        k = 0
        while j + k < len(w) and w[i + k] == w[j + k]:
            k += 1
        if k >= n:
            covered |= set(range(i, i + k)) | set(range(j, j + k))
            longest = max(longest, k)
    return len(w), len(covered), longest


def unrepetitive(docs: list[tuple]) -> list[tuple]:
    def ok(t):
        n, c, m = repeats(t)
        return c <= max(20, 0.6 * n) and m <= max(20, 0.25 * n)

    return [(d, t) for d, t in docs if ok(t)]


def grams(text: str | None, n: int = 3) -> frozenset:
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


def similar(docs: list[tuple], least: float = 0.5) -> set[tuple]:
    g = {d: grams(t) for d, t in docs}
    return {(a, b) for a, b in combinations(sorted(g), 2) if g[a] and g[b] and len(g[a] & g[b]) >= least * len(g[a] | g[b])}


def one_of_each(docs: list[tuple], least: float = 0.5) -> list[tuple]:
    head = {d: d for d, _ in docs}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in similar(docs, least):
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return [(d, t) for d, t in docs if find(d) == d]


def padding(lengths: list[int], bounds: list[int]) -> int:
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def least_padding(lengths: list[int], buckets: int) -> int:
    every = sorted(set(lengths))
    return min(padding(lengths, [*c, every[-1]]) for k in range(buckets) for c in combinations(every[:-1], k))
