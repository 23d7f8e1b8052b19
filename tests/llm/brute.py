"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow.dataset as ds

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(name: str, sf: str = SF) -> list[dict]:
    return ds.dataset(f"{sf}/{name}.parquet").to_table().to_pylist()


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def targets(sizes: dict, weights: dict, epochs: int) -> dict:
    budget, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        left, total = budget - sum(clamped.values()), sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * left > epochs * sizes[s] * total]
        if not over:
            return clamped | {s: weights[s] * left / total for s in free}
        clamped |= {s: epochs * sizes[s] for s in over}


def repeat_words(w: list[str], n: int = 8) -> int:
    windows = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    many = Counter(windows)
    covered = set()
    for i, x in enumerate(windows):
        if many[x] > 1:
            covered.update(range(i, i + n))
    return len(covered)


def dup_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text, True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(docs: list[tuple], n: int, percent: int = 80) -> dict:
    """Smallest id reachable, by comparing every pair."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def repeated_bytes(texts: list[bytes], n: int) -> list[list[tuple[int, int]]]:
    """Maximal runs of bytes that lie in an n-byte string found at two places."""
    places = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            places[t[i : i + n]].append((k, i))
    covered = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                covered[k].update(range(i, i + n))
    out = []
    for c in covered:
        runs: list[list[int]] = []
        for i in sorted(c):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        out.append([tuple(r) for r in runs])
    return out
