"""Small single-machine versions of the clustering steps, written for checking only."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np


def tfidf(texts: list[str], min_df: int = 2) -> np.ndarray:
    counts = [Counter(re.findall(r"[^\W]{2,}", t.lower())) for t in texts]
    df = Counter(t for c in counts for t in c)
    terms = sorted(t for t, n in df.items() if n >= min_df)
    place = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(texts), len(terms)))
    for i, c in enumerate(counts):
        for t, n in c.items():
            if t in place:
                x[i, place[t]] = n * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)
    d2 = sq[:, None] + sq[None, :] - 2 * x @ x.T
    d2[d2 < 1e-12] = 0
    np.fill_diagonal(d2, 0)
    return np.round(np.sqrt(d2), 12)


def core(d: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(d) - 1)
    return np.sort(d, axis=1)[:, k]


def reachability(d: np.ndarray, k: int) -> np.ndarray:
    c = core(d, k)
    w = np.maximum(np.maximum(d, c[:, None]), c[None, :])
    return w


def mst(w: np.ndarray) -> list[tuple[float, int, int]]:
    """Kruskal in the order (weight, a, b)."""
    n = len(w)
    order = sorted((w[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for weight, a, b in order:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((weight, a, b))
    return out


def hdbscan(w: np.ndarray, m: int) -> np.ndarray:
    """Labels from a spanning tree, by merging upwards; numbered by size, then least member."""
    n = len(w)
    group = {i: ([i], None) for i in range(n)}  # root -> members, open cluster
    root = list(range(n))
    clusters: list[dict] = []

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    def start(kids: list[int]) -> int:
        clusters.append({"falls": [], "kids": kids, "parent": None, "birth": 0.0, "mass": 0.0, "size": 0})
        return len(clusters) - 1

    def fall(c: int, members: list[int], lam: float) -> None:
        clusters[c]["falls"] += members
        clusters[c]["mass"] += lam * len(members)
        clusters[c]["size"] += len(members)

    for weight, a, b in mst(w):
        lam = 1 / max(weight, 1e-12)
        x, y = find(a), find(b)
        (mx, cx), (my, cy) = group.pop(x), group.pop(y)
        if cx is not None and cy is not None:
            c = start([cx, cy])
            for kid, members in ((cx, mx), (cy, my)):
                clusters[kid]["parent"], clusters[kid]["birth"] = c, lam
                clusters[c]["mass"] += lam * len(members)
                clusters[c]["size"] += len(members)
        elif cx is not None:
            c = cx
            fall(c, my, lam)
        elif cy is not None:
            c = cy
            fall(c, mx, lam)
        elif len(mx) + len(my) >= m:
            c = start([])
            fall(c, mx + my, lam)
        else:
            c = None
        root[x] = y
        group[y] = (mx + my, c)

    worth = []
    for c in clusters:  # children come before parents
        inside = sum(clusters[k]["worth"] for k in c["kids"])
        own = c["mass"] - c["size"] * c["birth"]
        c["worth"] = max(own, inside)
        worth.append(c["parent"] is not None and own >= inside)
    labels = np.full(n, -1)
    chosen: dict[int, list[int]] = {}
    top: dict[int, int | None] = {}
    for i in reversed(range(len(clusters))):
        p = clusters[i]["parent"]
        above = top.get(p) if p is not None else None
        top[i] = above if above is not None else (i if worth[i] else None)
        if top[i] is not None:
            chosen.setdefault(top[i], []).extend(clusters[i]["falls"])
    for number, members in enumerate(sorted(chosen.values(), key=lambda v: (-len(v), min(v)))):
        labels[members] = number
    return labels
