"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import defaultdict


def roots(ids: list, links: list[tuple]) -> dict:
    """id -> smallest id reachable."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def shingles(text: str | None, size: int = 5) -> list[str]:
    upper = {chr(c): chr(c + 32) for c in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(upper.get(c, c) for c in text or ""))
    if len(words) < size:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def jaccard_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """id -> (set size, component)."""
    sets = {i: set(shingles(t)) for i, t in docs}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    found = roots(list(sets), links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def cosine_links(vectors: list[tuple[int, list | None]], least: float) -> dict[int, tuple[int, int]]:
    """id -> (links, component)."""

    def usable(v: list | None) -> bool:
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [(i, v) for i, v in vectors if usable(v)]
    links = [
        (a, b) for a, v in ok for b, w in ok
        if a < b and len(v) == len(w)
        and sum(x * y for x, y in zip(v, w)) / math.sqrt(sum(x * x for x in v) * sum(y * y for y in w)) >= least
    ]
    found, count = roots([i for i, _ in vectors], links), defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], found[i]) for i, _ in vectors}


def repeated_documents(docs: list[tuple[int, str]], width: int = 46) -> set[int]:
    """Documents with a run of ``width`` shingles that one with a smaller id has too."""
    first: dict[tuple, int] = {}
    out = set()
    for i, text in sorted(docs):
        own = shingles(text)
        for k in range(len(own) - width + 1):
            if first.setdefault(tuple(own[k : k + width]), i) != i:
                out.add(i)
    return out


def common_subsequences(a: str, b: str, order: int, decay: float) -> float:
    """The kernel of two words straight from its definition."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), order):
        for j in combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[-1] - i[0] - order + 1 + j[-1] - j[0] - order + 1)
    return total
