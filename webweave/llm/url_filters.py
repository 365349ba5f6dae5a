"""URL rules in a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweave.llm.common import ascii_lower

#: The broadcast holds the rules' text only, and a rule set beyond this size is refused.
MAX_RULE_CHARS = 32_000_000


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``; an empty host is any host."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class _Paths:
    """Rules of one host: edges are whole path segments; ``tails`` start the segment that follows."""

    __slots__ = ("segments", "tails")

    def __init__(self) -> None:
        self.segments: dict[str, _Paths] = {}
        self.tails: dict[str, Rule] = {}

    def add(self, rule: Rule) -> None:
        *whole, tail = rule.path.split("/")
        node = self
        for segment in whole:
            node = node.segments.setdefault(segment, _Paths())
        held = node.tails.get(tail)
        if held is None or rule.verdict == "block":
            node.tails[tail] = rule

    def longest(self, path: str) -> Rule | None:
        node, best = self, None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            fitting = [tail for tail in node.tails if segment.startswith(tail)]
            if fitting:
                best = node.tails[max(fitting, key=len)]
            if i + 1 == len(segments) or (node := node.segments.get(segment)) is None:
                break
        return best


class Trie:
    """Hosts by label from the right; each node may hold the path rules of its host."""

    def __init__(self, rules: Iterable[Rule] = ()) -> None:
        self.labels: dict[str, Trie] = {}
        self.paths: _Paths | None = None
        for rule in rules:
            self._add(rule)

    def _add(self, rule: Rule) -> None:
        node = self
        for label in reversed(rule.host.split(".")) if rule.host else ():
            node = node.labels.setdefault(label, Trie())
        if node.paths is None:
            node.paths = _Paths()
        node.paths.add(rule)

    def longest(self, host: str, path: str) -> Rule | None:
        """The fitting rule with the longest host, and of those the one with the longest path."""
        node, best = self, self.paths and self.paths.longest(path)
        for label in reversed(host.split(".")):
            if (node := node.labels.get(label)) is None:
                break
            best = (node.paths and node.paths.longest(path)) or best
        return best


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``, repeated rows included.

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty.
    Where no rule fits, ``rule`` is null and the verdict is ``default``. Of two rules with the same
    host and path the blocking one holds. Null ids stay null. No row is shuffled: the trie is
    broadcast, and ``MAX_RULE_CHARS`` bounds it.
    """
    if sum(len(rule.name) for rule in rules) > MAX_RULE_CHARS:
        raise ValueError(f"rules of more than {MAX_RULE_CHARS} characters; join them as a table instead")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(Rule(*rule) for rule in rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.longest(host, path) for host, path in zip(hosts, paths)]
        return pd.DataFrame({
            "rule": [rule and rule.name for rule in found],
            "verdict": [rule.verdict if rule else default for rule in found],
        }, dtype=object)

    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    split = pages.select(
        F.col(id_col).alias("page_id"),
        ascii_lower(F.regexp_extract(url, parts, 1)).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )
    return split.withColumn("_found", look_up("host", "path")).select("page_id", "host", "path", "_found.rule", "_found.verdict")
