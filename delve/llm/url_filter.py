"""URL rules in a trie over reversed host labels and path segments.

Each host label, from the top-level domain down, is a step; a node of the host trie holds a trie of
the path segments of the rules that end there. A lookup walks the host once and keeps, at each
node, the longest path rule that fits: the deepest host with a fitting rule wins, and under it the
longest path; of equal rules block precedes allow. The trie is broadcast. A list of over
TRIE_BYTES becomes several tries, broadcast one after the other; the best of their answers wins by the same order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release, temp_name

TRIE_BYTES = 64 << 20
Rule = tuple[str, str, str]  # verdict, host, path
_AUTHORITY = re.compile(r"[/?#]")
_QUERY = re.compile(r"[?#]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_rule(verdict: str, rule: str) -> Rule:
    """``example.org/en/`` as (verdict, host, path)."""
    host, slash, path = rule.partition("/")
    return verdict, host, slash + path


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lowered, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = _AUTHORITY.search(rest)
    host = rest[: end.start()] if end else rest
    return host.translate(_LOWER), _QUERY.split(rest[len(host) :], maxsplit=1)[0]


def build_trie(rules: Iterable[Rule]) -> dict:
    root: dict = {"labels": {}, "paths": None}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
        *whole, last = path.split("/")
        step = node["paths"] = node["paths"] or {"segments": {}, "ends": {}}
        for segment in whole:
            step = step["segments"].setdefault(segment, {"segments": {}, "ends": {}})
        if step["ends"].get(last, ("allow",))[0] == "allow":
            step["ends"][last] = (verdict, host + path)
    return root


def _longest(paths: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    step = paths
    for segment in segments:
        for k in range(len(segment), -1, -1):  # the rule's last segment may end inside the url's
            if segment[:k] in step["ends"]:
                best = step["ends"][segment[:k]]
                break
        step = step["segments"].get(segment)
        if step is None:
            break
    return best


def lookup(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest match, or none."""
    segments = path.split("/")
    best = _longest(trie["paths"], segments) if trie["paths"] else None
    node = trie
    for label in reversed(host.split(".")) if host else ():
        node = node["labels"].get(label)
        if node is None:
            break
        if node["paths"]:
            best = _longest(node["paths"], segments) or best
    return best


def _tries(rules: Iterable[Rule], limit: int) -> Iterator[dict]:
    """Tries of at most ``limit`` bytes of rules each (and a rule at least); one empty trie for no rules."""
    held, size = [], 0
    for rule in rules:
        weight = len(rule[1]) + len(rule[2]) + 16
        if held and size + weight > limit:
            yield build_trie(held)
            held, size = [], 0
        held.append(rule)
        size += weight
    yield build_trie(held)


def precedence(verdict: str, rule: str) -> tuple[int, int, bool]:
    """Order of rules that fit one url: by host labels, then by path, then block."""
    host, slash, path = rule.partition("/")
    return len(host.split(".")) if host else 0, len(slash + path), verdict == "block"


_JUDGED = "host string, path string, rule string, verdict string"


def _judge(trie, default: str):
    @F.pandas_udf(_JUDGED)
    def judge(urls: pd.Series, so_far: pd.DataFrame) -> pd.DataFrame:
        out = []
        for url, rule, verdict in zip(urls, so_far["rule"], so_far["verdict"], strict=True):
            host, path = split_url(url)
            best = lookup(trie.value, host, path)
            if isinstance(rule, str) and (best is None or precedence(verdict, rule) >= precedence(*best)):
                best = verdict, rule
            out.append((host, path, best[1] if best else None, best[0] if best else default))
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])

    return judge


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Host: from ``://`` to ``/ ? #`` or the end, A-Z lowered; path: from there to ``? #`` or the end. A
    rule fits its host and all subdomains if the url's path starts with the rule's.

    - A null url, or one without ``://``, has an empty host and path. Where no rule fits, ``rule``
      is null and the verdict ``default``.
    - Repeated rows each get their verdict; an empty table or rule list is allowed.
    - Columns of ``pages`` stay; should it have columns named like the new ones, the new ones replace them.
    """
    spark = pages.sparkSession
    added = ("host", "path", "rule", "verdict")
    stays = [c for c in pages.columns if c.lower() not in added or c == url_col]
    source = pages.select(*stays)
    name = temp_name(source, "judged")
    judged = source.withColumn(name, F.lit(None).cast("struct<host:string,path:string,rule:string,verdict:string>"))
    spent = []
    for k, one in enumerate(_tries(rules, trie_bytes)):
        if k:  # one trie in a worker's memory at a time
            judged = materialize(judged)
            spent.append(judged)
            release(*spent[:-1])
            del spent[:-1]
        judged = judged.withColumn(name, _judge(spark.sparkContext.broadcast(one), default)(F.col(url_col), F.col(name)))
    return judged.select(*stays, f"{name}.host", f"{name}.path", f"{name}.rule", f"{name}.verdict")
