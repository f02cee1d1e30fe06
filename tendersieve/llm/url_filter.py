"""URL filters: a trie over reversed host labels, and below each host over path segments.

Hosts and paths are cut out in the JVM; tasks walk a broadcast trie whose size is that of the
rules (at most ``MOST_RULES``; more are refused), not of the data. A rule fits its host and all
subdomains if the url's path starts with the rule's. The longest fitting rule wins: the one with
more host labels, then the longer path; the last of equal rules counts.

Defined cases: a null url or one without ``://`` has an empty host and path, fits only rules for
every host, and gets the default verdict; ties and repeated rows are judged alike; an empty table
gives an empty result; extra columns are passed through, those named like a result replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

#: (verdict, host, path)
Rule = tuple[str, str, str]
MOST_RULES = 1_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to ``/ ? #`` with A-Z lower-cased, path up to ``? #``."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(u, r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts of host labels from the last to the first; key "/" holds a host's trie of path segments.

    In a path trie, key "" holds (segment beginning, verdict, rule) of the rules that end at this depth.
    """
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        node.setdefault("", {})[last] = (verdict, host + path)
    return root


def _in_path(node: dict, path: str) -> tuple[str, str] | None:
    """The rule with the longest beginning of ``path``."""
    found = None
    segments = path.split("/")
    for depth, segment in enumerate(segments):
        ends = node.get("")
        if ends:
            most = max((b for b in ends if segment.startswith(b)), key=len, default=None)
            if most is not None:
                found = ends[most]
        if depth + 1 == len(segments):
            break
        node = node.get("/" + segment)
        if node is None:
            break
    return found


def look_up(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits, or None."""
    node, found = root, _in_path(root.get("/", {}), path)
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        found = _in_path(node.get("/", {}), path) or found
    return found


def filter_urls(pages: DataFrame, rules: Iterable[Rule], url: str = "url", *, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (the rule's, else ``default``)."""
    rules = list(rules)
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast and holds at most {MOST_RULES}")
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            found = [look_up(root, h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r for _, r in found], "verdict": [v for v, _ in found]})

    host, path = url_parts(F.col(f"`{url}`").cast("string"))
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict") or c == url]
    found = free_name([*pages.columns, "host", "path"], "found")
    parts = pages.select(*rest, host.alias("host"), path.alias("path"))
    judged = parts.withColumn(found, judge("host", "path"))
    return judged.select("*", f"{found}.rule", f"{found}.verdict").drop(found)
