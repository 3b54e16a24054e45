"""URL filter: a trie over reversed host labels and path segments, longest match wins.

The rules are a bounded parameter (``MAX_RULES``); they are compiled into one trie and broadcast.  Every url
walks the trie from its top-level domain inwards, and from each host node down the path segments; among all
rules met on the way the longest (host and path together) decides, on a tie the one with most host labels.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the default
verdict.  Repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The trie is broadcast, so the number of rules is bounded.
MAX_RULES = 1_000_000
HOST_AND_PATH = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
LOWER = {c: c + 32 for c in range(65, 91)}

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# A host node: [children by label, path node or None].  A path node: [children by whole segment,
# the rules that end in the next segment, by the piece it must begin with].


class UrlTrie:
    """``match(host, path)`` gives (rule text, verdict) of the longest rule that fits, or None.

    A rule's path is cut at its slashes: all but the last piece must equal whole segments of the url, and the
    last piece (empty for a path that ends in a slash) must begin the next one.  On equal rules the last wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        self.longest = 0
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} url rules; the trie is broadcast and must stay bounded")
            node = self.root
            for label in reversed(host.lower().split(".") if host else []):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            *whole, last = path.split("/")
            at = node[1]
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            self.longest = max(self.longest, len(last))
            at[1][last] = (f"{host}{path}", verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        segments = path.split("/")
        node, best = self.root, None
        labels = host.split(".") if host else []
        while True:
            found = self._path(node[1], segments) if node[1] is not None else None
            if found and (best is None or len(found[0]) >= len(best[0])):  # later ones have more labels
                best = found
            if not labels:
                return best
            node = node[0].get(labels.pop())
            if node is None:
                return best

    def _path(self, at: list, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            ends = at[1]
            if ends:
                for k in range(min(len(segment), self.longest) + 1):  # a longer piece is a longer path
                    best = ends.get(segment[:k], best)
            at = at[0].get(segment)
            if at is None:
                break
        return best


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    found = HOST_AND_PATH.search(url) if url else None
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def judge_urls(df: DataFrame, url: str | Column = "url", rules=RULES, default: str = "allow") -> Column:
    """A struct column (host, path, rule, verdict) for the urls of ``df``; ``default`` where no rule fits."""
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for urls in batches:
            out = []
            for u in urls:
                host, path = split_url(u)
                rule, verdict = match(host, path) or (None, default)
                out.append((host, path, rule, verdict))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    return judge(F.col(url) if isinstance(url, str) else url)


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (columns page_id and url are read)."""
    verdicts = pages.select("page_id", judge_urls(pages, "url", rules, default).alias("j"))
    return verdicts.select("page_id", "j.host", "j.path", "j.rule", "j.verdict")
