"""Allow and block rules for urls in one trie: host labels from the right, then path segments from the left."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameclinic.llm.common import tidy

#: Rules that may be broadcast; more would need another place than each task's memory.
MOST_RULES = 2_000_000


class RuleTrie:
    """Longest match among (host, path, verdict) rules.

    A rule covers its host and all subdomains, and the urls whose path starts with its path. Of several that fit,
    the one with the most host labels wins, then the one with the longest path; of equal rules the last one counts.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        # Nodes are numbers and the tables are flat: the trie is broadcast built, and reaches any depth.
        self.nodes = 1
        self.children: dict[tuple[int, str], int] = {}  # by host label, or by path segment
        self.paths: dict[int, int] = {}  # where the paths of a host begin
        self.ends: dict[tuple[int, str], tuple[str, str]] = {}  # what the next segment may start with
        self.longest: dict[int, int] = {}
        for host, path, verdict in rules:
            node = 0
            for label in reversed(host.split(".")) if host else ():
                node = self._child(self.children, (node, label))
            *whole, last = path.split("/")
            step = self._child(self.paths, node)
            for segment in whole:
                step = self._child(self.children, (step, segment))
            self.ends[step, last] = (host + path, verdict)
            self.longest[step] = max(len(last), self.longest.get(step, 0))

    def _child(self, table: dict, key) -> int:
        if key not in table:
            table[key] = self.nodes
            self.nodes += 1
        return table[key]

    def _by_path(self, step: int, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            for size in range(min(len(segment), self.longest.get(step, -1)), -1, -1):
                if (step, segment[:size]) in self.ends:
                    best = self.ends[step, segment[:size]]
                    break
            step = self.children.get((step, segment))
            if step is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule, None if none fits."""
        fits, node = None, 0
        for label in (None, *reversed(host.split("."))) if host else (None,):
            if label is not None:
                node = self.children.get((node, label))
                if node is None:
                    break
            if node in self.paths:
                fits = self._by_path(self.paths[node], path) or fits
        return fits


_UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A to Z lower-cased) and path; both empty without ``://`` or for null."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", keep: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """``keep`` and host, path, rule (null if none fits), verdict (``default`` then) for every row of ``pages`` (url).

    Null and odd urls have an empty host and path, which only rules for the empty host can fit. Repeated rows are
    judged alike; only the url and the kept columns are read.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shared = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: RuleTrie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column("__url").to_pylist()]
            found = [trie.match(*p) or (None, default) for p in parts]
            new = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(c, pa.string()) for c in new],
                names=[*keep, "host", "path", "rule", "verdict"],
            )

    rows = pages.select(*keep, pages["url"].alias("__url"))
    fields = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    return rows.mapInArrow(tidy(run), T.StructType([*rows.select(*keep).schema.fields, *fields]))
