"""URL filter: a broadcast trie over reversed host labels and path segments; the longest entry decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
#: Entries a trie may hold, as it is sent to every executor.
MOST_RULES = 1_000_000

HOST = r"^[\s\S]*?://([^/?#]*)"
PATH = r"^[\s\S]*?://[^/?#]*([^?#]*)"


class UrlTrie:
    """Nodes are dicts: labels of the host from the right, then whole path segments, then under ``None`` the beginnings
    of the last segment, and under ``0`` how long these are, longest first. Of entries for the same host and path the last one
    given stays."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        """rules: (verdict, host, path), the path with its leading slash or empty for any path."""
        self.root: dict = {}
        n = 0
        for verdict, host, path in rules:
            if verdict not in ("allow", "block") or not host or (path and path[0] != "/"):
                raise ValueError(f"not a rule: {verdict} {host}{path}")
            n += 1
            if n > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules; split them by host")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(("h", label), {})
            *whole, last = path[1:].split("/") if path else [None]
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            node.setdefault(None, {})[last] = (f"{host}{path}", verdict)
        nodes = [self.root]
        while nodes:
            node = nodes.pop()
            if ends := node.get(None):
                node[0] = sorted({len(x) for x in ends if x is not None}, reverse=True)
            nodes += [child for key, child in node.items() if isinstance(key, tuple)]

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest entry that fits: most host labels first, then the longest path. A segment is looked up
        once for each length that beginnings have there."""
        node, nodes = self.root, []
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            nodes.append(node)
        segments = path[1:].split("/") if path[:1] == "/" else []
        for node in reversed(nodes):
            best = node.get(None, {}).get(None)
            for segment in segments:
                ends = node.get(None, {})
                best = next((found for n in node.get(0, ()) if n <= len(segment) and (found := ends.get(segment[:n]))), best)
                node = node.get(("p", segment))
                if node is None:
                    break
            if best:
                return best
        return None


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the entry that decided (or null) and the verdict (``default`` where none fits).

    The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the
    path follows up to ``?``, ``#`` or the end. Both are cut out by built-in expressions, and only the short host and
    path go through the Arrow function; pages are never shuffled. The trie's size is bounded by MOST_RULES. A null url or
    one without ``://`` has an empty host and path, and no entry fits. Repeated rows are judged each.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, seen = trie.value.match, {}
        for batch in batches:
            found = []
            for key in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[key] = match(*key) or (None, default)
                found.append(seen[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), F.translate(F.regexp_extract(url, HOST, 1), upper, lower).alias("host"), F.regexp_extract(url, PATH, 1).alias("path"))
    return parts.mapInArrow(run, SCHEMA)
