"""URL filters: a trie over reversed host labels and path segments, longest match first.

The entry with the most host labels wins, among those the one with the longest path; if the same
entry is both allowed and blocked, block wins. The trie is sent to the executors only while the
rules are at most `MAX_TRIE_BYTES` of text; beyond that, urls are joined with the rules on their
host suffixes and path prefixes, which gives the same verdicts.

Edge cases. A null url, or one without '://', has an empty host and path, which no rule fits. An
empty rule list leaves every url to the default. Repeated rows get equal results. Result columns replace input
columns of the same name. An empty table has an empty result; a url's length has no bound but its row's.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, table

MAX_TRIE_BYTES = 32 << 20
RESULT = ("host", "path", "rule", "verdict")
Rule = tuple[str, str, str]  # action, host, path


class UrlTrie:
    """Host labels from the last to the first, then path segments ('/' ends a segment).

    Nodes are numbers (0: the root) and edges one table, so the trie itself is what is broadcast.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.edges: dict[tuple[int, str], int] = {}
        self.entries: dict[int, tuple[str, str]] = {}
        self.tails: dict[int, list[tuple[str, tuple[str, str]]]] = {}  # rule paths that end inside a segment, longest first
        for action, host, path in rules:
            node = 0
            for label in reversed(host.split(".")):
                node = self._child(node, "." + label)
            node = self._child(node, "")  # from here on: the path
            *whole, tail = path.split("/")
            for segment in whole:
                node = self._child(node, segment + "/")
            entry = (host + path, action)
            if tail:
                old = self.tails.get(node, [])
                if action == "block" or tail not in dict(old):
                    self.tails[node] = sorted([t for t in old if t[0] != tail] + [(tail, entry)], key=lambda t: -len(t[0]))
            elif node not in self.entries or action == "block":
                self.entries[node] = entry

    def _child(self, node: int, label: str) -> int:
        return self.edges.setdefault((node, label), len(self.edges) + 1)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest match."""
        found, node = None, 0
        for label in reversed(host.split(".")):
            node = self.edges.get((node, "." + label))
            if node is None:
                break
            if (start := self.edges.get((node, ""))) is not None:
                found = self._path(start, path) or found
        return found

    def _path(self, node: int, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            best = self.entries.get(node, best)
            for tail, entry in self.tails.get(node, ()):
                if path.startswith(tail, at):
                    best = entry
                    break
            end = path.find("/", at)
            nxt = self.edges.get((node, path[at : end + 1])) if end >= 0 else None
            if nxt is None:
                return best
            node, at = nxt, end + 1


def split_url(pages: DataFrame) -> DataFrame:
    """`pages` plus host and path."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def _by_trie(pages: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            hits = [trie.find(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            rule = pa.array([h and h[0] for h in hits], pa.string())
            verdict = pa.array([h[1] if h else default for h in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    schema = T.StructType([*pages.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return pages.mapInArrow(run, schema)


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # at most one per path length
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substring("path", F.lit(1), n)))
    urls = pages.select("host", "path").distinct()
    keys = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).select("*", F.explode(prefixes).alias("rule_path"))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action")
    rank = F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"), (F.col("action") == "block").cast("int"))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank)
    hits = keys.join(known, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("hit"))
    return pages.join(hits, ["host", "path"], "left").select(
        *pages.columns, F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict")
    )


def filter_urls(pages: DataFrame, rules: DataFrame | Sequence[Rule], default: str = "allow", max_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """`pages` (with a url column) plus host, path, rule and verdict.

    `rules` is a list of (action, host, path) or a DataFrame with those columns.
    """
    spark = pages.sparkSession
    parts = split_url(pages.select(*[c for c in pages.columns if c not in RESULT]))
    if not isinstance(rules, DataFrame):
        if sum(len(h) + len(p) for _, h, p in rules) <= max_bytes:
            return _by_trie(parts, rules, default)
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    size = rules.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    if size <= max_bytes:
        return _by_trie(parts, [(r["action"], r["host"], r["path"]) for r in rules.collect()], default)
    return _by_join(parts, rules, default)


RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op9_url_filters(spark, sf_dir):
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (
  SELECT page_id, r,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(action, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hit AS (
  SELECT r, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
         arg_max(action, length(rhost) * 1000 + length(rpath)) AS action
  FROM p JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN hit USING (r)
"""
