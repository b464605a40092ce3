"""URL allow and block lists, judged by a broadcast trie.

The trie's upper part is keyed by host labels from the right, its lower part by
path segments; the walk remembers the deepest rule it passes.  Where rules stand
in a table too large to broadcast, the same trie nodes are keys of a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.session import ship_functions

ship_functions(__name__)

#: Characters of all rules up to which the trie is broadcast.
TRIE_CHARS = 16_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#`; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


class Trie:
    """Rules by reversed host labels, then path segments.

    A host node is `[children, path root]`; a path node is `[children, rests]`,
    where `rests` maps the begun last segment of a rule to (rule, verdict).
    Rules without any path lie under the rest `None` of the root.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, None]
        for rule, verdict in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            node = node[1]
            *whole, rest = path.split("/")[1:] if path else [None]
            for segment in whole:
                node = node[0].setdefault(segment, [{}, {}])
            known = node[1].get(rest)
            if known is None or verdict == "block":
                node[1][rest] = (rule, verdict)

    @staticmethod
    def _in_path(node: list, path: str) -> tuple[str, str] | None:
        found = node[1].get(None)
        if not path:
            return found
        for segment in path.split("/")[1:]:
            rests = node[1]
            if rests:
                best = max((r for r in rests if r is not None and segment.startswith(r)), key=len, default=None)
                if best is not None:
                    found = rests[best]
            node = node[0].get(segment)
            if node is None:
                return found
        return found

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule of the longest host that fits, and there of the longest path."""
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                found = self._in_path(node[1], path) or found
        return found


def _by_trie(df: DataFrame, host: Column, path: Column, rules: list[tuple[str, str]]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for hosts, paths in parts:
            found = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return df.withColumn("_kw_found", judge(host, path))


def _by_join(df: DataFrame, host: Column, path: Column, rules: DataFrame) -> DataFrame:
    """Every URL meets the rules at its own trie nodes: (host suffix, whole segments before the rest)."""
    cut = F.instr("rule", "/")
    rule_path = F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("")
    rules = rules.select("rule", "verdict", F.lower(F.substring_index("rule", "/", 1)).alias("_kw_h"), rule_path.alias("_kw_p"))
    rules = rules.groupBy("_kw_h", "_kw_p").agg(F.max_by(F.struct("rule", "verdict"), F.struct(
        F.col("verdict") == "block", "rule")).alias("_kw_r")).withColumn(
        "_kw_d", F.regexp_extract("_kw_p", r"(?s)^(.*/)", 1))
    urls = df.select(host.alias("_kw_host"), path.alias("_kw_path")).distinct()
    named = urls.withColumn("_kw_l", F.split("_kw_host", r"\.", -1)).withColumn("_kw_s", F.split("_kw_path", "/", -1))
    named = named.select("_kw_host", "_kw_path", "_kw_s", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("_kw_l")), lambda i: F.array_join(F.slice("_kw_l", i, F.size("_kw_l")), "."))).alias("_kw_h"))
    named = named.select("_kw_host", "_kw_path", "_kw_h", F.explode(F.when(F.size("_kw_s") < 2, F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size("_kw_s") - 1), lambda i: F.concat(
            F.array_join(F.slice("_kw_s", F.lit(1), i), "/"), F.lit("/")))))).alias("_kw_d"))
    found = named.join(rules, ["_kw_h", "_kw_d"]).where(F.expr("startswith(_kw_path, _kw_p)")).groupBy("_kw_host", "_kw_path").agg(
        F.max_by("_kw_r", F.struct(F.length("_kw_h"), F.length("_kw_p"))).alias("_kw_found"))
    left = df.withColumn("_kw_host", host).withColumn("_kw_path", path)
    return left.join(found, ["_kw_host", "_kw_path"], "left").drop("_kw_host", "_kw_path")


def judge_urls(df: DataFrame, rules: list[tuple[str, str]] | DataFrame, url: str = "url",
               default: str = "allow", trie_chars: int = TRIE_CHARS) -> DataFrame:
    """`df` with host, path, rule and verdict of each URL.

    `rules` are (rule, verdict) pairs, or a DataFrame of these two columns;
    `com/fr/` fits the host `com` with all subdomains, where the path starts
    with `/fr/`.  The rule of the longest host wins, there that of the longest
    path; between equal ones `block`.  Where none fits, rule is null and the
    verdict `default`.  A null URL, an empty one or one without `://` has empty
    host and path.  Columns of `df` named like the four new ones are replaced;
    repeated rows stay; an empty table gives an empty one.

    The trie is broadcast up to `trie_chars` characters of rules; larger lists
    meet the URLs in a shuffle join on trie nodes.
    """
    df = df.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else df
    host, path = host_of(F.col(url)), path_of(F.col(url))
    if isinstance(rules, DataFrame):
        rules = rules.select("rule", "verdict").where("rule IS NOT NULL AND verdict IS NOT NULL")
        size = rules.agg(F.sum(F.length("rule") + F.lit(8))).head()[0] or 0
        if size <= trie_chars:
            rules = [tuple(r) for r in rules.collect()]
    elif sum(len(r) + 8 for r, _ in rules) > trie_chars:
        rules = df.sparkSession.createDataFrame(rules, "rule string, verdict string")
    judged = (_by_join if isinstance(rules, DataFrame) else _by_trie)(df, host, path, rules)
    return judged.select(
        *df.columns, host.alias("host"), path.alias("path"), F.col("_kw_found.rule").alias("rule"),
        F.coalesce(F.col("_kw_found.verdict"), F.lit(default)).alias("verdict"))
