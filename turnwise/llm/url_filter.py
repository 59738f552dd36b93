"""URL filter: a trie over reversed host labels and path segments, longest match first.

A rule is (action, host, path). It fits its host and all subdomains, if the URL's path starts
with the rule's path. Of the rules that fit, the one with the most host and path characters
wins; of equal ones the longer host, and of the same host and path 'block'. A URL that no
rule fits gets the default.

The trie is shipped to the tasks only while the rule table is within MAX_TRIE_RULES rows and
MAX_TRIE_BYTES of text, which the operator checks first; a larger table is joined on exploded
(host suffix, path prefix) keys instead, with the same results.

Defined results: a null URL, or one without '://', has an empty host and path, and no rule
fits it. Repeated rows are judged one by one. An empty table gives an empty result. Of the
input only the id and URL columns are used, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MAX_TRIE_RULES = 200_000
MAX_TRIE_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end; A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nodes are dicts: "h" host children by label, "p" path children by segment, "r" the rules that end here.

    A path is cut after each slash; a rule's last piece without a slash may end inside a URL's
    segment, so it is kept at its node under "t" and compared as a prefix.
    """
    root: dict = {}
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("h", {}).setdefault(label, {})
        pieces = path.split("/")
        for piece in pieces[:-1]:
            node = node.setdefault("p", {}).setdefault(piece, {})
        found = (len(host) + len(path), len(host), action == "block", host + path, action)
        if pieces[-1]:
            node.setdefault("t", []).append((pieces[-1], found))
        else:
            node.setdefault("r", []).append(found)
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the longest rule that fits, or None."""
    best = None
    pieces = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node.get("h", {}).get(label)
        if node is None:
            break
        under = node
        for i, piece in enumerate(pieces):
            found = list(under.get("r", ()))
            if "t" in under:
                rest = "/".join(pieces[i:])
                found += [rule for tail, rule in under["t"] if rest.startswith(tail)]
            for rule in found:
                if best is None or rule > best:
                    best = rule
            if i == len(pieces) - 1:
                break
            under = under.get("p", {}).get(piece)
            if under is None:
                break
    return best and (best[3], best[4])


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row of `pages`.

    rules: DataFrame of (action, host, path), action 'allow' or 'block'; null rules are ignored.
    """
    rules = rules.select("action", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("action IS NOT NULL AND host <> ''")
    u = F.col(f"`{url_col}`")
    urls = pages.select(F.col(f"`{id_col}`"), url_host(u).alias("host"), url_path(u).alias("path"))
    n, size = rules.limit(max_trie_rules + 1).agg(F.count("*"), F.sum(F.length("host") + F.length("path"))).first()
    if n <= max_trie_rules and (size or 0) <= MAX_TRIE_BYTES:
        return _by_trie(urls, [tuple(r) for r in rules.collect()], default)
    return _by_join(urls, rules, id_col, default)


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [match(trie.value, h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule = pa.array([h and h[0] for h in hits], pa.string())
            verdict = pa.array([h[1] if h else default for h in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    kind = urls.schema[0].dataType.simpleString()
    return urls.mapInArrow(judge, f"`{urls.columns[0]}` {kind}, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same by an equi-join: distinct (host, path) pairs meet the rules of each host suffix."""
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    prefixes = F.expr("transform(sequence(0, length(path)), i -> substring(path, 1, i))")
    pairs = urls.select("host", "path").where("host <> ''").distinct()
    keys = pairs.withColumn("rule_host", F.explode(suffixes)).withColumn("rule_path", F.explode(prefixes))
    ranked = rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).withColumn("rank", F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("action") == "block"))
    best = keys.join(ranked, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), "rank").alias("best"))
    return urls.join(best, ["host", "path"], "left").select(f"`{id_col}`", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
