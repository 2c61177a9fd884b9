"""URL verdicts by a trie over reversed host labels and path segments.

Rules are (verdict, host, path). A rule fits its host and all subdomains where the path of the URL
starts with its path; of the rules that fit, the longest decides: more host labels first, then the
longer path. Rules are compiled into one trie: from the root along the labels of the host, last
label first, then along the segments of the path. A look-up walks down once and keeps, for each
host node on the way, the deepest path node with a rule.

The trie is broadcast while the rules number at most `broadcast_rules`; beyond that the same
precedence is had by an equi-join of the URLs' host suffixes and path prefixes with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _batches

#: At some 200 bytes a rule, a broadcast of about 100 MB at most.
BROADCAST_RULES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _PATH, _RULE = 0, 1, 2


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with host and path: JVM expressions only; both empty without '://'."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substr({url_col}, instr({url_col}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def refuse_malformed(rules: Sequence[tuple[str, str, str]]) -> None:
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or not path.startswith("/"):
            raise ValueError(f"not a rule: {(verdict, host, path)}")


class Trie:
    """Nodes are [host children, path children, rule]; a rule is (text, verdict)."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: list = [{}, None, None]
        refuse_malformed(rules)
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(str.maketrans(UPPER, LOWER)).split(".")):
                node = node[_HOST].setdefault(label, [{}, None, None])
            # The path's pieces end at its slashes; what follows the last one may end inside a segment.
            *whole, tail = path.split("/")[1:]
            if node[_PATH] is None:
                node[_PATH] = [{}, {}, None]
            node = node[_PATH]
            for segment in whole:
                node = node[_HOST].setdefault(segment, [{}, {}, None])
            text = host.translate(str.maketrans(UPPER, LOWER)) + path
            old = node[_PATH].get(tail)
            if old is None or old[1] == "allow":  # of equal rules, a block entry wins
                node[_PATH][tail] = (text, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node[_HOST].get(label)
            if node is None:
                break
            if node[_PATH] is not None and (found := self._along(node[_PATH], path)):
                best = found
        return best

    @staticmethod
    def _along(node: list, path: str) -> tuple[str, str] | None:
        best, at = None, 1
        if not path.startswith("/"):
            return None
        while node is not None:
            rest = path[at:]
            fits = [t for t in node[_PATH] if rest.startswith(t)]
            if fits:
                best = node[_PATH][max(fits, key=len)]
            stop = path.find("/", at)
            if stop < 0:
                break
            node, at = node[_HOST].get(path[at:stop]), stop + 1
        return best


def _judger(trie: Trie, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches.slices(batches, 8192):
            found = [trie.find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rule = pa.array([f[0] if f else None for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.record_batch([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; without a fitting rule, null and `default`.

    A null url, or one without '://', has an empty host and path and fits no rule. Null ids stay
    null, repeated rows are judged each, other columns are not read.
    """
    parts = with_parts(pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"))).select("page_id", "host", "path")
    if len(rules) > broadcast_rules:
        return _joined(parts, rules, default)
    return parts.mapInArrow(_judger(Trie(rules), default), "page_id bigint, host string, path string, rule string, verdict string")


def _joined(parts: DataFrame, rules: Sequence[tuple[str, str, str]], default: str) -> DataFrame:
    """The same verdicts by equi-joins, for rules that are too many to broadcast."""
    refuse_malformed(rules)
    table = parts.sparkSession.createDataFrame([(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string")
    table = table.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block wins
    lengths = table.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    # Distinct (host, path) pairs are matched once, so that a hot host costs its distinct paths.
    wanted = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = wanted.select("host").distinct().withColumn("rule_host", F.explode(suffixes)).join(lengths, "rule_host")
    tried = wanted.join(hosts, "host").withColumn("n", F.explode("lengths")).withColumn("rule_path", F.expr("substr(path, 1, n)")).filter(F.length("rule_path") == F.col("n"))
    fits = tried.join(table, ["rule_host", "rule_path"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule_host"), F.length("rule_path"), F.concat("rule_host", "rule_path"), "rule_verdict")).alias("best"))
    out = parts.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.col3").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
