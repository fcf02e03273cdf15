"""URL rules by a sort-merge range join.

A host becomes a key of its labels in reverse, each ended by a NUL, so a rule's
host and all its subdomains are one interval of keys. URLs and rules are split at
sampled keys; a rule goes to every part its interval meets, which for a part is the
chain of hosts around its first key plus what begins inside it. Each part is sorted
and swept once with a stack of the hosts whose interval is open. Paths are intervals in
the same way: a url is behind the rules of its host whose path it begins with, so of
each open host a table of its paths answers for the few lengths that its rules have.
Of the rules that fit, the longest wins.
"""

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import LOWER, UPPER, partitions

#: Keys sampled for a part; the driver gets so many at most.
SAMPLE_PER_PART = 40


def host_and_path(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for null."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host):
    """Labels in reverse, each ended by NUL."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\0"), F.lit("\0"))


def _key(host: str) -> str:
    return "\0".join(reversed(host.split("."))) + "\0"


class _Paths:
    """The rules of one host by path: the longest that a url's path begins with, in one look per length that rules have."""

    def __init__(self) -> None:
        self.actions, self.lengths = {}, []

    def add(self, path: str, action: str) -> None:
        """Rules come by length, shortest first; of two for one path block comes last and stays."""
        if path not in self.actions and (not self.lengths or self.lengths[-1] != len(path)):
            self.lengths.append(len(path))
        self.actions[path] = action

    def longest(self, path: str) -> str | None:
        at = bisect.bisect_right(self.lengths, len(path))
        return next((path[:n] for n in reversed(self.lengths[:at]) if path[:n] in self.actions), None)


def _sweep(default: str):
    def sweep(batches):
        part, stack = None, []  # of (key, host, its paths)
        for batch in batches:
            out = [[] for _ in range(5)]
            for p, key, host, path, action, row in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "host", "path", "action", "row"))):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if action is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, _Paths()))
                    stack[-1][2].add(path, action)
                    continue
                # hosts on the stack grow, so of equal lengths the later one has the longer host
                best = None
                for _, suffix, paths in stack:
                    found = paths.longest(path)
                    if found is not None and (best is None or len(suffix) + len(found) >= len(best[0])):
                        best = (suffix + found, paths.actions[found])
                for column, value in zip(out, (row["id"], host, path, best and best[0], best[1] if best else default)):
                    column.append(value)
            kinds = [batch.schema.field("row").type.field("id").type] + [pa.string()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "host", "path", "rule", "verdict"])

    return sweep


def url_rules(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per url: id, host, path, rule (host and path of the rule that won, else null), verdict.

    ``rules`` has columns host, path, action (allow or block). A rule fits its host and
    all subdomains of it when the url's path begins with the rule's. The longest wins:
    most characters of host and path together, then the longer host, then block over
    allow. Without a rule the verdict is ``default``. A null url, or one without
    ``://``, has an empty host and path, which no rule fits; repeated rows are judged
    each; an empty table of rules or urls is fine; other columns are ignored.
    """
    spark = df.sparkSession
    host, path = host_and_path(url_col)
    urls = df.select(F.struct(F.col(id_col).alias("id")).alias("row"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "action").filter("host IS NOT NULL AND action IS NOT NULL")
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").distinct().withColumn("key", host_key(F.col("host")))
    parts = partitions(spark)
    # splitters from a sample of bounded size; they decide on a row's part only, never on its verdict
    spotted = urls.withColumn("spot", F.monotonically_increasing_id())
    share = min(1.0, SAMPLE_PER_PART * parts / max(urls.count(), 1))
    sample = sorted((r["key"], r["spot"]) for r in spotted.select("key", "spot").sample(share, 7).collect())
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    def part_of(batches):
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("spot").to_pylist()))
            parts = pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], [*batch.schema.names, "part"])

    def parts_of(batches):
        for batch in batches:
            firsts, lasts = [], []
            for key in batch.column("key").to_pylist():
                firsts.append(bisect.bisect_left(cuts, (key,)))
                lasts.append(bisect.bisect_left(cuts, (key[:-1] + "\1",)))
            lists = pa.array([list(range(a, b + 1)) for a, b in zip(firsts, lasts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "parts"])

    def typed(frame, extra):
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + extra

    left = spotted.mapInArrow(part_of, typed(spotted, ", part int")).withColumn("action", F.lit(None).cast("string"))
    right = rules.mapInArrow(parts_of, typed(rules, ", parts array<int>")).select(
        "host", "path", "action", "key", F.explode("parts").alias("part"),
        F.lit(None).cast(urls.schema["row"].dataType).alias("row"), F.lit(None).cast("bigint").alias("spot"),
    )
    both = left.unionByName(right).repartition(parts, "part").sortWithinPartitions(
        "part", "key", F.col("action").isNull(), F.length("path"), "path", "action", "spot"
    )
    kind = urls.schema["row"].dataType["id"].dataType.simpleString()
    judged = both.select("part", "key", "host", "path", "action", "row").mapInArrow(
        _sweep(default), f"id {kind}, host string, path string, rule string, verdict string"
    )
    return judged.withColumnRenamed("id", id_col)
