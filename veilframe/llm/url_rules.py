"""URL rules as nested intervals of reversed-host keys, met by a sort-merge range join.

The canonical key of a rule is its host with the labels reversed, `#`, and its path: `www.example.com/en/` becomes
`com.example.www#/en/`. No host and no path begins with what the sign stands before, so a rule fits a key exactly if
it is a beginning of it: rules are intervals of the key order, and any two of them are nested or apart. A URL has one
key per number of labels that rules have: as `a.example.com` it is judged, as `example.com`, and as `com`.
"""

from __future__ import annotations

from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import column, free_name
from veilframe.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"://([^/?#]*)([^?#]*)"
#: Stands between host and path in a key; no host holds it.
_SIGN = "#"


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case. Null or no `://`: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _AFTER, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end. Null or no `://`: empty."""
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def _labels(host: Column) -> Column:
    """Labels of a host, the last first; an empty host has none."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.")))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(_SIGN), path)


def rule_intervals(rules: DataFrame) -> DataFrame:
    """`(host, path, verdict)` as one row per key: `(key, labels, rule, verdict, weight)`.

    A rule without host or verdict is none, a missing path is empty, an empty host fits every host. Of rules with one
    host and path, `block` wins.
    """
    host, path = F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    rows = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(host.alias("host"), path.alias("path"), "verdict")
    one = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    labels = _labels(F.col("host"))
    return one.select(
        _key(labels, F.col("path")).alias("key"), F.size(labels).alias("labels"), F.length("path").alias("path_length"),
        F.concat("host", "path").alias("rule"), "verdict", F.length(F.concat("host", "path")).alias("weight"),
    )


def _sweep(batches):
    """Points of one range of keys, in order, each with the innermost rule that is open where it lies.

    Rules open before the range began are not seen here. A point below no seen rule asks for them with `open`: what its
    key has in common with the first key of the range, since only a rule that is a beginning of both can be open. If
    that does not reach into a path, no rule is.
    """
    first, stack = None, []
    for batch in batches:
        rows, rules, opens = [], [], []
        keys, numbers, seen = (batch.column(i).to_pylist() for i in range(3))
        for key, number, rule in zip(keys, numbers, seen, strict=True):
            if first is None:
                first = key
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((key, rule))
            elif stack:
                rows.append(number)
                rules.append(stack[-1][1])
                opens.append(None)
            elif _SIGN in (common := commonprefix((first, key))):
                rows.append(number)
                rules.append(None)
                opens.append(common)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(rules, _RULE), pa.array(opens, pa.string())], ["row", "rule", "open"]
        )


_RULE = pa.struct([("weight", pa.int32()), ("labels", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])
_RULE_SQL = "struct<weight: int, labels: int, rule: string, verdict: string>"


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, `carry` columns, host, path, rule (null: none fits) and verdict (else `default`).

    A rule fits its host and all subdomains if the URL's path starts with its path. The longest fitting rule (host and
    path together, then the longer host) wins. Repeated rows, missing ids and missing URLs are judged like others.

    Rules and keys are sorted together by ranges of keys and swept once; the memory of a task is the stack of rules
    nested at one key. A frequent key is dealt over several ranges by its row. What was open before a range began
    is looked up once per distinct question, of which a range has at most as many as its first key has characters. Of a
    path, as many characters take part as the longest rule path has, since no rule can tell more apart.
    """
    host, path, rule_name, verdict = (free_name([id_column, *carry], n) for n in ("host", "path", "rule", "verdict"))
    intervals = stage(rule_intervals(rules), "url-rules")
    bounds = intervals.agg(F.max("path_length").alias("longest"), F.collect_set("labels").alias("depths")).first()
    rows = stage(
        pages.select(
            F.monotonically_increasing_id().alias("row"), column(id_column).alias("id"),
            *[column(c).alias(f"c_{i}") for i, c in enumerate(carry)],
            url_host(column(url_column)).alias("host"), url_path(column(url_column)).alias("path"),
        ),
        "urls",
    )
    labels = _labels(F.col("host"))
    depths = F.filter(F.array(*[F.lit(d) for d in sorted(bounds.depths)]).cast("array<int>"), lambda d: d <= F.size("labels"))
    points = rows.select("row", labels.alias("labels"), F.substring("path", 1, bounds.longest or 0).alias("cut")).select(
        "row", "labels", "cut", F.explode(depths).alias("depth")
    )
    asked = points.select(
        _key(F.slice("labels", 1, F.col("depth")), F.col("cut")).alias("key"), "row", F.lit(None).cast(_RULE_SQL).alias("rule"),
    )
    told = intervals.select("key", F.lit(None).cast("long").alias("row"), F.struct("weight", "labels", "rule", "verdict").alias("rule"))
    events = told.unionAll(asked).withColumn("spread", F.when(F.col("row").isNotNull(), F.xxhash64("row")))
    order = ["key", F.col("spread").asc_nulls_first()]
    swept = events.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "row", "rule")
    found = stage(swept.mapInArrow(_sweep, f"row long, rule {_RULE_SQL}, open string"), "url-sweep")

    # Rules that were open before a range began: the longest that is a beginning of what its points ask with.
    opens = found.where("open IS NOT NULL").select("open").distinct()
    signs = F.sequence(F.instr("open", _SIGN), F.length("open"))
    begun = opens.select("open", F.explode(signs).alias("n")).select("open", F.substring("open", F.lit(1), F.col("n")).alias("key"))
    answers = begun.join(intervals, "key").groupBy("open").agg(
        F.max(F.struct("weight", "labels", "rule", "verdict")).alias("rule")
    )
    late = found.where("open IS NOT NULL").select("row", "open").join(answers, "open").select("row", "rule")
    best = found.where("rule IS NOT NULL").select("row", "rule").unionAll(late).groupBy("row").agg(F.max("rule").alias("rule"))
    return rows.join(best, "row", "left").select(
        F.col("id").alias(id_column), *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)],
        F.col("host").alias(host), F.col("path").alias(path),
        F.col("rule.rule").alias(rule_name), F.coalesce("rule.verdict", F.lit(default)).alias(verdict),
    )
