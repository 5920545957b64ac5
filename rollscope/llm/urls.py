"""URL filters as a sort-merge range join of reversed-host keys.

A host's labels in reverse, each with a dot after it, make a key that a rule's own key begins if the rule fits the host; with
the rule's path after the rule's host key, the same holds for paths. So a rule is an interval of keys, and intervals nest or
are apart. Urls and rules are cut into stretches of the sorted order, every rule is copied to each stretch that its interval
reaches into, and a sweep over each sorted stretch keeps the stack of the rules that are open. One such sweep finds the hosts
with rules over each url, a second one, over (host with rules, path), the longest path rule of each.

A stretch's borders come from a sample and decide nothing but balance. Equal keys that fill several stretches are dealt over
them, so a url or host of any weight is spread out. Nothing is broadcast but the borders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollscope.llm.common import bounded_batches, checkpointed

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The borders are chosen among about SAMPLED keys, and keys are cut to BORDER letters for them: a few MB for the driver.
SAMPLED = 20_000
BORDER = 200
_RULE = "n int, host_n int, rule string, verdict string"


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://` up to `/`, `?`, `#` or the end, lower-cased, and from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of the rules open at each point, shortest first, of rows sorted by (stretch, key, rules before points)."""
    at, stack = None, []
    for batch in batches:
        points, found = [], []
        columns = (batch.column(c).to_pylist() for c in ("_stretch", "_key", "_value", "_is_point"))
        for i, (stretch, key, value, is_point) in enumerate(zip(*columns, strict=True)):
            if stretch != at:
                at, stack = stretch, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if is_point:
                points.append(i)
                found.append([v for _, v in stack])
            else:
                stack.append((key, value))
        out = batch.take(pa.array(points, pa.int64())).drop_columns(["_stretch", "_key", "_value", "_is_point"])
        yield out.append_column("_open", pa.array(found, pa.list_(pa.string())))


def open_rules(points: DataFrame, rules: DataFrame) -> DataFrame:
    """`points` (`_key` and other columns), with `_open` for `_key`: the `_value`s of the rules (`_key`, `_value`) that begin it.

    Keys of rules are distinct. Rows of `points` that are equal in all columns come to one task.
    """
    spark = points.sparkSession
    bounded_batches(spark)
    stretches = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED / max(points.count(), 1))
    sample = points.select(F.substring("_key", 1, BORDER).alias("k")).sample(share, 7).limit(2 * SAMPLED)
    keys = sorted(r.k for r in sample.collect())
    borders = np.array([keys[len(keys) * i // stretches] for i in range(1, stretches)] if keys else [], dtype=object)
    last = chr(0x10FFFF) * BORDER  # after all keys that a shorter one begins

    @F.pandas_udf("array<int>")
    def reached(key: pd.Series, is_point: pd.Series) -> pd.Series:
        # A point may lie in any stretch between equal borders; a rule is needed wherever keys that it begins may lie.
        short = key.str.slice(0, BORDER)
        end = short.where(is_point | (key.str.len() > BORDER), short + last)
        low = np.searchsorted(borders, short.to_numpy(dtype=object), "left")
        high = np.searchsorted(borders, end.to_numpy(dtype=object), "right")
        return pd.Series([list(range(a, b + 1)) for a, b in zip(low, high, strict=True)], dtype=object)

    span = reached("_key", "_is_point")
    names = [c for c in points.columns if c != "_key"]
    dealt = points.withColumn("_is_point", F.lit(True)).withColumn("_span", span)
    spread = F.pmod(F.xxhash64("_key", *names), F.size("_span")).cast("int")
    dealt = dealt.withColumn("_stretch", F.get("_span", spread)).withColumn("_value", F.lit(None).cast("string")).drop("_span")
    copies = rules.select("_key", "_value").withColumn("_is_point", F.lit(False)).withColumn("_stretch", F.explode(span))
    both = dealt.unionByName(copies, allowMissingColumns=True)
    laid = both.repartitionById(stretches, F.col("_stretch")).sortWithinPartitions("_stretch", "_key", "_is_point")
    kinds = ", ".join(f"`{c}` {laid.schema[c].dataType.simpleString()}" for c in names)
    return laid.select(*names, "_stretch", "_key", "_value", "_is_point").mapInArrow(_sweep, f"{kinds}, _open array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    A rule (verdict, host, path) fits its host and all subdomains, where the url's path starts with its own. The rule with most
    letters in host and path together wins, of equally long ones that with the longer host, of equal ones `block`; without
    any, rule is null and the verdict is `default`. Null urls and such without `://` have empty hosts and paths. Rules with a
    null or impossible host or path fit nothing. Urls of any length are judged whole, repeated pages each, null page_ids are
    kept, an empty table gives no rows, other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.spark_partition_id().alias("_file"))
    # Repeated rows of one split of the input are judged once and given back as often as they came.
    key = ["page_id", "host", "path", "_file"]
    urls = checkpointed(urls.groupBy(*key).agg(F.count("*").alias("_copies")))
    possible = ~F.col("host").rlike("[/?#]") & F.col("path").rlike("^(/|$)")
    described = F.to_json(F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("host_n"), F.concat("host", "path").alias("rule"), "verdict"))
    rules = (
        rules.filter(possible).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(host_key(F.col("host")).alias("_host_key"), "path", described.alias("_value"))
    )
    hosts = rules.select(F.col("_host_key").alias("_key")).distinct().withColumn("_value", F.col("_key"))
    hosted = open_rules(urls.withColumn("_key", host_key(F.col("host"))), hosts)
    each = checkpointed(hosted.withColumn("_at", F.explode_outer("_open")).drop("_open"))
    under = each.filter("_at is not null").withColumn("_key", F.concat("_at", "path")).drop("_at")
    pathed = open_rules(under, rules.select(F.concat("_host_key", "path").alias("_key"), "_value"))
    # Of the rules of one host the last open one is the longest.
    found = pathed.select(*key, "_copies", F.from_json(F.element_at("_open", F.when(F.size("_open") > 0, -1)), _RULE).alias("_rule"))
    none = each.filter("_at is null").select(*key, "_copies", F.lit(None).cast(f"struct<{_RULE.replace(' ', ':').replace(',:', ',')}>").alias("_rule"))
    best = found.unionByName(none).groupBy(*key, "_copies").agg(F.max("_rule").alias("_rule"))
    judged = best.select("page_id", "host", "path", "_rule.rule", F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"), "_copies")
    return judged.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).drop("_copy", "_copies")


ORACLE = f"""
with cut as (select page_id, row_number() over () as k, coalesce(case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end, '') as rest from pages),
parts as (
  select page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), rules(verdict, rhost, rpath) as (values {", ".join(map(str, RULES))}),
fit as (
  select *, row_number() over (partition by k order by length(rhost) + length(rpath) desc, length(rhost) desc, verdict desc) as place
  from parts left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rhost || rpath as rule, coalesce(verdict, '{DEFAULT}') as verdict from fit where place = 1
"""
