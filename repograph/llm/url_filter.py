"""Verdicts for addresses from nested host and path rules, by a sorted sweep.

A rule (host, path) fits its host and every subdomain, where the address's path starts with the
rule's path. With the path prefix in front and the host's labels reversed, `www.example.com` under
`/en/` becomes the key `4 /en/ NUL com.example.www.`: all addresses that a rule fits share the
rule's key as a prefix, so a rule is the interval of keys from its own to the next key that lacks
the prefix. Intervals nest. Rule starts, rule ends and addresses are sorted together; each start
or end carries the stack of rules that are open behind it, and an address takes the last stack
before it. The top of the stack is the longest host among the rules of that path length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.concat(F.format_string("%08d ", F.length(path)), path, F.lit("\0"), labels, F.lit("."))


def _events(rules: DataFrame) -> DataFrame:
    """Start and end of every rule, each with the stack (longest host first) open after it."""
    given = (rules.select("host", "path", "verdict").filter("host <> '' AND path IS NOT NULL")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    # The rules that enclose a rule stand under its own host's suffixes, with the same path.
    labels = F.split("host", r"\.")
    suffixes = given.select(
        F.col("host").alias("own"), "path",
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
            F.slice(labels, i, F.size(labels)), "."))).alias("depth", "host"))
    entry = F.struct((-F.col("depth")).alias("order"), F.length(F.concat("host", "path")).alias("n"),
                     F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict")
    stacks = (suffixes.join(given, ["host", "path"]).groupBy(F.col("own").alias("host"), "path")
              .agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack")))
    key = _key(F.col("host"), F.col("path"))
    start = F.struct(key.alias("key"), F.col("stack"))
    # "/" follows "." in byte order: the first key without the prefix.
    end = F.struct(F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/")).alias("key"),
                   F.slice("stack", F.lit(2), F.size("stack")).alias("stack"))
    return stacks.select(F.explode(F.array(start, end)).alias("e")).select("e.key", "e.stack")


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url",
               default: str = "allow") -> DataFrame:
    """Host, path, fitting rule and verdict of every row of `pages`.

    `rules` has host, path and verdict. Of the fitting rules the longest one (host and path
    together; then the longer host) decides; of repeated rules with different verdicts the larger
    word, so `block` before `allow`. A null address, one without `://` and one with an empty host
    fit no rule and get `default` and a null rule. Every row gives one row, repeated rows too.
    Result: the columns in `keep`, then host, path, rule, verdict; other columns of `pages` are
    not read.

    Rows are dealt out over as many buckets as there are shuffle partitions by row, not by host,
    so a host with most of the rows costs no more than others. Each bucket sweeps all rules.
    """
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Path lengths among the rules: as many as the longest path has characters, at most.
    lengths = sorted(r[0] for r in rules.filter("path IS NOT NULL").select(F.length("path"))
                     .distinct().collect())
    possible = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    parts = pages.select(kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                         F.monotonically_increasing_id().alias("row"))
    probes = parts.select(
        F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"), "row", "kept",
        "host", "path", F.explode_outer(F.when(F.col("host") != "", F.filter(
            possible, lambda n: n <= F.length("path")))).alias("n"))
    probes = probes.withColumn("key", F.when(F.col("n").isNotNull(), _key(
        F.col("host"), F.substring(F.col("path"), F.lit(1), F.col("n"))))).drop("n")
    events = _events(rules).withColumn(
        "bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    sweep = (Window.partitionBy("bucket").orderBy("key", F.col("row").isNotNull())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = (probes.unionByName(events, allowMissingColumns=True)
             .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
             .filter("row IS NOT NULL"))
    top = F.get("open", F.lit(0))
    best = F.max(F.when(top.isNotNull(), F.struct(
        top["n"].alias("n"), top["h"].alias("h"), top["rule"].alias("rule"),
        top["verdict"].alias("verdict"))))
    judged = swept.groupBy("bucket", "row").agg(
        F.any_value("kept").alias("kept"), F.any_value("host").alias("host"),
        F.any_value("path").alias("path"), best.alias("best"))
    return judged.select("kept.*", "host", "path", F.col("best.rule").alias("rule"),
                         F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
