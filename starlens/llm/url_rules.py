"""Operator 8: judge urls by host and path rules, a sort-merge range join.

Keys are canonical: the host's labels reversed, then the path. In this
order each rule is one interval below its host, and the intervals of a
host nest or are apart. Urls and interval ends are sorted together by key
and a running window carries the stack of rules that are open at that
point; its top is the longest rule that fits.

Scale: only hosts with rules are sorted. A host's urls are dealt over as
many salts as its count needs, with the host's interval ends copied to each
salt, so one host with a third of all urls is no single task. Urls are
judged once per distinct (host, path). What urls are joined with are written
tables, not aggregates: Spark broadcasts them by their real size or, if they
are large, adaptive execution splits a hot host or a hot url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch, ascii_lower, others

ROWS_PER_SALT = 50_000


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; '' without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, "[.]", -1)), ".")


def _rules_with_stack(rules: DataFrame) -> DataFrame:
    """One row a (host, path): its verdict and the stack of rules open inside it.

    A rule's enclosing rules are those of its host whose path is a prefix
    of its own; they are found by an equi-join on the prefixes.
    """
    r = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
         .groupBy(ascii_lower(F.col("host")).alias("host"), "path")
         .agg(F.max("verdict").alias("verdict"))  # 'block' is after 'allow'
         .withColumn("hkey", reversed_host(F.col("host"))))
    rule = F.struct(F.char_length("path").alias("len"), F.concat("host", "path").alias("rule"),
                    F.char_length("host").alias("host_len"), "verdict")
    prefixes = r.select("hkey", "path", F.explode(F.sequence(F.lit(0), F.char_length("path"))).alias("n"))
    prefixes = prefixes.select("hkey", F.col("path").alias("inner_path"),
                               F.col("path").substr(F.lit(1), F.col("n")).alias("path"))
    return (prefixes.join(r, ["hkey", "path"]).groupBy("hkey", "inner_path")
            .agg(F.sort_array(F.collect_list(rule)).alias("stack"))
            .withColumnRenamed("inner_path", "path"))


def judge_urls(pages: DataFrame, rules: DataFrame, scratch: Scratch, url_col: str = "url", default: str = "allow",
               rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and
    all subdomains if the url's path starts with the rule's; the longest
    rule (host and path, then host) wins, without one ``default``. Of
    rules with equal host and path ``block`` wins; rules with a null part
    are ignored. A null url, or one without ``://``, has empty host and
    path. Repeated rows each get their verdict; input columns with the
    names of the four results are replaced. An empty table stays empty.
    """
    keep = others(pages, "host", "path", "rule", "verdict")
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
                        url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = base.select("host", "path").distinct()
    stacks = scratch.save(_rules_with_stack(rules), "stacks")
    # a url's candidates: its host's last 1..m labels, m the most labels of a rule's host
    depth = stacks.agg(F.coalesce(F.max(F.size(F.split("hkey", "[.]", -1))), F.lit(0)).alias("depth"))
    depth = int(depth.first()["depth"])
    labels = F.split("host", "[.]", -1)
    parts = (urls.select("host", "path", F.size(labels).alias("n"), reversed_host(F.col("host")).alias("rev"))
             .select("host", "path", "rev", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(max(depth, 1))))).alias("k"))
             .select("host", "path", F.expr("substring_index(rev, '.', k)").alias("hkey")))
    candidates = scratch.save(parts.join(stacks.select("hkey"), "hkey", "left_semi"), "candidates")
    salts = (candidates.groupBy("hkey").agg(F.count(F.lit(1)).alias("n"))
             .select("hkey", F.ceil(F.col("n") / rows_per_salt).cast("int").alias("salts")))
    salts = scratch.save(salts, "salts")
    salted = (candidates.join(salts, "hkey")
              .select("hkey", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
                      F.encode("path", "utf-8").alias("key"), F.lit(1).alias("kind"), "host", "path",
                      F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")))
    ends = stacks.join(salts, "hkey").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    nothing = F.lit(None).cast("string")
    key = F.encode("path", "utf-8")
    opens = ends.select("hkey", "salt", key.alias("key"), F.lit(0).alias("kind"), nothing.alias("host"),
                        nothing.alias("path"), "stack")
    # byte FF is in no UTF-8 text: this end sorts after every path with the rule's prefix
    closes = ends.select("hkey", "salt", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"),
                         nothing.alias("host"), nothing.alias("path"),
                         F.slice("stack", 1, F.size("stack") - 1).alias("stack"))
    sweep = Window.partitionBy("hkey", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (salted.union(opens).union(closes)
             .withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
             .where((F.col("kind") == 1) & (F.size("open") > 0))
             .withColumn("top", F.element_at("open", -1)))
    best = (swept.groupBy("host", "path")
            .agg(F.max(F.struct((F.col("top.len") + F.col("top.host_len")).alias("total"),
                                F.col("top.host_len").alias("host_len"), F.col("top.rule").alias("rule"),
                                F.col("top.verdict").alias("verdict"))).alias("best"))
            .select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best.rule", "best.verdict"))
    best = scratch.save(best, "best")
    scratch.drop("stacks", "candidates", "salts")
    out = base.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return out.select(
        *[F.col(f"row.`{c}`") for c in keep], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
