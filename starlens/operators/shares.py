"""Shares, pivots and chart-ready long tables.

Windows here run over *aggregated* rows (one per group and category),
so the window shuffle is bounded by the number of groups, not by the
input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.operators.profile import group_count


def grouping_feeds(df: DataFrame, feeds: dict[str, Sequence[str]], sums: Sequence[str] = (), count_name: str = "count") -> DataFrame:
    """Several group-bys of one table in one scan: ``(feed, *keys, count, *sums)``.

    The rows are first reduced to one per combination of all keys, partially
    before the shuffle, and the grouping sets run on that table alone, so the
    input is neither scanned nor multiplied once for each feed.  A feed's
    unused keys are null; ``feed`` tells its rows from those of a null key.
    """
    keys = list(dict.fromkeys(k for used in feeds.values() for k in used))
    if len({frozenset(used) for used in feeds.values()}) != len(feeds):
        raise ValueError("two feeds have the same keys")
    finest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name), *[F.sum(s).alias(s) for s in sums])
    sets = [[F.col(k) for k in used] for used in feeds.values()]
    grouped = finest.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("__set"), F.sum(count_name).alias(count_name), *[F.sum(s).alias(s) for s in sums])
    # a set's id has a bit for every key it leaves out, the first key's the highest
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in used): name for name, used in feeds.items()}
    feed = F.element_at(F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]), F.col("__set").cast("int"))
    return grouped.select(feed.alias("feed"), *keys, count_name, *sums)


def feed_rows(grouped: DataFrame, feed: str, *columns: str) -> DataFrame:
    """One feed's rows of :func:`grouping_feeds`."""
    return grouped.where(F.col("feed") == feed).select(*columns)


def percent_of_partition(counts: DataFrame, count_col: str, partition_cols: Sequence[str],
                         out: str = "percentage") -> DataFrame:
    """``count / sum(count) over (partition by ...) * 100``."""
    w = Window.partitionBy(*partition_cols)
    return counts.withColumn(out, F.col(count_col) / F.sum(count_col).over(w) * F.lit(100))


def group_share(df: DataFrame, group_col: str, category_col: str, exclude: Sequence[str] = (),
                count_name: str = "count", out: str = "percentage") -> DataFrame:
    """Rows per (group, category) and each category's share of its group.

    Groups listed in ``exclude`` (and a null group) are dropped.  Because
    the filter is on the window's partition key, Catalyst pushes it below
    the window and the aggregate into the scan.
    """
    counts = group_count(df, group_col, category_col, count_name=count_name)
    shared = percent_of_partition(counts, count_name, [group_col], out=out)
    return shared.filter(~F.col(group_col).isin(list(exclude))) if exclude else shared.filter(F.col(group_col).isNotNull())


def share_of_total(counts: DataFrame, count_col: str, out: str = "share_pct", decimals: int | None = None) -> DataFrame:
    """Each row's share of the column total, in percent (pie-chart labels).

    Only for aggregated inputs (one row per category): the total is a
    window over the whole (small) frame.
    """
    pct = F.col(count_col) / F.sum(count_col).over(Window.partitionBy()) * F.lit(100)
    return counts.withColumn(out, F.round(pct, decimals) if decimals is not None else pct)


def pivot_counts(df: DataFrame, index_col: str, column_col: str, value_col: str,
                 columns: Sequence[str]) -> DataFrame:
    """Wide table index x columns of summed values, missing cells 0.

    The pivot values are given, which saves Spark the extra distinct job.
    """
    wide = df.groupBy(index_col).pivot(column_col, list(columns)).agg(F.sum(value_col))
    return wide.fillna(0, subset=list(columns))


def long_components(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
                    name_col: str = "component", value_col: str = "value") -> DataFrame:
    """Wide -> long: one row per (id, component)."""
    return df.unpivot(list(id_cols), list(value_cols), name_col, value_col)


def component_shares(df: DataFrame, group_col: str, value_cols: Sequence[str],
                     name_col: str = "component", value_col: str = "value",
                     out: str = "share_pct") -> DataFrame:
    """Each component's share of its group's sum of components (pie per group)."""
    long = long_components(df, [group_col], value_cols, name_col, value_col)
    w = Window.partitionBy(group_col)
    return long.withColumn(out, F.try_divide(F.col(value_col).cast("double"), F.sum(value_col).over(w)) * F.lit(100))


def stacked_baselines(df: DataFrame, group_col: str, value_cols: Sequence[str],
                      name_col: str = "component", value_col: str = "value",
                      out: str = "bottom") -> DataFrame:
    """Stacked bars: each segment's baseline is the sum of the segments below it."""
    order = {c: i for i, c in enumerate(value_cols)}
    long = long_components(df, [group_col], value_cols, name_col, value_col)
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])[F.col(name_col)]
    long = long.withColumn("stack_pos", pos)
    w = (Window.partitionBy(group_col).orderBy("stack_pos")
         .rowsBetween(Window.unboundedPreceding, -1))
    return long.withColumn(out, F.coalesce(F.sum(value_col).over(w), F.lit(0)).cast("bigint"))
