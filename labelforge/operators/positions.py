"""Global row positions without funnelling rows through one task.

``row_number() over (order by k)`` with no partition clause moves every row to
a single task. Instead: range-partition on the order key (balanced by
sampling), sort inside each partition, number rows locally, and add the count
of all rows in earlier partitions. The per-partition counts table has one row
per partition, so broadcasting it is bounded by the partition count.

The partition a row lands in depends on range bounds sampled from the input,
and an input coming out of a shuffle arrives in no fixed order, so two
evaluations of the same range exchange may draw different bounds. The
partition id and the local number are therefore materialised ONCE with a
reliable ``checkpoint()`` into the session's shared checkpoint folder (it
survives executor loss); the counts and the rows are both read from it. Index
narrow tables (ids and sort keys) and join wide rows back on the id — see
the dataset builders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.session import shared_dir

PARTITION_BYTES, MAX_PARTITIONS = 128 << 20, 20_000


def _partition_count(df: DataFrame, num_partitions: int | None) -> int:
    """An explicit range exchange is not widened by adaptive execution, so the
    number follows the input: one partition per ``PARTITION_BYTES`` of the
    tables read, at least the session's shuffle partitions."""
    if num_partitions:
        return int(num_partitions)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        # a leaf that came out of a checkpoint knows no size and reports the largest number there is
        sizes = [int(leaves.apply(i).stats().sizeInBytes().toString()) for i in range(leaves.size())]
    except Exception:               # a remote session has no plan to ask
        return least
    size = sum(s for s in sizes if s < 1 << 60)
    return max(least, min(size // PARTITION_BYTES, MAX_PARTITIONS))


def _range_partitioned(df: DataFrame, order_cols: list, n: int, number_rows: bool) -> DataFrame:
    """Range-partition, tag each row with its partition id (and its number
    inside the sorted partition), and materialise that once."""
    shared_dir(df.sparkSession)          # checkpoint() needs the folder set
    ranged = df.repartitionByRange(n, *order_cols)
    if number_rows:
        ranged = (ranged.sortWithinPartitions(*order_cols)
                        .withColumn("_lf_pid", F.spark_partition_id())
                        # low 33 bits of the id = record number inside the partition
                        .withColumn("_lf_local",
                                    F.monotonically_increasing_id()
                                    - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    else:
        ranged = ranged.withColumn("_lf_pid", F.spark_partition_id())
    return ranged.checkpoint(eager=True)


def with_row_index(df: DataFrame, order_cols: list[str | Column], name: str = "pos",
                   num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in the total order given by ``order_cols``.

    ``order_cols`` must form a total order (end them with a unique key) for the
    positions to be reproducible.
    """
    n = _partition_count(df, num_partitions)
    base = _range_partitioned(df, order_cols, n, number_rows=True)
    counts = base.groupBy("_lf_pid").agg(F.count(F.lit(1)).alias("_lf_n"))
    offsets = counts.select(
        "_lf_pid",
        (F.sum("_lf_n").over(Window.orderBy("_lf_pid")
                             .rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_lf_n")).alias("_lf_offset"))
    return (base.join(F.broadcast(offsets), "_lf_pid")
                .withColumn(name, (F.col("_lf_offset") + F.col("_lf_local")).cast("long"))
                .drop("_lf_pid", "_lf_local", "_lf_offset"))


def _range_partitioned_sorted(df: DataFrame, order_cols: list, n: int) -> DataFrame:
    shared_dir(df.sparkSession)
    return (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_lf_pid", F.spark_partition_id())
              .checkpoint(eager=True))


def _scan_schema(schema, value: str):
    from pyspark.sql import types as T
    vt = schema[value].dataType
    return T.StructType(list(schema.fields) + [T.StructField("_lf_lmax", vt), T.StructField("_lf_lprev", vt),
                                               T.StructField("_lf_first", T.BooleanType())])


def _local_scan(group: str, value: str):
    """Running max / previous value per group over a partition's sorted rows,
    batch by batch (vectorised per batch, carry between batches)."""
    def scan(batches):
        import numpy as np
        import pandas as pd
        started, carry_g, carry_max, carry_last = False, None, np.nan, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            v = pdf[value].astype("float64")
            # a null group is a group: its code is -1
            g = pd.Series(pd.factorize(pdf[group])[0], index=pdf.index)
            own = pdf[group].isna() if started and pd.isna(carry_g) else pdf[group] == carry_g
            cont = own.to_numpy() if started else np.zeros(len(pdf), bool)
            cm = v.fillna(-np.inf).groupby(g, sort=False).cummax().to_numpy()
            if cont.any() and not np.isnan(carry_max):
                cm[cont] = np.maximum(cm[cont], carry_max)
            cm = np.where(np.isneginf(cm), np.nan, cm)
            prev = pdf[value].groupby(g, sort=False).shift(1).astype(object)
            first = (~g.duplicated()).to_numpy()
            if cont.any():
                first = first & ~cont
                prev.iloc[0] = carry_last
            out = pdf.assign(_lf_lmax=cm, _lf_lprev=prev.where(pd.notna(prev), None), _lf_first=first)
            started, carry_g, carry_last = True, pdf[group].iloc[-1], pdf[value].iloc[-1]
            carry_max = cm[-1]
            yield out
    return scan


def running_max_and_lag(df: DataFrame, group: str, order_cols: list[str], value: str,
                        best: str = "best_so_far", prev: str = "prev_value",
                        num_partitions: int | None = None, method: str = "window") -> DataFrame:
    """Per group in ``order_cols`` order: the running maximum of ``value`` and
    the previous row's ``value``.

    ``Window.partitionBy(group)`` would put a whole group in one task. Here the
    rows are range-partitioned on (group, order), so a hot group is spread over
    several partitions; each (partition, group) segment is scanned locally, and
    the carry from the group's earlier segments (their maximum and last value)
    comes from a summary table with one row per segment. Pass only the
    columns the scan needs: the partition tags are materialised once. A NaN
    value is a missing one, in both methods and on any partitioning.
    """
    n = _partition_count(df, num_partitions)
    if df.schema[value].dataType.typeName() in ("double", "float"):
        df = df.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    if method == "arrow":
        # sorted partitions scanned in place: no second shuffle for the local pass
        ranged = _range_partitioned_sorted(df, [group, *order_cols], n)
        local = ranged.mapInPandas(_local_scan(group, value),
                                   _scan_schema(ranged.schema, value))
    else:
        ranged = _range_partitioned(df, [group, *order_cols], n, number_rows=False)
        w = Window.partitionBy("_lf_pid", group).orderBy(*order_cols)
        local = (ranged
                 .withColumn("_lf_lmax", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("_lf_lprev", F.lag(value).over(w))
                 .withColumn("_lf_first", F.row_number().over(w) == 1))
    seg = ranged.groupBy("_lf_pid", group).agg(
        F.max(value).alias("_lf_smax"),
        F.max_by(value, F.struct(*order_cols)).alias("_lf_slast"))
    ws = Window.partitionBy(group).orderBy("_lf_pid")
    carry = seg.select(
        "_lf_pid", group,
        F.max("_lf_smax").over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias("_lf_cmax"),
        F.lag("_lf_slast").over(ws).alias("_lf_clast"))
    if method == "arrow":
        # only the first group of a partition can continue from earlier
        # partitions: the carry table has at most one row per partition, so
        # it is broadcast and the scanned rows stay where they are
        first = seg.groupBy("_lf_pid").agg(F.min(F.struct(F.col(group).isNotNull().alias("k"), F.col(group).alias("g"))).alias("_lf_first_g"))
        carry = carry.join(first, "_lf_pid").filter(F.col(group).eqNullSafe(F.col("_lf_first_g.g"))).drop("_lf_first_g")
        carry, how = F.broadcast(carry), "left"
    else:
        how = "inner"
    carry = carry.withColumnsRenamed({"_lf_pid": "_lf_cpid", group: "_lf_cgroup"})
    here = (F.col("_lf_pid") == F.col("_lf_cpid")) & F.col(group).eqNullSafe(F.col("_lf_cgroup"))
    out = local.join(carry, here, how).drop("_lf_cpid", "_lf_cgroup")
    return (out.withColumn(best, F.greatest("_lf_lmax", "_lf_cmax"))
               .withColumn(prev, F.when(F.col("_lf_first"), F.col("_lf_clast"))
                                  .otherwise(F.col("_lf_lprev")))
               .drop("_lf_pid", "_lf_lmax", "_lf_lprev", "_lf_first", "_lf_cmax", "_lf_clast"))


def running_sums(df: DataFrame, group: str, order: Column, sums: list[str],
                 num_partitions: int | None = None) -> DataFrame:
    """Per group in ``order``: the sum of each column over all earlier rows, as
    ``before_<column>``. A group is spread over range partitions; each segment
    is summed locally and gets the total of the group's earlier segments (a
    table with one row per segment)."""
    n = _partition_count(df, num_partitions)
    ranged = _range_partitioned(df.withColumn("_lf_order", order), [group, "_lf_order"], n, number_rows=False)
    local = Window.partitionBy("_lf_pid", group).orderBy("_lf_order").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(group).orderBy("_lf_pid").rowsBetween(Window.unboundedPreceding, -1)
    segments = ranged.groupBy("_lf_pid", group).agg(*[F.sum(c).alias(f"_lf_{c}") for c in sums])
    carry = segments.select("_lf_pid", group, *[F.coalesce(F.sum(f"_lf_{c}").over(earlier), F.lit(0)).alias(f"_lf_{c}") for c in sums])
    return (ranged.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"before_{c}") for c in sums])
            .join(carry.withColumnsRenamed({"_lf_pid": "_lf_cpid", group: "_lf_cgroup"}),
                  (F.col("_lf_pid") == F.col("_lf_cpid")) & F.col(group).eqNullSafe(F.col("_lf_cgroup"))).drop("_lf_cpid", "_lf_cgroup")
            .withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_lf_{c}") for c in sums})
            .drop("_lf_pid", "_lf_order", *[f"_lf_{c}" for c in sums]))


def with_batch_id(df: DataFrame, order_cols: list[str | Column], batch_size: int,
                  pos: str = "pos", batch: str = "batch_id") -> DataFrame:
    """Fixed-size batches of consecutive rows in key order: ``floor(pos / n)``."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    out = with_row_index(df, order_cols, pos)
    return out.withColumn(batch, F.floor(F.col(pos) / F.lit(batch_size)).cast("long"))


def bounded_lists(df: DataFrame, key: str, order: Column, value: Column, limit: int, num_partitions: int | None = None) -> DataFrame:
    """``key, part, values``: the values of each key in ``order`` (a total order within the key), cut into lists of at most
    ``limit``. Positions come from sorted range partitions and parts are grouped by themselves, so a key of any size is
    never in one task or one row."""
    if limit < 1:
        raise ValueError("limit must be positive")
    narrow = df.select(F.col(key), order.alias("_lf_by"), value.alias("_lf_value"), F.lit(1).cast("long").alias("one"))
    placed = running_sums(narrow, key, F.col("_lf_by"), ["one"], num_partitions)
    part = F.floor(F.col("before_one") / F.lit(limit)).cast("long")
    held = placed.groupBy(key, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("before_one").alias("at"), F.col("_lf_value").alias("v")))).alias("l"))
    return held.select(key, "part", F.transform("l", lambda x: x["v"]).alias("values"))
