"""Helpers the operators share: word splitting, written intermediate tables,
connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.session import shared_dir, work_path

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Runs of non-blank characters of the whole text; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.filter(F.split(trimmed, BLANK_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters (long); null: 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


#: The setting by which Spark deletes the shuffle files of a job when the job ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Tables and checkpoints made in here leave no shuffle files. Else these stay until
    the driver happens to collect its garbage, so those of finished steps pile up on disk."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable ``checkpoint()`` of ``df`` that leaves no shuffle files."""
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint()          # a plan keeps the setting it was made under


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later steps
    start from files that survive a lost executor."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    with shuffles_go(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def discard(table: DataFrame) -> None:
    """Delete a table of ``written`` that no later step reads: intermediate
    tables should not pile up while a job is still running."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, rounds: int | None = None) -> DataFrame:
    """Connected components of an undirected edge list of longs.

    Returns ``node, component`` (the smallest node of its component) for every
    node that has an edge. Each round takes every node to the one of least hash
    among itself and its neighbours, and on to where that one is taken, and goes
    on with the edges between what is left, so the edges get fewer from round to round, and chains don't make many
    rounds, whatever the order of their nodes. A round is cut off with a reliable
    ``checkpoint()``; a hot node's neighbours are combined map-side. Stops when no
    edge is left; not settling within ``max_rounds`` is an error, never a silent
    cut. Empty edge lists give an empty result; self edges and repeats are harmless,
    edges with a null end are no edges. With ``rounds`` it stops after so many:
    nodes of one label are connected then, but connected nodes may have several.
    """
    shared_dir(edges.sparkSession)
    left = checkpointed(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    labels = left.select(F.explode(F.array("u", "v")).alias("u")).distinct().withColumn("c", F.col("u"))
    for done in range(max_rounds + 1):
        if done == rounds or left.isEmpty():
            least = labels.groupBy("c").agg(F.min("u").alias("component"))
            return checkpointed(labels.join(least, "c").select(F.col("u").alias("node"), "component"))
        both = left.union(left.select("v", "u"))
        # of equal hashes the smaller node counts as the lower one
        near = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("m"))
        near = near.select("u", F.least(F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("c")),
                                        F.struct(F.xxhash64("m").alias("h"), F.col("m").alias("c")))["c"].alias("c"))
        onward = near.select(F.col("u").alias("c"), F.col("c").alias("d"))
        near = near.join(onward, "c").select("u", F.col("d").alias("c"))
        moved = labels.join(near.select(F.col("u").alias("c"), F.col("c").alias("d")), "c", "left")
        labels = moved.select("u", F.coalesce("d", "c").alias("c"))
        for x in "uv":
            left = left.join(near.select(F.col("u").alias(x), F.col("c").alias(f"c{x}")), x)
        left = checkpointed(left.where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def joined_components(named: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` after the ``edges`` ``a, b`` are added to the result ``named`` of ``components``: only the components they touch are gone through."""
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node", "left_anti")
    every = named.select("node", "component").union(nodes.select("node", F.col("node").alias("component")))
    for x in "ab":
        ends = ends.join(every.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x)
    merged = components(ends, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("least"))
    return checkpointed(every.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def batches_of(it: Iterator, max_bytes: int, size_of) -> Iterator[list]:
    """Lists of consecutive items whose sizes add up to about ``max_bytes``."""
    held, total = [], 0
    for x in it:
        held.append(x)
        total += size_of(x)
        if total >= max_bytes:
            yield held
            held, total = [], 0
    if held:
        yield held


def map_batches(df: DataFrame, rows, schema) -> DataFrame:
    """``mapInArrow`` over plain Python columns, so that null ids stay null.

    ``rows`` gets an iterator of lists of tuples (one list an Arrow batch) and
    yields lists of tuples of ``schema``.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches):
        given = (list(zip(*(c.to_pylist() for c in b.columns))) for b in batches)
        for made in rows(given):
            if made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return df.mapInArrow(run, schema)


def bit_classes(counts):
    """The frequency class (bits of the count, 31 at most) of each of an array of counts."""
    import numpy as np
    return np.minimum(np.frexp(counts.astype(np.float64))[1], 31).astype(np.uint8)


def hash_sample(df: DataFrame, hashed: Column, limit: int, *ties: str) -> DataFrame:
    """``limit`` rows of lowest ``hashed`` value (a 64-bit hash), in that order.

    A plain top-k sends k rows of every task to one; here all but about four
    times ``limit`` rows are left out by their hash before that, whatever the
    number of tasks.
    """
    scale = 1 << 40
    share = min(scale, -(-4 * limit * scale // max(df.count(), 1)))
    spread = df.withColumn("_hash", hashed)
    low = F.shiftrightunsigned(F.col("_hash"), 24)          # the upper 40 bits, so the lowest values stay
    return spread.withColumn("_high", low).where(F.col("_high") < share).orderBy("_high", "_hash", *ties).limit(limit).drop("_high", "_hash")


def perhaps_in(df: DataFrame, col: Column, wanted: DataFrame, wanted_col: Column, bits: int = 1 << 24) -> DataFrame:
    """The rows of ``df`` whose ``col`` may be among ``wanted``: a filter before a wide shuffle.

    A bitmap of ``bits`` hash places (2 MB, whatever the number of rows) is
    merged on the executors and sent to the tasks. No wanted row is lost; the
    more rows are wanted, the less the filter saves.
    """
    import numpy as np

    place = F.pmod(F.xxhash64(wanted_col), F.lit(bits))
    rows = (wanted.select(place.alias("p")).select(F.bitmap_bucket_number("p").alias("k"), F.bitmap_bit_position("p").alias("b"))
            .groupBy("k").agg(F.bitmap_construct_agg("b").alias("m")).collect())       # at most bits / 32768 rows of 4 KB
    # bucket k holds the places (k - 1) * 32768 + 1 ... k * 32768 for k > 0
    first = wanted.sparkSession.range(1).select(F.bitmap_bucket_number(F.lit(0)).alias("k")).first().k
    found = np.zeros((bits // 32768 + 2, 4096), np.uint8)
    for r in rows:
        found[r.k - first] = np.frombuffer(bytes(r.m), np.uint8)
    at = F.pmod(F.xxhash64(col), F.lit(bits))

    @F.pandas_udf("boolean")
    def marked(bucket, bit):
        k, b = bucket.to_numpy() - first, bit.to_numpy()
        import pandas as pd
        return pd.Series((found[k, b // 8] >> (b % 8)) & 1 == 1)

    return df.where(marked(F.bitmap_bucket_number(at), F.bitmap_bit_position(at)))
