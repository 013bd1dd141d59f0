"""Operator 13: sharding by k-d tree partitioning (DataFrame functions only).

Documents are points in a space of metadata: source, language, size and id. The
tree starts with one node that owns all ``k`` shards. A node that owns more than
one is split along its widest dimension (its spread over that of the whole
table; ties go to the earlier dimension) at the weighted median: the left child
owns ``k DIV 2`` shards and gets that share of the bytes. Levels are split
until every node owns one shard, so with ``target_bytes`` until leaves reach it.

* Weights are bytes: the text in UTF-8 plus one. A cut lies between two rows of
  the order (value, hash of id and text, row number); the row that holds the
  median goes to the side with the larger part of it, so a node misses its share
  by half a row at most. Equal values may lie on both sides of a cut, so a hot
  source is split like any other; texts that are equal have no claim to one shard.
* Weighted medians of all nodes of a level are found together by radix selection:
  a round sums the bytes of at most 2^20 ranges a node (partial sums on the map
  side), keeps the range that holds the median and goes on inside it, value
  first, then hash, then row number. No node is sorted, gathered or sampled.
* Rows are narrow (no texts) and numbered once in a written table; every level
  is a written table too, and the one before is deleted.
* Slots are positions in the order (shard, hash, row number), by range partitions.

Edge cases: a null text has no bytes (size 1, checksum 0); a null string is a
value of its own, a null number counts as 0; equal rows are told apart by their
row number, so any number of them is spread evenly; with fewer rows than shards
some shards stay empty; an empty table gives an empty result; other columns of
the input are ignored. Reruns agree but for which of several equal rows is which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.common import discard, written
from labelforge.operators.positions import with_row_index

#: Stands for the size of the text among the dimensions.
BYTES = "<bytes>"
DIMENSIONS = ("source", "lang", BYTES, "doc_id")
#: Bits that a round of the radix selection settles; three words of 64 bits take 12 rounds at most.
DIGIT, MAX_ROUNDS = 20, 16


def hashed(c: Column, digits: int) -> Column:
    """A whole number from the first hexadecimal digits of the MD5 value."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


def coordinate(c: Column, kind: T.DataType) -> Column:
    """A long for one metadata value: whole numbers as they are, other numbers cut, anything else by a hash."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return F.coalesce(hashed(c.cast("string"), 8), F.lit(-1).cast("long"))


def points(docs: DataFrame, key: str, text: str, dimensions: tuple[str, ...]) -> DataFrame:
    """``_id, size, crc, tie, d0 ...``: a narrow row a document."""
    data = F.coalesce(F.col(text), F.lit(""))
    size, crc = (F.octet_length(data) + 1).cast("long"), F.crc32(data.cast("binary"))
    base = docs.select(F.col(key).alias("_id"), size.alias("size"), crc.alias("crc"),
                       *[F.lit(0).cast("long").alias(f"d{i}") if d == BYTES else coordinate(F.col(d), docs.schema[d].dataType).alias(f"d{i}")
                         for i, d in enumerate(dimensions)])
    for i, d in enumerate(dimensions):
        if d == BYTES:
            base = base.withColumn(f"d{i}", F.col("size"))
    tie = hashed(F.concat_ws("|", F.coalesce(F.col("_id").cast("string"), F.lit("null")), "crc", "size"), 15)
    return base.withColumn("tie", tie)


def _settled(state: DataFrame) -> DataFrame:
    """Goes on to the next words of the order where the range left has one value only."""
    one = "(word = 0 AND lo = hi)"
    two = f"({one} AND m1 = n1 OR word = 1 AND lo = hi)"
    all_three = f"({two} AND m2 = n2 OR word = 2 AND lo = hi)"
    return state.select(
        "node", "k", "dim", "target", "before", "m1", "n1", "m2", "n2", "at_cut",
        F.expr(f"CASE WHEN {all_three} THEN 3 WHEN {two} THEN 2 WHEN {one} THEN 1 ELSE word END").alias("word"),
        *[F.expr(f"CASE WHEN {two} THEN {m}2 WHEN {one} THEN {m}1 ELSE {end} END").alias(end) for m, end in (("m", "lo"), ("n", "hi"))],
        F.expr(f"CASE WHEN {one} THEN lo ELSE f0 END").alias("f0"),
        F.expr(f"CASE WHEN NOT {two} THEN f1 WHEN word = 1 THEN lo ELSE coalesce(f1, m1) END").alias("f1"))


STATE = ["node", "k", "dim", "target", "word", "before", "lo", "hi", "f0", "f1", "m1", "n1", "m2", "n2", "at_cut"]


def _stats(rows: DataFrame, n_dims: int) -> DataFrame:
    """Bytes and bounds of every node that has to be split."""
    ends = [f(c).alias(f"{p}_{c}") for c in [*[f"d{i}" for i in range(n_dims)], "tie", "rid"] for f, p in ((F.min, "min"), (F.max, "max"))]
    return rows.where("k > 1").groupBy("node", "k").agg(F.sum("size").alias("weight"), *ends)


def _start(stats: DataFrame, n_dims: int, spread: list[float]) -> DataFrame:
    """The widest dimension of each node, its share of bytes for the left child, and the range of the first word."""
    def width(i: int) -> Column:
        return ((F.col(f"max_d{i}").cast("double") - F.col(f"min_d{i}").cast("double")) / F.lit(spread[i])) if spread[i] else F.lit(0.0)
    widest = F.greatest(*[width(i) for i in range(n_dims)], F.lit(0.0))
    dim = F.lit(0)
    for i in reversed(range(n_dims)):
        dim = F.when(width(i) == widest, F.lit(i)).otherwise(dim)
    staged = stats.withColumn("dim", dim)
    low, high = (F.element_at(F.array(*[F.col(f"{p}_d{i}") for i in range(n_dims)]), F.col("dim") + 1) for p in ("min", "max"))
    left = F.expr("k DIV 2")
    share = F.expr("(weight DIV k)") * left + F.expr("((weight % k) * (k DIV 2)) DIV k")
    nothing = F.lit(None).cast("long")
    return _settled(staged.select(
        "node", "k", "dim", share.cast("long").alias("target"), F.lit(0).alias("word"), F.lit(0).cast("long").alias("before"),
        low.alias("lo"), high.alias("hi"), nothing.alias("f0"), nothing.alias("f1"), F.col("min_tie").alias("m1"), F.col("max_tie").alias("n1"),
        F.col("min_rid").alias("m2"), F.col("max_rid").alias("n2"), F.col("weight").alias("at_cut"))).select(*STATE)


def _round(rows: DataFrame, state: DataFrame, n_dims: int) -> DataFrame:
    """The state after one more digit of the words that are not settled."""
    x0 = F.element_at(F.array(*[F.col(f"d{i}") for i in range(n_dims)]), F.col("dim") + 1)
    shift = F.greatest(F.lit(0), F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))) - DIGIT).cast("int")
    open_ = state.where("word < 3").drop("m1", "n1", "m2", "n2", "at_cut").withColumn("shift", shift)
    inside = (rows.select("node", "size", "tie", "rid", *[f"d{i}" for i in range(n_dims)]).join(open_, "node")
              .withColumn("x0", x0).withColumn("x", F.expr("CASE word WHEN 0 THEN x0 WHEN 1 THEN tie ELSE rid END"))
              .where("x BETWEEN lo AND hi AND (word < 1 OR x0 = f0) AND (word < 2 OR tie = f1)"))
    place = [F.expr(f"shiftrightunsigned({c} ^ shiftleft(1L, 63), shift)") for c in ("x", "lo")]
    bins = (inside.withColumn("digit", place[0] - place[1])
            .groupBy("node", "k", "dim", "target", "word", "before", "f0", "f1", "digit")
            .agg(F.sum("size").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("tie").alias("m1"), F.max("tie").alias("n1"),
                 F.min("rid").alias("m2"), F.max("rid").alias("n2")))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    found = (bins.withColumn("_upto", F.col("before") + upto).withColumn("before", F.col("_upto") - F.col("w"))
             .where("before <= target AND target < _upto").withColumn("at_cut", F.col("w")))
    moved = _settled(found).select(*STATE)
    return moved.union(state.where("word >= 3").select(*STATE))


def _cuts(rows: DataFrame, n_dims: int, spread: list[float]) -> DataFrame:
    """``node, dim, f0, f1, f2, left``: the row that holds each node's median, and whether it goes left."""
    state = written(_start(_stats(rows, n_dims), n_dims, spread), "shard-state")
    for _ in range(MAX_ROUNDS):
        if state.where("word < 3").isEmpty():
            # what is settled last is a row number: lo of the range, m2 where the row was alone before
            return state.select("node", "dim", "f0", "f1", F.col("m2").alias("f2"), F.expr("2 * (target - before) >= at_cut").alias("left"))
        after = written(_round(rows, state, n_dims), "shard-state")
        discard(state)
        state = after
    raise RuntimeError(f"medians were not settled in {MAX_ROUNDS} rounds")


def _split(rows: DataFrame, cuts: DataFrame, n_dims: int) -> DataFrame:
    """``rows`` one level down: nodes are named by the first shard that they own."""
    x0 = F.element_at(F.array(*[F.col(f"d{i}") for i in range(n_dims)]), F.col("dim") + 1)
    here, cut = F.struct(x0.alias("a"), F.col("tie").alias("b"), F.col("rid").alias("c")), F.struct(
        F.col("f0").alias("a"), F.col("f1").alias("b"), F.col("f2").alias("c"))
    left = F.col("f0").isNull() | (here < cut) | ((here == cut) & F.col("left"))
    half = F.expr("CAST(k DIV 2 AS INT)")
    return (rows.join(cuts, "node", "left").withColumn("_left", left)
            .withColumn("node", F.when(F.col("k") == 1, F.col("node")).when(F.col("_left"), F.col("node")).otherwise(F.col("node") + half))
            .withColumn("k", F.when(F.col("k") == 1, F.col("k")).when(F.col("_left"), half).otherwise(F.col("k") - half))
            .select(*rows.columns))


def tree(docs: DataFrame, key: str, text: str, shards: int | None, target_bytes: int | None, dimensions: tuple[str, ...]) -> DataFrame:
    """``_id, size, crc, tie, rid, shard`` of every row."""
    rows = written(points(docs, key, text, dimensions).withColumn("rid", F.monotonically_increasing_id()), "shard-points")
    ends = [f(f"d{i}").cast("double") for i in range(len(dimensions)) for f in (F.max, F.min)]
    total, *ends = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), *ends).first()
    count = shards if shards is not None else max(1, -(-total // target_bytes))
    spread = [(a - b) if a is not None else 0.0 for a, b in zip(ends[::2], ends[1::2])]
    rows = rows.withColumn("node", F.lit(0)).withColumn("k", F.lit(int(count)))
    previous = None
    for _ in range((count - 1).bit_length()):
        below = written(_split(rows, _cuts(rows, len(dimensions), spread), len(dimensions)), "shard-level")
        if previous is not None:
            discard(previous)
        rows = previous = below
    return rows.select("_id", "size", "crc", "tie", "rid", F.col("node").alias("shard"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int | None = 16, target_bytes: int | None = None,
          dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Give ``shards`` or, with ``shards=None``, ``target_bytes`` a leaf. The law
    is ``bytes``: shards hold near equal sizes.
    """
    if (shards is None) == (target_bytes is None) or (shards if shards is not None else target_bytes) < 1:
        raise ValueError("give a positive number of shards or, with shards=None, positive target_bytes")
    placed = tree(docs, key, text, shards, target_bytes, dimensions)
    numbered = with_row_index(placed, ["shard", "tie", "rid"], "_pos")
    first = numbered.groupBy("shard").agg(F.min("_pos").alias("_first"))
    return numbered.join(first, "shard").select(
        F.col("_id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("_pos") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
