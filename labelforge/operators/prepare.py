"""Dataset preparation: joins, label vectors, splits, NLI expansion, builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.labels import (label_columns_by_position, negate_label,
                                         pack_labels, qcol)
from labelforge.operators.positions import with_row_index
from labelforge.schemas import SPLIT_VALUES, LabelSpec

INDEX_COL = "__index_level_0__"
# Lower-case split name of the dataset dict (train / validation / test). Column
# names are case-insensitive in Spark, so it cannot be called "split" next to
# the file's "Split".
SPLIT_NAME = "split_name"


# J1 -------------------------------------------------------------------------
def join_labels(abstracts: DataFrame, labels: DataFrame, key: str = "PMID") -> DataFrame:
    """Inner equi-join of texts and label rows on the id.

    Shuffle sort-merge join on the key; adaptive execution turns it into a
    broadcast at run time only when one side is measured small.
    """
    return abstracts.join(labels, key, "inner")


# P1 -------------------------------------------------------------------------
def with_label_vector(df: DataFrame, label_cols: list[str] | None = None,
                      first: int = 5, name: str = "label") -> DataFrame:
    """Pack the label columns into ``label`` (array<double>), file order.

    Without names, the label columns are taken by position (sixth column on).
    """
    cols = label_cols if label_cols is not None else label_columns_by_position(df.columns, first)
    return df.withColumn(name, pack_labels(cols))


# P2 -------------------------------------------------------------------------
def split_filter(df: DataFrame, split_col: str = "Split",
                 values: list[str] = SPLIT_VALUES) -> DataFrame:
    """Keep rows whose split is one of the (case-sensitive) names; add
    ``split_name`` in lower case. Other values are dropped from every split."""
    return (df.filter(F.col(split_col).isin(values))
              .withColumn(SPLIT_NAME, F.lower(F.col(split_col))))


def dropped_split_rows(df: DataFrame, split_col: str = "Split",
                       values: list[str] = SPLIT_VALUES) -> DataFrame:
    """Count of rows the split filter drops, per offending value."""
    return (df.filter(~F.col(split_col).isin(values) | F.col(split_col).isNull())
              .groupBy(split_col).agg(F.count(F.lit(1)).alias("n_dropped")))


# P3 / P4 --------------------------------------------------------------------
def rename_label(df: DataFrame, label_column: str | None) -> DataFrame:
    if label_column is None or label_column == "label":
        return df
    if label_column not in df.columns:
        raise ValueError(f"label column {label_column!r} not found")
    return df.withColumnRenamed(label_column, "label")


def drop_columns(df: DataFrame, names: str | list[str] | None) -> DataFrame:
    """Drop a comma-separated list of columns; an unknown name raises."""
    if not names:
        return df
    wanted = [n.strip() for n in names.split(",")] if isinstance(names, str) else list(names)
    missing = [n for n in wanted if n not in df.columns]
    if missing:
        raise ValueError(f"cannot drop unknown columns {missing}")
    return df.drop(*wanted)


# P6 / P7 --------------------------------------------------------------------
def split_alias(df: DataFrame, mapping: dict[str, str], split_col: str = "split") -> DataFrame:
    """Rename split values (``{"validation": "dev"}``); equal names are a no-op.
    A split that the table does not have is an error when the rows are read."""
    mapping = {k: v for k, v in mapping.items() if k != v}
    if not mapping:
        return df
    expr: Column | None = None
    for old, new in mapping.items():
        expr = (F.when(F.col(split_col) == old, F.lit(new)) if expr is None
                else expr.when(F.col(split_col) == old, F.lit(new)))
    there = df.agg(*[F.coalesce(F.max(F.col(split_col) == old), F.lit(False)).alias(f"h{i}") for i, old in enumerate(mapping)])
    checks = [F.when(~F.col(f"h{i}"), F.raise_error(F.lit(f"no split {old!r} to rename")).cast("boolean")).otherwise(F.lit(True))
              for i, old in enumerate(mapping)]
    every = there.select(F.array(*checks).alias("ok"))
    return (df.withColumn(split_col, expr.otherwise(F.col(split_col)))
            .filter(F.size(every.scalar()) == len(mapping)))


def eval_split_name(present: set[str]) -> str:
    """Validation if present, else test; neither is an error."""
    if "validation" in present:
        return "validation"
    if "test" in present:
        return "test"
    raise ValueError("evaluation needs a validation or test split")


def eval_split(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows of the evaluation split (validation, falling back to test; neither
    is an error when the rows are read).

    The choice is a one-value scalar subquery over the (few) split names, so
    no split list is brought to the driver.
    """
    pref = F.when(F.col(split_col) == "validation", 1).when(F.col(split_col) == "test", 2)
    choice = (df.select(split_col, pref.alias("_pref")).filter(F.col("_pref").isNotNull())
                .agg(F.min_by(split_col, "_pref").alias("_chosen"))
                .select(F.when(F.col("_chosen").isNotNull(), F.col("_chosen")).otherwise(
                    F.raise_error(F.lit("evaluation needs a validation or test split"))).alias("_chosen")))
    return df.filter(F.col(split_col) == choice.scalar())


# P8 -------------------------------------------------------------------------
def concat_text_columns(df: DataFrame, columns: list[str], delimiter: str = " ",
                        name: str = "sentence") -> DataFrame:
    """Join text columns with a delimiter; inputs are left untouched, nulls skipped."""
    return df.withColumn(name, F.concat_ws(delimiter, *[qcol(c) for c in columns]))


# P9 -------------------------------------------------------------------------
def with_position(df: DataFrame, order_cols: list[str], name: str = INDEX_COL) -> DataFrame:
    return with_row_index(df, order_cols, name)


# P11 ------------------------------------------------------------------------
def label_dictionary_from(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """(label_idx, label_name, n_labelled) from a label table: the label
    columns in file order, with how many rows carry a value for each (one
    partial-aggregated pass, C output rows)."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("label_idx"), F.lit(c).alias("label_name"),
                 qcol(c).isNotNull().cast("long").alias("has"))
        for i, c in enumerate(label_cols)])))
    return long.groupBy("label_idx", "label_name").agg(F.sum("has").alias("n_labelled"))


# P12 ------------------------------------------------------------------------
def candidate_term_filter(df: DataFrame, text_col: str, terms: list[str]) -> DataFrame:
    """OR of whole-word, case-insensitive term matches over the full text."""
    if not terms:
        return df.limit(0)
    import re
    # letters on either side end a match; explicit classes behave the same in
    # every regex engine (unlike \\b around accented letters)
    pattern = "(?i)(^|[^a-z0-9])(" + "|".join(re.escape(t) for t in terms) + ")([^a-z0-9]|$)"
    return df.filter(F.col(text_col).rlike(pattern))


def mesh_term_filter(df: DataFrame, headings: str, terms: list[tuple[str, str | None]],
                     major_only: bool = True) -> DataFrame:
    """Rows with a heading of one of the (topic, qualifier or None) terms.

    ``headings``: array of structs (name, qualifiers array<string>, major
    boolean). Names compare without regard to case. ``major_only`` asks for a
    major topic. Rows without headings are left out.
    """
    if not terms:
        return df.limit(0)

    def fits(h: Column) -> Column:
        ways = None
        for topic, qualifier in terms:
            way = F.lower(h["name"]) == topic.lower()
            if qualifier is not None:
                way = way & F.array_contains(F.transform(F.coalesce(h["qualifiers"], F.array()), lambda q: F.lower(q)),
                                             qualifier.lower())
            ways = way if ways is None else ways | way
        return F.coalesce(ways & h["major"], F.lit(False)) if major_only else F.coalesce(ways, F.lit(False))
    return df.filter(F.exists(headings, fits))


# J3 / J7 --------------------------------------------------------------------
def keyed_update(target: DataFrame, updates: DataFrame, key: str, column: str,
                 order: str | None = None) -> DataFrame:
    """Set ``column`` from ``updates`` where the key matches; other rows keep
    their value (null when never set). Of several updates of a key the last in
    ``order`` (without one: the largest value) counts; target rows never
    multiply. A null value is no update."""
    new = F.col(column)
    pick = F.max(new) if order is None else F.max_by(column, F.struct(F.col(order), new))
    upd = updates.filter(new.isNotNull()).groupBy(key).agg(pick.alias("_lf_new"))
    out = target.join(upd, key, "left")
    if column in target.columns:
        out = out.withColumn(column, F.coalesce(F.col("_lf_new"), F.col(column)))
    else:
        out = out.withColumn(column, F.col("_lf_new"))
    return out.drop("_lf_new")


def missing_ids(requested: DataFrame, received: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(received.select(key), key, "left_anti")


# X1 / X2 --------------------------------------------------------------------
def build_labelled(abstracts: DataFrame, labels: DataFrame, spec: LabelSpec,
                   key: str = "PMID", split_col: str = "Split", with_index: bool = True) -> DataFrame:
    """abstracts ⋈ labels → label vector → split filter (→ row position).

    One DataFrame with a ``split_name`` column; write it partitioned by it.
    Repeated ids on either side give every match, as an inner join does, and
    every merged row has a position of its own. Positions are computed on ids
    and label rows alone; the texts are read and moved once.
    """
    merged = indexed_join(abstracts, indexed_labels(abstracts, labels, key), key) if with_index \
        else join_labels(abstracts, labels, key)
    merged = with_label_vector(merged, spec.labels)
    if with_index:
        merged = merged.select(*[c for c in merged.columns if c != INDEX_COL], INDEX_COL)
    return split_filter(merged, split_col)


def indexed_labels(abstracts: DataFrame, labels: DataFrame, key: str = "PMID") -> DataFrame:
    """A row for each row of the merged table, without the texts: the label
    columns, ``_lf_copy`` (which of the id's abstracts) and the position.

    Positions follow the id, then the copy, then the label values. Only ids
    and label rows are joined and range-shuffled here.
    """
    copies = abstracts.select(key).groupBy(key).agg(F.count(F.lit(1)).alias("_lf_n"))
    rows = (labels.join(copies, key)
            .withColumn("_lf_copy", F.explode(F.sequence(F.lit(1), F.col("_lf_n")))).drop("_lf_n"))
    order = [qcol(key), F.col("_lf_copy"), F.xxhash64(*[qcol(c) for c in labels.columns])]
    return with_row_index(rows, order, INDEX_COL)


def indexed_join(abstracts: DataFrame, indexed: DataFrame, key: str = "PMID") -> DataFrame:
    """The merged rows: each abstract of an id is numbered in the order of its
    content and meets the rows of its number. Numbering and join share one
    hash partitioning on the id, so the texts are shuffled once."""
    content = F.xxhash64(*[qcol(c) for c in abstracts.columns])
    numbered = abstracts.withColumn(
        "_lf_place", F.row_number().over(Window.partitionBy(key).orderBy(content)).cast("long"))
    other = indexed.withColumnRenamed(key, "_lf_key")
    # a difference, not an equality of two columns: the id stays the only join key
    joined = numbered.join(other, (qcol(key) == F.col("_lf_key")) & (F.col("_lf_place") - F.col("_lf_copy") == 0))
    return joined.drop("_lf_key", "_lf_place", "_lf_copy")


def build_binary(abstracts: DataFrame, binary_labels: DataFrame, spec: LabelSpec,
                 key: str = "PMID", with_index: bool = True) -> DataFrame:
    return build_labelled(abstracts, binary_labels, spec, key, with_index=with_index)


def build_soft(abstracts: DataFrame, soft_labels: DataFrame, spec: LabelSpec,
               key: str = "PMID", with_index: bool = True) -> DataFrame:
    return build_labelled(abstracts, soft_labels, spec, key, with_index=with_index)


# X3 / J2 / F7 / F18 ---------------------------------------------------------
def hypothesis_rows(spec: LabelSpec) -> Column:
    """The hypothesis table as an inline array of structs (2 per label).

    It is a fixed configuration of a few rows, so it travels inside the plan;
    expanding with ``inline`` avoids a join altogether.
    """
    rows = []
    for h in spec.hypotheses:
        for positive, text in ((True, h.positive), (False, h.negative)):
            rows.append(F.struct(F.lit(h.label_name).alias("_lf_label"),
                                 F.lit(h.label_idx).cast("long").alias("Label_idx"),
                                 F.lit(positive).alias("Positive"),
                                 F.lit(text).alias("Hypothesis")))
    return F.array(*rows)


def build_nli(binary: DataFrame, spec: LabelSpec, key: str = "PMID",
              keep: list[str] | None = None) -> DataFrame:
    """Each labelled row → one premise/hypothesis row per (label, polarity).

    Entailment is the label value for the positive hypothesis and ``int(not
    value)`` for the negative one. The label value is picked from the packed
    vector by index, so no per-label column lookup is needed.
    """
    if not spec.hypotheses:
        raise ValueError("the label set has no hypothesis sentences to pair with")
    keep = keep if keep is not None else [c for c in ("Title", "Abstract", SPLIT_NAME)
                                          if c in binary.columns]
    expanded = binary.select(key, *keep, "label",
                             F.inline(hypothesis_rows(spec)))
    value = F.element_at(F.col("label"), F.col("Label_idx").cast("int") + 1)
    entail = F.when(F.col("Positive"), value).otherwise(negate_label(value))
    return expanded.select(key, *[c for c in keep if c != SPLIT_NAME], "Hypothesis",
                           entail.alias("Entailment"), "Positive", "Label_idx",
                           *([SPLIT_NAME] if SPLIT_NAME in keep else []))


def build_all(abstracts: DataFrame, binary_labels: DataFrame, soft_labels: DataFrame,
              spec: LabelSpec, out_dir: str, key: str = "PMID") -> dict[str, str]:
    """X4: binary, soft and NLI datasets, each split-partitioned.

    The texts of a Parquet corpus are read and shuffled once (land a CSV as
    Parquet first: a CSV is parsed anew by every scan, also of its ids): the
    binary and soft label rows (same columns, each with its row position
    computed on ids only) are tagged and unioned, joined with the abstracts in
    ONE join, and written partitioned by (dataset, split). The NLI set is
    expanded from the written binary set (lineage cut there).
    """
    labelled = f"{out_dir}/labelled"
    paths = {"binary": f"{labelled}/dataset=binary", "soft": f"{labelled}/dataset=soft",
             "nli": f"{out_dir}/nli_dataset"}
    tagged = (indexed_labels(abstracts, binary_labels, key).withColumn("dataset", F.lit("binary"))
              .unionByName(indexed_labels(abstracts, soft_labels, key).withColumn("dataset", F.lit("soft"))))
    merged = with_label_vector(indexed_join(abstracts, tagged, key), spec.labels)
    merged = merged.select(*[c for c in merged.columns if c not in (INDEX_COL, "dataset")],
                           INDEX_COL, "dataset")
    split_filter(merged).write.mode("overwrite").partitionBy("dataset", SPLIT_NAME).parquet(labelled)
    if not spec.hypotheses:          # a label set without hypothesis sentences has no NLI form
        del paths["nli"]
        return paths
    written = abstracts.sparkSession.read.parquet(paths["binary"])
    build_nli(written, spec, key).write.mode("overwrite").partitionBy(SPLIT_NAME).parquet(paths["nli"])
    return paths


def labels_by_name(df: DataFrame, label_cols: list[str]) -> DataFrame:
    """O2: label names in alphabetical order with their positive counts
    (the vector itself keeps file order)."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("label_name"), qcol(c).cast("double").alias("y")) for c in label_cols])))
    agg = long.groupBy("label_name").agg(F.sum("y").alias("positives"))
    return agg.orderBy("label_name")


def nli_summary(nli: DataFrame) -> DataFrame:
    """Count and entailment rate per (split, label, polarity)."""
    return (nli.groupBy(SPLIT_NAME, "Label_idx", "Positive")
               .agg(F.count(F.lit(1)).alias("n_pairs"),
                    F.round(F.avg("Entailment"), 6).alias("entail_rate")))
