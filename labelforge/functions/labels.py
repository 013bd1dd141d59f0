"""Column expressions over label vectors and scores (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qcol(name: str) -> Column:
    """Column by name; label names hold spaces and parentheses, so quote."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack_labels(label_cols: list[str]) -> Column:
    """Label columns (in file order) → array<double>."""
    return F.array(*[qcol(c).cast("double") for c in label_cols])


def label_columns_by_position(columns: list[str], first: int = 5) -> list[str]:
    """Label columns are everything from the sixth column of the merged table on."""
    return list(columns[first:])


def negate_label(y: Column) -> Column:
    """``int(not y)`` with Python truthiness: 0 → 1, any other value → 0.

    A missing or NaN value is truthy in Python, so its negation is 0 (Spark
    would cast NaN to true and null to null; guard both).
    """
    y = y.cast("double")
    return F.when(y.isNull() | F.isnan(y), F.lit(0.0)).otherwise((y == 0).cast("double"))


def threshold_scores(scores: Column, cut: float = 0.5) -> Column:
    """Strict ``> cut`` on raw scores → array<int> of 0/1. NaN and null → 0."""
    return F.transform(
        scores, lambda x: F.when((x > F.lit(cut)) & ~F.isnan(x), 1).otherwise(0))


def argmax(v: Column) -> Column:
    """Index (0-based) of the largest value, first on ties; NaN counts largest."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def decode_multi_hot(pred: Column, names: list[str]) -> Column:
    """Multi-hot 0/1 vector → list of label names, in vector order."""
    name_arr = F.array(*[F.lit(n) for n in names])
    picked = F.transform(
        F.arrays_zip(pred.alias("p"), name_arr.alias("n")),
        lambda z: F.when(z["p"] == 1, z["n"]))
    return F.filter(picked, lambda x: x.isNotNull())


def decode_class(idx: Column, names: list[str]) -> Column:
    """Class id → name (``element_at`` is 1-based)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), idx.cast("int") + 1)


def python_list_text(names: Column) -> Column:
    """Render a string array the way a Python list prints: ``['a', 'b']``; a
    name with an apostrophe is put in double quotes, with both in single quotes
    with the apostrophe escaped."""
    def shown(x: Column) -> Column:
        x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        one, two = F.contains(x, F.lit("'")), F.contains(x, F.lit('"'))
        return (F.when(one & ~two, F.concat(F.lit('"'), x, F.lit('"')))
                .otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    quoted = F.transform(names, shown)
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def split_of_key(key: Column) -> Column:
    """Deterministic Train/Validation/Test assignment used by the stand-in tables."""
    m = F.pmod(key, F.lit(10))
    return (F.when(m < 8, "Train").when(m == 8, "Validation").otherwise("Test"))
