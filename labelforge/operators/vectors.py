"""Label-attention table operators over embedding vectors.

The label side (C label vectors) is a few rows; no N×C join or shuffle is ever
planned. Two ways to score every row against all C labels inside its own task:

* ``method="arrow"`` (default): the C×D label matrix is cut into blocks of at
  most ``BLOCK_BYTES``, each broadcast and scored by an Arrow-batched pandas
  UDF with one matrix product a batch; the blocks' scores are joined in label
  order. Vector arithmetic in higher-order SQL functions is interpreted per
  element, so for embedding widths this is one to two orders of magnitude
  faster.
* ``method="sql"``: the label vectors are folded into ONE value (array of
  structs) by a scalar subquery and scored with built-in higher-order
  functions; no Python. The fold's size is checked before it is built: beyond
  ``BLOCK_BYTES`` this method refuses and names the other one.

A null vector scores null. Vectors of different widths are a named error
(``WidthError``), never cut to one of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.vectors import cosine, dot, floored_norm
from labelforge.schemas import NORM_EPS

BLOCK_BYTES = 64 << 20


class WidthError(ValueError):
    """Vectors that should have one width have several."""


# Arrow path -------------------------------------------------------------------
class _Inline:
    """Stand-in for a broadcast variable: the value travels with the UDF."""

    def __init__(self, value):
        self.value = value


class LabelMatrix:
    """C label vectors (ids ascending) as broadcast numpy matrices of bounded size."""

    def __init__(self, label_vectors: DataFrame, vec_col: str = "vec", bias_col: str | None = None,
                 block_bytes: int = BLOCK_BYTES):
        cols = [F.col("label_idx").cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v")]
        if bias_col:
            cols.append(F.col(bias_col).cast("double").alias("b"))
        named = label_vectors.select(*cols)
        self.dim = vector_dim(named, "v")
        per_block = max(1, block_bytes // (8 * max(self.dim, 1)))
        self.ids, self._blocks, held = [], [], []
        # one partition of the sorted table after the other reaches the driver
        for r in named.orderBy("i").toLocalIterator():
            held.append(r)
            if len(held) == per_block:
                self._add(label_vectors, held, bias_col)
                held = []
        if held or not self._blocks:
            self._add(label_vectors, held, bias_col)
        self.ids = np.array(self.ids, dtype=np.int64)

    def _add(self, label_vectors: DataFrame, rows: list, bias_col: str | None) -> None:
        w = np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), self.dim)
        b = np.array([r.b for r in rows], dtype=np.float64) if bias_col else np.zeros(len(rows))
        self.ids += [r.i for r in rows]
        try:
            self._blocks.append(label_vectors.sparkSession.sparkContext.broadcast((w, b)))
        except Exception:  # remote session without a context: ship with the function
            self._blocks.append(_Inline((w, b)))

    def scores(self, vec: Column, kind: str = "cosine", eps: float = NORM_EPS) -> Column:
        """array<double> per row, label order: ``cosine``, ``linear`` (x·w + b)
        or ``attended`` (linear × cosine); null for a null vector."""
        parts = [self._block_scores(bc, vec, kind, eps) for bc in self._blocks]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def _block_scores(self, bc, vec: Column, kind: str, eps: float) -> Column:
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def score(v: pd.Series) -> pd.Series:
            w, b = bc.value
            known = v.notna().to_numpy()
            if not known.any():
                return pd.Series([None] * len(v), dtype=object)
            widths = {len(a) for a in v[known]}
            if widths != {dim}:
                raise WidthError(f"vectors of width {sorted(widths)} against label vectors of width {dim}")
            x = np.stack(v[known].to_numpy()).astype(np.float64)
            raw = x @ w.T
            if kind == "linear":
                out = raw + b
            else:
                nx = np.maximum(np.linalg.norm(x, axis=1), eps)[:, None]
                nw = np.maximum(np.linalg.norm(w, axis=1), eps)[None, :]
                cos = raw / (nx * nw)
                out = cos if kind == "cosine" else (raw + b) * cos
            scored = iter(out)
            return pd.Series([next(scored) if k else None for k in known], dtype=object)

        # declared nondeterministic so the optimizer never copies the call into
        # a pushed-down or inferred filter (that would run the batch twice)
        return score.asNondeterministic()(vec)

    def label_ids(self) -> Column:
        return F.array(*[F.lit(int(i)).cast("long") for i in self.ids])

    def nearest(self, vec: Column, eps: float = NORM_EPS) -> Column:
        """Label id with the highest cosine (ties → lower id); null for a null vector."""
        cs = self.scores(vec, "cosine", eps)
        return F.when(vec.isNotNull(), F.element_at(self.label_ids(), F.array_position(cs, F.array_max(cs)).cast("int")))

    def long_form(self, df: DataFrame, key: str, vec_col: str, kind: str = "cosine",
                  name: str = "score") -> DataFrame:
        scored = df.select(key, F.arrays_zip(self.label_ids().alias("label_idx"),
                                             self.scores(F.col(vec_col), kind).alias(name)).alias("z"))
        return scored.select(key, F.inline("z"))


def vector_dim(df: DataFrame, vec_col: str) -> int:
    """The width that all non-null vectors have (one aggregation over all rows; 0 without vectors)."""
    w = F.when(F.col(vec_col).isNotNull(), F.size(vec_col))
    low, high = df.agg(F.min(w), F.max(w)).first()
    if low != high:
        raise WidthError(f"column {vec_col!r} holds vectors of width {low} to {high}")
    return int(low or 0)


# V5 -------------------------------------------------------------------------
def label_prototypes(df: DataFrame, vec_col: str, label_col: str,
                     dim: int | None = None) -> DataFrame:
    """Element-wise mean vector per label: (label_idx, vec).

    With the width known, one grouped aggregation keeps ``dim`` running sums
    per label (partial-aggregated map-side, so a label holding a third of the
    rows costs nothing extra); otherwise positions are exploded and averaged.
    A vector of another width than ``dim`` is an error; null vectors and
    labels of no vector are left out.
    """
    df = df.filter(F.col(vec_col).isNotNull())
    v = F.col(vec_col).cast("array<double>")
    if dim is not None:
        v = F.when(F.size(vec_col) == dim, v).otherwise(
            F.raise_error(F.concat(F.lit(f"a vector of another width than {dim}: "), F.size(vec_col).cast("string"))))
        agg = df.groupBy(F.col(label_col).alias("label_idx")).agg(
            *[F.avg(v[i]).alias(f"_m{i}") for i in range(dim)])
        return agg.select("label_idx", F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("vec"))
    long = df.select(F.col(label_col).alias("label_idx"), F.posexplode(v).alias("pos", "x"))
    means = long.groupBy("label_idx", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("label_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))),
                    lambda s: s["m"]).alias("vec"))


def folded_labels(label_vectors: DataFrame, vec_col: str = "vec",
                  extra: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> Column:
    """All label vectors as one array<struct> value (scalar subquery)."""
    n, dim = label_vectors.count(), vector_dim(label_vectors, vec_col)
    if n * dim * 8 > block_bytes:
        raise ValueError(f"{n} label vectors of width {dim} are too large to fold; use method='arrow'")
    fields = [F.col("label_idx").cast("long").alias("label_idx"),
              F.col(vec_col).cast("array<double>").alias("vec"),
              floored_norm(F.col(vec_col).cast("array<double>")).alias("norm")]
    fields += [F.col(c) for c in (extra or [])]
    folded = label_vectors.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("labels"))
    return folded.scalar()


def attach_labels(df: DataFrame, label_vectors: DataFrame, name: str = "_lf_labels",
                  extra: list[str] | None = None) -> DataFrame:
    """Add the folded label vectors as a column (higher-order functions cannot
    hold a subquery themselves, so they read this column)."""
    return df.withColumn(name, folded_labels(label_vectors, extra=extra))


# V1 -------------------------------------------------------------------------
def vector_norms(df: DataFrame, vec_col: str, eps: float = NORM_EPS) -> Column:
    return floored_norm(F.col(vec_col).cast("array<double>"), eps)


# V2 -------------------------------------------------------------------------
def cosine_scores(vec: Column, labels: Column, eps: float = NORM_EPS) -> Column:
    """array<double> of cosine similarities to every label, label order."""
    v = vec.cast("array<double>")
    nv = floored_norm(v, eps)
    return F.transform(labels, lambda lab: cosine(v, lab["vec"], eps, nv, lab["norm"]))


def cosine_label_matrix(df: DataFrame, key: str, vec_col: str,
                        label_vectors: DataFrame, method: str = "arrow") -> DataFrame:
    """Long form (key, label_idx, cosine) of the N×C similarity matrix."""
    if method == "arrow":
        return LabelMatrix(label_vectors).long_form(df, key, vec_col, "cosine", "cosine")
    labels = F.col("_lf_labels")
    scored = attach_labels(df, label_vectors).select(key, F.arrays_zip(
        F.transform(labels, lambda lab: lab["label_idx"]).alias("label_idx"),
        cosine_scores(F.col(vec_col), labels).alias("cosine")).alias("z"))
    # outer: a plain inline would get an inferred "size(...) > 0" filter that
    # runs the whole scoring a second time
    return scored.select(key, F.inline_outer("z"))


# V3 -------------------------------------------------------------------------
def linear_scores(vec: Column, weights: Column) -> Column:
    """x·w + b per label; ``weights`` is folded with a ``b`` field."""
    v = vec.cast("array<double>")
    return F.transform(weights, lambda w: dot(v, w["vec"]) + w["b"])


# V4 -------------------------------------------------------------------------
def label_attended_scores(vec: Column, weights: Column, eps: float = NORM_EPS) -> Column:
    """Linear score × cosine to the label vector, element-wise (label order)."""
    v = vec.cast("array<double>")
    nv = floored_norm(v, eps)
    return F.transform(weights, lambda w: (dot(v, w["vec"]) + w["b"])
                       * cosine(v, w["vec"], eps, nv, w["norm"]))


# V6 -------------------------------------------------------------------------
def nearest_label(vec: Column, labels: Column, eps: float = NORM_EPS) -> Column:
    """Label with the highest cosine; ties go to the lower label id."""
    cs = cosine_scores(vec, labels, eps)
    return F.element_at(labels, F.array_position(cs, F.array_max(cs)).cast("int"))["label_idx"]
