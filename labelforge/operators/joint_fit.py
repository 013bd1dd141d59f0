"""One-pass fits (V7, T3): every label and every trial from the same scans.

A search over T trials of C labels is T * C logistic regressions on the same rows.
Fitted one by one each of them scans the rows once an iteration. Here all of them
go through a scan together: a pass sends the coefficients of every model to the
tasks, and each task returns one gradient block for all of them, summed by Spark in
blocks of features. The number of passes is that of the slowest model, whatever
the number of labels and trials.

The objective is that of ``LogisticRegression`` with an L2 penalty on standardised
features: mean log-loss plus ``regParam / 2 * sum((coef * std)^2)``, no penalty on
the intercept. Fractional labels count as they are; rows whose label is null or
NaN are left out of that label's models.

``population_search`` adds exploit and explore: between generations of passes the
worst trials take over the coefficients of the best and go on with a changed
penalty; its decisions come out as a policy log (T5, T6).

Sizes: features x models coefficients are sent to the tasks and come back once a
pass; more than ``MAX_CELLS`` are refused. Rows stay in a written table.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.session import work_path

MAX_CELLS, BLOCK, HISTORY = 16 << 20, 4096, 8
#: Entries (tokens) of the rows that a task works on at once; a longer row goes alone.
ENTRIES = 1 << 16
#: Partial sums of a block of features that one task adds up at once.
FAN_IN = 32


def hashed_terms(text: Column, num_features: int) -> Column:
    """Places of the white-space tokens (lower case), one entry a token."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")
    return F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(num_features)).cast("int"))


@dataclass
class Rows:
    """Training rows as a written table ``places, y`` and the weight of each place (its IDF)."""
    table: DataFrame
    weights: np.ndarray
    n_labels: int


def prepare(df: DataFrame, text_col: str, label_col: str, n_labels: int, num_features: int = 1 << 18, weights: np.ndarray | None = None) -> Rows:
    spark, path = df.sparkSession, work_path(df.sparkSession, "joint-rows")
    target = F.transform(F.slice(F.col(label_col).cast("array<double>"), 1, n_labels), lambda y: F.when(~F.isnan(y), y))
    df.select(hashed_terms(F.col(text_col), num_features).alias("places"), target.alias("y")).write.parquet(path)
    table = spark.read.parquet(path)
    wrong = table.select(F.explode("y").alias("y")).where("y < 0 OR y > 1").limit(1).collect()
    if wrong:
        raise ValueError(f"a label outside 0 to 1: {wrong[0].y}")
    if weights is None:
        n = table.count()
        counts = table.select(F.explode(F.array_distinct("places")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        weights = np.full(num_features, np.log(n + 1.0))
        for r in counts.collect():                                     # at most num_features rows
            weights[r.p] = np.log((n + 1.0) / (r.n + 1.0))
    return Rows(table, weights, n_labels)


def _sparse(places: pd.Series, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the rows' TF-IDF entries."""
    lengths = [0 if p is None else len(p) for p in places]
    row = np.repeat(np.arange(len(places)), lengths)
    flat = np.concatenate([np.asarray(p, np.int64) for p in places if p is not None and len(p)] or [np.zeros(0, np.int64)])
    code, count = np.unique(row * len(weights) + flat, return_counts=True)
    row, place = np.divmod(code, len(weights))
    return row, place, count * weights[place]


def _targets(y: pd.Series, n_labels: int) -> np.ndarray:
    out = np.full((len(y), n_labels), np.nan)
    for i, v in enumerate(y):
        if v is not None:
            out[i, :min(len(v), n_labels)] = [np.nan if x is None else x for x in list(v)[:n_labels]]
    return out


def _slices(places: pd.Series) -> Iterator[slice]:
    """Slices of the rows, in order, with at most ``ENTRIES`` places together (at least one row)."""
    first, total = 0, 0
    for i, p in enumerate(places):
        n = 0 if p is None else len(p)
        if i > first and total + n > ENTRIES:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(places):
        yield slice(first, len(places))


def _summed(table: DataFrame, per_batch, width: int, n_extra: int, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """(features x width, n_extra) sums over all rows: a task adds its batches up, a slice of bounded size at a
    time, and sends the blocks that it touched; these are added up ``FAN_IN`` tasks at a time, then all."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, extra, seen = np.zeros((n_features, width)), np.zeros(n_extra), False
        for batch in batches:
            for part in _slices(batch["places"]):
                seen = True
                row_sums, more = per_batch(batch.iloc[part])
                extra += more
                for place, values in row_sums:
                    touched, at = np.unique(place, return_inverse=True)
                    for k in range(width):
                        total[touched, k] += np.bincount(at, weights=values[:, k], minlength=len(touched))
        if seen:
            blocks = [b for b in range(0, n_features, BLOCK) if total[b:b + BLOCK].any()]
            part = TaskContext.get().partitionId() // FAN_IN
            yield pd.DataFrame({"block": [-1, *blocks], "part": part, "sums": [extra.tobytes(), *[total[b:b + BLOCK].tobytes() for b in blocks]]})

    def add(given: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(s) for s in given["sums"])
        return pd.DataFrame({"block": given["block"].iloc[:1], "sums": [sums.tobytes()]})

    made = table.mapInPandas(partial, "block long, part long, sums binary").groupBy("block", "part").applyInPandas(add, "block long, sums binary")
    made = made.groupBy("block").applyInPandas(add, "block long, sums binary")
    total, extra = np.zeros((n_features, width)), np.zeros(n_extra)
    for r in made.collect():                                           # features x width numbers, checked by the caller
        if r.block < 0:
            extra += np.frombuffer(r.sums)
        else:
            part = np.frombuffer(r.sums).reshape(-1, width)
            total[r.block:r.block + len(part)] += part
    return total, extra


def _moments(rows: Rows) -> np.ndarray:
    """The standard deviation of each feature over all rows (1 where it is constant)."""
    weights = rows.weights

    def batch(given: pd.DataFrame):
        row, place, value = _sparse(given["places"], weights)
        return [(place, np.stack([value, value * value], axis=1))], np.array([len(given), 0.0])

    sums, extra = _summed(rows.table, batch, 2, 2, len(weights))
    n = max(extra[0], 1.0)
    spread = np.maximum((sums[:, 1] - sums[:, 0] ** 2 / n) / max(n - 1, 1), 0)
    return np.where(spread > 0, np.sqrt(spread), 1.0)


@dataclass
class Joint:
    """The state of all models: ``w`` (features x models, on standardised features) and ``b``."""
    rows: Rows
    penalties: np.ndarray                                              # of each trial
    std: np.ndarray
    w: np.ndarray = field(default=None)
    b: np.ndarray = field(default=None)
    passes: int = 0

    @property
    def n_models(self) -> int:
        return len(self.penalties) * self.rows.n_labels

    def evaluate(self, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(loss, gradient of w, gradient of b) of every model, from one pass over the rows."""
        weights, std, labels, models = self.rows.weights, self.std, self.rows.n_labels, self.n_models
        scaled = w / std[:, None]

        def batch(given: pd.DataFrame):
            row, place, value = _sparse(given["places"], weights)
            z = np.tile(b, (len(given), 1))
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                z[row[first]] += np.add.reduceat(scaled[place] * value[:, None], first, axis=0)
            y = np.tile(_targets(given["y"], labels), (1, models // labels))
            known = ~np.isnan(y)
            y = np.where(known, y, 0)
            loss = np.where(known, np.logaddexp(0, z) - y * z, 0).sum(axis=0)
            slope = np.where(known, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0)
            part = np.concatenate([loss, slope.sum(axis=0), known.sum(axis=0)])
            return [(place, slope[row] * value[:, None])], part

        self.passes += 1
        total, extra = _summed(self.rows.table, batch, models, 3 * models, len(weights))
        loss, slope_b, n = extra[:models], extra[models:2 * models], np.maximum(extra[2 * models:], 1)
        ridge = np.repeat(self.penalties, labels)
        return (loss / n + 0.5 * ridge * (w * w).sum(axis=0), total / std[:, None] / n + ridge * w, slope_b / n)


def start(rows: Rows, penalties: list[float]) -> Joint:
    cells = len(rows.weights) * len(penalties) * rows.n_labels
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} coefficients in one pass; at most {MAX_CELLS}: use fewer features or trials")
    joint = Joint(rows, np.array(penalties, float), _moments(rows))
    joint.w, joint.b = np.zeros((len(rows.weights), joint.n_models)), np.zeros(joint.n_models)
    return joint


def optimise(joint: Joint, passes: int, tolerance: float = 1e-7) -> Joint:
    """At most ``passes`` passes of L-BFGS for all models side by side.

    A pass is one evaluation at a point of each model's own: a new direction for
    models whose last step was good, a shorter step for the others, nothing new for
    those that have settled.
    """
    def packed(w, b):
        return np.concatenate([w, b[None]])

    x = packed(joint.w, joint.b)
    f, gw, gb = joint.evaluate(joint.w, joint.b)
    g, models = packed(gw, gb), joint.n_models
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(models)]
    move, scale, done = np.zeros_like(x), np.ones(models), np.zeros(models, bool)

    def aim(k: int) -> None:
        q, alphas = g[:, k].copy(), []
        for s, y in reversed(past[k]):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= (past[k][-1][0] @ past[k][-1][1]) / (past[k][-1][1] @ past[k][-1][1]) if past[k] else min(1.0, 1 / max(np.linalg.norm(q), 1e-12))
        for (s, y), a in zip(past[k], reversed(alphas)):
            q += s * (a - (y @ q) / (s @ y))
        move[:, k], scale[k] = -q, 1.0

    for k in range(models):
        aim(k)
    for _ in range(passes - 1):
        if done.all():
            break
        tried = x + move * np.where(done, 0, scale)
        ft, gw, gb = joint.evaluate(tried[:-1], tried[-1])
        gt = packed(gw, gb)
        for k in np.flatnonzero(~done):
            if ft[k] > f[k] + 1e-4 * scale[k] * (g[:, k] @ move[:, k]):
                scale[k] /= 2
                if scale[k] < 1e-10:
                    done[k] = True
                continue
            s, y = tried[:, k] - x[:, k], gt[:, k] - g[:, k]
            if s @ y > 1e-12 * (y @ y):
                past[k] = [*past[k], (s, y)][-HISTORY:]
            done[k] = abs(f[k] - ft[k]) <= tolerance * 1e-3 * max(abs(f[k]), 1e-12) or np.abs(gt[:, k]).max() <= tolerance
            x[:, k], f[k], g[:, k] = tried[:, k], ft[k], gt[:, k]
            aim(k)
    joint.w, joint.b = x[:-1], x[-1]
    return joint


@dataclass
class JointModel:
    """Coefficients (features x models) and intercepts; models of a trial side by side, in label order."""
    coefficients: np.ndarray
    intercepts: np.ndarray
    weights: np.ndarray
    n_labels: int

    def scores(self, df: DataFrame, text_col: str, name: str = "scores", trial: int = 0) -> DataFrame:
        """Adds ``name``: P(label) of each label by the models of ``trial``."""
        chosen = slice(trial * self.n_labels, (trial + 1) * self.n_labels)
        w, b, weights = self.coefficients[:, chosen], self.intercepts[chosen], self.weights

        @F.pandas_udf("array<double>")
        def score(places: pd.Series) -> pd.Series:
            z = np.tile(b, (len(places), 1))
            for part in _slices(places):
                row, place, value = _sparse(places.iloc[part], weights)
                if len(row):
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    z[part.start + row[first]] += np.add.reduceat(w[place] * value[:, None], first, axis=0)
            return pd.Series(list(1 / (1 + np.exp(-np.clip(z, -500, 500)))))

        return df.withColumn(name, score(hashed_terms(F.col(text_col), len(weights))))


def model_of(joint: Joint) -> JointModel:
    return JointModel(joint.w / joint.std[:, None], joint.b, joint.rows.weights, joint.rows.n_labels)


def fit_joint(train: DataFrame, text_col: str, label_col: str, n_labels: int, reg_params: list[float], passes: int = 60,
              num_features: int = 1 << 16, tolerance: float = 1e-7) -> JointModel:
    """The models of every label and every penalty, from at most ``passes`` scans of the training rows (and two to prepare)."""
    return model_of(optimise(start(prepare(train, text_col, label_col, n_labels, num_features), reg_params), passes, tolerance))


def trial_losses(joint: Joint, held: Rows) -> np.ndarray:
    """The mean log-loss of each trial over its labels on the rows of ``held``, one pass for all."""
    plain = Joint(held, np.zeros(len(joint.penalties)), joint.std)
    loss, _, _ = plain.evaluate(joint.w, joint.b)
    return loss.reshape(len(joint.penalties), -1).mean(axis=1)


POLICY = "generation int, value string"


def population_search(train: DataFrame, valid: DataFrame, text_col: str, label_col: str, n_labels: int, n_trials: int = 8, generations: int = 4,
                      passes: int = 6, low: float = 1e-4, high: float = 0.3, seed: int = 42, resample: float = 0.25,
                      num_features: int = 1 << 14) -> tuple[DataFrame, DataFrame, JointModel]:
    """(results, policy log, models): a search in which the worst quarter of the trials goes on from the best quarter.

    ``results``: a row a generation and trial with its ``regParam`` and validation
    loss. ``policy``: a line a decision, as ``trials.parse_policy_lines`` reads it:
    target and source trial, their iterations, the old and the new configuration
    (the penalty, as ``weight_decay``, times 0.8 or 1.2, or drawn anew).
    """
    rnd, spark = random.Random(seed), train.sparkSession
    rows = prepare(train, text_col, label_col, n_labels, num_features)
    held = prepare(valid, text_col, label_col, n_labels, num_features, rows.weights)

    def draw() -> float:
        return float(np.exp(rnd.uniform(np.log(low), np.log(high))))

    joint = start(rows, [draw() for _ in range(n_trials)])
    results, policy, quarter = [], [], max(1, n_trials // 4)
    for generation in range(generations):
        optimise(joint, passes)
        losses = trial_losses(joint, held)
        results += [(generation, t, float(joint.penalties[t]), float(losses[t]), (generation + 1) * passes) for t in range(n_trials)]
        if generation + 1 == generations:
            break
        order = np.argsort(losses, kind="stable").tolist()
        for target, source in zip(order[-quarter:], order[:quarter]):
            if target == source:
                continue
            before = float(joint.penalties[target])
            after = draw() if rnd.random() < resample else float(joint.penalties[source]) * rnd.choice((0.8, 1.2))
            for k in range(n_labels):
                joint.w[:, target * n_labels + k] = joint.w[:, source * n_labels + k]
                joint.b[target * n_labels + k] = joint.b[source * n_labels + k]
            old = {"weight_decay": float(joint.penalties[source])}
            joint.penalties[target] = after
            at = (generation + 1) * passes
            policy.append((generation, json.dumps([f"t{target:05d}", f"t{source:05d}", at, at, old | {"replaced": before}, {"weight_decay": after}])))
    made = spark.createDataFrame(results, "generation int, trial int, regParam double, eval_loss double, training_iteration int")
    return made, spark.createDataFrame(policy, POLICY), model_of(joint)
