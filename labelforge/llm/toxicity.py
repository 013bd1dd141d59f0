"""Operator 4: toxicity by a classifier chain.

Categories are predicted one after the other; each linear model (logistic
regression with an L2 penalty, fitted by Newton's method) reads the words of a
text and the probabilities of the categories before it. In training these
probabilities are out-of-fold predictions, so later models learn from the
errors that earlier models make on texts they have not seen.

The label table has one toxicity column. It is the last category of the chain;
the earlier ones are the label restricted to texts that hold a word of the
category's list (a general lexicon, ``CATEGORY_TERMS``), so the chain learns
kinds of toxicity first and the label from them. Other label columns can be
given as categories directly.

* Training sample: at most ``SAMPLE_ROWS`` labelled texts of lowest id hash (a
  documented bound; everything else covers all rows). A text is held as the
  distinct 64-bit hashes of its words. A fit is one task per fold.
* Each fit selects ``FEATURES`` words by chi-squared on its own rows.
* The cutoff on the last probability catches the most texts that out-of-fold
  scores allow at a precision of ``PRECISION``, so clean texts are left alone.
* Scoring is a vectorised UDF over whole texts; the model is a table of at
  most ``FEATURES`` times the number of categories weights.

Edge cases: null and empty texts have no words and are scored by the
intercepts; labels other than 0 and 1 and null ids are left out, of several
labels of one id the highest counts; with no labelled row, or none of a
category, that category's probability is near 0 and nothing is rejected by
it; repeated rows score alike; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.common import hash_sample, written

SAMPLE_ROWS, FEATURES, FOLDS, PENALTY, PRECISION = 10_000, 512, 3, 1.0, 0.95

#: Words of the earlier categories (fixed values).
CATEGORY_TERMS = {
    "insult": ("bastard", "clown", "coward", "cretin", "dimwit", "dumb", "fool", "idiot", "imbecile", "jerk", "loser",
               "moron", "stupid"),
    "degradation": ("disgusting", "filth", "garbage", "inferior", "pathetic", "repulsive", "rubbish", "scum", "subhuman",
                    "trash", "useless", "vermin", "worthless"),
}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def hashes_of(words: set[str]) -> np.ndarray:
    import xxhash
    return np.sort(np.fromiter((xxhash.xxh3_64_intdigest(w) >> 1 for w in words), np.int64, len(words)))


def fit(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, features: int = FEATURES,
        penalty: float = PENALTY) -> dict:
    """A logistic regression on the presence of words and on earlier probabilities.

    Returns ``words`` (hashes), ``weights`` (theirs), ``chain`` (of the earlier
    probabilities) and ``bias``.
    """
    n, pos = len(y), float(y.sum())
    if pos == 0 or pos == n:
        bias = float(np.log((pos + 0.01) / (n - pos + 0.01))) if n else -10.0
        return {"words": np.zeros(0, np.int64), "weights": np.zeros(0), "chain": np.zeros(earlier.shape[1]), "bias": bias}
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate(rows) if len(owner) else np.zeros(0, np.int64)
    words, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    hit = np.bincount(at, weights=y[owner], minlength=len(words))
    expected = seen * (pos / n)
    spread = expected * (1 - pos / n) * (n - seen) / max(n - 1, 1)
    chi = np.where((seen >= 3) & (spread > 0), (hit - expected) ** 2 / np.maximum(spread, 1e-12), 0)
    chosen = np.sort(np.lexsort((words, -chi))[:features])
    chosen = chosen[chi[chosen] > 0]
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    k, c = len(chosen), earlier.shape[1]
    x = np.zeros((n, k + c + 1))
    keep = place[at] >= 0
    x[owner[keep], place[at][keep]] = 1
    x[:, k:k + c] = earlier
    x[:, -1] = 1
    ridge = np.full(k + c + 1, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(k + c + 1)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (ridge * v * v).sum())

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        scale = 1.0
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        w, before, now = w - scale * step, now, loss(w - scale * step)
        if before - now < 1e-7 * max(before, 1):
            break
    return {"words": words[chosen], "weights": w[:k], "chain": w[k:k + c], "bias": float(w[-1])}


def predict(model: dict, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    z = earlier @ model["chain"] + model["bias"]
    if len(model["words"]):
        for i, r in enumerate(rows):
            at = np.searchsorted(model["words"], r)
            at[at == len(model["words"])] = 0
            z[i] += model["weights"][at[model["words"][at] == r]].sum()
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def best_cutoff(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The cutoff that catches most positives with at least ``precision``, halfway
    down to the next lower score. A small sample may have none: then the cutoff of
    the best F-measure; 0.5 without positives."""
    order = np.argsort(-p, kind="stable")
    hits, score = np.cumsum(y[order]), p[order]
    good = hits >= precision * np.arange(1, len(y) + 1)
    last = np.ones(len(y), bool)
    last[:-1] = score[:-1] != score[1:]               # equal scores fall together
    if not len(y) or not hits[-1]:
        return 0.5
    measure = np.where(good, hits, 0) if (good & last & (hits > 0)).any() else 2 * hits / (np.arange(1, len(y) + 1) + hits[-1])
    best = int(np.argmax(np.where(last, measure, -1)))
    return float((score[best] + (score[best + 1] if best + 1 < len(score) else 0)) / 2)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          terms: dict[str, Sequence[str]] = CATEGORY_TERMS, sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> dict:
    """The chain: ``categories`` (names), ``models`` (one each, in order) and ``cutoff``."""
    names = [*terms, label]
    marks = hash_sample(labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y")),
                        F.xxhash64(key), sample_rows, key)

    @F.pandas_udf("h binary, has array<boolean>")
    def features(texts: pd.Series) -> pd.DataFrame:
        words = [words_of(t) for t in texts]
        return pd.DataFrame({"h": [hashes_of(w).tobytes() for w in words],
                             "has": [[not w.isdisjoint(v) for v in terms.values()] for w in words]})

    # one text an id, so the sample stays bounded whatever repeats
    sample = (docs.select(key, F.col(text).alias("_t")).join(marks, key).groupBy(key)
              .agg(F.min("_t").alias("_t"), F.first("_y").alias("_y")))
    sample = written(sample.select(F.col(key).cast("string").alias("id"), F.pmod(F.xxhash64(key, F.lit(7)), F.lit(folds)).alias("part"),
                                   features("_t").alias("f"), "_y")
                     .select("id", "part", "f.h", F.concat(F.transform("f.has", lambda b: (b & (F.col("_y") == 1)).cast("int")),
                                                           F.array(F.col("_y").cast("int"))).alias("y")), "toxicity-sample")
    previous = None
    models, scores = [], None
    for c, name in enumerate(names):
        frame = sample if previous is None else sample.join(previous, "id")
        if previous is None:
            frame = frame.withColumn("earlier", F.array().cast("array<double>"))

        def fit_fold(given: pd.DataFrame) -> pd.DataFrame:
            given = given.sort_values("id")
            rows = [np.frombuffer(b, np.int64) for b in given.h]
            y = np.array([v[c] for v in given.y], float)
            earlier = np.array([list(e) for e in given.earlier], float).reshape(len(given), c)
            fold, part = int(given.fold.iloc[0]), given.part.to_numpy()
            inside, held = part != fold, part == fold
            model = fit([r for r, i in zip(rows, inside) if i], y[inside], earlier[inside])
            if fold == folds:                          # no part has this number: the model on all rows
                return pd.DataFrame({"id": [None], "earlier": [[]], "y": [0.0], "words": [model["words"].tolist()],
                                     "weights": [[*model["weights"], *model["chain"], model["bias"]]]})
            p = predict(model, [r for r, i in zip(rows, held) if i], earlier[held])
            # plain lists in object columns, also where a fold is empty
            lists = [[*map(float, e), float(v)] for e, v in zip(earlier[held], p)]
            nothing = pd.Series([None] * len(lists), dtype=object)
            return pd.DataFrame({"id": pd.Series(given.id[held].tolist(), dtype=object), "earlier": pd.Series(lists, dtype=object),
                                 "y": pd.Series(y[held], dtype=float), "words": nothing, "weights": nothing})

        made = written(frame.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds)))).groupBy("fold")
                       .applyInPandas(fit_fold, "id string, earlier array<double>, y double, words array<long>, weights array<double>"),
                       "toxicity-fold")
        whole = made.where("id IS NULL").first()
        if whole is None:                              # no labelled row at all
            models.append(fit([], np.zeros(0), np.zeros((0, c))))
            continue
        k = len(whole.words)
        models.append({"words": np.array(whole.words, np.int64), "weights": np.array(whole.weights[:k]),
                       "chain": np.array(whole.weights[k:-1]), "bias": whole.weights[-1]})
        previous = made.where("id IS NOT NULL").select("id", "earlier")
        scores = made.where("id IS NOT NULL")
    cutoff = 0.5
    if scores is not None:
        out = scores.select(F.element_at("earlier", -1).alias("p"), "y", "id").orderBy("id").collect()   # the bounded sample
        cutoff = best_cutoff(np.array([r.p for r in out]), np.array([r.y for r in out]))
    return {"categories": names, "models": models, "cutoff": cutoff}


def score(docs: DataFrame, chain: dict, text: str = "text", column: str = "toxicity") -> DataFrame:
    """``docs`` with the struct ``column``: ``p_<category>`` of each category and ``rejected``."""
    names, models, cutoff = chain["categories"], chain["models"], chain["cutoff"]
    table: dict[int, list[float]] = {}
    for c, m in enumerate(models):
        for word, weight in zip(m["words"].tolist(), m["weights"].tolist()):
            table.setdefault(word, [0.0] * len(models))[c] = weight
    schema = T.StructType([*[T.StructField(f"p_{n}", T.DoubleType()) for n in names], T.StructField("rejected", T.BooleanType())])

    @F.pandas_udf(schema)
    def judge(texts: pd.Series) -> pd.DataFrame:
        import xxhash
        digest, get = xxhash.xxh3_64_intdigest, table.get
        out = np.zeros((len(texts), len(models)))
        for i, t in enumerate(texts):
            # sums in a fixed order, so that equal texts score alike
            found = [w for h in sorted(digest(w) >> 1 for w in words_of(t)) if (w := get(h)) is not None]
            z = np.sum(np.array(found), axis=0) if found else np.zeros(len(models))
            for c, m in enumerate(models):
                out[i, c] = 1 / (1 + np.exp(-np.clip(z[c] + m["bias"] + out[i, :c] @ m["chain"], -500, 500)))
        made = pd.DataFrame(np.round(out, 9), columns=schema.names[:-1])
        made["rejected"] = out[:, -1] >= cutoff
        return made

    return docs.withColumn(column, judge(F.col(text)))


def judge_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the probability of each category and ``rejected``."""
    chain = train(docs, labels, key, text)
    return score(docs.select(key, F.col(text).alias("_text")), chain, "_text", "_tox").select(key, "_tox.*")
