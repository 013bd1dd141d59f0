"""Model tokens (F15-F17): sequences cut at the units a model counts.

The vocabulary is a public tokenizer's JSON file; its path is a parameter. It is
read once by the caller and sent to the tasks (a few MB), so executors need no
file of their own. Texts are encoded whole; null stays null. A token object takes
far more memory than its characters, so a task encodes ``CHUNK`` characters at a
time and keeps only what is asked for: ids as plain numbers, the first of them, or
their count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import effective_length

MAX_VOCABULARY_BYTES = 64 << 20
#: Characters (or token ids) that are in a tokenizer's hands at once; a longer text goes alone.
CHUNK = 1 << 18
_HELD: dict[int, object] = {}


def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer
    held = _HELD.get(hash(vocabulary))
    if held is None:
        held = Tokenizer.from_str(vocabulary)
        held.encode_special_tokens = True        # their strings in a text are ordinary text
        _HELD.clear()
        _HELD[hash(vocabulary)] = held
    return held


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} characters")
    return text


def _chunks(items: list, most: int) -> Iterator[list]:
    """The items in order, in lists of at most ``most`` characters or ids together (at least one item)."""
    held, total = [], 0
    for x in items:
        if held and total + len(x) > most:
            yield held
            held, total = [], 0
        held.append(x)
        total += len(x)
    if held:
        yield held


def _encoded(vocabulary: str, texts: pd.Series) -> Iterator[list[int] | None]:
    """The token ids of each text in turn; null: None."""
    tokenizer, known = _tokenizer(vocabulary), texts.notna().to_numpy()
    made = (e.ids for part in _chunks(texts[known].tolist(), CHUNK) for e in tokenizer.encode_batch(part, add_special_tokens=False))
    return (next(made) if k else None for k in known)


def encoder(vocabulary: str) -> Callable[[Column], Column]:
    """text → array of token ids."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else np.array(i, np.int32) for i in _encoded(vocabulary, texts)], dtype=object)
    return ids


def counter(vocabulary: str) -> Callable[[Column], Column]:
    """text → number of tokens; null: 0."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if i is None else len(i) for i in _encoded(vocabulary, texts)], dtype="int32")
    return count


def cutter(vocabulary: str, most: int) -> Callable[[Column], Column]:
    """text → ``n`` (its number of tokens) and ``ids`` (the first ``most`` of them); null: 0 and none."""
    @F.pandas_udf("n int, ids array<int>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        counts, ids = np.zeros(len(texts), np.int32), []
        for k, i in enumerate(_encoded(vocabulary, texts)):
            counts[k] = len(i or ())
            ids.append(np.array((i or [])[:most], np.int32))
        return pd.DataFrame({"n": counts, "ids": pd.Series(ids, dtype=object)})
    return cut


def decoder(vocabulary: str) -> Callable[[Column], Column]:
    """array of token ids → text."""
    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        tokenizer, known = _tokenizer(vocabulary), ids.notna().to_numpy()
        made = (t for part in _chunks(ids[known].tolist(), CHUNK)
                for t in tokenizer.decode_batch([np.asarray(i).tolist() for i in part], skip_special_tokens=False))
        return pd.Series([next(made) if k else None for k in known], dtype=object)
    return text


def with_subword_sequence(df: DataFrame, text_col: str, vocabulary: str, max_seq_length: int, first: int, last: int, pad: int) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask`` (both as long as the model takes at most), ``n_tokens`` and ``truncated``.

    A text is encoded once; a null text is an empty sequence.
    """
    n = effective_length(max_seq_length)
    if n < 2:
        raise ValueError("a sequence needs room for its first and last token")
    staged = df.withColumn("_lf_ids", cutter(vocabulary, n - 2)(F.col(text_col)))
    real = F.size("_lf_ids.ids") + 2
    spare = F.lit(n) - real
    return (staged.withColumn("n_tokens", F.col("_lf_ids.n"))
            .withColumn("input_ids", F.concat(F.array(F.lit(first)), F.col("_lf_ids.ids"), F.array(F.lit(last)), F.array_repeat(F.lit(pad), spare)))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), spare)))
            .withColumn("truncated", F.col("n_tokens") > n - 2).drop("_lf_ids"))


def truncation_rate(df: DataFrame, text_col: str, vocabulary: str, max_seq_length: int, *by: str) -> DataFrame:
    """``by, n, n_truncated, rate``: the share of texts that lose tokens, by group; only numbers are shuffled."""
    n = effective_length(max_seq_length)
    counted = df.select(*by, (counter(vocabulary)(F.col(text_col)) > n - 2).alias("over"))
    return counted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("over").cast("long")).alias("n_truncated"),
                                    F.avg(F.col("over").cast("double")).alias("rate"))
