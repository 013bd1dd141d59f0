"""Operator 7: licence scans by canonical digest lookup.

A text is brought into a canonical form - lower case, copyright lines dropped,
punctuation and blanks reduced to one space, equivalent spellings unified -
and its SHA-256 is joined with the digests of the known licences, whose texts
went through the same function. Whole documents are looked up, and so is every
line on its own, which finds one-line notices; digests are equal only if the
entire canonical texts are, so nothing is matched in part.

One Arrow pass computes the digests of a text and of its distinct lines, a row
each; these rows are hash-joined with the known digests (a table whose length
is checked, so Spark broadcasts it by its own size rule), unmatched lines go,
and what is left is merged per document with map-side aggregation. Texts are
never shuffled.

Edge cases: null, empty and blank texts have the empty canonical form, which
matches nothing; lines without a letter or digit are skipped; repeated rows
give repeated results; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelforge.llm.common import map_batches
from labelforge.llm.license_texts import DIGESTS, KNOWN, PAIRS, SPELLINGS

MAX_KNOWN = 100_000
_COPYRIGHT = re.compile(r"(?m)^[^\w\n]*(?:copyright\b(?=[^\n]*(?:\d{4}|\(c\)|©|<|\[))|\(c\)|©)[^\n]*$")
_WORD = re.compile(r"[^\W_]+")


def canonical(text: str | None) -> str:
    """The canonical form: unified words joined by single spaces."""
    low = (text or "").lower()
    if "copyright" in low or "(c)" in low or "©" in low:
        low = _COPYRIGHT.sub("", low)
    words = [SPELLINGS.get(w, w) for w in _WORD.findall(low)]
    out: list[str] = []
    for w in words:
        if out and (out[-1], w) in PAIRS:
            out[-1] = PAIRS[out[-1], w]
        else:
            out.append(w)
    return " ".join(out)


def digest(text: str | None) -> str | None:
    """SHA-256 of the canonical form (lower-case hex); null for the empty form."""
    form = canonical(text)
    return hashlib.sha256(form.encode()).hexdigest() if form else None


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN, key: str = "doc_id", text: str = "text",
         digests_known: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """``key, digest, license, n_notices, notices`` of every document.

    ``license`` is the licence whose entire text the document is (else null);
    ``notices`` the distinct licences that one of its lines names, in order,
    comma-joined (else empty), and ``n_notices`` the number of such lines.
    """
    if len(known) + len(digests_known) > MAX_KNOWN:
        raise ValueError(f"{len(known) + len(digests_known)} known texts; the lookup table is bounded to {MAX_KNOWN}")
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted({(digest(t), i) for i, t in known} | {(d, i) for i, d in digests_known}), "_digest string, _license string")
    table = table.where("_digest IS NOT NULL").groupBy("_digest").agg(F.min("_license").alias("_license"))

    def digests(given: Iterator[list]) -> Iterator[list]:
        for batch in given:
            out = []
            for i, t in batch:
                t = t or ""
                raw = hashlib.sha256(t.encode()).hexdigest()
                out.append((i, raw, digest(t), None))
                lines = Counter(d for line in t.split("\n") if (d := digest(line)))
                out += [(i, raw, d, n) for d, n in lines.items()]
            yield out

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, _raw string, digest string, _lines long"
    seen = map_batches(docs.select(key, text), digests, StructType.fromDDL(schema))
    whole = F.col("_lines").isNull()
    # the table has at most MAX_KNOWN rows: it goes to the tasks, and only hits and a row a document are moved
    hits = (seen.join(F.broadcast(table.withColumnRenamed("_digest", "digest")), "digest", "left")
            .where(whole | F.col("_license").isNotNull()))
    merged = hits.groupBy(key, "_raw").agg(
        F.count(F.when(whole, 1)).alias("_rows"), F.max(F.when(whole, F.col("digest"))).alias("digest"),
        F.max(F.when(whole, F.col("_license"))).alias("license"), F.coalesce(F.sum("_lines"), F.lit(0)).alias("_n"),
        F.array_join(F.sort_array(F.collect_set(F.when(~whole, F.col("_license")))), ",").alias("notices"))
    # repeated rows (same id, same text) were merged: give each its row again
    return (merged.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
            .select(key, "digest", "license", F.expr("_n DIV _rows").alias("n_notices"), "notices"))
