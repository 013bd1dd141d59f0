"""Operator 8: secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived:
every text that the rule can match satisfies it. Texts are indexed in shards
(the texts of one batch of about ``SHARD_CHARS`` characters): for each trigram
that some rule asks for, the posting list of the texts that hold it, letters
A-Z folded. A rule's query is answered by intersecting and joining postings;
only its candidates are matched with the expression itself. Rules without a
mandatory trigram scan every text of the shard. Whole texts are indexed and
matched; nothing is shuffled, so a hot source or copied texts cost no more
than their rows, and a shard is the memory bound (plus one text).

Edge cases: a null text is empty; empty texts have no spans (digest of the
empty string); repeated rows give repeated results; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from labelforge.llm.common import LOWER, UPPER, batches_of, map_batches

SHARD_CHARS = 8_000_000
_FOLD = str.maketrans(UPPER, LOWER)

# Fixed values: (kind, expression, flags, least length, group the length is of).
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     re.IGNORECASE | re.ASCII, 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
    ("hex", r"[0-9a-f]+", 0, 24, 0),
)
ADDED_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0),
    ("github", r"gh[opusr]_[A-Za-z0-9]+", 0, 40, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, 0),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39, 0),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, 0),
    ("url_login", r"://[A-Za-z0-9._~%+-]+:[^\x00-\x20/@:]+@", 0, 8, 0),
)
MAX_EXACT = 16


def _join(kind: str, parts: list) -> object:
    """AND / OR of trigram queries; True stands for "any text"."""
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    flat: list = []
    for p in parts:
        flat += [x for x in (p[1] if isinstance(p, tuple) and p[0] == kind else [p]) if x not in flat]
    return flat[0] if len(flat) == 1 else (kind, flat)


def _of_strings(strings: set[str]) -> object:
    """What a text holds if it holds one of the strings."""
    if any(len(s) < 3 for s in strings):
        return True
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _of_item(op, arg) -> tuple[set[str] | None, object]:
    """(the strings it can match, if few; a query that holds besides)."""
    if op is sre.LITERAL:
        return {chr(arg).translate(_FOLD)}, True
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 6:
        return {chr(a).translate(_FOLD) for _, a in arg}, True
    if op is sre.AT:
        return {""}, True
    if op is sre.SUBPATTERN:
        return _of_sequence(arg[-1])
    if op is sre.BRANCH:
        ways = [_of_sequence(w) for w in arg[1]]
        if all(e is not None for e, _ in ways) and len(every := set().union(*(e for e, _ in ways))) <= MAX_EXACT:
            return every, _join("or", [q for _, q in ways])
        return None, _join("or", [_join("and", [q, True if e is None else _of_strings(e)]) for e, q in ways])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, query = _of_sequence(inner)
        if least == 0:
            return (exact | {""}, True) if most == 1 and exact is not None else (None, True)
        if exact is not None and least == most and len(exact) == 1 and least <= 64:
            return {s * least for s in exact}, query
        return None, _join("and", [query, True if exact is None else _of_strings(exact)])
    return None, True


def _of_sequence(items) -> tuple[set[str] | None, object]:
    run, whole, found = {""}, True, []
    for op, arg in items:
        exact, query = _of_item(op, arg)
        found.append(query)
        if exact is not None and len(longer := {a + b for a in run for b in exact}) <= MAX_EXACT:
            run = longer
            continue
        found.append(_of_strings(run))
        whole = False
        run = exact if exact is not None else {""}
    if whole:
        return run, _join("and", found)
    return None, _join("and", [*found, _of_strings(run)])


def trigram_query(pattern: str, flags: int = 0) -> object:
    """A query that every text with a match of ``pattern`` satisfies.

    A trigram (str, letters A-Z folded), ``("and", [...])``, ``("or", [...])``,
    or ``True`` where no trigram is mandatory.
    """
    exact, query = _of_sequence(sre_parser.parse(pattern, flags))
    return _join("and", [query, True if exact is None else _of_strings(exact)])


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def answer(query: object, postings: dict[str, set[int]], every: set[int]) -> set[int]:
    """The texts of a shard that satisfy ``query``."""
    if query is True:
        return every
    if isinstance(query, str):
        return postings[query]
    parts = [answer(q, postings, every) for q in query[1]]
    return set.intersection(*parts) if query[0] == "and" else set().union(*parts)


def spans_of(texts: list[str], rules=BASE_RULES + ADDED_RULES) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every match in each text of a shard, in order."""
    queries = [trigram_query(p, f) for _, p, f, _, _ in rules]
    wanted = sorted(set().union(*map(trigrams_of, queries)))
    postings: dict[str, set[int]] = {t: set() for t in wanted}
    for i, text in enumerate(texts):
        folded = text.translate(_FOLD) if not text.isascii() else text.lower()
        for t in wanted:
            if t in folded:
                postings[t].add(i)
    every, found = set(range(len(texts))), [[] for _ in texts]
    for number, ((_, pattern, flags, least, group), query) in enumerate(zip(rules, queries, strict=True)):
        matcher = re.compile(pattern, flags)
        for i in answer(query, postings, every):
            found[i] += [(m.start(), number, m.end()) for m in matcher.finditer(texts[i])
                         if m.end(group) - m.start(group) >= least]
    return [sorted(f) for f in found]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_assign, n_access, n_hex, base_sha256, spans`` of every document.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then
    by the order of the rules; ``base_sha256`` is over the base kinds alone.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(f"n_{k[0]}", T.LongType()) for k in BASE_RULES],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    names = [r[0] for r in BASE_RULES + ADDED_RULES]

    def rows(given: Iterator[list]) -> Iterator[list]:
        every = ((i, t or "") for batch in given for i, t in batch)
        for shard in batches_of(every, SHARD_CHARS, lambda r: len(r[1]) + 100):
            out = []
            for (ident, _), found in zip(shard, spans_of([t for _, t in shard])):
                said = [f"{names[n]}:{a}:{b}" for a, n, b in found]
                base = ",".join(s for s, (_, n, _) in zip(said, found) if n < len(BASE_RULES))
                out.append((ident, *(sum(n == k for _, n, _ in found) for k in range(len(BASE_RULES))),
                            hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
            yield out

    return map_batches(docs.select(key, text), rows, schema)
