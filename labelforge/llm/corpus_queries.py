"""Queries over the whole of ``documents``: sharding, the divergence audit of sources, ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import lexical_search, sharding, source_audit
from labelforge.llm.queries import query, table


def _op13_sql(shards: int = 16) -> str:
    """The same tree in DuckDB SQL: a window a level instead of the radix selection."""
    def coordinate(c: str) -> str:
        return f"coalesce(('0x' || substr(md5({c}), 1, 8))::BIGINT, -1)"
    levels, dims = "", range(len(sharding.DIMENSIONS))
    for i in range((shards - 1).bit_length()):
        widths = [f"coalesce((max(d{j})::DOUBLE - min(d{j})::DOUBLE) / nullif((SELECT w{j} FROM ends), 0), 0)" for j in dims]
        widest = "CASE " + " ".join(f"WHEN {w} = greatest({', '.join(widths)}, 0) THEN {j}" for j, w in enumerate(widths)) + " END"
        levels += f""",
s{i} AS MATERIALIZED (SELECT node, k, {widest} AS dim, sum(size)::BIGINT // k * (k // 2) + sum(size)::BIGINT % k * (k // 2) // k AS target
  FROM t{i} WHERE k > 1 GROUP BY node, k),
x{i} AS (SELECT t.*, target, CASE dim {' '.join(f'WHEN {j} THEN d{j}' for j in dims)} END AS x FROM t{i} t JOIN s{i} USING (node, k)),
c{i} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY x, tie ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before FROM x{i}),
t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} WHERE k = 1 UNION ALL SELECT doc_id, size, crc, {', '.join(f'd{j}' for j in dims)}, tie,
  CASE WHEN 2 * before + size <= 2 * target THEN node ELSE node + k // 2 END, CASE WHEN 2 * before + size <= 2 * target THEN k // 2 ELSE k - k // 2 END FROM c{i})"""
    ends = ", ".join(f"max(d{j})::DOUBLE - min(d{j})::DOUBLE AS w{j}" for j in dims)
    return rf"""
WITH f AS (SELECT list(v ORDER BY i) AS f FROM (SELECT i, list_reduce(range(8),
    lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM (SELECT unnest(range(256)) AS i))),
b AS (SELECT doc_id, source, lang, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, source, lang, size, xor(list_reduce(list_transform(range(size - 1), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT),
    lambda a, c: xor(a >> 8, f[(xor(a, c) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS crc FROM b, f),
t0 AS MATERIALIZED (SELECT doc_id, size, crc, {coordinate('source')} AS d0, {coordinate('lang')} AS d1, size AS d2, coalesce(doc_id, 0)::BIGINT AS d3,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || crc || '|' || size), 1, 15))::BIGINT AS tie, 0 AS node, {shards} AS k FROM e),
ends AS (SELECT {ends} FROM t0){levels}
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, node AS shard,
  row_number() OVER (PARTITION BY node ORDER BY tie) - 1 AS slot, NULL::INT AS grown_shard FROM t{(shards - 1).bit_length()}"""


@query("op13_shard", _op13_sql())
def op13_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
t AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM t GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(n)::BIGINT AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n, k.n AS all_n FROM g JOIN k USING (lang)
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * terms) AS p,
  1 + 1000000000::HUGEINT * (all_n + 2) // (total + 2 * terms) AS q FROM c JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
f AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM f QUALIFY part = 'pair' OR rank <= 10"""


@query("op12_source_audit", OP12_SQL)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS MATERIALIZED (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*) AS docs, coalesce(sum(len(ws)), 0)::BIGINT AS words FROM d WHERE len(ws) > 0),
t AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t GROUP BY term),
c AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) AS part FROM t JOIN w USING (term), s),
f AS (SELECT i, item_id, r, doc_id, sum(part * times)::BIGINT AS score FROM c JOIN q USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM f WHERE score > 0 QUALIFY rank <= 20"""


@query("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
