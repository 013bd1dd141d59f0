"""One query per operator: the operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import (
    decontaminate,
    jaccard_join,
    license_scan,
    line_dedup,
    quality_rules,
    secret_scan,
    source_mix,
    toxicity,
    url_filter,
    warc_store,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op5_sql() -> str:
    """The same counts, exact binomial cutoffs and verdicts in DuckDB SQL."""
    risk = 0.02 / len(quality_rules.SIGNALS)
    tests = sum(len(c) for c in quality_rules.CUTOFFS.values())
    sums = ", ".join(f"sum(CASE WHEN {s} >= {c} THEN 1 ELSE 0 END) AS {s}_{c}"
                     for s, cs in quality_rules.CUTOFFS.items() for c in cs)
    cuts = ", ".join("least(" + ", ".join(f"CASE WHEN {s}_{c} <= most THEN {c} END" for c in cs) + f") AS c_{s}"
                     for s, cs in quality_rules.CUTOFFS.items())
    hits = " ".join(f"WHEN {s} >= c_{s} THEN '{s}'" for s in quality_rules.SIGNALS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g FROM u),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM q WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT d.r, doc_id, stratum, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_words, 1) AS dup_lines,
  n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS long_words FROM b),
good AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1),
c AS (SELECT stratum, count(*) AS n, {sums} FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY stratum),
pmf AS (SELECT stratum, i, exp(lgamma(n + 1.0) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1.0) END
  - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1.0) END + i * ln({risk}) + (n - i) * ln(1 - {risk})) AS p
  FROM (SELECT stratum, n, unnest(range(0, ceil(n * {risk})::BIGINT + 1)) AS i FROM c)),
cdf AS (SELECT stratum, i, sum(p) OVER (PARTITION BY stratum ORDER BY i) AS s FROM pmf),
k AS (SELECT stratum, coalesce(max(i) FILTER (WHERE s <= 0.05 / ((SELECT count(*) FROM c) * {tests})), -1) AS most FROM cdf GROUP BY stratum),
cut AS (SELECT stratum, {cuts} FROM c JOIN k USING (stratum)),
v AS (SELECT m.*, CASE WHEN base_failed THEN 'base' {hits} END AS reason FROM m LEFT JOIN cut USING (stratum))
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM v"""


@query("op5_quality_rules", _op5_sql())
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w,
    2 * source_size::DOUBLE AS lim FROM s),
l AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
    FROM w WINDOW b AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(lim, w * (SELECT max(lev) FROM l)) AS target FROM l),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    (epochs * size + least(greatest(floor(target)::BIGINT - epochs * source_size - before, 0), size))::BIGINT AS taken, source FROM p"""


@query("op6_source_mix", OP6_SQL)
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, ((j // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (j % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN g USING (t)"""


@query("op2_warc_store", OP2_SQL)
def op2_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = warc_store.write_archives(table(spark, sf_dir, "pages"))
    return warc_store.read_archives(manifest, folder).drop("url", "payload")


def _op1_sql(rounds: int = 40, damping: float = 0.85) -> str:
    """The same rules and walks; each round of the walk is one step of the CTE chain."""
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]))

    def fits(rule: str) -> str:
        name, _, start = rule.partition("/")
        return f"((host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}'))"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)
    said = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)
    chain = "".join(f""",
r{i} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT * FROM r0 UNION ALL
  SELECT s."to", {damping} * sum(trust * t), {damping} * sum(distrust * d) FROM r{i - 1} r JOIN steps s USING (host) GROUP BY 1) GROUP BY host)"""
                    for i in range(1, rounds + 1))
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS x FROM pages),
h AS (SELECT page_id, html, coalesce(translate(regexp_extract(x, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(x, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p AS (SELECT *, CASE {rule} END AS rule FROM h),
q AS MATERIALIZED (SELECT page_id, host, path, rule, CASE rule {said} END AS said FROM p),
l AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''),
  '(?i)<a\s[^>]*?\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>\\]+)', 1), lambda y: y))) AS dst FROM h WHERE host <> ''),
e AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM l)
  WHERE src <> dst GROUP BY ALL),
steps AS MATERIALIZED (SELECT src AS host, dst AS "to", weight / sum(weight) OVER (PARTITION BY src) AS t, 0.0::DOUBLE AS d FROM e UNION ALL
  SELECT dst, src, 0.0::DOUBLE, weight / sum(weight) OVER (PARTITION BY dst) FROM e),
r0 AS MATERIALIZED (SELECT host, {1 - damping} * avg((said = 'allow')::INT) AS trust, {1 - damping} * avg((said = 'block')::INT) AS distrust
  FROM q WHERE said IS NOT NULL GROUP BY host){chain},
z AS (SELECT host, coalesce(trust / nullif(sum(trust) OVER (), 0), 0) AS trust, coalesce(distrust / nullif(sum(distrust) OVER (), 0), 0) AS distrust FROM r{rounds})
SELECT page_id, q.host, path, rule, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust,
  coalesce(said, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN z ON q.host = z.host"""


@query("op1_url_filter", _op1_sql())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM
    (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
b AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""


@query("op3_jaccard_join", OP3_SQL)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))
