"""Operator 1: URL filters by link-graph propagation (DataFrame functions only).

Rules judge the urls they fit. Everything else is judged by its host: trust
flows along host links from hosts that the allow rules speak for, distrust
flows against the links from hosts that the block rules speak for (a host that
links to bad hosts is suspect), both as personalised PageRank. A host whose
distrust is above ``ratio`` times its trust is blocked.

* Seeds: a host's share of its ruled urls that are allowed (blocked) is its
  seed weight, so a host with urls of both kinds seeds both walks.
* Edges: distinct (page, host) links between different hosts, summed to one
  weighted row per host pair before any iteration. Links inside a host carry
  no endorsement and are left out.
* Scores are rank = (1 - damping) * seed + damping * (what flows in), in units
  of seed hosts. Walks that end at hosts without links are not restarted:
  restarting them at the seeds would only scale all scores alike.
* Each round joins the ranks with the edges and sums by host with map-side
  combination, so a hot host is one row per task; ranks are one row a host and
  are cut off with a reliable ``checkpoint()``. Rounds end after ``rounds`` or
  when the total change falls below ``tolerance``.

Edge cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is judged as an unlinked host (allow); hosts without evidence are
allowed; a null html has no links; repeated pages count their links each time;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import ascii_lower, written

#: (rule, verdict): a host and the start of the path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
HREF = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>\\]+)"""
DIGITS = 9


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; without ``://`` empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, ascii_lower(F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(url.substr(at + 3, F.length(url)), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule (else null)."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: str = "_host", html: str = "_html") -> DataFrame:
    """``src, dst, weight``: the number of src's pages that link to dst."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(HREF), F.lit(1)))
    return (pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(links).alias("dst"))
            .withColumn("dst", ascii_lower(F.col("dst"))).where("src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 400,
              tolerance: float = 1e-7) -> DataFrame:
    """``host, trust, distrust`` of every host that either walk reaches; each walk adds up to 1.

    ``edges``: src, dst, weight. ``seeds``: host, good, bad. The walks go on until
    a round moves less than ``tolerance`` of the seeds' mass; not getting there in
    ``rounds`` is an error, never a silent cut.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("_in"))
    # one flow table for both walks: trust to the link's target, distrust to its source
    steps = (edges.join(out, "src").join(into, "dst")
             .select(F.inline(F.array(
                 F.struct(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("_out")).alias("t"),
                          F.lit(0.0).alias("d")),
                 F.struct(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"),
                          (F.col("weight") / F.col("_in")).alias("d"))))))
    steps = written(steps, "host-steps")
    start = seeds.select("host", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust"))
    start = start.checkpoint()
    ranks = start
    mass = start.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 0.0
    if mass == 0 or steps.isEmpty():
        return _shares(ranks)
    for _ in range(rounds):
        flow = (ranks.join(steps, "host")
                .groupBy(F.col("to").alias("host"))
                .agg((damping * F.sum(F.col("trust") * F.col("t"))).alias("trust"),
                     (damping * F.sum(F.col("distrust") * F.col("d"))).alias("distrust")))
        parts = [start.select("host", "trust", "distrust", F.lit(0.0).alias("old_t"), F.lit(0.0).alias("old_d")),
                 flow.select("host", "trust", "distrust", F.lit(0.0).alias("old_t"), F.lit(0.0).alias("old_d")),
                 ranks.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"),
                              F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"))]
        both = (parts[0].union(parts[1]).union(parts[2]).groupBy("host")
                .agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "old_t", "old_d")]).checkpoint())
        ranks = both.select("host", "trust", "distrust")
        moved = both.agg(F.sum(F.abs(F.col("trust") - F.col("old_t")) + F.abs(F.col("distrust") - F.col("old_d")))).first()[0]
        if moved < tolerance * mass:
            return _shares(ranks)
    raise RuntimeError(f"trust and distrust did not settle in {rounds} rounds")


def _shares(ranks: DataFrame) -> DataFrame:
    """Both walks as shares of their sum: what dangling hosts lose differs between them."""
    totals = ranks.agg(F.sum("trust"), F.sum("distrust")).first()
    return ranks.select("host", *[F.col(c) / F.lit(t) if t else F.lit(0.0).alias(c) for c, t in zip(("trust", "distrust"), totals)]).toDF("host", "trust", "distrust")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
          rules: Sequence[tuple[str, str]] = RULES, damping: float = 0.85, rounds: int = 400, ratio: float = 1.0) -> DataFrame:
    """``key, host, path, rule, verdict, trust, distrust`` of every row.

    ``trust`` and ``distrust`` are the host's scores, rounded to 9 digits (0
    where no walk arrives).
    """
    from labelforge.session import shared_dir
    shared_dir(pages.sparkSession)          # checkpoints need the folder
    verdict = dict(rules)
    named = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                         F.col(html).alias("_html"))
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule, what in verdict.items():
        said = F.when(F.col("rule") == rule, F.lit(what)).otherwise(said)
    ruled = ruled.withColumn("_said", said)
    votes = (ruled.where("_said IS NOT NULL").groupBy("host")
             .agg(F.avg((F.col("_said") == "allow").cast("double")).alias("good"),
                  F.avg((F.col("_said") == "block").cast("double")).alias("bad")))
    edges = written(host_edges(named.withColumnRenamed("host", "_host")), "host-edges")
    scores = propagate(edges, votes, damping, rounds)
    return (ruled.drop("_html").join(scores, "host", "left")
            .withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
            .select(key, "host", "path", "rule", F.coalesce(
                "_said", F.when(F.col("distrust") > ratio * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                F.round("trust", DIGITS).alias("trust"), F.round("distrust", DIGITS).alias("distrust")))
