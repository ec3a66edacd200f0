"""URL filters: rules for hosts and paths, and trust that spreads over the links between hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import stored

#: (host, path prefix, verdict) of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    part = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(part, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct (n, rule, verdict); null if none fits."""
    hits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*hits))) if hits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def host_edges(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Distinct links (src, dst) between different hosts, from the absolute and ``//`` links of the pages."""
    links = F.regexp_extract_all(F.col(html_column), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""), 1)
    return (
        pages.select(host_of(F.col(url_column)).alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
        .withColumn("dst", F.translate("dst", _UPPER, _LOWER))
        .where("src != '' and dst != '' and src != dst")
        .distinct()
    )


#: Damping of both ranks, and the largest share of a seed's weight that the rounds may leave unsettled.
DAMPING, TOLERANCE = 0.85, 1e-4


def rounds_for(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which no score can differ from its limit by more than ``tolerance`` times the seeds' sum."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def personalised_rank(
    hosts: DataFrame, edges: DataFrame, seed: str, shared_by: str = "src", damping: float = DAMPING, tolerance: float = TOLERANCE, store_every: int = 4
) -> DataFrame:
    """PageRank of ``hosts`` (host, ``seed`` weight) over ``edges`` (src, dst) with restarts at the seeds: (host, score).

    ``shared_by="src"``: a host's rank is shared among its targets, as usual. ``"dst"``: a
    host gets the mean over its sources, so its score does not fall because others get the
    same source's rank too. Each round is one join on the source and one sum by target,
    combined before the shuffle; the lineage is cut every ``store_every`` rounds. The rounds
    end when no score moves any more, at the latest when ``tolerance`` is reached.
    """
    start = hosts.select("host", F.col(seed).alias("base"))
    out = edges.groupBy(shared_by).agg(F.count("*").alias("degree"))
    weighted = stored(edges.join(out, shared_by).select("src", "dst", (1 / F.col("degree")).alias("w")), "weighted_edges")
    if weighted.isEmpty():
        return start.select("host", ((1 - damping) * F.col("base")).alias("score"))
    rank, rounds = start.select("host", "base", F.col("base").alias("score"), F.lit(0.0).alias("before")), rounds_for(damping, tolerance)
    for i in range(1, rounds + 1):
        given = (
            rank.where("score > 0").join(weighted, rank["host"] == weighted["src"])
            .groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        )
        now = ((1 - damping) * F.col("base") + damping * F.coalesce("got", F.lit(0.0))).alias("score")
        rank = rank.join(given, rank["host"] == given["dst"], "left").select("host", "base", now, F.col("score").alias("before"))
        if i % store_every == 0 or i == rounds:
            rank = stored(rank, "rank")
            if (rank.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) < 1e-15:
                break
    return rank.select("host", "score")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    distrust_ratio: float = 2.0,
    least_distrust: float = 0.05,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    The longest rule that fits decides. Where none fits, the host does: trust flows along
    the links from hosts with allowed pages, distrust against the links from hosts with
    blocked pages (who links to a blocked host is suspect), and a host is blocked if its
    distrust exceeds ``distrust_ratio`` times its trust and ``least_distrust``. A host's
    distrust is the damped mean over the hosts it links to, so it does not depend on how many
    others link there: a host of which two fifths of the links lead to wholly blocked hosts reaches 0.05. Seeds weigh
    by their share of allowed and blocked pages, so a host with both is judged by which
    prevails. Without links, 0.05 is reached where a third of a host's pages are blocked. A
    host without links and rules is allowed.

    Null and malformed urls have an empty host and path and are allowed; repeated rows stay.
    An empty table gives no rows. Columns other than the three named are not read.
    """
    host, path = host_of(F.col(url_column)), path_of(F.col(url_column))
    judged = pages.select(F.col(id_column), host.alias("host"), path.alias("path")).withColumn(
        "best", best_rule(F.col("host"), F.col("path"), rules)
    )
    share = lambda v: F.avg(F.when(F.col("best.verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host != ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    edges = stored(host_edges(pages, url_column, html_column), "host_edges")
    others = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = stored(others.join(seeds, "host", "full").select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("good", "bad"))), "hosts")
    trust = personalised_rank(hosts, edges, "good").withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = personalised_rank(hosts, back, "bad", shared_by="dst").withColumnRenamed("score", "distrust")
    scores = stored(trust.join(distrust, "host"), "host_scores").withColumnRenamed("host", "_host")
    blocked = (F.col("distrust") > distrust_ratio * F.col("trust")) & (F.col("distrust") > least_distrust)
    return judged.join(scores, judged["host"] == scores["_host"], "left").select(
        id_column,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def judge_sql(rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = rounds_for()) -> str:
    """``judge_urls`` over ``pages`` in SQL: the ranks are recursive queries of ``rounds`` steps."""
    upper, lower = f"'{_UPPER}'", f"'{_LOWER}'"
    fits = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}"
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]

    def rank(name: str, seed: str, src: str, dst: str) -> str:
        return f"""
{name}_w AS (SELECT {src} AS s, {dst} AS d, 1::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM edges),
{name} AS (
  SELECT host, {seed} AS base, {seed} AS score, 0 AS i FROM hosts
  UNION ALL
  SELECT r.host, r.base, (1 - {damping}::DOUBLE) * r.base + {damping}::DOUBLE * coalesce(g.got, 0), r.i + 1
  FROM {name} r LEFT JOIN (
    SELECT d, sum(score * w) AS got FROM {name} JOIN {name}_w ON host = s GROUP BY d) g ON r.host = g.d
  WHERE r.i < {rounds})"""

    return rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {upper}, {lower}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (SELECT *, CASE {" ".join(fits)} END AS best FROM parts),
seeds AS (
  SELECT host, avg(CASE WHEN best.verdict = 'allow' THEN 1::DOUBLE ELSE 0 END) AS good,
    avg(CASE WHEN best.verdict = 'block' THEN 1::DOUBLE ELSE 0 END) AS bad
  FROM judged WHERE host != '' GROUP BY host),
links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(
    html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)), {upper}, {lower}) AS dst
  FROM judged),
edges AS (SELECT DISTINCT src, dst FROM links WHERE src != '' AND dst != '' AND src != dst),
hosts AS (
  SELECT host, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seeds) LEFT JOIN seeds USING (host)),
{rank("trust", "good", "src", "dst")},
{rank("distrust", "bad", "dst", "src")},
scores AS (
  SELECT t.host, d.score > 2::DOUBLE * t.score AND d.score > 0.05::DOUBLE AS blocked
  FROM trust t JOIN distrust d ON t.host = d.host AND t.i = {rounds} AND d.i = {rounds})
SELECT page_id, j.host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON j.host = s.host
"""
