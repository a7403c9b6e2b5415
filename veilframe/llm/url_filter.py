"""URL filters (native): rules, and link-graph propagation where no rule fits.

Host edges come from the pages' links that name a host - absolute ones, those without a scheme, and the base that
relative links stand for - and from the addresses that a page's own URL hands on in its query, literal or
percent-encoded. Links inside a host say nothing about other hosts and are left out. Two personalised PageRanks run over them in one loop: trust flows along links from
hosts whose pages the allow rules accept, distrust flows against links from hosts whose pages the block rules
reject. A caller may add `seed_words`, none by default: a host one of whose names between dots and hyphens is
such a word is a seed of distrust. A seed weighs what part of its host's pages its rules decide. A host whose distrust exceeds `ratio` times its trust is blocked; equal ones are allowed.

Only DataFrame operations are used. Edges are counted per host pair with map-side combining before
they are shuffled, and ranks are re-cut each few rounds. Scores are broadcast to the pages where a count says that
there are few hosts; else the pages of the most frequent hosts are settled by broadcast and only others shuffled.

A rule `host/path` fits its host and all its subdomains when the URL's path starts with `/path`; the
longest rule wins, among equal lengths the first by text, block before allow. A null URL, or one
without `://`, has an empty host and path, fits no rule and is allowed; null html has no links;
repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import cut, forget, looked_up

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: the rules of the contract
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""

HANDED = r"""(?i)=(https?://[^\s"'<>&#]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def fits(rule: str, host: Column, path: Column) -> Column:
    name, start = rule_parts(rule)
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


def by_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The winning rule and its verdict, null where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0], r[1] != "block"))
    none = F.lit(None).cast("string")
    pick = lambda k: F.coalesce(*[F.when(fits(r[0], host, path), F.lit(r[k])) for r in ranked], none)
    return pick(0), pick(1)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): the links from one host to another. pages: host, html, and url if its query counts, too."""
    html = F.coalesce("html", F.lit(""))
    links = F.when(html.contains("//"), F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).otherwise(F.array().cast("array<string>"))
    if "url" in pages.columns:
        handed = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"[?](.*)", 1), "(?i)%3A", ":"), "(?i)%2F", "/")
        links = F.concat(links, F.regexp_extract_all(handed, F.lit(HANDED), F.lit(1)))
    named = pages.select("host", F.explode(F.array_distinct(links)).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    ends = named.select(F.col("host").alias("src"), host_of(full).alias("dst")).where("src != '' and dst != '' and src != dst")
    return ends.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust). edges: src, dst, n; seeds: host, kind ('t' or 'd'), share (of one total for both kinds).

    Ranks of both kinds are one table; the edges of kind 'd' are the reversed ones. Ranks only grow; unless
    `rounds` ends it, that goes on until no host is new and none grew by more than `tolerance` of its own rank."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    along = edges.join(out, "src").select(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("w"))
    against = edges.join(back, "dst").select(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("total")).alias("w"))
    flow = cut(along.unionByName(against))
    base = cut(seeds.select("kind", "host", (F.col("share") * (1 - damping)).alias("rank")))
    ranks, kept = base, []
    if not flow.isEmpty():
        for turn in count() if rounds is None else range(rounds):
            sent = flow.join(ranks, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("w") * damping).alias("rank"))
            new = base.unionByName(sent).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if turn % 3 == 1:
                before = ranks = cut(new)  # the old ranks of the comparison below
            elif turn % 3 == 2:
                new = cut(new)
                moved = new.join(before.withColumnRenamed("rank", "old"), ["kind", "host"], "left")
                if moved.where(F.col("rank") - F.coalesce("old", F.lit(0.0)) > tolerance * F.col("rank")).isEmpty():
                    return pivoted(new)
                forget(before, *kept)
                ranks, kept = new, [new]
            else:
                ranks = new
    return pivoted(ranks)


def pivoted(ranks: DataFrame) -> DataFrame:
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    return ranks.groupBy("host").agg(part("t").alias("trust"), part("d").alias("distrust"))


def seed_shares(judged: DataFrame, seed_words: tuple[str, ...]) -> DataFrame:
    """(host, kind, share): a host's trusted and distrusted seed mass, the parts of its pages that rules accept and reject.
    Both kinds are divided by one total, so that they stay comparable: a host without links is judged by its own pages,
    whatever other hosts there are."""
    named = reduce(lambda a, b: a | b, [F.array_contains(F.split("host", "[.-]"), w) for w in seed_words], F.lit(False))
    part = lambda verdict: F.sum((F.coalesce("ruled", F.lit("")) == verdict).cast("double")) / F.count("*")
    hosts = judged.where("host != ''").groupBy("host").agg(part("allow").alias("t"), part("block").alias("d"))
    weight = hosts.select("host", F.when(named, 0.0).otherwise(F.col("t")).alias("t"), F.when(named, 1.0).otherwise(F.col("d")).alias("d"))
    long = weight.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("t").alias("w")), F.struct(F.lit("d").alias("kind"), F.col("d").alias("w")))).alias("s")).select("host", "s.*").where("w > 0")
    total = long.agg(F.sum("w").alias("total")).head()["total"]  # one number
    return long.select("host", "kind", (F.col("w") / F.lit(total)).alias("share"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, seed_words: tuple[str, ...] = (), ratio: float = 1.0, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, trust, distrust."""
    split = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = by_rule(rules, F.col("host"), F.col("path"))
    judged = split.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    seeds = cut(seed_shares(judged, seed_words))
    scores = propagate(cut(host_edges(split)), seeds, damping, rounds)
    open_ = F.when(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return looked_up(judged, cut(scores), "host", how="left").select("page_id", "host", "path", "rule", F.coalesce("ruled", open_).alias("verdict"), "trust", "distrust")


def sql_of_rules(rules: list[tuple[str, str]], k: int) -> str:
    """The winning rule (k = 0) or its verdict (1) in SQL."""
    ranked = sorted(rules, key=lambda r: (-len(r[0]), r[0], r[1] != "block"))
    when = lambda r: "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{2}'".format(*rule_parts(r[0]), r[k])
    return f"CASE {' '.join(map(when, ranked))} END"


#: Rounds of the SQL: 0.85 ** 100 of the mass is missing then.
ROUNDS = 100
HOST_SQL = "translate(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), '" + UPPER + "', '" + LOWER + "')"
STEP_SQL = "r{0} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, share * 0.15 AS rank FROM seeds UNION ALL SELECT f.kind, f.dst, r.rank * f.w * 0.85 FROM flow f JOIN {1} r ON r.kind = f.kind AND r.host = f.src) GROUP BY 1, 2)"
ORACLE = f"""
WITH split AS (SELECT page_id, url, coalesce(html, '') AS html, coalesce({HOST_SQL.format("url")}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
     judged AS (SELECT page_id, host, path, {sql_of_rules(RULES, 0)} AS rule, {sql_of_rules(RULES, 1)} AS ruled FROM split),
     links AS (SELECT host AS src, unnest(list_distinct(list_concat(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1), regexp_extract_all(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '[?](.*)', 1), '(?i)%3A', ':', 'g'), '(?i)%2F', '/', 'g'), '{HANDED.replace("'", "''")}', 1)))) AS link FROM split),
     ends AS (SELECT src, {HOST_SQL.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links),
     edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM ends WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
     flow AS MATERIALIZED (SELECT 't' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM edges UNION ALL SELECT 'd', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
     hosts AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS t, count(*) FILTER (ruled = 'block') / count(*) AS d FROM judged WHERE host <> '' GROUP BY host),
     seeds AS MATERIALIZED (SELECT kind, host, w / sum(w) OVER () AS share FROM (SELECT 't' AS kind, host, t AS w FROM hosts UNION ALL SELECT 'd', host, d FROM hosts) WHERE w > 0),
     r0 AS MATERIALIZED (SELECT kind, host, share * 0.15 AS rank FROM seeds),
     {", ".join(STEP_SQL.format(k, f"r{k - 1}") for k in range(1, ROUNDS + 1))},
     scores AS (SELECT host, sum(rank) FILTER (kind = 't') AS trust, sum(rank) FILTER (kind = 'd') AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores USING (host)
"""
