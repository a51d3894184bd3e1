"""URL filters by rules and link-graph propagation, in DataFrame operations only.

Rules (host, path) fit a host and its subdomains when the url's path starts with the rule's; the longest one decides. Pages
that no rule fits get their host's verdict: hosts are nodes; a page's links to other hosts (with or without a scheme and quotes; a
relative link stays on its host) give edges, and a host with four or more labels and its parent host point at each other. Trust is a personalised PageRank from the hosts
with allowed pages along the edges; distrust is one from the hosts with blocked pages against the edges (a host that links to
bad ones is suspect). Sweeps go on until no host's rank changes by more than TOLERANCE in SWEEPS of them. A seed's weight is the share of its pages that the rules judge so. A host is blocked when its distrust
exceeds its trust by THRESHOLD.

A null url, or one without "://", has an empty host and path, fits no rule, and is allowed; a null html has no links; repeated rows
are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, THRESHOLD, EDGE = 0.85, 0.05, 1.0
#: Ranks are swept until a round of SWEEPS changes none by more than TOLERANCE.
TOLERANCE, SWEEPS = 1e-6, 5
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(rest: Column) -> Column:
    """Host of what follows "://"."""
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    after = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host_of(rest), F.lit("")), F.coalesce(after, F.lit(""))


def rules_table(spark, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(rule, rule_verdict, rule_host, rule_path)."""
    if not rules:
        return spark.sql("select '' as rule, '' as rule_verdict, '' as rule_host, '' as rule_path where false")
    names = {f"{c}{i}": x for i, (v, r) in enumerate(rules) for c, x in zip("rvhp", (r, v, r.partition("/")[0].lower(), "/" + r.partition("/")[2]), strict=True)}
    values = ", ".join(f"(:r{i}, :v{i}, :h{i}, :p{i})" for i in range(len(rules)))
    return spark.sql(f"select * from values {values} as t(rule, rule_verdict, rule_host, rule_path)", args=names)


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) of the distinct places that a rule fits; ties go to the longer host, then to block."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    fits = places.select("host", "path").distinct().withColumn("suffix", suffix).join(rules, F.col("suffix") == F.col("rule_host")).where(F.startswith(F.col("path"), F.col("rule_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), "rule", "rule_verdict"))
    return fits.groupBy("host", "path").agg(best.alias("x")).select("host", "path", "x.rule", "x.rule_verdict")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, and the ties of subdomains, from (host, html)."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"), F.lit(1.0).alias("n"))
    ties = pages.select("host").distinct().where(F.size(F.split("host", r"\.")) >= 4).select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("up"))
    both = ties.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(EDGE).alias("n"))
    return links.union(both).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of edges (src, dst, n) and seeds (host, good, bad), by sweeps over both directions at once.

    Ranks only grow, and what is missing shrinks by damping with every sweep, so the sweeps end: some 90 of them at most for a damping of 0.85.
    """
    ways = edges.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").union(edges.select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    total = ways.groupBy("way", "a").agg(F.sum("n").alias("total"))
    ways = cut(ways.join(total, ["way", "a"]).select("way", "a", "b", (F.col("n") / F.col("total")).alias("w")))
    base = seeds.select(F.lit(0).alias("way"), "host", F.col("good").alias("x")).union(seeds.select(F.lit(1).alias("way"), "host", F.col("bad").alias("x"))).where("x > 0")
    base = cut(base.select("way", "host", (F.col("x") * (1 - damping)).alias("x")))
    state = base

    def sweep(state: DataFrame) -> DataFrame:
        moved = state.join(ways, (state.way == ways.way) & (state.host == ways.a)).select(state.way, F.col("b").alias("host"), (F.col("x") * F.col("w") * damping).alias("x"))
        return moved.union(base).groupBy("way", "host").agg(F.sum("x").alias("x"))

    change = 0.0 if ways.isEmpty() else None
    while change is None or change > TOLERANCE:
        last = state
        for _ in range(SWEEPS):
            state = sweep(state)
        state = cut(state)
        both = state.join(last.withColumnRenamed("x", "old"), ["way", "host"], "left")
        change = both.agg(F.max(F.col("x") - F.coalesce("old", F.lit(0.0)))).first()[0] or 0.0
    return state.groupBy("host").agg(F.sum(F.when(F.col("way") == 0, F.col("x")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("way") == 1, F.col("x")).otherwise(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of pages (page_id, url, html)."""
    rules = rules_table(pages.sparkSession) if rules is None else rules
    host, path = host_and_path(F.col("url"))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    matched = match_rules(placed, rules)
    judged = cut(placed.select("page_id", "host", "path").join(matched, ["host", "path"], "left"))
    part = lambda v: F.avg((F.coalesce("rule_verdict", F.lit("")) == v).cast("double"))
    seeds = judged.where("host <> ''").groupBy("host").agg(part("allow").alias("good"), part("block").alias("bad"))
    scores = propagate(host_edges(placed), seeds)
    by_host = F.when(F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)), 9) > threshold, "block").otherwise("allow")
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"), "trust", "distrust")


def _oracle() -> str:
    rules = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    link = LINK.replace("'", "''")
    return f"""
with recursive r(rule, rule_verdict, rule_host, rule_path) as (values {rules}),
u as (select page_id, html, case when contains(url, '://') then substring(url, strpos(url, '://') + 3) end as rest from pages),
p as (select page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
m as (select host, path, arg_max(rule, (length(rule), length(rule_host), rule_verdict = 'block')) as rule, arg_max(rule_verdict, (length(rule), length(rule_host), rule_verdict = 'block')) as rule_verdict
      from (select distinct host, path from p) d join r on (d.host = rule_host or ends_with(d.host, '.' || rule_host)) and starts_with(path, rule_path) group by all),
j as (select page_id, p.host, p.path, rule, rule_verdict from p left join m on p.host = m.host and p.path = m.path),
seeds as (select host, avg(cast(coalesce(rule_verdict, '') = 'allow' as double)) as good, avg(cast(coalesce(rule_verdict, '') = 'block' as double)) as bad from j where host <> '' group by host),
l as (select host as src, translate(unnest(list_distinct(regexp_extract_all(html, '{link}', 1))), '{UPPER}', '{LOWER}') as dst, 1e0 as n from p where host <> ''),
t as (select distinct host, substring(host, strpos(host, '.') + 1) as up from p where len(string_split(host, '.')) >= 4),
edges as (select src, dst, sum(n) as n from (select * from l union all select host, up, {EDGE} from t union all select up, host, {EDGE} from t) where src <> dst and dst <> '' group by all),
both_ways as (select 0 as way, src as a, dst as b, n from edges union all select 1, dst, src, n from edges),
ways as materialized (select way, a, b, n / sum(n) over (partition by way, a) as w from both_ways),
moved(i, way, host, x) as (select 0, way, host, x * {1 - DAMPING} from (select 0 as way, host, good as x from seeds union all select 1, host, bad from seeds) where x > 0
      union all select i + 1, m.way, e.b, sum(m.x * e.w * {DAMPING}) from moved m join ways e on m.way = e.way and m.host = e.a where i < 120 group by i, m.way, e.b),
f as (select host, sum(case when way = 0 then x else 0 end) as trust, sum(case when way = 1 then x else 0 end) as distrust from moved group by host)
select page_id, j.host, path, rule, coalesce(rule_verdict, case when round(coalesce(distrust, 0) - coalesce(trust, 0), 9) > {THRESHOLD} then 'block' else 'allow' end) as verdict
from j left join f on j.host = f.host
"""


ORACLE = _oracle()
