"""URL filter: rules first, then link-graph propagation over hosts.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; the longest
``host + path`` wins, ties go to the first in text order. Urls that no rule fits get their host's verdict:

* edges run from a page's host to the hosts its links name (other hosts only, each once);
* trust is personalised PageRank from hosts by the share of their pages that rules allow, with restart ``1 - DAMPING``;
* distrust is the same reversed: a host's is the share of its own personalised PageRank that lies on hosts by the share of their
  pages that rules block. It follows links backwards, and each host takes the mean of those that it links to, so what a linker
  gets doesn't shrink with the number of others: of a farm that points at one blocked host every member is caught;
* a host is blocked if its distrust is above its trust and at least ``THRESHOLD`` percent of what a host has of which rules
  block every page.

``ROUNDS`` rounds stand for convergence (0.85**8, a quarter of the mass, is left to longer walks). Seeds aren't normalised to one, and
trust that reaches a host without links goes no further.

Masses are whole numbers (``UNIT`` a host), so sums don't depend on the order of rows. A null url or one without
``://`` has an empty host and path, fits no rule and is allowed; null html has no links; repeated rows are judged
alike, very long html whole; an empty table gives an empty table; other columns pass through, whatever their names, unless named as a result.

Edges are summed before each shuffle, so a hub's in-links arrive as one row a task; joins on a host leave hot hosts to
be split by adaptive execution. Every fourth round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.common import Sheltered, materialise

Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UNIT = 1_000_000_000
DAMPING = 85
ROUNDS = 8
THRESHOLD = 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null; rules are meant to be few and go into the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """Distinct (src, dst) between different hosts."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))
    pairs = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(links).alias("dst"))
    return pairs.where("src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, backwards: bool = False) -> DataFrame:
    """Personalised PageRank in whole numbers, or backwards the share of each host's own that lies on the seeds. seeds: (host, seed); edges: (src, dst). Gives (host, mass)."""
    restart = F.expr(f"seed * {100 - DAMPING} div 100")
    base = seeds.select("host", restart.alias("mass"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    out = edges.join(degree, "src").select("src", "dst", "deg")
    if backwards:
        out = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "deg")
    mass = base
    for k in range(rounds):
        sent = out.join(mass.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.expr(f"mass * {DAMPING} div (100 * deg)")).alias("mass"))
        mass = base.unionByName(sent).groupBy("host").agg(F.sum("mass").alias("mass"))
        if k % 4 == 3:
            mass = materialise(mass, "host-mass")
    return mass


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """All columns of pages but html, with host, path, rule, verdict."""
    own = Sheltered(pages, ("html", "host", "path", "rule", "verdict"), ("url", "html"))
    url = F.col(own.of("url"))
    parsed = own.docs.select(*own.inner, F.col(own.of("html")).alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.withColumn("__best", best_rule(F.col("host"), F.col("path"), rules))
    hosts = materialise(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__best.verdict") == "allow").alias("allowed"), F.count_if(F.col("__best.verdict") == "block").alias("blocked")),
        "hosts",
    )
    edges = materialise(host_edges(parsed), "host-edges")
    there = 0 if edges.isEmpty() else rounds  # without edges every round gives the same masses
    trust = propagate(hosts.select("host", F.expr(f"allowed * {UNIT} div n").alias("seed")), edges, there)
    distrust = propagate(hosts.select("host", F.expr(f"blocked * {UNIT} div n").alias("seed")), edges, there, backwards=True)
    scores = trust.select("host", F.col("mass").alias("trust"), F.lit(0).cast("long").alias("distrust")).unionByName(distrust.select("host", F.lit(0).cast("long").alias("trust"), F.col("mass").alias("distrust")))
    bad = (
        scores.groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        .where((F.col("distrust") > F.col("trust")) & (F.col("distrust") * 10_000 >= F.lit(threshold * (100 - DAMPING)).cast("long") * UNIT))
        .select(F.col("host").alias("__host"), F.lit("block").alias("__verdict"))
    )
    judged = ruled.drop("html").join(bad, F.col("host") == F.col("__host"), "left")
    return judged.select(*own.inner, "host", "path", "__best.rule", F.coalesce("__best.verdict", "__verdict", F.lit("allow"))).toDF(*own.names, "host", "path", "rule", "verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every page's url judged by the fixed rules and by what its host's links carry."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def sql(rules: Sequence[Rule] = RULES, rounds: int = ROUNDS, threshold: int = THRESHOLD) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")

    def rank(name: str, seed: str, src: str, dst: str) -> str:
        parts = [f"{name}0 AS (SELECT host, {seed} * {UNIT} // n * {100 - DAMPING} // 100 AS mass FROM hosts)"]
        for k in range(1, rounds + 1):
            parts.append(
                f"{name}{k} AS MATERIALIZED (SELECT host, sum(mass)::BIGINT AS mass FROM (SELECT * FROM {name}0 UNION ALL "
                f"SELECT e.{dst}, m.mass * {DAMPING} // (100 * d.deg) FROM edges e JOIN {name}{k - 1} m ON m.host = e.{src} JOIN degrees d ON d.s = e.src) GROUP BY host)"
            )
        return ",\n".join(parts)

    return f"""
WITH rules(rh, rp, v) AS (VALUES {listed}),
parsed AS (
  SELECT page_id, html, {lower("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fits AS (
  SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, rh || rp) AS k
  FROM parsed, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
ruled AS (SELECT p.*, f.rule, f.v FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM ruled WHERE host <> '' GROUP BY host),
edges AS (
  SELECT DISTINCT host AS src, dst FROM (SELECT host, {lower(f"unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1))")} AS dst FROM parsed WHERE host <> '') WHERE host <> dst),
degrees AS (SELECT src AS s, count(*) AS deg FROM edges GROUP BY 1),
{rank("t", "a", "src", "dst")},
{rank("d", "b", "dst", "src")},
bad AS (
  SELECT d.host FROM d{rounds} d LEFT JOIN t{rounds} t ON t.host = d.host
  WHERE d.mass > coalesce(t.mass, 0) AND d.mass * 10000 >= {threshold * (100 - DAMPING)} * {UNIT}::BIGINT)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM ruled
"""


SQL = sql()
