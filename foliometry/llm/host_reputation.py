"""URL filters: rules for hosts and paths, and empirical-Bayes reputations for the hosts that no rule names.

Labelled page outcomes are counted per host, registered domain, suffix and over all. A level's concentration (how alike the children of one
parent are) is a moment estimate over all groups of that level; with it the mean of the parent becomes the beta prior of the child, from the
whole down to the host. A host is blocked when the lower bound of its posterior share of bad pages passes a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.tables import read, stored

#: (verdict, host, path): the rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of two labels below which names are registered; other suffixes have one label.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")

MAX_BAD = 0.5
Z = 1.645
LEAST_CORRELATION, MOST_CORRELATION = 1e-4, 0.95
BROADCAST_HOSTS = 200_000
HOT_PAGES = 1_000_000

LEVELS = ("host", "domain", "suffix", "root")


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    rest = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    bare = F.substring_index(F.substring_index(after_scheme(url), "?", 1), "#", 1)
    at = F.instr(bare, "/")
    return F.when(at > 0, F.substring(bare, at, F.length(bare))).otherwise("")


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last label, or the last two where these are a known suffix; of a name without port and final dot. An address of digits is its own suffix."""
    name = bare_name(host)
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$|^\["), name).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and one label before it, if there is one."""
    name, suffix = bare_name(host), suffix_of(host, suffixes)
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(name == suffix, name).when(labels == 3, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def bare_name(host: Column) -> Column:
    return F.regexp_replace(host, r"^[^@]*@|(?<!:):[0-9]*$|\.$", "")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, ties to the longer host, then to block; null if none fits."""
    fitting = []
    for verdict, name, start in rules:
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        order = (F.lit(len(name) + len(start)).alias("size"), F.lit(len(name)).alias("name_size"), F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        fitting.append(F.when(fits, F.struct(*order)))
    return F.array_max(F.array_compact(F.array(*fitting))) if rules else F.lit(None).cast("struct<verdict:string,rule:string>")


def named(hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """With domain, suffix and root of each host."""
    return hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes), "root": F.lit("")})


def concentration(children: DataFrame, parent: str) -> DataFrame:
    """One row (strength): the pseudo-count of the prior that children (n, bad) get from their parents, from the correlation inside children.

    With shares p of children and q of parents, the spread sum n (p - q)^2 is compared with what binomial draws alone would give.
    """
    groups = children.groupBy(parent).agg(
        F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("shares")
    )
    q = F.col("all_bad") / F.col("all_n")
    spread = F.col("shares") - F.col("all_bad") * q
    chance = (F.col("k") - 1) * q * (1 - q)
    room = (F.col("all_n") - F.col("squares") / F.col("all_n") - (F.col("k") - 1)) * q * (1 - q)
    total = groups.agg(F.sum(spread - chance).alias("excess"), F.sum(room).alias("room"))
    correlation = F.when(F.col("room") > 0, F.col("excess") / F.col("room")).otherwise(F.lit(LEAST_CORRELATION))
    bounded = F.least(F.greatest(correlation, F.lit(LEAST_CORRELATION)), F.lit(MOST_CORRELATION))
    return total.select(((1 - bounded) / bounded).alias("strength"))


def reputations(outcomes: DataFrame, hosts: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, low): the posterior share of bad pages of each distinct host and its lower bound.

    outcomes: (host, n, bad) of labelled pages, several rows per host allowed. Hosts without outcomes have their parent's prior; without any
    outcome at all the mean is a half. Counts are aggregated before every shuffle, so a host with a third of all pages is one row per task.
    """
    wanted = stored(named(hosts.select("host").distinct(), suffixes))
    counted = outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).where("n > 0")
    levels = {"host": stored(named(counted, suffixes))}
    for child, parent in zip(LEVELS, LEVELS[1:], strict=False):
        levels[parent] = levels[child].groupBy(*LEVELS[LEVELS.index(parent) :]).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    strength = {c: concentration(levels[c], p).first()["strength"] for c, p in zip(LEVELS, LEVELS[1:], strict=False)}
    total = levels["root"].first()
    overall = (total["bad"] + 1) / (total["n"] + 2) if total else 0.5
    priors = wanted.select("suffix").distinct().withColumn("mean", F.lit(overall))
    for level in ("suffix", "domain"):
        known = priors if level == "suffix" else wanted.select("domain", "suffix").distinct().join(priors, "suffix")
        known = known.join(levels[level].select(level, "n", "bad"), level, "left").fillna(0.0, ["n", "bad"])
        priors = known.select(level, ((F.col("bad") + strength[level] * F.col("mean")) / (F.col("n") + strength[level])).alias("mean"))
    rows = wanted.select("host", "domain").join(priors, "domain").join(levels["host"].select("host", "n", "bad"), "host", "left").fillna(0.0, ["n", "bad"])
    a = F.col("bad") + strength["host"] * F.col("mean")
    b = F.col("n") - F.col("bad") + strength["host"] * (1 - F.col("mean"))
    posterior = a / (a + b)
    low = posterior - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return rows.select("host", F.col("n").cast("bigint").alias("n"), F.col("bad").cast("bigint").alias("bad"), posterior.alias("mean"), low.alias("low"))


def with_reputation(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """pages joined with hosts on host. Many hosts are joined by a shuffle, but those with over HOT_PAGES pages, at most one per HOT_PAGES pages, by a broadcast."""
    if hosts.count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(hosts), "host", "left")
    hot = stored(pages.groupBy("host").count().where(F.col("count") > HOT_PAGES).select("host"))
    few = F.broadcast(hosts.join(F.broadcast(hot), "host", "left_semi"))
    rest = pages.join(F.broadcast(hot), "host", "left_anti").join(hosts, "host", "left")
    return pages.join(F.broadcast(hot), "host", "left_semi").join(few, "host", "left").unionByName(rest)


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """(page_id, host, path, rule, verdict, reputation): one row per row of pages (page_id, url).

    outcomes: (page_url, n, bad), counts of labelled pages by url; urls without a host count for the empty host. A rule decides where one fits,
    otherwise a page is blocked when the lower bound of its host's share of bad pages is above max_bad. Null page_ids are kept, null urls
    and urls without :// have an empty host and path, repeated rows are judged each, empty outcomes block nothing, an empty table gives no
    rows, other columns are ignored. A very long url costs time in proportion to its length and the number of rules.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = outcomes.select(host_of(F.col("page_url").cast("string")).alias("host"), "n", "bad")
    standing = stored(reputations(labelled, rows).select("host", F.col("mean").alias("reputation"), (F.col("low") > max_bad).alias("bad_host")))
    ruled = with_reputation(rows.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules)), standing)
    verdict = F.coalesce("best.verdict", F.when(F.col("bad_host"), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def document_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_url, n, bad): labelled pages. The first number among a path's names is the document that the page shows; it is bad when labelled of low quality or toxic."""
    url = F.col("url").cast("string")
    number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("bigint")
    shown = pages.select(F.concat(F.lit("://"), host_of(url)).alias("page_url"), number.alias("doc_id")).where("doc_id is not null")
    shown = shown.groupBy("page_url", "doc_id").agg(F.count("*").alias("n"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("bigint")
    judged = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), bad.alias("bad")).where("bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return shown.join(judged, "doc_id").groupBy("page_url").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad")).alias("bad"))


def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages, document_outcomes(pages, read(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH cut AS (
  SELECT page_id::BIGINT AS page_id,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), page AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, name, start) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), places AS (
  SELECT host, host AS name, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain FROM (SELECT DISTINCT host FROM page)
), judged AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
  FROM page JOIN judged ON try_cast(regexp_extract(path, '/([0-9]{1,18})(?:[/.]|$)', 1) AS BIGINT) = doc_id JOIN places USING (host) GROUP BY host
), d AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
r AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM s),
grouped AS (
  SELECT 'host' AS level, domain AS parent, n, bad FROM h UNION ALL SELECT 'domain', suffix, n, bad FROM d UNION ALL SELECT 'suffix', '', n, bad FROM s
), moments AS (
  SELECT level, sum(n) AS t, sum(bad) / sum(n) AS q, count(*) - 1 AS k, sum(n * n) AS squares, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS spread FROM grouped GROUP BY level, parent
), strength AS (
  SELECT level, (1 - c) / c AS m FROM (SELECT level, least(greatest(CASE WHEN sum((t - squares / t - k) * q * (1 - q)) > 0
    THEN sum(spread - k * q * (1 - q)) / sum((t - squares / t - k) * q * (1 - q)) ELSE 0.0001 END, 0.0001), 0.95) AS c FROM moments GROUP BY level)
), m AS (
  SELECT coalesce(max(m) FILTER (level = 'host'), 9999) AS host, coalesce(max(m) FILTER (level = 'domain'), 9999) AS domain, coalesce(max(m) FILTER (level = 'suffix'), 9999) AS suffix FROM strength
), suffixes AS (
  SELECT p.suffix, (coalesce(s.bad, 0) + m.suffix * (r.bad + 1) / (r.n + 2)) / (coalesce(s.n, 0) + m.suffix) AS mean
  FROM (SELECT DISTINCT suffix FROM places) p LEFT JOIN s USING (suffix), m, r
), domains AS (
  SELECT p.domain, (coalesce(d.bad, 0) + m.domain * x.mean) / (coalesce(d.n, 0) + m.domain) AS mean
  FROM (SELECT DISTINCT domain, suffix FROM places) p JOIN suffixes x USING (suffix) LEFT JOIN d ON d.domain = p.domain, m
), posterior AS (
  SELECT p.host, coalesce(h.bad, 0) + m.host * x.mean AS a, coalesce(h.n - h.bad, 0) + m.host * (1 - x.mean) AS b
  FROM places p JOIN domains x USING (domain) LEFT JOIN h ON h.host = p.host, m
), standing AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS bad_host FROM posterior),
fits AS (
  SELECT host, path, arg_max({'rule': name || start, 'verdict': verdict}, length(name) + length(start)) AS best
  FROM (SELECT DISTINCT host, path FROM page) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY host, path
)
SELECT page_id, page.host, page.path, best.rule AS rule, coalesce(best.verdict, CASE WHEN bad_host THEN 'block' ELSE 'allow' END) AS verdict
FROM page JOIN standing USING (host) LEFT JOIN fits ON fits.host = page.host AND fits.path = page.path
"""
