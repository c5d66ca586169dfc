"""URL filter: empirical-Bayes reputation of hosts, with rules that take precedence.

Labelled page outcomes are counted per host, registered domain and suffix. The suffix
is the last label, or the last two where they are known as a suffix (``TWO_LABELS``, or
a table); the registered domain is the suffix with the label before it. Each level's bad
rate is shrunk towards its parent's posterior mean with a beta-binomial prior:

    suffix: (bad + M * base) / (n + M), base = (all bad + 1) / (all n + 2)
    domain: the same with the suffix's mean as base, host: with the domain's

M, the prior's strength, is fitted to the outcomes at each level by moments. With rates
around their parents' means m, the sum of n * (bad / n - m)^2 / (m * (1 - m)) over k groups of
N outcomes is expected to be k + rho * (N - k), where rho = 1 / (M + 1) is the correlation of
outcomes within a group. rho is held within ``RHO`` and rounded, so that no sum's order
shows; where no group has two outcomes there is nothing to fit, and M is ``STRENGTH``.

A host is blocked when the lower bound of its posterior, mean - Z * sd of
Beta(a, b), exceeds ``LIMIT``; unseen hosts take their nearest known ancestor's
posterior by the same formula with no own outcomes.

Only counts per host are shuffled; one hot host is summed in each scan task first,
and the join of verdicts to pages splits a hot host's pages under adaptive execution.

Edge cases: a null url or one without ``://`` has host and path ''; such urls count as
one host, with their own outcomes; null outcomes count as unlabelled; several labels of one page count
each; an empty label table allows everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import can_broadcast, staged

STRENGTH, Z, LIMIT = 8.0, 1.64, 0.5
#: Bounds of the fitted correlation: strengths from 1 to 999.
RHO = (0.001, 0.5)
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which domains are registered.
TWO_LABELS = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")
_TWO = r"(^|\.)(" + "|".join(TWO_LABELS).replace(".", r"\.") + ")$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEVELS = ("suffix", "domain", "host")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; '' where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text (host and path) and verdict, null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _with_levels(df: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Add domain and suffix of ``host``; ``suffixes`` (suffix) has the two-label suffixes instead of ``TWO_LABELS``."""
    one_label, two_labels, three_labels = (F.regexp_extract("host", r"(?s)([^.]*\.)" + f"{{0,{n}}}" + r"[^.]*$", 0) for n in range(3))
    if suffixes is None:
        known, two = df, F.col("host").rlike(_TWO)
    else:
        table = suffixes.select(F.translate("suffix", _UPPER, _LOWER).alias("two")).where("two is not null").distinct()
        known = df.withColumn("two", two_labels).join(F.broadcast(table.withColumn("known", F.lit(True))) if can_broadcast(table) else table.withColumn("known", F.lit(True)), "two", "left")
        two = F.coalesce("known", F.lit(False))
    named = known.withColumn("domain", F.when(two, three_labels).otherwise(two_labels)).withColumn("suffix", F.when(two, two_labels).otherwise(one_label))
    return named.select(*df.columns, "domain", "suffix")


def fitted_strength(groups: DataFrame) -> DataFrame:
    """One row, strength: the prior's, by moments, from groups (n, bad, m) around their parents' means m."""
    n, m, seen = F.col("n"), F.col("m"), F.col("n") > 0
    spread = F.sum(F.when(seen, n * F.pow(F.col("bad") / n - m, 2) / (m * (1 - m))))
    sums = groups.agg(spread.alias("s"), F.count_if(seen).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("N"))
    rho = F.round(F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), (F.col("s") - F.col("k")) / (F.col("N") - F.col("k")))), 6)
    return sums.select(F.when(F.col("N") > F.col("k"), 1 / rho - 1).otherwise(STRENGTH).alias("strength"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """Per host: n, bad, posterior a and b, mean and lower bound.

    ``pages`` has page_id and host, ``outcomes`` page_id and bad (0 or 1).
    """
    seen = pages.join(outcomes.where("page_id is not null and bad is not null"), "page_id", "left")
    counted = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = staged(_with_levels(counted, suffixes), "url-hosts")
    root = hosts.select(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("m"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    posterior = ((F.col("bad") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength"))).alias("m")
    suffix = hosts.groupBy("suffix").agg(*sums).join(F.broadcast(root))  # one row, so are fitted strengths
    suffix = suffix.join(F.broadcast(fitted_strength(suffix))).select("suffix", posterior)
    domain = hosts.groupBy("suffix", "domain").agg(*sums).join(suffix, "suffix")
    domain = domain.join(F.broadcast(fitted_strength(domain))).select("domain", posterior)
    host = hosts.select("host", "domain", "n", "bad").join(domain, "domain")
    a = F.col("bad") + F.col("strength") * F.col("m")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("m"))
    out = host.join(F.broadcast(fitted_strength(host))).select("host", "n", "bad", a.alias("a"), b.alias("b"))
    mean, var = F.col("a") / (F.col("a") + F.col("b")), F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1))
    return out.select("*", mean.alias("bad_rate"), (mean - z * F.sqrt(var)).alias("bad_lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate and bad_lower of every page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(parts, outcomes, suffixes=suffixes).select("host", F.round("bad_rate", 9).alias("bad_rate"), F.round("bad_lower", 9).alias("bad_lower"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_lower") > limit, "block").otherwise("allow")
    return parts.join(known, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_lower"
    )


def _fit_sql(groups: str) -> str:
    """SQL for the strength fitted to a table of n, bad and m."""
    return f"""(SELECT CASE WHEN sum(n) > count(*) FILTER (n > 0) THEN 1 / round(greatest({RHO[0]}::DOUBLE, least({RHO[1]}::DOUBLE,
      (sum(n * pow(bad / n - m, 2) / (m * (1 - m))) FILTER (n > 0) - count(*) FILTER (n > 0)) / (sum(n) - count(*) FILTER (n > 0)))), 6) - 1
      ELSE {STRENGTH}::DOUBLE END FROM {groups})"""


ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
outcome AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels
            WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL),
hosts AS (SELECT host, regexp_extract(host, CASE WHEN regexp_matches(host, '{_TWO}') THEN '([^.]*\\.){{0,2}}[^.]*$' ELSE '([^.]*\\.)?[^.]*$' END) AS domain,
                 regexp_extract(host, CASE WHEN regexp_matches(host, '{_TWO}') THEN '([^.]*\\.)?[^.]*$' ELSE '[^.]*$' END) AS suffix,
                 count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
          FROM parts LEFT JOIN outcome USING (page_id) GROUP BY host),
root AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts, root GROUP BY suffix),
s AS (SELECT suffix, (bad + {_fit_sql('s0')} * m) / (n + {_fit_sql('s0')}) AS m FROM s0),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(s.m) AS m FROM hosts JOIN s USING (suffix) GROUP BY domain),
d AS (SELECT domain, (bad + {_fit_sql('d0')} * m) / (n + {_fit_sql('d0')}) AS m FROM d0),
h0 AS (SELECT host, n, bad, d.m AS m FROM hosts JOIN d USING (domain)),
ab AS (SELECT host, bad + {_fit_sql('h0')} * m AS a, n - bad + {_fit_sql('h0')} * (1 - m) AS b FROM h0),
rep AS (SELECT host, round(a / (a + b), 9) AS bad_rate,
               round(a / (a + b) - {Z}::DOUBLE * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))), 9) AS bad_lower FROM ab),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bad_lower > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict, bad_rate, bad_lower
FROM ruled LEFT JOIN rep USING (host)
"""
