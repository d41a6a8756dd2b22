"""URL filter: fixed rules first, then empirical-Bayes host reputation.

Reputation. Labelled page outcomes (bad or not) are counted per host. Three
beta-binomial levels shrink the counts: the suffix's rate towards the overall
rate, the registered domain's towards its suffix's, the host's towards its
domain's. How strongly a level shrinks (its prior's weight) is estimated from
the data by moments: with prior means m and v = m(1 - m), the counts' squared
deviations have expectation sum v (1 + (n - 1) rho), and the weight is
1 / rho - 1. A host is blocked if its posterior mean less ``z`` posterior
standard deviations is over ``limit``; a host without outcomes is judged by the
priors it inherits.

Skew: outcomes are summed per host before any other step; only blocked hosts
are joined back, broadcast after a count, otherwise shuffled with AQE's skew split.

Defined results: a null url or one without ``://`` has empty host and path,
and counts as one (empty) host; null outcomes and page ids are no evidence;
several outcomes of a page count once (bad if any is); a host that is an IP address
is its own domain, and all of them have one empty suffix; repeated pages are
judged and counted row by row; with no outcomes at all nothing is blocked by
reputation; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm.common import ascii_lower, maybe_broadcast, stored


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# Public suffixes of two labels (an excerpt, the default).
TWO_LABEL_SUFFIXES = ["ac.uk", "co.uk", "gov.uk", "org.uk", "co.jp", "or.jp", "co.kr", "co.in", "co.nz", "co.za",
                      "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw"]

# An IPv4 address, or an IPv6 address in brackets, once the port is gone.
IP_HOST = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct (rule, verdict), else null. Rules are
    configuration and become one CASE expression."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    shortest_first = sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path))
    return reduce(lambda rest, r: F.when(
        ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
        F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(rest),
        shortest_first, none)


def _suffix_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("suffix"))


def _with_levels(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts`` (host, n, y; one row per host) with its registered domain and public
    suffix: the longest of ``suffixes`` (suffix) that ends the host, else its last
    label; the domain has one label more. Ends of as many labels as the longest
    suffix has meet the table, and fold again under the hosts' own partitioning."""
    known = stored(suffixes.select(ascii_lower(F.col("suffix")).alias("end")).where("end is not null").distinct(), "url-suffixes")
    deepest = known.agg(F.max(F.size(F.split("end", r"\.")))).first()[0] or 1
    site = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    ends = F.expr(f"explode(transform(sequence(1, least({deepest}, size(split(site, '[.]')))), k -> named_struct('depth', k, 'end', substring_index(site, '.', -k))))")
    deep = (hosts.withColumn("site", site).select("*", ends.alias("e")).select("*", "e.depth", "e.end")
            .join(maybe_broadcast(known.withColumn("listed", F.lit(True))), "end", "left")
            .groupBy("host").agg(F.first("n").alias("n"), F.first("y").alias("y"),
                                 F.coalesce(F.max(F.when(F.col("listed"), F.col("depth"))), F.lit(1)).alias("depth"))
            .withColumn("site", site))  # not carried through the fold: numbers alone are hashed
    address = F.rlike("site", F.lit(IP_HOST))
    return deep.select("host", "n", "y", F.when(address, F.col("site")).otherwise(F.expr("substring_index(site, '.', -(depth + 1))")).alias("domain"),
                       F.when(address, F.lit("")).otherwise(F.expr("substring_index(site, '.', -depth)")).alias("suffix"))


def _prior_weight(groups: DataFrame) -> float:
    """Moment estimate of the beta prior's weight from (n, y, m) per group."""
    v = F.col("m") * (1 - F.col("m"))
    row = (groups.where("n > 0")
           .agg(F.sum(F.col("n") * F.pow(F.col("y") / F.col("n") - F.col("m"), F.lit(2.0)) - v).alias("excess"),
                F.sum(v * (F.col("n") - 1)).alias("scale")).first())
    rho = row.excess / row.scale if row.scale else 0.5
    return 1 / min(max(rho, 1e-3), 0.999) - 1


def _shrunk(groups: DataFrame, weight: float) -> DataFrame:
    """Posterior mean of each group, as ``m`` of the level below."""
    return groups.withColumn("m", (F.col("y") + weight * F.col("m")) / (F.col("n") + weight))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645,
                    suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, y, mean, bound) of every host of ``pages`` (page_id, host);
    ``outcomes`` is (page_id, bad), ``suffixes`` (suffix) a public suffix list of any
    length, of ``TWO_LABEL_SUFFIXES`` if none is given."""
    once = (outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull())
            .groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")))
    hosts = (pages.join(once, "page_id", "left")
             .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y")))
    if suffixes is None:
        suffixes = _suffix_table(pages.sparkSession, TWO_LABEL_SUFFIXES)
    hosts = stored(_with_levels(hosts, suffixes), "url-hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "url-domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    rate = (total.y + 0.5) / (total.n + 1)
    tops = tops.withColumn("m", F.lit(rate))
    tops = _shrunk(tops, _prior_weight(tops)).select("suffix", "m")
    domains = domains.join(tops, "suffix")
    domains = stored(_shrunk(domains, _prior_weight(domains)).select("domain", "suffix", "m"), "url-priors")
    hosts = hosts.join(domains, ["domain", "suffix"])
    weight = _prior_weight(hosts)
    mean = (F.col("y") + weight * F.col("m")) / (F.col("n") + weight)
    sd = F.sqrt(mean * (1 - mean) / (F.col("n") + weight + 1))
    return hosts.select("host", "n", "y", mean.alias("mean"), (mean - z * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = 0.3, z: float = 1.645,
          suffixes: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block);
    ``suffixes`` as for ``host_reputation``."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    total = outcomes.where("bad is not null").limit(1).count()
    reputation = host_reputation(split.select("page_id", "host"), outcomes, z, suffixes)
    blocked = reputation.where((F.col("bound") > limit) & F.lit(total > 0)).select("host", F.lit("block").alias("judged"))
    ruled = split.withColumn("r", apply_rules(F.col("host"), F.col("path"), rules))
    return (ruled.join(maybe_broadcast(stored(blocked, "url-blocked")), "host", "left")
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce(F.col("r.verdict"), F.col("judged"), F.lit("allow")).alias("verdict")))
