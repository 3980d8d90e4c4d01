"""URL filter: stated rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host and shrunk through beta-binomial
priors: the corpus is the prior of a suffix, the suffix that of a registered
domain, the domain that of a host.  A level's prior is what the level above
knows without the part below it, so no outcome counts twice; its strength is
fitted from the spread of the shares at that level by moments.  A host is
blocked if even the upper bound of its share of good pages is below the cut.

DataFrame functions alone; the rules are a short list and become one expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Standard deviations to the bound, and the least share of good pages a host may have.
Z, CUT = 1.645, 0.5
STRENGTH = (1.0, 1000.0)
#: Suffixes of two labels under which names are registered, unless others are given; all other suffixes are the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "ne.jp", "or.jp", "org.au", "org.uk")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    rest = F.substring(url, F.locate("://", F.coalesce(url, F.lit(""))) + 3, F.length(url))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.locate("://", F.coalesce(url, F.lit(""))) + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label before it."""
    return F.when(F.substring_index(host, ".", -2).isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_match(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits; null if none does.

    A rule is a verdict and a host with a path; it fits that host and all its
    subdomains where the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r)):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _strength(level: DataFrame, mean: float) -> float:
    """Concentration of the beta prior whose means spread as the level's shares do beyond binomial noise."""
    noise = mean * (1 - mean)
    got = level.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - mean, 2)).alias("v"), F.sum("n").alias("n"), F.count("*").alias("g")).first()
    if not got["n"]:
        return STRENGTH[0]
    spread = max(got["v"] / got["n"] - noise * got["g"] / got["n"], 1e-6)
    return min(max(noise / spread - 1, STRENGTH[0]), STRENGTH[1])


def host_reputation(pages: DataFrame, outcomes: DataFrame, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(host, mean, upper): posterior share of good pages of each host of ``pages`` (page, host), and its upper bound.

    ``outcomes`` is (page, good 0/1); a page without one counts for no share.
    """
    hosts = pages.join(outcomes, "page", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = materialise(hosts.withColumns({"domain": domain_of(F.col("host"), two_labels), "suffix": suffix_of(F.col("host"), two_labels)}), "hosts")
    domains = materialise(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = whole["k"] / whole["n"] if whole["n"] else 0.5
    s0, s1, s2 = (_strength(level, mean) for level in (suffixes, domains, hosts))

    def share(k: Column, n: Column, strength: float, prior: Column) -> Column:
        return (k + strength * prior) / (n + strength)

    at = domains.select("suffix", "domain", F.col("n").alias("dn"), F.col("k").alias("dk")).join(suffixes.select("suffix", F.col("n").alias("sn"), F.col("k").alias("sk")), "suffix")
    all_ = hosts.join(at, ["suffix", "domain"])
    c = F.col
    m_suffix = share(c("sk") - c("dk"), c("sn") - c("dn"), s0, F.lit(mean))
    m_domain = share(c("dk") - c("k"), c("dn") - c("n"), s1, m_suffix)
    a, b = c("k") + s2 * c("m"), c("n") - c("k") + s2 * (1 - c("m"))
    sd = F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1)))
    return all_.withColumn("m", m_domain).select("host", (a / (a + b)).alias("mean"), (a / (a + b) + Z * sd).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", cut: float = CUT, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``; ``outcomes``: (page, good).

    A null url, or one without ``://``, has an empty host and path and is judged
    as that host.  A null id has no outcome; rows that share an id are judged one
    by one, each with the outcome.  ``rule`` is null where the reputation
    decides.  ``two_labels``: the suffixes of two labels under which names are
    registered, as the public suffix list has them.
    """
    rows = pages.select(F.col(id_col).alias("page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.where("page is not null").groupBy("page").agg(F.max("good").alias("good"))
    hosts = host_reputation(rows.select("page", "host"), known, two_labels).select("host", F.when(F.col("upper") < cut, "block").otherwise("allow").alias("own"))
    out = rows.join(hosts, "host", "left").withColumn("hit", rule_match(F.col("host"), F.col("path"), rules))
    return out.select(F.col("page").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "own").alias("verdict"))
