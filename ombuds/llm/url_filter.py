"""URL rules first, then an empirical-Bayes host reputation from labelled page outcomes.

Outcomes (bad or not) are counted per host. Beta-binomial priors shrink them top down: the
rate over all pages is the prior of a suffix, the suffix's posterior mean that of a registered
domain, the domain's that of a host. Each level's prior strength is estimated from the spread
of its children's rates (method of moments). A page is blocked if the lower bound of its
host's posterior bad rate (mean - z sd) exceeds a limit; hosts without labels take their
domain's posterior mean as prior.

Defined results: a null url or one without ``://`` has an empty host and path and no rule,
and is judged as host ``''``; repeated rows are judged each; an empty table gives no rows;
without outcomes nothing is blocked but by a rule. Columns beyond those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: (verdict, rule), host up to the first slash, then the start of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
Z, BAD_LIMIT = 1.645, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns; ASCII capitals of the host are lowered, null becomes empty."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. ``rules`` is a short list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones overrule
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) \
            & F.startswith(path, F.lit(rule[at:]))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the last two labels and the last label of a host."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def strength(children: DataFrame) -> float:
    """The prior strength that the spread of the labelled children's rates implies."""
    t = children.where("n > 0").agg(
        F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.try_divide(F.col("bad") * F.col("bad"), F.col("n"))).alias("bb"))
    p = F.try_divide("B", "N")
    t = t.select("*", p.alias("p"), (F.col("N") - F.try_divide("nn", "N")).alias("d"))
    tau = F.try_divide(F.col("bb") - F.col("N") * F.col("p") * F.col("p")
                       - (F.col("k") - 1) * F.col("p") * (1 - F.col("p")), F.col("d"))
    s = F.when(tau > 0, F.least(F.greatest(F.try_divide(F.col("p") * (1 - F.col("p")), tau) - 1,
                                           F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)))
    return t.select(F.coalesce(s, F.lit(MOST_STRENGTH))).first()[0]


def posterior(prior: Column, s: float) -> Column:
    """Posterior mean of a beta prior with the given mean and strength."""
    return (F.col("bad") + s * prior) / (F.col("n") + s)


def reputation(spark: SparkSession, outcomes: DataFrame) -> DataFrame:
    """(host, mean, bound) per host, from rows (host, bad 0/1, null where unlabelled).

    Hosts are summed from rows, domains and suffixes from hosts, so a hot host is reduced
    in each task. The counts per host are written once; four numbers (the overall rate and
    a strength per level) come to the driver.
    """
    domain, suffix = levels(F.col("host"))
    hosts = written(spark, outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    overall = hosts.agg(F.try_divide(F.sum("bad"), F.sum("n"))).first()[0]
    s1, s2, s3 = (strength(level) for level in (suffixes, domains, hosts))
    top = suffixes.select("suffix", posterior(F.lit(overall).cast("double"), s1).alias("m1"))
    mid = domains.join(top, "suffix").select("domain", posterior(F.col("m1"), s2).alias("m2"))
    post = hosts.join(mid, "domain").select("host", "n", posterior(F.col("m2"), s3).alias("mean"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s3 + 1))
    return post.select("host", "mean", (F.col("mean") - Z * sd).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = BAD_LIMIT,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: host, path, the rule that fits, the host's posterior bound and the verdict.

    ``outcomes`` has (page id as ``id``, ``bad`` 0 or 1); several rows of a page count as
    their largest. Pages are shuffled by id only as (id, host) and once by host.
    """
    host, path = url_parts(F.col(url_col))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = p.select("page_id", "host").join(known, F.col("page_id") == F.col("id"), "left").select("host", "bad")
    p = p.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    found = p.join(reputation(pages.sparkSession, labelled).select(F.col("host").alias("h"), "mean", "bound"),
                   F.col("host") == F.col("h"), "left")
    learned = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                        F.coalesce(F.col("r.verdict"), learned).alias("verdict"),
                        F.round("bound", 9).alias("bad_bound"))
