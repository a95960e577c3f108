"""Host reputation by empirical Bayes, in DataFrame functions only.

Pages that a rule decides are labelled outcomes (block = bad, allow = good). Their counts per host are shrunk towards
the registered domain, the domain towards its suffix and the suffix towards the whole table: at each level the prior is
a beta distribution around the parent's mean, with a strength found from how much the units of that level differ
(beta-binomial, method of moments). A page that no rule fits is blocked when the lower bound of its host's posterior
stands above ``block_above``, else allowed.

Defined cases: a null url or one without ``://`` has empty host and path and takes part as the host ``''``; repeated
rows count as often as they occur; with no labelled page at all every page is allowed; an empty table gives no rows.
A hot host meets map-side in the counts; the lookup of hosts is a plain join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import cut

# The contract's rules, and suffixes of two labels.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))
TWO_LABELS = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domain_parts(host: Column, two_labels) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    suffix = F.when(F.substring_index(host, ".", -2).isin(list(two_labels)), F.substring_index(host, ".", -2)).otherwise(
        F.substring_index(host, ".", -1))
    deep = F.substring_index(host, ".", -2).isin(list(two_labels))
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)), suffix


def strength(units: DataFrame, least: float, most: float) -> float:
    """Prior strength over units with (n, bad): 1 / intra-class correlation - 1, held between the two bounds."""
    u = units.where("n > 0")
    r = u.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
              F.sum(F.col("n") * F.col("n")).alias("nn"),
              F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()  # one row of sums
    if not r["n"] or r["k"] < 2 or r["bad"] in (0, r["n"]):
        return most if not r["n"] or r["bad"] in (0, r["n"]) else least
    p = r["bad"] / r["n"]
    spread = r["bb"] - r["n"] * p * p
    free = r["n"] - r["nn"] / r["n"] - (r["k"] - 1)
    rho = (spread - p * (1 - p) * (r["k"] - 1)) / (p * (1 - p) * free) if free > 0 else 1.0
    return min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def reputation(counts: DataFrame, *, z: float = 1.645, two_labels=TWO_LABELS, least: float = 0.5,
               most: float = 1000.0) -> DataFrame:
    """(host, bad_mean, bad_bound) from labelled counts (host, n, bad)."""
    domain, suffix = domain_parts(F.col("host"), two_labels)
    hosts = cut(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(*sums).first()  # one row of sums
    p0 = ((whole["bad"] or 0) + 0.5) / ((whole["n"] or 0) + 1.0)
    k_host, k_domain, k_suffix = (strength(x, least, most) for x in (hosts, domains, suffixes))

    def shrunk(k: float, parent: Column) -> Column:
        return (F.col("bad") + k * parent) / (F.col("n") + k)

    s = suffixes.select("suffix", shrunk(k_suffix, F.lit(p0)).alias("suffix_mean"))
    d = domains.join(s, "suffix").select("domain", "suffix", shrunk(k_domain, F.col("suffix_mean")).alias("domain_mean"))
    h = hosts.join(d, ["domain", "suffix"])
    mean = shrunk(k_host, F.col("domain_mean"))
    return h.select("host", mean.alias("bad_mean"),
                    (mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + k_host + 1))).alias("bad_bound"))


def judge(pages: DataFrame, *, rules=RULES, block_above: float = 0.5, key: str = "page_id", url: str = "url",
          **prior) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per page."""
    host, path = url_parts(F.col(f"`{url}`"))
    split = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), says.alias("verdict"))
    counts = ruled.groupBy("host").agg(F.count("verdict").alias("n"),
                                       F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"))
    known = reputation(counts, **prior).select("host", F.when(F.col("bad_bound") > block_above, "block").otherwise(
        "allow").alias("posterior"))
    free = ruled.where("rule is null").drop("verdict").join(known, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("posterior", F.lit("allow")).alias("verdict"))
    return ruled.where("rule is not null").unionByName(free)
