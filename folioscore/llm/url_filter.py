"""URL filter by empirical-Bayes reputation of hosts (DataFrame functions only).

Labelled page outcomes are counted per host. Hosts with few labels borrow from their
registered domain, domains from their public suffix, suffixes from the whole table: on each
level a beta prior with the posterior mean of the level above and a strength that is fitted
to how much the groups of that level differ (beta-binomial, analysis-of-variance estimate).
A page is blocked where the lower bound of its host's posterior bad rate is above a limit.

Counts are pre-aggregated before every shuffle. Pages meet their host's row under a salted
key, so a host with a third of all pages is dealt over ``SALTS`` groups.

Defined results: a null url, or one without ``://``, has host and path ``''`` and takes the
posterior of that host. Repeated pages keep their rows; repeated outcomes of a page count
once, as bad if any is bad. Outcomes of unknown pages, and null outcomes, are left out.
Without any outcome every prior is even and nothing is blocked. Input columns other than
``page_id`` and ``url`` do not pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered (others: the last label).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
SALTS = 32
LEVELS = ("host", "domain", "suffix")


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _name(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?\.?$", "")


def public_suffix(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    name = _name(host)
    last_two = F.substring_index(name, ".", -2)
    return F.when(last_two.isin(*two_label), last_two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix and one label more; an address of digits stands for itself."""
    name = _name(host)
    wide = F.substring_index(name, ".", -2).isin(*two_label)
    return (
        F.when(name.rlike(r"^[0-9.]+$|^\["), name)
        .when(wide, F.substring_index(name, ".", -3))
        .otherwise(F.substring_index(name, ".", -2))
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule ``(verdict, host, path)`` that fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit).otherwise(found)
    return found


def _strength(groups: DataFrame) -> float:
    """Prior strength from the spread of bad rates between groups (``n``, ``bad``)."""
    seen = groups.filter("n > 0")
    total = seen.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("within"),
    ).first()
    k, n = total["k"], total["n"] or 0
    if k < 2 or n <= k:
        return 1.0
    between = max(total["within"] - total["bad"] ** 2 / n, 0.0) / (k - 1)
    within = max(total["bad"] - total["within"], 0.0) / (n - k)
    size = (n - total["nn"] / n) / (k - 1)
    share = (between - within) / max(between + (size - 1) * within, 1e-12)
    share = round(min(max(share, 0.001), 0.5), 4)
    return (1 - share) / share


def reputation(urls: DataFrame, outcomes: DataFrame, bound: float = 1.64) -> DataFrame:
    """Row per host: ``host, domain, suffix, n, bad, bad_mean, bad_bound``.

    ``urls`` has ``page_id, host``; ``outcomes`` has ``page_id, bad`` (0 or 1). ``bad_bound``
    is the posterior mean less ``bound`` standard deviations.
    """
    known = (
        outcomes.filter("page_id is not null and bad is not null")
        .groupBy("page_id")
        .agg(F.max("bad").cast("long").alias("_bad"))
    )
    hosts = (
        urls.select("page_id", "host")
        .join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": registered_domain(F.col("host")), "suffix": public_suffix(F.col("host"))})
    )
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(*sums).first()
    prior = F.lit(((whole["bad"] or 0) + 1) / ((whole["n"] or 0) + 2))

    def mean(strength: float, above: Column) -> Column:
        return (F.lit(strength) * above + F.col("bad")) / (F.lit(strength) + F.col("n"))

    suffixes = suffixes.select("suffix", mean(_strength(suffixes), prior).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", "suffix", mean(_strength(domains), F.col("suffix_mean")).alias("domain_mean")
    )
    strength = _strength(hosts)
    total = F.lit(strength) + F.col("n")
    middle = F.col("bad_mean")
    return (
        hosts.join(domains, ["domain", "suffix"])
        .withColumn("bad_mean", mean(strength, F.col("domain_mean")))
        .withColumn("bad_bound", middle - bound * F.sqrt(middle * (1 - middle) / (total + 1)))
        .select("host", "domain", "suffix", "n", "bad", "bad_mean", "bad_bound")
    )


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    max_bad: float = 0.5,
    bound: float = 1.64,
) -> DataFrame:
    """Row per page: ``page_id, host, path, rule, verdict`` and the host's reputation.

    A page is allowed or blocked by the longest rule that fits it, else by whether its host's
    ``bad_bound`` is above ``max_bad``.
    """
    urls = pages.select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt")
    hosts = reputation(urls, outcomes, bound).select("*", salts)
    dealt = urls.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    by_method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    return (
        dealt.join(hosts, ["host", "_salt"])
        .withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
        .select(
            "page_id",
            "host",
            "path",
            F.col("_rule.rule").alias("rule"),
            F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"),
            "domain",
            "suffix",
            F.col("n").alias("host_labels"),
            F.round("bad_mean", 6).alias("bad_mean"),
            F.round("bad_bound", 6).alias("bad_bound"),
        )
    )
