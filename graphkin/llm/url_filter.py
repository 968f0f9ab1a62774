"""URL filter: explicit rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (good or bad) are counted by host.  Three beta-binomial
levels shrink them: a suffix towards the global rate, a registered domain
towards its suffix, a host towards its domain.  The concentration of each level
is estimated from how its children scatter around their parents (method of
moments; at least one pseudo-outcome, so that a single label decides nothing).
A page is blocked when the lower posterior bound of its host's bad rate lies
above ``max_bad``.

Domains: user, port and a final dot are left out; an address in numbers is a
domain of its own.  The registered domain is the public suffix and one label
more.  Public suffixes come from ``suffixes``, a table of them; without one, a
suffix is the last label, or the last two where they are one of ``SECOND`` and a
country of two letters.

Everything is a DataFrame aggregate or join: hot hosts are pre-aggregated before
each shuffle, the counts by host, domain and suffix are written once, and the
join back to the pages can be split by AQE.  Only the rates of one row and the
table of suffixes are broadcast.

Defined cases: a null url or one without ``://`` has an empty host and path and
is judged like any other host; repeated pages are judged each; without any
labelled page the prior rate is 0.5 over one pseudo-outcome and nothing is
blocked but by rules; a null label takes no part.  Of rules that fit and are
equally long the one whose (host, path) sorts last counts.  Urls of any length
are matched whole; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii

#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: fixed values: second levels that countries give out names below
SECOND = ("co", "com", "org", "net", "ac", "gov", "edu")


def name_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None, *, host: str = "host") -> DataFrame:
    """hosts (one row each) with domain and suffix.  suffixes: column suffix."""
    name, number = name_of(F.col(host)), r"^([0-9]+(\.[0-9]+){3}|\[.*)$"
    if suffixes is None:
        labels = F.when(name.rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z]{{2}}$"), 2).otherwise(1)
        rows = hosts.select("*", name.alias("_name"), labels.alias("_labels"))
    else:
        listed = F.broadcast(suffixes.select(lower_ascii(F.col("suffix")).alias("_suffix")).distinct())
        split = F.split(name, r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(split)), lambda k: F.array_join(F.slice(split, F.size(split) - k + 1, k), "."))
        parts = hosts.select(F.col(host).alias("_host"), F.posexplode(ends).alias("_k", "_suffix"))
        longest = parts.join(listed, "_suffix").groupBy("_host").agg(F.max(F.col("_k") + 1).alias("_most"))
        rows = hosts.join(longest, F.col(host) == F.col("_host"), "left").select(*(F.col(f"`{c}`") for c in hosts.columns), name.alias("_name"), F.coalesce("_most", F.lit(1)).alias("_labels"))
    labels = F.split("_name", r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - k + 1), k), ".")
    numeric = F.col("_name").rlike(number)
    domain = F.when(numeric, F.col("_name")).otherwise(last(F.col("_labels") + 1))
    suffix = F.when(numeric, F.lit("")).otherwise(last(F.col("_labels")))
    return rows.select(*(F.col(f"`{c}`") for c in hosts.columns), domain.alias("domain"), suffix.alias("suffix"))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  The list is compiled into one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _concentration(children: DataFrame, parent_rate: str) -> DataFrame:
    """One row, kappa: children has n and bad, and the rate of the parent."""
    p, n, k = F.col(parent_rate), F.col("n").cast("double"), F.col("bad").cast("double")
    spread = p * (1 - p)
    rho = (F.sum(n * (k / n - p) * (k / n - p)) - F.sum(spread)) / F.nullif(F.sum(spread * (n - 1)), F.lit(0.0))
    return children.agg(F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(rho, F.lit(0.5)))).alias("rho")).select((1 / F.col("rho") - 1).alias("kappa"))


def host_reputation(labelled: DataFrame, suffixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From labelled(host, bad 0/1): hosts(host, n, bad), domains(domain, rate), suffixes(suffix, rate) and one row (rate, kappa)."""
    counts = labelled.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = checkpoint(with_domains(counts, suffixes))
    domains = checkpoint(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    by_suffix = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = by_suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("top_rate"))
    # each of the broadcast sides below is an aggregate without keys: one row
    one = lambda df, row: df.join(F.broadcast(row))
    shrunk = lambda prior: (F.col("kappa") * F.col(prior) + F.col("bad")) / (F.col("kappa") + F.col("n"))
    s = checkpoint(one(by_suffix, top))
    s = checkpoint(one(s, _concentration(s, "top_rate")).select("suffix", shrunk("top_rate").alias("suffix_rate")))
    d = checkpoint(domains.join(s, "suffix"))
    d = checkpoint(one(d, _concentration(d, "suffix_rate")).select("domain", shrunk("suffix_rate").alias("domain_rate")))
    top = checkpoint(one(top, _concentration(hosts.join(d, "domain"), "domain_rate")))
    return hosts.select("host", "n", "bad"), d, s, top


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule], *, url: str = "url", max_bad: float = 0.5, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, bad_rate, bad_bound and verdict (allow or block).  labelled has host and bad (0 or 1)."""
    hosts, domains, by_suffix, top = host_reputation(labelled, suffixes)
    clash = ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")
    kept = pages.drop(*(c for c in pages.columns if c.lower() in clash and c != url))
    df = kept.select(F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # one row for each host of the pages, so that the pages themselves are joined once, on a small key table
    known = with_domains(df.select("host").distinct(), suffixes)
    known = known.join(hosts, "host", "left").join(domains, "domain", "left").join(by_suffix, "suffix", "left").join(F.broadcast(top))
    prior = F.coalesce("domain_rate", "suffix_rate", "top_rate")
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    a, b = F.col("kappa") * prior + bad, F.col("kappa") * (1 - prior) + n - bad
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    known = checkpoint(known.select("host", (a / (a + b)).alias("bad_rate"), bound.alias("bad_bound")))
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    out = df.join(known, "host", "left")
    return out.select(*(F.col(f"page.`{c}`") for c in kept.columns if c.lower() not in clash), "host", "path", rule.alias("rule"), "bad_rate", "bad_bound", F.coalesce(by_rule, method).alias("verdict"))
