"""URL filter: explicit rules first, then an empirical-Bayes host reputation.

Labelled pages give each host a count of bad outcomes. The shares of bad pages
shrink down a tree: the public suffix's towards all pages', the registered domain's
towards its suffix's, the host's towards its domain's. Each level's beta prior
has as its strength the beta-binomial moment estimate from the groups of that
level. A host is blocked where the lower posterior bound of its share passes a
limit, so hosts with little evidence stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize
from tidemark.llm.text import lower_ascii, whole
from tidemark.operators.hot import attach

#: (verdict, rule): the rule's host ends at its first slash; its path starts there.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The lower bound is the posterior mean less Z standard deviations; a host is blocked where it passes LIMIT.
Z, LIMIT = 1.645, 0.5
#: Bounds of a prior's strength in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
# Public suffixes of two labels; every other suffix is the last label. Pass others as ``suffixes``.
TWO_LABEL_SUFFIXES = tuple(
    "ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.eg com.hk com.mx com.my com.ng com.pe com.ph com.pk com.pl com.sa com.sg com.tr com.tw com.ua com.ve com.vn"
    " edu.au edu.cn edu.tw go.jp gob.mx gov.au gov.br gov.cn gov.in gov.uk gov.za ltd.uk me.uk ne.jp net.au net.br net.cn net.nz net.uk nhs.uk or.jp or.kr org.au org.br org.cn org.mx org.nz org.tw org.uk org.za plc.uk sch.uk".split()
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(whole(url), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"),) * 2


def _strength(groups: DataFrame) -> DataFrame:
    """One row (strength): the beta prior's size in pages from rows (n, bad), by the moment estimate for beta-binomial counts."""
    sums = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"))
    p = F.col("bad") / F.col("n")
    noise = p * (1 - p)
    between = (F.col("bb") - F.col("n") * p * p - (F.col("m") - 1) * noise) / (F.col("n") - F.col("nn") / F.col("n"))
    rho = between / noise
    usable = (F.col("m") > 1) & (noise > 0) & (between > 0)
    return sums.select(F.when(usable, F.least(F.greatest((1 - rho) / rho, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(STRONGEST).alias("strength"))


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The host's public suffix: its last two labels where the table has them, else the last."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The host's registered domain: its suffix and the label before it; a host that is a suffix is its own domain."""
    return F.when(F.substring_index(host, ".", -2).isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def reputations(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, mean, lower) from labelled pages (host, bad 0 or 1); rows with a null in either don't count.

    An empty table gives an empty result.
    """
    counted = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = materialize(counted.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    overall = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("above"))

    def shrunk(level: DataFrame, above: DataFrame, on: str | None, name: str) -> DataFrame:
        joined = level.join(above, on) if on else level.crossJoin(F.broadcast(above))
        return joined.crossJoin(F.broadcast(_strength(level))).withColumn(name, (F.col("bad") + F.col("strength") * F.col("above")) / (F.col("n") + F.col("strength")))

    by_suffix = shrunk(suffixes, overall, None, "rate").select("suffix", F.col("rate").alias("above"))
    by_domain = materialize(shrunk(domains, by_suffix, "suffix", "rate").select("domain", F.col("rate").alias("above")), "by_domain")
    by_host = shrunk(hosts, by_domain, "domain", "mean")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return by_host.select("host", "n", "bad", "mean", (F.col("mean") - z * deviation).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, reputation) for every row of ``pages``.

    ``outcomes`` are rows (id_col, bad): labelled pages. A null url, or one
    without "://", has an empty host and path; such pages share the reputation
    of the empty host. The longest fitting rule decides; else the host's lower
    bound does. Hosts without labelled pages are allowed; reputation is then
    null. Repeated rows each get a row. Other columns are not read.
    """
    parsed = materialize(pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), "parsed")
    labelled = parsed.join(outcomes.select(F.col(id_col), F.col("bad")), id_col).select("host", "bad")
    met = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(met.join(reputations(labelled, z).select("host", "lower"), "host", "left"), "known")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("lower") > limit, "block").otherwise("allow")
    told = attach(parsed, known, "host", known.agg(F.sum("n")).first()[0] or 0)
    return told.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), F.col("lower").alias("reputation"))
