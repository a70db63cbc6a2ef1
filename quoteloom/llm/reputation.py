"""Host reputation: labelled page outcomes shrunk from host to registered domain to suffix, and fixed URL rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path): the longest rule that fits a url decides.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Suffixes of two labels; every other name's suffix is its last label.
TWO_LABEL = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "com.br", "co.nz", "co.in", "co.za", "com.mx", "com.ar"]
#: A host is blocked when the upper posterior bound of its share of good pages is under this.
MIN_GOOD, Z = 0.7, 1.0
#: Prior strength (pages) where the hosts of a level tell no spread, and its limits.
STRENGTH, WEAKEST, STRONGEST = 10.0, 1.0, 200.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path`` of every row; null or without ``://``: both empty."""
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    return named.select("id", host.alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the url's or a parent of it and whose path begins the url's path, else nulls."""
    ranked = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(TWO_LABEL), two).otherwise(F.substring_index(host, ".", -1))
    size = F.when(two.isin(TWO_LABEL), 3).otherwise(2)
    return F.when(F.size(labels) <= size, host).otherwise(F.when(size == 3, F.substring_index(host, ".", -3)).otherwise(two)), suffix


def _strength(rows: DataFrame, by: str) -> DataFrame:
    """Beta-binomial prior strength per parent, by moments over its labelled members (n, good, and the parent's mean)."""
    p, n = F.col("_mean"), F.col("n")
    spread = rows.groupBy(by).agg(
        F.sum(n * (F.col("good") / n - p) * (F.col("good") / n - p)).alias("_ss"), F.sum(n).alias("_n"), F.sum(n * n).alias("_n2"),
        F.count("*").alias("_k"), F.first("_mean").alias("_m"))
    v = F.col("_m") * (1 - F.col("_m"))
    effective = F.col("_n") - F.col("_n2") / F.col("_n")
    between = (F.col("_ss") - (F.col("_k") - 1) * v) / effective
    strength = F.when((F.col("_k") < 2) | (v <= 0) | (effective <= 0), F.lit(STRENGTH)).when(between <= 0, F.lit(STRONGEST)).otherwise(v / between - 1)
    return spread.select(by, F.least(F.greatest(strength, F.lit(WEAKEST)), F.lit(STRONGEST)).alias("_s"))


def reputations(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host``, ``posterior`` (share of good pages), ``bound`` (upper posterior bound), ``labelled``: one row per host.

    ``outcomes``: ``id``, ``good`` (1 or 0) of labelled pages; several outcomes of a page all count, null ones don't. The prior of
    a suffix is all pages' share; of a registered domain its suffix's posterior; of a host its domain's. How strongly a level
    shrinks comes from the spread of its members around their parent (beta-binomial moments). Counts are partial sums before
    each shuffle, so a host with a third of all pages is one row per task.
    """
    counts = urls.join(outcomes.filter("good is not null and id is not null"), "id", "left").groupBy("host").agg(
        F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    domain, suffix = levels(F.col("host"))
    hosts = counts.select("host", "n", "good", domain.alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = suffixes.withColumn("_all", F.lit(1))
    whole = suffixes.groupBy("_all").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("_mean"))  # one row

    def shrunk(level: DataFrame, parent: DataFrame, on: str) -> DataFrame:
        rows = level.join(parent, on)
        return rows.join(_strength(rows.filter("n > 0"), on), on, "left").withColumn("_s", F.coalesce("_s", F.lit(STRENGTH)))

    post = (F.col("good") + F.col("_s") * F.col("_mean")) / (F.col("n") + F.col("_s"))
    top = shrunk(suffixes, whole, "_all").select("suffix", post.alias("_mean"))
    middle = shrunk(domains, top, "suffix").select("domain", post.alias("_mean"))
    low = shrunk(hosts.select("host", "domain", "n", "good"), middle, "domain")
    spread = F.sqrt(F.col("_p") * (1 - F.col("_p")) / (F.col("n") + F.col("_s") + 1))
    return low.withColumn("_p", post).select("host", F.col("_p").alias("posterior"), (F.col("_p") + Z * spread).alias("bound"), F.col("n").cast("long").alias("labelled"))


def judged(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``posterior``, ``bound`` of every row of ``pages``.

    The longest rule that fits decides; else a host is blocked when its upper posterior bound is under MIN_GOOD, that is when
    even a favourable reading of its pages is poor. Null urls and urls without ``://`` share the empty host; repeated rows give
    repeated rows; pages are read for id and url alone. An empty table gives an empty one.
    """
    urls = split_urls(pages, id_col, url_col)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    known = reputations(urls, outcomes)
    own = F.when(F.col("bound") < MIN_GOOD, "block").otherwise("allow")
    # the hosts' table is small next to the pages; a hot host's pages are split by the adaptive skew join
    return urls.join(known, "host", "left").select(
        "id", "host", "path", rule.alias("rule"), F.coalesce(action, own).alias("verdict"), "posterior", "bound")
