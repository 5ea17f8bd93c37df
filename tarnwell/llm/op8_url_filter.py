"""URL filter: fixed rules, and empirical-Bayes reputation of hosts for all other pages, with DataFrame functions only.

A labelled outcome is 1 for a bad page. Outcomes are counted for each host, then summed to registered domains (the
last two labels of the host) and suffixes (the last label). Going down, each level's rate is shrunk towards its
parent's by a beta-binomial prior whose strength is fitted to the level by moments. A host is blocked if its
posterior mean less `Z` deviations is over `BOUND`; so a few bad pages never block a host.

The query has no outcome table, so it labels every page itself (`page_outcomes`): bad if the host's name has one of
`SPAM` as a word, or the page shouts ("!!") or insults. Any other table (page_id or url, bad) can be given instead.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule and is allowed; equal urls
get equal verdicts; null page_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm._common import materialise, table

NAME = "op8_url_filter"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SPAM = ["casino", "pills", "spam", "bets", "adult", "xxx", "viagra"]
INSULTS = ["idiot", "scum", "pathetic", "worthless", "stupid"]
BOUND = 0.5
Z = 1.645
BROADCAST = 100_000
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UP, _LOW)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def page_outcomes(pages: DataFrame) -> DataFrame:
    """host, bad for each page that has a host."""
    named = F.col("host").rlike(rf"(^|[.-])({'|'.join(SPAM)})([.-]|$)")
    text = F.coalesce("html", F.lit(""))
    rude = text.contains("!!") | text.rlike(r"\b(" + "|".join(INSULTS) + r")\b")
    return pages.select(host(F.col("url")).alias("host"), "html").filter("host != ''").select("host", (named | rude).cast("int").alias("bad"))


def _labels(of: Column, n: int) -> Column:
    return F.array_join(F.slice(F.concat(F.array_repeat(F.lit(""), n), F.split(of, r"\.")), -n, n), ".")


def _strength(level: DataFrame, parent: str) -> float:
    """Prior strength of a level with n, bad and its parents' mean, by moments."""
    m, p, n = F.col(parent), F.col("bad") / F.col("n"), F.col("n")
    over = F.sum((p - m) * (p - m) - m * (1 - m) / n)
    room = F.sum(m * (1 - m) * (1 - 1 / n))
    got = level.agg(over.alias("over"), room.alias("room")).first()
    share = min(0.999, max(0.001, (got.over or 0.0) / got.room)) if got.room else 0.5
    return 1 / share - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, n, bad, mean, low (the posterior bound) from outcomes (host, bad)."""
    hosts = outcomes.filter("host is not null and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = materialise(hosts, "host-outcomes")  # each level reads it: pages are read once
    hosts = hosts.withColumn("domain", _labels(F.col("host"), 2)).withColumn("suffix", _labels(F.col("host"), 1))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("bad") / F.sum("n")).first()[0] or 0.0
    suffixes = suffixes.withColumn("up", F.lit(float(whole)))
    k = _strength(suffixes, "up")
    mean = (F.col("bad") + F.lit(k) * F.col("up")) / (F.col("n") + F.lit(k))
    domains = domains.join(suffixes.select("suffix", mean.alias("up")), "suffix")
    k = _strength(domains, "up")
    mean = (F.col("bad") + F.lit(k) * F.col("up")) / (F.col("n") + F.lit(k))
    hosts = hosts.join(domains.select("domain", mean.alias("up")), "domain")
    k = _strength(hosts, "up")
    a, b = F.col("bad") + F.lit(k) * F.col("up"), F.col("n") - F.col("bad") + F.lit(k) * (1 - F.col("up"))
    low = a / (a + b) - F.lit(Z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "bad", (a / (a + b)).alias("mean"), low.alias("low"))


def rule_columns(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, bound: float = BOUND) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    bad = materialise(reputation(outcomes).filter(F.col("low") > bound).select("host", F.lit(True).alias("_bad")), "bad-hosts")
    if bad.limit(BROADCAST + 1).count() <= BROADCAST:
        bad = F.broadcast(bad)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(bad, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, page_outcomes(pages))


ORACLE_SQL = rf"""
with p as (
  select page_id, coalesce(html, '') as html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UP}', '{_LOW}'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
o as (
  select host, (regexp_matches(host, '(^|[.-])({'|'.join(SPAM)})([.-]|$)') or contains(html, '!!')
    or regexp_matches(html, '(^|[^0-9A-Za-z_À-ÿ])({'|'.join(INSULTS)})([^0-9A-Za-z_À-ÿ]|$)'))::int as bad
  from p where host <> ''),
h as (
  select host, count(*) as n, sum(bad) as bad, array_to_string(list_concat(['', ''], string_split(host, '.'))[-2:], '.') as domain,
    array_to_string(string_split(host, '.')[-1:], '.') as suffix
  from o group by host),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by all),
s1 as (select *, (select sum(bad) / sum(n) from s)::double as up from s),
ks as (select coalesce(1 / least(0.999, greatest(0.001, sum((bad / n - up) * (bad / n - up) - up * (1 - up) / n) / nullif(sum(up * (1 - up) * (1 - 1 / n)), 0))) - 1, 1) as k from s1),
d1 as (select d.*, (s1.bad + k * s1.up) / (s1.n + k) as up from d join s1 using (suffix), ks),
kd as (select coalesce(1 / least(0.999, greatest(0.001, sum((bad / n - up) * (bad / n - up) - up * (1 - up) / n) / nullif(sum(up * (1 - up) * (1 - 1 / n)), 0))) - 1, 1) as k from d1),
h1 as (select h.*, (d1.bad + k * d1.up) / (d1.n + k) as up from h join d1 using (domain), kd),
kh as (select coalesce(1 / least(0.999, greatest(0.001, sum((bad / n - up) * (bad / n - up) - up * (1 - up) / n) / nullif(sum(up * (1 - up) * (1 - 1 / n)), 0))) - 1, 1) as k from h1),
ab as (select host, bad + k * up as a, n - bad + k * (1 - up) as b from h1, kh),
low as (select host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as low from ab),
r as (
  select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from p)
select page_id, r.host, path, rule,
  case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block' when low > {BOUND} then 'block' else 'allow' end as verdict
from r left join low on r.host = low.host
"""
