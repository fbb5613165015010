"""URL filters: rules indexed by their rarest literal token.

Every rule names whole URL tokens (runs of letters and digits) that any URL it matches must
hold, or several sets of tokens one of which it must hold. The token of each set that fewest
URLs hold becomes an index entry of the rule; a URL's tokens
fetch the candidate rules, and only those run their regular expression.

Host rules (allow or block a host with its subdomains below a path) and pattern rules share
the index. The longest fitting host rule decides; without one, a URL that any pattern rule
matches is blocked and any other allowed.

Up to ``LITERAL_RULES`` rules the index is a literal of the plan: token counts come from one
aggregation over all URLs that returns at most one row for each literal, and judging is one scan
without a shuffle. A longer blocklist is a table of rules (``judge_by_table``): the tokens of
distinct URLs join the index, which Spark broadcasts only if it is small, and both ways give the
same rows. There a frequent token meets few rules, as a rule is indexed by its rarest token.

A null url, or one without ``://``, has empty host and path and is judged by the pattern rules
alone (a null one is allowed). Each row is judged by its url alone, so repeated rows get one
verdict; of host rules of equal length the greater name wins. Very long urls are read whole. Other
columns stay; those named like a result are replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


#: More rules than this are joined as a table.
LITERAL_RULES = 500


@dataclass(frozen=True)
class HostRule:
    """``action`` (allow or block) for a host, its subdomains, and paths that begin with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """On the host followed by the path."""
        return rf"^(?:[^/]*\.)?{_quoted(self.host)}" + (_quoted(self.path) if self.path else r"(?:/|$)")

    @property
    def literals(self) -> tuple[str, ...]:
        # the last token of a path without a closing delimiter may go on in the URL
        return tuple(re.findall(r"[a-z0-9]+(?=[^a-z0-9])", (self.name + ("/" if not self.path else "")).lower()))


@dataclass(frozen=True)
class PatternRule:
    """Block URLs that ``regex`` finds a match in; each match holds all ``literals``, or all of one of ``alternatives``, as whole tokens."""

    name: str
    regex: str
    literals: tuple[str, ...]
    alternatives: tuple[tuple[str, ...], ...] = ()


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
PATTERN_RULES = (
    PatternRule("spam farm", r"://([^/?#]*[.])?spam-farm[.]", ("spam", "farm")),
    PatternRule("feed tracking", r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed")),
    PatternRule("paged listing", r"[?&]page=[0-9]+(&|#|$)", ("page",)),
    PatternRule("adult", r"://([^/?#]*[./-])?(adult|porn|xxx)[./-]", ("adult",), (("porn",), ("xxx",))),
    PatternRule("login", r"/(wp-)?login[./?#]", ("login",)),
)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(url), "[^a-z0-9]+"))


def rarest_literals(urls: DataFrame, rules: list, url_col: str) -> dict[str, list[str]]:
    """Index tokens of each rule, one for each alternative, by how many URLs of the whole table hold them."""
    sets = {rule.name: (rule.literals, *getattr(rule, "alternatives", ())) for rule in rules}
    literals = sorted({x for own in sets.values() for one in own for x in one})
    held = F.explode(F.array_intersect(_tokens(F.col(url_col)), F.array(*map(F.lit, literals))))
    counts = {r["token"]: r["n"] for r in urls.select(held.alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {name: sorted({min(one, key=lambda x: (counts.get(x, 0), x)) for one in own}) for name, own in sets.items()}


def judge(urls: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, patterns (names of the pattern rules that match) and verdict."""
    rules = [*host_rules, *pattern_rules]
    if len(rules) > LITERAL_RULES:
        return judge_by_table(urls, rule_table(urls.sparkSession, host_rules, pattern_rules), url_col)
    tokens_of = rarest_literals(urls, rules, url_col)

    def index(own: tuple, entry) -> Column:
        by_token: dict[str, list] = {}
        for rule in own:
            for token in tokens_of[rule.name]:
                by_token.setdefault(token, []).append(rule)
        return F.create_map(*[x for token, held in by_token.items() for x in (F.lit(token), F.array(*map(entry, held)))])

    host_index = index(host_rules, lambda r: F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.regex).alias("regex")))
    pattern_index = index(pattern_rules, lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.regex).alias("regex")))
    url = F.coalesce(F.col(url_col), F.lit(""))
    known = F.array(*map(F.lit, sorted({x for tokens in tokens_of.values() for x in tokens})))

    def candidates(rules_of: Column) -> Column:
        return F.flatten(F.filter(F.transform("_td_tokens", lambda t: F.try_element_at(rules_of, t)), lambda x: x.isNotNull()))

    keep = [F.col(c) for c in urls.columns if c not in ("host", "path", "rule", "patterns", "verdict")]
    parted = urls.select(*keep, url.alias("_td_url"), lower_ascii(F.regexp_extract(url, _PARTS, 1)).alias("host"), F.regexp_extract(url, _PARTS, 2).alias("path"), F.array_intersect(_tokens(url), known).alias("_td_tokens"))
    found = parted.select(
        *keep,
        "host",
        "path",
        F.array_max(F.filter(candidates(host_index), lambda r: F.regexp_like(F.concat("host", "path"), r["regex"]))).alias("_td_best"),
        F.transform(F.filter(candidates(pattern_index), lambda r: F.regexp_like(F.col("_td_url"), r["regex"])), lambda r: r["name"]).alias("patterns"),
    )
    verdict = F.coalesce(F.col("_td_best.action"), F.when(F.size("patterns") > 0, "block").otherwise("allow"))
    return found.select(*keep, "host", "path", F.col("_td_best.name").alias("rule"), F.array_sort(F.array_distinct("patterns")).alias("patterns"), verdict.alias("verdict"))


def rule_table(spark: SparkSession, host_rules: Iterable[HostRule], pattern_rules: Iterable[PatternRule]) -> DataFrame:
    """Rules as rows: name, action, size (of host rules, else null), regex, literals (sets of tokens, one of which each match holds)."""
    rows = [(r.name, r.action, len(r.name), r.regex, [list(r.literals)]) for r in host_rules]
    rows += [(r.name, "block", None, r.regex, [list(x) for x in (r.literals, *r.alternatives)]) for r in pattern_rules]
    return spark.createDataFrame(rows, "name string, action string, size int, regex string, literals array<array<string>>")


def judge_by_table(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``judge`` by a table of rules as ``rule_table`` makes it."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    tokens = urls.select(url.alias("_td_url")).distinct().select("_td_url", F.explode(_tokens(F.col("_td_url"))).alias("token"))
    sets = rules.select("name", "action", "size", "regex", F.explode("literals").alias("one"))
    named = sets.select(F.explode("one").alias("token")).distinct()
    counts = tokens.join(named, "token").groupBy("token").agg(F.count("*").alias("n"))
    each = sets.select("*", F.explode("one").alias("token")).join(counts, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    index = each.groupBy("name", "action", "size", "regex", "one").agg(rarest).select("token", "name", "action", "size", "regex").distinct()
    candidates = tokens.join(index, "token")
    on_host = F.concat(lower_ascii(F.regexp_extract("_td_url", _PARTS, 1)), F.regexp_extract("_td_url", _PARTS, 2))
    matched = candidates.where(F.regexp_like(F.when(F.col("size").isNotNull(), on_host).otherwise(F.col("_td_url")), F.col("regex")))
    host = F.col("size").isNotNull()
    found = matched.groupBy("_td_url").agg(F.max(F.when(host, F.struct("size", "name", "action"))).alias("_td_best"), F.collect_set(F.when(~host, F.col("name"))).alias("_td_patterns"))
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "patterns", "verdict")]
    joined = urls.select(*keep, url.alias("_td_url")).join(found, "_td_url", "left")
    patterns = F.array_sort(F.coalesce("_td_patterns", F.array().cast("array<string>")))
    verdict = F.coalesce(F.col("_td_best.action"), F.when(F.size(patterns) > 0, "block").otherwise("allow"))
    return joined.select(*keep, lower_ascii(F.regexp_extract("_td_url", _PARTS, 1)).alias("host"), F.regexp_extract("_td_url", _PARTS, 2).alias("path"), F.col("_td_best.name").alias("rule"), patterns.alias("patterns"), verdict.alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> str:
    return ", ".join(f"({len(r.name)}, '{r.name}', '{r.action}', '{r.host}', '{r.path}')" for r in HOST_RULES)


OP7_SQL = rf"""
WITH rules(size, name, action, rule_host, rule_path) AS (VALUES {_sql_rules()}),
parted AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS u,
         translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path
  FROM pages),
best AS (
  SELECT r, arg_max(name, size) AS rule, arg_max(action, size) AS action
  FROM parted JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN {" OR ".join(f"regexp_matches(u, '{p.regex}')" for p in PATTERN_RULES)} THEN 'block' ELSE 'allow' END) AS verdict
FROM parted LEFT JOIN best USING (r)
"""
