"""URL filter: pattern rules indexed by their rarest literal token.

All work is DataFrame expressions on the url column. The literal tokens that every
url matching a pattern must hold are read off the pattern (an alternation gives a
token for each way through it), and the rule is filed under the one that the urls
use least. A url's tokens fetch the rules filed under them, and only these run their
regular expression. Rules without such a token can't be filed; they are tried on
every url, so none is lost. Host rules are fetched by the url's host and its parent
domains in the same way.

Up to INLINE rules the index is part of the plan, and nothing is shuffled but a
count of the rules' own tokens. Longer lists are tables that are joined by token and
by host.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants, _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.graph import spread_join
from geoloom.storage import job, materialize, result

#: Rules that go into the plan as literals; longer lists are joined.
INLINE = 2_000
#: Ways through a pattern's alternations that are followed; a pattern with more is tried on every url.
WAYS = 64
#: Urls of one token or domain that a task of the join meets.
AT_ONCE = 100_000


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains for paths that start with ``path``; longest wins."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """A regular expression, in the part of the language that Java and RE2 share, that is searched in host + path."""

    verdict: str
    pattern: str


BASE_RULES = [
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
]

PATTERN_RULES = [
    *(PatternRule("block", rf"^[^/]*\b{word}[.-]") for word in ("casino", "poker", "bingo", "roulette", "jackpot", "sportsbook", "viagra", "cialis", "xxx", "porn", "escorts", "payday", "replica", "torrents", "warez")),
    *(PatternRule("block", rf"^(?:[^/]*\.)?{name}\.") for name in ("doubleclick", "ads-track", "adserver", "adnxs", "taboola", "outbrain", "popads", "clickbank", "spam-farm")),
    PatternRule("block", r"^[^/]*\b(?:cheap-pills|free-bets|free-coins|quick-loans)\."),
    PatternRule("block", r"/(?:adserver|banner-ads|sponsored|affiliate-link)/"),
    PatternRule("block", r"/(?:wp-login|wp-admin|xmlrpc)(?:\.php|/|$)"),
    PatternRule("block", r"/(?:cart|checkout|basket)/(?:add|remove)\b"),
    PatternRule("block", r"/(?:login|signin|signup|register|logout)(?:\.html|\.php|\.aspx|/)?$"),
    PatternRule("block", r"/tags?/[^/]*/page/[0-9]+"),
    PatternRule("block", r"/calendar/[0-9]{4}/[0-9]{2}"),
    PatternRule("block", r"\.(?:exe|apk|dmg|iso|torrent)$"),
]


# What a pattern demands, element by element: a character of a token, a place where a token ends, or anything.
_EDGE, _ANY = "edge", "any"


def _ends_tokens(members: list) -> bool:
    """Whether a class of characters holds nothing that may be part of a token."""
    edge = lambda c: c < 128 and not chr(c).isalnum()
    for op, arg in members:
        if op == _constants.LITERAL and edge(arg) or op == _constants.CATEGORY and arg == _constants.CATEGORY_SPACE:
            continue
        if op == _constants.RANGE and all(edge(c) for c in range(arg[0], min(arg[1], 128) + 1)):
            continue
        return False
    return True


def _ways(parsed: list) -> list[list[str]]:
    """The ways through a parsed pattern as lists of elements; an empty list if there are too many."""
    ways: list[list[str]] = [[]]
    for op, arg in parsed:
        if op == _constants.LITERAL:
            c = chr(arg)
            tails = [[c.lower() if c.isascii() and c.isalnum() else _EDGE if c.isascii() else _ANY]]
        elif op == _constants.AT and arg != _constants.AT_NON_BOUNDARY:
            tails = [[_EDGE]]
        elif op == _constants.IN:
            tails = [[_EDGE if _ends_tokens(arg) else _ANY]]
        elif op == _constants.SUBPATTERN:
            tails = _ways(arg[-1])
        elif op == _constants.BRANCH:
            parts = [_ways(x) for x in arg[1]]
            tails = [y for x in parts for y in x] if all(parts) else []
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and arg[1] == 1:
            inner = _ways(arg[2])
            tails = inner and ([[]] if arg[0] == 0 else []) + inner
        else:
            tails = [[_ANY]]
        ways = [x + y for x in ways for y in tails]
        if not ways or len(ways) > WAYS:
            return []
    return ways


def required_tokens(pattern: str) -> list[list[str]]:
    """For each way through the pattern the whole tokens that a match holds; empty if some way demands none."""
    out = []
    for way in _ways(list(_parser.parse(pattern))) or [[]]:
        # a match may begin and end inside a token
        found = re.findall(r"(?<=\|)[a-z0-9]+(?=\|)", "".join({_EDGE: "|", _ANY: "?"}.get(x, x) for x in way))
        if not found:
            return []
        out.append(sorted(set(found)))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty for null or no ``://``."""
    rest = F.when(url.contains("://"), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != ""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many urls hold each of the tokens. Only those are counted, so the answer is as long as the rule list."""
    if not tokens:
        return {}
    if len(tokens) <= INLINE:
        held = urls.select(F.explode(F.array_intersect(tokens_of(F.col("target")), F.array(*map(F.lit, tokens)))).alias("token"))
    else:
        held = urls.select(F.explode(tokens_of(F.col("target"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
        return dict.fromkeys(tokens, 0) | {r["token"]: r["n"] for r in held.join(wanted, "token").collect()}
    return dict.fromkeys(tokens, 0) | {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


HOST_FIELDS, PATTERN_FIELDS = "key string, path string, length int, rule string, verdict string", "key string, k int, pattern string, verdict string"


def host_rows(rules: list[HostRule]) -> list[tuple]:
    return [(r.host, r.path, len(r.host + r.path), r.host + r.path, r.verdict) for r in rules]


def pattern_rows(rules: list[PatternRule], count: Callable[[list[str]], dict[str, int]]) -> list[tuple]:
    """Each rule under its rarest token of each way; under an empty key those without."""
    demands = [required_tokens(r.pattern) for r in rules]
    seen = count(sorted({t for ways in demands for way in ways for t in way}))
    keys = [sorted({min(way, key=lambda t: (seen[t], t)) for way in ways}) or [""] for ways in demands]
    return [(key, k, r.pattern, r.verdict) for k, r in enumerate(rules) for key in keys[k]]


def index(rows: list[tuple], fields: str) -> Callable[[Column], Column]:
    """A lookup from a key to the rows under it, as a literal of cells by the key's checksum."""
    names = [f.split()[0] for f in fields.split(", ")]
    kind = "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">>"
    cells: list[list[Column]] = [[] for _ in range(2 ** max(3, (2 * len(rows)).bit_length()))]
    for row in rows:
        cells[zlib.crc32(row[0].encode()) % len(cells)].append(F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]))
    table = F.array(*[F.array(*cell) if cell else F.expr(f"cast(array() as {kind})") for cell in cells])
    return lambda key: F.filter(F.element_at(table, (F.crc32(key.cast("binary")) % len(cells)).cast("int") + 1), lambda r: r["key"] == key)


def longest_fit(rules: Column) -> Column:
    fits = F.filter(rules, lambda r: F.col("path").startswith(r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["length"], r["rule"], r["verdict"])))


def first_match(rules: Column) -> Column:
    hits = F.filter(rules, lambda r: F.regexp(F.col("target"), r["pattern"]))
    return F.array_min(F.transform(hits, lambda r: F.struct(r["k"], r["pattern"], r["verdict"])))


def joined(judged: DataFrame, keys: Column, rows: list[tuple], fields: str, choose: Callable[[Column], Column], best: Callable[[str], Column], name: str) -> DataFrame:
    """``judged`` with the best rule by ``name``, the rules being a table joined by key."""
    rules = judged.sparkSession.createDataFrame(rows, fields)
    rules = materialize(rules.groupBy("key").agg(F.collect_list(F.struct("*")).alias("rules")), "rules")
    asked = judged.select("row", "path", "target", F.explode(keys).alias("key"))
    asked = asked.join(F.broadcast(rules.select("key")), "key", "left_semi") if len(rows) <= 1_000_000 else asked
    met = spread_join(materialize(asked, "asked"), rules, ["key"], "row", AT_ONCE)
    found = met.select("row", choose(F.col("rules")).alias(name)).groupBy("row").agg(best(name).alias(name))
    return judged.join(found, "row", "left")


def filter_urls(pages: DataFrame, host_rules: list[HostRule] = BASE_RULES, pattern_rules: list[PatternRule] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern.

    ``rule`` is the longest host rule that fits, else null; its verdict stands (of
    equally long ones the last by name, of equal ones the last verdict by name).
    Else the first pattern rule (list order) that matches ``host + path`` decides,
    else ``default``. Null or malformed urls have empty host and path, no rule and
    the default verdict unless a pattern matches the empty text. Urls of any length
    are judged whole; repeated rows are judged alike, one result each; an empty table
    gives an empty result; further columns are ignored.
    """
    for r in pattern_rules:
        re.compile(r.pattern)
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    judged = base.select("page_id", host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    hosts = host_rows(host_rules)
    patterns = pattern_rows(pattern_rules, lambda tokens: token_counts(judged, tokens))
    loose = [r for r in patterns if not r[0]]
    every = first_match(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("pattern"), F.lit(v).alias("verdict")) for _, k, p, v in loose])) if loose else F.lit(None).cast("struct<k:int,pattern:string,verdict:string>")
    if len(hosts) + len(patterns) <= INLINE:
        by_host, by_token = index(hosts, HOST_FIELDS), index([r for r in patterns if r[0]], PATTERN_FIELDS)
        judged = judged.withColumn("fit", longest_fit(F.flatten(F.transform(domains_of(F.col("host")), by_host))))
        judged = judged.withColumn("filed", first_match(F.flatten(F.transform(tokens_of(F.col("target")), by_token))))
        return verdicts(judged, every, default)
    with job(pages.sparkSession):
        judged = materialize(judged.withColumn("row", F.monotonically_increasing_id()), "urls")
        judged = joined(judged, domains_of(F.col("host")), hosts, HOST_FIELDS, longest_fit, F.max, "fit")
        judged = joined(judged, tokens_of(F.col("target")), [r for r in patterns if r[0]], PATTERN_FIELDS, first_match, F.min, "filed")
        return result(verdicts(judged, every, default), "verdicts")


def verdicts(judged: DataFrame, every: Column, default: str) -> DataFrame:
    judged = judged.withColumn("every", every).withColumn("hit", F.least("filed", "every"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "hit.verdict", F.lit(default)).alias("verdict"), F.col("hit.pattern").alias("pattern"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sql_of_rules(host_rules: list[HostRule] = BASE_RULES, pattern_rules: list[PatternRule] = PATTERN_RULES, default: str = "allow") -> str:
    """The same judgement in DuckDB SQL, every rule tried on every url."""
    ordered = sorted(host_rules, key=lambda r: -len(r.host + r.path))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN " for r in ordered]
    hits = [f"WHEN regexp_matches(host || path, '{r.pattern}') THEN " for r in pattern_rules]
    case = lambda whens, thens: "CASE " + " ".join(w + f"'{t}'" for w, t in zip(whens, thens)) + " END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {case(fits, [r.host + r.path for r in ordered])} AS rule,
       coalesce({case(fits, [r.verdict for r in ordered])}, {case(hits, [r.verdict for r in pattern_rules])}, '{default}') AS verdict,
       {case(hits, [r.pattern for r in pattern_rules])} AS pattern
FROM p
"""


OP7_SQL = sql_of_rules()
