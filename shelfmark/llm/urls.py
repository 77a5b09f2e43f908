"""URL rules, found by their rarest token.

Site rules name a host and the beginning of a path and allow or block; of those that fit a
URL the longest wins. Pattern rules block URLs that no site rule decides, unless an
exception, a pattern after ``@@``, fits as well; in a pattern, ``||`` is the beginning of
a host or of one of its subdomains, ``^`` a separator or the end, and ``*`` anything.
``read_patterns`` reads them from files with a rule a line.

Each rule is indexed by one word that every URL it fits must have as a token: of its
words, the one that the fewest URLs of the table have. A URL's tokens fetch the rules to
try, and only those are checked, pattern rules by their longest literal part and then
their regular expressions. A rule whose words may all go on in a URL is indexed by the
rarest run of up to ``GRAM`` characters of its literal parts instead, and URLs give their
runs of that length as tokens too while there is such a rule. So no rule is tried on
every URL; one without any literal character is an error.

The index has a row for each rule, so it is broadcast only while Spark knows it to be
small. Different URLs are judged once, and rows get their URL's verdict by a join.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no
site rule and is allowed; of site rules of equal length the blocking one wins, then the
first by name; repeated rows have equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.shared import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SITES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Hosts and paths of advertisement, tracking and pages without an article.
PATTERNS = (
    "||ads-track.", "||ads.", "||adserver.", "||tracking.", "||doubleclick.", "/ads/",
    "/banner/", "/banners/", "/popup/", "/pixel.gif^", "/login^", "/signup^", "/checkout^",
    "/cart^", "^casino^", "^porn^", "^affid=", "/wp-admin/",
)
TOKEN = "[a-z0-9]+"
GRAM = 3
EXCEPT = "@@"
ASCII = str.maketrans(UPPER, LOWER)
RULES = (
    "rule string, host string, path string, action string, regex string, literal string,"
    " words array<string>"
)


def parts_of(pattern: str) -> list[str]:
    """A pattern's signs and the literal parts between them, in turn."""
    return re.split(r"(^\|\||\^|\*)", pattern)


def regex_of(pattern: str) -> str:
    """The regular expression of a pattern, for lower-cased URLs."""
    signs = {"||": r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", "^": r"([^a-z0-9_.%-]|$)", "*": ".*"}
    parts = parts_of(pattern)
    parts[1::2] = [signs[x] for x in parts[1::2]]
    parts[::2] = [re.sub(r"([][\\.+?(){}|$])", r"\\\1", x) for x in parts[::2]]
    return "".join(parts)


def literals_of(pattern: str) -> list[str]:
    return [x for x in parts_of(pattern)[::2] if x]


def words_of(pattern: str) -> list[str]:
    """Tokens that each URL of a pattern has: runs of letters and digits with sure ends."""
    sure = []
    for found in re.finditer(TOKEN, pattern):
        before, after = pattern[: found.start()], pattern[found.end() :]
        if before and after and before[-1] != "*" and after[0] != "*":
            sure.append(found.group())
    return sure


def grams_of(rule: str, literals: Iterable[str]) -> list[str]:
    """Runs of characters that each URL of a rule has, as tokens: ``=`` and the run."""
    longest = max((len(x) for x in literals), default=0)
    size = min(GRAM, longest)
    if not size:
        raise ValueError(f"the rule {rule!r} has no literal character")
    return sorted({"=" + x[i : i + size] for x in literals for i in range(len(x) - size + 1)})


def site_row(host: str, path: str, action: str) -> tuple:
    low = path.translate(ASCII)
    words = re.findall(TOKEN, host)
    # the last token of a path may go on in the URL
    words += re.findall(f"(?<=/){TOKEN}(?=/)", low)
    rule = f"{host}{path}"
    return rule, host, path, action, None, None, words or grams_of(rule, (host, low))


def pattern_row(rule: str) -> tuple:
    action = "allow" if rule.startswith(EXCEPT) else "block"
    pattern = rule.removeprefix(EXCEPT).translate(ASCII)
    literals = literals_of(pattern)
    words = words_of(pattern) or grams_of(rule, literals)
    return rule, None, None, action, regex_of(pattern), max(literals, key=len), words


def rule_rows(sites: Iterable[tuple], patterns: Iterable[str]) -> list[tuple]:
    """Rows of ``RULES``."""
    return [site_row(*x) for x in sites] + [pattern_row(x) for x in patterns]


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Pattern rules of text files, one a line, as rows of ``RULES``, each once.

    Empty lines and those after ``!`` say nothing; spaces around a rule do not count.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("rule")).distinct()

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RULES.split(",")]
        for part in parts:
            yield pd.DataFrame([pattern_row(x) for x in part["rule"]], columns=names)

    return lines.filter("rule != '' and not startswith(rule, '!')").mapInPandas(rows, RULES)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1)


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the rarest of their words as ``token``."""
    words = rules.select("rule", F.explode("words").alias("token"))
    wanted = words.select("token").distinct()
    many = (
        urls.select(F.explode(F.array_distinct("tokens")).alias("token"))
        .join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    )
    rarest = (
        words.join(many, "token", "left").groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("n"), "token")).alias("low"))
    )
    return rules.join(rarest, "rule").select(
        "rule", "host", "path", "action", "regex", "literal", F.col("low.token").alias("token")
    )


def tokens_of(low: Column, sizes: Iterable[int]) -> Column:
    """A lower-cased URL's words, and its runs of characters of these sizes."""

    def runs(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - (size - 1))
        found = F.transform(starts, lambda i: F.concat(F.lit("="), low.substr(i, F.lit(size))))
        return F.when(F.length(low) >= size, found).otherwise(F.array().cast("array<string>"))

    words = F.regexp_extract_all(low, F.lit(TOKEN), 0)
    return F.array_distinct(F.concat(words, *map(runs, sizes)))


def candidates(urls: DataFrame, index: DataFrame) -> DataFrame:
    """The rules to try on each URL: those whose token it has."""
    narrow = ("url", "low", "url_host", "url_path")
    return urls.select(*narrow, F.explode("tokens").alias("token")).join(index, "token")


def distinct_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Different URLs of ``pages`` with what ``rules`` ask of them."""
    # between one and GRAM rows
    sizes = rules.select(F.explode("words").alias("w")).filter("startswith(w, '=')")
    sizes = sorted(r.n - 1 for r in sizes.select(F.length("w").alias("n")).distinct().collect())
    lowered = F.translate("url", UPPER, LOWER)
    known = pages.filter("url is not null").select("url").distinct()
    return known.withColumn("low", lowered).select(
        "url", "low", host_of(F.col("url")).alias("url_host"),
        path_of(F.col("url")).alias("url_path"), tokens_of(F.col("low"), sizes).alias("tokens"),
    )


def judge(
    pages: DataFrame, sites=SITES, patterns=PATTERNS, more: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url).

    ``more``: further pattern rules, as ``read_patterns`` gives them.
    """
    rules = pages.sparkSession.createDataFrame(rule_rows(sites, patterns), RULES)
    if more is not None:
        rules = settle(rules.unionByName(more).dropDuplicates(["rule", "action", "regex"]), "rules")
    urls = settle(distinct_urls(pages, rules), "urls")
    tried = candidates(urls, settle(index_rules(urls, rules), "url_rules"))
    fits_site = F.expr(
        "regex is null and (url_host = host or endswith(url_host, concat('.', host)))"
        " and startswith(url_path, path)"
    )
    fits = F.when(F.col("regex").isNull(), fits_site).otherwise(
        F.when(F.expr("contains(low, literal)"), F.expr("rlike(low, regex)")).otherwise(False)
    )
    found = tried.filter(fits).groupBy("url").agg(
        F.min(F.expr(
            "if(regex is null, struct(-length(rule) as l, if(action = 'block', 0, 1) as a, rule), null)"
        )).alias("site"),
        F.max(F.expr("regex is not null and action = 'block'")).alias("blocked"),
        F.max(F.expr("regex is not null and action = 'allow'")).alias("excepted"),
    )
    found = found.select(
        F.col("url").alias("known"), F.col("site.rule").alias("rule"),
        F.expr("case when site is not null then if(site.a = 0, 'block', 'allow')"
               " when blocked and not excepted then 'block' else 'allow' end").alias("verdict"),
    )
    return pages.select("page_id", "url").join(found, F.col("url") == F.col("known"), "left").select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


def oracle(sites=SITES, patterns=PATTERNS) -> str:
    """The same verdicts as DuckDB SQL."""
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in sites)
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"

    def any_of(action: str) -> str:
        quoted = [r[4].replace("'", "''") for r in map(pattern_row, patterns) if r[3] == action]
        return " OR ".join(f"regexp_matches({low}, '{x}')" for x in quoted) or "false"

    return f"""
WITH site(h, p, a) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS n, page_id, url,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (SELECT n, arg_min(h || p, (-length(h || p), CASE a WHEN 'block' THEN 0 ELSE 1 END, h || p)) AS rule,
  arg_min(a, (-length(h || p), CASE a WHEN 'block' THEN 0 ELSE 1 END, h || p)) AS verdict
  FROM u JOIN site ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN ({any_of("block")}) AND NOT ({any_of("allow")}) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (n)"""
