"""Lists of pattern rules: exceptions, rules without a sure word, ten thousand rules."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import urls

SCHEMA = "page_id long, url string"


def verdicts(spark, given, **rules):
    pages = spark.createDataFrame(list(enumerate(given)), SCHEMA)
    found = {r.page_id: r.verdict for r in urls.judge(pages, **rules).collect()}
    return [found[i] for i in range(len(given))]


@pytest.mark.parametrize("pattern, url, fits", [
    ("casino", "http://a.org/xcasinox", True), ("casino", "http://b.org/", False),
    ("||ads", "http://x.adserver.com/", True), ("||ads", "http://x.com/ads", False),
    ("*&x", "http://a.org/?b&x=1", True), ("*.z", "http://a.org/q.Z", True), ("?", "http://a.org/?", True),
    ("a||b", "http://c.org/a||b", True), ("a||b", "http://c.org/ab", False),
    ("/p[1]/", "http://c.org/p[1]/", True), ("/p[1]/", "http://c.org/p1/", False),
    ("(x+y)$", "http://c.org/(x+y)$", True), ("(x+y)$", "http://c.org/xxy", False),
    ("\\d", "http://c.org/\\d", True), ("\\d", "http://c.org/7", False),
    ("ü^", "http://c.org/ü/", True), ("/ADS/", "http://c.org/ads/", True),
    ("/a.b/", "http://c.org/axb/", False), ("^zz*yy^", "http://zz.org/1/yy", True),
])
def test_patterns(spark, pattern, url, fits):
    assert bool(re.search(urls.regex_of(pattern.translate(urls.ASCII)), url.lower())) == fits
    want = ["block" if fits else "allow", "allow", "allow"]
    assert verdicts(spark, [url, None, ""], sites=(), patterns=(pattern,)) == want


@pytest.mark.parametrize("pattern", ["", "*", "||^", "^*^", "@@*"])
def test_a_pattern_without_a_literal_is_an_error(pattern):
    with pytest.raises(ValueError, match="literal"):
        urls.pattern_row(pattern)


def test_exceptions_and_sites_go_before_patterns(spark):
    rules = {"sites": (("shop.org", "/en/", "block"),), "patterns": ("/ads/", "@@||news.org^", "@@promo")}
    given = ["http://a.org/ads/1", "http://news.org/ads/1", "http://a.org/ads/xpromox", "http://shop.org/en/promo",
             "http://a.org/promo"]
    assert verdicts(spark, given, **rules) == ["block", "allow", "allow", "block", "allow"]


def test_sites_without_a_host_or_word(spark):
    rules = {"sites": (("", "/é/", "block"), ("ü", "/", "block")), "patterns": ()}
    given = ["x:///é/x", "http://b.ü/", "http://a.org/é/"]
    assert verdicts(spark, given, **rules) == ["block", "block", "allow"]


def rule_list(rng: random.Random, count: int) -> list[str]:
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(3000)]
    shapes = ("||{0}.", "/{0}/", "^{0}={1}", "||{0}.{1}^", "/{0}/*/{1}/", "{0}-{1}", "/{0}", "*{0}*{1}",
              "@@/{0}/{1}", "@@||{0}.com^")
    return sorted({rng.choice(shapes).format(*rng.sample(words, 2)) for _ in range(count)})


def test_ten_thousand_rules_of_a_file(spark, tmp_path):
    rng = random.Random(3)
    rules = rule_list(rng, 10_000)
    with open(tmp_path / "rules.txt", "w") as file:
        file.write("! a comment\n\n" + "\n".join([*rules, "  " + rules[0], rules[1]]) + "\n")
    words = [w for r in rules for w in re.findall("[a-z]+", r)]
    given = []
    for _ in range(400):
        a, b, c, d, e = rng.choices(words, k=5)
        given.append(f"http://{a}.{b}.com/{c}/{d}/?{e}=1" if rng.random() < 0.8 else f"http://{a}.org/")
    compiled = [(r.startswith("@@"), re.compile(urls.regex_of(r.removeprefix("@@")))) for r in rules]
    want, matches = [], 0
    for url in given:
        found = {allow for allow, x in compiled if x.search(url)}
        matches += sum(1 for _, x in compiled if x.search(url))
        want.append("block" if found == {False} else "allow")
    assert 50 < Counter(want)["block"] < 350 and matches > 400
    more = urls.read_patterns(spark, str(tmp_path / "rules.txt"))
    assert more.count() == len(rules)
    assert verdicts(spark, given, sites=(), patterns=(), more=more) == want
    # the index leaves few rules to try, and each that fits is among them
    pages = spark.createDataFrame(list(enumerate(given)), SCHEMA)
    asked = urls.distinct_urls(pages, more)
    tried = urls.candidates(asked, urls.index_rules(asked, more))
    assert tried.groupBy("url", "rule").count().filter("count > 1").isEmpty()
    per_url = tried.count() / asked.count()
    assert per_url < len(rules) / 50
    fitting = tried.filter(F.expr("rlike(low, regex)")).count()
    assert fitting == sum(1 for url in set(given) for _, x in compiled if x.search(url))
