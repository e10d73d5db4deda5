"""Verdicts against a loop over the rules; the filter alone against its list."""

from annalist.llm import urlfilter
from annalist.llm.urlfilter import LOWER, UPPER

URLS = [
    None, "", "example.net/en/", "http://example.net", "http://EXAMPLE.net/", "https://a.example.net/en/x?y#z", "http://xexample.net/en/", "http://x.org/fr/", "http://x.org/fr",
    "http://a//b://c.net/", "://net/", "x://net?q/", "http://net#/", "http://.net/", "http://u@a.com:80/de/", "http://example.com/de/a/b", "http://M.Example.Com/de/", "http://m.example.com/DE/",
    "http://a.b.c.d.e.net//x", "http://\u00c4.net/\n?", "http://net/" + "x" * 5000,
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("NET", "allow"), ("d.e.net//", "block"), ("/x", "block"), (None, "block"), ("net/", "allow")]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].translate(str.maketrans(UPPER, LOWER)), rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for (rule_host, rule_path), verdict in rules.items():
        if host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = min(best or (1, "", ""), (-len(rule_host + rule_path), rule_host + rule_path, verdict))
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_against_the_rules_one_by_one(spark):
    listed = {}
    for rule, verdict in RULES:
        if rule and not rule.startswith("/"):
            host, slash, path = rule.partition("/")
            key = (host.translate(str.maketrans(UPPER, LOWER)), slash + path)
            listed[key] = max(verdict, listed.get(key, ""))
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(4, URLS[4], "again"), (None, URLS[5], "")], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    want = sorted(((i, *plain(u, listed)) for i, u in [*enumerate(URLS), (4, URLS[4]), (None, URLS[5])]), key=repr)
    for blocks in (1, 64):  # one block: nearly every key is a possible hit
        got = sorted((tuple(r) for r in urlfilter.judge_urls(pages, rules, blocks=blocks).collect()), key=repr)
        assert got == want
    nothing = urlfilter.judge_urls(pages, rules.where("false")).collect()
    assert {r.verdict for r in nothing} == {"allow"} and {r.rule for r in nothing} == {None}
    assert urlfilter.judge_urls(pages.where("false"), rules).collect() == []


def test_no_listed_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) AS key")
    blocks = [int(x) for x in urlfilter.bloom_blocks(keys, 1024, 4).split(",")]
    passes = lambda df: df.select((urlfilter._bits(df.key, 4)).alias("b"), urlfilter._block(df.key, 1024).alias("k")).collect()
    assert all(blocks[r.k] & r.b == r.b for r in passes(keys))
    others = passes(spark.range(5000, 9000).selectExpr("xxhash64(id) AS key"))
    assert sum(blocks[r.k] & r.b == r.b for r in others) < 200
