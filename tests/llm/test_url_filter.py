import random

import pytest

from optara.llm import url_filter
from optara.llm.queries import RULES


def brute(rules, host, path):
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            k = (h.count("."), len(p))
            if best is None or k > best[0]:
                best = (k, h + p, v)
    return best[1:] if best else None


def test_trie_matches_brute_force():
    rng = random.Random(2)
    hosts = ["org", "com", "a.org", "b.a.org", "ab.org", "org.", ".org", ""]
    paths = ["", "/", "/es", "/es/", "/es/1", "/e", "/en/1", "/en/12/x", "//", "/en//1"]
    for _ in range(200):
        rules = [(rng.choice(hosts[:5]), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(rng.randint(0, 6))]
        rules = list({(h, p): (h, p, v) for h, p, v in reversed(rules)}.values())
        trie = url_filter.Trie(rules)
        for h in hosts + ["x.b.a.org", "xorg"]:
            for p in paths:
                got = trie.match(h, p)
                assert (got[:2] if got else None) == brute(rules, h, p), (rules, h, p)


@pytest.mark.parametrize("limit", [64 << 20, 2000])
def test_awkward_urls(spark, limit):
    urls = ["HTTP://A.Example.ORG/es/x?q#f", "http://example.org/en/123", "https://x.com/fr/", "https://x.com", "ftp://x.com?/fr/", None, "no scheme", "", "http://É.org/ÀB", "a://b://c/d", "x.com://org/"]
    df = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)] + [(0, urls[0], "old", 1)], "page_id long, url string, verdict string, extra int")
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES, limit=limit).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1]["rule"] == "example.org/en/1" and got[2]["verdict"] == "allow" and got[3]["rule"] is None
    assert (got[4]["host"], got[4]["path"], got[4]["rule"]) == ("x.com", "", None)
    for i in (5, 6, 7):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == ("", "", None, "allow")
    assert got[8]["host"] == "É.org" and got[9]["host"] == "b:" and got[9]["path"] == "//c/d" and got[10]["rule"] == "org/"
    assert got[0]["extra"] == 1 and url_filter.judge(df, RULES, limit=limit).count() == len(urls) + 1
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_blocks_stay_below_limit():
    rules = [(f"h{i}.org", "/a/b", "block") for i in range(100)]
    cut = list(url_filter.blocks(rules, 10_000))
    assert [r for b, _ in cut for r in b] == rules and len(cut) > 5 and all(size <= 10_000 for _, size in cut)


def test_a_rule_beyond_the_bound_raises(spark):
    with pytest.raises(ValueError, match="exceed"):
        url_filter.judge(spark.createDataFrame([("http://a.org/",)], "url string"), [("a.org", "/" + "x" * 9_000_000, "block")])
