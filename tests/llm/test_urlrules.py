import re

import pytest

from tailweave.llm import urlrules
from tailweave.llm.urlrules import PATTERN_RULES, SITE_RULES, pattern_rule, site_rule

URLS = [
    "http://example.org/es/1", "https://A.EXAMPLE.org/en/17?x", "https://a.example.org/en/2#t", "http://example.org", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/#a", "http://com/de/",
    "http://xcom/de/", "http://spam-farm.example.net/en/", "http://my-spam-farm.net", "no scheme/fr/", "", None, "://", "a://b://c.com/fr/x", "http://x.com?/fr/", "HTTP://X.COM/FR/", "http://é.com/fr/", "http://casino.example.net/",
    "http://org/", "http://x.org\n/es/", "http://example.org/ES/", "http://u:p@example.org:80/es/", "http://xxx.example.net/a",
]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S) if "://" in (url or "") else None
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for host_, path_, verdict in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")):
        if (host == host_ or host.endswith("." + host_)) and path.startswith(path_) and (best is None or len(host_ + path_) > len(best[0])):
            best = (host_ + path_, verdict)
    other = any(re.search(r.pattern, host + path) for r in PATTERN_RULES)
    return host, path, best and best[0], best[1] if best else "block" if other else "allow"


def judged(spark, urls, rules):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = urlrules.judge_urls(df, rules).orderBy("page_id").collect()
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got]


def test_like_brute_force(spark, rng):
    hosts = ["example.org", "www.example.org", "a.com", "com", "spam-farm.example.com", "b.example.net", "link-farm.net", "org"]
    urls = URLS + [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/', '/fr/x', '/de/', '/free-download/', '/free-download'])}{rng.choice(['', '?a=/de/', '#/fr/'])}" for _ in range(200)]
    assert judged(spark, urls, SITE_RULES + PATTERN_RULES) == [brute(u) for u in urls]


def test_only_candidates_need_their_tokens_and_longest_wins(spark):
    rules = [site_rule("a.org", "/x/", "block"), site_rule("org", "/", "allow"), site_rule("b.a.org", "/x", "allow"), pattern_rule("numbers", r"/\d+-sale$", ("sale",))]
    got = judged(spark, ["http://b.a.org/x/1", "http://c.a.org/x/", "http://q.net/12-sale", "http://q.net/12-sales"], rules)
    assert [(g[2], g[3]) for g in got] == [("b.a.org/x", "allow"), ("a.org/x/", "block"), (None, "block"), (None, "allow")]


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlrules.judge_urls(empty, SITE_RULES).count() == 0
    assert judged(spark, ["http://x.org/"], []) == [("x.org", "/", None, "allow")]
    clash = spark.createDataFrame([("http://x.com/de/", 1, 2, 3)], "url string, host int, rule int, verdict int")
    assert urlrules.judge_urls(clash, SITE_RULES).first()["verdict"] == "block"
    with pytest.raises(ValueError):
        urlrules.judge_urls(empty, [urlrules.Rule("x", "block", ".*", ())])
    plan = urlrules.judge_urls(empty, SITE_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
