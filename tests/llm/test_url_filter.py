import random
from collections import Counter

import pytest

from transitlake.llm import url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def judged(url, rules):
    host, path = parts(url)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


URLS = [
    None, "", "no scheme.org/", "://", "http://", "http://org", "http://org/", "http://ORG/", "http://a.org/x", "http://example.org/es/1", "http://example.org/es", "http://b.example.org/en/12?q=://x", "http://xexample.org/en/1",
    "http://example.org?x=/en/1", "http://example.org/en/1#f", "https://fr.com/fr/de/", "https://m.COM/fr/a", "https://com/de/x", "http://a.com/FR/x", "http://ex.org/a\nb", "http://é.org/en/1", "http://example.org//en/1", "http://example.org/" + "a/" * 3000,
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_rules(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", -1)
        monkeypatch.setattr(url_filter, "_small", lambda compiled: False)
    pages = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[6], "x", "y"), (3, URLS[6], "x", "y"), (None, URLS[8], "x", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, token string, regex string")
    got = Counter(map(tuple, url_filter.url_filter(df, url_filter.rules_table(spark)).collect()))
    assert got == Counter((i, *judged(u, url_filter.RULES)) for i, u, _, _ in pages)


def test_random_rules(spark):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "c+", "d.e", "x(y"])
    rules = list({f"{label()}{'.org' if rng.random() < 0.5 else ''}/" + "/".join(label() for _ in range(rng.randrange(3))): (rng.choice(["allow", "block"])) for _ in range(60)}.items())
    urls = [f"http://{'.'.join(label() for _ in range(rng.randint(1, 2)))}{rng.choice(['', '.org'])}/" + "/".join(label() for _ in range(rng.randrange(4))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(df, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert got == {i: judged(u, [(v, r) for r, v in rules])[2:] for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.url_filter(pages, none).collect()] == [(1, "a.org", "/", None, "allow")]
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_a_rule_is_filed_under_its_rarest_token(spark):
    rules = url_filter.compile_rules(spark.createDataFrame([("b.org/x/y/z", "block"), ("org/", "allow")], "rule string, verdict string"))
    tokens = spark.createDataFrame([(t,) for t in ["h:org"] * 5 + ["h:b"] * 3 + ["p:x"] * 2 + ["p:y"] * 4 + ["p:"] * 9], "token string")
    got = {r.rule: r.token for r in url_filter.rarest_index(rules, tokens).collect()}
    assert got["b.org/x/y/z"] == "p:x"
    assert got["org/"] in ("h:org", "p:")


def test_hosts_may_hold_blanks(spark):
    urls = ["http://a b.example.org/es/x", "http://a b.com/de/", "http://a bexample.org/es/x", "http://example.org /es/x", "http://x\ty.com/de/1", "http://a.b /c.example.org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, url_filter.rules_table(spark)).collect()}
    assert got == {i: judged(u, url_filter.RULES) for i, u in enumerate(urls)}
    assert got[0][2:] == ("example.org/es/", "block")
