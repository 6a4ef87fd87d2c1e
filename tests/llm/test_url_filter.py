import random
import re

import duckdb
from comparing import compare
from corpuscope.llm import url_filter as operator
from corpuscope.llm.registered import LLM_ORACLES

URLS = [
    None, "", "no scheme", "https://", "HTTP://WWW.Example.NET/en/1?x#y", "https://example.net/en", "https://a.example.com/de/77",
    "https://a.example.com/de", "https://b.org/fr/", "https://org/fr/x", "https://corg/fr/x", "https://x.net", "https://x.net/",
    "https://x.net?q=://y/z", "ftp://É.ORG#f", "a://b://c.net/d", "https://h.example.com/es/1\n2", "//x.net/a", "https://u:p@x.net:80/é/日?",
]


def brute(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda m: m[0].lower(), match[1]), match[2]) if match else ("", "")
    fitting = [
        (rule, verdict) for rule, verdict in operator.RULES
        if (host == rule.split("/", 1)[0] or host.endswith("." + rule.split("/", 1)[0])) and path.startswith("/" + rule.split("/", 1)[1])
    ]
    return host, path, max(fitting, key=lambda r: len(r[0]), default=(None, None))


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS)], "page_id long, url string, host int, first string")
    found = {r.page_id: r for r in operator.filter_urls(pages).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, (rule, verdict) = brute(url)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == verdict or rule is None and found[i].verdict in ("allow", "block")


def test_learns_templates_from_labels(spark):
    """One host's /buy branch is labelled bad, /read good; others of the shape follow, other branches do not."""
    pages = [(i, f"https://shop.com/{'buy' if i % 2 else 'read'}/{i}") for i in range(60)]
    pages += [(100 + i, f"https://new.com/{s}/{i}") for i, s in enumerate(("buy", "buy", "buy", "read", "read", "read"))]
    labels = spark.createDataFrame(
        [("shop.com", f"/{'buy' if i % 2 else 'read'}/{i}", bool(i % 2)) for i in range(40)], "host string, path string, blocked boolean"
    )
    found = operator.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules=(), labels=labels)
    assert all((r.verdict == "block") == ("/buy/" in r.path) for r in found.collect())


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert operator.filter_urls(empty).count() == 0
    pages = spark.createDataFrame([(None, "https://a.b/c"), (1, "https://a.b/c"), (1, "https://a.b/c")], "page_id long, url string")
    assert [r.verdict for r in operator.filter_urls(pages, rules=()).collect()] == ["allow"] * 3


def twin_differs(spark, urls):
    """Compares with the SQL twin on a table of these urls."""
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    found = operator.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    return compare(found, con, LLM_ORACLES["op7_url_filter"])


def test_splits_below_the_second_segment(spark):
    """Two topics, three and four segments down, that share all segments above; unlabelled pages of each follow."""
    for above in ("en/forum", "en/forum/all"):
        pages = [f"/{above}/{t}/{i}" for t, n in (("spam", 100), ("help", 90)) for i in range(n)]
        labels = [("h.com", p, "spam" in p) for p in pages if int(p.rsplit("/", 1)[1]) < 50]
        found = operator.filter_urls(
            spark.createDataFrame([(i, "http://h.com" + p) for i, p in enumerate(pages)], "page_id long, url string"),
            rules=(), labels=spark.createDataFrame(labels, "host string, path string, blocked boolean")).collect()
        assert len(found) == 190 and all((r.verdict == "block") == ("spam" in r.path) for r in found)


def test_varying_segments_are_one_branch_at_any_size(spark):
    """Names on three pages each are a wildcard, so that the topic below them is judged over all names."""
    names = [f"user{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    pages = [f"/u/{n}/{t}/{i}" for n in names for t, i in (("spam", 1), ("spam", 2), ("help", 1), ("help", 2))]
    labels = [("h.com", p, "spam" in p) for k, p in enumerate(pages) if k % 5 < 2]
    found = operator.filter_urls(
        spark.createDataFrame([(i, "http://h.com" + p) for i, p in enumerate(pages)], "page_id long, url string"),
        rules=(), labels=spark.createDataFrame(labels, "host string, path string, blocked boolean")).collect()
    assert all((r.verdict == "block") == ("spam" in r.path) for r in found)


def test_equals_twin_on_deep_trees_and_edges(spark):
    """Labels by the rules; hosts of several tops share first segments, paths of up to six segments."""
    rng = random.Random(7)
    words = ["de", "en", "fr", "shop", "news", "a1", "b2x", "", "é", "*"]
    urls = list(URLS)
    for _ in range(3000):
        host = rng.choice(["a.example.com", "b.example.com", "c.example.net", "d.org", "e.org", "x.net"])
        urls.append(f"https://{host}/" + "/".join(rng.choice(words[:rng.randint(1, 10)]) for _ in range(rng.randint(0, 6))))
    assert twin_differs(spark, urls) is None
