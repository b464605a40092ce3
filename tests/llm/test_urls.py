"""URL rules: the trie and the join against a plain search of all rules."""

import random

from kinweave.llm import url_filter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block"), ("net", "block"), ("a.net/x/", "allow"), ("a.net/x/", "block"), ("a.net/x/y", "allow")]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for rule, verdict in RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (len(h), len(slash + p), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, rule, verdict)
    return (url, host, path, best[1] if best else None, best[2] if best else "allow")


URLS = [None, "", "no scheme", "http://", "http://ORG", "https://x.Example.org/es/1?q#f", "ftp://example.org/en/12", "http://example.org?x=/es/",
        "http://a.net/x/yz", "http://b.a.net/x/", "http://a.net", "http://com/de", "http://z.com/de/", "x://é.com/fr/à b", "http://a\nb.org/\n"]


def urls():
    draw = random.Random(5)
    out = list(URLS)
    for _ in range(300):
        host = ".".join(draw.choice(["a", "b", "example", "net", "org", "com"]) for _ in range(draw.randrange(1, 4)))
        out.append(f"http://{host}" + "".join(draw.choice(["/", "x", "y", "en", "1", "es", "de", "?"]) for _ in range(draw.randrange(6))))
    return out


def test_trie_and_join(spark, rows):
    df = spark.createDataFrame([(u, "old", 1) for u in urls()] + [(URLS[5], "old", 1)], "url string, verdict string, rule int")
    want = sorted([brute(u) for u in urls()] + [brute(URLS[5])], key=repr)
    cols = ("url", "host", "path", "rule", "verdict")
    assert rows(url_filter.judge_urls(df, RULES), *cols) == want
    assert rows(url_filter.judge_urls(df, RULES, trie_chars=10), *cols) == want
    table = spark.createDataFrame(RULES + [(None, "block")], "rule string, verdict string")
    assert rows(url_filter.judge_urls(df, table), *cols) == want


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([("http://a.org/",)], "url string")
    assert url_filter.judge_urls(df, [], default="block").head()["verdict"] == "block"
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0
