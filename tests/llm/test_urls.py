"""URL filters against rules read one by one, by trie and by join."""

from __future__ import annotations

import random

import pytest

from trackloom.llm import queries, url_filter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def brute(url, rules, otherwise="allow"):
    """Host, path, rule and verdict from every rule in turn."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for rule, verdict in rules:
        if rule is None or verdict not in ("allow", "block"):
            continue
        at = rule.find("/") if "/" in rule else len(rule)
        own, begun = "".join(c.lower() if "A" <= c <= "Z" else c for c in rule[:at]), rule[at:]
        if (own == "" or host == own or host.endswith("." + own)) and path.startswith(begun):
            rank = (len(own) + len(begun), len(own), verdict == "block")
            if best is None or rank > best[0]:
                best = rank, own + begun, verdict
    return (host, path, best[1], best[2]) if best else (host, path, None, otherwise)


def urls(draw, count):
    hosts = ["org", "example.org", "a.example.org", "b.com", "com", "EXAMPLE.ORG", "xexample.org", "", ".org", "a..org", "org.", "É.org:80", "u@b.com"]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12/3", "/en/2", "/fr/", "/fr", "//fr/", "/de/1?x=/es/", "/en/1#top", "?a=://b.org/", "#x", "/en\n/1"]
    rows = ["http://" + draw.choice(hosts) + draw.choice(paths) for _ in range(count)]
    return rows + [None, "", "no scheme", "://", "a://b://c.org/", "http://b.com/" + "de/" * 5000, "http://b.com/" + "fr" * 9000]


@pytest.mark.parametrize("most", [url_filter.TRIE_RULES, 0], ids=["trie", "join"])
@pytest.mark.parametrize("own", ["dealt", "many", "none"])
def test_verdicts_are_those_of_every_rule_in_turn(spark, own, most):
    draw = random.Random(7)
    rules = {"dealt": RULES, "none": [], "many": [*RULES, ("org/", "block"), ("", "allow"), ("/es", "block"), ("COM", "block"), (None, "allow"), ("b.com/en/", None),
             ("b.com/de/1", "allow"), ("a.example.org/e", "allow"), ("example.org/en/1", "allow"), ("b.org/x", "block"), ("org/xyzw/", "allow"), ("com//fr", "allow")]}[own]
    texts = urls(draw, 300)
    # columns that clash with the new ones, and rows that repeat
    rows = spark.createDataFrame([(k % 5, t, "kept") for k, t in enumerate(texts * 2)], "Rule long, url string, verdict string")
    out = url_filter.judged(rows, spark.createDataFrame(rules, "rule string, verdict string"), most=most)
    assert out.columns == ["Rule", "url", "verdict", "host", "path", "_rule", "_verdict"]
    found = sorted((tuple(r) for r in out.collect()), key=repr)
    assert found == sorted(((k % 5, t, "kept", *brute(t, rules)) for k, t in enumerate(texts * 2)), key=repr)


def test_no_rows(spark):
    none = spark.createDataFrame([], "url string")
    for most in (0, 10):
        assert url_filter.judged(none, spark.createDataFrame(RULES, "rule string, verdict string"), most=most).collect() == []


def test_registered_query(spark):
    rows = queries.op11_url_trie(spark, "/root/testdata/sf0.001")
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()}
    found = rows.collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(pages[r["page_id"]], RULES)
