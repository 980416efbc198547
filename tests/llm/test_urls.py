import random

import pytest
from pyspark.sql import functions as F

from careloom.llm import urls

RULES = [urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("example.org/en/1", "block"), urls.Rule("com/fr/", "allow"), urls.Rule("com/de/", "block")]


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("http://A.Example.ORG/es/1?q=/x", "a.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1"),
    ("http://x.org", "x.org", "", None), ("http://x.org/", "x.org", "/", "org/"), ("http://badexample.org/es/", "badexample.org", "/es/", "org/"),
    ("http://s.com/fr/", "s.com", "/fr/", "com/fr/"), ("ftp://s.com/FR/", "s.com", "/FR/", None), ("http://h?x=http://org/", "h", "", None),
    ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("x://É.com/de/\n1", "É.com", "/de/\n1", "com/de/"),
])
def test_parts_and_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    r = urls.judge_urls(df, RULES).first()
    assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
    wanted = {"org/": "allow", "com/fr/": "allow", None: None}.get(rule, "block")
    assert r["verdict"] == wanted if wanted else r["verdict"] in ("allow", "block")


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    good = [f"http://{word()}.example/{rng.choice(['news', 'science', 'library'])}/{word()}" for _ in range(300)]
    bad = [f"http://{rng.choice(['casino', 'slots', 'poker'])}{word()}.example/{word()}" for _ in range(300)]
    data = [(u, "allow") for u in good] + [(u, "block") for u in bad]
    rng.shuffle(data)
    train = spark.createDataFrame(data[:400], "url string, verdict string")
    test = spark.createDataFrame(data[400:], "url string, wanted string")
    judged = urls.judge_urls(test, [], labelled=train)
    assert judged.filter("verdict = wanted").count() >= 0.95 * 200


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([("http://q.net/",), (None,)], "url string")
    assert {r["verdict"] for r in urls.judge_urls(df, RULES).collect()} == {"allow"}
    assert urls.judge_urls(df.filter(F.lit(False)), RULES).count() == 0


def test_repeated_rows_are_judged_alike(spark):
    data = [(i % 5, u) for i, u in enumerate(["http://s.com/de/1", "http://s.com/fr/1", "http://q.net/x", None, ""] * 40)]
    data += [(None, "http://q.net/x")] * 3
    got = urls.judge_urls(spark.createDataFrame(data, "page_id long, url string").repartition(4), RULES).collect()
    assert len(got) == len(data) and len({(r["page_id"], r["url"], r["rule"], r["score"], r["verdict"]) for r in got}) == 6
