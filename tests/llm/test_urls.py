"""URL parsing, rules and learned templates."""

import re

import pytest

from pactscope.llm import urls


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.B.net/x?y", "a.b.net", "/x", "net/", "block"),
    ("http://example.NET/en/5#t", "example.net", "/en/5", "example.net/en/", "allow"),
    ("https://m.example.net/en/", "m.example.net", "/en/", "example.net/en/", "allow"),
    ("https://m.example.net/en", "m.example.net", "/en", "net/", "block"),
    ("https://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
    ("https://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
    ("https://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("https://x.net", "x.net", "", None, "allow"),
    ("https://x.net?a=/b", "x.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http:///x", "", "/x", None, "allow"),
    ("http://h/" + "seg/" * 3000, "h", "/" + "seg/" * 3000, None, "allow"),
])
def test_parse_and_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, template string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    row = urls.judge(pages, labels).first()
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_templates(spark):
    """One branch of a host is bad: it stays apart and is rejected; the like branches merge and stay."""
    pages, labels = [], []
    for i in range(1200):
        part = ("news", "blog", "spam")[i % 3]
        pages.append((i, f"http://h.example/{part}/{i}.html"))
        if i % 2:
            labels.append((i, int(part == "spam" or i % 50 == 1)))
    pages += [(5000 + i, f"http://h.example/rare{i}/x") for i in range(30)] + [(None, "http://h.example/news/1"), (7, None)]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    got = urls.judge(df, spark.createDataFrame([*labels, (1, None)], "page_id long, bad int")).collect()
    assert len(got) == len(pages)
    for r in got:
        spam = r.path.startswith("/spam/")
        assert r.verdict == ("block" if spam else "allow")
        if r.host:
            assert re.match(r"h\.example/spam/\*$" if spam else r"h\.example/(blog\|news|\*)/\*$", r.template)


def _judged(spark, pages, bad):
    """Pages are (id, url), bad says which ids are labelled bad; everything is labelled, each label stands there twice."""
    ids = [(i, int(i in bad)) for i, _ in pages]
    df = spark.createDataFrame(pages, "page_id long, url string").repartition(3)
    return {r.page_id: r for r in urls.judge(df, spark.createDataFrame(ids + ids, "page_id long, bad int")).collect()}


@pytest.mark.parametrize("sections", [1, 2, 20, 100])
def test_verdicts_do_not_depend_on_the_size_of_the_host(spark, sections):
    """Section 0 is bad throughout; however many good ones lie beside it, it alone is blocked."""
    pages = [(k * 200 + i, f"http://h.example/s{k}/{i}.html") for k in range(sections) for i in range(200)]
    got = _judged(spark, pages, set(range(200)))
    assert {i for i, r in got.items() if r.verdict == "block"} == set(range(200))


def test_deep_levels(spark):
    """The fifth level tells good from bad, the fourth and the sixth tell nothing."""
    pages = [(i, f"http://h.example/a/b/c/{i % 7}/{('good', 'bad')[i % 2]}/x{i}") for i in range(600)]
    got = _judged(spark, pages, {i for i, _ in pages if i % 2})
    assert all(r.verdict == ("block" if i % 2 else "allow") for i, r in got.items())


def test_small_steps_do_not_chain(spark):
    """Shares of 0, 0.1 to 1.0, each near the next: good sections stay, bad ones go; ties of a share share a template."""
    pages = [(k * 100 + i, f"http://h.example/s{k:02}/p{i}") for k in range(22) for i in range(100)]
    bad = {k * 100 + i for k in range(22) for i in range(100) if i < 10 * (k % 11)}
    got = _judged(spark, pages, bad)
    for i, r in got.items():
        share = i // 100 % 11
        if share != 5:
            assert r.verdict == ("block" if share > 5 else "allow"), r
        assert r.template == got[(i + 1100) % 2200].template


def test_mixed_depths_against_the_sql(spark):
    """Random trees with null labels and URLs: the verdicts are those of the registered SQL."""
    import random

    import duckdb
    import pandas as pd

    from pactscope.llm import queries

    r = random.Random(8)
    urls_ = [f"http://h{r.randint(0, 2)}.example/" + "/".join(r.choice("ab*") for _ in range(r.randint(0, 5))) + f"/{i}" for i in range(3000)]
    urls_ += [None, "", "http://h0.example", "http://x.net/a/1"]
    bad = [int("/a/b" in (u or "") or r.random() < 0.1) for u in urls_]
    pages = pd.DataFrame({"page_id": range(len(urls_)), "url": urls_})
    labels = pd.DataFrame({"doc_id": range(3000), "quality": [1 - b if i % 9 else None for i, b in enumerate(bad[:3000])]}).astype({"quality": "Int64"})
    with duckdb.connect() as db:
        db.register("pages", pages)
        db.register("labels", labels)
        want = sorted(db.execute(queries.ORACLE["op9_url_filters"]).fetchall())
    marks = [(i, b) for i, b in enumerate(bad[:3000]) if i % 9]
    df = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = urls.judge(df, spark.createDataFrame(marks, "page_id long, bad int"))
    got = sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == want
    assert {x[4] for x in got if x[3] is None} == {"allow", "block"}


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, spark.createDataFrame([], "page_id long, bad int")).collect() == []
