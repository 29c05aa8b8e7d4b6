import random
import time

import duckdb
import pandas as pd

from lodestack.llm import url_filter as u
from lodestack.llm.common import components

COLUMNS = "page_id long, url string, html string, host string, rule string, a string, node string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], COLUMNS)


def test_components_by_union_find(spark):
    rng, up = random.Random(2), {}
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5400)] + [(None, 1), (9, 9)]

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rules_and_hosts(spark):
    urls = [
        "https://WWW.Example.com/en/1", "http://example.com/en/1#t", "http://a.example.com/de/", "http://x.net/es/?q", "http://x.net/es", "x.net/es/", None, "http://EXAMPLE.org", "a://b.net?/fr/", "http://notexample.com/en/", "://net/fr/",
    ]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages(spark, *[(i, x, "") for i, x in enumerate(urls)])).collect()}
    assert got["https://WWW.Example.com/en/1"] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got["http://example.com/en/1#t"] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got["http://a.example.com/de/"] == ("a.example.com", "/de/", "com/", "allow")
    assert got["http://x.net/es/?q"] == ("x.net", "/es/", "net/es/", "block")
    assert got["http://x.net/es"] == ("x.net", "/es", None, "allow")
    assert got["x.net/es/"] == ("", "", None, "allow")
    assert got[None] == ("", "", None, "allow")
    assert got["http://EXAMPLE.org"] == ("example.org", "", None, "allow")
    assert got["a://b.net?/fr/"] == ("b.net", "", None, "allow")
    assert got["http://notexample.com/en/"][2] == "com/"
    assert got["://net/fr/"] == ("net", "/fr/", "net/fr/", "block")


def test_aliases(spark):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/fr/1">'),  # blocked by its canonical page
        (2, "http://b.net/fr/1", ""),
        (3, "http://c.org/", "<META HTTP-EQUIV=refresh content=\"0; URL='http://a.org/x'\">"),  # by an alias of an alias
        (4, "http://d.org/p/q", "<link href='/r' rel='alternate canonical'>"),
        (5, "http://d.org/r#frag", '<link rel=canonical href="//www.example.com/en/9">'),  # allowed explicitly
        (6, "http://d.org/s", '<link rel="canonical" href="r">'),
        (7, "http://e.net/es/1", '<link rel="canonical" href="http://d.org/r">'),  # its own rule stays
        (8, "http://f.org/", '<!-- <link rel="canonical" href="http://b.net/fr/1"> --><script>"<link rel=canonical href=http://b.net/fr/1>"</script>'),
        (9, "http://g.org/", None),
        (10, None, '<link rel="canonical" href="http://b.net/fr/1">'),
        (11, "http://h.org/", '<link rel="stylesheet" href="http://b.net/fr/1"><link rel=canonical href="javascript:x">'),
        (3, "http://c.org/", ""),
    ]
    got = sorted((r["page_id"], r["verdict"], r["alias"]) for r in u.judge(pages(spark, *rows)).collect())
    assert got == sorted(
        [(1, "block", True), (2, "block", False), (3, "block", True), (3, "block", True), (4, "allow", True), (5, "allow", True), (6, "allow", True), (7, "block", False), (8, "allow", False), (9, "allow", False), (10, "allow", False), (11, "allow", False)]
    )
    log = spark.createDataFrame([("http://g.org/", "http://hop.org/"), ("http://hop.org/", "http://b.net/fr/1"), (None, "x")], "source_url string, target_url string")
    assert u.judge(pages(spark, *rows), redirects=log).where("page_id = 9").first()["verdict"] == "block"
    assert u.judge(pages(spark, *rows).where("false")).count() == 0


def test_planted_links_by_sql(spark):
    """Chains, stars and cycles of canonical and refresh tags with absolute targets, against DuckDB."""
    rng = random.Random(5)
    hosts = ["a.org", "B.org", "example.com", "www.Example.com", "c.net", "d.net", "e.de"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/fr/2", "/es/3?q=1", "/x#f")]
    shapes = [
        '<link rel="canonical" href="{}">', "<LINK HREF='{}' REL='alternate Canonical'/>", "<link rel=canonical href={}>", '<meta http-equiv="refresh" content="5; url={}">',
        "<meta content=\"0;URL='{}'\" http-equiv=Refresh>", '<!-- <link rel="canonical" href="{}"> -->', '<link rel="next" href="{}">', '<script>var x = \'<link rel="canonical" href="{}">\'</script>', "<!-- open <link rel=canonical href={}>",
    ]
    rows = [(i, rng.choice([*urls, None, "no scheme"]), "<p>" + rng.choice(shapes).format(rng.choice(urls)) if rng.random() < 0.3 else rng.choice([None, "", "<p>canonical"])) for i in range(300)]
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    c = duckdb.connect()
    c.register("pages", frame)
    want = sorted(tuple(r) for r in c.execute(f"select page_id, host, path, rule, verdict from ({u.OP4_SQL.strip()})").fetchall())
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in u.judge(pages(spark, *rows)).collect())
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r["alias"] for r in u.judge(pages(spark, *rows)).collect()) > 20


def test_very_long_html(spark):
    """What is opened over and over and never closed takes linear time."""
    begun = time.perf_counter()
    rows = [(i, f"http://h{i}.org/", "canonical " + piece * (2_000_000 // len(piece))) for i, piece in enumerate(("<!-- x", "<script>x ", "<link rel=", "<meta content='", "<link rel=canonical href=http://b.net/fr/1 ", "<link href='//b.net/fr/1' rel=canonical>"))]
    got = {r["page_id"]: r["verdict"] for r in u.judge(pages(spark, *rows)).collect()}
    assert got == {0: "allow", 1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block"}
    assert time.perf_counter() - begun < 60
