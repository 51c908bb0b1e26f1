import random

from helpers import collect
from pyspark.sql import functions as F
from quarry.llm import url_filter as U

KIND = "page_id long, url string, html string, host int, key string, root int, hit int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], KIND)


def test_parts_and_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x", None, ), (2, "https://example.net/fr/", None), (3, "x://sub.example.com/de/1#a", None), (4, "http://example.com/DE/1", None),
        (5, "http://org/fr/x", None), (6, "http://myorg/fr/x", None), (7, "no scheme", None), (8, None, None), (9, "http://a.net", None), (10, "http://A.net?q=/x", None),
        (11, "", None), (None, "http://b.net/", None), (2, "https://example.net/fr/", None), (12, "http://u@H:80/p://q", None),
    ]
    got = collect(U.judge(frame(spark, rows)), "page_id", "host", "path", "rule", "verdict")
    want = [
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "example.net", "/fr/", "net/", "block"), (2, "example.net", "/fr/", "net/", "block"),
        (3, "sub.example.com", "/de/1", "example.com/de/", "block"), (4, "example.com", "/DE/1", None, "allow"), (5, "org", "/fr/x", "org/fr/", "allow"),
        (6, "myorg", "/fr/x", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "a.net", "", None, "allow"), (10, "a.net", "", None, "allow"),
        (11, "", "", None, "allow"), (None, "b.net", "/", "net/", "block"), (12, "u@h:80", "/p://q", None, "allow"),
    ]
    assert got == sorted(want, key=repr)


def test_aliases(spark):
    link = '<html><link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.com/", link.format("http://b.com/")), (2, "http://b.com/", "<META http-equiv='refresh' content='0; url=http://evil.net/x'>"),
        (3, "http://c.org/fr/1", "<link href=http://a.com/ rel=canonical>"), (4, "http://d.com/", link.format("http://e.com/")), (5, "http://e.com/", link.format("http://e.com/")),
        (6, "http://a.com/", None), (7, "http://f.com/", "canonical refresh <link rel=next href=http://evil.net/x>"),
    ]
    got = dict(collect(U.judge(frame(spark, rows)), "page_id", "verdict"))
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}
    chain = spark.createDataFrame([(f"http://n{i}.com/", f"http://n{i + 1}.com/") for i in range(50)] + [("http://n50.com/", "http://z.net/"), (None, "x")], "src string, dst string")
    pages = frame(spark, [(i, f"http://n{i}.com/", None) for i in range(0, 51, 10)] + [(99, "http://q.com/", None)])
    assert dict(collect(U.judge(pages, chain), "page_id", "verdict")) == {**{i: "block" for i in range(0, 51, 10)}, 99: "allow"}


def test_targets(spark):
    base = "HTTP://A.com/x/y/z?q#f"
    want = {
        "/p": "HTTP://A.com/p", "//b.net/p": "HTTP://b.net/p", "p.html?a=/../b": "HTTP://A.com/x/y/p.html?a=/../b", "../p": "HTTP://A.com/x/p", "./": "HTTP://A.com/x/y/",
        "..": "HTTP://A.com/x/", "/../../p/./q": "HTTP://A.com/p/q", "?r=1": "HTTP://A.com/x/y/z?r=1", "#t": "HTTP://A.com/x/y/z?q#t", "mailto:me@b.net": None, "": None, "https://c.org": "https://c.org",
    }
    rows = spark.createDataFrame([(base, t) for t in want] + [("none", "/p"), (None, "/p"), ("x://h", "p"), ("x://h", None)], "b string, t string")
    got = {(r.b, r.t): r.u for r in rows.select("b", "t", U.resolved(F.col("b"), F.col("t")).alias("u")).collect()}
    assert got == {(base, t): u for t, u in want.items()} | {("none", "/p"): None, (None, "/p"): None, ("x://h", "p"): "x://h/p", ("x://h", None): None}
    keys = [r.k for r in spark.createDataFrame([("HTTP://A.com#x",), ("http://a.com/",), ("http://a.com/?Q#y",), ("no",), (None,)], "u string").select(U.alias_key(F.col("u")).alias("k")).collect()]
    assert keys == ["http://a.com/", "http://a.com/", "http://a.com/?Q", None, None]


def test_tags_of_any_form(spark):
    evil, pad = "http://evil.net/x?a=1&amp;b=2", "y" * 30_000
    tags = [
        f'<link rel="canonical" href="{evil}" data-pad="{pad}">', f'<link title="a > b" rel="nofollow canonical" href="{evil}">', f"<LINK\nREL=canonical\nHREF='{evil}'/>",
        '<link rel=canonical href=//evil.net/y>', f'<link title=it\'s rel="canonical" href="{evil}">', "<meta content='5; URL=//evil.net/z' http-equiv=Refresh>", '<meta http-equiv="refresh" content="0;url=\'http://evil.net/\'">',
        "<link " + " ".join(f'a{i}="{i}"' for i in range(900)) + f' rel="canonical" href="{evil}">',
    ]
    clean = ['<link rel="canonical" href="/ok">', f'<a rel="canonical" href="{evil}">', f'<link rel="canonicals" href="{evil}">', f'<link rel="canonical" data-href="{evil}">', "<meta name=refresh content='0;url=//evil.net'>", '<link rel="canonical" href="mailto:x@evil.net">', "<link rel=canonical", "canonical"]
    rows = [(i, f"http://p{i}.com/a", f"<html>{t}</html>") for i, t in enumerate(tags + clean)]
    rows += [(100, "http://q.com/a", '<link rel="canonical" href="b/../c">'), (101, "http://q.com/c#frag", '<link rel="canonical" href="http://evil.net/">')]
    got = dict(collect(U.judge(frame(spark, rows)), "page_id", "verdict"))
    assert got == {i: "block" if i < len(tags) or i >= 100 else "allow" for i in got} and len(got) == len(rows)


def test_rules_of_equal_length(spark):
    rules = (("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "a.com", "/"))
    got = collect(U.judge(frame(spark, [(1, "http://a.com/x", None), (2, "http://a.com/y", None)]), rules=rules), "page_id", "verdict")
    assert got == [(1, "allow"), (2, "block")]


def test_aliases_equal_brute_force_on_a_chain_and_a_hub(spark):
    draw = random.Random(5)
    url = lambda n: f"http://h{n}.{'net' if n in (399, 7_777) else 'com'}/"
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1001 + i) for i in range(6_000)] + [(draw.randrange(8_000, 12_000), draw.randrange(8_000, 12_000)) for _ in range(2_500)]
    edges += [(7_777, 8_000 + k) for k in range(5)]
    top = list(range(12_001))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in edges:
        top[find(a)] = find(b)
    bad = {find(399), find(7_777)}
    asked = sorted({n for e in edges for n in e})
    pages = frame(spark, [(n, url(n), None) for n in asked])
    links = spark.createDataFrame([(url(a), url(b)) for a, b in edges], "src string, dst string")
    got = dict(collect(U.judge(pages, links), "page_id", "verdict"))
    assert got == {n: "block" if find(n) in bad else "allow" for n in asked}


def test_empty_and_native(spark):
    assert U.judge(frame(spark, []).limit(0)).count() == 0
    plan = U.judge(frame(spark, [(1, "http://a.com/", None)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
