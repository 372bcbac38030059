"""Pages, gazetteer, article files, counted inserts and snapshots by planted answers."""

import pytest
from pyspark.sql import functions as F

from storyloom.operators import joins as J
from storyloom.sources import articles as SA
from storyloom.sources import pages as P
from storyloom.sources import payloads as N
from storyloom.sources import snapshots as S
from storyloom.sources import tables as ST

BODIES = [
    ("<body><div id=PdfDiv><div>one</div><p>two <b>bold</b></p></div> tail</body>", "one two bold"),
    ("<body><article>A</article><div class='x ReleaseContent y'><div><div>deep</div></div>end<!-- no --></div></body>", "deep end"),
    ("<body>x<div id='PdfDiv '>not it</div><article><h1>Head</h1><script>var a='</p>';</script><p>text&nbsp;&copy 2024 &amp; more</article>y</body>",
     "Head text © 2024 & more"),
    ("<html><body><p>a<br>b</p><style>p{}</style>  c\n\n d</body></html>", "a b c d"),
    ("<div class='ReleaseContentMore'>no</div>", None), ("", None), (None, None), ("<body></body>", ""), ("<body>" + "<div>" * 3000 + "x", "x"),
    ("<body>1 < 2 &lt; 3</body>", "1 < 2 < 3"),
]


def test_page_bodies(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(BODIES)], "id int, html string")
    got = {r.id: r.body for r in rows.select("id", N.page_fields("html")["body"].alias("body")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(BODIES)}
    assert rows.filter("id = 0").select(P.extract_body("html", 7)).first()[0] == "one two"


def test_page_heads(spark):
    page = """<meta name=author content=" Desk "><meta property="og:title" content="Other"><h1> </h1><h1><i>x</i> Title &amp; more</h1>
    <div class="article-content big"><section><p>One <a>skip</a> two</p></section><p></p></div><article><p>Three<p>four</article><p>out</p>
    <meta content="2024-01-05T10:00:00Z" property="article:published_time"><meta name="description" content="Teaser">"""
    (one,) = N.extract_meta(spark.createDataFrame([(1, page)], "id int, html string"), keep=["id"]).collect()
    assert (one.title, one.summary, one.content, one.author) == ("", "Teaser", "One two Three four", "Desk")
    assert str(one.published_at) == "2024-01-05 10:00:00"
    (one,) = N.extract_meta(spark.createDataFrame([("<h1><b>x</b></h1><meta property='og:title' content='T'>",)], "html string")).collect()
    assert (one.title, one.content, one.author, one.published_at) == ("T", "", "WION Web Team", None)


def test_gazetteer(spark):
    texts = [("Rain in Mumbai today", "Maharashtra"), ("Mumbais rain", None), ("(J&K) votes", "Jammu and Kashmir"), ("jammu & kashmir", "Jammu and Kashmir"),
             ("Vasco da Gama!", "Goa"), ("vasco  da gama", None), ("greater\tnoida", "Uttar Pradesh"), ("from Pune to Patna", "Bihar"), ("x)goa", None),
             ("goa(x", None), ("in GOA]", "Goa"), (None, None), ("", None), ("new delhi", "Delhi"), ("tamil-nadu", None), ("port blair", "Andaman and Nicobar Islands")]
    rows = spark.createDataFrame(list(enumerate(t for t, _ in texts)), "id int, text string")
    got = {r.id: r.detected_state for r in J.detect_states(rows, J.gazetteer_rows(spark), "id", F.col("text")).collect()}
    assert got == {i: s for i, (_, s) in enumerate(texts) if s}


def test_article_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [ {"link": "l1", "title": "one", "category": "sports"},\n {"link": "l1", "title": "later"}, {"title": "none"} ]')
    (tmp_path / "b.json").write_text('{"link": "l1", "title": "third"}\n\n{"link": "l2", "title": "two"\n{"link": "l3", "title": "three"}\n')
    (tmp_path / "c.json").write_text('[{"link": "l9"}, ')
    (tmp_path / "d.json").write_text("")
    good, bad = SA.read_articles(spark, str(tmp_path))
    assert {(r.link, r.title) for r in good.collect()} == {("l1", "one"), ("l3", "three")}
    assert sorted((r.file[-6:], r.text.strip()) for r in bad.collect()) == [("b.json", '{"link": "l2", "title": "two"'), ("c.json", '[{"link": "l9"},')]


def test_counted_insert(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4), ("c", 5)], "link string, n int")
    old = spark.createDataFrame([("b", 0)], "link string, n int")
    path = str(tmp_path / "t")
    assert tuple(SA.write_new(rows, old, path, order=["n"]).first()) == (5, 2, 3)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("c", 5)]
    assert tuple(SA.write_new(rows, spark.read.parquet(path), path).first()) == (5, 1, 4)
    assert tuple(SA.write_new(rows.limit(0), old, path).first()) == (0, 0, 0)


def test_failed_swap_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "snap"), spark.range(10)
    with pytest.raises(FileNotFoundError):
        S.read_version(spark, path)
    S.write_version(df, path)
    with pytest.raises(Exception):
        S.write_version(df.select(F.expr("assert_true(id < 5)").alias("x"), "id"), path)
    assert S.read_version(spark, path).count() == 10
    with monkeypatch.context() as m:
        m.setattr(S, "_point", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            S.write_version(spark.range(3), path)
    assert S.read_version(spark, path).count() == 10
    for n in (4, 5, 6):
        S.write_version(spark.range(n), path)
    assert S.read_version(spark, path).count() == 6
    assert len([p for p in (tmp_path / "snap").iterdir() if p.name.startswith("version-")]) == 2


def test_snapshot_rows_are_bounded(spark):
    cards = spark.createDataFrame([(i, "hot" if i % 3 else None, float(i % 5)) for i in range(100)], "card_id long, category string, final_feed_score double")
    got = ST.feed_snapshot(cards, "2024-02-01 00:00:00", "category", size=7).collect()
    for key, n in (("hot", 66), (None, 34)):
        mine = sorted((r for r in got if r.category == key), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(-(-n // 7))) and all(r["count"] == n and len(r["items"]) <= 7 for r in mine)
        ids = [x.card_id for r in mine for x in r["items"]]
        assert ids == sorted(ids, key=lambda i: (-(i % 5), i)) and len(ids) == n
    whole = ST.feed_snapshot(cards, "2024-02-01 00:00:00", limit=10).collect()
    assert [len(r["items"]) for r in whole] == [10] and whole[0]["count"] == 100


def test_feed_filter_does_not_parse_again(spark):

    rows = spark.createDataFrame([("f", "<item><title>A &amp; b</title><link>https://x.example/a</link></item><item><title>c</title></item>"
                                        "<item><link>https://x.example/d</link></item>")], "feed string, xml string").withColumn("xml", F.concat("xml", "feed"))
    out = N.parse_feeds(rows, keep=["feed"])
    assert [tuple(r) for r in out.select("item_pos", "url", "title").collect()] == [(0, "https://x.example/a", "A & b")]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Filter" in x and "<title" in x for x in plan)
