"""Counts that a url model does not hold in memory count all the same."""

from pyspark.sql import functions as F

from storyloom.llm import urlfilter


def test_a_small_model_judges_as_the_whole_one(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id as page_id", """concat('https://', if(id % 3 = 0, 'a.net', if(id % 3 = 1, 'b.org', 'c.com')),
        '/fr/', substr(md5(cast(id % 1500 as string)), 1, 9), '/', id % 7) as url""").unionByName(
        spark.createDataFrame([(9000, None), (9001, ""), (9002, "x"), (7, "https://c.com/twice")], "page_id long, url string"))

    def run():
        out = urlfilter.judge(rows).select("page_id", "host", "rule", "verdict", F.round("ratio", 9).alias("ratio"))
        return sorted(out.collect(), key=lambda r: (r.page_id, r.host))

    whole = run()
    monkeypatch.setattr(urlfilter, "ENTRIES", 500)
    monkeypatch.setattr(urlfilter, "TOGETHER", 400)
    assert run() == whole and len(whole) == 3004
