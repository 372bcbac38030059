"""Toxicity, quality and url models: held-out accuracy and edges."""

import zlib

import numpy as np
import pytest

from storyloom.llm import quality, queries, toxicity, urlfilter
from storyloom.llm.textblocks import Block


def area(rows):
    s = np.array([r["score"] for r in rows])
    y = np.array([r["label"] for r in rows])
    rank = s.argsort().argsort() + 1.0
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize("name,column,least", [("op3_toxicity", "toxic", 0.95), ("op7_quality", "quality", 0.97)])
def test_held_out(spark, name, column, least):
    folder = "/root/testdata/sf0.1"
    out = queries.QUERIES[name](spark, folder).where("held_out")
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", f"{column} as label"), "doc_id").collect()
    assert len(rows) > 500 and area(rows) > least
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, edge, none, module):
    labels = spark.createDataFrame([(3, 1, 1, "t"), (3, 1, 1, "t"), (7, 0, 0, "t"), (None, 1, 1, "t"), (4, None, None, "t"), (99, 1, 1, "t")],
                                   "doc_id long, quality int, toxic int, text string")
    for docs in (edge, none):
        model = module.train(docs, labels)
        rows = module.score(docs, model, ("doc_id", "text"), *(["mark"] if module is toxicity else [])).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r[-1] <= 1 for r in rows)
        assert len({r[-1] for r in rows if not r.text}) <= 1 and len({r[-1] for r in rows if r.doc_id == 7}) <= 1
    untaught = module.score(edge, module.train(edge, labels.where("false"))).collect()
    assert {r["score"] for r in untaught} == {0.5}


def test_url_rules(spark):
    urls = ["http://a.NET/x", "http://net", "http://example.net/en/1", "https://WWW.example.net/en/", "http://example.net/de/", "http://notnet/x",
            "http://x.example.com/de/a?b#c", "http://example.com/en/", "http://org/fr/", "http://a.org/fr/q", None, "", "no scheme",
            "a://b://c/d", "http://h#f/x", "http://h?f/x", "http://é.org/fr/ü" + "u" * 50000]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, text string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][:3] == ("net", "", None)
    assert got[2][2:] == got[3][2:] == ("example.net/en/", "allow") and got[4][2:] == ("net/", "block")
    assert got[5][2] is None and got[6] == ("x.example.com", "/de/a", "example.com/de/", "block") and got[7][2] is None
    assert got[8][2:] == got[9][2:] == ("org/fr/", "allow") and got[16][2] == "org/fr/"
    assert got[10][:3] == got[11][:3] == got[12][:3] == ("", "", None) and got[13][:2] == ("b:", "//c/d")
    assert got[14][:2] == got[15][:2] == ("h", "")
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert urlfilter.judge(df.where("false")).count() == 0


def test_url_ratio_tells_classes_apart(spark):
    rows = [(i, f"http://{'spam-pills' if i % 2 else 'library'}{i}.example.com/page/{i}", bool(i % 2 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, accepted boolean")
    model = urlfilter.train(df)
    from storyloom.llm.textblocks import Block

    d = model.difference(Block(None, [b"http://spam-pills9999.example.com/", b"http://library9999.example.com/", b""]))
    assert d[0] < model.threshold <= d[1] and d[2] == 0


def plain_logs(url, counts, order=5, prior=3.0):
    """Log-probabilities of a url's bytes from exact dictionaries."""
    out = []
    for i, b in enumerate(url):
        p = 1 / 256
        for k in range(order + 1):
            context = (k, url[max(i - k, 0):i], i < k)
            seen = counts.get(context, {})
            p = (seen.get(b, 0) + prior * p) / (sum(seen.values()) + prior)
        out.append(np.log(p))
    return out


def test_url_models_against_dictionaries(spark):
    rng = np.random.default_rng(2)
    urls = ["http://" + "".join(rng.choice(list("abé/.-"), rng.integers(0, 30))) for _ in range(120)]
    rows = [(i, u, bool(i % 3), "k") for i, u in enumerate(urls)] + [(500, None, True, "k"), (501, "", True, "k"), (502, urls[0], None, "k")]
    model = urlfilter.train(spark.createDataFrame(rows, "page_id long, url string, accepted boolean, key string").repartition(4))
    counts = ({}, {})
    for i, u in enumerate(urls):
        if zlib.crc32(str(i).encode()) % urlfilter.HELD:
            raw = u.encode()
            for at, b in enumerate(raw):
                for k in range(6):
                    seen = counts[bool(i % 3)].setdefault((k, raw[max(at - k, 0):at], at < k), {})
                    seen[b] = seen.get(b, 0) + 1
    texts = [u.encode() for u in urls[:40]] + [b"", b"ftp://zzz", b"\x00\x00a"]
    logs = model.logs(Block(None, texts))
    for label in (0, 1):
        assert np.allclose(logs[label], np.concatenate([plain_logs(t, counts[label]) for t in texts]))


def test_url_probabilities_add_up(spark, monkeypatch):
    """60,000 varied urls, more contexts than the model holds: every context's next bytes still have a probability of 1."""
    monkeypatch.setattr(urlfilter, "ENTRIES", 20_000)
    rows = spark.range(60_000).selectExpr("id as page_id", "id % 2 = 0 as accepted",
                                          "concat('https://h', id % 700, '.example.org/', substr(md5(cast(id as string)), 1, 12)) as url")
    model = urlfilter.train(rows)
    assert 5_000 < len(model.followers) <= 20_000
    for context in (b"", b"https://h", b"https://h12.example.org/ab", b"q~q"):
        block = Block(None, [context + bytes([b]) for b in range(256)])
        last = block.lengths.cumsum() - 1
        assert np.allclose(np.exp(model.logs(block)[:, last]).sum(1), 1)
