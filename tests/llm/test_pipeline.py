"""Each stage against a plain version of its rule, on its own input."""

import re

import corpus_pipeline as P
from conftest import edge_rows, frame
from test_linededup import brute as brute_lines
from test_neardup import brute as brute_near

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    read = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    kept = P.reject_toxic(spark, docs, FOLDER)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}

    lined = P.drop_lines(spark, docs, FOLDER)
    assert lined.columns == columns
    rows = sorted(read(docs))
    cut = {int(i): text for i, text, _, _ in brute_lines(rows)}
    first = {}
    for i, whole, _ in rows:
        first.setdefault(whole, i)
    # copies of a whole text are cut as the first of them is
    want = {i: cut[first[whole]] for i, whole, _ in rows}
    assert {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    near = P.drop_near_duplicates(spark, docs, FOLDER)
    assert near.columns == columns
    assert sorted(str(r.doc_id) for r in near.collect()) == sorted(r[0] for r in brute_near(read(docs), 5, 80) if r[3])

    bench = [tuple(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", r.text.lower())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {w[i:i + 10] for w in bench for i in range(max(1, len(w) - 9))}

    def hit(text):
        w = tuple(re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text)))
        return any(w[i:i + n] in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))

    clean = P.drop_contaminated(spark, docs, FOLDER)
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t, _ in read(docs) if not hit(t))

    mixed = P.mix_sources(spark, docs, FOLDER)
    assert all(r.copies > 0 and r.taken == r.copies * r["size"] for r in mixed.collect())


def test_edges_pass_through(spark, edge, none):
    for docs in (edge, none):
        for name, stage in P.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "mixing" or out.columns == docs.columns
            rows = out.count()
            assert rows <= docs.count()
    one = P.drop_near_duplicates(spark, edge, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in one) == sorted(map(str, [0, 1, 2, 3, 4, 7, None, 9]))


def test_rows_that_share_an_id(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(7, long, "a"), (7, "quite another text stands in this row, word for word", "a"), (7, long, "a"), (9, None, "a"), (9, None, "b"),
            (8, long, "c"), (None, "a b c d e f g", "s"), (None, "h i j k l m n", "s")]
    got = P.drop_near_duplicates(spark, frame(spark, rows), FOLDER).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=str) == sorted(set(rows) - {(8, long, "c")}, key=str)


def test_run(spark):
    assert P.run(spark, FOLDER).columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
