"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import conversationrepair, ctw, decontamination, linededup, mixing, neardup, packing, periodicruns, quality, suffixdedup, topk, toxicity, urlfilter
from .tables import fold, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame query and, if given, its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS win, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw USING (n, win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark, folder):
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _scored(docs, model, scorer, least: float):
    return scorer(docs, model).select(
        F.col("doc_id").cast("long"), F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return _scored(docs, model, toxicity.score, 0.5)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, folder):
    return suffixdedup.remove_repeats(table(spark, folder, "documents"), 50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_topk", OP4_SQL)
def op4_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    return topk.search(rows, rows.where(F.col("vec_id") % 20 == 0), 20, 64.0)


OP5_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS sh FROM d WHERE len(w) >= 3
        UNION ALL SELECT doc_id, w FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, min(b) AS b FROM t GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(r.b, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
"""


@query("op5_near_duplicates", OP5_SQL)
def op5_near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"), k=3, percent=85)


@query("op6_urls")
def op6_urls(spark, folder):
    return urlfilter.judge(table(spark, folder, "pages"))


@query("op7_quality")
def op7_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    return _scored(docs, model, quality.score, 0.3)


@query("op8_line_dedup")
def op8_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_drops").alias("n_dropped"), "text")


@query("op9_lm_scores")
def op9_lm_scores(spark, folder):
    return ctw.score(table(spark, folder, "documents"))


@query("op10_mixing")
def op10_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op11_periodic_runs")
def op11_periodic_runs(spark, folder):
    found = periodicruns.periodic_runs(periodicruns.repeat_some(table(spark, folder, "documents")))
    runs = F.col("runs")
    # length / period falls, then start and period rise: compared as whole numbers, no quotient is rounded
    best = F.array_sort(runs, lambda x, y: F.coalesce(
        F.nullif(F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"), F.lit(0)),
        F.nullif(F.signum(x["start"] - y["start"]).cast("int"), F.lit(0)), F.signum(x["period"] - y["period"]).cast("int")))
    found = found.withColumn("best", F.get(best, F.lit(0)))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                          r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


@query("op12_conversation_repair")
def op12_conversation_repair(spark, folder):
    return conversationrepair.repair(conversationrepair.damage(table(spark, folder, "conversations")), gone="gone")


@query("op13_packing")
def op13_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"))
