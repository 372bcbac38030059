"""Registered SQL states the rules of its query, also on texts that the smallest tables lack."""

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def compared(spark, tmp_path, name, **changed):
    """The query against its SQL, with expressions in place of a table's columns: table={column: Spark SQL}."""
    con = duckdb.connect()
    for table in oracle.TABLES:
        at = f"{FOLDER}/{table}.parquet"
        if table in changed:
            rows = spark.read.parquet(at)
            for column, text in changed[table].items():
                rows = rows.withColumn(column, F.expr(text))
            rows.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
            at = f"{tmp_path}/{table}.parquet/*.parquet"
        else:
            (tmp_path / f"{table}.parquet").symlink_to(at)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}'")
    return oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))


@pytest.mark.parametrize("name", ["clean_text", "clean_html_text", "clean_chat_text", "extract_body", "extract_meta"])
def test_references_without_semicolon(spark, tmp_path, name):
    head = "'<body><article><h1>a &amp b &copy2024 &ampamp; &notit; &#39 &#x27;s &#146; &times; &nosuch; &</h1>x &amp</article></body>'"
    assert compared(spark, tmp_path, name, pages={"html": f"if(page_id % 3 = 0, {head}, html)"}) is None


def test_capital_of_several_letters(spark, tmp_path):
    assert compared(spark, tmp_path, "clean_summary", documents={"text": "if(doc_id % 3 = 0, concat('ßeit ', text), text)"}) is None


def test_final_score_between_decimals(spark, tmp_path):
    values = "cast(event_id % 20000 as double) / 100"
    assert compared(spark, tmp_path, "final_score", events={"value": values}) is None


@pytest.mark.parametrize("name", ["readability_grade", "quality_gate", "route_review"])
def test_grades_between_decimals(spark, tmp_path, name):
    """Texts of w words and y syllables in a sentence, the only ones, among them grades that end in 5 and grades just below 0."""
    texts = "concat(repeat('ma ', cast(doc_id % 400 + 1 as int)), repeat('mama ', cast(doc_id % 7 as int)), if(doc_id % 2 = 0, '. ', ''), 'ma')"
    assert compared(spark, tmp_path, name, documents={"text": texts}) is None


def test_grade_is_exact(spark):
    """20 words, one syllable each: 0.39 * 20 + 11.8 - 15.59 = 4.01; 285 words: 107.36; 295 words with 335 syllables: 112.86."""
    rows = spark.createDataFrame([("ma " * 20,), ("ma " * 285,), ("",), ("ma ma. " * 5,), ("ma " * 35 + "mama " * 5,)], "t string")
    from storyloom.functions.text import fk_grade

    got = [r[0] for r in rows.select(fk_grade("t")).collect()]
    # 40 words and 45 syllables: 15.6 + 13.275 - 15.59 = 13.285
    assert got == [4.0, 107.4, 0.0, -3.0, 13.3]
