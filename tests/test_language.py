"""Language tags shuffle a row for each text and language, not its words."""

from pyspark.sql import functions as F

from storyloom.functions.language import language_profiles, tag_language


def test_words_meet_profiles_before_any_shuffle(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "the dog und der", "en"), (4, None, "en")],
                                 "doc_id long, text string, lang string")
    profiles = language_profiles(docs).localCheckpoint()
    out = tag_language(docs, profiles, "doc_id", F.col("text"))
    got = {r.doc_id: (r.detected_lang, r.lane) for r in out.collect()}
    assert got[1] == ("en", "keep") and got[2] == ("de", "translate") and got[4] == ("en", "keep")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "word" in x]
