"""Language tags by a vote of frequent words.

Profiles are built from labelled text with ``groupBy``; a text is tagged with
the language whose profile words cover most of it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.keywords import words

PROFILE_WORDS = 200


def language_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_WORDS) -> DataFrame:
    """(lang, word, weight): the most frequent words of each language.

    A word counts for a language by the share of its uses that fall there.
    """
    counts = labelled.select(lang, F.explode(words(F.col(text))).alias("word")).groupBy(lang, "word").agg(
        F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(lang).agg(F.sum("n").alias("total"))
    rates = counts.join(totals, lang).withColumn("rate", F.col("n") / F.col("total"))
    w = Window.partitionBy(lang).orderBy(F.desc("rate"), "word")
    top = rates.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")
    share = F.col("rate") / F.sum("rate").over(Window.partitionBy("word"))
    return top.select(lang, "word", F.round(share, 6).alias("weight"))


def tag_language(df: DataFrame, profiles: DataFrame, key: str, text: Column, lang: str = "lang",
                 default: str = "en") -> DataFrame:
    """(key, detected_lang, confidence, lane): lane "translate" for other languages.

    The profile table is bounded (languages x PROFILE_WORDS rows).
    """
    # words meet the profiles where their text is, so only a row for each text and language is shuffled
    votes = (
        df.select(key, F.explode(words(text)).alias("word"))
        .join(F.broadcast(profiles.withColumnRenamed(lang, "_lang")), "word")
        .groupBy(key, "_lang").agg(F.round(F.sum("weight"), 6).alias("score"))
    )
    best = votes.groupBy(key).agg(
        F.min_by("_lang", F.struct(-F.col("score"), F.col("_lang"))).alias("_best"),
        F.max("score").alias("_top"), F.sum("score").alias("_all"))
    tag = F.coalesce("_best", F.lit(default))
    return df.select(key).join(best, key, "left").select(
        key, tag.alias("detected_lang"),
        F.round(F.coalesce(F.col("_top") / F.col("_all"), F.lit(1.0)), 4).alias("confidence"),
        F.when(tag == default, "keep").otherwise("translate").alias("lane"))
