"""Literal score cases."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions.facts import casualties, parse_dimensions
from storyloom.functions.signals import Signals
from storyloom.operators import scoring as S

AS_OF = "2024-03-16 00:00:00"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def scored(spark, rows):
    df = spark.createDataFrame(rows, "card_id int, headline string, summary string, category string, age_hours double")
    df = df.withColumn("published_at", F.expr(f"timestamp'{AS_OF}' - make_interval(0,0,0,0,0,0,age_hours * 3600)"))
    return {r.card_id: r for r in S.with_story_scores(df, AS_OF).collect()}


def test_flood_case(spark):
    row = scored(spark, [(1, "Floods in Nepal Claim 1,385 Lives, 8 Sikkim Residents Evacuated",
                          "In the early hours of March 15, 2024, flash floods in Nepal's western districts claimed 1,385 "
                          "lives and left dozens missing. Eight residents from Sikkim, who had been stranded in the affected "
                          "areas, were safely evacuated and returned home. The deluge overwhelmed rivers and caused "
                          "landslides. The Nepalese government has declared a state of emergency and appealed for "
                          "international assistance.", "national", 1.5)])[1]
    dims = {d: row.impact_evidence[d].score for d in S.DIMENSIONS}
    assert dims == {"human": 20.0, "safety": 18.0, "geographic": 14.0, "economic": 0.0, "policy": 0.0,
                    "infrastructure": 0.0, "security": 0.0, "consequence": 0.0}
    assert row.importance_raw == 52.0 and row.urgency_score == 95.0
    out = one(spark, x=S.effective_importance(F.lit(52.0), F.lit(95.0), F.lit(80.0)))
    assert out.x == 75.0


def test_scenarios_keep_their_order(spark):
    rows = scored(spark, [
        (1, "Cyclone Dana strikes Odisha coast, thousands evacuated",
         "Severe tropical cyclone brings 120kmph winds, widespread storm surge and thousands displaced across 5 coastal districts.",
         "state", 2.0),
        (4, "Critical ransomware attack halts hospital networks",
         "Malware outbreak forces emergency room diversions, patient monitoring offline across metropolitan healthcare system.",
         "health", 0.5),
        (6, "Veteran actor dies aged 82 in Mumbai",
         "Celebrated film icon passes away peacefully at residence surrounded by family after prolonged age-related illness.",
         "entertainment", 2.0),
        (9, "Emergency toxic chemical spill triggers mandatory evacuation order",
         "Industrial train derailment breaches chlorine tankers, toxic plume moving towards township.", "national", 0.6),
    ])
    assert rows[6].impact_evidence.safety.score == 0.0
    assert rows[6].importance_raw < rows[1].importance_raw
    assert rows[4].impact_evidence.security.score == 10.0
    assert rows[9].urgency_score == 95.0
    # the published importance includes the emergency floor
    lifted = one(spark, x=S.effective_importance(
        F.lit(rows[9].importance_raw), F.lit(rows[9].urgency_score), F.lit(rows[9].freshness_score)))
    assert rows[9].importance_raw == 58.0 and lifted.x == 75.0


@pytest.mark.parametrize("imp,expected", [(30.0, 76.5), (90.0, 82.5)])
def test_emergency_floor(spark, imp, expected):
    out = one(spark, f=S.final_score(F.lit(imp), F.lit(95.0), F.lit(80.0), F.lit(50.0), F.lit(80.0)))
    assert out.f == expected


def test_clamps(spark):
    low = one(spark, f=S.final_score(*[F.lit(-50.0)] * 5)).f
    high = one(spark, f=S.final_score(*[F.lit(500.0)] * 5)).f
    assert (low, high) == (0.0, 100.0)


@pytest.mark.parametrize("minutes,score", [
    (10, 100), (25, 95), (45, 90), (90, 80), (180, 70), (360, 55), (600, 40), (1080, 25), (2160, 10), (4320, 5), (-120, 25)])
def test_freshness(spark, minutes, score):
    ts = F.expr(f"timestamp'{AS_OF}' - make_interval(0,0,0,0,0,{minutes},0)")
    assert one(spark, f=S.freshness(ts, AS_OF)).f == score


@pytest.mark.parametrize("text,count", [
    ("Five killed in crash", 5), ("10 people killed", 10), ("25 dead", 25), ("100 fatalities", 100),
    ("1,385 lives lost", 1385), ("Floods claim 1,385 lives", 1385), ("death toll reaches 1,385", 1385),
    ("death toll of 1,385", 1385), ("at least 1,385 people have died", 1385),
    ("Floods affected 1,385 homes", None), ("Meeting held in 2025", None), ("Damage estimated at $1,385 million", None),
    ("1,385 people affected", None), ("1,385 vehicles damaged", None)])
def test_casualties(spark, text, count):
    assert one(spark, c=casualties(F.lit(text))).c == count


@pytest.mark.parametrize("text,score", [
    ("evacuation drills planned for schools", 35.0), ("immediate evacuation ordered", 95.0),
    ("car crash near bridge, motorcycle hit", 35.0), ("editorial on trade", 15.0), ("hostage crisis", 82.0)])
def test_urgency(spark, text, score):
    sig = Signals(F.lit(text))
    assert one(spark, u=S.urgency(sig, S.is_isolated(sig))["score"]).u == score


@pytest.mark.parametrize("names,score", [
    (["The Hindu", "BBC News", "Reuters"], 98.0), (["Press Trust of India"], 88.0), (["Livemint"], 70.0),
    (["Local Wire"], 55.0), (["Local Wire", "Hill Post"], 82.0), (["Reuters", "Hill Post"], 90.0),
    (["BBC", "BBC News World"], 88.0)])
def test_trust(spark, names, score):
    rows = [(1, i, n, "", "2") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "card_id int, ord int, name string, url string, trust_tier string")
    assert S.trust_scores(df).first().verification_score == score


def test_decay_refresh(spark):
    cards = spark.createDataFrame([
        (1, "Prime Minister Resigns", "A resignation has been tendered before the upcoming election.", "published", 12, 10.0, 2),
        (2, "Archived", "Old.", "published", 50, 9.99, 1), (3, "Draft", "No.", "draft", None, 0.0, 0)],
        "card_id int, headline string, summary string, verified_status string, h int, objective_score double, impact_keywords_count int")
    cards = cards.withColumn("published_at", F.expr(f"timestamp'{AS_OF}' - make_interval(0,0,0,0,h,0,0)")).withColumn(
        "priority_score", F.lit(5))
    arts = spark.createDataFrame([(1, "s", "2", "Major Political Update", "The prime minister resigns ahead of national election.")],
                                 "card_id int, source_id string, trust_tier string, title string, body string")
    out = {r.card_id: r.objective_score for r in S.refresh_decay(cards, arts, AS_OF).collect()}
    assert out[1] == pytest.approx(39.304, abs=0.01) and out[2] == 9.99 and out[3] == 0.0


def test_supplied_dimensions(spark):
    doc = '{"human_impact": {"score": 50, "evidence": " x ", "confidence": 3}, "policy_impact": 4, "security_impact": -2}'
    d = one(spark, d=parse_dimensions(F.lit(doc))).d
    assert (d.human.score, d.human.evidence, d.human.confidence) == (20.0, "x", 1.0)
    assert (d.policy.score, d.policy.evidence) == (4.0, "Direct model evaluation")
    assert d.security.score == 0.0 and d.safety.evidence == "Insufficient evidence"


def test_relevance(spark):
    order = F.array(F.lit("Politics"), F.lit("Tech"))
    none = F.lit(None).cast("string")
    out = one(
        spark,
        own=S.relevance(F.lit("politics"), F.lit("Goa"), none, F.lit("goa "), none, order),
        other=S.relevance(F.lit("tech"), F.lit("Goa"), none, F.lit("Assam"), none, order),
        world=S.relevance(F.lit("World"), none, none, F.lit("Assam"), none, order))
    assert (out.own, out.other, out.world) == (90.0, 60.0, 40.0)
