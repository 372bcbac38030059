"""SQL of the score ladders, built from the same fixed values (DuckDB dialect)."""

from storyloom import constants as K
from storyloom.plans import fixtures as V
from storyloom.plans import sqltext as Q

# first pattern that gives a number wins; money traps have their own query
_NUMBERS = ", ".join(
    f"try_cast(replace(nullif(regexp_extract(t, {Q.lit(p)}, 1), ''), ',', '') AS INT)" for p in K.CASUALTY_NUMBER_PATTERNS)
_WORD_CASE = "CASE {x} " + " ".join(f"WHEN {Q.lit(w)} THEN {n}" for w, n in K.NUMBER_WORDS.items()) + " END"
_WORDS = ", ".join(_WORD_CASE.format(x=f"regexp_extract(t, {Q.lit(p)}, 1)") for p in K.CASUALTY_WORD_PATTERNS)
CASUALTIES = f"coalesce({_NUMBERS}, {_WORDS})"


def _m(p):
    return Q.matches("t", p)


def _ladder(rows, last):
    return "CASE " + " ".join(f"WHEN {_m(r[0])} THEN {r[1]}" for r in rows) + f" {last} END"


HUMAN = (
    "CASE WHEN dead >= 1000 THEN 20.0 WHEN dead >= 100 THEN 16.0 WHEN dead >= 10 THEN 12.0 WHEN dead >= 2 THEN 8.0 "
    "WHEN dead = 1 THEN CASE WHEN notable THEN 2.0 WHEN isolated THEN 3.0 ELSE 6.0 END WHEN dead IS NOT NULL THEN 0.0 "
    + " ".join(f"WHEN {_m(p)} THEN {s}" for p, s, _ in K.HUMAN_LADDER)
    + f" WHEN {_m(K.FATAL_ACCIDENT)} AND NOT notable THEN CASE WHEN isolated THEN 4.0 ELSE 8.0 END "
    "WHEN notable THEN 2.0 ELSE 0.0 END"
)
SAFETY = _ladder(
    K.SAFETY_LADDER, f"WHEN {_m(K.LOCAL_SAFETY)} THEN CASE WHEN isolated THEN 3.0 ELSE 6.0 END ELSE 0.0")
GEOGRAPHIC = "CASE WHEN isolated THEN 2.0 " + " ".join(
    f"WHEN {_m(p)} OR lower(category) IN {Q.in_list(c)} THEN {s}" for p, c, s, _ in K.GEOGRAPHIC_LADDER) + " ELSE 2.0 END"
ECONOMIC = "CASE WHEN isolated THEN 0.0 " + " ".join(f"WHEN {_m(p)} THEN {s}" for p, s, _ in K.ECONOMIC_LADDER) + (
    f" WHEN {_m(K.BUSINESS_ROUTINE)} AND lower(category) = 'business' THEN 4.0 ELSE 0.0 END")
SECURITY = (
    f"CASE WHEN {_m(K.CYBER)} AND {_m(K.CYBER_ESSENTIAL)} THEN 10.0 WHEN {_m(K.CYBER)} THEN 7.0 "
    + " ".join(f"WHEN {_m(p)} THEN {s}" for p, s, _ in K.SECURITY_LADDER) + " ELSE 0.0 END")
POLICY = _ladder(K.POLICY_LADDER, "ELSE 0.0")
INFRASTRUCTURE = _ladder(K.INFRASTRUCTURE_LADDER, "ELSE 0.0")
CONSEQUENCE = _ladder(K.CONSEQUENCE_LADDER, "ELSE 0.0")

_NOT_EVACUATED = (
    r"regexp_replace(t, '\bevacuat(?:e|ion|ing|ions)\s+(?:protocols?|agreements?|frameworks?|drills?|plans?\b)', ' ', 'g')")
URGENCY = (
    f"CASE WHEN {_m(K.EMERGENCY_NOW)} OR {Q.matches(_NOT_EVACUATED, K.EVACUATION)} THEN 95.0 "
    f"WHEN NOT isolated AND {_m(K.CRISIS)} THEN 82.0 WHEN {_m(K.ANNOUNCED_TODAY)} THEN 60.0 WHEN isolated THEN 35.0 "
    f"WHEN {_m(K.PROCEDURE)} THEN 40.0 WHEN {_m(K.RETROSPECTIVE)} THEN 15.0 ELSE 35.0 END"
)
_AGE = f"(epoch_us(TIMESTAMP '{V.AS_OF}') - epoch_us(published_at)) / 60000000.0"
FRESHNESS = (
    f"CASE WHEN published_at IS NULL OR {_AGE} < 0 THEN 25.0 "
    + " ".join(f"WHEN {_AGE} <= {m} THEN {s}" for m, s in K.FRESHNESS_BRACKETS) + " ELSE 5.0 END"
)

# dims_v: impact scores, urgency and freshness of every card
DIMS_SQL = V.CARD_SOURCES_SQL + f""",
text_v AS (SELECT *, {Q.ascii_words("lower(headline || ' ' || summary)")} AS t FROM cards_v),
flags_v AS (SELECT *, {_m(K.NOTABLE_PERSON)} AND NOT {_m(K.MASS_HARM)} AS notable,
  {_m(K.ISOLATED)} AND NOT {_m(K.WIDE_HARM)} AS isolated, {CASUALTIES} AS dead FROM text_v),
dims_v AS MATERIALIZED (SELECT *, {HUMAN} AS human, {SAFETY} AS safety, {GEOGRAPHIC} AS geographic, {ECONOMIC} AS economic,
  {POLICY} AS policy, {INFRASTRUCTURE} AS infrastructure, {SECURITY} AS security, {CONSEQUENCE} AS consequence,
  {URGENCY} AS urgency, {FRESHNESS} AS freshness, {_m(K.LIFESTYLE)} AS lifestyle FROM flags_v),
sums_v AS (SELECT *, human + safety + geographic + economic + policy + infrastructure + security + consequence AS total
  FROM dims_v)"""


def trust(url: str) -> str:
    """trust_v: trust score and counts per card, with or without addresses."""
    return f""",
pubs_v AS (SELECT card_id, {Q.scoring_publisher('name', url, 'trust_tier')} AS pub, ord,
  {Q.scoring_tier('name')} AS tier, trust_tier FROM card_sources_v),
first_v AS (SELECT card_id, pub, arg_min(tier, ord) AS tier, count(*) AS n,
  count(*) FILTER (trust_tier IN ('1', 'Tier 1')) AS t1 FROM pubs_v GROUP BY 1, 2),
count_v AS (SELECT card_id, CAST(sum(n) AS BIGINT) AS source_count, CAST(sum(t1) AS BIGINT) AS tier1_count,
  count(*) FILTER (pub IS NOT NULL) AS ind,
  count(*) FILTER (pub IS NOT NULL AND tier = 1) AS one, count(*) FILTER (pub IS NOT NULL AND tier = 2) AS two
  FROM first_v GROUP BY 1),
trust_v AS (SELECT *, CASE WHEN one >= 2 THEN least(100.0, 95.0 + ind) WHEN one = 1 AND ind >= 2 THEN 90.0
  WHEN one = 1 THEN 88.0 WHEN ind >= 2 THEN 82.0 WHEN two = 1 THEN 70.0 ELSE 55.0 END AS trust,
  CASE WHEN one >= 2 THEN 'cross_verified_tier1' WHEN one = 1 AND ind >= 2 THEN 'cross_verified'
  WHEN one = 1 THEN 'official_wire_confirmed' WHEN ind >= 2 THEN 'multi_source_corroborated'
  WHEN two = 1 THEN 'single_reputable_source' ELSE 'single_unconfirmed_source' END AS status FROM count_v)"""


def parts(imp: str) -> str:
    """Effective importance, and the score part that no reader changes."""
    eff = f"CASE WHEN urgency >= 90 AND freshness >= 25 THEN greatest({imp}, 75.0) ELSE {imp} END"
    return f"""{eff} AS importance,
  round(round((CASE WHEN freshness < 10 THEN 0.40 WHEN freshness < 25 THEN 0.75 ELSE 1.0 END) * ({eff}) * 0.40
    + (CASE WHEN freshness < 10 THEN least(urgency, 25.0) WHEN freshness < 25 THEN least(urgency, 45.0) ELSE urgency END) * 0.20
    + freshness * 0.15 + trust * 0.10, 10), 2) AS base"""


def _scored(where: str, imp: str) -> str:
    return DIMS_SQL + trust("''") + f""",
pre_v AS (SELECT s.*, coalesce(x.trust, 40.0) AS trust, coalesce(x.source_count, 0) AS source_count,
  coalesce(x.tier1_count, 0) AS tier1_count FROM sums_v s LEFT JOIN trust_v x USING (card_id) WHERE {where}),
scored_v AS MATERIALIZED (SELECT *, {parts(imp)} FROM pre_v)"""


_CAPPED = "(CASE WHEN lifestyle THEN least(total, 30.0) ELSE total END)"
PUBLIC_WHERE = (
    f"verified_status = 'published' AND content_type = 'NEWS' AND created_by IN {Q.in_list(K.PUBLIC_CREATORS)} AND NOT "
    + Q.contains_any("summary", K.FEED_BOILERPLATE))
# scored_v: public cards with every reader-independent score
PUBLIC_SQL = _scored(PUBLIC_WHERE, _CAPPED)
# scored_v: all published cards, without the lifestyle cap
PUBLISHED_SQL = _scored("verified_status = 'published'", "total")


def location(state: str, district: str, ustate: str, udistrict: str, cat: str = "category") -> str:
    def c(x):
        return f"lower(trim(coalesce({x}, '')))"

    s, d, us, ud = c(state), c(district), c(ustate), c(udistrict)
    return (
        f"(CASE WHEN {ud} <> '' AND {d} <> '' AND {d} = {ud} THEN 50.0 WHEN {us} <> '' AND {s} <> '' AND {s} = {us} THEN 40.0 "
        f"WHEN ({ud} <> '' AND {d} <> '') OR ({us} <> '' AND {s} <> '') THEN 15.0 "
        f"WHEN lower(trim({cat})) IN ('international', 'world', 'global') THEN 15.0 ELSE 25.0 END)")


def interest(cat: str, order: str) -> str:
    pos = f"list_position(list_transform({order}, lambda c: lower(trim(c))), lower(trim({cat})))"
    return f"(CASE WHEN coalesce({pos}, 0) > 0 THEN greatest(20.0, 50.0 - ({pos} - 1) * 5.0) ELSE 25.0 END)"
