"""Numbers in text, and evidence supplied as JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom import constants as K
from storyloom.functions.labels import literal_map
from storyloom.functions.text import rx, strip, text_or_empty

_FACT = r"(\d+(?:\.\d+)?)\s+([a-zA-Z]+)"


def numeric_facts(c) -> Column:
    """Array of (label, value) for every "<number> <word>" in the lower-case text."""
    low = F.lower(text_or_empty(c))
    numbers = F.regexp_extract_all(low, F.lit(rx(_FACT)), F.lit(1))
    labels = F.regexp_extract_all(low, F.lit(rx(_FACT)), F.lit(2))
    return F.zip_with(
        labels, numbers,
        lambda label, value: F.struct(label.alias("label"), value.try_cast("double").alias("value")),
    )


def rel_diff(a, b) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def casualties(c) -> Column:
    """Explicit death count, or NULL; money amounts never count."""
    low = F.lower(text_or_empty(c))
    counts = []
    for pattern in K.CASUALTY_NUMBER_PATTERNS:
        # context of the first match: five characters before, twelve after the number
        opened = rx(r"(?s)^(.*?)(?=" + pattern + ")")
        before_match = F.regexp_extract(low, opened, 1)
        whole = F.regexp_substr(low, F.lit(rx(pattern)))
        number = F.regexp_extract(low, rx(pattern), 1)
        start = F.length(before_match) + F.position(number, whole)
        prefix = F.substr(low, F.greatest(start - 5, F.lit(1)), F.least(F.lit(5), start - 1))
        suffix = F.substr(low, start + F.length(number), F.lit(12))
        money = prefix.rlike(r"\$|rs|inr") | suffix.rlike("million|billion|crore")
        counts.append(
            F.when((number != "") & ~money, F.replace(number, F.lit(","), F.lit("")).try_cast("int"))
        )
    word_value = literal_map(K.NUMBER_WORDS)
    for pattern in K.CASUALTY_WORD_PATTERNS:
        counts.append(F.try_element_at(word_value, F.regexp_extract(low, rx(pattern), 1)))
    return F.coalesce(*counts)


_PART = T.StructType([
    T.StructField("score", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("explanation", T.StringType()),
])


def parse_dimensions(c) -> Column:
    """Supplied impact scores, each an object or a number, clamped to its cap."""
    doc = c if isinstance(c, Column) else F.col(c)
    fields = []
    for name, cap in K.DIMENSION_CAPS.items():
        raw = F.get_json_object(doc, f"$.{name}_impact")
        part = F.from_json(raw, _PART)
        number = raw.try_cast("double")
        is_object = F.startswith(raw, F.lit("{"))
        value = F.when(is_object, F.coalesce(part["score"].try_cast("double"), F.lit(0.0))).otherwise(number)
        fields.append(
            F.struct(
                F.greatest(F.lit(0.0), F.least(F.lit(cap), F.coalesce(value, F.lit(0.0)))).alias("score"),
                F.when(is_object, strip(F.coalesce(part["evidence"], F.lit(""))))
                .when(number.isNotNull(), F.lit("Direct model evaluation"))
                .otherwise(F.lit("Insufficient evidence")).alias("evidence"),
                F.when(
                    is_object,
                    F.greatest(F.lit(0.0), F.least(
                        F.lit(1.0), F.coalesce(part["confidence"].try_cast("double"), F.lit(0.9)))),
                ).when(number.isNotNull(), F.lit(0.8)).otherwise(F.lit(0.5)).alias("confidence"),
                F.when(is_object, strip(F.coalesce(part["explanation"], F.lit(""))))
                .otherwise(F.lit("")).alias("explanation"),
            ).alias(name)
        )
    return F.struct(*fields)
