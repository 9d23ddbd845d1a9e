"""From a reply text to a specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.specs import spec_struct

# Where a JSON object is looked for in a reply that is not JSON itself.
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
# Possessive, so that the search neither recurses nor goes back, however long the reply is.
BRACED = r"(?s)\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"


def _number(value: Column) -> Column:
    """JSON numbers only: a boolean or a text is not taken for one."""
    kind = F.schema_of_variant(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def _text(value: Column) -> Column:
    """JSON strings only."""
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.try_variant_get(value, "$", "string"))


def with_reply_object(df: DataFrame, raw: str, output: str = "found") -> DataFrame:
    """Add the reply's JSON object as a variant: whole text, fenced block, or first braces.

    A whole text that is JSON but not an object gives null, as broken text does. The fence
    and the braces are looked for only where the stage before found nothing. Of a key that occurs
    twice the last value counts, which the session is told here.
    """
    df.sparkSession.conf.set(LAST_KEY_WINS, "true")
    text = F.col(raw)
    candidates = F.coalesce(
        F.try_parse_json(F.trim(text)),
        F.try_parse_json(F.regexp_extract(text, FENCED, 1)),
        F.try_parse_json(F.regexp_extract(text, BRACED, 0)),
    )
    found = F.col("_found")
    is_object = F.schema_of_variant(found).startswith("OBJECT")
    return df.withColumn("_found", candidates).withColumn(output, F.when(is_object, found)).drop("_found")


def parse_spec(df: DataFrame, raw: str, output: str = "spec", parsed: str | None = None) -> DataFrame:
    """Add the specification a reply text holds, or null.

    ``parsed`` names the result of ``with_reply_object``, if there is one already.
    Fields of the wrong type become null, list entries and parameters of the wrong type
    are left out.
    """
    found = df.withColumn("_object", F.col(parsed)) if parsed else with_reply_object(df, raw, "_object")
    fields = found.withColumns(
        {
            "_steps": F.try_variant_get("_object", "$.preprocessing", "array<variant>"),
            "_parameters": F.try_variant_get("_object", "$.hyperparameters", "map<string,variant>"),
            "_model": F.try_variant_get("_object", "$.model", "variant"),
            "_reasoning": F.try_variant_get("_object", "$.reasoning", "variant"),
        }
    )
    steps = F.filter(F.transform("_steps", _text), lambda step: step.isNotNull())
    numbers = F.transform_values("_parameters", lambda name, value: _number(value))
    spec = spec_struct(
        steps,
        _text(F.col("_model")),
        F.map_filter(numbers, lambda name, value: value.isNotNull()),
        _text(F.col("_reasoning")),
    )
    return fields.withColumn(output, F.when(F.col("_object").isNotNull(), spec)).drop(
        "_object", "_steps", "_parameters", "_model", "_reasoning"
    )
