"""The event table's columns, and projecting any rows onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()

TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "billable_input_tokens"]
COSTS = ["cost_nano_usd", "input_cost_nano_usd", "output_cost_nano_usd", "cache_read_cost_nano_usd", "cache_creation_cost_nano_usd"]

EVENT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("idempotency_key", TEXT),
        *[T.StructField(n, LONG) for n in ("project_id", "user_id")],
        T.StructField("user_email", TEXT),
        T.StructField("role_snapshot", T.ArrayType(TEXT)),
        *[T.StructField(n, TEXT) for n in ("run_id", "conversation_id", "root_entity_type")],
        *[T.StructField(n, LONG) for n in ("root_entity_id", "root_entity_version_id", "root_entity_project_id")],
        T.StructField("entity_type", TEXT),
        *[T.StructField(n, LONG) for n in ("entity_id", "entity_version_id")],
        *[T.StructField(n, TEXT) for n in ("entity_name", "event_type", "model_name", "dialect", "endpoint", "tool_name")],
        *[T.StructField(n, LONG) for n in TOKENS],
        *[T.StructField(n, LONG) for n in COSTS],
        *[T.StructField(n, TEXT) for n in ("cost_source", "token_source")],
        T.StructField("duration_ms", T.IntegerType()),
        T.StructField("is_error", BOOL),
        T.StructField("trigger_source", TEXT),
        T.StructField("budget_exempt", BOOL),
        T.StructField("meta", TEXT),
    ]
)
#: What a missing or null value of a column that is never null stands for.
DEFAULTS = {**{n: 0 for n in [*TOKENS, *COSTS]}, "is_error": False, "user_id": 0}


def conform_events(rows: DataFrame, *keep: str) -> DataFrame:
    """rows on the event table's columns: missing ones are null or their default, unknown ones are dropped unless kept.

    Cost parts without a total of their own stay as they are; where the parts are missing they are zero.
    """
    have = {c.lower(): c for c in rows.columns}
    out = []
    for f in EVENT:
        value = F.col(have[f.name]).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return rows.select(*out, *keep)
