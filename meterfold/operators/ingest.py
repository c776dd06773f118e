"""From raw records to priced, de-duplicated events."""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterfold.operators.joins import to_all_if_few

NANO = 1_000_000_000
#: Trigger sources that a header may name, caps on its labels, and what meta of a paid tool may hold.
TRIGGERS = ("scheduled", "chat", "api", "webhook", "index", "schedule_manual", "mcp")
HEADER_CAP, LABEL_CAP = 4096, 255
MAX_LONG = (1 << 63) - 1


def canonical_run_id(value: Column) -> Column:
    """A run id as lower-case UUID with hyphens, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"^urn:uuid:", ""), r"[{}-]", "")
    spaced = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), spaced)


HEADER_SCHEMA = "run_id string, conversation_id string, root_entity_type string, root_entity_id string, root_entity_version_id string, root_entity_project_id string, entity_type string, entity_id string, entity_name string, trigger_source string, signature string"


def decode_attribution(rows: DataFrame, header: str = "header", secret: bytes | None = None) -> DataFrame:
    """Typed label columns from a base64url JSON header.

    A header over 4096 characters or without JSON gives nulls; texts are cut at 255 characters, numbers must be plain,
    unknown trigger sources are null. With a secret, a header's labels count only if signature_ok, an HMAC-SHA256 of
    header by the column signature; the row stays either way.
    """

    @F.pandas_udf("boolean")
    def verified(headers: pd.Series, signatures: pd.Series) -> pd.Series:
        ok = [h is not None and s is not None and hmac.compare_digest(hmac.new(secret, h.encode(), hashlib.sha256).hexdigest(), s) for h, s in zip(headers, signatures, strict=True)]
        return pd.Series(ok)

    standard = F.translate(F.col(header), "-_", "+/")
    padded = F.concat(F.rtrim(standard, F.lit("=")), F.repeat(F.lit("="), F.pmod(-F.length(F.rtrim(standard, F.lit("="))), F.lit(4)).cast("int")))
    usable = (F.length(header) <= HEADER_CAP) & F.col(header).rlike("^[A-Za-z0-9_=-]+$") & (F.pmod(F.length(F.rtrim(standard, F.lit("="))), F.lit(4)) != 1)
    if secret is not None:
        rows = rows.withColumn("signature_ok", verified(F.col(header), F.col("signature")))
        usable = usable & F.col("signature_ok")
    labels = F.from_json(F.when(usable, F.decode(F.unbase64(padded), "UTF-8")), HEADER_SCHEMA)
    rows = rows.withColumn("_labels", labels)
    text = lambda n: F.substring(F.col(f"_labels.{n}"), 1, LABEL_CAP)
    number = lambda n: F.when(F.col(f"_labels.{n}").rlike("^[0-9]{1,18}$"), F.col(f"_labels.{n}").cast("long"))
    texts = {n: text(n) for n in ("conversation_id", "root_entity_type", "entity_type", "entity_name")}
    numbers = {n: number(n) for n in ("root_entity_id", "root_entity_version_id", "root_entity_project_id", "entity_id")}
    trigger = F.when(F.col("_labels.trigger_source").isin(*TRIGGERS), F.col("_labels.trigger_source"))
    return rows.withColumns({"run_id": canonical_run_id(F.col("_labels.run_id")), **texts, **numbers, "trigger_source": trigger}).drop("_labels")


def encode_header(text: str) -> str:
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def resolve_project(rows: DataFrame, members: DataFrame, personal: DataFrame) -> DataFrame:
    """billed_project: the header's project if the caller is a member, else that in a service user's name, else the personal one.

    rows: user_id, user_name, header_project; members: project_id, user_id; personal: user_id, personal_project.
    """
    own = members.select(F.col("project_id").alias("header_project"), "user_id", F.lit(True).alias("_member")).distinct()
    service = F.regexp_extract("user_name", r"^system_user_(\d{1,18})(?:@|$)", 1)
    joined = rows.join(own, ["header_project", "user_id"], "left").join(personal, "user_id", "left")
    billed = F.coalesce(F.when(F.col("_member"), F.col("header_project")), F.nullif(service, F.lit("")).cast("long"), F.col("personal_project"))
    return joined.withColumn("billed_project", billed).drop("_member", "personal_project")


def price_events(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Four priced parts and their total in nano-dollars; rates are nano-dollars a token.

    A model without price costs 0 and is unpriced; without a cache rate the input rate holds. The total is rounded once,
    and the largest part, the first of equal ones, takes what rounding leaves.
    """
    dim = prices.select("model_name", "input_rate", "output_rate", "cache_read_rate", "cache_creation_rate", F.lit(True).alias("_priced"))
    parts = {"input": ("billable_input_tokens", "input_rate"), "output": ("output_tokens", "output_rate"), "cache_read": ("cache_read_tokens", "cache_read_rate"), "cache_creation": ("cache_creation_tokens", "cache_creation_rate")}
    joined = events.drop("cost_source", *[f"{n}_cost_nano_usd" for n in parts], "cost_nano_usd").join(dim, "model_name", "left")
    exact = {n: F.coalesce(F.coalesce(F.col(r), F.col("input_rate")).cast("decimal(20,6)") * F.coalesce(F.col(t), F.lit(0)), F.lit(0).cast("decimal(38,6)")) for n, (t, r) in parts.items()}
    joined = joined.withColumns({f"_{n}": v for n, v in exact.items()})
    total = F.bround(sum((F.col(f"_{n}") for n in parts), F.lit(0).cast("decimal(38,6)")), 0).cast("long")
    joined = joined.withColumns({f"{n}_cost_nano_usd": F.bround(f"_{n}", 0).cast("long") for n in parts}).withColumn("cost_nano_usd", total)
    rest = F.col("cost_nano_usd") - sum((F.col(f"{n}_cost_nano_usd") for n in parts), F.lit(0))
    largest = F.greatest(*[F.col(f"_{n}") for n in parts])
    which = None
    for n in parts:
        here = F.col(f"_{n}") == largest
        which = F.when(here, n) if which is None else which.when(here, n)
    joined = joined.withColumn("_rest", rest).withColumn("_which", which)
    joined = joined.withColumns({f"{n}_cost_nano_usd": F.col(f"{n}_cost_nano_usd") + F.when(F.col("_which") == n, F.col("_rest")).otherwise(0) for n in parts})
    source = F.when(F.col("_priced"), "catalog").otherwise("unpriced")
    return joined.withColumn("cost_source", source).drop("_priced", "_rest", "_which", *[f"_{n}" for n in parts], *[c for c in dim.columns if c.endswith("_rate")])


def price_open(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Events, of which model calls that come without a cost source are priced; any other keeps the cost that it came with."""
    own = ["cost_source", "cost_nano_usd", *[f"{n}_cost_nano_usd" for n in ("input", "output", "cache_read", "cache_creation")]]
    is_open = (F.col("event_type") == "llm") & F.col("cost_source").isNull()
    priced = price_events(events.withColumn("_given", F.struct(*own)).withColumn("_open", is_open), to_all_if_few(prices))
    return priced.withColumns({c: F.when(F.col("_open"), F.col(c)).otherwise(F.col(f"_given.{c}")) for c in own}).drop("_given", "_open")


def stamp_open_roles(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events, of which those that come without roles get their actor's sorted ones in the project, null without any."""
    return backfill_roles(events.withColumn("role_snapshot", F.when(F.size("role_snapshot") > 0, F.col("role_snapshot"))), members).drop("backfilled")


def estimate_cost(requests: DataFrame, prices: DataFrame, default_output: int = 4096, cap_nano: int = 2 * NANO) -> DataFrame:
    """estimate_nano: body bytes / 4 as input, the first positive limit on output or 4096, at most two dollars; 0 without price."""
    limits = [F.when(F.col(c) > 0, F.col(c)) for c in ("max_tokens", "max_completion_tokens", "max_output_tokens")]
    joined = requests.join(prices.select("model_name", "input_rate", "output_rate"), "model_name", "left")
    cost = F.floor(F.col("body_bytes") / 4) * F.col("input_rate") + F.coalesce(*limits, F.lit(default_output)) * F.col("output_rate")
    return joined.withColumn("estimate_nano", F.least(F.coalesce(cost, F.lit(0)), F.lit(cap_nano)).cast("long")).drop("input_rate", "output_rate")


def normalize_tool_cost(records: DataFrame) -> DataFrame:
    """Paid-tool records with valid, and their event columns: model backend/op, nano-dollars, whitelisted meta.

    Names have 1 to 64 characters; units and cost must be finite, not negative, and fit; no cost means unpriced.
    """
    names = ["feature", "backend", "op"]
    valid = F.col("ts").isNotNull() & F.col("project_id").isNotNull() & (F.length("idempotency_key") > 0)
    for n in names:
        valid = valid & F.length(n).between(1, 64)
    for n in ("units", "cost_usd"):
        c = F.col(n)
        valid = valid & (c.isNull() | (~F.isnan(c.cast("double")) & (c >= 0) & (c.cast("double") * float(NANO) < F.lit(float(MAX_LONG)))))
    valid = F.coalesce(valid, F.lit(False))
    priced = F.col("cost_usd").isNotNull()
    meta = F.to_json(F.struct(*names, "units", "unit"))
    return records.withColumns(
        {
            "valid": valid,
            "event_type": F.lit("tool_cost"),
            "model_name": F.concat_ws("/", "backend", "op"),
            "cost_nano_usd": F.when(valid & priced, F.bround(F.col("cost_usd").cast("decimal(28,10)") * NANO, 0).cast("long")).otherwise(0),
            "cost_source": F.when(priced, "reported").otherwise("unpriced"),
            "meta": meta,
        }
    )


def current_roles(members: DataFrame) -> DataFrame:
    return members.groupBy("project_id", "user_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))


def stamp_roles(events: DataFrame, members: DataFrame) -> DataFrame:
    """role_snapshot: the actor's sorted role names in the project, null without any."""
    return events.drop("role_snapshot").join(to_all_if_few(current_roles(members)).withColumnRenamed("roles", "role_snapshot"), ["project_id", "user_id"], "left")


def backfill_roles(events: DataFrame, members: DataFrame) -> DataFrame:
    """Current roles where an event has no snapshot yet; backfilled tells which rows changed."""
    joined = events.join(to_all_if_few(current_roles(members)), ["project_id", "user_id"], "left")
    changed = F.col("role_snapshot").isNull() & F.col("roles").isNotNull()
    return joined.withColumn("backfilled", changed).withColumn("role_snapshot", F.coalesce("role_snapshot", "roles")).drop("roles")


def dedupe_events(rows: DataFrame, arrival: str, sink: DataFrame | None = None, key: Sequence[str] = ("idempotency_key", "ts")) -> DataFrame:
    """The first arrival of each key that the sink doesn't hold yet.

    key: the columns of rows that stand for an event's key and time, where these aren't made out of them yet.
    """
    first = Window.partitionBy(*key).orderBy(arrival)
    out = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out if sink is None else out.join(sink.select(*key), list(key), "left_anti")


def quarantine_events(payloads: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Parsed payloads with reason: null where the row can be inserted, else why it never can be."""
    parsed = payloads.withColumn("_row", F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    required = [F.col(f"_row.{c}") for c in ("ts", "idempotency_key", "project_id", "event_type")]
    unreadable = F.col("_row").isNull() | F.greatest(*[c.isNotNull() for c in required]).eqNullSafe(False)
    missing = F.lit(False)
    for c in required:
        missing = missing | c.isNull()
    reason = F.when(unreadable, "unreadable").when(missing, "incomplete").when(F.length("_row.event_type") > 16, "too long")
    return parsed.withColumn("reason", reason).select(*payloads.columns, "_row.*", "reason")
