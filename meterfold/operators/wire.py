"""Token counts from response bodies of eleven wire shapes, by one parse of each payload and one shuffle; raw streams are cut into their events first."""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")


@dataclass(frozen=True)
class Shape:
    """How a wire shape is known, where its counts lie, and whether input includes what the cache served.

    path and body are patterns of the endpoint's path and of a call's whole first body; versioned: whether the
    query must (or must not) name an api-version. provider: whose calls may have this shape; for these own_path and
    own_body hold instead, where given, as what tells providers apart isn't asked of a known one. A shape without path is
    known by its provider only. needs: texts of which every path that fits path or own_path holds one, looked for first as
    that is quick.
    """

    path: str | None
    counts: tuple[tuple[str, ...], ...]
    inclusive: bool
    body: str | None = None
    versioned: bool | None = None
    provider: str | None = None
    own_path: str | None = None
    own_body: str | None = None
    needs: tuple[str, ...] = ()

    def fits(self, path: Column, pattern: str) -> Column:
        """Whether an endpoint's path has a pattern of this shape."""
        found = path.rlike(pattern)
        return functools.reduce(Column.__or__, [path.contains(n) for n in self.needs]) & found if self.needs else found


#: The public formats' paths, patterns and sample bodies, which lie in one data file.
_FORMATS = json.loads(resources.files(__package__).joinpath("wire_shapes.json").read_text())
#: In the order in which they are tried, the specific before the general.
SHAPES = {name: Shape(**{**s, "path": s.get("path"), "needs": tuple(s.get("needs", ())), "counts": tuple(tuple(s["counts"].get(c.removesuffix("_tokens"), ())) for c in COUNTS)}) for name, s in _FORMATS["shapes"].items()}
MODEL = tuple(_FORMATS["model"])
#: A base64 field that holds the body proper, in events of bedrock.invoke.
PACKED = "bytes"


def _schema() -> T.StructType:
    """One schema with every field that a shape or the model's name may lie in; counts stay texts until they are checked."""
    tree: dict = {}
    for path in [*MODEL, PACKED, *(p for s in SHAPES.values() for paths in s.counts for p in paths)]:
        at = tree
        *above, leaf = path.split(".")
        for name in above:
            at = at.setdefault(name, {})
        at[leaf] = None

    def struct(node: dict) -> T.StructType:
        return T.StructType([T.StructField(n, struct(v) if v else T.StringType()) for n, v in node.items()])

    return struct(tree)


def _at(body: str, path: str) -> Column:
    out = F.col(body)
    for name in path.split("."):
        out = out.getField(name)
    return out


def sample(kind: str, **values) -> str:
    """A sample body with values in place of some or all of m, i, o, r, c and t; others stay as <i>."""
    out = _FORMATS["samples"][kind]
    for name, value in values.items():
        out = out.replace(f"<{name}>", str(value))
    return out


def _path(endpoint: Column) -> Column:
    path = F.substring_index(F.substring_index(endpoint, "#", 1), "?", 1)
    return F.when(path.endswith("/"), F.regexp_replace(path, "/+$", "")).otherwise(path)


def _versioned(endpoint: Column) -> Column:
    query = F.substring_index(endpoint, "#", 1)
    return F.when(query.contains("?"), F.substring(query, F.length(F.substring_index(query, "?", 1)) + 1, F.length(query)).contains("api-version")).otherwise(False)


def _own(provider: Column, text: Column, kind: str) -> Column:
    """The first shape of the provider's own that text, which is an endpoint's path or a whole body as kind says, has."""
    rules = []
    for name, s in SHAPES.items():
        pattern = (s.own_path or s.path) if kind == "path" else (s.own_body or s.body)
        if s.provider and pattern:
            rules.append(F.when((provider == s.provider) & (s.fits(text, pattern) if kind == "path" else text.rlike(pattern)), name))
    return F.coalesce(*rules)


def dialect_by_endpoint(path: Column, versioned: Column) -> Column:
    rules = []
    for name, s in SHAPES.items():
        if s.path is None:
            continue
        fits = s.fits(path, s.path)
        if s.versioned is not None:
            # elsewhere than under deployments a query says nothing
            fits = fits & (versioned if s.versioned else ~(versioned & path.contains("/openai/deployments/") & ~F.lower(path).contains("dial")))
        rules.append(F.when(fits, name))
    return F.coalesce(*rules)


def dialect_by_body(body: Column) -> Column:
    return F.coalesce(*[F.when(body.rlike(s.body), name) for name, s in SHAPES.items() if s.body])


def frame_bodies(raw: DataFrame) -> DataFrame:
    """A raw response's events in order: call_id, endpoint, provider, seq, payload.

    raw: call_id, endpoint, provider, content_type, body (text). By content_type a body is a stream of server-sent events
    (their data lines joined; comments, other fields, empty events and the end mark go), lines of JSON, or one JSON text;
    without one that says so, its first event or line tells, however long it is. Lines end in LF, CR or both, and a last event counts without the
    empty line that should end it. A JSON text that is a list gives an event an element, any other is one event as it
    stands. A body without events, or null, gives one null payload, so that its call isn't lost.
    """
    text = F.regexp_replace(F.regexp_replace("body", "^\\uFEFF", ""), "\r\n?", "\n")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    start = F.col("_text")
    named = F.when(kind.contains("event-stream"), "sse").when(kind.rlike("ndjson|jsonl|json-?lines|json-?seq"), "lines").when(kind.contains("json"), "json")
    told = F.when(start.rlike(r"^\s*(data|event|id|retry)?:"), "sse").when(start.rlike(r"^\s*\{[^\n]*\}[ \t]*\n\s*\{"), "lines").otherwise("json")
    rows = raw.select("call_id", "endpoint", "provider", text.alias("_text"), named.alias("_named"))
    # a body that is labelled as JSON and has event lines is a stream all the same
    rows = rows.withColumn("_kind", F.when(F.col("_named").isNull() | ((F.col("_named") == "json") & start.rlike(r"^\s*(data|event):")), told).otherwise(F.col("_named")))
    data = lambda e: F.filter(F.split(e, "\n"), lambda x: x.rlike("^data(:|$)"))
    joined = F.transform(F.split("_text", "\n\n+"), lambda e: F.when(F.size(data(e)) > 0, F.array_join(F.transform(data(e), lambda x: F.regexp_replace(x, "^data:? ?", "")), "\n")))
    lines = F.split("_text", "\n")
    listed = F.when(start.rlike(r"^\s*\["), F.from_json("_text", "array<string>"))
    events = F.when(F.col("_kind") == "sse", joined).when(F.col("_kind") == "lines", lines).otherwise(F.coalesce(listed, F.array("_text")))
    clean = F.filter(F.transform(events, lambda x: F.regexp_replace(x, "^\\x1E", "")), lambda x: x.isNotNull() & (F.trim(x) != "") & (F.trim(x) != "[DONE]"))
    return rows.select("call_id", "endpoint", "provider", F.posexplode_outer(clean).alias("seq", "payload")).withColumn("seq", F.coalesce("seq", F.lit(0)).cast("long")).select("call_id", "endpoint", "provider", "seq", "payload")


def billable_input(inclusive: Column, given: Column, read: Column, creation: Column) -> Column:
    """Input tokens to bill: without what the cache served where the count includes it; null stays null."""
    less = given - F.coalesce(read, F.lit(0)) - F.coalesce(creation, F.lit(0))
    return F.when(given.isNotNull(), F.greatest(F.lit(0), F.when(inclusive, less).otherwise(given)))


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """The token counts of each call from its deframed events: call_id, dialect, counts, model_name, billable input, token_source.

    bodies: call_id, seq, endpoint, provider, payload (a JSON object). A provider with shapes of its own has one of these,
    by the endpoint's path or else by the call's first body; if none fits, or the provider isn't known, any shape may, by
    the endpoint or else by the first body. All events of a call share provider and endpoint. Across a call's events the first input count, the last
    output count, and the first count other than 0 of the others hold. Counts must be whole and not negative. A model that
    the path names comes before one that a body does.

    Each payload is parsed once, and each endpoint's path cut once. Events are read as their endpoint says, which one
    aggregation a call keeps as five counts, and, where a body may still say otherwise, as each shape that a body can tell:
    of such a call it keeps a list of the events that have a count, from which the first body's shape picks its own. So most
    calls are narrow rows, and only one whose endpoint says nothing has a list, no longer than its response. What is read is checked as two arrays of texts a row: an expression for each of the two dozen
    counts would make a method that the JVM doesn't compile.
    """
    schema = _schema()
    provider, endpoint = F.col("provider"), F.col("endpoint")
    rows = bodies.select("call_id", "seq", "provider", "payload", _path(endpoint).alias("_path"), _versioned(endpoint).alias("_versioned"), F.when(endpoint.contains("/model/"), F.regexp_extract(endpoint, r"/model/([^/]+)/", 1)).otherwise("").alias("_path_model"))
    # _sure: the provider's own by its path; _own: what the endpoint alone says
    rows = rows.select("call_id", "seq", "provider", "payload", "_path_model", _own(provider, F.col("_path"), "path").alias("_sure"), dialect_by_endpoint(F.col("_path"), F.col("_versioned")).alias("_any"))
    rows = rows.withColumn("_own", F.coalesce("_sure", "_any"))
    rows = rows.withColumn("_body", F.when(F.col("_sure").isNull(), F.col("payload"))).withColumn("_x", F.from_json("payload", schema))
    packed = F.col("_x").getField(PACKED)
    rows = rows.withColumn("_x", F.when((F.col("_own") == "bedrock.invoke") & packed.isNotNull(), F.from_json(F.decode(F.unbase64(packed), "UTF-8"), schema)).otherwise(F.col("_x")))
    rows = rows.withColumn("_mine", _own(provider, F.col("_body"), "body"))
    rows = rows.withColumn("_told", F.coalesce("_mine", F.when(F.col("_any").isNull(), dialect_by_body(F.col("_body")))))

    def reading(name: str, k: int) -> Column:
        paths = SHAPES[name].counts[k]
        return F.coalesce(*[_at("_x", p) for p in paths]) if paths else F.lit(None).cast("string")

    def numbers(texts: Column) -> Column:
        return F.transform(texts, lambda value: F.when(value.rlike("^[0-9]{1,18}$"), value.cast("long")))

    # shapes that a body tells; a provider's own chat is read like any other
    told = [n for n, s in SHAPES.items() if s.body]
    alike = {n: "openai.chat" for n, s in SHAPES.items() if s.own_body}
    open_to_bodies = F.col("_sure").isNull() & (F.col("_any").isNull() | provider.isin(*{s.provider for s in SHAPES.values() if s.provider and (s.own_body or s.body)}))
    places = [(k, i) for k in range(len(COUNTS)) for i, n in enumerate(told) if SHAPES[n].counts[k]]
    by_path = F.coalesce(*[F.when(F.col("_own") == n, F.array(*[reading(n, k) for k in range(len(COUNTS))])) for n in SHAPES])
    by_body = F.when(open_to_bodies, F.array(*[reading(told[i], k) for k, i in places]))
    rows = rows.select("call_id", "seq", "_sure", "_own", "_path_model", "_mine", "_told", F.coalesce(*[_at("_x", p) for p in MODEL]).alias("_model"), numbers(by_path).alias("_by_path"), numbers(by_body).alias("_by_body"))
    rows = rows.withColumn("_read", F.when(F.col("seq").isNotNull() & F.exists("_by_body", lambda n: n.isNotNull()), F.struct("seq", F.col("_by_body").alias("n"))))
    rows = rows.select("call_id", "seq", "_sure", "_own", "_path_model", "_mine", "_told", "_model", "_read", *[F.col("_by_path")[k].alias(f"_{c}") for k, c in enumerate(COUNTS)])

    def whole_output(output: Column, thoughts: Column) -> Column:
        """Google's output comes without its thoughts."""
        return output + F.coalesce(thoughts, F.lit(0))

    is_google = F.col("_own") == "google.generate_content"
    rows = rows.withColumn("_output_tokens", F.when(is_google, whole_output(F.col("_output_tokens"), F.col("_reasoning_tokens"))).otherwise(F.col("_output_tokens")))
    first = lambda n, there=None: F.min_by(n, F.when(F.col(n).isNotNull() if there is None else there, F.col("seq")))
    merged = [first("_input_tokens"), F.max_by("_output_tokens", F.when(F.col("_output_tokens").isNotNull(), F.col("seq"))), *[first(f"_{c}", F.col(f"_{c}") != 0) for c in COUNTS[2:]]]
    calls = rows.groupBy("call_id").agg(F.max("_sure").alias("_sure"), F.max("_own").alias("_own"), F.min_by("_mine", "seq").alias("_mine"), F.min_by("_told", "seq").alias("_told"), F.max("_path_model").alias("_path_model"), first("_model").alias("_model"), F.sort_array(F.collect_list("_read")).alias("_reads"), *[m.alias(f"_{c}") for m, c in zip(merged, COUNTS, strict=True)])
    calls = calls.withColumn("dialect", F.coalesce("_sure", "_mine", "_own", "_told"))
    calls = calls.withColumn("_by_body", F.when(F.col("_sure").isNull() & (F.col("_mine").isNotNull() | F.col("_own").isNull()), F.col("dialect")))
    calls = calls.replace(alike, subset=["_by_body"])
    at = {place: j for j, place in enumerate(places)}

    def from_reads(k: int, i: int) -> Column:
        """What holds of a count across the events that were read as a shape that a body tells."""
        own = lambda r: r["n"][at[k, i]]
        if k == 1:
            thoughts = at.get((COUNTS.index("reasoning_tokens"), i))
            given = F.transform("_reads", lambda r: whole_output(own(r), r["n"][thoughts]) if told[i] == "google.generate_content" else own(r))
            return F.try_element_at(F.filter(given, lambda n: n.isNotNull()), F.lit(-1))
        return F.get(F.filter(F.transform("_reads", own), lambda n: n.isNotNull() if k == 0 else n != 0), F.lit(0))

    counts = {}
    for k, count in enumerate(COUNTS):
        by_body = [F.when(F.col("_by_body") == n, from_reads(k, i)) for i, n in enumerate(told) if (k, i) in at]
        value = F.when(F.col("_by_body").isNull(), F.col(f"_{count}")).otherwise(F.coalesce(*by_body))
        counts[count] = value if k < 2 else F.coalesce(value, F.lit(0))
    counts["output_tokens"] = F.when(F.col("dialect") == "openai.embeddings", F.coalesce(counts["output_tokens"], F.lit(0))).otherwise(counts["output_tokens"])
    out = calls.select("call_id", "dialect", *[c.alias(n) for n, c in counts.items()], F.coalesce(F.nullif("_path_model", F.lit("")), "_model").alias("model_name"))
    inclusive = F.col("dialect").isin(*[n for n, s in SHAPES.items() if s.inclusive])
    source = F.when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), "unparsed").otherwise("provider")
    return out.withColumn("billable_input_tokens", billable_input(inclusive, F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_creation_tokens"))).withColumn("token_source", source)
