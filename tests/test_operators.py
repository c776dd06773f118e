"""Known answers of single operators."""

import base64
import datetime
import json
import math
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

from meterfold.functions import columns as C
from meterfold.functions.predicates import date_range
from meterfold.operators import complexity as X
from meterfold.operators import counters as K
from meterfold.operators import ingest as I
from meterfold.operators import quantiles as quantile_module
from meterfold.operators.wire import frame_bodies, parse_bodies, sample
from meterfold.operators.page import collapse_tail, page
from meterfold.operators.quantiles import quantiles
from meterfold.operators.sketches import daily_sketches, union_counts
from meterfold.plans import jobs as jobs_plans
from meterfold.plans import streams
from meterfold.schema import EVENT, conform_events
from meterfold.sources import fixtures
from meterfold.sources.events import drop_months, expired_months, read_events, write_events
from meterfold.sources.store import Store
from meterfold.streaming import balances as B
from meterfold.streaming import jobs as S
from meterfold.streaming import rollup
from meterfold.streaming.commits import Commit, CommitLog, Run, to_merge

DAY = datetime.datetime(2024, 1, 1)


def one(df):
    return df.first().asDict()


def test_date_range():
    week = datetime.timedelta(days=7)
    assert date_range(None, None, DAY).start == DAY - week
    assert date_range(DAY - 2 * week, None, DAY).end == DAY - week
    long = date_range(datetime.datetime(2020, 1, 1), DAY, DAY)
    assert long.clamped and (long.end - long.start).days == 366
    with pytest.raises(ValueError):
        date_range(DAY, DAY - week, DAY)


def test_conform_fills_and_drops(spark):
    got = one(conform_events(spark.createDataFrame([(5, "x", "y")], "project_id long, run_id string, unknown string")))
    assert list(got) == EVENT.fieldNames() and got["project_id"] == 5 and got["input_tokens"] == 0 and got["is_error"] is False and got["user_email"] is None


def test_canonical_run_id(spark):
    h = "0123456789abcdef0123456789abcdef"
    dashed = "01234567-89ab-cdef-0123-456789abcdef"
    df = spark.createDataFrame([(h.upper(),), ("urn:uuid:" + dashed,), ("{" + dashed + "}",), ("no",), (None,)], "v string")
    assert [r[0] for r in df.select(I.canonical_run_id(F.col("v"))).collect()] == [dashed] * 3 + [None] * 2


def test_price_takes_rounding_and_fallback(spark):
    events = spark.createDataFrame([("m", 3, 2, 5, 0), ("none", 1, 1, 1, 1)], "model_name string, billable_input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long")
    prices = spark.createDataFrame([("m", 1.5, 2.25, None, None)], "model_name string, input_rate double, output_rate double, cache_read_rate double, cache_creation_rate double")
    got = {r.model_name: r for r in I.price_events(events, prices).collect()}
    assert got["none"].cost_source == "unpriced" and got["none"].cost_nano_usd == 0
    m = got["m"]
    parts = m.input_cost_nano_usd + m.output_cost_nano_usd + m.cache_read_cost_nano_usd + m.cache_creation_cost_nano_usd
    assert m.cost_nano_usd == parts == 16 and m.cache_read_cost_nano_usd == 8


def test_attribution_header(spark):
    good = I.encode_header('{"run_id":"0123456789abcdef0123456789abcdef","root_entity_id":"12","trigger_source":"nowhere","entity_name":"' + "é" * 300 + '"}')
    df = spark.createDataFrame([(good,), ("!!",), (None,), ("A" * 5000,)], "header string")
    got = I.decode_attribution(df).collect()
    assert got[0].root_entity_id == 12 and got[0].trigger_source is None and len(got[0].entity_name) == 255
    assert all(r.run_id is None for r in got[1:])
    import hashlib
    import hmac

    signed = spark.createDataFrame([(good, hmac.new(b"k", good.encode(), hashlib.sha256).hexdigest()), (good, "bad")], "header string, signature string")
    assert [r.root_entity_id for r in I.decode_attribution(signed, secret=b"k").collect()] == [12, None]


def test_wire_known_answers(spark):
    rows = [
        ("a", 0, "https://x/v1/messages", None, sample("message_start", m="c", i=12, r=8000, c=3200)),
        ("a", 1, "https://x/v1/messages", None, sample("message_delta", o=45)),
        ("g", 0, "https://x/m:streamGenerateContent", None, sample("google", m="g", i=5000, o=11, t=20, r=4096)),
        ("e", 0, "https://x/v1/embeddings", None, sample("embeddings", m="e", i=7)),
        ("u", 0, "https://x/v1/chat/completions", None, sample("prompt_only", i=-1)),
    ]
    got = {r.call_id: r for r in parse_bodies(spark.createDataFrame(rows, "call_id string, seq long, endpoint string, provider string, payload string")).collect()}
    assert (got["a"].input_tokens, got["a"].output_tokens, got["a"].cache_read_tokens, got["a"].cache_creation_tokens, got["a"].billable_input_tokens) == (12, 45, 8000, 3200, 12)
    assert (got["g"].output_tokens, got["g"].billable_input_tokens, got["g"].dialect) == (31, 904, "google.generate_content")
    assert (got["e"].input_tokens, got["e"].output_tokens, got["e"].token_source) == (7, 0, "provider")
    assert got["u"].token_source == "unparsed"


CHAT = sample("chat", m="m", i=100, o=7, r=30, c=20, t=2)
MESSAGE = sample("message_start", m="m", i=100, r=30, c=20)
INVOKED = sample("invoke", i=100, o=7, r=30, c=20)
WIRE = [
    # dialect, endpoint, provider, bodies in order, (input, output, cache read, cache creation, reasoning, billable), model
    ("openai.chat", "https://x/v1/chat/completions?x=1", None, ['{"model":"m","choices":[]}', CHAT], (100, 7, 30, 20, 2, 50), "m"),
    ("openai.chat", "https://x/v1/completions", None, [CHAT], (100, 7, 30, 20, 2, 50), "m"),
    ("openai.chat", "https://x/proxy", None, [CHAT, "{}"], (100, 7, 30, 20, 2, 50), "m"),
    ("azure.chat", "https://x/openai/deployments/d/chat/completions?api-version=2024", None, [CHAT], (100, 7, 30, 20, 2, 50), "m"),
    ("ai_dial.chat", "https://x/openai/deployments/d/chat/completions", None, [CHAT], (100, 7, 30, 20, 2, 50), "m"),
    ("ai_dial.chat", "https://dial.x/v1/chat/completions", None, [CHAT], (100, 7, 30, 20, 2, 50), "m"),
    ("wam.chat", "https://x/v1/chat/completions", "wam", [CHAT], (100, 7, 30, 20, 2, 50), "m"),
    ("anthropic.messages", "https://x/v1/messages", "wam", [MESSAGE, sample("message_delta", o=3), sample("message_delta", o=7)], (100, 7, 30, 20, 0, 100), "m"),
    ("anthropic.messages", "https://x/proxy", None, [MESSAGE, sample("message_delta", o=7)], (100, 7, 30, 20, 0, 100), "m"),
    ("openai.responses", "https://x/v1/responses", None, ['{"response":{"model":"m"}}', sample("response", i=100, o=7, r=30, t=2)], (100, 7, 30, 0, 2, 70), "m"),
    ("openai.responses", "https://x/v1/images/edits", None, [sample("counts_short", i=100, o=7)], (100, 7, 0, 0, 0, 100), None),
    ("openai.embeddings", "https://x/v1/embeddings", None, [sample("embeddings", m="m", i=100)], (100, 0, 0, 0, 0, 100), "m"),
    ("bedrock.converse", "https://x/model/m.v1/converse-stream", None, ["{}", sample("converse", i=100, o=7, r=30, c=20)], (100, 7, 30, 20, 0, 100), "m.v1"),
    ("bedrock.invoke", "https://x/model/m.v1/invoke", None, [INVOKED], (100, 7, 30, 20, 0, 100), "m.v1"),
    ("bedrock.invoke", "https://x/model/m.v1/invoke-with-response-stream", None, [json.dumps({"bytes": base64.b64encode(b.encode()).decode()}) for b in (MESSAGE, sample("message_delta", o=7))], (100, 7, 30, 20, 0, 100), "m.v1"),
    ("google.generate_content", "https://x/models/m:generateContent", None, [sample("google", m="m", i=100, o=5, t=2, r=30)], (100, 7, 30, 0, 2, 70), "m"),
    ("ollama.native", "https://x/api/chat", None, ['{"model":"m","done":false}', '{"model":"m","prompt_eval_count":100,"eval_count":7}'], (100, 7, 0, 0, 0, 100), "m"),
    (None, "https://x/other", None, ["{broken", sample("prompt_only", i=1.5)], (None, None, 0, 0, 0, None), None),
]


def test_every_wire_shape(spark):
    rows = [(str(k), seq, endpoint, provider, body) for k, (_, endpoint, provider, bodies, _, _) in enumerate(WIRE) for seq, body in enumerate(bodies)]
    got = {int(r.call_id): r for r in parse_bodies(spark.createDataFrame(rows[::-1], "call_id string, seq long, endpoint string, provider string, payload string")).collect()}
    for k, (dialect, *_, counts, model) in enumerate(WIRE):
        r = got[k]
        found = r.input_tokens, r.output_tokens, r.cache_read_tokens, r.cache_creation_tokens, r.reasoning_tokens, r.billable_input_tokens
        assert (r.dialect, found, r.model_name) == (dialect, counts, model), WIRE[k][:3]
        assert r.token_source == ("unparsed" if dialect is None else "provider")


USED = sample("chat_short", i=100, o=7)
TOLD = [
    # dialect, endpoint, provider, bodies
    ("azure.chat", "https://gate/v1/chat/completions", "azure_open_ai", [USED]),
    ("ai_dial.chat", "https://gate/v1/chat/completions", "ai_dial", [USED]),
    ("ai_dial.chat", "https://x/openai/deployments/d/chat/completions?api-version=1", "ai_dial", [USED]),
    ("azure.chat", "https://dial.x/openai/deployments/d/completions", "azure_open_ai", [USED]),
    ("openai.chat", "https://dial.x/v1/chat/completions", "open_ai", [USED]),
    ("wam.chat", "https://dial.x/v1/chat/completions", "wam", [USED]),
    # a provider's own shape by its body comes before another's by the endpoint
    ("azure.chat", "https://gate/v1/messages", "azure_open_ai", [USED]),
    ("google.generate_content", "https://gate/v1/messages", "vertex_ai", [sample("google_short", i=100, o=7)]),
    # a provider that has no shape for it: any by the endpoint, then any by the body
    ("openai.embeddings", "https://x/v1/embeddings", "ai_dial", [sample("embeddings", m="m", i=100)]),
    ("anthropic.messages", "https://x/v1/messages", "amazon_bedrock", [sample("counts_short", i=100, o=7)]),
    ("openai.chat", "https://x/proxy", "amazon_bedrock", [USED]),
    ("openai.chat", "https://x/proxy", "unheard_of", [USED]),
    ("openai.embeddings", "https://x/v1/embeddings", "wam", [sample("prompt_only", i=100)]),
    # paths that go on, and an api-version that is in the path only
    ("anthropic.messages", "https://x/v1/messages/batch", None, [sample("counts_short", i=100, o=7)]),
    ("openai.responses", "https://x/v1/responses/r1", None, [sample("counts_short", i=100, o=7)]),
    ("google.generate_content", "https://x/m:generateContent/x", None, [sample("google_short", i=100, o=7)]),
    ("ollama.native", "https://x/api/embeddings/", None, ['{"prompt_eval_count":100,"eval_count":7}']),
    ("ai_dial.chat", "https://x/openai/deployments/api-version/chat/completions", None, [USED]),
    ("ai_dial.chat", "https://DIAL/openai/deployments/d/chat/completions", None, [USED]),
]


def test_a_known_provider_narrows_the_shapes(spark):
    rows = [(k, seq, endpoint, provider, body) for k, (_, endpoint, provider, bodies) in enumerate(TOLD) for seq, body in enumerate(bodies)]
    got = {r.call_id: r for r in parse_bodies(spark.createDataFrame(rows, "call_id long, seq long, endpoint string, provider string, payload string")).collect()}
    for k, (dialect, *own) in enumerate(TOLD):
        assert (got[k].dialect, got[k].input_tokens, got[k].output_tokens) == (dialect, 100, 0 if dialect == "openai.embeddings" else 7), own


def sse(*bodies, end="\n", extra=""):
    return "".join(f"event: x{end}{extra}data: {b}{end}{end}" for b in bodies)


RAW = [
    # dialect, endpoint, content type, raw body, (input, output)
    ("openai.chat", "https://x/v1/chat/completions", "text/event-stream; charset=utf-8", sse('{"choices":[]}', CHAT, "[DONE]"), (100, 7)),
    ("anthropic.messages", "https://x/v1/messages", "text/event-stream", ": ping\r\n\r\n" + sse(MESSAGE, sample("message_delta", o=7), end="\r\n", extra="id: 1\r\n"), (100, 7)),
    ("google.generate_content", "https://x/m:streamGenerateContent", "text/event-stream", sse(sample("google_short", i=100, o=7).replace(",", ",\ndata:")), (100, 7)),
    ("google.generate_content", "https://x/m:streamGenerateContent", "application/json", "[" + sample("google_short", i=100, o=2) + "\n,\r\n" + sample("google_short", i=100, o=7) + "]", (100, 7)),
    ("ollama.native", "https://x/api/chat", "application/x-ndjson", '{"model":"m","done":false}\n\n{"prompt_eval_count":100,"eval_count":7}\n', (100, 7)),
    ("openai.responses", "https://x/v1/responses", None, sse('{"response":{"model":"m"}}', sample("response_short", i=100, o=7), end="\r"), (100, 7)),
    ("openai.chat", "https://x/v1/chat/completions", "application/json", CHAT.replace(",", ",\n  "), (100, 7)),
    ("openai.chat", "https://x/v1/chat/completions", "application/json", "\ufeffdata: " + CHAT, (100, 7)),
    ("ollama.native", "https://x/api/chat", None, '{"model":"m"}\n{"prompt_eval_count":100,"eval_count":7}', (100, 7)),
    ("openai.chat", "https://x/v1/chat/completions", "text/event-stream", ": only a comment\n\n", (None, None)),
    ("openai.chat", "https://x/v1/chat/completions", "text/event-stream", None, (None, None)),
    ("openai.chat", "https://x/v1/chat/completions", "application/json", "", (None, None)),
]


def test_raw_streams_become_events(spark):
    rows = [(k, endpoint, None, kind, body) for k, (_, endpoint, kind, body, _) in enumerate(RAW)]
    framed = frame_bodies(spark.createDataFrame(rows, "call_id long, endpoint string, provider string, content_type string, body string"))
    assert "Python" not in framed._jdf.queryExecution().executedPlan().toString()
    got = {r.call_id: r for r in parse_bodies(framed).collect()}
    assert len(got) == len(RAW)
    for k, (dialect, endpoint, kind, _, counts) in enumerate(RAW):
        assert (got[k].dialect, got[k].input_tokens, got[k].output_tokens) == (dialect, *counts), (k, endpoint, kind)
    seqs = {(r.call_id, r.seq): r.payload for r in framed.collect()}
    assert seqs[2, 0] == sample("google_short", i=100, o=7).replace(",", ",\n") and (0, 2) not in seqs


def test_bodies_are_parsed_in_one_shuffle(spark):
    rows = spark.createDataFrame([("a", 0, "e", None, "{}")], "call_id string, seq long, endpoint string, provider string, payload string")
    plan = parse_bodies(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_spend_reads_one_month(spark, sf_dir):
    store = Store(spark, sf_dir)
    plan = store.counters.where("period_start = DATE '1996-06-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period_start" in plan


def test_breach_of_project_and_member(spark):
    rows = [(1, 5, DAY + datetime.timedelta(hours=k), f"k{k}", 10, "llm", None) for k in range(6)] + [(1, 0, DAY + datetime.timedelta(days=1), "sys", 100, "llm", None), (1, 6, DAY, "free", 999, "llm", True)]
    events = spark.createDataFrame(rows, "project_id long, user_id long, ts timestamp, idempotency_key string, cost_nano_usd long, event_type string, budget_exempt boolean")
    limits = spark.createDataFrame([(1, 100, 35)], "project_id long, project_limit_nano long, member_limit_nano long")
    got = {(r.user_id, r.idempotency_key, r.running_nano) for r in K.budget_breach(events, limits).collect()}
    assert got == {(0, "sys", 160), (5, "k3", 40)}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    """The same micro-batch twice, as after a failure behind its writes: the second changes nothing."""
    root, queue, checkpoint = (str(tmp_path / n) for n in ("log", "queue", "checkpoint"))
    record = '{"ts":"2024-01-01T00:00:00Z","idempotency_key":"%s","project_id":1,"user_id":2,"event_type":"llm","cost_nano_usd":5,"arrival":%d}'
    lines = [record % ("a", 1), record % ("b", 1), record % ("a", 2), "{broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(queue)

    def run():
        S.ingest(spark, S.read_queue(spark, queue), root, checkpoint, {"availableNow": True}).awaitTermination()
        return S.read_landed(spark, root).count(), {(r.user_id, r.cost_nano_usd, r.call_count) for r in S.read_counters(spark, root).collect()}, S.read_letters(spark, root).count()

    want = 2, {(0, 10, 2), (2, 10, 2)}, 1
    assert run() == want
    shutil.rmtree(tmp_path / "checkpoint" / "commits")
    assert run() == want
    now = S.read_letters(spark, root).first().quarantined_at
    assert S.drop_letters(spark, root, now + datetime.timedelta(days=13)) == [] and S.read_letters(spark, root).count() == 1
    assert S.drop_letters(spark, root, now + datetime.timedelta(days=15)) == [0] and S.read_letters(spark, root).count() == 0
    assert run() == (2, {(0, 10, 2), (2, 10, 2)}, 0)


def test_compaction_keeps_the_events(spark, tmp_path):
    root, queue = str(tmp_path / "log"), str(tmp_path / "queue")
    for k in range(7):
        lines = [f'{{"ts":"2024-0{1 + n % 3}-01T00:00:00Z","idempotency_key":"k{n}","project_id":1,"event_type":"llm","arrival":{k}}}' for n in range(k, k + 4)]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(queue)
    S.ingest(spark, S.read_queue(spark, queue, 1), root, str(tmp_path / "p"), {"availableNow": True}, S.Upkeep(fanout=3)).awaitTermination()
    assert sorted(r.idempotency_key for r in S.read_landed(spark, root).collect()) == sorted(f"k{n}" for n in range(10))
    assert [r.size for r in CommitLog(spark, root).newest().runs] == [3, 3, 1]


def test_a_task_of_ingest_has_a_bounded_share(spark, tmp_path, monkeypatch):
    """Events of one month are dealt over tasks by their number, in batches and in merges, and so are their keys."""
    monkeypatch.setattr(S, "ROWS_A_TASK", 200, raising=False)
    root, queue = str(tmp_path / "log"), str(tmp_path / "queue")
    for k in range(2):
        record = F.format_string('{"ts":"2024-01-01T%02d:00:00Z","idempotency_key":"k%d","project_id":1,"event_type":"llm","arrival":1}', (F.col("id") % 24).cast("int"), F.col("id"))
        spark.range(k * 900, k * 900 + 1000, numPartitions=1).select(record).write.mode("append").text(queue)  # 100 come again
    S.ingest(spark, S.read_queue(spark, queue, 1), root, str(tmp_path / "p"), {"availableNow": True}, S.Upkeep(fanout=2)).awaitTermination()
    assert [r.idempotency_key for r in S.read_landed(spark, root).orderBy(F.substring("idempotency_key", 2, 9).cast("int")).collect()] == [f"k{n}" for n in range(1900)]
    for table in ("events", "keys"):
        for folder in (tmp_path / "log" / table).iterdir():
            rows = [r["count"] for r in spark.read.parquet(str(folder)).groupBy(F.input_file_name()).count().collect()]
            assert max(rows) <= 400 and len(rows) <= sum(rows) // 200 + 2


def lines_of(spark, path, *batches):
    """A queue with one file a batch, whose records are (key, minute) pairs of model calls or broken lines."""
    import os

    os.makedirs(path, exist_ok=True)
    for k, batch in enumerate(batches):
        own = [x if isinstance(x, str) else f'{{"ts":"{(DAY + datetime.timedelta(minutes=x[1])).isoformat()}Z","idempotency_key":"{x[0]}","project_id":1,"user_id":2,"event_type":"llm","cost_nano_usd":5,"arrival":{k}}}' for x in batch]
        with open(f"{path}/{k:04d}.json", "w") as f:
            f.write("\n".join(own) + "\n")
        os.utime(f"{path}/{k:04d}.json", (k, k))
    return path


def seen_by_reader(spark, root, commit=None):
    """What a reader makes of one commit: keys of events, calls that counters have, and rejected rows."""
    commit = commit or CommitLog(spark, root).newest()
    keys = sorted(r.idempotency_key for r in S.read_landed(spark, root, commit).collect())
    calls = {r.user_id: r.call_count for r in S.read_counters(spark, root, commit).collect()}
    return keys, calls, S.read_letters(spark, root, commit).count()


def test_a_reader_sees_all_of_a_batch_or_none(spark, tmp_path, monkeypatch):
    """The writer is killed at every one of its writes in turn; what is readable then is that of whole batches, and the next try ends it."""
    batches = [[("a", 0), ("b", 1), "{broken"], [("a", 0), ("c", 90), "{broken"], [("d", 5), ("c", 90)], [("e", 60)]]
    queue = lines_of(spark, str(tmp_path / "queue"), *batches)
    states, keys, broken = [([], {}, 0)], [], 0
    for b in batches:
        keys = sorted({*keys, *(x[0] for x in b if not isinstance(x, str))})
        broken += sum(isinstance(x, str) for x in b)
        states.append((keys, {0: len(keys), 2: len(keys)}, broken))
    go = lambda root: S.ingest(spark, S.read_queue(spark, queue, 1), root, f"{root}-checkpoint", {"availableNow": True}, S.Upkeep(fanout=2)).awaitTermination()
    real, left, seen = {n: getattr(CommitLog, n) for n in ("write", "add")}, {}, []

    def step(name):
        def one(self, *args, **more):
            left[name] -= 1
            if left[name] < 0:
                raise OSError("killed")
            out = real[name](self, *args, **more)
            if left["look"]:
                seen.append(seen_by_reader(spark, self.root))
            return out

        return one

    for name in real:
        monkeypatch.setattr(CommitLog, name, step(name))
    for name, kills in (("write", (1, 4, 6, 11)), ("add", (0, 2)), ("none", (0,))):
        for k in kills:
            root = f"{tmp_path}/{name}-{k}"
            left |= {"write": 10**6, "add": 10**6, "look": name == "none"} | {name: k}
            if name != "none":
                with pytest.raises(Exception, match="killed"):
                    go(root)
                assert seen_by_reader(spark, root) in states
            left |= {"write": 10**6, "add": 10**6}
            go(root)
            assert seen_by_reader(spark, root) == states[-1]
    assert len(seen) > 20 and all(s in states for s in seen)


def test_a_reader_keeps_its_commit_through_merges(spark, tmp_path):
    root, queue = str(tmp_path / "log"), str(tmp_path / "queue")
    lines_of(spark, queue, *[[(f"k{k}", k)] for k in range(9)])
    S.ingest(spark, S.read_queue(spark, queue, 1), root, str(tmp_path / "c"), {"availableNow": True}, S.Upkeep(fanout=2, whole=4)).awaitTermination()
    log = CommitLog(spark, root)
    for v in log.versions():
        commit = log.load(v)
        n = commit.next
        assert seen_by_reader(spark, root, commit) == (sorted(f"k{k}" for k in range(n)), {0: n, 2: n}, 0)
    newest = log.newest()
    assert [r.size for r in newest.runs] == [8, 1]
    # counters are put together at every size, events only up to that of whole
    assert [len(r.folders["counters"]) for r in newest.runs] == [1, 1] and [len(r.folders["events"]) for r in newest.runs] == [2, 1]
    log.vacuum(keep=1)
    assert log.versions() == [newest.version] and seen_by_reader(spark, root)[1] == {0: 9, 2: 9}
    assert len(list((tmp_path / "log" / "events").iterdir())) == 3
    with pytest.raises(RuntimeError):
        log.add(log.load(newest.version)) and log.add(newest)


def test_counters_lie_in_few_files(spark, tmp_path):
    """Runs of a binary counter: of n batches at most fanout - 1 for each of log(n) sizes."""
    runs = ()
    for n in range(200):
        runs = (*runs, Run(n, n, {}))
        while k := to_merge(runs, 4):
            runs = (*runs[:-k], Run(runs[-k].first, runs[-1].last, {}))
        assert len(runs) <= 3 * (1 + math.log(n + 1, 4)) and sum(r.size for r in runs) == n + 1
        assert all(a.last + 1 == b.first for a, b in zip(runs, runs[1:], strict=False))


def test_a_replayed_batch_after_a_merge_counts_once(spark, tmp_path):
    root, queue, checkpoint = str(tmp_path / "log"), str(tmp_path / "queue"), tmp_path / "c"
    lines_of(spark, queue, *[[(f"k{k}", k), ("again", 1)] for k in range(4)])
    go = lambda: S.ingest(spark, S.read_queue(spark, queue, 1), root, str(checkpoint), {"availableNow": True}, S.Upkeep(fanout=2)).awaitTermination()
    go()
    before = seen_by_reader(spark, root)
    assert before == (["again", "k0", "k1", "k2", "k3"], {0: 5, 2: 5}, 0) and [r.size for r in CommitLog(spark, root).newest().runs] == [4]
    for name in ("3", ".3.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    go()
    assert seen_by_reader(spark, root) == before


def scanned(df):
    """Rows that the scans of a plan have read."""
    df.write.format("noop").mode("overwrite").save()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    rows = df.collect()
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found, len(rows)


def test_a_look_for_replays_reads_what_the_batch_spans(spark, tmp_path):
    """A month with ten times the events doesn't make a batch of two hours read more of it."""
    read = {}
    for name, per_hour in (("small", 400), ("large", 4000)):
        log = CommitLog(spark, str(tmp_path / name))
        hour0 = int(DAY.replace(tzinfo=datetime.UTC).timestamp()) * 1_000_000 // S.HOUR
        keys = spark.range(720 * 400, numPartitions=4).select(F.concat(F.lit("k"), F.col("id")).alias("key"), ((hour0 + F.col("id") % 720) * S.HOUR + F.col("id")).alias("us"))
        if per_hour == 4000:
            # the added ones lie in other hours than the batch's
            more = spark.range(720 * 3600, numPartitions=4).select(F.concat(F.lit("m"), F.col("id")).alias("key"), ((hour0 + 100 + F.col("id") % 500) * S.HOUR + F.col("id")).alias("us"))
            keys = keys.unionByName(more)
        folder = log.write(S.by_time(keys), "keys", 0, 0)
        commit = log.add(Commit(runs=(Run(0, 0, {"keys": [folder]}, (hour0 * S.HOUR, (hour0 + 720) * S.HOUR)),)))
        read[name] = scanned(S.seen_keys(log, commit, [hour0 + 3, hour0 + 4], 64))
        assert S.seen_keys(log, commit, [hour0 - 9], 64) is None
    assert read["small"][1] == read["large"][1] == 800
    # whole pages of some thousand rows are read, of millions
    assert read["large"][0] <= read["small"][0] + 40_000 and read["large"][0] < 100_000


def test_ranges_hold_all_hours():
    assert S.ranges_of([], 3) == []
    hours = [1, 2, 5, 6, 7, 20, 21, 90]
    for most in (1, 2, 3, 4, 9):
        got = S.ranges_of(hours, most)
        assert len(got) == min(most, 4) and all(any(lo <= h * S.HOUR <= hi for lo, hi in got) for h in hours)
    assert S.ranges_of(hours, 2) == [(S.HOUR, 22 * S.HOUR - 1), (90 * S.HOUR, 91 * S.HOUR - 1)]


def test_reservations(spark, tmp_path):
    """In time, late, never settled, and settled without a reservation."""
    at = lambda m: DAY + datetime.timedelta(minutes=m)
    reserves = spark.createDataFrame([(1, 2, "in", 10, at(0)), (1, 2, "late", 20, at(0)), (1, 3, "never", 30, at(0)), (9, 9, "end", 0, at(9999))], "project_id long, user_id long, call_id string, held_nano long, held_from timestamp")
    settles = spark.createDataFrame([(1, 2, "in", 4, at(15)), (1, 2, "late", 8, at(16)), (1, 3, "alone", 16, at(5)), (9, 9, "end", 0, at(9999))], "project_id long, user_id long, call_id string, billed_nano long, billed_at timestamp")
    streams = []
    for name, df in (("r", reserves), ("s", settles)):
        df.write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    S.open_reservations(*streams).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    calls = spark.read.parquet(str(tmp_path / "out")).where("project_id = 1")
    got = lambda m: {r.user_id: (r.spent_nano, r.reserved_nano, r.late, r.ran_out) for r in S.balances(calls, at(m)).collect()}
    assert got(10) == {2: (0, 30, 0, 0), 3: (16, 30, 1, 0)}
    assert got(60) == {2: (12, 0, 1, 1), 3: (16, 0, 1, 1)}


def test_live_balances_of_a_stream_that_goes_on(spark, tmp_path):
    """What is reserved is known while reservations are open, before any deadline or watermark; records that come again count once."""
    at = lambda m: DAY + datetime.timedelta(minutes=m)
    held, billed = "project_id long, user_id long, call_id string, held_nano long, held_from timestamp", "project_id long, user_id long, call_id string, billed_nano long, billed_at timestamp"

    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    put("r", held, [(1, 2, "a", 10, at(0)), (1, 2, "b", 20, at(1)), (1, 3, "c", 30, at(2))])
    put("s", billed, [(1, 3, "alone", 16, at(1))])
    streams = [spark.readStream.schema(schema).parquet(str(tmp_path / name)) for name, schema in (("r", held), ("s", billed))]
    root = str(tmp_path / "log")
    go = lambda: B.keep_balances(spark, B.signed_amounts(*streams), root, str(tmp_path / "c"), {"processingTime": "0 seconds"}, fanout=2)
    ask = lambda m: {(r.project_id, r.user_id): (r.spent_nano, r.reserved_nano, r.late, r.ran_out) for r in B.balances_at(spark, root, at(m)).collect()}
    query = go()
    try:
        query.processAllAvailable()
        assert query.isActive and ask(3) == {(1, 2): (0, 30, 0, 0), (1, 3): (16, 30, 1, 0)}
        # one settles in time and comes twice, one late
        put("s", billed, [(1, 2, "a", 4, at(5)), (1, 2, "a", 4, at(5)), (1, 3, "c", 8, at(18))])
        put("r", held, [(1, 2, "b", 20, at(1)), (2, 2, "d", 5, at(6))])
        query.processAllAvailable()
        assert ask(4) == {(1, 2): (0, 30, 0, 0), (1, 3): (16, 30, 1, 0)}
        assert ask(6) == {(1, 2): (4, 20, 0, 0), (1, 3): (16, 30, 1, 0), (2, 2): (0, 5, 0, 0)}
    finally:
        query.stop()
    query = go()
    try:
        put("s", billed, [(2, 2, "d", 1, at(21))])
        query.processAllAvailable()
        assert ask(20) == {(1, 2): (4, 0, 0, 1), (1, 3): (24, 0, 2, 1), (2, 2): (0, 5, 0, 0)}
        assert ask(60) == {(1, 2): (4, 0, 0, 1), (1, 3): (24, 0, 2, 1), (2, 2): (1, 0, 0, 0)}
    finally:
        query.stop()
    assert len(CommitLog(spark, root).newest().runs) <= 3


def test_score_known_answer(spark):
    runs = spark.createDataFrame([(1, "r", DAY, DAY, 12500, 4, 3)], "project_id long, run_id string, ts timestamp, last_event_at timestamp, peak_input_tokens long, llm_calls long, tool_calls long")
    counts = spark.createDataFrame([(1, "r", "kit__heavy", None, 2), (1, "r", "light", None, 1)], "project_id long, run_id string, tool_name string, toolkit_type string, calls long")
    weights = spark.createDataFrame([("heavy", 3)], "tool string, weight long")
    got = one(X.score_runs(runs, counts, weights))
    assert (got["cu_context"], got["cu_llm"], got["cu_tools"], got["cu_total"]) == (12.5, 4.0, 7.0, 23.5)


def test_histogram_median(spark):
    h = [0, 0, 0, 4] + [0] * 9
    df = spark.createDataFrame([(h, 4, 24.0, 8.0)], "h array<long>, n long, s double, m double")
    assert df.select(X.histogram_median(F.col("h"), F.col("n"), F.col("s"), F.col("m"))).first()[0] == 6.0


@pytest.mark.parametrize(("spent", "limit", "threshold", "level"), [(74, 100, 75, None), (75, 100, 75, 75), (92, 100, 75, 90), (96, 100, 75, 95), (96, 100, 96, 96), (100, 100, 75, None), (5, None, 75, None)])
def test_warning_level(spark, spent, limit, threshold, level):
    df = spark.createDataFrame([(spent, limit, threshold)], "s long, l long, t int")
    assert df.select(C.warning_level(F.col("s"), F.col("l"), F.col("t"))).first()[0] == level


def test_tail_and_page(spark):
    df = spark.createDataFrame([(k, k * 10) for k in range(6)], "k long, cost long")
    got = {r.k: r.cost for r in collapse_tail(df, ["k"], "cost", 2).collect()}
    assert got == {5: 50, 4: 40, None: 60}
    assert [r.k for r in page(df, "cost", ["k"], ["cost"], limit=2, offset=1).collect()] == [4, 3]
    with pytest.raises(ValueError):
        page(df, "k", ["k"], ["cost"])


def test_months_are_written_and_dropped(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame([(DAY, "a", 1), (datetime.datetime(2024, 3, 5), "b", 1)], "ts timestamp, idempotency_key string, project_id long")
    write_events(rows, path)
    events = read_events(spark, path)
    assert events.count() == 2
    old = [r[0] for r in expired_months(events, datetime.date(2024, 4, 1), 30).collect()]
    assert old == [datetime.date(2024, 1, 1)]
    drop_months(spark, path, old)
    assert [r.idempotency_key for r in read_events(spark, path).collect()] == ["b"]


def events_of(spark, rows):
    """Events (run, kind of event, minutes after DAY, entity) of one project."""
    own = [(1, run, DAY + datetime.timedelta(minutes=m), kind, entity, "application" if entity else None, "kit__t" if kind == "tool" else None, 1000 * (1 + m % 7)) for run, kind, m, entity in rows]
    df = spark.createDataFrame(own, "project_id long, run_id string, ts timestamp, event_type string, root_entity_id long, root_entity_type string, tool_name string, input_tokens long")
    return conform_events(df)


def files_under(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_rollup_follows_changed_runs(spark, tmp_path):
    """Passes over changed runs give what a rebuild of all gives; days that no changed run is or was in keep their files, and an aborted pass changes nothing."""
    weights = spark.createDataFrame([("t", 2)], "tool string, weight long")
    score = lambda rows: X.score_runs(X.run_aggregates(rows), X.run_tool_counts(rows), weights)
    day = 1440
    batches = [
        [(f"r{k}", kind, k % 6 * day + k, k % 4 or None) for k in range(40) for kind in ("llm", "tool")],
        [("r7", "llm", 1 * day - 30, 3), ("r8", "tool", 2 * day + 500, 4), ("new", "llm", 3 * day, 1)],  # r7 now begins a day earlier
        [("r9", "llm", 4 * day, 9), ("r12", "llm", 90, 2)],  # r9 has another entity and goes on into another day, r12's entity appears
    ]
    log, commit, seen = CommitLog(spark, str(tmp_path / "log")), Commit(), []
    flat = lambda df, *drop: sorted(map(str, df.drop("part", *drop).collect()))
    for k, batch in enumerate(batches):
        seen += batch
        rows = events_of(spark, seen)
        window = events_of(spark, batch).select("project_id", "run_id").distinct()
        scored = score(X.run_rows(rows, window))
        before, files = rollup.read_scores(log, commit), files_under(tmp_path / "log" / "daily") if k else {}
        after = rollup.keep_scores(log, commit, scored)
        changed = rollup.read_scores(log, after).join(window, ["project_id", "run_id"], "left_semi")
        keys = {(r.root_entity_id, str(r.day)) for r in rollup.daily_keys(changed, before).collect()}
        if k == 1:
            assert keys == {(3, "2024-01-01"), (3, "2024-01-02"), (4, "2024-01-03"), (1, "2024-01-04")}
        if k:
            days = {p.rpartition("/")[2] for r in after.runs[-1:] for p in r.folders["daily"]}
            assert days < {f"part=2024-01-0{d}" for d in range(1, 7)}
            assert files.items() <= files_under(tmp_path / "log" / "daily").items()
        whole = X.complexity_daily(score(rows))
        assert flat(rollup.read_daily(log, after).select(*sorted(whole.columns))) == flat(whole.select(*sorted(whole.columns)))
        assert flat(rollup.read_scores(log, after), "day") == flat(score(rows).select(*[c for c in rollup.SCORE.fieldNames() if c not in ("day", "part")]))
        commit = after
    log.vacuum(keep=1)
    assert flat(rollup.read_daily(log).select(*sorted(whole.columns))) == flat(whole.select(*sorted(whole.columns)))
    assert len(files_under(tmp_path / "log" / "daily")) == len({p for r in commit.runs for p in r.folders.get("daily", [])})


def test_roles_are_filled_in_by_month(spark, tmp_path, monkeypatch):
    """Only months with an event that can get roles are written again; counts are told, and a killed run changes nothing."""
    root, queue = str(tmp_path / "log"), str(tmp_path / "queue")
    record = '{"ts":"2024-0%d-01T00:00:00Z","idempotency_key":"k%d","project_id":1,"user_id":%d,"event_type":"llm","arrival":1%s}'
    lines = [record % (1 + k % 4, k, 2 if k % 4 < 2 else 3, ',"role_snapshot":["old"]' if k == 4 or k % 4 == 1 and k > 4 else "") for k in range(12)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(queue)
    S.ingest(spark, S.read_queue(spark, queue), root, str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    members = spark.createDataFrame([(1, 2, "viewer"), (1, 2, "editor")], "project_id long, user_id long, role string")
    log = CommitLog(spark, root)
    before, old = log.newest(), files_under(tmp_path / "log" / "events")
    rows = lambda: sorted((r.idempotency_key, r.role_snapshot) for r in S.read_landed(spark, root).collect())
    first = rows()
    real = CommitLog.add
    monkeypatch.setattr(CommitLog, "add", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        rollup.fill_roles(log, before, members)
    assert rows() == first and log.newest() == before
    monkeypatch.setattr(CommitLog, "add", real)
    after, counts = rollup.fill_roles(log, before, members)
    assert counts == {"2024-01-01": 2, "2024-02-01": 1}
    want = [(k, r or (["editor", "viewer"] if int(k[1:]) % 4 < 2 else None)) for k, r in first]
    assert rows() == want
    assert {p.rpartition("/")[2] for p in after.runs[-1].folders["events"]} == {"event_month=2024-01-01", "event_month=2024-02-01"}
    assert old.items() <= files_under(tmp_path / "log" / "events").items()
    assert rollup.fill_roles(log, after, members) == (after, {})
    # the stream goes on behind it, and knows its replays
    spark.createDataFrame([(record % (1, 0, 2, ""),), (record % (1, 99, 2, ""),)], "value string").coalesce(1).write.mode("append").text(queue)
    S.ingest(spark, S.read_queue(spark, queue), root, str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    assert len(rows()) == 13 and rows()[:1] == want[:1]


@pytest.mark.parametrize("keys", [["g"], [], ["g", "h"]])
def test_quantiles_are_those_of_percentile(spark, keys):
    """Groups of one row to a hot one, repeated values, nulls, and places between two ranges."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") < 50, F.col("id") % 20).otherwise(F.lit(77)).alias("g"), (F.col("id") % 2).alias("h"), F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 4001) / 8.0).alias("v"))
    shares = [0.0, 0.013, 0.25, 0.5, 0.75, 0.99, 1.0]
    marks = F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")
    want = {tuple(r[k] for k in keys): r.q for r in (df.groupBy(*keys) if keys else df).agg(marks).collect() if r.q is not None}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # ranges as many as partitions
    try:
        got = {tuple(r[k] for k in keys): r.quantiles for r in quantiles(df, keys, "v", shares).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == want


def test_quantiles_put_no_group_in_one_task(spark):
    """A single group's values are dealt over all partitions."""
    df = spark.range(40_000).select(F.col("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    seen = {}
    real = quantile_module.materialised

    def look(df, label):
        out = real(df, label)
        seen[label] = out.groupBy("_part").count().collect()
        return out

    quantile_module.materialised = look
    try:
        assert quantiles(df, [], "v", [0.5]).first().quantiles == [19999.5]
    finally:
        quantile_module.materialised = real
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(seen["values"]) == 4 and max(r["count"] for r in seen["values"]) < 20_000 and sum(r["count"] for r in seen["ranges"]) == 4


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([(1, None)], "g long, v double"), ["g"], "v", [0.5]).count() == 0


def test_sketches_merge_and_err_little(spark):
    """Daily sketches put together count as one sketch of all rows does, within a few per cent of the exact count."""
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("project_id"), (F.lit(DAY) + F.make_dt_interval((F.col("id") % 60).cast("int"))).alias("ts"), (F.col("id") * 31 % 70_001).alias("user_id"), F.concat(F.lit("r"), F.col("id") % 300).alias("run_id"), F.lit("chat").alias("trigger_source"))
    names = ["active_users", "runs"]
    daily = daily_sketches(rows, names)
    exact = rows.groupBy(F.date_trunc("month", "ts").alias("m")).agg(F.count_distinct("user_id").alias("active_users"), F.count_distinct("run_id").alias("runs"))
    merged = {r.m: r for r in union_counts(daily, names, F.date_trunc("month", "day").alias("m")).collect()}
    for r in exact.collect():
        assert abs(merged[r.m].active_users / r.active_users - 1) < 0.05 and abs(merged[r.m].runs / r.runs - 1) < 0.02
    once = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(12)))).first()[0]
    assert union_counts(daily, names).first().active_users == pytest.approx(once, rel=0.01)


def test_events_move_as_few_numbers(spark, sf_dir, monkeypatch):
    """The table's build deals and sorts what events are made of, over tasks by the number of lines; the events are those of the SQL."""
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        dealt_over_tasks(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def dealt_over_tasks(spark, sf_dir):
    store = Store(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert len(store.first.columns) <= 14
    assert store.first.rdd.getNumPartitions() == lines // 500 + 1
    plan = store.first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") + plan.count("REPARTITION_BY_NUM") <= 4  # lines, owners by order and both by customer: none for arrivals and replays
    own, sql = store.raw, fixtures._run(spark, fixtures.RAW_EVENTS, sf_dir)
    sql = sql.withColumn("ts", sql.ts.cast("timestamp"))
    assert own.schema == sql.schema
    assert own.exceptAll(sql).count() == 0 and sql.exceptAll(own).count() == 0


def test_first_of_other_keys(spark):
    rows = spark.createDataFrame([(1, 1, 2, "b"), (1, 1, 1, "a"), (1, 2, 1, "c")], "ok long, ln long, arrival long, x string")
    assert {r.x for r in I.dedupe_events(rows, "arrival", key=("ok", "ln")).collect()} == {"a", "c"}


def test_quiet_runs_have_a_size(spark, tmp_path):
    """A batch that only has a new watermark looks empty to the planner; its runs must not, or they'd be broadcast."""
    rows = [(1, f"r{k}", DAY) for k in range(5)] + [(-1, "end", DAY + datetime.timedelta(days=9))]
    spark.createDataFrame(rows, "project_id long, run_id string, ts timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("project_id long, run_id string, ts timestamp").parquet(f"{tmp_path}/in")
    seen = []

    def score(runs):
        seen.append((runs.count(), len(runs.inputFiles()) > 0))
        return runs.withColumn("cu_total", F.lit(1.0))

    S.score_quiet_runs(S.quiet_runs(stream), score, f"{tmp_path}/scores", f"{tmp_path}/checkpoint", {"availableNow": True}).awaitTermination()
    assert (5, True) in seen and all(sized for _, sized in seen)
    assert S.read_scores(spark, f"{tmp_path}/scores").count() == 5


def test_a_queue_is_packed(spark, sf_dir):
    """All arrivals and the replays of the first are in the queue, in a tenth of their text's size."""
    store = Store(spark, sf_dir)
    folder = streams.queue_of(store).removeprefix("file://")
    lines = spark.read.text(folder)
    first = store.first.count()
    assert lines.count() == store.raw.count() + first
    own = lines.agg(F.sum(F.length("value") + 1)).first()[0]
    assert sum(f.stat().st_size for f in Path(folder).rglob("part-*")) * 8 < own


def test_state_lies_on_disk(spark, sf_dir):
    streams.deduped(Store(spark, sf_dir))
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_batch_leaves_no_stage(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    batch = spark.createDataFrame([('{"idempotency_key":"a","ts":"2024-01-01T00:00:00Z","project_id":1,"event_type":"llm","arrival":1}',), ("{broken",)], "payload string")
    S.land(log, log.newest(), batch, "s", 0)
    assert S.read_landed(spark, f"{tmp_path}/log").count() == 1 and [r.payload for r in S.read_letters(spark, f"{tmp_path}/log").collect()] == ["{broken"]
    assert not list((tmp_path / "log" / "staged").glob("run=*"))


def test_tool_weights_keep_their_runs(spark, sf_dir):
    """Whole rows: a run's tools, not sums over runs; and events that scopes select, not their number."""
    from meterfold.plans.catalog import QUERIES

    store = Store(spark, sf_dir)
    weights = QUERIES["tool_weight"](store)
    assert {"project_id", "run_id"} <= {*weights.columns} and weights.select("run_id").distinct().count() > 100
    rows = QUERIES["run_filters"](store)
    assert rows.where("of_root").count() > 20 and "idempotency_key" in rows.columns


def test_runs_are_dealt_once_for_their_scores(spark):
    events = events_of(spark, [(f"r{k % 40}" if k % 5 else None, "llm" if k % 2 else "tool", k, 3) for k in range(200)])
    rows = X.by_run(events, a_task=20)
    assert rows.rdd.getNumPartitions() == 160 // 20 + 1
    runs = rows.select("project_id", "run_id", F.spark_partition_id().alias("p")).distinct()
    assert runs.count() == runs.select("project_id", "run_id").distinct().count()
    weights = spark.createDataFrame([("t", 2)], "tool string, weight long")
    scores = X.score_runs(X.run_aggregates(rows), X.run_tool_counts(rows), weights)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2


def test_roles_go_to_the_events(spark):
    events = conform_events(spark.createDataFrame([("a", 1, 2), ("b", 1, 3)], "idempotency_key string, project_id long, user_id long"))
    members = spark.createDataFrame([(1, 2, "editor"), (1, 2, "viewer")], "project_id long, user_id long, role string")
    for df in (I.backfill_roles(events, members), I.stamp_roles(events, members)):
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.idempotency_key: r.role_snapshot for r in df.collect()} == {"a": ["editor", "viewer"], "b": None}


def test_runs_without_evaluations_are_counted_in_tasks_by_number(spark, sf_dir):
    plan = entry.queries()["eval_runs_anti"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "distinct" not in plan


def test_parsing_keeps_few_values_a_call(spark):
    rows = spark.createDataFrame([("a", 0, "https://x/proxy", None, "{}")], "call_id string, seq long, endpoint string, provider string, payload string")
    plan = parse_bodies(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_") <= 12


def test_derived_raw_bodies_are_not_shuffled(spark, sf_dir):
    raw = jobs_plans.raw_bodies(Store(spark, sf_dir))
    assert "Exchange" not in raw._jdf.queryExecution().executedPlan().toString()
    assert raw.count() == raw.select("call_id").distinct().count() > 0


def test_calls_told_by_bodies_take_counts_from_all_their_events(spark):
    events = [
        ("open", 2, '{"usage":{"prompt_tokens":9,"completion_tokens":7}}'),
        ("open", 0, '{"usage":{"prompt_tokens":5,"prompt_tokens_details":{"cached_tokens":0}}}'),
        ("open", 1, '{"usage":{"completion_tokens":6,"prompt_tokens_details":{"cached_tokens":2}}}'),
        ("google", 0, '{"usageMetadata":{"promptTokenCount":4,"candidatesTokenCount":3,"thoughtsTokenCount":2}}'),
        ("google", 1, '{"usageMetadata":{"candidatesTokenCount":8,"thoughtsTokenCount":1}}'),
        ("none", 0, "{}"),
    ]
    rows = spark.createDataFrame([(c, s, "https://x/proxy", None, p) for c, s, p in events], "call_id string, seq long, endpoint string, provider string, payload string")
    out = {r.call_id: (r.dialect, r.input_tokens, r.output_tokens, r.cache_read_tokens, r.reasoning_tokens) for r in parse_bodies(rows).collect()}
    assert out == {"open": ("openai.chat", 5, 7, 2, 0), "google": ("google.generate_content", 4, 9, 0, 2), "none": (None, None, None, 0, 0)}


def test_a_task_of_the_reservations_join_has_one_state_store(spark, sf_dir, tmp_path):
    S.state_on_disk(spark)
    calls = S.open_reservations(*streams.calls_as_streams(Store(spark, sf_dir), str(tmp_path)))
    calls.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/rows").awaitTermination()
    assert (tmp_path / "checkpoint/state/0/0").is_dir() and not list((tmp_path / "checkpoint/state/0/0").glob("*keyToNumValues*"))


def test_a_bodys_shape_is_told_by_its_whole_text(spark):
    """What tells a shape may lie behind any length of content, and a line that tells a stream of lines may have any length."""
    long = "words of an answer " * 1000
    usage = '"usage":{"prompt_tokens":100,"completion_tokens":7}'
    parsed = spark.createDataFrame([("a", 0, "https://x/proxy", None, f'{{"content":"{long}",{usage}}}'), ("b", 0, "https://x/v1/messages", "azure_open_ai", f'{{"content":"{long}",{usage}}}')], "call_id string, seq long, endpoint string, provider string, payload string")
    raw = spark.createDataFrame([("c", "https://x/proxy", None, None, f'{{"content":"{long}"}}\n{{{usage}}}'), ("d", "https://x/proxy", None, None, "\n" * 9000 + f"data: {{{usage}}}\n\n")], "call_id string, endpoint string, provider string, content_type string, body string")
    framed = frame_bodies(raw)
    assert [(r.call_id, r.n) for r in framed.groupBy("call_id").agg(F.count("*").alias("n")).orderBy("call_id").collect()] == [("c", 2), ("d", 1)]
    out = {r.call_id: (r.dialect, r.input_tokens, r.output_tokens) for r in parse_bodies(parsed.unionByName(framed.where("call_id = 'd'").select(*parsed.columns))).collect()}
    assert out == {"a": ("openai.chat", 100, 7), "b": ("azure.chat", 100, 7), "d": ("openai.chat", 100, 7)}


def test_what_lands_is_priced_and_has_roles(spark, tmp_path):
    """A model call without a cost source is priced, one with it and a paid tool keep theirs; counters have the priced cost."""
    record = {"ts": "2024-01-01T00:00:00Z", "project_id": 1, "user_id": 2, "event_type": "llm", "model_name": "m", "billable_input_tokens": 10, "output_tokens": 3, "arrival": 1}
    own = [{"idempotency_key": "open"}, {"idempotency_key": "priced", "cost_source": "catalog", "cost_nano_usd": 5}, {"idempotency_key": "tool", "event_type": "tool_cost", "cost_nano_usd": 9, "meta": '{"feature":"f"}'}]
    own += [{"idempotency_key": "unknown", "model_name": "other", "user_id": 3}, {"idempotency_key": "old", "cost_source": "catalog", "role_snapshot": ["owner"]}]
    spark.createDataFrame([(json.dumps(record | o),) for o in own], "value string").coalesce(1).write.text(str(tmp_path / "queue"))
    prices = spark.createDataFrame([("m", 10, 30, None, None)], "model_name string, input_rate long, output_rate long, cache_read_rate long, cache_creation_rate long")
    members = spark.createDataFrame([(1, 2, "viewer"), (1, 2, "editor")], "project_id long, user_id long, role string")
    S.ingest(spark, S.read_queue(spark, str(tmp_path / "queue")), str(tmp_path / "log"), str(tmp_path / "c"), {"availableNow": True}, prices=prices, members=members).awaitTermination()
    got = {r.idempotency_key: (r.cost_nano_usd, r.input_cost_nano_usd, r.cost_source, r.role_snapshot) for r in S.read_landed(spark, str(tmp_path / "log")).collect()}
    roles = ["editor", "viewer"]
    assert got == {"open": (190, 100, "catalog", roles), "priced": (5, 0, "catalog", roles), "tool": (9, 0, None, roles), "unknown": (0, 0, "unpriced", None), "old": (0, 0, "catalog", ["owner"])}
    counted = {(r.user_id, r.model_name): r.cost_nano_usd for r in S.read_counters(spark, str(tmp_path / "log")).collect()}
    assert counted == {(0, ""): 195, (2, ""): 195, (3, ""): 0, (0, "f"): 9, (2, "f"): 9}


def test_a_batch_of_events_moves_once(spark, tmp_path, monkeypatch):
    """Events are dealt once for replays in the batch, replays of earlier ones and the write by month; a queue that was read goes."""
    record = '{"ts":"%s","idempotency_key":"%s","project_id":1,"user_id":2,"event_type":"llm","arrival":%d}'
    lines = [record % (f"2024-0{1 + k % 3}-01T00:00:00Z", f"k{k}", 1) for k in range(30)]
    for again in (lines[:20] + lines[:3], lines[10:]):
        spark.createDataFrame([(x,) for x in again], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "queue"))
    plans, real = [], S.CommitLog.write

    def look(log, df, table, *more):
        if table == "events":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(log, df, table, *more)

    monkeypatch.setattr(S.CommitLog, "write", look)
    S.ingest(spark, S.read_queue(spark, str(tmp_path / "queue"), 1), str(tmp_path / "log"), str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    assert sorted(r.idempotency_key for r in S.read_landed(spark, str(tmp_path / "log")).collect()) == sorted(f"k{k}" for k in range(30))
    moved = [p.count("Exchange") - p.count("BroadcastExchange") for p in plans]
    assert moved == [1, 2], plans  # the second batch's keys move too
