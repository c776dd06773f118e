"""Events and dimensions derived from the star-schema tables: an order is a run, a line a call, a customer an actor.

The SQL is plain enough for two engines; TEXT stands for the engine's name of the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WIDE = """
SELECT CONCAT('k-', CAST(ok AS TEXT), '-', CAST(ln AS TEXT)) AS idempotency_key,
  CAST(arrival AS BIGINT) AS arrival,
  od + ln * INTERVAL '1' MINUTE AS ts,
  CAST(nk % 5 + 1 AS BIGINT) AS project_id,
  CAST(ck % 50 AS BIGINT) AS user_id,
  CASE WHEN ck % 50 = 0 OR ck % 7 = 0 THEN NULL WHEN ck % 50 = 49 THEN 'system_user_1@service.invalid'
       ELSE CONCAT('user', CAST(ck % 50 AS TEXT), '@example.com') END AS user_email,
  CASE WHEN ok % 97 = 0 THEN NULL ELSE CONCAT('run-', CAST(ok AS TEXT)) END AS run_id,
  CASE WHEN ok % 4 = 3 THEN NULL WHEN ok % 4 = 2 THEN CONCAT('stream-', CAST(ok AS TEXT))
       ELSE CONCAT('00000000-0000-0000-0000-', LPAD(CAST(ck AS TEXT), 12, '0')) END AS conversation_id,
  CASE WHEN ok % 5 <= 2 THEN 'application' WHEN ok % 5 = 3 THEN 'skill' END AS root_entity_type,
  CASE WHEN ok % 5 <= 3 THEN CAST(ok % 11 + 1 AS BIGINT) END AS root_entity_id,
  CASE WHEN ok % 5 <= 3 THEN CAST(ok % 3 + 1 AS BIGINT) END AS root_entity_version_id,
  CASE WHEN ok % 13 = 0 THEN CAST(1 AS BIGINT) END AS root_entity_project_id,
  CASE WHEN ok % 17 = 0 THEN 'evaluation' WHEN kind = 18 THEN 'skill' WHEN ln = 3 THEN 'application'
       WHEN ok % 5 <= 2 THEN 'application' WHEN ok % 5 = 3 THEN 'skill' END AS entity_type,
  CASE WHEN ok % 17 = 0 THEN CAST(ok % 4 + 500 AS BIGINT) WHEN kind = 18 THEN CAST(pk % 7 + 1 AS BIGINT)
       WHEN ln = 3 THEN CAST(ok % 11 + 51 AS BIGINT) WHEN ok % 5 <= 3 THEN CAST(ok % 11 + 1 AS BIGINT) END AS entity_id,
  CASE WHEN kind = 18 THEN CONCAT('skill ', CAST(pk % 7 + 1 AS TEXT))
       WHEN ok % 5 <= 3 THEN CONCAT('agent ', CAST(ok % 11 + 1 AS TEXT), ' (v', CAST(ok % 3 + 1 AS TEXT), ')') END AS entity_name,
  CASE WHEN kind <= 11 THEN 'llm' WHEN kind <= 17 THEN 'tool' WHEN kind = 18 THEN 'skill' ELSE 'tool_cost' END AS event_type,
  CASE WHEN kind <= 11 THEN CONCAT('model-', CAST(pk % 6 AS TEXT)) WHEN kind = 19 THEN 'tavily/search' END AS model_name,
  CASE WHEN kind BETWEEN 12 AND 17 THEN CONCAT('kit-', CAST(sk % 3 AS TEXT), '__tool_', CAST(pk % 9 AS TEXT)) END AS tool_name,
  CASE WHEN kind <= 11 THEN q * 100 ELSE 0 END AS input_tokens,
  CASE WHEN kind <= 11 THEN q * 60 ELSE 0 END AS billable_input_tokens,
  CASE WHEN kind <= 11 THEN q * 30 ELSE 0 END AS cache_read_tokens,
  CASE WHEN kind <= 11 THEN q * 10 ELSE 0 END AS cache_creation_tokens,
  CASE WHEN kind <= 11 THEN q * 7 ELSE 0 END AS output_tokens,
  CASE WHEN kind <= 11 AND pk % 6 <> 5 AND q % 5 <> 0 THEN price * 4 ELSE 0 END AS input_cost_nano_usd,
  CASE WHEN kind <= 11 AND pk % 6 <> 5 AND q % 5 <> 0 THEN price * 4 ELSE 0 END AS output_cost_nano_usd,
  CASE WHEN kind <= 11 AND pk % 6 <> 5 AND q % 5 <> 0 THEN price * 1 ELSE 0 END AS cache_read_cost_nano_usd,
  CASE WHEN kind <= 11 AND pk % 6 <> 5 AND q % 5 <> 0 THEN price * 1 ELSE 0 END AS cache_creation_cost_nano_usd,
  CASE WHEN kind <= 11 AND ok % 23 = 0 THEN 'unparsed' WHEN kind <= 11 THEN 'provider' END AS token_source,
  CASE WHEN (kind <= 11 AND pk % 6 <> 5 AND q % 5 <> 0) OR kind = 19 THEN price * 10 ELSE 0 END AS cost_nano_usd,
  CASE WHEN pk % 6 = 5 THEN 'unpriced' ELSE 'catalog' END AS cost_source,
  CAST(ln * 250 + pk % 1000 AS INT) AS duration_ms,
  rf = 'R' AND ln % 2 = 0 AS is_error,
  CASE ok % 8 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'chat' WHEN 2 THEN 'api' WHEN 3 THEN 'webhook'
    WHEN 4 THEN 'index' WHEN 5 THEN 'schedule_manual' END AS trigger_source,
  CASE WHEN sk % 10 = 0 THEN TRUE END AS budget_exempt,
  CASE WHEN kind = 19 THEN '{"feature":"web_search","backend":"tavily"}'
       WHEN kind = 18 THEN '{"source":"agent","skill_project_id":"1"}'
       WHEN kind BETWEEN 12 AND 17 AND sk % 2 = 0 THEN '{"toolkit_type":"github"}' END AS meta"""
RAW_EVENTS = (
    _WIDE
    + """
FROM (
  SELECT l.l_orderkey AS ok, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk,
         CAST(FLOOR(l.l_quantity) AS BIGINT) AS q, CAST(FLOOR(l.l_extendedprice) AS BIGINT) AS price,
         l.l_returnflag AS rf, (l.l_orderkey + l.l_linenumber) % 20 AS kind,
         o.o_custkey AS ck, o.o_orderdate AS od, c.c_nationkey AS nk,
         ROW_NUMBER() OVER (PARTITION BY l.l_orderkey, l.l_linenumber
           ORDER BY l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_quantity, l.l_shipdate) AS arrival
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey) AS joined
"""
)

PROJECTS = "(SELECT DISTINCT CAST(n_nationkey % 5 + 1 AS BIGINT) AS project_id FROM nation) AS p"


def _ids(first: int, last: int, name: str = "id") -> str:
    return f"(SELECT DISTINCT CAST(p_partkey AS BIGINT) AS {name} FROM part WHERE p_partkey BETWEEN {first} AND {last}) AS i{first}_{last}"


DIMENSIONS = {
    "applications": f"SELECT project_id, id, CONCAT('app ', CAST(id AS TEXT)) AS name, CASE WHEN id % 4 = 0 THEN 'pipeline' ELSE 'agent' END AS kind FROM {PROJECTS} CROSS JOIN {_ids(1, 61)} WHERE (id BETWEEN 1 AND 10) OR id >= 51",
    "versions": f"SELECT id AS version_id, CONCAT('v', CAST(id AS TEXT)) AS version_name FROM {_ids(1, 3)}",
    "skills": f"SELECT project_id, id, CONCAT('skill ', CAST(id AS TEXT)) AS name, id % 2 = 0 AS is_public FROM {PROJECTS} CROSS JOIN {_ids(1, 11)} WHERE id <> 7",
    "users": f"SELECT id AS user_id, CONCAT('user', CAST(id AS TEXT), '@example.com') AS email FROM {_ids(1, 49)} WHERE id <> 48",
    "members": f"SELECT project_id, id AS user_id, CASE r.role WHEN 0 THEN 'viewer' ELSE 'editor' END AS role FROM {PROJECTS} CROSS JOIN {_ids(1, 49)} CROSS JOIN (SELECT 0 AS role UNION ALL SELECT 1 AS role) AS r WHERE (id + project_id) % 3 <> 0 AND (id % 3 = 2 OR id % 3 = r.role)",
    "super_admins": f"SELECT id AS user_id FROM {_ids(1, 49)} WHERE id % 10 = 0",
    "models": f"SELECT CONCAT('model-', CAST(id - 1 AS TEXT)) AS model_name, s.scope AS scope, CONCAT('Model ', CAST(id - 1 AS TEXT)) AS display_name FROM {_ids(1, 6)} CROSS JOIN (SELECT 'shared' AS scope UNION ALL SELECT 'own' AS scope) AS s WHERE s.scope = 'shared' OR id = 1",
    "prices": f"SELECT CONCAT('model-', CAST(id - 1 AS TEXT)) AS model_name, id * 10 AS input_rate, id * 30 AS output_rate, CASE WHEN id < 5 THEN id * 2 END AS cache_read_rate, CASE WHEN id < 5 THEN id * 12 END AS cache_creation_rate FROM {_ids(1, 5)}",
    "limits": f"SELECT project_id, project_id <> 4 AS enabled, CASE WHEN project_id <> 3 THEN n * (900 + 200 * project_id) END AS project_limit_nano, n * 40 AS member_limit_nano, project_id = 5 AS is_personal FROM {PROJECTS} CROSS JOIN (SELECT COUNT(*) AS n FROM orders) AS o",
    "tool_weights": f"SELECT CONCAT('tool_', CAST(id - 1 AS TEXT)) AS tool, CAST(id % 4 AS BIGINT) AS weight FROM {_ids(1, 8)} UNION ALL SELECT 'github:tool_1' AS tool, CAST(5 AS BIGINT) AS weight FROM {_ids(1, 1)}",
    "conversations": f"SELECT CONCAT('00000000-0000-0000-0000-', LPAD(CAST(c_custkey AS TEXT), 12, '0')) AS uuid, CONCAT('chat ', CAST(c_custkey AS TEXT)) AS chat_name, c_custkey % 3 = 0 AS is_private, CAST(c_custkey % 50 AS BIGINT) AS author_id FROM customer WHERE c_custkey % 19 <> 0",
    "feature_labels": "SELECT 'web_search' AS feature, 'Web search' AS label FROM region WHERE r_regionkey = 0",
}


def sql_for(spark_text: str, string: str) -> str:
    return spark_text.replace("AS TEXT)", f"AS {string})")


def base_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("lineitem", "orders", "customer", "part", "nation", "region")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _run(spark: SparkSession, text: str, sf_dir: str) -> DataFrame:
    for name, df in base_views(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql_for(text, "STRING"))


#: So many lines are a task's share of the join; tables of any size are dealt over as many tasks as that takes.
LINES_A_TASK = 100_000


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that an event is made of, replays included, as RAW_EVENTS joins them; with ts.

    Rows move by order key once, and as a dozen numbers: an order's lines and replays then lie in one task.
    """
    t = base_views(spark, sf_dir, ("lineitem", "orders", "customer"))
    owners = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), F.col("o_orderdate").alias("od"), F.col("c_nationkey").alias("nk"))
    own = {"ok": "l_orderkey", "ln": "l_linenumber", "pk": "l_partkey", "sk": "l_suppkey", "rf": "l_returnflag"}
    order = ["l_extendedprice", "l_quantity", "l_shipdate"]
    lines = t["lineitem"].select(*[F.col(c).alias(n) for n, c in own.items()], *order)
    rows = lines.repartition(lines.count() // LINES_A_TASK + 1, "ok").join(owners, "ok")
    rows = rows.withColumn("arrival", F.row_number().over(Window.partitionBy("ok", "ln").orderBy("pk", "sk", *order)))
    whole = {"q": "l_quantity", "price": "l_extendedprice"}
    rows = rows.select(*own, *[F.floor(c).cast("long").alias(n) for n, c in whole.items()], "ck", "od", "nk", "arrival")
    return rows.withColumn("kind", F.expr("(ok + ln) % 20")).withColumn("ts", F.expr("CAST(od + ln * INTERVAL '1' MINUTE AS TIMESTAMP)"))


def widened(rows: DataFrame, *keep: str) -> DataFrame:
    """Arrivals as events; keep: further columns that stay."""
    rows.createOrReplaceTempView("joined")
    out = rows.sparkSession.sql(sql_for(", ".join([_WIDE, *keep]) + " FROM joined", "STRING"))
    return out.withColumn("ts", out.ts.cast("timestamp"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive, replays included; arrival numbers those of one key."""
    return widened(arrivals(spark, sf_dir))


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _run(spark, DIMENSIONS[name], sf_dir)
