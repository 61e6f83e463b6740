"""Records and messages: conversations as prompts, derived action texts and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import actions as A
from tidemill.functions import records as R
from tidemill.functions import text as X
from tidemill.operators.examples import examples
from tidemill.plans.registry import query


def prompts(tables):
    """One row per conversation: its messages in turn order (a conversation is bounded by its turns)."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    turns = F.array_sort(F.collect_list(turn))
    return tables("conversations").groupBy("conv_id").agg(F.transform(turns, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("prompt"))


@query("SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_message(spark, tables):
    return prompts(tables).select("conv_id", R.last_user(F.col("prompt")).alias("content")).where("content is not null")


@query("SELECT conv_id, arg_min(text, turn) AS content FROM conversations WHERE role = 'user' GROUP BY 1")
def first_user_message(spark, tables):
    users = F.filter("prompt", lambda m: m["role"] == "user")
    return prompts(tables).select("conv_id", F.get(users, F.lit(0))["content"].alias("content")).where("content is not null")


@query("SELECT conv_id, turn, 'system' AS role0, 'You are bounded.' AS content0, 'user' AS role1, text AS content1, 'assistant' AS answer_role, substr(text, 1, 20) AS answer FROM conversations WHERE role = 'user'")
def chat_records(spark, tables):
    users = tables("conversations").where("role = 'user'")
    made = R.chat_record(users, F.lit("You are bounded."), F.col("text"), F.substring("text", 1, 20))
    m = lambda i: F.get("prompt", F.lit(i))
    done = F.get("completion", F.lit(0))
    return made.select("conv_id", "turn", m(0)["role"].alias("role0"), m(0)["content"].alias("content0"), m(1)["role"].alias("role1"), m(1)["content"].alias("content1"), done["role"].alias("answer_role"), done["content"].alias("answer"))


@query("SELECT conv_id, count(*) AS messages, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS system_first, arg_max(text, turn) FILTER (WHERE role = 'user') || ' [r=3]' AS last_user FROM conversations GROUP BY 1 HAVING arg_min(role, turn) = 'system' AND count(*) FILTER (WHERE role = 'user') > 0")
def prompt_rewrite(spark, tables):
    ok = prompts(tables).where((F.get("prompt", F.lit(0))["role"] == "system") & F.exists("prompt", lambda m: m["role"] == "user"))
    changed = ok.withColumn("prompt", R.inject_last_user(R.with_system(F.col("prompt"), F.lit("new rules")), lambda c: F.concat(c, F.lit(" [r=3]"))))
    first = F.get("prompt", F.lit(0))
    return changed.select("conv_id", F.size("prompt").cast("long").alias("messages"), (first["content"] == "new rules").cast("int").alias("system_first"), R.last_user(F.col("prompt")).alias("last_user"))


_BEFORE = "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query(
    f"WITH m AS (SELECT conv_id, turn, role, text, list(role || ': ' || text) OVER {_BEFORE} AS held FROM conversations)"
    " SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, len(coalesce(held, [])) AS n_context, array_to_string(coalesce(held, []), chr(10)) AS context, text AS answer FROM m WHERE role = 'assistant'"
)
def conversation_examples(spark, tables):
    """One row for each answer of a conversation with the three messages before it, by a table function."""
    return examples(tables("conversations"), 3)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_field(spark, tables):
    return tables("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


_SPACES = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT conv_id, turn, CASE WHEN {_SPACES} <> '' THEN substr({_SPACES}, 1, 160) END AS message FROM (SELECT conv_id, turn, '  ' || text || chr(10) AS text FROM conversations)")
def message_normalize(spark, tables):
    c = tables("conversations").withColumn("text", F.concat(F.lit("  "), "text", F.lit("\n")))
    return c.select("conv_id", "turn", X.normal_message(F.col("text")).alias("message"))


#: Messages that name a coordinate in several ways, and some that name none.
_MESSAGE = "CASE event_id % 5 WHEN 0 THEN 'food at [' || event_id % 24 || ',' || user_id % 24 || ']' WHEN 1 THEN 'saw FOOD AT [ ' || event_id % 24 || ' , ' || user_id % 24 || ' ] there' WHEN 2 THEN 'food at [' || event_id % 24 || ',]' WHEN 3 THEN 'food? energy? here' ELSE 'food at [1,2] and food at [' || event_id % 24 || ',3]' END"


def messages(tables):
    e, u = (F.col("event_id") % 24).cast("string"), (F.col("user_id") % 24).cast("string")
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("food at ["), e, F.lit(","), u, F.lit("]")))
        .when(k == 1, F.concat(F.lit("saw FOOD AT [ "), e, F.lit(" , "), u, F.lit(" ] there")))
        .when(k == 2, F.concat(F.lit("food at ["), e, F.lit(",]")))
        .when(k == 3, F.lit("food? energy? here"))
        .otherwise(F.concat(F.lit("food at [1,2] and food at ["), e, F.lit(",3]")))
    )
    return tables("events").select("event_id", text.alias("message"))


_RE = "'(?i)food at \\[\\s*(-?\\d+)\\s*,\\s*(-?\\d+)\\s*\\]'"


@query(f"SELECT event_id, TRY_CAST(regexp_extract(m, {_RE}, 1) AS INT) AS x, TRY_CAST(regexp_extract(m, {_RE}, 2) AS INT) AS y FROM (SELECT event_id, {_MESSAGE} AS m FROM events)")
def coordinate_regex(spark, tables):
    return messages(tables).withColumn("c", X.coordinate(F.col("message"))).select("event_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


_STRICT = "'^food at \\[\\s*([+-]?\\d+)\\s*,\\s*([+-]?\\d+)\\s*\\]$'"


@query(f"SELECT event_id, TRY_CAST(regexp_extract(m, {_STRICT}, 1) AS INT) AS x, TRY_CAST(regexp_extract(m, {_STRICT}, 2) AS INT) AS y FROM (SELECT event_id, {_MESSAGE} AS m FROM events)")
def coordinate_strict(spark, tables):
    return messages(tables).withColumn("c", X.strict_coordinate(F.col("message"))).select("event_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"))


@query(
    f"SELECT event_id, CASE WHEN regexp_extract(m, {_RE}, 1) = '' THEN 'corrupted: ' || m ELSE regexp_replace(m, {_RE}, 'food at [' || (CAST(regexp_extract(m, {_RE}, 1) AS INT) + 12) % 24 || ',' || (CAST(regexp_extract(m, {_RE}, 2) AS INT) + 12) % 24 || ']') END AS message"
    f" FROM (SELECT event_id, {_MESSAGE} AS m FROM events)"
)
def coordinate_corrupt(spark, tables):
    return messages(tables).select("event_id", X.corrupt(F.col("message"), 24, 24).alias("message"))


_OUTPUT = "CASE event_id % 6 WHEN 0 THEN '{\"action\":\"rest\"}' WHEN 1 THEN 'Action follows: {\"action\":\"rest\"}' WHEN 2 THEN '{\"action\":\"move\",\"target\":[' || event_id % 24 || ',2]}' WHEN 3 THEN '{\"action\":\"rest\"}' || chr(10) || 'user' || chr(10) || '{\"another\":\"turn\"}' WHEN 4 THEN '{\"action\":\"share\",\"target\":\"other\",\"amount\":0}' ELSE '{\"action\":\"signal\",\"message\":\" food at [1,2] \"}' END"


def outputs(tables):
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, '{"action":"rest"}')
        .when(k == 1, 'Action follows: {"action":"rest"}')
        .when(k == 2, F.concat(F.lit('{"action":"move","target":['), (F.col("event_id") % 24).cast("string"), F.lit(",2]}")))
        .when(k == 3, '{"action":"rest"}\nuser\n{"another":"turn"}')
        .when(k == 4, '{"action":"share","target":"other","amount":0}')
        .otherwise('{"action":"signal","message":" food at [1,2] "}')
    )
    return tables("events").select("event_id", text.alias("raw"))


@query(f"SELECT event_id, CASE WHEN json_valid(m) AND event_id % 6 <> 4 THEN json_extract_string(m, '$.action') END AS action, CASE WHEN event_id % 6 = 2 THEN (event_id % 24)::INT END AS x, CASE WHEN event_id % 6 = 5 THEN 'food at [1,2]' END AS message FROM (SELECT event_id, {_OUTPUT} AS m FROM events)")
def strict_json(spark, tables):
    return outputs(tables).withColumn("a", A.parse_strict(F.col("raw"))).select("event_id", F.col("a.action").alias("action"), F.col("a.x").alias("x"), F.col("a.message").alias("message"))


@query("SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'move' WHEN 4 THEN NULL WHEN 5 THEN 'signal' ELSE 'rest' END AS action, CASE event_id % 6 WHEN 2 THEN '{\"action\":\"move\",\"target\":[' || event_id % 24 || ',2]}' WHEN 4 THEN NULL WHEN 5 THEN '{\"action\":\"signal\",\"message\":\"food at [1,2]\"}' ELSE '{\"action\":\"rest\"}' END AS canonical FROM events")
def lenient_json(spark, tables):
    done = outputs(tables).withColumn("a", A.parse_lenient(F.col("raw")))
    return done.select("event_id", F.col("a.action").alias("action"), F.when(F.col("a.action").isNotNull(), A.action_json(F.col("a"))).alias("canonical"))


@query(f"SELECT json_extract_string(m, '$.action') AS action, count(*) AS n FROM (SELECT event_id, {_OUTPUT} AS m FROM events) WHERE event_id % 6 NOT IN (1, 3) GROUP BY 1")
def completion_kinds(spark, tables):
    done = outputs(tables).where("event_id % 6 not in (1, 3)").select(F.array(R.message("assistant", F.col("raw"))).alias("completion"))
    return done.groupBy(R.action_kind(F.col("completion")).alias("action")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'mined' WHEN event_type IN ('click', 'view') THEN 'paired' END AS source FROM events WHERE (event_type = 'error' AND event_id % 2 = 0) OR event_type IN ('click', 'view')")
def hard_negatives(spark, tables):
    """Mining filter and case whitelist; a missing prediction never matches."""
    predicted = F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("signal").alias("action")))
    mined = (F.col("event_type") == "error") & F.coalesce(predicted["action"] == "signal", F.lit(False))
    source = F.when(mined, "mined").when(F.col("event_type").isin("click", "view"), "paired")
    return tables("events").select("event_id", source.alias("source")).where("source is not null")
