"""Queries over question intent, application tables, dashboards and live events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import once
from ..functions.stage import shared_dir
from ..operators import dashboard as db, intent as nl, quality as q, stats as st
from ..sources.sinks import BaselineStore
from ..streaming import feed, intake, quota, stateful
from .common import big, joined, r, rounded, table, unions

QUERIES, SQL = {}, {}

# ---------------------------------------------------------------- questions
# Every event asks one of six questions; conversations are taken as they are.
_ASK = """CASE event_id % 6 WHEN 0 THEN concat('Give me a summary of the average VALUE by event_type ', event_type)
    WHEN 1 THEN concat('Why does user_id influence value? Which cause and impact, event ', event_id)
    WHEN 2 THEN 'Predict the future trend of value' WHEN 3 THEN 'Should we maximize value? recommend the best strategy'
    WHEN 4 THEN concat('hello ', event_type) ELSE 'forecast and optimize: minimize value for user_id with ts' END"""
_ask = lambda s, d: table(s, d, "events").select("event_id", F.expr(_ASK).alias("question"))
_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_hits = lambda words, c="t": " + ".join(f"(CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END)" for w in words)
_WORDS = "len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> ''))"


def _intent_sql(source, key, text) -> str:
    cols = ", ".join(f"{_hits(w)} AS s{i}" for i, w in enumerate(nl.KEYWORDS.values()))
    return f"""WITH v AS (SELECT {key}, lower({text}) AS t FROM {source}), s AS (SELECT *, {cols} FROM v),
      g AS (SELECT *, greatest(s0, s1, s2, s3) AS hits FROM s)
      SELECT {key}, CASE hits WHEN s0 THEN 'descriptive' WHEN s1 THEN 'diagnostic' WHEN s2 THEN 'predictive' ELSE 'prescriptive' END
        AS analysis_type, hits, CASE WHEN hits > 0 THEN {r(f"hits / {_WORDS}")} ELSE 0.3::DOUBLE END AS confidence,
        CASE WHEN contains(t, 'maximize') OR contains(t, 'increase') THEN 'maximize' WHEN contains(t, 'minimize') THEN 'minimize' END
        AS objective FROM g"""


QUERIES["nl_intent"] = lambda s, d: rounded(nl.classify_questions(_ask(s, d), "question").drop("question"))
SQL["nl_intent"] = _intent_sql(f"(SELECT event_id, {_ASK} AS question FROM events)", "event_id", "question")
QUERIES["nl_intent_talk"] = lambda s, d: rounded(nl.classify_questions(
    table(s, d, "conversations").filter("role = 'user'"), "text").drop("text", "role"))
SQL["nl_intent_talk"] = _intent_sql("(SELECT * FROM conversations WHERE role = 'user')", "conv_id, turn", "text")
QUERIES["nl_columns"] = lambda s, d: joined(nl.column_mentions(_ask(s, d), "question", _EVENT_COLUMNS).drop("question"),
                                            "feature_columns")
_FOUND = "list_filter([" + ", ".join(f"'{c}'" for c in _EVENT_COLUMNS) + "], lambda c: contains(t, c))"
SQL["nl_columns"] = f"""SELECT event_id, m[1] AS target_column, CASE WHEN len(m) > 1 THEN array_to_string(m[2:], ',') END
    AS feature_columns FROM (SELECT event_id, {_FOUND} AS m FROM (SELECT event_id, lower({_ASK}) AS t FROM events) v) w"""


def _profiled(s, d) -> DataFrame:
    events = table(s, d, "events")
    return nl.classify_with_profile(_ask(s, d), "question", events.count(), True)


_PROFILED = f"""WITH v AS (SELECT event_id, lower({_ASK}) AS t FROM events), n AS (SELECT count(*) AS n FROM events),
    s AS (SELECT event_id, {_hits(nl.PROFILE_KEYWORDS["descriptive"])} + CASE WHEN n < 100 THEN 2 ELSE 0 END AS s0,
      {_hits(nl.PROFILE_KEYWORDS["diagnostic"])} AS s1,
      {_hits(nl.PROFILE_KEYWORDS["predictive"])} + CASE WHEN n > 1000 THEN 1 ELSE 0 END + 1 AS s2,
      {_hits(nl.PROFILE_KEYWORDS["prescriptive"])} AS s3 FROM v, n), g AS (SELECT *, greatest(s0, s1, s2, s3) AS score FROM s),
    c AS (SELECT event_id, CASE score WHEN s0 THEN 'descriptive' WHEN s1 THEN 'diagnostic' WHEN s2 THEN 'predictive'
      ELSE 'prescriptive' END AS analysis_type, score, score / greatest(s0 + s1 + s2 + s3, 1) AS confidence FROM g)"""
QUERIES["nl_intent_profile"] = lambda s, d: rounded(_profiled(s, d).drop("question"))
SQL["nl_intent_profile"] = _PROFILED + f" SELECT event_id, analysis_type, score, {r('confidence')} AS confidence FROM c"
QUERIES["nl_suggestions"] = lambda s, d: joined(nl.suggestions(_profiled(s, d).select("event_id", "analysis_type"), 65.0),
                                                "methods", "visualizations", "next_steps")
_case = lambda f: "CASE analysis_type " + " ".join(f"WHEN '{t}' THEN '{f(t)}'" for t in nl.TYPES) + " END"
SQL["nl_suggestions"] = _PROFILED + f""" SELECT event_id, analysis_type, {_case(lambda t: ",".join(nl.METHODS[t][0]))} AS methods,
    {_case(lambda t: ",".join(nl.METHODS[t][1]))} AS visualizations, {_case(lambda t: nl.METHODS[t][2])} AS focus,
    {_case(lambda t: ",".join([nl.CLEAN_FIRST, *nl.NEXT_STEPS[t]]))} AS next_steps FROM c"""

_REPLY = """CASE event_id % 5 WHEN 0 THEN concat('Sure: {"analysis_type": "predictive", "target_column": "value", "feature_columns": ["user_id"], "confidence": 0.', event_id % 10, '} ok')
    WHEN 1 THEN '{"analysis_type": "magic", "target_column": "value", "confidence": 0.5}'
    WHEN 2 THEN '{"analysis_type": "diagnostic", "target_column": "nope", "confidence": 0.5}'
    WHEN 3 THEN '{"analysis_type": "diagnostic", "target_column": null, "confidence": 0.5, "feature_columns": ["ts", "oops"]}'
    ELSE 'no reply at all' END"""
QUERIES["nl_replies"] = lambda s, d: joined(nl.parse_replies(
    table(s, d, "events").select("event_id", F.expr(_REPLY).alias("reply")), "reply", _EVENT_COLUMNS).drop("reply", "objective"),
    "feature_columns")
SQL["nl_replies"] = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'predictive' WHEN 1 THEN 'magic' WHEN 4 THEN NULL ELSE 'diagnostic' END
    AS analysis_type, CASE event_id % 5 WHEN 2 THEN 'nope' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'value' END AS target_column,
    CASE event_id % 5 WHEN 0 THEN 'user_id' WHEN 3 THEN 'ts,oops' END AS feature_columns,
    CASE event_id % 5 WHEN 0 THEN (event_id % 10) / 10.0::DOUBLE WHEN 4 THEN NULL ELSE 0.5::DOUBLE END AS confidence,
    event_id % 5 = 0 AS valid FROM events"""


def _answered(s, d, kind) -> DataFrame:
    df = table(s, d, "part")
    if kind == "descriptive":
        return nl.answer(kind, nl.execute_intent(df, {"analysis_type": kind}), s)
    pairs = st.pearson_matrix(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return nl.answer(kind, {"strong": st.strong_correlations(pairs)}, s)


QUERIES["nl_answer"] = lambda s, d: _answered(s, d, "descriptive").unionAll(_answered(s, d, "diagnostic"))
SQL["nl_answer"] = """SELECT printf('Your dataset has %d rows and %d columns. It contains %d numeric and %d categorical features with %d missing values.',
      count(*), 6, 3, 3, 0) AS answer FROM part
    UNION ALL SELECT CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.5 THEN
      printf('Found strong correlation between l_quantity and l_extendedprice (correlation: %.3f). This suggests these variables are closely related.',
      corr(l_quantity, l_extendedprice)) ELSE 'Analysis completed. Please check the detailed results for specific insights.' END FROM lineitem"""
QUERIES["nl_context"] = lambda s, d: joined(nl.dataset_context(table(s, d, "events"))["shape"], "numeric_columns", "categorical_columns")
SQL["nl_context"] = """SELECT count(*) AS rows, 6 AS columns, 'event_id,user_id,value' AS numeric_columns, 'event_type,props' AS categorical_columns,
    0::BIGINT AS missing FROM events"""

# ---------------------------------------------------------------- application tables, played by the events
_of = lambda s, d, kind: table(s, d, "events").filter(F.col("event_type") == kind)
_USERS = "SELECT DISTINCT user_id FROM events"


def _people(s, d) -> DataFrame:
    u = table(s, d, "events").select("user_id").distinct()
    return u.select("user_id", F.when(F.col("user_id") % 50 == 0, "admin").otherwise("user").alias("role"),
                    F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Name "), "user_id")).alias("name"),
                    F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("u"), "user_id", F.lit("@example.com"))).alias("email"))


QUERIES["db_user_summary"] = lambda s, d: db.user_summary(_of(s, d, "view"), _of(s, d, "click"), _of(s, d, "error"), time="ts")["stats"]
SQL["db_user_summary"] = """SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS total_datasets,
    count(CASE WHEN event_type = 'click' THEN 1 END) AS total_analyses,
    count(CASE WHEN event_type = 'error' THEN 1 END) AS total_queries FROM events
    WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id"""
QUERIES["db_user_recent"] = lambda s, d: db.user_summary(
    _of(s, d, "view"), _of(s, d, "click"), _of(s, d, "error"), time="ts", tie="event_id")["recent_analyses"].select("user_id", "event_id", "rank")
SQL["db_user_recent"] = """SELECT user_id, event_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click') t WHERE k <= 5"""
QUERIES["db_latest_n"] = lambda s, d: db.latest(table(s, d, "events"), "user_id", "ts", 5, "event_id").select("user_id", "event_id", "rank")
SQL["db_latest_n"] = """SELECT user_id, event_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS k FROM events) t WHERE k <= 5"""
_system = lambda s, d: db.system_summary(_people(s, d), _of(s, d, "view"), _of(s, d, "click"), table(s, d, "events"), "ts", "event_id")
QUERIES["db_system_totals"] = lambda s, d: _system(s, d)["totals"]
SQL["db_system_totals"] = """SELECT count(DISTINCT user_id) AS total_users, count(CASE WHEN event_type = 'view' THEN 1 END) AS total_datasets,
    count(CASE WHEN event_type = 'click' THEN 1 END) AS total_analyses FROM events"""
QUERIES["db_system_activity"] = lambda s, d: _system(s, d)["activity"]
SQL["db_system_activity"] = "SELECT user_id, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) t GROUP BY 1"
QUERIES["db_activity_rank"] = lambda s, d: db.activity_ranking(
    table(s, d, "events"), _people(s, d), "user_id", "user_id", F.coalesce("name", "email"))
SQL["db_activity_rank"] = """SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'Name ' || user_id WHEN 1 THEN 'u' || user_id || '@example.com'
    ELSE 'Unknown User' END AS user_name, count(*) AS n FROM events GROUP BY user_id"""
_scope = lambda user: lambda s, d: db.tenant_scope(table(s, d, "events"), user, _people(s, d)).select("event_id", "user_id")
QUERIES["db_tenant_scope"] = _scope(8)
SQL["db_tenant_scope"] = "SELECT event_id, user_id FROM events WHERE user_id = 8"
QUERIES["db_tenant_scope_admin"] = _scope(0)
SQL["db_tenant_scope_admin"] = "SELECT event_id, user_id FROM events"
QUERIES["db_check_values"] = lambda s, d: db.check_allowed(table(s, d, "orders"), {
    "o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})
SQL["db_check_values"] = """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 2"""
QUERIES["db_latest_result"] = lambda s, d: db.latest_result(
    table(s, d, "orders"), table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "o_orderkey", "o_orderpriority")
SQL["db_latest_result"] = """SELECT c_custkey AS o_custkey, coalesce(p, '{"summary": "No analysis available"}') AS o_orderpriority FROM customer
    LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) r ON c_custkey = o_custkey"""

QUERIES["db_monthly_target"] = lambda s, d: rounded(db.monthly_target(table(s, d, "orders"), "o_orderdate", "o_totalprice"), 2)
SQL["db_monthly_target"] = f"""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS sales FROM orders GROUP BY 1)
    SELECT month::TIMESTAMP AS month, {r("sales", 2)} AS sales, {r("(SELECT arg_min(sales, month) FROM m) * pow(1.02, date_diff('month', (SELECT min(month) FROM m), month))", 2)}
    AS target FROM m"""
QUERIES["db_share"] = lambda s, d: db.market_share(table(s, d, "part").withColumn("cents", (F.col("p_retailprice") * 100).cast("long")),
                                                   "p_brand", "cents", 5)
SQL["db_share"] = """WITH b AS (SELECT p_brand AS name, sum(CAST(trunc(p_retailprice * 100) AS BIGINT)) AS value FROM part GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY value DESC, name) AS i FROM b),
    g AS (SELECT CASE WHEN i <= 5 THEN name ELSE 'Others' END AS name, CAST(sum(value) AS BIGINT) AS value FROM k GROUP BY 1)
    SELECT name, value, ROUND(value * 100.0::DOUBLE / (SELECT sum(value) FROM g), 1) AS percentage FROM g"""
QUERIES["db_pie"] = lambda s, d: db.pie_share(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "n").drop("share_raw")
SQL["db_pie"] = """SELECT event_type, count(*) AS n, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5) AS BIGINT) AS share_label
    FROM events GROUP BY 1"""
QUERIES["db_weekly_users"] = lambda s, d: db.weekly_users(table(s, d, "events"), "ts", "user_id")
SQL["db_weekly_users"] = """WITH s AS (SELECT DISTINCT date_trunc('week', ts)::TIMESTAMP AS week, user_id FROM events),
    f AS (SELECT user_id, min(week) AS week FROM s GROUP BY 1)
    SELECT week, count(*) AS active_users, (SELECT count(*) FROM f WHERE f.week = s.week) AS new_users FROM s GROUP BY week"""
QUERIES["db_quarterly"] = lambda s, d: rounded(db.quarterly_growth(table(s, d, "orders"), "o_orderdate", "o_totalprice"), 2)
SQL["db_quarterly"] = f"""WITH q AS (SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT quarter, {r("v", 2)} AS revenue, {r("(v - first(v) OVER (ORDER BY quarter)) / first(v) OVER (ORDER BY quarter) * 100", 2)} AS growth FROM q"""
QUERIES["db_date_filter"] = lambda s, d: db.dashboard_filter(
    table(s, d, "events"), "ts", "7d", {"event_type": "click", "user_id": "all"}).select("event_id", "ts")
SQL["db_date_filter"] = """SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"""

# ---------------------------------------------------------------- live events
_PAYLOAD = """CASE event_id % 9
    WHEN 0 THEN concat('{"timestamp": "2024-01-0', 1 + event_id % 9, 'T10:00:00Z", "source": " <b>', event_type, '</b> ", "metrics": {"v": ', event_id, ', "w": "x", "z": null, "q": 4}}')
    WHEN 1 THEN '{"source": "a", "metrics": {"v": 1}}' WHEN 2 THEN '{"timestamp": "soon", "source": "a", "metrics": {"v": 1}}'
    WHEN 3 THEN concat('{"timestamp": "2024-02-01", "source": "', repeat('x', 101), '", "metrics": {"v": 1}}')
    WHEN 4 THEN '{"timestamp": "2024-02-01", "source": "a", "metrics": 5}' WHEN 5 THEN '{"timestamp": "", "source": 7, "metrics": []}'
    WHEN 6 THEN concat('{"timestamp": "2024-02-01", "source": "a", "metrics": {"v": "', repeat('y', 100000), '"}}')
    WHEN 7 THEN 'not json' ELSE '{"timestamp": 1704103200000, "source": "a", "metrics": [1]}' END"""
_payloads = lambda s, d: once(table(s, d, "events").select("event_id", "user_id", "event_type"), "body", F.expr(_PAYLOAD)).drop("event_type")
QUERIES["ss_validate"] = lambda s, d: intake.validate(_payloads(s, d)).select(
    "event_id", F.array_join("errors", "; ").alias("errors"), "valid")
SQL["ss_validate"] = f"""SELECT event_id, CASE event_id % 9 WHEN 1 THEN '{intake.ERRORS["timestamp"]}' WHEN 2 THEN '{intake.ERRORS["time"]}'
    WHEN 3 THEN '{intake.ERRORS["text"]}' WHEN 4 THEN '{intake.ERRORS["object"]}'
    WHEN 5 THEN '{intake.ERRORS["timestamp"]}; {intake.ERRORS["text"]}' WHEN 6 THEN '{intake.ERRORS["size"]}'
    WHEN 7 THEN '{intake.NOT_JSON}' ELSE '' END AS errors, event_id % 9 IN (0, 8) AS valid FROM events"""
QUERIES["ss_sanitise"] = lambda s, d: table(s, d, "pages").select(
    "page_id", intake.sanitize_source(F.col("html")).alias("clean"))
SQL["ss_sanitise"] = "SELECT page_id, replace(replace(trim(html, E' \\n\\t\\r'), '<', ''), '>', '') AS clean FROM pages"
_KEY = "concat('sk_', substring(concat('00000000000000000000000000000000', c_custkey), -32, 32), CASE WHEN c_custkey % 10 = 0 THEN '!' ELSE '' END)"
_DUCK_KEY = "'sk_' || right('00000000000000000000000000000000' || c_custkey, 32) || CASE WHEN c_custkey % 10 = 0 THEN '!' ELSE '' END"
_keys = lambda s, d: table(s, d, "customer").select("c_custkey", F.expr(_KEY).alias("api_key"))
QUERIES["ss_key_hash"] = lambda s, d: _keys(s, d).select(
    "c_custkey", intake.valid_key(F.col("api_key")).alias("valid"), intake.key_hash(F.col("api_key")).alias("hash"))
SQL["ss_key_hash"] = f"SELECT c_custkey, c_custkey % 10 <> 0 AS valid, sha256({_DUCK_KEY}) AS hash FROM customer"
_registry = lambda s, d: table(s, d, "customer").select(
    intake.key_hash(F.expr(_KEY)).alias("key_hash"), F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4 != 0).alias("is_active"))
_sent = lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderdate", intake.key_hash(
    F.expr(_KEY.replace("c_custkey", "o_custkey"))).alias("key_hash"))
QUERIES["ss_lookup"] = lambda s, d: intake.attach_user(_sent(s, d), _registry(s, d)).select("o_orderkey", "user_id")
SQL["ss_lookup"] = "SELECT o_orderkey, o_custkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 4 <> 0"
QUERIES["ss_last_used"] = lambda s, d: intake.last_used(table(s, d, "orders"), "o_custkey", "o_orderdate")
SQL["ss_last_used"] = "SELECT o_custkey, max(o_orderdate) AS last_used_at FROM orders GROUP BY 1"
QUERIES["ss_event_rows"] = lambda s, d: intake.event_rows(intake.validate(_payloads(s, d)).filter("valid")).select(
    F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "source", "user_id")
SQL["ss_event_rows"] = """SELECT CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' ELSE TIMESTAMP '2024-01-01 10:00:00' END AS "timestamp",
    CASE WHEN event_id % 9 = 0 THEN 'b' || event_type || '/b' ELSE 'a' END AS source, user_id FROM events WHERE event_id % 9 IN (0, 8)"""
QUERIES["ss_latest20"] = lambda s, d: feed.latest_events(table(s, d, "events"), time="ts", tie="event_id").select("user_id", "event_id")
SQL["ss_latest20"] = """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
    FROM events) t WHERE k <= 20"""
QUERIES["ss_user_changes"] = lambda s, d: feed.user_changes(table(s, d, "events"), 8).select("event_id")
SQL["ss_user_changes"] = "SELECT event_id FROM events WHERE user_id = 8"
QUERIES["ss_first_entries"] = lambda s, d: table(s, d, "events").select("event_id", F.array_join(F.transform(intake.first_entries(
    F.expr("concat('{\"e\": ', event_id, ', \"t\": \"', event_type, '\", \"n\": null, \"z\": 1}')")),
    lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("entries"))
SQL["ss_first_entries"] = "SELECT event_id, 'e:' || event_id || ',t:' || event_type || ',n' AS entries FROM events"


# SS-4: ten requests a second over three keys
def _requests(s, d) -> DataFrame:
    return table(s, d, "events").select((F.col("user_id") % 3).alias("k"), F.timestamp_millis(F.col("event_id") * 100 + 1704067200000).alias("t"), "event_id")


QUERIES["ss_quota"] = lambda s, d: quota.apply_quota(_requests(s, d), "k", "t", "event_id").select("event_id", "accepted")
SQL["ss_quota"] = """WITH RECURSIVE e AS (SELECT user_id % 3 AS k, event_id * 100 + 1704067200000 AS ms, event_id FROM events),
    o AS (SELECT k, min(ms) AS ms FROM e GROUP BY k
      UNION ALL SELECT o.k, (SELECT min(e.ms) FROM e WHERE e.k = o.k AND e.ms > o.ms + 60000) FROM o
      WHERE EXISTS (SELECT 1 FROM e WHERE e.k = o.k AND e.ms > o.ms + 60000)),
    w AS (SELECT e.*, (SELECT max(o.ms) FROM o WHERE o.k = e.k AND o.ms <= e.ms) AS opened FROM e)
    SELECT event_id, row_number() OVER (PARTITION BY k, opened ORDER BY ms, event_id) <= 100 AS accepted FROM w"""
QUERIES["ss_quota_blocks"] = lambda s, d: quota.apply_quota(_requests(s, d), "k", "t", "event_id", block_ms=150_000, whole_key=100).select(
    "event_id", "accepted")
SQL["ss_quota_blocks"] = SQL["ss_quota"]
QUERIES["ss_quota_sparse"] = lambda s, d: quota.apply_quota(table(s, d, "events"), "event_type", "ts", "event_id", limit=2,
                                                            window_ms=900_000).select("event_id", "accepted")
SQL["ss_quota_sparse"] = """WITH RECURSIVE e AS (SELECT event_type AS k, epoch_ms(ts) AS ms, ts, event_id FROM events),
    o AS (SELECT k, min(ms) AS ms FROM e GROUP BY k
      UNION ALL SELECT o.k, (SELECT min(e.ms) FROM e WHERE e.k = o.k AND e.ms > o.ms + 900000) FROM o
      WHERE EXISTS (SELECT 1 FROM e WHERE e.k = o.k AND e.ms > o.ms + 900000)),
    w AS (SELECT e.*, x.ms AS opened FROM e ASOF JOIN o x ON x.k = e.k AND x.ms <= e.ms)
    SELECT event_id, row_number() OVER (PARTITION BY k, opened ORDER BY ts, event_id) <= 2 AS accepted FROM w"""


def _state_parts(s) -> int:
    """State partitions of a query: a task per core."""
    return s.sparkContext.defaultParallelism


def _folder(s, name) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def _streamed_quota(s, d) -> DataFrame:
    """The stateful operator, fed from files."""
    root = _folder(s, "quota")
    src = _requests(s, d)
    src.write.parquet(f"{root}/in")
    out = quota.stream_quota(s.readStream.schema(src.schema).parquet(f"{root}/in"), "k", "t", "event_id")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(
        availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(f"{root}/out").select("event_id", "accepted")


QUERIES["ss_quota_stream"] = _streamed_quota
SQL["ss_quota_stream"] = SQL["ss_quota"]


# Of five requests three come in time; one each comes in two later micro-batches, which reach back over the whole span.
_ARRIVAL = "CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END"


def _late_quota(s, d) -> DataFrame:
    """The stateful operator over several micro-batches, two of them late."""
    root = _folder(s, "quota")
    src = _requests(s, d)
    for n in range(3):  # a file each: one write after the other, so they are read in this order
        src.filter(f"{_ARRIVAL} = {n}").coalesce(1).write.mode("append").parquet(f"{root}/in")
    out = quota.stream_quota(s.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "k", "t", "event_id")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(
        availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(f"{root}/out").select("event_id", "accepted")


QUERIES["ss_quota_late"] = _late_quota
SQL["ss_quota_late"] = f"""WITH RECURSIVE e AS (SELECT user_id % 3 AS k, event_id * 100 + 1704067200000 AS ms, event_id,
      row_number() OVER (ORDER BY {_ARRIVAL}, event_id) AS pos FROM events),
    o AS (SELECT k, min(pos) AS pos, arg_min(ms, pos) AS ms FROM e GROUP BY k
      UNION ALL SELECT e.k, min(e.pos), arg_min(e.ms, e.pos) FROM o JOIN e ON e.k = o.k AND e.pos > o.pos AND e.ms > o.ms + 60000 GROUP BY e.k),
    w AS (SELECT e.*, x.pos AS opened FROM e ASOF JOIN o x ON x.k = e.k AND x.pos <= e.pos)
    SELECT event_id, row_number() OVER (PARTITION BY k, opened ORDER BY pos) <= 100 AS accepted FROM w"""


def _batched_quota(s, d) -> DataFrame:
    """The quota with its open windows kept as a table between micro-batches."""
    root = _folder(s, "quota")
    src = _requests(s, d)
    src.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(f"{root}/in")
    table_ = quota.QuotaTable(s, f"{root}/state", "k", "t", "event_id")
    write = lambda batch, n: table_.apply(batch, n).write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    s.readStream.schema(src.schema).parquet(f"{root}/in").writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{root}/out").select("event_id", "accepted")


QUERIES["ss_quota_table"] = _batched_quota
SQL["ss_quota_table"] = SQL["ss_quota"]


# SS-4 with state variables: ten micro-batches, every fifth request one batch late, every fiftieth again in the next batch
_KEYS, _LIMIT, _FROM = 20, 20, 1704067200000 - 30_000
_DELIVERED = """SELECT least(9, event_id * 10 // (last + 1) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END + again) AS b, user_id % 20 AS k,
      event_id * 100 + 1704067200000 AS ms, event_id FROM (SELECT *, 0 AS again FROM {events} UNION ALL SELECT *, 1 FROM {events} WHERE event_id % 50 = 7) e,
      (SELECT max(event_id) AS last FROM {events}) l"""


def _state_quota(s, d) -> DataFrame:
    """The quota with state variables over ten micro-batches; five keys come with a window from a table."""
    root = _folder(s, "quota")
    src = s.sql(_DELIVERED.replace("//", "div"), events=table(s, d, "events").select("event_id", "user_id")).select(
        "b", "k", F.timestamp_millis("ms").alias("t"), "event_id")
    for n in range(10):  # a file each: one write after the other, so they are read in this order
        src.filter(F.col("b") == n).coalesce(1).write.mode("append").parquet(f"{root}/in")
    open_now = s.range(5).select(F.col("id").alias("key"), F.lit(_FROM).cast("long").alias("start"), F.lit(15).cast("long").alias("count"))
    with stateful.state_settings(s, 2):
        out = stateful.quota(s.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "k", "t", "event_id",
                             limit=_LIMIT, state=open_now)
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(
            availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{root}/out").select(F.col("b").cast("long").alias("b"), "event_id", "accepted")


QUERIES["ss_quota_state"] = _state_quota
SQL["ss_quota_state"] = f"""WITH RECURSIVE e AS ({_DELIVERED.format(events="events")}),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b, ms, event_id) AS i FROM e),
    s AS (SELECT k, CAST(0 AS BIGINT) AS i, CASE WHEN k < 5 THEN {_FROM} END AS start, CASE WHEN k < 5 THEN 15 ELSE 0 END AS n,
        CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS event_id, false AS accepted FROM (SELECT DISTINCT k FROM o) k
      UNION ALL SELECT k, i, start, CASE WHEN again OR used >= {_LIMIT} THEN used ELSE used + 1 END,
        CASE WHEN again OR used >= {_LIMIT} THEN held ELSE list_append(held, event_id) END, b, event_id, again OR used < {_LIMIT}
      FROM (SELECT o.k, o.i, o.b, o.event_id, s.held, list_contains(s.held, o.event_id) AS again,
          CASE WHEN NOT list_contains(s.held, o.event_id) AND (s.start IS NULL OR o.ms > s.start + 60000) THEN o.ms ELSE s.start END AS start,
          CASE WHEN NOT list_contains(s.held, o.event_id) AND (s.start IS NULL OR o.ms > s.start + 60000) THEN 0 ELSE s.n END AS used
        FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1) x)
    SELECT b, event_id, accepted FROM s WHERE i > 0"""


# SS-8: the newest rows as lists in state; four micro-batches
def _streamed_feed(s, d) -> stateful.NewestTable:
    root = _folder(s, "feed")
    src = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    for n in range(4):
        src.filter(F.expr(f"event_id % 40 div 10 = {n}")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = s.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = stateful.NewestTable(s, f"{root}/feed", "user_id")
    out.start(stream, "ts", feed.FEED_ROWS, "event_id", f"{root}/check", _state_parts(s)).awaitTermination()
    return out


QUERIES["ss_feed_stream"] = lambda s, d: _streamed_feed(s, d).read().select("user_id", "event_id")
SQL["ss_feed_stream"] = SQL["ss_latest20"]
QUERIES["ss_feed_changes"] = lambda s, d: _streamed_feed(s, d).changes().select(F.col("batch").cast("long").alias("batch"), "user_id", "event_id", "rank")
SQL["ss_feed_changes"] = """WITH e AS (SELECT *, event_id % 40 // 10 AS b FROM events),
    w AS (SELECT n.b AS batch, e.b, user_id, event_id, CAST(row_number() OVER (PARTITION BY n.b, user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank
      FROM e JOIN range(4) AS n(b) ON e.b <= n.b),
    t AS (SELECT *, bool_or(b = batch) OVER (PARTITION BY batch, user_id) AS changed FROM w WHERE rank <= 20)
    SELECT batch, user_id, event_id, rank FROM t WHERE changed"""


def _user_feed(s, d) -> DataFrame:
    root = _folder(s, "feed")
    src = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    src.repartitionByRange(4, "event_id").write.parquet(f"{root}/in")
    with stateful.state_settings(s, 1):
        out = stateful.user_feed(s.readStream.schema(src.schema).parquet(f"{root}/in"), 8, "user_id", "ts", feed.FEED_ROWS, "event_id")
        q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{root}/out").select("event_id", "rank")


QUERIES["ss_user_feed"] = _user_feed
SQL["ss_user_feed"] = """SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events WHERE user_id = 8
    QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 20"""


def _streamed_intake(s, d) -> DataFrame:
    """Requests of all customers through key, quota and payload checks into two sinks; rows per outcome."""
    root = _folder(s, "intake")
    req = table(s, d, "events").select(
        F.expr(_KEY.replace("c_custkey", "user_id")).alias("api_key"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"), F.expr(_PAYLOAD).alias("body"))
    req.write.parquet(f"{root}/in")
    stream = s.readStream.schema(req.schema).parquet(f"{root}/in")
    feed.start_intake(stream, _registry(s, d), f"{root}/events", f"{root}/rejects", f"{root}/state",
                      f"{root}/check").awaitTermination()
    good = s.read.parquet(f"{root}/events").select(F.lit("stored").alias("outcome"))
    bad = s.read.parquet(f"{root}/rejects/payload").select(F.col("reason").alias("outcome"))
    refused = s.read.parquet(f"{root}/rejects/keys").select(F.col("reason").alias("outcome"))
    return good.unionAll(bad).unionAll(refused).groupBy("outcome").agg(F.count("*").alias("n"))


QUERIES["ss_intake_stream"] = _streamed_intake
SQL["ss_intake_stream"] = f"""SELECT CASE WHEN user_id % 10 = 0 THEN 'invalid key format' WHEN user_id % 4 = 0 THEN 'unknown or inactive key'
    WHEN valid THEN 'stored' ELSE errors END AS outcome, count(*) AS n FROM events JOIN ({SQL["ss_validate"]}) v USING (event_id) GROUP BY 1"""


def _scheduled(s, d) -> DataFrame:
    """Three arrivals of orders, the third with doubled prices; the alerts they raise."""
    root = _folder(s, "scheduled")
    o = table(s, d, "orders").select("o_totalprice", "o_orderstatus")
    store = BaselineStore(s, f"{root}/baselines")
    for factor in (1, 1, 2):
        o.withColumn("o_totalprice", F.col("o_totalprice") * factor).write.mode("append").parquet(f"{root}/in")
        stream = s.readStream.schema(o.schema).parquet(f"{root}/in")
        feed.scheduled_drift(stream, store, "orders", {"o_totalprice": 0.2}, f"{root}/alerts", f"{root}/check").awaitTermination()
    return s.read.json(f"{root}/alerts").select("dataset", "column", F.round("actual_value", 6).alias("actual_value"), "severity")


QUERIES["ss_scheduled"] = _scheduled
SQL["ss_scheduled"] = """SELECT 'orders' AS dataset, 'o_totalprice' AS "column", ROUND((avg(2 * o_totalprice) - avg(o_totalprice)) / avg(o_totalprice), 6)
    AS actual_value, 'high' AS severity FROM orders"""
