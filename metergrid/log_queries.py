"""Registered queries of the log readers: logs are written as JSON lines from the driver's events, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metergrid import tables
from metergrid.operators import collect, dedupe
from metergrid.queries import QueryFn
from metergrid.sources import billing, generations, grok_tree, logs, reconcile, snapshots, threads
from metergrid.streaming import counters

COLUMNS = ("id", "ms", "raw_model", "project", "session_id", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(e, u, k, iso): events with their time as ISO text of milliseconds."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS e", "user_id AS u", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS iso")


def claude_lines(spark, sf_dir):
    record = """to_json(named_struct('type', if(e % 11 = 0, 'user', 'assistant'), 'timestamp', if(e % 31 = 0, 'never', iso), 'sessionId', if(e % 6 <> 0, concat('s', u % 5), NULL), 'uuid', if(e % 10 = 5, concat('u', e), NULL), 'requestId', concat('r', e % 97),
      'cwd', if(e % 4 <> 0, ' /w ', NULL), 'isSidechain', e % 7 = 0, 'message', named_struct('id', if(e % 5 <> 0, concat('m', e % 300), NULL), 'model', CASE e % 9 WHEN 0 THEN '<synthetic>' WHEN 1 THEN NULL ELSE 'claude-x' END,
      'usage', named_struct('input_tokens', if(e % 6 = 2, 0, k), 'output_tokens', if(e % 6 = 2, 0, e % 50), 'cache_read_input_tokens', if(e % 6 = 2, 0, k * 2), 'cache_creation_input_tokens', if(e % 6 = 2, -1.5D, e % 30 + 0.7D), 'speed', if(e % 8 = 0, 'fast', NULL), 'service_tier', if(e % 3 = 0, ' standard ', NULL),
      'cache_creation', if(e % 6 = 2, NULL, named_struct('ephemeral_1h_input_tokens', e % 20, 'ephemeral_5m_input_tokens', e % 15)), 'output_tokens_details', named_struct('thinking_tokens', e % 60),
      'iterations', if(e % 12 = 1, array(named_struct('type', 'message', 'model', 'm', 'input_tokens', 9L), named_struct('type', 'advisor_message', 'model', if(e % 24 = 1, 'adv', NULL), 'input_tokens', 3L), named_struct('type', 'advisor_message', 'model', 'adv2', 'input_tokens', 4L)), NULL)))))"""
    return _base(spark, sf_dir).selectExpr("concat('/logs/f', u % 3, '.jsonl') AS file", "e AS line", f"{record} AS value")


def reader_claude(spark, sf_dir):
    return logs.claude(claude_lines(spark, sf_dir)).select(*COLUMNS, "cache_write_1h_tokens", "service_tier", "sidechain", "native_id", "parent_id", "legacy_id", "line")


def claude_empty_requests(spark, sf_dir):
    return logs.claude_empty(claude_lines(spark, sf_dir))


def collected_claude(spark, sf_dir):
    """A whole collection: read, replays dropped, one row a call, withdrawn ids, sources."""
    found = collect.claude_collection(claude_lines(spark, sf_dir))
    return found.events.select("id", "session_id", "input_tokens", "sidechain")


def collected_retractions(spark, sf_dir):
    return collect.claude_collection(claude_lines(spark, sf_dir)).withdrawn


def source_status(spark, sf_dir):
    """Files by what became of them, from customers."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('h', c_custkey % 3) AS harness", "concat('/p', c_nationkey) AS path", "c_custkey % 4 AS events", "if(c_custkey % 17 = 0, 1, 0) AS malformed", "c_nationkey % 5 = 0 AS unreadable")
    from metergrid.operators.aggregate import source_status as status

    return status(rows)


def codex_lines(spark, sf_dir):
    """A session for each of twenty users: running totals that start anew every ninth record."""
    base = _base(spark, sf_dir).withColumn("f", F.col("u") % 20)
    base = base.withColumn("i", F.row_number().over(Window.partitionBy("f").orderBy("e")))
    block = Window.partitionBy("f", F.floor(F.col("i") / 9)).orderBy("i")
    sums = {n: F.sum(c).over(block) for n, c in {"ti": F.col("k") * 10, "tc": F.col("k") * 4, "tw": F.col("k"), "to": F.col("k") % 7 + 1, "tr": F.col("k") % 9}.items()}
    total = "named_struct('input_tokens', ti, 'cached_input_tokens', tc, 'cache_creation_input_tokens', tw, 'output_tokens', to, 'reasoning_output_tokens', tr, 'total_tokens', if(i % 4 = 0, 0L, ti + to))"
    value = f"""CASE WHEN i % 6 = 1 THEN to_json(named_struct('type', 'turn_context', 'timestamp', iso, 'payload', named_struct('model', if(i % 12 = 1, concat('g', f), NULL), 'cwd', if(i % 18 = 1, concat('/w', f), NULL), 'service_tier', if(i % 18 = 7, 'flex', NULL))))
      ELSE to_json(named_struct('type', 'event_msg', 'timestamp', if(i % 23 = 0, '', iso), 'payload', named_struct('type', 'token_count', 'info', named_struct('total_token_usage', {total}, 'last_token_usage', if(i % 5 = 0, named_struct('input_tokens', 3L, 'cached_input_tokens', 5L, 'output_tokens', 2L), NULL))))) END"""
    lines = base.withColumns(sums).selectExpr("concat('/logs/c', f, '.jsonl') AS file", "CAST(i + 1 AS BIGINT) AS line", f"{value} AS value")
    heads = base.select("f").distinct().selectExpr("concat('/logs/c', f, '.jsonl') AS file", "1L AS line", "to_json(named_struct('type', 'session_meta', 'timestamp', '2024-01-01T00:00:00Z', 'payload', named_struct('id', concat('sess', f), 'cwd', '/home'))) AS value")
    return heads.union(lines)


def reader_codex(spark, sf_dir):
    return logs.codex(codex_lines(spark, sf_dir))[0].select(*COLUMNS, "service_tier", "line")


def streamed_codex(spark, sf_dir):
    """The same logs as a stream: their lines come in four portions that are out of order and overlap, and the query is
    stopped after the first and started again."""
    held, files = tables.lasting(spark), 16
    folder, lines = held.folder_of("stream"), held.written(codex_lines(spark, sf_dir), "lines")
    for k in range(4):
        # every fourth line early, the others late
        part = lines.where(f"pmod(xxhash64(line), 4) = {k} OR line % 50 = {k}")
        part.repartition(files, "file", F.floor(F.col("line") / counters.PART)).write.mode("append").parquet(f"{folder}/in")
        if k in (0, 3):
            stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
            counters.counted(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("NOT needs_batch").select(*COLUMNS, "service_tier", "line")


def pi_lines(spark, sf_dir):
    base = _base(spark, sf_dir).withColumn("f", F.col("u") % 20)
    value = """CASE WHEN e % 13 = 0 THEN to_json(named_struct('type', 'model_change', 'modelId', concat('p', e % 5))) ELSE to_json(named_struct('type', 'message', 'id', if(e % 17 <> 0, concat('m', e), NULL), 'timestamp', iso, 'message', named_struct('role', if(e % 10 = 0, 'user', 'assistant'),
      'model', if(e % 29 = 0, 'own', NULL), 'usage', named_struct('input', k, 'output', e % 40, 'cacheRead', k * 3, 'cacheWrite', e % 25, 'cacheWrite1h', e % 30, 'reasoning', e % 60)))) END"""
    lines = base.selectExpr("concat('/logs/p', f, '.jsonl') AS file", "e + 1 AS line", f"{value} AS value")
    heads = base.select("f").distinct().selectExpr("concat('/logs/p', f, '.jsonl') AS file", "0L AS line", "to_json(named_struct('type', 'session', 'id', concat('s', f), 'timestamp', '2024-01-01T00:00:00Z', 'cwd', if(f % 4 = 0, NULL, '/w'))) AS value")
    return heads.union(lines)


def reader_pi(spark, sf_dir):
    return logs.pi(pi_lines(spark, sf_dir)).select(*COLUMNS, "cache_write_1h_tokens")


def reader_grok(spark, sf_dir):
    """A ledger for each user, with a turn for each event."""
    turn = """named_struct('turnNumber', e % 50, 'endedAt', iso, 'usageIsIncomplete', if(e % 9 = 0, true, NULL), 'modelUsage', if(e % 8 = 0, NULL, map(concat('g', e % 3, '/x'), named_struct('inputTokens', k * 10, 'outputTokens', if(e % 14 = 0, -1L, e % 30), 'cachedReadTokens', k * 4, 'cacheCreationTokens', k * 8, 'reasoningTokens', e % 50,
      'modelCalls', e % 6, 'costUsdTicks', e % 5 * 1000000, 'costIsPartial', if(e % 7 = 0, true, NULL)))), 'primaryModelId', if(e % 16 = 0, 'prime', NULL), 'inputTokens', k, 'outputTokens', 1L)"""
    rows = _base(spark, sf_dir).selectExpr("u", f"struct(e AS at, to_json({turn}) AS t) AS t").groupBy("u").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ledgers = rows.selectExpr("concat('l', u) AS file", "concat('s ', u) AS session_id", "'/w' AS project", "'dm' AS model", "concat('{', if(u % 5 = 0, '', concat('\"sessionId\":\"', if(u % 11 = 0, 'other', concat('s ', u)), '\",')), '\"turns\":[', array_join(transform(ts, x -> x.t), ','), ']}') AS value")
    return logs.grok(ledgers).select(*COLUMNS, "reported_cost_usd", "requests")


def muse_lines(spark, sf_dir):
    """Records in frames, two deep at every third."""
    base = _base(spark, sf_dir).withColumn("f", F.col("u") % 20)
    call = """to_json(named_struct('id', if(e % 6 <> 0, concat('r', e), NULL), 'recorded_at', unix_micros(CAST(iso AS TIMESTAMP)), 'sequence', if(e % 4 = 0, e, NULL), 'stream', if(e % 19 = 0, named_struct('kind', 'approval-review', 'id', 'x'), named_struct('kind', 'session', 'id', concat('st', f))),
      'payload', named_struct('event', named_struct('kind', 'model_completed', 'model', if(e % 5 = 0, 'own', NULL), 'usage', named_struct('input_tokens', k * 9, 'cache_read_tokens', k * 3, 'cached_tokens', k * 4, 'cache_write_tokens', k * 7, 'output_tokens', e % 20, 'reasoning_tokens', e % 30)))))"""
    told = "to_json(named_struct('payload_type', 'run.model.configured', 'stream', named_struct('kind', 'session', 'id', concat('st', f)), 'payload', named_struct('record', named_struct('model_id', concat('mm', e % 4), 'workspace_root', if(e % 26 = 0, '/ws', NULL)))))"
    rows = base.withColumn("one", F.expr(f"CASE WHEN e % 13 = 0 THEN {told} ELSE {call} END"))
    framed = rows.withColumn("two", F.expr("to_json(named_struct('children', array(named_struct('record_json', one, 'child_index', 3L))))")).withColumn("value", F.expr("CASE e % 3 WHEN 0 THEN to_json(named_struct('children', array(named_struct('record_json', two)))) WHEN 1 THEN two ELSE one END"))
    return framed.selectExpr("concat('/d/', f, '/session.jsonl') AS file", "e AS line", "value")


def reader_muse(spark, sf_dir):
    return logs.muse(muse_lines(spark, sf_dir)).select(*COLUMNS)


def reader_billing(spark, sf_dir):
    usage = "to_json(map('prompt-text-tokens', CAST(k AS STRING), 'completion-text-tokens', CAST(e % 30 AS STRING), if(e % 2 = 0, 'cached-prompt-text-tokens', 'cache-write-text-tokens'), CAST(e % 70 AS STRING)))"
    raw = _base(spark, sf_dir).selectExpr("if(e % 5 = 0, 'other', 'cursor') AS Product", "if(e % 7 = 0, 'credit', 'usage') AS `Charge Category`", "concat('item-', e) AS `Billing Item ID`", "iso AS `Event Time`", "if(e % 3 = 0, ' ', ' auto ') AS Model", f"{usage} AS Usage")
    return billing.billing_rows(raw).select(*COLUMNS, "requests")


def parent_records(spark, sf_dir):
    """Running totals of chained sessions, which copy those of their parents."""
    from metergrid.queries import _files

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_custkey AS STRING) AS session_id", "o_orderkey % 400 AS ms", "o_orderkey % 3 AS input_tokens", "o_orderkey AS e")
    rows = o.selectExpr("session_id", "concat(if(e % 5 = 0, 'codex:response:', 'codex:total:'), e) AS id", "ms", "input_tokens", *[f"0L AS {c}" for c in ("output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")])
    files = _files(spark, sf_dir).withColumn("forked_ms", F.when(F.col("forked_ms") % 30 == 0, 50).cast("long"))
    listed = o.where("e % 15 = 0").selectExpr("session_id", "CAST(e AS STRING) AS response")
    above = listed.where("CAST(response AS LONG) % 30 = 0").join(files, "session_id").where("parent_id IS NOT NULL").select(F.col("parent_id").alias("session_id"), "response")
    return dedupe.without_parent_records(rows, files, 16, listed.union(above)).select("session_id", "id", "ms")


def thread_metadata(spark, sf_dir):
    """Thread tables of two databases, in both layouts, made from customers, orders and nations."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS c", "c_nationkey AS n", "c_custkey % 2 AS db", "concat('t ', c_custkey) AS thread_id", "concat('p', c_nationkey) AS project_id")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS o", "o_custkey % 2 AS db", "concat('t ', o_custkey) AS thread_id", "element_at(array('claudeAgent', 'codex', 'pi', 'other'), CAST(o_orderkey % 4 + 1 AS INT)) AS provider_name", "concat('n', o_orderkey % 900) AS native")
    both = spark.range(2).selectExpr("id AS db")
    projects = spark.read.parquet(f"{sf_dir}/nation.parquet").join(both).selectExpr("db", "concat('p', n_nationkey) AS project_id", "if(n_nationkey % 6 = 0, 'No project', n_name) AS title", "if(n_nationkey % 3 = 0, NULL, concat('/w/', n_nationkey)) AS workspace_root").where("project_id <> 'p7'")
    current = c.selectExpr("db", "thread_id", "project_id", "if(c % 5 = 0, '  ', concat(' Title ', c, ' ')) AS title", "if(c % 4 = 0, 'no json', to_json(named_struct('worktreePath', concat('/w/', n)))) AS payload_json", "if(c % 13 = 0, 'gone', NULL) AS deleted_at")
    bound = o.where("o % 3 = 0").selectExpr("db", "thread_id", "if(o % 11 = 0, '{', to_json(named_struct('nativeThreadRef', named_struct('nativeId', native, 'driver', provider_name)))) AS payload_json", "o % 50 AS updated_at")
    older = c.where("c % 3 > 0").selectExpr("db", "thread_id", "project_id", "concat('Old ', c) AS title", "if(c % 2 = 0, concat('/old/', c), NULL) AS worktree_path", "if(c % 17 = 0, 'gone', NULL) AS deleted_at")
    runtime = o.where("o % 3 = 1").selectExpr("db", "thread_id", "provider_name", "to_json(named_struct('threadId', if(o % 7 = 0, NULL, native), 'sessionId', 'z')) AS resume_cursor_json")
    sessions = o.where("o % 3 = 2").selectExpr("db", "thread_id", "provider_name", "if(o % 7 = 0, NULL, native) AS provider_thread_id", "if(o % 2 = 0, NULL, 'y') AS provider_session_id")
    found = threads.current_bindings(bound, current, projects).unionByName(threads.older_bindings(runtime, sessions, older, projects))
    out = threads.thread_metadata(found, current, "https://Host.example/base/", "env 1")
    return out.withColumn("repository_paths", F.array_join("repository_paths", ",")).drop("priority")


def merged_generations(spark, sf_dir):
    """Calls recorded several times, made from orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat('g', o_custkey) AS id", "o_orderkey AS seq", "element_at(array('unknown', 'a', 'b'), CAST(o_orderkey % 3 + 1 AS INT)) AS model", "element_at(array('', '', 'fast', 'slow'), CAST(o_orderkey % 4 + 1 AS INT)) AS tier",
        "o_orderkey * 7 % 10 AS input_tokens", "o_orderkey % 2 AS output_tokens", "0L AS cache_read_tokens", "0L AS cache_write_tokens",
    )
    return generations.merged_copies(rows, "seq").select("id", "seq", "model", "tier", "input_tokens")


def generation_workspaces(spark, sf_dir):
    """Models and workspaces of conversations, made from customers."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS c", "element_at(array(' models/alpha-high ', '', 'Publishers/x/models/beta'), CAST(c_custkey % 3 + 1 AS INT)) AS response", "element_at(array('models/gamma-XHIGH', 'delta-low-high', '', NULL), CAST(c_custkey % 4 + 1 AS INT)) AS planner",
        """array(named_struct('folder', if(c_custkey % 5 = 0, 'http://x/y', concat('file:///w/a%20', c_nationkey, '/')), 'git_root', '', 'remote_url', '', 'branch', ''),
          named_struct('folder', if(c_custkey % 7 = 0, '/u/.t3/userdata/attachments/1', ''), 'git_root', if(c_custkey % 2 = 0, concat('/git/', c_nationkey, '//'), ''), 'remote_url', if(c_custkey % 4 = 0, 'git@host.example:Team/Repo.git', ''), 'branch', '')) AS spaces""",
        "array('relative', 'file:///u/.T3/userdata/attachments', if(c_custkey % 3 = 0, 'file://localhost/last+one', 'ftp://z')) AS uris",
    )
    project, repository = generations.chosen_workspace(F.col("spaces"), F.col("uris"))
    return rows.select("c", generations.first_model(F.col("response"), F.col("planner")).alias("model"), project.alias("project"), repository.alias("repository"))


def _recorded_calls(spark, sf_dir):
    """Generators, steps, executors and conversations made from events, with aliases that neighbours share."""
    w = Window.partitionBy("c").orderBy("e")
    base = _base(spark, sf_dir).withColumn("c", F.expr("concat('c ', u % 40)")).withColumn("i", F.row_number().over(w).cast("long") - 1)
    usage = ("if(e % 13 = 0, NULL, if(e % 11 = 0, 0, k)) AS input_tokens", "if(e % 11 = 0 OR e % 4 = 0, 0L, e % 50) AS output_tokens", "if(e % 11 = 0, 0L, e % 3) AS cache_read_tokens", "0L AS cache_write_tokens", "if(e % 11 = 0, 0L, e % 9) AS thinking_tokens", "if(e % 11 = 0, 0L, e % 6) AS response_tokens")
    shared = ("if(e % 2 = 0, '', concat(' Tier', e % 3)) AS tier", "e % 5 AS model_enum", "if(e % 3 = 0, concat('x', e % 6), NULL) AS execution_id")
    steps = base.where("e % 3 <> 1").selectExpr("c AS conversation", "i AS idx", "if(e % 9 = 0, NULL, iso) AS stamp", "if(e % 5 < 2, '', concat('r', i div 3 + e % 2)) AS response_id", "if(e % 4 = 0, NULL, concat(if(e % 16 = 5, 'r', 'm'), i div 5 + e % 3)) AS message_id", "if(e % 6 = 0, concat('p', i div 4), '') AS provider_id", *shared, *usage)
    steps = steps.withColumn("model_enum", F.expr("(model_enum + 1) % 7"))
    generators = base.where("e % 4 <> 3").selectExpr("c AS conversation", "i AS idx", "CASE e % 5 WHEN 0 THEN array() WHEN 1 THEN array(i) WHEN 2 THEN array(i + 1, i) ELSE array(i - 1, i + 2, i) END AS step_indices", "if(e % 3 = 0, '', concat('r', i div 3 + (e div 2) % 2)) AS response_id",
      "if(e % 7 < 3, '', concat(if(e % 16 = 5, 'r', 'm'), i div 5 + e % 3)) AS message_id", "if(e % 5 = 4, concat('p', i div 4), NULL) AS provider_id", "if(e % 4 = 0, ' models/a-high ', '') AS response_model", "if(e % 6 = 1, 'models/gamma-low', NULL) AS planner_model", *shared, *usage)
    executors = base.where("e % 10 = 0").selectExpr("c AS conversation", "i AS idx", "concat('x', e % 6) AS execution_id", "concat('run', e % 7, '-low') AS model")
    conversations = base.groupBy("c").agg(F.when(F.min("u") % 3 == 0, F.min("iso")).alias("fallback_stamp")).withColumnRenamed("c", "conversation")
    return generators, steps, executors, conversations


def reconciled_calls(spark, sf_dir):
    return reconcile.reconcile(*_recorded_calls(spark, sf_dir), tables.lasting(spark))[0]


def reconciled_withdrawn(spark, sf_dir):
    return reconcile.reconcile(*_recorded_calls(spark, sf_dir), tables.lasting(spark))[1]


def _grok_sessions(spark, sf_dir):
    """Sessions in chains of forks, some from a session that is gone, some in circles; sub-agents by kind and by links."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS c")
    sessions = c.selectExpr("CAST(c AS STRING) AS session_id", "CASE WHEN c % 11 = 0 THEN concat('gone', c) WHEN c % 50 = 49 THEN CAST(c - 1 AS STRING) WHEN c % 50 = 48 THEN CAST(c + 1 AS STRING) WHEN c >= 7 THEN CAST(c div 7 AS STRING) ELSE '' END AS parent_id", "c * 50 AS forked_ms", "if(c % 4 = 1, 'subagent/x', NULL) AS kind", "c")
    links = c.where("c % 9 = 2").selectExpr("CAST(c AS STRING) AS child_id", "CAST(c div 3 AS STRING) AS parent_id", "c AS seq").union(c.where("c % 18 = 2").selectExpr("CAST(c AS STRING)", "CAST(c div 2 AS STRING)", "c + 1"))
    return sessions, links


def grok_forks(spark, sf_dir):
    """Turns of customers, with copies in the sessions forked from theirs, a few milliseconds off."""
    sessions, _ = _grok_sessions(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS p", "o_orderkey AS o")
    copies = sessions.where("parent_id <> ''").select("c", F.floor(F.col("c") / 7).alias("p")).join(o, "p").where("o % 3 <> 0").selectExpr("c", "o", "o * 10 + (o + c) % 6 - 2 AS ms")
    deeper = sessions.select("c", F.floor(F.col("c") / 49).alias("p")).join(o, "p").where("o % 4 = 0").selectExpr("c", "o", "o * 10 AS ms")
    rows = o.selectExpr("p AS c", "o", "o * 10 AS ms").union(copies).union(deeper).selectExpr("c", "o % 9 AS turn", "concat('m ', o % 2) AS raw_model", "ms")
    rows = rows.union(sessions.where("c % 11 = 0").selectExpr("c", "3L", "'m 1'", "forked_ms")).distinct()
    rows = rows.selectExpr("CAST(c AS STRING) AS session_id", "turn", "raw_model", "ms", "concat('grok:turn:', c, ':', turn, ':', replace(raw_model, ' ', '%20')) AS id", "false AS sidechain", "c AS copy")
    return grok_tree.fork_owners(rows, sessions, tables.lasting(spark)).select("copy", "session_id", "turn", "raw_model", "ms", "id", "sidechain")


def grok_roots(spark, sf_dir):
    """Sub-agents with the session that accounts for them, and whether they are orphans."""
    sessions, links = _grok_sessions(spark, sf_dir)
    held, read = tables.lasting(spark), sessions.where("c % 6 <> 0").select("session_id")
    lost = grok_tree.orphans(sessions, links, read, held).withColumn("orphan", F.lit(True))
    return grok_tree.roots(sessions, links, held).join(lost, "session_id", "left").select("session_id", "root", F.coalesce("orphan", F.lit(False)).alias("orphan"))


def grok_fallback(spark, sf_dir):
    """Ledgers and update streams made from orders: sound ledgers, others with malformed parts, with and without updates."""
    sessions, links = _grok_sessions(spark, sf_dir)
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS c", "o_orderkey AS o", "date_format(timestamp_seconds(1704067200 + o_orderkey), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS iso")
    turn = "to_json(named_struct('turnNumber', if(o % 89 = 0, 0, o), 'endedAt', iso, 'inputTokens', o % 70, 'outputTokens', if(o % 97 = 0, -1, o % 30), 'cachedReadTokens', o % 40))"
    ledgers = o.selectExpr("c", f"struct(o, {turn} AS t) AS t").groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    ledgers = ledgers.selectExpr("concat('l', c) AS file", "CAST(c AS STRING) AS session_id", "'/w' AS project", "'dm' AS model", "concat('{\"sessionId\":\"', if(c % 10 = 0, 'other', CAST(c AS STRING)), '\",\"turns\":[', array_join(transform(ts, x -> x.t), ','), ']}') AS value")
    done = "to_json(named_struct('timestamp', iso, 'params', named_struct('_meta', named_struct('eventId', concat('e', o div 6)), 'update', named_struct('sessionUpdate', 'turn_completed', 'usage', named_struct('inputTokens', o % 60, 'outputTokens', o % 25)))))"
    updates = o.where("c % 3 <> 0").selectExpr("concat('u', c) AS file", "CAST(c AS STRING) AS session_id", "'/w' AS project", "'dm' AS model", "o AS line", f"{done} AS value")
    return grok_tree.session_rows(sessions, links, ledgers, updates)[0].select("id", "ms", "session_id", "input_tokens", "cache_read_tokens", "output_tokens")


def snapshot_halves(spark, sf_dir):
    """Cloud usage, a switch to billing, a refresh that switches back, and a second import: each stored and read again."""
    base = _base(spark, sf_dir).selectExpr("e", "concat('a', u % 10) AS session_id", "u % 10 AS agent", "k AS input_tokens")
    of = lambda kind, where, tokens="input_tokens": base.where(where).selectExpr(f"concat('{kind}:', e) AS id", "session_id", f"{tokens} AS input_tokens")
    folder = tables.lasting(spark).folder_of("snapshot")
    schema = of("c", "true").schema
    agents = base.select("session_id", "agent").distinct()
    for step in (
        lambda s: snapshots.refreshed(s, of("c", "e % 4 = 0"), agents),
        lambda s: snapshots.imported(s, of("b", "e % 6 = 0")),
        lambda s: snapshots.refreshed(s, of("c", "agent < 5 AND (e % 8 = 0 OR e % 7 = 0)", "input_tokens + 1"), agents.where("agent < 5")),
        lambda s: snapshots.imported(s, of("b", "e % 9 = 0", "input_tokens + 2")),
    ):
        snapshots.write(spark, folder, step(snapshots.read(spark, folder, schema)))
    last = snapshots.read(spark, folder, schema)
    half = lambda df, name: df.withColumn("half", F.lit(name))
    return half(last.events, "active").unionByName(half(last.parked, "parked")).unionByName(half(last.withdrawn, "withdrawn"), allowMissingColumns=True)


def _blobs(spark, sf_dir):
    """Generators of _recorded_calls() as binary messages, with prompts that no reader may touch; some are cut off."""
    from metergrid.sources import wire

    rows = _recorded_calls(spark, sf_dir)[0]
    schema = "conversation string, idx long, data binary"

    def number(n):
        out = bytearray()
        while True:
            out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
            n >>= 7
            if not n:
                return bytes(out)

    def put(field, value):
        if isinstance(value, int):
            return number(field << 3) + number(value)
        raw = value.encode() if isinstance(value, str) else value
        return number(field << 3 | 2) + number(len(raw)) + raw

    numbers = {f.name: n for n, f in wire.USAGE.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                usage = b"".join(put(n, r[c]) for c, n in numbers.items() if c != "model_enum" and r.get(c))
                chat = put(1, "a prompt") + put(3, r["model_enum"]) + (put(4, usage) if r["input_tokens"] is not None else b"") + put(19, r["response_model"])
                data = put(1, chat) + put(2, b"".join(map(number, (x for x in r["step_indices"] if x >= 0)))) + put(3, put(28, r["planner_model"] or "") + put(5, b"\x08\xff")) + put(4, r["execution_id"] or "") + number(9 << 3 | 1) + b"8 bytes."
                out.append(data[:-3] if r["idx"] % 10 == 9 else data)
            yield pa.RecordBatch.from_pydict({"conversation": batch.column("conversation"), "idx": batch.column("idx"), "data": pa.array(out, pa.binary())})

    return rows.mapInArrow(run, schema)


def wire_generators(spark, sf_dir):
    from metergrid.sources import wire

    text = ("response_id", "message_id", "provider_id", "tier", "response_model", "planner_model", "execution_id")
    rows = wire.generators(_blobs(spark, sf_dir))
    return rows.select("conversation", "idx", "malformed", F.array_join(F.col("step_indices").cast("array<string>"), ",").alias("steps"), "model_enum", *text, *wire._COUNTS)


def queries() -> dict[str, QueryFn]:
    found = (reader_claude, claude_empty_requests, collected_claude, collected_retractions, source_status, reader_codex, streamed_codex, reader_pi, reader_grok, reader_muse, reader_billing, parent_records, thread_metadata, merged_generations, generation_workspaces, reconciled_calls, reconciled_withdrawn, grok_forks, grok_roots, grok_fallback, snapshot_halves, wire_generators)
    return {f.__name__: f for f in found}
