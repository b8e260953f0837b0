"""The query catalogue over the driver's tables, each with its SQL."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import native, opaque
from ..sources import readers, scratch, sinks
from .job import FileTransferJob, Job, MapReduceJob, ScriptJob, compile_job, run_mapreduce

_WORD = re.compile(r"\w+")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c) -> F.Column:
    return F.unix_micros(c.cast("timestamp"))


TOKENS = r"SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents"
Q01 = f"SELECT token, count(*) AS n FROM ({TOKENS}) WHERE token <> '' GROUP BY token"


@query(Q01)
def q01_token_count(spark, sf_dir):
    return native.count_by(native.explode_tokens(table(spark, sf_dir, "documents"), "text"), "token")


@query(f"SELECT lang, token, count(*) AS n FROM ({TOKENS}) WHERE token <> '' GROUP BY lang, token")
def q02_token_count_by_lang(spark, sf_dir):
    return native.count_by(native.explode_tokens(table(spark, sf_dir, "documents"), "text", "lang"), "lang", "token")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q03_event_type_count(spark, sf_dir):
    return native.count_by(table(spark, sf_dir, "events"), "event_type")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def q04_filter_project(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_totalprice > 100000 AND o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price FROM lineitem GROUP BY l_returnflag, l_linestatus")
def q05_flag_sums(spark, sf_dir):
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"))


@query("SELECT user_id, count(*) AS n, min(value) AS least, max(value) AS most, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value), 4) AS mean FROM events GROUP BY user_id")
def q06_user_stats(spark, sf_dir):
    total = F.sum(F.col("value").cast("decimal(18,6)")).cast("double")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(total / F.count("value"), 4).alias("mean"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def q07_distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))


@query("SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def q08_dedup_text(spark, sf_dir):
    # the digest is dealt out, not the text
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return docs.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"SELECT token, doc_id, count(*) AS n FROM ({TOKENS}) WHERE token <> '' GROUP BY token, doc_id")
def q09_inverted_index(spark, sf_dir):
    """Postings as rows: a token in every document makes many rows and no long list. Tokens of a pair mostly meet in the map task already."""
    return native.count_by(native.explode_tokens(table(spark, sf_dir, "documents"), "text", "doc_id"), "token", "doc_id")


def _words(lines, aux):
    """The words of some lines; no word goes over a line's end."""
    found = _WORD.findall("\n".join(filter(None, lines)).lower().replace("_", " "))
    return [t for t in found if t not in aux] if aux else found


def _add_up(group, aux):
    key, total = None, 0
    for key, n in group:  # noqa: B007
        total += n
    return [(key, total)]


@query(Q01)
def q10_opaque_token_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    return opaque.reduce_groups(opaque.count_keys(docs, _words, "token string, n long"), ["token"], _add_up, "token string, n long", merge=registry.add)


def _steps(group, aux):
    for i, (user, _, _, kind) in enumerate(group):
        yield user, i + 1, kind


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type FROM events")
def q11_event_path(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return opaque.reduce_groups(items, ["user_id"], _steps, "user_id long, step long, event_type string")


@query(_SQL["q11_event_path"])
def q11_native_event_path(spark, sf_dir):
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", step.cast("long").alias("step"), "event_type")


PAIRS = "SELECT event_type AS first_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second_type FROM events"


@query(f"SELECT first_type, second_type, count(*) AS n FROM ({PAIRS}) WHERE second_type IS NOT NULL GROUP BY first_type, second_type")
def q12_adjacent_pairs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("first_type"), F.lead("event_type").over(w).alias("second_type"))
    return native.count_by(pairs.filter("second_type IS NOT NULL"), "first_type", "second_type")


def _pairs(group, aux):
    before = None
    for *_, kind in group:
        if before is not None:
            yield before, kind
        before = kind


@query(f"SELECT first_type, second_type, count(*) AS n FROM ({PAIRS}) WHERE second_type IS NOT NULL GROUP BY first_type, second_type")
def q12_opaque_adjacent_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return native.count_by(opaque.reduce_groups(items, ["user_id"], _pairs, "first_type string, second_type string"), "first_type", "second_type")


@query("""WITH m AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
SELECT user_id, run, event_type, count(*) AS length FROM r GROUP BY user_id, run, event_type""")
def q13_runs_in_group(spark, sf_dir):
    return native.runs(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "event_type", ["ts", "event_id"])


def _opaque_runs(group, aux):
    for i, (kind, run) in enumerate(opaque.sub_groups(group, 3)):
        user = n = 0
        for user, *_ in run:  # noqa: B007
            n += 1
        yield user, i + 1, kind, n


@query(_SQL["q13_runs_in_group"])
def q13_opaque_runs(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return opaque.reduce_groups(items, ["user_id"], _opaque_runs, "user_id long, run long, event_type string, length long")


@query("""WITH t AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events),
m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM t),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM m)
SELECT user_id, session, count(*) AS n_events, min(t) AS first_us, max(t) AS last_us FROM s GROUP BY user_id, session""")
def q14_sessions_30min(spark, sf_dir):
    return native.sessions(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", micros(F.col("ts")), 30 * 60 * 1_000_000, ["event_id"])


@query("""SELECT l_suppkey, CAST(rank AS INTEGER) AS rank, l_orderkey, l_linenumber, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS rank FROM lineitem) WHERE rank <= 3""")
def q15_topk_per_supplier(spark, sf_dir):
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    return native.top_k(table(spark, sf_dir, "lineitem"), "l_suppkey", 3, order).select("l_suppkey", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


def _supplier(group, aux):
    key, total, n = None, Decimal(0), 0
    for key, qty, some in group:  # noqa: B007
        total, n = total + qty, n + some
    yield key, n, float(total)


def _same_supplier(a, b):
    return a[0], a[1] + b[1], a[2] + b[2]


@query("SELECT l_suppkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty FROM lineitem GROUP BY l_suppkey")
def q16_streaming_group(spark, sf_dir):
    """The reducer adds up, so a task merges its items before they are dealt out."""
    qty = F.coalesce(F.col("l_quantity").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", qty.alias("qty"), F.lit(1).cast("long").alias("n"))
    return opaque.reduce_groups(opaque.combine(items, ["l_suppkey"], _same_supplier), ["l_suppkey"], _supplier, "l_suppkey long, n long, sum_qty double", order_by=[])


@query(_SQL["q16_streaming_group"])
def q16_native_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("sum_qty"))


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def q17_aux_lookup_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return native.lookup(table(spark, sf_dir, "customer"), nation, "c_nationkey").select("c_custkey", "c_name", "n_name")


def _tagged(group, aux):
    name, n, cents = None, 0, 0
    for _, tag, text, amount in group:
        if tag == 0:
            name = text
        else:
            n, cents = n + 1, cents + amount
    if name is not None and n:
        yield name, n, cents


@query("SELECT n_name, count(*) AS n_customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def q18_tagged_join(spark, sf_dir):
    """Two inputs tagged and met in one group, the nation's item first by its tag."""
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.lit(0).alias("tag"), F.col("n_name").alias("text"), F.lit(0).cast("long").alias("amount"))
    right = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit(1).alias("tag"), F.lit("").alias("text"), F.round(F.col("c_acctbal") * 100).cast("long").alias("amount"))
    return opaque.reduce_groups(left.unionByName(right), ["key"], _tagged, "n_name string, n_customers long, cents long", order_by=["tag"])


@query(_SQL["q18_tagged_join"])
def q18_native_join(spark, sf_dir):
    """Customers are added up by nation before the nation's name is looked up."""
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("long"))
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"), cents.alias("cents"))
    return native.lookup(per, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "inner").select("n_name", "n_customers", "cents")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q19_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q20_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT key, CAST(sum(o) AS BIGINT) AS n_orders, CAST(sum(l) AS BIGINT) AS n_lines FROM (SELECT o_orderkey AS key, 1 AS o, 0 AS l FROM orders UNION ALL SELECT l_orderkey, 0, 1 FROM lineitem) GROUP BY key")
def q21_multi_input_counts(spark, sf_dir):
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), one.alias("n_orders"), none.alias("n_lines"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), none.alias("n_orders"), one.alias("n_lines"))
    return native.merge_sums([orders, lines], ["key"], ["n_orders", "n_lines"])


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def q22_aux_in_reducer(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    found = native.lookup(per, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "inner")
    return found.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


@query("SELECT doc_id, lang FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 <= 0.1")
def q23_hash_downsample(spark, sf_dir):
    return readers.sample_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 0.1)


@query()
def q24_file_downsample(spark, sf_dir):
    """Which files of the folder samples of a quarter and a half take, by name."""
    files = [n for _, n in readers.list_files(spark, [sf_dir])]
    few, half = ({n for _, n in readers.sampled([("", f) for f in files], r)} for r in (0.25, 0.5))
    return spark.createDataFrame([(f, readers.draw(f), f in few, f in half) for f in files], "file string, draw double, in_quarter boolean, in_half boolean")


@query(Q01)
def q25_incremental_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = [native.count_by(native.explode_tokens(docs.filter(F.pmod("doc_id", F.lit(2)) == i), "text"), "token") for i in (0, 1)]
    return native.merge_sums(parts, ["token"], ["n"])


@query("SELECT source, count(*) AS n_new FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 20 < 5) GROUP BY source")
def q26_unseen_inputs(spark, sf_dir):
    """Inputs (here sources) in a ledger of seen ones are left out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    seen = docs.filter("doc_id % 20 < 5").select("source").distinct()
    return docs.join(seen, "source", "left_anti").groupBy("source").agg(F.count("*").alias("n_new"))


@query(f"SELECT n AS occurrences, count(*) AS n_tokens FROM ({Q01}) GROUP BY n")
def q27_count_histogram(spark, sf_dir):
    return native.count_by(q01_token_count(spark, sf_dir).withColumnRenamed("n", "occurrences"), "occurrences", into="n_tokens")


@query(f"SELECT token, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 12) AS probability FROM ({Q01})")
def q28_token_probability(spark, sf_dir):
    """The total is one row joined back, so no task gets all tokens."""
    counts = q01_token_count(spark, sf_dir)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("token", "n", F.round(F.col("n") / F.col("total").cast("double"), 12).alias("probability"))


@query("SELECT k, count(*) AS n FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k")
def q29_json_props(spark, sf_dir):
    return native.count_by(table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")), "k")


@query(r"""WITH t AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
p AS (SELECT t, unnest(generate_series(1, len(t) - 1)) AS i FROM t WHERE len(t) > 1)
SELECT t[i] AS first, t[i + 1] AS second, count(*) AS n FROM p GROUP BY ALL""")
def q30_bigrams(spark, sf_dir):
    """One pass over a text's tokens: each place gives the token there and the next one."""
    t = table(spark, sf_dir, "documents").select(native.tokens(F.col("text")).alias("t")).filter("size(t) > 1")
    pairs = t.select("t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("i")).select(F.element_at("t", F.col("i")).alias("first"), F.element_at("t", F.col("i") + 1).alias("second"))
    return native.count_by(pairs, "first", "second")


def _conversation(group, aux):
    conv, first, last, n, chars = None, None, None, 0, 0
    for conv, _, role, text in group:  # noqa: B007
        first, last, n, chars = first if n else role, role, n + 1, chars + len(text or "")
    yield conv, n, first, last, chars


@query("SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def q31_conversation_walk(spark, sf_dir):
    return opaque.reduce_groups(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], _conversation, "conv_id long, n_turns long, first_role string, last_role string, n_chars long", order_by=["turn"])


@query("SELECT * FROM (VALUES (0, 0, 'high', true), (1, 0, 'once', true), (2, 0, 'breaks', false), (3, 0, 'low', true), (4, 1, 'high', true), (5, 1, 'low', true)) AS t(step, cycle, job_name, success)")
def q32_scheduler_log(spark, sf_dir):
    """Two cycles of a queue: priority, run_once, and a failure that takes its group along."""
    from ..control.scheduler import JobQueue, Runner

    def run(job: Job) -> None:
        if job.job_name == "breaks":
            raise RuntimeError("this job breaks")

    with tempfile.TemporaryDirectory() as folder:
        queue = JobQueue(folder)
        for name, priority, more in (("low", 1, {}), ("high", 9, {}), ("once", 7, {"run_once": True}), ("breaks", 5, {"group_name": "g"}), ("never", 3, {"group_name": "g"})):
            queue.submit(ScriptJob(job_name=name, job_priority=priority, script_location="-", **more))
        log = Runner(queue, runners={ScriptJob: run}).run(max_cycles=2)
    return spark.createDataFrame([(i, e["cycle"], e["job_name"], e["success"]) for i, e in enumerate(log)], "step int, cycle int, job_name string, success boolean")


@query("SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def q31_native_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def q33_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q34_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def q35_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def q36_grouping_sets(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupingSets([[status], [priority], []], status, priority).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q37_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def q38_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q39_order_limit(spark, sf_dir):
    """A global order with a limit: every task offers its first hundred."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


# From here on queries go the whole way of a job: text files in folders, named functions, written output, kept state.


registry.mapper("catalog_words", schema="token string, n long", counts=True)(_words)


@registry.reducer("catalog_total", schema="token string, n long", merge=registry.add)
def _total(group, aux):
    return _add_up(group, aux)


@registry.mapper("catalog_native_words", native=True)
def _native_words(lines, aux=None):
    return native.explode_tokens(lines, "value").withColumn("n", F.lit(1).cast("long"))


@registry.reducer("catalog_native_total", native=True)
def _native_total(items, aux=None):
    return native.merge_sums([items], ["token"], ["n"])


@registry.mapper("catalog_counts_of_items", schema="occurrences long, n_tokens long", counts=True)
def _counts_of_items(lines, aux):
    return [json.loads(line)[1] for line in lines]


@registry.reducer("catalog_histogram", schema="occurrences long, n_tokens long", merge=registry.add)
def _histogram(group, aux):
    return _add_up(group, aux)


def _text_files(spark, sf_dir, folder: str, half: int | None = None) -> str:
    """The documents' texts as files of lines in a folder; half: those of even or odd ids."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    docs = docs if half is None else docs.filter(F.pmod("doc_id", F.lit(2)) == half)
    sinks.write(docs.select("text"), folder, "lines", append=True)
    return folder


def _job(spark, name: str, inputs: list[str], out: str, **more) -> MapReduceJob:
    return MapReduceJob(**{"job_name": name, "job_priority": 1, "inputs": inputs, "map_function_name": "catalog_words", "reduce_function_name": "catalog_total", "output_dir": out} | more)


@query(Q01)
def q40_text_folders(spark, sf_dir):
    """A job over two folders of text, one of them gzip: native functions, output compressed and in rolling parts."""
    folders = [scratch.folder(spark, "in") for _ in "ab"]
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    for i, folder in enumerate(folders):
        sinks.write(docs.filter(F.pmod("doc_id", F.lit(2)) == i).select("text"), folder, "lines", compress=i == 1)
    out = scratch.folder(spark, "out")
    run_mapreduce(spark, _job(spark, "folders", folders, out, map_function_name="catalog_native_words", reduce_function_name="catalog_native_total", compress=True, max_records_per_file=10_000))
    return spark.read.schema("token string, n long").json(out)


@query(Q01)
def q41_ledger_delta(spark, sf_dir):
    """Three runs over a folder that grows, the third with nothing new; opaque functions, outputs merged."""
    from ..streaming import incremental

    folder, out = scratch.folder(spark, "in"), scratch.folder(spark, "out")
    job = _job(spark, "delta", [folder], out, hold_state=True, delete_job_data=False, streaming_group=True)
    for half in (0, 1, None):
        if half is not None:
            _text_files(spark, sf_dir, folder, half)
        incremental.run_delta(spark, job)
    return incremental.merged_output(spark, job)


@query(Q01)
def q42_state_reset(spark, sf_dir):
    """A run without hold_state forgets what was seen and reads all files again."""
    folder, out = scratch.folder(spark, "in"), scratch.folder(spark, "out")
    _text_files(spark, sf_dir, folder, 0)
    run_mapreduce(spark, _job(spark, "reset", [folder], out, hold_state=True))
    _text_files(spark, sf_dir, folder, 1)
    run_mapreduce(spark, _job(spark, "reset", [folder], out))
    return spark.read.schema("token string, n long").json(out)


@query(Q01)
def q43_streaming_counts(spark, sf_dir):
    """Structured Streaming over the same folder: what came since the last call is counted and added."""
    from ..streaming import incremental

    folder, state, parts = (scratch.folder(spark, n) for n in ("in", "state", "parts"))
    for half in (0, 1):
        _text_files(spark, sf_dir, folder, half)
        counts = incremental.token_counts_so_far(spark, folder, state, parts)
    return counts


@query(_SQL["q27_count_histogram"])
def q44_job_chain(spark, sf_dir):
    """A job writes items as JSON lines, and the next one's map function reads them."""
    folder, items, out = (scratch.folder(spark, n) for n in ("in", "items", "out"))
    _text_files(spark, sf_dir, folder)
    run_mapreduce(spark, _job(spark, "first", [folder], items, output_format="items", compress=True))
    return compile_job(spark, _job(spark, "second", [items], out, map_function_name="catalog_counts_of_items", reduce_function_name="catalog_histogram"))


@query(f"SELECT token, n FROM ({Q01}) WHERE token NOT IN ('the', 'and', 'de', 'der')")
def q45_auxiliary_file(spark, sf_dir):
    """Auxiliary data goes to the shared store by a transfer, and from there to every map task."""
    from ..control.transfer import transfer

    folder, far = scratch.folder(spark, "in"), scratch.folder(spark, "aux")
    _text_files(spark, sf_dir, folder)
    with tempfile.TemporaryDirectory() as local:  # the driver's own disk is where a transfer starts
        (Path(local) / "stop.json").write_text(json.dumps(["the", "and", "de", "der"]))
        transfer(spark, FileTransferJob(job_name="aux", job_priority=1, transfer_type="upload_auxiliary", input_file_name=f"{local}/stop.json", auxiliary_data_name="stop", output_dir=far))
    return compile_job(spark, _job(spark, "stop", [folder], "-", aux_dir=far, aux_map="stop"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, min(event_id) AS least FROM events GROUP BY ALL")
def q46_json_lines(spark, sf_dir):
    """Rows as JSON lines, compressed and in rolling parts, read back by schema."""
    folder = scratch.folder(spark, "json")
    sinks.write(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), folder, "json", compress=True, max_records_per_file=1000)
    back = readers.read_json_lines(spark, [folder], "event_id long, event_type string, props string")
    return back.groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


@query("SELECT event_id % 7 = 0 AS bad, count(*) AS n, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id END) AS BIGINT) AS ids FROM events GROUP BY 1")
def q47_bad_lines(spark, sf_dir):
    """Lines that are no JSON are kept apart, and the others lose nothing."""
    folder = scratch.folder(spark, "lines")
    line = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("{no")).otherwise(F.to_json(F.struct("event_id", "event_type")))
    sinks.write(table(spark, sf_dir, "events").select(line.alias("value")), folder, "lines")
    back = readers.read_json_lines(spark, [folder], "event_id long, event_type string", keep_bad=True)
    return back.groupBy(F.col(readers.BAD_LINE).isNotNull().alias("bad")).agg(F.count("*").alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))


@query()
def q48_sample_of_text_files(spark, sf_dir):
    """Which of a folder's files a sample by path takes, and that their lines come whole."""
    folder = scratch.folder(spark, "in")
    sinks.write(table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.md5("text")), folder, "values", max_records_per_file=50)
    files = readers.list_files(spark, [folder])
    few = {n for _, n in readers.sampled(files, 0.5)}
    lines = readers.read_text(spark, [folder], 0.5).count()
    whole = spark.read.text([f"{folder}/{n}" for n in sorted(few)]).count() if few else 0
    return spark.createDataFrame([(len(files), len(few), lines, whole)], "files int, taken int, n_lines long, n_whole long")
