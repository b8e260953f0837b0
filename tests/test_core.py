import fcntl
import gzip
import json
import math
import os
import re
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from mrflow.config import EngineConfig
from mrflow.control.scheduler import JobQueue, Runner
from mrflow.control.transfer import transfer
from mrflow.functions import registry
from mrflow.operators import native, opaque
from mrflow.plans.job import FileTransferJob, InvalidJob, MapReduceJob, ScriptJob, auxiliary, compile_job, from_dict, run_mapreduce, run_script
from mrflow.sources import readers, scratch, sinks
from mrflow.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests

ROOT = Path(__file__).resolve().parents[1]
LINES = ["the cat saw the dog", "", "a dog"]


@registry.mapper("words", schema="key string, n long")
def words(line, aux):
    return [(w, 1) for w in line.split() if not aux or w not in aux]


@registry.mapper("of_items", schema="key string, n long", merge=lambda a, b: (a[0], a[1] + b[1]))
def of_items(line, aux):
    return [tuple(json.loads(line))]


@registry.reducer("total", schema="key string, n long", merge=lambda a, b: (a[0], a[1] + b[1]))
def total(group, aux):
    items = list(group)
    return [(items[0][0], sum(n for _, n in items))]


@registry.mapper("native_words", native=True)
def native_words(df, aux=None):
    return df.select(F.explode(F.split("value", " ")).alias("key")).filter("key <> ''").withColumn("n", F.lit(1).cast("long"))


@registry.reducer("native_total", native=True)
def native_total(df, aux=None):
    return df.groupBy("key").agg(F.sum("n").alias("n"))


def put(folder, name, lines, gz=False):
    folder.mkdir(exist_ok=True)
    text = "\n".join(lines)
    if gz:
        with gzip.open(folder / f"{name}.gz", "wt") as f:
            f.write(text)
    else:
        (folder / name).write_text(text)


def job(folder, out, **more):
    return MapReduceJob(**{"job_name": "count", "job_priority": 1, "inputs": [str(folder)], "map_function_name": "words", "reduce_function_name": "total", "output_dir": str(out)} | more)


def counts(df):
    return {r["key"]: r["n"] for r in df.collect()}


WANT = {"the": 2, "cat": 1, "saw": 1, "dog": 2, "a": 1}


def test_sources(spark, tmp_path):
    put(tmp_path / "a", "x.txt", LINES)
    put(tmp_path / "b", "y", ["é ü"], gz=True)
    put(tmp_path / "b", "_hidden", ["no"])
    put(tmp_path / "b", ".dot", ["no"])
    (tmp_path / "b" / "sub").mkdir()
    both = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert sorted(r[0] for r in readers.read_text(spark, both).collect()) == sorted([*LINES, "é ü"])
    assert readers.read_text(spark, both, seen={str(tmp_path / "a/x.txt")}).count() == 1
    assert readers.read_text(spark, [str(tmp_path / "b" / "sub")]).count() == 0
    with pytest.raises(TypeError):
        readers.read_text(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        readers.read_text(spark, [str(tmp_path / "_x")])


def test_downsample_is_nested_and_stable_by_path():
    files = [("/a", f"f{i}") for i in range(400)]
    few, half = (readers.sampled(files, r) for r in (0.1, 0.5))
    assert set(few) < set(half) and 10 < len(few) < 80 and 140 < len(half) < 260
    assert readers.sampled(files, 0.1) == few and readers.sampled(files, 1.0) == files
    # the path counts, so folders whose files are all named alike are sampled too
    assert 140 < len(readers.sampled([(f"/d{i}", "part-00000") for i in range(400)], 0.5)) < 260


def test_files_still_being_written_wait(spark, tmp_path):
    put(tmp_path / "in", "x", ["one"])
    put(tmp_path / "in", "y.tmp", ["two"])
    put(tmp_path / "in", "z", ["three"])
    names = lambda **m: [n for _, n in readers.list_files(spark, [str(tmp_path / "in")], **m)]
    assert names() == ["x", "z"]
    with (tmp_path / "in" / "z").open("a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        locked = subprocess.run([sys.executable, "-c", f"from mrflow.sources import readers; print(readers._locked({str(tmp_path / 'in' / 'z')!r}), readers._locked({str(tmp_path / 'in' / 'x')!r}))"], capture_output=True, text=True, cwd=ROOT)
        assert locked.stdout.split() == ["True", "False"]
    assert names(settle=60.0) == []
    old = time.time() - 100
    os.utime(tmp_path / "in" / "x", (old, old))
    assert names(settle=60.0) == ["x"]


def test_code_goes_to_the_workers(tmp_path):
    """A query with Python functions and a user's project run in a folder where no worker finds them."""
    project = tmp_path / "lib" / "wordproject"
    project.mkdir(parents=True)
    (project / "__init__.py").write_text("from mrflow.functions import registry\nfrom wordproject.cut import cut\nregistry.mapper('cut', schema='key string, n long')(cut)\nregistry.reducer('sum_up', schema='key string, n long')(lambda group, aux: [(g[0][0], sum(n for _, n in g)) for g in [list(group)]])\n")
    (project / "cut.py").write_text("def cut(line, aux):\n    return [(w, 1) for w in line.split()]\n")
    put(tmp_path / "in", "x", LINES)
    (tmp_path / "run.py").write_text(f"""
import sys
sys.path[:0] = [{str(ROOT)!r}, {str(tmp_path / 'lib')!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from mrflow.plans import catalog
from mrflow.plans.job import MapReduceJob, compile_job
n = catalog.queries()["q31_conversation_walk"](spark, "/root/testdata/sf0.001").count()
job = MapReduceJob(job_name="p", job_priority=1, inputs=[{str(tmp_path / 'in')!r}], map_function_name="cut", reduce_function_name="sum_up", project_name="wordproject")
print(n > 0, sorted(tuple(r) for r in compile_job(spark, job).collect()))
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "run.py"], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert ran.stdout.strip() == f"True {sorted(WANT.items())}", ran.stderr[-2000:]


def test_a_job_reads_what_another_wrote(spark, tmp_path):
    put(tmp_path / "in", "x", LINES)
    for append in (False, True):
        run_mapreduce(spark, job(tmp_path / "in", tmp_path / f"items{append}", output_format="items", delete_job_data=not append))
        run_mapreduce(spark, job(tmp_path / "in", tmp_path / f"items{append}", output_format="items", delete_job_data=not append))
        second = job(tmp_path / f"items{append}", tmp_path / "o", map_function_name="of_items")
        assert counts(compile_job(spark, second)) == {k: n * (1 + append) for k, n in WANT.items()}
    with pytest.raises(InvalidJob):
        job(tmp_path / "in", tmp_path / "o", output_format="csv")


def test_a_run_that_broke_off_counts_once(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "x", LINES)
    j = job(tmp_path / "in", tmp_path / "out", hold_state=True, delete_job_data=False)
    with monkeypatch.context() as m:
        m.setattr(incremental.time, "time", lambda: 1 / 0)  # after the output, before the ledger
        with pytest.raises(ZeroDivisionError):
            incremental.run_delta(spark, j)
    assert not incremental.has_ledger(spark, j) and len(incremental.run_delta(spark, j)) == 1
    assert counts(incremental.merged_output(spark, j)) == WANT


def test_batches_of_long_values_stay_small():
    schema = opaque._arrow("k long, t string, a array<string>")
    items = [(i, "x" * 1_000_000, ["y" * 500_000]) for i in range(40)]
    sizes = [b.num_rows for b in opaque._batches(iter(items), schema)]
    assert sum(sizes) == 40 and max(sizes) <= 6


def test_scratch_goes(spark, tmp_path):
    before = scratch.mark()
    kept = [scratch.keep(spark.range(3), "x") for _ in range(3)]
    assert [k.count() for k in kept] == [3, 3, 3]
    paths = scratch._made()[before:]
    scratch.clear(spark, before, but=1)
    assert [scratch.exists(spark, p) for p in paths] == [False, False, True] and kept[2].count() == 3


def test_bad_json_lines(spark, tmp_path):
    put(tmp_path / "j", "x", ['{"a": 1}', "{no"])
    assert [r["_corrupt_record"] for r in readers.read_json_lines(spark, [str(tmp_path / "j")], "a long", keep_bad=True).orderBy("a").collect()] == ["{no", None]
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|Malformed"):
        readers.read_json_lines(spark, [str(tmp_path / "j")], "a long").collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), (None, 2, [1.5])], "k string, n long, v array<double>").coalesce(1)
    sinks.write(df, str(tmp_path / "i"), "items")
    assert sorted(map(json.dumps, map(json.loads, readers.read_text(spark, [str(tmp_path / "i")]).toPandas()["value"]))) == ['["a", 1, null]', "[null, 2, [1.5]]"]
    sinks.write(df.select("k"), str(tmp_path / "v"), "values", compress=True, max_records_per_file=1)
    assert len(list((tmp_path / "v").glob("part-*.gz"))) == 2
    sinks.write(df.select("k"), str(tmp_path / "v"), "values", compress=True, append=True)
    assert readers.read_text(spark, [str(tmp_path / "v")]).count() == 4
    with pytest.raises(ValueError):
        sinks.write(df, str(tmp_path / "x"), "csv")


def test_both_paths_agree_whatever_the_partitions(spark, tmp_path):
    put(tmp_path / "in", "x", LINES)
    for n in (1, 3, 16):
        assert counts(compile_job(spark, job(tmp_path / "in", tmp_path / "o", shuffle_partitions=n))) == WANT
    assert counts(compile_job(spark, job(tmp_path / "in", tmp_path / "o", map_function_name="native_words", reduce_function_name="native_total"))) == WANT
    assert counts(compile_job(spark, job(tmp_path / "in", tmp_path / "o", streaming_group=True))) == WANT
    identity = compile_job(spark, job(tmp_path / "in", tmp_path / "o", reduce_function_name="identity"))
    assert identity.count() == 7


def test_groups_come_sorted_and_whole(spark):
    rows = [(None, 3), (None, 1), (float("nan"), 2), (float("nan"), 1), (0.0, 1), (-0.0, 2), (1.0, 5), (1.0, 4)] * 3
    df = spark.createDataFrame(rows, "k double, v long").repartition(5)

    def values(group, aux):
        items = list(group)
        return [(repr(items[0][0]), ",".join(str(v) for _, v in items))]

    got = sorted(tuple(r) for r in opaque.reduce_groups(df, ["k"], values, "k string, v string").collect())
    assert len(got) == 4
    assert ("None", "1,1,1,3,3,3") in got and ("1.0", "4,4,4,5,5,5") in got and ("nan", "1,1,1,2,2,2") in got


def test_a_reducer_may_leave_items_unread(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), "id")
    got = opaque.reduce_groups(df, ["k"], lambda group, aux: [next(group)], "k long, id long", partitions=1).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 2)]


def test_maps_are_sorted_by_their_entries(spark):
    df = spark.sql("SELECT 1 AS k, map('b', 2) AS m UNION ALL SELECT 1, map('a', 1)")
    got = opaque.reduce_groups(df, ["k"], lambda group, aux: [(str([dict(m) for _, m in group]),)], "x string").first()[0]
    assert got == "[{'a': 1}, {'b': 2}]"


def test_merging_parts_is_the_whole(spark):
    df = spark.createDataFrame([(x,) for x in LINES * 4], "value string")
    one = native.count_by(native.explode_tokens(df, "value"), "token")
    half = [native.count_by(native.explode_tokens(df.limit(5), "value"), "token"), native.count_by(native.explode_tokens(df.exceptAll(df.limit(5)), "value"), "token")]
    assert sorted(map(tuple, native.merge_sums(half, ["token"], ["n"]).collect())) == sorted(map(tuple, one.collect()))


def test_plans(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    plan = opaque.reduce_groups(df, ["k"], lambda g, a: [], "k long")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Sort [k") < plan.index("Exchange")
    agg = native.count_by(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in agg
    small = native.lookup(df, spark.createDataFrame([(1, "a")], "k long, x string").coalesce(1), "k")
    assert small.count() == 100


def test_auxiliary(spark, tmp_path):
    put(tmp_path / "in", "x", LINES)
    (tmp_path / "stop.data").write_text(json.dumps(["the"]))
    got = counts(compile_job(spark, job(tmp_path / "in", tmp_path / "o", aux_dir=str(tmp_path), aux_map="stop")))
    assert got == {k: v for k, v in WANT.items() if k != "the"}
    assert auxiliary(spark, None, None) is None and auxiliary(spark, f"file://{tmp_path}", "stop") == ["the"]
    with pytest.raises(FileNotFoundError):
        auxiliary(spark, str(tmp_path), "none")


def test_incremental_runs(spark, tmp_path):
    put(tmp_path / "in", "x", LINES)
    j = job(tmp_path / "in", tmp_path / "out", hold_state=True, delete_job_data=False)
    assert len(incremental.run_delta(spark, j)) == 1 and incremental.run_delta(spark, j) == []
    put(tmp_path / "in", "y", ["dog"])
    put(tmp_path / "in", "x", ["changed"])  # identity is the path
    assert len(incremental.run_delta(spark, j)) == 1
    merged = native.merge_sums([spark.read.json(str(tmp_path / "out"))], ["key"], ["n"])
    assert counts(merged) == WANT | {"dog": 3} == counts(incremental.merged_output(spark, j))
    with pytest.raises(InvalidJob):
        incremental.merged_output(spark, job(tmp_path / "in", tmp_path / "out", reduce_function_name="native_total"))
    run_mapreduce(spark, job(tmp_path / "in", tmp_path / "out"))  # without hold_state: all files, and the state is gone
    assert not incremental.has_ledger(spark, j)
    assert counts(spark.read.json(str(tmp_path / "out"))) == {"changed": 1, "dog": 1}


def test_streaming_counts(spark, tmp_path):
    put(tmp_path / "in", "x", LINES)
    where = [str(tmp_path / n) for n in ("in", "checkpoint", "parts")]
    first = {r["token"]: r["n"] for r in incremental.token_counts_so_far(spark, *where).collect()}
    assert first == WANT
    put(tmp_path / "in", "y", ["dog"])
    for _ in range(2):
        again = {r["token"]: r["n"] for r in incremental.token_counts_so_far(spark, *where).collect()}
        assert again == WANT | {"dog": 3}


def test_job_validation():
    with pytest.raises(InvalidJob, match="map_function_name"):
        MapReduceJob(job_name="x", job_priority=0, inputs=["a"], reduce_function_name="total")
    assert ScriptJob(job_name="x", job_priority=0, script_location="y").job_priority == 0
    with pytest.raises(InvalidJob):
        MapReduceJob(job_name="x", job_priority=1, inputs="a", map_function_name="m", reduce_function_name="r")
    with pytest.raises(InvalidJob):
        FileTransferJob(job_name="x", job_priority=1, transfer_type="teleport")
    with pytest.raises(InvalidJob):
        from_dict({"job_type": "script", "job_name": "x", "job_priority": 1, "script_location": "y", "surprise": 1})
    with pytest.raises(registry.ProjectNotFound):
        registry.find("map", "nowhere")
    with pytest.raises(registry.ProjectNotFound):
        registry.find("map", "words", "no_such_project")


def test_queue_and_runner(tmp_path):
    queue, ran = JobQueue(tmp_path), []
    make = lambda name, p, **m: ScriptJob(job_name=name, job_priority=p, script_location="s", **m)
    for j in (make("b", 1), make("a", 1), make("top", 5), make("once", 3, run_once=True), make("bad", 2, group_name="g"), make("child", 1, group_name="g"), make("alone", 0)):
        queue.submit(j)
    queue.submit(make("top", 4, script_arguments=["new"]))
    assert [j.job_name for j in queue.jobs()] == ["top", "once", "bad", "b", "a", "child", "alone"]
    assert queue.get("top").script_arguments == ["new"] and queue.get("none") is None

    def run(j):
        ran.append(j.job_name)
        if j.job_name == "bad":
            raise RuntimeError("bad")

    runner = Runner(queue, runners={ScriptJob: run})
    log = runner.run(max_cycles=2)
    assert ran == ["top", "once", "bad", "b", "a", "alone", "top", "b", "a", "alone"]
    assert "RuntimeError" in next(e for e in log if not e["success"])["exception"]
    assert len((tmp_path / "failed.jsonl").read_text().splitlines()) == 1
    assert len(runner.runtimes("top")) == 2 and runner.estimate("top") >= 0 and runner.estimate("bad") is None
    assert queue.delete("a") and not queue.delete("a") and queue.delete_group(None) == []
    queue.submit(make("again", 9, force_run=True))
    ran.clear()
    runner.run(max_cycles=1)
    assert ran == ["again", "again", "top", "b", "alone"]
    assert Runner(queue, runners={ScriptJob: run}).run(5, stop=lambda: True) == []


def test_scripts_and_transfers(spark, tmp_path):
    (tmp_path / "s.py").write_text(f"import sys, pathlib; pathlib.Path(r'{tmp_path}/out').write_text(sys.argv[1])")
    run_script(ScriptJob(job_name="s", job_priority=1, script_location=str(tmp_path / "s.py"), script_arguments=["hi; ls"]))
    assert (tmp_path / "out").read_text() == "hi; ls"
    put(tmp_path / "local", "a.txt", ["one"])
    make = lambda kind, **m: FileTransferJob(job_name="t", job_priority=1, transfer_type=kind, **m)
    assert transfer(spark, make("upload", input_dir=str(tmp_path / "local"), output_dir=str(tmp_path / "far"), compress=True)) == ["a.txt.gz"]
    assert transfer(spark, make("upload", input_dir=str(tmp_path / "local"), output_dir=str(tmp_path / "far"), compress=True, reload_files=False)) == []
    assert transfer(spark, make("download", input_dir=str(tmp_path / "far"), output_dir=str(tmp_path / "back"))) == ["a.txt.gz"]
    assert gzip.open(tmp_path / "back/a.txt.gz", "rt").read() == "one"
    transfer(spark, make("upload_auxiliary", input_file_name=str(tmp_path / "local/a.txt"), auxiliary_data_name="x", output_dir=str(tmp_path / "far")))
    assert (tmp_path / "far/x.data").exists() and (tmp_path / "local/a.txt").exists()
    assert transfer(spark, make("delete", output_dir=str(tmp_path / "far"))) and not (tmp_path / "far").exists()


def test_config():
    conf = EngineConfig(shuffle_partitions=12, memory_per_executor="4g").spark_conf()
    assert conf["spark.sql.shuffle.partitions"] == "12" and conf["spark.executor.memory"] == "4g"


def test_nan_keys_are_one():
    assert opaque._same((math.nan,)) == opaque._same((float("nan"),)) and opaque._same((1,)) != opaque._same((True,))


def test_merging_in_the_task_and_after_it_agree(spark):
    rows = [(t, i) for i in range(50) for t in ("a b a", "", "c é", None)]
    lines = spark.createDataFrame(rows, "text string, i long").select("text").repartition(3)
    count = lambda line, aux: [(w, 1) for w in (line or "").split(" ")]
    add = lambda a, b: (a[0], a[1] + b[1])
    total = lambda group, aux: [(g[0][0], sum(n for _, n in g)) for g in [list(group)]]
    for most in (2, 100):
        inside = opaque.flat_map(lines, count, "token string, n long", keys=["token"], merge=add, most=most)
        after = opaque.combine(opaque.flat_map(lines, count, "token string, n long"), ["token"], add, most)
        for items in (inside, after):
            got = {tuple(r) for r in opaque.reduce_groups(items, ["token"], total, "token string, n long").collect()}
            assert got == {("a", 100), ("b", 50), ("", 100), ("c", 50), ("é", 50)}
    floats = spark.createDataFrame([(math.nan, 1), (0.0, 1), (-0.0, 2), (math.nan, 4)], "x double, n long").coalesce(1)
    assert sorted(r["n"] for r in opaque.combine(floats, ["x"], add).collect()) == [3, 5]


@registry.mapper("letters", schema="key string, n long", counts=True)
def letters(lines, aux):
    return [c for line in lines if line for c in line if not aux or c not in aux]


def test_items_that_add_up_are_one_before_they_reach_a_reducer(spark, tmp_path):
    """Spark adds them in the task and after one exchange; a reducer gets one item of each key."""
    lines = ["the cat", "", "the dog"] * 400
    want = {c: "".join(lines).count(c) for c in set("".join(lines))}
    put(tmp_path / "in", "x", lines)
    put(tmp_path / "in", "y", lines)
    for n in (None, 1, 5):
        df = compile_job(spark, job(tmp_path / "in", tmp_path / "o", map_function_name="letters", shuffle_partitions=n))
        assert counts(df) == {c: 2 * k for c, k in want.items()}
    plan = compile_job(spark, job(tmp_path / "in", tmp_path / "o", map_function_name="letters"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    rows = spark.createDataFrame([(k, 1 << 40) for k in ("a", None, "b", None)] * 5, "k string, n long").repartition(3)
    seen = lambda group, aux: [(k, n, 1) for k, n in group]
    got = opaque.reduce_groups(rows, ["k"], seen, "k string, n long, items long", merge=registry.add)
    assert {tuple(r) for r in got.collect()} == {("a", 5 << 40, 1), (None, 10 << 40, 1), ("b", 5 << 40, 1)}
    # what doesn't add up as whole numbers comes as it is
    texts = opaque.reduce_groups(rows.selectExpr("k", "'x' AS t"), ["k"], lambda group, aux: [(len(list(group)),)], "n long", merge=registry.add)
    assert sorted(r["n"] for r in texts.collect()) == [5, 5, 10]


def test_counting_keys_of_some_lines_at_once(spark):
    lines = ["a b a", "", None, "c é", "x" * 50] * 30
    df = spark.createDataFrame([(x,) for x in lines], "text string").repartition(2)
    words = lambda some, aux: [w for line in some if line for w in line.split() if w != aux]
    for most in (1, 100):
        items = opaque.count_keys(df, words, "w string, n long", aux="c", most=most)
        got = {tuple(r) for r in opaque.sum_up(items, ["w"]).collect()}
        assert got == {("a", 60), ("b", 30), ("é", 30), ("x" * 50, 30)}
    for schema in ("w double, n long", "w string, n int", "w string, v string, n long"):
        with pytest.raises(ValueError):
            opaque.count_keys(df, words, schema)
    assert [len(x) for x in opaque._some(iter(["x" * (1 << 19)] * 5 + [None] * 3))] == [2, 2, 4]
    assert [len(x) for x in opaque._some(iter([""] * 25_000))] == [10_000, 10_000, 5_000]
    big = opaque.Counter({f"{i}" + "y" * 500_000: i for i in range(40)})
    batches = list(opaque._counted(big, opaque._arrow("w string, n long")))
    assert max(b.num_rows for b in batches) <= 17 and sum(b.num_rows for b in batches) == 40
    with pytest.raises(ValueError):
        registry.mapper("bad", schema="w string, n long", counts=True, merge=max)


def test_words_of_joined_lines_are_those_of_each():
    from mrflow.plans import catalog

    lines = ["ΟΔΟΣ", "ΣΑ a_b", "", None, "_", "İx don't", "end", "٣x ½ Ⅳ", "x\ny"]
    each = [w for line in lines for w in re.findall(r"[^\W_]+", (line or "").lower())]
    assert catalog._words(lines, None) == each and each[:2] == ["οδος", "σα"]
    assert catalog._words(lines, ["a", "b"]) == [w for w in each if w not in "ab"]
