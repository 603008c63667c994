import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import extraction, generate as G, splits
from factloom.operators.corrupt import preference_pairs
from factloom.operators.requests import request_metrics_windowed
from factloom.functions.chat import chat_example
from factloom.sources import jsonl
from factloom.streaming import jobs

T0 = datetime(2024, 1, 1)


def echo_model():
    def load():
        def generate(texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return list(texts)

        return generate

    return load


REQUESTS = [
    (1, '{"event_type":"x","entities":[]}'), (2, ""), (3, "y" * 8001), (4, "bad"), (5, "no json"), (6, '{"event_type":5}'),
]


def respond(df):
    out = jobs.extract_requests(df, jobs.model_generator(echo_model(), "request_id", "text"))
    status = extraction.request_status(F.col("admission"), F.col("latency_ms"), F.col("error"), F.col("valid_json"), F.col("loaded"))
    return out.select("request_id", "valid_json", "schema_valid", "typed_ok", "error", status.alias("status"))


EXPECTED = {
    1: (True, True, True, None, "ok"), 2: (False, False, False, None, "rejected"), 3: (False, False, False, None, "invalid_json"),
    4: (False, False, False, "ValueError: bad text", "error"), 5: (False, False, False, None, "invalid_json"),
    6: (True, False, False, None, "ok"),
}


def test_batch_extraction(spark):
    df = spark.createDataFrame(REQUESTS, "request_id long, text string")
    assert {r.request_id: tuple(r)[1:] for r in respond(df).collect()} == EXPECTED


def test_model_is_loaded_once_per_worker_and_called_by_batch(spark, folder):
    def counting():
        import os
        import uuid

        note = lambda kind: open(f"{folder}/{kind}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        note("load")

        def generate(texts):
            note("call")
            return [t.upper() for t in texts]

        return generate

    df = spark.range(0, 4000, 1, 8).selectExpr("id request_id", "concat('t', id) text", "id % 3 more")
    got = extraction.generate_outputs(df, counting).collect()
    assert sorted((r.request_id, r.raw_output, r.more) for r in got) == [(i, f"T{i}", i % 3) for i in range(4000)]
    names = os.listdir(folder)
    loads, calls = [[n for n in names if n.startswith(k)] for k in ("load", "call")]
    assert len(loads) == len({n.split("-")[1] for n in loads}) <= 8 and len(calls) < 40


def test_model_that_cannot_be_loaded(spark):
    def load():
        raise OSError("gone")

    df = spark.createDataFrame(REQUESTS, "request_id long, text string")
    out = jobs.extract_requests(df, jobs.model_generator(load, "request_id", "text"))
    status = extraction.request_status(F.col("admission"), F.col("latency_ms"), F.col("error"), F.col("valid_json"), F.col("loaded"))
    assert {r.request_id: r.s for r in out.select("request_id", status.alias("s")).collect()} == {i: "rejected" if i == 2 else "unavailable" for i in range(1, 7)}


def test_stream_equals_batch(spark, folder):
    df = spark.createDataFrame(REQUESTS, "request_id long, text string")
    df.repartition(3).write.parquet(f"{folder}/in")
    stream = jobs.request_stream(spark, f"{folder}/in", "request_id long, text string", per_trigger=1)
    jobs.run_available(respond(stream), f"{folder}/out", f"{folder}/state")
    assert {r.request_id: tuple(r)[1:] for r in spark.read.parquet(f"{folder}/out").collect()} == EXPECTED
    jobs.run_available(respond(stream), f"{folder}/out", f"{folder}/state")  # nothing is done twice
    assert spark.read.parquet(f"{folder}/out").count() == len(REQUESTS)


def events(minutes):
    return [(i, T0 + timedelta(minutes=m), 0.2, "ok") for i, m in enumerate(minutes)]


SCHEMA = "request_id long, start_ts timestamp, elapsed_s double, status string"


def test_windows_drop_late_rows(spark, folder):
    for i, minutes in enumerate([[1, 2, 61], [200], [201], [3], [400]]):
        spark.createDataFrame(events(minutes), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        for name in os.listdir(f"{folder}/in/{i}"):  # files are taken by age
            os.utime(f"{folder}/in/{i}/{name}", (1_700_000_000 + 60 * i,) * 2)
    stream = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    )
    jobs.run_available(jobs.windowed_metrics(stream), f"{folder}/out", f"{folder}/state")
    got = {r.window_start: r.n for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got["2024-01-01 01:00:00"] == 1 and got["2024-01-01 00:00:00"] == 2
    batch = request_metrics_windowed(spark.createDataFrame(events([1, 2, 61, 200, 3]), SCHEMA)).collect()
    assert {r.window_start: r.n for r in batch}["2024-01-01 00:00:00"] == 3


def test_intake_takes_each_id_once(spark, folder):
    """Copies in one batch and in later ones, however late, and after a restart."""
    out, state = f"{folder}/out", f"{folder}/state"
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    df = spark.createDataFrame(events([1, 2, 3]), SCHEMA)
    df.union(df).coalesce(1).write.parquet(f"{folder}/in/0")
    df.coalesce(1).write.parquet(f"{folder}/in/1")
    jobs.intake_once(stream(), out, state)
    spark.createDataFrame(events([90_000, 4, 5, 6]), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/2")
    jobs.intake_once(stream(), out, state)
    assert sorted(r.request_id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


def test_intake_costs_what_a_batch_brings(spark, folder):
    """Three hundred batches with a restart in between: the last cost what the first did."""
    from statistics import median

    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = lambda: spark.readStream.schema("request_id long, n long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    try:
        took = []
        for run in range(2):
            ids = spark.range(0, 150, 1, 150).selectExpr(f"id + {100 * run} AS request_id", f"{run} AS n")
            ids.write.mode("append").parquet(f"{folder}/in")
            query = jobs.intake_once(stream(), f"{folder}/out", f"{folder}/state")
            took.append(median(p.durationMs["addBatch"] for p in query.recentProgress if p.numInputRows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert sum(n.startswith("batch=") for n in os.listdir(f"{folder}/out")) >= 300
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(r.request_id for r in rows) == list(range(250)) and sum(r.n for r in rows) == 100
    assert took[1] < 2 * took[0], took


def test_intake_with_bounded_state_and_rows_without_id(spark, folder):
    for i, rows in enumerate([[(1, 0), (1, 1), (None, 2), (None, 3)], [(2, 60), (1, 61)], [(3, 600)], [(1, 601), (None, 602)]]):
        spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in rows], "request_id long, start_ts timestamp").coalesce(1).write.parquet(f"{folder}/in/{i}")
        stream = spark.readStream.schema("request_id long, start_ts timestamp").option("recursiveFileLookup", True).parquet(f"{folder}/in")
        jobs.intake_once(stream, f"{folder}/out", f"{folder}/state", within="2 hours")
    ids = [r.request_id for r in spark.read.parquet(f"{folder}/out").collect()]
    assert sorted(ids, key=str) == [1, 1, 2, 3, None, None, None]  # the copy ten hours later counts as new


def test_late_rows_are_kept_aside(spark, folder):
    """Every row is in a closed window, in an open one or in the late table; a batch that runs again changes nothing."""
    out = f"{folder}/out"
    stream = lambda: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    for i, minutes in enumerate([[1, 2, 61], [55, 125, 130], [3, 70, 131], [140, 185, None]]):
        rows = [(10 * i + k, T0 + timedelta(minutes=m) if m is not None else None, 0.2, "ok") for k, m in enumerate(minutes)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
        jobs.split_late(stream(), out, f"{folder}/split")
        if i % 2:
            jobs.closed_windows(spark, SCHEMA, out, f"{folder}/windows")
    landed = lambda name: sorted(r.request_id for r in spark.read.schema(SCHEMA).parquet(f"{out}/{name}/batch=*").collect())
    assert landed("late") == [20, 21, 32] and len(landed("rows")) == 9  # minute 55 was in time: its window ended at 60, the mark was 51
    closed = {r.window_start: r.n for r in spark.read.parquet(f"{out}/windows").collect()}
    assert closed == {"2024-01-01 00:00:00": 3, "2024-01-01 01:00:00": 1}
    assert {n for n in os.listdir(f"{out}/marks")} == {f"batch={k}" for k in range(4)}


def test_totals_of_a_stream(spark, folder):
    for i, minutes in enumerate([[1, 2, 61], [200, 3]]):
        spark.createDataFrame(events(minutes), SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    jobs.latest_totals(request_metrics_windowed(stream), f"{folder}/out", f"{folder}/state")
    batch = request_metrics_windowed(spark.createDataFrame(events([1, 2, 61, 200, 3]), SCHEMA))
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == sorted(map(tuple, batch.collect()))


def test_shared_folder_has_to_be_named_on_a_cluster():
    from types import SimpleNamespace

    from factloom.session import shared_dir

    for master, named in (("spark://host:7077", None), ("yarn", ""), ("local-cluster[2,1,1024]", None)):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": named}, sparkContext=SimpleNamespace(master=master)))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_filters_reach_the_scan(spark):
    from factloom.functions.recovery import recover
    from factloom.plans import inputs

    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ex = plan(inputs.examples(spark, sf).filter("example_id = 5"))
    assert "EqualTo(o_orderkey,5)" in ex and "RoundRobin" not in ex
    docs = plan(recover(spark.read.parquet(f"{sf}/documents.parquet"), "text").filter("lang = 'en'"))
    assert "EqualTo(lang,en)" in docs
    assert "RoundRobin" not in plan(inputs.pairs(spark, sf)) + plan(inputs.outputs(spark, sf))


def test_round_trip_of_splits(spark, folder):
    ex = G.generate_examples(spark.range(60), "id")
    rows = ex.withColumn("messages", chat_example(F.col("text"), F.col("record_json")))
    jsonl.save_splits(splits.exact_split(rows, "example_id", 1), f"{folder}/sft", ["messages", "scenario"])
    train = jsonl.scan_chat(spark, f"{folder}/sft/split=train")
    assert train.count() == 54 and train.columns == ["messages"]
    for r in train.collect():
        assert [m.role for m in r.messages] == ["system", "user", "assistant"]
        assert json.loads(r.messages[2].content)["event_type"]
    pairs = splits.exact_split(preference_pairs(ex), "example_id", 1)
    jsonl.save_splits(pairs, f"{folder}/pairs", ["prompt", "chosen", "rejected"])
    both = jsonl.scan_splits(spark, {s: f"{folder}/pairs/split={s}" for s in ("train", "eval")})
    assert {r["split"]: r["count"] for r in both.groupBy("split").count().collect()} == {"train": 54, "eval": 6}


def test_optional_documents(spark, folder):
    schema = "name string, valid_json_rate double"
    assert jsonl.load_document(spark, f"{folder}/none.json", schema).collect() == []
    with open(f"{folder}/a.json", "w") as f:
        json.dump([{"name": "m", "valid_json_rate": 0.5}, {"name": "n"}], f, indent=2)
    assert jsonl.load_document(spark, f"{folder}/a.json", schema).count() == 2
    for m in ("x", "y"):
        spark.createDataFrame([(m, 1.0)], schema).coalesce(1).write.json(f"{folder}/res/{m}")
    found = jsonl.load_results(spark, [f"{folder}/res/{m}" for m in ("x", "gone", "y")], schema)
    assert sorted(r.name for r in found.collect()) == ["x", "y"]
    assert jsonl.load_results(spark, [f"{folder}/gone"], schema).count() == 0


def test_stage_is_built_once(spark, folder):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = f"{folder}/stage"
    assert jsonl.stage(spark, path, build).count() == 3
    jsonl.stage(spark, path, build)
    assert len(built) == 1
    jsonl.stage(spark, path, build, force=True)
    assert len(built) == 2
    os.remove(f"{path}/_SUCCESS")  # a half-written output does not count
    jsonl.stage(spark, path, build)
    assert len(built) == 3


def test_stage_follows_its_inputs(spark, folder):
    """Changed input rebuilds, unchanged input does not; what breaks off leaves the old result."""
    built, path, source = [], f"{folder}/stage", f"{folder}/in"

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS id")

    def broken():
        return spark.read.parquet(source).selectExpr("assert_true(id < 0)", "id")

    rows = lambda make=build, **more: sorted(r.id for r in jsonl.stage(spark, path, make, inputs=[source], **more).collect())
    spark.range(3).write.parquet(source)
    assert rows() == [0, 2, 4] and rows() == [0, 2, 4] and len(built) == 1
    spark.range(3, 5).write.mode("append").parquet(source)
    old = jsonl.current(spark, path)
    with pytest.raises(Exception):
        rows(broken)
    assert jsonl.current(spark, path) == old and sorted(r.id for r in spark.read.parquet(old).collect()) == [0, 2, 4]
    assert rows() == [0, 2, 4, 6, 8] and len(built) == 2
    assert sorted(r.id for r in spark.read.parquet(old).collect()) == [0, 2, 4]  # kept for those who still read it
    assert rows(force=True) == [0, 2, 4, 6, 8] and not os.path.exists(old)


def test_results_are_replaced_as_a_whole(spark, folder):
    schema, path = "model string, rate double", f"{folder}/results"
    load = lambda: sorted((r.model, r.rate) for r in jsonl.load_results(spark, [f"{jsonl.current(spark, path)}/_folder={m}" for m in ("a", "b", "c")], schema).collect())
    assert load() == []
    jsonl.save_results(spark.createDataFrame([("a", 0.5), ("b", 0.25)], schema), path)
    assert load() == [("a", 0.5), ("b", 0.25)]
    with pytest.raises(Exception):
        jsonl.save_results(spark.createDataFrame([("c", 1.0)], schema).withColumn("rate", F.raise_error(F.lit("gone")).cast("double")), path)
    assert load() == [("a", 0.5), ("b", 0.25)]
    jsonl.save_results(spark.createDataFrame([("c", 1.0)], schema), path)
    assert load() == [("c", 1.0)]


def test_indented_json(spark):
    from factloom.functions.json_text import indented

    kind = "s struct<a:string,n:bigint,x:double,b:boolean,v:array<struct<k:string,l:array<int>>>,e:struct<z:int>>"
    rows = [(("q\"\\\n é", 1, 0.5, True, [("k", [1, None]), (None, []), None], (None,)),), ((None, None, None, None, None, None),), (None,)]
    df = spark.createDataFrame(rows, kind)
    got = [r.j for r in df.select(indented(F.col("s"), df.schema["s"].dataType).alias("j")).collect()]
    value = {"a": "q\"\\\n é", "n": 1, "x": 0.5, "b": True, "v": [{"k": "k", "l": [1, None]}, {"l": []}, None], "e": {}}
    assert got == [json.dumps(value, indent=2, ensure_ascii=False), "{}", None]


def test_readable_sample(spark):
    ex = G.generate_examples(spark.range(5), "id")
    shown = jsonl.readable_sample(ex, "example_id", splits.shuffle_key("example_id", 1), ["text", "scenario"]).collect()
    assert len(shown) == 1 and "\n" in shown[0].sample and json.loads(shown[0].sample)["text"]


@pytest.mark.parametrize(
    "latency,error,valid,loaded,expected",
    [(1.0, None, True, True, "ok"), (1.0, None, False, True, "invalid_json"), (120001.0, None, True, True, "timeout"),
     (1.0, "boom", False, True, "error"), (1.0, None, True, False, "unavailable")],
)
def test_status(spark, latency, error, valid, loaded, expected):
    df = spark.createDataFrame([(latency, error, valid)], "l double, e string, v boolean")
    got = df.select(extraction.request_status(F.lit("ok"), F.col("l"), F.col("e"), F.col("v"), F.lit(loaded)).alias("s"))
    assert got.collect()[0].s == expected


def test_dates(spark):
    df = spark.createDataFrame([("March 5, 2024",), ("2024-03-05",), ("Smarch 1, 2024",), (None,)], "raw string")
    assert [r.iso for r in df.select(extraction.normalized_date(F.col("raw")).alias("iso")).collect()] == ["2024-03-05", None, None, None]
