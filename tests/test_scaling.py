"""Steps whose cost has to stay small on large tables: the join of scores, picking, recovery, elements, written pairs."""

import os

from pyspark.sql import functions as F

from factloom.functions.draws import pick, pick_from, places_of
from factloom.functions.recovery import SPACE, recover, strip
from factloom.functions.schema_rules import is_kind, objects
from factloom.operators import generate as G
from factloom.operators import scoring
from factloom.session import spread, written
from factloom.sources import jsonl


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_truth_is_not_broadcast(spark, capsys):
    record = F.lit('{"event_type":"x","entities":[{"type":"person","name":"A"}]}')
    ids = spark.range(20).withColumnRenamed("id", "example_id")
    out = ids.select(F.lit("m").alias("model"), "example_id", record.alias("raw_output"))
    scores = scoring.score(out, ids.select("example_id", record.alias("record_json")))
    plan = plan_of(scores, capsys)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r.n for r in scores.groupBy("entity_f1").agg(F.count("*").alias("n")).collect()] == [20]


def test_places_give_what_the_rest_of_the_array_gives(spark, capsys):
    pool, free = ["a", "b", "c", "d", "e"], [None, "a", "c", "e", "other"]
    df = spark.range(9).crossJoin(spark.createDataFrame([(x, y) for x in free for y in free], "x string, y string"))
    avoided = [F.col("x"), F.col("y")]
    items = F.array(*[F.lit(v) for v in pool])
    for taken in ([], avoided[:1], avoided):
        same = pick(items, F.col("id"), taken) == pick_from(pool, F.col("id"), [places_of(pool, c) for c in taken])
        assert df.filter(~F.coalesce(same, F.lit(False))).count() == 0
    assert "array_except" not in plan_of(G.with_slots(spark.range(3), "id"), capsys)


def test_odd_ends_and_fences(spark, capsys):
    ends = ["", *SPACE, " \n", "　\t", "x", "}", "é "]
    texts = [a + b + c for a in ends for b in ("", "a b", "{}") for c in ends]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r.s for r in df.select("id", strip(F.col("t")).alias("s")).orderBy("id").collect()]
    assert got == [t.strip(SPACE) for t in texts]
    cases = {
        '````{"a":1}```': '{"a":1}', '```json{"a":1}``` {"b":2}': '{"a":1}', 'x ```json\n{"a":1}': '{"a":1}', "``````": None,
        '{"a":1} and {': '{"a":1}', '} {"a":1}': '{"a":1}', "}{": None, "{}": "{}", "{": None, "}": None, '[1] ': "[1]", 'a{"b":1}c': '{"b":1}',
    }
    df = recover(spark.createDataFrame([(t,) for t in cases], "raw_output string"))
    assert {r.raw_output: r.json_text for r in df.collect()} == cases
    assert "$[0]" not in plan_of(df.select("valid_json", "json_text"), capsys)


def test_elements_as_structs(spark):
    text = '{"entities":[{"name":"A","type":null,"more":1},5,null,"x",{},[{"name":"B"}]],"dates":{"raw":"r"},"metrics":null}'
    v = F.try_parse_json(F.lit(text))
    df = spark.range(1).select(objects(v, "entities").alias("e"), *[objects(v, n).alias(n) for n in ("dates", "metrics", "financials")])
    r = df.select(
        F.transform("e", lambda e: e.isNotNull()).alias("there"), F.transform("e", lambda e: is_kind(e["name"], "string")).alias("text"),
        F.transform("e", lambda e: is_kind(e["type"], "null")).alias("null"), "dates", "metrics", "financials",
    ).collect()[0]
    assert r.there == [True, False, False, False, True, False] and r.text == [True, None, None, None, None, None]
    assert r.null == [True, None, None, None, None, None] and (r.dates, r.metrics, r.financials) == (None, None, None)


def test_pairs_are_written_compressed(spark, folder):
    df = spark.createDataFrame([("train", 1, "ä"), ("eval", 2, None)], "split string, id int, t string")
    jsonl.save_splits(df, f"{folder}/p", ["id", "t"])
    back = jsonl.scan_splits(spark, {s: f"{folder}/p/split={s}" for s in ("train", "eval")}, "id int, t string")
    assert sorted(map(tuple, back.collect())) == [(1, "ä", "train"), (2, None, "eval")]
    files = [f for _, _, names in os.walk(f"{folder}/p") for f in names if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_more_tasks_than_cores(spark):
    tasks = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().count()
    ids = spread(spark.range(400_000), "id")
    assert ids.count() == 400_000 and tasks(ids) >= 2 * spark.sparkContext.defaultParallelism
    assert tasks(written(ids, "ids")) >= 2 * spark.sparkContext.defaultParallelism
    assert tasks(spread(spark.range(10), "id")) <= spark.sparkContext.defaultParallelism  # the data decide


def test_only_what_a_metric_is_made_from(spark, capsys):
    texts = [
        '{"event_type":"x","entities":[{"type":"person","name":"A"},"b"],"dates":[{"raw":"r","normalized":"n"}],"financials":[{"type":"t","amount":5.0}]}',
        '{"event_type":"x","entities":[{"type":"person","name":"A"}],"dates":[{"raw":"q"}],"financials":[]}', "[1]", "null", '{"entities":{}}', "no",
    ]
    out = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "model string, example_id long, raw_output string")
    truth = out.select("example_id", F.lit(texts[0]).alias("record_json"))
    whole = {r.example_id: r for r in scoring.score(out, truth).collect()}
    for metrics in [["schema_compliance"], ["entity_f1"], *[[m] for m in scoring.METRICS if m != "entity_f1"], scoring.METRICS]:
        some = scoring.score(out, truth, metrics=metrics)
        assert [[whole[r.example_id][m] for m in metrics] for r in some.collect()] == [[r[m] for m in metrics] for r in some.collect()]
    plan = plan_of(scoring.score(out, truth, metrics=["date_normalization_recall"]), capsys)
    assert "$.dates" in plan and "$.entities" not in plan and "$.financials" not in plan and "$.metrics" not in plan
