import json

from factloom.operators import scoring
from factloom.operators.scoring import METRICS


def test_shared_values_are_found_once_and_empty_names_are_left_out(spark, capsys):
    names = lambda *n: json.dumps({"event_type": "a", "entities": [{"type": "person", "name": x} for x in n]})
    rows = [("m", 1, names("Bo", "", "bo", "Di", 5)), ("m", 2, '{"event_type":"a","entities":["",{"type":"person","name":""},"Bo"]}')]
    out = spark.createDataFrame(rows, "model string, example_id int, raw_output string")
    truth = spark.createDataFrame([(i, names("BO", "Al")) for i in (1, 2)], "example_id int, record_json string")
    scores = scoring.score(out, truth, metrics=METRICS)
    got = {r.example_id: r for r in scores.collect()}
    assert sorted(got[1].pred_names) == ["bo", "di"] and sorted(got[2].pred_names) == ["", "bo"]
    assert [(got[i].entity_recall, got[i].entity_precision, got[i].hallucination_count) for i in (1, 2)] == [(0.5, 0.5, 1.0)] * 2
    capsys.readouterr()
    scores.select("model", *METRICS).explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("array_intersect(") == 4 and "array_except(" not in plan
