"""The Arrow pass over recovered texts: one a side, and the same parts as the column expressions over VARIANT."""

import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.functions.record_parts import MOST_LEVELS, with_parts
from factloom.functions.recovery import recover, with_candidate
from factloom.functions.schema_rules import violations
from factloom.operators import scoring
from factloom.operators.extraction import respond, typed_projection
from factloom.plans.pseudo_models import ODD
from factloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NUMBERS = ["5", "5.0", "5.50", "-0", "1e3", "1E-4", "0.0001", "9223372036854775808", "1" * 1000, "1" * 1001, "01", "+1", ".5", "1.", "NaN", "-Infinity"]
VALUES = [*NUMBERS, '"5"', '"organization"', "true", "null", "{}", "[1]", '"\\ud83d\\ude00"', '"\tx"', '"\\x"', "'a'", '" "']


def _texts():
    out = [*ODD, "", "null", "{}", '{"a":1}\x00', '﻿{"a":1}', "[" * MOST_LEVELS + "]" * MOST_LEVELS, "[" * (MOST_LEVELS + 1) + "]" * (MOST_LEVELS + 1)]
    fields = [("entities", "name"), ("entities", "type"), ("dates", "raw"), ("financials", "amount"), ("relationships", "subject"), ("metrics", "value")]
    for v in VALUES:
        out.append(f'{{"event_type":{v},"entities":[{{"type":"person","name":"Bo"}},{v}],"dates":{v}}}')
        out += [f'{{"event_type":"x","entities":[],"{s}":[{{"{k}":{v}}},{{"type":"person"}}]}}' for s, k in fields]
    return out


def _parts(spark, rows, made, **how):
    return with_parts(with_candidate(spark.createDataFrame(rows, "id int, raw_output string")), made, **how)


def test_same_validity_and_rules_as_the_column_expressions(spark):
    rows = list(enumerate(_texts()))
    df = recover(spark.createDataFrame(rows, "id int, raw_output string"))
    df = df.select("id", "valid_json", "is_object", violations(F.col("parsed"), F.col("is_object")).alias("violations"))
    got = _parts(spark, rows, ["violations"]).select("id", "valid_json", "is_object", "violations")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect())) and len(rows) > 150


def test_dates_and_amounts_are_told_apart_as_before(spark):
    """Dates by their value (5 and 5.0 are one), amounts by their text (they are two)."""
    record = lambda v: f'{{"dates":[{{"raw":{v},"normalized":"n"}}],"financials":[{{"amount":{v}}}]}}'
    values = ["5", "5.0", "5.50", "5.5", "1e3", "1000.0", "0.0001", "1e-4", '"5"', "null", '"None"', '{"b":1,"a":2}', '{"a":2.0,"b":1}']
    rows = {values[r.id]: (r.dates, r.amounts) for r in _parts(spark, list(enumerate(map(record, values))), ["dates", "amounts"]).collect()}
    same = lambda part: {(a, b) for a in values for b in values if a < b and rows[a][part] == rows[b][part]}
    assert same(0) == {("5", "5.0"), ("5.5", "5.50"), ('{"a":2.0,"b":1}', '{"b":1,"a":2}')}
    assert same(1) == {('"5"', "5"), ("5.5", "5.50"), ("1000.0", "1e3"), ("0.0001", "1e-4"), ('"None"', "null")}
    assert rows["1e-4"][1] == ["1.0E-4"] and rows["5.0"][1] == ["5.0"]


def test_odd_letters(spark):
    """Lower case is the engine's; half a surrogate pair and bytes that are no UTF-8 do not stop the job."""
    names = ["ÉCOLE", "École", "İx", "ΑΣ", "Bo", "BO"]
    texts = [json.dumps({"entities": [{"name": n} for n in names]}), '{"entities":["\\ud800x"],"\\udc00":1}']
    got = {r.id: r for r in _parts(spark, list(enumerate(texts)), ["keys", "names"]).collect()}
    lower = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").select(F.lower("n").alias("n")).collect()]
    assert sorted(got[0].names) == sorted(set(lower)) and got[1].names == ["?x"] and sorted(got[1].keys) == ["?", "entities"]
    df = spark.range(1).select(F.concat(F.lit('{"a":"'), F.unhex(F.lit("FF")).cast("string"), F.lit('"}')).alias("raw_output"))
    assert [r.valid_json for r in with_parts(with_candidate(df), []).collect()] == [True]


def test_one_pass_a_side(spark, capsys):
    """Scores read every text once, in whatever way they are filtered; no VARIANT is built."""
    out = spark.createDataFrame([("m", i, t) for i, t in enumerate(ODD)], "model string, example_id int, raw_output string")
    truth = out.select("example_id", F.lit(ODD[8]).alias("record_json"), F.lit("kept").alias("keys"))
    errors = lambda: scoring.error_samples(scoring.score(out, truth))
    assert {r["keys"] for r in errors().collect()} == {"kept"}
    capsys.readouterr()
    errors().explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython [") == 2 and "variant" not in plan and "get_json_object" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["missed_entities", "top_hallucinations", "sample_report", "error_samples"])
def test_queries_about_names_read_names_alone(spark, capsys, name):
    QUERIES[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "$.entities" in plan and not [s for s in ("$.dates", "$.financials", "$.metrics") if s in plan]


def test_typed_in_one_pass(spark, capsys):
    """Numbers keep all their digits; a text has to be one number; the record is typed without a VARIANT."""
    metric = lambda v: f'{{"event_type":"e","metrics":[{{"name":"n","value":{v}}}]}}'
    amount = lambda v: f'{{"event_type":"e","financials":[{{"type":"t","amount":{v}}}]}}'
    values = {"5.0": "5", "0.1000": "0.1", "100": "100", "-0": "0", "123456789012345678901234567890.5": "123456789012345678901234567890.5", "1e3": "1000.0", "true": "1.0", '"x"': "x", "[1]": None, "null": None}
    amounts = {"5": 5.0, '" 5 "': 5.0, '"5\\n"': 5.0, '"+.5"': 0.5, '"1e400"': float("inf"), "true": 1.0, '"1_0"': None, '"NaN"': None, '"5 5"': None, '"٥"': None, "{}": None}
    texts = [*map(metric, values), *map(amount, amounts)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw_output string")
    typed = typed_projection(with_candidate(df))
    rows = {r.id: r for r in typed.collect()}
    got = [rows[i].result for i in range(len(texts))]
    assert [r and r.metrics[0].value for r in got[: len(values)]] == list(values.values())
    assert [r and r.financials[0].amount for r in got[len(values) :]] == list(amounts.values())
    assert {r.id: (r.typed_ok, r.result) for r in typed_projection(recover(df)).collect()} == {i: (r.typed_ok, r.result) for i, r in rows.items()}
    capsys.readouterr()
    typed_projection(with_candidate(df)).explain()
    respond(df.withColumnRenamed("id", "request_id")).explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython [") == 2 and "variant" not in plan
