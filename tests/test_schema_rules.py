import pytest

from factloom.functions.recovery import recover
from factloom.functions.schema_rules import violations
from factloom.operators.extraction import typed_projection
from pyspark.sql import functions as F

# text, broken rules, fits the typed record
CASES = [
    ('{"event_type":"x","entities":[]}', [], True),
    ('{"event_type":"x"}', ["$.entities:required"], True),
    ('{"entities":[]}', ["$.event_type:required"], False),
    ('{"event_type":null,"entities":[]}', ["$.event_type:type"], False),
    ('{"event_type":"x","entities":null}', ["$.entities:type"], False),
    ('{"event_type":"x","entities":["A"]}', ["$.entities[]:type"], False),
    ('{"event_type":"x","entities":[{"type":"animal","name":"A"}]}', ["$.entities[].type:enum"], True),
    ('{"event_type":"x","entities":[{"type":5,"name":"A"}]}', ["$.entities[].type:enum", "$.entities[].type:type"], False),
    ('{"event_type":"x","entities":[{"name":"A"}]}', ["$.entities[].type:required"], False),
    ('{"event_type":"x","entities":[],"financials":[{"type":"t","amount":"100"}]}', ["$.financials[].amount:type"], True),
    ('{"event_type":"x","entities":[],"financials":[{"type":"t","amount":"about 5"}]}', ["$.financials[].amount:type"], False),
    ('{"event_type":"x","entities":[],"financials":[{"type":"t","amount":true}]}', ["$.financials[].amount:type"], True),
    ('{"event_type":"x","entities":[],"financials":[{"type":"t","amount":5.0,"currency":null}]}', ["$.financials[].currency:type"], True),
    ('{"event_type":"x","entities":[],"financials":[{"type":"t","amount":1.5}]}', [], True),
    ('{"event_type":"x","entities":[],"metrics":[{"name":"m","value":"12%"},{"name":"n","value":3}]}', [], True),
    ('{"event_type":"x","entities":[],"metrics":[{"name":"m","value":[1]}]}', ["$.metrics[].value:type"], False),
    ('{"event_type":"x","entities":[],"dates":{"raw":"r"}}', ["$.dates:type"], False),
    ('{"event_type":"x","entities":[],"other":{"any":[1]}}', [], True),
    ("[1]", ["$:type"], False),
    ("7", ["$:type"], False),
    ("nothing", None, False),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw_output string")
    df = typed_projection(recover(df))
    rows = df.select("id", violations(F.col("parsed"), F.col("is_object")).alias("v"), "typed_ok", "result").collect()
    return {r.id: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(found, i):
    assert found[i].v == CASES[i][1]
    assert found[i].typed_ok == CASES[i][2]
    assert (found[i].result is not None) == CASES[i][2]


def test_typed_values(found):
    assert found[9].result.financials[0].amount == 100.0
    assert found[11].result.financials[0].amount == 1.0
    assert [(m.value, m.value_kind) for m in found[14].result.metrics] == [("12%", "string"), ("3", "number")]
    assert found[0].result.dates == []


def test_odd_outputs_break_every_rule(spark):
    from factloom.functions.recovery import recover
    from factloom.functions.schema_rules import RECORD_SCHEMA, violations
    from factloom.plans.pseudo_models import ODD, odd_predictions

    rules = {"$:type"} | {f"$.{n}:required" for n in RECORD_SCHEMA["required"]}
    for name, sub in RECORD_SCHEMA["properties"].items():
        rules.add(f"$.{name}:type")
        if "items" in sub:
            rules.add(f"$.{name}[]:type")
            rules |= {f"$.{name}[].{k}:required" for k in sub["items"]["required"]}
            for k, leaf in sub["items"]["properties"].items():
                rules |= {f"$.{name}[].{k}:type"} | ({f"$.{name}[].{k}:enum"} if "enum" in leaf else set())
    df = recover(odd_predictions(spark.range(len(ODD)).withColumnRenamed("id", "example_id")))
    got = {r.v for r in df.select(F.explode(violations(F.col("parsed"), F.col("is_object"))).alias("v")).collect()}
    assert got == rules
