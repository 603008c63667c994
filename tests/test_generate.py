import json
import re

import pytest
from pyspark.sql import functions as F

from factloom import vocabulary as V
from factloom.functions.draws import pick, with_draws
from factloom.operators import generate as G
from factloom.operators.corrupt import KINDS, preference_pairs, with_corruption
from factloom.plans.pseudo_models import predictions
from factloom.operators.scenarios import SCENARIOS, SCENARIO_NAMES
from factloom.operators.scoring import score

N = 700


@pytest.fixture(scope="module")
def examples(spark):
    return G.generate_examples(spark.range(N), "id").cache()


def test_pick_avoids_used_values_and_falls_back(spark):
    items = F.array(*[F.lit(i) for i in (1, 2, 3)])
    df = spark.range(40).select(
        pick(items, F.col("id"), [F.lit(1), F.lit(2)]).alias("rest"),
        pick(items, F.col("id"), [F.lit(1), F.lit(2), F.lit(3)]).alias("all"),
    )
    assert {r.rest for r in df.collect()} == {3}
    assert {r["all"] for r in df.collect()} == {1, 2, 3}


def test_every_scenario_has_its_record(examples):
    rows = examples.collect()
    assert {r.scenario for r in rows} == set(SCENARIO_NAMES)
    spec = {s.name: s for s in SCENARIOS}
    for r in rows:
        record = json.loads(r.record_json)
        s = spec[r.scenario]
        assert "\n" not in r.record_json and record["event_type"] == s.event_type
        assert [e["type"] for e in record["entities"]] == [t for t, _ in s.entities]
        assert len(record["entities"]) == r.num_entities
        assert ("financials" in record) == bool(s.financials) and ("metrics" in record) == bool(s.metrics)
        assert len(record["relationships"]) == len(s.relationships)
        for e in record["entities"]:
            assert e["name"] in r.text
        assert re.match(r"^\d{4}-\d{2}-\d{2}$", record["dates"][0]["normalized"])
        assert record["dates"][0]["raw"] in r.text
        for f in record.get("financials", []):
            assert isinstance(f["amount"], int) and f["currency"] in "$€£¥"


def test_dependent_slots_differ(spark):
    s = G.with_slots(spark.range(N), "id")
    for r in s.collect():
        if r.scenario in ("funding", "product_launch"):
            assert len({r.org_a, r.org_b, r.org_c}) == 3
        if r.scenario in ("acquisition", "executive_hire", "quarterly_results", "legal"):
            assert r.person_a != r.person_b


def test_ranges(spark):
    values = {}
    for r in G.slot_table(G.with_slots(spark.range(N), "id")).collect():
        values.setdefault(r.slot, []).append(r.value)
    number = lambda slot: [int(v.rstrip("%")) for v in values[slot]]
    for slot, low, high in (("jobs", 50, 2000), ("quarter", 1, 4), ("duration", 3, 24), ("growth", 10, 150), ("percent", 2, 25)):
        assert min(number(slot)) >= low and max(number(slot)) <= high


def test_currency_modes(spark):
    for r in G.money_table(G.with_slots(spark.range(N), "id")).collect():
        assert (r.text, r.value) in V.AMOUNTS and r.currency == r.text[0]
    first = G.money_table(G.with_slots(spark.range(N), "id"), "first").collect()
    assert any(r.currency != r.text[0] for r in first)


def test_same_values_for_any_partitioning(spark, examples):
    other = G.generate_examples(spark.range(0, N, 1, 1), "id").select("example_id", "record_json")
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, examples.select("example_id", "record_json").collect()))
    assert with_draws(spark.range(3), "id", 1, "x", ["a"]).collect() != with_draws(spark.range(3), "id", 2, "x", ["a"]).collect()


def test_missing_slots(spark):
    base = spark.createDataFrame([(i, None if i % 3 == 0 else "Known Org") for i in range(60)], "id long, org string")
    given = {"org_a": "org"}
    rejected = G.generate_examples(base, "id", given=given, on_missing="reject")
    assert {r.example_id % 3 for r in rejected.collect()} == {1, 2}
    filled = G.generate_examples(base, "id", given=given).collect()
    assert len(filled) == 60
    assert all(json.loads(r.record_json)["entities"][0]["name"] == "Unknown" for r in filled if r.example_id % 3 == 0)


@pytest.mark.parametrize("kind", KINDS)
def test_corruption(examples, kind):
    changed = 0
    for r in with_corruption(examples, kind=kind).collect():
        a, b = json.loads(r.record_json), json.loads(r.corrupted_json)
        changed += a != b
        if kind == "drop_entity":
            assert len(b["entities"]) == len(a["entities"]) - 1
        elif kind == "hallucinate_entity":
            assert b["entities"][:-1] == a["entities"] and (b["entities"][-1]["type"], b["entities"][-1]["name"]) in V.INVENTED_ENTITIES
        elif kind == "wrong_field_type":
            if "financials" in a:
                assert sum(isinstance(f["amount"], str) for f in b["financials"]) == 1
            else:
                assert a == b
        elif kind == "missing_field":
            assert len(set(a) - set(b)) == 1 and set(a) - set(b) <= set(G.SECTIONS)
        elif kind == "flat_instead_of_nested":
            assert "entities" not in b and b["extracted_entities"] == [e["name"] for e in a["entities"]]
        elif kind == "bad_normalization":
            assert b["dates"][0]["normalized"] == b["dates"][0]["raw"]
        else:
            assert b["_note"] and b["entities"] == a["entities"][1:]
            assert "financials" not in a or "amount" not in b["financials"][0]
    assert changed


def test_pairs(examples):
    rows = preference_pairs(examples).collect()
    assert len(rows) == N and 0.02 < sum(r.swapped for r in rows) / N < 0.09
    for r in rows:
        assert [m.role for m in r.prompt] == ["system", "user"]
        assert [m.role for m in r.chosen] == [m.role for m in r.rejected] == ["assistant"]


def test_clean_output_scores_one(examples):
    truth = examples.select("example_id", "scenario", "record_json")
    rows = score(predictions(examples).filter("model in ('clean', 'fenced', 'chatty')"), truth).collect()
    assert len(rows) == 3 * N
    assert all(r.entity_f1 == r.section_recall == r.schema_compliance == r.date_normalization_recall == r.financial_recall == 1.0 for r in rows)
