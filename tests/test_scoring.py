import json

import pytest

from factloom.operators import compare, scoring
from factloom.operators.scoring import METRICS, error_samples, hallucinated_names, score

E = lambda t, n: {"type": t, "name": n}
# Four entities, two dates, two amounts, one metric: quarters and halves.
WIDE = {
    "event_type": "partnership",
    "entities": [E("location", "Aarhus"), E("organization", "Saltmarsh Cooperative"), E("organization", "Veldt Instruments"), E("product", "Tern Buoy")],
    "dates": [{"raw": "June 2, 2025", "normalized": "2025-06-02"}, {"raw": "July 9, 2025", "normalized": "2025-07-09"}],
    "financials": [{"type": "budget", "amount": 7250000, "currency": "€"}, {"type": "deposit", "amount": 90000, "currency": "€"}],
    "metrics": [{"name": "buoys", "value": 40}],
}
# Five entities, an amount given as text, no dates.
PLAIN = {
    "entities": [E("person", "Ottilie Brandt"), E("organization", "Kelp Registry"), E("organization", "Quay & Daughters"), E("location", "Bergen"), E("product", "Net Tag")],
    "event_type": "legal",
    "financials": [{"type": "fee", "amount": "310"}],
}
SHOUTED = [E(e["type"], e["name"].upper()) for e in reversed(WIDE["entities"])]

# prediction, truth, expected metrics: shares are (values both have) / (values of truth or prediction).
CASES = [
    # Three of four entities among five, one date and one amount of two, a section missing and one too many.
    ({"event_type": "partnership", "entities": [*WIDE["entities"][1:], E("person", "Somebody"), E("location", "Elsewhere")],
      "dates": [WIDE["dates"][0], {"raw": "July 9, 2025", "normalized": "2025-09-07"}],
      "financials": [WIDE["financials"][1], {"type": "budget", "amount": 7260000}], "relationships": []}, WIDE,
     {"schema_compliance": 1.0, "entity_recall": 3 / 4, "entity_precision": 3 / 5, "entity_f1": 2 / 3, "hallucination_count": 2.0,
      "date_normalization_recall": 1 / 2, "date_normalization_precision": 1 / 2, "financial_recall": 1 / 2, "financial_precision": 1 / 2,
      "section_recall": 4 / 5, "section_precision": 4 / 5, "structural_fidelity": 1.0}),
    # Order and case of names do not matter.
    ({**WIDE, "entities": SHOUTED, "dates": WIDE["dates"][::-1]}, WIDE, {m: 1.0 for m in METRICS} | {"hallucination_count": 0.0}),
    # Bare names instead of objects still count as names.
    ({"event_type": "legal", "entities": ["kelp registry", "Nobody Known"]}, PLAIN,
     {"schema_compliance": 0.0, "structural_fidelity": 0.0, "entity_recall": 1 / 5, "entity_precision": 1 / 2, "hallucination_count": 1.0,
      "financial_recall": 0.0, "financial_precision": 0.0, "section_recall": 2 / 3}),
    # A name said three times is one name; an amount is compared as text, so the number 310 is the text "310".
    ({**PLAIN, "entities": [E("location", "Bergen")] * 3, "financials": [{"type": "fee", "amount": 310}]}, PLAIN,
     {"entity_recall": 1 / 5, "entity_precision": 1.0, "entity_f1": 1 / 3, "financial_recall": 1.0, "financial_precision": 1.0}),
    # Dates where the truth has none: nothing was missed, nothing is right.
    ({**PLAIN, "dates": WIDE["dates"]}, PLAIN,
     {"date_normalization_recall": 1.0, "date_normalization_precision": 0.0, "section_recall": 1.0, "section_precision": 3 / 4}),
    ({"event_type": "x", "entities": [{"type": "person"}, "Net Tag"], "_note": "n"}, PLAIN, {"structural_fidelity": 0.5, "section_precision": 1.0, "entity_recall": 1 / 5}),
    ({"event_type": "x"}, PLAIN, {"structural_fidelity": 1.0, "entity_recall": 0.0, "entity_precision": 0.0}),
    ({"event_type": "x", "entities": []}, PLAIN, {"structural_fidelity": 0.0}),
    ({"event_type": "x", "entities": None}, PLAIN, {"structural_fidelity": 0.0, "schema_compliance": 0.0}),
    ({**WIDE, "financials": [{"type": "v", "amount": 7250000.0}, {"type": "w", "amount": "7250000"}]}, WIDE, {"financial_recall": 1 / 2, "financial_precision": 1 / 2}),
    ({**WIDE, "financials": [{"amount": 5}, {"amount": 5}, 3, {"amount": None}]}, WIDE, {"financial_recall": 0.0, "financial_precision": 0.0}),
    ({**WIDE, "entities": [E("organization", "VELDT INSTRUMENTS"), E("person", ""), {"type": "p", "name": 5}]}, WIDE,
     {"entity_recall": 1 / 4, "entity_precision": 1.0, "hallucination_count": 0.0}),
]
CUT = json.dumps(WIDE, ensure_ascii=False)[:160]


@pytest.fixture(scope="module")
def scores(spark):
    ids = range(len(CASES))
    pred = [("m", i, json.dumps(CASES[i][0])) for i in ids] + [("bad", 0, "not json"), ("bad", 1, "[1]"), ("bad", 2, json.dumps(CASES[2][1]))]
    truth = [(i, json.dumps(CASES[i][1])) for i in ids]
    return score(
        spark.createDataFrame(pred, "model string, example_id long, raw_output string"),
        spark.createDataFrame(truth, "example_id long, record_json string"),
    ).cache()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_metrics(scores, i):
    row = scores.filter(f"model = 'm' and example_id = {i}").collect()[0]
    for name, value in CASES[i][2].items():
        assert row[name] == pytest.approx(value, abs=1e-9), name


def test_skipped_names_are_counted(scores):
    assert scores.filter("model = 'm' and example_id = 11").collect()[0].pred_skipped == 1


def test_invalid_and_non_object(scores):
    rows = {r.example_id: r for r in scores.filter("model = 'bad'").collect()}
    assert not rows[0].valid_json and rows[0].entity_f1 is None
    assert rows[1].valid_json and not rows[1].is_object and rows[1].entity_f1 is None
    assert rows[2].entity_f1 == 1.0


def test_aggregates(scores):
    rows = {r.model: r for r in compare.model_metrics(scores).collect()}
    assert rows["bad"].total_samples == 3
    assert rows["bad"].valid_json_rate == pytest.approx(2 / 3, abs=1e-6)
    assert rows["bad"].entity_f1 == 1.0 and rows["bad"].entity_f1_all == pytest.approx(1 / 3, abs=1e-6)


def test_errors_and_names(scores):
    found = {r.example_id for r in error_samples(scores).collect()}
    assert found >= {2, 3, 5, 6, 7, 11} and not found & {0, 1, 4}
    assert ("m", 2, "nobody known") in {tuple(r) for r in hallucinated_names(scores).collect()}


def test_preview_is_the_whole_repaired_output(spark):
    """A cut-off output is shown as it was parsed, a long one to its end."""
    long = json.dumps({**PLAIN, "event_type": "e" * 3000})
    pred = spark.createDataFrame([("m", 0, CUT), ("m", 1, long)], "model string, example_id long, raw_output string")
    truth = spark.createDataFrame([(i, json.dumps(WIDE)) for i in range(2)], "example_id long, record_json string")
    got = {r.example_id: r.preview for r in score(pred, truth).collect()}
    assert got[1] == long and got[0] == CUT[: CUT.rindex("}") + 1] != CUT


def test_delta_and_coverage(spark, scores):
    results = compare.model_metrics(scores)
    shown = {r.metric: r.shown for r in compare.metrics_delta(results, "bad", "m").collect()}
    assert shown["valid_json_rate"] == "+33.3 pp"
    assert shown["entity_f1"].startswith("-")
    missing = {r.metric: r.shown for r in compare.metrics_delta(results, "none", "m").collect()}
    assert missing["entity_f1"] == "N/A"
    models = spark.createDataFrame([("m", None), ("absent", None), ("bad", "no memory")], "model string, error string")
    status = {r.model: (r.status, r.error, r.total_samples, r.valid_json_rate, r.entity_f1) for r in compare.model_coverage(models, results).collect()}
    assert status["absent"] == ("skipped", None, 0, 0.0, None) and status["m"][0] == "evaluated"
    assert status["bad"] == ("failed", "no memory", 0, 0.0, None)
    named = spark.createDataFrame([("zeta-base", 1), ("alpha-base", 2), ("tuned", 0)], "model string, place int")
    assert compare.find_model(named, "BASE", "place").collect()[0].model == "zeta-base"
    wide = {r.metric: r for r in compare.metrics_pivot(results, ["m", "none"]).collect()}
    assert wide["entity_f1"]["none"] == "N/A" and wide["valid_json_rate"].label == "Valid JSON Rate"


def test_scoring_again_shuffles_nothing(spark, folder):
    """Stored sides are joined bucket by bucket: no exchange, the same scores."""
    from factloom.operators import generate as G
    from factloom.plans.pseudo_models import predictions

    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    ex = G.generate_examples(spark.range(200), "id")
    outputs, truth = predictions(ex), ex.select("example_id", "scenario", "record_json")
    columns = ["model", "example_id", "valid_json", "entity_f1", "section_recall", "financial_recall", "hallucination_count"]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        predicted = scoring.stored_features(scoring.prediction_side(outputs), f"{folder}/predicted", 4)
        known = scoring.stored_features(scoring.truth_features(truth), f"{folder}/truth", 4)
        again = scoring.score_features(predicted, known)
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        got = sorted(map(str, again.select(*columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert got == sorted(map(str, scoring.score(outputs, truth).select(*columns).collect())) and len(got) == 1000
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("features_")]
