"""Stand-ins for model output: the true record, wrapped or damaged in a known way.  Used where
no model is available, so that recovery and scoring have input whose result is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.draws import with_draws
from factloom.operators.corrupt import with_corruption
from factloom.operators.generate import SEED

MODELS = ["clean", "fenced", "chatty", "corrupted", "truncated"]
DRAWS = ["cut", "cut_share"]


def predictions(examples: DataFrame, seed: int = SEED) -> DataFrame:
    """(model, example_id, raw_output): every model's output for every example.

    ``truncated`` loses up to 600 thousandths of its length, one output in four nothing.
    """
    df = with_draws(with_corruption(examples, seed), "example_id", seed, "cut", DRAWS)
    record = F.col("record_json")
    lost = F.when(F.pmod("draw_cut", F.lit(4)) == 0, 0).otherwise(
        F.floor(F.length(record) * F.pmod("draw_cut_share", F.lit(601)) / 1000)
    )
    outputs = {
        "clean": record,
        "fenced": F.concat(F.lit("Here it is:\n```json\n"), record, F.lit("\n```\nAnything else?")),
        "chatty": F.concat(F.lit("  The text describes one event. "), record, F.lit(" That is all.\n")),
        "corrupted": F.col("corrupted_json"),
        "truncated": record.substr(F.lit(1), (F.length(record) - lost).cast("int")),
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), outputs[m].alias("raw_output")) for m in MODELS])
    return df.select("example_id", F.explode(pairs).alias("p")).select("p.model", "example_id", "p.raw_output")


# Outputs that break rules in every way the schema knows, by their number in this list; #n# is the example's id.
ODD = [
    '{"event_type":"note","entities":[]} trailing words #n#',
    '{"event_type":"note","entities":[]} and #n# } more',
    '{"event_type":"a","entities":[]} {"event_type":"b","entities":[#n#]}',
    '{"event_type":"x","entities":[],"event_type":"x"}',
    "null",
    "#n#",
    '[#n#, "a"]',
    '"text #n#"',
    '{"event_type":"note","entities":["Acme #n#",{"type":"person","name":"Bo"},5,{"type":"alien","name":7},{"name":""},{"type":null,"name":null}]}',
    '{"event_type":"note","entities":[],"financials":[{"type":"fee","amount":true,"currency":"$"},{"type":"fee","amount":"#n#","currency":null},{"type":5}]}',
    '{"entities":{"type":"person"},"dates":"none","financials":#n#,"relationships":null,"metrics":false}',
    '{"event_type":#n#}',
    '{"event_type":"note","entities":[],"dates":[{"raw":"March 5, 2024"},{"normalized":5,"raw":null,"context":true},"x"]}',
    '{"event_type":"note","entities":[],"relationships":[{"type":"a"},{"subject":"s","object":"o"},{"type":1,"subject":2,"object":3},[1]]}',
    '{"event_type":"note","entities":[],"metrics":[{"name":"m","value":[#n#]},{"name":1,"value":true},{"value":null},{"name":"n"},7]}',
    '{"event_type":"note","entities":[],"financials":[{"currency":"$"},"fee",{"type":"fee","amount":2.5,"currency":"$"}]}',
    "",
    '```json\n{"event_type":"note","entities":[{"type":"location","name":"Oslo"}]} #n#',
    '{"event_type":null,"entities":null}',
    '{"_note":"only #n#","event_type":"note","entities":[{}],"dates":[{}]}',
]


def odd_predictions(examples: DataFrame) -> DataFrame:
    """(model, example_id, raw_output) of a model whose outputs are seldom records."""
    style = F.element_at(F.array(*[F.lit(text) for text in ODD]), (F.pmod("example_id", F.lit(len(ODD))) + 1).cast("int"))
    return examples.select(F.lit("odd").alias("model"), "example_id", F.replace(style, F.lit("#n#"), F.col("example_id").cast("string")).alias("raw_output"))
