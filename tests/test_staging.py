"""Staged columns are made by a projection, and recovery tells a JSON null by its text."""

from pyspark.sql import functions as F

from factloom.functions.plan import staged
from factloom.functions.recovery import recover


def test_generator_reads_a_column(spark, capsys):
    df = staged(spark.range(3), {"double": F.col("id") * 2, "id": F.col("id") + 1})
    assert df.columns == ["double", "id"] and sorted(map(tuple, df.collect())) == [(0, 1), (2, 2), (4, 3)]
    df.explain()
    generators = [line for line in capsys.readouterr().out.splitlines() if "Generate " in line]
    assert len(generators) == 1 and "inline(_stage" in generators[0]


def test_a_null_is_no_value(spark, capsys):
    texts = ["null", " null\n", "```json\nnull\n```", "nul", "null null", '"null"', "[null]", '{"a":null}', "{null}", "0", "", None]
    df = recover(spark.createDataFrame([(t,) for t in texts], "raw_output string"))
    assert [r.valid_json for r in df.collect()] == [False] * 5 + [True] * 3 + [False, True, False, False]
    df.explain()
    plan = capsys.readouterr().out.lower()
    assert "variantnull" not in plan and "variant_null" not in plan
