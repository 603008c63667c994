import json

import pytest
from pyspark.sql import functions as F

from factloom.functions.recovery import END_MARK, recover, repair_truncated

CASES = [
    ('{"a":1}', '{"a":1}'),
    ('```json\n{"a":1}\n```', '{"a":1}'),
    ('```\n{"a":1}```', '{"a":1}'),
    ('```json{"a":1}``` and ```{"b":2}```', '{"a":1}'),
    ('text ``` {"a": 1}', '{"a": 1}'),
    ('Sure:\n{"a":{"b":2}}\nthere you are', '{"a":{"b":2}}'),
    ('{"a":1', None),
    ("no json", None),
    ("", None),
    ("   ", None),
    ('{"a":1} {"b":2}', None),
    ('{"a":1},{"b":2}', None),
    ('{"a":1}],[{"b":2}', None),
    ('} {', None),
    ("null", None),
    ("12", "12"),
    ("[1,2]", "[1,2]"),
    ('"word"', '"word"'),
    ("1,2", None),
    ("1],[2", None),
    ("true", "true"),
    ("  {\"a\":1} ", '{"a":1}'),
    ('{"a":1,}', None),
    ("{'a':1}", None),
    ('{"a":01}', None),
    (f'{{"a":"{END_MARK}"}}', f'{{"a":"{END_MARK}"}}'),
    (f'1,"{END_MARK}"],[2', None),
    ('{"k":1,"k":2}', '{"k":1,"k":2}'),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "id int, raw_output string")
    df = recover(df).withColumn("shown", F.to_json("parsed"))
    return {r.id: r for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_recovered_text(found, i):
    raw, expected = CASES[i]
    assert found[i].json_text == expected
    assert found[i].valid_json == (expected is not None)
    assert found[i].is_object == bool(expected and expected.startswith("{"))
    if expected is not None:
        assert json.loads(found[i].shown) == json.loads(expected)


def test_repair_cuts_after_last_brace(spark):
    rows = [('{"a":{"b":1},"c":[', '{"a":{"b":1}'), ('{"a":', '{"a":'), ('{"a":1}', '{"a":1}'), ('x {"a":', 'x {"a":')]
    df = spark.createDataFrame([(r,) for r, _ in rows], "raw_output string")
    assert [r.repaired for r in repair_truncated(df).collect()] == [e for _, e in rows]
    assert [r.was_truncated for r in repair_truncated(df).collect()] == [True, True, False, False]
