import pytest

from factloom.operators import conversations, splits
from factloom.functions import chat
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [0, 1, 9, 10, 1003])
def test_exact_size(spark, n):
    df = splits.exact_split(spark.range(n), "id", 7)
    rows = df.collect()
    assert len(rows) == n
    assert sum(r.split == "train" for r in rows) == int(n * 0.9)


def test_full_and_empty_share(spark):
    assert splits.exact_split(spark.range(50), "id", 7, share=1.0).filter("split = 'train'").count() == 50
    assert splits.exact_split(spark.range(50), "id", 7, share=0.0).filter("split = 'train'").count() == 0


def test_partitioning_does_not_matter(spark):
    a = splits.exact_split(spark.range(0, 500, 1, 1), "id", 7).collect()
    b = splits.exact_split(spark.range(0, 500, 1, 8), "id", 7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    c = splits.exact_split(spark.range(500), "id", 8).collect()
    assert sorted(map(tuple, a)) != sorted(map(tuple, c))


def test_copies_stay_together(spark):
    df = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("id"))
    rows = splits.exact_split(df, "id", 3).collect()
    sides = {}
    for r in rows:
        sides.setdefault(r.id, set()).add(r.split)
    assert len(rows) == 300 and all(len(s) == 1 for s in sides.values())


def test_threshold_share(spark):
    n = splits.threshold_split(spark.range(4000), "id", 1).filter("split = 'train'").count()
    assert 3500 < n < 3700


def test_union_and_first_rows_keep_all(spark):
    from factloom.operators.corrupt import source_union

    df = splits.exact_split(spark.range(100), "id", 7)
    part = lambda s: df.filter(F.col("split") == s).drop("split").withColumnRenamed("id", "example_id")
    rows = source_union(part("train"), part("eval")).collect()
    assert len(rows) == 100 and sum(r.source_split == "eval" for r in rows) == 10
    first = splits.first_rows(spark.range(30), "id", 12).collect()
    assert {r.id for r in first if r.among_first} == set(range(12)) and len(first) == 30


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exact_split_orders_no_more_than_a_bucket(spark):
    plan = optimized(splits.exact_split(spark.range(1000), "id", 7))
    assert "Sort" not in plan and plan.count("Repartition") == 0


def test_exact_split_reads_its_source_three_times(spark, folder):
    """The plan has a constant size: three scans, two of them of the key alone."""
    spark.range(500).selectExpr("id", "uuid() AS more").write.parquet(f"{folder}/t")
    df = splits.exact_split(spark.read.parquet(f"{folder}/t"), "id", 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and plan.count("ReadSchema: struct<id:bigint>") == 2
    assert df.groupBy("split").count().orderBy("split").collect() == [("eval", 50), ("train", 450)]


def test_exact_split_with_odd_keys(spark):
    """Rows without key come first; a key with many copies is not split; text keys work."""
    df = spark.createDataFrame([(None,)] * 4 + [("hot",)] * 60 + [(f"k{i}",) for i in range(36)], "k string")
    for share in (0.0, 0.02, 0.04, 0.3, 0.7, 0.99, 1.0):
        rows = splits.exact_split(df, "k", 5, share).collect()
        sides = {}
        for r in rows:
            sides.setdefault(r.k, set()).add(r.split)
        train = sum(r.split == "train" for r in rows)
        assert len(rows) == 100 and all(len(s) == 1 for s in sides.values()) and train <= int(100 * share)
        assert (sides[None] == {"train"}) == (share >= 0.04)


def test_columns_that_are_not_asked_for_are_not_built(spark):
    from factloom.plans import inputs, queries

    sf = "/root/testdata/sf0.001"
    for name in ("entity_coverage", "entity_count_profile", "train_eval_split", "dataset_summary"):
        plan = optimized(queries.QUERIES[name](spark, sf))
        assert "to_json" not in plan and "StructsToJson" not in plan, name
    assert "EqualTo(o_orderkey,5)" in inputs.examples(spark, sf, "entities").filter("example_id = 5")._jdf.queryExecution().executedPlan().toString()


def long_talk(spark, n=600):
    return spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 300, "assistant").otherwise("user").alias("role"),
                                 F.col("id").cast("string").alias("text"))


def test_whole_conversations_on_request(spark):
    turns = long_talk(spark)
    rows = conversations.to_messages(turns.repartition(5)).collect()
    assert [m.content for r in rows for m in r.messages] == [str(i) for i in range(600)] and len(rows) == 1
    prompts = conversations.to_messages(conversations.prompt_turns(turns)).select(chat.render_messages(F.col("messages"), True).alias("p")).collect()
    assert len(prompts) == 1 and prompts[0].p.count("<|im_start|>assistant") == 1 and prompts[0].p.endswith("299<|im_end|>\n<|im_start|>assistant\n")
    odd = turns.union(turns.selectExpr("NULL conv_id", "turn", "role", "text")).union(spark.sql("SELECT 2 conv_id, NULL turn, 'user' role, 'x' text"))
    sizes = {r.conv_id: len(r.messages) for r in conversations.to_messages(odd).collect()}
    assert sizes == {None: 600, 1: 600, 2: 1}
    assert conversations.prompt_turns(turns).count() == 300
    assert conversations.first_answers(turns).collect()[0].answer == "300"


def test_pieces_of_conversations(spark):
    rows = sorted(conversations.message_pieces(long_talk(spark).repartition(5)).collect(), key=lambda r: r.piece)
    assert [(r.piece, r.last, len(r.messages)) for r in rows] == [(0, False, 256), (1, False, 256), (2, True, 88)]
    assert [m.content for r in rows for m in r.messages] == [str(i) for i in range(600)]
    shown = conversations.rendered_pieces(conversations.message_pieces(conversations.prompt_turns(long_talk(spark))), True).orderBy("piece").collect()
    text = "".join(r.rendered for r in shown)
    assert text.count("<|im_start|>assistant") == 1 and text.endswith("<|im_start|>assistant\n") and [r.n_messages for r in shown] == [256, 44]
    same = spark.createDataFrame([(1, 5, "user", "x")] * 30 + [(None, None, "user", "y")] * 30 + [(None, None, None, None)], "conv_id int, turn int, role string, text string")
    got = conversations.message_pieces(same.repartition(4), 8).collect()
    assert sorted((str(r.conv_id), r.piece, len(r.messages), r.last) for r in got) == [("1", k, [8, 8, 8, 6][k], k == 3) for k in range(4)] + [("None", k, [8, 8, 8, 7][k], k == 3) for k in range(4)]
    assert conversations.message_pieces(same.limit(0)).collect() == []


def test_budget_over_turns(spark):
    """Pieces cut across turns, whatever the turns hold, are those of the conversation's text."""
    turns = [(c, t, ["user", "assistant"][t % 2], " ".join(f"w{i}" for i in range((c * t * 7) % 40)) + "\n" * (t % 3)) for c in (1, 2, 3) for t in range(30)]
    turns += [(4, 0, "user", "short"), (5, 0, None, "unseen"), (5, 1, "user", None), (None, None, "user", " \t "), (6, 0, "user", "a  b " * 300)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(7)
    got = {}
    for r in conversations.budget_pieces(df, 16).collect():
        got.setdefault(r.conv_id, {})[r.piece_no] = (r.n_tokens, r.over_budget, r.piece)
    for conv in (1, 2, 3, 4, 5, 6, None):
        text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for c, t, r, x in sorted((t for t in turns if t[0] == conv), key=lambda t: t[1] or 0) if r and x is not None)
        n, pieces = len(text.split()), [p[2] for _, p in sorted(got[conv].items())]
        assert {p[:2] for p in got[conv].values()} == {(n, n > 16)} and "".join(pieces) == text
        assert [len(p.split()) for p in pieces] == ([16] * (n // 16) + [n % 16] * (n % 16 > 0) if n > 16 else [n])
    with pytest.raises(ValueError):
        conversations.budget_pieces(df, 16, closing="")


def test_conversation_of_a_million_turns(spark):
    turns = long_talk(spark, 1_000_000)
    got = conversations.budget_pieces(turns, 512).agg(F.count("*"), F.max("piece_no"), F.max("n_tokens"), F.sum(F.length("piece")), F.max(chat.count_words(F.col("piece")))).first()
    length = turns.agg(F.sum(F.length("text") + F.length("role") + 24)).first()[0]
    assert tuple(got) == (3907, 3906, 2_000_000, length, 512)


def test_message_functions(spark):
    turns = [("system", "S"), ("user", "U"), ("assistant", "A"), ("user", "V")]
    df = spark.createDataFrame([(turns,)], "m array<struct<role:string,content:string>>")
    r = df.select(
        chat.render_messages(F.col("m")).alias("all"), chat.render_messages(chat.prompt_part(F.col("m")), True).alias("prompt"),
        chat.first_answer(F.col("m")).alias("answer"),
    ).collect()[0]
    assert r["all"].startswith("<|im_start|>system\nS<|im_end|>\n") and r["all"].endswith("V<|im_end|>\n")
    assert r.prompt == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n"
    assert r.answer == "A"


def test_length_budget(spark):
    df = spark.createDataFrame([(0, " a  b\nc d\t\n"), (1, "a b"), (2, ""), (3, " \n "), (4, None), (5, "w\u00e9  " * 20_000)], "k int, t string")
    rows = {}
    for r in chat.length_budget(df, "t", 3).orderBy("k", "piece_no").collect():
        rows.setdefault(r.k, []).append((r.n_tokens, r.over_budget, r.piece_no, r.piece))
    assert rows[0] == [(4, True, 0, " a  b\nc"), (4, True, 1, " d\t\n")]
    assert rows[1] == [(2, False, 0, "a b")] and rows[2] == [(0, False, 0, "")] and rows[3] == [(0, False, 0, " \n ")]
    assert [p[3] for p in rows[4]] == [None]
    assert "".join(p[3] for p in rows[5]) == "w\u00e9  " * 20_000 and len(rows[5]) == 6667
