"""The registered queries: name -> function of (session, table folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from factloom.functions import chat
from factloom.functions.draws import with_draws
from factloom.functions.json_text import indented
from factloom.functions.plan import staged
from factloom.functions.recovery import recover, repair_truncated, with_candidate
from factloom.functions.running import sums_before
from factloom.functions.schema_rules import violations
from factloom.operators import compare, conversations, extraction, requests, scoring, splits, trainlog
from factloom.operators.scoring import METRICS
from factloom.operators import generate as G
from factloom.operators.corrupt import KINDS, format_pairs, source_union, with_corruption
from factloom.operators.generate import SEED
from factloom.plans.pseudo_models import MODELS, odd_predictions, predictions
from factloom.operators.scenarios import SCENARIOS
from factloom.plans import inputs as I
from factloom.session import configure, shared_dir, written
from factloom.sources import jsonl
from factloom.sources.tables import table
from factloom.streaming import jobs

FIRST_N = 500
TOKEN_BUDGET = 64
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


# --- sources ----------------------------------------------------------------------


@query
def scan_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat lines, a piece of a conversation each, written and read with a stated schema."""
    path = f"{shared_dir(configure(spark))}/chat-{uuid.uuid4().hex}"
    conversations.message_pieces(table(spark, sf, "conversations")).write.json(path)
    lines, m = jsonl.scan_chat(spark, path, f"conv_id bigint, piece bigint, last boolean, {jsonl.CHAT_SCHEMA}"), F.col("messages")
    return lines.select(
        "conv_id", "piece", "last", F.size(m).cast("bigint").alias("n_messages"),
        joined(F.transform(m, lambda x: x["role"])).alias("roles"),
        F.array_join(F.transform(m, lambda x: x["content"]), "\n").alias("contents"),
    )


@query
def scan_pairs_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Both splits of the pairs, written as JSON lines and scanned as one table."""
    pairs = splits.exact_split(I.pairs(spark, sf), "example_id", SEED, stage="pair_split")
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    jsonl.save_splits(pairs, path, ["example_id", "prompt", "chosen", "rejected"])
    schema = f"example_id bigint, {jsonl.PAIR_SCHEMA}"
    both = jsonl.scan_splits(spark, {s: f"{path}/split={s}" for s in ("train", "eval")}, schema)
    return both.select(
        "example_id", "split", F.size("prompt").cast("bigint").alias("prompt_messages"),
        F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"),
    )


@query
def readable_sample(spark: SparkSession, sf: str) -> DataFrame:
    df, order = I.examples(spark, sf, "text", "scenario", "entities", "dates"), splits.shuffle_key("example_id", SEED)
    return jsonl.readable_sample(df, "example_id", order, ["text", "scenario", "entities", "dates"])


@query
def merge_model_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results with different metric sets, saved per model, then loaded and merged into one table."""
    columns = "model string, total_samples bigint, valid_json_rate double, entity_f1 double, section_recall double"
    path = f"{shared_dir(configure(spark))}/results-{uuid.uuid4().hex}"
    saved = jsonl.save_results(compare.model_metrics(I.scores(spark, sf, METRICS)).select(*[c.split()[0] for c in columns.split(", ")]), path)
    of = lambda names: jsonl.load_results(spark, [f"{saved}/_folder={m}" for m in names], columns)
    return compare.merge_results([of(["clean", "fenced", "corrupted", "absent"]), of(["chatty", "truncated"]).drop("section_recall")])


# --- generation -------------------------------------------------------------------


@query
def gen_pick_excluding(spark: SparkSession, sf: str) -> DataFrame:
    """Organizations that avoid one another, as drawn per row."""
    return I.slots(spark, sf).select("example_id", "scenario", "org_a", "org_b", "org_c")


@query
def gen_amounts(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("amount_a")
    return I.slots(spark, sf).select(
        "example_id", a["text"].alias("text"), a["value"].alias("value"), a["currency"].alias("currency")
    )


@query
def gen_date_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return I.slots(spark, sf).select("example_id", "date_raw", "date_norm")


@query
def gen_slots(spark: SparkSession, sf: str) -> DataFrame:
    return G.slot_table(I.slots(spark, sf))


@query
def gen_multi_amounts(spark: SparkSession, sf: str) -> DataFrame:
    s = I.slots(spark, sf)
    modes = [G.money_table(s, m).withColumn("currency_mode", F.lit(m)) for m in ("own", "first")]
    return modes[0].unionByName(modes[1])


@query
def render_text(spark: SparkSession, sf: str) -> DataFrame:
    return I.examples(spark, sf, "scenario", "text")


def _record_query(scenario: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        orders = table(configure(spark), sf, "orders")
        return G.generate_examples(orders, "o_orderkey", scenario=scenario).select("example_id", "text", "record_json")

    return run


# Query names of the seven record builders, by scenario.
RECORD_QUERIES = {
    "record_acquisition": "acquisition", "record_funding": "funding", "record_hire": "executive_hire",
    "record_partnership": "partnership", "record_launch": "product_launch",
    "record_earnings": "quarterly_results", "record_approval": "legal",
}
for _name, _scenario in RECORD_QUERIES.items():
    QUERIES[_name] = _record_query(_scenario)


@query
def record_first_currency(spark: SparkSession, sf: str) -> DataFrame:
    """Records in which all amounts carry the sign of the row's first amount."""
    orders = table(configure(spark), sf, "orders")
    return G.generate_examples(orders, "o_orderkey", currency_mode="first").select("example_id", "record_json")


@query
def entity_count_profile(spark: SparkSession, sf: str) -> DataFrame:
    return I.examples(spark, sf, "scenario", "num_entities").groupBy("scenario", F.col("num_entities").cast("bigint").alias("num_entities")).agg(
        F.count("*").alias("n")
    )


@query
def entity_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = I.examples(spark, sf, "entities").select(F.explode("entities").alias("e"))
    return e.groupBy(F.col("e.type").alias("type")).agg(
        F.countDistinct("e.name").alias("names"), F.count("*").alias("mentions")
    )


@query
def generation_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that yield no example, with the slots they lack."""
    s = I.fact_slots(spark, sf).filter(F.size("missing") > 0)
    return s.select("example_id", "scenario", joined(F.col("missing")).alias("missing"))


@query
def generation_yield(spark: SparkSession, sf: str) -> DataFrame:
    """Examples against rows tried, per scenario."""
    s = I.fact_slots(spark, sf)
    made = F.count_if(F.size("missing") == 0)
    return s.groupBy("scenario").agg(F.count("*").alias("attempts"), made.alias("examples"))


@query
def fact_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples built from the orders' own values; incomplete rows are left out."""
    s = I.fact_slots(spark, sf).filter(F.size("missing") == 0).drop("missing")
    return G.examples_from_slots(s).select("example_id", "scenario", "text", "record_json")


@query
def fact_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    """Examples of all orders; what an order lacks is called unknown."""
    facts_of = I.facts_table(spark, sf)
    return G.generate_examples(facts_of, "example_id", given=I.GIVEN).select("example_id", "scenario", "text", "record_json")


@query
def fact_corruptions(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the orders' own values, corrupted."""
    df = with_corruption(I.fact_examples(spark, sf))
    return df.select("example_id", "kind", "corrupted_json")


@query
def fact_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern extractor over the texts of the orders, scored by their records."""
    ex = written(I.fact_examples(spark, sf).select("example_id", "scenario", "text", "record_json"), "examples")
    out = ex.select(F.lit("patterns").alias("model"), "example_id", extraction.rule_based_output(F.col("text")).alias("raw_output"))
    scores = scoring.score(out, ex.select("example_id", "scenario", "record_json"))
    return compare.model_metrics(scores).select(
        "model", "total_samples", "entity_recall", "entity_precision", "date_normalization_recall", "financial_recall"
    )


@query
def fact_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in models over the orders' own records, by scenario."""
    ex = written(I.fact_examples(spark, sf).drop("text", "num_entities"), "examples")
    return compare.metrics_by_scenario(scoring.score(predictions(ex), ex.select("example_id", "scenario", "record_json")))


@query
def sft_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    return I.chat_rows(spark, sf).select(
        "example_id", joined(F.transform(m, lambda x: x["role"])).alias("roles"),
        m[0]["content"].alias("system"), m[1]["content"].alias("user"), m[2]["content"].alias("assistant"),
    )


@query
def train_eval_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.exact_split(I.examples(spark, sf, "scenario"), "example_id", SEED)


@query
def threshold_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.threshold_split(I.examples(spark, sf, "scenario"), "example_id", SEED)


@query
def scenario_composition(spark: SparkSession, sf: str) -> DataFrame:
    return splits.composition(I.examples(spark, sf, "scenario"))


@query
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    ids = I.example_ids(spark, sf)
    sft = splits.exact_split(ids, "example_id", SEED).withColumn("dataset", F.lit("sft"))
    pairs = splits.exact_split(ids, "example_id", SEED, stage="pair_split").withColumn("dataset", F.lit("pairs"))
    return splits.summary(sft.unionByName(pairs))


@query
def json_length_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Length of the one-line record against the indented one: means and exact medians."""
    ex = I.examples(spark, sf, "scenario", *G.RECORD_FIELDS, "record_json")
    pretty = indented(F.struct(*G.RECORD_FIELDS), T.StructType([ex.schema[f] for f in G.RECORD_FIELDS]))
    forms = {"one_line": F.col("record_json"), "indented": pretty}
    pairs = F.array(*[F.struct(F.lit(n).alias("form"), F.length(c).alias("chars")) for n, c in forms.items()])
    rows = ex.select("scenario", F.explode(pairs).alias("f")).select(F.concat_ws("/", "scenario", "f.form").alias("of"), "f.chars")
    counts = written(rows.groupBy("of", "chars").agg(F.count("*").alias("n")), "lengths")
    mean = counts.groupBy("of").agg(F.sum("n").alias("rows"), F.round(F.sum(F.col("chars") * F.col("n")) / F.sum("n"), 3).alias("avg_chars"))
    half = sums_before(counts, ["of"], "chars", "n").join(counts, ["of", "chars"]).join(mean, "of")
    at = F.least(F.col("rows") - 1, F.floor(F.col("rows") * 0.5))
    half = half.filter((F.col("before") <= at) & (at < F.col("before") + F.col("n")))
    scenario, form = F.split_part("of", F.lit("/"), F.lit(1)), F.split_part("of", F.lit("/"), F.lit(2))
    return half.select(scenario.alias("scenario"), form.alias("form"), "rows", "avg_chars", F.col("chars").cast("long").alias("p50_chars"))


# --- preference pairs -------------------------------------------------------------


@query
def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return I.pairs(spark, sf).select(
        "example_id", "kind", "swapped", F.col("prompt")[1]["content"].alias("user"),
        F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"),
    )


@query
def pair_cap(spark: SparkSession, sf: str) -> DataFrame:
    """All rows, of either side, with the side each pair comes from."""
    ids = splits.exact_split(I.example_ids(spark, sf), "example_id", SEED)
    part = lambda s: ids.filter(F.col("split") == s).drop("split")
    return source_union(part("train"), part("eval"))


@query
def corruption_mix(spark: SparkSession, sf: str) -> DataFrame:
    return I.corrupted(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


def _corrupt_query(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return I.corrupted(spark, sf, kind).select("example_id", "corrupted_json")

    return run


# Query names of the seven corruptions, by kind.
CORRUPT_QUERIES = dict(
    zip(
        (
            "corrupt_drop_entity", "corrupt_add_entity", "corrupt_amount_type", "corrupt_missing_section",
            "corrupt_flatten", "corrupt_dates", "corrupt_multiple",
        ),
        KINDS,
    )
)
for _name, _kind in CORRUPT_QUERIES.items():
    QUERIES[_name] = _corrupt_query(_kind)


@query
def pair_swap_rate(spark: SparkSession, sf: str) -> DataFrame:
    return I.pairs(spark, sf).groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if("swapped").alias("swapped"),
        F.round(F.avg(F.col("swapped").cast("double")), 6).alias("rate"),
    )


@query
def degenerate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose two answers are the same."""
    same = I.corrupted(spark, sf).filter(F.col("record_json") == F.col("corrupted_json"))
    return same.groupBy("scenario", "kind").agg(F.count("*").alias("n"))


@query
def pair_split(spark: SparkSession, sf: str) -> DataFrame:
    ids = I.example_ids(spark, sf)
    return splits.exact_split(ids, "example_id", SEED, stage="pair_split")


@query
def format_preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return format_pairs(I.pairs(spark, sf))


QUERIES["format_pairs"] = QUERIES.pop("format_preference_pairs")


# --- training input ---------------------------------------------------------------


@query
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversations as text."""
    pieces = conversations.message_pieces(table(configure(spark), sf, "conversations"))
    return conversations.rendered_whole(pieces).select("conv_id", "rendered")


@query
def prompt_split(spark: SparkSession, sf: str) -> DataFrame:
    """The part of every conversation before its first answer, with a generation header."""
    turns = conversations.prompt_turns(table(configure(spark), sf, "conversations"))
    whole = conversations.rendered_whole(conversations.message_pieces(turns), generation_header=True)
    return whole.withColumnRenamed("rendered", "prompt")


@query
def prompt_of_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The same rule on stored message arrays."""
    part = chat.prompt_part(F.col("messages"))
    return I.chat_rows(spark, sf).select(
        "example_id", F.size(part).cast("bigint").alias("n_messages"), chat.render_messages(part, True).alias("prompt")
    )


@query
def ground_truth_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Stored record if there is one (here: even ids), else what the first answer holds."""
    stored = F.when(F.col("example_id") % 2 == 0, F.col("record_json"))
    df = I.chat_rows(spark, sf).select("example_id", stored.alias("stored"), chat.first_answer(F.col("messages")).alias("answer"))
    df = recover(df, "answer")
    return df.select(
        "example_id", F.when(F.col("stored").isNotNull(), "stored").otherwise("answer").alias("source"),
        F.coalesce("stored", "json_text").alias("truth"),
    )


@query
def cap_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """All rows, and which of them are among the first."""
    return splits.first_rows(I.examples(spark, sf, "scenario"), "example_id", FIRST_N)


@query
def conversation_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """First answer of every conversation that has one, and whether it holds a record."""
    df = recover(conversations.first_answers(table(configure(spark), sf, "conversations")), "answer")
    return df.select("conv_id", "answer", "valid_json", "is_object")


def budgeted(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("n_tokens", "piece_no")})


@query
def length_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered conversations in pieces that fit the budget."""
    return budgeted(conversations.budget_pieces(table(configure(spark), sf, "conversations"), TOKEN_BUDGET))


@query
def length_budget_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(configure(spark), sf, "documents").select("doc_id", "text")
    df = budgeted(chat.length_budget(docs, "text", 512))
    return df.withColumn("piece_md5", F.md5("piece")).drop("piece")


@query
def dataset_format_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of training rows and of pairs, counted."""
    rows = I.chat_rows(spark, sf)
    shape = chat.role_shape(F.col("messages"))
    sft = recover(rows.withColumn("answer", chat.first_answer(F.col("messages"))), "answer").select(
        F.lit("sft").alias("dataset"), *[c.alias(n) for n, c in shape.items()], F.col("valid_json").alias("answer_parses"),
    )
    p = I.pairs(spark, sf)
    one = lambda c: (F.size(c) == 1) & (F.col(c)[0]["role"] == "assistant")
    flags = chat.role_shape(F.concat("prompt", "chosen"))
    pair = p.select(
        F.lit("pairs").alias("dataset"), *[c.alias(n) for n, c in flags.items()],
        ((F.size("prompt") == 2) & one("chosen") & one("rejected")).alias("answer_parses"),
    )
    both = sft.unionByName(pair)
    return both.groupBy("dataset", "has_system", "has_user", "has_assistant", F.col("answer_parses").alias("shape_ok")).agg(
        F.count("*").alias("n")
    )


@query
def conversation_shape_audit(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(configure(spark), sf, "conversations")
    has = lambda r: F.max((F.col("role") == r).cast("int")) == 1
    per = turns.groupBy("conv_id").agg(*[has(r).alias(f"has_{r}") for r in ("system", "user", "assistant")])
    return per.groupBy("has_system", "has_user", "has_assistant").agg(F.count("*").alias("n"))


# --- extraction -------------------------------------------------------------------


@query
def request_admission(spark: SparkSession, sf: str) -> DataFrame:
    docs = extraction.with_admission(table(configure(spark), sf, "documents"), limit=extraction.MAX_CHARS)
    return docs.select("doc_id", "admission", F.length("text").cast("bigint").alias("chars"))


@query
def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.with_prompt(table(configure(spark), sf, "documents")).select("doc_id", "prompt")


@query
def extract_rule_based(spark: SparkSession, sf: str) -> DataFrame:
    return I.examples(spark, sf, "text").select("example_id", extraction.rule_based_output(F.col("text")).alias("raw_output"))


@query
def rule_based_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern extractor scored like a model."""
    ex = written(I.examples(spark, sf, "scenario", "text", "record_json"), "examples")
    out = ex.select(F.lit("patterns").alias("model"), "example_id", extraction.rule_based_output(F.col("text")).alias("raw_output"))
    return compare.model_metrics(scoring.score(out, ex.drop("text"))).select(
        "model", "total_samples", "entity_recall", "entity_precision", "date_normalization_recall", "financial_recall"
    )


def _pattern_model():
    """Loader of a small extractor for the model seam: names, dates and amounts by the patterns of
    ``rule_based_output``.  Inner functions travel to the executors by value, so this package need not be
    installed there."""
    name, day, amount, months = extraction.NAME_PATTERN, extraction.DATE_PATTERN, extraction.AMOUNT_PATTERN, extraction.MONTHS

    def load():
        import json
        import re
        from datetime import datetime
        from decimal import Decimal

        find = [re.compile(p, re.ASCII) for p in (name, day, amount)]
        no_name = re.compile(f"(?:{months}) ")

        def date(raw: str) -> dict:
            try:
                return {"raw": raw, "normalized": datetime.strptime(raw, "%B %d, %Y").strftime("%Y-%m-%d")}
            except ValueError:
                return {"raw": raw}

        def money(text: str) -> dict:
            scale = 1_000_000_000 if text[-1] == "B" else 1_000_000
            return {"type": "amount", "amount": int(Decimal(text[1:-1]) * scale), "currency": text[0]}

        def one(text: str) -> str:
            names, days, amounts = (list(dict.fromkeys(p.findall(text))) for p in find)
            record = {
                "event_type": "unknown", "entities": [{"type": "organization", "name": n} for n in names if not no_name.match(n)],
                "dates": [date(d) for d in days], "financials": [money(a) for a in amounts],
            }
            return json.dumps(record, separators=(",", ":"), ensure_ascii=False)

        return lambda texts: [one(t) for t in texts]

    return load


def _absent_model():
    """Loader that fails, as where weights are missing."""

    def load():
        raise OSError("no weights")

    return load


def _response_rows(df: DataFrame) -> DataFrame:
    status = extraction.request_status(
        F.col("admission"), F.col("latency_ms"), F.col("error"), F.col("valid_json"), F.col("loaded")
    )
    return df.select(
        "doc_id", "raw_output", "valid_json", "schema_valid", "typed_ok", "error", status.alias("status")
    )


@query
def extract_plugged_model(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through the model seam: Arrow batches, one load per worker, failures as rows."""
    docs = table(configure(spark), sf, "documents")
    generate = jobs.model_generator(_pattern_model(), "doc_id", "text")
    return _response_rows(jobs.extract_requests(docs, generate, "doc_id"))


@query
def extract_absent_model(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a model that cannot be loaded: every admitted request says so."""
    docs = table(configure(spark), sf, "documents")
    rows = _response_rows(jobs.extract_requests(docs, jobs.model_generator(_absent_model(), "doc_id", "text"), "doc_id"))
    return rows.groupBy("status", "error").agg(F.count("*").alias("n"))


@query
def recover_json(spark: SparkSession, sf: str) -> DataFrame:
    return recover(I.outputs(spark, sf)).select("model", "example_id", "valid_json", "is_object", "json_text")


@query
def repair_truncated_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return repair_truncated(I.outputs(spark, sf)).select("model", "example_id", "was_truncated", "repaired")


QUERIES["repair_truncated"] = QUERIES.pop("repair_truncated_outputs")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    df = recover(I.outputs(spark, sf), repair=True)
    return staged(df, {"violations": violations(F.col("parsed"), F.col("is_object"))})


@query
def schema_validate(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select(
        "model", "example_id", "valid_json",
        F.coalesce(F.size("violations") == 0, F.lit(False)).alias("schema_valid"), joined(F.col("violations")).alias("violations"),
    )


@query
def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = _checked(spark, sf).select("model", F.explode("violations").alias("rule"))
    return rules.groupBy("model", "rule").agg(F.count("*").alias("n"))


def _odd(spark: SparkSession, sf: str) -> DataFrame:
    return odd_predictions(I.example_ids(spark, sf))


@query
def odd_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Recovery of outputs with text behind, two values, repeated keys, bare values, open fences."""
    return recover(_odd(spark, sf)).select("example_id", "valid_json", "is_object", "json_text")


@query
def odd_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the schema, broken."""
    df = recover(_odd(spark, sf))
    rules = df.select(F.explode(violations(F.col("parsed"), F.col("is_object"))).alias("rule"))
    return rules.groupBy("rule").agg(F.count("*").alias("n"))


@query
def odd_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of such outputs."""
    return compare.model_metrics(scoring.score(_odd(spark, sf), I.truth(spark, sf)))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.typed_projection(with_candidate(I.outputs(spark, sf)))


@query
def typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("result")
    count = lambda s: F.size(r[s]).cast("bigint").alias(f"n_{s}")
    known = lambda c: F.when(F.col("typed_ok"), c)
    total = F.aggregate(r["financials"], F.lit(0.0), lambda acc, f: acc + f["amount"])
    return _typed(spark, sf).select(
        "model", "example_id", "typed_ok", r["event_type"].alias("event_type"),
        *[known(count(s)).alias(f"n_{s}") for s in extraction.SECTION_FIELDS],
        known(total).alias("amount_total"),
    )


@query
def extraction_response(spark: SparkSession, sf: str) -> DataFrame:
    out = I.outputs(spark, sf).withColumn(
        "request_id", extraction.short_id(F.col("model"), F.col("example_id").cast("string"))
    )
    df = extraction.respond(out, include_raw=False)
    return df.select(
        "request_id", "raw_output", "valid_json", "schema_valid", F.col("result").isNotNull().alias("has_result"),
        F.col("result.event_type").alias("event_type"),
    )


@query
def request_status(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of every output as a request; latency and failures are drawn per request."""
    df = recover(I.outputs(spark, sf))
    df = with_draws(df, "example_id", SEED, "status", ["latency", "error", "size"])
    latency = F.pmod("draw_latency", F.lit(130_000)).cast("double")
    error = F.when(F.pmod("draw_error", F.lit(50)) == 0, "boom")
    admission = F.when(F.pmod("draw_size", F.lit(25)) == 0, "too_large").otherwise("ok")
    status = extraction.request_status(admission, latency, error, F.col("valid_json"), F.lit(True))
    return df.select("model", status.alias("status")).groupBy("model", "status").agg(F.count("*").alias("n"))


@query
def document_request_status(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of every document as a request, by language: admission, measured latency and errors, what was found."""
    docs = table(configure(spark), sf, "documents")
    generate = jobs.model_generator(_pattern_model(), "doc_id", "text")
    rows = _response_rows(jobs.extract_requests(docs, generate, "doc_id", limit=extraction.MAX_CHARS))
    return docs.select("doc_id", "lang").join(rows, "doc_id").groupBy("lang", "status").agg(F.count("*").alias("n"))


@query
def date_normalize(spark: SparkSession, sf: str) -> DataFrame:
    df = I.corrupted(spark, sf).select("example_id", "kind", F.from_json("corrupted_json", "dates array<struct<raw:string,normalized:string>>").alias("r"))
    d = df.select("example_id", "kind", F.explode("r.dates").alias("d")).select("example_id", "kind", "d.raw", "d.normalized")
    iso = extraction.normalized_date(F.col("raw"))
    return d.select(
        "example_id", "kind", "raw", "normalized", iso.alias("iso"),
        F.coalesce(iso == F.col("normalized"), F.lit(False)).alias("is_normalized"),
    )


def _section_query(section: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        raw = I.corrupted(spark, sf).select("example_id", F.col("corrupted_json").alias("raw_output"))
        rows = extraction.section_rows(extraction.typed_projection(with_candidate(raw)), section)
        return rows.withColumn("pos", F.col("pos").cast("bigint"))

    return run


for _section in extraction.SECTION_FIELDS:
    QUERIES[f"explode_{_section}"] = _section_query(_section)


# --- scoring ----------------------------------------------------------------------


@query
def align_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.align(I.outputs(spark, sf), I.truth(spark, sf), how="inner").select(
        "model", "example_id", "scenario", F.length("raw_output").cast("bigint").alias("output_chars"),
        F.length("record_json").cast("bigint").alias("truth_chars"),
    )


METRIC_QUERIES = {
    "metric_schema": ["schema_compliance"],
    "metric_sections": ["section_recall", "section_precision"],
    "metric_entities": ["entity_recall", "entity_precision", "entity_f1"],
    "metric_dates": ["date_normalization_recall", "date_normalization_precision"],
    "metric_financials": ["financial_recall", "financial_precision"],
    "metric_structure": ["structural_fidelity"],
    "metric_hallucinations": ["hallucination_count"],
}


def _metric_query(metrics: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return I.scores(spark, sf, metrics).select("model", "example_id", *[F.round(m, 6).alias(m) for m in metrics])

    return run


for _name, _metrics in METRIC_QUERIES.items():
    QUERIES[_name] = _metric_query(_metrics)


@query
def top_hallucinations(spark: SparkSession, sf: str) -> DataFrame:
    names = scoring.hallucinated_names(I.scores(spark, sf, ["hallucination_count"]))
    return names.groupBy("model", "name").agg(F.count("*").alias("n"))


@query
def missed_entities(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.missed_names(I.scores(spark, sf, ["entity_recall"])).groupBy("model", "name").agg(F.count("*").alias("n"))


@query
def sample_report(spark: SparkSession, sf: str) -> DataFrame:
    return I.scores(spark, sf, ["entity_f1"]).select("model", "example_id", "valid_json", "preview", F.round("entity_f1", 6).alias("entity_f1"))


@query
def error_samples(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.error_samples(I.scores(spark, sf, ["entity_f1"])).select(
        "model", "example_id", "preview", F.round("entity_f1", 6).alias("entity_f1")
    )


# --- comparison -------------------------------------------------------------------


@query
def valid_json_rate(spark: SparkSession, sf: str) -> DataFrame:
    return compare.valid_json_rate(recover(I.outputs(spark, sf), repair=True))


@query
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return compare.model_metrics(I.scores(spark, sf, METRICS))


@query
def model_metrics_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """The same from stored features: what a second scoring of the same outputs costs."""
    return compare.model_metrics(scoring.score_features(*I.stored_sides(spark, sf)))


@query
def model_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Expected models against the evaluated ones; one was never run, one broke off."""
    found = compare.model_metrics(I.scores(spark, sf, METRICS))
    told = [(m, None) for m in [*MODELS, "absent"]] + [("broken", "OSError: no weights")]
    expected = spark.createDataFrame(told, "model string, error string")
    return compare.model_coverage(expected, found).select(
        "model", "status", "error", "total_samples", "error_samples", "valid_json_rate", "entity_f1"
    )


@query
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    return compare.metrics_long(compare.model_metrics(I.scores(spark, sf, METRICS)))


@query
def metrics_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return compare.metrics_pivot(compare.model_metrics(I.scores(spark, sf, METRICS)), MODELS)


@query
def metrics_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Every model against the first."""
    results = written(compare.model_metrics(I.scores(spark, sf, METRICS)), "results")  # a row per model
    out = None
    for model in MODELS[1:]:
        part = compare.metrics_delta(results, model, MODELS[0]).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


@query
def find_model(spark: SparkSession, sf: str) -> DataFrame:
    """First hit in the order of the list of models."""
    models = compare.valid_json_rate(recover(I.outputs(spark, sf), repair=True))
    models = models.withColumn("place", F.array_position(F.array(*map(F.lit, MODELS)), F.col("model")))
    hit = lambda part: compare.find_model(models, part, "place")
    return hit("T").unionByName(hit("clean")).unionByName(hit("base"))


@query
def metrics_by_scenario(spark: SparkSession, sf: str) -> DataFrame:
    return compare.metrics_by_scenario(I.scores(spark, sf, METRICS))


# --- training logs ----------------------------------------------------------------


@query
def classify_log_entries(spark: SparkSession, sf: str) -> DataFrame:
    return trainlog.classify(I.train_log(spark, sf)).groupBy("run", "kind").agg(F.count("*").alias("n"))


def _log_query(f):
    return lambda spark, sf: f(I.train_log(spark, sf))


for _name, _f in {
    "train_series": trainlog.train_series, "eval_series": trainlog.eval_series, "reward_margins": trainlog.reward_series,
    "loss_reduction": trainlog.loss_reduction, "run_summary": trainlog.run_summary, "total_runtime": trainlog.total_runtime,
    "sft_step_table": trainlog.sft_step_table, "dpo_step_table": trainlog.dpo_step_table,
}.items():
    QUERIES[_name] = _log_query(_f)


@query
def series_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return trainlog.downsample(trainlog.train_series(I.train_log(spark, sf)))


@query
def series_levels(spark: SparkSession, sf: str) -> DataFrame:
    series = trainlog.train_series(I.train_log(spark, sf))
    low = trainlog.levels(series).withColumn("curve", F.lit("loss"))
    high = trainlog.levels(series, "mean_token_accuracy", lower_is_better=False).withColumn("curve", F.lit("accuracy"))
    return low.unionByName(high).withColumn("level", F.col("level").cast("bigint"))


# --- request logs -----------------------------------------------------------------

for _name, _f in {
    "requests_by_status": requests.requests_by_status, "latency_histogram": requests.latency_histogram,
    "peak_concurrency": requests.peak_concurrency, "throughput": requests.throughput,
    "success_failure": requests.success_failure, "latency_summary": requests.latency_summary,
    "latency_percentiles": requests.latency_percentiles, "request_metrics_windowed": requests.request_metrics_windowed,
}.items():
    QUERIES[_name] = lambda spark, sf, f=_f: f(I.request_log(spark, sf))


@query
def latency_percentiles_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of every hour and of every day, from one stored table of hourly sketches."""
    log = I.request_log(spark, sf)
    sketch, out = written(requests.rank_sketch(log), "ranks"), None
    for period in ("hour", "day"):
        part = requests.percentiles_over(sketch, log, lambda t, unit=period: F.date_trunc(unit, t))
        part = part.withColumns({"period": F.lit(period), "start": F.date_format("start", "yyyy-MM-dd HH:mm:ss")})
        out = part if out is None else out.unionByName(part)
    return out


@query
def inflight_requests(spark: SparkSession, sf: str) -> DataFrame:
    df = requests.inflight_requests(I.request_log(spark, sf))
    return df.select("service", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "inflight")


@query
def failure_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every failure with its place in the service's log."""
    df = requests.failures(I.request_log(spark, sf))
    return df.select("service", F.col("place").cast("bigint").alias("place"), "request_id", F.col("status_code").cast("bigint").alias("status_code"), "elapsed_s", "error")


# --- streams ----------------------------------------------------------------------
# Registering these queries runs nothing; calling one runs its stream to the end of the input, since
# what a stream has written is the table that is returned.


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(configure(spark), sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


@query
def stream_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The batch extraction as a stream."""
    generate = jobs.model_generator(_pattern_model(), "doc_id", "text")
    rows = _response_rows(jobs.extract_requests(_stream(spark, sf, "documents"), generate, "doc_id"))
    out, state = _folders(spark, "extraction")
    jobs.run_available(rows, out, state)
    return spark.read.parquet(out)


@query
def stream_intake_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every request delivered twice, taken in once."""
    one = lambda: _stream(spark, sf, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("kind"))
    out, state = _folders(spark, "intake")
    jobs.intake_once(one().unionByName(one()), out, state)
    return spark.read.parquet(out).select("request_id", "kind")


DELIVERIES, LATE_BY = 4, "10 minutes"


def _deliveries(log: DataFrame) -> DataFrame:
    """The log with the number of the delivery a request comes in: in quarters of the time, one in ten a quarter later."""
    t = F.unix_micros("start_ts")
    ends = log.agg(F.struct(F.min(t).alias("first"), F.max(t).alias("last")).alias("t")).scalar()
    quarter = F.floor((t - ends["first"]) * DELIVERIES / (ends["last"] - ends["first"] + 1))
    return log.withColumn("delivery", F.least(quarter + F.when(F.col("request_id") % 10 == 0, 1).otherwise(0), F.lit(DELIVERIES - 1)))


@query
def stream_request_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed request metrics as a stream with a watermark: windows that are over, those still open, and what
    came too late for its window, so that every request is in one of them."""
    log = I.request_log(spark, sf).withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    log = written(_deliveries(log), "log")
    schema = "request_id bigint, service string, start_ts timestamp, elapsed_s double, status string, status_code int, error string"
    out, state = _folders(spark, "metrics")
    for k in range(DELIVERIES):
        log.filter(F.col("delivery") == k).select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{out}/in/{k}")
        arrived = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/in")
        jobs.split_late(arrived, out, f"{state}/split", LATE_BY)
    jobs.closed_windows(spark, schema, out, f"{state}/windows", LATE_BY)
    metrics, landed = requests.request_metrics_windowed, lambda name: spark.read.schema(schema).parquet(f"{out}/{name}/batch=*")
    still_open = metrics(landed("rows"))
    closed = spark.read.schema(still_open.schema).parquet(f"{out}/windows")
    still_open = still_open.join(closed.select("window_start").distinct(), "window_start", "left_anti")
    parts = {"closed": closed, "open": still_open, "late": metrics(landed("late"))}
    told = [part.withColumn("state", F.lit(name)) for name, part in parts.items()]
    return told[0].unionByName(told[1]).unionByName(told[2])
