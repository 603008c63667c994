"""Generation of (text, record) examples.

Everything here is a narrow projection over the rows of the input table, whose bare ids are
dealt out once, and no Python on executors.  Values are staged (draws, then slots, then text and record) so that
no draw is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F

from factloom import vocabulary as V
from factloom.functions.draws import between, digest, lane, pick, pick_from, places_of, with_draws, word
from factloom.functions.plan import built_once, staged
from factloom.session import spread
from factloom.operators.scenarios import SCENARIOS, SCENARIO_NAMES, Choice, Scenario, Whole

SEED = 42
DRAWS = [
    "scenario", "org_a", "org_b", "org_c", "person_a", "person_b", "product", "location",
    "amount_a", "amount_b", "amount_c", "day", "attr_a", "attr_b", "attr_c", "attr_d",
]
# A slot may avoid the values of slots in an earlier stage.
SLOT_STAGES = (
    ("org_a", "person_a", "product", "location", "attr_a", "attr_b", "attr_c", "attr_d"),
    ("org_b", "person_b"),
    ("org_c",),
)
AMOUNT_SLOTS = ("amount_a", "amount_b", "amount_c")
SECTIONS = ("entities", "relationships", "financials", "dates", "metrics")
UNKNOWN = "Unknown"


def text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


@built_once
def _amounts() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(text).alias("text"), F.lit(value).cast("bigint").alias("value"), F.lit(text[0]).alias("currency")
            )
            for text, value in V.AMOUNTS
        ]
    )


def amount_choice(draw: Column) -> Column:
    """(text, value, currency) of the amount table; currency is the text's first character."""
    return pick(_amounts(), draw)


def day_choice(draw: Column) -> Column:
    return F.date_add(F.lit(V.FIRST_DAY).cast("date"), F.pmod(draw, F.lit(V.DAY_SPAN)).cast("int"))


def date_pair(day: Column) -> dict[str, Column]:
    """One date in its two spellings: as printed and ISO."""
    return {
        "date_raw": F.date_format(day, "MMMM d, yyyy"),
        "date_norm": F.date_format(day, "yyyy-MM-dd"),
    }


def _by_scenario(build: Callable[[Scenario], Column | None]) -> Column:
    """One column from a per-scenario builder.  Scenarios with nothing to say give null;
    scenarios with the same expression text are still separate branches."""
    chain = None
    for s in SCENARIOS:
        value = build(s)
        if value is None:
            continue
        condition = F.col("scenario") == s.name
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def _place(pool: str, slot: str) -> str:
    return f"_{slot}_in_{pool}"


@built_once
def _places(stage: tuple[str, ...]) -> dict[str, Column]:
    """Places of the values that slots of a stage avoid, in the pools these draw from."""
    drawn = [(s, c) for s in SCENARIOS for c in s.slots.values() if isinstance(c, Choice) and c.draw in stage]
    avoided = {(c.pool, s.slots[w].draw) for s, c in drawn for w in c.without}
    return {_place(pool, slot): places_of(V.POOLS[pool], F.col(slot)) for pool, slot in sorted(avoided)}


@built_once
def _slot_column(draw_name: str) -> Column:
    """Column of one physical slot: scenarios that draw it the same way share a branch."""
    branches: dict[tuple, list[str]] = {}
    for s in SCENARIOS:
        for source in s.slots.values():
            if source.draw != draw_name:
                continue
            if isinstance(source, Choice):
                how = ("pool", source.pool, tuple(s.slots[w].draw for w in source.without))
            else:
                how = ("whole", source.low, source.high, source.suffix)
            branches.setdefault(how, []).append(s.name)
    draw = F.col(f"draw_{draw_name}")
    chain = None
    for how, names in branches.items():
        if how[0] == "pool":
            value = pick_from(V.POOLS[how[1]], draw, [F.col(_place(how[1], w)) for w in how[2]])
        else:
            value = between(draw, how[1], how[2]).cast("string")
            value = F.concat(value, F.lit(how[3])) if how[3] else value
        condition = F.col("scenario").isin(names)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def with_scenario(base: DataFrame, key: str, seed: int = SEED, scenario: str | None = None) -> DataFrame:
    """(example_id, scenario) alone: one of the draws of ``with_slots``, nothing dealt out, nothing staged."""
    ids = base.select(F.col(key).alias("example_id"))
    draw = lane(word(digest(seed, "gen0", "example_id"), 0), DRAWS.index("scenario"))
    return ids.withColumn("scenario", F.lit(scenario) if scenario else pick(text_array(SCENARIO_NAMES), draw))


def with_slots(
    base: DataFrame,
    key: str,
    seed: int = SEED,
    given: Mapping[str, str] | None = None,
    scenario: str | None = None,
) -> DataFrame:
    """Slot columns for every row of ``base``.

    ``given`` maps a slot (``org_a``, ``person_a``, ``product``, ``location``, ``day``) to a column
    of ``base`` that replaces the draw.  ``scenario`` fixes one scenario for all rows.
    """
    given = dict(given or {})
    kept = [F.col(key).alias("example_id")] + [F.col(c).alias(f"given_{s}") for s, c in given.items()]
    df = with_draws(spread(base.select(*kept), "example_id"), "example_id", seed, "gen", DRAWS)
    chosen = F.lit(scenario) if scenario else pick(text_array(SCENARIO_NAMES), F.col("draw_scenario"))
    df = staged(df, {"scenario": chosen})
    for stage in SLOT_STAGES:
        df = df.withColumns(_places(stage))
        df = staged(df, {s: F.col(f"given_{s}") if s in given else _slot_column(s) for s in stage})
    day = F.col("given_day") if "day" in given else day_choice(F.col("draw_day"))
    df = df.withColumns({a: amount_choice(F.col(f"draw_{a}")) for a in AMOUNT_SLOTS})
    df = df.withColumns(date_pair(day))
    slots = [s for stage in SLOT_STAGES for s in stage]
    return df.select("example_id", "scenario", *slots, *AMOUNT_SLOTS, "date_raw", "date_norm")


def missing_slots(slots: DataFrame) -> DataFrame:
    """Add ``missing``: names of the row's required slots that are null."""

    def of(s: Scenario) -> Column:
        names = [F.when(F.col(src.draw).isNull(), F.lit(name)) for name, src in s.slots.items()]
        names.append(F.when(F.col("date_raw").isNull(), F.lit("date_raw")))
        return F.filter(F.array(*names), lambda n: n.isNotNull())

    return staged(slots, {"missing": _by_scenario(of)})


def fill_unknown(slots: DataFrame) -> DataFrame:
    """Required slots without a value become the literal ``Unknown``."""
    needed: dict[str, list[str]] = {}
    for s in SCENARIOS:
        for source in s.slots.values():
            needed.setdefault(source.draw, []).append(s.name)
    filled = {
        draw: F.when(F.col("scenario").isin(names), F.coalesce(F.col(draw), F.lit(UNKNOWN))).otherwise(F.col(draw))
        for draw, names in needed.items()
    }
    filled["date_raw"] = F.coalesce(F.col("date_raw"), F.lit(UNKNOWN))
    filled["date_norm"] = F.coalesce(F.col("date_norm"), F.lit(UNKNOWN))
    return slots.withColumns(filled)


def _value(s: Scenario, name: str) -> Column:
    if name in s.slots:
        return F.col(s.slots[name].draw)
    if name in s.money:
        return F.col(s.money[name])["text"]
    return F.col(name)


def fill(s: Scenario, pattern: str) -> Column:
    """A pattern with named slots as one concatenation."""
    parts = []
    for literal, name, _, _ in Formatter().parse(pattern):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(_value(s, name))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def slot_table(slots: DataFrame) -> DataFrame:
    """Slots in long form: (example_id, scenario, slot, value)."""

    def of(s: Scenario) -> Column:
        pairs = [F.struct(F.lit(n).alias("slot"), _value(s, n).alias("value")) for n in s.slots]
        return F.array(*pairs)

    return slots.select("example_id", "scenario", F.explode(_by_scenario(of)).alias("s")).select(
        "example_id", "scenario", "s.slot", "s.value"
    )


def money_table(slots: DataFrame, currency_mode: str = "own") -> DataFrame:
    """Every named amount of an example in long form."""

    def of(s: Scenario) -> Column | None:
        if not s.money:
            return None
        return F.array(
            *[
                F.struct(
                    F.lit(n).alias("slot"), F.col(d)["text"].alias("text"), F.col(d)["value"].alias("value"),
                    _currency(d, currency_mode).alias("currency"),
                )
                for n, d in s.money.items()
            ]
        )

    return slots.select("example_id", "scenario", F.explode(_by_scenario(of)).alias("m")).select(
        "example_id", "scenario", "m.slot", "m.text", "m.value", "m.currency"
    )


def _currency(draw: str, mode: str) -> Column:
    """``own``: the sign printed with the amount.  ``first``: the sign of the first amount
    drawn for the row, for all its amounts."""
    return F.col(draw if mode == "own" else "amount_a")["currency"]


@built_once
def rendered_text() -> Column:
    return _by_scenario(lambda s: fill(s, s.text))


def _optional(s: Scenario, extra: Mapping[str, str], names: tuple[str, ...]) -> list[Column]:
    none = F.lit(None).cast("string")
    return [(fill(s, extra[n]) if n in extra else none).alias(n) for n in names]


def _metric_value(s: Scenario, source: str) -> Column:
    if "{" in source:
        return fill(s, source).cast("variant")
    slot = s.slots.get(source)
    if isinstance(slot, Whole) and not slot.suffix:
        return F.col(slot.draw).cast("bigint").cast("variant")
    return _value(s, source).cast("variant")


@built_once
def record_columns(currency_mode: str = "own") -> dict[str, Column]:
    """The record's fields as typed columns; fields a scenario lacks are null and so are
    left out of the JSON.  Amounts and metric values are VARIANT (text or number)."""

    def entities(s: Scenario) -> Column:
        return F.array(
            *[F.struct(F.lit(t).alias("type"), _value(s, n).alias("name")) for t, n in s.entities]
        )

    def financials(s: Scenario) -> Column | None:
        if not s.financials:
            return None
        return F.array(
            *[
                F.struct(
                    F.lit(t).alias("type"),
                    F.col(s.money[n])["value"].cast("variant").alias("amount"),
                    _currency(s.money[n], currency_mode).alias("currency"),
                    *_optional(s, extra, ("series", "period")),
                )
                for t, n, extra in s.financials
            ]
        )

    def dates(s: Scenario) -> Column:
        return F.array(
            F.struct(
                F.col("date_raw").alias("raw"), F.col("date_norm").alias("normalized"),
                F.lit(s.date_role).alias("context"),
            )
        )

    def relationships(s: Scenario) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(t).alias("type"), fill(s, a).alias("subject"), fill(s, b).alias("object"),
                    *_optional(s, extra, ("role", "value", "date", "focus")),
                )
                for t, a, b, extra in s.relationships
            ]
        )

    def metrics(s: Scenario) -> Column | None:
        if not s.metrics:
            return None
        return F.array(
            *[F.struct(F.lit(n).alias("name"), _metric_value(s, v).alias("value")) for n, v in s.metrics]
        )

    def top(name: str) -> Column:
        return _by_scenario(lambda s: _value(s, name) if name in s.top else None)

    return {
        "event_type": _by_scenario(lambda s: F.lit(s.event_type)),
        "acquirer": top("acquirer"),
        "target": top("target"),
        "company": top("company"),
        "partners": _by_scenario(
            lambda s: F.array(*[_value(s, p) for p in s.partners]) if s.partners else None
        ),
        "entities": _by_scenario(entities),
        "financials": _by_scenario(financials),
        "dates": _by_scenario(dates),
        "relationships": _by_scenario(relationships),
        "metrics": _by_scenario(metrics),
    }


RECORD_FIELDS = (
    "event_type", "acquirer", "target", "company", "partners",
    "entities", "financials", "dates", "relationships", "metrics",
)


COLUMNS = ("scenario", "text", *RECORD_FIELDS, "record_json", "num_entities")


def examples_from_slots(slots: DataFrame, currency_mode: str = "own", columns: Sequence[str] = COLUMNS) -> DataFrame:
    """(example_id, scenario, text, record fields, record_json, num_entities), or the ``columns`` that are asked for:
    what is not asked for is not built."""
    needed = set(columns)
    needed |= set(RECORD_FIELDS) if "record_json" in needed else set()
    needed |= {"entities"} if "num_entities" in needed else set()
    made = {n: c for n, c in {"text": rendered_text(), **record_columns(currency_mode)}.items() if n in needed}
    df = (staged(slots, made) if made else slots).select("example_id", "scenario", *made)
    last = {"record_json": lambda: F.to_json(F.struct(*RECORD_FIELDS)), "num_entities": lambda: F.size("entities")}
    last = {n: build() for n, build in last.items() if n in needed}
    return (staged(df, last) if last else df).select("example_id", *columns)


def generate_examples(
    base: DataFrame,
    key: str,
    seed: int = SEED,
    given: Mapping[str, str] | None = None,
    scenario: str | None = None,
    currency_mode: str = "own",
    on_missing: str = "unknown",
    columns: Sequence[str] = COLUMNS,
) -> DataFrame:
    """One example per row of ``base``, with all ``columns`` or some.  With ``on_missing='reject'`` rows lacking a required
    slot yield no example (see ``missing_slots`` for the rejects); otherwise the slot is
    filled with ``Unknown``."""
    if not given and set(columns) <= {"scenario"}:
        return with_scenario(base, key, seed, scenario).select("example_id", *columns)
    slots = with_slots(base, key, seed, given, scenario)
    if given:
        if on_missing == "reject":
            slots = missing_slots(slots).filter(F.size("missing") == 0).drop("missing")
        else:
            slots = fill_unknown(slots)
    return examples_from_slots(slots, currency_mode, columns)
