"""The same results in DuckDB SQL.

Scenarios, pools and the record schema are data shared with the Spark side; the SQL itself is
written for DuckDB (string building, JSON functions, plain window ranks) and shares no code.
"""

from __future__ import annotations

from string import Formatter

from factloom import vocabulary as V
from factloom.functions import chat
from factloom.functions.schema_rules import RECORD_SCHEMA
from factloom.operators import corrupt as C
from factloom.operators import extraction as E
from factloom.operators.conversations import TURNS_PER_PIECE
from factloom.operators.generate import DRAWS, SEED
from factloom.operators.requests import BOUNDS, PERCENTILES
from factloom.operators.compare import LABELS
from factloom.plans.pseudo_models import MODELS, ODD
from factloom.operators.scenarios import SCENARIOS, SCENARIO_NAMES, Choice, Whole
from factloom.operators.scoring import METRICS, NOTE_KEY
from factloom.plans.queries import (
    CORRUPT_QUERIES, DELIVERIES, FIRST_N, METRIC_QUERIES, RECORD_QUERIES, TOKEN_BUDGET,
)

ORACLE: dict[str, str] = {}


def lit(text: str) -> str:
    parts = text.split("\n")
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts) + ")" if len(parts) > 1 else "'" + text.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


# --- draws and slots --------------------------------------------------------------


def draws_sql(source: str, key: str, stage: str, names, keep: str) -> str:
    """SELECT with one BIGINT column d_<name> per draw."""
    n = (len(names) + 5) // 6
    digests = ", ".join(f"md5('{SEED}:{stage}{i}:' || {key}) AS g{i}" for i in range(n))
    words = ", ".join(
        f"('0x' || substr(g{w // 2}, {1 + 15 * (w % 2)}, 15))::BIGINT AS w{w}" for w in range((len(names) + 2) // 3)
    )
    lanes = ", ".join(f"(w{i // 3} >> {20 * (i % 3)}) & 1048575 AS d_{x}" for i, x in enumerate(names))
    return (
        f"SELECT * EXCLUDE ({', '.join([f'g{i}' for i in range(n)] + [f'w{w}' for w in range((len(names) + 2) // 3)])}), {lanes} "
        f"FROM (SELECT *, {words} FROM (SELECT {keep}, {digests} FROM {source}))"
    )


def case(branches: list[tuple[str, str]]) -> str:
    return "CASE scenario " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in branches) + " END"


def slot_sql(draw: str) -> str:
    out = []
    for s in SCENARIOS:
        for src in s.slots.values():
            if src.draw != draw:
                continue
            if isinstance(src, Choice):
                pool = arr(V.POOLS[src.pool])
                if src.without:
                    tests = " AND ".join(f"x IS DISTINCT FROM {s.slots[w].draw}" for w in src.without)
                    pool = f"list_filter({pool}, lambda x: {tests})"
                out.append((s.name, f"{pool}[1 + d_{draw} % len({pool})]"))
            else:
                out.append((s.name, f"({src.low} + d_{draw} % {src.high - src.low + 1})::VARCHAR || '{src.suffix}'"))
    return case(out)


def slots_ctes(source="(SELECT o_orderkey AS example_id FROM orders)", given=None, scenario=None, keep="example_id") -> str:
    given = given or {}
    stage1 = ("org_a", "person_a", "product", "location", "attr_a", "attr_b", "attr_c", "attr_d")
    col = lambda s: f"{given[s]} AS {s}" if s in given else f"{slot_sql(s)} AS {s}"
    sc = f"'{scenario}'" if scenario else f"{arr(SCENARIO_NAMES)}[1 + d_scenario % {len(SCENARIOS)}]"
    texts = arr(t for t, _ in V.AMOUNTS)
    values = "[" + ", ".join(f"{v}::BIGINT" for _, v in V.AMOUNTS) + "]"
    money = ", ".join(
        f"{texts}[1 + d_{a} % {len(V.AMOUNTS)}] AS {a}_t, {values}[1 + d_{a} % {len(V.AMOUNTS)}] AS {a}_v"
        for a in ("amount_a", "amount_b", "amount_c")
    )
    day = given.get("day", f"(DATE '{V.FIRST_DAY}' + (d_day % {V.DAY_SPAN})::INTEGER)")
    return f"""
h AS ({draws_sql(source, 'example_id', 'gen', DRAWS, keep)}),
s0 AS (SELECT *, {sc} AS scenario FROM h),
s1 AS (SELECT *, {', '.join(col(s) for s in stage1)} FROM s0),
s2 AS (SELECT *, {slot_sql('org_b')} AS org_b, {slot_sql('person_b')} AS person_b FROM s1),
slots AS (SELECT *, {slot_sql('org_c')} AS org_c, {money},
  strftime({day}, '%B %-d, %Y') AS date_raw, strftime({day}, '%Y-%m-%d') AS date_norm FROM s2)"""


def val(s, name: str) -> str:
    if name in s.slots:
        return s.slots[name].draw
    if name in s.money:
        return f"{s.money[name]}_t"
    return name


def fill(s, pattern: str) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(pattern):
        if literal:
            parts.append(lit(literal))
        if name:
            parts.append(val(s, name))
    return "(" + " || ".join(parts) + ")"


def obj(pairs) -> str:
    """JSON object text; values are SQL for text unless given as ('raw', sql)."""
    out = []
    for k, v in pairs:
        shown = f"({v[1]})" if isinstance(v, tuple) else f"'\"' || {v} || '\"'"
        out.append(f"'\"{k}\":' || {shown}")
    return "('{' || " + " || ',' || ".join(out) + " || '}')"


def per(build) -> str:
    return case([(s.name, x) for s in SCENARIOS if (x := build(s)) is not None])


def lst(items) -> str:
    return "[" + ", ".join(items) + "]"


def record_ctes(currency="own", source="slots") -> str:
    def cur(s, n):
        return f"left({s.money[n] if currency == 'own' else 'amount_a'}_t, 1)"

    def fin(s, amount):
        if not s.financials:
            return None
        items = []
        for t, n, extra in s.financials:
            v = f"{s.money[n]}_v::VARCHAR"
            shown = {"num": [("amount", ("raw", v))], "text": [("amount", f"('{C.AMOUNT_PREFIX}' || {v})")], "none": []}[amount]
            items.append(obj([("type", lit(t))] + shown + [("currency", cur(s, n))] + [(k, fill(s, x)) for k, x in extra.items()]))
        return lst(items)

    def metric(s, n, src):
        if "{" in src:
            return obj([("name", lit(n)), ("value", fill(s, src))])
        w = s.slots.get(src)
        v = ("raw", w.draw) if isinstance(w, Whole) and not w.suffix else val(s, src)
        return obj([("name", lit(n)), ("value", v)])

    date = lambda s, norm: lst([obj([("raw", "date_raw"), ("normalized", norm), ("context", lit(s.date_role))])])
    rel = lambda s: lst(
        [obj([("type", lit(t)), ("subject", fill(s, a)), ("object", fill(s, b))] + [(k, fill(s, x)) for k, x in ex.items()]) for t, a, b, ex in s.relationships]
    )
    top = lambda s: lst(
        [f"'\"{n}\":\"' || {val(s, n)} || '\"'" for n in s.top]
        + (["'\"partners\":[' || " + " || ',' || ".join(f"'\"' || {val(s, p)} || '\"'" for p in s.partners) + " || ']'"] if s.partners else [])
    )
    return f"""
parts AS (SELECT *,
  {per(lambda s: fill(s, s.text))} AS text,
  {per(lambda s: lit(s.event_type))} AS event_type,
  {per(top)} AS top,
  {per(lambda s: lst([obj([("type", lit(t)), ("name", val(s, n))]) for t, n in s.entities]))} AS ent,
  {per(lambda s: lst([val(s, n) for _, n in s.entities]))} AS ent_names,
  {per(lambda s: arr(t for t, _ in s.entities))} AS ent_types,
  {per(lambda s: fin(s, "num"))} AS fin,
  {per(lambda s: fin(s, "text"))} AS fin_text,
  {per(lambda s: fin(s, "none"))} AS fin_none,
  {per(lambda s: date(s, "date_norm"))} AS dat,
  {per(lambda s: date(s, "date_raw"))} AS dat_bad,
  {per(rel)} AS rel,
  {per(lambda s: lst([metric(s, n, v) for n, v in s.metrics]) if s.metrics else None)} AS met
  FROM {source}),
ex AS (SELECT *, {assemble()} AS record_json FROM parts)"""


def assemble(ent="ent", fin="fin", dat="dat", rel="rel", met="met", tail="[]::VARCHAR[]") -> str:
    sec = lambda name, v: f"'\"{name}\":[' || array_to_string({v}, ',') || ']'"
    pieces = ", ".join(
        sec(n, v) for n, v in (("entities", ent), ("financials", fin), ("dates", dat), ("relationships", rel), ("metrics", met))
    )
    return (
        "'{' || array_to_string(list_concat(list_concat(['\"event_type\":\"' || event_type || '\"'], top), "
        f"list_concat(list_filter([{pieces}], lambda x: x IS NOT NULL), {tail})), ',') || '}}'"
    )


EX = "WITH" + slots_ctes() + "," + record_ctes()


def corrupt_ctes(kind: str | None = None) -> str:
    k = f"'{kind}'" if kind else f"{arr(C.KINDS)}[1 + d_kind % 7]"
    fakes = lst([obj([("type", lit(t)), ("name", lit(n))]) for t, n in V.INVENTED_ENTITIES])
    filled = "list_filter([CASE WHEN len(ent) > 0 THEN 'entities' END, CASE WHEN len(rel) > 0 THEN 'relationships' END, CASE WHEN len(fin) > 0 THEN 'financials' END, CASE WHEN len(dat) > 0 THEN 'dates' END, CASE WHEN len(met) > 0 THEN 'metrics' END], lambda x: x IS NOT NULL)"
    swap = lambda good, bad, at: f"list_transform(range(1, len({good}) + 1), lambda i: CASE WHEN i = {at} THEN {bad}[i] ELSE {good}[i] END)"
    return f"""
c0 AS ({draws_sql('ex', 'example_id', 'pair', C.DRAWS, '*')}),
c1 AS (SELECT *, {k} AS kind, {filled} AS filled FROM c0),
c2 AS (SELECT *, CASE WHEN kind = 'missing_field' THEN filled[1 + d_section % len(filled)] ELSE '' END AS lost FROM c1),
c3 AS (SELECT *,
  CASE WHEN kind = 'drop_entity' AND len(ent) > 1 THEN list_concat(ent[:(d_item % len(ent))], ent[(d_item % len(ent)) + 2:])
       WHEN kind = 'hallucinate_entity' THEN list_append(ent, {fakes}[1 + d_item % {len(V.INVENTED_ENTITIES)}])
       WHEN kind = 'multiple_errors' AND len(ent) > 1 THEN ent[2:]
       WHEN kind = 'flat_instead_of_nested' OR lost = 'entities' THEN NULL ELSE ent END AS c_ent,
  CASE WHEN fin IS NULL OR lost = 'financials' THEN NULL
       WHEN kind = 'wrong_field_type' THEN {swap('fin', 'fin_text', '1 + d_item % len(fin)')}
       WHEN kind = 'multiple_errors' THEN {swap('fin', 'fin_none', '1')} ELSE fin END AS c_fin,
  CASE WHEN lost = 'dates' THEN NULL WHEN kind = 'bad_normalization' THEN dat_bad ELSE dat END AS c_dat,
  CASE WHEN lost = 'relationships' THEN NULL ELSE rel END AS c_rel,
  CASE WHEN lost = 'metrics' THEN NULL ELSE met END AS c_met,
  list_filter([CASE WHEN kind = 'flat_instead_of_nested' THEN '"{C.FLAT_KEY}":["' || array_to_string(ent_names, '","') || '"]' END,
    CASE WHEN kind = 'multiple_errors' THEN '"{C.NOTE_KEY}":"{C.NOTE}"' END], lambda x: x IS NOT NULL) AS tail FROM c2),
cor AS (SELECT *, {assemble('c_ent', 'c_fin', 'c_dat', 'c_rel', 'c_met', 'tail')} AS corrupted_json FROM c3)"""


CO = EX + "," + corrupt_ctes()
USER = f"{lit(chat.REQUEST)} || text"
PAIRS = CO + f""",
pairs AS (SELECT *, (d_swap % 1000) < {C.SWAP_PER_MILLE} AS swapped,
  CASE WHEN (d_swap % 1000) < {C.SWAP_PER_MILLE} THEN corrupted_json ELSE record_json END AS chosen,
  CASE WHEN (d_swap % 1000) < {C.SWAP_PER_MILLE} THEN record_json ELSE corrupted_json END AS rejected FROM cor)"""

_models = {
    "clean": "record_json",
    "fenced": f"{lit('Here it is:' + chr(10) + '```json' + chr(10))} || record_json || {lit(chr(10) + '```' + chr(10) + 'Anything else?')}",
    "chatty": f"'  The text describes one event. ' || record_json || {lit(' That is all.' + chr(10))}",
    "corrupted": "corrupted_json",
    "truncated": "left(record_json, (length(record_json) - CASE WHEN d_cut % 4 = 0 THEN 0 ELSE (length(record_json) * (d_cut_share % 601)) // 1000 END)::BIGINT)",
}
OUT = CO + f""",
o0 AS ({draws_sql('cor', 'example_id', 'cut', ['cut', 'cut_share'], 'example_id, scenario, record_json, corrupted_json')}),
outputs AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, example_id, {sql} AS raw_output FROM o0" for m, sql in _models.items())})"""

SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def recover_ctes(source: str, raw="raw_output", repair=False, name="rec") -> str:
    fence = "'```(?:json)?\\s*([\\s\\S]*?)\\s*```'"
    bare = f"trim({raw}, {SPACE})"
    fixed = (
        f"CASE WHEN starts_with({bare}, '{{') AND NOT ends_with({bare}, '}}') THEN "
        f"CASE WHEN strpos(reverse({bare}), '}}') > 0 THEN left({bare}, length({bare}) - strpos(reverse({bare}), '}}') + 1) ELSE {bare} END "
        f"ELSE {raw} END"
    )
    return f"""
{name}0 AS (SELECT *, {fixed} AS repaired, coalesce(starts_with({bare}, '{{') AND NOT ends_with({bare}, '}}'), FALSE) AS was_truncated FROM {source}),
{name}1 AS (SELECT *, {'repaired' if repair else raw} AS src FROM {name}0),
{name}2 AS (SELECT *, trim(CASE WHEN regexp_matches(src, {fence}) THEN regexp_extract(src, {fence}, 1) ELSE src END, {SPACE}) AS body FROM {name}1),
{name}3 AS (SELECT *, strpos(body, '{{') AS p, CASE WHEN strpos(reverse(body), '}}') > 0 THEN length(body) - strpos(reverse(body), '}}') + 1 ELSE 0 END AS e FROM {name}2),
{name}4 AS (SELECT *, CASE WHEN p > 0 AND e > p THEN substr(body, p, e - p + 1) WHEN p = 0 THEN body END AS cand FROM {name}3),
{name}5 AS (SELECT *, coalesce(cand <> 'null' AND json_valid(cand), FALSE) AS valid_json FROM {name}4),
{name} AS (SELECT * EXCLUDE (src, body, p, e, cand), CASE WHEN valid_json THEN cand END AS json_text,
  coalesce(valid_json AND starts_with(cand, '{{'), FALSE) AS is_object FROM {name}5)"""


def compact(codes: list[str]) -> str:
    return f"list_filter([{', '.join(codes)}], lambda x: x IS NOT NULL)"


SQL_TYPES = {"string": ["VARCHAR"], "number": ["BIGINT", "UBIGINT", "DOUBLE", "HUGEINT"]}


def violations_sql(j: str = "json_text") -> str:
    def types(schema):
        t = schema["type"]
        return ", ".join(f"'{x}'" for k in ([t] if isinstance(t, str) else t) for x in SQL_TYPES[k])

    codes = [f"CASE WHEN json_type({j}, '$.{k}') IS NULL THEN '$.{k}:required' END" for k in RECORD_SCHEMA["required"]]
    for name, sub in RECORD_SCHEMA["properties"].items():
        kind = f"json_type({j}, '$.{name}')"
        if "items" not in sub:
            codes.append(f"CASE WHEN {kind} NOT IN ({types(sub)}) THEN '$.{name}:type' END")
            continue
        codes.append(f"CASE WHEN {kind} <> 'ARRAY' THEN '$.{name}:type' END")
        items = f"json_extract({j}, '$.{name}[*]')"
        any_ = lambda test: f"len(list_filter({items}, lambda x: {test})) > 0"
        codes.append(f"CASE WHEN {any_(chr(106) + 'son_type(x) <> ' + chr(39) + 'OBJECT' + chr(39))} THEN '$.{name}[]:type' END")
        obj_ = "json_type(x) = 'OBJECT' AND "
        for k in sub["items"]["required"]:
            test = obj_ + f"json_type(x, '$.{k}') IS NULL"
            codes.append(f"CASE WHEN {any_(test)} THEN '$.{name}[].{k}:required' END")
        for k, leaf in sub["items"]["properties"].items():
            test = obj_ + f"json_type(x, '$.{k}') NOT IN ({types(leaf)})"
            codes.append(f"CASE WHEN {any_(test)} THEN '$.{name}[].{k}:type' END")
            if "enum" in leaf:
                allowed = ", ".join(f"'{v}'" for v in leaf["enum"])
                test = obj_ + f"json_type(x, '$.{k}') IS NOT NULL AND json_extract_string(x, '$.{k}') NOT IN ({allowed})"
                codes.append(f"CASE WHEN {any_(test)} THEN '$.{name}[].{k}:enum' END")
    return f"CASE WHEN is_object THEN list_sort({compact(codes)}) WHEN valid_json THEN ['$:type'] END"


def features(prefix: str, j: str, bare: bool) -> str:
    """Part lists of a JSON text column."""
    named = f"CASE WHEN json_type(x, '$.name') = 'VARCHAR' AND json_extract_string(x, '$.name') <> '' THEN lower(json_extract_string(x, '$.name')) END"
    name = f"CASE WHEN json_type(x) = 'VARCHAR' THEN lower(json_extract_string(x, '$')) ELSE {named} END" if bare else named
    pair = "coalesce(json_extract(x, '$.raw')::VARCHAR, '\"\"') || ' = ' || coalesce(json_extract(x, '$.normalized')::VARCHAR, '\"\"')"
    ok = "json_type(x, '$.raw') IS NOT NULL AND json_type(x, '$.normalized') IS NOT NULL" if bare else "json_type(x) = 'OBJECT'"
    amount = "CASE WHEN json_type(x, '$.amount') IS NOT NULL THEN coalesce(json_extract_string(x, '$.amount'), 'None') END"
    of = lambda sec, e: f"CASE WHEN is_object THEN coalesce(list_distinct(list_filter(list_transform(json_extract({j}, '$.{sec}[*]'), lambda x: {e}), lambda x: x IS NOT NULL)), []) END"
    return f"""
  CASE WHEN is_object THEN list_distinct(list_filter(json_keys({j}), lambda x: x <> '{NOTE_KEY}')) END AS {prefix}_keys,
  {of('entities', name)} AS {prefix}_names,
  {of('dates', f'CASE WHEN {ok} THEN {pair} END')} AS {prefix}_dates,
  {of('financials', amount)} AS {prefix}_amounts"""


def scores_ctes(source="outputs", truth="(SELECT example_id, scenario, record_json FROM ex)") -> str:
    first = "json_type(json_extract(json_text, '$.entities[0]'))"
    whole = "len(list_filter(json_extract(json_text, '$.entities[*]'), lambda x: json_type(x, '$.type') IS NULL OR json_type(x, '$.name') IS NULL)) = 0"
    shared = lambda p: f"len(list_intersect(truth_{p}, pred_{p}))::DOUBLE"
    rec = lambda p: f"CASE WHEN len(truth_{p}) > 0 THEN {shared(p)} / len(truth_{p}) ELSE 1.0 END"
    pre = lambda p: f"CASE WHEN len(pred_{p}) > 0 THEN {shared(p)} / len(pred_{p}) ELSE 0.0 END"
    return recover_ctes(source, repair=True) + f""",
pf AS (SELECT model, example_id, raw_output, repaired, valid_json, is_object, json_text, {violations_sql()} AS violations,
  CASE WHEN json_type(json_text, '$.entities') IS NULL THEN 1.0::DOUBLE WHEN {first} = 'OBJECT' THEN CASE WHEN {whole} THEN 1.0 ELSE 0.5 END ELSE 0.0 END AS structure,
  {features('pred', 'json_text', True)} FROM rec),
tf AS (SELECT example_id, scenario, {features('truth', 'record_json', False)} FROM (SELECT *, TRUE AS is_object FROM {truth})),
sc0 AS (SELECT pf.*, tf.* EXCLUDE (example_id) FROM pf LEFT JOIN tf USING (example_id)),
sc1 AS (SELECT *,
  CASE WHEN is_object THEN (len(violations) = 0)::INTEGER::DOUBLE END AS schema_compliance,
  CASE WHEN is_object THEN {rec('keys')} END AS section_recall, CASE WHEN is_object THEN {pre('keys')} END AS section_precision,
  CASE WHEN is_object THEN {rec('names')} END AS entity_recall, CASE WHEN is_object THEN {pre('names')} END AS entity_precision,
  CASE WHEN is_object THEN {rec('dates')} END AS date_normalization_recall, CASE WHEN is_object THEN {pre('dates')} END AS date_normalization_precision,
  CASE WHEN is_object THEN {rec('amounts')} END AS financial_recall, CASE WHEN is_object THEN {pre('amounts')} END AS financial_precision,
  CASE WHEN is_object THEN structure END AS structural_fidelity,
  CASE WHEN is_object THEN (len(pred_names) - len(list_intersect(pred_names, truth_names)))::DOUBLE END AS hallucination_count FROM sc0),
scores AS (SELECT *, CASE WHEN entity_recall + entity_precision > 0 THEN 2 * entity_recall * entity_precision / (entity_recall + entity_precision)
  WHEN entity_recall + entity_precision = 0 THEN 0.0 END AS entity_f1 FROM sc1)"""


SC = OUT + "," + scores_ctes()
MM = SC + f""",
mm AS (SELECT model, count(*) AS total_samples, count(*) FILTER (valid_json AND entity_f1 < 0.5) AS error_samples,
  round(avg(valid_json::INTEGER), 6) AS valid_json_rate,
  {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)},
  {', '.join(f'round(avg(coalesce({m}, 0.0)), 6) AS {m}_all' for m in METRICS if m != 'hallucination_count')}
  FROM scores GROUP BY model)"""
RC = OUT + "," + recover_ctes("outputs")
RCR = OUT + "," + recover_ctes("outputs", repair=True)


def typed_ctes(source="rec") -> str:
    j = "json_text"
    t = lambda k, x="x": f"json_type({x}, '$.{k}')"
    strs = lambda *ks: "json_type(x) = 'OBJECT' AND " + " AND ".join(f"coalesce({t(k)} = 'VARCHAR', FALSE)" for k in ks)
    opt = lambda k: f"coalesce({t(k)} IN ('VARCHAR', 'NULL'), TRUE)"
    number = "try_cast(json_extract_string(x, '$.amount') AS DOUBLE) IS NOT NULL"
    tests = {
        "entities": strs("type", "name"), "dates": strs("raw", "normalized") + " AND " + opt("context"),
        "financials": strs("type") + " AND " + number + " AND " + opt("currency"),
        "relationships": strs("type", "subject", "object"),
        "metrics": strs("name") + f" AND coalesce({t('value')} IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN'), FALSE)",
    }
    ok = [f"coalesce({t('event_type', j)} = 'VARCHAR', FALSE)"]
    for sec, test in tests.items():
        ok.append(
            f"({t(sec, j)} IS NULL OR ({t(sec, j)} = 'ARRAY' AND len(list_filter(json_extract({j}, '$.{sec}[*]'), lambda x: NOT ({test}))) = 0))"
        )
    return f"typed AS (SELECT *, is_object AND coalesce({' AND '.join(ok)}, FALSE) AS typed_ok FROM {source})"


def q(name: str, sql: str) -> None:
    ORACLE[name] = sql


# --- sources ----------------------------------------------------------------------
TURN = f"'{chat.OPEN}' || role || chr(10) || text || '{chat.CLOSE}' || chr(10)"
def pieces_sql(source: str, columns: str) -> str:
    """Conversations in pieces of some turns: (conv_id, piece, last, ...)."""
    return f"""SELECT conv_id, place // {TURNS_PER_PIECE} AS piece, bool_or(place + 1 = of) AS last, {columns}
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS of FROM {source})
GROUP BY conv_id, piece"""


q("scan_messages", pieces_sql("conversations", "count(*) AS n_messages, string_agg(role, ',' ORDER BY place) AS roles, string_agg(text, chr(10) ORDER BY place) AS contents"))
SPLIT = lambda stage, src="ex": f"(SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:{stage}:' || example_id), example_id) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'eval' END AS split FROM {src})"
q("scan_pairs_by_split", PAIRS + f" SELECT example_id, split, 2::BIGINT AS prompt_messages, chosen, rejected FROM {SPLIT('pair_split', 'pairs')}")
q("merge_model_results", MM + " SELECT model, total_samples, valid_json_rate, entity_f1, CASE WHEN model NOT IN ('truncated', 'chatty') THEN section_recall END AS section_recall FROM mm")

def indented_sql(value: str) -> str:
    """JSON text over several lines, two blanks a level."""
    line = "repeat(' ', (length(l) - length(ltrim(l, ' '))) // 2) || ltrim(l, ' ')"
    return f"array_to_string(list_transform(string_split(json_pretty({value}), chr(10)), lambda l: {line}), chr(10))"


_shown = "'{\"text\":' || to_json(text) || ',\"scenario\":' || to_json(scenario) || ',\"entities\":' || json_extract(record_json, '$.entities') || ',\"dates\":' || json_extract(record_json, '$.dates') || '}'"
q("readable_sample", EX + f" SELECT {indented_sql('j')} AS sample FROM (SELECT arg_min({_shown}, md5('{SEED}:split:' || example_id)) AS j FROM ex)")
q("json_length_profile", EX + f""", len AS (SELECT scenario, unnest(['one_line', 'indented']) AS form, unnest([length(record_json), length({indented_sql('record_json')})]) AS chars FROM ex),
num AS (SELECT *, row_number() OVER (PARTITION BY scenario, form ORDER BY chars) - 1 AS i, count(*) OVER (PARTITION BY scenario, form) AS n FROM len)
SELECT scenario, form, n AS rows, round(avg(chars), 3) AS avg_chars, max(chars) FILTER (i = least(n - 1, floor(n * 0.5::DOUBLE)::BIGINT)) AS p50_chars FROM num GROUP BY scenario, form, n""")

# --- generation -------------------------------------------------------------------
q("gen_pick_excluding", EX + " SELECT example_id, scenario, org_a, org_b, org_c FROM slots")
q("gen_amounts", EX + " SELECT example_id, amount_a_t AS text, amount_a_v AS value, left(amount_a_t, 1) AS currency FROM slots")
q("gen_date_pairs", EX + " SELECT example_id, date_raw, date_norm FROM slots")
_rows = [f"SELECT example_id, scenario, '{n}' AS slot, {src.draw} AS value FROM slots WHERE scenario = '{s.name}'" for s in SCENARIOS for n, src in s.slots.items()]
q("gen_slots", EX + " " + " UNION ALL ".join(_rows))
_rows = [
    f"SELECT example_id, scenario, '{n}' AS slot, {d}_t AS text, {d}_v AS value, left({d if mode == 'own' else 'amount_a'}_t, 1) AS currency, '{mode}' AS currency_mode FROM slots WHERE scenario = '{s.name}'"
    for mode in ("own", "first") for s in SCENARIOS for n, d in s.money.items()
]
q("gen_multi_amounts", EX + " " + " UNION ALL ".join(_rows))
q("render_text", EX + " SELECT example_id, scenario, text FROM ex")
for _q, _s in RECORD_QUERIES.items():
    q(_q, "WITH" + slots_ctes(scenario=_s) + "," + record_ctes() + " SELECT example_id, text, record_json FROM ex")
q("record_first_currency", "WITH" + slots_ctes() + "," + record_ctes("first") + " SELECT example_id, record_json FROM ex")
q("entity_count_profile", EX + " SELECT scenario, len(ent) AS num_entities, count(*) AS n FROM ex GROUP BY ALL")
q("entity_coverage", EX + " SELECT type, count(DISTINCT name) AS names, count(*) AS mentions FROM (SELECT unnest(ent_names) AS name, unnest(ent_types) AS type FROM ex) GROUP BY type")

FACTS = """(SELECT o_orderkey AS example_id, s_name AS f_org, c_name AS f_person, p_name AS f_product, n_name AS f_location, o_orderdate::DATE AS f_day
  FROM orders LEFT JOIN (SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS line FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON line.p = p_partkey LEFT JOIN supplier ON line.s = s_suppkey)"""
_given = {"org_a": "f_org", "person_a": "f_person", "product": "f_product", "location": "f_location", "day": "f_day"}
FX = "WITH" + slots_ctes(FACTS, _given, keep="example_id, f_org, f_person, f_product, f_location, f_day") + "," + record_ctes()
_missing = per(lambda s: compact([f"CASE WHEN {src.draw} IS NULL THEN '{n}' END" for n, src in s.slots.items()] + ["CASE WHEN date_raw IS NULL THEN 'date_raw' END"]))
q("generation_rejects", FX + f" SELECT example_id, scenario, array_to_string(m, ',') AS missing FROM (SELECT example_id, scenario, {_missing} AS m FROM slots) WHERE len(m) > 0")
q("generation_yield", FX + f" SELECT scenario, count(*) AS attempts, count(*) FILTER (len(m) = 0) AS examples FROM (SELECT scenario, {_missing} AS m FROM slots) GROUP BY scenario")
q("fact_examples", FX + f" SELECT example_id, scenario, text, record_json FROM (SELECT *, {_missing} AS m FROM ex) WHERE len(m) = 0")
_need = {d: [s.name for s in SCENARIOS if any(src.draw == d for src in s.slots.values())] for d in ("org_a", "person_a", "product", "location")}
_known = ", ".join(f"CASE WHEN scenario IN ({', '.join(lit(n) for n in names)}) THEN coalesce({d}, 'Unknown') ELSE {d} END AS {d}" for d, names in _need.items())
_filled = f"(SELECT * REPLACE ({_known}, coalesce(date_raw, 'Unknown') AS date_raw, coalesce(date_norm, 'Unknown') AS date_norm) FROM slots)"
q("fact_unknowns", "WITH" + slots_ctes(FACTS, _given, keep="example_id, f_org, f_person, f_product, f_location, f_day") + "," + record_ctes(source=_filled) + " SELECT example_id, scenario, text, record_json FROM ex")
_whole = f"(SELECT * EXCLUDE (m) FROM (SELECT *, {_missing} AS m FROM slots) WHERE len(m) = 0)"
FW = "WITH" + slots_ctes(FACTS, _given, keep="example_id, f_org, f_person, f_product, f_location, f_day") + "," + record_ctes(source=_whole)
q("fact_corruptions", FW + "," + corrupt_ctes() + " SELECT example_id, kind, corrupted_json FROM cor")
q("sft_messages", EX + f" SELECT example_id, 'system,user,assistant' AS roles, {lit(chat.INSTRUCTION)} AS system, {USER} AS user, record_json AS assistant FROM ex")
q("train_eval_split", EX + f" SELECT example_id, scenario, split FROM {SPLIT('split')}")
q("threshold_split", EX + f" SELECT example_id, scenario, CASE WHEN (('0x' || substr(md5('{SEED}:split:' || example_id), 1, 15))::BIGINT & 1048575) < {int(0.9 * (1 << 20))} THEN 'train' ELSE 'eval' END AS split FROM ex")
q("scenario_composition", EX + " SELECT scenario, n, round(100 * n / sum(n) OVER (), 1) AS share_pct FROM (SELECT scenario, count(*) AS n FROM ex GROUP BY scenario)")
q("dataset_summary", EX + f" SELECT coalesce(dataset, '(all)') AS dataset, coalesce(split, '(all)') AS split, count(*) AS n FROM (SELECT 'sft' AS dataset, split FROM {SPLIT('split')} UNION ALL SELECT 'pairs', split FROM {SPLIT('pair_split')}) GROUP BY ROLLUP (dataset, split)")

# --- preference pairs -------------------------------------------------------------
q("preference_pairs", PAIRS + f" SELECT example_id, kind, swapped, {USER} AS user, chosen, rejected FROM pairs")
q("pair_cap", EX + f" SELECT example_id, split AS source_split FROM {SPLIT('split')}")
q("corruption_mix", CO + " SELECT kind, count(*) AS n FROM cor GROUP BY kind")
for _q, _k in CORRUPT_QUERIES.items():
    q(_q, EX + "," + corrupt_ctes(_k) + " SELECT example_id, corrupted_json FROM cor")
q("pair_swap_rate", PAIRS + " SELECT kind, count(*) AS n, count(*) FILTER (swapped) AS swapped, round(avg(swapped::INTEGER), 6) AS rate FROM pairs GROUP BY kind")
q("degenerate_pairs", CO + " SELECT scenario, kind, count(*) AS n FROM cor WHERE record_json = corrupted_json GROUP BY ALL")
q("pair_split", EX + f" SELECT example_id, split FROM {SPLIT('pair_split')}")
turn = lambda role, text: f"'{chat.OPEN}{role}' || chr(10) || {text} || '{chat.CLOSE}' || chr(10)"
HEADER = f"'{chat.OPEN}assistant' || chr(10)"
PROMPT_TEXT = f"{turn('system', lit(chat.INSTRUCTION))} || {turn('user', USER)} || {HEADER}"
q("format_pairs", PAIRS + f" SELECT example_id, {PROMPT_TEXT} AS prompt, chosen, rejected FROM pairs")

# --- training input ---------------------------------------------------------------
q("render_chat", f"SELECT conv_id, string_agg({TURN}, '' ORDER BY turn) AS rendered FROM conversations GROUP BY ALL")
q("prompt_split", f"""SELECT conv_id, count(*) AS n_messages, string_agg({TURN}, '' ORDER BY turn) || {HEADER} AS prompt
FROM (SELECT *, min(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS f FROM conversations) WHERE f IS NULL OR turn < f GROUP BY ALL""")
q("prompt_of_examples", EX + f" SELECT example_id, 2::BIGINT AS n_messages, {PROMPT_TEXT} AS prompt FROM ex")
q("ground_truth_pick", EX + " SELECT example_id, CASE WHEN example_id % 2 = 0 THEN 'stored' ELSE 'answer' END AS source, record_json AS truth FROM ex")
q("cap_first_n", EX + f" SELECT example_id, scenario, row_number() OVER (ORDER BY example_id) <= {FIRST_N} AS among_first FROM ex")
def budget_sql(key: str, source: str, limit: int, piece: str) -> str:
    """Rows (key, n_tokens, over_budget, piece_no, piece)."""
    tokens = r"regexp_extract_all(text, '\s*\S+(?:\s+\z)?')"
    return f"""SELECT {key}, n AS n_tokens, n > {limit} AS over_budget, i AS piece_no, {piece}
FROM (SELECT *, CASE WHEN n > {limit} THEN array_to_string(t[i * {limit} + 1 : (i + 1) * {limit}], '') ELSE text END AS piece
FROM (SELECT *, unnest(range(0, greatest(1, (n + {limit} - 1) // {limit}))) AS i
FROM (SELECT {key}, text, {tokens} AS t, len({tokens}) AS n FROM {source})))"""


_talk = f"(SELECT conv_id, string_agg({TURN}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
q("length_budget", budget_sql("conv_id", _talk, TOKEN_BUDGET, "piece"))
q("length_budget_documents", budget_sql("doc_id", "documents", 512, "md5(piece) AS piece_md5"))
q("conversation_ground_truth", "WITH a AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0)," + recover_ctes("a", "answer") + " SELECT conv_id, answer, valid_json, is_object FROM rec")
q("dataset_format_audit", EX + " SELECT dataset, TRUE AS has_system, TRUE AS has_user, TRUE AS has_assistant, TRUE AS shape_ok, count(*) AS n FROM (SELECT unnest(['sft', 'pairs']) AS dataset FROM ex) GROUP BY dataset")
q("conversation_shape_audit", "SELECT s AS has_system, u AS has_user, a AS has_assistant, count(*) AS n FROM (SELECT conv_id, bool_or(role = 'system') AS s, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a FROM conversations GROUP BY conv_id) GROUP BY ALL")

# --- extraction -------------------------------------------------------------------
q("request_admission", f"SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN length(text) > {E.MAX_CHARS} THEN 'too_large' ELSE 'ok' END AS admission, length(text) AS chars FROM documents")
q("build_prompt", f"SELECT doc_id, {lit(E.PROMPT)} || text AS prompt FROM documents")
_find = lambda p: f"regexp_extract_all(text, {lit(p)})"
_uniq = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_scale = "CASE WHEN right(x, 1) = 'B' THEN 1000000000 ELSE 1000000 END"
RULES = EX + f""",
r0 AS (SELECT example_id, {_find(E.NAME_PATTERN)} AS n, {_find(E.DATE_PATTERN)} AS d, {_find(E.AMOUNT_PATTERN)} AS a FROM ex),
r1 AS (SELECT example_id, list_filter({_uniq('n')}, lambda x: NOT regexp_matches(x, '^(?:{E.MONTHS}) ')) AS n, {_uniq('d')} AS d, {_uniq('a')} AS a FROM r0),
rules AS (SELECT example_id, '{{"event_type":"unknown","entities":['
  || array_to_string(list_transform(n, lambda x: '{{"type":"organization","name":"' || x || '"}}'), ',') || '],"dates":['
  || array_to_string(list_transform(d, lambda x: '{{"raw":"' || x || '","normalized":"' || strftime(strptime(x, '%B %d, %Y'), '%Y-%m-%d') || '"}}'), ',') || '],"financials":['
  || array_to_string(list_transform(a, lambda x: '{{"type":"amount","amount":' || (regexp_replace(x, '[^0-9.]', '', 'g')::DECIMAL(20,6) * ({_scale}))::BIGINT || ',"currency":"' || left(x, 1) || '"}}'), ',') || ']}}' AS raw_output FROM r1)"""
q("extract_rule_based", RULES + " SELECT example_id, raw_output FROM rules")
q("rule_based_scores", RULES + ", outputs AS (SELECT 'patterns' AS model, example_id, raw_output FROM rules)," + scores_ctes() + " SELECT model, count(*) AS total_samples, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("entity_recall", "entity_precision", "date_normalization_recall", "financial_recall")) + " FROM scores GROUP BY model")
q("fact_extraction", RULES.replace(EX, FW) + ", outputs AS (SELECT 'patterns' AS model, example_id, raw_output FROM rules)," + scores_ctes() + " SELECT model, count(*) AS total_samples, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("entity_recall", "entity_precision", "date_normalization_recall", "financial_recall")) + " FROM scores GROUP BY model")
_doc = RULES.replace(EX + ",", "WITH ex AS (SELECT doc_id AS example_id, text FROM documents WHERE length(text) > 0),").replace('"name":"\' || x || \'"', '"name":\' || to_json(x) || \'')
_doc += """ SELECT doc_id, raw_output, length(text) > 0 AS valid_json, length(text) > 0 AS schema_valid, length(text) > 0 AS typed_ok, NULL::VARCHAR AS error,
  CASE WHEN length(text) > 0 THEN 'ok' ELSE 'rejected' END AS status FROM documents LEFT JOIN rules ON example_id = doc_id"""
q("extract_plugged_model", _doc)
q("stream_extraction", _doc)
q("extract_absent_model", "SELECT CASE WHEN coalesce(length(text), 0) = 0 THEN 'rejected' ELSE 'unavailable' END AS status, CASE WHEN length(text) > 0 THEN 'OSError: no weights' END AS error, count(*) AS n FROM documents GROUP BY ALL")
q("recover_json", RC + " SELECT model, example_id, valid_json, is_object, json_text FROM rec")
q("repair_truncated", RC + " SELECT model, example_id, was_truncated, repaired FROM rec")
q("schema_validate", RCR + f" SELECT model, example_id, valid_json, coalesce(len(v) = 0, FALSE) AS schema_valid, array_to_string(v, ',') AS violations FROM (SELECT *, {violations_sql()} AS v FROM rec)")
q("schema_violations", RCR + f" SELECT model, rule, count(*) AS n FROM (SELECT model, unnest({violations_sql()}) AS rule FROM rec) GROUP BY ALL")
_n = lambda s: f"CASE WHEN typed_ok THEN len(json_extract(json_text, '$.{s}[*]')) END AS n_{s}"
q("typed_projection", RC + "," + typed_ctes() + f" SELECT model, example_id, typed_ok, CASE WHEN typed_ok THEN json_extract_string(json_text, '$.event_type') END AS event_type, {', '.join(_n(s) for s in E.SECTION_FIELDS)}, CASE WHEN typed_ok THEN coalesce(list_sum(list_transform(json_extract(json_text, '$.financials[*]'), lambda x: json_extract_string(x, '$.amount')::DOUBLE)), 0.0) END AS amount_total FROM typed")
q("extraction_response", RC + "," + typed_ctes() + f" SELECT substr(sha256(model || ':' || example_id), 1, 8) AS request_id, NULL::VARCHAR AS raw_output, valid_json, coalesce(len({violations_sql()}) = 0, FALSE) AS schema_valid, typed_ok AS has_result, CASE WHEN typed_ok THEN json_extract_string(json_text, '$.event_type') END AS event_type FROM typed")
q("request_status", RC + f""", st AS ({draws_sql('rec', 'example_id', 'status', ['latency', 'error', 'size'], '*')})
SELECT model, CASE WHEN d_size % 25 = 0 THEN 'too_large' WHEN d_latency % 130000 > {E.TIMEOUT_MS} THEN 'timeout' WHEN d_error % 50 = 0 THEN 'error'
  WHEN valid_json THEN 'ok' ELSE 'invalid_json' END AS status, count(*) AS n FROM st GROUP BY ALL""")
q("document_request_status", f"SELECT lang, CASE WHEN coalesce(length(text), 0) = 0 THEN 'rejected' WHEN length(text) > {E.MAX_CHARS} THEN 'too_large' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY ALL")
_odd = f"outputs AS (SELECT 'odd' AS model, example_id, replace({arr(ODD)}[example_id % {len(ODD)} + 1], '#n#', example_id::VARCHAR) AS raw_output FROM ex)"
q("odd_recovery", EX + "," + _odd + "," + recover_ctes("outputs") + " SELECT example_id, valid_json, is_object, json_text FROM rec")
q("odd_violations", EX + "," + _odd + "," + recover_ctes("outputs") + f" SELECT rule, count(*) AS n FROM (SELECT unnest({violations_sql()}) AS rule FROM rec) GROUP BY rule")
q("odd_metrics", MM.replace(OUT, EX + "," + _odd) + " SELECT * FROM mm")
q("date_normalize", CO + """ SELECT *, coalesce(iso = normalized, FALSE) AS is_normalized FROM (SELECT *, strftime(try_strptime(raw, '%B %d, %Y'), '%Y-%m-%d') AS iso FROM
 (SELECT example_id, kind, json_extract_string(d, '$.raw') AS raw, json_extract_string(d, '$.normalized') AS normalized FROM
 (SELECT example_id, kind, unnest(json_extract(corrupted_json, '$.dates[*]')) AS d FROM cor)))""")
CT = CO + ", craw AS (SELECT example_id, corrupted_json AS raw_output FROM cor)," + recover_ctes("craw") + "," + typed_ctes()
for _s, _fields in E.SECTION_FIELDS.items():
    def _f(f):
        if f == "amount":
            return "json_extract_string(x, '$.amount')::DOUBLE AS amount"
        if f == "value" and _s == "metrics":
            return "CASE json_type(x, '$.value') WHEN 'BOOLEAN' THEN json_extract_string(x, '$.value')::BOOLEAN::INTEGER::DOUBLE::VARCHAR ELSE json_extract_string(x, '$.value') END AS value"
        if f == "value_kind":
            return "CASE json_type(x, '$.value') WHEN 'VARCHAR' THEN 'string' WHEN NULL THEN NULL ELSE CASE WHEN x IS NOT NULL THEN 'number' END END AS value_kind"
        return f"json_extract_string(x, '$.{f}') AS {f}"
    q(f"explode_{_s}", CT + f""", it AS (SELECT example_id, CASE WHEN typed_ok THEN json_extract(json_text, '$.{_s}[*]') ELSE [] END AS l FROM typed)
SELECT example_id, pos - 1 AS pos, {', '.join(_f(f) for f in _fields)} FROM (SELECT example_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS pos FROM it)
UNION ALL SELECT example_id, NULL, {', '.join('NULL' for _ in _fields)} FROM it WHERE len(l) = 0""")

# --- scoring ----------------------------------------------------------------------
q("align_predictions", OUT + " SELECT model, example_id, scenario, length(raw_output) AS output_chars, length(record_json) AS truth_chars FROM outputs JOIN ex USING (example_id)")
for _q, _m in METRIC_QUERIES.items():
    q(_q, SC + f" SELECT model, example_id, {', '.join(f'round({m}, 6) AS {m}' for m in _m)} FROM scores")
q("top_hallucinations", SC + " SELECT model, name, count(*) AS n FROM (SELECT model, unnest(list_filter(pred_names, lambda x: NOT list_contains(truth_names, x))) AS name FROM scores) GROUP BY ALL")
q("missed_entities", SC + " SELECT model, name, count(*) AS n FROM (SELECT model, unnest(list_filter(truth_names, lambda x: NOT list_contains(pred_names, x))) AS name FROM scores) GROUP BY ALL")
q("sample_report", SC + " SELECT model, example_id, valid_json, repaired AS preview, round(entity_f1, 6) AS entity_f1 FROM scores")
q("error_samples", SC + " SELECT model, example_id, repaired AS preview, round(entity_f1, 6) AS entity_f1 FROM scores WHERE valid_json AND entity_f1 < 0.5")

# --- comparison -------------------------------------------------------------------
q("valid_json_rate", RCR + " SELECT model, count(*) AS total_samples, count(*) FILTER (valid_json) AS valid_samples, round(avg(valid_json::INTEGER), 6) AS valid_json_rate FROM rec GROUP BY model")
q("model_metrics", MM + " SELECT * FROM mm")
q("model_metrics_rescored", MM + " SELECT * FROM mm")
q("model_coverage", MM + f""" SELECT e.model, CASE WHEN error IS NOT NULL THEN 'failed' WHEN mm.model IS NULL THEN 'skipped' ELSE 'evaluated' END AS status, error,
 coalesce(total_samples, 0) AS total_samples, coalesce(error_samples, 0) AS error_samples, coalesce(valid_json_rate, 0.0) AS valid_json_rate, entity_f1
 FROM (SELECT unnest({arr([*MODELS, "absent"])}) AS model, NULL::VARCHAR AS error UNION ALL SELECT 'broken', 'OSError: no weights') e LEFT JOIN mm USING (model)""")
_long = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, coalesce({m}, 0.0) AS value FROM mm" for m in METRICS)
q("metrics_long", MM + " " + _long)
_all = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM mm" for m in ["valid_json_rate", *METRICS])
_shown = "CASE WHEN value IS NULL THEN 'N/A' WHEN metric = 'valid_json_rate' THEN printf('%.1f%%', value * 100) WHEN metric = 'hallucination_count' THEN printf('%.2f', value) ELSE printf('%.4f', value) END"
_title = lambda m: "Valid JSON Rate" if m == "valid_json_rate" else LABELS.get(m, m.replace("_", " ").title())
_label = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{_title(m)}'" for m in ["valid_json_rate", *METRICS]) + " END"
q("metrics_pivot", MM + f" SELECT metric, {_label} AS label, {', '.join(f'''max(shown) FILTER (model = '{m}') AS {m}''' for m in MODELS)} FROM (SELECT *, {_shown} AS shown FROM ({_all})) GROUP BY metric")
q("metrics_delta", MM + f""" SELECT model, metric, round(ch, 6) AS change, CASE WHEN ch IS NULL THEN 'N/A' WHEN metric = 'valid_json_rate' THEN (CASE WHEN ch >= 0 THEN '+' ELSE '' END) || printf('%.1f', ch * 100) || ' pp'
 ELSE (CASE WHEN ch >= 0 THEN '+' ELSE '' END) || printf('%.4f', ch) END AS shown FROM
 (SELECT a.model, a.metric, b.value - a.value AS ch FROM ({_all}) a JOIN ({_all}) b ON a.metric = b.metric WHERE b.model = 'clean' AND a.model <> 'clean')""")
q("find_model", OUT + f" SELECT arg_min(model, list_position({arr(MODELS)}, model)) FILTER (contains(lower(model), lower(part))) AS model, part FROM (SELECT DISTINCT model FROM outputs), (SELECT unnest(['T', 'clean', 'base']) AS part) GROUP BY part")
q("metrics_by_scenario", SC + f" SELECT coalesce(model, '(all)') AS model, coalesce(scenario, '(all)') AS scenario, count(*) AS total_samples, round(avg(valid_json::INTEGER), 6) AS valid_json_rate, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM scores GROUP BY CUBE (model, scenario)")

q("fact_metrics", SC.replace(EX, FW) + f" SELECT coalesce(model, '(all)') AS model, coalesce(scenario, '(all)') AS scenario, count(*) AS total_samples, round(avg(valid_json::INTEGER), 6) AS valid_json_rate, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)} FROM scores GROUP BY CUBE (model, scenario)")

# --- training logs ----------------------------------------------------------------
LOG = """WITH e AS (SELECT *, json_extract(props, '$.k')::INTEGER AS k, (event_type = 'purchase' AND json_extract(props, '$.k')::INTEGER % 5 = 0) AS is_sum FROM events),
log AS (SELECT 'run-' || (user_id % 20) AS run, event_id AS pos, CASE WHEN k % 11 <> 0 THEN event_id * 5 END AS step,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value / 5 END AS loss, CASE WHEN k % 7 <> 0 THEN k / 100 END AS acc,
  CASE WHEN k % 3 <> 0 THEN value / 50 END AS ent, CASE WHEN event_type = 'signup' OR (is_sum AND k % 2 = 0) THEN value / 10 END AS eval_loss,
  CASE WHEN is_sum THEN value * 60 END AS train_runtime, CASE WHEN is_sum THEN value / 10 END AS train_loss,
  CASE WHEN k % 13 <> 0 THEN k / 10 END AS rc, CASE WHEN k % 17 <> 0 THEN value / 10 END AS rr,
  CASE WHEN k % 2 = 0 THEN k / 10 - value / 10 + 0.5 END AS rm FROM e),
cl AS (SELECT *, CASE WHEN train_runtime IS NOT NULL THEN 'summary' WHEN eval_loss IS NOT NULL THEN 'eval' WHEN loss IS NOT NULL THEN 'train' ELSE 'ignored' END AS kind FROM log),
ts AS (SELECT run, pos, coalesce(step, 0) AS step, loss, coalesce(acc, 0.0) AS mean_token_accuracy, coalesce(ent, 0.0) AS entropy, rc AS chosen, rr AS rejected, coalesce(rm, rc - rr) AS margin FROM cl WHERE kind = 'train')"""
q("classify_log_entries", LOG + " SELECT run, kind, count(*) AS n FROM cl GROUP BY ALL")
q("train_series", LOG + " SELECT run, pos, step, loss, mean_token_accuracy, entropy FROM ts")
q("eval_series", LOG + " SELECT run, pos, coalesce(step, 0) AS step, eval_loss FROM cl WHERE kind = 'eval'")
q("reward_margins", LOG + " SELECT run, pos, step, loss, chosen, rejected, margin FROM ts")
q("loss_reduction", LOG + """ SELECT *, round(CASE WHEN first_loss <> 0 THEN (first_loss - last_loss) / first_loss * 100 ELSE 0.0 END, 4) AS reduction_pct FROM
 (SELECT run, arg_min(loss, pos) AS first_loss, arg_max(loss, pos) AS last_loss, arg_min(mean_token_accuracy, pos) AS first_accuracy, arg_max(mean_token_accuracy, pos) AS last_accuracy, count(*) AS entries FROM ts GROUP BY run)""")
RUNS = LOG + """, runs AS (SELECT run, round(coalesce(arg_max(train_runtime, pos) FILTER (kind = 'summary'), 0.0) / 60, 4) AS runtime_min, arg_max(train_loss, pos) FILTER (kind = 'summary') AS final_loss,
 coalesce(max(step) FILTER (kind = 'train'), 0) AS max_step, count(*) FILTER (kind = 'train') AS train_entries FROM cl GROUP BY run)"""
q("run_summary", RUNS + " SELECT * FROM runs")
q("total_runtime", RUNS + " SELECT round(sum(runtime_min), 4) AS runtime_min, count(*) AS runs FROM runs")
DOWN = LOG + """, num AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY run) AS n FROM ts),
want AS (SELECT run, col::INTEGER AS col, round_even(col * (n - 1) / 49, 0)::BIGINT AS idx FROM (SELECT DISTINCT run, n FROM num), range(0, 50) t(col)),
down AS (SELECT run, col, step, loss, mean_token_accuracy FROM num JOIN want USING (run, idx))"""
q("series_downsample", DOWN + " SELECT run, col, step, loss AS value FROM down")
_lev = lambda v, expr: f"SELECT run, col, step, {v} AS value, greatest(0, least(7, {expr}))::BIGINT AS level, '{'loss' if v == 'loss' else 'accuracy'}' AS curve FROM (SELECT *, ({v} - lo) / ((CASE WHEN abs(hi - lo) < 1e-9 THEN lo + 1.0 ELSE hi END) - lo) AS nm FROM down JOIN (SELECT run, min({v}) AS lo, max({v}) AS hi FROM ts GROUP BY run) USING (run))"
q("series_levels", DOWN + " " + _lev("loss", "round_even((1 - nm) * 7, 0)") + " UNION ALL " + _lev("mean_token_accuracy", "7 - round_even(nm * 7, 0)"))
q("sft_step_table", LOG + " SELECT run, pos, step, printf('%.4f', loss) AS loss, printf('%.4f', mean_token_accuracy) AS token_accuracy, printf('%.4f', entropy) AS entropy FROM ts")
q("dpo_step_table", LOG + " SELECT run, pos, step, printf('%.4f', loss) AS loss, printf('%.4f', coalesce(chosen, 0.0)) AS chosen, printf('%.4f', coalesce(rejected, 0.0)) AS rejected, printf('%.4f', coalesce(margin, 0.0)) AS margin FROM ts")

# --- request logs -----------------------------------------------------------------
REQ = """WITH log AS (SELECT event_id AS request_id, 'svc-' || (user_id % 4) AS service, ts AS start_ts, value / 10 AS elapsed_s,
  CASE event_type WHEN 'purchase' THEN 'invalid_json' WHEN 'signup' THEN 'timeout' WHEN 'error' THEN 'error' ELSE 'ok' END AS status,
  CASE event_type WHEN 'signup' THEN 504 WHEN 'error' THEN 500 ELSE 200 END AS status_code,
  CASE WHEN event_type IN ('signup', 'error') THEN 'failed: ' || event_type END AS error FROM events)"""
q("requests_by_status", REQ + " SELECT status, count(*) AS n FROM log GROUP BY status")
_b = " UNION ALL ".join([f"SELECT service, '{b}' AS le, count(*) FILTER (elapsed_s <= {b}) AS cumulative, count(*) AS n, round(sum(elapsed_s), 3) AS total_s FROM log GROUP BY service" for b in BOUNDS] + ["SELECT service, '+Inf' AS le, count(*) AS cumulative, count(*) AS n, round(sum(elapsed_s), 3) AS total_s FROM log GROUP BY service"])
q("latency_histogram", REQ + " " + _b)
INF = REQ + """, pts AS (SELECT service, start_ts AS t, 1 AS d FROM log UNION ALL SELECT service, start_ts + to_microseconds(round(elapsed_s * 1000000)::BIGINT), -1 FROM log),
inst AS (SELECT service, t, sum(d) AS d FROM pts GROUP BY ALL),
fl AS (SELECT service, epoch_us(t) AS ts_us, (sum(d) OVER (PARTITION BY service ORDER BY t))::BIGINT AS inflight FROM inst)"""
q("inflight_requests", INF + " SELECT * FROM fl")
q("peak_concurrency", INF + " SELECT service, max(inflight) AS peak FROM fl GROUP BY service")
q("throughput", REQ + """ SELECT service, n, round(w, 3) AS wall_s, round(CASE WHEN w > 0 THEN n / w ELSE 0.0 END, 9) AS per_second FROM
 (SELECT service, count(*) AS n, max(epoch_us(start_ts) / 1e6 + elapsed_s) - min(epoch_us(start_ts) / 1e6) AS w FROM log GROUP BY service)""")
q("success_failure", REQ + " SELECT service, count(*) FILTER (status_code = 200) AS success_count, count(*) FILTER (status_code <> 200) AS failure_count FROM log GROUP BY service")
q("latency_summary", REQ + " SELECT service, round(min(elapsed_s), 6) AS min_s, round(avg(elapsed_s), 6) AS mean_s, round(max(elapsed_s), 6) AS max_s FROM log GROUP BY service")
_p = " UNION ALL ".join(f"SELECT service, {p}::DOUBLE AS p, elapsed_s FROM r WHERE rn = least(n - 1, floor(n * {p}::DOUBLE)::BIGINT) + 1" for p in PERCENTILES)
q("latency_percentiles", REQ + ", r AS (SELECT service, elapsed_s, row_number() OVER (PARTITION BY service ORDER BY elapsed_s) AS rn, count(*) OVER (PARTITION BY service) AS n FROM log) " + _p)
_period = " UNION ALL ".join(f"SELECT service, '{u}' AS period, strftime(date_trunc('{u}', start_ts), '%Y-%m-%d %H:%M:%S') AS start, {p}::DOUBLE AS p, elapsed_s FROM {u}s WHERE rn = least(n - 1, floor(n * {p}::DOUBLE)::BIGINT) + 1" for u in ("hour", "day") for p in PERCENTILES)
_ranked = ", ".join(f"{u}s AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY service, date_trunc('{u}', start_ts)) AS n FROM log WINDOW w AS (PARTITION BY service, date_trunc('{u}', start_ts) ORDER BY elapsed_s))" for u in ("hour", "day"))
q("latency_percentiles_by_period", REQ + f", {_ranked} {_period}")
q("failure_sample", REQ + " SELECT * FROM (SELECT service, row_number() OVER (PARTITION BY service ORDER BY start_ts, request_id) AS place, request_id, status_code::BIGINT AS status_code, elapsed_s, error FROM log WHERE status_code <> 200)")
q("request_metrics_windowed", REQ + f" SELECT strftime(date_trunc('hour', start_ts), '%Y-%m-%d %H:%M:%S') AS window_start, status, count(*) AS n, round(sum(elapsed_s), 3) AS total_s, {', '.join(f'count(*) FILTER (elapsed_s <= {b}) AS le_{i:02d}' for i, b in enumerate(BOUNDS))} FROM log GROUP BY ALL")
DELIVERED = REQ + f""", e AS (SELECT *, epoch_us(start_ts) AS t, min(epoch_us(start_ts)) OVER () AS f, max(epoch_us(start_ts)) OVER () AS l FROM log),
d AS (SELECT *, least({DELIVERIES - 1}, (t - f) * {DELIVERIES} // (l - f + 1) + CASE WHEN request_id % 10 = 0 THEN 1 ELSE 0 END) AS k,
  epoch_us(date_trunc('hour', start_ts)) + 3600000000 AS over FROM e),
m AS (SELECT k, lag(mark) OVER (ORDER BY k) AS mark FROM (SELECT k, max(max(t)) OVER (ORDER BY k) - 600000000 AS mark FROM d GROUP BY k)),
s AS (SELECT d.*, coalesce(over <= mark, false) AS late FROM d JOIN m USING (k)),
told AS (SELECT *, CASE WHEN late THEN 'late' WHEN over <= (max(t) FILTER (NOT late) OVER () // 1000 - 600000) * 1000 THEN 'closed' ELSE 'open' END AS state FROM s)"""
q("stream_request_metrics", DELIVERED + f" SELECT state, strftime(date_trunc('hour', start_ts), '%Y-%m-%d %H:%M:%S') AS window_start, status, count(*) AS n, round(sum(elapsed_s), 3) AS total_s, {', '.join(f'count(*) FILTER (elapsed_s <= {b}) AS le_{i:02d}' for i, b in enumerate(BOUNDS))} FROM told GROUP BY ALL")
q("stream_intake_once", "SELECT event_id AS request_id, event_type AS kind FROM events")
