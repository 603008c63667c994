"""What scoring and typing read of a recovered text, found in one Arrow pass.

Every text is parsed once, by a Python worker's JSON decoder, and reduced to the parts that are asked for (section names, entity
names, date pairs, amount texts, broken rules, structure, the typed record).  Column expressions would build a VARIANT, take it apart
once for each section and go through the elements one expression at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from factloom.functions.plan import STAGE
from factloom.functions.schema_rules import RECORD_SCHEMA

# The key of the unofficial note, which is no section.
NOTE_KEY = "_note"
PARTS = ("keys", "names", "dates", "amounts")
ALL_MADE = (*PARTS, "pred_skipped", "structure", "violations")  # of a prediction
# The typed record: kinds a field takes; a text in place of an amount has to be one number.
_TEXT, _OPTIONAL = ("string",), ("string", "null", "absent")
TYPED_KINDS = {
    "entities": {"type": _TEXT, "name": _TEXT},
    "dates": {"raw": _TEXT, "normalized": _TEXT, "context": _OPTIONAL},
    "financials": {"type": _TEXT, "amount": ("number", "string", "boolean"), "currency": _OPTIONAL},
    "relationships": {"type": _TEXT, "subject": _TEXT, "object": _TEXT},
    "metrics": {"name": _TEXT, "value": ("string", "number", "boolean")},
}
SECTION_FIELDS = {n: (*kinds, *(("value_kind",) if n == "metrics" else ())) for n, kinds in TYPED_KINDS.items()}
_FIELD_TYPES = {("financials", "amount"): "double"}
_SECTION_TYPES = {n: f"array<struct<{', '.join(f'{k}: ' + _FIELD_TYPES.get((n, k), 'string') for k in f)}>>" for n, f in SECTION_FIELDS.items()}
RECORD_TYPE = f"struct<event_type: string, {', '.join(f'{n}: {t}' for n, t in _SECTION_TYPES.items())}>"
_TEXTS = "array<string>"
TYPES = {
    "valid_json": "boolean", "is_object": "boolean", **dict.fromkeys(PARTS, _TEXTS), "other_case": "boolean",
    "pred_skipped": "int", "structure": "double", "violations": _TEXTS, "result": RECORD_TYPE,
}
# Sections that are read for a part; the rules read all.
READ_FOR = {"names": ("entities",), "dates": ("dates",), "amounts": ("financials",), "structure": ("entities",), "pred_skipped": ("entities",)}
# Jackson's bounds, which hold for ``recover`` too: digits of a number, arrays and objects inside one another.
MOST_DIGITS, MOST_LEVELS = 1000, 999
# Texts a worker holds as Python objects at a time.
BLOCK = 1000


def sections_for(made: Sequence[str]) -> list[str]:
    """Sections that these are read from, in the order of the schema."""
    every = [n for n, sub in RECORD_SCHEMA["properties"].items() if "items" in sub]
    wanted = {s for n in made for s in (every if n in ("violations", "result") else READ_FOR.get(n, ()))}
    return [n for n in every if n in wanted]


def with_parts(df: DataFrame, made: Sequence[str], truth: bool = False, prefix: str = "", candidate: str = "_candidate") -> DataFrame:
    """Add ``valid_json``, ``is_object`` and the parts to be ``made``, null where the text is no object, of a ``candidate`` (see ``recovery.with_candidate``), which is dropped; their names begin with ``prefix``.  The pass is a generator's input, so filters on what
    it finds do not run it again.

    Names are distinct and in lower case.  A prediction's entity that is a bare text counts as a name, its date pairs need
    both keys; of the ``truth`` neither holds.  ``result`` is the typed record, null where the value does not fit: numbers are
    taken from numeric text, absent sections are empty, keys outside the type are dropped.
    """
    fields = ["valid_json", "is_object", *[n for n in (*ALL_MADE, "result") if n in made], *(["other_case"] if "names" in made else [])]
    reader = _reader(fields, truth, prefix)
    reader.__name__ = "parts of " + ", ".join(["$", *[f"$.{s}" for s in sections_for(made)]])
    found = arrow_udf(reader, ", ".join(f"`{prefix}{n}` {TYPES[n]}" for n in fields))(F.col(candidate))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (candidate, *[f"{prefix}{n}" for n in fields])]
    df = df.select(*kept, F.array(found).alias(STAGE)).select(*kept, F.inline_outer(STAGE))
    if "names" not in made:
        return df
    # The pass leaves a name with other letters than ASCII as it is: lower case is the engine's.
    names, other = f"{prefix}names", F.col(f"{prefix}other_case")
    lower = F.when(other, F.array_distinct(F.transform(names, F.lower))).otherwise(F.col(names))
    return df.withColumn(names, lower).drop(f"{prefix}other_case")


def _reader(fields: list[str], truth: bool, prefix: str):
    """Function from a batch of texts to a batch of ``fields``.  All it uses is made in here, so that it travels by value and
    executors need no copy of this package."""
    schema, note, most_digits, most_levels, block = RECORD_SCHEMA, NOTE_KEY, MOST_DIGITS, MOST_LEVELS, BLOCK
    types, typed_kinds, section_fields = dict(TYPES), dict(TYPED_KINDS), dict(SECTION_FIELDS)
    kept = {}

    def build():
        import itertools
        import json
        import math
        import operator
        import re
        from decimal import Decimal

        class Number(str):
            """A number as it is written."""

        def number(text: str) -> Number:
            if len(text) > most_digits and len(text.lstrip("-")) > most_digits:
                raise ValueError("too many digits")
            return Number(text)

        def constant(text: str):
            raise ValueError(text)  # NaN and Infinity are not JSON

        scan = json.JSONDecoder(parse_float=number, parse_int=number, parse_constant=constant).scan_once
        quoted = json.encoder.encode_basestring

        def levels(value) -> int:
            deepest, left = 0, [(value, 1)]
            while left:
                v, level = left.pop()
                if type(v) in (dict, list):
                    deepest = max(deepest, level)
                    left.extend((x, level + 1) for x in (v.values() if type(v) is dict else v))
            return deepest

        def parse(text: str):
            """(whether the text is one JSON value and no null, the value)"""
            if text is None or text == "null":
                return False, None
            try:
                value, end = scan(text, 0)
            except (ValueError, StopIteration, RecursionError):
                return False, None
            if end != len(text):
                return False, None
            if text.count("[") + text.count("{") > most_levels and levels(value) > most_levels:
                return False, None
            return True, value

        def double_text(text: str) -> str:
            """A double as the JVM writes it: plain from a thousandth to ten millions, else with an exponent."""
            x = float(text)
            if math.isinf(x):
                return "Infinity" if x > 0 else "-Infinity"
            if x == 0 or 1e-3 <= abs(x) < 1e7:
                return repr(x)
            sign, digits, exponent = Decimal(repr(x)).as_tuple()
            digits = "".join(map(str, digits)).rstrip("0")
            exponent += len(Decimal(repr(x)).as_tuple().digits) - 1
            return f"{'-' if sign else ''}{digits[0]}.{digits[1:] or '0'}E{exponent}"

        def is_whole(text: str) -> bool:
            return not ("." in text or "e" in text or "E" in text)

        def exact_text(text: str) -> str:
            """A number as VARIANT keeps it: 5 and 5.0 are the same decimal, one with an exponent or too long a double."""
            if "e" not in text and "E" not in text:
                d = Decimal(text)
                _, digits, exponent = d.as_tuple()
                if -exponent <= 38 and len(digits) <= 38:
                    plain = format(d, "f")
                    return "0" if d == 0 else plain.rstrip("0").rstrip(".") if "." in plain else plain
            return double_text(text)

        def amount_text(text: str) -> str:
            if is_whole(text):
                return "0" if text == "-0" else str(text)
            return double_text(text)

        def json_text(value, of_number, in_order) -> str:
            kind = type(value)
            if kind is str:
                return quoted(value)
            if kind is Number:
                return of_number(value)
            if value is None or kind is bool:
                return {None: "null", True: "true", False: "false"}[value]
            if kind is list:
                return f"[{','.join([json_text(v, of_number, in_order) for v in value])}]"
            pairs = value.items() if in_order else sorted(value.items())
            return "{" + ",".join([f"{quoted(k)}:{json_text(v, of_number, in_order)}" for k, v in pairs]) + "}"

        def names(record: dict):
            found, other = {}, False
            entities = record.get("entities")
            for e in entities if type(entities) is list else ():
                if type(e) is dict:
                    name = e.get("name")
                    if type(name) is not str or not name:
                        continue
                elif type(e) is str and not truth:
                    name = e
                else:
                    continue
                if name.isascii():
                    name = name.lower()
                else:
                    other = True
                found[name] = None
            return list(found), other

        def dates(record: dict) -> list[str]:
            found, elements = {}, record.get("dates")
            for d in elements if type(elements) is list else ():
                if type(d) is not dict:
                    continue
                if not truth and not ("raw" in d and "normalized" in d):
                    continue
                raw, iso = d.get("raw", ""), d.get("normalized", "")
                raw = quoted(raw) if type(raw) is str else json_text(raw, exact_text, False)
                iso = quoted(iso) if type(iso) is str else json_text(iso, exact_text, False)
                found[f"{raw} = {iso}"] = None
            return list(found)

        def amounts(record: dict) -> list[str]:
            found, elements = {}, record.get("financials")
            for f in elements if type(elements) is list else ():
                if type(f) is not dict or "amount" not in f:
                    continue
                a = f["amount"]
                if a is None:
                    a = "None"
                elif type(a) is not str:
                    a = amount_text(a) if type(a) is Number else json_text(a, amount_text, True)
                found[a] = None
            return list(found)

        def skipped(record: dict) -> int:
            entities = record.get("entities")
            if type(entities) is not list:
                return 0
            return sum(1 for e in entities if type(e) is dict and type(e.get("name")) not in (str, type(None)))

        def structure(record: dict) -> float:
            if "entities" not in record:
                return 1.0
            entities = record["entities"]
            if type(entities) is not list or not entities or type(entities[0]) is not dict:
                return 0.0
            return 1.0 if all([type(e) is dict and "type" in e and "name" in e for e in entities]) else 0.5

        kinds = {"string": str, "number": Number}
        leaf_rules, sections = [], []

        def leaves(path: str, sub: dict) -> list[tuple]:
            """(field, kinds it may have, values it may have, codes of the rules where it is absent, of another kind, none of the values)"""
            out = []
            for k, leaf in sub["properties"].items():
                allowed = leaf["type"] if isinstance(leaf["type"], list) else [leaf["type"]]
                code = f"{path}{k}"
                out.append((
                    k, frozenset(kinds[t] for t in allowed), frozenset(leaf["enum"]) if "enum" in leaf else None,
                    f"{code}:required" if k in sub["required"] else None, f"{code}:type", f"{code}:enum",
                ))
            return out

        for name, sub in schema["properties"].items():
            if "items" in sub:
                required = f"$.{name}:required" if name in schema["required"] else None
                sections.append((name, required, f"$.{name}:type", f"$.{name}[]:type", leaves(f"$.{name}[].", sub["items"])))
            else:
                leaf_rules += leaves("$.", {"properties": {name: sub}, "required": [n for n in schema["required"] if n == name]})

        def check(value: dict, rules: list[tuple], broken: set):
            for k, allowed, values, absent, wrong, none in rules:
                if k in value:
                    v = value[k]
                    if type(v) not in allowed:
                        broken.add(wrong)
                    if values is not None and (type(v) is not str or v not in values):
                        broken.add(none)
                elif absent:
                    broken.add(absent)

        def violations(value) -> list[str]:
            if type(value) is not dict:
                return ["$:type"]
            broken = set()
            check(value, leaf_rules, broken)
            for name, absent, no_array, no_object, rules in sections:
                if name not in value:
                    if absent:
                        broken.add(absent)
                    continue
                elements = value[name]
                if type(elements) is not list:
                    broken.add(no_array)
                    continue
                for e in elements:
                    if type(e) is dict:
                        check(e, rules, broken)
                    else:
                        broken.add(no_object)
            return sorted(broken)

        number_text = re.compile(r"[ \t\n\x0b\f\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\x0b\f\r]*")
        texts_only, text_or_null, null = frozenset([str]), frozenset([str, type(None)]), []
        type_of = {"string": str, "number": Number, "boolean": bool}
        # Of each section: how its required fields are taken, how many they are, kinds of the last one if it is no text, the optional field.
        layout = []
        for name, kinds_of in typed_kinds.items():
            required = [k for k, allowed in kinds_of.items() if "absent" not in allowed]
            last = frozenset(type_of[x] for x in kinds_of[required[-1]])
            optional = [k for k in kinds_of if k not in required]
            layout.append((name, operator.itemgetter(*required), len(required), last if last != texts_only else None, optional[0] if optional else None))

        def as_float(value):
            """Number, numeric text or boolean as a double; null for another text."""
            if type(value) is str and not number_text.fullmatch(value):
                return None
            x = float(value)
            return 0.0 if x == 0 and type(value) is Number and "e" not in value and "E" not in value else x

        def value_text(value) -> str:
            if type(value) is bool:
                return "1.0" if value else "0.0"
            return exact_text(value) if type(value) is Number else value

        def typed(record: dict):
            """(event type, section by section what its fields have, null for an empty one), or null if the record does not fit"""
            event = record.get("event_type")
            if type(event) is not str:
                return None
            out = [event]
            for name, get, width, last, optional in layout:
                elements = record.get(name, null)
                if type(elements) is not list:
                    return None
                if not elements:
                    out.append(None)
                    continue
                try:
                    flat = [v for e in map(get, elements) for v in e]
                except (KeyError, TypeError):  # a field is missing, or the element is no object
                    return None
                if last is None:
                    if not texts_only.issuperset(map(type, flat)):
                        return None
                    columns = [flat[i::width] for i in range(width)]
                else:
                    first, second = flat[0::2], flat[1::2]
                    if not (texts_only.issuperset(map(type, first)) and last.issuperset(map(type, second))):
                        return None
                    if name == "metrics":
                        columns = [first, list(map(value_text, second)), ["string" if type(v) is str else "number" for v in second]]
                    else:
                        columns = [first, list(map(as_float, second))]
                        if None in columns[1]:
                            return None
                if optional:
                    more = [e.get(optional) for e in elements]
                    if not text_or_null.issuperset(map(type, more)):
                        return None
                    columns.append(more)
                out.append(columns)
            return out

        def typed_column(records: list):
            arrays = [texts_array([r and r[0] for r in records])]
            for i, (name, names) in enumerate(section_fields.items(), 1):
                some = [r and r[i] for r in records]
                ends = [0, *itertools.accumulate([len(c[0]) if c else 0 for c in some])]
                some = [c for c in some if c]
                flat = [[v for c in some for v in c[k]] for k in range(len(names))]
                columns = [pa.array(c, pa.float64()) if k == "amount" else texts_array(c) for k, c in zip(names, flat)]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=names)))
            missing = pa.array([r is None for r in records], pa.bool_())
            return pa.StructArray.from_arrays(arrays, names=["event_type", *section_fields], mask=missing)

        def texts_array(texts: list):
            try:
                return pa.array(texts, pa.string())
            except UnicodeEncodeError:
                return pa.array([None if t is None else unpaired([t])[0] for t in texts], pa.string())

        wanted = {n: build for n, build in {"dates": dates, "amounts": amounts, "pred_skipped": skipped, "structure": structure, "result": typed}.items() if n in fields}

        def unpaired(texts):
            """Half a surrogate pair is no character: a question mark, as the JVM writes it."""
            return texts if texts is None else [t.encode("utf-8", "replace").decode() for t in texts]

        def read(texts: list) -> list:
            out = {n: [] for n in fields}
            valid, is_object = out["valid_json"], out["is_object"]
            for text in texts:
                ok, value = parse(text)
                valid.append(ok)
                if "violations" in out:
                    out["violations"].append(violations(value) if ok else None)
                if not ok or type(value) is not dict:
                    is_object.append(False)
                    for n in fields:
                        if n not in ("valid_json", "is_object", "violations"):
                            out[n].append(None)
                    continue
                is_object.append(True)
                if "keys" in out:
                    out["keys"].append([k for k in value if k != note])
                if "names" in out:
                    found, other = names(value)
                    out["names"].append(found)
                    out["other_case"].append(other)
                for n, build in wanted.items():
                    out[n].append(build(value))
            return [column(n, out[n]) for n in fields]

        arrow = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}

        def column(name: str, values: list):
            if name == "result":
                return typed_column(values)
            kind = arrow[types[name]]
            try:
                return pa.array(values, kind)
            except UnicodeEncodeError:
                return pa.array([unpaired(v) for v in values], kind)

        def texts_of(batch) -> list:
            try:
                return batch.to_pylist()
            except UnicodeDecodeError:
                return [None if b is None else b.decode("utf-8", "replace") for b in batch.cast(pa.binary()).to_pylist()]

        def run(batch):
            blocks = [read(texts_of(batch.slice(i, block))) for i in range(0, len(batch), block)] or [read([])]
            columns = [pa.concat_arrays(c) for c in zip(*blocks)]
            return pa.StructArray.from_arrays(columns, names=[f"{prefix}{n}" for n in fields])

        return run

    def found(batch: pa.Array) -> pa.Array:
        if not kept:
            kept["run"] = build()
        return kept["run"](batch)

    return found
