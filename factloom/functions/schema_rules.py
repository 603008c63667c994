"""JSON Schema (the draft-07 keywords ``type``, ``enum``, ``required``, ``properties``,
``items``) compiled to one column: the codes of the rules a VARIANT value breaks.

A code is ``path:keyword``, for instance ``$.entities[].type:enum``.  Content the schema
does not name is allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

TEXT = {"type": "string"}

# The record schema.
RECORD_SCHEMA = {
    "type": "object",
    "required": ["event_type", "entities"],
    "properties": {
        "event_type": TEXT,
        "entities": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["type", "name"],
                "properties": {
                    "type": {"type": "string", "enum": ["organization", "person", "product", "location"]},
                    "name": TEXT,
                },
            },
        },
        "dates": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["raw", "normalized"],
                "properties": {"raw": TEXT, "normalized": TEXT, "context": TEXT},
            },
        },
        "financials": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["type", "amount"],
                "properties": {"type": TEXT, "amount": {"type": "number"}, "currency": TEXT},
            },
        },
        "relationships": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["type", "subject", "object"],
                "properties": {"type": TEXT, "subject": TEXT, "object": TEXT},
            },
        },
        "metrics": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["name", "value"],
                "properties": {"name": TEXT, "value": {"type": ["string", "number"]}},
            },
        },
    },
}


# JSON kind -> names Spark gives it in a VARIANT.
KINDS = {
    "string": ["STRING"],
    "number": ["BIGINT", "DOUBLE", "FLOAT"],  # and DECIMAL(p, s)
    "boolean": ["BOOLEAN"],
    "null": ["VOID"],
    "object": ["OBJECT"],
    "array": ["ARRAY"],
}


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether the value has one of the JSON kinds (scalar ones, or one of object and array);
    null for a null (absent) value."""
    name = F.schema_of_variant(value)
    if kinds in (("object",), ("array",)):
        return name.startswith(KINDS[kinds[0]][0] + "<")
    plain = [n for k in kinds for n in KINDS[k]]
    test = name == plain[0] if len(plain) == 1 else name.isin(plain)
    return test | name.startswith("DECIMAL(") if "number" in kinds else test


def field(value: Column, name: str) -> Column:
    """Null if the key is absent; a JSON null is a value."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def objects(value: Column, name: str, schema: dict = RECORD_SCHEMA) -> Column:
    """A section's elements as structs of the fields its schema names, each a VARIANT, null if absent; an element that is
    no object is a null struct; null if there is no array.  One cast takes all fields out, and its result is plain
    structs, where ``field`` goes through VARIANT for each field and each use."""
    fields = ", ".join(f"`{k}`: variant" for k in schema["properties"][name]["items"]["properties"])
    return F.try_variant_get(value, f"$.{name}", f"array<struct<{fields}>>")


def _types(schema: dict) -> list[str]:
    t = schema.get("type", [])
    return [t] if isinstance(t, str) else list(t)


# What is found in a section is one whole number: for each field, by its place in the schema, a bit for every kind it has
# in any element, and bits for what concerns a whole element or the section.  Rules are masks over it.
FOUND = ("absent", "string", "number", "boolean", "null", "object", "array")
BAD_ENUM, NO_ARRAY, NO_SECTION, NO_OBJECT = (1 << b for b in range(56, 60))
_PREFIX = {names[:3]: kind for kind, all_names in KINDS.items() for names in all_names} | {"DEC": "number"}


def bits(place: int, *kinds: str) -> int:
    return sum(1 << (len(FOUND) * place + FOUND.index(k)) for k in kinds)


def others(place: int, *kinds: str) -> int:
    """All kinds of a field but these."""
    return bits(place, *[k for k in FOUND if k not in kinds])


def has(found: Column, mask: int) -> Column:
    return found.bitwiseAND(F.lit(mask).cast("long")) != 0


def kind_bit(value: Column) -> Column:
    """The bit of the value's kind in place 0; a kind is told by how its name begins.  Texts, the most frequent, first."""
    pairs = [x for prefix, kind in _PREFIX.items() for x in (F.lit(prefix), F.lit(bits(0, kind)).cast("long"))]
    other = F.try_element_at(F.create_map(*pairs), F.substring(F.schema_of_variant(value), 1, 3))
    return (
        F.when(value.isNull(), F.lit(bits(0, "absent")).cast("long"))
        .when(is_kind(value, "string"), F.lit(bits(0, "string")).cast("long"))
        .otherwise(F.coalesce(other, F.lit(bits(0, "absent")).cast("long")))
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _element(e: Column, schema: dict) -> Column:
    """What one element (see ``objects``) shows.  Something that is no object has no fields, and only that is told of it."""
    facts, zero = [], F.lit(0).cast("long")
    for i, (name, sub) in enumerate(schema["properties"].items()):
        value = e[name]
        facts.append(F.shiftleft(kind_bit(value), len(FOUND) * i) if i else kind_bit(value))
        if "enum" in sub:
            allowed = F.coalesce(F.try_variant_get(value, "$", "string").isin(sub["enum"]), F.lit(False))
            facts.append(F.when(allowed | value.isNull(), zero).otherwise(F.lit(BAD_ENUM).cast("long")))
    found = reduce(lambda x, y: x.bitwiseOR(y), facts)
    return F.when(e.isNull(), F.lit(NO_OBJECT).cast("long")).otherwise(found)


def masks(value: Column, schema: dict = RECORD_SCHEMA, items: Callable[[str], Column] | None = None) -> Column:
    """Struct of what an object shows, one whole number for each property of the schema: every section is gone through once.
    ``items`` gives the elements of a section (see ``objects``) where they are at hand."""
    items = items or (lambda name: objects(value, name, schema))
    out = []
    for name, sub in schema["properties"].items():
        if "items" not in sub:
            out.append(kind_bit(field(value, name)).alias(name))
            continue
        seen = _section(items(name), sub["items"])
        gone = F.when(field(value, name).isNull(), F.lit(NO_SECTION)).otherwise(F.lit(NO_ARRAY)).cast("long")
        out.append(F.coalesce(seen, gone).alias(name))
    return F.struct(*out)


def _section(items: Column, schema: dict) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(_element(e, schema)))


def broken_rules(found: Column, schema: dict = RECORD_SCHEMA) -> Column:
    """Sorted codes of the rules that ``masks`` show broken.  They are gone through one by one only where some is."""
    rules = []
    for name, sub in schema["properties"].items():
        path = f"$.{name}"
        if "items" in sub:
            rules += [(name, NO_SECTION, f"{path}:required")] if name in schema["required"] else []
            rules += [(name, NO_ARRAY, f"{path}:type"), (name, NO_OBJECT, f"{path}[]:type")]
            fields, path = sub["items"], f"{path}[]."
        else:
            fields, path = {"required": [n for n in schema["required"] if n == name], "properties": {name: sub}}, "$."
        for i, (k, leaf) in enumerate(fields["properties"].items()):
            rules += [(name, bits(i, "absent"), f"{path}{k}:required")] if k in fields["required"] else []
            rules.append((name, others(i, "absent", *_types(leaf)), f"{path}{k}:type"))
            rules += [(name, BAD_ENUM, f"{path}{k}:enum")] if "enum" in leaf else []
    wrong = {n: reduce(or_, [mask for name, mask, _ in rules if name == n]) for n in schema["properties"]}
    none = reduce(lambda x, y: x.bitwiseOR(y), [found[n].bitwiseAND(F.lit(m).cast("long")) for n, m in wrong.items()]) == 0
    codes = F.array_sort(F.array_compact(F.array(*[F.when(has(found[name], mask), F.lit(code)) for name, mask, code in rules])))
    return F.when(none, F.array().cast("array<string>")).otherwise(codes)


def violations(
    value: Column, is_object: Column, schema: dict = RECORD_SCHEMA, found: Column | None = None
) -> Column:
    """Sorted codes of the broken rules; null for a null value.  ``found`` are the value's ``masks`` where they are at hand."""
    broken = broken_rules(found, schema) if found is not None else _bound(masks(value, schema), lambda m: broken_rules(m, schema))
    checked = F.when(is_object, broken).otherwise(F.array(F.lit("$:type")))
    return F.when(value.isNotNull(), checked)
