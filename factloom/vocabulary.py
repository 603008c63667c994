"""What the generator draws from: names made by rule from a few parts, amounts from sign, number and scale."""

from itertools import product


def named(firsts: str, seconds: str) -> list[str]:
    """Every first part with every second part."""
    return [f"{a} {b}" for a, b in product(firsts.split(), seconds.split())]


ENTITY_TYPES = ("organization", "person", "product", "location")
SCALES = {"M": 1_000_000, "B": 1_000_000_000}

# (text as printed, whole units); the first character of the text is the currency sign.
AMOUNTS = [
    (f"{sign}{number:g}{scale}", int(number * SCALES[scale]))
    for sign in "$€£¥"
    for number, scale in ((6, "M"), (25, "M"), (410, "M"), (2.5, "B"), (11, "B"))
]

FIRST_DAY = "2024-01-01"
DAY_SPAN = 731

INVENTED_ENTITIES = [(kind, f"Unlisted {kind.title()} {mark}") for kind in ENTITY_TYPES for mark in ("One", "Two")]

POOLS = {
    "organizations": named("Alder Basalt Cinder Dune Ember Fathom Gale", "Works Lines Research Holdings"),
    "persons": named("Aiko Boris Carmen Dalia Edvin Femi", "Aalto Barros Cohen Dube Ekström Fontana"),
    "products": named("Amber Birch Copper Delta Fern", "Meter Router Valve Scanner"),
    "locations": "Turku Varna Cusco Nagoya Tromsø Bilbao Harare Perth Quito".split(),
    "regulators": named("Harbour Radio Seed Water Vaccine Toy", "Authority"),
    "new_roles": [f"Chief {field} Officer" for field in "Information Legal People Product Commercial".split()],
    "old_roles": [f"Head of {field}" for field in "Audit Labs Sales".split()],
    "series": list("ABCDEF"),
    "years": [str(year) for year in range(2023, 2027)],
}
