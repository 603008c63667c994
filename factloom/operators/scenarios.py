"""The seven scenarios, stated as data: which slots a text has, how each slot is drawn,
and which record belongs to the text.  ``generate.py`` turns this into columns."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Choice:
    """Item of a pool, avoiding the values of other slots of the same row."""

    draw: str
    pool: str
    without: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole:
    """Whole number in [low, high]; with a suffix it becomes text."""

    draw: str
    low: int
    high: int
    suffix: str = ""


@dataclass(frozen=True)
class Scenario:
    name: str
    event_type: str
    text: str
    slots: dict
    money: dict
    top: tuple
    entities: tuple
    date_role: str
    relationships: tuple
    financials: tuple = ()
    metrics: tuple = ()
    partners: tuple = field(default=())


ORG_A = Choice("org_a", "organizations")
PERSON_A = Choice("person_a", "persons")
PRODUCT = Choice("product", "products")
LOCATION = Choice("location", "locations")

# Scenario names, event types, entity types, section item types, date roles,
# metric names and number ranges below must keep these spellings, since records are compared by them.
SCENARIOS = (
    Scenario(
        name="acquisition",
        event_type="acquisition",
        text="Purchase of {target} by {acquirer}, closed {date_raw}; price: {amount}. chief executives: "
        "{ceo1} ({acquirer}) and {ceo2} ({target}). adviser: {advisor}.",
        slots={
            "acquirer": ORG_A,
            "target": Choice("org_b", "organizations", ("acquirer",)),
            "advisor": Choice("org_c", "organizations"),
            "ceo1": PERSON_A,
            "ceo2": Choice("person_b", "persons", ("ceo1",)),
        },
        money={"amount": "amount_a"},
        top=("acquirer", "target"),
        entities=(
            ("organization", "acquirer"), ("organization", "target"), ("organization", "advisor"),
            ("person", "ceo1"), ("person", "ceo2"),
        ),
        financials=(("acquisition_value", "amount", {}),),
        date_role="announcement",
        relationships=(
            ("employment", "{ceo1}", "{acquirer}", {"role": "CEO"}),
            ("employment", "{ceo2}", "{target}", {"role": "CEO"}),
            ("acquired", "{acquirer}", "{target}", {"value": "{amount}", "date": "{date_raw}"}),
            ("advisor", "{advisor}", "acquisition", {}),
        ),
    ),
    Scenario(
        name="funding",
        event_type="funding_round",
        text="Series {series} round of {company}: raised {amount}, raised so far {total_amount}; lead: "
        "{lead_investor}; also in: {participant}; dated {date_raw}. chief executive: {ceo}; main product: {product}.",
        slots={
            "company": ORG_A,
            "lead_investor": Choice("org_b", "organizations", ("company",)),
            "participant": Choice("org_c", "organizations", ("company", "lead_investor")),
            "ceo": PERSON_A,
            "product": PRODUCT,
            "series": Choice("attr_a", "series"),
        },
        money={"amount": "amount_a", "total_amount": "amount_b"},
        top=("company",),
        entities=(
            ("organization", "company"), ("organization", "lead_investor"),
            ("organization", "participant"), ("person", "ceo"), ("product", "product"),
        ),
        financials=(
            ("funding_raised", "amount", {"series": "{series}"}),
            ("total_funding", "total_amount", {}),
        ),
        date_role="announcement",
        relationships=(
            ("employment", "{ceo}", "{company}", {"role": "CEO"}),
            ("lead_investor", "{lead_investor}", "{company}", {}),
            ("investor", "{participant}", "{company}", {}),
        ),
    ),
    Scenario(
        name="executive_hire",
        event_type="executive_hire",
        text="New at {company} from {date_raw}: {person}, {role}. before: {previous_role} at "
        "{previous_company}. reports to: {chief}, chief executive.",
        slots={
            "company": ORG_A,
            "previous_company": Choice("org_b", "organizations", ("company",)),
            "person": PERSON_A,
            "chief": Choice("person_b", "persons", ("person",)),
            "role": Choice("attr_a", "new_roles"),
            "previous_role": Choice("attr_b", "old_roles"),
        },
        money={},
        top=("company",),
        entities=(
            ("organization", "company"), ("organization", "previous_company"),
            ("person", "person"), ("person", "chief"),
        ),
        date_role="effective_date",
        relationships=(
            ("employment", "{person}", "{company}", {"role": "{role}"}),
            ("employment", "{person}", "{previous_company}", {"role": "{previous_role}"}),
            ("employment", "{chief}", "{company}", {"role": "CEO"}),
        ),
    ),
    Scenario(
        name="partnership",
        event_type="partnership",
        text="Joint project of {org1} and {org2}; subject: {product}; value: {amount}; place: {location}; "
        "signed: {date_raw}; jobs: {jobs}. contact: {exec1}, technology chief of {org1}.",
        slots={
            "org1": ORG_A,
            "org2": Choice("org_b", "organizations", ("org1",)),
            "exec1": PERSON_A,
            "product": PRODUCT,
            "location": LOCATION,
            "jobs": Whole("attr_a", 50, 2000),
        },
        money={"amount": "amount_a"},
        top=(),
        partners=("org1", "org2"),
        entities=(
            ("organization", "org1"), ("organization", "org2"), ("person", "exec1"),
            ("product", "product"), ("location", "location"),
        ),
        financials=(("partnership_value", "amount", {}),),
        date_role="signing_date",
        relationships=(
            ("partnership", "{org1}", "{org2}", {"focus": "{product}"}),
            ("employment", "{exec1}", "{org1}", {"role": "CTO"}),
        ),
        metrics=(("jobs_created", "jobs"),),
    ),
    Scenario(
        name="product_launch",
        event_type="product_launch",
        text="{product}, new from {company}: first shown {date_raw} in {location}. unit price {amount}; "
        "orders from {customer1} and {customer2}; sales expected in year one: {revenue}. chief executive: {ceo}.",
        slots={
            "company": ORG_A,
            "customer1": Choice("org_b", "organizations", ("company",)),
            "customer2": Choice("org_c", "organizations", ("company", "customer1")),
            "ceo": PERSON_A,
            "product": PRODUCT,
            "location": LOCATION,
        },
        money={"amount": "amount_a", "revenue": "amount_b"},
        top=("company",),
        entities=(
            ("organization", "company"), ("organization", "customer1"), ("organization", "customer2"),
            ("person", "ceo"), ("product", "product"), ("location", "location"),
        ),
        financials=(("unit_price", "amount", {}), ("projected_revenue", "revenue", {})),
        date_role="launch_date",
        relationships=(
            ("employment", "{ceo}", "{company}", {"role": "CEO"}),
            ("customer", "{customer1}", "{company}", {}),
            ("customer", "{customer2}", "{company}", {}),
        ),
        metrics=(("first_year_projection", "revenue"),),
    ),
    Scenario(
        name="quarterly_results",
        event_type="earnings_report",
        text="Q{quarter} {year}, {company}, reported {date_raw}. revenue {revenue} (forecast {expected}); "
        "guidance {guidance}; growth of the best segment {growth}; best seller {product}. signed {ceo}, chief "
        "executive, and {cfo}, finance chief.",
        slots={
            "company": ORG_A,
            "ceo": PERSON_A,
            "cfo": Choice("person_b", "persons", ("ceo",)),
            "product": PRODUCT,
            "growth": Whole("attr_b", 10, 150, "%"),
            "quarter": Whole("attr_c", 1, 4),
            "year": Choice("attr_d", "years"),
        },
        money={"revenue": "amount_b", "expected": "amount_c", "guidance": "amount_b"},
        top=("company",),
        entities=(
            ("organization", "company"), ("person", "ceo"), ("person", "cfo"), ("product", "product"),
        ),
        financials=(
            ("revenue", "revenue", {"period": "Q{quarter} {year}"}),
            ("expected_revenue", "expected", {}),
            ("guidance", "guidance", {}),
        ),
        date_role="report_date",
        relationships=(
            ("employment", "{ceo}", "{company}", {"role": "CEO"}),
            ("employment", "{cfo}", "{company}", {"role": "CFO"}),
        ),
        metrics=(("segment_growth", "growth"), ("quarter", "Q{quarter} {year}")),
    ),
    Scenario(
        name="legal",
        event_type="regulatory_approval",
        text="{regulatory_body} approved {product} of {company} on {date_raw}, {duration} months after filing. "
        "case officer: {official}. chief executive: {ceo}. market size: {market_size}; share price change: {percent}.",
        slots={
            "company": ORG_A,
            "regulatory_body": Choice("org_b", "regulators"),
            "ceo": PERSON_A,
            "official": Choice("person_b", "persons", ("ceo",)),
            "product": PRODUCT,
            "duration": Whole("attr_c", 3, 24),
            "percent": Whole("attr_d", 2, 25, "%"),
        },
        money={"market_size": "amount_c"},
        top=("company",),
        entities=(
            ("organization", "company"), ("organization", "regulatory_body"), ("person", "ceo"),
            ("person", "official"), ("product", "product"),
        ),
        financials=(("market_size", "market_size", {}),),
        date_role="approval_date",
        relationships=(
            ("employment", "{ceo}", "{company}", {"role": "CEO"}),
            ("regulatory_approved", "{regulatory_body}", "{product}", {}),
        ),
        metrics=(("review_duration_months", "duration"), ("stock_change_percent", "percent")),
    ),
)

SCENARIO_NAMES = [s.name for s in SCENARIOS]
