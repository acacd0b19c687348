"""Classifiers of bureau accounts as column expressions.

Lists are checked in order and the first match wins.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelforge.functions.scalars import number

# Account types by what their text holds, and what excludes them.
ACCOUNT_TYPES = [
    ("microfinance_loans", ["microfinance"], []),
    ("credit_cards", ["credit card"], ["loan on credit card", "kisan credit card"]),
    ("gold_loans", ["gold loan"], []),
    ("home_loans", ["housing loan", "awas yojana", "home loan"], []),
    ("education_loans", ["education loan"], []),
    ("consumer_loans", ["consumer loan"], []),
    ("personal_loans", ["personal loan"], []),
    ("property_loans", ["property loan", "loan against property"], []),
    ("overdraft_accounts", ["overdraft"], []),
    ("business_loans", ["business", "mudra", "gecl", "loan to professional", "credit facility", "kisan credit card"], []),
    ("vehicle_loans", ["auto loan", "vehicle loan", "car loan", "tractor loan", "construction equipment", "two wheeler"], []),
]
BUCKETS = [name for name, _, _ in ACCOUNT_TYPES] + ["other_loans"]

# Statuses of closed and of settled accounts.
CLOSED = [
    "closed", "closed account", "charge off/written off", "written off", "settled", "post write off settled", "restructured & closed",
    "restructured and closed", "post write off closed", "account is inactive", "repossessed & settled", "sold/purchased",
]
SETTLED = ["settled", "post write off settled"]
WRITTEN_OFF = ["charge off/written off", "written off", "post write off settled", "post write off closed", "settled"]

# Institutions by what their name holds.
INSTITUTIONS = [
    ("PSU Bank", [
        "state bank of india", "punjab national bank", "canara bank", "bank of baroda", "union bank of india", "bank of india", "indian bank",
        "indian overseas bank", "uco bank", "central bank of india", "idbi bank", "punjab & sind bank", "uttar pradesh gramin bank",
    ]),
    ("Foreign Bank", [
        "standard chartered bank", "citibank n.a.", "hongkong and shanghai banking corporation limited", "american express banking corp",
        "dbs bank ltd india", "natwest markets plc", "sbm bank (india) limited", "deutsche bank", "barclays bank",
    ]),
    ("Private Bank", [
        "hdfc", "icici", "axis bank", "kotak mahindra bank", "indusind", "yes bank", "rbl bank", "idfc first", "karur vysya", "federal bank",
        "south indian bank", "jammu & kashmir bank", "development credit bank", "dcb bank", "au small finance bank", "slice small finance bank",
        "bandhan bank", "csb bank", "karnataka bank", "dhanlaxmi bank", "tamilnad mercantile",
    ]),
    ("Asset Reconstruction Company", ["asset reconstruction", "arcil", " arc ", "arc private", "arc limited", "assets care", "care & reconstruction"]),
    ("Fintech / Digital Lender", [
        "mpokket", "krazybee", "kreditbee", "kisetsu saison", "cashe", "si creva", "branch international", "capfloat", "oxyzo", "earlysalary", "fibe",
        "true credits", "payu finance", "dhani", "snapmint", "ndx p2p", "whizdm", "innofin", "apollo finvest", "transactree", "fdpl finance",
        "upmove capital", "fincfriends", "moneytap", "zestmoney", "navi finserv", "kissht", "indialends", "simpl", "lazypay", "uni cards", "rupeek",
        "fintech", "trillionloans", "wheelsemi", "fairassets", "epimoney",
    ]),
    ("NBFC", [
        "finance", "financial", "fincorp", "capital", "credit", "investments", "housing", "leasing", "leyland", "securities", "loan", "muthoot",
        "sbi cards", "bob cards", "kotak mahindra prime", "hire purchase", "indel money", "lease", "grih rin",
    ]),
    ("Private Bank", ["bank"]),
    ("NBFC", ["fin"]),
]
UNCLASSIFIED = "Other / Unclassified"

# Lenders of a segment whatever their category.
PREMIUM_NAMES = ["american express"]
MAINSTREAM_NAMES = ["sbi cards", "bob cards"]

# Lenders of two segments of NBFCs.
DIGITAL_NBFC = ["home credit", "bajaj finance", "krazybee", "kreditbee", "mpokket", "earlysalary", "fibe", "cashe", "dhani", "snapmint", "true credits"]
SECURED_NBFC = [
    "muthoot", "manappuram", "indel money", "housing", "home finance", "leyland", "mahindra financial", "tvs credit", "l&t finance",
    "cholamandalam", "hero fincorp", "shriram", "hinduja", "grih rin", "wheelsemi",
]
SEGMENTS = {
    "Premium": "premium", "Mainstream": "mainstream", "Distressed": "distressed", "Mass Market - Digital": "mass_market_digital",
    "Mass Market - Secured": "mass_market_secured", "Mass Market - General NBFC": "mass_market_general_nbfc", "Unclassified": "unclassified",
}


def holds(c: Column, parts: list[str]) -> Column:
    return reduce(or_, (c.contains(p) for p in parts), F.lit(False))


def account_type(c: Column) -> Column:
    """B2: the bucket of an account type's text; null is other_loans."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    chain = None
    for name, inside, outside in ACCOUNT_TYPES:
        hit = holds(t, inside) & ~holds(t, outside) if outside else holds(t, inside)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("other_loans")


def status(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")


def is_active(c: Column) -> Column:
    """Any status but the closed ones; null is active."""
    return ~status(c).isin(CLOSED)


def institution(c: Column) -> Column:
    """The category of an institution's name."""
    t = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    chain = F.when(t == "", UNCLASSIFIED)
    for name, parts in INSTITUTIONS:
        chain = chain.when(holds(t, parts), name)
    return chain.otherwise(UNCLASSIFIED)


def segment(category: Column, name: Column) -> Column:
    """The segment of an institution's category and name."""
    t = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    nbfc = category == "NBFC"
    return (
        F.when((category == "Foreign Bank") | holds(t, PREMIUM_NAMES), "Premium")
        .when(holds(t, MAINSTREAM_NAMES) | category.isin("PSU Bank", "Private Bank"), "Mainstream")
        .when(category == "Asset Reconstruction Company", "Distressed")
        .when((category == "Fintech / Digital Lender") | (nbfc & holds(t, DIGITAL_NBFC)), "Mass Market - Digital")
        .when(nbfc & holds(t, SECURED_NBFC), "Mass Market - Secured")
        .when(nbfc, "Mass Market - General NBFC")
        .otherwise("Unclassified")
    )


def amount(c: Column) -> Column:
    """A number with thousands commas; what is none counts as 0."""
    return F.coalesce(number(F.regexp_replace(c, ",", "")), F.lit(0.0))
