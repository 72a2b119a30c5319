"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, name endings and types that mark identifier columns; numeric types; units with their terms.
IDENTIFIER_NAMES = ["uid", "remarks", "publicationdate", "release"]
IDENTIFIER_ENDINGS = ["id", "uid", "code", "identifiedby", "recordedby", "measuredby"]
NUMERIC_TYPES = ["real", "integer", "unsignedinteger", "signedinteger", "int", "bigint", "smallint", "float", "double", "decimal", "numeric", "number"]
COMPOUND_WORDS = ["per", "square", "squared", "cubic", "cubed"]
UNITS = {
    "meter": "UO:0000008",
    "centimeter": "UO:0000015",
    "millimeter": "UO:0000016",
    "kilometer": "UO:0010066",
    "gram": "UO:0000021",
    "kilogram": "UO:0000009",
    "milligram": "UO:0000022",
    "second": "UO:0000010",
    "minute": "UO:0000031",
    "hour": "UO:0000032",
    "day": "UO:0000033",
    "celsius": "UO:0000027",
    "degree celsius": "UO:0000027",
    "percent": "UO:0000187",
    "kilometer per hour": "UO:0010008",
    "kilometers per hour": "UO:0010008",
    "meter per second": "UO:0000094",
    "meters per second": "UO:0000094",
    "watt per square meter": "UO:0000155",
    "watts per square meter": "UO:0000155",
    "milligram per kilogram": "UO:0000308",
    "milligrams per kilogram": "UO:0000308",
    "square meter": "UO:0000080",
    "square meters": "UO:0000080",
    "cubic meter": "UO:0000096",
    "cubic meters": "UO:0000096",
    "number": "UO:0000189",
    "count": "UO:0000189",
    "degree": "UO:0000185",
    "milliliter": "UO:0000098",
    "liter": "UO:0000099",
}


def normalize_unit(unit: Column) -> Column:
    """``gramsPerCubicMeter`` as ``grams per cubic meter``; underscores and hyphens are spaces. Null stays null."""
    spaced = F.regexp_replace(F.trim(unit), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[_-]+", " "), r"\s+", " ")))


def unit_term(unit: Column) -> Column:
    """The term of a unit: of its normal form, else of the longest known unit that ends it as whole words.

    A compound word before that ending means another quantity, which has no term here; a remaining mention of celsius
    is degrees. Null, blank and unknown units give null.
    """
    key = normalize_unit(unit)
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    longest = F.lit(None).cast("string")
    for name in sorted(UNITS, key=len):
        longest = F.when(key.endswith(" " + name), F.lit(name)).otherwise(longest)
    compound = lambda words: F.arrays_overlap(F.split(words, " "), F.array(*[F.lit(w) for w in COMPOUND_WORDS]))
    before = F.substring(key, F.lit(1), F.length(key) - F.length(longest) - 1)
    return (
        F.when(known[key].isNotNull(), known[key])
        .when(longest.isNotNull(), F.when(~compound(before), known[longest]))
        .when(key.contains("celsius") & ~compound(key), F.lit(UNITS["celsius"]))
    )


def split_camel(name: Column) -> Column:
    """Words of a camel-case name in lower case; a run of capitals ends before its last one."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def is_numeric_type(dtype: Column) -> Column:
    """Membership in the numeric types without case, spaces and underscores; null is no."""
    return F.coalesce(F.regexp_replace(F.lower(dtype), r"[\s_]", "").isin(NUMERIC_TYPES), F.lit(False))


def is_identifier(name: Column, dtype: Column, profile: Column) -> Column:
    """True for columns that name, date or keep books on a record instead of measuring something."""
    low, kind = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(profile, F.lit("")))
    ending = F.lit(False)
    for e in IDENTIFIER_ENDINGS:
        ending = ending | low.endswith(e)
    return (
        low.isin(IDENTIFIER_NAMES)
        | (ending & (low != "taxonid"))
        | F.coalesce(F.lower(dtype).isin("datetime", "date"), F.lit(False))
        | kind.startswith("all blank")
        | kind.contains("not profiled")
    )


def column_queries(name: Column, description: Column, unit: Column) -> Column:
    """Up to three different search texts of a column: its split name, the first clause of its description, its unit."""
    first = F.trim(F.replace(split_camel(F.coalesce(name, F.lit(""))), F.lit("_"), F.lit(" ")))
    clause = F.trim(F.split(F.coalesce(description, F.lit("")), r"[;.(]")[0])
    some = lambda c: F.when(c != "", c)
    return F.slice(F.array_compact(F.array(some(first), F.when(F.lower(clause) != first, some(F.substring(clause, 1, 80))), some(unit))), 1, 3)


def profile_number(profile: Column, name: str) -> Column:
    """The number after ``name=`` in a column profile; null where there is none."""
    return F.nullif(F.regexp_extract(profile, rf"\b{name}=(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def top_profile_value(profile: Column) -> Column:
    """``X`` of ``2 distinct; top: X (n), ...``; null where there is none."""
    first = F.split(F.regexp_extract(profile, r"(?s)top:(.*)$", 1), ",")[0]
    return F.nullif(F.trim(F.regexp_replace(F.trim(first), r" \([^(]*$", "")), F.lit(""))


def attribute_key(label: Column) -> Column:
    """A label as snake-case key; null if nothing is left, so that the row can be rejected."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "_"), r"^_|_$", ""), F.lit(""))


def product_of(card: Column) -> Column:
    """The product code that begins a card's name; the whole name if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(card, r"^(DP\d\.\d{5}\.\d{3})", 1), F.lit("")), card)


def curie_prefix(curie: Column) -> Column:
    """The prefix of a compact term name in its canonical case; without a colon it is empty."""
    raw = F.upper(F.split_part(curie, F.lit(":"), F.lit(1)))
    return F.when(F.contains(curie, F.lit(":")), F.when(raw == "NCBITAXON", F.lit("NCBITaxon")).otherwise(raw)).otherwise(F.lit(""))


def iri_for(curie: Column) -> Column:
    return F.concat(F.lit("http://purl.obolibrary.org/obo/"), F.replace(curie, F.lit(":"), F.lit("_")))


def chars_estimate(text: Column) -> Column:
    """An upper estimate of tokens: two characters each."""
    return F.ceil(F.length(text) / 2).cast("long")


def token_guard(text: Column, max_len: int = 512, margin: int = 16) -> Column:
    """True for texts that would be cut at ``max_len`` tokens less a margin."""
    return chars_estimate(text) > max_len - margin


def canonical_sha(**fields: Column) -> Column:
    """sha256 of the compact JSON object with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def redact(url: Column) -> Column:
    """A URL or connection string without its credentials."""
    return F.regexp_replace(url, r"(?<=://)[^/@\s]+@", "***@")
