"""Column functions over names, formulas, hashes and flags."""

from __future__ import annotations

import hashlib
import json
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Categories of elements that count as metals, the pattern of a citation key, the number within a
# text, the token of a formula, and the synonyms of structure families.
METAL_CATEGORIES = ("alkali metal", "alkaline earth metal", "metal", "transition metal", "lanthanoid", "actinoid")
BIBTEX_KEY = r"(?i)@\w+\s*\{\s*([^,\s]+)"
NUMBER = r"[-+]?\d+(?:\.\d+)?"
FORMULA_TOKEN = r"([A-Z][a-z]?)(\d+(?:\.\d+)?)?"
FAMILY_SYNONYMS = {"SPINELS": "SPINEL"}
#: A whole text that is a number.
_WHOLE = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("string"), 256)


def derived_seed(base: int, *parts: Column) -> Column:
    """First 32 bits of the hash of base and parts joined by bars, modulo 2**31 - 1."""
    text = F.concat_ws("|", F.lit(str(base)), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 2147483647).cast("long")


def stable_id(prefix: str, payload: Column, length: int = 20) -> Column:
    """Prefix and the first digits of the hash of a payload's canonical JSON; the payload is a JSON text, as of ``F.to_json``."""
    return F.concat(F.lit(prefix + "_"), F.substring(json_sha256(payload), 1, length))


def graph_id(fingerprint: Column) -> Column:
    return F.concat(F.lit("pg_"), F.substring(F.sha2(fingerprint, 256), 1, 18))


def record_id(raw_index: Column, jid: Column) -> Column:
    return F.format_string("em_complete_%04d_jid_%s", raw_index.cast("int"), F.coalesce(jid.cast("string"), F.lit("None")))


def edge_uid(number: Column) -> Column:
    """Default uid of the edge at that place, counted from 1."""
    return F.format_string("edge_%04d", number.cast("int"))


def source_group(bibtex: Column, fallback: Column) -> Column:
    """``SELF`` if that is the whole entry, else its citation key; the fallback where there is none."""
    key = F.regexp_extract(bibtex, BIBTEX_KEY, 1)
    return F.when(F.upper(F.trim(bibtex)) == "SELF", "SELF").when(key != "", key).otherwise(fallback)


def source_resolved(bibtex: Column) -> Column:
    return F.coalesce((F.upper(F.trim(bibtex)) == "SELF") | (F.regexp_extract(bibtex, BIBTEX_KEY, 1) != ""), F.lit(False))


def family(x: Column, synonyms: dict[str, str] = FAMILY_SYNONYMS) -> Column:
    """Upper case with single blanks, synonyms replaced; UNSPECIFIED where nothing is left."""
    name = F.upper(F.regexp_replace(F.trim(F.coalesce(x.cast("string"), F.lit("None"))), r"\s+", " "))
    return F.when(name == "", "UNSPECIFIED").otherwise(translated(name, synonyms))


def normal_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))


def first_number(x: Column) -> Column:
    """The whole cell if it is a number (null if that isn't finite), else the first number within it."""
    text = F.trim(x.cast("string"))
    inside = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double")
    whole = F.when(F.abs(text.try_cast("double")) < float("inf"), text.try_cast("double"))
    return F.when(text.rlike(_WHOLE), whole).when(~F.lower(text).isin("nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"), inside)


def is_metal(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*METAL_CATEGORIES), F.lit(False)).cast("double")


def finite_or_null(x: Column) -> Column:
    v = F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def triple(x: Column, kind: str = "double") -> Column:
    return F.transform(F.split(x, r"\s*,\s*"), lambda p: F.trim(p).cast(kind))


def present(x: Column, kind: str) -> Column:
    """Whether a value is there: a blank text or an empty container isn't."""
    if kind == "string":
        return F.coalesce(F.trim(x) != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(x) > 0, F.lit(False))
    return x.isNotNull()


def with_flag(flags: Column, flag: str, condition: Column) -> Column:
    return F.when(condition, F.array_union(flags, F.array(F.lit(flag)))).otherwise(flags)


def packed_flags(flags: Column) -> Column:
    return F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, ";"))


def text_number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def translated(x: Column, table: dict[str, str]) -> Column:
    if not table:
        return x
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x], x)


def group_key(formula: Column, species: Column) -> Column:
    """Reduced formula and migrating species; null where the formula can't be reduced."""
    return F.concat(reduced_formula(formula), F.lit("|"), species)


def unordered_pair(x: Column, y: Column) -> Column:
    return F.concat_ws("|", F.least(x, y), F.greatest(x, y))


def reduce_formula(formula: str) -> str:
    """A formula over the greatest divisor of its amounts.

    Tokens stay as they stand, so a symbol may come twice; amounts may be decimal; blanks don't count.  What is
    not a row of symbols and amounts raises ValueError, as do amounts that are all zero.
    """
    plain = formula.replace(" ", "")
    if not re.fullmatch(f"(?:{FORMULA_TOKEN})+", plain):
        raise ValueError(f"not a formula: {formula!r}")
    parts = [(symbol, Fraction(n or 1)) for symbol, n in re.findall(FORMULA_TOKEN, plain)]
    scale = math.lcm(*(n.denominator for _, n in parts))
    unit = math.gcd(*(int(n * scale) for _, n in parts))
    if not unit:
        raise ValueError(f"no amounts: {formula!r}")
    amounts = [int(n * scale) // unit for _, n in parts]
    return "".join(symbol if n == 1 else f"{symbol}{n}" for (symbol, _), n in zip(parts, amounts, strict=True))


def _reduced_or_none(formula: str | None) -> str | None:
    try:
        return None if formula is None else reduce_formula(formula)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def reduced_formula(x: pd.Series) -> pd.Series:
    """``reduce_formula`` of a column; null where it raises."""
    return x.map(_reduced_or_none)


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def float_text(x: pd.Series) -> pd.Series:
    """Shortest text that gives the number back, empty for none."""
    return x.map(lambda v: "" if v is None or v != v else repr(float(v)))


@F.pandas_udf(StringType())
def canonical_json(x: pd.Series) -> pd.Series:
    """Canonical form of a JSON text."""
    return x.map(lambda t: None if t is None else canonical(json.loads(t)))


@F.pandas_udf(StringType())
def json_sha256(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else hashlib.sha256(canonical(json.loads(t)).encode()).hexdigest())
