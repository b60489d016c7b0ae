"""Text columns: missing markers, cleaning, joining, splitting and hashing.

Every function maps Column to Column with JVM built-ins. ``(?U)`` makes ``\\s`` and ``\\b``
follow Unicode, so non-breaking spaces count as blanks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.constants import (
    CANONICAL_RESIDUES,
    MISSING_TOKENS,
    PLACEHOLDER_MARKERS,
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), r"(?U)^\s+|\s+$", "")


def squeeze(value: Column | str) -> Column:
    """Upper case with every blank removed."""
    return F.upper(F.regexp_replace(as_col(value), r"(?U)\s+", ""))


def norm_text(value: Column | str, missing: str | None = None) -> Column:
    """Trimmed text, null as blank; missing tokens become ``missing`` when it is given."""
    text = strip(F.coalesce(as_col(value).cast("string"), F.lit("")))
    if missing is None:
        return text
    return F.when(F.lower(text).isin(MISSING_TOKENS), F.lit(missing)).otherwise(text)


def normalize_marker(value: Column | str) -> Column:
    """Lower case, every run of other characters than letters and digits as one space."""
    lowered = F.lower(as_col(value).cast("string"))
    return F.trim(F.regexp_replace(lowered, r"[^a-z0-9]+", " "))


def is_missing(value: Column | str, markers: list[str] | None = None) -> Column:
    """Null or a placeholder. ``n/a`` normalises to ``n a``, which is no marker, and stays."""
    value = as_col(value)
    return value.isNull() | normalize_marker(value).isin(markers or PLACEHOLDER_MARKERS)


def is_missing_text(value: Column | str) -> Column:
    """Null or one of the short missing tokens."""
    return F.lower(norm_text(value)).isin(MISSING_TOKENS)


def is_blank(value: Column | str) -> Column:
    return norm_text(value) == ""


def clean_sequence(value: Column | str, mode: str = "compact") -> Column:
    """Blank-free upper case; then by mode.

    ``placeholder``: placeholders become null; ``token``: missing tokens become blank;
    ``canonical``: other letters than the 20 residues are removed; ``compact``: nothing more.
    """
    value = as_col(value)
    if mode == "placeholder":
        text = squeeze(value)
        return F.when(is_missing(value) | is_missing(text), F.lit(None)).otherwise(text)
    text = squeeze(F.coalesce(value, F.lit("")))
    if mode == "token":
        return F.when(F.lower(text).isin(MISSING_TOKENS), F.lit("")).otherwise(text)
    if mode == "canonical":
        return F.regexp_replace(text, f"[^{CANONICAL_RESIDUES}]", "")
    if mode == "compact":
        return text
    raise ValueError(f"unknown mode: {mode}")


def is_valid_alphabet(value: Column | str, alphabet: str = CANONICAL_RESIDUES) -> Column:
    return F.coalesce(as_col(value).rlike(f"^[{alphabet}]+$"), F.lit(False))


def mentions(value: Column | str, pattern: str) -> Column:
    """Case-insensitive regex hit; null counts as no hit."""
    return F.coalesce(as_col(value), F.lit("")).rlike(f"(?iU){pattern}")


def any_mention(values: list[Column | str], pattern: str) -> Column:
    return mentions(F.concat_ws(" ", *[as_col(v) for v in values]), pattern)


def pair_text(heavy: Column | str, light: Column | str, sep: str = "[SEP]", always: bool = False) -> Column:
    """``heavy sep light``; heavy alone where light is absent, unless ``always``."""
    heavy, light = as_col(heavy), F.coalesce(as_col(light), F.lit(""))
    joined = F.concat(heavy, F.lit(sep), light)
    return joined if always else F.when(light != "", joined).otherwise(heavy)


def split_pair(value: Column | str, sep: str = "[SEP]") -> tuple[Column, Column]:
    """Parts before and after the first separator; blank second part without one."""
    value = as_col(value)
    at = F.instr(value, F.lit(sep))
    first = F.when(at > 0, F.substr(value, F.lit(1), at - 1)).otherwise(value)
    second = F.when(at > 0, F.substr(value, at + len(sep))).otherwise(F.lit(""))
    return first, second


def model_text(value: Column | str) -> Column:
    """Existing pair text for n-grams: the separator becomes one bar, blanks go."""
    return squeeze(F.replace(F.coalesce(as_col(value), F.lit("")), F.lit("[SEP]"), F.lit("|")))


def region_text(values: list[Column | str], sep: str = "|") -> Column:
    parts = [F.coalesce(as_col(v), F.lit("")) for v in values]
    return squeeze(F.concat_ws(sep, *parts))


def prefix(value: Column | str, n: int) -> Column:
    return F.left(as_col(value), F.lit(n))


def suffix(value: Column | str, n: int) -> Column:
    return F.right(as_col(value), F.lit(n))


def hash_id(value: Column | str, n: int = 64, tag: str = "", blank: str | None = None) -> Column:
    """First n hex digits of SHA-256, with an optional tag and a constant for blanks."""
    value = as_col(value)
    digest = F.concat(F.lit(tag), F.left(F.sha2(value, 256), F.lit(n)))
    return digest if blank is None else F.when(value == "", F.lit(blank)).otherwise(digest)


def primary_token(value: Column | str, default: str = "missing_source") -> Column:
    """First non-blank part of a list separated by ``;``, ``,`` or ``|``."""
    text = norm_text(value)
    parts = F.filter(F.transform(F.split(text, r"[;,|]"), strip), lambda part: part != "")
    return F.when(text == "", F.lit(default)).otherwise(F.coalesce(F.get(parts, F.lit(0)), text))


def first_nonblank_of(values: list[Column | str]) -> Column:
    """Value of the first column that is not blank."""
    kept = [F.when(~is_blank(v), as_col(v)) for v in values]
    return F.coalesce(*kept, F.lit(""))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
