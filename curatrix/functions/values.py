"""Parsing of flags, labels and numbers, and derived categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.constants import LABEL_WORDS, MISSING_TOKENS
from curatrix.functions.text import as_col, is_missing_text, mentions, norm_text


def to_number(value: Column | str) -> Column:
    """Double, or null where the text is no plain number (``try_cast`` also takes ``1d``)."""
    text = norm_text(value)
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain, text.try_cast("double"))


def _word_flag(value: Column | str, true: list[str], false: list[str]) -> Column:
    word = F.lower(norm_text(value))
    return F.when(word.isin(true), F.lit(True)).when(word.isin(false), F.lit(False))


def is_true(value: Column | str) -> Column:
    """Flags written as true, 1, yes, y or t."""
    return F.lower(norm_text(value)).isin("true", "1", "yes", "y", "t")


def parse_bool(values: list[Column | str]) -> Column:
    """First readable flag over several columns: words, else a number; false where none."""
    readings = []
    for value in values:
        readings.append(_word_flag(value, ["true", "yes", "1"], ["false", "no", "0"]))
        readings.append(to_number(value) != 0)
    return F.coalesce(*readings, F.lit(False))


def parse_label(value: Column | str) -> Column:
    """A number, else a label word, else null."""
    words = F.create_map(*[F.lit(x) for pair in LABEL_WORDS.items() for x in pair])
    return F.coalesce(to_number(value), words[F.lower(norm_text(value))].cast("double"))


def binary_label(value: Column | str) -> Column:
    """0 or 1 as integer, null for everything else (``1.0`` counts)."""
    number = to_number(value)
    return F.when(number.isin(0.0, 1.0), number.cast("int"))


def numeric_or_flag(value: Column | str) -> Column:
    """A number, else a flag word as 0/1, else 0.0."""
    flag = _word_flag(value, ["true", "yes", "1"], ["false", "no", "0"])
    return F.coalesce(to_number(value), flag.cast("double"), F.lit(0.0))


def derive_label(positive: Column | str, negative: Column | str, pattern: str) -> tuple[Column, Column]:
    """(label, conflict): positive text wins; conflict where both mention the target."""
    pos, neg = mentions(positive, pattern), mentions(negative, pattern)
    return F.when(pos, 1).when(neg, 0), pos & neg


def region_group(value: Column | str) -> Column:
    """Free text to one of five broad regions; the first matching rule decides."""
    text = F.lower(norm_text(value))
    return (
        F.when(text.isin(MISSING_TOKENS), "unknown")
        .when(text.contains("rbd") | text.contains("receptor binding"), "RBD")
        .when(text.contains("ntd") | text.contains("n-terminal") | text.contains("n terminal"), "NTD")
        .when((text == "s") | text.contains("spike") | text.contains("s protein"), "Spike/S")
        .otherwise("other")
    )


def region_group_coarse(value: Column | str) -> Column:
    """The three-way variant."""
    text = F.lower(norm_text(value))
    return (
        F.when(text.isin(MISSING_TOKENS), "other_unknown")
        .when(text.contains("rbd") | text.contains("receptor binding"), "RBD")
        .when(text.contains("spike") | text.isin("s", "s protein"), "Spike non-RBD")
        .otherwise("other_unknown")
    )


def light_status(missing_light: Column) -> Column:
    return F.when(missing_light, "light_missing_or_single_chain").otherwise("paired")


def has_structure(flags: list[Column | str], text: Column | str) -> Column:
    return parse_bool(flags) | ~is_missing_text(text)


# --- residue statistics ------------------------------------------------------

def char_count(value: Column | str, letters: str) -> Column:
    value = as_col(value)
    return F.length(value) - F.length(F.translate(value, letters, ""))


def char_fraction(value: Column | str, letters: str, blank: float | None = None) -> Column:
    """Share of the letters in the text; ``blank`` for an empty one."""
    value = as_col(value)
    share = char_count(value, letters) / F.nullif(F.length(value), F.lit(0))
    return share if blank is None else F.coalesce(share, F.lit(blank))


def motif_count(value: Column | str, overlapping: bool = True) -> Column:
    """Motifs N-x-S/T with x other than P, counted with or without overlap."""
    pattern = "N(?=[^P][ST])" if overlapping else "N[^P][ST]"
    found = F.size(F.regexp_extract_all(as_col(value), F.lit(pattern), F.lit(0)))
    return F.coalesce(found, F.lit(0))


def length_class(length: Column, edges: tuple[int, int], names: tuple[str, str, str], missing: str) -> Column:
    """Three length classes; both inner edges belong to the lower class."""
    low, high = edges
    return (
        F.when(length <= low, names[0])
        .when(length <= high, names[1])
        .when(length > high, names[2])
        .otherwise(missing)
    )


def region_length_bin(length: Column, missing: str = "unknown") -> Column:
    return length_class(length, (10, 20), ("short", "medium", "long"), missing)


def heavy_length_bin(length: Column, missing: str = "missing") -> Column:
    return length_class(length, (115, 135), ("short", "normal", "long"), missing)


def width_bin(value: Column, width: int) -> Column:
    return (F.floor(value / width) * width).cast("long")


def matching_bin(heavy: Column, light: Column) -> Column:
    """Coarse key for matched sampling: two widths of five, the total by ten, light present."""
    has_light = F.when(light > 0, "True").otherwise("False")
    return F.concat_ws(
        "|", width_bin(heavy, 5), width_bin(light, 5), width_bin(heavy + light, 10), has_light
    )
