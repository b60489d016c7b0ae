"""Ordered substring search: each region must follow the one before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = "struct<at:int,pieces:array<string>,failed:array<string>,ambiguous:array<string>>"


def _spaced(text: Column) -> Column:
    return F.array_join(F.split(text, ""), " ")


def mark_spans(sequence: Column, regions: list[tuple[str, Column]]) -> Column:
    """Struct with the marked text and the names of failed and ambiguous regions.

    A fold over the regions keeps the position behind the last hit, so the search stays one
    expression per row.
    """
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.coalesce(text, F.lit("")).alias("text"))
        for name, text in regions
    ])
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.lit(1).alias("at"), empty.alias("pieces"), empty.alias("failed"), empty.alias("ambiguous")
    ).cast(STATE)

    def step(state: Column, region: Column) -> Column:
        rest = F.substr(sequence, state["at"])
        offset = F.when(region["text"] == "", 0).otherwise(F.instr(rest, region["text"]))
        removed = F.length(rest) - F.length(F.replace(rest, region["text"], F.lit("")))
        repeated = (offset > 0) & (removed > F.length(region["text"]))
        marker = F.upper(region["name"])
        pieces = F.array_append(state["pieces"], _spaced(F.substr(rest, F.lit(1), offset - 1)))
        pieces = F.array_append(pieces, F.concat(F.lit("<"), marker, F.lit("_START>")))
        pieces = F.array_append(pieces, _spaced(region["text"]))
        pieces = F.array_append(pieces, F.concat(F.lit("<"), marker, F.lit("_END>")))
        return F.struct(
            F.when(offset > 0, state["at"] + offset - 1 + F.length(region["text"]))
            .otherwise(state["at"]).alias("at"),
            F.when(offset > 0, pieces).otherwise(state["pieces"]).alias("pieces"),
            F.when(offset > 0, state["failed"])
            .otherwise(F.array_append(state["failed"], region["name"])).alias("failed"),
            F.when(repeated, F.array_append(state["ambiguous"], region["name"]))
            .otherwise(state["ambiguous"]).alias("ambiguous"),
        ).cast(STATE)

    def finish(state: Column) -> Column:
        pieces = F.array_append(state["pieces"], _spaced(F.substr(sequence, state["at"])))
        return F.struct(
            F.array_join(F.filter(pieces, lambda piece: piece != ""), " ").alias("marked_text"),
            F.array_join(state["failed"], ",").alias("failed_regions"),
            F.array_join(state["ambiguous"], ",").alias("ambiguous_regions"),
            (F.size(state["failed"]) == 0).alias("ok"),
        )

    return F.aggregate(wanted, start, step, finish)
