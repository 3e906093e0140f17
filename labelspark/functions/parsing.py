"""Parsing of label lists that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.functions.text import strip_white_space

# How a label id may be written.
BARE_ID = r"^[0-9]+$"
QUOTED_ID = r"^[+-]?[0-9]+$"

NUMBER_KINDS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _element(item: Column) -> Column:
    """One list element as (id, bad): null id = skipped, bad = spoils the whole list."""
    kind = F.schema_of_variant(item)
    word = strip_white_space(F.try_variant_get(item, "$", "string"))
    is_word = kind == "STRING"
    number = (
        F.when(kind.rlike(NUMBER_KINDS), F.try_variant_get(item, "$", "bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(item, "$", "boolean").cast("bigint"))
        .when(is_word & word.rlike(QUOTED_ID), word.try_cast("bigint"))
    )
    return F.struct(number.alias("id"), (is_word & ~word.rlike(QUOTED_ID)).alias("bad"))


def parse_label_ids(raw: Column) -> Column:
    """ARRAY<BIGINT> of the ids written in ``raw``; empty when nothing can be read.

    Lists in brackets are read as JSON after turning single quotes into double ones.
    Numbers are cut toward zero, booleans count as 0 and 1, quoted ids are converted and
    one that is no number empties the row; nulls, objects and nested lists are skipped. A
    bare run of digits is a single id. Everything else is empty.
    """
    trimmed = strip_white_space(raw)
    items = F.try_variant_get(
        F.try_parse_json(F.replace(trimmed, F.lit("'"), F.lit('"'))), "$", "array<variant>"
    )
    elements = F.transform(items, _element)
    ids = F.filter(F.transform(elements, lambda e: e["id"]), lambda i: i.isNotNull())
    bad = F.exists(elements, lambda e: e["bad"])
    none = F.array().cast("array<bigint>")
    is_list = trimmed.startswith("[") & trimmed.endswith("]")
    bare = F.array_compact(F.array(trimmed.try_cast("bigint")))
    return F.coalesce(
        F.when(is_list & ~bad, ids).when(~is_list & trimmed.rlike(BARE_ID), bare), none
    )
