"""Rendering ``{{ name }}`` placeholders as one column expression."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.binding import bind


def render(template: Column, values: Mapping[str, Column]) -> Column:
    """Replace each ``{{ name }}`` by its value, in one pass over the template.

    The template is cut into placeholders and plain text and put together
    again, so text inserted for one name is never searched for another.
    Unknown names render empty, NULL values render ``None``, and one final
    line break is dropped. A NULL template gives NULL.
    """
    pairs = [
        item
        for name, value in values.items()
        for item in (F.lit(name), F.coalesce(value.cast("string"), F.lit("None")))
    ]
    lookup = F.create_map(*pairs)
    trimmed = F.regexp_replace(template, r"\n\z", "")
    pieces = F.regexp_extract_all(
        trimmed, F.lit(r"(?s)(\{\{\s*\w+\s*\}\}|[^{]+|\{)"), F.lit(1)
    )

    def filled(names: Column) -> Column:
        def fill(piece: Column) -> Column:
            name = F.regexp_extract(piece, r"^\{\{\s*(\w+)\s*\}\}$", 1)
            return F.when(
                name != "", F.coalesce(F.try_element_at(names, name), F.lit(""))
            ).otherwise(piece)

        return F.array_join(F.transform(pieces, fill), "")

    return bind(lookup, filled)
