"""Scans, lookups and single-table filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import is_blank
from foliospark.operators.scale import first_per_key, join_by_key, join_dimension


def scan_ordered(
    df: DataFrame, order_by: str | None = None, direction: str = "asc", tie: str = "id"
) -> DataFrame:
    """All rows, optionally ordered. NULLs come last either way."""
    if order_by is None:
        return df
    key = F.col(order_by)
    first = key.desc_nulls_last() if direction == "desc" else key.asc_nulls_last()
    return df.orderBy(first, tie)


def lookup(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The row with this key; the filter reaches the scan."""
    return df.filter(F.col(column) == F.lit(key))


def lookup_many(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (possibly composite) key occurs in ``keys``."""
    return join_by_key(df, keys.distinct(), keys.columns, "left_semi")


def by_project(df: DataFrame, project_id: object, newest_first: bool = False) -> DataFrame:
    """Rows of a project in order of creation."""
    rows = df.filter(F.col("project_id") == F.lit(project_id))
    created = F.col("created_at")
    return rows.orderBy(created.desc() if newest_first else created.asc(), "id")


def owned_by(df: DataFrame, key: object, project_id: object) -> DataFrame:
    """The row with this id, only if it belongs to the project."""
    return df.filter(
        (F.col("id") == F.lit(key)) & (F.col("project_id") == F.lit(project_id))
    )


def pages_by_file(pages: DataFrame, file_id: object) -> DataFrame:
    """All pages of one file."""
    return pages.filter(F.col("file_id") == F.lit(file_id))


def page_range(
    pages: DataFrame, file_id: object, from_page: int, to_page: int | None = None
) -> DataFrame:
    """P5: pages ``from_page .. to_page`` of a file in page order.

    An absent or zero ``to_page`` leaves the range open.
    """
    if from_page < 1:
        raise ValueError("from_page starts at 1")
    number = F.col("content_number")
    rows = pages_by_file(pages, file_id).filter(number >= from_page)
    if to_page:
        rows = rows.filter(number <= to_page)
    return rows.orderBy(number)


def page_ranges(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """P5 for many requests ``(file_id, from_page, to_page)`` at once."""
    number = F.col("content_number")
    upper = F.col("to_page")
    joined = join_by_key(pages, requests, ["file_id"])
    open_end = upper.isNull() | (upper == 0)
    return joined.filter((number >= F.col("from_page")) & (open_end | (number <= upper)))


def evaluations_by_parent(
    evaluations: DataFrame,
    project_id: object,
    parent_evaluation_id: object | None = None,
    parent_evaluation_option: str | None = None,
) -> DataFrame:
    """Evaluations below (parent, option); a missing value matches only NULL."""
    return evaluations.filter(
        (F.col("project_id") == F.lit(project_id))
        & F.col("parent_evaluation_id").eqNullSafe(F.lit(parent_evaluation_id))
        & F.col("parent_evaluation_option").eqNullSafe(F.lit(parent_evaluation_option))
    )


def evaluations_for_parents(evaluations: DataFrame, parents: DataFrame) -> DataFrame:
    """P6 for many ``(project_id, parent_evaluation_id, parent_evaluation_option)``.

    NULL equals NULL here, so each nullable key is joined as the pair
    (is it missing, value or empty) and stays an ordinary equi-join.
    """
    nullable = ("parent_evaluation_id", "parent_evaluation_option")

    def keyed(df: DataFrame) -> DataFrame:
        for name in nullable:
            text = F.col(name).cast("string")
            df = df.withColumn(f"_no_{name}", text.isNull()).withColumn(
                f"_{name}", F.coalesce(text, F.lit(""))
            )
        return df

    keys = ["project_id", *[f"_{n}" for n in nullable], *[f"_no_{n}" for n in nullable]]
    wanted = keyed(parents).select(*keys).distinct()
    return join_dimension(keyed(evaluations), wanted, keys, "left_semi", ["id"]).select(
        *evaluations.columns
    )


def evaluations_by_category(
    evaluations: DataFrame, project_id: object, category_id: object
) -> DataFrame:
    """Evaluations of a category, newest first."""
    return evaluations.filter(
        (F.col("project_id") == F.lit(project_id))
        & (F.col("category_id") == F.lit(category_id))
    ).orderBy(F.col("created_at").desc(), "id")


def default_templates(templates: DataFrame, category_id: object | None = None) -> DataFrame:
    """Templates marked as default, of one category or of all."""
    rows = templates.filter(F.col("default") == F.lit(True))
    if category_id is not None:
        rows = rows.filter(F.col("category_id") == F.lit(category_id))
    return rows


def with_default_template(evaluations: DataFrame, templates: DataFrame) -> DataFrame:
    """Fill a missing ``template_id`` with the default template of the category."""
    defaults = first_per_key(
        default_templates(templates), ["category_id"], [F.col("id")]
    ).select("category_id", F.col("id").alias("default_template_id"))
    return join_dimension(
        evaluations, defaults, ["category_id"], "left", ["id"]
    ).withColumn("template_id", F.coalesce("template_id", "default_template_id"))


def category_by_name(categories: DataFrame, name: str, project_id: object) -> DataFrame:
    """The category of this exact name in a project."""
    return categories.filter(
        (F.col("name") == F.lit(name)) & (F.col("project_id") == F.lit(project_id))
    )


def search_categories(
    categories: DataFrame, evaluations: DataFrame, text: str, hide_empty_default: bool = True
) -> DataFrame:
    """Categories whose name contains ``text`` in any letter case.

    ``is_exact`` tells whether the whole name matches; ``n_evaluations`` counts
    the category's evaluations. An empty category named default is hidden.
    """
    counts = evaluations.groupBy(F.col("category_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_evaluations")
    )
    found = categories.filter(F.lower("name").contains(text.lower()))
    result = found.join(counts, "id", "left").select(
        *categories.columns,
        F.coalesce("n_evaluations", F.lit(0)).alias("n_evaluations"),
        (F.lower("name") == text.lower()).alias("is_exact"),
    )
    return result.filter(shown_when_empty()) if hide_empty_default else result


def shown_when_empty(name: str = "name", count: str = "n_evaluations") -> Column:
    """P25: everything is shown but an empty category called default."""
    return (F.lower(name) != "default") | (F.col(count) > 0)


def search_evaluations(evaluations: DataFrame, text: str) -> DataFrame:
    """Evaluations whose title, prompt, description or id contains ``text``."""
    match = F.col("id").cast("string").contains(text)
    for name in ("title", "prompt", "description"):
        match = match | F.col(name).contains(text)
    return evaluations.filter(match)


def categories_in_use(
    categories: DataFrame, evaluations: DataFrame, has_evaluations: bool | None = None
) -> DataFrame:
    """Categories with (True), without (False) or regardless of evaluations."""
    if has_evaluations is None:
        return categories
    used = evaluations.select(F.col("category_id").alias("id"), "project_id").distinct()
    how = "left_semi" if has_evaluations else "left_anti"
    return categories.join(used, ["id", "project_id"], how)


def deletable_categories(categories: DataFrame, evaluations: DataFrame) -> DataFrame:
    """A category may go once no evaluation uses it, in whatever project."""
    used = evaluations.select(F.col("category_id").alias("id")).distinct()
    return categories.join(used, "id", "left_anti")


def match_filter(results: DataFrame, choice: str = "all", content: str = "") -> DataFrame:
    """Keep matches (answer ``true``), the others, or all; and optionally
    only rows whose page contains a text, in any letter case."""
    is_match = F.col("response") == "true"
    if choice == "match":
        results = results.filter(is_match)
    elif choice != "all":
        results = results.filter(~is_match)
    if content:
        results = results.filter(F.lower("content").contains(content.lower()))
    return results


def page_label(metadata: Column, number: Column) -> Column:
    """The loader's page label, else the page number."""
    label = F.element_at(metadata, "page_label")
    return F.when(is_blank(label), number.cast("string")).otherwise(label)


def displayed_answer(evaluation_type: Column, response: Column) -> Column:
    """Boolean answers read Yes or No, all others stand as stored."""
    return F.when(
        evaluation_type == "boolean",
        F.when(response == "true", "Yes").otherwise("No"),
    ).otherwise(response)


def answer_from_display(choice: str) -> str | None:
    """P29 backwards: the stored value for a filter choice; All means no value."""
    if choice == "All":
        return None
    return {"yes": "true", "no": "false"}.get(choice.lower(), choice)


def page_of_rows(
    df: DataFrame, order: Sequence[Column], page_index: int, page_size: int = 10
) -> DataFrame:
    """One page of a table sorted by any columns; ``order`` ends in a unique one."""
    return df.orderBy(*order).offset(page_index * page_size).limit(page_size)


@dataclass(frozen=True)
class SortKey:
    """A column to sort by; NULLs come last unless ``nulls_first``."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        column = F.col(self.column)
        if self.descending:
            return column.desc_nulls_first() if self.nulls_first else column.desc_nulls_last()
        return column.asc_nulls_first() if self.nulls_first else column.asc_nulls_last()

    def equal(self, value: object) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == F.lit(value)

    def beyond(self, value: object) -> Column | None:
        """Rows that come after ``value``; None if there are none."""
        column = F.col(self.column)
        if value is None:
            return column.isNotNull() if self.nulls_first else None
        after = column < F.lit(value) if self.descending else column > F.lit(value)
        return after if self.nulls_first else after | column.isNull()


def page_after(
    df: DataFrame, keys: Sequence[SortKey], last: Sequence | None = None, page_size: int = 10
) -> DataFrame:
    """The page that follows the row whose sort values are ``last``; None: the first.

    ``keys`` end in a unique column. The position is a predicate on the sort columns
    that reaches the scan, so that a page costs the same however far it lies in the
    table: no row before it is sorted, and each task keeps one page of rows.
    """
    if last is not None:
        if len(last) != len(keys):
            raise ValueError("one value for each sort key")
        ways: list[Column] = []
        for at, key in enumerate(keys):
            beyond = key.beyond(last[at])
            if beyond is not None:
                same = [k.equal(v) for k, v in zip(keys[:at], last)]
                ways.append(reduce(and_, [*same, beyond]))
        df = df.filter(reduce(or_, ways) if ways else F.lit(False))
    return df.orderBy(*[key.order() for key in keys]).limit(page_size)
