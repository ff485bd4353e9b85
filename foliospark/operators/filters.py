"""Boolean search over evaluation answers.

A predicate tree of any size costs one aggregation: each leaf becomes a flag
per file, computed with map-side combining, and the tree is folded into one
column expression over the flags.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.scale import join_by_key, join_dimension


@dataclass(frozen=True)
class Condition:
    """A leaf: the file has (eq) or lacks (neq) an answer to an evaluation.

    An empty ``response`` means any answer.
    """

    evaluation_id: object
    response: str | None = None
    operation: str = "eq"


@dataclass(frozen=True)
class Group:
    """An inner node; an empty group filters nothing."""

    operation: str = "and"
    items: tuple[Condition | Group, ...] = field(default_factory=tuple)


def leaves(tree: Group) -> list[Condition]:
    """Distinct leaves in order of appearance."""

    def walk(node: Condition | Group) -> Iterator[Condition]:
        if isinstance(node, Condition):
            yield node
        else:
            for item in node.items:
                yield from walk(item)

    return list(dict.fromkeys(walk(tree)))


def _holds(leaf: Condition, neq_mode: str) -> Column:
    """True for an answer row that satisfies the leaf's EXISTS."""
    same = F.col("evaluation_id") == F.lit(leaf.evaluation_id)
    if not leaf.response:
        return same
    if leaf.operation == "neq" and neq_mode == "intended":
        return same & (F.col("response") != leaf.response)
    return same & (F.col("response") == leaf.response)


def leaf_flags(answers: DataFrame, tree: Group, neq_mode: str = "intended") -> DataFrame:
    """One row per file with a boolean ``leaf_i`` for every leaf."""
    found = leaves(tree)
    ids = list(dict.fromkeys(leaf.evaluation_id for leaf in found))
    flags = [
        F.max(_holds(leaf, neq_mode)).alias(f"leaf_{i}") for i, leaf in enumerate(found)
    ]
    return (
        answers.filter(F.col("evaluation_id").isin(ids)).groupBy("file_id").agg(*flags)
    )


def tree_condition(tree: Group, neq_mode: str = "intended") -> Column:
    """The tree as one column over the flags; a file without flags has none set."""
    position = {leaf: i for i, leaf in enumerate(leaves(tree))}

    def fold(node: Condition | Group) -> Column:
        if isinstance(node, Condition):
            flag = F.coalesce(F.col(f"leaf_{position[node]}"), F.lit(False))
            absent = (
                node.operation == "neq" and neq_mode == "intended" and not node.response
            )
            return ~flag if absent else flag
        parts = [fold(item) for item in node.items]
        if not parts:
            return F.lit(True)
        join = Column.__and__ if node.operation == "and" else Column.__or__
        return reduce(join, parts)

    return fold(tree)


def files_matching(
    files: DataFrame, answers: DataFrame, tree: Group | None, neq_mode: str = "intended"
) -> DataFrame:
    """Files for which the predicate tree holds.

    ``neq_mode="intended"``: an answer other than the given one exists, or,
    without a value, no answer exists. ``"reference"`` treats neq like eq.
    """
    if neq_mode not in ("intended", "reference"):
        raise ValueError(f"unknown neq_mode {neq_mode!r}")
    if tree is None or not leaves(tree):
        return files
    flags = leaf_flags(answers, tree, neq_mode).withColumnRenamed("file_id", "id")
    return (
        files.join(flags, "id", "left")
        .filter(tree_condition(tree, neq_mode))
        .select(*files.columns)
    )


def name_contains(files: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive name search; ``%`` and ``_`` stay wildcards."""
    return files.filter(F.col("name").ilike(f"%{query}%")) if query else files


def search_files(
    files: DataFrame,
    answers: DataFrame,
    evaluations: DataFrame,
    pages: DataFrame,
    project_id: object | None = None,
    search_query: str | None = None,
    tree: Group | None = None,
    neq_mode: str = "intended",
) -> DataFrame:
    """Every answer of every matching file, newest files first.

    Files without answers vanish. One file may hold a third of all answers,
    so the join on it broadcasts the matching files or is split where skewed.
    """
    if project_id is not None:
        files = files.filter(F.col("project_id") == F.lit(project_id))
    found = files_matching(name_contains(files, search_query), answers, tree, neq_mode)
    heads = found.select(
        F.col("id").alias("file_id"),
        F.col("name").alias("file_name"),
        F.col("status").alias("file_status"),
        F.col("project_id"),
        F.col("created_at").alias("file_created_at"),
    )
    rows = answers.select(
        F.col("id").alias("answer_id"), "file_id", "evaluation_id", "content_id", "response"
    )
    titles = evaluations.select(
        F.col("id").alias("evaluation_id"), "title", "evaluation_type"
    )
    numbers = pages.select("file_id", F.col("id").alias("content_id"), "content_number")
    joined = join_by_key(rows, heads, ["file_id"])
    joined = join_dimension(joined, titles, ["evaluation_id"], spread=["answer_id"])
    return joined.join(numbers, ["file_id", "content_id"]).orderBy(
        F.col("file_created_at").desc(), "file_id", "answer_id"
    )


def nest_answers(rows: DataFrame, pages_per_part: int = 100) -> DataFrame:
    """Answers nested under their file.

    A file is emitted in parts of ``pages_per_part`` pages, numbered from 0, so
    that no array outgrows a row; a page has one answer per evaluation. Files
    of up to that many pages come as a single row.
    """
    answer = F.struct(
        "content_number", "answer_id", "evaluation_id", "title", "response", "content_id"
    )
    heads = ["file_id", "file_name", "file_status", "project_id", "file_created_at"]
    part = F.floor((F.col("content_number") - 1) / pages_per_part).alias("part")
    return (
        rows.groupBy(*heads, part)
        .agg(F.sort_array(F.collect_list(answer)).alias("evaluations"))
        .orderBy(F.col("file_created_at").desc(), "file_id", "part")
    )
