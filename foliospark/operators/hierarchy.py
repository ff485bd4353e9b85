"""Evaluation forests and answer trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.scale import join_by_key, join_dimension
from foliospark.session import materialise


def evaluation_tree(evaluations: DataFrame) -> DataFrame:
    """H1: every evaluation with its depth, root and path of ids from the root.

    Every row knows the way up to some ancestor. A round lengthens each by the
    way of that ancestor, so that ways double, and a forest of depth d takes
    log2(d) rounds. It ends with the first round that reaches no further root:
    what is left lies below a missing parent or on a cycle and has no root.
    """
    nodes = evaluations.select(
        "id", "project_id", "title", "parent_evaluation_id", "created_at"
    )
    ways = materialise(
        nodes.select(
            "id", F.col("parent_evaluation_id").alias("above"), F.array("id").alias("path")
        ),
        "tree-ways",
    )
    while True:
        higher = ways.select(
            F.col("id").alias("above"), F.col("above").alias("_above"), F.col("path").alias("_path")
        )
        climbing = ways.filter(F.col("above").isNotNull())
        climbed = join_dimension(climbing, higher, ["above"], spread=["id"]).select(
            "id", F.col("_above").alias("above"), F.concat("_path", "path").alias("path"),
            F.lit(True).alias("moved"),
        )
        rooted = ways.filter(F.col("above").isNull()).withColumn("moved", F.lit(False))
        ways = materialise(rooted.unionByName(climbed), "tree-ways")
        reached = not ways.filter("moved AND above IS NULL").isEmpty()
        ways = ways.drop("moved")
        if not reached:
            break
    rooted = ways.filter(F.col("above").isNull()).select(
        "id",
        (F.size("path") - 1).alias("depth"),
        F.element_at("path", 1).alias("root_id"),
        "path",
    )
    return join_by_key(nodes, rooted, ["id"]).select(
        *nodes.columns, "depth", "root_id", "path"
    )


def answer_edges(answers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """(page, parent evaluation, child evaluation) where both are answered."""
    parents = evaluations.filter(F.col("parent_evaluation_id").isNotNull()).select(
        F.col("id").alias("evaluation_id"), "parent_evaluation_id"
    )
    nodes = answer_nodes(answers)
    wanted = join_dimension(nodes, parents, ["evaluation_id"], spread=["content_id"])
    present = nodes.withColumnRenamed("evaluation_id", "parent_evaluation_id")
    return wanted.join(
        present, ["content_id", "parent_evaluation_id"], "left_semi"
    ).select("content_id", "parent_evaluation_id", "evaluation_id")


def answer_nodes(answers: DataFrame) -> DataFrame:
    """Distinct (page, evaluation) nodes."""
    return answers.select("content_id", "evaluation_id").distinct()


def answer_roots(answers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Answered nodes into which no edge leads."""
    targets = answer_edges(answers, evaluations).select("content_id", "evaluation_id")
    return answer_nodes(answers).join(
        targets, ["content_id", "evaluation_id"], "left_anti"
    )


def answer_trees(answers: DataFrame, tree: DataFrame) -> DataFrame:
    """Each answered node with the root of its tree on that page.

    The root is the highest ancestor that an unbroken chain of answered
    evaluations leads to. One aggregate collects what is answered on a page, which
    is at most the questions of a project; the way up comes from the evaluation
    tree and is cut, in the row, at the first ancestor that is not among them.
    """
    pages = answers.groupBy("content_id").agg(F.collect_set("evaluation_id").alias("_answered"))
    nodes = pages.select("content_id", "_answered", F.explode("_answered").alias("evaluation_id"))
    ways = tree.select(F.col("id").alias("evaluation_id"), F.reverse("path").alias("_climb"))
    climbs = join_dimension(nodes, ways, ["evaluation_id"], spread=["content_id"])
    hits = F.transform("_climb", lambda e: F.array_contains(F.col("_answered"), e))
    gap = F.array_position(hits, False)
    steps = F.when(gap == 0, F.size("_climb")).otherwise(gap - 1).cast("int")
    return climbs.select("content_id", "evaluation_id", "_climb", steps.alias("_steps")).select(
        "content_id",
        "evaluation_id",
        F.element_at("_climb", F.col("_steps")).alias("root_evaluation_id"),
        (F.col("_steps") - 1).alias("depth"),
    )
