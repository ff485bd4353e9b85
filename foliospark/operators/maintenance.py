"""Changes to tables, as pure transforms from the old rows to the new ones.

Plain Parquet has neither MERGE nor DELETE. A caller writes the result to a
new location, or hands the same transform to a transactional table format.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import is_blank, object_url, file_extension, stable_id, upload_mime_type
from foliospark.operators.hierarchy import evaluation_tree
from foliospark.operators.scale import first_per_key, join_by_key, join_dimension, latest_per_key

# --- fixed values: seeded rows ------------------------------------------------
DEFAULT_CATEGORY = "default"
CATEGORY_HEAD = "Category: "
DEFAULT_CATEGORY_DESCRIPTION = "Default evaluation category"
EXAMPLE_CATEGORY = ("Example", "Category: Example category")
EXAMPLE_EVALUATIONS = (
    {
        "title": "Pizza Mention Detector",
        "description": "Check if the document mentions pizza.",
        "evaluation_type": "text",
        "evaluation_options": None,
        "prompt": "Does this document mention pizza in any context? If yes, return the flavor of the pizza, otherwise return none.",
        "system_prompt": "You are a fun evaluator. Your job is to determine if the provided document snippet contains any mention of pizza, regardless of context.",
    },
    {
        "title": "Joke Finder",
        "description": "Determine if the document contains a joke or something funny.",
        "evaluation_type": "enum_choice",
        "evaluation_options": ("good", "bad", "none"),
        "prompt": "Does this document contain a joke or something intended to be funny? If yes, return the joke, otherwise return none.",
        "system_prompt": "You are a whimsical evaluator. Your job is to check if the provided document snippet contains a joke, pun, or anything meant to make someone laugh.",
    },
)
# --------------------------------------------------------------------------------


def append_new(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not in the table yet (INSERT .. NOT EXISTS)."""
    return rows.join(table.select(*keys).distinct(), list(keys), "left_anti")


def update_rows(
    table: DataFrame, changes: DataFrame, key: str = "id", stamp: Column | None = None
) -> DataFrame:
    """Overwrite the columns that ``changes`` carries.

    ``changes`` has at most one row per key. The flag column tells a value set
    to NULL from a row without change.
    """
    changed = [c for c in changes.columns if c != key]
    renamed = changes.select(
        key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in changed]
    )
    joined = join_by_key(table, renamed, [key], "left")
    touched = F.coalesce("_changed", F.lit(False))

    def current(name: str) -> Column:
        if name in changed:
            return F.when(touched, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
        if name == "updated_at" and stamp is not None:
            return F.when(touched, stamp).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[current(c) for c in table.columns])


def upsert_answers(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (evaluation, page); the latest answer wins.

    The row keeps the id and creation time it got first. Both tables have the
    same columns. Union and aggregate: versions of a key are combined in each
    task before the shuffle, and applying the same batch twice changes nothing.
    """
    keys = ["evaluation_id", "content_id"]
    both = existing.withColumn("_arrival", F.lit(0)).unionByName(
        incoming.withColumn("_arrival", F.lit(1))
    )
    latest = F.struct("_arrival", "updated_at", "id")
    earliest = F.struct("_arrival", "created_at", "id")
    kept = [c for c in existing.columns if c not in (*keys, "id", "created_at")]
    return (
        both.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*kept), latest).alias("_latest"),
            F.min_by(F.struct("id", "created_at"), earliest).alias("_first"),
        )
        .select(*keys, "_latest.*", "_first.*")
        .select(*existing.columns)
    )


def delete_by_key(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """D3: the rows that stay. ``ids`` has one column, ``id``."""
    gone = ids.select(F.col("id").alias(key)).distinct()
    few = key in ("project_id", "evaluation_id")
    join = join_dimension if few else join_by_key
    return join(table, gone, [key], "left_anti")


def delete_files(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """D3: files with their pages, chunks and answers."""
    result = dict(tables)
    result["files"] = delete_by_key(tables["files"], ids)
    for name in ("file_contents", "file_embeddings", "file_evaluations"):
        if name in tables:
            result[name] = delete_by_key(tables[name], ids, "file_id")
    return result


def evaluation_closure(evaluations: DataFrame, ids: DataFrame) -> DataFrame:
    """The given evaluations and everything below them."""
    below = evaluation_tree(evaluations).select(
        F.col("id").alias("_member"), F.explode("path").alias("id")
    )
    members = join_dimension(below, ids.select("id").distinct(), ["id"], "left_semi")
    return (
        members.select(F.col("_member").alias("id")).unionByName(ids.select("id")).distinct()
    )


def delete_evaluations(
    tables: Mapping[str, DataFrame], ids: DataFrame
) -> dict[str, DataFrame]:
    """D3: evaluations, their descendants and all answers to them."""
    closure = evaluation_closure(tables["evaluations"], ids)
    result = dict(tables)
    result["evaluations"] = delete_by_key(tables["evaluations"], closure)
    if "file_evaluations" in tables:
        result["file_evaluations"] = delete_by_key(
            tables["file_evaluations"], closure, "evaluation_id"
        )
    return result


def delete_projects(
    tables: Mapping[str, DataFrame], ids: DataFrame, cascade: bool = False
) -> dict[str, DataFrame]:
    """D3: projects with their categories and chunks.

    Files and evaluations do not go along by themselves: without ``cascade``
    a project that still has some is refused.
    """
    owned = ids.select(F.col("id").alias("project_id")).distinct()
    files = join_dimension(tables["files"], owned, ["project_id"], "left_semi", ["id"])
    evaluations = join_dimension(
        tables["evaluations"], owned, ["project_id"], "left_semi", ["id"]
    )
    result = dict(tables)
    if cascade:
        result = delete_files(result, files.select("id"))
        result = delete_evaluations(result, evaluations.select("id"))
    elif not files.isEmpty() or not evaluations.isEmpty():
        raise ValueError("the project still has files or evaluations")
    result["projects"] = delete_by_key(tables["projects"], ids)
    for name in ("evaluation_categories", "evaluation_templates", "file_embeddings"):
        if name in result:
            result[name] = delete_by_key(result[name], ids, "project_id")
    return result


def find_or_create_categories(categories: DataFrame, wanted: DataFrame) -> DataFrame:
    """One category per wanted (name, project_id), found or new.

    ``wanted`` may carry a description; a new category without one gets
    ``Category: name``. ``is_new`` marks rows to append. Ids are strings.
    """
    keys = ["name", "project_id"]
    asked = first_per_key(wanted, keys, [F.col("description").isNull(), F.col("description")])
    known = first_per_key(categories, keys, [F.col("id")])
    found = known.join(asked.select(*keys), keys, "left_semi").select(
        F.col("id").cast("string").alias("id"), *keys, "description", F.lit(False).alias("is_new")
    )
    new = append_new(categories, asked, keys).select(
        stable_id(F.col("project_id"), F.col("name")).alias("id"),
        *keys,
        F.when(
            is_blank(F.col("description")), F.concat(F.lit(CATEGORY_HEAD), F.col("name"))
        )
        .otherwise(F.col("description"))
        .alias("description"),
        F.lit(True).alias("is_new"),
    )
    return found.unionByName(new)


def ensure_default_category(categories: DataFrame, projects: DataFrame) -> DataFrame:
    """The category ``default`` of every project, found or new."""
    wanted = projects.select(
        F.lit(DEFAULT_CATEGORY).alias("name"),
        F.col("id").alias("project_id"),
        F.lit(DEFAULT_CATEGORY_DESCRIPTION).alias("description"),
    )
    return find_or_create_categories(categories, wanted)


def seed_examples(
    categories: DataFrame, evaluations: DataFrame, projects: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The example category of each project, and the example evaluations
    of those titles that the project does not have yet."""
    name, description = EXAMPLE_CATEGORY
    examples = find_or_create_categories(
        categories,
        projects.select(
            F.lit(name).alias("name"),
            F.col("id").alias("project_id"),
            F.lit(description).alias("description"),
        ),
    )
    rows = F.array(
        *[
            F.struct(
                *[
                    (
                        F.lit(None).cast("array<string>")
                        if key == "evaluation_options" and value is None
                        else F.array(*map(F.lit, value))
                        if key == "evaluation_options"
                        else F.lit(value)
                    ).alias(key)
                    for key, value in row.items()
                ]
            )
            for row in EXAMPLE_EVALUATIONS
        ]
    )
    wanted = examples.select(
        "project_id", F.col("id").alias("category_id"), F.inline(rows)
    )
    new = append_new(evaluations, wanted, ["title", "project_id"]).withColumn(
        "id", stable_id(F.col("project_id"), F.col("title"))
    )
    return examples, new


def resolve_categories(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """The category of each creation request, or the reason to refuse it.

    A request carries either ``category_id`` or ``category_name``. A name is
    found or created, an id stands as given.
    """
    no_id, no_name = is_blank(F.col("category_id").cast("string")), is_blank(F.col("category_name"))
    reason = (
        F.when(no_id & no_name, "no category given")
        .when(~no_id & ~no_name, "category given twice")
    )
    checked = requests.withColumn("reject_reason", reason)
    named = checked.filter(F.col("reject_reason").isNull() & ~no_name).select(
        F.col("category_name").alias("name"),
        "project_id",
        F.col("category_description").alias("description"),
    )
    resolved = find_or_create_categories(categories, named).select(
        F.col("name").alias("category_name"),
        "project_id",
        F.col("id").alias("_named_id"),
        "is_new",
    )
    joined = join_dimension(checked, resolved, ["category_name", "project_id"], "left")
    return joined.select(
        *requests.columns,
        "reject_reason",
        F.when(
            F.col("reject_reason").isNull(),
            F.coalesce(F.col("_named_id"), F.col("category_id").cast("string")),
        ).alias("resolved_category_id"),
        (F.col("reject_reason").isNull() & F.coalesce("is_new", F.lit(False))).alias("is_new"),
    )


def exclusive_default(templates: DataFrame) -> DataFrame:
    """Of several default templates of a category only the newest stays one."""
    newest = (
        templates.filter("default")
        .groupBy("category_id")
        .agg(F.max(F.struct("updated_at", "id")).alias("_newest"))
        .select("category_id", F.col("_newest.id").alias("_keep"))
    )
    joined = join_dimension(templates, newest, ["category_id"], "left", ["id"])
    return joined.select(
        *[
            (F.col("default") & F.col("id").eqNullSafe(F.col("_keep"))).alias("default")
            if c == "default"
            else F.col(c)
            for c in templates.columns
        ]
    )


def backfill_category(evaluations: DataFrame, categories: DataFrame) -> DataFrame:
    """Give evaluations without category the default one of their project."""
    defaults = first_per_key(
        categories.filter(F.col("name") == DEFAULT_CATEGORY), ["project_id"], [F.col("id")]
    ).select("project_id", F.col("id").alias("_default_id"))
    joined = join_dimension(evaluations, defaults, ["project_id"], "left", ["id"])
    return joined.withColumn(
        "category_id", F.coalesce("category_id", "_default_id")
    ).select(*evaluations.columns)


def backfill_chunk_status(chunks: DataFrame) -> DataFrame:
    """Chunks from before the status column count as CHUNKED."""
    return chunks.withColumn("status", F.coalesce("status", F.lit("CHUNKED")))


def register_uploads(intents: DataFrame, bucket: str) -> DataFrame:
    """Pending file rows for upload intents (id, project_id, name, size)."""
    extension = file_extension(F.col("name"))
    return intents.select(
        "id",
        "project_id",
        "name",
        "size",
        upload_mime_type(F.col("name")).alias("type"),
        object_url(
            F.lit(bucket),
            F.col("project_id").cast("string"),
            F.concat(F.col("id").cast("string"), extension),
        ).alias("url"),
        F.lit("pending").alias("status"),
    )


def latest_answers(results: DataFrame) -> DataFrame:
    """Newest row per (file, evaluation, page, response)."""
    return latest_per_key(
        results,
        ["file_id", "evaluation_id", "content_id", "response"],
        [F.col("updated_at"), F.negative("id") if _is_number(results, "id") else F.col("id")],
    )


def _is_number(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("int", "bigint")
