"""Platform tables derived from the given tables, in plain DataFrame code.

Ids are integers here, so that SQL can state the same tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import object_url
from foliospark.operators.scale import spread_small
from foliospark.session import materialise

BASE_SECONDS = 1_704_067_200  # 2024-01-01 00:00:00 UTC
EMPTY_PROJECT = "src_empty"
PAGE_FACTOR = 100_000
LANDING_BUCKET = "landing"

# Declared, so that opening a table starts no job to infer its columns.
GIVEN_SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def seconds_after_base(offset: Column) -> Column:
    return F.timestamp_seconds(F.lit(BASE_SECONDS) + offset)


def project_index(project_id: Column) -> Column:
    """The number at the end of a source name; 999 for the empty project."""
    digits = F.regexp_extract(project_id, r"(\d+)$", 1)
    return F.when(digits == "", F.lit(999)).otherwise(digits.cast("long")).cast("long")


def page_texts() -> Column:
    """The non-blank lines of a document, its pages."""
    return F.filter(F.split("text", "\n"), lambda line: F.length(F.trim(line)) > 0)


class DriverTables:
    """Lazy DataFrames over one folder of given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN_SCHEMAS[name]).parquet(
            f"{self.sf_dir}/{name}.parquet"
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def projects(self) -> DataFrame:
        """Written first: the plan of a DISTINCT over all documents has their size, and no
        table derived from it would be broadcast."""
        named = self.documents.select(F.col("source").alias("id")).distinct()
        empty = self.spark.range(1).select(F.lit(EMPTY_PROJECT).alias("id"))
        index = project_index(F.col("id"))
        return materialise(named.unionByName(empty).coalesce(1), "projects").select(
            "id",
            F.col("id").alias("name"),
            F.concat(F.lit("Documents of "), F.col("id")).alias("description"),
            seconds_after_base(index).alias("created_at"),
            seconds_after_base(index).alias("updated_at"),
        )

    @cached_property
    def files(self) -> DataFrame:
        doc = F.col("doc_id")
        digit = doc % 10
        extension = F.when(doc % 5 == 0, ".pdf").otherwise(".txt")
        status = (
            F.when(digit == 0, "failed")
            .when(digit == 1, "pending")
            .when(digit == 2, "evaluating")
            .otherwise("completed")
        )
        created = seconds_after_base(doc)
        return self.documents.select(
            doc.alias("id"),
            F.concat(F.lit("doc-"), doc.cast("string"), extension).alias("name"),
            F.when(doc % 5 == 0, "application/pdf").otherwise("text/plain").alias("type"),
            F.col("n_chars").alias("size"),
            object_url(
                F.lit(LANDING_BUCKET), F.col("source"), F.concat(doc.cast("string"), extension)
            ).alias("url"),
            status.alias("status"),
            F.lit(None).cast("string").alias("error"),
            F.col("source").alias("project_id"),
            created.alias("created_at"),
            created.alias("updated_at"),
        )

    @cached_property
    def pages(self) -> DataFrame:
        """One page per non-blank line of a document's whole text."""
        lines = page_texts()
        rows = spread_small(self.documents, "doc_id").select(
            F.col("doc_id").alias("file_id"),
            F.col("source").alias("project_id"),
            F.posexplode(lines).alias("_position", "content"),
        )
        number = (F.col("_position") + 1).cast("int")
        label = F.concat(F.lit("p"), number.cast("string"))
        metadata = F.when(
            number % 2 == 0, F.create_map(F.lit("page_label"), label)
        ).otherwise(F.create_map().cast("map<string,string>"))
        return rows.select(
            (F.col("file_id") * PAGE_FACTOR + number).alias("id"),
            "file_id",
            "project_id",
            number.alias("content_number"),
            metadata.alias("content_metadata"),
            "content",
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """Embeddings as chunks; chunk numbers skip every fourth value."""
        vec = F.col("vec_id")
        position = vec % 10 + 1
        number = position + F.floor((position - 1) / 3)
        missing = vec % 23 == 0
        rows = self.read("embeddings").select(
            vec.alias("id"),
            F.floor(vec / 10).alias("file_id"),
            number.cast("int").alias("chunk_number"),
            F.floor((position + 1) / 2).cast("int").alias("content_number"),
            F.concat(F.lit("chunk "), vec.cast("string")).alias("content"),
            F.when(~missing, F.col("embedding")).alias("embedding"),
            F.when(missing, "CHUNKED").otherwise("EMBEDDED").alias("status"),
        )
        owners = self.documents.select(
            F.col("doc_id").alias("file_id"), F.col("source").alias("project_id")
        )
        return rows.join(owners, "file_id").withColumn(
            "content_id", F.col("file_id") * PAGE_FACTOR + F.col("content_number")
        )

    @cached_property
    def search_pages(self) -> DataFrame:
        """Pages the chunks belong to."""
        return self.chunks.select(
            F.col("content_id").alias("id"), "file_id", "content_number"
        ).distinct()

    def query_vector(self) -> list[float]:
        """The embedding of vector 0."""
        row = self.read("embeddings").filter("vec_id = 0").select("embedding").head()
        return [float(x) for x in row[0]]

    @cached_property
    def categories(self) -> DataFrame:
        names = F.array(F.lit("default"), F.lit("Quality"), F.lit("Empty"))
        rows = self.projects.select(
            F.col("id").alias("project_id"), F.posexplode(names).alias("_position", "name")
        )
        ident = project_index(F.col("project_id")) * 10 + F.col("_position") + 1
        return rows.select(
            ident.alias("id"),
            "name",
            F.concat(F.lit("Category: "), F.col("name")).alias("description"),
            "project_id",
            seconds_after_base(ident).alias("created_at"),
            seconds_after_base(ident).alias("updated_at"),
        )

    @cached_property
    def templates(self) -> DataFrame:
        """Two templates per category, the first of them default."""
        rows = self.categories.select(
            F.col("id").alias("category_id"),
            "project_id",
            F.explode(F.array(F.lit(1), F.lit(2))).alias("_n"),
        )
        ident = F.col("category_id") * 10 + F.col("_n")
        first = F.col("_n") == 1
        return rows.select(
            ident.alias("id"),
            F.concat(F.lit("Template "), ident.cast("string")).alias("name"),
            F.lit("Shared prompts").alias("description"),
            "project_id",
            F.when(first, F.lit("You review pages for {{ title }}."))
            .otherwise(F.lit(None))
            .alias("system_prompt"),
            F.when(
                first, F.lit("{{ system_prompt }} Answer: {{ description }} ({{evaluation_type}})")
            )
            .otherwise(F.lit("Say it: {{ title }}{{ unknown }}"))
            .alias("prompt"),
            "category_id",
            first.alias("default"),
            seconds_after_base(ident).alias("created_at"),
            seconds_after_base(ident).alias("updated_at"),
        )

    @cached_property
    def evaluations(self) -> DataFrame:
        """Six questions per project; every project but the empty one has them."""
        none_string = F.lit(None).cast("string")
        none_array = F.lit(None).cast("array<string>")

        def question(k, title, kind, options, parent, option, category, template, prompt):
            return F.struct(
                F.lit(k).alias("k"),
                F.lit(title).alias("title"),
                F.lit(kind).alias("evaluation_type"),
                (F.array(*map(F.lit, options)) if options else none_array).alias(
                    "evaluation_options"
                ),
                F.lit(parent).cast("long").alias("parent"),
                (F.lit(option) if option else none_string).alias("parent_evaluation_option"),
                F.lit(category).alias("category"),
                F.lit(template).cast("long").alias("template"),
                F.lit(prompt).alias("prompt"),
            )

        questions = F.array(
            question(1, "quality", "boolean", None, None, None, 2, 1, ""),
            question(2, "toxic", "boolean", None, 1, "true", 2, None, "Is the page toxic?"),
            question(3, "lang", "enum_choice", ("en", "fr", "de", "es"), None, None, 1, 2, ""),
            question(4, "topic", "text", None, 3, "en", 1, None, "What is it about?"),
            question(5, "long", "boolean", None, 4, None, 1, 1, ""),
            question(6, "grade", "enum_choice", ("A", "B", "C"), 2, "false", 2, None, "Grade?"),
        )
        rows = self.projects.filter(F.col("id") != EMPTY_PROJECT).select(
            F.col("id").alias("project_id"), F.inline(questions)
        )
        index = project_index(F.col("project_id"))
        ident = index * 10 + F.col("k")
        category = index * 10 + F.col("category")
        return rows.select(
            ident.alias("id"),
            "title",
            F.concat(F.lit("About "), F.col("title")).alias("description"),
            none_string.alias("system_prompt"),
            "prompt",
            "project_id",
            "evaluation_type",
            "evaluation_options",
            (index * 10 + F.col("parent")).alias("parent_evaluation_id"),
            "parent_evaluation_option",
            category.alias("category_id"),
            (category * 10 + F.col("template")).alias("template_id"),
            seconds_after_base(ident).alias("created_at"),
            seconds_after_base(ident).alias("updated_at"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Answers on all pages from labels and languages, with later duplicates.

        The id is file * 100 + question * 10 + copy. A file's questions are
        answered on one page if its number is even, else on pages in a row.
        """
        doc, index = F.col("doc_id"), project_index(F.col("source"))
        pages = F.greatest(F.size(page_texts()), F.lit(1))
        joined = self.documents.select("doc_id", "source", "lang", pages.alias("n")).join(
            self.read("labels"), "doc_id", "left"
        )

        def answer(k: int, response: Column, given: Column) -> Column:
            return F.when(
                given,
                F.struct(F.lit(k).cast("long").alias("k"), response.alias("response")),
            )

        def flag(name: str) -> Column:
            return F.when(F.col(name) == 1, "true").otherwise("false")

        given = F.filter(
            F.array(
                answer(1, flag("quality"), F.col("quality").isNotNull()),
                answer(2, flag("toxic"), F.col("quality") == 1),
                answer(3, F.col("lang"), F.lit(True)),
            ),
            lambda a: a.isNotNull(),
        )
        copies = F.sequence(F.lit(0), F.when(doc % 7 == 0, 1).otherwise(0))
        rows = joined.select("doc_id", "n", index.alias("_index"), F.inline(given)).select(
            "*", F.explode(copies).alias("_copy")
        )
        changed = seconds_after_base(doc + F.col("_copy") * 86_400)
        return rows.select(
            (doc * 100 + F.col("k") * 10 + F.col("_copy")).alias("id"),
            doc.alias("file_id"),
            (F.col("_index") * 10 + F.col("k")).alias("evaluation_id"),
            (doc * PAGE_FACTOR + (doc + doc % 2 * F.col("k")) % F.col("n") + 1).alias("content_id"),
            "response",
            F.lit("completed").alias("status"),
            F.lit(None).cast("string").alias("error"),
            changed.alias("created_at"),
            changed.alias("updated_at"),
        )

    @cached_property
    def landing_messages(self) -> DataFrame:
        """Queue bodies: one notification per document, some delivered twice.

        Keys vary by document: some are malformed, name an unknown project or
        have an extension without loader. Every 50th event has two records. Some
        documents have one more body that cannot be read (delivery 2) or whose
        event has no records (delivery 3).
        """
        doc = F.col("doc_id")
        extension = F.when(doc % 5 == 0, ".pdf").otherwise(".txt")
        key = F.concat(F.col("source"), F.lit("/"), doc.cast("string"), extension)
        kind = doc % 40
        key = (
            F.when(kind == 7, F.concat(F.col("source"), F.lit("/sub/"), doc.cast("string")))
            .when(kind == 17, F.concat(F.lit("nowhere/"), doc.cast("string"), extension))
            .when(kind == 27, F.concat(F.col("source"), F.lit("/"), doc.cast("string"), F.lit(".PDF")))
            .when(kind == 37, doc.cast("string"))
            .otherwise(key)
        )

        def record(key: Column) -> Column:
            return F.struct(
                F.struct(
                    F.struct(
                        F.lit(LANDING_BUCKET).alias("name"), F.lit("arn:landing").alias("arn")
                    ).alias("bucket"),
                    F.struct(
                        key.alias("key"),
                        doc.cast("string").alias("sequencer"),
                        F.lit("v1").alias("versionId"),
                        F.concat(F.lit("e"), doc.cast("string")).alias("eTag"),
                        F.col("n_chars").alias("size"),
                    ).alias("object"),
                ).alias("s3")
            )

        copy = F.concat(F.col("source"), F.lit("/"), doc.cast("string"), F.lit("-copy.txt"))
        records = F.when(doc % 50 == 0, F.array(record(key), record(copy))).otherwise(
            F.array(record(key))
        )
        message = F.to_json(F.struct(records.alias("Records")))
        envelope = F.to_json(
            F.struct(
                F.lit("Notification").alias("Type"),
                F.concat(F.lit("m-"), doc.cast("string")).alias("MessageId"),
                F.lit("arn:topic").alias("TopicArn"),
                message.alias("Message"),
                F.date_format(seconds_after_base(doc), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(
                    "Timestamp"
                ),
            )
        )
        deliveries = F.sequence(F.lit(0), F.when(doc % 9 == 0, 1).otherwise(0))
        good = self.documents.select(
            doc, envelope.alias("value"), F.explode(deliveries).alias("delivery")
        )
        broken = self.documents.filter(doc % 30 == 11).select(
            doc,
            F.when(doc % 60 == 11, F.concat(F.lit("no json "), doc.cast("string")))
            .otherwise(F.lit('{"MessageId":"cut","Message":"{\\"Records\\":"}'))
            .alias("value"),
            F.lit(2).alias("delivery"),
        )
        nothing = self.documents.filter(doc % 30 == 13).select(
            doc,
            F.lit('{"MessageId":"none","Message":"{\\"Records\\":[]}"}').alias("value"),
            F.lit(3).alias("delivery"),
        )
        return good.unionByName(broken).unionByName(nothing)
