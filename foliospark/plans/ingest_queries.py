"""Landing events, page loading, chunking, embedding, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.splitting import CHUNK_SIZE
from foliospark.functions.vectors import vector_length
from foliospark.operators import chunking, embedding
from foliospark.operators.embedding import EMBEDDING_DIMENSION
from foliospark.plans.driver_tables import DriverTables
from foliospark.plans.registry import query
from foliospark.session import scratch_path
from foliospark.sources import landing, loaders, manifests, sinks


@query(
    "decode_landing_events",
    """SELECT doc_id, message_id, 'ingestion-workflow-' || message_id AS workflow_id, record,
         delivery, bucket, key, size, etag, version_id FROM p_objects""",
)
def decode_landing_events(t: DriverTables) -> DataFrame:
    return landing.readable(landing.decode_landing_events(t.landing_messages)).select(
        "doc_id",
        "message_id",
        landing.workflow_id(F.col("message_id")).alias("workflow_id"),
        "record",
        "delivery",
        "bucket",
        "key",
        "size",
        "etag",
        "version_id",
    )


@query(
    "parse_object_key",
    """SELECT key, message_id, delivery, is_valid_key, project_id, file_name, extension
       FROM p_keys""",
)
def parse_object_key(t: DriverTables) -> DataFrame:
    objects = landing.readable(landing.decode_landing_events(t.landing_messages))
    return landing.parse_object_key(objects).select(
        "key", "message_id", "delivery", "is_valid_key", "project_id", "file_name", "extension"
    )


def checked_objects(t: DriverTables) -> DataFrame:
    objects = landing.parse_object_key(landing.decode_landing_events(t.landing_messages))
    return landing.check_objects(objects, t.projects)


@query(
    "ingest_rejects",
    """SELECT doc_id, record, delivery, key, reject_reason FROM p_checked
       WHERE reject_reason IS NOT NULL
       UNION ALL SELECT doc_id, NULL, 2, NULL, 'unreadable message' FROM documents
       WHERE doc_id % 30 = 11
       UNION ALL SELECT doc_id, NULL, 3, NULL, 'no records' FROM documents
       WHERE doc_id % 30 = 13""",
)
def ingest_rejects(t: DriverTables) -> DataFrame:
    """Refused objects, and bodies that name no object."""
    return landing.rejected(checked_objects(t)).select(
        "doc_id", "record", "delivery", "key", "reject_reason"
    )


@query(
    "register_files",
    """SELECT DISTINCT key, project_id,
         CASE WHEN record = 0 AND doc_id % 3 <> 2 THEN f.name ELSE file_name END AS name,
         o.size, CASE WHEN record = 0 AND doc_id % 3 = 0 THEN f.status
                      WHEN record = 0 AND doc_id % 3 = 1 THEN f.status
                      ELSE 'chunking' END AS status,
         record = 1 OR doc_id % 3 = 2 AS is_new
       FROM (SELECT * FROM p_checked WHERE reject_reason IS NULL) o
       JOIN (SELECT id, name, status FROM p_files) f ON f.id = o.doc_id""",
)
def register_files(t: DriverTables) -> DataFrame:
    """Two thirds of the objects carry the id of the file they were announced as."""
    announced = F.when(
        (F.col("record") == 0) & (F.col("doc_id") % 3 != 2), F.col("doc_id").cast("string")
    )
    objects = landing.accepted(checked_objects(t)).withColumn("file_id", announced)
    registered = landing.register_files(objects, t.files)
    return registered.filter(F.col("reject_reason").isNull()).select(
        F.substring_index("url", "s3://landing/", -1).alias("key"),
        "project_id",
        "name",
        "size",
        "status",
        "is_new",
    )


@query(
    "register_files_again",
    """SELECT DISTINCT key, project_id, file_name AS name, 'chunking' AS status, FALSE AS is_new
       FROM p_checked WHERE reject_reason IS NULL""",
)
def register_files_again(t: DriverTables) -> DataFrame:
    """Objects without a file id, registered once more after a first run."""
    objects = landing.accepted(checked_objects(t)).withColumn(
        "file_id", F.lit(None).cast("string")
    )
    files = t.files.select(F.col("id").cast("string").alias("id"), "name", "status")
    first = landing.register_files(objects, files).filter("is_new")
    files = files.unionByName(first.select(F.col("file_id").alias("id"), "name", "status"))
    return landing.register_files(objects, files).select(
        F.substring_index("url", "s3://landing/", -1).alias("key"),
        "project_id",
        "name",
        "status",
        "is_new",
    )


@query(
    "load_text_pages",
    r"""SELECT doc_id AS file_id, 1 AS content_number, text AS content,
         len(regexp_extract_all(text, '\r\n|[\n\r\v\f]'))
         + CASE WHEN text = '' OR regexp_matches(text, '[\n\r\v\f]$') THEN 0 ELSE 1 END
         AS total_lines FROM documents""",
)
def load_text_pages(t: DriverTables) -> DataFrame:
    """Every document as one page."""
    pages = loaders.text_pages(t.documents.select(F.col("doc_id").alias("file_id"), "text"))
    return pages.select(
        "file_id",
        "content_number",
        "content",
        F.element_at("content_metadata", "total_lines").cast("long").alias("total_lines"),
    )


@query(
    "extract_pages",
    """SELECT file_id, content_number, content,
         CASE WHEN content_number % 2 = 0 THEN 'even' ELSE 'odd' END AS kind,
         NULL::VARCHAR AS error FROM p_pages WHERE file_id % 50 <> 3
       UNION ALL SELECT doc_id, NULL, NULL, NULL, 'broken file' FROM documents
       WHERE doc_id % 50 = 3""",
)
def extract_pages(t: DriverTables) -> DataFrame:
    """The bytes of every document through a plugged-in extractor; some are broken."""

    def extractor(data: bytes) -> list[tuple[str, dict]]:
        if data.startswith(b"BROKEN"):
            raise ValueError("broken file")
        lines = [line for line in data.decode().split("\n") if line.strip(" ")]
        return [(line, {"kind": ("odd", "even")[n % 2]}) for n, line in enumerate(lines)]

    broken = F.when(F.col("doc_id") % 50 == 3, F.lit("BROKEN").cast("binary"))
    files = t.documents.select(
        F.col("doc_id").alias("file_id"),
        F.coalesce(broken, F.col("text").cast("binary")).alias("content"),
    )
    return loaders.extract_pages(files, extractor).select(
        "file_id",
        "content_number",
        "content",
        F.element_at("content_metadata", "kind").alias("kind"),
        "error",
    )


@query(
    "explode_pages",
    """SELECT file_id, project_id, content_number, page_label, content FROM p_pages""",
)
def explode_pages(t: DriverTables) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.trim(line)) > 0)
    files = t.documents.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("project_id"), "text"
    )
    numbered = loaders.explode_pages(files, lines, ["file_id", "project_id"])
    number = F.col("content_number")
    return numbered.withColumn(
        "page_label",
        F.when(number % 2 == 0, F.concat(F.lit("p"), number.cast("string"))),
    )


CHUNK_WINDOWS_SQL = r"""WITH words AS (
          SELECT file_id, id AS content_id, content_number,
            list_filter(regexp_split_to_array(content, '[ \t\n\r\f]+'), lambda x: x <> '') AS w
          FROM p_pages),
        starts AS (
          SELECT *, unnest(range(0, greatest(CAST(ceil((len(w) - 100) / 80.0) AS BIGINT), 0) + 1)) AS i
          FROM words WHERE len(w) > 0)
        SELECT file_id, content_id, i + 1 AS chunk_in_page,
          row_number() OVER (PARTITION BY file_id ORDER BY content_number, i) AS chunk_number,
          array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS content, 'CHUNKED' AS status
        FROM starts"""


@query("chunk_windows", CHUNK_WINDOWS_SQL)
def chunk_windows(t: DriverTables) -> DataFrame:
    return chunking.chunk_windows(t.pages).select(
        "file_id", "content_id", "chunk_in_page", "chunk_number", "content", "status"
    )


@query(
    "chunk_documents",
    r"""WITH words AS (
          SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'),
                                     lambda x: x <> '') AS w FROM documents),
        starts AS (
          SELECT *, unnest(range(0, greatest(CAST(ceil((len(w) - 100) / 80.0) AS BIGINT), 0) + 1)) AS i
          FROM words WHERE len(w) > 0)
        SELECT doc_id AS file_id, i + 1 AS chunk_number,
          array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS content FROM starts""",
)
def chunk_documents(t: DriverTables) -> DataFrame:
    """Windows over whole documents, each loaded as a single page."""
    pages = t.documents.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("project_id"),
        F.lit(1).alias("content_number"),
        F.create_map().cast("map<string,string>").alias("content_metadata"),
        F.col("text").alias("content"),
    )
    return chunking.chunk_windows(pages).select("file_id", "chunk_number", "content")


@query("chunk_recursive")
def chunk_recursive(t: DriverTables) -> DataFrame:
    return chunking.chunk_recursive(t.pages).select(
        "file_id", "content_id", "chunk_in_page", "chunk_number", "content", "status"
    )


# Every page's words are in its chunks and no others, the chunks are numbered through
# and none of them is too long.
COVERED_SQL = r"""SELECT id AS content_id,
      len(list_distinct(list_filter(regexp_split_to_array(content, '[ \t\n\r\f]+'),
                                    lambda x: x <> ''))) AS n_words,
      true AS dense, 0 AS too_long
    FROM p_pages"""


def _covered(chunks: DataFrame, size: Column, limit: int) -> DataFrame:
    words = F.filter(F.split("content", chunking.TOKEN_BREAK), lambda w: w != "")
    of_page = F.flatten(F.collect_list(F.array_distinct(words)))
    place = F.col("chunk_in_page")
    numbered = (F.min(place) == 1) & (F.max(place) == F.count(F.lit(1)))
    return chunks.groupBy("content_id").agg(
        F.size(F.array_distinct(of_page)).alias("n_words"),
        (numbered & (F.count_distinct(place) == F.count(F.lit(1)))).alias("dense"),
        F.count_if(size > limit).alias("too_long"),
    )


@query("chunk_recursive_covers", COVERED_SQL)
def chunk_recursive_covers(t: DriverTables) -> DataFrame:
    """What holds for the recursive chunks of every page, counted in estimated tokens."""
    tokens = F.regexp_count("content", F.lit(r"(?U)\w{1,6}|[^\w\s]"))
    return _covered(chunking.chunk_recursive(t.pages), tokens, CHUNK_SIZE)


@query("chunk_recursive_characters", COVERED_SQL)
def chunk_recursive_characters(t: DriverTables) -> DataFrame:
    """The same with a length function of the caller's: characters."""

    def characters(texts: list[str]) -> list[int]:
        return [len(text) for text in texts]

    chunks = chunking.chunk_recursive(t.pages, characters, size=300, overlap=60)
    return _covered(chunks, F.char_length("content"), 300)


@query(
    "embed_hashed",
    f"""SELECT file_id, content_id, chunk_number, {EMBEDDING_DIMENSION} AS dimension,
          1.0::DOUBLE AS norm, 'EMBEDDED' AS status FROM ({CHUNK_WINDOWS_SQL})""",
)
def embed_hashed(t: DriverTables) -> DataFrame:
    """Hashed word vectors of all chunks: their length, norm and status."""
    return embedding.embed_hashed(chunking.chunk_windows(t.pages)).select(
        "file_id",
        "content_id",
        "chunk_number",
        F.size("embedding").alias("dimension"),
        F.round(vector_length(F.col("embedding")), 4).alias("norm"),
        "status",
    )


@query(
    "embed_chunks",
    f"""SELECT file_id, content_id, chunk_number, length(content)::DOUBLE AS characters,
          (length(content) - length(replace(content, ' ', '')) + 1)::DOUBLE AS words,
          'EMBEDDED' AS status FROM ({CHUNK_WINDOWS_SQL})""",
)
def embed_chunks(t: DriverTables) -> DataFrame:
    """A plugged-in embedder of two dimensions: characters and words of a chunk."""

    def embedder(texts: list[str]) -> list[list[float]]:
        return [[float(len(text)), float(text.count(" ") + 1)] for text in texts]

    chunks = chunking.chunk_windows(t.pages)
    return embedding.embed_chunks(chunks, embedder, 2).select(
        "file_id",
        "content_id",
        "chunk_number",
        F.get("embedding", F.lit(0)).cast("double").alias("characters"),
        F.get("embedding", F.lit(1)).cast("double").alias("words"),
        "status",
    )


@query(
    "renumber_chunks",
    """SELECT id, file_id, content_number,
         row_number() OVER (PARTITION BY file_id ORDER BY content_number, chunk_number)
           AS chunk_number,
         row_number() OVER (PARTITION BY file_id, content_number ORDER BY chunk_number)
           AS chunk_in_page
       FROM p_chunks""",
)
def renumber_chunks(t: DriverTables) -> DataFrame:
    from pyspark.sql import Window

    page = Window.partitionBy("file_id", "content_number").orderBy("chunk_number")
    chunks = t.chunks.select("id", "file_id", "content_number", "chunk_number").withColumn(
        "chunk_in_page", F.row_number().over(page)
    )
    return chunking.renumber_chunks(chunks.drop("chunk_number"))


@query(
    "manifest_flatten",
    """SELECT file_id, content_id, 'c' || id AS chunk_id,
         row_number() OVER (PARTITION BY file_id ORDER BY content_number, id) AS chunk_number
       FROM p_chunks""",
)
def manifest_flatten(t: DriverTables) -> DataFrame:
    """Chunk results written as JSON lines with a manifest, read back through it
    and numbered through each file."""
    spark, root = t.spark, scratch_path(t.spark, "manifest")
    # a page has at most two chunks here
    ids = F.transform(
        F.sort_array(F.collect_list("id")), lambda i: F.concat(F.lit("c"), i.cast("string"))
    )
    results = (
        t.chunks.groupBy("project_id", "file_id", "content_id", "content_number")
        .agg(ids.alias("ids"))
        .select(
            "project_id",
            F.col("file_id").cast("string").alias("file_id"),
            F.col("content_id").cast("string").alias("file_content_id"),
            "content_number",
            F.struct(F.struct(F.col("ids").alias("chunk_ids")).alias("result")).alias(
                "chunk_document"
            ),
        )
    )
    results.write.mode("errorifexists").json(f"{root}/results")
    written = (
        spark.read.text(f"{root}/results")
        .select(
            F.concat(
                F.lit("results/"),
                F.substring_index(F.col("_metadata.file_path"), "/results/", -1),
            ).alias("Key"),
            F.col("_metadata.file_size").alias("Size"),
        )
        .distinct()
    )
    written.select(
        F.lit("bucket").alias("DestinationBucket"),
        F.struct(F.array(F.struct("Key", "Size")).alias("SUCCEEDED")).alias("ResultFiles"),
    ).write.mode("errorifexists").json(f"{root}/manifest")
    keys = manifests.read_manifest(spark, f"{root}/manifest", multi_line=False).select(
        F.substring_index("key", "results/", -1).alias("key")
    )
    # What other runs have left beside the listed files is never opened.
    spark.range(1000).select(F.lit("no JSON").alias("value")).repartition(1000).write.mode(
        "append"
    ).text(f"{root}/results")
    lines = manifests.read_listed(spark, f"{root}/results", keys)
    chunks = manifests.flatten_chunk_results(lines)
    return chunking.renumber_chunks(chunks).select(
        F.col("file_id").cast("long").alias("file_id"),
        F.col("content_id").cast("long").alias("content_id"),
        "chunk_id",
        "chunk_number",
    )


EVENTS_SQL = """SELECT DISTINCT doc_id, 'temporal-workflow.ingestion' AS source,
         CASE WHEN reject_reason IS NULL THEN 'file_ingested_successfully'
              ELSE 'file_ingestion_failed' END AS detail_type, doc_id AS file_id,
         reject_reason AS error FROM p_checked WHERE record = 0"""


def _events(t: DriverTables) -> DataFrame:
    outcomes = (
        checked_objects(t)
        .filter("record = 0")
        .select("doc_id", F.col("reject_reason").alias("error"))
        .distinct()
        .withColumn("file_id", F.col("doc_id").cast("string"))
    )
    return sinks.ingestion_events(outcomes, F.timestamp_seconds(F.lit(1_704_067_200)))


@query("emit_events", f"SELECT source, detail_type, file_id, error FROM ({EVENTS_SQL})")
def emit_events(t: DriverTables) -> DataFrame:
    return _events(t).select(
        "source",
        "detail_type",
        F.get_json_object("detail", "$.file_id").cast("long").alias("file_id"),
        F.get_json_object("detail", "$.error").alias("error"),
    )


@query(
    "route_events",
    f"SELECT file_id FROM ({EVENTS_SQL}) WHERE detail_type = 'file_ingested_successfully'",
)
def route_events(t: DriverTables) -> DataFrame:
    return sinks.route_events(_events(t)).select(F.col("file_id").cast("long").alias("file_id"))


@query(
    "append_roundtrip",
    "SELECT id, content_id, response FROM p_answers UNION ALL SELECT id, content_id, response FROM p_answers",
)
def append_roundtrip(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "append")
    rows = t.answers.select("id", "content_id", "response")
    sinks.append(rows, path)
    sinks.append(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "partitioned_results",
    "SELECT id, file_id, evaluation_id, content_id, response FROM p_answers",
)
def partitioned_results(t: DriverTables) -> DataFrame:
    path = scratch_path(t.spark, "results")
    sinks.write_partitioned_results(
        t.answers.select("id", "file_id", "evaluation_id", "content_id", "response"), path, 2
    )
    return sinks.read_partitioned_results(
        t.spark,
        path,
        "id BIGINT, file_id BIGINT, content_id BIGINT, response STRING, "
        "evaluation_id BIGINT, file_bucket INT",
    ).drop("file_bucket")
