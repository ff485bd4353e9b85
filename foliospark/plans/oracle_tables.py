"""The derived platform tables once more, as SQL for the checking database.

Every name starts with ``p_`` so that it cannot meet a given table. Later
entries may use earlier ones.
"""

ORACLE_TABLES = {
    "p_projects": r"""
SELECT id, id AS name, 'Documents of ' || id AS description, idx,
       1704067200 + idx AS created_at
FROM (SELECT id, coalesce(TRY_CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT), 999) AS idx
      FROM (SELECT DISTINCT source AS id FROM documents UNION ALL SELECT 'src_empty'))""",
    "p_docs": r"""
SELECT *, coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 999) AS idx,
       CASE WHEN doc_id % 5 = 0 THEN '.pdf' ELSE '.txt' END AS ext
FROM documents""",
    "p_files": r"""
SELECT doc_id AS id, 'doc-' || doc_id || ext AS name,
       CASE WHEN doc_id % 5 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS type,
       n_chars AS size, 's3://landing/' || source || '/' || doc_id || ext AS url,
       CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'evaluating'
                        ELSE 'completed' END AS status,
       source AS project_id, 1704067200 + doc_id AS created_at
FROM p_docs""",
    "p_lines": r"""
SELECT doc_id, source,
       list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS lines
FROM documents""",
    "p_pages": r"""
SELECT doc_id * 100000 + n AS id, doc_id AS file_id, source AS project_id,
       n AS content_number, CASE WHEN n % 2 = 0 THEN 'p' || n END AS page_label,
       lines[n] AS content
FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM p_lines)""",
    "p_chunks": r"""
SELECT vec_id AS id, vec_id // 10 AS file_id, p + (p - 1) // 3 AS chunk_number,
       (p + 1) // 2 AS content_number, 'chunk ' || vec_id AS content,
       CASE WHEN vec_id % 23 <> 0 THEN CAST(embedding AS DOUBLE[]) END AS embedding,
       CASE WHEN vec_id % 23 = 0 THEN 'CHUNKED' ELSE 'EMBEDDED' END AS status,
       d.source AS project_id, (vec_id // 10) * 100000 + (p + 1) // 2 AS content_id
FROM (SELECT *, vec_id % 10 + 1 AS p FROM embeddings)
JOIN documents d ON d.doc_id = vec_id // 10""",
    "p_search_pages": r"""
SELECT DISTINCT content_id AS id, file_id, content_number FROM p_chunks""",
    "p_scored": r"""
SELECT c.id AS chunk_id, file_id, content_id, project_id, chunk_number,
       list_cosine_similarity(c.embedding, q.v) AS score
FROM p_chunks c,
     (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) q
WHERE c.embedding IS NOT NULL""",
    "p_categories": r"""
SELECT idx * 10 + n AS id, name, 'Category: ' || name AS description,
       project_id, 1704067200 + idx * 10 + n AS created_at
FROM (SELECT id AS project_id, idx FROM p_projects),
     (VALUES (1, 'default'), (2, 'Quality'), (3, 'Empty')) v(n, name)""",
    "p_templates": r"""
SELECT c.id * 10 + n AS id, c.id AS category_id, project_id, n = 1 AS is_default,
       CASE WHEN n = 1 THEN 'You review pages for {{ title }}.' END AS system_prompt,
       1704067200 + c.id * 10 + n AS created_at
FROM p_categories c, (VALUES (1), (2)) v(n)""",
    "p_evaluations": r"""
SELECT idx * 10 + k AS id, title, 'About ' || title AS description, prompt, project_id,
       evaluation_type, evaluation_options, idx * 10 + parent AS parent_evaluation_id,
       parent_evaluation_option, idx * 10 + category AS category_id,
       (idx * 10 + category) * 10 + template AS template_id,
       1704067200 + idx * 10 + k AS created_at
FROM (SELECT id AS project_id, idx FROM p_projects WHERE id <> 'src_empty'),
     (VALUES
       (1, 'quality', 'boolean', NULL, NULL, NULL, 2, 1, ''),
       (2, 'toxic', 'boolean', NULL, 1, 'true', 2, NULL, 'Is the page toxic?'),
       (3, 'lang', 'enum_choice', ['en', 'fr', 'de', 'es'], NULL, NULL, 1, 2, ''),
       (4, 'topic', 'text', NULL, 3, 'en', 1, NULL, 'What is it about?'),
       (5, 'long', 'boolean', NULL, 4, NULL, 1, 1, ''),
       (6, 'grade', 'enum_choice', ['A', 'B', 'C'], 2, 'false', 2, NULL, 'Grade?')
     ) v(k, title, evaluation_type, evaluation_options, parent,
         parent_evaluation_option, category, template, prompt)""",
    "p_answers": r"""
SELECT doc_id * 100 + k * 10 + copy AS id, doc_id AS file_id, idx * 10 + k AS evaluation_id,
       doc_id * 100000 + (doc_id + doc_id % 2 * k) % n_pages + 1 AS content_id,
       response, 'completed' AS status,
       1704067200 + doc_id + copy * 86400 AS updated_at
FROM (
  SELECT doc_id, idx, 1 AS k, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS response
  FROM p_docs JOIN labels USING (doc_id) WHERE quality IS NOT NULL
  UNION ALL
  SELECT doc_id, idx, 2, CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END
  FROM p_docs JOIN labels USING (doc_id) WHERE quality = 1
  UNION ALL
  SELECT doc_id, idx, 3, lang FROM p_docs
) JOIN (SELECT doc_id, greatest(len(lines), 1) AS n_pages FROM p_lines) USING (doc_id),
  (VALUES (0), (1)) v(copy)
WHERE copy = 0 OR doc_id % 7 = 0""",
    "p_objects": r"""
SELECT doc_id, 'm-' || doc_id AS message_id, record, delivery, 'landing' AS bucket,
       CASE WHEN record = 1 THEN source || '/' || doc_id || '-copy.txt'
            WHEN doc_id % 40 = 7 THEN source || '/sub/' || doc_id
            WHEN doc_id % 40 = 17 THEN 'nowhere/' || doc_id || ext
            WHEN doc_id % 40 = 27 THEN source || '/' || doc_id || '.PDF'
            WHEN doc_id % 40 = 37 THEN CAST(doc_id AS VARCHAR)
            ELSE source || '/' || doc_id || ext END AS key,
       n_chars AS size, 'e' || doc_id AS etag, 'v1' AS version_id
FROM p_docs, (VALUES (0), (1)) r(record), (VALUES (0), (1)) d(delivery)
WHERE (record = 0 OR doc_id % 50 = 0) AND (delivery = 0 OR doc_id % 9 = 0)""",
    "p_keys": r"""
SELECT *, len(string_split(key, '/')) = 2 AS is_valid_key,
       CASE WHEN len(string_split(key, '/')) = 2 THEN split_part(key, '/', 1) END AS project_id,
       CASE WHEN len(string_split(key, '/')) = 2 THEN split_part(key, '/', 2) END AS file_name,
       CASE WHEN len(string_split(key, '/')) = 2
            THEN regexp_extract(split_part(key, '/', 2), '\.[^.]*$') END AS extension
FROM p_objects""",
    "p_checked": r"""
SELECT k.*, CASE WHEN NOT is_valid_key THEN 'malformed key'
                 WHEN p.id IS NULL THEN 'unknown project'
                 WHEN extension NOT IN ('.pdf', '.txt') THEN 'unsupported extension'
            END AS reject_reason
FROM p_keys k LEFT JOIN p_projects p ON p.id = k.project_id""",
    "p_latest": r"""
SELECT * FROM p_answers
QUALIFY row_number() OVER (PARTITION BY file_id, evaluation_id, content_id, response
                           ORDER BY updated_at DESC, id) = 1""",
    "p_detail": r"""
SELECT a.id AS answer_id, a.file_id, f.name AS file_name, f.project_id, a.evaluation_id,
       e.title, e.evaluation_type, e.category_id, a.content_id, p.content_number,
       p.page_label, p.content, a.response, a.updated_at
FROM p_answers a JOIN p_files f ON f.id = a.file_id
JOIN p_evaluations e ON e.id = a.evaluation_id JOIN p_pages p ON p.id = a.content_id""",
    "p_stub": r"""
SELECT p.project_id, p.file_id, p.id AS content_id, e.id AS evaluation_id,
       e.parent_evaluation_id, e.parent_evaluation_option, e.evaluation_type,
       e.evaluation_options,
       CASE e.evaluation_type
         WHEN 'boolean' THEN CASE WHEN (length(p.content) + e.id) % 2 = 0
                                  THEN 'true' ELSE 'false' END
         WHEN 'enum_choice' THEN e.evaluation_options[
              1 + (length(p.content) + e.id) % len(e.evaluation_options)]
         ELSE regexp_extract(p.content, '[^ \t\n\r\f]+') END AS response
FROM p_pages p JOIN p_evaluations e USING (project_id)""",
}
