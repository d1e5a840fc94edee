"""Queries over the chunks that the chunker makes: where they stand, search among them, stores of them and of their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import chunking, conversation, evaluation, exports, headings, lexical, retrieval, upkeep
from ..sources import tables
from ..sources.shared import written
from ..functions import text as T
from .catalogue import _QUESTIONS, _any, _bm25, _docs, _messages, _top
from .chunks_sql import MARKED, blocks, chunks
from .registry import query

_LAST = "string_split(heading_path, ' > ')[-1]"


def marked(spark, d):
    """Documents whose short lines are headings: a short first line is the title, others are sections."""
    first = F.when(F.col("text").rlike(r"\A[^\n#]{1,40}(\n|\z)"), F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    return tables.spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.regexp_replace(first, r"(?md)^([^\n#]{1,40})$", "## $1").alias("text"))


@query(f"WITH {blocks(MARKED)} SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, text, start_char, end_char, path FROM blocks")
def chunk_blocks(spark, d):
    return headings.blocks(marked(spark, d))


@query(f"WITH RECURSIVE {chunks('documents')} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, start_char, end_char, heading_path, {_LAST} AS section, text FROM chunks")
def chunk_documents(spark, d):
    return chunking.chunked(_docs(spark, d))


# Of four kinds of documents pages are ten lines each, and a second is fifteen characters.
_KINDS = "docs AS (SELECT doc_id, (['pdf', 'url', 'youtube', 'text'])[doc_id % 4 + 1] AS kind, 'doc-' || doc_id AS title, length(text) / 15.0::DOUBLE AS seconds FROM documents)"
_PLACED = f"""{chunks(MARKED)}, {_KINDS},
  sheets AS (SELECT doc_id, (i - 1) // 10 + 1 AS page, max(at_end) AS until FROM (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS at_end FROM split) JOIN docs USING (doc_id) WHERE kind = 'pdf' GROUP BY ALL),
  ends AS (SELECT doc_id, max(page) AS last FROM sheets GROUP BY doc_id),
  placed_chunks AS (SELECT c.doc_id, chunk_index, total_chunks, start_char, text, {_LAST} AS section, CASE WHEN kind = 'url' THEN coalesce(heading_path, title) ELSE heading_path END AS heading,
    CASE WHEN kind = 'pdf' THEN coalesce((SELECT min(page) FROM sheets s WHERE s.doc_id = c.doc_id AND s.until > c.start_char), last) END AS page,
    CASE WHEN kind = 'youtube' THEN round(seconds * chunk_index / total_chunks, 6) END AS ts_start, CASE WHEN kind = 'youtube' THEN round(seconds * (chunk_index + 1) / total_chunks, 6) END AS ts_end
    FROM chunks c JOIN docs USING (doc_id) LEFT JOIN ends USING (doc_id))"""


def placed(spark, d):
    """The chunks of documents of four kinds with page, time and heading: a table that is written once and read by all that follows."""
    texts = marked(spark, d)
    kind = F.element_at(F.array(*(F.lit(x) for x in ("pdf", "url", "youtube", "text"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = _docs(spark, d).select("doc_id", kind.alias("kind"), F.concat(F.lit("doc-"), "doc_id").alias("title"), (F.length("text") / 15.0).alias("seconds"))
    sizes = texts.where("doc_id % 4 = 0").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).groupBy("doc_id", (F.floor(F.col("line") / 10) + 1).alias("page")).agg((F.sum(F.length("text") + 1) - 2).alias("size"))
    return written(retrieval.dispatched(chunking.chunked(texts), docs, sizes), "chunks")


@query(f"WITH RECURSIVE {_PLACED} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, page, ts_start, ts_end, heading AS heading_path, section, start_char FROM placed_chunks")
def chunk_places(spark, d):
    return placed(spark, d).select("doc_id", "chunk_index", "page", "ts_start", "ts_end", "heading_path", "section", "start_char")


_INSIDE = f"inside AS (SELECT *, doc_id * {retrieval.CHUNK_IDS} + chunk_index AS id FROM placed_chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))"
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[-_.''][a-z0-9]+)*')"
_PASSAGE = "concat_ws(chr(10) || chr(10), nullif(concat_ws(' > ', 'doc-' || doc_id, heading), ''), text)"


def _weights(name: str, rows: str) -> str:
    """CTE with id, b and w: the vectors of rows (id, text) as the encoder makes them."""
    return f"""{name}_counts AS (SELECT id, h % {retrieval.DIMENSIONS} AS b, sum(CASE WHEN h < {retrieval.DIMENSIONS} THEN 1 ELSE -1 END) AS n FROM (SELECT id, CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) % {2 * retrieval.DIMENSIONS} AS h FROM (SELECT id, unnest({_TOKENS.format('text')}) AS t FROM ({rows}))) GROUP BY ALL),
    {name} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}_counts WHERE n <> 0)"""


_SEARCHED = "(SELECT id AS doc_id, concat_ws(' ', heading, text) AS text FROM inside)"
_FOUND = f"""{_PLACED}, {_INSIDE}, {_bm25(_SEARCHED)}, lex AS ({_top('scores', 30)}),
  {_weights('known', f"SELECT id, 'passage: ' || {_PASSAGE} AS text FROM inside")}, {_weights('asked_vectors', "SELECT query_id AS id, 'query: ' || question AS text FROM questions")},
  sims AS (SELECT q.id AS query_id, k.id AS doc_id, sum(q.w * k.w) AS score FROM asked_vectors q JOIN known k USING (b) GROUP BY ALL),
  dense AS ({_top('sims', 30)}),
  shares AS (SELECT query_id, doc_id, 1 / (60.0::DOUBLE + rank) AS s, rank AS seen FROM dense UNION ALL SELECT query_id, doc_id, 1 / (60.0::DOUBLE + rank), 1000000000 + rank FROM lex),
  fused AS (SELECT query_id, doc_id, max(s) AS best, sum(s) AS total, min(seen) AS seen FROM shares GROUP BY ALL),
  cand AS (SELECT query_id, id, best + total AS score, list_distinct({_TOKENS.format('text')}) AS t, row_number() OVER (PARTITION BY query_id ORDER BY round(best, 9) DESC, round(total, 9) DESC, seen) AS position FROM fused f JOIN inside i ON i.id = f.doc_id),
  fold AS (SELECT query_id, 0 AS step, CAST([] AS STRUCT(d BIGINT, t VARCHAR[])[]) AS kept FROM questions
    UNION ALL SELECT f.query_id, f.step + 1, CASE WHEN len(list_filter(f.kept, lambda k: len(k.t) > 0 AND len(c.t) > 0 AND len(list_intersect(k.t, c.t)) / len(list_distinct(list_concat(k.t, c.t))) >= {K.DEDUPE})) > 0 THEN f.kept ELSE list_append(f.kept, {{'d': c.id, 't': c.t}}) END
    FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.position = f.step + 1),
  kept AS (SELECT query_id, unnest(list_transform(kept, lambda k: k.d)) AS id FROM (SELECT query_id, kept, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS n FROM fold) WHERE n = 1),
  found AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY position) AS source FROM kept JOIN cand USING (query_id, id) QUALIFY source <= 5)"""


def _passage():
    return upkeep.passage(F.concat(F.lit("doc-"), "doc_id"), F.col("heading_path"), F.col("text"))


@query(f"WITH RECURSIVE {_FOUND} SELECT query_id, source, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, heading AS heading_path, page, ts_start, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS text_preview, round(score, 6) AS score FROM found JOIN inside USING (id)")
def retrieve_chunks(spark, d):
    """The whole path: chunks with their places, inside what a project holds and the caller may see, their postings and vectors, fused; with page, time and heading."""
    scope = _docs(spark, d).where("lang = 'en'").select("doc_id").join(tables.trusted(spark, d), "doc_id", "left_semi").distinct()
    inside = placed(spark, d).join(scope, "doc_id", "left_semi")
    inside = inside.withColumn("id", retrieval.chunk_id(inside))
    questions = tables.questions(spark, d).select("query_id", "question")
    vector = lambda rows, role: upkeep.encoded(rows, retrieval.hashed_features, role).select("id", "vector")
    known, asked = vector(inside.select("id", _passage().alias("text")), "passage"), vector(questions.select(F.col("query_id").alias("id"), F.col("question").alias("text")), "query")
    best = retrieval.hybrid(inside.select("id", "heading_path", "text"), known, questions, asked)
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    best = best.select("query_id", F.col("source").cast("long").alias("source"), "id", preview.alias("text_preview"), F.round("score", 6).alias("score"))
    return best.join(inside.select("id", "doc_id", "chunk_index", "heading_path", "page", "ts_start"), "id").drop("id")


@query(f"WITH RECURSIVE {chunks(MARKED)} SELECT count(*) AS chunks, max(length(text)) AS longest, round(avg(CAST(length(text) < 80 AS DOUBLE)), 6) AS tiny, round(avg(CAST(length(text) > 1024 AS DOUBLE)), 6) AS oversized, round(avg(CAST({_any('text', K.BOILERPLATE)} AS DOUBLE)), 6) AS boilerplate, round(avg(CAST({_any('text', K.EVALUATED_MARKS, 2)} AS DOUBLE)), 6) AS citation_like, round(avg(CAST(heading_path IS NOT NULL AS DOUBLE)), 6) AS with_heading, max(length(text)) FILTER (place = round_even(0.5 * (n - 1), 0)) AS p50, max(length(text)) FILTER (place = round_even(0.95 * (n - 1), 0)) AS p95 FROM (SELECT *, row_number() OVER (ORDER BY length(text)) - 1 AS place, count(*) OVER () AS n FROM chunks)")
def chunk_health(spark, d):
    return evaluation.health(chunking.chunked(marked(spark, d)).select("text", F.col("heading_path").alias("heading")))


_ASKED = "questions AS (SELECT conv_id AS query_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)"


@query(f"""WITH {_bm25().replace(_QUESTIONS, _ASKED)}, top AS ({_top('scores', 3)}), cited AS (SELECT query_id, list('doc-' || doc_id ORDER BY rank) AS citations FROM top GROUP BY query_id), ends AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
  SELECT conv_id, turn, role, text, NULL AS citations, NULL AS model, CAST(NULL AS BIGINT) AS tokens FROM conversations UNION ALL SELECT conv_id, last + 1, 'user', question, NULL, NULL, NULL FROM ends JOIN questions ON query_id = conv_id
  UNION ALL SELECT conv_id, last + 2, 'assistant', 'See ' || coalesce(array_to_string(citations, ', '), 'nothing') || '.', coalesce(array_to_string(citations, '|'), ''), 'extractive', length(question) // 4 FROM ends JOIN questions q ON q.query_id = conv_id LEFT JOIN cited c ON c.query_id = conv_id""")
def persist_cited_turn(spark, d):
    """The last question of each conversation asked again, and an answer with the documents it cites, its model and the prompt's tokens."""
    messages = _messages(spark, d)
    asked = messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    top = lexical.best(_docs(spark, d), asked.withColumnRenamed("conv_id", "query_id"), 3)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: F.concat(F.lit("doc-"), x["doc_id"]))
    turns = asked.join(top.groupBy(F.col("query_id").alias("conv_id")).agg(ordered.alias("citations")), "conv_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))
    answer = F.concat(F.lit("See "), F.coalesce(F.nullif(F.array_join("citations", ", "), F.lit("")), F.lit("nothing")), F.lit("."))
    turns = turns.select("conv_id", "question", answer.alias("answer"), F.array_join("citations", "|").alias("citations"), F.lit("extractive").alias("model"), T.prompt_tokens(F.col("question")).alias("tokens"))
    return conversation.with_turn(messages, turns)


@query(f"""WITH RECURSIVE {chunks('documents')}, counts AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id), talks AS (SELECT 'src' || conv_id % 40 AS project, conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '')[1:100] AS title, count(*) AS n FROM conversations GROUP BY ALL),
  docs AS (SELECT source AS project, doc_id, 'doc-' || doc_id AS title, lang AS kind, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'ready' ELSE 'error' END AS status FROM documents LEFT JOIN counts USING (doc_id))
  SELECT project, 0 AS part, CAST(0 AS BIGINT) AS id, '{{"name":"' || project || '"}}' AS json, '# ' || project || chr(10) || chr(10) AS markdown FROM (SELECT project FROM docs UNION SELECT project FROM talks)
  UNION ALL SELECT project, 1, doc_id, '{{"id":' || doc_id || ',"title":"' || title || '","source_type":"' || kind || '","status":"' || status || '","chunk_count":' || n || '}}', '### ' || title || chr(10) || '- Type: ' || kind || chr(10) || '- Status: ' || status || chr(10) || '- Chunks: ' || n || chr(10) || chr(10) FROM docs
  UNION ALL SELECT project, 2, conv_id, '{{"id":' || conv_id || ',"title":' || to_json(title) || ',"message_count":' || n || '}}', '### ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || '- Messages: ' || n || chr(10) || chr(10) FROM talks""")
def project_export(spark, d):
    """Every project as the rows of its JSON and Markdown files: documents with their chunks, and conversations."""
    counts = chunking.chunked(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    docs = _docs(spark, d).select(F.col("source").alias("project"), "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("title"), F.col("lang").alias("source_type")).join(counts, "doc_id", "left")
    talks = conversation.listing(_messages(spark, d)).select(F.concat(F.lit("src"), F.col("conv_id") % 40).alias("project"), "conv_id", "title", F.col("message_count").alias("messages"))
    return exports.project_rows(docs, talks)
