"""Queries of whole workflows: ingest, upkeep of stored tables, prompts, replies, scripts, exports and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import chunking, conversation, digest, evaluation, lexical, monitoring, sequences, upkeep
from ..sources import tables
from .catalogue import _HITS, _LINES, _MEANS, _PER_QUERY, _SHORT, _TOPICS, _any, _bm25, _docs, _judged, _messages, _top
from .registry import query

_CHUNKS = f"{_LINES}, heads AS (SELECT doc_id, CASE WHEN length(string_split(text, chr(10))[1]) BETWEEN 1 AND 40 THEN string_split(text, chr(10))[1] END AS head FROM documents), chunks AS (SELECT doc_id, line, text, CASE WHEN line > 0 THEN head END AS heading FROM blocks JOIN heads USING (doc_id))"
_HEADINGS = "headings AS (SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS position FROM (SELECT doc_id, trim(string_split(text, '/')[-1]) AS topic, min(line) AS first_line FROM blocks WHERE length(trim(text)) BETWEEN 1 AND 40 GROUP BY ALL) WHERE topic <> '')"
_FIRST_SENTENCES = "list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[.!?]$') AND len(string_split(s, ' ')) >= 3)[1:4]"


def _lines(spark, d, start=False):
    return sequences.lines(tables.spread(_docs(spark, d).select("doc_id", "text")), start=start)


def _chunks(spark, d):
    return tables.with_heading(sequences.lines(tables.spread(_docs(spark, d).select("doc_id", "text")), head=True, start=False))


def _headings(spark, d):
    return tables.headings(_lines(spark, d))


# --- ingest ---


@query("""SELECT video, doc_id AS track, lang, doc_id % 3 = 0 AS is_generated FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN lang = 'en' THEN CAST(doc_id % 3 = 0 AS INT) ELSE 2 END, CASE WHEN lang = 'en' THEN 1 ELSE 5 END, doc_id) AS n FROM (SELECT *, source || '-' || doc_id % 7 AS video FROM documents)) WHERE n = 1""")
def transcript_choice(spark, d):
    """Documents as caption tracks."""
    tracks = _docs(spark, d).select(F.concat("source", F.lit("-"), F.col("doc_id") % 7).alias("video"), "lang", (F.col("doc_id") % 3 == 0).alias("is_generated"), F.col("doc_id").alias("track"))
    return upkeep.transcript_choice(tracks)


_VIDEO = "CASE page_id % 3 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=1' WHEN 1 THEN 'https://youtu.be/' || substr(md5(url), 1, 11) ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'v=short' END"


@query(f"SELECT page_id, coalesce(nullif(regexp_extract(u, '(?:v=|/)([0-9A-Za-z_-]{{11}})(?:[?&/#]|$)', 1), ''), nullif(regexp_extract(u, 'youtu\\.be/([0-9A-Za-z_-]{{11}})', 1), ''), nullif(regexp_extract(u, '[?&]v=([^&#]*)', 1), '')) AS video_id, 'YouTube Video ' || video_id AS title, '' AS channel, 0 AS duration, 0 AS views, 0 AS likes FROM (SELECT page_id, {_VIDEO} AS u FROM pages)")
def video_info(spark, d):
    """Id of a video's address and a placeholder for what only its provider knows."""
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(F.md5("url"), 1, 11), F.lit("&t=1")))
    url = url.when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/"), F.substring(F.md5("url"), 1, 11))).otherwise(F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("v=short")))
    rows = tables.table(spark, d, "pages").select("page_id", T.video_id(url).alias("video_id"))
    zero = F.lit(0)
    return rows.select("page_id", "video_id", F.concat(F.lit("YouTube Video "), "video_id").alias("title"), F.lit("").alias("channel"), zero.alias("duration"), zero.alias("views"), zero.alias("likes"))


@query("SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn) AS text, count(*) AS segments, round(max(turn * 7.5::DOUBLE + length(text) / 16.0::DOUBLE), 6) AS duration FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def transcript_assembly(spark, d):
    return upkeep.transcript(tables.segments(spark, d), "conv_id")


_PACK = 300


@query(f"""WITH RECURSIVE seg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, text FROM conversations),
  fold AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS part FROM (SELECT DISTINCT conv_id FROM seg)
    UNION ALL SELECT f.conv_id, s.i, CASE WHEN f.n + length(s.text) > {_PACK} AND f.n > 0 THEN 0 ELSE f.n END + length(s.text) + 1, CASE WHEN f.n + length(s.text) > {_PACK} AND f.n > 0 THEN f.part + 1 ELSE f.part END FROM fold f JOIN seg s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
  SELECT conv_id, part, string_agg(text, ' ' ORDER BY seg.i) AS text, min(turn * 7.5::DOUBLE) AS start, max(turn * 7.5::DOUBLE + length(text) / 16.0::DOUBLE) AS "end" FROM fold JOIN seg USING (conv_id, i) GROUP BY conv_id, part""")
def segment_packing(spark, d):
    packed = sequences.packed(tables.segments(spark, d), "conv_id", "at", _PACK)
    return packed.select("conv_id", F.col("part").cast("long").alias("part"), "text", "start", "end")


@query(f"""WITH {_CHUNKS}, docs AS (SELECT doc_id, (['pdf', 'url', 'youtube', 'text'])[doc_id % 4 + 1] AS kind, len(string_split(text, chr(10))) AS of FROM documents)
  SELECT doc_id, line, CASE WHEN kind = 'pdf' THEN 1 + line * 3 // of END AS page, CASE WHEN kind = 'url' THEN coalesce(heading, 'doc-' || doc_id) ELSE heading END AS heading_path, heading AS section,
    CASE WHEN kind = 'youtube' THEN round(line * 600.0::DOUBLE / of, 6) END AS ts_start, CASE WHEN kind = 'youtube' THEN round((line + 1) * 600.0::DOUBLE / of, 6) END AS ts_end
  FROM chunks JOIN docs USING (doc_id) WHERE text <> ''""")
def source_dispatch(spark, d):
    """Lines as chunks, by the kind of their document."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("pdf", "url", "youtube", "text"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = tables.documents(spark, d).select("doc_id", kind.alias("kind"), "title", F.lit(3).alias("pages"), F.lit(600.0).alias("seconds"))
    return upkeep.dispatched(docs, _chunks(spark, d)).withColumn("line", F.col("line").cast("long"))


_NO_END = "(^|[^\\p{L}\\p{N}_])(" + "|".join(K.ABBREVIATIONS) + "|[A-Z])\\."
_GUARDED = f"regexp_replace(regexp_replace(text, '{_NO_END}', '\\1\\2' || chr(1), 'g'), '{_NO_END}', '\\1\\2' || chr(1), 'g')"  # twice, as a mark ends one and begins the next


@query(f"SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_GUARDED}, '([.!?])(\\s|$)', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'), ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '') AS sentences FROM documents")
def sentence_split(spark, d):
    return tables.spread(_docs(spark, d)).select("doc_id", T.sentences(F.col("text")).alias("sentences"))


@query("""WITH RECURSIVE cut AS (SELECT doc_id, 0 AS k, NULL::VARCHAR AS part, text AS rest FROM documents
    UNION ALL SELECT doc_id, k + 1, CASE WHEN length(rest) <= 512 THEN rest ELSE trim(rest[1:stop], w) END, CASE WHEN length(rest) <= 512 THEN NULL ELSE trim(rest[stop + 1:], w) END
    FROM (SELECT *, ' ' || chr(9) || chr(10) || chr(13) AS w, CASE WHEN found < 256 THEN 512 ELSE found END AS stop FROM (SELECT *, greatest(CASE WHEN contains(rest[1:512], ' ') THEN 512 - strpos(reverse(rest[1:512]), ' ') ELSE -1 END, CASE WHEN contains(rest[1:512], ',') THEN 512 - strpos(reverse(rest[1:512]), ',') ELSE -1 END, CASE WHEN contains(rest[1:512], '，') THEN 512 - strpos(reverse(rest[1:512]), '，') ELSE -1 END) AS found FROM cut WHERE rest IS NOT NULL)))
  SELECT doc_id, CAST(count(*) AS BIGINT) AS parts, md5(string_agg(part, '|' ORDER BY k)) AS text FROM cut WHERE part <> '' GROUP BY doc_id""")
def hard_split(spark, d):
    """Whole texts in parts of at most 512 characters."""
    parts = chunking.split_hard(tables.spread(_docs(spark, d).select("doc_id", "text")), K.CHUNK_SIZE)
    return parts.select("doc_id", F.size("parts").cast("long").alias("parts"), F.md5(F.array_join("parts", "|")).alias("text")).where("parts > 0")


@query(f"WITH {_LINES}, joined AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS joined FROM blocks GROUP BY doc_id) SELECT doc_id, trim(coalesce(CASE WHEN doc_id % 5 > 0 THEN nullif(text, '') END, joined), ' ' || chr(9) || chr(10) || chr(13))[1:1200] AS excerpt FROM documents JOIN joined USING (doc_id)")
def excerpt_of_chunks(spark, d):
    """A document's text, or where it has none (every fifth here) its chunks joined, cut to an excerpt."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    joined = _lines(spark, d).groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("joined"))
    content = F.when(F.col("doc_id") % 5 > 0, F.nullif("text", F.lit("")))
    text = F.regexp_replace(F.coalesce(content, F.col("joined")), r"^\s+|\s+$", "")
    return _docs(spark, d).join(joined, "doc_id").select("doc_id", F.substring(text, 1, K.EXCERPT).alias("excerpt"))


@query("SELECT doc_id, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS squashed FROM documents")
def squash_texts(spark, d):
    return tables.spread(_docs(spark, d)).select("doc_id", F.md5(T.squashed(F.col("text"))).alias("squashed"))


@query("""WITH named AS (SELECT page_id, 'page-' || page_id % 40 || CASE WHEN page_id % 5 = 0 THEN '.txt' ELSE '.PDF' END AS name, length(html) AS size FROM pages)
  SELECT page_id, CASE WHEN NOT ends_with(lower(name), '.pdf') THEN name || ' is not a supported PDF file' WHEN size > 0.001::DOUBLE * 1024 * 1024 THEN name || ' exceeds 0.001MB limit' WHEN row_number() OVER (PARTITION BY name ORDER BY page_id) > 1 THEN name || ' already added' END AS error FROM named""")
def upload_validation(spark, d):
    rows = tables.table(spark, d, "pages").select("page_id", F.concat(F.lit("page-"), F.col("page_id") % 40, F.when(F.col("page_id") % 5 == 0, ".txt").otherwise(".PDF")).alias("name"), F.length("html").alias("size"))
    first = rows.groupBy("name").agg(F.min("page_id").alias("first"))
    return rows.join(first, "name").select("page_id", upkeep.upload_error(F.col("name"), F.col("size"), F.col("page_id") > F.col("first"), 0.001).alias("error"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.0::DOUBLE END AS progress FROM documents")
def ingest_progress(spark, d):
    """Documents in each of the states, one of them unknown."""
    state = F.element_at(F.array(*(F.lit(x) for x in ("queued", "processing", "ready", "error", "gone"))), (F.col("doc_id") % 5 + 1).cast("int"))
    s = F.col("state")
    return _docs(spark, d).select("doc_id", state.alias("state")).select("doc_id", F.when(s == "queued", 0.0).when(s == "processing", 0.5).when(s == "ready", 1.0).when(s == "error", 0.0).alias("progress"))


# --- stored tables ---


@query(f"WITH {_LINES} SELECT doc_id, line, md5(text) AS text FROM blocks WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 0, md5(text || '!') FROM documents WHERE doc_id % 3 = 0")
def chunk_replace(spark, d):
    """The chunks of every third document are rebuilt (as one of its whole text); the others stay."""
    old = _lines(spark, d).select("doc_id", F.col("line").cast("long").alias("line"), F.md5("text").alias("text"))
    new = _docs(spark, d).where("doc_id % 3 = 0").select("doc_id", F.lit(0).cast("long").alias("line"), F.md5(F.concat("text", F.lit("!"))).alias("text"))
    return upkeep.replaced(old, new)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_document(spark, d):
    return upkeep.deleted(_docs(spark, d).select("doc_id", "lang"), tables.table(spark, d, "labels").where("toxic = 1"))


@query("SELECT event_type AS endpoint, user_id, value FROM events UNION ALL SELECT event_type || ' again', user_id, round(value * 2, 6) FROM events WHERE event_id % 10 = 0")
def metric_append(spark, d):
    old = tables.table(spark, d, "events").select(F.col("event_type").alias("endpoint"), "user_id", "value")
    new = tables.table(spark, d, "events").where("event_id % 10 = 0").select(F.concat("event_type", F.lit(" again")).alias("endpoint"), "user_id", F.round(F.col("value") * 2, 6).alias("value"))
    return upkeep.appended(old, new)


_PASSAGE = "CASE WHEN heading IS NULL THEN 'doc-' || doc_id ELSE 'doc-' || doc_id || ' > ' || heading END || chr(10) || chr(10) || text"
_COUNTED = "[" + ", ".join(f"(length(p) - length(replace(p, '{c}', '')))::DOUBLE" for c in "aeinrst") + "]"


def _passages(spark, d):
    text = upkeep.passage(F.concat(F.lit("doc-"), "doc_id"), F.col("heading"), F.col("text"))
    return _chunks(spark, d).where("text <> ''").select(F.concat("doc_id", F.lit("-"), "line").alias("id"), text.alias("text"))


@query(f"WITH {_CHUNKS} SELECT doc_id || '-' || line AS id, md5({_PASSAGE}) AS passage FROM chunks WHERE text <> ''")
def passage_texts(spark, d):
    return _passages(spark, d).select("id", F.md5("text").alias("passage"))


@query(f"""WITH {_CHUNKS}, p AS (SELECT doc_id || '-' || line AS id, 'passage: ' || {_PASSAGE} AS p FROM chunks WHERE text <> ''), raw AS (SELECT id, sha256(p || 'True') AS key, {_COUNTED} AS v FROM p), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM raw)
  SELECT id, key, list_transform(v, lambda x: round(CASE WHEN norm = 0 THEN x ELSE x / norm END, 6)) AS vector FROM n""")
def encode_passages(spark, d):
    """All passages, each text once; a model's UDF would stand in the place of letter counts."""
    made = upkeep.encoded(_passages(spark, d), upkeep.letter_counts("aeinrst"))
    return made.select("id", "key", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'known' END AS model FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def embedding_append(spark, d):
    """Known embeddings (labels stand for them) and those of documents that had none."""
    known = _docs(spark, d).select("doc_id").join(tables.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("model", F.lit("known"))
    new = _docs(spark, d).select("doc_id").join(known, "doc_id", "left_anti").withColumn("model", F.lit("new"))
    return upkeep.appended(known, new)


@query(f"WITH {_CHUNKS} SELECT status, count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks FROM (SELECT d.doc_id, count(c.line) AS n, CASE WHEN count(c.line) = 0 THEN 'error' ELSE 'ready' END AS status FROM documents d LEFT JOIN (SELECT * FROM chunks WHERE length(text) >= 80) c USING (doc_id) GROUP BY d.doc_id) GROUP BY status")
def reindex_outcomes(spark, d):
    """Documents by what a rebuilt index would say of them: without a chunk of 80 characters they are in error."""
    made = _lines(spark, d).where(F.length("text") >= K.LEAST_CHUNK).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _docs(spark, d).select("doc_id").join(made, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy(F.when(F.col("n") == 0, "error").otherwise("ready").alias("status")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"))


@query(f"WITH {_CHUNKS} SELECT doc_id % 10 AS part, count(*) AS chunks, count(heading) AS with_heading, max(length(text)) AS longest FROM chunks GROUP BY part")
def heading_stats(spark, d):
    n = F.length("text")
    return _chunks(spark, d).groupBy((F.col("doc_id") % 10).alias("part")).agg(F.count(F.lit(1)).alias("chunks"), F.count("heading").alias("with_heading"), F.max(n).cast("long").alias("longest"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, CASE WHEN hits + misses > 0 THEN printf('%.1f%%', 100.0::DOUBLE * hits / (hits + misses)) ELSE 'N/A' END AS hit_rate FROM events GROUP BY user_id")
def cache_hit_rate(spark, d):
    """Views as a cache's hits, clicks as its misses."""
    rows = tables.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return rows.withColumn("hit_rate", monitoring.hit_rate(F.col("hits"), F.col("misses")))


# --- pages, searches and scopes ---


@query(f"WITH {_LINES} SELECT doc_id, line, text FROM blocks WHERE text ILIKE '%THE%' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY doc_id, line LIMIT 25")
def keyword_search(spark, d):
    found = lexical.keyword_search(_lines(spark, d).select("doc_id", "line", "text"), "THE", 25, tables.trusted(spark, d))
    return found.withColumn("line", F.col("line").cast("long"))


@query("SELECT doc_id, 'doc-' || doc_id AS title FROM documents WHERE contains(lower('doc-' || doc_id), lower('C-1'))")
def title_filter(spark, d):
    return tables.documents(spark, d).where(F.contains(F.lower("title"), F.lit("C-1".lower()))).select("doc_id", "title")


@query("SELECT doc_id, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 20 OFFSET 20")
def page_with_total(spark, d):
    """The second page, with the number of rows on all pages."""
    rows = _docs(spark, d).where("lang = 'en'").select("doc_id")
    return rows.orderBy(F.desc("doc_id")).offset(20).limit(20).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row


@query("WITH bridge AS (SELECT source AS project, doc_id, doc_id % 13 AS added_at FROM documents UNION ALL SELECT lang, doc_id, doc_id % 17 FROM documents) SELECT d.doc_id, title, row_number() OVER (ORDER BY added_at, title) AS position FROM (SELECT doc_id, 'doc-' || doc_id AS title FROM documents) d JOIN bridge USING (doc_id) WHERE project = 'de'")
def project_documents_stable(spark, d):
    """A project's documents by the time they were added and their title; a document may be in several projects."""
    docs = _docs(spark, d)
    bridge = docs.select(F.col("source").alias("project"), "doc_id", (F.col("doc_id") % 13).alias("added_at")).unionByName(docs.select(F.col("lang").alias("project"), "doc_id", (F.col("doc_id") % 17).alias("added_at")))
    rows = tables.documents(spark, d).select("doc_id", "title").join(bridge.where("project = 'de'").select("doc_id", "added_at"), "doc_id")
    return sequences.numbered(rows.withColumn("all", F.lit(0)), "all", "added_at", "title").select("doc_id", "title", F.col("number").cast("long").alias("position"))


@query(f"WITH {_LINES}, placed AS (SELECT doc_id, line, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, text FROM blocks) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, start, md5(text) AS text FROM placed")
def chunks_in_order(spark, d):
    """The chunks of documents, in the order in which they stand."""
    rows = _lines(spark, d, start=True).orderBy("doc_id", "start")
    return rows.select("doc_id", F.col("line").cast("long").alias("chunk_index"), F.col("of").cast("long").alias("total_chunks"), "start", F.md5("text").alias("text"))


_INSIDE = "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))"


@query(f"WITH {_bm25(_INSIDE)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({_top('scores', 5)})")
def bm25_project_scope(spark, d):
    """Inside what a project holds and the caller may see."""
    scope = lexical.scoped(_docs(spark, d).where("lang = 'en'").select("doc_id"), tables.trusted(spark, d))
    hits = lexical.best(_docs(spark, d), tables.questions(spark, d), K.TOP_K, scope)
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_PASSAGES = f"(WITH {_CHUNKS} SELECT doc_id * 1000000 + line AS doc_id, concat_ws(' ', heading, text) AS text FROM chunks)"


@query(f"WITH {_bm25(_PASSAGES)} SELECT query_id, doc_id AS chunk_id, rank, round(score, 6) AS score FROM ({_top('scores', 30)})")
def passage_candidates(spark, d):
    """BM25 over chunks with the heading that they stand under."""
    chunks = _chunks(spark, d).select((F.col("doc_id") * 1_000_000 + F.col("line")).alias("doc_id"), F.concat_ws(" ", "heading", "text").alias("text"))
    best = lexical.best(chunks, tables.questions(spark, d), K.CANDIDATES)
    return best.select("query_id", F.col("doc_id").alias("chunk_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# --- prompts and turns ---

_HEAD = "'[Source ' || rank || ': doc-' || doc_id || CASE WHEN doc_id % 4 <> 0 THEN ', Page ' || doc_id % 4 ELSE '' END || CASE WHEN doc_id % 3 <> 0 THEN ', ' || printf('%.1f', (doc_id % 3) * 12.34) || 's' ELSE '' END || CASE WHEN head IS NOT NULL AND head <> 'doc-' || doc_id THEN ', ' || head ELSE '' END || ']'"
_HEADS = "heads AS (SELECT doc_id, CASE WHEN length(string_split(text, chr(10))[1]) BETWEEN 1 AND 40 THEN string_split(text, chr(10))[1] END AS head FROM documents)"


def _entries(spark, d):
    top = lexical.best(_docs(spark, d), tables.questions(spark, d), K.TOP_K)
    first = F.split("text", "\n")[0]
    rows = top.select("query_id", "doc_id", "rank").join(tables.documents(spark, d), "doc_id").withColumn("heading", F.when(F.length(first).between(1, 40), first))
    head = upkeep.source_head(F.col("rank"), F.col("title"), F.col("doc_id") % 4, (F.col("doc_id") % 3) * F.lit(12.34), F.coalesce("heading", F.lit("")))
    return rows.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), head.alias("head"), "text")


@query(f"WITH {_bm25()}, {_HEADS} SELECT query_id, doc_id, rank, {_HEAD} AS head FROM ({_top('scores', 5)}) JOIN heads USING (doc_id)")
def context_entries(spark, d):
    """The heads of a context's entries, with page, time and heading."""
    return _entries(spark, d).drop("text")


@query(f"""WITH {_bm25()}, {_HEADS}, entries AS (SELECT query_id, rank, {_HEAD} || chr(10) || text AS entry FROM ({_top('scores', 5)}) JOIN heads USING (doc_id) JOIN documents USING (doc_id)),
  used AS (SELECT *, sum(length(entry) + 2) OVER (PARTITION BY query_id ORDER BY rank) - 2 AS used FROM entries),
  context AS (SELECT query_id, string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS context FROM used WHERE used <= {K.CONTEXT_CHARS} OR rank = 1 GROUP BY query_id)
  SELECT query_id, '{K.ANSWER_RULES}' || CASE WHEN query_id % 2 = 0 THEN '{K.CITING_RULES}' ELSE '' END AS rules, md5('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question) AS prompt FROM context JOIN questions USING (query_id)""")
def prompt_assembly(spark, d):
    """What a model would be asked: rules, with the wish for citations for every second question, and the context within its budget."""
    entry = F.concat("head", F.lit("\n"), "text")
    kept = sequences.budget_prefix(_entries(spark, d).select("query_id", "rank", entry.alias("entry")), "query_id", "rank", F.length("entry"), K.CONTEXT_CHARS)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"])
    context = kept.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context")).join(tables.questions(spark, d), "query_id")
    rules = F.concat(F.lit(K.ANSWER_RULES), F.when(F.col("query_id") % 2 == 0, K.CITING_RULES).otherwise(""))
    return context.select("query_id", rules.alias("rules"), F.md5(F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "question")).alias("prompt"))


_LAST = "last AS (SELECT conv_id, arg_max(text, turn) AS question, max(turn) AS asked_at FROM conversations WHERE role = 'user' GROUP BY conv_id)"


@query(f"WITH {_LAST}, before AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS history FROM (SELECT c.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations c JOIN last USING (conv_id) WHERE turn < asked_at) WHERE n <= 10 GROUP BY conv_id) SELECT conv_id, coalesce('Previous conversation:' || chr(10) || history || chr(10) || chr(10) || 'Current question: ' || question, question) AS question FROM last LEFT JOIN before USING (conv_id)")
def enhanced_question(spark, d):
    return conversation.enhanced_question(_messages(spark, d))


@query(f"WITH {_LAST}, ends AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, last + 1, 'user', question FROM last JOIN ends USING (conv_id) UNION ALL SELECT conv_id, last + 2, 'assistant', 'You asked: ' || question FROM last JOIN ends USING (conv_id)")
def persist_turn(spark, d):
    """The last question of each conversation asked again, and an answer."""
    asked = _messages(spark, d).where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    return conversation.with_turn(_messages(spark, d), asked.withColumn("answer", F.concat(F.lit("You asked: "), "question")))


# --- topics, replies, scripts ---


@query(f"WITH {_LINES}, {_HEADINGS} SELECT * FROM headings WHERE position < 6")
def heading_topics(spark, d):
    return digest.heading_topics(_headings(spark, d)).withColumn("position", F.col("position").cast("long"))


_STRUCTURAL = f"{_LINES}, {_HEADINGS}, {_TOPICS}, structural AS (SELECT doc_id, position, topic FROM headings WHERE position < 6 UNION ALL SELECT doc_id, position, topic FROM topics WHERE doc_id NOT IN (SELECT doc_id FROM headings))"


@query(f"WITH {_STRUCTURAL} SELECT * FROM structural")
def structural_topics(spark, d):
    return digest.structural_topics(_headings(spark, d), _docs(spark, d)).withColumn("position", F.col("position").cast("long"))


_WORDS = "string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ')"
_REPLY = f"""CASE doc_id % 4 WHEN 0 THEN '{{"documents": [{{"index": 1, "topics": [" ' || w[1] || ' ", "", "' || w[2] || '"]}}, {{"index": 9, "topics": ["out"]}}, {{"index": "x", "topics": ["no"]}}]}}'
  WHEN 1 THEN 'Sure, here it is: {{"documents": [{{"index": 2, "topics": ["old"]}}, {{"index": 2, "topics": ["' || w[3] || '"]}}, {{"index": 1, "topics": []}}]}} Anything else?' WHEN 2 THEN '["no object"]' ELSE 'no JSON {{ here }}' END"""


def _replies(spark, d):
    """A model's replies as they may come: as asked for, inside prose, and useless."""
    w = F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " ")
    plain = F.concat(F.lit('{"documents": [{"index": 1, "topics": [" '), F.get(w, F.lit(0)), F.lit(' ", "", "'), F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.lit('"]}, {"index": 9, "topics": ["out"]}, {"index": "x", "topics": ["no"]}]}'))
    prose = F.concat(F.lit('Sure, here it is: {"documents": [{"index": 2, "topics": ["old"]}, {"index": 2, "topics": ["'), F.coalesce(F.get(w, F.lit(2)), F.lit("")), F.lit('"]}, {"index": 1, "topics": []}]} Anything else?'))
    reply = F.when(F.col("doc_id") % 4 == 0, plain).when(F.col("doc_id") % 4 == 1, prose).when(F.col("doc_id") % 4 == 2, '["no object"]').otherwise("no JSON { here }")
    return _docs(spark, d).select(F.col("doc_id").alias("prompt_id"), reply.alias("reply"), F.lit(3).alias("documents"))


_ASKED = f"asked AS (SELECT doc_id, {_REPLY} AS reply, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS c FROM (SELECT doc_id, list_concat({_WORDS}, ['', '', '']) AS w FROM documents))"


@query(f"WITH {_ASKED} SELECT doc_id AS prompt_id, CASE WHEN json_valid(reply) AND json_type(reply) = 'OBJECT' THEN reply WHEN json_valid(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1)) THEN nullif(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1), '') END AS object FROM asked")
def reply_objects(spark, d):
    return _replies(spark, d).select("prompt_id", T.first_object(F.col("reply")).alias("object"))


@query(f"WITH {_ASKED}, found AS (SELECT doc_id, 1 AS index, list_filter([trim(a), b], lambda x: trim(x) <> '') AS t FROM asked WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 2, CASE WHEN c = '' THEN ['old'] ELSE [c] END FROM asked WHERE doc_id % 4 = 1) SELECT doc_id AS prompt_id, index, CAST(i - 1 AS BIGINT) AS position, t[i] AS topic FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM found)")
def topic_replies(spark, d):
    return digest.topic_replies(_replies(spark, d)).withColumn("position", F.col("position").cast("long"))


_SCENE_REPLY = """CASE doc_id % 3 WHEN 0 THEN '{"scenes": [{"index": 1, "headline": " First  line ", "bullets": ["", " a  b ", "c"], "narration": "It   says ' || left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 20) || '."}, {"index": true, "narration": "no"}, {"index": 2, "narration": "  "}]}' WHEN 1 THEN 'Here: {"scenes": [{"index": 3, "bullets": null, "narration": "old"}, {"index": 3, "headline": "", "narration": "new one"}]}' ELSE 'nothing' END"""


@query("SELECT doc_id AS prompt_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 3 END AS index, CASE WHEN doc_id % 3 = 0 THEN 'First line' END AS headline, CASE WHEN doc_id % 3 = 0 THEN 'a b|c' ELSE '' END AS bullets, CASE WHEN doc_id % 3 = 0 THEN trim(regexp_replace('It   says ' || left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 20) || '.', '\\s+', ' ', 'g')) ELSE 'new one' END AS narration FROM documents WHERE doc_id % 3 < 2")
def scene_replies(spark, d):
    letters = F.substring(F.regexp_replace("text", "[^A-Za-z ]", ""), 1, 20)
    plain = F.concat(F.lit('{"scenes": [{"index": 1, "headline": " First  line ", "bullets": ["", " a  b ", "c"], "narration": "It   says '), letters, F.lit('."}, {"index": true, "narration": "no"}, {"index": 2, "narration": "  "}]}'))
    prose = F.lit('Here: {"scenes": [{"index": 3, "bullets": null, "narration": "old"}, {"index": 3, "headline": "", "narration": "new one"}]}')
    replies = _docs(spark, d).select(F.col("doc_id").alias("prompt_id"), F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, prose).otherwise("nothing").alias("reply"), F.lit(3).alias("documents"))
    return digest.scene_replies(replies).withColumn("bullets", F.array_join("bullets", "|"))


_CHOSEN = f"{_STRUCTURAL}, {_ASKED}, model AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS position, t[i] AS topic FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, list_filter([trim(a), b], lambda x: trim(x) <> '') AS t FROM asked WHERE doc_id % 4 = 0))), chosen AS (SELECT * FROM model UNION ALL SELECT * FROM structural WHERE doc_id NOT IN (SELECT doc_id FROM model))"


def _chosen(spark, d):
    """A model's topics for some documents, structural ones for the others."""
    model = digest.topic_replies(_replies(spark, d)).where("index = 1").select(F.col("prompt_id").alias("doc_id"), "position", "topic")
    return digest.chosen_topics(model, digest.structural_topics(_headings(spark, d), _docs(spark, d)))


@query(f"WITH {_CHOSEN} SELECT source AS project, 1 + count(DISTINCT d.doc_id) + count(c.topic) AS nodes FROM documents d LEFT JOIN chosen c USING (doc_id) GROUP BY source")
def tree_node_counts(spark, d):
    return digest.node_counts(tables.documents(spark, d), _chosen(spark, d))


@query(f"WITH {_CHOSEN} SELECT source AS project, doc_id, '- doc-' || doc_id || coalesce(l, '') AS list FROM documents LEFT JOIN (SELECT doc_id, string_agg(chr(10) || '  - ' || topic, '' ORDER BY position) AS l FROM chosen GROUP BY doc_id) USING (doc_id)")
def tree_markdown(spark, d):
    return digest.tree_lines(tables.documents(spark, d), _chosen(spark, d))


@query("SELECT source AS project, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) || '. doc-' || doc_id || chr(10) || coalesce(nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13))[1:1200], ''), '(no text extracted)') AS entry FROM documents")
def topic_prompt(spark, d):
    return digest.topic_prompt(tables.documents(spark, d))


_PHRASE = "CASE len({0}) WHEN 0 THEN '' WHEN 1 THEN {0}[1] ELSE array_to_string({0}[:-2], ', ') || ' and ' || {0}[-1] END"
_SCRIPT = f"""{_LINES}, {_HEADINGS}, {_TOPICS}, made AS (SELECT max(o_orderdate) AS made FROM orders),
  h AS (SELECT doc_id, list({_SHORT.format('topic')} ORDER BY position) AS h FROM headings WHERE position < 4 GROUP BY doc_id), k AS (SELECT doc_id, list(topic ORDER BY position) AS k FROM topics WHERE position < 4 GROUP BY doc_id),
  found AS (SELECT doc_id, source, h, k, list_transform({_FIRST_SENTENCES}, lambda s: {_SHORT.format('s')}) AS s FROM documents LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)),
  said AS (SELECT doc_id, source, coalesce(h, CASE WHEN len(s) > 0 THEN s END, k, []) AS bullets, h IS NULL AND len(s) > 0 AS spoken FROM found),
  spoken AS (SELECT *, list_transform(list_filter(bullets, lambda b: b <> ''), lambda b: regexp_replace(b, '\\.+$', '')) AS p FROM said),
  n AS (SELECT source, count(*) AS n, count(*) || ' source' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS sources, list('doc-' || doc_id ORDER BY doc_id)[1:4] AS shown FROM documents GROUP BY source),
  script AS (SELECT source AS project, 0 AS part, NULL::BIGINT AS doc_id, 'title' AS kind, source AS headline, [sources, 'Generated ' || strftime(made, '%-d %B %Y')] AS bullets, 'This is a video summary of the project ' || source || '. It covers ' || sources || '.' AS narration FROM n, made
  UNION ALL SELECT source, 1, doc_id, 'source', 'doc-' || doc_id, bullets, CASE WHEN spoken THEN 'This source is doc-' || doc_id || '. It begins: ' || array_to_string(bullets, ' ') WHEN len(bullets) > 0 THEN 'This source is doc-' || doc_id || '. It covers ' || {_PHRASE.format('p')} || '.' ELSE 'This source is doc-' || doc_id || '. Its text has not been extracted yet.' END FROM spoken
  UNION ALL SELECT source, 2, NULL, 'closing', 'What this project covers', shown, 'That is ' || source || ', covering ' || sources || ': ' || {_PHRASE.format('shown')} || CASE WHEN n > len(shown) THEN ', and ' || (n - len(shown)) || ' more' ELSE '' END || '.' FROM n)"""


def _script(spark, d):
    made = tables.table(spark, d, "orders").agg(F.max("o_orderdate").alias("made"))  # one row
    return digest.scene_script(tables.documents(spark, d), _headings(spark, d), made)


@query(f"WITH {_SCRIPT} SELECT project, part, doc_id, kind, headline, array_to_string(bullets, '|') AS bullets, narration FROM script")
def scene_script(spark, d):
    return _script(spark, d).withColumn("bullets", F.array_join("bullets", "|"))


@query(f"WITH {_SCRIPT} SELECT project, part, doc_id, '## ' || headline || chr(10) || chr(10) || CASE WHEN kind = 'source' THEN 'Source: ' || headline || chr(10) || chr(10) ELSE '' END || CASE WHEN len(bullets) > 0 THEN array_to_string(list_transform(bullets, lambda b: '- ' || b), chr(10)) || chr(10) || chr(10) ELSE '' END || narration || chr(10) AS section FROM script")
def script_markdown(spark, d):
    return digest.scene_sections(_script(spark, d))


_LENGTH = f"greatest(1.0::DOUBLE, len(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) / {K.WORDS_PER_SECOND}::DOUBLE)"


@query(f"WITH timed AS (SELECT conv_id, turn, {_LENGTH} AS seconds FROM conversations), placed AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts, sum(seconds) OVER (PARTITION BY conv_id) AS total FROM timed) SELECT conv_id, turn, round(starts + least(greatest(0, turn * 3.0::DOUBLE), seconds), 5) AS elapsed, (CAST(floor(round(starts, 6)) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(floor(round(starts, 6)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock, CAST(round_even(total, 0) AS BIGINT) AS total FROM placed")
def scene_clock(spark, d):
    """Where a player stands some seconds into each scene (never beyond its end), the clock at its start, and the script's seconds."""
    words = F.size(F.filter(F.split(T.collapsed(F.col("text")), " "), lambda w: w != ""))
    timed = sequences.timeline(_messages(spark, d).select("conv_id", "turn", F.greatest(F.lit(1.0), words / K.WORDS_PER_SECOND).alias("seconds")), "conv_id", "turn")
    total = timed.groupBy("conv_id").agg(F.bround(F.sum("seconds"), 0).cast("long").alias("total"))
    within = F.least(F.greatest(F.lit(0.0), F.col("turn") * 3.0), F.col("seconds"))
    return timed.join(total, "conv_id").select("conv_id", "turn", F.round(F.col("starts") + within, 5).alias("elapsed"), T.clock(F.round("starts", 6)).alias("clock"), "total")


# --- exports ---


@query("SELECT conv_id, '# ' || 'Conversation ' || conv_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(CASE WHEN role = 'user' THEN '## 👤 User' ELSE '## 🤖 Assistant' END || chr(10) || chr(10) || text || chr(10) || chr(10) || CASE WHEN role <> 'user' AND turn % 2 = 1 THEN '**Sources:**' || chr(10) || '- doc-' || turn || chr(10) || '- Unknown' || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def conversation_markdown(spark, d):
    cited = F.when((F.col("role") != "user") & (F.col("turn") % 2 == 1), F.array(F.concat(F.lit("doc-"), "turn"), F.lit(None).cast("string")))
    return conversation.as_markdown(_messages(spark, d).withColumn("citations", cited), F.concat(F.lit("Conversation "), "conv_id"))


@query("SELECT conv_id, '{\"id\":' || conv_id || ',\"messages\":[' || string_agg('{\"turn\":' || turn || ',\"role\":' || to_json(role) || ',\"text\":' || to_json(text) || '}', ',' ORDER BY turn) || ']}' AS body FROM conversations GROUP BY conv_id")
def conversation_json(spark, d):
    return conversation.as_json(_messages(spark, d))


@query(f"WITH {_LINES} SELECT source AS project, doc_id, '{{\"id\":' || doc_id || ',\"title\":\"doc-' || doc_id || '\",\"chunk_count\":' || n || '}}' AS line FROM documents JOIN (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id) USING (doc_id)")
def project_json(spark, d):
    """A project's documents as JSON lines."""
    counts = _docs(spark, d).select("doc_id", F.size(F.split("text", "\n")).alias("chunk_count"))
    rows = tables.documents(spark, d).join(counts, "doc_id")
    return rows.select("project", "doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "title", "chunk_count")).alias("line"))


@query("""WITH c AS (SELECT 'src' || conv_id % 40 AS project, conv_id, count(*) AS n FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY conv_id DESC) AS place FROM c),
  t AS (SELECT project, count(*) AS conversation_count, CAST(sum(n) FILTER (place <= 5) AS BIGINT) AS total_messages FROM r GROUP BY project), d AS (SELECT source AS project, count(*) AS document_count, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS total_chunks FROM documents GROUP BY source)
  SELECT project, '# Project Summary: ' || project || chr(10) || chr(10) || '## Statistics' || chr(10) || '- **Documents**: ' || document_count || chr(10) || '- **Total Chunks**: ' || total_chunks || chr(10) || '- **Conversations**: ' || coalesce(conversation_count, 0) || chr(10) || '- **Total Messages**: ' || coalesce(total_messages, 0) || chr(10) AS report FROM d LEFT JOIN t USING (project)""")
def project_summary(spark, d):
    """Counts of each project; messages are those of its five newest conversations only, beside the number of all."""
    talks = _messages(spark, d).groupBy(F.concat(F.lit("src"), F.col("conv_id") % 40).alias("project"), "conv_id").agg(F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(sequences.Window.partitionBy("project").orderBy(F.desc("conv_id")))
    recent = talks.withColumn("place", number).where("place <= 5").groupBy("project").agg(F.sum("n").alias("total_messages"))
    counts = talks.groupBy("project").agg(F.count(F.lit(1)).alias("conversation_count")).join(recent, "project")
    docs = tables.documents(spark, d).groupBy("project").agg(F.count(F.lit(1)).alias("document_count"), F.sum(F.size(F.split("text", "\n"))).alias("total_chunks"))
    rows = docs.join(counts, "project", "left")
    line = lambda name, c: F.concat(F.lit(f"- **{name}**: "), F.coalesce(c, F.lit(0)), F.lit("\n"))
    stats = [line(n, F.col(c)) for n, c in (("Documents", "document_count"), ("Total Chunks", "total_chunks"), ("Conversations", "conversation_count"), ("Total Messages", "total_messages"))]
    return rows.select("project", F.concat(F.lit("# Project Summary: "), "project", F.lit("\n\n## Statistics\n"), *stats).alias("report"))


# --- evaluation ---

_EXPECTED = _HITS.replace("AS relevant FROM", "AND doc_id % 7 = query_id % 7 AS relevant, doc_id, text FROM")


def _expected(spark, d):
    """Judged hits of which only those of expected documents count (a seventh of all for each question)."""
    wanted = _docs(spark, d).select("doc_id").join(tables.questions(spark, d).select("query_id"), F.col("doc_id") % 7 == F.col("query_id") % 7)
    hits = _judged(spark, d)
    return evaluation.expected(hits, wanted.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"))


@query(f"WITH {_EXPECTED} SELECT query_id, rank, doc_id, relevant FROM hits")
def eval_expected(spark, d):
    return _expected(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "relevant")


@query(f"WITH {_EXPECTED} SELECT query_id FROM hits GROUP BY query_id HAVING NOT bool_or(relevant)")
def eval_misses(spark, d):
    return evaluation.misses(evaluation.per_query(_expected(spark, d))).select("query_id")


@query(f"WITH {_EXPECTED} SELECT count(*) AS retrieved, round(avg(CAST({_any('text', K.BOILERPLATE)} AS DOUBLE)), 6) AS boilerplate, round(avg(CAST({_any('text', K.EVALUATED_MARKS, 2)} AS DOUBLE)), 6) AS citation_like FROM hits")
def eval_flagged_share(spark, d):
    return evaluation.flagged_share(_judged(spark, d))


@query(f"WITH {_HITS}, {_PER_QUERY}, parted AS (SELECT *, (['en', 'zh'])[query_id % 2 + 1] AS lang, (['mono', 'mono', 'cross'])[query_id % 3 + 1] AS mode FROM scored) SELECT lang, mode, {_MEANS} FROM parted GROUP BY GROUPING SETS ((), (lang, mode))")
def eval_slices_by_mode(spark, d):
    """All questions, and those of each language and mode."""
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("query_id") % n + 1).cast("int"))
    scored = evaluation.per_query(_judged(spark, d)).withColumn("lang", pick(("en", "zh"), 2)).withColumn("mode", pick(("mono", "mono", "cross"), 3))
    return evaluation.summary(scored, "lang", "mode")


@query(f"WITH {_HITS}, {_PER_QUERY}, m AS (SELECT {_MEANS} FROM scored) SELECT 'settings' AS section, unnest(['top_k', 'candidates', 'k1', 'b']) AS name, unnest([{K.TOP_K}::DOUBLE, {K.CANDIDATES}, {K.K1}, {K.B}]) AS value UNION ALL SELECT 'metrics', unnest(['queries', 'recall_1', 'recall_10', 'precision_5', 'rr_10']), unnest([queries::DOUBLE, recall_1, recall_10, precision_5, rr_10]) FROM m UNION ALL SELECT 'misses', 'question ' || query_id, NULL FROM scored WHERE h10 = 0")
def eval_report(spark, d):
    """Rows of a report: settings, means, and the questions without a hit."""
    scored = evaluation.per_query(_judged(spark, d))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
    settings = F.array(pair("top_k", F.lit(K.TOP_K)), pair("candidates", F.lit(K.CANDIDATES)), pair("k1", F.lit(K.K1)), pair("b", F.lit(K.B)))
    metrics = F.array(*(pair(n, F.col(n)) for n in ("queries", "recall_1", "recall_10", "precision_5", "rr_10")))
    means = evaluation.summary(scored).select(F.explode(F.array(F.struct(F.lit("settings").alias("section"), settings.alias("rows")), F.struct(F.lit("metrics").alias("section"), metrics.alias("rows")))).alias("x"))
    rows = means.select("x.section", F.explode("x.rows").alias("y")).select("section", "y.*")
    return rows.unionByName(evaluation.misses(scored).select(F.lit("misses").alias("section"), F.concat(F.lit("question "), "query_id").alias("name"), F.lit(None).cast("double").alias("value")))
