"""All registered queries of the library, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import chunking, conversation, digest, evaluation, fusion, lexical, monitoring, sequences, vectors
from ..sources import html, tables
from .registry import FLAGSHIP, ORACLE_SQL, QUERIES, query

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-_.''][a-z0-9]+)*')"


_QUESTIONS = "questions AS (SELECT item_id AS query_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:8], ' ') AS question, text AS answer FROM benchmark)"
_TRUSTED = "(SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"


def _bm25(docs: str = "documents") -> str:
    return f"""{_QUESTIONS},
    toks AS (SELECT doc_id, {_tok("text")} AS t FROM {docs}),
    lens AS (SELECT doc_id, len(t) AS n FROM toks),
    stats AS (SELECT count(*) AS docs, avg(n) AS mean FROM lens),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
    asked AS (SELECT query_id, unnest(list_distinct({_tok("question")})) AS term FROM questions),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scores AS (SELECT query_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * {K.K1 + 1} / (tf + {K.K1} * ({1 - K.B} + {K.B} * n / mean))) AS score
      FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL HAVING score > 0)"""


def _top(scores: str, k: int, key: str = "doc_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {key}) AS rank FROM {scores} QUALIFY rank <= {k}"


def _docs(spark, d):
    return tables.table(spark, d, "documents")


# --- tokens and lexical search ---


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)")
def tokenize_documents(spark, d):
    rows = tables.spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY term")
def document_frequency(spark, d):
    return lexical.document_frequency(_docs(spark, d))


@query(f"WITH {_bm25()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({_top('scores', 5)})")
def bm25_top_k(spark, d):
    return lexical.best(_docs(spark, d), tables.questions(spark, d), K.TOP_K).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {_bm25(f'(SELECT * FROM documents WHERE doc_id IN {_TRUSTED})')} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM ({_top('scores', 5)})")
def bm25_scoped(spark, d):
    hits = lexical.best(_docs(spark, d), tables.questions(spark, d), K.TOP_K, tables.trusted(spark, d))
    return hits.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25()}, top AS ({_top('scores', 30)}),
  hits AS (SELECT query_id, doc_id, score, list_distinct(regexp_split_to_array(lower(question), '\\s+')) AS q, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS t, length(text) AS n FROM top JOIN questions USING (query_id) JOIN documents USING (doc_id))
  SELECT query_id, doc_id, round({K.ALPHA} * round(score, 6) + {K.BETA} * len(list_intersect(q, t)) / len(q) + {K.GAMMA} * CASE WHEN n < 100 THEN 0.5 WHEN n > 1000 THEN 0.8 ELSE 1.0 END, 4) AS rerank_score FROM hits""")
def heuristic_rerank(spark, d):
    questions = tables.questions(spark, d)
    top = lexical.best(_docs(spark, d), questions, K.CANDIDATES).withColumn("score", F.round("score", 6))
    hits = top.join(questions, "query_id").join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return lexical.rerank(hits).select("query_id", "doc_id", F.round("rerank_score", 4).alias("rerank_score"))


# --- vector search ---

_VECTORS = "vectors AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


_ASKED = "scores AS (SELECT a.id AS query_id, b.id, {0} AS score FROM vectors a, vectors b WHERE a.id % 50 = 0{1})"


@query(f"WITH {_VECTORS}, {_ASKED.format('list_dot_product(a.v, b.v)', '')} SELECT query_id, id, rank, round(score, 5) AS score FROM ({_top('scores', 10, 'id')})")
def dense_top_k(spark, d):
    found = tables.vectors(spark, d)
    return vectors.block_search(found, found.where("id % 50 = 0"), 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"WITH {_VECTORS}, {_ASKED.format('list_dot_product(a.v, b.v)', ' AND b.label < 5')} SELECT query_id, id, round(score, 5) AS score FROM scores WHERE score >= 0.1")
def dense_scoped_threshold(spark, d):
    found = tables.vectors(spark, d)
    inside = lexical.scoped(found, found.where("label < 5").select("id"), "id")
    return vectors.block_search(inside, found.where("id % 50 = 0"), None, floor=0.1).select("query_id", "id", F.round("score", 5).alias("score"))


@query(f"WITH {_VECTORS}, {_ASKED.format('CASE WHEN list_dot_product(b.v, b.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, b.v) END', '')} SELECT query_id, id, rank, round(score, 5) AS score FROM ({_top('scores', 10, 'id')})")
def cosine_top_k(spark, d):
    found = tables.vectors(spark, d)
    best = vectors.block_search(found, found.where("id % 50 = 0"), 10, measure="cosine")
    return best.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query(f"WITH {_VECTORS}, scores AS (SELECT a.id AS query_id, b.id, list_dot_product(a.v, b.v) AS score FROM vectors a, vectors b WHERE a.id % 50 = 0) SELECT query_id, id, rank, round(score, 5) AS score FROM ({_top('scores', 5, 'id')})")
def dense_batch_top_k(spark, d):
    found = tables.vectors(spark, d)
    best = vectors.block_search(found, found.where("id % 50 = 0"), K.TOP_K)
    return best.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


# --- fusion and retrieval ---

_LISTS = f"""{_bm25()}, lex AS ({_top('scores', 30)}),
  scored2 AS (SELECT query_id, doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM asked JOIN tf USING (term) GROUP BY ALL), counted AS ({_top('scored2', 30)}),
  shares AS (SELECT query_id, doc_id, 1 / (60.0::DOUBLE + rank) AS s, rank AS seen FROM lex UNION ALL SELECT query_id, doc_id, 1 / (60.0::DOUBLE + rank), 1000000000 + rank FROM counted),
  fused AS (SELECT query_id, doc_id, max(s) AS best, sum(s) AS total, min(seen) AS seen FROM shares GROUP BY ALL)"""


def _two_lists(spark, d):
    """BM25's ranking and that of plain term counts, from one table of terms."""
    questions = tables.questions(spark, d)
    return [lexical.ranked(x, K.CANDIDATES) for x in lexical.scores(_docs(spark, d), questions, K.CANDIDATES, names=("bm25", "count"))]


@query(f"WITH {_LISTS} SELECT query_id, doc_id, round(total, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, seen) - 1 AS position FROM fused")
def rrf_sum(spark, d):
    return fusion.fused(_two_lists(spark, d), best_first=False).select("query_id", "doc_id", F.round("total", 6).alias("score"), F.col("position").cast("long").alias("position"))


_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY round(best, 9) DESC, round(total, 9) DESC, seen) - 1"


@query(f"WITH {_LISTS} SELECT query_id, doc_id, round(best, 6) AS best, round(total, 6) AS total, {_BEST} AS position FROM fused")
def rrf_best(spark, d):
    return fusion.fused(_two_lists(spark, d)).select("query_id", "doc_id", F.round("best", 6).alias("best"), F.round("total", 6).alias("total"), F.col("position").cast("long").alias("position"))


@query(f"WITH {_LISTS} SELECT query_id, doc_id, round(best + total, 6) AS rerank_score FROM (SELECT *, {_BEST} AS position FROM fused) WHERE position < 5")
def hybrid_fuse(spark, d):
    return fusion.fused(_two_lists(spark, d)).where(F.col("position") < K.TOP_K).select("query_id", "doc_id", F.round(F.col("best") + F.col("total"), 6).alias("rerank_score"))


_CANDIDATES = f"{_bm25()}, top AS ({_top('scores', 30)}), cand AS (SELECT query_id, doc_id, rank AS position, list_distinct({_tok('text')}) AS t FROM top JOIN documents USING (doc_id))"


def _candidates(spark, d):
    top = lexical.best(_docs(spark, d), tables.questions(spark, d), K.CANDIDATES)
    return top.select("query_id", "doc_id", F.col("rank").alias("position")).join(_docs(spark, d).select("doc_id", "text"), "doc_id")


@query(f"WITH {_CANDIDATES} SELECT a.query_id, a.doc_id AS left_id, b.doc_id AS right_id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM cand a JOIN cand b ON a.query_id = b.query_id AND b.position = a.position + 1")
def jaccard_pairs(spark, d):
    """Token similarity of each candidate and the next best."""
    rows = _candidates(spark, d).select("query_id", "doc_id", "position", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    after = Window.partitionBy("query_id").orderBy("position")
    pairs = rows.withColumn("right_id", F.lead("doc_id").over(after)).withColumn("u", F.lead("t").over(after)).where("right_id IS NOT NULL")
    return pairs.select("query_id", F.col("doc_id").alias("left_id"), "right_id", F.round(fusion.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query(f"""WITH RECURSIVE {_CANDIDATES},
  fold AS (SELECT query_id, 0 AS step, CAST([] AS STRUCT(d BIGINT, t VARCHAR[])[]) AS kept FROM questions
    UNION ALL SELECT f.query_id, f.step + 1, CASE WHEN len(list_filter(f.kept, lambda k: len(k.t) > 0 AND len(c.t) > 0 AND len(list_intersect(k.t, c.t)) / len(list_distinct(list_concat(k.t, c.t))) >= {K.DEDUPE})) > 0 THEN f.kept ELSE list_append(f.kept, {{'d': c.doc_id, 't': c.t}}) END
    FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.position = f.step + 1)
  SELECT query_id, unnest(list_transform(kept, lambda k: k.d)) AS doc_id FROM (SELECT query_id, kept, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS n FROM fold) WHERE n = 1""")
def dedupe_greedy(spark, d):
    return fusion.deduped(_candidates(spark, d)).select("query_id", "doc_id")


_FLAG = f"""{_bm25()}, lex AS ({_top('scores', 30)}), {_VECTORS},
  sims AS (SELECT a.id AS query_id, b.id AS doc_id, list_dot_product(a.v, b.v) AS score FROM vectors a JOIN questions q ON q.query_id = a.id, vectors b), dense AS ({_top('(SELECT * FROM sims JOIN (SELECT doc_id FROM documents) USING (doc_id))', 30)}),
  shares AS (SELECT query_id, doc_id, 1 / (60.0::DOUBLE + rank) AS s, rank AS seen FROM dense UNION ALL SELECT query_id, doc_id, 1 / (60.0::DOUBLE + rank), 1000000000 + rank FROM lex),
  fused AS (SELECT query_id, doc_id, max(s) AS best, sum(s) AS total, min(seen) AS seen FROM shares GROUP BY ALL),
  cand AS (SELECT query_id, doc_id, best + total AS score, text, list_distinct({_tok('text')}) AS t, {_BEST} + 1 AS position FROM fused JOIN documents USING (doc_id)),
  fold AS (SELECT query_id, 0 AS step, CAST([] AS STRUCT(d BIGINT, t VARCHAR[])[]) AS kept FROM questions
    UNION ALL SELECT f.query_id, f.step + 1, CASE WHEN len(list_filter(f.kept, lambda k: len(k.t) > 0 AND len(c.t) > 0 AND len(list_intersect(k.t, c.t)) / len(list_distinct(list_concat(k.t, c.t))) >= {K.DEDUPE})) > 0 THEN f.kept ELSE list_append(f.kept, {{'d': c.doc_id, 't': c.t}}) END
    FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.position = f.step + 1),
  kept AS (SELECT query_id, unnest(list_transform(kept, lambda k: k.d)) AS doc_id FROM (SELECT query_id, kept, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS n FROM fold) WHERE n = 1),
  final AS (SELECT query_id, doc_id, score, text, row_number() OVER (PARTITION BY query_id ORDER BY position) AS source FROM kept JOIN cand USING (query_id, doc_id) QUALIFY source <= 5)"""


def _retrieved(spark, d):
    """Hybrid retrieval for all questions in one job: vectors and terms, fused, without near duplicates, five each."""
    docs, questions = _docs(spark, d), tables.questions(spark, d)
    found = tables.vectors(spark, d).select("id", "vector")
    asked = found.join(questions.select(F.col("query_id").alias("id")), "id", "left_semi")
    known = found.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    dense = vectors.block_search(known, asked, K.CANDIDATES).withColumnRenamed("id", "doc_id")
    lists = [dense, lexical.best(docs, questions, K.CANDIDATES)]
    fused = fusion.fused(lists).select("query_id", "doc_id", "position", (F.col("best") + F.col("total")).alias("score"))
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    kept = fusion.deduped(fused.join(docs.select("doc_id", "text", preview.alias("text_preview")), "doc_id"))
    source = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return kept.withColumn("source", source).where(F.col("source") <= K.TOP_K)


@query(f"WITH RECURSIVE {_FLAG} SELECT query_id, source, doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS text_preview, round(score, 6) AS score FROM final")
def retrieve_flagship(spark, d):
    return _retrieved(spark, d).select("query_id", F.col("source").cast("long").alias("source"), "doc_id", "text_preview", F.round("score", 6).alias("score"))


_ENTRY = "'[Source ' || rank || ': doc-' || doc_id || ']' || chr(10) || text"


@query(f"WITH {_bm25()}, top AS ({_top('scores', 5)}), entries AS (SELECT query_id, rank, {_ENTRY} AS entry FROM top JOIN documents USING (doc_id)), used AS (SELECT *, sum(length(entry) + 2) OVER (PARTITION BY query_id ORDER BY rank) - 2 AS used FROM entries) SELECT query_id, CAST(count(*) AS BIGINT) AS sources, CAST(sum(length(entry)) AS BIGINT) AS chars, md5(string_agg(entry, chr(10) || chr(10) ORDER BY rank)) AS context FROM used WHERE used <= {K.CONTEXT_CHARS} OR rank = 1 GROUP BY query_id")
def context_budget(spark, d):
    top = lexical.best(_docs(spark, d), tables.questions(spark, d), K.TOP_K).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    entry = F.concat(F.lit("[Source "), "rank", F.lit(": doc-"), "doc_id", F.lit("]\n"), "text")
    kept = sequences.budget_prefix(top.select("query_id", "rank", entry.alias("entry")), "query_id", "rank", F.length("entry"), K.CONTEXT_CHARS)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"])
    return kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), F.sum(F.length("entry")).cast("long").alias("chars"), F.md5(F.array_join(ordered, "\n\n")).alias("context"))


@query(f"WITH {_bm25()} SELECT query_id, rank AS source, doc_id, 'doc-' || doc_id AS title, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS text_preview, round(score, 6) AS score FROM ({_top('scores', 5)}) JOIN documents USING (doc_id)")
def source_citations(spark, d):
    top = lexical.best(_docs(spark, d), tables.questions(spark, d), K.TOP_K).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return top.select("query_id", F.col("rank").cast("long").alias("source"), "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("title"), preview.alias("text_preview"), F.round("score", 6).alias("score"))


# --- evaluation ---

_HITS = f"{_bm25()}, hits AS (SELECT query_id, rank, contains(lower(regexp_replace(text, '\\s+', '', 'g')), lower(regexp_replace(answer, '\\s+', '', 'g'))) AS relevant FROM ({_top('scores', 10)}) JOIN documents USING (doc_id) JOIN questions USING (query_id))"
_PER_QUERY = "scored AS (SELECT query_id, max(CASE WHEN relevant AND rank <= 1 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN relevant AND rank <= 3 THEN 1 ELSE 0 END) AS h3, max(CASE WHEN relevant AND rank <= 5 THEN 1 ELSE 0 END) AS h5, max(CASE WHEN relevant AND rank <= 10 THEN 1 ELSE 0 END) AS h10, count(*) FILTER (relevant AND rank <= 5) / count(*) FILTER (rank <= 5) AS p5, coalesce(1.0 / min(rank) FILTER (relevant), 0) AS rr FROM hits GROUP BY query_id)"
_MEANS = "count(*) AS queries, round(avg(h1), 6) AS recall_1, round(avg(h3), 6) AS recall_3, round(avg(h5), 6) AS recall_5, round(avg(h10), 6) AS recall_10, round(avg(p5), 6) AS precision_5, round(avg(rr), 6) AS rr_10"


def _judged(spark, d):
    questions = tables.questions(spark, d)
    top = lexical.best(_docs(spark, d), questions, 10)
    return evaluation.judged(top.join(_docs(spark, d).select("doc_id", "text"), "doc_id").join(questions, "query_id"))


@query(f"WITH {_HITS} SELECT query_id, rank, relevant FROM hits")
def eval_judge(spark, d):
    return _judged(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "relevant")


@query(f"WITH {_HITS}, {_PER_QUERY} SELECT {_MEANS} FROM scored")
def eval_summary(spark, d):
    return evaluation.summary(evaluation.per_query(_judged(spark, d)))


@query(f"WITH {_HITS}, {_PER_QUERY}, parted AS (SELECT *, CAST(query_id % 3 AS BIGINT) AS part FROM scored) SELECT part, {_MEANS} FROM parted GROUP BY GROUPING SETS ((), (part))")
def eval_slices(spark, d):
    return evaluation.summary(evaluation.per_query(_judged(spark, d)).withColumn("part", F.col("query_id") % 3), "part")


@query("WITH p AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n_chars) FILTER (place = round_even(0.5 * (n - 1), 0)) AS p50, max(n_chars) FILTER (place = round_even(0.95 * (n - 1), 0)) AS p95, max(n_chars) FILTER (place = n - 1) AS p100 FROM p GROUP BY lang")
def length_percentiles(spark, d):
    return evaluation.percentiles(_docs(spark, d), "n_chars", (0.5, 0.95, 1.0), "lang")


def _any(text: str, marks: tuple[str, ...], least: int = 1) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{m}') AS INT)" for m in marks) + f") >= {least}"


@query(f"SELECT page_id, {_any('html', K.BOILERPLATE)} AS boilerplate, {_any('html', K.EVALUATED_MARKS, 2)} AS citation_like FROM pages")
def pollution_flags(spark, d):
    x = F.col("html")
    return tables.table(spark, d, "pages").select("page_id", evaluation.contains_any(x, K.BOILERPLATE).alias("boilerplate"), evaluation.contains_any(x, K.EVALUATED_MARKS, 2).alias("citation_like"))


_LINES = "blocks AS (SELECT doc_id, i - 1 AS line, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query(f"WITH {_LINES} SELECT count(*) AS chunks, max(length(text)) AS longest, round(avg(CAST(length(text) < 80 AS DOUBLE)), 6) AS tiny, round(avg(CAST(length(text) > 1024 AS DOUBLE)), 6) AS oversized, round(avg(CAST({_any('text', K.BOILERPLATE)} AS DOUBLE)), 6) AS boilerplate, round(avg(CAST({_any('text', K.EVALUATED_MARKS, 2)} AS DOUBLE)), 6) AS citation_like, round(avg(CAST(line > 0 AND length(first) BETWEEN 1 AND 40 AS DOUBLE)), 6) AS with_heading, max(length(text)) FILTER (place = round_even(0.5 * (n - 1), 0)) AS p50, max(length(text)) FILTER (place = round_even(0.95 * (n - 1), 0)) AS p95 FROM (SELECT *, string_split(full_text, chr(10))[1] AS first, row_number() OVER (ORDER BY length(blocks.text)) - 1 AS place, count(*) OVER () AS n FROM blocks JOIN (SELECT doc_id, text AS full_text FROM documents) USING (doc_id))")
def index_health(spark, d):
    """Lines as chunks; a short first line is the heading of those after it."""
    return evaluation.health(tables.with_heading(sequences.lines(_docs(spark, d), head=True, start=False)).select("text", "heading"))


@query("SELECT source, count(*) AS docs, max(length(text)) AS longest, count(*) FILTER (contains(text, chr(10))) AS with_lines FROM documents GROUP BY source")
def index_stats(spark, d):
    return _docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.max(F.length("text")).cast("long").alias("longest"), F.count_if(F.contains("text", F.lit("\n"))).alias("with_lines"))


# --- conversations and prompts ---


def _messages(spark, d):
    return tables.table(spark, d, "conversations")


@query("SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10 GROUP BY conv_id")
def conversation_history(spark, d):
    return conversation.history(_messages(spark, d))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) >= 16 OR previous IS NULL THEN text ELSE previous || ' ' || text END AS question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations) WHERE role = 'user'")
def followup_query(spark, d):
    return conversation.retrieval_question(_messages(spark, d))


@query("SELECT conv_id, count(*) AS message_count, coalesce(arg_min(text, turn) FILTER (role = 'user'), '')[1:100] AS title FROM conversations GROUP BY conv_id")
def conversation_list(spark, d):
    return conversation.listing(_messages(spark, d))


@query("SELECT conv_id, string_agg('[' || upper(role) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def export_conversation(spark, d):
    return conversation.as_text(_messages(spark, d))


@query("SELECT item_id, sha256(concat_ws('|', text, 'None', coalesce(array_to_string(list_sort(CASE WHEN item_id % 2 = 0 THEN ['doc-' || item_id, 'doc-0'] END), ','), 'any'), 'p1', '5', '0.7', '512', 'True')) AS cache_key FROM benchmark")
def query_cache_key(spark, d):
    asked = tables.table(spark, d, "benchmark").withColumn("scope", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("doc-"), F.col("item_id"), F.lit(",doc-0"))))
    return asked.select("item_id", T.cache_key(F.col("text"), F.split("scope", ","), F.lit(None), F.lit("p1"), F.lit(5), F.lit("0.7"), F.lit(512), F.lit("True")).alias("cache_key"))


@query(f"""WITH asked AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Context: ' || text || ' Question: why?' ELSE 'Context: [Source 1: doc-' || doc_id || '] ' || text || ' Question: why?' END AS prompt FROM documents),
  found AS (SELECT *, array_to_string(string_split(trim(regexp_extract(prompt, '(?s)Context:(.*?)Question:', 1)), '. ')[1:3], '. ') || '.' AS answer FROM asked)
  SELECT doc_id, CASE WHEN NOT (contains(prompt, 'Context:') AND contains(prompt, 'Question:')) THEN '{K.NO_ANSWER.replace("'", "''")}' WHEN contains(answer, '[Source') THEN '{K.ANSWER_HEAD}' || answer || '{K.ANSWER_NOTE}' ELSE answer END AS answer FROM found""")
def extractive_fallback(spark, d):
    """Prompts without a context, with a plain one, and with one that names its source."""
    head = F.when(F.col("doc_id") % 3 == 1, F.lit("Context: ")).otherwise(F.concat(F.lit("Context: [Source 1: doc-"), "doc_id", F.lit("] ")))
    prompt = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(head, "text", F.lit(" Question: why?")))
    return _docs(spark, d).select("doc_id", T.extract_answer(prompt).alias("answer"))


@query("SELECT conv_id, CAST(sum(length(text) // 4) + 1 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def prompt_token_estimate(spark, d):
    return _messages(spark, d).groupBy("conv_id").agg((F.sum(T.prompt_tokens(F.col("text"))) + 1).alias("tokens"))


@query("SELECT conv_id, CASE WHEN 8000 - tokens <= 256 THEN NULL ELSE least(8000 - tokens, 4096) END AS room FROM (SELECT conv_id, CAST(sum(length(text) // 4) + 1 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)")
def output_budget(spark, d):
    """Output tokens under a ceiling of 8000, 4096 asked for, 256 at least; null where that can't be had."""
    return prompt_token_estimate(spark, d).select("conv_id", T.output_budget(F.lit(4096), F.lit(16384), F.lit(256), F.lit(8000), F.col("tokens")).alias("room"))


@query("SELECT conv_id, CASE WHEN ceiling IS NULL THEN budget WHEN ceiling - tokens <= 256 THEN NULL ELSE least(budget, ceiling - tokens) END AS room FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 400 END AS ceiling, greatest(coalesce(CASE WHEN conv_id % 3 = 0 THEN 100 WHEN conv_id % 3 = 1 THEN 300 END, 16384), 256) AS budget, CAST(sum(length(text) // 4) + 1 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id)")
def output_budgets(spark, d):
    """The same with no ceiling or one of 400, and for calls that ask for little, for more, or for what the model allows."""
    asked = F.when(F.col("conv_id") % 3 == 0, 100).when(F.col("conv_id") % 3 == 1, 300)
    ceiling = F.when(F.col("conv_id") % 2 == 0, 400)
    return prompt_token_estimate(spark, d).select("conv_id", T.output_budget(asked, F.lit(16384), F.lit(256), ceiling, F.col("tokens")).alias("room"))


_REFUSAL = "CASE doc_id % 5 WHEN 0 THEN 'Request too large: Limit ' || n_chars || ', Requested 9999' WHEN 1 THEN 'Rate limit reached on requests per day (RPD): Limit: ' || n_chars WHEN 2 THEN 'rate_limit_exceeded on tokens per minute: LIMIT ' || n_chars || ' used' WHEN 3 THEN 'tokens: no number here' ELSE text END"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(lower(message), 'token|too large|rate_limit|rate limit') AND NOT regexp_matches(lower(message), 'requests per|request per|\\(rpm\\)|\\(rpd\\)') THEN CAST(nullif(regexp_extract(message, '(?i)\\bLimit[\\s:]+(\\d{{3,}})', 1), '') AS BIGINT) END AS ceiling FROM (SELECT doc_id, {_REFUSAL} AS message FROM documents)")
def token_ceilings(spark, d):
    """What providers' refusals say of a token limit: by size, by requests (no token limit), by rate, without a number; and ordinary texts."""
    n = F.col("doc_id") % 5
    message = (
        F.when(n == 0, F.concat(F.lit("Request too large: Limit "), "n_chars", F.lit(", Requested 9999")))
        .when(n == 1, F.concat(F.lit("Rate limit reached on requests per day (RPD): Limit: "), "n_chars"))
        .when(n == 2, F.concat(F.lit("rate_limit_exceeded on tokens per minute: LIMIT "), "n_chars", F.lit(" used")))
        .when(n == 3, "tokens: no number here")
        .otherwise(F.col("text"))
    )
    return _docs(spark, d).select("doc_id", T.token_ceiling(message).alias("ceiling"))


@query("SELECT o_orderkey, CASE WHEN days <= 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN 'This Week' WHEN CAST(o_orderdate AS DATE) > CAST(newest - INTERVAL 1 MONTH AS DATE) THEN 'This Month' ELSE 'Older' END AS bucket FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), CAST(newest AS DATE)) AS days FROM orders, (SELECT max(o_orderdate) AS newest FROM orders))")
def recency_buckets(spark, d):
    orders = tables.table(spark, d, "orders")
    dated = orders.join(F.broadcast(orders.agg(F.max("o_orderdate").alias("newest")))).withColumn("days", F.date_diff("newest", "o_orderdate"))
    month = F.to_date("o_orderdate") > F.add_months(F.to_date("newest"), -1)
    bucket = F.when(F.col("days") <= 0, "Today").when(F.col("days") == 1, "Yesterday").when(F.col("days") < 7, "This Week").when(month, "This Month").otherwise("Older")
    return dated.select("o_orderkey", bucket.alias("bucket"))


# --- relational queries ---


@query("SELECT doc_id, source FROM documents WHERE source = 'src1' ORDER BY doc_id DESC LIMIT 20 OFFSET 10")
def project_documents_page(spark, d):
    return _docs(spark, d).where("source = 'src1'").orderBy(F.desc("doc_id")).offset(10).limit(20).select("doc_id", "source")


@query("SELECT source AS project, count(*) AS documents, count(DISTINCT lang) AS languages, coalesce(max(n), 0) AS conversations FROM documents LEFT JOIN (SELECT 'src' || conv_id % 40 AS source, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1) USING (source) GROUP BY source")
def project_counts(spark, d):
    docs = _docs(spark, d).groupBy(F.col("source").alias("project")).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("lang").alias("languages"))
    talks = _messages(spark, d).groupBy(F.concat(F.lit("src"), F.col("conv_id") % 40).alias("project")).agg(F.count_distinct("conv_id").alias("conversations"))
    return docs.join(talks, "project", "left").withColumn("conversations", F.coalesce("conversations", F.lit(0)))


@query("SELECT p_partkey, p_name FROM (SELECT *, nullif(p_brand, 'Brand#12') AS description FROM part) WHERE p_name ILIKE '%1_7%' OR description ILIKE '%#1%'")
def project_search(spark, d):
    """By name or description; some have no description, which is no match and no error."""
    rows = tables.table(spark, d, "part").withColumn("description", F.nullif("p_brand", F.lit("Brand#12")))
    return rows.where(F.ilike("p_name", F.lit("%1_7%")) | F.ilike("description", F.lit("%#1%"))).select("p_partkey", "p_name")


@query("SELECT source, count(*) AS docs, count(l.doc_id) AS labelled, round(100.0 * count(l.doc_id) / count(*), 1) AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def embedding_coverage(spark, d):
    """Rows with a companion (labels stand for embeddings): counts and percentage."""
    rows = _docs(spark, d).select("doc_id", "source").join(tables.table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count("has").alias("labelled"), F.round(100.0 * F.count("has") / F.count(F.lit(1)), 1).alias("percent"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_embeddings(spark, d):
    return _docs(spark, d).select("doc_id").join(tables.table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS documents, round(avg(length(text)), 6) AS avg_chars, max(length(text)) AS max_chars, min(length(text)) AS min_chars FROM documents")
def vector_store_stats(spark, d):
    n = F.length("text")
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source").alias("documents"), F.round(F.avg(n), 6).alias("avg_chars"), F.max(n).cast("long").alias("max_chars"), F.min(n).cast("long").alias("min_chars"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0.0::DOUBLE WHEN 'P' THEN 0.5::DOUBLE WHEN 'F' THEN 1.0::DOUBLE END AS progress FROM orders")
def status_progress(spark, d):
    s = F.col("o_orderstatus")
    return tables.table(spark, d, "orders").select("o_orderkey", F.when(s == "O", 0.0).when(s == "P", 0.5).when(s == "F", 1.0).alias("progress"))


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def parent_scope_chain(spark, d):
    """Rows that a scope at the top of a chain of parents owns: semi joins from the top down."""
    t = lambda n: tables.table(spark, d, n)
    nations = t("nation").join(t("region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT source, doc_count, recent FROM (SELECT source, count(*) AS doc_count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id DESC) FILTER (n <= 5) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) GROUP BY source)")
def export_project(spark, d):
    """Of each project the number of documents and its five newest: counted by partial sums, and ranked only as far as five."""
    docs = _docs(spark, d).select("source", "doc_id")
    newest = docs.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))).where("n <= 5")
    recent = newest.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("doc_id"), asc=False).cast("array<string>"), ",").alias("recent"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("doc_count")).join(recent, "source")


# --- monitoring ---

_WHEN = "(SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {} HOURS)"
_SUMMARY = "count(*) AS requests, coalesce(round(avg(value), 6), 0) AS avg_ms, coalesce(round(max(value), 6), 0) AS max_ms, coalesce(round(min(value), 6), 0) AS min_ms, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT user_id) AS users, coalesce(round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6), 0) AS error_rate"


@query(f"SELECT {_SUMMARY} FROM {_WHEN.format(24)}")
def api_summary(spark, d):
    return monitoring.api_summary(monitoring.since(tables.metrics(spark, d), 24))


@query("SELECT event_type AS endpoint, count(*) AS requests, round(avg(value), 6) AS avg_ms FROM events GROUP BY 1 ORDER BY requests DESC, endpoint LIMIT 10")
def top_endpoints(spark, d):
    return monitoring.top_endpoints(tables.metrics(spark, d))


@query("SELECT event_type AS service, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY ROLLUP (event_type)")
def cost_summary(spark, d):
    return monitoring.cost_summary(tables.table(spark, d, "events").select(F.col("event_type").alias("service"), F.col("user_id").alias("tokens"), F.col("value").alias("cost")))


@query("SELECT event_type AS error_type, count(*) AS n, max(ts) AS last_seen, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM events GROUP BY event_type")
def error_summary(spark, d):
    return monitoring.error_summary(tables.table(spark, d, "events").select(F.col("event_type").alias("error_type"), "ts"))


def _api_part(part: str, hours: int) -> str:
    return f"SELECT '{part}' AS part, unnest(['requests', 'errors', 'users']) AS name, unnest([requests, errors, users]) AS amount, unnest([avg_ms, CAST(error_rate AS DOUBLE), max_ms]) AS value FROM (SELECT {_SUMMARY} FROM {_WHEN.format(hours)})"


@query(
    f"""{_api_part('api 1 day', 24)} UNION ALL {_api_part('api 7 days', 168)}
    UNION ALL SELECT 'cost 30 days', coalesce(event_type, 'all'), CAST(sum(user_id) AS BIGINT), round(sum(value), 4) FROM {_WHEN.format(720)} GROUP BY ROLLUP (event_type)
    UNION ALL SELECT 'errors 1 day', event_type, count(*), CAST(sum(count(*)) OVER () AS DOUBLE) FROM {_WHEN.format(24)} GROUP BY event_type"""
)
def dashboard(spark, d):
    """Requests of a day and of a week, costs of 30 days and errors of a day: part, name, amount and value."""
    rows = tables.metrics(spark, d)
    spans = {name: monitoring.since(rows, hours) for name, hours in (("1 day", 24), ("7 days", 168), ("30 days", 720))}
    return monitoring.dashboard(spans["1 day"], spans["7 days"], spans["30 days"].select(F.col("endpoint").alias("service"), F.col("user_id").alias("tokens"), F.col("response_time_ms").alias("cost")), spans["1 day"].select(F.col("endpoint").alias("error_type"), "ts"))


@query(f"SELECT event_id FROM {_WHEN.format(240)}")
def retention_filter(spark, d):
    return monitoring.since(tables.table(spark, d, "events"), 240).select("event_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    return monitoring.latest(tables.table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


# --- digests, scenes, trees ---


@query("SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13))[1:1200] AS excerpt FROM documents")
def document_excerpt(spark, d):
    return _docs(spark, d).select("doc_id", F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, K.EXCERPT).alias("excerpt"))


_STOP = "(" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + ")"
_TOPICS = f"topics AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) - 1 AS position, topic, n FROM (SELECT doc_id, topic, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, lower(w[i]) AS topic, i AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]{{2,}}') AS w FROM documents))) WHERE topic NOT IN {_STOP} GROUP BY ALL) QUALIFY position < 6)"


@query(f"WITH {_TOPICS} SELECT * FROM topics")
def keyword_topics(spark, d):
    return digest.keyword_topics(_docs(spark, d)).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_TOPICS} SELECT DISTINCT 'project-' || source AS id, NULL::VARCHAR AS parent, 'project' AS kind, source AS label FROM documents UNION ALL SELECT 'doc-' || doc_id, 'project-' || source, 'document', 'doc-' || doc_id FROM documents UNION ALL SELECT 'doc-' || doc_id || '-topic-' || position, 'doc-' || doc_id, 'topic', topic FROM topics")
def topic_tree_nodes(spark, d):
    docs = _docs(spark, d)
    return digest.tree_nodes(docs.select("doc_id", F.col("source").alias("project")), digest.keyword_topics(docs))


@query(f"WITH {_TOPICS}, leaves AS (SELECT source AS root, doc_id, CAST(position AS VARCHAR) AS leaf FROM topics JOIN documents USING (doc_id)), placed AS (SELECT *, 60.0::DOUBLE * (row_number() OVER (PARTITION BY root ORDER BY doc_id, leaf) - 1) AS y FROM leaves), docs AS (SELECT root, doc_id, (min(y) + max(y)) / 2 AS y FROM placed GROUP BY ALL) SELECT root, doc_id, leaf, 448.0::DOUBLE AS x, y FROM placed UNION ALL SELECT root, doc_id, NULL, 224.0::DOUBLE, y FROM docs UNION ALL SELECT root, NULL, NULL, 0.0::DOUBLE, (min(y) + max(y)) / 2 FROM docs GROUP BY root")
def tree_layout(spark, d):
    docs = _docs(spark, d)
    leaves = digest.keyword_topics(docs).select("doc_id", F.col("position").cast("string").alias("leaf")).join(docs.select("doc_id", F.col("source").alias("root")), "doc_id")
    return sequences.tree_layout(leaves)


_FLATTEN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_SHORT = "CASE WHEN length({0}) <= 120 THEN {0} ELSE regexp_replace(CASE WHEN contains({0}[1:120], ' ') THEN regexp_extract({0}[1:120], '^(.*) ', 1) ELSE {0}[1:120] END, '[ ,;:-]+$', '') || '…' END"


@query(f"SELECT doc_id, {_SHORT.format('s')} AS short FROM (SELECT doc_id, {_FLATTEN} AS s FROM documents)")
def shorten_lines(spark, d):
    return _docs(spark, d).select("doc_id", T.shortened(F.col("text")).alias("short"))


@query(f"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(regexp_replace({_FLATTEN}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[.!?]$') AND len(string_split(s, ' ')) >= 3)[1:4], lambda s: {_SHORT.format('s')}), '|') AS sentences FROM documents")
def leading_sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.leading_sentences(F.col("text")), "|").alias("sentences"))


_SECONDS = f"CAST(round_even(greatest(1.0::DOUBLE, len(list_filter(string_split({_FLATTEN}, ' '), lambda w: w <> '')) / 2.6::DOUBLE), 0) AS BIGINT)"


@query(f"SELECT conv_id, turn, {_SECONDS} AS seconds FROM conversations")
def scene_seconds(spark, d):
    return _messages(spark, d).select("conv_id", "turn", digest.scene_seconds().alias("seconds"))


@query(f"SELECT conv_id, turn, seconds, CAST(coalesce(sum(seconds) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts FROM (SELECT conv_id, turn, {_SECONDS} AS seconds FROM conversations)")
def scene_timeline(spark, d):
    return sequences.timeline(scene_seconds(spark, d), "conv_id", "turn")


# --- lines, pages, times ---

_AT = f"{_LINES}, placed AS (SELECT doc_id, line, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM blocks)"


@query(f"WITH {_AT} SELECT doc_id, line, start, md5(text) AS text FROM placed")
def line_blocks(spark, d):
    return sequences.lines(_docs(spark, d)).select("doc_id", F.col("line").cast("long").alias("line"), F.col("start").cast("long").alias("start"), F.md5("text").alias("text"))


@query(f"WITH {_AT}, ends AS (SELECT doc_id, line AS page, sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY line) AS until FROM blocks), f AS (SELECT p.doc_id, p.line, min(e.page) FILTER (e.until > p.start) AS page, max(e.page) AS last FROM placed p JOIN ends e USING (doc_id) GROUP BY ALL) SELECT doc_id, line, coalesce(page, last) AS page FROM f")
def page_attribution(spark, d):
    rows = sequences.lines(_docs(spark, d))
    return sequences.page_of(rows, rows.select("doc_id", F.col("line").alias("page"), F.length("text").alias("size"))).select("doc_id", F.col("line").cast("long").alias("line"), F.col("page").cast("long").alias("page"))


@query(f"WITH {_LINES} SELECT doc_id, line, round((row_number() OVER w - 1) * 600.0::DOUBLE / count(*) OVER (PARTITION BY doc_id), 6) AS ts_start, round((row_number() OVER w) * 600.0::DOUBLE / count(*) OVER (PARTITION BY doc_id), 6) AS ts_end FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY line)")
def time_slices(spark, d):
    return sequences.time_slices(sequences.lines(_docs(spark, d), start=False), F.lit(600.0)).select("doc_id", F.col("line").cast("long").alias("line"), "ts_start", "ts_end")


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS s FROM events), f AS (SELECT *, CASE WHEN s - lag(s) OVER w > 3600000000 THEN 1 ELSE 0 END AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) SELECT event_id, user_id, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM f")
def gap_paragraphs(spark, d):
    rows = tables.table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"))
    return sequences.gap_groups(rows, "user_id", "s", F.col("s"), 3_600_000_000, "event_id").select("event_id", "user_id", F.col("part").cast("long").alias("part"))


# --- cleaning, pages, chunks ---

_NOISE = "regexp_matches(x, '(?i)" + "|".join(f"(?:{p})" for p in K.NOISE_LINES) + "')"


@query(f"WITH {_LINES} SELECT doc_id, line, {_NOISE.replace('x,', 'text,')} OR {_any('text', K.CITATION_MARKS, 2)} AS noise FROM blocks")
def noise_lines(spark, d):
    return sequences.lines(_docs(spark, d), start=False).select("doc_id", F.col("line").cast("long").alias("line"), T.is_noise(F.col("text")).alias("noise"))


@query("SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])', '\\1\\2', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: NOT (regexp_matches(x, '(?i)^page\\s+\\d+(\\s+of\\s+\\d+)?$') OR (regexp_matches(x, '^[\\d\\s\\-–—.·|/()\\[\\]]+$') AND regexp_matches(x, '\\d')))), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text FROM documents")
def pdf_clean(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.pdf_clean(F.col("text"))).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[.*?\\]', '', 'g'), '\\(.*?\\)', '', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def transcript_clean(spark, d):
    return _docs(spark, d).select("doc_id", T.transcript_clean(F.col("text")).alias("text"))


def _spoken() -> str:
    line = f"regexp_replace(x, '{K.LINE_MARKS}', '')"
    for _ in range(2):
        line = f"regexp_replace({line}, '{K.EMPHASIS}', '\\1\\2\\3\\4', 'g')"
    line = f"trim(regexp_replace(regexp_replace(regexp_replace({line}, '{K.RULE}', ''), '{K.UNSPOKEN}', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ')"
    text = f"regexp_replace(regexp_replace(regexp_replace(text, '{K.FENCE}', ' ', 'g'), '{K.CODE}', '\\1', 'g'), '{K.LABELLED}', '\\1', 'g')"
    return f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {line}), lambda x: x <> ''), chr(10)) AS spoken FROM documents"


@query(_spoken())
def markdown_to_speech(spark, d):
    return _docs(spark, d).select("doc_id", T.speech(F.col("text")).alias("spoken"))


def _read(text: str) -> str:
    """SQL: the character references of the pages replaced; as in HTML their last semicolon may be missing."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return text


_TITLE = _read("regexp_extract(html, '<title>(.*?)</title>', 1)")


@query(f"SELECT page_id, trim({_TITLE}) AS title FROM pages")
def html_title(spark, d):
    return html.metadata(tables.table(spark, d, "pages")).select("page_id", F.coalesce("title", F.lit("")).alias("title"))


_META = ", ".join(f"""nullif(regexp_extract(html, '(?is)<meta[^>]*\\s(?:name|property)="{n.replace("_", ":")}"[^>]*\\scontent="([^"]*)"', 1), '') AS {n}""" for n in html.META)


@query(f"""SELECT page_id, nullif(trim({_TITLE}), '') AS title, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS domain, {_META} FROM pages""")
def html_metadata(spark, d):
    return html.metadata(tables.table(spark, d, "pages"))


@query("""WITH a AS (SELECT page_id, url, regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '(?is)<a [^>]*>.*?</a>') AS found FROM pages),
  l AS (SELECT page_id, url, i - 1 AS position, regexp_extract(found[i], '(?is)\\shref="([^"]*)"', 1) AS href, trim(regexp_replace(found[i], '(?is)<[^>]*>', '', 'g')) AS text FROM (SELECT page_id, url, list_filter(found, lambda x: NOT regexp_matches(x, 'href="(#|")')) AS found, unnest(range(1, len(list_filter(found, lambda x: NOT regexp_matches(x, 'href="(#|")'))) + 1)) AS i FROM a))
  SELECT page_id, position, href, replace(text, '&amp;', '&')[1:100] AS text, regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) IN ('', regexp_extract(url, '//([^/?#]*)', 1)) AS is_internal FROM l WHERE position < 100""")
def html_links(spark, d):
    return html.links(tables.table(spark, d, "pages")).withColumn("position", F.col("position").cast("long"))


_TAGS = "|".join(t for t in K.PRUNED if t.isalpha())


@query(f"""WITH cut AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]*>|[^<]+') AS t FROM pages),
  tok AS (SELECT page_id, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM cut),
  placed AS (SELECT *, sum(CASE WHEN regexp_matches(token, '^<({_TAGS})[ >]') THEN 1 WHEN regexp_matches(token, '^</({_TAGS})>') THEN -1 ELSE 0 END) OVER w AS pruned, last_value(CASE WHEN regexp_matches(token, '^</?h[1-6][ >]') THEN pos END IGNORE NULLS) OVER w AS mark FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
  heads AS (SELECT p.page_id, p.mark AS pos, h.token[3]::INT AS level, 'h' || h.token[3] AS tag, trim(regexp_replace(string_agg(p.token, '' ORDER BY p.pos), '\\s+', ' ', 'g')) AS text FROM placed p JOIN tok h ON h.page_id = p.page_id AND h.pos = p.mark WHERE p.pruned = 0 AND p.token[1] <> '<' AND h.token[2] = 'h' GROUP BY ALL)
  SELECT page_id, CAST(pos AS INT) AS pos, level, tag, {_read('text')} AS text FROM heads WHERE text <> ''""")
def html_headings(spark, d):
    return html.headings(tables.table(spark, d, "pages"))


@query()
def html_text(spark, d):
    return html.texts(tables.table(spark, d, "pages")).select("page_id", T.clean(F.col("text")).alias("text"))
