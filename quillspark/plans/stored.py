"""Queries that write, change and read back stored tables, and that replay streams."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import chunking, monitoring, retrieval, udtf, upkeep
from ..sources import snapshots, stores, tables
from ..sources.shared import shared_dir, written
from ..streaming import replays
from .catalogue import _docs
from .chunks import _LAST, _PASSAGE, _PLACED, _passage, placed
from .chunks_sql import chunks
from .registry import query


def _new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH RECURSIVE {chunks('documents')} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, start_char, end_char, heading_path, {_LAST} AS section, text FROM chunks")
def chunk_table_function(spark, d):
    """The chunker from SQL, over a table dealt by document."""
    udtf.register(spark)
    return spark.sql("SELECT * FROM chunk_text(TABLE({docs}) PARTITION BY doc_id)", docs=_docs(spark, d).select("doc_id", "text"))


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'Changed. ' || text ELSE text END AS text FROM documents WHERE doc_id % 50 <> 25)"


@query(f"WITH RECURSIVE {chunks(_CHANGED)} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, md5(text) AS text FROM chunks")
def chunk_store(spark, d):
    """A store of all chunks, in which then some documents' chunks are replaced and others' go."""
    docs, path = _docs(spark, d).select("doc_id", "text"), _new(spark, "chunk-store")
    stores.create(chunking.chunked(docs), path)
    changed = docs.where("doc_id % 50 = 0").withColumn("text", F.concat(F.lit("Changed. "), "text"))
    stores.replace(chunking.chunked(changed), docs.where("doc_id % 25 = 0"), path)
    return spark.read.parquet(path).select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("text"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def upsert_stream(spark, d):
    """Events as a stream of batches that are brought into a table of each user's newest one."""
    columns = ["user_id", "ts", "event_id", "event_type"]
    events = written(tables.table(spark, d, "events").select(*columns).repartition(3), "events")
    table = stores.Versioned(spark, _new(spark, "newest"), events._jdf.schema().toDDL(), "user_id")
    newest = lambda rows: monitoring.newest(rows, ["part", "user_id"], F.struct("ts", "event_id"))
    replays.replayed(replays.stream(spark, events._written_to, events.schema), _new(spark, "upsert-log"), lambda rows, batch: table.upsert(rows, batch, newest))
    return table.read().select(*columns)


_KEYS = f"WITH RECURSIVE {_PLACED}, keys AS (SELECT doc_id, sha256('passage: ' || {_PASSAGE} || 'True') AS key FROM placed_chunks)"


@query(f"{_KEYS}, known AS (SELECT DISTINCT key FROM keys WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT 1 AS run, count(*) AS passages, (SELECT count(*) FROM known) AS encoded FROM keys WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 2, count(*), count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM known)) FROM keys UNION ALL SELECT 3, count(*), 0 FROM keys")
def encode_memo(spark, d):
    """Passages encoded in three runs with a memo: those of labelled documents, all, and all again. What a run finds in the memo it doesn't encode."""
    rows = placed(spark, d)
    texts = rows.select("doc_id", retrieval.chunk_id(rows).alias("id"), _passage().alias("text"))
    memo, counts = stores.Memo(spark, _new(spark, "memo")), []
    for run, part in enumerate((texts.join(tables.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), texts, texts), 1):
        fresh = memo.fresh(upkeep.keyed(part, "passage"))
        counts.append((run, part.count(), memo.remember(upkeep.normalised(retrieval.hashed_features(fresh)))))
    memo.forget()
    return spark.createDataFrame(counts, "run int, passages long, encoded long")


@query(f"{_KEYS}, stored AS (SELECT DISTINCT key FROM keys WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT source AS project, count(DISTINCT doc_id) AS documents, count(key) AS chunks, count(key) FILTER (key IN (SELECT key FROM stored)) AS embedded, CASE WHEN count(key) = 0 THEN '0%' ELSE printf('%.1f%%', 100.0::DOUBLE * embedded / count(key)) END AS coverage FROM documents LEFT JOIN keys USING (doc_id) GROUP BY source")
def chunk_coverage(spark, d):
    """Of each project's chunks those whose passage has a vector in the store: documents, their chunks, and the vectors by key."""
    rows = placed(spark, d)
    keyed = upkeep.keyed(rows.select("doc_id", retrieval.chunk_id(rows).alias("id"), _passage().alias("text")), "passage").select("id", "key")
    keyed = keyed.withColumn("doc_id", F.floor(F.col("id") / retrieval.CHUNK_IDS).cast("long"))
    have = keyed.join(tables.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("key").distinct().withColumn("stored", F.lit(1))
    chain = _docs(spark, d).select("doc_id", F.col("source").alias("project")).join(keyed.join(have, "key", "left"), "doc_id", "left")
    out = chain.groupBy("project").agg(F.count_distinct("doc_id").alias("documents"), F.count("key").alias("chunks"), F.count("stored").alias("embedded"))
    return out.withColumn("coverage", F.coalesce(monitoring.percentage(F.col("embedded"), F.col("chunks")), F.lit("0%")))


@query(f"WITH RECURSIVE {chunks('(SELECT doc_id, CASE WHEN doc_id % 40 <> 0 THEN text END AS text FROM documents)')} SELECT doc_id, CASE WHEN count(chunk_index) > 0 THEN 'ready' ELSE 'error' END AS status, count(chunk_index) AS chunks, CAST(2 AS BIGINT) AS states FROM documents LEFT JOIN chunks USING (doc_id) GROUP BY doc_id")
def ingest_states(spark, d):
    """Documents that come in as a stream of files: every document's last state, and how many it went through. Some come without a text."""
    docs = written(tables.spread(_docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 40 != 0, F.col("text")).alias("text"))), "incoming")
    path, log = _new(spark, "states"), _new(spark, "ingest-log")
    files = math.ceil(len(docs.inputFiles()) / 4)  # four batches, of as many files as there are
    replays.ingest(replays.stream(spark, docs._written_to, docs.schema, max(1, files)), chunking.chunked, path, log)
    states = spark.read.parquet(path)
    last = F.max_by(F.struct("status", "chunks"), "step").alias("last")
    return states.groupBy("doc_id").agg(last, F.count(F.lit(1)).alias("states")).select("doc_id", "last.status", "last.chunks", "states")


_TTL = 6 * 3600


@query(f"""WITH RECURSIVE asked AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  run AS (SELECT user_id, n, moment AS since, FALSE AS hit FROM asked WHERE n = 1 UNION ALL SELECT r.user_id, a.n, CASE WHEN a.moment - since <= {_TTL} THEN since ELSE a.moment END, a.moment - since <= {_TTL} FROM run r JOIN asked a ON a.user_id = r.user_id AND a.n = r.n + 1)
  SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, printf('%.1f%%', 100.0::DOUBLE * hits / (hits + misses)) AS hit_rate FROM run GROUP BY user_id""")
def cache_lifetimes(spark, d):
    """Events as questions to a cache whose answers live six hours from when they were stored: hits and misses of each user."""
    asked = tables.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    log, path = _new(spark, "asked"), _new(spark, "answers")
    replays.logged(asked, "at", "key", log)
    ordered = replays.stream(spark, log, asked.schema, 4)
    replays.replayed(replays.cache_answers(ordered, _TTL), _new(spark, "cache-log"), replays.stored(path))
    out = spark.read.parquet(path).groupBy(F.col("key").alias("user_id")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return out.withColumn("hit_rate", monitoring.hit_rate(F.col("hits"), F.col("misses")))


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), parts AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS part FROM gaps)
  SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM parts GROUP BY user_id, part""")
def session_stream(spark, d):
    """Sessions of users, from a stream of files in any order: a pause of twelve hours ends one. A last row of no user, long after all, closes them."""
    events = tables.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts")
    log, path = _new(spark, "log"), _new(spark, "sessions")
    events.repartition(3).write.parquet(log)
    closing.write.mode("append").parquet(log)
    found = replays.sessions(replays.stream(spark, log, events.schema), "user_id", "12 hours", "400 days")
    replays.replayed(found, _new(spark, "session-log"), replays.stored(path))
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")]
    return spark.read.parquet(path).where("user_id IS NOT NULL").select("user_id", *plain, "events")


@query("SELECT page_id, url, md5(html) AS html, page_id % 3 = 0 AS fetched FROM pages")
def page_snapshots(spark, d):
    """Pages from a folder of snapshots, and those that it has not from the table, as a crawler would fetch them."""
    snapshots.register(spark)
    pages, path = tables.table(spark, d, "pages").select("page_id", "url", "html"), _new(spark, "snapshots")
    pages.where("page_id % 3 <> 0").write.json(path)
    stored = spark.read.format("page_snapshots").load(path)
    fetched = pages.join(stored.select("page_id"), "page_id", "left_anti")
    rows = stored.withColumn("fetched", F.lit(False)).unionByName(fetched.withColumn("fetched", F.lit(True)))
    return rows.withColumn("html", F.md5("html"))
