"""Stored tables that change, streams that are replayed, chunks that are placed and found."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, headings, monitoring, retrieval, udtf, upkeep
from quillspark.sources import stores
from quillspark.streaming import replays


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, text string")


def test_replace_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(d, k, f"{d}-{k}") for d in range(200) for k in range(d % 3 + 1)]
    stores.create(_rows(spark, first), path)
    before = _files(path)
    gone = spark.createDataFrame([(3,), (4,), (999,)], "doc_id long")
    new = _rows(spark, [(3, 0, "new"), (999, 0, "more")])
    parts = {r["part"] for r in gone.select(stores._part("doc_id").alias("part")).collect()}
    for _ in range(2):  # again: the same rows
        stores.replace(new, gone, path)
        found = sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in spark.read.parquet(path).collect())
        assert found == sorted([x for x in first if x[0] not in (3, 4)] + [(3, 0, "new"), (999, 0, "more")])
    after = _files(path)
    kept = {p: t for p, t in before.items() if not any(f"part={k}/" in p for k in parts)}
    assert kept and kept == {p: t for p, t in after.items() if not any(f"part={k}/" in p for k in parts)}


def test_replace_may_empty_a_partition(spark, tmp_path):
    path = str(tmp_path / "store")
    stores.create(_rows(spark, [(1, 0, "a"), (2, 0, "b")]), path)
    stores.replace(_rows(spark, []), spark.createDataFrame([(1,)], "doc_id long"), path)
    assert [r["doc_id"] for r in spark.read.parquet(path).collect()] == [2]


def _newest(rows):
    return monitoring.newest(rows, ["part", "k"], F.col("t"))


def test_upsert_switches_at_once(spark, tmp_path):
    table = stores.Versioned(spark, str(tmp_path / "table"), "k long, t long, v string", "k")
    frame = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    read = lambda: sorted(tuple(r) for r in table.read().collect())
    assert read() == []
    assert table.upsert(frame([(k, 1, "a") for k in range(50)]), 0, _newest)
    assert table.upsert(frame([(1, 2, "b"), (2, 0, "old"), (70, 1, "c")]), 1, _newest)
    wanted = sorted([(k, 1, "a") for k in range(50) if k != 1] + [(1, 2, "b"), (70, 1, "c")])
    assert read() == wanted
    assert not table.upsert(frame([(1, 9, "again")]), 1, _newest) and read() == wanted  # a batch that comes again changes nothing

    def fails(rows):
        return rows.withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("midway"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="midway"):
        table.upsert(frame([(5, 9, "x"), (6, 9, "x")]), 2, fails)
    assert read() == wanted
    assert table.upsert(frame([(5, 9, "x")]), 2, _newest) and (5, 9, "x") in read()


def test_memo_makes_each_key_once(spark, tmp_path):
    memo = stores.Memo(spark, str(tmp_path / "memo"))
    texts = lambda rows: upkeep.keyed(spark.createDataFrame(rows, "id long, text string"), "passage")
    make = lambda rows: upkeep.normalised(retrieval.hashed_features(memo.fresh(rows)))
    first = texts([(1, "some words"), (2, "some words"), (3, "other words")])
    assert memo.remember(make(first)) == 2
    assert memo.remember(make(texts([(4, "some words"), (5, "third one")]))) == 1
    assert memo.remember(make(first)) == 0
    known = {r["key"]: r["vector"] for r in memo.known().collect()}
    assert len(known) == 3 and all(abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == retrieval.DIMENSIONS for v in known.values())
    plan = memo.fresh(texts([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    memo.forget()


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    folder, log, path = (str(tmp_path / x) for x in ("in", "log", "out"))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    frame([(1, "a line"), (2, None), (3, "")]).coalesce(1).write.parquet(folder)
    run = lambda: replays.ingest(replays.stream(spark, folder, "doc_id long, text string"), chunking.chunked, path, log)
    run()
    states = lambda: sorted((r["doc_id"], r["step"], r["status"], r["chunks"]) for r in spark.read.parquet(path).collect())
    first = [(1, 0, "queued", 0), (1, 1, "ready", 1), (2, 0, "queued", 0), (2, 1, "error", 0), (3, 0, "queued", 0), (3, 1, "error", 0)]
    assert states() == first
    run()
    assert states() == first
    frame([(4, "more")]).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert states() == [*first, (4, 0, "queued", 0), (4, 1, "ready", 1)]


def test_cache_lifetimes(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    asked = [(1, 1, 0.0), (1, 2, 5.0), (1, 3, 10.0), (1, 4, 10.5), (1, 5, 21.0), (2, 6, 4.0), (2, 7, 14.0)]
    replays.logged(spark.createDataFrame(asked, "key long, id long, at double"), "at", "key", folder, files=1)
    hits = replays.cache_answers(replays.stream(spark, folder, "key long, id long, at double"), 10)
    replays.replayed(hits, str(tmp_path / "log"), replays.stored(out))
    # A hit at 5 doesn't prolong the answer of 0, which lives until 10.
    assert {r["id"]: r["hit"] for r in spark.read.parquet(out).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True}


def _slow_blocks(text):
    """Blocks by a stack, as one reads them."""
    stack, out = [], []
    for k, line in enumerate(text.split("\n")):
        bare = line.strip()
        if m := re.match(r"^(#{1,6})\s+(.*\S)\s*$", bare):
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), m[2])]
        elif bare:
            out.append((k, bare, " > ".join(t for _, t in stack) or None))
    return out


def test_blocks_and_table_function(spark):
    chance = random.Random(6)
    lines = ["# A", "## B", "### C", "#### D", "###### F", "text of a line", "  indented ", "", "#no heading", "# ", "word " * 200, "Dr. Who said so. Then he left! Why? " * 20, "x" * 1100]
    texts = [(k, "\n".join(chance.choices(lines, k=chance.randrange(0, 25)))) for k in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted((r["doc_id"], r["line"], r["text"], r["path"]) for r in headings.blocks(docs).collect())
    assert found == sorted((d, *b) for d, t in texts if t for b in _slow_blocks(t))
    for r in headings.blocks(docs).collect():
        assert dict(texts)[r["doc_id"]][r["start_char"] : r["end_char"]] == r["text"]
    udtf.register(spark)
    rows = spark.sql("SELECT * FROM chunk_text(TABLE({docs}) PARTITION BY doc_id)", docs=docs).collect()
    key = lambda r: (r["doc_id"], r["chunk_index"])
    assert sorted(rows, key=key) == sorted(chunking.chunked(docs).collect(), key=key)


def test_retrieval_in_scope(spark):
    chunks = spark.createDataFrame([(1, "Engines", "spark plans a query"), (2, None, "spark plans a query"), (3, "Birds", "an owl sleeps"), (4, "Owls", "they sleep by day")], "id long, heading_path string, text string")
    questions = spark.createDataFrame([(1, "owl sleeps"), (2, "nothing of it"), (3, "engines")], "query_id long, question string")
    vector = lambda rows, role: upkeep.encoded(rows, retrieval.hashed_features, role).select("id", "vector")
    asked = vector(questions.select(F.col("query_id").alias("id"), F.col("question").alias("text")), "query")
    found = lambda rows: {(r["query_id"], r["source"]): r["id"] for r in retrieval.hybrid(rows, vector(rows.select("id", "text"), "passage"), questions, asked).collect()}
    best = found(chunks)
    assert best[1, 1] == 3 and best[3, 1] in (1, 2)  # the heading is searched too
    assert len({best.get((3, k)) for k in range(1, 6)} & {1, 2}) == 1  # of equal texts one stays
    assert 3 not in found(chunks.where("id <> 3")).values()
    assert found(chunks.where("false")) == {}


def test_page_snapshots(spark, tmp_path):
    from quillspark.sources import snapshots

    snapshots.register(spark)
    lines = ['{"page_id": 1, "url": "http://h/ü", "html": "<p>é</p>"}', "", '{"page_id": 2, "html": null}', '{"page_id": 3, "url": "u", "html": "x", "more": 1}']
    (tmp_path / "a.json").write_text("\n".join(lines[:3]))
    (tmp_path / "b.json").write_text(lines[3] + "\n")
    (tmp_path / "c.txt").write_text("no snapshot")
    pages = spark.read.format("page_snapshots").load(f"file://{tmp_path}")
    assert sorted(tuple(r) for r in pages.collect()) == [(1, "http://h/ü", "<p>é</p>"), (2, None, None), (3, "u", "x")]
    assert pages.rdd.getNumPartitions() == 2
    assert [r["page_id"] for r in pages.where("page_id IN (2, 3) AND url IS NOT NULL").collect()] == [3]
