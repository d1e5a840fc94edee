"""What operators shuffle, hold and read at once does not grow with the square of a table, a partition or a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import arrow
from quillspark.operators import chunking, digest, lexical, retrieval, upkeep, vectors


def _asked(spark):
    words = ["red", "green", "blue", "old", "new"]
    docs = spark.createDataFrame([(i, " ".join(words[k] for k in range(5) if i >> k & 1) + " word" * (i % 3)) for i in range(64)], "doc_id long, text string")
    questions = spark.createDataFrame([(q, f"{words[q % 5]} {words[(q + 2) % 5]} word {q}") for q in range(9)] + [(3, "word"), (99, "nowhere")], "query_id long, question string")
    return docs, questions


def test_best_shuffles_only_the_best_of_each_task(spark):
    docs, questions = _asked(spark)
    rows = lexical.scores(docs, questions, 2)[0]
    assert rows.count() <= 4 * 2 * 9  # as many tasks as cores
    every = lexical.ranked(lexical.bm25(docs, questions), 2)
    assert lexical.bm25(docs, questions).count() > 300
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())
    assert key(lexical.ranked(rows, 2)) == key(every) and len(key(every)) == 18


def test_best_in_batches_and_with_dense_terms(spark, monkeypatch):
    docs, questions = _asked(spark)
    key = lambda dfs: [sorted((r["query_id"], r["doc_id"], round(r["score"], 6)) for r in lexical.ranked(x, 3).collect()) for x in dfs]
    whole = key(lexical.scores(docs, questions, 3, names=("bm25", "count")))
    monkeypatch.setattr(lexical, "DENSE_SHARE", 2.0)  # no term is dense
    monkeypatch.setattr(lexical, "HELD", 40)
    assert key(lexical.scores(docs, questions, 3, names=("bm25", "count"))) == whole
    monkeypatch.setattr(lexical, "BATCH", 4)
    assert key(lexical.scores(docs, questions, 3, names=("bm25", "count"))) == whole


def test_many_questions_take_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 50} w{i % 7} common") for i in range(300)], "doc_id long, text string")
    questions = spark.range(8500).select(F.col("id").alias("query_id"), F.concat(F.lit("w"), F.col("id") % 60, F.lit(" common")).alias("question"))
    names = []
    monkeypatch.setattr(lexical, "written", lambda df, name, real=lexical.written: names.append(name) or real(df, name))
    assert lexical.best(docs, questions, 1).count() == 8500
    assert names == ["terms"]  # before: tokens, and terms and scores of each 8,192 questions


def _in_process(docs, questions, k, part, monkeypatch):
    """What `_scored` finds of documents (lists of counts by term) in this process, and how many exact scores it makes."""
    asked = lexical._Asked((q, [str(t) for t in terms]) for q, terms in enumerate(questions))
    number = {int(t): i for i, t in enumerate(asked.words)}
    rows = [sorted((number[t], n) for t, n in d.items() if t in number) for d in docs]
    lists = lambda i: pa.array([[x[i] for x in r] for r in rows], pa.list_(pa.int32()))
    ids = list(range(len(docs)))[::-1]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([sum(d.values()) for d in docs], pa.int64()), lists(0), lists(1)], names=["doc_id", "n", "terms", "counts"])
    share = np.bincount([t for r in rows for t, _ in r], minlength=len(number)) / len(docs)

    class Frame:
        sparkSession = type("Session", (), {"sparkContext": type("Context", (), {"defaultParallelism": 1})})
        rdd = type("Rdd", (), {"getNumPartitions": staticmethod(lambda: 1)})
        where = lambda self, _: self
        mapInArrow = lambda self, run, _: run

    made = []
    monkeypatch.setattr(lexical._Block, "exact", lambda self, asked, q, d, real=lexical._Block.exact: made.append(len(q)) or real(self, asked, q, d))
    worth = lambda term, tf, n: part(np.array([int(w) for w in words])[term], tf, n)
    words = list(asked.words)
    found = pa.Table.from_batches(lexical._scored(Frame(), asked, share, worth, k)([batch])).to_pydict()
    every = np.zeros((len(questions), len(docs)))  # by doc_id
    for i, d in enumerate(docs):
        term, tf = np.array(list(d)), np.array(list(d.values()))
        adds = np.zeros(500)
        adds[term] = part(term, tf, np.full(len(term), sum(d.values())))
        every[:, ids[i]] = [adds[terms].sum() for terms in questions]
    return {(q, d): s for q, d, s in zip(found["query_id"], found["doc_id"], found["score"], strict=True)}, every, sum(made)


def _best_of(every, k):
    order = np.argsort(-np.round(every, 6), axis=1, kind="stable")[:, :k]
    return {(q, int(d)) for q, ds in enumerate(order) for d in ds if every[q, d] > 0}


def test_bounds_leave_out_most_documents_and_none_of_the_best(monkeypatch):
    rng = np.random.default_rng(5)
    words = lambda n: np.minimum(rng.zipf(1.4, n), 400).tolist()
    docs = [{t: x.count(t) for t in set(x)} for x in (words(int(n)) for n in rng.integers(1, 60, 3000))]
    docs[7:27] = [docs[7]] * 20  # ties
    questions = [words(int(n)) for n in rng.integers(1, 25, 40)] + [list(docs[7]), [401], [1], words(3000)]
    part = lambda term, tf, n: np.log1p(term) * tf * 2.2 / (tf + 0.3 + n / 30)
    for patched in ({}, {"FIRST": 64, "DOCUMENTS": 500}, {"FIRST": 100, "HELD": 900, "DENSE_SHARE": 2.0, "LOOKED_UP": 50}, {"DENSE_SHARE": 0.0}):
        for name, value in patched.items():
            monkeypatch.setattr(lexical, name, value)
        found, every, exact = _in_process(docs, questions, 3, part, monkeypatch)
        assert set(found) == _best_of(every, 3) and all(abs(s - every[x]) < 1e-8 for x, s in found.items())
        assert exact < 0.05 * len(docs) * len(questions)
        monkeypatch.undo()
    found, every, _ = _in_process(docs[:300], questions, None, part, monkeypatch)
    assert set(found) == set(zip(*(x.tolist() for x in np.nonzero(every)), strict=True))


def test_best_counts_documents_without_id(spark):
    docs, questions = _asked(spark)
    more = docs.withColumn("doc_id", F.when(F.col("doc_id") != 63, F.col("doc_id")))
    scores = lambda df: {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in lexical.best(df, questions, 70).collect()}
    assert {k: v for k, v in scores(docs).items() if k[1] != 63} == scores(more)


def test_pieces_and_best():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["aaaa", None, "bbb", "c" * 20])], names=["doc_id", "text"])
    assert [p.num_rows for p in arrow.pieces([batch], most=7)] == [3, 1] and [p.num_rows for p in arrow.pieces([batch], most=1)] == [1, 1, 1, 1]
    rng = np.random.default_rng(1)
    scores, keys = np.round(rng.random((90, 7)), 1), rng.permutation(90)
    best = arrow.Best(7, 4, 0.2)
    for a in range(0, 90, 11):
        best.add(keys[a : a + 11], scores[a : a + 11])
    want = {(q, k) for q in range(7) for _, k in sorted((-s, k) for s, k in zip(scores[:, q], keys, strict=True) if s >= 0.2)[:4]}
    assert set(zip(best.found[0].tolist(), best.found[1].tolist(), strict=True)) == {(q, int(k)) for q, k in want}


def test_chunker_takes_a_batch_in_pieces(spark):
    texts = {i: f"# Head {i}\n" + f"some words of {i} stand here. " * 2000 for i in range(12)}
    assert sum(map(len, texts.values())) > arrow.PIECE  # one batch, several pieces
    found = chunking.chunked(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()
    want = [(i, k, c.text) for i, t in texts.items() for k, c in enumerate(chunking.chunks_of(t))]
    assert sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in found) == sorted(want)


def test_topics_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "Geese and geese, boats. It's it's Boats boats"), (2, None), (3, ""), (4, "the and of")], "doc_id long, text string").repartition(8)
    found = digest.keyword_topics(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert [(r["doc_id"], r["position"], r["topic"], r["n"]) for r in found.collect()] == [(1, 0, "boats", 3), (1, 1, "geese", 2), (1, 2, "it's", 2)]


def test_texts_without_headings_are_not_joined(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "geese geese")], "doc_id long, text string")
    heads = spark.createDataFrame([(1, 0, "Top")], "doc_id long, at int, path string")
    found = digest.structural_topics(heads, docs)
    assert sorted((r["doc_id"], r["topic"]) for r in found.collect()) == [(1, "Top"), (2, "geese")]


def test_a_task_leaves_its_best_vectors(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "id long, vector array<double>").coalesce(1)
    asked = [(0, [1.0, 0.0]), (1, [-1.0, 0.5])]
    monkeypatch.setattr(vectors, "HELD", 64)
    assert vectors.batch_search(rows, asked, 3).count() == 6
    best = {q: [r["id"] for r in lexical.ranked(vectors.batch_search(rows, asked, 3), 3, "id").where(F.col("query_id") == q).orderBy("rank").collect()] for q in (0, 1)}
    assert best == {0: [6, 13, 20], 1: [0, 7, 14]}
    assert vectors.batch_search(rows, asked, None, floor=5.0).count() == sum(i % 7 >= 5 for i in range(200))


def test_normalised_keeps_zeros_and_nothing(spark):
    raw = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", []), ("d", None)], "key string, raw array<double>")
    assert {r["key"]: r["vector"] for r in upkeep.normalised(raw).collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0], "c": [], "d": None}
    assert "transform(" not in upkeep.normalised(raw)._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_made_once(spark):
    docs = spark.createDataFrame([(1, "pdf", "a", 1.0), (2, "url", "b", 1.0)], "doc_id long, kind string, title string, seconds double")
    texts = spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, 1, 5), (2, 1, 5)], "doc_id long, page long, size long")
    found = retrieval.dispatched(chunking.chunked(texts), docs, pages)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"]: r["page"] for r in found.collect()} == {1: 1, 2: None}
