"""Literal cases and invariants of single operators."""

from pyspark.sql import functions as F

from quillspark.functions import constants as K
from quillspark.functions import text as T
from quillspark.operators import chunking, evaluation, fusion, lexical, sequences, upkeep, vectors
from quillspark.sources import html
from quillspark.sources.unicode import nfkc
from quillspark.streaming import rollups


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    assert one(spark, T.tokens, "Harbour Lights") == ["harbour", "lights"]
    assert one(spark, T.tokens, "a well-known rock'n'roll_band v2.5.") == ["a", "well-known", "rock'n'roll_band", "v2.5"]
    assert one(spark, T.tokens, "東京タワー") == ["東京", "京タ", "タワ", "ワー"]
    assert one(spark, T.tokens, "山 and 海辺 too") == ["山", "海辺", "and", "too"]
    assert one(spark, T.tokens, "") == [] and one(spark, T.tokens, None) == []
    assert one(spark, T.tokens, "Ärger") == ["rger"]
    assert one(spark, T.tokens, "ＡＢＣ test ﬁne ②") == ["abc", "test", "fine", "2"]
    assert one(spark, T.tokens, "cafe\u0301 x") == ["caf", "x"]


def test_stable_characters():
    """What is taken for stable under NFKC is, alone and beside any other such character."""
    import re
    import unicodedata

    stable = re.compile(f"[{K.NFKC_STABLE}]")
    found = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and stable.fullmatch(chr(c))]
    assert len(found) > 30_000 and all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in found)
    assert unicodedata.is_normalized("NFKC", "".join(found)) and unicodedata.is_normalized("NFKC", "".join(reversed(found)))


def test_cleaning(spark):
    assert one(spark, T.clean, "red  fish\nPrivacy Policy\n3.1\n\n\n\nJump to content\nblue\u00a0\u3000fish") == "red fish\n\nblue fish"
    assert one(spark, T.clean, "two marks: pmid 7 and issn 8\none mark: pmid 7") == "one mark: pmid 7"
    assert one(spark, T.pdf_clean, "under-\nstanding\n- 41 -\nPage 7 of 12\nside-by-side") == "understanding\nside-by-side"
    assert one(spark, T.transcript_clean, "[applause] good  evening (coughs) all") == "good evening all"
    assert one(spark, T.prompt_tokens, "b" * 1003) == 250
    assert one(spark, T.token_ceiling, "tokens per minute: Limit 6500, Requested 9000") == 6500
    assert one(spark, T.token_ceiling, "requests per day (RPD): Limit 400 token") is None
    assert one(spark, nfkc, "ｘ１") == "x1"


def test_speech(spark):
    said = one(spark, T.speech, "## Plan\n> quoted *soft* and **loud _both_**\n- see [the map](http://m/x) ![pic](p.png)\n```\ncode\n```\n---\n`x = 1` | http://a.b/c")
    assert said == "Plan\nquoted soft and loud both\nsee the map pic\nx = 1"


def test_shortened(spark):
    assert one(spark, T.shortened, " a  b ") == "a b"
    cut = one(spark, T.shortened, "word, " * 40)
    assert len(cut) <= 121 and cut.endswith("word…")
    assert one(spark, T.shortened, "; " * 90) == "; " * 60 + "…"
    assert one(spark, T.shortened, "x" * 130) == "x" * 120 + "…"


def test_small_text_functions(spark):
    assert one(spark, lambda x: T.clock(F.lit(125.9)), "") == "2:05" and one(spark, lambda x: T.clock(F.lit(-3)), "") == "0:00"
    labels = lambda *v: F.array(*(F.lit(x) for x in v)).cast("array<string>")
    for given, said in (((), ""), (("one.",), "one"), (("one", "", "two"), "one and two"), (("a", "b", "c."), "a, b and c")):
        assert one(spark, lambda x, v=given: T.phrase(labels(*v)), "") == said
    assert one(spark, T.first_object, 'well {"a": 1} then') == '{"a": 1}' and one(spark, T.first_object, "[1]") is None and one(spark, T.first_object, "{ no }") is None
    assert one(spark, T.video_id, "https://youtu.be/abcdefghijk?t=1") == "abcdefghijk" and one(spark, T.video_id, "https://v.example/watch?list=1&v=short") == "short"
    assert one(spark, T.squashed, "Ａ b\u3000C") == "abc"
    key = lambda scope: one(spark, lambda x: T.cache_key(F.col("x"), scope, F.lit(None), F.lit(5)), "q")
    assert key(labels("b", "a")) == key(labels("a", "b")) != key(F.lit(None).cast("array<string>"))


SAMPLES = ("One is here. Two is here! Three?", "Dr. Who met Mr. X. at 3.14 today. Then left.", "他說「好。」然後走了。", "No. 7 it is... or not?! Yes. ", "", "J. R. came by.\nNext line.", '"Stop." he said。’ End')


def test_sentences(spark):
    assert chunking.sentences("One is here. Two is here! Three?") == ["One is here.", "Two is here!", "Three?"]
    assert chunking.sentences("Dr. Who met Mr. X. at 3.14 today. Then left.") == ["Dr. Who met Mr. X. at 3.14 today.", "Then left."]
    assert chunking.sentences("他說「好。」然後走了。") == ["他說「好。」", "然後走了。"]
    for text in SAMPLES:
        assert one(spark, T.sentences, text) == chunking.sentences(text), text


def test_chunks():
    text = "# A\n## B\n### C\n" + "word " * 300 + "\n# D\nshort text here\n"
    for size in (60, 100, 200, 512):
        for overlap in (0, 20):
            made = chunking.chunks_of(text, size, overlap)
            assert all(len(c.text) <= size for c in made)
            assert [c.start for c in made] == sorted(c.start for c in made)
    assert chunking.chunks_of(text)[0].path == "A > B > C"
    assert chunking.chunks_of(text)[-1].path == "D"
    assert all("#" not in c.text for c in chunking.chunks_of(text))
    assert len(chunking.chunks_of("a long enough line " * 6 + "\nshort")) == 1
    assert chunking.chunks_of("") == [] and chunking.chunks_of(None) == []
    assert max(len(p) for p in chunking.hard_split("x" * 130, 60)) == 60


PAGES = (
    "<title>Tea &amp; cake</title><nav>menu</nav><main><h2>Brewing</h2><p>Pour <a href='/x'>hot water</a> slowly, then wait.</p><table><tr><td>Oolong</td><td>90 degrees</td></tr></table><ol class='references'><li>gone</li></ol></main><footer>foot</footer>",
    "<div>only loose prose</div>",
    "<body><article><p><b>open <p>inner</p><ul><li>one<li>two</ul></article><p>outside</body>",
    "<div class='content'>  </div><article><p>Energy <math alttext='E'><semantics><mi>E</mi><annotation>{\\displaystyle E=mc^2}</annotation></semantics></math> is <math alttext='m'><mi>x</mi></math> mass.</p></article>",
    "<main><section role='search'><p>find</p></section><h1>A &lt; B</h1><blockquote><p>deep</p> shallow</blockquote><tr><th>k</th><td> </td><td>v</td></tr>bare</main></p></div>",
    "<main>mostly text outside of any block at all, a good deal of it<p>x</p></main>",
    "<p title='a>b' class=\"x toc\">cut</p><p>kept<br/>on</p><!-- <p>no</p> --><script>var a='<p>';</script><img src=x><a href=''>e</a><a href='#t'>t</a><a href='http://h/q'>in <b>bold</b></a>",
    "<main>1 < 2 and <b>bold</b> text, 3 <4 all of it outside of any block<p>x</p></main>",
    "<meta name='description' content='First'><meta name='description' content='second'><meta property=\"og:title\" content=\"O &quot;x&quot;\"><p>1 < 2 & 3</p>",
    "",
)


def test_html(spark):
    """Rows of tokens give what a tree of nodes gives."""
    import re

    import slow_html as slow

    pages = spark.createDataFrame([*((i, "http://h/", p) for i, p in enumerate(PAGES)), (99, None, None)], "page_id long, url string, html string")
    texts = {r["page_id"]: r["text"] for r in html.texts(pages).collect()}
    meta = {r["page_id"]: r for r in html.metadata(pages).collect()}
    links, heads = {}, {}
    for r in html.links(pages).orderBy("page_id", "position").collect():
        links.setdefault(r["page_id"], []).append({"href": r["href"], "text": r["text"], "is_internal": r["is_internal"]})
    for r in html.headings(pages).orderBy("page_id", "pos").collect():
        heads.setdefault(r["page_id"], []).append((r["tag"], r["text"]))
    for i, page in enumerate(PAGES):
        root = slow.parsed(page)
        wanted = slow.metadata(root)
        assert {k: meta[i][k] or None for k in ("title", *html.META)} == {k: v or None for k, v in wanted.items()}, page
        assert links.get(i, []) == slow.links(root, "http://h/"), page
        slow.prune(root)
        slow.inline_math(root)
        assert heads.get(i, []) == [(n.tag, t) for n in root.walk() if re.fullmatch("h[1-6]", n.tag) and (t := slow._flat(n.text()))]
        assert texts[i] == slow.block_text(slow.container(root)), page
    assert texts[99] is None and meta[99]["title"] is None
    assert "Oolong | 90 degrees" in texts[0] and "## Brewing" in texts[0] and "gone" not in texts[0]


def test_html_that_never_ends(spark):
    """A comment or script that is not closed goes on to the end of the page, and a page of many takes time in proportion."""
    import time

    pages = ["<main><p>before</p><!-- never closed <p>no</p></main>", "<p>a</p><script>var x = '<p>no</p>'", "<!-- " * 200_000, "<script>" * 100_000]
    frame = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    began = time.time()
    assert [r["text"] for r in html.texts(frame).orderBy("page_id").collect()] == ["before", "a", "", ""]
    assert all(r["title"] is None for r in html.metadata(frame).collect()) and html.links(frame).count() == 0
    spoken = spark.createDataFrame([("[" * 500_000,), ("[a](b) [c",)], "text string").select(T.speech(F.col("text")).alias("s")).collect()
    assert spoken[1]["s"] == "a [c" and time.time() - began < 60


def test_html_of_all_pages(spark):
    import slow_html as slow

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html.texts(pages).collect()}
    for r in pages.collect():
        root = slow.parsed(r["html"])
        slow.prune(root)
        slow.inline_math(root)
        assert found[r["page_id"]] == slow.block_text(slow.container(root))


def test_fusion(spark):
    lists = lambda *rows: [spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(r)], "query_id long, doc_id string, rank int") for r in rows]
    order = lambda df: [r["doc_id"] for r in df.orderBy("position").collect()]
    dense, lex = [f"d{i}" for i in range(1, 16)], ["answer", *(f"d{i}" for i in range(4, 16))]
    assert set(order(fusion.fused(lists(dense, lex)))[:2]) == {"d1", "answer"}
    assert order(fusion.fused(lists(["a", "x"], ["b", "a"])))[0] == "a"


def test_dedupe(spark):
    rows = [(1, 1, 1, "grey geese fly south in the late autumn"), (1, 2, 2, "grey geese fly south in the late cold autumn"), (1, 3, 3, "boats stay home")]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, position int, text string")
    assert {r["doc_id"] for r in fusion.deduped(df, 0.8).collect()} == {1, 3}
    assert fusion.deduped(df, 1.0).count() == 3


def test_scope(spark):
    docs = spark.createDataFrame([(1, "a cat"), (2, "a dog")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "cat dog")], "query_id long, question string")
    hits = lambda s: {r["doc_id"] for r in lexical.bm25(docs, asked, s).collect()}
    assert hits(None) == {1, 2} and hits(docs.where("doc_id = 2")) == {2} and hits(docs.where("false")) == set()


def test_cosine_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, vector array<double>")
    assert {r["id"]: r["score"] for r in vectors.search(df, [3.0, 4.0], measure="cosine").collect()} == {1: 0.0, 2: 1.0}
    found = vectors.block_search(df, df, None, floor=0.5, measure="cosine").collect()
    assert [(r["query_id"], r["id"], round(r["score"], 9)) for r in found] == [(2, 2, 1.0)]


def test_budget(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 5), (2, 1, 5), (2, 2, 3), (2, 3, 9)], "q long, r int, n int")
    kept = sequences.budget_prefix(df, "q", "r", F.col("n"), 10).collect()
    assert {(r["q"], r["r"]) for r in kept} == {(1, 1), (2, 1), (2, 2)}


def test_stream(spark):
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    metrics = stream.select(F.col("event_type").alias("endpoint"), F.lit(200).alias("status_code"), F.col("value").alias("response_time_ms"), F.col("ts").cast("timestamp").alias("ts"))
    running = rollups.windowed_summary(metrics).writeStream.format("memory").queryName("summary").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    assert spark.sql("SELECT sum(requests) FROM summary").first()[0] == events.count()


def test_more_questions_than_a_block(spark):
    """2,500 questions, in three blocks."""
    rows = spark.range(2500).selectExpr("id", "array(cast(cos(id) AS float), cast(sin(id) AS float)) AS vector")
    found = {}
    for r in vectors.block_search(rows, rows, 2).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    assert sorted(found) == list(range(2500)) and all(sorted(x) == [1, 2] for x in found.values())
    assert all(x[1][1] > 0.999999 and x[1][1] >= x[2][1] - 1e-6 for x in found.values())
    assert vectors.block_search(rows, rows.where("false"), 2).count() == 0


def test_judging(spark):
    hits = spark.createDataFrame([(1, 1, 10, "The ＲＥＤ  door", ["blue", "red door"]), (1, 2, 11, "a door", ["blue", "red door"]), (2, 1, 10, "x", ["y"])], "query_id long, rank int, doc_id long, text string, answer array<string>")
    judged = evaluation.judged(hits)
    assert [r["relevant"] for r in judged.orderBy("query_id", "rank").collect()] == [True, False, False]
    only = evaluation.expected(judged, spark.createDataFrame([(1, 11)], "query_id long, doc_id long"))
    assert not any(r["relevant"] for r in only.collect())
    scored = evaluation.per_query(judged)
    assert [r["query_id"] for r in evaluation.misses(scored).collect()] == [2]
    assert evaluation.flagged_share(hits.where("false")).first() == (0, 0.0, 0.0)


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", x) for x in (5, 1, 4, 2, 3)] + [("b", 7)] * 4 + [("c", None)], "g string, v long")
    found = {r["g"]: (r["p50"], r["p95"]) for r in evaluation.percentiles(rows, "v", (0.5, 0.95), "g").collect()}
    assert found == {"a": (3, 5), "b": (7, 7)}


def test_packing(spark):
    rows = spark.createDataFrame([(1, i, "x" * n, float(i), i + 0.5) for i, n in enumerate((4, 4, 30, 1, 1))], "g long, at int, text string, start double, end double")
    parts = [(r["part"], len(r["text"]), r["start"], r["end"]) for r in sequences.packed(rows, "g", "at", 10).orderBy("part").collect()]
    assert parts == [(0, 9, 0.0, 1.5), (1, 30, 2.0, 2.5), (2, 3, 3.0, 4.5)]


def test_long_documents(spark):
    """Places of many lines, and numbers of many rows, against running sums."""
    text = "\n".join("y" * (k % 7) for k in range(3000))
    rows = sequences.lines(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).collect()
    at, wanted = 0, []
    for k, line in enumerate(text.split("\n")):
        wanted.append((1, k, at, line, 3000))
        at += len(line) + 1
    assert [tuple(r) for r in rows if r["doc_id"] == 1] == wanted and [tuple(r) for r in rows if r["doc_id"] == 2] == [(2, 0, 0, "", 1)]
    many = spark.range(5000).selectExpr("id", "id % 2 AS g", "cast(id AS string) AS s")
    assert all(r["number"] == r["id"] // 2 + 1 for r in sequences.numbered(many, "g", "id", "s").collect())


def test_appends(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    new = spark.createDataFrame([(2, "c")], "doc_id long, text string")
    assert sorted(map(tuple, upkeep.replaced(rows, new).collect())) == [(1, "a"), (2, "c")]
    for _ in range(2):
        assert upkeep.appended(rows, new, f"file://{tmp_path}/rows").count() == 3
    assert spark.read.parquet(f"file://{tmp_path}/rows").count() == 2
    texts = spark.createDataFrame([("p", "aab"), ("q", "aab"), ("r", "zz")], "id string, text string")
    made = upkeep.encoded(texts, upkeep.letter_counts("ab"))
    vectors = {r["id"]: r["vector"] for r in made.collect()}
    assert vectors["p"] == vectors["q"] and abs(sum(x * x for x in vectors["p"]) - 1) < 1e-9
    known = made.where("id = 'p'").select("key", F.array(F.lit(9.0)).alias("vector"))
    assert {r["id"]: r["vector"] for r in upkeep.encoded(texts, upkeep.letter_counts("ab"), known=known).collect()}["q"] == [9.0]
