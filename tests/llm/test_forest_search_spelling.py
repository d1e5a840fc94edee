"""The forest of near duplicates, the search for many items and the spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import EXTRA, FOLDER, docs, odd  # noqa: F401

from quillspark.llm import forest, queries, shared_terms, spelling

_LOWER = {k: k + 32 for k in range(65, 91)}


def _classes(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), all pairs compared."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    least = [d for d, _ in rows]
    groups = {k: [k] for k in range(len(rows))}
    at = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and at[i] != at[j] and 100 * len(a & b) >= 80 * len(a | b):
                small, large = sorted((at[i], at[j]), key=lambda g: len(groups[g]))
                for k in groups[small]:
                    at[k] = large
                groups[large] += groups.pop(small)
    for g in groups.values():
        ids = [least[k] for k in g if rows[k][0] is not None]
        for k in g:
            least[k] = min(ids) if rows[k][0] is not None else None
    return Counter((d, len(s), c, d is not None and d == c) for (d, _), s, c in zip(rows, sets, least, strict=True))


def _found(frame):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in forest.classes(frame).collect())


def _edited(words, chance, edits):
    words = list(words)
    for _ in range(edits):
        words[chance.randrange(len(words))] = f"new{chance.randrange(10**6)}"
    return words


def test_forest_equals_brute_force(spark, odd):
    for frame in (docs(spark), odd):
        assert _found(frame) == _classes([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    assert forest.classes(odd.where("false")).count() == 0


@pytest.fixture(scope="module")
def templates():
    """Texts of one template whose sets are just below and just above the similarity that links, chains of edits, copies, and short ones."""
    chance = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    texts = [" ".join(_edited(base, chance, chance.randrange(1, 5))) for _ in range(150)]
    chain = [f"c{k}" for k in range(120)]
    for k in range(40):
        chain[k * 3] = f"changed{k}"
        texts.append(" ".join(chain))
    texts += texts[:20] + ["a b c", "A B C", "a b c d", "a b c d e"]
    return list(enumerate(texts, 100))


def test_forest_of_templates(spark, templates):
    assert _found(spark.createDataFrame(templates, "doc_id long, text string")) == _classes(templates)


def test_forest_adapts_and_grows(spark, templates, monkeypatch):
    """Regions that count as crowded at every depth are cut to the last, and nodes come into further forests."""
    monkeypatch.setattr(forest, "CROWDED", -1)
    monkeypatch.setattr(forest, "MISSED", 1e-3)
    monkeypatch.setattr(forest, "FIRST_TREES", 1)
    planted, again = [], forest._planted_again
    monkeypatch.setattr(forest, "_planted_again", lambda d, seed: planted.append(seed) or again(d, seed))
    assert _found(spark.createDataFrame(templates, "doc_id long, text string")) == _classes(templates)
    assert planted


def test_forest_of_a_swarm(spark):
    """Texts of one template just below the similarity that links: no link is lost where one of them is linked with many."""
    chance = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    texts = [_edited(base, chance, chance.randrange(3, 6)) for _ in range(200)]
    texts += [_edited(t, chance, 1) for t in texts[:40]] + [base, _edited(base, chance, 1)]
    rows = list(enumerate(map(" ".join, texts)))
    chance.shuffle(rows)
    assert _found(spark.createDataFrame(rows, "doc_id long, text string")) == _classes(rows)


def test_signature_agrees_like_the_sets():
    chance = np.random.default_rng(0)
    both, x, y = (np.unique(chance.integers(0, 2**63, n).astype(np.uint64)) for n in (800, 100, 100))
    a, b = (forest.signature(np.unique(np.concatenate((both, z))), 0) for z in (x, y))
    assert abs(float((a == b).mean()) - 0.8) < 0.1
    long = chance.integers(0, 2**63, 5000).astype(np.uint64)
    odd_numbers, other = forest._constants(0)
    assert (forest.signature(long, 0) == ((long.astype(np.uint32) ^ other) * odd_numbers + (long >> np.uint64(32)).astype(np.uint32)).min(axis=1)).all()


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def _ranked(rows, items):
    """(item_id, rank, doc_id, score), every document scored for every item by itself."""
    counts = [(d, Counter(TERM.findall((t or "").translate(_LOWER)))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        wanted = TERM.findall((text or "").translate(_LOWER))
        scores = []
        for d, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out.update((item, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:10], 1))
    return out


def _answers(frame, items):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in shared_terms.ranked(frame, items).collect())


def test_search_equals_brute_force(spark, odd, monkeypatch):
    items = [(1, "two words text"), (2, "two words text again please"), (3, None), (4, ""), (5, "long LONG long"), (6, "nowhere"), (7, "中文 Ünïcödé"), (7, "repeat me now please again"), (None, "words")]
    given = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert _answers(odd, given) == _ranked(rows, items)
    assert shared_terms.ranked(odd.where("false"), given).count() == 0
    assert shared_terms.ranked(odd, given.where("false")).count() == 0
    # Batches of items and graphs of any size, and steps of few documents, give the same.
    monkeypatch.setattr(shared_terms, "BATCH_ITEMS", 4)
    monkeypatch.setattr(shared_terms, "GRAPH_ITEMS", 2)
    assert _answers(odd, given) == _ranked(rows, items)


def test_search_of_the_benchmark(spark):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows, items = ([tuple(r) for r in frame.collect()] for frame in (docs(spark).select("doc_id", "text"), benchmark.select("item_id", "text")))
    found = queries.QUERIES["op12_shared_terms"](spark, FOLDER)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()) == _ranked(rows, items)


def test_graph_shares_sums():
    chance = random.Random(5)
    for trial in range(20):
        common = [chance.sample(range(60), 6) for _ in range(4)]
        items = [Counter(chance.sample(range(60), 5) + [t for c in chance.sample(common, 2) for t in c]) for _ in range(12)] + [Counter()]
        graph = shared_terms.Graph(items)
        values = np.array([[chance.randrange(1000) for _ in range(3)] for _ in range(60)])
        leaves = np.array([times * values[term] for term, times in graph.leaves])
        expected = np.array([sum((times * values[term] for term, times in c.items()), np.zeros(3, np.int64)) for c in items])
        assert (graph.scores(leaves) == expected).all()
        assert graph.sums and sum(map(len, graph.items)) + sum(map(len, graph.sums)) < sum(map(len, items)) + len(graph.sums)


def _variants(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[len(w), k, w[:k], w[k + 1 :]].add(w)
            if (x := w[:k] + w[k + 1 :]) in words:
                near[w].add(x)
                near[x].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= 5 * words[w]:
            form[w] = best
    out = Counter()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w, form.get(w), root, n, len(near[w]), words.get(form.get(w))] += 1
    return out


def _spelled(frame):
    return Counter((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame).collect())


@pytest.mark.parametrize("most", [spelling.MOST_WORDS, 4])
def test_spelling_equals_brute_force(spark, odd, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_WORDS", most)
    chance = random.Random(9)
    words = ["abcdef", "abcdeg", "abcdefg", "aabcdef", "bcdefg", "abcdéf", "zzzzzz", "zzzzzzz", "ABCDEF", "straße", "Éclair", "éclair", "eclair", "xxxxxx", *("".join(chance.choices("ab", k=chance.randrange(6, 10))) for _ in range(60))]
    texts = [(k if k % 7 else None, " ".join(w for w in chance.choices(words, [1 / (i + 1) for i in range(len(words))], k=60))) for k in range(120)]
    texts += [(1, None), (2, ""), (3, "y" * 300 + " " + "y" * 301)] + [(4, "y" * 300)] * 5 + [(5, "y" * 299)] * 5
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert _spelled(frame) == _variants(texts)
    # Of a chain of forms the last one is the root.
    chain = [(None, " ".join(["longword"] * 625 + ["longwords"] * 125 + ["longwordss"] * 25 + ["longwordsss"] * 5))]
    assert {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(chain, "doc_id long, text string")).collect()} == dict.fromkeys(chain[0][1].split(), "longword")
    if most > 4:
        rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
        assert _spelled(odd) == _variants(rows)
        assert spelling.variants(odd.where("false")).count() == 0


def test_spelling_of_long_runs(spark):
    texts = [(k, "y" * n) for n in (20_000, 20_001, 20_003) for k in range(6)]
    found = spelling.variants(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {len(r["word"]): r["n_near"] for r in found} == {20_000: 1, 20_001: 1, 20_003: 0}


def test_spelling_query(spark):
    found = queries.QUERIES["op13_spelling_variants"](spark, FOLDER).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).select("doc_id", "text").collect()]
    assert Counter((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found) == _variants(rows)


def test_acceptor_is_minimal():
    words = sorted({"walked", "walking", "walks", "talked", "talking", "talks", "talk"})
    acceptor = spelling.Acceptor(words)
    reached, stack, accepted = {0}, [(0, "")], []
    while stack:
        state, word = stack.pop()
        if acceptor.final[state]:
            accepted.append(word)
        for c, t in acceptor.edges[state].items():
            reached.add(t)
            stack.append((t, word + c))
    assert sorted(accepted) == words
    # No two states that are reached accept the same endings.
    assert len({(acceptor.final[s], *acceptor.edges[s].items()) for s in reached}) == len(reached)
    assert set(acceptor.near()) == {("talk", "talks"), ("talked", "walked"), ("talking", "walking"), ("talks", "walks")}
