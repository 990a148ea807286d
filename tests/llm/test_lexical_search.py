"""Operator 11 against the scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from eventlift.llm import lexical_search
from eventlift.llm.oracle import ORACLES
from eventlift.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, `a.b` int, score string"
ITEMS = "item_id long, text string, rank int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def texts(seed, count, longest):
    r = random.Random(seed)
    vocabulary = [f"{c}{i}" for i in range(60) for c in ("w", "É", "W")] + ["the"] * 60
    out = [None, "", " .,\x7f", "The the THE", "a_b-c 1é"]
    for _ in range(count):
        topic = r.sample(vocabulary, 20)
        out.append(" ".join(r.choice(topic) for _ in range(r.randint(1, longest))) + r.choice(["", ".", "\n"]))
    return out + out[5:9]


@pytest.mark.parametrize("shard,block,cells", [(2048, 32, 1 << 22), (16, 2, 1 << 22), (50, 4, 400)])
def test_against_all_scores(spark, monkeypatch, shard, block, cells):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "MATRIX_CELLS", cells)
    docs = [(i // 2 if i % 13 else None, t) for i, t in enumerate(texts(1, 300, 60))]
    items = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts(2, 25, 30))]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], ITEMS).coalesce(1)
    found = lexical_search.search(rows, asked, k=7).collect()
    assert sorted(map(tuple, found), key=repr) == expected(docs, items, 7)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 1, "x")], DOCS)
    items = spark.createDataFrame([(1, "a", 1)], ITEMS)
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(some, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.search(some, items).collect()] == [(1, 1, 1, 287 * (10**9 // 1800))]


def test_blocks_are_skipped_by_their_bounds():
    """Of documents on many topics few blocks are scored, and the result is that of all."""
    r = np.random.default_rng(3)
    vectors = np.zeros((2000, 200), np.int32)
    for d in range(2000):
        topic = d % 20 * 10
        vectors[d, topic : topic + 10] = r.integers(1, 900_000, 10)
        vectors[d, r.integers(0, 200, 5)] = r.integers(1, 100_000, 5)
    vectors[:, 0] = r.integers(1, 900_000, 2000)  # a term of all documents, the weightiest
    items = [(i, i, {0: 1} | {int(t): 1 for t in range(i * 10, i * 10 + 8)}) for i in range(20)]
    plan = lexical_search.Plan(items, {t: 1000 + (t == 0) for t in range(200)})
    best = lexical_search.Best(20, 5)
    matrix = vectors[:, list(plan.column)]
    seen, skipped = lexical_search.Shard(plan, matrix, np.arange(2000).astype(object)).search(best)
    assert skipped > seen / 2
    scores = plan.weights @ matrix.T
    for item in range(20):
        assert [-s for s, _ in best.held[item]] == sorted(scores[item].astype(int).tolist())[:-6:-1]


def test_twin(spark, duck):
    result = duck.execute(ORACLES["op11_lexical_search"])
    names = [c[0] for c in result.description]
    df = QUERIES["op11_lexical_search"](spark, f"{DATA}/sf0.01").select(*names)
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())
