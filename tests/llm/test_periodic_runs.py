"""Operator 12 against a search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA

from eventlift.llm import periodic_runs
from eventlift.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, `a.b` int, runs string"


def brute_runs(words):
    """(start, length, period) of every run, by comparing the words at all distances."""
    n, runs = len(words), {}
    ids = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s + q >= max(6, 4 * q):
                runs.setdefault((s, e - s + q), q)  # the smallest period comes first
    return sorted((s, length, q) for (s, length), q in runs.items())


def brute_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (
        doc_id,
        len(runs),
        *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(brute_kept(words, runs).encode()).hexdigest(),
    )


def odd_texts(seed, count, longest):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "é é é é é é\x0bé", "x y x y x y x y", "a b " * 9]
    for _ in range(count):
        few = [f"w{i}" for i in range(r.choice([1, 2, 3, 50]))]
        words = []
        while len(words) < r.randint(1, longest):
            block = [r.choice(few) for _ in range(r.randint(1, max(1, longest // 12)))]
            whole = block * r.randint(1, 9)
            words += whole[: r.randint(1, len(whole))]
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    return texts


@pytest.mark.parametrize("tile_words", [16, 64, 1 << 14])
def test_against_all_periods(spark, tile_words):
    texts = odd_texts(tile_words, 60, 400)
    rows = [(i if i % 11 else None, t, 1, "x") for i, t in enumerate([*texts, texts[5], texts[20]])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = periodic_runs.collapse_runs(docs, tile_words=tile_words).collect()
    plain = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = brute_runs(words)
        plain.append((i, len(words), sorted(runs, key=lambda r: (r[0], r[2])), brute_kept(words, runs)))
    got = [(r["id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["text"]) for r in found]
    assert sorted(got, key=repr) == sorted(plain, key=repr)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["digest"] for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.collapse_runs(docs).count() == 0
    assert periodic_runs.digest(docs).count() == 0


@pytest.mark.parametrize("word", ["a", "a b c d e f g"])
def test_long_text_of_one_period(spark, word):
    period = len(word.split())
    docs = spark.createDataFrame([(1, f"{word} " * (400_000 // period), 1, "x")], SCHEMA)
    row = periodic_runs.collapse_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(0, period, 400_000 // period * period)]
    assert row["text"] == word


def test_query(spark):
    got = QUERIES["op12_periodic_runs"](spark, f"{DATA}/sf0.001")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = []
    for doc_id, text in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        rows.append(expected(doc_id, words))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rows)
    assert sum(r[1] > 0 for r in rows) > 10
