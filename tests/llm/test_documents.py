"""Operators 7 and 9, the packed rows of 10, and the pipeline, against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from conftest import DATA
from tokenizers import Tokenizer

import corpus_pipeline
from eventlift import Workspace
from eventlift.llm import hyperminhash, packing, quality, tasks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE = P.path("word_bpe_49k.json")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, n):
    words = WORD.findall(lowered(text))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def linked(docs, n):
    """For each document the size of its set and the least id reachable."""
    sets = {d: shingles(t, n) for d, t in docs.items()}
    least = {d: d for d in docs}
    pairs = [
        (a, b)
        for a, b in itertools.combinations(sorted(docs), 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return {d: (len(sets[d]), least[d]) for d in docs}


def near_copies(seed, families, copies):
    r = random.Random(seed)
    vocabulary = [f"w{i}É" for i in range(300)]
    docs = {}
    for _ in range(families):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 6, 30, 120, 400]))]
        for _ in range(r.randint(1, copies)):
            own = list(words)
            for _ in range(r.randint(0, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            docs[len(docs) * 2 + r.randint(0, 1)] = r.choice([" ", "\n", "\t "]).join(own)
    return docs | {9001: None, 9003: "", 9005: " \n", 9007: "Ab cd", 9009: "ab  CD"}


@pytest.mark.parametrize("n", [4, 5])
def test_components_equal_brute_force(spark, n):
    docs = near_copies(n, 25, 8)
    df = spark.createDataFrame([*docs.items(), next(iter(docs.items()))], "doc_id long, text string").selectExpr("*", "1 AS component_id", "2 AS id")
    rows = hyperminhash.near_duplicates(df.repartition(5), n=n).collect()
    assert len(rows) == len(docs) + 1
    expected = linked(docs, n)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]], docs[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_large_groups_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BAND_MEMBERS", 7)
    monkeypatch.setattr(hyperminhash, "FAMILY_BYTES", 3000)
    docs = near_copies(11, 3, 60)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    expected = linked(docs, 5)
    for r in hyperminhash.near_duplicates(df).collect():
        assert r["component_id"] == expected[r["doc_id"]][1]


def test_memory_of_a_task_goes_back():
    """What a task has freed is not kept from the next, though something above it stays."""

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20

    kept = []

    def task(batches):
        held = [np.ones(12_000) for _ in range(2000)]
        kept.append(held[-1])
        yield resident()

    before = resident()
    (during,) = tasks._tidied(iter([]), task)
    assert during - before > 150 and resident() - before < 50


def test_two_texts_under_one_id_give_one_result(spark):
    texts = [f"{w} " * 3 + "one two three four five six seven eight nine ten" for w in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[2]), (3, "quite another text with other words in it")]
    found = set()
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(parts)
        found.add(tuple(sorted(map(tuple, hyperminhash.near_duplicates(df, n=4).collect()))))
    assert len(found) == 1


def test_a_large_family_of_near_copies_is_compared_once(spark, monkeypatch):
    """Copies of one text with a word changed: next to all hang on the least, few rows are left for chunks."""
    monkeypatch.setattr(hyperminhash, "BAND_MEMBERS", 16)
    monkeypatch.setattr(hyperminhash, "FAMILY_BYTES", 20_000)
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    docs = {}
    for i in range(400):
        own = list(base)
        own[r.randrange(300)] = f"x{i}"
        docs[i] = " ".join(own)
    steps, stage = {}, Workspace.stage

    def recorded(self, df, name):
        table = stage(self, df, name)
        steps.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(Workspace, "stage", recorded)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {x["component_id"] for x in hyperminhash.near_duplicates(df).collect()} == {0}
    assert len(steps["stars"]) == 2 and steps["stars"][1] == 399 and steps["left"][1] == 0
    assert steps["left"][0] < 0.1 * steps["large"][0]


def test_rows_without_id_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(df).collect()}
    assert rows == {(None, None, True), (3, 3, True)}
    assert hyperminhash.near_duplicates(df.limit(0)).count() == 0


def plain_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)]


def test_plain_counts_equal_brute_force():
    r = random.Random(3)
    texts = ["", " ", "\n\n", "a\x0b\x0cb", "a b c a b c", "é ü\n\né ü", " x", "x " * 5000]
    texts += ["".join(r.choice("ab \n\t#é") for _ in range(r.randrange(90))) for _ in range(400)]
    _, metrics = quality.base_metrics([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert [int(m[i]) for m in metrics] == plain_counts(text), repr(text)


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rules = quality.fit(docs, even)
    judged = quality.score(docs, rules).join(odd, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count()
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.collect()}
    good = counts.get((1, True), 0) / (counts.get((1, True), 0) + counts.get((1, False), 0))
    bad = counts.get((0, False), 0) / max(counts.get((0, False), 0) + counts.get((0, True), 0), 1)
    assert good > 0.99 and bad > 0.9


def test_every_label_counts(spark):
    """Trusted counts and threshold come from all labelled texts, however many."""
    r = random.Random(8)
    texts = [" ".join(f"w{i % 13}x{r.randrange(40)}" for i in range(50 + k % 3)) for k in range(300)]
    texts += [" ".join(f"{r.choice('wu')}{i % 13}x{r.randrange(40)}" for i in range(50)) for _ in range(60)]
    pick = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    docs = spark.range(24_000).selectExpr("id AS doc_id", "CAST(IF(id < 22000, id % 300, 300 + id % 60) AS INT) AS k").join(pick, "k")
    labels = spark.range(23_000).selectExpr("id AS doc_id", "CAST(id < 22000 AS INT) AS quality")
    buckets = [quality._buckets(quality.Words([t.encode()]))[1] for t in texts]
    counts = np.stack([np.bincount(b, minlength=quality.BUCKETS) for b in buckets])
    good, bad, all_docs = np.zeros((3, len(texts)), np.int64)
    np.add.at(good, np.arange(22_000) % 300, 1)
    np.add.at(bad, 300 + np.arange(22_000, 23_000) % 60, 1)
    np.add.at(all_docs, 300 + np.arange(22_000, 24_000) % 60, 1)
    raw, trusted = (all_docs + good) @ counts, good @ counts
    rules = quality.fit(docs, labels)
    assert np.allclose(rules.ratios, quality.log_ratios(raw, trusted), rtol=1e-12)

    def mean(k, held):
        return quality.log_ratios(raw, held)[buckets[k]].mean()

    good_scores = np.repeat([mean(k, trusted - counts[k]) for k in range(300)], good[:300])
    bad_scores = np.repeat([mean(k, trusted) for k in range(300, 360)], bad[300:])
    floor = np.quantile(good_scores, quality.LOST, method="lower")
    below = bad_scores[bad_scores < floor]
    assert len(below)
    assert np.isclose(rules.threshold, (floor + np.quantile(below, quality.CAUGHT)) / 2, rtol=1e-9)


def test_scores_by_rank(spark, monkeypatch):
    monkeypatch.setattr(quality, "RANGES", 4)
    monkeypatch.setattr(quality, "SORTED", 3)
    r = random.Random(9)
    values = [r.choice([-1e300, 0.5, 0.5 + 2**-53, 5e-324, 0.0, r.gauss(0, 1e-9), r.gauss(0, 9)]) for _ in range(150)]
    scores = spark.createDataFrame([(v,) for v in values], "score double").coalesce(2).cache()
    for n in (0, 1, 40, 75, 76, 149):
        assert quality.nth_least(scores, n) == sorted(values)[n]
    assert np.isclose(quality.quantile(scores, 150, 0.95), np.quantile(values, 0.95))


def test_quality_edges(spark):
    rows = [(1, None, "a"), (None, "", "b"), (3, "x y " * 60, "c"), (3, " ".join(f"w{i}" for i in range(60)), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    rules = quality.fit(docs, None)
    kept = [r["kept"] for r in quality.keep(docs, rules).collect()]
    assert kept == ["d"] and quality.keep(docs, rules).schema == docs.schema
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), None)).count() == 0


def test_packed_rows(spark):
    docs = {1: "some words here " * 400, 2: None, 3: "", 4: "short", 5: "a longer text of words " * 60}
    df = spark.createDataFrame([*docs.items(), (4, "short"), (None, "no id")], "doc_id long, text string").selectExpr("*", "0 AS length", "0 AS piece")
    rows = packing.pack(df, WORD_BPE, capacity=256, with_ids=True).collect()
    library = Tokenizer.from_file(WORD_BPE)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] * 4 == len(r["ids"]) <= 1024
        by_doc.setdefault(r["doc_id"], {})[r["piece"]] = r
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in [*docs.items(), (None, "no id")]:
        pieces = [by_doc[doc][k] for k in sorted(by_doc[doc])]
        ids = np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist()
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(p["start"] == 256 * k for k, p in enumerate(pieces)) and all(p["length"] == 256 for p in pieces[:-1])
    for held in by_sequence.values():
        ends = list(itertools.accumulate(n for _, n in sorted(held)))
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 256) + 1
    assert packing.pack(df.limit(0), WORD_BPE).count() == 0


def test_pipeline_stages(spark):
    base = " ".join(f"word{i} of{i % 7}" for i in range(80))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, base, "en", "s", 1),
        (2, base + " tail", "en", "s", 1),
        (3, " ".join(f"other{i}" for i in range(90)) + " " + passage, "en", "s", 1),
        (4, passage + " " + " ".join(f"third{i}" for i in range(90)) + " mail a@b.cd", None, "s", 1),
        (5, "too short", "en", "s", 1),
        (6, None, "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.schema
    sf = f"{DATA}/sf0.001"
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality rules":
            docs = quality.keep(docs, quality.fit(docs, None))
        else:
            docs = stage(spark, docs, sf)
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in columns]
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert [sorted(k) for k in kept] == [[1, 2, 3, 4], [1, 3, 4], [1, 3, 4], [1, 3, 4]]
    assert "shared30" in kept[2][3] and "shared30" not in kept[2][4] and "third5" in kept[2][4]
    assert "a@b.cd" in kept[2][4] and "[EMAIL]" in kept[3][4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {1, 3, 4}
