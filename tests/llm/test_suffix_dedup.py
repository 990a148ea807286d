import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from eventlift.llm import suffix_dedup as S


def brute(docs, length):
    """For each document the bytes that stay and the number of spans removed."""
    seen, result = {}, {}
    for doc, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen[string] = 1
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        result[doc] = (len(data), sum(gone), spans, kept)
    return result


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéf") for _ in range(r.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(r.randrange(15, 60))) for _ in range(6)]
    line = "a common line of some words that every document has in it"
    docs = {}
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            kind = r.random()
            parts.append(r.choice(passages) if kind < 0.3 else line if kind < 0.5 else " ".join(word() for _ in range(r.randrange(60))))
        text = " ".join(parts)
        if docs and r.random() < 0.2:
            text = r.choice(list(docs.values())) or ""
        if r.random() < 0.1 and text:
            at = r.randrange(len(text))
            text = text[:at] + "x" + text[at + 1 :]
        docs[i * 3] = text
    return docs | {1: None, 2: "", 4: "ab" * 500, 5: "ab" * 500, 7: "a" * 1000, 8: "q" * 99, 10: "q" * 100, 11: "q" * 100}


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()}


@pytest.mark.parametrize("hot,local_hot", [(1000, 32), (5, 32), (1000, 2), (5, 1)])
def test_equals_brute_force(spark, hot, local_hot):
    docs = corpus(hot, 150)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert result(S.remove_repeats(df, 100, hot=hot, local_hot=local_hot)) == brute(docs, 100)


def test_places_of_a_hot_substring_are_not_gathered():
    """A line in all of 3,000 texts: its places go by numbers of their own, a mark or two to its hash."""
    schema = pa.schema([("hash", pa.int64()), ("id", pa.int64()), ("place", pa.int32())])
    line = hashlib.sha512(b"line").hexdigest()
    texts = [line + hashlib.sha512(str(i).encode()).hexdigest() for i in range(3000)]
    batch = S.batch_of(pa.schema([("id", pa.int64()), ("text", pa.string())]), [range(3000), texts])
    rows = pa.concat_batches(S._represented(iter([batch]), 100, S.LOCAL_HOT, S.HOT, schema))
    hashes = rows.column(0).to_numpy()
    assert np.unique(hashes, return_counts=True)[1].max() < 60
    again = pa.schema([("id", pa.int64()), ("place", pa.int32()), ("hot", pa.bool_())])
    ordered = rows.take(pa.array(np.argsort(hashes, kind="stable")))
    pieces = [ordered.slice(i, 700) for i in range(0, ordered.num_rows, 700)]
    found = [(x["id"], x["place"]) for b in S._repeated(iter(pieces), S.HOT, again) for x in b.to_pylist() if x["hot"]]
    strings = S.Strings([t.encode() for t in texts])
    known, code, counts = np.unique(strings.hash, return_inverse=True, return_counts=True)
    hot = counts[code] > S.HOT
    assert sorted(found) == sorted(zip(strings.text[hot].tolist(), strings.place[hot].tolist(), strict=True))


def test_no_group_is_compared_beyond_the_bound(spark, monkeypatch):
    """A line that every document has between bytes of its own, shorter and longer than a string."""
    r = random.Random(3)
    own = lambda: "".join(r.choice("ghijklmn") for _ in range(r.randrange(3, 40)))
    docs = {}
    for length, first in ((95, 0), (180, 1000)):
        line = "".join(r.choice("abcdef") for _ in range(length))
        docs |= {first + i: own() + line + own() for i in range(300)}
    sizes, arrow_map = [], S.arrow_map

    def recorded(df, task, schema):
        if task.func is S._compared:
            sizes.extend(row["count"] for row in df.groupBy("key").count().collect())
        return arrow_map(df, task, schema)

    monkeypatch.setattr(S, "arrow_map", recorded)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    assert result(S.remove_repeats(df, 100, hot=20)) == brute(docs, 100)
    assert sizes and max(sizes) <= 20


def test_strings_alone_over_batch_borders():
    text = b"".join(hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(3))
    types = [pa.int64(), pa.int32(), pa.binary()]
    given = pa.schema(list(zip(["id", "start", "bytes"], types, strict=True)))
    sent = pa.schema([(n, pa.int32() if n[0] == "s" else pa.int64()) for n in ("p", "q", "id", "start", "stop")])
    runs = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    rows = [(k % 12, 5, text[k % 3 : k % 3 + 107]) for k in range(40)]
    batches = [S.batch_of(given, list(zip(*rows[i : i + 8], strict=True))) for i in range(0, 40, 8)]
    made = [x for b in S._strings(iter(batches), 100, sent) for x in b.to_pylist()]
    found = {(x["id"], s) for x in made if x["p"] is None for s in range(x["start"], x["stop"])}
    left = sorted(((x["p"], x["q"], x["id"], x["start"]) for x in made if x["p"] is not None))
    pieces = [S.batch_of(pa.schema(list(sent)[:4]), list(zip(*left[i : i + 3], strict=True))) for i in range(0, len(left), 3)]
    found |= {(x["id"], x["start"]) for b in S._later(iter(pieces), runs) for x in b.to_pylist()}
    first, expected = {}, set()
    for doc, begin, data in sorted(rows):
        for i in range(len(data) - 99):
            if first.setdefault(data[i : i + 100], (doc, begin + i)) != (doc, begin + i):
                expected.add((doc, begin + i))
    assert found == expected


def test_refinement_numbers_equal_strings_alike():
    r = random.Random(2)
    data = bytes(r.choice(b"ab") for _ in range(300)) * 2 + b"c" * 150 + bytes(r.randrange(256) for _ in range(300))
    starts = np.arange(len(data) - 99)
    numbers = S.refined(np.frombuffer(data, np.uint8), starts, 100)
    by_number, by_string = {}, {}
    for s, n in zip(starts.tolist(), numbers.tolist(), strict=True):
        by_number.setdefault(n, []).append(s)
        by_string.setdefault(data[s : s + 100], []).append(s)
    assert sorted(by_number.values()) == sorted(by_string.values())


def test_stretches_over_batch_borders_and_small_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "CHUNK_BYTES", 600)
    text = b"".join(hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(4))
    rows = [(k // 3, k, 0, 0, text[k // 3 : k // 3 + 110]) for k in range(60)]
    names, types = ["key", "id", "start", "stop", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    out = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    batches = [S.batch_of(schema, list(zip(*rows[i : i + 7], strict=True))) for i in range(0, 60, 7)]
    for same_key in (False, True):
        if same_key:
            batches = [S.batch_of(schema, [[0] * b.num_rows, *b.columns[1:]]) for b in batches]
        found = {x["id"] for b in S._compared(iter(batches), 100, out) for x in b.to_pylist()}
        assert {k for k in range(60) if k % 3} <= found


def test_equal_stretches_are_refined_once(monkeypatch):
    """Stretches of three keys: 50 times one, 50 times one and twice another, two that share some strings."""
    text = [b"".join(hashlib.sha256(bytes([k, i])).hexdigest().encode() for i in range(3)) for k in range(3)]
    rows = [(0, 900 - k, 7 * k, 0, text[0][:120]) for k in range(50)]
    rows += [(1, k % 45, 5, 0, text[1][:130]) for k in range(50)] + [(1, k, 30, 0, text[1][20:140]) for k in (3, 50)]
    rows += [(2, 1, 0, 0, text[2][:110]), (2, 1, 300, 0, text[2][4:104])]
    names, types = ["key", "id", "start", "stop", "bytes"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))
    out = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    sizes, refined = [], S.refined

    def recorded(data, *rest):
        sizes.append(len(data))
        return refined(data, *rest)

    monkeypatch.setattr(S, "refined", recorded)
    batches = [S.batch_of(schema, list(zip(*rows[i : i + 9], strict=True))) for i in range(0, len(rows), 9)]
    made = [x for b in S._compared(iter(batches), 100, out) for x in b.to_pylist()]
    found = {(x["id"], s) for x in made for s in range(x["start"], x["stop"])}
    first, expected = {}, set()
    for doc, begin, data in sorted((r[1], r[2], r[4]) for r in rows):
        for i in range(len(data) - 99):
            if first.setdefault(data[i : i + 100], (doc, begin + i)) != (doc, begin + i):
                expected.add((doc, begin + i))
    assert found == expected and sum(sizes) == 130 + 120 + 110 + 100


def test_rows_keep_their_columns(spark):
    long = "one two three four five six seven eight nine ten " * 3
    rows = [(1, long + "é", 9, "a"), (2, "x " + long, 8, None), (3, None, 7, "c"), (None, "short", 6, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, `r.stop` string")
    out = S.without_repeats(df)
    assert out.schema == df.schema
    found = {r["doc_id"]: r for r in out.collect()}
    expected = brute({1: rows[0][1], 2: rows[1][1]}, 100)
    assert {d: found[d]["text"].encode() for d in (1, 2)} == {d: expected[d][3] for d in (1, 2)}
    assert found[3]["text"] is None and found[None]["text"] == "short" and found[2]["start"] == 8


def test_clashing_columns_repeated_rows_and_rows_without_id(spark):
    long = "one two three four five six seven eight nine ten " * 3
    rows = [(1, long, 9), (1, long, 9), (None, long, 1), (None, "short", 2), (2, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int")
    out = sorted((r["doc_id"] or -1, r["n_removed"]) for r in S.remove_repeats(df).collect())
    first = brute({1: long}, 100)[1][1]
    assert out == sorted([(1, first), (1, first), (-1, len(long)), (-1, 0), (2, 0)])
    assert S.remove_repeats(df.limit(0)).count() == 0
