"""Quality rules: plain counts, and a likelihood ratio of hashed n-grams (operator 9).

The words and word pairs of a text are hashed into a fixed number of buckets. Two
multinomials over the buckets are set against each other: one of the whole raw corpus, one
of trusted texts, all those labelled as good. A text's score is the mean over its n-grams of the
logarithm of their ratio; a fixed threshold decides. It is calibrated on all labelled texts, each
good one scored by trusted counts without its own n-grams.
"""

from __future__ import annotations

import math
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm.tasks import Batches, arrow_map, batch_of, same_rows, texts_of
from eventlift.llm.words import Words, groups

BUCKETS = 1 << 16
#: Good texts that the threshold may give up, as a share.
LOST = 0.0005
#: Bad texts that the threshold aims to stay above, as a share of those the floor leaves out.
CAUGHT = 0.95
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "#*$%&|<>"
BAD, GOOD = 0, 1
#: Words of 64 bits in the filter that keeps most texts without a label out of the shuffle.
FILTER_WORDS = 1 << 18
#: Ranges into which scores are counted to find one by its rank, and scores sorted by the driver at once.
RANGES, SORTED = 4096, 4096
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Rules(NamedTuple):
    """Log ratio by bucket, and the score below which a text goes."""

    ratios: np.ndarray
    threshold: float


def base_metrics(texts: list[bytes]) -> tuple[Words, list[np.ndarray]]:
    """The five counts of each text."""
    words = Words(texts)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    first_byte = (words.bytes & 0xC0) != 0x80
    repeated_lines = []
    for text in texts:
        lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
        repeated_lines.append(len(lines) - len(set(lines)))
    first, window = words.ngrams(3)
    key = window ^ (words.doc[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    found = np.zeros(len(key), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(len(words.hash), bool)
    for k in range(3):
        covered[first[found] + k] = True
    return words, [
        words.per_doc,
        words.per_text(first_byte & ~words.space),
        words.per_text(symbol[words.bytes]),
        np.array(repeated_lines, np.int64),
        np.bincount(words.doc[covered], minlength=len(texts)),
    ]


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and word pair."""
    first, pairs = words.ngrams(2)
    docs = np.concatenate([words.doc, words.doc[first]])
    hashes = np.concatenate([words.hash, pairs])
    return docs, (hashes >> np.uint64(16)).astype(np.int64) % BUCKETS


def _counted(batches: Batches, schema: pa.Schema) -> Batches:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for start, stop in groups(texts):
            counts += np.bincount(_buckets(Words(texts[start:stop]))[1], minlength=BUCKETS)
    seen = np.nonzero(counts)[0]
    if len(seen):
        yield batch_of(schema, [seen, counts[seen]])


def _left_out(batches: Batches, raw: np.ndarray, trusted: np.ndarray, schema: pa.Schema) -> Batches:
    """``quality, score`` of labelled texts that are long enough for a score to decide.

    Good texts are scored as if the trusted counts did not hold them.
    """
    for batch in batches:
        quality, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
        for start, stop in groups(texts):
            words = Words(texts[start:stop])
            docs, buckets = _buckets(words)
            n = np.bincount(docs, minlength=stop - start)
            good = quality[start:stop] == GOOD
            _, pair, times = np.unique(docs * BUCKETS + buckets, return_inverse=True, return_counts=True)
            own = np.where(good[docs], times[pair], 0)
            others = np.where(good, trusted.sum() - n, trusted.sum()) + len(trusted)
            shares = np.log((trusted[buckets] - own + 1) / others[docs]) - log_shares(raw)[buckets]
            score = np.bincount(docs, shares, minlength=stop - start) / np.maximum(n, 1)
            long = words.per_doc >= MIN_WORDS
            yield batch_of(schema, [quality[start:stop][long], score[long]])


def _score(texts: list[bytes], rules: Rules) -> list[np.ndarray]:
    """The counts and the score of each text."""
    columns: list[list] = [[np.zeros(0, np.int64)] for _ in METRICS] + [[np.zeros(0)]]
    for start, stop in groups(texts):
        words, metrics = base_metrics(texts[start:stop])
        docs, buckets = _buckets(words)
        n = np.bincount(docs, minlength=stop - start)
        total = np.bincount(docs, rules.ratios[buckets], minlength=stop - start)
        for column, values in zip(columns, [*metrics, total / np.maximum(n, 1)], strict=True):
            column.append(values)
    return [np.concatenate(c) for c in columns]


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def _scored(batches: Batches, rules: Rules, schema: pa.Schema) -> Batches:
    for batch in batches:
        *metrics, score = _score(batch.column(1).cast(pa.binary()).to_pylist(), rules)
        failed = base_failed(metrics[0], metrics[4])
        kept = ~failed & (score >= rules.threshold)
        yield batch_of(schema, [batch.column(0), *metrics, score, failed, kept])


def _filtered(batches: Batches, rules: Rules, text_at: int) -> Batches:
    for batch in batches:
        texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
        *metrics, score = _score(texts, rules)
        kept = ~base_failed(metrics[0], metrics[4]) & (score >= rules.threshold)
        yield batch.filter(pa.array(kept))


def _labelled(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``quality, text`` of all texts with a label.

    A bit for the hash of each labelled id says which texts need not be shuffled; with more labels
    than bits the filter lets more through.
    """
    known = (
        labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("quality"))
        .where("id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("id")
        .agg(F.min("quality").alias("quality"))
    )
    place = F.pmod(F.xxhash64("id"), F.lit(64 * FILTER_WORDS))
    bits = [F.expr("place DIV 64").alias("word"), F.expr("shiftleft(1L, CAST(place % 64 AS INT))").alias("bit")]
    words = known.select(place.alias("place")).select(*bits).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    placed = texts.select("id", "text", place.alias("place")).select("id", "text", *bits)
    some = placed.join(F.broadcast(words), "word").where("(bits & bit) <> 0").select("id", "text")
    return some.join(known.hint("merge"), "id").select("quality", "text")


def _counts(texts: DataFrame) -> np.ndarray:
    """N-grams of the texts by bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
    counted = arrow_map(texts.select("text"), partial(_counted, schema=schema), "bucket long, n long")
    counts = np.zeros(BUCKETS, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def log_shares(counts: np.ndarray) -> np.ndarray:
    """ln of the share of each bucket, with one more of everything."""
    return np.log((counts + 1) / (counts.sum() + len(counts)))


def log_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """ln of trusted over raw share for each bucket."""
    return log_shares(trusted) - log_shares(raw)


def nth_least(scores: DataFrame, n: int) -> float:
    """The score with ``n`` others before it in ascending order.

    Scores are counted by range, and those of the range that holds it again, until few are left: the
    driver sees at most ``RANGES`` counts or ``SORTED`` scores at a time.
    """
    score = F.col("score")
    low, high, left = scores.agg(F.min(score), F.max(score), F.count("*")).first()
    while low < high:
        inside = scores.where(score.between(low, high))
        if left <= SORTED:
            return sorted(r["score"] for r in inside.select("score").collect())[n]
        part = F.least(F.floor((score - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        counts = inside.groupBy(part.alias("part")).agg(F.min(score), F.max(score), F.count("*"))
        for _, low, high, left in sorted(map(tuple, counts.collect())):  # noqa: B007
            if n < left:
                break
            n -= left
    return low


def quantile(scores: DataFrame, rows: int, share: float) -> float:
    """The quantile of so many scores, between two of them in proportion."""
    place = share * (rows - 1)
    low = nth_least(scores, math.floor(place))
    if place == math.floor(place):
        return low
    return low + (nth_least(scores, math.floor(place) + 1) - low) * (place - math.floor(place))


def threshold_of(scores: DataFrame, lost: float = LOST) -> float:
    """The score below which texts go, from ``quality, score`` of labelled texts.

    It lies halfway between the score that all but a share ``lost`` of the good reach and the
    one that most of the bad below it stay under; where there are no such bad texts, at the
    former. Without good texts nothing goes.
    """
    good = scores.where(F.col("quality") == GOOD)
    n = good.count()
    if not n:
        return float("-inf")
    floor = nth_least(good, math.floor(lost * (n - 1)))
    below = scores.where((F.col("quality") == BAD) & (F.col("score") < floor))
    m = below.count()
    return (floor + quantile(below, m, CAUGHT)) / 2 if m else floor


def fit(
    docs: DataFrame,
    labels: DataFrame | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    workspace: Workspace | None = None,
) -> Rules:
    """Bucket counts of all of ``docs`` and of all trusted texts, and the threshold.

    ``labels`` (doc_id, quality) names good (1) and bad (0) texts; an id with both counts as bad.
    All of them are used. Without labels only the plain rules decide.
    The driver sees a number for each bucket, and counts of scores by range.
    """
    texts = texts_of(docs, id_col, text_col)
    raw = _counts(texts)
    if labels is None:
        return Rules(log_ratios(raw, np.zeros_like(raw)), float("-inf"))
    workspace = workspace or Workspace(docs.sparkSession)
    labelled = workspace.stage(_labelled(texts, labels), "labelled")
    trusted = _counts(labelled.where(F.col("quality") == GOOD))
    schema = pa.schema([("quality", pa.int32()), ("score", pa.float64())])
    task = partial(_left_out, raw=raw, trusted=trusted, schema=schema)
    scores = workspace.stage(arrow_map(labelled, task, "quality int, score double"), "label-scores")
    return Rules(log_ratios(raw, trusted), threshold_of(scores))


def _scores(texts: DataFrame, rules: Rules) -> DataFrame:
    names = [("doc_id", pa.int64()), *((m, pa.int64()) for m in METRICS), ("score", pa.float64())]
    schema = pa.schema([*names, ("base_failed", pa.bool_()), ("kept", pa.bool_())])
    longs = ", ".join(f"{m} long" for m in METRICS)
    spelled = f"doc_id long, {longs}, score double, base_failed boolean, kept boolean"
    return arrow_map(texts, partial(_scored, rules=rules, schema=schema), spelled)


def score(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``score``, ``base_failed`` and ``kept`` for every row.

    Null and empty texts have no words and fail. Rows with the same id stay apart; a null id
    is carried along.
    """
    return _scores(texts_of(docs, id_col, text_col), rules)


def keep(docs: DataFrame, rules: Rules, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return same_rows(docs, partial(_filtered, rules=rules, text_at=docs.columns.index(text_col)))
