import random

import numpy as np
import pytest

from eventlift.llm import packing


def placed(histogram, capacity):
    """Every piece's (length, sequence, offset) under the plan."""
    lengths = np.repeat(np.arange(len(histogram)), histogram)[::-1]
    rows = []
    for run in packing.plan(histogram, capacity):
        for i in range(run.count):
            assert lengths[run.first + i] == run.length
            rows.append((run.length, run.sequence + i // run.per, run.offset + i % run.per * run.length))
    assert len(rows) == len(lengths)
    return rows


def checked(histogram, capacity):
    """Sequences are filled without gaps or overlaps; returns their number."""
    by_sequence = {}
    for length, sequence, offset in placed(histogram, capacity):
        by_sequence.setdefault(sequence, []).append((offset, length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


@pytest.mark.parametrize("seed", range(12))
def test_random_lengths_are_packed_whole_and_tightly(seed):
    r = random.Random(seed)
    capacity = r.choice([16, 64, 256, 1024])
    histogram = np.zeros(capacity + 1, np.int64)
    for _ in range(r.randrange(1, 800)):
        length = r.randrange(1, capacity + 1) if seed % 2 else min(capacity, 1 + int(r.expovariate(8 / capacity)))
        histogram[length] += r.choice([1, 1, 1, 7])
    bins = checked(histogram, capacity)
    total = int((histogram * np.arange(capacity + 1)).sum())
    large = int(histogram[capacity // 2 + 1 :].sum())
    assert bins <= 1.1 * max(-(-total // capacity), large) + 2


def test_small_sets_come_out_optimal():
    histogram = np.zeros(11, np.int64)
    histogram[[6, 4, 5, 10, 3, 7]] = [2, 2, 2, 1, 1, 1]
    assert checked(histogram, 10) == 5


def test_nothing_and_only_full_pieces():
    assert packing.plan(np.zeros(17, np.int64), 16) == []
    histogram = np.zeros(17, np.int64)
    histogram[16] = 5
    assert checked(histogram, 16) == 5
