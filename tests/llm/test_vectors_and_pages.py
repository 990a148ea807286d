"""Operators 3 and 6."""

import time
import tracemalloc

import numpy as np
import pytest
from conftest import DATA

import __spark_entry__ as contract
from eventlift.llm import html_blocks, html_labeller, pivot_topk


def brute(rows, k):
    """(query, rank, id, score) over rows (id, vector) that take part."""
    whole = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i % 5:
            continue
        scored = sorted((-int(q @ x), j) for j, x in whole if j != i and len(x) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (13, 7)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(pivot_topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(pivot_topk, "BATCH_QUERIES", blocks[1])
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * r.normal(size=8)).tolist()) for i in range(240)]
    rows += [(300 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(400 + i, [1.0, float(i)]) for i in range(12)]  # another length
    rows += [(500, None), (505, []), (510, [1.0, None]), (515, [float("nan")] * 8), (520, [float("inf")] * 8), (525, [0.0] * 8), (530, [1.0, 2.0, 3.0]), (None, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS score")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = sorted(map(tuple, pivot_topk.top_k(df, df["vec_id"] % 5 == 0, k=7).collect()))
    assert found == brute(rows, 7)
    assert pivot_topk.top_k(df.limit(0), df["vec_id"] % 5 == 0).count() == 0


def test_top_k_of_the_whole_table_equals_its_twin(spark, duck):
    df = contract.queries()["op3_pivot_topk"](spark, f"{DATA}/sf0.01")
    columns = ["query_id", "rank", "vec_id", "score"]
    assert df.columns == columns
    found = duck.execute(contract.oracle_sql()["op3_pivot_topk"])
    assert [c[0] for c in found.description] == columns
    expected = sorted(found.fetchall())
    assert len(expected) == 25 * 20 and sorted(map(tuple, df.collect())) == expected


def test_bounds_hold():
    r = np.random.default_rng(1)
    q, x = r.integers(-60, 60, (30, 16)).astype(float), r.integers(-60, 60, (200, 16)).astype(float)
    pivots = pivot_topk.choose_pivots(x, 12)
    bounds = pivot_topk.upper_bounds(q, x, pivot_topk.distances(q, pivots), pivot_topk.distances(x, pivots))
    assert (bounds >= q @ x.T).all()


def test_bounds_of_slices_hold_and_exclude():
    r = np.random.default_rng(2)
    centre = r.integers(-60, 60, (5, 16)) * 20
    x = np.concatenate([c + r.integers(-9, 9, (90, 16)) for c in centre])
    q = np.concatenate([c + r.integers(-9, 9, (6, 16)) for c in centre])
    pivots = centre.astype(float)
    x_away, q_away = pivot_topk.distances(x.astype(float), pivots), pivot_topk.distances(q.astype(float), pivots)
    for large in (1, 1 << 17):  # beyond what floating point holds exactly
        block = pivot_topk._Slices(x * large, np.arange(len(x)) // 2, x_away * large, 3)
        qs = q * large
        bounds = pivot_topk._slice_bounds((qs.astype(float) ** 2).sum(1), q_away * large, block.least, block.most, block.low, block.high)
        true = qs @ block.x.T
        for i, start in enumerate(block.starts):
            assert (bounds[:, i] >= true[:, start : start + pivot_topk.SLICE_ROWS].max(1)).all()
        beat = np.where(np.arange(len(q)) % 3, pivot_topk.NO_SCORE, np.sort(true, 1)[:, -4])
        assert (bounds < np.sort(true, 1)[:, -4, None]).mean() > 0.3
        own = np.arange(len(q))
        who, ids, scores = pivot_topk._best(qs, own, q_away * large, beat, block, 7)
        for i in range(len(q)):
            ranked = sorted((-int(s), int(n)) for s, n in zip(true[i], block.ids, strict=True) if n != i and s >= beat[i])
            assert [(-s, n) for s, n in zip(scores[who == i].tolist(), ids[who == i].tolist(), strict=True)] == ranked[:7]


def test_work_for_a_block_is_a_matrix_product():
    """Bounds are taken for slices, not for each pair: their cost is small beside the scores."""
    r = np.random.default_rng(3)
    x, q = r.integers(-90, 90, (8192, 64)), r.integers(-90, 90, (256, 64))
    pivots = pivot_topk.choose_pivots(x[:500].astype(float), pivot_topk.PIVOTS)
    block = pivot_topk._Slices(x, np.arange(len(x)), pivot_topk.distances(x.astype(float), pivots), 0)
    assert len(block.starts) * pivot_topk.SLICE_ROWS == len(x) and block.low.shape == (256, pivot_topk.PIVOTS)
    away = pivot_topk.distances(q.astype(float), pivots)
    beat = np.full(len(q), pivot_topk.NO_SCORE)
    who, _, scores = pivot_topk._best(q, -np.arange(1, 257), away, beat, block, 20)
    assert (scores.reshape(256, 20) == -np.sort(-(q @ x.T), 1)[:, :20]).all() and (who == np.repeat(np.arange(256), 20)).all()


def test_blocks_of_broken_markup():
    page = (
        "<html><head><title>T &amp; x</title><script>var t='</p><p>no';</script><style>p{}</style></head><body>"
        "<nav><a href='/a'>menu</a></nav><!-- ad <p>no</p> --><article class=\"post main\"><h1>Head</h1>"
        "<p><b>bold text<br>next &eacute;&#233;&nbsp;end<p>second <i>para\n\t graph</i></article><footer>foot"
    )
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["T & x", "menu", "Head", "bold text next éé end", "second para graph", "foot"]
    assert found[1].linked == 4 and "post" in found[2].path and found[-1].path[-1] == "<footer"
    assert html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("a < b <p")] == ["a < b <p"]


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(2)
    model = html_labeller.Labeller()
    size = html_labeller.PATHS + html_labeller.WORDS + html_labeller.EXTRAS
    x = r.normal(size=(5, 3, size)).astype(np.float32) * 0.3
    mask = np.ones((5, 3, 1), np.float32)
    mask[3:, 1] = 0
    labels = r.integers(-1, 2, (5, 3)).astype(np.float32)
    _, grads = model.gradients(x, mask, labels)
    for name, w in model.w.items():
        at = tuple(r.integers(0, s) for s in w.shape)
        old, losses = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = old + step
            losses.append(model.gradients(x, mask, labels)[0])
        w[at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 2e-3, name


@pytest.fixture(scope="module")
def pages(spark):
    from conftest import DATA

    return spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")


def test_held_out_pages(pages):
    rows = pages.collect()
    cut = [html_blocks.blocks(r["html"]) for r in rows]
    model = html_labeller.Labeller().fit(*html_labeller.training_set([r["html"] for r in rows[: html_labeller.SAMPLE]]))
    wrong = known = 0
    for page, found in zip(cut[html_labeller.SAMPLE :], model.label(cut[html_labeller.SAMPLE :]), strict=True):
        for block, main in zip(page, found, strict=True):
            if (label := html_labeller.silver(block)) >= 0:
                known += 1
                wrong += bool(label) != bool(main)
    assert known > 500 and wrong <= 0.002 * known


def test_unseen_layouts(pages):
    """Pages in forms drawn from other seeds than those of the training."""
    import random

    rows = [html_blocks.blocks(r["html"]) for r in pages.collect()]
    model = html_labeller.Labeller().fit(*html_labeller.training_set([r["html"] for r in pages.limit(html_labeller.SAMPLE).collect()]))
    r, wrong, known = random.Random(99), 0, 0
    for page in rows[html_labeller.SAMPLE :]:
        changed, labels = html_labeller._variant(page, r)
        for label, main in zip(labels, model.label([changed])[0], strict=True):
            known += 1
            wrong += bool(label) != bool(main)
    assert wrong <= 0.02 * known


def test_pages_without_content(spark):
    rows = [(1, "u", None), (None, None, ""), (3, "u", "<html><nav>a</nav></html>"), (3, "u", "plain text only, with no markup at all.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    out = html_labeller.extract(df).collect()
    assert len(out) == 4 and [(r["text"], r["n_chars"]) for r in out[:2]] == [("", 0), ("", 0)]
    assert html_labeller.extract(df.limit(0)).count() == 0


HOSTILE = {
    "tags that never end": "<a b " * 200_000,
    "quotes that never end": "<a \"'" * 160_000,
    "quotes in turn": "'<a \"b>" * 140_000,
    "names that never end": "<a" * 500_000,
    "declarations that never end": "<!x" * 300_000,
    "deep": "<div>x" * 160_000,
    "inline tags closed by others": "<i>" * 150_000 + "</b>" * 150_000,
    "inline tags behind a block": "<b><div>" + "<i>" * 150_000 + "</b>" * 150_000,
    "many blocks": "<p>some words, and more." * 60_000,
    "references": "&amp;&#x41;&nope" * 60_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_cost_little(name):
    began = time.process_time()
    cut = html_blocks.blocks(HOSTILE[name])
    assert time.process_time() - began < 10
    assert cut or "inline" in name


def test_a_long_page_is_labelled_in_bounded_memory():
    page = html_blocks.blocks(HOSTILE["many blocks"])
    assert len(page) == 60_000
    labeller = html_labeller.Labeller()
    tracemalloc.start()
    began = time.process_time()
    (labels,) = labeller.label([page])
    seconds, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(labels) == 60_000 and seconds < 60 and peak < 200 << 20
    whole = labeller._forward(*html_labeller._padded(np.tanh(html_labeller.vectors([page[:3000]]) @ labeller.w["project"]), [3000]))[-1]
    assert ((whole[:, 0] > 0.5) == labeller.label([page[:3000]])[0]).mean() > 0.999


def test_tags_end_outside_quotes():
    def texts(page):
        return [b.text for b in html_blocks.blocks(page)]

    assert texts("<p title='a>b' x=\"<p>\">one<p>two") == ["one", "two"]
    assert texts("<p \"x>one</p>two") == ['<p "x>one', "two"]
    assert texts("a </p \"x>b</ >c<!d>e<?f>g") == ["a bceg"]
    assert texts("<p>1<b>2<div>3</b>4</div>5</b>6") == ["12", "34", "56"]
