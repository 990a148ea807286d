"""Near-duplicate documents by HyperMinHash (operator 7).

Each document's set of word shingles is sketched into 128 registers: the shingle hash chooses
a register, which keeps the leading zeros and ten mantissa bits of the least hash it saw.
Documents with equal sets are one from then on. Four registers make a band; documents that
agree in a band are compared by their registers, corrected for chance collisions, and joined
into families if they may be similar. Inside a family similarity is decided on the full sets.

No step emits all pairs of a group. A group is searched breadth first, each document against
those not yet reached, and leaves one edge for each document it reached. A group too large
for a task is first compared with its document of least id, each once: near copies are linked by
that alone. Only what is left is compared with the whole group, chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlift import Workspace
from eventlift.llm.components import components
from eventlift.llm.tasks import Batches, arrow_map, batch_of
from eventlift.llm.words import Words, groups, mixed

BUCKET_BITS, MANTISSA = 7, 10
REGISTERS, ROWS = 1 << BUCKET_BITS, 4
BANDS = REGISTERS // ROWS
EMPTY = 0xFFFF
#: A pair goes on if its estimate is at most so many standard deviations below the limit.
DEVIATIONS = 5
#: Members of a band, and bytes of a family's texts, that one task compares at a time.
BAND_MEMBERS = 4096
FAMILY_BYTES = 16 << 20


# -- sketches -------------------------------------------------------------------------------


def shingles(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; of fewer words the whole sequence."""
    sets = []
    for start, stop in groups(texts):
        words = Words([t.lower() for t in texts[start:stop]])
        first, hashes = words.ngrams(n)
        cuts = np.searchsorted(words.doc[first], np.arange(stop - start + 1))
        begins = np.concatenate([[0], np.cumsum(words.per_doc)])
        for i in range(stop - start):
            count = int(words.per_doc[i])
            if count >= n:
                sets.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
                continue
            h = np.zeros(min(count, 1), np.uint64)
            for word in words.hash[begins[i] : begins[i] + count]:
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1))
            sets.append(h)
    return sets


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set: leading zeros and mantissa of the least hash in each bucket."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    rest = np.uint64(BUCKET_BITS)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    value = hashes << rest >> rest
    firsts = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0] if len(bucket) else []
    if len(firsts):  # hashes ascend, so the first of a bucket is its least
        least[bucket[firsts]] = value[firsts]
    full = least != np.iinfo(np.uint64).max
    length = np.frexp((least >> np.uint64(8)).astype(np.float64))[1].astype(np.int64) + 8
    zeros = 64 - BUCKET_BITS - np.minimum(length, 64 - BUCKET_BITS)
    after = least << np.clip(65 - length, 0, 63).astype(np.uint64) >> np.uint64(64 - MANTISSA)
    registers = zeros.astype(np.uint64) << np.uint64(MANTISSA) | after
    return np.where(full, registers, EMPTY).astype(np.uint16)


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two disjoint sets of these sizes are expected to share."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    return 0.169919487159739093975 * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def may_be_similar(one: np.ndarray, n: int, many: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Which of ``many`` sketches may belong to sets as similar to ``one`` as ``limit`` percent."""
    used = (many != EMPTY) | (one != EMPTY)
    matches = ((many == one) & used).sum(1) - chance_matches(sizes, np.array(n))
    filled = used.sum(1)
    share = limit / 100
    margin = DEVIATIONS * np.sqrt(share * (1 - share) / np.maximum(filled, 1))
    near = 100 * np.minimum(sizes, n) >= limit * np.maximum(sizes, n)
    return near & (matches >= (share - margin) * filled)


def _sketched(batches: Batches, n: int, schema: pa.Schema) -> Batches:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        sets = shingles(texts, n)
        prints = [(int(s.sum()), int(mixed(s + np.uint64(1)).sum())) for s in sets]
        signed = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        registers = [sketch(s).tobytes() for s in sets]
        yield batch_of(schema, [batch.column(0), [len(s) for s in sets], signed[:, 0], signed[:, 1], registers])


def sketches(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles``, two sums that tell sets apart, and the registers."""
    types = [pa.int64()] * 4 + [pa.binary()]
    schema = pa.schema(list(zip(["id", "n_shingles", "f1", "f2", "registers"], types, strict=True)))
    spelled = "id long, n_shingles long, f1 long, f2 long, registers binary"
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return arrow_map(texts, partial(_sketched, n=n, schema=schema), spelled)


def _banded(batches: Batches, schema: pa.Schema) -> Batches:
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.stack([np.frombuffer(r, np.uint16) for r in batch.column(1).to_pylist()])
        bands = registers.reshape(len(registers), BANDS, ROWS)
        packed = np.ascontiguousarray(bands).view(np.uint64)[:, :, 0]
        keys = mixed(packed * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64))
        row, band = np.nonzero((bands != EMPTY).any(2))
        yield batch_of(schema, [keys[row, band].view(np.int64), batch.column(0).to_numpy()[row]])


# -- groups searched in tasks ---------------------------------------------------------------


def in_groups(rows: DataFrame, key: str) -> DataFrame:
    """Rows of groups that one task takes, each group in one place."""
    one = rows.withColumns({"a": F.lit(0), "b": F.lit(0)})
    return one.repartition(key).sortWithinPartitions(key, "id")


def _groups_of(batches: Batches, by: int = 3) -> Iterator[pa.RecordBatch]:
    """Runs of rows that are equal in the first columns, also over batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(by)], 1)
        edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:], strict=False):
            key = tuple(keys[start].tolist())
            if held and key != last:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def forest(size: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """One edge for each member reached from an earlier one; ``near(i, others)`` tells which."""
    edges, left, queue = [], np.arange(size), []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        if len(left):
            reached = near(at, left)
            for other in left[reached].tolist():
                edges.append((at, other))
                queue.append(other)
            left = left[~reached]
    return edges


def _band_edges(batches: Batches, limit: int, schema: pa.Schema) -> Batches:
    out: list[np.ndarray] = []
    for group in _groups_of(batches):
        if group.num_rows < 2:
            continue
        ids, sizes = group.column(3).to_numpy(), group.column(4).to_numpy()
        registers = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint16).reshape(-1, REGISTERS)

        def near(i: int, others: np.ndarray, r=registers, s=sizes) -> np.ndarray:
            return may_be_similar(r[i], int(s[i]), r[others], s[others], limit)

        found = forest(len(ids), near)
        if found:
            out.append(ids[np.array(found)])
        if sum(map(len, out)) >= 10_000:
            edges, out = np.concatenate(out), []
            yield batch_of(schema, [edges[:, 0], edges[:, 1]])
    if out:
        edges = np.concatenate(out)
        yield batch_of(schema, [edges[:, 0], edges[:, 1]])


Near = Callable[[int, np.ndarray], np.ndarray]


def exact_near(sets: list[np.ndarray], limit: int) -> Near:
    """Tells which sets share ``limit`` percent of their union with a given one."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    known, dense = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(known), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fit = 100 * np.minimum(sizes[others], sizes[i]) >= limit * np.maximum(sizes[others], sizes[i])
        out = np.zeros(len(others), bool)
        some = others[fit]
        if not len(some):
            return out
        own = dense[ends[i] - sizes[i] : ends[i]]
        marked[own] = True
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        places = np.arange(sizes[some].sum()) + np.repeat(ends[some] - sizes[some] - starts, sizes[some])
        shared = np.add.reduceat(marked[dense[places]].astype(np.int64), starts)
        marked[own] = False
        out[fit] = 100 * shared >= limit * (sizes[some] + sizes[i] - shared)
        return out

    return near


def exact_edges(sets: list[np.ndarray], limit: int) -> list[tuple[int, int]]:
    """A forest of the pairs of sets whose intersection is ``limit`` percent of their union."""
    return forest(len(sets), exact_near(sets, limit))


def _family_edges(batches: Batches, n: int, limit: int, schema: pa.Schema) -> Batches:
    for group in _groups_of(batches):
        if group.num_rows < 2:
            continue
        ids = group.column(3).to_numpy()
        sets = shingles(group.column(4).cast(pa.binary()).to_pylist(), n)
        found = exact_edges(sets, limit)
        if found:
            edges = ids[np.array(found)]
            yield batch_of(schema, [edges[:, 0], edges[:, 1]])


# -- large groups: first the document of least id, then what is left -------------------------

MIDDLE, LINKED, LEFT, ASKS = range(4)


def _band_near(group: pa.RecordBatch, limit: int) -> Near:
    sizes = group.column(5).to_numpy()
    registers = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint16).reshape(-1, REGISTERS)
    return lambda i, others: may_be_similar(registers[i], int(sizes[i]), registers[others], sizes[others], limit)


def _family_near(group: pa.RecordBatch, n: int, limit: int) -> Near:
    return exact_near(shingles(group.column(5).cast(pa.binary()).to_pylist(), n), limit)


def _stars(batches: Batches, near_of: Callable[[pa.RecordBatch], Near], schema: pa.Schema) -> Batches:
    """Edges from a group's middle to the members of a chunk that are like it."""
    for group in _groups_of(batches):
        ids, roles = group.column(3).to_numpy(), group.column(4).to_numpy()
        middle, others = np.flatnonzero(roles == MIDDLE), np.flatnonzero(roles != MIDDLE)
        if not len(middle) or not len(others):
            continue
        hit = others[near_of(group)(int(middle[0]), others)]
        if len(hit):
            keys = np.full(len(hit), group.column(0)[0].as_py(), np.int64)
            yield batch_of(schema, [np.full(len(hit), ids[middle[0]]), ids[hit], keys])


def _left_edges(batches: Batches, near_of: Callable[[pa.RecordBatch], Near], schema: pa.Schema) -> Batches:
    """Edges of members that their group's middle is not like, to all members of a chunk.

    Linked members hang together already, so one edge to any of them will do.
    """
    for group in _groups_of(batches):
        ids, roles = group.column(3).to_numpy(), group.column(4).to_numpy()
        asking, members = np.flatnonzero(roles == ASKS), np.flatnonzero(roles != ASKS)
        if not len(asking) or not len(members):
            continue
        near, edges = near_of(group), []
        for i in asking.tolist():
            others = members[ids[members] != ids[i]]
            hit = others[near(i, others)] if len(others) else others
            linked = roles[hit] == LINKED
            edges += [(ids[i], ids[j]) for j in [*hit[linked][:1].tolist(), *hit[~linked].tolist()]]
        if edges:
            yield batch_of(schema, list(zip(*edges)))


def _large_edges(
    rows: DataFrame,
    key: str,
    columns: list[str],
    weight: Column,
    bound: int,
    near_of: Callable[[pa.RecordBatch], Near],
    workspace: Workspace,
) -> DataFrame:
    """Edges within groups of more than one chunk; ``_chunks`` says of how many.

    Every member meets the middle once. Those that it is not like, in chunks of ``bound``, meet all
    chunks of the group, so that what is shuffled grows with the group, times the chunks left.
    """
    rows = workspace.stage(rows, "large")
    edge_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    own = F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))

    def placed(part: DataFrame, a: Column, b: Column, role: int) -> DataFrame:
        return part.select(key, a.alias("a"), b.alias("b"), "id", F.lit(role).alias("role"), *columns)

    def met(parts: list[DataFrame], task, schema: pa.Schema, spelled: str) -> DataFrame:
        all_ = parts[0]
        for part in parts[1:]:
            all_ = all_.unionAll(part)
        dealt = all_.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b", "id")
        return arrow_map(dealt, partial(task, near_of=near_of, schema=schema), spelled)

    least = rows.groupBy(key).agg(F.min("id").alias("_least"))
    marked = rows.join(least, key)
    middles, others = marked.where("id = _least"), marked.where("id <> _least")
    star_schema = pa.schema([*edge_schema, ("key", pa.int64())])
    first = [placed(middles, every, F.lit(0), MIDDLE), placed(others, own, F.lit(0), LEFT)]
    stars = workspace.stage(met(first, _stars, star_schema, "u long, v long, key long"), "stars")

    linked = stars.select(F.col("key").alias(key), F.col("v").alias("id"))
    left = others.join(linked, [key, "id"], "left_anti")
    parts = F.ceil(F.sum(weight) / bound).cast("int").alias("_parts")
    left = workspace.stage(left.select(key, "id", "_chunks", *columns), "left")
    sizes = left.groupBy(key).agg(parts)
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    hung = others.join(linked, [key, "id"], "left_semi").select(key, "id", "_chunks", *columns)
    hung = hung.unionAll(middles.select(key, "id", "_chunks", *columns))
    second = [
        placed(left.join(sizes, key), part, every, ASKS),
        placed(left.join(sizes, key).withColumn("_a", each), F.col("_a"), own, LEFT),
        placed(hung.join(sizes, key).withColumn("_a", each), F.col("_a"), own, LINKED),
    ]
    return stars.select("u", "v").unionAll(met(second, _left_edges, edge_schema, "u long, v long"))


# -- the whole ------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    limit: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    workspace: Workspace | None = None,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked if their shingle sets share ``limit`` percent of their union;
    ``component_id`` is the least id reachable, and that document is kept. Texts without a
    word are linked with nothing. Rows of one id are one document: a copy of a row changes
    nothing. A row without an id is linked with nothing, has no component and is kept.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    sketched = workspace.stage(sketches(docs, n, id_col, text_col), "sketches")
    print_of = ["n_shingles", "f1", "f2"]
    linkable = sketched.where("n_shingles > 0 AND id IS NOT NULL")
    classes = workspace.stage(linkable.groupBy(*print_of).agg(F.min("id").alias("rep")), "classes")
    reps = linkable.join(classes, print_of).where("id = rep").select("id", "n_shingles", "registers")
    reps = workspace.stage(reps, "representatives")

    key_schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])
    banded = arrow_map(reps.select("id", "registers"), partial(_banded, schema=key_schema), "key long, id long")
    banded = workspace.stage(banded, "bands")
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = banded.join(shared, "key").join(reps, "id")
    members = members.withColumn("_chunks", F.ceil(F.col("members") / BAND_MEMBERS).cast("int"))
    in_bands = in_groups(members.where("_chunks = 1"), "key").select("key", "a", "b", "id", "n_shingles", "registers")
    edge_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    task = partial(_band_edges, limit=limit, schema=edge_schema)
    edges = arrow_map(in_bands, task, "u long, v long")
    large = members.where("_chunks > 1").select("key", "id", "_chunks", "n_shingles", "registers")
    if not shared.where(F.col("members") > BAND_MEMBERS).isEmpty():
        near = partial(_band_near, limit=limit)
        edges = edges.unionAll(
            _large_edges(large, "key", ["n_shingles", "registers"], F.lit(1), BAND_MEMBERS, near, workspace)
        )
    families = workspace.stage(components(edges, workspace), "families")

    # Of a representative's text any row will do that has its set; of several the least.
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # The same plan at every size: a table of families that happens to be small is not sent.
    held = texts.join(families.hint("shuffle_hash"), "id").withColumnRenamed("component", "family")
    held = held.groupBy("id", "family").agg(F.min("text").alias("text"))
    held = workspace.stage(held.withColumn("bytes", F.octet_length("text").cast("long")), "held")
    sizes = held.groupBy("family").agg(F.sum("bytes").alias("all_bytes"))
    sizes = workspace.stage(sizes.withColumn("_chunks", F.greatest(F.ceil(F.col("all_bytes") / FAMILY_BYTES), F.lit(1)).cast("int")), "sizes")
    members = held.join(sizes, "family")
    in_families = in_groups(members.where("_chunks = 1"), "family").select("family", "a", "b", "id", "text")
    task = partial(_family_edges, n=n, limit=limit, schema=edge_schema)
    edges = arrow_map(in_families, task, "u long, v long")
    if not sizes.where("_chunks > 1").isEmpty():
        large = members.where("_chunks > 1").select("family", "id", "_chunks", "bytes", "text")
        near = partial(_family_near, n=n, limit=limit)
        large = large.withColumnRenamed("family", "key")
        edges = edges.unionAll(_large_edges(large.select("key", "id", "_chunks", "text"), "key", ["text"], F.octet_length("text"), FAMILY_BYTES, near, workspace))
    linked = workspace.stage(components(edges, workspace), "linked")

    found = (
        sketched.drop("registers")
        .join(classes, print_of, "left")
        .join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
