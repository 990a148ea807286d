"""Personal data by candidates and boosted trees (operator 8). DataFrame functions only.

Strict patterns give the base spans. Next to them, looser patterns propose candidates that may
overlap; each is described by its format and its surroundings in a few small integers. Trees
boosted on labelled examples score the candidates, and those above a threshold, calibrated for their
kind on examples held out of the fit, are added where no base span is.

The examples are made by rule, so many of each sort whatever the table: personal data in forms that
the strict patterns miss (``name(at)host.org``, a card number with dots or with a wrong digit after the
word card, a phone number without plus after the word call) and look-alikes that are none (numbers
that fail the check and stand alone, dates, versions, lists). So the trees and thresholds are the
same for every table, and a document gets the same spans whatever stands beside it.

Positions come from one search: what lies between matches, and the matches, in turn, add up
to the text, and lengths count code points. Patterns run over characters or a marker that
stands for an inner separator, never over repeated groups, so that a match of any length
needs no stack, and they start only where a match can start. Running sums over matches and sweeps over
sorted spans go block by block (``_running``), so that many matches in a text cost little each.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlift import Workspace

KINDS = ["email", "ip", "card", "phone"]
MARK, OTHER = "\x01", "\x02"
#: Labelled examples that the trees are fitted on and calibrated with, half of them each.
EXAMPLES = 16_000
ROUNDS, DEPTH, RATE = 30, 3, 0.3
#: A kind's threshold: the lowest score at which so many of the held-out candidates are personal data.
PRECISION = 0.995
FEATURES = ["kind", "size", "digits", "groups", "marks", "left", "right", "cue", "ending", "check"]
CUES = [r"\b(e-?mail|contact)", r"\b(ip|host|server|addr)", r"\b(card|visa|pay|account|credit)", r"\b(tel|phone|call|fax|mobil)"]
#: Matches that a running sum copies at a time.
BLOCK = 256

_LOCAL = f"[A-Za-z0-9._%+{MARK}-]"
_LABEL = "[A-Za-z0-9-]"
#: Strict patterns over the marked text: dots between labels for emails, single separators
#: between digits for cards.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++{MARK}[A-Za-z0-9{MARK}-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{MARK}]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![^\s@<>()\[\]\",;])[^\s@<>()\[\]\",;]++(?:@|\(at\)|\[at\])[^\s@<>()\[\]\",;]++",
    "ip": r"(?<![0-9.:,])[0-9]{1,4}[.:,][0-9]{1,4}[.:,][0-9]{1,4}[.:,][0-9]{1,4}(?![0-9])",
    "card": r"(?<![0-9])[0-9][0-9 .-]{10,28}[0-9](?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ().-]{6,20}[0-9](?![0-9])",
}
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(
    items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str
) -> Column:
    """What ``step(state, item)`` gives out for each item, handing its state on to the next.

    Appending to an array copies it, so outputs are appended to a block's and blocks to all.
    """
    outs = F.array().cast(f"array<{out}>")

    def one(acc: Column, item: Column) -> Column:
        state, given = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["outs"], F.array(given)).alias("outs"))

    def walk(held: Column) -> Column:
        def block(acc: Column, number: Column) -> Column:
            own = F.slice(held, number * BLOCK + 1, F.lit(BLOCK))
            done = F.aggregate(own, F.struct(acc["state"].alias("state"), outs.alias("outs")), one)
            return _let(
                done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["outs"], F.array(d["outs"])).alias("outs"))
            )

        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{out}>>").alias("outs"))
        return F.when(F.size(held) > 0, F.aggregate(numbers, start, block, lambda acc: F.flatten(acc["outs"]))).otherwise(outs)

    return _let(items, walk)


def _located(text: Column, pattern: str, make: Callable[..., Column]) -> Column:
    """``make(start, match, before, after)`` for each leftmost match that does not overlap."""

    def placed(cut: Column) -> Column:
        found, between = cut["found"], cut["between"]
        pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))

        def start(at: Column, pair: Column) -> tuple[Column, Column]:
            begin = at + F.length(pair["b"])
            return begin + F.length(pair["m"]), begin

        starts = _running(pairs, F.lit(0), start, "int")
        return F.transform(
            starts, lambda begin, i: make(begin, F.get(found, i), F.get(between, i), F.get(between, i + 1))
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("between")), placed)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    places = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * (2 - i % 2),
    )
    return F.aggregate(places, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return _luhn_sum(digits) % 10 == 0


def _is_small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(plain) <= 3) & (F.rpad(plain, 3, " ").cast("int") <= 255)


_HOLDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "[.]"), _is_small),
    "card": lambda m: F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
_NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
_NEEDED_LOOSE = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9][.:,][0-9]", "card": "[0-9][0-9 .-]{10}", "phone": "[0-9][0-9 ().-]{6}"}


def _base(text: Column) -> Column:
    """All base spans, by kind and start."""
    plain = F.translate(text, MARK, OTHER)
    marked = {
        "email": F.regexp_replace(plain, f"(?<={_LABEL})[.](?={_LABEL})", MARK),
        "ip": plain,
        "card": F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", MARK),
        "phone": plain,
    }
    parts = []
    for number, kind in enumerate(KINDS):

        def span(start: Column, match: Column, _before: Column, _after: Column, n=number, k=kind) -> Column:
            return F.struct(
                F.lit(n).alias("kind"),
                start.alias("start"),
                (start + F.length(match)).alias("end"),
                _HOLDS[k](match).alias("holds"),
            )

        spans = F.filter(_located(marked[kind], BASE[kind], span), lambda s: s["holds"])
        bare = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        parts.append(F.when(text.rlike(_NEEDED[kind]), bare).otherwise(F.array().cast(_SPANS)))
    return F.concat(*parts)


#: What a candidate of each kind has to meet, whatever its separators are.
_CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: m.rlike(r"(@|[(\[]at[)\]])[^@.]+[.][A-Za-z]{2,}"),
    "ip": lambda m: F.forall(F.split(m, "[.:,]"), _is_small),
    "card": _HOLDS["card"],
    "phone": _HOLDS["phone"],
}


def _beside(part: Column) -> Column:
    """What stands next to a candidate: 0 white space or nothing, 1 a letter, 2 a digit, 3 another mark."""
    return (
        F.when((part == "") | part.rlike(r"^\s"), 0).when(part.rlike(r"^\p{L}"), 1).when(part.rlike("^[0-9]"), 2).otherwise(3)
    )


def _candidates(text: Column) -> Column:
    """Loose spans with their descriptions; ``code`` packs the description into one number."""
    parts = []
    for number, kind in enumerate(KINDS):

        def span(start: Column, match: Column, before: Column, after: Column, n=number, k=kind) -> Column:
            near = F.lower(F.right(before, F.lit(24)))
            marks = sum((F.contains(match, F.lit(c)).cast("int") * (1 << i) for i, c in enumerate(".- (+")), F.lit(0))
            values = [
                F.lit(n),
                F.least(F.length(match) / 3, F.lit(15)),
                F.least(F.length(_digits(match)), F.lit(20)),
                F.least(F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))), F.lit(8)),
                marks,
                _beside(F.right(before, F.lit(1))),
                _beside(F.left(after, F.lit(1))),
                near.rlike(CUES[n]).cast("int"),
                match.rlike(r"[.][A-Za-z]{2,}[.]?$").cast("int"),
                _CHECKS[k](match).cast("int"),
            ]
            described = [v.cast("int").alias(f) for v, f in zip(values, FEATURES, strict=True)]
            return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), *described)

        spans = _located(text, LOOSE[kind], span)
        empty = F.array().cast("array<struct<start:int,end:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>")
        parts.append(F.when(text.rlike(_NEEDED_LOOSE[kind]), spans).otherwise(empty))
    return F.concat(*parts)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


# Words of the examples, neutral ones and those the cues look for.
_WORDS = {
    "neutral": ["of", "and", "the", "about", "with", "item", "page", "version", "in", "on", "see", "total"],
    "name": ["maria", "j.smith", "info", "kim_lee", "otto", "a.b", "sales", "ana"],
    "host": ["mail", "example", "uni", "post", "shop", "home"],
    "ending": ["org", "com", "net", "de", "info"],
    "cue0": ["email", "contact"],
    "cue1": ["host", "server", "ip", "address"],
    "cue2": ["card", "visa", "pay by", "account"],
    "cue3": ["call", "phone", "tel", "fax"],
}


def examples(spark: SparkSession, rows: int = EXAMPLES) -> DataFrame:
    """``id, kind, real, text, start, end``: texts with one value each, real personal data or a look-alike.

    A fourth of them is of each kind, half of these real; ``form`` is one of three sorts of either. Numbers
    are hashes of the row's number.
    """

    def draw(below: int, salt: int) -> str:
        return f"pmod(xxhash64(id, {salt}), {below})"

    def pick(words: str, salt: int) -> str:
        listed = ", ".join(f"'{w}'" for w in _WORDS[words])
        return f"element_at(array({listed}), CAST({draw(len(_WORDS[words]), salt)} AS INT) + 1)"

    def digits(n: int, salt: int) -> str:
        return f"lpad(CAST({draw(10**n, salt)} AS STRING), {n}, '0')"

    def case(column: str, *values: str) -> str:
        return f"CASE {column} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    def either(real: list[str], other: list[str]) -> str:
        return f"IF(real, {case('form', *real)}, {case('form', *other)})"

    made = spark.range(rows).selectExpr(
        "id", "CAST(id % 4 AS INT) AS kind", "(id DIV 4) % 2 = 0 AS real", f"CAST({draw(3, 1)} AS INT) AS form",
        f"{digits(15, 2)} AS d15", f"element_at(array('', ' ', '-', '.'), CAST({draw(4, 3)} AS INT) + 1) AS mark",
        f"{pick('name', 4)} AS name", f"{pick('host', 5)} AS host", f"{pick('ending', 6)} AS ending",
        *[f"CAST({draw(256, 10 + i)} AS STRING) AS p{i}" for i in range(4)],
        f"CAST(256 + {draw(744, 14)} AS STRING) AS much", f"{draw(2, 15)} = 0 AS coin", f"{digits(8, 16)} AS d8",
    )
    right = (10 - _luhn_sum(F.concat("d15", F.lit("0"))) % 10) % 10
    made = made.withColumn("right", right).withColumn("wrong", F.expr(f"(right + 1 + {draw(9, 7)}) % 10"))
    numbers = [f"concat(d15, CAST({c} AS STRING))" for c in ("right", "wrong")]
    good, bad = ("concat_ws({0}, " + ", ".join(f"substring({n}, {1 + 4 * i}, 4)" for i in range(4)) + ")" for n in numbers)
    four = "concat_ws({0}, p0, p1, p2, p3)"
    phone = [
        "concat('0', substring(d8, 1, 2), '-', d8)",
        "concat('(0', substring(d8, 1, 2), ') ', substring(d8, 1, 4), ' ', substring(d8, 5, 4))",
        "concat_ws(' ', concat('0', substring(d8, 1, 3)), substring(d8, 3, 3), substring(d8, 6, 3))",
    ]
    values = [
        either(
            ["concat(name, '(at)', host, '.', ending)", "concat(name, '[at]', host, '.', ending)", "concat(name, '(at)', host, '-', p0, '.', ending)"],
            ["concat(host, '(at)', host)", "concat(name, '@', host)", "concat(host, '(at)', p0, '.', p1)"],
        ),
        either(
            [four.format("':'"), four.format("','"), four.format("':'")],
            [four.format("IF(coin, ':', ',')"), "concat_ws('.', p0, much, p2, p3)", "concat_ws(IF(coin, ':', '.'), p0, p1, much, p3)"],
        ),
        either(
            [good.format("'.'"), good.format("IF(coin, '.', ' - ')"), bad.format("mark")],
            [bad.format("mark"), bad.format("''"), "concat(substring(d15, 1, 8), mark, substring(d15, 9, 4))"],
        ),
        either(
            phone,
            [phone[0], "concat_ws(' ', d8, substring(d15, 1, 4))", "concat(substring(d8, 1, 4), '-', substring(d8, 5, 2), '-', substring(d8, 7, 2))"],
        ),
    ]
    cued = case("kind", "coin", "real OR (form = 1 AND coin)", "real AND (form = 2 OR coin)", "real OR (form = 2 AND coin)")
    cue = case("kind", *[pick(f"cue{k}", 8) for k in range(len(KINDS))])
    return (
        made.selectExpr("*", f"{case('kind', *values)} AS value", f"IF({cued}, {cue}, {pick('neutral', 8)}) AS word")
        .selectExpr("*", f"concat({pick('neutral', 17)}, ' ', word, ' ') AS ahead")
        .selectExpr(
            "id", "kind", "real", f"concat(ahead, value, ' ', {pick('neutral', 9)}) AS text",
            "length(ahead) AS start", "length(ahead) + length(value) AS end",
        )
    )


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base spans and the candidates of each text, as ``_base`` and ``_loose``."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.withColumns({"_base": _base(text), "_loose": _candidates(text)})


# -- boosted trees over counted descriptions ------------------------------------------------


class Tree(NamedTuple):
    """A node: below ``cut`` of a feature to ``low``, else to ``high``; a leaf has a value."""

    value: float
    feature: int = -1
    cut: int = 0
    low: Tree | None = None
    high: Tree | None = None


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """The tree that lowers the logistic loss most, split by split."""
    if not depth:
        return Tree(_leaf(g, h))
    total = g.sum() ** 2 / (h.sum() + 1.0)
    best = (1e-6, -1, 0)
    for feature in range(x.shape[1]):
        for cut in np.unique(x[:, feature])[1:]:
            low = x[:, feature] < cut
            gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0) - total
            best = max(best, (float(gain), feature, int(cut)))
    _, feature, cut = best
    if feature < 0:
        return Tree(_leaf(g, h))
    low = x[:, feature] < cut
    return Tree(0.0, feature, cut, _grown(x[low], g[low], h[low], depth - 1), _grown(x[~low], g[~low], h[~low], depth - 1))


def _value(tree: Tree, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] < tree.cut, _value(tree.low, x), _value(tree.high, x))


def boost(x: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> list[Tree]:
    """Trees whose sum is the log odds of a hit, from counts of hits and misses."""
    score, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        n = hits + misses
        tree = _grown(x, hits - n * p, n * p * (1 - p), DEPTH)
        trees.append(tree)
        score += RATE * _value(tree, x)
    return trees


def _sql(tree: Tree, of: str) -> str:
    if tree.feature < 0:
        return f"{RATE * tree.value!r}D"
    low, high = _sql(tree.low, of), _sql(tree.high, of)
    return f"CASE WHEN {of}.{FEATURES[tree.feature]} < {tree.cut} THEN {low} ELSE {high} END"


def thresholds(trees: list[Tree], x: np.ndarray, hits: np.ndarray, misses: np.ndarray) -> list[float]:
    """For each kind the lowest score above which held-out candidates are hits often enough."""
    score = sum((RATE * _value(t, x) for t in trees), np.zeros(len(x)))
    found = []
    for kind in range(len(KINDS)):
        own = np.nonzero(x[:, 0] == kind)[0]
        order = own[np.argsort(-score[own], kind="stable")]
        good, all_ = np.cumsum(hits[order]), np.cumsum((hits + misses)[order])
        ends = np.append(score[order][1:] < score[order][:-1], True)[: len(order)]
        fine = np.nonzero(ends & (good >= PRECISION * all_))[0]
        found.append(float(score[order[fine[-1]]]))
    return found


def described(spark: SparkSession, rows: int = EXAMPLES) -> list[np.ndarray]:
    """Descriptions of the examples' candidates with their hits and number, fitted and held out.

    The driver sees a row for each description.
    """
    hit = "real AND c.kind = kind AND c.start < end AND start < c.end"
    made = examples(spark, rows).withColumn("c", F.explode(_candidates(F.col("text"))))
    counted = (
        made.selectExpr("pmod(xxhash64(id, 0), 2) AS held", *[f"c.{f} AS _{f}" for f in FEATURES], f"CAST({hit} AS INT) AS hit")
        .groupBy("held", *[f"_{f}" for f in FEATURES])
        .agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    )
    table = np.array([[r[c] for c in ("held", "hits", "n", *[f"_{f}" for f in FEATURES])] for r in counted.collect()], np.int64)
    table = table[np.lexsort(table.T)]
    return [table[table[:, 0] == held, 1:] for held in (0, 1)]


def fit(spark: SparkSession, rows: int = EXAMPLES) -> tuple[list[Tree], list[float]]:
    """Trees and a threshold for each kind, from the examples alone; half of them are held out."""
    fitted, held = described(spark, rows)
    trees = boost(fitted[:, 2:], fitted[:, 0].astype(float), (fitted[:, 1] - fitted[:, 0]).astype(float))
    return trees, thresholds(trees, held[:, 2:], held[:, 0].astype(float), (held[:, 1] - held[:, 0]).astype(float))


_SCORED = "struct<start:int,end:int,kind:int,score:double,base:boolean>"


def _swept(spans_: Column, backward: bool) -> Column:
    """Scored spans in order of start, without those a base span reaches from the one side."""
    if backward:

        def step(state: Column, s: Column) -> tuple[Column, Column]:
            return F.when(s["base"], F.least(state, s["start"])).otherwise(state), s["base"] | (state >= s["end"])

        zero = F.lit((1 << 31) - 1)
    else:

        def step(state: Column, s: Column) -> tuple[Column, Column]:
            return F.when(s["base"], F.greatest(state, s["end"])).otherwise(state), s["base"] | (state <= s["start"])

        zero = F.lit(-1)
    return _let(
        F.reverse(spans_) if backward else spans_,
        lambda held: _let(
            _running(held, zero, step, "boolean"), lambda kept: F.filter(held, lambda s, i: F.get(kept, i))
        ),
    )


def _best(free: Column) -> Column:
    """Of spans in order of start those that stay: of two that overlap the one of the higher score."""
    ahead = F.expr(f"CAST(named_struct('start', -1, 'end', -1, 'kind', 0, 'score', -1e9D, 'base', false) AS {_SCORED})")
    last = F.expr(f"CAST(named_struct('start', {(1 << 31) - 1}, 'end', 0, 'kind', 0, 'score', 0D, 'base', false) AS {_SCORED})")

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        fresh = s["start"] >= state["end"]
        return F.when(fresh | (s["score"] > state["score"]), s).otherwise(state), F.when(fresh, state)

    given = _running(F.concat(free, F.array(last)), ahead, step, _SCORED)
    return F.filter(given, lambda s: s.isNotNull() & (s["start"] >= 0))


def spans(found: DataFrame, trees: list[Tree], limits: list[float]) -> DataFrame:
    """``find``'s columns with ``_spans``: base spans and those added, by kind and start."""
    score = " + ".join(_sql(t, "c") for t in trees)
    limit = "CASE c.kind " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in enumerate(limits)) + " END"
    scored = F.expr(
        "transform(_loose, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'score',"
        f" ({score}) - ({limit}), 'base', false))"
    )
    likely = F.filter(scored, lambda c: c["score"] >= 0)
    base = F.expr("transform(_base, b -> named_struct('start', b.start, 'end', b.end, 'kind', b.kind, 'score', 0D, 'base', true))")

    def added(kept: Column) -> Column:
        # a base span comes before a candidate that starts with it
        in_order = F.array_sort(
            F.concat(kept, base), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["base"] & ~b["base"], -1).when(b["base"] & ~a["base"], 1).otherwise(F.signum(a["kind"] - b["kind"]).cast("int")),
        )
        free = F.filter(F.reverse(_swept(_swept(in_order, False), True)), lambda s: ~s["base"])
        bare = F.transform(_best(free), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(F.size(kept) > 0, F.array_sort(F.concat("_base", bare))).otherwise(F.col("_base"))

    return found.withColumn("_spans", _let(likely, added))


def _spelled(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def detect(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None
) -> DataFrame:
    """``doc_id``, base spans by kind, a digest of them, and all spans.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows
    and null ids stay as they are; an empty table gives an empty one.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = workspace.stage(find(plain).drop("text"), "found")
    counts = [F.expr(f"size(filter(_base, s -> s.kind = {n}))").cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return spans(found, *fit(docs.sparkSession)).select(
        "doc_id", *counts, F.sha2(_spelled("_base"), 256).alias("base_sha256"), _spelled("_spans").alias("spans")
    )


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", workspace: Workspace | None = None
) -> DataFrame:
    """``docs`` with every span, merged where spans overlap, replaced by its kind in brackets.

    Columns keep their names, order and types; a null text stays null.
    """
    workspace = workspace or Workspace(docs.sparkSession)
    held = docs.select(F.struct("*").alias("row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = workspace.stage(find(held), "found")
    placed = spans(found, *fit(docs.sparkSession))
    ordered = F.array_sort(
        F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    text, names = F.col("text"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def after(at: Column, s: Column) -> tuple[Column, Column]:
        fresh = F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, fresh)

    apart = F.filter(_running(ordered, F.lit(0), after, "struct<at:int,start:int,kind:int>"), lambda s: s.isNotNull())

    def block(own: Column) -> Column:
        # a piece is cut from its block's stretch of the text, not from all of it
        first, end = F.get(own, 0)["at"], F.element_at(own, -1)["start"]
        stretch = F.struct(F.substring(text, first + 1, end - first).alias("text"), first.alias("at"))
        return _let(
            stretch,
            lambda c: F.transform(
                own,
                lambda s: F.concat(F.substring(c["text"], s["at"] - c["at"] + 1, s["start"] - s["at"]), F.get(names, s["kind"])),
            ),
        )

    def blocks(held: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda k: _let(F.slice(held, k * BLOCK + 1, F.lit(BLOCK)), block))

    pieces = F.flatten(_let(apart, blocks))
    last = F.array_max(F.transform("_spans", lambda s: s["end"]))
    rest = F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))
    clean = F.when(F.size("_spans") > 0, rest).otherwise(text)
    return placed.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
