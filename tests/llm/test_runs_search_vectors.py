"""Periodic runs, ranked search and embedding near-dedup against plain versions."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from test_operators import DDL, ODD, counted, full, prose, tables  # noqa: E402, F401

from shopfloor.llm import grid_order, periodic_runs, signatures  # noqa: E402

RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


# periodic runs


def periodic_texts():
    rng = random.Random(11)
    texts = [None, "", "  ", "a", "a " * 23, "a " * 24, "x " + "a " * 500 + "y", "a b " * 12, "a b " * 11 + "a", "a b c " * 8 + "a b", "a b a a b " * 9]
    for _ in range(60):  # two letters: runs within runs, of many periods
        texts.append(" ".join(rng.choice("ab") for _ in range(rng.randrange(30, 200))))
    for _ in range(60):
        words = prose(rng, rng.randrange(5, 60), 30)
        period = prose(rng, rng.randrange(1, 30), 5)
        turns = rng.randrange(2, 9)
        words += period * turns + period[: rng.randrange(len(period) + 1)] + prose(rng, rng.randrange(0, 30), 30)
        if rng.random() < 0.4:
            words = words * rng.randrange(1, 5)
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    fib = ["a"], ["a", "b"]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    return [*texts, " ".join(fib[1]), " ".join(prose(rng, 3000, 40)), "ü ß\x0b" * 30]


def test_maximal_pairs_are_the_runs(spark):
    texts = periodic_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for least, turns in ((24, 3), (4, 2), (10, 4)):
        got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(docs, least, turns).collect()}
        assert got == {i: brute.periodic_runs(brute.SPACE.findall(t or ""), least, turns) for i, t in enumerate(texts)}


def test_collapsed_text(spark):
    out = periodic_runs.periodic_runs(spark.createDataFrame([(1, "one  two " + "go on now " * 9 + "end"), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.collapsed for r in out} == {1: "one two go on now end", 2: ""}


def test_runs_of_odd_rows(spark, tables):  # noqa: F811
    rows = ODD + [(100 + i, t) for i, t in enumerate(periodic_texts())] + [(1000 + i, " ".join(prose(random.Random(i), 40 + i))) for i in range(60)]
    tables(periodic_runs, documents=spark.createDataFrame(full(rows), DDL).repartition(4))
    got = counted(periodic_runs.op11_periodic_runs(spark, ""), *RUN_COLUMNS)
    assert got == Counter(brute.run_digests(d, t) for d, t in rows)


def test_a_long_periodic_text_takes_few_steps():
    words = np.tile(np.array([5, 6, 7]), 20000)
    order, levels = periodic_runs.suffix_ranks(np.append(words, 99))
    shared = np.append(0, periodic_runs.shared_words(order[:-1], order[1:], levels))
    found = periodic_runs.maximal_pairs(order.tolist(), shared.tolist(), [-1, *words.tolist()], 16, 3)
    assert (0, 3, 59997) in found and len(found) < 20000


# ranked search


@pytest.mark.parametrize("terms", [20_000, 30])
def test_ranked_search(spark, tables, monkeypatch, terms):  # noqa: F811
    monkeypatch.setattr(signatures, "BLOCK_TERMS", terms)
    rng = random.Random(4)
    texts = [t for _, t in ODD if t]
    items = [(i, " ".join(rng.sample(rng.choice(texts).split(), 1) + rng.choice(texts).split()[:12])) for i in range(25)]
    items += [(100, None), (101, "..."), (102, "nowhere1 nowhere2"), (None, "One two words"), (5, "é ü ß"), (5, "漢字 REP rep"), (103, max(texts, key=len))]
    rows = ODD + [(2000 + i, "tie of many rows") for i in range(30)] + [(3000, "tie tie tie of many"), (None, "tie of many rows")]
    tables(signatures, documents=spark.createDataFrame(full(rows), DDL).repartition(4), benchmark=spark.createDataFrame([*items, (104, "tie")], "item_id long, text string"))
    got = counted(signatures.op12_ranked_search(spark, ""), "item_id", "rank", "doc_id", "score")
    assert got == brute.ranked(rows, [*items, (104, "tie")])


def test_bounds_are_never_below_the_scores(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(rng.choice([3, 30, 300])))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ix = signatures.index(docs)
    items = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(5))) for i in range(8)]
    (asked,) = signatures.query_blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    asked.weight = signatures.weights(signatures.held_by(docs, asked), ix.texts)
    score = {(q, d): s for (q, _, d, s) in brute.ranked(rows, items, 10**9)}
    keys = {bytes(r.k): r.doc_id for r in docs.select("doc_id", signatures.text_key(docs["text"]).alias("k")).collect()}
    seen, exact = 0, 0
    for block in map(lambda r: r.asDict(), ix.blocks.collect()):
        for i, bound in signatures.bounds(block, asked, ix.texts, ix.words):
            for key, b in zip(block["keys"], bound.tolist()):
                s = score.get((asked.ids[i].as_py(), keys[bytes(key)]), 0)
                assert b >= s
                seen, exact = seen + 1, exact + (b == s)
    assert ix.texts == 120 and seen and exact > seen / 3


# embedding near-dedup


def vectors():
    rng = np.random.default_rng(6)
    rows = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [float("nan")]), (904, [1.0] * 15 + [None]), (905, [float("inf")] + [1.0] * 15), (906, [0.0, -0.0] * 8), (None, [1.0] * 16)]
    for k in range(6):  # groups around centres, the last one large
        centre = rng.normal(size=16)
        rows += [(k * 100 + i, (centre + rng.normal(size=16) * 0.28).tolist()) for i in range(80 if k == 5 else 12)]
    step = np.linspace(0, 3, 40)
    rows += [(2000 + i, [float(np.cos(s)), float(np.sin(s)), *[0.0] * 14]) for i, s in enumerate(step)]  # a chain
    rows += [(3000 + i, rng.normal(size=16).tolist()) for i in range(80)]
    rows += [(4000 + i, rows[20][1]) for i in range(25)] + [(50, rows[20][1]), (50, rows[30][1]), rows[40], rows[40]]
    rows += [(5000 + i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)]  # another length, ties, zero vectors
    rows += [(6000, (np.array(rows[20][1]) * 7).tolist()), (6001, (np.array(rows[20][1]) * -1).tolist())]
    return rows


@pytest.mark.parametrize(("interval", "leaf", "kind"), [(1 << 19, 256, "float"), (16 * 16, 4, "double")])
def test_near_copies(spark, tables, monkeypatch, interval, leaf, kind):  # noqa: F811
    for name, value in (("INTERVAL", interval), ("LEAF", leaf), ("FAN", 4 if leaf == 4 else 32), ("PARTNERS", 2)):
        monkeypatch.setattr(grid_order, name, value)
    rows = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in vectors()]
    frame = spark.createDataFrame([(i, x, 1, "n") for i, x in rows], f"vec_id long, embedding array<{kind}>, label int, node string")
    tables(grid_order, embeddings=frame.repartition(3))
    assert counted(grid_order.op13_embedding_dedup(spark, ""), "vec_id", "n_links", "component_id", "kept") == brute.vector_links(rows)


def test_distant_intervals_are_skipped(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(6)
    x = np.concatenate([c + rng.normal(size=(64, 6)) * 0.02 for c in centres])
    units = grid_order.unit(x)
    axes = grid_order.principal_axes(x)
    where = grid_order.coordinates(units, axes)
    cuts = np.arange(0, len(where), 16)
    boxes = (np.minimum.reduceat(where, cuts), np.maximum.reduceat(where, cuts))
    near = grid_order.near_leaves(boxes, boxes, grid_order.reach_of(0.9), True)
    linked = np.argwhere(np.triu(units @ units.T >= 0.9, 1)) // 16
    assert near.sum() == 6 * (4 * 5 // 2) and all(near[i, j] for i, j in linked)


def test_the_result_does_not_depend_on_the_axes(spark, monkeypatch):
    rows = [(i, x) for i, x in vectors() if i is not None]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(grid_order, "INTERVAL", 16 * 16)
    monkeypatch.setattr(grid_order, "LEAF", 4)
    monkeypatch.setattr(grid_order, "principal_axes", lambda x, axes=8: np.eye(x.shape[1])[::-1][: min(axes, x.shape[1])].copy())
    assert counted(grid_order.near_copies(frame), "vec_id", "n_links", "component_id", "kept") == brute.vector_links(rows)
