"""The corpus operators on hand-made hard cases against plain versions, and on the small tables against SQL."""

import math
import random
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from helpers import corpus_connection  # noqa: E402

from checks.runall import compare  # noqa: E402
from conftest import SF_DIR  # noqa: E402
from shopfloor.llm import automata, components, decontamination, dom, extraction, jaccard, licences, mixing, quality_model, quality_rules, queries, sharding, suffixes  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, slot string, text_key string, key string, node int, component int, taken int, target int, n_words string, license int, `_n` int, `_first` int, `_row` string, `_key` string, row int, bucket int, first int, place string, n int, of int, whole string, cut int, a int, b int, link int, leaf int, `two words` int"


def prose(rng, n, vocabulary=4000):
    return [f"{rng.choice('abcdefgh')}w{rng.randrange(vocabulary)}" for _ in range(n)]


def hard_rows():
    """Null and empty texts, white space of all kinds, long texts, ties, copies, near copies, shared passages, many-fold passages."""
    rng = random.Random(7)
    base, passage, hot = prose(rng, 220), prose(rng, 130), prose(rng, 90)
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "One", "two words", "a b c", "A B C D", "é ü ß 漢字 x", "x" * 3000, "rep " * 600, "line one is here\nline one is here\n\nline one is here\n \n \n"]
    for k in range(14):  # near copies of each other by way of a middle one
        words = list(base)
        for j in range(k % 5):
            words[(37 * k + 41 * j) % len(words)] = f"edit{k}x{j}"
        texts.append(" ".join(words))
    texts += [" ".join(base), "  ".join(base), " ".join(base).upper()]
    for k in range(9):
        texts.append(" ".join(prose(rng, 20 + 9 * k) + passage[k : 60 + 8 * k] + prose(rng, 15)))
    for k in range(25):
        texts.append("\n".join(prose(rng, rng.randrange(3, 40)) + [" ".join(hot)] + prose(rng, rng.randrange(3, 40))))
    long = prose(rng, 15000)
    texts += [" ".join(long), " ".join(long[:9000] + prose(rng, 50) + long[9000:]), " ".join(passage + prose(rng, 12) + passage)]
    texts += [" ".join(prose(rng, rng.randrange(1, 120))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def full(rows):
    return [(d, t, "en", None if d is None else f"s{d % 3}", 0, 9, "x", "y", "z", "k", 1, 2, 3, 4, "w", 5, 6, 7, "r", "q", 8, 9, 1, "p", 2, 3, "h", 4, 5, 6, 7, 8, 9) for d, t in rows]


ROWS = hard_rows()
ODD = ROWS + [(None, ROWS[0][1]), (None, "no id"), (None, None), (5, "same id, other text"), ROWS[3], ROWS[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(full(ROWS), DDL).repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(full(ODD), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def tables(monkeypatch):
    """Queries read the given frames in place of files."""

    def put(module, **frames):
        monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: frames[name])

    return put


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF_DIR), corpus_connection(SF_DIR), queries.SQL[name])
    assert ok, note


def test_all_queries_on_an_empty_table(spark, tables, empty):
    ddls = ("doc_id long, quality int", "item_id long, text string", "page_id long, url string, html string", "vec_id long, embedding array<float>, label int")
    labels, bench, pages, vectors = (spark.createDataFrame([], x) for x in ddls)
    for name, query in queries.QUERIES.items():
        module = sys.modules[query.__module__]
        tables(module, documents=empty, labels=labels, benchmark=bench, pages=pages, embeddings=vectors)
        assert query(spark, "").collect() == [], name


# quality rules and classifier


def test_base_counts(spark, odd):
    got = counted(quality_rules.quality_rules(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for doc, text in ODD:
        c = brute.base_counts(text)
        want[(doc, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want


def test_compression_bands(spark):
    rng = random.Random(1)
    natural = " ".join(rng.choice("the a of and in to is it house river walk green slowly under over light table seven".split()) + rng.choice(["", "s", "ed", "ing", ","]) for _ in range(900))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2FFF)) for _ in range(12)) for _ in range(400))
    loop = " ".join(f"{i % 7} item {'abcdefghij' * 4} {i}" for i in range(900))
    rows = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame([(1, natural), (2, noise), (3, loop)], "doc_id long, text string")).collect()}
    assert (rows[1].kept, rows[3].kept) == (True, False)
    assert rows[2].zstd_ratio < rows[1].zstd_ratio < rows[3].zstd_ratio


def test_the_tail_of_a_text_is_judged(spark):
    """4,096 bytes of prose and 4,095 of printable noise, and prose alone."""
    rng = random.Random(5)
    words = "the a of and in to is it house river walk green slowly under over light table seven".split()
    natural = " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing", ","]) for _ in range(2500))
    noise = "".join(" " if i % 9 == 8 else chr(rng.randrange(33, 127)) for i in range(4095))
    rows = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame([(1, natural[:4096] + noise), (2, natural[:8191]), (3, natural[:5000])], "doc_id long, text string")).collect()}
    assert not rows[1].base_failed and not rows[1].kept and rows[1].zstd_ratio > 1.3 and abs(rows[1].chunks_outside - 4095 / 8191) < 1e-9
    assert rows[2].kept and rows[3].kept and rows[2].chunks_outside == rows[3].chunks_outside == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] * x[:, 0] > 0)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93

    def walk(row):  # one row and one node at a time
        total = model.start
        for t in range(len(model.feature)):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        return 1 / (1 + math.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))


def test_one_kind_of_label_gives_its_mean():
    x = np.ones((4, 2))
    assert np.allclose(quality_model.fit(x, np.ones(4)).score(x), 1, atol=1e-5)
    assert np.allclose(quality_model.fit(x[:0], np.ones(0)).score(x), 0.5)


def test_held_out_accuracy(spark):
    rows = quality_model.op6_quality_model(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = [(r.held_out, r.predicted == r.quality) for r in rows.join(labels, "doc_id").collect()]
    assert rows.count() == 1000
    assert sum(ok for held, ok in got if held) >= 0.95 * sum(held for held, _ in got)


def test_odd_rows_are_scored(spark, odd, tables):
    tables(quality_model, documents=odd, labels=spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int"))
    got = quality_model.op6_quality_model(spark, "").collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


# sharding


def test_shards_and_slots(spark, odd, tables):
    tables(sharding, documents=odd)
    rows = sharding.op4_shard(spark, "").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 16, brute.crc(t)) for d, t in ODD)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})


def test_growth_and_weights_move_little(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = sharding.layout()
    heavier = (*tree[:4], ("r4", (tree[4][1][0], ("r4k1", (*tree[4][1][1][1][:3], (39, 3.0))))))
    from pyspark.sql import functions as F

    rows = ids.select(*(sharding.shard_of(F.col("doc_id"), t).alias(n) for t, n in ((tree, "a"), (sharding.grown(tree), "b"), (heavier, "c")))).collect()
    count = Counter(r.a for r in rows)
    assert len(count) == 40 and max(abs(n - 500) for n in count.values()) < 110
    moved = [r.b for r in rows if r.a != r.b]
    assert set(moved) == {40} and abs(len(moved) - 20000 / 41) < 110
    assert all(r.c // 8 == 4 for r in rows if r.a != r.c), "only the region whose weight rose gains rows"
    assert abs(sum(r.c == 39 for r in rows) - 3 * 20000 / 42) < 160


# mixing


def test_mix_meets_targets(spark, odd, tables):
    tables(mixing, documents=odd)
    rows = mixing.op7_mix(spark, "").collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((d, len(brute.SPACE.findall(t or ""))) for d, t in ODD)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    again = counted(mixing.op7_mix(spark, ""), "doc_id", "size", "taken")
    assert again == Counter((r.doc_id, r["size"], r.taken) for r in rows)
    total = sum(r["size"] for r in rows)
    goals = {(None if r.doc_id is None else r.doc_id % 3): (r.source_size, r.target) for r in rows}
    assert math.isclose(sum(t for _, t in goals.values()), 1.5 * total)
    for source, (size, target) in goals.items():
        mine = [r for r in rows if (None if r.doc_id is None else r.doc_id % 3) == source]
        assert sum(r["size"] for r in mine) == size and target <= 2 * size
        assert abs(sum(r.taken for r in mine) - target) <= max(r["size"] for r in mine) * 3 / 2


def test_mix_repeats_rows_and_keeps_columns(spark, odd):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    taken = Counter(r.text for r in out.collect())
    assert set(taken.values()) - {0} and set(taken) <= {t for _, t in ODD}


# decontamination


def benchmark_items():
    rng = random.Random(3)
    texts = dict(ROWS)
    long = max((t for t in texts.values() if t), key=len).split()
    return [("b", " ".join(long[100:140])), (7, " ".join(long[300:309]).upper()), ("short", "Two, words!"), ("none", None), ("blank", "?! ..."), ("far", " ".join(prose(rng, 40, 10**9))), ("b", " ".join(long[100:140])), (None, "A b: c D")]


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate(spark, odd, tables, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    items = [(None if i is None else str(i), t) for i, t in benchmark_items()]
    tables(decontamination, documents=odd, benchmark=spark.createDataFrame(items, "item_id string, text string"))
    out = decontamination.op8_decontaminate(spark, "")
    got = counted(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.decontaminate(ODD, items)


def test_items_that_share_a_sentence_add_no_candidates(spark, monkeypatch):
    """1,000 items with one sentence in common, met in 40 texts: places in proportion to what occurs, not to items x texts."""
    rng = random.Random(8)
    shared = prose(rng, 14)
    items = [(f"i{k}", " ".join(shared + prose(rng, 3, 10**9))) for k in range(1000)]
    rows = [(d, " ".join(prose(rng, 20) + shared + prose(rng, d % 7))) for d in range(40)] + [(99, " ".join(prose(rng, 60)))]
    seen, plain = [], decontamination.verified

    def counted_places(docs, found, numbers):
        seen.append(found.count())
        return plain(docs, found, numbers)

    monkeypatch.setattr(decontamination, "verified", counted_places)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontamination.decontaminate(docs, bench).collect()}
    every = ",".join(sorted(k for k, _ in items))
    assert got == {(d, len(t.split()), 14 if d != 99 else 0, every if d != 99 else "") for d, t in rows} and seen[0] <= 40 * 5


def test_near_matches_and_clean(spark):
    rng = random.Random(5)
    item = prose(rng, 12)
    loose = item[:4] + ["gap"] + item[4:]
    docs = spark.createDataFrame([(1, " ".join(prose(rng, 30) + item)), (2, " ".join(loose)), (3, " ".join(prose(rng, 40)))], "doc_id long, text string")
    bench = spark.createDataFrame([("i", " ".join(item))], "item_id string, text string")
    assert {r.doc_id for r in decontamination.clean(docs, bench).collect()} == {2, 3}
    near = {bytes(r.text_key) for r in decontamination.near_matches(docs, bench, 1).collect()}
    keys = {r.doc_id: bytes(r.k) for r in docs.select("doc_id", decontamination.text_key(docs["text"]).alias("k")).collect()}
    assert near == {keys[1], keys[2]}


# n-gram Jaccard join


def test_jaccard_components(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute.jaccard_components(ROWS)


def test_jaccard_odd_rows(spark, odd):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == len(ODD) and all((r.component_id is None) == (r.doc_id is None) for r in rows)
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) == len({r.component_id for r in rows if r.doc_id is not None})


@pytest.mark.parametrize("edges_of_a_task", [1 << 20, 7])
def test_components(spark, monkeypatch, edges_of_a_task):
    """In one task, and in star steps over the forests of many."""
    monkeypatch.setattr(components, "TASK_EDGES", edges_of_a_task)
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(20)] + [(700, x) for x in range(710, 730)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert got == {(x, root(x)) for x in parent if root(x) != x}


def test_linked_sets_share_an_address():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 6 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
        common = n - drop
        if not len(b) or not jaccard.linked(common, n, len(b)):
            continue
        hashes, text = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((hashes, text))
        address, owner = jaccard.addresses(hashes[order], text[order], np.array([len(a), len(b)]))
        assert set(address[owner == 0]) & set(address[owner == 1])


def test_marks_never_part_linked_sets():
    rng = np.random.default_rng(7)
    parted = 0
    for _ in range(600):
        n, percent = int(rng.integers(1, 300)), int(rng.choice([80, 85]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        sides = [(np.array([len(x)]), [jaccard.marks(x)]) for x in (a, b)]
        (may,) = jaccard.may_link(*sides, np.zeros(1, int), np.zeros(1, int), percent)
        links = jaccard.do_link(a, b, percent)
        assert links == jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b), percent)
        assert may or not links
        parted += not links and not may
    assert parted > 200


def test_rtree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(4)
    centre = rng.poisson(5, (20, jaccard.GROUPS))
    counts = np.maximum(np.repeat(centre, 15, axis=0) + rng.integers(-1, 2, (300, jaccard.GROUPS)), 0)
    sizes, part = counts.sum(axis=1), rng.integers(0, 200, 300)
    a, b = jaccard.rtree_pairs(counts, sizes, part)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if part[i] != part[j] and jaccard.linked(np.minimum(counts[i], counts[j]).sum(), sizes[i], sizes[j])}
    assert {tuple(sorted(map(int, p))) for p in zip(a, b)} == want


@pytest.mark.parametrize("block", [512, 16])
def test_groups_of_many_links_are_searched_twice(spark, monkeypatch, block):
    """Near copies of one base that link with it, some with each other, and groups in a chain."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(12)
    rows, base = [], prose(rng, 160)
    for i in range(70):
        words = list(base)
        for j in rng.sample(range(160), rng.randrange(1, 4)):
            words[j] = f"edit{i}x{j}"
        rows.append((i * 3, " ".join(words)))
    rows += [(500 + i, " ".join(base[i:] + prose(rng, i))) for i in range(0, 120, 4)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute.jaccard_components(rows)


def test_a_leaf_of_unlinked_sets_is_searched_in_blocks(spark, monkeypatch):
    """Short templated texts share a leaf and do not link; a task gets pairs of bounded blocks, and no link between blocks is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(i, f"this notice is always the same v{i} w{i} x{i}") for i in range(150)]
    base = prose(rng, 40)
    rows += [(1000 + i, " ".join([*base[:-1], f"end{i}"])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = []
    plain = jaccard.searched

    def seen(split, *rule, **more):
        sizes.extend(r.n for r in split.groupBy("leaf").count().select(jaccard.F.col("count").alias("n")).collect())
        return plain(split, *rule, **more)

    monkeypatch.setattr(jaccard, "searched", seen)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute.jaccard_components(rows) and max(sizes) > 16


# substring and suffix-array dedup


@pytest.mark.parametrize("chunk", [512, 4])
def test_substring_dedup(spark, odd, tables, monkeypatch, chunk):
    monkeypatch.setattr(automata, "CHUNK", chunk)
    tables(automata, documents=odd)
    assert counted(automata.op5_substring_dedup(spark, ""), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(ODD)


@pytest.mark.parametrize("chunk", [512, 4])
def test_suffix_dedup(spark, odd, tables, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    tables(suffixes, documents=odd)
    assert counted(suffixes.op10_suffix_dedup(spark, ""), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(ODD)


def test_suffix_dedup_of_many_copies(spark, tables, monkeypatch):
    """Copies are summed before a join or meet it as plain rows, which Spark splits; short ones, and long ones that also repeat within, count as ever."""
    rng, plans, keep = random.Random(3), {}, suffixes.keep
    passage = " ".join(prose(rng, 90))
    texts = [passage] * 40 + ["rep " * 300] * 3 + [" ".join(prose(rng, 30)) + passage + f" {k}" for k in range(3)] + ["short"] * 5 + ["", None, "é" * 200, "é" * 200, "x" * 399, "x" * 399, "x" * 401]
    rows = list(enumerate(texts))

    def seen(df, name):
        plans[name] = df
        return keep(df, name)

    monkeypatch.setattr(suffixes, "keep", seen)
    tables(suffixes, documents=spark.createDataFrame(full(rows), DDL).repartition(3))
    out = suffixes.op10_suffix_dedup(spark, "")
    assert counted(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_dedup(rows)
    inner, outer = (df._jdf.queryExecution().optimizedPlan().toString() for df in (plans["passage-texts"], out))
    assert "Join" in inner.partition("Aggregate")[0] and "Join" in outer and "Aggregate" not in outer


def test_automaton_matches():
    rng = random.Random(9)
    for _ in range(60):
        known = [[rng.choice("abc").encode() for _ in range(rng.randrange(1, 25))] for _ in range(3)]
        auto = automata.Automaton()
        for words in known:
            auto.add(words)
        text = [rng.choice("abcd").encode() for _ in range(40)]
        occurs = lambda part: any(words[i : i + len(part)] == part for words in known for i in range(len(words)))
        for end, got in enumerate(auto.matches(text), 1):
            assert got == max((n for n in range(1, end + 1) if occurs(text[end - n : end])), default=0)


def test_two_stage_sort():
    rng = random.Random(1)
    for trial in range(200):
        data = bytes(rng.choice(b"ab\0c\xff") for _ in range(rng.randint(1, 300)))
        data = data[:20] * 8 if trial % 3 == 0 else data
        depth = rng.choice([3, 8, 20])
        wanted = np.array([rng.random() < 0.7 for _ in data])
        wanted[max(0, len(data) - depth + 1) :] = False
        order = suffixes.two_stage(data, wanted, depth)
        order = order[wanted[order]].tolist()
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        assert [data[i : i + depth] for i in order] == sorted(data[i : i + depth] for i in order)


# pages and licences


def page(title, body, extra="", url="http://h.example/a"):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li>Home<li>About</ul></nav>"
            f"<div class=\"cookie-notice\">We use cookies</div><div class='ad'>Buy</div><article><h1>{title}</h1>{body}</article>{extra}<footer>&copy; h</footer></body></html>", url)  # fmt: skip


def test_pages(spark):
    html = [
        page("One", "<p>A &amp; B<br>c&nbsp;d\n e <b>bold</b>er</p><p>  </p><p>Second<p>Third <script>no()</script>!"),
        page("Two", "<div>Loose <i>text</div><form><input value=x><p>Send</p></form><section class='comments'><p>Nice!</p></section>", "<aside>More</aside>"),
        ("<html><body><div id=sidebar>S</div><div id='content'><p>Only</p></div></body>", "http://other.example/x"),
        ("just text <b>open", None), ("", "http://h.example/e"), (None, "http://h.example/n"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "nohost"),
    ]
    rows = spark.createDataFrame([(i, u, h, "x", 1) for i, (h, u) in enumerate(html)], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract_pages(rows).collect()}
    want = ["One\nA & B c d e bolder\nSecond\nThird !", "Two\nLoose text", "Only", "just text open", "", "", "deep"]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}


def test_template_slots_of_a_host_go(spark):
    """Text without any telling name, but the same on all pages of the host."""
    rng = random.Random(2)
    rows = [(i, f"http://t.example/{i}", f"<body><div><p>Our motto on every page</p></div><div><p>{' '.join(prose(rng, 30))}</p><p>Tail {i}</p></div><div>Call 555</div></body>") for i in range(12)]
    got = extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("motto" not in r.text and "555" not in r.text and r.text.endswith(f"Tail {r.page_id}") for r in got)


def test_copies_of_a_page_are_no_template(spark):
    """A host of copies, and one where most pages are copies: their text stays, furniture of distinct pages goes."""
    rng = random.Random(3)
    shell = "<body><div>Our motto</div><div><article><p>{}</p><p>{}</p></article></div></body>"
    text = lambda: (" ".join(prose(rng, 20)), " ".join(prose(rng, 20)))
    copy, rare = text(), [text() for _ in range(9)]
    bare = " ".join(prose(rng, 30))
    pages = [("a", shell.format(*copy), "\n".join(copy))] * 40 + [("b", shell.format(*copy), "\n".join(copy))] * 300 + [("b", shell.format(*x), "\n".join(x)) for x in rare]
    pages += [("c", f"<body><div><p>{bare}</p></div></body>", bare)] * 30
    rows = [(i, f"http://{h}.example/{i}", html) for i, (h, html, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(pages)}


def test_tree_matching_is_greatest():
    """Against the plain recursion; an optional node ahead shifts nothing."""

    def plain(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
        for i, x in enumerate(a[2]):
            for j, y in enumerate(b[2]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(x, y))
        return 1 + best[-1][-1]

    rng = random.Random(6)
    tree = lambda depth: [rng.choice("ab"), "", [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else []]
    for _ in range(300):
        a, b = (["#root", "", [tree(2) for _ in range(rng.randrange(6))]] for _ in range(2))
        assert len(dom.matched(a, b)) == plain(a, b)
    promo, menu, footer = ["div", "1", [["p", "1", []]]], ["div", "2", [["ul", "2", [["li", "2", []]]]]], ["div", "3", [["span", "3", []]]]
    pairs = dom.matched(["#root", "", [promo, menu, footer]], ["#root", "", [menu, footer]])
    assert all(x[1] == y[1] for _, x, y, _ in pairs) and len(pairs) == 6


@pytest.mark.parametrize("wrapper", ["class='layout with-sidebar'", "class='no-sidebar'", "id='page-header-fixed'", "class='sidebar layout'", "class=related"])
@pytest.mark.parametrize("holder", ["article", "main", "div class=content"])
def test_names_of_a_wrapper_hide_no_article(wrapper, holder):
    inner = f"<{holder}><p>The text</p><div class=share>Share</div></{holder.split()[0]}>"
    for html in (f"<body><div {wrapper}>{inner}<div class=sidebar>Side</div></div></body>", f"<body><article><div {wrapper}>{inner}</div></article></body>"):
        assert extraction.extract(html) == "The text"


def test_comments_and_teasers_stay_out():
    html = "<body><div class='no-sidebar'><article><p>A long enough text of the page</p></article><div id=comments><article class=comment>Nice</article></div><div class=related><div class=entry>More</div></div></div></body>"
    assert extraction.extract(html) == "A long enough text of the page"


@pytest.mark.parametrize("around", ["form id=aspnetForm", "nav", "header", "div class=comments"])
@pytest.mark.parametrize("holder", ["article", "main", "div id=content"])
def test_elements_around_the_article_hide_nothing(around, holder):
    """Closed or not; what is furniture beside the article stays out."""
    inner = f"<ul><li><a href=/>Home</a></ul><{holder}><p>The text</p><form><p>Send</p></form></{holder.split()[0]}><footer>Imprint</footer>"
    tag = around.split()[0]
    assert extraction.extract(f"<body><{around}>{inner}</{tag}></body>") == "The text"
    assert extraction.extract(f"<body><{around}>{inner}</body>") == "The text"
    assert extraction.extract(f"<body><{around}>{inner}<div class=comments><article><p>Nice</p></article></div></{tag}></body>") == "The text"


def test_a_form_around_a_plain_page():
    assert extraction.extract("<body><form><nav><a href=/>Home</a></nav><p>A text without any article element</p><label>Name</label></form></body>").startswith("A text without")
    assert extraction.extract("<body><p>A text without any article element</p><form><p>Send us a note</p></form></body>") == "A text without any article element"


@pytest.mark.parametrize("names, stays", [("post-share-story", True), ("ad-hoc-networks", True), ("search-algorithms", True), ("post-share-buttons", False), ("ad-slot", False), ("related links", False), ("notice", False), ("comments", False)])
def test_names_inside_an_article(names, stays):
    html = f"<body><article><h1>Title of the page</h1><p>First of the text</p><section class='{names}'><p>Some words here</p></section></article></body>"
    assert ("Some words here" in extraction.extract(html)) == stays


def test_most_of_an_article_is_no_notice():
    html = "<article><p>Lead</p><div class={}><p>Nearly the whole of the text of the page is here</p></div></article>"
    assert extraction.extract(html.format("notice")).endswith("is here")
    assert extraction.extract(html.format("ads")) == extraction.extract(html.format("comments")) == "Lead"


def test_a_teaser_is_not_the_page():
    text = "The text of the page stands in its main element, word after word."
    assert text in extraction.extract(f"<body><main><p>{text}</p><article class=teaser><a href=/b>Other story</a></article></main></body>")
    assert extraction.extract(f"<body><main><article><p>{text}</p></article><p>Read more</p></main></body>") == text


def test_generated_pages_against_their_text(spark):
    """240 pages of 12 hosts: precision and recall of blocks."""
    rng = random.Random(12)
    rows, want = [], {}
    furniture = ["<nav><a href=/>Home</a></nav>", "<div class=sidebar><p>Side {h}</p></div>", "<div><p>Motto of {h}</p></div>", "<div class='cookie-box'>We use cookies</div>", "<aside>Read on</aside>", "<footer>Imprint of {h}</footer>"]
    for i in range(240):
        h = i % 12
        shape = random.Random(h)
        ahead, behind = ("".join(shape.sample(furniture, 3)).format(h=h) for _ in range(2))
        holder = shape.choice(["article", "main", "div class=content", "section id=post-body"])
        text = [" ".join(prose(rng, rng.randrange(4, 40))) for _ in range(rng.randrange(1, 9))]
        inner = "".join(f"<div class='{rng.choice(['x', 'search-algorithms', 'lead'])}'><p>{p}</p></div>" for p in text) + "<div class='share-buttons'>Share this</div><div class=comments><p>Nice</p></div>"
        around = shape.choice(["div class=page", "form method=post", "div class='layout with-sidebar'"])
        rows.append((i, f"https://h{h}.example/{i}", f"<html><body><{around}>{ahead}<{holder}>{inner}</{holder.split()[0]}>{behind}</{around.split()[0]}></body></html>"))
        want[i] = text
    got = {r.page_id: r.text.split("\n") for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    same = sum((Counter(got[i]) & Counter(want[i])).total() for i in want)
    assert same / sum(map(len, got.values())) > 0.99 and same / sum(map(len, want.values())) > 0.99


@pytest.mark.parametrize("layouts", [16, 1])
def test_templates_of_all_layouts_go(spark, monkeypatch, layouts):
    """Empty pages and stubs stand for no host; two layouts; a banner that some pages lack; one page with a changed motto."""
    monkeypatch.setattr(extraction, "LAYOUTS", layouts)
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(48):
        text = " ".join(prose(rng, 25))
        banner = "" if i % 4 == 0 else "<div><p>Great offer today</p></div>"
        motto = "Changed" if i == 5 else "Our motto"
        one = f"<body>{banner}<div><span>{motto}</span></div><div><p>{text}</p></div><div>Call 555</div></body>"
        two = f"<body><table><tr><td>Second look</td></tr></table><section><p>{text}</p></section><section><b>Imprint</b></section></body>"
        rows.append((i, f"http://l.example/{i}", one if i % 3 else two))
        want[i] = ("Changed\n" if i == 5 else "") + text
    for i, html in enumerate([None, "", "<p>Error</p>", None, "", " ", None], 100):
        rows.append((i, "http://l.example/e", html))
        want[i] = "Error" if html and "Error" in html else ""
    got = {r.page_id: r.text for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_licences(spark):
    mit = licences.KNOWN[4][1]
    texts = ["Copyright (c) 2021 Someone\nAll rights reserved.\n" + mit.upper().replace('"', "''").replace("COPYRIGHT HOLDERS", "Copyright Owner"), "Some text\nreleased under the MIT licence!\nLICENSED UNDER CC BY NC 4.0", "the MIT License is mentioned here", None, "", "...", mit[:-20]]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: (r.license, r.n_license_lines, r.licenses) for r in licences.scan(rows).collect()}
    assert got == {0: ("MIT", 0, ""), 1: (None, 2, "CC-BY-NC-4.0,MIT")} | {i: (None, 0, "") for i in range(2, 7)}


def test_standard_licence_files(spark):
    """With titles and copyright lines of all kinds, wrapped anew; a notice line is no title."""
    import textwrap

    known = dict(licences.whole_texts())
    mit, isc = licences.KNOWN[4][1], licences.KNOWN[5][1]
    wrap = lambda x, n: "\n\n".join(textwrap.fill(p, n) for p in x.split("\n\n"))
    texts = [("MIT", f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{mit}"), ("MIT", f"The MIT License (MIT)\n\nCopyright The X Authors\n\n{mit}"), ("MIT", f"Copyright © Someone\nCopyright Other Person\nAll rights reserved.\n\n{wrap(mit, 40)}"),
             ("ISC", f"ISC License\n\nCopyright The Y Project\n\n{wrap(isc, 33)}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n{known['BSD-3-Clause']}"), ("BSD-2-Clause", f"Copyright Z\n\n{wrap(known['BSD-2-Clause'], 20)}"),
             ("Apache-2.0", known["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Someone")), ("Apache-2.0", known["Apache-2.0"].split("   APPENDIX")[0]), ("Unlicense", "The Unlicense\n\n" + known["Unlicense"]), ("MIT", "Released under the MIT License."), (None, "MIT License"), (None, f"Other title\n\n{mit}")]
    texts += [(x, known[x]) for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "BSL-1.0", "0BSD")]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licences.scan(rows).collect()} == {i: x for i, (x, _) in enumerate(texts)}
    many = spark.createDataFrame([(1, "copyright me\n" * 200_000)], "doc_id long, text string")
    assert licences.scan(many).collect()[0].license is None


# pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != p.STAGES[-1][0]:
            assert out.columns == spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    names = [n for n, _ in p.STAGES]
    good = kept[names[0]]
    assert sum(labels[r.doc_id] for r in good if r.doc_id in labels) >= 0.97 * sum(labels.values())
    assert {r.doc_id for r in kept[names[1]]} == {c for _, _, c in brute.jaccard_components([(r.doc_id, r.text) for r in good])}
    hit = brute.decontaminate([(r.doc_id, r.text) for r in kept[names[1]]], items)
    assert {r.doc_id for r in kept[names[2]]} == {k[0] for k in hit if not k[5]}
    assert {r.doc_id for r in kept[names[3]]} <= {r.doc_id for r in kept[names[2]]} and max(Counter(r.doc_id for r in kept[names[3]]).values()) == 2
    assert Counter(r.doc_id for r in kept[names[4]]) == Counter(r.doc_id for r in kept[names[3]])
    assert len({(r.shard, r.slot) for r in kept[names[4]]}) == len(kept[names[4]])


def test_pipeline_near_copies_at_five_words_and_80(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    rows = []
    for k in range(12):  # one replaced block of 2 to 13 of 100 words
        words = prose(rng, 100)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:40] + [f"new{k}x{j}" for j in range(k + 2)] + words[42 + k :]))]
    rows += [(100 + i, " ".join(prose(rng, n))) for i, n in enumerate([1, 4, 5, 6])] + [(110, rows[-1][1] if rows else ""), (111, None)]
    sets = {}
    for doc, text in rows:
        words = brute.SPACE.findall((text or "").translate(brute.UPPER))
        sets[doc] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    least = {doc: doc for doc in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in p.without_near_copies(spark, docs, "").collect()}
    assert kept == set(least.values())
    assert kept < {c for _, _, c in brute.jaccard_components(rows)}


def test_an_article_above_a_licence_is_no_licence(spark):
    """In any script; and head lines of any number, and long texts without spaces, take one pass."""
    mit = dict(licences.NOTICES)["MIT"]
    lead = ["Это статья о лесе\nи реке.", "這是一篇文章\n關於河流", "Αυτό είναι ένα άρθρο\nγια το δάσος", "An article about\nthe forest"]
    texts = [f"{x}\nCopyright (c) 2020 A\n\n{mit}" for x in lead]
    texts += [f"MIT License\n\nCopyright (c) 2020 A\n\n{mit}", "".join(f"Copyright 20{i % 100:02d} Holder {i}\n" for i in range(3000)) + mit, f"Авторы: Copyright 2020\n{mit}"]
    texts.append("\n".join(["河流" * 6] * 8000))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    licences.scan(docs.limit(1)).collect()
    began = time.time()
    got = {r.doc_id: r.license for r in licences.scan(docs).collect()}
    assert [got[i] for i in range(8)] == [None] * 4 + ["MIT"] * 2 + [None] * 2 and time.time() - began < 10
