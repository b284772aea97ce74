"""Near-duplicates, benchmark leaks and top-k search against brute force."""

from __future__ import annotations

import itertools
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.parity import assert_same, connect
from tidemark.llm import dedup, leaks, topk, words
from tidemark.llm.common import table
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def word_lists(texts: list[str | None]) -> list[list[int]]:
    hashes, bounds = words.word_hashes(pa.array(texts, pa.string()))
    return [hashes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def shingles(tokens: list[int]) -> Counter:
    return Counter(tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))) if tokens else Counter()


def brute_classes(texts: list[str | None]) -> list[int]:
    """For each text, the first text of its connected component."""
    tokens = word_lists(texts)
    bags, parent = [shingles(t) for t in tokens], list(range(len(texts)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    near = defaultdict(set)
    for i, bag in enumerate(bags):
        for s in bag:
            near[s].add(i)
    for i, bag in enumerate(bags):
        for j in {j for s in bag for j in near[s] if j < i}:
            common = sum((bag & bags[j]).values())
            if common >= 0.8 * (bag.total() + bags[j].total() - common):
                parent[max(top(i), top(j))] = min(top(i), top(j))
        if not bag:
            same = [j for j in range(i) if not bags[j] and (texts[j] or "") == (texts[i] or "")]
            if same:
                parent[i] = top(same[0])
    return [top(i) for i in range(len(texts))]


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def planted(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts: list[str | None] = [None, "", "", "!!", "!!", "one two", "One, two!", "two one", "a b c d", fresh(3000)]
    shared = fresh(60)
    for _ in range(25):
        texts.append(f"{fresh(rng.randrange(20, 80))} {shared} {fresh(rng.randrange(20, 80))}")
    for size in (6, 20, 150, 800):
        base = fresh(size)
        texts += [base, base.upper(), *(edited(rng, base, rng.choice([0.005, 0.01, 0.03, 0.2])) for _ in range(20))]
    texts.append("again " * 500)
    texts.append("again " * 520)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = planted(seed)
    rows = list(enumerate(texts))
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = {r.doc_id: r for r in dedup.near_duplicates(docs).collect()}
    want = brute_classes(texts)
    assert [found[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(found[i].class_size == sizes[want[i]] and found[i].kept == (want[i] == i) for i in range(len(texts)))
    kept = dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_repeated_rows_and_missing_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, long), (None, "only"), (None, "only"), (2, long.upper()), (2, long), (3, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup.near_duplicates(docs)
    assert found.count() == 8 and {(r.class_id, r.class_size) for r in found.collect()} == {(1, 5), (None, 2), (3, 1)}
    kept = [tuple(r) for r in dedup.distinct_documents(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, long), (None, "only"), (3, "else")], key=str)
    for operator in (dedup.near_duplicates, dedup.distinct_documents):
        assert operator(docs.limit(0)).collect() == []


def test_whole_table_equals_brute_force(spark):
    found = QUERIES["op6_near_duplicates"](spark, SF).toPandas().sort_values("doc_id")
    docs = table(spark, SF, "documents").orderBy("doc_id").collect()
    want = brute_classes([d.text for d in docs])
    assert found.class_id.tolist() == [docs[i].doc_id for i in want]


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    other = [w if rng.random() > 0.02 else "x" for w in base]
    texts = pa.array([" ".join(base), " ".join(other), " ".join(base * 2), "q " * 40])
    found, bounds, _, _ = dedup.elements(texts)
    drawn = dedup.signatures(dedup.cells(found, bounds), bounds)
    bags = [shingles(t) for t in word_lists(texts.to_pylist())]
    for a, b in ((0, 1), (0, 2), (1, 2), (0, 3)):
        common = sum((bags[a] & bags[b]).values())
        exact = common / (bags[a].total() + bags[b].total() - common)
        assert abs((drawn[a] == drawn[b]).mean() - exact) < 0.16
    assert all(len(set(d.tolist())) > 100 for d in drawn)


def test_hot_group_is_not_expanded_into_pairs(spark, monkeypatch):
    """600 near copies: what is compared grows with the group, not with its square."""
    rng = random.Random(9)
    base = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, edited(rng, base, 0.004)) for i in range(600)], "doc_id long, text string")
    counts, plain = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: (lambda out: counts.append((name, out.count())) or out)(plain(df, name)))
    classes = Counter(r.class_id for r in dedup.near_duplicates(docs).collect())
    assert classes.most_common(1)[0][1] > 550
    assert sum(n for name, n in counts if name == "pairs") < 600 * 100


def test_a_round_has_no_more_pairs_than_members(spark, monkeypatch):
    """A family under the threshold: its buckets stay open, and each text meets many heads in every round."""
    rng = random.Random(12)
    base = " ".join(f"w{i}" for i in range(120))
    texts = [edited(rng, base, rng.choice([0.004, 0.02])) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, plain = [], dedup.compared
    monkeypatch.setattr(dedup, "compared", lambda pairs, *rest: (counts.append(pairs.count()), plain(pairs, *rest))[1])
    assert dedup.near_duplicates(docs).count() == 500
    assert len(counts) == 2 * len(dedup.PARTS) and 0 < max(counts) <= len(set(texts))


@pytest.mark.parametrize("seed", range(6))
def test_linked_joins_up_what_all_pairs_would(seed):
    rng = random.Random(seed)
    base = [rng.randrange(2**32) for _ in range(rng.choice([1, 4, 60]))]
    fresh = lambda: [x if rng.random() > 0.08 else rng.randrange(2**32) for x in base] + rng.sample(range(2**32), rng.randrange(len(base) // 4 + 1))
    raw = lambda units: np.sort(np.array(units, np.uint32)).tobytes()
    texts = [(f"{rng.randrange(40):02}".encode(), raw(fresh())) for _ in range(60)] + [(b"90", b""), (b"91", b""), (b"92", raw(base)), (b"93", raw(base))]
    probes = [t for t in texts if t[0] > b"10"] + [(b"94", raw(rng.sample(range(2**32), 30)))]
    want = {(max(a, b), min(a, b)) for (a, x), (b, y) in itertools.product(probes, texts) if a != b and dedup.similar(x, y)}
    found = dedup.linked(probes, texts)

    def classes(links: set) -> dict:
        top = {c: c for pair in want for c in pair}
        for a, z in links:
            x, y = top[a], top[z]
            top = {c: min(x, y) if t in (x, y) else t for c, t in top.items()}
        return top

    assert found <= want and classes(found) == classes(want)
    assert len(found) == len(classes(want)) - len(set(classes(want).values()))  # a tree of links for each class, not all pairs
    assert dedup.linked([], texts) == dedup.linked(probes, []) == set()


@pytest.mark.parametrize("block", [dedup.BLOCK_BYTES, 20_000])
def test_links_of_a_family_under_the_threshold_are_all_found(spark, monkeypatch, block):
    """Texts of one template just under the threshold, with a few links, whatever heads the buckets draw."""
    monkeypatch.setattr(dedup, "HEADS", 1)
    monkeypatch.setattr(dedup, "PARTS", ((0,), (0,)))
    monkeypatch.setattr(dedup, "BLOCK_BYTES", block, raising=False)
    rng = random.Random(3)
    base = " ".join(f"w{i}" for i in range(120))
    texts = [edited(rng, base, 0.025) for _ in range(250)]
    texts += [edited(rng, t, 0.015) for t in texts[:60]]
    want = brute_classes(texts)
    assert 20 < len(set(want)) < len(texts) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_hot_group_equals_brute_force(spark):
    rng = random.Random(9)
    base = " ".join(f"w{i}" for i in range(120))
    texts = [edited(rng, base, rng.choice([0.004, 0.02])) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(60)]
    star = [(b"900", f"{i}".encode()) for i in range(901, 960)]
    links = spark.createDataFrame(chain + star, "a binary, z binary")
    found = {bytes(r.node): bytes(r.comp) for r in dedup.components(links).collect()}
    assert set(found.values()) == {b"000", b"900"} and len(found) == 60 + 59


# Leaks


def brute_leaks(docs: list[tuple], items: list[tuple]) -> dict:
    found = {}
    tokens, others = word_lists([t for _, t in docs]), word_lists([t for _, t in items])
    for (doc, _), d in zip(docs, tokens, strict=True):
        for (item, _), q in zip(items, others, strict=True):
            if len(q) < leaks.SHORT:
                continue
            best = 0
            for shift in range(-len(q) + 1, len(d)):
                low, high = max(0, -shift), min(len(q), len(d) - shift)
                equal = np.array([d[i + shift] == q[i] for i in range(low, high)])
                for first in range(len(equal)):
                    for past in range(len(equal), first + best, -1):
                        if equal[first] and equal[past - 1] and equal[first:past].mean() >= leaks.IDENTITY:
                            best = past - first
                            break
            if best >= min(leaks.LEAST_WORDS, len(q)):
                found[doc, item] = best
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(fresh(n))) for i, n in enumerate((40, 25, 15, 14, 13, 9, 5, 4))] + [(90, None), (91, ""), (None, " ".join(fresh(20)))]
    docs = [(0, None), (1, ""), (2, " ".join(fresh(200)))]
    for k, (item, text) in enumerate(items):
        for share in (0, 0.08, 0.5):
            body = edited(rng, text or "", share)
            docs.append((1000 + 100 * k + int(share * 100), " ".join(fresh(15)) + f" {body}. " + " ".join(fresh(15))))
    docs.append((700, " ".join((items[0][1] or "").split()[5:25])))
    docs.append((None, items[1][1]))
    rows = [(i, t, 1) for i, t in docs] + [(700, docs[-2][1], 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = leaks.leaks(frame, bench).collect()
    found = {(r.doc_id, r.item_id): r.n_words for r in out}
    want = brute_leaks(docs, items)
    assert len(found) == len(out)
    exact = {k for k in want if k[0] is None or k[0] % 100 == 0}
    assert exact <= set(found) <= set(want) and len(found) >= 0.9 * len(want)
    assert all(found[k] <= want[k] for k in found)
    kept = leaks.unleaked(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _ in rows if i not in {d for d, _ in found})
    assert leaks.leaks(frame.limit(0), bench).collect() == [] == leaks.leaks(frame, bench.limit(0)).collect()
    assert leaks.unleaked(frame, bench.limit(0)).count() == len(rows)


def test_edited_copies_are_found_at_every_length(spark):
    """As many words replaced as IDENTITY lets, but for the ends; no exact copy but of items under five words."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items, docs, want = [], [], set()
    for size in (*range(1, 27), 31, 40):
        words = fresh(size)
        items.append((size, " ".join(words)))
        for k in range(12):
            body = list(words)
            for i in rng.sample(range(1, size - 1), size // 5):
                body[i] = f"x{rng.randrange(10**6)}"
            docs.append((100 * size + k, " ".join(fresh(20) + body + fresh(20))))
            want.add((100 * size + k, size))
        if 1 < size < 13:  # one word more than that
            for i in rng.sample(range(size), size // 5 + 1):
                words[i] = "y"
            docs.append((100 * size + 99, " ".join(words)))
    docs.append((5000, " ".join([items[0][1]] * 3)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = leaks.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(5000, 1)} and len(found) == len(want) + 1
    assert [(r.doc_start, r.doc_end) for r in found if r.doc_id == 5000] == [(0, 1)]


@pytest.mark.parametrize("size", range(13, 24))
def test_a_mask_fits_every_placement_of_differing_words(size):
    masks = [(sum(1 << i for i in leaks.offsets(m)), len(m)) for m in leaks.MASKS]
    for places in itertools.combinations(range(size), size // 5):
        gone = sum(1 << i for i in places)
        assert any(not (mask << shift) & gone for mask, span in masks for shift in range(size - span + 1))


def test_longest_run():
    run = lambda bits: leaks.longest_run(np.array([c == "1" for c in bits]))
    assert run("0000") == (0, 0) and run("1111") == (0, 4) and run("0111101111") == (1, 10)
    assert run("100001111") == (5, 9) and run("") == (0, 0)


def test_whole_benchmark_is_found(spark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    docs = table(spark, "/root/testdata/sf0.01", "documents").collect()
    bench = table(spark, "/root/testdata/sf0.01", "benchmark").collect()
    exact = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    assert exact and exact <= found


# Top-k


def brute_top(rows: list[tuple], modulus: int, k: int) -> dict:
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in whole:
        if i % modulus == 0:
            out[i] = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in whole if j != i)[:k]
    return out


@pytest.mark.parametrize("blocks", [(8192, 512, 2048, 4096, 8), (16, 4, 8, 8, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "QUERY_ROWS", "SEED_ROWS", "STRIPE", "DIMENSIONS"), blocks, strict=True):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(6)
    draw = lambda n=6: [rng.choice([rng.gauss(0, 0.3), 0.5, 0.0]) for _ in range(n)]
    rows = [(i, draw()) for i in range(150)] + [(i, [0.5] * 6) for i in range(150, 190)]
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, draw()), (204, []), (205, draw(3)), (7, draw()), (7, draw())]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    want = brute_top(rows, 5, 5)
    out = topk.top_k(vectors, 5, 5).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((-r.score, r.vec_id))
    assert dict(found) == want
    assert topk.top_k(vectors.limit(0)).collect() == []


def test_very_large_components_are_exact():
    ids = np.arange(3)
    values = np.array([[2.0**60, 3.0, 1.0], [1.0, 2.0, -(2.0**55)]])
    places, found, scores = topk.search(ids, values, np.full(3, -np.inf), ids, values, 2)
    assert scores[places == 1].tolist() == [3 * 2**60 + 2, 3 - 2**56] and found[places == 1].tolist() == [0, 2]


def test_top_k_equals_sql(spark):
    con = connect("sf0.01")
    assert assert_same(QUERIES["op5_exact_top_k"](spark, "/root/testdata/sf0.01"), con, ORACLES["op5_exact_top_k"]) == 50


def test_a_repeated_query_row_is_one_query_in_both_texts(spark):
    rng = random.Random(3)
    rows = [(i * 10, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    rows += [rows[0], rows[0], (50, [0.5, 0.25, 0.125, 1.0]), rows[7]]
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert assert_same(out, con, topk.oracle_sql()) == 5 * len({(i, tuple(v)) for i, v in rows if i % 50 == 0})


def test_vectors_that_end_in_zeros_are_queries_of_their_own(spark):
    rows = [(0, [1.0]), (0, [1.0, 0.0]), *((i, [i / 16, 0.5]) for i in range(1, 10))]
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert assert_same(out, con, topk.oracle_sql()) == 10


@pytest.mark.parametrize("scale", [0.2, 90.0, 1e5])  # 24 bits, 53 bits, components beyond 16 bits
def test_top_k_of_many_cells_equals_brute_force(spark, monkeypatch, scale):
    for name, value in {"BLOCK_ROWS": 64, "QUERY_ROWS": 16, "SEED_ROWS": 8, "STRIPE": 32, "TILE": 4, "ANSWER_ROWS": 7, "IDLE": 1, "AGAIN": 3}.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    values = rng.standard_normal((600, 24)) * scale * np.exp(-np.arange(24) / 2)[rng.permutation(24)]
    rows = [(i % 550, v.tolist()) for i, v in enumerate(values)] + [(1000 + i, values[0].tolist()) for i in range(60)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 3)
    found = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.score, r.vec_id))
    ids, whole = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows]))
    for q in (q for q in range(len(rows)) if ids[q] % 5 == 0 and (ids == ids[q]).sum() == 1):
        scores = whole @ whole[q]
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], -scores[others]))[:3]]
        assert found[ids[q]] == [(int(scores[c]), int(ids[c])) for c in best]


def test_bounds_leave_candidates_out(monkeypatch):
    monkeypatch.setattr(topk, "TILE", 8)
    rng = np.random.default_rng(4)
    values = np.rint(rng.standard_normal((64, 5000)) * 100 * np.exp(-np.arange(64) / 6)[:, None])
    ids, made = np.arange(5000), []
    best = topk.Best(ids[:16], values[:, :16], np.full(16, -np.inf), 5)
    summed = best._sums
    monkeypatch.setattr(best, "_sums", lambda *a: made.append(summed(*a)) or made[-1])
    best.add(ids, values)
    scores = values[:, :16].T @ values
    np.fill_diagonal(scores, -np.inf)
    assert [x.tolist() for x in np.split(best.answer()[2], 16)] == np.sort(scores)[:, :-6:-1].tolist()
    assert min(len(at) for at, _ in made) < 500


def test_cells_of_a_grid():
    for total, asked, wide in ((0, 0, 0), (1, 1, 128), (10**6, 1, 128), (15 * 10**6, 3 * 10**5, 128), (10**6, 10**6, 128), (7 * 10**5, 14_000, 8192)):
        lanes, rows = topk.grid(total, asked, wide)
        assert asked <= rows * topk.QUERY_ROWS and asked * wide <= rows * topk.QUERY_BYTES
        assert 1 <= lanes <= max(topk.LANES, total // topk.LANE_ROWS)
        assert lanes <= topk.LANES or asked * lanes <= total * rows


LOW_MEMORY = """
from pyspark.sql import SparkSession
from tidemark.llm import topk

topk.BLOCK_ROWS = 16
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "4").getOrCreate()
rows = spark.range(0, 40_000, 1, 4).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> (xxhash64(id, i) % 1000) / 4000d) as embedding")
rows.write.parquet("{0}/vectors")
out = topk.top_k(spark.read.parquet("{0}/vectors"))
out.write.parquet("{0}/found")
print("ROWS", spark.read.parquet("{0}/found").count())
"""


def test_queries_that_meet_many_candidates_fit_a_small_heap(tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 500m pyspark-shell", "PYTHONPATH": str(Path(topk.__file__).parents[2]), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", LOW_MEMORY.format(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 4000" in done.stdout, done.stderr[-2000:]


def test_a_part_of_a_bucket_has_one_head_of_a_component(spark):
    rows = [(band, f"{band}-{i}".encode(), comp.encode()) for band in range(20) for i, comp in enumerate("aaaaaaaabbbbc" if band else "aaaa")]
    parts = spark.createDataFrame(rows, "band long, rid binary, comp binary").selectExpr("*", "named_struct('mask', 0L, 'rest', 0L) as part")
    for round_ in (0, 1):
        found = [(r.band, bytes(r.head), bytes(r.head_comp)) for r in dedup.heads_of(parts, round_).collect()]
        assert {band for band, *_ in found} == set(range(1, 20)) and set(found) <= set(rows)
        assert len({(band, comp) for band, _, comp in found}) == len(found)
    assert len(found) > 19
