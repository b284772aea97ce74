"""URL filters, mixing, token files and the pipeline: against SQL, brute force and exact round trips."""

from __future__ import annotations

import random
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.parity import TABLE_NAMES, assert_same, connect
from tidemark.llm import dedup, leaks, mixing, tokens, toxicity, urls
from tidemark.llm.common import table, written
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", ["op9_url_filters", "op10_mixing"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_parity(spark, key, sf):
    assert assert_same(QUERIES[key](spark, f"/root/testdata/{sf}"), connect(sf), ORACLES[key]) > 0


# URLs

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "http://x.example.org/es/1", "http://x.example.org/en/12#f", "http://example.com/fr/", "x://É.com/de/?q",
        "http://a.com:80/de/1", "http://notexample.org/es/", "a://b://c.com/fr/x", "http://org/", "http://h.net/a/b/c/d/e/f/g", "http://h.net//", "http://h.net/a/"]


def test_rules_and_edge_cases(spark):
    rng = random.Random(2)
    pages = [(i, u, "k") for i, u in enumerate(URLS)] + [(0, URLS[4], None), (None, URLS[4], "z")]
    pages += [(100 + i, f"http://big.net/{'good' if i % 2 else 'bad'}/{rng.randrange(10**6)}", "") for i in range(200)]
    labels = [(100 + i, i % 2 if i % 20 else 1 - i % 2, 0) for i in range(150)] + [(100, None, None), (None, 0, 0), (101, 0, 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string, host string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = urls.judge(frame, known)
    con = duckdb.connect()
    con.register("pages", frame.toPandas().astype({"page_id": "Int64"}))
    con.register("labels", known.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    assert assert_same(out, con, urls.oracle_sql()) == len(pages)
    by_id = {r.page_id: r for r in out.collect()}
    assert (by_id[5].rule, by_id[5].verdict) == ("example.org/es/", "block")
    assert (by_id[6].rule, by_id[6].path) == ("example.org/en/1", "/en/12")
    assert by_id[4].rule is None and by_id[4].host == "a.example.org" and by_id[4].path == ""
    assert by_id[10].rule == "org/" and by_id[1].host == "" and by_id[11].host == "b:"
    big = {r.template: r.verdict for r in by_id.values() if r.host == "big.net"}
    assert big == {"/good/*": "allow", "/bad/*": "block"}
    assert urls.judge(frame.limit(0), known).collect() == []
    assert {r.verdict for r in urls.judge(frame, known.limit(0)).collect() if r.rule is None} == {"allow"}


@pytest.mark.parametrize("sections", [2, 12, 13, 40])
def test_more_sections_turn_no_verdict(spark, sections):
    """A bad, well-labelled section is told apart however many others its host has."""
    pages = [(i, f"http://h.net/s{i % sections}/{i}") for i in range(100 * sections)] + [(10**6, "http://h.net/rare/1")]
    labels = [(i, int(i % sections != 1), 0) for i in range(100 * sections)]
    frame, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = urls.judge(frame, known)
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    con.register("labels", known.toPandas())
    assert assert_same(out, con, urls.oracle_sql()) == len(pages)
    assert {r.verdict for r in out.collect() if r.path.startswith("/s1/")} == {"block"}
    assert {r.verdict for r in out.collect() if not r.path.startswith("/s1/")} == {"allow"}


def test_branches_are_compared_at_any_size(spark):
    rng = random.Random(8)
    rows = [(60_000, 125_000, 100_000, 10**6), (0, 10**9, 10**9, 3 * 10**9), (5 * 10**9, 10**10, 5 * 10**10, 10**11)]
    for size in (10, 10**3, 10**5, 10**7, 10**9):
        for _ in range(30):
            labelled, more = rng.randrange(1, size), rng.randrange(size)
            bad = rng.randrange(labelled + 1)
            rows.append((bad, labelled, bad + round(more * min(1, bad / labelled + rng.choice([0, size**-0.5]))), labelled + more))
    frame = spark.createDataFrame(rows, "b long, l long, all_b long, all_l long")
    found = frame.selectExpr("*", f"{urls.similar_at_any_size('b', 'l', 'all_b', 'all_l')} as s").collect()
    for r in found:
        assert r.s == ((r.b * r.all_l - r.l * r.all_b) ** 2 <= 4 * r.l * r.all_b * (r.all_l - r.all_b)), r


# Mixing


def water(sizes: dict) -> dict:
    """Targets by filling up round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", "z", None, "empty"][: 4 + seed]
    rows = [(i, rng.choice(names[: max(1, len(names) - 1)]), "w\t" * rng.choice([0, 1, 5, 40])) for i in range(300)]
    rows += [(900, "empty", ""), (901, "empty", None), (902, "a", "x " * 2000), (3, "a", "dup dup"), (3, "a", "dup dup"), (None, "a", "n")]
    docs = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id long, source string, text string, size int")
    out = mixing.mix(docs).collect()
    sizes: dict = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    assert len(out) == len(rows)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position_1 is None) == (r.taken == 0)
        assert all(p is None or 0 <= p <= 1 for p in (r.position_1, r.position_2))
        taken[r.source] += r.taken
    assert taken == {s: int(np.floor(want[s] + 1e-9)) for s in sizes}
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    places = [r.position_1 for r in out if r.position_1 is not None]
    assert places == sorted(places)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixing.mixed(docs.limit(0)).collect() == [] == mixing.mix(docs.limit(0)).collect()
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in out:
        if r.doc_id not in (3, None) and r.size:
            assert abs(copies.get(r.doc_id, 0) - r.taken / r.size) <= 1


def test_the_curriculum_follows_its_schedule(spark):
    """Positions of a rising source lie late, of a falling one early, and of a level one evenly."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "'one two three' as text")
    means = {r.source: r.m for r in mixing.mix(docs).groupBy("source").agg(F.avg("position_1").alias("m"), F.max("taken")).collect()}
    share = {r.source: r.target / r.source_size for r in mixing.mix(docs).select("source", "target", "source_size").distinct().collect()}
    # the first reading covers the first source_size / target of the target
    for name, slope in zip(("s0", "s1", "s2"), mixing.SLOPES, strict=True):
        y = (np.arange(2000) + 0.5) / 2000 / max(share[name], 1)
        t = y if slope == 0 else (-(1 - slope) + np.sqrt((1 - slope) ** 2 + 4 * slope * y)) / (2 * slope)
        assert means[name] == pytest.approx(t.mean(), abs=0.02)


def test_mixing_is_native(spark):
    plan = mixing.mix(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


# Tokens

PARTS = st.sampled_from(["a", " ", "  ", "\n", "\t", "\r\n", "word", "Word's", "'ll", "12", "½", "é", "漢字", "😀", "\u00a0", "\u2003", "\u200b", "\x1c", "!", "...", "<|endoftext|>", "_", "\u0301", "٣"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=4))
def test_remembered_units_give_the_library_s_ids(texts):
    coder = tokens.encoder(tokens.TOKENIZER)
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    for text, found in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_words_and_their_last_marks_give_the_library_s_ids():
    words = ["a", "été", "it's", "o'", "x2", "½", "ª", "ˁ", "˄", "e\u0301", "漢", "a\n", "\n", "\u00a0", "3", "", "-a", "a_b", "日.本"]
    marks = ["", ".", ",\"", "'", "''", "'s", "!'", "_", "$$$", "~`", "\u2026", "...\n", "\u00b7."]
    units = [word + mark for word in words for mark in marks]
    rng = random.Random(3)
    texts = [unit for unit in units] + [f" {unit}" for unit in units] + [" ".join(rng.choices([x for x in units if x], k=40)) for _ in range(100)]
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    coder = tokens.Encoder(tokens.TOKENIZER)
    for _ in range(2):  # the second time all units are known
        for text, found in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_an_encoder_at_rest_keeps_no_units():
    coder = tokens.Encoder(tokens.TOKENIZER)
    coder.encode(["some words, and 12 others."])
    coder.rest()
    assert not any(isinstance(x, dict) and x for x in vars(coder).values())


class Counted:
    """The library's tokenizer, with the lines it was given."""

    def __init__(self, lines):
        self.whole, self.given = lines, []

    def encode_batch_fast(self, texts, **how):
        self.given += [line for text in texts for line in text.split("\n")]
        return self.whole.encode_batch_fast(texts, **how)


def test_ids_are_copied_a_few_runs_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 4, 50)
    ids = np.arange(sizes.sum(), dtype="<u4")
    runs = np.split(ids, np.cumsum(sizes)[:-1])
    for count in (0, 1, 7, 8, 1000):
        monkeypatch.setattr(tokens, "RUNS", 7, raising=False)
        which = rng.integers(0, 50, count).astype(np.int32)
        assert tokens._runs_of(ids, sizes, which).tolist() == [x for i in which for x in runs[i].tolist()]
    monkeypatch.undo()
    which = rng.integers(0, 50, 1_000_000).astype(np.int32)
    tracemalloc.start()
    found = tokens._runs_of(ids, sizes, which)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 2.5 * found.nbytes + 4e6, (most, found.nbytes)


HELD = """
import numpy as np, pyarrow as pa
from tidemark.llm.common import frugal

def held():
    with open("/proc/self/status") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) // 1024

def run(batches):
    for _ in batches:
        np.ones(30 << 20, np.uint8)  # freed: glibc takes this for the size from which memory is mapped alone
        before = held()
        some = [np.ones(10 << 20, np.uint8) for _ in range(4)]
        used = held() - before
        del some
        yield used, held() - before, pa.default_memory_pool().backend_name

print(*next(frugal(run)(iter([None]))))
"""


def test_a_task_gives_large_arrays_back_at_once():
    said = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    used, kept, pool = said.stdout.split()
    assert int(used) > 35 and int(kept) < 5 and pool == "system", said.stdout


def test_plain_words_are_asked_once_and_never_handled_one_by_one(monkeypatch):
    coder, handled = tokens.Encoder(tokens.TOKENIZER), []
    of_units = coder._of_units
    monkeypatch.setattr(coder, "_of_units", lambda units: handled.extend(units) or of_units(units))
    coder.lines = Counted(coder.lines)
    texts = ["Plain words, été 12 words.\nWords été! it's", "Plain words.\nMore plain words"]
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    for _ in range(2):
        for text, found in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert {x for x in handled if any(map(str.isalnum, x))} == {" it's"}
    words = [x for x in coder.lines.given if x.isalpha()]
    assert len(words) == len(set(words)) and {"Plain", "Words", "More", "Ġwords", "Ġplain"} <= set(words)


@pytest.mark.parametrize("kept", [0, 1 << 30])
@pytest.mark.parametrize("lacking", [False, True])
def test_lines_and_plain_words_give_the_library_s_ids(monkeypatch, kept, lacking):
    monkeypatch.setattr(tokens, "WORD_BYTES", kept)
    monkeypatch.setattr(tokens, "LINES", 3)
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    coder, rng = tokens.Encoder(tokens.TOKENIZER), random.Random(7)
    if lacking:  # the sizes of ids do not tell where words end
        coder.sizes = np.zeros_like(coder.sizes)
    parts = ["a", "word", "été", "ñ", "ʰ", "˿", "\u0300", "漢", "7", "12", "٣", "'s", "'", ".", ",", "\n", "\n", "\n\n", "\r\n", "\t", "\x85", " ", " ", " "]
    for _ in range(60):
        texts = [" ".join("".join(rng.choices(parts, k=30)).split(" ")) for _ in range(10)]
        texts += ["", "\n", "word", " word", "word.\nword", "word\n", "\nword", " word.\n\nword"]
        for text, found in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("size", [0, 1, 7, tokens.BLOCK_IDS, tokens.BLOCK_IDS + 3])
def test_planes_round_trip(bits, size):
    ids = np.random.default_rng(size).integers(0, 50257, size).astype("<u4")
    sizes, frames = tokens.pack(ids.tobytes(), bits)
    assert np.array_equal(tokens.unpack(size, sizes, frames), ids)
    assert len(sizes) == -(-size // tokens.BLOCK_IDS) * (32 if bits else 4)


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(tokens, "CHUNK_IDS", 64)
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), " ".join(rng.choice(["the", "cat", "xyzzy", "12"]) for _ in range(rng.randrange(60)))) for _ in range(200)]
    rows += [(5, None), (5, ""), (5, "tie b"), (5, "tie a"), (5, "tie a"), (None, "none"), (7, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    tokens.write_tokens(docs, f"{tmp_path}/t", bits=bits)
    out = tokens.read_tokens(spark, f"{tmp_path}/t", with_ids=True).orderBy("start").collect()
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    assert len(out) == len(rows)
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start, want = 0, sorted(((i is not None, i or 0), plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in out) == want
    for r in out:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert tokens.token_output(docs.limit(0)).collect() == []


# Pipeline


def test_stages_do_what_their_operators_say(spark):
    sf = "/root/testdata/sf0.001"
    before = docs = table(spark, sf, "documents")
    labels, bench = table(spark, sf, "labels"), table(spark, sf, "benchmark")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "decontamination", "mixing", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, before, sf), "stage")
        if name != "tokens":
            assert docs.columns == before.columns
            assert docs.select(*before.columns).exceptAll(before.union(before)).isEmpty()  # whole rows, twice at most
        if name == "toxicity":
            scored = toxicity.score_documents(before, toxicity.train(before, labels))
            assert ids(docs) == ids(scored.filter("predicted = 0"))
        elif name == "near-duplicates":
            assert ids(docs) == sorted({r.class_id for r in dedup.near_duplicates(before).collect()})
        elif name == "decontamination":
            gone = {r.doc_id for r in leaks.leaks(before, bench).collect()}
            assert ids(docs) == [i for i in ids(before) if i not in gone]
        elif name == "mixing":
            taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(before).collect()}
            copies = ids(docs)
            assert all(abs(copies.count(i) - (t / s if s else 1)) <= 0.5 for i, (t, s) in taken.items())
        else:
            assert ids(docs) == ids(before)
        before = docs
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.drop("shard", "chunk").collect())) == sorted(map(str, docs.drop("shard", "chunk").collect()))


def test_any_column_names(spark):
    """Columns beside those that are used keep their names and values, whatever they are."""
    rows = [(i, f"words of text number {i} and some more of them", "en", f"s{i % 2}", 40, i, i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `c``d` int")
    items = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    for out in (mixing.mixed(docs), dedup.distinct_documents(docs), leaks.unleaked(docs, items)):
        assert out.columns == docs.columns and all(r["a.b"] == r.doc_id for r in out.collect())


def test_registered_queries():
    assert [k for k in QUERIES if k.startswith("op")] == sorted((k for k in QUERIES), key=lambda k: int(k[2:].split("_")[0]))
    assert len(QUERIES) == 13 and set(ORACLES) < set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert set(TABLE_NAMES) >= {"documents", "embeddings", "pages", "benchmark", "labels"}
