"""The Merkle manifest, against SQL and a plain recursive tree."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.parity import assert_same, connect
from tidemark.llm import manifest
from tidemark.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, more: int = 0) -> str:
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and each node's steps (side, sibling)."""
    steps: list[list[tuple[str, str]]] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            sibling = place ^ 1
            if sibling < len(nodes):
                steps[i].append(("left" if sibling < place else "right", nodes[sibling]))
            else:
                steps[i].append(("alone", ""))
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], steps


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    for side, sibling in steps:
        node = digest(sibling, node) if side == "left" else digest(node, sibling)
    return node


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict[bytes, list[tuple]] = {}
    for row in rows:
        groups.setdefault(b"" if row[2] is None else b"=" + row[2].encode(), []).append(row)
    ordered = [sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in sorted(groups)]
    subtrees = [tree([leaf(r) for r in rows]) for rows in ordered]
    root, upper = tree([subroot for subroot, _ in subtrees])
    out = []
    for rows, (subroot, lower), above in zip(ordered, subtrees, upper, strict=True):
        for row, steps in zip(rows, lower, strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            back = fold(leaf(row, int(tampered)), steps + above)
            proof = digest(*(sibling for _, sibling in steps + above))
            out.append((row[0], leaf(row), subroot, root, proof, back, back == root))
    return out


def found(frame) -> list[tuple]:
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in manifest.manifest_digest(frame).select(*columns).collect()), key=str)


def sample(counts: dict) -> list[tuple]:
    rows = []
    for lang, count in counts.items():
        rows += [(len(rows) + i * 3, f"text {i} é " * (i % 3), lang, None if i % 5 == 0 else f"s{i % 4}", None if i % 6 == 0 else i) for i in range(count)]
    return rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_parity(spark, sf):
    assert assert_same(QUERIES["op11_manifest"](spark, f"/root/testdata/{sf}"), connect(sf), ORACLES["op11_manifest"]) > 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equals_a_plain_tree_whatever_is_stored(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = sample({"de": 37, None: 1, "en": 64, "": 5, "é": 2, "zz": 3})
    rows += [(None, "no id", "de", None, 3), (None, "no id", "de", None, 3), (7, "", "en", "", 0), (7, None, "en", "", 0), rows[3]]
    rows.append((14, "word " * 200_000, "en", "src", 10**18))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    extra = frame.withColumn("a.b", F.lit(1)).withColumn("node", F.lit(2)).withColumn("tree", F.lit("x"))
    expected = sorted(brute(rows), key=str)
    assert {r[-1] for r in expected} == {True, False}
    assert found(extra) == expected


def test_equal_rows_and_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 3)
    rows = [(5, "same", "en", "s", 4)] * 300 + sample({"en": 200, "fr": 1})
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame) == sorted(brute(rows), key=str)


def test_equal_rows_are_spread(spark):
    rows = spark.range(4000).selectExpr("'=en' as tree", "5L as id", "unhex('00') as node", "cast(null as binary) as claimed")
    placed = manifest.placed(rows.repartition(8), ("id", "node"))
    assert sorted(r.pos for r in placed.select("pos").collect()) == list(range(4000))
    assert {r.n for r in placed.select("n").distinct().collect()} == {4000}


def test_sizes_around_the_stored_levels(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 65]
    rows = sample({f"g{size:02}": size for size in sizes})
    assert found(spark.createDataFrame(rows, SCHEMA)) == sorted(brute(rows), key=str)


def test_empty_table_and_single_row(spark):
    empty = manifest.manifest_digest(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[:2] == ["doc_id", "leaf"]
    row = (9, None, None, None, None)
    assert found(spark.createDataFrame([row], SCHEMA)) == brute([row])
    one = brute([row])[0]
    assert one[1] == one[2] == one[3] and one[4] == digest()


def test_proofs_are_given_in_full(spark):
    rows = sample({"en": 11, "fr": 3})
    out = manifest.proofs(spark.createDataFrame(rows, SCHEMA), "lang", "doc_id", [F.col(c) for c in manifest.FIELDS])
    opened = out.select("id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("root")).alias("root"), manifest.steps(F.col("path")).alias("steps"))
    assert {r.id: fold(r.leaf, [tuple(s) for s in r.steps]) for r in opened.collect()} == {row[0]: opened.first().root for row in rows}


def test_sql_on_nulls_and_repeats(spark):
    rows = sample({"de": 9, None: 3, "é": 2}) + [(None, "x", None, None, None), (1, "y", "de", "s", 2), (1, "y", "de", "s", 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", frame.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    assert assert_same(manifest.manifest_digest(frame), con, ORACLES["op11_manifest"]) == len(rows)
