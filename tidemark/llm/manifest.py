"""Merkle manifest of a table: one hash tree a group, one tree over the groups' roots, and proofs for every row.

A node is the SHA-256 of its children's digests written as hexadecimal text, two children a node; a last child
without a neighbour is hashed alone. Leaves are ordered by (group, id, digest).

Checkpoint and recompute: the tree is stored only at every LEVELS-th level, as blocks of 2**LEVELS neighbouring
nodes, whose subtree is aligned. A block's subtree is rebuilt from its stored nodes in one task, first to get
the next stored level, later to read the siblings of each of its nodes off it; the nodes between are never
stored. Proofs are put together from the top: a block's nodes append the path of the block's own top.

Positions come from a sort over ranges of (group, id, digest, arrival), so a group with a third of all rows, or equal
rows, is spread over many tasks; only counts per (group, range) are summed up. No task holds more than one
block, and the driver only learns how high the highest tree is.

Edge cases: a null group is a group of its own and the first; a null id comes first in its group; rows that are
equal in id and digest are leaves each, in any order, since exchanging them changes nothing; null fields are written `-`, an empty text `0:`;
a very long text is hashed whole where it is read and goes no further; an empty table has no root and gives no rows; columns
that are not hashed are not read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

LEVELS = 8
STEP = 33  # bytes of a step of a path: the sibling's side, then its digest
ALONE, LEFT, RIGHT = 0, 1, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_MEMBERS = "array<struct<pos:bigint,node:binary,id:bigint,claimed:binary>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: of each field `-` if null, else its length in UTF-8 bytes, `:` and its text."""
    texts = [field.cast("string") for field in fields]
    written_out = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*written_out), 256))


def _parent(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def subtree(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes, and `levels` levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_parent(below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def _levels_up(nodes: int, most: int) -> int:
    """Levels from so many nodes up to one, at most `most`."""
    return min(most, (nodes - 1).bit_length())


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
    """(place in the batch, members) of each block."""
    members = batch.column("members")
    bounds, flat = members.offsets.to_pylist(), members.values
    for i in range(batch.num_rows):
        yield i, flat.slice(bounds[i], bounds[i + 1] - bounds[i])


def placed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows (tree, id, node, claimed) with `pos`, their place in their tree, and `n`, the tree's number of rows."""
    arrived = written(rows.withColumn("arrival", F.monotonically_increasing_id()), "manifest-leaves")
    order = ["tree", *by, "arrival"]
    numbered = arrived.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = numbered.select("tree", "id", "node", "claimed", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    numbered = written(numbered, "manifest-order")
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("row").alias("first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    found = numbered.join(starts, ["tree", "part"])
    return found.select("tree", "id", "node", "claimed", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "n")


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """The stored level: nodes (tree, pos, n, node, id, claimed) in aligned blocks, sorted by place."""
    member = F.struct("pos", "node", "id", "claimed")
    grouped = nodes.groupBy("tree", "n", F.shiftright("pos", LEVELS).alias("block")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return written(grouped, name)


def tops(stored: DataFrame) -> DataFrame:
    """tree, pos, n, node of the next stored level: the top of each block's subtree."""
    most = LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("n").to_pylist()
            found = [subtree(m.field("node").to_pylist(), _levels_up(counts[i], most))[-1][0] for i, m in _opened(batch)]
            above = [-(-n >> most) if n > 1 << most else 1 for n in counts]
            columns = [batch.column("tree"), batch.column("block"), pa.array(above, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "n", "node"])

    found = stored.mapInArrow(run, "tree string, pos long, n long, node binary")
    return found.select("*", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claimed"))


def paths(stored: DataFrame, above: DataFrame) -> DataFrame:
    """tree, pos, node, id, claimed, path of a stored level's nodes; `above` has tree, pos and path of their blocks' tops."""
    joined = stored.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    most = LEVELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rest = batch.column("n").to_pylist(), batch.column("path").to_pylist()
            for i, members in _opened(batch):
                levels = subtree(members.field("node").to_pylist(), _levels_up(counts[i], most))[:-1]
                found = []
                for place in range(len(members)):
                    steps = []
                    for level in levels:
                        sibling = place ^ 1
                        if sibling < len(level):
                            steps.append(bytes([LEFT if sibling < place else RIGHT]) + level[sibling])
                        else:
                            steps.append(bytes(STEP))
                        place >>= 1
                    found.append(b"".join(steps) + rest[i])
                trees = pa.array([batch.column("tree")[i].as_py()] * len(members), pa.string())
                columns = [trees, *(members.field(c) for c in ("pos", "node", "id", "claimed")), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "node", "id", "claimed", "path"])

    return joined.mapInArrow(run, "tree string, pos long, node binary, id long, claimed binary, path binary")


def _stored_levels(rows: DataFrame, by: Sequence[str], name: str) -> list[DataFrame]:
    """The stored levels of all trees, the leaves first, in the order of the columns `by`."""
    levels = [blocks(placed(rows, by), f"{name}-0")]
    highest = levels[0].agg(F.max("n")).first()[0] or 0
    while highest > 1 << LEVELS:
        below = levels[-1].filter(F.col("n") > 1 << LEVELS)
        levels.append(blocks(tops(below), f"{name}-{len(levels)}"))
        highest = -(-highest >> LEVELS)
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """tree, node: each tree ends in the one block of its highest stored level."""
    ends = [tops(level.filter(F.col("n") <= 1 << LEVELS)) for level in levels]
    return reduce(DataFrame.unionByName, ends).select("tree", "node")


def _proofs(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """tree, node, id, claimed, path of all leaves; `ends` has tree and the path from its root on."""
    at_top = ends.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    above = None
    for level in reversed(levels):
        lone = level.filter(F.col("n") <= 1 << LEVELS).select("tree").distinct()
        tops_here = at_top.join(lone, "tree", "left_semi")
        above = paths(level, tops_here if above is None else above.select("tree", "pos", "path").unionByName(tops_here))
    return above


def proofs(docs: DataFrame, group: str, id: str, fields: Sequence[Column], claimed: Sequence[Column] | None = None) -> DataFrame:
    """The manifest's leaves with their proofs.

    One row a row: `id`, `leaf`, `claimed` (the digest of the `claimed` fields, null where these are null or not given),
    `subroot`, `root` and `path`, steps of STEP bytes. `steps` opens a path, `folded` checks one.
    """
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    other = F.lit(None).cast("binary") if claimed is None else F.when(claimed[0], leaf(claimed[1:]))
    leaves = docs.select(tree.alias("tree"), F.col(id).cast("long").alias("id"), leaf(fields).alias("node"), other.alias("claimed"))
    levels = _stored_levels(leaves, ("id", "node"), "manifest-rows")
    # The groups' roots are the leaves of one tree more; a group's name, as bytes, stands for a claimed digest there.
    subroots = _roots(levels).select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), "node", F.encode("tree", "UTF-8").alias("claimed"))
    top = _stored_levels(subroots, ("claimed",), "manifest-groups")
    root = _roots(top).first()
    start = top[0].select("tree").distinct().withColumn("path", F.lit(b""))
    names = F.decode("claimed", "UTF-8").alias("tree"), F.col("node").alias("subroot")
    ends = written(_proofs(top, start).select(*names, F.lit(root and bytes(root["node"])).cast("binary").alias("root"), "path"), "manifest-ends")
    found = _proofs(levels, ends.select("tree", "path")).join(ends.select("tree", "subroot", "root"), "tree")
    return found.select("id", F.col("node").alias("leaf"), "claimed", "subroot", "root", "path")


def steps(path: Column) -> Column:
    """The steps of a path, from the leaf up: side ('left', 'right' or 'alone') and sibling (hexadecimal, '' if alone)."""
    count = (F.length(path) / STEP).cast("int")
    side = lambda step: F.when(step == F.lit(bytes([LEFT])), "left").when(step == F.lit(bytes([RIGHT])), "right").otherwise("alone")
    at = lambda i: i * STEP + 1
    one = lambda i: F.struct(
        side(F.substring(path, at(i), F.lit(1))).alias("side"),
        F.when(F.substring(path, at(i), F.lit(1)) == F.lit(bytes([ALONE])), "").otherwise(F.lower(F.hex(F.substring(path, at(i) + 1, F.lit(32))))).alias("sibling"),
    )
    none = F.array().cast("array<struct<side:string,sibling:string>>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one)).otherwise(none)


def folded(leaf_text: Column, proof: Column) -> Column:
    """The root that a leaf (hexadecimal) and its steps lead to."""
    inputs = lambda node, step: F.when(step["side"] == "left", F.concat(step["sibling"], node)).when(step["side"] == "right", F.concat(node, step["sibling"])).otherwise(node)
    return F.aggregate(proof, leaf_text, lambda node, step: F.sha2(inputs(node, step), 256))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """Per document its leaf, subroot, root and proof, and whether a tampered table's documents still verify.

    Where 7 divides the unsigned crc32 of the id, n_chars is one too high in the tampered table (a null stays). A document
    without id is not tampered with.
    """
    fields = [F.col(c) for c in FIELDS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    changed = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = proofs(docs, "lang", "doc_id", fields, [tampered, *changed])
    text = lambda c: F.lower(F.hex(c))
    opened = found.select(
        F.col("id").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text(F.coalesce("claimed", "leaf")).alias("checked"),
        steps(F.col("path")).alias("proof"),
    )
    siblings = F.array_join(F.col("proof.sibling"), "")
    done = opened.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("checked"), F.col("proof")).alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """The same in SQL, level by level with every node kept."""
    part = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    hashed = lambda chars: "sha256(" + " || ".join(part(chars if c == "n_chars" else c) for c in FIELDS) + ")"
    # crc32, a bit at a time: a byte enters before the first of its eight steps
    digits = "flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::varchar, '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    tree = lambda name, leaves: f"""{name} as (
  select grp, 0 as level, pos, node from {leaves}
  union all
  select grp, level + 1, pos // 2, sha256(string_agg(node, '' order by pos)) from (
    select *, count(*) over (partition by grp) as nodes from {name}
  ) where nodes > 1 group by grp, level, pos // 2
)"""  # noqa: E731
    return f"""
with recursive leaves as (
  select doc_id, coalesce('=' || lang, '') as grp, {hashed("n_chars")} as node,
    case when {crc} % 7 = 0 then {hashed("(n_chars + 1)")} end as claimed
  from documents
), rows as (
  select *, row_number() over (partition by grp order by doc_id nulls first, node) - 1 as pos from leaves
), {tree("nodes", "rows")}, subroots as (
  select of_group, node, row_number() over (order by encode(of_group)) - 1 as pos, '' as grp
  from (select grp as of_group, max_by(node, level) as node from nodes group by grp)
), {tree("upper_nodes", "subroots")}, top as (
  select max(level) as height, max_by(node, level) as root from upper_nodes
), heights as (select grp, max(level) as height from nodes group by grp
), below as (
  select r.doc_id, r.grp, r.pos, h.level, (r.pos >> h.level)::bigint as at
  from rows r, (select distinct grp, level from nodes) h join heights using (grp) where h.grp = r.grp and h.level < height
), steps as (
  select b.grp, b.pos, b.level, case when s.node is null then 'A' when s.pos < b.at then 'L' || s.node else 'R' || s.node end as step
  from below b left join nodes s on s.grp = b.grp and s.level = b.level and s.pos = xor(b.at, 1)
  union all
  select r.grp, r.pos, h.height + u.level,
    case when s.node is null then 'A' when s.pos < (g.pos >> u.level) then 'L' || s.node else 'R' || s.node end
  from rows r join heights h using (grp) join subroots g on g.of_group = r.grp, (select distinct level from upper_nodes) u, top
  left join upper_nodes s on s.level = u.level and s.pos = xor((g.pos >> u.level)::bigint, 1)
  where u.level < top.height
), proofs as (select grp, pos, list(step order by level) as steps from steps group by grp, pos),
checked as (
  select r.doc_id, r.node as leaf, g.node as subroot, top.root,
    sha256(array_to_string([s[2:] for s in coalesce(p.steps, [])], '')) as proof_sha256,
    list_reduce(list_prepend(coalesce(r.claimed, r.node), coalesce(p.steps, [])),
      lambda a, s: sha256(case s[1] when 'L' then s[2:] || a when 'R' then a || s[2:] else a end)) as folded_root
  from rows r join subroots g on g.of_group = r.grp, top left join proofs p on p.grp = r.grp and p.pos = r.pos
)
select *, folded_root = root as verified from checked
"""
