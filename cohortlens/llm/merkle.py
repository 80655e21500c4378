"""Merkle manifest of a dataset: a tree of SHA-256 digests for each source, a tree over the sources'
roots, and for every row the proof that leads from its digest to the root of all.

A leaf is the digest of a row's fields, made by Spark's own functions. Leaves are put in order by one
range partitioning; counts of (tree, partition) turn places in a partition into places in the tree. Three
consecutive nodes have one parent, and 3 ** ``LEVELS`` = 2187 consecutive nodes are a superblock.

Up: every superblock is reduced to one node, until a tree has one node left. A table of nodes is a
2187th of the one below it. Down: the nodes outside a superblock that its rows need are the same for
all of them, a few digests for each level above. The superblocks of a level are cogrouped with those outer
nodes; local reduction, joining the proofs and folding them are done there. Blocks are dealt by hash over
as many groups as there are blocks, so many small trees share a group and a large tree is many groups.

Defined results: a null field is written ``-``, an empty one ``0:``. Rows without a source are a tree of their own,
the first; rows without a doc_id come first in their tree. Equal doc_ids stand in the order of their digests,
repeated rows next to each other, each with its own proof. An empty table has no rows and no root. Extra columns
are ignored, whatever they are called."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import crc_of_id
from cohortlens.operators.scale import settle

#: Children of a node, levels of a superblock, nodes below it.
FAN = 3
LEVELS = 7
#: Rows in a part of the range partitioning.
PART_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: dict[str, Column]) -> Column:
    """The digest of fields in order: ``-`` for null, else length in bytes, ``:``, value."""
    texts = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]), 256)


def rounds(n: int) -> int:
    """How often n nodes are reduced until one remains."""
    made = 0
    while n > 1:
        n, made = -(-n // FAN), made + 1
    return made


def reduced(nodes: list[str], times: int) -> list[list[str]]:
    """The nodes and what they become, level by level."""
    made = [nodes]
    for _ in range(times):
        below = made[-1]
        made.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return made


def steps(nodes: list[str]) -> list[str]:
    """For every node its place in its run and the other nodes of the run, as one text."""
    made = []
    for i in range(0, len(nodes), FAN):
        run = nodes[i : i + FAN]
        made += [f"{j}{''.join(run[:j])}{''.join(run[j + 1 :])}" for j in range(len(run))]
    return made


def paths(nodes: list[str], times: int, outer: str) -> tuple[list[str], str]:
    """The path of every node: its steps joined by ``/``, the outer ones last. And the node above all."""
    made = reduced(nodes, times)
    above = [outer]
    for level in made[-2::-1]:
        above = [f"{step}/{above[i // FAN]}" if above[i // FAN] else step for i, step in enumerate(steps(level))]
    return above, made[-1][0]


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and a path lead to."""
    for step in path.split("/") if path else ():
        at = 1 + DIGEST * int(step[0])
        leaf = digest(step[1:at] + leaf + step[at:])
    return leaf


def siblings_digest(path: str) -> str:
    return digest("".join(step[1:] for step in path.split("/")) if path else "")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add pos (the place in the tree, from 0) and n (nodes of the tree) to rows with a column tree."""
    names = rows.columns
    n = max(1, math.ceil(rows.count() / PART_ROWS))
    # equal rows may stand in any order: a number deals a very frequent one over parts
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1021)))
    cut = dealt.repartitionByRange(n, "tree", *order, "_salt").sortWithinPartitions("tree", *order).select(*names)

    def numbered(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = np.array(batch.column("tree").to_pylist(), object)
            at = np.arange(len(tree))
            begins = np.r_[True, tree[1:] != tree[:-1]]
            place = at - np.maximum.accumulate(np.where(begins, at, 0))
            if tree[0] == last:
                first = int(np.argmax(begins[1:])) + 1 if begins[1:].any() else len(tree)
                place[:first] += seen
            last, seen = tree[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(tree), part), pa.int32()), pa.array(place, pa.int64())], names=[*names, "_part", "_in"]
            )

    schema = ", ".join(f"`{c}` {kind}" for c, kind in cut.dtypes) + ", _part int, _in long"
    stored, _ = settle(cut.mapInArrow(numbered, schema))
    sizes = stored.groupBy("tree", "_part").agg((F.max("_in") + 1).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tree", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(tree).alias("n"))
    return stored.join(offsets, ["tree", "_part"]).select(*names, (F.col("_before") + F.col("_in")).alias("pos"), "n")


def _grouped(nodes: DataFrame, groups: int, block: Column) -> DataFrame:
    """Superblocks dealt over groups; the outer nodes of a superblock are dealt like it."""
    return nodes.withColumn("_group", F.pmod(F.xxhash64("tree", block), F.lit(groups)).cast("int"))


def _blocks(frame: pd.DataFrame, size: int):
    """(tree, block, nodes of the tree, rows in order) for every superblock of a group."""
    if frame.empty:
        return
    frame = frame.assign(_block=frame["pos"] // size).sort_values(["tree", "pos"], kind="stable")
    tree, block = frame["tree"].to_numpy(), frame["_block"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (block[1:] != block[:-1]), True])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield tree[a], int(block[a]), int(frame["n"].iat[a]), frame.iloc[a:b]


def _groups_of(nodes: DataFrame, size: int) -> int:
    return max(1, math.ceil(nodes.count() / size))


def _reduce(levels: int):
    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        size = FAN**levels
        made = [(tree, block, -(-n // size), reduced(rows["node"].tolist(), min(levels, rounds(n)))[-1][0]) for tree, block, n, rows in _blocks(frame, size)]
        return pd.DataFrame(made, columns=["tree", "pos", "n", "node"])

    return reduce


def climbed(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Tables (tree, pos, n, node), each a level of superblocks above the one before; the last has one
    node for each tree. Each is settled: a step here is a job of its own when the plan is built."""
    made, size = [nodes], FAN**levels
    while True:
        below = _grouped(made[-1].select("tree", "pos", "n", "node"), _groups_of(made[-1], size), F.expr(f"pos DIV {size}"))
        above, _ = settle(below.groupBy("_group").applyInPandas(_reduce(levels), "tree string, pos long, n long, node string"))
        made.append(above)
        if (above.agg(F.max("n")).first()[0] or 0) <= 1:
            return made


OUTER = "tree string, pos long, path string, subroot string, root string"


def _found(frame: pd.DataFrame, outer: pd.DataFrame, levels: int):
    """(tree, rows, their paths, subroot, root) for every superblock of a group."""
    known = {(t, p): x for t, p, *x in outer[["tree", "pos", "path", "subroot", "root"]].itertuples(index=False)}
    for tree, block, n, rows in _blocks(frame, FAN**levels):
        path, subroot, root = known[tree, block]
        yield tree, rows, paths(rows["node"].tolist(), min(levels, rounds(n)), path)[0], subroot, root


def _descend(levels: int):
    def descend(frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        made = []
        for tree, rows, found, subroot, root in _found(frame, outer, levels):
            made += [(tree, pos, path, subroot, root) for pos, path in zip(rows["pos"].tolist(), found, strict=True)]
        return pd.DataFrame(made, columns=["tree", "pos", "path", "subroot", "root"])

    return descend


def descended(tables: list[DataFrame], outer: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The outer nodes of every node of the first table, from those of the last."""
    size = FAN**levels
    for nodes in tables[-2::-1]:
        groups = _groups_of(nodes, size)
        inner = _grouped(nodes.select("tree", "pos", "n", "node"), groups, F.expr(f"pos DIV {size}"))
        outer = _grouped(outer, groups, F.col("pos"))
        outer, _ = settle(inner.groupBy("_group").cogroup(outer.groupBy("_group")).applyInPandas(_descend(levels), OUTER))
    return outer


def _finish(levels: int, with_proof: bool):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if with_proof else [])]

    def finish(frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        made = []
        for _, rows, found, subroot, root in _found(frame, outer, levels):
            for doc_id, leaf, other, proof in zip(rows["doc_id"], rows["node"], rows["other"], found, strict=True):
                top = folded(leaf if other is None else other, proof)
                made.append((doc_id, leaf, subroot, root, siblings_digest(proof), top, top == root, *([proof] if with_proof else [])))
        return pd.DataFrame(made, columns=names)

    return finish


def manifest(df: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, with_proof: bool = False, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, with_proof also the
    proof: steps from the leaf up joined by ``/``, each the place in the run and the other nodes of it.
    ``changed`` holds expressions for fields as they are found now: the root is folded from their digest."""
    as_given = {c: F.col(c) for c in fields}
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # sorts like the source, null first
    leaf, now = leaf_of(as_given), leaf_of(as_given | (changed or {}))
    rows = df.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("node"), now.alias("_now"))
    rows = rows.select("tree", "doc_id", "node", F.when(F.col("_now") != F.col("node"), F.col("_now")).alias("other"))
    leaves, _ = settle(placed(rows, ["doc_id", "node"]))
    nodes = climbed(leaves, levels)

    # the tree over the sources' roots
    subroots, _ = settle(placed(nodes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"]))
    top = climbed(subroots, levels)
    outer = top[-1].select("tree", "pos", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    outer = descended(top, outer, levels).join(subroots.select("pos", "name", "node"), "pos")
    outer = outer.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root")
    outer = descended(nodes[1:], outer, levels)

    groups = _groups_of(leaves, FAN**levels)
    # ids travel as text: pandas has no whole numbers beside nulls
    inner = _grouped(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), groups, F.expr(f"pos DIV {FAN**levels}"))
    outer = _grouped(outer, groups, F.col("pos"))
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    made = inner.groupBy("_group").cogroup(outer.groupBy("_group")).applyInPandas(_finish(levels, with_proof), schema + (", proof string" if with_proof else ""))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def without_line_feeds(id_column: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The change that the query looks for: line feeds deleted where the crc32 of the id is even (that of
    a row without an id counts as 0)."""
    return {text: F.when(crc_of_id(id_column) % 2 == 0, F.translate(F.col(text).cast("string"), "\n", "")).otherwise(F.col(text).cast("string"))}


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def oracle() -> str:
    """The same in SQL, level by level; crc32 bit by bit."""
    same = " || ".join(_field(c) for c in FIELDS)
    now = " || ".join(_field("tampered" if c == "text" else c) for c in FIELDS)
    bits = "flatten([[(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> b) & 1 for b in range(8)] for i in range(1, strlen(CAST(doc_id AS VARCHAR)) + 1)])"
    crc = f"list_reduce([CAST(4294967295 AS BIGINT)] || {bits}, lambda c, bit: xor(c >> 1, CASE WHEN (c & 1) != bit THEN CAST(3988292384 AS BIGINT) ELSE 0 END))"
    return f"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN xor({crc}, CAST(4294967295 AS BIGINT)) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents
),
l AS (
  SELECT doc_id, source, sha256({same}) AS leaf, sha256({now}) AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM d
),
up AS (
  SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY source, level, pos // 3
),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3
),
runs AS (SELECT source, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY source, level, pos // 3),
top_runs AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY level, pos // 3),
inside AS (
  SELECT doc_id, source, 0 AS level, pos, other AS h, '' AS proof FROM l
  UNION ALL
  SELECT i.doc_id, i.source, i.level + 1, i.pos // 3, sha256(array_to_string(hs[1:i.pos % 3] || [h] || hs[i.pos % 3 + 2:], '')),
    proof || array_to_string(hs[1:i.pos % 3] || hs[i.pos % 3 + 2:], '')
  FROM inside i JOIN runs r ON r.source IS NOT DISTINCT FROM i.source AND r.level = i.level AND r.run = i.pos // 3
),
at_subroot AS (SELECT i.* FROM inside i WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.source IS NOT DISTINCT FROM i.source AND r.level = i.level)),
outside AS (
  SELECT a.doc_id, 0 AS level, s.pos, a.h, a.proof, s.subroot FROM at_subroot a JOIN sub s ON s.source IS NOT DISTINCT FROM a.source
  UNION ALL
  SELECT o.doc_id, o.level + 1, o.pos // 3, sha256(array_to_string(hs[1:o.pos % 3] || [h] || hs[o.pos % 3 + 2:], '')),
    proof || array_to_string(hs[1:o.pos % 3] || hs[o.pos % 3 + 2:], ''), o.subroot
  FROM outside o JOIN top_runs r ON r.level = o.level AND r.run = o.pos // 3
)
SELECT o.doc_id, l.leaf, o.subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM outside o JOIN (SELECT * FROM top WHERE n = 1) t ON o.level = t.level JOIN l ON l.doc_id = o.doc_id
"""
