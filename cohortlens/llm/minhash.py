"""MinHash near-duplicates: documents whose sets of word 5-grams have a Jaccard similarity of 0.85 or more.

Documents of one set are one class. The rest is about classes:

1. One-permutation hashing: an n-gram's hash names one of ``BINS`` bins, and a bin holds the smallest hash that
   fell into it. Optimal densification fills an empty bin from one that is not, chosen by a random order of
   all bins that belongs to the empty bin and is the same for every set: bins are then equal with the
   probability of the similarity, independently of each other, for small sets too.
2. Every ``ROWS`` bins are a band, and classes with equal bands share a bucket. A pair at 0.85 shares none
   of 48 buckets with probability 2e-7.
3. Star-shaped candidates: in a bucket every class gets one edge, to the bucket's hub, which is the class that
   meets most others over all bands. A bucket of m classes gives m - 1 edges, not m * (m - 1) / 2, and the
   edges are confirmed on the full sets.
4. A bucket whose edges are all confirmed is settled: its classes are linked through the hub. Where some
   aren't, a link between two classes beside the hub could be lost. Those open buckets are joined to groups, and
   groups are compared exactly: blocks of classes, by sparse products, with no pair as a row. Pairs of blocks
   that sizes rule out, or that are linked through one star already, are not made.
5. Connected components of the links.

Defined results: text null or without words: 0 shingles, its own id as component, kept. Fewer than five
words: the whole sequence is the one shingle. Repeated rows and equal sets: one class, linked; all rows of the
smallest doc_id are kept. Rows without a doc_id have component null, link nothing and are kept. Extra columns are ignored.
The result holds one row per input row. Intermediate tables are settled when the plan is built."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, components, mix
from cohortlens.llm.jaccard import _roots, product, shingles
from cohortlens.operators.scale import HOT_ROWS, hot_keys, salted_left_join, settle

WORDS = 5
PERCENT = 85
BINS = 384
ROWS = 8
#: Classes in a block of the product, edges of a star in one task, shingles in one task.
BLOCK = 1024
STAR = 512
SHINGLES = 1_000_000
#: For every bin the order in which it asks the others.
ORDERS = np.argsort(mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1).argsort(axis=1).astype(np.uint16)


def signature(s: np.ndarray) -> np.ndarray:
    """The value of every bin for a set: sorted distinct hashes, at least one."""
    bins = (((s >> U64(32)) * U64(BINS)) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    held = bins[first]
    made = np.zeros(BINS, np.uint64)
    made[held] = s[first]
    if len(held) == 1:
        made[:] = s[0]
    elif len(held) < BINS:
        empty = np.ones(BINS, bool)
        empty[held] = False
        empty = np.flatnonzero(empty)
        made[empty] = made[held[ORDERS[np.ix_(empty, held)].argmin(1)]]
    return made


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for every band of a signature; keys of different bands differ."""
    bands = values.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + bands[:, j])
    return key.view(np.int64)


def described(df: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id, text_key, n, set_key (16 bytes) and keys (one for each band; null without shingles)."""

    def rows(batches):
        for batch in batches:
            n, set_keys, keys = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                set_keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(set_keys, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n", "set_key", "keys"],
            )

    text = F.col("text").cast("string")
    given = df.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return given.mapInArrow(rows, "doc_id long, text_key long, n long, set_key binary, keys array<long>")


def sets_of(df: DataFrame, rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_key, n, hashes) for the wanted classes (doc_id, text_key, set_key), made from their texts. A row
    that is repeated very often is dealt over tasks."""
    text = F.col("text").cast("string")
    texts = df.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    on = ["doc_id", "text_key"]
    hot, n_hot = settle(hot_keys(rows.where("doc_id IS NOT NULL").select(*on), on))
    # the wanted classes grow with the rows: never broadcast, the same plan at every size
    found = salted_left_join(texts, [wanted], on).where("set_key IS NOT NULL") if n_hot else texts.join(wanted.hint("merge"), on)
    found = found.dropDuplicates(on)

    def made(batches):
        for batch in batches:
            sets = [shingles(x, words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["set_key", "n", "hashes"],
            )

    return found.select("set_key", "text").mapInArrow(made, "set_key binary, n long, hashes binary")


def _with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Join rows with their bucket (key, size, ...); rows of a bucket above ``HOT_ROWS`` are dealt over tasks."""
    _, n_hot = settle(buckets.where(F.col("size") > HOT_ROWS).select("key"))
    if n_hot:
        return salted_left_join(rows, [buckets], ["key"]).where("size IS NOT NULL")
    # buckets grow with the rows: never broadcast, the same plan at every size
    return rows.join(buckets.hint("merge"), "key")


def stars(classes: DataFrame) -> DataFrame:
    """(key, size, set_key, hub) for every class in a bucket with others."""
    rows = classes.select(F.explode("keys").alias("key"), "set_key")
    buckets, _ = settle(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met, _ = settle(_with_bucket(rows, buckets))
    weights = met.groupBy("set_key").agg(F.sum("size").alias("weight"))
    hubs = met.join(weights, "set_key").groupBy("key").agg(F.max(F.struct("weight", "set_key")).alias("hub"), F.first("size").alias("size"))
    hubs, _ = settle(hubs.select("key", F.col("hub.set_key").alias("hub"), "size"))
    return _with_bucket(met.select("key", "set_key"), hubs)


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(set_key, hub, linked) for every edge (set_key, hub). A star of many edges is cut into parts, each
    with a copy of its hub's set; parts are dealt over tasks by hash."""
    counted = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("_parts"))
    dealt = salted_left_join(edges, [counted], ["hub"]).withColumn("_part", F.pmod(F.xxhash64("set_key"), F.col("_parts"))).drop("_parts")
    dealt, n_edges = settle(dealt)
    total = dealt.join(sets.select("set_key", "n"), "set_key").agg(F.sum("n")).first()[0] or 0
    group = F.pmod(F.xxhash64("hub", "_part"), F.lit(max(1, math.ceil(total / SHINGLES)))).cast("int").alias("_group")
    members = dealt.join(sets, "set_key").select(group, "hub", "_part", "set_key", "n", "hashes")
    hubs = dealt.select("hub", "_part").distinct().join(sets.withColumnRenamed("set_key", "hub"), "hub")
    hubs = hubs.select(group, F.col("hub").alias("of"), F.col("hashes").alias("centre"))

    def confirm(table: pa.Table, centres: pa.Table) -> pa.Table:
        own = dict(zip(centres["of"].to_pylist(), centres["centre"].to_pylist(), strict=True))
        table = table.sort_by([("hub", "ascending")])
        hub, n = table["hub"].to_pylist(), table["n"].to_numpy()
        blobs, linked = table["hashes"].to_pylist(), np.zeros(len(n), bool)
        begin = 0
        for end in range(1, len(hub) + 1):
            if end < len(hub) and hub[end] == hub[begin]:
                continue
            centre, sizes = np.frombuffer(own[hub[begin]], np.uint64), n[begin:end]
            every = np.frombuffer(b"".join(blobs[begin:end]), np.uint64)
            at = np.minimum(np.searchsorted(centre, every), len(centre) - 1)
            overlap = np.add.reduceat(centre[at] == every, np.cumsum(sizes) - sizes, dtype=np.int64)
            linked[begin:end] = 100 * overlap >= percent * (sizes + len(centre) - overlap)
            begin = end
        return pa.table({"set_key": table["set_key"], "hub": table["hub"], "linked": pa.array(linked)})

    return members.groupBy("_group").cogroup(hubs.groupBy("_group")).applyInArrow(confirm, "set_key binary, hub binary, linked boolean")


def _dealt_blocks(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(root, pair, side, set_key): members (root, set_key, n, star) of every group in pairs of blocks. A
    group of up to ``block`` classes is one block; a larger one is cut by range of size, by star if that is
    large, and by hash."""
    groups = members.groupBy("root").agg((F.count(F.lit(1)) > block).alias("large"))
    in_star = members.groupBy("root", "star").agg((F.count(F.lit(1)) > block).alias("large_star"))
    cut = salted_left_join(salted_left_join(members, [groups], ["root"]), [in_star], ["root", "star"])
    band = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)))).otherwise(F.lit(0))
    star = F.when(F.col("large") & F.col("large_star"), F.hex("star")).otherwise(F.lit(""))
    cut, _ = settle(cut.select("root", "set_key", band.alias("band"), star.alias("star")))
    cells = cut.groupBy("root", "band", "star").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    # the blocks of a group: one entry for up to ``block`` classes
    blocks = cells.select("root", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "band", "star")
    blocks = blocks.groupBy("root").agg(F.collect_list(F.struct("band", "star", "cut")).alias("blocks"))
    own = salted_left_join(cut, [cells], ["root", "band", "star"]).withColumn("cut", F.pmod(F.xxhash64("set_key"), F.col("cuts")).cast("int"))
    own = salted_left_join(own.select("root", "set_key", F.struct("band", "star", "cut").alias("own")), [blocks], ["root"])
    meets = F.filter(
        "blocks",
        lambda b: (F.abs(b["band"] - F.col("own.band")) <= 1) & ((b == F.col("own")) | (b["star"] != F.col("own.star")) | (b["star"] == "")),
    )
    met = own.select("root", "set_key", "own", F.explode(meets).alias("other"))
    # a large star's blocks are linked through its hub: nothing to compare inside
    met = met.where("own != other OR own.star = ''")
    pair = F.to_json(F.struct(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))
    return met.select("root", pair.alias("pair"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "set_key")


def compared(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(set_key, hub): a spanning forest of the links of every pair of blocks of members (root, set_key,
    n, star)."""
    dealt, _ = settle(_dealt_blocks(members, percent, block))
    total = dealt.join(sets.select("set_key", "n"), "set_key").agg(F.sum("n")).first()[0] or 0
    group = F.pmod(F.xxhash64("root", "pair"), F.lit(max(1, math.ceil(total / SHINGLES)))).cast("int").alias("_group")
    rows = dealt.join(sets, "set_key").select(group, "root", "pair", "side", "set_key", "n", "hashes")

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("root", "pair", "side", "set_key")])
        keys, n, side = table["set_key"].to_pylist(), table["n"].to_numpy(), table["side"].to_numpy()
        unit = list(zip(table["root"].to_pylist(), table["pair"].to_pylist(), strict=True))
        blobs, found, begin = table["hashes"].to_pylist(), [], 0
        for end in range(1, len(unit) + 1):
            if end < len(unit) and unit[end] == unit[begin]:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in blobs[begin:end]]
            middle, sizes = int((side[begin:end] == 0).sum()), n[begin:end]
            same = middle == len(sets)
            if same:
                pairs = product(sets, sets, sizes, sizes, True, percent)
            elif middle:
                pairs = product(sets[:middle], sets[middle:], sizes[:middle], sizes[middle:], False, percent) + [0, middle]
            else:
                pairs = np.empty((0, 2), np.int64)
            root = _roots(len(sets), pairs)
            found += [(keys[begin + i], keys[begin + int(root[i])]) for i in np.flatnonzero(root != np.arange(len(root)))]
            begin = end
        return pa.table({"set_key": pa.array([a for a, _ in found], pa.binary()), "hub": pa.array([b for _, b in found], pa.binary())})

    return rows.groupBy("_group").applyInArrow(links, "set_key binary, hub binary")


def links_of(classes: DataFrame, sets_for, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(set_key, hub): links that connect all classes that a bucket brings together and that are similar enough.
    sets_for(wanted) gives (set_key, n, hashes) of the wanted set_keys."""
    star_rows, _ = settle(stars(classes))
    sets, _ = settle(sets_for(star_rows.select("set_key").distinct()))
    edges = star_rows.where("set_key != hub").select("set_key", "hub").distinct()
    checked, _ = settle(confirmed(edges, sets, percent))
    linked = checked.where("linked").select("set_key", "hub")
    # buckets of three or more with an edge that failed
    failed = checked.where("NOT linked").select("set_key", "hub")
    open_keys = star_rows.where("size > 2").join(failed, ["set_key", "hub"]).select("key").distinct()
    open_edges, n_open = settle(star_rows.join(open_keys, "key", "left_semi").where("set_key != hub").select("set_key", "hub").distinct())
    if not n_open:
        return linked
    reach = components(open_edges, "set_key", "hub")
    grouped = reach.unionByName(reach.select(F.col("root").alias("node"), "root").distinct())
    own = components(linked, "set_key", "hub").select(F.col("node").alias("set_key"), F.col("root").alias("_star"))
    members = grouped.withColumnRenamed("node", "set_key").join(sets.select("set_key", "n"), "set_key").join(own, "set_key", "left")
    members, _ = settle(members.select("root", "set_key", "n", F.coalesce("_star", "set_key").alias("star")))
    return linked.unionByName(compared(members, sets, percent, block))


def near_duplicates(df: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept and class_id (the smallest doc_id of its set)."""
    rows, _ = settle(described(df, words))
    known = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "keys")).alias("c"))
    classes, _ = settle(classes.select("set_key", "c.*"))

    def sets_for(wanted: DataFrame) -> DataFrame:
        return sets_of(df, rows, classes.select("doc_id", "text_key", "set_key").join(wanted, "set_key"), words)

    joined = components(links_of(classes, sets_for, percent, block), "set_key", "hub")
    placed = classes.select("set_key", F.col("doc_id").alias("class_id")).join(joined, F.col("set_key") == F.col("node"), "left")
    placed = placed.select("set_key", "class_id", F.coalesce("root", "set_key").alias("root"))
    least = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    found, _ = settle(salted_left_join(placed, [least], ["root"]).select("set_key", "class_id", "component_id"))
    given = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    own = F.when(F.col("set_key").isNull(), F.col("doc_id"))
    made = salted_left_join(given, [found], ["set_key"]).select(
        "doc_id", "n_shingles", F.coalesce("component_id", own).alias("component_id"), F.coalesce("class_id", own).alias("class_id")
    )
    return made.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
