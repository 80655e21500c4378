"""N-gram Jaccard join: texts whose sets of word 5-grams have a Jaccard similarity of 0.75 or more.

Documents of one set are one class. The join is a blocked sparse product of the class by n-gram
incidence matrix with itself:

1. A chunk learns for each of its n-grams whether any other document has it (``common.ask``).
   A class that shares fewer than 75 % of its n-grams can't link with anything and leaves.
2. Size-derived prefix bound: in the order rarest first, two linked sets meet within the first
   n - ceil(0.75 n) + 1 n-grams of both. Classes that meet there form candidate groups; passages
   that many otherwise different texts hold are not rare and link nothing here.
3. A group is cut into blocks of classes ordered by size. Block pairs whose sizes rule a link
   out are not made; every other pair is one sparse product, which accumulates overlap counts,
   drops pairs below the bound 100 * overlap >= 75 * union and hands on a spanning forest of the
   links with every class's number of links. Pairs themselves are never rows of a table.
4. Connected components of the forests.

Defined results: text null or without words: 0 shingles, its own id as component. Fewer than five
words: the whole sequence is the one shingle. Repeated rows and equal sets: one class, linked.
Rows without a doc_id have component null and link nothing. Extra columns are ignored. The result
holds one row per input row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, answer, ask, chunk_counts, chunked, components, give_back, in_order, lean, mix, tell, texts_of
from cohortlens.operators.scale import settle

WORDS = 5
PERCENT = 75
#: Classes in a block of the product.
BLOCK = 1024
#: Increments handled at once in a product, of some 50 bytes each.
STEP = 1_000_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 5)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    with np.errstate(over="ignore"):
        made = h[:n].copy()
        for j in range(1, words):
            made = made * U64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(mix(made))


def needed(n: int, percent: int = PERCENT) -> int:
    """The least number of its n shingles that a set shares with any set it links with."""
    return -(-n * percent // 100)


def _chunk_sets(table: pa.Table, words: int) -> tuple[pa.Table, list[np.ndarray]]:
    table = in_order(table)
    return table, [shingles(x, words) for x in texts_of(table)]


def _join(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) if sets else np.empty(0, np.uint64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and which of them occur more than once. Sorts the keys where they are."""
    keys.sort()
    same = keys[1:] == keys[:-1]
    first = np.ones(len(keys), bool)
    first[1:] = ~same
    return keys[first], np.append(same, False)[: len(keys)][first]


def described(df: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n, set_key (16 bytes; null without shingles), and for the first of a set in
    its chunk, if enough of it is shared: the shared shingles rarest first and the prefix length."""
    chunks, n_chunks = chunked(df)

    def keys_of(table: pa.Table):
        keys, _ = _distinct(_join([shingles(x, words) for x in texts_of(table)]))
        return keys, np.empty(0, np.int64)

    def finish(table: pa.Table, said: np.ndarray) -> pa.Table:
        table, sets = _chunk_sets(table, words)
        keys, local = _distinct(_join(sets))
        shared_keys = (said > 1) | local
        out = {"n": [], "set_key": [], "shared": [], "prefix": []}
        seen = set()
        for s in sets:
            key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            shared, prefix = None, None
            if len(s) and key not in seen:
                seen.add(key)
                at = np.searchsorted(keys, s)
                some = shared_keys[at]
                if some.sum() >= needed(len(s), percent):
                    # one order for all chunks: by the number of chunks, then by hash
                    order = np.lexsort((s[some], said[at[some]]))
                    shared = s[some][order].tobytes()
                    prefix = len(s) - needed(len(s), percent) + 1 - int((~some).sum())
            for name, value in zip(out, (len(s), key, shared, prefix), strict=True):
                out[name].append(value)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n": pa.array(out["n"], pa.int64()),
                "set_key": pa.array(out["set_key"], pa.binary()),
                "shared": pa.array(out["shared"], pa.binary()),
                "prefix": pa.array(out["prefix"], pa.int32()),
            }
        )

    # half keys: a chance agreement only keeps a class in the join that the product then drops
    answers = answer(ask(chunks, keys_of, n_chunks, np.uint32), chunk_counts, np.uint32)
    return tell(chunks, answers, finish, "doc_id long, n long, set_key binary, shared binary, prefix int")


def _prefix_rows(classes: DataFrame) -> DataFrame:
    """(h, set_key) for the prefix of every class, its rarest shared shingles."""

    def rows(batches):
        for batch in batches:
            give_back()
            keys, hashes = [], []
            for key, shared, prefix in zip(*(batch.column(c).to_pylist() for c in ("set_key", "shared", "prefix")), strict=True):
                h = np.frombuffer(shared, np.int64)[:prefix]
                hashes.append(h)
                keys += [key] * len(h)
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array(np.concatenate(hashes) if hashes else [], pa.int64()), "set_key": pa.array(keys, pa.binary())}
            )

    return classes.select("set_key", "shared", "prefix").mapInArrow(rows, "h long, set_key binary")


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        while (root[root] != root).any():
            root = root[root]
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    return root


def product(
    left: list[np.ndarray], right: list[np.ndarray], left_n: np.ndarray, right_n: np.ndarray, same: bool, percent: int
) -> np.ndarray:
    """The linked (i, j) of two blocks of classes, by a sparse product over their shingles."""

    def entries(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (ha, ia), (hb, ib) = entries(left), entries(right)
    order = np.argsort(hb, kind="stable")
    hb, ib = hb[order], ib[order]
    lo, hi = np.searchsorted(hb, ha, "left"), np.searchsorted(hb, ha, "right")
    width = hi - lo
    counts = np.zeros((len(left), len(right)), np.int32)
    # one step at least: blocks of a large group may share nothing
    bounds = np.searchsorted(np.cumsum(width), np.arange(0, max(width.sum(), 1) + STEP, STEP))
    for s, e in zip(bounds[:-1], [*bounds[1:-1], len(width)], strict=True):
        w = width[s:e]
        if not w.sum():
            continue
        # the entries come class by class, so a step adds to a few rows of the counts
        first, last = ia[s], ia[e - 1] + 1
        cell = np.repeat((ia[s:e] - first) * len(right), w)
        at = np.arange(w.sum()) + np.repeat(lo[s:e] - (np.cumsum(w) - w), w)
        cell += ib[at]
        counts[first:last] += np.bincount(cell, minlength=(last - first) * len(right)).reshape(-1, len(right))
    # 100 * overlap >= percent * union, union being both sizes less the overlap
    linked = (100 + percent) * counts.astype(np.int64) >= percent * (left_n[:, None] + right_n[None, :])
    if same:
        linked &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    return np.argwhere(linked)


def _block_products(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of every candidate group: (set_key, root_key, links), a row for each linked class and
    block pair."""
    # groups are cut into size-ordered blocks: a block is a range of sizes, cut further by hash
    counted = members.groupBy("root", "n").agg(F.count(F.lit(1)).alias("rows"))
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("group_rows"))
    small = size.where(F.col("group_rows") <= block).select("root")
    large = size.where(F.col("group_rows") > block).select("root")
    whole = members.join(small, "root").select("root", F.lit("").alias("pair"), F.lit(0).alias("side"), "set_key", "n", "shared")

    # bands of sizes: classes of bands further apart than the bound allows can't link
    width = math.log(100 / percent)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width))
    banded = counted.join(large, "root").groupBy("root", band.alias("band")).agg(F.sum("rows").alias("rows"))
    banded = banded.select("root", "band", F.ceil(F.col("rows") / block).alias("cuts"))
    cut = members.join(large, "root").withColumn("band", band).join(banded, ["root", "band"])
    cut = cut.withColumn("cut", F.pmod(F.xxhash64("set_key"), F.col("cuts")))
    above = banded.select("root", (F.col("band") - 1).alias("band"), F.col("cuts").alias("above"))
    below = banded.select("root", (F.col("band") + 1).alias("band"), F.col("cuts").alias("below"))
    cut = cut.join(above, ["root", "band"], "left").join(below, ["root", "band"], "left")

    def name(b1, c1, b2, c2):
        return F.concat_ws(":", b1, c1, b2, c2)

    with_own = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda j: F.struct(
            name(F.col("band"), F.least(F.col("cut"), j), F.col("band"), F.greatest(F.col("cut"), j)).alias("pair"),
            F.when(j < F.col("cut"), 1).otherwise(0).alias("side"),
        ),
    )
    with_above = F.when(
        F.col("above") > 0,
        F.transform(
            F.sequence(F.lit(0), F.coalesce("above", F.lit(1)) - 1),
            lambda j: F.struct(name(F.col("band"), F.col("cut"), F.col("band") + 1, j).alias("pair"), F.lit(0).alias("side")),
        ),
    )
    with_below = F.when(
        F.col("below") > 0,
        F.transform(
            F.sequence(F.lit(0), F.coalesce("below", F.lit(1)) - 1),
            lambda j: F.struct(name(F.col("band") - 1, j, F.col("band"), F.col("cut")).alias("pair"), F.lit(1).alias("side")),
        ),
    )
    dealt = cut.select("root", "set_key", "n", "shared", F.explode(F.concat(with_own, F.coalesce(with_above, F.array()), F.coalesce(with_below, F.array()))).alias("p"))
    dealt = dealt.select("root", "p.pair", "p.side", "set_key", "n", "shared")

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by([("set_key", "ascending")])
        keys, n = table["set_key"].to_pylist(), table["n"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shared"].to_pylist()]
        side = table["side"].to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(b)
        b = a if same else b
        if len(a):
            pairs = product([sets[i] for i in a], [sets[i] for i in b], n[a], n[b], same, percent)
        else:
            pairs = np.empty((0, 2), np.int64)
        pairs = np.c_[a[pairs[:, 0]], b[pairs[:, 1]]]
        root = _roots(len(keys), pairs)
        degree = np.bincount(pairs.ravel(), minlength=len(keys))
        on = np.flatnonzero(degree)
        return pa.table(
            {
                "set_key": pa.array([keys[i] for i in on], pa.binary()),
                "root_key": pa.array([keys[root[i]] for i in on], pa.binary()),
                "links": pa.array(degree[on], pa.int64()),
            }
        )

    return whole.unionByName(dealt).groupBy("root", "pair").applyInArrow(lambda table: lean(links, table), "set_key binary, root_key binary, links long")


def jaccard_components(df: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (the smallest doc_id of its set) and
    class_links (the number of other sets that its set links with)."""
    rows, _ = settle(described(df, words, percent))
    known = rows.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = (
        known.where("shared IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "n", "shared", "prefix")).alias("c"))
        .select("set_key", "c.n", "c.shared", "c.prefix")
    )
    classes, _ = settle(classes)
    prefix = _prefix_rows(classes)
    firsts = prefix.groupBy("h").agg(F.min("set_key").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    met = components(prefix.join(firsts, "h").select(F.col("set_key").alias("a"), "b"))
    grouped = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct())
    members = classes.join(grouped, classes["set_key"] == grouped["node"]).select("root", "set_key", "n", "shared")
    links, _ = settle(_block_products(settle(members)[0], percent, block))
    joined = components(links.select(F.col("set_key").alias("a"), F.col("root_key").alias("b")))
    degree = links.groupBy("set_key").agg(F.sum("links").alias("class_links"))
    # the smallest doc_id of every class, then of every component
    class_ids = known.groupBy("set_key").agg(F.min("doc_id").alias("class_id"))
    placed = class_ids.join(joined, class_ids["set_key"] == joined["node"], "left").select("set_key", "class_id", F.coalesce("root", "set_key").alias("root"))
    least = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    found = placed.join(least, "root").join(degree, "set_key", "left")
    found, _ = settle(found.select("set_key", "class_id", "component_id", F.coalesce("class_links", F.lit(0)).alias("class_links")))
    own = F.when(F.col("set_key").isNull(), F.col("doc_id"))
    return (
        rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
        .join(found, "set_key", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"),
            F.coalesce("class_id", own).alias("class_id"), F.coalesce("class_links", F.lit(0)).alias("class_links"),
        )
    )
