"""Language-model scores by context-tree weighting over bytes.

A text is its words (A to Z lower-cased) with single spaces between them and an end byte. Each byte is eight
binary decisions, each decision a node of a tree over the ``DEPTH`` bytes before it. A node's
Krichevsky-Trofimov estimator learns from how often either bit followed; its weighted probability is half its
own block probability and half the product of its children's, one byte deeper. Reading the tree from the
training counts, a bit's probability mixes the estimates of all depths by the posterior weights that
follow; contexts never seen leave the word to the next shorter one. The code length of a text is the sum
over its bits.

The counts and the contexts grow with the data, so nobody holds them all. A chunk of texts asks about its
distinct grams (context and byte) in blocks by the hash of the whole gram, where the counts of all chunks are
added up, so that a gram goes on once however many chunks have it. All grams below ``CUT`` bytes of context then meet in
one task, 2^24 at most by construction at depth 5; it builds their subtree and answers with the code length of each. Depths 0 to
2, shared by many tasks, are fitted before on the counts of (two bytes of context, byte), at most 2^24 numbers by
construction. Their weights need the log weights of all subtrees below: these are summed in tasks by two bytes of
context and told to the subtrees, and from there up to the nodes of depth 1, 256 x 255 at most, which all subtrees
learn of and from which the weights of depth 0 follow. So the estimates of all depths are mixed by the weights of the whole tree. Word counts
for the unigram base are added up like those of grams, and the number of distinct words is summed from what each
task of words found.

Defined results: a null text is empty: its end alone is scored. Without training texts each bit has probability
1/2. Repeated rows are scored, and learned from, as often as they occur. Rows without a doc_id count as id 0 of
the hash, so they are training rows. Extra columns are ignored. The result holds one row per input row."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import U64, blocks, chunked, crc_of_id, in_order, mix
from cohortlens.operators.scale import settle

DEPTH = 5
#: Bytes of context whose subtrees are built in one task.
CUT = 3
FOLDS, HELD_FOLD = 7, 2
END = b"\n"
#: Bytes of texts whose grams are sorted at once.
BATCH = 2_000_000
_END_KEY = xxhash.xxh3_64_intdigest(END)
_EXACT = np.r_[0.0, np.cumsum(np.log(np.arange(4096) + 0.5))]
_FACTORIAL = np.r_[0.0, np.cumsum(np.log(np.arange(4096) + 1.0))]


def _rising(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) - log Gamma(shift): from the table, or by Stirling's series."""
    x = n + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    base = 0.5 * np.log(np.pi) if shift == 0.5 else 0.0
    return np.where(n < len(table), table[np.minimum(n, len(table) - 1).astype(np.int64)], series - base)


def block_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any sequence with those counts."""
    return _rising(n0, _EXACT, 0.5) + _rising(n1, _EXACT, 0.5) - _rising(n0 + n1, _FACTORIAL, 1.0)


def _parent(child: np.ndarray, bit: int) -> np.ndarray:
    """The nodes one byte less deep."""
    return ((child >> U64(bit + 8)) << U64(bit)) | (child & U64((1 << bit) - 1))


class Tree:
    """Nodes of contexts of ``top`` to ``bottom`` bytes. A key is a context, nearest byte first, and a byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int, bottom: int):
        self.top, self.bottom, self.nodes = top, bottom, {}
        below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for depth in range(bottom, top - 1, -1):
            own = ((keys >> U64(8 * (bottom - depth + 1))) << U64(8)) | (keys & U64(255))
            rows, back = np.unique(own, return_inverse=True)
            n = np.bincount(back, counts, len(rows))
            for bit in range(8):
                node = rows >> U64(8 - bit)
                first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
                one = ((rows >> U64(7 - bit)) & U64(1)).astype(bool)
                n1 = np.add.reduceat(np.where(one, n, 0), first) if len(first) else n
                n0 = np.add.reduceat(np.where(one, 0, n), first) if len(first) else n
                node, own_log = node[first], block_log(n0, n1)
                weighted = own_log
                if depth < bottom:
                    child, child_log = below[bit]
                    deeper = np.bincount(np.searchsorted(node, _parent(child, bit)), child_log, len(node))
                    weighted = np.logaddexp(own_log, deeper) - np.log(2)
                self.nodes[depth, bit] = (node, n0, n1, np.exp(own_log - np.log(2) - weighted))
                below[bit] = (node, weighted)
        self.below = below

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """For the nodes above ``top``: bit and node in one number, sorted, and the sum of their children's
        log weights."""
        ids, logs = [np.empty(0, np.uint64)], [np.empty(0)]
        for bit, (child, child_log) in self.below.items():
            node, back = np.unique(_parent(child, bit), return_inverse=True)
            ids.append(node | U64(bit << 32))
            logs.append(np.bincount(back, child_log, len(node)))
        return np.concatenate(ids), np.concatenate(logs)

    def weighed(self, depth: int, ids: np.ndarray, deeper: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
        """This tree with the weights of nodes of a depth (numbered as in ``sums``, sorted) from the sums of their
        children's log weights; and such sums for the nodes above them."""
        out, up, logs = copy.copy(self), [np.empty(0, np.uint64)], [np.empty(0)]
        out.nodes = dict(self.nodes)
        for bit in range(8):
            node, n0, n1, weight = self.nodes[depth, bit]
            a, b = np.searchsorted(ids, np.array([bit << 32, (bit + 1) << 32], np.uint64))
            some = ids[a:b] & U64(0xFFFFFFFF)
            at, weight = np.searchsorted(node, some), weight.copy()
            own_log = block_log(n0[at], n1[at])
            both = np.logaddexp(own_log, deeper[a:b])
            weight[at] = np.exp(own_log - both)
            out.nodes[depth, bit] = (node, n0, n1, weight)
            if depth:
                above, back = np.unique(_parent(some, bit), return_inverse=True)
                up.append(above | U64(bit << 32))
                logs.append(np.bincount(back, both - np.log(2), len(above)))
        return out, np.concatenate(up), np.concatenate(logs)

    def mixed(self, keys: np.ndarray, bytes_deep: int, p: list[np.ndarray], known: list[np.ndarray], from_depth: int) -> None:
        """Mix the estimates of depths from_depth to ``top`` into p, the probabilities of each key's
        bits, where known tells whether a deeper context was seen. Keys hold bytes_deep of context."""
        for depth in range(from_depth, self.top - 1, -1):
            context, symbol = keys >> U64(8 * (bytes_deep - depth + 1)), keys & U64(255)
            for bit in range(8):
                node, n0, n1, weight = self.nodes[depth, bit]
                if not len(node):
                    continue
                want = (context << U64(bit)) | (symbol >> U64(8 - bit))
                at = np.minimum(np.searchsorted(node, want), len(node) - 1)
                seen = node[at] == want
                one = ((symbol >> U64(7 - bit)) & U64(1)).astype(bool)
                kt = (np.where(one, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
                w = np.where(known[bit], weight[at], 1.0)
                p[bit] = np.where(seen, w * kt + (1 - w) * p[bit], p[bit])
                known[bit] = known[bit] | seen


def code_lengths(deep: Tree, top: Tree, keys: np.ndarray) -> np.ndarray:
    """Bits for the byte of each key (of deep.bottom bytes of context) after its context."""
    p = [np.full(len(keys), 0.5) for _ in range(8)]
    known = [np.zeros(len(keys), bool) for _ in range(8)]
    deep.mixed(keys, deep.bottom, p, known, deep.bottom)
    top.mixed(keys, deep.bottom, p, known, deep.top - 1)
    return -sum(np.log2(x) for x in p)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Batches of (key of every byte, number of its text in the batch, first text)."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= BATCH):
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(END * depth + x for x in texts[first:last]), np.uint8)
        sizes = np.array([len(x) for x in texts[first:last]])
        wide = data.astype(np.uint64)
        key = wide[depth:].copy()
        for near in range(1, depth + 1):
            key |= wide[depth - near : len(wide) - near] << U64(8 * (depth - near + 1))
        own = np.ones(len(data), bool)
        starts = np.cumsum(sizes + depth) - sizes - depth
        own[(starts[:, None] + np.arange(depth)).ravel()] = False
        yield key[own[depth:]], np.repeat(np.arange(last - first), sizes), first
        first = last


def _spelt(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def _counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def _gram_counts(texts: list[bytes], train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for use in (True, False):
        for key, _, _ in grams([x for x, t in zip(texts, train, strict=True) if t == use], depth):
            keys, n = np.unique(key, return_counts=True)
            found.append((keys, n if use else np.zeros(len(n), np.int64)))
    return _counted(found)


def _word_counts(words: list[list[bytes]], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for use in (True, False):
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for x, t in zip(words, train, strict=True) if t == use for w in (*x, END)), np.uint64)
        keys, n = np.unique(hashes, return_counts=True)
        found.append((keys, n if use else np.zeros(len(n), np.int64)))
    return _counted(found)


def _by_subtree(keys: np.ndarray, buckets: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of grams by the task of their ``CUT`` nearest bytes, then key; and where tasks begin."""
    return _dealt(mix(keys >> U64(8 * (depth - CUT + 1))), buckets)


def _by_gram(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of grams by the bucket of the whole gram, then key; and where buckets begin."""
    return _dealt(mix(keys), buckets)


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (hashes % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def top_tree(train: DataFrame) -> Tree:
    """Depths 0 to 2 from the counts of (two bytes of context, byte) of the training texts."""

    def counts(batches):
        for batch in batches:
            texts = [_spelt(words_of(x)) for x in batch.column("text").to_pylist()]
            keys, n = _gram_counts(texts, np.ones(len(texts), bool), 2)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    found = train.select(F.col("text").cast("string")).mapInArrow(counts, "key long, n long")
    total = found.groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
    keys = total["key"].to_numpy().astype(np.uint64)
    return Tree(keys, total["n"].to_numpy(), 0, 2)


def _asked(chunks: DataFrame, buckets: int, depth: int) -> DataFrame:
    """(_bucket, _chunk, keys, counts): grams by their hash (_bucket below buckets), and words."""

    def one(table: pa.Table) -> pa.Table:
        train = table["train"].to_numpy()
        words = [words_of(x) for x in table["text"].to_pylist()]
        keys, n = _gram_counts([_spelt(x) for x in words], train, depth)
        order, at = _by_gram(keys, buckets)
        made = [(b, keys[order[at[b] : at[b + 1]]], n[order[at[b] : at[b + 1]]]) for b in range(buckets) if at[b] < at[b + 1]]
        keys, n = _word_counts(words, train)
        at = blocks(keys, buckets)
        made += [(buckets + b, keys[at[b] : at[b + 1]], n[at[b] : at[b + 1]]) for b in range(buckets) if at[b] < at[b + 1]]
        return pa.table(
            {
                "_bucket": pa.array([b for b, _, _ in made], pa.int32()),
                "_chunk": pa.array([table["_chunk"][0].as_py()] * len(made), pa.int32()),
                "keys": pa.array([k.tobytes() for _, k, _ in made], pa.binary()),
                "counts": pa.array([n.tobytes() for _, _, n in made], pa.binary()),
            }
        )

    return chunks.groupBy("_chunk").applyInArrow(one, "_bucket int, _chunk int, keys binary, counts binary")


def _read(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


def _split(values: np.ndarray, blobs: pa.ChunkedArray, width: int = 8) -> pa.Array:
    """The values of each blob's entries."""
    ends = np.cumsum([len(x) // width for x in blobs.to_pylist()])
    return pa.array([x.tobytes() for x in np.split(values, ends[:-1])], pa.binary())


def _merged(asked: DataFrame, buckets: int, depth: int) -> DataFrame:
    """(_sub, _bucket, keys, counts): every gram once, with its count over all chunks, by subtree task."""

    def one(table: pa.Table) -> pa.Table:
        bucket, made = table["_bucket"][0].as_py(), []
        if bucket < buckets:
            keys, n = _counted([(_read(table, "keys", np.uint64), _read(table, "counts", np.int64))])
            order, at = _by_subtree(keys, buckets, depth)
            made = [(b, keys[order[at[b] : at[b + 1]]], n[order[at[b] : at[b + 1]]]) for b in range(buckets) if at[b] < at[b + 1]]
        return pa.table(
            {
                "_sub": pa.array([b for b, _, _ in made], pa.int32()),
                "_bucket": pa.array([bucket] * len(made), pa.int32()),
                "keys": pa.array([k.tobytes() for _, k, _ in made], pa.binary()),
                "counts": pa.array([n.tobytes() for _, _, n in made], pa.binary()),
            }
        )

    return asked.groupBy("_bucket").applyInArrow(one, "_sub int, _bucket int, keys binary, counts binary")


def _subtrees(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, Tree]:
    """The grams of a subtree task, sorted, their order, and the tree of those that training has."""
    keys, n = _read(table, "keys", np.uint64), _read(table, "counts", np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    return keys, order, Tree(keys[n > 0], n[n > 0], CUT, depth)


def _weighed(merged: DataFrame, top, buckets: int, depth: int) -> DataFrame:
    """(_sub, _pair, nodes, logs): for the nodes of depth 2 that a subtree task has children of, the
    sum of the log weights of all their children; and to every subtree task, with a _pair below 0 for each bit, such
    sums for all nodes of depth 1."""
    schema = "_sub int, _pair int, nodes binary, logs binary"

    def up(table: pa.Table) -> pa.Table:
        ids, logs = _subtrees(table, depth)[2].sums()
        context = (ids & U64(0xFFFFFFFF)) >> (ids >> U64(32))
        order, at = _dealt(mix(context), buckets)
        full = np.flatnonzero(at[1:] > at[:-1])
        return pa.table(
            {
                "_pair": pa.array(full, pa.int32()),
                "_sub": pa.array(np.full(len(full), table["_sub"][0].as_py()), pa.int32()),
                "nodes": pa.array([ids[order[at[i] : at[i + 1]]].tobytes() for i in full], pa.binary()),
                "logs": pa.array([logs[order[at[i] : at[i + 1]]].tobytes() for i in full], pa.binary()),
            }
        )

    def total(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by([("_sub", "ascending")])
        ids, back = np.unique(_read(table, "nodes", np.uint64), return_inverse=True)
        return table, ids, back, np.bincount(back, _read(table, "logs", np.float64), len(ids))

    def pair(table: pa.Table) -> pa.Table:
        table, _, back, logs = total(table)
        return table.select(["_sub", "_pair", "nodes"]).append_column("logs", _split(logs[back], table["nodes"]))

    def above(table: pa.Table) -> pa.Table:
        _, ids, _, logs = total(table)
        _, ids, logs = top.value.weighed(2, ids, logs)
        return pa.table({"node": pa.array(ids.view(np.int64)), "log": pa.array(logs)})

    def as_row(table: pa.Table) -> pa.Table:
        blobs = {"nodes": table["node"].to_numpy().tobytes(), "logs": table["log"].to_numpy().tobytes()}
        return pa.table({"bit": table["bit"][:1], **{k: pa.array([x], pa.binary()) for k, x in blobs.items()}})

    sums = merged.groupBy("_sub").applyInArrow(up, "_pair int, _sub int, nodes binary, logs binary").groupBy("_pair")
    # sums of decimals don't depend on the order of their terms
    ones = sums.applyInArrow(above, "node long, log double").groupBy("node").agg(F.sum(F.col("log").cast("decimal(38,9)")).cast("double").alias("log"))
    ones = ones.withColumn("bit", F.shiftright("node", 32).cast("int"))
    # eight rows with 256 x 255 nodes at most in all
    rows = ones.groupBy("bit").applyInArrow(as_row, "bit int, nodes binary, logs binary")
    wanted = merged.sparkSession.range(8 * buckets).select(F.expr("cast(id div 8 as int)").alias("_sub"), F.expr("cast(id % 8 as int)").alias("bit"))
    told = wanted.join(F.broadcast(rows), "bit").select("_sub", (-1 - F.col("bit")).alias("_pair"), "nodes", "logs")
    return sums.applyInArrow(pair, schema).unionByName(told)


def _answered(asked: DataFrame, top, buckets: int, depth: int) -> DataFrame:
    """(_chunk, _bucket, said, distinct): for every key the bits of a gram in 4 bytes or the count of a
    word in 8; the number of distinct training words, told to one chunk of each task."""

    def weights_of(got: pa.Table) -> Tree:
        def sums(some: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            ids, logs = _read(some, "nodes", np.uint64), _read(some, "logs", np.float64)
            order = np.argsort(ids)
            return ids[order], logs[order]

        is_one = got["_pair"].to_numpy() < 0
        tree, _, _ = top.value.weighed(2, *sums(got.filter(pa.array(~is_one))))
        tree, ids, logs = tree.weighed(1, *sums(got.filter(pa.array(is_one))))
        return tree.weighed(0, ids, logs)[0]

    def down(table: pa.Table, got: pa.Table) -> pa.Table:
        table = table.sort_by([("_bucket", "ascending")])
        keys, order, tree = _subtrees(table, depth)
        bits = np.empty(len(keys), np.float32)
        bits[order] = code_lengths(tree, weights_of(got), keys)
        return pa.table({"_bucket": table["_bucket"], "_sub": table["_sub"], "bits": _split(bits, table["keys"])})

    def one(table: pa.Table, got: pa.Table) -> pa.Table:
        table = table.sort_by([("_chunk", "ascending")])
        every, back = np.unique(_read(table, "keys", np.uint64), return_inverse=True)
        distinct = 0
        if table["_bucket"][0].as_py() < buckets:
            said = np.empty(len(every), np.float32)
            said[_by_subtree(every, buckets, depth)[0]] = _read(got.sort_by([("_sub", "ascending")]), "bits", np.float32)
        else:
            said = np.bincount(back, _read(table, "counts", np.int64), len(every)).astype(np.int64)
            distinct = int((said > 0).sum())
        return pa.table(
            {
                "_chunk": table["_chunk"], "_bucket": table["_bucket"],
                "said": _split(said[back], table["keys"]),
                "distinct": pa.array([distinct] + [0] * (len(table) - 1), pa.int64()),
            }
        )

    merged = _merged(asked, buckets, depth)
    weighed = _weighed(merged, top, buckets, depth)
    bits = merged.groupBy("_sub").cogroup(weighed.groupBy("_sub")).applyInArrow(down, "_bucket int, _sub int, bits binary")
    return asked.groupBy("_bucket").cogroup(bits.groupBy("_bucket")).applyInArrow(one, "_chunk int, _bucket int, said binary, distinct long")


class Lookup:
    """Places of keys in an array of distinct ones, by hashing: a table of at least four cells a key."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.size = keys, 1 << max(4, int(4 * len(keys)).bit_length())
        self.cell = np.full(self.size, -1, np.int32)
        rest, step = np.arange(len(keys), dtype=np.int32), 0
        while len(rest):
            at = self._at(keys[rest], step)
            free = self.cell[at] < 0
            self.cell[at[free]] = rest[free]
            rest, step = rest[self.cell[at] != rest], step + 1

    def _at(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (mix(keys + U64(step)) & U64(self.size - 1)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = self.cell[self._at(keys, 0)]
        rest = np.flatnonzero(self.keys[out] != keys)
        step = 1
        while len(rest):
            found = self.cell[self._at(keys[rest], step)]
            out[rest] = found
            rest, step = rest[self.keys[found] != keys[rest]], step + 1
        return out


def trained_on() -> Column:
    return crc_of_id() % FOLDS != HELD_FOLD


def scored(df: DataFrame, depth: int = DEPTH, chunk_bytes: int | None = None, train: Column | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10; score is
    that of the normal form, whose white space is single spaces), n_bytes of the normal form and bits_per_byte. Runs
    jobs when called: the counts of two bytes of context, and the scores, which are stored."""
    train = trained_on() if train is None else train
    top = df.sparkSession.sparkContext.broadcast(top_tree(df.where(train)))
    chunks, n = chunked(df, [train.alias("train")], **({"chunk_bytes": chunk_bytes} if chunk_bytes else {}))
    buckets = max(4, n)

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        table, got = in_order(table), got.sort_by([("_bucket", "ascending")])
        learned = table["train"].to_numpy()
        words = [words_of(x) for x in table["text"].to_pylist()]
        spelt = [_spelt(x) for x in words]
        bucket, said = got["_bucket"].to_numpy(), got["said"].to_pylist()
        split = int(np.searchsorted(bucket, buckets))
        lengths = np.frombuffer(b"".join(said[:split]), np.float32).astype(np.float64)
        counts = np.frombuffer(b"".join(said[split:]), np.int64).astype(np.float64)
        keys, _ = _gram_counts(spelt, learned, depth)
        order, _ = _by_gram(keys, buckets)
        places, bits = Lookup(keys[order]), np.zeros(len(spelt))
        for key, which, first in grams(spelt, depth):
            bits[first : first + which[-1] + 1] += np.bincount(which, lengths[places.of(key)], which[-1] + 1)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in words for w in (*x, END)), np.uint64)
        sizes = np.array([len(x) + 1 for x in words])
        count = counts[Lookup(np.unique(hashes)).of(hashes)]
        which = np.repeat(np.arange(len(words)), sizes)
        known = np.bincount(which, count > 0, len(words)).astype(np.int64)
        logs = np.bincount(which, np.log10(count + 1), len(words))
        n_bytes = np.array([len(x) for x in spelt], np.int64)
        distinct = np.zeros(len(words), np.int64)
        distinct[0] = got["distinct"].to_numpy().sum()
        return pa.table(
            {
                "doc_id": table["doc_id"], "train": table["train"], "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(known),
                "count_logs": pa.array(logs), "bits": pa.array(bits), "n_bytes": pa.array(n_bytes), "distinct": pa.array(distinct),
            }
        )

    answers = _answered(_asked(chunks, buckets, depth), top, buckets, depth)
    schema = "doc_id long, train boolean, n_tokens long, n_known long, count_logs double, bits double, n_bytes long, distinct long"
    made = chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(finish, schema)
    stored, _ = settle(made)
    total = stored.agg(F.coalesce(F.sum(F.when(F.col("train"), F.col("n_tokens"))), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    smooth = F.log10(F.lit(float(total["n"] + total["v"] + 1)))
    return stored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("count_logs") - F.col("n_tokens") * smooth).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
        "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
