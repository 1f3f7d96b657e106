"""Near-duplicate groups by ProbMinHash signatures, banding and verification.

Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased make shingles of five words
(a shorter text is one shingle); a text's distinct shingles weigh 1 each. Every
shingle is a Poisson process whose rate is its weight; an arrival falls on a
random component of the signature, which keeps its earliest arrival. A shingle
stops as soon as its next arrival is later than the signature's latest component.
Equal components estimate the probability Jaccard similarity, which on equal
weights is the Jaccard similarity of the shingle sets, the one that is verified.

Bands of components give buckets. Verification computes the Jaccard similarity
of the whole shingle sets; a link is 0.8 or more, and classes are the connected
components of links. Texts are compared, not rows: equal texts are one node
from the first shuffle on, counted per map task before it.

1. Every text in a bucket links to the bucket's most popular text (the one
   that meets most others over all its bands: of a group of edited copies, the
   original). One test per text.
2. Components; in buckets that still hold several, texts outside the largest
   are compared with all of other components, first by signature and set size,
   then by their sets, and one link for each two components becomes a row; then
   components again. Pairs inside a component are never formed. A bucket is a
   grid of cells, each of which holds a bounded number of texts against a
   bounded number of others, so a large bucket is many tasks.

Joins on keys that a large group shares (bucket, component) leave the rows of hot
keys, which are counted, where they are; other joins read both sides from
shuffles, where adaptive execution splits skewed keys.

Defined results: null, empty and word-less texts each are one text without
shingles: equal ones are copies, and nothing else is like them. Repeated rows
are copies. A class is named by its least doc_id (null if it has none).
Nodes are 64-bit text digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.textkit import FOLDED_VALUES, NON_SPACE, TASK_TEXTS, U64, Block, Powers, blocks, cut, gathered, mix, row_of, runs_of, small_batches, unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
COMPONENTS = BANDS * ROWS
#: A pair of step 2 needs so many equal components: of a pair at 0.8, expected to have 76.8, fewer are equal with probability 4e-7, which is less than that of sharing no band (3e-6).
LEAST_EQUAL = 56
#: Keys of so many rows or more are dealt apart, and how many there are at most.
HOT, MOST_HOT = 500, 2_000
#: Texts that one cell of a bucket holds, and texts that it holds them against.
HELD, SALTED = 1_000, 1_000


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles, repeats included, and each row's first."""
    starts, ends, firsts = block.words(NON_SPACE)
    words = block.span_hash(block.prefix(FOLDED_VALUES), starts, ends)
    n = np.diff(firsts)
    runs, at = runs_of(words, firsts, SHINGLE)
    row = row_of(firsts)[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.zeros(len(short), dtype=U64)
        for k in range(SHINGLE - 1):
            more = n[short] > k
            whole[more] = mix(whole[more] * U64(3) + words[firsts[short[more]] + k])
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        runs, row = np.concatenate([runs, whole])[order], np.concatenate([row, short])[order]
    return runs, np.searchsorted(row, np.arange(block.rows + 1))


def distinct(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct hashes in order, how often each occurs, and each row's first."""
    row = row_of(firsts)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(row[at], np.arange(len(firsts)))


def exponential(keys: np.ndarray) -> np.ndarray:
    return -np.log(((mix(keys) >> U64(11)).astype(float) + 0.5) / 2.0**53)


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Signatures (a row each): of every component the shingle that arrives first, 0 for a row without shingles."""
    rows = len(firsts) - 1
    row = row_of(firsts)
    earliest = np.full(rows * COMPONENTS, np.inf)
    signature = np.zeros(rows * COMPONENTS, dtype=U64)
    time, at, latest = np.zeros(len(hashes)), np.arange(len(hashes)), np.zeros(rows)
    arrival = 0
    while len(at):
        arrival += 1
        key = hashes[at] + U64(arrival * 0x9E3779B97F4A7C15 % (1 << 64))
        time = time + exponential(key) / weights[at]
        component = (mix(key ^ U64(0x5851F42D4C957F2D)) >> U64(40)).astype(np.int64) % COMPONENTS
        slot = row[at] * COMPONENTS + component
        np.minimum.at(earliest, slot, time)
        first = time == earliest[slot]
        signature[slot[first]] = hashes[at[first]]
        live = np.unique(row[at])
        latest[live] = earliest.reshape(rows, COMPONENTS)[live].max(axis=1)
        going = time < latest[row[at]]
        at, time = at[going], time[going]
    return signature.reshape(rows, COMPONENTS)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.zeros((len(signature), BANDS), dtype=U64)
    for k in range(ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + signature[:, k::ROWS])
    return mix(out + np.arange(BANDS, dtype=U64)[None, :])


def packed(values: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """A binary value per row from the values of all rows."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(firsts) - 1, [None, pa.py_buffer((firsts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


SKETCH_SCHEMA = "node long, doc_id long, n_shingles int, bands array<long>, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    """One row per (node, doc_id, text) with the signature's bands and its components' low 16 bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo, hi, block in blocks(batch.column(2), powers):
                hashes, _, firsts = distinct(*shingles(block))
                signature = prob_minhash(hashes, np.ones(len(hashes)), firsts)
                some = np.diff(firsts) > 0
                bands = band_hashes(signature).view(np.int64)
                width = np.where(some, BANDS, 0)
                offs = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
                low = (signature & U64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(np.diff(firsts).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offs), pa.array(bands[some].ravel())),
                        packed(low.ravel(), np.arange(len(low) + 1) * COMPONENTS),
                    ],
                    names=["node", "doc_id", "n_shingles", "bands", "sketch"],
                )

    return small_batches(docs.select("node", "doc_id", "text")).mapInArrow(scan, SKETCH_SCHEMA)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Node and its distinct shingles, four bytes each, in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo, hi, block in blocks(batch.column(1), powers):
                hashes, firsts = shingles(block)
                small, _, firsts = distinct(hashes >> U64(32), firsts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed(small.astype(np.uint32), firsts)], names=["node", "shingles"])

    return small_batches(docs.select("node", "text")).mapInArrow(scan, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), dtype=np.uint32) for s in (sa, sb))
                if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)) and len(x):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = common >= SIMILARITY * (len(both) - common) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    return small_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")).mapInArrow(test, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes with links: least node of the connected component, by label propagation with pointer jumping."""
    n = 2 * links.count()
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), n)
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        told = labels.join(heard, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("tl"))
        new = cut(told.join(target, F.col("label") == F.col("t")).select("node", "old", F.least("label", "tl").alias("label")), n)
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def cells(labelled: DataFrame, mixed: DataFrame, hot: list[int]) -> DataFrame:
    """Rows (bucket, i, j, held, label, node) of buckets with several components, from (bucket, node, label) and (bucket, major, groups, salts).

    A text outside its bucket's largest component is held in group i, and any
    text lies in salt j: each cell (i, j) compares its held texts with its
    others, so every pair meets in some cell, and none has more than HELD texts
    to hold and SALTED to hold them against (give or take the hash).
    """
    rest = by_key(labelled, mixed, "bucket", hot)
    numbers = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most) - 1))
    rows = rest.select("bucket", numbers("groups").alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("salts")).alias("j"), F.lit(False).alias("held"), "label", "node")
    held = rest.where("label <> major").select("bucket", F.pmod(F.xxhash64("node", F.lit(2)), F.col("groups")).alias("i"), numbers("salts").alias("j"), F.lit(True).alias("held"), "label", "node")
    return rows.unionByName(held)


def cross_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between components of one bucket, one for each two components of a cell that have any.

    Rows are (bucket, i, j, held, label, node, sketch, bands, shingles): a cell's
    held texts come first, and all others are compared with them. Texts that meet
    in several buckets are compared in the first only; sketches and set sizes sort
    out most pairs, and what is left is verified here, so no pair becomes a row
    unless it is a link.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, joined = None, [], {}
        for batch in batches:
            cell = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edges = np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                if current != (own := tuple(cell[:, lo].tolist())):
                    current, held, joined = own, [], {}
                part = batch.slice(lo, hi - lo)
                first = part.filter(part.column(3))
                held += Members(first, own[0]).each()
                if first.num_rows < part.num_rows:
                    others = Members(part.slice(first.num_rows), own[0])
                    found = [link for u in held for link in others.links(u, joined)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    dealt = rows.select("bucket", "i", "j", "held", "label", "node", "sketch", "bands", "shingles").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("held"))
    return small_batches(dealt).mapInArrow(scan, "a long, b long").distinct()


class Members:
    """Some rows of one bucket, as arrays."""

    def __init__(self, rows: pa.RecordBatch, bucket: int) -> None:
        self.label, self.node = rows.column(4).to_pylist(), rows.column(5).to_pylist()
        self.sketch = np.frombuffer(b"".join(rows.column(6).to_pylist()), dtype=np.uint16).reshape(-1, COMPONENTS)
        self.bands = np.array(rows.column(7).to_pylist(), dtype=np.int64).reshape(-1, BANDS)
        self.band = np.argmax(self.bands == bucket, axis=1)
        sets = rows.column(8).to_pylist()
        self.size = np.array([len(x) // 4 for x in sets], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.shingles = np.frombuffer(b"".join(sets), dtype=np.uint32)

    def each(self) -> list[tuple]:
        return [(self.label[i], self.node[i], self.sketch[i], self.bands[i], self.shingles[self.first[i] : self.first[i + 1]].copy()) for i in range(len(self.node))]

    def links(self, held: tuple, joined: dict[int, int]) -> Iterator[tuple[int, int]]:
        """Links of one held text to texts here, one for each component not joined to its own yet."""

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        label, node, sketch, bands, own = held
        near = (self.sketch == sketch).sum(axis=1) >= LEAST_EQUAL
        near &= np.minimum(self.size, len(own)) >= SIMILARITY * np.maximum(self.size, len(own)) - 1e-9
        near &= np.argmax(self.bands == bands, axis=1) == self.band
        at = [i for i in np.flatnonzero(near).tolist() if root(self.label[i]) != root(label)]
        if not at:
            return
        spans = [self.shingles[self.first[i] : self.first[i + 1]] for i in at]
        every = np.concatenate(spans)
        place = np.minimum(np.searchsorted(own, every), len(own) - 1)
        common = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum([0, *(len(x) for x in spans[:-1])]))
        for i, both in zip(at, common.tolist(), strict=True):
            a, b = root(label), root(self.label[i])
            if a != b and both >= SIMILARITY * (len(own) + int(self.size[i]) - both) - 1e-9:
                joined[a] = b
                yield min(node, self.node[i]), max(node, self.node[i])


def hot_from(n: int) -> int:
    """Rows from which a key is dealt apart: so many that there are MOST_HOT such keys at most, or HOT."""
    return max(HOT, n * BANDS // MOST_HOT)


def by_key(left: DataFrame, right: DataFrame, key: str, hot: list[int]) -> DataFrame:
    """The join of left with right, a row a key; rows of hot keys, of which there are MOST_HOT at most, stay where they are and meet theirs by broadcast."""
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key))


def nodes_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, label, doc_id, class_id, class_rows, class_texts) per distinct text: its digest, component, least id and class."""
    named, n = nodes_of(docs, id_col, text_col), docs.count()
    texts = cut(
        sketches(named)
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        n,
        TASK_TEXTS,
    )
    entries = texts.select("node", F.explode("bands").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    hot = [r["bucket"] for r in full.where(F.col("many") > hot_from(n)).collect()]
    members = cut(by_key(entries, full, "bucket", hot), n * BANDS)
    popular = members.groupBy("node").agg(F.sum("many").alias("popularity"))
    ranked = members.join(popular, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("popularity", "node")).alias("rank"))
    led = by_key(ranked, leaders, "bucket", hot).groupBy("node").agg(F.max("rank").alias("rank")).select(F.col("node").alias("a"), F.col("rank.node").alias("b")).where("a <> b")
    # Copies go before the shuffle, and what they leave meets the members without another one.
    one_each = named.dropDuplicates(["node"]).join(popular.select("node"), "node", "left_semi")
    sets = cut(shingle_sets(one_each), n, TASK_TEXTS)
    links = cut(verified(led, sets), n)
    labels = components(links)
    labelled = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sized = labelled.groupBy("bucket", "label").agg(F.count("*").alias("many"))
    of = F.struct("many", "label")
    mixed = sized.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("many").alias("all"), F.max(of).alias("major")).where("labels > 1")
    mixed = mixed.select("bucket", F.col("major.label").alias("major"), F.ceil((F.col("all") - F.col("major.many")) / HELD).alias("groups"), F.ceil(F.col("all") / SALTED).alias("salts"))
    rest = cells(labelled, mixed, hot).join(texts.select("node", "bands", "sketch"), "node").join(sets, "node")
    more = cut(cross_links(rest), n)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    joined = texts.select("node", "doc_id", "n_rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = joined.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n_rows").alias("class_rows"), F.count("*").alias("class_texts"))
    wide = [r["label"] for r in classes.where(F.col("class_texts") > hot_from(n)).collect()]
    return by_key(joined, classes, "label", wide).select("node", "label", "doc_id", "class_id", "class_rows", "class_texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its class, named by the class's least id, and the class's rows and distinct texts."""
    classes = text_classes(docs, id_col, text_col).select("node", "class_id", "class_rows", "class_texts")
    rows = nodes_of(docs, id_col, text_col).select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "class_rows", "class_texts")
    return gathered(rows, docs.count())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that of the least id, with all its columns; of rows that share this id and text, one."""
    kept = text_classes(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "doc_id").agg(F.min("node").alias("_node"))
    own_text, own_key, text, key = unused(docs.columns, "_text", "_key", "_text2", "_key2")
    keys = {own_text: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), own_key: F.col(id_col).cast("long")}
    same = (F.col(own_text) == F.col(text)) & F.col(own_key).eqNullSafe(F.col(key))
    one = docs.withColumns(keys).join(kept.select(F.col("_node").alias(text), F.col("doc_id").alias(key)), same).dropDuplicates([own_text, own_key])
    return gathered(one.select(*docs.columns), docs.count(), TASK_TEXTS)
