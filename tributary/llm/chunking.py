"""Substring dedup by content-defined chunking.

A gear hash rolls over a document's words (``[^\\x20\\x09-\\x0D]+``): it doubles
and adds a random value of the next word. A boundary follows a word where two
bits of it are zero, which the last ``ROLLED`` words decide, so after an
insertion the boundaries fall on the same words again. From every boundary a
chunk runs to the first boundary that is ``MIN_WORDS`` words on or more (the last one also to the text's end). Chunks
so vary in length, overlap, and each, known by a 64-bit digest of its words, is
a passage of its own: no chunk is so short that unrelated texts share it.

Of all documents that hold a digest, the one of least key keeps it, and a
document itself keeps the first of equal chunks. A chunk that others keep is
cut out, but only where the keeper's own chunk stays whole: a keeper that loses
words of it to a third document makes nobody lose it. So every word cut lies in
a chunk that stands, word for word, in the output. Of a repeated passage of over
50 words all goes but the few words before its first boundary and after its last;
repeats of fewer than ``MIN_WORDS`` words stay.

Distribution: a task gathers a million chunks at a time and sends each digest
once, with its least document, packed by digest range into binary columns (no
row per chunk); what the task's other documents lose is known already and goes
straight to them. A range's task sorts its digests and answers documents, packed
by bundles of documents. A bundle finds which of its kept chunks are damaged and
asks, once for each digest, whether what it loses is kept whole; damaged digests
and questions meet by range. A digest that a third of all documents share is one
entry per task and per bundle. Texts meet their cuts in one shuffle.

Defined results: null and empty texts and those of fewer than ``MIN_WORDS`` words
have no chunk and stay as they are; rows that share id and text are one document,
none of which loses to another; equal keys of different documents (64 bits) count
as one document; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.textkit import BYTE_VALUES, NON_SPACE, TASK_BYTES, U64, Block, Powers, blocks, cut, gathered, mix, row_of, small_batches, unused

#: Words that decide whether a boundary follows them, and the bits that they decide.
ROLLED = 4
BOUNDARY = U64(0b11 << (ROLLED - 2))
#: Words without a boundary after which there is one all the same; only words that repeat without a break get so far.
MOST_GAP = 32
#: Words of the shortest chunk.
MIN_WORDS = 20
#: Text whose digests go to one range, and text whose documents make one bundle.
RANGE_BYTES = 8 << 20
#: Chunks that a task gathers before it sends them on.
HELD_CHUNKS = 1_000_000
GEAR = U64(0xC2B2AE3D27D4EB4F)

#: A chunk in a document: digest, document's key, first word, number of words, and what becomes of it.
ENTRY = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("begin", "<u4"), ("words", "u1"), ("state", "u1")])
#: KEEPS: others lose it to this document. LOSES: another document keeps it. FIRST and AGAIN: of equal chunks in one document the first, and one that begins after the first's end.
KEEPS, LOSES, FIRST, AGAIN = range(4)


def boundaries(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Words at which a chunk may begin or end, in order; each row's first word and end are among them."""
    n = len(words)
    gear = mix(words ^ GEAR)
    place = np.arange(n) - np.repeat(firsts[:-1], np.diff(firsts))
    rolled = gear.copy()
    for k in range(1, ROLLED):
        inside = np.flatnonzero(place >= k)
        rolled[inside] += gear[inside - k] << U64(k)
    found = np.unique(np.concatenate([firsts, np.flatnonzero((rolled & BOUNDARY == 0) & (place >= ROLLED - 1)) + 1]))
    wide = np.flatnonzero(np.diff(found) > MOST_GAP)
    if len(wide):
        found = np.sort(np.concatenate([found, *(np.arange(found[k] + MOST_GAP, found[k + 1], MOST_GAP) for k in wide.tolist())]))
    return found


class Chunks:
    """Chunks of a block's rows: first word, end word, row and digest of each."""

    def __init__(self, block: Block) -> None:
        self.starts, self.ends, self.firsts = block.words(NON_SPACE)
        words = block.span_hash(block.prefix(BYTE_VALUES), self.starts, self.ends)
        n = len(words)
        bounds = boundaries(words, self.firsts)
        begin = bounds[bounds < n]
        row = row_of(self.firsts)[begin] if n else np.zeros(0, np.int64)
        fits = begin + MIN_WORDS <= self.firsts[row + 1]
        begin, row = begin[fits], row[fits]
        stop = bounds[np.searchsorted(bounds, begin + MIN_WORDS)]
        # A row's last chunk once more, up to the row's end, so that copies lose their last words too.
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, np.int64)
        last = last[stop[last] < self.firsts[row[last] + 1]]
        self.begin, self.row = np.append(begin, begin[last]), np.append(row, row[last])
        self.stop = np.append(stop, self.firsts[row[last] + 1])
        # Digest: a polynomial of the words' hashes, which is the same wherever the chunk lies.
        block.powers.grow(n + 1)
        running = np.zeros(n + 1, dtype=U64)
        np.cumsum(words * block.powers.up[:n], out=running[1:])
        self.digest = mix((running[self.stop] - running[self.begin]) * block.powers.down[self.begin] + (self.stop - self.begin).astype(U64) * GEAR)

    def entries(self, docs: np.ndarray) -> np.ndarray:
        """An ENTRY of every chunk, from the key of each row's document."""
        out = np.zeros(len(self.digest), dtype=ENTRY)
        out["digest"], out["doc"] = self.digest, docs[self.row]
        out["begin"], out["words"] = self.begin - self.firsts[self.row], self.stop - self.begin
        return out


def document_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of runs in which all keys are equal."""
    n = len(keys[0])
    fresh = np.zeros(max(0, n - 1), dtype=bool)
    for k in keys:
        fresh |= k[1:] != k[:-1]
    first = np.flatnonzero(np.append(True, fresh)) if n else np.zeros(0, np.int64)
    return first, np.append(first[1:], n).astype(np.int64)


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive values as binaries, from bound to bound."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.dtype.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def range_of(digest: np.ndarray, parts: int) -> np.ndarray:
    """Ranges in order of digests."""
    return ((digest >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def bundle_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(U64)) % U64(parts)).astype(np.int32)


def dealt(to: np.ndarray, values: np.ndarray, **more: int) -> Iterator[pa.RecordBatch]:
    """A row (part, ..., held) for each part with the values that go there; more columns hold a number each."""
    if len(values):
        order = np.argsort(to, kind="stable")
        to, values = to[order], values[order]
        first, _ = groups(to)
        columns = [pa.array(np.full(len(first), v, dtype=np.int32)) for v in more.values()]
        yield pa.RecordBatch.from_arrays([pa.array(to[first]), *columns, binary(values, np.append(first, len(to)))], names=["part", *more, "held"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each row by itself, with its first column."""
    for batch in batches:
        for row, key in enumerate(batch.column(0).to_pylist()):
            yield key, batch.slice(row, 1)


def requests(parts: int) -> Callable:
    """From (key, text) rows (part, kind, held). Kind 0, to a digest's range: each digest once, with its least document (state 1 if others here hold it). Kind 1, to a document's bundle: what is known of its chunks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, many = Powers(), [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, block in blocks(batch.column(1), powers):
                c = Chunks(block)
                own = c.entries(keys[lo:hi])
                order = np.lexsort((c.begin, own["digest"], c.row))
                own, row = own[order], c.row[order]
                first, end = groups(own["digest"], row)
                heads = own[first]
                again = own["begin"] >= np.repeat(heads["begin"] + heads["words"], end - first)
                own["state"] = AGAIN
                repeated = np.zeros(len(first), dtype=bool)
                repeated[np.searchsorted(first, np.flatnonzero(again), side="right") - 1] = True
                firsts = heads[repeated]
                firsts["state"] = FIRST
                known = np.concatenate([own[again], firsts])
                yield from dealt(bundle_of(known["doc"], parts), known, kind=1)
                held.append(heads)
                many += len(heads)
                if many >= HELD_CHUNKS:
                    yield from least_first(np.concatenate(held))
                    held, many = [], 0
        if held:
            yield from least_first(np.concatenate(held))

    def least_first(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        own, first, end, others = by_digest(own)
        lost = own[others]
        lost["state"] = LOSES
        yield from dealt(bundle_of(lost["doc"], parts), lost, kind=1)
        heads = own[first]
        heads["state"] = np.add.reduceat(others, first) > 0 if len(first) else 0
        yield from dealt(range_of(heads["digest"], parts), heads, kind=0)

    return scan


def by_digest(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries sorted by digest and document, first and end of each digest's, and which are of other documents than its least."""
    own = own[np.lexsort((own["doc"], own["digest"]))]
    first, end = groups(own["digest"])
    return own, first, end, own["doc"] != np.repeat(own["doc"][first], end - first)


def answers(parts: int) -> Callable:
    """From rows (part, kind, held) in order of parts rows (part, held) for bundles: of a range's digests that several documents hold, the least keeps, the others lose."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            own, first, end, others = by_digest(np.concatenate(held))
            shared = np.repeat(np.add.reduceat(others | (own["state"] == 1), first) > 0, end - first)
            own["state"] = np.where(others, LOSES, KEEPS)
            head = np.zeros(len(own), dtype=bool)
            head[first] = True
            own = own[shared & (others | head)]
            yield from dealt(bundle_of(own["doc"], parts), own)

        for part, row in runs(batches):
            if row.column(1)[0].as_py() == 1:
                yield row.select([0, 2])
                continue
            if part != current and held:
                yield from closed()
                held = []
            current = part
            held.append(np.frombuffer(row.column(2)[0].as_buffer(), dtype=ENTRY))
        if held:
            yield from closed()

    return scan


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (part, held) for each bundle from rows in order of bundles, in order of documents and words."""
    current, held = None, []

    def closed() -> Iterator[pa.RecordBatch]:
        own = np.concatenate(held)
        order = ("state", "digest", "begin", "doc")
        own = own[np.lexsort([own[k] for k in order])]
        own = own[groups(*(own[k] for k in order))[0]]
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), binary(own, np.array([0, len(own)]))], names=["part", "held"])

    for part, row in runs(batches):
        if part != current and held:
            yield from closed()
            held = []
        current = part
        held.append(np.frombuffer(row.column(1)[0].as_buffer(), dtype=ENTRY))
    if held:
        yield from closed()


def whole(own: np.ndarray) -> np.ndarray:
    """Which chunks of a bundle no chunk that may be cut touches."""
    first, end = groups(own["doc"])
    stop = own["begin"].astype(np.int64) + own["words"]
    length = np.maximum.reduceat(stop, first) if len(first) else stop
    offset = np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]) if len(first) else length, end - first)
    begin, stop = own["begin"] + offset, stop + offset
    gone = (own["state"] == LOSES) | (own["state"] == AGAIN)
    change = np.zeros(int(length.sum()) + 1, dtype=np.int64)
    np.add.at(change, begin[gone], 1)
    np.add.at(change, stop[gone], -1)
    touched = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
    return touched[stop] == touched[begin]


def questions(parts: int) -> Callable:
    """From bundles rows (part, kind, bundle, held) for ranges of digests. Kind 0: digests whose keeper has lost some of the chunk; kind 1: digests that the bundle loses, once each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, row in runs(batches):
            own = np.frombuffer(row.column(1)[0].as_buffer(), dtype=ENTRY)
            damaged = np.unique(own["digest"][(own["state"] == KEEPS) & ~whole(own)])
            yield from dealt(range_of(damaged, parts), damaged, kind=0, bundle=bundle)
            lost = np.unique(own["digest"][own["state"] == LOSES])
            yield from dealt(range_of(lost, parts), lost, kind=1, bundle=bundle)

    return scan


def replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of range and kind (bundle, held): digests that the bundle loses and that no document keeps whole."""
    current, damaged = None, np.zeros(0, dtype=U64)
    for part, row in runs(batches):
        if part != current:
            current, damaged = part, np.zeros(0, dtype=U64)
        held = np.frombuffer(row.column(3)[0].as_buffer(), dtype=U64)
        if row.column(1)[0].as_py() == 0:
            damaged = np.union1d(damaged, held)
        elif len(both := held[np.isin(held, damaged)]):
            yield pa.RecordBatch.from_arrays([row.column(2), binary(both, np.array([0, len(both)]))], names=["bundle", "held"])


def decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cuts) from (part, held, damaged): word ranges of each document to cut, as pairs of numbers."""
    for batch in batches:
        for held, damaged in zip(batch.column(1), batch.column(2), strict=True):
            own = np.frombuffer(held.as_buffer(), dtype=ENTRY)
            damaged = np.frombuffer(damaged.as_buffer(), dtype=U64) if damaged.is_valid else np.zeros(0, U64)
            sound = whole(own)
            same = mix(own["digest"] ^ mix(own["doc"].view(U64)))
            lost, again = own["state"] == LOSES, own["state"] == AGAIN
            elsewhere = np.isin(same, same[lost])
            kept_here = np.isin(same, same[(own["state"] == FIRST) & sound])
            gone = (lost | again & elsewhere) & ~np.isin(own["digest"], damaged) | again & ~elsewhere & kept_here
            own = own[gone]
            if not len(own):
                continue
            # Ranges that overlap or touch become one; entries are in order of documents and words.
            stop = own["begin"].astype(np.int64) + own["words"]
            first, end = groups(own["doc"])
            offset = np.repeat(np.arange(len(first)), end - first) << 33
            reach = np.maximum.accumulate(stop + offset)
            fresh = np.flatnonzero(np.append(True, own["begin"][1:] + offset[1:] > reach[:-1]))
            last = np.append(fresh[1:], len(own)) - 1
            pairs = np.stack([own["begin"][fresh], (reach - offset)[last]], axis=1).astype(np.uint32)
            docs = own["doc"][fresh]
            begin, _ = groups(docs)
            yield pa.RecordBatch.from_arrays([pa.array(docs[begin]), binary(pairs.ravel(), 2 * np.append(begin, len(docs)))], names=["key", "cuts"])


def cut_words(docs: DataFrame, held: int) -> DataFrame:
    """(key, cuts): the word ranges that each document loses, from (key, text) with so many bytes of text."""
    parts = max(8, -(-held // RANGE_BYTES))
    in_order = lambda df, by, *then: small_batches(df.repartition(by).sortWithinPartitions(by, *then))
    asked = small_batches(docs.select("key", "text")).mapInArrow(requests(parts), "part int, kind int, held binary")
    told = in_order(asked, "part").mapInArrow(answers(parts), "part int, held binary")
    bundles = cut(in_order(told, "part").mapInArrow(assembled, "part int, held binary"))
    asked = small_batches(bundles).mapInArrow(questions(parts), "part int, kind int, bundle int, held binary")
    damaged = in_order(asked, "part", "kind").mapInArrow(replies, "bundle int, held binary").groupBy("bundle").agg(F.listagg("held").alias("damaged"))
    met = bundles.join(damaged, F.col("part") == F.col("bundle"), "left").select("part", "held", "damaged")
    return small_batches(met).mapInArrow(decisions, "key long, cuts binary")


def without(block: Block, starts: np.ndarray, ends: np.ndarray, row: int, cuts: np.ndarray) -> str:
    """A row's text without the given words of the block; what stays is joined by a line break where one was cut, else by a space."""
    at, parts = int(block.offs[row]), []
    for b, e in cuts.tolist():
        parts.append(block.text(at, int(starts[b])))
        at = int(ends[e - 1])
    parts.append(block.text(at, int(block.offs[row + 1])))
    out = parts[0]
    for x in parts[1:]:
        gap = "\n" if out.endswith("\n") or x.startswith("\n") else " "
        left, right = out.rstrip(" \t\n\x0b\x0c\r"), x.lstrip(" \t\n\x0b\x0c\r")
        out = left + gap + right if left and right else left or right
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns; ``text_col`` without repeated passages, and _words, _cut_words and _cuts (word ranges cut, of the text as it was)."""
    names = docs.columns
    own_key, key, gone = unused(names, "_key", "_key2", "_gone")
    report = unused(names, *REPORT)
    held = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    keyed = docs.withColumn(own_key, document_key(id_col, text_col))
    cuts = cut_words(keyed.select(F.col(own_key).alias("key"), F.col(text_col).alias("text")), held).select(F.col("key").alias(key), F.col("cuts").alias(gone))
    met = keyed.join(cuts.hint("shuffle_hash"), F.col(own_key) == F.col(key), "left").select(*names, gone)
    at = names.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo, hi, block in blocks(batch.column(at), powers):
                starts, ends, firsts = block.words(NON_SPACE)
                own = [np.frombuffer(x, dtype=np.uint32).astype(np.int64).reshape(-1, 2) if x else np.zeros((0, 2), np.int64) for x in batch.column(len(names)).slice(lo, hi - lo).to_pylist()]
                columns = [x.slice(lo, hi - lo) for x in batch.columns[: len(names)]]
                if any(map(len, own)):
                    texts = columns[at].to_pylist()
                    for row, x in enumerate(own):
                        if len(x):
                            texts[row] = without(block, starts, ends, row, x + firsts[row])
                    columns[at] = pa.array(texts, columns[at].type)
                ranges = pa.array([[{"begin": b, "end": e} for b, e in x.tolist()] for x in own], SPANS)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(firsts)), pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in own], pa.int64()), ranges], names=[*names, *report])

    extra = "{} long, {} long, {} array<struct<begin: long, end: long>>".format(*report)
    return small_batches(gathered(met, held, TASK_BYTES)).mapInArrow(scan, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), extra]))


#: Columns that deduplicated() adds, with underscores after them where a column has that name.
REPORT = ("_words", "_cut_words", "_cuts")
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, the words cut, where, and the text that stays."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return deduplicated(plain).select("doc_id", F.col("_words").alias("n_words"), F.col("_cut_words").alias("n_cut_words"), F.size("_cuts").cast("long").alias("n_cuts"), F.to_json("_cuts").alias("cuts"), "text")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with repeated passages cut out and lengths brought up to date."""
    out = deduplicated(docs, id_col, text_col)
    if length_col in docs.columns:
        changed = F.when(F.col(unused(docs.columns, *REPORT)[1]) > 0, F.length(text_col)).otherwise(F.col(length_col))
        out = out.withColumn(length_col, changed.cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
