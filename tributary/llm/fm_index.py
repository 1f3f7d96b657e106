"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one Arrow batch. Its word sequence is kept
over the alphabet of the test phrases: every other word can be part of no
occurrence and becomes one delimiter, and runs of alphabet words shorter than
the shortest phrase are left out. The suffix array of that sequence gives the
Burrows-Wheeler transform, a wavelet matrix answers its ranks, all phrases are
searched backwards at once, and occurrences are located by walking to the next
sampled suffix position. The scan is row-wise: no shuffle, and a shard's
memory is bounded by ``SHARD_WORDS``. Items of more text than a task should hold
are searched in groups, one after the other, whose spans and items then meet by
row; the result is that of a single group.

Defined results: a null or empty text has no words; an item without words has
no window, and one without an id is listed as the empty string; repeated rows and repeated ids are judged row by row; without documents or
items nothing is hit; other columns
of either table are neither read nor carried by ``find_hits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tributary.llm.textkit import FOLDED_VALUES, LETTERS_DIGITS, U64, Block, Powers, blocks, cut, small_batches, unused

WINDOW = 10
#: Words of one shard's sequence; a longer run is cut with an overlap of a window less one word.
SHARD_WORDS = 400_000
#: Positions between sampled suffixes.
SAMPLE = 8
#: Text of the items that a task searches at once, some 2.5 million windows of 60 bytes; more is searched in groups.
GROUP_BYTES = 16 << 20


class WaveletMatrix:
    """Ranks of any symbol in a sequence, over arrays of queries."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        lo, hi = np.zeros_like(end), end
        for b, ones, zeros in self.levels:
            one, lo1, hi1 = (symbol >> b) & 1 == 1, ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def at(self, pos: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out = np.zeros(len(pos), dtype=np.int64)
        for b, ones, zeros in self.levels:
            before = ones[pos]
            one = ones[pos + 1] > before
            out |= one.astype(np.int64) << b
            pos = np.where(one, zeros + before, pos - before)
        return out


class FMIndex:
    """Full-text index of a sequence of positive symbols in which 0 delimits runs."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        n = len(sequence)
        suffixes = suffix_array(sequence)
        before = sequence[suffixes - 1]
        before[suffixes == 0] = 0
        self.bwt = WaveletMatrix(before, max(1, int(sigma).bit_length()))
        self.first = np.zeros(sigma + 2, dtype=np.int64)
        np.cumsum(np.bincount(sequence, minlength=sigma + 1), out=self.first[1:])
        # Sampled: every SAMPLE-th position and the first of each run, so that no walk meets a delimiter.
        kept = np.arange(n) % SAMPLE == 0
        kept[1:] |= sequence[:-1] == 0
        marked = kept[suffixes]
        self.marks = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(marked, out=self.marks[1:])
        self.samples = suffixes[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns of one length, a row each."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.first[-1], dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            lo[live] = self.first[symbol] + self.bwt.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.bwt.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, ranks: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffixes given by rank."""
        out, steps = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        left, at = np.arange(len(ranks)), ranks.copy()
        while len(left):
            marked = self.marks[at + 1] > self.marks[at]
            out[left[marked]] = self.samples[self.marks[at[marked]]] + steps[left[marked]]
            left, at = left[~marked], at[~marked]
            steps[left] += 1
            symbol = self.bwt.at(at)
            at = self.first[symbol] + self.bwt.rank(symbol, at)
        return out


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; delimiters are ordered by position, so each run ends in a symbol of its own."""
    n = len(sequence)
    delimiter = sequence == 0
    rank = sequence + int(delimiter.sum())
    rank[delimiter] = np.arange(delimiter.sum())
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * np.int64(max(n, int(rank.max()) + 1) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
        rank, width = fresh, width * 2
        if int(rank.max()) == n - 1 or width >= n:
            return order


class Owners:
    """The items of each pattern, as names sorted."""

    def __init__(self, pattern: np.ndarray, owner: np.ndarray, many: int, names: list[str]) -> None:
        pairs = np.unique(pattern.astype(np.int64) * len(names) + owner)
        self.owner = (pairs % len(names)).astype(np.int32)
        self.first = np.searchsorted(pairs // len(names), np.arange(many + 1))
        self.names = names

    def __len__(self) -> int:
        return len(self.first) - 1

    def __getitem__(self, pattern: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.first[pattern] : self.first[pattern + 1]].tolist()]


class Phrases:
    """All windows of the test items over an alphabet of word hashes."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        names = sorted({"" if key is None else str(key) for key, _ in items})
        code = {name: k for k, name in enumerate(names)}
        hashed, powers = [], Powers()
        for key, text in items:
            for _, _, block in blocks(pa.array([text], pa.large_string()), powers):
                hashed.append((code["" if key is None else str(key)], word_hashes(block)[0]))
        self.alphabet = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, U64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.alphabet & U64(0xFFFF)).astype(np.int64)] = True
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for own, h in hashed:
            if len(h):
                width = min(window, len(h))
                ids = (np.searchsorted(self.alphabet, h) + 1).astype(np.int32)
                by_width.setdefault(width, []).append((own, np.lib.stride_tricks.sliding_window_view(ids, width)))
        self.by_length: dict[int, tuple[np.ndarray, Owners]] = {}
        for width in sorted(by_width):
            rows = np.concatenate([w for _, w in by_width[width]]).view(np.dtype((np.void, 4 * width))).ravel()
            owner = np.repeat([own for own, _ in by_width[width]], [len(w) for _, w in by_width[width]])
            found, pattern = np.unique(rows, return_inverse=True)
            self.by_length[width] = (found.view(np.int32).reshape(len(found), width), Owners(pattern, owner, len(found), names))
        self.least = min(self.by_length, default=0)
        self.most = max(self.by_length, default=0)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for a word that no phrase has."""
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.maybe[(hashes & U64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.alphabet):
            at = np.minimum(np.searchsorted(self.alphabet, hashes[maybe]), len(self.alphabet) - 1)
            same = self.alphabet[at] == hashes[maybe]
            out[maybe[same]] = at[same] + 1
        return out


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, firsts = block.words(LETTERS_DIGITS)
    return block.span_hash(block.prefix(FOLDED_VALUES), starts, ends), starts, ends, firsts


def alphabet_runs(symbols: np.ndarray, firsts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of runs of alphabet words, inside a row, of at least a shortest phrase's length."""
    inside = np.zeros(len(symbols) + 1, dtype=bool)
    inside[1:] = symbols > 0
    cutoff = firsts[:-1][np.diff(firsts) > 0]
    before = inside[:-1].copy()
    before[cutoff] = False
    inside = inside[1:]
    begin = np.flatnonzero(inside & ~before)
    after = np.append(inside[1:], False)
    after[cutoff[cutoff > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    long = end - begin >= max(least, 1)
    return begin[long], end[long]


def occurrences(pieces: list[tuple[int, np.ndarray]], phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int, Owners]]:
    """First words and pattern numbers of all occurrences, the patterns' length and items, from pieces (position of the first word, symbols); a shard at a time."""
    shard: list[tuple[int, np.ndarray]] = []
    size = 0

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, int, Owners]]:
        sequence = np.concatenate([part for _, s in shard for part in (s, np.zeros(1, np.int64))])
        begins = np.cumsum([0, *(len(s) + 1 for _, s in shard)])
        origins = np.array([b for b, _ in shard], dtype=np.int64)
        index = FMIndex(sequence, len(phrases.alphabet))
        there = np.zeros(len(phrases.alphabet) + 1, dtype=bool)
        there[sequence] = True
        for width, (patterns, items) in phrases.by_length.items():
            # Only phrases all of whose words occur here are searched.
            likely = np.arange(len(patterns))
            for k in range(width):
                likely = likely[there[patterns[likely, k]]]
            lo, hi = index.search(patterns[likely].astype(np.int64))
            count = hi - lo
            if count.any():
                pattern = np.repeat(likely, count)
                at = index.locate(np.repeat(lo, count) + np.arange(len(pattern)) - np.repeat(np.cumsum(count) - count, count))
                piece = np.searchsorted(begins, at, side="right") - 1
                yield at - begins[piece] + origins[piece], pattern, width, items

    for begin, symbols in pieces:
        step = SHARD_WORDS - phrases.most + 1
        for k in range(0, max(1, len(symbols) - phrases.most + 1), step):
            part = symbols[k : k + SHARD_WORDS]
            if shard and size + len(part) > SHARD_WORDS:
                yield from found()
                shard, size = [], 0
            shard.append((begin + k, part))
            size += len(part)
    if shard:
        yield from found()


class Judged:
    """Words of a run of rows, which of them are hit, and each row's items."""

    def __init__(self, column: pa.Array, phrases: Phrases, powers: Powers) -> None:
        self.n_words = np.zeros(len(column), dtype=np.int64)
        pieces, total = [], 0
        firsts_all = [np.zeros(1, np.int64)]
        for lo, hi, block in blocks(column, powers):
            hashes, _, _, firsts = word_hashes(block)
            self.n_words[lo:hi] = np.diff(firsts)
            symbols = phrases.ids(hashes) if phrases.least else np.zeros(len(hashes), np.int64)
            for b, e in zip(*alphabet_runs(symbols, firsts, phrases.least), strict=True):
                pieces.append((total + int(b), symbols[b:e]))
            firsts_all.append(firsts[1:] + total)
            total += len(hashes)
        self.firsts = np.concatenate(firsts_all)
        self.items: dict[int, set[str]] = {}
        begins, widths = [], []
        for at, pattern, width, items in occurrences(pieces, phrases):
            begins.append(at)
            widths.append(np.full(len(at), width))
            row = np.searchsorted(self.firsts, at, side="right") - 1
            for pair in np.unique(row * len(items) + pattern).tolist():
                self.items.setdefault(pair // len(items), set()).update(items[pair % len(items)])
        self.spans = merged(np.concatenate(begins), np.concatenate(widths)) if begins else np.zeros((0, 2), np.int64)
        self.n_hit = np.zeros(len(column), dtype=np.int64)
        #: Each hit row's spans, counted from its first word.
        self.own_spans: dict[int, list[tuple[int, int]]] = {}
        rows = np.searchsorted(self.firsts, self.spans[:, 0], side="right") - 1
        # A span is cut where a row ends: windows lie inside rows, but windows of adjacent rows may touch.
        for (b, e), row in zip(self.spans.tolist(), rows.tolist(), strict=True):
            while b < e:
                first, stop = int(self.firsts[row]), min(e, int(self.firsts[row + 1]))
                if b < stop:
                    self.own_spans.setdefault(row, []).append((b - first, stop - first))
                    self.n_hit[row] += stop - b
                b, row = stop, row + 1


def merged(begins: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Overlapping and touching word spans joined into removal spans."""
    order = np.argsort(begins, kind="stable")
    begin, end = begins[order], (begins + widths)[order]
    reach = np.maximum.accumulate(end)
    fresh = np.append(True, begin[1:] > reach[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(begin) - 1)
    return np.stack([begin[fresh], reach[last]], axis=1)


def phrase_groups(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> list[Callable[[], Phrases]]:
    """Readers of the items' windows, a group of items of about GROUP_BYTES each; items of the same text share a group."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    held = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    many = max(1, -(-held // GROUP_BYTES))

    def read(k: int) -> Phrases:
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(many)) == k) if many > 1 else items
        return Phrases([(r["item"], r["text"]) for r in own.collect()], window)

    return [lambda k=k: read(k) for k in range(many)]


GROUP_SCHEMA = "row long, doc_id long, n_words long, spans array<struct<b: long, e: long>>, items array<string>"


def hits_by_group(rows: DataFrame, groups: list[Callable[[], Phrases]]) -> DataFrame:
    """(row, doc_id, n_words, spans, items) of every row of (row, doc_id, text): what each group finds, joined by row. One group's windows are held at a time."""

    def scan(phrases: Phrases, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers = Powers()
            for batch in batches:
                got = Judged(batch.column(2), phrases, powers)
                at = range(batch.num_rows) if every else sorted(got.own_spans)
                columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
                columns += [pa.array(got.n_words[list(at)], pa.int64())]
                columns += [pa.array([[{"b": b, "e": e} for b, e in got.own_spans.get(i, ())] for i in at], pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))]
                columns += [pa.array([sorted(got.items.get(i, ())) for i in at], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_words", "spans", "items"])

        return one

    found = None
    for k, group in enumerate(groups):
        own = cut(rows.mapInArrow(scan(group(), k == 0), GROUP_SCHEMA))
        found = own if found is None else found.unionByName(own)
    together = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    return found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), together("spans"), together("items"))


def joined_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """A row's spans of several groups as removal spans."""
    at = np.array([(s["b"], s["e"]) for s in spans or ()], dtype=np.int64).reshape(-1, 2)
    return [tuple(x) for x in merged(at[:, 0], at[:, 1] - at[:, 0]).tolist()] if len(at) else []


HIT_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, its words inside occurrences, and a digest of the items found."""
    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    groups = phrase_groups(benchmark)
    if len(groups) > 1:
        found = hits_by_group(cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")), groups)
        return found.mapInArrow(digested, HIT_SCHEMA)
    phrases = groups[0]()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            got = Judged(batch.column(1), phrases, powers)
            yield hit_rows(batch.column(0), got.n_words, got.n_hit, [sorted(got.items.get(i, ())) for i in range(batch.num_rows)])

    return rows.mapInArrow(scan, HIT_SCHEMA)


def hit_rows(ids: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0)],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hits_by_group as those of find_hits."""
    for batch in batches:
        n_hit = np.array([sum(e - b for b, e in joined_spans(x)) for x in batch.column(3).to_pylist()], dtype=np.int64)
        yield hit_rows(batch.column(1), batch.column(2), n_hit, batch.column(4).to_pylist())


def without(text: str, spans: list[tuple[int, int]], powers: Powers) -> str:
    """The text without spans of its words."""
    _, _, block = next(blocks(pa.array([text], pa.large_string()), powers))
    _, starts, ends, _ = word_hashes(block)
    parts, at = [], 0
    for b, e in spans:
        parts.append(block.text(at, int(starts[b])).rstrip(" "))
        at = int(ends[e - 1])
    parts.append(block.text(at, len(block.data)).lstrip(" "))
    return " ".join(x for x in parts if x)


def cut_hits(text: str, phrases: Phrases, powers: Powers) -> str:
    """The text without its removal spans; again, until what has moved together holds no phrase either."""
    while spans := Judged(pa.array([text], pa.large_string()), phrases, powers).own_spans.get(0):
        text = without(text, spans, powers)
    return text


def with_texts(batch: pa.RecordBatch, made: dict[int, str], text_at: int, length_at: int | None) -> pa.RecordBatch:
    """The batch with some rows' texts, and their lengths, replaced."""
    columns = list(batch.columns)
    for at, values in ((text_at, made), (length_at, {i: len(t) for i, t in made.items()})):
        if at is not None:
            held = columns[at].to_pylist()
            for i, v in values.items():
                held[i] = v
            columns[at] = pa.array(held, columns[at].type)
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def remove_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with all removal spans cut out of the texts and lengths brought up to date; a null text stays null."""
    groups = phrase_groups(benchmark)
    names = docs.columns
    text_at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None
    if len(groups) > 1:
        return remove_by_group(docs, groups, text_at, length_at)
    phrases = groups[0]()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            hit = np.flatnonzero(Judged(batch.column(text_at), phrases, powers).n_hit).tolist()
            if hit:
                texts = batch.column(text_at)
                batch = with_texts(batch, {i: cut_hits(texts[i].as_py(), phrases, powers) for i in hit}, text_at, length_at)
            yield batch

    return small_batches(docs).mapInArrow(scan, docs.schema)


def remove_by_group(docs: DataFrame, groups: list[Callable[[], Phrases]], text_at: int, length_at: int | None) -> DataFrame:
    """remove_hits() with items in groups: spans of all groups are cut together, then the texts that changed are searched again until none holds a phrase."""
    row, spans = unused(docs.columns, "_row", "_spans")
    schema = StructType([*docs.schema.fields, StructField(row, LongType())])
    quoted = [f"`{n}`" for n in schema.names]
    rows = cut(small_batches(docs).withColumn(row, F.monotonically_increasing_id()))
    text = F.col(f"`{docs.columns[text_at]}`")
    still = rows

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = batch.column(text_at)
            made = {i: without(texts[i].as_py(), joined_spans(x), powers) for i, x in enumerate(batch.column(batch.num_columns - 1).to_pylist())}
            yield with_texts(batch, made, text_at, length_at).select(schema.names)

    done = []
    while True:
        found = cut(hits_by_group(still.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), text.alias("text")), groups).where(F.size("spans") > 0))
        if found.isEmpty():
            done.append(still)
            break
        hit = found.select(F.col("row").alias(row), F.col("spans").alias(spans))
        done.append(still.join(hit, row, "left_anti").select(quoted))
        still = cut(still.join(hit, row).select(*quoted, spans).mapInArrow(clear, schema))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(quoted[:-1])
