"""Language identification by a blended-spectrum string kernel.

A text's features are the distinct byte n-grams of one to ``LONGEST`` bytes of
its text with A-Z lower-cased, hashed into ``SPACE`` slots; the presence kernel
of two texts is the number of slots they share over the geometric mean of
their slots. Landmarks give the Nyström map K(x, landmarks) K_mm^(-1/2), on
which one-versus-rest kernel ridge regression is solved; a batch of texts is
scored by two matrix products. Whole texts are used.

The model is fitted on a bounded sample: of each language the ``SAMPLE``
labelled texts of least hash among those that are not held out (crc32 of the
id as text, modulo 5, not 0), each digested whole, ``LANDMARKS`` of them spread
over the languages. Prediction reads nothing but the text.

Defined results: a null text or one without a letter is ``und`` with score 0;
a null id counts as the empty text (held out); rows without a language
or a letter are never learned from, and of rows that share id and language one
is; of equal scores the language first in order wins; without any labelled row
all are ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.textkit import FOLD, Block, Powers, blocks, small_batches

LONGEST = 3
SPACE = 1 << 14
SAMPLE = 300
LANDMARKS = 96
#: Languages beyond which the sample per language shrinks, so that the sample stays bounded.
MOST_SAMPLE = 12_000
RIDGE = 1e-3
#: Texts of one matrix product.
BATCH = 64

ASCII_LETTERS = np.zeros(256, dtype=bool)
ASCII_LETTERS[65:91] = ASCII_LETTERS[97:123] = True


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def presence(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A row per text: which slots its n-grams take."""
    rows = len(firsts) - 1
    out = np.zeros((rows, SPACE), dtype=np.uint8)
    flat = out.ravel()
    row = np.repeat(np.arange(rows, dtype=np.int64) * SPACE, np.diff(firsts))
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(firsts[0], firsts[-1])
    code = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        size = len(data) - n + 1
        if size <= 0:
            break
        code = code[:size] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(n)
        mixed = code * np.uint32(0x9E3779B1)
        slot = ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(SPACE - 1)).astype(np.int64)
        whole = left[:size] >= n
        flat[(row[:size] + slot)[whole]] = 1
    return out


def batches_of(block: Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, end row and presence of a block's texts, BATCH at a time."""
    folded = FOLD[block.data]
    for lo in range(0, block.rows, BATCH):
        hi = min(block.rows, lo + BATCH)
        b, e = int(block.offs[lo]), int(block.offs[hi])
        yield lo, hi, presence(folded[b:e], block.offs[lo : hi + 1] - b)


def normalised(x: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that their dot products are the kernel."""
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class Model:
    """Landmarks, Nyström map and one ridge solution per language."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        y = np.array([[1.0 if lang == own else -1.0 for own in self.langs] for lang in langs])
        per = max(1, LANDMARKS // max(1, len(self.langs)))
        chosen = [i for own in self.langs for i in [j for j, lang in enumerate(langs) if lang == own][:per]]
        self.landmarks = np.ascontiguousarray(x[chosen].T)
        value, vector = np.linalg.eigh((x[chosen] @ self.landmarks).astype(float))
        kept = value > 1e-6 * value.max()
        root = vector[:, kept] / np.sqrt(value[kept])
        phi = (x @ self.landmarks) @ root
        phi = np.concatenate([phi, np.ones((len(phi), 1))], axis=1)
        # Each language weighs the same, however many rows it has.
        weight = 1.0 / np.array([langs.count(lang) for lang in langs], dtype=float)
        solved = np.linalg.solve((phi.T * weight) @ phi + RIDGE * np.eye(phi.shape[1]), (phi.T * weight) @ y)
        self.map = (root @ solved[:-1]).astype(np.float32)
        self.offset = solved[-1].astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks) @ self.map + self.offset


def sample(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Normalised presence and language of the bounded training sample."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang", "deal").orderBy("order", "doc_id")
    ranked = usable.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(11)).alias("order")).withColumn("deal", F.pmod(F.col("order"), F.lit(64)))
    # In two steps, so that a language of most rows is ranked in 64 tasks before one.
    some = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).drop("rank", "deal")
    chosen = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))).where(F.col("rank") <= SAMPLE).select("doc_id", "lang", "rank")
    picked = [(r["doc_id"], r["lang"], r["rank"]) for r in chosen.orderBy("rank", "lang").limit(MOST_SAMPLE).collect()]
    wanted = [d for d, _, _ in picked]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo, hi, block in blocks(batch.column(2), powers):
                for b, e, x in batches_of(block):
                    bits = [np.packbits(r).tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo + b, e - b), batch.column(1).slice(lo + b, e - b), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    found = small_batches(usable.where(F.col("doc_id").isin(wanted)).select("doc_id", "lang", "text")).mapInArrow(digest, "doc_id long, lang string, bits binary") if wanted else None
    # Of rows that share id and language one is learned from, so that no more come to the driver than were picked.
    rows = [(r["lang"], r["doc_id"], bytes(r["bits"])) for r in found.groupBy("lang", "doc_id").agg(F.min("bits").alias("bits")).collect()] if wanted else []
    order_of = {(lang, d): k for d, lang, k in reversed(picked)}
    rows = sorted((x for x in rows if (x[0], x[1]) in order_of), key=lambda r: (r[0], order_of[r[0], r[1]]))
    x = np.stack([np.unpackbits(np.frombuffer(b, dtype=np.uint8)) for _, _, b in rows]) if rows else np.zeros((0, SPACE), np.uint8)
    return normalised(x), [lang for lang, _, _ in rows]


def lettered(block: Block) -> np.ndarray:
    """Which rows have a letter."""
    running = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(ASCII_LETTERS[block.data], out=running[1:])
    out = running[block.offs[1:]] > running[block.offs[:-1]]
    for row in np.flatnonzero(~out & (np.diff(block.offs) > 0)).tolist():
        out[row] = any(ch.isalpha() for ch in block.text(int(block.offs[row]), int(block.offs[row + 1])))
    return out


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: whether it was held out, its language, and the winner's share of the scores."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    x, langs = sample(docs)
    model = Model(x, langs) if langs else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            names, shares = [], []
            for _, _, block in blocks(batch.column(2), powers):
                some = lettered(block)
                for b, e, seen in batches_of(block) if model else ():
                    found = model.scores(normalised(seen))
                    best = found.argmax(axis=1)
                    # Softmax at a temperature of 1/4: scores are near -1 or 1.
                    power = np.exp(4.0 * (found - found.max(axis=1, keepdims=True)))
                    share = 1.0 / power.sum(axis=1)
                    names += [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), some[b:e].tolist(), strict=True)]
                    shares += np.where(some[b:e], share, 0.0).tolist()
            names, shares = (names, shares) if model else (["und"] * batch.num_rows, [0.0] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return small_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")).mapInArrow(scan, PREDICTED)
