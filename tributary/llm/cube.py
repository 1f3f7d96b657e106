"""Mixing sources to target weights by the cube method.

Each source has a target number of words; target over size is the mean number
of copies its documents need. The whole part is taken of every document, the
fraction is an inclusion probability. The flight phase moves three fractional
units at a time along the null-space of the two balancing constraints (words
and documents), until one of them is 0 or 1: both totals stay as they are. It
runs in blocks of a source; each leaves two fractional units or fewer, which
fly again together, until one block of a source is left and its last units
land on the choice nearest the target; where a long document then leaves the
total off, shorter ones of that last block are flipped towards it.

A unit is what is told apart by source, id, size and text digest: repeated
rows move together. Blocks and random directions depend on those values alone,
so reruns agree however rows are partitioned. Sizes and ids are shuffled, never
texts, except by ``materialise``.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; sources without a word have target 0 and take nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.textkit import TASK_TEXTS, U64, cut, gathered, mix, unused

WEIGHTS = (1, 2, 3)
#: Targets stop at so many times a source's size.
MOST_COPIES = 3
#: Units that fly together in one task.
BLOCK_UNITS = 5_000
SPACES = " \t\n\u000b\f\r"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Target of each source from all sources' sizes: weights 1, 2, 3 in order of code points, null last, with excess above three times the size shared out again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), list(weight), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * share > MOST_COPIES * size[s]]
        if not full:
            return out | {s: weight[s] * share for s in open_}
        for s in full:
            out[s] = float(MOST_COPIES * size[s])
            left -= out[s]
        stopped = set(full)
        open_ = [s for s in open_ if s not in stopped]
    return out


def fly(p: np.ndarray, size: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase over one block: sums of p and of p * size as before, two fractional units at most (more only where rounding stops it)."""
    p, near = p.astype(float).copy(), 1e-9
    pool: list[int] = []
    for i in range(len(p)):
        if near < p[i] < 1 - near:
            pool.append(i)
        if len(pool) == 3:
            step(p, size, pool, random[i])
            pool = [k for k in pool if near < p[k] < 1 - near]
    if len(pool) == 2 and size[pool[0]] == size[pool[1]]:
        step(p, size, pool, random[pool[0]])
    p[p <= near], p[p >= 1 - near] = 0.0, 1.0
    return p


def step(p: np.ndarray, size: np.ndarray, pool: list[int], u: float) -> None:
    """Moves the pool's units along the null-space of (1, 1, 1) and their sizes until one is 0 or 1."""
    if len(pool) == 3:
        a, b, c = (float(size[k]) for k in pool)
        way = (b - c, c - a, a - b)
        if a == b == c:
            way = (1.0, -1.0, 0.0)
    else:
        way = (1.0, -1.0)
    ahead = min((1 - p[k]) / w if w > 0 else p[k] / -w for k, w in zip(pool, way, strict=True) if w)
    back = min(p[k] / w if w > 0 else (1 - p[k]) / -w for k, w in zip(pool, way, strict=True) if w)
    length = ahead if u * (ahead + back) < back else -back
    for k, w in zip(pool, way, strict=True):
        p[k] = min(1.0, max(0.0, p[k] + length * w))


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last fractional units become 0 or 1, nearest to the words they stand for; of equal choices, nearest to their number."""
    left = np.flatnonzero((p > 0) & (p < 1))
    want, many, out = float((p[left] * size[left]).sum()), float(p[left].sum()), p.copy()
    out[left] = 0.0
    # Rounding may leave more than two units; beyond eight the rest is rounded on its own.
    for k in left[8:]:
        out[k] = round(p[k])
        want, many = want - out[k] * size[k], many - out[k]
    left = left[:8]
    best = min(range(1 << len(left)), key=lambda c: (abs(sum(size[k] for j, k in enumerate(left) if c >> j & 1) - want), abs(bin(c).count("1") - many), c), default=0)
    for j, k in enumerate(left):
        out[k] = float(best >> j & 1)
    return out


def settle(p: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """After landing: while one flip of a unit that could go either way brings the words nearer to what they were, flips the one that does so most."""
    out, off = p.copy(), float((p * size).sum() - (start * size).sum())
    free = np.flatnonzero((start > 0) & (start < 1))
    while len(free):
        after = np.abs(off + np.where(out[free] > 0, -size[free], size[free]))
        k = int(after.argmin())
        if after[k] >= abs(off):
            break
        off += -size[free[k]] if out[free[k]] > 0 else size[free[k]]
        out[free[k]] = 1 - out[free[k]]
    return out


UNIT = "source string, doc_id long, size long, digest long, n long, whole long, p double"


def flight(units: DataFrame, last: bool) -> DataFrame:
    """Runs the flight phase in each group (source, block); on the last level units land too."""

    def block(table: pa.Table) -> pa.Table:
        at = pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("size", "ascending"), ("digest", "ascending")])
        table = table.take(at)
        digest = table["digest"].to_numpy().astype(np.int64).view(U64)
        key = mix(digest ^ mix(table["doc_id"].fill_null(0).to_numpy().astype(np.int64).view(U64) + U64(7)))
        # In hash order: ids near one another often hold like documents.
        order = np.argsort(key, kind="stable")
        size = (table["size"].to_numpy() * table["n"].to_numpy())[order]
        start = table["p"].to_numpy()[order]
        p = fly(start, size, (mix(key[order]) >> U64(11)).astype(float) / 2.0**53)
        if last:
            p = settle(land(p, size), start, size)
        out = np.empty(len(p))
        out[order] = p
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out)).select([f.split()[0] for f in UNIT.split(", ")])

    return units.groupBy("source", "block").applyInArrow(block, UNIT)


def decide(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """Copies of every unit (source, doc_id, size, digest, n) under the sources' targets; sizes has a row (source, total, units) per source."""
    spark = units.sparkSession
    rows = sizes.collect()
    goal = targets([(r["source"], r["total"]) for r in rows])
    plan = spark.createDataFrame(
        [(r["source"], r["total"], goal[r["source"]], max(1, -(-r["units"] // BLOCK_UNITS))) for r in rows], "source string, source_size long, target double, blocks long"
    ).alias("plan")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ready = (
        units.alias("u")
        .join(plan, F.col("u.source").eqNullSafe(F.col("plan.source")))
        .select("u.*", "blocks", F.floor(mean + 1e-12).cast("long").alias("whole"), F.greatest(F.lit(0.0), mean - F.floor(mean + 1e-12)).alias("p"))
    )
    dealt = F.pmod(F.xxhash64("digest", "doc_id", "size"), F.col("blocks"))
    names = [f.split()[0] for f in UNIT.split(", ")]
    most = max((-(-r["units"] // BLOCK_UNITS) for r in rows), default=0)
    flown = flight(ready.withColumn("block", dealt), last=most <= 1)
    done = []
    total = sum(r["units"] for r in rows)
    while most > 1:
        flown = cut(flown, total)
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~fractional))
        # Each block leaves two units, so one block in BLOCK_UNITS / 2 is enough for them.
        most = -(-most * 3 // BLOCK_UNITS)
        again = flown.where(fractional).withColumn("block", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(most)))
        flown = flight(again, last=most <= 1)
    for part in done:
        flown = flown.unionByName(part)
    return (
        flown.alias("u")
        .join(plan, F.col("u.source").eqNullSafe(F.col("plan.source")))
        .select(*(f"u.{n}" for n in names[:5]), "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    )


def as_units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per unit with the number of its rows."""
    return (
        docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("digest"))
        .groupBy("source", "doc_id", "size", "digest")
        .agg(F.count("*").alias("n"))
    )


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    units = cut(as_units(docs, id_col, text_col, source_col), docs.count())
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.count("*").alias("units"))
    return decide(units, sizes)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    decided = mix_decisions(docs, id_col, text_col, source_col)
    rows = decided.select(F.explode(F.sequence(F.lit(1).cast("long"), "n")), "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies").drop("col")
    return gathered(rows, docs.count())


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the documents taken, with all their columns and the number of their copies, in place of a column of that name."""
    own_key, own_text, own_size, own_source, key, text, size, source, copies = unused(docs.columns, "_key", "_text", "_size", "_source", "_key2", "_text2", "_size2", "_source2", "_copies")
    decided = mix_decisions(docs, id_col, text_col, source_col).where("copies > 0")
    taken = decided.select(F.col("doc_id").alias(key), F.col("digest").alias(text), F.col("size").alias(size), F.col("source").alias(source), F.col("copies").alias(copies))
    d = docs.withColumns({own_key: F.col(id_col).cast("long"), own_text: F.xxhash64(F.col(text_col)), own_size: word_count(F.col(text_col)), own_source: F.col(source_col).cast("string")})
    same = (F.col(own_text) == F.col(text)) & (F.col(own_size) == F.col(size)) & F.col(own_key).eqNullSafe(F.col(key)) & F.col(own_source).eqNullSafe(F.col(source))
    return gathered(d.join(taken, same).select(*(d[c] for c in docs.columns if c.lower() != "copies"), F.col(copies).alias("copies")), docs.count(), TASK_TEXTS)
