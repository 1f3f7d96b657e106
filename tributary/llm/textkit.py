"""Vectorised scanning of Arrow string columns, shared by the llm operators.

A column is walked in blocks of about one MiB of UTF-8, so temporary arrays
stay near ten MB whatever the batch or the table holds. Only a single text
larger than a block makes its block larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

# Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over an array of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(chars: str) -> np.ndarray:
    """True for the bytes of the ASCII characters given."""
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode("ascii"))] = True
    return table


SPACES = byte_table(" \t\n\x0b\x0c\r")
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~SPACES
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
LETTERS_DIGITS = byte_table("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS_DIGITS[128:] = True
#: Lower-cases A-Z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes that begin a code point.
LEADING = (np.arange(256) & 0xC0) != 0x80

BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
FOLDED_VALUES = BYTE_VALUES[FOLD]


class Powers:
    """Powers of the hash's base and of its inverse, grown as blocks need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 1)
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                powers = np.full(n, base, dtype=U64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U64))


class Block:
    """Some rows' texts: their bytes, and where each text begins and ends."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, powers: Powers) -> None:
        self.data, self.offs, self.powers = data, offs, powers
        self.rows = len(offs) - 1

    def words(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every word, and each row's first word (one more entry than rows)."""
        n = len(self.data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = member[self.data]
        before, after = inside[:-2].copy(), inside[2:].copy()
        inside = inside[1:-1]
        filled = self.offs[:-1] < self.offs[1:]
        before[self.offs[:-1][filled]] = False
        after[self.offs[1:][filled] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Running polynomial hash, from which span_hash() takes that of any span."""
        n = len(self.data)
        self.powers.grow(n + 1)
        out = np.zeros(n + 1, dtype=U64)
        np.cumsum(values[self.data] * self.powers.up[:n], out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes, the same wherever the span lies."""
        out = (prefix[ends] - prefix[starts]) * self.powers.down[starts]
        return mix(out + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))

    def code_points(self) -> np.ndarray:
        """Running number of code points, with a leading 0."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(LEADING[self.data], out=out[1:])
        return out

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", errors="replace")


def blocks(column: pa.Array, powers: Powers, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """First row, end row and Block of consecutive rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and offs[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, Block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], powers)
        lo = hi


def row_of(firsts: np.ndarray) -> np.ndarray:
    """For each element its row, from the rows' first elements (one more entry than rows)."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def runs_of(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of width consecutive words inside a row, and each window's first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n - width + 1, dtype=U64)
    for k in range(width):
        out *= U64(BASE)
        out += hashes[k : n - width + 1 + k]
    last = np.repeat(firsts[1:], np.diff(firsts))[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= last)
    return mix(out[at]), at


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of the columns."""
    there, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


#: Bytes of an Arrow batch between the JVM and Python; the session's own limit holds if it is lower.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df):
    """The same frame, with its session's Arrow batches held to BATCH_BYTES: a batch is held several times over, by the JVM, by Arrow and by Python."""
    conf = df.sparkSession.conf
    held = conf.get(BATCH_LIMIT, None)
    if held is None or not held.rstrip("bB").isdigit() or int(held.rstrip("bB")) > BATCH_BYTES:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df


def shared_dir(spark) -> str:
    """The folder that driver and executors share: what the cluster names in spark.checkpoint.dir. Where that is unset, one of our own on one machine, and an error on a cluster, whose executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", found)
        gone_at_exit(spark, found)
    return found


def gone_at_exit(spark, path: str) -> None:
    """Has a folder deleted when the driver's JVM ends, however it ends but by force."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


#: Short rows, rows with texts, or bytes of text that a task of a result holds; small tables so don't end in hundreds of tiny files.
TASK_ROWS, TASK_TEXTS, TASK_BYTES = 50_000, 4_000, 16 << 20


def gathered(df, rows: int, most: int = TASK_ROWS):
    """The same rows in as many tasks as their number asks for, as many as there are cores at least; never more than now, and without a shuffle."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))


def cut(df, rows: int | None = None, most: int = TASK_ROWS):
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder; rows: about how many there are, at most."""
    context = df.sparkSession.sparkContext
    if rows is not None:
        df = gathered(df, rows, most)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
        # Spark makes a folder of its own there for this application.
        gone_at_exit(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint(eager=True)
