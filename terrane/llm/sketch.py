"""Mergeable percentiles by dyadic Count-sketches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.hashing import uniform
from terrane.session import staged

#: Bits of an encoded value, upper levels that are counted exactly, hash rows of a level, counters of a row (a power of 2).
BITS, EXACT, ROWS, WIDTH = 32, 12, 5, 4096
#: Values a task gathers before it adds them to a sketch, and values of a group for which it gets one task more.
GATHER, TASK = 1_000_000, 16_000_000
#: Distinct codes up to which a sketch keeps codes and counts themselves, exactly, instead of counters.
SPARSE = 50_000


def encode(values: np.ndarray) -> np.ndarray:
    """The upper BITS bits of finite doubles, so laid out that they order as the doubles do (one in a million apart)."""
    raw = (np.asarray(values, np.float64) + 0.0).view(np.int64)  # -0.0 becomes 0.0
    ordered = np.where(raw < 0, ~raw, raw | np.int64(-(2**63))).view(np.uint64)
    return (ordered >> np.uint64(64 - BITS)).astype(np.uint64)


def decode(code: int) -> tuple[float, float]:
    """The smallest and the largest double of a code."""
    ends = []
    for fill in (0, (1 << (64 - BITS)) - 1):
        bits = (int(code) << (64 - BITS)) | fill
        bits = bits & (2**63 - 1) if bits >> 63 else ~bits & (2**64 - 1)
        ends.append(struct.unpack("<d", struct.pack("<Q", bits))[0])
    return ends[0], ends[1]


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """64 well-mixed bits of each node for a hash row, by the finaliser of splitmix64."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Dyadic:
    """Counts of the values' binary prefixes: exact for the first EXACT bits, a Count-sketch for each longer prefix.

    Sketches are linear: adding two gives that of all values, subtracting one (or adding with weight -1) deletes values.
    The rank of a percentile is off by about n / WIDTH, far below 0.2 percentage points. As long as there are at most SPARSE
    distinct codes these and their counts are kept instead, so that a small group costs little and its ranks are exact.
    """

    def __init__(self) -> None:
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.exact: np.ndarray | None = None
        self.rows: np.ndarray | None = None

    @property
    def n(self) -> int:
        return int((self.counts if self.rows is None else self.exact).sum())

    def _place(self, nodes: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(nodes, level * ROWS + row)
        return (h >> np.uint64(64 - WIDTH.bit_length() + 1)).astype(np.int64), 1 - 2 * (h & np.uint64(1)).astype(np.int64)

    @staticmethod
    def _united(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, at = np.unique(codes, return_inverse=True)
        total = np.bincount(at, counts, len(one)).astype(np.int64)
        return one[total != 0], total[total != 0]

    def _counted(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct codes to the counters, which are made first if there are none."""
        if self.rows is None:
            self.exact, self.rows = np.zeros(1 << EXACT, np.int64), np.zeros((BITS - EXACT, ROWS, WIDTH), np.int64)
            own, had = self.codes, self.counts
            self.codes, self.counts = own[:0], had[:0]
            self._counted(own, had)
        for level in range(BITS, EXACT, -1):
            for row in range(ROWS):
                at, sign = self._place(codes, level, row)
                self.rows[level - EXACT - 1, row] += np.bincount(at, sign * counts, WIDTH).astype(np.int64)
            codes = codes >> np.uint64(1)
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            codes, counts = codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts
        self.exact += np.bincount(codes.astype(np.int64), counts, 1 << EXACT).astype(np.int64)

    def _add(self, codes: np.ndarray, counts: np.ndarray) -> Dyadic:
        if self.rows is None:
            self.codes, self.counts = self._united(np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts]))
            if len(self.codes) > SPARSE:
                own, had = self.codes, self.counts
                self.codes, self.counts = own[:0], had[:0]
                self._counted(own, had)
        else:
            self._counted(codes, counts)
        return self

    def add(self, values: np.ndarray, weight: int = 1) -> Dyadic:
        codes, counts = np.unique(encode(values), return_counts=True)
        return self._add(codes, counts * weight)

    def merge(self, other: Dyadic, weight: int = 1) -> Dyadic:
        if other.rows is None:
            return self._add(other.codes, weight * other.counts)
        if self.rows is None:
            self._counted(self.codes[:0], self.counts[:0])
        self.exact += weight * other.exact
        self.rows += weight * other.rows
        return self

    def count(self, level: int, node: int) -> int:
        """About how many values have the prefix `node` of `level` bits."""
        if self.rows is None:
            a, z = np.searchsorted(self.codes, np.array([node, node + 1], np.uint64) << np.uint64(BITS - level))
            return int(self.counts[a:z].sum())
        if level <= EXACT:
            width = 1 << (EXACT - level)
            return int(self.exact[node * width : (node + 1) * width].sum())
        nodes = np.array([node], np.uint64)
        seen = [int(sign[0] * self.rows[level - EXACT - 1, row, at[0]]) for row in range(ROWS) for at, sign in [self._place(nodes, level, row)]]
        return sorted(seen)[ROWS // 2]

    def quantile(self, p: float) -> tuple[float, float] | None:
        """The smallest and the largest double of the code in which the value of rank p * (n - 1) lies; None if empty."""
        n = self.n
        if n <= 0:
            return None
        left, inside, node = p * (n - 1), n, 0
        for level in range(1, BITS + 1):
            node *= 2
            low = min(max(self.count(level, node), 0), inside)
            if left < low:
                inside = low
            else:
                left, inside, node = left - low, inside - low, node + 1
        return decode(node)

    def pack(self) -> bytes:
        parts = (self.codes, self.counts) if self.rows is None else (self.exact, self.rows)
        return (b"c" if self.rows is None else b"s") + zlib.compress(b"".join(p.tobytes() for p in parts), 1)

    @staticmethod
    def unpack(data: bytes) -> Dyadic:
        out, flat = Dyadic(), np.frombuffer(zlib.decompress(data[1:]), np.int64)
        if data[:1] == b"c":
            out.codes, out.counts = flat[: len(flat) // 2].view(np.uint64).copy(), flat[len(flat) // 2 :].copy()
        else:
            out.exact, out.rows = flat[: 1 << EXACT].copy(), flat[1 << EXACT :].reshape(BITS - EXACT, ROWS, WIDTH).copy()
        return out


def finite(values: Column | str) -> Column:
    """The elements that are neither null, NaN nor infinite; null for null."""
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def median(values: Column | str) -> Column:
    """The exact median of an array of numbers, null if it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _by_group(keys: int, fold, out) -> object:
    """A function over batches sorted by their first columns: fold(state, batch, row) for the rows of a group, one group's
    state being held at a time, and out(state, key values, their types) for each group."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, kinds = None, None, []
        for batch in it:
            kinds = [c.type for c in batch.columns[:keys]]
            for i, key in enumerate(zip(*[c.to_pylist() for c in batch.columns[:keys]])):
                if key != own:
                    if own is not None:
                        yield out(state, own, kinds)
                    own, state = key, None
                state = fold(state, batch, i)
        if own is not None:
            yield out(state, own, kinds)

    return run


def _packed(names: list[str]):
    def out(sketch: Dyadic, key: tuple, kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], k) for x, k in zip(key, kinds)], pa.array([abs(sketch.n)], pa.int64()), pa.array([sketch.pack()], pa.binary())], names=names)

    return out


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch a group, (keys, n, sketch), of the sketches of separate partitions or days, by addition: a task reads those
    of a group as a stream and holds their sum."""
    schema = T.StructType([*[parts.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
    fold = lambda s, batch, i: (s or Dyadic()).merge(Dyadic.unpack(batch.column(len(keys))[i].as_py()))
    rows = parts.select(*keys, "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_by_group(len(keys), fold, _packed(schema.names)), schema)


def sketches(batches: DataFrame, keys: list[str], values: str, weight: int = 1, batch: str | None = None) -> DataFrame:
    """(keys, n, sketch) of each group: a sketch of the finite elements of its arrays; weight -1 makes one to delete with.

    A group gets one task for each TASK of its values, by a hash of `batch` (or of the array), so that a task that is run
    again gets the same rows; a task reads its arrays as a stream and holds one sketch (3 MB at most), and the sketches of a group
    are added. Rows with a null key, a null array or no finite element are left out; an empty table gives none.
    """
    at = uniform(F.col(batch) if batch else F.col(values), seed=11)
    kept = batches.select(*keys, finite(values).alias("__v"), at.alias("__u")).dropna(subset=keys).filter(F.size("__v") > 0)
    sizes = kept.groupBy(*keys).agg(F.ceil(F.sum(F.size("__v")) / TASK).alias("__n"))
    spread = kept.join(sizes, keys).select(*keys, F.floor(F.col("__u") * F.col("__n")).alias("__salt"), "__v")
    own = [*keys, "__salt"]
    schema = T.StructType([*[spread.schema[k] for k in own], T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def fold(state, batch: pa.RecordBatch, i: int):
        sketch, held, size = state or (Dyadic(), [], 0)
        lists = batch.column(len(own))
        a, z = lists.offsets[i].as_py(), lists.offsets[i + 1].as_py()
        held.append(lists.values.slice(a, z - a).to_numpy(zero_copy_only=False).copy())
        if size + z - a < GATHER:
            return sketch, held, size + z - a
        return sketch.add(np.concatenate(held), weight), [], 0

    def out(state, key: tuple, kinds: list) -> pa.RecordBatch:
        sketch, held, _ = state
        return _packed(schema.names)(sketch.add(np.concatenate(held), weight) if held else sketch, key, kinds)

    parts = spread.repartition(*own).sortWithinPartitions(*own).mapInArrow(_by_group(len(own), fold, out), schema)
    return merged(parts, keys)


def quantiles(sketched: DataFrame, keys: list[str], at: dict[str, str]) -> DataFrame:
    """Reads percentiles off sketches: at maps an output name to the column with the share (0..1) of each row.

    Each output is a struct (low, high), the ends of the interval (one in a million wide) that holds the value.
    """
    pair = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    schema = T.StructType([*[sketched.schema[k] for k in keys], *[T.StructField(n, pair) for n in at]])
    kinds = {"low": pa.float64(), "high": pa.float64()}

    def invert(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: dict[str, list] = {n: [] for n in at}
            for row in batch.select([*at.values(), "sketch"]).to_pylist():
                sketch = Dyadic.unpack(row["sketch"])
                for n, c in at.items():
                    v = None if row[c] is None else sketch.quantile(row[c])
                    found[n].append(v and {"low": v[0], "high": v[1]})
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(v, pa.struct(kinds)) for v in found.values()]], names=schema.names)

    return sketched.mapInArrow(invert, schema)


def delivered(batches: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """(batch, columns) of the latest delivery of each batch of known id; deliveries of one time are told apart by content."""
    latest = W.partitionBy(batch).orderBy(F.desc(order), F.xxhash64(*columns))
    kept = batches.filter(F.col(batch).isNotNull()).select(batch, *columns, order)
    return kept.withColumn("__rn", F.row_number().over(latest)).filter(F.col("__rn") == 1).select(batch, *columns)


def outlying(batches: DataFrame, contexts: DataFrame, batch: str = "batch_id", keys: tuple[str, str] = ("context_id", "name"), values: str = "values", level: str = "nt2_quantile", order: str = "loaded_at") -> DataFrame:
    """Each batch with its median and its group's bounds at 1 - q and q, and on which side of them it lies.

    (batch, keys, median, lower, upper, side): side is below, above or null. A batch delivered more than once counts once
    (its latest delivery). Batches with a null id, a null key, a context without q, or no finite element take no part. The
    median is exact; a median in the same interval of encoded values as the bound is not outside.
    """
    context = keys[0]
    q = contexts.select(context, F.col(level).cast("double").alias("__q")).dropna().dropDuplicates([context])
    clean = batches.select(batch, *keys, order, finite(values).alias("__v"))
    one = delivered(clean, batch, order, [*keys, "__v"])
    own = staged(one.dropna(subset=list(keys)).filter(F.size("__v") > 0).join(q, context).select(batch, *keys, "__q", "__v", median("__v").alias("median")))
    made = sketches(own, list(keys), "__v", batch=batch).join(q, context)
    bounds = quantiles(made.select(*keys, "sketch", (1 - F.col("__q")).alias("p_low"), F.col("__q").alias("p_high")), list(keys), {"lower": "p_low", "upper": "p_high"})
    side = F.when(F.col("median") < F.col("lower.low"), "below").when(F.col("median") > F.col("upper.high"), "above")
    return own.select(batch, *keys, "median").join(bounds, list(keys)).withColumn("side", side)
