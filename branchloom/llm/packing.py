"""Items packed into containers of fixed capacity along a space-filling curve."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchloom.llm.tokens import VOCABULARY, encoding, folder

DIMENSIONS = 4
BITS = 10
BUCKETS = 4096
#: Neighbours on the curve that are fitted together; open containers passed on to the next of these windows, and for how many windows.
WINDOW = 256
CARRIED = 64
CARRIED_WINDOWS = 4
ITEMS_PER_TASK = 200_000
SEED = 20240101


def projection() -> np.ndarray:
    """Fixed random directions of the hashed vectors' buckets."""
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def project(ids: list[int], directions: np.ndarray) -> np.ndarray:
    """A document's tokens, hashed to buckets, damped by their square root and projected to the unit cube."""
    if not ids:
        return np.full(DIMENSIONS, 0.5)
    bucket = (np.asarray(ids, dtype=np.int64) * 2654435761 >> 7) % BUCKETS
    which, n = np.unique(bucket, return_counts=True)
    w = np.sqrt(n).astype(np.float32)
    v = w @ directions[which] / np.linalg.norm(w)
    return 1 / (1 + np.exp(-1.7 * v))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points in the unit cube (n, d), by undoing rotations bit plane by bit plane."""
    n, d = points.shape
    x = np.minimum((points * (1 << bits)).astype(np.int64), (1 << bits) - 1).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | x[i] >> b & 1
    return key


def sized_on_curve(docs: DataFrame, item: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """item, n_tokens and place (Hilbert key) of every document, from its whole text."""
    path = os.path.join(folder(docs.sparkSession), vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, directions = encoding(path), projection()
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            points = np.array([project(x, directions) for x in ids]).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array(hilbert_key(points))], names=["item", "n_tokens", "place"])

    return docs.select(F.col(f"`{item}`").cast("bigint").alias("item"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "item bigint, n_tokens int, place bigint")


class _Packer:
    """Best fit of decreasing items into open containers, window by window. A container is only filled by the windows next to the one that opened it."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.window = capacity, first, 0
        self.open: list[tuple[int, int, int]] = []  # (free, number, window of its opening), sorted

    def fit(self, sizes: list[int]) -> list[int]:
        """Container numbers of the sizes, each at most the capacity."""
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            n = sizes[i]
            at = bisect_left(self.open, (n, -1, -1))
            if at < len(self.open):
                free, number, opened = self.open.pop(at)
            else:
                free, number, opened = self.capacity, self.next, self.window
                self.next += 1
            out[i] = number
            if free > n:
                insort(self.open, (free - n, number, opened))
        self.open = [x for x in self.open if self.window - x[2] < CARRIED_WINDOWS][-CARRIED:]
        self.window += 1
        return out


def pack(items: DataFrame, capacities: dict[str, int], items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Assign every item (item, n_tokens, place) to a container of each kind in ``capacities``.

    Result: container, capacity_tokens, container_no, item, piece_no,
    token_start, n_tokens. An item over the capacity is cut into full pieces
    with a container each and one rest, packed like an item; no other item is
    cut. Items are range-sorted by (kind, place, item) and ``WINDOW`` neighbours
    are packed at a time, best fit of decreasing sizes, with the emptiest
    containers left open for the next few windows. So a container holds
    neighbours on the curve. Equal places (copies) are ordered by item, so
    they spread over tasks.

    Defined results: an item without tokens takes no space and comes out once
    per kind with a null container_no and n_tokens 0; a null size counts as 0;
    no items give no rows. Container numbers are unique per kind.
    """
    spark = items.sparkSession
    kinds = spark.createDataFrame(sorted(capacities.items()), "container string, capacity_tokens int")
    rows = items.select("item", F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens"), "place").crossJoin(F.broadcast(kinds))  # a stated set of capacities against all items
    empty = rows.filter("n_tokens = 0").select("container", "capacity_tokens", F.lit(None).cast("bigint").alias("container_no"), "item", F.lit(0).alias("piece_no"), F.lit(0).alias("token_start"), "n_tokens")
    schema = "container string, capacity_tokens int, container_no bigint, item bigint, piece_no int, token_start int, n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packers: dict[str, _Packer] = {}
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kind, cap = held[0][2], held[0][3]
            packer = packers.setdefault(kind, _Packer(cap, base))
            out = []
            rest = []
            for item, n, _, _ in held:
                full = n // cap
                for p in range(full):
                    out.append((kind, cap, packer.next, item, p, p * cap, cap))
                    packer.next += 1
                if n % cap:
                    rest.append((item, full, n % cap))
            for (item, p, n), number in zip(rest, packer.fit([r[2] for r in rest])):
                out.append((kind, cap, number, item, p, p * cap, n))
            held.clear()
            columns = list(zip(*out))
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["container", "capacity_tokens", "container_no", "item", "piece_no", "token_start", "n_tokens"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (held[0][2] != row[2] or len(held) >= WINDOW):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    full = rows.filter("n_tokens > 0")
    parts = max(1, -(-items.count() * len(capacities) // items_per_task)) if capacities else 1
    on_curve = full.repartitionByRange(parts, "container", "place", "item").sortWithinPartitions("container", "place", "item")
    packed = on_curve.select("item", "n_tokens", "container", "capacity_tokens").mapInArrow(run, schema)
    return packed.unionByName(empty)
