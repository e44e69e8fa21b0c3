"""Helpers shared by the operators: words, hashes, blocks, checkpoints, components.

A *word* is a maximal run of ``[^\\x20\\x09-\\x0D]``; on UTF-8 bytes that is
exactly what ``bytes.split()`` yields, so the Python tasks work on bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64 constants


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset, a local master
    (tests) uses one below the warehouse; elsewhere that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``shared_folder``."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(array) -> list[bytes]:
    """An Arrow string column as bytes; null becomes empty."""
    import pyarrow as pa
    return [b or b"" for b in array.cast(pa.large_binary()).to_pylist()]


def give_back(cycles: bool = True) -> None:
    """Returns what a worker has freed to the machine: it goes on to other tasks, and an idle one would
    hold its largest block's memory beside them.  Without ``cycles`` it doesn't look for objects that hold each
    other (0.05 s each time)."""
    import ctypes
    import gc

    import pyarrow as pa
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


class WordHash(dict):
    """word (bytes) -> 63-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).astype(np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` consecutive words; a shorter, non-empty
    text gives one hash of its whole sequence."""
    if not len(h):
        return h
    k = len(h) - n + 1
    if k < 1:
        n, k = len(h), 1
    # The polynomial sum of h[i + j] * M2 ** (n - 1 - j), by doubling: spans of 1, 2, 4, ... words.
    acc, done, factor = None, 0, 1
    span, wide = h, 1
    while True:
        if n & wide:  # put this span behind what is done
            acc = span[done:done + k] if acc is None else acc * np.uint64(factor) + span[done:done + k]
            done += wide
        # factor of the next span: M2 ** (2 * wide)
        nxt = wide * 2
        if nxt > n:
            break
        span = span[:len(span) - wide] * np.uint64(pow(int(M2), wide, 1 << 64)) + span[wide:]
        wide, factor = nxt, pow(int(M2), nxt, 1 << 64)
    return mix(acc + np.uint64(n))


def small_side(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` (narrow rows) marked for a broadcast join if it has at most ``rows``; else unmarked, so it is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def n_blocks(df: DataFrame, text: str = "text", mb_per_block: int = 14) -> int:
    """How many blocks of about ``mb_per_block`` the texts fill (one scan)."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-size // (mb_per_block << 20)))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node of an edge list can reach.

    Alternates large-star and small-star steps.  Both are joins and ``min``
    aggregations that combine before the shuffle; a hub's share of a join is an
    ordinary skewed partition, which Spark splits; every round is checkpointed.
    """
    e = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .filter("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join below shuffles both sides and a hub's part can be split
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        new = checkpoint(small)
        # Stars only: no node is both a leaf and a centre, and nothing moved.
        open_ = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        many = new.groupBy("u").count().filter("count > 1").limit(1).count()
        e = new
        if not open_ and not many:
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
             .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


class Forest:
    """Union-find inside one task; ``edges`` is a spanning forest of what was united."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def unite(self, x: int, y: int) -> None:
        rx, ry = self.find(x), self.find(y)
        if rx != ry:
            self.parent[max(rx, ry)] = min(rx, ry)
            self.edges.append((x, y))
