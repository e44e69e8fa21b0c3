"""Near-duplicate vectors by p-stable hashing and exact cosine checks.

A normalised vector gets, in each of several tables, the bucket of its quantised
Gaussian projections ``floor((a.x + b) / WIDTH)``; vectors that share a bucket
are compared exactly, in double precision.  The number of projections follows
the number of vectors (so buckets stay small), the number of tables the wanted
recall at the threshold.

Copies are one class with a weight.  Crowded buckets are cut into blocks and
every pair of blocks is one task.  A pair is counted in the first table that
brings it together, and a task returns link counts and a spanning forest, so
pairs are never emitted.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import Forest, checkpoint, components

WIDTH = 2.0
BLOCK = 1024     # vectors of one bucket that meet in one task
SEED = 20240501


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two points at this distance together."""
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(projections, tables): a far vector meets 0.1 others a table; near pairs are found with ``recall``."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(max(1e-9, 2 - 2 * cosine)))
    k = max(4, math.ceil(math.log(10 * max(2, n)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near ** k))


def buckets(x: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """uint32 bucket of every row in every table."""
    rng = np.random.default_rng((seed, x.shape[1]))
    a = rng.standard_normal((tables * k, x.shape[1]))
    b = rng.uniform(0, WIDTH, tables * k)
    q = np.floor((x @ a.T + b) / WIDTH).astype(np.int64)
    out = np.empty((len(x), tables), np.uint32)
    for t in range(tables):
        part = np.ascontiguousarray(q[:, t * k:(t + 1) * k])
        out[:, t] = [xxhash.xxh32_intdigest(row.tobytes()) for row in part]
    return out


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95,
                 recall: float = 0.99, seed: int = SEED) -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite number link
    with nothing, nor do vectors of different lengths.  Rows that repeat a
    vector are linked copies.  Rows without a key form no component (null).
    Extra columns are ignored; an empty table gives an empty table.
    """
    import pyarrow as pa

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def prepare(batches):
        for batch in batches:
            ids, made = batch.column(0), []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
                big = np.abs(x).max() if len(x) else 0.0
                if not len(x) or not np.isfinite(x).all() or big == 0:
                    made.append((None, None, None))
                    continue
                digest = xxhash.xxh3_128_digest(x.tobytes())
                x = x / big
                made.append((int.from_bytes(digest[:8], "big", signed=True),
                             int.from_bytes(digest[8:], "big", signed=True), (x / np.sqrt(x @ x)).tobytes()))
            h1, h2, unit = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                              pa.array(unit, pa.binary())], names=["id", "h1", "h2", "unit"])

    known = rows.mapInArrow(prepare, "id long, h1 long, h2 long, unit binary")
    members = checkpoint(known)
    classes = checkpoint(members.filter("unit is not null and id is not null").groupBy("h1", "h2")
                         .agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("unit").alias("unit")))
    k, tables = plan(classes.count(), cosine, recall)

    def sign(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sig: list = [None] * len(raw)
            for size in {len(b) for b in raw}:
                at = [i for i, b in enumerate(raw) if len(b) == size]
                got = buckets(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), -1), k, tables, seed)
                for i, s in zip(at, got):
                    sig[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.binary())], names=["rep", "w", "unit", "sig"])

    signed = checkpoint(classes.select("rep", "w", "unit").mapInArrow(sign, "rep long, w long, unit binary, sig binary"))

    def light(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sig = np.frombuffer(b"".join(raw), np.uint32).astype(np.int64)
            dim = np.repeat([len(b) for b in batch.column(2).to_pylist()], tables)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), tables)),
                 pa.array(np.tile(np.arange(tables, dtype=np.int64) << 32, len(raw)) + sig + (dim.astype(np.int64) << 44))],
                names=["rep", "bucket"])

    placed = signed.select("rep", "sig", "unit").mapInArrow(light, "rep long, bucket long")
    crowd = placed.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).alias("nb"))
    shared = placed.join(crowd, "bucket").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    tasks = shared.select("rep", "bucket", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    loaded = tasks.join(signed, "rep").groupBy("bucket", "x", "y")

    def compare(group: pa.Table) -> pa.Table:
        rep, w = group.column("rep").to_numpy(), group.column("w").to_numpy()
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(rep), -1)
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(len(rep), tables)
        mine = group.column("mine").to_numpy()
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        t = (group.column("bucket")[0].as_py() >> 32) & 0xFFF
        left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        links, forest = np.zeros(len(rep), np.int64), Forest()
        step = max(1, (1 << 21) // max(1, len(right)))
        for low in range(0, len(left), step):
            part = left[low:low + step]
            i, j = np.nonzero(unit[part] @ unit[right].T >= cosine)
            i, j = part[i], right[j]
            if x == y:
                i, j = i[i < j], j[i < j]
            for cut in range(0, len(i), 1 << 18):
                a, b = i[cut:cut + (1 << 18)], j[cut:cut + (1 << 18)]
                first = (sig[a] == sig[b]).argmax(1) == t  # counted where the pair first meets
                a, b = a[first], b[first]
                np.add.at(links, a, w[b])
                np.add.at(links, b, w[a])
                for p, q in zip(rep[a].tolist(), rep[b].tolist()):
                    forest.unite(p, q)
        some = np.flatnonzero(links)
        edges = forest.edges
        return pa.table({"a": pa.array([*rep[some].tolist(), *(p for p, _ in edges)], pa.int64()),
                         "b": pa.array([*rep[some].tolist(), *(q for _, q in edges)], pa.int64()),
                         "n": pa.array([*links[some].tolist(), *([0] * len(edges))], pa.int64())})

    found = checkpoint(loaded.applyInArrow(compare, "a long, b long, n long"))
    degree = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    whole = components(found.filter("a <> b"))
    facts = checkpoint(classes.select("h1", "h2", "rep", "w").join(degree, "rep", "left")
                       .join(whole.withColumnRenamed("node", "rep"), "rep", "left")
                       .select("h1", "h2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
                               F.coalesce("component", "rep").alias("c")))
    linked = members.filter("unit is not null and id is not null").join(facts, ["h1", "h2"]).select("id", "n", "c")
    alone = members.filter("unit is null or id is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return linked.unionByName(alone).select(
        F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"),
        (F.col("id") == F.col("c")).alias("kept"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q
  ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND p.norm > 0 AND q.norm > 0
  WHERE list_dot_product(p.e, q.e) / (p.norm * q.norm) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS c FROM v
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.c)
SELECT v.vec_id, CAST((SELECT count(*) FROM pairs WHERE pairs.a = v.vec_id) AS BIGINT) AS n_links,
       r.component_id, v.vec_id = r.component_id AS kept
FROM v JOIN (SELECT a, min(c) AS component_id FROM reach GROUP BY a) r ON r.a = v.vec_id
"""
