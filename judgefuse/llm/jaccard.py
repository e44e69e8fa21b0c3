"""Exact Jaccard self-join on word shingles with a token-group matrix.

Documents with one shingle set are one class.  Classes are partitioned into
groups of similar ones (by the smallest hash among their prefix tokens that other
classes have too; crowded groups are cut into parts of about ``GROUP`` classes).  The matrix holds, per group, the union
of its members' *prefix* tokens: two sets that reach the threshold share ``SHARED``
tokens (or all they need, if fewer) among the rarest ``n - need + SHARED`` of
each, in any order that all sets follow.
Here the order is the document frequency of a shingle's rarest word, then the
frequency its words let expect, then its hash; so shingles of frequent words,
lines and passages come last.  A class takes part only if so many of its prefix
tokens are met in another class.

Groups of fitting sizes that share so many matrix tokens are candidates, if the
counts of their tokens in ``PARTS`` parts of the hash space allow the overlap.  The smaller one's members
become queries to the other: its whole token union bounds what any member can
share with a query, and only groups that qualify are opened and compared
exactly.  Tasks return a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import Forest, WordHash, checkpoint, components, give_back, gram_hashes, small_side, text_bytes

GROUP = 128            # classes of a group, and queries that meet it in one task
FREQUENT = 500_000     # words whose frequency the order knows: the bound of the broadcast table
SHARED = 8             # matrix tokens that candidate groups share (fewer for tiny sets)
PARTS = 32             # parts of the hash space whose token counts bound an overlap
FLUSH = 400_000        # words a task counts before it passes the counts on


def shingles(raw: bytes, hasher: WordHash, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text, letters A-Z in lower case."""
    return np.unique(gram_hashes(hasher.of(raw.lower().split()), n))


def set_mark(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def needed(n, percent: int):
    """Tokens that a set of ``n`` must share with any set that reaches the threshold."""
    return -(-percent * n // 100)


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hash, documents) of the most frequent words, by hash: all words of at
    least the document count that at most ``FREQUENT`` words reach."""
    import pyarrow as pa

    def count(batches):
        hasher, seen = WordHash(), {}

        def flush():
            some = [(w, n) for w, n in seen.items() if n > 1]  # a word met once is rare
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.int64()),
                                               pa.array([n for _, n in some], pa.int64())], names=["w", "n"])
        for batch in batches:
            for t in text_bytes(batch.column(0)):
                for w in set(t.lower().split()):
                    h = hasher[w]
                    seen[h] = seen.get(h, 0) + 1
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    counts = checkpoint(docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    # 256 rows at most: the histogram of the counts by quarters of powers of two
    step = F.floor(4 * F.log2("n")).cast("int")
    hist = sorted(((r["k"], r["count"]) for r in counts.groupBy(step.alias("k")).count().collect()), reverse=True)
    least, total = 1 << 30, 0
    for k, c in hist:
        total += c
        if total > FREQUENT:
            break
        least = k
    top = counts.filter(step >= least).toArrow()  # two columns of numbers, without rows of Python or a data frame
    w, n = (top.column(c).to_numpy() for c in ("w", "n"))
    order = np.argsort(w.astype(np.uint64))
    w, n = w.astype(np.uint64)[order], n[order]
    del top, order
    give_back()
    return w, n


class Group:
    """Token sets of one group: their union, and which members hold a token."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.union, at = np.unique(flat, return_inverse=True)
        member = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(at, kind="stable")
        self.member = member[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.union) + 1))

    def partners(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Members whose Jaccard with the query reaches ``percent``."""
        if not len(self.union):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        at = at[self.union[at] == query]
        if len(at) < needed(len(query), percent):
            return np.zeros(0, np.int64)  # the bound: no member can share enough
        low, n = self.start[at], self.start[at + 1] - self.start[at]
        take = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(self.member[take], minlength=len(self.sizes))
        return np.flatnonzero((shared > 0) & (100 * shared >= percent * (len(query) + self.sizes - shared)))


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id (smallest key reachable by links).

    Rows that share a key but hold different texts are documents of their own.  A text below ``n`` words is one shingle; null and empty texts have none and
    link with nothing, nor do rows with a null key (component null).  Repeated
    rows are copies.  Extra columns are ignored; an empty table stays empty.
    """
    return linked_rows(df, key, text, n, percent).select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def linked_rows(df: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(id, h: hash of the text, n, c, g: the component itself, since two may have one smallest key) of every row; see ``jaccard_components``.  Inside, a class goes by the hash of its set."""
    import pyarrow as pa

    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    known = df.sparkSession.sparkContext.broadcast(frequent_words(docs))

    def sign(batches):
        words, docs_of = known.value
        hasher = WordHash()
        for batch in batches:
            size, one, two, rare, parts = [], [], [], [], []
            for t in text_bytes(batch.column(1)):
                h = hasher.of(t.lower().split())
                u, at = np.unique(gram_hashes(h, n), return_index=True)
                size.append(len(u))
                if not len(u):
                    one.append(None), two.append(None), rare.append(None), parts.append(None)
                    continue
                f = np.zeros(len(h))
                if len(words):
                    i = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    f = np.where(words[i] == h, docs_of[i], 0)
                weight = np.rint(4 * np.log2(1 + f)).astype(np.int64)
                around = [weight[at + k] for k in range(min(n, len(h)))]
                least, expected = np.minimum.reduce(around), np.add.reduce(around)
                p = len(u) - needed(len(u), percent) + SHARED
                a, b = set_mark(u)
                one.append(a), two.append(b)
                rare.append(u[np.lexsort((u, expected, least))[:p]].astype(np.int64))
                parts.append(np.bincount((u >> np.uint64(59)).astype(np.int64), minlength=PARTS).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(rare, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))],
                names=["id", "h", "n", "s1", "s2", "rare", "parts"])

    signed = checkpoint(docs.mapInArrow(sign, "id long, h long, n long, s1 long, s2 long, rare array<long>, parts array<int>"))
    members = signed.select("id", "h", "n", "s1", "s2")
    classes = checkpoint(signed.filter("s1 is not null and id is not null").groupBy("s1", "s2").agg(
        F.min("id").alias("key"), F.col("s1").alias("rep"), *[F.first(c).alias(c) for c in ("n", "rare", "parts")]))
    least = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))  # tokens that a partner's prefix shares
    tokens = classes.select("rep", least.alias("least"), F.explode("rare").alias("token"))
    # counts that combine before the shuffle, then a join that can be split: no token's classes meet in one task
    often = tokens.groupBy("token").count().filter(F.col("count") > 1).select("token")
    shared = checkpoint(tokens.join(often, "token", "left_semi"))
    # near copies have most of their shared tokens in common, so one hash order gives most of them one smallest token
    alive = shared.groupBy("rep", "least").agg(F.count("*").alias("met"), F.min("token").alias("low")) \
        .filter(F.col("met") >= F.col("least")).select("rep", "low")
    kept = checkpoint(classes.drop("rare").join(alive, "rep"))
    crowded = kept.groupBy("low").count().filter(F.col("count") > GROUP).select(
        "low", F.ceil(F.col("count") / GROUP).alias("cuts"))
    cut = F.pmod(F.xxhash64("rep"), F.coalesce("cuts", F.lit(1)))
    grouped = checkpoint(kept.join(crowded, "low", "left").withColumn("gid", F.xxhash64("low", cut)).drop("cuts"))
    facts = grouped.groupBy("gid").agg(
        F.count("*").alias("m"), F.sum("n").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"),
        F.array(*[F.max(F.col("parts")[k]) for k in range(PARTS)]).alias("parts"))
    matrix = checkpoint(shared.join(grouped.select("rep", "gid"), "rep").groupBy("token", "gid").agg(F.min("least").alias("least")))
    one, two = (matrix.select("token", F.col("gid").alias(f"g{i}"), F.col("least").alias(f"least{i}")) for i in (1, 2))
    near = (one.join(two, "token").filter("g1 < g2").groupBy("g1", "g2").agg(
        F.count("*").alias("common"), F.least(F.min("least1"), F.min("least2")).alias("least")).filter("common >= least"))
    f1, f2 = (facts.select(*[F.col(c).alias(f"{c}{i}") for c in ("m", "size", "low", "high", "parts")], F.col("gid").alias(f"g{i}"))
              for i in (1, 2))
    # what two members share at most, and what the smallest two need: J >= t means overlap >= t (a + b) / (1 + t)
    most = F.aggregate(F.zip_with("parts1", "parts2", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    fits = ((100 * F.col("high1") >= percent * F.col("low2")) & (100 * F.col("high2") >= percent * F.col("low1"))
            & ((100 + percent) * most >= percent * (F.col("low1") + F.col("low2"))))
    swap = (F.col("size1") > F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("g1") > F.col("g2")))
    asks = checkpoint(near.join(f1, "g1").join(f2, "g2").filter(fits).select(
        F.when(swap, F.col("g2")).otherwise(F.col("g1")).alias("q"),
        F.when(swap, F.col("g1")).otherwise(F.col("g2")).alias("t"),
        F.when(swap, F.col("m2")).otherwise(F.col("m1")).alias("m")))
    live = (facts.filter("m > 1").select("gid").unionByName(asks.select(F.col("q").alias("gid")))
            .unionByName(asks.select(F.col("t").alias("gid"))).distinct())
    wanted = checkpoint(grouped.select("gid", F.col("key").alias("id"), F.col("rep").alias("mark")).join(live, "gid"))
    contents = checkpoint(docs.drop("h").join(small_side(wanted), "id").select("gid", "id", "mark", "text"))
    slices = asks.groupBy("t").agg(F.ceil(F.sum("m") / GROUP).alias("slices"))
    targets = (contents.join(slices.withColumnRenamed("t", "gid"), "gid", "left")
               .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1)))
               .drop("slices"))
    queries = (contents.withColumnRenamed("gid", "q").join(asks.select("q", "t"), "q").join(slices, "t")
               .select(F.col("t").alias("qgid"), F.pmod(F.xxhash64("mark"), F.col("slices")).alias("qslice"),
                       *[F.col(c).alias("q" + c) for c in ("id", "mark", "text")]))

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        hasher = WordHash()

        def sets(t: pa.Table, q: str = "") -> dict[int, np.ndarray]:
            out = {}
            for mark, chunk in zip(t.column(q + "mark").to_pylist(), (x for c in t.column(q + "text").chunks for x in text_bytes(c))):
                if mark not in out:
                    s = shingles(chunk, hasher, n)
                    if set_mark(s)[0] == mark:  # of rows that share an id, the class's own text
                        out[mark] = s
            return out

        forest = Forest()
        if len(held):
            mine = sets(held)
            ids, group = list(mine), Group(list(mine.values()))
            if held.column("slice")[0].as_py() == 0:
                for i, s in mine.items():
                    for j in group.partners(s, percent):
                        forest.unite(i, ids[j])
            for i, s in (sets(asked, "q") if len(asked) else {}).items():
                for j in group.partners(s, percent):
                    forest.unite(i, ids[j])
        return pa.table({"a": pa.array([a for a, _ in forest.edges], pa.int64()),
                         "b": pa.array([b for _, b in forest.edges], pa.int64())})

    edges = targets.groupBy("gid", "slice").cogroup(queries.groupBy("qgid", "qslice")).applyInArrow(compare, "a long, b long")
    whole = components(edges).withColumnRenamed("node", "rep")
    joined = checkpoint(classes.select("s1", "s2", "key", "rep").join(whole, "rep", "left")
                        .select("s1", "s2", "key", "component"))
    # written, so that a component with very many classes can be split in the join
    least_key = checkpoint(joined.filter("component is not null").groupBy("component").agg(F.min("key").alias("c")))
    labels = checkpoint(joined.join(least_key, "component", "left").select(
        "s1", "s2", F.coalesce("c", "key").alias("c"), F.coalesce("component", "s1").alias("g")))
    linked = members.filter("s1 is not null and id is not null").join(labels, ["s1", "s2"]).select("id", "h", "n", "c", "g")
    alone = members.filter("s1 is null or id is null").select("id", "h", "n", F.col("id").alias("c"), F.col("s1").alias("g"))
    return linked.unionByName(alone)


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each component: one with the smallest key.

    Rows with a null key stay.  Of rows that repeat key and text one stays; rows
    that share a key but hold different texts are documents of their own, each
    judged by its own component.  Texts without words are no copies of each other.
    """
    found = linked_rows(df, key, text, n, percent).filter("id = c")
    stay = (found.filter("n > 0").groupBy("g").agg(F.min("h").alias("__h"), F.first("id").alias("__id")).drop("g")
            .unionByName(found.filter("n = 0").select(F.col("h").alias("__h"), F.col("id").alias("__id"))).distinct())
    own = df.withColumns({"__id": F.col(key).cast("long"), "__h": F.xxhash64(text)})
    return (own.join(stay, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"]).select(*df.columns)
            .unionByName(df.filter(F.col(key).isNull())))
