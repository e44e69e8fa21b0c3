"""Removal of repeated byte passages with run-length compressed suffix indexes.

A byte goes if a string of ``window`` bytes that covers it starts anywhere else
in the table.  Texts are dealt to blocks of about equal size.

1. *Contexts*: the smallest hash among a window's short byte runs (its anchor)
   depends on the window alone, so equal windows share anchor and offset.  The
   consecutive windows of one anchor are a *context*: at most twice the window
   long.  Every block reports its different contexts once, by two hashes.
2. *Copies* are aggregated before anything is moved: a context that occurs twice
   is marked whole, and an anchor with a single context needs no index.
3. *Index*: the different contexts of all other recurring anchors are dealt by
   anchor to shards of bounded size.  A shard sorts its suffixes, keeps the
   Burrows-Wheeler transform as runs, and samples the suffix at both ends of
   every run.  Only there the match with the neighbouring suffix is measured;
   inside a run the end of the match stands still, so one pass over the shard's
   text streams the matching statistics of every position against all others.
   Positions whose match is ``window`` bytes or longer are marked.
4. *Crowded* anchors (over ``CROWD`` different contexts) would not fit a shard:
   their contexts are split by longer anchors, down to single windows if need be.
5. The marks go back to the blocks, which cut their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import block_of, checkpoint, gram_hashes, mix, n_blocks

GRAM = 32              # bytes of an anchor
PIECE = 1 << 17        # window starts that are hashed at a time
SHARD = 1 << 20        # bytes of contexts per index
CROWD = 2048           # different contexts of an anchor that one shard may hold
NO_KEY = -(1 << 63)
_RNG = np.random.default_rng(13)
BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)           # a random value per byte, for anchors
BYTE2 = _RNG.integers(0, 1 << 64, 256, np.uint64)          # and another one for contexts
BASE = int(_RNG.integers(0, 1 << 62)) * 4 + 3              # odd, so that it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


class Texts:
    """The texts of one Arrow table as one byte array; null is empty."""

    def __init__(self, column):
        import pyarrow as pa
        import pyarrow.compute as pc
        array = pc.fill_null(column.cast(pa.large_string()), "").combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
        bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1] \
            if len(array) else np.zeros(1, np.int64)
        raw = array.buffers()[2] if len(array) else None
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = data[bounds[0]:bounds[-1]]
        self.bounds = bounds - bounds[0]


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p)


class Contexts:
    """The contexts of some texts, in text order: ``first`` (first byte), ``stop``
    (behind the last byte), ``pos`` (the anchor's place), and their hashes."""

    def __init__(self, texts: Texts, window: int):
        data, bounds = texts.data, texts.bounds
        gram = min(GRAM, max(1, window // 4))
        wide = window - gram + 1                        # anchors to choose from
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        # the last window start of every text that has a window
        length = np.diff(bounds)
        long = np.flatnonzero(length >= window)
        self.begin, self.last = bounds[:-1][long], bounds[1:][long] - window
        total = len(data)
        size = min(PIECE, total) + 2 * window + gram + 2
        up, down = powers(BASE, size + 1), powers(INVERSE, size + 1)
        for lo in range(0, total, PIECE):
            hi = min(lo + PIECE, total)
            a, b = max(lo - 1, 0), min(hi + wide + 1, total - window + 1)   # window starts looked at
            if b <= a:
                continue
            k0, k1 = np.searchsorted(self.last, a), np.searchsorted(self.begin, b)
            if k0 >= k1:
                continue
            valid = np.zeros(b - a + 1, np.int8)
            np.add.at(valid, np.maximum(self.begin[k0:k1] - a, 0), 1)
            np.add.at(valid, np.minimum(self.last[k0:k1] + 1 - a, b - a), -1)
            valid = np.cumsum(valid[:-1]).astype(bool)
            raw = data[a:b + window - 1]
            g = gram_hashes(BYTE[raw], gram)
            at = leftmost_minimum(g, wide)
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(valid)] - 1        # last window of each run
            doc = np.searchsorted(self.begin, starts + a, "right") - 1
            ends = np.minimum(ends, self.last[doc] - a)
            keep = (starts + a >= lo) & (starts + a < hi)
            starts, ends = starts[keep], ends[keep]
            pos = at[starts]
            sums = np.r_[np.uint64(0), np.cumsum(BYTE2[raw] * up[:len(raw)])]
            ctx = (sums[ends + window] - sums[starts]) * down[starts]
            ctx = mix(ctx + mix((ends - starts).astype(np.uint64) * np.uint64(1024) + (pos - starts).astype(np.uint64) + np.uint64(1)))
            for c, v in zip(cols, (starts + a, ends + a + window, pos + a, g[pos], ctx)):
                c.append(v)
        whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
        self.first, self.stop, self.pos = whole[:3]
        self.anchor, self.ctx = (x.astype(np.uint64).view(np.int64) for x in whole[3:])
        self.window = window

    def __len__(self) -> int:
        return len(self.first)

    def both(self) -> np.ndarray:
        """One value per context, to look it up within a block."""
        return one_key(self.anchor, self.ctx)


def one_key(anchor: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix(anchor.astype(np.int64).view(np.uint64) * np.uint64(3) + ctx.astype(np.int64).view(np.uint64))


def leftmost_minimum(g: np.ndarray, wide: int) -> np.ndarray:
    """For every run of ``wide`` values the place of its smallest, the leftmost of equal ones."""
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    low = ((g >> bits) << bits) | np.arange(len(g), dtype=np.uint64)
    have, n = 1, len(g) - wide + 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < wide:
        low = np.minimum(low[:n], low[wide - have:wide - have + n])
    return (low[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


# ---- the index of one shard ------------------------------------------------------------------------
SYMBOLS = 7  # of nine bits, in one key


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of a collection of byte strings.

    Every string ends in a separator of its own.  ``heads`` are the ranks at which
    a run begins; ``head_at`` and ``end_at`` the sampled suffixes at the begin of
    every run and at the end of the run before it; ``common`` what the two share.
    """

    def __init__(self, strings: list[bytes]):
        codes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.r_[0, np.cumsum(size + 1)[:-1]]
        self.sep = self.start + size
        codes[self.sep] = 0
        self.codes, self.n = codes, len(codes)
        self.left = np.repeat(self.sep, size + 1) - np.arange(self.n)  # symbols before the separator
        key = np.zeros(self.n, np.int64)
        for j in range(SYMBOLS):
            key[:self.n - j] |= codes[j:] << 9 * (SYMBOLS - 1 - j)
        # nothing behind the separator counts
        masks = np.array([((1 << 63) - 1) & ~((1 << 9 * (SYMBOLS - j)) - 1) for j in range(SYMBOLS + 1)], np.int64)
        self.key = key & masks[np.minimum(self.left, SYMBOLS)]
        order = self.sort()
        before = codes[order - 1]                        # 0 at a string's begin
        new = np.ones(self.n, bool)
        new[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(new)
        self.symbols = before[self.heads]
        inner = self.heads[1:]
        self.head_at, self.end_at = order[inner], order[inner - 1]
        self.first_at, self.last_at = int(order[0]), int(order[-1])
        self.common = self.shared(self.head_at, self.end_at)

    def sort(self) -> np.ndarray:
        """Suffixes in order, by prefix doubling; only unsettled ranges are sorted again."""
        order = np.argsort(self.key, kind="stable")
        sorted_key = self.key[order]
        new = np.ones(self.n, bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (self.left[order[1:]] < SYMBOLS)
        del sorted_key
        rank = np.empty(self.n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(self.n), 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots, h = np.flatnonzero(tied), SYMBOLS
        while len(slots):
            at = order[slots]
            key = rank[at] * np.int64(self.n) + rank[at + h]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[slots] = at
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots, h = slots[tied], 2 * h
        return order

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b``; separators never match."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            i, j = a[live] + out[live], b[live] + out[live]
            same = (self.key[i] == self.key[j]) & (self.left[i] >= SYMBOLS)
            stop = live[~same]
            x, y = self.key[i[~same]], self.key[j[~same]]
            open_ = np.ones(len(stop), bool)
            for k in range(SYMBOLS):
                u, v = x >> 9 * (SYMBOLS - 1 - k) & 511, y >> 9 * (SYMBOLS - 1 - k) & 511
                open_ &= (u == v) & (u > 0)
                out[stop] += open_
            live = live[same]
            out[live] += SYMBOLS
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest string from there that also starts elsewhere.

        The match with a neighbouring suffix ends where that of the position
        before ends, unless the position is sampled: so the sampled ends are
        carried along the text."""
        place = np.arange(self.n)
        best = np.zeros(self.n, np.int64)
        for at, edge in ((self.head_at, self.first_at), (self.end_at, self.last_at)):
            known = np.zeros(self.n, np.int64)
            known[edge] = edge
            known[at] = at + self.common
            sampled = np.zeros(self.n, bool)
            sampled[edge] = sampled[at] = True
            source = np.maximum.accumulate(np.where(sampled, place, 0))
            np.maximum(best, known[source] - place, out=best)
        return best

    def long_matches(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, from, to): runs of places in a string at which ``window`` bytes also start elsewhere."""
        hit = self.matching_statistics() >= window
        edge = np.diff(np.r_[0, hit.astype(np.int8), 0])
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        s = np.searchsorted(self.start, low, "right") - 1
        return s, low - self.start[s], high - self.start[s]


# ---- the jobs --------------------------------------------------------------------------------------
def settle(strings: DataFrame, window: int, step: int | None = None) -> DataFrame:
    """(anchor, ctx, from, to): places in a context whose ``window`` bytes also start in another
    context of ``strings`` (anchor, ctx, at: the anchor's place, string, twice).  Contexts marked ``twice`` are left out.

    Anchors with up to ``CROWD`` contexts go to shards, each with an index of its
    own.  The contexts of the others are split into parts of ``step`` windows,
    and what all windows of a part share is a longer anchor: equal parts
    collapse, parts with an anchor of their own match nothing, and the rest is
    settled in the same way, in the end with parts of a single window.
    """
    import pyarrow as pa

    step = max(1, (window if step is None else step) // 8)
    # written, so that a crowded anchor's part of the join can be split
    crowds = checkpoint(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("anchor"))
    few = strings.join(crowds, "anchor", "left_anti")
    size = few.agg(F.sum(F.length("string"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))

    def index(group: pa.Table) -> pa.Table:
        twice = group.column("twice").to_numpy()
        s, low, high = RunIndex(group.column("string").to_pylist()).long_matches(window)
        new = ~twice[s]                                  # the others are marked whole
        s, low, high = s[new], low[new], high[new]
        return pa.table({"anchor": group.column("anchor").to_numpy()[s], "ctx": group.column("ctx").to_numpy()[s],
                         "from": pa.array(low.astype(np.int32)), "to": pa.array(high.astype(np.int32))})

    found = (few.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
             .groupBy("shard").applyInArrow(index, "anchor long, ctx long, from int, to int"))
    if not crowds.limit(1).count():
        return found

    def split(batches):
        for batch in batches:
            rows = []
            for a, c, at, s, twice in zip(*(batch.column(n).to_pylist() for n in ("anchor", "ctx", "at", "string", "twice"))):
                low, n = 0, len(s) - window + 1
                while low < n:
                    # windows whose distance to the anchor falls into one step, wherever the context begins
                    place = (at - low) // step
                    high = min(n, at - place * step + 1)
                    shared = s[at - place * step:at - place * step - step + 1 + window]
                    string = s[low:high + window - 1]
                    core = xxhash.xxh3_64_intdigest(shared, seed=(a ^ place) & (1 << 64) - 1) - (1 << 63)
                    rows.append((a, c, low, core, xxhash.xxh3_64_intdigest(string, seed=at - low) - (1 << 63), at - low, string, twice))
                    low = high
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [()] * 8, (
                pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))],
                names=["anchor", "ctx", "low", "core", "part", "at", "string", "twice"])

    many = strings.join(crowds, "anchor", "left_semi")
    parts = checkpoint(many.mapInArrow(
        split, "anchor long, ctx long, low int, core long, part long, at int, string binary, twice boolean"))
    kinds = checkpoint(parts.groupBy("core", "part").agg(
        ((F.count(F.lit(1)) > 1) | F.bool_or("twice")).alias("twice"), F.min("string").alias("string"), F.min("at").alias("at")))
    whole = kinds.filter("twice").select("core", "part", F.lit(0).alias("from"), (F.length("string") - window + 1).alias("to"))
    if step > 1:  # a single window is all that its parts share
        mixed = checkpoint(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
        rest = kinds.join(mixed, "core", "left_semi").withColumnsRenamed({"core": "anchor", "part": "ctx"})
        whole = whole.unionByName(settle(checkpoint(rest), window, step).withColumnsRenamed({"anchor": "core", "ctx": "part"}))
    inside = parts.filter("not twice").join(checkpoint(whole), ["core", "part"])
    return found.unionByName(inside.select("anchor", "ctx", (F.col("from") + F.col("low")).alias("from"),
                                           (F.col("to") + F.col("low")).alias("to")))


RANGES = "array<struct<from:int,to:int>>"


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """``df`` plus ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``removed`` (array of [from, to) byte spans) and ``kept`` (binary: what remains).

    Null and empty texts have no bytes; texts below ``window`` bytes lose none.
    Which row comes first does not matter: all places of a repeated string go,
    so repeated rows go whole (from ``window`` bytes on).  The key only deals
    rows to blocks; it may be null or repeated.  Columns named like an output
    are replaced; no row is dropped, and an empty table stays empty.
    """
    import pyarrow as pa

    made = ("n_bytes", "n_removed", "n_spans", "removed", "kept")
    keep = [c for c in df.columns if c.lower() not in (*made, "__block")]
    src = df.select(*keep)
    blocks = max(n_blocks(src, text, 10), 2 * df.sparkSession.sparkContext.defaultParallelism)
    place = F.struct(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)), F.xxhash64(text))
    dealt = src.withColumn("__block", block_of(place, blocks)).repartition(blocks, "__block")
    by_block = dealt.groupBy("__block")

    def report(batches):
        for batch in batches:
            texts = Texts(pa.chunked_array([batch.column(1)]))
            c = Contexts(texts, window)
            row = np.searchsorted(texts.bounds, c.first, "right") - 1
            block = batch.column(0).to_numpy()[row]
            _, i, n = np.unique(mix(c.both() + block.astype(np.uint64)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[i], pa.int32()), pa.array(c.anchor[i]), pa.array(c.ctx[i]),
                 pa.array(np.minimum(n, 2), pa.int32())], names=["block", "anchor", "ctx", "n"])

    # read where the texts lie: only hashes are moved here
    seen = checkpoint(src.withColumn("__block", block_of(place, blocks)).select("__block", text)
                      .mapInArrow(report, "block int, anchor long, ctx long, n int"))
    # An anchor with one context at one place is alone; with one context at several places all of them are copies.
    anchors = checkpoint(seen.groupBy("anchor").agg(F.sum("n").alias("total"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
                         .filter("total > 1").select("anchor", (F.col("low") == F.col("high")).alias("copies")))
    met = checkpoint(seen.join(anchors, "anchor"))
    kinds = checkpoint(met.filter("not copies").groupBy("anchor", "ctx").agg(
        (F.sum("n") > 1).alias("twice"), F.min("block").alias("block")))
    fetched = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("at", pa.int32()), ("string", pa.binary()), ("twice", pa.bool_())])

    def fetch(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(wanted):
            return fetched.empty_table()
        texts = Texts(docs.column(text))
        c = Contexts(texts, window)
        keys, i = np.unique(c.both(), return_index=True)
        i = i[np.searchsorted(keys, one_key(wanted.column("anchor").to_numpy(), wanted.column("ctx").to_numpy()))]
        strings = [texts.data[a:b].tobytes() for a, b in zip(c.first[i], c.stop[i])]
        return pa.table([wanted.column("anchor"), wanted.column("ctx"), pa.array((c.pos - c.first)[i], pa.int32()), pa.array(strings, pa.binary()),
                         wanted.column("twice")], schema=fetched)

    strings = checkpoint(by_block.cogroup(kinds.groupBy("block")).applyInArrow(
        fetch, "anchor long, ctx long, at int, string binary, twice boolean"))
    whole = kinds.filter("twice").select("anchor", "ctx", F.lit(0).alias("from"), F.lit(2 * window).alias("to"))
    verdicts = checkpoint(whole.unionByName(settle(strings, window)).groupBy("anchor", "ctx").agg(
        F.collect_list(F.struct("from", "to")).alias("ranges")))
    marks = (met.filter("not copies").join(verdicts, ["anchor", "ctx"]).select("block", "anchor", "ctx", "ranges")
             .unionByName(met.filter("copies").select(
                 "block", "anchor", "ctx", F.array(F.struct(F.lit(0).alias("from"), F.lit(2 * window).alias("to"))).alias("ranges"))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    fields += f", n_bytes long, n_removed long, n_spans long, removed {RANGES}, kept binary"

    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        texts = Texts(docs.column(text) if len(docs) else pa.chunked_array([pa.array([], pa.string())]))
        data, bounds = texts.data, texts.bounds
        gone = np.zeros(len(data) + 1, bool)             # the last entry ends a span
        if len(found) and len(data):
            c = Contexts(texts, window)
            order = np.argsort(keys := one_key(found.column("anchor").to_numpy(), found.column("ctx").to_numpy()))
            keys = keys[order]
            ask = c.both()
            hit = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
            which = np.flatnonzero(keys[hit] == ask)
            ranges = found.column("ranges").combine_chunks()
            ranges = pa.concat_arrays(ranges.chunks) if isinstance(ranges, pa.ChunkedArray) else ranges
            edges = ranges.offsets.to_numpy()
            inner = ranges.values
            low, high = inner.field("from").to_numpy(), inner.field("to").to_numpy()
            mark = np.zeros(len(data) + 1, np.int32)
            row = order[hit[which]]
            n = edges[row + 1] - edges[row]
            take = np.repeat(edges[row] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            start, last = np.repeat(c.first[which], n), np.repeat(c.stop[which] - window, n)
            a = start + low[take]
            b = np.minimum(start + high[take] - 1, last) + window
            np.add.at(mark, a, 1)
            np.add.at(mark, b, -1)
            gone = np.cumsum(mark) > 0
        count = np.r_[0, np.cumsum(gone[:-1])]
        n_removed = count[bounds[1:]] - count[bounds[:-1]]
        spans, kept = [], []
        for a, b, n in zip(bounds[:-1], bounds[1:], n_removed):
            if not n:
                spans.append([])
                kept.append(data[a:b].tobytes())
                continue
            own = gone[a:b]
            edge = np.diff(np.r_[0, own.astype(np.int8), 0])
            spans.append([{"from": int(x), "to": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kept.append(data[a:b][~own].tobytes())
        out = docs.drop_columns(["__block"])
        out = out.append_column("n_bytes", pa.array(np.diff(bounds), pa.int64()))
        out = out.append_column("n_removed", pa.array(n_removed, pa.int64()))
        out = out.append_column("n_spans", pa.array([len(s) for s in spans], pa.int64()))
        out = out.append_column("removed", pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))))
        return out.append_column("kept", pa.array(kept, pa.binary()))

    return by_block.cogroup(marks.groupBy("block")).applyInArrow(cut, fields)


def digests(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    return cut.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], window: int) -> list[tuple[int, int, int, str]]:
    """What ``digests`` says of a few texts, by a dictionary of all their strings (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i:i + window]] = seen.get(t[i:i + window], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                gone[i:i + window] = True
        edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
