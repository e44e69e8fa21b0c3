"""Removal of repeated passages with sharded Aho-Corasick automata.

A *window* is ``window`` consecutive words.  Texts are dealt to blocks of about
equal size; everything below is counted once per block before it is shuffled,
so a passage in a third of all rows costs one row per block.

1. *Anchors*: the smallest hash among a window's short word runs depends on the
   window alone, so equal windows share it.  Only anchors that occur twice in
   the corpus can belong to a recurring window; there are few anchors a text.
2. *Confirm*: the windows around recurring anchors are counted by a 64-bit hash;
   each recurring one gets its first start (smallest id, then position).
3. *Automata*: every block joins its recurring windows into passages, compiles
   them into one automaton (its shard) and streams all its texts through it.
   Words are spelled as fixed-length codes of their 63-bit hashes.  A located
   passage loses all words that start later than its first occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgefuse.llm.common import WordHash, block_of, give_back, gram_hashes, n_blocks, text_bytes

ANCHOR_WORDS = 5
NO_KEY = -(1 << 63)   # rows without a key count as the smallest


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of each window's anchor, hashes of all anchor-sized runs)."""
    k = min(ANCHOR_WORDS, window)
    g = gram_hashes(h, k)
    wide = window - k + 1
    n = len(h) - window + 1
    at = np.empty(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, wide)
    for low in range(0, n, 65536):
        part = view[low:low + 65536]
        at[low:low + len(part)] = part.argmin(1) + np.arange(low, low + len(part))
    return at, g


class Block:
    """The texts of one block as word hashes; words are held only one text at a time."""

    def __init__(self, table, key: str, text: str):
        self.ids = [NO_KEY if k is None else k for k in table.column(key).to_pylist()]
        self.column = table.column(text)
        hasher = WordHash()
        self.hashes = [hasher.of(w) for w in self.words()]

    def words(self):
        """The words of every text, in turn."""
        for chunk in self.column.chunks:
            for low in range(0, len(chunk), 256):
                for t in text_bytes(chunk.slice(low, 256)):
                    yield t.split()

    def runs(self, window: int):
        """(document, first window of each run of windows with one anchor, that anchor, number of windows)."""
        for d, h in enumerate(self.hashes):
            if len(h) >= window:
                at, g = anchors(h, window)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                yield d, first, g[at[first]], len(at)


def empty(*names: str) -> dict:
    return {n: np.zeros(0, np.int64) for n in names}


def deal(src: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """``src`` with ``__block``, by id and text: rows that share an id, or have none, spread as well."""
    place = F.struct(F.coalesce(F.col(key), F.lit(NO_KEY)), F.xxhash64(text))
    return src.withColumn("__block", block_of(place, blocks)).repartition(blocks, "__block")


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """``df`` plus ``n_words``, ``n_removed``, ``removed`` (array of [from, to) word spans)
    and ``kept_text`` (the kept words joined by one space).

    Null and empty texts have no words; texts below ``window`` words lose none.
    Rows that share an id count as one document at the same place, so an exactly
    repeated row loses no more than the first.  A null key counts as the
    smallest.  Columns named like an output are replaced; no row is dropped.
    """
    import ahocorasick
    import pyarrow as pa

    made = ("n_words", "n_removed", "removed", "kept_text")
    keep = [c for c in df.columns if c.lower() not in (*made, "__block")]
    src = df.select(*keep)
    blocks = max(n_blocks(src, text, 10), 2 * df.sparkSession.sparkContext.defaultParallelism)
    dealt = deal(src, key, text, blocks)
    by_block = dealt.groupBy("__block")

    def find_anchors(group: pa.Table) -> pa.Table:
        found = []
        for _, _, a, _ in Block(group, key, text).runs(window):
            found.append(a)
        a, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
        return pa.table({"block": pa.array(np.full(len(a), group.column("__block")[0].as_py(), np.int32)),
                         "anchor": pa.array(a.astype(np.int64)), "n": pa.array(np.minimum(n, 2).astype(np.int32))})

    seen = by_block.applyInArrow(find_anchors, "block int, anchor long, n int")
    recurring = (seen.withColumn("total", F.sum("n").over(Window.partitionBy("anchor")))
                 .filter("total > 1").select("block", "anchor"))

    def find_windows(docs: pa.Table, hits: pa.Table) -> pa.Table:
        out = {"block": np.zeros(0, np.int32), **empty("hash", "id", "start"), "n": np.zeros(0, np.int32)}
        if len(docs) and len(hits):
            want = np.sort(hits.column("anchor").to_numpy().astype(np.uint64))
            block = Block(docs, key, text)
            hashes, ids, starts = [], [], []
            for d, first, a, total in block.runs(window):
                i = np.minimum(np.searchsorted(want, a), len(want) - 1)
                hit = want[i] == a
                if hit.any():
                    at = np.flatnonzero(np.repeat(hit, np.diff(np.r_[first, total])))
                    hashes.append(gram_hashes(block.hashes[d], window)[at])
                    ids.append(np.full(len(at), block.ids[d], np.int64))
                    starts.append(at)
            if hashes:
                h, i, s = np.concatenate(hashes).astype(np.int64), np.concatenate(ids), np.concatenate(starts)
                order = np.lexsort((s, i, h))
                h, i, s = h[order], i[order], s[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                n = np.diff(np.r_[first, len(h)])
                out = {"block": np.full(len(first), hits.column("block")[0].as_py(), np.int32), "hash": h[first],
                       "id": i[first], "start": s[first], "n": np.minimum(n, 2).astype(np.int32)}
        return pa.table(out)

    windows = by_block.cogroup(recurring.groupBy("block")).applyInArrow(
        find_windows, "block int, hash long, id long, start long, n int")
    same = Window.partitionBy("hash")
    first = F.min(F.struct("id", "start")).over(same)
    confirmed = (windows.withColumn("total", F.sum("n").over(same)).withColumn("first", first)
                 .filter("total > 1")
                 .filter((F.col("n") > 1) | (F.col("first.id") != F.col("id")) | (F.col("first.start") != F.col("start")))
                 .select("block", "hash", F.col("first.id").alias("id"), F.col("first.start").alias("start")))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    fields += ", n_words long, n_removed long, removed array<struct<from:int,to:int>>, kept_text string"

    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(docs, key, text)
        automaton, how, holders = compile_passages(block, found, window) if len(docs) and len(found) else (None, None, set())
        n_words, n_removed, spans, texts = [], [], [], []
        for d, words in enumerate(block.words()):
            # a text without a recurring window holds no passage
            cuts = located(automaton, how, block.hashes[d], block.ids[d]) if d in holders else []
            spans.append([{"from": a, "to": b} for a, b in cuts])
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in cuts))
            kept, at = [], 0
            for a, b in cuts:
                kept += words[at:a]
                at = b
            kept += words[at:] if at else words
            texts.append(b" ".join(kept).decode("utf-8", "replace"))
        out = docs.drop_columns(["__block"])
        out = out.append_column("n_words", pa.array(n_words, pa.int64()))
        out = out.append_column("n_removed", pa.array(n_removed, pa.int64()))
        out = out.append_column("removed", pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))))
        out = out.append_column("kept_text", pa.array(texts, pa.string()))
        del block, automaton, how, holders, texts, spans
        give_back()
        return out

    def compile_passages(block: Block, found: pa.Table, window: int):
        """The block's automaton (each passage's value: first id, first start, words), how
        words are spelled, and the documents that hold recurring windows."""
        hashes = found.column("hash").to_numpy()
        order = np.argsort(hashes)
        hashes = hashes[order]
        first_id, first_at = found.column("id").to_numpy()[order], found.column("start").to_numpy()[order]
        passages: dict[tuple[int, int, int, int], tuple[int, int]] = {}  # first id, first start, words, hash: ids may be shared
        holders = set()
        for d, h in enumerate(block.hashes):
            if len(h) < window:
                continue
            w = gram_hashes(h, window).astype(np.int64)
            i = np.minimum(np.searchsorted(hashes, w), len(hashes) - 1)
            at = np.flatnonzero(hashes[i] == w)
            if not len(at):
                continue
            holders.add(d)
            fi, fs = first_id[i[at]], first_at[i[at]]
            new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(fi) != 0) | (np.diff(fs) != 1)])
            for a, b in zip(new, np.r_[new[1:], len(at)]):
                if (fi[a], fs[a]) != (block.ids[d], at[a]):  # not the first occurrence itself
                    mark = hash(w[at[a:b]].tobytes())
                    passages.setdefault((int(fi[a]), int(fs[a]), int(b - a) + window - 1, mark), (d, int(at[a])))
        if not passages:
            return None, None, set()
        # the passages' words by number, in the order of their hashes
        codes = np.unique(np.concatenate([block.hashes[d][s:s + n] for (_, _, n, _), (d, s) in passages.items()]))
        digits = 1
        while 64 ** digits <= len(codes) + 1:
            digits += 1

        def spell(h: np.ndarray) -> str:
            i = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
            ids = np.where(codes[i] == h, i + 1, 0)  # 0: in no passage
            out = np.empty((len(ids), digits), np.uint32)
            for k in range(digits):
                out[:, k] = 0x100 + (ids >> (6 * k) & 63)
            return out.tobytes().decode("utf-32-le")

        automaton = ahocorasick.Automaton()
        for (fi, fs, n, _), (d, s) in passages.items():
            automaton.add_word(spell(block.hashes[d][s:s + n]), (fi, fs, n))
        automaton.make_automaton()
        return automaton, (spell, digits), holders

    def located(automaton, how, hashes: np.ndarray, own: int) -> list[tuple[int, int]]:
        """Word spans of a text that a passage with an earlier start covers."""
        spell, digits = how
        spans = []
        for end, (fi, fs, n) in automaton.iter(spell(hashes)):
            if (end + 1) % digits == 0:
                stop = (end + 1) // digits
                if (fi, fs) < (own, stop - n):
                    spans.append((stop - n, stop))
        spans.sort()
        out: list[tuple[int, int]] = []
        for a, b in spans:
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    return by_block.cogroup(confirmed.groupBy("block")).applyInArrow(cut, fields)


def digests(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    return cut.select(key, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
