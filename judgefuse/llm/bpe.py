"""Byte-pair encoding and decoding with a given public vocabulary.

Each part of a partition gathers the pre-tokens it has not met, lays their
symbols out in one array and keeps an index *pair -> all its positions*.  Active
pairs are applied in ascending rank; a merge changes only the lists of the pairs
beside it.  Every pre-token of a text is then replaced by its ids.

No tokenizer is trained here, nothing is shuffled, and every task needs only
the vocabulary file (``path``, read by the driver and broadcast).
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgefuse.llm.common import give_back, text_bytes

FLUSH_BYTES = 2 << 20   # texts per output batch
REMEMBER = 250_000      # pre-tokens remembered per task; then forgotten, never skipped
MERGE_WORDS = 4096      # new pre-tokens that share one index: it stays in the processor's cache
NEVER = 1 << 60         # the rank of a pair that no merge joins
# The letters, numbers and spaces below U+0180, for the quick pattern.
LOW_LETTERS, LOW_NUMBERS, LOW_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\\x09-\\x0D\\x20\\x85\\xA0"
BEYOND_LOW = re.compile("[^\\x00-\u017F]")
# Fixed values: (first, last, first lower) of capitals that the library lowers and Python's tables do not know.
LATE_CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
                 (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B),
                 (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
LATE_LOWER = {c: low + c - first for first, last, low in LATE_CAPITALS for c in range(first, last + 1)}


# Letters and numbers that ``regex`` knows and the library's tables do not; to the library they are neither.
LATE_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D,
    0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1,
    0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475,
    0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123,
    0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0,
    0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]


def ranges_class(ranges) -> str:
    """The inside of a character class for (first, last, ...) ranges."""
    return "".join(f"\\U{r[0]:08X}-\\U{r[1]:08X}" for r in ranges)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(other)) for b in range(256)]


class Vocabulary:
    """The parts of a tokenizer file: ids, merge ranks, special strings, word end."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids.update(self.special)
        self.names = {i: t for t, i in self.ids.items()}
        self.rank_of: dict[tuple[int, int], int] = {}
        self.by_rank: list[tuple[int, int, int]] = []
        for r, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            pair = (self.ids[x], self.ids[y])
            self.rank_of[pair] = r
            self.by_rank.append((*pair, self.ids[x + y]))
        keys = np.array([x << 32 | y for x, y in self.rank_of] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([*self.rank_of.values()] or [NEVER], np.int64)[order]
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols], np.int32)
        self.last = np.array([self.ids[s + self.end] for s in symbols], np.int32)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]

    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NEVER where no merge joins it."""
        key = x.astype(np.int64) << 32 | y.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def decode(self, ids) -> str:
        """Without a decoder in its file the library joins token strings by a space."""
        return " ".join(map(self.names.__getitem__, ids))


def merge_words(words: list[str], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of every pre-token, by one pair occurrence index over all of them."""
    if not words:
        return []
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size + 1) - 1                      # a border follows every pre-token
    flat = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    start = vocab.inner[flat]
    start[ends - 1] = vocab.last[flat[ends - 1]]
    start[ends] = -1
    # The index: rank of a pair -> its positions, in ascending order.
    rank = vocab.pair_ranks(start[:-1], start[1:])
    at = np.flatnonzero(rank < NEVER)
    at = at[np.argsort(rank[at], kind="stable")]
    active, low = np.unique(rank[at], return_index=True)
    where = dict(zip(active.tolist(), (x.tolist() for x in np.split(at, low[1:]))))
    active = active.tolist()                            # sorted, so already a heap
    sym, after = start.tolist(), list(range(1, len(start) + 1))
    before = list(range(-1, len(start) - 1))
    rank_of, by_rank = vocab.rank_of.get, vocab.by_rank
    push, pop = heapq.heappush, heapq.heappop
    while active:
        now = pop(active)
        left, right, new = by_rank[now]
        spots = where.pop(now)
        spots.sort()
        for n, i in enumerate(spots):
            if sym[i] != left:
                continue
            j = after[i]
            if sym[j] != right:
                continue
            k = after[j]
            sym[i], sym[j] = new, -2                    # -2: swallowed
            after[i], before[k] = k, i
            earlier = False
            r = rank_of((new, sym[k]))
            if r is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
                    push(active, r)
                earlier = r < now
            h = before[i]
            if h >= 0:
                r = rank_of((sym[h], new))
                if r is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        push(active, r)
                    earlier = earlier or r < now
            if earlier and n + 1 < len(spots):          # a lower rank became active: it goes first
                where[now] = where.get(now, []) + spots[n + 1:]
                push(active, now)
                break
    done = np.array(sym, np.int32)
    alive = done >= 0
    cut = np.cumsum(alive)[ends - 1]
    return np.split(done[alive], cut[:-1])


class Encoder:
    """Pre-tokens of texts, and for each met so far its ids (int32 bytes)."""

    def __init__(self, vocab: Vocabulary):
        import regex
        self.vocab = vocab
        self.find = regex.compile(vocab.pattern.replace(r"\s", r"\p{White_Space}")).findall
        late = ranges_class(LATE_LETTERS)
        self.late = re.compile(f"[{late}{ranges_class(LATE_CAPITALS)}]").search
        self.find_late = regex.compile(
            vocab.pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|[{late}])")
            .replace(r"[\p{L}]", rf"[\p{{L}}--[{late}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{late}]]"),
            regex.V1).findall
        low = (vocab.pattern.replace(r"[\p{L}]", f"[{LOW_LETTERS}]").replace(r"[\p{N}]", f"[{LOW_NUMBERS}]")
               .replace(r"\p{L}", LOW_LETTERS).replace(r"\p{N}", LOW_NUMBERS).replace(r"\s", LOW_SPACES))
        self.find_low = re.compile(low).findall
        self.split = re.compile("(" + "|".join(map(re.escape, vocab.special)) + ")").split if vocab.special else None
        self.ids: dict[str, bytes] = {}

    def reset(self) -> None:
        self.ids = {t: np.int32(i).tobytes() for t, i in self.vocab.special.items()}

    def pretokens(self, text: str) -> list[str]:
        """NFC, lower case character by character (so no final sigma), then the
        file's pattern; strings of special tokens in the raw text are kept apart."""
        if self.split and "<" in text:
            parts = self.split(text)
            if len(parts) > 1:
                out = []
                for k, p in enumerate(parts):
                    out += [p] if k % 2 else self.pretokens(p)
                return out
        if text.isascii():
            return self.find_low(text.lower())
        text = unicodedata.normalize("NFC", text).replace("\u03A3", "\u03C3").lower()
        if not BEYOND_LOW.search(text):
            return self.find_low(text)
        return self.find_late(text.translate(LATE_LOWER)) if self.late(text) else self.find(text)

    def encode(self, texts: list[bytes]) -> list[list[str]]:
        """Pre-tokens of each text; afterwards ``ids`` holds all of them."""
        rows = [self.pretokens(t.decode("utf-8", "replace")) for t in texts]
        if not self.ids or len(self.ids) > REMEMBER:
            self.reset()
        new = set()
        for row in rows:
            new.update(row)
        new = [w for w in new if w not in self.ids]
        for low in range(0, len(new), MERGE_WORDS):
            part = new[low:low + MERGE_WORDS]
            for w, got in zip(part, merge_words(part, self.vocab)):
                self.ids[w] = got.tobytes()
        return rows


def encode_text(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids",
                decoded: str = "decoded") -> DataFrame:
    """``df`` plus ``ids`` (array<int>) and ``decoded`` (string) of its text column.

    Null and empty texts give an empty list and an empty string; texts of any
    length are encoded whole; repeated rows are encoded alike; an empty table
    gives an empty table; columns named like an output are replaced.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    with open(path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())]
    place = keep.index(text)
    schema = df.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType())).add(decoded, "string")

    def run(batches):
        give_back()  # of the tasks this worker ran before
        encoder = Encoder(Vocabulary(json.loads(spec.value)))
        gc.disable()  # many small objects, no cycles
        try:
            for batch in batches:
                size = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
                low = 0
                while low < len(size):
                    high = max(low + 1, int(low + np.searchsorted(np.cumsum(size[low:]), FLUSH_BYTES)))
                    part = batch.slice(low, high - low)
                    low = high
                    rows = encoder.encode(text_bytes(part.column(place)))
                    got = [b"".join(map(encoder.ids.__getitem__, row)) for row in rows]
                    del rows
                    ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
                    out_ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))
                    out_text = pa.array([encoder.vocab.decode(np.frombuffer(g, np.int32).tolist()) for g in got], pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, out_ids, out_text], names=[*keep, ids, decoded])
        finally:
            gc.enable()  # the worker goes on to other tasks
            del encoder
            give_back()

    return df.select(*keep).mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: number of ids and SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        key, F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
