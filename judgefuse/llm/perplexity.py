"""Quality classifier: interpolated modified Kneser-Ney over words, perplexity, language quantiles.

The symbols are words (``common.WORD_PATTERN``, unchanged) and n-grams have order 3;
two marks stand before every text.  Texts are packed into chunks once.  A trigram goes
by its middle word: that word's shard holds all pairs that end or begin with it and all
trigrams around it, so that counts, continuation counts and context totals are complete
in it.  A word with over half a shard's share of all words is dealt by its pairs instead: such a
trigram goes to the shard of its first two words, and if trusted to that of its last two as well.  Each chunk
sends a shard its different pairs and trigrams once, with the trusted counts, and gets the whole
counts back in the order sent; the probabilities are worked out in the chunk, once for each
different n-gram.  Shards are done in ``PASSES`` turns, so that the disk holds one part of the
n-grams at a time; each turn leaves its answers there, so a later turn has fewer shards.  Chunks ask for
their words and get their answers in ``PARTS`` turns of whole chunks for the same reason.

A word is told by 40 bits of a hash, a pair by 48 (to choose its shard) or 64.  A part of the trusted
texts (``HELD_OUT``) is not counted: a document passes where its perplexity is at most a
high quantile of those texts of its language; a short text's mean is steadied
with some words of that language's median.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgefuse.llm.common import M1, M2, WordHash, checkpoint, give_back, mix, small_side, text_bytes

QUANTILE, SLACK = 0.995, 1.1     # of the held-out trusted texts' perplexity; tolerance above it
HELD_OUT = 10                    # one trusted text in so many is not counted
STEADY = 2                       # words of the language's median that steady a short text's mean
SMALL_LANGUAGE = 50              # languages with fewer held-out texts use the quantile of all
CHUNK_BYTES = 8 << 20            # of text in a chunk
PASSES = 8                       # turns in which the shards are done
TAPER = 0.86                     # a turn's share of the shards by that of the turn before it
PARTS = 6                        # turns in which the chunks get their answers
START = 0                        # the mark before a text, as a word
COMMON = 8192                    # a chunk names the words that are one in so many of its own
WORD_BYTES, INDEX_BYTES = 5, 4
WORD_MASK, LOW = np.uint64((1 << 40) - 1), np.uint64((1 << 32) - 1)
#: What a chunk sends a shard: pairs by their second word (those words, pairs of each, first words), pairs by their first
#: word, trigrams as numbers of both pairs (steps, trusted count); of dealt words: number of the pair before, last word,
#: count; number of the pair behind, first word.
CELL = (WORD_BYTES, INDEX_BYTES, WORD_BYTES, WORD_BYTES, INDEX_BYTES, WORD_BYTES, INDEX_BYTES, INDEX_BYTES, INDEX_BYTES,
        INDEX_BYTES, WORD_BYTES, INDEX_BYTES, INDEX_BYTES, WORD_BYTES)
REPLY = (WORD_BYTES,) * 6        # trigrams' counts; spare, once, twice, more of the pairs before; counts of the pairs behind
STATS = ("n", "total", "once", "twice", "more")  # of a word
SUMS = 7                         # over words: n, how many have any, 1, 2, 3, 4, over 2


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * M2 + b + np.uint64(2))


def pack(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte: equal high bytes compress."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    if raw:
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def split(raw: bytes, k: int) -> list[np.ndarray]:
    """The ``k`` lists of one length that lie packed behind each other."""
    size = len(raw) // k
    return [unpack(raw[i * size:(i + 1) * size], WORD_BYTES) for i in range(k)]


def encode(lists: list[np.ndarray], widths: tuple[int, ...]) -> bytes:
    import pyarrow as pa

    raw = np.array([len(x) for x in lists], "<i8").tobytes() + b"".join(pack(x, k) for x, k in zip(lists, widths))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def decode(sent: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    import pyarrow as pa

    raw = pa.decompress(sent[8:], int.from_bytes(sent[:8], "little"), "zstd", asbytes=True)
    at, out = 8 * len(widths), []
    for n, k in zip(np.frombuffer(raw, "<i8", len(widths)).tolist(), widths):
        out.append(unpack(raw[at:at + n * k], k))
        at += n * k
    return out


def spare(total: np.ndarray, once: np.ndarray, twice: np.ndarray, more: np.ndarray) -> np.ndarray:
    """What a total has over the least that its classes come to: mostly 0, so it is sent in the total's place."""
    return total - once - 2 * twice - 3 * more


def totalled(over: np.ndarray, once: np.ndarray, twice: np.ndarray, more: np.ndarray) -> np.ndarray:
    return over + once + 2 * twice + 3 * more


def spans(bits: int) -> list[tuple[int, int]]:
    """The shards of each turn, fewer and fewer."""
    share = TAPER ** np.arange(PASSES)
    cuts = np.round(np.cumsum(share) / share.sum() * (1 << bits)).astype(int).tolist()
    return list(zip([0, *cuts], cuts))


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of whole numbers, their sign in the lowest bit."""
    d = np.diff(x.astype(np.int64), prepend=0)
    return (d << 1) ^ (d >> 63)


def summed(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int64)
    return np.cumsum((d >> 1) ^ -(d & 1))


class Grams:
    """The different pairs and trigrams of a chunk, in the order in which shards get them.

    ``a``, ``b``: numbers of each pair's words; ``behind``: pairs by the shard of their first word, ``before``:
    pairs by the shard of their second (dealt words last); ``tri``: trigrams as (place in ``before``, place in ``behind``), ascending;
    ``which``: the trigram of each word in ``at``.  With a span of shards, only the words that it concerns are looked at."""

    def __init__(self, packed: dict, bits: int, dealt: np.ndarray, span: tuple[int, int] | None = None):
        self.size, self.words, numbers = numbers_of(packed)
        size, wide = self.size, np.int64(len(self.words))
        own = np.arange(size.sum()) + 2 * np.repeat(np.arange(1, len(size) + 1), size)
        seq = np.zeros(size.sum() + 2 * len(size), np.int64)
        seq[own] = numbers + 1
        home = (self.words >> np.uint64(40 - bits)).astype(np.int64)
        self.dealt = found(dealt, self.words, np.ones(len(dealt), bool))[0].astype(bool)

        def hashed(a, b):
            return (pair_key(self.words[a], self.words[b]) >> np.uint64(64 - bits)).astype(np.int64)

        self.at = np.arange(len(own))  # the words looked at: those whose middle word or pair lies in the shards of the span
        if span:
            v = seq[own - 1]
            take = ((home >= span[0]) & (home < span[1]) & ~self.dealt)[v]
            apart = np.flatnonzero(self.dealt[v])
            for k in (2, 1):
                shard = hashed(seq[own[apart] - k], seq[own[apart] - k + 1])
                take[apart] |= (shard >= span[0]) & (shard < span[1])
            self.at = np.flatnonzero(take)
            own = own[take]
        # Each place's pair once: the pair behind a word's middle is mostly the pair before the next word's.
        used = np.zeros(len(seq), bool)
        used[own] = used[own - 1] = True
        used = np.flatnonzero(used)
        code = seq[used - 1] * wide + seq[used]
        order, first, pair = gathered(code)
        code = code[order[first]]
        seq[used] = pair  # from here on the numbers of the pairs
        of_before, of_behind = seq[own - 1], seq[own]
        del seq, numbers, used, pair, order
        a, b = self.a, self.b = code // wide, code % wide
        of_pair = hashed(a, b)
        to_a, to_b = np.where(self.dealt[a], of_pair, home[a]), np.where(self.dealt[b], of_pair, home[b])
        is_before, is_behind = np.zeros(len(code), bool), np.zeros(len(code), bool)
        is_before[of_before] = is_behind[of_behind] = True
        behind, before = np.flatnonzero(is_behind), np.flatnonzero(is_before)
        self.behind = behind[np.argsort(to_a[behind].astype(np.uint16), kind="stable")]  # pairs are in order of their first word
        before = before[order_of((b * wide + a)[before])]
        self.before = before[np.argsort((2 * to_b + self.dealt[b])[before].astype(np.uint16), kind="stable")]
        self.shard_behind, self.shard_before = to_a[self.behind], to_b[self.before]
        place_a, place_b = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
        place_a[self.behind], place_b[self.before] = np.arange(len(self.behind)), np.arange(len(self.before))
        i, j = place_b[of_before], place_a[of_behind]
        order, first, self.which = gathered(i * max(1, len(self.behind)) + j)
        self.i, self.j = i[order[first]], j[order[first]]


def vocabulary_of(raw: bytes, n: int) -> np.ndarray:
    """The mark and the different words' hashes."""
    import pyarrow as pa
    return np.r_[np.uint64(START), unpack(pa.decompress(raw, n, "zstd", asbytes=True), WORD_BYTES)]


def numbers_of(packed: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, words, numbers): words of each text, the mark and the different words' hashes, numbers of all words without the mark."""
    import pyarrow as pa

    open_ = lambda c, width: unpack(pa.decompress(packed[c], packed[f"n_{c}"], "zstd", asbytes=True), width)
    words = vocabulary_of(packed["vocabulary"], packed["n_vocabulary"])
    return (open_("sizes", WORD_BYTES).astype(np.int64), words,
            open_("numbers", 3 if len(words) < 1 << 24 else WORD_BYTES).astype(np.int64))


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def found(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The values of the wanted keys in a sorted list of keys; 0 where it lacks them."""
    if not len(keys):
        return [np.zeros(len(wanted), np.int64) for _ in values]
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[i] == wanted
    return [np.where(hit, v[i], 0) for v in values]


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable sorting order of whole numbers from 0.  Numbers with their places in the low bits are sorted without
    an index, several times faster; where the highest bits that fit do not settle it, the numbers are sorted as they are."""
    if not len(keys):
        return np.zeros(0, np.int64)
    keys, bits = keys.astype(np.uint64), len(keys).bit_length()
    drop = max(0, int(keys.max()).bit_length() + bits - 64)
    placed = (keys >> np.uint64(drop)) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    placed.sort()
    order = (placed & np.uint64((1 << bits) - 1)).astype(np.int64)
    if drop:
        sorted_ = keys[order]
        if (sorted_[1:] < sorted_[:-1]).any():
            return np.argsort(keys, kind="stable")
    return order


def gathered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, inverse): a sorting order, where equal keys begin in it, and each key's run."""
    order = order_of(keys)
    first = runs(keys[order])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))
    return order, first, inverse


def classes(n: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per run: sum of the counts, and how many are 1, 2, 3 or more."""
    return [np.add.reduceat(x.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            for x in (n, n == 1, n == 2, n > 2)]


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, of how many counts are 1, 2, 3, 4."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]


def rest(n: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts without their discounts."""
    return np.where(n > 0, n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)


CHUNK = "block long, docs binary, vocabulary binary, n_vocabulary long, numbers binary, n_numbers long, sizes binary, n_sizes long, common array<struct<word:long,n:long>>"


def chunks_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Some rows each: the columns ``keep`` as an Arrow stream, the words' hashes, the texts as numbers of words, and
    their sizes in words; written once, compressed."""
    import pyarrow as pa
    from pyspark import TaskContext

    binary, long_ = pa.binary(), pa.int64()
    schema = pa.schema([("block", long_), ("docs", binary), ("vocabulary", binary), ("n_vocabulary", long_), ("numbers", binary), ("n_numbers", long_),
                        ("sizes", binary), ("n_sizes", long_), ("common", pa.list_(pa.struct([("word", long_), ("n", long_)])))])

    def run(batches):
        at, held, rows, size, hasher = TaskContext.get().partitionId() << 32, [], [], 0, WordHash()

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            words = np.concatenate(rows)
            order, first, numbers = gathered(words)
            n, words = np.diff(np.r_[first, len(words)]), words[order[first]]
            often = np.argsort(-n, kind="stable")  # frequent words get small numbers
            place = np.empty(len(often), np.int64)
            place[often] = np.arange(len(often))
            row = {"block": at, "docs": sink.getvalue().to_pybytes()}
            for c, x, width in (("vocabulary", words[often], WORD_BYTES), ("numbers", place[numbers], 3 if len(words) < (1 << 24) - 1 else WORD_BYTES),
                                ("sizes", np.fromiter(map(len, rows), np.int64, len(rows)), WORD_BYTES)):
                raw = pack(x, width)
                row |= {c: pa.compress(raw, "zstd", asbytes=True), f"n_{c}": len(raw)}
            total = int(n.sum())
            row["common"] = [{"word": int(w), "n": int(k)} for w, k in zip(words, n) if k * COMMON >= total] + [{"word": START, "n": len(rows)}]
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            column = batch.schema.get_field_index("__text")
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = text_bytes(part.column(column))
                done = 0
                for k, t in enumerate(texts, 1):
                    rows.append(hasher.of(t.split()) & WORD_MASK)
                    size += len(t)
                    if size >= CHUNK_BYTES or k == len(texts):
                        held.append(part.slice(done, k - done).select(keep))
                        done = k
                    if size >= CHUNK_BYTES:
                        yield flush()
                        at, held, rows, size = at + 1, [], [], 0
        if held:
            yield flush()

    return checkpoint(df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, CHUNK))


def replies(name: str, got: list[list[np.ndarray]]) -> dict:
    """Columns ``name`` (the lists of each row, packed and compressed) and n_``name`` (bytes before that)."""
    import pyarrow as pa

    raw = [b"".join(pack(x, WORD_BYTES) for x in row) for row in got]
    return {name: pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary()),
            f"n_{name}": pa.array(list(map(len, raw)), pa.int64())}


def written(df: DataFrame) -> DataFrame:
    """A checkpoint whose shuffles are dropped as soon as it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return checkpoint(df.select("*"))
    finally:
        conf.set(name, before)


def opened(raw: bytes):
    import pyarrow as pa
    return pa.ipc.open_stream(raw).read_all()


def exchanged(chunks: DataFrame, fit: str, bits: int, turn: int, dealt: np.ndarray) -> DataFrame:
    """The shards of one turn: rows (block, shard, reply) with the counts of what a chunk sent, and rows (words, kinds)
    with a shard's part of each word's counts and how many trigrams and pairs have counts 1 to 4."""
    import pyarrow as pa

    low, high = spans(bits)[turn]

    def send(batches):
        for batch in batches:
            for packed in batch.to_pylist():
                g = Grams(packed, bits, dealt, (low, high))
                trusted = np.repeat(opened(packed["docs"]).column(fit).to_numpy().astype(bool), g.size)[g.at]
                n = np.bincount(g.which[trusted], minlength=len(g.i))
                u, v, w = g.a[g.before], g.b[g.before], g.b[g.behind]
                start = g.a[g.behind]
                apart = g.dealt[v[g.i]]
                lead = np.flatnonzero(apart & (n > 0))
                lead = lead[np.argsort(g.j[lead])]
                cuts = np.arange(low, high + 1)
                at_b, at_a = np.searchsorted(g.shard_before, cuts), np.searchsorted(g.shard_behind, cuts)
                at_t, at_l = np.searchsorted(g.i, at_b), np.searchsorted(g.j[lead], at_a)
                shards, cells = [], []
                for k in np.flatnonzero((np.diff(at_b) > 0) | (np.diff(at_a) > 0)).tolist():
                    b, a, t, e = (slice(x[k], x[k + 1]) for x in (at_b, at_a, at_t, at_l))
                    ends, begins = runs(v[b]), runs(start[a])
                    plain = slice(t.start, t.start + np.count_nonzero(~apart[t]))
                    other = slice(plain.stop, t.stop)
                    shards.append(low + k)
                    cells.append(encode([
                        g.words[v[b][ends]], np.diff(np.r_[ends, b.stop - b.start]), g.words[u[b]],
                        g.words[start[a][begins]], np.diff(np.r_[begins, a.stop - a.start]), g.words[w[a]],
                        steps(g.i[plain] - b.start), steps(g.j[plain] - a.start), n[plain],
                        steps(g.i[other] - b.start), g.words[w[g.j[other]]], n[other],
                        steps(g.j[lead[e]] - a.start), g.words[u[g.i[lead[e]]]]], CELL))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([packed["block"]] * len(shards), pa.int64()),
                                                  pa.array(cells, pa.binary())], names=["shard", "block", "cell"])
                del g, cells
                give_back(cycles=False)

    def count(group: pa.Table) -> pa.Table:
        keys_b, keys_a, v, w, plain, other, lead, sizes = [], [], [], [], [], [], [], [(0, 0, 0)]
        for raw in group.column("cell").to_pylist():
            ends, n_ends, u, begins, n_begins, last, i, j, n, oi, ow, on, lj, lu = decode(raw, CELL)
            ends, begins = np.repeat(ends, n_ends.astype(np.int64)), np.repeat(begins, n_begins.astype(np.int64))
            at_b, at_a, at_t = sizes[-1]
            keys_b.append(pair_key(u, ends)), keys_a.append(pair_key(begins, last)), v.append(begins), w.append(last)
            plain.append((summed(i) + at_b, summed(j) + at_a, n.astype(np.int64), np.arange(at_t, at_t + len(i))))
            other.append((summed(oi) + at_b, ow, on.astype(np.int64), np.arange(at_t + len(i), at_t + len(i) + len(oi))))
            lead.append((summed(lj) + at_a, lu))
            sizes.append((at_b + len(u), at_a + len(last), at_t + len(i) + len(oi)))
        join = lambda parts: [np.concatenate(c) for c in zip(*parts)]
        keys_b, keys_a, v, w = (np.concatenate(x) for x in (keys_b, keys_a, v, w))
        order, first, pair_b = gathered(keys_b)
        contexts = len(first)
        order, first, pair_a = gathered(keys_a)
        v, w, n2 = v[order[first]], w[order[first]], np.zeros(len(first), np.int64)

        told = np.zeros(sizes[-1][2], np.int64)  # count of each trigram sent
        context, whole = np.zeros((4, contexts)), []
        i, j, n, place = join(plain)
        oi, ow, on, other_place = join(other)
        for key, n, of, place in (((pair_b[i] << 32 | pair_a[j]).astype(np.uint64), n, pair_b[i], place),
                                  (mix(pair_b[oi].astype(np.uint64) * M1 + ow + np.uint64(3)), on, pair_b[oi], other_place)):
            order, first, inverse = gathered(key)
            n3 = np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
            told[place] = n3[inverse]
            one = order[first]
            for k, x in enumerate((n3, n3 == 1, n3 == 2, n3 > 2)):
                context[k] += np.bincount(of[one], weights=x, minlength=contexts)
            if place is not other_place:
                n2 += np.bincount(pair_a[j[one[n3 > 0]]], minlength=len(n2))
            whole.append(n3)
        lj, lu = join(lead)
        order, first, _ = gathered(mix(pair_a[lj].astype(np.uint64) * M1 + lu + np.uint64(5)))
        n2 += np.bincount(pair_a[lj[order[first]]], minlength=len(n2))

        context = context.astype(np.int64)
        context[0] = spare(*context)
        reply = []
        for (b0, a0, t0), (b1, a1, t1) in zip(sizes, sizes[1:]):
            reply.append(encode([told[t0:t1], *(c[pair_b[b0:b1]] for c in context), n2[pair_a[a0:a1]]], REPLY))
        asked = pa.table({"block": group.column("block"), "shard": group.column("shard"), "reply": pa.array(reply, pa.binary())})

        v, w, seen = v[n2 > 0], w[n2 > 0], n2[n2 > 0]
        order = np.argsort(v, kind="stable")
        first = runs(v[order])
        n3 = np.concatenate(whole)
        kinds = [np.array([np.count_nonzero(x == i) for i in range(1, 5)]) for x in (n3, seen)]
        leads, ends, times = v[order][first], *np.unique(w, return_counts=True)
        none = [np.zeros(len(x), np.int64) for x in (leads, ends)]
        share = pa.table({"block": pa.nulls(1, pa.int64()), "shard": group.column("shard")[:1]} | replies("words", [[np.r_[leads, ends], np.r_[none[0], times], *(np.r_[x, none[1]] for x in classes(seen[order], first))]])
                         | {"kinds": pa.array([np.concatenate(kinds).tolist()], pa.list_(pa.int64()))})
        del keys_a, keys_b, plain, other, lead, pair_a, pair_b, told, context, whole
        give_back(cycles=False)
        return pa.concat_tables([asked, share], promote_options="default").select(["block", "shard", "reply", "words", "n_words", "kinds"])

    sent = chunks.select("block", "docs", *[x for c in ("vocabulary", "numbers", "sizes") for x in (c, f"n_{c}")]).mapInArrow(
        send, "shard int, block long, cell binary")
    return sent.groupBy("shard").applyInArrow(count, "block long, shard int, reply binary, words binary, n_words long, kinds array<long>")


def word_counts(shares: DataFrame, bits: int) -> DataFrame:
    """(shard, words, n_words, sums): the shards' shares of each word's counts put together, by ranges of words, packed;
    ``sums`` are over the words of a range."""
    import pyarrow as pa

    def deal(batches):
        for batch in batches:
            for raw, n in zip(*(c.to_pylist() for c in batch.columns)):
                word, *counts = split(pa.decompress(raw, n, "zstd", asbytes=True), 1 + len(STATS))
                order = np.argsort(word, kind="stable")
                shard = (word[order] >> np.uint64(40 - bits)).astype(np.int32)
                first = runs(shard)
                rows = [b"".join(pack(a[i], WORD_BYTES) for a in (word, *counts)) for i in np.split(order, first[1:])] if len(word) else []
                yield pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), pa.array(rows, pa.binary())], names=["shard", "share"])

    def add(group: pa.Table) -> pa.Table:
        word, *counts = (np.concatenate(c) for c in zip(*(split(r, 1 + len(STATS)) for r in group.column("share").to_pylist())))
        order = order_of(word)
        first = runs(word[order])
        n, *counts = (np.add.reduceat(x[order].astype(np.int64), first) for x in counts)
        sums = [n.sum(), *(np.count_nonzero(x) for x in (n > 0, n == 1, n == 2, n == 3, n == 4, n > 2))]
        return pa.table({"shard": group.column("shard")[:1]} | replies("words", [[word[order][first], n, *counts]])
                        | {"sums": pa.array([list(map(int, sums))], pa.list_(pa.int64()))})

    return shares.mapInArrow(deal, "shard int, share binary").groupBy("shard").applyInArrow(
        add, "shard int, words binary, n_words long, sums array<long>")


def perplexities(df: DataFrame, fit: str, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Columns ``keep`` plus n_symbols (words) and perplexity (null without words) under the model of the rows
    whose column ``fit`` is true."""
    import pyarrow as pa

    keep = list(keep)
    chunks = chunks_of(df, text, [*keep, fit])
    blocks = sorted((r.block, r.n_numbers) for r in chunks.select("block", "n_numbers").collect())  # two numbers a chunk
    # Shards of about one or two chunks' size; their number is a power of two and not below the number of turns.
    bits = min(15, max(PASSES.bit_length(), len(blocks).bit_length() - 1))
    common = chunks.select(F.explode("common").alias("c")).groupBy("c.word").agg(F.sum("c.n").alias("n"))
    total = sum(n for _, n in blocks) / 3
    dealt = [r.word for r in common.filter(F.col("n") * (2 << bits) > total).collect()]  # at most 2 << bits words
    dealt = np.sort(np.array(dealt, np.int64)).astype(np.uint64)
    answers = reduce(DataFrame.unionByName, [written(exchanged(chunks, fit, bits, turn, dealt)) for turn in range(PASSES)])
    shares = answers.filter("words is not null")
    words = written(word_counts(shares.select("words", "n_words"), bits))
    kinds = [float(x or 0) for x in shares.agg(*[F.sum(F.col("kinds")[k]) for k in range(8)]).first()]
    d3, d2 = discounts(*kinds[:4]), discounts(*kinds[4:])
    total, known_words, *ones, many = (int(x or 0) for x in words.agg(*[F.sum(F.col("sums")[k]) for k in range(SUMS)]).first())
    d1 = discounts(*map(float, ones))
    total = float(total)
    freed = d1[0] * ones[0] + d1[1] * ones[1] + d1[2] * many
    floor = 1.0 / (known_words + 1)  # unknown words are one more

    def ask(batches):
        for batch in batches:
            for block, raw, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.unique(vocabulary_of(raw, n))
                shard = (own >> np.uint64(40 - bits)).astype(np.int32)
                first = runs(shard)
                mine = [pack(x, WORD_BYTES) for x in np.split(own, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), pa.array([block] * len(first), pa.int64()),
                                                  pa.array(mine, pa.binary())], names=["shard", "block", "own"])

    def tell(group: pa.Table, known: pa.Table) -> pa.Table:
        rows = [split(pa.decompress(r, n, "zstd", asbytes=True), 1 + len(STATS))
                for r, n in zip(known.column("words").to_pylist(), known.column("n_words").to_pylist())]  # one, or none
        names, n, *counts = rows[0] if rows else [np.zeros(0, np.uint64)] * (1 + len(STATS))
        return pa.table({"block": group.column("block"), "shard": group.column("shard")} | replies(
            "words", [found(names, unpack(x, WORD_BYTES), n, spare(*counts), *counts[1:]) for x in group.column("own").to_pylist()]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def judge(held: pa.Table, got: pa.Table) -> pa.Table:
        packed = held.to_pylist()[0]
        docs = opened(packed["docs"])
        g = Grams(packed, bits, dealt)
        size, got = g.size, got.sort_by("shard")
        # The shards' answers behind each other are those to the chunk's n-grams in their order.
        cut = [decode(r, REPLY) for r in got.column("reply").to_pylist() if r is not None]
        n3, *context, n2 = [np.concatenate(c).astype(np.int64) for c in zip(*cut)] or [np.zeros(0, np.int64)] * len(REPLY)
        context[0] = totalled(*context)
        rows = zip(got.column("words").to_pylist(), got.column("n_words").to_pylist())
        cut = [split(pa.decompress(r, n, "zstd", asbytes=True), len(STATS)) for r, n in rows if n]
        _, number = np.unique(g.words, return_inverse=True)
        n1, *following = [np.concatenate(c).astype(np.int64)[number] for c in zip(*cut)]
        following[0] = totalled(*following)

        def interpolated(n, d, total_, once, twice, more, low):
            return np.where(total_ > 0, (rest(n, d) + (d[0] * once + d[1] * twice + d[2] * more) * low) / np.maximum(total_, 1), low)

        p = (rest(n1, d1) + freed * floor) / total if total else np.full(len(n1), floor)
        first, last = g.a[g.behind], g.b[g.behind]
        p = interpolated(n2, d2, *(x[first] for x in following), p[last])
        p = np.log(interpolated(n3, d3, *(x[g.i] for x in context), p[g.j]))[g.which]
        del g, n3, n2, context, following, number
        give_back(cycles=False)
        ends = np.cumsum(size)
        done = np.r_[0.0, np.cumsum(p)]
        mean = (done[ends] - done[ends - size]) / np.maximum(size, 1)
        return docs.select(keep).append_column("n_symbols", pa.array(size, pa.int64())).append_column(
            "perplexity", pa.array(np.exp(-mean), pa.float64(), mask=size == 0))

    def judged(low: int, high: int) -> DataFrame:
        """The rows of a run of chunks; what they ask for and are told is only shuffled."""
        mine = lambda df: df.filter(F.col("block").between(low, high))
        told = mine(chunks).select("block", "vocabulary", "n_vocabulary").mapInArrow(ask, "shard int, block long, own binary").groupBy(
            "shard").cogroup(words.groupBy("shard")).applyInArrow(tell, "block long, shard int, words binary, n_words long")
        got = mine(answers).select("block", "shard", "reply").unionByName(told, allowMissingColumns=True)
        return mine(chunks).groupBy("block").cogroup(got.groupBy("block")).applyInArrow(judge, f"{fields}, n_symbols long, perplexity double")

    ends = [k * len(blocks) // PARTS for k in range(PARTS + 1)]
    parts = [(blocks[a][0], blocks[b - 1][0]) for a, b in zip(ends, ends[1:]) if a < b]
    return reduce(DataFrame.unionByName, [written(judged(*part)) for part in parts or [(0, 0)]])


def classify(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, lang, n_symbols, perplexity, steadied, threshold, kept.

    ``trusted`` holds the keys of trusted rows.  Null languages form a group;
    languages with few held-out texts use the quantile of all.  Texts without a
    word are not kept; without any trusted text the rest is kept (no
    threshold).  Repeated rows are judged alike; an empty table stays empty.
    """
    good = small_side(checkpoint(trusted.select(key).filter(F.col(key).isNotNull()).distinct()))
    marked = df.join(good.withColumn("__good", F.lit(True)), key, "left").withColumn("__good", F.coalesce("__good", F.lit(False)))
    marked = marked.withColumn("__held", F.col("__good") & (F.pmod(F.xxhash64(text), F.lit(HELD_OUT)) == 0))
    marked = marked.withColumn("__fit", F.col("__good") & ~F.col("__held"))
    scored = perplexities(marked, "__fit", text, (key, lang, "__good", "__held"))
    sure = scored.filter("__good and perplexity is not null")
    held = sure.filter("__held")
    sure = held if held.limit(1).count() else sure
    name = F.coalesce(F.col(lang), F.lit("\0"))
    half, high = (F.percentile_approx("perplexity", q, 10000) for q in (0.5, QUANTILE))
    whole = sure.agg(half.alias("median"), (high * SLACK).alias("threshold")).first()
    per = (sure.groupBy(name.alias("__lang")).agg(half.alias("median"), (high * SLACK).alias("threshold"), F.count("*").alias("__n"))
           .filter(F.col("__n") >= SMALL_LANGUAGE).drop("__n"))
    out = scored.withColumn("__lang", name).join(small_side(checkpoint(per)), "__lang", "left").drop("__lang")
    out = out.withColumns({c: F.coalesce(c, F.lit(whole[c]).cast("double")) for c in ("median", "threshold")})
    mean = (F.log("perplexity") * F.col("n_symbols") + F.log("median") * STEADY) / (F.col("n_symbols") + STEADY)
    out = out.withColumn("steadied", F.coalesce(F.exp(mean), "perplexity"))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("steadied") <= F.col("threshold"), F.lit(True))).select(
        key, lang, "n_symbols", "perplexity", "steadied", "threshold", "kept")
