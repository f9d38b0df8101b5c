"""Language-model scoring: prediction by partial matching over bytes, and an add-one unigram base.

The byte model is a trie of contexts of up to ORDER bytes counted over all learning texts.  A symbol's code length walks
from the longest known context down: escape method C (an escape weighs as much as the distinct symbols seen), and at each
shorter context the symbols that the longer one could have coded are excluded.  Every text ends with an end symbol, so
the log-probability is that of the whole text.  Counting covers every learning text, and every node counts.

A code depends on a symbol and the ORDER symbols before it alone.  So one pass over the texts writes, for each chunk of
about CHUNK_BYTES, its texts, its different strings of ORDER + 1 symbols and its different words, each with its count.
Counts are summed by string.  Strings whose contexts end with the same two bytes have all their nodes of two symbols or
more of context among themselves, so the trie is built and walked in parts, one for each such ending (a few hundredths of
the different strings at most in prose); shorter contexts, 257 x 257 nodes at most, go to all parts.

The codes go back to the chunks that have the strings.  Those that most chunks have, HOT at most, are broadcast; all others
are joined to their chunks, so no limit leaves anything out.  A chunk's worker sums the codes over its texts.  A frequent
string or word costs a row for each chunk, not for each document.

The pass writes the texts with the rows made from them in one table, so a task that is run again cannot part them.

Defined cases: null text is the empty text (one token, the end); a null id counts as learning; repeated rows are learned
and scored each; with nothing to learn from the base is 0 a token and the byte model is uniform; texts of any length are
handled in pieces of PIECE_BYTES; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framewright.llm.common import crc_mod, give_back, segment_sum, stash, tidied

ORDER = 5
END, START = 256, 257
SHIFT = 9  # bits of a symbol
ALPHABET = 257  # bytes and the end
CHUNK_BYTES = 32 << 20
#: Bytes of texts that are packed at once.
PIECE_BYTES = 1 << 20
#: Strings and words that are broadcast with their codes at most: 16 bytes each.
HOT = 1 << 20
#: Different strings in a part of the trie, about.
PART = 1 << 20
#: Stands for the end in the hash of words; no UTF-8 word has this byte.
END_WORD = b"\xff"
#: Kinds of rows: texts, strings and words, and strings of two symbols.
TEXT, LONG, SHORT = 0, 1, 2

#: A part of a text: its number, what stands before it, its bytes, whether the text ends with it.
Piece = tuple[int, bytes, bytes, bool]


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[list[Piece]]:
    """All texts, cut up where they are longer than ``limit``, in groups of about that many bytes."""
    held: list[Piece] = []
    size = 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), limit):
            body = t[lo : lo + limit]
            held.append((i, t[max(0, lo - ORDER) : lo], body, lo + limit >= len(t)))
            size += len(body)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(part: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of each piece, a text's end included, packed with the ORDER symbols before it; symbols per piece."""
    lens = np.fromiter((len(p[2]) + p[3] for p in part), np.int64, len(part))
    sym = np.frombuffer(b"".join(p[1].rjust(ORDER, b"\0") + p[2] + b"\0" * p[3] for p in part), np.uint8).astype(np.int64)
    begin = np.cumsum(lens + ORDER) - lens
    known = np.fromiter((len(p[1]) for p in part), np.int64, len(part))
    ok = np.ones(len(sym), bool)
    for k in range(1, ORDER + 1):
        sym[begin[known < k] - k] = START
        ok[begin - k] = False
    last = np.fromiter((p[3] for p in part), bool, len(part))
    sym[(begin + lens - 1)[last]] = END
    g = sym.copy()
    for k in range(1, ORDER + 1):
        g[k:] |= sym[:-k] << (SHIFT * k)
    return g[ok], lens


def words_of(text: bytes, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists from about ``limit`` bytes each; no word is cut."""
    lo = 0
    while len(text) - lo > limit:
        hi = lo + limit
        while hi < len(text) and text[hi] not in b" \t\n\r\x0b\x0c":
            hi += 1
        yield text[lo:hi].lower().split()
        lo = hi
    yield text[lo:].lower().split()


def find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``q`` stands in sorted ``keys``, and whether it does."""
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


class Trie:
    """Pretrained contexts with escapes and exclusion; ``log10`` codes packed symbols."""

    def __init__(self, order: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.keys, self.count, self.ctx, self.total, self.kinds, self.lost = [], [], [], [], [], []
        for n in range(ORDER + 1):
            at = np.flatnonzero(order == n)
            at = at[np.argsort(gram[at], kind="stable")]
            k, c = gram[at], count[at].astype(np.float64)
            ctx, first = np.unique(k >> SHIFT, return_index=True)
            size = np.diff(np.append(first, len(k)))
            self.keys.append(k)
            self.count.append(c)
            self.ctx.append(ctx)
            self.total.append(segment_sum(c, size))
            self.kinds.append(size.astype(np.float64))
            # what the symbols of this context weigh in the context one shorter, where they are excluded
            if n:
                at, ok = find(self.keys[n - 1], k & ((1 << (SHIFT * n)) - 1))
                self.lost.append(segment_sum(np.where(ok, self.count[n - 1][at] if len(self.count[n - 1]) else 0.0, 0.0), size))
            else:
                self.lost.append(np.zeros(len(ctx)))

    def log10(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g))
        todo = np.arange(len(g))
        came = np.full(len(g), -1, np.int64)  # the longer context that was left by an escape
        for n in range(ORDER, -1, -1):
            part = g[todo] & ((1 << (SHIFT * (n + 1))) - 1)
            c, known = find(self.ctx[n], part >> SHIFT)
            if not known.any():
                continue
            k = np.flatnonzero(known)
            c = c[k]
            t, d = self.total[n][c].copy(), self.kinds[n][c].copy()
            up = came[todo[k]]
            x = np.flatnonzero(up >= 0)
            if len(x):
                t[x] -= self.lost[n + 1][up[x]]
                d[x] -= self.kinds[n + 1][up[x]]
            at, hit = find(self.keys[n], part[k])
            both = t + d
            out[todo[k[hit]]] += np.log10(self.count[n][at[hit]] / both[hit])
            esc = ~hit & (d > 0)
            out[todo[k[esc]]] += np.log10(d[esc] / both[esc])
            came[todo[k]] = c
            stay = np.ones(len(todo), bool)
            stay[k[hit]] = False
            todo = todo[stay]
        left = ALPHABET - (self.kinds[0][0] if len(self.kinds[0]) else 0.0)
        out[todo] -= np.log10(max(1.0, left))
        return out


class Codes:
    """Different 64-bit keys -> numbers, by linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], self._next(slot[~won])

    def _slot(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key (0 where there is none), and whether there is one."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = there == keys
        out = np.where(found, self.values[slot], 0.0)
        at = np.flatnonzero(~found & (there != -1))
        slot = slot[at]
        while len(at):
            slot = self._next(slot)
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]], found[at[hit]] = self.values[slot[hit]], True
            go = ~hit & (there != -1)
            at, slot = at[go], slot[go]
        return out, found


class Frequent:
    """The broadcast codes; a worker makes its table of them once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.table = keys, values, None

    def codes(self) -> Codes:
        if self.table is None:
            self.table = Codes(self.keys, self.values)
        return self.table

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "values": self.values, "table": None}


def looked_up(keys: np.ndarray, first: Codes, then: Codes) -> np.ndarray:
    out, found = first(keys)
    rest = np.flatnonzero(~found)
    out[rest], found = then(keys[rest])
    if not found.all():
        raise ValueError("a string has no code: the texts are not those that were counted")
    return out


def word_keys(words: list[bytes]) -> np.ndarray:
    """Hashes of words as negative numbers; packed symbols are positive."""
    h = xxhash.xxh64_intdigest
    return (np.fromiter((h(w) for w in words), np.uint64, len(words)) | np.uint64(1 << 63)).view(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c[order], first) if len(k) else c


def _chunk_grams(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Different strings of a chunk with how often learning texts have them."""
    keys, counts, held = [], [], 0
    for learn in (True, False):
        for part in pieces([t for _, t, out in rows if out is not learn]):
            g = np.sort(grams(part)[0])
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            keys.append(g[first])
            counts.append(np.diff(np.append(first, len(g))) * int(learn))
            held += len(first)
            if held > 2_000_000:
                keys, counts = ([x] for x in _summed(keys, counts))
                held = len(keys[0])
    return _summed(keys, counts)


def _chunk_words(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Different words of a chunk, by their hashes, with how often learning texts have them."""
    seen: Counter[bytes] = Counter()
    other: set[bytes] = set()
    for _, text, held in rows:
        for w in words_of(text):
            if held:
                other.update(w)
            else:
                seen.update(w)
        if held:
            other.add(END_WORD)
        else:
            seen[END_WORD] += 1
    other.difference_update(seen)
    return word_keys([*seen, *other]), np.fromiter((*seen.values(), *([0] * len(other))), np.int64, len(seen) + len(other))


def survey(rows: DataFrame) -> DataFrame:
    """(chunk, kind, key, n, blob): the texts, the different strings and words of every chunk with their counts, and the short strings'."""
    id_kind = to_arrow_type(rows.schema["doc_id"].dataType)
    shape = pa.schema([("doc_id", id_kind), ("text", pa.binary()), ("held_out", pa.bool_())])
    names = ["chunk", "kind", "key", "n", "blob"]

    def out(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), 100_000):
            k = keys[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[lo : lo + 100_000]), pa.nulls(len(k), pa.binary())], names=names)

    def blob(part: list[tuple]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, shape, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_batch(pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], shape.field(c).type) for c in range(3)], schema=shape))
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            part, room = [], 0
            for x in held:
                part.append(x)
                room += len(x[1])
                if room >= PIECE_BYTES or x is held[-1]:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([TEXT], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([blob(part)], pa.binary())], names=names)
                    part, room = [], 0
            keys, counts = _chunk_grams(held)
            yield from out(number, LONG, keys, counts)
            some = np.flatnonzero(counts)
            yield from out(number, SHORT, *_summed([keys[some] & ((1 << (2 * SHIFT)) - 1)], [counts[some]]))
            del keys, counts, some
            yield from out(number, LONG, *_chunk_words(held))

        for b in batches:
            for i in range(b.num_rows):
                held.append((b.column(0)[i].as_py(), (b.column(1)[i].as_py() or "").encode("utf-8"), b.column(2)[i].as_py()))
                size += len(held[-1][1])
                if size >= CHUNK_BYTES:
                    yield from flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield from flush()

    return stash(rows.mapInArrow(tidied(run), "chunk bigint, kind int, key bigint, n bigint, blob binary"))


def codes(strings: DataFrame, short: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, value, m): log10 of the probability of a string's last symbol after the others, of different strings (key, n, m).

    ``n`` is how often learning texts have the string (perhaps never), ``m`` is carried along; ``short`` is the strings of
    two symbols, sorted, with their counts.
    """
    pairs, times = short
    lone, total = _summed([pairs & ((1 << SHIFT) - 1)], [times])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not got:
            return
        key, n, m = (np.concatenate([g[i] for g in got]) for i in range(3))
        del got
        order, gram, count = [np.zeros(len(lone), np.int64), np.ones(len(pairs), np.int64)], [lone, pairs], [total, times]
        learned = np.flatnonzero(n)
        k, c = key[learned], n[learned]
        for size in range(ORDER, 1, -1):
            k, c = _summed([k & ((1 << (SHIFT * (size + 1))) - 1)], [c])
            order.append(np.full(len(k), size))
            gram.append(k)
            count.append(c)
        trie = Trie(np.concatenate(order), np.concatenate(gram), np.concatenate(count))
        del order, gram, count, k, c
        for lo in range(0, len(key), 100_000):
            part = key[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(trie.log10(part)), pa.array(m[lo : lo + 100_000])], names=["key", "value", "m"])

    spark = strings.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), strings.count() // PART)
    ending = F.shiftright("key", SHIFT).bitwiseAND(F.lit((1 << (2 * SHIFT)) - 1))
    return strings.select("key", "n", "m").repartition(parts, ending).mapInArrow(tidied(run), "key bigint, value double, m bigint")


def _frequent(known: DataFrame, most: int) -> tuple[Frequent, int]:
    """Keys that the most chunks have, ``most`` at most, with their numbers; and how many chunks the others are below."""
    level = F.floor(F.log2("m")).cast("int")
    rows = sorted(((r.l, r.n) for r in known.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a row for each power of two
    least, held = 64, 0
    for at, n in rows:
        if held + n > most or at == 0:
            break
        least, held = at, held + n
    t = known.where(F.col("m") >= (1 << min(least, 62))).select("key", "value").toArrow()
    return Frequent(t.column(0).to_numpy(), t.column(1).to_numpy()), 1 << min(least, 62)


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (chunk, key, value) as few rows (chunk, n, blob) of sorted keys and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            chunk, key, value = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.lexsort((key, chunk))
            chunk, key, value = chunk[order], key[order], value[order]
            at = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
            ends = np.append(at[1:], len(chunk))
            blobs = [pa.compress(np.diff(key[a:z], prepend=0).tobytes() + value[a:z].tobytes(), codec="zstd", asbytes=True) for a, z in zip(at.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(chunk[at]), pa.array(ends - at), pa.array(blobs, pa.binary())], names=["chunk", "n", "blob"])

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy() for c in b.columns])
                size += b.num_rows
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(tidied(run), "chunk bigint, n bigint, blob binary")


def score(docs: DataFrame, frequent: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``frequent`` bounds what is broadcast; it changes the speed, never the result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = survey(docs.select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out")))
    pairs = made.where(F.col("kind") == LONG)
    sums = stash(pairs.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("m")))
    few = made.where(F.col("kind") == SHORT).groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()  # 257 x 257 rows at most
    short = few.column(0).to_numpy(), few.column(1).to_numpy()
    words = sums.where("key < 0")
    n_train, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    base = float(np.log10(n_train + n_words + 1))
    known = stash(codes(sums.where("key >= 0"), short).unionByName(words.select("key", F.col("n").cast("double").alias("value"), "m")))
    hot, below = _frequent(known, frequent)
    table = spark.sparkContext.broadcast(hot)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~table.value.codes()(b.column(1).to_numpy())[1]))

    cold = pairs.select("chunk", "key").mapInArrow(others, "chunk bigint, key bigint").join(known.where(F.col("m") < below).select("key", "value"), "key").select("chunk", "key", "value")
    facts = _packed(cold)
    texts = made.where(F.col("kind") == TEXT).select(F.col("chunk").alias("at"), "blob")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
        for n, b in zip(right.column("n").to_pylist(), right.column("blob"), strict=True):
            raw = pa.decompress(b.as_buffer(), decompressed_size=16 * n, codec="zstd")
            keys.append(np.cumsum(np.frombuffer(raw, np.int64, n)))
            values.append(np.frombuffer(raw, np.float64, n, 8 * n))
        first, then = table.value.codes(), Codes(np.concatenate(keys), np.concatenate(values))
        del keys, values, right
        count: dict[bytes, float] = {}  # of the chunk's words
        out = []
        for b in left.column("blob"):
            part = pa.ipc.open_stream(b.as_buffer()).read_all()
            texts = [x.as_py() for x in part.column("text")]
            score = np.zeros(len(texts))
            for piece in pieces(texts):
                g, lens = grams(piece)
                np.add.at(score, np.fromiter((p[0] for p in piece), np.int64, len(piece)), segment_sum(looked_up(g, first, then), lens))
            n_tokens, n_known, logs = [], [], []
            for t in texts:
                n, k, s = 0, 0, 0.0
                for w in [*words_of(t), [END_WORD]]:
                    if new := [x for x in set(w) if x not in count]:
                        count.update(zip(new, looked_up(word_keys(new), first, then).tolist(), strict=True))
                    c = np.fromiter(map(count.__getitem__, w), float, len(w))
                    n, k, s = n + len(w), k + int((c > 0).sum()), s + float(np.log10(c + 1.0).sum())
                n_tokens.append(n)
                n_known.append(k)
                logs.append(s - n * base)
            out.append(pa.table({
                "doc_id": part.column("doc_id"),
                "held_out": part.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([int(n_train)] * len(texts), pa.int64()),
                "base_score": pa.array(logs, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }))
        del then, count
        give_back()
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return texts.groupBy("at").cogroup(facts.groupBy("chunk")).applyInArrow(both, schema)


def brute_log10(learn: list[bytes], text: bytes) -> float:
    """The same code length from dictionaries, one symbol after the other; for tests."""
    seen: list[dict[tuple, Counter]] = [{} for _ in range(ORDER + 1)]
    pad = lambda t: [START] * ORDER + list(t) + [END]
    for t in learn:
        s = pad(t)
        for i in range(ORDER, len(s)):
            for n in range(ORDER + 1):
                seen[n].setdefault(tuple(s[i - n : i]), Counter())[s[i]] += 1
    s, out = pad(text), 0.0
    for i in range(ORDER, len(s)):
        gone: set[int] = set()
        for n in range(ORDER, -1, -1):
            c = seen[n].get(tuple(s[i - n : i]))
            if c is None:
                continue
            rest = {k: v for k, v in c.items() if k not in gone}
            t, d = sum(rest.values()), len(rest)
            if s[i] in rest:
                out += np.log10(rest[s[i]] / (t + d))
                break
            if d:
                out += np.log10(d / (t + d))
            gone |= set(c)
        else:
            out -= np.log10(max(1, ALPHABET - len(gone)))
    return out


__all__ = ["Codes", "Trie", "brute_log10", "codes", "score", "survey"]
