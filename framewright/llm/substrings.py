"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that starts more than once.

1.  Every window of ``length`` bytes is named by the least hash of the k-byte strings in it.  Equal windows have equal
    names, whatever stands around them, so windows of a name that occurs in one place only cannot repeat.  A region is a
    run of windows of one name in a document.
2.  Regions of a repeated name are aggregated by content.  All windows of a region that occurs twice repeat.
3.  Names with several different regions, or with a region that has the name's string twice, are dealt to shards, and each shard's suffixes are sorted with their common
    prefixes by external induced sorting (esais.py): a window repeats if its suffix shares ``length`` bytes with a neighbour.
    A name with more than ``hot_bytes`` of different regions is first cut finer, by a second hash of the same kind.
4.  The repeated windows of each document are merged and their bytes left out.

``strip`` can also judge by words: then a window is ``length`` whole words, whatever space is between them, and a text is taken as
its words with one space before each and one at the end, so that a string of bytes from space to space is a string of words.

Strings are judged on the input, not on what is left.  Nothing is gathered by document but its own ranges.

Defined cases: null text counts as empty and loses nothing; texts shorter than ``length`` lose nothing; repeated rows are
copies of each other, so each loses all its windows; rows are told apart by (doc_id, text), so null ids are fine; columns
other than doc_id and text are ignored (or carried along by ``strip``).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import MIX, drop_tables, mix64, stash, tidied
from framewright.llm.esais import Suffixes

LENGTH = 400
GRAM = 64
#: Words in a hashed string, where windows are words.
WORD_GRAM = 8
#: What a space is in a shard's text, where 0 stands between bodies.
SPACE = 33
#: Windows of a region at most; a longer run of one name is several regions.
REGION = 4096
BLOCK = 1 << 20
#: Bytes of text that a worker takes out of an Arrow batch at a time.
SLICE = 4 << 20


def _gram_hashes(data: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of data[i:i+k] for every i (k a power of two)."""
    return _rolled(_byte_table(salt)[data], k)


def _byte_table(salt: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(salt * 1000 + 1))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each place on."""
    base, width = np.uint64(0x2545F4914F6CDD1D), 1
    with np.errstate(over="ignore"):
        while width < k:
            h = h[:-width] * base + h[width:]
            base = base * base
            width *= 2
        h ^= h >> np.uint64(31)
        h *= MIX
    return h


def spaced(text: bytes) -> bytes:
    """The words of a text, each with a space before it, and one at the end."""
    words = text.split()
    return b" " + b" ".join(words) + b" " if words else b""


def word_starts(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    return np.flatnonzero(~space & np.append(True, space[:-1])) if len(data) else np.zeros(0, np.int64)


def _word_hashes(data: np.ndarray, gaps: np.ndarray, last: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each word of spaced texts; ``gaps`` are their spaces, and no word begins at those marked ``last``."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.full(len(data), x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
        total = np.cumsum(_byte_table(salt)[data] * up)
        at = np.flatnonzero(~last)
        return mix64((total[gaps[at + 1] - 1] - total[gaps[at]]) * down[gaps[at]])


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if width > done else h


def regions(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, salt: int = 0, words: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, name, twice) of every region of every text; of spaced texts counted in words, if ``words``.

    ``twice``: the name's string stands in the region more than once, so its windows may repeat one another.
    """
    empty = np.zeros(0, np.int64)
    parts: list[tuple[np.ndarray, ...]] = []

    def run(numbers: list[int]) -> None:
        lens = np.array([len(texts[i]) for i in numbers], np.int64)
        data = np.frombuffer(b"".join(texts[i] for i in numbers), np.uint8)
        if words:
            gaps, ends = np.flatnonzero(data == 32), np.cumsum(lens)
            last = np.isin(gaps, ends - 1)
            lens = np.diff(np.searchsorted(gaps, ends), prepend=0) - 1
            h = _rolled(_word_hashes(data, gaps, last, salt), gram)
        else:
            h = _gram_hashes(data, gram, salt)
        begin, wide = np.cumsum(lens) - lens, length - gram + 1
        name = _sliding_min(h, wide)
        owner = np.repeat(np.arange(len(numbers)), lens)
        inside = owner[: len(name)] == owner[length - 1 : length - 1 + len(name)]
        new = np.append(True, (name[1:] != name[:-1]) | (owner[1 : len(name)] != owner[: len(name) - 1]) | ~inside[:-1])
        at = np.flatnonzero(new & inside)
        stop = np.flatnonzero(np.append(new | ~inside, True))
        size = stop[np.searchsorted(stop, at, side="right")] - at
        if len(size) and size.max() > REGION:  # long runs of one name in pieces
            n = -(-size // REGION)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, total = np.repeat(at, n) + k * REGION, np.repeat(size, n)
            size = np.minimum(REGION, total - k * REGION)
        # it stands once only if its first place in the first window is its last place in the last window
        twice, step = size > wide, np.arange(wide)
        for lo in range(0, len(at), 4096):
            a, z, v = at[lo : lo + 4096, None], (at + size - 1)[lo : lo + 4096, None], name[at[lo : lo + 4096]][:, None]
            first = a[:, 0] + (h[a + step] == v).argmax(axis=1)
            last = z[:, 0] + wide - 1 - (h[z + step[::-1]] == v).argmax(axis=1)
            twice[lo : lo + 4096] |= first != last
        o = owner[at]
        parts.append((np.array(numbers, np.int64)[o], at - begin[o], size, name[at].view(np.int64), twice))

    held, total = [], 0
    for i, t in enumerate(texts):
        if len(t) >= length and (not words or t.count(b" ") > length):
            held.append(i)
            total += len(t)
            if total >= BLOCK:
                run(held)
                held, total = [], 0
    if held:
        run(held)
    return tuple(np.concatenate([p[x] for p in parts]) if parts else empty.astype(bool) if x == 4 else empty for x in range(5))


def repeated_starts(bodies: list[np.ndarray], folder: str, length: int = LENGTH, **how) -> list[np.ndarray]:
    """For each body the starts of strings of ``length`` bytes that also start elsewhere in the bodies."""
    sizes = np.array([len(b) + 1 for b in bodies], np.int64)
    total = int(sizes.sum())
    if not total:
        return []
    text = np.memmap(f"{folder}/text", np.int16, "w+", shape=total)
    begin = np.cumsum(sizes) - sizes
    for b, at in zip(bodies, begin, strict=True):
        text[at : at + len(b)] = b
        text[at : at + len(b)] += 1
    return [m - at for m, at in zip(_marked(text, begin, sizes, folder, length, **how), begin, strict=True)]


def _marked(text: np.ndarray, begin: np.ndarray, sizes: np.ndarray, folder: str, length: int, words: bool = False, **how) -> list[np.ndarray]:
    """Starts within a separated text (0 between bodies) of windows that repeat, by body.

    With ``words`` a window is ``length`` words from space to space, and starts are the body's first place plus a word's number.
    """
    mark = np.zeros(len(text), bool)
    need, cap = None, length
    if words:
        gaps = np.flatnonzero(text == SPACE)
        owner = np.searchsorted(begin, gaps, side="right") - 1
        fits = np.flatnonzero(owner[:-length] == owner[length:])
        wide = gaps[fits + length] - gaps[fits] + 1
        if not len(fits):
            return [np.zeros(0, np.int64) for _ in begin]
        need = np.full(len(text), np.iinfo(np.int32).max, np.int32)
        need[gaps[fits]] = wide
        cap = int(wide.max())
    before: dict[str, int] = {}

    def sink(p: np.ndarray, common: np.ndarray) -> None:
        far = np.flatnonzero(common >= (length if need is None else need[p]))
        mark[p[far]] = True
        mark[p[far[far > 0] - 1]] = True
        if len(far) and far[0] == 0:
            mark[before["last"]] = True
        before["last"] = int(p[-1])

    Suffixes(text, cap, folder, **how).induce(sink)
    hits = np.flatnonzero(mark)
    body = np.searchsorted(begin, hits, side="right") - 1
    if words:
        hits = np.searchsorted(gaps, hits) - np.searchsorted(gaps, begin)[body] + begin[body]
    else:
        ok = hits + length <= begin[body] + sizes[body] - 1  # whole within its body
        hits, body = hits[ok], body[ok]
    cut = np.searchsorted(body, np.arange(len(begin) + 1))
    return [hits[cut[i] : cut[i + 1]] for i in range(len(begin))]


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges [lo, hi)."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:] - 1, len(hi) - 1)]


def _bytes(b: pa.RecordBatch, i: int) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8") for x in b.column(i)]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose texts take SLICE bytes at most, or of one row."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _pieces(text: bytes, length: int, words: bool):
    """A function (start, windows) that gives the bytes of a region of a text, of a spaced one if ``words``."""
    if not words:
        return lambda s, n: text[s : s + n + length - 1]
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return lambda s, n: text[gaps[s] : gaps[s + n + length - 1] + 1]


def removed_ranges(docs: DataFrame, length: int = LENGTH, shard_bytes: int = 2 << 20, hot_bytes: int = 64 << 20, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, text_hash, text), and (doc_id, text_hash, ranges) of those that lose something, in words if ``words``."""
    spark = docs.sparkSession
    gram, sized = WORD_GRAM if words else GRAM, ", bytes int" if words else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2):
            texts = _bytes(b, 2)
            if words:
                texts = [spaced(t) for t in texts]
            owner, start, size, name, twice = regions(texts, length, gram, words=words)
            h = xxhash.xxh3_64_intdigest
            digest, n_bytes, at = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.int32), -1
            for k, (o, s, n) in enumerate(zip(owner.tolist(), start.tolist(), size.tolist(), strict=True)):
                if o != at:
                    at, piece = o, _pieces(texts[o], length, words)
                body = piece(s, n)
                digest[k], n_bytes[k] = h(body), len(body)
            for lo in range(0, len(owner), 50_000):
                part = slice(lo, lo + 50_000)
                take = pa.array(owner[part])
                more = [pa.array(n_bytes[part])] if words else []
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(name[part]), pa.array(digest[part].view(np.int64)), pa.array(start[part]), pa.array(size[part].astype(np.int32)), pa.array(twice[part]), *more],
                    names=["doc_id", "text_hash", "name", "digest", "start", "windows", "twice", *["bytes"] * words],
                )

    paths: list[str] = []  # tables that go before this function ends
    found = stash(rows.mapInArrow(tidied(cut_up), f"doc_id {kind}, text_hash bigint, name bigint, digest bigint, start bigint, windows int, twice boolean{sized}"), paths)
    # one row for each different region of a name, with one of the places where it stands
    content = found.groupBy("name", "digest").agg(F.count("*").alias("times"), F.min(F.struct("start", "text_hash", "doc_id")).alias("at"), F.first("windows").alias("windows"), F.bool_or("twice").alias("twice"), *[F.first("bytes").alias("bytes")] * words)
    size_of = F.col("bytes").cast("bigint") if words else F.col("windows") + length - 1
    names = content.groupBy("name").agg(F.count("*").alias("different"), F.sum("times").alias("total"), F.sum(size_of).alias("size"), F.bool_or("twice").alias("any_twice")).where("total > 1 or any_twice")
    kept = stash(content.join(names, "name").select("name", "digest", "times", "at", "windows", *["bytes"] * words, "size", (F.col("any_twice") | (F.col("different") > 1)).alias("open")), paths)
    whole = found.join(kept.where("times > 1").select("name", "digest"), ["name", "digest"]).select("doc_id", "text_hash", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + length - 1).alias("hi"))
    # what the suffix order has to decide
    open_ = kept.where("open").select("name", "times", "windows", (F.col("size") > hot_bytes).alias("hot"), "at.*")
    wanted = open_.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_list(F.struct("start", "windows", "name", "times", "hot")).alias("parts"))
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted._d) & (rows.text_hash == wanted._h)).select("doc_id", "text_hash", "text", "parts")
    if found.groupBy("doc_id", "text_hash", "start").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "text_hash"])  # of rows alike in id and text one is enough

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2):
            out: list[tuple] = []
            for i, text in enumerate(_bytes(b, 2)):
                piece = _pieces(spaced(text) if words else text, length, words)
                for p in b.column(3)[i].as_py():
                    body = piece(p["start"], p["windows"])
                    cuts = [(p["name"], 0, p["windows"])]
                    if p["hot"]:
                        _, s, n, second, _ = regions([body], length, gram, 1, words)
                        cuts = [(int(x), int(y), int(z)) for x, y, z in zip(mix64(np.full(len(s), p["name"], np.int64).view(np.uint64) ^ second.view(np.uint64)).view(np.int64), s, n, strict=True)]
                    part = _pieces(body, length, words)
                    for name, s, n in cuts:
                        out.append((b.column(0)[i], b.column(1)[i].as_py(), p["start"] + s, name, part(s, n), p["times"] > 1))
                if len(out) > 5_000:
                    yield shape(out)
                    out = []
            if out:
                yield shape(out)

    def shape(out: list[tuple]) -> pa.RecordBatch:
        ids = pa.array([x[0].as_py() for x in out], out[0][0].type)
        return pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in out], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (4, pa.binary()), (5, pa.bool_())))], names=["doc_id", "text_hash", "start", "name", "body", "sure"])

    n_bytes = kept.where("open").agg(F.coalesce(F.sum(size_of + 1), F.lit(0))).first()[0]
    shards = max(1, -(-int(n_bytes) // shard_bytes))
    bodies = texts.mapInArrow(tidied(take_out), f"doc_id {kind}, text_hash bigint, start bigint, name bigint, body binary, sure boolean")

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard: its bodies go to disk, only their places stay in memory."""
        with tempfile.TemporaryDirectory() as folder:
            ids, hashes, starts, sure, sizes = [], [], [], [], []
            total = 0
            with open(f"{folder}/text", "wb") as f:
                for b in batches:
                    ids.append(b.column(0))
                    hashes.append(b.column(1))
                    starts.append(b.column(2).to_numpy())
                    sure.append(b.column(5).to_numpy(zero_copy_only=False))
                    for body in b.column(4):
                        t = np.frombuffer(body.as_buffer(), np.uint8).astype(np.int16)
                        f.write((t + np.int16(1)).tobytes() + b"\0\0")
                        sizes.append(len(t) + 1)
                        total += len(t) + 1
            if not total:
                return
            size = np.array(sizes, np.int64)
            begin = np.cumsum(size) - size
            text = np.memmap(f"{folder}/text", np.int16, "r", shape=total)
            start = np.concatenate(starts)
            lo, hi, who = [], [], []
            for i, hits in enumerate(_marked(text, begin, size, folder, length, words)):
                if len(hits):
                    a, z = merge(hits - begin[i], hits - begin[i] + length)
                    lo.append(start[i] + a)
                    hi.append(start[i] + z)
                    who.append(np.full(len(a), i))
            del text
        if not lo:
            return
        at = np.concatenate(who)
        keep = ~np.concatenate(sure)[at]  # of the others every window is known to repeat
        take = pa.array(at[keep])
        col = lambda x: pa.chunked_array(x).combine_chunks().take(take)
        yield pa.RecordBatch.from_arrays([col(ids), col(hashes), pa.array(np.concatenate(lo)[keep]), pa.array(np.concatenate(hi)[keep])], names=["doc_id", "text_hash", "lo", "hi"])

    single = bodies.repartition(shards, "name").mapInArrow(tidied(sort_shard), f"doc_id {kind}, text_hash bigint, lo bigint, hi bigint")
    ranges = whole.unionByName(single).groupBy("doc_id", "text_hash", "lo").agg(F.max("hi").alias("hi"))  # repeated rows give the same ranges
    ranges = stash(ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    drop_tables(spark, paths)
    return rows, ranges


def _keep(text: bytes, ranges: list[dict] | None, words: bool = False) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and runs removed; ranges of words go with the space after them."""
    if not ranges:
        return text, 0, 0
    lo, hi = merge(np.array([r["lo"] for r in ranges], np.int64), np.array([r["hi"] for r in ranges], np.int64))
    if words:
        starts = np.append(word_starts(text), len(text))
        lo, hi = starts[lo], starts[hi]
    edge = [0, *(x for pair in zip(lo.tolist(), hi.tolist(), strict=True) for x in pair), len(text)]
    left = b"".join(text[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
    return left, len(text) - len(left), len(lo)


def dedup(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left of it) for every row of ``docs``.

    A cut may fall within a UTF-8 character; the digest is of the bytes that are left, ``text`` leaves the pieces out.
    """
    rows, ranges = removed_ranges(docs, length, **how)
    kind = docs.schema["doc_id"].dataType.simpleString()
    r = ranges.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "ranges")
    both = rows.join(r, rows.doc_id.eqNullSafe(r._d) & (rows.text_hash == r._h), "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            n, gone, spans, sha, kept = [], [], [], [], []
            for i, text in enumerate(_bytes(b, 1)):
                left, g, s = _keep(text, b.column(2)[i].as_py())
                n.append(len(text))
                gone.append(g)
                spans.append(s)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
            )

    return both.mapInArrow(tidied(run), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")


def strip(docs: DataFrame, length: int = LENGTH, words: bool = False, **how) -> DataFrame:
    """The rows of ``docs`` with repeated strings of ``length`` bytes (or words) left out of ``text``; other columns stay as they are.

    A cut may fall within a UTF-8 character; such a piece of a character goes too, so the text stays valid.
    """
    _, ranges = removed_ranges(docs, length, words=words, **how)
    r = ranges.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("ranges").alias("_ranges"))
    both = docs.join(r, docs.doc_id.eqNullSafe(r._d) & (F.xxhash64(docs.text) == r._h), "left").select(docs.columns + ["_ranges"])
    names = docs.columns
    text_at, n = names.index("text"), len(names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, text_at):
            out = []
            for i, x in enumerate(b.column(text_at)):
                t, k = x.as_py(), b.column(n)[i].as_py()
                out.append(_keep(t.encode("utf-8"), k, words)[0].decode("utf-8", "ignore") if t is not None and k else t)
            cols = [pa.array(out, pa.string()) if c == text_at else b.column(c) for c in range(n)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return both.mapInArrow(tidied(run), kinds)


def brute(texts: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(removed, runs, kept) by counting every string of ``length`` bytes; for tests."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        a = np.frombuffer(t, np.uint8)
        out.append((int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), a[~gone].tobytes()))
    return out
