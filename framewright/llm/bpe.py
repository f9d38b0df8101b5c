"""Byte-level BPE encoding and decoding.

Every text is split by the tokenizer's pattern.  The distinct pieces of a batch are laid out as padded numpy matrices,
one matrix for each length bucket.  In each round every row merges its leftmost pair of least rank; pairs are looked up
in an open-addressing hash table held in numpy arrays, and rows that have no pair left are compacted away.

A piece of ``LONG`` bytes or more is a matrix of one row.  There a round merges all places of the least rank at once
wherever this comes to the same as merging the leftmost of them round by round, so rounds are as many as different ranks.

Defined cases: null text counts as the empty text, which has no ids; repeated rows are encoded each; columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import tidied

NONE = np.int32(2**31 - 1)
LONG = 2048
#: Pieces remembered by one worker before its memory is emptied; it changes speed only.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> rank of their concatenation, by linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(k)
        while len(k):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = k[free]  # of several for one slot the last stays
            won = self.keys[slot] == k
            self.values[slot[won]] = v[won]
            k, v, slot = k[~won], v[~won], (slot[~won] + 1) & self.mask

    def _slot(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair does not merge or an id is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        k = (left[at].astype(np.int64) << 32) | right[at]
        slot = self._slot(k)
        while len(at):
            found = self.keys[slot]
            hit = found == k
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            at, k, slot = at[go], k[go], (slot[go] + 1) & self.mask
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, tuple[str, bytes, bytes]] = {}

    # -- encoding -----------------------------------------------------------------------------------------------
    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[i] = [rank]
            elif len(p) >= LONG:
                out[i] = self._encode_long(p)
            elif p:
                buckets.setdefault(max(2, (len(p) + 3) // 4) if len(p) <= 32 else 8 + (len(p) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            for at in range(0, len(rows), 65_536):
                self._encode_bucket(pieces, rows[at : at + 65_536], out)
        return out

    def _encode_bucket(self, pieces: list[bytes], rows: list[int], out: list[list[int]]) -> None:
        lens = np.fromiter((len(pieces[i]) for i in rows), np.int64, len(rows))
        width = int(lens.max())
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < lens[:, None], self.byte_id[raw], np.int32(-1))
        left = np.arange(len(rows))  # which row of the bucket a row of the matrix is
        rank = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        done: list[np.ndarray | None] = [None] * len(rows)
        while len(left):
            at = rank.argmin(axis=1)
            r = np.arange(len(left))
            best = rank[r, at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[left[k]] = ids[k]
                go = ~over
                ids, rank, left, at, best = ids[go], rank[go], left[go], at[go], best[go]
                if not len(left):
                    break
                r = np.arange(len(left))
            ids[r, at] = best
            # close the gap behind the merged pair
            cols = np.arange(ids.shape[1] - 1)
            ids = np.where(cols <= at[:, None], ids[:, :-1], ids[:, 1:])
            if ids.shape[1] == 1:
                for k in r:
                    done[left[k]] = ids[k]
                break
            cols = cols[:-1]
            rank = np.where(cols < at[:, None], rank[:, :-1], rank[:, 1:])
            last = rank.shape[1]
            for shift in (-1, 0):
                j = at + shift
                ok = np.flatnonzero((j >= 0) & (j < last))
                rank[ok, j[ok]] = self.pairs.get(ids[ok, j[ok]], ids[ok, j[ok] + 1])
        for i, row in zip(rows, done, strict=True):
            out[i] = row[row >= 0].tolist()

    def _encode_long(self, piece: bytes) -> list[int]:
        """One long row: a round merges all places of the least rank from the left, where that is what rounds of one merge each come to.

        It is, unless a merge makes a pair of a lesser rank than its own (with the token before it as it is by then, or with
        the token after it as it is before its own merge): then the round merges the leftmost place only.
        """
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of places that overlap every other one, from the left of each run
                run = np.flatnonzero(np.append(True, np.diff(at) > 1))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
                token = np.full(len(at), best, np.int32)
                before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
                before[1:][at[1:] == at[:-1] + 2] = best
                after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                if min(self.pairs.get(before, token).min(), self.pairs.get(token, after).min()) < best:
                    at = at[:1]
            ids[at] = best
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            new = at - np.arange(len(at))  # where the merged tokens come to stand
            rank = rank[stay[1:]]  # a pair goes with its right token
            ids = ids[stay]
            touched = np.unique(np.concatenate([new - 1, new]))
            touched = touched[(touched >= 0) & (touched < len(rank))]
            rank[touched] = self.pairs.get(ids[touched], ids[touched + 1])
        return ids.tolist()

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that aren't remembered; remember each with its ids as text, their decoded bytes, and the ids packed."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in set(pieces) if p not in self.known]
        for p, ids in zip(new, self.encode_pieces([p.encode("utf-8") for p in new]), strict=True):
            self.known[p] = (" ".join(map(str, ids)), self.decode(ids), np.array(ids, "<i4").tobytes())

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces([p.encode("utf-8") for p in self.split(text)]) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


#: Characters of text whose distinct pieces are encoded together.
GROUP = 2 << 20


def encode_texts(texts: Iterable[str | None], bpe: ByteBPE) -> Iterator[tuple[str, bytes, bytes]]:
    """For each text its ids as decimals joined by a space, the bytes that these ids decode to, and the ids as 32-bit integers."""

    def flush():
        bpe.learn({p for pieces in held for p in pieces})
        for pieces in held:
            both = [bpe.known[p] for p in pieces]
            yield " ".join([x[0] for x in both]), b"".join([x[1] for x in both]), b"".join([x[2] for x in both])

    held, chars = [], 0
    for t in texts:
        held.append(bpe.split(t or ""))
        chars += len(t or "")
        if chars >= GROUP:
            yield from flush()
            held, chars = [], 0
    yield from flush()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "digest") -> DataFrame:
    """Encode and decode every text.

    ``keep='digest'`` gives (id, n_tokens, ids_sha256, decoded_sha256), ``keep='packed'`` also the ids themselves, as
    little-endian 32-bit integers in a binary column; ``keep='ids'`` gives (id, n_tokens, ids array<int>, decoded binary).
    """
    digest = keep != "ids"
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary") + (", ids_packed binary" if keep == "packed" else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, a, b, c = [], [], [], []
            for ids, raw, packed in encode_texts((x.as_py() for x in batch.column(1)), bpe):
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(sha(ids.encode("ascii")) if digest else [int(x) for x in ids.split()])
                b.append(sha(raw) if digest else raw)
                c.append(packed)
            more = ([pa.array(c, pa.binary())], ["ids_packed"]) if keep == "packed" else ([], [])
            kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, kinds[0]), pa.array(b, kinds[1]), *more[0]], names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")), *more[1]])
        bpe.known.clear()  # the worker outlives the task

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every list of ids; a null list gives no bytes."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            raw = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(tidied(run), f"`{id_col}` {id_type}, decoded binary")
