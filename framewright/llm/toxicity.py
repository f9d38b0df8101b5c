"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A bag is the hashed byte n-grams (and the words themselves) of a few neighbouring words, so an unseen misspelling shares
most of its n-gram vectors with the word it imitates.  A document scores as its most toxic bag: a bag is a short window
because an average over a long document would drown one insult.  Training fits embeddings and softmax together on the
bag of each labelled document that the model finds most toxic now (starting from the bag with the most telling word).

The classifier is fitted on a bounded sample of labelled rows: ``per_class`` documents of each class with at most
``max_bytes`` of text, the first by a hash of their id.  Everything is scored, whole.

Defined cases: null or empty text, or text without a word, scores the share of toxic labels seen (0 if none were seen);
if only one class was seen every text scores as that class; repeated rows score each; null labels teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import crc_mod, give_back, ragged, segment_sum, subword_buckets, tidied

SIZES = (3, 4, 5)
BITS = 18
DIM = 8
WINDOW = 2
#: Words whose n-grams are hashed or summed at once, in training: the hashes take many times the bytes of the words.
SLICE = 8_192
_words = re.compile(r"[^\s|]+").findall


def words_of(text: str | None) -> list[str]:
    return _words((text or "").lower())


class Model:
    """Embeddings and a two-way linear softmax; ``bucket`` is what one n-gram adds to the logit of class 1."""

    def __init__(self, embed: np.ndarray, out: np.ndarray, bias: np.ndarray, base: float, only: int | None = None):
        self.embed, self.out, self.bias, self.base, self.only = embed, out, bias, base, only
        self.bucket = (embed @ (out[:, 1] - out[:, 0])).astype(np.float32)

    def word_values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        b, n = subword_buckets(words, SIZES, BITS)
        return segment_sum(self.bucket[b], n), n.astype(np.float64)

    def window_logits(self, s: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Logits of all windows of WINDOW words of one document (one window if it is shorter)."""
        w = min(WINDOW, len(s))
        cs, cm = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(m)])
        return (cs[w:] - cs[:-w]) / (cm[w:] - cm[:-w]) + (self.bias[1] - self.bias[0])

    def score(self, texts: list[str | None]) -> list[float]:
        if self.only is not None:
            return [float(self.only)] * len(texts)
        docs = [words_of(t) for t in texts]
        index: dict[str, int] = {}
        at = [np.fromiter((index.setdefault(w, len(index)) for w in d), np.int64, len(d)) for d in docs]
        s, m = self.word_values(list(index))
        out = []
        for a in at:
            out.append(1 / (1 + np.exp(-float(self.window_logits(s[a], m[a]).max()))) if len(a) else self.base)
        return out


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words, and how many each has, a slice at a time."""
    buckets, sizes = [], []
    for lo in range(0, len(words), SLICE):
        b, n = subword_buckets(words[lo : lo + SLICE], SIZES, BITS)
        buckets.append(b.astype(np.int32))
        sizes.append(n)
    return np.concatenate(buckets), np.concatenate(sizes)


def train(rows: list[tuple[str | None, int]], epochs: int = 24, seed: int = 7) -> Model:
    index: dict[str, int] = {}
    at, y, seen = [], [], []
    for text, label in rows:  # a document is kept as the numbers of its words
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words_of(text)), np.int32)
        seen.append(int(label))
        if len(ids):
            at.append(ids)
            y.append(int(label))
    base = float(np.mean(seen)) if seen else 0.0
    if len(set(y)) < 2:
        return Model(np.zeros((1 << BITS, DIM), np.float32), np.zeros((DIM, 2)), np.zeros(2), base, only=seen[0] if seen else 0)
    y = np.array(y)
    # document frequencies by class choose the first bag of each document
    df = np.zeros((2, len(index)))
    for a, c in zip(at, y, strict=True):
        df[c, np.unique(a)] += 1
    n = np.bincount(y, minlength=2)
    telling = np.log((df[1] + 0.1) / (n[1] + 0.2)) - np.log((df[0] + 0.1) / (n[0] + 0.2))
    tell = telling * np.log1p(df.sum(axis=0))
    vocab = list(index)
    bags, size = _features(vocab)
    first = np.cumsum(size) - size

    def word_sums(bucket: np.ndarray) -> np.ndarray:
        """What each word adds to the logit, a slice at a time."""
        cuts = range(0, len(size), SLICE)
        return np.concatenate([segment_sum(bucket[bags[first[lo] : first[lo] + size[lo : lo + SLICE].sum()]], size[lo : lo + SLICE]) for lo in cuts])

    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float64)
    out, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    g_embed = np.full(1 << BITS, 1e-6)
    g_out, g_bias = np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    rate = 0.3

    def windows(model: Model | None) -> list[np.ndarray]:
        """The most telling bag of each document, and of a clean one also a random bag."""
        picked = []
        if model is not None:
            s = word_sums(model.bucket)
            m = size.astype(np.float64)
        for a in at:
            w = min(WINDOW, len(a))
            if model is None:
                v = np.lib.stride_tricks.sliding_window_view(tell[a], w).max(axis=1)
            else:
                v = model.window_logits(s[a], m[a])
            k = int(v.argmax())
            picked.append(a[k : k + w])
        return picked

    model = None
    for _ in range(epochs):
        chosen = windows(model)
        items = [(c, t) for c, t in zip(chosen, y, strict=True)]
        for a, t in zip(at, y, strict=True):
            if t == 0:
                k = int(rng.integers(0, max(1, len(a) - WINDOW + 1)))
                items.append((a[k : k + WINDOW], 0))
            else:  # any of the document's telling words, not only the one that the model knows best
                k = int(rng.choice(np.flatnonzero(tell[a] >= 0.6 * tell[a].max())))
                k = max(0, k - int(rng.integers(0, WINDOW)))
                items.append((a[k : k + WINDOW], 1))
        order = rng.permutation(len(items))
        for lo in range(0, len(order), 512):
            part = [items[i] for i in order[lo : lo + 512]]
            words = np.concatenate([p[0] for p in part])
            per = np.array([len(p[0]) for p in part])
            target = np.array([p[1] for p in part])
            idx = bags[ragged(first[words], size[words])]
            n_bag = segment_sum(size[words].astype(float), per).astype(np.int64)
            hidden = segment_sum(embed[idx], n_bag) / n_bag[:, None]
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(target)), target] -= 1
            p /= len(target)
            d_out, d_bias, d_hidden = hidden.T @ p, p.sum(axis=0), (p @ out.T) / n_bag[:, None]
            u, inv = np.unique(idx, return_inverse=True)
            owner = np.repeat(np.arange(len(part)), n_bag)
            g = np.stack([np.bincount(inv, d_hidden[owner, k], len(u)) for k in range(DIM)], axis=1)
            g_embed[u] += (g * g).mean(axis=1)
            embed[u] -= rate * g / np.sqrt(g_embed[u])[:, None]
            g_out += d_out * d_out
            out = out - rate * d_out / np.sqrt(g_out)
            g_bias += d_bias * d_bias
            bias = bias - rate * d_bias / np.sqrt(g_bias)
        model = Model(embed, out, bias, base)
    # the most toxic of many bags is above the average bag: move the bias so that documents, not bags, part at 0.5
    s, m = word_sums(model.bucket), size.astype(np.float64)
    top = np.array([model.window_logits(s[a], m[a]).max() for a in at])
    order = np.argsort(top)
    wrong = np.concatenate([[0], np.cumsum(y[order] == 1)]) + np.concatenate([np.cumsum((y[order] == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[top.min() - 1], np.sort(top), [top.max() + 1]])
    model.bias = bias - np.array([0.0, (edges[best[0]] + edges[best[-1] + 1]) / 2])
    model.embed = None  # the scorer needs only each bucket's share of the logit
    return model


def sample(docs: DataFrame, labels: DataFrame, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class; the ids are chosen among those with a text of ``max_bytes`` at most, then joined."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & (crc_mod("_id", 5) > 0))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.octet_length("_text") <= max_bytes)
    rows = rows.join(texts.select("_id"), "_id", "left_semi")
    ids = [rows.where(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    picked = F.broadcast(ids[0].unionAll(ids[1]))  # 2 x per_class small rows at most
    got = texts.join(picked, "_id").select("_text", "_y").toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def score(docs: DataFrame, labels: DataFrame, per_class: int = 3000, max_bytes: int = 16_384) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(sorted(sample(docs, labels, per_class, max_bytes))))
    give_back()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, s, lo, size = batch.column(1), [], 0, 0
            for hi in range(len(texts)):  # bound the words held at once
                size += len(texts[hi].as_py() or "")
                if size > 1 << 20 or hi == len(texts) - 1:
                    s += model.value.score(texts.slice(lo, hi + 1 - lo).to_pylist())
                    lo, size = hi + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out")).mapInArrow(tidied(run), f"doc_id {kind}, held_out boolean, score double, predicted int")
