"""Language identification: a linear-chain conditional random field labels the words of code-switched text.

A word's features are hashed: the word, its prefixes and suffixes, its byte n-grams, and whether it stands in the
lexicon of each language (the words that most of that language's learning documents use).  Transitions between the
labels of neighbouring words are learned with the feature weights; forward-backward gives every word's posterior.

Learning documents are labelled as a whole, so learning chains are spliced from runs of words of several documents: the
transitions then know what switching looks like.  The model is fitted on a bounded sample: ``per_lang`` documents of each
language of at most ``max_bytes``, the first by a hash of their id; a language short of such documents is also learned from
runs of words of its longer ones, one of each, from a place given by the hash.  Every whole text is labelled.

A document's language is the one with the largest mean posterior over its words; that mean is its score.

Chains are whole texts, in bounded memory.  Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every text if no language was learned;
rows with null language teach nothing; ties go to the language that sorts first; repeated rows are labelled each.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import crc_mod, ragged, segment_sum, subword_buckets, tidied

BITS = 18
SIZES = (2, 3)
AFFIXES = (1, 2, 3, 4)
#: Words that are worked through at once; chains are whole texts, however long.
STEP = 64
LEXICON = 300
_words = re.compile(r"[^\W\d_]+").findall
_letters = regex.compile(r"\p{L}+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode's categories L), lower-cased; numerals of all kinds are no letters."""
    found = _words((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ([w] if w.isalpha() else _letters(w))]


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (steps, chains, labels) and log-partition of chains of emission scores; ``lens`` must not increase.

    At step t only the first k chains, those longer than t, are alive.
    """
    steps, chains, labels = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    tr = np.exp(trans)
    alpha = np.zeros_like(e)
    scale = np.ones((steps, chains))
    alive = [int(np.searchsorted(-lens, -t, side="left")) for t in range(steps)]  # lens > t
    for t in range(steps):
        k = alive[t]
        a = (np.exp(start)[None, :] if t == 0 else alpha[t - 1, :k] @ tr) * e[t, :k]
        scale[t, :k] = a.sum(axis=1)
        alpha[t, :k] = a / scale[t, :k, None]
    beta = np.ones_like(e)
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        beta[t, :k] = ((beta[t + 1, :k] * e[t + 1, :k]) @ tr.T) / scale[t + 1, :k, None]
    mask = np.arange(steps)[:, None] < lens[None, :]
    return alpha * beta * mask[:, :, None], (np.where(mask, np.log(scale) + top[:, :, 0], 0)).sum(axis=0)


def pair_posteriors(emit, trans, start, lens, post_alpha):  # noqa: D103  expected transitions, for the gradient
    steps, chains, labels = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    tr = np.exp(trans)
    out = np.zeros((labels, labels))
    alpha = np.exp(start)[None, :] * e[0]
    alpha /= alpha.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        k = int((lens > t).sum())
        if not k:
            break
        joint = alpha[:k, :, None] * tr[None] * e[t, :k, None, :]
        nxt = joint.sum(axis=1)
        # posterior of the pair: p(next | all) spread over p(previous | next, words before)
        out += (joint / np.maximum(nxt[:, None, :], 1e-300) * post_alpha[t, :k, None, :]).sum(axis=0)
        alpha = nxt / nxt.sum(axis=1, keepdims=True)
    return out


def posteriors(emit: np.ndarray, flat: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray, slab: int = 4096) -> np.ndarray:
    """Posterior of every word of chains laid end to end: word i has the scores ``emit[flat[i]]``, chain k has ``sizes[k]`` words.

    Chains are whole.  They are worked through in blocks of STEP words: each block's product of transitions and emissions
    is found for many blocks at once, passed on from block to block of a chain in both directions, and then each block
    is run forward and backward between what comes in on either side.
    """
    labels = len(start)
    post = np.zeros((len(flat), labels))
    n_blocks = -(-sizes // STEP)
    owner = np.repeat(np.arange(len(sizes)), n_blocks)
    k = ragged(np.zeros(len(sizes), np.int64), n_blocks)
    begin = (np.cumsum(sizes) - sizes)[owner] + k * STEP
    lens = np.minimum(STEP, sizes[owner] - k * STEP)
    tr, st = np.exp(trans), np.exp(start)
    total = len(owner)

    def scores(at: slice) -> np.ndarray:
        """Emissions of blocks, step by step, the best label's being 1; steps past a block's end repeat its last word."""
        n, b = lens[at], begin[at]
        e = emit[flat[np.minimum(b[None, :] + np.arange(int(n.max()))[:, None], (b + n - 1)[None, :])]]
        return np.exp(e - e.max(axis=2, keepdims=True))

    # a chain's first block begins with the start weights whatever comes in, so its product has equal rows
    whole = np.zeros((total, labels, labels))
    for lo in range(0, total, slab):
        at = slice(lo, min(total, lo + slab))
        e, n = scores(at), lens[at]
        first = (k[at] == 0)[:, None, None]
        m = np.where(first, st[None, None, :], tr[None]) * e[0][:, None, :]
        for t in range(1, len(e)):
            go = np.flatnonzero(n > t)
            nxt = (m[go] @ tr) * e[t, go][:, None, :]
            m[go] = nxt / nxt.sum(axis=(1, 2), keepdims=True)
        whole[at] = m
    come, back = np.full((total, labels), 1.0 / labels), np.full((total, labels), 1.0 / labels)
    first_of = np.cumsum(n_blocks) - n_blocks
    for step in range(1, int(n_blocks.max()) if len(sizes) else 0):
        on = first_of[n_blocks > step] + step  # from the block before
        v = np.einsum("bi,bij->bj", come[on - 1], whole[on - 1])
        come[on] = v / v.sum(axis=1, keepdims=True)
        off = first_of[n_blocks > step] + n_blocks[n_blocks > step] - 1 - step  # from the block after
        v = np.einsum("bij,bj->bi", whole[off + 1], back[off + 1])
        back[off] = v / v.sum(axis=1, keepdims=True)
    for lo in range(0, total, slab):
        at = slice(lo, min(total, lo + slab))
        e, n = scores(at), lens[at]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        a = np.where((k[at] == 0)[:, None], st[None, :], come[at] @ tr) * e[0]
        alpha[0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, len(e)):
            go = np.flatnonzero(n > t)
            a = (alpha[t - 1, go] @ tr) * e[t, go]
            alpha[t, go] = a / a.sum(axis=1, keepdims=True)
        for t in range(len(e) - 1, -1, -1):
            end = np.flatnonzero(n == t + 1)
            beta[t, end] = back[at][end]
            if len(go := np.flatnonzero(n > t + 1)):
                b = (beta[t + 1, go] * e[t + 1, go]) @ tr.T
                beta[t, go] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        ok = np.arange(len(e))[:, None] < n[None, :]
        where = (begin[at][None, :] + np.arange(len(e))[:, None])[ok]
        post[where] = p[ok] / p[ok].sum(axis=1, keepdims=True)
    return post


class Model:
    def __init__(self, labels: list[str], lexicon: list[frozenset[str]]):
        self.labels, self.lexicon = labels, lexicon
        n = len(labels)
        self.weights = np.zeros((1 << BITS, n), np.float32)
        self.lex = np.zeros((n, n))
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)

    def in_lexicon(self, words: list[str]) -> np.ndarray:
        return np.array([[w in s for s in self.lexicon] for w in words], float).reshape(len(words), len(self.lexicon))

    def emissions(self, words: list[str]) -> np.ndarray:
        out = [np.zeros((0, len(self.labels)))]
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            b, n = subword_buckets(part, SIZES, BITS, AFFIXES)
            out.append(segment_sum(self.weights[b], n) + self.in_lexicon(part) @ self.lex)
        return np.concatenate(out)

    def label_words(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Posterior of every word of every document (words x labels)."""
        index: dict[str, int] = {}
        at = [np.fromiter((index.setdefault(w, len(index)) for w in d), np.int64, len(d)) for d in docs]
        emit = self.emissions(list(index))
        flat = np.concatenate([np.zeros(0, np.int64), *at])
        sizes = np.array([len(a) for a in at], np.int64)
        post = posteriors(emit, flat, sizes, self.trans, self.start)
        return np.split(post, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        docs = [words_of(t) for t in texts]
        if not self.labels:
            return [("und", 0.0)] * len(texts)
        out = []
        for p in self.label_words(docs):
            if not len(p):
                out.append(("und", 0.0))
                continue
            mean = p.mean(axis=0)
            k = int(mean.argmax())
            out.append((self.labels[k], float(min(1.0, max(0.0, mean[k])))))
        return out


def train(rows: list[tuple[str, str]], chains: int = 6000, length: int = 40, epochs: int = 3, seed: int = 11) -> Model:
    """Fit on (text, language) rows by stochastic gradient steps on the chains' log-likelihood."""
    by: dict[str, list[list[str]]] = defaultdict(list)
    for text, lang in rows:
        if w := words_of(text):
            by[lang].append(w)
    labels = sorted(by)
    lexicon = []
    for lang in labels:
        df = Counter(w for d in by[lang] for w in set(d))
        lexicon.append(frozenset(w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]))
    model = Model(labels, lexicon)
    if len(labels) < 2:
        return model
    rng = np.random.default_rng(seed)
    words, y = np.empty((chains, length), object), np.zeros((chains, length), np.int64)
    for i in range(chains):
        at, k = 0, int(rng.integers(len(labels)))
        while at < length:  # a run from one document, then another, often of another language
            d = by[labels[k]][int(rng.integers(len(by[labels[k]])))]
            n = min(length - at, int(rng.integers(4, 30)))
            lo = int(rng.integers(0, max(1, len(d) - n + 1)))
            part = d[lo : lo + n]
            words[i, at : at + len(part)], y[i, at : at + len(part)] = part, k
            at += len(part)
            k = int(rng.integers(len(labels)))
    vocab = sorted(set(words.ravel()))
    index = {w: i for i, w in enumerate(vocab)}
    at = np.array([[index[w] for w in row] for row in words])
    feats, size = subword_buckets(vocab, SIZES, BITS, AFFIXES)
    first = np.cumsum(size) - size
    lex = model.in_lexicon(vocab)
    n = len(labels)
    weights = np.zeros((1 << BITS, n))
    g2 = np.full(1 << BITS, 1e-4)
    g_lex, g_tr, g_st = np.full((n, n), 1e-4), np.full((n, n), 1e-4), np.full(n, 1e-4)
    for _ in range(epochs):
        order = rng.permutation(chains)
        for lo in range(0, chains, 128):
            c = order[lo : lo + 128]
            w, inv = np.unique(at[c].T, return_inverse=True)  # distinct words of the chains
            inv = inv.reshape(length, len(c))
            f = feats[ragged(first[w], size[w])]
            emit = segment_sum(weights[f], size[w]) + lex[w] @ model.lex
            lens = np.full(len(c), length)
            post, _ = forward_backward(emit[inv], model.trans, model.start, lens)
            gold = np.zeros_like(post)
            np.put_along_axis(gold, y[c].T[:, :, None], 1.0, axis=2)
            diff = (post - gold) / len(c)
            d_word = np.stack([np.bincount(inv.ravel(), diff[:, :, k].ravel(), len(w)) for k in range(n)], axis=1)
            u, where = np.unique(f, return_inverse=True)
            owner = np.repeat(np.arange(len(w)), size[w])
            g = np.stack([np.bincount(where, d_word[owner, k], len(u)) for k in range(n)], axis=1)
            g2[u] += (g * g).mean(axis=1)
            weights[u] -= 0.1 * g / np.sqrt(g2[u])[:, None]
            d_lex = lex[w].T @ d_word
            g_lex += d_lex * d_lex
            model.lex = model.lex - 0.1 * d_lex / np.sqrt(g_lex)
            want = pair_posteriors(emit[inv], model.trans, model.start, lens, post)
            yc = y[c]
            have = np.bincount((yc[:, :-1] * n + yc[:, 1:]).ravel(), minlength=n * n).reshape(n, n)
            d_tr = (want - have) / len(c)
            g_tr += d_tr * d_tr
            model.trans = model.trans - 0.1 * d_tr / np.sqrt(g_tr)
            d_st = diff[0].sum(axis=0)
            g_st += d_st * d_st
            model.start = model.start - 0.1 * d_st / np.sqrt(g_st)
    model.weights = weights.astype(np.float32)
    return model


def sample(docs: DataFrame, per_lang: int, max_bytes: int) -> list[tuple[str, str]]:
    """At most ``per_lang`` documents of each language that may be learned from, as (text, language)."""
    may = F.col("_l").isNotNull() & crc_mod("_id", 4).isin(0, 1, 3)
    ids = docs.select(F.col("lang").alias("_l"), F.col("doc_id").alias("_id"), F.col("text").alias("_t"), F.xxhash64("doc_id").alias("_h")).where(may)
    ids = ids.where(F.col("_t").isNotNull()).withColumn("_long", F.octet_length("_t") > max_bytes)
    # of a frequent language only a share by hash goes further, twice what is wanted: no task meets a language's rows
    sizes = {(r._l, r._long): r.n for r in ids.groupBy("_l", "_long").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for (lang, long), n in sizes.items():
        want = max(0, per_lang - sizes.get((lang, False), 0)) if long else per_lang
        share = F.when((F.col("_l") == lang) & (F.col("_long") == long), F.lit(min(1.0, (2.0 * want + 50) / n) if want else 0.0)).otherwise(share)
    rows = ids.where(F.pmod("_h", F.lit(1_000_000)) < share * 1_000_000)
    # a long document gives a run of its words: the whole words of so many characters that they fit in max_bytes
    room = max_bytes // 4
    start = (F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) % F.greatest(F.lit(1), F.length("_t") - room + 1)).cast("int") + 1
    run = F.substring(F.col("_t"), F.greatest(F.lit(1), start), F.lit(room))
    whole = F.regexp_replace(run, r"^\S+\s+|\s+\S+$", "")
    rows = rows.withColumn("_t", F.when(F.col("_long"), whole).otherwise(F.col("_t")))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy("_long", "_h", "_t"))).where(F.col("_k") <= per_lang)
    return sorted((r._t, r._l) for r in first.select("_t", "_l").collect())


def predict(docs: DataFrame, per_lang: int = 400, max_bytes: int = 8_192) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, per_lang, max_bytes)))
    return annotate(docs.select("doc_id", "text", (crc_mod("doc_id", 4) == 2).alias("held_out")), model)


def accept(docs: DataFrame, least: float = 0.35, per_lang: int = 400, max_bytes: int = 8_192) -> DataFrame:
    """The rows, with all their columns, that are in a language: not ``und``, and one language has a mean posterior of ``least``.

    A text in several languages passes as long as one of them has a fair share; what no language claims goes.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, per_lang, max_bytes)))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo, size = batch.column(text_at), 0, 0
            for hi in range(len(texts)):
                size += len(texts[hi].as_py() or "")
                if size > 1 << 20 or hi == len(texts) - 1:
                    part = batch.slice(lo, hi + 1 - lo)
                    got = model.value.predict(part.column(text_at).to_pylist())
                    yield part.filter(pa.array([lang != "und" and score >= least for lang, score in got]))
                    lo, size = hi + 1, 0

    return docs.mapInArrow(tidied(run), docs.schema)


def annotate(docs: DataFrame, model) -> DataFrame:
    """Append lang_pred and score to the rows; ``text`` is dropped."""
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest))
            got, lo, size = [], 0, 0
            for hi in range(len(texts)):
                size += len(texts[hi].as_py() or "")
                if size > 1 << 20 or hi == len(texts) - 1:
                    got += model.value.predict(texts.slice(lo, hi + 1 - lo).to_pylist())
                    lo, size = hi + 1, 0
            cols = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.select(*rest, "text").mapInArrow(tidied(run), f"{kinds}, lang_pred string, score double")
