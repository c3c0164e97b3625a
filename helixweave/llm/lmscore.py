"""Language-model scores: a causal self-attention model over subword ids, beside a unigram base.

Subwords. A text is its A-Z-folded words; each word is encoded with a leading space by a public
byte-level BPE vocabulary (never trained here), and one end symbol closes the text. The model gives
p(symbol | before) = p(class | attention over the symbols before) * p(symbol | class, the symbol
before it in the word). A class holds symbols that begin words (the end symbol is one) or symbols
inside words, never both, so the second factor has one context for each class and all probabilities
of a next symbol sum to 1. Symbols, classes and the second factor come from counts over every training
text. The class part is one causal attention head, trained in numpy (Adam) on windows drawn from all
training texts, as many as grow with their bytes: one task trains on a first shard of windows, further
shards go on from its weights side by side, and their weights are averaged.
Texts run through windows of WINDOW symbols that overlap by CONTEXT; a symbol is scored once, in the
window where it has the most context, and a batch of windows is one masked matrix product.

Words. The symbols of a word and the chance that a word begins after it give the word a probability
P(word | before), which sums to at most 1 over all words. The score takes NEW * P + (1 - NEW) * c / N,
c of N being the word's exact count in all training texts: a mixture of two distributions, so again one.

Base. Word counts are exact and global. The counts of the about HOT most frequent words go to all tasks,
so that no word fills a task with its places. Of the other words, each step of texts deals by hash,
packed, the count in training texts and P at every place; the task of a hash range knows the counts of
all its words and returns, packed, each text's sums. No vocabulary is collected. Two different words
share a 64-bit hash with odds of 2**-64 a pair.

Edge cases: a null text is the empty text, which is the end symbol alone; a null doc_id is held out;
rows that repeat a doc_id are scored each; texts of any length are scored whole; an empty table gives
an empty result, and a table without training texts a model of even chances (N = 0). Further columns,
of any name, are ignored. Scores depend on the rows, not on their order or partitions, but for the
rounding of sums.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, Words, binary, cut, lookup, mix, n_parts, raw, steps
from .substring import _text_keys

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols 0..IDS-1 are the vocabulary's ids (at most 65535); END is the end symbol and stands before the first.
IDS = 50_257
END = IDS - 1
#: Windows that the attention weights learn from at least: ROUNDS rounds, or one for so many bytes of training text.
WINDOW_BYTES, ROUNDS, TRAIN_BATCH, RATE = 8192, 1500, 96, 0.02
#: Learning rate of the shards that go on from the first shard's weights.
NEXT_RATE = 0.005
SINGLE, GROUPS, WIDTH, KEY, WINDOW, CONTEXT, BATCH = 80, 40, 32, 16, 32, 8, 64
CLASSES = SINGLE + GROUPS + 2
#: Share of the subword model in a word's probability; the rest goes to the words of the training texts.
NEW = 0.9
#: Entries of the table of symbols by context, at most: the most frequent symbols are contexts of their own
#: while it has room; the others share that of their class, and a word's begin has one.
TABLE = 12_000_000
#: Frequent words whose counts are broadcast, about; all others are counted by hash.
HOT = 8192
#: Windows that leave a task at once, and those whose gradients are computed together.
SOME, AT_ONCE = 8192, 24
#: Sketches of the texts that hold an id, and of what follows it: columns.
HELD, NEXT = 12, 44


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    begins = np.zeros(IDS, bool)
    begins[END] = True
    for token, i in ranks.items():
        begins[i] = token[:1] == b" "
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), begins


def _encode(words: list[bytes], vocabulary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and the number of ids of each."""
    enc, begins = _encoding(vocabulary)
    if not words:
        return np.empty(0, np.uint16), np.empty(0, np.int64)
    ids = np.array(enc.encode_ordinary((b" " + b" ".join(words)).decode("utf-8", "replace")), np.uint16)
    at = np.flatnonzero(begins[ids])
    if len(at) != len(words) or at[0]:
        each = [enc.encode_ordinary((b" " + w).decode("utf-8", "replace")) for w in words]
        return np.array([i for e in each for i in e], np.uint16), np.array([len(e) for e in each])
    return ids, np.diff(at, append=len(ids))


class Texts:
    """Words and subwords of a batch; every distinct word is encoded once."""

    def __init__(self, buf, off, vocabulary: bytes):
        self.w = w = Words(buf, off)
        self.hash, first, self.inv = np.unique(w.hash, return_index=True, return_inverse=True)
        low = LOWER[buf].tobytes()
        self.ids, self.n = _encode([low[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], vocabulary)
        self.from_ = np.cumsum(self.n) - self.n

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols with END around each text; whether each begins a word (or ends a text); bounds of the texts."""
        n = self.n[self.inv]
        total = np.concatenate([[0], np.cumsum(n)])
        body = total[self.w.at]
        inside = np.repeat(self.from_[self.inv] - total[:-1], n) + np.arange(total[-1])
        row = np.repeat(np.arange(len(body) - 1), np.diff(body))
        at = np.arange(total[-1]) + 2 * row + 1
        bounds = body + 2 * np.arange(len(body))
        out, begins = np.full(bounds[-1], END, np.uint16), np.ones(bounds[-1], bool)
        out[at] = self.ids[inside]
        begins[at] = inside == np.repeat(self.from_[self.inv], n)
        return out, begins, bounds


# ---------------------------------------------------------------- the attention model


def new_classes(count: np.ndarray, held: np.ndarray, after: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(class of each id, compact id of each id, number of compact ids, number of classes that begin words).

    From the counts of all training texts. Classes 0 .. n - 1 begin words, the others are inside words.
    """
    known = np.flatnonzero(count)
    by = known[np.lexsort((known, -count[known]))]
    rest = by[SINGLE:]
    kinds = [(by[:SINGLE][begins[by[:SINGLE]] == first], rest[begins[rest] == first]) for first in (True, False)]
    # groups follow the occurrences of both kinds, at least one each
    share = [int(count[r].sum()) for _, r in kinds]
    groups = int(np.clip(np.rint(GROUPS * share[0] / max(1, sum(share))), 1, GROUPS - 1))
    cls, at, split = np.zeros(len(count), np.int64), 0, 0
    for (single, others), k, first in zip(kinds, (groups, GROUPS - groups), (True, False), strict=True):
        cls[single] = at + np.arange(len(single))
        at += len(single)
        cls[others] = at + _groups(held[others], after[others] / count[others][:, None], k)
        cls[(count == 0) & (begins == first)] = at + k
        at += k + 1
        split = split or at
    compact = np.where(begins, len(by), len(by) + 1)
    compact[by] = np.arange(len(by))
    return cls.astype(np.uint8), compact.astype(np.uint16), len(by) + 2, split


def _groups(held: np.ndarray, after: np.ndarray, k: int) -> np.ndarray:
    """k-means groups by the texts that hold an id and what follows it, on sketches."""
    if not len(held):
        return np.empty(0, np.int64)
    x = held.astype(float)
    x = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-9), 2 * after], 1)
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(15):
        near = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        for j in range(len(centre)):
            if (near == j).any():
                centre[j] = x[near == j].mean(0)
    return near


def new_weights(symbols: int, seed: int = 2) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
    return {"emb": f(0.5, symbols, WIDTH), "pos": f(0.3, WINDOW, WIDTH), "q": f(0.3, WIDTH, KEY), "k": f(0.3, WIDTH, KEY), "v": f(0.3, WIDTH, WIDTH), "out": f(0.2, WIDTH, CLASSES), "last": f(0.2, WIDTH, CLASSES), "bias": np.zeros(CLASSES, np.float32)}


_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def attend(w: dict, x: np.ndarray):
    """Class logits after each of the symbols x (B, WINDOW); masked so that none sees a later one."""
    e = w["emb"][x]
    h = e + w["pos"]
    # one product for all windows, where the weights are the same
    qkv = (h.reshape(-1, WIDTH) @ np.concatenate([w["q"], w["k"], w["v"]], 1)).reshape(*x.shape, -1)
    q, k, v = qkv[..., :KEY], qkv[..., KEY : 2 * KEY], qkv[..., 2 * KEY :]
    s = np.matmul(q, k.transpose(0, 2, 1))
    s *= np.float32(KEY**-0.5)
    s += _MASK
    s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(2, keepdims=True)
    both = np.empty((*x.shape, 2 * WIDTH), e.dtype)
    np.matmul(s, v, out=both[..., :WIDTH])
    both[..., WIDTH:] = e
    z = both.reshape(-1, 2 * WIDTH) @ np.concatenate([w["out"], w["last"]])
    z += w["bias"]
    return z.reshape(*x.shape, -1), (h, q, k, v, s, both)


def tables(w: dict) -> dict:
    """What each symbol and each place add to queries, keys and values; and what turns context and symbol to logits."""
    t = {f"{side}_{k}": np.ascontiguousarray(w[side] @ w[k]) for side in ("emb", "pos") for k in "qkv"}
    t["pos_q"], t["emb_q"] = (t[k] * np.float32(KEY**-0.5) for k in ("pos_q", "emb_q"))
    # a column of ones beside the values sums the weights, and one beside the symbol adds the bias
    one = lambda x: np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    return t | {"emb_v": one(t["emb_v"]), "pos_v": np.concatenate([t["pos_v"], np.zeros((WINDOW, 1), np.float32)], 1), "emb": one(w["emb"]), "out": np.concatenate([w["out"], w["last"], w["bias"][None]])}


_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _safe(z: np.ndarray) -> np.ndarray:
    """Rows that exp can take: less their maxima, where any value is large (in place)."""
    if z.size and max(z.max(), -z.min()) > 60:
        z -= z.max(-1, keepdims=True)
    return z


def class_logits(t: dict, x: np.ndarray) -> np.ndarray:
    """The logits of attend, from tables."""
    q, k, v = (t[f"emb_{c}"].take(x, 0) for c in "qkv")
    for a, c in ((q, "q"), (k, "k"), (v, "v")):
        a += t[f"pos_{c}"]
    s = np.matmul(q, k.transpose(0, 2, 1))
    if s.size and max(s.max(), -s.min()) > 60:  # what is masked must not be the maximum
        s += _MASK
        s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    s *= _CAUSAL
    c = np.matmul(s, v).reshape(-1, WIDTH + 1)
    both = np.empty((len(c), 2 * WIDTH + 1), np.float32)
    np.divide(c[:, :WIDTH], c[:, WIDTH:], out=both[:, :WIDTH])
    both[:, WIDTH:] = t["emb"].take(x.ravel(), 0)
    return (both @ t["out"]).reshape(*x.shape, CLASSES)


def _log_softmax(z):
    z -= z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def gradients(w: dict, x: np.ndarray, y: np.ndarray, use: np.ndarray) -> tuple[float, dict]:
    """Mean loss over the positions in use, and its gradients; a few windows at once, which caches hold."""
    loss, g, n = 0.0, {k: np.zeros_like(a) for k, a in w.items()}, max(1, int(use.sum()))
    for at in range(0, len(x), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        loss += _add_gradients(g, w, x[some], y[some], use[some], n)
    return loss, g


def _add_gradients(g: dict, w: dict, x: np.ndarray, y: np.ndarray, use: np.ndarray, n: int) -> float:
    """Adds these windows' share of the gradients to g and returns that of the loss; n: positions in use of all windows."""
    z, (h, q, k, v, s, both) = attend(w, x)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    each = (use / n).ravel().astype(z.dtype)
    z, h, at = _safe(flat(z)), flat(h), np.arange(x.size)
    hit = z[at, y.ravel()]
    np.exp(z, out=z)
    total = z @ np.ones(CLASSES, z.dtype)
    loss = float(((np.log(total) - hit) * each).sum())
    z *= (each / total)[:, None]
    z[at, y.ravel()] -= each
    both_z = flat(both).T @ z
    g["out"] += both_z[:WIDTH]
    g["last"] += both_z[WIDTH:]
    g["bias"] += np.ones(len(z), z.dtype) @ z
    d_both = (z @ np.concatenate([w["out"], w["last"]]).T).reshape(both.shape)
    c, dc = both[..., :WIDTH], d_both[..., :WIDTH]
    ds = np.matmul(dc, v.transpose(0, 2, 1))
    ds -= np.einsum("bij,bij->bi", dc, c)[..., None]
    ds *= s
    ds *= np.float32(KEY**-0.5)
    d_qkv = np.empty((*x.shape, 2 * KEY + WIDTH), z.dtype)
    np.matmul(ds, k, out=d_qkv[..., :KEY])
    np.matmul(ds.transpose(0, 2, 1), q, out=d_qkv[..., KEY : 2 * KEY])
    np.matmul(s.transpose(0, 2, 1), dc, out=d_qkv[..., 2 * KEY :])
    d_qkv = flat(d_qkv)
    h_qkv = h.T @ d_qkv
    for key, part in (("q", h_qkv[:, :KEY]), ("k", h_qkv[:, KEY : 2 * KEY]), ("v", h_qkv[:, 2 * KEY :])):
        g[key] += part
    dh = d_qkv @ np.concatenate([w["q"], w["k"], w["v"]], 1).T
    g["pos"] += dh.reshape(*x.shape, WIDTH).sum(0)
    # sums by symbol: places in their order
    dh += flat(d_both)[:, WIDTH:]
    order = np.argsort(x.ravel(), kind="stable")
    of = x.ravel()[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    g["emb"][of[first]] += np.add.reduceat(dh[order], first, 0)
    return loss


def windows_wanted(size: int) -> int:
    """Windows to learn from at least, of training texts of so many bytes; those of ``tiled`` count."""
    return max(ROUNDS * TRAIN_BATCH, -(-size // WINDOW_BYTES))


def tiled(out: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Windows end to end over each text, as rows of ``drawn``: every symbol but the first END is the next one in one of them."""
    many = -(-(np.diff(bounds) - 1) // WINDOW)
    row = np.repeat(np.arange(len(many)), many)
    return _rows_at(out, bounds, row, bounds[row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)))


def drawn(out: np.ndarray, bounds: np.ndarray, rate: float, keys: np.ndarray) -> np.ndarray:
    """Rows of a length and WINDOW + 1 symbols: about rate windows a symbol of each text, by hashes of its key."""
    size, k = np.diff(bounds), keys.view(U64)
    many = np.floor(rate * (size - 1) + (mix(k * U64(0x9E3779B97F4A7C15) + U64(1)) >> U64(11)).astype(float) / 2**53).astype(np.int64)
    row = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[row] + (mix(k[row] + (nth.astype(U64) + U64(2)) * U64(0xC2B2AE3D27D4EB4F)) % np.maximum(1, size[row] - WINDOW).astype(U64)).astype(np.int64)
    return _rows_at(out, bounds, row, start)


def _rows_at(out: np.ndarray, bounds: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW + 1)
    n = np.minimum(bounds[row + 1] - start, WINDOW + 1)
    # nothing of a neighbouring text
    got = np.where(np.arange(WINDOW + 1) < n[:, None], out[np.minimum(at, len(out) - 1)], np.uint16(END)) if len(row) else np.empty((0, WINDOW + 1), np.uint16)
    return np.concatenate([n[:, None].astype(np.uint16), got], 1)


def fit(rounds_of, rounds: int, cls: np.ndarray, compact: np.ndarray, symbols: int, w: dict | None = None, top: float = RATE) -> dict:
    """Weights after one Adam step for each array of windows; w: weights to go on from."""
    w = {k: a.copy() for k, a in w.items()} if w else new_weights(symbols)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step, got in enumerate(rounds_of, 1):
        use = np.arange(WINDOW) < got[:, :1].astype(np.int64) - 1
        x, y = np.where(use, compact[got[:, 1:-1]], compact[END]), np.where(use, cls[got[:, 2:]], 0).astype(np.int64)
        _, g = gradients(w, x, y, use)
        rate = top * min(1, max(0.02, 2 * (1 - step / (rounds + 1))))
        for key, d in g.items():
            m[key] *= 0.9
            m[key] += np.float32(0.1) * d
            v[key] *= 0.99
            v[key] += np.float32(0.01) * d * d
            down = np.sqrt(v[key])
            down *= (1 - 0.99**step) ** -0.5
            down += 1e-8
            np.divide(m[key], down, out=down)
            down *= rate / (1 - 0.9**step)
            w[key] -= down
    return w


def packed_weights(w: dict) -> bytes:
    return b"".join(a.astype(np.float32).tobytes() for a in w.values())


def unpacked_weights(data: bytes, symbols: int) -> dict:
    flat, at, out = np.frombuffer(data, np.float32), 0, {}
    for k, a in new_weights(symbols).items():
        out[k] = flat[at : at + a.size].reshape(a.shape)
        at += a.size
    return out


def n_contexts(symbols: int) -> int:
    return max(CLASSES + 1, min(symbols + CLASSES + 1, TABLE // symbols))


def contexts(cls: np.ndarray, compact: np.ndarray, symbols: int) -> np.ndarray:
    """The context that each id is for a symbol that follows it in the word; the last one is a word's begin."""
    own = n_contexts(symbols) - CLASSES - 1
    return np.where(compact < own, compact, own + cls.astype(np.int64))


def pair_codes(ctx: np.ndarray, compact: np.ndarray, symbols: int, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Context * symbols + compact id of each symbol."""
    last = n_contexts(symbols) - 1
    before = np.full(len(ids), last)
    before[1:] = ctx[ids[:-1]]
    before[begins] = last
    return before * symbols + compact[ids]


def emission(count: np.ndarray, cls: np.ndarray, compact: np.ndarray) -> np.ndarray:
    """log10 p(id | its class, context) by compact id: counts smoothed by those of all contexts.

    Ids that no training text has share two compact ids, evenly.
    """
    share = np.bincount(compact, minlength=count.shape[1])
    of = np.zeros(count.shape[1], np.int64)
    of[compact] = cls
    alone = count.sum(0) + 0.01 * share
    prior = alone / np.bincount(of, weights=alone, minlength=CLASSES)[of]
    out = np.empty(count.shape, np.float32)
    for k, row in enumerate(count):  # one at a time: the table may be large
        total = np.bincount(of, weights=row, minlength=CLASSES)
        out[k] = np.log10((row + 2 * prior) / (total[of] + 2)) - np.log10(np.maximum(share, 1))
    return out


def score_words(w: dict, em: np.ndarray, cls, compact, split: int, out, begins, bounds) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of every word in order, and of the end of each text.

    Every symbol but the leading END is scored exactly once.
    """
    size = np.diff(bounds) - 1
    stride = WINDOW - CONTEXT
    per = 1 + -(-np.maximum(size - WINDOW, 0) // stride)
    row = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    at = bounds[row] + nth * stride
    x, c = np.concatenate([compact[out], np.full(WINDOW, compact[END])]), np.concatenate([cls[out], np.zeros(WINDOW + 1, np.uint8)])
    first = np.concatenate([begins, np.zeros(WINDOW + 1, bool)])
    value, close, t = np.zeros(len(out)), np.zeros(len(out)), tables(w)
    kinds = np.stack([np.arange(CLASSES) < split, np.arange(CLASSES) >= split], 1).astype(np.float32)
    for i in range(0, len(row), BATCH):
        s = slice(i, i + BATCH)
        place = at[s][:, None] + np.arange(WINDOW)
        z = class_logits(t, x[place])
        use = (place + 1 < bounds[row[s] + 1][:, None]) & ((np.arange(WINDOW) >= CONTEXT) | (nth[s] == 0)[:, None])
        z, to = _safe(z[use]), place[use] + 1
        hit = z[np.arange(len(to)), c[to]]
        begin, inner = (np.exp(z, out=z) @ kinds).T
        total, new = begin + inner, first[to]
        # a symbol that begins a word is scored among those that do; that one does counts for the word before
        value[to] = hit - np.log(np.where(new, begin, total))
        close[to] = np.where(new, np.log(begin / total), 0)
    unit = em.ravel()[pair_codes(contexts(cls, compact, em.shape[1]), compact, em.shape[1], out, begins)].astype(np.float64)
    value = value / np.log(10) + unit
    value[bounds[:-1]] = 0
    item = begins.copy()
    item[bounds[:-1]] = False
    item = np.flatnonzero(item)
    sums = np.add.reduceat(value, item) if len(item) else np.empty(0)
    end = np.zeros(len(out) + 1, bool)
    end[bounds[1:] - 1] = True
    is_end = end[item]
    after = np.append(close[item[1:]], 0) / np.log(10)
    return (sums + after)[~is_end], sums[is_end]


# ---------------------------------------------------------------- tasks


class Subwords:
    """Counts of the ids of training texts, their sketches, and counts of (id before in the word, id)."""

    def __init__(self):
        self.count, self.held, self.after = np.zeros(IDS, np.int64), np.zeros(IDS * HELD, np.int32), np.zeros(IDS * NEXT, np.int32)
        self.bucket = np.random.default_rng(11).integers(NEXT, size=IDS)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.words = self.texts = 0
        self.vocabulary: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, t: Texts, rate: float, keys: np.ndarray) -> np.ndarray:
        """Counts texts to learn from and returns windows of them."""
        before = np.full(len(t.ids), IDS)
        before[1:] = t.ids[:-1]
        before[t.from_] = IDS
        self.words, self.texts = self.words + len(t.inv), self.texts + len(keys)
        many = np.bincount(t.inv, minlength=len(t.hash))
        self.pairs.append(totals(np.append(before * IDS + t.ids, IDS * IDS + END), np.append(np.repeat(many, t.n), len(keys))))
        self.vocabulary.append((t.hash, many))
        self.pairs, self.vocabulary = _folded_in(self.pairs), _folded_in(self.vocabulary)
        out, _, bounds = t.symbols()
        size = np.diff(bounds)
        self.count += np.bincount(out, minlength=IDS)
        np.add.at(self.after, out[:-1] * np.int64(NEXT) + self.bucket[out[1:]], 1)
        self.after[END * NEXT + self.bucket[END]] -= len(size) - 1  # from text to text
        text = np.arange(len(size), dtype=np.int32 if len(size) * IDS < 2**31 else np.int64)
        code, n = np.unique(np.repeat(text * text.dtype.type(IDS), size) + out, return_counts=True)
        row, i = code // IDS, code % IDS
        k = keys.view(U64)
        column, sign = (k % U64(HELD)).astype(np.int64), np.where(k >> U64(63), 64, -64)
        np.add.at(self.held, i * HELD + column[row], np.rint(np.log1p(n) * sign[row]).astype(np.int64))
        return np.concatenate([tiled(out, bounds), drawn(out, bounds, rate, keys)])


def totals(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of n, without those of 0."""
    u, inv = np.unique(code, return_inverse=True)
    got = np.zeros(len(u), np.int64)
    np.add.at(got, inv, n.astype(np.int64))
    return u[got > 0], got[got > 0]


def _folded_in(lists: list, most: int = 1_000_000) -> list:
    """The lists of (code, count), as one where they have grown long."""
    return [totals(*map(np.concatenate, zip(*lists, strict=True)))] if len(lists) > 1 and sum(len(x[0]) for x in lists) > most else lists


def _row_keys(doc: np.ndarray, buf, off) -> np.ndarray:
    """A hash of each row's id and text."""
    return mix(doc.view(U64) * U64(0x9E3779B97F4A7C15) + _text_keys(buf, off).view(U64)).view(np.int64)


def _batch(kinds, **cols) -> pa.RecordBatch:
    """Rows of numbers (first columns, with their types) and of packed arrays."""
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) if k in kinds else binary(v) for k, v in cols.items()], list(cols))


_KINDS = {"part": pa.int32(), "kind": pa.int8(), "step": pa.int64()}
_COUNT = "part int, kind tinyint, a binary, b binary, c binary, d binary"
_SEEN = f"{_COUNT}, window binary"


def _rows_of(windows: np.ndarray) -> pa.RecordBatch:
    """A row of kind 5 for each window: large rows would fill the heap of whoever reads them."""
    n, size = len(windows), windows.itemsize * (WINDOW + 2)
    window = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, size * n + 1, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(windows))])
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(np.full(n, 5, np.int8)), none, none, none, none, window], ["part", "kind", "a", "b", "c", "d", "window"])


def _count(parts: int, model):
    """Of the training texts: windows (kind 5), one a row; of each task, by part, pairs (2), ids (4) and words (7), and its totals (6)."""

    def run(batches):
        vocabulary, rate = model.value
        seen, any_ = Subwords(), False
        for whole in batches:
            for batch in steps(whole, "text"):
                any_ = True
                buf, off = raw(batch.column("text"))
                keys = _row_keys(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), buf, off)
                got = seen.add(Texts(buf, off, vocabulary), rate, keys)
                for at in range(0, len(got), SOME):
                    yield _rows_of(got[at : at + SOME])
        if any_:
            # both go by id: one task has all of an id
            code, n = totals(*map(np.concatenate, zip(*seen.pairs, strict=True)))
            ids = np.flatnonzero(seen.count)
            held, after = seen.held.reshape(IDS, HELD), seen.after.reshape(IDS, NEXT)
            yield _batch(_KINDS, part=[0], kind=[6], a=[np.array([seen.words + seen.texts, seen.texts])], b=[b""], c=[b""], d=[b""], window=[None])
            word, many = totals(*map(np.concatenate, zip(*seen.vocabulary, strict=True)))
            word, many = (x[np.argsort((word >> U64(40)) % U64(parts), kind="stable")] for x in (word, many))
            cuts = np.searchsorted((word >> U64(40)) % U64(parts), np.arange(parts + 1, dtype=U64))
            for p in range(parts):
                c, i, v = code % IDS % parts == p, ids[ids % parts == p], slice(cuts[p], cuts[p + 1])
                yield _batch(_KINDS, part=[p, p, p], kind=[2, 4, 7], a=[code[c], i, word[v]], b=[n[c], seen.count[i], many[v]], c=[b"", held[i], b""], d=[b"", after[i], b""], window=[None] * 3)

    return run


def _merge(parts: int):
    """Pairs and ids of one part over all tasks; its most frequent words, and how many words it has (8); the rest passes."""

    def run(batches):
        pairs, ids, words, part = [], [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 2:
                    part = r["part"]
                    pairs = _folded_in([*pairs, (np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64))])
                elif r["kind"] == 7:
                    words = _folded_in([*words, (np.frombuffer(r["a"], U64), np.frombuffer(r["b"], np.int64))])
                elif r["kind"] == 4:
                    i = np.frombuffer(r["a"], np.int64)
                    ids.append((i, np.concatenate([np.frombuffer(r["b"], np.int64)[:, None], np.frombuffer(r["c"], np.int32).reshape(len(i), HELD), np.frombuffer(r["d"], np.int32).reshape(len(i), NEXT)], 1)))
                    if len(ids) > 64:
                        ids = [_added(ids)]
                else:
                    yield _batch(_KINDS, part=[r["part"]], kind=[r["kind"]], a=[r["a"]], b=[b""], c=[b""], d=[b""])
        if pairs:
            code, n = totals(*map(np.concatenate, zip(*pairs, strict=True)))
            yield _batch(_KINDS, part=[part], kind=[2], a=[code], b=[n], c=[b""], d=[b""])
        if words:
            word, n = totals(*map(np.concatenate, zip(*words, strict=True)))
            # hashes deal words evenly: a part holds its share of the most frequent ones, and some more
            top = np.lexsort((word, -n))[: 4 * HOT // parts + 16]
            yield _batch(_KINDS, part=[part], kind=[8], a=[word[top]], b=[n[top]], c=[np.array([len(word)])], d=[b""])
        if ids:
            i, of = _added(ids)
            yield _batch(_KINDS, part=[part], kind=[4], a=[i], b=[of], c=[b""], d=[b""])

    return run


def _added(ids: list) -> tuple[np.ndarray, np.ndarray]:
    i, inv = np.unique(np.concatenate([x[0] for x in ids]), return_inverse=True)
    of = np.zeros((len(i), 1 + HELD + NEXT), np.int64)
    np.add.at(of, inv, np.concatenate([x[1] for x in ids]))
    return i, of


def _rounds(batches):
    """Arrays of TRAIN_BATCH windows, the last one smaller."""
    held = np.empty((0, WINDOW + 2), np.uint16)
    for batch in batches:
        held = np.concatenate([held, np.frombuffer(b"".join(batch.column("window").to_pylist()), np.uint16).reshape(-1, WINDOW + 2)])
        for at in range(0, len(held) - TRAIN_BATCH + 1, TRAIN_BATCH):
            yield held[at : at + TRAIN_BATCH]
        held = held[len(held) // TRAIN_BATCH * TRAIN_BATCH :]
    if len(held):
        yield held


def _fit_shard(rounds: int, model):
    """The weights of one shard: windows stream through, a round after the other."""

    def run(batches):
        cls, compact, symbols, start = model.value
        some = iter(_rounds(batches))
        one = next(some, None)
        if one is not None:
            again = (x for part in ([one], some) for x in part)
            w = fit(again, rounds, cls, compact, symbols, unpacked_weights(start, symbols) if start else None, NEXT_RATE if start else RATE)
            yield pa.RecordBatch.from_arrays([binary([packed_weights(w)])], ["w"])

    return run


def _mean(batches):
    total, n = 0.0, 0
    for batch in batches:
        for x in batch.column("w").to_pylist():
            total, n = total + np.frombuffer(x, np.float32).astype(float), n + 1
    if n:
        yield pa.RecordBatch.from_arrays([binary([(total / n).astype(np.float32)])], ["w"])


def trained(spark: SparkSession, windows: DataFrame, cls: np.ndarray, compact: np.ndarray, symbols: int) -> dict:
    """Weights learned from all windows (column ``window``); executors train, the driver gets the result."""
    n = windows.count()
    shards = max(1, n // (2 * ROUNDS * TRAIN_BATCH))
    rounds = -(-n // shards // TRAIN_BATCH)
    order = F.xxhash64("window")
    shard = F.pmod(order, F.lit(shards)).cast("int")
    first = windows.where(shard == 0).repartition(1).sortWithinPartitions(F.xxhash64(order), "window").select("window")
    model = spark.sparkContext.broadcast((cls, compact, symbols, None))
    got = first.mapInArrow(_fit_shard(rounds, model), "w binary").first()
    model.destroy()
    if got and shards > 1:
        model = spark.sparkContext.broadcast((cls, compact, symbols, bytes(got[0])))
        rest = windows.where(shard > 0).repartitionById(shards - 1, shard - 1).sortWithinPartitions(F.xxhash64(order), "window").select("window")
        each = cut(rest.mapInArrow(_fit_shard(rounds, model), "w binary"), spark)
        got = each.repartition(1).sortWithinPartitions(F.xxhash64("w")).mapInArrow(_mean, "w binary").first()
        model.destroy()
    return unpacked_weights(bytes(got[0]), symbols) if got else new_weights(symbols)


def _folded(model):
    """Pairs of ids as pairs of context and symbol."""

    def run(batches):
        cls, compact, symbols = model.value
        ctx = np.append(contexts(cls, compact, symbols), n_contexts(symbols) - 1)
        for batch in batches:
            for r in batch.to_pylist():
                code, n = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)
                code, n = totals(ctx[code // IDS] * symbols + compact[code % IDS], n)
                yield pa.RecordBatch.from_arrays([binary([code]), binary([n])], ["a", "b"])

    return run


_SCORED = "part int, kind tinyint, step long, a binary, b binary, c binary, d binary, e binary"
_SUMS = "part int, kind tinyint, step long, a binary, b binary, c binary, d binary"


def _score(parts: int, model):
    """Packed words by hash range (kind 1), with their probabilities; and the texts of each step (kind 0)."""

    def run(batches):
        vocabulary, cls, compact, split, w, em, n_all, ends, hot, hot_n = model.value
        step = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in steps(whole, "text"):
                step += 1
                buf, off = raw(batch.column("text"))
                learn = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                t = Texts(buf, off, vocabulary)
                words, end = score_words(w, em, cls, compact, split, *t.symbols())
                row = t.w.owner()
                # frequent words: their counts are here
                at = lookup(t.hash, hot)
                here = at[t.inv] >= 0
                i, of = row[here], hot_n[at[t.inv[here]]]
                own = lambda x, i=i, n=len(off) - 1: np.bincount(i, weights=x, minlength=n)
                sums = np.concatenate([own(np.log10(of + 1)), own(of > 0), mixed(end, ends, n_all) + own(mixed(words[here], of, n_all))])
                # the others by part, their places by word
                train = np.bincount(t.inv, weights=learn[row], minlength=len(t.hash)).astype(np.uint32)
                many = np.bincount(t.inv, minlength=len(t.hash))
                rest = np.flatnonzero(at < 0)
                part = ((t.hash[rest] >> U64(40)) % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, order = part[order], rest[order]
                rank = np.empty(len(t.hash), np.int64)
                rank[order] = np.arange(len(order))
                place = np.flatnonzero(~here)
                place = place[np.argsort(rank[t.inv[place]], kind="stable")]
                text, value = row[place].astype(np.uint16 if len(off) <= 65536 else np.uint32), words[place].astype(np.float32)
                cuts = np.searchsorted(part, np.arange(parts + 1))
                upto = np.concatenate([[0], np.cumsum(many[order])])
                cols = {k: [] for k in ("part", "kind", "step", "a", "b", "c", "d", "e")}
                ids = batch.column("doc_id")
                rows = [(step % parts, 0, step, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), ~learn, t.w.counts().astype(np.int64), sums)]
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    o, i = order[cuts[p] : cuts[p + 1]], slice(upto[cuts[p]], upto[cuts[p + 1]])
                    rows.append((p, 1, step, np.concatenate([[np.uint32(len(off) - 1)], many[o].astype(np.uint32)]).astype(np.uint32), t.hash[o], train[o], text[i], value[i]))
                for r in rows:
                    for key, v in zip(cols, r, strict=True):
                        cols[key].append(v)
                yield _batch(_KINDS, **cols)

    return run


def mixed(value: np.ndarray, count: np.ndarray | int, n_all: int) -> np.ndarray:
    """log10 of NEW times the subword model's probability (given as log10) and 1 - NEW times count / n_all."""
    if not n_all:
        return np.asarray(value, float)
    with np.errstate(divide="ignore"):
        seen = np.log((1 - NEW) * np.asarray(count, float) / n_all)
    return np.logaddexp(np.asarray(value, float) * np.log(10) + np.log(NEW), seen) / np.log(10)


def _sum(parts: int, n_all: int):
    """All words of one hash range: their counts, and each text's sums over them."""

    def run(batches):
        blobs, part = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    yield _batch(_KINDS, part=[r["part"]], kind=[0], step=[r["step"]], a=[r["a"]], b=[r["b"] + r["c"]], c=[r["d"]], d=[r["e"]])
                    continue
                part, (texts, *_) = r["part"], np.frombuffer(r["a"], np.uint32)
                blobs.append((r["step"], int(texts), np.frombuffer(r["a"], np.uint32)[1:], np.frombuffer(r["b"], U64), np.frombuffer(r["c"], np.uint32), np.frombuffer(r["d"], np.uint16 if texts + 1 <= 65536 else np.uint32), np.frombuffer(r["e"], np.float32)))
        if not blobs:
            return
        word, inv = np.unique(np.concatenate([b[3] for b in blobs]), return_inverse=True)
        count = np.bincount(inv, weights=np.concatenate([b[4] for b in blobs]), minlength=len(word))
        value, known, at = np.log10(count + 1), count > 0, 0
        for step, _, many, h, _, text, lp in blobs:
            i = np.repeat(inv[at : at + len(h)], many)
            at += len(h)
            # only the texts that hold any of these words
            which, own = np.unique(text, return_inverse=True)
            total = lambda x, own=own: np.bincount(own, weights=x)
            yield _batch(_KINDS, part=[step % parts], kind=[1], step=[step], a=[which.astype(np.uint32)], b=[total(value[i])], c=[total(known[i]).astype(np.uint32)], d=[total(mixed(lp, count[i], n_all))])

    return run


def _gather(batches):
    """Sums of each step over all hash ranges, back at its texts (kind 0 comes first)."""
    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                ids = np.frombuffer(r["a"], np.int64)
                flags = np.frombuffer(r["b"], bool)
                held[r["step"]] = [ids, flags[: len(ids)], flags[len(ids) :], np.frombuffer(r["c"], np.int64), np.frombuffer(r["d"], np.float64).reshape(3, -1).copy()]
            else:
                which = np.frombuffer(r["a"], np.uint32)
                for line, (c, kind) in zip(held[r["step"]][4], (("b", np.float64), ("c", np.uint32), ("d", np.float64)), strict=True):
                    line[which] += np.frombuffer(r[c], kind)
    for ids, none, flag, words, (value, known, score) in held.values():
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(flag), pa.array(words), pa.array(known.astype(np.int64)), pa.array(value), pa.array(score)], ["doc_id", "held_out", "words", "known", "value", "score"])


def lm_scores(spark: SparkSession, docs: DataFrame, held, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); learns where held is false.

    vocabulary: a file on the driver with a base64 token and its id a line, of at most IDS - 1 tokens.
    """
    with open(vocabulary, "rb") as f:
        vocab = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(True)).alias("held_out"), F.col("text").cast("binary").alias("text"))
    learn = rows.where("not held_out and doc_id is not null")
    parts = n_parts(spark, rows)
    size = learn.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 1
    # a symbol has about three bytes; further windows are drawn where those of all symbols are too few
    counting = spark.sparkContext.broadcast((vocab, max(0, 3 * windows_wanted(size) / size - 1 / WINDOW)))
    # parts of little data go through one task one after the other, each with its memory freed before the next
    files = min(parts, max(4 * spark.sparkContext.defaultParallelism, parts // 8))
    # windows are written where they are made; only counts move to their parts
    seen = cut(learn.mapInArrow(_count(parts, counting), _SEEN), spark)
    counts = cut(seen.where("kind <> 5").drop("window").repartitionById(parts, F.col("part")).mapInArrow(_merge(parts), _COUNT).coalesce(files), spark)
    counting.destroy()
    # of each id one row of numbers
    of, n_all, ends, v_all, hot = np.zeros((IDS, 1 + HELD + NEXT), np.int64), 0, 0, 0, []
    for kind, a, b, c in counts.where("kind in (4, 6, 8)").select("kind", "a", "b", "c").toLocalIterator():
        if kind == 8:
            hot.append((np.frombuffer(a, U64), np.frombuffer(b, np.int64)))
            v_all += int(np.frombuffer(c, np.int64)[0])
        elif kind == 6:
            n, texts = np.frombuffer(a, np.int64)
            n_all, ends = n_all + int(n), ends + int(texts)
        else:
            of[np.frombuffer(a, np.int64)] = np.frombuffer(b, np.int64).reshape(-1, 1 + HELD + NEXT)
    cls, compact, symbols, split = new_classes(of[:, 0], of[:, 1 : 1 + HELD], of[:, 1 + HELD :], _encoding(vocab)[1])
    del of
    v_all += int(ends > 0)
    hot, hot_n = map(np.concatenate, zip(*hot, strict=True)) if hot else (np.empty(0, U64), np.empty(0, np.int64))
    hot, hot_n = (x[np.lexsort((hot, -hot_n))[:HOT]] for x in (hot, hot_n))
    hot, hot_n = (x[np.argsort(hot)] for x in (hot, hot_n))
    w = trained(spark, seen.where("kind = 5").select("window"), cls, compact, symbols)
    pair = np.zeros(n_contexts(symbols) * symbols, np.float32)
    folded = spark.sparkContext.broadcast((cls, compact, symbols))
    for a, b in counts.where("kind = 2").select("a", "b").mapInArrow(_folded(folded), "a binary, b binary").toLocalIterator():
        np.add.at(pair, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))
    folded.destroy()
    em = emission(pair.reshape(-1, symbols), cls, compact)
    del pair
    model = spark.sparkContext.broadcast((vocab, cls, compact, split, w, em, n_all, ends, hot, hot_n))
    del em
    sums = cut(rows.mapInArrow(_score(parts, model), _SCORED).repartitionById(parts, F.col("part")).mapInArrow(_sum(parts, n_all), _SUMS).coalesce(files), spark)
    model.destroy()
    got = sums.repartitionById(parts, F.pmod(F.col("step"), F.lit(parts)).cast("int")).sortWithinPartitions("kind").mapInArrow(_gather, "doc_id long, held_out boolean, words long, known long, value double, score double")
    tokens = F.col("words") + 1
    value = F.col("value") + F.log10(F.lit(float(ends + 1))) - tokens * F.log10(F.lit(float(n_all + v_all + 1)))
    return got.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), value.alias("base_score"), "score")
