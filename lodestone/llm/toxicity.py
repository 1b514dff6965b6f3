"""Toxicity by noisy-channel deobfuscation.

Leetspeak, inserted separators, spaced-out letters and repetitions are read as
a character lattice; Viterbi decoding under a character language model of the
corpus restores the likeliest word.  A logistic model over words and word
beginnings, fitted on labelled rows, scores the restored text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._arrow import IS_SPACE, LOWER, Hasher, hash_strings, map_arrow, runs, text_slices
from lodestone.llm._shared import set_aside

#: The classifier is fitted on at most so many labelled rows and bytes of text, the first by hash of doc_id.
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 64 << 20
#: Features kept at most, the least share of toxic sample rows that have one, and the least log odds.
FEATURES, LEAST_SHARE, LEAST_ODDS = 1024, 0.004, 2.0
PREFIXES = (4, 5, 6, 7)
#: Letters that a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i"}
#: Channel costs in nats: a letter for a digit or symbol, dropping a separator, dropping a digit or symbol, dropping a repeated letter of a run of three or more, and of two.
SUBSTITUTE, SEPARATOR, DROP, REPEAT, DOUBLE = 0.7, 0.3, 8.0, 0.2, 4.0
N = 28  # boundary, a-z, bytes of other letters

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in LEET if ord(c) < 128 and not c.isdigit()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27
_TAG = [np.uint64(0x9E3779B97F4A7C15 * k % 2**64) for k in range(1 + len(PREFIXES))]


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs in nats of each letter after two others, from the trigrams of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for _, data, _ in text_slices(batches):
            c = _CODE[LOWER[data]]
            c = c[(c > 0) | (np.append(1, c[:-1]) > 0)]  # one boundary between words
            if len(c) > 2:
                total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": cell, "n": total[cell]})

    rows = map_arrow(docs.select("text"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # N ** 3 rows at most
    c3 = np.zeros(N**3)
    for cell, n in rows:
        c3[cell] = n
    c3 = c3.reshape(N, N, N)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + N)
    p2 = (c2 + 8 * p1) / (c2.sum(1, keepdims=True) + 8)
    return -np.log((c3 + 8 * p2[None]) / (c3.sum(2, keepdims=True) + 8))


class Restorer:
    """Viterbi decoding of one obfuscated word; results are remembered."""

    def __init__(self, costs: np.ndarray, memory: int = 200_000):
        self.costs, self.memory, self.known = costs.tolist(), memory, {}

    def __call__(self, word: str, spaced: bool = False) -> str:
        out = self.known.get((word, spaced))
        if out is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            out = self.known[word, spaced] = self.decode(word, spaced)
        return out

    def decode(self, word: str, spaced: bool = False) -> str:
        """States are the last two letters; each has its cost and the letters so far, as a linked list.

        With ``spaced`` words may end between any two characters; a space stands there.
        """
        costs = self.costs
        states = {(0, 0): (0.0, None)}
        run, before = 0, ""
        after = [len(m.group()) - 1 - k for m in re.finditer(r"(.)\1*", word, re.S) for k in range(len(m.group()))]
        for ch, rest in zip(word, after, strict=True):
            run = run + 1 if ch == before else 1
            long = run + rest > 2
            before = ch
            letter = ch.isalpha()
            if letter:
                options, drop = ((ch, 0.0),), (REPEAT if long else DOUBLE) if run > 1 else None
            elif ch in LEET:
                options, drop = tuple((x, SUBSTITUTE) for x in LEET[ch]), (DROP if run == 1 else REPEAT if long else DOUBLE)
            else:
                options, drop = (), SEPARATOR
            new: dict = {}
            for (a, b), (cost, back) in states.items():
                for x, extra in options:
                    o = ord(x)
                    k = o - 96 if 97 <= o <= 122 else 27
                    c = cost + extra + costs[a][b][k]
                    if (held := new.get((b, k))) is None or c < held[0]:
                        new[b, k] = (c, (x, back))
                if drop is not None and ((held := new.get((a, b))) is None or cost + drop < held[0]):
                    new[a, b] = (cost + drop, back)
            if spaced:
                for (a, b), (cost, back) in list(new.items()):
                    if b and ((held := new.get((b, 0))) is None or cost + costs[a][b][0] < held[0]):
                        new[b, 0] = (cost + costs[a][b][0], (" ", back))
            states = new
        back = min(((cost + costs[a][b][0], back) for (a, b), (cost, back) in states.items()), key=lambda x: x[0])[1]
        out = []
        while back:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))


def _spaced_out(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, restore: Restorer) -> list[tuple[int, bytes]]:
    """Restored words of three or more chunks in a row that are no words, whole and cut into words.

    Such a chunk has one character, or two that are not both letters.  A chunk
    of decoration only does not count, but for a symbol that stands for
    letters: a run with such symbols is read with and without them.
    """
    core = j > i
    first, last = at[np.minimum(i, len(at) - 1)] if len(at) else starts, at[j - 1] + 1 if len(at) else ends
    s, e = np.where(core, first, starts), np.where(core, last, ends)
    heads = np.zeros(len(low) + 1, np.int64)
    np.cumsum((low < 128) | (low >= 192), out=heads[1:])
    size = heads[e] - heads[s]
    letters = np.append(0, np.cumsum(_LETTER[low]))
    one = (size == 1) | (size == 2) & (letters[e] - letters[s] < e - s)
    symbol = ~core & (size == 1) & _SYMBOL[low[s]]
    out: list[tuple[int, bytes]] = []
    before: set[tuple[int, str]] = set()
    for among in (core, core | symbol):
        chunk = np.flatnonzero(among)
        single = np.flatnonzero(one[chunk])
        if len(single) < 3:
            continue
        cut = np.flatnonzero((np.diff(single) != 1) | (np.diff(doc[chunk[single]]) != 0)) + 1
        bounds = np.concatenate(([0], cut, [len(single)]))
        for k in np.flatnonzero(np.diff(bounds) > 2).tolist():
            g = chunk[single[bounds[k] : bounds[k + 1]]]
            d = int(doc[g[0]])
            word = b"".join(low[a:b].tobytes() for a, b in zip(s[g].tolist(), e[g].tolist(), strict=True)).decode("utf-8", "replace")
            if (d, word) in before or not any(c.isalnum() for c in word):
                continue
            before.add((d, word))
            out += [(d, w.encode()) for w in {restore(word), *restore(word, True).split(" ")} if w]
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, restore: Restorer) -> tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
    """Plain words as (documents, feature hashes by kind) and restored words as (document, bytes)."""
    low = LOWER[data]
    starts, ends, doc = runs(~IS_SPACE[low], offsets)
    if not len(starts):
        return np.empty(0, np.int64), np.empty((0, 1 + len(PREFIXES)), np.uint64), []
    n = len(low)
    # Decoration at the edges goes: a symbol there counts only as one or two of $ or @.
    soft = (low == ord("$")) | (low == ord("@"))
    three = np.zeros(n, bool)
    if n > 2:
        same = soft[2:] & soft[1:-1] & soft[:-2]
        three[2:] |= same
        three[1:-1] |= same
        three[:-2] |= same
    core = _LETTER[low] | _DIGIT[low] | (soft & ~three)
    at = np.flatnonzero(core)
    i, j = np.searchsorted(at, starts), np.searchsorted(at, ends)
    keep = j > i
    more = _spaced_out(low, starts, ends, doc, at, i, j, restore)
    i, j, doc = i[keep], j[keep], doc[keep]
    s, e = at[i], at[j - 1] + 1
    letters = np.zeros(n + 1, np.int64)
    np.cumsum(_LETTER[low], out=letters[1:])
    n_letters = letters[e] - letters[s]
    triple = np.zeros(n + 1, np.int64)
    if n > 2:
        np.cumsum(np.append([False, False], (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[low[2:]]), out=triple[1:])
    odd = ((n_letters > 0) | (e - s > 2)) & ((n_letters < e - s) | ((e - s > 2) & (triple[e] - triple[np.minimum(s + 2, e)] > 0)))
    plain = (n_letters == e - s) & ~odd
    for a, b, d in zip(s[odd].tolist(), e[odd].tolist(), doc[odd].tolist(), strict=True):
        word = low[a:b].tobytes().decode("utf-8", "replace")
        parts = [p.encode() for p in re.findall(r"[^\W\d_]{2,}", word)]
        more += [(d, p) for p in parts]
        if out := restore(word):
            more.append((d, out.encode()))
    use = plain & (e - s > 2)
    s, e, doc = s[use], e[use], doc[use]
    h = Hasher(low)
    found = np.zeros((len(s), 1 + len(PREFIXES)), np.uint64)
    found[:, 0] = h(s, e) ^ _TAG[0]
    for k, p in enumerate(PREFIXES, 1):
        found[:, k] = np.where(e - s > p, h(s, np.minimum(s + p, e)) ^ _TAG[k], found[:, 0])
    return doc, found, more


def features_of(data: np.ndarray, offsets: np.ndarray, restore: Restorer, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, only of the sorted features ``among`` if given."""
    doc, found, more = words_of(data, offsets, restore)
    docs, hashes = [np.repeat(doc, found.shape[1])], [found.ravel()]
    if more:
        words = [w for _, w in more]
        d = np.array([x for x, _ in more])
        docs.append(d)
        hashes.append(hash_strings(words) ^ _TAG[0])
        for k, p in enumerate(PREFIXES, 1):
            longer = [i for i, w in enumerate(words) if len(w) > p]
            if longer:
                docs.append(d[longer])
                hashes.append(hash_strings([words[i][:p] for i in longer]) ^ _TAG[k])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    if among is not None:
        if not len(among):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        gate = np.zeros(1 << 16, bool)
        gate[(among & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(gate[(h & np.uint64(0xFFFF)).astype(np.int64)])
        doc, h = doc[at], h[at]
        i = np.minimum(np.searchsorted(among, h), len(among) - 1)
        same = among[i] == h
        doc, h = doc[same], h[same]
    if not len(doc):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
    return doc[new], h[new]


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all rows at once; both classes weigh alike, but for a square root."""
    n, m = x.shape
    share = float(y.mean())
    weight = np.where(y > 0, np.sqrt(1 / share), np.sqrt(1 / (1 - share))).astype(np.float32)
    weight /= weight.mean()
    w = np.append(np.zeros(m), np.log(share / (1 - share))).astype(np.float32)  # the bias is last
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = weight * (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y)
        grad = np.append(x.T @ g / n + penalty / n * w[:-1], g.mean())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w = (w - rate * min(1.0, 2 * (1 - (t - 1) / steps)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(np.float64), float(w[-1])


class Model:
    """Sorted feature hashes with weights, a bias, and the character model's costs."""

    def __init__(self, costs: np.ndarray, features: np.ndarray, weights: np.ndarray, bias: float):
        self.costs, self.features, self.weights, self.bias = costs, features, weights, bias


def held_out(doc_id):
    """Rows never used for fitting: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The character model of all texts, and a classifier of labelled ones; null ids and labels are left out."""
    costs = language_model(docs)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("_y"), F.xxhash64("doc_id").alias("_o")).where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).orderBy("_o", "doc_id").limit(SAMPLE_ROWS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("_o", "doc_id", "text")  # SAMPLE_ROWS rows at most are broadcast
    texts, y, held = [], [], 0
    for row in sample.select("text", "_y").toLocalIterator():
        texts.append((row[0] or "").encode())
        y.append(row[1])
        if (held := held + len(texts[-1])) > SAMPLE_BYTES:
            break
    y = np.array(y, np.float64)
    # Without rows of both classes there is nothing to go by, and no text is called toxic.
    nothing = Model(costs, np.empty(0, np.uint64), np.empty(0), min(-0.1, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))))
    if not y.sum() or y.all():
        return nothing
    restore = Restorer(costs)

    def pairs(which: np.ndarray, among=None):
        batches = (pa.RecordBatch.from_pydict({"i": which[k : k + 500], "text": pa.array([texts[i] for i in which[k : k + 500]], pa.binary())}) for k in range(0, len(which), 500))
        for rows, data, offsets in text_slices(batches):
            d, h = features_of(data, offsets, restore, among)
            yield rows.column(0).to_numpy()[d], h

    bad = np.flatnonzero(y == 1)
    h, n_bad = np.unique(np.concatenate([h for _, h in pairs(bad)]), return_counts=True)
    frequent = n_bad >= max(2, LEAST_SHARE * len(bad))
    h, n_bad = h[frequent], n_bad[frequent]
    if not len(h):
        return nothing
    found = list(pairs(np.arange(len(y)), h))
    doc, which = np.concatenate([d for d, _ in found]), np.searchsorted(h, np.concatenate([x for _, x in found]))
    n_good = np.bincount(which, minlength=len(h)) - n_bad
    odds = np.log((n_bad + 0.5) / (len(bad) + 1)) - np.log((n_good + 0.5) / (len(y) - len(bad) + 1))
    best = np.sort(np.lexsort((h, -n_bad * odds))[:FEATURES])
    best = best[odds[best] >= LEAST_ODDS]
    to = np.full(len(h), -1)
    to[best] = np.arange(len(best))
    x = np.zeros((len(y), len(best)), np.float32)
    use = to[which] >= 0
    x[doc[use], to[which[use]]] = 1
    w, b = _fit(x, y.astype(np.float32))
    return Model(costs, h[best], w, b)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with ``into``, 0 to 1, higher for likelier toxic.

    Only ``text`` is read.  A null or empty text, or one without words, gets
    the model's bias; repeated rows get equal scores; texts of any length are
    read whole; a column called ``into`` is replaced.
    """
    from pyspark.sql.types import DoubleType, StructType

    base = docs.drop(into)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model.costs)
        for rows, data, offsets in text_slices(batches):
            d, h = features_of(data, offsets, restore, model.features)
            total = np.full(rows.num_rows, model.bias)
            if len(d):
                total += np.bincount(d, model.weights[np.searchsorted(model.features, h)], rows.num_rows)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-total)))], names=[*names, into])

    return map_arrow(base, run, StructType([*base.schema.fields]).add(into, DoubleType()))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that are scored 0.5 or more."""
    own, back = set_aside(docs, {"_toxicity"})
    return score(own, train(docs, labels), "_toxicity").where(F.col("_toxicity") < 0.5).select(back)
