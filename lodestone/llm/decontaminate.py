"""Benchmark decontamination by training suffix arrays.

Every slice of documents is a shard: its words are numbered, and a suffix
array, sorted to window depth, holds the places that may begin a match.  Every
benchmark suffix is binary-searched in it, which gives all places of its
window; each is extended word by word to the longest verbatim match.  The
benchmark is the query set: it is read in blocks of bounded size, each of which
is broadcast, and a worker holds one of them at a time; nothing is shuffled.
Words are equal only if their bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._arrow import LOWER, Hasher, distinct_spans, map_arrow, mix, runs, same_spans, slices_by, spread, text_slices
from lodestone.llm._shared import set_aside

WINDOW = 10
#: Characters of benchmark text in a block, pairs of places that are extended at once, and words that are compared in a step.
BLOCK_CHARS, PAIRS, STRIDE = 8 << 20, 1 << 20, 32
#: Digits, lower-case letters and all bytes of non-ASCII characters.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and starts, ends and documents of their words."""
    low = LOWER[data]
    starts, ends, doc = runs(_WORD[low], offsets)
    return low, starts, ends, doc


def window_hashes(number: np.ndarray, length: int) -> np.ndarray:
    """Hashes of each ``length`` word numbers in a row, only to find candidates."""
    total = np.zeros(max(0, len(number) - length + 1), np.uint64)
    for k in range(length):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + number[k : k + len(total)].astype(np.uint64))
    return total


class TestSuffixes:
    """A block of benchmark items: their distinct words, word numbers, and windows by hash."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        raw = [t.encode("utf-8", "replace") for _, t in items]
        low, starts, ends, item = words_of(np.frombuffer(b"".join(raw), np.uint8), slices_by(np.array([len(r) for r in raw], np.int64)))
        one, number = distinct_spans(low, starts, ends)
        h = Hasher(low)(starts[one], ends[one])
        order = np.argsort(h, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.hashes, self.size = h[order], (ends - starts)[one[order]]
        self.blob, self.at = low[spread(starts[one[order]], self.size)], slices_by(self.size)[:-1]
        number = back[number].astype(np.int32)
        bounds = np.searchsorted(item, np.arange(len(items) + 1))
        # Items of equal words are searched for once.
        groups: dict[bytes, list[str]] = {}
        for i, (name, _) in enumerate(items):
            if bounds[i + 1] > bounds[i]:
                groups.setdefault(number[bounds[i] : bounds[i + 1]].tobytes(), []).append(name)
        self.names = list(groups.values())
        self.number = np.frombuffer(b"".join(groups), np.int32)
        self.first = slices_by(np.array([len(g) // 4 for g in groups], np.int64))
        self.window = window
        count = np.diff(self.first)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: sorted hashes, and the place of each
        for length in np.unique(np.minimum(count, window)).tolist():
            mine = np.flatnonzero(np.minimum(count, window) == length)
            places = spread(self.first[mine], count[mine] - length + 1 if length == window else np.ones(len(mine), np.int64))
            hashed = window_hashes(self.number, length)[places]
            by = np.argsort(hashed, kind="stable")
            self.windows[length] = hashed[by], places[by]

    def numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those of no item."""
        out = np.full(len(starts), -1, np.int32)
        h, size = Hasher(low)(starts, ends), ends - starts
        at = np.searchsorted(self.hashes, h)
        todo = np.arange(len(starts))
        while len(todo):  # again only for words of the block that share a hash
            todo = todo[at[todo] < len(self.hashes)]
            todo = todo[self.hashes[at[todo]] == h[todo]]
            same = size[todo] == self.size[at[todo]]
            maybe = todo[same]
            same[same] = same_spans(low, starts[maybe], self.blob, self.at[at[maybe]], size[maybe])
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
        return out


def _binary_search(keys: np.ndarray, length: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the range of the sorted suffixes (rows of word numbers) that begin with its ``length`` words."""

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(suffixes), np.int64)
        while (live := np.flatnonzero(low < high)).size:
            middle = (low[live] + high[live]) // 2
            mine, its = keys[live], suffixes[middle].copy()
            its[np.arange(keys.shape[1]) >= length[live, None]] = -1
            differs = mine != its
            k = differs.argmax(1)
            row = np.arange(len(live))
            less = np.where(differs.any(1), its[row, k] < mine[row, k], upper)
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
        return low

    return bound(False), bound(True)


def search(test: TestSuffixes, number: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of windows in the shard: (place, class, lengths of the classes, and the classes' test places with their offsets)."""
    n = len(number)
    none = (np.empty(0, np.int64),) * 4 + (np.zeros(1, np.int64),)
    stop = number < 0
    until = np.flatnonzero(stop | np.append(True, doc[1:] != doc[:-1])) if n else np.empty(0, np.int64)
    room = np.where(stop, 0, np.append(until, n)[np.searchsorted(until, np.arange(n), "right")] - np.arange(n)) if n else np.empty(0, np.int64)
    begins, asked, size = np.zeros(n, bool), [], []
    for length, (hashes, places) in test.windows.items():
        h = window_hashes(number, length)
        at = np.flatnonzero(room[: len(h)] >= length)
        found = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
        same = hashes[found] == h[at]
        begins[at[same]] = True
        mine = places[np.isin(hashes, np.unique(h[at[same]]))]
        asked.append(mine)
        size.append(np.full(len(mine), length))
    suffixes = np.flatnonzero(begins)
    if not len(suffixes):
        return none
    deep = np.arange(test.window)

    def rows(sequence: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.where(deep < most[:, None], sequence[np.minimum(at[:, None] + deep, len(sequence) - 1)], -1).astype(np.int32)

    held = rows(number, suffixes, room[suffixes])
    order = np.lexsort(held.T[::-1])
    array, held = suffixes[order], held[order]
    places, size = np.concatenate(asked), np.concatenate(size)
    keys, of = np.unique(rows(test.number, places, size), axis=0, return_inverse=True)
    of = of.ravel()
    length = (keys >= 0).sum(1)
    low, high = _binary_search(keys, length, held)
    by = np.argsort(of, kind="stable")
    return array[spread(low, high - low)], np.repeat(np.arange(len(keys)), high - low), length, places[by], slices_by(np.bincount(of, minlength=len(keys)))


def longest(test: TestSuffixes, number: np.ndarray, doc: np.ndarray, at: np.ndarray, kind: np.ndarray, length: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (document, item, words, place in the shard, place in the item) of the longest verbatim match of each document with each item, the earliest of equals."""
    best = np.empty((5, 0), np.int64)
    end = np.searchsorted(doc, doc, "right")
    many = np.diff(offsets)[kind]
    cut = slices_by(many)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + PAIRS, "right")) - 1)
        for k in range(0, int(many[a:b].max()), PAIRS):  # one place may have more test places than are taken at once
            some = np.clip(many[a:b] - k, 0, PAIRS)
            p, q, size = np.repeat(at[a:b], some), places[spread(offsets[kind[a:b]] + k, some)], np.repeat(length[kind[a:b]], some)
            item = np.searchsorted(test.first, q, "right") - 1
            # A match that goes on to the left is found from its first word.
            inner = (q > test.first[item]) & (p > 0) & (doc[p] == doc[p - 1]) & (number[p - 1] == test.number[q - 1])
            p, q, size, item = p[~inner], q[~inner], size[~inner], item[~inner]
            most = np.minimum(end[p] - p, test.first[item + 1] - q)
            live = np.flatnonzero(size < most)
            while len(live):
                step = size[live, None] + np.arange(STRIDE)
                same = step < most[live, None]
                same &= number[np.minimum(p[live, None] + step, len(number) - 1)] == test.number[np.minimum(q[live, None] + step, len(test.number) - 1)]
                more = np.where(same.all(1), STRIDE, same.argmin(1))
                size[live] += more
                live = live[more == STRIDE]
            best = np.concatenate((best, np.stack((doc[p], item, size, p, q - test.first[item]))), axis=1)
            best = best[:, np.lexsort((best[4], best[3], -best[2], best[1], best[0]))]
            best = best[:, np.append(True, (best[:2, 1:] != best[:2, :-1]).any(0))] if best.shape[1] else best
        a = b
    return best


_MATCH = pa.list_(pa.struct([("item", pa.string()), ("words", pa.int64()), ("at", pa.int64()), ("item_at", pa.int64())]))


def _scan(blocks: list, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, limit=(2 if len(blocks) < 2 else 8) << 20):
            low, starts, ends, doc = words_of(data, offsets)
            n_docs = rows.num_rows
            first_word = np.searchsorted(doc, np.arange(n_docs + 1))
            edge = np.zeros(len(doc) + 1, np.int64)
            matches: list[list[dict]] = [[] for _ in range(n_docs)]
            for block in blocks:
                test = block.value
                number = test.numbers(low, starts, ends)
                at, kind, length, places, cut = search(test, number, doc)
                if len(at):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length[kind], -1)
                    for d, item, words, p, q in longest(test, number, doc, at, kind, length, places, cut).T.tolist():
                        matches[d] += [{"item": name, "words": words, "at": p - int(first_word[d]), "item_at": q} for name in test.names[item]]
                if len(blocks) > 1:
                    del test, block._value  # one block at a time
            hit = np.cumsum(edge[:-1]) > 0
            spans: list[list[int]] = [[] for _ in range(n_docs)]
            if hit.any():
                begin, end, d = runs(hit, first_word)
                for x, b, e in zip(d, begin, end, strict=True):
                    spans[x] += [int(b - first_word[x]), int(e - first_word[x])]
            out = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
            out["n_words"] = pa.array(np.diff(first_word), pa.int64())
            out["hit_spans"] = pa.array(spans, pa.list_(pa.int64()))
            out["matches"] = pa.array(matches, _MATCH)
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _blocks(benchmark: DataFrame, window: int) -> list:
    """The stated query set as broadcasts of bounded size; the driver builds one at a time."""
    sc, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        if size + len(text) > BLOCK_CHARS and held:
            out.append(sc.broadcast(TestSuffixes(held, window)))
            held, size = [], 0
        held.append(("null" if item is None else item, text))
        size += len(text)
    return [*out, sc.broadcast(TestSuffixes(held, window))] if held else out


ADDED = ("n_words", "hit_spans", "matches")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` with ``n_words``, ``hit_spans`` and ``matches``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lowered.
    ``matches`` has a row for each item of which a window of ``window`` words
    (all words of a shorter item) occurs: the number of words of the longest
    verbatim match, and its first word in the document and in the item, from 0.
    ``hit_spans`` has starts and ends, in words, of covered runs, end exclusive.
    Null and empty texts have no words and hits; repeated rows are judged
    alike, items of equal words are each named; an empty benchmark hits
    nothing; more columns of ``docs`` are kept, but those of the three names
    above are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType

    base = docs.drop(*ADDED)
    match = StructType().add("item", StringType()).add("words", LongType()).add("at", LongType()).add("item_at", LongType())
    schema = StructType([*base.schema.fields]).add("n_words", LongType()).add("hit_spans", ArrayType(LongType())).add("matches", ArrayType(match))
    return map_arrow(base, _scan(_blocks(benchmark, window), to_arrow_schema(schema)), schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts of words, hit words and items, the digest of the items, and the longest match with its first word (-1 without one)."""
    found = contamination(docs.select("doc_id", "text"), benchmark).drop("text")

    def digest(batches):
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            hits = [sum(s[1::2]) - sum(s[::2]) for s in c["hit_spans"].to_pylist()]
            matches = c["matches"].to_pylist()
            names = [sorted({m["item"] for m in x}) for x in matches]
            best = [min(((-m["words"], m["at"]) for m in x), default=(0, -1)) for x in matches]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": c["doc_id"], "n_words": c["n_words"], "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array(map(len, names), pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), "contaminated": pa.array([n > 0 for n in hits], pa.bool_()),
                    "longest_words": pa.array([-n for n, _ in best], pa.int64()), "longest_start": pa.array([at for _, at in best], pa.int64()),
                }
            )

    return map_arrow(found, digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_start long")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the affected documents."""
    own, back = set_aside(docs, set(ADDED))
    return contamination(own, benchmark, window).where(F.size("matches") == 0).select(back)
