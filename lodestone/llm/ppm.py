"""Language-model scoring by prediction by partial matching.

All training texts give the counts of a byte-context trie of three bytes, of
which every context stays.  Code lengths, with escapes by method C and
exclusion of the symbols that longer contexts have already offered, are worked
out once by partitions of contexts and held sparsely: those of the symbols seen
in a context, and what an escape from it adds.  They go out in blocks of
bounded size, of which a worker holds one at a time.  Beside it stands a
unigram model of words over all training texts: words are counted first; the
frequent ones, a bounded number by their share of all tokens, go to every
worker, and of the others slices ask word partitions, which hold the counts of
their words and answer, row by row, with sums per document.  Words are told
apart by 64-bit hashes; two that share one would be counted as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._arrow import IS_SPACE, LOWER, Hasher, map_arrow, runs, text_slices
from lodestone.llm._shared import written

#: Strings of four bytes that a row of the priced table and a block of the model hold, but for one context of two bytes more.
CHUNK, BLOCK = 1 << 18, 1 << 22
FOLDS, HELD_OUT = 7, 2
#: Bytes of text whose distinct words are sent together; a word of at least 1 / FREQUENT of all training tokens goes to every
#: worker (so no more than FREQUENT words do); words whose counts a partition holds.
SEND_BYTES, FREQUENT, PART_WORDS = 3 << 20, 1 << 15, 1 << 22
_END = np.uint64(0x2545F4914F6CDD1D)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with three zeros before each document, and the places of the documents' bytes in it."""
    at = np.arange(len(data)) + 3 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out = np.zeros(len(data) + 3 * (len(offsets) - 1), np.uint8)
    out[at] = data
    return out, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four bytes in a row in training texts."""
    grams, counts, held = [], [], 0

    def merged():
        g, n = np.concatenate(grams), np.concatenate(counts)
        order = np.argsort(g, kind="stable")
        g, n = g[order], n[order]
        new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        return g[new], np.add.reduceat(n, new)

    for rows, data, offsets in text_slices(batches):
        if not len(data):
            continue
        train = ~rows.column(rows.schema.get_field_index("held")).to_numpy(zero_copy_only=False)
        p, at = _padded(data, offsets)
        at = at[np.repeat(train, np.diff(offsets))]
        g = np.zeros(len(at), np.uint32)
        for k in range(4):
            g |= p[at - k].astype(np.uint32) << np.uint32(8 * k)
        g.sort()
        if not len(g):
            continue
        new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        grams.append(g[new])
        counts.append(np.diff(np.append(new, len(g))))
        held += len(new)
        if held > 4_000_000:
            g, n = merged()
            grams, counts, held = [g], [n], len(g)
    if grams:
        g, n = merged()
        yield pa.RecordBatch.from_pydict({"gram": pa.array(g.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal sorted keys, and the run of each key."""
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _escape(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.where(kinds > 0, np.log10(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0.0)


#: Binary columns of the priced table: four bytes with their cost; contexts of three with what symbols of the
#: context of two and others pay; two bytes and a symbol with the log of the count; contexts of two alike, and what
#: symbols of the context of one and others pay further.
PRICED = {"key3": "<u4", "cost3": "<f4", "context3": "<u4", "into3": "<f4", "past3": "<f4", "key2": "<u4", "log2": "<f4", "context2": "<u4", "into2": "<f4", "past2": "<f4", "into1": "<f4", "past1": "<f4"}


def _price(n1: np.ndarray):
    """A partition of contexts of two bytes: the code lengths (log10, positive) of all that was counted after them.

    A key has the bytes b-2, b-1, b-3 and the symbol, so that contexts of two, and of three in them, stand together.
    The symbols of a context are among those of the shorter ones, so an exclusion is a subtraction.
    """

    def price(key: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        two_and_symbol = (key >> 16 << 8) | (key & 0xFF)
        key2, which2 = np.unique(two_and_symbol, return_inverse=True)
        n2 = np.bincount(which2, n, len(key2))
        at2, of2 = _groups(key2 >> 8)
        context2 = key2[at2] >> 8
        total2, kinds2 = np.add.reduceat(n2, at2), np.bincount(of2)
        at3, of3 = _groups(key >> 8)
        total3, kinds3 = np.add.reduceat(n, at3), np.bincount(of3)
        two_of_3 = np.searchsorted(context2, key[at3] >> 16)
        left, left_kinds = total2[two_of_3] - np.add.reduceat(n2[which2], at3), kinds2[two_of_3] - kinds3
        out3 = _escape(total3, kinds3)
        after = n1[context2 & 0xFF]
        left1 = after.sum(1) - np.add.reduceat(n1[(key2 >> 8) & 0xFF, key2 & 0xFF], at2)
        left1_kinds = (after > 0).sum(1) - kinds2
        return {
            "key3": key, "cost3": np.log10((total3 + kinds3)[of3] / n),
            "context3": key[at3] >> 8, "into3": out3 + np.log10(np.maximum(left + left_kinds, 1)), "past3": out3 + _escape(left, left_kinds),
            "key2": key2, "log2": np.log10(n2),
            "context2": context2, "into2": np.log10(total2 + kinds2), "past2": _escape(total2, kinds2), "into1": np.log10(np.maximum(left1 + left1_kinds, 1)), "past1": _escape(left1, left1_kinds),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        g, n = (np.concatenate(x) for x in zip(*held, strict=True))
        key = ((g >> 8) & 0xFFFF) << 16 | (g >> 24) << 8 | (g & 0xFF)
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.float64)
        ends = np.append(_groups(key >> 16)[0][1:], len(key))
        begin = 0
        while begin < len(key):
            end = int(ends[min(np.searchsorted(ends, begin + CHUNK), len(ends) - 1)])
            got = price(key[begin:end], n[begin:end])
            yield pa.RecordBatch.from_pydict({c: pa.array([got[c].astype(t).tobytes()], pa.binary()) for c, t in PRICED.items()})
            begin = end

    return run


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class Model:
    """Costs (log10, positive) of a byte after at most one, and broadcast blocks of those after two and three."""

    def __init__(self, n1: np.ndarray, blocks: list):
        self.blocks = blocks
        n0, total1, kinds1 = n1.sum(0), n1.sum(1, keepdims=True), (n1 > 0).sum(1, keepdims=True)
        self.seen1 = n1 > 0
        left, left_kinds = n0.sum() - np.where(self.seen1, n0, 0).sum(1, keepdims=True), (n0 > 0).sum() - kinds1
        rest = 256 - (n0 > 0).sum()  # bytes that no training text has are alike
        #: after all symbols of the context of one are excluded
        self.below1 = np.where(n0 > 0, np.log10(np.maximum(left + left_kinds, 1) / np.maximum(n0, 1)), _escape(left, left_kinds) + np.log10(max(rest, 1)))
        self.log1 = np.log10(np.maximum(n1, 1))
        self.cost1 = np.where(self.seen1, np.log10(np.maximum(total1 + kinds1, 1)) - self.log1, _escape(total1, kinds1) + self.below1)

    def _fill(self, block: dict[str, np.ndarray], key: np.ndarray, cost: np.ndarray) -> None:
        """The costs of those keys whose context of two is in the block."""
        at, known = _find(block["context2"], key >> 16)
        mine = np.flatnonzero(known)
        if not len(mine):
            return
        key, two = key[mine], at[mine]
        at, hit = _find(block["key3"], key)
        out = block["cost3"][at].astype(np.float64)
        miss = np.flatnonzero(~hit)
        key, two = key[miss], two[miss]
        at, known = _find(block["context3"], key >> 8)
        into, past = (np.where(known, block[f"{c}3"][at], block[f"{c}2"][two]) for c in ("into", "past"))
        at, hit = _find(block["key2"], (key >> 16 << 8) | (key & 0xFF))
        one, symbol = (key >> 16) & 0xFF, key & 0xFF
        lower = past + np.where(self.seen1[one, symbol], block["into1"][two] - self.log1[one, symbol], block["past1"][two] + self.below1[one, symbol])
        out[miss] = np.where(hit, into - block["log2"][at], lower)
        cost[mine] = out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text."""
        p, at = _padded(data, offsets)
        packed = np.arange(len(at), dtype=np.uint64)  # slices have less than 2 ** 32 bytes
        for back, bit in ((2, 56), (1, 48), (3, 40), (0, 32)):
            packed |= p[at - back].astype(np.uint64) << np.uint64(bit)
        packed.sort()
        place = (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        every = (packed >> np.uint64(32)).astype(np.uint32)
        first, which = _groups(every)
        key = every[first]
        each = self.cost1[(key >> 16) & 0xFF, key & 0xFF]
        for block in self.blocks:
            self._fill(block.value, key, each)
            if len(self.blocks) > 1:
                del block._value  # one block at a time
        cost = np.empty(len(at))
        cost[place] = each[which]
        sums = np.append(0.0, np.cumsum(cost))
        return sums[offsets[:-1]] - sums[offsets[1:]]


def _blocks(priced: DataFrame) -> list:
    """Broadcasts of at most about BLOCK strings; the driver holds one of them at a time."""
    out, held, size = [], [], 0

    def send():
        block = {c: np.concatenate([np.frombuffer(r[c], t) for r in held]) for c, t in PRICED.items()}
        for by, columns in (("key3", ["cost3"]), ("context3", ["into3", "past3"]), ("key2", ["log2"]), ("context2", ["into2", "past2", "into1", "past1"])):
            order = np.argsort(block[by])
            block |= {c: block[c][order] for c in (by, *columns)}
        out.append(priced.sparkSession.sparkContext.broadcast(block))

    for row in priced.toLocalIterator():
        held.append(row)
        size += len(row["key3"]) // 4
        if size >= BLOCK:
            send()
            held, size = [], 0
    if held:
        send()
    return out


def train(docs: DataFrame) -> Model:
    """``docs`` has ``text`` and ``held``; all rows that are not held out count."""
    grams = written(map_arrow(docs.select("text", "held"), _count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    n1 = np.zeros((256, 256))
    for context, symbol, n in grams.groupBy((F.shiftright("gram", 8) % 256).alias("context"), (F.col("gram") % 256).alias("symbol")).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        n1[context, symbol] = n
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_context = grams.select("gram", "n").repartition(parts, F.shiftright("gram", 8) % 65536)
    return Model(n1, _blocks(written(map_arrow(by_context, _price(n1), ", ".join(f"{c} binary" for c in PRICED)))))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all tokens, the ends last."""
    low = LOWER[data]
    starts, ends, doc = runs(~IS_SPACE[low], offsets)
    n_docs = len(offsets) - 1
    return np.append(Hasher(low)(starts, ends), np.full(n_docs, _END)), np.append(doc, np.arange(n_docs))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of training texts, summed over a task as far as they fit."""
    words, counts, held = [], [], 0

    def merged():
        w, which = np.unique(np.concatenate(words), return_inverse=True)
        return w, np.bincount(which, np.concatenate(counts), len(w)).astype(np.int64)

    def row():
        w, n = merged()
        return pa.RecordBatch.from_pydict({"word": pa.array(w.view(np.int64)), "n": pa.array(n)})

    for rows, data, offsets in text_slices(batches):
        h, doc = _words(data, offsets)
        h = h[~rows.column(rows.schema.get_field_index("held")).to_numpy(zero_copy_only=False)[doc]]
        w, n = np.unique(h, return_counts=True)
        words.append(w)
        counts.append(n)
        held += len(w)
        if held > 2_000_000:
            w, n = merged()
            words, counts, held = [w], [n], len(w)
            if held > 1_000_000:
                yield row()
                words, counts, held = [], [], 0
    if held:
        yield row()


def _part(words: np.ndarray, parts: int) -> np.ndarray:
    return (words // np.uint64(2**64 // parts + 1)).astype(np.int64)


def _pack_counts(parts: int):
    """Rows (part, word, n) of whole partitions as sorted arrays, in rows of the kind that slices send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            order = np.argsort(w)
            w, n = w[order], n[order]
            cut = np.searchsorted(_part(w, parts), np.arange(parts + 1))
            out = [(-1, p, 0, w[a:b].tobytes(), n[a:b].astype("<i8").tobytes(), *[None] * 8) for p in np.flatnonzero(np.diff(cut)).tolist() for a, b in [cut[p : p + 2]]]
            yield _sent(out)

    return run


def _send(model: Model, parts: int, frequent: tuple[np.ndarray, np.ndarray]):
    """Each slice's distinct words but the frequent ones, with their documents, by word partition; one of them also carries what is final."""
    often, often_n = frequent
    often_log = np.log10(often_n + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for rows, data, offsets in text_slices(batches, limit=SEND_BYTES):
            n_docs = rows.num_rows
            h, doc = _words(data, offsets)
            total = np.bincount(doc, minlength=n_docs)
            at, here = _find(often, h) if len(often) else (np.zeros(len(h), np.int64), np.zeros(len(h), bool))
            sums, known = np.bincount(doc[here], often_log[at[here]], n_docs), np.bincount(doc[here], minlength=n_docs)
            h, doc = h[~here], doc[~here]
            words, which = np.unique(h, return_inverse=True)
            pair = np.sort(which * n_docs + doc)
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
            tf = np.diff(np.append(new, len(pair)))
            pair = pair[new]
            of_word, of_doc = pair // n_docs, pair % n_docs
            n_of_word = np.bincount(of_word, minlength=len(words)).astype("<u4")
            w_cut = np.searchsorted(_part(words, parts), np.arange(parts + 1))
            p_cut = np.append(0, np.cumsum(n_of_word, dtype=np.int64))[w_cut]
            score = model.score(data, offsets)
            held, no_id = rows.column(rows.schema.get_field_index("held")).to_numpy(zero_copy_only=False), np.asarray(rows.column(0).is_null())
            of_doc, tf = of_doc.astype("<u4" if n_docs > 65536 else "<u2"), tf.astype("<u4" if len(tf) and tf.max() > 255 else "u1")
            carrier = (31 * task + k) % parts  # one partition carries what is final
            final = [x.tobytes() for x in (rows.column(0).fill_null(0).to_numpy().astype("<i8"), total.astype("<i8"), score.astype("<f8"), held.astype("u1") + 2 * no_id.astype("u1"), np.stack((sums, known)).astype("<f8"))]
            out: list[tuple] = []
            for p in range(parts):
                a, b, c, d = w_cut[p], w_cut[p + 1], p_cut[p], p_cut[p + 1]
                if p == carrier or b > a:
                    out.append((task << 32 | k, p, n_docs, words[a:b].tobytes(), None, n_of_word[a:b].tobytes(), of_doc[c:d].tobytes(), tf[c:d].tobytes(), *(final if p == carrier else [None] * 5)))
            yield _sent(out)
            k += 1

    return run


SENT = ["slice", "part", "n_docs", "words", "counts", "n_of_word", "of_doc", "tf", "doc_ids", "total", "score", "flags", "often"]
ANSWERED = ["slice", "part", "n_docs", "at", "sums", "known", "doc_ids", "total", "score", "flags", "often"]


def _sent(rows: list[tuple], names: list[str] = SENT) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 3)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word partition, sorted by slice: first the counts of its words, then, one row at a time, sums for each slice's documents."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    words = count = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["slice"] < 0:
                held.append((np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], "<i8")))
                continue
            if words is None:
                words, count = (np.concatenate([h[i] for h in held] or [np.empty(0, t)]) for i, t in enumerate((np.uint64, np.int64)))
                order = np.argsort(words)
                words, count, held = words[order], count[order], []
            n_of_word = np.frombuffer(r["n_of_word"], "<u4")
            at, hit = _find(words, np.frombuffer(r["words"], np.uint64)) if len(words) else (np.zeros(len(n_of_word), np.int64), np.zeros(len(n_of_word), bool))
            c = np.where(hit, count[at], 0) if len(words) else np.zeros(len(n_of_word))
            doc = np.frombuffer(r["of_doc"], "<u4" if r["n_docs"] > 65536 else "<u2")
            tf = np.frombuffer(r["tf"], "<u4" if len(r["tf"]) > len(doc) else "u1").astype(np.float64)
            some = np.flatnonzero(np.bincount(doc, minlength=1))
            sums, known = (np.bincount(doc, tf * np.repeat(x, n_of_word))[some] if len(doc) else np.empty(0) for x in (np.log10(c + 1), c > 0))
            out.append((r["slice"], r["part"], r["n_docs"], some.astype("<u4").tobytes(), sums.astype("<f8").tobytes(), known.astype("<u4").tobytes(), *(r[x] for x in SENT[8:])))
        if out:
            yield _sent(out, ANSWERED)


def _gather(tokens: int, distinct: int):
    """All answers of a slice come together, sorted by slice and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, {}

        def flush():
            total, flags, often = np.frombuffer(state["total"], "<i8"), np.frombuffer(state["flags"], "u1"), np.frombuffer(state["often"], "<f8").reshape(2, -1)
            base = state["sums"] + often[0] - total * np.log10(tokens + distinct + 1)
            ids = pa.array(np.frombuffer(state["doc_ids"], "<i8"), pa.int64(), mask=flags >= 2)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids, "held_out": pa.array((flags & 1).astype(bool)), "n_tokens": pa.array(total, pa.int64()), "n_known": pa.array((state["known"] + often[1]).astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(total), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(np.frombuffer(state["score"], "<f8")),
                }
            )

        for batch in batches:
            for r in batch.to_pylist():
                if r["slice"] != now:
                    if now is not None:
                        yield flush()
                    now, state = r["slice"], {"sums": np.zeros(r["n_docs"]), "known": np.zeros(r["n_docs"])}
                if r["doc_ids"] is not None:
                    state |= {c: r[c] for c in SENT[8:]}
                at = np.frombuffer(r["at"], "<u4")
                state["sums"][at] += np.frombuffer(r["sums"], "<f8")
                state["known"][at] += np.frombuffer(r["known"], "<u4")
        if now is not None:
            yield flush()

    return run


def scores(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``score`` is the byte model's log10 probability of the whole text, 0 for a
    null or empty one, whose only token is the end.  Repeated rows count each
    time, rows without doc_id are training rows; only ``doc_id`` and ``text``
    are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held"))
    model = train(base)
    counts = written(map_arrow(base.select("text", "held"), _count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, distinct = counts.select(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = np.array([tuple(r) for r in counts.where(F.col("n") >= max(1, tokens / FREQUENT)).collect()], np.int64).reshape(-1, 2)  # FREQUENT rows at most
    often = often[np.argsort(often[:, 0].view(np.uint64))]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct // PART_WORDS))
    blob = "slice long, part int, n_docs long, " + ", ".join(f"{c} binary" for c in SENT[3:])
    sent = map_arrow(base, _send(model, parts, (often[:, 0].view(np.uint64).copy(), often[:, 1].copy())), blob)
    rare = counts.where(F.col("n") < max(1, tokens / FREQUENT)).select("word", "n")
    known = map_arrow(rare, _pack_counts(parts), blob)
    blob = ", ".join(f"{c} binary" for c in ANSWERED[3:])
    asked = sent.unionAll(known).repartitionById(parts, F.col("part")).sortWithinPartitions("slice")
    answered = written(map_arrow(asked, _answer, f"slice long, part int, n_docs long, {blob}"))
    mine = answered.repartition(parts, "slice").sortWithinPartitions("slice", "part")
    return map_arrow(mine, _gather(tokens, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
