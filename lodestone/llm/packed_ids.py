"""Token ids in a fixed-width bit-packed file format.

Each id takes the least number of bits that the vocabulary needs.  Ids lie in
groups of 64, so that a group fills whole 64-bit words: arrays are packed and
unpacked in numpy, and id k is read from group k // 64 alone.  A file is a
Parquet container of blocks; a block holds consecutive documents, the least and
greatest of their ids, their offsets, and the words.  Blocks follow ascending
doc_id, so a document is found by the blocks' bounds.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._arrow import IS_SPACE, LOWER, binaries, distinct_spans, document_of, map_arrow, runs, slices_by, spread, text_slices
from lodestone.llm._shared import removed_at_end, shared_folder
from lodestone.llm.bpe import LETTER, NUMBER, OTHER, char_classes, characters

#: Ids in a block at least (but for the last of a part), text bytes handled at once, and units remembered by a worker.
BLOCK_IDS, SLICE, MEMORY = 1 << 20, 2 << 20, 1_200_000
END_ID = 1
#: Bytes of a file that a look-up reads at least: a row group has a few blocks.
ROW_GROUP = 8 << 20
BLOCK_SCHEMA = "part int, block int, first long, bits int, low long, high long, doc_ids array<long>, ends array<long>, words binary"


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words; the last group is filled with zeros."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 64)
    words = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        w, shift = divmod(j * bits, 64)
        words[:, w] |= padded[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, w + 1] |= padded[:, j] >> np.uint64(64 - shift)
    return words.ravel()


def unpack(words: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop, from the groups that hold them only."""
    if stop <= start:
        return np.empty(0, np.uint32)
    g0, g1 = start // 64, -(-stop // 64)
    part = words[g0 * bits : g1 * bits].reshape(-1, bits)
    out = np.empty((g1 - g0, 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, shift = divmod(j * bits, 64)
        x = part[:, w] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (part[:, w + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.ravel()[start - g0 * 64 : stop - g0 * 64].astype(np.uint32)


_BAD = 8


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, and a flag where it is not normalised alone."""
    return char_classes() + np.where(_alone(), 0, _BAD).astype(np.uint8)


def _alone() -> np.ndarray:
    """Characters that the normaliser changes without their neighbours and within their class: below U+0300, one lower-case letter, no composition."""
    import unicodedata

    kinds = char_classes()
    out = np.zeros(0x110000, bool)
    for c in range(0x300):
        s = chr(c)
        low = s.lower()
        out[c] = len(low) == 1 and unicodedata.normalize("NFC", s) == s and kinds[ord(low)] == kinds[c] and kinds[c] in (LETTER, NUMBER, OTHER)
    return out


class WordEncoder:
    """The library's encoding, taken unit by unit.

    Texts are cut at ASCII white space.  A chunk whose characters are
    normalised one by one is cut further as the tokenizer's own split does;
    any other chunk is a unit.  Each distinct unit goes to the library once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.odd = re.compile("<\\||[" + "".join(f"\\u{c:04x}" for c in np.flatnonzero(~_alone()[:0x300]).tolist()) + "\\u0300-\U0010ffff]")
        self.memory: dict[bytes, bytes] = {}  # ids as 32-bit integers

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents."""
        starts, ends, _ = runs(~IS_SPACE[data], offsets)
        at, code = characters(data)
        n = len(at)
        if not n or not len(starts):
            return starts, ends, np.empty(0, np.int64)
        kind = _classes()[code]
        white = IS_SPACE[data[at]]
        bad = (kind >= _BAD) & ~white
        kind &= _BAD - 1
        bad[:-1] |= (code[:-1] == 0x3C) & (code[1:] == 0x7C)  # may begin a special token
        number = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)  # of characters up to a byte
        first, last = number[starts] - 1, number[ends - 1]
        begin = np.zeros(n + 1, bool)
        begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begin[first] = True
        mark = np.flatnonzero((code[:-1] == 0x27) & begin[: n - 1] & (kind[1:] == LETTER) & ~white[1:])
        if len(mark):
            chunk_end = last[np.searchsorted(first, mark, "right") - 1]
            mark, chunk_end = mark[mark + 1 < chunk_end], chunk_end[mark + 1 < chunk_end]
            low = lambda c: np.where((c >= 65) & (c <= 90), c + 32, c)
            one, two = low(code[mark + 1]), np.where(mark + 2 < chunk_end, low(code[np.minimum(mark + 2, n - 1)]), 0)
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(long, 3, 0))
            mark, size = mark[size > 0], size[size > 0]
            begin[mark + 1] = False
            begin[mark + size] = True
        if bad.any():  # of a chunk with such a character only the first begins
            n_bad = np.append(0, np.cumsum(bad, dtype=np.int32))
            whole = n_bad[last] > n_bad[first]
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, first[whole] + 1, 1)
            np.add.at(edge, last[whole], -1)
            begin &= np.cumsum(edge) <= 0
        begin[:-1] &= ~white
        end = begin[1:].copy()
        end[last - 1] = True
        end[:-1] |= white[1:]
        end &= ~white
        s, e = at[begin[:-1]], np.append(at, len(data))[np.flatnonzero(end) + 1]
        return s, e, document_of(s, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with the end id after each, and the documents' offsets in them."""
        low = LOWER[data]
        starts, ends, doc = self.units(low, offsets)
        # Special tokens are cut out of the text as it is, before letters are lowered: a unit that may hold one goes to the library so.
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        for k in np.unique(np.searchsorted(starts, special, "right") - 1).tolist():
            low[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        n_docs = len(offsets) - 1
        memory, flat = self.memory, []
        one, which = distinct_spans(low, starts, ends)
        text = low.tobytes()
        pieces = [text[s:e] for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        if len(memory) > MEMORY:
            memory.clear()
        new = [p for p in pieces if p not in memory]
        odd = [p for p in new if self.odd.search(p.decode())]
        for p in odd:  # chunks that are not cut
            memory[p] = array("I", self.tokenizer.encode(p.decode(), add_special_tokens=False).ids).tobytes()
        if odd:
            new = [p for p in new if p not in memory]
        for k in range(0, len(new), 2048):
            part = new[k : k + 2048]
            found = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
            if (words >= 0).all() and len(words) and words[-1] + 1 == len(part):  # each unit is one word of the library's
                ids, size = array("I", found.ids).tobytes(), 4 * np.append(0, np.cumsum(np.bincount(words, minlength=len(part))))
                for p, a, b in zip(part, size[:-1].tolist(), size[1:].tolist(), strict=True):
                    memory[p] = ids[a:b]
            else:
                for p, e in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                    memory[p] = array("I", e.ids).tobytes()
        sizes = np.empty(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            ids = memory[p]
            sizes[i] = len(ids) >> 2
            flat.append(ids)
        counts = sizes[which]
        per_doc = np.bincount(doc, counts, n_docs).astype(np.int64) + 1
        bounds = slices_by(per_doc)
        out = np.full(bounds[-1], END_ID, np.uint32)
        out[spread(slices_by(counts)[:-1] + doc, counts)] = np.frombuffer(b"".join(flat), np.uint32)[spread(slices_by(sizes)[:-1][which], counts)]
        return out, bounds


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _blocks(bits: int):
    """Rows (part, doc_id, ids) come sorted; blocks go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"part": None, "block": 0, "first": 0}
        ids, docs, ends, total = [], [], [], 0

        def flush():
            nonlocal total
            words = pack(np.concatenate(ids) if ids else np.empty(0, np.uint32), bits)
            known = [d for d in docs if d is not None] or [None]
            row = {
                "part": pa.array([state["part"]], pa.int32()), "block": pa.array([state["block"]], pa.int32()), "first": pa.array([state["first"]], pa.int64()), "bits": pa.array([bits], pa.int32()), "low": pa.array(known[:1], pa.int64()), "high": pa.array(known[-1:], pa.int64()),
                "doc_ids": pa.array([docs[:]], pa.list_(pa.int64())), "ends": pa.array([ends[:]], pa.list_(pa.int64())), "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
            }
            state["block"] += 1
            state["first"] += total
            ids.clear(), docs.clear(), ends.clear()
            total = 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part, doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != state["part"]:
                    if docs:
                        yield flush()
                    state.update(part=part, block=0, first=0)
                new = np.frombuffer(packed.as_buffer(), "<u4" if bits > 16 else "<u2")
                ids.append(new)
                docs.append(doc)
                total += len(new)
                ends.append(total)
                if total >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, parts: int | None = None) -> int:
    """Encodes whole texts, with the end id after each, into files at ``path``; returns the bits of an id.

    Null and empty texts give the end id alone.  Documents follow ascending
    doc_id, null ids first; rows of one id follow their ids' bytes.  Columns
    other than ``doc_id`` and ``text`` are not read; an empty table gives no
    blocks.
    """
    tokenizer = tokenizer or default_path()
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = encoder(tokenizer).tokenizer.get_vocab_size(True)
    bits = bits_for(size)
    bounds = np.unique(docs.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.002) if parts > 1 else [])
    kind = "<u4" if bits > 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for rows, data, offsets in text_slices(batches, "text", SLICE):
            ids, cut = e.encode(data, offsets)
            doc = rows.column(0)
            part = np.searchsorted(bounds, doc.fill_null(-(2**63)).to_numpy().astype(float), "left") if len(bounds) else np.zeros(len(doc), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), doc, binaries(ids.astype(kind), cut)], names=["part", "doc_id", "ids"])

    rows = map_arrow(docs.select("doc_id", "text"), run, "part int, doc_id long, ids binary")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    map_arrow(rows, _blocks(bits), BLOCK_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return bits


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents' ids as little-endian unsigned 32-bit integers, in the files' order by ``start``."""
    return _read(spark, path, lambda ids: ids.astype("<u4").tobytes(), "ids binary", pa.binary())


def _read(spark: SparkSession, path: str, of_ids, column: str, kind: pa.DataType) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row for each part, as many as the writer had partitions.
    totals = blocks.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n")).orderBy("part").collect()
    base, held = {}, 0
    for part, n in totals:
        base[part] = held
        held += n
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], "<u8")
                ends = np.array(row["ends"], np.int64)
                starts = np.append(0, ends[:-1])
                ids = unpack(words, row["bits"], 0, int(ends[-1]))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": starts + (base[row["part"]] + row["first"]), "n_tokens": ends - starts, name: pa.array([of_ids(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], kind)}
                )

    return map_arrow(blocks, run, f"doc_id long, start long, n_tokens long, {column}")


def document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """The ids of one document (the first of those with this id): Parquet leaves out row groups whose bounds exclude it, and only its groups of words are unpacked."""
    near = spark.read.schema(BLOCK_SCHEMA).parquet(path).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).where(F.array_contains("doc_ids", F.lit(doc_id)))
    row = near.orderBy("part", "block").first()
    if row is None:
        raise KeyError(doc_id)
    k = row["doc_ids"].index(doc_id)
    return unpack(np.frombuffer(row["words"], "<u8"), row["bits"], row["ends"][k - 1] if k else 0, row["ends"][k]).tolist()


def report(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    write(docs, path)
    removed_at_end(spark, path)
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long", pa.int64())
