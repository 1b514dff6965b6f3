"""Best rows of very many query vectors: a block of queries stays in a task, and its part of the corpus streams by.

Blocks and parts make groups, a task each.  There are about as many groups as
cores, so that a row is moved once a block, a query once a part, and a query
hands on its best rows of each part only; what a task holds is bounded by the
sizes of a block and of a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.bounds import small
from lodestone.operators.slices import _key, _matrix, _month_fits
from lodestone.plans.storage import stored

#: Numbers of the queries' vectors, results and rows that a task holds, about; queries whose scores are worked out at a time.
NUMBERS, HELD_RESULTS, PART, CHUNK = 4_000_000, 1_000_000, 250_000, 256
QUERY, GONE, ROW = 0, 1, 2


class _Group:
    """One block of queries and what it has met so far."""

    def __init__(self, most: int, keep_missing: bool):
        self.most, self.keep_missing = most, keep_missing
        self.sides: dict = {QUERY: [], GONE: []}
        self.chunks: list | None = None
        self.info: list[pa.Table] = []
        self.seen = 0

    def take(self, piece: pa.Table) -> None:
        kind = piece["kind"].to_numpy()
        for k in (QUERY, GONE):
            if (kind == k).any():
                self.sides[k].append(piece.filter(pa.array(kind == k)))
        if (kind == ROW).any() and (self.chunks is not None or self.sides[QUERY]):
            if self.chunks is None:
                self._begin()
            self._meet(piece.filter(pa.array(kind == ROW)).combine_chunks())

    def _begin(self) -> None:
        q = pa.concat_tables(self.sides[QUERY]).sort_by("qn").combine_chunks()
        self.qn, before = q["qn"].to_numpy(), pc.dictionary_encode(q["before_date"].combine_chunks(), null_encoding="encode")
        self.dates, self.date_of = before.dictionary.to_pylist(), before.indices.to_numpy()
        self.gone_of = self.gone = None
        if self.sides[GONE]:
            g = pa.concat_tables(self.sides[GONE]).combine_chunks()
            self.gone_of, self.gone = np.searchsorted(self.qn, g["qn"].to_numpy()), g["paper_id"].combine_chunks()
        self.chunks = []
        for begin in range(0, len(self.qn), CHUNK):
            n = min(CHUNK, len(self.qn) - begin)
            self.chunks.append({"begin": begin, "n": n, "q": _matrix(q["vector"].slice(begin, n)), "least": np.full(n, np.inf), "held": [], "size": 0})
        self.sides = {QUERY: [], GONE: []}

    def _meet(self, rows: pa.Table) -> None:
        x, count, ords = _matrix(rows["vector"]), rows.num_rows, rows["ord"].to_numpy()
        months = pc.dictionary_encode(rows["date"].combine_chunks().fill_null(""))
        names, at = np.array(months.dictionary.to_pylist(), object), months.indices.to_numpy()
        fits = np.array([_month_fits(names, d, self.keep_missing)[at] for d in self.dates])
        gone = np.zeros((2, 0), np.int64)
        if self.gone is not None:
            place = pc.index_in(self.gone, value_set=rows["paper_id"].combine_chunks()).fill_null(-1).to_numpy()
            gone = np.array([self.gone_of[place >= 0], place[place >= 0]])
        for c in self.chunks:
            self._chunk(c, x, count, ords, fits, gone[:, (gone[0] >= c["begin"]) & (gone[0] < c["begin"] + c["n"])])
        self.info.append(rows.select(["paper_id", "ord", "date", "arxiv_id"]))
        self.seen += count

    def _chunk(self, c: dict, x: dict, count: int, ords: np.ndarray, fits: np.ndarray, gone: np.ndarray) -> None:
        out, null = self._scores(c, x, count)
        key = -out if null is None else np.where(null, np.inf, -out)
        least = c["least"] + np.where(np.isfinite(c["least"]), 2e-9 + np.abs(c["least"]) * 1e-12, 0)  # more than scores are rounded by
        with np.errstate(invalid="ignore"):
            near = ~(key > least[:, None])  # NaN, which comes first, too
        left = gone[0] - c["begin"], gone[1]
        if np.count_nonzero(near) > 8 * self.most * c["n"]:
            near &= fits[self.date_of[c["begin"] : c["begin"] + c["n"]]]
            near[left] = False
            if count > self.most:
                bound = np.partition(np.where(near, np.where(np.isnan(key), -np.inf, key), np.inf), self.most - 1, axis=1)[:, self.most - 1]
                bound = bound + np.where(np.isfinite(bound), 2e-9 + np.abs(bound) * 1e-12, 0)
                with np.errstate(invalid="ignore"):
                    near &= ~(key > bound[:, None])
            q, r = np.nonzero(near)
        else:
            q, r = np.nonzero(near)
            good = fits[self.date_of[c["begin"] + q], r] & ~np.isin(q * count + r, left[0] * count + left[1])
            q, r = q[good], r[good]
        if len(q):
            none = np.zeros(len(q), bool) if null is None else null[q, r]
            c["held"].append((q, _key(out[q, r], none), ords[r], r + self.seen, out[q, r], none))
            c["size"] += len(q)
            if c["size"] > 2 * self.most * c["n"]:
                self._prune(c)

    def _scores(self, c: dict, x: dict, count: int) -> tuple[np.ndarray, np.ndarray | None]:
        with np.errstate(all="ignore"):
            if len(c["q"]) == 1 and len(x) == 1 and c["q"].keys() == x.keys():
                (at, q), (own, rows) = *c["q"].values(), *x.values()
                if len(at) == c["n"] and len(own) == count:
                    return q @ rows.T, None
            out, null = np.zeros((c["n"], count)), np.ones((c["n"], count), bool)
            for d, (at, q) in c["q"].items():
                if d in x:
                    own, rows = x[d]
                    out[np.ix_(at, own)] = q @ rows.T
                    null[np.ix_(at, own)] = False
        return out, null

    def _prune(self, c: dict) -> list[np.ndarray]:
        """The best of each query of the chunk, in order."""
        held = [np.concatenate(a) for a in zip(*c["held"], strict=True)]
        by = np.lexsort((held[2], held[1], held[0]))
        q = held[0][by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        by = by[place < self.most]
        held = [a[by] for a in held]
        full, last = np.unique(held[0][::-1], return_index=True)
        counts = np.bincount(held[0], minlength=c["n"])
        worst = np.full(c["n"], np.inf)
        worst[full] = held[1][::-1][last]
        c["least"] = np.where(counts >= self.most, worst, np.inf)
        c["held"], c["size"] = [tuple(held)], len(held[0])
        return held

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.info:
            info = pa.concat_tables(self.info)
            for c in self.chunks:
                if c["size"]:
                    q, _, _, row, score, none = self._prune(c)
                    rows = info.take(pa.array(row)).add_column(0, "qn", pa.array(self.qn[c["begin"] + q]))
                    yield from rows.append_column("score", pa.array(score, mask=none, from_pandas=False)).combine_chunks().to_batches()


def _nearest(most: int, keep_missing: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number = None, None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            of = whole["group"].to_numpy()
            for begin, end in zip(cuts := [0, *(np.flatnonzero(np.diff(of)) + 1)], [*cuts[1:], len(of)], strict=True):
                if begin < end and of[begin] != number:
                    if group is not None:
                        yield from group.results()
                    group, number = _Group(most, keep_missing), of[begin]
                if begin < end:
                    group.take(whole.slice(begin, end - begin))
        if group is not None:
            yield from group.results()

    return run


def nearest(rows: DataFrame, queries: DataFrame, most: int, keep_missing: bool = True, excluded: DataFrame | None = None) -> DataFrame:
    """(qid, paper_id, ord, date, arxiv_id, score): rows that hold the ``most`` best rows (paper_id, ord, date, arxiv_id, embedding) of each query (qid, embedding, before_date), without the excluded."""
    spark = rows.sparkSession
    kinds = {rows.schema["embedding"].dataType.simpleString(), queries.schema["embedding"].dataType.simpleString()}
    vector = F.col("embedding").cast(kinds.pop() if len(kinds) == 1 else "array<double>").alias("vector")
    asked = stored(queries.select("qid", F.col("before_date").cast("string").alias("before_date"), vector).withColumn("qn", F.monotonically_increasing_id()))
    count, length = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    own = rows.select("paper_id", "ord", "date", "arxiv_id", vector)
    block = max(CHUNK, min(NUMBERS // max(length or 1, 1), HELD_RESULTS // most))
    blocks = max(1, -(-count // block))
    parts = max(1, -(-spark.sparkContext.defaultParallelism // blocks), -(-own.count() // PART))
    block_of, part_of = F.pmod(F.xxhash64("qn"), F.lit(blocks)), F.pmod(F.xxhash64("paper_id"), F.lit(parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbered = lambda df, kind: df.withColumns({"group": (F.col("part") * blocks + F.col("block")).cast("int"), "kind": F.lit(kind)}).drop("part", "block")
    both = numbered(own.withColumns({"part": part_of, "block": every(blocks)}), ROW)
    both = both.unionByName(numbered(asked.select("qn", "before_date", "vector", block_of.alias("block"), every(parts).alias("part")), QUERY), allowMissingColumns=True)
    if excluded is not None:
        pairs = excluded.select("qid", "arxiv_id").distinct().join(own.select("paper_id", "arxiv_id"), "arxiv_id") if "arxiv_id" in excluded.columns else excluded
        pairs = pairs.select("qid", "paper_id").distinct().join(small(asked.select("qid", "qn")), "qid")
        both = both.unionByName(numbered(pairs.select("qn", "paper_id", block_of.alias("block"), part_of.alias("part")), GONE), allowMissingColumns=True)
    names = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("paper_id", "ord", "date", "arxiv_id"))
    # A group's queries come before its rows.
    met = both.repartitionById(parts * blocks, F.col("group")).sortWithinPartitions("group", "kind").mapInArrow(_nearest(most, keep_missing), f"qn long, {names}, score double")
    return met.join(small(asked.select("qid", "qn")), "qn").select("qid", "paper_id", "ord", "date", "arxiv_id", "score")
