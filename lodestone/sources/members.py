"""Members of one large JSON object or zip archive, read by several tasks.

A JSON object, in one file or in several that follow one another, is read as
pieces that end at a closing brace, which Spark's text source cuts at any byte
range of a file.  Whether a piece begins inside
a string, and how deep, follows from what the pieces before it hold: counts of
quotes and brackets are added up within each range, and over the ranges, so
that no task sees more than its own.  Members end where the depth is one.

Of an archive one task lists the directory, and members are read by their
byte ranges.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from lodestone.plans.storage import stored

#: Members that are numbered together: so many texts meet in a task at least.
MEMBERS = 4_096


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` (block, line, ...) with the sum of ``value`` over all rows before: within the block, and of the blocks before, a row each."""
    marked = rows.withColumn("_v", value)
    sums = marked.groupBy("block").agg(F.sum("_v").alias("_sum"))
    base = sums.select("block", F.coalesce(F.sum("_sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("_own", own).join(F.broadcast(base), "block").withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_v", "_own", "_base")


def _blocks(pieces: DataFrame) -> DataFrame:
    """(file, start, block, cut) of each byte range: its number in the order of files, and the line of a piece that the end of its file cuts off instead of a brace."""
    ranges = pieces.groupBy("file", "start").agg(F.sum("bytes").alias("_bytes"), F.max("line").alias("_line"))
    file = Window.partitionBy("file")
    # Each piece counts its brace, so a file whose last piece has none comes out a byte too long.
    cut = (F.sum("_bytes").over(file) > F.col("file.size")) & (F.col("start") == F.max("start").over(file))
    return ranges.select("file", "start", (F.row_number().over(Window.orderBy("file", "start")) - 1).cast("long").alias("block"), F.when(cut, F.col("_line")).alias("cut"))


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.translate(text, character, ""))


def json_members(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, ord, value) of the members of the JSON object at ``path``; ``ord`` is the place in the object.

    ``path`` is a file, or a folder of files (not compressed) that are the
    object one after another, in order of their names, shorter names first;
    each ends outside strings, behind a member's comma, say.  Values are read
    by ``value_schema``; a value of another kind is null.  Keys are taken to
    differ.  White space around the object goes; an empty object has no rows.
    """
    pieces = spark.read.option("lineSep", "}").text(path)
    # A block is a byte range; a task may read several, each in order.
    file = F.struct(F.length("_metadata.file_path").alias("length"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    pieces = pieces.select(file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes, a quote always opens or closes a string
    parts = F.split(bare, '"')
    depth = lambda text: _count(text, "{[") - _count(text, "}]")
    outside = lambda odd: F.array_join(F.filter(parts, lambda x, i: i % 2 == odd), "")
    marked = stored(pieces.withColumns({"bytes": F.octet_length("value") + 1, "quotes": F.size(parts) - 1, "out0": depth(outside(0)), "out1": depth(outside(1))}))
    marked = marked.join(F.broadcast(_blocks(marked)), ["file", "start"]).withColumn("braced", F.coalesce(F.col("line") != F.col("cut"), F.lit(True))).drop("file", "start", "bytes", "cut")
    marked = _before(marked, F.col("quotes"), "seen")
    inside, ends_inside = F.col("seen") % 2 == 1, (F.col("seen") + F.col("quotes")) % 2 == 1
    change = F.when(inside, F.col("out1")).otherwise(F.col("out0")) - F.when(ends_inside | ~F.col("braced"), 0).otherwise(1)
    deep = _before(marked.withColumns({"change": change, "ends_inside": ends_inside}), F.col("change"), "depth")
    after = F.col("depth") + F.col("change")
    closed = (after == 1) & ~F.col("ends_inside") & F.col("braced")
    grouped = _before(deep.withColumns({"after": after, "closed": closed}), F.col("closed").cast("int"), "member")
    # Before the object and behind its own end, whose brace goes, there is white space only.
    rows = grouped.where((F.col("depth") > 0) | ((F.col("depth") == 0) & F.col("value").rlike(r"^\s*\{")))
    piece = F.when(F.col("braced") & (F.col("after") > 0), F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    whole = rows.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("block", "line", piece.alias("piece")))).alias("p"))
    body = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["piece"]), ""), r"^\s*[,{]", "")
    entries = F.map_entries(F.from_json(F.concat(F.lit("{"), body, F.lit("}")), f"MAP<STRING,STRUCT<{value_schema}>>"))
    members = stored(whole.select(F.expr(f"member div {MEMBERS}").alias("block"), F.col("member").alias("line"), entries.alias("entries")).where(F.size("entries") > 0))
    numbered = _before(members, F.size("entries"), "first")
    return numbered.select("first", F.posexplode("entries").alias("at", "e")).select(F.col("e.key").alias("key"), (F.col("first") + F.col("at")).cast("long").alias("ord"), F.col("e.value").alias("value"))


# Archives.


def opened(path: str, mode: str = "rb"):
    """A file to read at any place, or to write (its folder is made): local by path or file:, else by Arrow's file systems."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at) if mode == "rb" else system.open_output_stream(at)


#: Signatures and layouts of the zip format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
TAIL = 22 + 65535


def _directory(f) -> tuple[int, int]:
    """(offset, length) of the central directory."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(max(0, size - TAIL - 20))
    tail = f.read()
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no zip archive")
    length, offset = struct.unpack("<II", tail[at + 12 : at + 20])
    if tail[at - 20 : at - 16] == LOCATOR64:
        f.seek(struct.unpack("<Q", tail[at - 12 : at - 4])[0])
        end = f.read(56)
        if end[:4] != END64:
            raise ValueError("broken zip64 directory")
        length, offset = struct.unpack("<QQ", end[40:56])
    return offset, length


def _entries(f) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, packed bytes, method) of the directory's entries, read a few at a time."""
    at, left = _directory(f)
    held = b""
    f.seek(at)
    while left or held:
        if len(held) < 1 << 17 and left:
            more = f.read(min(left, 1 << 20))
            held, left = held + more, left - len(more)
        if held[:4] != ENTRY:
            return
        method, packed, unpacked = struct.unpack("<H", held[10:12])[0], *struct.unpack("<II", held[20:28])
        names, extras, comments = struct.unpack("<HHH", held[28:34])
        offset = struct.unpack("<I", held[42:46])[0]
        extra = held[46 + names : 46 + names + extras]
        while len(extra) >= 4:  # sizes over 4 GB stand in an extra field, those only that do not fit
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                unpacked = wide.pop(0) if unpacked == 0xFFFFFFFF else unpacked
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n :]
        flags = struct.unpack("<H", held[8:10])[0]
        yield held[46 : 46 + names].decode("utf-8" if flags & 0x800 else "cp437"), offset, packed, method
        held = held[46 + names + extras + comments :]


class ZipDirectory(DataSource):
    """Entries of zip archives, a partition an archive: only the directories are read."""

    @classmethod
    def name(cls) -> str:
        return "zip_directory"

    def schema(self) -> str:
        return "archive string, name string, offset long, packed long, method int"

    def reader(self, schema) -> DataSourceReader:
        return _DirectoryReader(json.loads(self.options["paths"]))


class _DirectoryReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with opened(partition.value) as f:
            for name, offset, packed, method in _entries(f):
                yield partition.value, name, offset, packed, method


def zip_directory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, name, offset, packed, method) of all entries of the archives."""
    spark.dataSource.register(ZipDirectory)
    return spark.read.format("zip_directory").option("paths", json.dumps(paths)).load()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of entries by their byte ranges; what is held is one batch's contents and one open archive."""
    path = f = None
    for batch in batches:
        rows = batch.to_pydict()
        out, size = [], 0
        names: list[str] = []
        for archive, name, offset, packed, method in zip(*(rows[c] for c in ("archive", "name", "offset", "packed", "method")), strict=True):
            if archive != path:
                if f is not None:
                    f.close()
                path, f = archive, opened(archive)
            f.seek(offset)
            head = f.read(30)
            if head[:4] != LOCAL or method not in (0, 8):
                raise ValueError(f"{archive}: entry {name} cannot be read")
            f.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
            data = f.read(packed)
            names.append(name)
            out.append(data if method == 0 else zlib.decompress(data, -15))
            size += len(out[-1])
            if size > 16 << 20:
                yield pa.RecordBatch.from_pydict({"name": names, "content": pa.array(out, pa.binary())})
                names, out, size = [], [], 0
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(out, pa.binary())})
    if f is not None:
        f.close()


def zip_contents(entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """(name, content) of entries of ``zip_directory``: ranges of places in the archives go to several tasks, which read those bytes only."""
    tasks = tasks or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(_read, "name string, content binary")


def probed_members(spark: SparkSession, paths: list[str], keys: DataFrame) -> DataFrame:
    """(name, title, abstract) of the JSON members whose name is a ``key`` of ``keys``: the others' bytes are not read.  What is no JSON object goes."""
    wanted = zip_directory(spark, paths).join(keys.select(F.col("key").alias("name")).distinct(), "name", "left_semi")
    rows = zip_contents(wanted.select("archive", "name", "offset", "packed", "method"))
    parsed = rows.select("name", F.from_json(F.decode("content", "UTF-8"), "title STRING, abstract STRING").alias("m"), F.ltrim(F.decode("content", "UTF-8")).startswith("{").alias("object"))
    return parsed.where("m IS NOT NULL AND object").select("name", "m.title", "m.abstract")
