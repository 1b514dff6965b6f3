"""Members of large objects and archives by byte ranges, and lines in the order of appends."""

import json
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone import more_queries
from lodestone.sources import members, readers, writers

HOSTILE = ['a "quoted" }{ [text]', "back\\slash\\", '\\"', "}", "{", "", 'x"}, "y": {', "line\nbreak\t", "ü中😀 }", "\\\\\"}", "[{]}"]


@pytest.mark.parametrize(("n", "indent", "size"), [(0, None, 1 << 20), (1, None, 1 << 20), (300, None, 997), (300, 2, 4001), (40, 1, 1 << 20)])
def test_json_object_in_byte_ranges(spark, tmp_path, n, indent, size):
    """Texts full of quotes and brackets, nested values, nulls and other kinds, cut into small ranges; ``ord`` is the place."""
    rng = random.Random(n)
    papers = {f"k{i}{rng.choice(HOSTILE)}": {"arxiv_id": str(i), "title": rng.choice(HOSTILE), "abstract": "".join(rng.choices(HOSTILE, k=3)), "authors": rng.choices(HOSTILE, k=2), "extra": [{"a": [1, {"b": "}"}]}, {}]} for i in range(n)}
    if n > 5:
        papers |= {"null": None, "last": None}
    (tmp_path / "db.json").write_text("  " + json.dumps(papers, indent=indent, ensure_ascii=False) + "\n \n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = readers.paper_db(spark, f"{tmp_path}/db.json").orderBy("ord").collect()
        tasks = spark.read.option("lineSep", "}").text(f"{tmp_path}/db.json").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert [(r.paper_id, r.ord) for r in got] == [(k, i) for i, k in enumerate(papers)]
    assert [(r.title, r.abstract, r.authors) for r in got] == [((v or {}).get("title"), (v or {}).get("abstract"), (v or {}).get("authors")) for v in papers.values()]
    assert n < 300 or tasks > 1


@pytest.mark.parametrize(("indent", "size"), [(None, 997), (2, 4001), (1, 1 << 20)])
def test_json_object_in_several_files(spark, tmp_path, monkeypatch, indent, size):
    """An object cut behind members, before commas, in a member and at its very braces reads as one object; a shorter name comes first, and numbers go on over groups of members."""
    monkeypatch.setattr(members, "MEMBERS", 7)
    rng = random.Random(size)
    papers = {f"k{i}{rng.choice(HOSTILE)}": {"arxiv_id": str(i), "title": rng.choice(HOSTILE), "abstract": "".join(rng.choices(HOSTILE, k=3)), "authors": rng.choices(HOSTILE, k=2), "extra": [{"a": [1, {"b": "}"}]}, {}]} for i in range(120)} | {"null": None, "last": None}
    line = [f"{json.dumps(k)}: {json.dumps(v, indent=indent, ensure_ascii=False)}" for k, v in papers.items()]
    comma = [",\n" if i < 20 or i > 80 else "" if i % 2 else "\n," for i in range(len(line) - 1)]
    texts = ["\n ", "{", *(f"{x}{c if i < 20 or i > 80 else ''}" for i, (x, c) in enumerate(zip(line, comma, strict=False))), line[-1], "}\n", "\n"]
    for i in range(20, 81):
        texts[i + 3] = (comma[i] or ",") + texts[i + 3]  # the comma begins the next file
    at = texts[50].rindex("}", 0, -2) + 1
    texts[50:51] = [texts[50][:at], texts[50][at:]]  # ends with a nested value's brace
    assert json.loads("".join(texts)) == papers
    (tmp_path / "db").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "db" / f"part-{i + 40}.json").write_text(text)  # part-99 before part-100
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = readers.paper_db(spark, f"{tmp_path}/db").orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert [(r.paper_id, r.ord) for r in got] == [(k, i) for i, k in enumerate(papers)]
    assert [(r.title, r.abstract, r.authors) for r in got] == [((v or {}).get("title"), (v or {}).get("abstract"), (v or {}).get("authors")) for v in papers.values()]


def test_the_paper_file_is_written_by_several_tasks(spark, monkeypatch):
    """No task writes all papers, and the parts are one object in order of ids."""
    monkeypatch.setattr(more_queries, "place", lambda spark, name, f=more_queries.place: made.append(f(spark, name)) or made[-1])
    made: list[str] = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.paper_id: r.ord for r in more_queries.file_paper_db(spark, "/root/testdata/sf0.001").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(Path(made[0].removeprefix("file:")).glob("part-*"))
    sizes = [p.stat().st_size for p in parts]
    assert len(parts) == 4 and max(sizes) < sum(sizes) / 2
    written = json.loads("".join(p.read_text() for p in parts))
    assert got == {k: i for i, k in enumerate(written)} and list(written) == sorted(written, key=int)


def archive(path, names, kind=zipfile.ZIP_DEFLATED, comment=b""):
    with zipfile.ZipFile(path, "w", kind) as z:
        for name in names:
            z.writestr(name, json.dumps({"title": f"T {name}", "abstract": "A" * 500}))
        z.writestr("text", "no json")
        z.writestr("list", "[1]")
        z.comment = comment


def test_zip_directory_and_probe(spark, tmp_path):
    """Packed and stored members, names beyond ASCII, a comment, an empty archive; only what is asked for is read."""
    archive(tmp_path / "a.zip", [f"m{i}" for i in range(50)] + ["größe"], comment=b"PK trailing comment")
    archive(tmp_path / "b.zip", ["s1", "s2"], zipfile.ZIP_STORED)
    with zipfile.ZipFile(tmp_path / "c.zip", "w"):
        pass
    paths = [str(tmp_path / "a.zip"), f"file://{tmp_path}/b.zip", str(tmp_path / "c.zip")]
    listed = members.zip_directory(spark, paths)
    assert listed.count() == 51 + 2 + 4 and listed.rdd.getNumPartitions() == 3
    keys = spark.createDataFrame([("m7",), ("m7",), ("größe",), ("s2",), ("text",), ("list",), ("none",)], "key string")
    got = {r.name: (r.title, len(r.abstract)) for r in members.probed_members(spark, paths, keys).collect()}
    assert got == {"m7": ("T m7", 500), "größe": ("T größe", 500), "s2": ("T s2", 500)}
    # The bytes of other members are not looked at: they may be broken.
    where = {r.name: r for r in listed.collect()}
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[where["m8"].offset : where["m8"].offset + 20] = b"x" * 20
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    assert members.probed_members(spark, paths, keys).count() == 3


def test_zip64_entries(tmp_path):
    """Sizes and places that stand in the extra field."""
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z, z.open("big", "w", force_zip64=True) as f:
        f.write(b'{"title": "x"}')
    with members.opened(str(tmp_path / "z.zip")) as f:
        assert [(e[0], e[2]) for e in members._entries(f)] == [("big", 14)]


def test_the_last_append_counts(spark, tmp_path):
    """OLD, then NEW in a larger file: the later append wins, however Spark packs the files."""
    schema = "paper_id string, model string, summary string"
    old = spark.createDataFrame([("1", "m", "OLD")], schema)
    new = spark.createDataFrame([("1", "m", "NEW")] + [(str(i), "m", "x" * 100) for i in range(2, 52)], schema)
    for frames in ((old, new), (new, old)):
        path = str(tmp_path / f"cache{len(frames[0].collect())}")
        for df in frames:
            writers.json_lines(df.coalesce(1), path, append=True)
        got = readers.summary_cache(spark, path).where("paper_id = '1'").collect()
        assert [r.summary for r in got] == [frames[1].first().summary]


def test_bench_places_over_files(spark, tmp_path):
    """Lines of two appended files are numbered in the order of the appends."""
    for n, start in ((3, 0), (400, 3)):
        rows = spark.range(start, start + n).select(F.to_json(F.struct(F.col("id").cast("string").alias("qid"))).alias("value"))
        rows.coalesce(1).write.mode("append").text(str(tmp_path / "bench"))
    got = readers.bench(spark, str(tmp_path / "bench")).select("idx", "qid").collect()
    assert sorted((r.idx, int(r.qid)) for r in got) == [(i, i) for i in range(403)]
