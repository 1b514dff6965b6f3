"""The pipeline's stages, each against what its operator says by itself, and the run as a whole."""

import random
import re

import pytest

import corpus_pipeline
from lodestone.llm import bpe, pii
from tests.llm.test_text_operators import brute_components, brute_hits


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with toxic, copied, leaked and personal ones among clean ones."""
    rng = random.Random(11)
    plain = [f"{a}{b}ing" for a in "bcdfghjklm" for b in ("ol", "ar", "in", "et", "und")]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    leak = text(15)
    docs, labels = [], []
    for i in range(400):
        t = text(rng.randrange(20, 60))
        if i % 8 == 0:
            t = t.replace(" ", rng.choice([" idiot ", " moron ", " scum "]), 2)
            labels.append((i, 1, 1))
        elif i % 3 == 0:
            labels.append((i, 1, 0))
        if i in (33, 35):
            t = docs[31][1]
        if i in (41, 43):
            t = t + " " + leak
        if i in (51, 53):
            t = t + " a.b@c.example.com +1 (203) 555-8282"
        docs.append((i, t, "en", "s", len(t)))
    docs.append((400, None, "en", "s", 0))
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").persist()
    columns = docs.columns
    read = lambda df: {r.doc_id: r for r in df.collect()}
    before = read(docs)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == columns and set(read(clean)) == {i for i, r in before.items() if not re.search("idiot|moron|scum", r.text or "")}
    unique = stages["minhash_near_dedup"](spark, docs, sf_dir)
    want = brute_components([(i, r.text) for i, r in before.items()], 5)
    assert unique.columns == columns and set(read(unique)) == {i for i, (_, c) in want.items() if i == c}
    apart = stages["decontamination"](spark, docs, sf_dir)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = dict(zip(sorted(before), brute_hits([before[i].text for i in sorted(before)], bench), strict=True))
    assert apart.columns == columns and set(read(apart)) == {i for i, h in hits.items() if not h[-1]} and not {41, 43} & set(read(apart))
    masked = read(stages["pii"](spark, docs, sf_dir))
    assert set(masked) == set(before) and masked[51].text.endswith("<email> <phone>") and masked[51].n_chars == len(masked[51].text)
    assert all(masked[i].text == before[i].text for i in before if not pii.base_spans(before[i].text or "") and not re.search("[0-9@]", before[i].text or ""))
    ids = read(bpe.decode(stages["byte_bpe"](spark, docs, sf_dir)))
    assert all(ids[i].text == (r.text or "") and ids[i].n_tokens == len(ids[i].token_ids) // 4 for i, r in before.items())


def test_run(spark, sf_dir):
    """The whole run against plain versions of the stages, each on what the one before kept."""
    import base64

    import public_tokenizers
    import tiktoken

    from lodestone.llm import toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.report(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    rows = {r.doc_id: r for r in docs.collect() if not scored[r.doc_id]}
    assert set(rows) == {r.doc_id for r in docs.collect() if not re.search("idiot|moron|scum", r.text or "")}
    rows = {i: rows[i] for i, (_, c) in brute_components([(i, r.text) for i, r in rows.items()], 5).items() if i == c}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = dict(zip(rows, brute_hits([r.text for r in rows.values()], bench), strict=True))
    rows = {i: r for i, r in rows.items() if not hits[i][-1]}
    left = spark.createDataFrame([tuple(r) for r in rows.values()], docs.schema)
    spans = {r.doc_id: r.spans for r in pii.report(left).collect()}

    def masked(text, found):
        out, last = [], 0
        for s, e, kind in sorted((int(x[1]), int(x[2]), x[0]) for x in (p.split(":") for p in found.split(",") if p)):
            if s >= last:
                out += [text[last:s], f"<{kind}>"]
            last = max(last, e)
        return "".join([*out, text[last:]])

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_path(), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (r.lang, r.source, tuple(plain.encode_ordinary(masked(r.text or "", spans[i])))) for i, r in rows.items()}
    got = {r.doc_id: (r.lang, r.source, tuple(int.from_bytes(r.token_ids[k : k + 4], "little") for k in range(0, len(r.token_ids), 4))) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and {31, 51, 53, 400} <= set(got) and not {8, 16, 33, 35, 41, 43} & set(got)
    assert sum("email" in s for s in spans.values()) >= 2


def test_empty_and_clashing_tables(spark, sf_dir, tmp_path):
    """No documents, and documents with columns called as the operators' own, nulls and repeated rows."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/a/{name}.parquet")
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    extra = docs.where("doc_id < 60 OR doc_id = 400").select("*", *(F.lit(i).alias(c) for i, c in enumerate(["matches", "hit_spans", "_toxicity", "n_words", "bands", "token_ids", "n_tokens", "kept", "score"])))
    extra.unionAll(extra).write.parquet(f"{tmp_path}/a/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {31, 51, 53, 400} <= {r.doc_id for r in out} and not {33, 41} & {r.doc_id for r in out}
