import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < 0.9 else rng.choice(["the", "Größe,", "Élan.", "x-y", "中文"]) for _ in range(n))


def sample_texts(seed=1):
    """Plain, near and exact copies, shared passages, nulls, empty, blank, one word, ties and a very long text."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(40)]
    passage = words(rng, 30)
    near = [b.replace(b.split()[0], "changed", 1) for b in base[:10]]
    out = [*base, *near, *base[5:12], base[3] + " " + passage, passage + base[4], passage, None, "", "   \n\t", "one", "one", "two words", words(rng, 30_000), "a" * 300, "a" * 200 + "b"]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def texts():
    return sample_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns called as the operators' own, twice over."""
    from pyspark.sql import functions as F

    extra = ["n", "bands", "f1", "rep", "bucket", "score", "held", "_toxicity", "matches", "n_words", "hit_spans", "token_ids", "component_id", "kept", "part", "slice", "task", "ids", "spans", "html", "a", "b", "labels"]
    both = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(extra)))
    return both.unionAll(both)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
