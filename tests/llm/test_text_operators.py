"""Each operator against a brute-force version, on texts with all edge cases."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import _arrow, bpe, decontaminate, html_extract, minhash, packed_ids, pii, ppm, suffix_dedup, toxicity

WS = "[^\x20\x09-\x0D]+"


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# Byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(docs, texts, tiktoken_encoding):
    got = rows(bpe.round_trip(docs))
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_pieces(tiktoken_encoding):
    import random

    rng = random.Random(2)
    parts = ["'", "s", "t", "re", "ve", "ll", "'S", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "　", "a", "Ab", "1", "٣", "é", "ß", "中", "!", "…", "😀", "́"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(4000)]
    raw = [s.encode() for s in some]
    ids, cut = bpe.vocabulary(bpe.default_path()).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    for i, s in enumerate(some):
        assert ids[cut[i] : cut[i + 1]].tolist() == tiktoken_encoding.encode_ordinary(s), s


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    assert sorted(bpe.PerfectHash(keys)(keys)) == list(range(len(keys)))


def test_bpe_decode_and_edges(docs, clashing, empty, texts):
    back = rows(bpe.decode(bpe.encode(docs.select("doc_id", "text")).drop("text")))
    assert all(back[i].text == (t or "") for i, t in enumerate(texts))
    assert bpe.encode(clashing).count() == 2 * len(texts)
    assert bpe.encode(empty).count() == 0 and bpe.round_trip(empty).count() == 0


# Suffix-array dedup


def brute_passages(pairs):
    out, starts = {}, defaultdict(set)
    for i, t in pairs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            starts[b[k : k + 50]].add(i)
    for i, t in pairs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if min(starts[b[k : k + 50]]) < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, texts):
    want = brute_passages(list(enumerate(texts)))
    got = rows(suffix_dedup.deduplicate(docs))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got.values() if "�" not in r.text)


def test_suffix_dedup_many_slices(docs, texts, monkeypatch):
    import random

    rng = random.Random(4)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    some = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    df = docs.sparkSession.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(11)
    got = rows(suffix_dedup.report(df))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_passages(list(enumerate(some)))


def test_suffix_dedup_edges(spark, clashing, empty, texts):
    assert suffix_dedup.report(clashing).count() == 2 * len(texts)  # rows of one id do not match each other
    assert suffix_dedup.report(empty).count() == 0
    x = "y" * 10 + "0123456789" * 6
    got = suffix_dedup.report(spark.createDataFrame([(None, x), (2, x), (5, x)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (2, 0), (5, len(x))]


# MinHash


def brute_components(pairs, k, percent=80):
    sets = {}
    for i, t in pairs:
        w = re.findall(WS, low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k):
    got = rows(minhash.near_duplicates(docs, k))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(list(enumerate(texts)), k)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


@pytest.mark.parametrize("block", [8192, 20])
def test_near_duplicate_group(spark, block, monkeypatch):
    """A chain and a crowd of mutual near copies of which many are not alike to the first."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "MEMBERS", block // 4)

    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    crowd = []
    for n in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8])):
            w[rng.randrange(len(w))] = f"n{n}x{rng.randrange(5)}"
        crowd.append(" ".join(w))
    chain = [" ".join(f"c{i}" for i in range(8 * n, 8 * n + 100)) for n in range(8)]
    small = ["p q r s t", "p q r s t u", "p q r s", "p q", "q p", "p", "p"]
    pairs = list(enumerate(crowd + chain + small))
    got = rows(minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), 2))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(pairs, 2)


def test_near_duplicate_edges(clashing, empty, texts):
    assert minhash.near_duplicates(empty).count() == 0
    got = minhash.near_duplicates(clashing, 2).collect()
    assert len(got) == 2 * len(texts) and len({(r.doc_id, r.component_id) for r in got}) == len(texts)
    assert set(minhash.clean(clashing, 2).columns) == set(clashing.columns)


# Packed ids


def test_packed_ids(docs, texts):
    tokenizer = packed_ids.encoder(packed_ids.default_path()).tokenizer
    got, at = rows(packed_ids.report(docs)), 0
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_word_units():
    import random

    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "\n", "a", "1", "é", "é", "́", "ß", "Σ", "İ", "中", "!", "…", "\xa0", "　", "'S", "x", "😀", "\x1c", "\x85", "<|endoftext|>", "|>", "\x00", "É", "²", "½", "ª"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 20))) for _ in range(3000)]
    raw = [s.encode() for s in some]
    e = packed_ids.encoder(packed_ids.default_path())
    ids, cut = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    for i, s in enumerate(some):
        assert ids[cut[i] : cut[i + 1]].tolist() == [*e.tokenizer.encode(s, add_special_tokens=False).ids, 1], s


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 31])
def test_pack_round_trip(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 999).astype(np.uint32)
    w = packed_ids.pack(x, bits)
    assert (packed_ids.unpack(w, bits, 0, 999) == x).all() and (packed_ids.unpack(w, bits, 77, 501) == x[77:501]).all() and not len(packed_ids.unpack(w, bits, 5, 5))


def test_packed_ids_edges(spark, docs, clashing, empty, texts, tmp_path):
    assert packed_ids.report(empty).count() == 0
    assert packed_ids.report(clashing).count() == 2 * len(texts)
    packed_ids.write(docs, f"{tmp_path}/ids")
    i = texts.index("two words")
    assert packed_ids.document(spark, f"{tmp_path}/ids", i) == np.frombuffer(rows(packed_ids.read(spark, f"{tmp_path}/ids"))[i].ids, "<u4").tolist()


# Toxicity


@pytest.fixture(scope="module")
def toxic_rows(spark):
    import random

    rng = random.Random(3)
    bad = ["idiot", "moron", "loser", "worthless", "stupid"]
    data, y = [], []
    for i in range(600):
        w = [rng.choice(["river", "stone", "paper", "little", "house", "window", "summer", "garden", "letter", "simple", "moment", "silent", "story", "minor", "idea"]) for _ in range(rng.randrange(3, 40))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        data.append((i, " ".join(w)))
        y.append((i, 1, int(toxic)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, quality int, toxic int")


def test_toxicity_accuracy_and_obfuscation(spark, toxic_rows):
    d, labels = toxic_rows
    model = toxicity.train(d, labels)
    got, want = rows(toxicity.report(d, labels)), rows(labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    kept = [i for i, r in got.items() if r.held_out]
    assert kept and sum(got[i].predicted == want[i].toxic for i in kept) / len(kept) > 0.97
    hidden = ["house 1d10t window", "a m0r0n here", "you l-o-s-e-r now", "w0rthl3ss paper", "stuuuuupid story", "s t u p i d letter", "such an iiidiooot"]
    plain = ["house window garden", "l-e-t-t-e-r now", "paaaaper", "version 2.0 of 1999"]
    scored = toxicity.score(spark.createDataFrame([(t,) for t in hidden + plain], "text string"), model).collect()
    assert [r.text for r in scored if r.score >= 0.5] == hidden


@pytest.fixture(scope="module")
def toxic_model(toxic_rows):
    return toxicity.train(*toxic_rows)


def test_toxicity_joints_between_longer_chunks(spark, toxic_model):
    hidden = ["house id!ot window", "you lo$er now", "such a mo.ron here", "wor+hless paper", "stu-pid story"]
    plain = ["sum-mer gar.den", "letter-paper house", "win$dow story!silent"]
    scored = toxicity.score(spark.createDataFrame([(t,) for t in hidden + plain], "text string"), toxic_model).collect()
    assert [r.text for r in scored if r.score >= 0.5] == hidden


def test_toxicity_spaced_out_runs(spark, toxic_model):
    hidden = ["house i d 1 0 t window", "window 1 d 1 o t", "paper i d ! o t house", "such a m o r o n here", "h o u s e i d i o t", "p a p e r m o r o n s t o r y", "m - o - r - o - n", "m | o | r | o | n", "a m0 r0 n here", "1d 10 t window"]
    plain = ["such a g a r d e n here", "a b c", "1 2 3 4 5", "p a p e r s t o r y", "x | y | z"]
    scored = toxicity.score(spark.createDataFrame([(t,) for t in hidden + plain], "text string"), toxic_model).collect()
    assert [r.text for r in scored if r.score >= 0.5] == hidden
    words = lambda t: [w.decode() for _, w in toxicity.words_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), toxicity.Restorer(toxic_model.costs))[2]]
    assert "größe" in words("die g r ö ß e hier") and words("") == words("! ! !") == []


def test_toxicity_edges(spark, docs, clashing, empty, toxic_rows, texts):
    labels = toxic_rows[1]
    assert toxicity.report(empty, labels).count() == 0
    assert toxicity.report(docs, labels.limit(0)).count() == len(texts)
    assert all(0 <= r.score <= 1 for r in toxicity.report(docs, labels).collect())
    assert toxicity.clean(clashing, labels.limit(0)).columns == clashing.columns


# PII


def test_pii_base_spans():
    text = "Mail a.b+c@x-y.example.com, é 1.2.3.4 and 1.2.3.999; 4111 1111-1111 1111 no 4111111111111112 call +1 (203) 555-8282 or +12 34."
    want = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m.group())
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                want.append((k, m.start(), m.end()))
    assert pii.base_spans(text) == want and len(want) == 4


@pytest.fixture(scope="module")
def tagger(spark):
    import random

    rng = random.Random(8)
    plain = ["river", "stone", "paper", "little", "house", "window", "summer", "garden", "letter", "simple"]
    data = ["a.b@c.example.com", "10.20.30.40", "4111111111111111", "+1 (203) 555-8282", "version 3", "4111111111111112"]
    rows = [" ".join(rng.choice(data) if rng.random() < 0.05 else rng.choice(plain) for _ in range(60)) for _ in range(120)]
    return pii.train(spark.createDataFrame([(t,) for t in rows], "text string"))


def test_pii_gradients():
    t = pii.Tagger()
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, mask = pii._padded(["call +1 (555) 123-4567 now", "a@b.com x"])
    x, mask, tags = x[:30], mask[:30], np.random.default_rng(0).integers(0, pii.TAGS, (30, 2))
    _, g = t.loss(x, mask, tags)
    rng = np.random.default_rng(1)
    for k, v in t.p.items():
        at = (int(x[3, 0]), 2) if k == "e" else tuple(int(rng.integers(0, n)) for n in v.shape)
        old, up_down = v[at], []
        for d in (1e-4, -1e-4):
            v[at] = old + d
            up_down.append(t.loss(x, mask, tags)[0])
        v[at] = old
        assert abs((up_down[0] - up_down[1]) / 2e-4 - g[k][at]) < 1e-3, k


def test_pii_model_adds_and_keeps(spark, tagger):
    some = ["please write to john_22[at]foo[dot]org soon", "the server 10 . 0 . 0 . 1 is up", "plain words only", "mail a@b.com and 4111111111111111", None, ""]
    got = [r.spans for r in pii.report(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), tagger).orderBy("doc_id").collect()]
    assert "email:" in got[0] and "ip:" in got[1] and got[2] == got[4] == got[5] == ""
    assert {"email:5:12", "card:17:33"} <= set(got[3].split(","))


def test_pii_written_addresses_without_digits(spark, tagger):
    some = ["please write to john.smith[at]foo[dot]org soon", "write mary_jones(at)garden(dot)com about the letter", "a (note) at the [dot] of the house"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(some)], "doc_id long, text string, n_chars long")
    got = [r.spans for r in pii.report(df, tagger).orderBy("doc_id").collect()]
    assert got == ["email:16:41", "email:6:34", ""]
    masks = [r.text for r in pii.clean(df, tagger).orderBy("doc_id").collect()]
    assert masks[:2] == ["please write to <email> soon", "write <email> about the letter"] and masks[2] == some[2]


def test_pii_long_text_windows(tagger):
    text = ("x" * 500 + " +1 (203) 555-8282 ") * 30
    base = pii.base_spans(text)
    assert len(base) == 30 and all(b <= e for b, e in pii.windows_of(text))
    covered = np.zeros(len(text), bool)
    for b, e in pii.windows_of(text):
        covered[b:e] = True
    assert all(covered[m.start()] for m in re.finditer("[0-9@]", text))


def test_pii_edges(clashing, empty, tagger, texts):
    assert pii.report(empty, tagger).count() == 0
    out = pii.clean(clashing, tagger)
    assert out.columns == clashing.columns and out.count() == 2 * len(texts)
    assert pii.masked("a@b.cd 4111111111111111", [(0, 0, 6), (2, 7, 23)]) == "<email> <card>"


# Decontamination


def brute_hits(texts, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(k) for k in windows}
    for t in texts:
        w = word.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= got
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_decontamination(spark, docs, clashing, texts, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    long = [t for t in texts if t and 30 < len(t.split()) < 200]
    items = [(1, " ".join(long[0].split()[3:17])), (2, long[1].upper()), (3, "two   WORDS"), (4, None), (5, ""), (6, long[0]), (10, "never seen words " * 5), (11, "!!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.report(docs, bench))
    assert [tuple(got[i])[1:6] for i in range(len(texts))] == list(brute_hits(texts, items))
    left = decontaminate.clean(clashing, bench)
    assert left.columns == clashing.columns and left.count() == 2 * sum(not r.contaminated for r in got.values())


def test_decontamination_edges(spark, docs, empty, texts):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).where("contaminated").count() == 0
    assert decontaminate.report(docs, none).count() == len(texts) and decontaminate.report(empty, none).count() == 0


# HTML


def test_html_extraction():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></ul></nav><div class="ad">Buy now, cheap</div>'
        "<div class='sidebar'><p>Other, stories, here and there, quite a few of them.</p></div><article><h1>A &amp; B</h1><p>First&nbsp;line\n of <b>text</b>, with commas, and more.<br>Next<p>Second one, also long enough to count for something."
        "<ul><li>one<li>two</ul><script>var t='</p>';</script><aside>x</aside></article><section id=comments><p>Great, article, really great, thanks, a lot.</p></section><form><p>Mail, please</p></form><footer>&copy; x</footer>"
    )
    assert html_extract.extract(page) == "A & B\n\nFirst line of text, with commas, and more. Next\n\nSecond one, also long enough to count for something.\n\none\n\ntwo"
    assert html_extract.extract("<div><p>cut off &amp; gone <b") == "cut off & gone"
    assert [html_extract.extract(x) for x in (None, "", "   ", "<nav>a</nav>", "plain")] == ["", "", "", "", "plain"]
    assert html_extract.extract("<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    assert html_extract.extract('<p>a < b and <a title="x > y">c</a></p>') == "a < b and c"


def test_html_unlikely_names_around_the_article():
    story = "<p>A first paragraph, with commas, and enough words to be the text of a page.</p><p>A second one, which goes on, and on, for a while.</p>"
    want = "A first paragraph, with commas, and enough words to be the text of a page.\n\nA second one, which goes on, and on, for a while."
    for page in (
        f"<div class='layout has-sidebar'><article>{story}</article><div class='sidebar'><p>Other, stories, here.</p></div></div>",
        f"<div id='post-and-comments'><div>{story}</div><div class='comments'><p>Great, really.</p></div></div>",
        f"<div class='has-sidebar'><div class='content share-enabled'>{story}<div class='share'>Share this</div></div></div><p>Contact</p>",
        f"<main><div class='content share-enabled'>{story}</div></main><div class='ad'>Buy, now</div>",
        f"<div class='post'>{story}</div><div class='related'><article><p>Teaser, short.</p></article></div>",
        f"<article>{story}</article><div id='comments'><article class='comment'>{story}{story}{story}</article></div>",
    ):
        assert html_extract.extract(page) == want, page


def test_html_keeps_the_articles_own_links_and_byline():
    page = "<ul><li><a href=/>Home page</a></ul><article><h1>Title</h1><div class='byline'>By A. Writer</div><p>Some text, with commas, and more of it, to be the article.</p><section><ol><li><a href=a>First reference</a><li><a href=b>Second reference</a></ol></section><table><tr><td><a href=c>Linked cell</a></table></article>"
    assert html_extract.extract(page) == "Title\n\nBy A. Writer\n\nSome text, with commas, and more of it, to be the article.\n\nFirst reference\n\nSecond reference\n\nLinked cell"


def test_html_marked_articles_never_lose():
    """Short articles beside adverts and comments, class words within an article, words in buttons, and a title before the article."""
    long = "Buy this, buy that, buy more, and more, and yet more of it, since it is cheap, and good, and new."
    cases = {
        f"<body><article><h1>News</h1><p>Short news.</p></article><div class=ad>{long * 9}</div></body>": "News\n\nShort news.",
        f"<body><div class='ad'>{long * 9}</div><article><h1>T.</h1><p><b>T.<br></article></body>": "T.\n\nT.",
        f"<body><article><p>Short text.</p></article><section><h2>Reader comments</h2><p>{long}</p><p>{long}</p></section></body>": "Short text.",
        f"<article><p>{long}</p><p class='share-price'>It rose.</p><section id='widgets-of-physics'><p>On widgets.</p></section><div class='notice-board-history'>Old boards.</div><div class='ad-slot'>Buy</div><div class='newsletter signup'>Sign</div></article>": f"{long}\n\nIt rose.\n\nOn widgets.\n\nOld boards.",
        "<article><p>Press <button>Start</button> or <label>Stop</label> to go on.</p><form><button>Send</button></form><button>Menu</button></article>": "Press Start or Stop to go on.",
        f"<body><div class='top'><h1>The title</h1></div><article><p>{long}</p></article></body>": f"The title\n\n{long}",
        f"<main><p>Few words.</p></main><div class='popup'>{long * 9}</div>": "Few words.",
        "<article><p><a href=x>Only a link</a></p></article><div class=promo>Many, many, many words, and more, and more.</div>": "Only a link",
    }
    for page, want in cases.items():
        assert html_extract.extract(page) == want, page


def test_html_no_advert_in_any_page(spark):
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        text = html_extract.extract(r.html)
        advert = " ".join(re.search(r'<div class="ad">(.*?)</div>', r.html, re.S).group(1).split())
        assert text and not (advert and advert in text and advert not in r.html.split("<article>")[1]), r.page_id


def test_packed_ids_special_tokens():
    """Special tokens are matched in the text as it is, lower case only, within and beside words."""
    path = packed_ids.default_path()
    texts = ["hello <|ENDOFTEXT|> x", "hello <|endoftext|> x", "<|STARTOFTEXT|>", "<|startoftext|>A<|endoftext|>B", "a<|Endoftext|>b", "<|", "x<|y|>Z", "É<|endoftext|>É <|ENDOFTEXT|>", "<|endoftext|><|EndOfText|>"]
    rng = np.random.default_rng(5)
    parts = ["<|", "|>", "endoftext", "ENDOFTEXT", "<|endoftext|>", " ", "Ab", "é", "1", "'S", "."]
    texts += ["".join(rng.choice(parts, 8)) for _ in range(400)]
    encoder = packed_ids.WordEncoder(path)
    raw = [t.encode() for t in texts]
    ids, bounds = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1] - 1].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.report(pages).collect()) == [(1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_extract.report(pages.limit(0)).count() == 0
    assert html_extract.main_text(pages.withColumn("text", pages.url)).columns[-1] == "text"


# PPM


@pytest.mark.parametrize("frequent", [1 << 15, 20, 1])
def test_lm_scores(docs, texts, frequent, monkeypatch):
    """All, some and no words go to every worker."""
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    monkeypatch.setattr(ppm, "PART_WORDS", 1 << 22 if frequent > 1 else 50)
    got = rows(ppm.scores(docs))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = {i: [*re.findall(WS, low(t)), None] for i, t in enumerate(texts)}
    c = Counter(t for i in tokens if not held[i] for t in tokens[i])
    n, v = sum(c.values()), len(c)
    contexts = [defaultdict(Counter) for _ in range(4)]
    padded = {i: b"\0\0\0" + (t or "").encode() for i, t in enumerate(texts)}
    for i, b in padded.items():
        if not held[i]:
            for k in range(3, len(b)):
                for o in range(4):
                    contexts[o][b[k - o : k]][b[k]] += 1
    memo = {}

    def cost(ctx, sym):
        if (ctx, sym) not in memo:
            spent, out, total = set(), None, 0.0
            for o in (3, 2, 1, 0):
                free = {s: m for s, m in contexts[o].get(ctx[3 - o :], {}).items() if s not in spent}
                if free:
                    all_ = sum(free.values()) + len(free)
                    if sym in free:
                        out = total - math.log10(free[sym] / all_)
                        break
                    total -= math.log10(len(free) / all_)
                    spent |= set(free)
            memo[ctx, sym] = total + math.log10(256 - len(spent)) if out is None else out
        return memo[ctx, sym]

    for i, t in enumerate(texts):
        r, b = got[i], padded[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(c[x] > 0 for x in tokens[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens[i]), rel_tol=1e-9)
        assert math.isclose(r.score, -sum(cost(b[k - 3 : k], b[k]) for k in range(3, len(b))), rel_tol=1e-5, abs_tol=1e-9)


@pytest.mark.parametrize("block", [1 << 22, 20_000])
def test_lm_keeps_every_context(spark, block, monkeypatch):
    """More contexts than a fixed trie of 24,576 would hold, in one block and in several."""
    import random

    monkeypatch.setattr(ppm, "BLOCK", block)
    monkeypatch.setattr(ppm, "CHUNK", block // 8)
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) if rng.random() < 0.7 else rng.choice("aeinrst ") for _ in range(900)) for _ in range(60)]
    texts += [t[rng.randrange(100) :] for t in texts[:20]] + ["plain old text", "\x7f\x7f\x7f", "", None]
    n = [defaultdict(Counter) for _ in range(4)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    padded = [b"\0\0\0" + (t or "").encode() for t in texts]
    for b, h in zip(padded, held, strict=True):
        for k in range(3, 0 if h else len(b)):
            for o in range(4):
                n[o][b[k - o : k]][b[k]] += 1
    assert len(n[3]) > 24576 and any(held)

    def cost(b, k):
        spent, total = set(), 0.0
        for o in (3, 2, 1, 0):
            if free := {s: m for s, m in n[o].get(b[k - o : k], {}).items() if s not in spent}:
                all_ = sum(free.values()) + len(free)
                if b[k] in free:
                    return total - math.log10(free[b[k]] / all_)
                total -= math.log10(len(free) / all_)
                spent |= set(free)
        return total + math.log10(256 - len(spent))

    got = rows(ppm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, b in enumerate(padded):
        assert math.isclose(got[i].score, -sum(cost(b, k) for k in range(3, len(b))), rel_tol=1e-5, abs_tol=1e-9), i


def test_lm_edges(clashing, empty, texts):
    assert ppm.scores(empty).count() == 0
    assert ppm.scores(clashing).count() == 2 * len(texts)


def test_null_ids_and_columns(spark, tagger):
    rows = [(None, "a b c d e f g", None, None, None), (1, None, None, None, None), (1, "a b c d e f g", None, None, 3), (2, "a b c d e f g", "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "c d"), (4, None)], "item_id long, text string")
    for out in (bpe.round_trip(df), suffix_dedup.report(df), minhash.near_duplicates(df), packed_ids.report(df), toxicity.report(df, labels), pii.report(df, tagger), decontaminate.report(df, bench), ppm.scores(df)):
        assert sorted(r.doc_id or 0 for r in out.select("doc_id").collect()) == [0, 1, 1, 2]
    for out in (toxicity.clean(df, labels), minhash.clean(df), decontaminate.clean(df, bench), pii.clean(df, tagger)):
        assert out.columns == df.columns and out.count() >= 1


# Texts that a hash takes for equal


def thue_morse(n):
    """A word and its complement, which a polynomial modulo 2 ** 64 takes for equal whatever its base."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_unlike_texts_of_equal_hash(spark, monkeypatch, tiktoken_encoding):
    """Thue-Morse words, and all hashes forced onto a few values: bytes decide."""
    p, q = thue_morse(2048)
    some = [p, q, f"{p} x", f"{q} x", f"one two {p} three", f"one two {q} three", "one two three four five six seven eight nine ten eleven twelve", "two one three four five six seven eight nine ten eleven"]
    raw = [t.encode() for t in some]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    items = [("7", f"three {p} five"), ("8", q), ("9", "three four five six seven eight nine ten eleven twelve")]
    for forced in (False, True):
        if forced:
            monkeypatch.setattr(_arrow.Hasher, "__call__", lambda self, s, e: (np.asarray(e - s) % 3).astype(np.uint64))
        ids, cut = bpe.Vocabulary.encode(bpe.vocabulary(bpe.default_path()), data, offsets)
        e = packed_ids.encoder(packed_ids.default_path())
        e.memory.clear()
        packed, at = e.encode(data, offsets)
        for i, t in enumerate(some):
            assert forced or ids[cut[i] : cut[i + 1]].tolist() == tiktoken_encoding.encode_ordinary(t)
            assert packed[at[i] : at[i + 1]].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]
        low, s, f, doc = decontaminate.words_of(data, offsets)
        test = decontaminate.TestSuffixes(items)
        number = test.numbers(low, s, f)
        words = [data[a:b].tobytes().decode() for a, b in zip(s, f)]
        known = {w for _, t in items for w in t.split()}
        assert [n >= 0 for n in number] == [w in known for w in words] and len({(n, w) for n, w in zip(number, words) if n >= 0}) == len(set(words) & known)
        one, which = _arrow.distinct_spans(data, s, f)
        assert [words[one[k]] for k in which] == words
    monkeypatch.undo()
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    bench = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    got = rows(decontaminate.report(df, bench))
    assert [tuple(got[i])[1:6] for i in range(len(some))] == list(brute_hits(some, items))
    got = rows(minhash.near_duplicates(df, 2))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(list(enumerate(some)), 2)
    got = rows(bpe.round_trip(df))
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(some))
    got = rows(ppm.scores(df))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(some))]
    c = Counter(w for i, t in enumerate(some) if not held[i] for w in t.split())
    assert [got[i].n_known for i in range(len(some))] == [sum(c[w] > 0 for w in t.split()) + 1 for t in some]


def test_longest_previous_factors():
    import random

    rng = random.Random(6)
    for _ in range(20):
        text = "".join(rng.choice(["ab", "a", "b" * 20, "a" * 30, "ab" * 25]) for _ in range(40)).encode()
        starts = np.array(sorted(rng.sample(range(len(text) - 49), min(120, len(text) - 49))))
        owner = np.array([rng.randrange(6) for _ in starts])
        want = [50 * any(owner[j] < owner[i] and text[starts[j] : starts[j] + 50] == text[starts[i] : starts[i] + 50] for j in range(len(starts))) for i in range(len(starts))]
        assert suffix_dedup.longest_previous_factors(np.frombuffer(text, np.uint8), starts, owner).tolist() == want


def test_suffix_dedup_by_bytes(spark, monkeypatch):
    """Equal hashes of segments and strings prove nothing."""
    import random

    rng = random.Random(12)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randrange(30, 90))) for _ in range(8)]
    pairs = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 5)))) for i in range(40)]
    p, q = thue_morse(1024)
    pairs += [(40, p), (41, q), (42, p + "z")]
    want = brute_passages(pairs)
    got = rows(suffix_dedup.report(spark.createDataFrame(pairs, "doc_id long, text string")))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    # One slice, its steps called here with hashes of three values.
    monkeypatch.setattr(_arrow.Hasher, "__call__", lambda self, s, e: (self.data[s] % 3).astype(np.uint64))
    data = np.frombuffer(b"".join(t.encode() for _, t in pairs), np.uint8)
    sizes = np.array([len(t.encode()) for _, t in pairs])
    import pyarrow as pa

    row = {"task": 0, "slice": 0, "ids": np.arange(len(pairs)).astype("<i8").tobytes(), "no_id": bytes(len(pairs)), "offsets": np.append(0, np.cumsum(sizes)).astype("<i8").tobytes(), "text": suffix_dedup._squeeze(data.tobytes())}
    packed = pa.Table.from_pylist([row])
    asked = [r for b in suffix_dedup._ask(2)(iter(packed.to_batches())) for r in b.to_pylist()]
    replies = [r for part in (0, 1) for b in suffix_dedup._answer(iter(pa.Table.from_pylist([r for r in asked if r["part"] == part]).to_batches())) for r in b.to_pylist()]
    cut = suffix_dedup._cut(2)(packed, pa.Table.from_pylist(replies))
    answers = [b for part in (0, 1) for b in suffix_dedup._match(iter(pa.Table.from_pylist([r for r in cut.to_pylist() if r["part"] == part], schema=cut.schema).to_batches()))]
    got = suffix_dedup._remove(False)(packed, pa.Table.from_batches(answers)).to_pylist()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


# Long and hostile texts


PII_PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = []
    for k, p in enumerate(PII_PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum((d * 2 - 9 * (d > 4)) if j % 2 else d for j, d in enumerate(map(int, reversed(digits))))
            if [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 13 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15][k]:
                out.append((k, m.start(), m.end()))
    return out


def random_pii(seed, n, most=14):
    import random

    rng = random.Random(seed)
    parts = ["a", "b.c", "@", "@", "x-y", ".", ".", "1", "23", "255", "256", "4111111111111111", " ", " ", "-", "+", "(", "é", "_", "%", "+1 203 555 8282", "\n", "１", "[at]", "(dot)", "word ", "10.0.0.1"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, most))) for _ in range(n)]


def test_pii_base_spans_by_plain_patterns():
    for t in random_pii(1, 8000):
        assert pii.base_spans(t) == brute_base(t), t


def test_pii_query_by_plain_patterns_and_single_windows(spark, tagger):
    """All columns, with added spans read from each window alone and reconciled in a dictionary."""
    some = [*random_pii(2, 60, 60), None, "", "x" * 300 + "7" * 400 + "y@z.com"]

    def added(text, base):
        held = {}
        for b, e in pii.windows_of(text):
            tags = tagger.viterbi(*pii._padded([text[b:e]]))[:, 0]
            for i in range(e - b):
                deep = min(i, e - b - 1 - i)
                if b + i not in held or deep > held[b + i][0]:
                    held[b + i] = deep, int(tags[i])
        out, taken, i = [], {x for _, s, e in base for x in range(s, e)}, 0
        while i < len(text):
            tag = held.get(i, (0, 0))[1]
            if not tag:
                i += 1
                continue
            end = i + 1
            while (next_ := held.get(end, (0, 0))[1]) and next_ % 2 == 0 and (next_ - 1) // 2 == (tag - 1) // 2:
                end += 1
            fit = pii.shaped((tag - 1) // 2, text[i:end])
            if fit and not taken & set(range(i + fit[0], i + fit[1])):
                out.append(((tag - 1) // 2, i + fit[0], i + fit[1]))
                taken |= set(range(i + fit[0], i + fit[1]))
            i = end
        return out

    got = rows(pii.report(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), tagger))
    n_added = 0
    for i, t in enumerate(some):
        base = brute_base(t or "")
        more = added(t or "", base)
        n_added += len(more)
        said = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
        assert [got[i][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(said(base).encode()).hexdigest() and got[i].spans == said(base + more), t
    assert n_added


def test_pii_windows_cover_whole_words():
    text = "x" * 90 + ".smith[AT]" + "y" * 90 + "[dot]org end"
    b, e = pii.stretches_of(text)[0]
    assert b == 0 and e >= text.index(" end") and pii.shaped(0, text[: text.index(" end")]) == (0, text.index(" end"))
    for t in random_pii(3, 300, 80):
        covered = np.zeros(len(t) + 1, bool)
        for b, e in pii.windows_of(t):
            covered[b:e] = True
        for m in re.finditer(r"\S*(?:[0-9@]|\((?:at|dot)\)|\[(?:at|dot)\])\S*", t):
            assert covered[m.start() : m.end()].all()


def test_long_texts_take_linear_time():
    import time

    n = 1_000_000
    for t in ("a" * n + " @", "1" * n + ".", "1." * (n // 2), "a" * n + "@b.c", "@" * n, "a@" * (n // 2), "+1" * (n // 2)):
        began = time.time()
        pii.base_spans(t)
        pii.windows_of(t)
        assert time.time() - began < 2, t[:4]
    n = 70_000
    for t in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<span>" * n + "<div></div>" * n, "<b" * n, '<a "' * n, "<p>" * n, "<table><tr><td>" * n, "<svg>" * n):
        began = time.time()
        html_extract.extract(t)
        assert time.time() - began < 3, t[:12]


def test_html_reads_formulas_and_fallbacks():
    page = "<article><p>The value <math><mi>x</mi><mo>=</mo><mn>3</mn><annotation>x=3</annotation></math> holds, in all, of the cases.</p><object><p>Shown, where nothing else, can be.</p></object></article>"
    assert html_extract.extract(page) == "The value x=3 holds, in all, of the cases.\n\nShown, where nothing else, can be."


def test_html_random_pages():
    """Pages written by rule around known blocks."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioubcdfgst") for _ in range(rng.randrange(2, 9)))
    line = lambda n: ", ".join(" ".join(word() for _ in range(6)) for _ in range(n)) + "."
    for _ in range(150):
        blocks, body = [], ""
        for k in range(rng.randrange(3, 8)):
            t = line(rng.randrange(2, 6))
            kind = rng.choice(["p", "p", "p", "h2", "list", "quote", "pre"]) if k else "p"
            if kind == "list":
                items = [line(1) for _ in range(rng.randrange(1, 4))]
                blocks += items
                body += "<ul>" + "".join(f"<li>{i}" + rng.choice(["", "</li>"]) for i in items) + "</ul>"
            else:
                blocks.append(t)
                shown = t.replace(" ", rng.choice([" ", "\n  ", "&#32;"]), 1).replace(t.split()[1], f"<{(x := rng.choice(['b', 'i', 'span', 'code']))}>{t.split()[1]}</{x}>", 1)
                tag = {"quote": "blockquote"}.get(kind, kind)
                body += f"<{tag}>{shown}</{tag}>"
            if rng.random() < 0.3:
                body += rng.choice(["<script>var x = '<p>no</p>';</script>", "<style>p { }</style>", "<!-- <p>no</p> -->", "<div class='ad'>Buy, now</div>", "<form><input><p>Mail, us</p></form>", "<aside><p>Beside, the point</p></aside>"])
        head = rng.choice(["", "<nav><a href=/>Home</a> <a href=/x>More</a></nav>", "<header><p>Site, name</p></header>", "<div class='menu'><ul><li><a href=/>Home</a></ul></div>"])
        foot = rng.choice(["", "<footer>Foot, note</footer>", "<div id='comments'><p>Great, really, great.</p></div>", "<div class='sidebar'><p>Other, stories, here.</p></div>"])
        around = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div><div id=story>", "</div></div>")])
        page = f"<!doctype html><html><head><title>T</title></head><body>{head}{around[0]}{body}{around[1]}{foot}</body></html>"
        assert html_extract.extract(page) == "\n\n".join(blocks), page


def test_toxicity_restores_the_likeliest_word(toxic_model):
    """Viterbi against all paths through the lattice, for short words."""
    import itertools
    import random

    rng = random.Random(4)
    restore = toxicity.Restorer(toxic_model.costs)
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27

    def options(word):
        for i, c in enumerate(word):
            run = len(re.match(re.escape(c) + "*", word[i:]).group()) + next(k for k in range(i + 1) if k == i or word[i - k - 1] != c)
            again = i > 0 and word[i - 1] == c
            repeat = toxicity.REPEAT if run > 2 else toxicity.DOUBLE
            if c.isalpha():
                yield [(c, 0.0)] + ([("", repeat)] if again else [])
            elif c in toxicity.LEET:
                yield [(x, toxicity.SUBSTITUTE) for x in toxicity.LEET[c]] + [("", repeat if again else toxicity.DROP)]
            else:
                yield [("", toxicity.SEPARATOR)]

    for _ in range(300):
        word = "".join(rng.choice("idot10@$-.eli3") for _ in range(rng.randrange(1, 7)))
        word += word[-1] * rng.choice([0, 0, 1, 2])
        best = math.inf
        for path in itertools.product(*options(word)):
            out = "".join(x for x, _ in path)
            marks = [0, 0, *map(code, out), 0]
            cost = sum(c for _, c in path) + sum(toxic_model.costs[marks[k - 2], marks[k - 1], marks[k]] for k in range(2, len(marks)))
            best = min(best, cost)
        least = min(sum(c for _, c in p) + sum(toxic_model.costs[m[k - 2], m[k - 1], m[k]] for k in range(2, len(m))) for p in itertools.product(*options(word)) for m in [[0, 0, *map(code, "".join(x for x, _ in p)), 0]] if "".join(x for x, _ in p) == restore(word))
        assert math.isclose(least, best, rel_tol=1e-9), word


def test_toxicity_scores_word_by_word(spark, toxic_model):
    """The score of each text from its words one at a time, without arrays."""
    import random

    rng = random.Random(7)
    parts = ["idiot", "river", "1d10t", "mo.ron", "loooser", "w0rthless", "Stupid!", "l-o-s-e-r", "42", "45 5 70", "i d i o t", "m 0 r 0 n", "the", "é", "...", "stupidest", "12", "a"]
    some = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    restore, weight = toxicity.Restorer(toxic_model.costs), dict(zip(toxic_model.features.tolist(), toxic_model.weights, strict=True))

    def features(word):
        tags = [int(t) for t in toxicity._TAG]
        h = lambda w: int(_arrow.hash_strings([w])[0])
        return {h(word) ^ tags[0], *(h(word[:p]) ^ tags[k] for k, p in enumerate(toxicity.PREFIXES, 1) if len(word) > p)}

    def cores(text):
        for chunk in re.findall(WS, low(text)):
            core = re.sub(r"[$@]{3,}", lambda m: "\0" * len(m.group()), chunk)
            m = re.search(r"[^\W_]|[$@]", core)
            inner = [i for i, c in enumerate(core) if c.isalpha() or c.isdigit() or c in "$@"]
            yield chunk[inner[0] : inner[-1] + 1] if m and inner else ""

    for t, r in zip(some, toxicity.score(spark.createDataFrame([(x,) for x in some], "text string").coalesce(1), toxic_model).collect(), strict=True):
        found, words = set(), [c for c in cores(t) if c]
        for w in words:
            raw, plain = w.encode(), w.isalpha()
            if plain and not re.search(r"(.)\1\1", w) and len(raw) > 2:
                found |= features(raw)
            if not plain and (re.search(r"[^\W\d_]", w) or len(raw) > 2) or plain and len(raw) > 2 and re.search(r"(.)\1\1", w):
                for p in [*re.findall(r"[^\W\d_]{2,}", w), restore(w)]:
                    if p:
                        found |= features(p.encode())
        short = [len(w) == 1 or len(w) == 2 and not w.isalpha() for w in words]
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and short[j]:
                j += 1
            if j - i > 2:
                run = "".join(words[i:j])
                for p in {restore(run), *restore(run, True).split(" ")}:
                    if p:
                        found |= features(p.encode())
            i = max(j, i + 1)
        total = toxic_model.bias + sum(weight.get(f, 0.0) for f in found)
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9), t
