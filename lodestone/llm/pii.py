"""Personal data by fixed patterns and a character-level BiLSTM-CRF.

The patterns give the base spans.  A bidirectional LSTM with CRF transitions,
trained in numpy on spans that the patterns label in a bounded sample of the
corpus and on written variants of them, reads overlapping windows; their
labels are reconciled over the document, each position from the window in
which it lies furthest from an edge, and spans off the base ones are added.
Windows cover every word around a digit, an @ or a written at or dot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm._arrow import map_arrow, slices_by

KINDS = ("email", "ip", "card", "phone")
#: The classifier is fitted on at most so many windows of the corpus, the first by hash, and so many written variants.
SAMPLE_WINDOWS, VARIANTS = 1200, 3000
#: Window length, the step between windows, and the context around a digit, @ or a written at or dot, which goes on to the ends of words.
#: Nothing else is left out: an added span of every kind must hold one of these (see shaped).
WINDOW, STEP, CONTEXT = 96, 48, 32
EMBED, HIDDEN, BATCH, STEPS, SEED = 12, 20, 64, 300, 7
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
MASK = {"email": "<email>", "ip": "<ip>", "card": "<card>", "phone": "<phone>"}

# No pattern can begin within what another start has already read, so that all are linear: a local part is read from
# its @ backwards, and the digits of an ip begin at the first of their run, as an earlier start finds whatever a later one does.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}
_WRITTEN = re.compile(r"\((?:at|dot)\)|\[(?:at|dot)\]", re.I)
_TRIGGER = re.compile(rf"[0-9@]|{_WRITTEN.pattern}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _accepts(kind: str, text: str) -> bool:
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start, in code points."""
    out = []
    if not _TRIGGER.search(text):
        return out
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            s = at = m.start()
            while s > last and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((0, s, last := m.end()))
    for k, kind in enumerate(KINDS[1:], 1):
        if kind == "ip" and "." not in text or kind == "phone" and "+" not in text:
            continue
        out += [(k, m.start(), m.end()) for m in _PATTERNS[kind].finditer(text) if _accepts(kind, m.group())]
    return out


_CLASSES = " \n0123456789abcdefghijklmnopqrstuvwxyz@.+-()_%:/,;=\"'#*"
_OTHER, _ALPHA, N_CLASSES = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2
_CODE = np.full(128, _OTHER, np.int64)
_CODE[[ord(c) for c in _CLASSES]] = np.arange(len(_CLASSES))
_CODE[65:91] = _CODE[97:123]


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _CODE[np.minimum(points, 127)], np.where(points < 0x250, _ALPHA, _OTHER))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, LSTM in both directions, linear emissions, CRF transitions; all arrays are time by batch."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": draw(N_CLASSES, EMBED) * 4, "w": draw(2 * HIDDEN, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32)}
        for d in "fr":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # of the forget gate
            self.p |= {f"x{d}": draw(EMBED, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": bias}

    def _run(self, e: np.ndarray, mask: np.ndarray, d: str, keep: list | None):
        x = e @ self.p[f"x{d}"] + self.p[f"b{d}"]
        n, batch, _ = x.shape
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((n, batch, HIDDEN), np.float32)
        w = self.p[f"h{d}"]
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = x[t] + h @ w
            gates = sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = (f * c + i * g) * mask[t]
            s = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, s, h))
            c, h = new, o * s
            out[t] = h
        return out

    def emissions(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        e = self.p["e"][x]
        h = np.concatenate([self._run(e, mask, d, None if keep is None else keep.setdefault(d, [])) for d in "fr"], axis=2)
        if keep is not None:
            keep |= {"e_": e, "h_": h}
        return h @ self.p["w"] + self.p["b"]

    def _forward(self, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
        a = np.zeros_like(y)
        a[0] = y[0] + self.p["s"]
        for t in range(1, len(y)):
            z = a[t - 1][:, :, None] + self.p["t"]
            m = z.max(1)
            a[t] = np.where(mask[t] > 0, m + np.log(np.exp(z - m[:, None]).sum(1)) + y[t], a[t - 1])
        return a

    def loss(self, x: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood and its gradients."""
        keep: dict = {}
        y = self.emissions(x, mask, keep)
        n, batch, _ = y.shape
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        a = self._forward(y, mask)
        back = np.zeros_like(y)
        for t in range(n - 2, -1, -1):
            z = p["t"] + (y[t + 1] + back[t + 1])[:, None, :]
            m = z.max(2)
            back[t] = np.where(mask[t + 1] > 0, m + np.log(np.exp(z - m[:, :, None]).sum(2)), back[t + 1])
        total = a[-1].max(1) + np.log(np.exp(a[-1] - a[-1].max(1, keepdims=True)).sum(1))
        post = np.exp(a + back - total[:, None]) * mask
        row = np.arange(batch)
        gold = p["s"][tags[0]] + y[0, row, tags[0]]
        dy = post.copy()
        dy[0, row, tags[0]] -= 1
        np.add.at(g["s"], tags[0], -1)
        g["s"] += post[0].sum(0)
        for t in range(1, n):
            live = mask[t, :, 0] > 0
            gold += np.where(live, p["t"][tags[t - 1], tags[t]] + y[t, row, tags[t]], 0)
            dy[t, row[live], tags[t][live]] -= 1
            pair = np.exp(a[t - 1][:, :, None] + p["t"] + (y[t] + back[t])[:, None, :] - total[:, None, None])
            g["t"] += pair[live].sum(0)
            np.add.at(g["t"], (tags[t - 1][live], tags[t][live]), -1)
        g["w"] = np.einsum("tbh,tbk->hk", keep["h_"], dy)
        g["b"] = dy.sum((0, 1))
        dh_all = dy @ p["w"].T
        de = np.zeros_like(keep["e_"])
        for k, d in enumerate("fr"):
            dh = dc = np.zeros((batch, HIDDEN), np.float32)
            dz_all = np.zeros((n, batch, 4 * HIDDEN), np.float32)
            for t, i, f, o, gg, c, s, h in reversed(keep[d]):
                dh = dh + dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dnew = (dc + dh * o * (1 - s * s)) * mask[t]
                dz = np.concatenate((dnew * gg * i * (1 - i), dnew * c * f * (1 - f), dh * s * o * (1 - o), dnew * i * (1 - gg * gg)), axis=1)
                dz_all[t] = dz
                g[f"h{d}"] += h.T @ dz
                dh, dc = dz @ p[f"h{d}"].T, dnew * f
            g[f"x{d}"] = np.einsum("tbe,tbk->ek", keep["e_"], dz_all)
            g[f"b{d}"] = dz_all.sum((0, 1))
            de += dz_all @ p[f"x{d}"].T
        np.add.at(g["e"], x, de)
        return float((total - gold).mean()), {k: v / batch for k, v in g.items()}

    def fit(self, x: np.ndarray, mask: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.03) -> float:
        """Adam; the columns are examples."""
        rng = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        last = 0.0
        for step in range(1, steps + 1):
            pick = rng.integers(0, x.shape[1], BATCH)
            last, g = self.loss(x[:, pick], mask[:, pick], tags[:, pick])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return last

    def viterbi(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        y = self.emissions(x, mask)
        n, batch, _ = y.shape
        best = y[0] + self.p["s"]
        back = np.zeros((n, batch, TAGS), np.int8)
        for t in range(1, n):
            z = best[:, :, None] + self.p["t"]
            back[t] = z.argmax(1)
            best = np.where(mask[t] > 0, z.max(1) + y[t], best)
            back[t] = np.where(mask[t] > 0, back[t], np.arange(TAGS))
        out = np.zeros((n, batch), np.int64)
        out[-1] = best.argmax(1)
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, np.arange(batch), out[t]]
        return out


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((WINDOW, len(texts)), np.int64), np.zeros((WINDOW, len(texts), 1), np.float32)
    for k, t in enumerate(texts):
        c = codes(t)
        x[: len(c), k] = c
        mask[: len(c), k] = 1
    return x, mask


def stretches_of(text: str) -> list[tuple[int, int]]:
    """The parts of a text that windows cover: the context of each digit, @ and written at or dot, on to the ends of words."""
    out: list[tuple[int, int]] = []
    last, n = 0, len(text)
    for m in _TRIGGER.finditer(text):
        p = m.start()
        if out and p < last:
            if p + CONTEXT <= last:
                continue
            begin = out.pop()[0]
        else:
            begin = max(p - CONTEXT, last)
            while begin > last and not text[begin - 1].isspace():
                begin -= 1
            if out and begin == last:
                begin = out.pop()[0]
        last = min(p + CONTEXT, n)
        while last < n and not text[last].isspace():
            last += 1
        out.append((begin, last))
    return out


def windows_in(begin: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows of a stretch."""
    return [(b, min(b + WINDOW, end)) for b in range(begin, max(begin + 1, end - WINDOW + STEP), STEP)]


def windows_of(text: str) -> list[tuple[int, int]]:
    return [w for s in stretches_of(text) for w in windows_in(*s)]


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end): a span begins at its begin tag, or where its kind begins, and goes on over inside tags of the kind."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    begin = np.flatnonzero((kind >= 0) & ((tags % 2 == 1) | (kind != np.append(-1, kind[:-1]))))
    edge = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)))
    end = np.append(edge, len(tags))[np.searchsorted(edge, begin, "right")]
    return list(zip(kind[begin].tolist(), begin.tolist(), end.tolist(), strict=True))


#: Shapes of added spans, and the length up to which a tagged span is looked at.
_SHAPES = (
    re.compile(r"[^\s@]+ ?(?:@|\(at\)|\[at\]) ?[^\s@]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[^\s@.]+)+", re.I),
    re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])"),
    re.compile(r"[0-9][0-9 .()+/\-]*[0-9]"),
    re.compile(r"[0-9+(][0-9 .()+/\-]*[0-9]"),
)
LONGEST = 320


def shaped(kind: int, text: str) -> tuple[int, int] | None:
    """The part of a tagged span, from its first character on, that has the shape of its kind; None if there is none."""
    start = len(text) - len(text.lstrip())
    m = _SHAPES[kind].match(text, start) if len(text) <= LONGEST else None
    if m is None:
        return None
    found = m.group()
    digits = re.sub(r"[^0-9]", "", found)
    if kind == 1:
        good = all(int(x) <= 255 for x in re.findall(r"[0-9]+", found))
    elif kind == 2:
        good = 13 <= len(digits) <= 19 and luhn(digits)
    else:
        good = kind == 0 or 9 <= len(digits) <= 15 and bool(found.startswith("00") or re.search(r"[0-9)][ ().+/-]+[0-9]", found))
    return m.span() if good else None


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], batch: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans of the model in each text that overlap no base span."""
    stretches = [(d, b, e) for d, t in enumerate(texts) for b, e in stretches_of(t)]
    jobs = [(k, b, e) for k, (_, x, y) in enumerate(stretches) for b, e in windows_in(x, y)]
    starts = slices_by(np.array([e - b for _, b, e in stretches], np.int64))
    depth, label = np.full(starts[-1], -1, np.int16), np.zeros(starts[-1], np.int8)
    for k in range(0, len(jobs), batch):
        part = jobs[k : k + batch]
        x, mask = _padded([texts[stretches[j][0]][b:e] for j, b, e in part])
        tags = tagger.viterbi(x, mask)
        for i, (j, b, e) in enumerate(part):
            at = starts[j] + b - stretches[j][1]
            here = np.arange(e - b)
            deep = np.minimum(here, here[::-1])
            better = np.flatnonzero(deep > depth[at : at + e - b])
            depth[at + better], label[at + better] = deep[better], tags[better, i]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    now, taken = -1, np.empty(0, bool)
    for j, (d, begin, end) in enumerate(stretches):
        mine = label[starts[j] : starts[j + 1]]
        if not mine.any():
            continue
        if d != now:
            now, taken = d, np.zeros(len(texts[d]), bool)
            for _, s, e in base[d]:
                taken[s:e] = True
        for kind, s, e in spans_of(mine.astype(np.int64)):
            if (fit := shaped(kind, texts[d][begin + s : begin + e])) is None:
                continue
            s, e = begin + s + fit[0], begin + s + fit[1]
            if not taken[s:e].any():
                out[d].append((kind, s, e))
                taken[s:e] = True
    return out


def _variants(rng: np.random.Generator, kind: int, words: list[str]) -> str:
    """A written form of a kind, drawn by rule; names are random letters or ``words``."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    pick = lambda *x: x[rng.integers(0, len(x))]
    if kind == 0:
        written = pick(("@", "."), (" @ ", "."), (" @ ", " . "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", "."), ("@", "(dot)"), ("@", "[dot]"))
        part = lambda: pick(letters(rng.integers(2, 9)), pick(*words))
        return part() + pick("", digits(2), pick(".", "_", "-") + part()) + written[0] + part() + "".join(written[1] + x for x in pick(("com",), ("org",), ("net",), ("example", "com"), (letters(2),)))
    if kind == 1:
        return pick(".", ".", " . ").join(str(rng.integers(1, 256)) for _ in range(4))
    if kind == 2:
        sep = pick("", "", " ", "-", ".")
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return pick("+1 ", "+", "", "00") + pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a}/{b}{c}")


def _noise(rng: np.random.Generator) -> str:
    """Digits and letters that are none of the kinds."""
    n = int(rng.integers(1, 7))
    return [f"v{n}.{n + 1}", str(n) * n, hashlib.md5(bytes([n])).hexdigest()[: 8 + n], f"19{n}{n}-0{n}-1{n}", f"{n},{n}00.{n}0", f"#{n}", f"{n}:{n}0"][rng.integers(0, 7)]


def train(docs: DataFrame) -> Tagger:
    """Fitted on windows of the corpus, labelled by the patterns, and on variants written into them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, str]] = []
            for text in batch.column(0).to_pylist():
                if text and _TRIGGER.search(text):
                    # The patterns would label a written at or dot as no data.
                    found += [(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=7).digest(), "big"), w) for w in (text[b:e] for b, e in windows_of(text)) if not _WRITTEN.search(w)]
            found = sorted(set(found))[:SAMPLE_WINDOWS]
            yield pa.RecordBatch.from_pydict({"h": pa.array([h for h, _ in found], pa.int64()), "w": pa.array([w for _, w in found], pa.string())})

    rows = map_arrow(docs.select("text"), cut, "h long, w string").distinct().orderBy("h", "w").limit(SAMPLE_WINDOWS).collect()
    rng = np.random.default_rng(SEED)
    texts, tags = [], []

    def add(text: str, spans: list[tuple[int, int, int]]):
        t = np.zeros(WINDOW, np.int64)
        for kind, s, e in spans:
            t[s:e] = 2 * kind + 2
            t[s] = 2 * kind + 1
        texts.append(text[:WINDOW])
        tags.append(t)

    for _, w in rows:
        add(w, base_spans(w))
    plain = [re.sub(r"\S*[0-9@]\S*", "", w) for _, w in rows] or ["text without any data in it "]
    words = [w for t in plain for w in re.findall("[a-z]{2,12}", t)] or ["text"]
    for k in range(VARIANTS):
        around = plain[rng.integers(0, len(plain))].split(" ")
        left, right = " ".join(around[: len(around) // 2])[-int(rng.integers(1, 40)) :], " ".join(around[len(around) // 2 :])
        piece = _noise(rng) if k % 5 == 4 else _variants(rng, k % 5, words)
        left = (left + " ")[: WINDOW - len(piece)]
        text = left + piece + [" ", ". ", ", ", "\n"][rng.integers(0, 4)] + right
        add(text, [] if k % 5 == 4 else [(k % 5, len(left), min(WINDOW, len(left) + len(piece)))])
    x, mask = _padded(texts)
    tagger = Tagger()
    tagger.fit(x, mask, np.stack(tags, axis=1))
    return tagger


def _found(tagger: Tagger, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            rows = batch.slice(i, 2000)
            texts = [t or "" for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]
            base = [base_spans(t) for t in texts]
            yield rows, texts, base, added_spans(tagger, texts, base)


def report(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per document the counts of base spans, their digest and all spans.

    Null and empty texts have none; texts are read whole; repeated rows have
    equal spans; only ``doc_id`` and ``text`` are read.
    """
    tagger = tagger or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
        for rows, _, base, more in _found(tagger, batches):
            out = {"doc_id": rows.column(0)} | {f"n_{kind}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k, kind in enumerate(KINDS)}
            out["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base], pa.string())
            out["spans"] = pa.array([written(b + m) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first stands for all."""
    out, last = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if s >= last:
            out += [text[last:s], MASK[KINDS[kind]]]
        last = max(last, e)
    return "".join([*out, text[last:]])


def clean(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data masked; where ``n_chars`` exists it is counted anew for changed texts."""
    tagger = tagger or train(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, base, more in _found(tagger, batches):
            at = rows.schema.get_field_index("text")
            was = rows.column(at).to_pylist()
            new = [None if w is None else masked(t, b + m) if b or m else t for w, t, b, m in zip(was, texts, base, more, strict=True)]
            columns = list(rows.columns)
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if t == w else len(t) for n, t, w in zip(rows.column(k).to_pylist(), new, was, strict=True)], rows.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(docs, run, docs.schema)
