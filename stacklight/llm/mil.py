"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `passage_words` words. Every passage is encoded to fixed features (hashed byte pairs,
hashed words, and shares of character classes, repeats and word shapes) and by a learned layer. Gated attention
weighs the passages, and the weighted mean of their codes gives the document's score. Only document labels train it: which
passages matter is learned. The fit takes at most `max_docs` labelled documents, the least by a seeded hash of their id, and of a
long one `fit_passages` passages, evenly spread; every passage of every document is scored.

Cases: null, empty and word-less texts are one passage without words, and get a score like any; null ids or labels don't train;
an id labelled twice trains with its least label, rows of one id with one of their texts; labels without a document are passed over; without labels every score is 0.5; equal
rows get equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, mix64, text_bytes, word_hashes

PAIRS, WORDS, SHAPES = 256, 256, 18
FEATURES = PAIRS + WORDS + SHAPES
PASSAGE_WORDS, MAX_DOCS, FIT_PASSAGES = 128, 4000, 32
_b = np.arange(256)
#: Indicators of character classes, a row for each: upper, lower, digit, punctuation, blank, line break, other controls, non-ASCII.
CLASSES = np.stack([(_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122), (_b >= 48) & (_b <= 57), ((_b > 32) & (_b < 127)) & ~((_b >= 48) & (_b <= 57)) & ~((_b >= 65) & (_b <= 90)) & ~((_b >= 97) & (_b <= 122)), (_b == 32) | (_b == 9), (_b == 10) | (_b == 13), (_b < 9) | (_b == 127), _b >= 128]).astype(np.int64)
CLASS_OF = CLASSES.argmax(0)


def passages(text: bytes, passage_words: int = PASSAGE_WORDS) -> np.ndarray:
    """float32 features, a row for each passage of a text."""
    b = np.frombuffer(text, np.uint8)
    w = word_hashes(text)
    n = max(1, -(-len(w) // passage_words))
    out = np.zeros((n, FEATURES), np.float32)
    if not len(w):
        return out
    inside = ~SPACES[b]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    bounds = np.concatenate([[0], starts[passage_words::passage_words], [len(b)]])[: n + 1]
    bounds[-1] = len(b)
    of = np.repeat(np.arange(n), np.diff(bounds))
    size = np.maximum(np.diff(bounds), 1)[:, None]
    pair = (mix64(b[:-1].astype(np.uint64) << np.uint64(8) | b[1:]) & np.uint64(PAIRS - 1)).astype(np.int64)
    out[:, :PAIRS] = np.sqrt(np.bincount(of[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / size)
    word_of = np.arange(len(w)) // passage_words
    count = np.bincount(word_of, minlength=n)
    hashed = np.bincount(word_of * WORDS + (w >> np.uint64(40) & np.uint64(WORDS - 1)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, PAIRS : PAIRS + WORDS] = np.sqrt(hashed / count[:, None])
    classes = np.bincount(of * 8 + CLASS_OF[b], minlength=n * 8).reshape(n, 8)
    s = out[:, PAIRS + WORDS :]
    s[:, :8] = classes / size
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    lens = ends - starts + 1
    s[:, 8] = np.bincount(word_of, lens, n) / count / 10
    s[:, 9] = np.sqrt(np.maximum(np.bincount(word_of, lens.astype(float) ** 2, n) / count - (10 * s[:, 8]) ** 2, 0)) / 10
    key = np.sort((word_of.astype(np.uint64) << np.uint64(44)) | (w >> np.uint64(20)))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    s[:, 10] = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n) / count
    runs = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
    most = np.zeros(n)
    np.maximum.at(most, (key[new] >> np.uint64(44)).astype(np.int64), runs)
    s[:, 11] = most / count
    last, first = CLASS_OF[b[ends]], CLASS_OF[b[starts]]
    s[:, 12] = np.bincount(word_of, last == 3, n) / count
    s[:, 13] = np.bincount(word_of, first == 0, n) / count
    s[:, 14] = np.bincount(word_of, (last == 0) & (lens > 1), n) / count
    s[:, 15] = np.bincount(word_of, lens == 1, n) / count
    s[:, 16] = np.log1p(count) / 5
    s[:, 17] = np.log1p(len(w)) / 10
    return out


class Model:
    """Gated attention over encoded passages (numpy)."""

    def __init__(self, mean, scale, p):
        self.mean, self.scale, self.p = mean, scale, p

    @staticmethod
    def sums(x, bag, n):
        out = np.zeros((n, *x.shape[1:]), x.dtype)
        np.add.at(out, bag, x)
        return out

    def forward(self, x, bag, n):
        p = self.p
        h = np.tanh(((x - self.mean) * self.scale) @ p["w1"] + p["b1"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        top = np.full(n, -np.inf, e.dtype)
        np.maximum.at(top, bag, e)
        e = np.exp(e - top[bag])
        att = e / self.sums(e, bag, n)[bag]
        z = self.sums(att[:, None] * h, bag, n)
        return h, t, g, att, z, z @ p["c"] + p["d"]

    def scores(self, x, bag, n):
        return 1 / (1 + np.exp(-np.clip(self.forward(x, bag, n)[-1].astype(np.float64), -40, 40)))


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 25, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam on the cross-entropy of document labels."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    base = np.clip(labels.mean(), 0.02, 0.98)
    p = {"w1": draw(FEATURES, hidden), "b1": np.zeros(hidden, np.float32), "v": draw(hidden, gate), "u": draw(hidden, gate), "a": draw(gate), "c": draw(hidden), "d": np.float32(np.log(base / (1 - base)))}
    model = Model(every.mean(0), (1 / np.maximum(every.std(0), 1e-2)).astype(np.float32), p)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            x, n = np.concatenate([bags[i] for i in ids]), len(ids)
            bag = np.repeat(np.arange(n), [len(bags[i]) for i in ids])
            h, t, g, att, z, logit = model.forward(x, bag, n)
            dl = ((1 / (1 + np.exp(-logit)) - labels[ids]) / n).astype(np.float32)
            dz = dl[:, None] * p["c"]
            da = (dz[bag] * h).sum(1)
            de = att * (da - model.sums(att * da, bag, n)[bag])
            dtg = de[:, None] * p["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (att[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
            xs = (x - model.mean) * model.scale
            grads = {"w1": xs.T @ dh, "b1": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dl, "d": dl.sum()}
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, d in grads.items():
                if k not in ("b1", "d"):
                    d = d + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = (p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id"):
    """The fold that never trains: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_docs: int = MAX_DOCS, passage_words: int = PASSAGE_WORDS, fit_passages: int = FIT_PASSAGES, seed: int = 11) -> Model | None:
    """Trains on labels(doc_id, quality) outside the held-out fold; None without any."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_docs)
    quality = {r.doc_id: r.quality for r in chosen.collect()}  # at most max_docs rows
    if not quality:
        return None
    ids = docs.sparkSession.createDataFrame([(i,) for i in quality], "doc_id long")

    def encode(batches):
        for b in batches:
            x = [passages(t, passage_words) for t in b.column("text").to_pylist()]
            x = [v if len(v) <= fit_passages else v[np.linspace(0, len(v) - 1, fit_passages).astype(int)] for v in x]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["doc_id", "x"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text")).join(F.broadcast(ids), "doc_id")
    # one row of each id: at most max_docs texts, and max_docs * fit_passages rows of features on the driver
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = sorted((r.doc_id, bytes(r.x)) for r in sample.mapInArrow(encode, "doc_id long, x binary").collect())
    if not rows:
        return None
    bags = [np.frombuffer(x, np.float16).astype(np.float32).reshape(-1, FEATURES) for _, x in rows]
    return train(bags, np.array([quality[i] for i, _ in rows], np.float32), seed=seed)


def score(docs: DataFrame, model: Model | None, text: str = "text", passage_words: int = PASSAGE_WORDS, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default doc_id) and score (0 to 1) for each row of docs."""
    keep = keep or ["doc_id"]

    def run(batches):
        for b in batches:
            texts, got = b.column("text_bytes").to_pylist(), []
            for lo in range(0, len(texts), 128):
                x = [passages(t, passage_words).astype(np.float16).astype(np.float32) for t in texts[lo : lo + 128]]
                if model is None:
                    got.append(np.full(len(x), 0.5))
                else:
                    got.append(model.scores(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x]), len(x)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.concatenate(got) if got else [], pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*keep).alias("row"), text_bytes(text).alias("text_bytes"))
    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text)."""
    out = score(docs, fit(docs, labels, **options)).select(F.col("row.doc_id").cast("long").alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
