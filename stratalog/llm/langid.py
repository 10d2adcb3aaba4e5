"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL-proximal and elastic-net penalties, then temperature-calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, roomy, slices

ORDERS = (1, 2, 3)
BITS = 16
#: Labelled rows a language at most, for training and calibration together.
ROWS_PER_LANGUAGE = 400
MIN_CONFIDENCE = 0.5
SCALE = 30.0


def ngrams(texts: list[str], orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-grams of all texts in a row, and which of them lie within one text. Texts are lower-cased and end with a separator."""
    code = np.frombuffer("".join([t.lower() + "\0" for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")
    out, ends = [], code == 0
    h, bad = np.zeros(len(code), np.uint32), np.zeros(len(code), bool)
    for n in range(1, max(orders) + 1):
        tail, end = np.zeros(len(code), np.uint32), np.ones(len(code), bool)
        tail[: len(code) - n + 1], end[: len(code) - n + 1] = code[n - 1 :], ends[n - 1 :]
        h = (h ^ tail) * np.uint32(0x9E3779B1) + np.uint32(n)
        bad |= end
        if n in orders:
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits), ~bad))
    return out


def lengths(texts: list[str]) -> np.ndarray:
    """Code points of each lower-cased text and its separator."""
    return np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))


def features(text: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their share of the text's n-grams."""
    g = np.concatenate([h[ok] for h, ok in ngrams([text.replace("\0", " ")], orders, bits)])
    b, n = np.unique(g, return_counts=True)
    return b.astype(np.int32), (n / max(1, len(g))).astype(np.float32)


def document_frequency(docs: DataFrame, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(bucket, df) over all rows with a text; bucket -1 holds the number of rows. Summed in tasks first, so at most 2^bits rows leave one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(1 << bits, np.int64), 0, np.zeros(1 << bits, bool)
        for b in batches:
            for _, part in slices(b.column(0).drop_null(), 1_500_000):
                texts = [t.replace("\0", " ") for t in part.to_pylist()]
                ends = np.cumsum(lengths(texts))
                grams = [h for h, _ in ngrams(texts, orders, bits)]
                start = 0
                for k, end in enumerate(ends):
                    for o, g in zip(orders, grams):
                        if end - start - o > 0:
                            seen[g[start : end - o]] = True
                    hit = np.flatnonzero(seen)
                    df[hit] += 1
                    seen[hit] = False
                    start = end
                n += len(texts)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], names=["bucket", "df"])

    return docs.mapInArrow(lean(run), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, times IDF and SCALE
    bias: np.ndarray
    temperature: float
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS

    def __post_init__(self):
        self.columns = [np.append(w, 0.0) for w in self.weights.T.astype(np.float64)]

    def logits(self, texts: list[str]) -> np.ndarray:
        """Whole texts. Rows of texts without n-grams hold the bias."""
        texts = [t.replace("\0", " ") for t in texts]
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        size = lengths(texts)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        for o, (h, ok) in zip(self.orders, ngrams(texts, self.orders, self.bits)):
            h = np.where(ok, h, np.uint32(1 << self.bits))
            for c, w in enumerate(self.columns):
                total[:, c] += np.add.reduceat(w.take(h), starts)
            count += np.maximum(0, size - o)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, buckets: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the softmax, by follow-the-regularised-leader, one row at a time, rows shuffled in each epoch."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    order = np.random.default_rng(seed)

    def weight(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        free = at == buckets
        pen = np.where(free, 0.0, l1)[:, None]
        return np.where(np.abs(zz) <= pen, 0.0, -(zz - np.sign(zz) * pen) / ((beta + np.sqrt(n[at])) / alpha + np.where(free, 0.0, l2)[:, None]))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            b, x = rows[r]
            at, x = np.append(b, buckets), np.append(x, 1.0)[:, None]
            w = weight(at)
            s = (w * x).sum(0)
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weight(np.arange(buckets + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm.

    Targets are (n + 1) / (n + 2) for the right class of n rows and share the rest among the others, so that rows without
    an error don't call for certainty.
    """
    n, k = logits.shape if len(y) else (0, 0)
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), y] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        m = z.max(1)
        return float((m + np.log(np.exp(z - m[:, None]).sum(1)) - (z * target).sum(1)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, bits: int = BITS, orders: tuple[int, ...] = ORDERS, text_col: str = "text", label_col: str = "lang") -> Model:
    """Document frequencies come from all documents. Weights and temperature are fitted to at most rows_per_language labelled rows of each language, those of different texts with the smallest hashes: four in five for the weights, the fifth for the temperature. Rows without a label or words are no examples; copies of one text are one example; a language is any label; texts of any length are read whole; other columns don't matter; without examples the model has one language without a name."""
    src = roomy(docs.select(docs[text_col].alias("text"), docs[label_col].cast("string").alias("label")))
    df = document_frequency(src.select("text"), bits, orders).toPandas()
    idf = np.zeros(1 << bits)
    total = int(df.loc[df.bucket == -1, "df"].sum())
    known = df[df.bucket >= 0]
    idf[known.bucket.to_numpy()] = np.log((1 + total) / (1 + known.df.to_numpy())) + 1
    labelled = src.where("label IS NOT NULL AND length(trim(text)) > 0").withColumn("h", F.xxhash64("text"))
    # copies are one row, so that a hot text neither fills the sample nor keeps others out
    apart = cut(labelled.select("label", "h").distinct(), "labels")
    counts = {r["label"]: r["n"] for r in apart.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([""], np.zeros((1 << bits, 1), np.float32), np.zeros(1), 1.0, bits, orders)
    # at most twice what is wanted lies below a share of the hashes; the smallest of those are taken, or of all where too few do
    spread = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * rows_per_language + 50) / n))))
    drawn = apart.where(F.pmod("h", F.lit(1 << 30)) < spread[F.col("label")] * (1 << 30))
    few = [r["label"] for r in drawn.groupBy("label").agg(F.count("*").alias("n")).collect() if r["n"] >= min(rows_per_language, counts[r["label"]])]
    drawn = drawn.where(F.col("label").isin(few)).union(apart.where(~F.col("label").isin(few)))
    turn_ = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    wanted = drawn.withColumn("k", turn_).where(F.col("k") <= rows_per_language).select("label", "h")
    near = labelled.join(F.broadcast(wanted), ["label", "h"]).groupBy("label", "h").agg(F.any_value("text").alias("text")).select("label", "text", "h")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t, bits, orders) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[0] for x in f], pa.list_(pa.int32())), pa.array([x[1] for x in f], pa.list_(pa.float32()))], names=["label", "h", "b", "x"])

    got = near.mapInArrow(lean(turn), "label string, h long, b array<int>, x array<float>").toPandas().sort_values(["label", "h"])
    y = np.array([languages.index(x) for x in got.label])
    rows = [(np.asarray(b), np.asarray(x, np.float64) * idf[np.asarray(b)] * SCALE) for b, x in zip(got.b, got.x)]
    held = got.groupby("label").cumcount().to_numpy() % 5 == 4
    w, bias = ftrl([r for r, o in zip(rows, held) if not o], y[~held], len(languages), 1 << bits)
    z = np.array([(w[b] * x[:, None]).sum(0) + bias for (b, x), o in zip(rows, held) if o]).reshape(-1, len(languages))
    return Model(languages, (w * idf[:, None] * SCALE).astype(np.float32), bias, calibrate(z, y[held]), bits, orders)


def _judge(model: Model, col: pa.Array, min_confidence: float) -> tuple[list, list, list]:
    lang, conf, ok = [None] * len(col), [0.0] * len(col), [False] * len(col)
    for start, part in slices(col, 1_500_000):
        texts = part.to_pylist()
        at = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if not at:
            continue
        p = model.probabilities([texts[i] for i in at])
        for i, c, q in zip(at, p.argmax(1), p.max(1)):
            lang[start + i], conf[start + i], ok[start + i] = model.languages[c], float(q), bool(q >= min_confidence)
    return lang, conf, ok


def identify(docs: DataFrame, model: Model, min_confidence: float = MIN_CONFIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, confidence, accepted), a row for each input row.

    A NULL, empty or blank text has language NULL, confidence 0 and isn't accepted; otherwise accepted means a calibrated
    probability of at least min_confidence. Ties go to the language that sorts first. Ids may be NULL or repeat; other
    columns don't matter; whole texts are read; an empty table gives an empty result. The model (2^bits x languages
    floats, a size of its own) is broadcast. No shuffle, but of tables too small for the cores.
    """
    src = roomy(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, conf, ok = _judge(shared.value, b.column(1), min_confidence)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "language", "confidence", "accepted"])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, language string, confidence double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model, min_confidence: float = MIN_CONFIDENCE, text_col: str = "text") -> DataFrame:
    """The accepted rows, all columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_judge(shared.value, b.column(at), min_confidence)[2], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
