"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows.

Network: one-hot bytes of the lower-case text, filters of several widths, max pooling over the window, ReLU, linear
layer, softmax. It learns from a bounded sample of labelled rows (``SAMPLE`` windows, one of each sampled row, the same
share for each language, so that a rare one is learned however large the table is) and reads every window of every text.
A document's logits are the mean over its windows, each weighing as many bytes as it holds.

Edge cases: a text of any length is read whole, window by window; a null text or one without a letter (Unicode category L) is ``und`` with score 0; without any labelled
training row every text is ``und``; with more than ``SAMPLE`` languages the sample has one row of each; rows with a null
doc_id aren't learned from and aren't held out; repeated rows get equal predictions; the new columns replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import group_sample, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled rows to learn from, at most; the driver gets one window of each.
SAMPLE = 6000
STEPS, BATCH, RATE = 600, 64, 0.01
#: Windows in one numpy step.
STEP = 1024
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    """Whether any character is of category L; other numerals are none."""
    return any(map(str.isalpha, text))


def windows_of(text: bytes) -> np.ndarray:
    """The text's bytes as rows of ``WINDOW``, the last filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def training_sample(docs: DataFrame, limit: int = SAMPLE, seed: int = 3) -> tuple[np.ndarray, list[str]]:
    """About ``limit`` windows at most of labelled rows outside the held-out fold, as many of each language, chosen and
    placed by a hash."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.filter("text is not null")
    start = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)) + 1
    pieces = known.select(F.substring("text", start.cast("int"), F.lit(WINDOW)).alias("piece"), "lang", "doc_id")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    rows = group_sample(pieces, "doc_id", "lang", counts, max(1, limit // len(counts)), seed).collect()
    rows.sort(key=lambda r: (r["_hash"], r.doc_id, r.lang, r.piece))
    rows = [r for r in rows if has_letter(r.piece)]
    pieces = [windows_of(r.piece.lower().encode()[:WINDOW]) for r in rows]
    return (np.concatenate(pieces) if pieces else np.zeros((0, WINDOW), np.uint8)), [r.lang for r in rows]


class ByteNetwork:
    """filters[w]: (w, 256, FILTERS) weights on one-hot bytes; out: (features, classes)."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.filters = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(self.bias), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 9) -> None:
        rng, held = np.random.default_rng(seed), {}
        params = [*self.filters.values(), self.bias, self.out, self.out_bias]
        for n in range(1, STEPS + 1):
            at = rng.integers(0, len(x), BATCH)
            for k, (p, g) in enumerate(zip(params, self._gradients(x[at], y[at]), strict=True)):
                m, v = held.get(k, (np.zeros_like(p), np.zeros_like(p)))
                held[k] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                step = RATE * (1 - 0.9 * n / STEPS) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
                p -= (step * m / (np.sqrt(v) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, rows, places, pooled = len(x), np.arange(len(x))[:, None], [], []
        for w, f in self.filters.items():
            z = sum(f[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            at = z.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
        pre = np.concatenate(pooled, 1) + self.bias
        h = np.maximum(pre, 0)
        logits = h @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.out.T) * (pre > 0)
        grads, cols = [], np.arange(FILTERS)[None, :]
        for k, (w, f) in enumerate(self.filters.items()):
            g, d = np.zeros_like(f), dh[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[rows, places[k] + j], np.broadcast_to(cols, places[k].shape)), d)
            grads.append(g)
        return [*grads, dh.sum(0), h.T @ p, p.sum(0)]

    def reader(self) -> WindowReader:
        return WindowReader(self)


class WindowReader:
    """The network on many windows: two neighbouring bytes are one look-up in a table of 65,536 sums."""

    def __init__(self, net: ByteNetwork):
        self.net = net
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.parts = []
        for w, f in net.filters.items():
            of = [(j, pair(f[j], f[j + 1])) for j in range(0, w - 1, 2)]
            self.parts.append((w, of, f[w - 1] if w % 2 else None))

    def logits(self, x: np.ndarray) -> np.ndarray:
        pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        pooled = []
        for w, of, last in self.parts:
            n = WINDOW - w + 1
            z = None
            for j, t in of:
                part = np.take(t, pairs[:, j : j + n], axis=0)
                z = part if z is None else np.add(z, part, out=z)
            if last is not None:
                z += np.take(last, x[:, w - 1 : w - 1 + n], axis=0)
            while z.shape[1] > 1:
                half = z.shape[1] // 2
                top = np.maximum(z[:, :half], z[:, half : 2 * half])
                if z.shape[1] % 2:
                    np.maximum(top[:, 0], z[:, -1], out=top[:, 0])
                z = top
            pooled.append(z[:, 0])
        return np.maximum(np.concatenate(pooled, 1) + self.net.bias, 0) @ self.net.out + self.net.out_bias

    def documents(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Label and probability of each text."""
        windows = [windows_of(t) for t in texts]
        x = np.concatenate(windows)
        logits = np.concatenate([self.logits(x[lo : lo + STEP]) for lo in range(0, len(x), STEP)])
        counts = np.array([len(w) for w in windows])
        weight = np.full(len(x), float(WINDOW))
        ends = np.cumsum(counts)
        weight[ends - 1] = [max(1, len(t) - (len(w) - 1) * WINDOW) for t, w in zip(texts, windows, strict=True)]
        starts = ends - counts
        mean = np.add.reduceat(logits * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.net.classes[k] for k in best], [float(v) for v in p[np.arange(len(p)), best]]


def fit_network(docs: DataFrame, limit: int = SAMPLE) -> ByteNetwork | None:
    """None if there is no labelled row."""
    x, langs = training_sample(docs, limit)
    if not langs:
        return None
    net = ByteNetwork(sorted(set(langs)))
    net.train(x, np.array([net.classes.index(v) for v in langs]))
    return net


def identify_languages(
    docs: DataFrame, net: ByteNetwork | None, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns ``keep`` of each row, with prediction and score under ``names``; ``docs`` needs a ``text`` column."""
    keep = [c for c in keep if c not in names]
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = net.reader() if net else None
        for batch in batches:
            langs, scores, group, held, size = [], [], [], [], 0

            def flush(group: list[bytes], held: list[int], langs: list, scores: list) -> None:
                for k, name, p in zip(held, *reader.documents(group), strict=True):
                    langs[k], scores[k] = name, p

            for k, text in enumerate(batch.column("text")):
                t = text.as_py()
                langs.append(UNKNOWN)
                scores.append(0.0)
                if reader and t and has_letter(t):
                    group.append(t.lower().encode())
                    held.append(k)
                    size += len(group[-1])
                    if size >= STEP * WINDOW:
                        flush(group, held, langs, scores)
                        group, held, size = [], [], 0
            if group:
                flush(group, held, langs, scores)
            columns = [batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(predict, schema)


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``."""
    out = identify_languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_network(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(table(spark, sf_dir, "documents"))
