"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy by backpropagation through time. It reads the UTF-8 of a text in
windows; in each, one recurrent layer runs forwards and one backwards from a zero state, and a softmax on
both states labels every byte. A document's probabilities are the means over all its bytes, so every
byte of every text counts once and memory is bounded by a batch of windows. Gates and candidates use the
softsign x / (1 + |x|), which numpy evaluates several times faster than tanh.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batch_bytes, crc32_of, spread, table

WINDOW, HIDDEN, BATCH = 128, 8, 1024
#: Training rows for each language (those with the smallest hashes of their ids), bytes of each, and steps.
ROWS_EACH, ROW_BYTES, STEPS = 600, 4096, 260
#: Beyond so many languages each has fewer training rows, so that all of them still fit the driver.
LANGUAGES = 200
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign in place."""
    x /= np.abs(x) + np.float32(1)
    return x


@dataclass
class ByteGRU:
    """Weights: input tables E (2, 3H, 256), recurrent U (2, 3H, H), output V (2, K, H) and its bias (K, 1)."""

    labels: list[str]
    E: np.ndarray
    U: np.ndarray
    V: np.ndarray
    bias: np.ndarray

    def states(self, x: np.ndarray, live: np.ndarray, back: int, keep: bool = False):
        """States (T, H, B) of the layer that runs forwards (0) or backwards (1) over bytes x (T, B).

        ``live`` is False at padding, where the state is held at zero. With ``keep`` also what backpropagation needs.
        """
        steps, width = x.shape
        hidden = self.U.shape[2]
        out, past = np.empty((steps, hidden, width), np.float32), []
        h, padded = np.zeros((hidden, width), np.float32), not live.all()
        for t in range(steps - 1, -1, -1) if back else range(steps):
            a = np.take(self.E[back], x[t], axis=1)
            u = self.U[back] @ h
            gates = a[: 2 * hidden]
            gates += u[: 2 * hidden]
            _squash(gates)
            gates *= 0.5
            gates += 0.5
            candidate = a[2 * hidden :]
            candidate += gates[hidden:] * u[2 * hidden :]
            _squash(candidate)
            if keep:
                past.append((t, h, gates.copy(), candidate.copy(), u[2 * hidden :]))
            h = candidate + gates[:hidden] * (h - candidate)
            if padded:
                h *= live[t]
            out[t] = h
        return out, past

    def probabilities(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities (T, K, B) of the labels at every byte of windows x (T, B)."""
        z = self.V[0] @ self.states(x, live, 0)[0]
        z += self.V[1] @ self.states(x, live, 1)[0]
        z += self.bias
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over all bytes of windows x (T, B) with labels y (B,), and gradients by BPTT."""
        steps, width = x.shape
        live = np.ones((steps, width), bool)
        hidden = self.U.shape[2]
        runs = [self.states(x, live, d, keep=True) for d in (0, 1)]
        z = self.V[0] @ runs[0][0] + self.V[1] @ runs[1][0] + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        at = np.arange(width)
        loss = -np.log(np.maximum(p[:, y, at], 1e-12)).mean()
        p[:, y, at] -= 1
        p /= steps * width
        g = {"E": np.zeros_like(self.E), "U": np.zeros_like(self.U), "V": np.stack([np.einsum("tkb,thb->kh", p, r[0]) for r in runs]), "bias": p.sum((0, 2))[:, None]}
        for d, (_, past) in enumerate(runs):
            out = self.V[d].T @ p
            dh = np.zeros((hidden, width), np.float32)
            for t, before, gates, candidate, u in reversed(past):
                dh = dh + out[t]
                zg, r = gates[:hidden], gates[hidden:]
                # Softsign's slope at its value s is (1 - |s|) ** 2; a gate is (1 + s) / 2.
                dc = dh * (1 - zg) * (1 - np.abs(candidate)) ** 2
                dz = dh * (before - candidate) * 0.5 * (1 - np.abs(2 * zg - 1)) ** 2
                dr = dc * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                da = np.concatenate([dz, dr, dc])
                du = np.concatenate([dz, dr, dc * r])
                g["U"][d] += du @ before.T
                np.add.at(g["E"][d].T, x[t], da.T)
                dh = dh * zg + self.U[d].T @ du
        return loss, g


def fit(texts: list[bytes], labels: list[str], seed: int = 7, steps: int = STEPS, width: int = 192, span: int = 64) -> ByteGRU:
    """Train on random spans of the texts by Adam, as many of each label."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    by = [[np.frombuffer(t, np.uint8) for t, n in zip(texts, labels) if n == name and len(t) >= 8] for name in names]
    names, by = zip(*[(n, ts) for n, ts in zip(names, by) if ts]) if any(by) else ((), ())
    init = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
    model = ByteGRU(list(names), init(2, 3 * HIDDEN, 256), init(2, 3 * HIDDEN, HIDDEN), init(2, len(names), HIDDEN), np.zeros((len(names), 1), np.float32))
    if len(names) < 2:
        return model
    m = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in ("E", "U", "V", "bias")}
    for step in range(1, steps + 1):
        y = np.arange(width) % len(names)
        x = np.empty((span, width), np.uint8)
        for j, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            x[:, j] = np.resize(t[rng.integers(max(1, len(t) - span + 1)) :], span)
        _, g = model.gradients(x, y)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (a, b) in m.items():
            a += 0.1 * (g[k] - a)
            b += 0.01 * (g[k] ** 2 - b)
            setattr(model, k, (getattr(model, k) - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return model


def _windows(lengths: np.ndarray):
    """Document, start, length, and first byte that counts, of windows that cover all bytes once.

    The last window of a text reaches back to a whole one where it can; what it has seen before is only context.
    """
    many = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    nominal = k * WINDOW
    start = np.maximum(0, np.minimum(nominal, lengths[doc] - WINDOW))
    return doc, start, np.minimum(WINDOW, lengths[doc] - start), nominal - start


def document_probabilities(model: ByteGRU, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (documents, K) over all bytes; zeros for empty texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(model.labels)))
    if lengths.sum() == 0 or not model.labels:
        return total
    # A window's worth of padding lets every window be read whole.
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    offset = np.cumsum(lengths) - lengths
    doc, start, size, skip = _windows(lengths)
    order = np.argsort(size, kind="stable")
    span = np.arange(WINDOW)
    for low in range(0, len(order), BATCH):
        w = order[low : low + BATCH]
        longest = int(size[w].max())
        x = data[(offset[doc[w]] + start[w])[None, :] + span[:longest, None]]
        live = span[:longest, None] < size[w][None, :]
        p = model.probabilities(x, live)
        counted = live & (span[:longest, None] >= skip[w][None, :])
        pooled = np.einsum("tkb,tb->bk", p, counted.astype(np.float32)) if not counted.all() else p.sum(0).T
        np.add.at(total, doc[w], pooled)
    return total / np.maximum(lengths, 1)[:, None]


def label_positions(model: ByteGRU, text: str) -> list[str]:
    """The label of every byte of ``text``."""
    data = text.encode()
    out: list[str] = []
    for low in range(0, len(data), WINDOW):
        x = np.frombuffer(data[low : low + WINDOW], np.uint8)[:, None]
        out += [model.labels[k] for k in model.probabilities(x, np.ones(x.shape, bool)).argmax(1)[:, 0]]
    return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_each: int = ROWS_EACH) -> ByteGRU:
    """A network for the languages in ``lang_col``, learned from about ``rows_each`` rows of each (twice that on average at the very most) with non-null text and language.

    Every language that has rows is learned; beyond LANGUAGES of them each has a smaller share of the same number of rows (about one at least).
    A span of at most ROW_BYTES bytes, anywhere in the text by a hash, is read of each row, and ``fit`` takes STEPS steps.
    """
    rows = docs.select(F.xxhash64(id_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    rows_each = max(1, min(rows_each, rows_each * LANGUAGES // max(1, len(sizes))))
    # A threshold on the hash for each language keeps about rows_each of its rows, for a rare one all.
    below = [(lang, 2**63 - 1 if n <= rows_each else int(-(2**63) + rows_each / n * 2**64)) for lang, n in sizes]
    limits = docs.sparkSession.createDataFrame(below, "lang string, below bigint")
    size = F.octet_length("text")
    at = (1 + F.pmod(F.xxhash64("h", F.lit("span")), F.greatest(size - ROW_BYTES, F.lit(0)) + 1)).cast("int")
    chosen = rows.join(F.broadcast(limits), "lang").where("h <= below").select("lang", F.substring(F.col("text").cast("binary"), at, F.lit(ROW_BYTES)).alias("text"), "h")
    got = chosen.orderBy("h", "text").limit(2 * rows_each * max(1, len(sizes))).collect()
    return fit([bytes(r["text"]) for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, model: ByteGRU, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its mean probability; ``und`` and 0 for texts that are null or have no letter."""
    kind = "struct<lang: string, score: double>"
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf(kind)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = held.value
        for texts in batches:
            letters = np.array([isinstance(t, str) and _LETTER.search(t) is not None for t in texts], bool)
            p = document_probabilities(net, [t.encode() if ok else b"" for t, ok in zip(texts, letters)])
            if not net.labels:
                yield pd.DataFrame({"lang": [UNDETERMINED] * len(texts), "score": 0.0})
                continue
            best = p.argmax(1)
            yield pd.DataFrame({"lang": [net.labels[k] if ok else UNDETERMINED for k, ok in zip(best, letters)], "score": np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1).round(4), 0.0)})

    both = "_langid"
    while both in docs.columns:
        both += "_"
    return spread(docs).withColumn(both, labelled(F.col(text_col))).withColumns({lang: F.col(f"{both}.lang"), score: F.col(f"{both}.score")}).drop(both)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_of("doc_id") % 4 == 2
    model = learn(docs.where(~held_out | F.col("doc_id").isNull()))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
