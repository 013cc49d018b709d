"""Language identification: a byte convolutional network trained in numpy, applied to fixed-length windows in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of a window; a multiple of every width.
WINDOW = 252
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 6
#: Bounds of the training data: labelled rows per language, windows from a row.
ROWS_PER_LANGUAGE = 1200
WINDOWS_PER_ROW = 2
#: Windows that are convolved at once (about 1.5 MB of sums, so that they stay in a core's cache).
BLOCK = 32

_LETTER = regex.compile(r"\p{L}")


def windows_of(data: bytes) -> np.ndarray:
    """All bytes of a (lower-cased) text as rows of WINDOW bytes, the last padded with zeros."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, WINDOW)


class ByteConvNet:
    """Byte embeddings, filters of several widths, max pooling over a window, softmax over the languages."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Maximum of each filter over each window, and with ``places`` where it is."""
        p, n = self.p, len(windows)
        flat = p["embed"][windows].reshape(-1)
        tops, at = [], []
        for w in WIDTHS:
            best, where = None, None
            for phase in range(w):  # every w-th start at once: the rows are the flat embeddings themselves
                rows = (n * WINDOW - phase) // w
                part = flat[phase * EMBED : (phase + rows * w) * EMBED].reshape(rows, w * EMBED) @ p[f"w{w}"]
                if phase:  # the last start of a window would reach into the next one
                    part = np.concatenate([part, part[:1]])[: n * WINDOW // w] if rows < n * WINDOW // w else part
                    part = part.reshape(n, WINDOW // w, FILTERS)[:, :-1]
                else:
                    part = part.reshape(n, WINDOW // w, FILTERS)
                top = part.max(axis=1)
                if places:
                    place = part.argmax(axis=1) * w + phase
                    where = place if where is None else np.where(top > best, place, where)
                best = top if best is None else np.maximum(best, top)
            tops.append(np.maximum(best + p[f"b{w}"], 0))
            at.append(where)
        return (np.concatenate(tops, axis=1), at) if places else np.concatenate(tops, axis=1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters applied to all byte pairs: first two bytes of every width, third of width 3, last two of width 4."""
        p = self.p
        tap = {(w, k): p["embed"] @ p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for w in WIDTHS for k in range(w)}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, FILTERS)
        first = np.concatenate([pair(tap[w, 0] + p[f"b{w}"], tap[w, 1]) for w in WIDTHS], axis=1)
        return first, np.ascontiguousarray(tap[3, 2]), pair(tap[4, 2], tap[4, 3])

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        """The same network, its convolutions looked up: a filter's sum over two bytes is one row of a table."""
        first, third, last = tables
        tops = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        for i in range(0, len(windows), BLOCK):
            w = windows[i : i + BLOCK]
            pairs = (w[:, :-1].astype(np.int64) << 8) | w[:, 1:]
            sums = first[pairs]
            sums[:, :-1, FILTERS : 2 * FILTERS] += third[w[:, 2:]]
            sums[:, :-2, 2 * FILTERS :] += last[pairs[:, 2:]]
            sums[:, -1, FILTERS:] = 0  # no start here: the filter would reach beyond the window
            sums[:, -2, 2 * FILTERS :] = 0
            tops[i : i + BLOCK] = sums.max(axis=1)
        return softmax(np.maximum(tops, 0) @ self.p["out"] + self.p["bias"])

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 0) -> ByteConvNet:
        """Adam on the cross-entropy, classes weighted equally; gradients flow through the places of the maxima only."""
        rng = np.random.default_rng(seed)
        weight = len(labels) / (len(self.languages) * np.maximum(1, np.bincount(labels, minlength=len(self.languages))))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                pick, step = order[i : i + batch], step + 1
                grads = self._gradients(windows[pick], labels[pick], weight[labels[pick]])
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, windows, labels, weight):
        p, n = self.p, len(windows)
        pooled, at = self.pooled(windows, places=True)
        d = softmax(pooled @ p["out"] + p["bias"])
        d[np.arange(n), labels] -= 1
        d *= (weight / n)[:, None].astype(np.float32)
        grads = {"out": pooled.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (d @ p["out"].T) * (pooled > 0)
        for j, w in enumerate(WIDTHS):
            g = back[:, j * FILTERS : (j + 1) * FILTERS]
            taken = windows[np.arange(n)[:, None, None], at[j][:, :, None] + np.arange(w)]  # windows, filters, bytes
            grads[f"w{w}"] = np.einsum("nf,nfk->kf", g, p["embed"][taken].reshape(n, FILTERS, w * EMBED))
            grads[f"b{w}"] = g.sum(axis=0)
            towards = (g[:, :, None] * p[f"w{w}"].T[None]).reshape(-1, EMBED)
            np.add.at(grads["embed"], taken.reshape(-1), towards)
        return grads


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _training_windows(rows: DataFrame, per_row: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, langs = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = windows_of(text.lower().encode())
                for i in {(2 * k + 1) * len(found) // (2 * per_row) for k in range(per_row)} if len(found) else ():
                    out.append(found[i].tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], names=["bytes", "lang"])

    return rows.mapInArrow(run, "bytes binary, lang string")


def train(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE, per_row: int = WINDOWS_PER_ROW, seed: int = 0) -> ByteConvNet | None:
    """Fit a network to (text, lang) rows; null and letterless ones are left out. None if no row is left.

    The sample is bounded: about ``rows`` rows for each language, chosen by a digest of the text, and ``per_row``
    windows spread over each text; the driver receives only the windows.
    """
    known = labelled.where("text is not null and lang is not null and text rlike '\\\\p{L}'").select("text", "lang")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(seed)), 11) / float(1 << 53)
    sample = known.join(F.broadcast(counts), "lang").where(draw < rows / F.col("n")).select("text", "lang")
    got = _training_windows(sample, per_row).collect()
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    order = sorted(range(len(got)), key=lambda i: (bytes(got[i]["bytes"]), got[i]["lang"]))  # same model at each run
    windows = np.frombuffer(b"".join(bytes(got[i]["bytes"]) for i in order), np.uint8).reshape(-1, WINDOW)
    labels = np.array([languages.index(got[i]["lang"]) for i in order])
    short = windows.copy()  # each window once more as a short text
    short[np.arange(WINDOW) >= np.random.default_rng(seed).integers(16, 120, len(short))[:, None]] = 0
    windows, labels = np.concatenate([windows, short]), np.concatenate([labels, labels])
    return ByteConvNet(languages, seed).fit(windows, labels, seed=seed)


def predict(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score; one row per row of ``docs``, other columns not read.

    All windows of a text are classified; their probabilities are averaged by the bytes in them, the language with
    the largest mean wins and that mean is the score. ``und`` with score 0 if the text is null or has no letter, or if
    there is no model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            langs, scores = [], []
            pending: list[np.ndarray] = []
            size, spans = 0, []

            def flush():
                nonlocal size
                if not spans:
                    return
                probs = model.probabilities(np.concatenate(pending), tables)
                start = 0
                for at, count, last in spans:
                    part = probs[start : start + count]
                    weight = np.full(count, WINDOW, np.float64)
                    weight[-1] = last
                    mean = weight @ part / weight.sum()
                    best = int(mean.argmax())
                    langs[at], scores[at] = model.languages[best], float(min(1.0, mean[best]))
                    start += count
                pending.clear()
                spans.clear()
                size = 0

            for at, value in enumerate(batch.column(1)):
                text = value.as_py()
                langs.append("und")
                scores.append(0.0)
                if model is None or not text or not _LETTER.search(text):
                    continue
                data = text.lower().encode()
                found = windows_of(data)
                pending.append(found)
                spans.append((at, len(found), len(data) - (len(found) - 1) * WINDOW))
                size += len(found)
                if size >= 64 * BLOCK:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, parts: int = 3, held_out: int = 1) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and predict every row: doc_id, held_out, lang_pred, score.

    A row without id is in no fold: it isn't learned from and counts as held out.
    """
    out = F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(True))
    model = train(docs.where(~out).select("text", "lang"))
    return predict(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")
