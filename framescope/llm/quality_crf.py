"""Quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features are its own shape
(length, letter case, signs, repeats; ``NAMES``), the same of the line before
and after, and how much of the text repeats; a 2 x 2 table ties neighbouring
labels. Training maximises the conditional likelihood with every line carrying
its document's label; the gradient comes from forward-backward. A document's
quality is the length-weighted mean of its lines' marginals, calibrated by a
logistic curve fitted on the training documents.

The model is fitted on the driver from at most ``TRAIN_DOCS`` labelled
documents (least hash first) of at most ``TRAIN_BYTES`` bytes each; scoring covers every whole
text, in tasks, with no exchange.

Defined cases: NULL or empty text is one empty line. NULL ``doc_id`` is scored
and ``held_out`` is NULL. Without labels of both kinds every score is the share
of good labels (0.5 if there are none). Extra columns are ignored; ids, labels,
language and source are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framescope.llm import common as C

TRAIN_DOCS, TRAIN_BYTES = 6000, 20_000
NAMES = ["one", "length", "upper", "digit", "bang", "pipe", "sign", "other_mark", "not_ascii", "space", "word_length", "same_as_last", "repeated_words", "repeated_line", "ends"]
_KIND = np.zeros(256, np.uint8)  # 0 lower case and the rest
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[33] = 3
_KIND[124] = 4
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]_=+/\\"]] = 5
_KIND[[ord(c) for c in "\"'(),-.:;?`"]] = 6
_KIND[128:] = 7
_KIND[[9, 32, 11, 12, 13]] = 8


class Lines:
    """Features of the lines of a chunk of texts: ``x`` (lines x 3 * names + 2), ``size`` in bytes, ``off`` lines of each text."""

    def __init__(self, texts: list[bytes]):
        words = C.Words(texts)
        buf = words.buf
        ends = np.append(np.flatnonzero(buf == 10), len(buf))  # texts are joined by line ends
        starts = np.append(0, ends[:-1] + 1)
        n = len(ends)
        size = ends - starts
        self.size = size
        self.off = np.append(np.searchsorted(starts, words.row_start), n)
        line = np.repeat(np.arange(n), size)
        body = np.ones(len(buf), bool)
        body[ends[:-1]] = False
        count = np.bincount(line * 9 + _KIND[buf[body]], minlength=9 * n).reshape(n, 9)
        full = np.maximum(size, 1)
        owner = np.searchsorted(starts, words.start, side="right") - 1
        n_words = np.bincount(owner, minlength=n)
        some = np.maximum(n_words, 1)
        h = words.hash
        same = np.zeros(n)
        if len(h) > 1:
            same = np.bincount(owner[1:], weights=(h[1:] == h[:-1]) & (owner[1:] == owner[:-1]), minlength=n)

        def distinct(group, values, size):
            """Distinct values of each group."""
            by = np.lexsort((values, group))
            g, v = group[by], values[by]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
            return np.bincount(g[new], minlength=size)

        row = np.repeat(np.arange(len(texts)), np.diff(self.off))
        prefix = C.prefix_sums(buf.astype(np.uint64) + np.uint64(1), C.BYTE_BASE)
        line_hash = C.span_hash(prefix, starts, ends, C.BYTE_BASE)
        by = np.lexsort((line_hash, row))
        twin = np.zeros(n, bool)
        if n > 1:
            eq = (row[by][1:] == row[by][:-1]) & (line_hash[by][1:] == line_hash[by][:-1])
            twin[by[1:]] |= eq
            twin[by[:-1]] |= eq
        last = buf[np.maximum(ends - 1, 0)] if len(buf) else np.zeros(n, np.uint8)
        own = np.stack(
            [
                np.ones(n), np.log1p(size) / 5, count[:, 1] / full, count[:, 2] / full, count[:, 3] / full, count[:, 4] / full, count[:, 5] / full, count[:, 6] / full,
                count[:, 7] / full, count[:, 8] / full, np.minimum((size - count[:, 8]) / some, 30) / 10, same / some, 1 - distinct(owner, h, n) / some, twin & (size > 0),
                np.isin(last, [33, 46, 63]) & (size > 0),
            ], 1,
        )
        before, after = np.zeros_like(own), np.zeros_like(own)
        inner = row[1:] == row[:-1]
        before[1:][inner], after[:-1][inner] = own[:-1][inner], own[1:][inner]
        # of the whole text: how much its words and lines repeat
        t_words = np.maximum(np.diff(words.ptr), 1)
        repeats = 1 - distinct(words.row, h, len(texts)) / t_words
        first = np.minimum(self.off[:-1], n - 1)
        twins = np.add.reduceat((twin * size).astype(float), first) / np.maximum(np.add.reduceat(size, first), 1)
        self.x = np.concatenate([own, before, after, repeats[row][:, None], twins[row][:, None]], 1)


def _chunked(texts: list[bytes]) -> Lines:
    """Features of many texts, made chunk by chunk so that the byte arrays stay small."""
    parts = [Lines(texts[lo:hi]) for lo, hi in C.chunks(texts, C.CHUNK_BYTES >> 2)]
    out = parts[0]
    ends = np.cumsum([p.off[-1] for p in parts])
    out.off = np.concatenate([parts[0].off, *(p.off[1:] + e for p, e in zip(parts[1:], ends, strict=False))])
    out.x, out.size = np.concatenate([p.x for p in parts]), np.concatenate([p.size for p in parts])
    return out


def _marginals(score: np.ndarray, off: np.ndarray, ties: np.ndarray, pairs: bool = False):
    """Forward-backward for all chains at once, the longest first so that a step covers those still running.

    ``score`` (lines x 2). Returns the marginals, and if asked the expected
    label pairs (2 x 2) summed over all neighbours.
    """
    n = np.diff(off)
    by = np.argsort(-n, kind="stable")
    start, n = off[:-1][by], n[by]
    e = np.exp(score - score.max(1, keepdims=True))
    t = np.exp(ties - ties.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    steps = int(n[0]) if len(n) else 0
    alive = [int(np.searchsorted(-n, -k, side="left")) for k in range(steps + 1)]  # chains longer than k
    for k in range(steps):
        at = start[: alive[k]] + k
        a = e[at] if not k else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for k in range(steps - 1, 0, -1):
        at = start[: alive[k]] + k
        b = (e[at] * beta[at]) @ t.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    out = alpha * beta
    out /= out.sum(1, keepdims=True)
    if not pairs:
        return out
    inner = np.ones(len(e), bool)
    inner[off[:-1]] = False
    at = np.flatnonzero(inner)
    p = alpha[at - 1][:, :, None] * t[None] * (e[at] * beta[at])[:, None, :]
    return out, (p / p.sum((1, 2), keepdims=True)).sum(0)


def _quality(lines: Lines, model: dict) -> np.ndarray:
    """Length-weighted mean marginal of the good label, per text."""
    weight = lines.x @ model["w"]
    p = _marginals(np.stack([np.zeros(len(weight)), weight], 1), lines.off, model["ties"])[:, 1]
    first = lines.off[:-1]
    size = lines.size + 1.0
    return np.add.reduceat(p * size, first) / np.add.reduceat(size, first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 150) -> dict:
    """Weights, tie table and calibration; Adam on the mean conditional log-likelihood, documents weighing alike."""
    good = float(np.mean(labels)) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return {"share": good}
    lines = _chunked(texts)
    n = np.diff(lines.off)
    y = np.repeat(labels, n).astype(float)
    each = np.repeat(1.0 / n, n)
    inner = np.ones(len(y), bool)
    inner[lines.off[:-1]] = False
    theta = np.zeros(lines.x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (inner & (y == 0)).sum(), (inner & (y == 1)).sum()
    for k in range(1, rounds + 1):
        w, ties = theta[:-4], theta[-4:].reshape(2, 2)
        z = lines.x @ w
        p, expected = _marginals(np.stack([np.zeros(len(z)), z], 1), lines.off, ties, pairs=True)
        grad = np.concatenate([lines.x.T @ ((y - p[:, 1]) * each) / len(n) - 1e-5 * w, ((seen - expected) / max(1, inner.sum())).ravel() * 0.1 - 1e-2 * theta[-4:]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = {"w": theta[:-4], "ties": theta[-4:].reshape(2, 2)}
    s = _logit(_quality(lines, model))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g, h = np.array([((labels - p) * s).sum() - 1e-3 * a, (labels - p).sum()]), p * (1 - p) + 1e-9
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
    return model | {"a": float(a), "b": float(b), "share": good}


def score_texts(texts: list[bytes], model: dict) -> np.ndarray:
    if "w" not in model:
        return np.full(len(texts), model["share"])
    out = np.empty(len(texts))
    for lo, hi in C.chunks(texts):
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(model["a"] * _logit(_quality(Lines(texts[lo:hi]), model)) + model["b"], -30, 30)))
    return out


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """Fit on labelled documents (``labels(doc_id, label)``, label 0 or 1) outside the held-out fifth."""
    known = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "label").limit(train_docs)  # bounds what is sent to the tasks and back
    rows = C.keyed(docs).where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")
    got = sorted((r["doc_id"], r["text"], r["label"]) for r in rows.limit(2 * train_docs).collect())
    return fit([t.encode() for _, t, _ in got], np.array([y for _, _, y in got], float))


def quality_crf(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` (0 to 1, higher is better) and ``predicted`` added (replacing columns of these names)."""
    C.shared_dir(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    kept = docs.select(*rest)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(C.text_bytes(batch.column(batch.schema.get_field_index("text"))), model))], names=[*batch.schema.names, "score"])

    scored = kept.mapInArrow(C.task(rows), schema)
    held = (F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0).alias("held_out")
    return scored.select(*rest, held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
