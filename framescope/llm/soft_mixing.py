"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document its domain
posteriors p; with t tokens, a document of rate r adds r * t * p expected tokens
to the domains. Rates are nonnegative and solve the least-squares problem
``min |G^-1/2 (sum r t p - b)|`` for the targets b and G = sum t p p'. Scaled by
1 / t, the projected gradient of a document is r - max(floor, r - p . g) with one
vector g = G^-1 (total - b) for all. With a term of ``RIDGE`` for the distance
from rate 1, which takes the nearest of many solutions, rates are those of one
vector too, r = max(floor, 1 - p . v), and the gradient is 0 where
``sum r t p = b + RIDGE G v``. Newton steps find v: a round is one pass that sums
the totals, and the Gram matrix of the documents above the floor, for several
lengths of the step at once, with map-side combine. No state is kept between
passes and a lost executor costs nothing. Rounds go on until that equation holds
to ``TOLERANCE`` of the targets; if ``rounds`` passes are not enough, it raises.
Targets that no rates reach are met as nearly as they can be, with a warning.

Rates become whole copies: the integer part, and one more by a hash of the
document against the rest. Targets are scaled so that the domain furthest above
its weight keeps its tokens: with ``floor`` 1 rates start at 1 and none falls
below, so documents are repeated and none is dropped.

Domains are all those of labelled documents with text. The classifier (softmax
over hashed byte pairs) is fitted on the driver from a sample by domain, about
``TRAIN_DOCS`` in their shares but ``LEAST`` of each domain if it has so many
(less where there are many domains), weighted back to the shares; of each text,
the first ``TRAIN_BYTES`` bytes count. All documents are scored whole. A target
weight for a domain without labelled text raises.

Defined cases: NULL or empty text has no tokens, rate 1 and one copy. Without labels there
is one domain. Repeated rows get equal rates; extra columns are kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C


TRAIN_DOCS, TRAIN_BYTES, BUCKETS, LEAST = 3000, 20_000, 4096, 100
RIDGE, TOLERANCE, ROUNDS = 1e-7, 1e-7, 100
#: lengths of a Newton step that a pass tries
_LENGTHS = [4.0**-j for j in range(14)]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Share of each hashed byte pair (letters in lower case) and the number of words, per text."""
    out, words = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        b = C._LOWER[np.frombuffer(t, np.uint8)].astype(np.int64) - 1
        if len(b) > 1:
            pair = (b[:-1] * 256 + b[1:]) * 40503 % 65536 % BUCKETS
            out[i] = np.bincount(pair, minlength=BUCKETS) / len(pair)
        space = C._SPACE[np.frombuffer(t, np.uint8)]
        words[i] = int((~space[1:] & space[:-1]).sum()) + int(len(space) > 0 and not space[0])
    return np.sqrt(out), words


def fit(texts: list[bytes], domains: list[str], counts: dict[str, int] | None = None, rounds: int = 120) -> dict:
    """Softmax weights by gradient descent with momentum; ``counts``: how many documents each domain's texts stand for."""
    names = sorted(set(domains))
    if len(names) < 2:
        return {"names": names or ["all"], "w": None}
    x, _ = features(texts)
    had = {n: domains.count(n) for n in names}
    of = np.array([(counts or had)[d] / had[d] for d in domains])
    of = (of / of.sum())[:, None]
    y = np.eye(len(names))[[names.index(d) for d in domains]]
    w, b = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        mw, mb = 0.9 * mw + x.T @ (of * (y - p)) - 1e-5 * w, 0.9 * mb + (of * (y - p)).sum(0)
        w, b = w + 2.0 * mw, b + 0.5 * mb
    return {"names": names, "w": w.astype(np.float32), "b": b.astype(np.float32)}


def train(docs: DataFrame, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """Fit on ``labelled(doc_id, domain)``: of each domain, the rows of least hash."""
    known = labelled.where("doc_id is not null and domain is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain").cast("string").alias("domain"))
    rows = C.keyed(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    known = C.written(known.distinct().join(rows.select("doc_id").distinct(), "doc_id"), "labelled")
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], [])
    least, total = min(LEAST, max(1, train_docs // len(counts))), sum(counts.values())
    size = {d: min(n, max(least, -(-train_docs * n // total))) for d, n in counts.items()}
    # rows below a hash that half as many again as wanted, and 50 more, are expected to pass; the least of them are taken
    hashed = F.pmod(F.xxhash64("doc_id", "domain"), F.lit(1 << 30))
    bound = docs.sparkSession.createDataFrame([(d, int(min(1.0, (1.5 * size[d] + 50) / n) * (1 << 30))) for d, n in counts.items()], "domain string, bound long")
    taken = known.join(F.broadcast(bound), "domain").where(hashed < F.col("bound")).select("doc_id", "domain", hashed.alias("h"))
    taken = rows.join(F.broadcast(taken), "doc_id").groupBy("domain", "h", "doc_id").agg(F.min(F.substr("text", F.lit(1), F.lit(TRAIN_BYTES))).alias("text"))
    left, texts, domains = dict(size), [], []
    for r in sorted(taken.collect(), key=lambda r: (r["domain"], r["h"], r["doc_id"])):
        if left[r["domain"]] > 0:
            left[r["domain"]] -= 1
            texts.append(r["text"].encode()[:TRAIN_BYTES])
            domains.append(r["domain"])
    return fit(texts, domains, counts)


def _posteriors(model: dict):
    k = len(model["names"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            for lo in range(0, len(texts), 512):
                part = texts[lo : lo + 512]
                x, words = features(part)
                p = np.ones((len(part), k))
                if model["w"] is not None:
                    z = (x @ model["w"] + model["b"]).astype(np.float64)
                    p = np.exp(z - z.max(1, keepdims=True))
                p = np.round(p / p.sum(1, keepdims=True), 6)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 512), batch.column("th").slice(lo, 512), pa.array(words), lists], names=["doc_id", "th", "tokens", "posterior"])

    return rows


def fold(p: np.ndarray, steps: list[np.ndarray], floor: float) -> np.ndarray:
    """Rates after the rounds whose residuals (already times G^-1) are ``steps``, from rate 1."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(floor, r - p @ s)
    return r


def _gram(k: int):
    """Sums over a task: ``sum t p p'`` and ``sum t p``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * k)
        for batch in batches:
            p, t = batch.column("posterior").flatten().to_numpy().reshape(-1, k), batch.column("tokens").to_numpy().astype(float)
            total += np.append(((p * t[:, None]).T @ p).ravel(), t @ p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "x"])

    return rows


def _trials(vectors: list[np.ndarray], floor: float, k: int):
    """Sums over a task for each vector: the dual's part, ``sum r t p``, and ``sum t p p'`` of the documents above the floor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(vectors), 1 + k + k * k))
        for batch in batches:
            p, t = batch.column("posterior").flatten().to_numpy().reshape(-1, k), batch.column("tokens").to_numpy().astype(float)
            for out, v in zip(total, vectors, strict=True):
                u, r = p @ v, fold(p, [v], floor)
                above = 1 - u >= floor
                q = p[above]
                out[0] += t @ np.where(above, u * u / 2 - u, -floor * u - (1 - floor) ** 2 / 2)
                out[1 : k + 1] += (r * t) @ p
                out[k + 1 :] += ((q * t[above, None]).T @ q).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "x"])

    return rows


def solve(trial: Callable[[list[np.ndarray]], np.ndarray], gram: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Vector of the rates and their totals; ``trial`` has a row of sums (see ``_trials``) for each vector."""
    k = len(target)
    scale = max(1.0, np.abs(target).max())
    tried = [np.zeros(k)]
    for _ in range(rounds):
        got = trial(tried)
        value = [target @ v + RIDGE / 2 * v @ gram @ v + x[0] for v, x in zip(tried, got, strict=True)]
        best = int(np.argmin(value))
        v, total, above = tried[best], got[best, 1 : k + 1], got[best, k + 1 :].reshape(k, k)
        residual = target + RIDGE * gram @ v - total
        if np.abs(residual).max() <= tolerance * scale:
            return v, total
        step = np.linalg.lstsq(above + RIDGE * gram, residual, rcond=1e-14)[0]
        tried = [v - x * step for x in _LENGTHS]
    raise RuntimeError(f"rates not found in {rounds} rounds: totals still off by {np.abs(residual).max() / scale:.2g} of the largest target")


def soft_mixing(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | float = 0.5, rounds: int = ROUNDS, floor: float = 1.0, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, th, tokens, posterior, rate, copies`` per row of ``docs(doc_id, text)``.

    ``weights``: a target weight for each domain, or an exponent put on the
    domains' present shares (below 1: small domains gain). ``th`` is the hash of
    the text, which tells rows of one ``doc_id`` apart.
    """
    model = train(docs, labelled, train_docs)
    names, k = model["names"], len(model["names"])
    if isinstance(weights, dict) and (unknown := sorted(n for n, x in weights.items() if x > 0 and n not in names)):
        raise ValueError(f"domains with a target weight but no labelled text: {', '.join(unknown)}")
    base = C.written(C.keyed(docs).mapInArrow(C.task(_posteriors(model)), "doc_id long, th long, tokens long, posterior array<double>"), "posteriors")

    def summed(task, size):
        out = np.zeros(size)
        for r in base.mapInArrow(C.task(task), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r["at"]] = r["x"]
        return out

    gram, now = np.split(summed(_gram(k), (k + 1) * k), [k * k])
    share = now / max(now.sum(), 1e-300)
    want = np.array([weights.get(n, 0.0) for n in names]) if isinstance(weights, dict) else np.where(share > 0, np.maximum(share, 1e-12) ** weights, 0)
    want = want / max(want.sum(), 1e-300)
    some = want > 0
    target = want * float(np.max(now[some] / want[some])) if some.any() else now
    width = 1 + k + k * k
    vector, total = solve(lambda vs: summed(_trials(vs, floor, k), len(vs) * width).reshape(len(vs), width), gram.reshape(k, k), target, rounds)
    miss = np.abs(total / max(total.sum(), 1e-300) - target / max(target.sum(), 1e-300))
    if miss.max() > 0.01:
        warnings.warn(f"no rates reach the targets: the share of {names[int(miss.argmax())]} is off by {miss.max():.3f}", stacklevel=2)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            rate = np.round(np.where(batch.column("tokens").to_numpy() > 0, fold(p, [vector], floor), 1.0), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    out = base.mapInArrow(C.task(rated), "doc_id long, th long, tokens long, posterior array<double>, rate double")
    chance = F.pmod(F.xxhash64("doc_id", "th", F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    return out.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
