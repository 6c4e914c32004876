"""Operator 1: document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import text_slices

#: Bytes of text whose lines are handled at a time.
CHUNK_BYTES = 1 << 20
#: Documents of each label that a model is fitted on, at most.
FIT_DOCS = 1_500
#: Longer texts are left out of the fitting sample, which bounds what the driver gets to 2 * FIT_DOCS * FIT_BYTES.
FIT_BYTES = 20_000

_KINDS = np.full(256, 7, np.uint8)
for _kind, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b".,;:'\"()-?", b"!", b"|"]):
    _KINDS[list(_chars)] = _kind
_KINDS[128:] = 8
_N_KINDS = 9
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
BASE = 18
#: Own features, those of the line before and of the line after, no line before, no line after, constant.
WIDTH = 3 * BASE + 3


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH), lengths in bytes, and for each line the index of its text. Every text has a line at least."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]) - 1, ends)
    line = np.repeat(np.arange(len(ends), dtype=np.int64), size + 1)
    kinds = np.bincount(line * _N_KINDS + _KINDS[data], minlength=len(ends) * _N_KINDS).reshape(-1, _N_KINDS).astype(float)
    kinds[:, 7] -= 1  # the line's own end
    share = kinds / np.maximum(size, 1)[:, None]

    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    words, repeats, letters = np.zeros(len(ends)), np.zeros(len(ends)), np.zeros(len(ends))
    if len(begins):
        of = np.cumsum(~space & np.concatenate([[True], space[:-1]])) - 1
        at = np.where(space, 0, _POWERS[(np.arange(len(data)) - begins[np.maximum(of, 0)]) & 63] * (data.astype(np.uint64) + np.uint64(1)))
        code = np.add.reduceat(at, begins)
        own = line[begins]
        words = np.bincount(own, minlength=len(ends)).astype(float)
        same = (code[1:] == code[:-1]) & (own[1:] == own[:-1])
        repeats = np.bincount(own[1:][same], minlength=len(ends)).astype(float)
        letters = np.bincount(line[~space], minlength=len(ends)).astype(float)
    case = kinds[:, 0] / np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)], 10)
    base = np.column_stack(
        [share, np.minimum(1, 10 * share[:, 5:8]), np.log1p(size) / 6, np.minimum(3, letters / np.maximum(words, 1) / 6),
         repeats / np.maximum(words, 1), case, np.isin(last, list(b".?!")), size == 0]
    )
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    final = np.concatenate([doc[1:] != doc[:-1], [True]])
    before = np.where(first[:, None], 0, np.roll(base, 1, axis=0))
    after = np.where(final[:, None], 0, np.roll(base, -1, axis=0))
    return np.column_stack([base, before, after, first, final, np.ones(len(ends))]), size, doc


@dataclass
class Model:
    weights: np.ndarray  # score of label good over bad, by feature
    moves: np.ndarray  # 2 x 2: log-potential of a label after another


def _scan(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each line the product of its chain's 2 x 2 matrices up to it, each scaled; log2(longest chain) rounds for all chains at once."""
    out = m.copy()
    at = np.arange(len(m)) - np.maximum.accumulate(np.where(first, np.arange(len(m)), 0))  # place within the chain
    step = 1
    while step <= at.max(initial=0):
        i = np.flatnonzero(at >= step)
        new = np.matmul(out[i - step], out[i])
        out[i] = new / new.sum(axis=(1, 2), keepdims=True)
        step *= 2
    return out


def marginals(model: Model, x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By forward-backward: P(good) of each line, and P(labels of the line before, of the line), zero for first lines."""
    u = np.clip(x @ model.weights, -30, 30)
    emit = np.stack([1 / (1 + np.exp(u)), 1 / (1 + np.exp(-u))], axis=1)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    step = np.exp(model.moves)[None] * emit[:, None, :]
    begin = np.repeat(emit[:, None, :], 2, axis=1)
    alpha = _scan(np.where(first[:, None, None], begin, step), first)[:, 0]
    final = np.roll(first, -1)
    after = np.where(final[:, None, None], np.eye(2), np.roll(step, -1, axis=0))
    back = _scan(after[::-1].transpose(0, 2, 1), final[::-1])[::-1].transpose(0, 2, 1)
    beta = back.sum(axis=2)
    both = alpha * beta
    pair = np.roll(alpha, 1, axis=0)[:, :, None] * step * beta[:, None, :]
    pair = np.where(first[:, None, None], 0, pair / pair.sum(axis=(1, 2), keepdims=True))
    return both[:, 1] / both.sum(axis=1), pair


def fit(x: np.ndarray, doc: np.ndarray, good: np.ndarray, rounds: int = 250, rate: float = 0.08, decay: float = 2e-3) -> Model:
    """Maximise the chains' conditional likelihood, each line bearing its document's label, by Adam; the same each time."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    mean, std = np.where(std > 0, mean, 0), np.where(std > 0, std, 1)  # constants stay as they are
    z = (x - mean) / std
    n = len(x)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    seen = np.zeros((2, 2))
    np.add.at(seen, (np.roll(good, 1)[~first].astype(int), good[~first].astype(int)), 1)
    for k in range(1, rounds + 1):
        p, pair = marginals(Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2)), z, doc)
        g = np.concatenate([z.T @ (good - p), (seen - pair.sum(axis=0)).ravel()]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights = theta[:WIDTH] / std
    weights[-1] -= weights[:-1] @ mean[:-1]  # the last feature is the constant, which isn't standardised
    return Model(weights, theta[WIDTH:].reshape(2, 2))


def text_scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """P(good) of each text: its lines' marginals weighted by their length plus one."""
    out = np.zeros(len(texts))
    for a, b in _chunks(texts):
        x, size, doc = line_features(texts[a:b])
        p, _ = marginals(model, x, doc)
        w = size + 1.0
        out[a:b] = np.bincount(doc, w * p, minlength=b - a) / np.bincount(doc, w, minlength=b - a)
    return np.clip(out, 0.0, 1.0)


def _bytes(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def fit_documents(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on up to FIT_DOCS documents of each label, taken by a hash of the key from those labelled rows for which
    `usable` holds; a document with several labels counts as good if all say so. Without any the model is
    indifferent (score 0.5)."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(F.col(key).alias("__k")).agg(F.min(label).alias("__good"))
    texts = docs.select(F.col(key).alias("__k"), F.coalesce(text, F.lit("")).alias("__t")).where(F.octet_length("__t") <= FIT_BYTES)
    rows = texts.join(known, "__k")
    order = F.xxhash64("__k", F.lit("fit"))
    sample = []
    for good in (True, False):
        mine = rows.where((F.col("__good") >= 1) == good).select("__k", order.alias("__o"))
        few = mine.orderBy("__o", "__k").limit(FIT_DOCS)
        got = texts.join(F.broadcast(few.select("__k").distinct()), "__k", "left_semi")
        sample += [(r[0], r[1], good) for r in got.select("__k", "__t").orderBy(order, "__k", "__t").limit(FIT_DOCS).collect()]
    if not sample:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)))
    texts, good = _bytes(t for _, t, _ in sample), np.array([g for _, _, g in sample], float)
    parts = [(a, *line_features(texts[a:b])) for a, b in _chunks(texts)]
    doc = np.concatenate([a + d for a, _, _, d in parts])
    return fit(np.concatenate([x for _, x, _, _ in parts]), doc, good[doc])


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out` (replaced if there already): the quality of each whole text, 0 to 1. Null texts score as empty ones,
    equal texts score alike, an empty table stays empty; no other column is looked at."""
    cols = [c for c in docs.columns if c != out]
    schema = docs.select(*cols).schema.add(out, "double")

    def run(batches):
        for b in batches:
            parts = text_slices(b.column(b.schema.get_field_index(text)), CHUNK_BYTES)
            score = pa.array(np.concatenate([text_scores(model, texts) for _, texts in parts] or [[]]), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, score], [*b.schema.names, out])

    return docs.select(*cols).mapInArrow(run, schema)


def hash_mod(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod (null: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs with score, held_out (crc32 of doc_id mod 4 is 2: never fitted on) and predicted (1: score >= threshold).

    Columns of these names are replaced. The model is fitted on labelled rows that are not held out, see fit_documents.
    """
    model = fit_documents(docs, labels, hash_mod("doc_id", 4) != 2)
    scored = score_documents(docs, model)
    return scored.withColumns({"held_out": hash_mod("doc_id", 4) == 2, "predicted": (F.col("score") >= threshold).cast("int")})
