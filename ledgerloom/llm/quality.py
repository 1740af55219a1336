"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text's terms are the trigrams of its bytes (letters as they are), the trigrams of its bytes' classes (letters of either case, digits,
white space, and each ASCII sign for itself), which tell its layout, and, for words, repetition of the word before;
counts are dampened and weighted by inverse document frequency.  A truncated SVD of
the labelled texts' vectors gives the latent space.  The labelled vectors are
broadcast; cosines of every document with all of them are blocked products, and the
``neighbours`` nearest vote with weights that grow with their cosine.

The labelled sample is bounded: ``per_label`` documents of each label by hash order
of the id.  Documents beyond it aren't learned from; all documents are scored.

Defined results: a null or empty text has no term and gets the labelled share of good
texts as its score; if nothing is labelled, every score is 0.5.  Labels that are null or not 0 or 1 are ignored, equal labels
of one document count once, and different ones both; of repeated rows of a labelled document the least text is learned from.  Neighbours
that tie with the last one vote too.  Texts of any length are scored whole, and repeated rows each.  Columns other than those
named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of
from .textkernels import word_hashes, word_spans


@dataclass(frozen=True)
class QualityConfig:
    per_label: int = 1500
    dims: int = 48
    neighbours: int = 25
    power: float = 8.0
    block: int = 512


def _classes() -> tuple[np.ndarray, int]:
    """lower-case and non-ASCII letters 0, capitals 1, digits 2, blanks 3, line ends 4, each sign its own, others last."""
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    codes = np.full(256, 5 + len(signs), np.uint8)
    codes[97:123] = codes[128:] = 0
    codes[65:91] = 1
    codes[48:58] = 2
    codes[[9, 32]] = 3
    codes[[10, 13]] = 4
    for k, b in enumerate(signs):
        codes[b] = 5 + k
    return codes, 6 + len(signs)


_CODES, _KINDS = _classes()
#: Trigrams of bytes and of classes fold into this many terms; the last two terms count words and repeated words.
LETTERS, LAYOUT = 4096, 2048
WORDS = LETTERS + LAYOUT
TERMS = WORDS + 2


def _folded(code: np.ndarray, kinds: int, terms: int) -> np.ndarray:
    three = (code[:-2] * kinds + code[1:-1]) * kinds + code[2:]
    return (three * 2654435761 >> 7) % terms


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x terms."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    letters, layout = _folded(data.astype(np.int64), 256, LETTERS), _folded(_CODES[data].astype(np.int64), _KINDS, LAYOUT)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a > 2:
            out[k, :LETTERS] = np.bincount(letters[a : b - 2], minlength=LETTERS)
            out[k, LETTERS:WORDS] = np.bincount(layout[a : b - 2], minlength=LAYOUT)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        np.cumsum(words[1:] == words[:-1], out=same[2:])
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        out[k, WORDS] = b - a
        out[k, WORDS + 1] = same[b] - same[a + 1] if b > a + 1 else 0
    return out


@dataclass
class QualityModel:
    weights: np.ndarray  # inverse document frequencies
    space: np.ndarray  # terms x dims
    vectors: np.ndarray  # labelled texts x dims, of length 1
    labels: np.ndarray
    prior: float
    config: QualityConfig

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.weights) @ self.space)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        own = self.latent(counts)
        cosine = own @ self.vectors.T
        k = min(self.config.neighbours, cosine.shape[1])
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
        weight = np.where(cosine >= least, np.maximum(cosine, 0), 0).astype(np.float64) ** self.config.power
        total = weight.sum(axis=1)
        voted = weight @ self.labels / np.maximum(total, 1e-300)
        return np.where((total > 1e-12) & (np.abs(own).sum(axis=1) > 0), np.clip(voted, 0, 1), self.prior)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shares of the text's terms, dampened, so that a text's length doesn't matter; a term stands out by its share."""
    size = np.maximum(counts[:, :LETTERS].sum(axis=1, keepdims=True), 1)
    share = counts / size
    share[:, WORDS + 1] = 5 * counts[:, WORDS + 1] / np.maximum(counts[:, WORDS], 1)
    share[:, WORDS] = 0
    return np.sqrt(share) * weights


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray, config: QualityConfig) -> QualityModel:
    if not len(counts):
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5, config)
    seen = (counts > 0).sum(axis=0)
    weights = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
    rows = _weighted(counts, weights)
    dims = min(config.dims, *rows.shape)
    # randomised SVD, two power rounds
    rng = np.random.default_rng(5)
    basis = rows @ rng.standard_normal((rows.shape[1], min(dims + 16, rows.shape[1]))).astype(np.float32)
    for _ in range(2):
        basis = rows @ (rows.T @ np.linalg.qr(basis)[0])
    _, _, right = np.linalg.svd(np.linalg.qr(basis)[0].T @ rows, full_matrices=False)
    model = QualityModel(weights, np.ascontiguousarray(right[:dims].T), np.zeros((0, dims), np.float32), labels.astype(np.float64), float(labels.mean()), config)
    model.vectors = model.latent(counts)
    return model


_COUNTS = "label int, terms array<int>, counts array<float>"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        counts = term_counts(data, offsets)
        at = [np.flatnonzero(c).astype(np.int32) for c in counts]
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("label")), pa.array(at, pa.list_(pa.int32())), pa.array([c[a] for c, a in zip(counts, at)], pa.list_(pa.float32()))], names=["label", "terms", "counts"])


def learn(docs: DataFrame, labels: DataFrame, config: QualityConfig | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model from at most ``per_label`` documents of each label; their term counts are collected, not their texts."""
    config = config or QualityConfig()
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null").distinct()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(order, "doc_id").limit(config.per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    # a row for each chosen id and label, 2 x per_label at most, however often the id is repeated
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = once.select("text", "label").mapInArrow(_sampled, _COUNTS).collect()
    found.sort(key=lambda r: (r["label"], r["terms"], r["counts"]))
    counts = np.zeros((len(found), TERMS), np.float32)
    for k, r in enumerate(found):
        counts[k, r["terms"]] = r["counts"]
    return fit(counts, np.array([r["label"] for r in found], np.float64), config)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for rows, data, offsets in slices(batches):
            found = []
            for a in range(0, len(offsets) - 1, model.config.block):
                own = offsets[a : a + model.config.block + 1]
                found.append(model.scores(term_counts(data[own[0] : own[-1]], own - own[0])))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.concatenate(found).astype(np.float64))], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")
