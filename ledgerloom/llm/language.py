"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (n = 1, 2, 3) that both
hold, whatever their number of occurrences (a blended-spectrum presence kernel),
divided by the root of the product of the texts' own numbers.  Bytes are
lower-cased and mapped to 64 codes: the ASCII letters, a break for white space, digits and signs,
and one code for each of the most frequent other bytes of the landmarks, so that
all n-grams have exact places in a presence vector.

Landmarks, a bounded sample of each language, span a Nyström space: with the
kernel matrix M among landmarks, a text's features are its kernel row times M^(-1/2).
One-versus-rest kernel ridge regression on those features gives a weight
vector for each language.  Texts are scored in batches: presence matrix times landmark
matrix, then times the weights.

Scores tell the learned languages apart, but are high for foreign texts too.  So ``keep_known`` also looks at the
share of a text's n-grams that no landmark holds.  The fitted texts, each held out of the landmarks,
say what share their language's own texts have: 99 % of them at most u.  A text may have the share whose odds are
``strange_odds`` times those of u (``strange_least`` at least), and two standard deviations of such a share more.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a
text that shares nothing with any landmark gets the regression's bias scores.  Of equal scores the language that comes first
by name wins.  Rows with a null language or id are never learned from; of repeated rows of an id and language the least text is, once.  Texts of any
length are scored whole, and repeated rows each.  If nothing can be learned from, everything is
``und``.  Columns other than those named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, slices, text_of

CODES = 64
_GRAMS = CODES + CODES**2 + CODES**3
_OTHER = CODES - 1


@dataclass(frozen=True)
class LanguageConfig:
    """Samples are by hash order of the id, ``fit`` texts of each language, the first ``landmarks`` of them as landmarks."""

    landmarks: int = 40
    fit: int = 250
    ridge: float = 1e-2
    batch: int = 256
    strange_odds: float = 3.0
    strange_least: float = 0.05


def _base_codes() -> np.ndarray:
    codes = np.zeros(256, np.uint8)  # 0: break
    for k in range(26):
        codes[97 + k] = codes[65 + k] = k + 1
    codes[128:] = _OTHER
    return codes


def raw_grams(data: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text's own bytes, n and bytes packed in one number."""
    c = data.astype(np.int64)
    parts = [np.unique(c) + (1 << 24)]
    if len(c) > 1:
        parts.append(np.unique(c[:-1] << 8 | c[1:]) + (2 << 24))
    if len(c) > 2:
        parts.append(np.unique(c[:-2] << 16 | c[1:-1] << 8 | c[2:]) + (3 << 24))
    return np.concatenate(parts) if len(c) else np.zeros(0, np.int64)


def coded(raw: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """What :func:`grams` gives for the text that ``raw`` is of."""
    n, c = raw >> 24, codes.astype(np.int64)
    low, mid, high = c[raw & 255], c[raw >> 8 & 255], c[raw >> 16 & 255]
    return np.unique(np.where(n == 1, low, np.where(n == 2, CODES + mid * CODES + low, CODES + CODES**2 + (high * CODES + mid) * CODES + low)))


def byte_codes(raws: list[np.ndarray]) -> np.ndarray:
    """A code for each byte; the non-ASCII bytes that most texts hold get their own."""
    codes = _base_codes()
    seen = np.zeros(256, np.int64)
    for raw in raws:
        seen[raw[raw >> 24 == 1] & 255] += 1
    high = 128 + np.argsort(-seen[128:], kind="stable")[: _OTHER - 27]
    high = high[seen[high] > 0]
    codes[high] = 27 + np.arange(len(high))
    return codes


def grams(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text, ascending."""
    c = codes[data].astype(np.int32)
    seen = np.zeros(_GRAMS, bool)
    seen[c] = True
    if len(c) > 1:
        two = c[:-1] * CODES + c[1:]
        seen[CODES + two] = True
        if len(c) > 2:
            seen[CODES + CODES**2 + two[:-1] * CODES + c[2:]] = True
    return np.flatnonzero(seen)


@dataclass
class LanguageModel:
    codes: np.ndarray
    places: np.ndarray  # n-gram -> column of the landmark matrix, -1: in no landmark
    landmarks: np.ndarray  # columns x landmarks, presence over the landmark's root
    weights: np.ndarray  # landmarks + 1 (bias) x languages
    languages: list[str]
    strange: np.ndarray  # languages: the share of n-grams in no landmark that a text may have

    def is_strange(self, sets: list[np.ndarray], language: np.ndarray) -> np.ndarray:
        """Whether a text has too many n-grams that no landmark holds for one of its language (a number)."""
        size = np.array([max(1, len(g)) for g in sets])
        share = np.array([(self.places[g] < 0).sum() for g in sets]) / size
        limit = self.strange[language]
        return share > limit + 2 * np.sqrt(limit * (1 - limit) / size)

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Texts x languages, from the texts' n-grams."""
        present = np.zeros((len(sets), self.landmarks.shape[0]), np.float32)
        root = np.ones(len(sets), np.float32)
        for k, g in enumerate(sets):
            root[k] = max(1, len(g)) ** 0.5
            at = self.places[g]
            present[k, at[at >= 0]] = 1
        kernel = (present @ self.landmarks) / root[:, None]
        return kernel @ self.weights[:-1] + self.weights[-1]


def fit(raws: list[np.ndarray], labels: list[str], is_landmark: list[bool], config: LanguageConfig) -> LanguageModel | None:
    languages = sorted(set(labels))
    chosen = [k for k, x in enumerate(is_landmark) if x]
    if not chosen:
        return None
    codes = byte_codes([raws[k] for k in chosen])
    every = [coded(raw, codes) for raw in raws]
    sets = [every[k] for k in chosen]
    columns = np.unique(np.concatenate(sets))
    places = np.full(_GRAMS, -1, np.int32)
    places[columns] = np.arange(len(columns))
    land = np.zeros((len(columns), len(chosen)), np.float32)
    for k, g in enumerate(sets):
        land[places[g], k] = len(g) ** -0.5
    # Nyström: features = kernel row x M^(-1/2); the weights on the features go back to weights on the kernel row
    value, vector = np.linalg.eigh((land.T @ land).astype(np.float64))
    value = np.maximum(value, 1e-8)
    root = vector @ np.diag(value**-0.5) @ vector.T
    bare = LanguageModel(codes, places, land, np.vstack([np.eye(len(chosen)), np.zeros(len(chosen))]).astype(np.float32), languages, np.ones(len(languages)))
    rows = np.concatenate([bare.scores(every[a : a + config.batch]) for a in range(0, len(every), config.batch)]).astype(np.float64) @ root
    target = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in labels])
    share = (target > 0).mean(axis=0)
    balance = np.where(target > 0, 0.5 / np.maximum(share, 1e-9), 0.5 / np.maximum(1 - share, 1e-9))
    full = np.hstack([rows, np.ones((len(rows), 1))])
    weights = np.empty((full.shape[1], len(languages)))
    for k in range(len(languages)):
        w = balance[:, k][:, None]
        weights[:, k] = np.linalg.solve(full.T @ (w * full) + config.ridge * len(rows) / 100 * np.eye(full.shape[1]), full.T @ (w[:, 0] * target[:, k]))
    return LanguageModel(codes, places, land, np.vstack([root @ weights[:-1], weights[-1:]]).astype(np.float32), languages, _strange(every, labels, is_landmark, places, land, languages, config))


def _strange(every: list[np.ndarray], labels: list[str], is_landmark: list[bool], places: np.ndarray, land: np.ndarray, languages: list[str], config: LanguageConfig) -> np.ndarray:
    holders = np.append((land > 0).sum(axis=1), 0)  # for place -1: the last
    share = np.array([(holders[places[g]] <= own).mean() if len(g) else 0.0 for g, own in zip(every, is_landmark)])
    of = np.array(labels)
    most = np.clip([np.quantile(share[of == lang], 0.99) for lang in languages], 0, 0.9)
    odds = config.strange_odds * most / (1 - most)
    return np.maximum(odds / (1 + odds), config.strange_least)


def learn(docs: DataFrame, labelled: DataFrame, config: LanguageConfig | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from the rows ``labelled`` of ``docs``: at most ``config.fit`` of each language are collected."""
    config = config or LanguageConfig()
    known = labelled.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    chosen = known.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= config.fit).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # a row for each chosen id and language, at most config.fit a language; their n-grams are collected, not their texts
    once = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "n").agg(F.min("text").alias("text"))
    rows = once.select("lang", "n", "text").mapInArrow(_raw, "lang string, n int, raw array<int>").collect()
    rows.sort(key=lambda r: (r["lang"], r["n"], r["raw"]))
    return fit([np.array(r["raw"], np.int64) for r in rows], [r["lang"] for r in rows], [r["n"] <= config.landmarks for r in rows], config)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        sets = [raw_grams(data[a:b]).astype(np.int32) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sets, pa.list_(pa.int32()))], names=["lang", "n", "raw"])


def _predictor(model: LanguageModel | None, batch: int):
    names = ["doc_id", "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            lettered = rows.column(rows.schema.get_field_index("lettered")).to_pylist()
            lang, score = ["und"] * len(lettered), np.zeros(len(lettered))
            at = [k for k, x in enumerate(lettered) if x and model is not None]
            for a in range(0, len(at), batch):
                some = at[a : a + batch]
                found = model.scores([grams(data[offsets[k] : offsets[k + 1]], model.codes) for k in some])
                best = found.argmax(axis=1)
                for k, b, s in zip(some, best.tolist(), found):
                    lang[k], score[k] = model.languages[b], min(1.0, max(0.0, (float(s[b]) + 1) / 2))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang), pa.array(score)], names=names)

    return run


def predict(docs: DataFrame, model: LanguageModel | None, config: LanguageConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    config = config or LanguageConfig()
    held = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB at most for 4 languages
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    texts = text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col).select("doc_id", "text", lettered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predictor(held.value, config.batch)(batches)

    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def _keeper(model: LanguageModel | None, least: float, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            lettered = rows.column(1).to_pylist()
            at = [k for k, x in enumerate(lettered) if x and model is not None]
            good = []
            for a in range(0, len(at), batch):
                some = at[a : a + batch]
                sets = [grams(data[offsets[k] : offsets[k + 1]], model.codes) for k in some]
                found = model.scores(sets)
                strange = model.is_strange(sets, found.argmax(axis=1))
                good += [k for k, s, x in zip(some, found.max(axis=1).tolist(), strange.tolist()) if (s + 1) / 2 >= least and not x]
            yield rows.select(["row"]).take(pa.array(good, pa.int64()))

    return run


def keep_known(docs: DataFrame, model: LanguageModel | None, least: float, config: LanguageConfig | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more and whose n-grams are not strange to it, all columns as they are."""
    config = config or LanguageConfig()
    held = docs.sparkSession.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _keeper(held.value, least, config.batch)(batches)

    return packed(docs, lettered, text=text_col).mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
