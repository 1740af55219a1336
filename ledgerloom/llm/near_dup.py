"""MinHash near-duplicate detection with sequential Bayesian verification.

Two texts are linked when the Jaccard similarity of their sets of word
shingles reaches a threshold.  The work goes in steps that never hold a group
of copies in one place:

1. Every text becomes a set of shingle hashes and a MinHash signature; texts of
   equal word sequence are one *class*, represented by the smallest id.
2. Bands of the signatures give candidates.  Within a bucket each member is
   tied to the least member only, so a bucket of m classes costs m rows, and
   the connected parts of these ties are *families*: no candidate pair
   crosses two families.
3. Families are cut into blocks of bounded size and each task gets one pair of
   blocks.  A family of more than ``family_blocks`` blocks, such as common passages can chain together, is
   compared within its buckets instead, each cut into blocks the same way, so that only candidates
   meet.  There batches of signature positions are compared one after
   another; a pair is pruned once the posterior probability that it reaches the
   threshold falls below ``miss``.  Survivors are verified on their full
   sets, and a pair whose ends are already connected is not verified again.
4. The verified links of all tasks make the components.

Defined results: a null or empty text, or one of white space only, has no
shingle and is linked with nothing.  Rows that share an id are one node.  A row
with a null id takes part in nothing: its component is null and it is not kept.
An empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_narrow, few_files, slices, text_of
from .components import connected_components
from .textkernels import minhashes, shingles, word_hashes, word_spans

#: Members of families up to this many are sent to every executor (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class NearDupConfig:
    """``bands`` of ``rows`` positions miss a pair at the threshold 0.8 with probability (1 - 0.8^4)^24 = 3e-6."""

    words: int = 4
    percent: int = 80
    bands: int = 24
    rows: int = 4
    miss: float = 1e-5
    step: int = 16
    block_texts: int = 512
    block_shingles: int = 1_000_000
    family_blocks: int = 24

    @property
    def size(self) -> int:
        return self.bands * self.rows


@lru_cache
def least_matches(seen: int, threshold: float, miss: float) -> int:
    """The fewest equal positions of ``seen`` at which P(similarity >= threshold) is still ``miss``.

    Under a uniform prior the posterior is Beta(m + 1, seen - m + 1), whose
    upper tail is a binomial sum.
    """
    tail = 0.0
    for m in range(seen + 1):
        tail += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
        if tail >= miss:
            return m
    return seen


def survivors(own: np.ndarray, others: np.ndarray, threshold: float, miss: float, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``others`` that signature ``own`` isn't ruled out against, and their equal positions."""
    alive = np.arange(len(others))
    matches = np.zeros(len(others), np.int32)
    for a in range(0, len(own), step):
        matches = matches + (others[alive, a : a + step] == own[a : a + step]).sum(axis=1, dtype=np.int32)
        good = matches >= least_matches(min(a + step, len(own)), threshold, miss)
        alive, matches = alive[good], matches[good]
        if not len(alive):
            break
    return alive, matches


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, config: NearDupConfig) -> list[tuple[int, int]]:
    """Verified links between the sets at ``left`` and at ``right`` (``same``: within ``left``) that connect all that is linked."""
    signs = np.stack([minhashes(s, config.size) for s in sets])
    # postings of the right-hand sets, so that one pass gives a set's overlap with all of them
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate([sets[i] for i in right])
    owners = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    forest, out = Forest(len(sets)), []
    right_signs = signs[right]
    for k, i in enumerate(left):
        alive, matches = survivors(signs[i], right_signs[k + 1 :] if same else right_signs, config.percent / 100, config.miss, config.step)
        if same:
            alive = alive + k + 1
        if not len(alive):
            continue
        alive = alive[np.argsort(-matches, kind="stable")]
        mine, overlap = forest.root(int(i)), None
        for j in alive.tolist():
            other = int(right[j])
            if forest.root(other) == mine:
                continue
            if overlap is None:
                a, b = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
                many = b - a
                at = np.repeat(a - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                overlap = np.bincount(owners[at], minlength=len(right))
            both = int(overlap[j])
            if 100 * both >= config.percent * (int(sizes[i]) + int(sizes[other]) - both):
                forest.join(int(i), other)
                mine = forest.root(int(i))
                out.append((int(i), other))
    return out


def _signer(config: NearDupConfig):
    names = ["doc_id", "n_shingles", "norm", "sign"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            starts, ends, bounds = word_spans(data, offsets)
            words = word_hashes(data, starts, ends)
            sets = shingles(words, bounds, config.words)
            norm = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            sign = [minhashes(s, config.size).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(norm, pa.binary()), pa.array(sign, pa.binary())], names=names)

    return run


def _sets(config: NearDupConfig):
    names = ["doc_id", "family", "blocks", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            starts, ends, bounds = word_spans(data, offsets)
            sets = shingles(word_hashes(data, starts, ends), bounds, config.words)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array([s.tobytes() for s in sets], pa.binary())], names=names)

    return run


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Consecutive rows of equal first ``keys`` columns, across batches: the key and the lists of the other columns."""
    now, rest = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != now:
                if now is not None:
                    yield now, rest
                now, rest = row[:keys], [[] for _ in columns[keys:]]
            for kept, value in zip(rest, row[keys:]):
                kept.append(value)
    if now is not None:
        yield now, rest


def _linker(config: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, one, two), (docs, blocks, hashes) in grouped(batches, 3):
            sets = [np.frombuffer(h, np.uint64) for h in hashes]
            blocks = np.array(blocks)
            left, right = np.flatnonzero(blocks == one), np.flatnonzero(blocks == two)
            if len(left) and len(right):
                links = block_links(sets, left, right, one == two, config)
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in links], pa.int64()), pa.array([docs[j] for _, j in links], pa.int64())], names=["a", "b"])

    return run


def signatures(docs: DataFrame, config: NearDupConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, norm`` (a digest of the word sequence) and ``sign``, a row for each row."""
    texts = text_of(docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs, F.col("doc_id").cast("long").alias("doc_id"), text=text_col)
    return texts.mapInArrow(_signer(config), "doc_id long, n_shingles long, norm binary, sign binary")


def _compared(sets: DataFrame, config: NearDupConfig) -> DataFrame:
    """Links within each ``family`` of ``doc_id, family, blocks, hashes``, a pair of blocks to a group."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    pairs = (
        sets.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "doc_id", "block", "hashes")
        .repartition("family", "one", "two")
        .sortWithinPartitions("family", "one", "two")
    )
    return pairs.mapInArrow(_linker(config), "a long, b long")


def near_duplicate_links(docs: DataFrame, signed: DataFrame, config: NearDupConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``a, b`` that connect exactly what is linked: copies to their class, classes by verified pairs."""
    named = signed.where("norm is not null and doc_id is not null")
    files = few_files(docs)
    classes = cut_narrow(named.groupBy("norm").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign")), files)
    width = 4 * config.rows
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("sign", b * width + 1, width)) for b in range(config.bands)))
    banded = classes.select("doc_id", F.explode(keys).alias("bucket"))
    least = banded.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("bucket", "least")
    ties = banded.join(least, "bucket").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    families = connected_components(ties, "a", "b")
    members = classes.select(F.col("doc_id").alias("node"), "n_shingles").join(families, "node")
    weight = members.groupBy("component").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_shingles").alias("all"))
    blocks = F.greatest(F.ceil(F.col("texts") / config.block_texts), F.ceil(F.col("all") / config.block_shingles)).cast("int")
    placed = cut_narrow(members.join(weight, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("family"), blocks.alias("blocks")), files)
    texts = text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    many, most = placed.agg(F.count(F.lit(1)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    found = texts.join(F.broadcast(placed) if many <= BROADCAST_ROWS else placed, "doc_id").select("doc_id", "family", "blocks", "text")
    sets = found.mapInArrow(_sets(config), "doc_id long, family long, blocks int, hashes binary")
    if most <= config.family_blocks:
        links = _compared(sets, config)
    else:
        sets = cut(sets)
        large = placed.where(F.col("blocks") > config.family_blocks).select("doc_id")
        own = banded.join(large, "doc_id").join(classes.select("doc_id", "n_shingles"), "doc_id")
        sizes = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_shingles").alias("all")).where("texts > 1").select("bucket", blocks.alias("blocks"))
        place = own.join(sizes, "bucket").select("doc_id", F.col("bucket").alias("family"), "blocks")
        links = _compared(sets.where(F.col("blocks") <= config.family_blocks), config).unionByName(_compared(sets.select("doc_id", "hashes").join(place, "doc_id"), config))
    copies = named.join(classes.select("norm", F.col("doc_id").alias("first")), "norm").where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    # written first: a second Python operator in the linker's stage would take a second worker for each core, and executors
    # hand all workers they ever started to later stages in turn, so that each of them comes to hold every stage's tables
    return cut_narrow(links, files, heavy=True).unionByName(copies)


def near_duplicates(docs: DataFrame, config: NearDupConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``."""
    config = config or NearDupConfig()
    signed = cut_narrow(signatures(docs, config, id_col, text_col), few_files(docs), heavy=True)
    links = near_duplicate_links(docs, signed, config, id_col, text_col)
    parts = connected_components(links, "a", "b")
    joined = signed.select("doc_id", "n_shingles").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_duplicates(docs: DataFrame, config: NearDupConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that aren't the first of their group; rows with a null id stay."""
    found = near_duplicates(docs, config, id_col, text_col)
    gone = cut_narrow(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), few_files(docs))
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
