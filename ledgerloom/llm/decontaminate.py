"""Benchmark decontamination by latent semantic retrieval.

1. *Space.*  All documents are read in passages of ``passage`` words.  Over the terms of the benchmark, each
   task adds up its passages' document frequencies and, for a random matrix R, the
   product C'CR of its passage-by-term counts C; the sums of all tasks are added by blocks of terms.
   With D the inverse document frequencies this is a randomised eigendecomposition of
   the TF-IDF matrix's D C'C D in one pass: its test matrix is R scaled by 1/D, its sample D C'CR, its core R'C'CR.  The
   leading vectors span the latent space.
2. *Candidates.*  Windows of 16, 32, 64, ... words, a half of them apart, are
   projected into the space; a window and an item of about its length are a candidate if their cosine is ``cosine`` or more.
   The items of a slice are compared with all windows in blocks of matrix products.
3. *Checks.*  Words of the item and of the window with its surroundings are compared by their
   longest common subsequence.  A document leaks an item if that holds
   ``share`` of the item's words, or ``answer_share`` of them and the item's answer (its last sentence) nearly whole.
   Before the subsequence is computed, candidates that can't pass go: first by bit masks of
   their words, then by the words themselves; both count no fewer words than a subsequence has.

Items of fewer than ``short`` words leak where they stand word by word: their sequences are looked up.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case
(ASCII and Latin-1).  Words are terms by the first ``FOLD_BITS`` bits of their hashes, so that statistics and space have a bounded
size whatever the number of items; words that share them share a place in the space, not in the checks.

The items stream through the driver in slices of ``slice_items``, which are broadcast one by one; a task reads its documents once
and compares them with slice after slice, and keeps ``slices_held`` of them at a time.  There are two passes over the documents,
whatever the number of items.

Defined results: null or empty texts and items leak nothing; items of the same id are items of their own, and the best row of
an id is reported, of equal ones the first in the text; repeated documents and rows with a null document id are reported each; texts of any
length are searched whole; an empty benchmark or document table
gives an empty result; columns other than ids and texts are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, slices, text_of
from .textkernels import mix, word_hashes, word_spans

STEP = 8
FOLD_BITS = 17
_TERM_BLOCK = 256
#: Splits of the documents that one task of the first pass adds up; a task sends sums of all terms, whatever it reads.
SPLITS_A_TASK = 32


@dataclass(frozen=True)
class DecontaminationConfig:
    passage: int = 64
    sketch: int = 112
    dims: int = 96
    cosine: float = 0.42
    share: float = 0.6
    answer_share: float = 0.45
    answer: float = 0.8
    short: int = 8
    slice_items: int = 4000
    slices_held: int = 32
    pass_bytes: int = 1 << 19


class Terms:
    """Word hash -> term number, by the hash's first bits; -1 for a word whose bits no item's word has."""

    def __init__(self, folds: np.ndarray):
        self.size = len(folds)
        self.number = np.full(1 << FOLD_BITS, -1, np.int32)
        self.number[folds] = np.arange(len(folds))

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.number[fold(words)]


def fold(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - FOLD_BITS)).astype(np.int64)


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]
    answers: list[int]  # each item's first word of its answer


def hashed(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), wordlike=True)
    return word_hashes(data, starts, ends, latin=True)


def prepare_items(rows: list[tuple[int, str]]) -> Items:
    ids, words, answers = [], [], []
    for item, text in rows:
        own = hashed((text or "").encode())
        if not len(own):
            continue
        body = (text or "").rstrip()
        cut = max(body.rfind(sign, 0, len(body) - 1) for sign in (". ", "? ", "! ", ".\n", "?\n", "!\n", "\n"))
        ids.append(item)
        words.append(own)
        answers.append(len(hashed(body[: cut + 1].encode())) if cut > 0 else 0)
    return Items(ids, words, answers)


def lcs(item: np.ndarray, window: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word's worth of the item at a time."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in window.tolist():
        hit = masks.get(w)
        if hit:
            both = row & hit
            row = (row + both | row - both) & full
    return len(item) - row.bit_count()


# ------------------------------------------------------------------ space


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in slices(batches):
        starts, ends, _ = word_spans(data, offsets, wordlike=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(fold(word_hashes(data, starts, ends, latin=True))))], names=["fold"])


def _random(n: int, size: int) -> np.ndarray:
    return np.random.default_rng(77).standard_normal((n, size)).astype(np.float32)


def run_sums(table: np.ndarray, index: np.ndarray, times: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rows ``table[index] * times``, added up within each run of them; all runs' first rows, then their second, and so on."""
    size = np.diff(np.append(starts, len(index)))
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    out = table[index[at]] * times[at, None]
    longer = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 1) + 1), "left")
    for k in range(1, len(longer)):
        m = longer[k]
        if m < 16:  # a few long runs: each at once
            for r in range(m):
                rest = slice(at[r] + k, at[r] + size[r])
                out[r] += times[rest] @ table[index[rest]]
            break
        out[:m] += table[index[at[:m] + k]] * times[at[:m] + k, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _sums(terms: Terms, config: DecontaminationConfig):
    n, size = terms.size, config.sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = _random(n, size)
        seen, total, passages = np.zeros(n, np.int64), np.zeros((n, size), np.float32), 0
        for _, data, offsets in slices(batches, limit=config.pass_bytes):
            starts, ends, bounds = word_spans(data, offsets, wordlike=True)
            term = terms.of(word_hashes(data, starts, ends, latin=True))
            per_text = -(-np.diff(bounds) // config.passage)
            first = np.concatenate(([0], np.cumsum(per_text)))
            passages += int(first[-1])
            at = np.flatnonzero(term >= 0)
            if not len(at):
                continue
            text = np.searchsorted(bounds, at, "right") - 1
            passage = first[text] + (at - bounds[text]) // config.passage
            # each passage's terms once, with their counts
            pair, times = np.unique(passage * n + term[at], return_counts=True)
            passage, term, times = pair // n, pair % n, times.astype(np.float32)
            seen += np.bincount(term, minlength=n)
            begins = np.concatenate(([True], passage[1:] != passage[:-1]))
            mixed = run_sums(random, term, times, np.flatnonzero(begins))
            order = np.argsort(term, kind="stable")
            term = term[order]
            cuts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            total[term[cuts]] += run_sums(mixed, (np.cumsum(begins) - 1)[order], times[order], cuts)
        if passages:
            blocks = range(0, n, _TERM_BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a // _TERM_BLOCK for a in blocks], pa.int32()), pa.array([passages] * len(blocks), pa.int64()), pa.array([seen[a : a + _TERM_BLOCK].tobytes() for a in blocks], pa.binary()), pa.array([total[a : a + _TERM_BLOCK].tobytes() for a in blocks], pa.binary())],
                names=["block", "passages", "seen", "total"],
            )

    return run


def _added(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, passages, seen, total in zip(*(c.to_pylist() for c in batch.columns)):
                seen, total = np.frombuffer(seen, np.int64), np.frombuffer(total, np.float32).astype(np.float64)
                if block in sums:
                    own = sums[block]
                    own[0] += passages
                    own[1] = own[1] + seen
                    own[2] = own[2] + total
                else:
                    sums[block] = [passages, seen, total]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary()), pa.array([x[2].tobytes() for x in sums.values()], pa.binary())], names=["block", "passages", "seen", "total"])

    return run


_SUMS = "block int, passages long, seen binary, total binary"


def latent_space(texts: DataFrame, terms: Terms, config: DecontaminationConfig) -> np.ndarray:
    """terms x dims: what a term, times its inverse document frequency, adds to its passage's place in the space."""
    n, size = terms.size, config.sketch
    few = max(8 * texts.sparkSession.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // SPLITS_A_TASK))
    parts = texts.coalesce(few).mapInArrow(_sums(terms, config), _SUMS)
    added = parts.repartition("block").mapInArrow(_added(size), _SUMS).collect()  # a row for each block of terms
    seen, sample, passages = np.zeros(n), np.zeros((n, size)), 0
    for r in added:
        a = r["block"] * _TERM_BLOCK
        own = np.frombuffer(r["seen"], np.int64)
        seen[a : a + len(own)] = own
        sample[a : a + len(own)] = np.frombuffer(r["total"], np.float64).reshape(len(own), size)
        passages = max(passages, r["passages"])
    weight = np.log((passages + 1) / (seen + 1)) + 1e-3
    core = _random(n, size).astype(np.float64).T @ sample
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(), 0) * 1e-9 if len(value) else value > 0
    if not good.any():
        return np.zeros((n, 1), np.float32)
    root = (weight[:, None] * sample) @ vector[:, good] / np.sqrt(value[good])
    left, _, _ = np.linalg.svd(root, full_matrices=False)
    return np.ascontiguousarray(weight[:, None] * left[:, : config.dims]).astype(np.float32)


# ------------------------------------------------------------------ search


def window_width(item_words: int) -> int:
    """The window width of an item: the power of two from 16 on that is nearest by ratio."""
    width = 16
    while item_words > width * 1.5:
        width *= 2
    return width


def _room(item_words: int) -> int:
    """Words of surroundings on either side of a window."""
    return max(STEP, 3 * item_words // 4)


_MASK_WORDS = 8


def mask_word(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint64(6)) % np.uint64(_MASK_WORDS)).astype(np.int64)


def mask_bit(words: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (words & np.uint64(63))


def mask_of(words: np.ndarray) -> np.ndarray:
    """A bit for each word, of ``_MASK_WORDS`` times 64."""
    out = np.zeros(_MASK_WORDS, np.uint64)
    np.bitwise_or.at(out, mask_word(words), mask_bit(words))
    return out


def _sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    full = np.zeros(n, np.uint64)
    for k in range(size):
        full = mix(full * np.uint64(3) + words[k : k + n])
    return full


class Texts:
    """The words of a pass's texts, cut into steps of ``STEP`` words, each within one text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, terms: Terms, space: np.ndarray):
        starts, ends, self.bounds = word_spans(data, offsets, wordlike=True)
        self.words = word_hashes(data, starts, ends, latin=True)
        bounds = self.bounds
        per_text = -(-np.diff(bounds) // STEP)
        self.first = np.concatenate(([0], np.cumsum(per_text)))
        self.text_of_step = np.repeat(np.arange(len(per_text)), per_text)
        self.steps = int(self.first[-1])
        # steps x STEP: each step's words, padded by one past the last
        begin = bounds[self.text_of_step] + (np.arange(self.steps) - self.first[self.text_of_step]) * STEP
        self.places = begin[:, None] + np.arange(STEP)
        self.places[self.places >= bounds[self.text_of_step + 1][:, None]] = len(self.words)
        self.term = terms.of(self.words)
        term = np.append(self.term, -1)
        self.sums = np.zeros((self.steps, space.shape[1]), np.float32)
        for k in range(STEP):
            own = term[self.places[:, k]]
            of = np.flatnonzero(own >= 0)
            self.sums[of] += space[own[of]]

    @cached_property
    def masks(self) -> list[np.ndarray]:
        """Masks of the words of 1, 2, 4, ... steps."""
        bits = np.zeros((self.steps, _MASK_WORDS), np.uint64)
        of = np.arange(self.steps)
        words = np.append(self.words, np.uint64(0))
        for k in range(STEP):
            own = words[self.places[:, k]]
            real = self.places[:, k] < len(self.words)
            bits[of[real], mask_word(own[real])] |= mask_bit(own[real])
        return [bits]

    def masks_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Masks of the steps from low to high, one step at least."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        while len(self.masks) <= level.max():
            last, n = self.masks[-1], 1 << len(self.masks) - 1
            wider = last.copy()
            wider[:-n] |= last[n:]
            self.masks.append(wider)
        out = np.empty((len(low), _MASK_WORDS), np.uint64)
        for k in np.unique(level).tolist():
            of = level == k
            out[of] = self.masks[k][low[of]] | self.masks[k][high[of] - (1 << k)]
        return out

    def windows(self, width: int, longest: int) -> tuple[np.ndarray, ...]:
        """Of windows: first steps, vectors, and the words from, to and the mask of them with surroundings for items of up to ``longest`` words."""
        n = max(1, width // STEP)
        window = self.sums.copy()
        for k in range(1, n):
            if len(window) > k:
                # a step of another text adds what the checks sort out
                window[:-k] += self.sums[k:]
        begin = np.arange(0, self.steps, max(1, n // 2))
        text = self.text_of_step[begin]
        room = _room(longest)
        low = np.maximum(begin - -(-room // STEP), self.first[text])
        high = np.minimum(begin + -(-(max(width, longest) + room) // STEP), self.first[text + 1])
        word_from = self.bounds[text] + (low - self.first[text]) * STEP
        word_to = np.minimum(self.bounds[text] + (high - self.first[text]) * STEP, self.bounds[text + 1])
        return begin, window[begin], word_from, word_to, self.masks_of(low, high)


class Slice:
    """Some items, ready to be compared."""

    def __init__(self, items: Items, terms: Terms, space: np.ndarray, config: DecontaminationConfig):
        self.items, self.config = items, config
        self.size = np.array([len(w) for w in items.words])
        starts = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        vectors = np.add.reduceat(space[terms.of(np.concatenate(items.words))], starts, axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
        self.vocabulary, number = np.unique(np.concatenate(items.words), return_inverse=True)
        # words of one term are together, as terms are hashes' first bits
        self.of_term = np.searchsorted(terms.of(self.vocabulary), np.arange(terms.size + 1))
        # each item's different words, how often they are in it and in its answer; padded by a number that no word has
        self.numbers = np.split(number, starts[1:])
        bags = [np.unique(own, return_inverse=True, return_counts=True) for own in self.numbers]
        shape = (len(bags), max(len(b[0]) for b in bags))
        self.bag, self.times, self.end_times = np.full(shape, len(self.vocabulary)), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for k, ((words, place, times), at) in enumerate(zip(bags, items.answers)):
            self.bag[k, : len(words)], self.times[k, : len(words)] = words, times
            self.end_times[k, : len(words)] = np.bincount(place[at:], minlength=len(words))
        self.mask = np.stack([mask_of(w) for w in items.words])
        self.end_mask = np.stack([mask_of(w[at:]) for w, at in zip(items.words, items.answers)])
        self.end = end = self.size - np.array(items.answers)
        #: words of an item, and of its answer, that can be missing where it leaks by either rule
        self.slack = self.size - np.ceil(config.share * self.size - 1e-9).astype(np.int64)
        self.part_slack = np.where(end > 0, self.size - np.ceil(config.answer_share * self.size - 1e-9).astype(np.int64), -1)
        self.end_slack = end - np.ceil(config.answer * end - 1e-9).astype(np.int64)
        self.widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        long = np.flatnonzero(self.size >= config.short)
        width = np.array([window_width(n) for n in self.size[long].tolist()], np.int64)
        for w in np.unique(width).tolist():
            self.widths[w] = (long[width == w], np.ascontiguousarray(vectors[long[width == w]]))
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, config.short):
            of = np.flatnonzero(self.size == n)
            if len(of):
                key = np.concatenate([_sequence_hashes(items.words[i], n) for i in of])
                order = np.argsort(key, kind="stable")
                self.whole[n] = (key[order], of[order])

    def leaks(self, texts: Texts) -> dict[tuple[int, int], tuple]:
        """(text, item) -> (share, cosine, answer found, first word), the best of each."""
        found: dict[tuple[int, int], tuple] = {}
        if texts.steps:
            self._find_whole(texts, found)
            held = self._held(texts)
            for width, (which, vectors) in self.widths.items():
                self._find_near(texts, width, which, vectors, held, found)
        return found

    def _find_whole(self, texts: Texts, found: dict) -> None:
        for n, (keys, item) in self.whole.items():
            run = _sequence_hashes(texts.words, n)
            low, high = np.searchsorted(keys, run, "left"), np.searchsorted(keys, run, "right")
            for at in np.flatnonzero(high > low).tolist():
                text = int(np.searchsorted(texts.bounds, at, "right")) - 1
                if at + n <= texts.bounds[text + 1]:
                    for i in item[low[at] : high[at]].tolist():
                        if np.array_equal(texts.words[at : at + n], self.items.words[i]):
                            found.setdefault((text, i), (1.0, 1.0, True, at - int(texts.bounds[text])))

    def _held(self, texts: Texts) -> np.ndarray:
        """Of each word its number in the vocabulary, or one past it."""
        none = len(self.vocabulary)
        out = np.full(len(texts.words), none)
        at = np.flatnonzero(texts.term >= 0)
        number, last = self.of_term[texts.term[at]], self.of_term[texts.term[at] + 1]
        while len(at):
            inside = number < last
            at, number, last = at[inside], number[inside], last[inside]
            same = self.vocabulary[number] == texts.words[at]
            out[at[same]] = number[same]
            at, number, last = at[~same], number[~same] + 1, last[~same]
        return out

    def _find_near(self, texts: Texts, width: int, which: np.ndarray, vectors: np.ndarray, held: np.ndarray, found: dict) -> None:
        begin, window, word_from, word_to, mask = texts.windows(width, int(self.size[which].max()))
        length = np.linalg.norm(window, axis=1)
        for a in range(0, len(which), 256):
            some = which[a : a + 256]
            near = window @ vectors[a : a + 256].T
            row, item = np.nonzero(near >= np.maximum(self.config.cosine * length, 1e-30)[:, None])
            of = some[item]
            missing = self._missing(self.mask, of, mask, row)
            good = (missing <= self.slack[of]) | (missing <= self.part_slack[of]) & (self._missing(self.end_mask, of, mask, row) <= self.end_slack[of])
            row, item, cosine = row[good], of[good], near[row[good], item[good]] / length[row[good]]
            for r, i, c, most in self._covered(row, item, cosine, word_from, word_to, held):
                self._check(i, int(begin[r]), width, c, most, texts, held, found)

    @staticmethod
    def _missing(wanted: np.ndarray, item: np.ndarray, mask: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Bits of each candidate's item that its window lacks: as many of the item's words are missing at least."""
        out = np.zeros(len(row), np.uint8)
        for k in range(_MASK_WORDS):
            out += np.bitwise_count(wanted[item, k] & ~mask[row, k])
        return out

    def _covered(self, row: np.ndarray, item: np.ndarray, cosine: np.ndarray, word_from: np.ndarray, word_to: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """Those candidates whose windows, with surroundings, hold enough words of the item, with the number of them; those that hold most come first."""
        config, none = self.config, len(self.vocabulary)
        for a in range(0, len(row), 4096):
            of = item[a : a + 4096]
            block, place = np.unique(row[a : a + 4096], return_inverse=True)
            many = word_to[block] - word_from[block]
            at = np.repeat(word_from[block] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            key = np.repeat(np.arange(len(block)), many) * (none + 1) + held[at]
            key, times = np.unique(key[held[at] < none], return_counts=True)
            if not len(key):
                continue
            wanted = place[:, None] * (none + 1) + self.bag[of]
            found = np.searchsorted(key, wanted).clip(0, len(key) - 1)
            there = np.where(key[found] == wanted, times[found], 0)
            whole, end = np.minimum(there, self.times[of]).sum(axis=1), np.minimum(there, self.end_times[of]).sum(axis=1)
            answered = (self.end[of] > 0) & (end >= config.answer * self.end[of]) & (whole >= config.answer_share * self.size[of])
            kept = np.flatnonzero((whole >= config.share * self.size[of]) | answered)
            for k in kept[np.argsort(-whole[kept], kind="stable")].tolist():
                yield int(row[a + k]), int(of[k]), float(cosine[a + k]), int(whole[k])

    def _check(self, item: int, step: int, width: int, cosine: float, most: int, texts: Texts, held: np.ndarray, found: dict) -> None:
        config, own = self.config, self.numbers[item]
        text = int(texts.text_of_step[step])
        old = found.get((text, item))
        if old and most <= old[0] * len(own):  # no subsequence is longer
            return
        start, stop = int(texts.bounds[text]), int(texts.bounds[text + 1])
        a = start + (step - int(texts.first[text])) * STEP
        room = _room(len(own))
        low, high = max(start, a - room), min(stop, a + max(width, len(own)) + room)
        window = held[low:high]
        window = window[window < len(self.vocabulary)]
        share = lcs(own, window) / len(own)
        if share < min(config.share, config.answer_share) or old and share <= old[0]:
            return
        answer = own[self.items.answers[item] :]
        answered = bool(len(answer)) and lcs(answer, window) >= config.answer * len(answer)
        if share >= config.share or share >= config.answer_share and answered:
            found[text, item] = (share, cosine, answered, low - start)


@dataclass
class Search:
    """What the executors hold: the space, and the slices of items, which they load as they need them."""

    terms: Terms
    space: np.ndarray
    config: DecontaminationConfig

    def __post_init__(self):
        self.ready: OrderedDict[int, Slice] = OrderedDict()

    def slice(self, number: int, held) -> Slice:
        if number in self.ready:
            self.ready.move_to_end(number)
        else:
            self.ready[number] = Slice(held.value, self.terms, self.space, self.config)
            held.__dict__.pop("_value", None)
            if len(self.ready) > self.config.slices_held:
                self.ready.popitem(last=False)
        return self.ready[number]


_LEAKS = "doc_id long, item_id long, share double, cosine double, answer_found boolean, first_word long"


def _found(held, parts: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[tuple[int, int], tuple]]]:
    """Of each pass its rows and (text, item id) -> the best leak."""
    search = held.value
    for rows, data, offsets in slices(batches, limit=search.config.pass_bytes):
        texts = Texts(data, offsets, search.terms, search.space)
        best: dict[tuple[int, int], tuple] = {}
        for k, part in enumerate(parts):
            own = search.slice(k, part)
            for (t, i), leak in own.leaks(texts).items():
                key = (t, own.items.ids[i])
                if key not in best or (leak[0], -leak[3]) > (best[key][0], -best[key][3]):
                    best[key] = leak
        yield rows, best


def _finder(held, parts: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, best in _found(held, parts, batches):
            docs = rows.column(0).to_pylist()
            columns = [[docs[t] for t, _ in best], [i for _, i in best], *([v[k] for v in best.values()] for k in range(4))]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _LEAKS.split(", ")])

    return run


def _prepared(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig, text_col: str, item_col: str, item_text_col: str) -> tuple | None:
    """The broadcast search and its broadcast slices of items; None without items."""
    context = docs.sparkSession.sparkContext
    items = text_of(benchmark, F.col(item_col).cast("long").alias("i"), text=item_text_col)
    folds = sorted(r["fold"] for r in items.mapInArrow(_folds, "fold long").distinct().collect())  # 2^FOLD_BITS at most
    if not folds:
        return None
    terms = Terms(np.array(folds, np.int64))
    search = context.broadcast(Search(terms, latent_space(text_of(docs, text=text_col), terms, config), config))
    parts, some = [], []

    def send() -> None:
        own = prepare_items(some)
        if own.ids:
            parts.append(context.broadcast(own))
        some.clear()

    for r in items.toLocalIterator():  # a partition at a time
        some.append((r["i"], r["text"]))
        if len(some) == config.slice_items:
            send()
    send()
    return search, parts


def leaks(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, share, cosine, answer_found, first_word`` of each document that leaks an item."""
    ready = _prepared(docs, benchmark, config or DecontaminationConfig(), text_col, item_col, item_text_col)
    if ready is None:
        return docs.sparkSession.createDataFrame([], _LEAKS)
    return text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col).mapInArrow(_finder(*ready), _LEAKS)


def _cleaner(held, parts: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, best in _found(held, parts, batches):
            bad = {t for t, _ in best}
            yield rows.select(["row"]).take(pa.array([k for k in range(rows.num_rows) if k not in bad], pa.int64()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, config: DecontaminationConfig | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns as they are; nothing is joined or moved."""
    ready = _prepared(docs, benchmark, config or DecontaminationConfig(), text_col, item_col, item_text_col)
    if ready is None:
        return docs
    return packed(docs, text=text_col).mapInArrow(_cleaner(*ready), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
