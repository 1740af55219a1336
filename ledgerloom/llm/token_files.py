"""Token ids in files of patched frame-of-reference blocks.

A shard file holds the ids of consecutive documents, in id order::

    blocks | block index | document table | footer

* A block has up to ``BLOCK`` ids: their minimum (u32), a bit width (u8), the
  number of exceptions (u16) and of ids (u16); then each id minus the minimum in
  ``width`` bits; then the exceptions' places (u16) and values minus the
  minimum (u32).  The width is that of the ``percentile``-th difference of the
  block; larger differences are exceptions and zero in the packed bits.
* The block index has the start of each block (u64), so that any run of ids can
  be read without decoding what is before it.
* The document table has ids (i64; the least i64 for null) and lengths (u32).
* The footer has the places of index and table, the counts, and a magic word.

Documents are dealt out by ranges of ids and sorted within each, a shard for
each range.  A task writes under a name of its own and moves the file to its
final name at the end, so that a task that runs again replaces its shard whole.
Starts over all shards follow from one row for each shard.

Defined results: a null or empty text has the end id only; rows with one id are
all written, in any order among themselves; null ids come first; an empty table gives
no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder, passes, byte_view, text_of

BLOCK = 1024
PERCENTILE = 97
MAGIC = b"LLPFOR01"
_HEAD = struct.Struct("<IBHH")
_FOOT = struct.Struct("<QQQQQ8s")
NULL_ID = -(2**63)


# ------------------------------------------------------------------ blocks


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of up to ``BLOCK`` ids each, in order; only the last can be short."""
    full = len(ids) // BLOCK
    out: list[bytes] = [b""] * full
    if full:
        rows = ids[: full * BLOCK].reshape(full, BLOCK).astype(np.uint32)
        _pack_rows(rows, percentile, out)
    if len(ids) > full * BLOCK:
        last = [b""]
        _pack_rows(ids[full * BLOCK :].reshape(1, -1).astype(np.uint32), percentile, last)
        out += last
    return out


def _pack_rows(rows: np.ndarray, percentile: int, out: list[bytes]) -> None:
    n = rows.shape[1]
    least = rows.min(axis=1)
    over = rows - least[:, None]
    rank = min(n - 1, n * percentile // 100)
    widths = np.array([int(x).bit_length() for x in np.partition(over, rank, axis=1)[:, rank]])
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        part = over[at]
        extra = part >= np.uint64(1) << np.uint64(width)
        kept = np.where(extra, 0, part)
        bits = _to_bits(kept, width)
        for k, i in enumerate(at.tolist()):
            places = np.flatnonzero(extra[k])
            out[i] = _HEAD.pack(int(least[i]), width, len(places), n) + bits[k].tobytes() + places.astype("<u2").tobytes() + part[k, places].astype("<u4").tobytes()


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Each row's values in ``width`` bits, padded to whole bytes."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    word = 16 if width <= 16 else 32
    raw = values.astype(">u2" if word == 16 else ">u4").view(np.uint8).reshape(len(values), values.shape[1], word // 8)
    bits = np.unpackbits(raw, axis=2)[:, :, word - width :]
    return np.packbits(bits.reshape(len(values), -1), axis=1)


def unpack_block(data: memoryview | bytes) -> np.ndarray:
    least, width, extras, n = _HEAD.unpack_from(data, 0)
    at = _HEAD.size
    packed = (n * width + 7) // 8
    if width:
        word = 16 if width <= 16 else 32
        bits = np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=n * width).reshape(n, width)
        wide = np.zeros((n, word), np.uint8)
        wide[:, word - width :] = bits
        ids = np.packbits(wide, axis=1).reshape(-1).view(">u2" if word == 16 else ">u4").astype(np.uint32)
    else:
        ids = np.zeros(n, np.uint32)
    if extras:
        places = np.frombuffer(data, "<u2", extras, at + packed)
        ids[places] = np.frombuffer(data, "<u4", extras, at + packed + 2 * extras)
    return ids + np.uint32(least)


# ------------------------------------------------------------------ shards


class ShardWriter:
    """Writes one shard; ids are packed as soon as ``flush_ids`` of them are there."""

    def __init__(self, sink, percentile: int = PERCENTILE, flush_ids: int = 256 * BLOCK):
        self.sink, self.percentile, self.flush_ids = sink, percentile, flush_ids
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.starts: list[int] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc is None else doc)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.flush_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in pack_blocks(ids[:whole], self.percentile):
            self.starts.append(self.at)
            self.sink.write(block)
            self.at += len(block)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = np.array(self.starts + [self.at], "<u8").tobytes()
        table = np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes()
        self.sink.write(index)
        self.sink.write(table)
        self.sink.write(_FOOT.pack(self.at, self.at + len(index), len(self.starts), len(self.docs), self.n_ids, MAGIC))


class ShardReader:
    """Reads a shard by its index; only the blocks that a run of ids touches are decoded."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        self.index_at, self.table_at, self.n_blocks, self.n_docs, self.n_ids, magic = _FOOT.unpack(source.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.starts = np.frombuffer(source.read_at(self.table_at - self.index_at, self.index_at), "<u8").astype(np.int64)
        table = source.read_at(size - _FOOT.size - self.table_at, self.table_at)
        self.docs = np.frombuffer(table, "<i8", self.n_docs)
        self.lengths = np.frombuffer(table, "<u4", self.n_docs, 8 * self.n_docs).astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + count - 1) // BLOCK + 1
        base = int(self.starts[first])
        data = self.source.read_at(int(self.starts[last]) - base, base)
        parts = [unpack_block(data[int(self.starts[k]) - base : int(self.starts[k + 1]) - base]) for k in range(first, last)]
        return np.concatenate(parts)[start - first * BLOCK : start - first * BLOCK + count]

    def documents(self, run_ids: int = 256 * BLOCK) -> Iterator[tuple[int | None, np.ndarray]]:
        ends = np.cumsum(self.lengths)
        first = 0
        while first < self.n_docs:
            begin = int(ends[first] - self.lengths[first])
            last = max(first + 1, int(np.searchsorted(ends, begin + run_ids, "right")))
            ids = self.ids(begin, int(ends[last - 1]) - begin)
            for k in range(first, last):
                b = int(ends[k]) - begin
                yield (None if self.docs[k] == NULL_ID else int(self.docs[k])), ids[b - int(self.lengths[k]) : b]
            first = last


# ------------------------------------------------------------------ encoding


#: Letters of Latin-1 in lower case, and the white space there that the tokenizer drops.
_LETTERS, _BLANKS = "a-zß-öø-ÿªµº", " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
_WORD = re.compile(f"[{_LETTERS}]+")
_RUNS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}{_BLANKS}]+")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, with repeated pieces encoded once.

    The tokenizer lowers all letters, drops white space and splits between letters and
    what isn't a letter before it merges anything, so that a text's ids are those of such pieces in
    turn.  In texts of Latin-1 without apostrophes (which can join what
    follows) the pieces are runs of letters and of other signs; in other texts they are what stands between spaces.
    Pieces that aren't known yet are encoded together, with a special token between
    them; runs of letters, which are most, go past the steps that don't change them,
    and are told apart by the mark that a word's last token has.  At ``limit``
    pieces the store starts anew.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges for words that are lower-case letters already
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.limit = limit
        self.known: dict[str, bytes] = {"": b""}
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(special.items()))
        self.specials = tuple(special)

    def pieces(self, text: str) -> list[str]:
        if "'" not in text and not any(s in text for s in self.specials):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return _RUNS.findall(text.lower())
        return text.replace("\n", " ").split(" ")

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        if self.ends.any():
            letters, rest = [], []
            for p in pieces:
                (letters if (p.isalpha() and p.islower() if p.isascii() else _WORD.fullmatch(p)) else rest).append(p)
            pieces = rest
            for a in range(0, len(letters), 2000):
                some = letters[a : a + 2000]
                ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != len(some):
                    raise ValueError("words can't be told apart")
                data, first = ids.tobytes(), 0
                for p, last in zip(some, ends.tolist()):
                    self.known[p] = data[4 * first : 4 * last]
                    first = last
        odd = {p for p in pieces if "<" in p and any(s in p for s in self.specials)} if all("<" in s for s in self.specials) else set(pieces)
        for p in odd:
            self.known[p] = self._plain(p).tobytes()
        pieces = [p for p in pieces if p not in odd]
        for a in range(0, len(pieces), 2000):
            some = pieces[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(some) - 1:
                raise ValueError("pieces can't be told apart")
            data, a = ids.tobytes(), 0
            for p, b in zip(some, [*ends.tolist(), len(ids)]):
                self.known[p] = data[4 * a : 4 * b]
                a = b + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.known.keys())
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known = {"": b""}
                new = set().union(*split).difference(self.known.keys())
            self._learn(list(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), np.uint32) for pieces in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ------------------------------------------------------------------ Spark


def _writer(folder: str, tokenizer: str, end_id: int, percentile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        own, name = f"{base}/.{part}-{uuid.uuid4().hex}", f"shard-{part:06d}.pfor"
        encode, end, first = encoder(tokenizer).encode, np.array([end_id], np.uint32), None
        with store.open_output_stream(own) as sink:
            out = ShardWriter(sink, percentile)
            for batch in batches:
                _, offsets = byte_view(batch.column(1))
                for a, b in passes(offsets):
                    docs = batch.column(0).slice(a, b - a).to_pylist()
                    for doc, ids in zip(docs, encode(batch.column(1).slice(a, b - a).to_pylist())):
                        first = doc if first is None else first
                        out.add(doc, np.concatenate((ids, end)))
            out.close()
        if out.docs:
            store.move(own, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(out.docs)], pa.int64()), pa.array([out.n_ids], pa.int64())], names=["part", "name", "n_docs", "n_ids"])
        else:
            store.delete_file(own)

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, percentile: int = PERCENTILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts' ids to shards in ``folder`` in id order; ``part, name, n_docs, n_ids, start`` for each shard."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col)
    dealt = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    written = dealt.mapInArrow(_writer(folder, tokenizer, end_id, percentile), "part int, name string, n_docs long, n_ids long")
    rows, start = [], 0
    for r in sorted(written.collect(), key=lambda r: r["part"]):  # a row for each shard
        rows.append((r["part"], r["name"], r["n_docs"], r["n_ids"], start))
        start += r["n_ids"]
    return spark.createDataFrame(rows, "part int, name string, n_docs long, n_ids long, start long")


def _reader(folder: str):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with store.open_input_file(f"{base}/{name}") as source:
                    for doc, ids in ShardReader(source).documents():
                        rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return run


def read_token_files(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the shards."""
    return shards.select("name", "start").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = fresh_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
