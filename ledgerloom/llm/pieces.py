"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is escaped (a space becomes U+2581, one is put in front) and merged by a
score-ordered agenda: of all adjacent symbol pairs whose join is a piece, the
one of the highest score is merged, the leftmost among equals, until none is
left.  Symbols outside the vocabulary become byte pieces.

No piece of a merge-type vocabulary that was trained within words joins a symbol
to a following U+2581, so that the agenda works on each *chunk* (a run of
U+2581 and what follows it, or a line feed and what follows it) alone.  All texts are cut
into chunks the same way.  The chunks of an
Arrow batch that aren't known yet are merged together: one array row per
chunk, one merge per row and round.  Long or odd chunks go through the
same agenda one at a time, with a heap.

Each Arrow batch is checked against the sentencepiece library, where a difference is an error: ids and decoded text
of every whole text, however long, whose CRC-32 is divisible by ``CHECKED``, and of the first text in each pass of about 1 MB.

A model is refused when it is loaded unless it is of the merge type, leaves texts as they are but for the space in front
and the escapes, has no user-defined pieces, and has no piece that crosses a chunk's start.

Defined results: a null text is an empty one and has begin and end ids only; rows
are independent, so ties and repeated rows need no rule; a text longer than a pass is a pass of its own, whole; an
empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

SPACE = "▁"
#: Chunks of up to this many symbols are merged as array rows.
ROW_SYMBOLS = 40
#: One whole text in this many is compared with the library.
CHECKED = 4
_CHUNK = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
#: Fixed values of the model file's format: the number of the merge type, and the type of pieces that users define.
_MERGE_TYPE, _USER_DEFINED = 2, 4


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbers and raw values of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield key >> 3, message[at : at + size]
        at += size


def refuse_unsupported(model: bytes) -> None:
    """Raise for a model file whose texts the agenda wouldn't encode as the library does."""
    parts = list(_fields(model))
    trainer = dict(_fields(next((v for k, v in parts if k == 2), b"")))
    normalizer = dict(_fields(next((v for k, v in parts if k == 3), b"")))
    kinds = {dict(_fields(v)).get(3, 1) for k, v in parts if k == 1}
    wrong = {
        "it isn't of the merge type": trainer.get(3, 1) != _MERGE_TYPE,
        "its white space is a suffix": bool(trainer.get(24, 0)),
        "it changes texts": bool(normalizer.get(2, b"")),
        "it puts no space in front": not normalizer.get(3, 1),
        "it drops spaces": bool(normalizer.get(4, 1)),
        "it escapes no spaces": not normalizer.get(5, 1),
        "it has user-defined pieces": _USER_DEFINED in kinds,
    }
    if any(wrong.values()):
        raise ValueError(f"the model isn't supported: {', '.join(k for k, v in wrong.items() if v)}")


class PairTable:
    """(left id, right id) -> (joined id, rank of its score), by two probes into hashed arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int], rank: np.ndarray):
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64)
        self.bits = max(8, int(len(keys) * 16).bit_length())
        self.rank = rank
        seed = 1
        while True:
            self.times = tuple(np.uint64(x | 1) for x in np.random.default_rng(seed).integers(2**61, 2**63, 2, dtype=np.uint64))
            self.keys = [np.full(1 << self.bits, -1, np.int64) for _ in range(2)]
            self.values = [np.full(1 << self.bits, -1, np.int32) for _ in range(2)]
            left = np.arange(len(keys))
            for level in range(2):
                slot = self._slot(keys[left], level)
                _, first = np.unique(slot, return_index=True)
                self.keys[level][slot[first]] = keys[left[first]]
                self.values[level][slot[first]] = values[left[first]]
                left = np.delete(left, first)
            if not len(left):
                break
            seed += 1
        self.none = np.int32(2**31 - 1)

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.times[level]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids (-1: none) and ranks."""
        keys = left.astype(np.int64) << 20 | right
        slot = self._slot(keys, 0)
        joined = np.where(self.keys[0][slot] == keys, self.values[0][slot], -1)
        miss = joined < 0
        if miss.any():
            rest = keys[miss]
            slot = self._slot(rest, 1)
            joined[miss] = np.where(self.keys[1][slot] == rest, self.values[1][slot], -1)
        return joined, np.where(joined >= 0, self.rank[joined], self.none)


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str, limit: int = 150_000):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        refuse_unsupported(model.serialized_model_proto())
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        odd = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        if odd:
            raise ValueError(f"pieces that cross a word's start aren't supported: {odd[:3]}")
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.begin, self.end = model.bos_id(), model.eos_id()
        scores = np.array([model.get_score(i) for i in range(n)])
        # equal scores get equal ranks, so that the leftmost of them comes first
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = {(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.pairs = pairs
        self.table = PairTable(pairs, self.rank)
        self.of_char = {p: i for p, i in self.ids.items() if len(p) == 1}
        for b in range(128):  # one byte, one id, never merged
            if chr(b) not in self.of_char and b in self.bytes:
                self.of_char[chr(b)] = self.bytes[b]
        self.limit = limit
        self.known: dict[str, bytes] = {}
        bodies = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.body = np.frombuffer(b"".join(bodies), np.uint8)
        self.body_size = np.array([len(b) for b in bodies], np.int64)
        self.body_at = np.concatenate(([0], np.cumsum(self.body_size)[:-1]))

    # -------------------------------------------------------------- agenda

    def agenda(self, chunk: str) -> list[int]:
        """One chunk's ids by a heap of adjacent pairs."""
        spans = list(chunk)
        symbols = [self.of_char.get(c, -1) for c in spans]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def offer(a: int, b: int) -> None:
            joined = self.pairs.get((symbols[a], symbols[b]))
            if joined is not None:
                heapq.heappush(heap, (int(self.rank[joined]), a, b, symbols[a], symbols[b], joined))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, x, y, joined = heapq.heappop(heap)
            if not (alive[a] and alive[b] and symbols[a] == x and symbols[b] == y and after[a] == b):
                continue
            symbols[a], alive[b] = joined, False
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        out: list[int] = []
        for k in range(n):
            if alive[k]:
                if symbols[k] >= 0:
                    out.append(symbols[k])
                elif self.bytes:
                    out += [self.bytes[b] for b in spans[k].encode()]
                else:
                    out.append(self.unknown)
        return out

    def _rows(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks whose characters all have ids: the agenda on array rows, one merge per row and round."""
        size = np.array([len(c) for c in chunks])
        wide = int(size.max())
        code = np.array(chunks, dtype=f"U{wide}").view(np.uint32).reshape(len(chunks), wide)
        kinds, at = np.unique(code, return_inverse=True)
        symbols = np.array([self.of_char.get(chr(c), -1) if c else -1 for c in kinds.tolist()], np.int32)[at].reshape(code.shape)
        out: list[bytes] = [b""] * len(chunks)
        live = np.arange(len(chunks))
        joined = np.full(symbols.shape, -1, np.int32)
        rank = np.full(symbols.shape, self.table.none, np.int32)
        if wide > 1:
            joined[:, :-1], rank[:, :-1] = self.table.find(symbols[:, :-1], symbols[:, 1:])
            rank[:, :-1][symbols[:, 1:] < 0] = self.table.none
        columns = np.arange(wide)
        while True:
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            done = rank[row, best] == self.table.none
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[live[k]] = symbols[k, : size[k]].tobytes()
                keep = ~done
                if not keep.any():
                    return out
                live, size, symbols, joined, rank, best = live[keep], size[keep], symbols[keep], joined[keep], rank[keep], best[keep]
                row = np.arange(len(live))
            # the left symbol becomes the join, what is right of the pair moves up
            symbols[row, best] = joined[row, best]
            source = np.minimum(columns + (columns > best[:, None]), wide - 1)
            symbols = np.take_along_axis(symbols, source, 1)
            joined = np.take_along_axis(joined, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            size = size - 1
            symbols[row, size] = -1
            rank[:, -1] = self.table.none
            for a in (best - 1, best):
                ok = (a >= 0) & (a + 1 < size)
                r, c = row[ok], a[ok]
                joined[r, c], rank[r, c] = self.table.find(symbols[r, c], symbols[r, c + 1])
            rank[row, np.maximum(size - 1, 0)] = self.table.none

    def _merged(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        plain = set(self.of_char)
        short = []
        for k, chunk in enumerate(chunks):
            if 0 < len(chunk) <= ROW_SYMBOLS and plain.issuperset(chunk) and "\0" not in chunk:
                short.append(k)
            else:
                out[k] = np.array(self.agenda(chunk), np.uint32).tobytes()
        short.sort(key=lambda k: len(chunks[k]))
        for a in range(0, len(short), 4096):
            some = short[a : a + 4096]
            for k, ids in zip(some, self._rows([chunks[k] for k in some])):
                out[k] = ids
        return out

    # -------------------------------------------------------------- texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end."""
        split = [_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split).difference(self.known.keys())
        if new and len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = set().union(*split)
        new = list(new)
        self.known.update(zip(new, self._merged(new)))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, chunks)), np.uint32) for chunks in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the pieces in turn, without the space in front."""
        size = self.body_size[ids]
        total = int(size.sum())
        source = np.repeat(self.body_at[ids] - np.cumsum(size) + size, size) + np.arange(total)
        text = self.body[source].tobytes()
        return text[1:] if text[:1] == b" " else text

    def check(self, text: str, ids: np.ndarray, decoded: bytes) -> None:
        """Raise if the library gives anything else for this text."""
        own = self.library.encode(text)
        if own != ids.tolist() or self.library.decode([self.begin, *own, self.end]).encode() != decoded:
            raise ValueError(f"differs from the library: {text[:200]!r}")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encoded(path: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for rows, _, _ in slices(batches):
            texts = rows.column(1).to_pylist()
            some = model.encode(texts)
            whole = [np.concatenate(([model.begin], ids, [model.end])).astype("<u4") for ids in some]
            decoded = [model.decode(ids) for ids in some]
            for k, text in enumerate(texts):
                if not k or zlib.crc32(text.encode()) % CHECKED == 0:
                    model.check(text, some[k], decoded[k])
            if full:
                columns = [pa.array([w.astype(np.int32) for w in whole], pa.list_(pa.int32())), pa.array([d.decode() for d in decoded])]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["doc_id", "ids", "decoded"])
            else:
                columns = [pa.array([len(w) for w in whole], pa.int64()), pa.array([hashlib.sha256(w).hexdigest() for w in whole]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (with begin and end) and ``decoded``, the text that the ids stand for."""
    return text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col).mapInArrow(_encoded(model, True), "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what :func:`encode_documents` gives, digested where it is made."""
    return text_of(docs, F.col(id_col).cast("long").alias("doc_id"), text=text_col).mapInArrow(_encoded(model, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
