"""Token totals by source, language and tokenizer version, maintained by deltas.

A ledger is a folder in the shared file system::

    commits/<number>.json            names what commit <number> has written; made exclusively, last
    deltas/files=<name>/             signed totals of one batch, by source, lang and tokenizer
    counts/files=<name>/bucket=<b>/  what each touched document counts as from this commit on

A batch has changes ``op, doc_id, source, lang, tokenizer, tokens``; op is ``put``
(insert, or revise what is there) or ``delete``.  Against the latest committed
counts each change becomes signed rows: minus what was counted, plus what is
counted now.  They are summed within tasks before any shuffle; only totals by source,
language and tokenizer move.  Totals of the ledger are the sums of all committed deltas, and are
never computed from documents again.

Counts lie in ``buckets`` by a hash of the document; a batch reads the buckets that it touches.  After
``compact_every`` commits a commit of another kind writes the latest counts and the totals as one, and what is older isn't read
any more (``vacuum`` deletes it).  So a batch's work grows with itself and its buckets, not with the ledger's history.

A batch id that is committed already is not applied again, whatever it holds, and files
that no commit names don't count: a batch that failed half-way or was sent twice
changes nothing.  Commits have consecutive numbers, and one writer only can make each: of writers that race, the second
finds its number taken, deletes what it wrote, and applies its batch again to what is committed then (or not at all, if that was the same batch).

Defined results: rows of a batch that share document and tokenizer are one change, a deletion
before a put, then the put with the most tokens (then least source and lang); deleting what isn't there changes nothing; null
sources and languages are groups of their own; changes with a null document or tokenizer are
ignored; null token counts are 0; groups whose documents have all gone aren't reported; an empty ledger has no
totals; other columns are ignored.  Texts of any length are counted whole, null ones as empty.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.exclusive import create_once
from .common import bounded, slices
from .pieces import codec
from .token_files import encoder

_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
_COUNT = "doc_id long, tokenizer string, source string, lang string, tokens long, live boolean, number long, bucket int"

#: Document ids up to this many (16 bytes each) are sent to every executor.
BROADCAST_IDS = 2_000_000
#: Tokenizer versions that count by a pattern, so that SQL can.
PATTERNS = {"words/1": r"[^\x20\x09-\x0D]+", "words/2": r"[\p{L}\p{N}]+"}


def counted(text: Column, tokenizer: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PATTERNS[tokenizer])).cast("long")


def _counter(words: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = encoder(words), codec(pieces)
        for rows, _, _ in slices(batches):
            texts = rows.column(3).to_pylist()
            sizes = [[len(ids) for ids in model.encode(texts)] for model in (first, second)]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(3)), *(pa.array(n, pa.int64()) for n in sizes)], names=["doc_id", "source", "lang", "words", "pieces"])

    return run


def puts(docs: DataFrame, words: str, pieces: str, versions: tuple[str, str]) -> DataFrame:
    """A put for each of the rows ``doc_id, source, lang, text`` and each of two tokenizers: the word-level one of the file ``words``
    and the merge-type one of the file ``pieces``, under their names ``versions``.  Both count in one pass over the texts."""
    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    counts = own.mapInArrow(_counter(words, pieces), "doc_id long, source string, lang string, words long, pieces long")
    each = F.inline(F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.col(column).alias("tokens")) for name, column in zip(versions, ("words", "pieces")))))
    return counts.select(F.lit("put").alias("op"), "doc_id", "source", "lang", each)


class TokenLedger:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, compact_every: int = 16):
        self.spark, self.folder, self.buckets, self.compact_every = spark, folder, buckets, compact_every
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ commits

    def _entry(self, path) -> dict | None:
        stream = self._store.open(path)
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text.endswith("\n") else None  # else it is being written

    def commits(self) -> list[dict]:
        """Of each commit its number, batch id (null: a compaction), files and number of buckets, in order."""
        top = self._path(f"{self.folder}/commits")
        if not self._store.exists(top):
            return []
        paths = [status.getPath() for status in self._store.listStatus(top)]
        found = [self._entry(p) for p in paths if not p.getName().startswith(".")]
        return sorted((c for c in found if c), key=lambda c: c["number"])

    def _commit(self, batch: str | None, number: int, name: str) -> dict | None:
        """The commit ``number``, if it was made for ``batch`` and no other."""
        path = f"{self.folder}/commits/{number:012d}.json"
        if create_once(self.spark, path, json.dumps({"number": number, "batch": batch, "files": name, "buckets": self.buckets}) + "\n"):
            return None
        self._delete(name)
        return self._entry(self._path(path)) or {}

    def _delete(self, name: str) -> None:
        for kind in ("counts", "deltas"):
            self._store.delete(self._path(f"{self.folder}/{kind}/files={name}"), True)

    @staticmethod
    def _live(commits: list[dict]) -> list[dict]:
        """The last compaction and what follows it, or all."""
        first = max((k for k, c in enumerate(commits) if c["batch"] is None), default=0)
        return commits[first:]

    def _read(self, kind: str, schema: str, commits: list[dict]) -> DataFrame:
        paths = [f"{self.folder}/{kind}/files={c['files']}" for c in self._live(commits)]
        paths = [p for p in paths if self._store.exists(self._path(p))]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ state

    def _counts(self, commits: list[dict], buckets: list[int] | None = None) -> DataFrame:
        rows = self._read("counts", _COUNT, commits)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))  # other buckets' files aren't opened
        latest = F.max_by(F.struct("source", "lang", "tokens", "live"), "number")
        return rows.groupBy("doc_id", "tokenizer").agg(latest.alias("x")).where("x.live").select("doc_id", "tokenizer", "x.source", "x.lang", "x.tokens")

    def counts(self) -> DataFrame:
        """What each document counts as now, by tokenizer."""
        return self._counts(self.commits())

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens``."""
        return self._read("deltas", _DELTA, self.commits()).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")).where("docs <> 0 or tokens <> 0")

    # ------------------------------------------------------------ changes

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply and commit the changes under the id ``batch``; False if that id is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError("a batch id has letters, digits, points, dashes and underscores only")
        done = self.commits()
        if any(c["batch"] == batch for c in done):
            return False
        if done and done[0]["buckets"] != self.buckets:
            raise ValueError(f"the ledger has {done[0]['buckets']} buckets")
        row = F.struct((F.col("op") == "put").alias("put"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        rank = F.struct(F.col("row.put"), -F.col("row.tokens"), F.col("source"), F.col("lang"))
        wanted = changes.where("doc_id is not null and tokenizer is not null and op in ('put', 'delete')").select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "source", "lang", row.alias("row"))
        one = wanted.groupBy("doc_id", "tokenizer").agg(F.min_by(F.struct("row", "source", "lang"), rank).alias("new")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))
        # the batch itself is computed once, however many writers it races with
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        one.write.parquet(staged)
        try:
            one = self.spark.read.parquet(staged)
            touched = [r["bucket"] for r in one.select("bucket").distinct().collect()]  # ``buckets`` at most
            while True:
                name = uuid.uuid4().hex
                self._write(one, touched, done, len(done), name)
                other = self._commit(batch, len(done), name)
                if other is None:
                    break
                if other.get("batch") == batch:
                    return False
                done = self.commits()
                if any(c["batch"] == batch for c in done):
                    return False
        finally:
            self._store.delete(self._path(staged), True)
        if len(self._live(done)) >= self.compact_every:
            self.compact()
        return True

    def _write(self, one: DataFrame, touched: list[int], done: list[dict], number: int, name: str) -> None:
        old = self._counts(done, touched).select("doc_id", "tokenizer", F.struct("source", "lang", "tokens").alias("old"))
        both = one.join(old, ["doc_id", "tokenizer"], "left").where("new.row.put or old is not null")
        put = F.col("new.row.put")
        source, lang = F.when(put, F.col("new.source")).otherwise(F.col("old.source")), F.when(put, F.col("new.lang")).otherwise(F.col("old.lang"))
        rows = both.select("doc_id", "tokenizer", source.alias("source"), lang.alias("lang"), F.when(put, F.col("new.row.tokens")).otherwise(0).alias("tokens"), put.alias("live"), F.lit(number).cast("long").alias("number"), "old", "bucket")
        # written once with what was counted before, and read again for the deltas; Spark splits large buckets and joins small ones
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/counts/files={name}")
        written = self.spark.read.schema(_COUNT + ", old struct<source:string,lang:string,tokens:bigint>").parquet(f"{self.folder}/counts/files={name}")
        plus = written.where("live").select("source", "lang", "tokenizer", F.lit(1).alias("docs"), "tokens")
        minus = written.where("old is not null").select("old.source", "old.lang", "tokenizer", F.lit(-1).alias("docs"), (-F.col("old.tokens")).alias("tokens"))
        signed = plus.unionByName(minus).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        signed.write.parquet(f"{self.folder}/deltas/files={name}")

    def compact(self) -> bool:
        """A commit that stands for all before it; False if another writer committed meanwhile."""
        done = self.commits()
        if not done:
            return False
        name = uuid.uuid4().hex
        rows = self._counts(done).withColumns({"live": F.lit(True), "number": F.lit(len(done)).cast("long"), "bucket": F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")})
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/counts/files={name}")
        self.totals().write.parquet(f"{self.folder}/deltas/files={name}")
        return self._commit(None, len(done), name) is None

    def vacuum(self) -> int:
        """Deletes the files that a compaction stands for; for when no reader of an older state is left.  The number of commits whose files went."""
        done = self.commits()
        old = done[: len(done) - len(self._live(done))]
        for c in old:
            self._delete(c["files"])
        return len(old)
