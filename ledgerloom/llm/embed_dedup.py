"""Near-duplicate vectors: spherical k-means cells, blocked cosine products of what is near the planes between them.

1. Equal vectors become one class, represented by the least id, with a multiplicity.
2. Spherical k-means, fitted on a bounded sample by hash order (``sample``), gives the cells, one for each ``cell_rows``
   classes, ``cells_a_sample`` times the sample at most.  Every class goes to the cell of its nearest centroid.
3. Cells are packed into blocks of bounded size, larger cells cut into several, and each class is written once, to its
   block's folder in the shared folder.  A task gets a tile of pairs of blocks, a few numbers, and reads them: what is
   stored grows with the vectors, not with the pairs.
4. Of two cells, a linked pair's steps from the bisecting plane add up to ``reach`` at most.  Rows are
   sorted by their step and multiplied only with those whose step leaves them in reach; within a cell all are.
   No pair is emitted: a tile gives each class its number of links and, for each part that its links connect, a forest.
5. Forests make components; counts are added up.

Two unit vectors of cosine t are 2 - 2t apart, squared.  ``reach`` is that distance in any number of dimensions, as
the steps of a linked pair to a plane between them are never longer together: no pair is lost, whatever direction it differs in.
The more cells, the fewer products are left; their number still grows faster than the vectors.

Defined results: null, zero or empty vectors and those with a null or non-finite component
are linked with nothing, nor are vectors of different length.  Rows that share an id are one node; a null id is linked
with nothing, has a null component and isn't kept.  A vector that is equally near to centroids is at home with the first.  An empty table gives an empty result; columns other than
id and vector are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, delete_folder, fresh_folder
from .components import connected_components, forest


@dataclass(frozen=True)
class EmbedConfig:
    cosine: float = 0.95
    sample: int = 20_000
    cell_rows: int = 1500
    cells_a_sample: float = 0.25
    rounds: int = 8
    guests: float = math.inf  # the number of cells is halved while a vector is near the planes of more cells on average
    block: int = 2048
    block_bytes: int = 8 << 20  # as doubles; blocks grow to that size with the vectors
    tiles: int = 64  # of blocks, either way

    @property
    def reach(self) -> float:
        return (2 - 2 * self.cosine) ** 0.5 * (1 + 1e-9)


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles of length 1; None for one that can't be compared."""
    out: list[np.ndarray | None] = []
    values = column.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    sizes = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    for n, e in zip(sizes.tolist(), ends.tolist()):
        v = flat[e - n : e]
        if not n or not np.isfinite(v).all():
            out.append(None)
            continue
        top = np.abs(v).max()
        if not top:
            out.append(None)
            continue
        v = v / top
        out.append(v / np.sqrt(v @ v))
    return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        column = batch.column(1)
        rows = unit_rows(column)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        flat = flat.astype("<f4" if column.type.value_type == pa.float32() else "<f8")
        ends = np.cumsum([n or 0 for n in pa.compute.list_value_length(column).to_pylist()]).tolist()
        raw = [None if v is None else flat[e - len(v) : e].tobytes() for v, e in zip(rows, ends)]
        key = [None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary()), pa.array([0 if v is None else len(v) for v in rows], pa.int32())], names=["vec_id", "key", "raw", "dims"])


def unit_matrix(raw: list[bytes], dims: int) -> np.ndarray:
    """Vectors of one length, kept as they were given, as rows of length 1."""
    rows = np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dims else "<f8").astype(np.float64).reshape(len(raw), dims)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return rows


def homes(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each row's nearest centroid."""
    return np.concatenate([(rows[a : a + 1024] @ centroids.T).argmax(axis=1) for a in range(0, len(rows), 1024)])


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k unit centroids; empty cells keep theirs."""
    rng = np.random.default_rng(11)
    centroids = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        cell = homes(rows, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, rows)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, total / np.maximum(size, 1e-300), centroids)
    return centroids


def _apart(centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (centroids @ centroids.T), 1e-24))


def _guest_at(rows: np.ndarray, centroids: np.ndarray, apart: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's home, and rows x cells: where it is a guest."""
    near = rows @ centroids.T
    home = near.argmax(axis=1)
    gap = (near[np.arange(len(rows)), home][:, None] - near) / apart[home]
    return home, (gap <= reach) & (np.arange(len(centroids))[None, :] < home[:, None])


def cells_for(sample: np.ndarray, k: int, config: EmbedConfig) -> np.ndarray:
    """Centroids: k of them, or fewer if too many vectors would be guests."""
    while True:
        centroids = spherical_kmeans(sample, k, config.rounds)
        some = sample[:4000]
        if k == 1 or config.guests >= k or _guest_at(some, centroids, _apart(centroids), config.reach)[1].sum() <= config.guests * len(some):
            return centroids
        k = max(1, k // 2)


def placed(sizes: list[float], rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each cell's first block, its number of blocks, and the number of all blocks; small neighbours share one."""
    first, parts, block, room = [], [], -1, 0.0
    for size in sizes:
        many = max(1, math.ceil(size / rows))
        if many == 1 and size <= room:
            room -= size
        else:
            block += 1
            room = rows - size if many == 1 else 0.0
        first.append(block)
        parts.append(many)
        block += many - 1
    return np.array(first, np.int64), np.array(parts, np.int64), block + 1


def _dealer(centroids: np.ndarray, first: np.ndarray, parts: np.ndarray, others: dict[int, tuple[int, int]]):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, raw, wide = (batch.column(i).to_pylist() for i in (1, 3, 4))
            cell = -np.array(wide, np.int64)  # vectors of another length are a cell of their own
            main = np.flatnonzero(cell == -dims)
            for a in range(0, len(main), 1024):
                some = main[a : a + 1024]
                cell[some] = homes(unit_matrix([raw[i] for i in some], dims), centroids)
            block = []
            for c, k in zip(cell.tolist(), key):
                base, many = (int(first[c]), int(parts[c])) if c >= 0 else others[-c]
                block.append(base + int.from_bytes(k[:6], "little") % many)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(cell), pa.array(block, pa.int64())], names=["vec_id", "times", "raw", "dims", "cell", "block"])

    return run


def block_products(one: np.ndarray, two: np.ndarray, times_one: np.ndarray, times_two: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of either side and ties (positions; side two after side one) that connect what is linked."""
    near = np.empty((len(one), len(two)), bool)
    for a in range(0, len(one), 256):  # the products themselves are never held whole
        np.greater_equal(one[a : a + 256] @ two.T, cosine, out=near[a : a + 256])
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return np.zeros(len(one), np.int64), np.zeros(len(two), np.int64), []
    count_one = near @ times_two
    count_two = np.zeros(len(two), np.int64) if same else times_one @ near
    ties, n = [], len(one)
    fresh_one = near.any(axis=1)
    fresh_two = near.any(axis=0)
    for i in range(n):
        if not fresh_one[i]:
            continue
        fresh_one[i] = False
        front = np.array([i])
        while len(front):
            reached = near[front].any(axis=0) & fresh_two
            fresh_two &= ~reached
            right = np.flatnonzero(reached)
            ties += [(i, j if same else n + j) for j in right.tolist() if not (same and j == i)]
            if not len(right):
                break
            front = right if same else np.flatnonzero(near[:, right].any(axis=1) & fresh_one)
            if same:
                front = front[fresh_one[front]]
            else:
                ties += [(i, j) for j in front.tolist()]
            fresh_one[front] = False
    return count_one, count_two, ties


@dataclass
class Block:
    """Rows sorted by cell."""

    ids: np.ndarray
    times: np.ndarray
    rows: np.ndarray
    cells: list[tuple[int, int, int]]  # cell, from, to

    @classmethod
    def read(cls, folder: str, number: int) -> Block | None:
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        store, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/block={number}"
        if store.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        table = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["vec_id", "times", "raw", "dims", "cell"])
        cell = table.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        rows = unit_matrix(table.column("raw").to_pylist(), table.column("dims")[0].as_py())[order]
        found, start = np.unique(cell[order], return_index=True)
        ends = [*start[1:].tolist(), len(cell)]
        return cls(table.column("vec_id").to_numpy()[order], table.column("times").to_numpy()[order], rows, list(zip(found.tolist(), start.tolist(), ends)))


def near_tiles(one: Block, two: Block, same: bool, centroids: np.ndarray, reach: float, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Positions in either block that have to be multiplied with each other (the last: one part with itself): every linked pair is in exactly one."""
    main = one.cells[0][0] >= 0 and two.cells[0][0] >= 0
    if main:
        to_two = one.rows @ centroids[[c for c, _, _ in two.cells]].T
        to_one = two.rows @ centroids[[c for c, _, _ in one.cells]].T
        at_one = {c: k for k, (c, _, _) in enumerate(one.cells)}
    for k, (c, a, b) in enumerate(one.cells):
        for m, (d, x, y) in enumerate(two.cells):
            if c == d:
                for p in range(a, b, rows):
                    some = np.arange(p, min(b, p + rows))
                    if same:
                        yield some, some, True
                    for q in range(some[-1] + 1 if same else x, y, 4 * rows):
                        yield some, np.arange(q, min(y, q + 4 * rows)), False
                continue
            if not main or same and m < k:
                continue
            # products with the centroids' difference; both are 0 or more, and a linked pair's add up to limit at most
            limit = reach * float(np.linalg.norm(centroids[c] - centroids[d])) + 1e-9
            left = one.rows[a:b] @ centroids[c] - to_two[a:b, m]
            right = two.rows[x:y] @ centroids[d] - to_one[x:y, at_one[c]]
            here = np.flatnonzero(left <= limit - right.min())
            there = np.flatnonzero(right <= limit - left.min())
            if not len(here) or not len(there):
                continue
            here, there = here[np.argsort(left[here], kind="stable")], there[np.argsort(right[there], kind="stable")]
            steps = right[there]
            for p in range(0, len(here), 256):
                some = here[p : p + 256]
                upto = int(np.searchsorted(steps, limit - left[some[0]], "right"))
                for q in range(0, upto, 4 * rows):
                    yield some + a, there[q : min(upto, q + 4 * rows)] + x, False


def _multiplier(folder: str, centroids: np.ndarray, config: EmbedConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in zip(*(c.to_pylist() for c in batch.columns)):
                yield from multiply(*tile)

    def multiply(low: int, high: int, second: int, last: int) -> Iterator[pa.RecordBatch]:
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ties = []
        for i in range(low, high):
            one = Block.read(folder, i)
            if one is None:
                continue
            for j in range(max(i, second), last):
                two = one if i == j else Block.read(folder, j)
                if two is None:
                    continue
                for n, block in ((i, one), (j, two)):
                    counts.setdefault(n, (block.ids, np.zeros(len(block.ids), np.int64)))
                first, other = [], []
                for left, right, same in near_tiles(one, two, i == j, centroids, config.reach, config.block):
                    a, b, found = block_products(one.rows[left], two.rows[right], one.times[left], two.times[right], same, config.cosine)
                    counts[i][1][left] += a
                    if not same:
                        counts[j][1][right] += b
                    if found:
                        both = one.ids[left] if same else np.concatenate((one.ids[left], two.ids[right]))
                        first.append(both[[x for x, _ in found]])
                        other.append(both[[y for _, y in found]])
                if first:
                    ties.append(pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(other))], names=["a", "b"]))
                    if sum(t.num_rows for t in ties) > 1_000_000:
                        ties = list(forest(iter(ties)))
        for ids, n in counts.values():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(n[some])], names=["a", "b", "n"])
        for part in forest(iter(ties)):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.zeros(part.num_rows, np.int64))], names=["a", "b", "n"])

    return run


def block_tiles(first: int, last: int, most: int) -> list[tuple[int, int, int, int]]:
    """Tiles that hold each pair of blocks once, a tile's pairs of lower number first."""
    step = max(1, (last - first) // most)
    return [(a, min(last, a + step), b, min(last, b + step)) for a in range(first, last, step) for b in range(a, last, step)]


def near_vectors(vectors: DataFrame, config: EmbedConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``vectors``."""
    config = config or EmbedConfig()
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"  # kept as given, which is smaller
    own = bounded(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    known = own.mapInArrow(_prepare, "vec_id long, key binary, raw binary, dims int")
    ready = cut(known.select("vec_id", "key"))
    valid = ready.where("key is not null and vec_id is not null")
    classes = cut(known.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times"), F.first("raw").alias("raw"), F.first("dims").alias("dims")))
    lengths = [(r["dims"], r["count"]) for r in classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").collect()]
    if lengths:
        dims, n = lengths[0]
        sample = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("vec_id"), "vec_id").limit(config.sample).select("raw").collect()
        rows = unit_matrix([bytes(r["raw"]) for r in sample], dims)
        k = max(1, min(int(config.cells_a_sample * len(rows)), n // config.cell_rows))
        centroids = cells_for(rows, k, config)
        # cells' sizes are those of the sample
        sizes = np.bincount(homes(rows, centroids), minlength=len(centroids)) * (n / len(rows))
        size = max(1, min(max(4 * config.block, n // config.tiles), config.block_bytes // (8 * dims)))
        first, parts, blocks = placed(sizes.tolist(), size)
        tiles, others = block_tiles(0, blocks, config.tiles), {}
        for wide, many in lengths[1:]:
            others[wide] = (blocks, math.ceil(many / max(1, min(size, config.block_bytes // (8 * wide)))))
            tiles += block_tiles(blocks, blocks + others[wide][1], config.tiles)
            blocks += others[wide][1]
        spark = vectors.sparkSession
        folder = fresh_folder(spark, "vector-blocks")
        dealt = classes.select("vec_id", "key", "times", "raw", "dims").mapInArrow(_dealer(centroids, first, parts, others), "vec_id long, times long, raw binary, dims int, cell long, block long")
        dealt.repartition("block").write.partitionBy("block").parquet(f"{folder}/blocks")
        asked = spark.createDataFrame(tiles, "low long, high long, second long, last long").repartition(min(len(tiles), max(24, n // 20_000)))
        found = cut(asked.mapInArrow(_multiplier(f"{folder}/blocks", centroids, config), "a long, b long, n long"))
        delete_folder(spark, folder)
    else:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    counts = found.where("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    copies = valid.join(classes.select("key", F.col("vec_id").alias("first")), "key").where("vec_id > first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    parts = connected_components(found.where("b is not null").select("a", "b").unionByName(copies), "a", "b")
    linked = classes.select("key", F.col("vec_id").alias("first"), "times").join(counts, "first", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    joined = ready.select("vec_id", "key").join(linked, "key", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
