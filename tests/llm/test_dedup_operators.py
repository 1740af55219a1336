"""Near duplicates, vectors, components and rollups against brute force, and on odd rows."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import embed_dedup, near_dup, token_ledger
from ledgerloom.llm.common import shared_folder
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.queries import QUERIES


def smallest(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


# ------------------------------------------------------------------ components


@pytest.mark.parametrize("together", [1_000_000, 100, 0])
def test_components_of_chains_stars_and_noise(spark, together):
    rng = np.random.default_rng(1)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(9, 9), (8, 7), (7, 8)]
    links += [tuple(map(int, x)) for x in rng.integers(1000, 1200, (150, 2))]
    rows = spark.createDataFrame(links + [(None, 3), (4, None)], "a long, b long").repartition(3)
    every = connected_components(rows, "a", "b", together).collect()
    found = {r["node"]: r["component"] for r in every}
    assert len(every) == len(found)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == smallest(nodes, [x for x in links if x[0] != x[1]])
    assert connected_components(rows.limit(0), "a", "b").count() == 0


# ------------------------------------------------------------------ near duplicates


def plain_near_duplicates(rows, n):
    sets = {}
    for doc, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        own = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
        sets.setdefault(doc, []).append(own)
    every = [(d, s) for d, many in sets.items() for s in many]
    links = []
    for k, (a, s) in enumerate(every):
        for b, t in every[k + 1 :]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                links.append((a, b))
    return smallest(sets, links), sets


@pytest.mark.parametrize("words,block,family", [(4, 512, 24), (5, 512, 24), (4, 3, 24), (4, 3, 1)])
def test_near_duplicates_equal_brute_force(spark, words, block, family):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: list(rng.choice(vocabulary, n))
    texts = []
    for _ in range(12):
        base = say(int(rng.integers(30, 120)))
        for _ in range(int(rng.integers(1, 14))):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(len(own)))] = "changed"
            texts.append(" ".join(own))
    texts += ["Same Text here again", "same text HERE\tagain\n", "two words", "Two  words", "", " ", "one"] * 2
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    config = near_dup.NearDupConfig(words=words, block_texts=block, family_blocks=family)
    expected, sets = plain_near_duplicates(rows, words)
    for r in near_dup.near_duplicates(frame, config).collect():
        doc = r["doc_id"]
        assert r["n_shingles"] == len(sets[doc][0]) and r["kept"] == (r["component_id"] == doc)
        assert r["component_id"] == (expected[doc] if sets[doc][0] else doc)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, None), (9, "A B C D E"), (4, "x" * 100_000), (5, " ".join(map(str, range(30_000)))), (6, " ".join(map(str, range(29_000))))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"norm": F.lit(1), "node": F.lit("x"), "component": F.lit(2), "bucket": F.lit(3)})
    found = near_dup.near_duplicates(frame).collect()
    assert len(found) == len(rows)
    component = {r["doc_id"]: r["component_id"] for r in found}
    assert component == {1: 1, 2: 2, 3: 3, None: None, 9: 3, 4: 4, 5: 5, 6: 5}
    assert [r["kept"] for r in found if r["doc_id"] is None] == [False, False]
    assert near_dup.near_duplicates(frame.limit(0)).count() == 0
    kept = near_dup.drop_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "3", "4", "5", "None", "None"]


def test_a_task_keeps_few_nodes_at_once(monkeypatch):
    import pyarrow as pa

    from ledgerloom.llm import components

    monkeypatch.setattr(components, "MOST_NODES", 10)
    links = [(k, k + 1) for k in range(100)] + [(3, 50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in links[k : k + 7]]), pa.array([b for _, b in links[k : k + 7]])], names=["a", "b"]) for k in range(0, 101, 7)]
    out = [(a, b) for batch in components.forest(iter(batches)) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
    assert smallest(range(101), out) == smallest(range(101), links)


def test_survivors_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    signs = []
    for share in np.linspace(0, 1, 40):
        own = base.copy()
        change = rng.random(400) > share
        own[change] = rng.integers(0, 2**63, int(change.sum()), dtype=np.uint64)
        signs.append((near_dup.minhashes(np.unique(own), 96), len(np.intersect1d(base, own)) / len(np.union1d(base, own))))
    alive, _ = near_dup.survivors(near_dup.minhashes(np.unique(base), 96), np.stack([s for s, _ in signs]), 0.8, 1e-5, 16)
    assert {k for k, (_, j) in enumerate(signs) if j >= 0.8} <= set(alive.tolist())
    assert not any(signs[k][1] < 0.4 for k in alive)


def test_links_and_their_forests_need_one_python_worker_a_core(spark, monkeypatch):
    # two Python operators in one stage take two workers for each core, which stay for all later stages
    plans, parts = [], near_dup.connected_components

    def seen(links, a, b):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return parts(links, a, b)

    monkeypatch.setattr(near_dup, "connected_components", seen)
    same = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, same), (2, same + " more"), (3, same), (4, "something else that is not the same")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert len(plans) == 2 and not [p for p in plans if "MapInArrow" in p]


def test_intermediate_tables_of_many_tasks_are_few_files(spark):
    # the JVM starts processes for each file that it makes, and each counts with all of its memory until it runs
    folder, cores = Path(shared_folder(spark).removeprefix("file:")), spark.sparkContext.defaultParallelism
    before = set(folder.rglob("rdd-*"))
    texts = [" ".join(f"w{k % 30}x{j}" for j in range(40)) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(64)
    kept = [r["doc_id"] for r in near_dup.drop_duplicates(docs).select("doc_id").collect()]
    assert sorted(kept) == list(range(30))
    made = [len(list(x.glob("part-*"))) for x in set(folder.rglob("rdd-*")) - before]
    assert len(made) > 5 and max(made) <= 2 * max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ------------------------------------------------------------------ vectors


def plain_vectors(rows, cosine=0.95):
    good, links, count = {}, [], {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    for k in good:
        for j in good:
            if k != j and len(good[k]) == len(good[j]) and good[k] @ good[j] >= cosine:
                links.append((rows[k][0], rows[j][0]))
                count[rows[k][0]] = count.get(rows[k][0], 0) + 1
    return count, smallest({i for i, _ in rows}, links)


@pytest.mark.parametrize("dims,cell_rows,block", [(8, 20, 2048), (32, 30, 7), (3, 1000, 2048)])
def test_vectors_equal_brute_force(spark, dims, cell_rows, block):
    rng = np.random.default_rng(dims)
    rows = []
    for k in range(160):
        v = rng.standard_normal(dims)
        rows.append(v)
        for _ in range(int(rng.integers(0, 4)) if k % 3 == 0 else 0):
            step = rng.standard_normal(dims)
            rows.append(v * rng.uniform(0.5, 2) + 0.15 * step * np.linalg.norm(v) / np.linalg.norm(step))
    rows += [rows[0], rows[0], rows[5]]
    ids = rng.permutation(len(rows)).tolist()
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    config = embed_dedup.EmbedConfig(cell_rows=cell_rows, block=block)
    count, component = plain_vectors(rows)
    for r in embed_dedup.near_vectors(frame, config).collect():
        v = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (count.get(v, 0), component[v], component[v] == v)


@pytest.mark.parametrize("dims, power, guests", [(64, 1.0, 4.0), (64, 0.5, 1e9), (64, 0.0, 1e9), (256, 1.0, 1e9)])
def test_vectors_that_differ_along_the_spectrum(spark, dims, power, guests):
    # neighbours differ most in the directions that the cells are cut in
    rng = np.random.default_rng(5)
    spectrum = np.arange(1, dims + 1) ** -power
    first = rng.standard_normal((2000, dims)) * spectrum
    step = rng.standard_normal((2000, dims)) * spectrum
    step *= np.tan(np.arccos(0.955)) * np.linalg.norm(first, axis=1, keepdims=True) / np.linalg.norm(step, axis=1, keepdims=True)
    rows = np.concatenate((first, first + step))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    near = rows @ rows.T >= 0.95
    assert near[np.arange(2000), np.arange(2000) + 2000].sum() > 800
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>").repartition(3)
    found = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(frame, embed_dedup.EmbedConfig(cell_rows=200, block=512, guests=guests)).collect()}
    assert len(embed_dedup.cells_for(rows, 20, embed_dedup.EmbedConfig(guests=guests))) == 20 or guests < 1e9
    expected = near.sum(axis=1) - 1
    assert found == {k: int(n) for k, n in enumerate(expected)}


def test_what_vectors_take_on_disk_does_not_grow_with_their_pairs(spark):
    def written():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()))

    rows = np.random.default_rng(8).standard_normal((3000, 64))
    rows[2990:] = rows[:10] * 2 + 0.01
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rows.tolist())], "vec_id long, embedding array<double>").repartition(3).cache()
    frame.count()
    before = written()
    found = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(frame, embed_dedup.EmbedConfig(block=32)).collect()}
    assert found == {k: int(k < 10 or k >= 2990) for k in range(3000)}
    assert written() - before < 4 * rows.nbytes


def test_tiles_hold_each_linked_pair_once():
    rng = np.random.default_rng(4)
    first = rng.standard_normal((600, 16))
    rows = np.concatenate((first, first + 0.07 * rng.standard_normal((600, 16))))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    centroids = embed_dedup.spherical_kmeans(rows, 40, 4)
    home = embed_dedup.homes(rows, centroids)
    blocks = []
    for k in range(3):
        own = np.flatnonzero(np.arange(len(rows)) % 3 == k)
        own = own[np.argsort(home[own], kind="stable")]
        cells, start = np.unique(home[own], return_index=True)
        blocks.append(embed_dedup.Block(own, np.ones(len(own), np.int64), rows[own], list(zip(cells.tolist(), start.tolist(), [*start[1:].tolist(), len(own)]))))
    seen = np.zeros((len(rows), len(rows)), int)
    for a in range(3):
        for b in range(a, 3):
            for left, right, same in embed_dedup.near_tiles(blocks[a], blocks[b], a == b, centroids, embed_dedup.EmbedConfig().reach, 16):
                x, y = blocks[a].ids[left], blocks[b].ids[right]
                seen[np.ix_(x, y)] += 1
                if not same:
                    seen[np.ix_(y, x)] += 1
    linked = rows @ rows.T >= 0.95
    np.fill_diagonal(linked, False)
    assert linked.sum() > 400 and (seen[linked] == 1).all()
    np.fill_diagonal(seen, 0)
    assert seen.max() == 1 and seen.sum() < 0.9 * seen.size


def test_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [1.0]), (None, [1.0, 0.0]), (10, [float("inf"), 0.0]), (11, [1e-300, 0.0]), (12, [1e200, 1e-5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "key": F.lit("x"), "cell": F.lit(2), "unit": F.lit(3)})
    found = embed_dedup.near_vectors(frame).collect()
    assert len(found) == len(rows)
    own = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert own == {1: (3, 1), 2: (3, 1), 11: (3, 1), 12: (3, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7), 8: (1, 8), 9: (1, 8), 10: (0, 10), None: (0, None)}
    assert embed_dedup.near_vectors(frame.limit(0)).count() == 0
    assert embed_dedup.near_vectors(frame.where("vec_id in (3, 4)")).count() == 2


def test_vectors_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    count, component = plain_vectors(rows)
    for r in QUERIES["op7_embedding_cells"](spark, sf).collect():
        assert (r["n_links"], r["component_id"]) == (count.get(r["vec_id"], 0), component[r["vec_id"]])


# ------------------------------------------------------------------ token rollups

SCHEMA = "op string, doc_id long, source string, lang string, tokenizer string, tokens long"


def totals(ledger):
    return sorted((tuple(r) for r in ledger.totals().collect()), key=str)


def test_rollups_follow_the_batches(spark, tmp_path):
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"))
    assert totals(ledger) == []
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    first = batch(("put", 1, "s", "en", "w/1", 10), ("put", 2, "s", "en", "w/1", 5), ("put", 1, "s", "en", "w/2", 12), ("put", 3, None, None, "w/1", None), ("put", None, "s", "en", "w/1", 99), ("put", 4, "s", "en", None, 99))
    assert ledger.apply("b1", first) and not ledger.apply("b1", batch(("put", 9, "s", "en", "w/1", 1)))
    assert totals(ledger) == sorted([("s", "en", "w/1", 2, 15), ("s", "en", "w/2", 1, 12), (None, None, "w/1", 1, 0)], key=str)
    # a revised count, a move to another source, a deletion, and a deletion of what isn't there
    assert ledger.apply("b2", batch(("put", 1, "s", "en", "w/1", 7), ("put", 2, "t", "en", "w/1", 5), ("delete", 3, None, None, "w/1", None), ("delete", 77, "s", "en", "w/1", None)))
    assert totals(ledger) == sorted([("s", "en", "w/1", 1, 7), ("t", "en", "w/1", 1, 5), ("s", "en", "w/2", 1, 12)], key=str)
    # rows of one batch for one document: the deletion wins, else the most tokens
    assert ledger.apply("b3", batch(("put", 1, "s", "en", "w/1", 8), ("delete", 1, None, None, "w/1", None), ("put", 2, "t", "en", "w/1", 6), ("put", 2, "t", "en", "w/1", 4)))
    assert totals(ledger) == sorted([("t", "en", "w/1", 1, 6), ("s", "en", "w/2", 1, 12)], key=str)
    assert ledger.apply("b4", first.limit(0)) and len(ledger.commits()) == 4
    with pytest.raises(ValueError):
        ledger.apply("no/slash", first)


def test_a_batch_that_fails_before_its_commit_counts_nothing(spark, tmp_path, monkeypatch):
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([("put", 1, "s", "en", "w/1", 10)], SCHEMA)
    monkeypatch.setattr(token_ledger, "create_once", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ledger.apply("b1", rows)
    assert totals(ledger) == []
    monkeypatch.undo()
    assert ledger.apply("b1", rows) and totals(ledger) == [("s", "en", "w/1", 1, 10)]
    # a second writer of the same batch finds its commit taken
    monkeypatch.setattr(ledger, "commits", lambda: [])
    assert not ledger.apply("b1", rows)
    monkeypatch.undo()
    assert totals(ledger) == [("s", "en", "w/1", 1, 10)]


def test_racing_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "ledger")
    rows = [[("put", d, "s", "en", "w/1", 10 * k + d) for d in range(k, k + 4)] for k in range(5)]

    def write(k):
        return token_ledger.TokenLedger(spark, folder, buckets=4, compact_every=3).apply(f"b{k % 5}", spark.createDataFrame(rows[k % 5], SCHEMA))

    with ThreadPoolExecutor(7) as pool:
        done = list(pool.map(write, range(7)))  # two batches are sent twice
    ledger = token_ledger.TokenLedger(spark, folder, buckets=4)
    commits = ledger.commits()
    assert sum(done) == 5 and [c["number"] for c in commits] == list(range(len(commits)))
    state = {}
    for c in commits:
        if c["batch"]:
            state.update({d: n for _, d, _, _, _, n in rows[int(c["batch"][1])]})
    assert totals(ledger) == [("s", "en", "w/1", len(state), sum(state.values()))]
    assert {r["doc_id"]: r["tokens"] for r in ledger.counts().collect()} == state


def test_compaction_and_touched_buckets(spark, tmp_path):
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), buckets=8, compact_every=3)
    state = {}
    for k in range(8):
        rows = [("put", d, f"s{d % 2}", "en", "w/1", k + d) for d in range(3 * k, 3 * k + 9)] + [("delete", 3 * k - 1, None, None, "w/1", None)]
        assert ledger.apply(f"b{k}", spark.createDataFrame(rows, SCHEMA))
        state.update({d: k + d for d in range(3 * k, 3 * k + 9)})
        state.pop(3 * k - 1, None)
        expected = {}
        for d, n in state.items():
            many, all_ = expected.get(f"s{d % 2}", (0, 0))
            expected[f"s{d % 2}"] = (many + 1, all_ + n)
        assert totals(ledger) == sorted([(s, "en", "w/1", *x) for s, x in expected.items()], key=str)
    commits = ledger.commits()
    assert sum(c["batch"] is None for c in commits) >= 2 and not ledger.apply("b0", spark.createDataFrame(rows, SCHEMA))
    before = totals(ledger)
    assert ledger.vacuum() > 0 and totals(ledger) == before and not (tmp_path / "ledger" / "counts" / f"files={commits[0]['files']}").exists()
    assert {r["doc_id"]: r["tokens"] for r in ledger.counts().collect()} == state
    plan = ledger._counts(commits, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(ValueError):
        token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), buckets=9).apply("x", spark.createDataFrame(rows, SCHEMA))


def test_rollups_equal_sql_on_repeated_ids(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    rows = [("put" if rng.random() < 0.8 else "delete", int(rng.integers(0, 20)), rng.choice(["s", "t"]), rng.choice(["en", None]), rng.choice(["w/1", "w/2"]), int(rng.integers(0, 9))) for _ in range(300)]
    rows = [(op, d, str(s), lang, str(t), n) for op, d, s, lang, t, n in rows]
    ledger = token_ledger.TokenLedger(spark, str(tmp_path / "ledger"), buckets=4)
    for k in range(3):
        ledger.apply(f"b{k}", spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE changes (batch INT, op VARCHAR, doc_id BIGINT, source VARCHAR, lang VARCHAR, tokenizer VARCHAR, tokens BIGINT)")
    duck.executemany("INSERT INTO changes VALUES (?, ?, ?, ?, ?, ?, ?)", [(k // 100, *r) for k, r in enumerate(rows)])
    sql = """
    WITH one AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY batch, doc_id, tokenizer ORDER BY op = 'put', -tokens, source, lang NULLS FIRST) = 1),
    last AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY doc_id, tokenizer ORDER BY batch DESC) = 1)
    SELECT source, lang, tokenizer, count(*), sum(tokens)::BIGINT FROM last WHERE op = 'put' GROUP BY ALL"""
    assert totals(ledger) == sorted(duck.execute(sql).fetchall(), key=str)


def test_rollups_of_the_table_equal_the_libraries(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    words, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, bad = {r["doc_id"] for r in labels if r["toxic"] == 1}, {r["doc_id"] for r in labels if r["quality"] == 0}
    expected = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r["doc_id"] in bad:
            continue
        text = r["text"] or ""
        text = re.sub("[0-9]+", " ", text) if r["doc_id"] in toxic else text
        for name, n in (("word_bpe_49k", len(words.encode(text, add_special_tokens=False).ids)), ("piece_bpe_32k", len(pieces.encode(text)))):
            many, all_ = expected.get((r["source"], r["lang"], name), (0, 0))
            expected[r["source"], r["lang"], name] = (many + 1, all_ + n)
    assert toxic and bad
    assert sorted((tuple(r) for r in QUERIES["op8_token_rollups"](spark, sf).collect()), key=str) == sorted(((*k, *v) for k, v in expected.items()), key=str)


def test_counts(spark):
    rows = spark.createDataFrame([("a b\tc\n d",), (None,), ("",), ("don't 12é",)], "t string")
    assert [r[0] for r in rows.select(token_ledger.counted(F.col("t"), "words/1")).collect()] == [4, 0, 0, 2]
    assert [r[0] for r in rows.select(token_ledger.counted(F.col("t"), "words/2")).collect()] == [4, 0, 0, 3]
