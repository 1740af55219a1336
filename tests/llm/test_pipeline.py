"""The pipeline's stages, one after another, against brute force."""

import base64
import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from ledgerloom.llm import secrets
from tests.llm.test_dedup_operators import plain_near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def rows_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns_stay_until_the_last_stage(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_language_keeps_clean_documents(stages):
    assert rows_of(stages[1]) == {d: t for d, t in rows_of(stages[0]).items() if re.search(r"[^\W\d_]", t or "")}


def test_near_duplicates_leave_one_of_each_group(stages):
    before = rows_of(stages[1])
    component, _ = plain_near_duplicates(list(before.items()), 5)
    assert rows_of(stages[2]) == {d: t for d, t in before.items() if component[d] == d}


def test_leaking_documents_go(spark, stages):
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [f" {words(r['text'])} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows_of(stages[2])
    assert rows_of(stages[3]) == {d: t for d, t in before.items() if not any(i in f" {words(t)} " for i in items)}


def test_secrets_are_gone(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert before.keys() == after.keys()
    key = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}""", re.I | re.A)
    for doc, text in after.items():
        assert text == before[doc] or "[SECRET]" in text
        assert not re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", text)
    assert any(key.search(t) for t in before.values()) and secrets.KINDS[0] == "assign"


def test_pieces_equal_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = rows_of(stages[4])
    for r in stages[5].collect():
        assert r["ids"] == [1, *library.encode(texts[r["doc_id"]]), 2] and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == library.decode(r["ids"])


def test_run_equals_the_stages(spark, stages):
    own = sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert own == sorted((r["doc_id"], tuple(r["ids"])) for r in stages[-1].collect())


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_language_rejects_foreign_texts_and_gibberish(spark):
    rng = random.Random(1)
    odd = {
        "ru": "Москва является столицей России и крупнейшим по численности населения городом страны. Город расположен на западе России.",
        "zh": "北京是中华人民共和国的首都，是全国的政治中心、文化中心，也是世界著名古都和现代化国际城市。",
        "el": "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και μία από τις αρχαιότερες πόλεις του κόσμου.",
        "ar": "القاهرة هي عاصمة جمهورية مصر العربية وأكبر مدنها من حيث عدد السكان والمساحة، وتقع على ضفتي نهر النيل.",
        "fi": "Helsinki on Suomen pääkaupunki ja väkiluvultaan suurin kaupunki. Kaupunki sijaitsee Suomenlahden rannalla ja siellä asuu yli kuusisataatuhatta ihmistä.",
        "pl": "Warszawa jest stolicą Polski i największym miastem kraju, położonym nad Wisłą. Większość zabytków została zniszczona podczas wojny.",
        "tr": "Ankara, Türkiye'nin başkenti ve en kalabalık ikinci şehridir. Şehir, ülkenin kuzeybatısında yer almakta olup büyük önem taşımaktadır.",
        "consonants": " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(60)),
        "base64": base64.b64encode(rng.randbytes(400)).decode(),
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(odd.values())], "doc_id long, text string, lang string")
    kept = rows_of(corpus_pipeline.identify_language(spark, docs.unionByName(more), ""))
    assert [name for k, name in enumerate(odd) if -1 - k in kept] == []
    assert kept == {d: t for d, t in rows_of(docs).items() if re.search(r"[^\W\d_]", t or "")}
