"""The pipeline's stages: what they drop, what they keep, and awkward rows."""

import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm import library_ids

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with awkward documents added, under columns that clash with what operators return."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    item = spark.read.parquet(f"{SOURCE}/benchmark.parquet").orderBy("item_id").first().text
    some = [r.text for r in docs.orderBy("doc_id").limit(40).collect() if r.lang == "en" and len(r.text.split()) > 120][:2]
    words = some[0].split(" ")
    near = " ".join([*words[:50], "changed", *words[51:]])
    rows = [
        (900001, None), (900002, ""), (900003, "12 !?"), (900004, some[1]), (900005, near), (900006, f"{some[1]} {item}"), (900007, some[1] + " tail of words"),
        (900008, "the and of in to is that it " * 3000), (900009, "the and of in to was that it for"), (900009, "the and of in to was that it for"),
    ]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    docs.unionByName(extra).selectExpr("*", "1 as score", "true as rejected", "'x' as component_id", "2 as row", "3 as item_id").repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def staged(spark, folder):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != "packing":
            assert made.columns == docs.columns
        made.write.parquet(f"{folder}/out-{name}")
        made = spark.read.parquet(f"{folder}/out-{name}")
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return {name: (before, after) for name, before, after in out}


def ids(rows):
    return [r.doc_id for r in rows]


def test_toxic_documents_go(spark, staged):
    before, after = staged["toxicity"]
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SOURCE}/labels.parquet").collect()}
    kept = set(ids(after))
    right = np.mean([(i in kept) == (label[i] == 0) for i in ids(before) if i in label])
    clean = np.mean([i in kept for i in ids(before) if label.get(i) == 0])
    assert {900001, 900002, 900009} <= kept
    assert right > 0.8 and clean > 0.9, (right, clean)  # some seventy labels here; larger tables do far better


def test_texts_without_letters_go(staged):
    before, after = staged["language"]
    gone = set(ids(before)) - set(ids(after))
    assert {900001, 900002} <= gone
    assert len(gone) <= 3 and ids(after).count(900009) == 2


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_one_of_each_group_stays(staged):
    before, after = staged["near-duplicates"]
    kept, text = set(ids(after)), {r.doc_id: r.text for r in before}
    assert len(ids(after)) == len(kept) and 900009 in kept
    sets = {i: shingles(t) for i, t in text.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    order = sorted(text)
    pairs = [(a, b, like(a, b)) for k, a in enumerate(order) for b in order[k + 1 :]]
    assert not [p for p in pairs if p[2] > 0.87 and p[0] in kept and p[1] in kept]
    close = {i for a, b, s in pairs if s > 0.7 for i in (a, b)}
    assert set(order) - close <= kept


def test_benchmark_items_go(spark, staged):
    before, after = staged["decontamination"]
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{SOURCE}/benchmark.parquet").collect()]
    gone = set(ids(before)) - set(ids(after))
    holding = {r.doc_id for r in before if any(i in flat(r.text) for i in items)}
    assert holding <= gone and 900006 not in ids(after) and len(gone) <= len(holding) + 1


def test_packing_holds_every_id_once(staged):
    import public_tokenizers

    before, after = staged["packing"]
    text = {r.doc_id: r.text for r in before}
    by: dict = {}
    for r in sorted(after, key=lambda r: r.start):
        by.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert set(by) == set(text)
    for i in sorted(text)[:40]:
        assert np.frombuffer(b"".join(by[i]), "<u4").tolist() == library_ids(public_tokenizers.path("word_bpe_49k.json"), text[i], 1)


def test_run_and_empty(spark, folder, staged, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() == len(staged["packing"][1])
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
