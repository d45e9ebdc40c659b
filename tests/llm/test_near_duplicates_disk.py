"""What near-duplicates leave on disk: rows of tries, texts of regions, files of finished steps."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from tracewell.llm import simhash
from tracewell.llm._shared import materialise
from tracewell.llm.simhash import near_duplicates, windows_needed


def crowd(seed: int) -> list[tuple[int, str]]:
    """Families of texts of all degrees of likeness, some large, and two rows of one id."""
    r = np.random.default_rng(seed)
    rows = []
    for family in range(12):
        base = r.choice([f"w{k}" for k in range(4000)], 200).tolist()
        for _ in range(int(r.integers(1, 6)) if family else 40):
            text = list(base)
            for at in r.integers(0, 200, int(r.integers(0, 7))):
                text[at] = f"z{r.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(text)))
    return [*rows, (3, rows[60][1])]


def components(rows: list[tuple[int, str]]) -> dict[int, int]:
    bags = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for _, t in rows]
    label = {k: k for k, _ in rows}
    for i, x in enumerate(bags):
        for j, y in enumerate(bags[:i]):
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                low, high = sorted((label[rows[i][0]], label[rows[j][0]]))
                label = {k: low if at == high else at for k, at in label.items()}
    return label


@pytest.mark.parametrize("most", [1, 3, 64])
def test_regions_of_any_size_against_brute_force(spark, monkeypatch, most):
    """Regions compared in one place and regions cut into cells give the components of all pairs."""
    monkeypatch.setattr(simhash, "REGION", most)
    rows = crowd(4)[:-1]
    want = components(rows)
    assert 1 < len(set(want.values())) < len(want) - 20
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_a_text_of_a_small_region_is_not_sent_pair_by_pair(spark, monkeypatch):
    """Texts of small regions are dealt out by region, each once; a row that repeats an id with another text has its own class."""
    monkeypatch.setattr(simhash, "alike", lambda *a: pytest.fail("texts were joined to pairs"))
    rows = crowd(4)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 3").collect()
    want = components(rows[:-1])
    assert sorted(x.component_id for x in got) == sorted({want[3], min(3, want[60])})


def test_rows_of_tries_stay_below_three_times_the_input(spark, monkeypatch):
    """At 30 GB of texts of 2,200 bytes; what a window sends of a document is a 32-byte fingerprint and two numbers."""
    keys = 30e9 / 2200
    window = round(math.log2(keys / simhash.NEAR_SUBTREE))
    assert windows_needed(0.8, window) * (8 * simhash.SENT_WORDS + 12) < 3 * 2200


def test_tables_leave_no_shuffle_files(spark):
    """Files of a finished step are deleted, and the session's setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)

    def files() -> set[str]:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_") and n.endswith(".data")}

    old = files()
    got = materialise(spark.range(5000).repartition(7, "id"), "numbers")
    for _ in range(50):
        if not files() - old:
            break
        time.sleep(0.2)
    assert not files() - old and got.count() == 5000 and spark.conf.get(key) == before
