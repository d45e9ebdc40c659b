"""Rows that near-duplicates send to tries: as many a text at any size, and what becomes of tries that many texts share."""

from __future__ import annotations

import numpy as np
import pytest

from tests.llm.test_near_duplicates_disk import components, crowd
from tracewell.llm import simhash
from tracewell.llm.simhash import Bags, least_values, near_duplicates, near_links, small_links, values_needed


@pytest.fixture
def dealt(spark, monkeypatch):
    """The numbers of rows that were dealt out by trie."""
    made, kind = [], type(spark.range(1))
    real = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *a: (made.append(df.count()) if "tree" in df.columns else None, real(df, *a))[1])
    return made


def test_rows_of_tries_grow_with_the_texts(spark, monkeypatch, dealt):
    """Ten times the texts make ten times the rows, where tables are large for their tries."""
    monkeypatch.setattr(simhash, "NEAR_SUBTREE", 16)
    r = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{a}" for a in r.integers(0, 5000, 60))) for k in range(1000)]
    for n in (100, 1000):
        near_duplicates(spark.createDataFrame(rows[:n], "doc_id long, text string"))
    assert dealt == [100 * values_needed(0.8), 1000 * values_needed(0.8)]


def test_bags_of_the_similarity_agree_as_drawn_at_random():
    """In the square of their similarity of the values; all values apart is as rare as independent draws make it."""
    r, count = np.random.default_rng(3), values_needed(0.8)
    for n, shared in ((18, 16), (180, 160)):
        agree = []
        for _ in range(2000):
            e = r.integers(0, 1 << 64, 2 * n - shared, dtype=np.uint64)
            agree.append(int((least_values(e[:n], count) == least_values(e[n - shared :], count)).sum()))
        assert abs(np.mean(agree) / count - 0.64) < 0.01 and abs(np.var(agree) / count - 0.64 * 0.36) < 0.03 and min(agree) > 0


def test_small_tries_at_once_give_what_each_gives():
    r = np.random.default_rng(4)
    starts, n = np.cumsum([0, 3, 1, 40, 64]), 110
    keys, size = r.integers(0, 1 << 64, n, dtype=np.uint64), r.integers(8, 12, n)
    near = r.integers(0, 1 << 64, n, dtype=np.uint64) & r.integers(0, 1 << 64, n, dtype=np.uint64) & r.integers(0, 1 << 64, n, dtype=np.uint64)
    keys[:] = keys[0] ^ near
    wide = np.stack([keys, keys ^ np.roll(near, 1)], axis=1)
    ends = np.r_[starts[1:], n]
    budget = np.array([20, 20, 64, 20, 64])
    got = small_links(starts, ends, keys, wide, size, budget, 0.8, 40)
    want: list[np.ndarray] = []
    for a, b, most in zip(starts, ends, budget, strict=True):
        at = a + np.argsort(keys[a:b], kind="stable")
        if b - a > 1:
            i, j = near_links(keys[at], wide[at], size[at], int(most), 0.8, 40)
            want += [np.stack([at[i], at[j]])]
    forests = [simhash.Forest(n), simhash.Forest(n)]
    forests[0].add(*got)
    forests[1].add(*np.concatenate(want, axis=1))
    assert np.array_equal(forests[0].root, forests[1].root) and len(set(forests[0].root.tolist())) < n


def test_tries_that_many_texts_share_are_dealt_out_once_more(spark, monkeypatch, dealt):
    """A passage in most texts: its tries are cut by windows, and the components are those of all pairs."""
    rows = crowd(7)[:-1]
    passage = " ".join(f"p{k}" for k in range(100))
    r = np.random.default_rng(8)
    for _ in range(40):
        base = r.choice([f"v{k}" for k in range(4000)], 60).tolist()
        rows += [(len(rows) + k, " ".join([passage, *base[: 60 - 5 * k], *(f"y{len(rows)}-{j}" for j in range(5 * k))])) for k in range(2)]
    want = components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot, subtree in ((65536, 8192), (10, 4)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "NEAR_SUBTREE", subtree)
        assert {x.doc_id: x.component_id for x in near_duplicates(docs).collect()} == want
    assert dealt[1] > 1.5 * dealt[0]


def test_long_and_short_bags_have_values():
    bags = Bags(5)
    long = bags.bag(" ".join(f"a{k}" for k in range(9000)))
    values = least_values(long, 14)
    assert np.array_equal(values, least_values(long[::-1].copy(), 14)) and (values >= 0).all() and len(set(values.tolist())) == 14
    assert (values >> 52 == np.arange(14)).all() and (least_values(bags.bag("one"), 14) >> 52 == np.arange(14)).all()
