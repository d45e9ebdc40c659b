"""Fingerprints, vector codes and ranked search against brute force, and with awkward rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries
from tracewell.llm.fingerprints import containment, distinct_shingles, fingerprint_edits, group_sketches, merged, resemblance, sketch
from tracewell.llm.oracles import ORACLES
from tracewell.llm.ranked_search import BallTree, components, ranked_search, terms
from tracewell.llm.vector_codes import CoverTree, vector_codes

SPLIT = re.compile("[ \t\n\x0b\x0c\r]+")


def shingles(text):
    w = [x for x in SPLIT.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_sketch(text, k=128):
    return sorted({hashlib.md5(s.encode()).hexdigest()[:13] for s in shingles(text)})[:k]


def brute_near(a, b, k=128):
    union = sorted({*a, *b})[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


TEXTS = [None, "", "  \t\n", "one", "One", "a b c d", "a b c d e", "a b c d e f g", "É É é\x0bx\x1cy z", "naïve 東京 café " * 3, "word " * 5000, " ".join(map(str, range(3000))), "b" * 70_000]


def test_fingerprints_of_awkward_texts(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "one"), (3, "zzz one two three four five six"), (None, "no id at all here")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sketch string, __range int")
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for at, (i, t) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(following)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), brute_near(a, b), brute_near(a, c)))
    for parts in (1, 3):
        got = fingerprint_edits(docs.repartition(parts)).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in got)
    assert fingerprint_edits(docs.limit(0)).count() == 0
    alone = fingerprint_edits(docs.where("doc_id = 11")).first()
    assert alone.near_next == 1.0 and alone.n_chars == len(TEXTS[11])


def test_sketches_estimate_and_merge(spark):
    a, b = " ".join(f"w{k}" for k in range(4000)), " ".join(f"w{k}" for k in range(2000, 6000))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sketch(F.col("a")).alias("a"), sketch(F.col("b")).alias("b"))
    got = row.select(resemblance(F.col("a"), F.col("b")), containment(F.col("a"), F.col("b")), distinct_shingles(F.col("a")), merged(F.col("a"), F.col("b"))).first()
    assert abs(got[0] - 1 / 3) < 0.13 and abs(got[1] - 0.5) < 0.2 and abs(got[2] / 3996 - 1) < 0.25
    assert got[3] == sorted({hashlib.md5(s.encode()).hexdigest()[:13] for s in shingles(a) | shingles(b)})[:128]


def test_a_group_has_the_sketch_of_all_its_texts(spark):
    rows = [(k % 2, " ".join(f"{k}-{j}" for j in range(60))) for k in range(40)] + [(None, "a b c d e f"), (7, None)]
    sketches = spark.createDataFrame(rows, "source int, text string").select("source", sketch(F.col("text")).alias("sketch"))
    got = {r.source: r.sketch for r in group_sketches(sketches, ["source"], salts=4).collect()}
    for source in (0, 1, None, 7):
        assert got[source] == sorted({hashlib.md5(s.encode()).hexdigest()[:13] for i, t in rows if i == source for s in shingles(t)})[:128]


def brute_lloyd(vectors, start):
    rows = np.array([[math.floor(4096 * x) for x in v] for v in vectors], dtype=object).reshape(len(vectors), 8, -1)
    books = [[list(rows[k, p]) for k in start] for p in range(8)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e], strict=True)), e))
    for _ in range(6):
        for p in range(8):
            own = [near(x, books[p]) for x in rows[:, p]]
            for e in {*own}:
                mine = [x for x, o in zip(rows[:, p], own, strict=True) if o == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    codes = [[near(rows[k, p], books[p]) for p in range(8)] for k in range(len(rows))]
    errors = [sum((a - b) ** 2 for p in range(8) for a, b in zip(rows[k, p], books[p][codes[k][p]], strict=True)) for k in range(len(rows))]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return ["".join(f"{c:02x}" for c in own) for own in codes], errors, digest


@pytest.mark.parametrize(("n", "spread", "chunk"), [(150, 1.0, 64), (150, 0.002, 4096), (9, 1.0, 4), (60, 20_000.0, 16)])
def test_codes_are_those_of_exact_rounds(spark, n, spread, chunk):
    rng = np.random.default_rng(n)
    good = [[float(x) for x in v] for v in rng.uniform(-spread, spread, (n, 16))]
    good[3:6] = [good[2]] * 3  # copies, among the first entries too
    bad = [None, [], [None] * 16, [float("nan")] * 16, [float("inf"), *[0.0] * 15], [1e30, *[0.0] * 15], [1.0] * 15]
    rows = [(k * 3, v, k % 3 or None) for k, v in enumerate(good)] + [(k * 3 + 1, v, 1) for k, v in enumerate(bad)]
    table = spark.createDataFrame([(i, v, x, "code") for i, v, x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    codes, errors, digest = brute_lloyd(good, range(min(16, n)))
    got = {r.vec_id: r for r in vector_codes(table, chunk).collect()}
    assert sorted(got) == [k * 3 for k in range(n)]
    totals = Counter()
    for k in range(n):
        totals[k % 3] += errors[k]
    for k in range(n):
        r = got[k * 3]
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == (codes[k], errors[k], totals[k % 3], digest)


def test_codes_of_empty_tables_null_ids_and_odd_lengths(spark):
    kind = "vec_id long, embedding array<float>, label long"
    assert vector_codes(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0] * 10, None), (2, [0.5] * 10, None), (2, [0.5] * 10, None)]
    got = vector_codes(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id or 0, r.error, r.label_error) for r in got) == [(0, 0, 0), (2, 0, 0), (2, 0, 0)]


def test_cover_tree_holds_its_invariants():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-4000, 4000, (700, 4)), rng.integers(0, 3, (300, 4)), np.zeros((200, 4), np.int64)])
    tree = CoverTree(rows)
    assert (tree.points[tree.place] == rows).all() and tree.count[0] == len(rows) and (tree.total[0] == rows.sum(0)).all()
    for k in range(len(tree.lo)):
        own = tree.points[tree.lo[k] : tree.hi[k]]
        assert np.sqrt(((own - tree.points[tree.centre[k]]) ** 2).sum(1)).max() <= tree.radius[k]
        a, b = tree.child[k]
        if b:
            assert tree.centre[a] == tree.centre[k] and tree.hi[a:b].max() == tree.hi[k] and (tree.hi[a:b] - tree.lo[a:b]).sum() == tree.hi[k] - tree.lo[k]
    sums, counts, found = tree.assign(rows[:16])
    want = ((rows[:, None] - rows[:16]) ** 2).sum(2).argmin(1)
    assert (counts == np.bincount(want, minlength=16)).all()
    assert tree.compared < len(tree.points)  # whole subtrees are assigned


def brute_ranks(docs, items, most=50):
    own = {k: terms((t or "").encode()) for k, (_, t) in enumerate(docs)}
    n_docs, n_terms = sum(1 for t in own.values() if t), sum(map(len, own.values()))
    df = Counter(t for x in own.values() for t in {*x})
    out = []
    for item, text in items:
        scores = []
        for k, x in own.items():
            tf = Counter(x)
            m = 50 + (50 * len(x) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in {*terms(text.encode())} if tf[t])
            if score > 0:
                scores.append((-score, docs[k][0]))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out)


def test_ranks_are_those_of_every_score(spark):
    rng = np.random.default_rng(3)
    words = [f"t{k}" for k in range(60)] + ["Ünï", "X9", "x9"]
    docs = [(k, " ".join(rng.choice(words, rng.integers(0, 30)))) for k in range(400)]
    docs += [(400 + k, "same-words, same words!") for k in range(80)] + [(500, None), (501, ""), (502, "!!"), (503, "t1 " * 30_000), (503, "t2 t3")]
    items = [(k, " ".join(rng.choice(words, 6))) for k in range(20)] + [(90, "same words"), (91, ""), (92, "unseen"), (93, "T1 t1 x9")]
    d = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    b = spark.createDataFrame([*items, (94, None)], "item_id long, text string")
    want = brute_ranks(docs, items)
    for limits in ({}, {"pass_terms": 10, "tree": 64}):
        assert sorted(tuple(r) for r in ranked_search(d, b, **limits).collect()) == want
    assert ranked_search(d.limit(0), b).count() == 0 and ranked_search(d, b.limit(0)).count() == 0


def test_items_of_one_id_and_rows_without_id(spark):
    d = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, "a")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "a"), (5, "b"), (None, "b")], "item_id long, text string")
    got = sorted(((r.item_id or 0, r["rank"], r.doc_id) for r in ranked_search(d, b).collect()))
    assert got[:2] == [(0, 1, 1), (0, 2, None)] and got[2:4] == [(5, 1, 1), (5, 2, None)]


def test_bounds_are_never_below_a_score_and_prune():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 40, 3000)
    term = np.concatenate([np.sort(rng.choice(200, s, replace=False)) + 200 * (k % 4) for k, s in enumerate(size)])
    value = components(rng.integers(0, 20_000, 800), term, rng.integers(1, 9, len(term)), np.repeat(rng.integers(5, 900, 3000), size), 3000, 900_000)
    some = value > 0
    start = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(3000), size)[some], minlength=3000))])
    tree = BallTree(start, term[some], value[some])

    def below(node):
        return np.concatenate([below(c) for c in node.children]) if node.children else node.docs

    def check(node):
        if node.children:
            item = np.sort(rng.choice(800, 12, replace=False))
            for bound, child in zip(node.block.sums(item), node.children, strict=True):
                scores = [value[some][a:b][np.isin(term[some][a:b], item)].sum() for a, b in zip(start[below(child)], start[below(child) + 1], strict=True)]
                assert bound >= max(scores)
                check(child)

    check(tree.root)
    for _ in range(20):
        tree.search(np.sort(rng.choice(200, 8, replace=False)), np.arange(3000), 10, [])
    assert tree.scored < 0.5 * 20 * 3000


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fingerprints", "op13_ranked_search"])
def test_queries_agree_with_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(repr(r) for r in cursor.fetchall())
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == want
