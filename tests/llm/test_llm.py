"""Each operator against brute force, an exact round trip or held-out accuracy, and with awkward rows."""

import hashlib
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tracewell.llm import queries
from tracewell.llm._shared import scratch
from tracewell.llm._tokens import PieceEncoder
from tracewell.llm.components import connected_components
from tracewell.llm.decontaminate import ItemMatcher, contaminated, myers_distance, normalise, pattern_masks
from tracewell.llm.html_text import fit_weights, main_text
from tracewell.llm.language import UNKNOWN, fit_centroids, identify_language
from tracewell.llm.neighbours import nearest_neighbours
from tracewell.llm.packing import pack_documents, piece_lengths
from tracewell.llm import simhash
from tracewell.llm.simhash import Bags, _node, _wide_fingerprint, near_duplicates, near_links, near_pairs, shingle_hashes, simhash_components, trie_self_join
from tracewell.llm.token_files import read_token_files, write_token_files
from tracewell.llm.tool_calls import link_tool_calls, schema_errors
from tracewell.llm.toxicity import STRIDE, WIDTH, GatedNetwork, Scorer, Words, score_toxicity, train, window_starts
from tracewell.llm.warc import chunked, dechunked, read_warc, write_warc

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [None, "", " ", "\n", "a", "a b", " a  b ", "a\tb\r\nc", "x\ny\n", "naïve 東京 café", "don't  stop", "1234 5,678!", "<|endoftext|> x", "a b  c", "é é", "word " * 3000, "ΣΑΣ Σ", "a\x1cb\x85c", "x \ny", "퟿ z", "x <|startoftext|>y<|endoftext|>", "a.\n\nB c\n\n", "a\n\n\nb", "Nul\0 x", "it's. x're!? 'll, (a) b)\" c###\nd.", "É É Ç.", "İ Σ. ΑΣ", "_a_ b_ 3.5, 12%"]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def library_ids(path, text, end):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_encoded_as_the_whole(path, sf_dir):
    import pyarrow.parquet as pq

    texts = [t or "" for t in ODD] + pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:60] + pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()[:5]
    whole = Tokenizer.from_file(path)
    got = PieceEncoder(path, limit=500).encode(texts)
    for text, found in zip(texts, got, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]


def test_token_files_round_trip(spark):
    docs = documents(spark, ODD, 5).union(documents(spark, ["twice"], 7)).unionByName(documents(spark, ["no id"]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    out = scratch(spark, "t")
    write_token_files(docs.withColumn("ids", docs["text"]), out, BYTE, 0, shards=3)
    rows = sorted(read_token_files(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([None, *range(5, 5 + len(ODD)), 7], key=lambda v: -1 if v is None else v)
    start = 0
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(crc(library_ids(BYTE, r.text, 0)))
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids) // 4
        texts[r.doc_id].remove(zlib.crc32(r.ids))
        start += r.n_tokens
    out = scratch(spark, "t")
    assert write_token_files(docs.limit(0), out, BYTE) == [] and read_token_files(spark, out).count() == 0


def test_packing_covers_each_id_once(spark):
    docs = documents(spark, ODD)
    rows = pack_documents(docs.withColumn("ids", docs["text"]), WORD, 1, 64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and len(r.ids) == 4 * r.length
    assert len({r.sequence_id for r in rows}) == len(rows)
    for k, text in enumerate(ODD):
        own = sorted(by[k], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        assert ids == library_ids(WORD, text, 1) and own[0].doc_tokens == len(ids)
        assert [r.length for r in own] == piece_lengths(len(ids), 64)
    assert pack_documents(docs.limit(0), WORD).count() == 0


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    base = texts[3][1].split(" ")
    extra = [(1000 + k, " ".join(base[:k] + ["x"] + base[k + 1 :])) for k in range(0, 60, 3)] + [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE two"), (2004, texts[0][1])]
    rows = texts + extra
    got = {r.doc_id: r for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as id", "3 as component_id")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert len(links) > 5
    assert {i: r.component_id for i, r in got.items()} == brute_components(links, ids)
    assert simhash_components(docs.limit(0)).count() == 0


def test_trie_join_is_complete():
    r = np.random.default_rng(0)
    keys = np.concatenate([r.integers(0, 4096, 300, np.uint64), np.full(50, 77, np.uint64)])
    groups = r.integers(0, 2, len(keys))
    order = np.lexsort((keys, groups))
    keys, groups = keys[order], groups[order]
    got = set()
    for i, j, leaves in trie_self_join(groups, keys, 16, 2):
        got |= {(min(a, b), max(a, b)) for a in i.tolist() for b in j.tolist() if a != b} if leaves else set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == {(a, b) for a in range(350) for b in range(a + 1, 350) if groups[a] == groups[b] and int(keys[a] ^ keys[b]).bit_count() <= 2}


def test_near_duplicates_follow_shingle_similarity(spark):
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(5000)]
    rows, want = [], {}
    for k in range(60):
        text = r.choice(words, 300).tolist()
        rows.append((10 * k, " ".join(text)))
        for c in range(3):
            copy = text.copy()
            for at in r.integers(0, 300, 3):
                copy[at] = "z"
            rows.append((10 * k + 1 + c, " ".join(copy)))
        changed = [w if j % 4 else f"q{j}" for j, w in enumerate(text)]
        rows.append((10 * k + 5, " ".join(changed)))
        want |= {10 * k: 10 * k, 10 * k + 1: 10 * k, 10 * k + 2: 10 * k, 10 * k + 3: 10 * k, 10 * k + 5: 10 * k + 5}
    rows += [(9000, None), (9001, "")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {9000: 9000, 9001: 9001}
    same = spark.createDataFrame([(k, "a b c d e f " * 40 + f"end{k % 3}") for k in range(900)], "doc_id long, text string")
    assert {x.component_id for x in near_duplicates(same).select("component_id").distinct().collect()} == {0}


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(50, 45), (45, 45), (50, 45), (60, 10)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 10), 60: 10, 45: 45, 50: 45}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for k, p in enumerate(pattern, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_matching_against_brute_force(spark):
    r = np.random.default_rng(4)
    alphabet = list("abcdefgh ")
    items = [(k, "".join(r.choice(alphabet, 60 + 10 * k))) for k in range(6)]
    docs = []
    for k in range(40):
        text = "".join(r.choice(alphabet, 400))
        item = list(items[k % 6][1])
        for _ in range(k % 8):
            at = int(r.integers(0, len(item)))
            item[at : at + 1] = [[], ["x"], [item[at] if at < len(item) else "y", "z"]][int(r.integers(0, 3))]
        docs.append((k, text[:200].upper() + "".join(item) + text[200:]))
    for _, text in docs[:5]:
        p = normalise(items[0][1])
        assert myers_distance(pattern_masks(p), len(p), normalise(text))[0] == edit_distance_within(p, normalise(text))
    want = set()
    for d, text in docs:
        for i, item in items:
            distance = edit_distance_within(normalise(item), normalise(text))
            if distance <= int(0.1 * len(normalise(item))):
                want.add((d, i, distance))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, items[1][1])], "item_id long, text string")
    table = spark.createDataFrame([*docs, (100, None), (101, "")], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as distance")
    want |= {(d, 92, x) for d, i, x in want if i == 1}
    for block in (10_000, 100):
        assert {(x.doc_id, x.item_id, x.distance) for x in contaminated(table, bench, 0.1, block).collect()} == want
    assert len(want) > 20 and contaminated(table, bench.limit(0)).count() == 0
    assert ItemMatcher([], 0.1).match("x") == []


def test_warc_round_trip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    big = "é" * 700
    rows = [(-1, "http://a/é b\r\nx", big), (-2, "u", big), (-3, None, big), (-4, "u", None), (-5, "u", ""), (-6, "u", "short"), (-7, "u", "short"), (-2, "u", big), (None, "u", big), (-9, "u", "y" * 300_000)]
    pages = pages.unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for segment in (700, 1 << 20):
        out = scratch(spark, "w")
        names = write_warc(pages.selectExpr("*", "1 as digest", "2 as p", "3 as refers_to"), out, 1000, segment)
        got = read_warc(spark, out, names).collect()
        want = pages.collect()
        assert len(got) == len(want)
        payload = {(r.page_id, r.record_type): r for r in got}
        for r in want:
            body = (r.html or "").encode()
            revisit = r.html == big and r.page_id != -1
            x = payload[r.page_id, "revisit" if revisit else "response"]
            assert (x.payload_bytes, x.payload_digest, x.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), -1 if revisit else None)
            assert revisit or bytes(x.payload) == body
    assert payload[-1, "response"].url == "http://a/é b\r\nx"
    assert dechunked(chunked(b"x" * 200_000, 999)) == b"x" * 200_000 and dechunked(b"3;a=b\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    out = scratch(spark, "w")
    assert read_warc(spark, out, write_warc(pages.limit(0), out)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>Two words</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id=main class="content"><h1>Title&nbsp;here</h1><p>One  <b>bold</b>word<br>next &amp; last.<p>Second &lt;p&gt; paragraph.
<aside class=x>Side</aside><div class="ad">Buy now</div><form>Name <input> <button>Go</button></form><p>Be.</p></div>
<section id="comments"><p>First! this is a reader comment that is long enough to look like text of the page.</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text(sf_dir):
    import pyarrow.parquet as pq

    weights = fit_weights(pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist())
    assert main_text(PAGE, weights) == "Title here\nOne boldword next & last.\nSecond <p> paragraph.\nBe."
    for empty in (None, "", "<html></html>", "<nav>x</nav>", "<!-- open", "<script>x", "<p"):
        assert main_text(empty, weights) == ""
    assert main_text("just words &lt; here", weights) == "just words < here"
    assert len(main_text("<p>a</p>" * 20_000, weights).split("\n")) == 20_000


def test_language(spark, sf_dir):
    rows = [r for r in queries.op9_language(spark, sf_dir).collect() if r.held_out]
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.9
    train_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the of and " * 20_000), (4, None)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as lang_pred")
    got = sorted(identify_language(odd, train_docs).collect(), key=lambda r: (r.doc_id, r.lang_pred))
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, UNKNOWN), (2, UNKNOWN), (3, UNKNOWN), (4, "en"), (4, UNKNOWN)]
    assert all(r.rejected for r in identify_language(odd, train_docs.limit(0)).collect()) and identify_language(odd.limit(0), train_docs).count() == 0
    assert fit_centroids(["abc"], ["xx"]).predict("zq 界")[0] == "xx"


def test_neighbours_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    odd = [(100000, None), (100050, [0.0] * 64), (100100, [float("nan")] * 64), (None, [1.0] * 64), (100150, [None, *[1.0] * 63]), (100200, [])]
    table = vectors.unionByName(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).selectExpr("*", "1 as rank", "2 as score")
    got = defaultdict(list)
    for r in nearest_neighbours(table, table.where("vec_id % 50 = 0"), 5, block=3, shard=200).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    ids, hits = np.array(sorted(rows)), 0
    v = np.array([rows[i] for i in ids])
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert set(got) == set(asked)
    for q in asked:
        c = v @ rows[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(rows[q])
        c[ids == q] = -2
        best = ids[np.lexsort((ids, -c))[:5]].tolist()
        own = sorted(got[q])
        assert [r for r, *_ in own] == [1, 2, 3, 4, 5]
        assert np.allclose([s for *_, s in own], [c[ids == i][0] for _, i, _ in own], atol=1e-12)
        hits += len({i for _, i, _ in own} & set(best))
    assert hits / (5 * len(asked)) >= 0.9
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(300)], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in nearest_neighbours(same, same.where("vec_id = 1"), 3).orderBy("rank").collect()] == [(1, 0), (2, 2), (3, 3)]
    few = nearest_neighbours(same.limit(2), same.where("vec_id = 0"), 5)
    assert few.count() == 1 and nearest_neighbours(same.limit(0), same).count() == 0 and nearest_neighbours(same, same.limit(0)).count() == 0


def test_toxicity_gradients():
    net = GatedNetwork.fresh(3)
    r = np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k != "words"}
    words = Words.of(["a", "bcd", "dcbae", "xy", "b", "long-word"])
    at, y, w = r.integers(0, 7, (5, 8)), np.array([0, 1, 1, 0, 1.0]), np.ones(5)
    at[:, 0] = 1
    own = r.normal(size=(7, WIDTH))

    def vectors():
        spelt, made = net.spell(words, keep=True)
        return np.hstack([own, np.vstack([np.zeros((1, spelt.shape[1])), spelt])]), made

    def loss():
        logit = net.forward(net.inputs(vectors()[0]), at)[0]
        return float((np.logaddexp(0, logit) - y * logit).mean())

    x, made = vectors()
    g, dx = net.gradients(x, at, y, w)
    g |= net.spelling_gradients(made, dx[1:, WIDTH:])
    assert set(g) == set(net.p)
    for value, grad in [*((net.p[k], g[k]) for k in g), (own, dx[:, :WIDTH])]:
        flat, want = value.reshape(-1), np.asarray(grad).reshape(-1)
        for k in [*np.argsort(-np.abs(want))[:2].tolist(), len(flat) // 2]:
            before = flat[k]
            flat[k] = before + 1e-3
            up = loss()
            flat[k] = before - 1e-3
            down = loss()
            flat[k] = before
            assert abs((up - down) / 2e-3 - want[k]) < 1e-4


def word_list_scores(train_texts, labels, texts):
    """The greatest log-odds of a text's words: what the network must beat."""
    counts = [defaultdict(int), defaultdict(int)]
    for t, y in zip(train_texts, labels, strict=True):
        for w in set(re.findall(r"\w+", t.lower())):
            counts[y][w] += 1
    n = [max(1, labels.count(0)), max(1, labels.count(1))]
    odds = {w: np.log((counts[1][w] + 0.5) / n[1]) - np.log((counts[0][w] + 0.5) / n[0]) for w in {*counts[0], *counts[1]} if counts[0][w] + counts[1][w] > 3}
    return np.array([max((odds.get(w, 0) for w in re.findall(r"\w+", t.lower())), default=0) for t in texts])


def area(scores, labels):
    order, y = np.argsort(np.argsort(scores)), np.array(labels)
    return (order[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_network_beats_a_word_list():
    """On held-out documents, by ranking; and most toxic ones are caught with few false alarms."""
    import pyarrow.parquet as pq

    source = "/root/testdata/sf0.1"
    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"{source}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{source}/labels.parquet").to_pylist() if r["doc_id"] in text}
    held = [i for i in sorted(label) if zlib.crc32(str(i).encode()) % 5 == 0]
    fit = sorted(set(label) - set(held), key=lambda i: zlib.crc32(f"order {i}".encode()))
    fit = [i for i in fit if label[i]] + [i for i in fit if not label[i]][:2000]
    fit.sort(key=lambda i: zlib.crc32(f"mix {i}".encode()))
    texts, labels, known = [text[i] for i in held], [label[i] for i in held], ([text[i] for i in fit], [label[i] for i in fit])
    scorer = Scorer(train(*known))
    scores = np.concatenate([scorer.score(texts[a : a + 100]) for a in range(0, len(texts), 100)])
    y = np.array(labels)
    assert area(scores, labels) > area(word_list_scores(*known, texts), labels) + 0.01
    assert (scores[y == 1] >= 0.5).mean() > 0.8 and (scores[y == 0] >= 0.5).mean() < 0.025


def test_toxicity_frame(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    odd = spark.createDataFrame([(1, None), (1, None), (None, "some words"), (2, ""), (3, "word " * 20_000), (3, "other")], "doc_id long, text string").selectExpr("*", "9 as score", "'x' as toxic", "7 as p")
    got = score_toxicity(odd, docs, labels.selectExpr("*", "1 as text"), 40, carry=("p",)).collect()
    with pytest.raises(ValueError):
        score_toxicity(odd, docs, labels, 40, carry=("score",))
    assert sorted((r[0] is None, r[0] or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 3), (True, 0)]
    assert all(0 <= r[1] <= 1 and r[2] == 7 for r in got) and [r[1] for r in got if r[0] in (1, 2)] == [0, 0, 0]
    assert score_toxicity(odd.limit(0), docs, labels, 40).count() == 0
    assert all(r.score < 0.5 for r in score_toxicity(odd, docs, labels.limit(0), 40).collect())


def test_toxicity_learns_and_handles_odd_texts():
    r = np.random.default_rng(0)
    calm, bad = [f"word{k}" for k in range(300)], ["vilepest", "vileling", "grot"]
    texts, labels = [], []
    for k in range(400):
        words = r.choice(calm, int(r.integers(3, 150))).tolist()
        if k % 4 == 0:
            words[int(r.integers(0, len(words)))] = bad[k // 4 % 3]
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    net = train(texts[:300], labels[:300])
    scorer = Scorer(net, limit=50)
    got = np.concatenate([scorer.score(texts[a : a + 10]) for a in range(300, 400, 10)])
    assert np.mean((got >= 0.5) == np.array(labels[300:])) > 0.95
    odd = scorer.score([None, "", "...", "calm " * 20_000 + "grot"])
    assert (odd[:3] < 0.5).all() and odd[0] == odd[1] == odd[2] and 0 <= odd[3] <= 1
    assert (Scorer(train(["a"], [1])).score(["a"]) < 0.5).all()
    assert all(0 <= s <= max(0, n - 32) for n in range(1, 300) for s in window_starts(n)) and window_starts(40) == [0, 8] and STRIDE <= 16


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "f", '{"x": 1, "b": "é"}', None),
        (1, 2, "b", "f", '{"x": "no"}', ["a", "missing"]),
        (1, 4, "c", "f", '{"x": 2}', ["a", "b"]),
        (2, 0, "d", "f", '{"x": 2}', ["e"]),
        (2, 1, "e", "f", '{"x": 2}', ["d"]),
        (2, 2, "g", "f", "nope", []),
        (3, 0, "h", "unknown", None, []),
        (3, 0, "h", "unknown", None, []),
        (3, 1, None, "f", "{}", []),
        (3, 2, "i", "f", '{"x": 1}', []),
    ]
    calls = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>").selectExpr("*", "1 as level", "2 as needed")
    results = spark.createDataFrame([("a", 1, "r"), ("b", 3, "s"), ("b", 9, "later"), ("c", 5, None), ("d", 1, "x"), ("g", 3, "y"), ("h", 1, "z"), (None, 1, "q"), ("zz", 1, "q")], "call_id string, turn long, content string")
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}
    got = {r.call_id: r for r in link_tool_calls(calls, results, schemas).collect()}
    assert {k: (r.level, r.status) for k, r in got.items()} == {"a": (0, "ok"), "b": (1, "invalid"), "c": (2, "ok"), "d": (None, "cycle"), "e": (None, "cycle"), "g": (0, "invalid"), "h": (0, "invalid"), "i": (0, "unlinked")}
    assert got["a"].canonical == '{"arguments":{"b":"é","x":1},"id":"a","name":"f","result":"r"}'
    assert json.loads(got["b"].canonical)["result"] == "s" and got["b"].errors == ["$.x: not of type integer"] and got["c"].result_turn == 5
    assert link_tool_calls(calls.limit(0), results, schemas).count() == 0
    assert schema_errors([1, True], {"type": "array", "items": {"type": "number", "maximum": 3}}) == ["$[1]: not of type number"]


def test_conversation_calls_are_whole(spark, sf_dir):
    rows = queries.op4_tool_calls(spark, sf_dir).collect()
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    users = {k for k, r in turns.items() if r.role == "user"}
    assert {(r.conv_id, r.turn) for r in rows} == users
    for r in rows:
        depth, turn = 0, r.turn
        while (r.conv_id, turn - 2) in users:
            depth, turn = depth + 1, turn - 2
        answer = turns.get((r.conv_id, r.turn + 1))
        linked = answer is not None and answer.role == "assistant"
        assert r.level == depth and (r.status == "unlinked") == (not linked)
        assert json.loads(r.canonical)["result"] == (answer.text if linked else None)


def test_shingles_of_short_and_odd_texts():
    assert len(shingle_hashes(None, 3)) == len(shingle_hashes(" \t\n", 3)) == 0
    assert shingle_hashes("A b", 3).tolist() == [xxhash.xxh64_intdigest("a b", seed=42)]
    assert shingle_hashes("a b c d", 3).tolist() == [xxhash.xxh64_intdigest("a b c d", seed=42)]


def test_article_inside_odd_wrappers(sf_dir):
    import pyarrow.parquet as pq

    weights = fit_weights(pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist())
    page = """<body><div class="header">Site name</div><div class="wrap has-sidebar"><article class="post"><h2>A title</h2><p>Some words of it.</p></article>
    <div class="sidebar"><p>More of this site</p></div><section class="comments"><article class="comment"><p>Nice one, thanks!</p></article></section></div></body>"""
    assert main_text(page, weights) == "A title\nSome words of it."


def test_levels_match_brute_force(spark):
    from tracewell.llm.tool_calls import topological_levels

    r = np.random.default_rng(5)
    edges = [(f"c{k}", f"c{k - 1}") for k in range(1, 150)]
    edges += [(f"d{k}", f"{'cd'[int(r.integers(0, 2))]}{int(r.integers(0, k + 1))}") for k in range(60) for _ in range(int(r.integers(0, 3)))]
    edges = [(a, b) for a, b in edges if a != b] + [("x", "y"), ("y", "x"), ("z", "x"), ("z", "c1"), ("w", "z"), ("v", "gone"), ("s", "s")]
    names = sorted({a for a, _ in edges} | {b for _, b in edges if b != "gone"})
    needs = {n: {b for a, b in edges if a == n and b in names} for n in names}
    want: dict = {}
    while new := {n: 1 + max((want[b] for b in needs[n]), default=-1) for n in names if n not in want and needs[n] <= set(want)}:
        want |= new
    got = topological_levels(spark.createDataFrame([(n,) for n in names], "call_id string"), spark.createDataFrame(edges, "call_id string, needed string")).collect()
    assert len(got) == len(want) and {x.call_id: x.level for x in got} == want


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.83 are found, pairs of 0.70 to 0.79 are kept apart, and a common passage links nothing."""
    r = np.random.default_rng(11)
    passage = " ".join(f"common{k}" for k in range(60))
    rows, want = [], {}
    for k in range(400):
        text = r.choice([f"w{j}" for j in range(9000)], 200).tolist()
        lost = int(r.integers(18, 22)) if k % 2 else int(r.integers(24, 35))  # words changed at the end; 196 shingles
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text[:-lost], *(f"n{k}-{j}" for j in range(lost))]))]
        assert (0.8 <= (196 - lost) / (196 + lost) < 0.84) if k % 2 else (0.69 < (196 - lost) / (196 + lost) < 0.8)
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if k % 2 else 2 * k + 1}
    for k in range(300):
        rows.append((5000 + k, passage + " " + " ".join(f"p{k}-{j}" for j in range(60))))
        want[5000 + k] = 5000 + k
    rows += [(6000, "x y z"), (6001, "X  y z"), (6002, "x y"), (6003, None)]
    want |= {6000: 6000, 6001: 6000, 6002: 6002, 6003: 6003}
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_repeated_pieces_against_brute_force():
    """Items whose pieces recur: an occurrence left of a stretch tried before is found, with its least distance."""
    assert [d for _, d, _ in ItemMatcher([(1, "the cat sat abcdthe cat sat abcd")], 0.06).match("z " * 100 + "thX cat sat abcdthe cat sat abcd" + " z" * 100)] == [1]
    r = np.random.default_rng(8)
    found = 0
    for _ in range(150):
        part = "".join(r.choice(list("abc"), int(r.integers(2, 9))))
        item = (part * 20)[: int(r.integers(20, 50))]
        copy = list(item)
        for _ in range(int(r.integers(0, 5))):
            at = int(r.integers(0, len(copy)))
            copy[at : at + 1] = [[], ["x"], [copy[at], "y"]][int(r.integers(0, 3))]
        text = "".join(r.choice(list("abcz"), 30)) + part + "".join(copy) + part + "".join(r.choice(list("abcz"), 30))
        least = edit_distance_within(item, text)
        want = [(1, least)] if least <= int(0.1 * len(item)) else []
        assert [(i, d) for i, d, _ in ItemMatcher([(1, item)], 0.1).match(text)] == want, (item, text)
        found += len(want)
    assert found > 40


def test_main_text_of_open_heads_and_layout_wrappers(sf_dir):
    import pyarrow.parquet as pq

    weights = fit_weights(pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist())
    story, want = "<h2>A title</h2><p>Some words of it.</p>", "A title\nSome words of it."
    for page in (
        f"<html><head><title>x</title><meta charset=utf-8><body>{story}",
        f"<html><head><title>x</title><script>y</script>{story}",
        f"<head><title>x</title><link rel=a href=b>\n<body><article>{story}</article>",
        f"<head><title>x</title><main>{story}</main>",
        f"<body><div class='content with-sidebar'>{story}</div>",
        f"<body><div id=page-has-menu>{story}</div>",
        f"<body><div class='no-sidebar wide'>{story}</div>",
        f"<body><div class='has-left-sidebar'>{story}<div class='sidebar no-print'><p>More of this site</p></div></div>",
        f"<body><div class='sidebar layout'><div itemprop='articleBody'>{story}</div></div>",
        f"<body><div class='menu layout'><div class='banner page' role=main>{story}</div></div>",
        f"<body><article class='post has-comments'>{story}</article>",
    ):
        assert main_text(page, weights) == want, page
    assert main_text("<head><title>x</title>Some words", weights) == "Some words"
    assert main_text("<body><div class='piano-sidebar'><p>Links</p></div>", weights) == ""


def test_neighbours_of_repeated_rows(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = table.where("vec_id % 50 = 0")
    rows = lambda t: sorted(tuple(r) for r in nearest_neighbours(t, asked, 5).select("query_id", "rank", "vec_id").collect())
    once = rows(table)
    assert len(once) == 5 * asked.count() and rows(table.union(table)) == once
    near = spark.createDataFrame([(0, [1.0, 0.0])] + [(1, [1.0, 0.01 * k]) for k in range(6)] + [(k, [1.0, 0.1 * k]) for k in range(2, 7)], "vec_id long, embedding array<float>")
    got = nearest_neighbours(near, near.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and got[0].score == 1.0


def test_main_text_of_hostile_markup(sf_dir):
    import time

    import pyarrow.parquet as pq

    weights = fit_weights(pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist())
    assert main_text("<p data-x=don't>four five</p><p>it's six seven</p>", weights) == "four five\nit's six seven"
    assert main_text("<p title='a>b' class=x'y>four</p><p alt=\"c>d\">five</p>", weights) == "four\nfive"
    long = "many words " * 10
    assert main_text(f"<div><b>{long}<div>{long}</b> three</div>", weights) == f"{long.strip()}\n{long}three"
    for part in ("<b></i>", "<i><div></i>", "<p>a<nav>b</nav>", "<b><div><i></b>", "<a title='"):
        start = time.perf_counter()
        main_text(part * 40_000, weights)
        assert time.perf_counter() - start < 20, part


def test_main_text_frame(spark, sf_dir):
    from tracewell.llm.html_text import extract_main_text

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(None, "u", "<p>a b</p>"), (1, None, None), (1, None, ""), (1, None, "")], "page_id long, url string, html string")
    table = pages.unionByName(odd).selectExpr("*", "1 as text", "'x' as weights")
    got = extract_main_text(table).collect()
    assert len(got) == pages.count() + 4 and [r.text for r in got if r.page_id is None] == ["a b"]
    assert extract_main_text(table.limit(0)).count() == 0
    assert [r.text for r in extract_main_text(odd.where("page_id = 1")).collect()] == ["", "", ""]


def test_best_region_is_the_maximum_sum():
    import random

    from tracewell.llm.html_text import best_region

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 9)
        gaps, scores = [rng.randint(-6, 0) + 0.0 for _ in range(n)], [rng.randint(-4, 6) + 0.0 for _ in range(n)]
        total = lambda a, b: sum(scores[a:b]) + sum(gaps[a + 1 : b])
        most = max((total(a, b) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        a, b = best_region(gaps, scores)
        assert total(a, b) == max(0, most) if most > 0 else (a, b) == (0, 0)


def test_main_text_comes_from_learned_weights(sf_dir, monkeypatch):
    import pyarrow.parquet as pq

    from tracewell.llm import html_text
    from tracewell.llm.html_text import ELEMENTS

    pages = pq.read_table(f"{sf_dir}/pages.parquet").column("html").to_pylist()
    weights = fit_weights(pages)
    full = [main_text(p, weights) for p in pages]
    without = [main_text(p, weights | {ELEMENTS: {}}) for p in pages]
    monkeypatch.setattr(html_text, "prior", lambda feature: 0.0)
    assert [main_text(p, weights) for p in pages] == full  # no list of names
    bare = [main_text(p, weights | {ELEMENTS: {}}) for p in pages]
    assert all(a != b for a, b in zip(full, bare)) and without != bare
    monkeypatch.undo()
    # what labelled pages show outweighs a name, and names that no list has are learned
    labelled = ["<body><div class=zq17>Win a car now</div><article><h1>T</h1><p class='lead promo'>One two three</p></article></body>"] * 40
    own = fit_weights(labelled)
    page = "<body><div class=wrap><p class=promo>Four five six</p><div class=zq17>Win a boat</div><p>seven eight</p></div></body>"
    assert main_text(page, own) == "Four five six\nseven eight"
    assert main_text(page, weights) == "Win a boat\nseven eight"
    # a region is chosen by the scan where no name tells: links of a menu score below zero, an article's own list does not
    menu = "<ul>" + "<li><a href=/x>Item</a></li>" * 9 + "</ul>"
    story = "<p>" + "word " * 40 + "</p>"
    assert main_text(f"<body><div>{menu}</div>{story}", weights) == ("word " * 40).strip()
    assert main_text(f"<body><article>{story}<ul><li>One</li><li>Two</li></ul></article>", weights).endswith("One\nTwo")


def test_tries_give_near_duplicates(spark, monkeypatch):
    """Without pairs from the tries nothing is a near-duplicate; with them, pairs of similarity 0.8 meet, of long and of small bags."""
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in range(9000)]
    rows, want = [], set()
    for k in range(300):
        n = int(r.integers(40, 300)) if k % 2 else int(r.integers(8, 24))
        text = r.choice(words, n).tolist()
        lost = max(1, (n - 4) // 9) if n > 12 else 0  # words changed at the end; n - 4 shingles
        copy = [*text[: n - lost], *(f"n{k}-{j}" for j in range(lost))] if lost else [*text, "more"]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
        bags = [set(zip(*(t[j:] for j in range(5)), strict=False)) for t in (text, copy)]
        if len(bags[0] & bags[1]) >= 0.8 * len(bags[0] | bags[1]):
            want.add((2 * k, 2 * k + 1))
    assert len(want) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.component_id, x.doc_id) for x in near_duplicates(docs).where("component_id <> doc_id").collect()}
    assert got == want
    monkeypatch.setattr(simhash, "near_pairs", lambda *a: near_pairs(*a).limit(0))
    assert near_duplicates(docs).where("component_id <> doc_id").count() == 0


def test_links_of_one_trie_connect_what_all_pairs_connect(monkeypatch):
    """A crowd of near copies among other texts, in tries walked to nodes of any size, against all pairs."""
    r = np.random.default_rng(6)
    base = [r.choice([f"w{k}" for k in range(3000)], 120).tolist() for _ in range(40)]
    texts = []
    for k in range(400):
        text = list(base[0] if k < 250 else base[int(r.integers(0, 40))])
        for at in r.integers(0, 120, int(r.integers(0, 12))):
            text[at] = f"z{r.integers(0, 10**9)}"
        texts.append(" ".join(text))
    bags = [Bags(5).bag(t) for t in texts]
    wide, size = np.array([_wide_fingerprint(b) for b in bags]).view("<u8"), np.array([len(b) for b in bags])
    order = np.argsort(wide[:, 3])
    wide, size = wide[order], size[order]
    assert len({_node(b) for b in bags}) > 300
    for leaf in (8, 64, 4096):
        monkeypatch.setattr(simhash, "NEAR_LEAF", leaf)
        i, j = near_links(wide[:, 3], wide, size, 20, 0.8)
        links = [
            (a, b) for a in range(400) for b in range(a + 1, 400)
            if int(wide[a, 3] ^ wide[b, 3]).bit_count() <= 20 and np.bitwise_count(wide[a] ^ wide[b]).sum() <= simhash.FILTER_BITS and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) - 1e-9
        ]
        assert brute_components(zip(i.tolist(), j.tolist(), strict=True), range(400)) == brute_components(links, range(400))
        assert len(i) < 4 * 400 and len(links) > 5000


def test_words_of_ascii_are_not_translated_letter_by_letter():
    """Pieces of letters, accented ones too, get the library's ids, and ASCII letters are not looked up one by one."""
    import public_tokenizers

    from tracewell.llm._tokens import PieceEncoder

    class Table(dict):
        seen = 0

        def __getitem__(self, key):
            Table.seen += 65 <= key < 128
            return super().__getitem__(key)

    words = [f"{a}{b}{c}" for a in ("Ab", "zzq", "é", "ÀØ", "Ü") for b in ("xk", "", "ß", "Ö") for c in ("th", "ÿ", "Q", "Ğ")]
    for name, end in (("byte_bpe_50k.json", 0), ("word_bpe_49k.json", 1)):
        path = public_tokenizers.path(name)
        coder = PieceEncoder(path)
        coder.written = Table(coder.written)
        plain = " ".join(w for w in words if w.isascii())
        assert coder.encode_flat([plain], end)[0].tolist() == library_ids(path, plain, end) and Table.seen == 0
        for text in (" ".join(words), " ".join(reversed(words)) + " ", words[7]):
            assert coder.encode_flat([text], end)[0].tolist() == library_ids(path, text, end)
