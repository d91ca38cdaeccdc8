"""N-gram join, filter audit and importance resampling against brute force, on edge tables and on the smallest given tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import importance_resampling as draws
from tablewright.llm import interaction_audit as audits
from tablewright.llm import ngram_join as joins
from tablewright.llm.common import written
from tablewright.llm.words import NOT_SPACE, byte_slices, word_spans

FOLDER = "/root/testdata/sf0.001"
EDGE = [(1, "a b c d"), (2, None), (3, ""), (4, "  \t "), (5, "A b c D"), (5, "a b  c\nd"), (None, "A B c\nd é 1"), (None, None), (6, "x " * 30_000), (7, "it's  odd \n\n ▁ \0 end "), (8, "漢字" * 100)]
DOCS = "doc_id long, text string, source string, row string, node string, key string, root string, n long, range string, part string, signature string"


@pytest.fixture(scope="module")
def edge(spark):
    return written(spark.createDataFrame([(*r, "s" if i % 2 else None, *["x"] * 4, i, *["y"] * 3) for i, r in enumerate(EDGE)], DOCS), "edge")


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_word_spans_over_slices():
    texts = ["one two", None, "", " x ", "joined", "next é", "\t"]
    for most in (1, 8, 1000):
        got = []
        for _, data, offsets in byte_slices(pa.array(["skipped", *texts]).slice(1), most):
            start, end, row = word_spans(data, offsets, NOT_SPACE)
            got += [data[a:b].tobytes().decode() for a, b in zip(start, end)]
            assert (row == np.searchsorted(offsets, start, "right") - 1).all()
        assert got == " ".join(t or "" for t in texts).split()
    assert list(byte_slices(pa.array([], pa.string()))) == []


# N-gram join


def shingles(text):
    words = [w.decode() for w in lowered(text).encode().split()]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def joined_by_hand(rows):
    """(id, size, smallest linked id) of each row."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    least = {r: min((k for (k, _), q in zip(rows, root) if q == r and k is not None), default=None) for r in root}
    return collections.Counter((k, len(s), least[r]) for (k, _), s, r in zip(rows, sets, root))


def found(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_similar_sets_share_a_signature():
    rng, tried = np.random.default_rng(5), 0
    for _ in range(3000):
        n = int(rng.integers(1, rng.choice([6, 12, 40, 200, 900]) + 1))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[rng.random(n) >= 0.1], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 2)), dtype=np.uint64)]))
        a = np.unique(a)
        shared = len(np.intersect1d(a, b))
        if not len(b) or not joins.similar(shared, len(a), len(b)):
            continue
        tried += 1
        sig, row = joins.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert np.intersect1d(sig[row == 0], sig[row == 1]).size
    assert tried > 1000


def test_ngram_join_edges(edge, empty):
    assert found(joins.ngram_components(edge)) == joined_by_hand(EDGE)
    assert joins.ngram_components(empty).count() == 0
    assert joins.ngram_components(empty).columns == ["doc_id", "n_shingles", "component_id"]


def test_ngram_join_on_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(joins.ngram_components(documents)) == joined_by_hand(rows)


def test_ngram_join_of_chains_and_crowds(spark):
    """Near copies of copies, of which most are no near copies of each other, and a passage that many texts share."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocabulary, 90))
    passage = list(rng.choice(vocabulary, 50))
    rows = []
    for i in range(60):
        if i % 10 == 0:
            base[int(rng.integers(90))] = f"new{i}"
        mine = list(base)
        for at in rng.integers(0, 90, 2):
            mine[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(mine)))
    rows += [(100 + i, " ".join([*rng.choice(vocabulary, 12), *passage, *rng.choice(vocabulary, int(rng.integers(2, 20)))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = joined_by_hand(rows)
    assert found(joins.ngram_components(docs)) == want
    numbered = written(docs.selectExpr("doc_id AS row", "text"), "rows")
    # crowded signatures go their own way to the same result
    got = joins.components(numbered, block=4, shard_signatures=500, crowd=3).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == sorted(collections.Counter(c for _, _, c in want.elements()).values())


def test_signatures_with_the_same_nodes_travel_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 300)] for _ in range(20)]
    rows = [(2 * i + j, " ".join([*t, *["more"] * j])) for i, t in enumerate(texts) for j in (0, 1)]
    entries = {}

    def seen(df, name, *options):
        out = written(df, name, *options)
        entries[name] = out.count()
        return out

    monkeypatch.setattr(joins, "written", seen)
    numbered = spark.createDataFrame(rows, "row long, text string")
    got = joins.components(written(numbered, "rows"), shard_signatures=500).groupBy("root").count().collect()
    assert len(got) == 20 and all(r["count"] == 2 for r in got)
    assert entries["shared-signatures"] == 40  # each pair has some fifty signatures in common


def test_texts_just_too_different_make_no_row_for_each_pair(spark, monkeypatch):
    """Twelve classes of near copies; two texts of different classes have a similarity of about 0.75."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(240):
        mine = list(base)
        at = 2 + 8 * int(rng.integers(12))
        mine[at : at + 3] = [f"edit{i}x{j}" for j in range(3)]
        rows.append((i, " ".join(mine)))
    made = {}

    def seen(df, name, *options):
        out = written(df, name, *options)
        if name.startswith("open-") and name != "open-signatures":
            made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(joins, "written", seen)
    numbered = written(spark.createDataFrame(rows, "row long, text string"), "rows")
    want = sorted(collections.Counter(c for _, _, c in joined_by_hand(rows).elements()).values())
    got = joins.components(numbered).groupBy("root").count().collect()
    assert len(want) == 12 and sorted(r["count"] for r in got) == want
    assert made and max(made.values()) <= 12 * len(rows), made  # a class at a time, not a pair at a time
    # groups in several tiles have the same result
    got = joins.components(numbered, block=16, group_hashes=2500, crowd=5).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == want


def test_groups_become_one_where_that_is_less(spark):
    groups = spark.createDataFrame([(0, 7, [1, 2, 3]), (1, 7, [2, 3, 4]), (2, 7, [1, 2, 4]), (3, 8, [1, 9]), (4, 8, [5, 6])], "group long, most long, nodes array<long>")
    sizes = spark.createDataFrame([(i, 10) for i in range(1, 10)], "node long, n long")

    def gathered(block, hashes):
        found = collections.defaultdict(set)
        for r in joins._gathered(groups, sizes, block, hashes).collect():
            found[tuple(r)[:4]].add(r["node"])
        return found

    one = gathered(10, 1000)
    assert one == {(True, 7, 0, 0): {1, 2, 3, 4}, (False, 3, 0, 0): {1, 9}, (False, 4, 0, 0): {5, 6}}
    several = gathered(2, 1000)  # in two blocks
    assert {1, 2, 3, 4} == set().union(*[v for k, v in several.items() if k[0]])
    assert all(any(set(two) <= v for v in several.values()) for two in itertools.combinations((1, 2, 3, 4), 2))
    assert not any(k[0] for k in gathered(1, 1000))  # four blocks would have more rows than the groups


def test_links_of_a_group_connect_components_only():
    """Sets 0 to 9 are alike and 2, 3 have one component; 10 to 12 are alike, with one component; 20 is alone."""
    sets = {i: np.r_[np.arange(40), 1000 + i].astype(np.uint64) for i in range(10)} | {i: np.r_[np.arange(60, 90), 2000 + i].astype(np.uint64) for i in (10, 11, 12)} | {20: np.arange(30, 70, dtype=np.uint64)}
    root = {i: i for i in sets} | {3: 2, 11: 10, 12: 10}
    rows = [(g, node) for g in (4, 6) for node in sets]
    shape = pa.schema([("merged", pa.bool_()), ("group", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("root", pa.int64()), ("hashes", pa.binary())])
    for size in (1, 5, 100):
        batches = pa.Table.from_pylist([{"merged": True, "group": g, "i": 0, "j": 0, "node": node, "root": root[node], "hashes": sets[node].tobytes()} for g, node in rows], shape).to_batches(size)
        links = [(r["a"], r["b"]) for out in joins._group_links(iter(batches)) for r in out.to_pylist()]
        assert len(links) == 18 and all(a < 10 and b < 10 and root[a] != root[b] for a, b in links), links
        for half in (links[:9], links[9:]):
            reached = {0}
            for _ in range(10):
                reached |= {x for a, b in [*half, (2, 3)] if {a, b} & reached for x in (a, b)}
            assert reached == set(range(10))
    more = [np.arange(i, 50 + 3 * i, dtype=np.uint64) for i in range(6)]
    got = joins._shared(more)
    assert all(got[i, j] == len(np.intersect1d(more[i], more[j])) for i, j in itertools.permutations(range(6), 2))


def test_entries_of_whole_and_crowded_signatures():
    """Signatures 5 and 6 of nodes 1 and 2; 7 of nodes 1 to 4, more than a crowd; 8 with a crowd elsewhere; 9 of one node."""
    sig = np.array([5, 6, 5, 6, 7, 7, 7, 7, 8, 8, 9], np.uint64)
    node = np.array([1, 1, 2, 2, 4, 3, 2, 1, 9, -1, 3])
    low = sig.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    plain = pa.table({"shard": [0], "salt": [0], "signatures": [low], "nodes": [node.tobytes()]})
    got = sorted((r["signature"], r["nodes"], r["met"], r["whole"]) for r in joins._shared_entries(3)(plain).to_pylist())
    assert got == [(5, [1, 2], 2, True), (6, [1, 2], 2, True), *[(7, [i], 4, False) for i in (1, 2, 3, 4)], (8, [9], 1, False)]
    crowd = pa.table({"shard": [0], "salt": [3], "signatures": [sig[4:9].tobytes()], "nodes": [node[4:9].tobytes()]})
    got = sorted((r["signature"], r["nodes"], r["met"], r["whole"]) for r in joins._shared_entries(3)(crowd).to_pylist())
    assert got == [*[(7, [i], 4, False) for i in (1, 2, 3, 4)], (8, [9], 1, False)]


def test_bucket_counts_bound_the_difference():
    words = ["a b c d " * 200, " ".join(f"w{i}" for i in range(1000)), " ".join(f"w{i}" for i in range(40, 1000)), " ".join(f"v{i}" for i in range(900))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(words)], ["node", "text"])
    found = [r for out in joins._counts(iter([batch])) for r in out.to_pylist()]
    sets = [np.frombuffer(r["hashes"], np.uint64) for out in joins._sets(iter([batch])) for r in out.to_pylist()]
    for x, y in itertools.combinations(range(4), 2):
        apart = len(np.setxor1d(sets[x], sets[y]))
        assert not joins._ruled_out([found[x]["counts"]], [found[y]["counts"]], np.array([apart]))[0]
    assert joins._ruled_out([found[1]["counts"]], [found[3]["counts"]], np.array([(found[1]["n"] + found[3]["n"]) // 9]))[0]
    assert all(len(r["counts"]) <= max(32, r["n"] / 2) for r in found)
    assert [r["n"] for r in found] == [len(s) for s in sets]


# Filter audit


def fails_by_hand(rows):
    first = {}
    for k, t, *_ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    for k, text, source in rows:
        t = text or ""
        words = t.encode().split()
        yield source or "", {
            f
            for f, bad in zip(
                "ABCDE",
                (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and first[t] < k),
            )
            if bad
        }, k


def audited_by_hand(rows, good, toxic):
    told = list(fails_by_hand(rows))
    out, shapley = {}, collections.Counter()
    for part in {p for p, _, _ in told}:
        for order in itertools.permutations("ABCDE"):
            left = [(f, k) for p, f, k in told if p == part]
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                mine = [f for p, f, _ in told if p == part and name in f]
                left = [x for x in left if name not in x[0]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(mine) - len(gone), sum(f == {name} for f in mine), sum(k in good for _, k in gone), sum(k in toxic for _, k in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def test_audit_edges(spark, edge, empty):
    more = [(k + 20 if k else k, t, s) for k, t, s in [(1, "a b c d", "s"), (2, "A B $", None), (3, "word " * 60, ""), (4, "word " * 60, "s"), (5, None, "s")]]
    rows = [*[(k, t, "s" if i % 2 else None) for i, (k, t) in enumerate(EDGE)], *more]
    docs = edge.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (21, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    facts = audits.judged(docs, labels)
    marks = {"good": "good_lost", "toxic": "toxic_lost"}
    want = audited_by_hand(rows, {1}, {5, 21})
    assert audited(audits.audit(facts, "ABCDE", marks)) == want
    assert audited(audits.audit(facts, "ABCDE", marks, range_bits=1)) == want
    assert audits.audit(audits.judged(empty, labels), "ABCDE", marks).count() == 0
    assert {k: v[4:6] for k, v in audited(audits.audit(audits.judged(docs, labels.limit(0)), "ABCDE", marks)).items()} == dict.fromkeys(want, (0, 0))


def test_galloping_merges():
    rng = np.random.default_rng(2)
    for sizes in ((0, 5), (5, 0), (1, 5000), (5000, 3), (700, 900), (3000, 3000)):
        a, b = (np.unique(rng.integers(0, 6000, n)) for n in sizes)
        assert (audits.positions(a, b) == np.searchsorted(b, a)).all()
        assert (audits.held(a, b) == np.isin(a, b)).all()
        c = np.unique(rng.integers(0, 6000, 50))
        assert (audits.union([a, b, c]) == np.unique(np.concatenate([a, b, c]))).all()
    assert len(audits.union([])) == 0


# Importance resampling


def features(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
    return words, [*words, *map(" ".join, zip(words, words[1:]))]


def drawn_by_hand(rows, target, percent=25, least=20, buckets=10_000):
    told = [(k, len(features(t)[0]), [zlib.crc32(f.encode()) % buckets for f in features(t)[1]]) for k, t in rows]
    s, t = collections.Counter(b for *_, bs in told for b in bs), collections.Counter(zlib.crc32(f.encode()) % buckets for x in target for f in features(x)[1])
    total_s, total_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out = []
    for k, n, bs in told:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    asked = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(asked[: percent * len(asked) // 100])}
    return collections.Counter((*r[:4], ranks.get(id(r))) for r in out)


def drawn(df):
    return collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 500)
    end = start + rng.choice([1, 2, 63, 64, 65, 128, 129, 900], 500)
    assert draws.crc32_of_spans(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]
    assert len(draws.crc32_of_spans(data, start[:0], end[:0])) == 0


def test_resampling_edges(spark, edge, empty):
    target = spark.createDataFrame([("x x c d",), (None,), ("",)], "text string")
    texts = ["x x c d", "", None]
    got = draws.resample(edge, target, percent=60, least_words=2)
    assert drawn(got) == drawn_by_hand(EDGE, texts, 60, 2)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert drawn(draws.resample(edge, target.limit(0))) == drawn_by_hand(EDGE, [])
    assert draws.resample(empty, target).count() == 0


def test_resampling_of_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert drawn(draws.op13_resampling(spark, FOLDER)) == drawn_by_hand(rows, target)
