"""Operators over the whole corpus: line dedup, SimHash, substring dedup, neighbours, token shards, archives, the
pipeline.
"""

import base64
import collections
import hashlib
import io
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gridwright.functions.distance import distance as edit_distance
from gridwright.llm import ann, graph, line_dedup, queries, similar, simhash, substring, token_store, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"


def corpus(n=60, seed=1):
    """Texts with exact and near copies, shared passages and lines, empty and null ones."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "the and Of to in".split() for b in "xyzäuv"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, common = line(20), line(9)
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            t = rng.choice(out)
        elif kind < 0.35 and any(out):
            w = list(rng.choice([t for t in out if t]))
            w[rng.randrange(len(w))] = rng.choice("ab \n")
            t = "".join(w)
        else:
            t = "\n".join(line(rng.randrange(0, 30)) for _ in range(rng.randrange(1, 5)))
            t += f" {passage}" if rng.random() < 0.3 else f"\n{common}" if rng.random() < 0.3 else ""
        out.append(t)
    out[3], out[4], out[5], out[6] = None, "", " \n ", "a" * 50_000
    return out


def frame(spark, texts, schema=DOC):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcé🎉", max_size=70), st.lists(st.tuples(st.integers(0, 69), st.sampled_from(["", "a", "xy"])), max_size=6)), min_size=8, max_size=40), st.integers(1, 4))
def test_many_distances_at_once(cases, k):
    left, right = [], []
    for a, edits in cases:
        b = a
        for at, c in edits:
            b = b[:at] + c + b[at + 1 :]
        left.append(a)
        right.append(b)
    assert line_dedup.within_all(left, right, k).tolist() == [distance(a, b) <= k for a, b in zip(left, right)]


@settings(max_examples=500, deadline=None)
@given(st.text("abcé", min_size=4, max_size=16), st.lists(st.tuples(st.integers(0, 15), st.sampled_from(["a", "b", ""]), st.booleans()), max_size=3), st.integers(1, 3))
def test_segments_meet_and_sketches_are_close(a, edits, k):
    b = a
    for at, c, insert in edits[:k]:
        b = b[:at] + c + b[at + (not insert) :]
    n = distance(a, b)
    sketch = line_dedup.sketches(*line_dedup.points([a, b]))
    assert int(np.bitwise_count(sketch[0] ^ sketch[1])) <= 4 * n
    if n <= k and min(len(a), len(b)) > k:
        long, short = sorted((a, b), key=len, reverse=True)
        key, line, _, role = line_dedup.entries([short, long], k)
        own, other = line_dedup.names([short, long])
        assert a == b or {*key[(role == line_dedup.FILES) & (line == own)].tolist()} & {*key[(role == line_dedup.ASKS) & (line == other)].tolist()}


@pytest.mark.parametrize("most,crowd,held", [(1, 4096, 96 << 20), (2, 1, 96 << 20), (3, 4096, 3000)])
def test_line_dedup(spark, monkeypatch, most, crowd, held):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "MOST_HELD", held)
    texts = corpus()
    at = collections.OrderedDict()
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= 20:
                at.setdefault(x, (i, k))
    forest = graph.Forest()
    lines = list(at)
    for i, a in enumerate(lines):
        for j in range(i):
            if abs(len(a) - len(lines[j])) <= most and edit_distance(a, lines[j]) <= most:
                forest.link(i, j)
    first = {x: at[lines[forest.find(i)]] for i, x in enumerate(lines)}
    want = [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < 20 or first[x] == (i, k)) for i, t in enumerate(texts)]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in line_dedup.digest(df.repartition(5), most).collect()}
    assert [got[i].kept_sha256 for i in range(len(texts))] == [hashlib.sha256((t or "").encode()).hexdigest() for t in want]
    stays = [sorted({first[x][0] for k, x in enumerate((t or "").split("\n")) if len(x) >= 20 and first[x] != (i, k)}) for i, t in enumerate(texts)]
    assert [got[i].stays_in for i in range(len(texts))] == [",".join(map(str, x)) for x in stays]
    clash = df.selectExpr("doc_id", "text", "1 as gone", "2 as near").unionByName(spark.createDataFrame([(None, texts[0], 3, 4)], "doc_id long, text string, gone int, near int"))
    rows = line_dedup.deduplicated(clash, most).collect()
    assert {r.doc_id: r.text for r in rows} == {**dict(enumerate(want)), None: texts[0]} and rows[0].asDict().keys() == {"doc_id", "text", "gone", "near"}
    emptied = {i for i, t in enumerate(texts) if any(len(x) >= 20 for x in (t or "").split("\n")) and not any(len(x) >= 20 for x in want[i].split("\n"))}
    assert emptied and {r.doc_id for r in line_dedup.deduplicated(df, most, drop_emptied=True).collect()} == set(range(len(texts))) - emptied
    assert line_dedup.digest(frame(spark, [])).count() == 0 and line_dedup.deduplicated(frame(spark, [])).count() == 0


def test_lines_with_a_changed_word_go(spark, tmp_path):
    """The query and the pipeline's stage reach three edits."""
    base = "and so the night whst the by for all of them"
    texts = [base, "and so the night whst is by for all of them\nhere stands a line of its own", "and so the night whst by for all of them today"]
    assert [distance(base, t.split("\n")[0]) for t in texts] == [0, 3, 10]
    texts.append(base.replace("so the", "so he").replace("night", "nights").replace("by", "my"))
    assert distance(base, texts[3]) == 3
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_near) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (0, 0), 3: (1, 1)}
    docs = frame(spark, texts).selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {0: texts[0], 1: "here stands a line of its own", 2: texts[2]}


def test_documents_with_short_lines_left_stay(spark):
    texts = ["this line stands in every document", "this line stands in every document\na short one", "this line stands in every document\n \n", "\n"]
    docs = frame(spark, texts).selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {0: texts[0], 1: "a short one", 3: "\n"}


def test_short_lines_that_repeat_go(spark, tmp_path):
    texts = ["share\n\nshare this", "share\n\n \nshare thin", "share this\nshare thin\nshare"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = [texts[0], "\n \nshare thin", ""]
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert [(got[i].n_removed, got[i].n_near, got[i].stays_in) for i in range(3)] == [(0, 0, ""), (1, 0, "0"), (3, 0, "0,1")]
    assert [got[i].kept_sha256 for i in range(3)] == [hashlib.sha256(t.encode()).hexdigest() for t in want]
    docs = frame(spark, texts).selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {0: want[0], 1: want[1]}


def test_filter_never_misses(spark):
    df = spark.range(5000).selectExpr("id * 7919 as k")
    held = line_dedup.filter_of(df, *line_dedup.id_spots(df.k))
    spots = df.unionByName(spark.range(5000).selectExpr("-id - 1 as k")).select("k", *(c.alias(n) for c, n in zip(line_dedup.id_spots(df.k), "pq"))).toPandas()
    ok = held.passes(spots.p.to_numpy(), spots.q.to_numpy())
    assert ok[spots.k >= 0].all() and ok[spots.k < 0].mean() < 0.01


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = corpus(120)
    got = {r.doc_id: r for r in simhash.grouped(frame(spark, texts).repartition(3)).collect()}
    prints = [plain_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    forest = graph.Forest()
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                forest.link(i, j)
    assert [got[i].component_id for i in range(len(texts))] == [forest.find(i) for i in range(len(texts))]
    kept = simhash.one_of_each(frame(spark, texts).selectExpr("*", "1 as kept_id", "2 as component_id")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({forest.find(i) for i in range(len(texts))})
    assert simhash.grouped(frame(spark, [])).count() == 0


def test_large_groups_of_sets_make_no_pairs(spark):
    """A key of many sets gives links that join them, not all pairs, whichever sets are alike."""
    rng = np.random.default_rng(0)
    base, n, least = np.arange(100, dtype=np.uint64), 700, Fraction(4, 5)
    sets = {i: np.sort(np.concatenate([base, np.array([1000 + i], np.uint64)])) if i % 7 else np.unique(rng.integers(0, 2**60, 101).astype(np.uint64)) for i in range(n)}
    held = spark.createDataFrame([(i, x.tobytes()) for i, x in sets.items()], "id long, shingles binary")
    rows = spark.createDataFrame([(5, i, 101, 0, i) for i in [*sets, *range(0, n, 3)]], "key long, id long, n int, at int, part long").repartition(5)
    found = similar.meetings(rows, least).collect()
    assert len(found) == rows.count() and {r.id for r in found} == set(sets) and all(r.a is None for r in found)
    assert similar.meetings(rows.withColumn("at", F.lit(-3)), least).where("at = 2 and a is null").count() == rows.count()
    few = similar.meetings(rows.where("id < 40").withColumn("key", F.col("id") % 2), least).collect()
    assert {(r.a, r.b) for r in few} == {(a, b) for b in range(40) for a in range(b) if a % 2 == b % 2}
    links = [tuple(r) for r in similar.in_blocks(rows, lambda ids: held, least).collect()]
    forest = graph.Forest()
    for a, b in links:
        assert similar.similarity(sets[a], sets[b]) >= least
        forest.link(a, b)
    assert len(links) < 4 * n and len({forest.find(i) for i in sets if i % 7}) == 1 and len({forest.find(i) for i in sets}) == 1 + n // 7
    assert similar.in_blocks(rows.withColumn("part", F.lit(1).cast("long")), lambda ids: held, least) is None


@pytest.mark.parametrize("few,block,often", [(64, 256, 4096), (2, 3, 1)])
def test_similar_documents(spark, monkeypatch, few, block, often):
    """All pairs of five-word shingle sets at 0.8 or more link, those far apart in SimHash too; the pipeline's stage
    takes them.
    """
    for name, value in (("FEW", few), ("BLOCK", block), ("OFTEN", often)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(8)
    texts = corpus(60)
    for _ in range(40):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 150))]
        texts.append(" ".join(w))
        for k in range(rng.randrange(1, 4)):
            v = list(w)
            for _ in range(rng.randrange(1, 5)):
                v[rng.randrange(len(v))] = f"x{k}"
            texts.append(" ".join(v))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    forest, far = graph.Forest(), 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                forest.link(i, j)
                far += (plain_print(texts[i]) ^ plain_print(texts[j])).bit_count() > 4
    df = frame(spark, texts)
    assert far > 10 and {r.doc_id: r.component_id for r in similar.grouped(df.repartition(3)).collect()} == {i: forest.find(i) for i in range(len(texts))}
    again = frame(spark, texts).unionByName(spark.createDataFrame([(3, texts[10]), (5, None), (None, texts[10]), (None, "only here"), (10, texts[10])], DOC))
    labels = collections.Counter((r.doc_id, r.component_id) for r in similar.grouped(again).collect())
    assert sum(labels.values()) == len(texts) + 5 and labels[None, None] == 1 and labels[10, forest.find(min(3, forest.find(10)))] >= 1
    docs = df.selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted({forest.find(i) for i in range(len(texts))})
    assert similar.grouped(frame(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4, unique=True))
def test_ring_keys_meet(fp, bits):
    """Fingerprints at up to four bits share a key under which the chain holds."""
    other = fp ^ sum(1 << b for b in bits)

    def keys(x):
        out = {}
        for i in range(5):
            turned = (x >> simhash.STARTS[i] | x << (64 - simhash.STARTS[i])) & (2**64 - 1)
            first, second = simhash.SEGMENTS[i], simhash.SEGMENTS[(i + 1) % 5]
            for bit in range(second):
                out[(turned & ((1 << first + second) - 1) & ~(1 << first + bit)) + ((i << 4 | bit) << 26)] = 1
        return out

    shared = np.array(sorted(keys(fp).keys() & keys(other).keys()), np.int64)
    a, b = (np.full(len(shared), x, np.uint64) for x in (fp, other))
    assert len(shared) and simhash.chained(a, b, shared).any()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 9), st.integers(1, 12))
def test_runs_are_bounded(keys, size, most):
    keys = sorted(keys)
    rows = pa.record_batch({"k": pa.array(keys, pa.int64()), "i": pa.array(range(len(keys)), pa.int64())})
    out = list(graph.bounded_runs((rows.slice(i, size) for i in range(0, len(keys), size)), "k", most))
    assert [i for t, _ in out for i in t.column("i").to_pylist()] == list(range(len(keys)))
    parts = [set(t.column("k").to_pylist()) for t, whole in out if not whole]
    assert all(len(p) == 1 and keys.count(*p) > most for p in parts) and all(t.num_rows <= most + size or whole for t, whole in out)
    whole = [set(t.column("k").to_pylist()) for t, ok in out if ok]
    assert sum(map(len, whole)) == len(set().union(*whole)) and not set().union(*whole) & set().union(*parts)


@pytest.mark.parametrize("crowd,block", [(4096, 2048), (5, 3)])
def test_ring_keys_in_spark_and_large_groups(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(0)
    centre = rng.integers(-(2**63), 2**63 - 1, 6)
    fps = sorted({int(c) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 63, k))) for c in centre for k in rng.integers(1, 5, 60)})
    df = spark.createDataFrame([(f, f) for f in fps], "fp long, id long")
    got = {r.node: r.component for r in graph.components(simhash.hamming_links(df)).collect()}
    forest = graph.Forest()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                forest.link(a, b)
    assert {f: got.get(f, f) for f in fps} == {f: forest.find(f) for f in fps}


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2000, 2001)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 2000: 2000, 2001: 2000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("length", [13, 5])
def test_substring_dedup(spark, length):
    texts = corpus(80, seed=4)
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    got = {r.doc_id: r for r in substring.deduplicated(frame(spark, texts).repartition(3), length, text=True).collect()}
    removed = 0
    for i, w in enumerate(words):
        out = [any(first[tuple(w[s : s + length])] < i for s in range(max(0, k - length + 1), min(k, len(w) - length) + 1)) for k in range(len(w))]
        kept = b" ".join(x for x, o in zip(w, out) if not o)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(out), hashlib.sha256(kept).hexdigest()), i
        assert got[i].kept_text == (texts[i] if not sum(out) else kept.decode())
        removed += sum(out)
    assert removed > 100
    odd = frame(spark, [texts[0], None]).unionByName(spark.createDataFrame([(None, texts[0])], DOC))
    assert {(r.doc_id, r.n_removed) for r in substring.deduplicated(odd).collect()} == {(0, 0), (1, 0), (None, 0)}
    assert substring.deduplicated(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring.deduplicated(odd, 13, 3)


def test_doubling_levels(spark):
    texts = corpus(50, seed=9) + ["z " + " ".join(f"q{i}" for i in range(100)), "y " + " ".join(f"q{i}" for i in range(100))]
    words = [(t or "").encode().split() for t in texts]
    want = {}
    for level in (5, 10, 20, 40, 80):
        seen = collections.defaultdict(set)
        for i, w in enumerate(words):
            for k in range(len(w) - level + 1):
                seen[tuple(w[k : k + level])].add(i)
        want |= {i: level for s in seen.values() if len(s) > 1 for i in s}
    assert {r.doc_id: r.longest for r in substring.repeats(frame(spark, texts), 5).collect()} == want
    assert want[50] == 80 and substring.repeats(frame(spark, texts[:1])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want, got = c.sql(queries.ORACLE[name]), queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert want.columns == got.columns and sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def plain_search(vectors, every, top):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and None not in v and len(v) and np.isfinite(v).all() and any(v)}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            out[q] = sorted(((-float(np.einsum("i,i->", v, w)), i) for i, w in ok.items() if i != q))[:top]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [1.0, 0.5] + [0.0] * 6) for i in range(60)]
    vectors += [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0, None] + [0.0] * 6), (480, [1.0]), (500, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "2 as entry")
    want = plain_search([(i, v) for i, v in vectors if v is None or len(v) != 1], 20, 20)
    rows = ann.search(df).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for _, i in near] and np.allclose([s for _, s in got[q]], [-s for s, _ in near], rtol=0, atol=1e-12)
    few = spark.createDataFrame(vectors[:5], "vec_id long, embedding array<double>")
    assert ann.search(few).count() == 4 and ann.search(few.limit(0)).count() == 0


def test_neighbour_recall(spark):
    """Against brute force, with lists and codes at work."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in ann.search(df).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (300 * 20) >= 0.9


def test_neighbour_recall_on_wide_rows(spark):
    """Many components."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 256)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.search(df).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (200 * 20) >= 0.9


def recalls(spark, x, kind="double"):
    """Of each query the share of its 20 true neighbours, ties to smaller ids, that is found."""
    got = collections.defaultdict(set)
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")).collect():
        got[r.query_id].add(r.vec_id)
    out = {}
    for q in range(0, len(x), 20):
        if x[q].any():
            s = np.where((x != 0).any(1), x @ x[q], -np.inf)
            s[q] = -np.inf
            out[q] = len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20
    return out


def test_neighbour_recall_among_ties(spark):
    """Products are small whole numbers: the smaller ids of many equal ones are the neighbours."""
    rng = np.random.default_rng(8)
    x = np.zeros((8000, 300))
    for _ in range(2):
        x[np.arange(8000), rng.integers(0, 300, 8000)] += 1
    assert np.mean(list(recalls(spark, x).values())) >= 0.9


def test_neighbour_recall_of_rare_queries(spark):
    """Few queries whose neighbours lie anywhere, beside many whose neighbours lie together."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(100, 48))[rng.integers(0, 100, 8000)] + 0.1 * rng.normal(size=(8000, 48))
    rare = np.flatnonzero(rng.random(8000) < 0.04)
    x[rare] = rng.normal(size=(len(rare), 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = recalls(spark, x)
    assert np.mean([found[q] for q in rare.tolist() if q in found]) >= 0.8 and np.mean(list(found.values())) >= 0.9


def test_neighbours_of_each_length(spark):
    """Vectors of any length are searched among those of their length, with lists and without."""
    rng = np.random.default_rng(10)
    size = rng.choice([3, 8, 12], 6000, p=[0.1, 0.5, 0.4])
    x = [rng.normal(size=k) for k in size.tolist()]
    found = collections.defaultdict(set)
    for r in ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        found[r.query_id].add(r.vec_id)
    for k, least in ((3, 1), (8, 0.9), (12, 0.9)):
        ids = np.flatnonzero(size == k)
        y, hits, asked = np.stack([x[i] for i in ids.tolist()]), 0, np.flatnonzero(ids % 20 == 0)
        for j in asked.tolist():
            s = y @ y[j]
            s[j] = -np.inf
            hits += len(found[int(ids[j])] & set(ids[np.argsort(-s)[:20]].tolist()))
        assert hits / (20 * len(asked)) >= least


def test_neighbours_whose_products_overflow(spark):
    """Products beyond the largest double are equal: the smaller ids win. Opposite ones come last."""
    x = np.random.default_rng(11).normal(size=(400, 6))
    rows = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x * 1e170)], "vec_id long, embedding array<double>")).collect()
    for q in range(0, 400, 20):
        got = [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q]
        assert got == [(i, np.inf) for i in range(400) if i != q and x[i] @ x[q] > 0][:20]


def shuffled(spark):
    """Bytes that each stage so far has written for shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, none, None)
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}


def test_neighbours_shuffle_no_more_than_the_table(spark, tmp_path):
    """Queries aren't dealt to each list that they look into."""
    x = np.random.default_rng(6).normal(size=(30_000, 32)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "e"))
    before, conf = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "-1")  # as with larger tables
    try:
        assert ann.search(spark.read.parquet(str(tmp_path / "e"))).count() == 1500 * 20
    finally:
        spark.conf.set(conf, was)
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 8 * x.nbytes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700), st.data())
def test_elias_fano(steps, data):
    values = np.cumsum(np.array(steps, np.uint64)) if steps else np.zeros(0, np.uint64)
    coded = token_store.EliasFano.of(values)
    i = data.draw(st.integers(0, len(values)))
    j = data.draw(st.integers(i, len(values)))
    assert (coded.range(i, j) == values[i:j]).all()
    if i < len(values):
        assert coded.select(i) == values[i]
    assert not len(values) or coded.low.nbytes + coded.high.nbytes <= len(values) * (3 + coded.width) / 8 + 16


def test_token_shards(spark):
    texts = [*corpus(), "a\n \nb", "a  b", "trail ", "<|endoftext|>"]
    shuffled = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], DOC).repartition(5)
    got = sorted(token_store.token_store(shuffled, BPE).collect())
    library, start = token_store.WordTokens(BPE).library, 0
    for r, (i, t) in zip(got, sorted((1000 - i, t) for i, t in enumerate(texts))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)
    null = token_store.token_store(spark.createDataFrame([(5, "b"), (None, "a"), (5, "b")], DOC), BPE).collect()
    assert [(r.doc_id, r.start) for r in sorted(null, key=lambda r: r.start)] == [(None, 0), (5, 2), (5, 4)]
    assert token_store.token_store(frame(spark, []), BPE).count() == 0


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    texts = ["a b <|endoftext|> c", "<|endoftext|>", "a<|endoftext|>b c", "<|endoftext|> <|endoftext|>", "a b c", "< |endoftext|> b"]
    library = Tokenizer.from_file(BPE)
    got = token_store.WordTokens(BPE).of(texts)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[0].tolist() and 50256 not in got[5].tolist()


def test_shard_access():
    docs = [(i, np.arange(i * 37 % 50, dtype="<u2").tobytes()) for i in range(1000)]
    sink = io.BytesIO()
    token_store.write_shard(sink, iter(docs), 2)
    shard = token_store.Shard(sink, sink.tell())
    for i in (0, 1, 255, 256, 257, 999):
        a, b = shard.bounds(i)
        assert shard.ids(a, b).tobytes() == docs[i][1]
    assert [(k, ids.tobytes()) for k, _, ids in shard.documents(most=100)] == docs
    with pytest.raises(ValueError):
        token_store.Shard(io.BytesIO(b"x" * 40), 40)


def test_archives(spark):
    pages = [(i, f"http://a.example/{i}", f"<p>{i % 7} é</p>" if i % 3 else f"<p>{i}</p>" * 3000) for i in range(60)]
    pages += [
        (100, None, None), (101, "x\r\nY: z", ""), (102, "u", None), (7, "http://a.example/7", "<p>0 é</p>"), (None, "n", "<p>0 é</p>"),
        (None, "n", "only"), (103, "same", "twice"), (103, "same", "twice")
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as top", "2 as sha1")
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        b, best = (h or "").encode(), top[h or ""]
        first = best < 0 or i == best
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, warc.archived(df).collect()), key=key) == sorted(want, key=key)
    assert {r.record_type for r in warc.archived(df, smallest=100_000).collect()} == {"response"}
    assert warc.archived(df.limit(0)).count() == 0


def test_archive_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.example/{i}", "x" * i * 100) for i in range(30)] + [(30, "http://c/", "")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    files = warc.write_archives(pages, folder, roll=500)
    assert len(files) > 5
    (tmp_path / "lost.warc.gz").write_bytes(b"\x1f\x8b half a file of a lost task")
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == 31 and all(r.payload_ok for r in got if r.record_type == "response")
    assert {len(r.payload) for r in got if r.payload is not None} == {i * 100 for i in range(30)}
    some = warc.read_archives(spark, folder, "target_uri", "payload_bytes").where("target_uri like 'http://a%'")
    assert some.count() == 15
    reader = warc.WarcReader({"path": folder}, warc.SCHEMA)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.In(("target_uri",), ("a", "b")), warc.EqualTo(("payload_bytes",), 1)]))
    assert len(left) == 1 and reader.tests == [("warc-type", "in", ("response",)), ("warc-target-uri", "in", ("a", "b"))]


def test_archives_of_other_writers():
    import gzip

    records = [warc.record("response", f"urn:page:{i}", "http://a", p := b"ab" * i, warc.digest(p), len(p), "d") for i in (0, 3, 40_000, 5)]
    for data in (b"".join(map(warc.member, records)), b"".join(map(gzip.compress, records)), b"".join(records)):
        for payloads in (True, False):
            got = list(warc.records(io.BytesIO(data), len(data), lambda h: True, payloads))
            assert [http["content-length"] for _, http, _, _ in got] == ["0", "6", "80000", "10"]
            one = list(warc.records(io.BytesIO(data), len(data), lambda h: h["warc-record-id"] == "<urn:page:5>", True))
            assert [p for *_, p, _ in one] == [b"ab" * 5]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    rows = {r.doc_id: r for r in out.collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert 0.8 * len(docs) < len(rows) < len(docs) and len(rows) == out.count()
    assert all(r.decoded_text == r.text and r.n_chars == len(r.text) and r.token_ids[0] == 1 for r in rows.values())
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in " ".join(r.text.lower().split()) for r in rows.values() for i in items)
    prints = [plain_print(r.text) for r in rows.values()]
    assert len(set(prints)) == len(prints)
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "Der die das ist ein", "de", "s", 3), (3, "123", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        assert set(odd.columns) <= set(got.columns), name
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES] == list(range(1, 11))


def test_rows_of_one_id(spark):
    """Rows come out as often as they came in, and nothing goes because of another row of the id."""
    w, v, q = (" ".join(f"{c}{i}" for i in range(20)) for c in "wvq")
    df = spark.createDataFrame([(1, w), (2, w), (2, v), (2, v), (3, q), (3, None), (None, w), (None, None), (4, w + " " + q)], DOC)
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.deduplicated(df).collect()))
    assert got == sorted([(1, 20, 0), (2, 20, 20), (2, 20, 0), (2, 20, 0), (3, 20, 0), (3, 0, 0), (0, 20, 0), (0, 0, 0), (4, 40, 40)])
    texts = {(r.doc_id, r.kept_text) for r in substring.deduplicated(df, text=True).collect()}
    assert texts == {(1, w), (2, ""), (2, v), (3, q), (3, None), (None, w), (None, None), (4, "")}
    a, b = "this line stands twice over", "and that line stands elsewhere"
    df = spark.createDataFrame([(1, a), (2, f"{a}\n{b}"), (2, f"only here, first place of it\n{a}"), (2, f"{a}\n{b}"), (None, a), (5, f"{b}.\nx"), (5, None)], DOC)
    rows = line_dedup.deduplicated(df, 3).collect()
    assert sorted((r.doc_id or 0, r.text or "-") for r in rows) == sorted([(1, a), (2, b), (2, "only here, first place of it"), (2, b), (0, a), (5, "x"), (5, "-")])
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in line_dedup.digest(df, 3).collect()) == sorted([(1, 1, 0), (2, 2, 1), (2, 2, 1), (2, 2, 1), (0, 1, 0), (5, 2, 1), (5, 0, 0)])


def test_large_groups_of_near_lines(spark, monkeypatch):
    """Chains of variants and false friends under shared keys, in one block and in several."""
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(80))
    lines = {base}
    for _ in range(120):
        s = list(rng.choice(sorted(lines)))
        for _ in range(rng.randrange(1, 8)):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh")
        lines.add("".join(s))
    lines = sorted(lines)
    forest = graph.Forest()
    for i, x in enumerate(lines):
        for j in range(i):
            if distance(x, lines[j]) <= 3:
                forest.link(i, j)
    want = {}
    for i in range(len(lines)):
        want.setdefault(forest.find(i), set()).add(lines[i])
    docs = line_dedup.with_rows(frame(spark, lines))
    names = dict(zip(line_dedup.S.signed(line_dedup.names(lines)).tolist(), lines))
    for block in (2048, 16):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = {}
        for r in line_dedup.classes(docs, 3, 20).collect():
            got.setdefault(r.component, set()).add(names[r.node])
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)
        assert max(map(len, got.values())) > 10


def test_hot_windows_are_a_row_from_each_task():
    """Windows that many of a task's documents share go on once, and none that another task needs is lost."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        tasks = [[(int(d), int(d) % 5 if rng.random() < 0.3 else 100 + int(d), rng.integers(0, 6, rng.integers(1, 6))) for d in rng.integers(0, 12, rng.integers(1, 8))] for _ in range(3)]
        shuffled, known = [], set()
        for t in tasks:
            h, d, text = (np.concatenate(x) for x in zip(*((np.unique(w), np.full(len(np.unique(w)), d), np.full(len(np.unique(w)), name, np.uint64)) for d, name, w in t)))
            h, d, state = substring.settled(h, d, text)
            known |= set(zip(h[state == substring.KNOWN].tolist(), d[state == substring.KNOWN].tolist()))
            shuffled += zip(h[state == substring.OPEN].tolist(), d[state == substring.OPEN].tolist())
        owners = collections.defaultdict(set)
        for t in tasks:
            for d, _, w in t:
                for x in w.tolist():
                    owners[x].add(d)
        assert all(len(owners[x]) > 1 for x, _ in known)
        seen = collections.defaultdict(set)
        for x, d in shuffled:
            seen[x].add(d)
        open_ = {(x, d) for x, d in shuffled if d != substring.NOBODY and len(seen[x]) > 1}
        assert known | open_ == {(x, d) for x, ds in owners.items() for d in ds if len(ds) > 1}
