"""Packing, the filter interaction audit and the trie of conversations, each against a plain version."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridwright.llm import audit, packing, prefix_trie, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abJHé̌́ \t\n\x0b\x85 ',.;!?s<|>09İKΣ🎉-“”"), max_size=40), max_size=6))
@example(["<|endoftext|> a", "J̌, ẖ.", "don't. it's,x", "a,́b", "", " "])
@example([])
def test_word_pieces_equal_the_library(texts):
    if texts:
        assert [x.tolist() for x in packing.tokens(WORDS).of(texts)] == [ids_of(t)[:-1] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    bins = packing.first_fit_decreasing(lengths, 64)
    plain = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = next((b for b in plain if sum(lengths[x] for x in b) + lengths[k] <= 64), None)
        if found is None:
            plain.append(found := [])
        found.append(k)
    assert bins == plain
    cut = packing.filled([[(k, 0, lengths[k]) for k in b] for b in bins], 64)
    sizes = [sum(p[2] for p in b) for b in cut]
    assert all(x == 64 or x & (x - 1) == 0 for x in sizes) and sum(sizes) == sum(lengths) and len({x for x in sizes if x < 64}) == sum(x < 64 for x in sizes)
    for k, n in enumerate(lengths):
        own = sorted((s, m) for b in cut for d, s, m in b if d == k)
        assert own[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] == n


def check_packed(texts, rows, room):
    """texts: (doc_id, text) of every row; rows: of digest()."""
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == {k for k, _ in texts}
    for k, t in texts:
        ids = ids_of(t)
        mine = sorted((r for r in pieces[k] if r.doc_tokens == len(ids)), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        total = own[-1][0] + own[-1][1]
        assert total == room or total < room and total & (total - 1) == 0


def test_packing(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["alpha", "Beta,", "gamma.", "d'accord", "é", "42"]) for _ in range(rng.choice([0, 1, 5, 30, 200, 900])))) for i in range(150)]
    texts += [(150, None), (151, ""), (152, "same"), (153, "same"), (None, "no id"), (154, "x " * 40_000), (155, "y" * 100_000)]
    df = spark.createDataFrame([(k, t, 7, "z") for k, t in texts], "doc_id long, text string, length int, sequence_id string")
    pieces = packing.packed(df, WORDS, room=256, group=64)
    check_packed(texts, packing.digest(pieces).collect(), 256)
    whole = packing.sequences(pieces).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(len(ids_of(t)) for _, t in texts)
    twice = packing.digest(packing.packed(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d")], "doc_id long, text string"), WORDS)).collect()
    assert sum(r.length for r in twice) == sum(len(ids_of(t)) for t in ("a b c", "a b c", "d"))
    assert packing.packed(df.limit(0), WORDS).count() == 0
    assert packing.packed(df, WORDS, room=256, group=64).drop("ids").collect() == pieces.drop("ids").collect()


def test_packing_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(texts, queries.op11_packing(spark, d).collect(), 2048)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    rows = []
    for k, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {x for x, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t))) if bad}
        if k is not None and any(o is not None and o < k and (u or "") == t for o, u, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, k in good, k in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, table, shapley = [r for r in rows if r[0] == part], [], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                before = set(order[:step])
                gone = [r for r in mine if x in r[1] and not r[1] & before]
                shapley[x] += len(gone)
                table.append(
                    (
                        x,
                        (
                            part, "".join(order), step + 1, sum(not r[1] & {*before, x} for r in mine), len(gone),
                            sum(x in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone),
                            sum(r[3] for r in gone)
                        )
                    )
                )
        out |= {(*row, shapley[x]) for x, row in table}
    return out


def test_audit(spark, monkeypatch):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["the", "Of", "to", "IN", "a#", "x%d" % i, "y%d" % rng.randrange(400)]) for _ in range(n)) for i, n in enumerate([3, 199, 200, 201, 260, 300, 700, 5])]
    docs = [(i, rng.choice([*base, base[2], base[2], None, "", " é\x0bÉ ", "Ab" * 30]), rng.choice(["hot", "hot", "hot", "b", None, ""])) for i in range(120)]
    docs += [(None, base[2], "hot"), (None, None, "b"), (7, base[2], "b"), (7, base[2], "hot"), (500, "w " * 300_000, "b"), (501, "w " * 300_000, "b")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 120, 2)] + [(2, 1, 1), (None, 1, 1), (4, None, None)]
    rng.shuffle(docs)
    d = spark.createDataFrame([(k, t, s, 1) for k, t, s in docs], "doc_id long, text string, source string, part int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit(docs, labels)
    got = [tuple(r) for r in audit.audited(d, lab).collect()]
    assert len(got) == len(want) and set(got) == want
    found = audit.masks(d).collect()
    assert sum(r.n for r in found) == len(docs)
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda raw: len(raw) % 3)  # chains of different texts
    links = audit.Chains()
    lost = [x for k, t, s in docs if k is not None for x in links.add(len(t or "") % 3, (t or "").encode(), k, 0, collections.Counter([s]))]
    smallest = {}
    for k, t, _ in docs:
        if k is not None:
            smallest[t or ""] = min(k, smallest.get(t or "", k))
    assert {(raw.decode(), k) for _, (raw, k, _, _) in links.links()} == set(smallest.items())
    assert sum(sum(x[2].values()) for x in lost) == sum(k is not None and smallest[t or ""] < k for k, t, _ in docs)
    assert audit.audited(d.limit(0), lab).count() == 0 and audit.audited(d, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def plain_trie(turns):
    own = collections.defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {c: tuple(own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:]) for c, v in own.items()}
    members = collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below = collections.defaultdict(set)
    for p in members:
        if p:
            below[p[:-1]].add(p)
    out, leaves, saved = set(), {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in below[p]) or 1
        saved[p] = sum(saved[x] for x in below[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [1, 3, 2000])
def test_trie(spark, limit):
    rng = random.Random(limit)
    say = [("user", "a"), ("user", "aa"), ("a", "user"), ("assistant", "é🎉"), (None, "b"), ("system", None), ("", "")]
    turns = []
    for c in [*range(0, 40), *range(100, 140), *range(205, 230)]:
        path = [say[0], say[3], say[1]] * 3 if c % 5 == 1 else [rng.choice(say[: rng.choice([1, 2, 7])]) for _ in range(rng.randrange(1, 8))]
        turns += [(c, i if i or rng.random() < 0.5 else None, *t) for i, t in enumerate(path)]
    turns += [(300, i, "user", f"t{i}") for i in range(60)] + [(301 + k, i, "user", f"t{i}") for k in range(30) for i in range(30 + k)]
    turns += [(None, 1, "user", "no id"), (10**12, 0, "user", "x" * 200_000)]
    rng.shuffle(turns)
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = [tuple(r) for r in prefix_trie.prefix_trie(df, limit).collect()] if limit > 1 else None
    if limit > 1:
        assert len(got) == len(set(got)) and set(got) == plain_trie(turns)
    else:
        few = [t for t in turns if t[0] is not None and t[0] < 12]
        got = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(few, "conv_id long, turn long, role string, text string"), limit).collect()]
        assert set(got) == plain_trie(few) and len(got) == len(set(got))


def test_trie_of_copies(spark, monkeypatch):
    """A third of all conversations are one; their ids cross many tasks, and come in several blobs."""
    monkeypatch.setattr(prefix_trie, "BLOB", 200)
    turns = [(c, t, "user", f"same {t}" if c % 3 == 0 else f"{c} {t}") for c in range(1, 700) for t in range(2)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
        got = [tuple(r) for r in prefix_trie.prefix_trie(rows, 50).collect()]
        assert set(got) == plain_trie(turns) and len(got) == len(set(got))
        none = prefix_trie.prefix_trie(rows.limit(0))
        assert none.count() == 0 and none.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_query(spark):
    d = "/root/testdata/sf0.01"
    turns = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.op13_prefix_trie(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(turns)
