"""Operators that look at each row by itself: SentencePiece, personal data, language, decontamination."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright.llm import _shared, decontamination, langid, pii
from gridwright.llm import sentencepiece_codec as sp

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  a  b ", "\n", "a\x00b", "ﬁ é", "a▁b", "▁", "<s>", "�", "x" * 200, "ab" * 3000, "日本語 テキスト 🎉", " " * 17, "é́", "a\t\tb"]


def rows(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


def test_pieces_equal_the_library(spark):
    c = sp.Codec(PIECES, check="texts")
    ids, back = c.both(ODD)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == c.library.encode(ODD, add_bos=True, add_eos=True)
    assert back == [c.library.decode(c.library.encode(t)) for t in ODD]
    got = {r.doc_id: r for r in sp.coded(rows(spark, [None, *ODD]), PIECES).collect()}
    assert got[0].n_tokens == 2 and got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == len(ODD) + 1
    empty = sp.coded(rows(spark, []), PIECES)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    more = sp.with_tokens(rows(spark, ["a b"]).selectExpr("doc_id", "text", "1 as decoded_text", "2 as other"), PIECES).head()
    assert (more.token_ids, more.decoded_text, more.decoded_text_input, more.other) == (c.library.encode("a b", add_bos=True, add_eos=True), "a b", 1, 2)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe ▁\nthZ.é日🎉"), max_size=60))
def test_both_agendas_agree(text):
    c = sp.codec(PIECES)
    segment = "▁" + text
    sym, counts = c.merge_all([segment])
    assert c.merge_one([int(c.table[ord(x)]) for x in segment]) == sym.tolist() and counts.tolist() == [len(sym)]
    assert np.frombuffer(c.encode([text])[0], "<u4").tolist() == c.library.encode(text, add_bos=True, add_eos=True)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if x) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.-+ ()0123459%_é"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_in_long_runs():
    for text in ("1" * 20_000, "a@" * 5_000, "1.2.3." * 3_000, "+" * 5_000 + "1", "4111 1111 1111 1111", "1.2.3.256 1.2.3.4.5.6.7.8"):
        assert pii.base_spans(text) == plain_base(text) if len(text) < 100 else pii.base_spans(text) is not None
    assert pii.base_spans("x 4111 1111 1111 1111, +1 (555) 555-0100 é me@a.b") == plain_base("x 4111 1111 1111 1111, +1 (555) 555-0100 é me@a.b")


def test_detector(spark):
    texts = [f"write to user{i}@mail.example.com now" for i in range(40)] + [f"host 10.0.{i}.1 is up" for i in range(40)] + [
        f"card 4111111111111111 and 411111111111{i:04d}" for i in range(40)
    ] + [f"call +1 ({200 + i}) 555-01{i:02d} today" for i in range(40)] + ["no data in 2020 or 12345"] * 20 + [None, ""]
    df = rows(spark, texts)
    got = {r.doc_id: r for r in pii.detected(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    assert got[165].spans == "" and got[180].spans == got[181].spans == ""
    detector = pii.Detector.fit([t for t in texts if t])
    assert ("card", 5, 24) in detector.spans("card 4111.1111.1111.1111 ok")[1]
    clean = pii.redacted(df.where("doc_id in (0, 180)"), detector).orderBy("doc_id").collect()
    assert clean[0].text == "write to [email] now" and clean[1].text is None
    assert pii.detected(rows(spark, [])).count() == 0


def test_added_spans_on_unseen_rewritings():
    """Families of rewritings and texts that training hasn't seen, by kind; and no span that isn't there."""
    import pyarrow.parquet as pq

    every = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    texts = [t for t in every if re.search("[0-9@]", t)]
    told = {r["kind"]: r for r in pii.evidence(texts)}
    assert all(told[k]["right"] >= 10 and told[k]["recall"] >= 0.5 and told[k]["precision"] >= 0.95 for k in pii.KINDS), told
    d = pii.Detector.fit(texts)
    for text, span in (("write to john (at) example (dot) com", ("email", 9, 36)), ("call (415) 555-2671 today", ("phone", 5, 19)), ("host 10[.]0[.]0[.]1 is up", ("ip", 5, 19))):
        assert span in d.spans(text)[1]
    for text in ("we met at noon. Then at five", "on 2024-05-17 10:30 it was", "see page 12.5 of 300", "1,234,567,890 people"):
        assert d.spans(text)[1] == []
    assert sum(len(set(e) - set(b)) for b, e in map(d.spans, every)) <= 0.02 * len(every)
    rng = np.random.default_rng(0)
    for kind, s in (("card", "4111 1111 1111 1111"), ("phone", "+44 20 7946 0958"), ("email", "a.b@c.de"), ("ip", "1.22.3.4")):
        for name, write in pii.FAMILIES[kind].items():
            assert write(s, rng) != s, name
            if kind in ("card", "phone"):
                assert pii.only_digits(write(s, rng)).endswith(pii.only_digits(s)[1:])


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = pii.Boosted().fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "12 34 !", "de"), (None, "Der die das ist", "de")], "doc_id long, text string, lang string")
    out = langid.identified(d.select("doc_id", "text", "lang").unionByName(extra))
    truth = {r.doc_id: r.lang for r in d.collect()}
    got = out.collect()
    assert len(got) == len(truth) + 4 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id and r.doc_id >= 10**6} == {10**6: "und", 10**6 + 1: "und", 10**6 + 2: "und"}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    own = langid.predicted(d.limit(3).selectExpr("doc_id", "text", "'x' as lang_pred", "0.5D as score"), None, names=("a", "b")).collect()
    assert {(r.lang_pred, r.score, r.a, r.b) for r in own} == {("x", 0.5, "und", 0.0)}
    none = langid.identified(d.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_words_and_hashes():
    texts = ["", None, " a  b\tc\x0b\x0cd\r\ne ", "é\x85x y", "x" * 100, " ".join(map(str, range(3000)))]
    for t, h in zip(texts, _shared.hashed_texts(texts)):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert h.shape == (2, len(ws)) and (_shared.hashed_words(t, piece=64) == h).all()
        assert [_shared.hashed_words(w)[:, 0].tolist() for w in ws[:50]] == h[:, :50].T.tolist()


def thue_morse(bits):
    """A word and its complement, whose letters' polynomials agree modulo 2**64 for every odd base once they are long.
    """
    word = "".join("ab"[k.bit_count() & 1] for k in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_no_pattern_of_letters_collides():
    seen = {}
    words = [w for k in range(1, 13) for w in thue_morse(k)] + ["a" * k for k in range(1, 300)] + ["\x00" * k for k in range(1, 70)] + [f"w{k}" for k in range(20_000)]
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        for half in _shared.spans_hash(b, np.array([0]), np.array([len(b)])):
            assert seen.setdefault(int(half[0]), w) == w


def test_pieces_of_words_that_fooled_polynomials(spark):
    texts = [*thue_morse(11), " ".join(thue_morse(12))]
    c = sp.codec(PIECES)
    got = {r.doc_id: r.ids_sha256 for r in sp.coded(rows(spark, texts), PIECES).collect()}
    want = [np.array(c.library.encode(t, add_bos=True, add_eos=True), "<u4").tobytes() for t in texts]
    assert got == {i: hashlib.sha256(w).hexdigest() for i, w in enumerate(want)}


def test_a_text_that_differs_gets_the_librarys_ids():
    c = sp.Codec(PIECES)
    c.byte_ids = c.byte_ids[::-1]  # as if this agenda were wrong about characters outside the vocabulary
    text = "plain words and 𓀀 signs"
    ids, back = c.both([text])
    assert ids[0].tolist() == c.library.encode(text, add_bos=True, add_eos=True) and back == [text]


def brute_items(text, items, least=0.8):
    shingles = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    w, out = text.encode().lower().split(), set()
    for k, t in items:
        v = t.encode().lower().split()
        for i in range(max(1, len(w) - len(v) + 1)):
            a, b = shingles(w[i : i + len(v)]), shingles(v)
            if w and v and sum((a & b).values()) / sum((a | b).values()) >= least:
                out.add(k)
    return sorted(out)


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    word = lambda: "w" + str(rng.integers(0, 400))
    items = [(i, " ".join(word() for _ in range(rng.integers(1, 40)))) for i in range(40)] + [(90, ""), (91, None)]
    texts = [None, "", "one two"]
    for k in range(120):
        w = items[k % 40][1].split()
        for _ in range(int(rng.integers(0, 4))):
            i = int(rng.integers(0, len(w)))
            w[i : i + 1] = [[], ["odd"], [w[i], "odd"]][int(rng.integers(0, 3))] or ["z"]
        base = [word() for _ in range(int(rng.integers(0, 60)))]
        at = int(rng.integers(0, len(base) + 1))
        texts.append(" ".join(base[:at] + [x.upper() for x in w] + base[at:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.report(rows(spark, texts), bench).collect()}
    usable = [(k, t) for k, t in items if t]
    for i, t in enumerate(texts):
        assert got[i].item_ids == ",".join(map(str, brute_items(t or "", usable))), i
    kept = decontamination.decontaminated(rows(spark, texts).selectExpr("*", "1 as item_id"), bench)
    assert kept.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].contaminated}
    assert decontamination.report(rows(spark, []), bench).count() == 0
    assert {r.contaminated for r in decontamination.report(rows(spark, texts), bench.limit(0)).collect()} == {False}


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 2**63, 20).astype(np.uint64) for _ in range(300)]
    items = decontamination.Items(list(range(300)), words, 5, 20)
    flips = [rng.permutation(64)[: rng.integers(0, 26)] for _ in range(200)]
    prints = np.array([items.prints[i] ^ np.bitwise_or.reduce(np.uint64(1) << f.astype(np.uint64)) if len(f) else items.prints[i] for i, f in enumerate(flips)], np.uint64)
    full = {(i, j) for i in range(200) for j in range(300) if int(prints[i] ^ items.prints[j]).bit_count() <= 20}
    assert set(zip(*(x.tolist() for x in items.lookup(prints)))) == full
    assert len(items.near) > len(items.filed[0][1])  # so far the filed values were gone through; now all close values are tried
    every = decontamination.masks(16, 5).astype(np.int64)

    class Short(np.ndarray):
        def __len__(self):
            return 0

    items.near = every.view(Short)
    assert set(zip(*(x.tolist() for x in items.lookup(prints)))) == full


def test_spelled_at_is_proposed():
    for text in ("write to john at example.com now", "john AT example.com", "john\tat\nexample.com", "john at example dot com"):
        want = [m.span() for m in pii.LOOSE["email"].finditer(text)]
        assert want and [(a, b) for k, a, b in pii.proposals(text) if k == "email"] == want


def test_items_in_blocks_keep_rows(spark, monkeypatch):
    """Rows that repeat a doc_id, or have none, stay rows of their own when items come in several blocks."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(7)]
    docs = [(1, items[0][1]), (1, items[1][1] + " and " + items[2][1]), (None, items[3][1]), (None, "nothing of them"), (2, items[4][1] + " " + items[5][1][:-4]), (3, None)]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontamination.report(df, benchmark).collect()))
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 2)
    assert len(one) == len(docs) and sorted(map(str, decontamination.report(df, benchmark).collect())) == one


def test_samples_are_bounded_by_rows(spark):
    """An id that many rows repeat doesn't bring them all to the driver."""
    many = spark.range(5000).selectExpr("1L as doc_id", "concat('ein Satz mit Zahl ', id) as text", "if(id % 2 = 0, 'de', 'en') as lang")
    seen = []
    real, pii.Detector.fit = pii.Detector.fit, classmethod(lambda cls, texts: seen.append(len(texts)) or cls(None, {}))
    try:
        pii.train(many, 300)
    finally:
        pii.Detector.fit = real
    assert seen == [300]
    model = langid.train(many.withColumn("doc_id", many.doc_id + 1), 20)
    assert model is None or len(model.landmarks) <= 40


def test_kernel_ridge_against_a_plain_version():
    """With every text a landmark, Nystroem is exact: scores are those of kernel ridge regression with the full kernel.
    """
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(a), 60)) for a in ("abcd e", "cdef g") for _ in range(12)]
    langs = ["x"] * 12 + ["y"] * 12
    model = langid.Model.fit(texts, langs, landmarks=12, ridge=1e-2)
    grams = [{t.encode()[i : i + n] for n in langid.SIZES for i in range(len(t) - n + 1)} for t in texts]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    x = langid.features(texts)
    assert np.abs(x @ x.T - k).max() < 0.05  # but for n-grams that share a place
    k = (x @ x.T).astype(float)
    y = np.where(np.array(langs)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    # Weighted ridge with an intercept that is penalised alike: (K + 1 + lambda / w) alpha = y.
    alpha = np.linalg.solve(k + 1 + 1e-2 / 2 * 12 * np.eye(24), y)
    s = 4 * (k + 1) @ alpha
    e = np.exp(s - s.max(1, keepdims=True))
    assert np.abs(model.scores(texts) - e / e.sum(1, keepdims=True)).max() < 0.02


def test_spans_of_many_numbers_and_ranges():
    text = " ".join(f"call 00{49_000_000_000 + i} or +49 30 {1_000_000 + i}" for i in range(4000))
    detector = pii.Detector.fit([f"call +1 ({200 + i}) 555-01{i:02d} today" for i in range(60)] + ["none in 2020 or 12345"] * 40)
    base, every = detector.spans(text)
    assert len(base) == 4000 and set(base) <= set(every)
    ends = [s[1:] for s in sorted(every, key=lambda s: s[1])]
    assert all(b <= c for (_, b), (c, _) in zip(ends, ends[1:]))
    r = pii.Ranges()
    for a, b in ((0, 5), (3, 9), (20, 30)):
        r.cover(a, b)
    assert [r.meets(*x) for x in ((9, 20), (8, 9), (0, 1), (29, 40), (30, 31))] == [False, True, True, True, False]
    assert r.add(10, 12) and not r.add(11, 14) and r.add(12, 20) and r.starts == [0, 10, 12, 20]
