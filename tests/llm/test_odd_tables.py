"""One odd table through all operators over documents, and through the pipeline's stages: nulls, empty and very long
texts, repeated rows and ids, ties, columns whose names clash, and no rows at all.
"""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridwright.llm import _shared, audit, decontamination, langid, line_dedup, packing, pii, sentencepiece_codec, simhash, similar, substring, token_store

PIECES, BPE, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = " ".join(f"word{i % 7919}" + ("\n" if i % 50 == 0 else "") for i in range(160_000))  # over a million characters
PLAIN = "the quick brown fox jumps over the lazy dog and so it goes on for a while until the end"
TEXTS = [
    (0, PLAIN), (1, None), (2, ""), (3, " \n\t\x0b"), (4, LONG), (5, LONG), (6, PLAIN + " again"), (6, PLAIN + " again"), (6, "another text under the same id, with 4111 1111 1111 1111 in it"),
    (None, PLAIN), (None, None), (None, "no id and nothing like it anywhere else in this table of odd rows"), (7, PLAIN), (-3, "ünïcödé 🎉 \x00 text"), (9, "x" * 5000), (10, "a b c"),
]
CLASHING = (
    "component_id", "fingerprint", "n_tokens", "ids", "score", "lang_pred", "row", "key", "fp", "state", "part", "length", "start", "line", "marks",
    "item_ids", "kept_text", "id", "n", "mask", "draw", "token_ids", "decoded_text"
)
ITEMS = [(1, PLAIN), (1, "something else entirely for the same item of the benchmark"), (None, PLAIN), (3, None), (4, ""), (5, PLAIN)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(
        [(k, t, "en" if i % 2 else None, "hot" if i % 3 else None, None if t is None else len(t)) for i, (k, t) in enumerate(TEXTS)],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)}).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(7))


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (0, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "1": lambda d, i: sentencepiece_codec.coded(d, PIECES),
    "2": lambda d, i: line_dedup.digest(d, 3, 20, short=True),
    "3": lambda d, i: simhash.grouped(d),
    "3 exact": lambda d, i: similar.grouped(d),
    "4": lambda d, i: decontamination.report(d, i),
    "5": lambda d, i: pii.detected(d),
    "6": lambda d, i: langid.identified(d),
    "8": lambda d, i: token_store.token_store(d, BPE),
    "9": lambda d, i: substring.deduplicated(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, docs, items, name):
    out = OPERATORS[name](docs, items).cache()
    assert sorted(((r.doc_id is not None, r.doc_id or 0) for r in out.select("doc_id").collect())) == sorted((k is not None, k or 0) for k, _ in TEXTS)
    by = {r.doc_id: r for r in out.where("doc_id not in (6) and doc_id is not null").collect()}
    if name == "1":
        assert by[1].n_tokens == by[2].n_tokens == 2 and by[4].ids_sha256 == by[5].ids_sha256
    elif name == "2":
        assert by[4].n_removed < by[4].n_lines == by[5].n_removed and by[1].n_lines == 0
    elif name in ("3", "3 exact"):
        assert by[5].component_id == 4 and by[7].component_id == by[0].component_id == 0 and by[1].component_id == by[2].component_id == by[3].component_id
    elif name == "4":
        assert {k for k, r in by.items() if r.contaminated} == {0, 7} and by[0].item_ids == "1,5"
    elif name == "6":
        assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und"
    elif name == "9":
        assert by[5].kept_sha256 == hashlib.sha256(b"").hexdigest() and by[7].n_removed == by[7].n_words and by[0].n_removed == by[4].n_removed == 0
    out.unpersist()
    empty = OPERATORS[name](docs.limit(0), items)
    assert empty.count() == 0 and empty.columns == out.columns


def test_packing_and_audit(spark, docs):
    pieces = packing.digest(packing.packed(docs, WORDS)).collect()
    library = Tokenizer.from_file(WORDS)
    assert {(r.doc_id, r.doc_tokens) for r in pieces} == {(k, 1 + len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in TEXTS}
    assert sum(r.length for r in pieces if r.doc_id == 4) == next(r.doc_tokens for r in pieces if r.doc_id == 4)
    found = audit.masks(docs).collect()
    assert sum(r.n for r in found) == len(TEXTS) and {r.doc_id for r in found if r["mask"] >> 4} == {5, 7, 2}
    assert audit.audited(docs, labels(spark)).count() == 2 * 600


def test_stages(spark, docs, tmp_path):
    """Each stage on what the one before kept; columns come as they were, and tables made on the way go."""
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        with _shared.kept_for(spark) as made:
            rows, path = _shared.stored_at(stage(spark, rows, str(tmp_path)), name)
            made.remove(path)
        extra = {"token_ids", "decoded_text", "token_ids_input", "decoded_text_input"}
        assert set(rows.columns) - extra == set(docs.columns) - extra, name
        left = sorted((r.doc_id is None, r.doc_id or 0) for r in rows.select("doc_id").collect())
        if name == "language_id":
            assert all(k not in (1, 2, 3) for _, k in left if not _) and (False, 4) in left
        if name == "simhash_near_dedup":
            assert (False, 5) not in left and (False, 7) not in left and (False, 4) in left
        if name == "benchmark_decontamination":
            assert (False, 0) not in left and (False, 4) in left
    assert rows.where("doc_id = 4").head().decoded_text is not None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
