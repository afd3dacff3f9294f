"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import _shared as S
from . import ann, audit, decontamination, langid, line_dedup, packing, pii, prefix_trie, sentencepiece_codec, simhash, substring, token_store, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.coded(S.table(spark, sf_dir, "documents", "doc_id", "text"), PIECES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(S.table(spark, sf_dir, "documents", "doc_id", "text"), most=3, least=20, short=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(S.table(spark, sf_dir, "documents", "doc_id", "text"), size=4, most=4)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(S.table(spark, sf_dir, "documents", "doc_id", "text"), S.table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(S.table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(S.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(S.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=20, top=20)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(S.table(spark, sf_dir, "documents", "doc_id", "text"), BPE, end_id=0)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(S.table(spark, sf_dir, "documents", "doc_id", "text"), length=13)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(S.table(spark, sf_dir, "pages", "page_id", "url", "html"), smallest=0)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(S.table(spark, sf_dir, "documents", "doc_id", "text"), WORDS, end_id=1, room=2048))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(S.table(spark, sf_dir, "documents", "doc_id", "text", "source"), S.table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(S.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_line_dedup, op3_simhash, op4_decontamination, op5_pii, op6_langid, op7_ann, op8_token_store, op9_substring, op10_warc,
        op11_packing, op12_filter_audit, op13_prefix_trie,
    )
}

# SQL of those that it can tell. The others hash (XXH64), tokenize, learn, search approximately or reach transitively;
# tests hold them against brute-force versions.
ORACLE: dict[str, str] = {
    "op9_substring": r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
  win as (select doc_id, i, min(doc_id) over (partition by words) as first from (select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as words from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13))),
  gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from win where first < doc_id),
  kept as (select k.doc_id, count(*) as n, string_agg(k.word, ' ' order by k.i) as t from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d) k anti join gone g on k.doc_id = g.doc_id and k.i = g.i group by k.doc_id)
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op10_warc": """select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, max(page_id) over (partition by coalesce(html, '')) as top,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((('0x' || substr(sha1(coalesce(html, '')), cast(i // 4 * 5 + 1 as int), 5))::bigint >> cast(15 - i % 4 * 5 as int)) & 31) + 1 as int), 1)), '') as payload_digest from pages)""",
    "op12_filter_audit": r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
  l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
  m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, cast(len(w) < 200 as int) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int)
    + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as int) + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(doc_id > first, false) as int) as mask from d left join l using (doc_id)),
  c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
  f as (select unnest(range(5)) as f),
  o as (select [a.f, b.f, c.f, d.f, e.f] as o from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s as (select array_to_string(list_transform(o, lambda x: substr('ABCDE', cast(x + 1 as int), 1)), '') as filter_order, cast(i as int) as step, cast(1 << o[i] as int) as own,
    cast(coalesce(list_sum(list_transform(o[1:i - 1], lambda x: 1 << x)), 0) as int) as before from o, unnest(range(1, 6)) as u(i)),
  r as (select part, filter_order, step, own,
    sum(case when mask & (before | own) = 0 then n else 0 end) as kept, sum(case when mask & own > 0 and mask & before = 0 then n else 0 end) as removed,
    sum(case when mask & own > 0 and mask & before > 0 then n else 0 end) as redundant, sum(case when mask = own then n else 0 end) as unique_fails,
    sum(case when mask & own > 0 and mask & before = 0 then good else 0 end) as good_lost, sum(case when mask & own > 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
    from c, s group by part, filter_order, step, own)
  select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
    cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from r""",
}
