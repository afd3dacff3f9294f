"""Filter interaction audit: what each order of the filters removes, and why.

Each document gets a mask of the filters that it fails, looked at by itself; all orders follow from counts of masks. The
filters A to D look at one text. E, an identical text under a smaller id, is found by an RDD that is routed by a
fingerprint: a key's chain holds each different text in full with its least id and gives out the ids that aren't the
least. Texts meet in their task first and only the least row of each goes on, so a text that a third of all documents
share sends one row a task. Vectors of counts by mask are merged by part of the corpus.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"
DUPLICATE = "E"
HELD = 32_000_000  # bytes of texts that a task compares at once: before the shuffle, and about as many behind it


def short(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def repetitive(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def shouting(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 2 * len(text)


def marked(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(raw.translate(None, MARKS)) < len(raw)


Filter = Callable[[str, bytes, list[bytes]], bool]
FILTERS: dict[str, Filter] = {"A": short, "B": repetitive, "C": shouting, "D": marked}


class Chains:
    """Different texts by fingerprint, each with its least id, the mask of its own filters, and how many rows of that id
    each part has. add() gives out, as (id, part, rows), what a smaller id beats.
    """

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.size = 0

    def add(self, key: int, raw: bytes, doc_id: int, mask: int, parts: Counter) -> Iterator[tuple[int, int, Counter]]:
        chain = self.chains.setdefault(key, [])
        for link in chain:
            if link[0] == raw:
                if link[1] == doc_id:
                    link[3].update(parts)
                elif link[1] < doc_id:
                    yield doc_id, mask, parts
                else:
                    yield link[1], link[2], link[3]
                    link[1], link[3] = doc_id, parts
                return
        chain.append([raw, doc_id, mask, parts])
        self.size += len(raw)

    def links(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.chains.items():
            for link in chain:
                yield key, link


def masks(docs: DataFrame, filters: dict[str, Filter] = FILTERS) -> DataFrame:
    """The filters that each document fails: doc_id, part, mask (bit i: the i-th filter, the last one: an identical text
    under a smaller doc_id), n (rows of this kind). docs: doc_id, text, source; others are ignored.

    A null text is empty, a null source the empty part. A row without doc_id has no smaller id and is none, so it is
    never a copy; rows of one doc_id aren't copies of each other.
    """
    S.ship(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))).rdd
    tests, copy = list(filters.values()), 1 << len(filters)

    def loser(doc_id: int, mask: int, parts: Counter) -> Iterator[tuple]:
        key = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True))
        for part, n in parts.items():
            yield key, (None, doc_id, mask | copy, part, n)

    def routed(documents: Iterator) -> Iterator[tuple]:
        chains = Chains()
        for doc_id, text, part in documents:
            raw = text.encode()
            words = raw.split()
            mask = sum(1 << i for i, fails in enumerate(tests) if fails(text, raw, words))
            key = xxhash.xxh64_intdigest(raw)
            if doc_id is None:
                yield key, (None, None, mask, part, 1)
                continue
            for beaten in chains.add(key, raw, doc_id, mask, Counter([part])):
                yield from loser(*beaten)
            if chains.size > HELD:
                yield from chains.links()
                chains = Chains()
        yield from chains.links()

    def judged(entries: Iterator[tuple]) -> Iterator[tuple]:
        chains = Chains()
        for key, value in entries:
            if value[0] is None:
                yield value[1:]
                continue
            for doc_id, mask, parts in chains.add(key, *value):
                for part, n in parts.items():
                    yield doc_id, mask | copy, part, n
        for _, (_, doc_id, mask, parts) in chains.links():
            for part, n in parts.items():
                yield doc_id, mask, part, n

    # A task of the second step holds the different texts that reach it, so their number follows the bytes of all texts.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / HELD))
    found = rows.mapPartitions(routed).partitionBy(tasks, lambda key: key).mapPartitions(judged)
    return docs.sparkSession.createDataFrame(found, "doc_id long, mask int, part string, n long", verifySchema=False)


def counted(found: DataFrame, labels: DataFrame, n_filters: int = 5):
    """An RDD of (part, an array of a row for each mask: documents, good ones, toxic ones).

    labels: doc_id, quality, toxic; a document is good (toxic) if a row of its id says so, and neither without one.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = found.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)), "n").rdd

    def add(vector: np.ndarray, row: tuple) -> np.ndarray:
        mask, good, toxic, n = row
        vector[mask] += (n, n * good, n * toxic)
        return vector

    def first(row: tuple) -> np.ndarray:
        return add(np.zeros((1 << n_filters, 3), np.int64), row)

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    return rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(first, add, merge)


def orders(part: str, vector: np.ndarray, letters: str) -> Iterator[tuple]:
    """The rows of a part: each order of the filters, step by step."""
    every = np.arange(len(vector))
    failing = {x: every & 1 << i > 0 for i, x in enumerate(letters)}
    rows, shapley = [], Counter()
    for order in itertools.permutations(letters):
        kept = np.ones(len(vector), bool)
        for step, x in enumerate(order, 1):
            removed, redundant = failing[x] & kept, failing[x] & ~kept
            kept = kept & ~failing[x]
            gone = vector[removed].sum(axis=0).tolist()
            shapley[x] += gone[0]
            rows.append((x, (part, "".join(order), step, int(vector[kept, 0].sum()), gone[0], int(vector[redundant, 0].sum()), int(vector[1 << letters.index(x), 0]), gone[1], gone[2])))
    for x, row in rows:
        yield *row, shapley[x]


def audited(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] = FILTERS) -> DataFrame:
    """All orders of the filters and the search for copies (E) over documents (doc_id, text, source), by part.

    A row for each part (source; null: the empty string), filter_order and step (from 1; its filter is that letter), with
    counts of documents: kept after this step; removed here; redundant (fail its filter, removed before); unique_fails
    (fail its filter only); good_lost and toxic_lost (removed here and labelled so); shapley (removed by its filter in
    all orders together). Rows that repeat an id count each; an empty table gives no rows. See masks for nulls.
    """
    letters = "".join(filters) + DUPLICATE
    vectors = counted(masks(docs, filters), labels, len(letters))
    rows = vectors.flatMap(lambda x: orders(x[0], x[1], letters))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)
