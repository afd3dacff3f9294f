"""Packing: documents as token ids in sequences of at most so many tokens, by first-fit decreasing in random groups.

Documents are dealt to tasks and put in order by a hash of the whole row, so a group (so many documents that follow one
another) is a random sample of the corpus whatever its sources are. Full lengths of a document are sequences of their
own. What is left of the documents of a group goes, longest first, to the first open sequence with room; a tournament
tree over the free places finds it in logarithmic time. As documents may be cut, the emptiest sequences of the group are
then dealt out over the gaps of the others, and the last one in powers of two.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S

Piece = tuple[int, int, int]  # number of the document, start in it, length

GROUP = 4096  # documents packed together
SEED = 20_731  # of the hash that deals documents out
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
KINDS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins in a row, each with some free places; a node of the tree holds the most that a bin below it has."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Takes so many places (at least one, at most a bin's room) of the first bin that has them; its number."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        tree[i] -= need
        found = i - self.leaves
        while i := i >> 1:
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most
        return found


def first_fit_decreasing(lengths: list[int], room: int) -> list[list[int]]:
    """The numbers of the items of each bin; no item is longer than a bin."""
    bins: list[list[int]] = []
    tree = Tournament(len(lengths), room)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = tree.place(lengths[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
    return bins


def filled(bins: list[list[Piece]], room: int) -> list[list[Piece]]:
    """The same tokens without padding: pieces of the emptiest bins, cut where need be, fill the gaps of the others; what
    the last bin has left becomes bins of different powers of two.
    """
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: -used[k])
    rows, used = [list(bins[k]) for k in order], [used[k] for k in order]
    i, j = 0, len(rows) - 1
    while i < j:
        gap = min(room - used[i], rows[j][-1][2])
        if not gap:
            i += 1
            continue
        doc, start, length = rows[j].pop()
        if length > gap:
            rows[j].append((doc, start, length - gap))
        rows[i].append((doc, start + length - gap, gap))
        used[i] += gap
        used[j] -= gap
        j -= not used[j]
    rows = rows[: j + 1]
    if rows and used[j] < room:
        left = rows.pop()[::-1]
        for bit in reversed(range(used[j].bit_length())):
            need = used[j] & 1 << bit
            if need:
                rows.append([])
            while need:
                doc, start, length = left.pop()
                take = min(need, length)
                rows[-1].append((doc, start, take))
                if take < length:
                    left.append((doc, start + take, length - take))
                need -= take
    return rows


class SpacedTokens:
    """Ids of a tokenizers file whose pieces never hold white space: texts are cut at it, and at the stop after a letter,
    and each different part is encoded once (parts are told apart by 128-bit hashes).

    Files of another kind, and texts that may hold an added token, go to the library whole.
    """

    ADDED = "<|"  # what the added tokens of such files begin with
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # a fixed value: the files' own pattern

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cuts = steps[0].get("pattern") == {"Regex": self.SPLIT} and steps[0].get("behavior") == "Removed" and all(t.startswith(self.ADDED) for t in added)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.parts = S.Parts(self.kind, most)
        self.letter, self.stop = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
        self.stop[[*b",.;:!?)"]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        alone = [not self.cuts or self.ADDED in t for t in texts]
        raws = [b"" if x else t.encode() for t, x in zip(texts, alone)]
        b = np.frombuffer(b"\n".join(raws), np.uint8)
        out = np.flatnonzero(np.diff(S.GAP[b], prepend=True, append=True))
        cuts = np.flatnonzero(self.letter[b[:-1]] & self.stop[b[1:]]) + 1
        starts, ends = np.sort(np.concatenate([out[::2], cuts])), np.sort(np.concatenate([out[1::2], cuts]))
        h, g = S.spans_hash(b, starts, ends)
        h[h == 0] = 1
        table = self.parts
        if table.entries > table.most:
            table.clear()
        entry = table.find(h, g)
        at = np.flatnonzero(entry < 0)
        if len(at):
            new = at[S.distinct(h[at], g[at])]
            lists = self.whole([b[i:j].tobytes().decode() for i, j in zip(starts[new].tolist(), ends[new].tolist())])
            table.insert(h[new], g[new], table.add(np.concatenate(lists), np.array([len(x) for x in lists], np.int32)))
            entry[at] = table.find(h[at], g[at])
        ids, stops = table.gather(entry)
        edge = np.concatenate([[0], stops])[np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))].tolist()
        lists = [ids[i:j] for i, j in zip([0, *edge], edge)]
        for k, own in zip(rest := [k for k, x in enumerate(alone) if x], self.whole([texts[k] for k in rest]) if rest else []):
            lists[k] = own
        return lists


_TOKENIZERS: dict[str, SpacedTokens] = {}


def tokens(path: str) -> SpacedTokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = SpacedTokens(path)
    return _TOKENIZERS[path]


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = 2048, group: int = GROUP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most `room` tokens: a row for each piece.

    Columns: doc_id, start (ids of its document before it), length, ids (of the piece, little-endian unsigned 32-bit
    integers), doc_tokens (ids of the document, the end id included), sequence_id, offset (where the piece begins in its
    sequence, gapless from 0). Every id of a document, end_id after its last, is in exactly one piece. Sequences are full
    or of a power of two, so nothing is padded. A null text is empty and has its end id only; null keys stay null; rows
    that repeat a key are documents of their own; an empty table gives no rows; other columns of the input are left out.

    One shuffle deals the texts out by a hash of key and text; ids never cross a shuffle. A task holds at most the ids of
    `group` documents, each less than `room`, and a document's ids while it is cut.
    """
    S.ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.withColumn("draw", F.xxhash64(F.lit(SEED), "key", "text")).repartition(S.tasks_for(docs), "draw").sortWithinPartitions("draw", "key").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = tokens(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], encoder.kind)
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # key, tokens, start of what is left, its ids
        pieces: list[tuple] = []

        def give(sequence: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for name, start, ids, total in sequence:
                pieces.append((name, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset))
                offset += len(ids)
            number += 1

        def pack() -> Iterator[pa.RecordBatch]:
            bins = first_fit_decreasing([len(x[3]) for x in held], room)
            for sequence in filled([[(k, 0, len(held[k][3])) for k in b] for b in bins], room):
                give([(held[k][0], held[k][2] + at, held[k][3][at : at + n], held[k][1]) for k, at, n in sequence])
                if len(pieces) >= 500:
                    yield from flush()
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if pieces:
                yield S.batch(OUT, *zip(*pieces))
                pieces.clear()

        for b in batches:
            texts, keys = b.column("text").to_pylist(), b.column("key").to_pylist()
            for i, j in S.by_bytes(texts, 500_000):
                for name, ids in zip(keys[i:j], encoder.of(texts[i:j])):
                    ids = np.concatenate([ids, end])
                    body = len(ids) // room * room
                    for at in range(0, body, room):
                        give([(name, at, ids[at : at + room], len(ids))])
                        if len(pieces) >= 500:
                            yield from flush()
                    if body < len(ids):
                        held.append((name, len(ids), body, ids[body:].copy()))
                    if len(held) == group:
                        yield from pack()
        if held:
            yield from pack()
        yield from flush()

    return dealt.mapInArrow(run, KINDS)


def sequences(pieces: DataFrame) -> DataFrame:
    """The ids of each sequence in order, from its pieces: sequence_id, n_docs, ids (little-endian unsigned 32-bit)."""
    rows = pieces.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", "n_pieces", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of them."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
