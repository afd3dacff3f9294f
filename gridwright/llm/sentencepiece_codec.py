"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

The method: an agenda of adjacent symbol pairs, ordered by the score of the piece that the pair makes and then by place;
the best pair is merged, the pairs beside it change, until no pair makes a piece. Two forms of the one agenda give the
same ids: `merge_one` keeps a heap, for long segments; `merge_all` holds the agendas of many short segments as flat
arrays and takes the best pair of each segment at once.

No piece of such a vocabulary holds the space mark after another character (checked when a model is read), so no merge
crosses from a character to a space mark: a text is a row of segments, each a run of space marks and what follows it,
and a segment is merged once however often it appears. New segments, or with check="texts" whole texts, are held against
the sentencepiece library, and every text is decoded: where a segment's ids differ, or a text doesn't come back, the
library's own ids are taken.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shared as S

SPACE = "▁"
_MODELS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A model, read once in each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Codec(path)
    return _MODELS[path]


class Codec:
    """A model, with the ids of the segments seen so far; at most about `most` of them."""

    def __init__(self, path: str, most: int = 500_000, check: str = "segments"):
        from sentencepiece import SentencePieceProcessor

        sp = self.library = SentencePieceProcessor(model_file=path)
        self.check, self.parts = check, S.Parts("<u4", most)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in normal):
            raise ValueError("a piece holds a space mark after another character: segments can't be merged alone")
        if sp.encode("", add_bos=True, add_eos=True) != [sp.bos_id(), sp.eos_id()] or sp.normalize("  ﬁ") != SPACE * 3 + "ﬁ":
            raise ValueError("only models with a leading space mark and no other normalization are supported")
        self.ids = {self.pieces[i]: i for i in normal}
        # A symbol is a piece's id; characters that pieces hold but that are none themselves follow; any other is -1 -
        # its code point.
        self.rare = sorted({c for t in self.ids for c in t}.difference(self.ids))
        self.symbol = self.ids | {c: len(self.pieces) + k for k, c in enumerate(self.rare)}
        self.table = -1 - np.arange(0x110000, dtype=np.int64)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.table[ord(c)] = i
        # Order of merges: a higher score first. Equal scores share a rank; the place then decides.
        self.rank = np.unique([-sp.get_score(i) for i in range(len(self.pieces))], return_inverse=True)[1].astype(np.int64)
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # The pairs of symbols that make a piece.
        self.pair = {a << 32 | b: i for t, i in self.ids.items() for k in range(1, len(t)) if (a := self.symbol.get(t[:k])) is not None and (b := self.symbol.get(t[k:])) is not None}
        self.keys = np.append(np.array(sorted(self.pair), np.int64), np.int64(1 << 62))
        self.made = np.array([*map(self.pair.get, self.keys[:-1].tolist()), -1], np.int64)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap over a linked list."""
        n, pair, rank = len(symbols), self.pair, self.rank
        sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (p := pair.get(sym[i] << 32 | sym[j])) is not None:
                heapq.heappush(agenda, (int(rank[p]), i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i] = pair[a << 32 | b]
            gone[j] = True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s, g in zip(sym, gone) if not g]

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many segments in flat arrays; returns all symbols that are left and how many each segment has.
        """
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        sym = self.table[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")]
        seg = np.repeat(np.arange(len(segments)), lengths)
        none = np.int64(1 << 62)

        def offer(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and piece of the pairs that begin at these places."""
            after = np.minimum(at + 1, len(sym) - 1)
            key = np.where((seg[after] == seg[at]) & (after > at) & (sym[at] >= 0) & (sym[after] >= 0), sym[at] << 32 | sym[after], -1)
            slot = np.searchsorted(self.keys, key)
            hit = self.keys[slot] == key
            return np.where(hit, self.rank[self.made[slot]], none), self.made[slot]

        rank, made = offer(np.arange(len(sym))) if len(sym) else (sym, sym)
        done_sym, done_seg = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat(np.where(rank < none, rank << 32 | np.arange(len(sym)), none), starts)
            live = best < none
            if not live.all():  # segments whose agenda is empty
                stay = np.repeat(live, np.diff(np.append(starts, len(sym))))
                done_sym.append(sym[~stay])
                done_seg.append(seg[~stay])
                sym, seg, rank, made = sym[stay], seg[stay], rank[stay], made[stay]
                best = np.minimum.reduceat(np.where(rank < none, rank << 32 | np.arange(len(sym)), none), np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))) if len(sym) else sym
            if not len(sym):
                break
            at = best & 0xFFFFFFFF  # the best pair of each segment: lowest rank, then leftmost
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            sym, seg, rank, made = sym[stay], seg[stay], rank[stay], made[stay]
            at = place[at]
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at], made[at] = offer(at)
        sym, seg = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_sym, done_seg))
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=len(segments))

    def to_ids(self, symbols: list[int]) -> list[int]:
        """Ids of symbols: characters outside the vocabulary become the pieces of their bytes."""
        out = []
        for s in symbols:
            if 0 <= s < len(self.pieces):
                out.append(s)
            else:
                out.extend(self.byte_ids[b] for b in (chr(-1 - s) if s < 0 else self.rare[s - len(self.pieces)]).encode())
        return out

    def learn(self, h: np.ndarray, g: np.ndarray, new: list[str]) -> None:
        """Merge segments, each with its space marks, and keep their ids under these hashes."""
        short = np.array([len(w) <= 48 for w in new], bool)
        sym, counts = self.merge_all([w for w, s in zip(new, short) if s])
        lists = np.split(sym, np.cumsum(counts)[:-1])
        odd = np.add.reduceat((sym < 0) | (sym >= len(self.pieces)), np.cumsum(counts) - counts) if len(sym) else ()
        lists = [np.array(self.to_ids(x.tolist())) if o else x for x, o in zip(lists, odd)]
        lists += [np.array(self.to_ids(self.merge_one([int(self.table[ord(c)]) for c in w]))) for w, s in zip(new, short) if not s]
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        if self.check:  # the library puts the first space mark itself; a lone one is no text of it
            held = [k for k, i in enumerate(order.tolist()) if new[i] != SPACE]
            for k, theirs in zip(held, self.library.encode([new[order[k]][1:] for k in held], num_threads=1)):
                if lists[k].tolist() != theirs:
                    lists[k] = np.array(theirs, np.int64)
        self.parts.insert(h[order], g[order], self.parts.add(np.concatenate(lists), np.array([len(x) for x in lists])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with begin and end ids."""
        if self.parts.entries > self.parts.most:
            self.parts.clear()
        # A space mark in a text counts as a space; a text that isn't empty gets one before it.
        raws = [b" " + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        raw = b"".join(raws)
        b = np.frombuffer(raw, np.uint8)
        bounds = np.cumsum([0, *map(len, raws)])
        space = b == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(b))[: len(starts)]
        h, g = S.spans_hash(b, starts, ends)
        h[h == 0] = 1
        entry = self.parts.find(h, g)
        if (lost := entry < 0).any():
            at = np.flatnonzero(lost)
            at = at[S.distinct(h[at], g[at])]
            self.learn(h[at], g[at], [raw[i:j].decode().replace(" ", SPACE) for i, j in zip(starts[at].tolist(), ends[at].tolist())])
            entry[lost] = self.parts.find(h[lost], g[lost])
        ids, stops = self.parts.gather(entry)
        cuts = np.append(0, stops)[np.searchsorted(starts, bounds)].tolist()
        begin, end = (np.array([i], "<u4") for i in (self.library.bos_id(), self.library.eos_id()))
        out = [np.concatenate([begin, ids[i:j], end]) for i, j in zip(cuts, cuts[1:])]
        if self.check == "texts":
            out = [x if x.tolist() == theirs else np.array(theirs, "<u4") for x, theirs in zip(out, self.whole(texts))]
        return out

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of whole texts, with begin and end ids."""
        return self.library.encode(list(texts), add_bos=True, add_eos=True, num_threads=1)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The library's decode of ids."""
        return self.library.decode([x.tolist() for x in ids], num_threads=1)

    def both(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids and the texts they decode to. A text that doesn't come back, but for space marks, which come back as
        spaces, gets the library's ids and what these decode to.
        """
        ids = self.encode(texts)
        decoded = self.decode(ids)
        lost = [i for i, (t, d) in enumerate(zip(texts, decoded)) if t != d and t.replace(SPACE, " ") != d]
        for i, theirs in zip(lost, self.whole([texts[i] for i in lost]) if lost else ()):
            ids[i] = np.array(theirs, "<u4")
            decoded[i] = self.library.decode(theirs)
        return ids, decoded


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def coded(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text of documents (doc_id, text).

    Per row: doc_id, n_tokens (begin and end ids included), ids_sha256 (of the ids as little-endian 32-bit integers),
    decoded_sha256 (of the decoded text). A null text is empty. Rows stay in their partitions; nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c, keys, texts = codec(model), b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        rows = []
        for i, j in S.by_bytes(texts, 500_000):
            ids, decoded = c.both([t or "" for t in texts[i:j]])
            rows += [(k, len(x), sha256(x).hexdigest(), sha256(d.encode()).hexdigest()) for k, x, d in zip(keys[i:j], ids, decoded)]
        if rows:
            yield S.batch(schema, *zip(*rows))

    return S.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, CODED)


def with_tokens(docs: DataFrame, model: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text") -> DataFrame:
    """The documents with two more columns: the ids (array<int>, begin and end ids included) and their decoded text. A
    null text is empty; a row comes out for each row. Columns that have these names already are kept as {name}_input.
    """
    for c in {ids, decoded}.intersection(docs.columns):
        docs = docs.withColumnRenamed(c, S.free_name(docs, f"{c}_input"))
    kept = docs.schema.fields
    out = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c, texts = codec(model), b.column(text).to_pylist()
        for i, j in S.by_bytes(texts, 500_000):
            made, decoded = c.both([t or "" for t in texts[i:j]])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made).astype(np.int32)))
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), lists, pa.array(decoded, pa.string())], names=[f.name for f in out.fields])

    return S.map_arrow(docs, run, out)
