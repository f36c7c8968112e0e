"""Packing documents into sequences (operator 7).

Bounded-space online packing: each partition keeps a fixed number of open windows. A document gives whole
windows first; its rest goes to the open window where it fits best. When none fits, the fullest window is
filled up with a cut of the rest and emitted. What a partition has left is merged into at most one open
window, and the open windows of several partitions are merged at the end, with a cut at powers of two, which
need no padding.

Tokens: a text is cut at white space, between ASCII letters, digits and other ASCII marks (where this
tokenizer never joins anything), and different pieces are tokenized once for each block and kept in a
bounded table in the Python worker, by two 64-bit names (see common.names). Texts that hold a special token's string go to
the tokenizer whole. Documents are never shuffled; only open windows are.

Defined results: null text counts as empty and packs its end token alone. A null doc_id, repeated ids and
extra columns have no influence. Sequence ids are unique, and follow the partitions that the input is read
in. A text longer than a block is one block. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

BLOCK = 1 << 20
KEPT_PIECES = 300_000
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open int, ids binary"
SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in PIECES.split(", ")])
#: Classes of bytes: white space, letter, digit, mark, and those (in words of other scripts, apostrophes, controls) next to which nothing is cut.
SPACE, LETTER, DIGIT, MARK, GLUE = range(5)
CLASSES = np.array([SPACE if x == 32 or 9 <= x <= 13 else DIGIT if 48 <= x <= 57 else LETTER if 65 <= x & 0xDF <= 90 else MARK if 32 < x < 127 and x != 39 else GLUE for x in range(256)], np.uint8)


class Encoder:
    """Token ids of texts, with a bounded table of pieces seen before."""

    kept = KEPT_PIECES

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.n_ids = np.zeros(1 << 20, np.int32), 0

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, np.int32)

    def _encode(self, pieces: list[bytes], glued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the pieces, where each piece's begin and how many it has. Pieces that are sure to end with one end-of-word token go as one text."""
        sure = ~glued
        for i in np.flatnonzero(glued).tolist():
            text = pieces[i].decode(errors="replace")
            sure[i] = text.isalpha() and max(text) < "\u0180"
        plain, other = np.flatnonzero(sure), np.flatnonzero(~sure)
        text = b" ".join([pieces[i] for i in plain.tolist()]).decode(errors="replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(plain):
            ids, ends, plain, other = ids[:0], ends[:0], plain[:0], np.arange(len(pieces))
        found = self.tokenizer.encode_batch_fast([pieces[i].decode(errors="replace") for i in other.tolist()], add_special_tokens=False)
        sizes = np.zeros(len(pieces), np.int32)
        sizes[plain], sizes[other] = np.diff(ends, prepend=0), [len(e.ids) for e in found]
        at = np.zeros(len(pieces), np.int64)
        order = np.append(plain, other)
        at[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate([ids, *[np.array(e.ids, np.int32) for e in found]]), at, sizes

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and how many each has."""
        kind = CLASSES[data]
        inner = kind != SPACE
        cut = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut &= (kind[1:] != GLUE) & (kind[:-1] != GLUE)
        start, last = inner.copy(), inner.copy()
        start[1:] &= ~inner[:-1] | cut
        last[:-1] &= ~inner[1:] | cut
        begin, end = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
        start[begin], last[end] = inner[begin], inner[end]
        starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        low = C.lowered(data)
        low[:-1] = np.where(data[1:] >= 128, data[:-1], low[:-1])  # what comes next may combine with a capital
        name, check = C.names(low, starts, ends)
        order, firsts = C.sorted_groups(name, check)
        first, of = order[firsts], np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(order))))
        at, size = self._known(name[first], check[first], low, starts[first], ends[first])
        sizes = size[of].astype(np.int64)
        until = np.cumsum(sizes)
        ids = self.ids[np.arange(until[-1]) + np.repeat(at[of] - (until - sizes), sizes)]
        doc = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(doc, sizes, len(offsets) - 1).astype(np.int64)

    def _known(self, keys: np.ndarray, checks: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each different piece, which come by key; those not in the table are encoded, and kept unless the table has their key."""
        place, known = self._find(keys, checks)
        if len(self.keys) + len(keys) - known.sum() > self.kept:
            self._forget()
            place, known = self._find(keys, checks)
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        at[known], size[known] = self.at[place[known]], self.size[place[known]]
        if len(new := np.flatnonzero(~known)):
            n_glue = np.append(0, np.cumsum(CLASSES[low] == GLUE))
            pieces = [low[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            ids, begin, size[new] = self._encode(pieces, n_glue[ends[new]] > n_glue[starts[new]])
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros(len(self.ids), np.int32))
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            at[new] = begin + self.n_ids
            self.n_ids += len(ids)
            free = np.append(self.keys, 0)[place[new]] != keys[new]
            free |= place[new] == len(self.keys)
            free[1:] &= keys[new][1:] != keys[new][:-1]
            new = new[free]
            self.keys, self.checks, self.at, self.size = (np.insert(x, place[new], y[new]) for x, y in ((self.keys, keys), (self.checks, checks), (self.at, at), (self.size, size)))
        return at, size

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands or would stand in the table, and whether it is there with its check."""
        place = np.searchsorted(self.keys, keys)
        return place, (place < len(self.keys)) & (np.append(self.keys, 0)[place] == keys) & (np.append(self.checks, 0)[place] == checks)

    def documents(self, data: np.ndarray, offsets: np.ndarray):
        """The ids of each text, with the end id."""
        raw = data.tobytes() if self.special else b""
        odd = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.special.finditer(raw)} if self.special else set()
        ids, sizes = self.texts(data, offsets)
        ends = np.cumsum(sizes)
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            yield np.append(self.whole(raw[offsets[i] : offsets[i + 1]]) if i in odd else ids[a:b], np.int32(END_ID))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """Open windows; a window is a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, n_open: int, first_id: int):
        self.size, self.n_open, self.next_id = size, n_open, first_id
        self.open: list[list] = []
        self.used: list[int] = []
        self.rows: list[tuple] = []

    def emit(self, window: list, is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, n in window:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc_id, start, len(ids), zlib.crc32(raw), n, self.next_id, offset, int(is_open), raw if is_open else None))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.size:
            self.emit([(doc_id, at, ids[at : at + self.size], n)])
            at += self.size
        self.place(doc_id, at, ids[at:], n)

    def place(self, doc_id: int | None, start: int, ids: np.ndarray, n: int) -> None:
        while len(ids):
            fits = [(self.size - u, i) for i, u in enumerate(self.used) if u + len(ids) <= self.size]
            if fits:
                i = min(fits)[1]
            elif len(self.open) < self.n_open:
                i = len(self.open)
                self.open.append([])
                self.used.append(0)
            else:
                i = max(range(len(self.used)), key=self.used.__getitem__)
            part = ids[: self.size - self.used[i]]
            self.open[i].append((doc_id, start, part, n))
            self.used[i] += len(part)
            start, ids = start + len(part), ids[len(part) :]
            if self.used[i] == self.size:
                self.emit(self.open.pop(i))
                self.used.pop(i)

    def merge(self) -> list:
        """Join all open windows into whole ones, the fullest first; return the one that is left."""
        left = [piece for _, window in sorted(zip(self.used, self.open, strict=True), key=lambda x: -x[0]) for piece in window]
        self.open, self.used, self.n_open = [], [], 1
        for doc_id, start, ids, n in left:
            self.place(doc_id, start, ids, n)
        return self.open.pop() if self.open else []

    def finish(self, window: list) -> None:
        """Emit a window cut at powers of two, the largest first."""
        total, at = sum(len(p[2]) for p in window), 0
        for power in (1 << k for k in range(total.bit_length() - 1, -1, -1)):
            if total & power:
                self.emit(_slice(window, at, at + power))
                at += power

    def table(self) -> list[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)] if rows else []


def _slice(window: list, a: int, b: int) -> list:
    out, at = [], 0
    for doc_id, start, ids, n in window:
        x, y = max(a - at, 0), min(b - at, len(ids))
        if x < y:
            out.append((doc_id, start + x, ids[x:y], n))
        at += len(ids)
    return out


def _pack(path: str, size: int, n_open: int):
    def pack(batches):
        windows = Windows(size, n_open, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = C.text_arrays(batch.column(1))
            for i, j in C.blocks(offsets, BLOCK):
                for doc_id, ids in zip(doc_ids[i:j], encoder(path).documents(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                    windows.add(doc_id, ids)
                yield from windows.table()
        if left := windows.merge():
            windows.emit(left, is_open=True)
        yield from windows.table()

    return pack


def _merge(size: int):
    def merge(key, table):
        windows = Windows(size, 1, (1 << 62) + (key[0].as_py() << 32))
        for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            windows.place(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        windows.finish(windows.merge())
        batches = windows.table()
        return pa.Table.from_batches(batches, SCHEMA)

    return merge


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, n_open: int = 16, merged: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. merged: partitions whose open windows meet."""
    C.small_batches(docs.sparkSession)
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    pieces = C.materialise(t.mapInArrow(_pack(tokenizer, size, n_open), PIECES))
    left = pieces.filter("open = 1").withColumn("group", F.floor(F.col("sequence_id") / (merged << 32)).cast("int"))
    left = left.groupBy("group").applyInArrow(_merge(size), PIECES)
    return pieces.filter("open = 0").unionByName(left).drop("open", "ids")


def query(spark, sf_dir):
    import public_tokenizers

    return pack_documents(C.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
