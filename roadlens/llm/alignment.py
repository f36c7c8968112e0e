"""Alignment of the tokens of two tokenizers by bytes (operator 11).

A is a byte-level BPE of the tokenizers library, B a SentencePiece BPE. Both encode a space and the text. A's character offsets and the
spans of SentencePiece's proto are coarse cuts. Where a token is as long as its span, the span's end is its end; where several
tokens share a character (parts of multibyte characters, byte-fallback tokens), their ends follow from their decoded bytes.
A text counts only if each tokenizer's decoded bytes are the space and the text. Byte offsets where tokens of both
end cut a text into groups, and two tokens are linked where their bytes overlap: each stretch between neighbouring ends of
either side is one link.

Texts are cut where neither tokenizer ever joins anything: before white space, and between ASCII letters, digits and marks
unless some piece of B's vocabulary has both bytes in a row. Different pieces are tokenized once for each block and kept in the
bounded table of operator 7. Ids are written once. Counts of linked id pairs are summed in each task before they are
shuffled by pair. The counted pairs come back as a table of id pairs, which is broadcast in groups of about GROUP_PAIRS pairs by hash of the A id, one
after the other, however many there are.

Defined results: texts null, empty or whose decoded bytes differ have no tokens and only zeros. A null doc_id, repeated ids and extra columns
have no influence: each row counts as a document. Texts of any length are encoded whole. An empty table gives an empty result. Vocabularies of more than 65,536 entries are refused.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C
from roadlens.llm import packing
from roadlens.llm.bpe import byte_of_char

BLOCK = 1 << 20
#: Counted pairs that a Python worker holds before it hands them on, and those of a broadcast group (13 bytes each).
HELD_PAIRS, GROUP_PAIRS = 1 << 20, 1 << 21
TOKENS = "doc_id long, a binary, b binary"
COUNTS = "a int, b int, n long"
DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>"
#: Characters that Unicode counts as white space (and U+180E, which older versions do), beyond ASCII.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
IS_B, FAILED = 1 << 20, 1 << 21  # marks of ids in the table of pieces


def refined(spans: list[tuple[int, int]], decoded: list[int], at: int) -> list[int]:
    """Ends of tokens in bytes, from coarse spans and the tokens' decoded lengths: spans that fit are taken, others are replaced by what the bytes say."""
    ends = []
    for (begin, end), size in zip(spans, decoded, strict=True):
        at = end if begin == at and end - begin == size else at + size
        ends.append(at)
    return ends


class Aligner(packing.Encoder):
    """Ids of both tokenizers for texts that begin with a space."""

    kept = 1_000_000  # of about 60 bytes

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n_b, vocabulary, of = self.b.get_piece_size(), self.a.get_vocab(), byte_of_char()
        if max(n_b, max(vocabulary.values()) + 1) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 entries are not supported")
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n_b)))]
        joined = np.zeros((256, 256), bool)
        for i, piece in enumerate(self.b_bytes):
            if not self.b.is_control(i) and not self.b.is_unknown(i):
                joined[list(piece[:-1]), list(piece[1:])] = True
        self.apart = ~joined
        self._forget()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a piece may begin at each byte but the first."""
        kind = packing.CLASSES[data]
        space = kind == packing.SPACE
        visible = (data > 32) & (data != 127)
        for m in WIDE_SPACE.finditer(data.tobytes()):
            visible[m.start() : m.end()] = False
        before, after = kind[:-1], kind[1:]
        solid = (packing.LETTER, packing.DIGIT, packing.MARK)
        other = np.isin(before, solid) & np.isin(after, solid) & (before != after)
        return (visible[:-1] & space[1:] | other) & self.apart[data[:-1], data[1:]]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, piece after piece (A's, then B's with a mark), and how many each text has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        start = np.append(True, self.cuts(data))
        start[offsets[:-1]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        name, check = C.names(data, starts, ends)
        order, firsts = C.sorted_groups(name, check)
        first, of = order[firsts], np.empty(len(order), np.int64)
        of[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(order))))
        at, size = self._known(name[first], check[first], data, starts[first], ends[first])
        sizes = size[of].astype(np.int64)
        until = np.cumsum(sizes)
        ids = self.ids[np.arange(until[-1]) + np.repeat(at[of] - (until - sizes), sizes)]
        doc = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(doc, sizes, len(offsets) - 1).astype(np.int64)

    def _encode(self, pieces: list[bytes], glued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        found = []
        # before a line feed, which is no part of any longer piece, B puts its space, so that the piece itself comes as it stands
        for raw, text, x, y in zip(pieces, texts, self.a.encode_batch(texts, add_special_tokens=False), self.b.encode(["\n" + t for t in texts], return_type="proto"), strict=True):
            byte_at = range(len(raw) + 1) if len(raw) == len(text) else [*itertools.accumulate((len(c.encode()) for c in text), initial=0)]
            a_ids, b_tokens = x.ids, y.pieces[2:]
            a_ends = refined([(byte_at[p], byte_at[q]) for p, q in x.offsets], [len(self.a_bytes[i]) for i in a_ids], 0)
            b_ids = [t.id for t in b_tokens]
            b_ends = refined([(t.begin - 1, t.end - 1) for t in b_tokens], [len(self.b_bytes[i]) for i in b_ids], 0)
            whole = all(self._covers(raw, ids, ends, names) for ids, ends, names in ((a_ids, a_ends, self.a_bytes), (b_ids, b_ends, self.b_bytes)))
            found.append([*a_ids, *[i | IS_B for i in b_ids]] if whole else [FAILED])
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum())), np.cumsum(sizes, dtype=np.int64) - sizes, sizes

    @staticmethod
    def _covers(raw: bytes, ids: list[int], ends: list[int], names: list[bytes]) -> bool:
        return bool(ends) and ends[-1] == len(raw) and b"".join([names[i] for i in ids]) == raw

    def pairs(self, data: np.ndarray, offsets: np.ndarray):
        """(A's ids, B's ids) of each text; both empty where the text has no tokens."""
        ids, sizes = self.texts(data, offsets)
        ends = np.cumsum(sizes)
        for a, b, n in zip((ends - sizes).tolist(), ends.tolist(), np.diff(offsets).tolist(), strict=True):
            own = ids[a:b] if n > 1 else ids[:0]  # more than the space
            if (own & FAILED).any():
                own = own[:0]
            is_b = own & IS_B > 0
            yield own[~is_b], own[is_b] ^ IS_B


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _tokens(paths: tuple[str, str]):
    def tokens(batches):
        own = aligner(*paths)
        for batch in batches:
            data, offsets = C.text_arrays(batch.column(1))
            for i, j in C.blocks(offsets, BLOCK):
                rows = [(x.astype("<u2").tobytes(), y.astype("<u2").tobytes()) for x, y in own.pairs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                columns = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "a", "b"])

    return tokens


class Block:
    """Tokens of some documents, whose bytes are laid end to end, with their links and groups."""

    def __init__(self, own: Aligner, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray):
        sizes = own.__dict__.setdefault("sizes", tuple(np.array([len(x) for x in names], np.int64) for names in (own.a_bytes, own.b_bytes)))
        self.a, self.b, self.a_at, self.b_at = a, b, a_at, b_at
        self.a_ends, self.b_ends = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
        n = int(self.a_ends[-1]) if len(a) else 0
        ends = np.zeros(n + 1, np.uint8)
        ends[self.a_ends] += 1
        ends[self.b_ends] += 1
        self.links, self.groups = np.flatnonzero(ends), np.flatnonzero(ends == 2)
        self.link_a, self.link_b = np.searchsorted(self.a_ends, self.links), np.searchsorted(self.b_ends, self.links)
        self.keys = a[self.link_a].astype(np.uint64) << np.uint64(16) | b[self.link_b].astype(np.uint64)
        self.doc_ends = np.append(0, self.a_ends)[a_at]  # in bytes, with the start of the first
        self.link_at = np.searchsorted(self.links, self.doc_ends, "right")
        self.group_at = np.searchsorted(self.groups, self.doc_ends, "right")

    def documents_pairs(self) -> np.ndarray:
        """The keys of the different pairs of each document, one for each document that holds the pair."""
        doc = np.repeat(np.arange(len(self.link_at) - 1, dtype=np.uint64), np.diff(self.link_at))
        return np.unique(doc << np.uint64(32) | self.keys) & np.uint64((1 << 32) - 1)

    def texts_of_groups(self, names: list[bytes]) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each document. names: of 2 * id (+ 1 for the last token of its side of a group), A's then B's."""
        a_group, b_group = np.searchsorted(self.groups, self.a_ends), np.searchsorted(self.groups, self.b_ends)
        a_upto, b_upto = (np.searchsorted(ends, self.groups, "right") for ends in (self.a_ends, self.b_ends))  # tokens up to each group's end
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.append(0, b_upto)[a_group]] = 2 * self.a.astype(np.int64) + (np.arange(len(self.a)) + 1 == a_upto[a_group])
        code[np.arange(len(self.b)) + a_upto[b_group]] = 2 * (self.b.astype(np.int64) + (1 << 16)) + (np.arange(len(self.b)) + 1 == b_upto[b_group])
        at = (self.a_at + self.b_at).tolist()
        return [b"".join(map(names.__getitem__, code[x:y].tolist()))[:-1] for x, y in itertools.pairwise(at)]


def names_of_ids() -> list[bytes]:
    return [str(i).encode() + sep for side in (b",|", b",;") for i in range(1 << 16) for sep in (side[:1], side[1:])]


def _blocks(own: Aligner, batch):
    """(first row, last row, Block) of a batch of TOKENS, with a block's worth of tokens each."""
    (a, a_at), (b, b_at) = (C.text_arrays(batch.column(c)) for c in ("a", "b"))
    a, b, a_at, b_at = a.view("<u2") if len(a) else np.zeros(0, "<u2"), b.view("<u2") if len(b) else np.zeros(0, "<u2"), a_at // 2, b_at // 2
    for i, j in C.blocks(a_at, BLOCK // 2):
        yield i, j, Block(own, a[a_at[i] : a_at[j]], a_at[i : j + 1] - a_at[i], b[b_at[i] : b_at[j]], b_at[i : j + 1] - b_at[i])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(of, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(paths: tuple[str, str]):
    def rows(keys, counts):
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(16)).astype(np.int32)), pa.array((k & np.uint64(0xFFFF)).astype(np.int32)), pa.array(counts[i : i + (1 << 16)])], names=["a", "b", "n"])

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, block in _blocks(aligner(*paths), batch):
                parts.append(np.unique(block.documents_pairs(), return_counts=True))
                held += len(parts[-1][0])
                if held > 4 * HELD_PAIRS:
                    parts = [_summed(parts)]
                    held = len(parts[0][0])
                    if held > HELD_PAIRS:
                        yield from rows(*parts[0])
                        parts, held = [], 0
        if parts:
            yield from rows(*_summed(parts))

    return count


def token_ids(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a, b: both tokenizers' ids of each row's text (little-endian unsigned 16-bit integers)."""
    C.small_batches(docs.sparkSession)
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.concat(F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))), "UTF-8").alias("text"))
    return t.mapInArrow(_tokens((a_path, b_path)), TOKENS)


def link_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, n, best: how many documents hold an id pair linked, and whether that is the most of its A id."""
    counts = C.materialise(tokens.mapInArrow(_count((a_path, b_path)), COUNTS).groupBy("a", "b").agg(F.sum("n").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _digest(paths: tuple[str, str], held, first: bool):
    """n_best and count_sum over the pairs held, added to those of the groups before; the first group gives all else."""

    def digest(batches):
        own, names = aligner(*paths), names_of_ids() if first else None
        keys, counts, best = held.value
        for batch in batches:
            for i, j, block in _blocks(own, batch):
                at = np.searchsorted(keys, block.keys)
                hit = np.append(keys, np.uint64(1 << 40))[at] == block.keys
                per_doc = lambda x, at=block.link_at: np.diff(np.append(0, np.cumsum(x))[at])
                mine = [per_doc(hit & np.append(best, False)[at]), per_doc(np.where(hit, np.append(counts, 0)[at], 0))]
                rest = [batch.column(c).slice(i, j - i) for c in ("doc_id", "a", "b")]
                if first:
                    groups = pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in block.texts_of_groups(names)])
                    rest += [pa.array(np.diff(x).astype(np.int64)) for x in (block.a_at, block.b_at, block.group_at, block.link_at)] + [groups]
                else:
                    rest += [batch.column(c).slice(i, j - i) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                    mine = [x + np.asarray(batch.column(c).slice(i, j - i)) for x, c in zip(mine, ("n_best", "count_sum"), strict=True)]
                yield pa.RecordBatch.from_arrays([*rest, *[pa.array(x.astype(np.int64)) for x in mine]], names=["doc_id", "a", "b", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return digest


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """The columns of DIGESTS for each row."""
    spark, paths = docs.sparkSession, (a_path, b_path)
    t = C.materialise(token_ids(docs, a_path, b_path, id_col, text_col))
    counts = link_counts(t, a_path, b_path).select((F.col("a").cast("long") * 65536 + F.col("b")).alias("key"), "a", "n", "best")
    counts = C.materialise(counts)
    n_groups = max(1, math.ceil(counts.count() / group_pairs))
    for k in range(n_groups):
        own = counts.filter(F.pmod(F.xxhash64("a"), F.lit(n_groups)) == k).select("key", "n", "best").toArrow()  # about group_pairs rows
        keys = np.asarray(own.column("key")).astype(np.uint64)
        order = np.argsort(keys)
        held = spark.sparkContext.broadcast((keys[order], np.asarray(own.column("n"))[order], np.asarray(own.column("best"))[order]))
        told = t.mapInArrow(_digest(paths, held, k == 0), "doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
        if k == n_groups - 1:
            break
        last, t = t, C.materialise(told)
        held.destroy()
        C.discard(last)
    return told.select(*[c.split()[0] for c in DIGESTS.split(", ")])


def _aligned(paths: tuple[str, str]):
    def aligned(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))])
        for batch in batches:
            for i, j, block in _blocks(aligner(*paths), batch):
                a_upto, b_upto = (np.append(0, np.searchsorted(ends, block.groups, "right")).tolist() for ends in (block.a_ends, block.b_ends))
                edges, rows = np.append(0, block.groups).tolist(), []
                for d, (x, y) in enumerate(itertools.pairwise(block.group_at.tolist())):
                    base = int(block.doc_ends[d])
                    rows.append([{"start": edges[g] - base, "end": edges[g + 1] - base, "a": block.a[a_upto[g] : a_upto[g + 1]].tolist(), "b": block.b[b_upto[g] : b_upto[g + 1]].tolist()} for g in range(x, y)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(rows, schema.field(1).type)], schema=schema)

    return aligned


def aligned_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the groups of each row: their bytes in the space and the text, and both sides' ids."""
    return token_ids(docs, a_path, b_path, id_col, text_col).mapInArrow(_aligned((a_path, b_path)), GROUPS)


def query(spark, sf_dir):
    import public_tokenizers

    return alignment_digests(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
