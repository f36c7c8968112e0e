"""Removal of long repeated byte strings (operator 1).

Induced sorting on a sample of suffixes. A full suffix array of the corpus takes more than 12 bytes
for each byte of text in every pass, so only sampled suffixes are moved and sorted; all the others
take their order and their common prefixes from them:

1. Each window of `length` bytes samples one of its suffixes, by content alone (the one whose first
   `seed` bytes have the least fingerprint), so equal windows sample at the same place. Neighbouring
   windows that share their sample form a run. A sample is named by the fingerprint of its seed and a
   run by that of all its bytes, and both names are shuffled, once for each chunk of documents. A run
   that an earlier document holds as well goes whole; a seed that no other document holds, or
   that always stands in the same run, is finished too.
2. For what remains (about the edges of repeats) the bytes of each different run are shuffled by seed.
   Each bucket sorts the sampled suffixes, with the common prefix of neighbours, and induces the order of
   the suffixes one, two, ... bytes further left: a stable sort by the preceding byte, with the least
   common prefix between two neighbours carried along, plus one. Neighbours with `length` bytes in
   common hold the same window; the smallest doc_id of such a group keeps it.
3. Each chunk marks the windows that lose and cuts their bytes.

Spark's shuffle does the external part: names and suffix tuples are spilled, merged and dealt to buckets
whose number follows the session's shuffle partitions, so that a bucket stays small at any input size. A
repeat meets its bucket once for each chunk and different run, never once for each copy. All three
rounds are one lazy plan which shuffles the texts once.

Names: seeds are named by 40 bits of a 64-bit polynomial fingerprint next to their bucket, which the other 24 bits choose,
and runs by 48 bits of one, with seed and bucket. Runs have at most 2 * length - seed bytes (76 by default); texts that such fingerprints
confuse by construction differ over 1,024 bytes or more. Equal names of runs count as equal bytes without another look; seeds and
all that is sorted in step 2 are compared by bytes.

Defined results: null text counts as empty; a null doc_id comes after all others; rows of one doc_id
never remove each other's bytes. Extra columns are ignored. Empty tables give empty results. A text longer than
two blocks is cut into overlapping pieces, so each of its windows lies in one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

BLOCK = 1 << 20
NO_ID = np.iinfo(np.int64).max
MESSAGE = "chunk int, kind int, bucket int, names binary, runs binary, docs binary, shape binary, bytes binary"
REPLY = "chunk int, kind int, bucket int, answer binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


class Runs:
    """The runs of a chunk's documents and their different (seed, run) pairs, in an order that depends on the chunk alone."""

    def __init__(self, table: pa.Table, n_buckets: int, length: int, seed: int):
        ids = table.column("doc_id").combine_chunks()
        known = np.asarray(ids.is_valid())
        ids = np.where(known, np.asarray(ids.fill_null(0)), NO_ID)
        self.order = np.lexsort((np.arange(len(ids)), ids))  # documents by id: the first holder of a run has the least id
        self.ids, self.known = ids[self.order], known[self.order]
        self.data, self.offsets = C.text_arrays(table.column("text").take(pa.array(self.order)))
        self.length, self.seed = length, seed
        parts = [self._block(d, s) for d, s in self._pieces()]
        names, runs, self.start, self.last, self.sample = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64 if i < 2 else np.int64) for i in range(5))
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        bucket = ((names & np.uint64(0xFFFFFF)) % np.uint64(n_buckets)).astype(np.uint64)
        names, runs = names >> np.uint64(24), runs & np.uint64((1 << 48) - 1)
        key = (bucket << np.uint64(40)) | (C.mix(names ^ (runs * np.uint64(C.BASE))) >> np.uint64(24))
        by = np.argsort(key, kind="stable")  # stable: of equal runs the first one, by document, stands for all
        first = C.starts_of_runs(bucket[by], names[by], runs[by])
        self.unique = by[first]
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
        self.names, self.runs, self.bucket = names[self.unique], runs[self.unique], bucket[self.unique].astype(np.int64)
        self.first_id = self.ids[self.doc[self.unique]]

    def _pieces(self):
        """(bytes, start in the chunk, ends of the texts) of about a block each; a longer text is cut into pieces that share length - 1 bytes, so each window lies in one."""
        for first, last in C.blocks(self.offsets, BLOCK):
            a, b = int(self.offsets[first]), int(self.offsets[last])
            if b - a <= 2 * BLOCK:
                yield (self.data[a:b], self.offsets[first + 1 : last + 1] - a), a
            else:
                for s in range(a, b, BLOCK):
                    piece = self.data[s : min(b, s + BLOCK + self.length - 1)]
                    yield (piece, np.array([len(piece)])), s
                    if s + BLOCK + self.length - 1 >= b:
                        break

    def _block(self, block: tuple, at: int) -> tuple:
        (data, ends), length, seed = block, self.length, self.seed
        n = len(data) - length + 1
        if n <= 0:
            return (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3)
        prefix = C.prefix_hashes(data)
        _, down = C.powers(len(data) + 1)
        h = C.mix((prefix[seed:] - prefix[:-seed]) * down[: len(prefix) - seed])
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width, least, span = length - seed + 1, key, 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        least = np.minimum(least[: n], least[width - span : width - span + n])
        sample = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        whole = np.ones(n, bool)  # windows that lie in one text
        for e in ends[:-1].tolist():
            whole[max(0, e - length + 1) : e] = False
        edge = np.flatnonzero(sample[1:] != sample[:-1]) + 1
        turn = np.zeros(n + 1, bool)
        turn[edge] = True
        turn[0] = True
        turn[1:n] |= whole[1:] != whole[:-1]
        start = np.flatnonzero(turn[:n])
        last = np.append(start[1:], n) - 1
        start, last = start[whole[start]], last[whole[start]]
        p = sample[start]
        run = C.mix(C.span_hash(prefix, start, last + length) ^ ((last - start) * 64 + (p - start)).astype(np.uint64))
        return h[p], run, start + at, last + at, p + at


def _group(bucket: np.ndarray):
    """(bucket, first, end) of each stretch of equal buckets."""
    firsts = C.starts_of_runs(bucket)
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(bucket)], strict=False):
        yield int(bucket[a]), a, b


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _send_names(n_buckets: int, length: int, seed: int):
    def send(key, table):
        r, chunk, out = Runs(table, n_buckets, length, seed), key[0].as_py(), []
        for b, i, j in _group(r.bucket):
            out.append({"chunk": chunk, "kind": 0, "bucket": b, "names": C.narrow(r.names[i:j], 5), "runs": C.narrow(r.runs[i:j], 6), "docs": r.first_id[i:j].tobytes()})
        return pa.Table.from_pylist(out, arrow_schema(MESSAGE))

    return send


def _answer_names(key, table):
    """For each (seed, run): 1 if an earlier document holds the run, plus 2 if the seed stands in several runs and documents."""
    table = table.sort_by("chunk")
    names = np.concatenate([C.widen(x.as_py(), 5) for x in table.column("names")])
    runs = np.concatenate([C.widen(x.as_py(), 6) for x in table.column("runs")])
    docs = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("docs")])
    by = np.lexsort((runs, names))
    names, runs, sorted_docs = names[by], runs[by], docs[by]
    seeds, same = C.starts_of_runs(names), C.starts_of_runs(names, runs)
    n = len(names)
    spread = lambda values, firsts: np.repeat(values, np.diff(np.append(firsts, n)))
    earlier = spread(np.minimum.reduceat(sorted_docs, same), same) < sorted_docs
    several = np.diff(np.append(np.searchsorted(same, seeds), len(same))) > 1
    several &= np.minimum.reduceat(sorted_docs, seeds) < np.maximum.reduceat(sorted_docs, seeds)
    answer = np.empty(n, np.uint8)
    answer[by] = earlier + 2 * spread(several, seeds)
    sizes = np.cumsum([0] + [len(x.as_py()) // 5 for x in table.column("names")])
    rows = [{"chunk": c.as_py(), "kind": 0, "bucket": key[0].as_py(), "answer": answer[i:j].tobytes()} for c, i, j in zip(table.column("chunk"), sizes[:-1], sizes[1:], strict=True)]
    return pa.Table.from_pylist(rows, arrow_schema(REPLY))


def _joined(replies: pa.Table, kind: int, dtype, n: int) -> np.ndarray:
    got = replies.filter(pa.compute.equal(replies.column("kind"), kind)).sort_by("bucket")
    out = np.concatenate([np.frombuffer(x.as_py(), dtype) for x in got.column("answer")]) if got.num_rows else np.zeros(0, dtype)
    assert len(out) == n, (len(out), n)
    return out


def _send_suffixes(n_buckets: int, length: int, seed: int):
    def send(key, table, replies):
        if not table.num_rows:
            return pa.Table.from_pylist([], arrow_schema(MESSAGE))
        r, chunk = Runs(table, n_buckets, length, seed), key[0].as_py()
        status = _joined(replies, 0, np.uint8, len(r.unique))
        out = [{"chunk": chunk, "kind": 0, "bucket": chunk % n_buckets, "bytes": status.tobytes()}]
        for b, i, j in _group(r.bucket):
            picked = i + np.flatnonzero(status[i:j] == 2)
            if len(picked):
                u = r.unique[picked]
                size = r.last[u] + length - r.start[u]
                ends = np.cumsum(size)
                spread = np.arange(ends[-1]) + np.repeat(r.start[u] - (ends - size), size)
                shape = np.stack([r.sample[u] - r.start[u], size], 1).astype(np.uint8)
                out.append({"chunk": chunk, "kind": 1, "bucket": b, "names": C.narrow(r.names[picked], 5), "docs": r.first_id[picked].tobytes(), "shape": shape.tobytes(), "bytes": r.data[spread].tobytes()})
        return pa.Table.from_pylist(out, arrow_schema(MESSAGE))

    return send


def induce(names: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Bit j of row i: an earlier document holds the window that starts j bytes left of sample i.

    before: the bytes left of each sample, nearest first, left of them valid; after: the bytes from it on,
    right of them valid (zeros behind). The order and common prefixes of the samples come from sorting,
    those at each further byte to the left by induction from the last ones.
    """
    n = len(names)
    lost = np.zeros(n, np.uint32 if length <= 32 else np.uint64)
    padded = np.zeros((n, -(-after.shape[1] // 8) * 8), np.uint8)
    padded[:, : after.shape[1]] = after
    columns = padded.view(">u8").astype(np.uint64)
    at = np.lexsort((*columns.T[::-1], names))
    differs = after[at[1:]] != after[at[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), after.shape[1])
    common = np.minimum(common, np.minimum(right[at[1:]], right[at[:-1]]))
    common[names[at[1:]] != names[at[:-1]]] = 0
    common = np.append(0, common)
    for j in range(before.shape[1] + 1):
        if j:
            stay = np.flatnonzero(left[at] >= j)
            if not len(stay):
                break
            preceding = before[at[stay], j - 1]
            turn = np.argsort(preceding, kind="stable")
            stay, preceding = stay[turn], preceding[turn]
            joined = np.flatnonzero(preceding[1:] == preceding[:-1]) + 1
            pairs = np.stack([stay[joined - 1] + 1, stay[joined] + 1], 1).ravel()
            least = np.minimum.reduceat(np.append(common, 0), pairs)[::2] if len(pairs) else np.zeros(0, common.dtype)
            at, common = at[stay], np.zeros(len(stay), common.dtype)
            common[joined] = least + 1
        firsts = np.flatnonzero(common < length)
        smallest = np.minimum.reduceat(docs[at], firsts)
        is_lost = docs[at] > np.repeat(smallest, np.diff(np.append(firsts, len(at))))
        lost[at[is_lost]] |= lost.dtype.type(1 << j)
    return lost


def _answer_suffixes(length: int, seed: int):
    def answer(key, table):
        kinds = np.asarray(table.column("kind"))
        rows = [{"chunk": x["chunk"], "kind": 0, "bucket": 0, "answer": x["bytes"]} for x in table.filter(pa.array(kinds == 0)).select(["chunk", "bytes"]).to_pylist()]
        table = table.filter(pa.array(kinds == 1)).sort_by("chunk")
        if table.num_rows:
            each = table.to_pylist()
            names = np.concatenate([C.widen(x["names"], 5) for x in each])
            docs = np.concatenate([np.frombuffer(x["docs"], np.int64) for x in each])
            shape = np.concatenate([np.frombuffer(x["shape"], np.uint8).reshape(-1, 2) for x in each]).astype(np.int64)
            text = np.frombuffer(b"".join(x["bytes"] for x in each), np.uint8)
            left, size = shape[:, 0], shape[:, 1]
            sample = np.cumsum(size) - size + left
            text = np.append(text, np.zeros(length, np.uint8))
            right = size - left
            after = text[sample[:, None] + np.arange(length)] * (np.arange(length) < right[:, None]).astype(np.uint8)
            before = text[np.maximum(sample[:, None] - 1 - np.arange(length - seed), 0)]
            lost = induce(names, left, np.minimum(right, length), before, after, docs, length)
            ends = np.cumsum([0] + [len(x["docs"]) // 8 for x in each])
            rows += [{"chunk": x["chunk"], "kind": 1, "bucket": key[0].as_py(), "answer": lost[i:j].tobytes()} for x, i, j in zip(each, ends[:-1], ends[1:], strict=True)]
        return pa.Table.from_pylist(rows, arrow_schema(REPLY))

    return answer


def _cut(n_buckets: int, length: int, seed: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", span)])

    def cut(key, table, replies):
        if not table.num_rows:
            return schema.empty_table()
        r = Runs(table, n_buckets, length, seed)
        status = _joined(replies, 0, np.uint8, len(r.unique))
        lost = np.zeros(len(r.unique), np.uint32 if length <= 32 else np.uint64)
        lost[status == 2] = _joined(replies, 1, lost.dtype, int((status == 2).sum()))
        change = np.zeros(len(r.data) + 1, np.int32)
        gone = ((status[r.of] & 1) == 1) | (r.ids[r.doc] > r.first_id[r.of])
        np.add.at(change, r.start[gone], 1)
        np.subtract.at(change, r.last[gone] + length, 1)
        rest = np.flatnonzero(~gone & (lost[r.of] != 0))
        for j in range(length - seed + 1):
            at = r.sample[rest[(lost[r.of[rest]] >> lost.dtype.type(j)) & lost.dtype.type(1) == 1]] - j
            np.add.at(change, at, 1)
            np.subtract.at(change, at + length, 1)
        covered = np.cumsum(change[:-1]) > 0
        # removed runs never cross texts: edges are taken within each text
        edge = np.diff(covered.astype(np.int8), prepend=0)
        inner = r.offsets[1:-1][r.offsets[1:-1] < len(covered)]
        begins = np.union1d(np.flatnonzero(edge == 1), inner[covered[inner]]) if len(covered) else np.zeros(0, np.int64)
        after = np.append(covered[1:], False) if len(covered) else covered
        at_end = np.zeros(len(covered), bool)
        at_end[r.offsets[1:][r.offsets[1:] > 0] - 1] = True
        finishes = np.flatnonzero(covered & (~after | at_end)) + 1
        owner = np.searchsorted(r.offsets, begins, "right") - 1
        first = np.searchsorted(owner, np.arange(len(r.ids) + 1))
        out = []
        for i in range(len(r.ids)):
            a, b = int(r.offsets[i]), int(r.offsets[i + 1])
            spans = [{"start": s - a, "end": e - a} for s, e in zip(begins[first[i] : first[i + 1]].tolist(), finishes[first[i] : first[i + 1]].tolist(), strict=True)]
            kept = r.data[a:b][~covered[a:b]] if spans else r.data[a:b]
            out.append({"doc_id": int(r.ids[i]) if r.known[i] else None, "n_bytes": b - a, "n_removed": b - a - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest(), "removed": spans})
        return pa.Table.from_pylist(out, schema)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, seed: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets in its text).

    A byte goes if it is covered by a string of `length` bytes that starts in a document with a smaller id as well.
    seed: bytes by which a sampled suffix is named (about half of length).
    """
    spark = docs.sparkSession
    seed = seed or max(length * 12 // 25, length - 31, 1)
    n_chunks, n_buckets = C.chunk_count(spark), C.partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    texts = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks)).cast("int")).repartition(n_buckets, "chunk")
    names = texts.groupBy("chunk").applyInArrow(_send_names(n_buckets, length, seed), MESSAGE)
    named = names.groupBy("bucket").applyInArrow(_answer_names, REPLY)
    suffixes = texts.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(_send_suffixes(n_buckets, length, seed), MESSAGE)
    answers = suffixes.groupBy("bucket").applyInArrow(_answer_suffixes(length, seed), REPLY)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(n_buckets, length, seed), RESULT)


def query(spark, sf_dir):
    found = remove_repeats(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
