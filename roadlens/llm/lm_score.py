"""Language-model scores (operator 5).

Training counts words and bigrams: tasks count their own blocks and shuffle, for each bucket of hashes, one
message of different names with counts. A bucket adds them up, keeps its words' counts as a table and writes
its bigrams into its segment of a log-frequency Bloom filter: a bigram of count c goes in once for each level
from 1 to 1 + log_b(c). Segments grow with their entries, so the rate of false hits is the same at every size.
Scoring probes level after level until one is missing; the level reached stands for the mean count of the bigrams
at it.

    P(w | h) = (count(h w) + mu * P(w)) / (count(h) + mu),   P(w) = (c + 0.5) / (N + 0.5 * (V + 1))

The filter follows the corpus, so it is never broadcast whole: the buckets' segments, with their exact counts of words, are
broadcast in groups of at most `group_bytes`, one group after the other. All of a bigram's places lie in one block of BLOCK_BITS bits of its segment, and
a word has its place among the blocks too, so a bucket that is larger than a group is cut between blocks into slices, without
any influence on what the filter answers. Each chunk of documents writes down its different words and
bigrams once, filed by group, and each group's pass answers its own share of these questions, without a shuffle.
All sizes take this one way.

Words are named by 128 bits (see common.names), bigrams by 32 bits within their bucket, next to which the filter's
own false hits are many; a bucket's share of the bigrams doesn't grow, as there is one for each partition and for each BUCKET_TEXT bytes of text.

Defined results: null text counts as empty (one token, the end). A null doc_id counts as empty text for the split, and so is
a training row. With no training tokens at all P(w) = 1. Repeated rows count as often as they stand there.
Extra columns are ignored. Empty tables give empty results. A very long text is read in one block of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C
from roadlens.sources import shared

BLOCK = 8 << 20
GROUP_BYTES = 16 << 20
BUCKET_TEXT = 64 << 20
BLOCK_BITS = 512
#: Names of the end of a text and of what stands before its first word; the second name of both is 0.
END, START = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7)
COUNTS = "bucket int, words binary, checks binary, word_counts binary, grams binary, gram_counts binary"
MERGED = "bucket int, slice int, n_slices int, n_blocks long, words binary, checks binary, word_counts binary, bits binary, n_bits long, n_hashes int, tokens long, types long, level_sums binary"
ASKED = "chunk int, bucket int, part int, words binary, checks binary, grams binary"
TOLD = "chunk int, bucket int, counts binary, levels binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
LEVELS = 96
GRAM_BITS = np.uint64((1 << 32) - 1)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both names of all tokens, each text's words and then its end, and where each text's tokens begin (one more for the end)."""
    low = C.lowered(data)
    starts, ends = C.words_of(low, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    begin = np.searchsorted(doc, np.arange(len(offsets))) + np.arange(len(offsets))
    name, check = np.full(len(starts) + len(offsets) - 1, END, np.uint64), np.zeros(len(starts) + len(offsets) - 1, np.uint64)
    at = np.arange(len(starts)) + doc
    name[at], check[at] = C.names(low, starts, ends)
    return name, check, begin


def bigrams(token: np.ndarray, begin: np.ndarray) -> np.ndarray:
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[begin[:-1]] = START
    return C.mix(before * np.uint64(C.BASE) + token)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _block(h: np.ndarray, n_blocks: np.ndarray | int) -> np.ndarray:
    """By the low 32 bits, which is what is kept of bigrams."""
    part = (h & GRAM_BITS) * np.uint64(C.BASE) >> np.uint64(32)
    return (part * np.asarray(n_blocks, np.uint64) >> np.uint64(32)).astype(np.int64)


class Slots:
    """Buckets with their slices, numbered through, and the group of each slot."""

    def __init__(self, n_blocks: np.ndarray, n_slices: np.ndarray):
        self.n_blocks, self.n_slices, self.first = n_blocks, n_slices, np.cumsum(n_slices) - n_slices
        self.n, self.groups = int(n_slices.sum()), np.zeros(int(n_slices.sum()), np.int64)

    def pack(self, sizes: np.ndarray, most: int) -> int:
        """Neighbouring slots share a group as long as they have at most `most` bytes together; the number of groups."""
        total, group = 0, 0
        for slot, size in enumerate(sizes.tolist()):
            if total and total + size > most:
                total, group = 0, group + 1
            total += size
            self.groups[slot] = group
        return group + 1

    def of(self, h: np.ndarray) -> np.ndarray:
        bucket = _bucket(h, len(self.n_slices))
        return self.first[bucket] + _block(h, self.n_blocks[bucket]) * self.n_slices[bucket] // self.n_blocks[bucket]


def _parted(of: np.ndarray, n: int):
    """(number, places that have it) for each number below n."""
    at = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[at], np.arange(n + 1))
    return ((b, at[ends[b] : ends[b + 1]]) for b in range(n))


def _grams(h: np.ndarray) -> bytes:
    return C.narrow(h, 4)


def _count(n_buckets: int):
    def count(batches):
        for batch in batches:
            data, offsets = C.text_arrays(batch.column(0))
            for i, j in C.blocks(offsets, BLOCK):
                token, check, begin = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order, firsts = C.sorted_groups(token, check)
                words, checks, word_counts = token[order[firsts]], check[order[firsts]], np.diff(np.append(firsts, len(order)))
                grams, gram_counts = np.unique(bigrams(token, begin), return_counts=True)
                rows = []
                for (b, x), (_, y) in zip(_parted(_bucket(words, n_buckets), n_buckets), _parted(_bucket(grams, n_buckets), n_buckets), strict=True):
                    if len(x) or len(y):
                        rows.append({"bucket": b, "words": words[x].tobytes(), "checks": checks[x].tobytes(), "word_counts": word_counts[x].astype(np.uint32).tobytes(), "grams": _grams(grams[y]), "gram_counts": gram_counts[y].astype(np.uint32).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, _schema(COUNTS))

    return count


def _sum(keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys with their checks and sums of counts."""
    checks = np.zeros(len(keys), np.uint64) if checks is None else checks
    order, firsts = C.sorted_groups(keys, checks)
    sums = np.add.reduceat(counts[order].astype(np.int64), firsts) if len(firsts) else np.zeros(0, np.int64)
    return keys[order[firsts]], checks[order[firsts]], sums


def level(counts: np.ndarray, base: float) -> np.ndarray:
    """Quantised log count: 1 + log_base(count), rounded down, LEVELS - 1 at most."""
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9), LEVELS - 1).astype(np.int64)


def _seeds(h: np.ndarray, n_level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key at a level; their sums are its places in the filter."""
    seed = C.mix(h + np.uint64(n_level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    return seed, C.mix(seed ^ np.uint64(0xA5A5A5A5)) | np.uint64(1)


def _segment(grams: np.ndarray, levels: np.ndarray, bits_per_entry: float) -> tuple[np.ndarray, int]:
    """Blocks of a filter that holds each bigram once for each level up to its own, and the number of hashes."""
    entries = int(levels.sum())
    n_blocks = max(1, math.ceil(bits_per_entry * entries / BLOCK_BITS))
    n_hashes = int(np.clip(round(0.693 * n_blocks * BLOCK_BITS / max(1, entries)), 1, 6))
    on, block = np.zeros(n_blocks * BLOCK_BITS, bool), _block(grams, n_blocks).astype(np.uint64) * np.uint64(BLOCK_BITS)
    for n in range(1, int(levels.max(initial=0)) + 1):
        own = levels >= n
        seed, step = _seeds(grams[own], n)
        for k in range(n_hashes):
            on[block[own] + (seed + np.uint64(k) * step) % np.uint64(BLOCK_BITS)] = True
    return np.packbits(on, bitorder="little").reshape(n_blocks, -1), n_hashes


def _slices(words_of_block: np.ndarray, most: int) -> int:
    """How many slices it takes until none has more than `most` bytes, as far as there are blocks."""
    n_blocks, bytes_upto = len(words_of_block), np.append(0, np.cumsum(24 * words_of_block + BLOCK_BITS // 8))
    n = 1
    while n < n_blocks:
        edges = -(-np.arange(n + 1) * n_blocks // n)
        if np.diff(bytes_upto[edges]).max() <= most:
            break
        n = min(n_blocks, max(n + 1, 5 * n // 4, int(bytes_upto[-1]) // most))
    return n


def _merge(base: float, bits_per_entry: float, most: int = GROUP_BYTES):
    def merge(key, table):
        joined = lambda name: b"".join(x.as_py() for x in table.column(name))
        numbers = lambda name, kind: np.frombuffer(joined(name), kind)
        words, checks, word_counts = _sum(numbers("words", np.uint64), numbers("checks", np.uint64), numbers("word_counts", np.uint32))
        grams, _, gram_counts = _sum(C.widen(joined("grams"), 4), None, numbers("gram_counts", np.uint32))
        levels = level(gram_counts, base)
        blocks, n_hashes = _segment(grams, levels, bits_per_entry)
        n_blocks, at = len(blocks), _block(words, len(blocks))
        n, rows = _slices(np.bincount(at, minlength=n_blocks), most), []
        gram_slice = _block(grams, n_blocks) * n // n_blocks
        for (i, x), (_, y) in zip(_parted(at * n // n_blocks, n), _parted(gram_slice, n), strict=True):
            bits = blocks[-(-i * n_blocks // n) : -(-(i + 1) * n_blocks // n)]
            sums = np.stack([np.bincount(levels[y], minlength=LEVELS), np.bincount(levels[y], gram_counts[y], minlength=LEVELS)])
            row = {"bucket": key[0].as_py(), "slice": i, "n_slices": n, "n_blocks": n_blocks, "words": words[x].tobytes(), "checks": checks[x].tobytes(), "word_counts": word_counts[x].tobytes(), "bits": bits.tobytes(), "n_bits": bits.size * 8, "n_hashes": n_hashes}
            rows.append(row | {"tokens": int(word_counts[x].sum()), "types": len(x), "level_sums": sums.astype(float).tobytes()})
        return pa.Table.from_pylist(rows, _schema(MERGED))

    return merge


class Group:
    """Segments and exact counts of a group of buckets, which answers questions of all its buckets together."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["bucket"])
        joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        names, checks = joined("words", np.uint64), joined("checks", np.uint64)
        order = np.lexsort((checks, names))  # a name belongs to one bucket
        self.words, self.checks, self.counts = names[order], checks[order], joined("word_counts", np.int64)[order]
        self.bits = joined("bits", np.uint8)
        self.buckets = np.array([r["bucket"] for r in rows], np.int64)
        self.n_bits = np.array([r["n_bits"] for r in rows], np.uint64)
        self.n_hashes = np.array([r["n_hashes"] for r in rows], np.int64)
        self.n_blocks = np.array([r["n_blocks"] for r in rows], np.int64)
        # where a bucket's first block would be among the bits, which begin with the first block of its slice
        before = np.array([-(-r["slice"] * r["n_blocks"] // r["n_slices"]) * BLOCK_BITS for r in rows], np.int64)
        self.first = (np.cumsum(self.n_bits) - self.n_bits).astype(np.int64) - before

    def look_up(self, want: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The counts of wanted words, 0 for those not in the table."""
        at, out = np.searchsorted(self.words, want), np.zeros(len(want), np.int64)
        words, left = np.append(self.words, 0), np.arange(len(want))
        while len(left := left[(at[left] < len(self.counts)) & (words[at[left]] == want[left])]):  # different words with one name: the next entry is looked at
            hit = self.checks[at[left]] == check[left]
            out[left[hit]] = self.counts[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
        return out

    def probe(self, grams: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The level of each bigram in the segment of its slot (or bucket, if it has one slice), 0 if it isn't there: levels are probed until one is missing."""
        reached, h = np.zeros(len(grams), np.uint8), grams & GRAM_BITS
        if not len(self.buckets):
            return reached
        place = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        block = self.first[place] + _block(h, self.n_blocks[place]) * BLOCK_BITS
        left, n = np.flatnonzero(self.buckets[place] == bucket), 1
        while len(left) and n < LEVELS:
            seed, step = _seeds(h[left], n)
            for k in range(int(self.n_hashes.max())):
                at = block[left] + (seed % np.uint64(BLOCK_BITS)).astype(np.int64)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                hit |= k >= self.n_hashes[place[left]]
                left, step = left[hit], step[hit]
                seed = seed[hit] + step
            reached[left] = n
            n += 1
        return reached


class Chunk:
    """The tokens of a chunk's documents and the different words and bigrams among them, in an order that depends on the chunk alone."""

    def __init__(self, table: pa.Table):
        data, offsets = C.text_arrays(table.column("text"))
        token, check, self.begin = tokens(data, offsets)
        order, firsts = C.sorted_groups(token, check)
        self.words, self.checks = token[order[firsts]], check[order[firsts]]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(order))))
        self.grams, self.of_gram = np.unique(bigrams(token, self.begin), return_inverse=True)


def _ask(slots: Slots):
    def ask(key, table):
        c = Chunk(table)
        parts = zip(_parted(slots.of(c.words), slots.n), _parted(slots.of(c.grams), slots.n), strict=True)
        rows = [{"chunk": key[0].as_py(), "bucket": b, "part": int(slots.groups[b]), "words": c.words[x].tobytes(), "checks": c.checks[x].tobytes(), "grams": _grams(c.grams[y])} for (b, x), (_, y) in parts if len(x) or len(y)]
        return pa.Table.from_pylist(rows, _schema(ASKED))

    return ask


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each value of a binary column: the bytes of values up to the next of ends (counted in bytes)."""
    offsets = np.append(0, ends).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _tell(held):
    """Counts of the words and levels of the bigrams that chunks ask of one group of buckets."""

    def tell(batches):
        group = Group(held.value)
        for batch in batches:
            bucket = np.asarray(batch.column("bucket"))
            (words, word_at), (checks, _), (grams, gram_at) = (C.text_arrays(batch.column(c)) for c in ("words", "checks", "grams"))
            for i, j in C.blocks(gram_at, BLOCK):
                numbers = lambda data, at, i=i, j=j: data[at[i] : at[j]].tobytes()
                counts = group.look_up(np.frombuffer(numbers(words, word_at), np.uint64), np.frombuffer(numbers(checks, word_at), np.uint64))
                levels = group.probe(C.widen(numbers(grams, gram_at), 4), np.repeat(bucket[i:j], np.diff(gram_at[i : j + 1]) // 4))
                rest = [batch.column(c).slice(i, j - i) for c in ("chunk", "bucket")]
                yield pa.RecordBatch.from_arrays([*rest, _binary(counts, word_at[i + 1 : j + 1] - word_at[i]), _binary(levels, (gram_at[i + 1 : j + 1] - gram_at[i]) // 4)], schema=_schema(TOLD))

    return tell


def _joined(told: pa.Table, field: str, names: np.ndarray, slots: Slots, kind) -> np.ndarray:
    """The answers about names, which come by slot and in each slot in the order of the questions."""
    out = np.zeros(len(names), kind)
    out[np.argsort(slots.of(names), kind="stable")] = np.frombuffer(C.text_arrays(told.column(field))[0].tobytes(), kind)
    return out


def _score(slots: Slots, n_tokens: int, n_types: int, mu: float, n_texts: int, means: np.ndarray):
    def score(key, table, told):
        if not table.num_rows:
            return _schema(SCORES).empty_table()
        chunk, replies = Chunk(table), told.sort_by("bucket")
        begin = chunk.begin
        c = _joined(replies, "counts", chunk.words, slots, np.int64)[chunk.of]
        p = (c + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[begin[:-1]] = n_texts
        together = means[_joined(replies, "levels", chunk.grams, slots, np.uint8)[chunk.of_gram]]
        together = np.where((c > 0) & (before > 0), np.minimum(together, np.minimum(c, before)), 0.0)  # a bigram is no more frequent than its words
        model = np.log10((together + mu * p) / (before + mu))
        per_text = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731  each text has at least its end
        return pa.table(
            [table.column("doc_id"), pa.compute.invert(table.column("train")), pa.array(np.diff(begin)), pa.array(per_text((c > 0).astype(np.int64))), pa.array(np.full(len(begin) - 1, n_tokens)), pa.array(per_text(np.log10(p))), pa.array(per_text(model))],
            schema=_schema(SCORES),
        )

    return score


def score_texts(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", base: float = 1.5, bits_per_entry: float = 8.0, group_bytes: int = GROUP_BYTES, mu: float = 500.0) -> DataFrame:
    """Scores of all texts under a model of those for which the Column train holds (columns: see SCORES)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    n_text, n_texts = t.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count_if("train")).first()
    n_buckets = max(C.partitions(spark), math.ceil(n_text / BUCKET_TEXT))
    counted = t.filter("train").select("text").mapInArrow(_count(n_buckets), COUNTS)
    merged = C.materialise(counted.groupBy("bucket").applyInArrow(_merge(base, bits_per_entry, group_bytes), MERGED))
    n_tokens, n_types = (x or 0 for x in merged.agg(F.sum("tokens"), F.sum("types")).first())
    sums = sum((np.frombuffer(r[0]).reshape(2, -1) for r in merged.select("level_sums").toLocalIterator()), np.zeros((2, LEVELS)))  # LEVELS sums of each slot
    means = np.where(sums[0] > 0, sums[1] / np.maximum(sums[0], 1), 0.0)
    size = F.col("n_bits") / 8 + F.octet_length("words") + F.octet_length("checks") + F.octet_length("word_counts")
    held_sizes = merged.select("bucket", "slice", "n_slices", "n_blocks", size.cast("long").alias("size")).collect()  # a few numbers for each slot
    n_slices, n_blocks = np.ones(n_buckets, np.int64), np.ones(n_buckets, np.int64)
    n_slices[[r["bucket"] for r in held_sizes]] = [r["n_slices"] for r in held_sizes]
    n_blocks[[r["bucket"] for r in held_sizes]] = [r["n_blocks"] for r in held_sizes]
    slots = Slots(n_blocks, n_slices)
    sizes = np.zeros(slots.n, np.int64)
    sizes[[slots.first[r["bucket"]] + r["slice"] for r in held_sizes]] = [r["size"] for r in held_sizes]
    n_parts = slots.pack(sizes, group_bytes)
    own = F.coalesce(F.col("doc_id"), F.xxhash64("text"))  # rows without id are dealt by their texts
    chunked = t.withColumn("chunk", F.pmod(F.xxhash64(own), F.lit(C.CHUNKS * n_buckets)).cast("int")).repartition(n_buckets, "chunk")
    questions, answers = shared.new_path(spark), shared.new_path(spark)
    chunked.groupBy("chunk").applyInArrow(_ask(slots), ASKED).write.partitionBy("part").parquet(questions)
    asked = spark.read.schema(ASKED).parquet(questions)
    for k in range(n_parts):  # one bounded group of slots after the other
        inside = [int(i) for i in np.flatnonzero(slots.groups == k)]
        buckets = np.searchsorted(slots.first, [inside[0], inside[-1]], "right") - 1
        rows = merged.filter(F.col("bucket").between(*buckets.tolist())).withColumn("slot", F.get(F.array(*[F.lit(int(x)) for x in slots.first[buckets[0] : buckets[1] + 1]]), F.col("bucket") - int(buckets[0])) + F.col("slice"))
        rows = rows.filter(F.col("slot").between(inside[0], inside[-1])).drop("tokens", "types", "level_sums").collect()  # at most group_bytes
        held = spark.sparkContext.broadcast([{c: bytes(x) if isinstance(x, bytearray) else x for c, x in r.asDict().items()} | {"bucket": r["slot"]} for r in rows])
        asked.filter(F.col("part") == k).drop("part").mapInArrow(_tell(held), TOLD).write.mode("append").parquet(answers)
        held.destroy()
    shared.delete(questions)
    C.discard(merged)
    scored = chunked.groupBy("chunk").cogroup(spark.read.schema(TOLD).parquet(answers).groupBy("chunk"))
    return scored.applyInArrow(_score(slots, n_tokens, n_types, mu, n_texts, means), SCORES)


def query(spark, sf_dir):
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    return score_texts(C.read(spark, sf_dir, "documents"), split != 1)
