"""SimHash near-dedup (operator 10).

Fingerprints: 64 bits, or several times 64, from the XXH64 values of word shingles. Links: generalised pigeonhole. The bits are
grouped into parts, correlated bits together, and each part i gets a threshold t_i >= -1. A part with threshold t is probed by
its bits with each choice of t of them left out; -1 leaves a part out. Thresholds come from dynamic programming on estimated
costs (signatures written plus candidates verified), from a sample of at most SAMPLE fingerprints, the ones with the least
hash; every fingerprint is probed. Every candidate is verified by the bits of both fingerprints.

- `most`: with sum(t_i) = most - parts + 1 two fingerprints that differ in at most `most` bits differ in at most t_i bits
  in some part, so no link is lost.
- `similarity`: shingle sets of Jaccard similarity J have a cosine of 2J / (1 + J) and differ in about a share of
  arccos(cosine) / pi of the bits: 0.15 for 0.8. To cover every such pair thresholds would have to add up to far more
  signatures than can be written, so the fingerprint has 64 * WORDS bits, the bits are grouped several times over, and the
  program chooses the cheapest thresholds with which two texts of that similarity meet with a chance of `recall`
  or more. Links need at most as many different bits as nine in ten pairs of that similarity have.
  The number of signatures grows about with the 0.3rd power of the number of fingerprints.

Only different fingerprints are probed, so exact copies never meet. A signature's group is verified in numpy, one of more than
TILE fingerprints in pairs of slices, and stars (member, least member joined to it) are returned rather than
all pairs. Components are found by alternating large-star and small-star steps on the links; each step is a
grouped aggregation written to the shared folder.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; texts
with fewer words than a shingle give one shingle; rows of one doc_id share the least component of any of
them only through equal or near fingerprints, as any rows do. A null doc_id never names a component unless no
member has an id (then it is null). Extra columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

BITS = 64
#: 64-bit words of a fingerprint that is compared by similarity.
WORDS = 4
SAMPLE = 20_000
TILE = 1024
ROWS = 1 << 15
BLOCK = 1 << 18
#: The eight bits of each byte, the lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1].astype(float)


def fingerprints_of(texts: list[bytes | None], words: int = 3, n: int = 1) -> np.ndarray:
    """(texts, n) unsigned 64-bit fingerprints of the texts' shingles, repeats included; those after the first are of the hashes mixed anew."""
    import xxhash

    out, digest = np.zeros((len(texts), n), np.uint64), xxhash.xxh64_intdigest
    hashes, rows, held = [], [], 0

    def vote() -> None:
        if rows:
            h, size = np.concatenate(hashes), np.array([len(x) for x in hashes])
            at = np.repeat(np.arange(len(rows)) * 256, size)
            for k in range(n):
                out[rows, k] = _majority(C.mix(h + np.uint64(k)) if k else h, at, size)
            hashes.clear()
            rows.clear()

    for i, text in enumerate(texts):
        found = (text or b"").lower().split()
        if not found:
            continue
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.append(0, ends[:-1] + 1)
        m = max(1, len(found) - words + 1)
        last = ends[-m:].tolist() if len(found) >= words else [len(joined)]
        hashes.append(np.array([digest(joined[a:b], 42) for a, b in zip(starts[:m].tolist(), last, strict=True)], np.uint64))
        rows.append(i)
        held += m
        if held > BLOCK or len(rows) >= 512:
            vote()
            held = 0
    vote()
    return out


def _majority(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half of its hashes: bytes are counted by value, at tells where a text's counts begin."""
    out = np.zeros(len(size), np.uint64)
    for byte in range(8):
        value = (h >> np.uint64(8 * byte)).astype(np.uint8)
        votes = np.bincount(at + value, minlength=256 * len(size)).reshape(-1, 256) @ BYTE_BITS
        out |= np.packbits(2 * votes > size[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprint(text: bytes | None, words: int = 3, n: int = 1) -> np.ndarray:
    return fingerprints_of([text], words, n)[0]


def _columns(n: int) -> list[str]:
    return [f"fp{k or ''}" for k in range(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, n: int = 1) -> DataFrame:
    """doc_id, key (a hash of the text) and fp (the fingerprint as a signed long), with n > 1 also fp1, fp2, ..."""
    import pyarrow as pa

    C.small_batches(docs.sparkSession)

    def of(batches):
        for batch in batches:
            fps = fingerprints_of(batch.column(1).to_pylist(), words, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(np.ascontiguousarray(f)) for f in fps.view(np.int64).T]], ["doc_id", "key", *_columns(n)])

    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text"), F.xxhash64(text_col).alias("key"))
    return t.mapInArrow(of, "doc_id long, key long, " + ", ".join(f"{x} long" for x in _columns(n)))


def _unpacked(sample: np.ndarray) -> np.ndarray:
    """(fingerprints, bits) of a sample of words, bit 0 of the first word first."""
    sample = sample if sample.ndim == 2 else sample[:, None]
    if not len(sample):
        return np.zeros((1, BITS * max(1, sample.shape[1])), np.uint8)
    return np.unpackbits(sample.astype("<u8").view(np.uint8), axis=1, bitorder="little")


def _ties(bits: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(np.abs(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((bits.shape[1],) * 2)


def plan_parts(sample: np.ndarray, n: int, most: int = 3) -> list[tuple[list[int], int]]:
    """Parts of the 64 bits with their thresholds (parts with threshold -1 are left out), for n fingerprints in all."""
    bits = _unpacked(sample)
    tied = _ties(bits)
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, most + 2):
        parts = _correlated(tied, m)
        cost = [_costs(bits, part, max(n, 1), most) for part in parts]
        # left[s]: least cost of thresholds that sum to s, when -1 is counted as 0, 0 as 1, ...
        left: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for i, part in enumerate(parts):
            new: dict[int, tuple[float, list]] = {}
            for s, (c, chosen) in left.items():
                for t in range(-1, most + 1):
                    at = s + t + 1
                    total = c + (cost[i][t] if t >= 0 else 0.0)
                    if at <= most + 1 and total < new.get(at, (math.inf,))[0]:
                        new[at] = (total, chosen + ([(part, t)] if t >= 0 else []))
            left = new
        best = min(best, left[most + 1], key=lambda x: x[0])
    return best[1]


def share_of_bits(similarity: float) -> float:
    """The share of bits in which the fingerprints of two texts of a Jaccard similarity differ on average."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def most_bits(n_bits: int, similarity: float) -> int:
    """Different bits that nine in ten pairs of the similarity don't exceed."""
    p = share_of_bits(similarity)
    return round(n_bits * p + 1.28 * math.sqrt(n_bits * p * (1 - p)))


@functools.cache
def _missed(size: int, t: int, n_bits: int, different: int) -> float:
    """Log of the chance that more than t of a part's bits are among the different ones."""
    ways = (math.comb(different, k) * math.comb(n_bits - different, size - k) for k in range(t + 1) if k <= different and size - k <= n_bits - different)
    return math.log(max(1e-12, 1 - sum(ways) / math.comb(n_bits, size)))


def met(plan: list[tuple[list[int], int]], n_bits: int, different: int) -> float:
    """The chance that two fingerprints with so many different bits meet under some signature of a plan."""
    return 1 - math.exp(sum(_missed(len(part), t, n_bits, different) for part, t in plan))


def expected_recall(plan: list[tuple[list[int], int]], n_bits: int, similarity: float) -> float:
    p = share_of_bits(similarity)
    chance = lambda d: math.comb(n_bits, d) * p**d * (1 - p) ** (n_bits - d)
    near = range(int(n_bits * p * 0.3), int(n_bits * p * 1.7) + 2)
    return sum(chance(d) * met(plan, n_bits, d) for d in near)


def plan_recall(sample: np.ndarray, n: int, similarity: float, recall: float) -> list[tuple[list[int], int]]:
    """Parts with thresholds of the least estimated cost with which pairs of the similarity meet with a chance of recall."""
    bits = _unpacked(sample)
    n_bits, p = bits.shape[1], share_of_bits(similarity)
    few, best = bits[:2000], (math.inf, [])
    tied, pair = _ties(few), 0.004 * n_bits / BITS
    need = -math.log(1 - recall)
    for size in range(10, 31, 2):
        hit = [sum(math.comb(size, k) * p**k * (1 - p) ** (size - k) for k in range(t + 1)) for t in range(2)]
        gain = [-math.log(1 - h) for h in hit]
        rounds = math.ceil(2.5 * need / gain[0] / (n_bits // size))
        parts = _correlated(tied, n_bits // size)
        rng = np.random.default_rng(size)
        for _ in range(rounds - 1):  # the same bits in other groups
            order = rng.permutation(n_bits)
            parts += [sorted(order[i * size : (i + 1) * size].tolist()) for i in range(n_bits // size)]
        cost = [_costs(few, part, max(n, 1), 1, pair) for part in parts]
        for step in range(13):  # bits of one pair are no independent draws, so more is aimed at until the chance is reached
            plan, total = _cheapest(parts, cost, gain, need * 1.07**step)
            if total >= best[0]:
                break
            if expected_recall(plan, n_bits, similarity) >= recall:
                best = (total, plan)
                break
    return best[1]


def _cheapest(parts: list, cost: list, gain: list[float], target: float) -> tuple[list, float]:
    """The least cost of thresholds -1, 0 or 1 whose gains reach the target, by dynamic programming on steps of a 400th of it."""
    steps = 400
    worth = [min(steps, max(1, int(g / target * steps))) for g in gain]
    left = np.append(0.0, np.full(steps, math.inf))  # left[s]: least cost of a gain of s steps, the last: or more
    chosen = []
    for each in cost:
        best, at, came = left.copy(), np.full(steps + 1, -1), np.arange(steps + 1)
        for t, w in enumerate(worth):
            new, source = np.full(steps + 1, math.inf), np.maximum(np.arange(steps + 1) - w, 0)
            new[w:] = left[: steps + 1 - w] + each[t]
            source[steps] = steps - w + int(left[steps - w : steps].argmin())
            new[steps] = left[source[steps]] + each[t]
            better = new < best
            best[better], at[better], came[better] = new[better], t, source[better]
        left = best
        chosen.append((at, came))
    plan, s = [], steps
    for part, (at, came) in zip(parts[::-1], chosen[::-1], strict=True):
        if at[s] >= 0:
            plan.append((part, int(at[s])))
        s = came[s]
    return plan, float(left[steps])


def _correlated(tied: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each grows from the free bit with the strongest ties by the bits tied to it most."""
    n_bits, free, parts = len(tied), np.ones(len(tied), bool), []
    for i in range(m):
        size = (n_bits - sum(map(len, parts))) // (m - i)
        strength = np.where(free, tied[:, free].sum(1), -1.0)
        part = []
        for _ in range(size):
            part.append(int(strength.argmax()))
            free[part[-1]] = False
            strength = np.where(free, tied[:, part].sum(1), -1.0)
        parts.append(sorted(part))
    return parts


def _costs(bits: np.ndarray, part: list[int], n: int, most: int, pair: float = 0.004) -> list[float]:
    """For thresholds from 0 to most: signatures written for a part, with pairs that share one; a pair of 64 bits costs a 250th of a row."""
    rows = bits[:, part]
    # chance that two fingerprints agree in the part: from blocks of 8 bits, as a sample has few agreements in all of them
    agree = 1.0
    for i in range(0, len(part), 8):
        c = np.bincount(np.packbits(rows[:, i : i + 8], axis=1)[:, 0], minlength=256)
        agree *= max(0.5 ** rows[:, i : i + 8].shape[1], float(c @ (c - 1)) / max(1, len(rows) * (len(rows) - 1)))
    share = rows.mean(0)
    rare = float(np.mean(np.minimum(share, 1 - share) * 2).clip(0.05, 1))
    out = []
    for t in range(most + 1):
        signatures = math.comb(len(part), t)
        out.append(n * signatures + pair * n * n / 2 * agree * signatures * (1 + rare) ** t if t < len(part) else math.inf)  # else no bits are left to compare
    return out


def _masks(plan: list[tuple[list[int], int]], n: int = 1) -> list[list[int]]:
    """For each signature the bits it compares of each word, as signed longs."""
    out = []
    for part, t in plan:
        whole = sum(1 << b for b in part)
        for gone in itertools.combinations(part, t):
            mask = whole - sum(1 << b for b in gone)
            words = [mask >> BITS * k & (1 << BITS) - 1 for k in range(n)]
            out.append([x - (1 << BITS) if x >= 1 << (BITS - 1) else x for x in words])
    return out


def _stars(tile: np.ndarray, node: np.ndarray, fps: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member joined to it) in each tile; rows of one tile stand together. All pairs of a tile are compared, few are returned."""
    if not len(tile):
        return node, node
    firsts = C.starts_of_runs(tile)
    end = np.repeat(np.append(firsts[1:], len(tile)), np.diff(np.append(firsts, len(tile))))
    row, pairs = np.arange(len(tile)), []
    step = 1
    while len(row := row[row + step < end[row]]):
        bits = np.zeros(len(row), np.int32)
        for fp in fps:
            bits += np.bitwise_count(fp[row] ^ fp[row + step])
        near = row[bits <= most]
        pairs.append((near, near + step))
        step += 1
    if not pairs:
        return node[:0], node[:0]
    i, j = (np.concatenate([x[k] for x in pairs]) for k in (0, 1))
    label = np.arange(len(tile))
    while True:
        least = np.minimum(label[i], label[j])
        if (least == label[i]).all() and (least == label[j]).all():
            break
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
    joined = np.flatnonzero(label != np.arange(len(tile)))
    return node[joined], node[label[joined]]


def _verify(most: int):
    import pyarrow as pa

    def found(tile, node, *fps):
        a, b = _stars(tile, node, [f.view(np.uint64) for f in fps], most)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def verify(batches):
        kept, held = [], 0  # rows not compared yet: the last tile may go on in the next batch, and has two slices at most
        for batch in batches:
            kept.append([np.asarray(c) for c in batch.columns])
            held += batch.num_rows
            if held > ROWS:
                columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
                last = int(np.flatnonzero(np.append(True, columns[0] != columns[0][-1]))[-1])
                yield found(*[c[:last] for c in columns])
                kept, held = [[c[last:] for c in columns]], 0
        if kept:
            yield found(*[np.concatenate(c) for c in zip(*kept, strict=True)])

    return verify


def links(fps: DataFrame, most: int = 3, similarity: float | None = None, recall: float = 0.95) -> DataFrame:
    """a, b: pairs of nodes (columns node and fp, fp1, ...; no repeats) whose components are those of all links."""
    columns = [c for c in fps.columns if c.startswith("fp")]
    n_bits, p = BITS * len(columns), C.partitions(fps.sparkSession)
    n = fps.count()
    sample = np.array([list(r) for r in fps.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(SAMPLE).collect()], np.int64).reshape(-1, len(columns)).view(np.uint64)
    if similarity is None:
        plan = plan_parts(sample, n, most)
    else:
        plan, most = plan_recall(sample, n, similarity, recall), most_bits(n_bits, similarity)
    masks = F.array(*[F.struct(*[F.lit(m).alias(c) for c, m in zip(columns, mask, strict=True)]) for mask in _masks(plan, len(columns))])
    rows = fps.select("node", *columns, F.posexplode(masks).alias("i", "mask"))
    rows = rows.select(F.xxhash64("i", *[F.col(c).bitwiseAND(F.col(f"mask.{c}")) for c in columns]).alias("tile"), "node", *columns).repartition(p, "tile")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tile"))).filter("n > 1")
    small = rows.filter(F.col("n") <= TILE).select("tile", "node", *columns)
    # a group of more than TILE is cut into slices, and each pair of slices is a tile
    slices = F.ceil(F.col("n") / TILE)
    own = F.pmod(F.xxhash64(F.lit(1), "node"), slices)
    others = F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))
    large = rows.filter(F.col("n") > TILE).select("node", *columns, "tile", F.explode(others).alias("pair"))
    large = large.select(F.xxhash64("tile", "pair.x", "pair.y").alias("tile"), "node", *columns).repartition(p, "tile").sortWithinPartitions("tile", "node")
    found = small.mapInArrow(_verify(most), "a long, b long").unionByName(large.mapInArrow(_verify(most), "a long, b long"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root for each node of the edges (a, b): root is the least node of its component. Large-star and small-star in turn."""
    edges = C.materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # large star: each node's larger neighbours go to its least neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: each node's smaller neighbours and itself go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).filter("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        new = C.materialise(small)
        n, same, stars = new.agg(F.count(F.lit(1)), F.count_distinct("b"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        old = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        C.discard(edges)
        edges = new
        if n == old[0] and stars == old[1]:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def _members(docs: DataFrame, id_col: str, text_col: str, words: int, most: int, similarity: float | None, recall: float) -> DataFrame:
    """doc_id, key and fp of each row, with `least`: the least (doc_id, key) of its component, null if no member has an id."""
    n = 1 if similarity is None else WORDS
    t = fingerprints(docs, id_col, text_col, words, n)
    t = C.materialise(t.withColumn("node", F.col("fp") if n == 1 else F.xxhash64(*_columns(n))))
    name = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    classes = C.materialise(t.groupBy("node", *_columns(n)).agg(F.min(name).alias("least")))
    roots = connected(links(classes.drop("least"), most, similarity, recall)).withColumnRenamed("node", "member")
    near = classes.join(roots, F.col("node") == F.col("member"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = C.materialise(near.groupBy("root").agg(F.min("least").alias("least")))  # as a table, so that Spark can split the join of a large component
    return t.join(near.drop("least").join(ids, "root").select("node", "least"), "node")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, similarity: float | None = None, recall: float = 0.95) -> DataFrame:
    """doc_id, fingerprint (16 hex digits, the first 64 bits), component_id (the least doc_id that links reach). Links: at most `most` of 64 bits differ or, with similarity, see above."""
    t = _members(docs, id_col, text_col, words, most, similarity, recall)
    return t.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, similarity: float | None = None, recall: float = 0.95) -> DataFrame:
    """docs with one text of each component, that of its least id (of several the one with the least hash), columns unchanged.

    Rows are told apart by id and text: of a repeated id only the rows go whose own text is a near copy. Rows without id stay, and
    rows that repeat both id and text stay or go together.
    """
    t = _members(docs, id_col, text_col, words, most, similarity, recall).filter("doc_id is not null")
    gone = t.filter(F.struct("doc_id", "key") != F.col("least")).select(F.col("doc_id").alias("gone"), F.col("key").alias("gone_key")).distinct()
    rows = docs.select(C.whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"))
    return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("key") == F.col("gone_key")), "left_anti").select("row.*")


def query(spark, sf_dir):
    return near_groups(C.read(spark, sf_dir, "documents"))
