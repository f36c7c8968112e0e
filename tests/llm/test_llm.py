"""The operators against brute force, on texts with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import ann, exact_dedup, language_id, line_dedup, lm_score, mixing, packing, registry, simhash, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, row string, chunk string, size string, rank string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: "".join(word() + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n))
    passage, line = text(40), "  This line stands in MANY documents.\t"
    texts = [None, "", " \n\t", "x", passage, passage, passage.upper(), "a" * 400, "a" * 120, "ab" * 100, text(4000)]
    texts += [text(rng.randint(1, 60)) + rng.choice(["", passage, passage[:70], line + "\n" + line, "\n" + line + "\n"]) + text(rng.randint(0, 30)) for _ in range(60)]
    rows = [(i * 3, t, "en", [None, "a", "b", "c"][i % 4] if i % 3 else "hot", 0) for i, t in enumerate(texts)]
    rows += [(None, passage, "en", "a", 0), (None, None, None, None, None), rows[20], rows[20]]
    return [(*r, "k", "i", "r", "c", "s", "z") for r in rows]


ROWS = corpus()
PLAIN = [(i, t or "") for i, t, *_ in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return collections.Counter(map(tuple, rows))


def brute_repeats(df, length=50):
    """What remove_repeats gives, from all strings of 50 bytes."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, b in rows:
        for k in range(len(b) - length + 1):
            least[b[k : k + length]] = min(least.get(b[k : k + length], math.inf), key(i))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return bag(want)


def test_suffix_dedup(spark, docs):
    got = suffix_dedup.remove_repeats(docs).drop("removed").collect()
    assert bag(got) == brute_repeats(docs) and sum(r.n_removed for r in got) > 1000
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_of_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcd efg") for _ in range(n))
    passage = text(90)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)  # texts of over 1,400 bytes are cut; Python workers of local tasks get it by value below
    long = text(3000) + passage + text(2500)
    table = suffix_dedup.pa.table({"doc_id": [5, 2, 9], "text": [long.encode(), (text(40) + passage).encode(), (text(800) + long[1000:3500]).encode()]})
    cut = suffix_dedup.Runs(table, 4, 50, 24)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 20)
    whole = suffix_dedup.Runs(table, 4, 50, 24)
    covered = lambda r: {(w, int(p)) for a, b, p in zip(r.start, r.last, r.sample, strict=True) for w in range(a, b + 1)}
    assert covered(cut) == covered(whole)
    assert {r.doc_id: r.n_removed > 0 for r in suffix_dedup.remove_repeats(spark.createDataFrame([(5, long * 700), (2, passage)], "doc_id long, text string")).collect()} == {5: True, 2: False}


def test_induction_equals_comparison():
    rng = np.random.default_rng(0)
    n, length, seed = 300, 12, 5
    text = rng.integers(97, 99, (n, 19)).astype(np.uint8)
    left = rng.integers(0, 8, n)
    docs = rng.integers(0, 50, n)
    before = np.stack([text[i, left[i] - 1 - np.minimum(np.arange(7), left[i] - 1)] if left[i] else np.zeros(7, np.uint8) for i in range(n)])
    after = np.stack([text[i, left[i] : left[i] + 12] if left[i] + 12 <= 19 else np.pad(text[i, left[i] :], (0, 12 - (19 - left[i]))) for i in range(n)])
    right = np.minimum(12, 19 - left)
    names = np.array([int.from_bytes(a[:seed].tobytes(), "big") for a in after], np.uint64)
    lost = suffix_dedup.induce(names, left, right, before, after, docs, length)
    least = {}
    window = lambda i, j: (j, text[i, left[i] - j : left[i] - j + length].tobytes())
    fits = lambda i, j: j <= left[i] and right[i] >= length - j
    for i in range(n):
        for j in range(8):
            if fits(i, j):
                least[window(i, j)] = min(least.get(window(i, j), 99), docs[i])
    for i in range(n):
        for j in range(8):
            if fits(i, j):
                assert bool(lost[i] >> j & 1) == (least[window(i, j)] < docs[i])


def test_line_dedup(spark, docs):
    low = str.maketrans(line_dedup.C.UPPER, line_dedup.C.LOWER)
    keys = lambda t: [x.translate(low).strip(line_dedup.TRIM) for x in t.split("\n")]
    number = lambda i: -(1 << 63) if i is None else i
    holders = collections.defaultdict(set)
    for i, t in PLAIN:
        for k in keys(t):
            if len(k) >= 20:
                holders[k].add(number(i))
    want = []
    for i, t in PLAIN:
        lines, dropped = t.split("\n"), [len(holders.get(k, ())) >= 3 and number(i) < max(holders[k]) for k in keys(t)]
        want.append((i, len(lines), sum(dropped), "\n".join(x for x, d in zip(lines, dropped, strict=True) if not d)))
    got = line_dedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
    assert bag(got.collect()) == bag(want) and sum(w[2] for w in want) > 10
    assert line_dedup.drop_lines(empty(spark)).count() == 0


def test_exact_dedup(spark, docs):
    groups = collections.defaultdict(list)
    for i, t in PLAIN:
        groups[t].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_groups(docs).select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "row.kept").collect()
    assert len(got) == len(ROWS)
    kept = collections.Counter()
    for doc_id, text, keep_id, size, is_kept, own in got:
        t = text or ""
        assert keep_id == top[t] and size == len(groups[t]) and own == "k"
        assert not is_kept or doc_id == top[t]
        kept[t] += is_kept
    assert kept == collections.Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_exact_dedup_compares_neighbours(spark):
    """All copies but the first of a range stand next to a copy: a text has a run more than one only for each splitter inside it."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") % 300)).alias("text"))
    runs = exact_dedup._runs(df, "doc_id", "text", exact_dedup._same, None)
    by_range = {r["range"]: r["count"] for r in runs.groupBy("range").count().collect()}
    assert len(by_range) == 8 and max(by_range.values()) < 1.5 * 5000 / 8  # the hot text is over several ranges
    assert 300 <= runs.filter("first").count() <= 300 + 7
    sizes = runs.filter("not first").count()
    assert 5000 - 300 - 8 <= sizes <= 5000 - 300
    assert exact_dedup.exact_groups(df).groupBy("text_sha256").agg(F.max("group_size").alias("n"), F.count_if("kept").alias("k")).filter("k = 1").count() == 300


@pytest.mark.parametrize("copies", [2, 200, 3000])
def test_exact_dedup_of_a_hot_text(spark, copies):
    same = F.col("doc_id") < copies
    df = spark.range(3300).toDF("doc_id").select("doc_id", F.when(same, F.lit(None)).otherwise(F.col("doc_id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(df).filter("row.text is null").agg(F.min("group_size"), F.max("group_size"), F.max("keep_id"), F.count_if("kept")).first()
    assert tuple(got) == (copies, copies, copies - 1, 1)
    kept = exact_dedup.drop_copies(df).collect()
    assert len(kept) == 3301 - copies and [r.doc_id for r in kept if r.text is None] == [copies - 1]
    without = exact_dedup.drop_copies(df.withColumn("doc_id", F.when(~same, F.col("doc_id"))).repartition(5))
    assert without.count() == 3301 - copies and without.filter("text is null").count() == 1


@pytest.mark.parametrize(("url", "verdict"), [(None, "allow"), ("", "allow"), ("http://a.org/casino", "block"), ("http://a.org/casinos", "block"), ("http://a.org/casinolike", "allow"), ("http://a.org/free", "allow"), ("http://a.org/free-free", "allow"), ("http://a.org/FREE-bets", "block"), ("http://x.net/a", "block"), ("http://b.example.net/en/casino", "allow"), ("net/a", "allow"), ("http://org/fr/casino", "allow"), ("http://Net/", "block"), ("http://net?x", "allow"), ("http://freebets.org", "allow")])
def test_url_filter(spark, url, verdict):
    df = spark.createDataFrame([(1, url, "h")], "page_id long, url string, rule string")
    assert url_filter.judge_urls(df).first().verdict == verdict


def test_url_filter_on_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "http://a.org/free\nbets"), (None, "http://A.org/CASINO"), (3, "x" * 3_000_000 + "://h/casino"), (4, "http://a.org/\u00e9casino\U0001f600free-win")], "page_id long, url string").withColumns({"host": F.lit("h"), "terms": F.lit(1), "rest": F.lit(2)})
    got = collections.Counter((r.page_id, r.verdict) for r in url_filter.judge_urls(df).collect())
    assert got == collections.Counter({(1, "allow"): 2, (2, "block"): 1, (None, "block"): 1, (3, "block"): 1, (4, "block"): 1})
    assert url_filter.judge_urls(df.limit(0)).count() == 0
    own = url_filter.vocabulary_of(spark.createDataFrame([("Foo", 0.0), ("bar", 2.0), ("", 1.0)], "term string, weight double"))
    pages = spark.createDataFrame([(1, "http://a.org/foo"), (2, "http://a.org/bar"), (3, "http://a.org/casino")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, vocabulary=own).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_mixing(spark, docs):
    size = lambda t: len((t or "").encode().split())
    totals = collections.Counter()
    for r in ROWS:
        totals[r[3]] += size(r[1])
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    left, target, budget = set(order), {}, 1.5 * sum(totals.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= 2 * totals[s]}
        if not full:
            break
        left -= full
        target |= {s: 2.0 * totals[s] for s in full}
    target |= {s: weight[s] * level for s in left}
    got = mixing.mix(docs).select("row.source", "row.text", "size", "source_size", "target", "taken").collect()
    taken = collections.Counter()
    for source, text, n, of_source, t, k in got:
        assert n == size(text) and of_source == totals[source] and t == pytest.approx(target[source]) and 0 <= k <= 2 * n
        taken[source] += k
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert bag(got) == bag(mixing.mix(docs.repartition(5)).select("row.source", "row.text", "size", "source_size", "target", "taken").collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(docs.filter("text is null")).filter("taken = 0 and target = 0").count() == 2


def test_mixing_is_weighted_fair_queueing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 5, 9, 40])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    key = {i: int(hashlib.md5(f"42|{i}|{t.count('w')}".encode()).hexdigest()[:10], 16) for i, t, _ in rows}
    queues = collections.defaultdict(list)
    for r in got:
        queues[r.source].append((key[r.doc_id], r.doc_id, r.size, math.floor(r.target)))
    heap, left = [], {}
    for source, queue in queues.items():
        left[source] = iter(sorted(queue) * 2)
        heap.append([0, source or "", source])

    def advance(entry, at):
        """The next copy of a source with its finish time; where the source reaches its target the copy is cut."""
        for _, i, size, target in left[entry[2]]:
            if size:
                inside = max(0, min(size, target - at))
                return [[(at + inside) / target, i, inside]] * (inside > 0) + [[(at + size) / target, i, size - inside]] * (size > inside), at + size
        return [], at

    waiting = []
    for _, _, source in heap:
        at = 0
        while True:
            parts, at = advance([0, "", source], at)
            if not parts:
                break
            waiting += [(f, source or "", n, i, words) for n, (f, i, words) in enumerate(parts)]
    budget, taken = sum({r.source: math.floor(r.target) for r in got}.values()), collections.Counter()
    heapq.heapify(waiting)
    while waiting and budget:
        _, _, _, i, words = heapq.heappop(waiting)
        assert words <= budget
        budget -= words
        taken[i] += words
    assert budget == 0 and {r.doc_id: r.taken for r in got} == {i: taken[i] for i, *_ in rows}


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(10**6 + i, t, *ROWS[0][2:]) for i, t in enumerate(["It's J̌ 55é x'.s <|endoftext|> a", "<|ENDOFTEXT|> İstanbul \x1c ﬁ 12,3 don't ab,'s ‘ß 中文字"])]
    df = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(odd, SCHEMA))
    tokenizer = Tokenizer.from_file(path)
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in df.collect()}
    got = packing.pack_documents(df, path, size=64, n_open=3).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        at = 0
        for start, n, crc, total in sorted(found):
            assert (start, total, crc) == (at, len(ids[i]), zlib.crc32(ids[i][start : start + n].tobytes()))
            at += n
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_simhash(spark, docs):
    import xxhash

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, fingerprint(t)) for i, t in PLAIN]
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    want = [(i, f"{f:016x}", least.get(find(f))) for i, f in rows]
    assert bag(simhash.near_groups(docs).collect()) == bag(want)
    assert simhash.near_groups(empty(spark)).count() == 0


def test_simhash_near_copies(spark):
    rng = random.Random(3)
    sentence = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for group in range(40):
        words = sentence(rng.randint(300, 600))
        for copy in range(4):
            changed = list(words)
            for at in rng.sample(range(len(words)), copy):  # at most 3 words, so 15 shingles: similar by 0.9 at least
                changed[at] = "changed"
            rows.append((group * 4 + copy, " ".join(changed)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "one"), (1003, "two words")]
    fps = {i: simhash.fingerprint((t or "").encode(), 5, simhash.WORDS) for i, t in rows if i is not None}
    most = simhash.most_bits(64 * simhash.WORDS, 0.8)
    least = {i: i for i in fps}
    for _ in range(5):
        for a, b in ((a, b) for a in fps for b in fps):
            if np.bitwise_count(fps[a] ^ fps[b]).sum() <= most:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"gone": F.lit("x"), "key": F.lit("y"), "__gone": F.lit(1), "node": F.lit(2)})
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, words=5, similarity=0.8, recall=0.999).collect()}
    assert got.pop(None) == 0 and got == least
    assert sum(got[i] == i // 4 * 4 for i in range(160)) >= 155 and all(got[i] // 4 == i // 4 for i in range(160))
    out = simhash.drop_near(df, words=5, similarity=0.8, recall=0.999)
    assert out.columns == df.columns and out.count() == len(set(got.values())) + 1


def test_drop_near_tells_rows_of_one_id_apart(spark):
    """Of a repeated id only the near copy goes; of two texts of one id that are near copies one stays."""
    words = [f"w{i}" for i in range(300)]
    base, close, other = " ".join(words), " ".join([*words[:150], "changed", *words[151:]]), " ".join(f"x{i}" for i in range(300))
    df = spark.createDataFrame([(1, base), (5, close), (5, other), (7, other + " x"), (7, other + " y"), (9, "alone"), (None, base)], "doc_id long, text string")
    got = simhash.drop_near(df, words=5, similarity=0.8, recall=0.999).collect()
    assert bag((r.doc_id, r.text) for r in got) == bag([(1, base), (5, other), (9, "alone"), (None, base)])
    pair = spark.createDataFrame([(3, base), (3, close)], "doc_id long, text string")
    assert simhash.drop_near(pair, words=5, similarity=0.8, recall=0.999).count() == 1


def test_recall_plan_reaches_its_recall():
    rng = np.random.default_rng(4)
    p = simhash.share_of_bits(0.8)
    for n in (10**3, 10**5, 10**7):
        plan = simhash.plan_recall(rng.integers(0, 1 << 63, (800, 4), dtype=np.uint64), n, 0.8, 0.95)
        masks = np.array([[m & (1 << 64) - 1 for m in mask] for mask in simhash._masks(plan, 4)], np.uint64)
        flips = np.packbits(rng.random((3000, 256)) < p, axis=1, bitorder="little").view("<u8")
        met = sum(bool(((f & masks) == 0).all(1).any()) for f in flips)
        assert met / len(flips) >= 0.94 and len(masks) < 20 * n**0.3


def test_simhash_links_dense_groups(spark):
    rng = random.Random(1)
    fps = {c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 3))}) for c in [rng.getrandbits(64) for _ in range(4)] for _ in range(200)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    found = simhash.connected(simhash.links(spark.createDataFrame([(f, f) for f in signed], "node long, fp long")))
    assert found.count() == len(fps) and found.select("root").distinct().count() == 4


def test_pigeonhole_plan_covers_every_link():
    rng = np.random.default_rng(2)
    for n, most in ((100, 3), (10**5, 3), (10**8, 3), (10**4, 10), (10**7, 10)):
        plan = simhash.plan_parts(rng.integers(0, 1 << 63, 500, dtype=np.uint64), n, most)
        masks = [m[0] & (1 << 64) - 1 for m in simhash._masks(plan)]
        assert masks
        for _ in range(500):
            bits = sum({1 << int(b) for b in rng.integers(0, 64, most)})
            assert any(bits & m == 0 for m in masks)


def test_lm_score(spark, docs):
    train = F.col("doc_id") % 2 == 0
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in PLAIN]
    counts = collections.Counter(w for i, ws in tokens if i is not None and i % 2 == 0 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5)) for i, ws in tokens)
    got = lm_score.score_texts(docs, train).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    rounded = lambda rows: bag((r.doc_id, r.n_tokens, r.n_known, round(r.score, 9)) for r in rows)
    assert rounded(lm_score.score_texts(docs, train, group_bytes=300).collect()) == rounded(got)  # a group of segments for each bucket
    assert lm_score.score_texts(empty(spark), train).count() == 0
    assert lm_score.score_texts(docs, F.lit(False)).filter("train_tokens = 0 and n_known = 0").count() == len(ROWS)


def test_lm_groups_stay_bounded(spark, docs, monkeypatch):
    """Two partitions and groups of 300 bytes: no broadcast is larger, and the scores are those of one group, up to the filter's false hits."""
    held, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (held.append(value), broadcast(self, value))[1])
    monkeypatch.setattr(lm_score.C, "partitions", lambda _: 2)
    train = F.col("doc_id") % 2 == 0
    score = lambda n: bag((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.score_texts(docs.filter("length(text) < 300"), train, bits_per_entry=400.0, group_bytes=n).collect())
    small = score(2000)
    sizes = [sum(len(r[c]) for r in rows for c in ("words", "checks", "word_counts", "bits")) for rows in held]
    assert len(sizes) > 10 and max(sizes) <= 2000
    assert small == score(1 << 30)


def test_lm_score_is_the_formula(spark, docs):
    tokens = [(i, [None, *(t or "").encode().lower().split(), ""]) for i, t in PLAIN]
    training = [ws for i, ws in tokens if i is not None and i % 2 == 0]
    words, grams = collections.Counter(w for ws in training for w in ws[1:]), collections.Counter(g for ws in training for g in itertools.pairwise(ws))
    words[None] = len(training)
    n, v, mu = sum(words.values()) - words[None], len(words) - 1, 500.0
    level = lambda c: int(lm_score.level(np.array([c]), 1.5)[0])
    by_level = collections.defaultdict(list)
    for c in grams.values():
        by_level[level(c)].append(c)
    score = collections.Counter()
    for i, ws in tokens:
        total = 0.0
        for a, b in itertools.pairwise(ws):
            p = (words[b] + 0.5) / (n + 0.5 * (v + 1))
            c = min(np.mean(by_level[level(grams[a, b])]), words[a], words[b]) if grams[a, b] else 0.0
            total += math.log10((c + mu * p) / (words[a] + mu))
        score[i, round(total, 4)] += 1
    got = lm_score.score_texts(docs, F.col("doc_id") % 2 == 0, bits_per_entry=400.0).collect()  # no false hits
    assert collections.Counter((r.doc_id, round(r.score, 4)) for r in got) == score


def thue_morse(n):
    """Two different texts of n letters that every polynomial fingerprint modulo a power of two takes for one."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_with_one_fingerprint(spark, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    a, b = thue_morse(n)
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " " + b)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score_texts(df, F.col("doc_id") == 1).collect()}
    assert (got[1].n_known, got[2].n_known, got[3].n_known) == (2, 1, 2)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for r in packing.pack_documents(df, path, size=1 << 20).collect():
        text = {1: a, 2: b, 3: a + " " + b}[r.doc_id]
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert brute_repeats(df) == bag(suffix_dedup.remove_repeats(df).drop("removed").collect())


def test_bloom_filter_keeps_counts():
    grams = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000, dtype=np.uint64))
    counts = np.arange(len(grams)) % 40 + 1
    import pyarrow as pa

    table = pa.table({"words": [b""], "checks": [b""], "word_counts": [b""], "grams": [lm_score.C.narrow(grams, 4)], "gram_counts": [counts.astype(np.uint32).tobytes()]})
    row = lm_score._merge(1.5, 12.0)((pa.scalar(0),), table).to_pylist()[0]
    sums = np.frombuffer(row["level_sums"]).reshape(2, -1)
    estimate = lambda g: (sums[1] / np.maximum(sums[0], 1))[lm_score.Group([row]).probe(g, np.zeros(len(g), np.int64))]
    with np.errstate(divide="ignore"):
        assert (np.abs(np.log(estimate(grams) / counts)) < 0.75).mean() > 0.97
    assert (estimate(grams + np.uint64(12345)) == 0).mean() > 0.97


@pytest.mark.parametrize("n", [3, 1500])
def test_nearest(spark, n):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(n, 24)).astype(np.float32)
    v[n // 2 :: 7] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(10**6, None), (10**6 + 50, [0.0] * 24), (10**6 + 1, [float("nan")] * 24), (10**6 + 2, []), (10**6 + 3, [1.0, None] * 12), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    found = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = v.astype(np.float64)
    hits = total = 0
    for q in range(0, n, 50):
        score = (x * x[q]).sum(1) / np.sqrt((x * x).sum(1) * (x[q] * x[q]).sum())
        score[q] = -9
        best = np.lexsort((np.arange(n), -np.round(score, 12)))[: min(5, n - 1)].tolist()
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(best) + 1))
        assert all(abs(g[2] - score[g[1]]) < 1e-12 for g in got)
        hits, total = hits + len({g[1] for g in got} & set(best)), total + len(best)
    assert hits / total >= 0.9 and set(found) == set(range(0, n, 50))


def test_nearest_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8000, 64))
    x[:2700] = x[0] + rng.normal(size=(2700, 64)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(8000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    place = np.argsort(ids)
    assert len(got) == 160
    for q, rows in got.items():
        cos = x[place] @ x[place[q]]
        cos[q] = -2
        assert [r[1] for r in sorted(rows)] == np.argsort(-cos)[:5].tolist()


@pytest.mark.parametrize(("dim", "levels"), [(64, 1), (64, 2), (64, 3), (7, 2), (1, 2)])
def test_bounds_of_the_levels(dim, levels):
    """A score is off by no more than its level's bound; two levels leave few rows open, one level a third or more."""
    x = np.random.default_rng(3).normal(size=(4000, dim))
    quantiser = ann.Quantiser(x[:2000], levels=levels)
    codes = quantiser.codes(x)
    errors = quantiser.errors(x, codes)
    assert codes.shape == (4000, levels, quantiser.parts) and errors.shape == (4000, levels)
    assert dim == 1 or (np.diff(errors.mean(0)) < 0).all()  # of one component nothing is left after the first level
    queries = x[::100]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit[::100].T
    cos[np.arange(0, 4000, 100), np.arange(40)] = -9
    fifth = np.sort(cos, 0)[-5]
    score = np.zeros((40, 4000), np.float32)
    shares = []
    for level, tables in enumerate(quantiser.tables(queries)):
        for table, code in zip(tables, ann.packed(codes)[:, level].T, strict=True):
            score += table[:, code]
        off = np.abs(score.T - unit @ unit[::100].T)
        assert (off <= errors[:, level, None]).all()
        shares.append((score.T + errors[:, level, None] >= fifth).mean())
    if dim == 64:
        assert shares[0] > 0.3 and all(s < 0.05 for s in shares[1:])


def test_nearest_of_nothing(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs, "text", "lang", "doc_id")
    none = F.lit(None).cast("string")
    judged = language_id.identify(docs.withColumnRenamed("lang", "label"), model, ["doc_id", "label"], F.col("text"), none, none, F.col("source"), none)
    assert judged.filter("label = lang").count() >= 0.97 * docs.count()
    odd = spark.createDataFrame([(1, None, None, "s", 0), (2, "", "en", None, 0), (3, "12 34 !!", "xx", "s", 0), (4, "the and of that is the with and the", None, None, 0)], docs.schema)
    assert [r.doc_id for r in language_id.accepted_documents(odd, model).collect()] == [4]
    assert language_id.accepted_documents(docs.limit(0)).count() == 0


def test_language_id_of_rare_labels_and_headers(spark):
    rows = [(i, "the and of that is the with and the", "en") for i in range(3000)] + [(9000 + i, "zwölf größere Übungen", "qq") for i in range(3)]
    languages, table = model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id", sample=30)
    assert languages == ["en", "qq"] and table.shape[0] == 2
    pages = spark.createDataFrame([(1, "http://a.b/", "<html><header>the and of that is the</header></html>"), (2, "http://c.d/", "<html><script>the and of</script>12</html>"), (3, "http://e.f/", "<nav>the and of that</nav><p>zwölf größere Übungen</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in language_id.identify_pages(pages, model).collect()} == {1: "en", 2: None, 3: "qq"}


def test_language_id_is_the_fusion(spark):
    """identify_pages against Bayes by hand, on pages whose text, declaration, suffix and host disagree; some have none of them."""
    rng = random.Random(11)
    words = {"aa": "kala mela sola tira", "bb": "grost blent wurzt plomp", "cc": "ghiou veaux leuil quoin"}
    train = [(100 * k + i, " ".join(rng.choice(w.split()) for _ in range(12)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(15)]
    model = languages, table = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert languages == ["aa", "bb", "cc"]
    rows = []
    for i in range(300):
        lang = rng.choice("abc") * 2
        text = " ".join(rng.choice(words[lang if rng.random() < 0.5 else rng.choice(languages)].split()) for _ in range(rng.choice([0, 2, 2, 2, 6])))
        declared = rng.choice([lang, lang, "aa", "zz", ""])
        host = rng.choice([f"{rng.choice('xyz')}.{lang}site.{lang}", f"www.site.{lang}", "mixed.org", "localhost"])
        url = rng.choice([f"http://{host}/p{i}"] * 9 + [None, "nothing"])
        rows.append((i, url, f"<html lang='{declared}-X'><p>{text}</p></html>" if i % 25 else None))
    softmax = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    seen = []
    for i, url, html in rows:
        text = (html or "").split("<p>")[1].split("</p>")[0] if html else ""
        data = f"  {text}  ".encode()  # each tag leaves a space
        grams = [data[k : k + 3] for k in range(len(data) - 2) if chr(data[k]).isalpha()]
        places = [int(language_id.trigrams(np.frombuffer(g, np.uint8), np.array([0, 3]))[0][0]) for g in grams]
        scores = table[:, places].sum(1) * min(1.0, 200 / max(1, len(places))) if places else None
        declared = html.split("'")[1].split("-")[0] if html else ""
        host = url.split("//")[1].split("/")[0] if url and "//" in url else None
        parts = host.split(".") if host else []
        seen.append({
            "id": i, "scores": scores, "p": softmax(scores) if places else None,
            "declared": (declared if declared in languages else "other") if declared else None,
            "host": host, "suffix": parts[-1] if len(parts) > 1 else None, "domain": ".".join(parts[-2:]) if len(parts) > 1 else None,
        })
    told = [x for x in seen if x["p"] is not None]
    share = (sum(x["p"] for x in told) + 1) / (len(told) + 3)

    def others(x, by):
        same = [y for y in told if x[by] is not None and y[by] == x[by] and y is not x]
        return sum((y["p"] for y in same), np.zeros(3)), len(same)

    want = {}
    for x in seen:
        if x["p"] is None:
            want[x["id"]] = (None, 0.0)
            continue
        (h, nh), (d, nd) = others(x, "host"), others(x, "domain")
        prior = (h + 5 * ((d + 5 * share) / (nd + 5))) / (nh + 5)
        logs = x["scores"] + np.log(prior)
        for by in ("declared", "suffix"):
            if x[by] is not None:
                s, n = others(x, by)
                logs += np.log((s + 5 * share) / (n + 5) / share)
        p = softmax(logs)
        want[x["id"]] = (languages[int(p.argmax())] if p.max() >= 0.5 else None, p.max())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n": F.lit(1), "lang": F.lit("q"), "host": F.lit("r")})
    got = {r.page_id: (r.lang, r.confidence) for r in language_id.identify_pages(pages, model).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in want)
    by_text = {x["id"]: languages[int(x["p"].argmax())] for x in told}
    assert sum(want[i][0] != by_text[i] for i in by_text) >= 3  # the fusion decides some
    assert language_id.identify_pages(pages.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        language_id.train(spark.range(600).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.col("id").cast("string").alias("lang")), "text", "lang", "doc_id")


def test_language_id_of_many_labels(spark):
    """150 labels are fused in about the time of 4: cost does not grow with their square."""
    import time

    rng = np.random.default_rng(3)
    letters = np.array([chr(c) for c in range(97, 123)])
    rows = [(i, "".join(rng.choice(letters, 60)), "en", "http://a.b.com/x") for i in range(300)]
    pages = spark.createDataFrame([(i, url, f"<html lang={lang}>{text}") for i, text, lang, url in rows], "page_id long, url string, html string").cache()
    took = []
    for n in (4, 4, 150):
        table = np.log(rng.dirichlet(np.ones(language_id.BUCKETS), n))
        began = time.time()
        got = language_id.identify_pages(pages, ([f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)], table)).collect()
        took.append(time.time() - began)
        assert len(got) == 300 and all(0 < r.confidence <= 1 for r in got)
    assert took[2] < 3 * took[1] + 5


def test_pipeline_by_brute_force(spark, tmp_path):
    """run() on a small table with nulls, repeats and clashing columns, each stage against what it is to do."""
    import corpus_pipeline

    rng = random.Random(2)
    source = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and len(r.text) < 6000][:60]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in source]
    rows += [(1000 + i, *rows[i][1:]) for i in range(5)] + [rows[7], (2000, None, None, None, None), (2001, "", "en", "src0", 0), (None, rows[9][1], "en", None, 1), (2002, "12 34 ??", "en", "src1", 8)]
    for i in range(4):
        words = rows[i + 20][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((3000 + i, " ".join(words), *rows[i + 20][2:]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"gone": F.lit(1), "row": F.lit("x"), "slot": F.lit(2)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, outs = df, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = outs[name] = spark.createDataFrame(stage(spark, docs, "").collect(), None if name == "packed" else ", ".join(f"{c} {k}" for c, k in df.select(*corpus_pipeline.COLUMNS).dtypes)) if name != "packed" else stage(spark, docs, "")
    kept = {name: [(r.doc_id, r.text) for r in out.collect()] for name, out in outs.items() if name != "packed"}
    assert {i for i, _ in kept["language"]} == {r[0] for r in rows} - {2000, 2001, 2002}
    best = {}
    for i, t in kept["language"]:
        best[t] = i if best.get(t) is None else max(best[t], -1 if i is None else i)
    assert sorted((i, t) for t, i in best.items()) == sorted(kept["exact"])
    shingles = {t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t in kept["exact"] for w in [t.lower().split()]}
    ids, texts = [i for i, _ in kept["exact"]], dict(kept["exact"])

    def later(similarity):
        """The documents that are not the least of those they reach at a similarity."""
        close = [(a, b) for a in ids for b in ids if a < b and len(shingles[texts[a]] & shingles[texts[b]]) >= similarity * len(shingles[texts[a]] | shingles[texts[b]])]
        root = {i: i for i in ids}
        for _ in ids:
            for a, b in close:
                root[a] = root[b] = min(root[a], root[b])
        return {i for i in ids if root[i] != i}

    near = {i for i, _ in kept["near"]}
    dropped = set(ids) - near
    assert len(later(0.8)) >= 4 and len(later(0.8) - dropped) <= 1 and dropped <= later(0.55)
    counts = collections.Counter(i for i, _ in kept["mixed"])
    assert set(counts) <= near and max(counts.values()) <= 2
    pieces = outs["packed"].collect()
    tokens = collections.Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == counts[r.doc_id] * r.doc_tokens for r in pieces) and set(tokens) == set(counts)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in whole.select("doc_id", "doc_tokens").distinct().collect()) == collections.Counter({(r.doc_id, r.doc_tokens) for r in pieces})
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_duckdb(spark, name):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"create view {table} as select * from '{data}/{table}.parquet'")
    df, rel = registry.QUERIES[name](spark, data), con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert bag(df.select(*rel.columns).collect()) == bag(rel.fetchall())
