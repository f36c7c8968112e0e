"""Operators 11 to 13 against the tokenizers' own libraries and brute force, on odd rows."""

import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadlens.llm import alignment, bpe, hard_negatives

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, row string, a string, b string, tokens string"
ODD = [
    *[None, "", " ", "  ", "\n", "foo ", "foo  \n\n bar\t\tx \n", "don't O'Neil's ÉCOLE İstanbul a<|endoftext|>B <|startoftext|><s> </s>"],
    *["1234 中文 字́ é 🙂🙂 \x00  x  y　 z  \n q", "a▁b", "ab" * 400 + "!!!???" * 100, "foo(bar); x.y_z  //  {}\r\n  return 0;\x1c \x1d x᠎ y \x7f z"],
    *["<0x0A> <unk> é, è.  «ñ»​ x", "ŉ ſt ﬁ Ǆ ß ẞ", "Ⅷ ½ ²³ ٣ क्षि ไทย"],
]


def rows():
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdeéßЖ'.-1") for _ in range(rng.randint(1, 8))) for _ in range(n))
    texts = [*ODD, *[text(rng.randint(1, 50)) for _ in range(40)], text(400_000)]  # the last one is longer than a block
    out = [(i, t, "r", "x", "y", "z") for i, t in enumerate(texts)]
    return [*out, out[20], out[20], (None, "null id", "r", None, None, None)]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def test_trie_encodes_and_decodes_like_the_library(spark, docs):
    own = Tokenizer.from_file(WORDS)
    want = []
    for i, text, *_ in ROWS:
        ids = own.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), np.array(ids, "<u4").tobytes(), own.decode(ids, skip_special_tokens=False)))
    got = [(str(r.doc_id), bytes(r.ids), r.text) for r in bpe.encode_texts(docs, WORDS).collect()]
    assert collections.Counter(got) == collections.Counter(want)
    assert bpe.encode_texts(docs.limit(0), WORDS).collect() == []


def test_trie_query_digests(spark):
    own = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(table)
    for r in table:
        ids = own.encode(r.text or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


ENCODER = bpe.TrieEncoder(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), min_size=1, max_size=12), min_size=1, max_size=8))
def test_trie_is_plain_merging(words):
    """The states of the trie give what merging pair by pair gives, in a trie that keeps growing."""
    words = [w.encode() for w in words]
    found = ENCODER.trie.encode(list(set(words)))
    for w in words:
        assert found[w] == ENCODER.trie.merged((*w[:-1], w[-1] + 256))


def test_trie_shares_prefixes():
    """Each different prefix is a node once, and a second call makes none."""
    trie = bpe.Trie({"vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": ["a b", "ab a"]})
    assert trie.encode([b"abab", b"aba", b"abb"]) == {b"abab": [2, 2], b"aba": [3], b"abb": [2, 1]}
    n = len(trie.last)
    assert n == 1 + len({w[:k] for w in (b"abab", b"aba", b"abb") for k in range(1, len(w) + 1)})
    trie.encode([b"ab", b"abab"])
    assert len(trie.last) == n
    with pytest.raises(ValueError):
        bpe.Trie({"vocab": {"a": 0}, "merges": [], "dropout": 0.1})


def spans(ids, names):
    ends = list(itertools.accumulate(len(names[i]) for i in ids))
    return list(zip([0, *ends], ends, strict=False))


def brute_alignment(table):
    """The digests of (doc_id, text) rows, from whole texts, token by token."""
    own = alignment.Aligner(BYTES, PIECES)
    a_side, b_side = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_side.encode_special_tokens = True
    each, count = [], collections.Counter()
    for i, text in table:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        if b"".join(own.a_bytes[x] for x in a) != (" " + (text or "")).encode() or b"".join(own.b_bytes[x] for x in b) != (" " + (text or "")).encode():
            a, b = [], []
        at, bt = spans(a, own.a_bytes), spans(b, own.b_bytes)
        links, j = [], 0
        for x, (u, v) in zip(a, at, strict=True):
            while bt[j][1] <= u:
                j += 1
            links += [(x, b[k]) for k in itertools.takewhile(lambda k, v=v: bt[k][0] < v, range(j, len(b)))]
        both = {v for _, v in at} & {v for _, v in bt}
        groups, side = [], ([], [])
        tokens = sorted([(v, 0, x) for x, (_, v) in zip(a, at, strict=True)] + [(v, 1, x) for x, (_, v) in zip(b, bt, strict=True)])
        for v, which, x in tokens:
            side[which].append(str(x))
            if v in both and which == 1:
                groups.append(",".join(side[0]) + "|" + ",".join(side[1]))
                side = ([], [])
        count.update(set(links))
        each.append((i, a, b, links, groups))
    most = collections.Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return collections.Counter((i, len(a), len(b), len(g), len(k), sum(count[p] == most[p[0]] for p in k), sum(count[p] for p in k), digest(g)) for i, a, b, k, g in each)


@pytest.mark.parametrize("group_pairs", [1 << 21, 1500])
def test_alignment(spark, docs, group_pairs):
    """With one group of counted pairs and with several."""
    got = alignment.alignment_digests(docs, BYTES, PIECES, group_pairs=group_pairs).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_alignment([r[:2] for r in ROWS])


def test_alignment_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = collections.Counter(tuple(r) for r in alignment.query(spark, "/root/testdata/sf0.001").collect())
    assert got == brute_alignment([(r.doc_id, r.text) for r in table.collect()])
    assert alignment.alignment_digests(table.limit(0), BYTES, PIECES).collect() == []


def test_alignment_groups_cover_the_text(spark, docs):
    own = alignment.Aligner(BYTES, PIECES)
    texts = {i: t for i, t, *_ in ROWS if i is not None}
    for r in alignment.aligned_groups(docs.filter("doc_id is not null"), BYTES, PIECES).collect():
        raw, at = (" " + (texts[r.doc_id] or "")).encode(), 0
        for g in r.groups:
            assert g.start == at and b"".join(own.a_bytes[i] for i in g.a) == raw[g.start : g.end] == b"".join(own.b_bytes[i] for i in g.b)
            at = g.end
        assert at in (0, len(raw))


def test_spans_are_refined_where_tokens_share_a_character():
    assert alignment.refined([(0, 1), (1, 5), (1, 5), (5, 7)], [1, 2, 2, 2], 0) == [1, 3, 5, 7]


def test_counted_pairs_leave_a_task_in_bounded_pieces(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 50)
    tokens = alignment.token_ids(docs.limit(30), BYTES, PIECES)
    parts = alignment._count((BYTES, PIECES))(tokens.toArrow().to_batches(max_chunksize=3))
    few = collections.Counter()
    for part in parts:
        for r in part.to_pylist():
            few[r["a"], r["b"]] += r["n"]
    assert few == {(r.a, r.b): r.n for r in alignment.link_counts(tokens, BYTES, PIECES).collect()}


def brute_negatives(table, n=5):
    v = [(i, np.floor(256 * np.array(x, float)), (y + 1) % 10 if i % 7 == 0 else y) for i, x, y in table if i is not None and y is not None and x and len(x) == len(table[0][1]) and all(c is not None and np.isfinite(c) for c in x)]
    ids, m, label = np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])
    want = []
    for i in np.flatnonzero(ids % 100 == 0):
        score = (m @ m[i]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]]
        for p in [j for j in order if label[j] == label[i]][:n]:
            found = [j for j in order if label[j] != label[i] and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:n]
            want += [(int(ids[i]), int(ids[p]), k, int(ids[j]), int(score[p]), int(score[j])) for k, j in enumerate(found, 1)]
    return collections.Counter(want)


def vectors():
    """Clusters, many copies of one vector, ties, and rows that take no part."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 8))
    v = centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.15, (3000, 8))
    v[1000:2000] = v[7]
    table = [(i, [float(x) for x in np.float32(v[i])], int(rng.integers(0, 4))) for i in range(3000)]
    return [*table, (None, [1.0] * 8, 1), (5000, None, 1), (5100, [1.0] * 8, None), (5200, [1.0] * 7 + [float("nan")], 1), (5300, [1.0] * 7 + [None], 1), (5400, [1.0] * 3, 1), (300, [0.5] * 8, 2), (5500, [0.0] * 8, 3), (5600, [], 1)]


VECTORS = vectors()
LABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"


@pytest.mark.parametrize("leaf_sample, part, arity", [(16, 64, 4), (64, 500, 8), (100_000, 100_000, 8)])
def test_hard_negatives(spark, leaf_sample, part, arity):
    """A deep tree with small parts, a flat one, and a single leaf."""
    df = spark.createDataFrame([(*r, "x") for r in VECTORS], "vec_id long, embedding array<float>, label int, leaf string")
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=F.expr(LABEL), leaf_sample=leaf_sample, part=part, arity=arity).collect()
    assert collections.Counter(map(tuple, got)) == brute_negatives(VECTORS)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(VECTORS[:3], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df.limit(0), F.lit(True)).collect() == []
    assert hard_negatives.mine(df.filter("vec_id = 1"), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.createDataFrame([(1, [1e300], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True))


def test_tree_drops_siblings_and_loses_no_row():
    """On clusters most leaves are dropped, and no row of an annulus lies in a dropped leaf."""
    m = np.floor(256 * np.array([r[1] for r in VECTORS[:3000]]))
    tree = hard_negatives.Tree(m[::3], int((m * m).sum(1).max()), leaf_sample=16, arity=8)
    for n in tree.nodes:
        n.low, n.high = np.full((len(n.points),) * 2, np.inf), np.full((len(n.points),) * 2, -np.inf)

    def seen(node, d, nearest):
        n = tree.nodes[node]
        for k in set(nearest.tolist()):
            n.low[:, k], n.high[:, k] = np.minimum(n.low[:, k], d[:, nearest == k].min(1)), np.maximum(n.high[:, k], d[:, nearest == k].max(1))

    leaf = tree.route(tree.lifted(m), seen)
    queries = m[::50]
    score, norms = queries @ m.T, (queries * queries).sum(1)
    top = np.sort(score, axis=1)[:, -6]
    near, far = tree.radii(norms, np.minimum(score.max(1), (norms + tree.square) / 2)), tree.radii(norms, top)
    at, to = tree.visits(np.column_stack([queries, np.zeros(len(queries))]), near[:, None], far[:, None])
    visited = set(zip(at.tolist(), to.tolist(), strict=True))
    assert all((q, int(leaf[x])) in visited for q in range(len(queries)) for x in np.flatnonzero(score[q] >= top[q]))
    assert len(visited) < 0.5 * len(queries) * len(set(leaf.tolist()))
