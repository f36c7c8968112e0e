"""Very long texts, null ids and repeated ids, for operators whose other tests have none."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadlens.llm import ann, exact_dedup, line_dedup, lm_score, packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packing_of_null_and_repeated_ids_and_a_long_text(spark):
    long = " ".join(f"word{i % 977}" for i in range(250_000))  # longer than a block
    assert len(long) > packing.BLOCK
    rows = [(None, "no id here"), (None, None), (3, "one text of this id"), (3, "another text of the same id"), (3, "one text of this id"), (4, long), (5, "")]
    own = Tokenizer.from_file(WORDS)
    ids = [(i, np.array([*own.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")) for i, t in rows]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), WORDS).collect()
    got, want = collections.Counter(), collections.Counter()
    for i, x in ids:
        want[i] += len(x)
    for r in pieces:
        got[r.doc_id] += r.length
        assert any(i == r.doc_id and len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i, x in ids)
    assert got == want
    used = collections.defaultdict(list)
    for r in pieces:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_nearest_of_repeated_ids(spark):
    """A row finds no row of its own id, and candidates that share an id each count. Queries that share an id share a ranking."""
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 8)]) for i in [*range(60), 7, 7, 50, 50]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(20, 50), k=70).collect()
    found = {q: collections.Counter(r.vec_id for r in got if r.query_id == q) for q in (20, 50)}
    assert found[20] == collections.Counter(i for i, _ in rows if i != 20) and found[50][50] == 0 and found[50].total() == 70
    v = collections.defaultdict(list)
    for i, x in rows:
        v[i].append(np.array(x))
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    best = max(cosine(q, x) for q in v[50] for i, xs in v.items() if i != 50 for x in xs)
    assert abs(max(r.score for r in got if r.query_id == 50) - best) < 1e-12


def test_scores_of_a_text_longer_than_a_block(spark):
    words = [f"w{i % 5003}" for i in range(1_500_000)]
    text = " ".join(words)
    assert len(text) > lm_score.BLOCK
    df = spark.createDataFrame([(1, text), (2, "w1 w2 new"), (None, "w1 w2"), (2, "w1")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in lm_score.score_texts(df, F.col("doc_id") == 1).collect())
    assert got == [(0, 3, 3), (1, len(words) + 1, len(words) + 1), (2, 2, 2), (2, 4, 3)]


def test_lines_and_copies_of_very_long_texts(spark):
    line = "a line that stands in many documents"
    long = "\n".join(line if i % 3 == 0 else f"line number {i} of its own" for i in range(150_000))
    rows = [(1, long), (2, line), (3, line + "\nx"), (9, long + "\n"), (4, long), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines): r.n_dropped for r in line_dedup.drop_lines(df).collect() if r.doc_id is not None}
    n = 150_000
    assert got[2, 1] == 1 and got[3, 2] == 1 and got[1, n] == n and got[4, n] == n and got[9, n + 1] == 0  # the largest id keeps its lines
    copies = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    digest = hashlib.sha256(long.encode()).hexdigest()
    assert {x for x in copies if x[4] == digest} == {(1, 4, 3, False, digest), (4, 4, 3, True, digest), (None, 4, 3, False, digest)} and len(copies) == 6
