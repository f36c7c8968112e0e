"""Language ID (operator 4).

Bayesian fusion of four kinds of evidence:

- the text: a hashed byte-trigram model; its log likelihoods count as those of at most `most_trigrams` independent
  trigrams, since neighbours in a text are not independent;
- the declared language (of the markup, or of a column): P(declared | language);
- the address suffix: P(suffix | language);
- the host: a prior P(language | host), smoothed by that of its domain, which is smoothed by the overall one.

The last three come from grouped sums of the text posteriors over all rows; each row's own share is
taken out of its host's and domain's sums. The text model is trained on a bounded sample of labelled rows (about SAMPLE rows,
those with the least hash, and of each label about EACH rows or all it has), by grouped counts. All labels are answered; the
model has BUCKETS numbers for each, and more than MOST_LABELS labels are an error, not cut.

A row is rejected if its text has no trigram with a letter, or if no language reaches `min_confidence`.

Defined results: null text counts as empty and is rejected; a null declared language, suffix or host gives no
evidence of that kind; unknown declared values share one class. Repeated rows are each judged (and counted).
Extra columns are ignored. With no labelled rows at all nothing is accepted. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

SAMPLE = 4000
EACH = 60
MOST_LABELS = 500
BUCKETS = 1 << 15
BLOCK = 2 << 20
#: What rows are grouped by for evidence.
GROUPS = ("declared", "suffix", "host", "domain")


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text that begin with a letter or a byte of another script, and their texts."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = C.lowered(data)
    at = np.flatnonzero(((low[:-2] >= 97) & (low[:-2] <= 122)) | (low[:-2] >= 128))
    text = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[text + 1]
    at, text = at[inside], text[inside]
    code = (low[at].astype(np.uint64) << np.uint64(16)) | (low[at + 1].astype(np.uint64) << np.uint64(8)) | low[at + 2]
    return (C.mix(code) % np.uint64(BUCKETS)).astype(np.int64), text


def train(rows: DataFrame, text_col: str, label_col: str, key_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities (language, bucket) of their trigrams, from about `sample` labelled rows; a rare label has about EACH or all of its rows."""
    rows = rows.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    labels = C.materialise(rows.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    n = labels.agg(F.sum("n")).first()[0] or 0
    most = labels.orderBy("label").limit(MOST_LABELS + 1).collect()
    if len(most) > MOST_LABELS:
        raise ValueError(f"{label_col} has more than {MOST_LABELS} labels")
    limits = [F.lit(x) for r in most for x in (r["label"], int((1 << 30) * min(1.0, max(sample / n, EACH / r["n"]))))]
    keep = F.pmod(F.xxhash64(F.lit(4), key_col), F.lit(1 << 30)) < F.try_element_at(F.create_map(*limits), F.col(label_col)) if limits else F.lit(False)

    def count(batches):
        for batch in batches:
            labels = batch.column(0).to_pylist()
            data, offsets = C.text_arrays(batch.column(1))
            for i, j in C.blocks(offsets, BLOCK):
                bucket, text = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names, of = np.unique(np.array(labels[i:j], object).astype(str), return_inverse=True)
                key, n = np.unique(of[text] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[key // BUCKETS].tolist(), pa.string()), pa.array((key % BUCKETS).astype(np.int32)), pa.array(n)], ["lang", "bucket", "n"])

    counted = rows.filter(keep).select(label_col, F.encode(F.col(text_col), "UTF-8").alias("text")).mapInArrow(count, "lang string, bucket int, n long")
    counted = C.materialise(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]  # MOST_LABELS at most
    counts = np.full((len(languages), BUCKETS), 0.1)
    if languages:
        place = {x: i for i, x in enumerate(languages)}
        for r in counted.toLocalIterator():  # a row for each label and bucket of the sample at most
            counts[place[r[0]], r[1]] += r[2]
    return languages, np.log(counts / counts.sum(1, keepdims=True))


def text_posterior(model, most_trigrams: int) -> Column:
    """Function of a binary text column: log likelihoods of the languages, scaled; empty for texts without evidence."""

    def of(column: pa.Array) -> pa.Array:
        table, out = model.value, []
        data, offsets = C.text_arrays(column)
        for i, j in C.blocks(offsets, BLOCK):
            bucket, text = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.bincount(text, minlength=j - i)
            scale = np.minimum(1.0, most_trigrams / np.maximum(n, 1))
            scores = np.stack([np.bincount(text, row[bucket], j - i) * scale for row in table], 1) if len(table) else np.zeros((j - i, 0))
            out += [s.tolist() if k else [] for s, k in zip(scores, n.tolist(), strict=True)]
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(of, "array<double>")


def _matrix(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, n) numbers of a column of lists, 0 where a list is null or empty, and which rows have numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)) > 0
    out = np.zeros((len(column), n))
    out[there] = np.asarray(column.flatten(), np.float64).reshape(-1, n)
    return out, there


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array([x if k else [] for x, k in zip(values.tolist(), there.tolist(), strict=True)], pa.list_(pa.float64()))


def _posterior(n: int) -> Callable:
    """Function of a column of log likelihoods: their posterior under equal priors."""

    def of(column: pa.Array) -> pa.Array:
        scores, there = _matrix(column, n)
        return _lists(_softmax(scores) if n else scores, there)

    return F.arrow_udf(of, "array<double>")


def _fusion(share: list[float], weight: float) -> Callable:
    """Function of scores, p and, for each of GROUPS, the group's sums and size: the posterior with all evidence. A row's own p is taken off its groups."""

    def of(scores: pa.Array, p: pa.Array, *groups: pa.Array) -> pa.Array:
        n, overall = len(share), np.array(share)
        (score, there), (own, judged) = _matrix(scores, n), _matrix(p, n)
        if not n:
            return _lists(score, there)
        sums = {by: np.where((m := _matrix(groups[2 * i], n))[1][:, None], m[0] - own, 0.0) for i, by in enumerate(GROUPS)}
        size = lambda c: np.where(np.asarray(c.is_valid()), np.asarray(pa.compute.fill_null(c, 0), np.float64) - judged, 0.0)
        sizes = {by: size(groups[2 * i + 1])[:, None] for i, by in enumerate(GROUPS)}
        smooth = lambda by, prior: (sums[by] + weight * prior) / (sizes[by] + weight)
        prior = smooth("host", smooth("domain", overall))
        logs = score + np.log(np.maximum(prior, 1e-9))
        for by in ("declared", "suffix"):  # P(value | language) against P(value), with the overall shares as smoothing
            told = smooth(by, overall) / overall
            logs += np.log(told, out=np.zeros_like(told), where=told > 0)
        return _lists(_softmax(logs), there)

    return F.arrow_udf(of, "array<double>")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keys: list[str], text: Column, declared: Column, suffix: Column, host: Column, domain: Column, most_trigrams: int = 200, min_confidence: float = 0.5, weight: float = 5.0) -> DataFrame:
    """The key columns with declared, suffix, host, text_lang, lang (null if rejected), confidence and accepted."""
    spark = rows.sparkSession
    C.small_batches(spark)
    languages, table = model
    score = text_posterior(spark.sparkContext.broadcast(table), most_trigrams)  # MOST_LABELS * BUCKETS numbers at most
    declared = F.regexp_extract(F.lower(declared), "^[a-z]+", 0)
    declared = F.when(declared.isNull() | (declared == ""), None).when(declared.isin(languages), declared).otherwise("other")
    slim = rows.select(*keys, declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain"), score(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("scores"))
    n_languages = len(languages)
    slim = C.materialise(slim.withColumn("p", _posterior(n_languages)("scores")))
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(n_languages)]

    def gather(by: str) -> DataFrame:
        """Counts and sums of posteriors for each value of a column."""
        told = slim.filter(F.col(by).isNotNull() & (F.size("p") > 0))
        g = told.groupBy(F.col(by).alias(f"{by}_key")).agg(F.count(F.lit(1)).alias(f"{by}_n"), *sums)
        return g.select(f"{by}_key", f"{by}_n", F.array(*[f"s{i}" for i in range(n_languages)]).alias(f"{by}_sum"))

    t = slim
    for by in GROUPS:
        g = gather(by)
        t = t.join(g, F.col(by) == F.col(f"{by}_key"), "left")  # slim rows; Spark broadcasts the groups only if they are small
    overall = slim.filter(F.size("p") > 0).agg(F.count(F.lit(1)), *sums).first()
    total = [float(x or 0.0) for x in overall[1:]]
    share = [(x + 1.0) / (overall[0] + n_languages) for x in total]
    fused = _fusion(share, weight)("scores", "p", *[c for by in GROUPS for c in (f"{by}_sum", f"{by}_n")])
    t = t.withColumn("fused", F.when(F.size("scores") > 0, fused))
    names = F.array(*[F.lit(x) for x in languages]).cast("array<string>")
    best = lambda x: F.get(names, F.array_position(x, F.array_max(x)).cast("int") - 1)
    confidence = F.coalesce(F.array_max("fused"), F.lit(0.0))
    accepted = F.coalesce(confidence >= min_confidence, F.lit(False)) & (F.size("scores") > 0)
    return t.select(*keys, "declared", "suffix", "host", best(F.col("p")).alias("text_lang"), F.when(accepted, best(F.col("fused"))).alias("lang"), confidence.alias("confidence"), accepted.alias("accepted"))


def identify_pages(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Web pages: page_id, url, html. The text is the markup without scripts, styles, tags and all that stands in nav, header or footer; where that has no trigram, with these three."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    without = lambda names: F.regexp_replace(F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    main = without("script|style|nav|header|footer")
    told = F.decode(F.encode(main, "UTF-8"), "ISO-8859-1").rlike(r"(?s)[A-Za-z\x80-\xFF]..")  # a character for each byte, as trigrams are of bytes
    text = F.when(told, main).otherwise(without("script|style"))
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#:@]+)", 1))
    host = F.when(host != "", host)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    blank = lambda c: F.when(c != "", c)
    return identify(pages, model, ["page_id"], text, declared, blank(suffix), host, blank(domain))


def accepted_documents(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """documents without the rejected ones, columns unchanged. The lang column is the declared language and source the host."""
    model = model or train(docs, "text", "lang", "doc_id")
    key = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "lang", "source")
    nothing = F.lit(None).cast("string")
    judged = identify(key, model, ["doc_id", "text_hash"], F.col("text"), F.col("lang"), nothing, F.col("source"), nothing)
    gone = judged.filter(~F.col("accepted")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(C.whole_row(docs).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    return rows.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti").select("row.*")


def query(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_pages(C.read(spark, sf_dir, "pages"), train(docs, "text", "lang", "doc_id"))
