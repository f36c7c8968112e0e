"""URL filters (operator 9).

Host rules decide first: the longest rule that fits wins. Other urls are judged by a weighted vocabulary: one
Aho-Corasick automaton in each Python worker finds all terms of a whole batch of lower-cased urls in one pass; a term
counts only between characters that are no ASCII letters or digits; one strict term blocks, and so do different
soft ones whose weights reach `soft_limit` together. Nothing is shuffled: each url is judged alone, so skewed hosts don't matter.

The vocabulary is a dict of terms with weights, 0 for strict ones. vocabulary_of() takes it from a table of
at most MOST_TERMS terms; a larger one is an error.

Defined results: a null url, or one without ://, has empty host and path, fits no rule, and a null or empty url
holds no term (allow). Repeated pages are judged each. Extra columns of pages are ignored. Urls of any length are
read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

STRICT = "casino pill porn porno pornstar xxx sex viagra cialis spam malware phishing warez escort camgirl hentai milf nude keygen torrent botnet ransomware trojan spyware adware scam jackpot roulette blackjack baccarat sportsbook steroid tramadol xanax crackz hookup stripper fetish".split()
SOFT = "free bet cheap win winner ad track tracker adult poker bonus loan payday deal promo click utm_source utm_medium utm_campaign dating farm slot gambling lottery lotto credit debt discount coupon sale offer affiliate referral sponsor popup banner subscribe giveaway prize reward cash money earn rich investment forex crypto bitcoin token airdrop pharmacy pharma drug diet weight pharmacyonline replica rolex luxury outlet wholesale download crack serial patch hack cheat mod apk stream proxy vpn mirror redirect clickid gclid fbclid sessionid cart checkout login signin verify account secure update confirm password wallet".split()
HEAVY = "gambling payday lottery airdrop replica crack clickid".split()
SOFT_LIMIT = 2.0
MOST_TERMS = 100_000
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def default_vocabulary() -> dict[str, float]:
    """The words above and their plurals: strict ones at 0, soft ones at 1, heavy ones at 1.5."""
    plural = lambda words: [*words, *[w + ("es" if w[-1] in "sxz" or w[-2:] == "ch" else "s") for w in words]]
    return dict.fromkeys(plural(SOFT), 1.0) | dict.fromkeys(plural(HEAVY), 1.5) | dict.fromkeys(plural(STRICT), 0.0)


def vocabulary_of(terms: DataFrame) -> dict[str, float]:
    """A vocabulary from the columns term and weight (0: strict)."""
    rows = terms.select("term", "weight").filter("term <> ''").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r["term"].lower(): float(r["weight"] or 0.0) for r in rows}


@functools.cache
def _automaton(vocabulary: tuple[tuple[str, float], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (term, _) in enumerate(vocabulary):
        a.add_word(term, i)
    a.make_automaton()
    return a, np.array([len(t) for t, _ in vocabulary]), np.array([w for _, w in vocabulary])


def hits(urls: list[str], vocabulary: tuple[tuple[str, float], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Number of strict terms and weight of the different soft terms of each lower-cased url."""
    automaton, length, weight = _automaton(vocabulary)
    strict, soft = np.zeros(len(urls), np.int32), np.zeros(len(urls))
    text = "\n" + "\n".join(urls) + "\n"
    found = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
    if not len(found):
        return strict, soft
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = ((code | 32) >= 97) & ((code | 32) <= 122) | (code >= 48) & (code <= 57)
    end, term = found[:, 0], found[:, 1]
    alone = ~word[end + 1] & ~word[end - length[term]]
    end, term = end[alone], term[alone]
    starts = np.append(0, np.cumsum([len(u) + 1 for u in urls]))
    url = np.searchsorted(starts, end, "left") - 1
    np.add.at(strict, url[weight[term] == 0], 1)
    pairs = np.unique(np.stack([url, term], 1)[weight[term] > 0], axis=0)
    np.add.at(soft, pairs[:, 0], weight[pairs[:, 1]])
    return strict, soft


def count_terms(url: Column, vocabulary: dict[str, float]) -> Column:
    """Struct of strict (all hits) and soft (weight of the different terms) for each lower-cased url; null: no hits."""
    terms = tuple(vocabulary.items())
    kind = pa.struct([("strict", pa.int32()), ("soft", pa.float64())])

    def count(urls: pa.Array) -> pa.Array:
        # a line feed inside a url is no letter or digit either, and must not look like its end
        strict, soft = hits([(u or "").replace("\n", " ") for u in urls.to_pylist()], terms)
        return pa.StructArray.from_arrays([pa.array(strict), pa.array(soft)], fields=list(kind))

    return F.arrow_udf(count, "strict int, soft double")(url)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: dict[str, float] | None = None, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict and the counts of terms."""
    vocabulary = default_vocabulary() if vocabulary is None else vocabulary
    t = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    t = t.withColumn("rest", F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(""))
    t = t.withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0)).withColumn("host", C.lower_ascii(F.col("raw_host")))
    t = t.withColumn("path", F.regexp_extract(F.expr("substring(rest, char_length(raw_host) + 1)"), r"^[^?#]*", 0))
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits.append((((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path), rule, verdict))
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, name, verdict in reversed(fits):
        rule, by_rule = F.when(fit, F.lit(name)).otherwise(rule), F.when(fit, F.lit(verdict)).otherwise(by_rule)
    t = t.withColumn("terms", count_terms(C.lower_ascii(F.col("url")), vocabulary))
    by_terms = F.when((F.col("terms.strict") >= 1) | (F.col("terms.soft") >= soft_limit), "block").otherwise("allow")
    return t.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_terms).alias("verdict"), "terms")


def query(spark, sf_dir):
    return judge_urls(C.read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    has = lambda term: f"regexp_matches({low}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    vocabulary = default_vocabulary()
    strict = has("(" + "|".join(t for t, w in vocabulary.items() if not w) + ")")
    soft = " + ".join(f"CAST({has(t)} AS INT) * {w}" for t, w in vocabulary.items() if w)
    fits = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')", rule, verdict))
    case = lambda i: " ".join(f"WHEN {x[0]} THEN '{x[i]}'" for x in fits)
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
SELECT page_id, host, path, CASE {case(1)} END AS rule,
       CASE {case(2)} WHEN {strict} OR ({soft}) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


SQL = _sql()
