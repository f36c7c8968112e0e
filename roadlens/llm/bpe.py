"""BPE encoding and decoding by a prefix-sharing trie (operator 12).

Distinct words go into a trie, in order, so that it grows depth first. Each node holds the last token of its prefix's encoding.
As a byte-pair encoding never merges across a place where it ends up with a cut, the encoding of a prefix is that of a
shorter prefix and one more token, and exactly one token does: the one that ends the prefix and stays apart from the shorter prefix's
last token when the two are encoded together. So a node's state follows from the states above it, shared prefixes are encoded once, and
a word's tokens are read backwards from its end. An end-of-word suffix makes a word's last byte a symbol of its own.

Texts are cut as in operator 7, and different pieces are kept in its bounded table. Pieces of ASCII letters, digits or marks are words as they
stand; others pass the file's own normaliser and pre-tokeniser, as Unicode rules are theirs. Strings of special tokens give their ids. Nothing is shuffled.

Defined results: null text counts as empty and has no tokens. A null doc_id, repeated ids and extra columns have no influence.
A text of any length is encoded whole. An empty table gives an empty result. Files with a merge dropout, an unknown token,
byte fallback or special tokens that strip white space are refused.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C
from roadlens.llm import packing

#: Nodes of the trie, and pairs of tokens known to stay apart or not, that a Python worker keeps at most.
NODES, PAIRS = 1 << 20, 1 << 20
BLOCK = 1 << 20
CODED = "doc_id long, ids binary, text string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for their own byte, the others' bytes follow from U+0100 on."""
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    rest = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


class Trie:
    """Last-token states of prefixes. A symbol is a byte, or 256 + byte at the end of a word."""

    def __init__(self, model: dict):
        of, end = byte_of_char(), model.get("end_of_word_suffix") or ""
        if model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-level BPE models are supported")
        self.closed = bool(end)
        self.symbols: dict[int, tuple[int, ...]] = {}
        for token, i in model["vocab"].items():
            last = bool(end) and token.endswith(end)
            text = token[: -len(end)] if last else token
            if text and all(c in of for c in text):
                own = [of[c] for c in text]
                self.symbols[i] = (*own[:-1], own[-1] + 256) if last else tuple(own)
        self.ids = {s: i for i, s in self.symbols.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        vocab = model["vocab"]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        prefixes = {s[:n] for s in self.ids for n in range(len(s) + 1)}
        self.prefixes = {s for s in prefixes if not s or s[-1] < 256}
        self.states, self.contexts, self.moves, self.found = {(): 0}, [()], {}, {}
        self.apart: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.context = [-1], [0]

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Tokens of a few symbols by merging the pair of the least rank, the leftmost first."""
        tokens = [self.ids[(s,)] for s in symbols]
        while len(tokens) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            tokens[i : i + 2] = [self.ranks[tokens[i], tokens[i + 1]][1]]
        return tokens

    def stay_apart(self, before: int, token: int) -> bool:
        """Whether the two tokens (or the second alone, if there is none before) are their own encoding."""
        key = (before + 1) << 32 | token
        if (known := self.apart.get(key)) is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            alone = before < 0
            known = self.apart[key] = self.merged(self.symbols[token] if alone else self.symbols[before] + self.symbols[token]) == ([token] if alone else [before, token])
        return known

    def move(self, state: int, symbol: int) -> int:
        """The longest end of a prefix with which some token begins, after one more symbol; the tokens that end there are noted, the longest first."""
        text = (*self.contexts[state], symbol)
        self.found[state << 9 | symbol] = [(self.ids[text[n:]], len(text) - n) for n in range(len(text)) if text[n:] in self.ids]
        while text not in self.prefixes:
            text = text[1:]
        to = self.states.setdefault(text, len(self.contexts))
        if to == len(self.contexts):
            self.contexts.append(text)
        self.moves[state << 9 | symbol] = to
        return to

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The tokens of distinct words, which are inserted in order, so that new nodes are met depth first."""
        if len(self.last) > NODES:
            self.forget()
        child, last, context, moves, found, apart = self.child, self.last, self.context, self.moves, self.found, self.apart
        out, path, lasts, before = {}, [0], [-1], b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(before[:-1] if self.closed else before, word[:-1] if self.closed else word, strict=False):  # a word's end is no prefix of another word
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :], lasts[shared + 1 :]
            node = path[shared]
            for depth in range(shared, len(word)):
                symbol = word[depth] + 256 if self.closed and depth == len(word) - 1 else word[depth]
                there = child.get(node << 9 | symbol)
                if there is None:
                    key = context[node] << 9 | symbol
                    to = moves[key] if key in moves else self.move(context[node], symbol)
                    for token, size in found[key]:
                        known = apart.get((lasts[depth + 1 - size] + 1) << 32 | token)
                        if self.stay_apart(lasts[depth + 1 - size], token) if known is None else known:
                            break
                    else:
                        raise ValueError("the vocabulary lacks a byte")
                    there = child[node << 9 | symbol] = len(last)
                    last.append(token)
                    context.append(to)
                node = there
                path.append(node)
                lasts.append(last[node])
            tokens, depth = [], len(word)
            while depth:
                tokens.append(lasts[depth])
                depth -= len(self.symbols[lasts[depth]])
            out[word] = tokens[::-1]
            before = word
        return out


class TrieEncoder(packing.Encoder):
    """The pieces of operator 7, encoded by the trie."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.trie = Trie(model["model"])
        self.of = byte_of_char()
        added = model["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens must be plain strings")
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.special = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        names = {i: t for t, i in model["model"]["vocab"].items()} | {t["id"]: t["content"] for t in added}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self._forget()

    def words(self, piece: bytes) -> list[bytes]:
        text = piece.decode(errors="replace")
        if max(text) < "ƀ":
            plain = unicodedata.normalize("NFC", text).lower()
            if plain.isalpha():
                return [plain.encode()]
        return [bytes(map(self.of.__getitem__, word)) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def _encode(self, pieces: list[bytes], glued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [self.words(p) if g else [p] for p, g in zip(pieces, glued.tolist(), strict=True)]
        tokens = self.trie.encode(list({w for ws in words for w in ws}))
        found = [[t for w in ws for t in tokens[w]] for ws in words]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum())), np.cumsum(sizes, dtype=np.int64) - sizes, sizes

    def whole(self, text: bytes) -> np.ndarray:
        """A text that holds strings of special tokens: what stands between them is encoded by itself."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.added[m[0]]], np.int32)]
            at = m.end()
        return np.concatenate([*out, self.plain(text[at:])])

    def plain(self, text: bytes) -> np.ndarray:
        return self.texts(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))[0]

    def documents(self, data: np.ndarray, offsets: np.ndarray):
        """The ids of each text."""
        return (ids[:-1] for ids in super().documents(data, offsets))

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens' texts as the file's decoder joins them; without one, spaces go between them."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


@functools.cache
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def _each(path: str, row):
    """row(encoder, ids of a text) gives what follows the id."""

    def each(batches):
        for batch in batches:
            data, offsets = C.text_arrays(batch.column(1))
            for i, j in C.blocks(offsets, BLOCK):
                ids = encoder(path).documents(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = [row(encoder(path), x) for x in ids]
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", *[f"c{k}" for k in range(len(columns))]])

    return each


def _coded(e: TrieEncoder, ids: np.ndarray) -> tuple:
    return ids.astype("<u4").tobytes(), e.decode(ids).decode()


def _digests(e: TrieEncoder, ids: np.ndarray) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()


def _run(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, row, schema: str) -> DataFrame:
    C.small_batches(docs.sparkSession)
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    names = [f"c{k}" for k in range(schema.count(","))]
    raw = t.mapInArrow(_each(tokenizer, row), ", ".join(f"{n} {c.split()[1]}" for n, c in zip(["doc_id", *names], schema.split(", "), strict=True)))
    return raw.toDF(*[c.split()[0] for c in schema.split(", ")])


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), text (the ids decoded) for each row."""
    return _run(docs, tokenizer, id_col, text_col, _coded, CODED)


def query(spark, sf_dir):
    import public_tokenizers

    return _run(C.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", _digests, DIGESTS)
