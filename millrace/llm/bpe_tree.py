"""BPE encoding and decoding by tree concatenation.

A short text is encoded in place. A long one is halved again and again into leaves; the leaves of all
long texts are spread over the cluster and encoded on their own, wherever the cuts fall. Neighbours
are then joined, pair by pair up the tree: the text around a join is encoded anew in a growing window
until, on either side, the window and the half hold the same token at the same place. From there on
the halves are right: a sequence is the encoding of its text exactly when every two neighbouring
tokens are the encoding of theirs, and each neighbouring pair of the joined sequence stands in one of
the three encodings. If no window agrees, the pair is encoded as a whole.

The tokenizer is a file of the tokenizers library with a lower-casing BPE of word ends. Its merges are
the library's own; splitting into words, the memo of words, leaves, windows and joins are made here.
Text with a code point that Python's tables don't know (a newer one, or none) is normalised and split
into words by the library's own parts, as its tables may differ there.

Null text counts as empty: no tokens, decoded to the empty text. Special tokens' strings inside a text
give their ids, as by the library's default. Repeated rows of one id are each returned. Texts of any
length are encoded whole. Only the id column is kept, so other columns can't clash.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_texts, ship, tool

#: Characters in a leaf; longer texts are halved.
LEAF_CHARS = 16_384
#: Characters on either side of a join in the first window.
FIRST_WINDOW = 32
#: Characters at either end of a leaf for which the places of the tokens are kept.
END_CHARS = 512

# White space of the tokenizer's \s, and its pattern of words.
BLANKS = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def suspects() -> re.Pattern:
    """Code points of the first plane that have no meaning in Python's Unicode tables, and all of the other planes."""
    unknown = [unicodedata.category(chr(c)) == "Cn" for c in range(0x10000)]
    ranges = [f"{chr(c)}-" if a else chr(c - 1) for c, (a, b) in enumerate(zip([*unknown, False], [False, *unknown], strict=True)) if a != b]
    return re.compile(f"[{''.join(ranges)}\U00010000-\U0010ffff]")


class Half(NamedTuple):
    """A stretch of normalised text from byte ``base`` on, its ids, and the bytes where its first and its
    last tokens start (of as many tokens as are listed)."""

    text: str
    base: int
    ids: np.ndarray
    head: np.ndarray
    tail: np.ndarray


class TreeEncoder:
    def __init__(self, path: str, first_window: int = FIRST_WINDOW):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model, self.first_window = tokenizer.model, first_window
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special_split = regex.compile("|".join(map(regex.escape, self.specials)))
        self.letters = dict(enumerate(byte_letters()))
        self.suspects = suspects()
        self.library_normal, self.library_words = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        vocab = tokenizer.get_vocab()
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.sizes = [len(t.removesuffix("</w>")) for t in self.tokens]
        self.memo = Memo(self.chunk_ids)

    # Text to tokens.

    def is_odd(self, text: str) -> bool:
        """Whether a code point in it has no meaning in Python's Unicode tables."""
        if text.isascii() or self.suspects.search(text) is None:
            return False
        return any(unicodedata.category(c) == "Cn" for c in set(self.suspects.findall(text)))

    def places(self, normal: str) -> list[tuple[int, int]]:
        """Start and end of each word of a normalised text."""
        return [place for _, place in self.library_words(normal)] if self.is_odd(normal) else [m.span() for m in WORDS.finditer(normal)]

    def normalise(self, text: str) -> str:
        """NFC and lower case, letter by letter (no final sigma). White space stays: it only separates."""
        if self.is_odd(text):
            return self.library_normal(text)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def word_ids(self, word: str) -> list[int]:
        if not (word.isascii() and word.isprintable()):  # else each byte is its own letter: a word has no blanks
            word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without white space."""
        if chunk.isascii() and chunk.isalpha():  # one word
            return tuple(self.word_ids(chunk))
        if chunk.isascii() and chunk.isprintable() and chunk[:-1].isalpha():  # a word and one mark or digit
            return (*self.memo[chunk[:-1]], *self.memo[chunk[-1]])
        if len(words := WORDS.findall(chunk)) == 1:
            return tuple(self.word_ids(words[0]))
        # the same words stand alone elsewhere
        return tuple(chain.from_iterable([self.memo[word] if word.isalpha() else self.word_ids(word) for word in words]))

    def plain_ids(self, normal: str) -> list[int]:
        """Ids of a normalised text, whole."""
        if self.is_odd(normal):
            return [i for lo, hi in self.places(normal) for i in self.word_ids(normal[lo:hi])]
        chunks = [c for c in BLANKS.split(normal) if c] if SEPARATORS.search(normal) else normal.split()
        return list(chain.from_iterable(map(self.memo.__getitem__, chunks)))

    def spanned(self, normal: str, base: int = 0) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
        """Ids, the byte where each starts (from ``base``), and the words as (first token, end, kind)."""
        ids: list[int] = []
        starts: list[int] = []
        words: list[tuple[int, int, str]] = []
        at, place = 0, base
        odd = self.is_odd(normal)
        for lo, hi in self.places(normal):
            place += len(normal[at:lo].encode())
            at = hi
            first, word = len(ids), normal[lo:hi]
            for i in self.word_ids(word) if odd else self.memo[word]:
                ids.append(i)
                starts.append(place)
                place += self.sizes[i]
            words.append((first, len(ids), "letters" if word.isalpha() else "mark" if word[0] == "'" else "other"))
        return np.array(ids, np.int64), np.array(starts, np.int64), words

    # Tree.

    def leaf(self, text: str, base: int = 0) -> Half:
        """Encode a leaf. Starts are kept for its two ends only, up to a blank behind END_CHARS: what stands
        between blanks is encoded on its own anyway."""
        lo = BLANKS.search(text, END_CHARS)
        hi = max((text.rfind(c, 0, max(0, len(text) - END_CHARS)) for c in " \n\t"), default=-1)
        if lo is None or hi <= lo.start():
            ids, starts, _ = self.spanned(text, base)
            return Half(text, base, ids, starts, starts)
        cut = lo.start()
        head, tail = self.spanned(text[:cut], base), self.spanned(text[hi:], base + len(text[:hi].encode()))
        middle = np.array(self.plain_ids(text[cut:hi]), np.int64)
        return Half(text, base, np.concatenate([head[0], middle, tail[0]]), head[1], tail[1])

    def join(self, left: Half, right: Half) -> Half:
        """The half that two neighbours make."""
        text, cut = left.text + right.text, len(left.text)
        reach = self.first_window
        while reach < max(cut, len(text) - cut):
            if reach > END_CHARS // 2:  # beyond the starts that were kept
                left, right = self.known(left), self.known(right)
            a, b = max(0, cut - reach), min(len(text), cut + reach)
            ids, starts, words = self.spanned(text[a:b], left.base + len(text[:a].encode()))
            head = self._agrees(ids, starts, words, left, True) if a else (0, 0)
            tail = self._agrees(ids, starts, words, right, False) if b < len(text) else (len(ids), len(right.ids))
            if head and tail and head[0] <= tail[0]:
                both = np.concatenate([left.ids[: head[1]], ids[head[0] : tail[0]], right.ids[tail[1] :]])
                after = len(right.ids) - tail[1]
                return Half(text, left.base, both, left.head[: head[1]], right.tail[max(0, len(right.tail) - after) :])
            reach *= 2
        return self.known(Half(text, left.base, None, None, None))

    def known(self, half: Half) -> Half:
        """The half with the starts of all its tokens, encoded as a whole."""
        if half.ids is not None and len(half.head) == len(half.ids):
            return half
        ids, starts, _ = self.spanned(half.text, half.base)
        return Half(half.text, half.base, ids, starts, starts)

    @staticmethod
    def _agrees(ids: np.ndarray, starts: np.ndarray, words: list, side: Half, at_head: bool) -> tuple[int, int] | None:
        """Where window and half hold the same token: (index in window, index in half). The window's head
        is compared with the left half's tail, its tail with the right half's head.

        Cut words at the window's edge count only if they are runs of letters: the words next to a cut
        run of letters are what they are in the whole text, while a cut run of marks can hide a
        contraction. At the tail a run behind a mark is left out too, as it may belong to that mark."""
        if not len(ids):
            return None
        lo, hi = 0, len(ids)
        if at_head:
            if words[0][2] != "letters":
                lo = words[0][1]
        else:
            n = len(words)
            while n and (words[n - 1][2] != "letters" or n > 1 and words[n - 2][2] != "letters"):
                n -= 1
            hi = words[n - 1][1] if n else 0
        own, shift = (side.tail, len(side.ids) - len(side.tail)) if at_head else (side.head, 0)
        order = range(lo + 1, hi) if at_head else range(hi - 2, lo - 1, -1)  # never the token at the cut itself
        for i in order:
            j = int(np.searchsorted(own, starts[i]))
            if j < len(own) and own[j] == starts[i] and side.ids[shift + j] == ids[i]:
                return (i, shift + j)
        return None

    def fold(self, halves: list[Half]) -> np.ndarray:
        """Join neighbouring leaves, then neighbouring pairs, up to the root; its ids."""
        while len(halves) > 1:
            pairs = [halves[k : k + 2] for k in range(0, len(halves), 2)]
            halves = [self.join(*p) if len(p) == 2 else p[0] for p in pairs]
        return halves[0].ids

    def segments(self, text: str) -> list[str | int]:
        """The text as normalised parts and the ids of special tokens between them."""
        if not self.specials or not any(s in text for s in self.specials):
            return [self.normalise(text)]
        out: list[str | int] = []
        at = 0
        for m in self.special_split.finditer(text):
            out += [self.normalise(text[at : m.start()]), self.specials[m.group()]]
            at = m.end()
        return [*out, self.normalise(text[at:])]

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        """The whole of it in one place: what the Spark job does for one text."""
        out: list[int] = []
        for part in self.segments(text):
            if isinstance(part, int):
                out.append(part)
            elif len(part) <= leaf_chars:
                out += self.plain_ids(part)
            else:
                base, leaves = 0, []
                for text_part in halves(part, leaf_chars):
                    leaves.append(self.leaf(text_part, base))
                    base += len(text_part.encode())
                out += self.fold(leaves).tolist()
        return out

    def decode(self, ids) -> str:
        """The file names no decoder: the tokens, joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


def halves(text: str, leaf_chars: int) -> list[str]:
    """Leaves of the tree over ``text``, left to right: 2**d parts of nearly equal length."""
    parts = [text]
    while max(map(len, parts)) > leaf_chars:
        parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
    return parts


def encoder(path: str) -> TreeEncoder:
    return tool(("bpe", path), lambda: TreeEncoder(path))


#: How a leaf's arrays travel.
PACKED = {"ids": np.uint32, "head": np.int64, "tail": np.int64}
_LEAF = "seg int, special int, leaf int, leaf_text string, base long"


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, decoded: bool = True) -> DataFrame:
    """One row per input row: ``id_col``, ``ids array<int>`` and, if asked for, ``decoded string``."""
    schema = "ids array<int>" + ", decoded string" * decoded

    def columns(enc: TreeEncoder, ids: list) -> dict:
        sizes = [len(i) for i in ids]
        flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(sizes))
        out = {"ids": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat)}
        return out | ({"decoded": [enc.decode(i) for i in ids]} if decoded else {})

    def short() -> object:
        enc = encoder(tokenizer_path)

        def run(texts):
            ids = []
            for t in texts:
                ids.append(enc.encode(t or "", leaf_chars))
                enc.memo.trim()
            return columns(enc, ids)

        return run

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("__t"))
    is_long = F.length("__t") > leaf_chars
    here = map_texts(rows.filter(~is_long), short, schema, "__t", [id_col])
    return here.unionByName(_encode_long(rows.filter(is_long), id_col, tokenizer_path, leaf_chars, schema, decoded))


def _encode_long(rows: DataFrame, id_col: str, path: str, leaf_chars: int, schema: str, decoded: bool) -> DataFrame:
    """Cut, spread the leaves, encode each on its own, bring a text's leaves together, join."""
    ship(rows.sparkSession)
    id_type = rows.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                found = []
                for seg, part in enumerate(enc.segments(row[1])):
                    if isinstance(part, int):
                        found.append((seg, part, 0, "", 0))
                        continue
                    base = 0
                    for leaf, piece in enumerate(halves(part, leaf_chars)):
                        found.append((seg, -1, leaf, piece, base))
                        base += len(piece.encode())
                out = pd.DataFrame(found, columns=["seg", "special", "leaf", "leaf_text", "base"])
                out.insert(0, "__key", row[2])
                out.insert(0, id_col, pd.Series([row[0]] * len(out), dtype=pdf[id_col].dtype))
                yield out

    keyed = rows.withColumn("__key", F.sha2(F.col("__t").cast("binary"), 256))
    leaves = keyed.mapInPandas(cut, f"`{id_col}` {id_type}, __key string, {_LEAF}")
    # repeated rows of one id and text give the same leaves: each is encoded once and counted
    spread = leaves.groupBy(id_col, "__key", "seg", "special", "leaf").agg(F.first("leaf_text").alias("leaf_text"), F.first("base").alias("base"), F.count(F.lit(1)).alias("copies"))

    def encode_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            leaves = [enc.leaf(t, b) for t, b in zip(pdf["leaf_text"], pdf["base"], strict=True)]
            enc.memo.trim()
            packed = {name: [getattr(h, name).astype(kind).tobytes() for h in leaves] for name, kind in PACKED.items()}
            yield pdf.assign(**packed)

    encoded = spread.mapInPandas(encode_leaf, f"`{id_col}` {id_type}, __key string, seg int, special int, leaf int, leaf_text string, base long, copies long, ids binary, head binary, tail binary")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        enc, ids = encoder(path), []
        for _, part in pdf.sort_values(["seg", "leaf"]).groupby("seg", sort=True):
            if part["special"].iloc[0] >= 0:
                ids.append(int(part["special"].iloc[0]))
            else:
                unpacked = [[np.frombuffer(x, kind).astype(np.int64) for x in part[name]] for name, kind in PACKED.items()]
                ids += enc.fold(list(map(Half, part["leaf_text"], part["base"], *unpacked))).tolist()
        n = int(pdf["copies"].iloc[0])
        out = pd.DataFrame({"ids": [np.asarray(ids, np.int32)] * n} | ({"decoded": [enc.decode(ids)] * n} if decoded else {}))
        out.insert(0, id_col, pd.Series([pdf[id_col].iloc[0]] * n, dtype=pdf[id_col].dtype))
        return out

    return encoded.groupBy(id_col, "__key").applyInPandas(join, f"`{id_col}` {id_type}, {schema}")


def digest(encoded: DataFrame, id_col: str = "doc_id", more: Sequence[str] = ()) -> DataFrame:
    """n_tokens and the digests of ids and decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), sha(listed).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"), *more)
