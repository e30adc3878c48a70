"""Quality rules from tokenizer fertility.

Each word goes through two public vocabularies, once in a memo's lifetime: a sentencepiece BPE with
byte fallback and a byte-level BPE. A text is then measured by characters per token under both, the
share of tokens that are byte fallbacks, and the entropy of its tokens. Word and line counts beside them
form the base rule: too few words, or mostly repeated three-word windows.

Texts that pass it are held against bands of allowed values. Wide fixed bands by main script catch what no
language does. Narrow ones are fitted to the corpus (:func:`judge_fitted`): quartiles of each measure over all
texts of a language (or script, where the language is not known) and of about the same number of words, since
the measures of short texts vary more; a text further than ``SPREAD`` times the distance of the quartiles
outside of them is rejected. Quartiles are aggregates of bounded size, added up in each task first, and hardly
move with a share of junk below a fourth. A class of fewer than ``LEAST_TEXTS`` texts takes the bands of its
whole language; if that has as few, only the fixed ones hold.

Null and empty text has no word, and fails the base rule. Very long texts and words are measured whole.
Repeated rows are measured, and counted in the bands, each for itself. Extra columns that are kept stay, but
those named like a measure are replaced. An empty table gives no row.
"""

from __future__ import annotations

import base64
import math
import sys
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import Memo, map_texts, tool

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
GROUP_CHARS = 4_000_000
#: Tokens and bytes of words that the tables may hold between groups of texts.
TABLE_TOKENS, TABLE_BYTES = 8_000_000, 32_000_000


@dataclass(frozen=True)
class Band:
    """Allowed values for one script. Entropy is in bits, relative to the most that so many tokens can have."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: By main script; "other" also holds texts without letters. Few characters per token mean noise for
#: the script, many mean one long word again and again; low entropy means repetition.
BANDS = {
    "latin": Band(1.2, 7.0, 0.25, 0.45),
    "greek_cyrillic": Band(0.8, 5.0, 0.35, 0.45),
    "semitic": Band(0.5, 4.0, 0.50, 0.40),
    "indic": Band(0.25, 4.0, 0.90, 0.35),
    "cjk": Band(0.3, 3.0, 0.60, 0.40),
    "other": Band(0.5, 7.0, 0.60, 0.40),
}
#: First code points of the ranges, and the script from there on.
SCRIPTS = [(0x41, "latin"), (0x370, "greek_cyrillic"), (0x530, "other"), (0x590, "semitic"), (0x900, "indic"), (0xE00, "other"), (0x1E00, "latin"), (0x1F00, "greek_cyrillic"), (0x2000, "other"), (0x2E80, "cjk"), (0xA4D0, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"), (0x32000, "other")]


#: In the order of the tables' numbers; "none" is a word without letters.
SCRIPT_NAMES = ["none", *dict.fromkeys(name for _, name in SCRIPTS)]


def script_of(word: str) -> str | None:
    """The script of the first letter."""
    for c in word:
        if c.isalpha():
            found = "other"
            for first, name in SCRIPTS:
                if ord(c) < first:
                    break
                found = name
            return found
    return None


class Fertility:
    def __init__(self, piece_model: str, byte_ranks: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.is_byte = [self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())]
        with open(byte_ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.renew()

    def number(self, word: bytes) -> int:
        """Measure a new word, append it to the tables, and give its row there."""
        text = word.decode()
        self.held += len(word)
        ids = self.pieces.encode(text)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        self.fallbacks.append(sum(map(self.is_byte.__getitem__, ids)))
        self.byte_tokens.append(len(self.bytes.encode_ordinary(" " + text)))
        self.scripts.append(SCRIPT_NAMES.index(script_of(text) or "none"))
        return len(self.scripts) - 1

    def renew(self) -> None:
        """Empty tables and memo. Row 0 is no word."""
        self.memo = Memo(self.number, longest=sys.maxsize)  # equal words have equal numbers, however long
        self.held = 0
        self.flat, self.ends = array("i"), array("q", [0])
        self.fallbacks, self.byte_tokens, self.scripts = array("i", [0]), array("i", [0]), array("b", [0])

    def measure_all(self, texts: list[str | None]) -> list[tuple]:
        """Number all words first, then measure text by text from the tables."""
        split = [(t or "").encode().split() for t in texts]  # of bytes: at ASCII white space only
        numbered = [np.fromiter(map(self.memo.__getitem__, w), np.int64, len(w)) for w in split]
        tables = [np.frombuffer(x, x.typecode) for x in (self.flat, self.ends, self.fallbacks, self.byte_tokens, self.scripts)]
        out = [self.measure(t, w, *tables) for t, w in zip(texts, numbered, strict=True)]
        del tables  # the arrays can't grow while they are viewed
        if len(self.memo) > self.memo.entries or len(self.flat) > TABLE_TOKENS or self.held > TABLE_BYTES:
            self.renew()
        return out

    def measure(self, text: str | None, words: np.ndarray, flat: np.ndarray, ends: np.ndarray, fallbacks: np.ndarray, byte_tokens: np.ndarray, scripts: np.ndarray) -> tuple:
        n = len(words)
        if not n:
            return (0, 0, 0, 0, 0, "other", 0.0, 0.0, 0.0, 0.0)
        chars = len(text) - sum(map(text.count, BLANKS))
        symbols = sum(map(text.count, SYMBOLS))
        lines = [s for s in text.split("\n") if s.strip(BLANKS)]
        sizes = ends[words] - ends[words - 1]
        total = int(sizes.sum())
        places = np.arange(total) + np.repeat(ends[words] - np.cumsum(sizes), sizes)
        seen = np.bincount(flat[places])
        seen = seen[seen > 0]
        entropy = math.log2(total) - float((seen * np.log2(seen)).sum()) / total
        most = math.log2(min(total, len(self.is_byte)))
        by_script = np.bincount(scripts[words], minlength=len(SCRIPT_NAMES))[1:]
        script = SCRIPT_NAMES[1 + int(by_script.argmax())] if by_script.any() else "other"
        return (
            n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words), script,
            chars / total, chars / max(1, int(byte_tokens[words].sum())), int(fallbacks[words].sum()) / total, entropy / most if most else 1.0,
        )

    def columns(self, texts: list[str | None]) -> dict[str, list]:
        rows, group, size = [], [], 0
        for t in texts:  # some megabytes at a time, so that the tables stay small
            group.append(t)
            size += len(t or "")
            if size > GROUP_CHARS:
                rows += self.measure_all(group)
                group, size = [], 0
        rows += self.measure_all(group)
        return dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in NAMES}


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", "chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy_share"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, chars_per_piece double, chars_per_byte_token double, fallback_share double, entropy_share double"


def repeated_words(words: np.ndarray) -> int:
    """Words that stand in a three-word window found twice or more; equal words have equal numbers."""
    n = len(words) - 2
    if n < 2:
        return 0
    bits = 21
    if int(words.max()) >> bits:
        words = np.unique(words, return_inverse=True)[1]
    if int(words.max()) >> bits:  # more words than three of them fit in 63 bits: number the pairs first
        pairs = np.unique(words[:-1] << 32 | words[1:], return_inverse=True)[1]
        window = pairs[:n] << 32 | words[2:]
    else:
        window = words[:n] << 2 * bits | words[1 : n + 1] << bits | words[2:]
    order = np.argsort(window)
    same = np.diff(window[order]) == 0
    again = np.zeros(n, bool)
    again[order[:-1][same]] = again[order[1:][same]] = True
    hit = np.zeros(n + 2, bool)
    for k in range(3):
        hit[k : k + n] |= again
    return int(hit.sum())


def fertility(piece_model: str, byte_ranks: str, pattern: str) -> Fertility:
    return tool(("fertility", piece_model, byte_ranks, pattern), lambda: Fertility(piece_model, byte_ranks, pattern))


def measure(docs: DataFrame, piece_model: str, byte_ranks: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the word counts and the fertility measures."""
    return map_texts(docs, lambda: fertility(piece_model, byte_ranks, pattern).columns, SCHEMA, text_col, keep)


def judge(measured: DataFrame, bands: dict[str, Band] = BANDS, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Add base_failed, the verdict of the fixed bands (in_band), and kept (neither fails)."""

    def inside(b: Band):
        chars = F.col("chars_per_piece").between(b.least_chars, b.most_chars) & F.col("chars_per_byte_token").between(b.least_chars / 2, b.most_chars)
        return chars & (F.col("fallback_share") <= b.most_fallback) & (F.col("entropy_share") >= b.least_entropy)

    verdict = F.lit(False)
    for name, band in bands.items():
        verdict = F.when(F.col("script") == name, inside(band)).otherwise(verdict)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("in_band", verdict).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))


#: Which ends of a measure's band are fitted.
MEASURES = {"chars_per_piece": (True, True), "chars_per_byte_token": (True, True), "fallback_share": (False, True), "entropy_share": (True, False)}
#: Distances of the quartiles that a band reaches beyond them, the least such distance, texts that a band is fitted to
#: at least, and the class of the longest texts (2^11 words and more).
SPREAD, LEAST_DISTANCE, LEAST_TEXTS, LONGEST = 2.0, 0.01, 50, 11


def fitted_bands(judged: DataFrame, group: Column, spread: float = SPREAD) -> DataFrame:
    """Bands of each group and class of size, and of each group as a whole (size null): a written table, with the
    number of texts that each was fitted to. Texts that fail the base rule don't count."""
    sized = judged.filter(~F.col("base_failed")).select(group.alias("group"), size_class().alias("size"), *MEASURES)
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in MEASURES]
    counted = sized.rollup("group", "size").agg(F.count(F.lit(1)).alias("n"), *quartiles).filter("group is not null")

    def band(m: str) -> Column:
        low, high = F.col(m)[0], F.col(m)[1]
        reach = spread * F.greatest(high - low, F.lit(LEAST_DISTANCE))
        return F.struct((low - reach).alias("low"), (high + reach).alias("high")).alias(m)

    return written(counted.select("group", "size", "n", *map(band, MEASURES)), "bands")


def size_class() -> Column:
    return F.least(F.floor(F.log2(F.greatest("n_words", F.lit(1)))), F.lit(LONGEST)).cast("int")


def judge_fitted(measured: DataFrame, group: Column, spread: float = SPREAD, least_texts: int = LEAST_TEXTS, **base) -> DataFrame:
    """As :func:`judge`, with bands fitted to ``measured`` by ``group`` (a name that is not null) as well. The
    measures are written first, since they are read twice."""
    judged = judge(written(measured, "measures"), **base)
    bands = fitted_bands(judged, group, spread).filter(F.col("n") >= least_texts)
    of = lambda name, whole: bands.filter(F.col("size").isNull() == whole).select(F.col("group").alias(f"{name}_group"), F.col("size").alias(f"{name}_size"), F.struct(*MEASURES).alias(name))
    rows = judged.withColumns({"__group": group, "__size": size_class()})
    rows = rows.join(of("__own", False), (F.col("__group") == F.col("__own_group")) & (F.col("__size") == F.col("__own_size")), "left")
    rows = rows.join(of("__all", True), F.col("__group") == F.col("__all_group"), "left").withColumn("__band", F.coalesce("__own", "__all"))
    inside = F.lit(True)
    for m, (low, high) in MEASURES.items():
        inside = inside & (F.col(m) >= F.col(f"__band.{m}.low") if low else F.lit(True)) & (F.col(m) <= F.col(f"__band.{m}.high") if high else F.lit(True))
    in_band = F.col("in_band") & F.coalesce(inside, F.lit(True))
    told = rows.withColumn("in_band", in_band).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
    return told.select(*[F.col(f"`{c}`") for c in judged.columns])
