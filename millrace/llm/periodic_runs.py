"""Periodic runs of words, found online by dyadic square catching.

A run is a stretch of words with a smallest period q (words q apart are equal) of at least
``max(min_words, 2 * q)`` words that no neighbouring word extends. Words are the maximal parts without
``[ \\t-\\r]``.

Words are appended; every completed block of 2^k words that begins at a multiple of 2^k becomes a
catcher. A square of period q holds two equal stretches q apart; each of them is long enough to hold a
whole aligned block of one size that depends on q only. So the catcher of a block waits for its own
content to come again at the distances that its size serves: it compares the hash of the block with that
of each suffix of the block's length, as the words come. What it catches is extended in both directions by
comparing words. A stretch that reaches the last word stays open and is advanced by the words appended
next; one that ends is a run if it is long enough. Equal stretches of words found with several periods are
one run, of the smallest period. Words come in pieces, so that numpy advances many suffixes at a time; the
result is the same for any pieces, single words included. Hashes only propose, words decide.

Catchers of a size are kept only as long as their distances ask for, so memory is linear in the words of a
text and time is about ``n log n``, whatever the text repeats.

Null and empty texts have no word and no run, and collapse to an empty text. Very long texts and words are
taken whole. Repeated rows each get the same result. A text of one word over and over is one run of period
1. Extra columns stay, but those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts
from .order_minhash import ODD, mix

MIN_WORDS = 12
#: Words that are appended at a time, and catchers that are looked at one by one (more are compared at once).
PIECE, FEW = 1 << 16, 8
#: Distinct words, and bytes of words, that a worker numbers before it starts afresh.
MOST_WORDS, MOST_BYTES = 400_000, 64 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # of bytes: splits at [ \t-\r] and nothing else


def shifts(block: int, least: int) -> list[tuple[int, int]]:
    """Ranges of periods that blocks of this size serve. Equal stretches of a square of period q have
    ``max(q, least - q)`` words at least, and hold an aligned block if they have ``2 * block - 1``."""
    low, high, half = 2 * block - 1, 4 * block - 2, -(-least // 2)
    up = (max(low, half), high)
    down = (max(1, least - high), min(half - 1, least - low))
    return [(lo, hi) for lo, hi in (down, up) if lo <= hi]


class Catchers:
    """Squares of a growing sequence of numbers; :meth:`finish` gives its runs."""

    def __init__(self, least: int = MIN_WORDS):
        self.least = max(2, least)
        self.seq, self.n = np.empty(256, np.int64), 0
        self.windows: list[np.ndarray] = []  # by size: hashes of the last windows of 2^k words
        self.blocks: list[np.ndarray] = []  # by size: hashes of the blocks that still catch
        self.first: list[int] = []  # number of the first of those blocks
        self.open: dict[int, int] = {}  # period: begin of an equal stretch that reaches the last word
        self.runs: dict[tuple[int, int], int] = {}  # (begin, end): smallest period

    def append(self, words: np.ndarray) -> None:
        for at in range(0, len(words), PIECE):
            self._append(words[at : at + PIECE])

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of what was appended, by start, then period."""
        for q, begin in self.open.items():
            self._settle(q, begin, self.n - q)
        return sorted((begin, end - begin, q) for (begin, end), q in self.runs.items())

    def _settle(self, q: int, begin: int, end: int) -> bool:
        """``begin:end`` equals the words q later and cannot be extended: is it a run?"""
        if not self._is_run(q, begin, end):
            return False
        key = begin, end + q
        self.runs[key] = min(q, self.runs.get(key, q))
        return True

    def _is_run(self, q: int, begin: int, end: int) -> bool:
        return end - begin >= q and end + q - begin >= self.least

    def _append(self, words: np.ndarray) -> None:
        old, n = self.n, self.n + len(words)
        if n > len(self.seq):
            self.seq = np.concatenate([self.seq[:old], np.empty(max(n, 2 * old) - old, np.int64)])
        self.seq[old:n] = words
        self.n = n
        periods: list[tuple[int, int, int]] = []  # (begin, end, period) of runs that reach into the new words
        ends: dict[int, int] = {}  # period: end of its last equal stretch
        for q, begin in list(self.open.items()):
            end = old - q + self._ahead(old - q, old)
            ends[q] = end
            if end + q < n:
                del self.open[q]
                self._settle(q, begin, end)
            if self._is_run(q, begin, end):
                periods.append((begin, end + q, q))
        level, block = 0, 1
        while block <= n:
            at, fresh = self._suffixes(level, block, old, n)
            for lo, hi in shifts(block, self.least):
                if lo + block <= n:
                    self._examine(*self._caught(level, block, at, fresh, lo, hi), block, periods, ends)
            level, block = level + 1, 2 * block
        for k in range(level):  # what later words no longer need
            block = 1 << k
            self.windows[k] = self.windows[k][-block:]
            reach = n - block + 1 - max(4 * block - 2, self.least)  # the first word whose block still catches
            passed = -(-reach // block) - self.first[k]
            if passed > 0:
                self.blocks[k], self.first[k] = self.blocks[k][passed:], self.first[k] + passed

    def _suffixes(self, level: int, block: int, old: int, n: int) -> tuple[int, np.ndarray]:
        """Hashes of the windows of ``block`` words that the new words complete, and where the first begins."""
        at = max(0, old - block + 1)
        if not level:
            fresh = mix((self.seq[old:n].astype(np.uint64) + np.uint64(1)) * ODD)
        else:
            half, halves = block // 2, self.windows[level - 1]
            skip = len(halves) - (n - half + 1 - at)  # windows of half the size that begin before ``at``
            left = halves[skip : skip + n - block + 1 - at]
            fresh = mix(left * ODD + halves[skip + half : skip + half + len(left)])
        if level == len(self.windows):
            self.windows.append(fresh)
            self.blocks.append(np.empty(0, np.uint64))
            self.first.append(0)
        else:
            self.windows[level] = np.concatenate([self.windows[level], fresh])
        done = -at % block  # the first new window that is an aligned block
        self.blocks[level] = np.concatenate([self.blocks[level], fresh[done::block]])
        return at, fresh

    def _caught(self, level: int, block: int, at: int, fresh: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin of a block, distance) of new windows equal to a block lo to hi words before them. Of
        neighbouring blocks with one distance only the first is given: their stretch is the same."""
        first, blocks = self.first[level], self.blocks[level]
        one, last = max(first, -((hi - at) // block)), (at + len(fresh) - 1 - lo) // block
        last = min(last, first + len(blocks) - 1)
        if last - one < FEW:
            begins, found = [], []
            for m in range(one, last + 1):
                a, z = max(at, m * block + lo), min(at + len(fresh), m * block + hi + 1)
                here = np.flatnonzero(fresh[a - at : z - at] == blocks[m - first]) + (a - m * block) if a < z else np.empty(0, np.int64)
                begins.append(np.full(len(here), m * block))
                found.append(here)
            return (np.concatenate(begins), np.concatenate(found)) if found else (np.empty(0, np.int64),) * 2
        line = np.zeros((last - one) * block + hi - lo + 1, np.uint64)
        start = one * block + lo  # place of line[0]; outside the new windows nothing is caught
        a, z = max(at, start), min(at + len(fresh), start + len(line))
        line[a - start : z - start] = fresh[a - at : z - at]
        same = sliding_window_view(line, hi - lo + 1)[::block] == blocks[one - first : last + 1 - first, None]
        heads = same.copy()
        heads[1:] &= ~same[:-1]
        row, shift = np.nonzero(heads)
        return (row + one) * block, shift + lo

    def _examine(self, begins: np.ndarray, distances: np.ndarray, block: int, periods: list[tuple[int, int, int]], ends: dict[int, int]) -> None:
        """Extend what was caught; what lies in a run of a period that divides its own is that run again."""
        if not len(begins):
            return
        order = np.lexsort((begins, distances))
        begins, distances = begins[order], distances[order]
        left = np.ones(len(begins), bool)

        def inside(run: tuple[int, int, int]) -> np.ndarray:
            return (begins >= run[0]) & (begins + distances + block <= run[1]) & (distances % run[2] == 0)

        for run in periods:
            left &= ~inside(run)
        at = 0
        while True:
            more = np.flatnonzero(left[at:])
            if not len(more):
                return
            for k in (more + at).tolist():
                at, i, q = k + 1, int(begins[k]), int(distances[k])
                if i < ends.get(q, 0):
                    continue
                ahead = block + self._ahead(i + block, i + block + q) if (self.seq[i : i + block] == self.seq[i + q : i + q + block]).all() else 0
                if not ahead:  # equal hashes of other words
                    continue
                begin, end = i - self._back(i, i + q), i + ahead
                ends[q] = end
                if end + q == self.n:
                    self.open[q] = begin
                elif not self._settle(q, begin, end):
                    continue
                if self._is_run(q, begin, end):
                    periods.append((begin, end + q, q))
                    left &= ~inside(periods[-1])
                    break

    def _ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, up to the last word."""
        done, step = 0, 16
        while (size := min(step, self.n - j - done)) > 0:
            differs = self.seq[i + done : i + done + size] != self.seq[j + done : j + done + size]
            k = int(differs.argmax())
            if differs[k]:
                return done + k
            done, step = done + size, min(2 * step, PIECE)
        return done

    def _back(self, i: int, j: int) -> int:
        """How many words before i equal those before j."""
        done, step = 0, 16
        while (size := min(step, i - done)) > 0:
            differs = (self.seq[i - done - size : i - done] != self.seq[j - done - size : j - done])[::-1]
            k = int(differs.argmax())
            if differs[k]:
                return done + k
            done, step = done + size, min(2 * step, PIECE)
        return done


class Numbers(dict):
    """Words to numbers, the same for equal words until :meth:`renew`."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.size += len(word)
        return number

    def renew(self) -> None:
        if len(self) > MOST_WORDS or self.size > MOST_BYTES:
            self.clear()
            self.size = 0


class Finder:
    def __init__(self, least: int):
        self.least, self.numbers = least, Numbers()

    def runs(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        if len(words) < self.least:
            return []
        catchers, numbered = Catchers(self.least), map(self.numbers.__getitem__, words)
        for at in range(0, len(words), PIECE):
            catchers.append(np.fromiter(islice(numbered, PIECE), np.int64, min(PIECE, len(words) - at)))
        self.numbers.renew()
        return catchers.finish()

    @staticmethod
    def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
        """The words without those that lie in a run after its first period."""
        if not runs:
            return b" ".join(words).decode()
        steps = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]).decode()

    def columns(self, texts: list[str | None]) -> dict[str, Sequence]:
        sizes, found, kept = [], [], []
        for text in texts:
            words = words_of(text)
            runs = self.runs(words)
            sizes.append(len(words))
            found.append([dict(zip(("start", "length", "period"), run, strict=True)) for run in runs])
            kept.append(self.collapsed(words, runs))
        return {"n_words": sizes, "runs": found, "collapsed": kept}


def find_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length and period of each, by start, then period) and ``collapsed``, the
    words that stay, joined by one blank."""
    schema = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_texts(docs, lambda: Finder(min_words).columns, schema, text_col, keep)


def run_digest(found: DataFrame) -> DataFrame:
    """The longest run of each row and digests of all runs and of the collapsed text, in place of them."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    told = found.withColumns({"_longest": longest, "runs_sha256": digest(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))), "collapsed_sha256": digest(F.col("collapsed"))})
    return told.select(
        *[F.col(f"`{c}`") for c in found.columns if c not in ("n_words", "runs", "collapsed")], F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"), F.col("_longest.length").alias("length"), (-F.col("_longest.period")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def looped(doc_id: Column, text: Column) -> Column:
    """The text, but of every document whose crc32(id) is divisible by 10 and that has words: its words with a
    stretch that repeats up to the end (from word a on, the p words that stand there), joined by blanks."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        chosen = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(chosen, " ")).otherwise(text)

    # the words are bound as a lambda's variable, so that a text is split once
    split = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.when(h % 10 == 0, F.element_at(F.transform(split, repeat), 1)).otherwise(text)
