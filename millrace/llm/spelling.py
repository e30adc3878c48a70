"""Spelling variants by blocked Gram matrices of letter counts.

Two words are near if one inserted, deleted or replaced code point makes them equal. Their letter counts
then differ by a squared distance of at most two: one for a letter more, two for another letter. Words
are compared in blocks of two adjacent lengths: in each, numpy products of the matrices of letter counts
give all squared distances (|x|^2 + |y|^2 - 2xy), pairs at most two apart are kept, and edits are verified.

A block of a length alone would hold far too many words, so it is cut by letters. The alphabet is dealt into
four groups; an edit touches letters of two groups at most, so near words have equal counts in two others
at least. Each word is in a block for each pair of groups and for its length and the one below it, and
meets there the words with the same counts of the letters of those groups. Work is then linear in the
words but for the sizes of such blocks. A block of more than ``TILE`` words is cut further, into tiles of
words, and each pair of tiles is a task of its own; so a block of any size is compared whole, and no task
holds more than two tiles. A pair that meets in several blocks is kept in the first only.

A word's form is its near word of largest count (ties: the smallest in code-point order), if that count
is at least ``RATIO`` times its own. Its root is the last word that following forms leads to; counts grow
on the way, so there is an end. Chains are followed by doubling: in each round a word learns where
its present target leads.

Words are counted over all documents; what a task counts is added up before it is shuffled. Null and empty
texts have no words. Very long texts and words are taken whole (a word's code points outside the given
letters count as one more letter). Repeated rows count each time. Words without near words keep their
row. Extra columns don't matter. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove_tables, written
from .common import release, ship
from .order_minhash import ODD, mix

#: Code points of words: A-Z, a-z and U+00C0 to U+00FF.
WORD = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Words in a tile of a large block, words that are compared with a tile at a time, and pairs that are verified at a time.
TILE, STRIP, VERIFIED = 2_048, 512, 1 << 16
#: Letters in the order in which they are dealt into groups: common ones first, so that all groups get some.
LETTERS = "etaoinsrhldcumfpgwybvkxjqzéèàçäöüßáíóúñê"
GROUPS = 4
PAIRS = list(combinations(range(GROUPS), 2))
BITS = 1 << np.arange(GROUPS)
#: By touched groups, as bits: the first pair of groups that an edit in them leaves as it was.
FIRST = np.array([next((k for k, p in enumerate(PAIRS) if not any(bits >> g & 1 for g in p)), -1) for bits in range(1 << GROUPS)])


def _columns() -> np.ndarray:
    """Column of each code point of a Latin text in a count matrix; the last one is for all others."""
    at = {ord(c): k for k, c in enumerate(LETTERS)}
    for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]:
        at.setdefault(c, len(at))
    return np.array([at.get(c, len(at)) for c in range(256)])


COLUMN = _columns()
WIDTH = int(COLUMN.max()) + 1
GROUP = np.arange(WIDTH) % GROUPS
WEIGHTS = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * ODD)


def counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    column = COLUMN[np.minimum(codes, 255)]
    column[codes > 255] = WIDTH - 1
    row = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(row * WIDTH + column, minlength=len(words) * WIDTH).reshape(len(words), WIDTH)


def group_keys(counted: np.ndarray) -> np.ndarray:
    """Per word and group of letters: 64 bits that tell the counts of those letters."""
    folded = counted.astype(np.uint64) * WEIGHTS
    return np.stack([folded[:, GROUP == g].sum(axis=1, dtype=np.uint64) for g in range(GROUPS)], axis=1)


def block_keys(words: list[str]) -> np.ndarray:
    """Per word: a key for each pair of groups, in the blocks of its own length (first half) and of the one
    below (second half). Equal counts and lengths have equal keys; other words seldom."""
    group = group_keys(counts(words))
    size = np.array([len(w) for w in words], np.uint64)
    keys = []
    for length in (size, size - np.uint64(1)):
        for k, (g, h) in enumerate(PAIRS):
            keys.append(mix(mix(group[:, g] * ODD + group[:, h]) * ODD + length * np.uint64(len(PAIRS)) + np.uint64(k)))
    return np.stack(keys, axis=1)


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: exactly one inserted, deleted or replaced code point; rows of ``b`` are as long or longer by one."""
    n = a.shape[1]
    if n == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.minimum.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


class Blocks:
    """Whole blocks, or pairs of tiles of blocks, row by row: their words are rows of one matrix of letter counts."""

    def __init__(self, pairs: np.ndarray, words: list[str], longer: np.ndarray):
        self.pairs, self.words, self.longer = pairs, words, longer
        self.size = np.array([len(w) for w in words], np.int64)
        exact = self.size.max(initial=0) < 2_000  # so that sums of squares are exact in single precision
        counted = counts(words)
        self.groups = group_keys(counted)
        self.counts = counted.astype(np.float32 if exact else np.float64)
        self.norm = (self.counts * self.counts).sum(axis=1)
        self.other = self.counts[:, -1] > 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0
        self.near: list[tuple[int, int]] = []

    def compare(self, left: slice, right: slice) -> None:
        """All pairs of two stretches of rows of one block. Pairs of the same letters are near only if they have
        code points outside the letters."""
        least = -1 if self.other[left].any() and self.other[right].any() else 0.5
        for at in range(left.start, left.stop, STRIP):
            rows = slice(at, min(at + STRIP, left.stop))
            apart = self.norm[rows, None] + self.norm[None, right] - 2 * (self.counts[rows] @ self.counts[right].T)
            i, j = np.nonzero((apart > least) & (apart < 2.5))
            if len(i):
                self.waiting.append((i + at, j + right.start))
                self.n_waiting += len(i)
                if self.n_waiting > VERIFIED:
                    self.verify()

    def verify(self) -> None:
        """Of the pairs found so far, keep those of one edit, each once in its block, in the first block that they share."""
        if not self.waiting:
            return
        i, j = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        kept = (self.longer[j] | (i < j)) & (self.size[j] == self.size[i] + self.longer[j])
        i, j = i[kept], j[kept]
        for at in range(0, len(i), VERIFIED):
            a, b = i[at : at + VERIFIED], j[at : at + VERIFIED]
            touched = self.groups[a] != self.groups[b]
            first = FIRST[touched @ BITS] == self.pairs[a]
            a, b = a[first], b[first]
            lengths = self.size[a] * 2 + self.longer[b]
            for length in np.unique(lengths):
                x, y = a[lengths == length], b[lengths == length]
                step = max(1, (VERIFIED << 4) // int(length))
                for k in range(0, len(x), step):
                    p, q = x[k : k + step], y[k : k + step]
                    edit = one_edit(codes([self.words[m] for m in p.tolist()]), codes([self.words[m] for m in q.tolist()]))
                    self.near += zip(p[edit].tolist(), q[edit].tolist(), strict=True)


def near_in_blocks(pairs: np.ndarray, own: np.ndarray, cuts: list[int], words: list[str], longer: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Near pairs of rows. ``cuts`` are the bounds of blocks; in a block, shorter words come first, and of
    those of a length the first tile's. A whole block is ``own``; else two tiles of it meet."""
    blocks = Blocks(pairs, words, longer)
    shorts = np.concatenate([[0], np.cumsum(~longer)])
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        mid = lo + int(shorts[hi] - shorts[lo])
        if hi - lo < 2 or mid == lo:
            continue
        if own[lo]:
            blocks.compare(slice(lo, mid), slice(lo, hi))
        else:
            a, b = lo + int((~second[lo:mid]).sum()), mid + int((~second[mid:hi]).sum())
            for left, right in ((slice(lo, a), slice(a, mid)), (slice(lo, a), slice(b, hi)), (slice(a, mid), slice(mid, b))):
                if left.start < left.stop and right.start < right.stop:
                    blocks.compare(left, right)
    blocks.verify()
    return blocks.near


def blocked(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each word and block that it is in: key, pair, the two tiles, word, n, longer, second."""
    fields = pa.schema([("key", pa.int64()), ("pair", pa.int8()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = batch.column(0).to_pylist(), 2 * len(PAIRS)
            if not words:
                continue
            keys = block_keys(words).view(np.int64).ravel()
            pair = np.tile(np.arange(times) % len(PAIRS), len(words)).astype(np.int8)
            row = pa.array(np.repeat(np.arange(len(words)), times))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(pair), pa.array(np.tile(np.arange(times) >= len(PAIRS), len(words))), batch.column(0).take(row), batch.column(1).take(row)], schema=fields)
        release()

    rows = written(vocabulary.select("word", "n").mapInArrow(cut, "key long, pair byte, longer boolean, word string, n long"), "blocks")
    sizes = written(rows.groupBy("key", "pair").agg(F.count(F.lit(1)).alias("size"), F.min("longer").alias("alone")).filter("size > 1 and not alone").select("key", "pair", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "block-sizes")
    one = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("second"))
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j"), (t < own).alias("second")))
    met = rows.join(sizes, ["key", "pair"]).withColumn("t", F.explode(F.when(F.col("tiles") == 1, F.array(one)).otherwise(tiles)))
    out = met.select("key", "pair", "t.i", "t.j", "word", "n", "longer", "t.second")
    out._spare = [rows, sizes]
    return out


def near_words(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """Near pairs (a, n_a, b, n_b) of a vocabulary (word, n), each once; a written table."""
    ship(vocabulary.sparkSession)
    rows = blocked(vocabulary, tile)
    fields = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(b: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
            pairs, i, j, longer, second = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 6, 7))
            found = near_in_blocks(pairs, i == j, cuts, b.column(4).to_pylist(), longer, second)
            x, y = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([b.column(4).take(x), b.column(5).take(x), b.column(4).take(y), b.column(5).take(y)], schema=fields)

        left: pa.RecordBatch | None = None  # the last block, which may go on in the next batch
        for b in batches:
            b = pa.concat_batches([left, b]) if left is not None else b
            if b.num_rows:
                keys = [b.column(k).to_numpy() for k in range(4)]
                cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()]
                yield near(b.slice(0, cuts[-1]), cuts)
                left = b.slice(cuts[-1])
        if left is not None:
            yield near(left, [0, left.num_rows])
        release()

    order = ("key", "pair", "i", "j")
    met = rows.repartition(*order).sortWithinPartitions(*order, "longer", "second")
    pairs = written(met.mapInArrow(compare, "a string, n_a long, b string, n_b long"), "near-words")
    remove_tables(*rows._spare)
    return pairs


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words (column ``word``) that are long and frequent enough, with their count n."""
    long = words.filter(F.char_length("word") >= min_chars)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def words_of(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each run of letters with ``min_chars`` code points at least, A-Z in lower case."""
    long = f"{WORD}{{{min_chars},}}+"  # maximal runs, as the quantifier is possessive; shorter ones never become rows
    runs = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(long), F.lit(0))).alias("run")
    return docs.select(*keep, runs).select(*keep, F.translate("run", UPPER, LOWER).alias("word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) with forms of all words that have one, to (word, root); a written table."""
    to = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(to.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove_tables(to)
        moved = not longer.filter("moved").isEmpty()
        to = longer.select("word", "root")
        to._written_to = longer._written_to
        if not moved:
            return to


def variants(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """From a row for each occurrence of a word: each word of the vocabulary with its form and root, counts
    of itself and of its form, and the number of its near words. Reads tables in the shared folder."""
    known = written(vocabulary(words, min_chars, min_count), "vocabulary")
    pairs = near_words(known, tile)
    either = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionAll(pairs.select("b", "a", "n_a"))
    best = either.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = known.join(best, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    rooted = roots(told.filter("form is not null"))
    remove_tables(known, pairs)
    return told.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def slips(words: DataFrame, doc_id: str, every: int = 199) -> DataFrame:
    """The words, but without one code point wherever crc32 of ``<doc_id>:<word>`` is divisible by ``every``: the
    one at that number modulo the word's length. A null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    word, at = F.col("word"), F.pmod(h, F.char_length("word")).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return words.select(F.when(h % every == 0, cut).otherwise(word).alias("word"))
