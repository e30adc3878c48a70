"""Secret scans: fixed patterns, and guess costs of values that stand in a credential's place.

A value behind a word like "password" is cut into the segments that make it cheapest to guess: common
passwords and words (also in leet spelling or capitals; the words and their ranks are those of a public
vocabulary), dates, repeats of a block of any size, keyboard walks, and brute force for what is
left. Between a credential's word and its value any blanks may stand. A repeat costs its block by brute force, and
its number of times; repeats are found by the catchers of :mod:`.periodic_runs`. Dynamic programming finds the cheapest cut of the whole value exactly. The cost is log10 of the guesses; a value
that costs enough is reported as a secret of kind ``guess``. The fixed kinds are always reported.

Null text counts as empty: no spans. Spans are code points, end exclusive, over the whole text, however
long; repeated rows are each scanned. Other columns stay, but one named like the output is replaced.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, tool
from .periodic_runs import Catchers

KINDS = ("assign", "access", "hex", "guess")
#: Kinds of the segments of a value.
SEGMENTS = ("brute", "word", "date", "repeat", "walk")


def _any_case(words: Iterable[str]) -> str:
    """ASCII letters in either case, nothing else."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


ASSIGN = re.compile(f"({_any_case(['password', 'passwd', 'secret', 'token'])}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # a run is matched whole, so this equals: a run, then at least 32 long
CONTEXT_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "credential", "bearer")
CONTEXT = re.compile(f"(?:{_any_case(CONTEXT_WORDS)})[\"']?(?:[\\x20\\t]*(?::=|=>|->|[:=])[\\x20\\t]*|[\\x20\\t]+(?:is|was)[\\x20\\t]+)[\"']?([^\\s\"'<>|,;]{{6,}})")

# Frequent passwords and words, most frequent first.
COMMON = (
    "password qwerty abc letmein monkey dragon baseball football master sunshine iloveyou trustno welcome shadow ashley "
    "michael superman batman jordan harley hunter ranger buster soccer hockey killer george charlie andrew michelle love "
    "jessica pepper daniel access joshua maggie starwars silver william dallas yankees hello amanda orange biteme freedom "
    "computer thunder ginger hammer summer corvette austin merlin diamond golfer cheese princess martin chelsea patrick "
    "richard yellow bigdog secret asdf sparky cowboy camaro matrix falcon iceman tigers purple andrea horny dakota player "
    "morgan starter admin root user login test guest changeme default token api key example pass winter spring autumn"
).split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@83610!57$", "aabegiolsts")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")


def vocabulary_words(byte_ranks: str) -> list[str]:
    """The lower-case words of three letters or more among a vocabulary's pieces that begin a word, most frequent first."""
    with open(byte_ranks, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    return [w.decode() for _, piece in ranked if piece[:1] == b" " and len(w := piece[1:]) >= 3 and w.isalpha() and w.islower()]


class GuessCost:
    def __init__(self, words: Iterable[str] = COMMON):
        self.rank = {}
        for i, w in enumerate(words):
            self.rank.setdefault(w, i + 1)
        self.longest_word = max(map(len, self.rank))
        self.prefixes = {w[:k] for w in self.rank for k in range(3, len(w) + 1)}
        self.place = {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row)}

    @staticmethod
    def alphabet(text: str) -> int:
        size = 10 * any(c.isdigit() for c in text) + 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text)
        return max(10, size + 33 * any(not c.isalnum() for c in text))

    def begun(self, value: str) -> Iterator[list[tuple[int, float, str]]]:
        """For each start in turn, the ends, costs and kinds of single characters, words, dates and repeated blocks."""
        n, low = len(value), self.lowered(value)
        plain = low.translate(LEET)
        each = math.log10(self.alphabet(value))
        runs, live = self.repeats(value), []
        for i in range(n):
            out = [(i + 1, each, "brute")]
            for j in range(i + 3, min(n, i + self.longest_word) + 1):
                begins = False  # a word, in either spelling
                for spelled, more in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                    begins = begins or spelled in self.prefixes
                    if spelled in self.rank:
                        case = 0.0 if value[i:j] == low[i:j] else 0.4 if value[i:j].istitle() or value[i:j].isupper() else 1.0
                        out.append((j, math.log10(self.rank[spelled]) + more + case, "word"))
                        break
                if not begins:
                    break
            if value[i] in "0123456789" and DATE.match(value, i):
                ends = (j for j in range(i + 4, min(n, i + 10) + 1) if DATE.fullmatch(value, i, j))
                out += [(j, 2.1 if j - i == 4 else 4.6, "date") for j in ends]
            while runs and runs[-1][0] == i:
                live.append(runs.pop())
            live = [r for r in live if i + 2 * r[2] <= r[1]]
            for _, end, size in live:  # a block again and again, as often as it comes, or up to three times less: another segment may begin in it
                most = (end - i) // size
                out += [(i + times * size, size * each + math.log10(times), "repeat") for times in range(max(2, most - 3), most + 1)]
            yield out

    @staticmethod
    def repeats(value: str) -> list[tuple[int, int, int]]:
        """(begin, end, size) of the longest stretches that repeat a block of two characters or more, last one first."""
        found = Catchers(4)
        found.append(np.frombuffer(value.encode("utf-32-le"), np.uint32).astype(np.int64))
        return [(begin, begin + length, size) for begin, length, size in reversed(found.finish()) if size > 1]

    @staticmethod
    def lowered(value: str) -> str:
        low = value.lower()
        return low if len(low) == len(value) else value

    def segments(self, value: str) -> list[list[tuple[int, float, str]]]:
        """For each start, the ends, costs and kinds of all segments that begin there: quadratic in long runs."""
        n, low = len(value), self.lowered(value)
        each = math.log10(self.alphabet(value))
        out = list(self.begun(value))
        for i in range(n):
            j = i + 1
            while j < n and value[j] == value[i]:
                j += 1
            if j - i >= 3:
                out[i] += [(k, each + math.log10(k - i), "repeat") for k in range(i + 3, j + 1)]
            j, turns, way = i + 1, 0, None
            while j < n and (step := self.step(low[j - 1], low[j])) is not None:
                turns += way is not None and step != way
                way = step
                j += 1
                if j - i >= 3:
                    out[i].append((j, math.log10(47) + turns * 0.9 + math.log10(j - i), "walk"))
        return out

    def step(self, a: str, b: str) -> tuple[int, int] | None:
        """The direction from key to neighbouring key."""
        if a not in self.place or b not in self.place:
            return None
        (r, k), (s, m) = self.place[a], self.place[b]
        return (s - r, m - k) if (r, k) != (s, m) and abs(s - r) <= 1 and abs(m - k) <= 1 else None

    @staticmethod
    def best(starts: list[tuple[float, int]], end: int) -> tuple[float, int]:
        """The least of cost + log10 of the length over the starts of a run's segments to ``end``. An earlier
        start that is as cheap as a later one stays so for all later ends, so the later one is dropped; so is
        an earlier one that costs as much before the length counts."""
        kept: list[tuple[float, int]] = []
        least = math.inf
        for cost, i in starts:
            while kept and kept[-1][0] >= cost:
                kept.pop()
            if (price := cost + math.log10(end - i)) < least:
                kept.append((cost, i))
                least = price
        starts[:] = kept
        return least, kept[-1][1]

    def cheapest(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """log10 of the guesses, and the cut that needs them. Each further patterned segment costs a factor of 2.
        All of :meth:`segments` take part, but long runs and walks are not listed: they keep the starts that
        can still be the best."""
        n, low = len(value), self.lowered(value)
        cost, came, kinds = array("d", [0.0]) + array("d", [math.inf]) * n, array("q", [0]) * (n + 1), bytearray(n + 1)
        each, walk = math.log10(self.alphabet(value)), math.log10(47)
        run, way_from = 0, 0  # where the run of equal characters, and the walk, up to here begin
        runs: list[tuple[float, int]] = []
        walks: list[tuple[float, int]] = []
        turns, way = array("q", [0]) * n, None  # turns of the walk up to each character

        def reach(j: int, price: float, i: int, kind: str) -> None:
            if price < cost[j]:
                cost[j], came[j], kinds[j] = price, i, SEGMENTS.index(kind)

        for i, begun in enumerate(self.begun(value)):
            if i:
                if value[i] != value[i - 1]:
                    run, runs = i, []
                step = self.step(low[i - 1], low[i])
                if step is None:
                    way_from, walks = i, []
                else:
                    turns[i] = turns[i - 1] + (way is not None and step != way)
                way = step
            k = i - 2  # the last start of a segment of three that ends behind this character
            begins = cost[k] + (0.3 if k else 0.0) if k >= 0 else 0.0
            if k >= run:
                runs.append((begins, k))
                price, at = self.best(runs, i + 1)
                reach(i + 1, price + each, at, "repeat")
            if k >= way_from:
                walks.append((begins - 0.9 * turns[k + 1], k))
                price, at = self.best(walks, i + 1)
                reach(i + 1, price + walk + 0.9 * turns[i], at, "walk")
            for j, price, kind in begun:
                reach(j, price + cost[i] + (0.3 if i and kind != "brute" else 0.0), i, kind)
        cut, j = [], n
        while j:
            cut.append((came[j], j, SEGMENTS[kinds[j]]))
            j = came[j]
        return cost[n], cut[::-1]


class Scanner:
    def __init__(self, least_cost: float = 10.0, words: Iterable[str] = (), price_fixed: bool = True):
        """``words``: further than the common passwords, most frequent first."""
        self.cost, self.least_cost, self.price_fixed = GuessCost([*COMMON, *words]), least_cost, price_fixed

    def price(self, value: str) -> float | None:
        return self.cost.cheapest(value)[0] if self.price_fixed else None

    def scan(self, text: str | None) -> list[tuple[str, int, int, float | None]]:
        """(kind, start, end, cost) by start, then kind; the cost of a fixed kind is that of its value, if it is asked for."""
        if not text:
            return []
        found = []
        lower = text.lower()
        if any(w in lower for w in CONTEXT_WORDS):
            for m in ASSIGN.finditer(text):
                if len(m[2]) >= 8:
                    found.append(("assign", m.start(), m.end(), self.price(m[2])))
            for m in CONTEXT.finditer(text):
                value = m[1].rstrip(".!?)")
                if len(value) >= 6 and (cost := self.cost.cheapest(value)[0]) >= self.least_cost:
                    found.append(("guess", m.start(1), m.start(1) + len(value), cost))
        if "AKIA" in text:
            found += [("access", m.start(), m.end(), self.price(m[0])) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [("hex", m.start(), m.end(), self.price(m[0])) for m in HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    def columns(self, texts: list[str | None]) -> dict[str, list]:
        return {"found": [[{"kind": k, "start": a, "end": b, "log10_guesses": c} for k, a, b, c in self.scan(t)] for t in texts]}


def scanner(least_cost: float, byte_ranks: str | None, price_fixed: bool) -> Scanner:
    words = lambda: vocabulary_words(byte_ranks) if byte_ranks else ()
    return tool(("scanner", least_cost, byte_ranks, price_fixed), lambda: Scanner(least_cost, words(), price_fixed))


SCHEMA = "found array<struct<kind:string,start:int,end:int,log10_guesses:double>>"


def scan_secrets(
    docs: DataFrame, byte_ranks: str | None = None, least_cost: float = 10.0, text_col: str = "text", keep: list[str] | None = None, price_fixed: bool = True
) -> DataFrame:
    """Add ``found``: the spans of each text. ``byte_ranks``: a file of ranked pieces, for the words. Values of the
    fixed kinds have a cost only with ``price_fixed``."""
    return map_texts(docs, lambda: scanner(least_cost, byte_ranks, price_fixed).columns, SCHEMA, text_col, keep)


def span_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    only = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s.kind != "guess")
    return scanned.select(id_col, only("assign"), only("access"), only("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
