"""Toxicity by weak supervision.

Voters are lexicon words, word starts and patterns. A short fixed lexicon and the patterns (its words
spelled out or masked, abusive phrases) are always there; more entries are induced from labelled texts:
words and word starts that toxic texts hold far oftener than others, counted over all labelled texts.
The strongest of some support are voters of their own: of few toxic texts even true ones can't pass a test
against chance, and the label model and the classifier weigh them. Rarer ones, which are many more, must
pass such a test, corrected for the number of entries tried. They and what is beyond the number of voters
vote together, in a voter for each band of strength, so none is left out for number. A voter fires on a text where its
entries are frequent enough. A generative label model then treats the true class as hidden and
estimates, by expectation maximisation over the votes of all texts, how often each voter fires on either
class (its accuracies); given labels take part as one more voter that may err. From the joint firings of
each pair it estimates the voters' correlations, and voters that repeat each other count for less. Its
posteriors are the targets of a linear (logistic) classifier, fitted on a bounded sample, and the
classifier scores every text.

What reaches the driver: the significant entries, counts for each voter and each pair of voters, and
features of at most ``sample_rows`` labelled texts. Entries and votes are counted over all texts. An entry
of less than ``POOL_SHARE`` of the toxic texts is no voter, so there are at most (distinct entries of a
toxic text, on average) / ``POOL_SHARE`` of them whatever the corpus, and at most ``OWN_VOTERS`` vote alone,
which bounds the matrices: both are the same at every size.

Null and empty texts get the score of a text without any entry. Very long texts are read whole. Label
rows without a class, or for unknown ids, teach nothing; an id labelled twice counts as toxic if it once
is; repeated rows each count. Without a toxic and a clean label, the fixed voters alone decide. Other
columns stay, but one named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import remove_tables, written
from .common import Memo, map_texts, release, ship

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 9)
# Common English insults.
LEXICON = (
    "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting garbage filth vermin imbecile retard "
    "bastard bitch asshole whore slut jerk creep freak"
).split()
# Common English abuse of several words.
PHRASES = ("shut up", "go to hell", "drop dead", "kill yourself", "piece of shit", "son of a", "hate you", "you make me sick", "nobody likes you", "waste of space")
PHRASE = {p: re.compile(rf"(?<![^\W_]){p}(?![^\W_])") for p in PHRASES}
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_][ ._*-]){3,}[^\W_](?![^\W_])")
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[*@!$01345]+[^\W\d_]+")
# What every match of the two holds, quick to look for.
SPELLED_SIGN = re.compile(r"[ ._*-][^\W_][ ._*-][^\W_](?![^\W_])")
MASKED_SIGN = re.compile(r"[*@!$01345](?<=[^\W\d_].)[*@!$01345]*[^\W\d_]")
UNMASK = str.maketrans("@!$01345", "aisoieas")
SAMPLE_ROWS = 20_000
#: An entry's toxic share over its clean share at least, and toxic texts that hold it.
LEAST_LIFT, LEAST_TEXTS = 6.0, 3
#: Share of the toxic texts that an entry needs for a voter of its own, and for any; voters of their own at
#: most; bands of lift of the others.
OWN_SHARE, POOL_SHARE, OWN_VOTERS, BANDS = 0.02, 1e-3, 200, (6.0, 20.0, 60.0)
#: The test value (G squared) that a rare entry needs at least, and the share of entries without a bearing on
#: toxicity among those that pass, at most: with many entries it asks for more.
LEAST_TEST, ERROR_RATE, TEST_STEP, TEST_STEPS = 25.0, 0.05, 0.5, 400
ROUNDS = 6
#: Bits of a bit map of Spark's.
BITMAP = 1 << 15


def least_test(n_entries: int, passing: dict[int, int], error_rate: float = ERROR_RATE) -> float:
    """The least test value (one degree of freedom, one side) at which at most ``error_rate`` of the
    passing entries pass by chance (step-up rule of Benjamini and Hochberg), in steps of ``TEST_STEP``.

    ``n_entries``: entries tried; ``passing``: entries for each step."""
    least, passed = math.inf, 0
    for step in sorted(passing, reverse=True):
        passed += passing[step]
        if n_entries * 0.5 * math.erfc(math.sqrt(step * TEST_STEP / 2)) <= error_rate * passed:
            least = step * TEST_STEP
    return least


def entries_of(word: str) -> list[str]:
    """The word itself, and its starts."""
    return ["=" + word, *["^" + word[:k] for k in PREFIXES if k < len(word)]]


def _known(word: str) -> bool:
    """Whether a masked word can be one of the lexicon: letters for signs, or any letter for an asterisk."""
    if "*" not in word:
        return word.translate(UNMASK) in LEXICON
    return any(len(w) == len(word) and all(a in ("*", b) for a, b in zip(word, w, strict=True)) for w in LEXICON)


def patterns_in(lower: str) -> list[str]:
    """Names of the patterns, once for each place in a lower-case text; phrases begin and end with a word."""
    out = [f"~{p}" for p, whole in PHRASE.items() if p in lower for _ in whole.finditer(lower)]
    if SPELLED_SIGN.search(lower):
        out += ["~spelled" for m in SPELLED.finditer(lower) if re.sub(r"[ ._*-]", "", m[0]) in LEXICON]
    if MASKED_SIGN.search(lower):
        out += ["~masked" for m in MASKED.finditer(lower) if _known(m[0])]
    return out


PATTERNS = ("~spelled", "~masked", *[f"~{p}" for p in PHRASES])


@dataclass(frozen=True)
class Voter:
    #: "=word", "^word start", "~pattern", or "+band"
    entry: str
    least_hits: int = 1
    #: hits for each word
    least_rate: float = 0.0
    toxic_rate: float = 2e-3
    clean_rate: float = 1e-5


class Hits:
    """Counts of the voters' entries in a text."""

    def __init__(self, voters: Sequence[Voter], pooled: dict[str, int] | None = None):
        """``pooled``: the rarer entries, each with its voter."""
        place = {v.entry: i for i, v in enumerate(voters)} | (pooled or {})
        self.place = place
        self.memo = Memo(lambda w: tuple({place[e] for e in entries_of(w) if e in place}))

    def count(self, text: str | None) -> tuple[dict[int, int], int]:
        lower = text.lower() if text else ""
        words = WORDS.findall(lower)
        hits = Counter(chain.from_iterable(map(self.memo.__getitem__, words)))
        for name in patterns_in(lower):
            hits[self.place[name]] += 1
        self.memo.trim()
        return hits, len(words)


@dataclass
class Model:
    voters: list[Voter]
    #: the rarer entries, each with its voter
    pooled: dict[str, int]
    #: of the label model: fires on toxic, fires on clean, share of toxic texts, discounts
    accuracies: np.ndarray
    prior: float
    discounts: np.ndarray
    correlations: np.ndarray
    #: of the classifier: bias, then two weights for each voter, then two for the text
    weights: np.ndarray

    def features(self, hits: dict[int, int], n_words: int) -> np.ndarray:
        return features(self.voters, hits, n_words)

    def score(self, hits: dict[int, int], n_words: int) -> float:
        z = self.weights[0] if not hits else float(self.weights @ self.features(hits, n_words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(voters: Sequence[Voter], hits: dict[int, int], n_words: int) -> np.ndarray:
    """1; for each voter its presence and how much likelier its hits are in a toxic text (a Poisson log
    ratio, at least 0); the best and the sum of those ratios."""
    x = np.zeros(1 + 2 * len(voters) + 2)
    x[0] = 1.0
    ratios = []
    for i, n in hits.items():
        v = voters[i]
        ratio = n * math.log(v.toxic_rate / v.clean_rate) - n_words * (v.toxic_rate - v.clean_rate)
        ratios.append(min(10.0, max(0.0, ratio)) / 10)
        x[1 + 2 * i], x[2 + 2 * i] = 1.0, ratios[-1]
    if ratios:
        x[-2], x[-1] = max(ratios), min(3.0, sum(ratios))
    return x


# Voters.


def _classes(labels: DataFrame, id_col: str) -> DataFrame:
    """A row (id, toxic int) for each id with a class."""
    return labels.filter("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")


def _perhaps_labelled(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The texts whose id is in ``classes``, and one in eight of the others: a bit map of the ids' hashes, about one
    byte for a label, is sent to where the texts are. All texts, where the ids are of two types or no whole numbers or strings."""
    kind = texts.schema["id"].dataType
    if kind != classes.schema["id"].dataType or not isinstance(kind, (T.IntegralType, T.StringType)):
        return texts
    places = BITMAP * max(1, math.ceil(8 * classes.count() / BITMAP))
    part, bit = (f(F.pmod(F.xxhash64("id"), F.lit(places))) for f in (F.bitmap_bucket_number, F.bitmap_bit_position))
    marked = classes.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return texts.withColumn("part", part).join(F.broadcast(marked), "part").filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select("id", "text")


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Labelled texts (id, toxic int, text string). Texts and labels are shuffled to meet at any size, so what is
    shuffled grows as the input does; most texts without a label are not."""
    classes = _classes(labels, id_col).filter("id is not null")
    return _perhaps_labelled(_texts(docs, id_col, text_col), classes).join(classes.hint("merge"), "id")


def _entry_counts(labelled: DataFrame) -> DataFrame:
    """For each entry and class: texts that hold it, texts that hold it often, and all its hits. The entry ""
    counts texts and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {"": 0}
        memo = Memo(lambda w: [number.setdefault(e, len(number)) for e in entries_of(w)])
        counts = np.zeros((6, 0), np.int64)  # hits, held, often of clean texts, then of toxic ones
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORDS.findall(text.lower())
                own, n = np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, words)), np.int64), return_counts=True)
                if len(number) > counts.shape[1]:
                    counts = np.pad(counts, ((0, 0), (0, len(number))))
                hits, held, often = counts[3:] if toxic > 0 else counts[:3]
                hits[0] += len(words)
                held[0] += 1
                hits[own] += n
                held[own] += 1
                often[own[(n >= 2) & (n >= 0.004 * len(words))]] += 1
                if len(number) > 300_000:
                    yield from _counted(number, counts)
                    number.clear()
                    memo.clear()
                    number[""] = 0
                    counts = np.zeros((6, 0), np.int64)
        yield from _counted(number, counts)
        release()

    counts = labelled.select("toxic", "text").mapInArrow(run, "entry string, toxic int, hits long, held long, often long")
    return counts.groupBy("entry").agg(*[F.sum(F.when(F.col("toxic") == c, F.col(n)).otherwise(0)).alias(f"{n}_{c}") for n in ("hits", "held", "often") for c in (0, 1)])


def _counted(number: dict[str, int], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = pa.array(list(number), pa.string())
    for toxic, (hits, held, often) in ((0, counts[:3]), (1, counts[3:])):
        used = np.flatnonzero(held)
        columns = {n: pa.array(c[used]) for n, c in (("hits", hits), ("held", held), ("often", often))}
        yield pa.RecordBatch.from_pydict({"entry": names.take(pa.array(used)), "toxic": pa.array(np.full(len(used), toxic, np.int32)), **columns})


def _tested(column: str, n_tox: int, n_clean: int):
    """Columns of the lift and the test value of texts counted in ``column``: toxic against clean texts."""
    t, c = F.col(f"{column}_1"), F.col(f"{column}_0")
    lift = ((t + 0.5) / (n_tox + 1)) / ((c + 0.5) / (n_clean + 1))
    expected = (t + c) * (n_tox / (n_tox + n_clean))
    test = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0.0))
    return F.when(t >= LEAST_TEXTS, lift).otherwise(0.0).alias(f"lift_{column}"), F.when(t >= LEAST_TEXTS, test).otherwise(0.0).alias(f"test_{column}")


def induce_voters(labelled: DataFrame, own_voters: int = OWN_VOTERS) -> tuple[list[Voter], dict[str, int]]:
    """The fixed voters and those of the entries that tell toxic texts; and the rarer entries with their voters."""
    fixed = [Voter(e) for e in (*["=" + w for w in LEXICON], *PATTERNS)]
    counts = written(_entry_counts(labelled), "entries")
    size = counts.filter("entry = ''").first()
    if size is None or not size.held_1 or not size.held_0:
        remove_tables(counts)
        return fixed, {}
    tried = counts.filter(f"entry <> '' and held_0 + held_1 >= {LEAST_TEXTS}")
    tested = tried.select("*", *_tested("held", size.held_1, size.held_0), _tested("often", size.held_1, size.held_0)[0])
    tested = tested.filter(f"held_1 >= {max(LEAST_TEXTS, POOL_SHARE * size.held_1)}")
    step = F.least(F.floor(F.col("test_held") / TEST_STEP), F.lit(TEST_STEPS)).cast("int")
    steps = tested.filter("lift_held > 1").groupBy(step.alias("step")).count().collect()  # TEST_STEPS rows at most
    least = max(LEAST_TEST, least_test(tried.count(), {r.step: r["count"] for r in steps}))
    own = f"held_1 >= {OWN_SHARE * size.held_1} and greatest(lift_held, lift_often) > {LEAST_LIFT}"
    rows = tested.filter(f"{own} or lift_held > {LEAST_LIFT} and test_held > double('{least}')").collect()  # what the voters are made of
    remove_tables(counts)
    words_tox, words_clean = max(1, size.hits_1), max(1, size.hits_0)
    found, together = [], {}  # voters of their own, best first; the rows of those that vote together
    for r in rows:
        rates = max(r.hits_1, 0.5) / words_tox, max(r.hits_0, 0.5) / words_clean
        if r.held_1 < OWN_SHARE * size.held_1:
            together[r.entry] = f"+{sum(r.lift_held > b for b in BANDS) - 1}", r
            continue
        for column, least_hits, least_rate in (("held", 1, 0.0), ("often", 2, 0.004)):
            t, lift = r[f"{column}_1"], r[f"lift_{column}"]
            if lift > LEAST_LIFT:
                band = f"+{sum(lift > b for b in BANDS) - 1}" if least_hits == 1 else "+often"
                found.append(((t + 0.5) / (size.held_1 + 1) * math.log(lift), r.entry, t, Voter(r.entry, least_hits, least_rate, *rates), band, r))
    found.sort(key=lambda f: (-f[0], -len(f[1]), f[1]))
    voters: dict[str, Voter] = {}
    supports: dict[str, int] = {}
    for _, e, support, voter, band, r in found:
        # an entry that covers the texts of one that is there, at its start or end, says nothing new
        if not any(e[1:].startswith(o[1:]) and support <= supports[o] and support > 0.9 * supports[o] or o[1:].startswith(e[1:]) and support < 1.1 * supports[o] for o in voters):
            if e in voters or len(voters) < own_voters:
                voters[e], supports[e] = voter, support
            else:
                together.setdefault(e, (band, r))
    out = [*voters.values(), *[v for v in fixed if v.entry not in voters]]
    pooled: dict[str, int] = {}
    taken = {v.entry for v in out}
    for band in sorted({band for band, _ in together.values()}):
        own = [r for e, (b, r) in together.items() if b == band and e not in taken]
        if own:
            pooled |= {r.entry: len(out) for r in own}
            rates = sum(r.hits_1 for r in own) / words_tox, max(0.5, sum(r.hits_0 for r in own)) / words_clean
            out.append(Voter(band, 2, 0.004, *rates) if band == "+often" else Voter(band, 1, 0.0, *rates))
    return out, pooled


# Label model.


def votes(docs: DataFrame, labels: DataFrame | None, voters: Sequence[Voter], pooled: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """How many texts have each set of firing voters and label: (fired, label, n)."""

    def make():
        hits_of = Hits(voters, pooled)

        def run(texts):
            out = []
            for t in texts:
                hits, n_words = hits_of.count(t)
                out.append(sorted(i for i, n in hits.items() if n >= voters[i].least_hits and n >= voters[i].least_rate * n_words))
            return {"fired": out}

        return run

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # parted before the texts are read, so that each is read once; rows without an id have no label, and no need to meet
    fired, nobody = [map_texts(rows.filter(which), make, "fired array<int>", "text", ["id"]) for which in ("id is not null", "id is null")]
    nobody = nobody.withColumn("label", F.lit(None).cast("int"))
    if labels is not None:
        fired = fired.join(_classes(labels, id_col).withColumnRenamed("toxic", "label"), "id", "left")
    else:
        fired = fired.withColumn("label", F.lit(None).cast("int"))
    return written(fired.unionByName(nobody).groupBy("fired", "label").agg(F.count(F.lit(1)).alias("n")), "toxic-votes")


def _log_odds(a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each voter's firing, and the sum of all silences, discounted."""
    fires, silent = np.log(a[:, 0] / a[:, 1]), np.log((1 - a[:, 0]) / (1 - a[:, 1]))
    return d * (fires - silent), float((d * silent).sum())


def _posterior(fired, label, weights: np.ndarray, rest: float, label_odds: tuple[float, float]):
    """The column of P(toxic | votes and label)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate(fired, F.lit(0.0), lambda acc, j: acc + F.get(w, j)) + rest
    z = z + F.when(label == 1, label_odds[0]).when(label == 0, label_odds[1]).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def label_model(signatures: DataFrame, m: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float, tuple[float, float], np.ndarray, np.ndarray]:
    """Accuracies (voters x [toxic, clean]), share of toxic, log odds of either label, discounts, correlations."""
    a = np.tile([0.2, 0.002], (m, 1))
    prior, discount, correlation = 0.1, np.ones(m), np.eye(m)
    label = (math.log(0.95 / 0.01), math.log(0.05 / 0.99))
    n, p = F.col("n"), F.col("p")
    mass, miss = F.sum(n * p), F.sum(n * (1 - p))
    given = {r.label for r in signatures.filter("label is not null").select("label").distinct().collect()}
    for k in range(rounds):
        if k == 0 and given >= {0, 1}:  # begin with what the labels say
            judged = signatures.filter("label is not null").withColumn("p", F.when(F.col("label") == 1, 0.95).otherwise(0.01))
        else:
            weights, rest = _log_odds(a, discount)
            judged = signatures.withColumn("p", _posterior(F.col("fired"), F.col("label"), weights, rest + math.log(prior / (1 - prior)), label))
        sums = {r.label: (r.t, r.c) for r in judged.groupBy("label").agg(mass.alias("t"), miss.alias("c")).collect()}
        t, c = (sum(v[i] for v in sums.values()) for i in (0, 1))
        if t + c == 0:
            break
        fires = np.zeros((m, 2))
        for r in judged.select(F.explode("fired").alias("j"), "n", "p").groupBy("j").agg(mass.alias("t"), miss.alias("c")).collect():
            fires[r.j] = r.t, r.c
        a = np.clip((fires + [0.2, 0.02]) / (np.array([t, c]) + [2.0, 20.0]), 1e-6, 0.98)
        a[:, 0] = np.maximum(a[:, 0], a[:, 1])  # a voter never speaks for the clean class
        prior = min(0.5, max(1e-4, (t + 1) / (t + c + 10)))
        if k and given >= {0, 1}:
            lt = (sums[1][0] + 1) / (sums[1][0] + sums[0][0] + 2)
            lc = (sums[1][1] + 1) / (sums[1][1] + sums[0][1] + 50)
            lt, lc = min(0.999, max(0.5, lt)), min(0.2, max(1e-3, lc))
            label = (math.log(lt / lc), math.log((1 - lt) / (1 - lc)))
        if k in (0, rounds - 2):  # voters that repeat each other count for less
            two = judged.select(F.explode("fired").alias("i"), "fired", "n", "p").select("i", F.explode("fired").alias("j"), "n", "p")
            both = np.zeros((m, m))
            for r in two.groupBy("i", "j").agg(mass.alias("t")).collect():
                both[r.i, r.j] = r.t
            share = both / max(t, 1e-9)
            spread = np.sqrt(a[:, 0] * (1 - a[:, 0]))
            correlation = np.clip((share - np.outer(a[:, 0], a[:, 0])) / np.outer(spread, spread), -1, 1)
            np.fill_diagonal(correlation, 1.0)
            discount = 1 / np.maximum(1.0, (np.maximum(correlation, 0) ** 2).sum(axis=1))
    return a, prior, label, discount, correlation


# Classifier.


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps on the penalised likelihood; soft targets are welcome."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """``labels``: rows (id, toxic 0/1) that may be learned from. Entries are counted over all labelled texts
    and votes over all of ``docs``; the classifier is fitted on at most ``sample_rows`` labelled texts."""
    ship(docs.sparkSession)
    labels = written(_classes(labels, id_col).withColumnRenamed("id", id_col), "labels")
    labelled = _labelled(docs, labels, id_col, text_col)
    voters, pooled = induce_voters(labelled)
    m = len(voters)
    signatures = votes(docs, labels, voters, pooled, id_col, text_col)
    a, prior, label, discount, correlation = label_model(signatures, m)
    remove_tables(signatures)
    weights, rest = _log_odds(a, discount)
    rest += math.log(prior / (1 - prior))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits_of = Hits(voters, pooled)
        for batch in batches:
            xs, ys = [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits, n_words = hits_of.count(text)
                fired = [i for i, n in hits.items() if n >= voters[i].least_hits and n >= voters[i].least_rate * n_words]
                z = rest + sum(weights[i] for i in fired) + label[0 if toxic else 1]
                x = features(voters, hits, n_words)
                used = np.flatnonzero(x)
                xs.append([{"i": int(i), "v": float(x[i])} for i in used])
                ys.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())]))), pa.array(ys, pa.float64())], ["x", "y"])
        release()

    # ids by a hash, so that the sample does not depend on the order of rows; repeated rows stay within the bound
    chosen = _classes(labels, id_col).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = _texts(docs, id_col, text_col).join(F.broadcast(chosen), "id").select("toxic", "text")  # at most sample_rows ids
    # a limit as the last step would run task after task
    found = sample.mapInArrow(rows, "x array<struct<i:int,v:double>>, y double").limit(sample_rows).filter("y is not null").collect()
    remove_tables(labels)
    model = Model(voters, pooled, a, prior, discount, correlation, np.zeros(1 + 2 * m + 2))
    if sum(r.y > 0.5 for r in found) and sum(r.y < 0.5 for r in found):
        x = np.zeros((len(found), 1 + 2 * m + 2))
        for k, r in enumerate(found):
            for f in r.x:
                x[k, f.i] = f.v
        model.weights = fit_logistic(x, np.array([r.y for r in found]))
    else:
        model.weights[0], model.weights[1::2][:m] = -4.0, 5.0
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add ``out``: the higher, the likelier toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some numbers for each voter, and the significant entries

    def make():
        own, hits_of = sent.value, Hits(sent.value.voters, sent.value.pooled)

        return lambda texts: {out: [own.score(*hits_of.count(t)) for t in texts]}

    return map_texts(docs, make, f"{out} double", text_col, keep)
