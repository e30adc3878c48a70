"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word can be cut into
pieces in many ways; its probability is the sum over all cuts, by the forward algorithm. A text is as
likely as the product over its words, and the likeliest language is predicted.

The probabilities are learned by one step of expectation maximisation: words are counted by language
over all training texts, the expected number of times that each piece is used in a word comes from a
forward and a backward pass under a common first model, and the sums are smoothed. The driver gets a
row for each language and piece, however large the corpus is.

Words are runs of letters (and letter-like numbers) in lower case, of any length: the sums run along the
whole of a word and are scaled on the way, a very long one in slices that hand on the last sums. Null
texts, and texts without a letter, are ``und`` with score 0. Texts without a language are not learned
from; without any training text all texts are ``und``. Repeated rows are each counted and predicted. Of equally
likely languages the first in the model's order is predicted.
Other columns stay, but those named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, ship, tool

WORDS = re.compile(r"[^\W\d_]+")
#: A position's probability is scaled by this, and sums anew after so many positions, to stay within a double's range.
SCALE, RESCALE = 12.0, 24
#: Characters of a word that are taken at once; when learning, with so many more on either side that do not count.
SLICE, MARGIN = 4096, 256
GROUP_CHARS, COUNT_ROWS = 1_000_000, 200_000
#: Numbers (characters by languages) that a sum works on, and that the table of words holds.
CELLS, TABLE_CELLS = 500_000, 8_000_000
UNKNOWN = "und"
#: Bytes of a model, which is sent to every task: pieces by languages.
MODEL_BYTES = 1 << 30
BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Trellis:
    """Arcs of all cuts of many words at once, found with rolling hashes of their substrings."""

    def __init__(self, pieces: Sequence[str]):
        """Piece 0 stands for any single character that is no piece."""
        self.pieces = list(pieces)
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        self.prefixes: list[np.ndarray] = []
        longest = max(map(len, pieces[1:]))
        for k in range(1, longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if i and len(p) == k], np.int64)
            keys = self.hashes([pieces[i] for i in ids], k)
            order = np.argsort(keys)
            self.by_length.append((keys[order], ids[order]))
            self.prefixes.append(np.unique(self.hashes(sorted({p[:k] for p in pieces[1:] if len(p) > k}), k)))
        every = np.concatenate([k for k, _ in self.by_length])
        if len(np.unique(every)) < len(every):
            raise ValueError("two pieces of the vocabulary have one hash")

    @staticmethod
    def hashes(texts: list[str], length: int) -> np.ndarray:
        """Polynomial hashes of texts of one length."""
        codes = np.array([list(map(ord, t)) for t in texts], np.uint64).reshape(len(texts), length)
        out = np.zeros(len(texts), np.uint64)
        for k in range(length):
            out = out * BASE + codes[:, k] + np.uint64(1)
        return out

    @staticmethod
    def among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, or -1."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def arcs(self, marked: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from node, to node, piece) of all arcs, the first node of each word and its length. The words
        have their space marks already. A word of n characters has n + 1 nodes in a row."""
        words = marked
        sizes = np.array([len(w) for w in marked], np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first_char = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(words) else sizes
        first_node = first_char + np.arange(len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(first_char + sizes, sizes) - np.arange(len(codes))  # characters from here to the word's end
        active, value = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, ends, ids = [], [], []
        for k in range(1, len(self.by_length) + 1):
            fits = left[active] >= k
            active, value = active[fits], value[fits]
            if not len(active):
                break
            value = value * BASE + codes[active + k - 1] + np.uint64(1)
            keys, pieces = self.by_length[k - 1]
            at = self.among(keys, value)
            hit = at >= 0
            found = np.where(hit, pieces[at] if len(pieces) else 0, 0)
            if k == 1:
                hit = np.ones(len(active), bool)
            starts.append(active[hit])
            ends.append(active[hit] + k)
            ids.append(found[hit])
            more = self.among(self.prefixes[k - 1], value) >= 0
            active, value = active[more], value[more]
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, ids))
        shift = word[start] if len(start) else start
        return start + shift, end + shift, piece, first_node, sizes

    def forward(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """log probability of each word under each column of ``probs`` (pieces x languages)."""
        out = np.zeros((len(words), probs.shape[1]))
        group, size = [], 0
        for i, w in enumerate(words):
            if len(w) >= SLICE:
                out[i] = self._long("▁" + w, probs)
                continue
            group.append(i)
            size += (len(w) + 2) * probs.shape[1]
            if size > CELLS:
                self._forward(words, group, probs, out)
                group, size = [], 0
        self._forward(words, group, probs, out)
        return out

    def _forward(self, words: list[str], group: list[int], probs: np.ndarray, out: np.ndarray) -> None:
        if group:
            start, end, piece, first, sizes = self.arcs(["▁" + words[i] for i in group])
            alpha, shift = self.run(start, end, piece, first, sizes, probs)
            out[group] = np.log(alpha[first + sizes]) + shift[first + sizes] - (sizes * np.log(SCALE))[:, None]

    def _long(self, marked: str, probs: np.ndarray) -> np.ndarray:
        """The same for one long word, slice by slice: the sums before a slice's first characters are handed on."""
        reach = len(self.by_length)
        before, shift = np.ones((1, probs.shape[1])), np.zeros(probs.shape[1])  # sums at the nodes up to the slice's start
        for at in range(0, len(marked), SLICE):
            lead = len(before) - 1
            part = marked[at - lead : at + SLICE]
            start, end, piece, first, sizes = self.arcs([part])
            fresh = end > lead
            alpha, moved = self.run(start[fresh], end[fresh], piece[fresh], first, sizes, probs, before)
            tail = alpha[-reach:] if len(part) >= reach else alpha
            before = tail / tail[-1] * np.exp(moved[-len(tail) :] - moved[-1])  # all by the last one
            shift = shift + moved[-1] + np.log(tail[-1])
        return shift - len(marked) * np.log(SCALE)

    def run(self, start, end, piece, first, sizes, probs, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums at every node, and the logs of their scales: probabilities are scaled by SCALE for each
        character, sums by their word's last sum every RESCALE characters. ``before``: the sums at the first
        nodes, which are then given."""
        nodes = int(first[-1] + sizes[-1] + 1) if len(first) else 0
        alpha, shift = np.zeros((nodes, probs.shape[1])), np.zeros((nodes, probs.shape[1]))
        given = 1
        if before is None:
            alpha[first] = 1.0
        else:
            given = len(before)
            alpha[:given] = before
        depth = np.arange(nodes) - np.repeat(first, sizes + 1)
        weight = probs[piece] * (SCALE ** (end - start))[:, None]
        order = np.lexsort((end, depth[end]))
        start, end, weight = start[order], end[order], weight[order]
        longest = int(sizes.max(initial=0))
        cuts = np.searchsorted(depth[end], np.arange(1, longest + 2))
        reach, scale = len(self.by_length), np.zeros((len(first), probs.shape[1]))
        for d, lo, hi in zip(range(1, longest + 1), cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                into = np.flatnonzero(np.r_[True, np.diff(end[lo:hi]) > 0])
                alpha[end[lo:hi][into]] = np.add.reduceat(alpha[start[lo:hi]] * weight[lo:hi], into, axis=0)
            if longest > RESCALE and d >= given:
                going = np.flatnonzero(sizes >= d)
                at = first[going] + d
                shift[at] = scale[going]
                if d % RESCALE == 0:
                    by = alpha[at]
                    scale[going] += np.log(by)
                    for back in range(min(reach, d + 1)):  # the sums that later ones are made of
                        alpha[at - back] /= by
                        shift[at - back] = scale[going]
        return alpha, shift

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (pieces x languages) in words of these counts (words x languages),
        under one model ``probs`` (pieces)."""
        out = np.zeros((len(self.pieces), counts.shape[1]))
        group: list[str] = []
        owner: list[int] = []
        core: list[tuple[int, int]] = []  # the positions whose pieces count
        size = 0

        def flush() -> None:
            nonlocal size
            if group:
                out.__iadd__(self._expected(group, counts[owner], probs, np.array(core)))
            for x in (group, owner, core):
                x.clear()
            size = 0

        for i, w in enumerate(words):
            marked = "▁" + w
            for at in range(0, len(marked), SLICE):
                lo, hi = max(0, at - MARGIN), min(len(marked), at + SLICE + MARGIN)
                group.append(marked[lo:hi])
                owner.append(i)
                core.append((at - lo, min(len(marked), at + SLICE) - lo))
                size += hi - lo + 1
                if size > CELLS // 8:
                    flush()
        flush()
        return out

    def _expected(self, marked: list[str], counts: np.ndarray, probs: np.ndarray, core: np.ndarray) -> np.ndarray:
        start, end, piece, first, sizes = self.arcs(marked)
        alpha, up = (x[:, 0] for x in self.run(start, end, piece, first, sizes, probs[:, None]))
        # backward: the same sums over the mirrored nodes
        nodes = len(alpha)
        mirror = np.repeat(2 * first + sizes, sizes + 1) - np.arange(nodes)
        beta, down = (x[:, 0][mirror] for x in self.run(mirror[end], mirror[start], piece, first, sizes, probs[:, None]))
        word = np.repeat(np.arange(len(marked)), sizes + 1)[start]
        last = (first + sizes)[word]
        inside = (start - first[word] >= core[word, 0]) & (start - first[word] < core[word, 1])
        share = inside * alpha[start] * probs[piece] * SCALE ** (end - start) * beta[end] / alpha[last] * np.exp(up[start] + down[end] - up[last])
        return np.stack([np.bincount(piece, share * counts[word, k], minlength=len(self.pieces)) for k in range(counts.shape[1])], axis=1)


def vocabulary(model_path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of letters in lower case, and a first probability for each that falls with its rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, weights = [""], [1e-4]
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and p == p.lower():
            body = p.removeprefix("▁")
            if not body or WORDS.fullmatch(body):
                pieces.append(p)
                weights.append(1 / (i + 100))
    probs = np.array(weights)
    return pieces, probs / probs.sum()


def trellis(model_path: str) -> tuple[Trellis, np.ndarray]:
    def make():
        pieces, probs = vocabulary(model_path)
        return Trellis(pieces), probs

    return tool(("trellis", model_path), make)


class Model:
    def __init__(self, languages: list[str], probs: np.ndarray):
        """``probs``: pieces x languages."""
        self.languages, self.probs = languages, probs


def learn(docs: DataFrame, model_path: str, lang_col: str = "lang", text_col: str = "text", smoothing: float = 0.05) -> Model:
    """Learn from all rows that have a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, first = trellis(model_path)
        seen: dict[str, dict[str, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def flush() -> None:
            if not seen:
                return
            words = sorted(set().union(*seen.values()))
            place = {w: i for i, w in enumerate(words)}
            counts = np.zeros((len(words), len(seen)))
            for k, own in enumerate(seen.values()):
                counts[np.fromiter(map(place.__getitem__, own), np.int64, len(own)), k] = np.fromiter(own.values(), float, len(own))
            part = lattice.expected(words, counts, first)
            for k, lang in enumerate(seen):
                sums[lang] = sums.get(lang, 0.0) + part[:, k]
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lang, {})
                for w in letters(text):
                    own[w] = own.get(w, 0) + 1
                if sum(map(len, seen.values())) > COUNT_ROWS:
                    flush()
        flush()
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "piece": pa.array(used, pa.int32()), "uses": pa.array(total[used], pa.float64())})

    ship(docs.sparkSession)
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counted = texts.mapInArrow(count, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    rows = counted.toPandas()  # a row for each language and piece
    languages = sorted(rows["lang"].unique())
    pieces, first = vocabulary(model_path)
    if 8 * len(pieces) * len(languages) > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages: their model has over {MODEL_BYTES} bytes")
    uses = np.zeros((len(pieces), len(languages)))
    uses[rows["piece"].to_numpy(), rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = rows["uses"].to_numpy()
    # a little of the first model keeps every piece possible
    probs = uses / np.maximum(uses.sum(axis=0), 1e-9) * (1 - smoothing) + smoothing * first[:, None]
    return Model(languages, probs)


class Predictor:
    def __init__(self, lattice: Trellis, model: Model):
        self.lattice, self.model = lattice, model
        self.renew()

    def renew(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0  # characters
        self.logs = np.zeros((0, len(self.model.languages)))

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        labels, scores, group, size = [], [], [], 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size > GROUP_CHARS:
                self._group(group, labels, scores)
                group, size = [], 0
        self._group(group, labels, scores)
        return {"lang_pred": labels, "score": scores}

    def _group(self, texts: list[str | None], labels: list[str], scores: list[float]) -> None:
        if len(self.number) * (20 + len(self.model.languages)) > TABLE_CELLS or self.held > 8 * TABLE_CELLS:
            self.renew()
        number, known = self.number, len(self.number)
        rows = []
        for t in texts:
            words = letters(t) if t else []
            if words and any(w[0].isalpha() or any(map(str.isalpha, w)) for w in words):
                rows.append(np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words)))
            else:
                rows.append(None)
        fresh = list(number)[known:] if len(number) > known else []
        if fresh and self.model.languages:
            self.held += sum(map(len, fresh))
            self.logs = np.concatenate([self.logs, self.lattice.forward(fresh, self.model.probs)])
        for own in rows:
            if own is None or not self.model.languages:
                labels.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.logs[own].sum(axis=0)
            best = int(total.argmax())
            labels.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))


def predict(docs: DataFrame, model: Model, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score, the posterior of the predicted language (all equally likely before)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, bounded in learn()

    def make():
        return Predictor(trellis(model_path)[0], sent.value).predict

    return map_texts(docs, make, "lang_pred string, score double", text_col, keep)
