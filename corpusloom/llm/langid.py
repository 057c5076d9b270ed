"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a model of the characters of its words: an n-gram never crosses a word, words stand
between boundary marks, and only letters count, in lower case. The models of all languages share, for
each order, one sorted array of 64-bit n-gram hashes; beside it lie, for each language, the discounted
probability of the n-gram and the weight with which its next shorter context backs off. A text's
language is the one whose model gives the lowest cross-entropy per character. The lowest order is
interpolated with a uniform distribution over the characters of all languages and one class for all
others, so every model is a distribution over the same characters and cross-entropies compare.

Rejection is calibrated on labelled texts that the models have not seen: a text is rejected when its best
cross-entropy is over `mean + reach * sqrt(a + b / n)` for its n characters. a and b are fitted to the
calibration texts' deviations, so short texts get a wider bound; reach is twice the 99th percentile of
their deviations in those units, so a single odd text does not move it.

Cases: a null text, or one without letters (Unicode L, with marks M inside words), gets `und`, score 0, rejected.
Texts of any length are scored whole, word by word. Ties go to the language that sorts first. Repeated
rows are scored alike and count once in the sample. Without any labelled row every text gets `und`. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LETTERS = regex.compile(r"[\p{L}\p{M}]*\p{L}[\p{L}\p{M}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_EDGE = 1
_CACHE = 400_000


def _code(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words one after another, each word between marks, and each character's place in its word."""
    marked = "\x01".join(["", *words, ""]) if words else ""
    # every word needs a mark of its own on both sides: a shared mark would let contexts see the word before
    joined = marked.replace("\x01", "\x01\x01")[1:-1] if words else ""
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(points == _EDGE)[::2]
    place = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    return points, place


def _hashes(points: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the hash of the n characters that end at each place; 0 where the word has fewer before."""
    with np.errstate(over="ignore"):
        grown, out, power = np.zeros(len(points), np.uint64), [], np.uint64(1)
        for n in range(1, order + 1):
            back = np.zeros(len(points), np.uint64)
            back[n - 1 :] = points[: len(points) - n + 1]
            grown = grown + (back + np.uint64(7)) * power
            power = power * _BASE
            mixed = (grown ^ (grown >> np.uint64(29))) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(32))) | np.uint64(1)
            out.append(np.where(place >= n - 1, mixed, np.uint64(0)))
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of the sorted keys that hold what is wanted; len(keys) where none does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


@dataclass
class Models:
    """keys[n-1]: sorted hashes of n-grams; prob[n-1], back[n-1]: one row a key and a last row for none, one column a language.

    base: each language's probability of one character by the uniform share of its lowest order.
    """

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    prob: list[np.ndarray]
    back: list[np.ndarray]
    base: np.ndarray
    sharpness: float = 1.0
    #: mean cross-entropy of calibration texts, variance of long texts, variance times characters, reach
    bound: tuple[float, float, float, float] | None = None

    def char_logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of each character and end mark of the words (one row each, one column a language), and its place in its word."""
        points, place = _code(words)
        hashes = _hashes(points, place, self.order)
        p, before = None, None
        for n in range(1, self.order + 1):
            row = _find(self.keys[n - 1], hashes[n - 1])
            if n == 1:
                p = self.prob[0][row] + self.base
            else:
                context = np.empty(len(points), np.int64)
                context[:1], context[1:] = len(self.keys[n - 2]), before[:-1]
                p = np.where((place >= n - 1)[:, None], self.prob[n - 1][row] + self.back[n - 2][context] * p, p)
            before = row
        return np.log(p), place

    def word_logs(self, words: list[str]) -> np.ndarray:
        """For each word: the sum of log-probabilities of its characters and its end under each language, and their number."""
        logs, place = self.char_logs(words)
        counted = place > 0
        word = np.cumsum(place == 0) - 1
        out = np.zeros((len(words), len(self.languages) + 1))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word[counted], logs[counted, k], len(words))
        out[:, -1] = np.bincount(word[counted], minlength=len(words))
        return out

    def rejects(self, rate: float, n: float) -> bool:
        """Whether a text of n characters with this lowest cross-entropy lies outside what calibration has seen."""
        if self.bound is None:
            return False
        mean, long, short, reach = self.bound
        return rate > mean + reach * float(np.sqrt(long + short / n))


def fit(rows: list[tuple[str, str]], order: int = 4, discount: float = 0.75, calibrate: int = 5) -> Models:
    """Fits models on (text, language) rows; every `calibrate`-th row of a language only calibrates score and rejection (all do where no language has as many)."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Models([], order, [], [], [], np.zeros(0))
    words: list[Counter] = [Counter() for _ in languages]
    kept: list[tuple[str, str]] = []
    for k, lang in enumerate(languages):
        own = [t for t, x in rows if x == lang]
        # every language trains on one text at least
        late = set(range(calibrate - 1, len(own), calibrate)) if len(own) > 1 else set()
        kept += [(own[i], lang) for i in sorted(late)]
        for i, text in enumerate(own):
            if i not in late:
                words[k].update(_LETTERS.findall(text.lower()))
    kept = kept or rows
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for counts in words:
        points, place = _code(list(counts))
        weight = np.repeat(np.array(list(counts.values()), np.float64), np.array([len(w) + 2 for w in counts], np.int64)) if counts else np.zeros(0)
        hashes = _hashes(points, place, order)
        below = None
        for n in range(order, 0, -1):
            real = (place >= n - 1) & (place > 0)
            grams, first, inverse = np.unique(hashes[n - 1][real], return_index=True, return_inverse=True)
            raw = np.bincount(inverse, weight[real], len(grams))
            if below is None:
                count = raw
            else:
                # continuation counts: how many distinct longer n-grams end with this one; at a word's start the counts themselves
                count = np.zeros(len(grams))
                np.add.at(count, np.searchsorted(grams, below), 1.0)
                at_start = place[real][first] == n - 1
                count = np.where(at_start, raw, np.maximum(count, 1.0))
            ends = np.flatnonzero(real)[first]
            context = hashes[n - 2][ends - 1] if n > 1 else np.zeros(len(grams), np.uint64)
            found[n - 1].append((grams, count, context))
            below = hashes[n - 2][ends] if n > 1 else None  # each distinct n-gram's last n-1 characters
    keys = [np.unique(np.concatenate([f[0] for f in found[n]])) for n in range(order)]
    # a context may be a mark alone, which no character's n-gram ends with
    mark = _hashes(np.array([_EDGE], np.uint64), np.array([0]), 1)[0]
    keys[0] = np.union1d(keys[0], mark)
    prob = [np.zeros((len(k) + 1, len(languages))) for k in keys]
    back = [np.zeros((len(k) + 1, len(languages))) for k in keys]
    # characters of all languages and the end mark, and one class for every other character
    size = len(np.unique(np.concatenate([f[0] for f in found[0]]))) + 1
    base = np.full(len(languages), 1.0 / size)
    for n in range(order):
        if n:
            back[n - 1][:, :] = 1.0
        for k, (grams, count, context) in enumerate(found[n]):
            _, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, count)[inverse] if len(grams) else count
            kinds = np.bincount(inverse)[inverse] if len(grams) else count
            prob[n][np.searchsorted(keys[n], grams), k] = (count - discount) / total
            if not n and len(grams):
                base[k] *= discount * len(grams) / count.sum()
            if n:
                at = _find(keys[n - 1], context)
                back[n - 1][at, k] = discount * kinds / total
                back[n - 1][-1, k] = 1.0
    models = Models(languages, order, keys, prob, back, base)
    _calibrate(models, kept)
    return models


def _calibrate(models: Models, rows: list[tuple[str, str]]) -> None:
    scores = [(x, models.languages.index(lang)) for text, lang in rows if (x := text_logs(models, text)) is not None]
    if not scores:
        return
    n = np.array([x[-1] for x, _ in scores])
    rates = np.array([-x[:-1].max() / x[-1] for x, _ in scores])
    mean = float(np.average(rates, weights=n))
    # variance a + b / n by least squares, both not negative
    off, inverse = (rates - mean) ** 2, 1 / n
    design = np.stack([np.ones(len(n)), inverse], 1)
    a, b = np.linalg.lstsq(design, off, rcond=None)[0]
    if b < 0:
        a, b = float(off.mean()), 0.0
    elif a < 0:
        a, b = 0.0, float((off * inverse).sum() / (inverse**2).sum())
    a, b = max(a, 1e-4), max(b, 1.0)  # a tenth of a nat on a single character is never odd
    reach = 2 * float(np.quantile(np.abs(rates - mean) / np.sqrt(a + b / n), 0.99))
    models.bound = (mean, float(a), float(b), max(reach, 4.0))
    best = None
    for sharp in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0):
        loss = 0.0
        for x, k in scores:
            z = sharp * (x[:-1] - x[:-1].max())
            loss -= z[k] - np.log(np.exp(z).sum())
        if best is None or loss < best[0] - 1e-9:
            best = (loss, sharp)
    models.sharpness = best[1]


def text_logs(models: Models, text: str | None) -> np.ndarray | None:
    words = _LETTERS.findall((text or "").lower())
    return models.word_logs(words).sum(0) if words else None


class Scorer:
    """Scores texts chunk by chunk (runs without white space), with a bounded table of the chunks seen."""

    def __init__(self, models: Models):
        self.models, self.rows, self.sums = models, {}, np.zeros((1, len(models.languages) + 1))

    def _learn(self, chunks: set[str]) -> None:
        fresh = [c for c in chunks if c not in self.rows]
        if len(self.rows) + len(fresh) > _CACHE:
            self.rows, self.sums, fresh = {}, self.sums[:1], list(chunks)
        found = [_LETTERS.findall(c) for c in fresh]
        words = list({w for f in found for w in f})
        if not words:
            self.rows.update(dict.fromkeys(fresh, 0))
            return
        place = dict(zip(words, range(len(words)), strict=True))
        logs = self.models.word_logs(words)
        flat = np.array([place[w] for f in found for w in f], np.int64)
        owner = np.repeat(np.arange(len(fresh)), [len(f) for f in found])
        made = np.stack([np.bincount(owner, logs[flat, k], len(fresh)) for k in range(logs.shape[1])], 1)
        base = len(self.sums)
        self.sums = np.concatenate([self.sums, made])
        self.rows.update(zip(fresh, range(base, base + len(fresh)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        if not self.models.languages:
            return [("und", 0.0, 0.0, True)] * len(texts)
        split = [(t or "").lower().split() for t in texts]
        self._learn(set().union(*split))
        out = []
        for chunks in split:
            total = self.sums[list(map(self.rows.__getitem__, chunks))].sum(0) if chunks else self.sums[0]
            out.append(self._decide(total))
        return out

    def _decide(self, total: np.ndarray) -> tuple[str, float, float, bool]:
        n = total[-1]
        if n == 0:
            return "und", 0.0, 0.0, True
        best = int(np.argmax(total[:-1]))
        z = self.models.sharpness * (total[:-1] - total[best])
        rate = float(-total[best] / n)
        return self.models.languages[best], float(1 / np.exp(z).sum()), rate, self.models.rejects(rate, n)


def labelled_sample(docs: DataFrame, per_language: int = 250, size: int = 8 << 20) -> list[tuple[str, str]]:
    """The bounded sample that models are fitted on: at most `per_language` whole texts and `size` bytes of each language, none of them held out.

    Rows with one doc_id and language count once.
    """
    usable = docs.where(F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    return common.sampled_texts(docs, common.bounded_sample(usable, "lang", "doc_id", per_language), "lang", ["doc_id", "lang"], size)


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Per document: doc_id, lang_pred, score, cross_entropy (nats per character), rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def start():
        scorer = Scorer(sent.value)

        def work(columns):
            made = scorer(columns[1])
            return [columns[0], *map(list, zip(*made, strict=True))]

        return work

    return common.map_text(docs, ["doc_id", "text"], "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean", start)


def accepted(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    common.bounded_batches(docs.sparkSession)

    def start():
        scorer = Scorer(sent.value)
        return lambda texts: [not rejected for _, _, _, rejected in scorer(texts)]

    return docs.where(common.text_column(start, "boolean")(F.col("text")))
