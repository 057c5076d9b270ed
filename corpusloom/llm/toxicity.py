"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs without white space; a chain is a sentence. Token labels come from
the document labels: a word, or a word beginning of 4 to 6 letters, whose presence separates toxic from
clean documents beyond chance marks its tokens in toxic documents. The field's features are the word, its
beginnings and endings, its length and its kinds of characters; two labels, four transition weights. For
a text, forward and backward passes give each token's marginal; the document score is a logistic
function of the sum and the largest of them, and tokens at or over 0.5 are the spans.

Cases: null and empty texts score like a text without any toxic token. Texts and sentences of any length are
scored whole. Repeated rows score alike and count once in the sample. A marginal of exactly 0.5 is a span, a
score of exactly the threshold is rejected. Without labelled rows of both kinds every score is 0. An empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Chains of more tokens are worked on one by one, which gives the same marginals without a matrix as tall as the longest.
LONG = 128
_CACHE = 400_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_END = re.compile(r"[.!?][\W_]*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_CHUNK = re.compile(r"\S+")


def word_of(chunk: str) -> str:
    return _EDGES.sub("", chunk).lower()


def beginnings(word: str) -> list[str]:
    return [f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n]


#: Feature templates: the word, its beginnings and endings, its length and its kinds of characters.
TEMPLATES = 9


def features(chunk: str) -> tuple:
    """One value for each template; None throughout where the chunk has no letter or digit."""
    word = word_of(chunk)
    if not word:
        return (None,) * TEMPLATES
    kind = word.isalpha() + 2 * chunk.isupper() + 4 * (not word.isalpha() and any(map(str.isdigit, word)))
    return (word, word[:3], word[:4], word[:5], word[:6], word[-3:], word[-4:], min(len(word), 12), kind)


@dataclass
class Field:
    """weights: for label 1 against label 0, a table for each template; step[a, b]: from label a to label b; document: of 1, log of the marginals' sum, logit of the largest."""

    bias: float = -2.0
    weights: list[dict] = field(default_factory=lambda: [{} for _ in range(TEMPLATES)])
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: tuple[float, float, float] | None = None

    def emission(self, chunk: str) -> float:
        return self.bias + sum([w.get(f, 0.0) for w, f in zip(self.weights, features(chunk), strict=True)])


def chains(ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The chain that each token belongs to: a new one after a sentence's end and at a document's start."""
    starts = np.zeros(len(ends), bool)
    starts[1:] = ends[:-1]
    first = np.cumsum(lengths) - lengths
    starts[first[lengths > 0]] = True
    return np.cumsum(starts) - 1


def _forward(e: np.ndarray, alive: np.ndarray, a: np.ndarray, out: np.ndarray) -> None:
    """out[t]: log odds of label 1 by what stands before and at t; alive[t]: how many of the chains, longest first, have a token t."""
    for t in range(len(e)):
        n = alive[t]
        if t:
            r = out[t - 1, :n]
            out[t, :n] = e[t, :n] + np.logaddexp(a[0, 1], a[1, 1] + r) - np.logaddexp(a[0, 0], a[1, 0] + r)
        else:
            out[0, :n] = e[0, :n]


def _backward(e: np.ndarray, alive: np.ndarray, a: np.ndarray, out: np.ndarray) -> None:
    for t in range(len(e) - 2, -1, -1):
        n = alive[t + 1]
        x = e[t + 1, :n] + out[t + 1, :n]
        out[t, :n] = np.logaddexp(a[1, 0], a[1, 1] + x) - np.logaddexp(a[0, 0], a[0, 1] + x)


def _both_ways(e: list[float], a: np.ndarray) -> tuple[list[float], list[float]]:
    """_forward and _backward of one chain."""
    a00, a01, a10, a11 = a.ravel().tolist()

    def add(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    before, after = [e[0]], [0.0]
    for x in e[1:]:
        r = before[-1]
        before.append(x + add(a01, a11 + r) - add(a00, a10 + r))
    for x in reversed(e[1:]):
        x += after[-1]
        after.append(add(a10, a11 + x) - add(a00, a01 + x))
    return before, after[::-1]


def log_odds(emission: np.ndarray, chain: np.ndarray, step: np.ndarray, paired: bool = False):
    """Each token's log odds of label 1 by forward and backward passes, over all chains of up to LONG tokens at once.

    paired: also the probabilities of the labels of a token and the one before it in its chain (00, 01, 10, 11; 0 for first ones).
    """
    if not len(emission):
        return (emission, emission) if paired else emission
    sizes = np.bincount(chain)
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(emission)) - start[chain]
    before, after = np.empty(len(emission)), np.empty(len(emission))
    short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    if len(short):
        long = sizes[short]
        by_length = np.argsort(-long, kind="stable")
        column = np.full(len(sizes), -1)
        column[short[by_length]] = np.arange(len(short))
        own = np.flatnonzero(sizes[chain] <= LONG)
        at = (place[own], column[chain[own]])
        e = np.zeros((long.max(), len(short)))
        e[at] = emission[own]
        alive = np.searchsorted(-long[by_length], -np.arange(1, long.max() + 1), side="right")
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        _forward(e, alive, step, forward)
        _backward(e, alive, step, backward)
        before[own], after[own] = forward[at], backward[at]
    for c in np.flatnonzero(sizes > LONG).tolist():
        span = slice(start[c], start[c] + sizes[c])
        before[span], after[span] = _both_ways(emission[span].tolist(), step)
    odds = before + after
    if not paired:
        return odds
    back = np.where(place > 0, np.roll(before, 1), -np.inf)
    ahead = emission + after
    with np.errstate(over="ignore", invalid="ignore"):
        logs = np.stack([np.zeros(len(emission)) + step[0, 0], step[0, 1] + ahead, step[1, 0] + back, step[1, 1] + back + ahead])
        logs -= logs.max(0)
        both = np.exp(logs)
        both /= both.sum(0)
    return odds, np.where(place > 0, both, 0.0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def separating(rows: list[tuple[str, int]]) -> set[str]:
    """Words and word beginnings that sentences of toxic documents have far more often than those of clean ones.

    Each different sentence counts once, so that copies of a document are no evidence. Far more often:
    a likelihood ratio well over twice the log of the number tried, and 20 times the rate.
    """
    seen, totals = (Counter(), Counter()), [1, 1]
    met: tuple[set, set] = (set(), set())
    terms: dict[str, tuple[str, ...]] = {}
    for text, label in rows:
        for sentence in _SENTENCE.split(text):
            if sentence in met[label]:
                continue
            met[label].add(sentence)
            found = set()
            for c in sentence.split():
                if c not in terms:
                    word = word_of(c)
                    terms[c] = (word, *beginnings(word)) if word else ()
                found.update(terms[c])
            seen[label].update(found)
            totals[label] += 1
    limit = 2 * math.log(max(2, len(seen[1]))) + 6
    out = set()
    for term, k in seen[1].items():
        j = seen[0][term]
        p, rate1, rate0 = (k + j) / sum(totals), k / totals[1], max(j, 0.5) / totals[0]
        if math.log(rate1 / rate0) < 3 or k < 3:
            continue
        g = 2 * (k * math.log(k / (totals[1] * p)) + (j * math.log(j / (totals[0] * p)) if j else 0))
        if g > limit:
            out.add(term)
    return out


def fit(rows: list[tuple[str, int]], passes: int = 40, sentences: int = 6000) -> Field:
    """Fits on (text, label) rows: at most `sentences` sentences, half of them with a marked token where there are so many.

    A second fit adds as many sentences of clean documents in which the first one sees toxic tokens.
    Every fifth document only fits the document score, on marginals of texts that the field has not seen.
    Without rows of both labels, or without a word in any of them, nothing is toxic.
    """
    if len({label for _, label in rows}) < 2:
        return Field()
    late = [i % 5 == 4 and len(rows) >= 500 for i in range(len(rows))]
    own = [r for r, last in zip(rows, late, strict=True) if not last]
    tagged, clean = _sentences(own, separating(own))
    half = sentences // 2
    chosen = tagged[:: max(1, len(tagged) // half)][:half]
    rest = sentences - len(chosen)
    chosen = chosen + clean[:: max(1, len(clean) // rest)][:rest]
    if not chosen:
        return Field()
    out = _fit_field(chosen, passes)
    texts = [t for t, label in own if label == 0]
    scorer, hard = Scorer(out), []
    for i in range(0, len(texts), 500):
        odds, lengths = scorer.odds(texts[i : i + 500])
        hot = np.add.reduceat(odds > -3, (np.cumsum(lengths) - lengths)[lengths > 0]) if len(odds) else []
        hard += [t for t, n in zip([t for t, k in zip(texts[i : i + 500], lengths, strict=True) if k], hot, strict=True) if n]
    _, again = _sentences([(t, 0) for t in hard], set())
    wrong = [x for x in again if max(map(out.emission, x[0])) > -3]
    out = _fit_field(chosen + wrong[:: max(1, len(wrong) // sentences)][:sentences], passes)
    judged = [r for r, last in zip(rows, late, strict=True) if last] or rows
    out.document = _logistic(Scorer(out).sums([t for t, _ in judged]), np.array([label for _, label in judged], np.float64))
    return out


def _sentences(rows: list[tuple[str, int]], marks: set[str]) -> tuple[list, list]:
    """(tokens, labels) of the sentences with and without a marked token in a toxic document."""
    known: dict[str, tuple[bool, bool]] = {}

    def seen(chunk: str) -> tuple[bool, bool]:
        word = word_of(chunk)
        known[chunk] = made = (word in marks or any(b in marks for b in beginnings(word)), bool(_END.search(chunk)))
        return made

    tagged: list[tuple[list[str], list[bool]]] = []
    clean: list[tuple[list[str], list[bool]]] = []
    for text, label in rows:
        chunks = text.split()
        if not chunks:
            continue
        flags = [known.get(c) or seen(c) for c in chunks]
        chain = chains(np.array([e for _, e in flags]), np.array([len(chunks)]))
        for lo, hi in zip(at := np.flatnonzero(np.diff(chain, prepend=-1)), np.append(at[1:], len(chunks)), strict=True):
            y = [m and label == 1 for m, _ in flags[lo:hi]]
            (tagged if any(y) else clean).append((chunks[lo:hi], y))
    return tagged, clean


def _fit_field(chosen: list, passes: int) -> Field:
    """Weights that maximise the penalised likelihood of the labels, by adaptive gradient steps on all sentences."""
    tokens = [c for chunks, _ in chosen for c in chunks]
    y = np.array([v for _, labels in chosen for v in labels], np.float64)
    places: list[dict] = [{} for _ in range(TEMPLATES)]
    size = 0
    rows_of: dict[str, list[int]] = {}
    for c in dict.fromkeys(tokens):
        at = []
        for names, f in zip(places, features(c), strict=True):
            if f not in names:
                names[f], size = size, size + 1
            at.append(names[f])
        rows_of[c] = at
    ids = np.array([rows_of[c] for c in tokens], np.int64)
    chain = np.repeat(np.arange(len(chosen)), [len(c) for c, _ in chosen])
    follows = np.diff(chain, prepend=-1) == 0
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:-1].astype(int)[follows[1:]], y[1:].astype(int)[follows[1:]]), 1)
    out = Field()
    weight, step = np.zeros(size), np.zeros((2, 2))
    g2w, g2s = np.full(size, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(passes):
        odds, both = log_odds(weight[ids].sum(1) + out.bias, chain, step, paired=True)
        slope = np.bincount(ids.ravel(), np.repeat(y - _sigmoid(odds), TEMPLATES), size) / 100 - 3e-3 * weight
        pull = (pairs - both.sum(1).reshape(2, 2)) / 100 - 1e-2 * step
        g2w += slope**2
        g2s += pull**2
        weight += 0.3 * slope / np.sqrt(g2w)
        step += 0.1 * pull / np.sqrt(g2s)
    out.weights, out.step = [{f: float(weight[i]) for f, i in names.items()} for names in places], step
    return out


def _logistic(sums: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    x = _inputs(sums)
    w = np.zeros(3)
    for _ in range(40):
        p = _sigmoid(x @ w)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(3)
        w += np.linalg.solve(curve, x.T @ (y - p) - 0.3 * w)
    return tuple(float(v) for v in w)


def _inputs(sums: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(sums)), np.log(sums[:, 0] + 1e-3), np.clip(sums[:, 1], -8, 8)], 1)


class Scorer:
    def __init__(self, model: Field):
        self.model, self.rows = model, {}
        self.emit, self.ends = np.zeros(0), np.zeros(0, bool)

    def _learn(self, chunks: set[str]) -> None:
        fresh = [c for c in chunks if c not in self.rows]
        if len(self.rows) + len(fresh) > _CACHE:
            self.rows, self.emit, self.ends, fresh = {}, self.emit[:0], self.ends[:0], list(chunks)
        if not fresh:
            return
        base = len(self.emit)
        self.emit = np.concatenate([self.emit, [self.model.emission(c) for c in fresh]])
        self.ends = np.concatenate([self.ends, [bool(_END.search(c)) for c in fresh]])
        self.rows.update(zip(fresh, range(base, base + len(fresh)), strict=True))

    def odds(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of all tokens, one text after another, and how many tokens each text has."""
        split = [(t or "").split() for t in texts]
        self._learn(set().union(*split))
        row = self.rows.__getitem__
        at = np.array([i for chunks in split for i in map(row, chunks)], np.int64)
        lengths = np.array([len(c) for c in split], np.int64)
        if not len(at):
            return np.zeros(0), lengths
        return log_odds(self.emit[at], chains(self.ends[at], lengths), self.model.step), lengths

    def sums(self, texts: list[str | None]) -> np.ndarray:
        odds, lengths = self.odds(texts)
        return _sums(odds, lengths)

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[list[dict]]]:
        if self.model.document is None:
            return [0.0] * len(texts), [[] for _ in texts]
        odds, lengths = self.odds(texts)
        scores = _sigmoid(_inputs(_sums(odds, lengths)) @ np.array(self.model.document))
        hot = np.flatnonzero(odds >= 0)
        first = np.cumsum(lengths) - lengths
        spans: list[list[dict]] = [[] for _ in texts]
        owners = np.searchsorted(first, hot, side="right") - 1 if len(hot) else hot
        wanted: dict[int, list[int]] = {}
        for i, owner in zip(hot.tolist(), owners.tolist(), strict=True):
            wanted.setdefault(owner, []).append(i)
        for owner, tokens in wanted.items():
            where = [m.span() for m in _CHUNK.finditer(texts[owner])]
            for i in tokens:
                lo, hi = where[i - int(first[owner])]
                spans[owner].append({"start": lo, "end": hi, "marginal": float(_sigmoid(odds[i]))})
        return scores.tolist(), spans


def _sums(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text the sum of its tokens' marginals and the largest log odds."""
    out = np.tile([0.0, -8.0], (len(lengths), 1))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(odds):
        out[:, 0] = np.bincount(owner, _sigmoid(odds), len(lengths))
        full = lengths > 0
        out[full, 1] = np.maximum.reduceat(odds, (np.cumsum(lengths) - lengths)[full])
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, size: int = 24 << 20) -> list[tuple[str, int]]:
    """The bounded sample: at most `per_class` whole labelled texts and `size` bytes of either label, none of them held out.

    Of several labels of a document the larger one counts; rows with one doc_id count once.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~common.held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return common.sampled_texts(docs, common.bounded_sample(usable, "toxic", "doc_id", per_class), "toxic", ["doc_id"], size)


def score(docs: DataFrame, model: Field) -> DataFrame:
    """Per document: doc_id, score, spans (code-point offsets of toxic tokens with their marginals)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(sent.value)

        def work(columns):
            return [columns[0], *scorer(columns[1])]

        return work

    return common.map_text(docs, ["doc_id", "text"], "doc_id bigint, score double, spans array<struct<start:int,end:int,marginal:double>>", start)


def clean(docs: DataFrame, model: Field, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    common.bounded_batches(docs.sparkSession)

    def start():
        scorer = Scorer(sent.value)
        return lambda texts: scorer(texts)[0]

    return docs.where(common.text_column(start, "double")(F.col("text")) < threshold)
