import itertools
import math

import numpy as np
import pytest

from corpusloom.llm import common, langid, toxicity

from .tables import empty, frames, rows


def test_language_models_are_distributions():
    """After any beginning of a word, the probabilities of all characters, the word's end and any other character sum to one."""
    seen = [(t, lang) for _, t, lang, *_ in rows()[0][:100] if t]
    models = langid.fit(seen)
    letters = sorted({c for t, _ in seen for c in t.lower() if c.isalpha()})
    for start in ("", "t", "th", "the", "ga", "zzz", "qä", "winte"):
        logs, place = models.char_logs([start + c for c in [*letters, "\u0416"]] + ([start] if start else []))
        # the character after the beginning; a lone beginning has its end mark there
        p = np.exp(logs[place == len(start) + 1])
        if not start:  # the end mark, which no word starts with, has the rest
            assert np.all(p.sum(0) <= 1 + 1e-9)
            continue
        assert len(p) == len(letters) + 2
        assert np.allclose(p.sum(0), 1, atol=1e-9), start


def test_rejection_is_a_quantile_by_length():
    seen = [(t, lang) for _, t, lang, *_ in rows()[0][:120] if t]
    models = langid.fit(seen)
    odd = langid.fit([*seen, *[("ЖЩЪ ЫЭЮ ЪЪЪ ЩЩЩ ЖЖЖ ЭЭЭ " * 10, "en")]])
    assert langid.Scorer(models)(["ЖЩЪЫ " * 30])[0][3]
    assert abs(odd.bound[0] - models.bound[0]) < 0.5
    kept = [not r[3] for r in langid.Scorer(models)([t for t, _ in seen])]
    assert sum(kept) == len(kept)
    assert models.rejects(models.bound[0] + 1.5, 400) and not models.rejects(models.bound[0] + 1.5, 2)


def test_letters():
    scorer = langid.Scorer(langid.fit([(t, lang) for _, t, lang, *_ in rows()[0][:60] if t]))
    assert [r[0] for r in scorer(["½ ² ①", "12 !?", "\u0301", None])] == ["und"] * 4
    assert langid._LETTERS.findall("cafe\u0301 x2y") == ["cafe\u0301", "x", "y"]


def test_kneser_ney_by_hand():
    # one word, order 2: counts of ^a, aa, ab, b$ against the definition
    models = langid.fit([("aab aab", "x")], order=2, discount=0.5)
    grams = {"^a": 2, "aa": 2, "ab": 2, "b$": 2}
    kinds = {"a": 2, "b": 1, "$": 1}  # how many different characters stand before
    # the discounted mass goes to a, b, the end mark and all other characters evenly
    unigram = {c: (n - 0.5) / 4 + 0.5 * 3 / 4 / 4 for c, n in kinds.items()}
    total = {"^": 2, "a": 4, "b": 2}
    after = {"^": 1, "a": 2, "b": 1}

    def p(pair):
        return (grams[pair] - 0.5) / total[pair[0]] + 0.5 * after[pair[0]] / total[pair[0]] * unigram[pair[1]]

    want = sum(math.log(p(g)) for g in ("^a", "aa", "ab", "b$"))
    assert abs(models.word_logs(["aab"])[0, 0] - want) < 1e-9


def test_languages_of_all_cases(spark):
    docs, _ = frames(spark)
    models = langid.fit(langid.labelled_sample(docs))
    found = langid.identify(docs, models).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i in range(40, 120):
        assert by[i]["lang_pred"] == ("en" if i % 2 else "de")
    for i in (120, 121, 122):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"]
    assert by[123]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.accepted(docs, models).columns == docs.columns


def test_no_labels_and_no_rows(spark):
    docs, labels = empty(spark)
    models = langid.fit(langid.labelled_sample(docs))
    assert langid.identify(docs, models).count() == 0
    some, _ = frames(spark, 40)
    assert {r["lang_pred"] for r in langid.identify(some, models).collect()} == {"und"}
    field = toxicity.fit(toxicity.labelled_sample(docs, labels))
    assert {r["score"] for r in toxicity.score(some, field).collect()} == {0.0}
    assert toxicity.score(docs, field).count() == 0


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(3)
    emission, step = rng.normal(size=9), rng.normal(size=(2, 2))
    chain = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    odds, both = toxicity.log_odds(emission, chain, step, paired=True)
    for c in range(3):
        at = np.flatnonzero(chain == c)
        weights = {}
        for y in itertools.product((0, 1), repeat=len(at)):
            weights[y] = math.exp(sum(emission[i] * v for i, v in zip(at, y)) + sum(step[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        for k, i in enumerate(at):
            p = sum(w for y, w in weights.items() if y[k]) / total
            assert abs(1 / (1 + math.exp(-odds[i])) - p) < 1e-9
            if k:
                for a, b in itertools.product((0, 1), repeat=2):
                    q = sum(w for y, w in weights.items() if (y[k - 1], y[k]) == (a, b)) / total
                    assert abs(both[2 * a + b, i] - q) < 1e-9


def test_long_chains_have_the_same_marginals(monkeypatch):
    rng = np.random.default_rng(5)
    emission, step = rng.normal(size=400), rng.normal(size=(2, 2))
    chain = np.repeat([0, 1, 2], [5, 390, 5])
    want = toxicity.log_odds(emission, chain, step, paired=True)
    monkeypatch.setattr(toxicity, "LONG", 1000)
    got = toxicity.log_odds(emission, chain, step, paired=True)
    assert np.allclose(want[0], got[0]) and np.allclose(want[1], got[1])


def test_repeated_rows_do_not_multiply_the_sample(spark):
    docs, labels = frames(spark, 60)
    many = docs.unionByName(docs).unionByName(docs.where("doc_id % 4 = 0").limit(3))
    assert langid.labelled_sample(many) == langid.labelled_sample(docs)
    assert toxicity.labelled_sample(many, labels.union(labels)) == toxicity.labelled_sample(docs, labels)
    assert len(langid.labelled_sample(many, per_language=5)) == 10
    assert sum(len(t.encode()) for t, _ in langid.labelled_sample(docs, size=3000)) <= 6000


def test_toxic_documents_and_spans(spark):
    docs, labels = frames(spark)
    field = toxicity.fit(toxicity.labelled_sample(docs, labels))
    found = {r["doc_id"]: r for r in toxicity.score(docs, field).collect() if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    wrong = [i for i in range(120) if i not in (10, 20, 30) and (found[i]["score"] >= 0.3) != (i % 4 == 0)]
    assert len(wrong) <= 2
    spans = [texts[i][s["start"] : s["end"]].strip(".") for i in range(40, 120) for s in found[i]["spans"]]
    assert spans and set(spans) <= {"moron", "scum"}
    assert found[120]["score"] == found[121]["score"] < 0.3
    kept = toxicity.clean(docs, field)
    assert kept.columns == docs.columns and kept.where("doc_id = 120").count() == 1


def test_labelled_texts_without_words():
    for rows in ([("", 0), ("", 1)], [(" \n", 1), ("\t", 0)], [("", 1), ("hello there", 0)], [("...", 1), ("!!! ?", 0)], [("...", 0), ("", 1)] * 300):
        scores = toxicity.Scorer(toxicity.fit(rows)).sums([t for t, _ in rows])
        assert np.isfinite(scores).all()


def test_a_thousand_languages(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "concat('l', id % 1000) as lang")
    found = common.bounded_sample(rows, "lang", "doc_id", 3)
    assert found.groupBy("lang").count().agg({"count": "max"}).first()[0] == 3 and found.select("lang").distinct().count() == 1000
    with pytest.raises(ValueError):
        common.bounded_sample(spark.range(1001).selectExpr("id as doc_id", "concat('l', id) as lang"), "lang", "doc_id", 3)


def test_samples_of_many_keys_share_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(common, "SAMPLE_BYTES", 4000)
    docs = spark.range(400).selectExpr("id as doc_id", "concat('l', id % 4) as lang", "repeat('x', 100) as text")
    texts = common.sampled_texts(docs, docs.select("doc_id", "lang"), "lang", ["doc_id", "lang"], 10_000)
    assert sum(len(t) for t, _ in texts) == 4000
