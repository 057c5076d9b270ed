"""Small tables with the cases that every operator must bear."""

import random

WORDS = {
    "en": "the and with from house river summer letter window garden morning paper little great never under".split(),
    "de": "der und mit von haus fluss sommer brief fenster garten morgen papier klein gross niemals unter".split(),
}
BAD = ["moron", "scum"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fingerprint string, key string"


def text(rng, lang, n, bad=0):
    words = [rng.choice(WORDS[lang]) for _ in range(n)]
    for _ in range(bad):
        words[rng.randrange(n)] = rng.choice(BAD)
    return ". ".join(" ".join(words[i : i + 8]) for i in range(0, n, 8)) + "."


def rows(n=120, seed=5):
    """Documents in two languages, a quarter toxic; copies, a near copy, nulls, empties and a very long text."""
    rng = random.Random(seed)
    out, labels = [], []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        toxic = int(i % 4 == 0)
        out.append([i, text(rng, lang, 60, 4 * toxic), lang, f"s{i % 3}"])
        labels.append((i, i % 2, toxic))
    out[10][1] = out[20][1] = out[30][1] = out[11][1]
    near = out[13][1].split(" ")
    near[5] = "changed"
    out[15][1] = " ".join(near)
    extra = [
        [n, None, "en", None], [n + 1, "", None, "s0"], [n + 2, "  \n\t ", "en", "s0"], [n + 3, text(rng, "en", 20_000), "en", "s0"],
        [n + 4, "12345 !!! ½", None, "s1"], [None, "no id here", "en", "s0"], [3, out[3][1], "en", "s0"], [n + 5, "<|endoftext|> a  b\n\n c 🎉 é", None, "s0"],
    ]
    table = [(*r, None, 0.5, "x", "k") for r in out + extra]
    return table, labels + [(None, None, None), (n, None, 1)]


def frames(spark, n=120):
    docs, labels = rows(n)
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
