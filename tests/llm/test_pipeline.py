import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import langid, packing, queries, toxicity

from .tables import empty, frames


def write(spark, tmp_path, n=120):
    docs, labels = frames(spark, n)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_decides(spark, tmp_path):
    at = write(spark, tmp_path)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = docs
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, at)
        kept.write.parquet(f"{tmp_path}/out-{name}")
        kept = spark.read.parquet(f"{tmp_path}/out-{name}")
        assert kept.columns == docs.columns
        left.append([r["doc_id"] for r in kept.select("doc_id").collect()])
    clean, known, single = left
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    bad = [i for i in texts if i is not None and ("moron" in texts[i] or "scum" in texts[i])]
    assert len(set(bad) & set(clean)) <= 2 and len(clean) >= docs.count() - len(bad) - 2
    assert 120 in clean and 120 not in known and 122 not in known and 123 in known
    assert 11 in known and not {20, 30} & set(single)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, at).collect()
    assert {r["doc_id"] for r in pieces} == set(single)


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_run_against_brute_force(spark, tmp_path):
    """All stages on plain lists: scores by the same models, every pair's Jaccard similarity, each kept document's ids packed once."""
    at = write(spark, tmp_path, 60)
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    scores = toxicity.Scorer(toxicity.fit(toxicity.labelled_sample(docs, labels)))([t for _, t in rows])[0]
    rows = [r for r, s in zip(rows, scores) if s < 0.3]
    left = spark.createDataFrame([r for r in docs.collect() if (r["doc_id"], r["text"]) in rows], docs.schema)
    known = langid.Scorer(langid.fit(langid.labelled_sample(left)))([t for _, t in rows])
    rows = sorted((r for r, k in zip(rows, known) if not k[3]), key=lambda r: (r[0] is None, r[0], hashlib.md5((r[1] or "").encode()).digest()))
    group = list(range(len(rows)))
    sets = [grams(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    kept = [rows[i] for i in range(len(rows)) if group[i] == i]
    made = corpus_pipeline.run(spark, at)
    assert made.columns == packing.SCHEMA.replace(" bigint", "").split(", ")
    pieces = made.collect()
    assert {r["doc_id"] for r in pieces} == {i for i, _ in kept} and len(kept) == len({i for i, _ in kept})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in kept:
        own = sorted((r for r in pieces if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"] == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1


def test_stages_bear_empty_tables_and_clashing_columns(spark, tmp_path):
    docs, labels = empty(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


#: Columns that each registered query returns at least, and the table whose rows it returns one by one (packing: pieces).
RETURNS = {
    "op1": "doc_id held_out lang_pred score", "op2": "doc_id fingerprint component_id",
    "op3": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op4": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op5": "doc_id held_out score predicted",
    "op6": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op7": "doc_id n_bytes n_tokens over_limit",
    "op8": "page_id payload_bytes payload_digest record_type refers_to", "op9": "page_id url text n_chars", "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "doc_id n_bytes n_removed n_spans kept_sha256", "op12": "lang rank phrase a l r n score", "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = write(spark, tmp_path_factory.mktemp("sf"), 40)
    spark.createDataFrame([(i, f"u{i}", f"<p>page {i % 7}</p>") for i in range(20)] + [(99, None, None)], "page_id bigint, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, tables, name):
    short = name.split("_")[0]
    found = queries.QUERIES[name](spark, tables)
    assert set(RETURNS[short].split()) <= set(found.columns)
    rows = found.collect()
    if short == "op12":  # phrases, not documents
        assert rows and {r["lang"] for r in rows} <= {"en", "de", "und"}
        return
    source = spark.read.parquet(f"{tables}/{'pages' if short in ('op8', 'op9') else 'documents'}.parquet")
    key = "page_id" if short in ("op8", "op9") else "doc_id"
    got, want = (sorted((str(r[key]) for r in x)) for x in (rows, source.select(key).collect()))
    assert (set(got) == set(want)) if short == "op6" else got == want


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 4
