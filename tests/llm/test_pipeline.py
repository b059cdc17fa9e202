import hashlib

import public_tokenizers as P
from test_exact_dedup import normal
from test_near_dedup import brute

import corpus_pipeline
from nightjar.llm import bpe, decontaminate, language
from nightjar.llm.common import with_row_ids

SF = "/root/testdata/sf0.001"


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pred = {r["doc_id"]: r for r in language.predict(docs, language.fit(language.training_rows(docs))).collect()}
    left = {d for d in texts if pred[d]["lang_pred"] != "und" and pred[d]["score"] >= language.LEAST_SCORE}
    first = {}
    for d in sorted(left, key=lambda d: (-len(texts[d] or ""), d)):
        first.setdefault(normal(texts[d]), d)
    left = set(first.values())
    left = {d for d, (_, c) in brute([(d, texts[d]) for d in left], 5).items() if d == c}
    found = decontaminate.leaks(with_row_ids(docs.select("doc_id", "text")), spark.read.parquet(f"{SF}/benchmark.parquet"))
    left -= {r["doc_id"] for r in found.collect()}
    encoding = bpe.load_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = {}
    for d in left:
        ids = encoding.encode_ordinary(texts[d])
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) > 100


def test_stages_keep_the_columns(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.STAGES[0][1](spark, odd_docs, str(tmp_path)).count() == 0  # no language to learn


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [n for k in range(1, 11) if not (n := [x for x in names if x.startswith(f"op{k}_")])] == []
    assert set(entry.oracle_sql()) <= set(names)
