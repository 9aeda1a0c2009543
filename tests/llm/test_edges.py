"""Every operator on odd rows and on an empty table."""

import corpus_pipeline
import public_tokenizers
import pytest

from quillmark.llm import bpe, decontam, langid, lm, quality, queries, secret_scan, simhash, spans, toxicity, warc


def labels(docs):
    return docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 2 AS INT) AS toxic", "'x' AS label")


def benchmark(docs):
    return docs.selectExpr("doc_id AS item_id", "text", "'x' AS score")


def pages(docs):
    return docs.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "'x' AS digest", "'y' AS first_id")


PER_DOCUMENT = {
    "op1": lambda d: simhash.near_duplicates(d),
    "op3": lambda d: lm.held_out_scores(d),
    "op5": lambda d: langid.held_out_predictions(d),
    "op7": lambda d: toxicity.held_out_scores(d, labels(d)),
    "op8": lambda d: warc.archive_round_trip(pages(d)),
    "op9": lambda d: quality.judge_documents(d),
    "op10": lambda d: bpe.digests(bpe.round_trip(d, queries.RANKS, public_tokenizers.PATTERN)),
}
OTHERS = {"op2": lambda d: spans.removed(d, spans.repeated_spans(d)), "op4": lambda d: secret_scan.find(d, secret_scan.train(settings=secret_scan.Settings(trees=3, sample=300))), "op6": lambda d: decontam.contaminated(d, benchmark(d))}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_each(odd, nothing, name):
    out = PER_DOCUMENT[name](odd).collect()
    assert len(out) == odd.count()
    assert PER_DOCUMENT[name](nothing).count() == 0


def test_values_of_odd_rows(odd):
    """Null, empty and blank texts (0, 1, 2), copies (5, 6 and 7, 8), repeated rows (7) and rows without id."""
    rows = {name: {r[0]: r for r in f(odd).collect()} for name, f in PER_DOCUMENT.items()}
    for i in (0, 1, 2):
        assert rows["op1"][i]["fingerprint"] == "0" * 16 and rows["op1"][i]["component_id"] == 0
        assert rows["op3"][i]["n_tokens"] == 1
        assert (rows["op5"][i]["lang_pred"], rows["op5"][i]["score"]) == ("und", 0.0)
        assert (rows["op9"][i]["n_words"], rows["op9"][i]["base_failed"], rows["op9"][i]["kept"]) == (0, True, False)
    assert rows["op7"][0]["score"] == rows["op7"][1]["score"] == rows["op7"][2]["score"]
    assert rows["op1"][6]["component_id"] == 5 and rows["op1"][8]["component_id"] == rows["op1"][7]["component_id"] == 7
    for a, b in ((5, 6), (7, 8)):
        assert rows["op3"][a]["base_score"] == rows["op3"][b]["base_score"] and rows["op7"][a]["score"] == rows["op7"][b]["score"]
        assert rows["op10"][a]["ids_sha256"] == rows["op10"][b]["ids_sha256"] and rows["op9"][a]["zstd_ratio"] == rows["op9"][b]["zstd_ratio"]
    assert rows["op10"][0]["n_tokens"] == rows["op10"][1]["n_tokens"] == 0
    assert [rows["op3"][None]["held_out"], rows["op5"][None]["held_out"], rows["op7"][None]["held_out"]] == [False] * 3
    assert (rows["op8"][0]["payload_bytes"], rows["op8"][1]["record_type"], rows["op8"][1]["refers_to"]) == (0, "revisit", 0)


def test_odd_rows_of_others(odd):
    """Copies lose all their sentences but the first's; items are found in their own texts."""
    gone = {r["doc_id"]: r for r in OTHERS["op2"](odd).collect()}
    assert gone[6]["source"] == 5 and gone[6]["text"].strip() == "" and gone[8]["source"] == 7 and gone[8]["text"].strip() == "" and 9 not in gone
    whole = [(r["doc_id"], r["text"]) for r in spans.remove_spans(odd).collect()]
    assert len(whole) == odd.count() and dict(whole)[8].strip() == "" and dict(whole)[0] is None
    found = {(r["doc_id"], r["item_id"]) for r in OTHERS["op6"](odd).collect()}
    assert {(7, 7), (8, 7), (7, 8), (None, 7), (9, 9)} <= found and not any(k in (0, 1, 2) or i in (0, 1, 2) for i, k in found)
    coded = bpe.encode(odd, queries.RANKS, public_tokenizers.PATTERN)
    texts = sorted((r["text"] or "") for r in odd.collect())
    assert sorted(bytes(r["decoded"]).decode() for r in bpe.decode(coded, queries.RANKS, public_tokenizers.PATTERN).collect()) == texts


@pytest.mark.parametrize("name", OTHERS)
def test_others(nothing, name):
    assert OTHERS[name](nothing).count() == 0


def test_stages_keep_the_columns(spark, odd, nothing, tmp_path):
    benchmark(nothing).write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
