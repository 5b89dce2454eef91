"""The ten contract queries as a caller sees them, and the pipeline on awkward rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, queries
from tidemark.session import ship

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

CONTRACTS = {
    "op1_token_counts": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    "op3_language_id": ("documents", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    "op5_simhash": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op6_quality_rules": ("documents", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    "op7_mixing": ("documents", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    "op8_html_extraction": ("pages", {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}),
    "op9_decontamination": ("documents", {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}),
    "op10_quality_classifier": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
}


@data
@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_of(spark, name):
    table, columns = CONTRACTS[name]
    found = queries.QUERIES[name](spark, SF)
    assert columns.items() <= dict(found.dtypes).items()
    rows = found.collect()
    key = "page_id" if table == "pages" else "doc_id"
    given = [r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert sorted(r[key] for r in rows) == sorted(given)
    if name == "op5_simhash":
        assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() and r["component_id"] <= r["doc_id"] for r in rows)
    if name == "op10_quality_classifier":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


@data
def test_the_other_two(spark):
    assert dict(queries.op2_license_scan(spark, SF).dtypes) == {"doc_id": "bigint", "scope": "string", "line_no": "bigint", "license_id": "string"}
    assert dict(queries.op4_chat_format(spark, SF).dtypes) == {"conv_id": "bigint", "part": "bigint", "n_turns": "bigint", "text": "string"}


def test_words_taken_equal_those_of_the_blocks(spark):
    """The closed form against every block counted out."""
    rng, rows = np.random.default_rng(1), []
    for _ in range(300):
        blocks = int(rng.integers(1, 12))
        quota, start, words = int(rng.integers(0, 2 * blocks + 1)), int(rng.integers(0, blocks)), int(rng.integers(0, 16 * blocks + 1))
        copies = [((b + 1) * quota + start) // blocks - (b * quota + start) // blocks for b in range(blocks)]
        assert sum(copies) == quota and max(copies) <= 2
        rows.append((words, blocks, quota, start, sum(copies[w // 16] for w in range(words))))
    table = spark.createDataFrame(rows, "words long, blocks long, quota long, start long, want long")
    found = table.withColumn("got", mixing._taken_before(*(F.col(c) for c in ("words", "blocks", "quota", "start"))))
    assert found.where("got <> want").count() == 0


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null texts, null and repeated ids, repeated rows, columns that clash with the stages' own."""
    ship(spark)
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    rows = [(k % 30, say(40), "en", "a" if k % 3 else None, 1, "x", "y", 2) for k in range(60)]
    rows += [(None, say(50), None, "b", None, None, None, None), (7, None, "en", "a", 1, "x", "y", 2), (8, "", None, None, 1, "x", "y", 2), rows[0], rows[0], rows[1]]
    item = say(30)
    rows.append((99, item, "en", "a", 1, "x", "y", 2))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, ledger string, hits string, h1 int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # short rows fall to the rules, the item to the benchmark, exact copies to one another
    kept = {(r[0], r[1]) for r in rows if r[1] and r[1] != item}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((k is None, k or 0) for k, _ in kept)
