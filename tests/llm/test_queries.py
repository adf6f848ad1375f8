"""Every query of the package against its SQL, and that odd and empty tables give defined results."""

import pyarrow as pa
import pytest

import corpus_pipeline
from contract.check import differences, duckdb_session
from duefold.llm import (
    common,
    exact_dedup,
    language_id,
    license_scan,
    mixing,
    packing,
    passages,
    quality,
    sharding,
    simhash,
)
from duefold.llm.queries import ORACLES, QUERIES
from duefold.llm.settings import TOKENIZER
from tests.conftest import SMALL

from .test_dedup import components, near_by_force


@pytest.fixture(scope="module")
def connection():
    return duckdb_session(SMALL)


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    found = QUERIES[name](spark, SMALL).toArrow()
    assert differences(found, connection.sql(ORACLES[name]).to_arrow_table()) == ""
    assert found.num_rows


OPERATORS = {
    "exact": exact_dedup.exact_dedup,
    "license": license_scan.scan_licenses,
    "simhash": simhash.near_groups,
    "language": language_id.identify,
    "shards": sharding.shard_documents,
    "mix": mixing.mix_report,
    "quality": lambda d: quality.score_quality(d, d.selectExpr("doc_id", "size AS quality")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(odd_docs, no_docs, name):
    assert OPERATORS[name](odd_docs).count() == 12
    empty = no_docs.selectExpr("*", "1 AS size")
    assert OPERATORS[name](empty).count() == 0


def test_odd_and_empty_tables_of_pieces_and_passages(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, TOKENIZER)
    assert pieces.select("doc_id").distinct().count() == 10
    assert packing.pack(no_docs, TOKENIZER).count() == 0
    assert passages.repeated_passages(odd_docs).count() == 0
    assert passages.repeated_passages(no_docs).count() == 0


def test_stages_keep_columns_and_take_effect(spark, odd_docs, no_docs, tmp_path):
    for start in (odd_docs, no_docs):
        docs = start
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            if name != "pack":
                out = stage(spark, docs, SMALL)
                assert out.columns == start.columns
                out.write.parquet(f"{tmp_path}/{len(start.columns)}/{name}")
                docs = spark.read.parquet(f"{tmp_path}/{len(start.columns)}/{name}")
                counts.append(docs.count())
            else:
                counts.append(stage(spark, docs, SMALL).count())
        # Null, empty, blank and number texts go; then copies, repeated rows included.
        assert counts[:3] == ([8, 5, 5] if start is odd_docs else [0, 0, 0])
        assert (counts[4] > 0) == (start is odd_docs)


def test_pipeline_keeps_clean_documents(spark):
    """Recomputed by brute force: everything readable, one of each text, one of each group."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = corpus_pipeline.language(spark, docs, SMALL)
    assert known.count() == docs.where("text RLIKE '\\\\p{L}'").count()
    once = corpus_pipeline.exact(spark, known, SMALL)
    assert once.count() == known.selectExpr("sha2(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 256)").distinct().count()
    near = corpus_pipeline.near(spark, once, SMALL)
    texts = {r.doc_id: r.text for r in once.collect()}
    _, links = near_by_force(texts)
    expected = set(components(texts, links).values())
    assert {r.doc_id for r in near.collect()} == expected and len(expected) == near.count()
    assert QUERIES["pipeline"](spark, SMALL).count() > 0


def test_stages_send_texts_to_workers_in_small_batches(spark, no_docs):
    """Ten thousand rows of 20 KB would be 200 MB at once, and 64 MB by the setting's default."""
    corpus_pipeline.language(spark, no_docs, SMALL)
    texts = spark.range(0, 1000, 1, 1).selectExpr("repeat('many words ', 2000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    rows = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 1000
    assert max(r["size"] for r in rows) < 2 * common.BATCH


@pytest.mark.parametrize("set_before, bound", [("64m", common.BATCH), ("1m", 1 << 20)])
def test_a_smaller_batch_bound_of_the_session_stays(spark, set_before, bound):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.set(name, set_before)
        common.bounded_batches(spark)
        assert common._bytes(spark.conf.get(name)) == bound
    finally:
        spark.conf.unset(name)
