"""The registered queries and the pipeline."""
import zlib

import pytest
from compare import difference, oracle_connection, oracle_table, spark_table
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, name):
    got = spark_table(queries.QUERIES[name](spark, SMALL))
    assert difference(got, oracle_table(oracle_connection(SMALL), oracle.ORACLE[name])) is None


def test_every_operator_is_registered():
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    names = registered()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(oracle.ORACLE) <= set(oracle_sql())


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    clean = {i: " ".join(f"{w}{i}" for w in ("calm", "river", "stone", "paper", "winter", "garden", "music", "bridge")) for i in range(40)}
    item = "the benchmark asks which of seven bridges a walker may cross only once before noon"
    docs = {**clean, 50: "you vile idiot " + clean[1], 51: "you vile idiot and scum " + clean[2], 60: clean[5], 61: clean[6] + "\n" + clean[7] + " own words of another kind",
            70: clean[8] + " more " + item + " again", 80: None, 81: ""}
    rows = [(k, t, "en", "src", None if t is None else len(t)) for k, t in docs.items()]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(k, 1, int(k in (50, 51))) for k in docs] * 1, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }
    # Enough marked rows to learn from, all in the part that is learned from.
    more = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 5]
    extra = [(k, f"vile idiot note{k} page{k} leaf{k}" if k % 2 else f"kind note{k} page{k} leaf{k}", "en", "src", 1) for k in more]
    tables["documents"] = tables["documents"].union(spark.createDataFrame(extra, tables["documents"].schema))
    tables["labels"] = tables["labels"].union(spark.createDataFrame([(k, 1, k % 2) for k in more], "doc_id long, quality int, toxic int"))
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    docs_now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs_now, str(tmp_path)).write.parquet(f"{tmp_path}/out{number}")
        docs_now = spark.read.parquet(f"{tmp_path}/out{number}")
        seen[name] = {r.doc_id: r for r in docs_now.collect()}
        if name != "bpe":
            assert docs_now.columns == tables["documents"].columns
    assert set(clean) <= set(seen["toxicity"]) and not {50, 51, 1001} & set(seen["toxicity"])
    assert 60 not in seen["line_dedup"] and set(clean) <= set(seen["line_dedup"])
    # One line goes, and with it its place in n_chars.
    assert seen["line_dedup"][61].text == clean[7] + " own words of another kind" and seen["line_dedup"][61].n_chars == len(clean[7] + " own words of another kind")
    assert {80, 81} <= set(seen["line_dedup"]) and len({80, 81} & set(seen["simhash"])) == 1
    assert 70 in seen["simhash"] and 70 not in seen["decontamination"]
    assert set(clean) <= set(seen["bpe"]) and all(r.decoded_equal for r in seen["bpe"].values())
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in ran.select(F.col("doc_id")).collect()} == set(seen["bpe"])
