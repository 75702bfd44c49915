"""Coerced flags, file hashes, flat records' ids and topic files."""

import hashlib

from pyspark.sql import functions as F

from impactlake.functions import text as T
from impactlake.operators import corpus, topics
from impactlake.sources import bundle


def test_coerced_flags_are_counted(spark):
    rows = spark.createDataFrame([(x,) for x in ("Sim", "no", "1", "0.5", "7", "maybe", "", None, " TRUE ", "nan?")], "s string")
    assert rows.agg(F.count_if(T.binary_coerced(F.col("s")))).first()[0] == 4
    assert rows.filter(T.binary_coerced(F.col("s"))).agg(F.sum(T.as_binary(F.col("s")))).first()[0] == 0


def test_file_hashes(spark, tmp_path):
    path = tmp_path / "a b.bin"
    path.write_bytes(b"x" * 100_000)
    want = hashlib.sha256(b"x" * 100_000).hexdigest()[:16]
    assert bundle.file_hash(spark, str(path)) == want and bundle.file_hash(spark, str(tmp_path / "none")) == "" and bundle.file_hash(spark, None) == ""
    got = {r["key"]: r["value"] for r in bundle.run_metadata(spark, {"a": 1}, {"input": str(path), "gold": None}).collect()}
    assert got["input_hash"] == want and got["gold_hash"] == "" and len(got["config_hash"]) == 16


def test_flat_records_have_ids_and_concepts(spark):
    concept = "array(named_struct('id', 'C1', 'display_name', 'One', 'level', 1, 'score', 0.5D), named_struct('id', 'C0', 'display_name', 'Top', 'level', 0, 'score', 0.9D))"
    who = "array(named_struct('author', named_struct('id', 'A1', 'display_name', 'x', 'orcid', ''), 'institutions', array(named_struct('ror', 'R1', 'display_name', 'i', 'country_code', 'PT'), named_struct('ror', string(null), 'display_name', 'j', 'country_code', 'PT'))))"
    works = spark.range(1).selectExpr("'W1' id", "'https://doi.org/10.1234/X' doi", "'t' title", "'2000' publication_year", "'3' cited_by_count", "false is_retracted", "'article' type", f"{concept} concepts", f"{who} authorships", "array('W2') referenced_works")
    row = corpus.flat_record(works, 1).first()
    assert (row["author_ids"], row["inst_ids"], row["n_affiliations"]) == (["A1"], ["R1"], 2) and [c["id"] for c in row["concepts_lvl"]] == ["C1"]


def test_topic_files(spark, tmp_path):
    assigned = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.7), (3, 1, 1.0)], "idx long, topic int, probability double")
    words = spark.createDataFrame([(0, i + 1, w, 1.0) for i, w in enumerate("abcde")], "topic int, position int, word string, weight double")
    topics.write_topics(assigned, words, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/out/topics", header=True).collect()} == {("0", "2", "0_a_b_c_d"), ("1", "1", "1")}
    assert spark.read.csv(f"{tmp_path}/out/doc_topics", header=True).columns == ["doc_id", "topic", "probability"]
