import corpus_pipeline
import pytest
from tests.llm.test_operators import DOC, sample_rows

from impactlake.llm.common import written


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    letters = {"en": "the of and to in is was with ing tion", "fr": "le la des est dans pour que eau ment"}
    rows = [(100 + i, " ".join("".join(rng.choices(letters[k].split(), k=2)) for _ in range(rng.randrange(40, 200))), k, "s", 1) for i in range(120) for k in letters]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(sample_rows() + rows, DOC).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 200
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[-1]


def test_stages_take_an_empty_table(spark, sf_dir, tmp_path):
    docs = written(spark.createDataFrame([], DOC), "docs")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_repeated_passages_are_counted_in_words(spark, sf_dir):
    import random

    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(n))
    passage, short = own(51), own(49)
    assert len(passage) < 400
    a, b, c, d = own(80), own(70), own(60), own(90)
    texts = [f"{a} {passage} {b}", f"{c}\n{passage.replace(' ', chr(10))} é {d}", f"{a[:50]} {short}", f"{b[:40]} {short}", " ".join(["é" * 9] * 49), None]
    docs = written(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC), "docs")
    out = {r["doc_id"]: r for r in corpus_pipeline.repeated_passage_stage(spark, docs, sf_dir).collect()}
    assert out[0]["text"] == f"{a}  {b}" and out[1]["text"] == f"{c}\n é {d}"
    assert [out[i]["text"] for i in (2, 3, 4, 5)] == texts[2:]
    assert out[0]["n_chars"] == len(out[0]["text"])
