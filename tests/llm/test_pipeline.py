"""The pipeline's stages on the smallest tables and on odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "packing"]
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] and counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == counts[4]


def test_run_leaves_no_stage_folder(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(corpus_pipeline.new_path(spark, "x")).getParent()
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = corpus_pipeline.run(spark, SF)
    assert not [f for f in files.listStatus(path) if "leafmend-stage-" in f.getPath().getName()]
    assert rows.count() > 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Null, repeated and shared ids, null and empty texts, and columns named like the operators'."""
    long_ = " ".join(f"word{i % 97} next{i}" for i in range(3000))
    rows = [(1, "one small river ran past the old mill here", "a"), (1, "one small river ran past the old mill here", "a"), (1, "nothing at all like the other text of this id", "b")]
    rows += [(None, "a row without any id of its own is still a row", "a"), (None, None, None), (2, "", "b"), (3, long_, "b"), (4, 'pwd = "Xq7#vT9!pLz2zzQ" and more words', "a")]
    df = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    for name in ("score", "predicted", "spans", "n_hex", "clean_text", "_doc", "component_id", "copies", "row", "size", "document", "_row"):
        df = df.withColumn(name, F.lit("own"))
    return df


def test_stages_keep_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    rows = Counter(odd.collect())
    kept = Counter(stages["toxicity"](spark, odd, SF).collect())
    assert kept == rows
    left = stages["simhash"](spark, odd, SF)
    assert left.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter({k: 1 for k in {(r.doc_id, r.text) for r in rows if r.text}} | {(2, ""): 1})
    masked = stages["secrets"](spark, odd, SF).collect()
    changed = [r for r in masked if r.text and "[SECRET]" in r.text]
    assert len(masked) == sum(rows.values()) and [(r.doc_id, r.n_chars == len(r.text)) for r in changed] == [(4, True)]
    assert Counter(r for r in masked if r.doc_id != 4) == Counter({r: n for r, n in rows.items() if r.doc_id != 4})
    mix = Counter(stages["mixing"](spark, odd, SF).collect())
    assert all(n <= 2 * rows[r] and r.text for r, n in mix.items())
    pieces = stages["packing"](spark, odd, SF).collect()
    assert sum(p.piece == 0 for p in pieces) == sum(rows.values())
