"""The pipeline, stage by stage, against brute force."""

import collections
import zlib

import corpus_pipeline as pipeline
import duckdb
import pytest
from strandloom.llm import decontamination, mixing, toxicity

from tests.llm import helpers
from tests.llm.test_free_style import brute_groups, brute_tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_stages(spark, tmp_path, extra):
    folder = helpers.write(tmp_path, extra=extra)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "token_shards"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = collections.Counter((r.doc_id, r.score < toxicity.THRESHOLD) for r in toxicity.score(docs, model).collect())
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter({i: n for (i, good), n in scores.items() if good})

    unique = stages["near_dedup"](spark, docs, folder)
    assert unique.columns == docs.columns
    whole = rows_of(docs)
    by_id = {r[0]: r[1] for r in whole}
    ids = sorted(by_id)
    roots, _ = brute_groups([by_id[i] for i in ids])
    assert rows_of(unique) == sorted((r for r in whole if ids[roots[ids.index(r[0])]] == r[0]), key=str)

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    clean = con.execute(f"WITH {decontamination.sql_hits('documents')} SELECT doc_id FROM judged WHERE NOT contaminated").fetchall()
    assert sorted(r[0] for r in rows_of(stages["decontamination"](spark, docs, folder))) == sorted(r[0] for r in clean)

    mixed = con.execute(f"WITH {mixing.sql_mix('documents')} SELECT doc_id, sum(copies) FROM mixed GROUP BY 1 HAVING sum(copies) > 0").fetchall()
    out = stages["mixing"](spark, docs, folder)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(dict(mixed))

    got = sorted((tuple(r) for r in stages["token_shards"](spark, out, folder).collect()), key=lambda r: r[1])
    assert got == brute_tokens(sorted(((r.doc_id, r.text) for r in out.collect()), key=lambda r: (r[0], r[1] or "")))


def test_stages_on_empty_tables_and_null_columns(spark, tmp_path):
    folder = helpers.write(tmp_path, empty=True)
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None)] * 2):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in pipeline.STAGES[:-1]:
            assert stage(spark, docs, folder).count() == (0 if name == "mixing" else len(rows)), name
        last = pipeline.STAGES[-1][1](spark, docs, folder)
        assert [(r.doc_id, r.start, r.n_tokens) for r in last.orderBy("start").collect()] == [(None, i, 1) for i in range(len(rows))]


def test_run_is_the_stages_in_order(spark, tmp_path):
    folder = helpers.write(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert collections.Counter(map(tuple, docs.collect())) == collections.Counter(map(tuple, pipeline.run(spark, folder).collect()))


def test_crc_fold_is_that_of_the_text_of_the_id(spark):
    from pyspark.sql import functions as F

    assert spark.range(50).select(F.crc32(F.col("id").cast("string")).alias("c")).collect() == [(zlib.crc32(str(i).encode()),) for i in range(50)]
