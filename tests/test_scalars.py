"""Sums of codes in one pass over the texts, and the letters of awkward texts."""

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.functions import superkmers as M
from strandloom.plans import queries


def test_sums_of_codes_equal_those_of_single_kmers(spark):
    rows = spark.createDataFrame([(1, "ACGTTGCAACGGTATTCAG"), (2, "ACG"), (3, "ACGTNACGTAACCGT"), (4, ""), (5, None)], "id long, seq string")
    every = S.explode_kmers(rows, 5, "id").where(F.col("kmer").rlike("^[ACGT]+$"))
    sums = every.groupBy("id").agg(F.sum(S.pack(S.canonical(F.col("kmer")))), F.sum(S.pack(F.col("kmer"))), F.sum(S.pack(S.minimizer(F.col("kmer"), 3))))
    expected = rows.select("id").join(sums, "id", "left")
    assert sorted(M.code_sums(rows, 5, 3, "id").collect()) == sorted(expected.collect())


def test_letters_of_awkward_texts(spark):
    texts = ["aB-c d\x00e\n", "Kİx", "é中\U0001f600z", "", None]
    old = F.translate(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", ("ACGT" * 7)[:26])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(old.alias("a"), S.encode_text(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_scalars_need_no_row_for_each_kmer(spark, tmp_path):
    spark.createDataFrame([(1, "src0", "some text of more than twenty-one letters")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.sequence_scalars(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
