"""Readers and writers of sequence and annotation files."""

import gzip

from pyspark.sql import functions as F

from strandloom.sources import annotation as A
from strandloom.sources import sequences as Q


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">t1 cdna chr:1 gene:G1.2 x\nacgt\nAC\n>t2 cdna chr:2 gene:G2\nTTT\n>t3\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nGG\nCC\n")
    got = {r.header.split(" ")[0]: r.seq for r in Q.read_fasta(spark, f"{tmp_path}/*.fa*").collect()}
    assert got == {"t1": "ACGTAC", "t2": "TTT", "t3": "", "z": "GGCC"}
    genes = {r.transcript_id: r.gene for r in Q.read_cdna(spark, f"{tmp_path}/a.fa").collect()}
    assert genes["t1"] == "G1.2" and genes["t2"] == "G2"
    assert {r.chr for r in Q.read_genome(spark, str(tmp_path)).collect()} == {"a", "b"}
    Q.write_fasta(spark.createDataFrame([("h", "ACG")], "n string, seq string"), f"{tmp_path}/out", F.col("n"))
    assert Q.read_fasta(spark, f"{tmp_path}/out/part*").first().seq == "ACG"


def test_fastq_pairs(spark, tmp_path):
    for name, reads in (("l", ["ACGT", "CCCC"]), ("r", ["GGTT", "AAAA"])):
        with gzip.open(tmp_path / f"{name}.fq.gz", "wt") as f:
            f.write("".join(f"@{name}{i}\n{s.lower()}\n+\nIIII\n" for i, s in enumerate(reads)))
    got = Q.read_pairs(spark, f"{tmp_path}/l.fq.gz", f"{tmp_path}/r.fq.gz").orderBy("read_index").collect()
    assert [(r.left.seq, r.right.seq, r.left.header) for r in got] == [("ACGT", "GGTT", "l0"), ("CCCC", "AAAA", "l1")]
    assert Q.read_fastq(spark, f"{tmp_path}/l.fq.gz").orderBy("read_index").first().qual == "IIII"


def test_lists(spark, tmp_path):
    import pytest

    (tmp_path / "x").write_text("hello")
    (tmp_path / "list").write_text(f"{tmp_path}/x\n\n")
    assert Q.listed_files(spark, f"{tmp_path}/list") == [f"{tmp_path}/x"]
    (tmp_path / "bad").write_text(f"{tmp_path}/missing\n")
    with pytest.raises(FileNotFoundError):
        Q.listed_files(spark, f"{tmp_path}/bad")


def test_bubbles_and_difference(spark, tmp_path):
    (tmp_path / "b.fa").write_text(">Bubble_7_x\nAC\n>Bubble_7_y\nACG\n>Bubble_9_x\nT\n>Bubble_9_y\nTT\n")
    got = {r.id: (r.a, r.b) for r in Q.read_bubble_fasta(spark, f"{tmp_path}/b.fa").collect()}
    assert got == {0: ("AC", "ACG"), 1: ("T", "TT")}
    a = spark.createDataFrame([("ac",), ("GG",)], "seq string")
    b = spark.createDataFrame([("AC",), ("TT",)], "seq string")
    assert {(r.side, r.seq) for r in Q.fasta_difference(a, b).collect()} == {("a", "GG"), ("b", "TT")}


GTF = """#!comment
1\thav\tgene\t1\t90\t.\t+\t.\tgene_id "G1"; gene_name "N1";
1\thav\ttranscript\t1\t90\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1";
1\thav\texon\t50\t90\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1";
1\thav\texon\t1\t20\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N1";
1\thav\tas_event\t1\t90\t.\t+\t.\ttranscript_id "T1/T2,T3"; gene_id "G1"; flanks "20^,50-"; splice_chain "30-40^,";
2\thav\texon\t5\t9\t.\t-\t.\tgene_id "G2"; transcript_id "T9"; gene_name "N2";
"""


def test_gtf(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(GTF)
    path = f"{tmp_path}/a.gtf"
    exons = {r.transcript_id: [(e.start, e.end) for e in r.exons] for r in A.read_exons(spark, path).collect()}
    assert exons == {"T1": [(1, 20), (50, 90)], "T9": [(5, 9)]}
    assert [tuple(r) for r in A.read_transcripts(spark, path).collect()] == [("G1", "T1")]
    event = A.read_events(spark, path).first()
    assert (event.transcripts_1, event.transcripts_2, event.chain_1) == ("T1/T2", "T3", "30-40^")
    genes = spark.createDataFrame([("G2",)], "gene_id string")
    assert A.genes_in_list(A.read_gtf(spark, path), genes).count() == 1
    A.split_by_gene(A.read_gtf(spark, path), f"{tmp_path}/split")
    assert spark.read.parquet(f"{tmp_path}/split/gene_id=G2").count() == 1


def test_graph_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "FF")], A.EDGES)
    A.write_tsv(rows, f"{tmp_path}/edges")
    assert A.read_tsv(spark, f"{tmp_path}/edges", A.EDGES).collect() == rows.collect()
    transcripts = spark.createDataFrame([(7, "t7", "ACGTACGT")], "read_index long, header string, seq string")
    columns = "read_index long, bubble_id int, label string, event_type string, representative boolean, orig_path string, path string, orig_seq string, alt_seq string, n_branches int, edit_distance int"
    found = spark.createDataFrame([(7, 1, "AS", "AS", True, "1_F 2_F", "1_F 3_R", "ACG", "ACGG", 2, 1), (7, 2, "IR", "SNP", False, "1_F", "3_R", "AC", "AG", 0, 1)], columns)
    A.write_bubbles(found, transcripts, f"{tmp_path}/bubbles")
    read = lambda kind, event: [r.value for r in spark.read.text(f"{tmp_path}/bubbles/kind={kind}/event_type={event}").collect()]
    assert read("blat", "AS") == [">t7", "ACGTACGT", ">Bubble_id=0;Length=4;Novel_AS_sequence", "ACGG"]
    assert read("blat.clustered", "SNP") == [">t7", "ACGTACGT"]
    detailed = read("bubbles.detailed", "SNP")
    assert detailed[0] == ">Bubble_id=1;Transcript=t7;Length=2;Branches=N/A;Original_LR_sequence;Edit_distance=1;Read_index=7;Path=1_F"
    assert detailed[2] == ">Bubble_id=1;Transcript=Novel;Length=2;Branches=0;Novel_intron_sequence;Edit_distance=1;Read_index=7;Path=3_R"
