"""Registered queries that write files in every supported format and read them back.

Each has its SQL beside it, over the tables that the files were made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import encode_text, reverse_complement
from strandloom.operators import kmers, unitigs
from strandloom.plans.checkpoints import folder, written
from strandloom.plans.oracle import MAPPED, SEQS, _counted, _encode, _rc
from strandloom.plans.queries import MAP_K, K, _reads
from strandloom.plans.tables import contigs, items, sequences, table
from strandloom.sources import annotation
from strandloom.sources import sequences as Q
from strandloom.streaming import lookup

#: Letters on each line of a wrapped sequence, and bytes of a range of a FASTQ file.
LINE, RANGE = 60, 256_000


def fasta_records(spark, sf_dir):
    """Sequences in lower case and wrapped lines, found through a file of file names."""
    rows = sequences(spark, sf_dir)
    wrapped = F.regexp_replace(F.lower("seq"), f"(.{{{LINE}}})", "$1\n")
    path, names = folder(spark, "fasta"), folder(spark, "names")
    Q.write_fasta(rows.withColumn("wrapped", wrapped), path, F.concat(F.lit("r"), F.col("read_index").cast("string")), "wrapped")
    spark.createDataFrame([(path,), ("",)], "value string").write.text(names)
    return Q.read_fasta(spark, *Q.listed_files(spark, names)).select("header", F.md5("seq").alias("seq"), F.char_length("seq").alias("n"))


def fastq_pairs(spark, sf_dir):
    """Mates by their places: rows of even ids from gzip files, of odd ids from plain ones, many parts each.

    Plain parts are read in small ranges, so records lie across their borders.
    """
    rows = sequences(spark, sf_dir).where("seq <> ''")
    paths, parts = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rest in (0, 1):
        side = rows.where(F.col("read_index") % 2 == rest).repartitionByRange(parts, "read_index").sortWithinPartitions("read_index")
        record = F.concat(F.lit("@r"), F.col("read_index").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("@"), F.char_length("seq")))
        paths.append(folder(spark, "fastq"))
        side.select(record).write.option("compression", "none" if rest else "gzip").text(paths[-1])
    pairs = Q.read_pairs(spark, *paths, split=RANGE)
    return pairs.select("read_index", *(F.col(f"{side}.header").alias(f"{side}_header") for side in ("left", "right")), *(F.md5(f"{side}.seq").alias(f"{side}_seq") for side in ("left", "right")))


def unitig_files(spark, sf_dir):
    """Unitigs as FASTA, their coverages, number, node and coloured-node tables."""
    rows = items(spark, sf_dir).select("unitig_id", "seq", F.char_length("seq").alias("len"), (F.col("unitig_id") / 2).alias("coverage"))
    path = folder(spark, "unitigs")
    Q.write_unitigs(rows, path)
    annotation.write_tsv(rows.select("unitig_id", "seq"), f"{path}/nodes")
    coloured = rows.select("unitig_id", (F.col("len") > 100).alias("trustable"), F.col("len").cast("long").alias("tr_count"), F.col("unitig_id").alias("sr_count"), "seq")
    annotation.write_tsv(coloured, f"{path}/coloured")
    header = F.split(F.trim("header"), "__len__")
    fasta = Q.read_fasta(spark, f"{path}/unitigs").select(F.get(header, F.lit(0)).cast("long").alias("unitig_id"), F.get(header, F.lit(1)).cast("int").alias("len"), F.md5("seq").alias("seq"))
    nodes = annotation.read_tsv(spark, f"{path}/nodes", annotation.NODES).select("unitig_id", F.md5("seq").alias("node_seq"))
    colours = annotation.read_tsv(spark, f"{path}/coloured", annotation.COLOURED).drop("seq")
    total = Q.read_unitig_count(spark, path)
    return fasta.join(nodes, "unitig_id").join(colours, "unitig_id").join(spark.read.parquet(f"{path}/coverage"), "unitig_id").withColumn("unitigs", F.lit(total))


def bubble_fasta(spark, sf_dir):
    """Bubbles of consecutive records, with repaired headers, of which only some names are kept."""
    rows = items(spark, sf_dir).select(F.col("unitig_id").alias("id"), "seq").orderBy("id")
    two = F.array(F.struct(F.lit("upper").alias("side"), F.col("seq").alias("s")), F.struct(F.lit("lower").alias("side"), reverse_complement(F.col("seq")).alias("s")))
    records = rows.select("id", F.posexplode(two).alias("n", "x")).orderBy("id", "n")
    path = folder(spark, "bubbles")
    records.select(F.concat(F.lit(">Bubble_x_"), F.col("id").cast("string"), F.lit("_"), "x.side", F.lit("\n"), "x.s")).coalesce(1).write.text(path)
    got = Q.bubbles_with(Q.read_bubble_fasta(spark, path), "Bubble_x", "1")
    return got.select("id", Q.paired_header(F.col("a_header"), F.col("id") * 2).alias("header"), F.md5("a").alias("a"), F.md5("b").alias("b"))


def fasta_differences(spark, sf_dir):
    """Sequences that only one of two sets has: all documents, and those of even ids in lower case."""
    rows = sequences(spark, sf_dir).select("read_index", "seq")
    return Q.fasta_difference(rows, rows.where("read_index % 2 = 0").withColumn("seq", F.lower("seq"))).select(F.md5("seq").alias("seq"), "side")


def kmer_dump(spark, sf_dir):
    """Histogram of k-mer counts, from the dump of a count: binary columns and text lines."""
    path = folder(spark, "dump")
    kmers.write_dump(kmers.count_kmers(_reads(spark, sf_dir, True), K, pack=True), path, K)
    return kmers.read_dump(spark, path).groupBy("n").agg(F.count("*").alias("kmers"), F.min("kmer").alias("first"), F.max("kmer").alias("last"))


def distinct_kmers(spark, sf_dir):
    """Number of distinct k-mers, and whether the sketch's estimate lies within 10 % of it."""
    counted = kmers.count_kmers(sequences(spark, sf_dir), K, pack=True)
    return counted.agg(F.count("*").alias("kmers"), F.approx_count_distinct("kmer", 0.02).alias("estimate")).select("kmers", (F.abs(F.col("estimate") / F.col("kmers") - 1) < 0.1).alias("close"))


def _gtf_lines(spark, sf_dir) -> DataFrame:
    order = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem")
    attrs = F.format_string('gene_id "G%d"; transcript_id "T%d"; gene_name "N%d"; tag "basic"; tag "x";', order % 100, order, order % 100)
    start = F.col("l_partkey") * 10
    place = [F.concat(F.lit("chr"), (order % 5).cast("string")), F.lit("made"), F.lit("exon"), start.cast("string"), (start + F.col("l_quantity").cast("long")).cast("string"), F.lit("."), F.when(order % 2 == 0, "+").otherwise("-"), F.lit("."), attrs]
    exon = lines.select(F.concat_ws("\t", *place).alias("value"))
    place[2], place[3], place[4] = F.lit("transcript"), F.lit("1"), F.lit("2")
    return exon.unionByName(lines.select(F.concat_ws("\t", *place).alias("value")).distinct()).unionByName(spark.createDataFrame([("#!comment",)], "value string"))


def gtf_exons(spark, sf_dir):
    """Exons of each transcript of an annotation file, with the neighbours of the first one."""
    path = folder(spark, "gtf")
    _gtf_lines(spark, sf_dir).write.text(path)
    rows = annotation.read_exons(spark, path)
    first, last = F.get("exons", F.lit(0)), F.get("exons", F.size("exons") - 1)
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"] + 1)
    return rows.select("transcript_id", "gene_name", "chr", "strand", F.size("exons").alias("exons"), first["start"].alias("first"), last["start"].alias("last"), length.alias("bases"))


def gtf_genes(spark, sf_dir):
    """Transcripts of the listed genes on two chromosomes, from one folder for each gene."""
    path = folder(spark, "gtf")
    _gtf_lines(spark, sf_dir).write.text(path)
    genes = spark.range(0, 100, 2).select(F.concat(F.lit("G"), F.col("id").cast("string")).alias("gene_id"))
    genes.coalesce(1).write.csv(f"{path}-list", sep="\t", header=True)
    rows = annotation.on_chromosomes(annotation.read_gtf(spark, path, feature="transcript"), "chr1", "chr2")
    annotation.split_by_gene(annotation.genes_in_list(rows, annotation.read_gene_list(spark, f"{path}-list")), f"{path}-genes")
    split = spark.read.parquet(f"{path}-genes").select("gene_id", annotation.attribute("transcript_id").alias("transcript_id"))
    return annotation.gene_transcripts(split).select("gene_id", F.size("transcripts").alias("transcripts"), F.md5(F.array_join("transcripts", ",")).alias("names"))


def cdna_genes(spark, sf_dir):
    """Records, bases and selected transcripts of each gene of a cDNA file."""
    path = folder(spark, "cdna")
    header = F.format_string("T%d cdna chromosome:X:1:2:3 gene:G%d gene_biotype:x", F.col("read_index"), F.col("read_index") % 7)
    Q.write_fasta(sequences(spark, sf_dir), path, header)
    rows = Q.read_cdna(spark, path)
    ids = spark.range(0, 1000, 3).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("transcript_id"))
    picked = Q.records_with(rows, ids).groupBy("gene").agg(F.count("*").alias("picked"))
    return rows.groupBy("gene").agg(F.count("*").alias("records"), F.sum(F.char_length("seq")).alias("bases")).join(picked, "gene", "left")


def stream_unitig_hits(spark, sf_dir):
    """Running counts of hits of each unitig, from a stream of all documents."""
    docs = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    reads = stream.select(F.col("doc_id").alias("read_index"), encode_text(F.col("text")).alias("seq"))
    index = written(unitigs.index(contigs(spark, sf_dir), MAP_K), "index")
    name, base = f"hits_{folder(spark, 'x').rsplit('-', 1)[1]}", folder(spark, "stream")
    query = lookup.stream_unitig_counts(reads, index, MAP_K).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", base).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


QUERIES = {
    f.__name__: f
    for f in (
        fasta_records, fastq_pairs, unitig_files, bubble_fasta, fasta_differences, kmer_dump, distinct_kmers, gtf_exons, gtf_genes, cdna_genes,
        stream_unitig_hits,
    )
}

_WHOLE = f"whole AS (SELECT * FROM (SELECT item_id AS unitig_id, {_encode('text')} AS seq FROM benchmark) WHERE seq <> '')"

ORACLE = {
    "fasta_records": f"WITH {SEQS} SELECT 'r' || read_index AS header, md5(seq) AS seq, CAST(length(seq) AS INTEGER) AS n FROM seqs",
    "fastq_pairs": f"""WITH {SEQS}, s AS (
          SELECT read_index % 2 AS side, row_number() OVER (PARTITION BY read_index % 2 ORDER BY read_index) - 1 AS read_index, 'r' || read_index AS header, md5(seq) AS seq FROM seqs WHERE seq <> '')
        SELECT a.read_index, a.header AS left_header, b.header AS right_header, a.seq AS left_seq, b.seq AS right_seq FROM s a JOIN s b ON a.side = 0 AND b.side = 1 AND a.read_index = b.read_index""",
    "unitig_files": f"""WITH {_WHOLE} SELECT unitig_id, CAST(length(seq) AS INTEGER) AS len, md5(seq) AS seq, md5(seq) AS node_seq, length(seq) > 100 AS trustable, length(seq) AS tr_count,
        unitig_id AS sr_count, unitig_id / 2 AS coverage, (SELECT count(*) FROM whole) AS unitigs FROM whole""",
    "bubble_fasta": f"""WITH {_WHOLE}, n AS (SELECT row_number() OVER (ORDER BY unitig_id) - 1 AS id, unitig_id, seq FROM whole)
        SELECT id, 'Bubble_x_' || id AS header, md5(seq) AS a, md5({_rc("seq")}) AS b FROM n WHERE contains('Bubble_x_' || unitig_id, '1')""",
    "fasta_differences": f"""WITH {SEQS}, e AS (SELECT seq FROM seqs WHERE read_index % 2 = 0)
        SELECT md5(seq) AS seq, 'a' AS side FROM (SELECT seq FROM seqs EXCEPT ALL SELECT seq FROM e) UNION ALL SELECT md5(seq), 'b' FROM (SELECT seq FROM e EXCEPT ALL SELECT seq FROM seqs)""",
    "kmer_dump": f"WITH {SEQS} SELECT n, count(*) AS kmers, min(kmer) AS first, max(kmer) AS last FROM ({_counted('tr', 1)}) GROUP BY n",
    "distinct_kmers": f"WITH {SEQS} SELECT count(*) AS kmers, true AS close FROM ({_counted('seqs', 1)})",
    "gtf_exons": """WITH e AS (SELECT *, l_partkey * 10 AS s, l_partkey * 10 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
        SELECT 'T' || l_orderkey AS transcript_id, 'N' || l_orderkey % 100 AS gene_name, 'chr' || l_orderkey % 5 AS chr, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
               CAST(count(*) AS INTEGER) AS exons, CAST(min(s) AS INTEGER) AS first, CAST(max(s) AS INTEGER) AS last, CAST(sum(e - s + 1) AS BIGINT) AS bases FROM e GROUP BY l_orderkey""",
    "gtf_genes": """WITH t AS (SELECT DISTINCT 'G' || l_orderkey % 100 AS gene_id, 'T' || l_orderkey AS t FROM lineitem WHERE l_orderkey % 2 = 0 AND l_orderkey % 5 IN (1, 2))
        SELECT gene_id, CAST(count(*) AS INTEGER) AS transcripts, md5(string_agg(t, ',' ORDER BY t)) AS names FROM t GROUP BY gene_id""",
    "cdna_genes": f"""WITH {SEQS} SELECT 'G' || read_index % 7 AS gene, count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS bases,
        nullif(count(*) FILTER (read_index < 1000 AND read_index % 3 = 0), 0) AS picked FROM seqs GROUP BY 1""",
    "stream_unitig_hits": f"WITH {MAPPED} SELECT unitig_id, count(*) AS hits FROM hits GROUP BY unitig_id",
}
