"""The whole run over files: a skipped exon comes out as a bubble."""

import random

from strandloom.operators import mapping, unitigs
from strandloom.plans import enhance


def test_skipped_exon_from_files(spark, tmp_path):
    rng = random.Random(21)
    a, b, c = ("".join(rng.choice("ACGT") for _ in range(70)) for _ in range(3))
    a, b, c = a + "G", "A" + b + "T", "C" + c  # the isoforms part right at the exon's ends
    known, skipped = a + b + c, a + c
    (tmp_path / "t.fa").write_text(f">t1\n{known}\n")
    reads = [known, known, skipped, skipped, skipped]
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    (tmp_path / "list").write_text(f"{tmp_path}/r.fq\n")
    out = f"{tmp_path}/out"
    enhance.main(["-t", f"{tmp_path}/t.fa", "-sesr", f"{tmp_path}/list", "-k", "15", "-prefix", out, "-min_edit_distance", "0.1"])
    found = spark.read.parquet(f"{out}/bubbles").collect()
    assert [(r.orig_seq, r.alt_seq) for r in found] == [(known[71 - 15 : 71 + 72 + 15], skipped[71 - 15 : 71 + 15])]
    nodes, blue = spark.read.parquet(f"{out}/unitigs"), spark.read.parquet(f"{out}/tr_mapping")
    assert mapping.reassembled(blue, nodes, spark.read.parquet(f"{out}/transcripts"), 15).first().same is True
    assert spark.read.text(f"{out}/final_stats").count() == 16
    assert spark.read.text(f"{out}/alternative_paths/kind=bubbles.detailed/event_type=AS").count() == 4
    again = enhance.run(spark, enhance.Options(f"{tmp_path}/t.fa", f"{tmp_path}/list", prefix=out, k=15, min_edit_distance=0.1, skip_sr=True, skip_tr=True, skip_merged=True, skip_mapping=True))
    assert again.count() == len(found)
    assert unitigs.unitig_edges(nodes, 15).count() > 0


def test_options(spark):
    import pytest

    with pytest.raises(ValueError):
        enhance.Options("t.fa").check()
    with pytest.raises(ValueError):
        enhance.Options("t.fa", "r", k=64).check()
