"""Files that tasks write in parts and a commit joins."""

import gzip

import pytest
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.sinks.committed import write_joined
from alleloom.sinks.text import ordered_lines, write_runfile, write_twobit
from alleloom.sources import runfile, twobit


def _rows(spark, n):
    return spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.lit(0).alias("j")).repartition(5).withColumn("data", F.encode(F.concat(F.col("k").cast("string"), F.lit(" ")), "utf-8"))


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("n", [0, 1, 3000])
def test_parts_are_joined_in_order(spark, tmp_path, n, aqe):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        write_joined(_rows(spark, n), str(tmp_path / "x"), b"head ")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert (tmp_path / "x").read_bytes() == b"head " + b"".join(b"%d " % i for i in range(n)) and [p.name for p in tmp_path.iterdir()] == ["x"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"old")
    bad = _rows(spark, 1000).withColumn("data", F.when(F.col("k") == 990, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        write_joined(bad, str(tmp_path / "x"))
    assert (tmp_path / "x").read_bytes() == b"old" and [p.name for p in tmp_path.iterdir()] == ["x"]


def test_lines_and_gzip(spark, tmp_path):
    lines = spark.range(2000).select("id", F.concat(F.lit("línea "), F.col("id").cast("string")).alias("line"))
    want = "head\n" + "".join(f"línea {i}\n" for i in range(2000))
    ordered_lines(lines, ["id"], str(tmp_path / "a.txt"), "head\n")
    ordered_lines(lines, ["id"], str(tmp_path / "a.gz"), "head\n", compress=True)
    ordered_lines(lines.limit(0), ["id"], str(tmp_path / "none.gz"), compress=True)
    assert (tmp_path / "a.txt").read_text() == want == gzip.decompress((tmp_path / "a.gz").read_bytes()).decode()
    assert len((tmp_path / "none.gz").read_bytes()) > 0 == len(gzip.decompress((tmp_path / "none.gz").read_bytes()))


def test_files_equal_those_made_whole(spark, tmp_path):
    texts = {0: "ACGTN" * 40 + "NN", 1: "", 2: "NNNNNNNNNNAC", 3: "TTTT"}
    contigs = spark.createDataFrame([(c, f"chr{c}", len(t)) for c, t in texts.items()], S.CONTIGS)
    chunks = spark.createDataFrame([(c, i, t[i : i + 8]) for c, t in texts.items() for i in range(0, len(t), 8)], S.CHUNKS).repartition(7)
    write_twobit(chunks, contigs, str(tmp_path / "a.2bit"))
    assert (tmp_path / "a.2bit").read_bytes() == twobit.write([f"chr{c}" for c in texts], [twobit.pack(t) for t in texts.values()])
    runs = spark.createDataFrame([(0, 0, 3, 90, S.EQS2), (0, 2, 0, 12, S.EQS1)], S.RUNS)
    write_runfile(runs, str(tmp_path / "a.run"), "ref", contigs)
    head = runfile.header("ref", runfile.token([f"chr{c}" for c in texts], [len(t) for t in texts.values()]))
    own = {r["chrom_ix"]: bytes(r["data"]) for r in runfile.encoded(runs).collect()}
    assert (tmp_path / "a.run").read_bytes() == head + b"".join(own.get(c, b"\0") for c in texts)
