"""Plans that hold on large tables: what grows with the input is neither broadcast nor left to one task."""

import pytest
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.operators import filters as Q
from alleloom.operators import merge as M
from alleloom.operators import runs as R
from alleloom.operators.sweep import swept
from alleloom.plans import projections as P
from alleloom.sources import runfile


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_populations_are_merged_not_broadcast(spark):
    people = spark.createDataFrame([("a", "P0"), ("ab", "P1"), ("abc", "P2"), ("b", "P3"), ("é", "P4")], "name string, pop string")
    who = spark.createDataFrame([(0, "abX"), (1, "abcd"), (2, "ac"), (3, "b"), (4, "é.run")], "sample_ix int, label string")
    got = Q.assign_populations(who, people)
    assert "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(0, "abX", "P1"), (1, "abcd", "P2"), (2, "ac", "P0"), (3, "b", "P3"), (4, "é.run", "P4")]
    with pytest.raises(Exception, match="no individual for x"):
        Q.assign_populations(who.unionByName(who.limit(1).withColumn("label", F.lit("x"))), people).collect()
    with pytest.raises(Exception, match="several individuals for b"):
        Q.assign_populations(who, people.unionByName(people.where("name = 'b'"))).collect()


@pytest.fixture
def long_genome(spark, tmp_path):
    """A folder whose lineitem has calls up to position 400,000: seven chunks of each chromosome."""
    spark.range(4000).select((F.col("id") * 100 + F.col("id") % 7).alias("l_orderkey"), (F.col("id") * 7919 % 1009).alias("l_partkey"), (F.col("id") * 104729 % 97).alias("l_suppkey"), F.lit(1).alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_texts_are_made_and_compared_by_many_tasks(spark, long_genome):
    chunks = P.chunks(spark, long_genome)
    assert len({r["p"] for r in chunks.select(F.spark_partition_id().alias("p")).collect()}) > 1
    got = R.diff_chunks(chunks.withColumn("sample_ix", F.lit(0)), chunks)
    assert "Broadcast" not in plan(got)
    known = got.where(F.col("code") == S.EQS2).agg(F.sum(F.col("run_end") - F.col("run_start"))).first()[0]
    assert known == chunks.agg(F.sum(F.length(F.translate("seq", "N", "")))).first()[0]


def test_runs_are_joined_without_grouping(spark):
    rows = [(0, 0, i * 10, i * 10 + 10, S.EQS2) for i in range(40)] + [(0, 0, 400, 401, S.TRANS2), (0, 0, 401, 405, S.NS), (0, 0, 409, 410, S.NS)]
    got = R._islands(spark.createDataFrame(rows, S.RUNS), R.KEY, R.KEY)
    assert "Aggregate" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 0, 400, S.EQS2), *rows[40:]]


def test_no_call_is_looked_for_along_a_whole_chromosome(spark, long_genome):
    """Windows over (sample, chromosome) see a row for each bin, not the calls."""
    runs = P.runs(spark, long_genome)
    calls = sorted(map(tuple, P.points(spark, long_genome).select("sample_ix", "chrom_ix", "pos", "code").collect()))
    after = {a[:3]: b[2] for a, b in zip(calls, calls[1:], strict=False) if a[:2] == b[:2]}
    assert sorted(map(tuple, runs.collect())) == [(i, c, p, after.get((i, c, p), p + 1) if code in S.STRETCHES else p + 1, code) for i, c, p, code in calls]
    assert len({p // P.WIDTH for _, _, p, _ in calls}) == 7
    long = [x for x in plan(runs).splitlines() if "windowspecdefinition" in x and "_bin" not in x]
    assert not long, long
    for x in plan(runs).splitlines():
        if "lead(pos" in x:
            assert "_bin" in x.split("windowspecdefinition(")[1].split(" ASC")[0]


def test_partitions_of_runs_stay_as_many(spark, long_genome):
    """Adaptive execution doesn't put partitions of runs together, whose compressed size says little."""
    runs = P.runs(spark, long_genome)
    for df in (R.normalize(runs), swept(runs, P.N_SAMPLES, within=[runs.select("chrom_ix", F.col("run_start").alias("s"), F.col("run_end").alias("e"))])):
        sizes = [x for x in plan(df).splitlines() if "Exchange hashpartitioning" in x and ("_bin" in x or "bin#" in x)]
        assert sizes and all("REPARTITION_BY_NUM" in x for x in sizes)


def test_gaps_meet_only_their_own_regions(spark):
    """No join of all gaps of a bin with all its regions; a gap over many bins and regions is whole again."""
    points = spark.createDataFrame([(0, 0, 5, S.TRANS2), (0, 0, 90000, S.TRANS2), (1, 0, 39999, S.TRANS2)], "sample_ix int, chrom_ix int, pos int, code int")
    contigs, bed = spark.createDataFrame([(0, "1", 100000)], S.CONTIGS), [(0, 0, 3), (0, 10, 20), (0, 15, 40000), (0, 40002, 95000)]
    got = R.gap_fill_patches(points, contigs, spark.createDataFrame(bed, S.BED))
    assert not [x for x in plan(got).splitlines() if "Join" in x and "bin" in x]
    g, b = S.EQS2, S.NS
    want = [(0, 0, 3, g), (0, 3, 5, b), (0, 5, 6, S.TRANS2), (0, 6, 10, b), (0, 10, 40000, g), (0, 40000, 40002, b), (0, 40002, 90000, g), (0, 90000, 90001, S.TRANS2), (0, 90001, 95000, g), (0, 95000, 100000, b)]
    want += [(1, 0, 3, g), (1, 3, 10, b), (1, 10, 39999, g), (1, 39999, 40000, S.TRANS2), (1, 40000, 40002, b), (1, 40002, 95000, g), (1, 95000, 100000, b)]
    assert sorted((r["sample_ix"], r["run_start"], r["run_end"], r["code"]) for r in got.collect()) == want


@pytest.mark.parametrize("width", [4, 50, 65536])
def test_run_files_are_made_in_pieces(spark, width):
    """The pieces of a chromosome are its bytes, wherever bins end, and each can be decoded alone."""
    one = [(S.NS, 3, None), (S.EQS2, 40, None), (S.INS1, 2, "AC"), (S.EQS2, 200, None), (S.TRANS2, 1, None), (S.DEL1, 2, None), (S.NS, 90, None), (S.EQS1, 7, None), (S.TRANS1, 1, None)]
    rows = [(i, c, *x) for i, c in ((0, 0), (0, 2), (3, 1)) for x in runfile.positioned(one)]
    # stretches in bits, and the uncalled ones left out
    cut = [(*r[:2], a, min(a + 9, r[3]), *r[4:]) if r[4] in S.STRETCHES else r for r in rows if r[4] != S.NS for a in range(r[2], max(r[3], r[2] + 1), 9 if r[4] in S.STRETCHES else 1 << 20)]
    got = runfile.encoded(spark.createDataFrame(cut, S.RUNS_INS).repartition(3), width)
    pieces = sorted((r["sample_ix"], r["chrom_ix"], r["start"], bytes(r["data"])) for r in got.collect())
    assert len(pieces) == len({p[:3] for p in pieces}) and (width > 100 or len(pieces) > 6)
    for key in ((0, 0), (0, 2), (3, 1)):
        assert b"".join(p[3] for p in pieces if p[:2] == key) == runfile.encode(one)
    assert sorted(map(tuple, runfile.decoded(got).collect()), key=str) == sorted(rows, key=str)
    assert "FlatMapGroups" not in plan(got)


def test_reference_bases_meet_calls_in_as_many_partitions(spark, long_genome):
    m = M.merge_ref(P.runs(spark, long_genome), M.bases_of(P.chunks(spark, long_genome)), P.N_SAMPLES)
    sides = [x for x in plan(m).splitlines() if "hashpartitioning(chrom_ix" in x and "pos#" in x]
    assert len(sides) == 2 and all("REPARTITION_BY_NUM" in x for x in sides)
