"""Greedy blocks of a stream equal those of the batch, each handed out once."""

import random

import pytest
from pyspark.sql import functions as F

from alleloom.operators.stats import greedy_blocks
from alleloom.streaming.positions import closed_blocks

SCHEMA = "chrom_ix int, pos int, n_ref int, n_alt int, extra string"


def _stream(spark, folder, name, triggers, size):
    """Runs the stream, one trigger after another; gives the blocks that each trigger has handed out."""
    (folder / "in").mkdir(parents=True)
    q = closed_blocks(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")), size).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).start()
    told, seen = [], 0
    try:
        for rows in triggers:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            q.processAllAvailable()
            now = spark.table(name).collect()
            told.append(sorted(map(tuple, now))[:] if not seen else sorted(set(map(tuple, now)) - set(map(tuple, before))))
            assert len(now) == len(set(now))
            before, seen = now, len(now)
    finally:
        q.stop()
    return told


def test_a_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, r.randrange(4000), r.randrange(3), r.choice([0, 1, None]), "x") for c in (0, 3) for _ in range(150)]
    rows += [(0, rows[10][1], 1, 1, "again")]  # one position twice
    parts = [[], [], []]
    for row in rows:
        parts[min(2, row[1] // 1500)].append(row)
    for p in parts:
        r.shuffle(p)
    told = _stream(spark, tmp_path, "ordered", [*parts, [(0, None, None, None, "end")], [(3, None, None, None, "end")]], 130)
    df = spark.createDataFrame(rows, SCHEMA)
    want = greedy_blocks(df, 130).groupBy("chrom_ix", "block").agg(F.count("*"), F.countDistinct("pos"), F.sum("n_ref"), F.sum(F.coalesce("n_alt", F.lit(0))))
    assert sorted(sum(told, [])) == sorted(map(tuple, want.collect()))
    assert [len(t) > 5 for t in told[:3]] == [True] * 3 and [[x[0] for x in t] for t in told[3:]] == [[0], [3]]
    assert all(b[1] + 130 <= 3000 for t in told[:2] for b in t)


@pytest.mark.parametrize("bad", [[(1, 40, 1, 0, "")], "ended"])
def test_disorder_stops_the_stream(spark, tmp_path, bad):
    name = "ended" if bad == "ended" else "disorder"
    triggers = [[(1, 50, 1, 0, ""), (1, 10, 1, 0, "")], [(1, None, 0, 0, "")], [(1, 90, 1, 0, "")]] if bad == "ended" else [[(1, 50, 1, 0, "")], [(1, 50, 1, 0, "")], bad]
    with pytest.raises(Exception, match="rows come after its end" if bad == "ended" else "position 40 comes after 50"):
        _stream(spark, tmp_path, name, triggers, 20)
