"""Point calls, runs, regions, reference and populations projected from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.operators.sweep import dealt

N_SAMPLES, N_CHROMS = 6, 3
#: Bin width of range joins and letters of a reference chunk, as in use.
WIDTH = 65536
CHUNK = 65536
POPULATIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "AFRICA")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_ix, chrom_ix, pos, code), several for one position."""
    code = ((F.col("l_partkey") + F.col("l_linenumber") * 7) % 15).cast("int").alias("code")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 6).cast("int").alias("sample_ix"), (F.col("l_partkey") % 3).cast("int").alias("chrom_ix"), F.col("l_orderkey").cast("int").alias("pos"), code)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: (sample_ix, chrom_ix, pos, code)."""
    return _calls(spark, sf_dir).groupBy("sample_ix", "chrom_ix", "pos").agg(F.min("code").alias("code"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: stretches reach to the sample's next call, point calls have length 1, the rest is uncalled. Calls are dealt out by bin
    once, and the next call is looked for there; only that of a bin's last call lies in another one, whose first call is known
    from a row for each bin."""
    key = ("sample_ix", "chrom_ix")
    p = dealt(_calls(spark, sf_dir).withColumn("_bin", F.floor(F.col("pos") / WIDTH)), *key, "_bin").groupBy(*key, "_bin", "pos").agg(F.min("code").alias("code"))
    inner = p.withColumn("_next", F.lead("pos").over(Window.partitionBy(*key, "_bin").orderBy("pos"))).where("_next is not null")
    bins = p.groupBy(*key, "_bin").agg(F.min("pos").alias("first"), F.max(F.struct("pos", "code")).alias("last"))
    last = bins.select(*key, "last.pos", "last.code", F.lead("first").over(Window.partitionBy(*key).orderBy("_bin")).alias("_next"))
    every = inner.select(*key, "pos", "code", "_next").unionByName(last)
    end = F.when(F.col("code").isin(*S.STRETCHES), F.coalesce("_next", F.col("pos") + 1)).otherwise(F.col("pos") + 1)
    return every.select(*key, F.col("pos").alias("run_start"), end.alias("run_end"), "code")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for every order: some overlap, some touch."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 3).cast("int").alias("chrom_ix"), F.col("o_orderkey").cast("int").alias("s"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 5).cast("int").alias("e"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("m"))
    return top.select(F.explode(F.array(*(F.struct(F.lit(i).alias("chrom_ix"), F.lit(n).alias("name"), (F.col("m") + 10 + i).cast("int").alias("length")) for i, n in enumerate(("1", "chr2", "X"))))).alias("c")).select("c.*")


def chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """The reference in chunks: base (pos * 7 + chrom_ix * 3) % 5, 4 meaning N."""
    start = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("k")
    # few rows make all letters, so they are dealt out before
    c = dealt(contigs(spark, sf_dir).select("chrom_ix", "length", start).withColumn("start", (F.col("k") * size).cast("int")), "chrom_ix", "start")
    letters = F.transform(F.sequence(F.col("start"), F.least(F.col("start") + size, F.col("length")) - 1), lambda p: F.substring(F.lit("TCAGN"), ((p.cast("long") * 7 + F.col("chrom_ix") * 3) % 5 + 1).cast("int"), F.lit(1)))
    return c.select("chrom_ix", "start", F.array_join(letters, "").alias("seq"))


# --- SQL ------------------------------------------------------------------------------------


def count_sql(which: int, code: str, alt: str) -> str:
    """n_ref (which 0) or n_alt (1) of a code for a change, as SQL."""
    whens = [f"when {code} = {c} and {alt} = {a} then {S.counts(c, a)[which]}" for c in S.ALLELES for a in (1, 2, 3) if S.counts(c, a)[which]]
    return f"case {' '.join(whens)} else 0 end"


P_SQL = "p as (select cast(l_suppkey % 6 as int) sample_ix, cast(l_partkey % 3 as int) chrom_ix, cast(l_orderkey as int) pos, min(cast((l_partkey + l_linenumber * 7) % 15 as int)) code from lineitem group by 1, 2, 3)"
R_SQL = P_SQL + ", r as (select sample_ix, chrom_ix, pos run_start, case when code in (0, 4, 14) then coalesce(nxt, pos + 1) else pos + 1 end run_end, code from (select *, lead(pos) over (partition by sample_ix, chrom_ix order by pos) nxt from p) x)"
BED_SQL = "bed as (select cast(o_custkey % 3 as int) chrom_ix, cast(o_orderkey as int) s, cast(o_orderkey + 1 + o_custkey % 5 as int) e from orders)"
CONTIG_SQL = "ctg as (select i chrom_ix, ['1', 'chr2', 'X'][i + 1] name, cast(m + 10 + i as int) length from (select max(l_orderkey) m from lineitem), (values (0), (1), (2)) v(i))"
REF_SQL = CONTIG_SQL + ", ref as (select chrom_ix, cast(pos as int) pos, nullif((pos * 7 + chrom_ix * 3) % 5, 4) ref from (select chrom_ix, unnest(range(length)) pos from ctg))"


def sites_sql(nout: int, name: str = "sites") -> str:
    return f"{name} as (select distinct chrom_ix, run_start pos, alt from r, (values (1), (2), (3)) a(alt) where sample_ix >= {nout} and code not in (0, 4, 14) and {count_sql(1, 'code', 'alt')} > 0)"


def sparse_sql(nout: int) -> str:
    """v: long sparse variants; w: wide ones with lists nr and na."""
    return f"""{R_SQL}, {sites_sql(nout)},
v as (select s.chrom_ix, s.pos, s.alt, i.sample_ix, coalesce({count_sql(0, 'code', 's.alt')}, 0) n_ref, coalesce({count_sql(1, 'code', 's.alt')}, 0) n_alt
  from sites s cross join (values (0), (1), (2), (3), (4), (5)) i(sample_ix)
  left join r on r.sample_ix = i.sample_ix and r.chrom_ix = s.chrom_ix and s.pos >= r.run_start and s.pos < r.run_end),
w as (select chrom_ix, pos, alt, list(n_ref order by sample_ix) nr, list(n_alt order by sample_ix) na from v group by 1, 2, 3)"""


DENSE_SQL = (
    sparse_sql(0)
    + f""", pr as (select chrom_ix, pos, 255 alt, sample_ix, {count_sql(0, 'code', '1')} n_ref, 0 n_alt from (select sample_ix, chrom_ix, unnest(range(run_start, run_end)) pos, code from r where code <> 0)),
pw as (select pos.chrom_ix, pos.pos, 255 alt, i.sample_ix, coalesce(pr.n_ref, 0) n_ref, 0 n_alt
  from (select distinct chrom_ix, pos from pr where not exists (select 1 from sites s where s.chrom_ix = pr.chrom_ix and s.pos = pr.pos)) pos cross join (values (0), (1), (2), (3), (4), (5)) i(sample_ix)
  left join pr on pr.chrom_ix = pos.chrom_ix and pr.pos = pos.pos and pr.sample_ix = i.sample_ix),
d as (select chrom_ix, cast(pos as int) pos, alt, sample_ix, n_ref, n_alt from v union all select chrom_ix, cast(pos as int), alt, sample_ix, n_ref, n_alt from pw),
dw as (select chrom_ix, pos, alt, list(n_ref order by sample_ix) nr, list(n_alt order by sample_ix) na from d group by 1, 2, 3)"""
)


def base_sql(x: str) -> str:
    return f"case when {x} between 0 and 3 then substr('TCAG', cast({x} + 1 as int), 1) else 'N' end"
