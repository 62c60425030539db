"""Driver queries over the projections of the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alleloom import schema as S
from alleloom.functions import scalars as X
from alleloom.operators import blocks as B
from alleloom.operators import filters as Q
from alleloom.operators import merge as M
from alleloom.operators import pileup as U
from alleloom.operators import runs as R
from alleloom.operators import stats as A
from alleloom.plans import projections as P

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
LABELS = [f"s{i}" for i in range(P.N_SAMPLES)]
GRID = 1000


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return keep


def _sparse(spark, d, nout=1) -> DataFrame:
    return M.merge_sparse(P.runs(spark, d), P.N_SAMPLES, nout, P.WIDTH)


def _with_ref(spark, d, variants: DataFrame) -> DataFrame:
    return M.add_ref(variants, P.chunks(spark, d), P.CHUNK)


# --- merging ----------------------------------------------------------------------------------


@query(f"with {P.P_SQL} select sample_ix, chrom_ix, pos, alt, {P.count_sql(0, 'code', 'alt')} n_ref, {P.count_sql(1, 'code', 'alt')} n_alt from p, (values (1), (2), (3)) a(alt)")
def allele_counts(spark, d):
    return M.point_calls(P.points(spark, d).withColumnRenamed("pos", "run_start"))


@query(f"with {P.sparse_sql(1)} select chrom_ix, pos, alt, sample_ix, n_ref, n_alt from v")
def merge_sparse(spark, d):
    return M.long(_sparse(spark, d))


@query(f"with {P.DENSE_SQL} select chrom_ix, pos, alt, sample_ix, n_ref, n_alt from d")
def merge_dense(spark, d):
    return M.long(M.merge_dense(P.runs(spark, d), P.N_SAMPLES, P.WIDTH))


@query(
    f"""with {P.DENSE_SQL}, {P.REF_SQL}, kr as (select chrom_ix, pos, ref from ref where ref is not null)
select kr.chrom_ix, kr.pos, kr.ref, coalesce(dw.alt, 255) alt, array_to_string(coalesce(dw.nr, [0, 0, 0, 0, 0, 0]), ',') n_ref, array_to_string(coalesce(dw.na, [0, 0, 0, 0, 0, 0]), ',') n_alt
from kr left join dw on dw.chrom_ix = kr.chrom_ix and dw.pos = kr.pos"""
)
def merge_ref(spark, d):
    m = M.merge_ref(P.runs(spark, d), M.bases_of(P.chunks(spark, d)), P.N_SAMPLES, P.WIDTH)
    text = lambda f: F.array_join(F.transform("calls", lambda c: c[f].cast("string")), ",")
    return m.select("chrom_ix", "pos", "ref", "alt", text("n_ref").alias("n_ref"), text("n_alt").alias("n_alt"))


@query(f"with {P.sparse_sql(1)}, {P.REF_SQL} select w.chrom_ix, w.pos, w.alt, {P.base_sql('ref')} ref_base, case when ref is null then substr('IOPX', cast(w.alt + 1 as int), 1) else {P.base_sql('xor(ref, w.alt)')} end alt_base from w join ref using (chrom_ix, pos)")
def add_ref(spark, d):
    v = _with_ref(spark, d, _sparse(spark, d))
    return v.select("chrom_ix", "pos", "alt", X.base_char(F.col("ref")).alias("ref_base"), X.alt_char(F.col("ref"), F.col("alt")).alias("alt_base"))


# --- runs -------------------------------------------------------------------------------------

_NORMAL = """n as (select sample_ix, chrom_ix, min(run_start) run_start, max(run_end) run_end, min(code) code from (
  select *, sum(case when j then 0 else 1 end) over (partition by sample_ix, chrom_ix order by run_start) g from (
    select *, coalesce(code in (0, 4, 14) and code = lag(code) over w and lag(run_end) over w = run_start, false) j from r window w as (partition by sample_ix, chrom_ix order by run_start)))
  group by sample_ix, chrom_ix, g)"""


@query(f"with {P.R_SQL}, {_NORMAL} select sample_ix, chrom_ix, run_start, run_end, code from n")
def normalize_runs(spark, d):
    return R.normalize(P.runs(spark, d))


def _gap_sql(gap: int) -> str:
    return f"""f as (select sample_ix, chrom_ix, pos run_start, pos + 1 run_end, code from p
  union all select * from (select sample_ix, chrom_ix, pos + 1 run_start, coalesce(lead(pos) over (partition by sample_ix, chrom_ix order by pos), length) run_end, {gap} code from p join ctg using (chrom_ix)) where run_end > run_start
  union all select sample_ix, chrom_ix, 0, min(pos), {gap} from p group by 1, 2 having min(pos) > 0)"""


@query(f"with {P.P_SQL}, {P.CONTIG_SQL}, {_gap_sql(S.NS)} select sample_ix, chrom_ix, run_start, run_end, code from f")
def gap_fill_dense(spark, d):
    return R.gap_fill(P.points(spark, d), P.contigs(spark, d), S.NS)


@query(f"with {P.P_SQL}, {P.CONTIG_SQL}, {_gap_sql(S.EQS2)} select sample_ix, chrom_ix, run_start, run_end, code from f")
def gap_fill_sparse(spark, d):
    return R.gap_fill(P.points(spark, d), P.contigs(spark, d), S.EQS2)


@query(
    f"""with {P.P_SQL}, {P.CONTIG_SQL}, {P.BED_SQL}, {_gap_sql(-2)},
b as (select distinct chrom_ix, unnest(range(s, e)) pos from bed),
x as (select sample_ix, chrom_ix, unnest(range(run_start, run_end)) pos, run_start g from f where code = -2),
y as (select x.*, case when b.pos is null then {S.NS} else {S.EQS2} end code from x left join b using (chrom_ix, pos)),
z as (select *, pos - row_number() over (partition by sample_ix, chrom_ix, g, code order by pos) island from y)
select sample_ix, chrom_ix, run_start, run_end, code from f where code <> -2
union all select sample_ix, chrom_ix, cast(min(pos) as int), cast(max(pos) + 1 as int), code from z group by sample_ix, chrom_ix, g, code, island"""
)
def gap_fill_patches(spark, d):
    return R.gap_fill_patches(P.points(spark, d), P.contigs(spark, d), P.regions(spark, d), width=1024)


@query(f"with {P.P_SQL} select sample_ix, chrom_ix, pos, case {' '.join(f'when code = {c} then {S.haploid(c)}' for c in S.ALLELES)} else code end code from p")
def make_hap(spark, d):
    return R.make_hap(P.points(spark, d))


_RAW = "raw as (select l_orderkey * 10 + l_linenumber ord, cast(l_partkey % 4 - 1 as int) chrom_ix, cast(l_orderkey + 1 as int) pos, substr('TCAG', cast(l_orderkey % 4 + 1 as int), 1) ref, case when l_suppkey % 7 = 0 then 'GA' else substr('CAGT', cast(l_orderkey % 4 + 1 as int), 1) end alt from lineitem)"


def _raw(spark, d) -> DataFrame:
    r = P.table(spark, d, "lineitem")
    letter = lambda s: F.substring(F.lit(s), (F.col("l_orderkey") % 4 + 1).cast("int"), F.lit(1))
    return r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_partkey") % 4 - 1).cast("int").alias("chrom_ix"), (F.col("l_orderkey") + 1).cast("int").alias("pos"), letter("TCAG").alias("ref"), F.array(F.when(F.col("l_suppkey") % 7 == 0, "GA").otherwise(letter("CAGT"))).alias("alts"))


@query(f"with {_RAW} select ord, chrom_ix, pos, ref, alt from raw where chrom_ix >= 0 and length(alt) = 1 qualify row_number() over (partition by chrom_ix, pos order by ord) = 1")
def dedup_clean(spark, d):
    return R.dedup(R.clean(_raw(spark, d))).select("ord", "chrom_ix", "pos", "ref", F.col("alts")[0].alias("alt"))


_BLOCKS = "blk as (select o_orderkey ord, cast(o_custkey % 3 as int) chrom_ix, cast(o_orderkey * 3 % 20011 as int) start, cast(1 + o_custkey % 7 as int) len from orders)"


def _blocks(spark, d) -> DataFrame:
    o = P.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 3).cast("int").alias("chrom_ix"), (F.col("o_orderkey") * 3 % 20011).cast("int").alias("start"), (1 + F.col("o_custkey") % 7).cast("int").alias("len"))


@query(
    f"""with {_BLOCKS}, k as (select * from blk qualify row_number() over (partition by chrom_ix, start order by ord desc) = 1)
select ord, chrom_ix, start, len, coalesce(max(start + len) over (partition by chrom_ix order by start rows between unbounded preceding and 1 preceding) > start, false) overlaps_before,
coalesce(lead(start) over (partition by chrom_ix order by start) < start + len, false) overlaps_after from k"""
)
def block_overlaps(spark, d):
    return R.block_overlaps(_blocks(spark, d))


@query(
    f"""with recursive {_BLOCKS}, {P.CONTIG_SQL}, k as (select * from blk qualify row_number() over (partition by chrom_ix, start order by ord desc) = 1),
st as (select chrom_ix, min({{'s': start, 'n': len, 'o': ord}}) m from k group by 1
  union all select st.chrom_ix, (select min({{'s': start, 'n': len, 'o': ord}}) from k where k.chrom_ix = st.chrom_ix and k.start >= st.m.s + st.m.n) from st where st.m is not null),
u as (select chrom_ix, m.s run_start, m.s + m.n run_end, m.o ord from st where m is not null),
g as (select chrom_ix, run_end run_start, coalesce(lead(run_start) over (partition by chrom_ix order by run_start), length) run_end from u join ctg using (chrom_ix)
  union all select chrom_ix, 0, min(run_start) from u group by 1 union all select chrom_ix, 0, length from ctg where chrom_ix not in (select chrom_ix from u))
select * from u union all select chrom_ix, run_start, run_end, null from g where run_end > run_start"""
)
def assemble_blocks(spark, d):
    return R.assemble(_blocks(spark, d), P.contigs(spark, d))


# --- filters ----------------------------------------------------------------------------------


@query(f"with {P.P_SQL}, {P.BED_SQL} select sample_ix, chrom_ix, pos, code from p semi join (select distinct chrom_ix, unnest(range(s, e)) pos from bed) b using (chrom_ix, pos)")
def region_filter(spark, d):
    return Q.restrict_to_regions(P.points(spark, d), P.regions(spark, d), P.WIDTH)


@query(f"with {P.R_SQL}, {P.sites_sql(1)} select chrom_ix, pos, alt from sites where alt >= 2")
def transversions(spark, d):
    return Q.transversions(M.sites_of(P.runs(spark, d), 1))


@query(f"with {P.R_SQL}, {P.sites_sql(1)} select chrom_ix, pos, alt from sites qualify count(*) over (partition by chrom_ix, pos) = 1")
def biallelic(spark, d):
    return Q.biallelic(M.sites_of(P.runs(spark, d), 1))


_INFORMATIVE = "i as (select * from w where list_sum(list_slice(nr, 2, 6)) <> 0 and list_sum(list_slice(na, 2, 6)) <> 0)"


@query(f"with {P.sparse_sql(1)}, {_INFORMATIVE} select chrom_ix, pos, alt from i")
def informative(spark, d):
    return Q.informative(_sparse(spark, d), 1).select("chrom_ix", "pos", "alt")


@query(f"with {P.R_SQL}, {P.sites_sql(1)}, {P.REF_SQL}, c as (select x.chrom_ix, x.pos from ref x join ref y on x.chrom_ix = y.chrom_ix and y.pos = x.pos + 1 where x.ref = 1 and y.ref = 3) select s.chrom_ix, s.pos, s.alt from sites s where not exists (select 1 from c where c.chrom_ix = s.chrom_ix and (c.pos = s.pos or c.pos + 1 = s.pos))")
def drop_cpg(spark, d):
    return Q.drop_cpg(M.sites_of(P.runs(spark, d), 1), P.chunks(spark, d), P.CHUNK)


@query(f"with {P.P_SQL}, {P.CONTIG_SQL} select sample_ix, chrom_ix, pos, code from p where chrom_ix in (select chrom_ix from ctg where regexp_matches(name, '^(chr)?[0-9]+[a-z]?$'))")
def chrom_select(spark, d):
    return Q.select_chroms(P.points(spark, d), P.contigs(spark, d), Q.AUTOSOMES)


@query("""with c as (select c_custkey sample_ix, 'c' || c_custkey as name, 'c' || c_custkey || '.run' as label, 'pop' || c_nationkey pop from customer),
p as (select sample_ix, label, unnest(range(1, length(label) + 1)) n from c),
b as (select p.sample_ix, p.label, max(n) n from p join c on c.name = substr(p.label, 1, n) group by 1, 2)
select b.sample_ix, b.label, c.pop from b join c on c.name = substr(b.label, 1, n)""")
def population_lookup(spark, d):
    c = P.table(spark, d, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    individuals = c.select(name.alias("name"), F.concat(F.lit("pop"), F.col("c_nationkey").cast("string")).alias("pop"))
    return Q.assign_populations(c.select(F.col("c_custkey").alias("sample_ix"), F.concat(name, F.lit(".run")).alias("label")), individuals)


# --- statistics -------------------------------------------------------------------------------


def _ways_sql(pattern: str, combo: tuple[int, ...]) -> str:
    def one(states: str) -> str:
        return " * ".join(("1" if s == "A" else "0") if i < 0 else f"{'nr' if s == 'A' else 'na'}[{i + 1}]" for s, i in zip(states, combo, strict=True))

    return f"({one(pattern)} + {one(pattern.translate(str.maketrans('AD', 'DA')))})"


def _stat_sql(ctes: str, source: str, combos, patterns, block_sql: str) -> str:
    parts = []
    for i, (c, _) in enumerate(combos):
        nn = " * ".join("1" if j < 0 else f"(nr[{j + 1}] + na[{j + 1}])" for j in c)
        aa = " + ".join(_ways_sql(p, c) for p in patterns["aa"])
        bb = " + ".join(_ways_sql(p, c) for p in patterns["bb"])
        parts.append(f"select chrom_ix, pos, {i} combo, case when {nn} > 0 then ({aa}) / cast({nn} as double) else 0 end k, case when {nn} > 0 then ({aa} + {bb}) / cast({nn} as double) else 0 end n, case when {nn} > 0 then 1.0 else 0.0 end t from {source}")
    return f"""with recursive {ctes}, sc as ({' union all '.join(parts)}), {block_sql},
tot as (select combo, sum(k) k, sum(n) n, cast(sum(t) as double) t, count(*) g from b group by combo),
j as (select b.combo, sum(case when b.n = 0 then 0 else (b.k * b.k / b.n - 2 * b.k * tot.k / tot.n + tot.k * tot.k * b.n / (tot.n * tot.n)) / nullif(tot.n - b.n, 0) end) s, max(case when b.n <> 0 and b.n = tot.n then 1 else 0 end) bad from b join tot using (combo) group by 1)
select cast(combo as int) combo, round(k, 9) k, round(n, 9) n, t, g, round(2 * k / nullif(n, 0) - 1, 9) r, round((2 * k - n) / nullif(t, 0), 9) f4, round(case when bad = 0 and n <> 0 then 4 * s / g end, 9) as var from tot join j using (combo)"""


_GRID_SQL = f"b as (select chrom_ix, pos // {GRID} blk, combo, sum(k) k, sum(n) n, sum(t) t from sc group by 1, 2, 3)"


def _rounded(blocks: DataFrame) -> DataFrame:
    j = A.summarize(blocks)
    return j.select("combo", F.round("k", 9).alias("k"), F.round("n", 9).alias("n"), "t", "g", F.round("r", 9).alias("r"), F.round("f4", 9).alias("f4"), F.round("var", 9).alias("var"))


_D = A.patterson_combos(1, 2, LABELS)
_K = A.kay_combos(2, LABELS)
_Y = A.yadda_combos(1, 1, 2, LABELS)


@query(_stat_sql(P.sparse_sql(1), "w", _D, A.PATTERSON, _GRID_SQL))
def d_statistic(spark, d):
    return _rounded(A.block_sums(_sparse(spark, d), [c for c, _ in _D], A.PATTERSON, GRID, grid=True))


@query(_stat_sql(P.DENSE_SQL, "dw", _D, A.PATTERSON, _GRID_SQL))
def f4_statistic(spark, d):
    return _rounded(A.dense_blocks(None, P.runs(spark, d), P.N_SAMPLES, [c for c, _ in _D], A.PATTERSON, GRID, P.WIDTH))


@query(_stat_sql(P.sparse_sql(0), "w", _K, A.KAY, _GRID_SQL))
def kayvergence(spark, d):
    return _rounded(A.block_sums(_sparse(spark, d, 0), [c for c, _ in _K], A.KAY, GRID, grid=True))


@query(_stat_sql(P.sparse_sql(2), "w", _Y, A.YADDA, _GRID_SQL))
def yadda(spark, d):
    return _rounded(A.block_sums(_sparse(spark, d, 2), [c for c, _ in _Y], A.YADDA, GRID, grid=True))


@query(
    f"""with recursive {P.P_SQL}, u as (select distinct chrom_ix, pos from p),
st as (select chrom_ix, min(pos) block from u group by 1 union all select st.chrom_ix, (select min(pos) from u where u.chrom_ix = st.chrom_ix and u.pos >= st.block + {GRID}) from st where st.block is not null)
select st.chrom_ix, st.block, count(*) n, count(distinct p.pos) n_pos from st join p on p.chrom_ix = st.chrom_ix and p.pos >= st.block and p.pos < st.block + {GRID} where st.block is not null group by 1, 2"""
)
def jackknife_blocks_greedy(spark, d):
    return A.greedy_blocks(P.points(spark, d), GRID).groupBy("chrom_ix", "block").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("n_pos"))


_GREEDY_SQL = f"""u as (select distinct chrom_ix, pos from sc),
st as (select chrom_ix, min(pos) blk from u group by 1 union all select st.chrom_ix, (select min(pos) from u where u.chrom_ix = st.chrom_ix and u.pos >= st.blk + {GRID}) from st where st.blk is not null),
b as (select sc.chrom_ix, blk, combo, sum(k) k, sum(n) n, sum(t) t from sc join st on st.chrom_ix = sc.chrom_ix and sc.pos >= blk and sc.pos < blk + {GRID} group by 1, 2, 3)"""


@query(_stat_sql(P.sparse_sql(1), "w", _D, A.PATTERSON, _GREEDY_SQL))
def d_statistic_greedy(spark, d):
    return _rounded(A.block_sums(_sparse(spark, d), [c for c, _ in _D], A.PATTERSON, GRID))


@query(_stat_sql(P.DENSE_SQL, "dw", _D, A.PATTERSON, _GREEDY_SQL))
def f4_statistic_greedy(spark, d):
    return _rounded(A.dense_blocks(None, P.runs(spark, d), P.N_SAMPLES, [c for c, _ in _D], A.PATTERSON, GRID, P.WIDTH, grid=False))


_F4_ONLY = """cg as (select x.chrom_ix, unnest([x.pos, y.pos]) pos from ref x join ref y on x.chrom_ix = y.chrom_ix and y.pos = x.pos + 1 where x.ref = 1 and y.ref = 3),
fw as (select * from dw semi join (select distinct chrom_ix, unnest(range(s, e)) pos from bed) b using (chrom_ix, pos) where (alt = 255 or alt >= 2)
  and not exists (select 1 from cg where cg.chrom_ix = dw.chrom_ix and cg.pos = dw.pos))"""


def _f4_only(spark, d, grid: bool) -> DataFrame:
    """F4 over transversions and sites without variant, within regions and outside CG pairs."""
    masks = {"within": [P.regions(spark, d)], "without": [Q.cpg_sites(P.chunks(spark, d), P.CHUNK)]}
    return _rounded(A.dense_blocks(None, P.runs(spark, d), P.N_SAMPLES, [c for c, _ in _D], A.PATTERSON, GRID, P.WIDTH, grid=grid, sites=X.is_transversion(F.col("alt")), **masks))


@query(_stat_sql(f"{P.DENSE_SQL}, {P.BED_SQL}, {P.REF_SQL}, {_F4_ONLY}", "fw", _D, A.PATTERSON, _GRID_SQL))
def f4_regions(spark, d):
    return _f4_only(spark, d, grid=True)


@query(_stat_sql(f"{P.DENSE_SQL}, {P.BED_SQL}, {P.REF_SQL}, {_F4_ONLY}", "fw", _D, A.PATTERSON, _GREEDY_SQL))
def f4_regions_greedy(spark, d):
    return _f4_only(spark, d, grid=False)


@query()
def d_pvalue(spark, d):
    blocks = A.block_sums(_sparse(spark, d), [c for c, _ in _D], A.PATTERSON, GRID)
    return A.report(spark, blocks, _D, ("sample", "outgroup", "panel_a", "panel_b"))


# --- exports ----------------------------------------------------------------------------------

_POP_SUM = {p: [i for i, x in enumerate(P.POPULATIONS) if x == p] for p in dict.fromkeys(P.POPULATIONS)}


@query(f"with {P.sparse_sql(1)}, {_INFORMATIVE} " + " union all ".join(f"select chrom_ix, pos, alt, '{p}' pop, {' + '.join(f'nr[{i + 1}]' for i in ix)} n_ref, {' + '.join(f'na[{i + 1}]' for i in ix)} n_alt from i" for p, ix in _POP_SUM.items()))
def treemix_counts(spark, d):
    v = Q.population_counts(Q.informative(_sparse(spark, d), 1), list(P.POPULATIONS))
    return v.select("chrom_ix", "pos", "alt", F.explode("pops").alias("x")).select("chrom_ix", "pos", "alt", "x.pop", "x.n_ref", "x.n_alt")


def _call_text(calls: Column, one, sep: str) -> Column:
    return F.array_join(F.transform(calls, lambda c: one(c["n_ref"], c["n_alt"])), sep)


_CALLS = "list_transform(range(1, 7), lambda i: {})"
_GENO_SQL = "case when nr[i] = 0 and na[i] = 0 then '9' when na[i] = 0 then '2' when nr[i] = 0 then '0' else '1' end"
_GT_SQL = "case when nr[i] = 0 and na[i] = 0 then './.' when nr[i] = 1 and na[i] = 0 then '0' when nr[i] = 0 and na[i] = 1 then '1' when na[i] = 0 then '0/0' when nr[i] = 0 then '1/1' else '0/1' end"


@query(f"with {P.sparse_sql(1)}, {_INFORMATIVE} select chrom_ix, pos, alt, array_to_string({_CALLS.format(_GENO_SQL)}, '') geno from i")
def eigenstrat_geno(spark, d):
    return Q.informative(_sparse(spark, d), 1).select("chrom_ix", "pos", "alt", _call_text(F.col("calls"), X.geno_char, "").alias("geno"))


_DIGIT_SQL = " || ".join(f"case when (val >> {5 * k}) > 0 then substr('{X.DIGITS}', cast(((val >> {5 * k}) & 31) + 1 as int), 1) else '' end" for k in range(8))


@query(
    f"""with {P.sparse_sql(1)}, {P.REF_SQL}, {_INFORMATIVE},
x as (select chrom_ix, pos, {P.base_sql('ref')} rb, case when ref is null then substr('IOPX', cast(alt + 1 as int), 1) else {P.base_sql('xor(ref, alt)')} end ab from i join ref using (chrom_ix, pos)),
y as (select *, cast(pos as bigint) * 4 + case ab when 'A' then 0 when 'C' then 1 when 'G' then 2 else 3 end val from x)
select {_DIGIT_SQL} || substr('{X.DIGITS}', chrom_ix + 1, 1) as name, case chrom_ix when 24 then 90 else chrom_ix + 1 end chrom, '0.0' as genetic, pos + 1 as pos, rb ref, ab alt from y"""
)
def eigenstrat_snp(spark, d):
    v = _with_ref(spark, d, Q.informative(_sparse(spark, d), 1))
    v = v.withColumn("ab", X.alt_char(F.col("ref"), F.col("alt")))
    return v.select(X.snp_name(F.col("chrom_ix"), F.col("pos"), F.col("ab")).alias("name"), X.eigen_chrom(F.col("chrom_ix")).alias("chrom"), F.lit("0.0").alias("genetic"), (F.col("pos") + 1).alias("pos"), X.base_char(F.col("ref")).alias("ref"), F.col("ab").alias("alt"))


@query(f"with {P.sparse_sql(1)}, {P.REF_SQL} select chrom_ix, pos + 1 as pos, {P.base_sql('ref')} ref, case when ref is null then substr('IOPX', cast(alt + 1 as int), 1) else {P.base_sql('xor(ref, alt)')} end alt, array_to_string({_CALLS.format(_GT_SQL)}, chr(9)) gts from w join ref using (chrom_ix, pos)")
def vcf_rows(spark, d):
    v = _with_ref(spark, d, _sparse(spark, d))
    return v.select("chrom_ix", (F.col("pos") + 1).alias("pos"), X.base_char(F.col("ref")).alias("ref"), X.alt_char(F.col("ref"), F.col("alt")).alias("alt"), _call_text(F.col("calls"), X.vcf_gt, "\t").alias("gts"))


@query(
    f"""with {P.sparse_sql(1)}, {P.REF_SQL}, x as (select chrom_ix, pos, pos // 500 block, alt, nr, na, ref from w join ref using (chrom_ix, pos) where ref is not null),
l as (select x.*, h.i, h.hap, case when nr[h.i] = 0 and na[h.i] = 0 then 'N' when nr[h.i] = 0 then {P.base_sql('xor(ref, alt)')} when na[h.i] = 0 or h.hap = 0 then {P.base_sql('ref')} else {P.base_sql('xor(ref, alt)')} end c from x cross join (select i, hap from (values (1), (2), (3), (4), (5), (6)) a(i), (values (0), (1)) b(hap)) h),
s as (select chrom_ix, block, i, hap, string_agg(c, '' order by pos, alt) line from l group by 1, 2, 3, 4),
e as (select chrom_ix, block, 100.0 * avg(case when list_min(list_transform(range(1, 7), lambda k: nr[k] + na[k])) > 0 then 1.0 else 0.0 end) >= 20 enough from x group by 1, 2)
select s.chrom_ix, cast(s.block as int) block, enough, cast(2 * (i - 1) + hap as int) line_no, line from s join e on s.chrom_ix = e.chrom_ix and s.block = e.block"""
)
def pseudo_ms_blocks(spark, d):
    v = B.tumbling_blocks(_with_ref(spark, d, _sparse(spark, d)).where("ref is not null"), 500)
    return B.haplotype_lines(v, P.N_SAMPLES, 20.0)


# --- pileups ----------------------------------------------------------------------------------

_PILE_SQL = "pile as (select chrom_ix, pos, nullif((pos * 7 + chrom_ix * 3) % 5, 4) ref, a, c - c // 3 c, g, t, ar, cr, gr - gr // 3 gr, tr, c // 3 u, gr // 3 ur from (select cast(l_partkey % 3 as int) chrom_ix, cast(l_orderkey as int) pos, " + ", ".join(f"cast(sum((l_partkey + l_linenumber * {i + 3}) % {i + 2}) as int) {c}" for i, c in enumerate(U.COUNTS)) + " from lineitem group by 1, 2))"


def _pile(spark, d) -> DataFrame:
    key = [(F.col("l_partkey") % 3).cast("int").alias("chrom_ix"), F.col("l_orderkey").cast("int").alias("pos")]
    p = P.table(spark, d, "lineitem").groupBy(*key).agg(*(F.sum((F.col("l_partkey") + F.col("l_linenumber") * (i + 3)) % (i + 2)).cast("int").alias(c) for i, c in enumerate(U.COUNTS)))
    p = p.withColumn("u", F.floor(F.col("c") / 3).cast("int")).withColumn("ur", F.floor(F.col("gr") / 3).cast("int")).withColumn("c", F.col("c") - F.col("u")).withColumn("gr", F.col("gr") - F.col("ur"))
    code = (F.col("pos") * 7 + F.col("chrom_ix") * 3) % 5
    return p.withColumn("ref", F.when(code < 4, code))


#: The schemes in SQL, as written out from their definition.
_PICKS = {
    "ostrich": ("a + ar + ur", "c + cr", "g + gr", "t + tr + u", "0"),
    "ignore_t": ("a", "c + cr", "g + gr", "tr", "0"),
    "ignore_a": ("ar + ur", "c + cr", "g + gr", "t + u", "0"),
    "ignore_c": ("a + ar + ur", "cr", "g", "t + tr + u", "0"),
    "ignore_g": ("a + ar + ur", "c", "gr", "t + tr + u", "0"),
    "stranded": ("a", "cr", "g", "tr", "0"),
    "udg": ("a + ar", "c + cr", "g + gr", "t + tr", "0"),
    "kay": ("a", "c + cr", "g + gr", "tr", "t + ar + ur + u"),
    "mateja": tuple(f"case when ref = 1 and t + u > 0 then {b} when ref = 3 and ar + ur > 0 then {f} else {o} end" for b, f, o in (("ar + ur", "a", "a + ar + ur"), ("cr", "c", "c + cr"), ("gr", "g", "g + gr"), ("tr", "t + u", "t + tr + u"))) + ("0",),
    "mateja2": ("case when ref = 3 then a else a + ar + ur end", "c + cr", "g + gr", "case when ref = 1 then tr else t + tr + u end", "0"),
}


def _pick_query(scheme: str) -> None:
    sql = f"with {_PILE_SQL} select chrom_ix, pos, " + ", ".join(f"{e} w_{k}" for e, k in zip(_PICKS[scheme], "acgtn", strict=True)) + " from pile"

    @query(sql, name=f"pick_weights_{scheme}")
    def run(spark, d):
        return U.pick_weights(_pile(spark, d), scheme).select("chrom_ix", "pos", *(f"w_{k}" for k in "acgtn"))


for _scheme in U.SCHEMES:
    _pick_query(_scheme)


@query(
    f"""with {_PILE_SQL}, x as (select chrom_ix, pos, {', '.join(f'{e} w_{k}' for e, k in zip(_PICKS['kay'], 'acgtn', strict=True))} from pile),
y as (select *, (pos * 31 + chrom_ix) % nullif(w_a + w_c + w_g + w_t + w_n, 0) i from x)
select chrom_ix, pos, case when i is null then null when i < w_a then 2 when i < w_a + w_c then 1 when i < w_a + w_c + w_g then 3 when i < w_a + w_c + w_g + w_t then 0 end base from y"""
)
def sample_base(spark, d):
    w = U.pick_weights(_pile(spark, d), "kay")
    return U.pick(w, F.col("pos") * 31 + F.col("chrom_ix")).select("chrom_ix", "pos", "base")


@query()
def sample_base_seeded(spark, d):
    return U.to_points(U.sample_base(U.pick_weights(U.deaminate(_pile(spark, d).drop("u", "ur")), "ostrich"), seed=7))


# --- formats ----------------------------------------------------------------------------------


@query(f"with {P.R_SQL}, {_NORMAL} select sample_ix, chrom_ix, run_start, run_end, code from n where code <> 0")
def runfile_roundtrip(spark, d):
    from alleloom.sources.runfile import decoded, encoded

    return decoded(encoded(P.runs(spark, d))).where("code <> 0").drop("ins")


@query(f"with {P.REF_SQL} select chrom_ix, pos // {P.CHUNK} chunk, md5(string_agg({P.base_sql('ref')}, '' order by pos)) digest, count(ref) n_bases from ref group by 1, 2")
def twobit_roundtrip(spark, d):
    from alleloom.sources.twobit import chunks_of, packed

    whole = chunks_of(packed(P.chunks(spark, d), P.contigs(spark, d)), P.CHUNK)
    return whole.select("chrom_ix", F.floor(F.col("start") / P.CHUNK).alias("chunk"), F.md5("seq").alias("digest"), F.length(F.translate("seq", "N", "")).cast("long").alias("n_bases"))


def _patched_sql() -> str:
    whens = []
    for r in range(4):
        for c, alleles in S.ALLELES.items():
            whens.append(f"when ref = {r} and code = {c} then '{S.LETTER_OF[''.join(sorted(S.BASES[r ^ a] for a in (alleles * 2)[:2]))]}'")
    return f"case {' '.join(whens)} else 'N' end"


@query(
    f"""with {P.R_SQL}, {P.REF_SQL}, x as (select sample_ix, chrom_ix, unnest(range(run_start, run_end)) pos, code from r),
y as (select i.sample_ix, ref.chrom_ix, ref.pos, {_patched_sql()} c from ref cross join (values (0), (1), (2), (3), (4), (5)) i(sample_ix) left join x on x.sample_ix = i.sample_ix and x.chrom_ix = ref.chrom_ix and x.pos = ref.pos)
select sample_ix, chrom_ix, cast(pos // {P.CHUNK} * {P.CHUNK} as int) start, md5(string_agg(c, '' order by pos)) digest from y group by 1, 2, 3"""
)
def patch_texts(spark, d):
    return M.patch(P.runs(spark, d), P.chunks(spark, d), P.CHUNK).select("sample_ix", "chrom_ix", "start", F.md5("seq").alias("digest"))


# --- imports and texts ------------------------------------------------------------------------

#: A sample's text: letters by position, of which every other matches the reference.
_LETTERS = "TCAGSWMKRYN-QQQQQQQQQQQQQ"
_TEXT_SQL = f"x as (select chrom_ix, pos, ref, substr('{_LETTERS}', cast((pos * 11 + pos // 7 + chrom_ix * 5) % {len(_LETTERS)} + 1 as int), 1) q from ref)"


def _letter_sql() -> str:
    whens = [f"when ref = {r} and q = '{q}' then {S.code_of(r, *(S.BASES.index(b) for b in v))}" for r in range(4) for q, v in S.IUPAC.items()]
    return f"case when ref is null or q in ('N', '-') then {S.NS} when q = 'Q' then {S.EQS2} {' '.join(whens)} end"


@query(
    f"""with {P.REF_SQL}, {_TEXT_SQL}, c as (select chrom_ix, pos, {_letter_sql()} code from x),
i as (select *, sum(case when code in ({S.NS}, {S.EQS2}) and code = before then 0 else 1 end) over (partition by chrom_ix order by pos) g from (select *, lag(code) over (partition by chrom_ix order by pos) before from c))
select 0 sample_ix, chrom_ix, cast(min(pos) as int) run_start, cast(max(pos) + 1 as int) run_end, min(code) code from i group by chrom_ix, g"""
)
def diff_runs(spark, d):
    chunks = P.chunks(spark, d)
    at = lambda p: F.substring(F.lit(_LETTERS), ((p.cast("long") * 11 + F.floor(p / 7) + F.col("chrom_ix") * 5) % len(_LETTERS) + 1).cast("int"), F.lit(1))
    text = F.array_join(F.transform(F.sequence(F.col("start"), F.col("start") + F.length("seq") - 1), at), "")
    return R.diff_chunks(chunks.select(F.lit(0).alias("sample_ix"), "chrom_ix", "start", text.alias("seq")), chunks)


def _pair_sql(ref: str, first: str, second: str) -> str:
    whens = [f"when least(xor({ref}, {first}), xor({ref}, {second})) = {p} and greatest(xor({ref}, {first}), xor({ref}, {second})) = {q} then {S.CODE_OF[(p, q)]}" for p in range(4) for q in range(p, 4)]
    return f"case {' '.join(whens)} end"


@query(
    f"""with g as (select cast(l_partkey % 3 as int) chrom_ix, cast(l_orderkey * 8 + l_linenumber as int) pos, cast(l_orderkey % 4 as int) ref, cast((l_orderkey + 1) % 4 as int) alt1, cast((l_orderkey + 3) % 4 as int) alt2,
  cast(l_suppkey % 4 - 1 as int) a1, case when l_partkey % 5 = 4 then null else cast(l_partkey % 5 - 1 as int) end a2 from lineitem),
h as (select *, case when a1 >= 0 then a1 else coalesce(a2, -1) end f, [ref, alt1, alt2] al from g)
select chrom_ix, pos, case when f < 0 then {S.NS}
  when a1 < 0 or coalesce(a2, -1) < 0 then case when f = 0 then {S.EQS2} else case xor(ref, al[f + 1]) when 1 then {S.TRANS1} when 2 then {S.COMPL1} when 3 then {S.TCOMPL1} end end
  when a2 > 2 then {S.NS} else {_pair_sql('ref', 'al[a1 + 1]', 'al[a2 + 1]')} end code from h"""
)
def genotype_codes(spark, d):
    r = P.table(spark, d, "lineitem")
    letter = lambda k: F.substring(F.lit(S.BASES), ((F.col("l_orderkey") + k) % 4 + 1).cast("int"), F.lit(1))
    a2 = F.when(F.col("l_partkey") % 5 != 4, (F.col("l_partkey") % 5 - 1).cast("int"))
    raw = r.select((F.col("l_partkey") % 3).cast("int").alias("chrom_ix"), (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 1).cast("int").alias("pos"), letter(0).alias("ref"), F.array(letter(1), letter(3)).alias("alts"), (F.col("l_suppkey") % 4 - 1).cast("int").alias("a1"), a2.alias("a2"))
    return R.call_codes(raw)


@query("""with r as (select cast(l_partkey % 3 as int) chrom_ix, cast(l_orderkey as int) pos, substr('acGT', cast(l_linenumber % 4 + 1 as int), 1) base, case when l_suppkey % 2 = 0 then '+' else '-' end strand, cast(l_quantity as int) baseq, cast(l_partkey % 60 as int) mapq, cast(l_suppkey % 40 - 20 as int) read_pos from lineitem),
k as (select *, upper(base) || strand x from r where mapq >= 20 and baseq >= 10 and (case when read_pos >= 0 then read_pos >= 3 else read_pos < -4 end))
select chrom_ix, pos, """ + ", ".join(f"cast(count(*) filter (x = '{b}{s}') as int) {b.lower()}{'r' if s == '-' else ''}" for s in "+-" for b in "ACGT") + " from k group by 1, 2")
def collate_reads(spark, d):
    t = P.table(spark, d, "lineitem")
    reads = t.select((F.col("l_partkey") % 3).cast("int").alias("chrom_ix"), F.col("l_orderkey").cast("int").alias("pos"), F.substring(F.lit("acGT"), (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("base"), F.when(F.col("l_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("l_quantity").cast("int").alias("baseq"), (F.col("l_partkey") % 60).cast("int").alias("mapq"), (F.col("l_suppkey") % 40 - 20).cast("int").alias("read_pos"))
    return U.collate(reads, 20, 10, 3, 4)


@query(f"with {P.sparse_sql(1)}, {_INFORMATIVE} select chrom_ix, pos, alt, " + " || ".join(f"({' + '.join(f'nr[{i + 1}]' for i in ix)}) || ',' || ({' + '.join(f'na[{i + 1}]' for i in ix)}) || ' '" for ix in _POP_SUM.values()) + " line from i")
def treemix_text(spark, d):
    from alleloom.sinks.text import treemix_lines

    return treemix_lines(Q.population_counts(Q.informative(_sparse(spark, d), 1), list(P.POPULATIONS)))


@query(f"with {P.REF_SQL} select chrom_ix, cast(pos // 50 + 1 as int) ord, string_agg({P.base_sql('ref')}, '' order by pos) line from ref group by 1, 2 union all select chrom_ix, 0, '>' || name from ctg")
def fasta_text(spark, d):
    from alleloom.sinks.wrap import wrapped

    return wrapped(P.chunks(spark, d).join(P.contigs(spark, d).select("chrom_ix", "name"), "chrom_ix"), ["chrom_ix"], 50).select("chrom_ix", "ord", "line")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
