"""URL filters as a temporal list join, in DataFrame functions only.

A list is a log of dated entries: (kind, pattern, verdict, action, effective). `validity` turns the log into intervals:
an "add" holds from its date to the next entry of the same kind and pattern, a "remove" ends it. `evaluate` gives every
capture the keys of its URL (its host, each parent domain, each path prefix) and joins them as of the fetch time to the
intervals active then. Kinds: host (that host only), domain (it and what lies below), prefix (host/path segments).
The most specific match decides: prefix before host before domain, longer patterns first, allow before block.

Defined results: a null or host-less URL, or a null fetch time, matches nothing and is not blocked; entries with null
kind, pattern or date are ignored; of entries of one pattern at one time the last by (seq) counts; a repeated capture
gives a repeated row; an empty list blocks nothing; patterns and hosts are compared without regard to case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alleloom.llm.common import written

FOREVER = "9999-12-31 00:00:00"
_RANK = {"domain": 1, "host": 2, "prefix": 3}


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])", 1)


def segments_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def validity(entries: DataFrame) -> DataFrame:
    """(key, verdict, rank, valid_from, valid_to), half open, of the entries' log."""
    e = entries.where("kind is not null and pattern is not null and effective is not null").select(
        F.concat_ws(":", "kind", F.lower("pattern")).alias("key"), "kind", "pattern", "verdict", "action", "effective", "seq"
    )
    # spellings of one pattern are one key, so they are settled together
    last = e.groupBy("key", "kind", "effective").agg(F.max(F.struct("seq", "action", "verdict", F.length(F.lower("pattern")).alias("n"))).alias("x"))
    w = Window.partitionBy("key").orderBy("effective")
    spans = last.select("key", "kind", F.col("x.n").alias("n"), F.col("x.action").alias("action"), F.col("x.verdict").alias("verdict"), F.col("effective").alias("valid_from"), F.coalesce(F.lead("effective").over(w), F.to_timestamp(F.lit(FOREVER))).alias("valid_to"))
    rank = F.coalesce(*(F.when(F.col("kind") == k, r) for k, r in _RANK.items()), F.lit(0))
    return spans.where("action = 'add'").select("key", "verdict", (rank * 100000 + F.col("n")).cast("int").alias("rank"), "valid_from", "valid_to")


def keys_of(url: Column, deepest: int) -> Column:
    """All keys that an entry could match this URL by; no entry has a prefix of more than `deepest` segments."""
    host, seg = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.greatest(F.size(seg), F.lit(1)), F.lit(max(1, deepest)))), lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.lower(F.array_join(F.slice(seg, F.lit(1), i), "/"))))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, intervals: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(key, url, fetched, blocked, matched, n_active) for every capture row.

    Captures meet the intervals on a hashed key; a host with a third of all captures is a skewed join side, which
    Spark splits, as the intervals are a table of their own and few to a key.
    """
    # a path deeper than any entry's needs no keys below that, so its keys stay in proportion to the URL
    deepest = intervals.where(F.startswith("key", F.lit("prefix:"))).agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    one = captures.groupBy(F.col(key).alias("k"), F.col(url).alias("u"), F.col(fetched).alias("t")).agg(F.count("*").cast("int").alias("copies"))
    probe = one.select("k", "u", "t", "copies", F.explode_outer(F.array_distinct(keys_of(F.col("u"), deepest))).alias("key"))
    spans = intervals.select("key", "verdict", "rank", "valid_from", "valid_to")
    met = probe.join(spans, (probe["key"] == spans["key"]) & (probe["t"] >= spans["valid_from"]) & (probe["t"] < spans["valid_to"]), "left")
    best = F.max(F.when(F.col("rank").isNotNull(), F.struct("rank", (F.col("verdict") == "allow").alias("allow"), spans["key"].alias("key"))))
    got = met.groupBy("k", "u", "t", "copies").agg(best.alias("best"), F.count("rank").alias("n_active"))
    out = got.select(F.col("k").alias(key), F.col("u").alias(url), F.col("t").alias(fetched), F.coalesce(~F.col("best.allow"), F.lit(False)).alias("blocked"), F.col("best.key").alias("matched"), "n_active", "copies")
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copy", "copies")


# --- the production list ----------------------------------------------------------------------

#: The curated part of the list, as dated entries.
CURATED = (
    ("domain", "spam-farm.example.org", "block", "add", "2024-01-01 00:00:00", 0),
    ("domain", "cheap-pills.example.com", "block", "add", "2024-03-01 00:00:00", 1),
    ("domain", "cheap-pills.example.com", "block", "remove", "2024-09-01 00:00:00", 2),
    ("host", "www.cheap-pills.example.com", "block", "add", "2024-06-01 00:00:00", 3),
)


def listed(pages: DataFrame, url: str = "url") -> DataFrame:
    """The dated list: the curated entries, and a review log of every host seen, dated by a digest of its name."""
    spark = pages.sparkSession
    hosts = pages.select(host_of(F.col(url)).alias("host")).where("host <> ''").distinct()
    h = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    day = lambda n: F.timestamp_add("DAY", n, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    entry = lambda kind, pattern, verdict, action, when, seq: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), when.alias("effective"), F.lit(seq).alias("seq"))
    c, n = F.col("host"), F.col("h")
    rows = F.array(
        F.when(n % 5 == 0, entry("host", c, "block", "add", day(n % 300), 10)),
        F.when(n % 15 == 0, entry("host", c, "block", "remove", day(n % 300 + n % 60), 11)),
        F.when(n % 7 == 1, entry("prefix", F.concat(c, F.lit("/de")), "block", "add", day(n % 200), 12)),
        F.when(n % 11 == 2, entry("host", c, "allow", "add", day(n % 100), 13)),
    )
    logged = h.select(F.explode(rows).alias("e")).where("e is not null").select("e.*")
    fixed = spark.createDataFrame(list(CURATED), "kind string, pattern string, verdict string, action string, effective string, seq int").withColumn("effective", F.to_timestamp("effective"))
    return logged.unionByName(fixed)


def fetched(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages as captures: the tables have no fetch time, so it is spread over the year by the key."""
    return pages.withColumn("fetched_at", F.timestamp_add("MINUTE", (F.col(key) * 7919 % 525600).cast("int"), F.to_timestamp(F.lit("2024-01-01 00:00:00"))))


def filtered(pages: DataFrame) -> DataFrame:
    spans = written(validity(listed(pages)), "validity")
    return evaluate(fetched(pages), spans)


#: The same in DuckDB.
SQL = r"""
with p as (select page_id, url, timestamp '2024-01-01 00:00:00' + to_minutes(cast(page_id * 7919 % 525600 as int)) fetched_at,
    regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*[^/?#:@.])', 1) host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') seg from pages),
h as (select distinct host, cast('0x' || substr(md5(host), 1, 4) as int) h from p where host <> ''),
e as (
    select 'host' kind, host pattern, 'block' verdict, 'add' act, timestamp '2024-01-01' + to_days(h % 300) eff, 10 seq from h where h % 5 = 0
    union all select 'host', host, 'block', 'remove', timestamp '2024-01-01' + to_days(h % 300 + h % 60), 11 from h where h % 15 = 0
    union all select 'prefix', host || '/de', 'block', 'add', timestamp '2024-01-01' + to_days(h % 200), 12 from h where h % 7 = 1
    union all select 'host', host, 'allow', 'add', timestamp '2024-01-01' + to_days(h % 100), 13 from h where h % 11 = 2
    union all select * from (values ('domain', 'spam-farm.example.org', 'block', 'add', timestamp '2024-01-01', 0), ('domain', 'cheap-pills.example.com', 'block', 'add', timestamp '2024-03-01', 1),
        ('domain', 'cheap-pills.example.com', 'block', 'remove', timestamp '2024-09-01', 2), ('host', 'www.cheap-pills.example.com', 'block', 'add', timestamp '2024-06-01', 3)) v),
l as (select * from e qualify row_number() over (partition by kind, pattern, eff order by seq desc) = 1),
s as (select kind || ':' || pattern k, verdict, case kind when 'domain' then 1 when 'host' then 2 else 3 end * 100000 + length(pattern) rank, act, eff f,
    coalesce(lead(eff) over (partition by kind, pattern order by eff), timestamp '9999-12-31') t from l),
k as (select page_id, url, fetched_at, 'host:' || host k from p where host <> ''
    union select page_id, url, fetched_at, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') from p, unnest(range(1, len(string_split(host, '.')) + 1)) u(i) where host <> ''
    union select page_id, url, fetched_at, 'prefix:' || host || '/' || lower(array_to_string(list_slice(seg, 1, i), '/')) from p, unnest(range(1, greatest(len(seg), 1) + 1)) u(i) where host <> ''),
m as (select page_id, rank, verdict = 'allow' allow, k.k from k join s on k.k = s.k and fetched_at >= f and fetched_at < t and act = 'add'),
b as (select page_id, count(*) n, arg_max(k, rank * 2 + cast(allow as int)) k, arg_max(allow, rank * 2 + cast(allow as int)) allow from m group by 1)
select p.page_id, p.url, p.fetched_at, coalesce(not allow, false) blocked, b.k matched, coalesce(n, 0) n_active from p left join b using (page_id)
"""
