"""Queries over perceptual hashes: collapse, pairs, leaders, groups, removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions.hashing import average_bits, bits_to_long, long_to_hex
from docsift.operators import dedup as DD
from docsift.operators import images as I
from docsift.operators.hash_index import HashIndex
from docsift.plans.registry import ORACLE, register
from docsift.session import scratch_dir, write_table
from docsift.sources.fixtures import duckdb_cte, fixture
from docsift.sources.tables import table

T = C.DEFAULT_THRESHOLD
_F = duckdb_cte("fingerprints")
_DIST = "bit_count(xor({a}::bit, {b}::bit))"


@register("ahash", """
with b as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
 m as (select vec_id, e, list_sum(e)/len(e) mu from b),
 h as (select vec_id, array_to_string(list_transform(e, lambda x: case when x>mu then '1' else '0' end),'') bits from m)
select vec_id, bits, lower(printf('%016x', bits::bit::bigint)) as hash_hex,
  cast(length(bits) - length(replace(bits, '1', '')) as integer) as ones from h""")
def ahash(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    bits = average_bits(F.col("embedding"))
    return emb.select("vec_id", bits.alias("bits")).select(
        "vec_id", "bits", long_to_hex(bits_to_long(F.col("bits"))).alias("hash_hex"),
        (F.length("bits") - F.length(F.regexp_replace("bits", "1", ""))).alias("ones"))


@register("exact_collapse", _F + """
select bits, min(ord) as node, max(ord) as file_ord, count(*) as copies from fingerprints group by bits""")
def exact_collapse(spark, sf_dir):
    return DD.collapse_exact(fixture(spark, sf_dir, "fingerprints")).select("bits", "node", "file_ord", "copies")


_NODES = _F + ", c as (select bits, min(ord) as node, max(ord) as file_ord from fingerprints group by bits)\n"


@register("near_dup_pairs", _NODES + f"""
select a.node as node_a, b.node as node_b, cast({_DIST.format(a='a.bits', b='b.bits')} as integer) as distance
from c a join c b on a.node < b.node and {_DIST.format(a='a.bits', b='b.bits')} <= {T}""")
def near_dup_pairs(spark, sf_dir):
    return DD.node_pairs(DD.collapse_exact(fixture(spark, sf_dir, "fingerprints")), T)


def _walk(nodes_cte: str, seed_list: str = "[]::varchar[]") -> str:
    """Recursive walk in node order carrying the list of kept hashes."""
    return f""", n as (select row_number() over (order by node) as rn, node, bits from {nodes_cte}),
 walk(rn, node, is_kept, kept) as (
  select 0::bigint, null::bigint, false, {seed_list}
  union all
  select n.rn, n.node,
    not coalesce(list_bool_or(list_transform(w.kept, lambda k: {_DIST.format(a='k', b='n.bits')} <= {T})), false),
    case when coalesce(list_bool_or(list_transform(w.kept, lambda k: {_DIST.format(a='k', b='n.bits')} <= {T})), false)
         then w.kept else list_append(w.kept, n.bits) end
  from walk w join n on n.rn = w.rn + 1)
"""


_LEAD = "with recursive" + _NODES[len("with"):] + _walk("c") + \
    ", l as (select w.node, c.bits from walk w join c on c.node = w.node where w.is_kept)\n"


@register("leaders", _LEAD + "select node as ord, bits from l")
def leaders(spark, sf_dir):
    return DD.leaders(fixture(spark, sf_dir, "fingerprints"), T)


_PLAN = _LEAD + f""", o as (select c.node, coalesce((select min(l.node) from l where l.node <= c.node and {_DIST.format(a='l.bits', b='c.bits')} <= {T}), c.node) as leader from c),
 p as (select f.ord, f.bits, o.node, o.leader, lc.file_ord as leader_file, lc.bits as leader_bits
   from fingerprints f join c on c.bits = f.bits join o on o.node = c.node join c lc on lc.node = o.leader)
"""


@register("dup_groups", _PLAN + """
select leader, ord as member, group_size from p join (select leader as g, count(*) as group_size from p group by leader having count(*) > 1) s on s.g = p.leader""")
def dup_groups(spark, sf_dir):
    return DD.groups(DD.dedup_plan(fixture(spark, sf_dir, "fingerprints"), T))


@register("dedup_removed", _PLAN + """
select ord, leader, case when bits = leader_bits then 'exact' else 'near' end as reason from p where ord <> leader_file""")
def dedup_removed(spark, sf_dir):
    return DD.removed(DD.dedup_plan(fixture(spark, sf_dir, "fingerprints"), T))


# incremental: block 2 is the existing store; every other row arrives in ord
# order and is checked against it
STORE_BLOCK = 2


@register("incremental_dedup", "with recursive" + _F[len("with"):] + f""",
 s as (select distinct bits from fingerprints where block = {STORE_BLOCK}),
 bt as (select ord as node, bits from fingerprints where block <> {STORE_BLOCK})""" +
          _walk("bt", f"(select coalesce(list(bits), []::varchar[]) from s)") + """
select node as ord, case when is_kept then 'new' else 'duplicate' end as status from walk where node is not null""")
def incremental_dedup(spark, sf_dir):
    fp = fixture(spark, sf_dir, "fingerprints")
    store = fp.filter(F.col("block") == STORE_BLOCK)
    batch = fp.filter(F.col("block") != STORE_BLOCK)
    return DD.incremental(batch, store, T)


@register("indexed_dedup", ORACLE["incremental_dedup"])
def indexed_dedup(spark, sf_dir):
    """The same through a stored index of three batches, one of them written twice,
    compacted between."""
    fp = fixture(spark, sf_dir, "fingerprints")
    index = HashIndex(spark, scratch_dir(spark, "hash-index"), T, shard_rows=1 << 16, most_batches=2)
    stored = write_table(DD.with_hash(fp.filter(F.col("block") == STORE_BLOCK)).select("hash").distinct(), "hash-index-rows")
    for batch in (0, 1, 2, 2):
        index.append(stored.filter(F.pmod("hash", F.lit(3)) == batch), batch)
    return DD.incremental(fp.filter(F.col("block") != STORE_BLOCK), index, T)


_REASON = f"""case when i.file_id is null then 'missing'
  when file_size < {C.MIN_FILE_BYTES} or file_size > {C.MAX_FILE_BYTES} then 'file_size'
  when format not in ('JPEG', 'PNG', 'WEBP') then 'format'
  when width < {C.MIN_SIDE} or height < {C.MIN_SIDE} or width > {C.MAX_SIDE} or height > {C.MAX_SIDE} then 'dimensions'
  when greatest(width, height) > least(width, height) * {C.MAX_ASPECT} then 'aspect_ratio'
  when not decodable then 'undecodable' end"""


@register("arrival_status", "with recursive" + duckdb_cte("fingerprints", "image_info")[len("with"):] + f""",
 a as (select f.ord, f.bits, {_REASON} as reason from fingerprints f left join image_info i on i.file_id = f.ord // 3),
 v as (select ord as node, bits from a where reason is null)""" + _walk("v") + """
select ord, 'invalid' as status from a where reason is not null
union all select node, case when is_kept then 'accepted' else 'duplicate' end from walk where node is not null""")
def arrival_status(spark, sf_dir):
    fp = fixture(spark, sf_dir, "fingerprints")
    info = fixture(spark, sf_dir, "image_info")
    arrivals = fp.join(info, F.floor(F.col("ord") / 3) == F.col("file_id"), "left")
    reason = F.when(F.col("file_id").isNull(), F.lit("missing")).otherwise(I.reject_reason())
    checked = arrivals.withColumn("reason", reason)
    valid = checked.filter(F.col("reason").isNull()).select("ord", "bits")
    status = DD.incremental(valid, None, T).select(
        "ord", F.when(F.col("status") == "new", F.lit("accepted")).otherwise(F.lit("duplicate")).alias("status"))
    invalid = checked.filter(F.col("reason").isNotNull()).select("ord", F.lit("invalid").alias("status"))
    return invalid.unionByName(status)
