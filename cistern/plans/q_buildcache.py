"""Build cache queries."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import buildcache
from .bindings import bind
from .registry import query

NOW = datetime(1999, 1, 1)
NOW_SQL = "timestamp '1999-01-01 00:00:00'"
INDEXED = datetime(1998, 6, 1)
INDEXED_SQL = "timestamp '1998-06-01 00:00:00'"

V2_SQL = f""", v2 as (select regexp_extract(key, '^(.+)/build_cache/', 1) as prefix,
    regexp_extract(key, '-([^-.]+)[.]', 1) as hash,
    max(key) filter (key like '%{fixed.V2_SUFFIXES[0]}') as meta,
    max(key) filter (key like '%{fixed.V2_SUFFIXES[1]}') as archive,
    arg_max(size, key) filter (key like '%{fixed.V2_SUFFIXES[1]}') as any_size from b_object_keys group by all)"""


@query("catalog_v2", V2_SQL + "select prefix, hash, meta, archive from v2", "object_keys")
def catalog_v2(spark, sf):
    rows = buildcache.catalog_v2(bind(spark, sf, "object_keys"))
    return rows.select("prefix", "hash", "meta", "archive")


@query(
    "catalog_v3",
    """select regexp_extract(key, '^(.+)/v3/manifests', 1) as prefix, hash, max(key) as manifest
      from b_manifest_keys group by all""",
    "manifest_keys",
)
def catalog_v3(spark, sf):
    return buildcache.catalog_v3(bind(spark, sf, "manifest_keys"))


def _split(spark, sf):
    catalog = buildcache.catalog_v2(bind(spark, sf, "object_keys"))
    return buildcache.split_stacks(catalog, "develop", ["stack3"])


@query(
    "split_stacks",
    V2_SQL
    + """select hash, case when prefix <> 'develop' then substr(prefix, 9) end as stack from v2
      where prefix <> 'develop/stack3'""",
    "object_keys",
)
def split_stacks(spark, sf):
    stacks, top = _split(spark, sf)
    none = F.lit(None).cast("string").alias("stack")
    return stacks.select("hash", "stack").unionByName(top.select("hash", none))


@query(
    "blob_path",
    """select key, 'develop' || coalesce('/' || stack, '') || '/blobs/sha256/' || substr(spec_sum, 1, 2) || '/'
        || spec_sum as blob_path, cast(null as varchar) as reason from b_manifest_keys
      where spec_sum is not null
    union all select 'none', null, 'missing checksum' from b_manifest_keys where spec_sum is null""",
    "manifest_keys",
)
def blob_path(spark, sf):
    rows = bind(spark, sf, "manifest_keys").select(
        "key", F.concat_ws("/", F.lit("develop"), "stack").alias("prefix"),
        F.lit("sha256").alias("algorithm"), F.col("spec_sum").alias("checksum"),
    )
    good, rejects = buildcache.blob_path(rows)
    none = F.lit(None).cast("string")
    return good.select("key", "blob_path", none.alias("reason")).unionByName(
        rejects.select(F.lit("none").alias("key"), none.alias("blob_path"), "reason")
    )


def _blobs():
    """Content of each manifest: the first of two metadata blobs counts."""
    def blob(media, checksum):
        return F.struct(
            F.lit(10).cast("bigint").alias("contentLength"), F.lit(media).alias("mediaType"),
            F.lit("gzip").alias("compression"), F.lit("sha256").alias("checksumAlgorithm"),
            F.col(checksum).alias("checksum"),
        )

    return F.array(
        blob("other", "hash"), blob(fixed.TARBALL_MEDIA_TYPE, "tar_sum"),
        blob(fixed.SPEC_MEDIA_TYPE, "spec_sum"), blob(fixed.SPEC_MEDIA_TYPE, "hash"),
    )


def _manifests(spark, sf):
    """Catalog entries and one manifest document per stack and hash."""
    rows = bind(spark, sf, "manifest_keys")
    stacks, top = buildcache.split_stacks(buildcache.catalog_v3(rows), "develop")
    data = _blobs()
    sums = rows.where("stack IS NOT NULL").select("stack", "hash", "spec_sum", "tar_sum")
    documents = sums.distinct().select("stack", "hash", data.alias("data"))
    return buildcache.manifest_blobs(stacks, documents, "develop"), top


MANIFEST_SQL = """, mb as (select distinct stack, hash, max(key) over (partition by stack, hash) as manifest,
    'develop/' || stack || '/blobs/sha256/' || substr(spec_sum, 1, 2) || '/' || spec_sum as meta,
    case when spec_sum is not null then 'develop/' || stack || '/blobs/sha256/' ||
      substr(tar_sum, 1, 2) || '/' || tar_sum end as archive
    from b_manifest_keys where stack is not null),
  ms as (select * from mb where meta is not null and archive is not null and hash not in
    (select hash from b_manifest_keys where stack is null)),
  pick as (select hash, min(stack) as stack from ms group by hash)"""


@query(
    "manifest_blobs",
    MANIFEST_SQL + "select stack, hash, manifest, meta, archive from mb",
    "manifest_keys",
)
def manifest_blobs(spark, sf):
    stacks, _ = _manifests(spark, sf)
    return stacks.select("stack", "hash", "manifest", "meta", "archive")


def _missing(spark, sf):
    objects = bind(spark, sf, "manifest_keys").select("key", _blobs().alias("data"))
    return buildcache.missing_by_hash(objects, "develop")


@query("missing_at_top", MANIFEST_SQL + "select stack, hash, archive from ms", "manifest_keys")
def missing_at_top(spark, sf):
    return buildcache.entries_of(_missing(spark, sf)).select("stack", "hash", "archive")


@query(
    "missing_summary",
    MANIFEST_SQL
    + """select hash, string_agg(stack, ',' order by stack) as viable_stacks,
      cast(null as bigint) as total_missing from ms group by hash
    union all select null, null, count(distinct hash) from ms""",
    "manifest_keys",
)
def missing_summary(spark, sf):
    per_hash, total = buildcache.summary_of(_missing(spark, sf))
    none = F.lit(None).cast("string")
    return per_hash.select(
        "hash", "viable_stacks", F.lit(None).cast("bigint").alias("total_missing")
    ).unionByName(
        total.select(none.alias("hash"), none.alias("viable_stacks"), "total_missing")
    )


@query(
    "publish_plan",
    MANIFEST_SQL
    + """, c as (select ms.* from ms join pick using (hash, stack)),
    k as (select hash, stack, 0 as step, 'archive' as kind, archive as src from c
      union all select hash, stack, 1, 'meta', meta from c
      union all select hash, stack, 2, 'manifest', manifest from c)
    select *, 'develop/' || substr(src, length('develop/' || stack || '/') + 1) as dst from k""",
    "manifest_keys",
)
def publish_plan(spark, sf):
    return buildcache.plan_of(_missing(spark, sf), "develop")


def _spec_documents(spark, sf):
    """One spec document per order, with gaps of each kind that stops a migration."""
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "md5(concat('h', o_orderkey)) AS hash",
        "case when o_orderkey % 11 <> 0 then 'sha256' end AS hash_algorithm",
        "md5(concat('a', o_orderkey)) AS checksum",
        "concat('pkg', o_orderkey % 9) AS name",
        "'1.2' AS version",
        "case when o_orderkey % 13 = 0 then 'odd' else md5(concat('h', o_orderkey)) end AS spec_hash",
        "o_custkey AS meta_size",
        "md5(concat('b', o_orderkey)) AS meta_checksum",
    )


MIGRATE_SQL = V2_SQL + f""", done as (select distinct 'develop' || coalesce('/' || stack, '') as prefix, hash from b_manifest_keys),
  sz as (select prefix, hash, max(size) filter (key like '%{fixed.V2_SUFFIXES[1]}') as n from (
    select *, regexp_extract(key, '^(.+)/build_cache/', 1) as prefix,
      regexp_extract(key, '-([^-.]+)[.]', 1) as hash from b_object_keys) group by all),
  sd as (select md5(concat('h', o_orderkey)) as hash, o_orderkey % 11 <> 0 as has_alg,
    md5(concat('a', o_orderkey)) as checksum, 'pkg' || (o_orderkey % 9) as name,
    o_orderkey % 13 = 0 as odd, md5(concat('b', o_orderkey)) as meta_checksum from orders),
  pl as (select v2.prefix, v2.hash, meta, archive, sd.*, case when meta is null then 'no metadata'
    when archive is null then 'no archive' when (v2.prefix, v2.hash) in (select (prefix, hash) from done) then 'previously migrated'
    when sd.hash is null then 'metadata not readable' when not has_alg then 'no checksum'
    when odd then 'hash mismatch' end as skip
    from v2 left join sd on sd.hash = v2.hash)"""


@query(
    "migration_plan",
    MIGRATE_SQL
    + """select prefix, hash, skip as skip_reason,
      case when skip is null then prefix || '/blobs/sha256/' || substr(checksum, 1, 2) || '/' || checksum end as archive_path,
      case when skip is null then prefix || '/blobs/sha256/' || substr(meta_checksum, 1, 2) || '/' || meta_checksum end as meta_path,
      case when skip is null then prefix || '/v3/manifests/spec/' || name || '/' || name || '-1.2-' || hash || '.spec.manifest.json' end as manifest_path,
      case when skip is null then checksum end as manifest_checksum from pl""",
    "object_keys",
    "manifest_keys",
)
def migration_plan(spark, sf):
    catalog = buildcache.catalog_v2(bind(spark, sf, "object_keys"))
    listing = bind(spark, sf, "manifest_keys")
    specs = _spec_documents(spark, sf)
    # Every mirror moves below its own prefix, with the listing of that prefix.
    mirrors = ["develop", *[f"develop/{s}" for s in ("stack1", "stack2", "stack3")]]
    plan = buildcache.migration_plan(
        catalog.where(F.col("prefix").isin(*mirrors)), listing, specs, None
    )
    return plan.select(
        "prefix", "hash", "skip_reason", "archive_path", "meta_path", "manifest_path",
        F.get_json_object("manifest", "$.data[0].checksum").alias("manifest_checksum"),
    )


@query(
    "key_manifest_plan",
    """, k as (select 'develop/build_cache/_pgp/K' || doc_id || '.pub' as key, doc_id, text from documents)
    select key, 'K' || doc_id as key_id, octet_length(encode(text)) as size, sha256(text) as checksum,
      'develop/blobs/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) as blob_path,
      'develop/v3/manifests/key/K' || doc_id || '.key.manifest.json' as manifest_path
    from k""".replace(", k as", "WITH k as"),
)
def key_manifest_plan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "concat('develop/build_cache/_pgp/K', doc_id, '.pub') AS key",
        "cast(text AS binary) AS content",
    )
    plan = buildcache.key_manifest_plan(docs.select("key"), docs, "develop")
    return plan.select("key", "key_id", "size", "checksum", "blob_path", "manifest_path")


@query(
    "pick_mirror",
    V2_SQL
    + """, p as (select prefix, min(key) as pos from (select regexp_extract(key, '^(.+)/build_cache/', 1)
      as prefix, key from b_object_keys) group by prefix)
    select arg_min(prefix, pos) as prefix from p where ends_with('s3://bucket/develop/stack2', prefix)""",
    "object_keys",
)
def pick_mirror(spark, sf):
    catalog = buildcache.catalog_v2(bind(spark, sf, "object_keys"))
    first = F.min(F.least(F.coalesce("meta", "archive"), F.coalesce("archive", "meta")))
    prefixes = catalog.groupBy("prefix").agg(first.alias("pos"))
    return buildcache.pick_mirror(prefixes, "s3://bucket/develop/stack2")


@query(
    "index_holes",
    """, h as (select name || '/' || substr(hash, 1, 7) as item, not external and not in_buildcache as hole
      from b_cache_index)
    select item, cast(null as bigint) as total, cast(null as bigint) as present,
      cast(null as bigint) as missing from h where hole
    union all select null, count(*), count(*) filter (not hole), count(*) filter (hole) from h""",
    "cache_index",
)
def index_holes(spark, sf):
    holes, counts = buildcache.index_holes(bind(spark, sf, "cache_index"))
    none = [F.lit(None).cast("bigint").alias(c) for c in ("total", "present", "missing")]
    return holes.select("item", *none).unionByName(
        counts.select(F.lit(None).cast("string").alias("item"), "total", "present", "missing")
    )


@query(
    "keep_hashes",
    f""", k as (select l.stack, hash from b_locks l join b_lock_pipelines p on p.id = l.pipeline_id
      where ref = 'develop' and updated_at between {NOW_SQL} - interval '500' day and {NOW_SQL})
    select stack, hash from k union select 'develop', hash from k""",
    "locks",
    "lock_pipelines",
)
def keep_hashes(spark, sf):
    return buildcache.keep_hashes(
        bind(spark, sf, "locks"), bind(spark, sf, "lock_pipelines"), "develop", NOW, 500
    )


PRUNE_BINDINGS = ("listing", "cache_index", "keep")
PRUNE_SQL = f""", b as (select distinct hash from b_listing where kind = 'archive' and modified < {NOW_SQL}),
  bo as (select distinct hash from b_listing where kind = 'archive' and modified < {INDEXED_SQL}),
  m as (select distinct hash from b_listing where kind = 'meta'),
  i as (select distinct hash from b_cache_index where in_buildcache),
  k as (select hash from b_keep where hash is not null),
  direct as (select hash from b except select hash from k),
  orphans as (((select hash from m intersect select hash from i) except select hash from bo)
    union (select hash from bo except select hash from m))"""


def _prune_inputs(spark, sf):
    keep = bind(spark, sf, "keep").where("hash IS NOT NULL")
    return bind(spark, sf, "listing"), bind(spark, sf, "cache_index"), keep


def _direct(spark, sf):
    objects, _, keep = _prune_inputs(spark, sf)
    return buildcache.prune_direct(objects, keep, NOW)


@query("prune_direct", PRUNE_SQL + "select hash from direct", *PRUNE_BINDINGS)
def prune_direct(spark, sf):
    return _direct(spark, sf)


@query("prune_index", PRUNE_SQL + "select hash from i except select hash from k", *PRUNE_BINDINGS)
def prune_index(spark, sf):
    _, index, keep = _prune_inputs(spark, sf)
    return buildcache.prune_index(index, keep)


@query("prune_orphans", PRUNE_SQL + "select hash from orphans", *PRUNE_BINDINGS)
def prune_orphans(spark, sf):
    objects, index, _ = _prune_inputs(spark, sf)
    return buildcache.prune_orphans(objects, index, NOW, INDEXED)


@query(
    "files_to_prune",
    PRUNE_SQL + "select stack, hash, kind, size from b_listing where hash in (select hash from direct)",
    *PRUNE_BINDINGS,
)
def files_to_prune(spark, sf):
    objects, _, _ = _prune_inputs(spark, sf)
    out = buildcache.files_to_prune(objects, _direct(spark, sf))
    return out.select("stack", "hash", "kind", "size")


STALE_SQL = f""", st as (select p.repo, prefix,
    cast(regexp_extract(prefix, 'pr([0-9]+)_', 1) as bigint) as number from b_cache_prefixes p
    where regexp_matches(prefix, 'pr([0-9]+)_.*') and (repo is null or not exists (
      select 1 from b_mirror_prs m where m.repo = p.repo
        and m.number = cast(regexp_extract(prefix, 'pr([0-9]+)_', 1) as bigint)
        and m.state = 'open' and not m.draft and m.updated_at >= {NOW_SQL} - interval '14' day)))"""


def _stale(spark, sf):
    return buildcache.stale_pr_mirrors(
        bind(spark, sf, "cache_prefixes"), bind(spark, sf, "mirror_prs"), NOW
    )


@query("stale_pr_mirrors", STALE_SQL + "select * from st", "cache_prefixes", "mirror_prs")
def stale_pr_mirrors(spark, sf):
    return _stale(spark, sf)


@query(
    "reclaimable_size",
    STALE_SQL
    + """, o as (select c.prefix, l_orderkey, cast(floor(l_extendedprice) as bigint) as size
      from lineitem join b_cache_prefixes c on regexp_matches(c.prefix, 'pr' || l_orderkey || '_')),
    e as (select st.prefix, cast(coalesce(sum(size), 0) as bigint) as bytes, count(size) as objects
      from st left join o on o.prefix = st.prefix group by st.prefix)
    select * from e union all
    select null, cast(sum(bytes) as bigint), cast(sum(objects) as bigint) from e""".replace(
        "lineitem join b_cache_prefixes c on regexp_matches(c.prefix, 'pr' || l_orderkey || '_')",
        "lineitem join (select *, try_cast(regexp_extract(prefix, 'pr([0-9]+)_', 1) as bigint) as n "
        "from b_cache_prefixes) c on c.n = l_orderkey",
    ),
    "cache_prefixes",
    "mirror_prs",
)
def reclaimable_size(spark, sf):
    numbered = bind(spark, sf, "cache_prefixes").select(
        "prefix",
        F.regexp_extract("prefix", fixed.PR_PREFIX, 1).try_cast("bigint").alias("l_orderkey"),
    )
    objects = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .join(numbered, "l_orderkey")
        .select(
            F.concat(F.col("prefix"), F.lit("build_cache/f"), F.col("l_linenumber").cast("string"))
            .alias("key"),
            F.floor("l_extendedprice").cast("bigint").alias("size"),
        )
    )
    return buildcache.reclaimable_size(objects, _stale(spark, sf))


REF_KEYS = {
    "key": "concat(case o_custkey % 5 when 0 then 'develop' when 1 then concat('v0.', o_custkey % 30, '.0') "
    "when 2 then 'develop-2024-01-0' when 3 then 'develop-2024-01-07' else concat('pr', o_custkey) end, "
    "case o_orderkey % 6 when 0 then '' when 1 then '/deprecated' else concat('/stack', o_orderkey % 6) end, "
    "'/v3/', case when o_orderkey % 4 = 3 then 'specs/x.json' else 'manifests/index/index.manifest.json' end)",
    "sum": "md5(concat('i', o_custkey % 5, '-', o_custkey % 30, '-', o_orderkey % 6))",
    "blob": "o_custkey % 7 <> 6",
}
REFS_SQL = (
    "WITH k as (select "
    + ", ".join(f"{e} as {c}" for c, e in REF_KEYS.items())
    + """ from orders), u as (select key, min(sum) as sum, bool_or(blob) as blob from k group by key),
    p as (select *, split_part(key, '/', 1) as ref, split_part(key, '/', 2) as sub from u
      where ends_with(key, '/v3/manifests/index/index.manifest.json') and blob),
    l as (select ref, case when sub = 'v3' then 'root' else sub end as label,
      's3://bkt/' || regexp_extract(key, '^(.+)/v3/manifests', 1) || '/blobs/sha256/' || substr(sum, 1, 2)
        || '/' || sum as url from p
      where regexp_matches(ref, '^(develop-\\d+-\\d+-\\d+|develop|v\\d+\\.\\d+\\.\\d+)$')
        and sub not in ('deprecated', 'e4s-mac'))"""
)


def cache_entries(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        *[f"{e} AS {c}" for c, e in REF_KEYS.items()]
    )
    keys = rows.groupBy("key").agg(F.min("sum").alias("sum"), F.bool_or("blob").alias("blob"))
    blob = F.struct(
        F.when(F.col("blob"), fixed.INDEX_MEDIA_TYPE).otherwise("text/plain")
        .alias("mediaType"),
        F.lit("sha256").alias("checksumAlgorithm"), F.col("sum").alias("checksum"),
    )
    manifests = keys.select("key", F.array(blob).alias("data"))
    return buildcache.cache_refs(keys.select("key"), manifests, "bkt")


@query("cache_refs", REFS_SQL + " select * from l")
def cache_refs(spark, sf):
    return cache_entries(spark, sf)
