"""Build cache catalog: what is built where, what is missing, what can be pruned."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import is_true, matches_one_of
from .pipelines import _lit_ts

CATALOG = ("prefix", "hash")


def _parsed(listing: DataFrame, pattern: str, suffixes: Sequence[str]) -> DataFrame:
    """Keys of one shape with prefix, hash and suffix, by one regex evaluation per key.

    Most keys of a bucket are blobs, so the suffix is tested before the regex runs.
    """
    key = F.col("key")
    ending = F.lit(False)
    for suffix in suffixes:
        ending = ending | key.endswith(suffix)
    mark = "\u0001"
    parts = F.split(F.regexp_replace(key, pattern, f"$1{mark}$3{mark}$4"), mark)
    # Behind a generator the regex stays evaluated once: later filters are not merged into it.
    named = listing.where(ending).select("key", "size", F.explode(F.array(parts)).alias("_p"))
    return named.where(F.size("_p") == 3).select(
        F.get("_p", F.lit(0)).alias("prefix"),
        F.get("_p", F.lit(1)).alias("hash"),
        F.get("_p", F.lit(2)).alias("suffix"),
        "key",
        "size",
    )


def catalog_v2(listing: DataFrame) -> DataFrame:
    """One row per (prefix, hash) with the keys of its metadata and archive, NULL if absent.

    An aggregate over both kinds in one pass of the listing; of several keys of one kind the last
    in key order, the order in which a bucket lists them, is kept.
    """
    parts = _parsed(listing, fixed.V2_KEY, fixed.V2_SUFFIXES)
    is_meta = F.col("suffix") == fixed.V2_SUFFIXES[0]
    return parts.groupBy(*CATALOG).agg(
        F.max(F.when(is_meta, F.col("key"))).alias("meta"),
        F.max(F.when(~is_meta, F.col("key"))).alias("archive"),
        F.max_by("size", F.when(~is_meta, F.col("key"))).alias("archive_size"),
    )


def catalog_v3(listing: DataFrame) -> DataFrame:
    parts = _parsed(listing, fixed.V3_KEY, fixed.V3_SUFFIXES)
    return parts.groupBy(*CATALOG).agg(F.max("key").alias("manifest"))


def split_stacks(
    catalog: DataFrame, ref: str, exclude: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Entries below `ref/<stack>` with their stack, and the entries of ref itself.

    The ref is read as plain text, so a dot in it matches only a dot.
    """
    stack = F.regexp_extract("prefix", rf"\Q{ref}\E/(.+)", 1)
    stacks = catalog.withColumn("stack", stack).where(F.col("stack") != "")
    if exclude:
        stacks = stacks.where(~F.col("stack").isin(*exclude))
    return stacks, catalog.where(F.col("prefix") == ref)


def blob_key(prefix: Column, algorithm: Column, checksum: Column) -> Column:
    """`<prefix>/blobs/<algorithm>/<first two>/<checksum>`; NULL if a part is missing."""
    given = (F.coalesce(algorithm, F.lit("")) != "") & (F.coalesce(checksum, F.lit("")) != "")
    path = F.concat(
        prefix, F.lit("/blobs/"), algorithm, F.lit("/"), F.substring(checksum, 1, 2), F.lit("/"),
        checksum,
    )
    return F.when(given, path)


def blob_path(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds blob_path from prefix, algorithm and checksum; rows missing a part are rejects."""
    out = df.withColumn(
        "blob_path", blob_key(F.col("prefix"), F.col("algorithm"), F.col("checksum"))
    )
    gone = F.when(F.coalesce("algorithm", F.lit("")) == "", "missing algorithm").otherwise(
        "missing checksum"
    )
    rejects = out.where("blob_path IS NULL").select(
        F.col("prefix").alias("key"), F.lit("blob_path").alias("operator"), gone.alias("reason")
    )
    return out.where("blob_path IS NOT NULL"), rejects


def _first_blob(data: Column, media: str) -> Column:
    return F.get(F.filter(data, lambda b: b["mediaType"] == media), F.lit(0))


def manifest_paths(prefix: Column, data: Column) -> tuple[Column, Column]:
    """Metadata and archive paths that a manifest's blobs name; no archive without metadata."""
    def path(media: str) -> Column:
        blob = _first_blob(data, media)
        return blob_key(prefix, blob["checksumAlgorithm"], blob["checksum"])

    meta = path(fixed.SPEC_MEDIA_TYPE)
    return meta, F.when(meta.isNotNull(), path(fixed.TARBALL_MEDIA_TYPE))


def _manifest_sums(data: Column) -> dict[str, Column]:
    """What `manifest_paths` makes its paths of."""
    blobs = {
        "meta": _first_blob(data, fixed.SPEC_MEDIA_TYPE),
        "archive": _first_blob(data, fixed.TARBALL_MEDIA_TYPE),
    }
    out = {}
    for kind, blob in blobs.items():
        out |= {f"{kind}_algorithm": blob["checksumAlgorithm"], f"{kind}_sum": blob["checksum"]}
    return out


def manifest_blobs(stacks: DataFrame, manifests: DataFrame, ref: str) -> DataFrame:
    """Stack entries with the metadata and archive paths their manifests name.

    manifests: stack, hash, data (array of blobs). The first blob of each media type counts; an
    entry whose manifest lacks one, or a part of it, keeps NULL paths from there on.
    """
    prefix = F.concat(F.lit(f"{ref}/"), F.col("stack"))
    meta, archive = manifest_paths(prefix, F.col("data"))
    both = manifests.select("stack", "hash", meta.alias("meta"), archive.alias("archive"))
    return stacks.drop("meta", "archive").join(both, ["stack", "hash"], "left")


def missing_by_hash(objects: DataFrame, ref: str) -> DataFrame:
    """The complete entries (stack, meta, archive, manifest) of each hash that the top level lacks.

    objects: key and data (array of blobs) of manifests, each listed with its content. One pass and
    one shuffle, by hash, gives what `split_stacks`, `manifest_blobs` and `missing_at_top` give by
    joins; `entries_of`, `summary_of` and `plan_of` read off the rest. A hash gathers at most one
    entry per stack and document, however many objects name it.

    Rows are shuffled as they are read, without the parts of paths that stack and hash give: a
    listing names a key once, so gathering a hash's rows before the shuffle would only sort them.
    """
    ending = F.col("key").endswith(fixed.V3_SUFFIXES[0])
    mark = "\u0001"
    parts = F.split(F.regexp_replace("key", fixed.V3_KEY, f"$1{mark}$3{mark}$2"), mark)
    named = objects.where(ending).select("data", F.explode(F.array(parts)).alias("_p"))
    named = named.where(F.size("_p") == 3).select(
        F.get("_p", F.lit(0)).alias("prefix"), F.get("_p", F.lit(1)).alias("hash"),
        F.get("_p", F.lit(2)).alias("_middle"), "data",
    )
    stack = F.regexp_extract("prefix", rf"\Q{ref}\E/(.+)", 1)
    known = named.withColumn("stack", F.when(F.col("prefix") != ref, stack)).where(
        F.col("stack").isNull() | (F.col("stack") != "")
    )
    below = F.concat(F.lit(f"{ref}/"), F.col("stack"))
    # The prefix may hold more than the ref and the stack: it is kept only where it does.
    other = F.when(F.col("prefix") != below, F.col("prefix"))
    blobs = _manifest_sums(F.col("data"))
    in_stack = F.col("stack").isNotNull()
    rows = known.select(
        "hash", "stack", F.when(in_stack, other).alias("other"),
        *[F.when(in_stack, v).alias(c) for c, v in blobs.items()],
        F.when(in_stack, F.col("_middle")).alias("middle"),
    )
    entry = F.struct(*[c for c in rows.columns if c != "hash"])
    per_hash = rows.repartition("hash").groupBy("hash").agg(
        F.bool_or(F.col("stack").isNull()).alias("_top"),
        F.collect_set(F.when(F.col("stack").isNotNull(), entry)).alias("_all"),
    ).where(~F.col("_top"))

    def prefix(e: Column) -> Column:
        return F.coalesce(e["other"], F.concat(F.lit(f"{ref}/"), e["stack"]))

    def key(e: Column) -> Column:
        return F.concat(prefix(e), e["middle"], F.col("hash"), F.lit(fixed.V3_SUFFIXES[0]))

    def last_key(e: Column) -> Column:
        own = F.filter("_all", lambda o: o["stack"] == e["stack"])
        return F.array_max(F.transform(own, key))

    def path(e: Column, kind: str) -> Column:
        return blob_key(prefix(e), e[f"{kind}_algorithm"], e[f"{kind}_sum"])

    whole = F.filter(
        "_all", lambda e: path(e, "meta").isNotNull() & path(e, "archive").isNotNull()
    )
    entries = F.array_distinct(
        F.transform(
            whole,
            lambda e: F.struct(
                e["stack"].alias("stack"), path(e, "meta").alias("meta"),
                path(e, "archive").alias("archive"), last_key(e).alias("manifest"),
            ),
        )
    )
    return per_hash.select("hash", entries.alias("entries")).where(F.size("entries") > 0)


def entries_of(missing: DataFrame) -> DataFrame:
    """A row for each entry of `missing_by_hash`."""
    return missing.select("hash", F.inline("entries"))


def summary_of(missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`missing_summary` of `missing_by_hash`, without another shuffle of the hashes."""
    stacks = F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["stack"])))
    return (
        missing.select("hash", F.concat_ws(",", stacks).alias("viable_stacks")),
        missing.agg(F.count(F.lit(1)).alias("total_missing")),
    )


def plan_of(missing: DataFrame, ref: str, version: int = 3) -> DataFrame:
    """`publish_plan` of `missing_by_hash`, without another shuffle."""
    one = missing.select("hash", F.array_min("entries").alias("s"))
    return _copies(one, ref, version)


def missing_at_top(stacks: DataFrame, top: DataFrame) -> DataFrame:
    """Complete stack entries whose hash the top level does not have."""
    complete = stacks.where("meta IS NOT NULL AND archive IS NOT NULL")
    return complete.join(top.select("hash").distinct(), "hash", "left_anti")


def missing_summary(missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per hash the stacks that offer it, and one row with the number of missing hashes.

    A hash gathers at most one entry per stack, however many rows name it.
    """
    per_hash = missing.groupBy("hash").agg(F.collect_set("stack").alias("stacks"))
    listed = per_hash.select(
        "hash", F.concat_ws(",", F.array_sort("stacks")).alias("viable_stacks")
    )
    return listed, per_hash.agg(F.count(F.lit(1)).alias("total_missing"))


def publish_plan(missing: DataFrame, ref: str, version: int = 3) -> DataFrame:
    """Copies that bring each missing hash to the top level, from one of the stacks that has it.

    Copies of a hash are the same, so the first stack by name is taken. Archive before metadata
    before manifest: a reader never sees an entry whose files are not there yet.
    """
    fields = [c for c in ("stack", "meta", "archive", "manifest") if c in missing.columns]
    one = missing.groupBy("hash").agg(F.min_by(F.struct(*fields), "stack").alias("s"))
    return _copies(one, ref, version)


def _copies(one: DataFrame, ref: str, version: int) -> DataFrame:
    """A row for each copy of an entry (hash, s), in the order in which they are made."""
    kinds = ["archive", "meta"] + (["manifest"] if version == 3 else [])
    copies = one.select(
        "hash",
        F.col("s.stack").alias("stack"),
        F.posexplode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), F.col(f"s.{k}").alias("src"))
                    for k in kinds
                ]
            )
        ).alias("step", "copy"),
    ).select("hash", "stack", "step", "copy.kind", "copy.src")
    if version == 3:
        below = F.concat(F.lit(f"{ref}/"), F.col("stack"), F.lit("/"))
        rest = F.when(
            F.col("src").startswith(below), F.substr("src", F.length(below) + 1)
        )
        dst = F.concat(F.lit(f"{ref}/"), rest)
    else:
        rest = F.regexp_extract("src", r"/build_cache/(.+)$", 1)
        dst = F.concat(F.lit(f"{ref}/build_cache/"), F.nullif(rest, F.lit("")))
    return copies.withColumn("dst", dst)




def _blob(size: Column, media: str, compression: str, algorithm: Column, checksum: Column):
    return F.struct(
        size.alias("contentLength"), F.lit(media).alias("mediaType"),
        F.lit(compression).alias("compression"), algorithm.alias("checksumAlgorithm"),
        checksum.alias("checksum"),
    )


def migration_plan(
    catalog: DataFrame, listing: DataFrame, specs: DataFrame, target_prefix: str | None,
    force: bool = False,
) -> DataFrame:
    """What moving each old entry of a mirror to the new layout takes, or why it is skipped.

    catalog: catalog_v2 rows of the mirror
    specs: hash, hash_algorithm, checksum, name, version, spec_hash, meta_size, meta_checksum;
    the last two describe the compressed metadata that the caller has prepared
    target_prefix: None for the entries of several mirrors, each of which moves below its own prefix
    and is migrated where the listing has it there
    """
    own = ["hash"] if target_prefix is not None else [*CATALOG]
    migrated = _parsed(listing, fixed.V3_KEY, fixed.V3_SUFFIXES).select(*own).distinct()
    df = catalog.join(migrated.withColumn("_done", F.lit(True)), own, "left").join(
        specs.withColumn("_spec", F.lit(True)), "hash", "left"
    )
    has_sum = (F.coalesce("checksum", F.lit("")) != "") & (
        F.coalesce("hash_algorithm", F.lit("")) != ""
    )
    skip = (
        F.when(F.col("meta").isNull(), "no metadata")
        .when(F.col("archive").isNull(), "no archive")
        .when(F.coalesce("hash", F.lit("")) == "", "no hash")
        .when(F.lit(not force) & is_true(F.col("_done")), "previously migrated")
        .when(F.col("_spec").isNull(), "metadata not readable")
        .when(F.coalesce("archive_size", F.lit(0)) == 0, "no archive size")
        .when(~has_sum, "no checksum")
        .when(~is_true(F.col("spec_hash") == F.col("hash")), "hash mismatch")
    )
    target = F.col("prefix") if target_prefix is None else F.lit(target_prefix)
    sha = F.lit("sha256")
    manifest = F.struct(
        F.lit(3).alias("version"),
        F.array(
            _blob(F.col("archive_size"), fixed.TARBALL_MEDIA_TYPE, "gzip",
                  F.col("hash_algorithm"), F.col("checksum")),
            _blob(F.col("meta_size"), fixed.SPEC_MEDIA_TYPE, "gzip", sha,
                  F.col("meta_checksum")),
        ).alias("data"),
    )
    path = F.concat(
        target, F.lit("/v3/manifests/spec/"), F.col("name"), F.lit("/"), F.col("name"),
        F.lit("-"), F.col("version"), F.lit("-"), F.col("spec_hash"),
        F.lit(".spec.manifest.json"),
    )
    planned = df.withColumn("skip_reason", skip)
    go = F.col("skip_reason").isNull()
    return planned.select(
        "prefix",
        "hash",
        "skip_reason",
        F.when(go, blob_key(target, F.col("hash_algorithm"), F.col("checksum")))
        .alias("archive_path"),
        F.when(go, blob_key(target, sha, F.col("meta_checksum"))).alias("meta_path"),
        F.when(go, path).alias("manifest_path"),
        F.when(go, F.to_json(manifest)).alias("manifest"),
    )


def key_manifest_plan(listing: DataFrame, blobs: DataFrame, target_prefix: str) -> DataFrame:
    """New-layout paths and manifest of every public key in the listing.

    blobs: key, content (bytes of the key file)
    """
    key_id = F.regexp_extract("key", r"_pgp/([^/]+)\.pub$", 1)
    keys = listing.where(F.col("key").rlike(r"^[^\s]+\.pub$")).select("key").distinct()
    read = keys.join(blobs, "key").select(
        "key",
        key_id.alias("key_id"),
        F.sha2("content", 256).alias("checksum"),
        F.octet_length("content").cast("bigint").alias("size"),
    )
    target = F.lit(target_prefix)
    manifest = F.struct(
        F.lit(3).alias("version"),
        F.array(
            _blob(F.col("size"), fixed.KEY_MEDIA_TYPE, "none", F.lit("sha256"), F.col("checksum"))
        ).alias("data"),
    )
    return read.where("key_id <> ''").select(
        "key",
        "key_id",
        "size",
        "checksum",
        blob_key(target, F.lit("sha256"), F.col("checksum")).alias("blob_path"),
        F.concat(
            target, F.lit("/v3/manifests/key/"), F.col("key_id"), F.lit(".key.manifest.json")
        ).alias("manifest_path"),
        F.to_json(manifest).alias("manifest"),
    )


def pick_mirror(prefixes: DataFrame, url: str) -> DataFrame:
    """The first listed prefix that the url ends with."""
    fits = prefixes.where(F.lit(url).endswith(F.col("prefix")))
    return fits.agg(F.min_by("prefix", "pos").alias("prefix")).where("prefix IS NOT NULL")


def index_holes(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specs the index promises but the cache lacks, and one row of counts."""
    hole = ~F.col("external") & ~F.col("in_buildcache")
    holes = index.where(hole).select(
        "hash", F.concat(F.col("name"), F.lit("/"), F.substring("hash", 1, 7)).alias("item")
    )
    counts = index.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~hole).alias("present"),
        F.count_if(hole).alias("missing"),
    )
    return holes, counts


def keep_hashes(
    locks: DataFrame, pipelines: DataFrame, ref: str, now: datetime, days: int
) -> DataFrame:
    """Hashes to keep per stack, and all of them under develop.

    locks: pipeline_id, stack, hash; pipelines: id, ref, updated_at
    """
    since = _lit_ts(now - timedelta(days=days))
    recent = pipelines.where(
        (F.col("ref") == ref)
        & (F.col("updated_at") >= since)
        & (F.col("updated_at") <= _lit_ts(now))
    ).select(F.col("id").alias("pipeline_id"))
    kept = locks.join(recent, "pipeline_id", "left_semi")
    both = F.explode(F.array(F.col("stack"), F.lit("develop"))).alias("stack")
    return kept.select(both, "hash").distinct()


def _binaries(objects: DataFrame, cutoff: Column) -> DataFrame:
    old = objects.where((F.col("kind") == "archive") & (F.col("modified") < cutoff))
    return old.select("hash").distinct()


def prune_direct(objects: DataFrame, keep: DataFrame, cutoff: datetime) -> DataFrame:
    """Hashes of old binaries that are not kept."""
    old = _binaries(objects, _lit_ts(cutoff))
    return old.join(keep.select("hash").distinct(), "hash", "left_anti")


def prune_index(index: DataFrame, keep: DataFrame) -> DataFrame:
    """Hashes the index has in the build cache that are not kept."""
    have = index.where("in_buildcache").select("hash").distinct()
    return have.join(keep.select("hash").distinct(), "hash", "left_anti")


def prune_orphans(
    objects: DataFrame, index: DataFrame, cutoff: datetime, index_modified: datetime
) -> DataFrame:
    """Hashes with metadata or a binary but not both.

    Nothing newer than the index counts: it may still be waiting for its other half.
    """
    old = _binaries(objects, _lit_ts(min(cutoff, index_modified)))
    metas = objects.where("kind = 'meta'").select("hash").distinct()
    indexed = index.where("in_buildcache").select("hash")
    lone_meta = metas.join(indexed, "hash", "left_semi").join(old, "hash", "left_anti")
    lone_binary = old.join(metas, "hash", "left_anti")
    return lone_meta.unionByName(lone_binary).distinct()


def files_to_prune(objects: DataFrame, hashes: DataFrame) -> DataFrame:
    return objects.join(hashes.select("hash").distinct(), "hash", "left_semi")


def stale_pr_mirrors(
    prefixes: DataFrame, prs: DataFrame, now: datetime, days: int = 14
) -> DataFrame:
    """Mirror prefixes of pull requests that are no longer active.

    prefixes: repo (NULL at the top of the bucket), prefix; prs: repo, number, state, draft,
    updated_at. Prefixes at the top level always go: mirrors now live below their repository.
    """
    number = F.regexp_extract("prefix", fixed.PR_PREFIX, 1).try_cast("bigint")
    numbered = prefixes.withColumn("number", number).where("number IS NOT NULL")
    active = prs.where(
        (F.col("state") == "open")
        & ~F.col("draft")
        & (F.col("updated_at") >= _lit_ts(now - timedelta(days=days)))
    ).select("repo", "number")
    top = numbered.where("repo IS NULL")
    below = numbered.where("repo IS NOT NULL").join(active, ["repo", "number"], "left_anti")
    return top.select("repo", "prefix", "number").unionByName(
        below.select("repo", "prefix", "number")
    )


def reclaimable_size(objects: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Bytes below each doomed prefix, and their sum under the prefix NULL.

    Objects are added up by their folder, the key up to its last slash, where they are read: one
    row for each folder of a task is shuffled. A folder lies below every prefix that ends at one of
    its slashes, so a folder's own prefixes are looked up by equality.
    """
    last = F.length("key") - F.instr(F.reverse(F.col("key")), F.lit("/")) + 1
    folder = F.when(F.col("key").contains("/"), F.substring("key", F.lit(1), last))
    folders = objects.select(folder.alias("folder"), "size").where("folder IS NOT NULL")
    folders = folders.groupBy("folder").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    parts = F.split("folder", "/")
    own = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")),
    )
    sized = folders.withColumn("prefix", F.explode(own)).groupBy("prefix").agg(
        F.sum("size").cast("bigint").alias("bytes"), F.sum("n").cast("bigint").alias("objects")
    )
    doomed = prefixes.select("prefix").distinct()
    each = doomed.join(sized, "prefix", "left").select(
        "prefix",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("objects", F.lit(0)).alias("objects"),
    )
    total = each.agg(
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.sum("objects").cast("bigint").alias("objects"),
    )
    return each.unionByName(
        total.select(F.lit(None).cast("string").alias("prefix"), "bytes", "objects")
    )


def cache_refs(keys: DataFrame, manifests: DataFrame, bucket: str) -> DataFrame:
    """Label and index address of each listed mirror.

    keys: key of every object; manifests: key, data (array of blobs)
    """
    k = F.col("key")
    parts = F.split(k, "/")
    ref, sub = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    listed = keys.where(k.rlike(fixed.INDEX_MANIFEST)).select(
        "key", ref.alias("ref"),
        F.when(sub.rlike(fixed.LAYOUT_ROOT), "root")
        .when(~matches_one_of(sub, fixed.UNLISTED_STACKS), sub)
        .alias("label"),
        F.regexp_extract("key", r"^(.+)/v[\d]+/manifests", 1).alias("root"),
    )
    listed = listed.where(matches_one_of(F.col("ref"), fixed.LISTED_REFS) & F.col("label").isNotNull())
    blob = F.get(
        F.filter("data", lambda b: b["mediaType"].startswith(fixed.INDEX_MEDIA_PREFIX)), F.lit(0)
    )
    found = manifests.select("key", blob.alias("blob")).where("blob IS NOT NULL")
    path = blob_key(F.col("root"), F.col("blob.checksumAlgorithm"), F.col("blob.checksum"))
    return listed.join(found, "key").select(
        "ref", "label", F.concat(F.lit(f"s3://{bucket}/"), path).alias("url")
    )


