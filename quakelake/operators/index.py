"""Keeping a document index in step with its files: change detection, eviction, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakelake.operators.common import top_k

# File formats that can be indexed, and index files that rank first.
SUPPORTED = [".pdf", ".docx", ".md", ".txt", ".text", ".rst", ".html", ".htm"]
INDEX_NAMES = ["readme.md", "readme.rst", "readme.txt", "index.md", "index.rst", "readme"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def priority(path: Column) -> Column:
    """``struct(tier, depth)``: index files, then Markdown, text, PDF, DOCX, HTML; shallow first."""
    ext = extension(path)
    tier = (
        F.when(F.lower(file_name(path)).isin(INDEX_NAMES), 0)
        .when(ext.isin(".md", ".rst"), 1)
        .when(ext.isin(".txt", ".text"), 2)
        .when(ext == ".pdf", 3)
        .when(ext == ".docx", 4)
        .when(ext.isin(".html", ".htm"), 5)
        .otherwise(9)
    )
    return F.struct(tier.alias("tier"), F.size(F.split(path, "/")).alias("depth"))


def supported(path: Column) -> Column:
    return extension(path).isin(SUPPORTED) & ~F.startswith(file_name(path), F.lit("."))


def project_of(rel_path: Column) -> Column:
    """First folder of a relative path; empty for a file at the root."""
    return F.when(F.contains(rel_path, F.lit("/")), F.element_at(F.split(rel_path, "/"), 1)).otherwise("")


def key_files(listing: DataFrame, path_col: str = "rel_path", max_files: int | None = None) -> DataFrame:
    """Supported files; of each project the ``max_files`` of highest priority, if given (root files all)."""
    path = F.col(path_col)
    usable = listing.filter(supported(path)).withColumn("project", project_of(path)).withColumn("__p", priority(path))
    if max_files is None:
        return usable.drop("__p")
    root = usable.filter(F.col("project") == "")
    inside = top_k(usable.filter(F.col("project") != ""), ["project"], [F.asc("__p"), F.asc(path_col)], max_files, "__r")
    return root.unionByName(inside.drop("__r")).drop("__p")


def fingerprint(content: Column) -> Column:
    """SHA-256 of all bytes."""
    return F.sha2(content.cast("binary"), 256)


def document_id(folder: Column, name: Column, content: Column) -> Column:
    """Content id: 12 hex digits of the MD5 of ``folder/name|content``."""
    return F.substring(
        F.md5(F.concat(F.concat(folder, F.lit("/"), name, F.lit("|")).cast("binary"), content.cast("binary"))), 1, 12
    )


def manifest_diff(
    listing: DataFrame, manifest: DataFrame, live: DataFrame, key: str = "rel_path"
) -> DataFrame:
    """State of every file: new, modified, unchanged, failed or deleted.

    ``listing`` has key, mtime (seconds), size, sha256; ``manifest`` adds status and doc_id;
    ``live`` holds the doc_ids in the store. A file indexed earlier whose document is gone is new.
    """
    old = manifest.select(
        F.col(key).alias("__key"), F.col("mtime").alias("__mtime"), F.col("size").alias("__size"),
        F.col("sha256").alias("__sha"), F.col("status").alias("__status"), F.col("doc_id").alias("__doc"),
    )
    alive = live.select(F.col("doc_id").alias("__doc")).distinct().withColumn("__alive", F.lit(True))
    both = (
        listing.select(key, "mtime", "size", "sha256", F.lit(True).alias("__here"))
        .join(old, F.col(key) == F.col("__key"), "full_outer")
        .join(alive, "__doc", "left")
    )
    same = (
        (F.abs(F.col("mtime") - F.coalesce("__mtime", F.lit(0.0))) < 1.0)
        & (F.col("size") == F.coalesce("__size", F.lit(-1)))
        & (F.col("sha256") == F.coalesce("__sha", F.lit("")))
    )
    lost = (F.coalesce(F.col("__doc").cast("string"), F.lit("")) != "") & F.col("__alive").isNull()
    state = (
        F.when(F.col("__here").isNull(), "deleted")
        .when(F.col("__key").isNull(), "new")
        .when(F.col("__status") == "failed", "failed")
        .when(F.coalesce("__status", F.lit("")) != "indexed", "new")
        .when(~same, "modified")
        .when(lost, "new")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce(key, "__key").alias(key), F.col("__doc").alias("doc_id"), state.alias("state"))


def pending(diff: DataFrame) -> DataFrame:
    """Files to index next: new, modified, and failed ones to retry."""
    return diff.filter(F.col("state").isin("new", "modified", "failed"))


def changed_projects(diff: DataFrame, known: DataFrame, key: str = "rel_path") -> DataFrame:
    """Projects never indexed before, and known ones with files to index."""
    per = (
        diff.filter(F.col("state") != "deleted")
        .withColumn("project", project_of(F.col(key)))
        .filter(F.col("project") != "")
        .groupBy("project")
        .agg(F.count_if(F.col("state") != "unchanged").alias("n_pending"))
    )
    seen = known.select("project").distinct().withColumn("__k", F.lit(True))
    return (
        per.join(seen, "project", "left")
        .withColumn("state", F.when(F.col("__k").isNull(), "new").when(F.col("n_pending") > 0, "updated"))
        .filter(F.col("state").isNotNull())
        .select("project", "state", "n_pending")
    )


def project_status(selected: DataFrame, diff: DataFrame, manifest: DataFrame, key: str = "rel_path") -> DataFrame:
    """Per project: files selected, indexed and failed, and a label.

    ``new`` before anything is indexed, ``modified`` with new or changed files, ``partial`` when
    some selected files are not indexed, else ``indexed``. Root files are their own projects.
    """
    merged = (
        selected.select(key)
        .join(manifest.select(key, F.col("status").alias("__s")), key, "left")
        .join(diff.select(key, "state"), key, "left")
        .withColumn("project", F.when(project_of(F.col(key)) == "", F.col(key)).otherwise(project_of(F.col(key))))
    )
    counted = merged.groupBy("project").agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("__s") == "indexed").alias("n_indexed"),
        F.count_if(F.col("__s") == "failed").alias("n_failed"),
        F.count_if(F.col("state").isin("new", "modified")).alias("n_changed"),
    )
    label = (
        F.when(F.col("n_indexed") == 0, "new")
        .when(F.col("n_changed") > 0, "modified")
        .when(F.col("n_indexed") < F.col("n_files"), "partial")
        .otherwise("indexed")
    )
    return counted.withColumn("status", label).drop("n_changed")


def evict_missing(documents: DataFrame, chunks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks left after dropping documents whose stored file is gone.

    Documents without a stored file (empty ``file_path``) stay.
    """
    present = files.select(F.col("path").alias("file_path")).distinct()
    stale = documents.filter(F.coalesce("file_path", F.lit("")) != "").join(present, "file_path", "left_anti")
    gone = stale.select("doc_id")
    return documents.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def delete_documents(documents: DataFrame, chunks: DataFrame, doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without the named documents. Vectors sit on the chunks: no rebuild."""
    gone = doc_ids.select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def in_project(project: str, folder_col: str = "proj_folder", key: str = "rel_path") -> Column:
    return (F.col(folder_col) == project) | F.col(key).startswith(project + "/")


def delete_project(
    manifest: DataFrame, documents: DataFrame, chunks: DataFrame, project: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, documents and chunks without one project's files."""
    test = F.coalesce(in_project(project), F.lit(False))
    gone = manifest.filter(test & (F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "")).select("doc_id")
    docs, left = delete_documents(documents, chunks, gone)
    return manifest.filter(~test), docs, left


def new_documents(candidates: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Candidates whose content id is not stored yet, each id once (first by ``order``)."""
    others = [c for c in candidates.columns if c != "doc_id"]
    first = (
        candidates.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.col(order)).alias("__c")).select("doc_id", "__c.*")
    )
    return first.join(existing.select("doc_id"), "doc_id", "left_anti")


def override_union(layers: Sequence[DataFrame], key: str = "name") -> DataFrame:
    """Union of catalogs in which later layers shadow earlier entries of the same name."""
    merged = None
    for level, layer in enumerate(layers):
        tagged = layer.withColumn("__level", F.lit(level))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    others = [c for c in merged.columns if c not in (key, "__level")]
    return (
        merged.groupBy(key).agg(F.max_by(F.struct(*others), F.col("__level")).alias("__e")).select(key, "__e.*")
    )


def all_documents(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Documents of both stores; the primary store's record wins."""
    extra = fallback.join(primary.select("doc_id"), "doc_id", "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True).orderBy(F.desc("added_at"), "doc_id")


def catalog_listing(catalog: DataFrame) -> DataFrame:
    """Entries without their bodies: metadata and the names of their reference files."""
    keep = [c for c in ("name", "description", "category", "keywords", "source", "rag_sources", "related") if c in catalog.columns]
    listed = catalog.select(*keep, *([F.map_keys("references").alias("reference_names")] if "references" in catalog.columns else []))
    return listed.orderBy("name")
