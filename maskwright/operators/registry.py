"""Labels, models, archives and task states."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; a log of upserts, updates and deletions read as a table."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_candidates(found: DataFrame, limits: dict[str, float], priority: dict[str, int]) -> DataFrame:
    """Model candidates (doc_id, value, category, prob, ix): the best of each value, by category priority and then probability."""
    literal = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    good = found.withColumn("prio", F.coalesce(literal(priority)[F.col("category")], F.lit(0))).filter(F.col("prob") >= F.coalesce(literal(limits)[F.col("category")], F.lit(1.0)))
    w = Window.partitionBy("doc_id", "value").orderBy(F.desc("prio"), F.desc("prob"), "ix")
    return good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "prio")


def ordered_candidates(found: DataFrame, limits: dict[str, float], priority: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """What is selected of model candidates (doc_id, value, category, prob, ix, text_index, start), and how many are not.

    The first table is ``best_candidates`` with ``position``, from 1 in each document: by text_index (null: 0), start (null:
    -1), the longer value, then the value that passed first by ``ix``. The second has doc_id and ``rejected``, all candidates of a
    document less those selected, documents without a selected one too. A null or empty value is rejected.
    """
    named = found.filter("value <> ''")
    best = best_candidates(named, limits, priority)
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("category")], F.lit(1.0))
    first = named.filter(F.col("prob") >= limit).groupBy(F.col("doc_id").alias("_doc"), F.col("value").alias("_value")).agg(F.min("ix").alias("_first"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("value") == F.col("_value"))
    w = Window.partitionBy("doc_id").orderBy(F.coalesce("text_index", F.lit(0)), F.coalesce("start", F.lit(-1)), F.desc(F.length("value")), "_first")
    chosen = best.join(first, same).withColumn("position", F.row_number().over(w)).drop("_doc", "_value", "_first")
    kept = chosen.groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("_kept"))
    every = found.groupBy("doc_id").agg(F.count("*").alias("_all")).join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return chosen, every.select("doc_id", (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("rejected"))


def recover(tasks: DataFrame) -> DataFrame:
    """What an interrupted task becomes at a restart."""
    new = F.coalesce("previous_status", F.when(F.col("has_output"), "completed").when(F.col("has_mapping"), "review").otherwise("cancelled"))
    return tasks.withColumn("status", F.when(F.col("status") == "processing", new).otherwise(F.col("status")))


def manifest_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files of a manifest (path, sha) that are missing or differ."""
    a = actual.select("path", F.col("sha").alias("found"))
    return expected.join(a, "path", "left").filter("found is null or found <> sha").select("path", "sha", "found")


def archive_guard(entries: DataFrame, most: int = 5000, entry_bytes: int = 80 << 20, total_bytes: int = 250 << 20, ratio: float = 200.0) -> DataFrame:
    """Per archive of (archive, entry, size, csize): count, total, largest ratio and whether it is safe to open."""
    bad_path = F.col("entry").rlike(r"^[/\\]|(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:")
    out = entries.groupBy("archive").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("total"), F.max("size").alias("largest"), F.max(F.col("size") / F.greatest(F.col("csize"), F.lit(1))).alias("ratio"), F.count_if(bad_path).alias("bad"))
    safe = (F.col("n") <= most) & (F.col("total") <= total_bytes) & (F.col("largest") <= entry_bytes) & (F.col("ratio") <= ratio) & (F.col("bad") == 0)
    return out.select("archive", "n", "total", F.round("ratio", 4).alias("ratio"), safe.alias("safe"))


def encrypt(column, key: str) -> F.Column:
    """AES-GCM under the SHA-256 of a secret; the same text differs each time."""
    return F.base64(F.aes_encrypt(column, F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")))


def decrypt(column, key: str) -> F.Column:
    """Null when the key or the data is wrong."""
    return F.try_aes_decrypt(F.unbase64(column), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")).cast("string")


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def pads(secret: str) -> tuple[str, str]:
    """The inner and outer pad of the fingerprints under a secret, in hex."""
    return tuple(x.hex() for x in _pads(hashlib.sha256(secret.encode()).digest()))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed digest of a text or binary column, in hex: two nested SHA-256 over the padded key, in built-in expressions."""
    inner, outer = map(F.lit, _pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def fingerprint(text: Column, category: Column, secret: str) -> Column:
    """What labels are told apart by without their texts: the keyed digest of category and text under the SHA-256 of a secret."""
    return hmac_sha256(hashlib.sha256(secret.encode()).digest(), F.concat(category, F.lit("\0"), text))


def upsert_labels(labels: DataFrame, new: DataFrame, secret: str) -> DataFrame:
    """``labels`` (category, fingerprint, cipher, active) with ``new`` (text, category) in: created, or active again, or as they were.

    ``changed`` tells which rows were created or woke up; these get their text encrypted anew. Several of ``new`` with one
    text and category are one label. Rows of ``new`` without a text or category are none.
    """
    named = new.filter("text is not null and category is not null").select("text", "category").distinct().withColumn("fingerprint", fingerprint(F.col("text"), F.col("category"), secret))
    both = labels.withColumn("_old", F.lit(True)).join(named, ["category", "fingerprint"], "full")
    changed = F.col("text").isNotNull() & ~F.coalesce(F.col("active"), F.lit(False))
    out = both.withColumn("changed", changed)
    return out.select("category", "fingerprint", F.when(F.col("changed"), encrypt(F.col("text"), secret)).otherwise(F.col("cipher")).alias("cipher"), (F.col("changed") | F.coalesce("active", F.lit(False))).alias("active"), "changed")


def annotation_counts(payloads: DataFrame, secret: str) -> DataFrame:
    """``payloads`` with ``annotation_count`` in the place of ``annotations``, encrypted JSON: its number of entities, 0 where there is none or it can't be read."""
    plain = F.from_json(decrypt(F.col("annotations"), secret), "entities array<string>")
    return payloads.withColumn("annotation_count", F.coalesce(F.size(plain["entities"]), F.lit(0))).withColumn("annotation_count", F.greatest("annotation_count", F.lit(0))).drop("annotations")


def registry_listing(artifacts: DataFrame) -> DataFrame:
    """(id, name, version, file_count, is_active) of model packages, file_count being that of their manifests (a map, null: none)."""
    return artifacts.select("id", "name", "version", F.coalesce(F.greatest(F.size("manifest"), F.lit(0)), F.lit(0)).alias("file_count"), F.coalesce("is_active", F.lit(False)).alias("is_active"))


def active_model(artifacts: DataFrame, base: str) -> DataFrame:
    """One row: active_artifact_id, the first active package by id or '', and whether the ``base`` model serves."""
    found = artifacts.filter("is_active").agg(F.min("id").alias("id"))
    return found.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("active_artifact_id"), F.lit(base).alias("base_model"), F.col("id").isNull().alias("base_is_active"))
