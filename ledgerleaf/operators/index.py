"""Vector and graph stores as keyed tables: embedding, routing, incremental sync, upserts, deletes, catalog."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerleaf.functions import text as T

# Vector collection by node type (other types are sections) and by graph label (other labels are not indexed); dimensions of models.
COLLECTIONS = {
    "document": "documents", "act_title": "documents", "preamble": "documents", "chapter": "chapters", "part": "chapters",
    "section": "sections", "sub_section": "sections", "explanation": "sections", "illustration": "sections", "proviso": "sections",
    "clause": "clauses", "sub_clause": "clauses", "schedule": "clauses", "appendix": "clauses",
}
LABEL_COLLECTIONS = {"Document": "documents", "Chapter": "chapters", "Part": "chapters", "Section": "sections", "Clause": "clauses", "Schedule": "clauses"}
MODELS = {"hash": 64, "bge-m3": 1024, "labse": 768, "muril": 768, "indic-bert": 768}


def hash_embed_udf(dim: int = 64):
    """Signed hashed counts of word tokens by 8-byte blake2b, L2-normalised; blank texts give zeros. Arrow batches."""
    word = re.compile(r"\w+")

    def one(text: str | None) -> list[float]:
        v = np.zeros(dim)
        for token in word.findall((text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest())
            v[h % dim] += -1.0 if h & 1 else 1.0  # the sign is the parity of the low bytes
        n = np.linalg.norm(v)
        return (v / n if n else v).astype("float32").tolist()

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return text.map(one)

    return embed


def md5_buckets(docs: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, bucket, weight): the same shape of embedding from built-ins alone, as a sparse long table."""
    toks = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)).alias("t"))
    h = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 8), 16, 10).cast("long")
    sign = F.when(F.floor(h / dim) % 2 == 0, 1).otherwise(-1)
    return toks.groupBy(key, (h % dim).alias("bucket")).agg(F.sum(sign).alias("weight"))


def node_text(title: Column, text: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(text, F.lit(""))))


def collection_of(node_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in COLLECTIONS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, node_type), F.lit("sections"))


def label_collection(label: Column) -> Column:
    """The collection of a graph label; null for labels that are not indexed."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LABEL_COLLECTIONS.items() for x in kv)), label)


def changed(current: DataFrame, indexed: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``current`` that are new or whose digest differs from the indexed one."""
    old = indexed.select(F.col(key), F.col(digest).alias("old_digest"))
    return current.join(old, key, "left").where(F.col("old_digest").isNull() | (F.col("old_digest") != F.col(digest))).drop("old_digest")


def stale(current: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    return indexed.select(key).join(current.select(key), key, "left_anti")


def synced(current: DataFrame, indexed: DataFrame, key: str, digest: str) -> DataFrame:
    """The index after a sync: unchanged rows stay as they are, new and changed ones come from ``current``, stale ones go."""
    fresh = changed(current, indexed, key, digest)
    keep = indexed.join(stale(current, indexed, key), key, "left_anti").join(fresh.select(key), key, "left_anti")
    return keep.unionByName(fresh)


def upserted(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n_ = 1").drop("n_")


def point_id(node: Column) -> Column:
    """A name-based version-5 UUID of the node in a fixed namespace (DNS)."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, node.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def merge_nodes_table(nodes: DataFrame, updates: DataFrame, key: str = "node_id") -> DataFrame:
    """Create or update nodes: updates win column by column where they are not null."""
    u = updates.select(key, *(F.col(c).alias(f"u_{c}") for c in updates.columns if c != key))
    joined = nodes.join(u, key, "full")
    return joined.select(key, *(F.coalesce(f"u_{c}", c).alias(c) if f"u_{c}" in u.columns else F.col(c) for c in nodes.columns if c != key))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given node_ids and without edges at them."""
    g = gone.select("node_id")
    left = edges.join(g.withColumnRenamed("node_id", "src"), "src", "left_anti").join(g.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(g, "node_id", "left_anti"), left.select(*edges.columns)


class Collections:
    """Vector collections as catalog tables; ``dim`` is checked on write."""

    def __init__(self, spark: SparkSession, prefix: str = "vec_") -> None:
        self.spark, self.prefix = spark, prefix

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.prefix + name)

    def create(self, name: str, rows: DataFrame, dim: int) -> None:
        checked = rows.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"embedding is not of {dim} dimensions"))))
        checked.write.mode("overwrite").saveAsTable(self.prefix + name)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self.prefix + name)

    def delete(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}{name}")


def embed_text(docs: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    return docs.withColumn("embedding", hash_embed_udf(dim)(F.col(text)))


def payload_digest(title: Column, text: Column) -> Column:
    return F.md5(node_text(title, text).cast("binary"))


def ingest(raw: DataFrame) -> DataFrame:
    """Raw (path, text) to processed documents: id, title, language, cleaned text."""
    clean = T.clean_text(F.col("text"))
    stem = F.initcap(F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "[_-]+", " "))
    return raw.select(T.document_id(F.col("path"), F.col("text")).alias("document_id"), clean.alias("text"), "path").withColumns({"title": T.title_of(F.col("text"), stem), "language": T.detect_language(F.col("text"))})


class IndexLog:
    """An index as a log of batches, for streams: ``batch=<id>`` has what changed in that micro-batch.

    A batch is compared with the batches before it alone and replaces its own folder, so replaying it writes the same
    rows; nothing else is ever rewritten. Reading takes each key's newest row and leaves out deleted ones. ``key`` and
    ``digest`` name columns; a row whose ``deleted`` is true removes its key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, digest: str) -> None:
        self.spark, self.path, self.key, self.digest = spark, path.rstrip("/"), key, digest
        self.schema = f"{schema}, deleted boolean"

    def log(self, before: int | None = None) -> DataFrame:
        """All rows of the batches (before the given one), with their ``batch``."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        rows = self.spark.read.schema(f"{self.schema}, batch long").parquet(self.path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def current(self, before: int | None = None) -> DataFrame:
        rows = self.log(before)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), "batch").alias("x"))
        return newest.select("x.*").where("not coalesce(deleted, false)").drop("deleted")

    def sync(self, rows: DataFrame, batch: int) -> None:
        """Store what a micro-batch changes: new keys, other digests, and deletions of keys that are there."""
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        names = [c.split()[0] for c in self.schema.split(", ")]
        one = rows.dropDuplicates([self.key]).select(*names)
        had = self.current(batch).select(F.col(self.key), F.col(self.digest).alias("had"))
        fresh = one.join(had, self.key, "left")
        gone = F.coalesce("deleted", F.lit(False))
        keep = fresh.where(F.when(gone, F.col("had").isNotNull()).otherwise(F.col("had").isNull() | (F.col("had") != F.col(self.digest))))
        keep.select(*names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
