"""Sinks: feature tables with the policy they were made under, reports, manifests."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The policy that a feature table is made under.
POLICY = {
    "causal_policy": "strict_timestamp_block",
    "same_timestamp_policy": "block_frozen_t_minus",
    "label_release_policy": "release_time_strictly_less_than_candidate_timestamp",
}
#: What the tables of a kind also say, and what they say alike.
KINDS = {
    "base": ((), {}),
    "green": (("delays_days", "alphas", "ego_radius", "max_ego_nodes"), {"cache_version": "block_causal_v1"}),
    "precision": (("delay_days", "history_alpha", "precision_alpha", "ego_radius", "max_ego_nodes"), {"cache_version": "block_causal_v1"}),
    "posterior": (("delay_days", "alpha", "ego_radius", "max_ego_nodes"), {"cache_version": "block_causal_posterior_v1"}),
    "warm": (("score_start", "score_end", "delay_days"), {"cache_version": "warmstart_block_causal", "warm_start_policy": "prefix_history_from_all_prior_rows"}),
}
#: Where a column of the Parquet schema carries the policy.
_KEY = "causal"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)  # not by Spark's readers, which skip names with an underscore
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def policy(kind: str, **meta: object) -> dict[str, object]:
    """The policy of a kind of table with what is given; a key that the kind has to say and that is missing raises."""
    needed, alike = KINDS[kind]
    missing = [k for k in needed if k not in meta]
    if missing:
        raise ValueError(f"a table of kind {kind} also says {', '.join(missing)}")
    return json.loads(json.dumps({**POLICY, **alike, **meta}))


def write_features(df: DataFrame, path: str, partition_by: str | None = None, narrow: bool = True, kind: str = "base", **meta: object) -> None:
    """Zstd parquet, doubles as floats, and the causal policy in the files' own schema (and in a ``_meta.json`` to read).

    The footer of every file carries the policy as metadata of the first column, so it goes where the files go.
    """
    said = policy(kind, **meta)
    if narrow:
        df = df.select(*[F.col(f"`{c}`").cast("float").alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
    first = next(c for c in df.columns if c != partition_by)
    df = df.withMetadata(first, {_KEY: json.dumps(said, sort_keys=True)})
    out = df.write.mode("overwrite").option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    write_text(df.sparkSession, f"{path}/_meta.json", json.dumps(said, sort_keys=True))


def footer(spark: SparkSession, path: str) -> dict[str, object]:
    """``columns`` with their types and the ``policy`` of a table, from its files' footers alone; an absent or empty path gives neither."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return {"columns": {}, "policy": {}}
    try:
        schema = spark.read.parquet(path).schema
    except AnalysisException:
        return {"columns": {}, "policy": {}}
    said = next((f.metadata[_KEY] for f in schema.fields if _KEY in f.metadata), None)
    return {"columns": {f.name: f.dataType.simpleString() for f in schema.fields}, "policy": json.loads(said) if said else {}}


def causal_meta_ok(spark: SparkSession, path: str, **expected: object) -> bool:
    """Whether a feature table carries the policy and all that is expected of it; a foreign table does not."""
    said = footer(spark, path)["policy"]
    wanted = json.loads(json.dumps({**POLICY, **expected}))
    return all(said.get(k) == v for k, v in wanted.items())


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(name, bytes, mtime in ms)`` of a file, or of the files right inside a folder, by name; none if it is absent."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [(x.getPath().getName(), int(x.getLen()), int(x.getModificationTime())) for x in fs.listStatus(p) if x.isFile()]
    return sorted(x for x in found if not x[0].startswith(("_", ".")))


def cached(spark: SparkSession, path: str, make, sources: list[str] = (), version: str = "1", **meta: object) -> DataFrame:
    """The table at ``path`` if it was made under the same policy, version and source files, else made, written and read again.

    Source files are told apart by name, size and time of change.
    """
    stamp = cache_key([[s, files(spark, s)] for s in sources], version)
    if not causal_meta_ok(spark, path, stamp=stamp, **meta):
        write_features(make(), path, narrow=False, stamp=stamp, **meta)
    return spark.read.parquet(path)


def predictions(spark: SparkSession, folder: str, name: str, columns: list[str], seed: int, make, version: str = "1") -> DataFrame:
    """The scores of a model, kept in ``folder`` under the hash of its name, columns, seed and version; made where they are not there yet."""
    return cached(spark, f"{folder}/{cache_key(name, sorted(columns), seed, version)}", make, model=name)


def write_status(spark: SparkSession, path: str, stage: str, **more: object) -> None:
    """A small file that says how far a run has come."""
    write_text(spark, path, json.dumps({"stage": stage, "updated": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **more}, sort_keys=True))


def cache_key(*parts: object) -> str:
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def content_digest(df: DataFrame) -> str:
    """A sha256 of a table's rows that depends on neither their order nor the partitioning."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    got = df.agg(F.count("*").alias("n"), F.sum(row).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("x")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{got['n']}|{got['s']}|{got['x']}".encode()).hexdigest()


def manifest(tables: dict[str, DataFrame], parameters: dict) -> str:
    return json.dumps({"parameters": parameters, "tables": {k: {"rows": d.count(), "sha256": content_digest(d)} for k, d in sorted(tables.items())}}, sort_keys=True, indent=2)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *(f"| {' | '.join(map(show, r))} |" for r in rows)])


def write_report(df: DataFrame, path: str) -> None:
    """A summary as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
