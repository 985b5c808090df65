"""Tags and evidence trails as array columns, and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "array<struct<source:string,type:string,details:string,confidence:double>>"
NO_TAGS, NO_EVIDENCE = "cast(array() as array<string>)", f"cast(array() as {EVIDENCE})"


def evidence(source: str, kind: str, details: Column | str, confidence: float) -> Column:
    text = F.lit(details) if isinstance(details, str) else details
    return F.struct(F.lit(source).alias("source"), F.lit(kind).alias("type"), text.alias("details"), F.lit(float(confidence)).alias("confidence"))


def tag_with(actors: DataFrame, source: str, rules: list[tuple[Column, str, list[Column]]]) -> DataFrame:
    """Adds a tag where its condition holds: always an entry ``tag_added``, then the rule's own entries; tags stay a sorted set."""
    tags, trail = F.col("tags"), F.col("evidence_trail")
    for condition, tag, own in rules:
        holds = F.coalesce(condition, F.lit(False))
        entries = F.array(evidence(source, "tag_added", f"Added tag: {tag}", 1.0), *own)
        tags = F.when(holds, F.array_sort(F.array_union(tags, F.array(F.lit(tag))))).otherwise(tags)
        trail = F.when(holds, F.concat(trail, entries)).otherwise(trail)
    return actors.withColumns({"tags": tags, "evidence_trail": trail})


def has_all(tags: Column, wanted) -> Column:
    return F.size(F.array_except(F.array(*(F.lit(t) for t in wanted)), tags)) == 0


def has_any(tags: Column, wanted) -> Column:
    return F.arrays_overlap(tags, F.array(*(F.lit(t) for t in wanted)))


def _shared(df: DataFrame) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of its own only on a local master. It is the context's from now on."""
    context = df.sparkSession.sparkContext
    if not (known := context._jsc.sc().getCheckpointDir()).isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = f"{tempfile.gettempdir()}/checkpoints"
        context.setCheckpointDir(path)
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder. What the optimizer infers of the rows isn't kept: over many cuts and joins it grows until it takes the driver's time."""
    _shared(df)
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return df.checkpoint()
    finally:
        conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, in compressed columns, for tables with a row for each event or so: columns without times. They go when the driver ends."""
    spark = df.sparkSession
    path = f"{_shared(df)}/{uuid.uuid4().hex}"
    df.write.orc(path, compression="zstd")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).orc(path)
