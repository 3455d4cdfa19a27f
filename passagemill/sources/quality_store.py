"""A quality cache that grows by committed chunks, each with a summary that merges with the others'.

A corpus is dealt to chunks by a hash of docno. A chunk's scores are written under a name of their own,
and count only when its entry is in the manifest: one small file, put there by a rename, which the file
system does whole or not at all. A run that stops between writing and committing leaves a folder that
nothing reads; the next run looks at the manifest alone, scores what it lacks, and never reads the
scores that are there. Two runs at once can't both commit a chunk.

An entry holds the chunk's moments and a quantile sketch, so the cache's mean, deviation, extremes and
thresholds come from the manifest, however much was scored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS, SKETCH = 8, 4_096  #: chunks of a corpus, and size of a sketch: ranks are off by about a thousandth
ENTRY = "chunk int, chunks int, data string, rows long, n long, mean double, m2 double, low double, high double, sketch string"
SCORES = "docno string, quality double"


def chunk_of(docno: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(docno), F.lit(chunks)).cast("int")


def summary(scores: DataFrame) -> DataFrame:
    """One row: rows, and n, mean, m2 (sum of squared distances from the mean), low, high and sketch of finite scores."""
    x = F.when(~F.isnan("quality") & (F.abs("quality") < float("inf")), F.col("quality"))
    sketch = F.base64(F.kll_sketch_agg_double(x, F.lit(SKETCH)))
    return scores.agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"), sketch.alias("sketch"))


def _commit(spark: SparkSession, path: str, entry: dict) -> bool:
    """Put an entry in the manifest; False if the chunk is there already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    made, place = hadoop.Path(f"{path}/making/{uuid.uuid4().hex}"), hadoop.Path(f"{path}/manifest/chunk-{entry['chunk']:06d}.json")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place.getParent())
    out = system.create(made, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    done = not system.exists(place) and system.rename(made, place)
    if not done:
        system.delete(made, False)
    return done


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of committed chunks."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{path}/manifest")


def score(corpus: DataFrame, scorer: Callable[[DataFrame], DataFrame], path: str, chunks: int = CHUNKS, at_most: int | None = None) -> int:
    """Score the chunks of docno, text that the manifest lacks, at_most so many of them, and return how many this run committed.

    The scorer sees one chunk at a time: a model of the whole corpus must be made before. A store of
    another number of chunks is an error.
    """
    spark = corpus.sparkSession
    known = manifest(spark, path).select("chunk", "chunks").collect()  # one for each chunk
    if any(r["chunks"] != chunks for r in known):
        raise ValueError(f"the store at {path} has {known[0]['chunks']} chunks, not {chunks}")
    missing = sorted(set(range(chunks)) - {r["chunk"] for r in known})
    committed = 0
    for chunk in missing[:at_most]:
        data = f"data/{chunk:06d}-{uuid.uuid4().hex}"
        scorer(corpus.where(chunk_of(F.col("docno"), chunks) == chunk)).select(F.col("docno").cast("string").alias("docno"), F.col("quality").cast("double").alias("quality")).write.parquet(f"{path}/{data}")
        entry = summary(spark.read.schema(SCORES).parquet(f"{path}/{data}")).first().asDict()
        committed += _commit(spark, path, {"chunk": chunk, "chunks": chunks, "data": data, **entry})
    return committed


def scores(spark: SparkSession, path: str) -> DataFrame:
    """docno, quality of the committed chunks alone."""
    folders = [f"{path}/{r['data']}" for r in manifest(spark, path).select("data").collect()]
    return spark.read.schema(SCORES).parquet(*folders) if folders else spark.createDataFrame([], SCORES)


def complete(spark: SparkSession, path: str, chunks: int = CHUNKS) -> bool:
    return manifest(spark, path).select("chunk").distinct().count() == chunks


def moments(entries: DataFrame) -> DataFrame:
    """One row: rows, n, mean, std (population), low, high of all chunks, from their entries."""
    some = entries.where("n > 0")
    one = some.agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    both = some.crossJoin(F.broadcast(one))  # one row
    out = both.agg(F.max("_n").alias("n"), F.max("_mean").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * apart * apart) / F.max("_n")).alias("std"), F.min("low").alias("low"), F.max("high").alias("high"))
    return entries.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).crossJoin(F.broadcast(out))


def threshold(entries: DataFrame, fraction: float) -> DataFrame:
    """One row: the approximate quantile of all chunks' scores, from their merged sketches."""
    merged = entries.where("n > 0").agg(F.kll_merge_agg_double(F.unbase64("sketch")).alias("s"), F.count(F.lit(1)).alias("c"))
    return merged.select(F.when(F.col("c") > 0, F.kll_sketch_get_quantile_double("s", F.lit(float(fraction)))).alias("threshold"))
