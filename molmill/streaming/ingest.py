"""Incremental jobs: new library files once, running totals, generation cycles."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scores import generation
from ..sources import parse as P
from ..sources import writers as W


def block_stream(spark: SparkSession, folder: str, files_per_batch: int = 100_000, mark: str = "ZINC") -> DataFrame:
    """(file, name, block) of the SDF files that appear in a folder; plain files, blocks ended by $$$$."""
    rows = spark.readStream.format("text").option("lineSep", "$$$$\n").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("block")).where(F.contains(F.rtrim("block"), F.lit("\n")))
    return rows.select("file", F.coalesce(P.molecule_name(F.col("block"), mark), F.trim(F.get(P.lines(F.col("block")), 0))).alias("name"), "block")


def ingest(blocks: DataFrame, keep: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write what keep leaves of the blocks as Parquet, each source file once; after a stop it goes on where it was. Ends when no new file is left."""
    return keep(blocks).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def drain(stream: StreamingQuery) -> None:
    """Run a started stream until nothing is left for it, then stop it."""
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()


def ingest_blocks(blocks: DataFrame, keep: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The same for a stream of text_blocks, which takes a step at a time: once stops after one, else it runs on and drain ends it."""
    writer = keep(blocks).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_totals(rows: DataFrame, out: str, checkpoint: str, valid: str = "true", sampled: str = "true") -> StreamingQuery:
    """Rows processed, valid and sampled so far by file. Each batch writes the totals that it changed under out/version=N; latest_totals reads them.

    Totals are kept in the stream's state, spread by file; none passes through the driver. A batch that is run again writes its version anew.
    """
    totals = rows.groupBy("file").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.expr(valid)).alias("valid"), F.count_if(F.expr(f"({valid}) and ({sampled})")).alias("sampled"))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/version={n}")
    return totals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """Each file's totals of the latest version that has them."""
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct("processed", "valid", "sampled"), "version").alias("last")
    return rows.groupBy("file").agg(last).select("file", "last.*")


def generations(results: Callable[[int], DataFrame], select: Callable[[DataFrame, int], DataFrame], receptors: DataFrame, folder: str, n_cycles: int) -> list[str]:
    """Cycles up to n_cycles: each reads the results that the cycle before led to, selects, and writes the next inputs. What is there already is not done again.

    results(cycle) is the table of results after so many cycles; select(table, cycle) has pdb_id, name. Returns the folders written.
    """
    spark = receptors.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for cycle in range(n_cycles):
        at = f"{folder}/cycle_{cycle + 1}"
        done = path(f"{at}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            continue
        W.write_next_inputs(W.next_inputs(select(results(cycle), cycle), receptors, at), at)
        out.append(at)
    return out


def last_generation(names: DataFrame, name: str = "model") -> int:
    return names.agg(F.coalesce(F.max(generation(F.col(name))), F.lit(0))).head()[0]
