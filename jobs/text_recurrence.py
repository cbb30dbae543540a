"""Recurrence quantification of texts as they arrive: how repetitive a text's sequence of words is.

    python -m jobs.text_recurrence --input documents --output results --checkpoint marks [--config jobs/text_recurrence.json]

A file stream over the folder takes the files that its checkpoint has not seen, and ends. Every text is cut into
windows of words; two places of a window recur if they hold the same word, and runs along the diagonals and columns of
these recurrences are counted. A text's figures come from the counts of all its windows, so whole texts count. The
stream's sink writes one row for each document (texts/language=...), exactly once by its checkpoint. After it a second
table gives the same figures for each source (sources/language=...), from the counts that the first one holds.
"""

from __future__ import annotations

import argparse
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import config, log, read_if_there, settings

DEFAULT = Path(__file__).with_suffix(".json")
COUNTS = ["words", "windows", "points", "diagonal_long", "diagonal_runs", "vertical_long"]
TEXTS = "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", entr double, language string"
SOURCES = "source string, texts long, " + ", ".join(f"{c} long" for c in COUNTS) + ", det double, lam double, lmean double, language string"
#: Rows and bytes of texts that go to Python at a time.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Recurrent pairs of whole windows that are held at a time.
PAIRS = 1 << 20


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's text, code of the word) of the words between ASCII white space, A-Z lower-cased; null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, text = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(flat), 0)
    return text[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode().indices.to_numpy().astype(np.int64)


def counted(texts: pa.Array, size: int, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """COUNTS and entropy of each text. Windows follow each other; the last one of a text may be shorter.

    The places of a word in a window are all that is needed: no window's matrix is made.
    """
    text, code = words(texts)
    n = np.bincount(text, minlength=len(texts))
    windows = -(-n // size)
    place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
    win = (np.cumsum(windows) - windows)[text] + place // size
    owner = np.repeat(np.arange(len(texts)), windows)
    group = win * (int(code.max(initial=0)) + 1) + code
    order = np.argsort(group, kind="stable")
    starts = lambda x: np.flatnonzero(np.diff(x, prepend=x[:1] - 2) != 0)
    first = starts(group[order])
    m = np.diff(first, append=len(order))
    at = order[np.repeat(m > 1, m)]  # words that are in their window again
    m = m[m > 1]
    win, place = win[at], place[at] % size
    total = lambda at, x: np.bincount(owner[at], x, len(texts)).astype(np.int64)
    each = np.repeat(m, m)
    points = total(win, each - 1)

    # Runs of a word's places: the columns of its other places hold them whole, their own columns hold them without one place.
    ids = np.repeat(np.arange(len(m)), m)
    run = starts(ids * (size + 1) + place - np.arange(len(at)))
    length = np.diff(run, append=len(at))
    inner = np.maximum((length - 1) * length - (least - 1) * least, 0)
    vertical_long = total(win[run], np.where(length >= least, (each[run] - length) * length, 0) + inner)

    # Pairs of a word's places, by window, lag and place. Both triangles are alike, and a lag's last place is no other's first.
    later = np.repeat(np.cumsum(m), m) - np.arange(len(at)) - 1
    found = [np.zeros((2, 0), np.int64)]
    chunk = np.cumsum(later) // PAIRS
    edges = np.unique(np.searchsorted(win, win[starts(chunk)])) if len(at) else []
    for a, b in zip(edges, [*edges[1:], len(at)]):
        i = np.repeat(np.arange(a, b), later[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
        key = np.sort((win[i] * size + place[j] - place[i]) * size + place[i])
        line = np.flatnonzero(np.diff(key, prepend=key[:1] - 2) != 1)
        length = np.diff(line, append=len(key))
        long = length >= least
        found.append(np.stack(np.unique(owner[key[line[long]] // size**2] * (size + 1) + length[long], return_counts=True)))
    key, c = np.concatenate(found, axis=1)
    key, back = np.unique(key, return_inverse=True)
    c = 2 * np.bincount(back, c, len(key))
    owner, length = key // (size + 1), key % (size + 1)
    runs = np.bincount(owner, c, len(texts))
    p = c / runs[owner]
    entropy = np.bincount(owner, -p * np.log(p), len(texts)) + 0.0
    return [n, windows, points, np.bincount(owner, c * length, len(texts)).astype(np.int64), runs.astype(np.int64), vertical_long], entropy


def measured(docs: DataFrame, cfg: dict) -> DataFrame:
    """Documents -> TEXTS. Needs no other row, so it serves streams and tables alike."""
    size, least = cfg["window_words"], cfg["least"]
    language = F.coalesce(F.nullif(F.col(cfg["language"]), F.lit("")), F.lit("und"))
    each = docs.select(F.col(cfg["id"]).cast("long").alias("doc_id"), F.coalesce(F.col(cfg["source"]), F.lit("")).alias("source"), F.col(cfg["text"]).cast("string").alias("text"), language.alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, entropy = counted(b["text"], size, least)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], *map(pa.array, counts), pa.array(entropy), b["language"]], ["doc_id", "source", *COUNTS, "entr", "language"])

    return each.mapInArrow(run, TEXTS)


def figures(counts: DataFrame) -> DataFrame:
    """Adds det, lam and lmean: the share of recurrent points on diagonals and on columns of `least` or more, and the mean of such diagonals."""
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("points"), F.lit(0)), F.lit(0.0))
    return counts.withColumns({"det": share("diagonal_long"), "lam": share("vertical_long"), "lmean": F.coalesce(F.col("diagonal_long") / F.nullif(F.col("diagonal_runs"), F.lit(0)), F.lit(0.0))})


def is_folder(spark: SparkSession, source: str, schema: StructType) -> bool:
    try:
        spark.read.schema(schema).parquet(f"{source.rstrip('/')}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def run(spark: SparkSession, source: str, output: str, checkpoint: str, cfg: dict) -> dict[str, int]:
    """Takes the files that are new to the checkpoint; returns rows read by the stream and sources written. See the module."""
    schema = spark.read.parquet(source).schema
    limits = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(BATCH_ROWS), "spark__sql__execution__arrow__maxBytesPerBatch": str(BATCH_BYTES), "spark__sql__streaming__schemaInference": "false"}
    with settings(spark, **limits):
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", cfg["files_per_batch"])
        folder, _, name = source.rstrip("/").rpartition("/")
        # A stream reads folders; a table that is one file is its folder's only file of that name.
        docs = reader.parquet(source) if is_folder(spark, source, schema) else reader.option("pathGlobFilter", name).parquet(folder)
        out = measured(docs, cfg).writeStream.format("parquet").partitionBy("language").option("path", f"{output}/texts").option("checkpointLocation", checkpoint)
        stream = out.trigger(availableNow=True).start()
        try:
            stream.awaitTermination()
        finally:
            stream.stop()
        read = sum(p["numInputRows"] for p in stream.recentProgress)
        texts = read_if_there(spark, f"{output}/texts", TEXTS)
        sums = texts.groupBy("language", "source").agg(F.count(F.lit(1)).alias("texts"), *[F.sum(c).alias(c) for c in COUNTS])
        found = figures(sums).select(*[f.split()[0] for f in SOURCES.split(", ")])
        if read:
            found.repartition("language").write.mode("overwrite").partitionBy("language").parquet(f"{output}/sources")
    written = read_if_there(spark, f"{output}/sources", SOURCES).count()
    log.info("%s: read %d new rows, wrote them to %s/texts; %d sources in %s/sources", source, read, output, written, output)
    return {"rows": read, "sources": written}


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """Both tables as one, shares and entropy to 6 decimals, with the part that a row is of."""
    r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
    texts = figures(read_if_there(spark, f"{output}/texts", TEXTS)).select(F.lit("text").alias("part"), "language", "source", "doc_id", *COUNTS, *r6("det", "lam", "lmean", "entr"))
    sources = read_if_there(spark, f"{output}/sources", SOURCES).select(F.lit("source").alias("part"), "language", "source", "texts", *COUNTS, *r6("det", "lam", "lmean"))
    return texts.unionByName(sources, True)


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    a.add_argument("--input", required=True, help="folder of Parquet files")
    a.add_argument("--output", required=True)
    a.add_argument("--checkpoint", required=True, help="folder that remembers the files taken")
    a.add_argument("--config", default=DEFAULT)
    o = a.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, o.input, o.output, o.checkpoint, config(o.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    import logging

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    main()
