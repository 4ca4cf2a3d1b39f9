"""Token counts of documents in flat, unindexed token files.

A flat file holds token identifiers of a fixed width and nothing else; an
end-of-document identifier follows each document. Files in the order of their names
are one stream, and a document may run on from one file to the next.

Files are scanned in blocks of a bounded number of tokens with one vector comparison per
block; only the separators' places leave it. A file of up to ``WHOLE_BYTES`` is one row
of the reader; of a larger one of any size each block is, read in a task of its byte
range. Boundaries are then stitched by a prefix
scan over the blocks: a running sum of lengths gives each block's place in the stream, a
running maximum of separator places gives the last separator before it, which is where
its first document began. The scan runs per file over its blocks, and over files with
one row each; a block's places take no part in it and are joined when it is done.

Tokens after the last separator are a document that isn't terminated. Two separators
next to each other enclose an empty document. A file that isn't a whole number of tokens
is an error. Empty files and folders have no documents. The writer takes a null text for
an empty one, writes very long texts whole and each repeated row anew, and reads no column
but the text; a document's place in the stream is unique, so there are no ties.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salescast.llm.scratch import stored

# Two bytes per token, high byte first. The separator lies above the vocabulary's
# identifiers (0 to 50,256), and its two bytes are one UTF-8 character, so that
# Spark's text writer can set it after each row.
TOKEN_TYPE = ">u2"
SEPARATOR = 50_304
BLOCK_TOKENS = 1 << 20
WHOLE_BYTES = 64 << 20
RANGE_BLOCKS = 16  # blocks of a large file in a task
VOCABULARY = "byte_bpe_50k.tiktoken"
ENCODE_ROWS = 256


@lru_cache(maxsize=1)
def load_tokenizer(vocabulary: str):
    """A byte-level BPE from a file of ranks, or from the name of an installed public one."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Token identifiers of a text; none for a null."""
    return np.array(load_tokenizer(vocabulary).encode_ordinary(text or ""), dtype=TOKEN_TYPE)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Write the documents' tokens as flat files, a separator after each document.

    The rows are not sorted or shuffled: each task writes the documents it reads.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ENCODE_ROWS):
                texts = batch.column(0).slice(first, ENCODE_ROWS)
                data = [encode(text.as_py(), vocabulary).tobytes() for text in texts]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["tokens"])

    rows = docs.select("text").mapInArrow(tokens, "tokens binary")
    separator = np.array([SEPARATOR], dtype=TOKEN_TYPE).tobytes().decode()
    rows.select(F.col("tokens").cast("string")).write.option("lineSep", separator).text(path)


def _range_blocks(spark: SparkSession, path: str, size: int, places_in, width: int, block_tokens: int):
    """Rows of ``scan_blocks`` of one large file: an RDD of its blocks, and a list of those in its rest.

    The reader of fixed-length records fails on a rest that isn't a whole record, so the
    range with the rest is left out there, and read here. Block lengths are chosen so
    that the rest is about an eighth of a block: ranges end at whole blocks only where
    more than a tenth of one remains.
    """
    context = spark.sparkContext
    jvm = context._jvm
    tokens = size // width
    record = max(1, int(tokens / (-(-tokens // block_tokens) + 0.125))) * width
    settings = {
        "org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record),
        "mapreduce.input.fileinputformat.split.minsize": str(record),
        "mapreduce.input.fileinputformat.split.maxsize": str(record),
    }
    records = context.newAPIHadoopFile(
        re.sub(r"([\[\]{}*?\\])", r"\\\1", path),
        "org.apache.spark.input.FixedLengthBinaryInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf=settings,
    )
    whole = records.getNumPartitions() - (size % record > 0)
    kept = jvm.PythonUtils.toSeq(list(range(whole))).toSet()
    pruned = jvm.org.apache.spark.rdd.PartitionPruningRDD.create(records._jrdd.rdd(), kept)
    records = RDD(pruned.toJavaRDD(), context, records._jrdd_deserializer).coalesce(-(-whole // RANGE_BLOCKS) or 1)
    blocks = records.map(lambda r: (path, r[0], len(r[1]) // width, places_in(r[1])))

    rest = size - whole * record if size % record else 0
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(context._jsc.hadoopConfiguration()).open(file)
    try:
        stream.seek(size - rest)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    if len(data) != rest:
        raise ValueError(f"{path}: {len(data)} bytes instead of {rest} at its end")
    ends = [data[i : i + record] for i in range(0, rest, record)]
    return blocks, [(path, whole + i, len(end) // width, places_in(end)) for i, end in enumerate(ends)]


def scan_blocks(
    spark: SparkSession,
    path: str,
    separator: int = SEPARATOR,
    token_type: str = TOKEN_TYPE,
    block_tokens: int = BLOCK_TOKENS,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """One row per block: file, block, n_tokens, places (of separators, from the block's start)."""
    wanted = np.array([separator], dtype=token_type)
    raw_type = wanted.dtype.newbyteorder("=")
    raw = wanted.view(raw_type)[0]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_buffer()
                if len(data) % raw_type.itemsize:
                    raise ValueError(f"{name}: {len(data)} bytes are no whole number of tokens")
                stream = np.frombuffer(data, dtype=raw_type)
                starts = range(0, len(stream), block_tokens)
                places = [np.flatnonzero(stream[s : s + block_tokens] == raw) for s in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(starts), pa.string()),
                        pa.array(range(len(starts)), pa.int64()),
                        pa.array([min(block_tokens, len(stream) - s) for s in starts], pa.int64()),
                        pa.array([p.astype(np.int64) for p in places], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "n_tokens", "places"],
                )

    def places_in(data: bytes | bytearray) -> list[int]:
        return np.flatnonzero(np.frombuffer(data, dtype=raw_type) == raw).tolist()

    # Zero bytes and Spark's own markers aside, each file is one row, or one RDD of blocks.
    schema = "file string, block long, n_tokens long, places array<long>"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).where("length > 0")
    small = files.where(F.col("length") <= whole_bytes)
    blocks = small.select("path", "content").mapInArrow(scan, schema)
    large = files.where(F.col("length") > whole_bytes).select("path", "length").collect()  # names and sizes
    for name, size in large:
        if size % raw_type.itemsize:
            raise ValueError(f"{name}: {size} bytes are no whole number of tokens")
    if large:
        found = [_range_blocks(spark, name, size, places_in, raw_type.itemsize, block_tokens) for name, size in large]
        ranges = spark.createDataFrame(spark.sparkContext.union([rdd for rdd, _ in found]), schema)
        ends = [row for _, rows in found for row in rows]
        blocks = blocks.union(ranges).union(spark.createDataFrame(ends, schema))
    return blocks


def stitched(blocks: DataFrame) -> DataFrame:
    """Each block's place in the stream: file, block, file_no, start, documents before it, and the last separator before it.

    ``blocks`` has file, block, n_tokens, n_docs and last (place of its last separator):
    a few numbers for each block, whatever it holds.
    """
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    inside = blocks.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(before), none))
    inside = inside.withColumns(
        {
            "last_in_file": F.max(F.col("file_start") + F.col("last")).over(before),
            "docs_in_file": F.coalesce(F.sum("n_docs").over(before), none),
        }
    )
    files = inside.groupBy("file").agg(
        F.sum("n_tokens").alias("file_tokens"),
        F.sum("n_docs").alias("file_docs"),
        F.max(F.col("file_start") + F.col("last")).alias("file_last"),
    )
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("stream_start", F.coalesce(F.sum("file_tokens").over(earlier), none))
    files = files.select(
        "file",
        "stream_start",
        (F.row_number().over(Window.orderBy("file")) - 1).alias("file_no"),
        F.coalesce(F.sum("file_docs").over(earlier), none).alias("stream_docs"),
        F.coalesce(F.max(F.col("stream_start") + F.col("file_last")).over(earlier), F.lit(-1)).alias("stream_last"),
    )
    placed = inside.join(files, "file")
    return placed.select(
        "file",
        "block",
        "file_no",
        "n_tokens",
        "n_docs",
        "last",
        (F.col("stream_start") + F.col("file_start")).alias("start"),
        (F.col("stream_docs") + F.col("docs_in_file")).alias("docs_before"),
        F.coalesce(F.col("stream_start") + F.col("last_in_file"), "stream_last").alias("last_before"),
    )


def document_lengths(blocks: DataFrame) -> DataFrame:
    """One row per document of the stream: doc_no, file_no (where it ends), start_token, n_tokens, terminated."""
    # Written once, since the places are needed again when the blocks have found theirs.
    blocks = stored(blocks, "token-blocks")
    last = F.when(F.size("places") > 0, F.element_at("places", -1))
    narrow = blocks.select("file", "block", "n_tokens", F.size("places").alias("n_docs"), last.alias("last"))
    placed = stored(stitched(narrow), "token-places")
    starts = placed.select("file", "block", "file_no", "start", "docs_before", "last_before")
    each = blocks.where(F.size("places") > 0).join(starts, ["file", "block"])
    each = each.select("*", F.posexplode("places").alias("nth", "place"))
    previous = F.when(F.col("nth") == 0, F.col("last_before")).otherwise(
        F.col("start") + F.try_element_at("places", F.col("nth"))
    )
    ended = each.select(
        (F.col("docs_before") + F.col("nth")).alias("doc_no"),
        "file_no",
        (previous + 1).alias("start_token"),
        (F.col("start") + F.col("place") - previous - 1).alias("n_tokens"),
        F.lit(True).alias("terminated"),
    )
    last = F.coalesce(F.col("start") + F.col("last"), "last_before")
    end = F.struct((F.col("start") + F.col("n_tokens")).alias("tokens"), "file_no", "docs_before", F.col("n_docs").alias("here"), last.alias("last"))
    end = F.max(end)
    rest = placed.agg(end.alias("end")).where("end.tokens > end.last + 1")
    rest = rest.select(
        (F.col("end.docs_before") + F.col("end.here")).alias("doc_no"),
        F.col("end.file_no").alias("file_no"),
        (F.col("end.last") + 1).alias("start_token"),
        (F.col("end.tokens") - F.col("end.last") - 1).alias("n_tokens"),
        F.lit(False).alias("terminated"),
    )
    return ended.union(rest)
