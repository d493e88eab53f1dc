"""Operator 3: token ids in training order, as fixed-stride binary shards.

Texts are encoded and cut into sequences of ``LENGTH`` ids, the last one
padded.  Sequence g of the corpus goes to slot permute(g) of the keyed Feistel permutation,
so slots are a shuffle without gaps; slot s lies in shard s div ``SHARD_ROWS``.
Ranges of shards are the partitions of one shuffle, each sorted by slot and written as
raw records of ``STRIDE`` bytes:

    id (8 bytes), sequence of the text (4), ids that are no padding (4), ids (2 each), newline

so byte (s mod SHARD_ROWS) * STRIDE of its shard starts slot s, and a reader that stopped
after s records resumes there.  Spark's own writer commits the files, on any file system.

Sequences are numbered by file, row of the file and place in the text, so the order
depends on the input's files alone, not on split size, cores or task order.  A first
pass counts the sequences of each run of rows (one number per file and task), a second
encodes again and numbers.  Storing the ids between the passes would take more disk
than the shards.  A table that is no file scan is numbered by partition and row
instead, and must then be one whose partitions repeat, such as a checkpoint.

Defined cases: null and empty texts have no sequence; a null id is written as the least
long; repeated rows have sequences of their own; an id over 65,535 of another codec is an
error; an empty table writes no shard and gives an empty index; columns besides the id and
the text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.common import shared_dir, text_of
from folium.llm.feistel import permute_array

LENGTH = 512
PAD = 50_256
STRIDE = 8 + 4 + 4 + 2 * LENGTH + 1
SHARD_ROWS = 1 << 15
KEY = 77_031
#: Partitions of the shuffle at most; a partition writes whole shards.
MAX_RANGES = 20_000
_RUNS = ("  ", "\n\n", " \n", "\n ")
_OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NEVER = "\x00\x01never\x02\x00"
RECORD = np.dtype([("id", "<i8"), ("seq", "<i4"), ("n", "<i4"), ("ids", "<u2", (LENGTH,)), ("end", "u1")])


class TokenIds:
    """Encodes by the ranks of a byte-level vocabulary with the tiktoken library.

    Strings of special tokens are ordinary text, so ``PAD`` occurs as padding only.
    Any object with ``encoder().encode_batch(texts)`` can take its place, such as the
    codec of operator 5, which returns the bytes of the ids."""

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, spark: SparkSession, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            self.shared = spark.sparkContext.broadcast(f.read())

    def encoder(self) -> TokenIds.Encoder:
        """The encoder of this worker, built once for all its tasks."""
        content = self.shared.value
        held = TokenIds._held
        if held is None or held[0] != content:
            held = TokenIds._held = (content, TokenIds.Encoder(content))
        return held[1]

    _held: tuple | None = None

    class Encoder:
        def __init__(self, content: bytes):
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            # With no special token at all the library looks for one at every character.  This one
            # is never allowed, so its string is ordinary text, too.
            make = lambda p: tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={NEVER: len(ranks)})
            self.one, self.plain = make(TokenIds.PATTERN), make(TokenIds.PATTERN.replace(r"|\s+(?!\S)", ""))

        @staticmethod
        def is_plain(text: str) -> bool:
            """Whether all white space is single blanks and line feeds.  The pattern then needs no
            look-ahead: it only splits a run of white space before a word."""
            return not (any(r in text for r in _RUNS) or any(c in text for c in _OTHER_SPACE))

        def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
            out = []
            for t in texts:
                t = t or ""
                out.append((self.plain if self.is_plain(t) else self.one).encode_to_numpy(t, disallowed_special=()))
            return out


def flat_ids(ids: np.ndarray | bytes) -> np.ndarray:
    """Ids of a text, given as an array or as unsigned 32-bit little-endian bytes."""
    return ids if isinstance(ids, np.ndarray) else np.frombuffer(ids, dtype="<u4")


def records(doc_id: int | None, ids: np.ndarray | bytes) -> np.ndarray:
    """The records of one text from its ids."""
    flat = flat_ids(ids)
    if len(flat) and flat.max() > 65_535:
        raise ValueError("a record holds ids of 16 bits")
    n = -(-len(flat) // LENGTH)
    out = np.zeros(n, dtype=RECORD)
    padded = np.full(n * LENGTH, PAD, dtype="<u2")
    padded[: len(flat)] = flat
    out["id"] = -(1 << 63) if doc_id is None else doc_id
    out["seq"] = np.arange(n)
    out["n"] = np.minimum(LENGTH, len(flat) - LENGTH * np.arange(n))
    out["ids"] = padded.reshape(n, LENGTH)
    out["end"] = 10
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _t, _file, _at): file and row of a file scan, else an empty name and null."""
    columns = [F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_t")]
    try:
        return docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return docs.select(*columns, F.lit("").alias("_file"), F.lit(None).cast("long").alias("_at"))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, row, begin, end) of the parts of a batch that lie in one file each."""
    files = b.column(2).to_pylist()
    begin = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or files[k] != files[begin]:
            row = b.column(3)[begin].as_py()
            yield files[begin], TaskContext.get().partitionId() if row is None else row, begin, k
            begin = k


def run_counts(docs: DataFrame, codec: TokenIds, id_col: str, text_col: str) -> list[tuple[str, int, int]]:
    """(file, first row, sequences) of each run: one row per file and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = codec.encoder(), []
        for b in batches:
            texts = b.column(1).to_pylist()
            for file, row, begin, end in _runs(b):
                part = texts[begin:end]
                # An id covers a byte at least, so a text of LENGTH bytes is one sequence.
                short = [len(t) <= LENGTH and len(t.encode("utf-8", "surrogatepass")) <= LENGTH for t in part]
                n = sum(1 for t, s in zip(part, short, strict=True) if s and t)
                for ids in encoder.encode_batch([t for t, s in zip(part, short, strict=True) if not s]):
                    n += -(-len(flat_ids(ids)) // LENGTH)
                if found and found[-1][0] == file:
                    found[-1][2] += n
                else:
                    found.append([file, row, n])
        yield pa.RecordBatch.from_pylist(
            [{"file": f, "row": r, "n": n} for f, r, n in found],
            schema=pa.schema([("file", pa.string()), ("row", pa.int64()), ("n", pa.int64())]),
        )

    return sorted(map(tuple, _rows(docs, id_col, text_col).mapInArrow(count, "file string, row long, n long").collect()))


def materialise(
    docs: DataFrame,
    codec: TokenIds,
    path: str | None = None,
    key: int = KEY,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[str, int]:
    """Write the shards under ``path``; returns it and the number of sequences."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    starts, total = {}, 0
    for file, row, n in run_counts(docs, codec, id_col, text_col):
        starts[file, row], total = total, total + n
    if not total:
        return path, 0
    # One number for each file and task, sent to a worker once.
    first = spark.sparkContext.broadcast(starts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, at = codec.encoder(), None, 0
        for b in batches:
            made, rows = [np.zeros(0, dtype=RECORD)], [np.zeros(0, dtype=np.int64)]
            texts, owners = b.column(1).to_pylist(), b.column(0).to_pylist()
            for name, row, begin, end in _runs(b):
                if name != file:
                    file, at = name, first.value[name, row]
                part = [records(i, ids) for i, ids in zip(owners[begin:end], encoder.encode_batch(texts[begin:end]), strict=True)]
                size = sum(map(len, part))
                rows.append(np.arange(at, at + size))
                made += part
                at += size
            flat = np.concatenate(made)
            n = len(flat)
            # The record's own newline is left to the writer's line separator.
            body = flat.view(np.uint8).reshape(n, STRIDE)[:, :-1] if n else np.zeros((0, STRIDE - 1), dtype=np.uint8)
            offsets = pa.py_buffer((np.arange(n + 1) * (STRIDE - 1)).astype(np.int32))
            data = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(body))])
            slots = permute_array(np.concatenate(rows), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), data], ["slot", "record"])

    shards = -(-total // shard_rows)
    ranges = min(MAX_RANGES, shards)
    placed = _rows(docs, id_col, text_col).mapInArrow(emit, "slot long, record binary")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    (
        placed.withColumn("shard", div(F.col("slot"), shard_rows))
        .withColumn("range", div(F.col("shard") * F.lit(ranges), shards).cast("int"))
        .repartitionById(ranges, "range")
        .sortWithinPartitions("shard", "slot")
        .select(F.col("record").cast("string").alias("value"), "shard")
        .write.partitionBy("shard")
        .option("lineSep", "\n")
        .option("compression", "none")
        .mode("errorifexists")
        .text(path)
    )
    return path, total


def read_index(spark: SparkSession, path: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per sequence, read from the shards alone."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                buffer = content.as_buffer()
                found = np.frombuffer(buffer, dtype=RECORD)
                ids, view = found["id"], memoryview(buffer)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=ids == -(1 << 63)),
                        pa.array(found["seq"], pa.int32()),
                        pa.array(shard * shard_rows + np.arange(len(found)), pa.int64()),
                        pa.array(np.full(len(found), shard), pa.int64()),
                        pa.array(np.arange(len(found)) * STRIDE, pa.int64()),
                        pa.array(found["n"], pa.int32()),
                        pa.array([zlib.crc32(view[k : k + 2 * LENGTH]) for k in range(16, len(view), STRIDE)], pa.int64()),
                    ],
                    ["doc_id", "seq_no", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    # A shard is one file, read whole: SHARD_ROWS * STRIDE bytes at most.
    schema = "doc_id long, seq_no int, slot long, shard long, byte_offset long, n_tokens int, ids_crc32 long"
    return files.select(F.col("shard").cast("long"), "content").mapInArrow(parse, schema)


def training_order(docs: DataFrame, codec: TokenIds | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the shards and return their index."""
    spark = docs.sparkSession
    path, total = materialise(docs, codec or TokenIds(spark), id_col=id_col, text_col=text_col, **options)
    if not total:
        return spark.createDataFrame(
            [], "doc_id long, seq_no int, slot long, shard long, byte_offset long, n_tokens int, ids_crc32 long"
        )
    return read_index(spark, path, options.get("shard_rows", SHARD_ROWS))
