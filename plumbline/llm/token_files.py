"""Token ids in Arrow stream files of equal-length sequences, read back by memory maps.

``write`` deals documents to parts by ranges of doc_id, and each part's task tokenises its
documents in order and streams them into two files:

* ``tokens-*.arrow``: batches of two fixed-size lists, ``ids`` (16 bits an id where the
  vocabulary allows, else 32) and ``mask`` (one bit an id: whether it is a token or padding). A
  document runs on from one sequence into the next; only a part's last sequence is padded;
* ``documents-*.arrow``: doc_id, start and length in tokens of each document of the part.

File names hold the task's attempt, and the manifest, a table that Spark commits, names the files
of the attempts that count. So a lost or repeated task leaves files that nobody reads, never a
torn one. A task holds one batch of texts and one of sequences, whatever its part's size.

``documents`` gives each document's ids as Spark rows, a task for each part. ``Sequences`` gives
the k-th sequence of all at random: a search among the parts' sizes and a slice of a memory map,
whose ids are never copied.

Cases: a null text is an empty text, whose only token is the end id; rows without doc_id come
first; rows of equal doc_id come as the table is read, and repeated rows are documents of their
own; a text of any length goes through whole; an empty table gives no files and no rows; further
columns, whatever their names, are not read. doc_id must fit 64 bits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.common import BATCH_BYTES, BATCH_ROWS, batched, doc_texts, new_folder, partitions, record_batch
from plumbline.llm.packing import fast

#: Sequences of one batch of a file.
AT_ONCE = 256
MANIFEST = "part int, tokens string, documents string, n_sequences long, n_tokens long, n_documents long"
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def layout(length: int, wide: bool) -> pa.Schema:
    """The schema of a file of sequences of ``length`` ids."""
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Fills sequences and writes them in batches of ``AT_ONCE``."""

    def __init__(self, sink, length: int, wide: bool):
        self.schema, self.length, self.n, self.sequences = layout(length, wide), length, 0, 0
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.buffer, self.at = np.zeros(AT_ONCE * length, np.uint32 if wide else np.uint16), 0

    def put(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        while len(ids):
            some = ids[: len(self.buffer) - self.at]
            self.buffer[self.at : self.at + len(some)] = some
            self.at, ids = self.at + len(some), ids[len(some) :]
            if self.at == len(self.buffer):
                self.flush()

    def flush(self) -> None:
        rows = -(-self.at // self.length)
        ids, mask = self.buffer[: rows * self.length], np.arange(rows * self.length) < self.at
        ids[self.at :] = 0
        if rows:
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), self.length) for x, f in zip((ids, mask), self.schema, strict=True)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences, self.at = self.sequences + rows, 0

    def close(self) -> None:
        self.flush()
        self.out.close()


def write(docs: DataFrame, path: str, folder: str | None = None, end: int = 2, length: int = 2048, parts: int | None = None) -> DataFrame:
    """Tokenise ``docs`` by the file ``path``, end each with ``end``, and write the files of all parts.

    Returns the manifest, stored in ``folder`` (a new one in the shared folder if None) beside the
    files. There are ``parts`` files at most, as many as shuffle partitions if None.
    """
    spark = docs.sparkSession
    batched(spark)
    folder = folder or new_folder(spark, "tokens")
    rows = doc_texts(docs).withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts or partitions(spark), "doc_id", "_row").sortWithinPartitions("doc_id", "_row").drop("_row")
    fields = to_arrow_schema(T._parse_datatype_string(MANIFEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        context, bpe = TaskContext.get(), fast(path)
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        with fs.open_output_stream(f"{root}/tokens-{name}") as tokens, fs.open_output_stream(f"{root}/documents-{name}") as index:
            out, listed, n = _Writer(tokens, length, max(len(bpe.strings), end + 1) > 1 << 16), pa.ipc.new_stream(index, _INDEX), 0
            last = np.array([end], np.uint32)
            for b in chain([first], batches):
                starts, lengths = [], []
                for text in b["text"].to_pylist():
                    starts.append(out.n)
                    out.put(np.frombuffer(bpe.encode(text), "<u4"))
                    out.put(last)
                    lengths.append(out.n - starts[-1])
                listed.write_batch(record_batch({"doc_id": b["doc_id"], "start": starts, "n_tokens": lengths}, _INDEX))
                n += b.num_rows
            out.close()
            listed.close()
        made = (context.partitionId(), f"tokens-{name}", f"documents-{name}", out.sequences, out.n, n)
        yield record_batch({f.name: [x] for f, x in zip(fields, made, strict=True)}, fields)

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder``, one row a part, with the folder's name."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def _opened(folder: str, name: str):
    """A file of ``folder``: a memory map where the folder is a local one."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    return pa.memory_map(f"{root}/{name}") if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(f"{root}/{name}")


class _Flow:
    """The tokens of a file, one run after the other; a batch at a time is in memory."""

    def __init__(self, source):
        self.batches, self.rest = iter(pa.ipc.open_stream(source)), np.zeros(0, np.uint16)

    def take(self, n: int) -> np.ndarray:
        got = []
        while n:
            if not len(self.rest):
                b = next(self.batches)
                ids, mask = b["ids"].flatten().to_numpy(), b["mask"].flatten()
                self.rest = ids if mask.true_count == len(mask) else ids[mask.to_numpy(zero_copy_only=False)]
            some, self.rest = self.rest[:n], self.rest[n:]
            got.append(some)
            n -= len(some)
        return np.concatenate(got).astype("<u4")


def documents(files: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it) and ids (little-endian, 32 bits each) of each document.

    ``files`` is a manifest: its rows, a few numbers for each part, reach the driver, which adds
    up what is before each part. Each part is then read by a task, from its files.
    """
    spark = files.sparkSession
    batched(spark)
    parts = sorted(files.collect(), key=lambda r: r.part)
    before = accumulate((r.n_tokens for r in parts), initial=0)
    rows = spark.createDataFrame([(r.folder, r.tokens, r.documents, b) for r, b in zip(parts, before)], "folder string, tokens string, documents string, before long")
    fields = to_arrow_schema(T._parse_datatype_string("doc_id long, start long, ids binary"))

    def read(folder: str, tokens: str, index: str, before: int) -> Iterator[pa.RecordBatch]:
        with _opened(folder, tokens) as source, _opened(folder, index) as listed:
            flow = _Flow(source)
            for b in pa.ipc.open_stream(listed):
                start, n = b["start"].to_numpy(), b["n_tokens"].to_numpy()
                cuts = np.flatnonzero(np.diff(np.cumsum(4 * n) // BATCH_BYTES, prepend=-1) | (np.arange(len(n)) % BATCH_ROWS == 0)).tolist()
                for i, j in zip(cuts, [*cuts[1:], len(n)], strict=True):
                    yield record_batch({"doc_id": b["doc_id"].slice(i, j - i), "start": start[i:j] + before, "ids": pa.array([flow.take(k).tobytes() for k in n[i:j].tolist()], pa.binary())}, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read(*row.values())

    return rows.repartition(max(1, len(parts))).mapInArrow(run, "doc_id long, start long, ids binary")


class Sequences:
    """All sequences of a local folder at random: ``s[k]`` is (ids, mask) of the k-th, parts in order.

    ids are a view of the memory map; the mask is unpacked from its bits. ``files`` is the
    manifest's rows. At most ``most`` maps are open.
    """

    def __init__(self, files: list, most: int = 64):
        self.files = sorted(files, key=lambda r: r.part)
        self.ends = list(accumulate(r.n_sequences for r in self.files))
        self.table = lru_cache(most)(self._table)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def _table(self, part: int) -> list[pa.RecordBatch]:
        return list(pa.ipc.open_stream(_opened(self.files[part].folder, self.files[part].tokens)))

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        part = bisect_right(self.ends, k)
        place = k - (self.ends[part - 1] if part else 0)
        row = self.table(part)[place // AT_ONCE].slice(place % AT_ONCE, 1)
        return row["ids"].flatten().to_numpy(), row["mask"].flatten().to_numpy(zero_copy_only=False)
