"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds record batches of ``BATCH`` sequences of ``LENGTH`` ids and a
mask of the same shape (a bit each; 0: padding after the last id of the file).
All batches but the last are equally long on disk, so the place of batch i
follows from the first one's length: :func:`sequence` reads the k-th sequence
from there without touching those before it, as views of the mapped file.
Ids are 16-bit where the vocabulary allows, else 32-bit; the schema's metadata
tells the format, the length and the end id.  A second stream beside it lists
the documents (doc_id, first id, ids).

Documents are dealt to files by ranges of (doc_id, hash of the text, row), so
equal and null ids are spread as well; each file is in ascending order, nulls
first.  Texts are encoded by the task that writes them: compressed, they are
hardly longer than ids, which would have to be written once more to find the
ranges.  A file appears under its name only when it is whole (written beside
it, then moved), a task that runs again writes another file, and only files
that the committed manifest names are read.

Null and empty texts are the end id alone; repeated rows are written each; an
empty table writes no file; other columns are ignored.  Texts are encoded
whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_dir, slices, text_or_empty
from .vocab import encoder, with_end

LENGTH, BATCH, END_ID = 1024, 256, 2
MANIFEST = "file_no long, path string, docs long, ids long, sequences long"
FIELDS = "file_no long, doc_id long, local long, n_tokens long, ids_crc32 long"
DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])


def id_dtype(vocabulary: str) -> str:
    """16 bits if they hold every id of the vocabulary, else 32."""
    return "<u2" if encoder(vocabulary).whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def file_schema(dtype: str, length: int, end_id: int) -> pa.Schema:
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"format": "token-sequences", "length": str(length), "end_id": str(end_id)})


def _fs(uri: str):
    """The file system of a folder; Hadoop's names of stores are other than
    those of Arrow."""
    from pyarrow.fs import FileSystem

    scheme, _, rest = uri.partition("://")
    if rest:
        return FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest}")
    return FileSystem.from_uri(uri if uri.startswith("file:") else "file://" + uri)


def docs_path(path: str) -> str:
    return path.removesuffix(".arrows") + ".docs.arrows"


class Writer:
    """Ids of documents one after another, cut into batches of sequences."""

    def __init__(self, sink, listing, dtype: str, length: int, batch: int, end_id: int):
        self.schema, self.dtype, self.length, self.rows = file_schema(dtype, length, end_id), np.dtype(dtype), length, batch
        self.out, self.listing = pa.ipc.new_stream(sink, self.schema), pa.ipc.new_stream(listing, DOCS)
        self.held: list[np.ndarray] = []
        self.n = self.ids = self.sequences = self.count = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents' ids one after another, [documents + 1] offsets."""
        self.listing.write_batch(pa.record_batch([doc_ids, pa.array(self.ids + offsets[:-1]), pa.array(np.diff(offsets))], schema=DOCS))
        self.held.append(ids)
        self.ids += len(ids)
        self.n += len(ids)
        self.count += len(doc_ids)
        whole = self.length * self.rows
        if self.n >= whole:
            every = np.concatenate(self.held)
            for at in range(0, len(every) - whole + 1, whole):
                self._write(every[at : at + whole], whole)
            self.held, self.n = [every[len(every) // whole * whole :]], len(every) % whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids.astype(self.dtype), mask)], schema=self.schema))
        self.sequences += len(ids) // self.length

    def close(self) -> None:
        if self.n:
            rows = -(-self.n // self.length)
            self._write(np.concatenate([*self.held, np.zeros(rows * self.length - self.n, self.dtype)]), self.n)
        self.out.close()
        self.listing.close()


def write_sequences(docs: DataFrame, vocabulary: str, folder: str | None = None, length: int = LENGTH, end_id: int = END_ID, dtype: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest, in doc_id order of
    file_no.  ``folder`` must be one that all executors share."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-files")
    dtype = dtype or id_dtype(vocabulary)
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def written(batches):
        from pyspark import TaskContext

        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        path = f"{root}/part-{number:06d}-{uuid.uuid4().hex}.arrows"
        names = path, docs_path(path)
        writer = None
        encode = encoder(vocabulary).encode_column
        for batch in slices(batches, "text", 2 << 20):
            if writer is None:
                sinks = [fs.open_output_stream(n + ".part") for n in names]
                writer = Writer(*sinks, dtype, length, BATCH, end_id)
            ids, offsets = with_end(*encode(batch.column("text")), end_id)
            writer.add(batch.column("doc_id"), ids.astype(dtype), offsets)
        if writer is not None:
            writer.close()
            for sink, n in zip(sinks, names, strict=True):
                sink.close()
                fs.move(n + ".part", n)
            yield pa.RecordBatch.from_pylist([{"file_no": number, "path": path, "docs": writer.count, "ids": writer.ids, "sequences": writer.sequences}], pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("sequences", pa.int64())]))

    manifest = cut(dealt.mapInArrow(written, MANIFEST))
    return manifest.withColumn("folder", F.lit(folder))


def read_documents(folder: str, path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, first id in the file, ids) of a file, a batch at a time."""
    fs, _ = _fs(folder)
    with fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader, fs.open_input_stream(docs_path(path)) as listed, pa.ipc.open_stream(listed) as docs:
        held, start = np.zeros(0, np.uint32), 0
        for batch in docs:
            for doc, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                while start + len(held) < first + n:
                    try:
                        rows = reader.read_next_batch()
                    except StopIteration:
                        raise ValueError(f"{path} ends inside a document") from None
                    ids, mask = rows.column("ids").values.to_numpy(), rows.column("mask").values
                    held = np.concatenate([held[first - start :], ids[: mask.true_count].astype("<u4")])
                    start = first
                yield doc, first, held[first - start : first - start + n]


def sequence(path: str, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask (bits, as Arrow keeps them) of the k-th sequence of a
    mapped local file: views of it.  Reads the schema, one message to learn a
    batch's length, and batch k."""
    source = pa.memory_map(path)
    schema = pa.ipc.read_schema(source)
    length = int(schema.metadata[b"length"])
    first = source.tell()
    rows = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema).num_rows
    if not 0 <= k:
        raise IndexError(k)
    at = first + (source.tell() - first) * (k // rows)
    if at >= source.size():
        raise IndexError(k)
    source.seek(at)
    try:
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(source), schema)
    except (EOFError, pa.ArrowInvalid):
        raise IndexError(k) from None
    if k % rows >= batch.num_rows:
        raise IndexError(k)
    at = k % rows * length
    return batch.column("ids").values.to_numpy()[at : at + length], batch.column("mask").values.slice(at, length)


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(file_no, doc_id, local, n_tokens, ids_crc32) of every document, from
    the files."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def rows(batches):
        for batch in batches:
            for number, path, folder in zip(*(batch.column(k).to_pylist() for k in ("file_no", "path", "folder")), strict=True):
                out: list[tuple] = []
                for doc, first, ids in read_documents(folder, path):
                    out.append((number, doc, first, len(ids), zlib.crc32(ids)))
                    if len(out) == 50_000:
                        yield pa.record_batch({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(names)})
                        out = []
                yield pa.record_batch({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(names)})

    return manifest.select("file_no", "path", "folder").mapInArrow(rows, FIELDS)


def encode_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from the files."""
    manifest = write_sequences(docs, vocabulary)
    # a row for each file, a few thousand: their running sum is one small task
    base = manifest.select("file_no", F.coalesce(F.sum("ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return read_back(docs.sparkSession, manifest).join(F.broadcast(base), "file_no").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
