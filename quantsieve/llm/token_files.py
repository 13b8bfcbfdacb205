r"""Token-id output as length-delimited binary records with a separate offset index.

A data file is a run of records: length (u64, little-endian), masked CRC-32 of the length's 8 bytes (u32), the
sequence, masked CRC-32 of the sequence (u32). A sequence is token ids as u16 or, where the vocabulary or the end id
goes beyond 65,535, u32, little-endian. The mask is that of common record formats: rotate right by 15 bits, add
0xa282ead8. An index file holds, for each record of its data file, three i64: document id, byte offset of the record,
number of ids; so that readers may take records in any order.

Documents are range-partitioned by id and sorted, and each partition writes one data file and its index, in
a folder that all executors share. Files get names of their own in each attempt of a task; the manifest, which
is made of what the successful tasks return, says which count. So lost executors and repeated tasks leave
at most unused files.

Defined results: a null text counts as empty: its record holds the end id alone; rows without a document id come first, as
id -2**63; rows with the same id are ordered by text; an empty table gives no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantsieve.llm._shared import table
from quantsieve.llm.encoding import encoder, with_end
from quantsieve.sources.shared import new_path

MANIFEST = "part int, data string, index string, n_records long, n_ids long, width int"
NULL_ID = -(2**63)

def masked_crc(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(sequence: bytes | memoryview) -> bytes:
    head = struct.pack("<Q", len(sequence))
    return b"".join((head, struct.pack("<I", masked_crc(head)), sequence, struct.pack("<I", masked_crc(sequence))))


def unframe(stream) -> Iterator[bytes]:
    """The sequences of a data file, checked."""
    while head := stream.read(12):
        size, check = struct.unpack("<QI", head)
        if check != masked_crc(head[:8]):
            raise ValueError("corrupt record length")
        sequence = stream.read(size)
        if struct.unpack("<I", stream.read(4))[0] != masked_crc(sequence):
            raise ValueError("corrupt record")
        yield sequence


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, *, folder: str | None = None, wide: bool | None = None, special_strings: bool = True, files: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs in ascending order of id; the manifest: one row per file, in order of ``part``.

    wide: whether ids are u32; by the vocabulary if not given. Too large an id for u16 is an error.
    """
    spark = docs.sparkSession
    folder = _uri(folder or new_path(spark, "tokens"))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
    keys = (F.col("doc_id"), F.xxhash64("text"))
    rows = (rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer_path, special_strings)
        fits = max(enc.largest, end_id) <= 0xFFFF
        if wide is False and not fits:
            raise ValueError("ids of this vocabulary need 32 bits")
        width = 2 if fits and not wide else 4
        out, index, at, total = None, [], 0, 0
        for batch in batches:
            keys, row = batch.column("doc_id").to_pylist(), 0
            for ids, counts in enc.encode(batch.column("text")):
                if out is None:
                    fs, top = _open(folder)
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}.bin")
                ids, counts = with_end(ids, counts, end_id)
                data, lo = memoryview(ids.astype(f"<u{width}", copy=False)).cast("B"), 0
                for n in counts.tolist():
                    out.write(record := frame(data[lo : lo + n * width]))
                    index.append((keys[row], at, n))
                    at, total, lo, row = at + len(record), total + n, lo + n * width, row + 1
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{top}/{name}.idx") as f:
            f.write(np.array(index, "<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": [f"{folder}/{name}.bin"], "index": [f"{folder}/{name}.idx"], "n_records": [len(index)], "n_ids": [total], "width": pa.array([width], pa.int32())})

    return table(rows.mapInArrow(write, MANIFEST), "manifest")


def read_index(manifest: DataFrame) -> DataFrame:
    """One row per record: data, doc_id, at (bytes), n_ids, width: what a reader shuffles."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf.itertuples():
                fs, path = _open(m.index)
                with fs.open_input_stream(path) as f:
                    got = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                yield pd.DataFrame({"data": m.data, "doc_id": got[:, 0], "at": got[:, 1], "n_ids": got[:, 2], "width": m.width})

    return manifest.mapInPandas(read, "data string, doc_id long, at long, n_ids long, width int")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Every record's (doc_id, ids) in an order that the seed sets, each read by its offset."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict[str, object] = {}
        for pdf in batches:
            ids = []
            for r in pdf.itertuples():
                if r.data not in files:
                    fs, path = _open(r.data)
                    files[r.data] = fs.open_input_file(path)
                files[r.data].seek(r.at)
                ids.append(np.frombuffer(next(unframe(files[r.data])), f"<u{r.width}").astype(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids})
        for f in files.values():
            f.close()

    order = F.xxhash64(F.lit(seed), "data", "at")
    return read_index(manifest).orderBy(order, "data", "at").mapInPandas(read, "doc_id long, ids array<long>")


def read_digest(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, in file order from the files themselves.

    start counts the ids of all records before: those of earlier files from the manifest, one row per file.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_files = max(1, manifest.count())
    files = manifest.select("part", "data", "index", "width", before.alias("start")).repartitionByRange(n_files, "part")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf.itertuples():
                fs, path = _open(m.index)
                with fs.open_input_stream(path) as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                crc = np.empty(len(index), np.int64)
                fs, path = _open(m.data)
                with fs.open_input_stream(path, buffer_size=1 << 20) as f:
                    for i, sequence in enumerate(unframe(f)):
                        ids = np.frombuffer(sequence, f"<u{m.width}")
                        if len(ids) != index[i, 2]:
                            raise ValueError("index and records differ")
                        crc[i] = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
                n = index[:, 2]
                yield pd.DataFrame({"doc_id": pd.array(index[:, 0]), "start": m.start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    out = files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
