"""Batches of named arrays: assembled from records in tasks, and as bytes in Arrow's stream format."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_bytes(batch: tuple[tuple[str, np.ndarray], ...]) -> bytes:
    """One row with a binary column per array; shapes and types are the schema's metadata."""
    about = [{"name": n, "shape": list(x.shape), "dtype": x.dtype.newbyteorder("<").str} for n, x in batch]
    cols = [pa.array([np.ascontiguousarray(x, d["dtype"]).tobytes()], pa.large_binary()) for (_, x), d in zip(batch, about)]
    rows = pa.RecordBatch.from_arrays(cols, [f"a{i}" for i in range(len(cols))]).replace_schema_metadata({"batch": json.dumps(about)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> tuple[tuple[str, np.ndarray], ...]:
    with pa.ipc.open_stream(data) as source:
        rows = source.read_next_batch()
    about = json.loads(rows.schema.metadata[b"batch"])
    return tuple((d["name"], np.frombuffer(rows.column(i)[0].as_py(), d["dtype"]).reshape(d["shape"])) for i, d in enumerate(about))


def _numbers(column: pa.Array, size: int, kind: str) -> np.ndarray:
    """The numbers of a list column as rows of an array; a null list is zeros. No number becomes an object."""
    if column.null_count:
        offsets = np.concatenate([[0], np.cumsum(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, size))])
        out = np.zeros((len(column), size), kind)
        out[np.diff(offsets) > 0] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(kind)
        return out
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(kind, copy=False)


def assemble(records: DataFrame, arrays: list[tuple[str, tuple[int, ...], str]], batch_size: int, batch_major: bool) -> DataFrame:
    """A row per batch from records that stand in the order of (batch_id, slot), all of a batch in one partition.

    ``arrays`` are columns of lists with their shape and number type. Returns batch_id, n_bytes, a binary column per array (a0, a1,
    ...; little-endian, the batch axis first, or last without ``batch_major``) and ``_error``, which names the first record that has one. A task
    holds one batch and what it reads of the next; what it hands on is the batch's bytes.
    """
    names = [f"a{i}" for i in range(len(arrays))]
    sizes = [int(np.prod(shape)) for _, shape, _ in arrays]

    def run(batches):
        filled = [np.zeros((batch_size, n), np.dtype(kind).newbyteorder("<")) for n, (_, _, kind) in zip(sizes, arrays)]
        at, error = 0, None
        for b in batches:
            ids, errors, record = b.column("batch_id"), b.column("_error"), b.column("row_idx")
            columns = [_numbers(b.column(name), n, kind) for name, n, (_, _, kind) in zip(names, sizes, arrays)]
            broken = np.flatnonzero(errors.is_valid().to_numpy(zero_copy_only=False))
            done = 0
            while done < b.num_rows:
                n = min(batch_size - at, b.num_rows - done)
                for to, c in zip(filled, columns):
                    to[at : at + n] = c[done : done + n]
                here = broken[(broken >= done) & (broken < done + n)]
                if error is None and len(here):
                    error = f"record {record[here[0]].as_py()}: {errors[here[0]].as_py()}"
                at, done = at + n, done + n
                if at == batch_size:
                    raw = [(x if batch_major else np.ascontiguousarray(x.T)).tobytes() for x in filled]
                    values = [pa.array([ids[done - 1].as_py()], pa.int64()), pa.array([sum(map(len, raw))], pa.int64()), *(pa.array([r], pa.binary()) for r in raw), pa.array([error], pa.string())]
                    yield pa.RecordBatch.from_arrays(values, ["batch_id", "n_bytes", *names, "_error"])
                    at, error = 0, None

    rows = records.select("batch_id", "row_idx", *(F.col(f"`{name}`").alias(n) for n, (name, _, _) in zip(names, arrays)), "_error")
    return rows.mapInArrow(run, ", ".join(["batch_id long", "n_bytes long", *(f"{n} binary" for n in names), "_error string"]))
