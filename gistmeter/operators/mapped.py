"""A vector table too large to send to every task: Spark writes it once to the shared folder, tasks map the files."""

import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame

from gistmeter.operators.layout import fresh_path

COPY = 1 << 22


def _store(uri: str):
    """The Arrow file system of a folder and the folder's path in it."""
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _opened(folder: str, name: str) -> pa.Table:
    """The rows of a file, mapped.  From a remote store it is first copied to a nameless local file."""
    store, base = _store(folder)
    if store.type_name == "local":
        return pa.ipc.open_file(pa.memory_map(f"{base}/{name}")).read_all()
    with tempfile.NamedTemporaryFile() as local, store.open_input_stream(f"{base}/{name}") as remote:
        while piece := remote.read(COPY):
            local.write(piece)
        local.flush()
        return pa.ipc.open_file(pa.memory_map(local.name)).read_all()


class MappedLookup:
    """Keys and vectors of all files.  A task opens them when it first asks; pages that it reads are shared by the tasks of a machine."""

    def __init__(self, folder: str, names: list[str], dim: int):
        self.folder, self.names, self.dim, self.keys = folder, names, dim, None

    def _open(self) -> None:
        chunks = [b for name in self.names for b in _opened(self.folder, name).to_batches() if b.num_rows]
        self.parts = [b.column("vec").flatten().to_numpy().reshape(-1, self.dim) for b in chunks]
        self.starts = np.cumsum([0, *(len(p) for p in self.parts)])
        self.keys = pa.concat_arrays([b.column("key") for b in chunks])

    def __len__(self) -> int:
        if self.keys is None:
            self._open()
        return len(self.keys)

    def rows(self, asked: pa.Array) -> np.ndarray:
        """The row of each key; -1 where there is none."""
        if not len(self) or not len(asked):
            return np.full(len(asked), -1)
        distinct = asked.dictionary_encode()
        at = pc.fill_null(pc.index_in(distinct.dictionary, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype("int64")
        codes = pc.fill_null(distinct.indices, len(at)).to_numpy(zero_copy_only=False)
        return np.append(at, -1)[codes]

    def take(self, at: np.ndarray) -> np.ndarray:
        """The vectors of these rows."""
        out, part = np.empty((len(at), self.dim)), np.searchsorted(self.starts, at, side="right") - 1
        for k in np.unique(part):
            here = np.flatnonzero(part == k)
            out[here] = self.parts[k][at[here] - self.starts[k]]
        return out


def mapped_lookup(vectors: DataFrame) -> MappedLookup | None:
    """The table (key, vec) written by the tasks that read it; None if keys repeat or are null or vectors are not whole.
    The driver gets a name and a few figures of each file."""
    folder = fresh_path(vectors.sparkSession, "vectors")

    def write(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, out, n, fine, dims = f"{uuid.uuid4().hex}.arrow", None, 0, True, set()
        with store.open_output_stream(f"{base}/{name}") as sink:
            for batch in batches:
                keys, vecs = batch.column("key"), batch.column("vec")
                flat = vecs.flatten()
                fine = fine and not (keys.null_count or vecs.null_count or flat.null_count) and pc.all(pc.is_finite(flat)).as_py() is not False
                dims |= set(pc.unique(pc.list_value_length(vecs)).to_pylist())
                out = out or pa.ipc.new_file(sink, batch.schema)
                out.write_batch(batch)
                n += batch.num_rows
            if out:
                out.close()
        if n:
            yield pa.RecordBatch.from_pydict({"name": [name], "fine": [bool(fine) and len(dims) == 1], "dim": pa.array([max(d or 0 for d in dims)], pa.int32())})

    rows = vectors.select("key", "vec")
    made = rows.mapInArrow(write, "name string, fine boolean, dim int").collect()
    if not made or not all(r["fine"] for r in made) or len({r["dim"] for r in made}) > 1 or not made[0]["dim"]:
        return None
    if not rows.groupBy("key").count().filter("count > 1").isEmpty():
        return None
    return MappedLookup(folder, sorted(r["name"] for r in made), made[0]["dim"])
