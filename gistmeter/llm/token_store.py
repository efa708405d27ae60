"""Token ids in files of byte planes with a chunk index."""

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.llm.columns import SLICE, row_slices, text_column
from gistmeter.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, Memo, Splitter
from gistmeter.llm.shared import file_system, text_documents

BLOCK = 1 << 16  # ids of a block
MEMO = 1_000_000  # pieces remembered by a worker, some 30 bytes each
MAGIC = b"PLANES01"


def planes(ids: np.ndarray) -> list[bytes]:
    """The four byte planes of a block of ids, lowest byte first, each compressed on its own."""
    packer = zstandard.ZstdCompressor(level=3)
    return [packer.compress(np.ascontiguousarray(p).tobytes()) for p in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def from_planes(packed: list[bytes], n: int) -> np.ndarray:
    opener = zstandard.ZstdDecompressor()
    return np.ascontiguousarray(np.stack([np.frombuffer(opener.decompress(p, max_output_size=n), np.uint8) for p in packed], axis=1)).view("<u4").ravel()


class PlaneWriter:
    """A file: magic, blocks of planes, documents' ids and lengths, the chunk index, its place.

    The index names, for each block, the place and length of every plane and the number of ids, so any
    range of ids is read without the rest.
    """

    def __init__(self, out):
        self.out, self.at, self.blocks = out, 0, []
        self.waiting, self.count, self.ids, self.lengths, self.valid = [], 0, [], [], []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        entry = [len(ids)]
        for plane in planes(ids):
            entry += [self.at, len(plane)]
            self._write(plane)
        self.blocks.append(entry)

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        """The ids of some documents end to end."""
        self.ids.append(np.array([0 if d is None else d for d in doc_ids], np.int64))
        self.valid.append(np.array([d is not None for d in doc_ids], np.uint8))
        self.lengths.append(lengths)
        self.waiting.append(ids)
        self.count += len(ids)
        if self.count >= BLOCK:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(ids[k:k + BLOCK])
            self.waiting, self.count = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        """Returns the numbers of documents and ids."""
        if self.count:
            self._block(np.concatenate(self.waiting))
        tables = [np.concatenate([*x, np.empty(0, kind)]).astype(kind) for x, kind in ((self.ids, "<i8"), (self.lengths, "<i8"), (self.valid, "u1"))]
        index = {"blocks": self.blocks, "tables": []}
        for t in tables:
            packed = zstandard.compress(t.tobytes())
            index["tables"].append([self.at, len(packed), t.nbytes])
            self._write(packed)
        packed = zstandard.compress(json.dumps(index).encode())
        self._write(packed + len(packed).to_bytes(8, "little"))
        return len(tables[0]), int(tables[1].sum())


class PlaneReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        length = int.from_bytes(self._read(size - 8, 8), "little")
        self.index = json.loads(zstandard.decompress(self._read(size - 8 - length, length)))
        ids, lengths, valid = (zstandard.decompress(self._read(at, n), max_output_size=most) for at, n, most in self.index["tables"])
        self.doc_ids, self.lengths, self.valid = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8"), np.frombuffer(valid, "u1")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        n, *places = self.index["blocks"][k]
        return from_planes([self._read(places[i], places[i + 1]) for i in range(0, 8, 2)], n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """A range of the file's ids, by the blocks that hold it."""
        blocks = range(start // BLOCK, -(-stop // BLOCK))
        return np.concatenate([np.empty(0, "<u4"), *map(self.block, blocks)])[start - start // BLOCK * BLOCK:][:stop - start]


class AddedTokens:
    """The tokenizer's added tokens, whose strings the library takes out of a text before it splits the rest."""

    def __init__(self, tokens: dict):
        odd = [t.content for t in tokens.values() if t.lstrip or t.rstrip or t.single_word]
        if odd:
            raise ValueError(f"added tokens that take blanks or need word bounds are not supported: {odd}")
        self.of = {t.content.encode(): i for i, t in tokens.items()}
        # of those that start first, the longest
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.of, key=len, reverse=True))))

    def ids(self, data: np.ndarray, splitter: Splitter, memo: Memo, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `Memo.ids`: the tokens' ids as they are, and each span between them split and encoded on its own."""
        raw = data.tobytes()
        if not any(t in raw for t in self.of):
            return memo.ids(data, splitter, offsets)
        spans, tokens, after, last = [], [], [], []  # `after`: the span before each token; `last`: the last span of each row
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for found in self.pattern.finditer(raw, a, b):
                after.append(len(spans))
                tokens.append(self.of[found.group()])
                spans.append((a, found.start()))
                a = found.end()
            last.append(len(spans))
            spans.append((a, b))
        rest = np.frombuffer(b"".join(raw[a:b] for a, b in spans), np.uint8)
        ids, ends = memo.ids(rest, splitter, np.concatenate([[0], np.cumsum([b - a for a, b in spans])]))
        return np.insert(ids, ends[after], tokens), ends[last] + np.searchsorted(after, last)


@lru_cache(maxsize=2)
def _tools(path: str, added: bool) -> tuple[Splitter, Memo, AddedTokens | None]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    tokens = whole.get_added_tokens_decoder() if added else {}
    whole.encode_special_tokens = True  # their strings in a piece are ordinary text

    def probe(chars: list[str]) -> list[int]:
        split = whole.pre_tokenizer.pre_tokenize_str
        return [next((k for mate, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(split(mate + c)) == 1), SPACE) for c in chars]

    def encode(pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in whole.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    return Splitter(probe), Memo(encode, MEMO), AddedTokens(tokens) if tokens else None


MANIFEST = "part long, file string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, added: bool = False) -> DataFrame:
    """Encode every text and write its ids, `end_id` behind them, to files in ascending doc_id order.

    Returns the manifest (part, file, n_docs, n_ids, start), a row for each file; start counts the ids of
    all files before.  A null doc_id comes first, rows that repeat a doc_id are ordered by their text, a
    null or empty text has the end id alone, other columns are ignored, and an empty table gives no rows.

    Texts move once, into ranges of doc_id; each task streams its range to one file of its own, which gets
    its name when it is whole.  `tokenizer` is a file whose pieces are split by the pattern of `pretokens`.
    With `added`, strings of its added tokens in a text have the tokens' ids, as the library does unless told
    otherwise; without, they are spelled out.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, memo, tokens = _tools(tokenizer, added)
        part = TaskContext.get().partitionId()
        store, base = file_system(folder)
        partial, path, writer, out = f"{base}/.{uuid.uuid4().hex}", f"{base}/part-{part:06d}.planes", None, None
        for batch in batches:
            data, offsets = text_column(batch)
            for lo, hi in row_slices(offsets, SLICE):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(partial)
                    writer = PlaneWriter(out)
                some, bounds = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                ids, ends = tokens.ids(some, splitter, memo, bounds) if tokens else memo.ids(some, splitter, bounds)
                lengths = np.diff(ends, prepend=0)
                writer.add(batch.column(0).slice(lo, hi - lo).to_pylist(), np.insert(ids, ends, end_id), lengths + 1)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            store.move(partial, path)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path.rsplit("/", 1)[1]]), pa.array([n_docs], pa.int64()),
                                              pa.array([n_ids], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    placed = text_documents(docs).repartitionByRange("doc_id", F.crc32(F.encode("text", "UTF-8"))).sortWithinPartitions("doc_id", "text")
    files = sorted(placed.mapInArrow(task, MANIFEST).collect())  # a row for each file
    start, rows = 0, []
    for r in files:
        rows.append((*r, start))
        start += r["n_ids"]
    return docs.sparkSession.createDataFrame(rows, MANIFEST + ", start long")


def _documents(reader: PlaneReader, start: int):
    """(doc_id, start, n_tokens, crc32 of the ids) of each document, block by block."""
    ids, block, left, at = b"", 0, 0, 0
    for doc_id, valid, n in zip(reader.doc_ids.tolist(), reader.valid.tolist(), reader.lengths.tolist()):
        crc, need = 0, n
        while need:
            if not left:
                ids, at = reader.block(block).tobytes(), 0
                block, left = block + 1, len(ids) // 4
            take = min(need, left)
            crc = zlib.crc32(ids[4 * at:4 * (at + take)], crc)
            at, left, need = at + take, left - take, need - take
        yield doc_id if valid else None, start, n, crc
        start += n


DOCUMENT_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{file}") as source:
                    rows = list(zip(*_documents(PlaneReader(source), start)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=[c.split()[0] for c in DOCUMENT_ROWS.split(", ")])

    spark: SparkSession = manifest.sparkSession
    rows = [(r["file"], r["start"]) for r in manifest.collect()]
    files = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(task, DOCUMENT_ROWS)
