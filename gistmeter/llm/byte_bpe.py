"""Exact byte-level BPE by backtracking over longest matches."""

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from gistmeter.llm.columns import SLICE, row_slices, text_column
from gistmeter.llm.pretokens import LETTER, NUMBER, OTHER, SPACE, Memo, Splitter
from gistmeter.llm.shared import text_documents

MEMO = 1_000_000  # pieces remembered by a worker, some 30 bytes each
PAIRS = 300_000  # pairs of tokens remembered


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def class_probe(pattern: str):
    """Classes of characters as tiktoken's own pattern engine sees them: which letter, digit or mark a
    character makes one piece with."""
    def probe(chars: list[str]) -> list[int]:
        ranks = {bytes([b]): b for b in range(256)}
        for c in chars:
            for mate in "a1!":
                ranks.setdefault((mate + c).encode(), len(ranks))
        own = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return [next((k for mate, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(own.encode_ordinary(mate + c)) == 1), SPACE)
                for c in chars]
    return probe


class Encoder:
    """Bytes to ids, as merging the adjacent pair of lowest rank again and again would give them.

    A sequence of tokens is that result if every token is the merge of its own bytes and every two
    neighbours stay apart when their bytes are merged alone; there is one such sequence.  It is looked for
    from the left: the longest match first, then its shorter prefixes, and one step back where none fits.
    A position from which the search came back is never entered again, so the steps are linear in the length.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = [len(t) for t in self.token]
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), rank)
        self.matches.make_automaton()
        self.prefix: dict[int, int] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The definition, for the few bytes of one or two tokens."""
        rank, none = self.ranks.get, len(self.token)
        parts = [data[k:k + 1] for k in range(len(data))]
        pairs = [rank(data[k:k + 2], none) for k in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are side by side; a is -1 at the start."""
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.merged(self.token[b]) == [b] if a < 0 else \
                self.compatible(-1, b) and self.merged(self.token[a] + self.token[b]) == [a, b]
            self.apart[key] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix; -1 if none."""
        known = self.prefix.get(token)
        if known is None:
            data = self.token[token]
            known = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
            self.prefix[token] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length = len(piece), self.length
        longest = [-1] * n
        for end, rank in self.matches.iter(piece.decode("latin-1")):  # by end, so the last one is the longest
            longest[end + 1 - length[rank]] = rank
        out, at, reachable = [], 0, bytearray(b"\x01") * (n + 1)
        candidate = longest[0] if n else -1
        while at < n:
            before = out[-1] if out else -1
            while candidate >= 0 and not (reachable[at + length[candidate]] and self.compatible(before, candidate)):
                candidate = self.shorter(candidate)
            if candidate >= 0:
                out.append(candidate)
                at += length[candidate]
                candidate = longest[at] if at < n else -1
            elif out:
                reachable[at] = 0
                candidate = out.pop()
                at -= length[candidate]
            else:
                raise ValueError("the ranks do not hold every byte of the text")
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def _tools(path: str, pattern: str) -> tuple[Encoder, Splitter, Memo]:
    encoder = Encoder(read_ranks(path))
    return encoder, Splitter(class_probe(pattern)), Memo(lambda pieces: map(encoder.encode, pieces), MEMO)


COLUMNS = {"n_tokens": pa.int64(), "ids": pa.binary(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def encoded(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the asked of COLUMNS, one row per row of `docs`.

    ids are little-endian unsigned 32-bit numbers; what is decoded is made from them.  `pattern` must be the
    split pattern of `pretokens`.  A null or empty text has no ids.  Repeated rows are encoded each on its
    own, other columns are ignored, and an empty table gives an empty result.

    No shuffle.  Slices of about a megabyte are split at once, distinct pieces are encoded once each, and
    what is remembered between slices is bounded.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, splitter, memo = _tools(path, pattern)
        for batch in batches:
            data, offsets = text_column(batch)
            for lo, hi in row_slices(offsets, SLICE):
                ids, ends = memo.ids(data[offsets[lo]:offsets[hi]], splitter, offsets[lo:hi + 1] - offsets[lo])
                rows = np.split(ids, ends[:-1])
                made = {"n_tokens": [len(r) for r in rows], "ids": [r.astype("<u4").tobytes() for r in rows],
                        "decoded": [encoder.decode(r.tolist()) for r in rows]}
                made |= {f"{c}_sha256": [hashlib.sha256(x).hexdigest() for x in made[c]] for c in ("ids", "decoded") if f"{c}_sha256" in columns}
                made["decoded"] = [x.decode() for x in made["decoded"]] if "decoded" in columns else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(made[c], COLUMNS[c]) for c in columns]], names=["doc_id", *columns])

    return text_documents(docs).mapInArrow(task, ", ".join(["doc_id long", *[f"{c} {_SQL[COLUMNS[c]]}" for c in columns]]))
