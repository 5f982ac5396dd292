"""Byte-level BPE by monoid tree reduction.

A piece (a match of the split pattern) is cut in halves until they are short; the halves' tokens are joined up the
tree. A join re-encodes a window of tokens around the seam and lets it grow until its outermost tokens are again the
ones that stood there before. That is proof enough: a chain of tokens is the encoding of its bytes if and only if each
two neighbours are the encoding of theirs, pairs within a half or within the window hold by construction, and at the
window's ends the pairs are the same as before.

Decoding concatenates up a tree of ids in the same way.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsfold.llm.text import documents

#: Bytes of a half that is merged directly; pieces that a worker remembers; ids joined at once when decoding.
LEAF, REMEMBER, RUN = 24, 400_000, 65_536


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The ids of data: the pair of least rank is merged, the leftmost of equals first, until none has a rank."""
        ranks = self.ranks
        if len(data) > 2 * LEAF:
            return self._merge_long(data)
        none = 1 << 62
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """As merge, with a heap over linked parts."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; where the one before it starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of the bytes of a and b together; a and b are encodings."""
        w = 1
        while True:
            left, right = a[-w:], b[:w]
            mid = self.merge(self.decode(left + right))
            if (w >= len(a) or mid[0] == left[0]) and (w >= len(b) or mid[-1] == right[-1]):
                return a[:-w] + mid + b[w:]
            w *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        return self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self._tree(data[:half]), self._tree(data[half:]))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; pieces seen before are looked up."""
        pieces, known = self.find(text), self.known
        if len(known) > REMEMBER:
            known.clear()
        for p in set(pieces).difference(known):
            known[p] = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, pieces)), "<u4")

    def decode(self, ids) -> bytes:
        if len(ids) <= RUN:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=1)
def codec(ranks_path: str, pattern: str) -> Codec:
    """The worker's codec: it keeps what it has learnt from one task to the next."""
    return Codec(load_ranks(ranks_path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row; null text is empty and has no ids; repeated rows are repeated."""

    def run(batches):
        encode = codec(ranks_path, pattern).encode
        for batch in batches:
            ids = [pa.array(encode(t.as_py() or "").astype(np.int32)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.to_pylist() for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids.

    One pass without a shuffle. Null text is empty; repeated rows are repeated; other columns are ignored. ranks_path: a
    path that every executor can read.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            n, coded, decoded = [], [], []
            for t in batch.column("text"):
                ids = own.encode(t.as_py() or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    return round_trip(documents(spark, sf_dir), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
