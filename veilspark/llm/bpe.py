"""Operator 9: byte-level BPE by monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .sampling import slices

LEAF = 8  # bytes that are merged directly; longer ones are halved
DIRECT = 48  # bytes of a window whose least pair is looked for anew at each step; longer ones keep a heap
NONE = 1 << 62
REMEMBERED = 1 << 18  # pieces, and as many pairs, that a worker keeps; more start the memory afresh
SHORT = 48  # characters of a piece that is kept


class Encoder:
    """Encodes and decodes by a table of ranks (bytes to id), each match of the pattern on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.fits = lru_cache(REMEMBERED)(self._fits)
        self.pieces: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merges the pair of least rank, the leftmost of equals, again and again: BPE of a short piece or window."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return (ranks[data],) if n else ()
        if n <= DIRECT:
            get, cut = ranks.get, list(range(n + 1))
            pair = [get(data[i : i + 2], NONE) for i in range(n - 1)]
            while pair and (least := min(pair)) != NONE:
                i = pair.index(least)
                del cut[i + 1], pair[i]
                if i < len(pair):
                    pair[i] = get(data[cut[i] : cut[i + 2]], NONE)
                if i:
                    pair[i - 1] = get(data[cut[i - 1] : cut[i + 1]], NONE)
            return tuple([ranks[data[a:b]] for a, b in zip(cut, cut[1:])])
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i] or (j := after[i]) >= n or after[j] != end:
                continue
            gone[j] = True
            after[i] = end
            if end < n:
                before[end] = i
                if (r := ranks.get(data[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def _fits(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both texts together from the encodings of each.

        A window around the boundary is encoded anew and doubled until its first token fits the token before it
        and its last token the one after it (a pair fits if it encodes as itself). Tokens are then as in the
        encoding of the whole: within parts that are encoded on their own, the merges of the whole run in the
        order in which they run in any two neighbours alone, so the first merge over a token's end would also
        happen in a pair of neighbours, and none does.
        """
        if not left or not right:
            return left or right
        if self.fits(left[-1], right[0]):
            return left + right
        w = 1
        while True:
            a, b = left[-w:], right[:w]
            mid = self.merge(self.decode(a + b))
            head, tail = left[:-w], right[w:]
            if (not head or self.fits(head[-1], mid[0])) and (not tail or self.fits(mid[-1], tail[0])):
                return head + mid + tail
            if not head and not tail:
                return mid
            w *= 2

    def encode(self, data: bytes) -> tuple[int, ...]:
        """BPE of data: halves by recursion, then joined; short ones directly."""
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def decode(self, ids: tuple[int, ...]) -> bytes:
        """The bytes of ids, concatenated up the tree of halves."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def piece(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids as text, and the bytes that they decode to, for one match of the pattern."""
        if (found := self.pieces.get(text)) is not None:
            return found
        data = text.encode("utf-8", "surrogatepass")
        ids = (whole,) if (whole := self.ranks.get(data)) is not None else self.encode(data)
        found = len(ids), ",".join(map(str, ids)), self.decode(ids)
        if len(text) <= SHORT:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            self.pieces[text] = found
        return found

    def document(self, text: str | None) -> list[tuple[int, str, bytes]]:
        return list(map(self.piece, self.find(text or "")))

    def ids(self, text: str | None) -> list[int]:
        return [int(i) for _, s, _ in self.document(text) for i in s.split(",")]


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken file: a line for each token, its bytes in base64 and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_ENCODERS: dict[str, Encoder] = {}


def _of(shared, pattern: str) -> Encoder:
    """A worker's encoder; it lives as long as the worker, and so do the pieces that it remembers."""
    name, ranks = shared.value
    key = f"{name} {pattern}"
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids for every row of docs (doc_id, text).

    The table of ranks is read where this is called and sent to the executors once (its size does not depend on
    the documents). Null texts are encoded as empty ones, which have no ids; texts may be of any length;
    repeated rows stay; an empty table gives an empty result; other columns are left alone.
    """
    ranks = load_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _of(shared, pattern)
        for p in slices(parts):
            n, ids, decoded, lists = [], [], [], []
            for text in p.column("text").to_pylist():
                got = enc.document(text)
                line = ",".join([x[1] for x in got])
                n.append(sum([x[0] for x in got]))
                ids.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([x[2] for x in got])).hexdigest())
                lists.append(line)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(lists, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string")


def standard(docs: DataFrame) -> DataFrame:
    """encode_documents() with the public table for many languages."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standard(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
