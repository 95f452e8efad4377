"""Tokenise documents and pack them into as few fixed-length sequences as local search finds.

Tokens: the byte-level vocabulary file named by `vocabulary`; each distinct space-separated chunk of an Arrow batch is
encoded once and the rest is array gathering, which gives the same ids as encoding whole texts (see _Encoder).

Packing: full pieces are sequences of their own. The others, one a document at most, are dealt to blocks of about
BLOCK_ROWS pieces by hash; each block starts from best-fit decreasing and improves by moves, one-for-one and two-for-one exchanges that increase the sum of squared fills, which
empties the least filled sequences. A block wastes less than one sequence against packing all at once, needs memory
for its own sizes only, and blocks run in parallel.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunlattice.llm.scratch import cut

CAPACITY = 1024
END_ID = 2
BLOCK_ROWS = 8192
#: Distinct chunks that a Python worker keeps encoded, and bytes of text that it takes at once.
KEPT_CHUNKS, TEXT_BYTES = 300_000, 8_000_000
#: Fixed: the one special token of the vocabulary.
SPECIAL = "<|endoftext|>"


class _Encoder:
    """Ids of whole texts, by way of the distinct chunks between single spaces.

    The vocabulary's pattern splits a text before every space that stands between two characters which are no white
    space, so chunks between such spaces can be encoded apart. Texts with a space beside other white space are encoded
    whole, and texts with the special token's string go to the library that knows special tokens.
    """

    loose = re.compile(r"(?:^|\s) | (?:\s|$)")

    def __init__(self, ranks: bytes, pattern: str, full: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.full, self.library, self.kept = full, None, {}

    def whole(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.full.decode())
        return self.library.encode(text, add_special_tokens=False).ids

    def chunk(self, chunk: str) -> list[int]:
        ids = self.kept.get(chunk)
        if ids is None:
            ids = self.fast.encode_ordinary(" " + chunk)
            if len(self.kept) < KEPT_CHUNKS:
                self.kept[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with END_ID after them."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if SPECIAL in text or self.loose.search(text):
                out[i] = np.asarray([*self.whole(text), END_ID], dtype="<u4")
            else:
                plain.append(i)
        if not plain:
            return out
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        chunks = coded.dictionary.to_pylist()
        heads = [chunks[k] for k in which[offsets[:-1]]]
        encoded = [self.chunk(c) for c in chunks]
        encoded += [self.whole(c) for c in heads]
        encoded.append([END_ID])
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), dtype="<u4", count=int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        which = which.astype(np.int64)
        which[offsets[:-1]] = len(chunks) + np.arange(len(plain))  # a text's first chunk has no space before it
        which = np.insert(which, offsets[1:], len(encoded) - 1)
        ends = offsets[1:] + np.arange(1, len(plain) + 1)
        sizes = lengths[which]
        total = np.cumsum(sizes)
        ids = flat[np.repeat(starts[which] - (total - sizes), sizes) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total[ends - 1]])
        for k, i in enumerate(plain):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out


def _cuts(length: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces: all of CAPACITY tokens but the first."""
    first = length % CAPACITY or CAPACITY
    yield 0, first
    for start in range(first, length, CAPACITY):
        yield start, CAPACITY


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every document; null text is empty, and so only the end id."""
    import public_tokenizers

    def content(path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(
        (
            content(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")),
            public_tokenizers.PATTERN,
            content(vocabulary or public_tokenizers.path("byte_bpe_50k.json")),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(*files.value)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // TEXT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
            for a, b in zip(edges, edges[1:], strict=False):
                rows = []
                encoded = encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                for doc_id, ids in zip(doc_ids.slice(a, b - a).to_pylist(), encoded, strict=True):
                    for k, (start, n) in enumerate(_cuts(len(ids))):
                        rows.append((doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers. Best-fit decreasing, then local search from the emptiest bin on."""
    bins: list[list[int]] = []
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
            bins[k].append(item)
            room[k] = r - size
        else:
            k = len(bins)
            bins.append([item])
            room.append(capacity - size)
        if room[k]:
            by_room[room[k]].append(k)
            open_rooms |= 1 << room[k]
    return _exchange(bins, room, sizes, capacity)


def _exchange(bins: list[list[int]], room: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges that increase the sum of squared fills, until each bin is full, empty or stuck.

    For every item size (0 stands for a move) a heap gives the underfull bin with the most room that holds such an item.
    """
    heaps: dict[int, list[tuple[int, int]]] = {}
    top = np.full(capacity + 1, -1)

    def offer(k: int) -> None:
        if room[k] and bins[k]:
            for size in {0, *(sizes[i] for i in bins[k])}:
                heapq.heappush(heaps.setdefault(size, []), (-room[k], k))
                top[size] = max(top[size], room[k])

    def best(size: int, own: int) -> int:
        """The bin with the most room that has an item of this size; -1 if none."""
        heap, aside, found = heaps.get(size, []), [], -1
        while heap:
            r, k = heap[0]
            if -r != room[k] or not bins[k] or size and all(sizes[i] != size for i in bins[k]):
                heapq.heappop(heap)
            elif k == own:
                aside.append(heapq.heappop(heap))
            else:
                found = k
                break
        top[size] = -heap[0][0] if heap else -1
        for x in aside:
            heapq.heappush(heap, x)
        return found

    for k in range(len(bins)):
        offer(k)
    spare = np.arange(capacity + 1)
    for u in sorted((k for k in range(len(bins)) if room[k]), key=lambda k: -room[k]):
        changed = True
        while changed and bins[u]:
            changed = False
            # only what is given away in total counts: one item or two for each sum that the bin's items make
            own = sorted(bins[u], key=lambda i: -sizes[i])
            of_size: dict[int, list[int]] = {}
            for i in own:
                of_size.setdefault(sizes[i], []).append(i)
            gives = {size: (items[0],) for size, items in of_size.items()}
            for n, (x, xs) in enumerate(of_size.items()):
                if len(xs) > 1:
                    gives.setdefault(2 * x, (xs[0], xs[1]))
                for y in list(of_size)[n + 1 :]:
                    gives.setdefault(x + y, (xs[0], of_size[y][0]))
            for amount, give in gives.items():
                takes = np.flatnonzero(top[:amount] >= amount - spare[:amount])
                for size in takes.tolist():  # the smallest exchanged item first: the largest gain
                    v = best(size, u)
                    gain = amount - size
                    if v < 0 or room[v] < gain or capacity - room[v] + gain <= capacity - room[u]:
                        continue
                    back = next((i for i in bins[v] if sizes[i] == size), None) if size else None
                    bins[v] = [i for i in bins[v] if i != back] + list(give)
                    bins[u] = [i for i in bins[u] if i not in give] + ([back] if size else [])
                    room[v] -= gain
                    room[u] += gain
                    offer(v)
                    offer(u)
                    changed = True
                    break
                if changed:
                    break
    return [b for b in bins if b]


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
    sizes = frame["length"].tolist()
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for n, items in enumerate(pack(sizes)):
        at = 0
        for i in items:
            sequence[i], offset[i] = (int(key[0]) << 32) + n, at
            at += sizes[i]
    return frame.drop(columns="block").assign(sequence_id=sequence, offset=offset)


def pack_documents(docs: DataFrame, **files) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts and empty texts are documents of one
    token (the end id); rows with a null or repeated doc_id are packed like any other; an empty table gives an empty one;
    very long texts are cut into full pieces, the first of which may be shorter. Other columns are dropped.
    """
    pieces = cut(token_pieces(docs, **files))
    part = pieces.where(F.col("length") < CAPACITY)
    blocks = max(1, -(-part.count() // BLOCK_ROWS))
    # rows of the written table are numbered, so that a row repeated very often is dealt to many blocks
    numbered = part.withColumn("row", F.monotonically_increasing_id())
    blocked = numbered.select(*part.columns, F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("long").alias("block"))
    packed = blocked.groupBy("block").applyInPandas(_pack_block, _PACKED)
    # numbers below zero, as blocks count from zero
    own = (-1 - F.monotonically_increasing_id()).alias("sequence_id")
    full = pieces.where(F.col("length") == CAPACITY).select(*pieces.columns, own, F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
