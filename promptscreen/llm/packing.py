"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best-fit: at most OPEN_BINS bins are open; a bitset has a
bit for each free space that some open bin has, so the bin that fits best is
found by a shift and the lowest set bit; when one bin too many would be open,
the fullest closes first. Each task packs what it has read, so nothing is
shuffled. Pieces come to the bins by windows of WINDOW_TOKENS tokens, the longest of a window first: that much
is known before a piece is placed, so it is online by windows, not by pieces. Bins stay open
from window to window.

Ids are those of the tokenizer file. Where that file is a plain byte-level BPE
whose ids follow its merges, they are made with the same vocabulary as ranks,
about four times as fast; the two ways are compared once in each worker. Strings of
added tokens inside a text are those tokens, as the library has it by default.

Defined results. A null text is an empty one; an empty text is one piece of
length 1, the closing id. Rows that repeat are packed as rows of their own. A
null id is kept. An empty table gives no pieces. Columns not named are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

CAPACITY = 2048
OPEN_BINS = 4096
#: Tokens in a window: as many as half the open bins hold.
WINDOW_TOKENS = OPEN_BINS * CAPACITY // 2
TOKENIZER = "byte_bpe_50k.json"

#: Fixed value: how the byte-level pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What both ways are compared on before the faster is used.
PROBE = ["", " a  b\n\n c\t", "It's 12,345 naïve — größer 日本語 🙂​", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "x=1;\r\n y <|endoftext|>", "ßéñ" * 40]


class BestFit:
    """Bins of one size; place() gives a bin and where in it the piece begins."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.bits = 0  # bit f: some open bin has f free
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        row = self.free[space]
        out = row.pop()
        if not row:
            self.bits ^= 1 << space
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        if fitting := self.bits >> length:
            space = length + (fitting & -fitting).bit_length() - 1
            at = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            at, space = self.made, self.capacity
            self.made += 1
        if left := space - length:
            self.free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - space


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if visible in Latin-1, else the next code point from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids by the tokenizer file; no special tokens are added, and their strings inside texts are what the library makes of them."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)

    def slow(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in exact.encode_batch(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        return slow
    import tiktoken

    chars, special = _byte_chars(), {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def fast(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            try:
                out.append(ranked.encode(text, allowed_special="all") if any(x in text for x in special) else ranked.encode_ordinary(text))
            except BaseException as e:
                # Its regex engine gives up on some very long runs, by a panic, which is no Exception; anything else is an error.
                if type(e).__name__ != "PanicException":
                    raise
                out += slow([text])
        return out

    probe = PROBE + [f"{a}{x}{b}" for x in special for a in ("", "a ", "b\n") for b in ("", " c", "d", x)]
    return fast if fast(probe) == slow(probe) else slow


def pieces_of(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of them full but the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pack_documents(
    docs: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = 0,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: keys, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    tokenizer is a file's path, or the name of a file of public_tokenizers, found on each worker.
    """
    own = [docs.schema[k] for k in keys]
    more = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    more += [("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own] + [T.StructField(n, t) for n, t in more])
    texts = F.coalesce(F.col(text_col), F.lit("")).alias("__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(tokenizer if "/" in tokenizer else str(public_tokenizers.path(tokenizer)))
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        heads: list[pa.RecordBatch] = []
        n_heads = tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, heads, n_heads, tokens
            order = sorted(range(len(held)), key=lambda i: -held[i][3])
            places: list[tuple[int, int]] = [(0, 0)] * len(held)
            for i in order:
                places[i] = fit.place(held[i][3])
            rows = pa.array([x[0] for x in held], pa.int64())
            top = pa.Table.from_batches(heads).take(rows).combine_chunks()
            cols = [pa.array([x[k] for x in held], pa.int32() if k == 1 else pa.int64()) for k in (1, 2, 3, 4)]
            cols += [pa.array([base + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            if with_ids:
                cols.append(pa.array([x[5] for x in held], pa.list_(pa.int32())))
            table = pa.Table.from_arrays([*top.columns, *cols], names=schema.names)
            held, heads, n_heads, tokens = [], [], 0, 0
            yield from table.to_batches(max_chunksize=20_000)

        for batch in batches:
            # Slices keep what is tokenized at once small, however long the texts are.
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                heads.append(pa.RecordBatch.from_arrays(part.columns[:-1], names=list(keys)))
                for j, text in enumerate(part.columns[-1].to_pylist()):
                    ids = np.array([*encode([text])[0], end_id], dtype="<u4")
                    for p, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                        piece = ids[s : s + n]
                        held.append((n_heads + j, p, s, n, zlib.crc32(piece.tobytes()), piece.astype(np.int32) if with_ids else None))
                    tokens += len(ids)
                n_heads += part.num_rows
                if tokens >= WINDOW_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    return small_batches(docs).select(*keys, texts).mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, in sequences of 2048 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
