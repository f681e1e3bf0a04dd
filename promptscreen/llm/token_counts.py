"""Token counts of texts, from counts of distinct pre-tokens.

A pre-token is a stretch that no piece of the vocabulary crosses the ends of, so a
text's tokens are those of its pre-tokens, and their number is the sum of theirs.
The pieces of each distinct pre-token are counted once in the whole corpus; each
document's frequencies of pre-tokens are joined to these counts and summed. No ids
of a text are ever made.

Three steps. The distinct pre-tokens with their frequencies (partial sums in each
task, then a shuffle by pre-token), and the pieces of each. Then the documents
again: what is among the COMMON most frequent pre-tokens is summed where the
document is, by a broadcast table of bounded rows and characters; so no pre-token
that many documents share is left to one task. The rest is sent as (row, pre-token,
frequency) and joined to the counts. Last the sums by row.

Where a text may be cut is told from the vocabulary itself: before a space that
follows something else, and around a line end, if no piece has either inside. A
vocabulary for which that is not so is refused.

Defined results. A null text is an empty one: 0 bytes, 0 tokens. A text of any
length is counted whole; one without spaces or line ends is one pre-token. Rows
that repeat, and null ids, are counted as rows of their own. An empty table gives
no rows. Columns not named are not read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

MODEL = "piece_bpe_32k.model"
#: Pre-tokens whose counts are broadcast, the most frequent first: so many at most, of so many characters together.
COMMON, COMMON_CHARS = 100_000, 8 << 20
#: A task sends its partial sums when it holds so many distinct pre-tokens, or has seen so many characters since.
HELD, SEEN = 500_000, 64 << 20

SPACE = "▁"
#: Spaces belong to what follows them; a line end is a pre-token of its own.
PRETOKEN = re.compile(r" *[^ \n]+|\n| +")


def pretokens(text: str) -> list[str]:
    """Pre-tokens of a text, in order; the model puts a space before the first."""
    if not text:
        return []
    return PRETOKEN.findall(" " + (text.replace(SPACE, " ") if SPACE in text else text))


@functools.cache
def piece_counter(path: str):
    """Function from a list of pre-tokens to their numbers of pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    probe = "  a\n\n b \tc  é"
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) or "".join(model.encode(probe, out_type=str)).replace("<0x0A>", "\n").replace("<0x09>", "\t") != SPACE + probe.replace(" ", SPACE):
        raise ValueError(f"{path}: texts cannot be cut at spaces and line ends")

    def counts(tokens: list[str]) -> list[int]:
        # The line end keeps the space that the model puts first away from the pre-token: two pieces come before it.
        return [len(ids) - 2 for ids in model.encode(["\n" + t for t in tokens], num_threads=1)]

    return counts


def model_path(model: str) -> str:
    """A file's path as it is; else the place of a file of public_tokenizers, looked up on each worker."""
    import public_tokenizers

    return model if "/" in model else str(public_tokenizers.path(model))


def vocabulary(docs: DataFrame, text_col: str, model: str) -> DataFrame:
    """pretoken, uses (how often it comes in all texts), pieces; each pre-token once."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            table = pa.table({"pretoken": pa.array(list(held), pa.string()), "uses": pa.array(held.values(), pa.int64())})
            held.clear()
            seen = 0
            yield from table.to_batches(max_chunksize=20_000)

        for b in batches:
            for value in b.column(0):
                text = value.as_py()
                held.update(pretokens(text))
                seen += len(text)
                if len(held) >= HELD or seen >= SEEN:
                    yield from flush()
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counter(model_path(model))
        for b in batches:
            tokens = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts(tokens), pa.int64())], names=["pretoken", "uses", "pieces"])

    texts = small_batches(docs).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = texts.mapInArrow(tally, "pretoken string, uses long").groupBy("pretoken").agg(F.sum("uses").alias("uses"))
    return distinct.mapInArrow(count, "pretoken string, uses long, pieces long")


def common_counts(vocab: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, within most and COMMON_CHARS; the threshold is told from sums by class of frequency."""
    # Classes of frequency 5 % apart: some hundred rows whatever the table.
    level = F.floor(F.log("uses") * 20).cast("int")
    by_level = vocab.groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("pretoken")).alias("chars")).collect()
    least, rows, chars = None, most, COMMON_CHARS
    for r in sorted(by_level, reverse=True):
        rows, chars = rows - r.n, chars - r.chars
        if rows < 0 or chars < 0:
            break
        least = r.k
    if least is None:
        return {}
    return {r.pretoken: r.pieces for r in vocab.where(level >= least).select("pretoken", "pieces").collect()}


def count_tokens(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", model: str = MODEL, common: int = COMMON) -> DataFrame:
    """keys, n_bytes and n_tokens of each row. model is a sentencepiece file's path, or the name of a file of public_tokenizers."""
    spark = docs.sparkSession
    vocab = materialize(vocabulary(docs, text_col, model), "pretokens")
    known = spark.sparkContext.broadcast(common_counts(vocab, common))
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, base, n = known.value, TaskContext.get().partitionId() << 33, 0
        for b in batches:
            rows, sizes, sums, tokens, uses, lengths = [], [], [], [], [], [0]
            for value in b.column(b.num_columns - 1):
                text = value.as_py()
                total = 0
                for t, k in Counter(pretokens(text)).items():
                    if (c := count.get(t)) is not None:
                        total += c * k
                    else:
                        tokens.append(t)
                        uses.append(k)
                lengths.append(len(tokens))
                rows.append(base + n)
                sizes.append(value.as_buffer().size if value.is_valid else 0)
                sums.append(total)
                n += 1
            rest = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(uses, pa.int64())], names=["pretoken", "uses"]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), rest], names=[*keys, "__row", "n_bytes", "__sum", "__rest"])

    texts = small_batches(docs).select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    known_rows = materialize(texts.mapInArrow(frequencies, f"{kinds}, __row long, n_bytes long, __sum long, __rest array<struct<pretoken: string, uses: long>>"), "frequencies")
    rare = known_rows.select("__row", F.explode("__rest").alias("r")).select("__row", "r.pretoken", "r.uses")
    # Each text's rare pre-tokens meet their counts; what comes back is one row for each document that has any.
    sums = rare.join(vocab.select("pretoken", "pieces"), "pretoken").groupBy("__row").agg(F.sum(F.col("uses") * F.col("pieces")).alias("__more"))
    out = known_rows.drop("__rest").join(sums, "__row", "left")
    return out.select(*keys, "n_bytes", (F.col("__sum") + F.coalesce("__more", F.lit(0))).alias("n_tokens"))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents; over_limit: more than 4096 tokens."""
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
