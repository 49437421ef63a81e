"""Sum-of-squares packing of documents into sequences of at most CAPACITY tokens.

Documents are encoded where they lie.  Only those longer than a sequence are cut: the first
piece takes what is left over, the others fill a sequence each.  The shorter pieces, as rows
of (row, length), are dealt over shards by a hash of their row; within a shard each piece goes
where the sum over gaps of (number of open sequences with this gap) squared becomes smallest,
either onto an open sequence or as a new one.  That keeps all gaps equally common, so that a
fitting one is there for whatever comes next, and wastes less the more pieces a shard has.

What a shard leaves open at its end is about a twentieth of its sequences.  These are taken
apart again; their pieces meet those of other shards in a second round, longest first, which
opens a new sequence only where no open one has room.

A shard has SHARD pieces on average, so tasks stay equal however much data there is, and no
task sees all lengths.  Sequence numbers are row numbers of pieces (each sequence's first
placed one), so they need no counter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written
from .tokens import byte_bpe

CAPACITY, SHARD, SEED = 1024, 50_000, 42
#: Bytes of token ids of one batch between Python and Spark.
BATCH_BYTES = 1 << 24


def token_pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids) of each row of `docs`; ids: little-endian unsigned 32-bit numbers.

    A document's tokens are those of the tokenizer file, then `end`.  A null or empty text has
    the token `end` alone.  A longer document than `capacity` has pieces of `capacity` tokens,
    the first one shorter if they don't divide; `start` counts its tokens before the piece.
    Repeated rows have pieces of their own; null ids stay null.
    """
    out = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            column, of, rows, held = batch.column(1), [], [], 0
            for i in range(batch.num_rows):
                ids = np.append(bpe.encode(column[i].as_py() or ""), np.uint32(end)).astype("<u4", copy=False)
                first = len(ids) % capacity or min(len(ids), capacity)
                starts = [0, *range(first, len(ids), capacity)]
                of += [i] * len(starts)
                rows += [(k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
                held += ids.nbytes
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names=out.names)
                    of, rows, held = [], [], 0

    found = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(cut, out)
    return found.withColumnRenamed("id", id)


class OpenBins:
    """Open sequences by level (tokens held); a level's newest sequence is taken first."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.open = capacity, np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity)]

    def place(self, length: int, number: int, spare: bool) -> tuple[int, int]:
        """(sequence, offset) for a piece; a new sequence gets `number`.  With `spare` only where no open one has room.

        From level h to h + length the sum of squares changes by 2 * (count[h + length] - count[h]) + 2;
        filling a sequence up takes 2 * count[h] - 1 away, a new one adds 2 * count[length] + 1.
        Of equal changes the fullest sequence is taken.
        """
        top = self.capacity - length
        change = 2 * (self.count[length:] - self.count[: top + 1]) + 2
        change[top] = 1 - 2 * self.count[top]
        change[self.count[: top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = np.iinfo(np.int64).max - 1 if spare else 2 * self.count[length] + 1
        level = top - int(change[::-1].argmin())
        if level:
            self.count[level] -= 1
            number = self.open[level].pop()
        if level + length < self.capacity:
            self.count[level + length] += 1
            self.open[level + length].append(number)
        return number, level


def pack_shard(rows: np.ndarray, lengths: np.ndarray, capacity: int, spare: bool, seed: int) -> pd.DataFrame:
    """(row, length, sequence, offset, open) of one shard's pieces, all shorter than `capacity`.

    In a random order that rows and seed fix, or longest first with `spare`.
    """
    order = np.argsort(rows, kind="stable")
    order = order[np.argsort(-lengths[order], kind="stable")] if spare else order[np.random.default_rng(seed).permutation(len(order))]
    rows, lengths = rows[order], lengths[order]
    bins = OpenBins(capacity)
    placed = np.array([bins.place(length, row, spare) for row, length in zip(rows.tolist(), lengths.tolist(), strict=True)], np.int64).reshape(-1, 2)
    left = np.array([n for level in bins.open for n in level], np.int64)
    return pd.DataFrame({"row": rows, "length": lengths, "sequence": placed[:, 0], "offset": placed[:, 1], "open": np.isin(placed[:, 0], left)})


PLACED = "row long, length long, sequence long, offset long, open boolean"


def _round(short: DataFrame, capacity: int, spare: bool, shard: int, seed: int) -> DataFrame:
    """One round over rows (row, length), dealt over as many shards as their number asks for."""
    shards = max(1, -(-short.count() // shard))
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(shards)))
    pack = lambda key, part: pack_shard(part["row"].to_numpy(), part["length"].to_numpy(), capacity, spare, seed + int(key[0]))
    return written(dealt.groupBy("shard").applyInPandas(pack, PLACED), "packed")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """`pieces` with columns sequence_id and offset (lengthened while the names are taken).

    Offsets are gapless from 0 within a sequence, none of which holds more than `capacity`.
    Lengths from 1 to `capacity`; anything else raises.  Pieces of equal length, repeated rows
    too, are placed one by one.  No piece: no row.
    """
    row, of, by, at, sequence, offset = (free_name(pieces, x) for x in ("piece_row", "placed_row", "placed_sequence", "placed_at", "sequence_id", "offset"))
    # written: the number has to be the same wherever it is read
    numbered = written(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    size = F.col(f"`{length}`").cast("long")
    wrong = size.isNull() | (size < 1) | (size > capacity)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("a piece's length must lie between 1 and the capacity: "), F.coalesce(size.cast("string"), F.lit("null")))).cast("long")).otherwise(size)
    short = numbered.select(F.col(row).alias("row"), checked.alias("length")).filter(F.col("length") < capacity)
    first = _round(short, capacity, False, shard, seed)
    second = _round(first.filter("open").select("row", "length"), capacity, True, shard, seed + 1)
    placed = first.filter("not open").unionByName(second).select("row", "sequence", "offset").toDF(of, by, at)
    # full pieces are sequences of their own
    met = numbered.join(placed, F.col(row) == F.col(of), "left")
    kept = [F.col(f"`{c}`") for c in pieces.columns]
    return met.select(*kept, F.coalesce(by, row).alias(sequence), F.coalesce(at, F.lit(0)).cast("long").alias(offset))


def sequences(packed: DataFrame, sequence: str = "sequence_id", offset: str = "offset", ids: str = "ids") -> DataFrame:
    """(sequence_id, length, ids, parts) of packed pieces with their token ids; parts: lengths in order, for masks between documents."""
    at = F.sort_array(F.collect_list(F.struct(F.col(f"`{offset}`").alias("offset"), F.col(f"`{ids}`").alias("ids"))))
    held = packed.groupBy(F.col(f"`{sequence}`").alias("sequence_id")).agg(at.alias("held"))
    # binary arrays have no join of their own: hex digits, and back
    whole = F.unhex(F.array_join(F.transform("held", lambda x: F.hex(x["ids"])), ""))
    parts = F.transform("held", lambda x: (F.length(x["ids"]) / 4).cast("long"))
    return held.select("sequence_id", whole.alias("ids"), parts.alias("parts")).select("sequence_id", (F.length("ids") / 4).cast("long").alias("length"), "ids", "parts")
