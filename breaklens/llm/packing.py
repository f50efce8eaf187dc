"""Vector bin packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breaklens.llm.tokens import encoding
from breaklens.llm.words import small_batches
from breaklens.session import ship_package

#: Open items among which a sequence's next piece is chosen.
WINDOW = 4096


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, pieces of documents, tokens that bear loss."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class Packer:
    """Packs items of one task; memory is bounded by the window.

    An item is what is left of a document: (key, start, ids, mask). Items are
    vectors (tokens, one segment, loss tokens) in units of the limits. A
    sequence takes, again and again, the fitting item with the largest dot
    product with the room left, weighted by the items' mean demand in each
    dimension. When none fits, the longest item is cut to fill the room. A
    sequence that a limit closes early, and the last ones, are cut back to a
    power of two tokens, a length that needs no padding.
    """

    def __init__(self, limits: Limits, window: int = WINDOW) -> None:
        self.limits, self.window = limits, window
        self.items: list[list | None] = []
        self.tokens = self.loss = np.zeros(0, np.int64)
        self.total = self.open = 0
        self.sequences = 0

    def _load(self, items: list) -> None:
        self.items = items
        self.tokens = np.array([len(i[2]) for i in items], np.int64)
        self.loss = np.array([int(i[3].sum()) if i[3] is not None else len(i[2]) for i in items], np.int64)
        self.total, self.open = int(self.tokens.sum()), len(items)

    def add(self, key, start: int, ids: np.ndarray, mask: np.ndarray | None):
        """Finished pieces, if the window got full."""
        self.items.append([key, start, ids, mask])
        if len(self.items) >= self.window:
            yield from self.flush(self.window // 2)

    def flush(self, keep: int = 0):
        """Packs while more than ``keep`` items are open (0: everything)."""
        self._load([i for i in self.items if i is not None])
        while self.open > keep:
            yield from self._sequence(min(self.limits.tokens, 1 << (self.total.bit_length() - 1))
                                      if self.total < self.limits.tokens else self.limits.tokens)
        self.items = [i for i in self.items if i is not None]

    def _take(self, i: int, n: int) -> tuple:
        key, start, ids, mask = self.items[i]
        piece = (key, start, ids[:n], None if mask is None else mask[:n])
        if n == len(ids):
            self.items[i] = None
            self.open -= 1
        else:
            self.items[i] = [key, start + n, ids[n:], None if mask is None else mask[n:]]
        bears = n if mask is None else int(piece[3].sum())
        self.tokens[i] -= n
        self.loss[i] -= bears
        self.total -= n
        return piece, bears

    def _give_back(self, piece: tuple, n: int) -> tuple:
        """Cut ``n`` tokens off a piece's end; they become an open item again."""
        key, start, ids, mask = piece
        at = len(ids) - n
        rest = [key, start + at, ids[at:], None if mask is None else mask[at:]]
        self.items.append(rest)
        self.tokens = np.append(self.tokens, n)
        self.loss = np.append(self.loss, n if mask is None else int(rest[3].sum()))
        self.total += n
        self.open += 1
        return key, start, ids[:at], None if mask is None else mask[:at]

    def _sequence(self, tokens: int):
        lim = self.limits
        room_t, room_s, room_l = tokens, lim.segments, lim.loss
        open_ = self.tokens > 0
        demand = np.array([self.tokens[open_].mean() / lim.tokens, 1 / lim.segments, self.loss[open_].mean() / lim.loss])
        pieces = []
        while room_t and room_s:
            fits = np.flatnonzero((self.tokens > 0) & (self.tokens <= room_t) & (self.loss <= room_l))
            if len(fits):
                room = demand * [room_t / lim.tokens, room_s / lim.segments, room_l / lim.loss]
                gain = (self.tokens[fits] * (room[0] / lim.tokens) + room[1] / lim.segments
                        + self.loss[fits] * (room[2] / lim.loss))
                i = int(fits[gain.argmax()])
                n = int(self.tokens[i])
            else:
                i = int(self.tokens.argmax())
                n = min(room_t, int(self.tokens[i]))
                mask = self.items[i][3]
                if mask is None:
                    n = min(n, room_l)
                else:
                    n = min(n, int(np.searchsorted(np.cumsum(mask[:n]), room_l, "right")))
                if not n:
                    break
            piece, bears = self._take(i, n)
            pieces.append(piece)
            room_t, room_s, room_l = room_t - n, room_s - 1, room_l - bears
        used = tokens - room_t
        extra = used - (1 << (used.bit_length() - 1)) if used < lim.tokens else 0
        while extra:
            last = pieces.pop()
            n = min(extra, len(last[2]))
            last = self._give_back(last, n)
            extra -= n
            if len(last[2]):
                pieces.append(last)
        at = 0
        for piece in pieces:
            yield *piece, self.sequences, at
            at += len(piece[2])
        self.sequences += 1

    def whole(self, key, start: int, ids: np.ndarray, mask: np.ndarray | None):
        """A full sequence out of one long document."""
        yield key, start, ids, mask, self.sequences, 0
        self.sequences += 1


_FIELDS = ("start bigint, length bigint, ids binary, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, "
           "offset bigint")


def _packing(limits: Limits, window: int):
    """The function of a task that packs batches of (id, ids) or (id, ids, loss)."""
    names = ["id", *(f.split()[0] for f in _FIELDS.split(", "))]

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        packer = Packer(limits, window)
        kinds, out = None, []

        def batch_of(found):
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def row(piece):
            (key, total), start, ids, mask, sequence, at = piece
            return (key, start, len(ids), ids.tobytes(), total, len(ids) if mask is None else int(mask.sum()),
                    first + sequence, at)

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            masks = batch.column(2) if batch.num_columns > 2 else pa.nulls(batch.num_rows, pa.binary())
            for key, ids, mask in zip(batch.column(0), batch.column(1), masks, strict=True):
                data = ids.as_buffer() if ids.is_valid else None
                if data is None or not data.size:
                    continue
                ids = np.frombuffer(data, "<u4")
                mask = np.frombuffer(mask.as_buffer(), np.uint8) if mask.is_valid else None
                own, at = (key.as_py(), len(ids)), 0
                while len(ids) - at >= limits.tokens and (
                        limits.tokens if mask is None else int(mask[at:at + limits.tokens].sum())) <= limits.loss:
                    end = at + limits.tokens
                    out += map(row, packer.whole(own, at, ids[at:end], None if mask is None else mask[at:end]))
                    at = end
                if at < len(ids):
                    # copied, for what stays open shall not hold its whole batch
                    out += map(row, packer.add(own, at, ids[at:].copy(), None if mask is None else mask[at:].copy()))
                if len(out) >= 2048:
                    yield batch_of(out)
                    out = []
        out += map(row, packer.flush())
        for i in range(0, len(out), 2048):
            yield batch_of(out[i:i + 2048])

    return run


def pack(rows: DataFrame, id_col: str, ids_col: str = "ids", loss_col: str | None = None,
         limits: Limits = Limits(), window: int = WINDOW) -> DataFrame:
    """Pieces of sequences: ``id_col``, start, length, ids, doc_tokens, loss_tokens,
    sequence_id, offset.

    ``ids_col`` is binary (little-endian unsigned 32-bit ids); ``loss_col``, if
    given, binary with one byte 0 or 1 per id, else every id bears loss. Each
    id of each row lies in exactly one piece; a sequence keeps all ``limits``
    at once. Rows are packed within their partition, in one pass and without a
    shuffle, among ``window`` open rows. A sequence has the limit's tokens or,
    at a partition's end or where segments or loss run out, a power of two.
    sequence_id is the partition's number times 2**40 plus a count: unique, and
    the same when a task runs again over the same input.

    A row longer than a sequence fills whole ones first (where its loss allows
    it); null ids are no ids and give no piece. Repeated rows and null keys are
    packed like any other; other columns are not looked at.
    """
    ship_package(rows.sparkSession)
    cols = [F.col(id_col).alias("id"), F.col(ids_col).alias("ids")]
    if loss_col:
        cols.append(F.col(loss_col).alias("loss"))
    kind = rows.schema[id_col].dataType.simpleString()
    return (rows.select(*cols).mapInArrow(_packing(limits, window), f"id {kind}, {_FIELDS}")
            .withColumnRenamed("id", id_col))


def pack_texts(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
               limits: Limits = Limits(), window: int = WINDOW) -> DataFrame:
    """:func:`pack` over the tokens of whole texts, encoded in the same task: ids don't
    travel between processes. A null text is ``end_id`` alone; every id bears loss."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    encode, run = encoding(tokenizer_path, end_id), _packing(limits, window)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(lambda batches: run(encode(batches)), f"id {kind}, {_FIELDS}").withColumnRenamed("id", id_col))
