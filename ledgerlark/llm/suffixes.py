"""Removal of repeated byte strings by a sparse suffix array with bucket-pointer refinement.

A byte of a text goes if a string of ``LENGTH`` bytes that covers it also starts in a row with a smaller doc_id.

Suffixes are not kept for every byte but at anchors: of each string of ``LENGTH`` bytes the q-gram with the smallest
hash, the leftmost of equals, is its anchor. Equal strings have equal anchors at equal offsets, so it is enough to sort
anchors. An anchor owns a run of neighbouring strings. Its bucket is refined step by step, each step sorting on the
identifiers of buckets at later offsets, which are built from the q-gram identifiers of the first step again:

1. ``gram``: anchors by q-gram. A bucket with anchors of one block of texts and one doc_id drops out.
2. ``run``: what is left by all bytes that the anchor's strings cover. Every row but the one with the smallest doc_id of
   a bucket loses the whole run.
3. ``mixed``: of these smallest rows, only q-gram buckets that still hold different runs stay open.
4. ``piece``: open runs are cut where the offset of the anchor is a multiple of ``PIECE``. Pieces are refined like runs;
   with them ``core``, what all strings of a piece have in common: only cores with different pieces stay open.
5. ``string``: their single strings; rows lose those that a row with a smaller doc_id has.

The row with the smallest doc_id of all that have a string stays open in every step, so the last one knows it.

Texts are dealt into blocks. In each step a block sends every range of identifiers the distinct ones that it has, packed
into a binary row with the smallest doc_id for each; a range sorts what all blocks sent and answers each block with a
bit for each identifier. A string in very many rows therefore costs an identifier a block, no step moves all suffixes,
and no task holds more than a block or a range. Identifiers of runs and strings have 128 bits, those of q-grams, which
only choose what is compared, have 64.

Defined results: null and empty texts have no bytes; rows with equal doc_id, or equal in everything, don't remove each
other's bytes, nor do repeats within a row; a null doc_id counts as greater than all others. Only ``doc_id`` and
``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch

U = np.uint64
LENGTH, GRAM, PIECE = 50, 16, 8
BLOCK_BYTES = (4_000_000, 64_000_000)
STEPS = (("gram",), ("run",), ("mixed",), ("piece", "core"), ("string",))
_SPAN, _LAST = 1 << 18, np.iinfo(np.int64).max
_SALT = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_ASKED = "kind string, block long, part int, high binary, low binary, least binary, most binary"
_BITS = "kind string, block long, bits binary, part int"


class Block:
    """The anchors of some texts, and what the steps have found out about them so far."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, length: int):
        data, self.at = tokens.buffers(texts)
        self.n, self.length, self.ids = len(data), length, ids
        self.data = np.concatenate((data, np.zeros(GRAM, np.uint8)))
        self.long = np.ndarray(self.n + GRAM - 7, "<u8", self.data, strides=(1,))
        self._anchors()

    def gram(self, at: np.ndarray | slice, salt: int = 0, plus: int = GRAM // 2) -> np.ndarray:
        """Identifiers of the q-grams that start at ``at``."""
        late = slice(at.start + plus, at.stop + plus) if isinstance(at, slice) else at + plus
        x, y = self.long[at].astype(np.uint64) * _SALT[salt], self.long[late].astype(np.uint64) * _SALT[1 - salt]
        x ^= y >> U(29) | y << U(35)
        return tokens.mix(x)

    def _anchors(self) -> None:
        """place, first, last: each anchor and the first and last string that it owns."""
        width, found, none = self.length - GRAM + 1, [], np.uint32(2**32 - 1)
        for lo in range(0, self.n - self.length + 1, _SPAN):
            hi = min(lo + _SPAN, self.n - self.length + 1)
            m = hi - lo + width - 1
            low = self.gram(slice(lo, lo + m)) >> U(32) << U(32) | np.arange(m, dtype=np.uint64)
            reach = 1
            while 2 * reach <= width:
                low = np.minimum(low[:-reach], low[reach:])
                reach *= 2
            low = np.minimum(low[: hi - lo], low[width - reach : width - reach + hi - lo])
            owner = low.astype(np.uint32)
            a, b = np.searchsorted(self.at, lo, "right"), np.searchsorted(self.at, hi + self.length, "left") + 1
            end = self.at[a:b]
            across = _ranges(np.clip(np.maximum(self.at[a - 1 : a - 1 + len(end)], end - self.length + 1), lo, hi), np.clip(end, lo, hi) - 1)
            owner[across - lo] = none  # strings that would cross the end of a text
            new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            last = np.append(new[1:], hi - lo) - 1
            own = owner[new] != none
            found.append(np.stack((owner[new[own]].astype(np.int64), new[own], last[own])) + lo)
        every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        new = np.flatnonzero(np.concatenate(([True], every[0, 1:] != every[0, :-1]))) if every.shape[1] else np.zeros(0, np.int64)
        self.place, self.first = every[0, new], every[1, new]
        self.last = every[2, np.append(new[1:], every.shape[1]) - 1] if len(new) else new
        self.key = tokens.mix(self.gram(self.place) + _SALT[1])  # anchors have small hashes: spread them over the ranges
        self.owner = self.ids[np.searchsorted(self.at, self.place, "right") - 1] if len(new) else new

    def string_ids(self, start: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Two words for each string of ``size`` bytes at ``start`` with its anchor at ``offset``."""
        out = np.empty((len(start), 2), np.uint64)
        shape = (size.astype(np.uint64) << U(32)) + offset.astype(np.uint64)
        for salt in (0, 1):
            x = tokens.mix(shape + _SALT[salt])
            for step in range(0, int(size.max(initial=0)), GRAM):
                x = tokens.mix(x * _SALT[1 - salt] + self.gram(start + np.minimum(step, size - GRAM), salt))
            out[:, salt] = x
        return out

    def advance(self, answers: dict[str, np.ndarray]) -> dict[str, dict]:
        """What to ask in the first step without answer, by kind; nothing after the last. Afterwards ``starts`` has the strings that go."""
        self.keys, inverse = np.unique(self.key, return_inverse=True)
        if "gram" not in answers:
            return {"gram": {"high": self.keys}}
        low, high = _extremes(inverse, self.owner, len(self.keys))
        open_ = np.flatnonzero((answers["gram"] | (low != high))[inverse])
        place, first, last, owner, inverse = (x[open_] for x in (self.place, self.first, self.last, self.owner, inverse))
        ids, run = _unique_pairs(self.string_ids(first, last - first + self.length, place - first))
        least, _ = _extremes(run, owner, len(ids))
        if "run" not in answers:
            return {"run": {"high": ids[:, 0], "low": ids[:, 1], "least": least}}
        gone = answers["run"][run] | (owner > least[run])
        self.starts = [_ranges(first[gone], last[gone])]
        kept = np.flatnonzero(~gone)
        bucket, inverse = np.unique(inverse[kept], return_inverse=True)
        small, large = _extremes(inverse, ids[run[kept], 0].view(np.int64), len(bucket))
        if "mixed" not in answers:
            return {"mixed": {"high": self.keys[bucket], "least": small, "most": large}}
        open_ = kept[(answers["mixed"] | (small != large))[inverse]]
        near, far = place[open_] - last[open_], place[open_] - first[open_]
        piece = _ranges(near // PIECE, far // PIECE) * PIECE
        times = far // PIECE - near // PIECE + 1
        place, owner = np.repeat(place[open_], times), np.repeat(owner[open_], times)
        first = place - np.minimum(np.repeat(far, times), piece + PIECE - 1)
        last = place - np.maximum(np.repeat(near, times), piece)
        ids, run = _unique_pairs(self.string_ids(first, last - first + self.length, place - first))
        least, _ = _extremes(run, owner, len(ids))
        size = np.full(len(place), self.length - PIECE + 1)
        core, inverse = np.unique(self.string_ids(place - piece, size, piece)[:, 0], return_inverse=True)
        small, large = _extremes(inverse, ids[run, 0].view(np.int64), len(core))
        if "piece" not in answers:
            return {"piece": {"high": ids[:, 0], "low": ids[:, 1], "least": least}, "core": {"high": core, "least": small, "most": large}}
        gone = answers["piece"][run] | (owner > least[run])
        self.starts.append(_ranges(first[gone], last[gone]))
        open_ = np.flatnonzero(~gone & (answers["core"] | (small != large))[inverse])
        start, times = _ranges(first[open_], last[open_]), last[open_] - first[open_] + 1
        ids, run = _unique_pairs(self.string_ids(start, np.full(len(start), self.length), np.repeat(place[open_], times) - start))
        owner = np.repeat(owner[open_], times)
        least, _ = _extremes(run, owner, len(ids))
        if "string" not in answers:
            return {"string": {"high": ids[:, 0], "low": ids[:, 1], "least": least}}
        self.starts.append(start[answers["string"][run] | (owner > least[run])])
        return {}

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the maximal runs of bytes that go, within their texts, in order."""
        start = np.sort(np.concatenate(self.starts))
        row = np.searchsorted(self.at, start, "right")
        new = np.concatenate(([True], (start[1:] - start[:-1] > self.length) | (row[1:] != row[:-1]))) if len(start) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return start[first], start[np.append(first[1:], len(start)) - 1] + self.length if len(first) else start


def _extremes(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, _LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group, value)
    np.maximum.at(high, group, value)
    return low, high


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers from each first to its last."""
    times = last - first + 1
    return np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)


def _unique_pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct rows, index of each row in them)."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    own = ids[order]
    new = np.concatenate(([True], (own[1:] != own[:-1]).any(axis=1))) if len(own) else np.zeros(0, bool)
    inverse = np.empty(len(own), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return own[new], inverse


def _packed(block: int, asked: dict[str, dict], bits: int) -> Iterator[dict]:
    """A row for each kind and range of identifiers that a block asks about."""
    for kind, ask in asked.items():
        part = (ask["high"] >> U(64 - bits)).astype(np.int64)
        cut = np.searchsorted(part, np.arange((1 << bits) + 1))
        for p in np.flatnonzero(np.diff(cut)):
            own = slice(cut[p], cut[p + 1])
            yield {"kind": kind, "block": block, "part": int(p)} | {c: ask[c][own].tobytes() for c in ("high", "low", "least", "most") if c in ask}


def _answer(table: pa.Table) -> pa.Table:
    """For each row of a range a bit for each identifier: whether another block has it too, with a smaller value, or with another."""
    kind = table.column("kind")[0].as_py()

    def words(name: str, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)

    sizes = np.array([len(x) // 8 for x in table.column("high").to_pylist()])
    ids = np.zeros((sizes.sum(), 2), np.uint64)
    ids[:, 0] = words("high", np.uint64)
    if kind in ("run", "piece", "string"):
        ids[:, 1] = words("low", np.uint64)
    unique, group = _unique_pairs(ids)
    if kind == "gram":
        yes = np.bincount(group, minlength=len(unique))[group] > 1
    else:
        least = words("least", np.int64)
        small, large = _extremes(group, least, len(unique))
        if kind in ("mixed", "core"):
            large = np.maximum(large, _extremes(group, words("most", np.int64), len(unique))[1])
            yes = (small != large)[group]
        else:
            yes = small[group] < least
    end = np.cumsum(sizes)
    bits = [np.packbits(yes[a:b]).tobytes() + int(b - a).to_bytes(8, "little") for a, b in zip(end - sizes, end, strict=True)]
    return pa.table({"kind": table.column("kind"), "block": table.column("block"), "bits": pa.array(bits, pa.binary()), "part": table.column("part")})


def _answers(table: pa.Table) -> dict[str, np.ndarray]:
    """The bits of each kind in the order of the block's identifiers; a kind that asked nothing has none."""
    rows = sorted(zip(table.column("kind").to_pylist(), table.column("part").to_pylist(), table.column("bits").to_pylist(), strict=True), key=lambda r: r[:2])
    out = {k: [np.zeros(0, bool)] for step in STEPS for k in step}
    for kind, _, bits in rows:
        out[kind].append(np.unpackbits(np.frombuffer(bits[:-8], np.uint8), count=int.from_bytes(bits[-8:], "little")).astype(bool))
    return {k: np.concatenate(v) for k, v in out.items()}


def _block(table: pa.Table, length: int) -> tuple[Block, pa.Table]:
    table = table.sort_by("seq").combine_chunks()
    ids = table.column("doc_id").fill_null(_LAST).to_numpy()
    return Block(table.column("text").combine_chunks(), ids, length), table


def repeated_spans(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes: what goes), kept (binary: all other bytes) for every row of ``docs``.

    ``length`` of at least 24 bytes. Blocks hold about ``block_bytes`` of texts, and at least one text; by default their
    size grows with the square root of the corpus within ``BLOCK_BYTES``, so that the rows that blocks send to ranges
    stay large. A range gets the identifiers of about four blocks' bytes.
    """
    if length < GRAM + PIECE:
        raise ValueError(f"length must be {GRAM + PIECE} at least")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = block_bytes or int(np.clip(136 * total**0.5, *BLOCK_BYTES))
    bits = int(np.ceil(np.log2(max(4, total / (4 * block_bytes)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled, seq = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            size = np.diff(tokens.buffers(batch.column("text"))[1])
            numbers = np.empty(batch.num_rows, np.int64)
            for i, own in enumerate(size.tolist()):
                if filled and filled + own > block_bytes:
                    block, filled = block + 1, 0
                filled += own + 16
                numbers[i] = block
            order = np.arange(seq, seq + batch.num_rows)
            seq += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(order), batch.column("doc_id"), batch.column("text")], ["block", "seq", "doc_id", "text"])

    shape = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("high", "low", "least", "most"))])

    def ask(step: int):
        known = [k for kinds in STEPS[:step] for k in kinds]

        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            own, table = _block(table, length)
            every = _answers(answers)
            asked = own.advance({k: every[k] for k in known})
            return pa.Table.from_pylist(list(_packed(table.column("block")[0].as_py(), asked, bits)), shape)

        return run

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own, table = _block(table, length)
        own.advance(_answers(answers))
        first, end = own.spans()
        gone = np.zeros(own.n + 1, np.int8)
        np.add.at(gone, first, 1)
        np.add.at(gone, end, -1)
        keep = np.cumsum(gone[:-1], dtype=np.int8) == 0
        kept, upto = own.data[: own.n][keep], np.concatenate(([0], np.cumsum(keep)))[own.at]
        row = np.searchsorted(own.at, first, "right") - 1
        pairs = pa.StructArray.from_arrays([pa.array(first - own.at[row]), pa.array(end - own.at[row])], ["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(own.at))), pa.int32()), pairs)
        left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own.at) - 1, [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(kept)])
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(own.at)), "spans": spans, "kept": left.cast(pa.binary())})

    dealt = scratch.save(rows.mapInArrow(deal, "block long, seq long, doc_id long, text string"), "dealt")
    given = docs.sparkSession.createDataFrame([], _BITS)
    for step in range(len(STEPS)):
        asked = dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(ask(step), _ASKED)
        bit = scratch.save(asked.groupBy("kind", "part").applyInArrow(_answer, _BITS), f"bits{step}")
        given = given.unionAll(bit) if step else bit
    return dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
