"""Bounded-space online packing of token sequences.

Each task keeps at most ``open_windows`` windows. A document is tokenised, ended by id 0 and cut into whole
windows; what remains goes to the open window that it fits best. When it fits none and no further window may
be opened, the fullest window is topped up with the head of the remainder and emitted. What is left open at
the end of a task is merged: first within the task, which leaves at most one partial window, then across
tasks in groups of bounded size. The last remainder is cut into sequences whose lengths are powers of two,
so no padding is needed anywhere but in a window closed with a gap of up to ``max_gap`` ids.

Null and empty texts hold id 0 only. Rows with the same doc_id, and null doc_ids, are packed as documents of
their own. An empty table gives no pieces. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, slices, written

WINDOW = 1024
MERGE_GROUP = 1024
_AMBIGUOUS_SPACE = re.compile(r"\s (?!\S)")
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids")
_ARROW = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in _FIELDS])


class Encoder:
    """Ids of texts as little-endian uint32 bytes, equal to those of the ``tokenizers`` file at ``path``.

    A byte-level BPE file never merges across a space that is followed by a non-space, so a text is cut there
    and the ids of each part are kept in a bounded table. Parts not yet known are encoded with the file's own
    vocabulary as merge ranks. Texts in which a space stands inside a longer run of white space are encoded
    whole. Texts that hold an added token of the file, such as <|endoftext|>, and files of another kind are left to
    ``tokenizers``, called as it comes: an added token spelt out in a text gets its own id.
    """

    def __init__(self, path: str, max_parts: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.max_parts, self.parts = path, max_parts, _Parts(self)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = self._by_ranks(spec)
        self.cut = ranks is not None
        self._encode = ranks or self.plain

    @cached_property
    def _tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _by_ranks(self, spec: dict) -> Callable[[str], list[int]] | None:
        import public_tokenizers
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def direct(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return np.array(self.plain(text), "<u4").tobytes()
        if not self.cut or _AMBIGUOUS_SPACE.search(text):
            return self.direct(text)
        first, *rest = text.split(" ")
        if len(self.parts) > self.max_parts:
            self.parts.clear()
        return (self.direct(first) if first else b"") + b"".join(map(self.parts.__getitem__, rest))


class _Parts(dict):
    """Ids of ' ' + part, by part."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        ids = self.encoder.direct(" " + part)
        if len(part) < 64:
            self[part] = ids
        return ids


class Packer:
    """Packs items (doc_id, start, ids as bytes, doc_tokens) online; ``rows`` gathers finished pieces."""

    def __init__(self, part: int, first_sequence: int, window: int, open_windows: int, max_gap: int, keep_ids: bool):
        self.part, self.next, self.window, self.limit, self.max_gap, self.keep_ids = part, first_sequence, window, open_windows, max_gap, keep_ids
        self.open: dict[int, list] = {}
        self.gaps: list[tuple[int, int]] = []
        self.serial = 0
        self.rows: list[tuple] = []

    def emit(self, items: list) -> None:
        at = 0
        for doc, start, ids, total in items:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, self.part, ids if self.keep_ids else None))
            at += n
        self.next += 1

    def _put(self, slot: int, gap: int, item: tuple) -> None:
        self.open[slot].append(item)
        gap -= len(item[2]) // 4
        if gap:
            insort(self.gaps, (gap, slot))
        else:
            self.emit(self.open.pop(slot))

    def add(self, item: tuple) -> None:
        doc, start, ids, total = item
        n, step = len(ids) // 4, self.window
        whole = n // step * step
        for at in range(0, whole, step):
            self.emit([(doc, start + at, ids[4 * at : 4 * (at + step)], total)])
        start, ids, n = start + whole, ids[4 * whole :], n - whole
        while n:
            best = bisect_left(self.gaps, (n, -1))
            if best < len(self.gaps):
                gap, slot = self.gaps.pop(best)
                return self._put(slot, gap, (doc, start, ids, total))
            if len(self.gaps) < self.limit:
                self.serial += 1
                self.open[self.serial] = []
                return self._put(self.serial, step, (doc, start, ids, total))
            gap, slot = self.gaps.pop(0)
            if gap > self.max_gap:
                self._put(slot, gap, (doc, start, ids[: 4 * gap], total))
                start, ids, n = start + gap, ids[4 * gap :], n - gap
            else:
                self.emit(self.open.pop(slot))

    def leftovers(self) -> list[tuple]:
        """The items of all open windows, the fullest first."""
        items = [x for _, slot in self.gaps for x in self.open[slot]]
        self.open, self.gaps = {}, []
        return items


def merge(items: list[tuple], window: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Lay items end to end: the full windows, and the items of the last partial one."""
    full, held, room = [], [], window
    for doc, start, ids, total in items:
        while ids:
            n = min(room, len(ids) // 4)
            held.append((doc, start, ids[: 4 * n], total))
            start, ids, room = start + n, ids[4 * n :], room - n
            if not room:
                full.append(held)
                held, room = [], window
    return full, held


def _leftover_rows(items: list[tuple], part: int) -> list[tuple]:
    return [(doc, start, len(ids) // 4, zlib.crc32(ids), total, None, at, part, ids) for at, (doc, start, ids, total) in enumerate(items)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], t.type) for t in _ARROW], schema=_ARROW)


def _pack_tasks(path: str, window: int, open_windows: int, max_gap: int, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, packer = Encoder(path), Packer(part, part << 32, window, open_windows, max_gap, keep_ids)
        end = np.zeros(1, "<u4").tobytes()
        for batch in batches:
            for piece in slices(batch, "text"):
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    ids = (encode(text) if text else b"") + end
                    packer.add((doc, 0, ids, len(ids) // 4))
                yield _batch(packer.rows)
                packer.rows = []
        full, rest = merge(packer.leftovers(), window)
        for items in full:
            packer.emit(items)
        yield _batch(packer.rows + _leftover_rows(rest, part))

    return run


def _merge_group(level: int, last: bool, window: int, keep_ids: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        rows = sorted(table.drop_columns(["group"]).to_pylist(), key=lambda r: (r["part"], r["offset"]))
        packer = Packer(group, (level << 56) + (group << 32), window, 1, 0, keep_ids)
        full, rest = merge([(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows], window)
        for items in full:
            packer.emit(items)
        if last:
            left, size = sum(len(x[2]) for x in rest) // 4, window
            while rest:
                while size > left:
                    size //= 2
                whole, tail = merge(rest, size)
                packer.emit(whole[0])
                rest = [x for w in whole[1:] for x in w] + tail
                left -= size
        return pa.Table.from_batches([_batch(packer.rows + _leftover_rows([] if last else rest, group))])

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = 64, max_gap: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Tokenised once and written; only the partial windows, at most one a task, are moved between tasks.
    Each merge takes ``MERGE_GROUP`` of them, at most ``MERGE_GROUP * window`` ids, until one group is left.
    """
    done = written(docs.select("doc_id", "text").mapInArrow(lean(_pack_tasks(tokenizer_path, window, open_windows, max_gap, keep_ids)), _SCHEMA), "pack")
    out = done.where(F.col("sequence_id").isNotNull())
    rest, level = done.where(F.col("sequence_id").isNull()), 1
    while True:
        parts = rest.agg(F.max("part")).first()[0]
        if parts is None:
            break
        last = parts < MERGE_GROUP
        grouped = rest.withColumn("group", F.floor(F.col("part") / MERGE_GROUP).cast("long")).groupBy("group")
        merged = written(grouped.applyInArrow(_merge_group(level, last, window, keep_ids), _SCHEMA), "pack-merge")
        out = out.unionByName(merged.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        rest, level = merged.where(F.col("sequence_id").isNull()), level + 1
    return out.drop("part") if keep_ids else out.drop("part", "ids")
