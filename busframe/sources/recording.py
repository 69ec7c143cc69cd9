"""Raw recordings as a Spark data source: record boundaries, the clock's format and recovery from corruption.

A record's place depends on the lengths of all before it, so a file is one task; everything behind the frames is
columns. The file is mapped, not read: a task holds one batch of records, whatever the file's size. Behind its frames
each file has one row with a status, which tells how it ended; the source itself raises nothing about recordings."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from busframe.functions.words import MESSAGE_TYPES

SCAN_BYTES = 65536
#: Words of a file that are looked at at a time: few behind a loss of sync, twice as many each time a chain goes on.
LEAST_BLOCK, BLOCK = 1 << 12, 1 << 18
#: The least record that a walk by lengths shows, in words.
LEAST_WALK = 5
STATUS = "struct<outcome: string, offset: long, raw: int, need: long, have: long, losses: long, irig: int, standard: int, probed: int, confidence: string, clock: string>"
SCHEMA = f"file_idx int, path string, file_name string, file_len long, ts_format string, ts_words int, epoch int, seq long, offset long, nwords int, w array<int>, status {STATUS}"
KNOWN = np.zeros(128, bool)
KNOWN[list(MESSAGE_TYPES)] = True


@dataclass(frozen=True)
class Options:
    time_format: str = "auto"
    detect_records: int = 8
    lookahead_records: int = 2
    strict: bool = False


@dataclass
class Run:
    """Records that stand one behind the other from word `at` on: the words of each."""

    ts_words: int
    epoch: int
    at: int
    counts: np.ndarray


class Recording:
    """The 16-bit words of a file; an odd last byte counts for its length only. After runs(), status tells the end."""

    def __init__(self, words: np.ndarray, size: int, options: Options = Options()):
        self.size, self.options, self.w = size, options, words
        self.status: dict = {"outcome": "OK", "losses": 0}
        self.block = LEAST_BLOCK

    @classmethod
    def of(cls, data: bytes, options: Options = Options()) -> Recording:
        return cls(np.frombuffer(data, "<u2", len(data) // 2), len(data), options)

    @classmethod
    def mapped(cls, path: str, options: Options = Options()) -> Recording:
        size = os.path.getsize(path)
        return cls(np.memmap(path, "<u2", "r", shape=(size // 2,)) if size > 1 else np.zeros(0, "<u2"), size, options)

    def word(self, at: int) -> int:
        return int(self.w[at])

    def fault(self, at: int, ts_words: int | None, ahead: int, ends: bool = True) -> str | None:
        """Why no record begins at word `at`, or null. ahead: records checked, this one included; ends: a zero word
        behind a record ends the check."""
        if 2 * at + 2 > self.size:
            return "UNREADABLE"
        word = self.word(at)
        count = word >> 8 & 63
        least = 4 if ts_words is None else ts_words + 2
        if word & 127 not in MESSAGE_TYPES:
            return "UNKNOWN_TYPE"
        if count < least:
            return "WORD_COUNT"
        if 2 * (at + count) > self.size:
            return "TRUNCATED"
        if ts_words == 3:
            a, b, c = map(int, self.w[at + 1 : at + 4])
            checks = (("HOUR", a & 31, 24), ("MINUTE", b >> 10, 60), ("SECOND", b >> 4 & 63, 60), ("MICROS", (b & 15) << 16 | c, 1_000_000))
            for name, value, limit in checks:
                if value >= limit:
                    return name
            if not a >> 15 and not 1 <= a >> 5 & 511 <= 366:
                return "DAY"
        for _ in range(ahead - 1):
            at += count
            if 2 * at + 2 > self.size:
                break
            word = self.word(at)
            if ends and not word:
                break
            count = word >> 8 & 63
            if word & 127 not in MESSAGE_TYPES:
                return "AHEAD_TYPE"
            if count < least:
                return "AHEAD_WORD_COUNT"
        return None

    def found(self, start: int, stop: int, ts_words: int | None, ends: bool = True) -> int | None:
        """The first word from start on, before stop, where a record begins. Only words that name a type are looked at."""
        near = start + np.flatnonzero(KNOWN[self.w[start:stop] & 127])
        return next((int(k) for k in near if self.fault(int(k), ts_words, self.options.lookahead_records, ends) is None), None)

    def scores(self, at: int) -> tuple[int, int, int]:
        """Of up to detect_records records from word `at`: points for either clock, and records seen."""
        irig = standard = seen = 0
        for _ in range(max(1, self.options.detect_records)):
            if 2 * at + 8 > self.size or (count := self.word(at) >> 8 & 63) < 4:
                break
            kind = self.word(at) & 127

            def points(place: int, overhead: int) -> int:
                if 2 * place + 2 > self.size:
                    return 0
                cmd = self.word(place)
                fits = kind in (0x02, 0x10) and not cmd >> 10 & 1 or kind == 0x04 and cmd >> 10 & 1
                return 2 * bool(fits) + 2 * (count - overhead == (cmd & 31 or 32))

            if 2 * (at + 5) <= self.size:
                a, b = self.word(at + 1), self.word(at + 2)
                irig += points(at + 4, 6) + (a & 31 < 24 and b >> 10 < 60 and (b >> 4 & 63) < 60)
            standard += points(at + 3, 5)
            seen += 1
            at += count
            if 2 * at > self.size:
                break
        return irig, standard, seen

    def alike(self, at: int) -> bool:
        """Whether four records' lengths from `at` on hold the same words but for the clock, as filler does."""
        n = self.word(at) >> 8 & 63
        if 2 * (at + 4 * n) > self.size:
            return False
        parts = self.w[at : at + 4 * n].reshape(4, n)
        return bool((parts[:, 0] == parts[0, 0]).all() and (parts[:, 4:] == parts[0, 4:]).all())

    def ended(self, outcome: str, at: int | None = None, **facts) -> None:
        raw = None if at is None or 2 * at + 2 > self.size else self.word(at)
        need = None if raw is None else 2 * (raw >> 8 & 63)
        have = None if at is None else self.size - 2 * at
        self.status |= {"outcome": outcome, "offset": None if at is None else 2 * at, "raw": raw, "need": need, "have": have, **facts}

    def clock(self, at: int, known: int | None) -> int:
        """Words of the clock of the record at word `at` and those behind it. What was asked for stays, but is checked."""
        irig, standard, seen = self.scores(at)
        most, margin = max(irig, standard), abs(irig - standard)
        confidence = "AMBIGUOUS" if most < 4 or margin < 3 else "DECISIVE" if most >= 8 and margin >= 6 else "MARGINAL"
        likely = 3 if irig >= standard else 2
        clock = ("AMBIGUOUS" if confidence == "AMBIGUOUS" else "OK") if known is None else "CONFLICT" if confidence == "DECISIVE" and likely != known else "OK"
        self.status |= {"irig": irig, "standard": standard, "probed": seen, "confidence": confidence, "clock": clock}
        return known or likely

    def chain(self, at: int, ts_words: int) -> tuple[np.ndarray, int]:
        """Lengths of the records from word `at` on up to the end of a block or the first word where none begins, and
        the word behind them. All places of the block are checked at once; the walk only follows lengths."""
        w = self.w[at : at + self.block + 64].astype(np.int32)
        n = min(len(w), self.block)
        head = w[:n]
        count = head >> 8 & 63
        good = KNOWN[head & 127] & (count >= ts_words + 2) & (np.arange(n) + count <= len(w))
        if ts_words == 3:
            a, b, c = (np.pad(w, (0, 4))[k : k + n] for k in (1, 2, 3))
            day = a >> 5 & 511
            good &= (a & 31 < 24) & (b >> 10 < 60) & ((b >> 4 & 63) < 60) & (((b & 15) << 16 | c) < 1_000_000) & ((a >> 15 > 0) | (day >= 1) & (day <= 366))
        step, out, k = np.where(good, count, 0).tolist(), [], 0
        while k < n and (m := step[k]):
            out.append(m)
            k += m
        self.block = min(BLOCK, 2 * self.block) if k >= n else LEAST_BLOCK
        return np.array(out, np.int32), at + k

    def runs(self) -> Iterator[Run]:
        """The records, in runs without gaps; an epoch is what lies between two losses of sync."""
        o = self.options
        known = {"irig": 3, "standard": 2}.get(o.time_format)
        at = self.found(0, min(self.size, SCAN_BYTES) // 2, known)
        if at is None:
            if len(self.w) and not self.word(0):
                self.ended("EMPTY_RECORDING", 0)
            elif (cut := self.cut(known)) is not None:
                self.ended("STRICT_FIRST_TRUNCATED" if o.strict else "FIRST_TRUNCATED", cut)
            else:
                self.ended("NO_RECORDS")
            return
        if self.alike(at):
            self.ended("HOMOGENEOUS", at)
            return
        known = self.clock(at, known)
        if o.strict and self.status["clock"] != "OK":
            self.ended("STRICT_CLOCK", at)
            return
        epoch = 0
        while 2 * at + 8 <= self.size and self.word(at):
            counts, behind = self.chain(at, known)
            if len(counts):
                yield Run(known, epoch, at, counts)
                at = behind
                continue
            self.status["losses"] += 1
            if o.strict:
                self.ended(f"STRICT_{self.fault(at, known, 1)}", at)
                return
            found = self.found(at + 1, min(self.size, 2 * at + SCAN_BYTES) // 2, known, False)
            if found is None:
                self.ended("TRUNCATED_TAIL" if self.size - 2 * at < SCAN_BYTES else "UNRECOVERABLE", at)
                return
            at, epoch = found, epoch + 1

    def cut(self, ts_words: int | None) -> int | None:
        """The first word in reach of the scan where a record of a known type begins that passes the end of the file, or null."""
        w = self.w[: SCAN_BYTES // 2].astype(np.int32)
        count = w >> 8 & 63
        cut = KNOWN[w & 127] & (count >= (ts_words or 3) + 2) & (2 * (np.arange(len(w)) + count) > self.size)
        return int(cut.argmax()) if cut.any() else None

    def walk(self, offset: int, most: int | None) -> Iterator[Run]:
        """Records by their lengths alone, as a report of a suspect file shows them; from a byte offset on, at most so many.

        Here the runs' `at` counts bytes, as the offset may be odd."""
        at, counts, n, why, count = offset, [], 0, "OK", 0
        start = at
        while at + 2 * LEAST_WALK <= self.size and (most is None or n < most):
            count = int(self.bytes_at(at, 2).view("<u2")[0]) >> 8 & 63
            if count < LEAST_WALK or at + 2 * count > self.size:
                why = "WORD_COUNT" if count < LEAST_WALK else "TRUNCATED"
                break
            counts.append(count)
            at, n = at + 2 * count, n + 1
            if len(counts) == LEAST_BLOCK:
                yield Run(3, 0, start, np.array(counts, np.int32))
                start, counts = at, []
        if counts:
            yield Run(3, 0, start, np.array(counts, np.int32))
        self.status |= {"outcome": why, "offset": at, "raw": count & 63, "need": 2 * count, "have": self.size - at}

    def bytes_at(self, at: int, n: int) -> np.ndarray:
        """n bytes from byte `at` on, also at odd places."""
        return self.w[at // 2 : (at + n + 1) // 2].view(np.uint8)[at % 2 : at % 2 + n].copy()


class _File(InputPartition):
    def __init__(self, index: int, path: str):
        super().__init__(index)
        self.index, self.path = index, path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], options: Options, schema, offset: int | None, most: int | None):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.paths, self.options, self.offset, self.most = paths, options, offset, most
        self.schema = to_arrow_schema(schema)

    def partitions(self):
        return [_File(k, p) for k, p in enumerate(self.paths)]

    def _batch(self, file: _File, size: int, n: int, **columns) -> pa.RecordBatch:
        fixed = {"file_idx": file.index, "path": file.path, "file_name": os.path.basename(file.path), "file_len": size}
        arrays = []
        for f in self.schema:
            value = columns.get(f.name, fixed.get(f.name))
            arrays.append(value if isinstance(value, pa.Array) else pa.array(value if isinstance(value, (list, np.ndarray)) else [value] * n, f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def _status(self, file: _File, size: int, status: dict) -> pa.RecordBatch:
        names = [x.name for x in self.schema.field("status").type]
        return self._batch(file, size, 1, status=[{k: status.get(k) for k in names}])

    def read(self, partition):
        try:
            own = Recording.mapped(partition.path, self.options)
        except FileNotFoundError:
            yield self._status(partition, 0, {"outcome": "OPEN_MISSING"})
            return
        except OSError:
            yield self._status(partition, 0, {"outcome": "OPEN_ERROR"})
            return
        if not own.size:
            yield self._status(partition, 0, {"outcome": "OPEN_EMPTY"})
            return
        walks, seq = self.offset is not None, 0
        for run in own.walk(self.offset, self.most) if walks else own.runs():
            n, total = len(run.counts), int(run.counts.sum())
            ends = np.concatenate([[0], np.cumsum(run.counts)]).astype(np.int32)
            first = run.at if walks else 2 * run.at
            words = own.bytes_at(first, 2 * total).view("<u2") if walks else own.w[run.at : run.at + total]
            yield self._batch(
                partition, own.size, n, ts_format="IRIG" if run.ts_words == 3 else "STANDARD", ts_words=run.ts_words, epoch=run.epoch, seq=np.arange(seq, seq + n), offset=first + 2 * ends[:-1].astype(np.int64), nwords=run.counts,
                w=pa.ListArray.from_arrays(pa.array(ends), pa.array(words.astype(np.int32)), type=self.schema.field("w").type),
            )
            seq += n
        yield self._status(partition, own.size, own.status)


class RecordingSource(DataSource):
    """spark.read.format("busrec").option("paths", "a\\nb").load(): a row for each record, files in the order given, and
    one with a status for each file. With walkOffset (and walkRecords) records go by their lengths alone."""

    @classmethod
    def name(cls) -> str:
        return "busrec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        get = self.options.get
        paths = [p for p in get("paths", get("path", "")).split("\n") if p]
        if not 1 <= len(paths) <= 256:
            raise ValueError("1 to 256 recordings are read at a time")
        options = Options(get("timeFormat", "auto").lower(), int(get("detectRecords", 8)), int(get("lookaheadRecords", 2)), get("strict", "false").lower() == "true")
        number = lambda name: int(get(name)) if get(name) is not None else None
        return _Reader(paths, options, schema, number("walkOffset"), number("walkRecords"))
