"""Sliding-window decoding of rounds, in batch replays and on Structured Streaming state."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import kernel
from ..operators.lattice import Adjacency
from ..plans.grids import Grid, next_power_of_two

SCHEMA = "stream_id bigint, round bigint, u bigint, v bigint, observable bigint"


class WindowDecoder:
    """Rounds of one stream in a window of `size` layers.

    A round enters the window's end; once the window is full its oldest round is decoded with the others and
    committed: every edge at that round is emitted, and the far end of an edge into the next round toggles a
    defect there, so that the emitted edges of the whole stream annihilate its defects. flush commits the rest.
    Rounds before the window are late and dropped; rounds that are skipped count as empty.
    """

    def __init__(self, width: int, height: int, size: int, state: dict | None = None):
        self.layer = Grid(width, height)
        self.size, self.state = size, state or {"tail": 0, "head": 0, "late": 0, "defects": []}
        side = next_power_of_two(max(width, height))
        self.stride_y, self.stride_z = side, side * side
        self._adjacent: dict[int, Adjacency] = {}

    def node(self, x: int, y: int, round_: int) -> int:
        """Absolute id: layers follow each other without end."""
        return round_ * self.stride_z + y * self.stride_y + x

    @property
    def is_full(self) -> bool:
        return self.state["head"] - self.state["tail"] >= self.size

    def push(self, round_: int, cells: list[tuple[int, int]]) -> Iterator[tuple]:
        """Takes a round's defects (x, y); yields (round, u, v or None, observable) that are committed by it."""
        s = self.state
        if round_ < s["tail"]:
            s["late"] += 1
            return
        while round_ >= s["head"]:
            if self.is_full:
                yield from self._commit(s["tail"] + 1)
            s["head"] += 1
        for x, y in cells:
            if x < self.layer.width and y < self.layer.height:
                self._toggle([round_, y, x])

    def flush(self) -> Iterator[tuple]:
        yield from self._commit(self.state["head"])

    def _toggle(self, cell: list[int]) -> None:
        d = self.state["defects"]
        d.remove(cell) if cell in d else d.append(cell)

    def _commit(self, until: int) -> Iterator[tuple]:
        """Commits the rounds before `until`."""
        s, w, h = self.state, self.layer.width, self.layer.height
        if s["defects"]:
            depth = s["head"] - s["tail"]
            if depth not in self._adjacent:
                self._adjacent[depth] = Adjacency(Grid(w, h, depth, "grid3d"))
            adj = self._adjacent[depth]
            dense = np.sort(np.array([((r - s["tail"]) * h + y) * w + x for r, y, x in s["defects"]]))
            _, edge, _, _ = kernel.decode(adj, np.zeros(len(dense), np.int64), dense, 1)
            found = []
            for e in edge:
                ends = [k for k in (int(adj.u[e]), int(adj.v[e])) if k >= 0]
                cells = [(k // (w * h) + s["tail"], k // w % h, k % w) for k in ends]
                if cells[0][0] >= until:
                    continue
                bit = 0
                if len(cells) == 1:
                    _, y, x = cells[0]
                    to_x, to_y = min(x, w - 1 - x), min(y, h - 1 - y)
                    bit = 2 if to_x == 0 else 1 if to_y == 0 else 2 if to_x <= to_y else 1
                for cell in cells:
                    self._toggle(list(cell))
                found.append((cells[0][0], self.node(cells[0][2], cells[0][1], cells[0][0]), self.node(cells[1][2], cells[1][1], cells[1][0]) if len(cells) == 2 else None, bit))
            yield from sorted(found, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))
        s["tail"] = until


#: Rows that a replay holds at once; a stream with more goes round by round.
CHUNK_ROWS = 20_000


def _rows(stream_id, out: list[tuple]) -> pa.RecordBatch:
    r, u, v, o = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([stream_id] * len(out), pa.int64()), pa.array(r, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(o, pa.int64())], ["stream_id", "round", "u", "v", "observable"])


class _LongStream:
    """One stream that goes on over many batches."""

    def __init__(self, stream: int, width: int, height: int, size: int):
        self.stream, self.decoder = stream, WindowDecoder(width, height, size)

    def feed(self, round_: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray, end: bool) -> Iterator[pa.RecordBatch]:
        """Whole rounds, in order."""
        out: list[tuple] = []
        starts = np.flatnonzero(np.diff(round_, prepend=round_[:1] - 1)) if len(round_) else np.zeros(0, int)
        for i, j in zip(starts, [*starts[1:], len(round_)], strict=True):
            k = np.flatnonzero(on[i:j]) + i
            out.extend(self.decoder.push(int(round_[i]), list(zip(x[k].tolist(), y[k].tolist(), strict=True))))
        if end:
            out.extend(self.decoder.flush())
        if out:
            yield _rows(self.stream, out)


def _lockstep(cols: list[np.ndarray], width: int, height: int, size: int) -> Iterator[pa.RecordBatch]:
    """Commits of whole streams as WindowDecoder makes them, all streams at the same round in one kernel call."""
    side, layer = next_power_of_two(max(width, height)), width * height
    ids, idx = np.unique(cols[0], return_inverse=True)
    last = np.zeros(len(ids), np.int64)
    np.maximum.at(last, idx, cols[1])
    cell = cols[3] * width + cols[2]
    ok = cols[4].astype(bool) & (cols[2] < width) & (cols[3] < height) & (cols[1] >= 0)
    order = np.argsort(cols[1][ok], kind="stable")
    when, who, what = cols[1][ok][order], idx[ok][order], cell[ok][order]
    adjacent: dict[int, Adjacency] = {}
    window = np.zeros((len(ids), size * layer), np.uint8)

    def load(r: int, at: int) -> None:
        i, j = np.searchsorted(when, [r, r + 1])
        np.bitwise_xor.at(window, (who[i:j], at * layer + what[i:j]), 1)

    for k in range(size):
        load(k, k)
    tail = 0
    while True:
        flush = last - size + 1 <= tail
        for depth in np.unique(np.minimum(size, last[window.any(1)] + 1)).tolist():
            mine = np.flatnonzero(window.any(1) & (np.minimum(size, last + 1) == depth))
            if depth not in adjacent:
                adjacent[depth] = Adjacency(Grid(width, height, depth, "grid3d"))
            adj = adjacent[depth]
            shot, node = np.nonzero(window[mine, : depth * layer])
            c_shot, edge, _, _ = kernel.decode(adj, shot, node, len(mine))
            u, v = adj.u[edge], adj.v[edge]
            keep = flush[mine[c_shot]] | (u < layer)
            stream, u, v = mine[c_shot[keep]], u[keep], v[keep]
            if not len(u):
                continue
            inner = v >= 0
            np.bitwise_xor.at(window, (stream, u), 1)
            np.bitwise_xor.at(window, (stream[inner], v[inner]), 1)
            x, y = u % width, u // width % height
            to_x, to_y = np.minimum(x, width - 1 - x), np.minimum(y, height - 1 - y)
            bit = np.where(inner, 0, np.where(to_x == 0, 2, np.where(to_y == 0, 1, np.where(to_x <= to_y, 2, 1))))
            first, second = ((tail + n // layer) * side * side + n // width % height * side + n % width for n in (u, np.maximum(v, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[stream], pa.int64()), pa.array(tail + u // layer), pa.array(first), pa.array(second, mask=~inner), pa.array(bit.astype(np.int64))], ["stream_id", "round", "u", "v", "observable"])
        window[flush] = 0  # what no correction clears stays behind, as at the end of a stream
        tail += 1
        window[:, :-layer] = window[:, layer:]
        window[:, -layer:] = 0
        load(tail + size - 1, size - 1)
        if not window.any():  # on to the next round with a defect
            nxt = np.searchsorted(when, tail + size)
            if nxt == len(when):
                return
            target = int(when[nxt]) - size + 1
            if target > tail:
                tail = target
                load(tail + size - 1, size - 1)


def replay(rounds: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """Commits of whole streams: rounds (stream_id, round, x, y, on), decoded in round order as a stream would be.

    A task takes its streams in lockstep, CHUNK_ROWS rows at a time; a stream with more rows goes on by itself.
    """

    def run(batches):
        held, long = None, None
        for batch in itertools.chain(batches, [None]):
            end = batch is None
            if not end and batch.num_rows:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if held is None or (not end and len(held[0]) < CHUNK_ROWS):
                continue
            if long is not None:
                n = int(np.searchsorted(held[0], long.stream, "right"))
                over = end or n < len(held[0])
                whole = n if over else int(np.searchsorted(held[1], held[1][-1]))  # the last round may go on
                yield from long.feed(*(c[:whole] for c in held[1:]), over)
                held = [c[whole:] for c in held]
                if not over:
                    continue
                long = None
            cut = len(held[0]) if end else int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield from _lockstep([c[:cut] for c in held], width, height, size)
            held = [c[cut:] for c in held]
            if not end and len(held[0]) >= CHUNK_ROWS:
                long = _LongStream(int(held[0][0]), width, height, size)

    rows = rounds.select("stream_id", "round", "x", "y", "on").filter("stream_id IS NOT NULL AND round IS NOT NULL").repartition("stream_id").sortWithinPartitions("stream_id", "round")
    return rows.mapInArrow(run, SCHEMA)


LATENCY = "stream_id bigint, rounds bigint, commits bigint, ingest_us double, commit_us double, flush_us double"


def latencies(rounds: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """(stream_id, rounds, commits, ingest_us, commit_us, flush_us): what one decoder by stream takes.

    ingest_us and commit_us are means over the rounds that only enter the window and over those that push one out,
    flush_us is the end's. Each stream is decoded by itself, as a live one would be.
    """

    def timed(stream: int, cols: list[np.ndarray]) -> tuple:
        decoder, took, done, commits = WindowDecoder(width, height, size), [0.0, 0.0], [0, 0], 0
        starts = np.flatnonzero(np.diff(cols[0], prepend=cols[0][:1] - 1))
        for i, j in zip(starts, [*starts[1:], len(cols[0])], strict=True):
            on = np.flatnonzero(cols[3][i:j].astype(bool)) + i
            cells, began, full = list(zip(cols[1][on].tolist(), cols[2][on].tolist(), strict=True)), time.perf_counter(), decoder.is_full
            commits += len(list(decoder.push(int(cols[0][i]), cells)))
            took[full] += time.perf_counter() - began
            done[full] += 1
        began = time.perf_counter()
        commits += len(list(decoder.flush()))
        flush = time.perf_counter() - began
        return stream, len(starts), commits, *(1e6 * t / max(n, 1) for t, n in zip(took, done, strict=True)), 1e6 * flush

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if held is None or not len(held[0]):
                continue
            starts = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
            ends = np.append(starts[1:], len(held[0]))
            whole = len(starts) - (batch is not None)
            rows = [timed(int(held[0][i]), [c[i:j] for c in held[1:]]) for i, j in zip(starts[:whole], ends[:whole], strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], ["stream_id", "rounds", "commits", "ingest_us", "commit_us", "flush_us"])
            held = [c[ends[whole - 1] if whole else 0 :] for c in held]

    rows = rounds.select("stream_id", "round", "x", "y", "on").filter("stream_id IS NOT NULL AND round IS NOT NULL").repartition("stream_id").sortWithinPartitions("stream_id", "round")
    return rows.mapInArrow(run, LATENCY)


class WindowProcessor(StatefulProcessor):
    """State of one stream: the window as JSON. A row with end_of_stream flushes and clears it."""

    def __init__(self, width: int, height: int, size: int):
        self.shape = width, height, size

    def init(self, handle) -> None:
        self.window = handle.getValueState("window", "state string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = self.window.get() if self.window.exists() else None
        decoder = WindowDecoder(*self.shape, json.loads(held[0]) if held else None)
        frame = pd.concat(list(rows)).sort_values(["end_of_stream", "round"], kind="stable")
        out = []
        for r, part in frame[~frame.end_of_stream].groupby("round", sort=True):
            on = part[part.on]
            out.extend(decoder.push(int(r), list(zip(on.x.tolist(), on.y.tolist(), strict=True))))
        if frame.end_of_stream.any():
            out.extend(decoder.flush())
            self.window.clear()
        else:
            self.window.update((json.dumps(decoder.state),))
        yield pd.DataFrame({"stream_id": pd.array([key[0]] * len(out), "int64"), "round": pd.array([r[0] for r in out], "int64"), "u": pd.array([r[1] for r in out], "int64"), "v": pd.array([r[2] for r in out], "Int64"), "observable": pd.array([r[3] for r in out], "int64")})

    def close(self) -> None:
        pass


def stream(rounds: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """Commits of a streaming DataFrame (stream_id, round, x, y, on, end_of_stream); needs the RocksDB state store.

    Rounds of a stream must arrive in order across micro-batches; earlier ones than the window are dropped as late.
    """
    return rounds.groupBy("stream_id").transformWithStateInPandas(WindowProcessor(width, height, size), outputStructType=SCHEMA, outputMode="Append", timeMode="None")


def commit_order(rounds: DataFrame, size: int) -> DataFrame:
    """(stream_id, round, committed_at): a round leaves when round + size arrives; at the end of the stream, the last ones."""
    last = rounds.groupBy("stream_id").agg(F.max("round").alias("last"))
    return rounds.select("stream_id", "round").distinct().join(last, "stream_id").select("stream_id", "round", F.least(F.col("round") + size, F.col("last") + 1).alias("committed_at"))
