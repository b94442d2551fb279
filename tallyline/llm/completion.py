"""Best-fit packing of token sequences by bin completion.

A document of more than ``size`` tokens is cut into pieces of ``size``; all other documents stay
whole. Every task packs what it reads, a pool of bounded size at a time. Best fit by decreasing
length gives a first packing. If it takes more sequences than a lower bound allows, a
branch-and-bound search tries to save one: it takes the longest piece left, enumerates
the undominated fillings of the room beside it, goes on with the rest, and turns back
where the room wasted so far exceeds what a better packing can afford. Each better packing becomes
the incumbent, until the bound is met or the search has used its nodes. Of a pool's packing the
emptiest sequences go back to the pool, so room is left open only at a task's end.

Defined results: a null text is empty and still ends with the separator, so it has one token. Repeated
rows are packed once each; pieces of equal length are placed in the order in which they
are read. A task without rows packs nothing. Of the input only the key and the text are read, so other
columns may have any name; a null key is passed on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_texts, map_arrow, per_worker, ranges, without_gc
from tallyline.llm.tokens import encoder

Filling = tuple[int, ...]


class Stock:
    """How many pieces of each length are left. Bit l of ``have`` is set where there are any, bit size - l of ``mirror`` too."""

    def __init__(self, lengths: Iterable[int], size: int):
        self.size, self.counts, self.have, self.mirror = size, [0] * (size + 1), 0, 0
        for length in lengths:
            self.give(length)

    def give(self, length: int) -> None:
        self.counts[length] += 1
        self.have |= 1 << length
        self.mirror |= 1 << (self.size - length)

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.have &= ~(1 << length)
            self.mirror &= ~(1 << (self.size - length))

    def pairs(self, room: int) -> int:
        """Bit a is set where a and room - a are both left, a being the longer."""
        found = (self.have & (self.mirror >> (self.size - room))) >> (half := -(-room // 2)) << half
        return found & ~(1 << half) if room % 2 == 0 and self.counts[half] < 2 else found

    def dominated(self, filling: Filling, waste: int) -> bool:
        """Whether a longer piece left could stand for one of the filling's, or one piece for several: then the filling needn't be tried."""
        one, more = 0, 0
        for length in filling:  # sums of one piece, and of two and more
            more |= (more | one) << length
            one |= 1 << length
        longer = _spread(one, waste - 1) << 1 if waste else 0
        return bool(self.have & (longer | _spread(more, waste)))


def _spread(bits: int, reach: int) -> int:
    """Every bit, and the ``reach`` bits above it."""
    span = 1
    while span <= reach:
        step = min(span, reach + 1 - span)
        bits |= bits << step
        span += step
    return bits


#: Pieces of a filling beyond this many are taken longest first, without alternatives.
DEEPEST = 40


def fillings(stock: Stock, room: int, most: int, spare: int, tries: int, enough: int = 8) -> list[tuple[int, Filling]]:
    """(waste, filling) of undominated sets of pieces of at most ``most`` that leave at most ``spare`` of the room, least waste first.

    Sets are enumerated with falling lengths, exact ones of one or two pieces first, until ``tries`` were looked at
    or ``enough`` exact ones were found.
    """
    out: list[tuple[int, Filling]] = []
    looked = 0

    def add(taken: Filling, more: Filling, waste: int) -> None:
        nonlocal looked
        looked += 1
        if waste > spare:
            return
        for x in more:
            stock.take(x)
        if not stock.dominated(taken + more, waste):
            out.append((waste, taken + more))
        for x in more:
            stock.give(x)

    def fill(room: int, most: int, taken: Filling) -> None:
        if room <= most and stock.have >> room & 1:  # dominates all others; behind a piece it is one of the pairs
            if not taken:
                add((), (room,), 0)
            return
        exact = stock.pairs(room) & ((1 << (most + 1)) - 1)
        fits = stock.have & ((1 << (min(room, most) + 1)) - 1)
        if not fits:
            add(taken, (), room)
        while exact and looked < tries and len(out) < enough:
            first = exact.bit_length() - 1
            exact &= ~(1 << first)
            add(taken, (first, room - first), 0)
        while fits and looked < tries and len(out) < enough:
            first = fits.bit_length() - 1
            fits &= ~(1 << first)
            stock.take(first)
            fill(room - first, first, (*taken, first))
            stock.give(first)
            if len(taken) >= DEEPEST:
                break

    if room:
        fill(room, most, ())
    else:
        out.append((0, ()))
    return sorted(out, key=lambda x: x[0])


def lower_bound(lengths: list[int], size: int) -> int:
    """Sequences that any packing needs: for each a, pieces over size - a share none with those of a and more; halves pair at most."""
    counts = np.bincount(lengths, minlength=size + 1)[: size + 1]
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(size + 1))
    a = np.arange(1, size // 2 + 1)
    alone = number[size] - number[size - a]
    large = number[size - a] - number[size // 2]
    inside = total[size - a] - total[a - 1]  # of pieces from a to size - a
    return int(max(-(-total[size] // size), (alone + np.maximum(large, -(-inside // size))).max(initial=0)))


def best_fit(lengths: list[int], size: int) -> list[Filling]:
    """Longest first, each into the fullest sequence that has room."""
    by_room: list[list[list[int]]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set where a sequence has room for r
    for length in sorted(lengths, reverse=True):
        fits = rooms >> length << length
        room = (fits & -fits).bit_length() - 1 if fits else size
        own = by_room[room].pop() if fits else []
        if fits and not by_room[room]:
            rooms &= ~(1 << room)
        own.append(length)
        by_room[room - length].append(own)
        if room > length:
            rooms |= 1 << (room - length)
    return [tuple(x) for own in by_room for x in own]


def complete(lengths: list[int], size: int, nodes: int = 500, tries: int = 32) -> list[Filling]:
    """Packs the lengths (1 to size) into as few sequences as it finds.

    The search tries at most ``nodes`` fillings beyond one for each sequence, and looks at up to ``tries`` fillings of a
    place; within these it finds the fewest.
    """
    best = best_fit(lengths, size)
    bound, total = lower_bound(lengths, size), sum(lengths)
    left = nodes + len(best)
    while len(best) > bound and left > 0:
        found, used = _search(lengths, size, (len(best) - 1) * size - total, left, tries)
        left -= used
        if found is None:
            break
        best = found
    return best


def _search(lengths: list[int], size: int, spare: int, nodes: int, tries: int) -> tuple[list[Filling] | None, int]:
    """A packing that wastes at most ``spare``, or None if it finds none or the nodes are used up; and the nodes used."""
    stock, used = Stock(lengths, size), 0
    chosen: list[tuple[int, Filling]] = []
    open_: list[tuple[int, deque]] = []  # by place: its longest piece, and the fillings not tried yet
    while stock.have:
        longest = stock.have.bit_length() - 1
        stock.take(longest)
        open_.append((longest, deque(fillings(stock, size - longest, longest, spare, tries))))
        stock.give(longest)
        while open_ and not open_[-1][1]:  # nothing left to try here: back to the place before
            open_.pop()
            if chosen:
                waste, filling = chosen.pop()
                spare += waste
                for x in filling:
                    stock.give(x)
        if not open_ or used >= nodes:
            return None, used
        longest, left = open_[-1]
        waste, filling = left.popleft()
        used += 1
        spare -= waste
        chosen.append((waste, (longest, *filling)))
        for x in chosen[-1][1]:
            stock.take(x)
    return [f for _, f in chosen], used


class Pool:
    """Pieces that wait for a place, by length, and the sequences that are closed."""

    def __init__(self, size: int, **search):
        self.size, self.search, self.tokens = size, search, 0
        self.waiting: dict[int, deque] = {}
        self.closed: list[list[tuple]] = []

    def add(self, key, ids: np.ndarray) -> None:
        """ids: all of a document's."""
        for piece, start in enumerate(range(0, len(ids), self.size)):
            own = ids[start : start + self.size]
            if len(own) == self.size:
                self.closed.append([(key, piece, start, own)])
            else:
                self.waiting.setdefault(len(own), deque()).append((key, piece, start, own.copy()))
                self.tokens += len(own)

    def pack(self, last: bool) -> None:
        """Closes the sequences of a packing of the whole pool; unless this is the last one, the emptiest quarter waits on where it has room."""
        packed = sorted(complete([n for n, own in self.waiting.items() for _ in own], self.size, **self.search), key=sum, reverse=True)
        keep = len(packed) if last else len(packed) - len(packed) // 4
        done = packed[:keep] + [f for f in packed[keep:] if sum(f) == self.size]
        for filling in done:
            self.closed.append([self.waiting[n].popleft() for n in filling])
            self.tokens -= sum(filling)
        self.waiting = {n: own for n, own in self.waiting.items() if own}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048, end: int = 0, pool_tokens: int = 4_000_000, max_bytes: int = 4_000_000, **search) -> DataFrame:
    """A row per piece: key, piece, start, length, sequence_id, offset, ids (little-endian, unsigned, 32 bits each).

    A pool of pool_tokens is packed at a time. sequence_id holds the task's number in its upper 31 bits. search: see complete().
    """

    def rows(sequences: list[list[tuple]], first: int, kind: pa.DataType) -> pa.RecordBatch:
        pieces = [p for own in sequences for p in own]
        length = np.fromiter((len(p[3]) for p in pieces), dtype=np.int64, count=len(pieces))
        before, opens = np.cumsum(length) - length, np.cumsum([0, *map(len, sequences)])[:-1]
        number = np.repeat(np.arange(len(sequences)), [len(x) for x in sequences])
        ends = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([p[3] for p in pieces]).astype("<u4"))])
        columns = [pa.array([p[0] for p in pieces], kind), pa.array([p[1] for p in pieces], pa.int32()), pa.array([p[2] for p in pieces], pa.int64()), *map(pa.array, (length, first + number, before - before[opens][number])), ids]
        return pa.RecordBatch.from_arrays(columns, names=["key", "piece", "start", "length", "sequence_id", "offset", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pool = per_worker("completion", tokenizer, lambda: encoder(tokenizer)), Pool(size, **search)
        at, kind = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, None

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal at
            while pool.closed:
                some, pool.closed = pool.closed[:256], pool.closed[256:]
                yield rows(some, at, kind)
                at += len(some)

        with without_gc():
            for batch in batches:
                kind = batch.column(0).type
                keys, texts = batch.column(0).to_pylist(), arrow_texts(batch.column(1))
                for low, high in ranges(texts, max_bytes):
                    ids, lengths = own.encode(texts.slice(low, high - low), end)
                    stop = np.cumsum(lengths)
                    for k in range(low, high):
                        pool.add(keys[k], ids[stop[k - low] - lengths[k - low] : stop[k - low]])
                    if pool.tokens >= pool_tokens:
                        pool.pack(last=False)
                    yield from closed()
            pool.pack(last=True)
            yield from closed()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, sequence_id long, offset long, ids binary"
    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema).withColumnRenamed("key", key)
