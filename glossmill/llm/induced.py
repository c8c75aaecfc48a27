"""External suffix sorting by induction, with common-prefix values.

Suffixes of one type induce the order of those before them. Suffix tuples (first symbol, position, length of
the prefix shared with the tuple before) wait in a priority queue by symbol and arrival, which is monotone:
what comes out induces tuples that come out later. Queue and results are kept on disk beyond a bound, so that
memory holds a range of symbols at a time; the text itself is a file that is mapped. The suffixes that start
an induction (an S type after an L type) are sorted by inducing the substrings between them, naming these, and
sorting the string of names, by recursion as long as it is longer than a few thousand. Names are many and
seldom repeat, so that a range of symbols at a time is settled there.

Common-prefix values are kept up to a depth, and suffixes that agree on so many symbols may stand in either
order. After Bingmann, Fischer and Osipov (2013), and Nong, Zhang and Chan (2009).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

RECORD = np.dtype([("p", "<i8"), ("c", "<i4"), ("l", "u1")], align=True)  # 16 bytes
#: Tuples that one pass of numpy takes.
PART = 1 << 18
#: Names that are sorted without a further recursion.
SHORT = 1 << 12
#: More symbols than MANY are taken in ranges, of about RANGE suffixes each.
MANY, RANGE = 1 << 10, 1 << 15


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Records one after another; numpy is slow at joining many arrays of fields."""
    return parts[0] if len(parts) == 1 else np.concatenate([x.view("c16") for x in parts]).view(RECORD)


class Tape:
    """Records one after another, on disk beyond a bound."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.parts, self.held, self.size, self.file, self.spilled = folder, limit, [], 0, 0, None, 0

    def add(self, records: np.ndarray) -> None:
        self.parts.append(records)
        self.held += len(records)
        self.size += len(records)
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            self.file.seek(0, os.SEEK_END)
            for x in self.parts:
                x.tofile(self.file)
            self.spilled += self.held
            self.parts, self.held = [], 0

    def read(self, low: int, high: int) -> np.ndarray:
        out = []
        if low < self.spilled:
            end = min(high, self.spilled)
            self.file.flush()
            self.file.seek(low * RECORD.itemsize)
            out.append(np.fromfile(self.file, RECORD, end - low))
        if high > self.spilled:
            if len(self.parts) > 1:
                self.parts = [joined(self.parts)]
            out.append(self.parts[0][max(low, self.spilled) - self.spilled : high - self.spilled])
        return joined(out) if out else np.zeros(0, RECORD)


class SymbolQueue:
    """A priority queue by symbol, first in first out within a symbol; only the range of symbols in turn is in memory."""

    def __init__(self, symbols: int, folder: str, limit: int, turns: int = 256):
        self.width = -(-symbols // turns)
        self.later = [Tape(folder, limit // turns) for _ in range(turns)]
        self.turn, self.now = -1, {}

    def open(self, turn: int) -> np.ndarray:
        """What has come for a range of symbols."""
        tape, self.later[turn] = self.later[turn], None
        self.turn, self.now = turn, {}
        return tape.read(0, tape.size)

    def deal(self, records: np.ndarray) -> None:
        if not len(records):
            return
        if self.width > 1:
            records = records[np.argsort(records["c"], kind="stable")]
        borders = np.concatenate(([0], np.flatnonzero(np.diff(records["c"])) + 1, [len(records)]))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            self.now.setdefault(int(records["c"][a]), []).append(records[a:b])

    def push(self, records: np.ndarray) -> None:
        """Records come sorted by symbol, those of a symbol in their order."""
        if not len(records):
            return
        turns = records["c"] // self.width
        borders = np.concatenate(([0], np.flatnonzero(np.diff(turns)) + 1, [len(records)]))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            turn = int(turns[a])
            if turn == self.turn:
                self.deal(records[a:b])
            else:
                self.later[turn].add(records[a:b])

    def take(self, symbol: int) -> np.ndarray | None:
        found = self.now.pop(symbol, None)
        return None if found is None else joined(found)


class Shared:
    """Smallest common-prefix value since a symbol last induced something."""

    def __init__(self, symbols: int, depth: int):
        self.depth = depth
        self.since = np.full(symbols, depth, np.uint8)
        self.seen = np.zeros(symbols, bool)

    def induced(self, values: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """values: of the batch in its order; at: indices of those that induce, sorted by the induced symbol and then by order."""
        low = np.minimum.accumulate(values)
        out = np.empty(len(at), np.uint8)
        first = np.ones(len(at), bool)
        first[1:] = symbols[1:] != symbols[:-1]
        out[first] = np.minimum(self.since[symbols[first]], low[at[first]])
        rest = np.flatnonzero(~first)
        if len(rest):
            a, b = at[rest - 1] + 1, at[rest]
            level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            table = [values]
            for k in range(int(level.max())):
                table.append(np.minimum(table[-1][: -(1 << k)], table[-1][1 << k :]))
            for k in range(len(table)):
                own = level == k
                if own.any():
                    out[rest[own]] = np.minimum(table[k][a[own]], table[k][b[own] - (1 << k) + 1])
        out = np.minimum(out, self.depth - 1) + np.uint8(1)
        new = first & ~self.seen[symbols]
        out[new] = 0
        self.since = np.minimum(self.since, low[-1])
        if len(at):
            last = np.append(first[1:], True)
            tail = np.append(np.minimum.accumulate(values[::-1])[::-1], np.uint8(self.depth))
            self.since[symbols[last]] = tail[at[last] + 1]
            self.seen[symbols[last]] = True
        return out


class Sorter:
    """text: symbols from 0, the last one 0 and nowhere else."""

    def __init__(self, text: np.ndarray, symbols: int, folder: str, limit: int, depth: int = 0):
        self.text, self.symbols, self.folder, self.limit, self.depth = text, symbols, folder, max(256, limit), depth
        self.smaller = self._types()
        self.starts = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1

    def _types(self) -> np.ndarray:
        """Whether a suffix is smaller than that after it (type S)."""
        n = len(self.text)
        out = np.ones(n, bool)
        following = True
        for high in range(n - 1, 0, -PART):
            low = max(0, high - PART)
            a, b = self.text[low:high], self.text[low + 1 : high + 1]
            place = np.where(a != b, np.arange(high - low), high - low)
            place = np.minimum.accumulate(place[::-1])[::-1]
            out[low:high] = np.append(a < b, following)[place]
            following = bool(out[low])
        return out

    def common(self, a: int, b: int) -> int:
        x, y = self.text[a : a + self.depth], self.text[b : b + self.depth]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def _from(self, queue: SymbolQueue, batch: np.ndarray, smaller: bool, shared: Shared | None) -> None:
        """What a batch of sorted suffixes induces of one type."""
        for low in range(0, len(batch), PART):
            part = batch[low : low + PART]
            before = part["p"] - 1
            at = np.flatnonzero(before >= 0)
            at = at[self.smaller[before[at]] == smaller]
            symbols = self.text[before[at]]
            order = np.argsort(symbols, kind="stable")
            at, symbols = at[order], symbols[order]
            out = np.zeros(len(at), RECORD)
            out["c"], out["p"] = symbols, before[at]
            if shared:
                out["l"] = shared.induced(part["l"], at, symbols.astype(np.int64))
            queue.push(out)

    def induce(self, seeds: np.ndarray, values: np.ndarray | None) -> tuple[Tape, np.ndarray, Tape, np.ndarray]:
        """Suffixes of type L rising and of type S falling, each with the borders of its symbols; seeds: sorted starting suffixes."""
        seed_at = np.searchsorted(self.text[seeds], np.arange(self.symbols + 1))
        if values is None and self.symbols > MANY:
            large, large_at = self._ranges(seeds, seed_at, False)
            return large, large_at, *self._ranges(large, large_at, True)
        queue = SymbolQueue(self.symbols, self.folder, self.limit)
        shared = Shared(self.symbols, self.depth) if values is not None else None
        large, large_at = Tape(self.folder, self.limit), np.zeros(self.symbols + 1, np.int64)
        for symbol in range(self.symbols):
            if symbol // queue.width != queue.turn:
                queue.deal(queue.open(symbol // queue.width))
            last = None
            while (batch := queue.take(symbol)) is not None:
                large.add(batch)
                last = int(batch["p"][-1])
                self._from(queue, batch, False, shared)
            large_at[symbol + 1] = large.size
            a, b = seed_at[symbol], seed_at[symbol + 1]
            if a < b:
                batch = np.zeros(b - a, RECORD)
                batch["p"] = seeds[a:b]
                if shared:
                    batch["l"] = values[a:b]
                    batch["l"][0] = 0 if last is None else self.common(last, int(seeds[a]))
                self._from(queue, batch, False, shared)
        queue = SymbolQueue(self.symbols, self.folder, self.limit)
        shared = Shared(self.symbols, self.depth) if values is not None else None
        small, small_at = Tape(self.folder, self.limit), np.zeros(self.symbols + 1, np.int64)
        for symbol in range(self.symbols - 1, -1, -1):
            if symbol // queue.width != queue.turn:
                queue.deal(queue.open(symbol // queue.width))
            last = None
            while (batch := queue.take(symbol)) is not None:
                small.add(batch)
                last = int(batch["p"][-1])
                self._from(queue, batch, True, shared)
            small_at[symbol] = small.size
            for high in range(int(large_at[symbol + 1]), int(large_at[symbol]), -PART):
                low = max(int(large_at[symbol]), high - PART)
                batch = large.read(low, high)[::-1].copy()
                if shared:
                    after = batch["l"].copy()  # a value belongs to the pair with the suffix before; falling, with that after
                    batch["l"][1:] = after[:-1]
                    batch["l"][0] = carried if high < large_at[symbol + 1] else 0 if last is None else self.common(int(batch["p"][0]), last)
                    carried = after[-1]
                self._from(queue, batch, True, shared)
        small_at[self.symbols] = 0
        return large, large_at, small, small_at

    def _settled(self, come: np.ndarray, rest: np.ndarray, turn: int, width: int, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sorted tuples of a range of symbols, and what they induce beyond it.

        come: tuples in order of arrival; rest: sorted suffixes of the other type, which follow those of their symbol.
        Tuples that are induced inside the range point to the one that induces them. Their order is that of the chains
        of symbols up to a tuple that came or a suffix of rest, and is found by doubling the links that are compared.
        """
        parts, source, last, at = [come["p"], rest["p"]], [], np.concatenate([come["p"], rest["p"]]), 0
        fixed, beyond = len(last), []
        while len(last):
            of = np.arange(at, at + len(last))
            at += len(last)
            last = last - 1
            valid = last >= 0
            valid[valid] = self.smaller[last[valid]] == smaller
            last, of = last[valid], of[valid]
            inside = self.text[last] // width == turn
            beyond.append((of[~inside], last[~inside]))
            last = last[inside]
            parts.append(last)
            source.append(of[inside])
        places = np.concatenate(parts)
        symbols = self.text[places].astype(np.int64)
        if smaller:
            symbols = self.symbols - symbols
        n = len(places)
        link = np.concatenate([np.arange(fixed), *source])
        # Those that came are first in their symbol, those induced inside the range next, and rest last.
        kind = np.full(n, 1)
        kind[: len(come)], kind[len(come) : fixed] = 0, 2
        key = symbols * 3 + kind
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order[1:]] != key[order[:-1]])[:n] | (kind[order] != 1)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while len(slots := np.flatnonzero(~(new & np.append(new[1:], True)))):
            own = order[slots]
            key = rank[own] * n + rank[link[own]]
            turned = np.argsort(key)
            own, key = own[turned], key[turned]
            order[slots] = own
            new[slots] = np.append(True, key[1:] != key[:-1])
            rank[own] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            link[own] = link[link[own]]
        known = order[kind[order] != 2]
        out = np.zeros(len(known), RECORD)
        out["p"], out["c"] = places[known], self.text[places[known]]
        of, induced = (np.concatenate(x) for x in zip(*beyond, strict=True)) if beyond else (np.zeros(0, np.int64),) * 2
        induced = induced[np.argsort(rank[of])]
        symbols = self.text[induced]
        turned = np.argsort(-symbols.astype(np.int64) if smaller else symbols, kind="stable")
        later = np.zeros(len(induced), RECORD)
        later["p"], later["c"] = induced[turned], symbols[turned]
        return out, later

    def _ranges(self, first: Tape | np.ndarray, first_at: np.ndarray, smaller: bool) -> tuple[Tape, np.ndarray]:
        """What sorted suffixes of one type induce of the other, a range of symbols at a time; first_at: borders of their symbols."""
        queue = SymbolQueue(self.symbols, self.folder, self.limit, min(self.symbols, 1024, 1 + len(self.text) // RANGE))
        out, at = Tape(self.folder, self.limit), np.zeros(self.symbols + 1, np.int64)
        turns = range(-(-self.symbols // queue.width))
        for turn in reversed(turns) if smaller else turns:
            low, high = turn * queue.width, min((turn + 1) * queue.width, self.symbols)
            come, (a, b) = queue.open(turn), first_at[[low, high]]
            rest = np.zeros(b - a, RECORD)
            rest["p"] = first.read(int(a), int(b))["p"][::-1] if smaller else first[a:b]
            symbols = np.arange(low, high)[:: -1 if smaller else 1]
            known, beyond = self._settled(come, rest, turn, queue.width, smaller)
            queue.push(beyond)
            counts = np.cumsum(np.bincount(known["c"] - low, minlength=high - low)[symbols - low])
            at[symbols if smaller else symbols + 1] = out.size + counts
            out.add(known)
        if smaller:
            at[self.symbols] = 0
        return out, at

    def sorted_starts(self) -> np.ndarray:
        """Starting suffixes in order (up to the depth, if there is one)."""
        starts = self.starts
        if len(starts) <= 1:
            return starts
        _, _, small, small_at = self.induce(starts[np.argsort(self.text[starts], kind="stable")], None)
        is_start = np.zeros(len(self.text), bool)
        is_start[starts] = True
        found = []
        for high in range(small.size, 0, -PART):
            p = small.read(max(0, high - PART), high)["p"][::-1]
            found.append(p[is_start[p]])
        order = np.concatenate([np.array([len(self.text) - 1]), *found])
        names = self._names(order)
        top = int(names[-1]) + 1
        of = np.empty(len(self.text), np.int32) if len(self.text) < 1 << 31 else np.empty(len(self.text), np.int64)
        of[order] = names
        reduced = of[starts]
        del of
        if top == len(starts):
            ranked = np.empty(len(starts), np.int64)
            ranked[reduced] = np.arange(len(starts))
        elif len(reduced) <= min(self.limit, SHORT):
            ranked = doubled(reduced, self.depth)
        else:
            ranked = Sorter(reduced, top, self.folder, self.limit, self.depth).order()
        return starts[ranked]

    def _names(self, order: np.ndarray) -> np.ndarray:
        """Equal substrings from one start to the next get equal names, in rising order."""
        ends = np.append(self.starts[1:], len(self.text))
        at = np.searchsorted(self.starts, order)
        length = ends[at] - order
        differs = np.zeros(len(order), bool)
        differs[0] = True
        for low in range(1, len(order), PART):
            a, b = order[low - 1 : low - 1 + PART][: len(order) - low], order[low : low + PART]
            left = length[low : low + PART].copy()
            unequal = length[low - 1 : low - 1 + PART][: len(b)] != left
            live = np.flatnonzero(~unequal)
            j = 0
            while len(live):  # the symbol after the substring is the first of the next one, so it is compared as well
                x, y = a[live] + j, b[live] + j
                inside = y < len(self.text)
                same = np.zeros(len(live), bool)
                same[inside] = self.text[x[inside]] == self.text[y[inside]]
                unequal[live[~same]] = True
                live = live[same & (left[live] > j)]
                j += 1
            differs[low : low + PART] = unequal
        return np.cumsum(differs) - 1

    def order(self) -> np.ndarray:
        """All suffixes in order."""
        large, large_at, small, small_at = self.induce(self.sorted_starts(), None)
        out, at = np.empty(len(self.text), np.int64), 1
        out[0] = len(self.text) - 1
        width = -(-self.symbols // 256)
        for low in range(0, self.symbols, width):
            high = min(low + width, self.symbols)
            rising, falling = large.read(*large_at[[low, high]].tolist())["p"], small.read(*small_at[[high, low]].tolist())["p"][::-1]
            both = np.concatenate([rising, falling])
            both = both[np.argsort(self.text[both], kind="stable")]
            out[at : at + len(both)] = both
            at += len(both)
        return out

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Suffixes in order, in parts, each with the length that it shares with the one before."""
        seeds = self.sorted_starts()
        large, large_at, small, small_at = self.induce(seeds, self._adjacent(seeds))
        yield np.array([len(self.text) - 1]), np.zeros(1, np.uint8)
        for symbol in range(self.symbols):
            last = None
            for low in range(int(large_at[symbol]), int(large_at[symbol + 1]), PART):
                part = large.read(low, min(low + PART, int(large_at[symbol + 1])))
                last = int(part["p"][-1])
                yield part["p"], part["l"]
            low, high = int(small_at[symbol + 1]), int(small_at[symbol])
            for end in range(high, low, -PART):
                start = max(low, end - PART)
                part = small.read(start, min(end + 1, high))  # one record more has the value that the last one needs
                values = np.append(part["l"][1:], np.uint8(0))[: end - start] if end == high else part["l"][1:]
                values = values.copy()
                p = part["p"][: end - start][::-1]
                if end == high:
                    values[-1] = 0 if last is None else self.common(last, int(p[0]))
                yield p, values[::-1]

    def _adjacent(self, order: np.ndarray) -> np.ndarray:
        """What sorted starting suffixes share with the one before, four symbols at a time."""
        out = np.zeros(len(order), np.uint8)
        padded = np.zeros(len(self.text) + self.depth + 8, "<u2")
        padded[: len(self.text)] = self.text
        words = np.ndarray((len(padded) - 3,), "<u8", padded, 0, (2,))
        for low in range(1, len(order), PART):
            a, b = order[low - 1 : low - 1 + PART][: len(order) - low], order[low : low + PART]
            shared = np.full(len(b), self.depth, np.int64)
            live = np.arange(len(b))
            for j in range(0, self.depth, 4):
                differ = words[a[live] + j] ^ words[b[live] + j]
                ended = differ != 0
                x = differ[ended]
                bits = (x & (~x + np.uint64(1))).astype(np.float64)  # the lowest bit that differs
                shared[live[ended]] = j + (np.frexp(bits)[1] - 1) // 16
                live = live[~ended]
                if not len(live):
                    break
            out[low : low + PART] = np.minimum(shared, self.depth)
        return out


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a short string in order, by prefix doubling of what isn't told apart yet; two symbols of text at least stand behind a name."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    first = np.append(True, names[order[1:]] != names[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        slots = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(slots) or reach >= n or depth and reach > depth:
            return order
        places = order[slots]
        after = places + reach
        key = rank[places] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        turn = np.argsort(key)
        places, key = places[turn], key[turn]
        order[slots] = places
        first[slots] = np.append(True, key[1:] != key[:-1])
        rank[places] = np.maximum.accumulate(np.where(first[slots], slots, 0))
        reach *= 2
