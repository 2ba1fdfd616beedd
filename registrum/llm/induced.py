"""External induced suffix sorting of one shard, with common-prefix values.

Suffixes are typed (S: smaller than the next, L: larger). The S suffixes after an L suffix are the sample: their substrings
are named in order by external sorting, and names are doubled until they span depth characters or differ (in place of a call
on the shortened text: its alphabet of many names would make as many queues, which numpy scans too slowly). The sorted sample
then induces all L suffixes in an ascending scan and all S suffixes in a descending one. A scan reads queues, one for each
character, and writes (position, common prefix) tuples to them; common prefixes follow as one more than the least value
scanned since the queue's last entry.

Queues hold MEMORY bytes and put the rest in a file; text, types, names and orders are arrays of a Scratch, in memory up to
ARRAYS bytes and mapped files beyond; sorting and scanning take RUN and BATCH entries at once. So memory has a bound that
doesn't depend on the shard. Files are unlinked when they are opened, so they vanish with the task, however it ends.

Order and common prefixes are exact up to depth characters; suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples that all queues of a scan hold in memory, bytes of other arrays, tuples scanned at once, and names sorted at once.
MEMORY, ARRAYS, BATCH, RUN = 8 << 20, 16 << 20, 1 << 17, 1 << 18


def _file():
    """A nameless file in the folder that Spark gives its tasks for spills."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=local if local and os.path.isdir(local) else None)


class Scratch:
    """Arrays of one sort: in memory up to a budget, then mapped files."""

    def __init__(self, memory: int = ARRAYS):
        self.memory, self.mapped = memory, 0

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.memory:
            self.memory -= size
            return np.zeros(n, dtype)
        self.mapped += size
        with _file() as f:
            f.truncate(size)
            return np.memmap(f, dtype, "r+", shape=(n,))


class Queues:
    """First-in-first-out queues of (position, common prefix) by character; the largest go to a file when memory is short."""

    def __init__(self, memory: int):
        self.memory, self.held, self.parts, self.file, self.end = memory, 0, {}, None, 0

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if len(pos):
            pos, lcp = pos.astype(np.int32), lcp.astype(np.int32)
            self.parts.setdefault(c, []).append((pos, lcp))
            self.held += pos.nbytes + lcp.nbytes
            if self.held > self.memory:
                self.spill()

    def spill(self) -> None:
        """Writes what the largest queues hold in memory; a queue's written entries are its first ones."""
        live = {c: sum(p[0].nbytes * 2 for p in parts if not isinstance(p[0], int)) for c, parts in self.parts.items()}
        self.file = self.file or _file()
        for c in sorted(live, key=live.get, reverse=True):
            if self.held <= self.memory // 2 or not live[c]:
                break
            parts = self.parts[c]
            kept = [p for p in parts if isinstance(p[0], int)]
            pos, lcp = (np.concatenate([p[k] for p in parts if not isinstance(p[0], int)]) for k in (0, 1))
            for a in range(0, len(pos), BATCH):
                p, v = pos[a : a + BATCH], lcp[a : a + BATCH]
                os.pwrite(self.file.fileno(), p.tobytes() + v.tobytes(), self.end)
                kept.append((self.end, len(p)))
                self.end += 8 * len(p)
            self.parts[c] = kept
            self.held -= live[c]

    def has(self, c: int) -> bool:
        return c in self.parts

    def take(self, c: int, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empties queue c: its entries in parts of about BATCH; back: the last part first."""
        parts = self.parts.pop(c, [])
        self.held -= sum(p[0].nbytes * 2 for p in parts if not isinstance(p[0], int))
        some, size = [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            one = some[::-1] if back else some
            return np.concatenate([p for p, _ in one]), np.concatenate([v for _, v in one])

        for a, b in reversed(parts) if back else parts:
            if isinstance(a, int):
                both = np.frombuffer(os.pread(self.file.fileno(), 8 * b, a), np.int32)
                a, b = both[:b], both[b:]
            some.append((a, b))
            size += len(a)
            if size >= BATCH:
                yield joined()
                some, size = [], 0
        if some:
            yield joined()

    def close(self) -> None:
        self.parts.clear()
        if self.file:
            self.file.close()


class _Scan:
    """One scan's running minima: what each character's next entry shares with its last one."""

    def __init__(self, depth: int, chars: int):
        self.depth = depth
        self.since = np.zeros(chars, np.int32)  # least common prefix since the last entry; 0: none yet

    def read(self, lcp: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """lcp of each scanned entry with the one before; target: its character to induce, -1: none. Gives character, places, common prefixes."""
        n = len(lcp)
        rows = np.flatnonzero(target >= 0)
        rows = rows[np.argsort(target[rows], kind="stable")]
        c = target[rows]
        levels = [lcp]
        while 1 << len(levels) <= n:
            a, w = levels[-1], 1 << (len(levels) - 1)
            levels.append(np.minimum(a[:-w], a[w:]))

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Least of lcp[a..b], a <= b."""
            k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
            out = np.empty(len(a), np.int32)
            for x in np.unique(k):
                m = k == x
                out[m] = np.minimum(levels[x][a[m]], levels[x][b[m] - (1 << int(x)) + 1])
            return out

        if len(rows):
            first = np.concatenate([[True], c[1:] != c[:-1]])
            begin = np.where(first, 0, np.concatenate([[0], rows[:-1] + 1]))
            low = least(begin, rows)
            low = np.where(first, np.minimum(low, self.since[c]), low)
            # since is 0 before a character's first entry, so that entry gets 0 + 1 and starts its bucket
            shared = np.minimum(low + 1, self.depth).astype(np.int32)
        whole = int(lcp.min()) if n else self.depth
        np.minimum(self.since, whole, out=self.since)
        if len(rows):
            last = np.flatnonzero(np.concatenate([c[1:] != c[:-1], [True]]))
            ends = rows[last]
            tail = np.full(len(last), self.depth, np.int32)
            some = ends < n - 1
            if some.any():
                tail[some] = least(ends[some] + 1, np.full(int(some.sum()), n - 1))
            self.since[c[last]] = tail
            for a, b in zip(np.flatnonzero(first), last + 1):
                yield int(c[a]), rows[a:b], shared[a:b]


def _agree(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, known: np.ndarray | None = None) -> np.ndarray:
    """Common prefixes of suffix pairs, up to depth; known: characters known to agree."""
    out = np.zeros(len(a), np.int32) if known is None else np.minimum(known, depth).astype(np.int32)
    live = np.flatnonzero(out < depth)
    n = len(t)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        ok[ok] = t[x[ok]] == t[y[ok]]
        live = live[ok]
        out[live] += 1
        live = live[out[live] < depth]
    return out


def _blocks(n: int, size: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + size)) for a in range(0, n, size))


class _Sort:
    """One sort: text with its end mark, types, sample."""

    def __init__(self, text: np.ndarray, depth: int, scratch: Scratch):
        self.depth, self.scratch = depth, scratch
        self.n = n = len(text) + 1
        self.t = scratch.array(n, np.uint16)
        for a, b in _blocks(n - 1, RUN):
            self.t[a:b] = text[a:b]
            self.t[a:b] += 1
        self.chars = max((int(self.t[a:b].max()) for a, b in _blocks(n, RUN))) + 1
        self.small = self.types()
        self.sample = self.starts()

    def types(self) -> np.ndarray:
        small, z = self.scratch.array(self.n, np.bool_), self.n - 1
        small[z] = True
        while z > 0:
            a = max(0, z - RUN)
            x = self.t[a : z + 1].astype(np.int32)
            up = np.sign(x[1:] - x[:-1])
            near = np.minimum.accumulate(np.where(up != 0, np.arange(z - a), z - a)[::-1])[::-1]
            small[a:z] = np.where(near < z - a, up[np.minimum(near, z - a - 1)] > 0, small[z])
            z = a
        return small

    def starts(self) -> np.ndarray:
        """Places of the sample, in text order."""
        of = lambda a, b: np.flatnonzero(self.small[a + 1 : b + 1] & ~self.small[a:b]) + a + 1
        out = self.scratch.array(sum(len(of(a, b)) for a, b in _blocks(self.n - 1, RUN)), np.int32)
        k = 0
        for a, b in _blocks(self.n - 1, RUN):
            p = of(a, b)
            out[k : k + len(p)] = p
            k += len(p)
        return out

    def order(self, key: np.ndarray) -> np.ndarray:
        """Indexes by key. Sorted runs, then one merge of blocks of all runs."""
        m = len(key)
        idx = self.scratch.array(m, np.int32)
        for a, b in _blocks(m, RUN):
            idx[a:b] = a + np.argsort(key[a:b])
        if m <= RUN:
            return idx
        runs, out, w = [list(x) for x in _blocks(m, RUN)], self.scratch.array(m, np.int32), 0
        block = max(256, RUN // len(runs))
        while runs:
            held = [np.array(idx[a : min(b, a + block)]) for a, b in runs]
            keys = [key[h] for h in held]
            most, got = min(int(k[-1]) for k in keys), []
            for r, h, k in zip(runs, held, keys):
                take = int(np.searchsorted(k, most, "right"))
                got.append(h[:take])
                r[0] += take
            got = np.concatenate(got)
            out[w : w + len(got)] = got[np.argsort(key[got])]
            w += len(got)
            runs = [r for r in runs if r[0] < r[1]]
        return out

    def renamed(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Ranks of keys, the order, and how many ranks there are."""
        idx = self.order(key)
        out, rank, before = self.scratch.array(len(key), np.int32), 0, None
        for a, b in _blocks(len(idx), RUN):
            p = np.array(idx[a:b])
            x = np.array(key[p])
            ranks = rank + np.cumsum(np.concatenate([[before is not None and before != x[0]], x[1:] != x[:-1]]))
            out[p] = ranks
            rank, before = int(ranks[-1]), x[-1]
        return out, idx, rank + 1

    def names(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Names of runs of 1, 2, 4 ... sample substrings; the order by the last, which ranks the suffixes by their first depth characters."""
        m, n, sample = len(self.sample), self.n, self.sample
        name, idx, ranks, at = self.scratch.array(m, np.int32), np.arange(m), 1, 0
        key = self.scratch.array(m, np.int64)
        while True:
            some = False
            for a, b in _blocks(m, RUN):
                begin = sample[a:b].astype(np.int64)
                end = np.concatenate([sample[a + 1 : b + 1], [n - 1] if b == m else []]).astype(np.int64)
                word, live = np.zeros(b - a, np.int64), begin + at <= end
                for k in range(3):
                    p = np.minimum(begin + at + k, n - 1)
                    word = (word << 10) | np.where(begin + at + k <= end, (self.t[p].astype(np.int64) << 1 | self.small[p]) + 1, 0)
                key[a:b] = name[a:b].astype(np.int64) << 31 | np.where(live, word, 0)
                some |= bool(live.any())
            if not some:
                break
            name, idx, ranks = self.renamed(key)
            at += 3
        levels, span = [name], 2  # a sample substring has two characters at least, but for the last
        while span < 2 * self.depth and ranks < m:
            step = 1 << (len(levels) - 1)
            for a, b in _blocks(m, RUN):
                after = np.zeros(b - a, np.int64)
                part = name[a + step : b + step]
                after[: len(part)] = part
                after[: len(part)] += 1
                key[a:b] = name[a:b].astype(np.int64) << 31 | after
            name, idx, ranks = self.renamed(key)
            levels.append(name)
            span *= 2
        return levels, idx

    def shared(self, levels: list[np.ndarray], idx: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours in order: doubled names skip what they prove equal."""
        m, out = len(idx), self.scratch.array(len(idx), np.int32)
        for x, y in _blocks(m - 1, RUN):
            one, two = idx[x:y].astype(np.int64), idx[x + 1 : y + 1].astype(np.int64)
            a, b = one.copy(), two.copy()
            for k in range(len(levels) - 1, -1, -1):
                step, name = 1 << k, levels[k]
                ok = (a + step < m) & (b + step < m)
                ok[ok] = name[a[ok]] == name[b[ok]]
                a[ok] += step
                b[ok] += step
            known = self.sample[a] - self.sample[one]
            out[x + 1 : y + 1] = _agree(self.t, self.sample[one].astype(np.int64), self.sample[two].astype(np.int64), self.depth, known)
        return out


def suffixes(text: np.ndarray, depth: int, memory: int = MEMORY, scratch: Scratch | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of text's suffixes from the last to the first, part by part, and what each shares with the one before (the next
    larger), both up to depth. text: small integers, over which suffixes of the end mark are left out."""
    s = _Sort(text, depth, scratch or Scratch())
    t, n, small, chars = s.t, s.n, s.small, s.chars
    levels, idx = s.names()
    shared = s.shared(levels, idx)
    del levels
    order, count = s.scratch.array(len(idx), np.int32), np.zeros(chars, np.int64)
    for a, b in _blocks(len(idx), RUN):
        order[a:b] = s.sample[idx[a:b]]
        count += np.bincount(t[order[a:b]], minlength=chars)
    bounds = np.concatenate([[0], np.cumsum(count)])

    def seam(a: int, b: int) -> int:
        return int(_agree(t, np.array([a]), np.array([b]), depth)[0])

    def induce(scan: _Scan, q: Queues, pos: np.ndarray, lcp: np.ndarray, want: bool) -> None:
        """Scans entries; predecessors of the wanted type go to q."""
        for a, b in _blocks(len(pos), BATCH):
            p, v = pos[a:b].astype(np.int64), lcp[a:b]
            before = np.maximum(p - 1, 0)
            target = np.where((p > 0) & (small[before] == want), t[before].astype(np.int64), -1)
            for c, rows, low in scan.read(v, target):
                q.put(c, before[rows], low)

    q, larger, scan = Queues(memory), Queues(memory), _Scan(depth, chars)
    try:
        for c in range(chars):
            last = None
            while q.has(c):
                for pos, lcp in q.take(c):
                    if last is None:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    larger.put(c, pos, lcp)
                    last = int(pos[-1])
                    induce(scan, q, pos, lcp, False)
            for a, b in _blocks(int(bounds[c + 1] - bounds[c]), BATCH):
                a, b = a + int(bounds[c]), b + int(bounds[c])
                lcp = np.array(shared[a:b])
                if a == bounds[c]:
                    lcp[0] = seam(last, int(order[a])) if last is not None else 0
                induce(scan, q, order[a:b], lcp, False)
        q.close()
        q, scan = Queues(memory), _Scan(depth, chars)
        q.put(0, np.array([n - 1]), np.zeros(1, np.int32))
        for c in range(chars - 1, -1, -1):
            last = None
            while q.has(c):
                for pos, lcp in q.take(c):
                    if last is None:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    last = int(pos[-1])
                    if c:
                        yield pos.astype(np.int64), lcp
                    induce(scan, q, pos, lcp, True)
            after = None  # what the entry before, the next larger, shares with its next smaller one
            for pos, up in larger.take(c, back=True):
                if after is None:
                    after = seam(int(pos[-1]), last) if last is not None else 0
                pos, lcp = pos[::-1], np.concatenate([[after], up[:0:-1]]).astype(np.int32)
                after = int(up[0])
                induce(scan, q, pos, lcp, True)
                yield pos.astype(np.int64), lcp
    finally:
        q.close()
        larger.close()


def suffix_array(text: np.ndarray, depth: int, memory: int = MEMORY, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same from the first to the last, whole, each with what it shares with the next smaller one."""
    parts = [*suffixes(text, depth, memory, scratch)]
    pos = np.concatenate([p for p, _ in parts] or [np.zeros(0, np.int64)])[::-1]
    down = np.concatenate([v for _, v in parts] or [np.zeros(0, np.int32)])
    return pos, np.concatenate([[0] * bool(len(pos)), down[:0:-1]]).astype(np.int32)
