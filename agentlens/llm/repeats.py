"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of `LENGTH` bytes covers it that also starts in a
document with a smaller id. In terms of a suffix array over all documents: a
string goes if its longest previous factor, the longer of the common prefixes
with the previous and the next suffix in suffix order that come from a smaller
document, has `LENGTH` bytes or more. One array over a corpus fits no task, so
it is cut where equal strings can't be parted:

1. Every window of `LENGTH` bytes is dealt to the least of the hashes of its
   `K`-byte strings (its anchor). Neighbouring windows mostly share an anchor and
   make one context, so there are about 18 bytes to a context. Equal windows
   have equal anchors at equal places.
2. All documents, packed in parts: each part sends the names of its distinct
   contexts (24 bits and the fragment of the anchor, 40 of the context, 15 each
   of the bytes left and right of the anchor, 32 of the context by other powers
   and other numbers for its bytes) with their smallest document. A fragment
   finds contexts that an earlier document has as a whole: all their windows go.
   A window reaches `SIDE` bytes or more beyond its anchor on one side, so contexts
   that share one also share the name of a side; where others do, the first
   document of each context has to show its bytes.
3. These contexts meet by anchor. There their suffixes are put in order, with the
   common prefixes of neighbours, and for each suffix the previous and the next
   smaller document in that order give its longest previous factor, byte for byte.
4. The spans found are brought back to the parts, and each document is cut.

A part sends a context once, however many of its documents have it, so a passage
in a third of all documents is as many entries as there are parts. Parts are
written once, compressed, and travel as they are.

At 100 TB there are about 2 ** 83 pairs of contexts, and two different ones have the
same names with a chance of 2 ** -134 (24 bits tell fragments apart there, and at
least 15 + 32 bits come to the 64 of anchor and context), so one wrong removal is to be
expected in some 10 ** 15 such corpora.

Defined cases: a null text is empty; a text shorter than `LENGTH` keeps all; rows
with one id don't cover each other; a null id comes after all others (beside the
largest id there is, with which it counts as one document); other columns, whatever
their names, are ignored. Bytes that remain need not be UTF-8, so only digests of
them are returned beside the spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import dealt, table, text_bytes, whole_text, written

LENGTH, K = 50, 16
WINDOW = LENGTH - K + 1
SIDE = (LENGTH - K) // 2
PART_BYTES = 3_000_000
FRAGMENT_BYTES, SHOWN_BYTES = 8_000_000, 8_000_000  # of text to a fragment of the two exchanges
PIECE_BITS = 17
PIECE = 1 << PIECE_BITS
STEP = PIECE - 128
U = np.uint64
LAST = (1 << 63) - 1  # where a null id stands in the order; that it is null travels beside it



def powers(base: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(PIECE, base, U))])


BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # two independent hashes
POWERS, OTHER_POWERS = map(powers, BASES)
INVERSES, OTHER_INVERSES = (powers(pow(b, -1, 1 << 64)) for b in BASES)
BYTES, OTHER_BYTES = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) for seed in (50, 51))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(piece: np.ndarray, values: np.ndarray = BYTES, by: np.ndarray = POWERS) -> np.ndarray:
    """Sums of bytes times powers: the hash of piece[a:b] is (sums[b] - sums[a]) * INVERSES[a]."""
    sums = np.zeros(len(piece) + 1, U)
    np.cumsum(values[piece] * by[: len(piece)], out=sums[1:])
    return sums


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def anchor_places(data: np.ndarray) -> np.ndarray:
    """For every window start, the place of its anchor (the leftmost, among equals)."""
    n = len(data) - LENGTH + 1
    out = np.empty(max(n, 0), np.int32)
    low = U(PIECE - 1)
    for at in range(0, n, STEP):
        piece = data[at : at + PIECE]
        sums = prefix_sums(piece)
        m = len(piece) - K + 1
        h = mixed((sums[K:] - sums[:m]) * INVERSES[:m])
        h = (h & ~low) | np.arange(m, dtype=U)
        least = (least_of(h, WINDOW) & low).astype(np.int32)
        here = min(STEP, n - at)
        out[at : at + here] = least[:here] + at
    return out


class Contexts:
    """The contexts of one part: runs of windows with one anchor in one document."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        n = len(data) - LENGTH + 1
        self.start = self.last = self.doc = np.zeros(0, np.int64)
        self.anchor = self.name = np.zeros(0, U)
        self.rest = np.zeros(0, U)
        self.offset = np.zeros(0, np.int64)
        if n <= 0:
            return
        anchors = anchor_places(data)
        valid = np.zeros(len(data), bool)
        for a, b in zip(ends - lengths, ends):
            valid[a : max(a, b - LENGTH + 1)] = True
        valid = valid[:n]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (anchors[1:] != anchors[:-1])
        self.start = np.flatnonzero(fresh)
        over = valid.copy()
        over[:-1] &= ~valid[1:] | fresh[1:]
        self.last = np.flatnonzero(over)
        self.doc = np.searchsorted(ends, self.start, side="right")
        place = anchors[self.start].astype(np.int64)
        self.offset = place - self.start
        self.anchor, self.name = np.empty(len(place), U), np.empty(len(place), U)
        self.rest = np.empty(len(place), U)
        for at in range(0, n, STEP):
            a, b = np.searchsorted(self.start, [at, at + STEP])
            if a == b:
                continue
            sums = prefix_sums(data[at : at + PIECE])
            s, e, p = self.start[a:b] - at, self.last[a:b] - at + LENGTH, place[a:b] - at
            self.anchor[a:b] = mixed(mixed((sums[p + K] - sums[p]) * INVERSES[p]) + U(1))  # anew: the hashes that made anchors are small ones
            shape = (e - s).astype(U) * U(0xD6E8FEB86659FD93) + self.offset[a:b].astype(U) * U(0xA0761D6478BD642F)
            self.name[a:b] = mixed((sums[e] - sums[s]) * INVERSES[s] + shape)
            left, right = np.maximum(p - SIDE, 0), np.minimum(p + K + SIDE, len(sums) - 1)
            names = [(mixed((sums[j] - sums[i]) * INVERSES[i]) >> U(49)).astype(np.uint32) + 1 for i, j in ((left, p), (p + K, right))]
            sides = np.where(p - s >= SIDE, names[0], 0) << 16 | np.where(e - p - K >= SIDE, names[1], 0)  # 0: the side isn't that long
            other = prefix_sums(data[at : at + PIECE], OTHER_BYTES, OTHER_POWERS)
            self.rest[a:b] = sides.astype(U) << U(32) | mixed((other[e] - other[s]) * OTHER_INVERSES[s]) >> U(32)

    def entries(self, n_fragments: int):
        """Distinct contexts in order of fragment and name: (fragment, key, rest, owner's number, entry of each context)."""
        fragment = (((self.anchor >> U(32)) * U(n_fragments)) >> U(32)).astype(np.int32)
        key = (self.anchor << U(40)) | (self.name >> U(24))
        rest = self.rest
        order = np.argsort(key, kind="stable")  # contexts come by document, so the first of equals is the owner's
        order = order[np.argsort(fragment[order], kind="stable")]
        f, k, r = fragment[order], key[order], rest[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        return f[new], k[new], r[new], self.doc[order[new]], entry


PART = pa.schema([("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("data", pa.binary())])
PART_SQL = "part bigint, ids array<bigint>, lengths binary, data binary"
in_order = lambda i: LAST if i is None else i


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, text) as parts in order of their ids."""
    from pyspark import TaskContext

    task, count, size = TaskContext.get().partitionId(), 0, 0
    rows: list[tuple[int | None, bytes]] = []

    def part() -> pa.RecordBatch:
        rows.sort(key=lambda r: in_order(r[0]))
        data = b"".join(t for _, t in rows)
        lengths = np.array([len(t) for _, t in rows], np.int64)
        cols = [[(task << 32) + count], [[i for i, _ in rows]], [lengths.tobytes()], [zstandard.ZstdCompressor(level=3).compress(data)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PART)], schema=PART)

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            for i, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                rows.append((i, b := t.encode()))
                size += len(b)
                if size >= PART_BYTES or len(rows) >= 60_000:
                    yield part()
                    rows, size, count = [], 0, count + 1
    if rows:
        yield part()


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lengths, data) of a part."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(lengths.sum())))
    return np.array([in_order(i) for i in row["ids"]], np.int64), lengths, np.frombuffer(data, np.uint8)


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


NAMES = pa.schema([("fragment", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("rest", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary())])
NAMES_SQL = "fragment int, part bigint, keys binary, rest binary, owners binary, ids binary"


def name_contexts(n_fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths, data = unpacked(row)
                f, k, r, owner, _ = Contexts(data, lengths).entries(n_fragments)
                cuts = np.append(np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else [], len(f)).astype(np.int64)
                out = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    used, owners = np.unique(owner[a:b], return_inverse=True)
                    out.append((int(f[a]), row["part"], k[a:b].tobytes(), r[a:b].tobytes(), owners.astype(np.uint16).tobytes(), ids[used].tobytes()))
                yield from arrow_rows(out, NAMES).to_batches()

    return run


FLAGS = pa.schema([("part", pa.int64()), ("fragment", pa.int32()), ("flags", pa.binary())])
GONE, SHOW = 1, 2


def flag_contexts(group: pa.Table) -> pa.Table:
    """In one fragment: GONE, if an earlier document than any of the part's has the whole context; SHOW, if it is first with the context, and another document with one that shares the anchor and a side."""
    rows = group.to_pylist()
    key = np.concatenate([np.frombuffer(r["keys"], U) for r in rows])
    rest = np.concatenate([np.frombuffer(r["rest"], U) for r in rows])
    owner = np.concatenate([np.frombuffer(r["ids"], np.int64)[np.frombuffer(r["owners"], np.uint16)] for r in rows])
    order = np.lexsort((owner, rest, key))
    k, r, o = key[order], rest[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    first = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    show = np.zeros(len(k), bool)
    for side in (r >> U(48), r >> U(32) & U(0xFFFF)):
        # contexts of one anchor and side; they matter to each other if more than one document is first with one
        own = np.flatnonzero((o == first) & (side > 0))
        by = own[np.lexsort((side[own], k[own] >> U(40)))]
        a, x, f = k[by] >> U(40), side[by], o[by]
        if not len(by):
            continue
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (x[1:] != x[:-1])]))
        several = np.minimum.reduceat(f, start) < np.maximum.reduceat(f, start)
        show[by[np.repeat(several, np.diff(np.append(start, len(by))))]] = True
    flags = np.empty(len(k), np.uint8)
    flags[order] = np.where(o > first, GONE, np.where(show, SHOW, 0))
    cuts = np.concatenate([[0], np.cumsum([len(x["keys"]) // 8 for x in rows])])
    return arrow_rows([(x["part"], x["fragment"], flags[i:j].tobytes()) for x, i, j in zip(rows, cuts[:-1], cuts[1:])], FLAGS)


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of spans in order of their starts."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of spans, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


SHOWN = pa.schema([("fragment", pa.int32()), ("part", pa.int64()), *[(c, pa.binary()) for c in ("starts", "ends", "anchors", "owners", "bytes")]])
SHOWN_SQL = "fragment int, part bigint, starts binary, ends binary, anchors binary, owners binary, bytes binary"


def show_contexts(n_fragments: int, n_shown: int):
    """For a part: a row of the spans that go already (without bytes), and rows of contexts to be compared."""

    def run(parts: pa.Table, flags: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in parts.to_pylist():
            ids, lengths, data = unpacked(row)
            found = Contexts(data, lengths)
            _, _, _, owner, entry = found.entries(n_fragments)
            told = sorted(flags.to_pylist(), key=lambda x: x["fragment"])
            flag = np.frombuffer(b"".join(x["flags"] for x in told), np.uint8)[entry]
            own = ids[owner][entry]
            gone = (flag == GONE) | (ids[found.doc] > own) if len(entry) else np.zeros(0, bool)
            starts, ends = union_of(found.start[gone], found.last[gone] + LENGTH)
            out.append((row["part"] % n_shown, row["part"], starts.astype(np.uint32).tobytes(), ends.astype(np.uint32).tobytes(), None, None, None))
            show = np.flatnonzero((flag == SHOW) & ~gone)
            target = (found.anchor[show] % U(n_shown)).astype(np.int64)
            show = show[np.argsort(target, kind="stable")]
            target = np.sort(target)
            for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.diff(target, prepend=-1)), len(target)))):
                own = show[a:b]
                s, e = found.start[own], found.last[own] + LENGTH
                out.append((int(target[a]), row["part"], s.astype(np.uint32).tobytes(), e.astype(np.uint32).tobytes(), found.anchor[own].tobytes(), ids[found.doc[own]].tobytes(), data[ranges(s, e - s)].tobytes()))
        return arrow_rows(out, SHOWN)

    return run


SPANS = pa.schema([("part", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])
AT_ONCE = 150_000  # suffixes put in order together, if one anchor hasn't more
WIDEST = LENGTH + WINDOW - 1  # bytes of a context at most
COLUMNS = -(-WIDEST // 8)


def suffix_order(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes by anchor and bytes, and the length of the common prefix of each with the one before it."""
    padded = np.zeros((len(starts), 8 * COLUMNS), np.uint8)
    inside = np.arange(8 * COLUMNS) < lengths[:, None]
    padded[inside] = data[(starts[:, None] + np.arange(8 * COLUMNS))[inside]]
    words = padded.view(">u8").astype(U)
    order = np.lexsort((lengths, *words.T[::-1], anchors))
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        left, right = order[:-1], order[1:]
        same = padded[left] == padded[right]
        length = np.where(same.all(axis=1), 8 * COLUMNS, same.argmin(axis=1))
        common[1:] = np.where(anchors[left] == anchors[right], np.minimum(length, np.minimum(lengths[left], lengths[right])), 0)
    return order, common


def smaller_before(owners: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place, the length of the common prefix with the nearest place before it that has a smaller owner (0 if none).

    Both minima, of owners and of common prefixes, are kept over the 2 ** j places before each one, and the way to
    the smaller owner is taken in such steps, the widest first.
    """
    n = len(owners)
    least, lcp = [owners], [common]  # over places i - 2 ** j + 1 .. i
    step = 1
    while step < n:
        a, c = least[-1], lcp[-1]
        least.append(np.concatenate([a[:step], np.minimum(a[step:], a[:-step])]))
        lcp.append(np.concatenate([np.minimum(c[:step], 0), np.minimum(c[step:], c[:-step])]))
        step *= 2
    at = np.arange(n) - 1  # everything after `at`, up to the place itself, is no smaller
    shared = common.copy()
    for j in range(len(least) - 1, -1, -1):
        able = at >= (1 << j) - 1
        over = able & (least[j][np.maximum(at, 0)] >= owners)
        shared[over] = np.minimum(shared[over], lcp[j][at[over]])
        at[over] -= 1 << j
    return np.where(at >= 0, shared, 0)


def previous_factors(owners: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in suffix order: the longer of the common prefixes with the previous and the next one of a smaller document."""
    before = smaller_before(owners, common)
    after = smaller_before(owners[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
    return np.maximum(before, after)


def compare_contexts(group: pa.Table) -> pa.Table:
    """In one fragment: spans of the factors that an earlier document has. Rows without bytes pass."""
    rows = group.to_pylist()
    out = [(r["part"], r["starts"], r["ends"]) for r in rows if r["bytes"] is None]
    rows = [r for r in rows if r["bytes"] is not None]
    if not rows:
        return arrow_rows(out, SPANS)
    start = np.concatenate([np.frombuffer(r["starts"], np.uint32) for r in rows]).astype(np.int64)
    end = np.concatenate([np.frombuffer(r["ends"], np.uint32) for r in rows]).astype(np.int64)
    anchor = np.concatenate([np.frombuffer(r["anchors"], U) for r in rows])
    owner = np.concatenate([np.frombuffer(r["owners"], np.int64) for r in rows])
    part = np.repeat(np.arange(len(rows)), [len(r["starts"]) // 4 for r in rows])
    data = np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows])
    at = np.cumsum(end - start) - (end - start)
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    # an anchor with one document alone has nothing earlier
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    width = np.diff(np.append(first, len(a)))
    low, high = np.minimum.reduceat(owner[order], first), np.maximum.reduceat(owner[order], first)
    order = order[np.repeat(low < high, width)]
    n_windows = (end - start)[order] - LENGTH + 1
    a = anchor[order]
    cut, total, found = [0], 0, []
    ends_of = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)) if len(a) else np.zeros(0, np.int64)
    sums = np.cumsum(n_windows)
    for stop in ends_of:
        if sums[stop - 1] - total >= AT_ONCE or stop == len(a):
            cut.append(int(stop))
            total = sums[stop - 1]
    for x, y in zip(cut[:-1], cut[1:]):
        own, n = order[x:y], n_windows[x:y]
        places = ranges(at[own], n)
        heads = np.zeros((len(places), 56), np.uint8)
        heads[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[places]
        names = np.repeat(anchor[own], n)
        # most suffixes share `LENGTH` bytes with no other; a hash leaves those out of the order, whose long factors stay the same
        h = mixed((heads.view(U) * POWERS[1:8]).sum(axis=1) + names)
        by = np.argsort(h, kind="stable")
        same = np.zeros(len(h), bool)
        same[1:] = h[by][1:] == h[by][:-1]
        same[:-1] |= same[1:].copy()
        some = np.sort(by[same])
        if not len(some):
            continue
        lengths = (np.repeat((at + end - start)[own], n) - places)[some]
        by, common = suffix_order(data, places[some], lengths, names[some])
        factors = np.empty(len(some), np.int64)
        factors[by] = previous_factors(np.repeat(owner[own], n)[some][by], common)
        long = factors >= LENGTH
        hit = some[long]
        found.append(np.stack([np.repeat(part[own], n)[hit], (places + np.repeat(start[own] - at[own], n))[hit], factors[long]]))
    if found:
        p, s, length = np.concatenate(found, axis=1)
        by = np.lexsort((s, p))
        p, s, length = p[by], s[by], length[by]
        for x, y in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.diff(p, prepend=-1)), len(p)))):
            b, e = union_of(s[x:y], s[x:y] + length[x:y])
            out.append((rows[p[x]]["part"], b.astype(np.uint32).tobytes(), e.astype(np.uint32).tobytes()))
    return arrow_rows(out, SPANS)


RESULT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,`end`:bigint>>"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def cut_parts(parts: pa.Table, spans: pa.Table) -> pa.Table:
    """Each document of a part without the bytes of its spans."""
    out: list[tuple] = []
    for row in parts.to_pylist():
        ids, lengths, data = unpacked(row)
        change = np.zeros(len(data) + 1, np.int32)
        for x in spans.to_pylist():
            np.add.at(change, np.frombuffer(x["starts"], np.uint32), 1)
            np.add.at(change, np.frombuffer(x["ends"], np.uint32), -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        end = 0
        for i, length in zip(row["ids"], lengths.tolist()):
            begin, end = end, end + length
            own = gone[begin:end]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            kept = data[begin:end] if not len(edges) else data[begin:end][~own]
            told = [{"start": int(a), "end": int(b)} for a, b in edges]
            out.append((i, length, int((edges[:, 1] - edges[:, 0]).sum()), len(edges), hashlib.sha256(kept.tobytes()).hexdigest(), told))
    return arrow_rows(out, RESULT)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed bytes of each document."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    total = text_bytes(rows)
    n_fragments, n_shown = max(1, -(-total // FRAGMENT_BYTES)), max(1, -(-total // SHOWN_BYTES))
    parts = written(rows.mapInArrow(pack, PART_SQL))
    flags = dealt(parts.mapInArrow(name_contexts(n_fragments), NAMES_SQL), n_fragments).groupBy("fragment").applyInArrow(flag_contexts, "part bigint, fragment int, flags binary")
    shown = parts.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(show_contexts(n_fragments, n_shown), SHOWN_SQL)
    spans = dealt(shown, n_shown).groupBy("fragment").applyInArrow(compare_contexts, "part bigint, starts binary, ends binary")
    cut = parts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(cut_parts, RESULT_SQL)
    return cut.withColumnRenamed("doc_id", key)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")
