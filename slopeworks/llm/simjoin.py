"""Exact Jaccard links of shingle sets by universe partition and pigeonhole, and their components.

Two sets of sizes r <= s with Jaccard at least 3/4 differ in at most H = (r + s) / 7 shingles. The
universe of shingles is partitioned by hash into segments, as many as a set's size band calls for; a set
has a subset in each segment that it fills, at the segments of its own band and, for its smaller partners, of
the next band down. Each differing shingle spoils at most one subset of either set. So if one of the two
fills more than H segments, they have a subset in common, and the first of those in an order that is the same for all sets is among
the first H + 1 of each. Only these are indexed. The order is the allocation's cost: the subsets with the most
shingles that are not crowded come first, as their lists are the shortest. Each task counts its shingles in a table of
fixed size, and what stands out in any of them is crowded; this bears on cost alone.

A set that fills only F <= H segments indexes all its subsets and their one-deletion neighbourhoods, the
subsets less one shingle. It allots a second unit to H + 1 - F of its segments of least cost: of two
such sets, one segment of those differs by at most one shingle or another by none, so that one's subset
is the other's or in its neighbourhood. Where too few segments hold two shingles for that, the set
indexes and probes its single shingles as well. Small bands have segments of single shingles at once.

Subsets are shuffled as compact blocks per bucket of their hash. Within a bucket, sets that share a
subset become candidates; candidates are screened by
parity sketches, which bound their difference from below, and verified on their whole sets. A subset that many sets share
is not expanded into all pairs: all are compared with its first set, and of sets that are still in
different components only those are then verified whose sketches allow a link, the nearest ones first. Copies are one set throughout.
Of a subset that a task finds in very many sets only the first goes to its bucket; the task's list goes past it and joins the subset's
other lists by name, so no bucket gathers them.

Identities of words, shingles and sets are 64-bit hashes; where copies are classes by themselves, sets are told by 128 bits.

Defined cases: a null or empty text has no shingles and is its own component; a text of one to four
words is one shingle; a null id counts as greater than any other; ties cannot occur, as a component
takes its smallest id; repeated rows are copies; an empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm import base, graph, words as W

WIDTH = 5
#: Sets in a subset's list up to which all its pairs are candidates at once.
SMALL = 3
#: Shingles for each bucket of the index.
BUCKET = 1_600_000
#: Documents whose ids may be broadcast to find their texts; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Subset hashes a task gathers before it emits a block for each bucket.
GATHERED = 2_000_000
#: Sets of a task with one subset from which on only their first goes to its bucket, and cells that these are told in.
HOT, HOT_CELLS = 10_000, 1 << 18
#: Sets that a task remembers to index copies once.
REMEMBERED = 500_000
#: Sets of a long list that are compared with as many others at once, and words of sketches that a comparison holds.
CHUNK, SCREENED = 4096, 1 << 22
#: Cells that shingles are counted in to tell crowded ones: a bit each is broadcast, whatever the corpus's size.
CELLS = 1 << 22
#: Mean shingles in a segment, by the largest size of a band.
LOADS = ((32, None), (128, 1.9), (512, 2.2), (1 << 62, 2.4))


def _bands() -> tuple[np.ndarray, np.ndarray]:
    """Largest size of each band (a partner of a band's set is in the same or the next one), and its segments (0: one a shingle)."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, 16 * tops[-1] // 9))
    segments = [next(0 if load is None else -(-top // load) for most, load in LOADS if top <= most) for top in tops]
    return np.array(tops, np.int64), np.array(segments, np.uint64)


TOPS, SEGMENTS = _bands()


def sets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingles, sorted within each row, and each row's first one with the total at the end."""
    n = len(column)
    found = W.words(*W.flat(column), fold=True)
    key, where = W.windows(found, WIDTH)
    row = found.row[where]
    few = np.flatnonzero((found.counts > 0) & (found.counts < WIDTH))
    if len(few):
        whole = []
        for r in few.tolist():
            h = np.uint64(found.counts[r])
            for w in found.hash[found.first[r] : found.first[r + 1]]:
                h = W.mix(np.array([h], np.uint64) * np.uint64(31) + w)[0]
            whole.append(h)
        key, row = np.concatenate((key, np.array(whole, np.uint64))), np.concatenate((row, few))
    order = np.argsort(key)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 65536 else np.int64), kind="stable")]
    key, row = key[order], row[order]
    if len(key):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        key, row = key[fresh], row[fresh]
    return key, np.searchsorted(row, np.arange(n + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values, 0 for an empty row."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def digests(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(first).astype(np.uint64)
    return W.mix(_sums(W.mix(key + np.uint64(1)), first) + size).astype(np.int64), W.mix(_sums(W.mix(key ^ np.uint64(0x5BD1E9955BD1E995)), first)).astype(np.int64)


def crowded_cells(counts: np.ndarray) -> np.ndarray:
    """Cells of a task's shingle counts that stand out from what chance puts in a cell."""
    mean = counts.mean(dtype=np.float64)
    return np.flatnonzero(counts > mean + 6 * mean**0.5 + 4)


_MEMBER = ("id", "n", "one", "two", "cell")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: size and digests of its set; then a row for each crowded cell of the task."""
    counts, kind = np.zeros(CELLS, np.uint32), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in base.parts(batch.column(1)):
            key, first = sets_of(batch.column(1).slice(a, b - a))
            counts += np.bincount((key % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            one, two = digests(key, first)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(one), pa.array(two), pa.nulls(b - a, pa.int64())], names=_MEMBER)
    cells = crowded_cells(counts)
    if len(cells):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), kind), *(pa.nulls(len(cells), pa.int64()) for _ in range(3)), pa.array(cells, pa.int64())], names=_MEMBER)


def _crowd(cells: DataFrame) -> bytes:
    """The bitmap of all tasks' crowded cells, put together in words of 64 bits before it comes to the driver."""
    words = cells.groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits")).collect()
    bits = np.zeros(CELLS // 64, np.int64)
    bits[[r["word"] for r in words]] = [r["bits"] for r in words]
    return bits.astype("<i8").tobytes()


def _level(key: np.ndarray, first: np.ndarray, band: np.ndarray, own: bool, crowd: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes that each row indexes at a band (-1: none), the row of each, and whether it is a probe.

    Two rows are candidates if they have a hash in common that is a probe of one of them.
    """
    size = np.where(band >= 0, np.diff(first), 0)
    row = np.repeat(np.arange(len(size)), np.diff(first))
    if (band < 0).any():
        there = band[row] >= 0
        key, row = key[there], row[there]
    if not len(key):
        return np.zeros(0, np.uint64), row, np.zeros(0, bool)
    segments = SEGMENTS[band][row]
    place = ((key >> np.uint64(32)) * segments) >> np.uint64(32)
    begins = np.ones(len(key), bool)
    begins[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (segments[1:] == 0)
    starts = np.flatnonzero(begins)
    filled = np.diff(np.append(starts, len(key)))
    rows = row[starts]
    value = W.mix(key + np.uint64(7))
    total = np.add.reduceat(value, starts) + (band[rows].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)  # the last term tells bands apart
    hashes = W.mix(total)
    n_filled = np.bincount(rows, minlength=len(size))
    # one more than the shingles that a partner can differ in: at its own band one of up to a third more, below it one no larger than that band
    least = (size + (4 * size // 3 if own else np.minimum(size, TOPS[band]))) // 7 + 1
    # cost: a subset of crowded shingles only has a long list; else the more that are not, the shorter it is
    sparse = np.add.reduceat(~crowd[(key % np.uint64(CELLS)).astype(np.int64)], starts, dtype=np.int64) if crowd is not None else filled
    order = np.lexsort((hashes, -filled, -sparse, rows))
    rank = np.empty(len(starts), np.int64)
    rank[order] = np.arange(len(starts)) - np.repeat(np.cumsum(n_filled) - n_filled, n_filled)
    chosen = rank < least[rows]
    found = [(hashes[chosen], rows[chosen], np.ones(int(chosen.sum()), bool))]
    short = n_filled < least
    if short.any():
        several = short[rows] & (filled > 1)
        # the segments with a second unit: the first ones of several shingles in the same order
        among = order[several[order]]
        n_several = np.bincount(rows[several], minlength=len(size))
        place_of = np.arange(len(among)) - np.repeat(np.cumsum(n_several) - n_several, n_several)
        second = np.zeros(len(starts), bool)
        second[among] = place_of < (least - n_filled)[rows[among]]
        segment = np.repeat(np.arange(len(starts)), filled)
        mine = several[segment]
        found.append((W.mix(total[segment[mine]] - value[mine]), row[mine], second[segment[mine]]))
        single = (short & (n_several < least - n_filled))[row]
        singles = W.mix(key[single] + (band[row[single]].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        found.append((singles, row[single], np.ones(len(singles), bool)))
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(key: np.ndarray, first: np.ndarray, crowd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    band = np.where(np.diff(first) > 0, np.searchsorted(TOPS, np.diff(first)), -1)
    below = np.maximum(band, 0) - 1
    below = np.where(3 * np.diff(first) <= 4 * TOPS[below], below, -1)  # no partner is there for a set too large for that band's sets
    levels = [_level(key, first, band, True, crowd), _level(key, first, below, False, crowd)]
    return tuple(np.concatenate(x) for x in zip(*levels))


def _only(wanted: np.ndarray, key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the wanted rows."""
    size = np.diff(first)
    return key[np.repeat(wanted, size)], np.concatenate(([0], np.cumsum(size[wanted])))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.uint32) % np.uint32(buckets)


def _held_back(hashes: np.ndarray, nick: np.ndarray, probe: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Which rows go to their buckets, which of these stand for a list, and the lists: a hash and all its sets.

    Of the sets of a hash that more than ``hot`` of a task's rows have, the first stands for all; a probe of one counts for it.
    """
    go, stands, lists = np.ones(len(hashes), bool), np.zeros(len(hashes), bool), []
    cells = (hashes % np.uint64(HOT_CELLS)).astype(np.int64)
    crowded = np.bincount(cells, minlength=HOT_CELLS) > hot
    if crowded.any():
        at = np.flatnonzero(crowded[cells])
        order = at[np.lexsort((nick[at], hashes[at]))]
        h = hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        for first, n in zip(starts.tolist(), np.diff(np.append(starts, len(h))).tolist()):
            if n > hot:
                mine = order[first : first + n]
                go[mine[1:]], stands[mine[0]] = False, True
                probe[mine[0]] = probe[mine].any()
                lists.append((int(h[first]), np.unique(nick[mine])))
    return go, stands, lists


def _blocks(buckets: int, crowd):
    """Batches of texts into a row for each bucket: sets' nicks, how many hashes each has there, and the hashes.

    A list that a task has held back is a row of its own, under a negative number, with its name.
    """

    def emit(gathered: list[tuple], number: list[int]) -> Iterator[pa.RecordBatch]:
        hashes, nick, probe = (np.concatenate(x) for x in zip(*gathered))
        go, stands, lists = _held_back(hashes, nick, probe, HOT)
        if lists:
            hashes, nick, probe, stands = (x[go] for x in (hashes, nick, probe, stands))
        bucket = _bucket(hashes, buckets)
        order = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows: list[tuple] = []
        for k in range(buckets):
            mine = order[ends[k] : ends[k + 1]]
            if not len(mine):
                continue
            nicks = nick[mine]
            starts = np.flatnonzero(np.concatenate(([True], nicks[1:] != nicks[:-1])))
            low = (hashes[mine] & np.uint64(0xFFFFFFFF)).astype("<u4")
            high = ((hashes[mine] >> np.uint64(32)) & np.uint64(0x3F)).astype(np.uint8) | (stands[mine].astype(np.uint8) << 6) | (probe[mine].astype(np.uint8) << 7)
            rows.append((k, nicks[starts].astype("<i8").tobytes(), np.diff(np.append(starts, len(mine))).astype("<u4").tobytes(), low.tobytes(), high.tobytes()))
        for h, members in lists:
            name = _name(_bucket(np.array([h], np.uint64), buckets).astype(np.int64), np.array([h & ((1 << 38) - 1)], np.uint64))
            number[0] += 1
            rows.append((-number[0], members.astype("<i8").tobytes(), name.astype("<i8").tobytes(), b"", b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], names=["bucket", "nicks", "counts", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size, seen, number = [], 0, set(), [TaskContext.get().partitionId() << 32]
        dense = np.unpackbits(np.frombuffer(crowd.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for a, b in base.parts(batch.column(0)):
                key, first = sets_of(batch.column(0).slice(a, b - a))
                nicks = digests(key, first)[0]
                fresh = np.array([not (x in seen or seen.add(x)) for x in nicks.tolist()], bool)  # of a task's copies, one is indexed
                key, first = _only(fresh, key, first)
                hashes, row, probe = signatures(key, first, dense)
                gathered.append((hashes, nicks[fresh][row], probe))
                size += len(hashes)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if size >= GATHERED:
                    yield from emit(gathered, number)
                    gathered, size = [], 0
        if size:
            yield from emit(gathered, number)

    return run


def _unique(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[fresh] for c in columns)


def candidates_of(nick: np.ndarray, key: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Candidate pairs (a < b) among sets with a common key, and the distinct lists of more than SMALL sets that share one."""
    order = np.argsort(key)
    nick, key, probe = nick[order], key[order], probe[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    nick, key, probe = nick[same], key[same], probe[same]
    order = np.lexsort((~probe, nick, key))  # of a set's rows under a key, the probe comes first
    nick, key, probe = nick[order], key[order], probe[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (nick[1:] != nick[:-1])
    nick, key, probe = nick[fresh], key[fresh], probe[fresh]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, SMALL):  # pairs at each distance within the short lists
        at = np.flatnonzero(np.repeat((sizes > step) & (sizes <= SMALL), sizes))
        end = np.repeat(starts + sizes, sizes)[at]
        at = at[at + step < end]
        at = at[probe[at] | probe[at + step]]
        left.append(nick[at])
        right.append(nick[at + step])
    lists: dict[bytes, np.ndarray] = {}
    for k in np.flatnonzero(sizes > SMALL):
        members = nick[starts[k] : starts[k] + sizes[k]]
        if probe[starts[k] : starts[k] + sizes[k]].any():
            lists.setdefault(members.tobytes(), members)
    for members in lists.values():
        left.append(np.full(len(members) - 1, members[0]))
        right.append(members[1:])
    return *_unique(np.concatenate(left), np.concatenate(right)), list(lists.values())


def _name(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What a hash is called in all tasks: its bucket and what else buckets tell hashes by."""
    return (bucket.astype(np.int64) << 38) + key.astype(np.int64)


_FOUND = "a long, b long, name long, members binary"


def _found(a, b, name, members) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip((a, b, name, members), kinds)], names=["a", "b", "name", "members"])


def _candidates(rows: pa.Table) -> pa.Table:
    """Candidate pairs (a, b), lists (a, members), lists that tasks held back (a, name, members), and whose they are (a, name)."""
    bucket = rows.column("bucket")[0].as_py()
    columns = {c: rows.column(c).to_pylist() for c in ("nicks", "counts", "low", "high")}
    if bucket < 0:
        members = np.frombuffer(columns["nicks"][0], "<i8")
        n, (name,) = len(members) - 1, np.frombuffer(columns["counts"][0], "<i8").tolist()
        pairs = _found(np.full(n, members[0]), members[1:], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()))
        return pa.concat_tables([pairs, _found([int(members[0])], [None], [name], [columns["nicks"][0]])])
    join = lambda c, t: np.frombuffer(b"".join(columns[c]), t)
    high = join("high", np.uint8)
    key = (high & 0x3F).astype(np.uint64) << np.uint64(32) | join("low", "<u4").astype(np.uint64)
    nick = np.repeat(join("nicks", "<i8"), join("counts", "<u4"))
    a, b, runs = candidates_of(nick, key, high >= 128)
    names, firsts = [], []
    for k in np.unique(key[(high & 0x40) > 0]):  # sets of other tasks with this subset belong to what was held back
        mine = np.unique(nick[key == k])
        runs.append(mine)
        names.append(int(_name(np.array([bucket]), np.array([k]))[0]))
        firsts.append(int(mine[0]))
    n, m = len(a), len(runs)
    pairs = _found(a, b, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()))
    lists = _found([int(r[0]) for r in runs], pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), [r.astype("<i8").tobytes() for r in runs])
    return pa.concat_tables([pairs, lists, _found(firsts, [None] * len(firsts), names, [None] * len(firsts))])


def sketch(key: np.ndarray) -> bytes:
    """For each cell of a set's shingles whether it has an odd number of them, in two to four cells a shingle."""
    cells = 1 << max(6, int(2 * len(key) - 1).bit_length())
    return np.packbits(np.bincount((key % np.uint64(cells)).astype(np.int64), minlength=cells) & 1).astype(np.uint8).tobytes()


def may_link(x: bytes, m: int, y: bytes, n: int) -> bool:
    """Whether two sets of m and n shingles can link: each odd cell of the sketches' difference needs a shingle that differs."""
    if 4 * min(m, n) < 3 * max(m, n):
        return False
    p, q = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y))
    least = min(len(p), len(q))
    p, q = (z.reshape(-1, least).sum(axis=0) & 1 for z in (p, q))
    return int((p != q).sum()) <= (m + n) // 7


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in base.parts(batch.column(0)):
            key, first = sets_of(batch.column(0).slice(a, b - a))
            each = [key[i:j] for i, j in zip(first[:-1], first[1:])]
            columns = [pa.array(digests(key, first)[0]), pa.array(np.diff(first), pa.int64()), pa.array([sketch(x) for x in each], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in each], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["nick", "n", "sketch", "shingles"])


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [may_link(x, m, y, n) for m, x, n, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["a", "b", "near"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link: 100 * intersection >= 75 * union."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 4 * small < 3 * large:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two sorted runs are merged
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (small + large - common)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = (batch.column(k).to_pylist() for k in (2, 3))
        links = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(xs, ys)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, pa.bool_())], names=["a", "b", "linked"])


def _wanted_sets(pairs: DataFrame, docs: DataFrame, members: DataFrame) -> DataFrame:
    """(nick, shingles) of all sets in ``pairs``, from the whole text of one document of each."""
    wanted = pairs.select(F.col("a").alias("one")).union(pairs.select("b")).distinct()
    rank = F.struct(F.col("id").isNull().alias("none"), "id")
    chosen = base.settled(members.join(wanted, "one", "left_semi").groupBy("one", "two").agg(F.min(rank).alias("x")).select(F.col("x.id").alias("chosen")))
    if chosen.count() <= BROADCAST:
        chosen = F.broadcast(chosen)
    texts = docs.join(chosen, F.col("id").eqNullSafe(F.col("chosen")), "left_semi").select("text")
    return base.settled(texts.mapInArrow(_sets, "nick long, n long, sketch binary, shingles binary"))


def _asked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets in ``pairs``; beyond BROADCAST of them all sets, so that a join by a shuffle picks them."""
    wanted = base.settled(pairs.select(F.col("a").alias("nick")).union(pairs.select("b")).distinct())
    return sets.join(F.broadcast(wanted), "nick", "left_semi") if wanted.count() <= BROADCAST else sets


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) of candidate pairs: screened by their small sketches, which rule no link out, then by their whole sets."""

    def met(pairs: DataFrame, *columns: str) -> DataFrame:
        mine = _asked(pairs, sets)  # of most sets the shingles are not asked for, so these need not be shuffled
        side = lambda name: mine.select(F.col("nick").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    pairs = base.settled(pairs)
    screened = met(pairs, "n", "sketch").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    screened = base.settled(screened.mapInArrow(_screened, "a long, b long, near boolean"))
    near = met(screened.filter("near").select("a", "b"), "shingles").select("a", "b", "shingles_a", "shingles_b")
    links = near.mapInArrow(_verified, "a long, b long, linked boolean")
    return base.settled(links.union(screened.filter("not near").select("a", "b", F.lit(False).alias("linked"))))


def apart(nick: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: list[bytes], nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list's sets in different components that may link by their sketches.

    With ``nearest``, of the pairs of two components only the one of the nearest sketches.
    """
    least = min(map(len, sketches))
    folded = np.zeros((len(sketches), max(1, least // 8)), np.uint64)
    for k, x in enumerate(sketches):
        folded[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, folded.shape[1]), axis=0)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, SCREENED // (len(nick) * folded.shape[1]))
    for at in range(0, len(nick), step):
        own = slice(at, at + step)
        differ = np.bitwise_count(folded[own, None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
        size, other = n[own, None], n[None, :]
        near = (root[own, None] != root[None, :]) & (7 * differ <= size + other) & (4 * np.minimum(size, other) >= 3 * np.maximum(size, other))
        i, j = np.nonzero(near)
        if nearest and len(i):
            low, high = np.minimum(root[own][i], root[j]), np.maximum(root[own][i], root[j])
            order = np.lexsort((j, i, differ[i, j], high, low))
            i, j, low, high = i[order], j[order], low[order], high[order]
            first = np.ones(len(i), bool)
            first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            i, j = i[first], j[first]
        left.append(np.minimum(nick[own][i], nick[j]))
        right.append(np.maximum(nick[own][i], nick[j]))
    return _unique(np.concatenate(left), np.concatenate(right))


def _apart(nearest: bool, slots: int):
    """The pairs of a list as a block for each slot: lists of one group give mostly the same pairs, which then meet in their slot."""

    def run(rows: pa.Table) -> pa.Table:
        nick, root, n = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("nick", "root", "n"))
        a, b = apart(nick, root, n, rows.column("sketch").to_pylist(), nearest)
        slot = (W.mix(a.astype(np.uint64) + W.mix(b.astype(np.uint64))) % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        there, starts = np.unique(slot[order], return_index=True)
        blocks = [np.column_stack((a[k], b[k])).astype("<i8").tobytes() for k in np.split(order, starts[1:])] if len(order) else []
        return pa.table({"slot": pa.array(there, pa.int64()), "block": pa.array(blocks, pa.binary())})

    return run


def _met(rows: pa.Table) -> pa.Table:
    pairs = np.frombuffer(b"".join(rows.column("block").to_pylist()), "<i8").reshape(-1, 2)
    a, b = _unique(pairs[:, 0], pairs[:, 1])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set of each list, under the list's first set."""
    for batch in batches:
        for run, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            nick = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nick), run, np.int64)), pa.array(nick)], names=["run", "nick"])


def _listed(found: DataFrame) -> DataFrame:
    """(run, nick): lists of the same first set as one list, as most of them hold mostly the same sets.

    What tasks held back of a subset is one list, under the first set of all of them.
    """
    owners = found.filter("name is not null and members is null").groupBy("name").agg(F.min("a").alias("first"))
    lists = found.filter("members is not null").join(owners, "name", "left").select(F.coalesce("first", "a").alias("run"), "members")
    return base.settled(lists.mapInArrow(_exploded, "run long, nick long").distinct())


def _open_parts(rows: DataFrame) -> DataFrame:
    """(run, part, nick, root) of lists (run, nick, root) whose sets are in several components.

    Long lists are dealt out in chunks. Sets of a list's largest component need not meet each other, so its chunks meet
    only those of all others: a list of mostly one component has as many parts as chunks.
    """
    by_root = rows.groupBy("run", "root").agg(F.count("*").alias("n"))
    sizes = by_root.groupBy("run").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
    chunks = lambda n: F.ceil(n / CHUNK)
    sizes = sizes.select("run", "top", F.when(F.col("all") <= CHUNK, 0).otherwise(chunks(F.col("all") - F.col("most"))).alias("others"), chunks(F.col("most")).alias("tops"))
    rows = rows.join(sizes, "run").withColumn("own", F.when(F.col("root") == F.col("top"), F.pmod(F.xxhash64("nick"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("nick"), F.greatest(F.col("others"), F.lit(1)))))
    zero = F.lit(0).cast("long")
    part = lambda other, k: other * (F.col("others") + F.col("tops")) + k
    to_tops = F.transform(F.sequence(zero, F.col("tops") - 1), lambda j: part(F.col("own"), F.col("others") + j))
    to_others = F.transform(F.sequence(zero, F.col("others") - 1), lambda i: part(F.least(i, "own"), F.greatest(i, "own")))
    from_top = F.transform(F.sequence(zero, F.col("others") - 1), lambda i: part(i, F.col("others") + F.col("own")))
    parts = F.when(F.col("others") == 0, F.array(zero)).when(F.col("root") == F.col("top"), from_top).otherwise(F.concat(to_tops, to_others))
    return rows.select("run", F.explode(parts).alias("part"), "nick", "root")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, ``n_shingles``, and ``component_id``, the smallest id that links lead to."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    read = base.settled(docs.mapInArrow(_members, f"id {kind}, n long, one long, two long, cell long"))
    members = read.filter("cell is null").drop("cell")
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET))
    shared = docs.sparkSession.sparkContext.broadcast(_crowd(read.filter("cell is not null")))
    found = base.settled(
        docs.select("text").mapInArrow(_blocks(buckets, shared), "bucket long, nicks binary, counts binary, low binary, high binary")
        .groupBy("bucket").applyInArrow(_candidates, _FOUND)
    )
    pairs = base.settled(found.filter("b is not null").select("a", "b").distinct())
    sets = _wanted_sets(pairs, docs, members)
    checked = _verify(pairs, sets)
    roots = graph.components(checked.filter("linked").select("a", "b"))
    listed = _listed(found.filter("b is null"))
    for nearest in (True, False):  # most links show at the nearest pairs, and what then is one component needs no more
        joined = listed.join(roots.withColumnRenamed("node", "nick"), "nick", "left").select("run", "nick", F.coalesce("root", "nick").alias("root"))
        rows = _open_parts(joined).join(sets.select("nick", "n", "sketch"), "nick")
        blocks = rows.groupBy("run", "part").applyInArrow(_apart(nearest, 2 * buckets), "slot long, block binary")
        pairs = blocks.groupBy("slot").applyInArrow(_met, "a long, b long").join(checked, ["a", "b"], "left_anti")
        more = _verify(pairs, sets)
        checked = checked.union(more)
        if not more.filter("linked").isEmpty():  # components of components: what is one already is one node
            merged = more.filter("linked").select("a", "b").union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = graph.components(merged)
    # without links, copies alone are a class; a document without shingles is one by itself
    keyed = members.join(roots.withColumnRenamed("node", "one"), "one", "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("root", "one")).alias("k1"), F.when((F.col("n") > 0) & F.col("root").isNull(), F.col("two")).otherwise(F.lit(0)).alias("k2")
    )
    least = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("least"))
    return keyed.join(least, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their component, all columns as they were, repeated rows once.

    Documents without an id cannot be told apart: they stay if one of them is in no class with an id.
    """
    key, mark = base.free_name(docs, "kept_key"), base.free_name(docs, "kept_text")
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    kept = components(docs, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(own.alias(key)).distinct()
    rows = docs.withColumn(key, own).join(kept, key, "left_semi").withColumn(mark, F.xxhash64(text_col))
    return rows.dropDuplicates([key, mark]).select(*docs.columns)
