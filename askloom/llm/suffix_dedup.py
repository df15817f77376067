"""Repeated passages: a distributed merge sort of suffixes that knows common prefixes.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier, in a
smaller document or further up. Sorting every suffix is not needed for that. Each string
of that length holds an anchor, a run of ``GRAM`` bytes chosen by its content alone, so equal
strings have equal anchors at equal places. Only suffixes at anchors that occur more than
once are sorted:

1. documents are packed, and the packs tell which anchors they hold; anchors that occur
   once are dropped (their strings are unique);
2. each pack sorts its suffixes at the anchors that are left and writes them as a front-coded
   run: per suffix, the length of the prefix it shares with the one before, and the rest;
3. runs are cut at sampled splitters and exchanged; a loser tree merges those of a range. It
   carries the known common prefixes along and compares only what lies behind them;
4. neighbours in the merged order with the anchor in common are the candidates. Their
   strings, which reach to the left of the anchor too, are compared and the earliest of
   equals stays.

Anchors in very many places are not gathered; their strings are grouped as rows instead.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Staging, written

LENGTH = 100
GRAM = 40  # of an anchor
LEFT = LENGTH - GRAM  # a string begins at most so far before its anchor
KEY = LENGTH + 1  # a suffix as it is sorted: its bytes, padded, and how many there are

PACK_BYTES = 4 << 20  # of texts in a pack, but for longer texts
BLOCK = 1 << 19  # bytes looked at together for anchors
PART_BYTES = 16 << 20  # of texts for each part of the anchors' table
RUN_ITEMS = 60_000  # suffixes merged by one task, about
SPLITTER_BYTES = 32  # not more than an anchor, so that equal anchors meet
SAMPLES = 100_000  # keys from which splitters are taken, about; what the driver sees
LEVEL = 5  # of compression: what is packed is staged once and shuffled twice
HOT = 50_000  # occurrences from which an anchor's strings are grouped as rows

LAST = np.iinfo(np.int64).max  # stands for a null id: after all others

_MUL = np.uint32(0x9E3779B1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


# -- Packs ----------------------------------------------------------------------------

_PACK = "pack long, raw_bytes long, data binary"


def _packed_row(ids: list, texts: list[bytes]) -> pa.RecordBatch:
    head = np.array([len(ids)], np.int64).tobytes()
    known = np.array([LAST if i is None else i for i in ids], np.int64).tobytes()
    nulls = np.array([i is None for i in ids], np.uint8).tobytes()
    sizes = np.array([len(t) for t in texts], np.int64).tobytes()
    raw = b"".join([head, known, nulls, sizes, *texts])
    return pa.RecordBatch.from_pydict(
        {
            "pack": pa.array([int.from_bytes(os.urandom(8), "little", signed=True)], pa.int64()),
            "raw_bytes": pa.array([len(raw)], pa.int64()),
            "data": pa.array([zstandard.ZstdCompressor(level=LEVEL).compress(raw)], pa.binary()),
        }
    )


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, nulls, begins with the end, bytes)."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.frombuffer(raw, np.int64, n, 8)
    nulls = np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
    sizes = np.frombuffer(raw[8 + 9 * n : 8 + 17 * n], np.int64)
    return ids, nulls.astype(bool), np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(raw, np.uint8, -1, 8 + 17 * n)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode()
            if ids and held + len(data) > PACK_BYTES:
                yield _packed_row(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(data)
            held += len(data)
    if ids:
        yield _packed_row(ids, texts)


# -- Anchors --------------------------------------------------------------------------


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each stretch of ``width`` values."""
    span, size = values, 1
    while size * 2 <= width:
        span, size = pick(span[:-size], span[size:]), size * 2
    return pick(span[: len(span) - (width - size)], span[width - size :]) if width > size else span


def _gram_order(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the ``GRAM`` bytes from each place on."""
    value = (data.astype(np.uint32) + np.uint32(1)) * _MUL
    value ^= value >> np.uint32(15)
    parts, size, power = {1: value}, 1, _MUL
    while size * 2 <= GRAM:
        value = value[:-size] * power + value[size:]
        with np.errstate(over="ignore"):
            power = np.uint32(power * power)
        size *= 2
        parts[size] = value
    done, have = value, size
    while have < GRAM:
        more = max(s for s in parts if s <= GRAM - have)
        with np.errstate(over="ignore"):
            shift = np.uint32(1)
            for _ in range(more):
                shift = np.uint32(shift * _MUL)
        n = len(data) - have - more + 1
        done = done[:n] * shift + parts[more][have : have + n]
        have += more
    done = (done ^ (done >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return np.maximum(done ^ (done >> np.uint32(13)), np.uint32(1))  # 0 says: no string here


def anchors(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of the anchors: in every string of ``LENGTH`` bytes of a document, those of its
    ``GRAM``-byte runs whose hash is smallest."""
    found = []
    ends = np.append(begins[1:], 0)[: len(begins) - 1]
    for at in range(0, len(data), BLOCK):
        low, high = max(0, at - LENGTH), min(len(data), at + BLOCK + LENGTH + GRAM)
        part = data[low:high]
        if len(part) < LENGTH:
            continue
        order = _gram_order(part)
        least = _sliding(order, LEFT + 1, np.minimum)
        # strings that reach over the end of a document do not count
        places = np.arange(low, low + len(least))
        doc = np.searchsorted(begins, places, side="right") - 1
        least[places + LENGTH > ends[np.minimum(doc, len(ends) - 1)]] = 0
        padded = np.concatenate([np.zeros(LEFT, np.uint32), least, np.zeros(max(0, len(order) - len(least)), np.uint32)])
        most = _sliding(padded, LEFT + 1, np.maximum)[: len(order)]
        chosen = np.flatnonzero((most == order) & (most > 0)) + low
        found.append(chosen[(chosen >= at) & (chosen < at + BLOCK)])
    return np.concatenate([np.empty(0, np.int64), *found])


def _hashed(rows: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of bytes, eight of them at a time."""
    width = -(-rows.shape[1] // 8) * 8
    if width != rows.shape[1]:
        rows = np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
    words = np.ascontiguousarray(rows).view(np.uint64)
    value = np.full(len(rows), seed, np.uint64)
    for k in range(words.shape[1]):
        value = (value ^ words[:, k]) * _BASE
        value ^= value >> np.uint64(32)
    return value


def _gram_hash(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    made = [
        _hashed(data[places[at : at + AT_ONCE, None] + np.arange(GRAM)], 1) for at in range(0, len(places), AT_ONCE)
    ]
    return np.concatenate([np.empty(0, np.uint64), *made])


_HASHES = "part int, pack long, hashes binary, counts binary"


def _anchor_table(parts: int):
    """For each pack and part: hashes of its anchors and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, packed in zip(batch.column("pack").to_pylist(), batch.column("data").to_pylist()):
                _, _, begins, data = _unpacked(packed)
                hashes, counts = np.unique(_gram_hash(data, anchors(data, begins)), return_counts=True)
                part = (hashes % np.uint64(parts)).astype(np.int64)
                rows = [(p, np.flatnonzero(part == p)) for p in np.unique(part)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([int(p) for p, _ in rows], pa.int32()),
                        "pack": pa.array([pack] * len(rows), pa.int64()),
                        "hashes": pa.array([hashes[r].tobytes() for _, r in rows], pa.binary()),
                        "counts": pa.array([counts[r].astype(np.uint32).tobytes() for _, r in rows], pa.binary()),
                    }
                )

    return run


def _repeated_anchors(hot: int):
    """Of a part's anchors those that occur more than once, back to the packs that hold them."""
    schema = pa.schema([("pack", pa.int64()), ("hashes", pa.binary()), ("hot", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]
        known, back = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(known))
        rows, at = [], 0
        for pack, own in zip(table.column("pack").to_pylist(), lists):
            n = total[back[at : at + len(own)]]
            at += len(own)
            if (n > 1).any():
                rows.append({"pack": pack, "hashes": own[n > 1].tobytes(), "hot": (n[n > 1] > hot).astype(np.uint8).tobytes()})
        return pa.Table.from_pylist(rows, schema)

    return run


# -- Runs -----------------------------------------------------------------------------

COVER, RUN, SAMPLE, WINDOWS = 0, 1, 2, 3

_FOUND = "kind int, pack long, n long, data binary"


def _pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack_arrays(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, found = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
    for size, kind in zip(sizes, kinds):
        found.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return found


_RUN_KINDS = (np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.int32, np.int64)


def front_coded(keys: np.ndarray, left: np.ndarray, left_size: np.ndarray, ids: np.ndarray, docs: np.ndarray, places: np.ndarray) -> bytes:
    """A sorted run: shared prefixes, the rest of each key, and what belongs to the suffixes."""
    shared = np.zeros(len(keys), np.uint8)
    differs = keys[1:] != keys[:-1]
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), KEY)
    rest = keys[np.arange(KEY, dtype=np.uint8)[None, :] >= shared[:, None]]
    return _pack_arrays(shared, rest, left, left_size, ids, docs, places)


def decoded(run: bytes) -> tuple[np.ndarray, ...]:
    """(shared, keys, left, left_size, ids, docs, places) of a front-coded run."""
    shared, rest, left, left_size, ids, docs, places = _unpack_arrays(run, *_RUN_KINDS)
    n = len(shared)
    keys = np.zeros((n, KEY), np.uint8)
    keys[np.arange(KEY, dtype=np.uint8)[None, :] >= shared[:, None]] = rest
    rows = np.arange(n)
    for k in range(KEY):
        # a byte that is not stored is the last one stored above it in its column
        above = np.maximum.accumulate(np.where(shared <= k, rows, 0))
        keys[:, k] = keys[above, k]
    return shared, keys, left.reshape(n, LEFT), left_size, ids, docs, places


AT_ONCE = 8192  # places whose surroundings are gathered in one step


def _contexts(data: np.ndarray, begins: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, left, left_size, doc) at each place: what follows and what precedes it in its
    document, padded with zeros. ``left`` reads away from the place."""
    steps = range(0, max(1, len(places)), AT_ONCE)
    parts = [_some_contexts(data, begins, places[at : at + AT_ONCE]) for at in steps]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _some_contexts(data: np.ndarray, begins: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    doc = np.searchsorted(begins, places, side="right") - 1
    after, before = begins[doc + 1] - places, places - begins[doc]
    right_size, left_size = np.minimum(after, LENGTH), np.minimum(before, LEFT)
    forth, back = np.arange(LENGTH), np.arange(1, LEFT + 1)
    keys = np.zeros((len(places), KEY), np.uint8)
    keys[:, :LENGTH] = data[np.minimum(places[:, None] + forth, len(data) - 1)]
    keys[:, :LENGTH][forth[None, :] >= right_size[:, None]] = 0
    keys[:, LENGTH] = right_size
    left = data[np.maximum(places[:, None] - back, 0)]
    left[back[None, :] > left_size[:, None]] = 0
    return keys, left, left_size.astype(np.uint8), doc


def _suffixes():
    """Of one pack and its repeated anchors: a run of suffixes, and spans known at once.

    Places with the same bytes around them are settled here but for the first: what is
    around it stands for all. The first goes into the run.
    """
    schema = pa.schema([("kind", pa.int32()), ("pack", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(packs: pa.Table, flags: pa.Table) -> pa.Table:
        if not packs.num_rows or not flags.num_rows:
            return schema.empty_table()
        pack = packs.column("pack")[0].as_py()
        ids, _, begins, data = _unpacked(packs.column("data")[0].as_py())
        known = np.concatenate([np.frombuffer(h, np.uint64) for h in flags.column("hashes").to_pylist()])
        hot = np.concatenate([np.frombuffer(h, np.uint8) for h in flags.column("hot").to_pylist()])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        places = anchors(data, begins)
        hashes = _gram_hash(data, places)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        repeated = known[at] == hashes
        places, is_hot = places[repeated], hot[at[repeated]].astype(bool)
        rows = []
        for few in range(0, len(places), 65536):
            rows += self_contained(pack, ids, begins, data, places[few : few + 65536], is_hot[few : few + 65536])
        return pa.Table.from_pylist(rows, schema)

    def self_contained(pack, ids, begins, data, places, is_hot) -> list[dict]:
        keys, left, left_size, doc = _contexts(data, begins, places)
        enough = keys[:, LENGTH].astype(np.int64) + left_size >= LENGTH
        keys, left, left_size, doc, places, is_hot = (x[enough] for x in (keys, left, left_size, doc, places, is_hot))
        if not len(places):
            return []
        around = _hashed(np.concatenate([keys, left, left_size[:, None]], axis=1), 2)
        inside = places - begins[doc]
        order = np.lexsort((inside, doc, ids[doc], around))
        first = np.ones(len(order), bool)
        first[1:] = around[order[1:]] != around[order[:-1]]
        again, lead = order[~first], order[first]
        rows = []
        if len(again):
            low = inside[again] - left_size[again]
            high = inside[again] + keys[again, LENGTH]
            rows.append({"kind": COVER, "pack": pack, "n": len(again), "data": _pack_arrays(doc[again].astype(np.int32), low, high)})
        cold = lead[~is_hot[lead]]
        if len(cold):
            cold = cold[np.argsort(keys[cold].view(f"V{KEY}").ravel())]
            run = front_coded(keys[cold], left[cold], left_size[cold], ids[doc[cold]], doc[cold].astype(np.int32), inside[cold])
            rows.append({"kind": RUN, "pack": pack, "n": len(cold), "data": run})
            step = max(1, len(cold) // 64)
            rows += [{"kind": SAMPLE, "pack": pack, "n": step, "data": keys[k, :SPLITTER_BYTES].tobytes()} for k in cold[::step]]
        warm = lead[is_hot[lead]]
        for few in range(0, len(warm), 4096):
            own = warm[few : few + 4096]
            value, valid = window_hashes(keys[own], left[own], left_size[own])
            k, off = np.nonzero(valid)
            at = own[k]
            made = _pack_arrays(value[k, off], ids[doc[at]], doc[at].astype(np.int32), inside[at] - off)
            rows.append({"kind": WINDOWS, "pack": pack, "n": len(k), "data": made})
        return rows

    return run


def window_hashes(keys: np.ndarray, left: np.ndarray, left_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix and offset: the hash of the string of ``LENGTH`` bytes that begins so far
    before the anchor, and whether there is one."""
    around = np.concatenate([left[:, ::-1], keys[:, :LENGTH]], axis=1).astype(np.uint64)
    around = (around + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    around ^= around >> np.uint64(32)
    width = around.shape[1]
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(width, _BASE)]))
    sums = np.zeros((len(keys), width + 1), np.uint64)
    np.cumsum(around * powers[width - 1 :: -1][None, :width], axis=1, out=sums[:, 1:])
    offs = np.arange(LEFT + 1)
    begin = LEFT - offs
    value = (sums[:, begin + LENGTH] - sums[:, begin]) * powers[begin][None, :]
    value = (value ^ (value >> np.uint64(31))) * _BASE
    valid = (offs[None, :] <= left_size[:, None]) & (LENGTH - offs[None, :] <= keys[:, LENGTH][:, None])
    return value, valid


def _cut_runs(splitters: np.ndarray):
    """Runs cut into the ranges between ``splitters``."""
    schema = pa.schema([("part", pa.int32()), ("pack", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, data in zip(batch.column("pack").to_pylist(), batch.column("data").to_pylist()):
                _, keys, left, left_size, ids, docs, places = decoded(data)
                heads = np.ascontiguousarray(keys[:, :SPLITTER_BYTES]).view(f"S{SPLITTER_BYTES}").ravel()
                part = np.searchsorted(splitters, heads, side="right")
                rows = []
                for p in np.unique(part):
                    own = part == p
                    cut = front_coded(keys[own], left[own], left_size[own], ids[own], docs[own], places[own])
                    rows.append({"part": int(p), "pack": pack, "n": int(own.sum()), "data": cut})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


# -- Merge ----------------------------------------------------------------------------


def _mismatch(a: bytes, b: bytes, begin: int) -> int:
    """The first place from ``begin`` on where two keys differ, ``KEY`` if none."""
    for at in range(begin, KEY, 24):
        x, y = a[at : at + 24], b[at : at + 24]
        if x != y:
            n = len(x)
            return at + n - 1 - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() - 1) // 8
    return KEY


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Sorted runs (keys, prefixes shared with the key before) as one: (run of each key in
    order, prefix shared with the key before in order).

    A loser tree. Each run's next key has a known prefix in common with the last key that
    left the tree. Of two keys the one with the longer such prefix is smaller, without a look
    at either. Where the prefixes are equally long, the keys are compared behind them, and the
    loser then knows its prefix in common with the winner.
    """
    count = len(runs)
    if count == 1:
        return [0] * len(runs[0][0]), list(runs[0][1])
    size = 1
    while size < count:
        size *= 2
    key: list[bytes | None] = [r[0][0] for r in runs] + [None] * (size - count)
    known = [0] * size
    at = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = key[a], key[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        place = _mismatch(x, y, known[a])
        if place == KEY or x[place] < y[place]:
            known[b] = place
            return a, b
        known[a] = place
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        for k in range(level):
            winners[k], loser[level + k] = play(winners[2 * k], winners[2 * k + 1])
    best = winners[0]
    order, shared = [], []
    while key[best] is not None:
        order.append(best)
        shared.append(known[best])
        keys, prefixes = runs[best]
        at[best] += 1
        n = at[best]
        if n < len(keys):
            key[best], known[best] = keys[n], prefixes[n]
        else:
            key[best], known[best] = None, 0
        node = (size + best) // 2
        while node:
            other = loser[node]
            x, y = key[best], key[other]
            if y is None:
                pass
            elif x is None:
                best, loser[node] = other, best
            elif known[best] < known[other]:
                best, loser[node] = other, best
            elif known[best] == known[other]:
                place = _mismatch(x, y, known[best])
                if place != KEY and x[place] > y[place]:
                    known[best] = place
                    best, loser[node] = other, best
                else:
                    known[other] = place
            node //= 2
    return order, shared


def _merged_part(table: pa.Table) -> pa.Table:
    """The runs of one range: spans of suffixes whose strings occur earlier."""
    schema = pa.schema([("pack", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
    runs = [decoded(d) for d in table.column("data").to_pylist()]
    packs = np.repeat(np.array(table.column("pack").to_pylist(), np.int64), [len(r[0]) for r in runs])
    order, shared = merged([([k.tobytes() for k in r[1]], r[0].tolist()) for r in runs])
    # the n-th key that a run gave is its n-th
    place = np.empty(len(order), np.int64)
    place[np.argsort(np.array(order, np.int64), kind="stable")] = np.arange(len(order))
    shared = np.array(shared, np.int64)
    keys, left, left_size, ids, docs, places = (np.concatenate([r[k] for r in runs])[place] for k in range(1, 7))
    packs = packs[place]
    # the longest prefix that a suffix shares with any other is one with a neighbour
    reach = np.maximum(shared, np.append(shared[1:], 0))
    group = np.cumsum(shared < GRAM)
    open_ = np.flatnonzero((reach >= GRAM) & (np.minimum(reach, LENGTH) + left_size >= LENGTH))
    rows: dict[int, list[np.ndarray]] = {}
    # whole groups together, a bounded number of suffixes at once
    begin = 0
    while begin < len(open_):
        end = min(len(open_), begin + 4096)
        while end < len(open_) and group[open_[end]] == group[open_[end - 1]]:
            end += 1
        some = open_[begin:end]
        begin = end
        some = some[np.lexsort((places[some], docs[some], packs[some], ids[some]))]
        value, valid = window_hashes(keys[some], left[some], left_size[some])
        low, high = np.full(len(some), LEFT + 1), np.full(len(some), -1)
        for off in range(LEFT + 1):
            rows_in = np.flatnonzero(valid[:, off])
            own = value[rows_in, off]
            by_value = np.argsort(own, kind="stable")
            same = own[by_value[1:]] == own[by_value[:-1]]
            later = rows_in[by_value[1:][same]]
            low[later] = np.minimum(low[later], off)
            high[later] = np.maximum(high[later], off)
        hit = np.flatnonzero(high >= 0)
        at = some[hit]
        spans = np.stack([docs[at].astype(np.int64), places[at] - high[hit], places[at] - low[hit] + LENGTH], axis=1)
        for pack in np.unique(packs[at]):
            rows.setdefault(int(pack), []).append(spans[packs[at] == pack])
    out = []
    for pack, found in rows.items():
        spans = np.concatenate(found)
        out.append(
            {"pack": pack, "n": len(spans), "data": _pack_arrays(spans[:, 0].astype(np.int32), spans[:, 1].copy(), spans[:, 2].copy())}
        )
    return pa.Table.from_pylist(out, schema)


# -- Hot anchors ------------------------------------------------------------------------

_WINDOW = "value long, id long, pack long, doc int, begin long"


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack, data in zip(batch.column("pack").to_pylist(), batch.column("data").to_pylist()):
            value, ids, docs, begins = _unpack_arrays(data, np.int64, np.int64, np.int32, np.int64)
            columns = [value, ids, np.full(len(value), pack, np.int64), docs, begins]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["value", "id", "pack", "doc", "begin"])


def _hot_spans(found: DataFrame, stage: Staging) -> DataFrame:
    """(pack, doc, low, high) of the strings around hot anchors that occur earlier."""
    windows = stage.write(found.where(F.col("kind") == WINDOWS).select("pack", "data").mapInArrow(_window_rows, _WINDOW), "windows")
    place = F.struct("id", "pack", "doc", "begin")
    first = stage.write(
        windows.groupBy("value").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first"
    )
    later = windows.join(first, "value").where(place != F.col("first"))
    return later.select("pack", "doc", F.col("begin").alias("low"), (F.col("begin") + LENGTH).alias("high"))


# -- Texts ----------------------------------------------------------------------------

_RESULT = "id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"


def _cut_texts(packs: pa.Table, covers: pa.Table) -> pa.Table:
    """A pack's documents without the spans that cover them."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    if not packs.num_rows:
        return schema.empty_table()
    ids, nulls, begins, data = _unpacked(packs.column("data")[0].as_py())
    parts = [_unpack_arrays(c, np.int32, np.int64, np.int64) for c in covers.column("data").to_pylist()]
    docs, lows, highs = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]).astype(np.int64) for k in range(3))
    steps = np.zeros(len(data) + 1, np.int32)
    np.add.at(steps, begins[docs] + lows, 1)
    np.add.at(steps, begins[docs] + highs, -1)
    gone = np.cumsum(steps[:-1]) > 0
    kept, spans = [], []
    for k in range(len(ids)):
        own, text = gone[begins[k] : begins[k + 1]], data[begins[k] : begins[k + 1]]
        if own.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            spans.append([{"begin": int(b), "end": int(e)} for b, e in zip(edges[::2], edges[1::2])])
            kept.append(text[~own].tobytes())
        else:
            spans.append([])
            kept.append(text.tobytes())
    return pa.table(
        [pa.array([None if n else int(i) for i, n in zip(ids, nulls)], pa.int64()), pa.array(np.diff(begins)), pa.array(spans, schema.field(2).type), pa.array(kept, pa.binary())],
        schema=schema,
    )


def _packed_spans(table: pa.Table) -> pa.Table:
    arrays = [table.column(c).to_numpy() for c in ("doc", "low", "high")]
    return pa.table({"pack": table.column("pack").slice(0, 1), "data": pa.array([_pack_arrays(*arrays)], pa.binary())})


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, run_items: int = RUN_ITEMS
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (what goes, as byte offsets), kept.

    Texts are bytes in UTF-8, null counting as empty; ``kept`` need not be valid UTF-8. A
    byte goes if a string of ``LENGTH`` bytes over it also starts earlier: in a smaller id (null
    comes last), or further up in the same text. Rows with equal ids come in some fixed order
    of this run. Strings are known by 64-bit hashes. Other columns are not read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with Staging(spark, "suffixes") as stage:
        packs = stage.write(texts.mapInArrow(_packs, _PACK), "packs")
        total = packs.agg(F.sum("raw_bytes")).first()[0] or 0
        parts = max(1, -(-total // PART_BYTES))
        table = packs.select("pack", "data").mapInArrow(_anchor_table(parts), _HASHES)
        flags = stage.write(
            table.groupBy("part").applyInArrow(_repeated_anchors(hot), "pack long, hashes binary, hot binary"), "flags"
        )
        path = stage.path("found")
        by_pack = packs.select("pack", "data").groupBy("pack").cogroup(flags.groupBy("pack"))
        by_pack.applyInArrow(_suffixes(), _FOUND).write.partitionBy("kind").parquet(path)
        found = spark.read.schema("pack long, n long, data binary, kind int").parquet(path)
        splitters = _splitters(found, run_items)
        runs = found.where(F.col("kind") == RUN).select("pack", "data")
        cut = runs.mapInArrow(_cut_runs(splitters), "part int, pack long, n long, data binary")
        spans = cut.groupBy("part").applyInArrow(_merged_part, "pack long, n long, data binary").select("pack", "data")
        hot_rows = _hot_spans(found, stage).groupBy("pack").applyInArrow(_packed_spans, "pack long, data binary")
        settled = found.where(F.col("kind") == COVER).select("pack", "data")
        covers = stage.write(settled.unionByName(spans).unionByName(hot_rows), "covers")
        result = packs.select("pack", "data").groupBy("pack").cogroup(covers.groupBy("pack"))
        return written(result.applyInArrow(_cut_texts, _RESULT), "without-repeats")


def _splitters(found: DataFrame, run_items: int) -> np.ndarray:
    """Heads of keys between ranges of about ``run_items`` suffixes, from a sample of bounded size."""
    samples = found.where(F.col("kind") == SAMPLE)
    counted = samples.agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("samples")).first()
    ranges = -(-(counted["items"] or 0) // run_items)
    if ranges < 2:
        return np.empty(0, f"S{SPLITTER_BYTES}")
    share = min(1.0, SAMPLES / counted["samples"])
    chosen = F.pmod(F.xxhash64("data", "pack"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    rows = samples.where(chosen).select("data").collect()
    heads = np.sort(np.array([bytes(r["data"]) for r in rows], f"S{SPLITTER_BYTES}"))
    return np.unique(heads[np.linspace(0, len(heads), ranges, endpoint=False).astype(int)[1:]])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its bytes in passages that start earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = without_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
