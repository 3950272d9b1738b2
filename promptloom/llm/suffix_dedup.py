"""Substring dedup by a distributed difference-cover suffix sort.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id. Suffixes need to be
told apart over 50 bytes only, which bounds the recursion of the difference-cover algorithm:

1. Anchors. Every 50-byte window has a least 32-byte hash; windows whose least hash stands in one document only can't
   repeat. A bit table of bounded size of the others (too many at worst) leaves the candidate windows. Strings of 32
   bytes repeat by chance, the more so the larger the input; so the least 42-byte hashes of these windows pass once more.
2. Strings. Candidate stretches are cut where their content says so, each piece with the 49 bytes that follow. Equal
   pieces become one string with the smallest doc_id they stand in, so copies, however many, are sorted once. Anchors
   say little at the ends of what repeats, so hashes of the strings' windows are exchanged, and only the stretches of
   those that stand in several strings, or in a string of several documents, are cut and made strings again.
3. Sampled triples. Positions of residue 1 and 2 modulo 3 are sampled; their triples of 6-byte letters are sorted and
   named by rank.
4. Recursion. Triples of names, at distances 0, 15 and 30, which the sample contains, are sorted and named: ranks over
   48 bytes.
5. Merge. Any two positions meet in sampled positions 0, 1 or 2 further on; so each pair of residues is merged by keys
   of one rank and two bytes, sorted, and neighbours with equal keys, that is equal 50-byte prefixes, share the
   smallest doc_id.

Blocks of strings exchange packed, locally deduplicated arrays with key ranges; a key that stands everywhere comes once
from each block. Arrays are exchanged as differences where they ascend, by byte planes, with zstd. What a round leaves
is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.shared import ROW, TABLE_BITS, attach, bit_table, bound_batches, drop_table, hits, materialize, numbered, release, split_rows, stored, trimmed

WIDTH = 50
GRAM = 32
#: Least hashes are taken over so many grams: GRAM + WINDOW - 1 = WIDTH.
WINDOW = 19
#: The same of the longer grams that candidates are looked at by once more.
FINE, NARROW = 42, 9
#: Bits of a table of anchors: at least TABLE_BITS, at most this.
MOST_BITS = 1 << 30
#: A piece ends before a gram whose hash is 0 modulo CUT; none has more than LONGEST windows.
CUT, LONGEST = 256, 4096
#: Bytes of strings in a block, and keys in a range.
BLOCK_BYTES, RANGE_KEYS = 3 << 20, 1 << 20
#: A range is 16 bits of a merge key; more ranges are an error.
MOST_RANGES = 1 << 16
#: Text that is hashed at a time: the hashes of so much stay in a core's cache.
STEP = 1 << 16
#: Rows that the bit table of whole copies takes for some and that may be named to the tasks; more are joined instead.
MISTAKEN = 1 << 20
LAST = (1 << 63) - 1
_LOW = (1 << 32) - 1

_ZSTD = pa.Codec("zstd", compression_level=1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _grams(text: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte strings of an array of bytes, by doubling."""
    if len(text) > 4 * STEP:
        return np.concatenate([_grams(text[i : i + STEP + GRAM - 1]) for i in range(0, len(text) - GRAM + 1, STEP)])
    h, n = text.astype(np.uint64) + np.uint64(1), 1
    for mix in _MIX:
        h = h[: len(h) - n] * mix + h[n:]  # no factor here: with one that is also a mix, neighbours could change places
        h ^= h >> np.uint64(29)
        n *= 2
    return h * _MIX[1] ^ h >> np.uint64(31)


def _least(h: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """The least of each n hashes in a row."""
    have = 1
    while 2 * have <= n:
        h, have = np.minimum(h[:-have], h[have:]), 2 * have
    return np.minimum(h[: have - n], h[n - have :]) if have < n else h


def _longer(h: np.ndarray, more: int) -> np.ndarray:
    """Hashes of strings that are longer than grams by `more` bytes, at most by 32."""
    w = h[:-more] * _MIX[2] ^ (h[more:] + _MIX[3]) * _MIX[0]
    return (w ^ w >> np.uint64(31)) * _MIX[1]


def _fine(h: np.ndarray) -> np.ndarray:
    """The least 42-byte hash of each window."""
    return _least(_longer(h, FINE - GRAM), NARROW)


def _hashed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of long enough texts: their numbers, a joint buffer, their starts in it and its end, its gram hashes and
    least hashes."""
    own: list[int] = []
    size = 0

    def flush():
        raw = b"".join(texts[i] for i in own)
        h = _grams(np.frombuffer(raw, np.uint8))
        return np.array(own), raw, np.cumsum([0, *(len(texts[i]) for i in own)]), h, _least(h)

    for i, t in enumerate(texts):
        if len(t) >= WIDTH:
            own.append(i)
            size += len(t)
            if size >= STEP:
                yield flush()
                own, size = [], 0
    if own:
        yield flush()


def _inside(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows at these places of a joint buffer don't cross a text's end, and the texts of these."""
    owner = np.searchsorted(starts, at, side="right") - 1
    within = starts[owner + 1] - at >= WIDTH
    return within, owner[within]


def _window_hashes(text: np.ndarray) -> np.ndarray:
    """Hashes of all 50-byte windows of an array of bytes, of one such window at least."""
    return _longer(_grams(text), WIDTH - GRAM)


def _texts(column: pa.Array) -> list[bytes]:
    return [(x.as_py() or "").encode() for x in column]


def _bit_table(pieces: list, bits: int, parts: int) -> np.ndarray:
    out, size = np.zeros(bits // 8, np.uint8), bits // 8 // parts
    for part, raw in pieces:
        out[part * size : (part + 1) * size] = np.frombuffer(raw, np.uint8)
    return out


def _bits(total: int) -> int:
    """Bits of a table of anchors for so many bytes of text: a quarter as many or more, where that is within bounds."""
    return min(MOST_BITS, max(TABLE_BITS, 1 << max(0, total // 4 - 1).bit_length()))


def _parts(total: int) -> int:
    """Ranges of anchors, a power of 2, for so many bytes of text."""
    return 1 << min(24, max(6, (total // 10 // RANGE_KEYS).bit_length()))


def _split_hash(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's range and the 32 bits that follow."""
    n = parts.bit_length() - 1
    return (h >> np.uint64(64 - n)).astype(np.int64), h << np.uint64(n) >> np.uint64(32)


def _places(rest: np.ndarray, span: int) -> list[np.ndarray]:
    """The three bits of a hash within the part of the table that belongs to its range."""
    return [((rest * m & np.uint64(0xFFFFFFFF)) * np.uint64(span) >> np.uint64(32)).astype(np.int64) for m in (np.uint64(1), np.uint64(0x9E3779B1), np.uint64(0x85EBCA77))]


def _is_repeated(table: np.ndarray, h: np.ndarray, parts: int) -> np.ndarray:
    # windows next to each other mostly have the same least hash
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(first)
    part, rest = _split_hash(h[at], parts)
    span = len(table) * 8 // parts
    some = np.arange(len(at))
    for i in range(3):
        some = some[hits(table, part[some] * span + _places(rest[some], span)[i])]
    found = np.zeros(len(at), bool)
    found[some] = True
    return np.repeat(found, np.diff(np.append(at, len(h))))


def _alive(table, kept) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Leaves rows (rid, .., at) out whose bit is set in a broadcast table, but those of the broadcast rids `kept`."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        hit = hits(table.value, b.column(b.num_columns - 1).to_numpy())
        return b.filter(pa.array(~hit | np.isin(b.column(0).to_numpy(), kept.value))) if hit.any() else b

    return run


def _same(b: pa.RecordBatch) -> pa.RecordBatch:
    return b


def _repeated_anchors(rows: DataFrame, alive: Callable, total: int, earlier=None) -> np.ndarray:
    """The bit table of least hashes that stand in more than one document: exact up to hashes that fall together. With
    the broadcast table of these, that of the least 42-byte hashes of the windows that it leaves.

    A range of hashes has a part of the table, so its bits are made where its hashes meet."""
    parts, bits = _parts(total), _bits(total)
    span = bits // parts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(alive, batches):
            found, docs = [], []
            for own, _, starts, h, least in _hashed(_texts(b.column(1))):
                new = np.ones(len(least), bool)
                if earlier:
                    hit = _is_repeated(earlier.value, least, parts)
                    if not hit.any():
                        continue
                    least = _fine(h)
                new[1:] = least[1:] != least[:-1]
                if earlier:
                    new[1:] |= ~hit[:-1]
                new[starts[:-1]] = True
                at = np.flatnonzero(new & hit if earlier else new)
                within, owner = _inside(starts, at)
                found.append(least[at[within]])
                docs.append(own[owner])
            if not found:
                continue
            h, doc = np.concatenate(found), np.concatenate(docs)
            if not len(h):
                continue
            order = np.argsort(h)
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            other = np.zeros(len(h), bool)
            other[1:] = doc[1:] != doc[:-1]
            other[first] = False
            h, twice = h[first], np.logical_or.reduceat(other, first)
            part, rest = _split_hash(h, parts)
            ends = np.searchsorted(part, np.arange(parts + 1))
            some = [i for i in range(parts) if ends[i] < ends[i + 1]]
            cut = [slice(ends[i], ends[i + 1]) for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([_pack(rest[c], True) for c in cut]), pa.array([np.packbits(twice[c]).tobytes() for c in cut])], names=["part", "h", "twice"]
            )

    def merge(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        hs = [_unpack(x.as_py()) for x in table["h"]]
        twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(h)) for x, h in zip(table["twice"], hs)]
        s = np.sort(np.concatenate(hs) << np.uint64(1) | np.concatenate(twice))
        same = (s & np.uint64(1)).astype(bool)
        s >>= np.uint64(1)
        same[1:] |= s[1:] == s[:-1]
        flags = np.zeros(span, bool)
        for place in _places(s[same], span):
            flags[place] = True
        return pa.table({"part": pa.array([part], pa.int32()), "raw": pa.array([np.packbits(flags, bitorder="little").tobytes()])})

    return _bit_table(rows.select("rid", "text", "at").mapInArrow(trimmed(scan), "part int, h binary, twice binary").groupBy("part").applyInArrow(merge, "part int, raw binary").collect(), bits, parts)


def _pieces(rows: DataFrame, alive: Callable, anchors, fine, parts: int) -> DataFrame:
    """rid, doc, start, h, g, body: the pieces of the candidate stretches of each text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = anchors.value
        for b in map(alive, batches):
            rids, docs = b.column(0).to_numpy(), b.column(1).to_numpy()
            row, start, bodies = [], [], []
            for own, raw, starts, h, least in _hashed(_texts(b.column(2))):
                some, hit = np.flatnonzero(_is_repeated(table, least, parts)), np.zeros(len(least) + 1, bool)
                if not len(some):
                    continue
                some = some[_is_repeated(fine.value, _fine(h)[some], parts)]
                hit[some[_inside(starts, some)[0]]] = True
                # the last windows of a text are never hit, so no stretch crosses its end
                edge = hit.copy()
                edge[1:] &= ~hit[:-1] | ((h[1 : len(hit)] & np.uint64(CUT - 1)) == 0)
                first, stops = np.flatnonzero(edge), np.flatnonzero(~hit)
                last = np.minimum(np.append(first[1:], len(hit)), stops[np.searchsorted(stops, first)])
                owner = np.searchsorted(starts, first, side="right") - 1
                for i, s, p, q in zip(own[owner].tolist(), starts[owner].tolist(), first.tolist(), last.tolist()):
                    for x in range(p, q, LONGEST):
                        row.append(i)
                        start.append(x - s)
                        bodies.append(raw[x : min(q, x + LONGEST) + WIDTH - 1])
            if row:
                ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, bodies)), "<i8").reshape(-1, 2)
                columns = [pa.array(rids[row]), pa.array(docs[row]), pa.array(start, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc", "start", "h", "g", "body"])

    return rows.select("rid", "doc", "text", "at").mapInArrow(trimmed(scan), "rid long, doc long, start long, h long, g long, body binary")


def _pack(a: np.ndarray, ascending: bool = False) -> bytes:
    """An array of numbers from 0 on in few bytes: the planes of their bytes, of their differences if they ascend."""
    a = a.astype(np.uint64)
    if ascending:
        a[1:] -= a[:-1].copy()
    width = (int(a.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(a).to_bytes(8, "little") + bytes([width, ascending]) + (_ZSTD.compress(planes.data, asbytes=True) if planes.size else b"")


def _unpack(raw: bytes) -> np.ndarray:
    n, width, ascending = int.from_bytes(raw[:8], "little"), raw[8], raw[9]
    out = np.zeros((n, 8), np.uint8)
    if n * width:
        out[:, :width] = np.frombuffer(_ZSTD.decompress(raw[10:], decompressed_size=n * width), np.uint8).reshape(width, n).T
    out = out.view(np.uint64).ravel()
    return np.cumsum(out, dtype=np.uint64) if ascending else out


class _Block:
    """A block of strings: their bytes in one buffer, and which positions are sampled."""

    def __init__(self, table: pa.Table):
        self.order = order = np.lexsort((table["g"].to_numpy(), table["h"].to_numpy()))
        self.h, self.g, self.doc = (table[c].to_numpy()[order] for c in ("h", "g", "doc"))
        bodies = table["body"].take(pa.array(order)).to_pylist()
        self.lengths = np.array([len(x) for x in bodies], np.int64)
        self.text = np.frombuffer(b"".join(bodies), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        at = np.arange(len(self.text)) - np.repeat(self.starts, self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - at  # bytes from here to the string's end
        self.residue = (at % 3).astype(np.int8)
        self.docs = np.repeat(self.doc, self.lengths)

    def words(self, at: np.ndarray) -> list[np.ndarray]:
        """The 18 bytes from each position on as numbers that compare like the bytes."""
        w, n = self.text.astype(np.uint64), 1
        two = w[:-1] << np.uint64(8) | w[1:]
        while n < 8:
            w = w[:-n] << np.uint64(8 * n) | w[n:]
            n *= 2
        return [w[at], w[at + 8], two[at + 16]]

    def sampled(self, depth: int) -> np.ndarray:
        return np.flatnonzero((self.residue > 0) & (self.left >= depth))

    def names(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct 18 bytes of sampled positions, in order, and by position which of them stand there."""
        at = self.sampled(18)
        words = self.words(at)
        some, inverse = _distinct(words)
        own = np.full(len(self.text), -1, np.int64)
        own[at] = inverse
        return [w[some] for w in words], own

    def ranks(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The same of 48 bytes, which are three of names(), in the same order as by the names that the block is sent."""
        own, at = self.names()[1], self.sampled(48)
        triples = [own[at], own[at + 15], own[at + 30]]
        some, inverse = _distinct(triples)
        out = np.full(len(self.text), -1, np.int64)
        out[at] = inverse
        return [x[some] for x in triples], out

    def merged(self, own: np.ndarray, ranks: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the window starts whose position `shift` further on is sampled along with another residue's: distinct merge
        keys in order, the block's smallest doc of each, positions, and their keys' places. A key is the rank there and
        the two bytes of the window that it doesn't cover. own: which of the block's ranks stand at each position."""
        residues = {0: (1, 2), 1: (0, 1), 2: (0, 2)}[shift]
        at = np.flatnonzero(((self.residue == residues[0]) | (self.residue == residues[1])) & (self.left >= WIDTH))
        a, b = {0: (48, 49), 1: (0, 49), 2: (0, 1)}[shift]
        keys = own[at + shift].astype(np.uint64) << np.uint64(16) | self.text[at + a].astype(np.uint64) << np.uint64(8) | self.text[at + b]
        order = np.argsort(keys)
        k, d = keys[order], self.docs[at[order]]
        new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        inverse = np.empty(len(k), np.int64)
        inverse[order] = np.cumsum(new) - 1
        k = k[first]
        k = ranks[(k >> np.uint64(16)).astype(np.int64)].astype(np.uint64) << np.uint64(16) | k & np.uint64(0xFFFF)
        return k, np.minimum.reduceat(d, first) if len(d) else d, at, inverse


def _dense(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the same order."""
    order = np.argsort(a)
    s, rank = a[order], np.empty(len(a), np.uint64)
    rank[order[:1]] = 0
    rank[order[1:]] = np.cumsum(s[1:] != s[:-1])
    return rank


def _joined(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers in the order of the keys' tuples. Numbers are sorted several times as fast as tuples."""
    out = keys[0].astype(np.uint64)
    for k in keys[1:]:
        pair = [out, k.astype(np.uint64)]
        for i in (0, 1):
            if sum(int(x.max(initial=0)).bit_length() for x in pair) > 64:
                pair[i] = _dense(pair[i])
        out = pair[0] << np.uint64(int(pair[1].max(initial=0)).bit_length()) | pair[1]
    return out


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one of each distinct key, in order, and each key's place among them."""
    key = _joined(keys)
    order = np.argsort(key)
    s, new = key[order], np.ones(len(key), bool)
    new[1:] = s[1:] != s[:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def _received(replies: pa.Table, kind: int) -> np.ndarray:
    mine = replies.filter(pa.array(replies["kind"].to_numpy() == kind)).sort_by("range")
    parts = [_unpack(x.as_py()).view(np.int64) | r << 32 for r, x in zip(mine["range"].to_pylist(), mine["names"])]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _send(block: int, ranges: np.ndarray, arrays: list[np.ndarray], count: int, first: int = 0) -> pa.Table:
    """Sorted arrays, the first one ascending, cut into rows by key range; ranges are numbered from `first`."""
    ends = np.searchsorted(ranges, np.arange(count + 1))
    some = [i for i in range(count) if ends[i] < ends[i + 1]]
    columns = {f"k{j}": pa.array([_pack(a[ends[i] : ends[i + 1]], not j) for i in some], pa.binary()) for j, a in enumerate(arrays)}
    return pa.table({"range": pa.array([first + i for i in some], pa.int32()), "block": pa.array([block] * len(some), pa.int32())} | columns)


_KEYS = "range int, block int, k0 binary, k1 binary, k2 binary"
_REPLY = "block int, range int, kind int, names binary"


def _read(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of a range's rows one after the other, and where each row ends."""
    rows = [[_unpack(x.as_py()) for x in table[f"k{j}"]] for j in range(3)]
    return [np.concatenate(r) for r in rows], np.cumsum([0, *(len(x) for x in rows[0])])


def _name(kind: int):
    """Sorts the keys of a range; the name of a key is the range and its rank in it, so names are in the keys' order.
    Ranks are sent back."""

    def run(table: pa.Table) -> pa.Table:
        columns, ends = _read(table)
        _, rank = _distinct(columns)
        return pa.table({
            "block": table["block"], "range": table["range"], "kind": pa.array([kind] * len(table), pa.int32()),
            "names": pa.array([_pack(rank[a:b], True) for a, b in zip(ends, ends[1:])], pa.binary()),
        })

    return run


def _trimmed(strings: DataFrame, total: int) -> DataFrame:
    """strings(h, g, doc, many, body, block) -> h, g, at, sh, sg, doc, body: the pieces, from `at` of a string on, of the
    stretches whose windows stand in it twice, in another string, or, by `many`, in several documents. Windows of equal
    hashes pass for equal here, which only keeps some more."""
    parts = 1 << min(16, max(3, (total // RANGE_KEYS).bit_length()))
    blocks = strings.groupBy("block")

    def hashes(b: _Block) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(b.left >= WIDTH)
        w = _window_hashes(b.text)[at]
        order = np.argsort(w)
        part, rest = _split_hash(w[order], parts)
        new = np.ones(len(w), bool)
        new[1:] = (rest[1:] != rest[:-1]) | (part[1:] != part[:-1])
        return at, order, np.flatnonzero(new), part[new], rest[new]

    def send(table: pa.Table) -> pa.Table:
        b = _Block(table)
        at, order, first, part, rest = hashes(b)
        many = np.repeat(table["many"].to_numpy()[b.order], b.lengths)[at][order]
        twice = np.logical_or.reduceat(many, first) | (np.diff(np.append(first, len(at))) > 1)
        return _send(table["block"][0].as_py(), part, [rest, twice, twice[:0]], parts)

    def compare(table: pa.Table) -> pa.Table:
        hs, twice = ([_unpack(x.as_py()) for x in table[c]] for c in ("k0", "k1"))
        ends, h = np.cumsum([0, *map(len, hs)]), np.concatenate(hs)
        order = np.argsort(h)
        s = h[order]
        same = np.concatenate(twice)[order] == 1
        same[1:] |= s[1:] == s[:-1]
        # the first of equal hashes, too
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        repeated = np.empty(len(h), bool)
        repeated[order] = np.repeat(np.logical_or.reduceat(same, first), np.diff(np.append(first, len(h))))
        names = [np.packbits(repeated[a:z]).tobytes() for a, z in zip(ends, ends[1:])]
        return pa.table({"block": table["block"], "range": table["range"], "kind": pa.array([0] * len(table), pa.int32()), "names": pa.array(names, pa.binary())})

    replies = blocks.applyInArrow(send, _KEYS).groupBy("range").applyInArrow(compare, _REPLY)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(table)
        at, order, first, part, _ = hashes(b)
        size = np.bincount(part, minlength=parts)
        mine = replies.sort_by("range")
        flags = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=size[r]) for r, x in zip(mine["range"].to_pylist(), mine["names"])])
        hit = np.zeros(len(b.text) + 1, bool)
        hit[at[order]] = np.repeat(flags, np.diff(np.append(first, len(at)))) == 1
        # no window starts in the last bytes of a string, so no stretch crosses its end
        h = _grams(b.text)
        edge = hit.copy()
        edge[1:] &= ~hit[:-1]
        edge[: len(h)] |= hit[: len(h)] & ((h & np.uint64(CUT - 1)) == 0)
        starts = np.flatnonzero(edge)
        stops = np.flatnonzero(~hit)
        ends = np.minimum(np.append(starts[1:], len(b.text)), stops[np.searchsorted(stops, starts)]) + WIDTH - 1
        owner = np.searchsorted(b.starts, starts, side="right") - 1
        raw = b.text.tobytes()
        bodies = [raw[p:q] for p, q in zip(starts.tolist(), ends.tolist())]
        ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, bodies)), "<i8").reshape(-1, 2)
        return pa.table({
            "h": pa.array(b.h[owner]), "g": pa.array(b.g[owner]), "at": pa.array((starts - b.starts[owner]).astype(np.int32)),
            "sh": pa.array(ids[:, 0]), "sg": pa.array(ids[:, 1]), "doc": pa.array(b.doc[owner]), "body": pa.array(bodies, pa.binary()),
        })

    return materialize(blocks.cogroup(replies.groupBy("block")).applyInArrow(cut, "h long, g long, at int, sh long, sg long, doc long, body binary"), "trimmed")


def _least_documents(strings: DataFrame, total: int) -> DataFrame:
    """strings(h, g, doc, body, block) -> h, g, at, least: from window `at` of a string on, the smallest doc that the
    50 bytes stand in; the string's own doc before the first."""
    count = max(8, -(-total * 2 // 3 // RANGE_KEYS))
    if count > MOST_RANGES:
        raise ValueError(f"{count} key ranges, but keys hold {MOST_RANGES}: RANGE_KEYS must grow")
    spark = strings.sparkSession
    # splitters from at most 20,000 strings' first words: they only even out the ranges
    heads = strings.select(F.substring("body", 2, 8).alias("w")).orderBy(F.xxhash64("w")).limit(20_000).toPandas()["w"]
    sample = np.sort(np.array([int.from_bytes(bytes(x).ljust(8, b"\0"), "big") for x in heads] or [0], np.uint64))
    edges = spark.sparkContext.broadcast(np.unique(sample[np.linspace(0, len(sample) - 1, count + 1).astype(int)[1:-1]]))
    blocks = strings.groupBy("block")

    def first(table: pa.Table) -> pa.Table:
        words, _ = _Block(table).names()
        return _send(table["block"][0].as_py(), np.searchsorted(edges.value, words[0], side="right"), words, count)

    one = materialize(blocks.applyInArrow(first, _KEYS).groupBy("range").applyInArrow(_name(1), _REPLY), "names")
    release(spark)

    def second(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        names = _received(replies, 1)
        keys = [names[x] for x in _Block(table).ranks()[0]]
        return _send(key[0].as_py(), keys[0] >> 32, [keys[0] & _LOW, *keys[1:]], count)

    two = materialize(blocks.cogroup(one.groupBy("block")).applyInArrow(second, _KEYS).groupBy("range").applyInArrow(_name(2), _REPLY), "ranks")
    release(spark)
    drop_table(one)

    def merge(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        # all pairs of residues at once: ranks are made once, and a block moves once; ranges say which pair is meant
        b = _Block(table)
        own, ranks, sent = b.ranks()[1], _received(replies, 2), []
        for shift in (0, 1, 2):
            k, d, _, _ = b.merged(own, ranks, shift)
            # a doc_id may be negative: as an unsigned number it is sent and comes back the same
            columns = [k >> np.uint64(16) & np.uint64(_LOW), k & np.uint64(0xFFFF), d.view(np.uint64)]
            sent.append(_send(key[0].as_py(), (k >> np.uint64(48)).astype(np.int64), columns, count, shift * count))
        return pa.concat_tables(sent)

    def compare(table: pa.Table) -> pa.Table:
        (rank, rest, d), ends = _read(table)
        shift, part = divmod(table["range"][0].as_py(), count)
        k, d = np.uint64(part) << np.uint64(48) | rank << np.uint64(16) | rest, d.view(np.int64)
        order = np.argsort(k)
        s = k[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        best = np.empty(len(k), np.int64)
        best[order] = np.repeat(np.minimum.reduceat(d[order], first), np.diff(np.append(first, len(k))))
        out = []
        for i, (a, z) in enumerate(zip(ends, ends[1:])):
            less = np.flatnonzero(best[a:z] < d[a:z]) + a
            if len(less):
                out.append((table["block"][i].as_py(), part, 10 + shift, _pack(k[less], True)))
                out.append((table["block"][i].as_py(), part, 20 + shift, _pack(best[less].view(np.uint64))))
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "range", "kind", "names"), columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))})

    least = materialize(blocks.cogroup(two.groupBy("block")).applyInArrow(merge, _KEYS).groupBy("range").applyInArrow(compare, _REPLY), "merged")
    release(spark)

    def last(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({n: pa.array([], t) for n, t in (("h", pa.int64()), ("g", pa.int64()), ("at", pa.list_(pa.int32())), ("least", pa.list_(pa.int64())))})
        b = _Block(table)
        own, ranks, best = b.ranks()[1], _received(replies, 2), b.docs.copy()
        for shift in (0, 1, 2):
            k, d, at, inverse = b.merged(own, ranks, shift)
            theirs, less = ([_unpack(x.as_py()) for x in replies.filter(pa.array(replies["kind"].to_numpy() == n + shift)).sort_by("range")["names"]] for n in (10, 20))
            for x, y in zip(theirs, less):
                d[np.searchsorted(k, x)] = y.view(np.int64)
            best[at] = np.minimum(best[at], d[inverse])
        # windows' smallest doc changes rarely along a string: runs are kept
        new = np.concatenate(([True], best[1:] != best[:-1]))
        new[b.starts] = True
        new &= b.left >= WIDTH
        where = np.flatnonzero(new)
        owner = np.searchsorted(b.starts, where, side="right") - 1
        cut = np.searchsorted(owner, np.arange(len(b.h) + 1))
        offsets = pa.array(cut, pa.int32())
        return pa.table({
            "h": pa.array(b.h), "g": pa.array(b.g), "at": pa.ListArray.from_arrays(offsets, pa.array((where - b.starts[owner]).astype(np.int32))),
            "least": pa.ListArray.from_arrays(offsets, pa.array(best[where])),
        })

    runs = materialize(blocks.cogroup(two.unionByName(least).groupBy("block")).applyInArrow(last, "h long, g long, at array<int>, least array<long>"), "runs")
    for table in (two, least):
        drop_table(table)
    return runs


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep=True also `kept` (binary).

    Texts are UTF-8 bytes, null is empty. A null doc_id counts as larger than all others; rows of the same doc_id are
    not smaller than each other. Texts under 50 bytes stay whole. An empty table gives no rows; extra columns are
    ignored.

    A text that also stands whole in a document of smaller doc_id goes whole, and takes no part in the sort."""
    # scanned again and again, so rows need a number that doesn't hang on the scan's partitions
    bound_batches(docs.sparkSession)
    frame = numbered(
        stored(docs, text, doc_id), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumnRenamed(ROW, "rid")
    facts = frame.select("doc_id", "doc", "rid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    facts = materialize(facts, "facts")
    n = facts.count()
    sizes = facts.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    repeated = attach(facts.select("rid", "doc", "n_bytes", "sha"), sizes.filter("n > 1"), "sha", "n", n)
    gone = materialize(repeated.filter((F.col("doc") > F.col("first")) & (F.col("n_bytes") >= WIDTH)).select("rid"), "whole")
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(gone, "rid"))

    # not stored: a scan costs less than another copy of the texts
    own = frame.select("rid", "doc", "text")
    mistaken = split_rows(facts.select("rid"), "rid", sent, True).join(gone, "rid", "left_anti").limit(MISTAKEN + 1).toPandas()["rid"].to_numpy(np.int64)
    if len(mistaken) <= MISTAKEN:
        rows = own.select("*", F.pmod(F.xxhash64("rid"), F.lit(TABLE_BITS)).alias("at"))
        alive = _alive(sent, docs.sparkSession.sparkContext.broadcast(mistaken))
    else:
        rows = split_rows(own, "rid", sent, False).unionByName(split_rows(own, "rid", sent, True).join(gone, "rid", "left_anti")).select("*", F.lit(0).alias("at"))
        alive = _same
    total = int(facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    anchors = docs.sparkSession.sparkContext.broadcast(_repeated_anchors(rows, alive, total))
    release(docs.sparkSession)
    fine = docs.sparkSession.sparkContext.broadcast(_repeated_anchors(rows, alive, total, anchors))
    release(docs.sparkSession)
    pieces = materialize(_pieces(rows, alive, anchors, fine, _parts(total)), "pieces")
    # bodies of equal identifiers are equal or grouped apart
    strings = pieces.groupBy("h", "g", "body").agg(F.min("doc").alias("doc"), F.count("*").alias("n"), (F.min("doc") < F.max("doc")).alias("many"))
    strings = materialize(strings, "strings")
    release(docs.sparkSession)

    def dealt(table: DataFrame, *columns: str) -> tuple[DataFrame, int]:
        size = int(table.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long")).first()[0])
        blocks = max(1, -(-size // BLOCK_BYTES))
        return table.select("h", "g", "doc", *columns, "body", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block")), size

    trims = _trimmed(*dealt(strings, "many"))
    strings, whole_strings = materialize(strings.select("h", "g", "n"), "counts"), strings
    drop_table(whole_strings)
    release(docs.sparkSession)
    parts = trims.groupBy(F.col("sh").alias("h"), F.col("sg").alias("g"), "body").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    parts = materialize(parts, "strings")
    places = materialize(trims.select("h", "g", "at", "sh", "sg"), "places")
    drop_table(trims)
    release(docs.sparkSession)
    runs = _least_documents(*dealt(parts))
    whole_parts, parts = parts, materialize(parts.select("h", "g", "n", F.octet_length("body").alias("length")), "lengths")
    drop_table(whole_parts)
    release(docs.sparkSession)
    # a run from `at` to the next one's; it goes if its smallest doc is smaller than this one
    ends = F.expr("transform(at, (x, i) -> struct(x as a, coalesce(try_element_at(at, i + 2), length - 49) as z, least[i] as d))")
    known = runs.join(parts, ["h", "g"]).select(F.struct("h", "g").alias("hg"), "n", ends.alias("runs"))
    inner = attach(places.select("h", "g", "at", F.struct(F.col("sh").alias("h"), F.col("sg").alias("g")).alias("hg")), known, "hg", "n", max(1, places.count()))
    moved = F.expr("transform(runs, r -> struct(r.a + at as a, r.z + at as z, r.d as d))")
    inner = inner.groupBy("h", "g").agg(F.flatten(F.collect_list(moved)).alias("runs"))
    inner = materialize(inner.join(strings, ["h", "g"]).select(F.struct("h", "g").alias("hg"), "n", "runs"), "inner")
    placed = attach(pieces.select("rid", "doc", "start", F.struct("h", "g").alias("hg")), inner, "hg", "n", max(1, n))
    spans = placed.select("rid", "doc", "start", F.explode("runs").alias("r")).filter("r.d < doc").select("rid", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.z") + WIDTH - 1).alias("z"))
    spans = materialize(spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("spans")), "spans")
    for table in (pieces, runs, strings, parts, places, inner):
        drop_table(table)
    release(docs.sparkSession)
    some = docs.sparkSession.sparkContext.broadcast(bit_table(spans, "rid"))
    cut = split_rows(own.select("rid", "text"), "rid", some, True).join(spans, "rid").select("rid", "text", F.col("spans.a").alias("a"), F.col("spans.z").alias("z"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, x, a, z in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                raw, parts, end, count, removed = x.as_py().encode(), [], 0, 0, 0
                for s, e in zip(a, z):
                    if s > end or not count:
                        parts.append(raw[end:s])
                        count += 1
                        removed += e - s
                        end = e
                    elif e > end:
                        removed += e - end
                        end = e
                left = b"".join(parts) + raw[end:]
                out.append((rid, removed, count, hashlib.sha256(left).hexdigest(), left if keep else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, types)], names=["rid", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = cut.mapInArrow(trimmed(remove), "rid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = gone.select("rid", F.lit(True).alias("whole"))
    all_rows = facts.join(changed, "rid", "left").join(whole, "rid", "left")
    is_whole = F.col("whole").isNotNull()
    out = all_rows.select(
        "doc_id", "n_bytes", F.when(is_whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(is_whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *(["rid", "kept", is_whole.alias("whole")] if keep else []),
    )
    if not keep:
        return out
    texts = own.select("rid", F.encode("text", "utf-8").alias("raw"))
    return out.join(texts, "rid", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.when(F.col("whole"), F.encode(F.lit(""), "utf-8")).otherwise(F.coalesce("kept", "raw")).alias("kept"))
