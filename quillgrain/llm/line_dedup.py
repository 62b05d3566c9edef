"""Fuzzy line de-duplication.

Lines are normalised (ASCII lower case, white space collapsed) and identified by a 128-bit hash;
equal lines are one node. Whether two nodes are linked is decided by edit similarity alone. Lines
meet in the buckets of twelve hash blocks, each of three minima over windows of eight bytes (five in
short lines). In a bucket a line is first offered to the two lines before it, in one fixed order, that
are nearest by a SimHash of its bytes; every offer is a row that is joined with its two lines and
tested alone. That links most groups. What then lies in one bucket but not yet in one group is tested
in full, inside the cells of the bucket, so no link of a bucket is lost. Large buckets are cells of
two blocks each: neither a bucket nor a group has to fit into a task, and no link hangs on the bounds
of batches. Of every connected group the occurrence in the smallest document, at the earliest place,
is kept.

Blocks of the SimHash itself would not do: pairs of edit similarity 0.8 differ in up to a third of
its bits, and blocks that survive this are too short to tell lines apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.llm.common import components, doc_key, in_cells, raw, shared, stored, whole_keys
from quillgrain.llm.simhash_dedup import SEED

SIMILARITY = 0.8
#: Blocks a line and minima a block; lines of SHORT bytes or fewer meet by short windows, those near it by both.
BANDS, ROWS, SHORT = 12, 3, 50
#: At first a line is offered to the REPS nearest lines before it in a cell; a bucket of more than CELL lines is several cells.
#: The cells of what is left, which hold texts, are of REST lines.
REPS, CELL, REST = 2, 4096, 512
#: Pairs of small cells that are tested at once.
POOL = 2000
#: What more than one in HOT lines are is joined by broadcast: HOT keys at most.
HOT = 2000


def normal(line: bytes) -> bytes:
    """Lower-cased words joined by one space."""
    return b" ".join(line.lower().split())


def windows(lines: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` bytes that start in each line, and the start and size of each line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    flat = b"".join([line + bytes(8) for line in lines])
    start = np.cumsum(size + 8) - size - 8
    mixed = np.empty(len(flat) - 7, np.uint64)
    for i in range(8):  # every eighth window, read as numbers of eight bytes
        mixed[i::8] = np.frombuffer(flat, "<u8", len(mixed[i::8]), i)
    mixed &= np.uint64((1 << 8 * width) - 1)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed, start, size


#: For a byte the eight bits, first the highest, as eight one-byte counters in a 64-bit word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def line_prints(lines: list[bytes]) -> np.ndarray:
    """SimHashes of normalised lines, none of them empty: of their windows of four bytes."""
    if not lines:
        return np.empty(0, np.int64)
    return np.concatenate([_prints([lines[i] for i in part]) for part in cached(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))])


def cached(rows: np.ndarray, size: np.ndarray, room: int = 100_000) -> list[np.ndarray]:
    """The rows in parts of about 100 kB, which stay in the processor's cache."""
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // room)) + 1)


def _prints(lines: list[bytes]) -> np.ndarray:
    mixed, start, size = windows(lines, 4)
    # one-byte counters hold 255 windows: longer lines are added up in parts
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    owner = np.repeat(np.arange(len(lines)), parts)
    at = 255 * (np.arange(len(owner)) - first[owner])
    ends = np.stack([start[owner] + at, start[owner] + np.minimum(at + 255, size[owner])], axis=1).ravel()
    # the last end may lie past the windows
    eight = np.concatenate([mixed, mixed[:1]]).view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.add.reduceat(_LANES[eight[:, i]], ends)[::2] for i in range(8)], axis=1)
    ones = np.add.reduceat(ones.view(np.uint8).reshape(len(owner), 64).astype(np.int64), first, axis=0)
    return np.packbits(ones * 2 > size[:, None], axis=1).view(">i8").astype(np.int64).ravel()


def edits(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance: equal ends are cut off, the rest goes through Myers' bit vectors.

    Once the distance is sure to pass `most`, any larger value is given.
    """
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    plus, minus, score = full, 0, len(a)
    for left, c in zip(range(len(b), 0, -1), b, strict=True):
        if score - left > most:  # a column changes it by one at most
            return score - left
        eq = where.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        score += 1 if up & top else -1 if down & top else 0
        up, down = (up << 1) | 1, down << 1
        plus, minus = (down | (full & ~((eq | minus) | up))) & full, up & (eq | minus) & full
    return score


def grams(line: str) -> np.ndarray:
    """How often the three-character grams of a line fall into each of 1,024 classes."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) & np.uint32(1023), minlength=1024)


def least_edits(a: str, b: str) -> int:
    """A lower bound of the edits: one edit takes away three grams at most."""
    if min(len(a), len(b)) < 3:
        return 0
    more = grams(a) - grams(b)
    return -(-int(max(more[more > 0].sum(), -more[more < 0].sum())) // 3)


def most_edits(a: str, b: str, most: float = float("inf")) -> int:
    """An upper bound of the edits: words are paired in order, and where they differ, up to six are passed over.

    Once it is sure to pass `most`, any larger value is given.
    """
    x, y = a.split(" "), b.split(" ")
    n, m, cost = len(x), len(y), 0
    x.append("")
    y.append("")
    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p, q = 1, 1
        for p, q in _STEPS:
            if i + p <= n and j + q <= m and x[i + p] == y[j + q]:
                break
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most:
            return cost
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:n])) + n - i + sum(map(len, y[j:m])) + m - j


#: The ways to pass over words on both sides, the fewest first; none of them fitting, the last is taken.
_STEPS = [(s - q, q) for s in (2, 1, 3, 4, 5, 6) for q in sorted(range(s + 1), key=lambda q: abs(s - 2 * q))] + [(1, 1)]


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their equal ends, which cost no edit."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    return a[: len(a) - i], b[: len(b) - i]


def side_by_side(pairs: list[tuple[str, str]]) -> list[int]:
    """Edits of many pairs, none of them with an empty side: their bit vectors lie side by side in one integer.

    A pair's lane is the bits of its first line and at least one more, which takes the carry. The
    distance is the length of the second line and what the vertical differences add up to.
    """
    sides = [[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in p] for p in pairs]
    wide = [len(a) // 8 + 1 for a, _ in sides]
    at = np.cumsum([0, *wide])
    eq = np.zeros((max(len(b) for _, b in sides), int(at[-1])), np.uint8)
    ends: dict[int, list[int]] = {}
    full = low = 0
    for k, (a, b) in enumerate(sides):
        signs, own = np.unique(a, return_inverse=True)
        hot = np.zeros((len(signs) + 1, 8 * wide[k]), bool)  # the last row: a sign that the first line lacks
        hot[own, np.arange(len(a))] = True
        found = np.minimum(np.searchsorted(signs, b), len(signs) - 1)
        rows = np.where(signs[found] == b, found, len(signs))
        eq[: len(b), at[k] : at[k + 1]] = np.packbits(hot, axis=1, bitorder="little")[rows]
        ends.setdefault(len(b), []).append(k)
        full |= ((1 << len(a)) - 1) << 8 * int(at[k])
        low |= 1 << 8 * int(at[k])
    plus, minus, out = full, 0, [0] * len(pairs)
    for j, column in enumerate(eq, 1):
        same = int.from_bytes(column.tobytes(), "little")
        x = (((same & plus) + plus) ^ plus) | same | minus
        up = ((minus | (full & ~(x | plus))) << 1) | low
        plus, minus = (((plus & x) << 1) | ~(x | up)) & full, up & x & full
        if j in ends:
            more, less = (v.to_bytes(int(at[-1]), "little") for v in (plus, minus))
            for k in ends[j]:
                own_plus, own_minus = (int.from_bytes(v[at[k] : at[k + 1]], "little") for v in (more, less))
                out[k] = j + own_plus.bit_count() - own_minus.bit_count()
    return out


#: Characters of a piece, lanes that are searched at once, classes of characters; longer lines than LONG aren't cut into pieces.
PIECE, ROOM, CLASSES, LONG = 64, 4096, 128, 4096
#: Characters of the pairs that are looked at together.
PART = 2_000_000


def pieced(pairs: list[tuple[str, str]], most: list[float]) -> np.ndarray:
    """Whether a lower bound of the edits of each pair is at most `most`; no line is empty.

    The first line is cut into pieces of up to 64 characters. In any way to edit it into the second line within
    `most` each piece lies at most that far from its own place, so the pieces' least edits there add up to no more
    than those of the lines. All pieces are searched at once, a bit vector each; what shares a class counts as equal.
    """
    if not pairs:
        return np.empty(0, bool)
    flat, start, size = [], [], []
    for side in zip(*pairs, strict=True):
        codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in side]
        size.append(np.fromiter(map(len, codes), np.int64, len(codes)))
        start.append(np.cumsum(size[-1]) - size[-1])
        flat.append((np.concatenate(codes) % CLASSES).astype(np.uint8))
    far = np.array(most).astype(np.int64)
    n = -(-size[0] // PIECE)
    own = np.repeat(np.arange(len(pairs)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    begin, end = at * size[0][own] // n[own], (at + 1) * size[0][own] // n[own]
    gap = size[1] - size[0]
    low = np.maximum(begin - (far - gap)[own] // 2, 0)
    width = np.maximum(np.minimum(end + (far + gap)[own] // 2, size[1][own]) - low, 0)
    least, near = np.zeros(len(own), np.int64), np.ones(len(pairs), bool)
    for half in (0, 1):  # half of the pieces settle many pairs
        order = np.flatnonzero((at % 2 == half) & near[own])
        order = order[np.argsort(width[order], kind="stable")]
        for k in np.split(order, range(ROOM, len(order), ROOM)):
            least[k] = _least_inside(flat, start[0][own[k]] + begin[k], (end - begin)[k], start[1][own[k]] + low[k], width[k])
        near = np.add.reduceat(least, np.cumsum(n) - n) <= np.array(most)
    return near


def _least_inside(flat: list[np.ndarray], a: np.ndarray, m: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Per lane the least edits between the `m` characters from `a` on and any part of the `width` from `b` on.

    Myers' search; the lanes come by width, so those that are through lie before the others.
    """
    row = np.arange(len(a)) * CLASSES
    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    where = np.zeros(len(a) * CLASSES, np.uint64)
    np.add.at(where, np.repeat(row, m) + flat[0][np.repeat(a, m) + step], np.uint64(1) << step.astype(np.uint64))
    one, top = np.uint64(1), (m - 1).astype(np.uint64)
    plus, minus = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    score, best = m.astype(np.uint64), m.astype(np.uint64)
    done = np.searchsorted(width, np.arange(width.max(initial=0)), "right").tolist()
    for j, f in enumerate(done):
        p, t, s = plus[f:], top[f:], score[f:]
        eq = where[row[f:] + flat[1][b[f:] + j]]
        x = eq & p
        x += p
        x ^= p
        x |= eq
        eq |= minus[f:]
        x |= minus[f:]
        up, down = ~(x | p), x & p
        up |= minus[f:]
        s += (up >> t) & one
        s -= (down >> t) & one
        np.minimum(best[f:], s, out=best[f:])
        up <<= one
        down <<= one
        np.bitwise_and(up, eq, out=minus[f:])
        up |= eq
        np.bitwise_or(down, ~up, out=p)
    return best.astype(np.int64)


#: Bytes of the columns that pairs side by side may have; a longer pair goes alone.
GROUP_BYTES = 2 << 20


def similar(pairs: list[tuple[str, str]], least: float = SIMILARITY, alike: bool = True) -> list[bool]:
    """Whether 1 - edits / longer length is at least `least`; bounds of the edits settle most pairs.

    Where many pairs are `alike`, the upper bound comes first; elsewhere it isn't worth its time.
    """
    ok = [False] * len(pairs)
    bound = [(1 - least) * max(len(a), len(b)) + 1e-9 for a, b in pairs]
    fit = [k for k, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= bound[k]]
    if alike:
        for k in fit:
            ok[k] = most_edits(*pairs[k], bound[k]) <= bound[k]
        fit = [k for k in fit if not ok[k]]
    size = np.fromiter((len(a) + len(b) for a, b in pairs), np.int64, len(pairs))
    near = [k for k in fit if 0 < min(map(len, pairs[k])) and max(map(len, pairs[k])) <= LONG]
    off = set(near)
    for way in (1, -1):  # the other way the pieces lie otherwise
        parts = [part.tolist() for part in cached(np.array(near, np.int64), size, PART)]
        near = [k for part in parts for k, held in zip(part, pieced([pairs[k][::way] for k in part], [bound[k] for k in part]), strict=True) if held]
    off -= set(near)
    left = []
    for k in fit:
        (a, b), most = pairs[k], bound[k]
        if k in off:
            continue
        x, y = trimmed(a, b)
        if not x or not y:
            ok[k] = len(x) + len(y) <= most
        elif len(y) * (len(x) // 8 + 1) > GROUP_BYTES:
            ok[k] = least_edits(a, b) <= most and edits(x, y, most) <= most
        else:
            left.append((len(y), k, most, x, y))
    left.sort()
    part, size = [], 0
    for i, item in enumerate(left):
        part.append(item)
        size += len(item[3]) // 8 + 1
        # pairs come by length: the next one has the most columns
        if i + 1 == len(left) or (size + len(left[i + 1][3]) // 8 + 1) * left[i + 1][0] > GROUP_BYTES:
            for (_, k, most, _, _), d in zip(part, side_by_side([(x, y) for *_, x, y in part]), strict=True):
                ok[k] = d <= most
            part, size = [], 0
    return ok


def sketch(lines: list[bytes], width: int) -> np.ndarray:
    """For each normalised line BANDS hashes, each of ROWS minima over its windows of `width` bytes."""
    mixed, start, size = windows(lines, width)
    mixed = mixed.astype(np.uint32)
    ends = np.stack([start, start + size], axis=1).ravel()
    out, turned = np.zeros((len(lines), BANDS), np.uint32), np.empty_like(mixed)
    for k, (salt, odd) in enumerate(_PERMUTATIONS):
        np.multiply(np.bitwise_xor(mixed, salt, out=turned), odd, out=turned)
        least = np.minimum.reduceat(turned, ends)[::2]
        out[:, k // ROWS] = (out[:, k // ROWS] ^ least) * np.uint32(0x85EBCA6B) + (least >> np.uint32(15))
    return out


_PERMUTATIONS = np.random.default_rng(SEED).integers(0, 2**32, (BANDS * ROWS, 2), dtype=np.uint32) | np.array([0, 1], np.uint32)


def bands_of(lines: list[bytes]) -> pa.Array:
    """Per line the band hashes of its long windows, then those of its short ones; null where it has none."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    found = np.zeros((len(lines), 2 * BANDS), np.uint32)
    gone = np.ones((len(lines), 2 * BANDS), bool)
    for at, (width, own) in enumerate(((8, size >= SHORT * SIMILARITY), (5, size <= SHORT / SIMILARITY))):
        for part in cached(np.flatnonzero(own), size):
            if len(part):
                found[part, at * BANDS : (at + 1) * BANDS] = sketch([lines[i] for i in part], width)
                gone[part, at * BANDS : (at + 1) * BANDS] = False
    values = pa.array(found.view(np.int32).ravel(), pa.int32(), mask=gone.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, 2 * BANDS, dtype=np.int32)), values)


def nearest_before(fp: np.ndarray, n: np.ndarray, side: np.ndarray, lead: int, reps: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For the rows from `lead` on: pairs (row, earlier row) with the `reps` nearest of fitting length.

    In a cell of two blocks, sides 0 and 1, the rows of one block are paired with those of the other alone.
    """
    far = np.bitwise_count(fp[lead:, None] ^ fp[None, :])
    fits = np.abs(n[lead:, None] - n[None, :]) <= (1 - least) * np.maximum(n[lead:, None], n[None, :]) + 1e-9
    apart = (side[lead:, None] != side[None, :]) | (side[None, :] < 0)
    far[~(fits & apart) | (np.arange(len(fp))[None, :] >= np.arange(lead, len(fp))[:, None])] = 255
    rows = np.arange(len(far))
    out = []
    for _ in range(min(reps, len(fp))):
        at = far.argmin(axis=1)
        hit = far[rows, at] < 255
        if not hit.any():
            break
        out.append((lead + rows[hit], at[hit]))
        far[rows, at] = 255
    return tuple(np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def offers(reps: int = REPS, least: float = SIMILARITY, part: int = 256):
    """A task over (key, side, id, fp, n) rows by key: (u, v) offers a line of a cell to the `reps` nearest before it.

    A cell is looked at as a whole, whatever the batches were; `part` rows at a time are compared with those before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches):
            key, ids, fp, n = (pdf[c].to_numpy(np.int64) for c in ("key", "id", "fp", "n"))
            side = pdf["side"].fillna(-1).to_numpy(np.int64)
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            # whole buckets of two rows, most of all, at once
            v = start[size == 2]
            fits = np.abs(n[v] - n[v + 1]) <= (1 - least) * np.maximum(n[v], n[v + 1]) + 1e-9
            us, vs = [v[fits] + 1], [v[fits]]
            for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for lead in range(0, m, part):
                    cell = slice(s, s + min(m, lead + part))
                    u, v = nearest_before(fp[cell], n[cell], side[cell], lead, reps, least)
                    us.append(s + u)
                    vs.append(s + v)
            if sum(map(len, us)):
                yield pd.DataFrame({"u": ids[np.concatenate(us)], "v": ids[np.concatenate(vs)]})

    return run


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose lines pass the edit test, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)
            ok = similar([(x.decode(errors="replace"), y.decode(errors="replace")) for x, y in both], least)
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    lines = pairs.join(texts.select(F.col("id").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("line").alias("b")), "v")
    return lines.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def letters(lines: list[str]) -> np.ndarray:
    """How often the characters of each line fall into each of 32 classes, 255 at most."""
    codes = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) & np.uint32(31) for x in lines)
    return np.array([np.minimum(np.bincount(c, minlength=32), 255) for c in codes], np.int16).reshape(-1, 32)


def unlinked(least: float = SIMILARITY, part: int = 128):
    """A task over (key, side, root, line) rows by key: (u, v) links between the groups `root` of a cell.

    Every two lines of different groups whose lengths and letters allow it go through the edit test, `part`
    rows at a time against those before; an edit changes the number of one letter on either side by one at most.
    """

    def offered(lines: list[str], root: np.ndarray, side: np.ndarray, lead: int, held: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(lead, min(lead + part, len(lines)))[:, None]
        most = (1 - least) * np.maximum(n[rows], n) + 1e-9
        apart = (side[rows] != side) | (side < 0)
        i, j = np.nonzero((np.arange(len(lines)) < rows) & (root[rows] != root) & (np.abs(n[rows] - n) <= most) & apart)
        far, most = held[i + lead] - held[j], most[i, j]
        near = np.flatnonzero(np.maximum(np.maximum(far, 0).sum(axis=1), np.maximum(-far, 0).sum(axis=1)) <= most)
        return i[near] + lead, j[near]

    def links(pool: list[tuple[str, str, int, int]]) -> set[tuple[int, int]]:
        return {(u, v) for (_, _, u, v), ok in zip(pool, similar([(a, b) for a, b, _, _ in pool], least, alike=False), strict=True) if ok}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches, 2000):
            key, root = pdf["key"].to_numpy(np.int64), pdf["root"].to_numpy(np.int64)
            side = pdf["side"].fillna(-1).to_numpy(np.int64)
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist()
            found, pool = set(), []
            for s, e in zip(start, [*start[1:], len(key)], strict=True):
                if (root[s:e] == root[s]).all():
                    continue
                lines = [x.decode(errors="replace") for x in pdf["line"][s:e]]
                held, n, group = letters(lines), np.fromiter(map(len, lines), np.int64, e - s), root[s:e].copy()
                for lead in range(0, e - s, part):
                    i, j = offered(lines, group, side[s:e], lead, held, n)
                    pool += [(lines[x], lines[y], int(group[x]), int(group[y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    # small cells are tested together; in a large one, what was linked needs no more tests
                    if len(pool) >= POOL or e - s > part:
                        new = links(pool)
                        found |= new
                        pool = []
                        for u, v in new:
                            group[group == u] = v
            found |= links(pool)
            if found:
                yield pd.DataFrame(list(found), columns=["u", "v"])

    return run


def similar_groups(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(node, root): the connected groups of the nodes that share a bucket and whose lines are similar."""
    sketches = nodes.select("id", F.posexplode("bands")).where("col is not null")
    dealt = sketches.select((F.col("pos").cast("long") * 2**32 + F.col("col")).alias("key"), "id")
    dealt = stored(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, id long"))
    texts = stored(line_texts(nodes.join(dealt.select("id").distinct(), "id"), docs, id_col, text_col))
    known = in_cells(dealt, CELL).join(texts.select("id", "fp", "n"), "id")
    ordered = known.repartition("key").sortWithinPartitions("key", F.hash("id"), "id").select("key", "side", "id", "fp", "n")
    first = components(verified(ordered.mapInPandas(offers(least=least), "u long, v long").distinct(), texts, least))
    return joined(first, rest_links(dealt, first, texts, least))


def rest_links(dealt: DataFrame, groups: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (u, v) between the groups (node, root) that meet in a bucket; a node of no group is one of its own.

    In a bucket of REPS + 1 lines or fewer every line was offered to all before it.
    """
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > REPS + 1).select("key")
    rows = stored(dealt.join(large, "key").join(groups.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    mixed = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rows = stored(rows.join(mixed, "key", "left_semi"))
    lines = texts.join(rows.select("id", "root").distinct(), "id").select("id", "root", "line")
    # the work of a cell grows with its pairs, not its bytes: partitions aren't put together by their bytes
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = in_cells(rows.select("key", "id"), REST).join(lines, "id").repartition(parts, "key").sortWithinPartitions("key", F.hash("id"), "id")
    return cells.select("key", "side", "root", "line").mapInPandas(unlinked(least), "u long, v long")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (node, root) after links between their roots, or nodes of no group, came in."""
    more = stored(components(links).select(F.col("node").alias("root"), F.col("root").alias("last")))
    old = groups.join(more, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    new = more.join(groups.select(F.col("node").alias("root")), "root", "left_anti")
    return old.unionByName(new.select(F.col("root").alias("node"), F.col("last").alias("root")))


def line_texts(asked: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, fp, n): the normalised lines of the asked nodes with SimHash and characters, taken from the documents of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [normal(x.as_py()) for x in b.column("line")]
            n = [len(x.decode(errors="replace")) for x in lines]
            yield pa.record_batch([b.column("id"), pa.array(lines, pa.binary()), pa.array(line_prints(lines)), pa.array(n, pa.int64())], ["id", "line", "fp", "n"])

    by_doc = asked.groupBy(F.col("at._d").alias("_d"), F.col("at._t").alias("_t")).agg(F.collect_list(F.struct("id", F.col("at.pos").alias("pos"))).alias("asked"))
    texts = doc_key(docs.select(id_col, text_col), id_col, text_col).select("_d", "_t", F.col(text_col).alias("t"))
    # the text is split once a document, and only the asked lines are copied out of it
    own = F.flatten(F.transform(F.array(F.split("t", "\n", -1)), lambda x: F.transform("asked", lambda a: F.struct(a["id"].alias("id"), F.element_at(x, a["pos"] + 1).cast("binary").alias("line")))))
    # the hash join builds on the places and spares sorting whole texts; rows that repeat a document give their lines once more
    rows = texts.join(by_doc.hint("shuffle_hash"), ["_d", "_t"]).select(F.inline(own))
    return rows.mapInArrow(run, "id long, line binary, fp long, n long").dropDuplicates(["id"])


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_d, _t, pos, key, bands) of every line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, lines = [], [], []
            for i, text in enumerate(b.column("t")):
                for k, line in enumerate(text.as_py().split(b"\n")):
                    if w := normal(line):
                        at.append(i)
                        pos.append(k)
                        lines.append(w)
            rows = pa.array(at, pa.int64())
            key = pa.array([xxhash.xxh3_128_digest(w) for w in lines], pa.binary())
            yield pa.record_batch([b.column("_d").take(rows), b.column("_t").take(rows), pa.array(pos, pa.int32()), key, bands_of(lines)], ["_d", "_t", "pos", "key", "bands"])

    rows = doc_key(docs.select(id_col, text_col), id_col, text_col).select("_d", "_t", raw(text_col).alias("t"))
    return rows.mapInArrow(run, "_d long, _t long, pos int, key binary, bands array<int>")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(_d, _t, gone): the positions of the lines of each document that repeat a kept line."""
    lines = stored(lines_of(docs, id_col, text_col))
    nodes = stored(
        lines.groupBy("key").agg(F.first("bands").alias("bands"), F.min(F.struct("_d", "_t", "pos")).alias("at"), F.count("*").alias("n"))
        .withColumn("id", F.xxhash64("key"))
    )
    roots = similar_groups(nodes, docs, id_col, text_col, least)
    fuzzy = nodes.select("id", "at").join(roots.withColumnRenamed("node", "id"), "id")
    groups = fuzzy.join(fuzzy.groupBy("root").agg(F.min("at").alias("kept")), "root").select("id", "kept")
    kept = stored(nodes.select("id", "key", "at", "n").join(groups, "id", "left").where("n > 1 or kept is not null").select("key", "n", F.coalesce("kept", "at").alias("k")))
    # a line that more than one in HOT lines are is one of HOT at most, and is broadcast; no other key is large
    often = F.col("n") > lines.count() / HOT
    own = lines.select("_d", "_t", "pos", "key").join(F.broadcast(kept.where(often).select("key", F.col("k").alias("k1"))), "key", "left")
    few = own.where("k1 is null").drop("k1").join(kept.where(~often).select("key", "k"), "key")
    every = own.where("k1 is not null").withColumnRenamed("k1", "k").unionByName(few)
    gone = every.where("not (_d = k._d and _t = k._t and pos = k.pos)")
    return stored(gone.groupBy("_d", "_t").agg(F.sort_array(F.collect_set("pos")).alias("gone")))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows with repeated lines taken out of the text; n_lines and n_lines_removed are added or replaced.

    Lines without a word are left alone. Null and empty texts stay as they are, an empty table stays
    empty. Rows equal in id and text are one document, so each of them keeps the same lines; rows
    that share only their id are documents of their own; a null id counts as the largest. All other
    columns stay, whatever their names.
    """
    d, t, gone = (f"{x}_{uuid.uuid4().hex}" for x in ("d", "t", "gone"))
    found = repeated_lines(docs, id_col, text_col, least).select(F.col("_d").alias(d), F.col("_t").alias(t), F.col("gone").alias(gone))
    joined = doc_key(docs, id_col, text_col, d, t).join(found.hint("shuffle_hash"), [d, t], "left")
    split = F.split(text_col, "\n", -1)

    def left(x):  # the lines between those that go, each run copied once
        ends = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(x)))
        runs = F.zip_with(ends, F.slice(ends, 2, F.size(ends)), lambda a, b: F.when(b.isNotNull(), F.slice(x, a + 2, b - a - 1)))
        return F.array_join(F.flatten(F.slice(runs, F.lit(1), F.size(runs) - 1)), "\n")

    return joined.withColumns({
        "n_lines": F.coalesce(F.when(F.col(text_col) == "", 0).otherwise(F.size(split)), F.lit(0)),
        "n_lines_removed": F.coalesce(F.size(gone), F.lit(0)),
        text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.element_at(F.transform(F.array(split), left), 1)),
    }).drop(d, t, gone)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document with its repeated lines removed."""
    from quillgrain.llm.common import table

    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_lines_removed", "text")
