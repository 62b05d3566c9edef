"""SentencePiece encoding and decoding by suffix-array matching.

A task gathers the words of its batch that it hasn't met (a word is a run of spaces with what
follows them; no piece goes on past it), concatenates them, builds the suffix array of the batch
and finds the occurrence range of every piece by binary search. The occurrences are the edges of a
lattice; sorted by position they are relaxed in one pass. For a model of merges (BPE) the relaxing
rule is not a sum of scores, which wouldn't give the merges' result: an edge is taken if its piece
and the last piece of what precedes it stay apart when the two are merged alone. Exactly one edge
into each position passes, and the path is that of the merges. For a unigram model the best sum of
scores is relaxed as usual. Characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrain.llm.common import raw

#: Where the vocabulary lies; a parameter of every public function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁".encode()
WORDS = re.compile(rb"\n|(?:\xe2\x96\x81)*(?:[^\n\xe2]|\xe2(?!\x96\x81))+|(?:\xe2\x96\x81)+", re.S)
BATCH_BYTES, ROOM = 1 << 19, 500_000


@dataclass
class Vocabulary:
    """The pieces that can match (UTF-8, with the space mark), their ids and scores."""

    path: str
    texts: list[bytes]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]
    surface: list[bytes]
    merges: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece as spm

        m = spm.SentencePieceProcessor(model_file=path)
        byte_ids, texts, ids, scores, surface = [-1] * 256, [], [], [], []
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            surface.append(b"")
            if m.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surface[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                texts.append(piece.encode())
                ids.append(i)
                scores.append(m.get_score(i))
                surface[i] = piece.encode().replace(SPACE, b" ")
        return cls(path, texts, ids, scores, byte_ids, surface, min(scores, default=0) <= -len(scores) / 2)


def suffix_array(text: bytes, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the `reach` bytes from them on (doubling), and the 8 bytes at each."""
    b = np.frombuffer(text + bytes(reach + 8), np.uint8)
    n = len(text)
    eight = np.zeros(n + reach, np.uint64)
    for i in range(8):
        eight = (eight << np.uint64(8)) | b[i : i + n + reach]
    rank, width = np.unique(eight[:n], return_inverse=True)[1].astype(np.int64), 8
    while width < reach:
        later = np.zeros(n, np.int64)
        later[: max(0, n - width)] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank), eight


class Matcher:
    """Binary search of all pieces at once in the suffix array of a text."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces])
        self.blocks = -(-int(self.sizes.max()) // 8)
        padded = np.frombuffer(b"".join(p.ljust(8 * self.blocks, b"\0") for p in pieces), ">u8")
        self.keys = padded.astype(np.uint64).reshape(len(pieces), self.blocks)
        held = np.clip(self.sizes[:, None] - 8 * np.arange(self.blocks), 0, 8).astype(np.uint64)
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.masks = np.where(held == 0, np.uint64(0), ones << (np.uint64(8) * (np.uint64(8) - np.maximum(held, 1))))

    def _bound(self, sa: np.ndarray, eight: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(self.keys), np.int64), np.full(len(self.keys), len(sa))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = sa[np.minimum(mid, len(sa) - 1)]
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for j in range(self.blocks):
                part = eight[at + 8 * j] & self.masks[:, j]
                less |= same & (part < self.keys[:, j])
                same &= part == self.keys[:, j]
            right = open_ & (less | same if after else less)
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece number of all occurrences."""
        sa, eight = suffix_array(text, 8 * self.blocks)
        lo, hi = self._bound(sa, eight, False), self._bound(sa, eight, True)
        count = hi - lo
        piece = np.repeat(np.arange(len(count)), count)
        start = sa[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        return start, start + self.sizes[piece], piece


class Encoder:
    """Encodes texts; keeps the ids of words it has met, for a bounded number of them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.matcher = vocabulary, Matcher(vocabulary.texts)
        self.number = {p: i for i, p in enumerate(vocabulary.texts)}
        self.scores, self.ids, self.byte_ids = (np.array(x) for x in (vocabulary.scores, vocabulary.ids, vocabulary.byte_ids))
        self.pairs, self.apart = np.empty(0, np.int64), np.empty(0, bool)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _merged(self, text: str) -> list[str]:
        """Merges of one short string: the best piece first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                n = self.number.get((parts[i] + parts[i + 1]).encode())
                if n is not None and (best is None or self.v.scores[n] > best[0]):
                    best = self.v.scores[n], i
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _stay_apart(self, keys: np.ndarray) -> np.ndarray:
        """Whether pieces a (-1: a word's start) and b, merged alone, come out as they are.

        A key is (a + 1) * pieces + b; what has been worked out is kept in order of the keys.
        """
        at = np.searchsorted(self.pairs, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.pairs)
        new[inside] = self.pairs[at[inside]] != keys[inside]
        if new.any():
            fresh, size = np.unique(keys[new]), len(self.v.texts)
            if len(self.pairs) > 8 * ROOM:
                self.pairs, self.apart = np.empty(0, np.int64), np.empty(0, bool)
                fresh = np.unique(keys)
            found = []
            for a, b in zip((fresh // size - 1).tolist(), (fresh % size).tolist(), strict=True):
                parts = [self.v.texts[x].decode() for x in (a, b) if x >= 0]
                found.append(self._merged("".join(parts)) == parts)
            where = np.searchsorted(self.pairs, fresh)
            self.pairs, self.apart = np.insert(self.pairs, where, fresh), np.insert(self.apart, where, found)
            at = np.searchsorted(self.pairs, keys)
        return self.apart[at]

    def _learn(self, words: list[bytes]) -> None:
        """Suffix array, occurrence ranges, edges by position, one pass of relaxing over all words at once."""
        text = b"\xff".join(words) + b"\xff"
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes + 1) - sizes - 1
        starts, ends, pieces = self.matcher.edges(text)
        own = np.repeat(begin, sizes + 1)  # where the word of each byte begins
        depth = ends - own[starts]
        order = np.argsort(depth * len(text) + starts)  # by position in the word
        starts, ends, pieces, depth = starts[order], ends[order], pieces[order], depth[order]
        fresh = np.frombuffer(text, np.uint8) & 0xC0 != 0x80  # where a character or a separator starts
        marks = np.flatnonzero(fresh)
        stop, before = marks[1:], marks[:-1]
        inner = np.frombuffer(text, np.uint8)[before] != 0xFF  # ends of characters, and where they start
        stop, before = stop[inner], before[inner]
        stop_depth = stop - own[before]
        order = np.argsort(stop_depth)
        stop, before, stop_depth = stop[order], before[order], stop_depth[order]
        none = -2
        last = np.full(len(text) + 1, none)  # the piece that ends here; -1: a start, or a character without piece
        back, gain = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1)
        last[begin] = -1
        size, worst = len(self.v.texts), float(self.scores.min()) - 10
        levels = np.unique(stop_depth)
        edge_at, stop_at = np.searchsorted(depth, [levels, levels + 1]), np.searchsorted(stop_depth, [levels, levels + 1])
        for e0, e1, s0, s1 in zip(*edge_at.tolist(), *stop_at.tolist(), strict=True):
            s, e, p = starts[e0:e1], ends[e0:e1], pieces[e0:e1]
            live = last[s] != none
            s, e, p = s[live], e[live], p[live]
            if self.v.merges:
                ok = self._stay_apart((last[s] + 1) * size + p)
                last[e[ok]], back[e[ok]] = p[ok], s[ok]
            else:
                total = gain[s] + self.scores[p]
                best = np.lexsort((total, e))[::-1]  # the best of each end comes first
                e, s, p, total = e[best], s[best], p[best], total[best]
                one = np.r_[True, e[1:] != e[:-1]] if len(e) else np.empty(0, bool)
                last[e[one]], back[e[one]], gain[e[one]] = p[one], s[one], total[one]
            at, prev = stop[s0:s1], before[s0:s1]
            lost = last[at] == none
            at, prev = at[lost], prev[lost]
            last[at], back[at], gain[at] = -1, prev, gain[prev] + worst
        self._keep(words, text, begin, begin + sizes, last, back)

    def _keep(self, words: list[bytes], text: bytes, begin: np.ndarray, end: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """Walks all paths back, from the ends of the words, and files their ids."""
        octets, at, number = np.frombuffer(text, np.uint8), end.copy(), np.arange(len(words))
        who, place, ids = [], [], []
        while len(at):
            open_ = at > begin[number]
            at, number = at[open_], number[open_]
            s, p = back[at], last[at]
            good = p >= 0
            who.append(number[good])
            place.append(s[good])
            ids.append(self.ids[p[good]])
            for k in range(4):  # the bytes of characters without a piece
                more = ~good & (s + k < at)
                who.append(number[more])
                place.append(s[more] + k)
                ids.append(self.byte_ids[octets[s[more] + k]])
            at = s
        who_, place_, ids_ = (np.concatenate(x) for x in (who, place, ids))
        order = np.argsort(place_)
        count = np.bincount(who_, minlength=len(words))
        first = len(self.flat) + np.cumsum(count) - count
        self.known.update(zip(words, range(len(self.first), len(self.first) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids_[order].astype(np.int32)])
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts, one after the other, and the number of each text's ids."""
        flats, counts, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        while at < len(texts):
            new: dict[bytes, None] = {}
            known, split, size, to = self.known, [], 0, at
            while to < len(texts) and (size < BATCH_BYTES or to == at):
                words = WORDS.findall(SPACE + texts[to].replace(b" ", SPACE)) if texts[to] else []
                for w in set(words):
                    if w not in known and w not in new:
                        new[w] = None
                        size += len(w) + 1
                split.append(words)
                to += 1
            if new:
                self._learn(list(new))
            numbers = np.fromiter((known[w] for words in split for w in words), np.int64, sum(map(len, split)))
            count = self.count[numbers]
            total = np.cumsum(count)
            flats.append(self.flat[np.repeat(self.first[numbers] - total + count, count) + np.arange(total[-1] if len(total) else 0)])
            ends = np.r_[0, total][np.cumsum([len(words) for words in split])]
            counts.append(np.diff(np.r_[0, ends]))
            if len(known) > ROOM:
                self._forget()
            at = to
        return np.concatenate(flats), np.concatenate(counts)


#: A Python worker serves many tasks; what it learnt about a vocabulary in one serves the next.
_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder for a vocabulary."""
    if vocabulary.path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.path] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.path]


class Decoder:
    """Texts of ids: the surfaces of pieces, laid end to end."""

    def __init__(self, surface: list[bytes]):
        self.size = np.fromiter(map(len, surface), np.int64, len(surface))
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(surface), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        """UTF-8 of one text, without the space that encoding put first."""
        size = self.size[ids]
        end = np.cumsum(size)
        text = self.flat[np.repeat(self.first[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        return text[1:] if text[:1] == b" " else text


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with the ids of `text_col` (added or replaced); null and empty texts have no ids.

    Repeated rows and null ids are encoded each for itself; an empty table stays empty. All other
    columns stay, whatever their names. The space mark U+2581 in a text is a space. The vocabulary travels with the task's code; its
    size is that of the file and doesn't depend on the data.
    """
    vocabulary, x = Vocabulary.load(model), f"x_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary)
        for b in batches:
            rest, texts = b.drop_columns([x]), b.column(x)
            for at in range(0, len(texts), 1000):  # ids take more room than the text
                ids, count = one.encode([t.as_py() for t in texts[at : at + 1000]])
                col = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids))
                yield pa.record_batch([*(c[at : at + 1000] for c in rest.columns), col], [*rest.schema.names, ids_col])

    rest = docs.drop(ids_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{ids_col}` array<int>"])
    return rest.withColumn(x, raw(text_col)).mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """The rows with the text of their ids; bytes that aren't UTF-8 become U+FFFD."""
    surface = Vocabulary.load(model).surface

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Decoder(surface)
        for b in batches:
            col = b.column(ids_col)
            texts = [one(x.values.to_numpy()).decode(errors="replace") if x.is_valid else "" for x in col]
            names = b.schema.names
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], [*names, text_col])

    rows = rows.drop(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{text_col}` string"])
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: number and hash of the ids of every document, and whether decoding gives the text back."""
    from quillgrain.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select(
        "doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
