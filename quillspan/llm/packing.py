"""Sequence packing along a space-filling curve.

Each document's hashed vector (signed counts of its byte 4-grams in DIMS cells, of unit length) is
projected to AXES dimensions and gets a Hilbert key. Documents are range-sorted by key and packed
in that order: each partition is one stretch of the curve, its documents follow one another without
a gap, and the stream is cut every ``length`` ids. So neighbours on the curve share sequences. What is
left at the end of a stretch, less than a sequence, goes on with its ids to a second pass, which packs
the ends of STRETCHES neighbouring stretches in the same way: one sequence in so many stretches is
not full, however the rows are partitioned.

The key is computed from the text alone, so only texts are shuffled, once; ids are made after the
shuffle and never leave their task but in the pieces' digests. Ties of the key are ordered by doc_id
and checksum, which also lets the range partitioner split a key that many documents share.

Cases: a null text is an empty one, whose ids are just the end id; repeated rows are packed each;
an empty table gives no piece; columns other than doc_id and text are ignored, whatever their names.
Very long texts are hashed and split into words in blocks; a task holds the ids of one such text.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .store import written

LENGTH = 2048
END = 1
DIMS, AXES, BITS, SEED = 64, 3, 16, 20240607
_BLOCK = 1 << 18
#: Words whose ids a worker remembers; it starts anew beyond. Those of plain texts are kept in arrays,
#: others with about 250 bytes each.
KNOWN, REMEMBERED = 1_000_000, 300_000
STRETCHES = 1024


def hashed_vector(data: bytes) -> np.ndarray:
    """Signed counts of the 4-grams, of unit length; zero for fewer than four bytes."""
    v = np.zeros(DIMS)
    for at in range(0, max(len(data) - 3, 0), _BLOCK):
        block = data[at : at + _BLOCK + 3]
        # All 4-grams by four views of whole words, each begun one byte later.
        h = np.concatenate([np.frombuffer(block, "<u4", (len(block) - k) // 4, k) for k in range(4)]) * np.uint32(2654435761)
        c = np.bincount(h >> np.uint32(25), minlength=2 * DIMS)
        v += c[:DIMS] - c[DIMS:]
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(DIMS, AXES)) / np.sqrt(AXES)


def hilbert_key(points: np.ndarray) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (n, AXES) below 2**BITS.

    Each level picks the child cell by Gray code; the state is the axis order and mirroring of
    the cell, kept for each point as a rotation and a flip mask."""
    n, d = points.shape
    full = (1 << d) - 1
    entry, turn, key = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rotl = lambda x, r: ((x << r) | (x >> (d - r))) & full
    rotr = lambda x, r: ((x >> r) | (x << (d - r))) & full
    ones = np.array([(~i & (i + 1)).bit_length() - 1 for i in range(1 << d)])  # trailing set bits
    gray = lambda i: i ^ (i >> 1)
    enter = np.array([0] + [gray(2 * ((i - 1) // 2)) for i in range(1, 1 << d)])
    step = np.array([0] + [int(ones[i - 1] if i % 2 == 0 else ones[i]) % d for i in range(1, 1 << d)])
    for level in range(BITS - 1, -1, -1):
        cell = np.zeros(n, np.int64)
        for a in range(d):
            cell |= ((points[:, a].astype(np.int64) >> level) & 1) << a
        g = rotr(cell ^ entry, (turn + 1) % d)
        w = g.copy()
        for s in range(1, d):
            w ^= g >> s
        key = (key << d) | w
        entry ^= rotl(enter[w], (turn + 1) % d)
        turn = (turn + step[w] + 1) % d
    return key


def curve_keys(texts) -> np.ndarray:
    if not len(texts):
        return np.zeros(0, np.int64)
    v = np.stack([hashed_vector((t or "").encode()) for t in texts]) @ _projection()
    return hilbert_key(np.clip((v + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


_DIGIT = 2
#: Of each Latin-1 character: 0 for a blank, 1 for a letter, _DIGIT, or 3 for another sign.
_KIND = np.array([1 if chr(c).isalpha() else _DIGIT if chr(c) in "0123456789" else 3 if c > 32 else 0 for c in range(256)], np.int8)
_SIGN = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, remembered."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, _BLOCK), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … of size numbers, for each pair in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Known:
    """The ids of words, told by a hash of their bytes that is then checked byte by byte: arrays of fixed
    size, which take memory only as they fill, with about 50 bytes a word."""

    def __init__(self):
        self.n, self.table = 0, np.zeros(1 << (4 * KNOWN - 1).bit_length(), np.int32)  # 0: free; else the word's number and 1
        self.hashed, self.raw, self.ids = np.empty(KNOWN, np.uint64), np.empty(16 * KNOWN, np.uint8), np.empty(4 * KNOWN, "<u4")
        # Where each word's bytes and ids begin, and the last one's end.
        self.raw_at, self.ids_at = np.zeros(KNOWN + 1, np.int32), np.zeros(KNOWN + 1, np.int32)

    def _slots(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def find(self, hashed: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not held."""
        out, slot, todo = np.full(len(hashed), -1), self._slots(hashed), np.arange(len(hashed))
        while len(todo):
            word = self.table[slot[todo]].astype(np.int64) - 1
            todo, word = todo[word >= 0], word[word >= 0]
            same = self.hashed[word] == hashed[todo]
            out[todo[same]] = word[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
        here = np.flatnonzero(out >= 0)
        word = out[here]
        like = self.raw_at[word + 1] - self.raw_at[word] == size[here]
        out[here[~like]] = -1
        here, word = here[like], word[like]
        n = size[here]
        differ = self.raw[_spread(self.raw_at[word].astype(np.int64), n)] != raw[_spread(start[here], n)]
        out[np.repeat(here, n)[differ]] = -1
        return out

    def add(self, hashed: np.ndarray, raw: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> bool:
        """Takes in words of distinct hashes that find() has not found, their bytes and ids one after another; False if there is no room."""
        new, at, ids_at = len(hashed), int(self.raw_at[self.n]), int(self.ids_at[self.n])
        if self.n + new > KNOWN or at + len(raw) > len(self.raw) or ids_at + len(ids) > len(self.ids):
            return False
        own = np.arange(self.n, self.n + new)
        self.hashed[own], self.raw[at : at + len(raw)], self.ids[ids_at : ids_at + len(ids)] = hashed, raw, ids
        self.raw_at[own + 1], self.ids_at[own + 1] = at + np.cumsum(size), ids_at + np.cumsum(count)
        slot, todo = self._slots(hashed), np.arange(new)
        while len(todo):
            free = todo[self.table[slot[todo]] == 0]
            self.table[slot[free]] = own[free] + 1
            todo = todo[self.table[slot[todo]] != own[todo] + 1]
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
        self.n += new
        return True


class Ids:
    """Ids of texts, by way of their words: the tokenizer splits at white space and between
    letters and other signs, so the ids of a text are those of its pieces, which recur.
    Texts of Latin-1 letters and ASCII signs are split here into what the tokenizer splits them
    into; any other text is cut only at blanks and line ends, which no token spans."""

    _plain = re.compile(r"[\n\r\t\x20-\x26\x28-\x7EÀ-ÖØ-öø-ÿ]*")
    _long = re.compile(r"(?s).{1,1048576}[^ \n\r\t]*")
    _blanks = re.compile(r"[^ \n]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.known, self.plain = Tokenizer.from_file(path), {}, Known()
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of plain words, many in one call: each ends with the one id that marks a word's end."""
        out, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                apart = [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
                ids, ends = np.concatenate(apart), np.cumsum([len(x) for x in apart])
            out.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(out), np.concatenate(counts)

    def _plain_words(self, hashed: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of the words at start, told apart by their hashes."""
        held = self.plain.find(hashed, raw, start, size)
        old, new = np.flatnonzero(held >= 0), np.flatnonzero(held < 0)
        data = raw[_spread(start[new], size[new])]
        text, cut = data.tobytes().decode("latin-1"), np.cumsum(size[new])
        fresh, fresh_count = self._learned([text[x:y] for x, y in zip((cut - size[new]).tolist(), cut.tolist())])
        held, count = held[old], np.empty(len(start), np.int64)
        count[old], count[new] = self.plain.ids_at[held + 1] - self.plain.ids_at[held], fresh_count
        begin, ids = np.cumsum(count) - count, np.empty(count.sum(), "<u4")
        ids[_spread(begin[old], count[old])] = self.plain.ids[_spread(self.plain.ids_at[held].astype(np.int64), count[old])]
        ids[_spread(begin[new], fresh_count)] = fresh
        if not self.plain.add(hashed[new], data, size[new], fresh, fresh_count):
            self.plain = Known()  # starts anew with these, if there is room for them at all
            self.plain.add(hashed[new], data, size[new], fresh, fresh_count)
        return ids, count

    def _learn_apart(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _recall(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        self._learn_apart([w for w in words if w not in self.known])
        return [self.known[w] for w in words]

    def _plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts in lower case: words are found by their bytes' kinds, made distinct by a hash
        that is then checked byte by byte, and only distinct words are looked up."""
        raw = np.frombuffer("\n".join(texts).encode("latin-1") + b"\n", np.uint8)
        kind = _KIND[raw]
        new = kind > 0
        new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start = np.flatnonzero(new)
        end = np.flatnonzero((kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[:-1] == _DIGIT))) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_SIGN[raw] * _powers(_ODD, len(raw)), out=sums[1:])
        hashed = (sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start]
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        size = end - start
        if (size != size[first][which]).any() or (raw[_spread(start, size)] != raw[_spread(start[first][which], size)]).any():
            # Two words share a hash: learn every word, and remember none.
            which, data = np.arange(len(start)), raw.tobytes().decode("latin-1")
            found, count = self._learned([data[x:y] for x, y in zip(start.tolist(), end.tolist())])
        else:
            found, count = self._plain_words(hashed[first], raw, start[first], size[first])
        ids = found[_spread((np.cumsum(count) - count)[which], count[which])]
        text_end = np.cumsum([len(t) + 1 for t in texts])
        cut = np.concatenate([[0], np.cumsum(count[which])])[np.searchsorted(start, text_end)]
        return np.split(ids, cut[:-1])

    def _stretch(self, text: str) -> list[np.ndarray]:
        """Of one text, in stretches cut at white space, which no token spans."""
        if not self._plain.fullmatch(text) or "<|" in text:
            words = self._blanks.findall(text)
            here = list(dict.fromkeys(words))
            ids = dict(zip(here, self._recall(here)))
            return [np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u4")]
        return [x for part in self._long.findall(text.lower()) for x in self._plain_ids([part])]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # Lower case here merges words; the tokenizer does the same to each letter of a plain text.
        out, group, size = [None] * len(texts), [], 0
        for i, t in enumerate(texts):
            if len(t) > _BLOCK or not self._plain.fullmatch(t) or "<|" in t:
                out[i] = np.concatenate([np.zeros(0, "<u4"), *self._stretch(t)])
                continue
            group, size = [*group, i], size + len(t)
            if size > _BLOCK:
                self._fill(out, group, texts)
                group, size = [], 0
        self._fill(out, group, texts)
        return [np.append(x, np.uint32(END)) for x in out]

    def _fill(self, out: list, group: list[int], texts: list[str]) -> None:
        if group:
            for i, ids in zip(group, self._plain_ids([texts[i].lower() for i in group])):
                out[i] = ids


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One for each worker process."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Sequences:
    """Cuts what it is given into sequences; pieces of one that is not full yet are held back with their ids."""

    def __init__(self, first: int, length: int):
        self.now, self.length, self.at, self.done, self.open = first, length, 0, [], []

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            part = ids[: self.length - self.at]
            self.open.append((doc, start, len(part), zlib.crc32(part.tobytes()), total, self.now, self.at, part.tobytes()))
            start, ids, self.at = start + len(part), ids[len(part) :], self.at + len(part)
            if self.at == self.length:
                self.close()

    def close(self) -> None:
        self.done += [(*row[:-1], None) for row in self.open]
        self.now, self.at, self.open = self.now + (self.at > 0), 0, []

    def rows(self, rest: bool = False) -> pd.DataFrame:
        """What is done since the last call, and the rest with its ids."""
        out = pd.DataFrame(self.done + (self.open if rest else []), columns=[*COLUMNS, "ids"])
        self.done = []
        return out.astype({"doc_id": "Int64"})


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece, see SCHEMA. sequence_id: the stretch's number in the high bits."""

    @F.pandas_udf("long")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series(curve_keys(texts.tolist()))

    def packed(batches):
        from pyspark import TaskContext

        out = Sequences(TaskContext.get().partitionId() << 40, length)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                for doc, ids in zip(part["doc_id"], ids_of(tokenizer)(part["text"].tolist())):
                    out.add(doc, 0, ids, len(ids))
                yield out.rows()
        yield out.rows(rest=True)

    def ends(batches):
        """Rows of whole groups of stretches, sorted by group, sequence and offset."""
        out, group = None, None
        for b in batches:
            for g, doc, start, total, ids in zip(b["stretches"], b["doc_id"], b["start"], b["doc_tokens"], b["ids"]):
                if out is None or g != group:
                    if out:
                        out.close()
                        yield out.rows()[COLUMNS]
                    out, group = Sequences(1 << 62 | int(g) << 31, length), g
                out.add(doc, start, np.frombuffer(ids, "<u4"), total)
            if out:
                yield out.rows()[COLUMNS]
        if out:
            out.close()
            yield out.rows()[COLUMNS]

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(key("text").alias("key"), "doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), "text")
    order = ["key", "doc_id", "crc"]
    pieces = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInPandas(packed, f"{SCHEMA}, ids binary"))
    left = pieces.filter("ids is not null").withColumn("stretches", F.shiftright("sequence_id", 40) / STRETCHES).withColumn("stretches", F.floor("stretches"))
    left = left.repartition("stretches").sortWithinPartitions("stretches", "sequence_id", "offset").mapInPandas(ends, SCHEMA)
    return pieces.filter("ids is null").select(*COLUMNS).unionByName(left)
