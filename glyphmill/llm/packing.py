"""Vector bin packing of examples into sequences, by the dot-product heuristic.

An example is a run of token ids, all or some of which bear loss.  A sequence has room for so
many tokens, segments and loss-bearing tokens at once.  Each task fills one sequence at a
time from a pool of pending pieces: of those that fit in all dimensions it takes the piece
whose demand vector has the largest dot product with the sequence's remaining room.  When
none fits whole and cutting is allowed, the best piece is cut to fill the gap; a task's last
sequence is cut into powers of two, which need no padding.  Pieces carry only their place
and size, so the pool is small; the job has no shuffle.

Edge cases: a null or empty text still has its end id; a text longer than a sequence is cut;
repeated rows are packed as often as they come; a null ``doc_id`` is kept; an empty table
gives no sequences; other columns of the input are ignored.  ``sequence_id`` is
(partition, number in it), so reruns over the same table agree.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textbytes as tb

SEQUENCE = 4096
MAX_SEGMENTS = 512
END_ID = 2
#: Pending pieces that the heuristic chooses from.
POOL = 2048
#: Pieces of text whose ids a task remembers (twice as many at most), and their longest.
CACHED = 200_000
LONGEST = 64
#: Pieces that the tokenizer gets in one line.
LINE = 500
#: Bytes of texts whose pieces are looked up together.
GROUP = 4 << 20

PIECE = ("doc_id long, start long, length long, loss long, doc_tokens long, ids_crc32 long, "
         "sequence_id long, offset long")


#: Latin-1 bytes of the characters that the vocabulary's normaliser only lower-cases, one by one.
_PLAIN = bytes(range(128)) + "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()).encode("latin-1")
#: The vocabulary's own pieces of such text in lower case (fixed by its pre-tokenizer).
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\x09-\\x0D\\x20a-z0-9ß-öø-ÿ]+")
_SPACES = re.compile("[\\x09-\\x0D\\x20]+")


def plain(text: str) -> bool:
    """Has the text only ASCII and the letters of Latin-1?"""
    if text.isascii():
        return True
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


def gather(flat: np.ndarray, offs: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs ``which`` of ``flat`` one behind the other; run i lies between offsets i and i + 1."""
    firsts = offs[which]
    sizes = offs[which + 1] - firsts
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - ends + sizes, sizes)]


class PieceTokenizer:
    """Ids of whole texts through a cache of ids by piece.

    The vocabulary's merges never cross its pre-tokenizer's pieces (letters, single digits,
    runs of other signs), and white space is dropped, so a text's ids are those of its pieces
    in turn.  A word with a character beyond Latin-1's letters stays whole and is left to the
    tokenizer, and so is a text with a special token's characters.  The cache has two generations
    of at most CACHED pieces of at most LONGEST characters; pieces still in use move to the
    younger one, longer pieces are forgotten after their texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[bytes], most: int = GROUP) -> Iterator[np.ndarray]:
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= most:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if plain(text):
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for word in _SPACES.split(text):
            if plain(word):
                out += _PIECES.findall(word.lower())
            else:
                out.append(word)
        return out

    def _codes(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of each piece; plain pieces go to the tokenizer in lines of several."""
        several = [p for p in pieces if p.isascii() or plain(p)]
        other = [p for p in pieces if not (p.isascii() or plain(p))] if len(several) < len(pieces) else []
        pieces[:] = several + other
        for lo in range(0, len(several), LINE):
            some = several[lo: lo + LINE]
            line = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            of, ids = np.array(line.word_ids, np.int64), np.array(line.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(of, np.arange(len(some) + 1))).tolist()
            if len(of) and of[-1] != len(some) - 1:
                raise ValueError("the vocabulary cuts words otherwise than its pieces")
            yield from map(ids.__getitem__, map(slice, cuts[:-1], cuts[1:]))
        for lo in range(0, len(other), 10_000):
            some = other[lo: lo + 10_000]
            codes = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            yield from (array("I", c.ids).tobytes() for c in codes)

    def _group(self, group: list[bytes]) -> Iterator[np.ndarray]:
        # a group's pieces are numbered as they come, so that they are looked up once and its ids gathered at once
        number: defaultdict[str, int] = defaultdict(count().__next__)
        which: list[np.ndarray | None] = []
        for t in group:
            text = t.decode()
            held = self.pieces(text) if "<|" not in text else None
            which.append(None if held is None else np.fromiter(map(number.__getitem__, held), np.int32, len(held)))
        if len(self.cache) > CACHED:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        new = []
        for w in filterfalse(cache.__contains__, number):
            known = older.get(w)
            if known is None:
                new.append(w)
            else:
                cache[w] = known
        found = list(self._codes(new))  # which puts ``new`` in their order
        cache.update(zip(new, found, strict=True))
        codes = list(map(cache.__getitem__, number))
        ends = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes))) // 4
        flat, offs = np.frombuffer(b"".join(codes), "<u4"), np.concatenate([[0], ends])
        for t, at in zip(group, which, strict=True):
            yield self._whole(t.decode()) if at is None else gather(flat, offs, at)
        for w in new:
            if len(w) > LONGEST:
                del cache[w]


_coders: dict[str, PieceTokenizer] = {}


def coder(path: str) -> PieceTokenizer:
    """One tokenizer and cache for all tasks of a Python worker."""
    if path not in _coders:
        _coders[path] = PieceTokenizer(path)
    return _coders[path]


class Packer:
    """Fills sequences from a pool of pieces [key, start, tokens, loss] with three limits."""

    def __init__(self, limits=(SEQUENCE, MAX_SEGMENTS, SEQUENCE), cut: bool = True, pool: int = POOL):
        self.limits = np.array(limits, np.int64)
        self.cut, self.most = cut, pool
        self.keys = np.zeros(0, np.int64)
        self.demand = np.zeros((0, 3), np.int64)  # tokens, segments, loss-bearing tokens
        self.start = np.zeros(0, np.int64)
        self.done: list[list[tuple[int, int, int, int]]] = []  # sequences of (key, start, tokens, loss)

    def add(self, keys, starts, tokens, loss) -> None:
        self.keys = np.concatenate([self.keys, keys])
        self.start = np.concatenate([self.start, starts])
        self.demand = np.concatenate([self.demand, np.stack([tokens, np.ones_like(tokens), loss], axis=1)])
        while len(self.keys) > self.most:
            self._sequence()

    def finish(self) -> None:
        while len(self.keys):
            self._sequence()

    def _sequence(self) -> None:
        alive = np.ones(len(self.keys), bool)
        scaled = self.demand / self.limits
        tokens, bearing = self.demand[:, 0], self.demand[:, 2]  # each piece is one segment
        room, got = self.limits.copy(), []
        while room[0] > 0 and room[1] > 0 and alive.any():
            fits = alive & (tokens <= room[0]) & (bearing <= room[2])
            if fits.any():
                best = int(np.argmax(np.where(fits, scaled @ (room / self.limits), -1.0)))
                alive[best] = False
                got.append((int(self.keys[best]), int(self.start[best]), int(self.demand[best, 0]),
                            int(self.demand[best, 2])))
                room -= self.demand[best]
                continue
            # loss-bearing ids lie evenly enough that a cut takes them from the end on
            able = alive & (self.demand[:, 0] > room[0]) & (self.demand[:, 2] <= self.demand[:, 0])
            if not self.cut or not able.any() or room[2] <= 0:
                break
            best = int(np.argmax(np.where(able, scaled @ (room / self.limits), -1.0)))
            take = int(min(room[0], room[2]))
            loss = int(min(take, self.demand[best, 2]))
            got.append((int(self.keys[best]), int(self.start[best]), take, loss))
            self.start[best] += take
            self.demand[best, 0] -= take
            self.demand[best, 2] -= loss
            room -= np.array([take, 1, loss])
        if not got:
            raise ValueError("a piece exceeds an empty sequence's room")
        self.done.append(got)
        self.keys, self.start, self.demand = self.keys[alive], self.start[alive], self.demand[alive]

    def powers(self) -> None:
        """Cut a short last sequence at powers of two, which need no padding."""
        if not self.done or not self.cut:
            return
        last = self.done.pop()
        total = sum(p[2] for p in last)
        room = 1 << (total.bit_length() - 1) if total else 0
        now: list[tuple[int, int, int, int]] = []
        for key, start, tokens, loss in last:
            while tokens:
                take = min(tokens, room)
                bear = min(take, loss)
                now.append((key, start, take, bear))
                start, tokens, loss, room, total = start + take, tokens - take, loss - bear, room - take, total - take
                if not room:
                    self.done.append(now)
                    now = []
                    room = 1 << (total.bit_length() - 1) if total else 0


def pack_batches(batches: Iterator[pa.RecordBatch], tokenizer_path: str, limits: tuple, cut: bool) -> Iterator[pa.RecordBatch]:
    """doc ids and texts in, packed pieces out; a text's ids are dropped once its pieces are cut."""
    base = TaskContext.get().partitionId() << 32
    words, packer = coder(tokenizer_path), Packer(limits, cut)
    whole = int(limits[0])
    docs: dict[int, tuple[int, int, np.ndarray]] = {}  # key: doc_id, pieces' ids still pending
    pending: dict[int, int] = {}
    key = number = 0

    def flush():
        nonlocal number
        out: list[list] = [[] for _ in range(8)]
        for seq in packer.done:
            offset = 0
            for k, start, tokens, loss in seq:
                doc_id, n_ids, tail, at = docs[k]
                crc = zlib.crc32(tail[start - at: start - at + tokens].tobytes())
                for col, v in zip(out, (doc_id, start, tokens, loss, n_ids, crc, base + number, offset), strict=True):
                    col.append(v)
                offset += tokens
                pending[k] -= tokens
                if not pending[k]:
                    del docs[k], pending[k]
            number += 1
        packer.done.clear()
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [tb.id_array(np.array(out[0], np.int64)), *[pa.array(c, pa.int64()) for c in out[1:]]],
                names=[c.split()[0] for c in PIECE.split(", ")])

    for batch in batches:
        body, offs = tb.column(batch.column("text"))
        doc_id = tb.ids(batch.column("doc_id"))
        raw = body.tobytes()
        at = offs.tolist()
        texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        new: list[tuple[int, int, int, int]] = []
        for one, codes in zip(doc_id.tolist(), words.encode(texts), strict=True):
            codes = np.append(codes, np.uint32(END_ID)).astype("<u4")
            n, start = len(codes), 0
            if cut:  # full pieces are sequences of their own; only the rest is packed
                while n - start >= whole and whole <= limits[2]:
                    docs[key], pending[key] = (one, n, codes, 0), pending.get(key, 0) + whole
                    packer.done.append([(key, start, whole, whole)])
                    start += whole
            elif n > whole:
                raise ValueError("an example is longer than a sequence and may not be cut")
            if start < n:
                docs[key], pending[key] = (one, n, codes, 0), pending.get(key, 0) + n - start
                new.append((key, start, n - start, n - start))
            if len(new) >= 256:
                packer.add(*np.array(new, np.int64).T)
                new = []
            key += 1
            if len(packer.done) >= 1024:
                yield from flush()
                for k, (i, m, held, from_) in list(docs.items()):  # keep only the ids still to be placed
                    if from_ == 0 and m > pending[k] and k in pending:
                        docs[k] = (i, m, held[m - pending[k]:].copy(), m - pending[k])
        if new:
            packer.add(*np.array(new, np.int64).T)
        yield from flush()
    packer.finish()
    packer.powers()
    yield from flush()


def pack(docs: DataFrame, tokenizer_path: str, limits: tuple = (SEQUENCE, MAX_SEGMENTS, SEQUENCE),
         cut: bool = True) -> DataFrame:
    """Pieces of every text's ids (with the end id) and their places in sequences."""
    limits = tuple(int(x) for x in limits)
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: pack_batches(batches, tokenizer_path, limits, cut), PIECE)


def pieces(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.col("offset"))
