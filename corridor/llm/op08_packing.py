"""Operator 8: sum-of-squares online packing into windows of a fixed length.

Every task packs its own documents online.  ``level[f]`` is the number of open
windows filled to ``f``; a piece of size ``s`` goes to the level that leaves the
smallest sum of squared counts.  A document longer than a window fills whole
windows first, and only its rest is placed.

At most ``OPEN`` windows are open at a time, so a task holds ``OPEN`` x window
ids whatever its documents are: where a piece fits into none of them and no
further one may be opened, it is cut so that its first part fills a level's
window, by the same sum over both parts.  At the end of the task the few windows
left open are cut anew, end to end, into full windows and one remainder, whose
binary digits become windows with a power of two tokens, which need no padding.

Defined results: a null or empty text has one token (the end mark).  Extra
columns are ignored; a null or repeated doc_id is packed as any other.  An
empty table gives no pieces.  Texts are packed whole, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._spark import lean, table

WINDOW = 1024
END_ID = 0
OPEN = 12  # windows that a task has open at most
CACHE_WORDS = 300_000  # distinct parts of texts in a generation; a worker keeps the last two
CACHE_CHARS = 40  # longer parts are not kept
_END = np.array([END_ID], np.uint32).tobytes()

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: fixed values: the pre-tokeniser's pattern, on printable ASCII
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+")
_PRINTABLE = re.compile(r"[!-~]+")
_SPECIAL = "<|"  # what may be a special token is left to the tokenizer
_LONE_BREAK = re.compile(r"(?<=\S)\n(?=\S)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for every byte: printable Latin-1 stands for itself, the rest follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Irregular(Exception):
    """A part with white space at an end: it may not be cut there."""


class _Parts(dict):
    """Part of a text -> its ids as bytes.  ``blank`` stands before each part, or nothing does.

    A part of printable ASCII is cut as the pre-tokeniser cuts it, and its pieces go
    straight to the BPE model, as does a part of letters alone; a part closed by a
    comma or full stop, and one holding lone line breaks between other characters,
    are put together from the ids of their pieces, as the pre-tokeniser cuts there
    too.  Everything else takes the whole tokenizer.
    """

    def __init__(self, owner: WordTokenizer, blank: str, old: dict | None = None):
        self.owner, self.blank, self.old = owner, blank, old or {}

    def __missing__(self, key: str) -> bytes:
        owner, last = self.owner, key[-1:]
        ids = self.old.get(key)
        if ids is None:
            if not owner.careful and (not key or key[0].isspace() or last.isspace()):
                raise Irregular
            ids = self.made(key, last)
        if len(key) <= CACHE_CHARS:
            owner.held += 1
            self[key] = ids
        return ids

    def made(self, key: str, last: str) -> bytes:
        owner = self.owner
        if key.isalpha():
            return owner.piece(self.blank + key)
        if last in (".", ",") and key[:-1].isalpha():
            return self[key[:-1]] + owner.head[last]
        if _PRINTABLE.fullmatch(key) and _SPECIAL not in key:
            first, *rest = _PIECES.findall(self.blank + key)
            return b"".join([owner.piece(first), *map(owner.piece, rest)])
        if "\n" in key and len(lines := _LONE_BREAK.split(key)) > 1:
            return owner.line.join([self[lines[0]], *map(owner.head.__getitem__, lines[1:])])
        return array("I", owner.tokenizer.encode(self.blank + key, add_special_tokens=False).ids).tobytes()


class WordTokenizer:
    """ids of whole texts, each distinct part encoded once and kept.

    The pre-tokeniser always cuts between a character that is not white space
    and a blank followed by another such character, so the parts between these
    places have the same ids apart as together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.careful = _byte_letters(), False
        self.held, self.head, self.rest = 0, _Parts(self, ""), _Parts(self, " ")
        self.line = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, np.uint32).tobytes()

    def turn(self) -> None:
        """A new generation: what it asks for again comes from the one before, the rest goes."""
        self.held = 0
        for name in ("head", "rest"):
            before = getattr(self, name)
            before.old = {}
            setattr(self, name, _Parts(self, before.blank, before))

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token."""
        letters = text.replace(" ", "\u0120") if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers, with the end mark after them."""
        if self.held > CACHE_WORDS:
            self.turn()
        if not text:
            return _END
        first, *rest = text.split(" ")
        try:  # single blanks between parts, as nearly everywhere
            return b"".join([self.head[first] if first else b"", *map(self.rest.__getitem__, rest), _END])
        except Irregular:
            pass
        first, *rest = _CUT.split(text)
        self.careful = True
        try:
            return b"".join([self.head[first] if first else b"", *[self.rest[x[1:]] for x in rest], _END])
        finally:
            self.careful = False


_kept: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: later tasks find the words of earlier ones."""
    if path not in _kept:
        _kept[path] = WordTokenizer(path)
    return _kept[path]


class SumOfSquares:
    """The level array and, for each level, the open windows filled so far."""

    def __init__(self, window: int, most: int = OPEN):
        self.window, self.most = window, most
        self.level = [0] * (window + 1)
        self.open: dict[int, list[int]] = {}  # fill -> windows
        self.count = self.held = 0

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def change(self, fill: int, size: int) -> int:
        """How the sum of squares changes when ``size`` goes to a window filled to ``fill``; 0 opens one.  Full windows do not count."""
        n, to = self.level, fill + size
        return (1 - 2 * n[fill] if fill else 0) + (2 * n[to] + 1 if to < self.window else 0)

    def best(self, size: int, room: int) -> tuple[int, int] | None:
        """(change, fill) of the best level for a whole piece, ties to the fullest; a new window only with ``room``."""
        levels = [f for f in self.open if f + size <= self.window]
        if room > 0 or size == self.window:
            levels.append(0)
        return min(((self.change(f, size), -f) for f in levels), default=None)

    def move(self, fill: int, size: int) -> int:
        if fill:
            own = self.open[fill]
            seq = own.pop()
            if not own:
                del self.open[fill]
            self.level[fill] -= 1
            self.held -= 1
        else:
            seq = self.new()
        to = fill + size
        if to < self.window:
            self.open.setdefault(to, []).append(seq)
            self.level[to] += 1
            self.held += 1
        return seq

    def place(self, size: int) -> list[tuple[int, int, int]]:
        """(window, offset, length) of the piece, or of its parts where only a cut keeps the windows few."""
        out = []
        while size:
            found = self.best(size, self.most - self.held)
            if found is not None:
                out.append((self.move(-found[1], size), -found[1], size))
                break
            # it fits into none: fill one and see where the rest goes best
            cuts = []
            for f in list(self.open):
                first = self.window - f
                change, seq = self.change(f, first), self.move(f, first)
                rest = self.best(size - first, self.most - self.held)
                cuts.append((change + (rest[0] if rest else 0), -f))
                self.undo(f, seq)
            fill = -min(cuts)[1]
            out.append((self.move(fill, self.window - fill), fill, self.window - fill))
            size -= self.window - fill
        return out

    def undo(self, fill: int, seq: int) -> None:
        """A filled window opens again."""
        self.open.setdefault(fill, []).append(seq)
        self.level[fill] += 1
        self.held += 1


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, text_col: str, id_col: str) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    tok, bins = tokenizer(path), SumOfSquares(window)
    held: dict[int, list[tuple]] = {}  # pieces of open windows with their ids
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 7
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=SCHEMA.names)

    for batch in batches:
        docs, texts = batch.column(id_col).to_pylist(), batch.column(text_col)
        for lo in range(0, len(docs), 256):
            for doc, text in zip(docs[lo : lo + 256], texts.slice(lo, 256).to_pylist()):
                own = memoryview(tok.ids(text))
                total, at = len(own) // 4, 0
                while total - at >= window:
                    rows.append((doc, at, window, zlib.crc32(own[4 * at : 4 * (at + window)]), total, base + bins.new(), 0))
                    at += window
                for seq, offset, size in bins.place(total - at):
                    held.setdefault(seq, []).append((doc, at, bytes(own[4 * at : 4 * (at + size)]), total, offset))
                    at += size
                    if offset + size == window:  # full: its pieces are final
                        rows += [(d, a, len(ids) // 4, zlib.crc32(ids), n, base + seq, o) for d, a, ids, n, o in held.pop(seq)]
            if len(rows) >= 20_000:
                yield flush()
    # what is open at the end of the task is laid end to end and cut anew
    left = [p for seq in sorted(held) for p in held[seq]]
    remaining = sum(len(p[2]) // 4 for p in left)
    seq, offset, room = -1, 0, 0
    for doc, start, ids, total, _ in left:
        size, at = len(ids) // 4, 0
        while at < size:
            if room == offset:
                seq, offset = bins.new(), 0
                room = min(window, 1 << (remaining.bit_length() - 1)) if remaining < window else window
            take = min(size - at, room - offset)
            rows.append((doc, start + at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), total, base + seq, offset))
            offset, at, remaining = offset + take, at + take, remaining - take
    yield flush()


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", keep_words: bool = True) -> DataFrame:
    """One row per piece; ``sequence_id`` is unique over all tasks.

    Without ``keep_words`` a worker forgets the words of a task at its end: slower,
    but nothing of it stays in memory for the stages that follow.
    """

    def run(batches):
        yield from _pack(batches, tokenizer_path, window, "text", "doc_id")
        if not keep_words:
            _kept.clear()

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(lean(run), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
