"""Packing token sequences by the sum-of-squares rule, online.

A document's ids end with an end id. What exceeds the window is cut off in full windows. The remainder, of s tokens,
goes to an open window of fill level l, or to a new one (l = 0), so that the sum of squared counts of partially filled
windows, over all levels, becomes least; the counts stand in one array by level. Ties go to the fullest window.

Each partition packs what it reads, in its order, with memory for its open windows' piece lists only (no texts). At its
end the windows still open are joined: pieces of the emptiest fill up the fullest, cut where need be. The last one is cut
into powers of two, which need no padding. So no sequence is padded, and partitions don't wait for each other; a lost
executor's partition is packed again, alone. sequence_id is the partition's number times 2^33 plus a running number.

Ids are found per white-space separated piece of text and remembered in a bounded table: the tokenizer's normaliser and
pattern never look across white space. A text that holds the string of one of the tokenizer's added tokens goes to it whole.

Nulls and edges: a null or empty text is the end id alone, one token. Repeated rows are packed each for itself. An empty
table gives no pieces. Extra columns are not read. A text of any length is tokenised whole.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
END = 1
#: Words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 600_000
#: Longest word that is remembered, in characters.
WORD_CHARS = 64
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which NFC changes nothing, lower case is one character, and letters and digits are as in SPLIT.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]+")
PLAIN_TEXT = re.compile("[\x09-\x0d\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^\x09-\x0d\x20a-z0-9\xdf-\xf6\xf8-\u017f]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SELF)}
SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """The ids of a piece that the pattern doesn't split, by the model alone; bounded like Ids."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
        ids = array("I", [t.id for t in self.tokenize(seen)])
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(piece) <= WORD_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Ids(dict):
    """The ids of a text, as little-endian unsigned 32-bit numbers; as a table, those of white-space separated words.

    Texts, or else words, of ASCII and of the Latin letters up to U+017F are split by the tokenizer's pattern here, and only
    the model is asked; all others go through the whole tokenizer. Either way gives the same ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in known.get("added_tokens", [])]
        # in either case, as an added token may be looked for in the lower-cased text
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        plain = known["normalizer"] == NORMALIZER and known["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": PATTERN}
        self.pieces = Pieces(self.tokenizer.model) if plain else None

    def __missing__(self, word: str) -> bytes:
        if self.pieces is not None and PLAIN.fullmatch(word):
            ids = b"".join(map(self.pieces.__getitem__, SPLIT.findall(word.lower())))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= WORD_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        text = text or ""
        if self.added is not None and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.pieces is not None and PLAIN_TEXT.fullmatch(text):
            return b"".join(map(self.pieces.__getitem__, SPLIT.findall(text.lower())))
        # str.split() also splits at these four, which the tokenizer's pattern takes for ordinary characters
        words = SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return b"".join(map(self.__getitem__, words))


@functools.cache
def ids_of(path: str) -> Ids:
    """One table for all tasks of a worker process."""
    return Ids(path)


class Levels:
    """Open windows by fill level, and the sum-of-squares choice."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, size: int) -> int:
        """The level that takes a piece of `size` < window; -1 for a new window."""
        n, w = self.count, self.window
        top = w - size
        # change of the sum of squares: level l loses a window (1 - 2n), level l + size gains one (2n + 1) but if it is full
        change = 2 * n[size : w + 1] + 1
        change[top] = 0
        change[1:] += 1 - 2 * n[1 : top + 1]
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = top - int(np.argmin(change[::-1]))
        return best or -1


def pack(lengths: Iterator[tuple[int, int]], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece of (document, tokens) pairs, by the rules above."""
    levels, held, next_sequence = Levels(window), {}, 0
    for document, tokens in lengths:
        start = 0
        while tokens - start >= window:
            yield document, start, window, next_sequence, 0
            next_sequence, start = next_sequence + 1, start + window
        if not (size := tokens - start):
            continue
        level = levels.place(size)
        if level < 0:
            sequence, level, next_sequence = next_sequence, 0, next_sequence + 1
            held[sequence] = []
        else:
            sequence = levels.open[level].pop()
            levels.count[level] -= 1
        held[sequence].append((document, start, size))
        if level + size == window:
            yield from _placed(held.pop(sequence), sequence)
        else:
            levels.open[level + size].append(sequence)
            levels.count[level + size] += 1
    # close: fill the fullest with pieces of the emptiest
    left = sorted(((sum(p[2] for p in pieces), sequence, pieces) for sequence, pieces in held.items()), key=lambda x: (x[0], x[1]))
    low, spare = 0, []
    for high in range(len(left) - 1, -1, -1):
        fill, sequence, pieces = left[high]
        if high < low:
            break
        while fill < window and (spare or low < high):
            if not spare:
                spare, low = left[low][2][::-1], low + 1
                continue
            document, start, size = spare.pop()
            if (over := fill + size - window) > 0:
                spare.append((document, start + size - over, over))
                size -= over
            pieces.append((document, start, size))
            fill += size
        if fill == window:
            yield from _placed(pieces, sequence)
            continue
        spare = pieces[::-1] + spare[::-1] if not spare else pieces[::-1]
        break
    left_over = spare[::-1]
    fill = sum(p[2] for p in left_over)
    while fill:
        room = 1 << (fill.bit_length() - 1)
        fill, pieces = fill - room, []
        while room:
            document, start, size = left_over.pop(0)
            if size > room:
                left_over.insert(0, (document, start + room, size - room))
                size = room
            pieces.append((document, start, size))
            room -= size
        yield from _placed(pieces, next_sequence)
        next_sequence += 1


def _placed(pieces: list[tuple[int, int, int]], sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
    offset = 0
    for document, start, size in pieces:
        yield document, start, size, sequence, offset
        offset += size


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids."""
    path = path or tokenizer_path()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_packer(path, window, end, with_ids), SCHEMA + (", ids array<int>" if with_ids else ""))


def _packer(path: str, window: int, end: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ending = ids_of(path), np.array([end], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        known: dict[int, list] = {}  # of documents with pieces not yet placed: doc_id, tokens, the last of its ids, tokens not placed

        def lengths() -> Iterator[tuple[int, int]]:
            n = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    own = ids.of(text.as_py()) + ending
                    tokens = len(own) // 4
                    whole = tokens // window * window
                    known[n] = [doc_id, tokens, own, tokens]
                    yield n, tokens
                    if whole and n in known:  # its full windows are out; only the remainder can still be open
                        known[n][2] = own[whole * 4 :]
                    n += 1

        out: list[tuple] = []
        for k, start, length, sequence, offset in pack(lengths(), window):
            d = known[k]
            shift = d[1] - len(d[2]) // 4
            piece = d[2][(start - shift) * 4 : (start - shift + length) * 4]
            row = (d[0], start, length, zlib.crc32(piece), d[1], base + sequence, offset)
            out.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
            d[3] -= length
            if not d[3]:
                del known[k]
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(rows[0])]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def query(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
