"""Vector bin packing of token pieces into training sequences.

A piece asks for tokens, one segment and its loss-bearing tokens; a sequence offers ``capacity``,
``max_segments`` and ``max_loss`` of them. Each task packs its own documents: full stretches of a long
document are sequences by themselves, and each rest goes to the open sequence with the largest dot
product of what is asked for and what is left, both as shares of the limits. If it fits nowhere whole
and no more sequences may be open, it is cut to fill the roomiest. What is open at a task's end is
filled up by cutting; the last, short sequence becomes sequences of powers of two, which need no
padding. No row is shuffled, and a task that runs again packs its own rows alike.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import small_batches

#: Words and pieces kept by a worker; some 100 and 150 bytes each.
CACHED_WORDS, CACHED_PIECES = 600_000, 600_000
_tokenizers: dict[str, object] = {}
#: Texts encoded at a time, in bytes.
GROUP_BYTES = 1 << 22

#: Words of these characters are the same in NFC, and split into these pieces, in lower case.
PLAIN = "[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
PIECES = "'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"
#: Bytes of a word that may be kept.
LONGEST = 64


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


#: Texts on which the short way is held against the whole tokenizer when a file is loaded.
PROBES = [
    "a", "The quick Fox's", "it'll WE'VE don't", "x1y22 3,14", "(a) [b] {c}; d: e!?", "naïve Été ÀÖØÞ ß ÿ", "a  b\n\tc \r d", "!!## $$", "¡hola! 日本 e\u0301", "...", "'s 's's",
]


def _items(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def _joined(parts: list[bytes], numbers: pa.Int32Array, offsets: pa.Int32Array) -> list[bytes]:
    """The numbered parts, one after another, from each offset to the next."""
    if not len(numbers):
        return [b""] * (len(offsets) - 1)
    lined_up = pa.array(parts, pa.large_binary()).take(numbers)
    _, ends, data = lined_up.buffers()
    ends = np.frombuffer(ends, np.int64)[offsets.to_numpy()].tolist()
    held = memoryview(data)
    return [bytes(held[start:end]) for start, end in zip(ends, ends[1:])]


class WordTokenizer:
    """Ids of a lower-casing byte-level tokenizer that drops white space, so words can be encoded one by one.

    The first ``CACHED_WORDS`` words and ``CACHED_PIECES`` pieces are kept, so a text is mostly look-ups. Words of
    plain letters, digits and signs are cut into pieces here, and the new pieces of all texts at hand go to the vocabulary's merges
    in one call: a piece ends where a token ends a word. All others, and those that may
    hold a special token, go through the whole tokenizer. A file whose tokenizer is of another kind is told by a few
    probes, and then encodes all texts as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # nothing but the merges, of pieces between spaces
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.letters = {b: letter for b, letter in enumerate(byte_letters()) if letter != chr(b) and b != 0x20}
        try:
            suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
            self.by_word = self._by_word([text.encode() for text in PROBES]) == [self._whole(text) for text in PROBES]
        except Exception:  # merges that don't take bare pieces, or don't tell where one ends
            self.by_word = False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        spelled = b" ".join(pieces).decode("latin-1")
        if not spelled.isascii():
            spelled = spelled.translate(self.letters)
        ids = np.array(self.merges.encode(spelled, add_special_tokens=False).ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        made = ids.tobytes()
        return [made[start:end] for start, end in zip([0, *ends[:-1]], ends, strict=True)]

    def _encode(self, words: pa.LargeBinaryArray) -> list[bytes]:
        """Ids of words that are not kept yet."""
        texts = words.view(pa.large_string())  # so that patterns see characters; bytes that are none match nothing
        plain = pc.and_(pc.match_substring_regex(texts, f"^{PLAIN}$"), pc.less_equal(pc.binary_length(words), LONGEST))
        plain = pc.and_not(plain, pc.match_substring(words, "<|"))
        others = words.filter(pc.invert(plain))
        words, lower = words.filter(plain), pc.utf8_lower(texts.filter(plain))
        split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(lower, f"({PIECES})", r"\1 ")))
        pieces = split.values.view(pa.large_binary()).dictionary_encode()
        distinct = _items(pieces.dictionary)
        new = [piece for piece in distinct if piece not in self.pieces]
        fresh = dict(zip(new, self._merged(new), strict=True)) if new else {}
        made = _joined([self.pieces.get(piece) or fresh[piece] for piece in distinct], pieces.indices, split.offsets)
        self.pieces.update(itertools.islice(fresh.items(), max(0, CACHED_PIECES - len(self.pieces))))
        self.known.update(itertools.islice(zip(_items(words), made, strict=True), max(0, CACHED_WORDS - len(self.known))))
        made, whole = iter(made), (self._whole(word.decode("utf-8", "replace")) for word in _items(others))
        return [next(made if is_plain else whole) for is_plain in _items(plain)]

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        """Distinct words are looked up; Arrow splits the texts, numbers their words and lines up the ids."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = split.values.view(pa.large_binary()).dictionary_encode()
        distinct = _items(words.dictionary)
        found = list(map(self.known.get, distinct))
        if None in found:
            missing = [k for k, ids in enumerate(found) if ids is None]
            for k, ids in zip(missing, self._encode(words.dictionary.take(pa.array(missing, pa.int32()))), strict=True):
                found[k] = ids
        return _joined(found, words.indices, split.offsets)

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of the text."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; the more texts at a time, the fewer look-ups."""
        return self._by_word(texts) if self.by_word else [self._whole(text.decode("utf-8", "replace")) for text in texts]


def tokenizer_of(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def ids_in_order(tokenizer: WordTokenizer, texts: Iterable[bytes]) -> Iterator[bytes]:
    """Ids of each text, encoded in groups of ``GROUP_BYTES``; a longer text is a group by itself."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > GROUP_BYTES:
            yield from tokenizer.ids_of(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield from tokenizer.ids_of(group)


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: bytes
    doc_tokens: int
    prompt: int  # ids of the document that bear no loss, from its start

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self) - max(self.start, self.prompt))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[: 4 * length], self.doc_tokens, self.prompt)
        return head, Piece(self.doc, self.start + length, self.ids[4 * length :], self.doc_tokens, self.prompt)

    def most(self, tokens: int, loss: int) -> int:
        """The longest head within ``tokens`` ids and ``loss`` loss-bearing ids."""
        free = max(0, self.prompt - self.start)
        return min(len(self), tokens, free + loss)


class Packer:
    def __init__(self, emit: Callable[[list[Piece]], None], capacity: int, max_segments: int, max_loss: int, max_open: int):
        self.emit, self.max_open = emit, max_open
        self.limits = np.array([capacity, max_segments, max_loss], dtype=np.float64)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.bins: list[list[Piece]] = []
        self.left = np.zeros((max_open, 3))

    def add(self, piece: Piece) -> None:
        while len(piece):
            whole = piece.most(self.capacity, self.max_loss)
            if whole == self.capacity:
                head, piece = piece.cut(whole)
                self.emit([head])
                continue
            if whole < len(piece):
                head, piece = piece.cut(max(1, whole))
                self.place(head)
                continue
            self.place(piece)
            return

    def place(self, piece: Piece) -> None:
        while len(piece):
            asked = np.array([len(piece), 1, piece.loss], dtype=np.float64)
            left = self.left[: len(self.bins)]
            fits = (left >= asked).all(axis=1)
            if fits.any():
                scores = np.where(fits, (left / self.limits) @ (asked / self.limits), -1.0)
                self.put(int(scores.argmax()), piece)
                return
            if len(self.bins) < self.max_open:
                self.bins.append([])
                self.left[len(self.bins) - 1] = self.limits
                self.put(len(self.bins) - 1, piece)
                return
            number = int(left[:, 0].argmax())
            length = piece.most(int(left[number, 0]), int(left[number, 2]))
            if length:
                head, piece = piece.cut(length)
                self.put(number, head)
            else:
                self.close(number)

    def put(self, number: int, piece: Piece) -> None:
        self.bins[number].append(piece)
        self.left[number] -= (len(piece), 1, piece.loss)
        if self.left[number, 0] <= 0 or self.left[number, 1] <= 0:
            self.close(number)

    def close(self, number: int) -> None:
        pieces = self.bins[number]
        last = len(self.bins) - 1
        self.bins[number], self.left[number] = self.bins[last], self.left[last]
        self.bins.pop()
        self.emit(pieces)

    def finish(self) -> None:
        """Refill what is open, cutting at will; the last sequence is split at powers of two."""
        rest = sorted((p for pieces in self.bins for p in pieces), key=len, reverse=True)
        self.bins = []
        filled: list[Piece] = []
        tokens = loss = 0
        for piece in rest:
            while len(piece):
                length = piece.most(self.capacity - tokens, self.max_loss - loss)
                if length == 0 or len(filled) == self.max_segments:
                    self.emit(filled)
                    filled, tokens, loss = [], 0, 0
                    continue
                head, piece = piece.cut(length)
                filled.append(head)
                tokens, loss = tokens + length, loss + head.loss
                if tokens == self.capacity:
                    self.emit(filled)
                    filled, tokens, loss = [], 0, 0
        while tokens:
            size = 1 << (tokens.bit_length() - 1)
            tokens -= size
            taken: list[Piece] = []
            while size:
                head, filled[0] = filled[0].cut(min(size, len(filled[0])))
                taken.append(head)
                size -= len(head)
                if not len(filled[0]):
                    filled.pop(0)
            self.emit(taken)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    key: str = "doc_id",
    prompt: str | None = None,
    end_id: int = 1,
    capacity: int = 2048,
    max_segments: int = 256,
    max_loss: int | None = None,
    max_open: int = 64,
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. ``prompt`` names a
    column with the number of leading ids that bear no loss (none if it is not given or null). Repeated
    rows are packed as often as they occur; an empty table gives an empty table. sequence_id is
    the task's number and a running number within it.
    """
    limit_loss = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, limit_loss) < 1:
        raise ValueError("capacity, max_segments and max_loss must be at least 1")
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def pack_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_of(tokenizer_path)
        made: list[tuple] = []
        waiting = 0  # ids in ``made``
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence, waiting
            offset = 0
            for piece in pieces:
                row = (piece.doc, piece.start, len(piece), zlib.crc32(piece.ids), piece.doc_tokens, sequence, offset)
                made.append((*row, np.frombuffer(piece.ids, dtype="<u4").astype(np.int32)) if with_ids else row)
                offset += len(piece)
            sequence += 1
            waiting += offset

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(made, columns=names)
            out["doc"] = out["doc"].astype("Int64")
            made.clear()
            return out

        packer = Packer(emit, capacity, max_segments, limit_loss, max_open)
        for batch in batches:
            encoded = ids_in_order(tokenizer, (body or b"" for body in batch["body"]))
            for doc, ids, leading in zip(batch["doc"], encoded, batch["prompt"], strict=True):
                ids += end
                packer.add(Piece(None if pd.isna(doc) else int(doc), 0, ids, len(ids) // 4, int(leading)))
                if waiting >= 1 << 18:
                    waiting = 0
                    yield frame()
        packer.finish()
        yield frame()

    leading = F.coalesce(F.col(prompt).cast("long"), F.lit(0)) if prompt else F.lit(0).cast("long")
    rows = small_batches(docs).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("body"), leading.alias("prompt"))
    kinds = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rows.mapInPandas(pack_batches, kinds + (", ids array<int>" if with_ids else ""))
    return packed.withColumnRenamed("doc", key)
