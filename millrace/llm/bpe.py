"""BPE encoding and decoding of a public word-end tokenizer, by a bounded-lookahead streaming transducer.

Spark deals the documents; a task keeps one transducer, made from the tokenizer's file, and a bounded memory of words.
Texts are read piece by piece and cut at ASCII white space, which no token crosses; each word that is not remembered goes
through the transducer. Decoding is incremental too: a state machine takes ids as they come.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe_core import ByteText, TokenText, WordBpe, gathered
from .common import each, give_back, held, id_of, key_of, lists, text_of

#: Words that come alone and are remembered.
_WORDS = 10_000
#: Bytes of a text that are read at once, of texts whose words are encoded at once, and ids that are written at once.
_PIECE, _GROUP, _IDS = 1 << 20, 2 << 20, 125_000
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces, cut at white space; an empty one is a piece too."""
    at = 0
    while at + _PIECE < len(text) and (cut := _BLANK.search(text, at + _PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _groups(texts: pa.Array) -> Iterator[tuple[list[int], pa.Array]]:
    """The pieces of texts, some at a time, and the row of each."""
    rows: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for row, text in enumerate(each(texts)):
        for piece in _pieces(text):
            rows.append(row)
            pieces.append(piece)
            size += len(piece)
            if size >= _GROUP:
                yield rows, pa.array(pieces, pa.binary()).cast(pa.string())
                rows, pieces, size = [], [], 0
    if rows:
        yield rows, pa.array(pieces, pa.binary()).cast(pa.string())


class _Encoder:
    """Ids of texts: each word of a group of texts is encoded once, all of them side by side."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe = bpe

    def encode(self, pieces: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some pieces at a time, one piece's after the other's, and how many each has."""
        words = pc.ascii_split_whitespace(pieces)
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        ids, start, size = self.bpe.ids_flat(coded.dictionary)
        size = size[word]
        ends = np.r_[0, np.cumsum(size)][bounds]
        at = 0
        while at < len(pieces):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _IDS, "right")) - 1)
            some = slice(bounds[at], bounds[to])
            yield gathered(ids, start[word[some]], size[some]), np.diff(ends[at : to + 1])
            at = to


class _Row:
    """What is known so far of a text that is read: digests of its ids, of the token strings and of the bytes' text."""

    def __init__(self) -> None:
        self.n, self.made = 0, (hashlib.sha256(), hashlib.sha256(), hashlib.sha256())

    def add(self, n: int, spelt: list[memoryview]) -> None:
        """``n`` more ids, spelt in three ways; there is one space behind each in the first two."""
        if n:
            for digest, text in zip(self.made[:2], spelt, strict=False):
                if self.n:
                    digest.update(b" ")
                digest.update(text[:-1])
            # a piece ends with its last word, so no character goes on in the next one
            try:
                str(spelt[2], "utf-8")
                self.made[2].update(spelt[2])
            except UnicodeDecodeError:
                self.made[2].update(str(spelt[2], "utf-8", "replace").encode())
            self.n += n


class _Digests:
    """Digests of texts' ids and of what they decode to, and the ids, taken while the texts are read."""

    def __init__(self, bpe: WordBpe) -> None:
        self.encoder, self.text, self.special = _Encoder(bpe), bpe.text, bpe.special
        own = ByteText(self.text, self.special).bytes
        ways = ({i: b"%d " % i for i in own}, {i: f"{t} ".encode() for i, t in self.text.items()}, own)
        self.spelt = [pa.array([way.get(i, b"") for i in range(max(own) + 1)], pa.binary()) for way in ways]

    def rows(self, texts: pa.Array, digests: bool, with_ids: bool) -> Iterator[tuple[list[_Row], np.ndarray]]:
        """The rows that are done, a group at a time, and their ids; the rows come in order."""
        rows: list[_Row] = []
        kept: list[np.ndarray] = []
        done = 0
        for row_of, pieces in _groups(texts):
            if rows:  # the last one may go on in this group
                ready = rows[:-1] if row_of[0] == done + len(rows) - 1 else rows
                n = sum(r.n for r in ready)
                flat = np.concatenate(kept) if with_ids else np.zeros(0, np.int32)
                if ready:
                    yield ready, flat[:n]
                rows, kept, done = rows[len(ready) :], [flat[n:]] * with_ids, done + len(ready)
            at = 0
            for ids, counts in self.encoder.encode(pieces):
                bounds = np.r_[0, np.cumsum(counts)]
                views = [self._spell(way, ids, bounds) for way in self.spelt if digests]
                for k, n in enumerate(counts.tolist()):
                    if row_of[at + k] == done + len(rows):
                        rows.append(_Row())
                    if digests:
                        rows[-1].add(n, [view[ends[k] : ends[k + 1]] for view, ends in views])
                    else:
                        rows[-1].n += n
                if with_ids:
                    kept.append(ids)
                at += len(counts)
        if rows:
            yield rows, np.concatenate(kept) if with_ids else np.zeros(0, np.int32)

    @staticmethod
    def _spell(way: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, list[int]]:
        """The ids' spellings, one after the other, and where they stand at some bounds."""
        text = way.take(pa.array(ids))
        _, ends, data = text.buffers()
        return memoryview(data or b""), np.frombuffer(ends, np.int32)[bounds].tolist() if len(ids) else [0] * len(bounds)


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """Pauses the search for cycles, which goes through all remembered words time and again and finds none among them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _digest(path: str, with_ids: bool, digests: bool = True):
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"] if digests else ["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held(("bpe", path), lambda: _Digests(WordBpe(path, _WORDS)))
        for batch in batches:
            at = 0
            found = made.rows(batch.column("bytes"), digests, with_ids)
            while True:
                with _uncollected():
                    rows, ids = next(found, ((), None))
                if not rows:
                    break
                n = np.array([r.n for r in rows], np.int64)
                columns = [batch.column("key").slice(at, len(rows))]
                if digests:
                    columns += [pa.array(n), *(pa.array([r.made[k].hexdigest() for r in rows], pa.string()) for k in range(3))]
                if with_ids:
                    columns.append(lists(pa.array(ids), n))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *["ids"] * with_ids])
                at += len(rows)
                del columns, rows, ids
                give_back()

    return run


def _decode(path: str, as_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = held(("bpe", path), lambda: _Digests(WordBpe(path, _WORDS)))
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                machine = ByteText(made.text, made.special) if as_bytes else TokenText(made.text)
                parts = [machine.feed(x) for x in batched(ids or (), _IDS)]
                texts.append("".join(parts) + (machine.feed((), final=True) if as_bytes else ""))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    return run


def bpe_encode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text, as the tokenizers library encodes it without added special tokens.

    A null or empty text has no ids. Rows that repeat stay; a null doc_id stays null; other columns are ignored.
    """
    keyed = docs.select(key_of().alias("key"), text_of().cast("binary").alias("bytes"))
    return keyed.mapInArrow(_digest(path or default_path(), True, False), "key long, ids array<int>").select(id_of().alias("doc_id"), "ids")


def bpe_decode(encoded: DataFrame, *, path: str | None = None, as_bytes: bool = False) -> DataFrame:
    """doc_id and text of ids. As the library's decode with special tokens, or (``as_bytes``) the bytes' own text, one
    space after each word, with U+FFFD for what is no character. Null ids give an empty text."""
    keyed = encoded.select(key_of().alias("key"), "ids")
    return keyed.mapInArrow(_decode(path or default_path(), as_bytes), "key long, text string").select(id_of().alias("doc_id"), "text")


def bpe_roundtrip(docs: DataFrame, *, path: str | None = None, ids: bool = False) -> DataFrame:
    """Encodes and decodes every text and gives digests: doc_id, n_tokens, ids_sha256 (decimal ids, one space between
    them), decoded_sha256, text_sha256 (of the bytes' own text), and with ``ids`` the ids. As ``bpe_encode`` and both ways
    of ``bpe_decode`` in one pass over the texts."""
    keyed = docs.select(key_of().alias("key"), text_of().cast("binary").alias("bytes"))
    more = ", ids array<int>" if ids else ""
    out = keyed.mapInArrow(_digest(path or default_path(), ids), f"key long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string{more}")
    return out.select(id_of().alias("doc_id"), *out.columns[1:])
