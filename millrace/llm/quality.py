"""Quality rules: plain counts of words, symbols and repeats, and the fertility of a public tokenizer.

Each word is cut into pieces of the public vocabulary once per task and remembered; a text's pieces give characters per
piece, the share of byte-fallback pieces and the entropy of its pieces. Bands for each language say what is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, hash_sample, held, id_of, key_of, text_of

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Words that a worker remembers.
_REMEMBERED = 200_000


@dataclass(frozen=True)
class Band:
    """What is kept: characters per piece, pieces per word, share of byte pieces, entropy of pieces in bits."""

    least_chars: float = 0.3
    most_chars: float = 12.0
    most_pieces: float = 12.0
    most_bytes: float = 0.5
    least_entropy: float = 3.0


#: Bands by language, and by script where a text's language is unknown: ``fit_bands`` over 3,243 labelled texts, rounded
#: outwards or to where bad texts begin. Any other script has the wide default.
BANDS = {
    "en": Band(1.95, 8.0, 3.3, 0.05, 5.6),
    "de": Band(1.97, 8.0, 3.3, 0.05, 5.5),
    "es": Band(1.78, 8.0, 3.4, 0.05, 5.45),
    "fr": Band(1.80, 8.0, 3.4, 0.05, 5.55),
    "Latin": Band(1.70, 8.0, 3.6, 0.05, 5.4),
}
DEFAULT_BAND = Band()
_LATIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Pieces:
    """Numbers of words and the pieces of each, in flat arrays; forgotten as a whole when there are too many."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pieces, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.size = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > _REMEMBERED:
            self.forget()
        get = self.number.get
        found = [get(w, -1) for w in words]
        if -1 in found:
            new = list(dict.fromkeys(w for w, n in zip(words, found, strict=True) if n < 0))
            for w, ids in zip(new, self.model.encode([w.decode(errors="replace") for w in new], num_threads=1), strict=True):
                self._add(w, ids)
            found = [get(w) for w in words]
        return np.array(found, np.int64)

    def _add(self, word: bytes, ids: list[int]) -> None:
        n = len(self.number)
        if n >= len(self.start):
            self.start, self.size = (np.r_[x, np.zeros(len(x), np.int64)] for x in (self.start, self.size))
        while self.used + len(ids) > len(self.pieces):
            self.pieces = np.r_[self.pieces, np.zeros(len(self.pieces), np.int32)]
        self.number[word] = n
        self.start[n], self.size[n] = self.used, len(ids)
        self.pieces[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        total = int(size.sum())
        return self.pieces[np.repeat(self.start[numbers] - (np.cumsum(size) - size), size) + np.arange(total)]


def _pieces(path: str) -> _Pieces:
    return held(("pieces", path), lambda: _Pieces(path))


def repeat_words(numbers: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs at least twice."""
    n = len(numbers)
    if n < 3:
        return 0
    _, small = np.unique(numbers, return_inverse=True)
    base = int(small.max()) + 1
    if base < 2_000_000:
        window = (small[:-2] * base + small[1:-1]) * base + small[2:]
    else:
        _, two = np.unique(small[:-1] * base + small[1:], return_inverse=True)
        window = two[:-1] * base + small[2:]
    _, kind, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[kind] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def measure(text: bytes, pieces: _Pieces) -> tuple[Any, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_pieces, chars_per_piece, byte_share, entropy."""
    words = text.split()
    solid = text.translate(None, SPACE)
    chars = len(solid.decode(errors="replace"))
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    if not words:
        return 0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0
    numbers = pieces.numbers(words)
    ids = pieces.of(numbers)
    n = len(ids)
    count = np.bincount(ids)
    count = count[count > 0]
    entropy = float(np.log2(n) - (count * np.log2(count)).sum() / n) if n else 0.0
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(numbers), n, chars / n if n else 0.0, float(pieces.is_byte[ids].mean()) if n else 0.0, entropy


_OUT = "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_pieces long, chars_per_piece double, byte_share double, piece_entropy double, base_failed boolean, kept boolean"
_TYPES = [*[pa.int64()] * 6, *[pa.float64()] * 3, pa.bool_(), pa.bool_()]


def band_of(text: bytes, lang: str | None, bands: dict[str, Band]) -> Band:
    """The band of the language, else of the script: Latin if most characters outside of blanks are its letters."""
    if lang in bands:
        return bands[lang]
    solid = text.translate(None, SPACE)
    latin = len(solid) - len(solid.translate(None, _LATIN))
    return bands.get("Latin", DEFAULT_BAND) if latin * 2 > len(solid.decode(errors="replace")) else DEFAULT_BAND


def judge(x: tuple[Any, ...], text: bytes, lang: str | None, bands: dict[str, Band]) -> tuple[bool, bool]:
    """Whether the plain rules fail, and whether the text is kept."""
    n_words, _, _, _, repeats, n, chars, share, entropy = x
    if n_words < 50 or 100 * repeats > 50 * n_words:
        return True, False
    b = band_of(text, lang, bands)
    return False, b.least_chars <= chars <= b.most_chars and n <= b.most_pieces * n_words and share <= b.most_bytes and entropy >= b.least_entropy


def _rules(path: str, bands: dict[str, Band]):
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            rows = []
            for text, lang in zip(each(batch.column("bytes")), each(batch.column("lang")), strict=True):
                x = measure(text, pieces)
                rows.append((*x, *judge(x, text, lang, bands)))
            columns = zip(*rows, strict=True) if rows else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=names)

    return run


def quality_rules(docs: DataFrame, *, path: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """Counts, fertility and verdict of every text.

    Words are maximal runs without ASCII white space. base_failed: fewer than 50 words, or more than half of them in
    3-word windows that occur again. kept: the plain rules hold and the text lies in its language's band.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_pieces, chars_per_piece, byte_share,
    piece_entropy, base_failed, kept; a row for each row of ``docs`` (doc_id, text and, if there is one, lang). A null
    or empty text has no words and fails; a null or unknown lang has the band of the text's script, or the wide one; other
    columns are ignored.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    keyed = docs.select(key_of().alias("key"), lang.alias("lang"), text_of().cast("binary").alias("bytes"))
    out = keyed.mapInArrow(_rules(path or default_path(), BANDS if bands is None else bands), _OUT)
    return out.select(id_of().alias("doc_id"), *[c for c in out.columns if c != "key"])


def keep_good(docs: DataFrame, *, path: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; decided in the pass that reads them."""
    names, fields = docs.columns, docs.schema
    chosen, rules = path or default_path(), BANDS if bands is None else bands
    at, lang_at = names.index("text"), names.index("lang") if "lang" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(chosen)
        for batch in batches:
            langs = each(batch.column(lang_at)) if lang_at >= 0 else [None] * batch.num_rows
            texts = ((t or "").encode() for t in each(batch.column(at)))
            keep = [judge(measure(t, pieces), t, lang, rules)[1] for t, lang in zip(texts, langs, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, fields)


def fit_bands(docs: DataFrame, labels: DataFrame, *, sample: int = 4_000, tail: float = 0.005, path: str | None = None) -> dict[str, Band]:
    """Bands for each language, from at most ``sample`` documents that labels (doc_id, quality) call good.

    They hold all but a share ``tail`` of these at either end; documents that the plain rules fail do not count. A row for
    each language comes to the driver.
    """
    good = hash_sample(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id"), ["doc_id"], sample)
    rows = quality_rules(docs.join(F.broadcast(good), "doc_id", "left_semi"), path=path).where("NOT base_failed").join(docs.select("doc_id", "lang"), "doc_id")
    end = lambda c, p: F.percentile(c, F.lit(p)).cast("double")
    found = rows.groupBy("lang").agg(end("chars_per_piece", tail).alias("a"), end("chars_per_piece", 1 - tail).alias("b"), end(F.col("n_pieces") / F.col("n_words"), 1 - tail).alias("c"), end("byte_share", 1 - tail).alias("d"), end("piece_entropy", tail).alias("e"))
    return {r["lang"]: Band(r["a"], r["b"], r["c"], r["d"], r["e"]) for r in found.where("lang IS NOT NULL").collect()}
