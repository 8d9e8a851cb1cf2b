"""Secret scans: plain patterns, and a linear-chain conditional random field for what they miss.

The patterns' finds in documents that have some train the field, on a bounded sample of windows of tokens. It tags the
tokens around every long token as begin, inside or outside of a secret, from their shape, their neighbours and features
of the file, and Viterbi decodes the tags. Only tokens of 12 characters or more may be tagged inside or begin, so that
all other tokens are outside without being decoded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import each, hash_sample, id_of, key_of, lists, materialize, text_of

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
#: The same for Spark: texts in which one of the patterns finds something.
_ANY = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "crf")
_LONG = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")
#: A word as in a sentence, and what gives a value: a word of one case is looked at only after such a thing.
_PLAIN = re.compile(rb"[A-Za-z]?[a-z]+[.\-]*|[A-Z]+[.\-]*")
_GIVEN = re.compile(rb"[:=\"'`]|pass|pwd|secret|token|key|auth|cred|bearer|private", re.IGNORECASE)
_TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]+|[^A-Za-z0-9+/_.=\-\s]+")
_TURNS = re.compile(rb"[0-9][A-Za-z]")
_KEYISH = re.compile(rb"pass|pwd|secret|token|key|auth|cred|bearer|private", re.IGNORECASE)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Bytes of text on either side of a long token that its window of tokens takes in.
_AROUND = 40
#: Tokens of a window that are trained on at once; longer windows come in pieces.
_LONGEST = 48
OUT, BEGIN, INSIDE = 0, 1, 2
_N_FEATURES = 29
#: Features of the patterns' own: hex digits, AKIA, and the neighbouring words.
_PECULIAR = np.isin(np.arange(_N_FEATURES), [8, 15, 21, 22, 23, 24, 26])
#: What weights are drawn to where the patterns' finds do not tell: what holds "//" is an address.
_PRIOR = np.zeros((_N_FEATURES, 3))
_PRIOR[19, BEGIN:] = -6.0
_NEVER = -1e9


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """start, end and kind (0 to 2) of what the patterns find, in bytes, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2], s[1]))
    return found


def windows(text: bytes) -> list[list[tuple[int, int]]]:
    """Tokens, as (start, end), around the long tokens; near ones share a window. Plain words that nothing gives as a value
    are left to their sentence."""
    out: list[tuple[int, int]] = []
    for m in _LONG.finditer(text):
        if _PLAIN.fullmatch(m[0]) and not _GIVEN.search(text, max(0, m.start() - 24), m.start()):
            continue
        a, b = max(0, m.start() - _AROUND), m.end() + _AROUND
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    found = []
    for a, b in out:
        tokens = [m.span() for m in _TOKEN.finditer(text, a, min(b, len(text)))]
        if a and tokens and tokens[0][0] == a and not text[a - 1 : a].isspace():
            tokens = tokens[1:]  # the window cut it
        found.append(tokens)
    return found


_DIGITS, _UPPER, _LOWER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def _shape(t: bytes) -> list[float]:
    n = len(t)
    digits, upper, lower = (n - len(t.translate(None, x)) for x in (_DIGITS, _UPPER, _LOWER))
    long = n >= 12
    bits = math.log2(n) - sum(c * math.log2(c) for c in Counter(t).values()) / n if long else 0
    hexed = long and not t.translate(None, _DIGITS + b"abcdef")
    # letters and digits taking turns, as in random codes
    turns = len(_TURNS.findall(t)) if long and digits else 0
    return [1, long, n >= 16, n >= 20, n >= 32, digits > 0, digits >= 0.25 * n, digits == n, hexed, upper > 0, lower > 0, upper > 0 and lower > 0 and digits > 0, b"." in t, any(c in t for c in b"/+="), b"_" in t or b"-" in t, t.startswith(b"AKIA"), bits >= 3, bits >= 3.6, long and digits > 0 and upper + lower > 0, b"//" in t, turns >= 3]


def features(text: bytes, tokens: list[tuple[int, int]], keyed: bool, many: bool) -> tuple[np.ndarray, np.ndarray]:
    """The features of each token, and whether it may belong to a secret."""
    words = [text[a:b] for a, b in tokens]
    rows = []
    for i, w in enumerate(words):
        before, after = words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""
        near = b" ".join(words[max(0, i - 3) : i])
        rows.append([*_shape(w), any(c in b":=" for c in before), any(c in b"\"'`" for c in before), _KEYISH.search(near) is not None, any(c in b"\"'`" for c in after[:1]), b"@" in before[-1:] or b"@" in after[:1], keyed, many, len(w) < 12])
    x = np.array(rows, np.float64).reshape(len(words), _N_FEATURES)
    return x, np.array([len(w) >= 12 for w in words], bool)


class Field:
    """A linear-chain conditional random field with three tags."""

    def __init__(self, emit: np.ndarray, step: np.ndarray) -> None:
        self.emit, self.step = emit, step

    @staticmethod
    def fit(sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
        """Maximises the penalised likelihood of tags, by gradient steps over all sequences, padded side by side."""
        longest = max(len(y) for _, _, y in sequences)
        n = len(sequences)
        x, mask, y, real = np.zeros((n, longest, _N_FEATURES)), np.zeros((n, longest, 3)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (a, may, tags) in enumerate(sequences):
            k = len(tags)
            x[i, :k], y[i, :k], real[i, :k] = a, tags, True
            mask[i, :k, 1:] = np.where(may, 0.0, _NEVER)[:, None]
        emit, step = _PRIOR.copy(), np.zeros((3, 3))
        step[OUT, INSIDE] = _NEVER
        moment = [np.zeros_like(emit), np.zeros_like(step)]
        square = [np.zeros_like(emit), np.zeros_like(step)]
        gold, onehot = np.zeros((3, 3)), np.eye(3)[y] * real[:, :, None]
        both = real[:, 1:]
        np.add.at(gold, (y[:, :-1][both], y[:, 1:][both]), 1)
        for t in range(1, rounds + 1):
            score = x @ emit + mask
            fore, back = np.zeros_like(score), np.zeros_like(score)
            fore[:, 0] = score[:, 0] + np.array([0, 0, _NEVER])
            for k in range(1, longest):
                fore[:, k] = np.where(real[:, k, None], np.logaddexp.reduce(fore[:, k - 1, :, None] + step, axis=1) + score[:, k], fore[:, k - 1])
            for k in range(longest - 2, -1, -1):
                back[:, k] = np.where(real[:, k + 1, None], np.logaddexp.reduce(step + (score[:, k + 1] + back[:, k + 1])[:, None, :], axis=2), back[:, k + 1])
            total = np.logaddexp.reduce(fore[:, -1], axis=1)
            prob = np.exp(fore + back - total[:, None, None]) * real[:, :, None]
            pairs = np.zeros((3, 3))
            for k in range(1, longest):
                on = real[:, k]
                if on.any():
                    pairs += np.exp(fore[on, k - 1, :, None] + step + (score[on, k] + back[on, k])[:, None, :] - total[on, None, None]).sum(0)
            grads = [np.einsum("nkf,nkt->ft", x, onehot - prob) / n - decay * (emit - _PRIOR), (gold - pairs) / n - decay * np.where(step < -1e8, 0, step)]
            for p, g, m, s in zip((emit, step), grads, moment, square, strict=True):
                m[:] = 0.9 * m + 0.1 * g
                s[:] = 0.99 * s + 0.01 * g * g
                p += rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            step[OUT, INSIDE] = _NEVER
        return Field(emit, step)

    def decode(self, x: np.ndarray, may: np.ndarray) -> list[int]:
        """The likeliest tags (Viterbi)."""
        score = x @ self.emit
        score[~may, 1:] = _NEVER
        best, came = score[0] + np.array([0, 0, _NEVER]), []
        for row in score[1:]:
            way = best[:, None] + self.step
            came.append(way.argmax(0))
            best = way.max(0) + row
        tags = [int(best.argmax())]
        for c in reversed(came):
            tags.append(int(c[tags[-1]]))
        return tags[::-1]


def examples(text: bytes) -> list[tuple[list[tuple[int, int]], np.ndarray]]:
    """The windows of a text with the tags that the patterns' finds give."""
    spans, out = base_spans(text), []
    for tokens in windows(text):
        if not tokens:
            continue
        tags, last = [], None
        for a, b in tokens:
            hit = next((s for s in spans if s[0] < b and a < s[1]), None) if b - a >= 12 else None
            tags.append(OUT if hit is None else INSIDE if hit == last and tags and tags[-1] != OUT else BEGIN)
            last = hit
        out.append((tokens, np.array(tags, np.int8)))
    return out


_PIECE = "text binary, ends binary, tags binary, skip int, keyed boolean, many boolean"


def train(docs: DataFrame, sample: int) -> Field | None:
    """A field from at most ``sample`` different pieces of windows, of 48 tokens at most, of the documents in which the
    patterns find something, taken in the order of a hash; None without any.

    Other documents do not teach: a secret of another kind may stand in them unmarked. Windows are cut on the executors;
    long ones come in pieces, all of which may be drawn. A piece counts once however often it stands, so that copies of a
    document do not crowd out the others; features are made of the chosen pieces alone.
    """
    texts = docs.select(text_of().alias("text")).where(F.col("text").rlike(_ANY))
    pieces = texts.select(F.col("text").cast("binary").alias("bytes")).mapInArrow(_windows_of, _PIECE)
    pieces = materialize(pieces.withColumn("name", F.xxhash64("text", "ends", "tags", "skip", "keyed", "many")).dropDuplicates(["name"]))
    found = [_taught(r) for r in hash_sample(pieces, ["name"], sample).collect()]
    if not any((y != OUT).any() for _, _, y in found):
        return None
    # once more without what is peculiar to the patterns, so that the shape of a code alone can tell
    bare = [(np.where(_PECULIAR, 0.0, x), may, y) for x, may, y in found]
    return Field.fit([*found, *bare])


def _taught(r: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, what may be a secret, and tags of a piece, without the tokens before and after that it came with."""
    tokens, tags = np.frombuffer(r.ends, np.int32).reshape(-1, 2), np.frombuffer(r.tags, np.int8)
    x, may = features(bytes(r.text), [(a, b) for a, b in tokens.tolist()], r.keyed, r.many)
    own = slice(r.skip, r.skip + len(tags))
    return x[own], may[own], tags.astype(np.int64)


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of windows of texts in which the patterns find something: their bytes, the tokens in them, and tags.

    A piece brings the three tokens before it and the one after it along, as features look at these.
    """
    for batch in batches:
        for t in each(batch.column("bytes")):
            if not base_spans(t):
                continue
            found, rows = examples(t), []
            keyed = _KEYISH.search(t) is not None
            for tokens, tags in found:
                for k in range(0, len(tags), _LONGEST):
                    first, own = max(0, k - 3), tags[k : k + _LONGEST].copy()
                    own[:1] = np.where(own[:1] == INSIDE, BEGIN, own[:1])  # a piece begins what the last one has cut
                    some = np.array(tokens[first : k + _LONGEST + 1], np.int32)
                    rows.append((t[some[0, 0] : some[-1, 1]], (some - some[0, 0]).tobytes(), own.tobytes(), k - first, keyed, len(found) > 1))
            for k in range(0, len(rows), 500):
                columns = [*zip(*rows[k : k + 500], strict=True)]
                kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["text", "ends", "tags", "skip", "keyed", "many"])


def all_spans(text: bytes, field: Field | None) -> list[tuple[int, int, int]]:
    """start, end and kind of all finds, in code points, by start and kind."""
    base = base_spans(text)
    more = []
    if field is not None:
        found = windows(text)
        keyed = bool(found) and _KEYISH.search(text) is not None
        for tokens in found:
            if not tokens:
                continue
            x, may = features(text, tokens, keyed, len(found) > 1)
            if not may.any():
                continue
            begun = None
            for (a, b), tag in zip([*tokens, (0, 0)], [*field.decode(x, may), OUT], strict=True):
                if begun and tag != INSIDE:
                    if not any(s < begun[1] and begun[0] < e for s, e, _ in base):
                        more.append((*begun, 3))
                    begun = None
                if tag == BEGIN:
                    begun = (a, b)
                elif tag == INSIDE and begun:
                    begun = (begun[0], b)
    spans = sorted([*base, *more], key=lambda s: (s[0], s[2], s[1]))
    if spans and not text.isascii():
        points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(points[i - 1]) if i else 0
        spans = [(at(a), at(b), k) for a, b, k in spans]
    return spans


def _scan(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, field) for t in each(batch.column("bytes"))]
            flat = [s for f in found for s in f]
            parts = [pa.array([KINDS[k] for _, _, k in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, b, _ in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists(pa.StructArray.from_arrays(parts, ["kind", "start", "end"]), np.array([len(f) for f in found], np.int64))], names=["key", "spans"])

    return run


def secret_spans(docs: DataFrame, *, sample: int = 600) -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive) of every text, by start and kind.

    Kinds: assign, access and hex are what the patterns find, leftmost and without overlap within a kind; crf is what
    the field adds beside them. ``sample`` bounds the pieces of windows that train the field; all documents are scanned.

    A null or empty text has no spans; a null doc_id stays null; repeated rows get a row each; an empty table gives an
    empty result, and without any pattern's find the field adds nothing. Other columns are ignored.
    """
    field = train(docs, sample)
    keyed = docs.select(key_of().alias("key"), text_of().cast("binary").alias("bytes"))
    found = keyed.mapInArrow(_scan(field), "key long, spans array<struct<kind:string,start:long,end:long>>")
    return found.select(id_of().alias("doc_id"), "spans")
