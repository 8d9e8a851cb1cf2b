"""A streaming BPE transducer with bounded lookahead, and an incremental decoder; no Spark here."""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

END = "</w>"
#: Bytes of a word that the transducer takes at once.
_BLOCK = 128


def byte_letters() -> list[str]:
    """The letter of each byte: printable bytes stand for themselves, the others follow from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return letters


class Table:
    """Numbers by 64-bit keys, looked up and added many at a time; -1 for a key that is not there. Half full at most."""

    def __init__(self, kind: type, bits: int = 12) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, kind)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        there, out = self.keys[at], self.values[at]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = next_one = at[todo] + 1 & len(self.keys) - 1
            there, out[todo] = self.keys[next_one], self.values[next_one]
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are not there yet, each given once."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old, self.used = self.keys >= 0, 0
            keys, values = np.r_[self.keys[old], keys], np.r_[self.values[old], values].astype(self.values.dtype)
            self.bits = (2 * len(keys)).bit_length()
            self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, self.values.dtype)
        self.used += len(keys)
        at = self._first(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            # of several that want one place, one has it now
            has = self.keys[at] == keys
            self.values[at[has]] = values[has]
            at, keys, values = at[~has] + 1 & len(self.keys) - 1, keys[~has], values[~has]


class Transducer:
    """Encodes the bytes of one word into tokens, each as soon as no later byte can change it.

    After every byte it keeps the one last token that the word so far can have: a token whose own encoding is itself and
    that may follow the last token of what is before it. A tree of tokens with links from each place to the longest
    other one that ends alike gives the tokens that end at a byte, none of them longer than ``lookahead``, the length of
    the longest token that the merge list can make. Once the encodings of the last ``lookahead`` prefixes agree on their
    first tokens, these are stable and are given out. So memory is bounded by the merge list, not by the word.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.text = {i: t for t, i in vocab.items()}
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges) if a in vocab and b in vocab}
        #: For each token its merge: rank and the two tokens it joins; letters have none.
        self.made = {vocab[a + b]: (r, vocab[a], vocab[b]) for r, (a, b) in enumerate(merges) if a + b in vocab}
        self.follows: dict[int, bool] = {}
        self.whole: set[str] = set()
        #: The tree of tokens: place * 256 + byte gives the next place; by place the token within and at the end of a word.
        self.edge: dict[int, int] = {}
        self.within, self.ending, self.lookahead = [-1], [-1], 1
        byte = {c: b for b, c in enumerate(byte_letters())}
        for token, i in sorted(vocab.items(), key=lambda x: self.made.get(x[1], (-1,))[0]):
            ends = token.endswith(END) and len(token) > len(END)
            letters = token[: -len(END)] if ends else token
            n = len(letters)
            if n == 0 or any(c not in byte for c in letters) or n > 1 and not (i in self.made and self._possible(i)):
                continue
            self.whole.add(token)
            self.lookahead = max(self.lookahead, n)
            place = 0
            for c in letters:
                key = place * 256 + byte[c]
                if key not in self.edge:
                    self.edge[key] = len(self.within)
                    self.within.append(-1)
                    self.ending.append(-1)
                place = self.edge[key]
            (self.ending if ends else self.within)[place] = i
        self._link()

    def _link(self) -> None:
        """For each place: its depth, the longest other place that ends alike, and the next one with a token, within and at the end."""
        n = len(self.within)
        below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, place in self.edge.items():
            below[key >> 8].append((key & 255, place))
        self.alike, self.depth, self.next_within, self.next_ending = [0] * n, [0] * n, [0] * n, [0] * n
        todo = [0]
        for up in todo:
            for byte, place in below[up]:
                self.depth[place] = self.depth[up] + 1
                f = self.alike[up]
                while up and (to := self.edge.get(f * 256 + byte)) is None and f:
                    f = self.alike[f]
                f = self.alike[place] = (to or 0) if up else 0
                self.next_within[place] = f if self.within[f] >= 0 else self.next_within[f]
                self.next_ending[place] = f if self.ending[f] >= 0 else self.next_ending[f]
                todo.append(place)
        self._flatten()

    def _flatten(self) -> None:
        """The same tables as arrays, for many words at once."""
        self.flat_edge, self.flat_rank, self.flat_follows = Table(np.int32), Table(np.int32), Table(np.int8)
        self.flat_edge.put(np.array([*self.edge], np.int64), np.array([*self.edge.values()], np.int32))
        self.flat_rank.put(np.array([u << 20 | t for u, t in self.rank], np.int64), np.array([*self.rank.values()], np.int32))
        self.flat_alike, self.flat_depth = np.array(self.alike), np.array(self.depth)
        self.flat_within = np.array(self.within), np.array(self.next_within)
        self.flat_ending = np.array(self.ending), np.array(self.next_ending)
        self.flat_made = tuple(np.full(max(self.text) + 1, -1) for _ in range(3))
        for i, made in self.made.items():
            for column, x in zip(self.flat_made, made, strict=True):
                column[i] = x

    def _possible(self, i: int) -> bool:
        """Whether plain BPE makes this token of its own letters: its two parts are such tokens and may stand together
        until their merge."""
        rank, a, b = self.made[i]
        text = self.text
        return text[a] in self.whole and text[b] in self.whole and self._apart(a, b, rank)

    def _apart(self, u: int, t: int, before: float = float("inf")) -> bool:
        """Whether the letters of tokens u and t become just these if merges of a rank below ``before`` alone count.

        Undoes merges of both sides, the latest one first, and asks at each step whether the tokens that then touched
        would have been joined before the next merge of either side.
        """
        rank, made = self.rank, self.made
        none = (-1, -1, -1)
        while True:
            left, right = made.get(u, none), made.get(t, none)
            joined = rank.get((u, t))
            if joined is not None and joined < before:
                return False
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                before, u = left[0], left[2]
            else:
                # the right side's merge came at the same time as, or before, a pair on its left of the same rank
                before, t = right[0] + 1, right[1]

    def may_follow(self, u: int, t: int) -> bool:
        if len(self.follows) > 400_000:
            self.follows.clear()
        found = self.follows[u << 20 | t] = self._apart(u, t)
        return found

    def encode(self, word: Iterable[bytes]) -> Iterator[int]:
        """Token ids of a word given in blocks of bytes, none of them empty; the last block closes the word."""
        edge, alike, depth, most = self.edge.get, self.alike, self.depth, self.lookahead
        last: list[int] = [-1]  # the last token of each prefix that is kept, the first one has been given out
        size: list[int] = [0]
        n, place, given = 0, 0, False
        stream = iter(word)
        ahead = next(stream, None)
        while ahead is not None:
            block, ahead = ahead, next(stream, None)
            token, onward, follows = self.within, self.next_within, self.follows
            final = n + len(block) if ahead is None else 0
            for byte in block:
                n += 1
                if n == final:
                    token, onward = self.ending, self.next_ending
                to = edge(place * 256 + byte)
                while to is None and place:
                    place = alike[place]
                    to = edge(place * 256 + byte)
                place = to or 0
                p = place if token[place] >= 0 else onward[place]
                while p:  # the tokens that end here, the longest first
                    u, t = last[n - depth[p]], token[p]
                    # a word's first token follows none
                    if u < 0 or (f if (f := follows.get(u << 20 | t)) is not None else self.may_follow(u, t)):
                        break
                    p = onward[p]
                else:
                    raise ValueError(f"no token for byte {byte}")
                last.append(t)
                size.append(depth[p])
            if n > 8 * most and ahead is not None:
                at = self._agreed(size, most)
                if at:
                    yield from self._path(last, size, at)
                    n, last, size = n - at, last[at:], [0, *size[at + 1 :]]
                    given = True
        yield from self._path(last, size, len(last) - 1)

    def encode_all(self, words: Sequence[bytes]) -> Iterator[list[int]]:
        """Token ids of many short words, each as ``encode`` gives them."""
        length = np.array([len(w) for w in words], np.int64)
        ids, counts = self.encode_flat(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)
        ends, flat = np.cumsum(counts).tolist(), ids.tolist()
        return (flat[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def encode_flat(self, letters: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many short words, which stand somewhere in ``letters``: one word's after the other's, and how many each
        has. The words' states go on side by side, a byte at a time; long words stand first, so that those that go on are the
        first ones."""
        order = np.argsort(-length, kind="stable")
        longest, begin = -length[order], begin[order]
        state = (np.cumsum(length + 1) - length - 1)[order]  # a word has a state before its first byte, and one after each
        n_states = int(length.sum()) + len(length)
        last, size = np.full(n_states, -1, np.int32), np.zeros(n_states, np.int16)
        place = np.zeros(len(length), np.int64)
        for n in range(int(length.max(initial=0))):
            going, on = np.searchsorted(longest, (-n, -n - 1))
            place[:going] = self._step(place[:going], letters[begin[:going] + n])
            for some, (token, onward) in ((slice(0, on), self.flat_within), (slice(on, going), self.flat_ending)):
                self._close(place[some], state[some] + n + 1, last, size, token, onward)
        return self._paths(np.cumsum(length + 1) - 1, last, size)

    def _step(self, place: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The places after one more byte."""
        place = place.copy()
        to = self.flat_edge.get(place << 8 | byte)
        todo = np.flatnonzero((to < 0) & (place > 0))
        while len(todo):
            place[todo] = up = self.flat_alike[place[todo]]
            to[todo] = found = self.flat_edge.get(up << 8 | byte[todo])
            todo = todo[(found < 0) & (up > 0)]
        return np.maximum(to, 0).astype(np.int64)

    def _close(self, place: np.ndarray, at: np.ndarray, last: np.ndarray, size: np.ndarray, token: np.ndarray, onward: np.ndarray) -> None:
        """Puts the last tokens of prefixes that end in these places into their states: of the tokens that end here the longest
        one that may follow the last token of what is before it."""
        p = np.where(token[place] >= 0, place, onward[place])
        while len(p):
            if not p.all():
                raise ValueError("no token for a byte")
            d, t = self.flat_depth[p], token[p]
            u = last[at - d]
            fits = u < 0
            asked = np.flatnonzero(~fits)
            fits[asked] = self._follow(u[asked].astype(np.int64) << 20 | t[asked])
            last[at[fits]], size[at[fits]] = t[fits], d[fits]
            at, p = at[~fits], onward[p[~fits]]

    def _follow(self, pairs: np.ndarray) -> np.ndarray:
        """``may_follow`` of many pairs; what was found is remembered."""
        found = self.flat_follows.get(pairs)
        if (found < 0).any():
            new = np.unique(pairs[found < 0])
            if self.flat_follows.used + len(new) > 400_000:
                self.flat_follows = Table(np.int8)
            self.flat_follows.put(new, self._apart_all(new))
            missing = np.flatnonzero(found < 0)
            found[missing] = self.flat_follows.get(pairs[missing])
        return found > 0

    def _apart_all(self, pairs: np.ndarray) -> np.ndarray:
        """``_apart`` of many pairs."""
        out, todo = np.zeros(len(pairs), bool), np.arange(len(pairs))
        u, t, before = pairs >> 20, pairs & 0xFFFFF, np.full(len(pairs), 1 << 30)
        rank, left, right = self.flat_made
        while len(todo):
            joined, a, b = self.flat_rank.get(u << 20 | t), rank[u], rank[t]
            apart = (joined < 0) | (joined >= before)
            out[todo[apart & (a < 0) & (b < 0)]] = True
            go = apart & ((a >= 0) | (b >= 0))
            todo, u, t, a, b = todo[go], u[go], t[go], a[go], b[go]
            before = np.where(a > b, a, b + 1)
            u, t = np.where(a > b, right[u], u), np.where(a > b, t, left[t])
        return out

    @staticmethod
    def _paths(at: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that lead to each of these states, and how many."""
        counts, word, steps = np.zeros(len(at), np.int64), np.arange(len(at)), []
        while True:
            going = last[at] >= 0
            at, word = at[going], word[going]
            if not len(at):
                break
            counts[word] += 1
            steps.append((word, last[at]))
            at = at - size[at]
        ends, out = np.cumsum(counts), np.zeros(int(counts.sum()), np.int32)
        for back, (word, token) in enumerate(steps, 1):
            out[ends[word] - back] = token
        return out, counts

    @staticmethod
    def _agreed(size: list[int], most: int) -> int:
        """The longest prefix that the encodings of all of the last ``most`` prefixes run through."""
        live = set(range(len(size) - most, len(size)))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - size[top])
        return live.pop()

    @staticmethod
    def _path(last: list[int], size: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of an array, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))]


class Seen:
    """Tells words that come again from those that come once, in a bit each; forgets all before the bits fill up.

    Words that come once need not be remembered, and most words of a language's long tail do. A word may be taken for
    another one: it is then remembered early.
    """

    def __init__(self) -> None:
        self.bits, self.used = bytearray(1 << 21), 0

    def before(self, word: str | bytes) -> bool:
        h = hash(word) & 0xFFFFFF
        byte, bit = h >> 3, 1 << (h & 7)
        if self.bits[byte] & bit:
            return True
        self.bits[byte] |= bit
        self.used += 1
        if self.used > 1 << 22:
            self.bits, self.used = bytearray(1 << 21), 0
        return False


class TokenText:
    """Decoding without a decoder in the tokenizer's file: token strings, one space between them, piece by piece."""

    def __init__(self, text: dict[int, str]) -> None:
        self.text, self.begun = text, False

    def feed(self, ids: Iterable[int]) -> str:
        out = " ".join(map(self.text.__getitem__, ids))
        if self.begun and out:
            out = " " + out
        self.begun |= bool(out)
        return out


class ByteText:
    """Decoding of byte letters to text: a state machine that holds an unfinished UTF-8 sequence between calls.

    A word's end becomes one space. Bytes that form no character become U+FFFD.
    """

    _known: dict[int, tuple[dict[int, str], dict[int, bytes]]] = {}

    def __init__(self, text: dict[int, str], special: Iterable[str] = ()) -> None:
        found = self._known.get(id(text))
        if found is None or found[0] is not text:
            self._known.clear()
            found = self._known[id(text)] = text, self._bytes(text, {*special})
        self.bytes = found[1]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    @staticmethod
    def _bytes(text: dict[int, str], special: set[str]) -> dict[int, bytes]:
        """By id, the bytes that a token stands for; a special token stands for its own text, which ends what is unfinished."""
        byte = {c: b for b, c in enumerate(byte_letters())}
        out = {}
        for i, token in text.items():
            ends = token.endswith(END) and token not in special
            body = token[: -len(END)] if ends else token
            out[i] = token.encode() if token in special else bytes([byte[c] for c in body]) + b" " * ends
        return out

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)), final)


class WordBpe:
    """The tokenizer of a ``tokenizers`` file of the kind: NFC, white space, lower case; regex words; byte letters; BPE."""

    def __init__(self, path: str, cached: int = 250_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or model["end_of_word_suffix"] != END or split["behavior"] != "Removed" or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path} is not a word-end BPE tokenizer of the kind that this operator reproduces")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.transducer = Transducer(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.words = regex.compile(split["pattern"]["Regex"])
        self.in_lines = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.cached = cached
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.seen = Seen()

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word, remembered from the second time on; what was not asked for since the memory was last full goes."""
        found = self.older.get(word)
        if found is None:
            spelt = word.encode()
            found = tuple(self.transducer.encode((spelt,) if len(spelt) <= _BLOCK else (spelt[k : k + _BLOCK] for k in range(0, len(spelt), _BLOCK))))
            if len(word) > 64 or not self.seen.before(word):
                return found
        if len(self.known) >= self.cached:
            self.known, self.older = {}, self.known
        self.known[word] = found
        return found

    def _spelt(self, chunk: str) -> Iterator[str | int]:
        """The words of a text as the model gets them, and the ids of special tokens."""
        for piece in self.specials.split(chunk) if "<|" in chunk else (chunk,):
            if piece in self.special:
                yield self.special[piece]
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
            piece = "".join([c.lower() for c in piece]) if "Σ" in piece else piece.lower()
            yield from (piece,) if piece.isascii() and piece.isalpha() else self.words.findall(piece)

    def ids(self, chunk: str) -> list[int]:
        """Token ids of a text. Texts may be cut at ASCII white space and their ids joined: no token crosses it."""
        out: list[int] = []
        for word in self._spelt(chunk):
            if isinstance(word, int):
                out.append(word)
            else:
                out.extend(self.known.get(word) or self._word(word))
        return out

    def ids_of(self, chunks: Sequence[str]) -> list[list[int]]:
        """Token ids of many short texts."""
        ids, start, size = self.ids_flat(pa.array(chunks, pa.string()))
        return [ids[a : a + n].tolist() for a, n in zip(start.tolist(), size.tolist(), strict=True)]

    def ids_flat(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of many different texts without ASCII white space: the ids, where a text's begin, and how many they are.
        Equal words of theirs go through the transducer once, all of them side by side."""
        plain, special = pc.ascii_is_alpha(chunks), pc.match_substring(chunks, "<|")
        rest = pc.and_not(pc.invert(plain), special)
        # the other texts are put in lines: nothing is composed, and no word goes, across their ends
        lines = "\n".join(chunks.filter(rest).to_pylist())
        if not lines.isascii():
            lines = unicodedata.normalize("NFC", lines).replace("Σ", "σ")
        found = pa.array(self.in_lines.findall(lines.lower()), pa.string())
        line = np.cumsum(ends := pc.equal(found, "\n").to_numpy(zero_copy_only=False))[~ends]
        coded = pa.chunked_array([pc.ascii_lower(chunks.filter(plain)), found.filter(pa.array(~ends))]).combine_chunks().dictionary_encode()
        word, n_plain = coded.indices.to_numpy(), len(coded) - len(line)
        ids, at, n = self._ids_of_words(coded.dictionary)

        start, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        where = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        start[where], size[where] = at[word[:n_plain]], n[word[:n_plain]]
        where, more = np.flatnonzero(rest.to_numpy(zero_copy_only=False)), [ids]
        if len(where):
            several = word[n_plain:]
            size[where] = np.bincount(line, n[several], len(where)).astype(np.int64)
            start[where] = len(ids) + np.cumsum(size[where]) - size[where]
            more.append(gathered(ids, at[several], n[several]))
        self._behind(more, start, size, [(k, self.ids(chunks[k].as_py())) for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()])
        return np.concatenate(more), start, size

    def _ids_of_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``ids_flat``, of single words."""
        _, ends, letters = words.buffers()
        ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        length = np.diff(ends).astype(np.int64)
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        short = np.flatnonzero(length <= _BLOCK)
        ids, size[short] = self.transducer.encode_flat(np.frombuffer(letters or b"", np.uint8), ends[short].astype(np.int64), length[short])
        start[short] = np.cumsum(size[short]) - size[short]
        more = [ids]
        self._behind(more, start, size, [(k, self._word(words[k].as_py())) for k in np.flatnonzero(length > _BLOCK).tolist()])
        return np.concatenate(more), start, size

    @staticmethod
    def _behind(parts: list[np.ndarray], start: np.ndarray, size: np.ndarray, found: list[tuple[int, Sequence[int]]]) -> None:
        """Puts the ids of some texts behind those of the others."""
        at = sum(map(len, parts))
        for k, ids in found:
            start[k], size[k], at = at, len(ids), at + len(ids)
            parts.append(np.array(ids, np.int32))
