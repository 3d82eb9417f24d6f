"""Exact token ids by the tokenizers library, with a cache of word pieces.

For a byte-level BPE with the usual splitting pattern, a text always splits
before a space that is followed by a character which is not white space, and
nothing merges across that place.  So a text's ids are those of its pieces,
each taken alone; pieces recur, and only those not seen lately are encoded.
Where a piece starts with white space (or is empty, or a special string follows
the space), it stays joined to the piece before it.  Files of any other kind
(with a normalizer, another splitter, or a sentencepiece model) get whole texts.

Pieces are found on the UTF-8 bytes and looked up in arrays: the bytes of a
piece of up to ``Store.LONGEST`` of them, and their number, are its key as they
are, so no two pieces share one.  Longer pieces, texts' first ones and joined
ones are kept by their bytes in a dictionary.

New pieces of plain Latin letters, digits and signs, for which the pattern has
one reading, are proposed by a rank-ordered encoder built from the file, where
the file's ids are in the order of its merges.  A proposal counts only if the
library agrees on all of it: a sequence of tokens is a BPE's encoding if and only
if each two neighbours are the encoding of their text, so every distinct pair
of neighbours (and every token that stands alone) goes to the library once in
each worker.  Pieces with a pair that the library gives otherwise, or that is
no whole text, are encoded by the library themselves, like all other pieces.

Huge texts go to the library in overlapping chunks, with offsets.  The splitter
reads from left to right and looks one character ahead, so what it does from a
place on depends on that place alone: where the left chunk's encoding, before
its last characters, and the right chunk's start a word of the splitter at the
same place, both go on alike, and the text's encoding is the left one up to
there and the right one from there on.  All common tokens behind that place
must agree in id and offset; if they don't, or no word starts at the same place
in both, the overlap is widened, at last to all of the left chunk, which then
grows itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries after which the cache keeps its short pieces alone (about 60 bytes each), and bytes of pieces in its dictionary.
MAX_ENTRIES, MAX_NAMED = 1_500_000, 1 << 25
#: Bytes of a short piece, and of the longest one that is kept.
SHORT, KEPT = 7, 256
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: Pairs after which a worker proves them anew (about 100 bytes each).
MAX_PAIRS = 1_000_000
#: Characters of a chunk of a huge text, and of the first overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 8

#: Bytes of plain pieces: ASCII without white space but line breaks, and the first byte of À to ÿ, whose second ones are told by it.
_PLAIN = np.array([b == 10 or 33 <= b <= 126 or b == 0xC3 for b in range(256)])
_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
#: White space of one byte, and first bytes of characters that may be white space.
_SPACE = np.array([b < 128 and chr(b).isspace() for b in range(256)])
_SPACE_MAYBE = np.array([any(chr(c).isspace() and chr(c).encode()[0] == b for c in range(128, 0x3001)) for b in range(256)])
#: How byte-level files usually split a text; a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stands for the second token of a token that is alone.
_ALONE = (1 << 32) - 1

_OPEN: dict[tuple[str, bool, int], Encoder] = {}


def _bytes_of_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _usual(spec: dict) -> bool:
    """Whether the file is a byte-level BPE that splits by the usual pattern and takes texts and special strings as they are."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    merges = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return bool(plain and merges and not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")))


def _rank_encoder(spec: dict):
    """A rank-ordered encoder with the ids of a usual file, or None where they aren't in the order of its merges."""
    model = spec["model"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(model["vocab"].get(token) != 256 + k for k, token in enumerate(merged)):
        return None
    letters = _bytes_of_letters()
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): rank for token, rank in model["vocab"].items() if token not in special}
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str, special_as_text: bool = False, chunk: int = CHUNK) -> Encoder:
    """One encoder for each file and worker; special strings inside texts as the library's default has it, or as ordinary text."""
    key = path, special_as_text, chunk
    if key not in _OPEN:
        _OPEN[key] = Encoder(path, chunk, special_as_text=special_as_text)
    return _OPEN[key]


class _Sentences:
    """A sentencepiece model behind the calls that are used of the tokenizers library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def get_vocab_size(self) -> int:
        return self.model.vocab_size()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Library:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.get_vocab_size = self.model.get_vocab_size

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Spans:
    """The library's encoding of text[at:end]: ids, their offsets in the whole text, and which ids start a word of the splitter."""

    def __init__(self, library: _Library, text: str, at: int, end: int, dtype: np.dtype):
        found = library.model.encode(text[at:end], add_special_tokens=False)
        self.at, self.end = at, end
        self.ids = np.array(found.ids, dtype)
        self.offsets = np.array([a for a, _ in found.offsets], np.int64) + at
        word = np.array([-1 - k if w is None else w for k, w in enumerate(found.word_ids)], np.int64)
        self.words = np.append(True, word[1:] != word[:-1])[: len(word)]

    def starts(self, low: int, high: int) -> np.ndarray:
        """Places of words' starts from low on, before high."""
        return self.offsets[self.words & (self.offsets >= low) & (self.offsets < high)]

    def between(self, low: int, high: int) -> slice:
        return slice(*np.searchsorted(self.offsets, (low, high)).tolist())


def _laid(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places at[0], at[0] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    place = np.int32 if max(total, int(at.max(initial=0)) + int(lengths.max(initial=0))) < 1 << 31 else np.int64
    out = np.repeat((at - (ends - lengths)).astype(place), lengths)
    out += np.arange(total, dtype=place)
    return out


class Store:
    """Ids of pieces by number.  Number 0 is no piece; a piece without ids is one that stays joined to the piece before it."""

    #: Bytes of the longest piece with a key: all of a key but one byte, for their number and 1.
    LONGEST, WORDS = 23, 3
    _MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    _ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __init__(self, dtype: np.dtype, size: int = 1 << 12):
        self.n, self.used = 1, 0
        self.keys = [np.zeros(size, np.uint64) for _ in range(self.WORDS)]
        self.at, self.lengths = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.flat = np.zeros(4 * size, dtype)
        self.table = np.zeros(2 * size, np.int32)
        self.named: dict[bytes, int] = {}
        self.named_bytes = 0

    @classmethod
    def keys_of(cls, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Keys of pieces of at most LONGEST bytes of buf, which has 8 * WORDS more at its end."""
        view = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))  # the eight bytes from every place on
        keys = [view[starts + 8 * k] & cls._MASK[np.clip(lengths - 8 * k, 0, 8)] for k in range(cls.WORDS)]
        keys[-1] |= (lengths + 1).astype(np.uint64) << np.uint64(56)  # never 0, which named pieces have
        return keys

    def _slots(self, keys: list[np.ndarray]) -> np.ndarray:
        mixed = np.zeros(len(keys[0]), np.uint64)
        for k, odd in zip(keys, self._ODD, strict=True):
            mixed = (mixed ^ k) * odd
            mixed ^= mixed >> np.uint64(32)
        return ((mixed * self._ODD[0]) >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _same(self, numbers: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([own[numbers] == k for own, k in zip(self.keys, keys, strict=True)])

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """Number of each key's piece, or 0."""
        slots = self._slots(keys)
        out = self.table[slots]
        bad = np.flatnonzero((out != 0) & ~self._same(out, keys))
        while len(bad):
            slots[bad] = (slots[bad] + 1) & (len(self.table) - 1)
            out[bad] = self.table[slots[bad]]
            bad = bad[(out[bad] != 0) & ~self._same(out[bad], [k[bad] for k in keys])]
        return out

    def _put(self, numbers: np.ndarray) -> None:
        slots = self._slots([k[numbers] for k in self.keys])
        while len(numbers):
            free = self.table[slots] == 0
            self.table[slots[free]] = numbers[free]
            left = self.table[slots] != numbers
            numbers, slots = numbers[left], (slots[left] + 1) & (len(self.table) - 1)

    def add(self, ids: np.ndarray, lengths: np.ndarray, keys: list[np.ndarray] | None = None) -> np.ndarray:
        """Numbers of new pieces; keys: of different pieces, none of them here yet."""
        first, self.n = self.n, self.n + len(lengths)
        grown = lambda x, least: x if least <= len(x) else np.concatenate([x, np.zeros(max(least, 2 * len(x)) - len(x), x.dtype)])
        self.at, self.lengths, self.flat = grown(self.at, self.n), grown(self.lengths, self.n), grown(self.flat, self.used + len(ids))
        self.keys = [grown(k, self.n) for k in self.keys]
        self.at[first : self.n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : self.n] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        numbers = np.arange(first, self.n, dtype=np.int32)
        for own, k in zip(self.keys, keys or [0] * self.WORDS, strict=True):
            own[first : self.n] = k
        if keys and len(numbers):
            if 2 * self.n > len(self.table):
                self.table = np.zeros(1 << (4 * self.n - 1).bit_length(), np.int32)
                self._put(np.flatnonzero(self.keys[-1][: self.n]).astype(np.int32))
            else:
                self._put(numbers)
        return numbers

    def short(self) -> Store:
        """A store of the pieces of few bytes alone, or an empty one if they are most."""
        out = Store(self.flat.dtype)
        sizes = self.keys[-1][: self.n] >> np.uint64(56)
        left = np.flatnonzero((sizes > 0) & (sizes <= SHORT + 1))
        if 2 * len(left) <= MAX_ENTRIES:
            out.add(self.flat[_laid(self.at[left], self.lengths[left])], self.lengths[left], [k[left] for k in self.keys])
        return out


class Encoder:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, special_as_text: bool = False):
        self.chunk, self.overlap, self.widened, self.spliced = chunk, overlap, 0, 0
        self.pairs: dict[int, bool] = {}
        self.usual, self.special, self.ranked, self.tab = False, (), None, None
        if path.endswith(".model"):
            self.library: _Library | _Sentences = _Sentences(path)
        else:
            self.library = _Library(path)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.library.model.encode_special_tokens = special_as_text
            self.special = () if special_as_text else tuple(t["content"] for t in spec["added_tokens"])
            self.usual = _usual(spec)
            self.ranked = _rank_encoder(spec) if self.usual else None
            self.tab = self.ranked.encode_ordinary("\t")[0] if self.ranked else None
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.store = Store(self.dtype)
        self.special_first = np.zeros(256, bool)
        self.special_first[[t.encode()[0] for t in self.special]] = True

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of a byte-level file's ids, without loss."""
        return self.library.model.decode_batch(ids, skip_special_tokens=False)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, self.dtype).tobytes() for x in self.library.ids(texts)]

    def _joined(self, piece: str) -> bool:
        """The space before this piece is no proven boundary."""
        return not piece or piece[0].isspace() or piece.startswith(self.special)

    def _prove(self, codes: list[int]) -> None:
        """Asks the library about pairs of tokens."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        texts, asked = [], []
        for code in codes:
            tokens = [code >> 32] if code & _ALONE == _ALONE else [code >> 32, code & _ALONE]
            self.pairs[code] = False
            try:
                texts.append(b"".join(map(self.ranked.decode_single_token_bytes, tokens)).decode())
            except UnicodeDecodeError:
                continue
            asked.append((code, tokens))
        for (code, tokens), ids in zip(asked, self.library.ids(texts), strict=True):
            self.pairs[code] = ids == tokens

    def _proven(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Whether the library agrees with all of each proposal; ids of all of them, and where each starts."""
        following = np.append(ids[1:], 0).astype(np.int64)
        last = np.append(starts[1:], len(ids)) - 1
        following[last] = np.where(last == starts, _ALONE, -1)  # -1: nothing to prove, the token is in the pair before
        real = following >= 0
        codes, inverse = np.unique((ids[real].astype(np.int64) << 32) | following[real], return_inverse=True)
        known = codes.tolist()
        self._prove([c for c in known if c not in self.pairs])
        right = np.ones(len(ids), bool)
        right[real] = np.array([self.pairs.get(c, False) for c in known], bool)[inverse]
        return np.logical_and.reduceat(right, starts)

    def _propose(self, spaced: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces, each with its space, and where each starts; a tab between them is a word of the splitter."""
        ids = np.array(self.ranked.encode_ordinary(spaced.decode()), np.uint32)
        tabs = np.flatnonzero(ids == self.tab)
        return np.delete(ids, tabs), np.append(0, tabs - np.arange(len(tabs)))

    def _spaced_at(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of bytes, each with its space, one after the other, and how many each has."""
        own = buf[_laid(starts, lengths)]
        ends = np.cumsum(lengths)
        counts, found, plain = np.zeros(len(starts), np.int64), [], np.zeros(len(starts), bool)
        some = np.flatnonzero(lengths > 0)
        if self.ranked is not None and len(some):
            before = np.append(np.uint8(0), own[:-1])
            before[(ends - lengths)[some]] = 0
            odd = ~np.where(before == 0xC3, _SECOND[own], _PLAIN[own]) | ((own == 0x7C) & (before == 0x3C))  # "<|" may be special
            odd[ends[some] - 1] |= own[ends[some] - 1] == 10
            plain[some] = ~np.logical_or.reduceat(odd, (ends - lengths)[some])
        at = np.flatnonzero(plain)
        if len(at):
            sizes = lengths[at] + 2
            spaced = np.full(int(sizes.sum()), 32, np.uint8)
            spaced[np.cumsum(sizes) - 1] = 9
            spaced[_laid(np.cumsum(sizes) - sizes + 1, lengths[at])] = own[np.repeat(plain, lengths)]
            ids, first = self._propose(spaced[:-1].tobytes())
            right = self._proven(ids, first)
            found.append(ids[np.repeat(right, np.diff(np.append(first, len(ids))))].astype(self.dtype))
            counts[at] = np.diff(np.append(first, len(ids)))
            plain[at] = right
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return found[0] if found else np.zeros(0, self.dtype), counts
        raw = own.tobytes()
        edges = zip((ends - lengths)[rest].tolist(), ends[rest].tolist())
        left = self.library.ids([" " + raw[a:b].decode() for a, b in edges])
        counts[rest] = [len(x) for x in left]
        found.append(np.array([i for x in left for i in x], self.dtype))
        order = np.concatenate([np.flatnonzero(plain), rest])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(found)[_laid(at, counts)], counts

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each with its space."""
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(x) for x in raw], np.int64)
        ids, counts = self._spaced_at(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths)
        edges = np.append(0, np.cumsum(counts)).tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def _numbers(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers in the store of pieces with keys; buf has room for the last keys."""
        keys = Store.keys_of(buf, starts, lengths)
        out = self.store.find(keys)
        new = np.flatnonzero(out == 0)
        if not len(new):
            return out
        order = new[np.lexsort([k[new] for k in keys])]
        first = np.append(True, np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys]))
        at = order[first]
        byte = buf[starts[at]]
        joined = (lengths[at] == 0) | _SPACE[byte]
        for k in np.flatnonzero(~joined & (_SPACE_MAYBE | self.special_first)[byte]).tolist():
            joined[k] = self._joined(buf[starts[at[k]] : starts[at[k]] + lengths[at[k]]].tobytes().decode())
        free = at[~joined]
        counts = np.zeros(len(at), np.int64)
        ids, counts[~joined] = self._spaced_at(buf, starts[free], lengths[free])
        out[order] = self.store.add(ids, counts, [k[at] for k in keys])[np.cumsum(first) - 1]
        return out

    def _named(self, texts: list[bytes]) -> np.ndarray:
        """Numbers in the store of texts that the library encodes as they are."""
        store = self.store
        asked = dict.fromkeys(t for t in texts if t not in store.named)
        whole = self.library.ids([t.decode() for t in asked])
        numbers = store.add(np.array([i for x in whole for i in x], self.dtype), np.array([len(x) for x in whole], np.int64))
        fresh = dict(zip(asked, numbers.tolist(), strict=True))
        out = np.array([fresh[t] if t in fresh else store.named[t] for t in texts], np.int32)
        store.named |= fresh
        store.named_bytes += sum(map(len, fresh))
        return out

    def _by_pieces(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts from those of their distinct pieces, put together in arrays, and their places."""
        if self.store.n > MAX_ENTRIES or self.store.named_bytes > MAX_NAMED:
            self.store = self.store.short()
        store, rows = self.store, len(offs) - 1
        spaces = np.flatnonzero(buf == 32)
        first = np.searchsorted(spaces, offs[:-1]) + np.arange(rows)
        last = np.append(first[1:], len(spaces) + rows) - 1
        head, tail = np.zeros(len(spaces) + rows, bool), np.zeros(len(spaces) + rows, bool)
        head[first], tail[last] = True, True
        starts, ends = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
        starts[head], starts[~head], ends[tail], ends[~tail] = offs[:-1], spaces + 1, offs[1:], spaces
        keyed = ~head & (ends - starts <= Store.LONGEST)
        at = np.flatnonzero(keyed)
        numbers = np.zeros(len(head), np.int32)
        numbers[at] = self._numbers(np.append(buf, np.zeros(8 * Store.WORDS, np.uint8)), starts[at], (ends - starts)[at])
        raw = buf.tobytes()
        joined = keyed & (store.lengths[numbers] == 0)
        for k in np.flatnonzero(~head & ~keyed).tolist():
            joined[k] = self._joined(raw[starts[k] : ends[k]].decode())
        whole = ~keyed
        if joined.any():  # pieces with all that are joined to them
            group = np.flatnonzero(~joined)
            whole = whole[group] | (np.diff(np.append(group, len(head))) > 1)
            numbers, head = numbers[group], head[group]
            starts, ends = starts[group], ends[np.append(group[1:], len(ends)) - 1]
            first = np.flatnonzero(head)
        spaced = starts - ~head
        kept = np.flatnonzero(whole & (ends - spaced <= KEPT))
        numbers[kept] = self._named([raw[a:b] for a, b in zip(spaced[kept].tolist(), ends[kept].tolist())])
        mark = store.n, store.used
        long = np.flatnonzero(whole & (ends - spaced > KEPT))
        if len(long):
            ids = self.library.ids([raw[a:b].decode() for a, b in zip(spaced[long].tolist(), ends[long].tolist())])
            numbers[long] = store.add(np.concatenate([np.array(x, self.dtype) for x in ids]), np.array([len(x) for x in ids], np.int64))
        taken = store.lengths[numbers]
        out = store.flat[_laid(store.at[numbers], taken)]
        store.n, store.used = mark
        return out, np.append(np.append(0, np.cumsum(taken))[first], len(out))

    def arrays(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of UTF-8 bytes, one after the other, and their places."""
        if self.usual and len(offs) > 1 and (offs[1:] - offs[:-1]).max() <= self.chunk:
            return self._by_pieces(buf, offs)
        raw = buf.tobytes()
        out = self.batch([raw[a:b].decode() for a, b in zip(offs.tolist(), offs[1:].tolist())])
        return np.frombuffer(b"".join(out), self.dtype), np.cumsum([0, *(len(x) // self.dtype.itemsize for x in out)])

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian numbers of ``dtype``."""
        if not self.usual:
            return self._whole(texts)
        out: list[bytes | None] = [None] * len(texts)
        short = []
        for k, text in enumerate(texts):
            if len(text) > self.chunk:
                out[k] = self._resynchronised(text)
            else:
                short.append(k)
        low = 0
        while low < len(short):
            high, raw, size = low, [], 0
            while high < len(short) and size < SLICE:
                raw.append(texts[short[high]].encode())
                size, high = size + len(raw[-1]), high + 1
            ids, places = self._by_pieces(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            got, edges = ids.tobytes(), (places * self.dtype.itemsize).tolist()
            for k, a, b in zip(short[low:high], edges, edges[1:]):
                out[k] = got[a:b]
            low = high
        return out

    def _resynchronised(self, text: str) -> bytes:
        """Ids of a huge text from overlapping chunks."""
        out: list[bytes] = []
        unsure = max(map(len, self.special), default=0) + 1  # a special string may be cut at a chunk's end
        cut, overlap = 0, self.overlap
        left = self._spans(text, 0, self.chunk)
        while left.end < len(text):
            again = max(cut, left.end - overlap)
            right = self._spans(text, again, again + max(self.chunk, 2 * (left.end - again)))
            common = np.intersect1d(left.starts(again, left.end - unsure), right.starts(again, left.end - unsure))
            if len(common) > 1 and self._agree(left, right, int(common[0]), int(common[-1])):
                place = int(common[0])
                out.append(left.ids[left.between(cut, place)].tobytes())
                cut, left, overlap = place, right, self.overlap
                self.spliced += 1
                continue
            self.widened += 1
            overlap *= 2
            if again == cut:  # all of the left chunk's rest was in the overlap
                left = self._spans(text, cut, cut + 2 * (left.end - cut))
        out.append(left.ids[left.between(cut, len(text))].tobytes())
        return b"".join(out)

    def _spans(self, text: str, at: int, end: int) -> Spans:
        return Spans(self.library, text, at, min(end, len(text)), self.dtype)

    @staticmethod
    def _agree(left: Spans, right: Spans, low: int, high: int) -> bool:
        """Whether both have the same ids at the same offsets between two places."""
        a, b = left.between(low, high), right.between(low, high)
        return np.array_equal(left.ids[a], right.ids[b]) and np.array_equal(left.offsets[a], right.offsets[b])
