"""Token ids by the tokenizers library, encoding each distinct piece once.

A byte-level BPE splits a text into pieces by a fixed pattern and encodes
each piece by itself, so the ids of a text are those of its pieces.  For
texts of printable ASCII and Latin-1 letters the pieces are cut here as the
vocabulary's own pattern does (which means the same in ``re`` on these
characters), and the library encodes each distinct piece once per worker;
any other text goes to the library whole.  Both ways give the library's ids.

For the byte vocabulary, which splits white space off too, the cuts of all texts of a
batch are found at once, and pieces of up to 16 characters are looked up at once, by
their characters as two 64-bit numbers.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

# One thread per task: Spark runs the tasks in parallel already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"

# Letters, digits and spaces as the patterns below see them; a text with any other character is encoded whole.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡ª«µº»¿-ÿ]*")
# The split patterns of the two vocabularies (letters come first: no other branch can begin with one).
_SPLIT = {
    "byte": re.compile(rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{_LETTER}0-9]+"),
}

# Space, tab, newline, carriage return, vertical tab and form feed as a byte-level vocabulary writes them.
_BYTE_BLANKS = "\u0120\u0109\u010a\u010d\u010b\u010c"

# How a byte-level vocabulary writes a byte: one that is no visible character of Latin-1 as the next letter from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

# Distinct pieces remembered by a worker, in two generations: when the young one
# has half of them, the old one is forgotten and it becomes the old one.
CACHE_PIECES = 1_000_000

# What a character of a plain text is to the byte vocabulary's pattern, by its Latin-1 code.
_KIND = np.full(256, 2, np.uint8)  # 0: letter, 1: digit, 2: other, 3: white space
_KIND[[c for c in range(256) if re.match(f"[{_LETTER}]", chr(c))]] = 0
_KIND[list(b"0123456789")] = 1
_KIND[list(b"\t\n\r ")] = 3
_SPACE, _QUOTE = ord(" "), ord("'")
# Masks of the first 0 to 8 characters of a 64-bit number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Characters of the longest piece that is looked up by two numbers; bits of its number of ids (two a character at most).
LONGEST, _COUNT = 16, 6
# Places in a word for which mixed ids are held.
_PLACES = 8

_encoders: dict[str, Encoder] = {}


def byte_cuts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte vocabulary begin, in plain texts one after the
    other as Latin-1 codes; ``texts``: where those that are not empty begin."""
    kind = _KIND[data]
    run = np.empty(len(data), bool)
    run[1:] = kind[1:] != kind[:-1]
    run[texts] = True
    opens = np.zeros(len(data), bool)
    opens[texts] = True
    # the last white space before anything else is cut off; a space goes with what follows
    after = np.flatnonzero(run & (kind != 3) & ~opens)
    after = after[kind[after - 1] == 3]
    run[after - 1] = True
    run[after[data[after - 1] == _SPACE]] = False
    # 's, 't, 'm, 'd, 're, 've and 'll where a piece begins
    quote = np.flatnonzero(run & (data == _QUOTE))
    quote = quote[quote < len(data) - 1]
    quote = quote[~opens[quote + 1]]
    next_ = data[quote + 1]
    one = quote[np.isin(next_, np.frombuffer(b"stmd", np.uint8))]
    two = quote[np.isin(next_, np.frombuffer(b"rvl", np.uint8)) & (quote < len(data) - 2)]
    two = two[~opens[two + 2]]
    two = two[data[two + 2] == np.where(data[two + 1] == ord("l"), ord("l"), ord("e"))]
    run[one + 1] = run[two + 1] = False
    ends = np.concatenate([one + 2, two + 3])
    run[ends[ends < len(data)]] = True
    return np.flatnonzero(run)


class Pieces:
    """The ids of distinct pieces of up to 16 characters, each two numbers (the first not 0): a table
    with open addresses, in which many pieces are found at once."""

    def __init__(self, bits: int = 12):
        self.table, self.bits, self.size = np.zeros((1 << bits, 4), np.uint64), bits, 0
        self.ids, self.filled = np.zeros(1 << bits, np.uint32), 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mixed(low + high * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the ids of each piece begin in ``ids``, and in the lower 6 bits how many they are; -1 if unknown."""
        slot = self._slots(low, high)
        row = self.table[slot]
        hit = (row[:, 0] == low) & (row[:, 1] == high)
        place = np.where(hit, row[:, 2].astype(np.int64), -1)
        open_ = np.flatnonzero(~hit & (row[:, 0] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            row = self.table[slot[open_]]
            hit = (row[:, 0] == low[open_]) & (row[:, 1] == high[open_])
            place[open_[hit]] = row[hit, 2].astype(np.int64)
            open_ = open_[~hit & (row[:, 0] != 0)]
        return place

    def add(self, low: np.ndarray, high: np.ndarray, ids: list[bytes]) -> None:
        """Take up distinct pieces that are not in the table."""
        raw = np.frombuffer(b"".join(ids), np.uint32)
        counts = np.array([len(i) // 4 for i in ids], np.int64)
        while self.filled + len(raw) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.filled:self.filled + len(raw)] = raw
        place = (self.filled + np.cumsum(counts) - counts) << _COUNT | counts
        self.filled += len(raw)
        self.size += len(ids)
        new = np.stack([low, high, place.astype(np.uint64), np.zeros_like(low)], axis=1)
        if 2 * self.size > 1 << self.bits:
            new = np.concatenate([self.table[self.table[:, 0] != 0], new])
            while 2 * self.size > 1 << self.bits:
                self.bits += 1
            self.table = np.zeros((1 << self.bits, 4), np.uint64)
        slot = self._slots(new[:, 0], new[:, 1])
        while len(new):
            free = self.table[slot, 0] == 0
            self.table[slot[free]] = new[free]
            lost = (self.table[slot, :2] != new[:, :2]).any(axis=1)  # others were there, or came for the same slot
            new, slot = new[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def ids_at(self, place: np.ndarray) -> list[bytes]:
        at, raw = place >> _COUNT, self.ids
        return [raw[a:a + c].tobytes() for a, c in zip(at.tolist(), (place & ((1 << _COUNT) - 1)).tolist())]


class Encoder:
    """Encodes texts with one vocabulary file."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the word vocabulary lower-cases and drops white space, the byte vocabulary keeps texts as they are
        self.kind = "word" if spec.get("normalizer") else "byte"
        vocab = self.tokenizer.get_vocab()
        #: ids that begin a word, and ids after which the next one does
        self.first, self.last = np.zeros(self.size, dtype=bool), np.zeros(self.size, dtype=bool)
        if self.kind == "word":  # the last id of each piece ends a word
            self.last[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        else:  # a space goes with the word after it; other white space stands alone
            self.first[[i for word, i in vocab.items() if word[:1] in _BYTE_BLANKS]] = True
            self.last[[i for word, i in vocab.items() if word and not word.strip(_BYTE_BLANKS)]] = True
        self.mixes = mixed(np.arange(self.size, dtype=np.uint64))
        #: an id mixed for the first places in a word
        self.turned = np.concatenate([mixed(self.mixes + np.uint64(p)) for p in range(_PLACES)])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_pieces, self.old_pieces = Pieces(), Pieces()
        self.cache_pieces = cache_pieces

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of new pieces.  Those of the byte vocabulary go to the library's model as they
        are.  Of the word vocabulary many are encoded in one call with a newline after each, which
        is dropped; white space and anything unexpected goes one by one."""
        if self.kind == "byte":
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(p.replace(" ", "\u0120") if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_LETTERS))]
                     for p in pieces]
            raw = np.array(list(chain.from_iterable(found)), dtype=np.uint32).tobytes()
            ends = np.cumsum([4 * len(f) for f in found]).tolist()
            return list(map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)))
        joint = [p for p in pieces if not p.isspace()]
        texts = ["\n".join(joint[at:at + 256]) + "\n" for at in range(0, len(joint), 256)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if joint else []
        ids = np.array(list(chain.from_iterable(found)), dtype=np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        starts = np.concatenate([[0], ends[:-1]])
        known = {}
        if len(ends) == len(joint):
            raw = ids.tobytes()
            known = dict(zip(joint, map(raw.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist()))))
        return [known[p] if p in known else np.array(self.whole(p), dtype=np.uint32).tobytes() for p in pieces]

    def _remember(self, new: list[str]) -> None:
        """Take distinct pieces that are not in the cache up into it."""
        if 2 * (len(self.cache) + len(new)) > self.cache_pieces:
            self.cache, self.old = {}, self.cache
        # what the old generation has moves up, as do pieces of these texts that were in it a moment ago
        again = {p: ids for p in new if (ids := self.old.get(p)) is not None}
        self.cache.update(again)
        new = [p for p in new if p not in again]
        self.cache.update(zip(new, self._ids_of(new)))

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids (uint32) of each text, with ``end_id`` appended if given."""
        tail = b"" if end_id is None else np.uint32(end_id).tobytes()
        out = [None if _PLAIN.fullmatch(t) else np.frombuffer(np.array(self.whole(t), dtype=np.uint32).tobytes() + tail, np.uint32) for t in texts]
        plain = [i for i, ids in enumerate(out) if ids is None]
        if plain:
            encode = self._by_words if self.kind == "word" else self._by_bytes
            for i, ids in zip(plain, encode([texts[i] for i in plain], end_id)):
                out[i] = ids
        return out

    def _by_words(self, texts: list[str], end_id: int | None) -> list[np.ndarray]:
        cut, get = _SPLIT[self.kind].findall, self.cache.get
        tail = b"" if end_id is None else np.uint32(end_id).tobytes()
        known: list[list[bytes | None]] = []
        gaps: list[tuple[list, int, str]] = []  # pieces not met before: where they go
        for text in texts:
            pieces = cut(text.lower())
            parts = list(map(get, pieces))
            at = -1
            for _ in range(parts.count(None)):
                at = parts.index(None, at + 1)
                gaps.append((parts, at, pieces[at]))
            parts.append(tail)
            known.append(parts)
        if gaps:
            self._remember(list({piece for _, _, piece in gaps}))
            for parts, at, piece in gaps:
                parts[at] = self.cache[piece]
        return [np.frombuffer(b"".join(parts), dtype=np.uint32) for parts in known]

    def _places(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``Pieces.find`` for pieces of at most 16 characters, after which all are known."""
        view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low = view[starts] & _FIRST[np.minimum(sizes, 8)]
        high = view[starts + 8] & _FIRST[np.maximum(sizes - 8, 0)]
        place = self.young_pieces.find(low, high)
        gaps = np.flatnonzero(place < 0)
        while len(gaps):
            ends = starts + sizes
            new = {data[s:e]: i for i, s, e in zip(gaps.tolist(), starts[gaps].tolist(), ends[gaps].tolist())}
            if self.young_pieces.size and len(gaps) < len(starts) and 2 * (self.young_pieces.size + len(new)) > self.cache_pieces:
                # all pieces of these texts are looked up in the new generation
                self.young_pieces, self.old_pieces = Pieces(), self.young_pieces
                gaps = np.arange(len(starts))
                continue
            some = np.fromiter(new.values(), np.int64, len(new))
            held = self.old_pieces.find(low[some], high[some])
            again, unmet = some[held >= 0], some[held < 0]
            texts = [p.decode("latin-1") for p, h in zip(new, held.tolist()) if h < 0]
            order = np.concatenate([again, unmet])
            self.young_pieces.add(low[order], high[order], self.old_pieces.ids_at(held[held >= 0]) + self._ids_of(texts))
            place[gaps] = self.young_pieces.find(low[gaps], high[gaps])
            break
        return place

    def _by_bytes(self, texts: list[str], end_id: int | None) -> list[np.ndarray]:
        codes = [t.encode("latin-1") for t in texts]
        ends = np.cumsum([len(c) for c in codes])
        data = b"".join(codes) + bytes(LONGEST)
        begins = np.concatenate([[0], ends[:-1]])
        starts = byte_cuts(np.frombuffer(data, np.uint8, ends[-1]), begins[begins < ends])
        sizes = np.diff(starts, append=ends[-1])
        short = sizes <= LONGEST
        place, long = np.zeros(len(starts), np.int64), []
        if short.all():
            place = self._places(data, starts, sizes)
        else:
            place[short] = self._places(data, starts[short], sizes[short])
            long = np.flatnonzero(~short).tolist()
            pieces = [data[starts[i]:starts[i] + sizes[i]].decode("latin-1") for i in long]
            new = list(dict.fromkeys(p for p in pieces if p not in self.cache))
            if new:
                known = {p: self.cache[p] for p in pieces if p in self.cache}
                self._remember(new)
                known.update((p, self.cache[p]) for p in new)
                long = [(i, known[p]) for i, p in zip(long, pieces)]
            else:
                long = [(i, self.cache[p]) for i, p in zip(long, pieces)]
        counts = place & ((1 << _COUNT) - 1)
        for i, ids in long:
            counts[i] = len(ids) // 4
        upto = np.cumsum(counts)
        before = upto - counts
        total = int(upto[-1]) if len(upto) else 0
        # places of long pieces are 0 and may run over the end
        ids = self.young_pieces.ids.take(np.repeat((place >> _COUNT) - before, counts) + np.arange(total), mode="clip")
        for i, own in long:
            ids[before[i]:upto[i]] = np.frombuffer(own, np.uint32)
        cuts = np.append(0, upto)[np.searchsorted(starts, ends)]
        if end_id is not None:
            ids = np.insert(ids, cuts, end_id)
            cuts = cuts + np.arange(1, len(cuts) + 1)
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def word_hashes(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash for every word of encoded texts, and the text it is in.
        A word is a run of ids up to the next that begins one."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.concatenate([*texts, np.zeros(0, np.uint16)]).astype(np.int64)
        if not len(ids):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        begins = self.first[ids]
        begins[1:] |= self.last[ids[:-1]]
        begins[(ends - sizes)[sizes > 0]] = True
        at = np.flatnonzero(begins)
        place = np.arange(len(ids)) - np.repeat(at, np.diff(at, append=len(ids)))
        # a sum of mixed ids, each turned by its place in the word
        far = np.flatnonzero(place >= _PLACES)
        turned = self.turned.take(place * self.size + ids, mode="clip")
        if len(far):
            turned[far] = mixed(self.mixes[ids[far]] + place[far].astype(np.uint64))
        h = np.add.reduceat(turned, at)
        words = np.diff(np.searchsorted(at, ends), prepend=0)
        return mixed(h), np.repeat(np.arange(len(texts)), words)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix."""
    x = (x ^ (x >> np.uint64(30)) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)
