"""Token ids of whole texts by the tokenizers library, fast on repeated words.

Byte-level BPE splits a text by a fixed pattern before it merges bytes, and a piece's ids depend
on that piece alone.  Texts are cut at places where that pattern always ends a piece, the library
encodes every distinct unit once, and each text's ids are its units' ids in order.  Units that begin
with such a place whatever stands before them are encoded many in one string; the bytes that each
token stands for tell where a unit's ids end.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tessera.llm._words import ragged, raw, strings

#: Units kept from earlier texts: those that a slice has more than once, and no longer ones (a text
#: without spaces is one unit).  Two generations of this many bound the memory.
CACHE_UNITS, CACHE_LENGTH = 100_000, 64
#: Units that the library encodes at once, and joined in a string.
ENCODED, JOINED = 4096, 256
#: Units whose ids are put together at once.
PART = 1 << 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that start no white-space character: not ASCII white space or control, nor the first byte
#: of a longer character that may be white space (U+0085, U+00A0, U+1680, U+2000.., U+3000).
_SOLID = np.ones(256, dtype=bool)
_SOLID[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Byte positions where a unit starts: each text's start, a space before a visible character,
    a line end after one, and a full stop or comma after an ASCII letter."""
    if not len(data):
        return np.empty(0, np.int64)
    at = np.zeros(len(data), dtype=bool)
    at[:-1] = (data[:-1] == 0x20) & _SOLID[data[1:]]
    at[1:] |= (data[1:] == 0x0A) & _PLAIN[data[:-1]]
    at[1:] |= ((data[1:] == 0x2E) | (data[1:] == 0x2C)) & _LETTER[data[:-1]]
    last = ends[1:][np.diff(ends) > 0] - 1
    at[last] &= data[last] != 0x20  # what follows is another text
    at[ends[:-1][np.diff(ends) > 0]] = True
    return np.flatnonzero(at)


class Encoder:
    """Encodes texts; add_special_tokens is False, nothing is cut off."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        added = self.tokenizer.get_added_tokens_decoder()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each token: a character of a byte-level token stands for one.
        self.width = np.zeros(max(names.values(), default=0) + 1, np.int64)
        for name, i in names.items():
            self.width[i] = len(added[i].content.encode()) if i in added else len(name)
        self.young: dict[str, bytes] = {}  # ids as unsigned 32-bit integers
        self.old: dict[str, bytes] = {}

    def _units(self, column: pa.LargeStringArray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the units, and of each unit where its ids start and how many there are."""
        if len(self.young) > CACHE_UNITS:
            self.old, self.young = self.young, {}
        units = column.to_pylist()
        found = list(map(self.young.get, units))
        new = []
        for i in [i for i, x in enumerate(found) if x is None]:
            x = found[i] = self.old.get(units[i])
            if x is None:
                new.append(i)
            else:
                self.young[units[i]] = x
        sizes = np.array([0 if x is None else len(x) // 4 for x in found], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(filter(None, found)), dtype=np.uint32)
        del found
        if new:
            new = np.array(new)
            more, n = self._new(column, units, new)
            starts[new], sizes[new] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, more])
            for i in new[times[new] > 1].tolist():
                if len(units[i]) <= CACHE_LENGTH:
                    self.young[units[i]] = ids[starts[i] : starts[i] + sizes[i]].tobytes()
        return ids, starts, sizes

    def _new(self, column: pa.LargeStringArray, units: list[str], new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at ``new``, and how many each has."""
        data, ends = raw(column)
        first, size = ends[new], ends[new + 1] - ends[new]
        second = _SOLID[data[np.minimum(first + 1, len(data) - 1)]] & (size > 1)
        # A space before a visible character, or a line end before one and after another.
        space = (data[first] == 0x20) & second
        line = (data[first] == 0x0A) & second & _PLAIN[data[ends[new + 1] - 1]]
        strings, members = [], []
        for kind in (np.flatnonzero(space), np.flatnonzero(line)):
            for k in range(0, len(kind), JOINED):
                members.append(kind[k : k + JOINED])
                strings.append("".join([units[i] for i in new[members[-1]].tolist()]))
        for i in np.flatnonzero(~space & ~line).tolist():
            members.append(np.array([i]))
            strings.append(units[new[i]])
        ids, n = [], []
        step = max(1, ENCODED // JOINED)
        for k in range(0, len(strings), step):
            part = strings[k : k + step]
            for own, e in zip(members[k : k + step], self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                x = np.array(e.ids, dtype=np.uint32)
                if len(own) > 1:
                    wanted, got = np.cumsum(size[own]), np.cumsum(self.width[x])
                    at = np.searchsorted(got, wanted)
                    if len(got) and got[-1] == wanted[-1] and (got[at] == wanted).all():
                        n.append(np.diff(at, prepend=-1))
                    else:  # no byte-level tokens
                        alone = self.tokenizer.encode_batch_fast([units[i] for i in new[own].tolist()], add_special_tokens=False)
                        n.append(np.array([len(e.ids) for e in alone], np.int64))
                        x = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in alone])
                else:
                    n.append(np.array([len(x)]))
                ids.append(x)
        flat, n = np.concatenate(ids), np.concatenate(n)
        # Back from the order of the strings to that of the units.
        order = np.concatenate(members)
        out = np.empty(len(new), np.int64)
        out[order] = n
        begin = np.empty(len(new), np.int64)
        begin[order] = np.cumsum(n) - n
        return flat[ragged(begin, out)], out

    def encode(self, col: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and where each text's ids start (with the end)."""
        data, ends = raw(col)
        at = cuts(data, ends)
        encoded = strings(data, np.append(at, len(data))).dictionary_encode()
        codes = np.asarray(encoded.indices)
        at = np.searchsorted(at, ends)
        flat, first, sizes = self._units(encoded.dictionary, np.bincount(codes))
        del encoded
        starts = np.concatenate([[0], np.cumsum(sizes[codes])])[at]
        # A part of the units at a time: an index for each id is twice as large as the ids.
        out = np.empty(int(starts[-1]) if len(starts) else 0, np.uint32)
        done = 0
        for k in range(0, len(codes), PART):
            c = codes[k : k + PART]
            ids = flat[ragged(first[c], sizes[c])]
            out[done : done + len(ids)] = ids
            done += len(ids)
        odd = self._with_special(col, data)
        return self._replace(col, odd, out, starts) if len(odd) else (out, starts)

    def _with_special(self, col: pa.LargeStringArray, data: np.ndarray) -> list[int]:
        """Texts that hold a special token's string, which the library takes out first."""
        whole = data.tobytes()
        if not any(s.encode() in whole for s in self.special):
            return []
        return [i for i, x in enumerate(col.to_pylist()) if any(s in x for s in self.special)]

    def _replace(self, col, odd, out, starts):
        parts = [out[a:b] for a, b in zip(starts[:-1], starts[1:])]
        for i, e in zip(odd, self.tokenizer.encode_batch([col[i].as_py() for i in odd], add_special_tokens=False)):
            parts[i] = np.array(e.ids, dtype=np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    return np.insert(ids, starts[1:], np.uint32(end_id)), starts + np.arange(len(starts))
