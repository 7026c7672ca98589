"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once.

A byte-level BPE with the usual pre-tokeniser never merges across a single
space or newline between two visible characters, so a text is cut there and
the ids of its pieces, put together, are the ids of the text.  The library
encodes each piece a worker meets for the first time; a hash table of pieces,
compared byte by byte, gives the ids of all later ones.  Places where the cut
would not be safe (runs of white space, control characters, Unicode spaces) are
not cut: the longer piece goes to the library as it is.  Added tokens whose
literals the library matches are pieces of their own, and what stands on either
side of one is cut like a text of its own, as the library does.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

from .textscan import RUN, U, lookup, mix, span_hash

VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True
VISIBLE[0x80:] = True
LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP[[x for x in b"!#$%&()*,-./:;<=>?@[]^_{|}~"]] = True
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Pieces that a worker's table holds at most, some 40 MB; a full table starts anew.
MOST = 1 << 19


def _unicode_spaces(d: np.ndarray) -> np.ndarray:
    """Positions of all bytes of U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    lead = np.flatnonzero((d == 0xC2) | ((d >= 0xE1) & (d <= 0xE3)))
    if not lead.size:
        return lead
    pad = np.concatenate([d, np.zeros(2, np.uint8)])
    a, b, c = pad[lead], pad[lead + 1], pad[lead + 2]
    two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
    three = lead[
        ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
        | ((a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    ]
    return np.concatenate([two, two + 1, three, three + 1, three + 2])


def pieces(d: np.ndarray, offs: np.ndarray, literal: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end of the pieces that are encoded on their own, and which bytes are visible; no piece crosses the edge of a row or of a literal (their starts and ends)."""
    n = len(d)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, bool)
    seen = lookup(VISIBLE, d)
    seen[_unicode_spaces(d)] = False
    left, right = np.zeros(n, bool), np.zeros(n, bool)
    left[1:], right[:-1] = seen[:-1], seen[1:]
    lo, hi = literal or (offs[:0], offs[:0])
    edge = np.concatenate([offs, lo, hi])
    edge = edge[(edge > 0) & (edge < n)]
    left[edge] = right[edge - 1] = False
    alone = left & right
    cut = alone & (d == 0x20)
    line = np.flatnonzero(alone & (d == 0x0A))
    cut[line] = cut[line + 1] = True
    cut[1:] |= lookup(LETTER, d[:-1]) & lookup(STOP, d[1:])
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        cut[a:b] = False
    cut[0] = cut[edge] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n), seen


class Encoder:
    """added: match the literals of all added tokens, as the library does by default; otherwise those of special tokens are plain text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = not added
        known = {i: t for i, t in self.lib.get_added_tokens_decoder().items() if added or not t.special}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized or any(c.isspace() for c in t.content) for t in known.values()):
            raise ValueError("an added token takes in or depends on what is around it: this tokenizer file can't be used word by word")
        self.literals = sorted((t.content.encode() for t in known.values() if t.content), key=len, reverse=True)
        self.literal = re.compile(b"|".join(map(re.escape, self.literals)))
        vocab = self.lib.get_vocab()
        self.size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # byte-level: a character of the vocabulary is a byte
        for i, t in known.items():
            self.n_bytes[i] = len(t.content.encode())
        self._clear(1 << 16)

    def _clear(self, room: int) -> None:
        self.table = self._empty(room)
        self.flat, self.used, self.n = np.zeros(1 << 16, np.int32), 0, 0
        self.bytes, self.stored = np.zeros(1 << 16, np.uint8), 0  # of the pieces over 16 bytes

    def _empty(self, room: int) -> dict[str, np.ndarray]:
        """A slot: the piece's hash, first and last eight bytes, size, and where the bytes of a long one are; its ids' place and number (-1: free)."""
        return {c: np.full(room, -1 if c == "ids" else 0, t) for c, t in (("key", np.uint64), ("head", np.uint64), ("tail", np.uint64), ("size", np.int64), ("from", np.int64), ("at", np.int64), ("ids", np.int32))}

    def _equal(self, d: np.ndarray, start: np.ndarray, size: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Whether the bytes of long pieces are those stored."""
        out = np.ones(len(start), bool)
        short = np.flatnonzero(size <= 4096)
        for lo in range(0, len(short), 256):
            k = short[lo : lo + 256]
            ends = np.cumsum(size[k])
            each = np.arange(ends[-1])
            same = d[np.repeat(start[k] - (ends - size[k]), size[k]) + each] == self.bytes[np.repeat(stored[k] - (ends - size[k]), size[k]) + each]
            out[k] = np.logical_and.reduceat(same, ends - size[k])
        for k in np.flatnonzero(size > 4096).tolist():
            out[k] = np.array_equal(d[start[k] : start[k] + size[k]], self.bytes[stored[k] : stored[k] + size[k]])
        return out

    def _find(self, piece: dict[str, np.ndarray], d: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Slot of each piece, or -1."""
        t = self.table
        mask = len(t["key"]) - 1
        slot, todo, p = np.full(len(start), -1, np.int64), np.arange(len(start)), (piece["key"] & U(mask)).astype(np.int64)
        while todo.size:
            full = t["ids"][p] >= 0
            same = full.copy()
            for c in ("key", "size", "head", "tail"):
                same &= t[c][p] == piece[c][todo]
            long = np.flatnonzero(same & (piece["size"][todo] > 16))
            if long.size:
                k = todo[long]
                same[long] = self._equal(d, start[k], piece["size"][k], t["from"][p[long]])
            slot[todo[same]] = p[same]
            go = full & ~same
            todo, p = todo[go], (p[go] + 1) & mask
        return slot

    def _insert(self, new: dict[str, np.ndarray]) -> None:
        count = len(new["key"])
        if (self.n + count) * 2 > len(self.table["key"]):
            old = np.flatnonzero(self.table["ids"] >= 0)
            room = len(self.table["key"])
            while (self.n + count) * 2 > room:
                room *= 2
            new = {c: np.concatenate([self.table[c][old], new[c]]) for c in new}
            self.table, self.n, count = self._empty(room), 0, len(new["key"])
        mask = len(self.table["key"]) - 1
        todo, p = np.arange(count), (new["key"] & U(mask)).astype(np.int64)
        while todo.size:
            free = self.table["ids"][p] < 0
            _, first = np.unique(p[free], return_index=True)
            won = np.flatnonzero(free)[first]
            for c, v in new.items():
                self.table[c][p[won]] = v[todo[won]]
            rest = np.ones(todo.size, bool)
            rest[won] = False
            todo, p = todo[rest], p[rest]
            p = np.where(self.table["ids"][p] >= 0, (p + 1) & mask, p)
        self.n += count

    def _distinct(self, raw: bytes, start: np.ndarray, end: np.ndarray, piece: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
        """Of the pieces ``at``, one of each: up to 16 bytes are told apart by both ends and the size, longer ones by all their bytes."""
        short = at[piece["size"][at] <= 16]
        order = short[np.lexsort([piece[c][short] for c in ("size", "tail", "head")])]
        if order.size:
            differs = np.ones(order.size, bool)
            differs[1:] = np.logical_or.reduce([piece[c][order][1:] != piece[c][order][:-1] for c in ("size", "tail", "head")])
            order = order[differs]
        seen: dict[bytes, int] = {}
        for k in at[piece["size"][at] > 16].tolist():
            seen.setdefault(raw[start[k] : end[k]], k)
        return np.concatenate([order, np.fromiter(seen.values(), np.int64, len(seen))]).astype(np.int64)

    def _joined(self, words: list[bytes], lead: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of words that the library sees a thousand at a time; lead: ids before each that are not its own."""
        text = [(b"\n" if lead else b"").join([b"", *words[i : i + 1000]]).decode() for i in range(0, len(words), 1000)]
        got = np.concatenate([np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast(text, add_special_tokens=False)] or [np.zeros(0, np.int32)])
        end, want = np.cumsum(self.n_bytes[got]), np.cumsum([len(w) + lead for w in words], dtype=np.int64)
        upto = np.searchsorted(end, want) + 1
        if not np.array_equal(end[upto - 1], want):
            raise ValueError("the vocabulary merges across a space: this tokenizer file can't be used word by word")
        n = np.diff(upto, prepend=0)
        return (np.delete(got, upto - n), n - 1) if lead else (got, n)

    def _library(self, raw: bytes, start: np.ndarray, end: np.ndarray, d: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, all ids in that order, and how many each has."""
        closed = seen[end - 1]
        spaced = closed & (d[start] == 0x20) & (end - start > 1) & seen[np.minimum(start + 1, len(d) - 1)]
        plain = closed & seen[start]
        kinds = [np.flatnonzero(x) for x in (spaced, plain, ~spaced & ~plain)]
        words = [[raw[a:b] for a, b in zip(start[k].tolist(), end[k].tolist(), strict=True)] for k in kinds]
        one = [np.array(e.ids, np.int32) for e in self.lib.encode_batch_fast([w.decode() for w in words[2]], add_special_tokens=False)]
        done = [self._joined(words[0], 0), self._joined(words[1], 1), (np.concatenate([np.zeros(0, np.int32), *one]), np.array([len(x) for x in one], np.int64))]
        return np.concatenate(kinds), np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])

    def _literals(self, raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Starts and ends of the added tokens' literals in each row: the leftmost first, and the longest there."""
        if not any(x in raw for x in self.literals):
            return None
        found = [m.span() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True) for m in self.literal.finditer(raw, a, b)]
        at = np.array(found, np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]

    def _spaces(self, d: np.ndarray) -> list[int]:
        """Bounds of runs of about ``RUN`` bytes: a space between two ASCII letters is always a cut, and never inside a literal."""
        out = [0]
        while len(d) - out[-1] > RUN:
            at, size = out[-1] + RUN // 2, RUN
            while at + 1 < len(d):
                w = d[at - 1 : at + size + 1]
                found = np.flatnonzero(lookup(LETTER, w[:-2]) & (w[1:-1] == 0x20) & lookup(LETTER, w[2:]))
                if found.size:
                    break
                at, size = at + size, 2 * size
            if at + 1 >= len(d):
                break
            out.append(at + int(found[0]))
        return [*out, len(d)]

    def encode(self, d: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows in a row, and the row ends in them."""
        if len(offs) == 2 and len(d) > RUN:  # one long text
            cuts = self._spaces(d)
            if len(cuts) > 2:
                ids = np.concatenate([self._encode(d[a:z], np.array([0, z - a]))[0] for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
                return ids, np.array([len(ids)], np.int64)
        return self._encode(d, offs)

    def _encode(self, d: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = d.tobytes()
        start, end, seen = pieces(d, offs, self._literals(raw, offs))
        rows = len(offs) - 1
        if not start.size:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        size = end - start
        pad = np.concatenate([d, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(d), "<u8", pad, strides=(1,))
        ends_in = MASK[np.minimum(size, 8)]
        piece = {"size": size, "head": eight[start] & ends_in, "tail": eight[np.maximum(end - 8, start)] & ends_in}
        piece["key"] = mix(piece["head"] + U(0x9FB21C651E98DF25) * piece["tail"] + size.astype(np.uint64))
        long = np.flatnonzero(size > 16)
        if long.size:
            piece["key"][long] = span_hash(d, start[long], end[long])
        slot = self._find(piece, d, start)
        miss = np.flatnonzero(slot < 0)
        if miss.size:
            if self.n and self.n + miss.size > MOST:
                self._clear(1 << 16)
                miss = np.arange(len(start))
            new = self._distinct(raw, start, end, piece, miss)
            order, got, n = self._library(raw, start[new], end[new], d, seen)
            new = new[order]
            while self.used + got.size > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[self.used : self.used + got.size] = got
            kept = np.where(size[new] > 16, size[new], 0)
            place = self.stored + np.cumsum(kept) - kept
            while self.stored + kept.sum() > len(self.bytes):
                self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes), np.uint8)])
            for k, q in zip(new[kept > 0].tolist(), place[kept > 0].tolist(), strict=True):
                self.bytes[q : q + size[k]] = d[start[k] : end[k]]
            self.stored += int(kept.sum())
            self._insert({**{c: v[new] for c, v in piece.items()}, "from": place, "at": self.used + np.cumsum(n, dtype=np.int64) - n, "ids": n.astype(np.int32)})
            self.used += got.size
            slot = self._find(piece, d, start)
        n = self.table["ids"][slot].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.table["at"][slot] - (ends - n), n) + np.arange(ends[-1])]
        upto = np.searchsorted(start, offs[1:], "left")
        return ids, np.where(upto > 0, ends[np.maximum(upto - 1, 0)], 0)


@cache
def encoder(path: str, added: bool = False) -> Encoder:
    """One per worker process."""
    return Encoder(path, added)
