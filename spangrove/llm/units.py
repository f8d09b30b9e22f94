"""Exact BPE encoding through distinct units: a unit is a stretch of text that the tokenizer never merges across.

Words between ASCII white space are such units for the lower-casing word tokenizer, whose pattern drops white space.
For the byte-level tokenizer a unit also holds the white space before its word, since its pattern joins one space to
the next word; a unit then starts only where white space follows a character that is none.
Every distinct unit is encoded by the tokenizers library itself, special strings included, and remembered by its bytes,
up to `cap` units.
"""

from __future__ import annotations

import os

import numpy as np

from .common import SPACE, distinct_spans, word_spans


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file; any other path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


#: Punctuation that no special string or contraction of the tokenizers holds.
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,!?;:%$&*#")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def mark_cuts(buf: np.ndarray) -> np.ndarray:
    """Where punctuation follows a Latin letter: both tokenizers' patterns always end a piece there."""
    at = np.flatnonzero(_MARK[buf])
    at = at[at > 0]
    a, b = buf[at - 1], buf[np.maximum(at - 2, 0)]
    return at[_LETTER[a] | (b == 0xC3) & (a >= 0x80) & (a != 0x97) & (a != 0xB7) & (at > 1)]


def spaced_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of white space and the word after it; together they cover each row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = SPACE[buf]
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    at = np.flatnonzero(first)
    # White space beyond ASCII before this one belongs to the same run for the tokenizer.
    a = buf[np.maximum(at - 1, 0)]
    odd = np.flatnonzero((a >= 128) & (at > 0))
    if len(odd):
        p = at[odd]
        b, c = buf[np.maximum(p - 2, 0)], buf[np.maximum(p - 3, 0)]
        last = a[odd]
        wide = (b == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (c == 0xE2) & ((b == 0x80) | (b == 0x81)) | (c == 0xE1) & (b == 0x9A) | (c == 0xE3) & (b == 0x80)
        first[p[wide]] = False
    first[offsets[:-1][offsets[:-1] < n]] = True
    first[mark_cuts(buf)] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], n)


_memos: dict[tuple, UnitMemo] = {}


def shared_memo(tokenizer: str, spaced: bool) -> UnitMemo:
    """The memo of this worker process; tasks that run after each other go on with it."""
    key = tokenizer, spaced
    if key not in _memos:
        _memos[key] = UnitMemo(tokenizer, spaced)
    if _memos[key].full():
        _memos[key].clear()
    return _memos[key]


class UnitMemo:
    def __init__(self, tokenizer: str, spaced: bool, cap: int = 1_000_000):
        self.tok, self.spaced, self.cap = load_tokenizer(tokenizer), spaced, cap
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        #: Ids that begin a word after a space, or end a word.
        self.edge = np.array([x.startswith("Ġ") if spaced else x.endswith("</w>") for x in names])
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.lens = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def full(self) -> bool:
        return len(self.slot) > self.cap

    def spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return spaced_spans(buf, offsets) if self.spaced else word_spans(buf, offsets, mark_cuts(buf))

    def slots(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The slot of each unit; new ones are encoded."""
        if not len(s):
            return np.zeros(0, np.int64)
        keys, back = distinct_spans(buf, s, e)
        get = self.slot.get
        found = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(found < 0)
        if len(new):
            names = [keys[i] for i in new.tolist()]
            base = len(self.slot)
            order, lens, flat = self.encode([x.decode("utf-8", "replace") for x in names])
            total = len(flat)
            while base + len(new) > len(self.lens):
                self.lens, self.at = np.append(self.lens, np.zeros_like(self.lens)), np.append(self.at, np.zeros_like(self.at))
            while self.used + total > len(self.flat):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.flat[self.used : self.used + total] = flat
            self.lens[base : base + len(new)] = lens
            self.at[base : base + len(new)] = self.used + np.cumsum(lens) - lens
            self.used += total
            self.slot.update(zip([names[i] for i in order.tolist()], range(base, base + len(new)), strict=True))
            found[new[order]] = np.arange(base, base + len(new))
        return found[back]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which units were encoded, and by it their numbers of ids and all ids.

        Units that are a word of letters (after one space, if spaced) are encoded in one text: the library ends a piece
        at each of them, and the ids that begin (or end) a word tell them apart. Where their number does not come out,
        and for all other units, each is a text of its own.
        """
        word = (lambda u: u[:1] == " " and u[1:].isalpha()) if self.spaced else str.isalpha
        simple = [i for i, u in enumerate(units) if word(u)]
        rest = [i for i, u in enumerate(units) if not word(u)]
        order: list[int] = []
        lens: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        for at in range(0, len(simple), 1024):
            some = simple[at : at + 1024]
            text = ("" if self.spaced else " ").join([units[i] for i in some])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            edge = np.flatnonzero(self.edge[ids])
            if len(edge) != len(some):
                rest += some
                continue
            bounds = np.append(edge, len(ids)) if self.spaced else np.append(-1, edge) + 1
            order += some
            lens.append(np.diff(bounds))
            flat.append(ids)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            coded = [x.ids for x in self.tok.encode_batch_fast([units[i] for i in some], add_special_tokens=False)]
            order += some
            lens.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            flat.append(np.fromiter((x for i in coded for x in i), np.int32, int(lens[-1].sum())))
        none = [np.zeros(0, np.int64)]
        return np.array(order, np.int64), np.concatenate(lens or none).astype(np.int64), np.concatenate(flat or none).astype(np.int32)

    def encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        s, e = self.spans(buf, bounds)
        slots = self.slots(buf, s, e)
        ids, ends = self.ids(slots), np.append(0, np.cumsum(self.lens[slots]))[np.searchsorted(s, bounds)].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of all units, one after another."""
        lens = self.lens[slots].astype(np.int64)
        ends = np.cumsum(lens)
        if not len(ends):
            return np.zeros(0, np.int32)
        shift = np.repeat(self.at[slots] - (ends - lens), lens)
        return self.flat[np.arange(ends[-1]) + shift]
