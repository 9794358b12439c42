"""Cutting texts for byte-level BPE, so that equal pieces are encoded once.

The split pattern of the byte-level vocabularies attaches a single space to what follows it and makes a single line end a token of
its own. A text may therefore be cut around a line end and before a space that stand between other characters than white space,
and the pieces encoded apart. Where white space runs together, the text is left whole around the run.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with other white space than single spaces and line ends between other characters (for RE2, whose \s knows ASCII alone).
_UNEVEN = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = re.compile(r"\s (?:\s|\Z)")
#: Characters that make one word of their own behind letters.
_MARKS = ".,;:!?#*$%&|<>()-"
#: Distinct pieces in the younger half of the memory; when it is full it becomes the older half, and that is dropped.
MOST = 250_000
#: Characters and bytes of ids in the younger half of the memory, which makes long pieces count: it is full beyond either bound.
HELD = 16 << 20
#: Bytes of text whose new pieces are encoded together, and ids that are handed out at a time (more only for one text).
SLICE, IDS = 8 << 20, 1 << 19


def units(text: str) -> list[str]:
    """The text cut at the line ends that stand between other characters than white space."""
    out: list[str] = []
    for line in text.split("\n"):
        if out and (not line or line[0].isspace() or not out[-1] or out[-1][-1].isspace()):
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) of ``flat`` in a row."""
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return flat[at]


class _Half:
    """Pieces with the place of their ids in one array. A piece behind a space is known without it (1), others as they are (0)."""

    def __init__(self):
        self.known: tuple[dict, dict] = ({}, {})
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = 0

    def __len__(self) -> int:
        return len(self.start)

    def add(self, kind: int, pieces: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.known[kind].update(zip(pieces, range(len(self), len(self) + len(pieces))))
        self.chars += sum(map(len, pieces))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))

    def held(self) -> int:
        return self.chars + self.flat.nbytes

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.start[slots], self.size[slots]), self.size[slots]


class PieceCache:
    """The ids of texts. ``encode(pieces)`` gives the ids of all pieces in a row and the number of each. A text that holds one of
    ``special`` is encoded whole. ``most`` and ``slice_bytes`` stand for MOST and SLICE."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: tuple[str, ...] = (), most: int | None = None, slice_bytes: int | None = None):
        self.encode, self.special, self.most, self.slice_bytes, self.young, self.old = encode, special, most, slice_bytes, _Half(), _Half()

    def _learn(self, kind: int, new: list[str]) -> None:
        """Put ``new`` (distinct, none of them there) into the younger half."""
        young, old = self.young, self.old
        mine, theirs = young.known[kind], old.known[kind]
        if theirs:
            back = [x for x in new if x in theirs]
            if back:
                young.add(kind, back, *old.ids(np.array([theirs[x] for x in back])))
                new = [x for x in new if x not in theirs]
        plain, marked = [], []
        for x in new:
            body = x.rstrip(_MARKS)
            if len(body) == len(x) or not body.isalpha():
                plain.append(x)
            else:
                marked.append((x, body, x[len(body):]))
        if plain:
            young.add(kind, plain, *self.encode([" " + x for x in plain] if kind else plain))
        if marked:
            bodies, tails = self._slots(kind, [b for _, b, _ in marked]), self._slots(0, [t for _, _, t in marked])
            flat, size = young.ids(np.stack((bodies, tails), 1).ravel())
            young.add(kind, [x for x, _, _ in marked], flat, size.reshape(-1, 2).sum(1))

    def _slots(self, kind: int, pieces: list[str]) -> np.ndarray:
        """The places of ``pieces`` in the younger half, which learns those that it has not."""
        known = self.young.known[kind]
        slots = list(map(known.get, pieces))
        missing = [k for k, v in enumerate(slots) if v is None]
        if missing:
            self._learn(kind, list(dict.fromkeys([pieces[k] for k in missing])))
            for k in missing:
                slots[k] = known[pieces[k]]
        return np.array(slots, np.int64)

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pieces of all texts in a row, and how many pieces each has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        d = lists.flatten().dictionary_encode()
        code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = d.dictionary.to_numpy(zero_copy_only=False)
        line = np.flatnonzero(values == "\n")
        head = np.zeros(len(code) + 1, bool)
        head[np.cumsum(count) - count] = True
        if len(line):
            ends = code == line[0]
            head[:-1] |= ends
            head[1:] |= ends
        key = 2 * code + ~head[:-1]
        used = np.zeros(2 * len(values), bool)
        used[key] = True
        slot = np.zeros(len(used), np.int64)
        for kind in (0, 1):
            at = np.flatnonzero(used[kind::2])
            slot[2 * at + kind] = self._slots(kind, values[at].tolist())
        return slot[key], count

    def _uneven(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = []
        for t in texts:
            row: list[tuple[int, str]] = []
            for n, u in enumerate([t] if any(s in t for s in self.special) else units(t)):
                if n:
                    row.append((0, "\n"))
                words = [u] if _RUN.search(u) or any(s in u for s in self.special) else u.split(" ")
                row.append((0, words[0]))
                row += [(1, w) for w in words[1:]]
            rows.append(row)
        kinds = np.array([k for row in rows for k, _ in row], np.int64)
        slots = np.zeros(len(kinds), np.int64)
        for kind in (0, 1):
            slots[kinds == kind] = self._slots(kind, [x for row in rows for k, x in row if k == kind])
        return slots, np.array([len(r) for r in rows], np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pieces of all texts in a row, and how many pieces each has."""
        if len(self.young) > (self.most or MOST) or self.young.held() > HELD:
            self.old, self.young = self.young, _Half()
        odd = pc.match_substring_regex(texts, _UNEVEN)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._even(texts)
        parts = [(np.flatnonzero(odd), *self._uneven(texts.filter(pa.array(odd)).to_pylist()))]
        if not odd.all():
            parts.append((np.flatnonzero(~odd), *self._even(texts.filter(pa.array(~odd)))))
        start, count, base = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for rows, slots, n in parts:
            count[rows], start[rows] = n, base + np.cumsum(n) - n
            base += len(slots)
        return gather(np.concatenate([slots for _, slots, _ in parts]), start, count), count

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """In runs [a, b) of the texts (no nulls): the ids of all in a row, and the number of each."""
        texts = texts.cast(pa.large_string())
        full = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(full, (full[a - 1] if a else 0) + (self.slice_bytes or SLICE), "right")))
            slots, count = self._cut(texts.slice(a, b - a))
            pieces = np.concatenate(([0], np.cumsum(count)))
            ids = np.concatenate(([0], np.cumsum(self.young.size[slots])))[pieces]
            x = 0
            while x < b - a:
                y = max(x + 1, int(np.searchsorted(ids, ids[x] + IDS, "right")) - 1)
                yield a + x, a + y, self.young.ids(slots[pieces[x] : pieces[y]])[0], np.diff(ids[x : y + 1])
                x = y
            a = b
