"""Token ids of whole texts by a word-level tokenizer file, inside tasks.

The tokenizer's own rules drop white space and never join what white space
separates, so the ids of a text are the ids of its words in a row.  Texts are cut
into units with numpy, a megabyte at a time: a plain word is its letters and the
signs after them, any other word is one unit.  A table of the units met so far, keyed
by their bytes, gives each unit a row of one flat array of ids; the tokenizers library
is asked for new units only.  The table holds at most `limit` units (about 150
bytes each) and starts anew when it is full.
"""

from __future__ import annotations

import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The first bytes of combining marks that may join an ASCII letter.
_MARKS = (b"\xcc", b"\xcd")
_GROUP_BYTES = 1 << 20
_STEMS = 200
LETTER, SIGN, SPACE = 1, 2, 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = LETTER
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = SIGN
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
#: Second bytes of the letters from À to ÿ after 0xC3 (without × and ÷).
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Units up to so many bytes are keys of three 64-bit words.
_KEY = 24
PAD = _KEY + 8
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0xD6E8FEB86659FD93)]
_EMPTY = np.int32(-1)


def classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte: a-z and the letters from À to ÿ, ASCII signs, white space, others."""
    kind = _CLASS[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]])
    kind[latin] = kind[latin + 1] = LETTER
    return kind


class _Table:
    """Rows of units by their bytes: open addressing, searched and filled as arrays."""

    def __init__(self, slots: int):
        self.slots = np.full(slots, _EMPTY, dtype=np.int32)
        self.keys = np.empty((4, 0), dtype=np.uint64)
        self.n = 0

    @staticmethod
    def mixed(keys: np.ndarray) -> np.ndarray:
        h = keys[0] * _MIX[0]
        for k in range(1, 4):
            h ^= h >> np.uint64(31)
            h = (h + keys[k]) * _MIX[k]
        return h ^ (h >> np.uint64(29))

    def find(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for new ones."""
        rows = np.full(len(mixed), _EMPTY, dtype=np.int32)
        last = len(self.slots) - 1
        at, todo = (mixed & np.uint64(last)).astype(np.int64), np.arange(len(mixed))
        while len(todo):
            found = self.slots[at]
            held = found >= 0
            same = held & (self.keys[:, np.where(held, found, 0)] == keys[:, todo]).all(axis=0) \
                if self.n else held
            rows[todo[same]] = found[same]
            on = held & ~same
            todo, at = todo[on], (at[on] + 1) & last
        return rows

    def add(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Rows of distinct new keys."""
        rows = np.arange(self.n, self.n + len(mixed), dtype=np.int32)
        if self.n + len(mixed) > self.keys.shape[1]:
            more = np.empty((4, 2 * (self.n + len(mixed))), dtype=np.uint64)
            more[:, :self.n] = self.keys[:, :self.n]
            self.keys = more
        self.keys[:, rows] = keys
        self.n += len(mixed)
        while 2 * self.n > len(self.slots):  # all rows anew in a table twice as large
            self.slots = np.full(2 * len(self.slots), _EMPTY, dtype=np.int32)
            rows = np.arange(self.n, dtype=np.int32)
            mixed = self.mixed(self.keys[:, :self.n])
        last = len(self.slots) - 1
        at, left = (mixed & np.uint64(last)).astype(np.int64), rows
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            where, first = np.unique(at[free], return_index=True)
            self.slots[where] = left[free[first]]
            on = np.ones(len(left), dtype=bool)
            on[free[first]] = False
            left, at = left[on], (at[on] + 1) & last
        return np.arange(self.n - keys.shape[1], self.n, dtype=np.int32)


class UnitRows:
    """Row numbers of units of bytes: a table for short ones, a dictionary for the rest.

    Holds at most `limit` units, unless one call brings more."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.table = _Table(1 << 16)
        self.unit_rows = np.empty(0, dtype=np.int64)
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self.table.n + len(self.long)

    @staticmethod
    def _keys(raw: bytes, us: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        keys = np.empty((4, len(us)), dtype=np.uint64)
        for k in range(3):
            keys[k] = words[us + 8 * k] & _MASK[np.clip(sizes - 8 * k, 0, 8)]
        keys[3] = sizes
        return keys

    def find(self, raw: bytes, us: np.ndarray, ue: np.ndarray, learn, forget) -> np.ndarray:
        """The row of each unit raw[us:ue]; `raw` ends with PAD further bytes.

        `learn(units, at)` gives the rows of new units (`at`: one place of each);
        `forget()` drops all rows when the limit is reached."""
        sizes = ue - us
        rows = np.empty(len(us), dtype=np.int64)
        short = np.flatnonzero(sizes <= _KEY)
        keys = self._keys(raw, us[short], sizes[short])
        mixed = self.table.mixed(keys)
        found = self.table.find(keys, mixed)
        long = np.flatnonzero(sizes > _KEY).tolist()
        words = [raw[us[k]:ue[k]] for k in long]
        where = {w: k for w, k in zip(words, long) if w not in self.long}
        new = np.flatnonzero(found < 0)
        _, first, back = np.unique(mixed[new], return_index=True, return_inverse=True)
        if len(self) and len(self) + len(first) + len(where) > self.limit:
            self.clear()
            forget()
            return self.find(raw, us, ue, learn, forget)
        if len(new) and not (keys[:, new] == keys[:, new[first[back]]]).all():
            # different units of one hash: told apart by their bytes
            _, first, back = np.unique(keys[:, new], axis=1, return_index=True, return_inverse=True)
            back = back.ravel()
        one = new[first]
        if len(one) or where:
            at = np.array([*short[one].tolist(), *where.values()], dtype=np.int64)
            learned = learn([raw[i:j] for i, j in zip(us[at].tolist(), ue[at].tolist())], at)
            if len(one):
                self.unit_rows = np.concatenate([self.unit_rows, learned[:len(one)]])
                found[new] = self.table.add(keys[:, one], mixed[one])[back]
            self.long.update(zip(where, learned[len(one):].tolist()))
        if len(short):
            rows[short] = self.unit_rows[found]
        rows[long] = [self.long[w] for w in words]
        return rows


class WordIds:
    """`encode(texts)` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = UnitRows(limit)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.is_end = np.zeros(self.size, dtype=bool)
        for token, i in vocab.items():
            self.is_end[i] = token.endswith("</w>")
        self.special = [t.content.lower().encode() for t in
                        self.tokenizer.get_added_tokens_decoder().values()]
        self.lean = self._lean(path)
        self._clear()

    def _lean(self, path: str):
        """The same merges without normalising and pattern splitting, for words
        that are plain lower-case letters; the full tokenizer if a probe differs."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        lean = Tokenizer.from_file(path)
        lean.normalizer = normalizers.Sequence([])
        lean.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the abcdefghijklmnopqrstuvwxyz ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ licence été"
        same = (lean.encode(probe, add_special_tokens=False).ids
                == self.tokenizer.encode(probe, add_special_tokens=False).ids)
        return lean if same else self.tokenizer

    # --- the store ---

    def _clear(self) -> None:
        self.start, self.count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.ids, self.held, self.rows = np.empty(0, dtype="<u4"), 0, 0

    def _append(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Add rows of the given numbers of ids."""
        n, m = self.rows + len(sizes), self.held + len(ids)
        if n > len(self.start):
            self.start, self.count = (np.resize(x, 2 * n) for x in (self.start, self.count))
        if m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * m)
        self.start[self.rows:n] = self.held + np.cumsum(sizes) - sizes
        self.count[self.rows:n] = sizes
        self.ids[self.held:m] = ids
        self.rows, self.held = n, m

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of plain stems; the word ends of a list are checked."""
        lists = [stems[i:i + _STEMS] for i in range(0, len(stems), _STEMS)]
        done = self.lean.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False)
        sizes, parts = [], []
        for some, e in zip(lists, done):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                sizes.append(np.diff(ends, prepend=0))
                parts.append(ids)
            else:
                single = [self._one(x) for x in some]
                sizes.append(np.array([len(x) for x in single]))
                parts += single
        return np.concatenate(sizes), np.concatenate(parts)

    def _learn(self, units: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Rows of new units; those that are plain letters are encoded together."""
        words = b" ".join(units).decode().split(" ")
        rows = np.empty(len(words), dtype=np.int64)
        for kind in (True, False):
            at = np.flatnonzero(plain == kind)
            some = [words[k] for k in at.tolist()]
            rows[at] = self.rows + np.arange(len(at))
            if some and kind:
                self._append(*self._stems([w.lower() for w in some]))
            elif some:
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                self._append(np.array([len(x) for x in ids], dtype=np.int64),
                             np.array([i for x in ids for i in x], dtype="<u4"))
        return rows

    # --- units ---

    @staticmethod
    def _units(data: np.ndarray):
        """Start, end and plainness of the units of white-space-separated bytes."""
        kind = classes(data)
        space = kind == SPACE
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        letter, sign = kind == LETTER, kind == SIGN

        def inside(flags):
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
            return total[ends] - total[starts]

        back = np.zeros(len(data), dtype=bool)
        back[1:] = sign[:-1] & letter[1:]
        letters = inside(letter)
        plain = (inside(kind == 0) == 0) & (inside(back) == 0) & letter[starts]
        cut = np.where(plain, starts + letters, ends)
        tail = cut < ends
        at = np.cumsum(1 + tail) - 1 - tail
        us, ue = np.empty((2, len(starts) + int(tail.sum())), dtype=np.int64)
        stem = np.zeros(len(us), dtype=bool)
        us[at], ue[at], stem[at] = starts, cut, plain
        us[at[tail] + 1], ue[at[tail] + 1] = cut[tail], ends[tail]
        return us, ue, stem

    # --- texts ---

    def _group(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece of text."""
        raw = b" ".join([*pieces, b" " * PAD])
        data = np.frombuffer(raw, np.uint8)
        us, ue, stem = self._units(data)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        if not len(us):
            return [np.empty(0, dtype="<u4")] * len(pieces)
        rows = self.known.find(raw, us, ue, lambda units, at: self._learn(units, stem[at]),
                               self._clear)
        n = self.count[rows]
        total = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[rows] - total + n, n) + np.arange(total[-1])]
        until = np.concatenate([[0], total])[np.searchsorted(us, ends)]
        return np.split(ids, until[:-1])

    def _pieces(self, text: bytes) -> list[bytes]:
        """A text for `_group`, cut at white space if it is long."""
        if not any(m in text for m in _MARKS):
            text = text.lower()
        out, at = [], 0
        while len(text) - at > _GROUP_BYTES:
            cut = max(text.rfind(s, at, at + _GROUP_BYTES) for s in (b" ", b"\n", b"\t"))
            if cut <= at:
                nearest = [k for s in (b" ", b"\n", b"\t") if (k := text.find(s, at + 1)) > 0]
                cut = min(nearest, default=len(text))
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some: list[tuple[int, bytes]] = []
        held = 0

        def flush():
            for (k, _), ids in zip(some, self._group([p for _, p in some])):
                out[k] += ids.tobytes()
            some.clear()

        for k, t in enumerate(texts):
            if b"<|" in t and any(s in t.lower() for s in self.special):
                out[k] = self._one(t.decode()).tobytes()
                continue
            for piece in self._pieces(t):
                some.append((k, piece))
                held += len(piece)
                if held >= _GROUP_BYTES:
                    flush()
                    held = 0
        if some:
            flush()
        return out


_OPEN: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The encoder of this worker process."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
