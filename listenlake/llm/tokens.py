"""Whole texts to token ids, exactly as the tokenizers library encodes them.

``word_bpe_49k.json`` drops white space and never joins across it, so a text's ids are those of
its pieces between spaces or line ends, one after the other. A piece of plain Latin letters
followed by plain marks is, to this tokenizer, one word and one run of marks. So a text is cut
into such runs with numpy, every run gets a 128-bit hash, and ids known for that hash are
gathered. Runs not met before go through the library, many at a time. All other pieces (digits,
other scripts, apostrophes inside words, special tokens) go through the library whole.

Each Python worker remembers a bounded number of runs. Tests compare with plain encoding.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MEMORY_BITS = 21  # a worker remembers half of 2**21 runs, then starts anew
WORDS_AT_ONCE = 400
BUFFER = 1 << 19  # bytes of text worked on at once
SPACE, LETTER, MARK, OTHER = range(4)


def _classes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[0x20, 0x0A]] = SPACE
    for first, last in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
        kinds[first : last + 1] = MARK
    for first, last in ((0x41, 0x5A), (0x61, 0x7A)):
        kinds[first : last + 1] = LETTER
    return kinds


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Hashes:
    """Hashes of stretches of a buffer by prefix sums of odd powers, modulo 2**64."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(1, 2**62)) * 8 + 5
        self.powers = self.inverse = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            n = max(BUFFER + 64, len(data) + 1)
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


class RunMemory:
    """Ids by run in one growing pool, found through an open table of 128-bit hashes."""

    def __init__(self, path: str, bits: int = MEMORY_BITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(vocabulary.values()) + 1
        self.word_end = np.zeros(self.vocabulary, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.first, self.second = _Hashes(1), _Hashes(2)
        self.bits = bits
        self._forget()

    def _forget(self):
        size = 1 << self.bits
        self.keys, self.checks = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.at = np.full(size, -1, np.int32)
        self.starts, self.lengths = np.zeros(size // 2, np.int64), np.zeros(size // 2, np.int32)
        self.known = 0
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each run, -1 where unknown."""
        slot, found = self._slots(keys), np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            s = slot[open_]
            at = self.at[s]
            same = (self.keys[s] == keys[open_]) & (self.checks[s] == checks[open_]) & (at >= 0)
            found[open_[same]] = at[same]
            open_ = open_[~same & (at >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return found

    def _insert(self, keys: np.ndarray, checks: np.ndarray, numbers: np.ndarray):
        slot, open_ = self._slots(keys), np.arange(len(keys))
        while len(open_):
            s = slot[open_]
            free = self.at[s] < 0
            self.at[s[free]] = numbers[open_[free]]  # of several on one slot, the last stays
            mine = self.at[s] == numbers[open_]
            self.keys[s[mine]], self.checks[s[mine]] = keys[open_[mine]], checks[open_[mine]]
            open_ = open_[~mine]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)

    def _encode_each(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_runs(self, words: list[str]) -> list[list[int]]:
        """Runs that are one word to the tokenizer: joined by spaces and cut at the ends of words."""
        found = []
        groups = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        for group, ids in zip(groups, self._encode_each([" ".join(g) for g in groups]), strict=True):
            ends = (np.flatnonzero(self.word_end[np.asarray(ids, np.int64)]) + 1).tolist()
            if len(ends) == len(group):
                found += [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                found += self._encode_each(group)
        return found

    def _learn(self, raw: bytes, keys, checks, starts, ends, plain):
        """Runs with distinct hashes that are not known yet."""
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        runs = [raw[a:b].decode() for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True)]
        n = int(plain.sum())
        ids = self._encode_runs(runs[:n]) + self._encode_each(runs[n:])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.uint32, int(lengths.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(ids) > len(self.starts):  # only where one buffer brings more than the memory holds
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.pool[self.used : self.used + len(flat)] = flat
        new = np.arange(self.known, self.known + len(ids))
        self.starts[new] = self.used + np.cumsum(lengths) - lengths
        self.lengths[new] = lengths
        self._insert(keys[order], checks[order], new.astype(np.int32))
        self.used += len(flat)
        self.known += len(ids)

    @staticmethod
    def _runs(data: np.ndarray):
        """Starts and ends of the runs, and whether each is plain (else a whole piece)."""
        kind = CLASSES[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        low = LOWER[data]
        capital = lead[data[lead + 1] <= 0x9E] + 1
        low[capital] += 32
        starts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(data)]])
        kinds = kind[starts]
        after_space = np.concatenate([[True], kinds[:-1] == SPACE])
        odd = (kinds == OTHER) | ((kinds == LETTER) & ~after_space)
        inside = kinds != SPACE
        starts, ends, odd, first = starts[inside], ends[inside], odd[inside], after_space[inside]
        if not len(starts):
            return low, starts, ends, odd
        heads = np.flatnonzero(first)
        piece_odd = np.logical_or.reduceat(odd, heads)
        lasts = np.concatenate([heads[1:], [len(starts)]]) - 1
        ends[heads[piece_odd]] = ends[lasts[piece_odd]]
        odd = piece_odd[np.cumsum(first) - 1]
        keep = first | ~odd
        return low, starts[keep], ends[keep], ~odd[keep]

    def _encode_buffer(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a buffer, with each run's start and number of ids."""
        data = np.frombuffer(raw, np.uint8)
        low, starts, ends, plain = self._runs(data)
        if not len(starts):
            return np.zeros(0, np.uint32), starts, starts
        mixed = np.where(plain, np.uint64(0), np.uint64(0x5851F42D4C957F2D))
        # Whole pieces keep their capitals: lower case may depend on what follows them.
        keys, checks = self.first.of(low, starts, ends), self.second.of(low, starts, ends)
        other = np.flatnonzero(~plain)
        if len(other):
            keys[other] = self.first.of(data, starts[other], ends[other])
            checks[other] = self.second.of(data, starts[other], ends[other])
        keys = keys ^ mixed
        at = self._find(keys, checks)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.known + len(new) > 1 << (self.bits - 1):
                self._forget()
                new = np.arange(len(keys))
            pairs = np.empty(len(new), [("k", np.uint64), ("c", np.uint64)])
            pairs["k"], pairs["c"] = keys[new], checks[new]
            _, index = np.unique(pairs, return_index=True)
            one = new[np.sort(index)]
            while (self.known + len(one)) * 2 > 1 << self.bits:
                self.bits += 1  # a single buffer has more runs than the memory
                self._forget()
            source = low.tobytes()
            if len(other):
                whole = bytearray(source)
                for i in one[~plain[one]].tolist():
                    whole[starts[i] : ends[i]] = raw[starts[i] : ends[i]]
                source = bytes(whole)
            self._learn(source, keys[one], checks[one], starts[one], ends[one], plain[one])
            at = self._find(keys, checks)
        lengths = self.lengths[at].astype(np.int64)
        stops = np.cumsum(lengths)
        index = np.repeat(self.starts[at] - (stops - lengths), lengths)
        index += np.arange(len(index))
        return self.pool[index], starts, lengths

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts one after the other, and where each text's begin (one more border at the end)."""
        counts = np.zeros(len(texts) + 1, np.int64)
        found, held, size = [], [], 0

        def flush():
            nonlocal size
            if held:
                ids, starts, lengths = self._encode_buffer(b"\n".join(part for _, part in held))
                begins = np.cumsum([0] + [len(part) + 1 for _, part in held[:-1]])
                sums = np.concatenate([[0], np.cumsum(lengths)])
                cuts = sums[np.searchsorted(starts, np.append(begins, size + len(held)))]
                np.add.at(counts, [i + 1 for i, _ in held], np.diff(cuts))
                found.append(ids)
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            begin, text = 0, text or b""
            while begin < len(text):
                end = len(text)
                if end - begin > BUFFER:  # cut a long text behind a space; only a piece without any may be longer
                    end = text.rfind(b" ", begin, begin + BUFFER) + 1
                    end = end or text.find(b" ", begin + BUFFER) + 1 or len(text)
                if size and size + end - begin > BUFFER:
                    flush()
                held.append((i, text[begin:end]))
                size += end - begin
                begin = end
        flush()
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum(counts)

    def encode_with_end(self, texts: list[bytes | None], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the end id after each text."""
        ids, borders = self.encode(texts)
        return np.insert(ids, borders[1:], end_id), borders + np.arange(len(borders))


_MEMORIES: dict[str, RunMemory] = {}


def memory(path: str) -> RunMemory:
    """This worker's memory for a tokenizer file."""
    if path not in _MEMORIES:
        _MEMORIES[path] = RunMemory(path)
    return _MEMORIES[path]


def default_path() -> str:
    return public_tokenizers.path(TOKENIZER)
