"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The texts of a batch are cut into pieces (the vocabulary's own splitting pattern), distinct
pieces that aren't in the worker's memo become symbols of one flat array, and in each
round every piece merges its lowest-ranked pair wherever it occurs.  Ranks are
found by binary search over the sorted keys of all pairs.  The vocabulary file is
a parameter; only its contents (a few MB, the same for every input) are broadcast.

Defined results: null text counts as empty and gives no ids; special tokens that stand in a
text become their ids, as the tokenizers library does; a piece of more than LONG bytes merges its pairs one by one from a
heap, which gives the same ids in time that hardly grows faster than its length; repeated rows give the same ids; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import regex

#: The pattern by which byte-level BPE vocabularies of this family split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers; at that many it starts anew.
MEMO = 1 << 19
_PIECES = regex.compile(PATTERN)
#: White space as the pattern means it (str.isspace() also holds for four control characters).
_WHITE = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WHITE_THEN_SPACE = regex.compile("[" + "".join(sorted(_WHITE)) + "] ")
#: Bytes beyond which a piece leaves the batched rounds, each of which reads all of it.
LONG = 512
#: Texts that are cut into pieces at a time.
TEXTS = 128


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """What the encoder needs of a tokenizers JSON file; read on the driver, then broadcast."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
    return {"vocab": j["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in j.get("added_tokens", [])}}


def chunks(text: str) -> list[str]:
    """Parts between whose ends no piece can lie: cut before a space that follows a character other than white space."""
    parts = text.split(" ")
    if len(parts) > 1:
        parts[1:] = [" " + p for p in parts[1:]]
        if not parts[0]:
            del parts[0]
    if not _WHITE_THEN_SPACE.search(text):
        return parts if text else []
    out: list[str] = []
    joined = ""
    for p in parts:
        joined += p
        if p and p[-1] not in _WHITE:
            out.append(joined)
            joined = ""
    if joined:
        out.append(joined)
    return out


class Bpe:
    def __init__(self, vocabulary: dict):
        vocab, alphabet = vocabulary["vocab"], byte_alphabet()
        self.special = vocabulary["special"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        left, right, made = (np.array([vocab[x] for x in part], np.int64) for part in zip(*((a, b, a + b) for a, b in vocabulary["merges"]), strict=True))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        keys, ranks = keys[order], order
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.keys, self.ranks, self.made = keys[first], ranks[first], made
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[int, int] = {}

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces in one array, and how many each piece has."""
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        lengths = np.array([len(p) for p in pieces], np.int64)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        out_symbols, out_owner = [], []
        none = len(self.made)
        while len(symbols):
            rank = np.full(len(symbols), none, np.int64)
            if len(symbols) > 1:
                pair = symbols[:-1] * self.size + symbols[1:]
                at = np.searchsorted(self.keys, pair)
                at[at == len(self.keys)] = 0
                found = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
                rank[:-1][found] = self.ranks[at[found]]
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = best < none
            if not open_.all():
                # Pieces without a pair are done.
                out_symbols.append(symbols[~open_])
                out_owner.append(owner[~open_])
                symbols, owner, rank, best = symbols[open_], owner[open_], rank[open_], best[open_]
                if not len(symbols):
                    break
            hit = rank == best
            # Of overlapping pairs (a a a) the first, third, ... merge: count from the start of each run.
            run_start = hit & ~np.concatenate(([False], hit[:-1]))
            if (hit & ~run_start).any():
                place = np.arange(len(hit))
                since = place - np.maximum.accumulate(np.where(run_start, place, 0))
                hit &= since % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, best, 0)], symbols)
            keep = ~np.concatenate(([False], hit[:-1]))
            symbols, owner = symbols[keep], owner[keep]
        if not out_symbols:
            return np.zeros(0, np.int64), lengths
        symbols, owner = np.concatenate(out_symbols), np.concatenate(out_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(pieces))

    def merged_long(self, piece: bytes) -> np.ndarray:
        """ids of one piece; the lowest-ranked pair, of equal ones the leftmost, merges first."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        symbols, made, size = self.of_byte[np.frombuffer(piece, np.uint8)].tolist(), self.made.tolist(), self.size
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.pairs.get
        heap = [(r, i) for i, r in enumerate(rank_of(a * size + b) for a, b in zip(symbols, symbols[1:], strict=False)) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # A pair that has changed since is out of date.
            if symbols[i] < 0 or j >= n or rank_of(symbols[i] * size + symbols[j]) != r:
                continue
            symbols[i], symbols[j], after[i] = made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (fresh := rank_of(symbols[a] * size + symbols[b])) is not None:
                    heapq.heappush(heap, (fresh, a))
        out = np.array(symbols, np.int64)
        return out[out >= 0]

    def _learn(self, chunks: list[str]) -> None:
        """Puts the ids of new chunks into the memo, as little-endian 32-bit integers."""
        memo = self.memo
        cut = [(c,) if c[c[0] == " " :].isalpha() else _PIECES.findall(c) for c in chunks]
        pieces = [p for p in dict.fromkeys(p for c in cut for p in c) if p not in memo]
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ids, n = self.merged([c for c in coded if len(c) <= LONG])
        long = {p: self.merged_long(c).astype("<u4").tobytes() for p, c in zip(pieces, coded, strict=True) if len(c) > LONG}
        pieces = [p for p, c in zip(pieces, coded, strict=True) if len(c) <= LONG]
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        of = dict(zip(pieces, (raw[e - 4 * k : e] for e, k in zip(ends, n.tolist(), strict=True)), strict=True)) | long
        for chunk, parts in zip(chunks, cut, strict=True):
            if len(parts) > 1:
                of[chunk] = b"".join([of[p] if p in of else memo[p] for p in parts])
        memo.update(of)

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for at in range(0, len(texts), TEXTS):
            yield from self._encode_some([self._row(t or "") for t in texts[at : at + TEXTS]])

    def _row(self, text: str) -> list:
        """A text's chunks, and encoded ids where special tokens stand."""
        if not any(s in text for s in self.special):
            return chunks(text)
        row: list = []
        for i, part in enumerate(self.cut.split(text)):
            row += [int(self.special[part]).to_bytes(4, "little")] if i % 2 else chunks(part)
        return row

    def _encode_some(self, rows: list[list]) -> Iterator[np.ndarray]:
        memo = self.memo
        seen = [c for c in set().union(*rows) if c.__class__ is str]
        new = [c for c in seen if c not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = seen
        if new:
            self._learn(new)
        for row in rows:
            yield np.frombuffer(b"".join([memo[c] if c.__class__ is str else c for c in row]), "<u4")

    def decode(self, ids: list[int]) -> str:
        """Special tokens stay; bytes that aren't UTF-8 become replacement characters."""
        of = self.bytes
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


_made: dict[int, Bpe] = {}


def on_worker(broadcast) -> Bpe:
    """One encoder, and so one memo, for each worker process and vocabulary."""
    key = broadcast.value["key"]
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(broadcast.value)
    return _made[key]


def broadcast_vocabulary(spark, path: str):
    """The vocabulary as a broadcast: a few MB, by the file's size, whatever the input."""
    import zlib

    found = read_vocabulary(path)
    with open(path, "rb") as f:
        found["key"] = zlib.crc32(f.read())
    return spark.sparkContext.broadcast(found)
