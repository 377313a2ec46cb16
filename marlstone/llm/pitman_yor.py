"""A hierarchical Pitman-Yor language model of a whole corpus, and every text's probability under it.

The model is a hierarchy of Chinese restaurants.  Each word that precedes another is a context with a
restaurant of its own; the end token stands before a text's first word.  All contexts share one parent, which serves
words; its customers are the children's tables.  Each of its own tables orders a new spelling from the restaurants below.  Those
serve bytes, one for each context of up to ORDER preceding bytes; contexts that share their last byte share
a parent, down to a uniform choice.  So an unseen word has the probability of its spelling, and a
context that is rarely seen leans on its parent.

Seating is sampled by Gibbs sweeps over the numbers of tables.  For a dish with at most STIRLING customers the number of
tables is drawn from its exact conditional distribution (generalised Stirling numbers); larger dishes are seated anew one
customer after another, in blocks of a sixteenth of those who sit, which is an approximation.  All
dishes of a sweep see the other dishes' tables as of its start.  A pair of words that occurs once has one table
in every seating, so only the others are sampled.  After every sweep the parent's customers, its tables and all totals are
formed anew from the tables below, so each sample is a distribution: it sums to one over words and spellings.  The averages
over the samples that follow the burn-in are taken at each level of the hierarchy.

Where things happen: texts are cut into blocks of about BLOCK_BYTES and written as word numbers.  A block sends its words to
shards by a 48-bit checksum, and its distinct pairs of words to other shards by a checksum of both, so that neither a common word nor a
common context is dealt whole to one task.  Word shards hold the parent, pair shards the contexts.  Each round pair shards send word shards
the tables of their words, and get back probabilities and totals.  In the end both send each block its numbers, in the order of the block's own.
Only the spelling model is gathered: its cells are n-grams of ORDER + 1 bytes, at most 2^24 of them at every size.

Defined results: null text counts as empty and has the end token only; a row with a null id is
training text; repeated rows are scored each, and count each; without training tokens all known counts are 0 and the model is the uniform spelling; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, UID, Workspace, batches, fold, lowered, release, sliced, with_uid
from .shingles import chunks, mixed, word_hashes, word_spans

#: Bytes of text in a block, tokens for which one shard of pairs is made, and distinct words of blocks for which one shard of words is made.
BLOCK_BYTES, SHARD_TOKENS, SHARD_WORDS = 1 << 24, 1 << 21, 1 << 19
STIRLING = 256
#: Pairs that are looked at at a time where all of a block's are gone through.
RUN = 1 << 18
BURN_IN, SAMPLES = 2, 3
#: Sweeps over the spelling model between two samples of the words.
SPELLING_SWEEPS = 3
#: Bytes of context in the spelling model.
ORDER = 2
#: The token that ends a text; no word can be a line feed.
STOP = b"\n"
LEAST_LOG = -80.0
#: Base probability that a text ends, and the concentration of all restaurants.
END = 1e-3
THETA = 1.0


# --- seating -----------------------------------------------------------------


def stirling(d: float, n: int = STIRLING) -> np.ndarray:
    """log S[c, t]: the weight of all seatings of c customers at t tables with discount d."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(n):
        t = np.arange(n + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.log(np.maximum(c - t * d, 0)) + s[c]
        stay[np.isnan(stay)] = -np.inf
        s[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], s[c, :-1])))
    return s


def seat(c: np.ndarray, t: np.ndarray, tables: np.ndarray, base: np.ndarray, d: float, log_s: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables of dishes with c customers; tables: of each dish's restaurant, all dishes; base: the parent's probability."""
    out = np.minimum(c, 1)
    others = np.maximum(tables - t, 0)
    base = np.maximum(base, 1e-300)
    for low, high in ((2, 2), (3, 3), (4, 4), (5, 8), (9, 16), (17, 64), (65, STIRLING)):
        at = np.flatnonzero((c >= low) & (c <= high))
        size = (1 << 19) // high
        for i in range(0, len(at), size):
            k = at[i : i + size]
            steps = np.arange(high)
            grown = np.cumsum(np.log(THETA + d * (others[k][:, None] + steps)), axis=1)
            log_p = grown + (steps + 1) * np.log(base[k])[:, None] + log_s[c[k], 1 : high + 1]
            p = np.cumsum(np.exp(log_p - log_p.max(axis=1, keepdims=True)), axis=1)
            out[k] = 1 + (p < rng.random(len(k))[:, None] * p[:, -1:]).sum(axis=1)
    at = np.flatnonzero(c > STIRLING)
    if len(at):
        n, made = np.ones(len(at)), np.ones(len(at))
        want, near, p0 = c[at].astype(float), others[at].astype(float), base[at]
        going = n < want
        while going.any():
            step = np.minimum(np.maximum(1, np.floor(n / 16)), want - n)
            fresh = (THETA + d * (near + made)) * p0
            p = fresh / (fresh + n - d * made)
            made += np.where(going, rng.binomial(np.where(going, step, 0).astype(np.int64), p), 0)
            n += np.where(going, step, 0)
            going = n < want
        out[at] = made.astype(out.dtype)
    return out


def discount(ones: float, twos: float) -> float:
    """The usual estimate from the numbers of dishes with one and with two customers."""
    return float(min(0.9, max(0.1, ones / (ones + 2 * twos)))) if ones + twos else 0.5


# --- spelling ------------------------------------------------------------------


@dataclass
class Level:
    """Restaurants of one context length: cells (context << 8 | byte) with customers and tables."""

    cells: np.ndarray
    c: np.ndarray
    t: np.ndarray
    d: float = 0.5
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.contexts, self.of = np.unique(self.cells >> 8, return_inverse=True)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x, len(self.contexts))


class Spelling:
    """Byte restaurants with contexts of 0 to `order` bytes."""

    def __init__(self, cells: np.ndarray, c: np.ndarray, order: int):
        self.levels: list[Level] = []
        for n in range(order, -1, -1):
            mask = (1 << (8 * (n + 1))) - 1
            if n < order:
                cells, where = np.unique(cells & mask, return_inverse=True)
                c = np.bincount(where, self.levels[-1].t, len(cells)).astype(np.int64)
            level = Level(cells, c, np.minimum(c, 1))
            level.d = discount((c == 1).sum(), (c == 2).sum())
            self.levels.append(level)
        self.levels.reverse()
        self.tables: list = []
        self._predict()

    def _predict(self) -> None:
        """For each level the probability of its cells and the weight of the parent by context."""
        self.tables = []
        for n, level in enumerate(self.levels):
            total, tables = level.sums(level.c), level.sums(level.t)
            share = (THETA + level.d * tables) / (THETA + total)
            parent = self.probability(level.cells, n - 1)
            p = (level.c - level.d * level.t) / (THETA + total[level.of]) + share[level.of] * parent
            self.tables.append((level.cells, p, level.contexts, share))

    def probability(self, cells: np.ndarray, n: int | None = None) -> np.ndarray:
        """Of the last byte of each cell, given the n bytes before it."""
        n = len(self.tables) - 1 if n is None else n
        if n < 0 or not len(self.tables):
            return np.full(len(cells), 1 / 256)
        mask = (1 << (8 * (n + 1))) - 1
        own = cells & mask
        known, p, contexts, share = self.tables[n]
        out = np.empty(len(own))
        at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
        hit = known[at] == own if len(known) else np.zeros(len(own), bool)
        out[hit] = p[at[hit]]
        if not hit.all():
            rest = own[~hit]
            lower = self.probability(rest, n - 1)
            if len(contexts):
                up = np.minimum(np.searchsorted(contexts, rest >> 8), len(contexts) - 1)
                lower = np.where(contexts[up] == rest >> 8, share[up], 1.0) * lower
            out[~hit] = lower
        return out

    def sweep(self, rng: np.random.Generator) -> None:
        """One Gibbs sweep from the longest contexts down; a level's tables are its parent's customers."""
        for n in range(len(self.levels) - 1, -1, -1):
            level = self.levels[n]
            log_s = stirling(level.d)
            level.t = seat(level.c, level.t, level.sums(level.t)[level.of].astype(np.int64), self.probability(level.cells, n - 1), level.d, log_s, rng)
            if n:
                below = self.levels[n - 1]
                at = np.searchsorted(below.cells, level.cells & ((1 << (8 * n)) - 1))
                below.c = np.bincount(at, level.t, len(below.cells)).astype(np.int64)
                below.t = np.minimum(np.maximum(below.t, 1), below.c)
        self._predict()

    def frozen(self) -> Spelling:
        """A copy that only predicts."""
        out = object.__new__(Spelling)
        out.levels, out.tables = [], self.tables
        return out


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all bytes and closing spaces of words, with ORDER bytes of context; where each word starts; their lengths."""
    raw = np.frombuffer(b" " * ORDER + (b" " * (ORDER + 1)).join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    cells = np.zeros(len(raw) - ORDER, np.int32)
    for k in range(ORDER + 1):
        cells |= raw[ORDER - k : len(raw) - k].astype(np.int32) << (8 * k)
    keep = np.ones(len(cells), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    for k in range(ORDER):
        # The bytes before a word's first one are no cells of its own.
        keep[starts[1:] + k - ORDER] = False
    return cells[keep], np.cumsum(sizes) - sizes, sizes


def _ranked(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the place of each among them, by a table of all cells there can be."""
    used = np.zeros(1 << (8 * (ORDER + 1)), bool)
    used[cells] = True
    known = np.flatnonzero(used)
    place = np.empty(len(used), np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    return known, place[cells]


def log_spelling(words: list[bytes], model: Spelling) -> np.ndarray:
    """Natural logarithms of the probabilities of words' spellings."""
    if not words:
        return np.zeros(0)
    out = []
    for i in range(0, len(words), 1 << 15):
        cells, starts, _ = spelled(words[i : i + (1 << 15)])
        known, back = _ranked(cells)
        out.append(np.add.reduceat(np.log(model.probability(known))[back], starts))
    return np.concatenate(out)


def spelling_cells(words: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of words that are ordered weight times each, and their counts."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cells, _, sizes = spelled(words)
    known, back = _ranked(cells)
    return known, np.bincount(back, np.repeat(weight, sizes), len(known)).astype(np.int64)


# --- blocks ------------------------------------------------------------------------


def _pack(x: np.ndarray, kind=np.int32) -> bytes:
    """The size of its items, then their first bytes, their second ones, and so on, compressed; integers take no more bytes than they need."""
    kind = np.dtype(kind)
    if kind.kind == "i" and len(x):
        most = max(int(x.max()), -int(x.min()))
        kind = np.dtype(next(f"i{n}" for n in (1, 2, 4, 8) if most < 1 << (8 * n - 1)))
    x = np.ascontiguousarray(x.astype(kind))
    planes = x.view(np.uint8).reshape(len(x), -1).T if kind.itemsize > 1 and len(x) else x
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _open(data: bytes, kind=np.int32) -> np.ndarray:
    kind, size = np.dtype(kind), data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f"{kind.kind}{size}").ravel().astype(kind)


def _pack_rising(x: np.ndarray) -> bytes:
    """As differences."""
    return _pack(np.diff(x, prepend=0))


def _open_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_open(data), dtype=np.int64)


def distinct(x: np.ndarray, kind: str | None = "stable") -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them in four bytes; quick where x consists of rising runs."""
    if not len(x):
        return x, np.zeros(0, np.int32)
    by = np.argsort(x, kind=kind)
    y = x[by]
    fresh = np.ones(len(y), bool)
    fresh[1:] = y[1:] != y[:-1]
    place = np.cumsum(fresh, dtype=np.int32)
    place -= 1
    at = np.empty(len(x), np.int32)
    at[by] = place
    return y[fresh], at


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _open_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


CODE_BITS = 48


def _codes(words: list[bytes]) -> np.ndarray:
    """What tells words apart when they are parts of pairs; the end token, which comes first where it is there, has 0."""
    first = int(words[:1] == [STOP])
    parts = [np.zeros(first, np.uint64), *(word_hashes(words[i : i + (1 << 16)])[0] for i in range(first, len(words), 1 << 16))]
    return np.concatenate(parts) >> np.uint64(64 - CODE_BITS)


def _pack_codes(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CODE_BITS // 8].tobytes()


def _open_codes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) * 8 // CODE_BITS, 8), np.uint8)
    out[:, : CODE_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, CODE_BITS // 8)
    return out.view("<u8").ravel().astype(np.uint64)


def _word_shard(codes: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the code."""
    return ((codes >> np.uint64(CODE_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cuts(slot: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    edges = np.flatnonzero(np.diff(slot, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(slot[a]), int(a), int(b)


def _batch(schema: pa.Schema, *rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema)


def _rows(batches_: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as each holds a block or a shard."""
    for b in batches_:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


_BLOCKS = "block long, ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, n_tokens long, n_words long, n_train long"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("n_train", pa.int64())])


def _run(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a run of texts as hashes and as bytes, its tokens as places among them (from 1, as 0 is the end), and the texts' sizes."""
    joined, hashes, starts, ends, counts = word_spans(texts)
    known, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    names = [joined[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return known, names, np.insert((at + 1).astype(np.int32), np.cumsum(counts), 0), counts + 1


def _block(ids: list, held: list, uid: int, parts: list) -> pa.RecordBatch:
    """parts: what _run gives for runs of texts."""
    every, names, tokens, sizes = zip(*parts, strict=True)
    words, first, at = np.unique(np.concatenate((np.zeros(1, np.uint64), *every)), return_index=True, return_inverse=True)
    names = [STOP, *(n for run in names for n in run)]
    ends = np.cumsum([len(x) for x in every]) + 1
    own = [np.insert(at[z - len(x) : z], 0, 0).astype(np.int32)[t] for x, z, t in zip(every, ends, tokens, strict=True)]
    sizes = np.concatenate(sizes)
    row = {"block": uid, "ids": ids, "held": held, "sizes": sizes.tolist(), "tokens": _pack(np.concatenate(own)), "words": _pack_words([names[i] for i in first.tolist()])}
    return _batch(_BLOCKS_ARROW, row | {"n_tokens": int(sizes.sum()), "n_words": len(words), "n_train": int(sizes[~np.array(held)].sum())})


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of a block's words, which are in order of their codes."""
    ids, held, parts, uid, size = [], [], [], 0, 0
    for uids, own, out, texts in batches(sliced(rows), [UID, OWN + "id", OWN + "held", "text"]):
        for first, part in chunks(texts):
            if not parts:
                uid = uids[first]
            ids += own[first : first + len(part)]
            held += out[first : first + len(part)]
            parts.append(_run(part))
            size += sum(map(len, part)) + len(part)
            if size >= BLOCK_BYTES:
                yield _block(ids, held, uid, parts)
                ids, held, parts, size = [], [], [], 0
    if parts:
        yield _block(ids, held, uid, parts)


class Block:
    """A block's tokens, and its distinct pairs (u before w: places in words) in order of their shards, then of u and w."""

    def __init__(self, row: dict, shards: int):
        self.tokens, self.words = _open(row["tokens"]), _open_words(row["words"])
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = _codes(self.words)
        n = len(self.words)
        pairs = np.empty(len(self.tokens), np.int64)
        pairs[1:] = self.tokens[:-1]
        pairs[self.starts] = 0
        pairs *= n
        pairs += self.tokens
        pairs, at = distinct(pairs, None)
        u, w, shard = (np.empty(len(pairs), k) for k in (np.int32, np.int32, np.uint16 if shards <= 1 << 16 else np.int64))
        for i in range(0, len(pairs), RUN):
            k = slice(i, i + RUN)
            u[k], w[k] = np.divmod(pairs[k], n)
            key = mixed(self.codes[u[k]] * np.uint64(0x9E3779B97F4A7C15) + mixed(self.codes[w[k]]))
            shard[k] = (key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        del pairs
        by = np.argsort(shard, kind="stable")
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        self.u, self.w, self.shard, self.at = u[by], w[by], shard[by], rank[at]

    def names(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of a run of pairs, and the places of u and w among them."""
        u, w = self.u[first:end], self.w[first:end]
        if (end - first) * 32 < len(self.words):
            names, at = np.unique(np.concatenate((u, w)), return_inverse=True)
            return names, at[: len(u)], at[len(u) :]
        used = np.zeros(len(self.words), bool)
        used[u] = used[w] = True
        place = np.cumsum(used) - 1
        return np.flatnonzero(used), place[u], place[w]


_PAIR_PACKETS = "shard int, block long, codes binary, u binary, w binary, counts binary"
_PAIR_PACKETS_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("codes", pa.binary()), ("u", pa.binary()), ("w", pa.binary()), ("counts", pa.binary())])


def _send_pairs(shards: int):
    """Each block's distinct pairs with their counts over training rows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            b = Block(r, shards)
            counts = np.bincount(b.at[np.repeat(~np.array(r["held"]), b.sizes)], minlength=len(b.u))
            for shard, first, end in _cuts(b.shard):
                names, u, w = b.names(first, end)
                yield _batch(_PAIR_PACKETS_ARROW, {"shard": shard, "block": r["block"], "codes": _pack_codes(b.codes[names]), "u": _pack_rising(u), "w": _pack(w), "counts": _pack(counts[first:end])})

    return run


#: What word shards get.  kind NEW: a block's words with counts; SINGLE, ASKED: codes with tables as contexts and as words.
_WORD_PACKETS = "shard int, kind int, sender long, data binary, a binary, b binary"
_WORD_PACKETS_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("sender", pa.int64()), ("data", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
NEW, SINGLE, ASKED = 0, 1, 2


def _send_words(shards: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            tokens, words = _open(r["tokens"]), _open_words(r["words"])
            counts = np.bincount(tokens[np.repeat(~np.array(r["held"]), r["sizes"])], minlength=len(words))
            # Words are in order of their shards, so a few of them tell where each begins.
            of = lambda w: int(_word_shard(_codes([w]), shards)[0])
            edges = [*(bisect_left(words, k, key=of) for k in range(shards)), len(words)]
            for shard, (first, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if first == end:
                    continue
                yield _batch(_WORD_PACKETS_ARROW, {"shard": shard, "kind": NEW, "sender": r["block"], "data": _pack_words(words[first:end]), "a": _pack(counts[first:end])})

    return run


# --- pairs -------------------------------------------------------------------------

#: A shard of pairs.  Of all its pairs: c, and at: those of each block (its numbers end at ends).  Of the pairs that occur more than once: u and w
#: (places in names), many (customers), t (tables), total (tables added up over samples).  single, su, sw: codes and tables of the pairs that occur once.
_PAIRS = "shard int, blocks array<long>, ends array<long>, at binary, c binary, names binary, u binary, w binary, many binary, t binary, total binary, single binary, su binary, sw binary, ones long, twos long"
_PAIRS_ARROW = pa.schema([("shard", pa.int32()), ("blocks", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("at", "c", "names", "u", "w", "many", "t", "total", "single", "su", "sw")), ("ones", pa.int64()), ("twos", pa.int64())])
_SEATED = "shard int, names binary, u binary, w binary, many binary, t binary, total binary"
_SEATED_COLUMNS = [c.split()[0] for c in _SEATED.split(", ")]
_SEATED_ARROW = pa.schema([_PAIRS_ARROW.field(c) for c in _SEATED_COLUMNS])


def _merge_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    packets = rows.select(["block", "codes", "u", "w", "counts"]).to_pylist()
    each = [_open_codes(r["codes"]) for r in packets]
    names, place = distinct(np.concatenate(each))
    pairs, end = [], 0
    for r, own in zip(packets, each, strict=True):
        at = place[end : end + len(own)]
        end += len(own)
        pairs.append(at[_open_rising(r["u"])] * np.int64(len(names)) + at[_open(r["w"])])
    known, at = distinct(np.concatenate(pairs))
    c = np.bincount(at, np.concatenate([_open(r["counts"]) for r in packets]), len(known)).astype(np.int64)
    u, w = np.divmod(known, len(names))
    many, once = c > 1, c == 1
    used, back = distinct(np.concatenate((u[many], w[many])))
    su, sw = np.bincount(u[once], minlength=len(names)), np.bincount(w[once], minlength=len(names))
    some = np.flatnonzero(su + sw)
    n = int(many.sum())
    row = {"shard": key[0].as_py(), "blocks": [r["block"] for r in packets], "ends": np.cumsum([len(p) for p in pairs]).tolist(), "at": _pack_rising(at), "c": _pack(c, np.int64)}
    row |= {"names": _pack_codes(names[used]), "u": _pack_rising(back[:n]), "w": _pack(back[n:]), "many": _pack(c[many], np.int64), "t": _pack(np.ones(n), np.int64), "total": _pack(np.zeros(n), np.int64)}
    row |= {"single": _pack_codes(names[some]), "su": _pack(su[some]), "sw": _pack(sw[some]), "ones": int(once.sum()), "twos": int((c == 2).sum())}
    return pa.Table.from_pylist([row], _PAIRS_ARROW)


def _tables_of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a shard's names, and the tables of the sampled pairs by context and by word."""
    codes, t = _open_codes(r["names"]), _open(r["t"], np.int64)
    return codes, np.bincount(_open_rising(r["u"]), t, len(codes)), np.bincount(_open(r["w"]), t, len(codes))


def _send_tables(shards: int, first: bool):
    """A pair shard's tables to the word shards; at first with its codes and the pairs that occur once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            sets = [(ASKED, *_tables_of(r))]
            if first:
                sets.append((SINGLE, _open_codes(r["single"]), _open(r["su"]), _open(r["sw"])))
            for kind, codes, u, w in sets:
                for shard, i, j in _cuts(_word_shard(codes, shards)):
                    yield _batch(_WORD_PACKETS_ARROW, {"shard": shard, "kind": kind, "sender": r["shard"], "data": _pack_codes(codes[i:j]) if first else None, "a": _pack(u[i:j], np.int64), "b": _pack(w[i:j], np.int64)})

    return run


def _seat_pairs(state: State, seed: int, record: bool):
    """A Gibbs sweep over a shard's pairs; answers: totals of contexts and the parent's probabilities, by word shard."""

    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        r = rows.to_pylist()[0]
        got = sorted(answers.to_pylist(), key=lambda x: x["sender"])
        u, w, c, t, total = _open_rising(r["u"]), _open(r["w"]), *(_open(r[k], np.int64) for k in ("many", "t", "total"))
        if len(c):
            tables = np.concatenate([_open(x["a"], np.int64) for x in got])
            base = np.concatenate([_open(x["b"], np.float32) for x in got]).astype(float)
            t = seat(c, t, tables[u], base[w], state.d, stirling(state.d), np.random.default_rng([seed, 0, r["shard"]]))
        r |= {"t": _pack(t, np.int64), "total": _pack(total + t, np.int64) if record else r["total"]}
        return pa.Table.from_pylist([r], _SEATED_ARROW)

    return run


# --- words ---------------------------------------------------------------------------

#: A shard of words, in order of their codes.  c: training tokens, also those that follow the word.  at: the places of each block's words.  asked: the places of each
#: pair shard's names.  c1, u1: tables of pairs that occur once, by word and by context.  customers, seated: of the parent; inside: tables of the word as a context.
#: spelling, extra: probability, and the rest of its natural logarithm below LEAST_LOG.  p, insides: sums over samples of the parent's probability and of `inside`.
_WORDS = "shard int, blocks array<long>, ends array<long>, at binary, senders array<long>, asked_ends array<long>, asked binary, words binary, c binary, c1 binary, u1 binary, customers binary, seated binary, inside binary, insides binary, spelling binary, extra binary, p binary, n long, v long, sum_customers long, sum_seated long, ones long, twos long"
_LISTS, _LONGS = ("blocks", "ends", "senders", "asked_ends"), ("n", "v", "sum_customers", "sum_seated", "ones", "twos")
_WORDS_ARROW = pa.schema([(c, pa.int32() if c == "shard" else pa.list_(pa.int64()) if c in _LISTS else pa.int64() if c in _LONGS else pa.binary()) for c in (x.split()[0] for x in _WORDS.split(", "))])
_COUNTS, _REALS = ("c", "c1", "u1", "customers", "seated", "inside", "insides"), ("spelling", "extra", "p")
_ROUTES = ("blocks", "ends", "at")


#: What changes from round to round.
_SHARD = ", ".join(c for c in _WORDS.split(", ") if c.split()[0] not in _ROUTES)
_SHARD_ARROW = pa.schema([f for f in _WORDS_ARROW if f.name not in _ROUTES])


class Words:
    """A row of _SHARD with open arrays."""

    def __init__(self, row: dict):
        self.row = row
        self.words = _open_words(row["words"])
        for k in _COUNTS:
            setattr(self, k, _open(row[k], np.int64))
        for k in _REALS:
            setattr(self, k, _open(row[k], np.float32).astype(float))

    def closed(self) -> dict:
        own = {"sum_customers": int(self.customers.sum()), "sum_seated": int(self.seated.sum())}
        return self.row | {k: _pack(getattr(self, k), np.int64) for k in _COUNTS} | {k: _pack(getattr(self, k), np.float32) for k in _REALS} | own

    def asked(self) -> Iterator[tuple[int, np.ndarray]]:
        at, ends = _open_rising(self.row["asked"]), self.row["asked_ends"]
        for sender, a, b in zip(self.row["senders"], [0, *ends], ends, strict=False):
            yield sender, at[a:b]

    def served(self, state: State) -> np.ndarray:
        """The parent's probabilities, but for `extra`."""
        return (self.customers - state.d0 * self.seated + (THETA + state.d0 * state.seated) * self.spelling) / (THETA + state.customers)



def _merge_words(key: tuple, rows: pa.Table) -> pa.Table:
    packets = rows.to_pylist()
    new, single, asked = ([r for r in packets if r["kind"] == k] for k in (NEW, SINGLE, ASKED))
    lists = [_open_words(r["data"]) for r in new]
    every = sorted(set().union(*lists), key=lambda w: (w != STOP, w))
    codes = _codes(every)
    by = np.argsort(codes, kind="stable")
    words, codes = [every[i] for i in by], codes[by]
    place = dict(zip(words, range(len(words)), strict=True))
    at = [np.fromiter(map(place.__getitem__, x), np.int32, len(x)) for x in lists]
    total = lambda places, values: np.bincount(np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0), *values]), len(words))
    find = lambda some: [np.searchsorted(codes, _open_codes(r["data"])) for r in some]
    mine = Words.__new__(Words)
    mine.words = words
    mine.c = total(at, [_open(r["a"]) for r in new]).astype(np.int64)
    once, more = find(single), find(asked)
    longs = lambda some, k: [_open(r[k], np.int64) for r in some]
    mine.u1, mine.c1 = total(once, longs(single, "a")).astype(np.int64), total(once, longs(single, "b")).astype(np.int64)
    mine.inside = mine.u1 + total(more, longs(asked, "a")).astype(np.int64)
    mine.customers = mine.c1 + total(more, longs(asked, "b")).astype(np.int64)
    mine.seated = np.minimum(mine.customers, 1)
    mine.insides = np.zeros(len(words), np.int64)
    for k in _REALS:
        setattr(mine, k, np.zeros(len(words)))
    mine.row = {"shard": key[0].as_py(), "words": _pack_words(words), "blocks": [r["sender"] for r in new], "ends": np.cumsum([len(x) for x in at]).tolist(), "at": _pack_rising(np.concatenate([np.zeros(0, np.int64), *at]))}
    mine.row |= {"senders": [r["sender"] for r in asked], "asked_ends": np.cumsum([len(x) for x in more]).tolist(), "asked": _pack_rising(np.concatenate([np.zeros(0, np.int64), *more]))}
    mine.row |= {"n": int(mine.c.sum()), "v": int((mine.c > 0).sum()), "ones": int((mine.customers == 1).sum()), "twos": int((mine.customers == 2).sum())}
    return pa.Table.from_pylist([mine.closed()], _WORDS_ARROW)


@dataclass
class State:
    """n, v: training tokens, all and distinct; d, d0: discounts of contexts and of their parent, which has customers at seated tables."""

    n: int
    v: int
    d: float
    d0: float
    customers: int
    seated: int


def _state(words: DataFrame, d: float, d0: float | None = None) -> State:
    r = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _LONGS]).first()
    return State(r.n, r.v, d, discount(r.ones, r.twos) if d0 is None else d0, r.sum_customers, r.sum_seated)


def _seat_row(r: dict, packets: list[dict], model: Spelling, state: State, seed: int, record: bool) -> dict:
    """The parent's tables after the pair shards' sweep; with `record`, adds the previous state to the averages."""
    x = Words(r)
    if record:
        x.p += x.served(state)
        x.insides += x.inside
    if packets:
        x.customers, x.inside = x.c1.copy(), x.u1.copy()
        sent = {p["sender"]: p for p in packets}
        for sender, at in x.asked():
            np.add.at(x.inside, at, _open(sent[sender]["a"], np.int64))
            np.add.at(x.customers, at, _open(sent[sender]["b"], np.int64))
    log_p = log_spelling(x.words, model)
    x.extra = np.minimum(log_p - LEAST_LOG, 0)
    x.spelling = (1 - END) * np.exp(np.maximum(log_p, LEAST_LOG))
    x.spelling[[i for i, w in enumerate(x.words) if w == STOP]] = END
    x.seated = np.where(x.customers > 0, seat(x.customers, np.minimum(np.maximum(x.seated, 1), x.customers), np.full(len(x.words), state.seated), x.spelling, state.d0, stirling(state.d0), np.random.default_rng([seed, 1, r["shard"]])), 0)
    return x.closed()


def _seat_words(model, state: State, seed: int, record: bool):
    def run(key: tuple, rows: pa.Table, packets: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([_seat_row(rows.to_pylist()[0], packets.to_pylist(), model.value, state, seed, record)], _SHARD_ARROW)

    return run


def _seat_first(model, state: State, seed: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            yield _batch(_SHARD_ARROW, _seat_row(r, [], model.value, state, seed, False))

    return run


_ANSWERS = "shard int, sender int, a binary, b binary"
_ANSWERS_ARROW = pa.schema([("shard", pa.int32()), ("sender", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _answer_pairs(state: State):
    """To each pair shard, the tables in its contexts and the parent's probabilities of its words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(rows):
            x = Words(r)
            p = x.served(state)
            for sender, at in x.asked():
                yield _batch(_ANSWERS_ARROW, {"shard": sender, "sender": r["shard"], "a": _pack(x.inside[at], np.int64), "b": _pack(p[at], np.float32)})

    return run


# --- spelling cells of all shards ------------------------------------------------------

_CELLS = "part int, tag long, cells binary, n binary"
_CELLS_ARROW = pa.schema([("part", pa.int32()), ("tag", pa.int64()), ("cells", pa.binary()), ("n", pa.binary())])
PARTS = 16


def _cells_of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spellings that the parent's tables order, cut by the last byte so that parts are merged apart."""
    for r in _rows(rows):
        words, t = _open_words(r["words"]), _open(r["seated"], np.int64)
        some = [i for i in np.flatnonzero(t > 0) if words[i] != STOP]
        cells, n = spelling_cells([words[i] for i in some], t[some])
        for k in range(PARTS):
            own = cells % PARTS == k
            yield _batch(_CELLS_ARROW, {"part": k, "tag": r["shard"], "cells": _pack(cells[own], np.int64), "n": _pack(n[own], np.int64)})


def _merge_cells(key: tuple, rows: pa.Table) -> pa.Table:
    found = rows.to_pylist()
    cells, back = np.unique(np.concatenate([_open(r["cells"], np.int64) for r in found]), return_inverse=True)
    n = np.bincount(back, np.concatenate([_open(r["n"], np.int64) for r in found]), len(cells))
    return pa.Table.from_pylist([{"part": found[0]["part"], "tag": found[0]["tag"], "cells": _pack(cells, np.int64), "n": _pack(n, np.int64)}], _CELLS_ARROW)


def _spelling(words: DataFrame, work: Workspace, name: str, rng: np.random.Generator) -> Spelling:
    parts = fold(words.select("shard", "words", "seated").mapInArrow(_cells_of, _CELLS), "part", ["tag"], _merge_cells, work, name)
    found = parts.collect()
    cells, n = (np.concatenate([np.zeros(0, np.int64), *(_open(r[k], np.int64) for r in found)]) for k in ("cells", "n"))
    by = np.argsort(cells)
    model = Spelling(cells[by], n[by], ORDER)
    for _ in range(SPELLING_SWEEPS):
        model.sweep(rng)
    return model.frozen()


# --- scores --------------------------------------------------------------------------

_LAST = "block long, kind int, sender int, a binary, b binary, c binary"
_LAST_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("sender", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
OF_PAIRS, OF_WORDS = 0, 1


def own_weights(c: np.ndarray, total: np.ndarray, d: float) -> np.ndarray:
    """Customers of pairs less the discount of their tables; total: tables of those with more than one customer, over all samples."""
    out = np.where(c == 1, 1 - d, 0.0)
    out[c > 1] = c[c > 1] - d * total / SAMPLES
    return out


def _last_of_pairs(d: float):
    def run(key: tuple, rows: pa.Table, seated: pa.Table) -> pa.Table:
        r = rows.to_pylist()[0]
        out = own_weights(_open(r["c"], np.int64), _open(seated.column("total")[0].as_py(), np.int64), d).astype(np.float32)[_open_rising(r["at"])]
        ends = r["ends"]
        return pa.Table.from_pylist([{"block": b, "kind": OF_PAIRS, "sender": r["shard"], "a": _pack(out[i:j], np.float32)} for b, i, j in zip(r["blocks"], [0, *ends], ends, strict=False)], _LAST_ARROW)

    return run


def averages(x: Words, state: State) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the parent's probabilities over all samples, and tables of contexts added up over them; state: of the last one."""
    p = (x.p + x.served(state)) / SAMPLES
    return np.log10(p) + np.where(x.customers > 0, 0, x.extra / np.log(10)), x.insides + x.inside


def shares(c: np.ndarray, insides: np.ndarray, d: float) -> np.ndarray:
    """The weights of the parent in contexts with c customers."""
    return (THETA + d * insides / SAMPLES) / (THETA + c)


def _last_of_words(state: State):
    def run(key: tuple, rows: pa.Table, routes: pa.Table) -> pa.Table:
        x, r = Words(rows.to_pylist()[0]), routes.to_pylist()[0]
        at, ends = _open_rising(r["at"]), r["ends"]
        p, insides = averages(x, state)
        cut = [(block, at[i:j]) for block, i, j in zip(r["blocks"], [0, *ends], ends, strict=False)]
        return pa.Table.from_pylist([{"block": block, "kind": OF_WORDS, "sender": r["shard"], "a": _pack(x.c[k], np.int64), "b": _pack(p[k], np.float32), "c": _pack(insides[k], np.int64)} for block, k in cut], _LAST_ARROW)

    return run


def mixture(own: np.ndarray, c: np.ndarray, log_p: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 probabilities of pairs: of their own weight, their context's customers and share of the parent, and their word's log10 probability there."""
    rest = np.log10(share) + log_p
    seen = own > 0
    return np.where(seen, np.log10(np.where(seen, own, 1) / (THETA + c) + 10.0**rest), rest)


def _score(shards: int, state: State):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        r = rows.to_pylist()[0]
        got = sorted(answers.to_pylist(), key=lambda x: (x["kind"], x["sender"]))
        b = Block(r, shards)
        own = np.concatenate([_open(x["a"], np.float32) for x in got if x["kind"] == OF_PAIRS])
        words = [x for x in got if x["kind"] == OF_WORDS]
        c, insides = (np.concatenate([_open(x[k], np.int64) for x in words]) for k in ("a", "c"))
        log_p = np.concatenate([_open(x["b"], np.float32) for x in words]).astype(float)
        share, p = shares(c, insides, state.d), np.empty(len(own))
        for i in range(0, len(own), RUN):
            k = slice(i, i + RUN)
            p[k] = mixture(own[k].astype(float), c[b.u[k]], log_p[b.w[k]], share[b.u[k]])
        known, base = (c > 0).astype(np.int64), np.log10((c + 1) / (state.n + state.v + 1))
        sums = [np.add.reduceat(x[at], b.starts) for x, at in ((known, b.tokens), (base, b.tokens), (p, b.at))]
        columns = [pa.array(r["ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(b.sizes), pa.array(sums[0]), pa.array(np.full(len(b.sizes), state.n)), *(pa.array(x) for x in (sums[1], sums[2], -sums[2] / b.sizes))]
        return pa.table(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, log10_perplexity double"


@dataclass
class Model:
    """Tables of a fitted model, and the state of its last sample."""

    blocks: DataFrame
    pairs: DataFrame
    seated: DataFrame
    routes: DataFrame
    words: DataFrame
    state: State
    pair_shards: int


def fit(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, seed: int = 1) -> Model | None:
    """Counts and seats all texts; None without rows."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    rows = with_uid(docs).select(UID, F.col(id_col).cast("long").alias(OWN + "id"), held.alias(OWN + "held"), F.col(text_col).alias("text"))
    blocks = work.save(rows.mapInArrow(_blocks, _BLOCKS), "blocks")
    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    if not size.tokens:
        return None
    pair_shards, word_shards = max(4, -(-size.tokens // SHARD_TOKENS)), max(4, -(-size.words // SHARD_WORDS))

    pairs = work.save(blocks.mapInArrow(_send_pairs(pair_shards), _PAIR_PACKETS).groupBy("shard").applyInArrow(_merge_pairs, _PAIRS), "pairs")
    release(spark)
    counts = pairs.agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
    sent = blocks.select("block", "held", "sizes", "tokens", "words").mapInArrow(_send_words(word_shards), _WORD_PACKETS)
    told = pairs.select(*_SEATED_COLUMNS, "single", "su", "sw").mapInArrow(_send_tables(word_shards, True), _WORD_PACKETS)
    merged = work.save(sent.unionByName(told).groupBy("shard").applyInArrow(_merge_words, _WORDS), "words")
    release(spark)
    words = merged.drop(*_ROUTES)
    state = _state(words, discount(counts.ones, counts.twos))
    rng = np.random.default_rng(seed)
    model = spark.sparkContext.broadcast(_spelling(words, work, "cells_", rng))
    words = work.save(words.mapInArrow(_seat_first(model, state, seed), _SHARD), "words_first")
    seated, previous = pairs.select(*_SEATED_COLUMNS), ("", "words_first")
    for i in range(BURN_IN + SAMPLES):
        state = _state(words, state.d, state.d0)
        answers = words.mapInArrow(_answer_pairs(state), _ANSWERS)
        seated = work.save(seated.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_seat_pairs(state, seed + i + 1, i >= BURN_IN), _SEATED), f"seated{i}")
        model = spark.sparkContext.broadcast(_spelling(words, work, f"cells{i}_", rng))
        told = seated.mapInArrow(_send_tables(word_shards, False), _WORD_PACKETS)
        words = work.save(words.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_seat_words(model, state, seed + i + 1, i > BURN_IN), _SHARD), f"words{i}")
        for name in filter(None, previous):
            work.drop(name)
        previous = (f"seated{i}", f"words{i}")
        release(spark)
    return Model(blocks, pairs, seated, merged.select("shard", *_ROUTES), words, _state(words, state.d, state.d0), pair_shards)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), log10_perplexity.

    Documents whose crc32(id as text) mod folds is held_fold are held out.
    """
    found = fit(docs, Workspace(docs.sparkSession, "hpy"), id_col, text_col, folds, held_fold, seed)
    if found is None:
        return docs.sparkSession.createDataFrame([], _SCORED)
    state = found.state
    routes = found.pairs.select("shard", "blocks", "ends", "at", "c").groupBy("shard")
    answers = routes.cogroup(found.seated.select("shard", "total").groupBy("shard")).applyInArrow(_last_of_pairs(state.d), _LAST)
    answers = answers.unionByName(found.words.groupBy("shard").cogroup(found.routes.groupBy("shard")).applyInArrow(_last_of_words(state), _LAST))
    blocks = found.blocks.select("block", "ids", "held", "sizes", "tokens", "words")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(found.pair_shards, state), _SCORED)
