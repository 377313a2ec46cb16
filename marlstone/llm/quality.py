"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted text: documents labelled good and not toxic.  The model is trained on all of them, and all of them set the
thresholds, each by its score under the counts without its own (the discounts, and the size of the vocabulary and of its
counts, stay those of all).

    p1(w) = less1(c1(w)) / C1 + g1 / (V + 1)
    p2(w | v) = less2(c2(v, w)) / C2(v) + g2(v) p1(w)
    p3(w | u, v) = less3(c3(u, v, w)) / C3(u, v) + g3(u, v) p2(w | v)

c3 counts occurrences, the lower orders left contexts, except after the start, which has only itself to its left; less
takes a discount off, C are sums over a context, and g(context) is the weight of what its discounts leave.

Where things happen: texts are cut into blocks of about BLOCK_BYTES, trusted ones apart from others.  The model stays in
shards, by KEY_BITS bits of a checksum of the n-gram, and is never gathered.  In each of three rounds every block sends its distinct
n-grams to the shards, trusted blocks with what they add to the counts, and gets the sums back.  First trigrams;
then pairs, as the block that a shard names owner of a trigram adds it to its two pairs; then words, in the same way from pairs.  With
the three answers a block scores its texts.  Only a bit a row (whether it is trusted) and some sums are gathered.

A document is rejected if its log10 perplexity exceeds its language's threshold: the `quantile` of
trusted documents of the language plus `slack`, and plus SPREAD / sqrt(tokens), as the mean over a few tokens
strays further.  A language with fewer than LEAST_HELD of
those takes the threshold of all languages together; without any trusted text nothing is rejected but
texts without words.

Defined results: null text counts as empty; texts without words are rejected; a null language is a language of its
own; of an id's several labels the worst counts; rows that repeat an id share its labels, and each is trained on; extra columns are kept by
`filter_documents` and ignored elsewhere; empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, UID, Workspace, batches, keep_rows, release, sliced, with_uid
from .pitman_yor import _cuts, _pack, _pack_rising
from .pitman_yor import _open as _open_as
from .shingles import chunks, mixed, word_hashes

QUANTILE = 0.995
SLACK = 0.05
LEAST_HELD = 50
SPREAD = 1.2
#: Bytes of text in a block, and tokens for which one shard is made.
BLOCK_BYTES, SHARD_TOKENS = 1 << 23, 1 << 20
KEY_BITS = 48
#: The last visit to the blocks is made in so many turns, and texts are scored without their own counts in runs of about so many tokens, to hold less at a time.
TURNS, RUN_TOKENS = 4, 1 << 16
#: Codes, and places in a block, of the padding before a text and of the token after it; words follow.
START, STOP, FIRST = 0, 1, 2
#: What a shard sums for each trigram, pair and word: the n-gram's own count is last.  Before it, of the n-gram as a
#: context: the sum of its counts, and how many are 1, 2 and more.
TRIGRAMS, PAIRS, WORDS = 1, 2, 3
_WIDTH = {TRIGRAMS: 1, PAIRS: 5, WORDS: 5}
_STATE = 0
#: Answers per shard of words, pairs and trigrams: words repeat most.
_REPEATS = {TRIGRAMS: 1, PAIRS: 1, WORDS: 4}


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All trusted ids as doc_id."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select("doc_id")


# --- blocks ------------------------------------------------------------------------


def _open(data: bytes) -> np.ndarray:
    """In four bytes where that is enough."""
    return _open_as(data, np.int32 if data[0] <= 4 else np.int64)


def _open_rising(data: bytes) -> np.ndarray:
    return np.cumsum(_open(data), dtype=np.int64)


def _pack_sums(columns: list[np.ndarray]) -> list[bytes]:
    """Of an n-gram as a context and its own count: what the classes leave of the sum, and how the count differs from their number, are mostly 0."""
    if len(columns) == 1:
        return [_pack(columns[0])]
    total, one, two, more, c = columns
    return [_pack(x) for x in (total - one - 2 * two - 3 * more, one, two, more, c - one - two - more)]


def _open_sums(data: list[bytes]) -> list[np.ndarray]:
    if len(data) == 1:
        return [_open(data[0])]
    total, one, two, more, c = (_open_as(x, np.int64) for x in data)
    return [_narrow(x) for x in (total + one + 2 * two + 3 * more, one, two, more, c + one + two + more)]


def _narrow(x: np.ndarray) -> np.ndarray:
    """In four bytes where that is enough; x: not negative."""
    return x.astype(np.int32) if not len(x) or int(x.max()) < 1 << 31 else x


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    by = np.argsort(x)
    y = x[by]
    fresh = np.ones(len(y), bool)
    fresh[1:] = y[1:] != y[:-1]
    at = np.empty(len(x), np.int32)
    place = np.cumsum(fresh, dtype=np.int32)
    place -= 1
    at[by] = place
    return y[fresh], at


def _key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (mixed(first * np.uint64(0x9E3779B97F4A7C15) + last) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


class Block:
    """Texts as places among the block's words, which are in order of their codes; distinct pairs and trigrams in order of their keys."""

    def __init__(self, rows: tuple, words: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        self.rows, self.words, self.at, self.sizes = rows, words, at, sizes

    @classmethod
    def of(cls, rows: tuple, codes: np.ndarray, sizes: np.ndarray) -> Block:
        words, at = _distinct(np.concatenate((np.array([START, STOP]), codes)))
        return cls(rows, words, at[FIRST:], sizes)

    def message(self) -> list[bytes]:
        return [zstandard.compress(pickle.dumps(self.rows)), _pack_rising(self.words), _pack(self.at), _pack(self.sizes)]

    @classmethod
    def opened(cls, data: list[bytes]) -> Block:
        return cls(pickle.loads(zstandard.decompress(data[0])), _open_rising(data[1]), _open(data[2]), _open(data[3]))

    def number(self, trigrams: bool = True) -> Block:
        """Finds the distinct pairs, and the trigrams."""
        ends = np.cumsum(self.sizes + 3)
        first = ends - self.sizes - 3
        x = np.full(int(ends[-1]), -1, np.int32)
        x[first] = x[first + 1] = START
        x[ends - 1] = STOP
        x[x < 0] = self.at
        self.x, self.doc = x, np.repeat(np.arange(len(first), dtype=np.int32), self.sizes + 3)
        # Pairs end anywhere but at a text's first place, trigrams (that is, tokens) beyond its second.
        two = np.ones(len(x), bool)
        two[first] = False
        two = np.flatnonzero(two).astype(np.int32)
        codes = self.words.astype(np.uint64)
        mix = mixed(codes)
        self.pairs, place = _distinct(_key(codes[x[two - 1]], mix[x[two]]))
        self.two, self.pair = two, np.zeros(len(x), np.int32)
        self.pair[two] = place
        self.before, self.last = np.empty(len(self.pairs), np.int32), np.empty(len(self.pairs), np.int32)
        self.before[place], self.last[place] = x[two - 1], x[two]
        if trigrams:
            three = np.ones(len(x), bool)
            three[first] = three[first + 1] = False
            self.three = three = np.flatnonzero(three).astype(np.int32)
            self.trigrams, self.trigram = _distinct(_key(self.pairs[self.pair[three - 1]].astype(np.uint64), mix[x[three]]))
            self.context, self.suffix = np.empty(len(self.trigrams), np.int32), np.empty(len(self.trigrams), np.int32)
            self.context[self.trigram], self.suffix[self.trigram] = self.pair[three - 1], self.pair[three]
        return self

    def keys(self, level: int) -> np.ndarray:
        return {TRIGRAMS: lambda: self.trigrams, PAIRS: lambda: self.pairs, WORDS: lambda: self.words}[level]()


def _blocks(rows: Iterator[pa.RecordBatch], bits: dict[int, bytes] | None, kinds: tuple[bool, ...]) -> Iterator[tuple[int, Block]]:
    """Blocks and their names, odd for trusted text.  Without `bits` all rows are trusted."""
    open_bits: dict[int, np.ndarray] = {}

    def trusted(uid: int) -> bool:
        if bits is None:
            return True
        part, row = uid >> 33, uid & ((1 << 33) - 1)
        if part not in open_bits:
            open_bits[part] = np.frombuffer(zstandard.decompress(bits[part]) if part in bits else b"", np.uint8)
        return row >> 3 < len(open_bits[part]) and bool(open_bits[part][row >> 3] >> (row & 7) & 1)

    held: dict[bool, list] = {k: [] for k in kinds}

    def made(kind: bool) -> tuple[int, Block]:
        uids, ids, langs, codes, sizes = (list(c) for c in zip(*held[kind], strict=True))
        held[kind].clear()
        flat = (sum(uids, []), sum(ids, []), sum(langs, []))
        return flat[0][0] << 1 | kind, Block.of(flat, np.concatenate(codes), np.concatenate(sizes))

    size = dict.fromkeys(kinds, 0)
    for columns in batches(sliced(rows), [UID, OWN + "id", "lang", "text"]):
        flags = [trusted(u) for u in columns[0]]
        for kind in kinds:
            uids, ids, langs, texts = ([x for x, f in zip(c, flags, strict=True) if f is kind] for c in columns)
            for first, part in chunks(texts):
                hashes, sizes = word_hashes(part)
                codes = np.maximum(hashes >> np.uint64(64 - KEY_BITS), np.uint64(FIRST)).astype(np.int64)
                end = first + len(part)
                held[kind].append((uids[first:end], ids[first:end], langs[first:end], codes, sizes))
                size[kind] += sum(map(len, part))
                if size[kind] >= BLOCK_BYTES:
                    yield made(kind)
                    size[kind] = 0
    for kind in kinds:
        if held[kind]:
            yield made(kind)


_MESSAGE = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("data", pa.list_(pa.binary()))])
_PACKET = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.list_(pa.binary()))])
_ANSWER = _MESSAGE.append(pa.field("sums", pa.list_(pa.int64())))
_MESSAGE_SQL = "block long, kind int, shard int, data array<binary>"
_PACKET_SQL = "shard int, block long, keys binary, counts array<binary>"


def _states(bits, kinds: tuple[bool, ...]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in _blocks(rows, bits and bits.value, kinds):
            yield pa.RecordBatch.from_pylist([{"block": name, "kind": _STATE, "shard": 0, "data": b.message()}], _MESSAGE)

    return run


def _packets(name: int, keys: np.ndarray, counts: np.ndarray | None, shards: int) -> list[dict]:
    """A block's n-grams, shard by shard; counts has a row for each."""
    shard = ((keys >> (KEY_BITS - 32)) * shards) >> 32
    return [{"shard": s, "block": name, "keys": _pack_rising(keys[a:z]), "counts": [] if counts is None else _pack_sums(list(counts[a:z].T))} for s, a, z in _cuts(shard)]


def _ask(bits, level: int, shards: int):
    """What blocks send in a round without having heard of an earlier one: all blocks their trigrams, others than trusted ones pairs and words."""
    kinds = (False, True) if level == TRIGRAMS else (False,)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b in _blocks(rows, bits and bits.value, kinds):
            if level != WORDS:
                b.number(level == TRIGRAMS)
            keys = b.keys(level)
            counts = np.bincount(b.trigram, minlength=len(keys))[:, None] if name & 1 else None
            yield pa.RecordBatch.from_pylist(_packets(name, keys, counts, shards), _PACKET)

    return run


def _heard(rows: pa.Table) -> tuple[Block, dict[int, list[np.ndarray]]]:
    """A block, and of each level it heard of the sums' columns, then (if it is trusted) what it owns."""
    rows = rows.select(["kind", "shard", "data"]).to_pylist()
    got = {level: sorted((r for r in rows if r["kind"] == level), key=lambda r: r["shard"]) for level in _WIDTH}
    state = next(r["data"] for r in rows if r["kind"] == _STATE)
    del rows
    b, heard = Block.opened(state), {}
    for level, found in got.items():
        if found:
            parts = [[*_open_sums(r["data"][: _WIDTH[level]]), *map(_open, r["data"][_WIDTH[level] :])] for r in found]
            found.clear()
            heard[level] = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return b, heard


def _classes(of: np.ndarray, c: np.ndarray, n: int) -> list[np.ndarray]:
    """For each of n contexts how many counts are 1, 2 and more; of: each count's context."""
    return [np.bincount(of[m], minlength=n) for m in (c == 1, c == 2, c > 2)]


def _sum_at(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, x, n).astype(np.int64)


def _add(level: int, shards: int):
    """What a trusted block adds to pairs, having heard of trigrams, or to words, having heard of pairs."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        b, heard = _heard(rows)
        b.number(level == PAIRS)
        *_, c, own = heard[level - 1]
        own = np.flatnonzero(own)
        c, keys = c[own], b.keys(level)
        n = len(keys)
        if level == PAIRS:
            of, last = b.context[own], b.suffix[own]
            count = _sum_at(last, np.where(b.before[last] == START, c, 1), n)
        else:
            of, last = b.before[own], b.last[own]
            count = np.bincount(last, minlength=n)
        counts = np.stack([_sum_at(of, c, n), *_classes(of, c, n), count], axis=1)
        return pa.Table.from_pylist(_packets(key[0].as_py(), keys, counts, shards), _PACKET)

    return run


def _total(level: int):
    """Sums of a shard's n-grams, sent back to each block in the order of its own; the owner of an n-gram is one of the blocks that count it."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        names, packets = rows.column("block").to_pylist(), rows.column("counts").to_pylist()
        parts = [_open_rising(k) for k in rows.column("keys").to_pylist()]
        known, at = _distinct(np.concatenate(parts))
        places = np.split(at, np.cumsum([len(p) for p in parts])[:-1])
        sums = np.zeros((len(known), _WIDTH[level]), np.int64)
        owner = np.full(len(known), -1, np.int32)
        for i, (p, counts) in enumerate(zip(places, packets, strict=True)):
            if counts:
                counts = _open_sums(counts)
                for k, c in enumerate(counts):
                    sums[p, k] += c
                owner[p[counts[-1] > 0]] = i
        c = sums[:, -1]
        tally = [*(int((c == k).sum()) for k in (1, 2, 3, 4)), int((c > 0).sum()), int(c.sum())]
        out = []
        for i, (name, p) in enumerate(zip(names, places, strict=True)):
            data = _pack_sums(list(sums[p].T))
            if name & 1:
                data.append(_pack((owner[p] == i).astype(np.int8), np.int8))
            out.append({"block": name, "kind": level, "shard": key[0].as_py(), "data": data, "sums": [] if i else tally})
        return pa.Table.from_pylist(out, _ANSWER)

    return run


# --- the model ---------------------------------------------------------------------


@dataclass
class Model:
    """Discounts of words, pairs and trigrams, the sum of words' counts, and what an unknown word has."""

    d1: np.ndarray
    d2: np.ndarray
    d3: np.ndarray
    total: int
    floor: float


def _discounts(n: list[int]) -> np.ndarray:
    """0, D1, D2 and D3+ from the counts of counts; half of each where the data are too few."""
    n1, n2, n3, n4 = n[:4]
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def _model(sums: dict[int, list[int]]) -> Model:
    d1, d2, d3 = (_discounts(sums[level]) for level in (WORDS, PAIRS, TRIGRAMS))
    n1, n2, _, _, v, total = sums[WORDS]
    if not v:
        return Model(d1, d2, d3, 1, 1e-7)
    return Model(d1, d2, d3, total, float((d1[1] * n1 + d1[2] * n2 + d1[3] * (v - n1 - n2)) / total / (v + 1)))


def _interpolated(c: np.ndarray, d: np.ndarray, of: np.ndarray, context: list[np.ndarray], lower: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities from counts, the statistics of their contexts (of: which one) and probabilities of the order below (at: which one)."""
    total = np.maximum(context[0], 1)
    weight = np.where(context[0] > 0, sum(n * x for n, x in zip(context[1:4], d[1:], strict=True)) / total, 1.0)
    out = np.empty(len(c))
    for i in range(0, len(c), 1 << 16):
        k = slice(i, i + (1 << 16))
        out[k] = (c[k] - d[np.minimum(c[k], 3)]) / total[of[k]] + weight[of[k]] * lower[at[k]]
    return out


def _probabilities(m: Model, words: list, pairs: list, c3: np.ndarray, before: np.ndarray, last: np.ndarray, context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Of trigrams; before and last: words of a pair; context and suffix: pairs of a trigram."""
    c1, c2 = words[4], pairs[4]
    p1 = (c1 - m.d1[np.minimum(c1, 3)]) / m.total + m.floor
    p2 = _interpolated(c2, m.d2, before, words, p1, last)
    return _interpolated(c3, m.d3, context, pairs, p2, suffix)


def _log10(m: Model, b: Block, heard: dict[int, list[np.ndarray]]) -> np.ndarray:
    """log10 probability of each text."""
    p = _probabilities(m, heard[WORDS], heard[PAIRS], heard[TRIGRAMS][0], b.before, b.last, b.context, b.suffix)
    return np.bincount(b.doc[b.three], np.log10(p)[b.trigram], len(b.sizes))


def _log10_without(m: Model, b: Block, heard: dict[int, list[np.ndarray]]) -> np.ndarray:
    """log10 probability of each trained text under the counts of all others."""
    ends = np.cumsum(b.sizes + 3)
    edges = np.flatnonzero(np.diff((ends - 1) // RUN_TOKENS, append=-1)) + 1
    return np.concatenate([_run_without(m, b, heard, first, end) for first, end in zip([0, *edges[:-1]], edges, strict=True)])


def _run_without(m: Model, b: Block, heard: dict[int, list[np.ndarray]], first: int, end: int) -> np.ndarray:
    """The same of a run of texts."""
    low, high = np.searchsorted(b.doc, [first, end])
    doc, x = b.doc[low:high] - first, b.x[low:high]
    two = b.two[slice(*np.searchsorted(b.two, [low, high]))]
    some = slice(*np.searchsorted(b.three, [low, high]))
    three, trigram = b.three[some] - low, b.trigram[some]
    pair, two = b.pair[two], two - low
    words, word = _distinct(doc * np.int64(len(b.words)) + x)
    pairs, pair = _distinct(doc[two] * np.int64(len(b.pairs)) + pair)
    trigrams, trigram = _distinct(doc[three] * np.int64(len(b.trigrams)) + trigram)
    at = np.zeros(len(x), np.int64)
    at[two] = pair
    before, last = np.empty(len(pairs), np.int64), np.empty(len(pairs), np.int64)
    before[pair], last[pair] = word[two - 1], word[two]
    context, suffix = np.empty(len(trigrams), np.int64), np.empty(len(trigrams), np.int64)
    context[trigram], suffix[trigram] = at[three - 1], at[three]
    of = trigrams // len(b.trigrams)
    words, pairs, trigrams = words % len(b.words), pairs % len(b.pairs), trigrams % len(b.trigrams)

    own, was = np.bincount(trigram, minlength=len(trigrams)), heard[TRIGRAMS][0][trigrams]
    c3 = was - own
    n = len(pairs)
    total, *classes, c2_was = (c[pairs] for c in heard[PAIRS][:5])
    classes = [c - x + y for c, x, y in zip(classes, _classes(context, was, n), _classes(context, c3, n), strict=True)]
    gone = _sum_at(suffix, np.where(words[before[suffix]] == START, own, c3 == 0), n)
    c2 = c2_was - gone
    of_pairs = [total - _sum_at(context, own, n), *classes, c2]

    n = len(words)
    total, *classes, c1 = (c[words] for c in heard[WORDS][:5])
    classes = [c - x + y for c, x, y in zip(classes, _classes(before, c2_was, n), _classes(before, c2, n), strict=True)]
    c1 = c1 - _sum_at(last, (c2_was > 0) & (c2 == 0), n)
    of_words = [total - _sum_at(before, gone, n), *classes, c1]
    p = _probabilities(m, of_words, of_pairs, c3, before, last, context, suffix)
    return np.bincount(of, own * np.log10(p), end - first)


_SCORED = pa.schema([(UID, pa.int64()), (OWN + "id", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("log10_prob", pa.float64()), (OWN + "without", pa.float64())])
_SCORED_SQL = f"{UID} long, {OWN}id long, lang string, n_tokens long, log10_prob double, {OWN}without double"


def _score(m: Model):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        b, heard = _heard(rows)
        b.number()
        without = _log10_without(m, b, heard) if key[0].as_py() & 1 else [None] * len(b.sizes)
        uids, ids, langs = b.rows
        columns = [uids, ids, langs, b.sizes + 1, _log10(m, b, heard), without]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED)

    return run


def _counted(docs: DataFrame, bits, work: Workspace) -> tuple[Model, dict[int, DataFrame]]:
    """The rounds: the model's few numbers, and the shards' answers."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") / 6 + 1), F.lit(0)).alias("tokens")).first()["tokens"]
    sums, answers = {}, {}
    for level in (TRIGRAMS, PAIRS, WORDS):
        shards = max(4, int(-(-size // (SHARD_TOKENS * _REPEATS[level]))))
        packets = docs.mapInArrow(_ask(bits, level, shards), _PACKET_SQL)
        if level != TRIGRAMS:
            told = docs.mapInArrow(_states(bits, (True,)), _MESSAGE_SQL).unionByName(answers[level - 1].where("block % 2 != 0"))
            packets = packets.unionByName(told.groupBy("block").applyInArrow(_add(level, shards), _PACKET_SQL))
        found = work.save(packets.groupBy("shard").applyInArrow(_total(level), _MESSAGE_SQL + ", sums array<long>"), f"answers{level}")
        row = found.where("size(sums) > 0").agg(*(F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(6))).first()
        sums[level], answers[level] = list(row), found.drop("sums")
        del packets, found
        release(work.spark)
    return _model(sums), answers


def _messages(docs: DataFrame, bits, answers: dict[int, DataFrame], turn: int) -> DataFrame:
    """The blocks of a turn, which are those of every TURNS-th scan partition, and all answers to them."""
    out = docs.where(F.pmod(F.shiftright(UID, 33), F.lit(TURNS)) == turn).mapInArrow(_states(bits, (False, True)), _MESSAGE_SQL)
    for found in answers.values():
        out = out.unionByName(found.where(F.pmod(F.shiftright("block", 34), F.lit(TURNS)) == turn))
    return out


# --- a model in one place ------------------------------------------------------------


def _tables(key: tuple, rows: pa.Table) -> pa.Table:
    b, heard = _heard(rows)
    b.number()
    out = [{"block": 0, "kind": level, "shard": 0, "data": [_pack_rising(b.keys(level)), *(_pack(c) for c in heard[level][: _WIDTH[level]])]} for level in _WIDTH]
    return pa.Table.from_pylist(out, _MESSAGE)


def train(texts: DataFrame, work: Workspace) -> dict:
    """The model of a few texts (text), gathered for a `Scorer`; `judged` leaves it in shards."""
    docs = with_uid(work.save(texts.select("text"), "texts")).select(UID, F.lit(None).cast("long").alias(OWN + "id"), F.lit(None).cast("string").alias("lang"), "text")
    m, answers = _counted(docs, None, work)
    got = [r for k in range(TURNS) for r in _messages(docs, None, answers, k).groupBy("block").applyInArrow(_tables, _MESSAGE_SQL).collect()]
    model: dict = {"model": m}
    for level, width in _WIDTH.items():
        columns = [np.concatenate([np.zeros(0, np.int64), *((_open if k else _open_rising)(r["data"][k]) for r in got if r["kind"] == level)]).astype(np.int64) for k in range(width + 1)]
        keys, first = np.unique(columns[0], return_index=True)
        model[level] = [keys, *(c[first] for c in columns[1:])]
    return model


class Scorer:
    """A gathered model, ready to look n-grams up."""

    def __init__(self, model: dict):
        self.m = model

    def log10(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and number of tokens (the end with them) of each text."""
        rows = pa.RecordBatch.from_pydict({UID: list(range(len(texts))), OWN + "id": [None] * len(texts), "lang": [None] * len(texts), "text": texts})
        scores, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, b in _blocks(iter([rows]), None, (True,)):
            b.number()
            heard = {}
            for level in _WIDTH:
                known, *columns = self.m[level]
                at = np.minimum(np.searchsorted(known, b.keys(level)), max(len(known) - 1, 0))
                hit = known[at] == b.keys(level) if len(known) else np.zeros(len(at), bool)
                heard[level] = [np.where(hit, c[at] if len(c) else 0, 0) for c in columns]
            scores.append(_log10(self.m["model"], b, heard))
            sizes.append(b.sizes + 1)
        return np.concatenate(scores), np.concatenate(sizes)


# --- the query -----------------------------------------------------------------------


def _bits(key: tuple, rows: pa.Table) -> pa.Table:
    at = rows.column("row").to_numpy()
    flags = np.zeros(int(at.max()) + 1, bool)
    flags[at] = True
    return pa.Table.from_pylist([{"part": key[0].as_py(), "bits": zstandard.compress(np.packbits(flags, bitorder="little").tobytes())}], pa.schema([("part", pa.int64()), ("bits", pa.binary())]))


def _trusted_rows(docs: DataFrame, labels: DataFrame) -> dict[int, bytes]:
    """A bit for each row of each scan partition: whether it is trusted.  This is gathered: one megabyte for eight million rows at most."""
    good = docs.select(UID, OWN + "id").join(trusted_ids(labels).withColumnRenamed("doc_id", OWN + "id"), OWN + "id", "left_semi")
    rows = good.select(F.shiftright(UID, 33).alias("part"), F.col(UID).bitwiseAND((1 << 33) - 1).alias("row"))
    return {r["part"]: bytes(r["bits"]) for r in rows.groupBy("part").applyInArrow(_bits, "part long, bits binary").collect()}


def scored(docs: DataFrame, labels: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: UID, id, lang, n_tokens, log10_prob, and of trusted ones log10_prob without their own counts."""
    spark = docs.sparkSession
    docs = docs.select(UID, F.col(id_col).cast("long").alias(OWN + "id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    bits = spark.sparkContext.broadcast(_trusted_rows(docs, labels))
    model, answers = _counted(docs, bits, work)
    parts = []
    for k in range(TURNS):
        parts.append(work.save(_messages(docs, bits, answers, k).groupBy("block").applyInArrow(_score(model), _SCORED_SQL), f"scored{k}"))
        release(spark)
    for level in _WIDTH:
        work.drop(f"answers{level}")
    return reduce(DataFrame.unionByName, parts)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: UID, id, lang, n_tokens, log10_prob, log10_perplexity, threshold, kept.  `docs` must have UID."""
    work = Workspace(docs.sparkSession, "quality")
    rows = scored(docs, labels, work, id_col, text_col, lang_col).withColumn("log10_perplexity", -F.col("log10_prob") / F.col("n_tokens"))
    trusted = rows.where(f"n_tokens > 1 AND {OWN}without IS NOT NULL")
    cut = F.percentile_approx(-F.col(OWN + "without") / F.col("n_tokens"), F.lit(quantile), F.lit(100_000))
    own = trusted.groupBy("lang").agg(cut.alias("own"), F.count("*").alias("n")).where(F.col("n") >= LEAST_HELD)
    # One row for each language that trusted text has.
    every = trusted.agg(cut.alias("every"))
    limits = work.save(own, "limits")
    joined = rows.join(limits.select(F.col("lang").alias(OWN + "lang"), "own"), F.col("lang").eqNullSafe(F.col(OWN + "lang")), "left").withColumn("every", F.lit(every.first()["every"]).cast("double"))
    threshold = (F.coalesce("own", "every") + slack + SPREAD / F.sqrt("n_tokens")).alias("threshold")
    out = joined.select(UID, OWN + "id", "lang", "n_tokens", "log10_prob", "log10_perplexity", threshold)
    return out.withColumn("kept", (F.col("n_tokens") > 1) & F.coalesce(F.col("log10_perplexity") <= F.col("threshold"), F.lit(True)))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """`docs` without the rejected rows; the columns are those of `docs`."""
    rows = with_uid(docs)
    return keep_rows(rows, judged(rows, labels, id_col=id_col, **how).where(~F.col("kept"))).drop(UID)
