"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles are counted over all documents, by
   hashed feature (2^20 of them, as hashing TF-IDF does), so the table of weights that is
   broadcast has one size for every input.
2. Each text gets K consistent weighted samples (Ioffe, 2010) of its weighted
   shingles.  The variates r, c and beta come from a table that the shingle's hash indexes;
   log weights are rounded to an eighth.  Equal samples have the probability of the weighted
   Jaccard similarity.
3. Samples are banded.  Copies of one text count as one, so buckets hold different
   texts; every text of a bucket is first linked to two leaders, whose choice differs
   between bands.
4. Links whose samples agree enough are verified: the weighted Jaccard similarity of the whole
   texts is at least 0.8.  One link per text goes first; the others only where they would join two groups.
5. Buckets whose other members still lie in several groups are settled in full: all their pairs
   between groups are compared, in pairs of blocks of about BLOCK texts.  A pair is compared in the first band
   where it meets; a large group has blocks of its own, which are not compared with each other.
6. Connected components of the verified links, and the copies, are the classes.

Defined results: null text counts as empty; texts without words are equal
to each other's exact copies only; the smallest id (nulls last) of a class stays, and the first
row where an id repeats; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, UID, Workspace, afresh, batches, fold, join_counted, keep_rows, with_uid
from .graph import components
from .shingles import chunks, mixed, shingles

FEATURE_BITS = 20
SLICES = 16
BANDS, ROWS = 16, 4
K = BANDS * ROWS
THRESHOLD = 0.8
#: Share of equal samples from which a link is verified (sampling error at 0.8: 0.05).
LEAST_SAMPLES = 0.5
#: Texts in a block of a bucket that the leaders did not settle.
BLOCK = 256
VARIATES = 1 << 14
LEVELS = 128

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_MASKS = [int(x) for x in np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 62, BANDS)]
_samples_table: list[np.ndarray] = []


def _distinct(sh: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts in the text, and how many each text has; sh is sorted within texts."""
    if not len(sh):
        return sh, np.zeros(0, np.int64), n
    starts = (np.cumsum(n) - n)[n > 0]
    first = np.ones(len(sh), bool)
    first[1:] = sh[1:] != sh[:-1]
    first[starts] = True
    at = np.flatnonzero(first)
    per = np.zeros(len(n), np.int64)
    per[n > 0] = np.add.reduceat(first.astype(np.int64), starts)
    return sh[at], np.diff(np.append(at, len(sh))), per


def _features(sh: np.ndarray) -> np.ndarray:
    return (sh >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _count_features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(1 << FEATURE_BITS, np.int64), 0
    for (texts,) in batches(afresh(rows), ["text"]):
        docs += len(texts)
        for _, part in chunks(texts):
            sh, _, _ = _distinct(*shingles(part))
            df += np.bincount(_features(sh), minlength=1 << FEATURE_BITS)
    if docs:
        yield _sliced(df, docs)


def _sliced(df: np.ndarray, docs: int) -> pa.RecordBatch:
    cut = [zlib.compress(x.astype(np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes(), 1) for x in np.split(df, SLICES)]
    wide = [int(x.max() >= 1 << 32) for x in np.split(df, SLICES)]
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(cut, pa.binary()), pa.array(wide, pa.int32()), pa.array([docs] * SLICES, pa.int64())], names=["slice", "df", "wide", "docs"])


_DF = "slice int, df binary, wide int, docs long"


def _opened(df: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(df), np.uint64 if wide else np.uint32).astype(np.int64)


def _add_slices(key: tuple, rows: pa.Table) -> pa.Table:
    found = rows.to_pylist()
    total = sum(_opened(r["df"], r["wide"]) for r in found)
    wide = int(total.max() >= 1 << 32)
    packed = zlib.compress(total.astype(np.uint64 if wide else np.uint32).tobytes(), 1)
    return pa.table([pa.array([found[0]["slice"]], pa.int32()), pa.array([packed], pa.binary()), pa.array([wide], pa.int32()), pa.array([sum(r["docs"] for r in found)], pa.int64())], names=["slice", "df", "wide", "docs"])


def document_frequencies(texts: DataFrame, work: Workspace) -> tuple[np.ndarray, int]:
    """Counts by feature and the number of documents, added up in a tree; the result has one size for every input."""
    parts = fold(texts.mapInArrow(_count_features, _DF), "slice", ["df", "docs"], _add_slices, work, "df")
    found = {r["slice"]: r for r in parts.collect()}
    if not found:
        return np.zeros(1 << FEATURE_BITS, np.int64), 0
    return np.concatenate([_opened(found[i]["df"], found[i]["wide"]) for i in range(SLICES)]), found[0]["docs"]


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    """Inverse document frequencies between 1 and 2: 1 + ln((1 + N) / (1 + df)) / ln(1 + N)."""
    scale = np.log1p(max(docs, 1))
    return (1 + np.maximum(0, np.log((1 + docs) / (1 + df))) / scale).astype(np.float32)


def _table() -> np.ndarray:
    """[level, variate]: rank of ln a in the upper half of 64 bits; a = c / (y e^r), y = e^(r (t - beta)), t = floor(ln w / r + beta)."""
    if not _samples_table:
        g = np.random.Generator(np.random.PCG64(99))
        r, c, beta = g.gamma(2, 1, VARIATES), g.gamma(2, 1, VARIATES), g.random(VARIATES)
        log_w = np.arange(LEVELS)[:, None] / 8
        log_a = (np.log(c) - r * (np.floor(log_w / r + beta) - beta + 1)).astype(np.float32)
        bits = log_a.view(np.uint32)
        ranked = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        _samples_table.append((ranked.astype(np.uint64) << np.uint64(32)).ravel())
    return _samples_table[0]


def samples(sh: np.ndarray, tf: np.ndarray, per: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(texts with shingles, K) samples; a sample is (rank of a, half of the shingle's hash)."""
    table, starts = _table(), (np.cumsum(per) - per)[per > 0]
    level = np.minimum(np.rint(8 * np.log(tf * idf[_features(sh)])), LEVELS - 1).astype(np.int64) * VARIATES
    out = np.empty((len(starts), K), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for k in range(K):
        h = (sh ^ _XOR[k]) * _MULTIPLY[k]
        a = table[(h >> np.uint64(50)).astype(np.int64) + level]
        h >>= np.uint64(16)
        h &= low
        a |= h
        out[:, k] = np.minimum.reduceat(a, starts)
    return out


_SIGNED = f"{UID} long, {OWN}id long, digest binary, bands array<long>, sig binary"


def _sign(idf):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = idf.value
        for uids, ids, texts in batches(afresh(rows), [UID, OWN + "id", "text"]):
            for first, part in chunks(texts):
                sh, tf, per = _distinct(*shingles(part))
                bands: list = [None] * len(part)
                sigs: list = [None] * len(part)
                if len(sh):
                    got = samples(sh, tf, per, own)
                    keys = got.reshape(-1, BANDS, ROWS)
                    mix = keys[:, :, 0]
                    for j in range(1, ROWS):
                        mix = mixed(mix * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, j])
                    short = (mixed(got) & np.uint64(255)).astype(np.uint8)
                    for i, b, s in zip(np.flatnonzero(per > 0), mix.view(np.int64).tolist(), short, strict=True):
                        bands[i], sigs[i] = b, s.tobytes()
                stop = first + len(part)
                digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts[first:stop]]
                yield pa.RecordBatch.from_arrays([pa.array(uids[first:stop], pa.int64()), pa.array(ids[first:stop], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=[UID, OWN + "id", "digest", "bands", "sig"])

    return run


def _agreeing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, K) for i in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= LEAST_SAMPLES))


def _elements(sh: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shingles with the number of their occurrence mixed in, so that a multiset becomes a set."""
    d, tf, _ = _distinct(sh, n)
    at = np.arange(len(sh)) - np.repeat(np.cumsum(tf) - tf, tf)
    return sh + at.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)


def similarity(sh: np.ndarray, n: np.ndarray, idf: np.ndarray):
    """A function of two indexes of texts: weighted Jaccard similarity of the multisets of shingles."""
    w, el = idf[_features(sh)].astype(np.float64), _elements(sh, n)
    ends = np.cumsum(n)

    def of(i: int, j: int) -> float:
        a, b = slice(ends[i] - n[i], ends[i]), slice(ends[j] - n[j], ends[j])
        common = np.isin(el[a], el[b], assume_unique=True)
        shared = w[a][common].sum()
        total = w[a].sum() + w[b].sum() - shared
        return shared / total if total else 0.0

    return of


def similarities(pairs: list[tuple[int, int]], texts: list[bytes], idf: np.ndarray) -> list[float]:
    """Weighted Jaccard similarity for pairs of indexes into texts."""
    of = similarity(*shingles(texts), idf)
    return [of(i, j) for i, j in pairs]


def _verify(idf, threshold: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids_a, ids_b, ta, tb = (c.to_pylist() for c in part.columns)
                place: dict[int, int] = {}
                texts: list[bytes] = []
                for u, t in zip([*ids_a, *ids_b], [*ta, *tb], strict=True):
                    if u not in place:
                        place[u] = len(texts)
                        texts.append(next(iter(chunks([t])))[1][0])
                got = similarities([(place[x], place[y]) for x, y in zip(ids_a, ids_b, strict=True)], texts, idf.value)
                yield part.select(["a", "b"]).filter(pa.array([s >= threshold for s in got], pa.bool_()))

    return run


def _maybe(filters, bits: int):
    """Rows whose UID may be in the filter."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(filters.value, np.uint8)
        for b in rows:
            h = mixed(b.column(0).to_numpy().astype(np.uint64))
            ok = np.ones(len(h), bool)
            for shift in (0, 20, 40):
                at = ((h >> np.uint64(shift)) % np.uint64(bits)).astype(np.int64)
                ok &= (held[at >> 3] >> (at & 7) & 1).astype(bool)
            yield b.filter(pa.array(ok))

    return run


FILTER_BITS = 1 << 24


def _node_filter(nodes: DataFrame) -> bytes:
    """A Bloom filter of 2 MiB over row ids.  Parts of it are set in several tasks and joined by bitwise OR."""

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, any_row = np.zeros(FILTER_BITS, np.uint8), False
        for b in rows:
            h = mixed(b.column(0).to_numpy().astype(np.uint64))
            for shift in (0, 20, 40):
                bits[((h >> np.uint64(shift)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
            any_row |= b.num_rows > 0
        if any_row:
            packed = np.packbits(bits, bitorder="little").view(np.int64)
            at = np.flatnonzero(packed)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], names=["at", "word"])

    words = nodes.mapInArrow(build, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toPandas()
    out[got["at"].to_numpy()] = got["word"].to_numpy()
    return out.tobytes()


def _texts(docs: DataFrame, nodes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """UID and text of the rows whose UID is in nodes."""
    bits = docs.sparkSession.sparkContext.broadcast(_node_filter(nodes))
    return work.save(docs.select(UID, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_maybe(bits, FILTER_BITS), f"{UID} long, text string").join(nodes, UID, "left_semi"), name)


def _verified(edges: DataFrame, docs: DataFrame, idf, threshold: float, work: Workspace, name: str) -> DataFrame:
    """The edges whose whole texts are similar enough; only texts on an edge are moved."""
    nodes = work.save(edges.select(F.explode(F.array("a", "b")).alias(UID)).distinct(), name + "_nodes")
    texts = _texts(docs, nodes, work, name + "_texts")
    with_b = edges.join(texts.select(F.col(UID).alias("b"), F.col("text").alias("tb")), "b")
    with_a = with_b.join(texts.select(F.col(UID).alias("a"), F.col("text").alias("ta")), "a")
    return work.save(with_a.select("a", "b", "ta", "tb").mapInArrow(_verify(idf, threshold), "a long, b long"), name)


def _candidates(rows: pa.Table) -> list[tuple[int, int]]:
    """Pairs of places in one task's rows that it has to decide: blocks and groups differ, samples agree, no earlier band has both."""
    side, root = (rows.column(c).to_numpy() for c in ("side", "root"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, K)
    bands = np.array(rows.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
    band, both = rows.column("band")[0].as_py(), bool((side > 0).any())
    out = []
    for i in np.flatnonzero(side == 0):
        others = np.flatnonzero(side == 1) if both else np.arange(i + 1, len(side))
        others = others[root[others] != root[i]]
        met = (bands[others, :band] == bands[i, :band]).any(axis=1)
        near = (sig[others] == sig[i]).mean(axis=1) >= LEAST_SAMPLES
        out += [(int(i), int(j)) for j in others[near & ~met]]
    return out


_TASK = f"task long, band int, side int, {UID} long, root long, bands array<long>, sig binary"


def _in_question(rows: pa.Table) -> pa.Table:
    """The rows of a task that some candidate has."""
    at = sorted({i for pair in _candidates(rows) for i in pair})
    return rows.take(pa.array(at, pa.int64()))


def _settle(idf, threshold: float):
    """Verified pairs of a task; pairs whose groups it has joined already are left out."""

    def run(rows: pa.Table) -> pa.Table:
        uids, roots = rows.column(UID).to_pylist(), rows.column("root").to_pylist()
        parts = [shingles(part) for _, part in chunks(rows.column("text").to_pylist())]
        similar = similarity(*(np.concatenate(x) for x in zip(*parts, strict=True)), idf.value)
        top = {r: r for r in roots}

        def find(r: int) -> int:
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        found = []
        for i, j in _candidates(rows):
            x, y = find(roots[i]), find(roots[j])
            if x != y and similar(i, j) >= threshold:
                top[x] = y
                found.append((uids[i], uids[j]))
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _unsettled(met: DataFrame, roots: DataFrame, signatures: DataFrame, work: Workspace) -> DataFrame:
    """_TASK rows: the members of two blocks (or of one) of a bucket whose members, without the leaders, lie in several groups.

    met: u, band, key, x, low, high.  Links to leaders have been decided by now.
    """
    rest = met.where("x <> low AND x <> high").select("band", "key", "u")
    rest = rest.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    groups = rest.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    pooled = F.coalesce(F.sum(F.when(F.col("n") < BLOCK, F.col("n"))), F.lit(0))
    open_ = groups.groupBy("band", "key").agg(F.count("*").alias("groups"), pooled.alias("pooled")).where("groups > 1").select("band", "key", "pooled")
    size = F.when(F.col("n") < BLOCK, F.col("pooled")).otherwise(F.col("n"))
    # Groups under BLOCK texts share the blocks of the owner -1.
    owned = groups.join(open_, ["band", "key"]).select("band", "key", "root", F.when(F.col("n") < BLOCK, -1).otherwise(F.col("root")).alias("owner"), F.ceil(size / BLOCK).alias("parts"))
    members = rest.join(owned, ["band", "key", "root"]).withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")))
    members = work.save(members.select("band", "key", "u", "root", "owner", "part"), "unsettled")

    blocks = members.select("band", "key", "owner", "part").distinct()
    a, b = (blocks.select("band", "key", F.struct("owner", "part").alias(side)) for side in ("a", "b"))
    pairs = a.join(b, ["band", "key"]).where("a < b AND a.owner <> b.owner OR a.owner = -1 AND b.owner = -1 AND a.part <= b.part")
    pairs = work.save(pairs.withColumn("task", F.monotonically_increasing_id()), "block_pairs")
    sides = pairs.select("band", "key", "task", F.posexplode(F.array_distinct(F.array("a", "b"))).alias("side", "block"))
    sides = sides.select("band", "key", "task", "side", F.col("block.owner").alias("owner"), F.col("block.part").alias("part"))
    tasks = members.join(sides, ["band", "key", "owner", "part"]).join(signatures, "u")
    return tasks.select("task", "band", "side", F.col("u").alias(UID), "root", "bands", "sig")


def _settled(met: DataFrame, roots: DataFrame, signatures: DataFrame, docs: DataFrame, idf, threshold: float, work: Workspace) -> DataFrame:
    """Verified links between groups that the links to leaders left apart; only texts with a candidate are moved."""
    asked = work.save(_unsettled(met, roots, signatures, work).groupBy("task").applyInArrow(_in_question, _TASK), "in_question")
    nodes = work.save(asked.select(UID).distinct(), "in_question_nodes")
    texts = _texts(docs, nodes, work, "in_question_texts")
    return work.save(asked.join(texts, UID).groupBy("task").applyInArrow(_settle(idf, threshold), "a long, b long"), "settled")


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """One row per document: UID, id, class_id (the id that stays), class_size, kept.  `docs` must have UID."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "near")
    docs = docs.select(UID, F.col(id_col).cast("long").alias(OWN + "id"), F.col(text_col).alias("text"))
    df, n = document_frequencies(docs.select("text"), work)
    idf = spark.sparkContext.broadcast(weights(df, n))
    signed = work.save(docs.mapInArrow(_sign(idf), _SIGNED), "signed")
    copies = work.save(signed.groupBy("digest").agg(F.min(UID).alias("rep")), "copies")
    signatures = work.save(signed.where("bands IS NOT NULL").join(copies.select(F.col("rep").alias(UID)), UID, "left_semi").select(F.col(UID).alias("u"), "bands", "sig"), "signatures")

    banded = signatures.select("u", F.posexplode("bands").alias("band", "key"))
    mask = F.element_at(F.array(*[F.lit(m) for m in _MASKS]), F.col("band") + 1)
    shuffled = banded.withColumn("x", F.col("u").bitwiseXOR(mask))
    buckets = shuffled.groupBy("band", "key").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low <> high")
    met = shuffled.join(buckets, ["band", "key"])
    links = met.select("u", F.explode(F.array("low", "high")).alias("leader"), "band").select("u", F.col("leader").bitwiseXOR(mask).alias("v")).where("u <> v")
    links = links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    sigs = signatures.select("u", "sig")
    signed_links = links.join(sigs.select(F.col("u").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("u").alias("b"), F.col("sig").alias("sb")), "b")
    links = work.save(signed_links.select("a", "b", "sa", "sb").mapInArrow(_agreeing, "a long, b long"), "links")

    first = links.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    sure = _verified(first, docs, idf, threshold, work, "first")
    roots = components(sure, work, "cc_first")
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rest = links.join(first, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    rest = work.save(rest.where(~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rb", "b"))).select("a", "b"), "rest")
    if rest.take(1):
        sure = sure.unionByName(_verified(rest, docs, idf, threshold, work, "second"))
        roots = components(sure, work, "cc_leaders")
    more = _settled(met, roots, signatures, docs, idf, threshold, work)
    if more.take(1):
        roots = components(sure.unionByName(more), work, "cc_all")

    rooted = work.save(copies.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root")), "rooted")
    members = work.save(signed.select(UID, OWN + "id", "digest").join(rooted, "digest").select(UID, OWN + "id", "root"), "members")
    order = F.struct(F.col(OWN + "id").isNull().alias("bare"), F.col(OWN + "id").alias("id"), F.col(UID).alias("uid"))
    heads = members.groupBy("root").agg(F.min(order).alias("head"), F.count("*").alias("class_size"))
    return join_counted(members, work.save(heads, "heads"), ["root"], "class_size").select(UID, OWN + "id", F.col("head.id").alias("class_id"), "class_size", (F.col(UID) == F.col("head.uid")).alias("kept"))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row left of each class; the columns are those of `docs`."""
    rows = with_uid(docs)
    found = classes(rows, threshold, id_col, text_col)
    return keep_rows(rows, found.where(~F.col("kept"))).drop(UID)
