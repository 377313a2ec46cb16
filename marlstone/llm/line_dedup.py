"""Line deduplication by a deletion-neighbourhood join.

A line is a duplicate if an earlier line (by document id, then place) equals it, or is one insertion, deletion or
substitution away.  Lines count as equal where two 64-bit hashes agree.  For near ones, every distinct line emits
its deletion variants, all strings that deleting up to one character leaves, as hashed keys, and equal variants are joined:

- lines that give the same variant by deleting at the same place differ in that character only, so each is paired with the
  earliest of them;
- a line that equals a variant of longer lines is paired with the earliest of these, and each of these with it.

Either way a key gives one pair for each of its lines, never all pairs, and no link is lost.  Every near pair's edit
distance is verified on the lines themselves.

Lines one edit apart are equal left and right of the quarter that holds the edit.  So a line emits variants only for those of its quarters
whose surroundings it shares with another line; this filter is exact, and leaves few variants.  The surroundings are hashed
by built-in functions, and a key's lines are told apart by the least and the greatest of their hashes, so texts are not moved for it.

Defined results: null text counts as empty and stays null; blank lines are always kept and lines of fewer than
`shortest` characters only equal their exact copies; a null id sorts first; rows that repeat an id keep their
order in the scan; extra columns are kept by `dedup_lines`, but for those named n_lines, n_exact or n_near, which it
replaces; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, UID, Workspace, join_counted, with_uid
from .shingles import mixed

EDITS = 1
SHORTEST = 1
_rng = np.random.Generator(np.random.PCG64(41))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), _BASE, np.uint64)))) if n else np.zeros(0, np.uint64)


def _letters(line: str) -> np.ndarray:
    return mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))


def _hash(x: np.ndarray) -> np.ndarray:
    """Of the whole line, as an array of one."""
    return mixed(np.array([(x * _powers(len(x))).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64))


def variants(line: str) -> np.ndarray:
    """Hashes of the strings that deleting the first, second, ... character leaves."""
    x = _letters(line)
    if not len(x):
        return np.zeros(0, np.uint64)
    p = _powers(len(x))
    before = np.concatenate(([np.uint64(0)], np.cumsum(x * p)[:-1]))
    # What follows the deleted letter moves down one place.
    after = np.append(np.cumsum((x[1:] * p[:-1])[::-1])[::-1], np.uint64(0))
    return mixed(before + after + np.uint64(len(x) - 1))


def within_one(a: str, b: str) -> bool:
    """Whether the Levenshtein distance is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, stop = 0, min(len(a), len(b))
    while i < stop and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


#: Quarters are counted in bytes.  Their sizes are rounded down to multiples of GRID, so that neighbouring lengths mostly have the same;
#: lines one character apart differ by at most WIDEST bytes, and quarters reach WIDEST - 1 bytes into the next so that each character lies in one.
QUARTERS, GRID, WIDEST = 4, 4, 4
#: Lines under this many bytes always emit all variants, as a quarter of the shorter line may be 0.
ALWAYS = QUARTERS * GRID + WIDEST
ALL = (1 << 2 * QUARTERS) - 1


def _quarter(n):
    """The size of quarters of lines of n bytes, as an integer or a column."""
    if isinstance(n, int):
        return n // (QUARTERS * GRID) * GRID
    return (F.floor(n / (QUARTERS * GRID)) * GRID).cast("int")


def _surroundings(rows: DataFrame, *columns: str) -> DataFrame:
    """columns of rows (with `line`), k, key: what is left and right of each quarter.

    k: 0 to 3 for this line's quarters, 4 to 7 for those of a line of WIDEST bytes less, where they differ.
    """
    rows = rows.select(*columns, F.col("line").cast("binary").alias("b"), F.octet_length("line").alias("n")).where(F.col("n") >= QUARTERS * GRID)
    rows = rows.select("*", _quarter(F.col("n")).alias("long"), _quarter(F.col("n") - WIDEST).alias("short"))
    own, less = F.struct(F.lit(0).alias("k"), F.col("long").alias("s")), F.struct(F.lit(QUARTERS).alias("k"), F.col("short").alias("s"))
    sizes = F.when((F.col("short") != F.col("long")) & (F.col("short") > 0), F.array(own, less)).otherwise(F.array(own))
    rows = rows.select(*columns, "b", "n", F.explode(sizes).alias("size")).select(*columns, "b", "n", F.col("size.k").alias("k0"), F.col("size.s").alias("s"))
    # Pieces from the left, and from the right but for what quarters reach over.
    n, s = F.col("n") + (WIDEST - 1), F.col("s")
    left = [F.substring("b", s * q + 1, s).alias(f"l{q}") for q in range(QUARTERS - 1)]
    right = [F.substring("b", n - s * (q + 1) + 1, s if q else s - (WIDEST - 1)).alias(f"r{q}") for q in range(QUARTERS - 1)]
    rows = rows.select(*columns, "k0", "s", *left, *right)
    keys = [F.xxhash64(F.lit(q), "s", *[f"l{i}" for i in range(q)], *[f"r{i}" for i in range(QUARTERS - 1 - q)]) for q in range(QUARTERS)]
    return rows.select(*columns, "k0", F.posexplode(F.array(*keys)).alias("q", "key")).select(*columns, (F.col("k0") + F.col("q")).alias("k"), "key")


def _open_places(line: str, mask: int) -> np.ndarray:
    """Places of characters that lie in the quarters of a mask of key numbers."""
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum(1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000))
    start, n = np.concatenate(([0], end[:-1])), int(end[-1]) if len(end) else 0
    if mask == ALL:
        return np.arange(len(x))
    out = np.zeros(len(x), bool)
    for k in range(2 * QUARTERS):
        if mask >> k & 1:
            quarter, size = k % QUARTERS, _quarter(n - k // QUARTERS * WIDEST)
            after = (QUARTERS - 1 - quarter) * size
            out |= (start >= quarter * size) & (end <= (n - after + WIDEST - 1 if after else n))
    return np.flatnonzero(out)


#: A line is named by its earliest place; `id` comes first in the order of lines.
_PLACE = ["id", "uid", "place"]
_KEYS = "id long, uid long, place int, key long, kind byte"
SUBSTITUTED, LONGER, WHOLE = 0, 1, 2


#: Characters of lines whose variants are made at a time.
SLICE = 1 << 16


def _emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of lines, some lines at a time."""
    for b in rows:
        lines, masks = b.column("line").to_pylist(), b.column("mask").to_pylist()
        slot = np.cumsum([len(x) for x in lines]) // SLICE
        edges = np.flatnonzero(np.diff(slot, prepend=-1, append=-1)).tolist()
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            found = [_neighbourhood(line, mask) for line, mask in zip(lines[i:j], masks[i:j], strict=True)]
            index = pa.array(np.repeat(np.arange(i, j), [len(k) for k, _ in found]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(index) for c in _PLACE), pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(np.concatenate([x for _, x in found]).astype(np.int8))], names=[*_PLACE, "key", "kind"])


def _neighbourhood(line: str, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants with the place of the deletion, variants without it, and the line itself."""
    places = _open_places(line, mask)
    v = variants(line)[places]
    placed = mixed(v + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    longer = np.unique(v)
    kinds = np.repeat(np.array([SUBSTITUTED, LONGER, WHOLE], np.int8), [len(v), len(longer), 1])
    return np.concatenate((placed, longer, _hash(_letters(line)))), kinds


def _near(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        ok = [within_one(p, q) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select(["uid", "place"]).filter(pa.array(ok, pa.bool_()))


def _suspects(rows: DataFrame, hashed: DataFrame, docs_of, work: Workspace, shortest: int) -> DataFrame:
    """id, uid, place, line, mask: the distinct lines that share surroundings, and which ones.  rows: uid, place, line, h1; hashed: id, uid, place, h1, h2."""
    rows = rows.where(F.length("line") >= shortest)
    keys = _surroundings(rows, "h1")
    shared = work.save(keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"), "shared")
    # The same plan at every size: the keys that are shared grow with the lines.
    named = _surroundings(rows, "uid", "place").join(shared.hint("merge"), "key", "left_semi")
    masks = named.select("uid", "place", F.expr("shiftleft(1, k)").alias("mask"))
    masks = work.save(masks.unionByName(rows.where(F.octet_length("line") < ALWAYS).select("uid", "place", F.lit(ALL).alias("mask"))).groupBy("uid", "place").agg(F.bit_or("mask").alias("mask")), "masks")
    found = hashed.join(masks, ["uid", "place"]).groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.bit_or("mask").alias("mask"))
    by_row = found.groupBy(F.col("first.uid").alias("uid")).agg(F.map_from_entries(F.collect_list(F.struct("first.place", "mask"))).alias("masks"))
    lines = docs_of(work.save(by_row, "wanted")).withColumn("mask", F.expr("masks[place]")).where("mask IS NOT NULL")
    return work.save(lines.select(*_PLACE, "line", "mask"), "suspects")


def _near_duplicates(lines: DataFrame, work: Workspace) -> DataFrame:
    """(uid, place) of the distinct lines that have an earlier line within one edit.  lines: id, uid, place, line, mask."""
    emitted = work.save(lines.mapInArrow(_emit, _KEYS), "variants")

    me, other = F.struct(*_PLACE), F.struct(*[F.col("o." + c) for c in _PLACE])
    as_o = lambda df: df.select("key", F.struct(*_PLACE).alias("o"))
    first = lambda df: df.groupBy("key").agg(F.min(F.struct(*_PLACE)).alias("o"))
    pair = ["uid", "place", F.col("o.uid").alias("uid2"), F.col("o.place").alias("place2")]
    same, longer, whole = (emitted.where(F.col("kind") == k) for k in (SUBSTITUTED, LONGER, WHOLE))
    pairs = same.join(first(same), "key").where(me > other).select(*pair)
    pairs = pairs.unionByName(longer.join(as_o(whole), "key").where(me > other).select(*pair))
    pairs = pairs.unionByName(whole.join(first(longer), "key").where(me > other).select(*pair))
    pairs = work.save(pairs.distinct(), "pairs")
    texts = lines.select("uid", "place", "line")
    tested = pairs.join(texts, ["uid", "place"]).join(texts.select(F.col("uid").alias("uid2"), F.col("place").alias("place2"), F.col("line").alias("line2")), ["uid2", "place2"])
    return tested.select("uid", "place", "line", "line2").mapInArrow(_near, "uid long, place int").distinct()


def marked_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """UID, place, exact, near: the lines that are duplicates, and of which kind.  `docs` must have UID; edits: 0 or 1."""
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    work = work or Workspace(docs.sparkSession, "lines")
    texts = docs.select(F.col(UID).alias("uid"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(texts: DataFrame, *more: str) -> DataFrame:
        rows = texts.select("uid", "id", *more, F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).where("trim(line) <> ''")
        return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))

    rows = cut(texts)
    hashed = work.save(rows.select(*_PLACE, "h1", "h2"), "hashed")
    firsts = hashed.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("copies"))
    firsts = firsts.select("h1", "h2", F.col("first.uid").alias("u0"), F.col("first.place").alias("p0"), "copies")
    near = F.lit(False)
    if edits:
        suspects = _suspects(rows, hashed, lambda wanted: cut(texts.join(wanted, "uid"), "masks"), work, shortest)
        found = work.save(_near_duplicates(suspects, work), "near").select(F.col("uid").alias("u0"), F.col("place").alias("p0"), F.lit(True).alias("near"))
        firsts = firsts.join(found, ["u0", "p0"], "left")
        near = F.coalesce("near", F.lit(False))
    # Lines that have no other copy and no near one stay, so they need not be looked up.
    firsts = work.save(firsts.where((F.col("copies") > 1) | near), "firsts")
    later = (F.col("uid") != F.col("u0")) | (F.col("place") != F.col("p0"))
    joined = join_counted(hashed, firsts, ["h1", "h2"], "copies").where(later | near)
    return joined.select(F.col("uid").alias(UID), "place", later.alias("exact"), (~later).alias("near"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with duplicate lines cut out of text_col, and n_lines, n_exact, n_near: lines before, and lines cut of each kind."""
    rows = with_uid(docs)
    marks = marked_lines(rows, edits, shortest, id_col, text_col)
    # Of one document's lines, so never more than it has.
    counted = [F.sum(F.col(c).cast("long")).alias(OWN + c) for c in ("exact", "near")]
    cut = marks.groupBy(UID).agg(F.collect_list("place").alias(OWN + "cut"), *counted)
    out = rows.join(cut, UID, "left").withColumn(OWN + "lines", F.split(F.col(text_col), "\n", -1))
    lines = F.col(OWN + "lines")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(OWN + "cut"))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(OWN + "cut").isNull(), F.col(text_col)).otherwise(kept)
    numbers = {"n_lines": F.coalesce(F.size(lines), F.lit(1)), "n_exact": F.coalesce(OWN + "exact", F.lit(0)), "n_near": F.coalesce(OWN + "near", F.lit(0))}
    own = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in numbers]
    return out.select(*own, *[x.cast("long").alias(c) for c, x in numbers.items()])
