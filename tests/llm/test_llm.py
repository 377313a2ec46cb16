"""The training-data operators against brute-force versions, round trips and awkward inputs."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import bpe, exact_dedup, graph, line_dedup, near_dedup, packing, pii, pitman_yor, quality, shingles, tiff, token_output, tokenize
from marlstone.llm.common import OWN, UID, Workspace, afresh, lowered, with_uid
from marlstone.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def awkward(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
    rows = [(1, "same words in this text here", "en", "s", 4), (2, "same words in this text here", None, None, None), (2, "same words in this text here", None, None, None), (3, None, "en", "s", 0), (4, "", None, "s", 0), (None, "same words in this text here", "xx", "s", 1), (None, "other", "en", "s", 5), (7, long, "en", "s", len(long)), (8, long + " y", "en", "s", 1), (9, " \n\t ", "en", "s", 4)]
    path = str(tmp_path / "awkward")
    spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def empty(spark, tmp_path):
    path = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# --- exact copies ------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, awkward, keep):
    got = exact_dedup.groups(with_uid(awkward), keep).collect()
    assert len(got) == 10
    same = [r for r in got if r.group_size == 4]
    assert {r.keep_id for r in same} == {None if keep == "min" else 2}
    assert sum(r.kept for r in same) == 1
    assert sum(r.group_size == 2 for r in got) == 2  # null and empty text
    assert exact_dedup.exact_dedup(awkward, keep).count() == sum(r.kept for r in got)


def test_exact_compaction_in_levels(spark, docs):
    work = Workspace(spark, "test")
    rows = docs.crossJoin(spark.range(3).withColumnRenamed("id", "k")).repartition(7).select(F.monotonically_increasing_id().alias(UID), F.col("doc_id").alias(exact_dedup.ID), F.unhex(F.sha2("text", 256)).alias(exact_dedup.DIGEST))
    staged = work.save(rows, "staged")
    got = exact_dedup.DigestIndex(staged, work, memtable=16, fan_in=3).entries()
    want = staged.groupBy(exact_dedup.DIGEST).agg(F.min(exact_dedup.ID).alias("low"), F.max(exact_dedup.ID).alias("high"), F.count("*").alias("n"))
    pick = lambda df: sorted((bytes(r[0]), r.low, r.high, r.n) for r in df.collect())
    assert pick(got.select(exact_dedup.DIGEST, "low", "high", "n")) == pick(want)


def test_exact_clashing_digests(spark, monkeypatch, tmp_path):
    """Texts that share a digest are told apart by their bytes."""
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = with_uid(spark.read.parquet(str(tmp_path / "t")))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("00" * 32))
    got = {r[OWN + "id"]: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(rows, "max").collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True)}


# --- near copies ---------------------------------------------------------------------


def _weighted(spark, source, texts):
    df, n = near_dedup.document_frequencies(source, Workspace(spark, "df"))
    return near_dedup.weights(df, n), [lowered(t) for t in texts]


def test_near_classes_against_all_pairs(spark, docs):
    rows = docs.collect()
    got = [r.class_id for r in sorted(near_dedup.classes(with_uid(docs)).collect(), key=lambda r: r[UID])]
    idf, texts = _weighted(spark, docs, [r.text for r in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    linked = set()
    for (i, j), x in zip(pairs, near_dedup.similarities(pairs, texts, idf), strict=True):
        if x >= near_dedup.THRESHOLD or rows[i].text == rows[j].text:
            assert got[i] == got[j]
            linked |= {i, j}
    sizes = Counter(got)
    assert linked == {i for i in range(len(rows)) if sizes[got[i]] > 1}


def test_near_recall_of_planted_pairs(spark, tmp_path):
    """Pairs whose weighted similarity spreads from 0.8 to 0.95."""
    g = random.Random(8)
    words = lambda n: [f"w{g.randrange(3000)}" for _ in range(n)]
    texts = []
    for i in range(400):
        own = words(300)
        texts += [own, own[: 292 - i % 22] + words(8 + i % 22)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    idf, encoded = _weighted(spark, source, [" ".join(t) for t in texts])
    pairs = [(2 * i, 2 * i + 1) for i in range(400)]
    near = [p for p, x in zip(pairs, near_dedup.similarities(pairs, encoded, idf), strict=True) if 0.8 <= x <= 0.95]
    assert len(near) > 300
    got = {r[OWN + "id"]: r.class_id for r in near_dedup.classes(with_uid(source)).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 0.99 * len(near)


def test_near_awkward(spark, awkward, empty):
    got = near_dedup.classes(with_uid(awkward)).collect()
    assert len(got) == 10 and sum(r.kept for r in got) == 5
    by = {(r[OWN + "id"], r.class_size) for r in got}
    assert (7, 2) in by and (8, 2) in by and (3, 2) in by
    assert near_dedup.near_dedup(awkward).columns == awkward.columns
    assert near_dedup.classes(with_uid(empty)).count() == 0


def test_near_pairs_inside_a_family_of_shared_boilerplate(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32, raising=False)
    g = random.Random(5)
    words = lambda n: [f"w{g.randrange(10**9)}" for _ in range(n)]
    shared, texts, pairs = words(300), [], []
    for i in range(200):
        own = words(24)
        texts.append(shared + own)
        if i % 5 == 0:
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(shared + own[:12] + words(12))
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df, n = near_dedup.document_frequencies(spark.read.parquet(str(tmp_path / "t")), Workspace(spark, "df"))
    encoded, idf = [" ".join(t).encode() for t in texts], near_dedup.weights(df, n)
    near = near_dedup.similarities(pairs, encoded, idf)
    strangers = near_dedup.similarities([(a, b) for a, _ in pairs for b, _ in pairs if a < b], encoded, idf)
    assert min(near) >= near_dedup.THRESHOLD and 0.7 < min(strangers) and max(strangers) < near_dedup.THRESHOLD
    got = {r[OWN + "id"]: r.class_id for r in near_dedup.classes(with_uid(spark.read.parquet(str(tmp_path / "t")))).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.9 * len(pairs)
    assert len(set(got.values())) == len(texts) - found


def test_samples_estimate_weighted_jaccard():
    words = [f"w{i}" for i in range(400)]
    a = words
    b = words[:300] + [f"v{i}" for i in range(100)]
    texts = [" ".join(a).encode(), " ".join(b).encode()]
    idf = np.asarray(np.random.default_rng(1).uniform(1, 2, 1 << near_dedup.FEATURE_BITS), np.float32)
    sh, tf, per = near_dedup._distinct(*shingles.shingles(texts))
    s = near_dedup.samples(sh, tf, per, idf)
    true = near_dedup.similarities([(0, 1)], texts, idf)[0]
    assert abs((s[0] == s[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / near_dedup.K)


def test_shingles_do_not_depend_on_the_batch():
    texts = [b"a b c d e f", b"", b"x", b"a b c d e f", b"  a  b\tc d e\nf "]
    sh, n = shingles.shingles(texts)
    alone = [shingles.shingles([t])[0].tolist() for t in texts]
    assert n.tolist() == [2, 0, 1, 2, 2]
    assert [x for a in alone for x in a] == sh.tolist() and alone[0] == alone[3] == alone[4]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.root for x in graph.components(df, Workspace(spark, "t")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# --- lines ---------------------------------------------------------------------------------


def _distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
@settings(max_examples=300, deadline=None)
def test_one_edit(a, b):
    assert line_dedup.within_one(a, b) == (_distance(a, b) <= 1)


@pytest.mark.parametrize("sizes", [(1, 6), (12, 36), (20, 200)])
def test_lines_against_brute_force(spark, tmp_path, sizes):
    """With the registered settings."""
    r = random.Random(2)
    pool = ["".join(r.choice("abcé語𝄞") for _ in range(r.randint(*sizes))) for _ in range(30)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 5)):
            x = r.choice(pool)
            k = r.randint(0, len(x))
            lines.append(r.choice([x, x[:k] + "b" + x[k:], x[:k] + x[k + 1 :], x[:k] + r.choice("c𝄞") + x[k + 1 :]]))
        rows.append((i, "\n".join(lines)))
    rows += [(None, "aaa\n\n  \nabc"), (100, None), (3, "abca"), (101, "\n".join(pool)), (102, pool[0] + "x" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.text or "", x.n_exact, x.n_near) for x in line_dedup.dedup_lines(spark.read.parquet(str(tmp_path / "t"))).collect())
    seen, want = [], []
    for i, _, t in sorted((-1 if i is None else i, n, t) for n, (i, t) in enumerate(rows)):
        keep, exact, near = [], 0, 0
        for x in (t or "").split("\n"):
            if not x.strip():
                keep.append(x)
            elif x in seen:
                exact += 1
            else:
                if any(line_dedup.within_one(x, y) for y in seen):
                    near += 1
                else:
                    keep.append(x)
                seen.append(x)
        want.append((i, "\n".join(keep), exact, near))
    assert got == sorted(want)


def test_lines_awkward(spark, awkward, empty):
    assert line_dedup.dedup_lines(awkward).count() == 10
    clash = awkward.withColumnRenamed("shard", "n_exact").withColumnRenamed("digest", "near")
    got = line_dedup.dedup_lines(clash)
    assert got.columns == [c for c in clash.columns if c != "n_exact"] + ["n_lines", "n_exact", "n_near"] and got.agg(F.sum("n_exact")).first()[0] == 3
    assert line_dedup.dedup_lines(empty).count() == 0


# --- quality -----------------------------------------------------------------------------------


def test_kneser_ney_against_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("a b c d e f g h".split()[: r.randint(2, 8)]) for _ in range(r.randint(0, 12))) for _ in range(60)]
    scorer = quality.Scorer(quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), Workspace(spark, "t")))
    c3, c2, c1 = Counter(), Counter(), Counter()
    for t in texts:
        w = ["<", "<", *t.split(), ">"]
        c3.update(zip(w, w[1:], w[2:], strict=False))
    for (_, v, w), n in c3.items():
        c2[v, w] += n if v == "<" else 1
    for _, w in c2:
        c1[w,] += 1

    def discounts(c):
        n = Counter(c.values())
        if not all(n[i] for i in (1, 2, 3, 4)):
            return [0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]

    tables = [(c, discounts(c)) for c in (c1, c2, c3)]

    def p(context, w, order):
        if not order:
            return 1 / (len(c1) + 1)
        c, d = tables[order - 1]
        own = {k[-1]: n for k, n in c.items() if k[:-1] == context}
        if not own:
            return p(context[1:], w, order - 1)
        total = sum(own.values())
        spare = sum(d[min(n, 3) - 1] for n in own.values()) / total
        n = own.get(w, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total + spare * p(context[1:], w, order - 1)

    assert sum(p(("a", "b"), w, 3) for w in [*(k[0] for k in c1), "unseen"]) == pytest.approx(1)
    for t in [*texts[:10], "a b zz c", "", "h h h h a", "zz"]:
        w = ["<", "<", *t.split(), ">"]
        want = sum(math.log10(p((w[i - 2], w[i - 1]), w[i], 3)) for i in range(2, len(w)))
        got, n = scorer.log10([t])
        assert got[0] == pytest.approx(want, abs=1e-4) and n[0] == len(w) - 2


def test_quality_learns_from_all_trusted_text(spark, tmp_path):
    """Every trusted row is in the model, and sets the thresholds by its score without its own counts."""
    r = random.Random(5)
    texts = [" ".join(r.choice("a b c d e f g h i j".split()[: r.randint(2, 10)]) for _ in range(r.randint(1, 12))) for _ in range(1700)] + ["a b odd", "a b odd c", "lone"]
    path = str(tmp_path / "all")
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3).write.parquet(path)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts)) if i % 10], "doc_id long, quality int, toxic int")
    got = {x[OWN + "id"]: x for x in quality.judged(with_uid(spark.read.parquet(path)), labels).collect()}
    trusted = [i for i in range(len(texts)) if i % 10]

    def grams(t):
        w = ["<", "<", *t.split(), ">"]
        return list(zip(w, w[1:], w[2:], strict=False))

    def lower(c3):
        c2, c1 = Counter(), Counter()
        for (_, v, w), n in c3.items():
            c2[v, w] += n if v == "<" else 1
        for _, w in c2:
            c1[w,] += 1
        return c1, c2, c3

    def discounts(c):
        n = Counter(c.values())
        if not all(n[i] for i in (1, 2, 3, 4)):
            return [0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]

    whole = lower(Counter(g for i in trusted for g in grams(texts[i])))
    d = [discounts(c) for c in whole]
    total = sum(whole[0].values())
    floor = sum(d[0][min(n, 3) - 1] for n in whole[0].values()) / total / (len(whole[0]) + 1)

    def p(tables, context, w):
        c, order = tables[len(context)], len(context)
        n = c[(*context, w)]
        n -= d[order][min(n, 3) - 1] if n else 0
        if not order:
            return n / total + floor
        own = [x for k, x in c.items() if k[:-1] == context]
        rest = p(tables, context[1:], w)
        return n / sum(own) + sum(d[order][min(x, 3) - 1] for x in own) / sum(own) * rest if own else rest

    def log10(tables, t):
        return sum(math.log10(p(tables, g[:2], g[2])) for g in grams(t))

    for i in [*range(12), len(texts) - 3, len(texts) - 2, len(texts) - 1]:
        assert got[i].log10_prob == pytest.approx(log10(whole, texts[i]), abs=1e-6)
    apart = []
    for i in trusted:
        c3 = whole[2].copy()
        c3.subtract(grams(texts[i]))
        if i < 40 or i > len(texts) - 4:
            tables = lower(Counter({k: n for k, n in c3.items() if n}))
            apart.append((i, log10(tables, texts[i])))
    without = {x[OWN + "id"]: x[OWN + "without"] for x in quality.scored(with_uid(spark.read.parquet(path)), labels, Workspace(spark, "t")).collect()}
    assert {i for i, x in without.items() if x is not None} == set(trusted)
    assert all(without[i] == pytest.approx(x, abs=1e-6) for i, x in apart)
    cut = sorted(-without[i] / got[i].n_tokens for i in trusted)[math.ceil(0.995 * len(trusted)) - 1]
    assert all(x.threshold == pytest.approx(cut + quality.SLACK + quality.SPREAD / math.sqrt(x.n_tokens), abs=1e-6) for x in got.values())


def test_quality_keeps_trusted_and_drops_noise(spark, docs, labels):
    found = quality.judged(with_uid(docs), labels).join(labels, F.col(OWN + "id") == F.col("doc_id"))
    kept = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert kept.get((1, False), 0) <= 0.05 * kept[1, True]
    assert kept.get((0, False), 0) >= 0.5 * sum(n for (q, _), n in kept.items() if q == 0)


def test_quality_awkward(spark, awkward, empty, labels):
    out = quality.judged(with_uid(awkward), labels)
    assert out.count() == 10 and out.where("n_tokens = 1 AND kept").count() == 0
    assert quality.judged(with_uid(empty), labels).count() == 0
    assert quality.filter_documents(awkward, labels.limit(0)).columns == awkward.columns


def _traced(rows: int, words: int, run) -> float:
    """Peak bytes a token of a run over invented texts, given as one batch."""
    r = np.random.default_rng(1)
    texts = [" ".join(map(str, r.zipf(1.3, words) % 50_000)) for _ in range(rows)]
    batch = pa.RecordBatch.from_pydict({UID: list(range(rows)), OWN + "id": list(range(rows)), OWN + "held": [False] * rows, "lang": ["en"] * rows, "text": texts})
    run(batch.slice(0, 1))  # tables that stay
    tracemalloc.start()
    try:
        run(batch)
        return tracemalloc.get_traced_memory()[1] / (rows * words)
    finally:
        tracemalloc.stop()


def test_quality_holds_few_bytes_a_token():
    assert _traced(400, 1000, lambda rows: list(quality._ask(None, quality.TRIGRAMS, 8)(iter([rows])))) < 100


def test_quality_sums_are_packed_as_differences():
    r = np.random.default_rng(1)
    one, two, more = (r.integers(0, 3, 1000) for _ in range(3))
    columns = [one + 2 * two + 3 * more + (r.random(1000) < 0.01) * (1 << 40), one, two, more, one + two + more]
    packed = quality._pack_sums(columns)
    for got, want in zip(quality._open_sums(packed), columns, strict=True):
        assert got.tolist() == want.tolist()
    assert sum(map(len, packed)) < sum(len(pitman_yor._pack(c)) for c in columns)
    assert [c.tolist() for c in quality._open_sums(quality._pack_sums([np.arange(5)]))] == [[0, 1, 2, 3, 4]]
    assert all(len(c) == 0 for c in quality._open_sums(quality._pack_sums([np.zeros(0, np.int64)] * 5)))


# --- language model ----------------------------------------------------------------------------------


def test_stirling_numbers():
    s = pitman_yor.stirling(0.5, 6)
    # Three customers: one table 0.5 * 1.5, three ways to two tables, one to three.
    assert np.exp(s[3, 1:4]) == pytest.approx([0.75, 1.5, 1.0])


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"there", b"a"]
    cells, n = pitman_yor.spelling_cells(words, np.array([5, 2, 1, 7]))
    m = pitman_yor.Spelling(cells, n, pitman_yor.ORDER)
    m.sweep(np.random.default_rng(1))
    for context in (b"  ", b"th", b"zz"):
        own = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert m.probability(own).sum() == pytest.approx(1)


def _partitions(n: int):
    """All ways to seat n customers at tables, as tuples of table sizes (one for each set partition)."""
    if n == 0:
        yield ()
        return
    for p in _partitions(n - 1):
        yield (*p, 1)
        for i in range(len(p)):
            yield (*p[:i], p[i] + 1, *p[i + 1 :])


@pytest.mark.parametrize(("c", "others", "base", "d"), [(3, 0, 0.2, 0.5), (5, 7, 0.03, 0.8), (6, 2, 0.5, 0.3)])
def test_seats_against_all_seatings(c, others, base, d):
    want = Counter()
    for p in _partitions(c):
        fresh = math.prod((pitman_yor.THETA + d * (others + k)) * base for k in range(len(p)))
        want[len(p)] += fresh * math.prod(math.prod(j - d for j in range(1, size)) for size in p)
    n = 40_000
    got = pitman_yor.seat(np.full(n, c), np.ones(n, np.int64), np.full(n, others + 1), np.full(n, base), d, pitman_yor.stirling(d), np.random.default_rng(3))
    for t in range(1, c + 1):
        assert (got == t).mean() == pytest.approx(want[t] / sum(want.values()), abs=0.01)


@pytest.fixture(scope="module")
def model_texts(docs):
    rows = {r.doc_id: [*lowered(r.text).split(), b"\n"] for r in docs.collect()}
    return rows, {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}


def test_scores_against_plain_tables(spark, docs, model_texts, monkeypatch):
    """Every restaurant sums to one, and scores equal those looked up word by word, with several blocks."""
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 50_000)
    rows, held = model_texts
    model = pitman_yor.fit(docs, Workspace(spark, "t"))
    state, words, pairs = model.state, {}, Counter()
    open_words = [pitman_yor.Words(r.asDict()) for r in model.words.collect()]
    rest = 1.0
    for x in open_words:
        p, insides = pitman_yor.averages(x, state)
        words |= {w: (int(c), lp, sh) for w, c, lp, sh in zip(x.words, x.c, p, pitman_yor.shares(x.c, insides, state.d), strict=True)}
        rest -= x.spelling.sum()
    served = sum(x.served(state).sum() for x in open_words)
    assert served + (pitman_yor.THETA + state.d0 * state.seated) * rest / (pitman_yor.THETA + state.customers) == pytest.approx(1, abs=1e-6)
    for i, ws in rows.items():
        if not held[i]:
            pairs.update(zip([b"\n", *ws], ws, strict=False))
    assert {w: n for w, n in Counter(w for i, ws in rows.items() if not held[i] for w in ws).items()} == {w: c for w, (c, _, _) in words.items() if c}
    some = sorted(words)
    code = dict(zip(pitman_yor._codes(some).tolist(), some, strict=True))
    own = {k: 1 - state.d for k, n in pairs.items() if n == 1}
    for r in model.seated.collect():
        names, total = pitman_yor._open_codes(r.names).tolist(), pitman_yor._open(r.total, np.int64)
        for u, w, c, t in zip(pitman_yor._open_rising(r.u), pitman_yor._open(r.w), pitman_yor._open(r.many, np.int64), total, strict=True):
            pair = (code[names[u]], code[names[w]])
            assert pairs[pair] == c and pitman_yor.SAMPLES <= t <= c * pitman_yor.SAMPLES
            own[pair] = c - state.d * t / pitman_yor.SAMPLES
    assert set(own) == set(pairs)
    sums = Counter()
    for (u, _), x in own.items():
        sums[u] += x
    for u, x in sums.items():
        c, _, share = words[u]
        assert x / (pitman_yor.THETA + c) + share == pytest.approx(1, abs=1e-9)
    for r in pitman_yor.score(docs).collect():
        ws = rows[r.doc_id]
        want = sum(math.log10(own.get((u, w), 0) / (pitman_yor.THETA + words[u][0]) + words[u][2] * 10 ** words[w][1]) for u, w in zip([b"\n", *ws], ws, strict=False))
        assert r.score == pytest.approx(want, rel=1e-5) and r.log10_perplexity == pytest.approx(-r.score / len(ws))


def test_tables_settle(spark, docs):
    """After the burn-in the number of tables no longer drifts."""
    seen = []
    keep = pitman_yor._state
    pitman_yor._state = lambda *a: (seen.append(keep(*a)), seen[-1])[1]
    try:
        pitman_yor.fit(docs, Workspace(spark, "t"))
    finally:
        pitman_yor._state = keep
    tables = [s.customers for s in seen][-pitman_yor.SAMPLES - 1 :]
    assert max(tables) < 1.05 * min(tables)


def test_scores_against_counts(docs, model_texts):
    got = {r.doc_id: r for r in pitman_yor.score(docs).collect()}
    rows, held = model_texts
    c = Counter(w for i, ws in rows.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in rows.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
    assert sum(got[i].score for i in rows if not held[i]) > sum(got[i].base_score for i in rows if not held[i])


def test_blocks_hold_few_bytes_a_token():
    blocks = []
    assert _traced(400, 1000, lambda rows: blocks.append(list(pitman_yor._blocks(iter([rows]))))) < 80
    pitman_yor.Block(blocks[0][0].to_pylist()[0], 8)  # tables that stay
    row = blocks[1][0].to_pylist()[0]
    tracemalloc.start()
    try:
        pitman_yor.Block(row, 8)
        assert tracemalloc.get_traced_memory()[1] / row["n_tokens"] < 50
    finally:
        tracemalloc.stop()


def test_repeated_texts_score_higher(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(200)) for _ in range(60)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:10])], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r for r in pitman_yor.score(spark.read.parquet(str(tmp_path / "t"))).collect()}
    both = [i for i in range(10) if not got[i].held_out and not got[60 + i].held_out]
    once = [i for i in range(10, 60) if not got[i].held_out]
    assert both and min(got[i].score for i in both) > max(got[i].score for i in once)


VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so") for b in ("ta", "ve", "zi", "do", "fu", "gra", "hol")]


def test_scores_awkward(spark, awkward, empty):
    got = pitman_yor.score(awkward).collect()
    assert len(got) == 10 and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert pitman_yor.score(empty).count() == 0


# --- personal data ---------------------------------------------------------------------------------------


def _base(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[2]]))


@given(st.lists(st.sampled_from(["a", "@", ".", "1", "25", "+", "-", " ", "(", ")", "b.c", "@x.y", "é", "4111111111111111", " 1.2.3.4"]), max_size=25).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans(t):
    assert pii.base_spans(t) == _base(t)


def test_pii_adds_secrets_and_masks(spark, docs):
    found = pii.find(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        base = _base(texts[r.doc_id])
        assert r.base == ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
        assert r.n_email == sum(k == "email" for _, _, k in base)
        assert r.base_sha256 == hashlib.sha256(r.base.encode()).hexdigest()
    assert pii.masked("call +1 234 567 8901 now", [(5, 20, "phone")]) == "call [PHONE] now"
    for r in pii.redact(docs).collect():
        assert not _base(r.text) and r.n_chars == len(r.text)


def test_pii_long_texts_take_linear_time():
    t = "a" * 100_000 + " " + "1" * 100_000 + "@" + "b." * 50_000
    pii.candidates(t, pii.base_spans(t))


def test_pii_holds_a_slice_of_the_texts():
    assert _traced(4000, 100, lambda rows: [None for _ in pii._find(iter([rows.rename_columns([OWN + "id" if n == UID else n if n == "text" else n + "_" for n in rows.schema.names])]))]) < 4
    rows = pa.RecordBatch.from_pydict({"n": list(range(1100))})
    got = list(afresh(iter([rows, rows.slice(0, 0), rows.slice(7, 3)])))
    assert max(b.num_rows for b in got) <= 512 and [x for b in got for x in b.column(0).to_pylist()] == [*range(1100), 7, 8, 9]


def test_pii_awkward(spark, awkward, empty):
    assert pii.find(awkward).count() == 10 and pii.find(empty).count() == 0
    out = pii.redact(awkward)
    assert out.columns == awkward.columns and out.where("text IS NULL").count() == 1


# --- packing ---------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    r = random.Random(1)
    for _ in range(30):
        lengths = np.array(sorted(r.sample(range(1, 40), r.randint(1, 8))))
        counts = np.array([r.randint(1, 9) for _ in lengths])
        k = r.randint(1, 4)

        def cost(bounds, lengths=lengths, counts=counts):
            return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))

        from itertools import combinations

        best = min(cost((*some, lengths[-1])) for m in range(k) for some in combinations(lengths[:-1], m))
        got = packing.boundaries(lengths, counts, k)
        assert len(got) <= k and cost(got) == best


def test_batches_hold_every_token_once(spark, docs, awkward, empty):
    for df in (docs, awkward):
        rows = packing.pack(df, longest=128, budget=512, buckets=4).collect()
        assert sum(r.n_tokens for r in rows) == sum(len(lowered(r.text).split()) for r in df.collect())
        assert all(0 <= r.n_tokens <= r.boundary <= 128 for r in rows)
        size = Counter(r.batch for r in rows)
        width = {r.batch: r.boundary for r in rows}
        assert all(n * max(width[b], 1) <= 512 or n == 1 or width[b] == 0 for b, n in size.items())
        assert len({(r.batch, r.place) for r in rows}) == len(rows)
    assert packing.pack(empty).count() == 0


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_decreasing(lengths):
    got = token_output.best_fit_decreasing(np.array(lengths, np.int64), 50)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    # The plain version: scan all bins for the tightest that fits.
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(bins) if f >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(50 - n)
    assert sorted(50 - sum(lengths[i] for i in b) for b in got) == sorted(bins)


def test_packed_matrices_are_lossless(spark, docs, awkward, empty, tmp_path):
    import tiktoken

    path = vocabulary_path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=token_output.read_ranks(path), special_tokens={})
    for df in (docs, awkward):
        parts: dict = {}
        for r in token_output.pack_documents(df, path, capacity=256, block_tokens=4096).collect():
            ids, at = np.frombuffer(r.ids, "<u2"), np.frombuffer(r["positions"], "<u2")
            assert len(ids) == len(at) == 256
            for a, b, i, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts, strict=False):
                assert at[a:b].tolist() == list(range(b - a))
                parts.setdefault(i, []).append((s, ids[a:b].tolist()))
            assert not at[r.cu_seqlens[-1] :].any()
        want: dict = {}
        for r in df.collect():
            want.setdefault(r.doc_id, []).append([*coder.encode_ordinary(r.text or ""), 50256])
        for i, texts in want.items():
            if len(texts) == 1:
                assert [x for _, p in sorted(parts[i]) for x in p] == texts[0]
            else:
                assert sum(len(p) for _, p in parts[i]) == sum(map(len, texts))
    assert token_output.pack_documents(empty, path).count() == 0
    out = str(tmp_path / "packed")
    packed = token_output.pack_documents(docs, path, capacity=256, block_tokens=4096)
    token_output.write_packed(packed, out)
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[:2])
    assert order(spark.read.parquet(out).select(packed.columns)) == order(packed)
    files = spark.read.parquet(out).select("block", F.input_file_name().alias("f")).distinct().groupBy("block").count()
    assert files.where("count > 1").count() == 0


# --- tokens ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    path = vocabulary_path()
    return bpe.Bpe(bpe.read_vocabulary(path)), Tokenizer.from_file(path)


def test_bpe_equals_the_library(coders, docs):
    own, lib = coders
    r = random.Random(1)
    alphabet = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　'sdaZé漢1٣½!?.​—🙂́", "<|endoftext|>", "'ll", "  ", " \n", "aaaa"]
    texts = [x.text for x in docs.collect()] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    got = [x.tolist() for x in own.encode_batch(texts)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert all(own.decode(g) == t == lib.decode(g, skip_special_tokens=False) for g, t in zip(got, texts, strict=True))
    long = ["".join(r.choice("abcdeäöst") for _ in range(n)) for n in (511, 513, 5000, 200_000)] + ["ab" * 3000, "a" * 5001, "x " + "the" * 4000 + " y"]
    assert [x.tolist() for x in own.encode_batch(long)] == [e.ids for e in lib.encode_batch(long, add_special_tokens=False)]
    assert own.decode([128]) == lib.decode([128], skip_special_tokens=False)


def test_bpe_tables(spark, coders, awkward, empty):
    _, lib = coders
    path = vocabulary_path()
    back = {(r.doc_id, r.text) for r in tokenize.decode(tokenize.encode(awkward, path), path).collect()}
    assert back == {(r.doc_id, r.text or "") for r in awkward.collect()}
    for r in tokenize.round_trip(awkward.where("doc_id = 8"), path).collect():
        text = awkward.where("doc_id = 8").first().text
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert tokenize.round_trip(empty, path).count() == 0


# --- media ------------------------------------------------------------------------------------------------------------


@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"aaaa", b"ab", b"\0" * 200, b"xyz"]), max_size=60).map(b"".join))
@settings(max_examples=150, deadline=None)
def test_compression_round_trips(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_known_streams():
    # The worked example of the PackBits note, and a stream of clear, 3 codes and end.
    packed = bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA".replace(" ", ""))
    assert tiff.packbits_decode(packed).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"
    # Nine-bit codes by hand: clear, 7, the pair 7 7 (258), 8, 8, 258, 6, 6, end.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    stream = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.lzw_decode(stream) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages(scheme, tile, predictor):
    g = np.random.default_rng(1)
    made = [g.integers(0, 9, shape, dtype=np.uint8) for shape in ((1, 64), (1500, 64), (17, 33))]
    got = list(tiff.pages(tiff.encode(made, scheme, predictor, tile)))
    assert len(got) == 3 and all((a == p.pixels[:, :, 0]).all() for a, p in zip(made, got, strict=True))


def test_big_endian_rgb_with_predictor():
    import struct

    rgb = np.random.default_rng(2).integers(0, 65536, (3, 5, 3)).astype(np.uint16)
    raw = np.diff(rgb, axis=1, prepend=np.zeros((3, 1, 3), np.uint16)).astype(">u2").tobytes()
    body = b"MM\0*" + struct.pack(">I", 8 + len(raw) + 6) + raw + struct.pack(">HHH", 16, 16, 16)
    tags = [(256, 3, 1, 5), (257, 3, 1, 3), (258, 3, 3, 8 + len(raw)), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, 3), (279, 4, 1, len(raw)), (317, 3, 1, 2)]
    body += struct.pack(">H", len(tags))
    for tag, kind, n, v in tags:
        body += struct.pack(">HHI", tag, kind, n) + (struct.pack(">HH", v, 0) if kind == 3 and n == 1 else struct.pack(">I", v))
    (page,) = tiff.pages(body + struct.pack(">I", 0))
    assert (page.pixels == rgb).all()


def test_media_tables(spark, docs, awkward, empty):
    files = tiff.write_media(awkward)
    read = tiff.read_pages(files).collect()
    long = [r for r in read if r.doc_id == 7]
    assert len(read) >= 10 and all(r.error is None for r in read) and b"".join(bytes(r.pixels) for r in long).rstrip(b"\0").decode() == awkward.where("doc_id = 7").first().text
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"II*\0\xff\xff\0\0")), (3, bytearray(b""))], "doc_id long, media binary")
    assert [(r.page, r.error is None) for r in tiff.read_pages(broken).collect()] == [(-1, False)] * 3
    # A header that claims a million pixels squared, with one strip of a few bytes; and a strip that inflates far beyond its page.
    whole = tiff.encode([np.zeros((2, 64), np.uint8)], tiff.DEFLATE, 1)
    tags, _ = tiff._directory(whole, 8 if whole[4:8] == b"\x08\0\0\0" else int.from_bytes(whole[4:8], "little"), "<")
    huge = tags | {tiff.WIDTH: (10**6,), tiff.LENGTH: (10**6,), tiff.ROWS: (10**6,)}
    with pytest.raises(ValueError, match="too short"):
        tiff._page(whole, huge, "<")
    assert len(tiff._unpack(zlib.compress(bytes(10**7)), tiff.DEFLATE, 64)) == 64
    for r in tiff.stored_features(docs.limit(20)).collect():
        raw = docs.where(F.col("doc_id") == r.doc_id).first().text.encode()
        padded = raw + b"\0" * (-len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert tiff.stored_features(empty).count() == 0
    assert {r.payload_bytes for r in tiff.stored_features(awkward.where("text IS NULL OR text = ''")).collect()} == {64}
