"""Whitening, resampling and packing against plain models of their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from maskworks.llm import packing, queries, resampling, textkit, whitening

ENCODER = (public_tokenizers.path(queries.TOKENIZER), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)


# Whitening


def _plain_whitening(vectors):
    kept = {k: np.array([math.floor(64 * float(c)) + 1_000_000 for c in v], object) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted({tuple(x) for x in kept.values()}), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((fit * n - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    values_of, axes = values[order], axes[:, order]
    out = {}
    for k, x in kept.items():
        d = x * n - sums
        y = (d / n).astype(float) @ axes / np.sqrt(values_of)
        out[k] = (n, int((d**2).sum()), y)
    return out, values_of / values.sum()


@pytest.fixture
def many_partitions(spark):
    """Shuffles with so many partitions that states are merged in several rounds."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_a_plain_model(spark, sf, parts, many_partitions):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = [(k, [c * (1 + (j % 7)) for j, c in enumerate(v)]) for k, v in rows]
    rows += [(10_001, rows[0][1]), (10_002, None), (10_003, [None] * len(rows[0][1])), (10_004, [float("nan")] * len(rows[0][1])), (10_005, [float("inf")] * len(rows[0][1])), (10_006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
    rows = [(r[0], r[1]) for r in df.collect()]
    want, share = _plain_whitening(rows)
    got = defaultdict(dict)
    for r in whitening.whiten(df.withColumn("n", F.lit("x")).withColumn("key", F.lit(1)).withColumn("x", F.lit(2))).collect():
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(want)
    signs = {c: np.sign(max((got[k][c]["whitened"] * want[k][2][c - 1] for k in want), key=abs)) for c in range(1, 17)}
    for k, by in got.items():
        n, deviation, y = want[k]
        assert set(by) == set(range(1, 17))
        for c, r in by.items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["whitened"] * signs[c] - y[c - 1]) < 1e-8
            assert abs(r["explained"] / share[c - 1] - 1) < 1e-10 and r["identity_error"] < 1e-9


def test_whitening_of_few_odd_and_large_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, [1.0, 2.0]), (None, [1.0, 2.0])])).count() == 0
    rows = whitening.whiten(make([(None, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.5, 1.0]), (4, [0.5, 0.5, 1.0]), (5, [1e30, 1.0]), (6, [1e15, 0.0, 0.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["n"]) for r in rows if r["component"] == 1) == [(0, 2), (2, 2), (3, 3), (4, 3), (6, 3)]
    far = {r["vec_id"]: r["deviation"] for r in rows}
    assert far[6] is None and far[2] == 128**2


def test_eigen_solver_on_hard_matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 40, 90):
        for kind in range(4):
            a = rng.normal(size=(n, n)) * 10.0 ** rng.integers(-6, 6, n)
            m = {0: a @ a.T, 1: np.eye(n), 2: np.zeros((n, n)), 3: np.diag(np.arange(n) % 3.0) + np.ones((n, n))}[kind]
            values, axes = whitening.eigen(m)
            scale = max(np.abs(m).max(), 1e-300)
            assert np.allclose(values, np.sort(np.linalg.eigvalsh(m))[::-1], atol=1e-12 * scale * n)
            assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-12) and np.allclose(m @ axes, axes * values, atol=1e-12 * scale * n)


# Resampling


def _plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def _plain_resampling(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, _plain_features(text)[1]))
    for text in target:
        t.update(map(bucket, _plain_features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    out = {}
    for k, text in docs:
        n_words, features = _plain_features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
        out[k] = [len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words]
    able = sorted((k for k in out if out[k][3] >= 20), key=lambda k: (-out[k][2], k))
    rank = {k: i + 1 for i, k in enumerate(able[: 5 * len(able) // 100])}
    return {k: (*v[:3], rank.get(k)) for k, v in out.items()}


def test_resampling_equals_a_plain_model(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in queries.op12_resampling(spark, sf).collect()}
    assert got == _plain_resampling(docs, target)


def test_resampling_of_odd_texts(spark):
    long = "ab" * 5000
    odd = ["", None, "Zażółć gęślą JAŹŃ", long, f"x {long} y z", "a" * 64 + " " + "b" * 65 + " c", "one-two_three\n\n4", "...", "word " * 50_000]
    docs = [(i, t) for i, t in enumerate(odd)] + [(-5 - i, " ".join(f"w{i * j % 11}" for j in range(30))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("key", F.lit(1))
    target = spark.createDataFrame([("zażółć w1 w2 w3",), (None,)], "text string")
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in resampling.resample(frame, target).collect()}
    assert got == _plain_resampling(docs, ["zażółć w1 w2 w3", None])
    assert resampling.resample(frame.limit(0), target).count() == 0 and resampling.resample(frame, target.limit(0)).count() == len(docs)
    twice = frame.where("doc_id < 0").select(F.lit(None).cast("long").alias("doc_id"), "text").unionByName(frame.where("doc_id < 0").select(F.lit(7).cast("long").alias("doc_id"), "text"))
    ranks = sorted(r["rank"] for r in resampling.resample(twice, target, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, 61))


def test_draw_is_exact_among_ties_and_over_all_digits(spark):
    rng = np.random.default_rng(3)
    score = rng.choice([0, -1, 1, 1 << 40, -(1 << 50), 5, 6], 3000).tolist()
    key = rng.permutation(np.concatenate([rng.integers(-(1 << 62), 1 << 62, 1500), np.arange(-700, 800)])).tolist()
    rows = spark.createDataFrame(list(zip(key, score, strict=True)), "key long, score long").repartition(9)
    order = sorted(zip(key, score, strict=True), key=lambda r: (-r[1], r[0]))
    for many in (1, 2, 17, 420, 1301, 2999, 3000):
        got = sorted((r["rank"], r["key"]) for r in resampling.drawn(rows, lambda n, m=many: m, "true").collect() if r["rank"])
        assert got == [(i + 1, k) for i, (k, _) in enumerate(order[:many])]


# Packing


def _check_packing(rows, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(ENCODER[0])
    want = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts}
    held, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(held) == set(want)
    for k, pieces in held.items():
        got = []
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == len(got) and r["doc_tokens"] == len(want[k]) and r["length"] * 4 == len(r["ids"])
            got += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert got == want[k]
    sizes = []
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert max(sizes, default=0) <= 1024 and all(n == 1024 or n & (n - 1) == 0 for n in sizes)
    assert sum(n != 1024 for n in sizes) <= 10
    return len(rows)


def test_packing_keeps_all_ids_in_full_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, ENCODER).collect()
    _check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries.op13_packing(spark, sf).collect()}
    assert digest == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in rows}


def test_packing_of_odd_texts(spark):
    odd = ["", None, "a", " ", "\n", "a  b", "a \n b\n\nc\n", "x<|endoftext|> y <|endoftext|>", "  lead", "trail  ", "é è ü 　 中文 字 x \u0085y", "it's we 'll\n'd", "1234 56\t7", "﻿ b ﻿",
           "word " * 40_000, "\n".join(f"line {i} né" for i in range(3000)), "q" * 30_000, "a\x1cb \x1fc", "\r\n x\r\ny"]
    texts = list(enumerate(odd)) + [(100 + i, "some words of a text " * (i % 17)) for i in range(300)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("mine")).withColumn("ids", F.lit(1)).repartition(5)
    _check_packing(packing.pack(frame, ENCODER).collect(), texts)
    assert packing.pack(frame.limit(0), ENCODER).count() == 0
    same = packing.pack(frame.where("doc_id >= 100").select(F.lit(None).cast("long").alias("doc_id"), "text"), ENCODER)
    assert same.agg(F.sum(F.when(F.col("start") == 0, 1))).first()[0] == 300


def test_chunks_encode_as_the_tokenizer_does(spark, sf):
    from tokenizers import Tokenizer

    plain, chunks = Tokenizer.from_file(ENCODER[0]), packing.ChunkEncoder(*ENCODER)
    words = [t for t in plain.get_vocab() if t.isascii()]
    spoken = [plain.decode([i]) for i in range(50_000)]
    texts = [" ".join(spoken[i : i + 50]) for i in range(0, 50_000, 50)] + ["".join(spoken[i : i + 50]) for i in range(0, 50_000, 50)] + [" ".join(words[:5000])]
    settled = [chr(c) for c in (*range(0x250), *range(0x400, 0x500), *range(0x2010, 0x2028), *range(0x4E00, 0x9FA6))]
    texts += ["".join(f" {c}{c} x{c}1{c}\n{c}" for c in settled[i : i + 100]) for i in range(0, len(settled), 100)]
    import pyarrow as pa

    ids, ends = chunks(*textkit.utf8(pa.array(texts)))
    at = 0
    for text, end in zip(texts, ends, strict=True):
        assert ids[at:end].tolist() == plain.encode(text, add_special_tokens=False).ids
        at = end


@pytest.mark.parametrize("kind", ["even", "hot", "few", "none"])
def test_plan_fills_windows(kind):
    rng = np.random.default_rng(5)
    lengths = {"even": rng.integers(1, 65, 3000), "hot": np.concatenate([np.full(900, 43), rng.integers(1, 64, 500)]), "few": np.array([64, 63, 1, 30]), "none": np.zeros(0, int)}[kind]
    counts = np.bincount(lengths, minlength=65)
    made = packing.plan(counts, 64)
    length, number = np.repeat(np.arange(65), counts), np.concatenate([np.arange(c) for c in counts])
    if not len(length):
        return
    row, start, size, sequence, offset = packing.placed(made, length, number)
    total = np.bincount(sequence, size)
    assert size.sum() == length.sum() and sum(total != 64) <= 6 and all(int(n) & (int(n) - 1) == 0 for n in total)
    assert len(set(zip(sequence.tolist(), offset.tolist(), strict=True))) == len(row)
    whole = np.bincount(row, minlength=len(length)) == 1
    assert kind != "even" or whole.mean() > 0.9


def test_least_squares_is_near_the_optimum():
    rng = np.random.default_rng(6)
    counts = np.concatenate(([0.0], rng.integers(0, 500, 63)))
    combos = packing.combinations(np.flatnonzero(counts), 64)
    x = packing.least_squares(combos, counts)
    assert (x >= 0).all() and (combos.sum(1) == 64).all()
    used = np.bincount(combos.ravel(), np.repeat(x, 3), 64)
    used[0] = 0
    gain = (counts - used)[combos] * (combos > 0)
    # At an optimum no column could lower the distance, and those in use are level.
    assert gain.sum(1).max() < 0.05 * counts.max() and abs(gain.sum(1)[x > 0]).max() < 1e-3 * counts.max()
