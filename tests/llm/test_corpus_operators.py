"""Operators that look at the whole corpus: line dedup, embeddings, language model, WARC, n-gram join, pipeline."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same  # noqa: E402

import corpus_pipeline  # noqa: E402
from maskworks.llm import class_lm, embedding_tiles, line_dedup, ngram_join, queries, warc  # noqa: E402
from maskworks.llm.components import components  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (3, None), (5, 6), (6, 5)]
    edges += [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {(x["node"], x["component"]) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_keeps_first_and_removes_shifted_passages(spark):
    lines = [f"line number {i} of a passage with its own words {i * i}" for i in range(40)]
    passage = "\n".join(lines)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"own start\n{passage}\nown end"), (2, f"other\nstart here\n{passage}\nmore"), (3, None), (4, ""), (5, f"a\n{long}\nb"), (6, f"c\nd\n{long}"), (6, f"c\nd\n{long}"), (None, f"x\n{long}\ny")]
    docs = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, lines_before string, other int")
    out = {(r["doc_id"], r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    by_id = {d: t for d, t, _ in out}
    assert by_id[1] == rows[0][1] and by_id[3] is None and by_id[4] == ""
    assert by_id[2].startswith("other\nstart here\n") and by_id[2].endswith("\nmore") and len(by_id[2]) < len(passage) / 3
    assert by_id[5] == rows[4][1] and by_id[6] == "c\nd" and by_id[None] == "x\ny"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_removes_short_passages_whole(spark):
    r = random.Random(12)
    line = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows, passages = [], []
    for i in range(60):
        size = 2 + i % 5
        passages.append([line(51 // size + 1) for _ in range(size)])
        rows += [(2 * i, [line(5), *passages[-1], line(5)]), (2 * i + 1, [line(4), line(3), *passages[-1], line(6)])]
    rows += [(500, [line(4), *passages[3][:2], line(4), *passages[7], *passages[8], line(4)]), (501, ["", line(30), line(30), "", "x", line(30)])]
    rows += [(502, [*rows[-1][1][1:3], "y", *rows[-1][1][:3]])]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    out = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs).collect()}
    for i, passage in enumerate(passages):
        assert out[2 * i]["text"] == "\n".join(rows[2 * i][1]) and out[2 * i]["lines_removed"] == 0
        own = rows[2 * i + 1][1]
        assert out[2 * i + 1]["text"] == "\n".join([*own[:2], own[-1]]), len(passage)
    assert not set(out[500]["text"].split("\n")) & {*passages[7], *passages[8]} and out[500]["lines_before"] == len(rows[-3][1])
    assert out[502]["text"] == "y" and out[501]["lines_removed"] == 0
    assert {x for _, t in rows for x in t} == {x for o in out.values() for x in o["text"].split("\n")}


def test_line_dedup_leaves_what_stands_nowhere_else(spark):
    a, b, c, d, x, y, z = (" ".join(f"{n}{i}" for i in range(20)) for n in "abcdxyz")
    rows = [(1, [a, b, x]), (2, [b, c, y]), (3, [c, d, z]), (4, [a, b, c, d])]
    out = line_dedup.dedup_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string"))
    # Whole chunks of two lines may go, as each stands elsewhere; no run does.
    kept = {x["doc_id"]: x["text"].split("\n") for x in out.collect()}
    gone = [line for line in rows[3][1] if line not in kept[4]]
    assert [kept[i] for i in (1, 2, 3)] == [t for _, t in rows[:3]] and len(gone) <= 2 and all(any("\n".join(gone) in "\n".join(t) for _, t in rows[:3]) for _ in gone)


def _plain_dedup(docs):
    """Chunks and runs by the definitions of the operator, document by document."""
    chunks, pairs = {}, {}
    cut = {}
    for k, text in docs:
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        long = [x.count(" ") >= line_dedup.PASSAGE_WORDS for x in lines]
        ends = [i + 1 for i in range(len(lines)) if (h[i] + 31 * (h[i - 1] if i else 0)) % 3 == 0 or long[i] or i + 1 == len(lines) or long[i + 1]]
        cut[k] = [(s, e) for s, e in zip([0, *ends], ends, strict=False) if e - s > 1 or long[s]]
        for s, e in cut[k]:
            chunks.setdefault("\n".join(lines[s:e]), (k, s))
        for i in range(len(lines) - 1):
            pairs.setdefault((lines[i], lines[i + 1]), (k, i))
    out = {}
    for k, text in docs:
        lines = text.split("\n")
        gone = {i for s, e in cut[k] if chunks["\n".join(lines[s:e])] != (k, s) for i in range(s, e)}
        first = [pairs[lines[i], lines[i + 1]] for i in range(len(lines) - 1)]
        i = 0
        while i < len(first):
            j = i
            while first[i] != (k, i) and j + 1 < len(first) and first[j + 1] == (first[j][0], first[j][1] + 1) and first[j + 1] != (k, j + 1):
                j += 1
            if first[i] != (k, i) and sum(len(x.split()) for x in lines[i : j + 2]) > line_dedup.PASSAGE_WORDS:
                gone |= set(range(i, j + 2))
            i = j + 1
        out[k] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_equals_a_plain_model(spark, tmp_path, seed):
    r = random.Random(seed)
    pool = [" ".join(f"w{r.randrange(999)}" for _ in range(r.choice((0, 1, 9, 17, 26, 55)))) for _ in range(30)]
    docs = []
    for k in range(80):
        lines = [r.choice(pool) if r.random() < 0.3 else f"own {k} {i}" for i in range(r.randrange(1, 12))]
        if docs and r.random() < 0.7:
            other = r.choice(docs)[1].split("\n")
            a = r.randrange(len(other))
            lines[len(lines) // 2 :] = other[a : a + r.randrange(1, 9)]
        docs.append((k, "\n".join(lines)))
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {x["doc_id"]: (x["text"], x["lines_removed"]) for x in out.collect()} == _plain_dedup(docs)
    # The registered query and its SQL on the same documents.
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    (file,) = (tmp_path / "x").glob("part-*.parquet")
    file.rename(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.execute(queries.OP2_SQL).fetchall()
    got = [tuple(x) for x in queries.op2_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_line_dedup_runs_no_python(spark, sf):
    plan = queries.op2_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_embeddings_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_tiles, "TILE", 8)
    r = random.Random(6)
    base = [[r.gauss(0, 1) for _ in range(20)] for _ in range(12)]
    rows = []
    for i in range(150):
        b = r.choice(base)
        rows.append((i, [x + r.gauss(0, 0.12) for x in b], r.randrange(2)))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], rows[0][2]), (202, [x * 3 for x in rows[0][1]], rows[0][2])]
    rows += [(300, None, 1), (301, [0.0] * 20, 1), (302, [float("nan")] + [1.0] * 19, 1), (303, rows[0][1], None), (304, [None] + [1.0] * 19, 1), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] * 20, 0)]
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    able = [x for x in rows if x[1] and x[2] is not None and all(v is not None and math.isfinite(v) for v in x[1]) and any(x[1])]
    near = {x[0]: [y[0] for y in able if y[0] != x[0] and y[2] == x[2] and len(y[1]) == len(x[1]) and cos(x[1], y[1]) >= 0.93] for x in able}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    got = {x["vec_id"]: x for x in embedding_tiles.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for i, _, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(near.get(i, [])), reach(i), reach(i) == i), i
    assert embedding_tiles.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language_model_base_is_exact_and_classes_help(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in docs}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    total, distinct = sum(c.values()), len(c)
    base = score = 0.0
    for r in queries.op7_lm_scoring(spark, sf).collect():
        ws = tokens[r["doc_id"]]
        want = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        base, score = (base + want, score + r["score"]) if held[r["doc_id"]] else (base, score)
    assert score > base


def test_language_model_of_odd_rows(spark):
    rows = [(1, None, True), (2, "", True), (2, "a b a", True), (None, "A b  c!", False), (4, "w " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumn("score", F.lit("clash"))
    out = class_lm.score_texts(docs, "learn").collect()
    assert sorted(r["n_tokens"] for r in out) == [1, 1, 4, 4, 50_001] and {r["train_tokens"] for r in out} == {6}
    none = class_lm.score_texts(docs.withColumn("learn", F.lit(False)), "learn").collect()
    assert {(r["n_known"], r["base_score"]) for r in none} == {(0, 0.0)}
    assert class_lm.score_texts(docs.limit(0), "learn").count() == 0


@pytest.mark.parametrize("core", [1 << 13, 60])
def test_words_outside_the_core_are_classed_by_their_neighbours(spark, core):
    r = random.Random(3)
    common, rows = [f"c{i}" for i in range(20)], []
    for i in range(3000):
        # Each rare word occurs five times, always between words of its own kind.
        kind = "ab"[i % 2]
        rows.append((i, " ".join(x for _ in range(60) for x in (f"{kind}left", kind + r.choice(common), f"{kind}right")) + f" {kind}left {kind}rare{i // 10} {kind}right", True))
    held = [(5000 + i, f"{k}left {w}rare{n} {k}right") for i, (k, w, n) in enumerate((k, w, n) for k in "ab" for w in "ab" for n in range(100))]
    docs = spark.createDataFrame([*rows, *((i, t, False) for i, t in held)], "doc_id long, text string, learn boolean")
    got = {x["doc_id"]: x["score"] - x["base_score"] for x in class_lm.score_texts(docs, "learn", core_words=core).where("doc_id >= 5000").collect()}
    own = [got[5000 + i] for i in (*range(100), *range(300, 400))]
    other = [got[5000 + i] for i in range(100, 300)]
    assert sum(own) / 200 > sum(other) / 200 + 0.2


def test_every_round_gains_and_every_repeated_word_gets_a_class(spark, sf, monkeypatch):
    seen, exchange, rest = [], class_lm._exchange, class_lm._rest_classes
    monkeypatch.setattr(class_lm, "_exchange", lambda *a: seen.append(exchange(*a)) or seen[0])
    monkeypatch.setattr(class_lm, "_rest_classes", lambda *a: seen.append(rest(*a)) or seen[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("learn", F.lit(True))
    class_lm.score_texts(docs.select("doc_id", "text", "learn"), "learn", core_words=500).count()
    _, _, reached = seen[0]
    assert len(reached) > 2 and all(b > a for a, b in zip(reached, reached[1:]))
    counts = Counter(w for x in docs.collect() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x["text"] or "")))
    assert seen[1].count() == sum(n >= class_lm.LEAST_COUNT for n in counts.values()) - 500


def test_class_gains_match_brute_force():
    import numpy as np

    r = np.random.default_rng(5)
    codes, words = class_lm.CODES, 30
    own = r.integers(0, class_lm.CLASSES, words)
    own[20:] = class_lm.CLASSES + r.integers(0, 4, 10)
    text = r.integers(0, words, 4000)
    best = None
    for w in (0, 7, 25):

        def table(cls, w=w):
            c = own.copy()
            c[w] = cls
            t = np.zeros((codes, codes))
            np.add.at(t, (c[text[:-1]], c[text[1:]]), 1)
            return class_lm.likelihood(t)

        # The text has no place where the word stands beside itself; such places count only about.
        text = text[np.concatenate(([True], (text[1:] != w) | (text[:-1] != w)))]
        t = np.zeros((codes, codes))
        np.add.at(t, (own[text[:-1]], own[text[1:]]), 1)
        behind, front = own[text[1:][text[:-1] == w]], own[text[:-1][text[1:] == w]]
        parts = class_lm._summed(np.zeros(len(behind) + len(front), np.int64), np.concatenate([behind, codes + front]), np.ones(len(behind) + len(front)))
        best = class_lm.best_classes(*parts, own[[w]], t, stay=False)[0][0]
        every = [table(c) for c in range(class_lm.CLASSES)]
        assert math.isclose(every[best], max(every), rel_tol=1e-9)
    assert best is not None


def test_warc_round_trip_over_small_splits(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    r = random.Random(9)
    noise = lambda n: "".join(chr(r.randrange(32, 0x250)) for _ in range(n))
    same = noise(300)
    rows = [(i, f"http://x/{i}\r\n", noise(r.randint(0, 3000))) for i in range(60)] + [(100, None, same), (90, "u", same), (95, "u", same), (101, "u", None), (102, "u", ""), (103, "u", "tiny"), (104, "u", "tiny"), (105, "magic", "\x1f\x8b\x08" * 50)]
    rows += [(None, "n", noise(200)), (90, "again", same)]
    pages = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(pages)
    assert archives.count() > 1
    for split in (97, 5000, 1 << 22):
        got = warc.read_archives(archives, split_bytes=split).collect()
        assert len(got) == len(rows)
        for x in got:
            if x["record_type"] == "response":
                assert x["payload"].decode() in [h or "" for p, _, h in rows if p == x["page_id"]]
        revisits = {(x["page_id"], x["refers_to"]) for x in got if x["record_type"] == "revisit"}
        assert revisits == {(100, 90), (95, 90)} and {x["payload_bytes"] for x in got if x["page_id"] == 100} == {len(same.encode())}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def _jaccard(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def test_ngram_join_matches_brute_force(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows, shared = [], [r.choice(words) for _ in range(60)]
    for c in range(12):
        text = [r.choice(words) for _ in range(r.choice([3, 8, 40, 120, 400]))] + (shared if c % 2 else [])
        for m in range(r.choice([1, 2, 6, 25])):
            own = list(text)
            for _ in range(r.choice([0, 1, 2, len(own) // 25])):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((1000 - len(rows), " ".join(own)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, rows[0][1]), (7, rows[0][1]), (None, rows[0][1].upper()), (None, "alone here")]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, n string")
    want = _jaccard(rows)
    for tile in (2048, 2):
        monkeypatch.setattr(ngram_join, "TILE", tile)
        monkeypatch.setattr(ngram_join, "COUNT_BITS", 12 if tile == 2 else 20)
        assert sorted((tuple(x) for x in ngram_join.jaccard_groups(docs).collect()), key=repr) == want
    one = ngram_join.one_of_each(docs)
    kept = [(x["doc_id"], x["text"]) for x in one.collect()]
    groups = {c for k, n, c in want if n}
    assert len([k for k, t in kept if (t or "").strip()]) == len(groups | {None}) and {1, 2, 3} <= {k for k, _ in kept}
    assert one.columns == docs.columns and ngram_join.jaccard_groups(docs.limit(0)).count() == 0


def test_pipeline_stages_on_odd_tables(spark, sf):
    """Empty tables, clashing names of other types, repeated and null ids: nothing is lost and no column changes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = docs.withColumn("rejected", F.lit("mine")).withColumn("leaks", F.lit(7)).withColumn("lines_removed", F.lit("x")).withColumn("p_toxic", F.lit(True)).withColumn("key", F.lit(1)).withColumn("n_tokens", F.lit("n"))
    extra = odd.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    odd = odd.unionByName(odd.limit(2)).unionByName(extra.withColumn("text", F.lit(None).cast("string"))).unionByName(extra.withColumn("text", F.lit("")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.schema.simpleString() == odd.schema.simpleString(), name
        rows = out.collect()
        assert all((r["rejected"], r["leaks"], r["lines_removed"], r["p_toxic"], r["key"], r["n_tokens"]) == ("mine", 7, "x", True, 1, "n") for r in rows), name
        assert sorted(str(r["text"]) for r in rows if r["doc_id"] is None) == ["", "None"] and len(rows) > 20, name
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0


def test_pipeline_stages_keep_columns_and_decide(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    extra = [(10_000, texts[3], "en", "s", 1), (10_001, f"{texts[5]} {item} and so on", "en", "s", 1), (10_002, None, None, None, None), (10_003, "", "en", "s", 0)]
    now = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    before = {r["doc_id"] for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= before and {10_002, 10_003} <= set(ids)
    assert 10_000 not in ids and 10_001 not in ids and len(ids) > 0.8 * docs.count() - 40
