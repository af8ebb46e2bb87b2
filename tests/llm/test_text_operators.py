"""Operators that judge documents one by one: language, license, pieces, toxicity, decontamination."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from re import _constants as codes
from re import _parser as parser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from maskworks.llm import decontamination, language_bloom, license_scan, queries, sentencepiece_codec, textkit, toxicity_chain
from maskworks.llm.license_rules import rules

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "  \n\t ", None), (4, "Ab ▁ é　日本 <unk></s> \x00😀", "z"), (5, "word " * 30_000, "z"), (6, "x" * 70_000, None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    return rows.withColumn("n_words", F.lit("clash")).withColumn("lang", F.lit("en"))


def test_words_and_shingles_match_plain_python():
    r = random.Random(5)
    texts = [None, "", " ", "A", *("".join(r.choice("aB \n\té ") for _ in range(r.randint(0, 60))) for _ in range(200))]
    seen = {}
    for a, b, words in textkit.word_batches(pa.array(texts)):
        hashes = words.hashes()
        for i in range(a, b):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[i] or "")
            plain = re.findall(r"[^\x20\x09-\x0D]+", low)
            own = hashes[words.first[i - a] : words.first[i - a + 1]]
            assert len(own) == len(plain)
            for w, h in zip(plain, own, strict=True):
                assert seen.setdefault(w, h) == h
        for i, own in zip(range(a, b), textkit.shingle_sets(words, 5), strict=True):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[i] or "")
            w = re.findall(r"[^\x20\x09-\x0D]+", low)
            assert len(own) == (len({tuple(w[j : j + 5]) for j in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w)))
    assert len(set(seen.values())) == len(seen)


def test_language_id_learns_and_handles_odd_rows(spark, sf, odd):
    out = queries.op1_language_id(spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    model = language_bloom.train(docs.limit(0).select(F.lit("a").alias("text"), "lang"))
    empty = language_bloom.predict(odd.drop("lang"), spark.sparkContext.broadcast(model)).collect()
    assert len(empty) == len(ODD) and {r["lang_pred"] for r in empty} == {"und"}
    taught = language_bloom.train(spark.createDataFrame([("the and of", "en"), ("der die und", "de"), (None, "de")], "text string, lang string"))
    got = {(r["doc_id"], r["lang_pred"]) for r in language_bloom.predict(odd.drop("lang"), spark.sparkContext.broadcast(taught)).collect()}
    assert {(1, "und"), (2, "und"), (None, "und")} <= got


def test_ngrams_match_plain_python():
    table = language_bloom.letter_table()
    texts = ["Hallo, Wörld 12 x", "", None, "a", "é!", "123", "ab cd  ef", "ÀÉ日本 x", "!", "a!b"]

    def grams(text):
        s = re.sub(" +", " ", " " + "".join(chr(table[ord(c)]) for c in text) + " ")
        return [s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].strip()]

    for a, b, own, doc in language_bloom.gram_batches(pa.array(texts)):
        for i in range(a, b):
            want = [((ord(g[0]) * 0x110000 + ord(g[1])) * 0x110000 + ord(g[2]) + 3) & (2**64 - 1) for g in grams(texts[i] or "")]
            assert sorted(own[doc == i - a]) == sorted(textkit.mix(np.array(want, np.uint64)))


def test_license_rules_and_base_phrases(spark, odd):
    assert len(rules()) > 200
    cases = {
        "Released under the MIT License.": ("mit", "mit", 1),
        "Licensed under the Apache License, Version 2.0.": ("apache-2", "apache-2", 1),
        "CC-BY-NC and cc by nc": ("cc-by-nc", "cc-by-nc", 2),
        "licensed under the GNU General Public License, version 3.": ("", "gpl-3", 0),
        "SPDX-License-Identifier: BSD-3-Clause": ("", "bsd-3-clause", 0),
        "nothing here": ("", "", 0),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        base, labels, n = list(cases.values())[r["doc_id"]]
        assert sorted({b["label"] for b in r["base"]}) == [x for x in [base] if x] and len(r["base"]) == n
        assert {x["label"] for x in r["found"]} | {b["label"] for b in r["base"]} == {x for x in [labels] if x}
    out = license_scan.scan(odd).collect()
    assert len(out) == len(ODD) and {r["n_words"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert next(r["n_words"] for r in out if r["doc_id"] == 5) == 30_000


def _examples(tree) -> list[str]:
    """Strings that a parsed expression matches: its first choice everywhere, then every other choice once."""
    parts = []
    for op, arg in tree:
        if op is codes.LITERAL:
            parts.append([chr(arg)])
        elif op is codes.NOT_LITERAL:
            parts.append(["zz"])
        elif op is codes.IN:
            parts.append([chr(c) for o, v in arg for c in ([v] if o is codes.LITERAL else range(v[0], v[1] + 1))])
        elif op is codes.SUBPATTERN:
            parts.append(_examples(arg[3]))
        elif op is codes.BRANCH:
            parts.append([x for branch in arg[1] for x in _examples(branch)])
        else:
            assert op is codes.MAX_REPEAT
            parts.append([""] * (arg[0] == 0) + _examples(arg[2]))
    first = [p[0] for p in parts]
    return ["".join(first), *("".join([*first[:i], x, *first[i + 1 :]]) for i, p in enumerate(parts) for x in p[1:])]


def test_license_prefilter_loses_no_match(monkeypatch):
    texts = {x for rule in rules() for x in _examples(parser.parse(rule.pattern)) if rule.compiled().search(f" {x} ")}
    assert len(texts) > 5 * len(rules())
    gated = {x: license_scan.detect(f" so {x} it ".encode()) for x in texts}
    for x, (base, kept) in gated.items():
        assert any(a == 4 for a, *_ in [*base, *kept]), x
    everywhere = {(): [(i, rule, re.compile(f"(?<= )(?:{rule.pattern})(?= )".encode())) for i, rule in enumerate(rules())]}
    monkeypatch.setattr(license_scan, "_by_needs", lambda: everywhere)
    assert gated == {x: license_scan.detect(f" so {x} it ".encode()) for x in texts}


@pytest.mark.parametrize(
    "text, label",
    [
        ("GPLv3", "gpl-3"),
        ("GNU GPL v2", "gpl-2"),
        ("the GNU LGPL", "lgpl"),
        ("GNU AGPL", "agpl"),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"),
        ("Creative Commons Zero", "cc0"),
        ("MIT No Attribution", "mit-0"),
        ("Zero-Clause BSD", "0bsd"),
        ("Historical Permission Notice and Disclaimer", "hpnd"),
        ("available under the GPL 3.0", "gpl-3"),
        ("licensed per CC BY-SA 4.0", "cc-by-sa"),
    ],
)
def test_license_names_without_the_word_license(text, label):
    assert [x[2] for x in license_scan.detect(license_scan.normal_form(text)[0])[1]] == [label]


def test_license_query_matches_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for r in queries.op5_license_scans(spark, sf).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r["doc_id"]])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


def test_pieces_equal_the_library(spark, sf, odd):
    codec = sentencepiece_codec.ChunkCodec(MODEL, entries=60)
    r = random.Random(2)
    texts = [None, *(t for _, t, _ in ODD if t is not None), *("".join(r.choice("ab  ▁\n\té<0x41>unk　\x00😀") for _ in range(r.randint(0, 30))) for _ in range(1500))]
    for text, (ids, decoded) in zip(texts, codec.encode_decode(texts), strict=True):
        want = codec.model.encode(text or "")
        assert ids == ",".join(map(str, want)) and decoded == codec.model.decode(want)
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in queries.op9_sentencepiece(spark, sf).collect():
        want = codec.model.encode(docs[x["doc_id"]] or "")
        assert x["n_tokens"] == len(want) and x["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(codec.model.decode(want).encode()).hexdigest()
    full = sentencepiece_codec.encode_decode(odd, MODEL)
    assert {c for c in odd.columns} <= set(full.columns) and full.where("doc_id = 1").first()["piece_ids"] == []
    assert sentencepiece_codec.digests(odd.limit(0), MODEL).count() == 0


def test_classifier_chain_learns_toxic_words(spark, odd):
    r = random.Random(1)
    plain = ["blue", "green", "house", "tree", "river", "stone"]
    rows = [(i, " ".join(r.choice(plain) for _ in range(40)) + (" idiot scum" if i % 5 == 0 else ""), int(i % 7 > 0), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, q, t) for a, _, q, t in rows] + [(0, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity_chain.train(docs.where("doc_id < 300"), labels)
    assert [len(m.earlier) for m in chain] == [0, 1, 2]
    out = toxicity_chain.score(docs, spark.sparkContext.broadcast(chain))
    assert out.where("doc_id >= 300 and rejected <> (doc_id % 5 = 0)").count() == 0
    assert out.columns == ["doc_id", "text", "p_low_quality", "p_toxic", "p_toxic_low_quality", "rejected"]
    odd_out = toxicity_chain.score(odd, spark.sparkContext.broadcast(chain)).collect()
    assert len(odd_out) == len(ODD) and not any(x["rejected"] for x in odd_out)
    none = toxicity_chain.train(docs, labels.limit(0))
    assert not any(x["rejected"] for x in toxicity_chain.score(docs, spark.sparkContext.broadcast(none)).collect())

def _plain_features(text: str) -> Counter:
    low = text.lower().encode()
    words = re.findall(rb"[A-Za-z\x80-\xff]+", low)
    return Counter([(0, w) for w in words] + [(p, w[:p]) for w in words for p in toxicity_chain.PREFIXES])


def test_chain_equals_one_fitted_on_all_features(spark):
    r = random.Random(21)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(150)]
    rows = []
    for i in range(500):
        toxic, low = int(r.random() < 0.3), int(r.random() < 0.4)
        own = [r.choice(words[40 * toxic : 40 * toxic + 60] + words[100 + 20 * low : 120 + 20 * low]) for _ in range(r.randint(0, 30))]
        rows.append((i, " ".join(own), 1 - low, toxic))
    docs = spark.createDataFrame([(a, b) for a, b, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, q, t) for a, _, q, t in rows if a < 400], "doc_id long, quality int, toxic int")
    chain = toxicity_chain.train(docs, labels, most=40)
    got = {x["doc_id"]: x for x in toxicity_chain.score(docs, spark.sparkContext.broadcast(chain)).collect()}
    feats, doc = [], []
    for a, _, f, d in toxicity_chain.feature_batches(pa.array([t for i, t, _, _ in rows])):
        f, d = toxicity_chain._levels(f, d)
        feats.append(f)
        doc.append(a + d)
    feats, doc = np.concatenate(feats), np.concatenate(doc)
    distinct, column = np.unique(feats, return_inverse=True)
    taught = doc < 400
    low, toxic = np.array([q <= 0 for _, _, q, _ in rows[:400]]), np.array([t > 0 for _, _, _, t in rows[:400]])
    fold = np.array([zlib.crc32(str(i).encode()) % toxicity_chain.FOLDS for i in range(400)])
    whole = toxicity_chain.fit_chain(column[taught], doc[taught], distinct, np.column_stack([low, toxic, toxic & low]).astype(float), np.ones(400), fold, 40)
    p = np.zeros((500, 3))
    for k, model in enumerate(whole):
        place = {f: w for f, w in zip(model.features.tolist(), model.weights, strict=True)}
        z = np.full(500, model.bias) + p[:, :k] @ model.earlier
        for f, d in zip(feats.tolist(), doc, strict=True):
            z[d] += place.get(f, 0.0)
        p[:, k] = 1 / (1 + np.exp(-z))
    for i, text, _, _ in rows:
        want = p[i] if text else np.zeros(3)
        assert np.allclose([got[i]["p_low_quality"], got[i]["p_toxic"], got[i]["p_toxic_low_quality"]], want, atol=1e-6), i
        assert got[i]["rejected"] == (want[1] >= toxicity_chain.THRESHOLD)


def test_features_are_words_beginnings_and_shares():
    texts = ["Abcdefgh abc", "", None, "x, y! Z", "ÄÖ äö word word"]
    for a, b, feats, doc in toxicity_chain.feature_batches(pa.array(texts)):
        for i in range(a, b):
            assert len(feats[doc == i - a]) == sum(_plain_features(texts[i] or "").values()) + 2


def test_features_of_a_batch_are_made_piece_by_piece():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    texts = pa.array([" ".join(r.choices(words, k=500)) for _ in range(3000)])
    before, most = pa.total_allocated_bytes(), 0
    for _ in toxicity_chain.feature_batches(texts):
        most = max(most, pa.total_allocated_bytes() - before)
    assert most < texts.nbytes / 8
    batch = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(len(texts), dtype=np.int32) % 16)], names=["text", "slot"])
    found = Counter()
    tracemalloc.start()
    for out in toxicity_chain._counted(iter([batch])):
        found[0] += pc.sum(out.column(2)).as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    assert found[0] == sum(len(toxicity_chain._levels(f, d)[0]) for _, _, f, d in toxicity_chain.feature_batches(texts))


def test_training_writes_the_sample_alone_and_scores_need_no_texts(spark, monkeypatch):
    names, written = [], toxicity_chain.written
    monkeypatch.setattr(toxicity_chain, "written", lambda df, name: names.append(name) or written(df, name))
    docs = spark.createDataFrame([(i, None if i == 7 else "" if i == 8 else "blue tree" + " scum" * (i % 3 == 0)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    chain = spark.sparkContext.broadcast(toxicity_chain.train(docs, labels))
    assert names == ["labelled"]
    out = toxicity_chain.score(docs, chain, texts=False)
    assert out.columns == ["doc_id", "p_low_quality", "p_toxic", "p_toxic_low_quality", "rejected"]
    assert sorted(out.collect()) == sorted(toxicity_chain.score(docs, chain).drop("text").collect())


def test_classifier_without_labelled_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, "c d"), (2, "c d"), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for d, known in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.where("doc_id = 7")), (docs.withColumn("text", F.lit(None).cast("string")), labels), (docs, labels)):
        chain = toxicity_chain.train(d, known)
        assert len(chain) == 3
        out = toxicity_chain.score(docs, spark.sparkContext.broadcast(chain)).collect()
        assert len(out) == 5 and not any(x["rejected"] for x in out if x["text"] is None)


def _distance(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_matches_brute_force():
    r = random.Random(3)
    parts = ["ab", "cde", "fgh", "ijé", "kl", "mno", "pqr"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    for _ in range(15):
        items = [(i, " ".join(word() for _ in range(r.randint(3, 45)))) for i in range(4)]
        docs = []
        for _ in range(6):
            own = list(r.choice(items)[1])
            for _ in range(r.randint(0, len(own) // 8)):
                k = r.randrange(len(own))
                own[k] = r.choice(["x", "", own[k] + "z"])
            docs.append(" ".join(word() for _ in range(r.randint(0, 40))) + " " + "".join(own).upper() + "!! " + word())
        patterns = decontamination.Patterns(items)
        offsets, data = textkit.utf8(pa.array(docs))
        got = {(a, b) for a, b, *_ in patterns.matches(offsets, data)}
        want = set()
        for i, text in enumerate(docs):
            raw = np.frombuffer(text.encode(), np.uint8)
            form = decontamination.normal_form(np.array([0, len(raw)]), raw)[0].tobytes()
            want |= {(i, item) for own, piece, e in zip(patterns.items, patterns.text, patterns.edits, strict=True) if _distance(piece, form) <= e for item in own}
        assert got == want
        with pytest.MonkeyPatch.context() as patch:  # in small pieces, split by place and by window
            patch.setattr(decontamination, "HITS", 40)
            patch.setattr(decontamination, "_PIECE", 128)
            assert {(a, b) for a, b, *_ in patterns.matches(offsets, data)} == want


def test_excerpts_of_the_stated_length_are_found_wherever_they_begin():
    r = random.Random(5)
    item = "".join(r.choice("abcdefghijklmnop") for _ in range(700))
    patterns = decontamination.Patterns([(1, item), (2, item), (None, "some other words that stand in no text here")])
    size = decontamination.WINDOW + decontamination.STRIDE - 1
    docs = ["xyz " * 50 + item[a : a + size].upper() + " zyx" * 50 for a in range(0, 700 - size, 7)]
    found = list(patterns.matches(*textkit.utf8(pa.array(docs))))
    assert {(row, i) for row, i, *_ in found} == {(row, i) for row in range(len(docs)) for i in (1, 2)}
    assert all(docs[row][a:b].lower() in item and edits == 0 for row, _, a, b, edits in found if edits == 0)


def test_the_best_leaks_that_do_not_overlap():
    found = {(2, 0, 10, 7), (0, 5, 15, 7), (1, 15, 25, 7), (2, 20, 30, 7), (3, 0, 10, None)}
    assert decontamination.best_apart(found) == [
        {"item_id": 7, "start": 5, "stop": 15, "edits": 0},
        {"item_id": 7, "start": 15, "stop": 25, "edits": 1},
        {"item_id": None, "start": 0, "stop": 10, "edits": 3},
    ]


def test_a_very_long_text_of_one_repeated_item_takes_bounded_memory():
    import tracemalloc

    items = [(i, "alpha beta gamma delta epsilon zeta eta theta " * 6 + str(i)) for i in range(300)]
    patterns = decontamination.Patterns(items)
    offsets, data = textkit.utf8(pa.array(["alpha beta gamma delta epsilon zeta eta theta " * 60_000]))
    form, bounds, _ = decontamination.normal_form(offsets, data)
    tracemalloc.start()
    for n, _ in enumerate(patterns._candidates(form, bounds)):
        if n == 3:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_decontamination_of_odd_rows_and_in_passes(spark, odd, monkeypatch):
    item = "A passage of the benchmark that is long enough to be looked for in any text."
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, item + " More of it."), (7, item)], "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame([(50, f"before {item.upper()} after", "s", "c", "en")], odd.columns and "doc_id long, text string, score string, n_words string, lang string"))
    one = {(r["doc_id"], tuple(sorted({x["item_id"] for x in r["leaks"]}))) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert (50, (7,)) in one or (50, (7, 10)) in one
    assert all(not leaks for d, leaks in one if d != 50)
    monkeypatch.setattr(decontamination, "PASS_BYTES", 50)
    many = {(r["doc_id"], tuple(sorted({x["item_id"] for x in r["leaks"]}))) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert many == one
    assert decontamination.find_leaks(docs, benchmark.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontamination.find_leaks(docs.limit(0), benchmark).count() == 0


def test_license_findings_take_linear_time():
    one = b"licensed under the apache license version 2 0 and the mit license "
    took = []
    for n in (500, 4000):
        norm = b" " + one * n
        began = time.perf_counter()
        base, kept = license_scan.detect(norm)
        took.append(time.perf_counter() - began)
        assert len(kept) == 2 * n and len(base) == n
    assert took[1] < 30 * took[0]


def test_containment_matches_brute_force():
    r = random.Random(11)
    for _ in range(200):
        spans = [(a, a + r.randint(1, 12)) for a in (r.randrange(30) for _ in range(25))]
        own, plain = license_scan._Intervals([a for a, _ in spans]), []
        for a, b in spans:
            covered = any(x <= a and b <= y for x, y in plain)
            assert own.covers(a, b) == covered
            if not covered:
                own.add(a, b)
                plain.append((a, b))
