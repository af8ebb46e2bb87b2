"""Toxicity by a classifier chain of linear models.

The categories stand in a fixed order. The model of each category is a logistic regression over word
features and over the probabilities of all categories before it. In training, those probabilities come
out of fold: each row's from models that did not see it; in scoring, from the final models in turn.

Features are binary: a word is there, it is there again, the same for the beginnings of words (5, 6 and
7 bytes, so that inflected forms count together), and coarse shares of capitals and signs. They are kept
by full 64-bit hash, so no other word of the corpus can pass for one that was learned.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textkit import Words, mix, slices, utf8

#: Labelled keys that the models are fitted on at most, half of them toxic; chosen by hash of the key, weighted back.
SAMPLE_ROWS = 8192
#: Features that one model keeps at most, those that tell most about its category.
FEATURES = 4096
#: Tasks for what the sampled rows give, which is bounded however large the tables are.
TASKS = 16
#: Features of rows that a task holds before it passes their counts on.
HELD = 500_000
#: Bytes of texts that are lower-cased, hashed and sorted at a time, one document at least.
PIECE_BYTES = 1 << 18
FOLDS = 4
ROUNDS = 150
RIDGE = 0.3
PREFIXES = (5, 6, 7)
#: Probability of "toxic" from which a document is rejected; costs no precision on held-out labels.
THRESHOLD = 0.4
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-!?"]] = True


def feature_batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, feature hashes, document of each) for slices of a string column; repeats are still there.

    Nothing is made of more than one slice, so what is held beside the column does not grow with it.
    """
    raw_offsets, raw = utf8(column)
    for a, b in slices(raw_offsets, PIECE_BYTES):
        words = Words(*utf8(pc.utf8_lower(column.slice(a, b - a).cast(pa.large_string()))), LETTERS)
        doc = np.repeat(np.arange(b - a), np.diff(words.first))
        kinds = [words.hashes(), *(mix(words.hashes(p) + np.uint64(p)) for p in PREFIXES)]
        feats, docs = [*kinds], [doc] * len(kinds)
        for number, flags in enumerate((_SIGNS, _UPPER)):
            sums = np.concatenate(([0], np.cumsum(flags[raw[raw_offsets[a] : raw_offsets[b]]])))
            at = raw_offsets[a : b + 1] - raw_offsets[a]
            share = np.diff(sums[at]) / np.maximum(1, np.diff(at))
            bin_ = np.minimum(9, (share * 20).astype(np.int64)).astype(np.uint64)
            feats.append(mix(bin_ + np.uint64(1000 * (number + 1))))
            docs.append(np.arange(b - a))
        yield a, b, np.concatenate(feats), np.concatenate(docs)


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _levels(feats: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, document), each feature once more under another hash where it is repeated."""
    order = np.lexsort((feats, doc))
    feats, doc = feats[order], doc[order]
    new = np.ones(len(feats), bool)
    new[1:] = (feats[1:] != feats[:-1]) | (doc[1:] != doc[:-1])
    second = np.zeros(len(feats), bool)
    second[1:] = new[:-1] & ~new[1:]
    return np.concatenate([feats[new], mix(feats[second] + np.uint64(1))]), np.concatenate([doc[new], doc[second]])


class Linear:
    """A logistic regression over some features and some earlier probabilities."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.features, self.weights, self.earlier, self.bias = features, weights, earlier, bias

    def probability(self, column: np.ndarray, doc: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """For documents with features ``column`` (places in ``features``) at ``doc``."""
        z = self.bias + earlier @ self.earlier + np.bincount(doc, weights=self.weights[column], minlength=len(earlier))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(feature: np.ndarray, doc: np.ndarray, distinct: np.ndarray, earlier: np.ndarray, target: np.ndarray, weight: np.ndarray, most: int = FEATURES) -> Linear:
    """A ridge logistic regression on the rows of positive weight, by accelerated gradient descent."""
    used = weight > 0
    total = weight.sum()
    rate = float((weight * target).sum() / total) if total else 0.0
    if rate in (0.0, 1.0):
        return Linear(distinct[:0], np.zeros(0), np.zeros(earlier.shape[1]), 12.0 if rate else -12.0)
    rows = used[doc]
    f, d = feature[rows], doc[rows]
    there = np.bincount(f, weights=weight[d], minlength=len(distinct))
    positive = np.bincount(f, weights=(weight * target)[d], minlength=len(distinct))
    told = (positive - there * rate) ** 2 / (there + 1)
    told[np.bincount(f, minlength=len(distinct)) < 3] = 0
    picked = np.sort(np.argsort(-told, kind="stable")[:most])
    picked = picked[told[picked] > 0]
    place = np.full(len(distinct), -1)
    place[picked] = np.arange(len(picked))
    inside = place[f] >= 0
    f, d = place[f[inside]], d[inside].astype(np.intp)
    n, m = len(target), len(picked)
    w, e, bias = np.zeros(m), np.zeros(earlier.shape[1]), np.log(rate / (1 - rate))
    share = weight / total
    norm = np.bincount(d, minlength=n) + 1 + (earlier**2).sum(axis=1)
    step = 1 / (0.25 * np.average(norm, weights=share) * 4 + RIDGE / total)
    last = (w, e, bias)
    for t in range(1, ROUNDS + 1):
        ahead = [x + (t - 1) / (t + 2) * (x - y) for x, y in zip((w, e, bias), last, strict=True)]
        z = ahead[2] + earlier @ ahead[1] + np.bincount(d, weights=ahead[0][f], minlength=n)
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * share
        last = (w, e, bias)
        w = ahead[0] - step * (np.bincount(f, weights=off[d], minlength=m) + RIDGE / total * ahead[0])
        e = ahead[1] - step * (earlier.T @ off + RIDGE / total * ahead[1])
        bias = ahead[2] - step * off.sum()
    return Linear(distinct[picked], w, e, float(bias))


def fit_chain(feature: np.ndarray, doc: np.ndarray, distinct: np.ndarray, targets: np.ndarray, weight: np.ndarray, fold: np.ndarray, most: int = FEATURES) -> list[Linear]:
    """One final model for each category; every later one has seen out-of-fold probabilities of the earlier ones."""
    n, chain = len(weight), []
    outside = np.zeros((n, 0))
    for k in range(targets.shape[1]):
        chain.append(fit_linear(feature, doc, distinct, outside, targets[:, k], weight, most))
        if k + 1 == targets.shape[1]:
            break
        p = np.zeros(n)
        for j in range(FOLDS):
            part = fit_linear(feature, doc, distinct, outside, targets[:, k], np.where(fold == j, 0.0, weight), most)
            place = np.searchsorted(part.features, distinct)
            place = np.where((place < len(part.features)) & (part.features[np.minimum(place, max(0, len(part.features) - 1))] == distinct) if len(part.features) else False, place, -1)
            held = place[feature] >= 0
            mine = part.probability(place[feature[held]], doc[held], outside)
            p[fold == j] = mine[fold == j]
        outside = np.column_stack([outside, p])
    return chain


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = FEATURES) -> list[Linear]:
    """The chain, from rows of ``labels`` (key, quality, toxic) that have a text in ``docs``.

    Fitted on at most ``SAMPLE_ROWS`` labelled keys, those of the smallest hashes, toxic and other ones apart.
    Several labels of a key count as their largest toxicity and smallest quality, null labels not at all; of
    several texts of a key the smallest one counts. Features are counted by fold and class in Spark; the one
    task that fits gets, for each row, the numbers of those features alone that some model of the chain
    keeps, at most ``most`` a model. Without a labelled text every category has a model that says no.
    The driver gets those features and the models.
    """
    known = labels.where("quality is not null and toxic is not null").groupBy(F.col(f"`{key}`").alias("key")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = known.where("key is not null").select("key", F.expr("toxic > 0").alias("toxic"), F.expr("quality <= 0").alias("low"))
    half, hashed = SAMPLE_ROWS // 2, (F.xxhash64("key"), "key")
    chosen = known.where("toxic").orderBy(*hashed).limit(half).unionByName(known.where("not toxic").orderBy(*hashed).limit(half))
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.groupBy("key", "toxic", "low").agg(F.min("text").alias("text"))
    fold = F.pmod(F.crc32(F.col("key").cast("string")), F.lit(FOLDS)).cast("int")
    sample = written(rows.select("text", (fold * 4 + F.col("low").cast("int") * 2 + F.col("toxic").cast("int")).alias("slot")).repartition(TASKS), "labelled")
    whole = dict(known.groupBy(F.col("toxic").cast("int").alias("t")).count().collect())
    had = dict(sample.groupBy("slot").count().collect())
    if not had:
        return fit_chain(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(CATEGORIES))), np.zeros(0), np.zeros(0))
    weights = np.array([max(1.0, whole.get(s % 2, 0) / half) for s in range(4 * FOLDS)])
    size = np.array([had.get(s, 0) for s in range(4 * FOLDS)], float)
    per_slot = [F.sum(F.when(F.col("slot") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(len(size))]
    counts = sample.mapInArrow(_counted, "feature long, slot int, n int").groupBy("feature").agg(*per_slot)
    counts = counts.where(sum((F.col(f"n{s}") for s in range(len(size))), F.lit(0)) >= 3)
    best = counts.coalesce(TASKS).mapInArrow(_telling(size, weights, most), "model int, told double, feature long")
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("told"), F.col("feature") < 0, "feature"))
    kept = best.withColumn("rank", rank).where(F.col("rank") <= most).select("feature").distinct().toArrow()["feature"].to_numpy()
    distinct = np.sort(kept.view(np.uint64))
    found = sample.mapInArrow(_placed(distinct), "places binary, slot int").repartition(1)
    fitted = found.mapInArrow(_fitted(distinct, weights, most), "model binary").collect()
    return pickle.loads(fitted[0][0])


def _target(slot: np.ndarray) -> np.ndarray:
    """What the rows of a slot say on each category."""
    toxic, low = slot % 2 > 0, slot // 2 % 2 > 0
    return np.column_stack([low, toxic, toxic & low]).astype(float).reshape(-1, len(CATEGORIES))


def _counted(batches):
    """(feature, slot, rows that have it) of batches (text, slot)."""
    held, size = [], 0

    def out():
        feats, slot = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((slot, feats))
        feats, slot = feats[order], slot[order]
        first = np.flatnonzero(np.concatenate(([True], (feats[1:] != feats[:-1]) | (slot[1:] != slot[:-1]))))
        n = np.diff(np.append(first, len(feats))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(feats[first].view(np.int64)), pa.array(slot[first]), pa.array(n)], names=["feature", "slot", "n"])

    for batch in batches:
        slots = batch.column(1).to_numpy()
        for a, _, feats, doc in feature_batches(batch.column(0)):
            feats, doc = _levels(feats, doc)
            held.append((feats, slots[a + doc]))
            size += len(feats)
            if size > HELD:
                yield out()
                held, size = [], 0
    if size:
        yield out()


def _telling(size: np.ndarray, weights: np.ndarray, most: int):
    """Of batches (feature, rows by slot) those features that tell most, for each category and each left-out fold or none."""
    slot = np.arange(len(size))
    target = _target(slot)
    models = [(k, np.where(slot // 4 == j, 0.0, weights)) for k in range(len(CATEGORIES)) for j in range(-1, FOLDS)]

    def run(batches):
        tops = [(np.zeros(0), np.zeros(0, np.int64)) for _ in models]
        for batch in batches:
            feature = batch.column(0).to_numpy()
            n = np.column_stack([batch.column(1 + s).to_numpy() for s in range(len(size))]).astype(float)
            for m, (k, weight) in enumerate(models):
                rate = (size * weight * target[:, k]).sum() / max(1e-300, (size * weight).sum())
                there, positive = n @ weight, n @ (weight * target[:, k])
                told = (positive - there * rate) ** 2 / (there + 1)
                good = np.flatnonzero((n @ (weight > 0) >= 3) & (told > 0))
                told, own = np.concatenate([tops[m][0], told[good]]), np.concatenate([tops[m][1], feature[good]])
                order = np.lexsort((own.view(np.uint64), -told))[:most]
                tops[m] = told[order], own[order]
        for m, (told, own) in enumerate(tops):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m, np.int32)), pa.array(told), pa.array(own)], names=["model", "told", "feature"])

    return run


def _placed(distinct: np.ndarray):
    """Batches (text, slot) as (places in ``distinct`` of the row's features, slot)."""

    def run(batches):
        for batch in batches:
            made = []
            for a, b, feats, doc in feature_batches(batch.column(0)):
                feats, doc = _levels(feats, doc)
                place = np.minimum(np.searchsorted(distinct, feats), max(0, len(distinct) - 1))
                same = distinct[place] == feats if len(distinct) else np.zeros(len(feats), bool)
                place, doc = place[same].astype(np.int32), doc[same]
                order = np.argsort(doc, kind="stable")
                made += [x.tobytes() for x in np.split(place[order], np.searchsorted(doc[order], np.arange(1, b - a)))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["places", "slot"])

    return run


def _fitted(distinct: np.ndarray, weights: np.ndarray, most: int):
    """The pickled chain of all rows (places, slot)."""

    def run(batches):
        places, slots = [], []
        for batch in batches:
            places.append((np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0)]), pc.binary_length(batch.column(0)).to_numpy() // 4))
            slots.append(batch.column(1).to_numpy())
        if places:
            feature, length, slot = np.concatenate([p for p, _ in places]), np.concatenate([n for _, n in places]), np.concatenate(slots)
            doc = np.repeat(np.arange(len(slot), dtype=np.int32), length)
            chain = fit_chain(feature, doc, distinct, _target(slot), weights[slot], slot // 4, most)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["model"])

    return run


def score(docs: DataFrame, chain: Broadcast, text: str = "text", threshold: float = THRESHOLD, texts: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``p_<category>`` for each category and ``rejected`` (p_toxic at or over the threshold).

    Without ``texts`` the text column is left out, and texts do not travel back from the Python workers.

    A null or empty text has no words and is never rejected. Rows are judged one by one, so repeated
    rows, ties, null keys and empty tables need no care; columns with one of the new names are replaced.
    """
    new = [*(f"p_{c}" for c in CATEGORIES), "rejected"]
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    back = [i for i in range(len(kept)) if texts or i != at]

    def run(batches):
        models = chain.value
        all_features = np.unique(np.concatenate([np.zeros(0, np.uint64), *(m.features for m in models)]))
        places = [np.searchsorted(m.features, all_features) for m in models]
        places = [np.where(np.isin(all_features, m.features), p, -1) for m, p in zip(models, places, strict=True)]
        known = np.zeros(1 << 20, bool)  # lets most features pass by without a search
        for f in all_features:
            known[int(f) & 0xFFFFF] = True
        for batch in batches:
            for a, b, feats, doc in feature_batches(batch.column(at)):
                p = np.zeros((b - a, len(models)))
                worded = np.bincount(doc, minlength=b - a) > 2
                again = mix(feats + np.uint64(1))
                near = known[(feats & np.uint64(0xFFFFF)).astype(np.int64)] | known[(again & np.uint64(0xFFFFF)).astype(np.int64)]
                f, d = _levels(feats[near], doc[near])
                spot = np.minimum(np.searchsorted(all_features, f), max(0, len(all_features) - 1))
                same = all_features[spot] == f if len(all_features) else np.zeros(len(f), bool)
                spot, d = spot[same], d[same]
                for k, (m, place) in enumerate(zip(models, places, strict=True)):
                    held = place[spot] >= 0
                    p[:, k] = m.probability(place[spot[held]], d[held], p[:, :k])
                p[~worded] = 0.0
                fresh = [pa.array(p[:, k]) for k in range(len(models))] + [pa.array(p[:, CATEGORIES.index("toxic")] >= threshold)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in back] + fresh, names=[kept[i] for i in back] + new)

    schema = "".join(f"`{kept[i]}` {source.schema[kept[i]].dataType.simpleString()}, " for i in back) + "".join(f"{c} double, " for c in new[:-1]) + "rejected boolean"
    return source.mapInArrow(run, schema)
