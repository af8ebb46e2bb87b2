"""Importance resampling of documents towards a target by hashed n-gram features, with an exact distributed draw.

Features of a text are its runs of one to three words; each falls into a bucket by CRC-32. Bucket counts of the
documents and of the target give an array with each bucket's gain, and a document's weight is the sum of the
gains of its features. The array has ``BUCKETS`` figures whatever the corpus, so it is all that is broadcast.

The draw takes the largest scores, the smaller keys among equal ones. Score and key make one composite number
of eight 16-bit digits; each pass counts the next digit of the rows that agree with the digits found so
far, at most 65,536 counts, until the last row to draw is known. Nothing is sorted but the drawn rows, by
ranges, and a rank is a row's place in its range behind the sizes of the ranges before it.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textkit import Words, word_batches

BUCKETS, LONGEST_RUN, SEED, LEAST_WORDS = 10_000, 3, 42, 20
DIGIT, DIGITS = 16, 4
#: Words of more bytes go through zlib one by one.
LONG_WORD = 64

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def _shifts(most: int) -> np.ndarray:
    """``[n, i, b]``: what byte i of a CRC register with value b becomes after n zero bytes; a register is their XOR."""
    now = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [now]
    for _ in range(most):
        now = _step(now, np.uint32(0))
        out.append(now)
    return np.stack(out).astype(np.uint32)


_SHIFT = _shifts(LONG_WORD + 1)


def _shifted(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(state), np.uint32)
    for i in range(4):
        out ^= _SHIFT[n, i, (state >> np.uint32(8 * i)) & np.uint32(0xFF)]
    return out


def feature_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each run of one, two and three words, as rows by its first word, -1 where a document ends before.

    The register of a CRC is linear in what it has read: that of "a b" is that of "a", shifted by the bytes of
    " b", XOR that of " b" by itself. So each word's bytes are read once, all words side by side.
    """
    n = len(words)
    out = np.full((LONGEST_RUN, n), -1, np.int64)
    doc_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if not n:
        return out, doc_of
    data, size = _LOWER[words.data], words.end - words.start
    long = np.flatnonzero(size > LONG_WORD)
    short = np.where(size > LONG_WORD, 0, size)
    order = np.argsort(-short, kind="stable")
    own = np.zeros(n, np.uint32)  # each word's register, begun at zero
    many = np.searchsorted(-short[order], -np.arange(int(short.max()) + 1), "left")
    for j in range(int(short.max())):
        rows = order[: many[j]]
        own[rows] = _step(own[rows], data[words.start[rows] + j])
    blank = _step(np.zeros(1, np.uint32), np.uint32(0x20))
    spaced = _shifted(np.repeat(blank, n), short) ^ own
    state = _shifted(np.full(n, 0xFFFFFFFF, np.uint32), short) ^ own
    for k in range(LONGEST_RUN):
        if k:
            state = _shifted(state[:-1], short[k:] + 1) ^ spaced[k:]
        rows = np.flatnonzero(doc_of[k:] == doc_of[: n - k])
        out[k, rows] = (state[rows] ^ np.uint32(0xFFFFFFFF)) % BUCKETS
    for w in long:
        for k in range(LONGEST_RUN):
            for first in range(max(0, w - k), min(w, n - 1 - k) + 1):
                if doc_of[first] == doc_of[first + k]:
                    text = b" ".join(data[words.start[i] : words.end[i]].tobytes() for i in range(first, first + k + 1))
                    out[k, first] = zlib.crc32(text) % BUCKETS
    return out, doc_of


def bucket_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, words in word_batches(batch.column(0), WORD_BYTES):
                found, _ = feature_buckets(words)
                total += np.bincount(found[found >= 0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths of a natural logarithm, rounded down, with one added to every count."""
    s, t = source.tolist(), target.tolist()
    all_s, all_t = sum(s) + BUCKETS, sum(t) + BUCKETS
    return np.array([math.floor(1000 * math.log(float((b + 1) * all_s) / float((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, n_words, n_features, weight) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for a, b, words in word_batches(batch.column(1), WORD_BYTES):
                found, doc_of = feature_buckets(words)
                n_words[a:b] = np.diff(words.first)
                each = np.where(found >= 0, held.value[np.maximum(found, 0)], 0).sum(0)
                sums = np.concatenate(([0], each.cumsum()))
                many = np.concatenate(([0], (found >= 0).sum(0).cumsum()))
                weight[a:b], n_features[a:b] = np.diff(sums[words.first]), np.diff(many[words.first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a key in thousandths, rounded down: the same for the same key and seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _digit(value: Column, place: int) -> Column:
    """16 bits of a signed long, such that larger values have larger digits."""
    biased = value.bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(biased, DIGIT * (DIGITS - 1 - place)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def kth_key(rows: DataFrame, best: Column, then: Column, most) -> tuple[int, list[tuple[Column, int]]]:
    """How many rows to draw, and the leading digits of the last of them, larger ``best`` and smaller ``then`` first.

    ``most`` is the number to draw as a function of the number of rows. Each digit is (column, value), larger
    ones first; the digits end where all rows that agree with them are drawn.
    """
    keys = [_digit(best, i) for i in range(DIGITS)] + [((1 << DIGIT) - 1) - _digit(then, i) for i in range(DIGITS)]
    found: list[tuple[Column, int]] = []
    draw = need = None
    for digit in keys:
        held = rows
        for column, value in found:
            held = held.where(column == F.lit(value))
        counts = sorted(((d, n) for d, n in held.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        if need is None:
            draw = need = most(sum(n for _, n in counts))
            if not need:
                return 0, []
        for value, n in counts:
            if need <= n:
                break
            need -= n
        found.append((digit, value))
        if need == n:
            break
    return draw, found


def drawn(scored: DataFrame, most, where: str) -> DataFrame:
    """``scored`` (key, score, …) with ``rank``: 1, 2, … for the rows drawn of those that ``where`` holds for, else null.

    Rows with a null key come behind all others of their score. Of rows with the same score and key as the last
    one drawn, any may be it.
    """
    place = F.coalesce(F.col("key").cast("long"), F.lit((1 << 63) - 1))
    draw, digits = kth_key(scored.where(where), F.col("score"), place, most)
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    # A row comes first if at the first digit where it differs from the last drawn row its own is larger.
    ahead, same = F.lit(False), F.lit(True)
    for column, value in digits:
        ahead, same = ahead | (same & (column > F.lit(value))), same & (column == F.lit(value))
    chosen = F.expr(f"coalesce({where}, false)") & (ahead | same)
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), place.asc(), F.col("key").asc_nulls_last()]
    ranged = scored.where(chosen).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    ranged = written(ranged.withColumn("__part", F.shiftright(number, 33).cast("int")).withColumn("__place", number.bitwiseAND(F.lit((1 << 33) - 1)) + 1), "drawn")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__place")
    # One row for each range: a table of at most ``parts`` rows.
    ranked = ranged.join(F.broadcast(before), "__part").withColumn("rank", F.when(rank <= draw, rank))
    return scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for those not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn, rounded down. Keys are
    integers. A null or empty text has no words and weight 0; a null key is drawn like any other, by the noise
    of an empty key. Rows that agree in key are rows of their own with ranks of their own. Texts are read
    whole in two passes and not shuffled, very long ones included. Empty tables give no rows, an empty target
    equal counts; other columns are not read.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = weighed(docs, gain, key, text).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    out = drawn(written(scored, "scored"), lambda n: percent * n // 100, f"n_words >= {int(least_words)}")
    return out.withColumnRenamed("key", key)
