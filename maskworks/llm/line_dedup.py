"""Line deduplication by content-defined chunks of lines, in DataFrame functions alone.

Lines get a hash; a rolling hash over ``WINDOW`` consecutive line hashes ends a chunk where it is
divisible by ``DIVISOR``. Boundaries so depend on nearby lines only, and a passage pasted at another
place falls into the same chunks again. A line of more than ``PASSAGE_WORDS`` words is a passage by
itself and always its own chunk. Of the chunks of two lines or more, and of those passage lines, that
occur more than once anywhere, the first occurrence stays and the others go.

Chunks at the ends of a passage may be shared with its surroundings. So each pair of neighbouring lines is
told as well, with the first place that it has anywhere. Where the first places of consecutive pairs are
consecutive lines of one document, the lines repeat that place as a whole: such a run goes too if it has
more than ``PASSAGE_WORDS`` words. Pairs whose first places are in different documents never make a run.

Narrow rows (digest, place) find the repeats; then each document's list of repeats meets its text in
one join, and the texts of all occurrences of a digest are compared byte by byte before anything is
removed. A digest whose occurrences differ removes nothing. A run is as its first place, byte by byte, as
each of its pairs is.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

WINDOW = 2
DIVISOR = 3
PASSAGE_WORDS = 50
FACTOR = 31
WORD = r"[^ \t\x0B\f\r]+"


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _is_passage(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) >= PASSAGE_WORDS


def chunked(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` plus ``__lines`` and ``__chunks``: array of (start, stop) line ranges, start from 0."""
    d = docs.withColumn("__lines", F.split(F.col(f"`{text}`"), "\n", -1))
    d = d.withColumn("__hash", F.transform("__lines", _line_hash)).withColumn("__long", F.transform("__lines", _is_passage))
    # The list that is walked holds each line's rolling hash and whether it or the next line stands alone.
    rolled = F.col("__hash")
    for back in range(1, WINDOW):
        before = F.concat(F.array_repeat(F.lit(0).cast("long"), back), F.slice("__hash", 1, F.greatest(F.size("__hash") - back, F.lit(0))))
        rolled = F.zip_with(rolled, before, lambda a, b: a + b * FACTOR)
    alone_next = F.concat(F.slice("__long", 2, F.size("__long")), F.array(F.lit(True)))
    d = d.withColumn("__cut", F.zip_with(F.zip_with(rolled, F.col("__long"), lambda h, p: (h % DIVISOR == 0) | p), alone_next, lambda a, b: a | b))
    stops = F.filter(F.transform("__cut", lambda c, i: F.when(c, i + 1)), lambda x: x.isNotNull())
    d = d.withColumn("__stops", stops)
    starts = F.concat(F.array(F.lit(0)), F.slice("__stops", 1, F.greatest(F.size("__stops") - 1, F.lit(0))))
    d = d.withColumn("__chunks", F.zip_with(starts, F.col("__stops"), lambda a, b: F.struct(a.alias("start"), b.alias("stop"))))
    return d.drop("__hash", "__cut", "__stops")


def _chunk_text(lines: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, stop - start), "\n")


#: Stands for the end of a pair, which is always two lines on.
_PAIR = 0


def _pairs(lines: Column) -> Column:
    """Every two neighbouring lines as (start, stop, digest)."""
    texts = F.zip_with(F.slice(lines, 1, F.size(lines) - 1), F.slice(lines, 2, F.size(lines)), lambda a, b: F.concat(a, F.lit("\n"), b))
    return F.transform(texts, lambda t, i: F.struct(i.alias("start"), F.lit(_PAIR).alias("stop"), F.xxhash64(t, F.lit("pair")).alias("digest")))


def _text_key(text: Column) -> Column:
    """60 bits of a text's digest, which tell apart texts of equal keys."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without its repeated chunks and runs, plus ``lines_before`` and ``lines_removed``.

    The first occurrence is the one with the smallest (key, text digest, line); a null key comes last.
    Rows that agree in key and text count as one document and get the same result. A null text stays
    null with 0 lines; an empty text has one empty line. Line ends are ``\\n``; others belong to the line.
    Very long texts are rows like any other: their lines are arrays of one row. No rows give no rows. A
    column that has one of the new names is replaced.
    """
    docs = docs.drop("lines_before", "lines_removed")
    source = docs.withColumn("__text_key", _text_key(F.col(f"`{text}`")))
    parts = chunked(source.select(F.col(f"`{key}`").alias("__key"), "__text_key", F.col(f"`{text}`").alias("__text")), "__text")
    chunks = F.transform(
        F.filter("__chunks", lambda c: (c["stop"] - c["start"] > 1) | F.get(F.col("__long"), c["start"])),
        lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.xxhash64(_chunk_text(F.col("__lines"), c["start"], c["stop"]), F.lit("chunk")).alias("digest")),
    )
    told = parts.select("__key", "__text_key", F.explode_outer(F.concat(chunks, _pairs(F.col("__lines")))).alias("c")).where("c is not null")
    told = written(told.select("__key", "__text_key", "c.start", "c.stop", "c.digest").distinct(), "chunks")
    place = F.struct(F.col("__key").isNull().alias("last"), F.col("__key").alias("key"), F.col("__text_key").alias("text_key"), F.col("start").alias("start"))
    first = told.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeats = told.join(first, "digest").select("__key", "__text_key", F.struct("start", "stop", "digest", (place == F.col("first")).alias("stays"), "first").alias("r"))
    by_doc = repeats.groupBy("__key", "__text_key").agg(F.collect_list("r").alias("__repeats"))
    met = source.alias("d").join(
        by_doc.alias("r"),
        F.col(f"d.`{key}`").eqNullSafe(F.col("r.__key")) & (F.col("d.__text_key") == F.col("r.__text_key")),
        "left",
    )
    met = written(met.select("d.*", "r.__repeats").drop("__text_key"), "repeats")
    return _removed(met, text, _differing(met, text))


def _differing(met: DataFrame, text: str) -> DataFrame | None:
    """Digests whose occurrences are not the same bytes, or None when there are none, as always so far."""
    lines = met.where("__repeats is not null").select("__repeats", F.split(F.col(f"`{text}`"), "\n", -1).alias("__lines"))
    stop = lambda r: F.when(r["stop"] == _PAIR, r["start"] + 2).otherwise(r["stop"])
    texts = lines.select(F.explode_outer(F.transform("__repeats", lambda r: F.struct(r["digest"].alias("digest"), _chunk_text(F.col("__lines"), r["start"], stop(r)).alias("text")))).alias("o"))
    odd = written(texts.groupBy("o.digest").agg(F.min("o.text").alias("a"), F.max("o.text").alias("b")).where("a <> b").select("digest"), "differing")
    return None if odd.isEmpty() else odd


def _runs(pairs: Column) -> Column:
    """Line ranges (start, stop) of the runs among pairs (start, first), sorted: the next pair at the next line, here and there."""
    none = F.array(F.lit(None))
    follows = lambda p, x: F.coalesce(
        (p["start"] + 1 == x["start"]) & p["first"]["key"].eqNullSafe(x["first"]["key"]) & (p["first"]["text_key"] == x["first"]["text_key"]) & (p["first"]["start"] + 1 == x["first"]["start"]), F.lit(False)
    )
    before = F.concat(none, F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))))
    after = F.concat(F.slice(pairs, 2, F.size(pairs)), none)
    begins = F.zip_with(before, pairs, lambda p, x: F.when(~follows(p, x), x["start"]))
    ends = F.zip_with(pairs, after, lambda x, n: F.when(~follows(x, n), x["start"] + 2))
    there = lambda x: F.filter(x, lambda y: y.isNotNull())
    return F.zip_with(there(begins), there(ends), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def _words(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, line: n + F.regexp_count(line, F.lit(WORD)))


def _removed(met: DataFrame, text: str, differing: DataFrame | None) -> DataFrame:
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    if differing is not None:
        met = met.withColumn("__row", F.monotonically_increasing_id())
        met = written(met, "repeats")
        held = met.select("__row", F.explode("__repeats").alias("r")).join(differing, F.col("r.digest") == F.col("digest"), "left_anti")
        held = held.groupBy("__row").agg(F.collect_list("r").alias("__repeats"))
        met = met.drop("__repeats").join(held, "__row", "left").drop("__row")
    met, gone = met.withColumn("__lines", lines), F.filter("__repeats", lambda r: ~r["stays"])
    pairs = F.transform(F.filter(gone, lambda r: r["stop"] == _PAIR), lambda r: F.struct(r["start"].alias("start"), r["first"].alias("first")))
    chunks = F.transform(F.filter(gone, lambda r: r["stop"] != _PAIR), lambda r: F.struct(r["start"], r["stop"]))
    met = met.withColumn("__pairs", F.array_sort(pairs))
    met = met.withColumn("__runs", F.filter(_runs(F.col("__pairs")), lambda r: _words(F.slice("__lines", r["start"] + 1, r["stop"] - r["start"])) > PASSAGE_WORDS))
    gone = F.concat(chunks, "__runs")
    gone = F.flatten(F.transform(gone, lambda r: F.sequence(r["start"], r["stop"] - 1)))
    out = met.withColumn("__gone", F.coalesce(F.array_distinct(gone), F.array().cast("array<int>")))
    size = F.coalesce(F.size("__lines"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), size - 1), F.col("__gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    changed = F.when(F.size("__gone") > 0, kept).otherwise(F.col(f"`{text}`"))
    return (
        out.withColumn("lines_before", F.when(F.col(f"`{text}`").isNull(), 0).otherwise(size).cast("long"))
        .withColumn("lines_removed", F.size("__gone").cast("long"))
        .withColumn(text, changed)
        .drop("__lines", "__pairs", "__runs", "__gone", "__repeats")
    )
