"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts n-grams per language over all training texts. An n-gram belongs to a language when its
rate there is at least ``share`` of the sum of its rates over all languages; the belonging n-grams of all
languages fill one Bloom filter whose cells hold a bit for each language, so that one lookup returns
all languages containing an n-gram. For a text, the per-language counts of hits are corrected for the
expected false positives of that language's slice, and the largest corrected count decides.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .textkit import mix, slices, utf8

NGRAM = 3
CELLS_LOG2 = 20
PROBES = 3
SHARE = 0.4
MAX_LANGUAGES = 1024
#: Distinct n-grams a task holds before it passes their counts on.
HELD = 200_000

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point its lower-case form if it is a letter of one code point, else 0x20."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 0x20, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters = table
    return _letters


def gram_batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, n-gram hashes, document of each) for slices of a string column.

    N-grams run over lower-case letters; every run of other characters is one space, and each text
    begins and ends with a space. Only n-grams with a letter count; a text without a letter has none.
    """
    offsets, data = utf8(column)
    table = letter_table()
    for a, b in slices(offsets, 1 << 19):
        pieces = data[offsets[a] : offsets[b]].tobytes()
        begins = offsets[a : b + 1] - offsets[a]
        text = pieces.decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) == len(pieces):
            starts = begins
        else:  # from places in bytes to places in characters
            first = (np.frombuffer(pieces, np.uint8) & 0xC0) != 0x80
            starts = np.concatenate(([0], np.cumsum(first)))[begins]
        low = np.full(len(codes) + b - a + 1, 0x20, np.uint32)
        # One space before each text and one at the very end; texts stay apart.
        at = np.arange(len(codes)) + np.repeat(np.arange(1, b - a + 1), np.diff(starts))
        low[at] = table[codes]
        doc = np.full(len(low), b - a - 1, np.int64)
        heads = starts[:-1] + np.arange(b - a)
        marks = np.zeros(len(low), np.int64)
        np.add.at(marks, heads, 1)
        doc = np.minimum(np.cumsum(marks) - 1, b - a - 1)
        space = low == 0x20
        keep = np.ones(len(low), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        head = np.zeros(len(low), bool)
        head[heads] = True
        head[-1] = True
        keep |= head
        keep[:-1] &= head[:-1] | ~space[:-1] | ~head[1:]  # of a text's last spaces the one that opens the next text stays
        low, doc = low[keep], doc[keep]
        if len(low) < NGRAM:
            yield a, b, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        h = np.zeros(len(low) - NGRAM + 1, np.uint64)
        lettered = np.zeros(len(h), bool)
        for j in range(NGRAM):
            part = low[j : len(h) + j].astype(np.uint64)
            h = h * np.uint64(0x110000) + part
            lettered |= part != 0x20
        # The space that opens the next text also closes the one before it.
        own = doc[: len(h)]
        last = doc[NGRAM - 1 :]
        inside = (own == last) | ((last == own + 1) & (np.concatenate((doc[NGRAM - 2 :][: len(h)],)) == own))
        good = lettered & inside
        yield a, b, mix(h[good] + np.uint64(NGRAM)), own[good]


@dataclass
class BloomModel:
    """Languages, cells x bytes of language bits, and each language's false-positive rate."""

    languages: list[str]
    cells: np.ndarray
    false_positives: np.ndarray

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the language bytes that all its cells share."""
        found = None
        for at in probes(grams):
            found = self.cells[at] if found is None else found & self.cells[at]
        return found

    def scores(self, grams: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(corrected counts docs x languages, n-grams of each text)."""
        total = np.bincount(doc, minlength=docs).astype(float)
        found = self.hits(grams) if len(grams) else np.zeros((0, self.cells.shape[1]), np.uint8)
        counts = np.empty((docs, len(self.languages)))
        for j in range(len(self.languages)):
            counts[:, j] = np.bincount(doc, weights=(found[:, j >> 3] >> (j & 7)) & 1, minlength=docs)
        fp = self.false_positives
        return np.maximum(0.0, (counts - total[:, None] * fp) / (1 - fp)), total


def probes(grams: np.ndarray) -> list[np.ndarray]:
    """The cells of each n-gram."""
    step = (grams >> np.uint64(CELLS_LOG2)) | np.uint64(1)
    return [((grams + step * np.uint64(i)) & np.uint64((1 << CELLS_LOG2) - 1)).astype(np.int64) for i in range(PROBES)]


def _counted(batches, names: list[str]):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        distinct, inverse = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(inverse, weights=counts).astype(np.int64)

    def out():
        keys, counts = merged()
        return pa.RecordBatch.from_arrays([pa.array(keys["g"].view(np.int64)), pa.array(keys["l"].astype(np.int32)), pa.array(counts)], names=["gram", "lang_at", "n"])

    kind = np.dtype([("g", np.uint64), ("l", np.uint16)])
    for batch in batches:
        langs = batch.column(1).to_numpy(zero_copy_only=False)
        for a, _, grams, doc in gram_batches(batch.column(0)):
            for lang in np.unique(langs[a:][: doc.max() + 1]) if len(doc) else ():
                g, n = np.unique(grams[langs[a + doc] == lang], return_counts=True)
                keys = np.empty(len(g), kind)
                keys["g"], keys["l"] = g, lang
                held.append((keys, n))
                size += len(g)
            if size > 4 * HELD:
                keys, counts = merged()
                held, size = [(keys, counts)], len(keys)
                if size > HELD:
                    yield out()
                    held, size = [], 0
    if held:
        yield out()


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> BloomModel:
    """The filter of all rows of ``docs`` whose language is not null.

    The driver gets the language names (an error beyond ``MAX_LANGUAGES``), one total per language
    and at most 2^``CELLS_LOG2`` filled cells, never n-grams or texts.
    """
    known = docs.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    languages = sorted(r[0] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    width = max(1, (len(languages) + 7) // 8)
    cells = np.zeros((1 << CELLS_LOG2, width), np.uint8)
    if languages:
        number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
        counts = known.select("text", number.alias("lang_at")).mapInArrow(lambda b: _counted(b, languages), "gram long, lang_at int, n long")
        counts = written(counts.groupBy("gram", "lang_at").agg(F.sum("n").alias("n")), "grams")
        totals = {r[0]: r[1] for r in counts.groupBy("lang_at").agg(F.sum("n")).collect()}
        rate = F.col("n") / F.element_at(F.array(*[F.lit(float(totals.get(i, 1))) for i in range(len(languages))]), F.col("lang_at") + 1)
        rates = counts.select("gram", "lang_at", rate.alias("rate"))
        sums = rates.groupBy("gram").agg(F.sum("rate").alias("all"), F.collect_list(F.struct("lang_at", "rate")).alias("r"))
        members = sums.select("gram", F.explode(F.filter("r", lambda x: x["rate"] >= SHARE * F.col("all"))).alias("r")).select("gram", "r.lang_at")
        filled = members.mapInArrow(_cells, "cell int, byte_at int, bits int").groupBy("cell", "byte_at").agg(F.bit_or("bits").alias("bits"))
        got = filled.toArrow()
        cells[got["cell"].to_numpy(), got["byte_at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    filled = np.array([np.mean((cells[:, j >> 3] >> (j & 7)) & 1) for j in range(len(languages))])
    return BloomModel(languages, cells, np.minimum(filled**PROBES, 0.999))


def _cells(batches):
    for batch in batches:
        grams = batch.column(0).to_numpy().view(np.uint64)
        lang = batch.column(1).to_numpy()
        at = np.concatenate(probes(grams))
        byte = np.tile(lang >> 3, PROBES)
        bit = np.tile(1 << (lang & 7), PROBES)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (at, byte, bit)], names=["cell", "byte_at", "bits"])


def predict(docs: DataFrame, model: Broadcast, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus ``lang_pred`` and ``score``.

    ``und`` with score 0 for null texts and texts without a letter, and for every text when nothing was
    learned. Ties go to the language that comes first in alphabetical order. The score is the winner's
    part of the sum of corrected counts. Rows are judged one by one, so repeated rows, null keys and
    empty tables need no care; columns with one of the new names are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        own = model.value
        names = np.array([*own.languages, "und"], dtype=object)
        for batch in batches:
            best, share = np.full(batch.num_rows, len(own.languages)), np.zeros(batch.num_rows)
            for a, b, grams, doc in gram_batches(batch.column(len(kept))) if own.languages else ():
                counts, total = own.scores(grams, doc, b - a)
                top = counts.argmax(axis=1)
                whole = counts.sum(axis=1)
                best[a:b] = np.where(total > 0, top, len(own.languages))
                share[a:b] = np.where(whole > 0, counts[np.arange(b - a), top] / np.where(whole > 0, whole, 1), 0.0)
            fresh = [pa.array(names[best], pa.string()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + fresh, names=[*kept, "lang_pred", "score"])

    schema = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in kept) + "lang_pred string, score double"
    return source.mapInArrow(run, schema)
