"""Scoring of texts with a class-based bigram language model (Brown model).

Word counts of all training texts form a distributed table. The ``CORE_WORDS`` most frequent words are put
into classes by exchange clustering: in rounds, words go to the class where the class-bigram
likelihood gains most, until the likelihood hardly gains. Then every other word that occurs
``LEAST_COUNT`` times or more makes the same exchange, from the class of its shape to the class in which its
own neighbours make class bigrams likeliest; so the words with learned classes grow with the corpus. Words
that occur once and unknown ones are in a few classes by their shape. A text's probability is the product of
class transitions and of word emissions within the class, both smoothed.

Texts lie in blocks; a block's distinct words meet counts and classes of all words in a join and then their
texts in one group for each block. Only the core, whose size is fixed, is broadcast. A word outside the core
is at most one in ``CORE_WORDS`` of all tokens, so no group of the shuffles by word is large.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, sides
from .store import written
from .textkit import Words, word_batches

LEAST_COUNT = 2
CORE_WORDS = 1 << 13
CLASSES = 48
#: Rounds go on while one raises the log likelihood by this share of it and makes this share of its moves.
LEAST_GAIN = 3e-4
LEAST_SHARE = 1 / 256
SHAPES = 4
#: Codes of all classes: learned ones, shapes, the end and the start of a text.
CODES = CLASSES + SHAPES + 2
END, START = CODES - 2, CODES - 1
#: Added to counts of words, in the base score and in the emissions of shape classes.
WORD_SMOOTHING = 0.1
#: Weight, in observations, of the unconditional class probabilities in a class's transitions.
TRANSITION_WEIGHT = 5.0
_HELD = 1_000_000


def shapes(words: Words) -> np.ndarray:
    """0 to 3 for each word: 1 more when it ends in an ASCII sign, 2 more when it has a byte beyond ASCII."""
    if not len(words):
        return np.zeros(0, np.int64)
    last = words.data[words.end - 1]
    sign = (last < 128) & ~(((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)))
    beyond = np.concatenate(([0], np.cumsum(words.data >= 128)))
    return sign.astype(np.int64) + 2 * (beyond[words.end] > beyond[words.start])


class _Sums:
    """Sums by integer key, merged whenever many have gathered."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        distinct, inverse = np.unique(keys, return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        self.parts, self.size = [(distinct, sums)], len(distinct)
        return distinct, sums


class Core:
    """The core words and, of each, its place in the order of frequency, its count and its class."""

    def __init__(self, word: np.ndarray, n: np.ndarray, classes: np.ndarray):
        self.order = np.argsort(word)
        self.word, self.n, self.classes = word[self.order], n[self.order], classes

    def places(self, word: np.ndarray) -> np.ndarray:
        """The place of each word in the order of frequency, -1 outside the core."""
        if not len(self.word):
            return np.full(len(word), -1)
        spot = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[spot] == word, self.order[spot], -1)


def _block_words(batches) -> Iterator[pa.RecordBatch]:
    """(block, word, shape, n) of batches (text, trains, block); n counts training texts only."""
    at_block = None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flushed():
        word, shape, n = (np.concatenate(c) for c in zip(*held, strict=True))
        distinct, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=n, minlength=len(distinct)).astype(np.int64)
        return distinct, shape[first], n

    def batch_of(block, word, shape, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), block, np.int64)), pa.array(word.view(np.int64)), pa.array(shape.astype(np.int8)), pa.array(n)], names=["block", "word", "shape", "n"])

    for batch in batches:
        blocks = batch.column(2).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if at_block is not None and blocks[a] != at_block and held:
                yield batch_of(at_block, *flushed())
                held, size = [], 0
            at_block = int(blocks[a])
            trains = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
            for c, d, words in word_batches(batch.column(0).slice(a, b - a)):
                if not len(words):
                    continue
                word, shape = words.hashes(), shapes(words)
                counted = np.repeat(trains[c:d], np.diff(words.first))
                distinct, first, inverse = np.unique(word, return_index=True, return_inverse=True)
                held.append((distinct, shape[first], np.bincount(inverse, weights=counted, minlength=len(distinct)).astype(np.int64)))
                size += len(distinct)
                if size > _HELD:
                    held = [flushed()]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield batch_of(at_block, *held[0])
                        held, size = [], 0
    if held:
        yield batch_of(at_block, *flushed())


def _sequences(column: pa.Array, core: Core, code_of: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, first, word) of slices of texts: each text as start, words and end.

    Core words have the code that ``code_of`` has at their place, other words that of their shape; the codes
    of shapes, end and start are the last ones below ``size``. ``word`` is 0 where no word outside the core stands.
    """
    for _, _, w in word_batches(column):
        docs, word = len(w.first) - 1, w.hashes()
        at = core.places(word)
        number = np.repeat(np.arange(docs), np.diff(w.first))
        first = w.first[:-1] + 2 * np.arange(docs)
        code, other = np.empty(len(word) + 2 * docs, np.int64), np.zeros(len(word) + 2 * docs, np.uint64)
        inner = np.arange(len(word)) + 2 * number + 1
        code[inner] = np.where(at >= 0, code_of[at] if len(code_of) else 0, size - SHAPES - 2 + shapes(w))
        other[inner] = np.where(at >= 0, np.uint64(0), word)
        code[first] = size - 1
        code[w.first[1:] + 2 * np.arange(docs) + 1] = size - 2
        yield code, first, other


def _sent(sums: _Sums, names: list[str], split: int) -> Iterator[pa.RecordBatch]:
    """What has gathered as (first, second, n), if anything; keys are first * split + second."""
    if sums.parts:
        keys, n = sums.merged()
        yield pa.RecordBatch.from_arrays([pa.array((keys // split).astype(np.int32)), pa.array((keys % split).astype(np.int32)), pa.array(n)], names=names)


def _core_bigrams(texts: DataFrame, core) -> DataFrame:
    """(a, b, n): how often core word or shape b follows a; ``texts`` has the texts alone."""

    def run(batches):
        own, sums = core.value, _Sums()
        m = len(own.word)
        size = m + SHAPES + 2
        for batch in batches:
            for code, first, _ in _sequences(batch.column(0), own, np.arange(m), size):
                inner = np.ones(len(code), bool)
                inner[first] = False
                b = np.flatnonzero(inner)
                sums.add(*np.unique(code[b - 1] * size + code[b], return_counts=True))
                if sums.size > 2 * _HELD:
                    sums.merged()
                    if sums.size > _HELD:
                        yield from _sent(sums, ["a", "b", "n"], size)
                        sums = _Sums()
        yield from _sent(sums, ["a", "b", "n"], size)

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(word: np.ndarray, side: np.ndarray, cls: np.ndarray, n: np.ndarray, own: np.ndarray, table: np.ndarray, stay: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each word, numbered from 0, the class in which its neighbours make class bigrams likeliest, and how much it gains there.

    A row says that ``word`` has neighbours of class ``cls`` behind it (side 0) or in front (side 1) ``n`` times;
    rows are sorted by word and differ in (word, side, cls), and every word has one. ``table`` has the bigram
    counts of all classes with each word in its ``own`` class. With ``stay`` a word moves only if it gains.
    """
    table = table.astype(float)
    right, left = np.zeros((len(own), CODES)), np.zeros((len(own), CODES))
    right[word[side == 0], cls[side == 0]] = n[side == 0]
    left[word[side == 1], cls[side == 1]] = n[side == 1]
    who, r_sum, l_sum = np.arange(len(own)), right.sum(axis=1), left.sum(axis=1)
    # A word beside itself is in both of its counts.
    twice = np.maximum(0, right[who, own] + left[who, own] - table[own, own])
    rows, cols = table.sum(axis=1) - left, table.sum(axis=0) - right
    rows[who, own] += twice - r_sum
    cols[who, own] += twice - l_sum
    gain = -(_phi(rows + r_sum[:, None]) - _phi(rows) + _phi(cols + l_sum[:, None]) - _phi(cols))
    begins = np.searchsorted(word, who)
    for a in range(0, len(own), 512):
        part = slice(begins[a], begins[a + 512] if a + 512 < len(own) else len(word))
        w, s, k, c = word[part], side[part], cls[part], n[part]
        beside = np.where((s == 0)[:, None], table[:, k].T, table[k])
        beside[np.arange(len(w)), own[w]] -= c
        same = np.flatnonzero(k == own[w])
        beside[same] -= np.where((s[same] == 0)[:, None], left[w[same]], right[w[same]])
        beside = np.maximum(beside, 0)
        gain[a : a + 512] += np.add.reduceat(_phi(beside + c[:, None]) - _phi(beside), begins[a : a + 512] - begins[a])
    top = gain[:, :CLASSES].argmax(axis=1)
    # What rounding alone makes of equal gains, such as those of empty classes, is no reason to move.
    more = gain[who, top] - gain[who, own]
    return (np.where(more > 1e-6 * (1 + r_sum + l_sum), top, own) if stay else top), more


def _neighbours(seen: pa.Array, field: int) -> np.ndarray:
    return pc.struct_field(seen.flatten(), field).to_numpy(zero_copy_only=False)


def _summed(word: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, side, class, count) with equal ones added up; ``code`` is side * CODES + class."""
    keys, inverse = np.unique(word * (2 * CODES) + code, return_inverse=True)
    n = np.bincount(inverse, weights=n, minlength=len(keys))
    return keys // (2 * CODES), keys // CODES % 2, keys % CODES, n


def _class_of(classes: np.ndarray) -> np.ndarray:
    """Class of every token of the core bigrams: those of the words, then one for each shape, the end and the start."""
    return np.concatenate([classes, CLASSES + np.arange(SHAPES + 2)]).astype(np.uint8)


def _as_table(pairs: DataFrame) -> np.ndarray:
    """Bigram counts between classes from (code, n), code is a * CODES + b; the driver gets one number for each pair of classes."""
    got = pairs.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(CODES * CODES, np.int64)
    table[got["code"].to_numpy()] = got["n"].to_numpy()
    return table.reshape(CODES, CODES)


def _pairs(total: np.ndarray) -> pa.RecordBatch:
    there = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["code", "n"])


def _class_table(bigrams: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """Bigram counts between the classes of core words and shapes."""
    held = bigrams.sparkSession.sparkContext.broadcast(class_of)

    def run(batches):
        own, total = held.value, np.zeros(CODES * CODES, np.int64)
        for batch in batches:
            code = own[batch.column(0).to_numpy()].astype(np.int64) * CODES + own[batch.column(1).to_numpy()]
            total += np.bincount(code, weights=batch.column(2).to_numpy(), minlength=CODES * CODES).astype(np.int64)
        yield _pairs(total)

    table = _as_table(bigrams.mapInArrow(run, "code long, n long"))
    held.destroy()
    return table


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood that hangs on the classes, of class bigram counts."""
    t = table.astype(float)
    return float(_phi(t).sum() - _phi(t.sum(axis=0)).sum() - _phi(t.sum(axis=1)).sum())


def _exchange(bigrams: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(classes, class bigrams, likelihoods) after rounds in which core words move to their best classes.

    Words that move at once may spoil each other's gains. So those that gain most move first: of a round that
    lowers the likelihood a quarter of the moves is tried, and so on.
    """
    sc, m = bigrams.sparkSession.sparkContext, len(classes)
    size = m + SHAPES + 2
    # Neighbours of each core word, at most two for each token: behind it below ``size``, in front from there on.
    behind = bigrams.where(F.col("a") < m).select(F.col("a").alias("word"), F.col("b").alias("other"), "n")
    front = bigrams.where(F.col("b") < m).select(F.col("b").alias("word"), (F.col("a") + size).alias("other"), "n")
    beside = written(behind.unionByName(front).groupBy("word").agg(F.collect_list(F.struct("other", "n")).alias("seen")), "beside")
    counts = _class_table(bigrams, _class_of(classes))
    reached, share = [likelihood(counts)], 1.0
    while m:
        class_of, table = sc.broadcast(_class_of(classes)), sc.broadcast(counts)

        def moved(batches, class_of=class_of, table=table):
            for batch in batches:
                own, other = class_of.value, _neighbours(batch.column(1), 0)
                word = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy())
                rows = _summed(word, own[other % size] + CODES * (other // size), _neighbours(batch.column(1), 1))
                now = own[batch.column(0).to_numpy()].astype(np.int64)
                best, gain = best_classes(*rows, now, table.value)
                moves = np.flatnonzero(best != now)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(moves)), pa.array(best[moves].astype(np.int8)), pa.array(gain[moves])], names=["word", "cls", "gain"])

        got = beside.mapInArrow(moved, "word int, cls byte, gain double").toArrow()
        class_of.destroy()
        table.destroy()
        order = np.lexsort((got["word"].to_numpy(), -got["gain"].to_numpy()))
        word, cls = got["word"].to_numpy()[order], got["cls"].to_numpy()[order]
        share, rose = min(1.0, 4 * share), False
        while len(word) and not rose and share >= LEAST_SHARE:
            new, tried = classes.copy(), int(np.ceil(share * len(word)))
            new[word[:tried]] = cls[:tried]
            new_counts = _class_table(bigrams, _class_of(new))
            rose = likelihood(new_counts) > reached[-1]
            share = share if rose else share / 4
        if not rose:
            break
        classes, counts = new, new_counts
        reached.append(likelihood(counts))
        if reached[-1] - reached[-2] <= LEAST_GAIN * abs(reached[-1]):
            break
    return classes, counts, reached


def _rest_classes(texts: DataFrame, core, counts) -> DataFrame:
    """(word, cls) of the words outside the core that occur ``LEAST_COUNT`` times: each in the class that its neighbours choose."""

    def contexts(batches):
        own, held, size = core.value, [], 0
        code_of = own.classes.astype(np.int64)

        def out():
            word, pair = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((pair, word))
            word, pair = word[order], pair[order]
            first = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (pair[1:] != pair[:-1]))))
            n = np.diff(np.append(first, len(word)))
            return pa.RecordBatch.from_arrays([pa.array(word[first].view(np.int64)), pa.array(pair[first].astype(np.int32)), pa.array(n)], names=["word", "pair", "n"])

        for batch in batches:
            for code, _, word in _sequences(batch.column(0), own, code_of, CODES):
                at = np.flatnonzero(word)
                held.append((word[at], (code[at - 1] * CODES + code[at + 1]) * SHAPES + code[at] - CLASSES))
                size += len(at)
                if size > 4 * _HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def choose(batches):
        table = counts.value
        for batch in batches:
            seen = batch.column(1)
            word, pair, n = np.repeat(np.arange(batch.num_rows), pc.list_value_length(seen).to_numpy()), _neighbours(seen, 0).astype(np.int64), _neighbours(seen, 1)
            shape = np.zeros(batch.num_rows, np.int64)
            shape[word] = pair % SHAPES
            pair //= SHAPES
            parts = _summed(np.tile(word, 2), np.concatenate([pair % CODES, CODES + pair // CODES]), np.tile(n, 2))
            best = best_classes(*parts, CLASSES + shape, table, stay=False)[0] if batch.num_rows else shape
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int8))], names=["word", "cls"])

    met = texts.mapInArrow(contexts, "word long, pair int, n long").repartition("word").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    # A word has at most a row for each pair of classes, so its list is bounded.
    lists = met.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("pair", "n")).alias("seen")).where(F.col("all") >= LEAST_COUNT)
    return lists.select("word", "seen").mapInArrow(choose, "word long, cls byte")


def score_texts(docs: DataFrame, trains: str, text: str = "text", core_words: int = CORE_WORDS) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Learns from the rows whose boolean column ``trains`` is true (null counts as false) and scores all rows,
    whole texts. Null and empty texts are the end token alone. With no training row every count is 0 and
    base scores are 0. Rows are scored one by one: repeated rows, ties and null keys need no care; of an
    empty table nothing is returned. Columns with one of the new names are replaced. Words are told apart by
    a 64-bit hash.
    """
    sc = docs.sparkSession.sparkContext
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kept = [c for c in docs.columns if c != text and c not in (*new, "block")]
    held = blocked(docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{trains}`"), F.lit(False)).alias("__trains"), F.col(f"`{text}`").alias("__text")), "__text", "lm_texts")
    words = written(held.select("__text", "__trains", "block").mapInArrow(_block_words, "block long, word long, shape byte, n long"), "words")
    vocabulary = written(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"), F.first("shape").alias("shape")), "vocabulary")
    end_count = held.where("__trains").count()
    sizes = vocabulary.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = (sizes[0] or 0) + end_count, sizes[1] + (end_count > 0)
    most = vocabulary.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(core_words).select("word", "n").toArrow()
    word, n = most["word"].to_numpy().view(np.uint64), most["n"].to_numpy()
    core = sc.broadcast(Core(word, n, np.zeros(0, np.uint8)))
    taught = held.where("__trains").select("__text")
    classes, counts, _ = _exchange(written(_core_bigrams(taught, core), "bigrams"), (np.arange(len(word)) % CLASSES).astype(np.uint8))
    core.destroy()
    core, counted = sc.broadcast(Core(word, n, classes)), sc.broadcast(counts)
    rest = _rest_classes(taught, core, counted)
    lexicon = written(vocabulary.join(rest, "word", "left"), "lexicon")
    in_core = lambda batches: (b.filter(pa.array(core.value.places(b.column(1).to_numpy().view(np.uint64)) < 0)) for b in batches)
    # Core words are known everywhere already; the others meet their counts and classes.
    known = words.select("block", "word").mapInArrow(in_core, "block long, word long").join(lexicon.select("word", "n", "cls"), "word")
    tail = lexicon.mapInArrow(lambda batches: (b.filter(pa.array(core.value.places(b.column(0).to_numpy().view(np.uint64)) < 0)) for b in batches), lexicon.schema)
    shaped = {r[0]: (r[1], r[2]) for r in tail.where("cls is null").groupBy("shape").agg(F.sum("n"), F.count("*")).collect()}
    shape_tokens, shape_words = (np.array([shaped.get(s, (0, 0))[i] for s in range(SHAPES)], float) for i in (0, 1))
    floor = tokens + WORD_SMOOTHING * (distinct + 1)
    end_score = float(np.log10((end_count + WORD_SMOOTHING) / floor))
    made = ["__trains", "n_tokens", "n_known", "base_score", "__emitted", "__codes"]

    def code(texts, met):
        own = core.value
        known_word = met["word"].to_numpy().view(np.uint64)
        order = np.argsort(known_word)
        known_word, met_n, met_cls = known_word[order], met["n"].to_numpy()[order], met["cls"].fill_null(-1).to_numpy()[order]
        out = [[], [], [], [], []]
        for _, _, w in word_batches(texts["__text"]):
            docs, word, shape = len(w.first) - 1, w.hashes(), shapes(w)
            c, cls = np.zeros(len(word), np.int64), np.full(len(word), -1)
            if len(known_word):
                spot = np.minimum(np.searchsorted(known_word, word), len(known_word) - 1)
                there = known_word[spot] == word
                c[there], cls[there] = met_n[spot[there]], met_cls[spot[there]]
            at = own.places(word)
            there = at >= 0
            if there.any():
                counts = np.empty(len(own.n), np.int64)
                counts[own.order] = own.n
                c[there], cls[there] = counts[at[there]], own.classes[at[there]]
            rare = (c + WORD_SMOOTHING) / (shape_tokens[shape] + WORD_SMOOTHING * (shape_words[shape] + 1))
            number = np.repeat(np.arange(docs), np.diff(w.first))
            of_doc = lambda x, number=number, docs=docs: np.bincount(number, weights=x, minlength=docs)
            codes = np.empty(len(word) + 2 * docs, np.uint8)
            begin = w.first[:-1] + 2 * np.arange(docs)
            codes[np.arange(len(word)) + 2 * number + 1] = np.where(cls >= 0, cls, CLASSES + shape)
            codes[begin] = START
            codes[w.first[1:] + 2 * np.arange(docs) + 1] = END
            emit = np.log10(np.where(cls >= 0, np.maximum(c, 1), rare))
            columns = np.diff(w.first) + 1, of_doc(c > 0).astype(np.int64) + int(end_count > 0), of_doc(np.log10((c + WORD_SMOOTHING) / floor)) + end_score, of_doc(emit)
            for column, value in zip(out, columns, strict=False):
                column.append(value)
            out[4] += [codes[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(codes)], strict=True)]
        numeric = [np.concatenate(c) if c else np.zeros(0) for c in out[:4]]
        fresh = [pa.array(numeric[0].astype(np.int64)), pa.array(numeric[1].astype(np.int64)), *(pa.array(x, pa.float64()) for x in numeric[2:]), pa.array(out[4], pa.binary())]
        return pa.table([*(texts[c] for c in kept), texts["__trains"], *fresh], names=[*kept, *made])

    kept_schema = "".join(f"`{c}` {held.schema[c].dataType.simpleString()}, " for c in kept)
    coded = written(sides(held, known).applyInArrow(code, kept_schema + "__trains boolean, n_tokens long, n_known long, base_score double, __emitted double, __codes binary"), "coded")

    def moves(batches):
        total = np.zeros(CODES * CODES, np.int64)
        for batch in batches:
            codes, begin = _flat(batch.column(0))
            inner = np.ones(len(codes), bool)
            inner[begin] = False
            b = np.flatnonzero(inner)
            total += np.bincount(codes[b - 1].astype(np.int64) * CODES + codes[b], minlength=CODES * CODES)
        yield _pairs(total)

    table = _as_table(coded.where("__trains").select("__codes").mapInArrow(moves, "code long, n long")).astype(float)
    arrivals = table.sum(axis=0)
    prior = (arrivals + 0.5) / (arrivals + 0.5).sum()
    transition = np.log10((table + TRANSITION_WEIGHT * prior) / (table.sum(axis=1, keepdims=True) + TRANSITION_WEIGHT))
    # A word's count within its class: the counts are in what was emitted, the class's own belongs to each arrival.
    transition[:, :CLASSES] -= np.log10(np.maximum(1, arrivals[:CLASSES]))

    def scored(batches):
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            codes, begin = _flat(column["__codes"])
            move = np.zeros(len(codes))
            move[1:] = transition[codes[:-1], codes[1:]]
            move[begin] = 0.0
            score = column["__emitted"].to_numpy() + (np.add.reduceat(move, begin) if len(begin) else np.zeros(0))
            perplexity = 10 ** np.minimum(300, -score / np.maximum(1, column["n_tokens"].to_numpy()))
            fresh = [column["n_tokens"], column["n_known"], pa.array(np.full(len(score), tokens, np.int64)), column["base_score"], pa.array(score), pa.array(perplexity)]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in kept), *fresh], names=kept + new)

    return coded.mapInArrow(scored, kept_schema + "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def _flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all rows, first of each row)."""
    length = pc.binary_length(codes).to_numpy()
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8), np.cumsum(length) - length
