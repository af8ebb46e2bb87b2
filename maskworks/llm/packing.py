"""Packing documents into windows of tokens: length combinations by non-negative least squares, the rest greedily.

Texts are encoded where they are read. A document is cut into whole windows and a tail; the count of tails of
each length, at most ``window`` figures, is all the plan is made from, so the driver's work does not grow with
the corpus. Combinations of two or three lengths that fill a window exactly are the columns of a non-negative
least squares problem whose right side is that histogram. Its solution says how often each is used; rounded, it
takes most tails. What is left is packed greedily: from the longest tail down, ever shorter ones fill the
window for as long as they come out even, and those that never do lie end to end and are cut where a window
ends. So no window has padding, but for the last one, which is cut into powers of two.

Every tail has a number among those of its length: the count of such tails in earlier tasks plus those before
it in its own task. The number alone says which window the plan puts it into, so pieces are placed in parallel
and no group of equal lengths, however large, meets in one task.
"""

import base64
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .textkit import slices, utf8

WINDOW = 1024
#: Chunks that a task remembers, and the longest one that it does; neither changes an id.
KNOWN_CHUNKS, KNOWN_BYTES, CHUNKS_AT_ONCE = 400_000, 48, 1 << 16
#: Rounds of the least squares solver; what it has not settled by then is packed greedily.
ROUNDS, ADDED, SETTLED = 200, 128, 1e-2


def _plain_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that surely end, and surely begin, a character that is no white space."""
    ends, begins = np.zeros(256, bool), np.zeros(256, bool)
    ends[0x21:0x7F] = begins[0x21:0x7F] = True
    ends[0x80:0xC0] = True
    ends[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, 0xBF]] = False
    begins[0xC3:0xF5] = True
    begins[[0xE1, 0xE2, 0xE3, 0xEF]] = False
    return ends, begins


_ENDS, _BEGINS = _plain_bytes()


#: Characters whose classes have been the same in every version of Unicode that the two libraries may know.
_SETTLED_CHARACTERS = re.compile("[\\x00-\u024f\u0400-\u04ff\u2010-\u2027\u4e00-\u9fa5]*")


class ChunkEncoder:
    """Ids of texts by way of their chunks: a text falls apart where its pre-tokens surely do.

    Such places are a lone blank or line end between other characters. A chunk is encoded once, as long as the
    task remembers it: those of long settled characters many at a time by the vocabulary as ranks, the others,
    and all in which a special token may stand, by the tokenizer itself; tests hold the two equal.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._whole, self._ranked = Tokenizer.from_file(tokenizer_path), None
        if ranks_path:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self._ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self._bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
            self._bytes_of[list(ranks.values())] = list(map(len, ranks))
        self._forget()

    def _forget(self) -> None:
        self._codes: dict[bytes, int] = {}
        self._begin = np.zeros(KNOWN_CHUNKS + 2 * CHUNKS_AT_ONCE + 1, np.int64)
        self._store = np.zeros(1 << 20, np.uint32)
        self._many = 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Appends the ids of some chunks, which get the next codes."""
        used = int(self._begin[self._many])
        while used + len(ids) > len(self._store):
            self._store = np.concatenate([self._store, np.zeros_like(self._store)])
        self._store[used : used + len(ids)] = ids
        self._begin[self._many + 1 : self._many + 1 + len(sizes)] = used + np.cumsum(sizes)
        self._many += len(sizes)

    def _together(self, chunk: bytes) -> bool:
        if self._ranked is None or b"<|" in chunk or not _ENDS[chunk[-1]]:
            return False
        first = chunk[1] if chunk[0] == 0x20 and len(chunk) > 1 else chunk[0]
        return bool(_BEGINS[first]) and (chunk.isascii() or _SETTLED_CHARACTERS.fullmatch(chunk.decode()) is not None)

    def _encoded(self, chunks: list[bytes]) -> None:
        """Keeps the ids of chunks in their order."""
        together = [self._together(c) for c in chunks]
        # A chunk without a blank in front gets a line end, which is a pre-token of its own, and loses its id again.
        parts = [c if c[0] == 0x20 else b"\n" + c for c, t in zip(chunks, together, strict=True) if t]
        ids = np.array(self._ranked.encode_ordinary(b"".join(parts).decode()) if parts else [], np.uint32)
        ends = np.searchsorted(self._bytes_of[ids].cumsum(), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))) + 1 if parts else []
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64) + np.array([p[0] == 0x0A for p in parts], np.int64) if parts else []
        out, k = [], 0
        for c, t in zip(chunks, together, strict=True):
            if t:
                out.append(ids[begins[k] : ends[k]])
                k += 1
            else:
                out.append(np.array(self._whole.encode(c.decode(), add_special_tokens=False).ids, np.uint32))
        self._keep(np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out)))

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids end among them."""
        cut = np.zeros(len(data) + 1, bool)
        gap = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1
        gap = gap[_ENDS[data[gap - 1]] & _BEGINS[data[gap + 1]]]
        cut[gap] = True
        cut[gap[data[gap] == 0x0A] + 1] = True
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        raw, found, sizes = data.tobytes(), [np.zeros(0, np.uint32)], []
        for a in range(0, len(starts) - 1, CHUNKS_AT_ONCE):
            ids, size = self._some(raw, starts[a : a + CHUNKS_AT_ONCE + 1].tolist())
            found.append(ids)
            sizes.append(size)
        total = np.concatenate(([0], *sizes)).cumsum()
        return np.concatenate(found), total[np.searchsorted(starts, offsets[1:])]

    def _some(self, raw: bytes, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._codes) > KNOWN_CHUNKS:
            self._forget()
        code_of = self._codes.get
        codes = np.array([code_of(raw[a:b], -1) for a, b in zip(places, places[1:])])
        unknown = np.flatnonzero(codes < 0)
        new: dict[bytes, int] = {}
        which = [new.setdefault(raw[places[i] : places[i + 1]], len(new)) for i in unknown.tolist()]
        known = self._many
        if new:
            # Long chunks come last and are forgotten with the block.
            order = sorted(new, key=lambda c: len(c) > KNOWN_BYTES)
            self._encoded(order)
            place = {c: known + i for i, c in enumerate(order)}
            codes[unknown] = np.array([place[c] for c in new])[which]
            short = sum(len(c) <= KNOWN_BYTES for c in order)
            self._codes.update((c, place[c]) for c in order[:short])
        size = self._begin[codes + 1] - self._begin[codes]
        at = np.arange(int(size.sum())) - np.repeat(size.cumsum() - size, size) + np.repeat(self._begin[codes], size)
        flat = self._store[at]
        if new:
            self._many = known + short
        return flat, size


@cache
def chunk_encoder(*where: str | None) -> ChunkEncoder:
    """The encoder of a Python worker, which its tasks share."""
    return ChunkEncoder(*where)


def _counted(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each length among equal ones so far; ``seen`` is counted on."""
    order = np.argsort(lengths, kind="stable")
    held = lengths[order]
    first = np.searchsorted(held, held, "left")
    out = np.empty(len(lengths), np.int64)
    out[order] = seen[held] + np.arange(len(held)) - first
    np.add.at(seen, lengths, 1)
    return out


def windows(docs: DataFrame, key: str, text: str, encoder: tuple, window: int = WINDOW) -> DataFrame:
    """(key, start, length, ids, doc_tokens, task, local): every text's ids and a 0, cut into whole windows and a tail.

    ``ids`` is binary, 32-bit little-endian; ``local`` numbers the pieces of one length in one task.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    spec = f"key {source.schema['key'].dataType.simpleString()}, start long, length int, ids binary, doc_tokens long, task int, local long"

    def run(batches):
        encode, seen, task = chunk_encoder(*encoder), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for a, b in slices(offsets):
                ids, ends = encode(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                ids = np.insert(ids, ends, 0).astype("<u4")
                tokens = np.diff(ends, prepend=0) + 1
                ends = tokens.cumsum()
                pieces = -(-tokens // window)
                doc = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(doc)) - np.repeat(pieces.cumsum() - pieces, pieces)) * window
                length = np.minimum(window, tokens[doc] - start)
                at = np.append((ends - tokens)[doc] + start, ends[-1])
                # Pieces lie one after another in ``ids``, which so serves as the column's bytes.
                local = _counted(length, seen)
                for x in range(0, len(doc), 8192):
                    y = min(len(doc), x + 8192)
                    held = ids[at[x] : at[y]]
                    body = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(((at[x : y + 1] - at[x]) * 4).astype(np.int32)), pa.py_buffer(held.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(doc[x:y] + a)), pa.array(start[x:y]), pa.array(length[x:y].astype(np.int32)), body,
                            pa.array(tokens[doc[x:y]]), pa.array(np.full(y - x, task, np.int32)), pa.array(local[x:y]),
                        ],
                        names=["key", "start", "length", "ids", "doc_tokens", "task", "local"],
                    )

    return source.mapInArrow(run, spec)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Every two or three of some lengths that sum up to a window, rising, as rows (0, a, b) or (a, b, c)."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a, b = np.meshgrid(np.arange(window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    c = window - a - b
    there[0] = True
    good = (a <= b) & (b <= c) & (c < window) & there[a] & there[b] & there[np.maximum(c, 0)]
    return np.stack([a[good], b[good], c[good]], 1)


def least_squares(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each combination is used: non-negative x with the least squared distance of its lengths to ``counts``.

    An active set method that lets many columns with disjoint lengths in at once while that lowers the
    distance, and one at a time when it no longer does.
    """
    x, n = np.zeros(len(combos)), len(counts)
    weight = np.append(0.0, np.ones(n - 1))

    def used(some: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.bincount(combos[some].ravel(), np.repeat(times, 3), n) * weight

    def solved(some: np.ndarray) -> np.ndarray:
        matrix = np.zeros((n, len(some)))
        np.add.at(matrix, (combos[some].ravel(), np.repeat(np.arange(len(some)), 3)), 1.0)
        matrix[0] = 0
        gram = matrix.T @ matrix
        gram[np.diag_indices(len(some))] += 1e-9
        return np.linalg.solve(gram, matrix.T @ goal)

    goal = counts * weight
    scale, added = goal.max(initial=0.0), ADDED
    rest, passive = goal.copy(), np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        if not len(combos) or np.abs(rest).sum() <= 1e-3 * goal.sum():
            break
        gain = rest[combos].sum(1)
        gain[passive] = 0
        order, taken, new = np.argsort(-gain, kind="stable")[: 40 * added], np.zeros(n, bool), []
        for j in order:
            if gain[j] <= 1e-9 * scale or len(new) == added:
                break
            if not taken[combos[j]].any():
                new.append(j)
                taken[combos[j][combos[j] > 0]] = True
        if not new:
            break
        some = np.concatenate([passive, np.array(new, np.int64)])
        times = solved(some)
        while len(some) and times.min() <= 0:
            some = some[times > 0]
            times = solved(some)
        left = goal - used(some, times)
        now, before = left @ left, rest @ rest
        if now < before:
            passive, rest = some, left
            x[:] = 0
            x[passive] = times
        if now > before * (1 - SETTLED):
            if added == 1:
                break
            added = max(1, added // 4)
    return x


@dataclass
class Plan:
    """Where the tail of a length and number goes: runs of windows of one combination, or the tape of those that are cut.

    ``runs[length]``: (first numbers, first window of each run, tails of that length in each window, offset of the
    first). ``tape[length]``: first number on the tape and where it begins there. The tape is cut at
    multiples of the window and at ``ends``, the powers of two that its last part is made of.
    """

    window: int
    runs: dict[int, list[np.ndarray]] = field(default_factory=dict)
    tape: dict[int, tuple[int, int]] = field(default_factory=dict)
    first_of_tape: int = 0
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))


def plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The plan for a histogram of lengths: ``counts[n]`` pieces have ``n`` ids."""
    left, out, at = counts.astype(np.int64).copy(), Plan(window), 0
    runs: dict[int, list[tuple]] = {}

    def use(lengths: np.ndarray, times: int) -> None:
        nonlocal at
        offset = 0
        for n, m in zip(*np.unique(lengths, return_counts=True), strict=True):
            runs.setdefault(int(n), []).append((int(counts[n] - left[n]), at, int(m), offset))
            left[n] -= m * times
            offset += int(n * m)
        at += times

    def fits(lengths: np.ndarray, most: int) -> int:
        n, m = np.unique(lengths, return_counts=True)
        return int(min(most, (left[n] // m).min()))

    if left[window]:
        use(np.array([window]), int(left[window]))
    combos = combinations(np.flatnonzero(left[:window]), window)
    x = np.rint(least_squares(combos, left[:window].astype(float))).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        if not x[j]:
            break
        lengths = combos[j][combos[j] > 0]
        if times := fits(lengths, x[j]):
            use(lengths, times)
    for longest in range(window - 1, 0, -1):
        while left[longest]:
            lengths, room, below = [longest], window - longest, longest
            while room:
                there = np.flatnonzero(left[: min(room, below) + 1])
                if not len(there) or there[-1] == 0:
                    break
                below = int(there[-1])
                free = int(left[below]) - lengths.count(below)
                if free > 0:
                    lengths += [below] * min(free, room // below)
                    room = window - sum(lengths)
                below -= 1
            if room:
                break
            use(np.array(lengths), fits(np.array(lengths), int(left[longest])))
    end = 0
    for n in np.flatnonzero(left)[::-1]:
        out.tape[int(n)] = (int(counts[n] - left[n]), end)
        end += int(n * left[n])
    out.first_of_tape = at
    last, ends = end - end % window, [end - end % window]
    for bit in range(window.bit_length(), -1, -1):
        if (end - last) >> bit & 1:
            ends.append(ends[-1] + (1 << bit))
    out.ends = np.array(ends, np.int64)
    out.runs = {n: [np.array(c, np.int64) for c in zip(*rows, strict=True)] for n, rows in runs.items()}
    return out


def placed(made: Plan, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, length, sequence, offset) of every part of some pieces; only pieces on the tape have several."""
    parts = []
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        on_tape, base = made.tape.get(int(n), (np.iinfo(np.int64).max, 0))
        whole, cut = rows[number[rows] < on_tape], rows[number[rows] >= on_tape]
        if len(whole):
            first, window_at, each, offset = made.runs[int(n)]
            k = np.searchsorted(first, number[whole], "right") - 1
            nth = number[whole] - first[k]
            parts.append((whole, np.zeros(len(whole), np.int64), np.full(len(whole), n), window_at[k] + nth // each[k], offset[k] + nth % each[k] * n))
        pos, done = base + (number[cut] - on_tape) * n, np.zeros(len(cut), np.int64)
        while len(cut):
            full = pos < made.ends[0]
            k = np.searchsorted(made.ends, pos, "right")
            begin = np.where(full, pos // made.window * made.window, made.ends[k - 1])
            stop = np.where(full, begin + made.window, made.ends[np.minimum(k, len(made.ends) - 1)])
            here = np.minimum(stop - pos, n - done)
            seq = made.first_of_tape + np.where(full, pos // made.window, made.ends[0] // made.window + k - 1)
            parts.append((cut, done, here, seq, pos - begin))
            more = done + here < n
            cut, pos, done = cut[more], (pos + here)[more], (done + here)[more]
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def pack(docs: DataFrame, encoder: tuple, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, packed into windows.

    ``encoder`` is (tokenizer file, file of the same vocabulary as ranks or None, pattern of the latter). A document
    is its text's ids and then id 0; a null or an empty text is that id alone. ``ids`` is binary, 32-bit
    little-endian; ``start`` counts the document's ids before the piece. Sequences have exactly
    ``window`` ids, but for those with the end of the tape, which have powers of two. Rows with equal or
    null keys are documents of their own; very long texts are read piece by piece and make one row for
    each window. No rows give no pieces; other columns are not read.
    """
    pieces = written(windows(docs, key, text, encoder, window), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.withColumn("before", earlier), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for n, c in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[n] = c
    made = docs.sparkSession.sparkContext.broadcast(plan(histogram, window))
    numbered = pieces.join(counts.drop("n"), ["task", "length"]).select("key", "start", "length", "ids", "doc_tokens", (F.col("before") + F.col("local")).alias("number"))
    spec = f"`{key}` {pieces.schema['key'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("number").to_numpy(zero_copy_only=False)
            row, start, size, sequence, offset = placed(made.value, length, number)
            ids = batch.column("ids").take(pa.array(row))
            if (size < length[row]).any():  # a piece that is cut gives its parts
                ids = pa.array([x[4 * s : 4 * (s + n)] for x, s, n in zip(ids.to_pylist(), start.tolist(), size.tolist(), strict=True)], pa.binary())
            first = pc.add(batch.column("start").take(pa.array(row)), pa.array(start))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(row)), first, pa.array(size), ids, batch.column("doc_tokens").take(pa.array(row)), pa.array(sequence), pa.array(offset)],
                names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(run, spec)
