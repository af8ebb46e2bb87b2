"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are compared in a normal form: lower-case letters and digits, every run of other characters one
space. Benchmark items are cut into overlapping windows of at most ``WINDOW`` bytes. A window of L bytes
that stands in a document with at most e edits shares at least L - q + 1 - q*e of its q-grams with it,
on diagonals (place in the document minus place in the window) no further apart than e. So shared
q-grams are counted in overlapping diagonal bands, bands that reach the bound are kept, and a banded
alignment gives the number of edits.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .textkit import mix, slices, utf8

Q = 8
WINDOW = 160
STRIDE = 40
EDIT_SHARE = 0.1
#: Bytes of benchmark whose index is broadcast at a time; a larger benchmark takes several passes over the documents.
PASS_BYTES = 2 << 20
#: Shared q-grams that are looked at together; more are split by place and then by window.
HITS = 2_000_000
_STEP = 20
_BLOCK = 2048
_PIECE = 1 << 20
_SPAN = WINDOW + int(EDIT_SHARE * WINDOW)
_CELLS = 1 << 20

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def normal_form(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, which bytes of ``data`` they are) of the normal forms of some texts.

    ASCII and Latin-1 letters are lower-cased, which keeps places; other letters stay as they are.
    """
    low = _LOWER[data]
    if len(low) > 1:
        latin = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][latin] += 0x20
    word = _ALNUM[low]
    low[~word] = 0x20
    keep = word.copy()
    keep[1:] |= word[:-1]
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep[starts] = word[starts]
    sizes = [np.count_nonzero(keep[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return low[keep], np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), keep


def places(keep: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places in the text of some bytes of its normal form, without a table of all places."""
    before = np.concatenate(([0], np.cumsum([np.count_nonzero(keep[a : a + _PIECE]) for a in range(0, len(keep), _PIECE)], dtype=np.int64)))
    out = np.empty(len(wanted), np.int64)
    piece = np.searchsorted(before, wanted, "right") - 1
    for k in np.unique(piece):
        own = piece == k
        out[own] = np.flatnonzero(keep[k * _PIECE : (k + 1) * _PIECE])[wanted[own] - before[k]] + k * _PIECE
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(data) - Q + 1, np.uint64)
    for j in range(Q):
        out = (out << np.uint64(8)) | data[j : len(out) + j]
    return out


class Patterns:
    """The q-gram index of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        windows: dict[bytes, set] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            form = normal_form(np.array([0, len(raw)]), raw)[0]
            form = form[: len(form) - (len(form) > 0 and form[-1] == 0x20)]
            last = max(0, len(form) - WINDOW)
            for at in sorted({*range(0, last, STRIDE), last}):
                piece = form[at : at + WINDOW]
                if len(piece) >= Q:
                    windows.setdefault(piece.tobytes(), set()).add(item)
        self.text = list(windows)
        self.items = [sorted(i, key=lambda x: (x is None, x)) for i in windows.values()]
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.minimum((EDIT_SHARE * self.length).astype(np.int64), (self.length - Q) // Q)
        self.need = self.length - Q + 1 - Q * self.edits
        keys = np.concatenate([np.zeros(0, np.uint64), *(grams(np.frombuffer(t, np.uint8)) for t in self.text)])
        pattern = np.repeat(np.arange(len(self.text)), self.length - Q + 1)
        place = np.concatenate([np.zeros(0, np.int16), *(np.arange(n, dtype=np.int16) for n in self.length - Q + 1)])
        order = np.argsort(keys, kind="stable")
        self.place = place[order]
        self.keys, self.first, rank = np.unique(keys[order], return_index=True, return_inverse=True)
        self.first = np.append(self.first, len(keys))
        #: Postings by q-gram and window.
        self.code = rank * max(1, len(self.text)) + pattern[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(mix(self.keys) & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def matches(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, stop, edits) of the windows found in some texts; places are bytes of ``data``.

        What is found where two pieces of a text meet may come twice.
        """
        form, bounds, keep = normal_form(offsets, data)
        for row, pattern, diagonal in self._candidates(form, bounds):
            found = list(self._aligned(form, bounds, row, pattern, diagonal))
            if found:
                r, p, begin, stop, cost = (np.array(x) for x in zip(*found, strict=True))
                begin, stop = places(keep, begin), places(keep, stop - 1) + 1
                for i in range(len(r)):
                    for item in self.items[p[i]]:
                        yield int(r[i]), item, int(begin[i]), int(stop[i]), int(cost[i])

    def _candidates(self, form: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, window, diagonal) of bands with enough shared q-grams, piece by piece of the texts.

        Pieces overlap by the longest span a match can have, so each match lies in one of them whole.
        """
        for begin in range(0, len(form) if len(self.keys) else 0, _PIECE):
            g = grams(form[begin : begin + _PIECE + _SPAN])
            near = np.flatnonzero(self.seen[(mix(g) & np.uint64(0xFFFFF)).astype(np.int64)])
            if not len(near):
                continue
            spot = np.minimum(np.searchsorted(self.keys, g[near]), len(self.keys) - 1)
            same = self.keys[spot] == g[near]
            at, spot = near[same] + begin, spot[same]
            row = np.searchsorted(bounds, at, "right") - 1
            whole = at + Q <= bounds[row + 1]
            if whole.any():
                yield from self._bands(at[whole], spot[whole], row[whole], 0, len(self.text))

    def _bands(self, at: np.ndarray, spot: np.ndarray, row: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """:meth:`_candidates` among places ``at`` for the windows from ``low`` to ``high``, at most about ``HITS`` hits at a time."""
        windows = len(self.text)
        begin, end = (np.searchsorted(self.code, spot * windows + w) for w in (low, high)) if (low, high) != (0, windows) else (self.first[spot], self.first[spot + 1])
        m = end - begin
        if m.sum() > HITS:
            if at[-1] - at[0] > 4 * _SPAN:
                middle = (at[0] + at[-1]) // 2
                a, b = np.searchsorted(at, middle + _SPAN), np.searchsorted(at, middle)
                yield from self._bands(at[:a], spot[:a], row[:a], low, high)
                yield from self._bands(at[b:], spot[b:], row[b:], low, high)
                return
            if high - low > 1:
                middle = (low + high) // 2
                yield from self._bands(at, spot, row, low, middle)
                yield from self._bands(at, spot, row, middle, high)
                return
        if not m.sum():
            return
        posting = np.repeat(begin, m) + np.arange(int(m.sum())) - np.repeat(np.concatenate(([0], np.cumsum(m)[:-1])), m)
        place, pattern, hit_row = np.repeat(at, m), self.code[posting] % windows, np.repeat(row, m)
        # A match lies within two neighbouring blocks of text, so hits of poorer neighbourhoods go first. Blocks share
        # the cells of a table, which can only raise a count.
        block = pattern * (int(at[-1]) // _BLOCK + 3) + place // _BLOCK + 1
        cell = [(mix((block + d).astype(np.uint64)) & np.uint64(_CELLS - 1)).astype(np.int64) for d in (-1, 0, 1)]
        cells = np.bincount(cell[1], minlength=_CELLS)
        good = cells[cell[1]] + np.maximum(cells[cell[0]], cells[cell[2]]) >= self.need[pattern]
        place, pattern, hit_row = place[good], pattern[good], hit_row[good]
        if not len(place):
            return
        diagonal = place - self.place[posting[good]]
        band = diagonal // _STEP
        least = int(band.min()) - 1
        width = int(band.max()) - least + 1
        code = (hit_row * windows + pattern) * width + band - least
        flat, count = np.unique(np.concatenate([code, code - 1]), return_counts=True)
        pattern_of = flat // width % windows
        enough = count >= self.need[pattern_of]
        flat, pattern_of = flat[enough], pattern_of[enough]
        if len(flat):
            yield flat // width // windows, pattern_of, (flat % width + least) * _STEP

    def _aligned(self, form, bounds, row, pattern, diagonal) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, window, start, stop, edits) of candidates that align inside their band with few enough edits; places are in ``form``."""
        slack = int(self.edits.max())
        width = 2 * _STEP + 2 * slack + 1
        # A window that stands there byte for byte needs no alignment.
        rest = []
        for k, (r, p, base) in enumerate(zip(row.tolist(), pattern.tolist(), (diagonal - slack).tolist(), strict=True)):
            first, window = max(base, int(bounds[r])), self.text[p]
            at = form[first : max(first, min(base + width + len(window) - 1, int(bounds[r + 1])))].tobytes().find(window)
            if at < 0:
                rest.append(k)
            else:
                yield r, p, first + at, first + at + len(window), 0
        row, pattern, diagonal = row[rest], pattern[rest], diagonal[rest]
        for a in range(0, len(row), 512):
            r, p = row[a : a + 512], pattern[a : a + 512]
            base = diagonal[a : a + 512] - slack
            length = self.length[p]
            most = int(length.max())
            text = np.full((len(r), most), 1, np.uint8)
            for i, k in enumerate(p):
                text[i, : length[i]] = np.frombuffer(self.text[k], np.uint8)
            # The texts around the candidates, 0 (no byte of a normal form) outside of their rows.
            at = base[:, None] + np.arange(most + width)
            around = np.where((at >= bounds[r][:, None]) & (at < bounds[r + 1][:, None]), form[np.clip(at, 0, len(form) - 1)], np.uint8(0))
            # Cell (i, j): the window's first i bytes against text that ends at base + i + j.
            column = np.arange(width, dtype=np.int32)
            far = np.int32(1 << 20)
            cost = np.zeros((len(r), width), np.int32)
            origin_at = np.broadcast_to(column, cost.shape).copy()  # where the aligned text begins, minus base
            done_cost, done_stop, done_start = np.full(len(r), 1 << 30), np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            live = np.arange(len(r))  # no cell of a row falls below the least one before, so rows beyond their edits go
            for i in range(most):
                if i % 8 == 7:
                    near = np.flatnonzero((cost.min(axis=1) <= self.edits[p[live]]) & (length[live] > i))
                    if len(near) < 0.9 * len(live):
                        live, cost, origin_at, around, text = live[near], cost[near], origin_at[near], around[near], text[near]
                    if not len(live):
                        break
                other = around[:, i : i + width]
                step = np.where(other != 0, cost + (other != text[:, i : i + 1]), far)
                drop = np.full_like(cost, far)
                drop[:, :-1] = cost[:, 1:] + 1  # a byte of the window that the text lacks
                start = origin_at.copy()
                np.copyto(start[:, :-1], origin_at[:, 1:], where=step[:, :-1] > drop[:, :-1])
                # A byte of the text that the window lacks: the best cell to the left plus the way.
                run = np.minimum.accumulate((np.minimum(step, drop) - column) * 256 + column, axis=1)
                cost = (run >> 8) + column
                origin_at = np.take_along_axis(start, run & 255, axis=1)
                here = np.flatnonzero(length[live] == i + 1)
                if len(here):
                    ended, j = live[here], cost[here].argmin(axis=1)
                    done_cost[ended] = cost[here, j]
                    done_stop[ended] = base[ended] + i + j + 1
                    done_start[ended] = base[ended] + origin_at[here, j]
            for i in np.flatnonzero(done_cost <= self.edits[p]):
                begin, stop = max(int(done_start[i]), int(bounds[r[i]])), min(int(done_stop[i]), int(bounds[r[i] + 1]))
                if stop > begin:
                    yield int(r[i]), int(p[i]), begin, stop, int(done_cost[i])


LEAKS = "array<struct<item_id:long,start:long,stop:long,edits:long>>"
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64())]))


def best_apart(found: set[tuple]) -> list[dict]:
    """Of some (edits, start, stop, item) those that overlap no better one of their item, as leaks in order of item and place."""
    kept: dict = {}
    for edits, start, stop, item in sorted(found, key=lambda x: x[:3]):
        own = kept.setdefault(item, [])
        i = bisect_left(own, (start, stop))
        if (i == 0 or own[i - 1][1] <= start) and (i == len(own) or own[i][0] >= stop):
            own.insert(i, (start, stop, edits))
    return [{"item_id": k, "start": a, "stop": b, "edits": e} for k in sorted(kept, key=lambda x: (x is None, x)) for a, b, e in kept[k]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``leaks``: the benchmark windows found in the row's text.

    Each leak has the item's id, the place in the text as UTF-8 bytes and the number of edits; of windows
    found at overlapping places of one item the best counts, and items that share a window are all named.
    An excerpt of ``WINDOW`` + ``STRIDE`` - 1 bytes of normal form holds a whole window and is surely found,
    as is a whole item of ``Q`` to ``WINDOW`` bytes. A null or empty text has none. Items that are null or whose
    normal form is shorter than ``Q`` bytes are too short to look for. Rows are handled one by one, so
    repeated rows, null keys and empty tables need no care; a column ``leaks`` is replaced. Every benchmark
    item is used: a benchmark of more than ``PASS_BYTES`` is dealt to parts of about that size by hash, and the
    documents are written with what each part found before the next one is broadcast.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "leaks"]
    at = kept.index(text)
    usable = benchmark.where("text is not null").select("item_id", "text")
    size = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PASS_BYTES) or 1
    found = docs.select(*[F.col(f"`{c}`") for c in kept])
    for part in range(parts):
        chosen = usable if parts == 1 else usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        patterns = spark.sparkContext.broadcast(Patterns([(r[0], r[1]) for r in chosen.distinct().collect()]))

        def run(batches, patterns=patterns):
            for batch in batches:
                offsets, data = utf8(batch.column(at))
                leaks: list[set[tuple]] = [set() for _ in range(batch.num_rows)]
                for a, b in slices(offsets):
                    for row, item, start, stop, edits in patterns.value.matches(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]):
                        shift = int(offsets[a + row] - offsets[a])
                        leaks[a + row].add((edits, start - shift, stop - shift, item))
                value = pa.array([best_apart(x) for x in leaks], _LEAKS)
                yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, f"__leaks{part}"])

        schema = "".join(f"`{c}` {t}, " for c, t in found.dtypes) + f"__leaks{part} {LEAKS}"
        found = found.mapInArrow(run, schema)
        if part < parts - 1:
            found = written(found, "leaks")
            patterns.destroy()
    return found.select(*[F.col(f"`{c}`") for c in kept], F.concat(*[F.col(f"__leaks{i}") for i in range(parts)]).alias("leaks"))
