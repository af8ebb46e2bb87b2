"""Arrow helpers for what is looked up word by word: a dictionary a row, in batches, linear in the text.

Spark's maps are searched entry by entry, which is quadratic for long texts. Finding segments, names, roles,
rules and secrets stays with Spark's functions; these helpers number the distinct names of a row and put
texts together.
"""

import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .grammar import NUMBERED, ROLE_BASES, ROLE_PRIORITY

_WORDS = re.compile("([A-Za-z0-9_$]+)").split
_NUMBERED = re.compile(NUMBERED.replace(r"\z", r"\Z"), re.ASCII).match
BASES = {str(p): ROLE_BASES[role] for role, p in ROLE_PRIORITY.items()}
LARGEST = (1 << 63) - 1
_LETTER = re.compile("[A-Za-z0-9_$]")
#: Rows whose values are Python objects at a time.
AT_ONCE = 32
#: Bytes of rows that go to a Python worker at a time, unless the session says otherwise. A worker and the executor
#: hold a batch and what is made of it, some of it twice.
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Automata that a worker keeps, by their terms.
KEPT_AUTOMATA = 8


def base_and_number(placeholder: str) -> tuple[str, int] | None:
    """The base and the number of a numbered placeholder whose number is a long."""
    found = _NUMBERED(placeholder)
    return (found[1], int(found[2])) if found and int(found[2]) <= LARGEST else None


def number_names(found: list[str], known: list[tuple[str, str]], held: list[str], bases: list[str | None] | None) -> tuple[list[str], list[str], int]:
    """(names, their placeholders, how many of them are new): new ones by length and first place, then known ones.

    ``found`` has a name behind the digit of a role for each of its roles, by first place; ``known`` is
    (placeholder, name) with later ones going first; ``bases`` has an own base for a name, or "" if it stays.
    """
    roles: dict[str, str] = {}
    own: dict[str, str | None] = {}
    for i, x in enumerate(found):
        name, role = x[1:], x[0]
        if roles.get(name, "") < role:
            roles[name] = role
        if bases:
            own[name] = bases[i]
    mapped = {n: p for p, n in known}
    last: dict[str, int] = {}
    for p in (*held, *(p for p, _ in known)):
        if numbered := base_and_number(p):
            last[numbered[0]] = max(last.get(numbered[0], 0), numbered[1])
    names = sorted((n for n in roles if n not in mapped and own.get(n) != ""), key=len, reverse=True)
    out = []
    for n in names:
        base = own.get(n) or BASES[roles[n]]
        last[base] = last.get(base, 0) + 1
        out.append(f"{base}{last[base]}")
    again = [n for n in roles if n in mapped]
    return names + again, out + [mapped[n] for n in again], len(names)


def small_batches(spark: SparkSession) -> None:
    """Lets batches of whole texts be of ``BATCH_BYTES``, in a session that has its default for them."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def settled(column: Column) -> Column:
    """A column that stays one of its own: no expression is written across a generator, here of one row, into what uses it."""
    return F.explode(F.array(column))


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of some columns as Python values, ``AT_ONCE`` at a time: a batch may hold thousands of long texts."""
    for at in range(0, len(columns[0]), AT_ONCE):
        yield from zip(*(c.slice(at, AT_ONCE).to_pylist() for c in columns), strict=True)


def _gathered(values: Iterator, kind: pa.DataType) -> pa.Array:
    """Values as an array, of which only ``AT_ONCE`` are Python objects at a time."""
    parts = []
    while held := list(islice(values, AT_ONCE)):
        parts.append(pa.array(held, kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_ENTRY = pa.struct([("placeholder", pa.string()), ("name", pa.string()), ("ord", pa.int32())])
_MADE = pa.struct([("text", pa.string()), ("entries", pa.list_(_ENTRY))])
_BASE_OF = pa.array([BASES[str(p)] for p in range(len(BASES))])


def _lists(counts: np.ndarray, *fields: pa.Array) -> pa.ListArray:
    """Lists of that many entries each, from the fields of :data:`_ENTRY`."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields), fields=list(_ENTRY)))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def number_batch(found: pa.ListArray, bases: pa.Array | None = None) -> pa.ListArray:
    """The new entries of :func:`number_names` for rows that carry no entry and hold no placeholder, all rows at once.

    Names are told apart by their codes in the batch; sorting whole numbers does what dictionaries and lists do there.
    """
    rows = len(found)
    flat = found.flatten()
    row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    role = pc.utf8_slice_codeunits(flat, 0, 1).cast(pa.int8()).to_numpy(zero_copy_only=False)
    names = pc.utf8_slice_codeunits(flat, 1)
    code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = row * (code.max(initial=0) + 1) + code
    order = np.argsort(key, kind="stable")
    starts = _runs(key[order])
    # Sorting is stable, so the first of a run is the name's first place.
    first = order[starts]
    strongest = np.maximum.reduceat(role[order], starts) if len(starts) else role
    by_place = np.argsort(first)
    first, strongest = first[by_place], strongest[by_place]
    base = _BASE_OF.take(pa.array(strongest.astype(np.int64)))
    if bases is not None:
        own = bases.flatten().take(pa.array(first))
        base, kept = pc.coalesce(own, base), pc.fill_null(pc.not_equal(own, ""), True).to_numpy(zero_copy_only=False)
        first, base = first[kept], base.filter(pa.array(kept))
    size = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[first]
    longest = size.max(initial=0) + 1
    order = np.argsort(row[first] * longest + longest - 1 - size, kind="stable")
    first, base = first[order], base.take(pa.array(order)).dictionary_encode()
    of = row[first]
    group = of * max(len(base.dictionary), 1) + base.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(group, kind="stable")
    starts = _runs(group[order])
    number = np.empty(len(group), np.int64)
    number[order] = 1 + np.arange(len(group)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(group)]])))
    placeholders = pc.binary_join_element_wise(base.dictionary_decode(), pc.cast(pa.array(number), pa.string()), "")
    counts = np.bincount(of, minlength=rows)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    return _lists(counts, placeholders, names.take(pa.array(first)), pa.array(place.astype(np.int32)))


def _strings(values: pa.Array) -> list:
    """Strings as Python objects; an array's own way makes an object of its own for each of them before."""
    return values.to_numpy(zero_copy_only=False).tolist()


def _numbered(found: pa.Array, placeholders: pa.Array, names: pa.Array, held: pa.Array, bases: pa.Array | None) -> tuple[pa.ListArray, dict[int, tuple[list[str], list[str]]]]:
    """(the new entries of each row, all (names, placeholders) of the rows that carry entries or hold placeholders)."""
    size = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    special = (size(placeholders) > 0) | (size(held) > 0)
    plain = pa.array(~special)
    made = number_batch(found.filter(plain), None if bases is None else bases.filter(plain))
    if not special.any():
        return made, {}
    at, whole, counts, fresh_names, fresh = np.flatnonzero(special), {}, [], [], []
    for i, (f, p, n, h, *b) in zip(at.tolist(), _rows(*(c.take(pa.array(at)) for c in (found, placeholders, names, held, *([] if bases is None else [bases])))), strict=True):
        all_names, others, new = number_names(f or [], list(zip(p or [], n or [], strict=True)), h or [], b[0] if b else None)
        whole[i] = (all_names, others)
        counts.append(new)
        fresh_names += all_names[:new]
        fresh += others[:new]
    place = [j for n in counts for j in range(n)]
    one_by_one = _lists(np.array(counts), pa.array(fresh, pa.string()), pa.array(fresh_names, pa.string()), pa.array(place, pa.int32()))
    where = np.empty(len(special), np.int64)
    where[~special], where[special] = np.arange(len(made)), len(made) + np.arange(len(at))
    return pa.concat_arrays([made, one_by_one]).take(pa.array(where)), whole


def numbered(found: Column, known: Column, held: Column, bases: Column | None = None, segments: Column | None = None, stays: Column | None = None) -> Column:
    """struct(text, entries): the new names of :func:`number_names` as entries from 0 on, and the segments put together with all names swapped.

    ``known`` are entries in any order. Without ``segments`` the text is null and no text goes to Python. Numbering
    and swapping are one step, so a task has one Python worker and the names go there once.
    """

    with_bases, with_texts = bases is not None, segments is not None

    @F.arrow_udf("struct<text:string,entries:array<struct<placeholder:string,name:string,ord:int>>>")
    def run(found: pa.Array, placeholders: pa.Array, names: pa.Array, held: pa.Array, *more: pa.Array) -> pa.Array:
        given = iter(more)
        entries, whole = _numbered(found, placeholders, names, held, next(given) if with_bases else None)
        if not with_texts:
            return pa.StructArray.from_arrays([pa.nulls(len(entries), pa.string()), entries], fields=list(_MADE))

        def texts() -> Iterator[str | None]:
            for i, (segs, keep) in enumerate(_rows(*given)):
                if i in whole:
                    yield _swapped(segs, keep, *whole[i])
                else:
                    of = entries[i].values
                    yield _swapped(segs, keep, _strings(of.field("name")), _strings(of.field("placeholder")))

        return pa.StructArray.from_arrays([_gathered(texts(), pa.string()), entries], fields=list(_MADE))

    ordered = F.array_sort(F.transform(known, lambda e: F.struct(e["ord"].alias("ord"), e["placeholder"].alias("placeholder"), e["name"].alias("name"))))
    given = [c for c in (bases, segments, stays) if c is not None]
    # Told to be nondeterministic, it is computed once and not inlined into each place that uses a field of it.
    return run.asNondeterministic()(found, F.transform(ordered, lambda e: e["placeholder"]), F.transform(ordered, lambda e: e["name"]), held, *given)


class _Swap(dict):
    """What stands for a piece of text between spaces: told once by its words, then looked up."""

    def __init__(self, names: list[str], others: list[str]):
        super().__init__(zip(names, others, strict=True))
        self.word = dict(self).get

    def __missing__(self, piece: str) -> str:
        self[piece] = out = "".join([self.word(w, w) for w in _WORDS(piece)])
        return out


def _swapped(segments: list[str] | None, keep: list[bool], names: list[str], others: list[str]) -> str | None:
    """Segments put together with whole words swapped, but for those that stay."""
    if segments is None:
        return None
    if not names:
        return "".join(segments)
    # A space is no part of a word, so what stands between spaces is swapped by itself.
    swap = _Swap(names, others).__getitem__
    return "".join([s if k else " ".join(map(swap, s.split(" "))) for s, k in zip(segments, keep, strict=True)])


def swap_words(segments: Column | str, stays: Column | str, names: Column | str, others: Column | str) -> Column:
    """Segments put together with whole words swapped, but for segments that stay as they are."""

    @F.arrow_udf(StringType())
    def run(segments: pa.Array, stays: pa.Array, names: pa.Array, others: pa.Array) -> pa.Array:
        return _gathered((_swapped(s, k, n or [], o or []) for s, k, n, o in _rows(segments, stays, names, others)), pa.string())

    return run(segments, stays, names, others)


class Finder:
    """Finds terms in texts: at each place from the left the longest one, in one pass whatever their number.

    An Aho-Corasick automaton over the terms; the terms that end inside a longer one at the same place are
    told by their lengths, so what is found is what trying all terms at each place, longest first, would find.
    """

    def __init__(self, terms: list[str]):
        import ahocorasick

        self._found = ahocorasick.Automaton()
        for t in terms:
            if t:
                self._found.add_word(t, len(t))
        self._empty = not len(self._found)
        if not self._empty:
            self._found.make_automaton()

    def longest(self, text: str, strict: bool = False) -> dict[int, int]:
        """Where the longest term from each place that a term begins at stops; ``strict``: between characters of no word."""
        out: dict[int, int] = {}
        for end, size in () if self._empty else self._found.iter(text):
            start, stop = end + 1 - size, end + 1
            if strict and (start and _LETTER.match(text[start - 1]) or stop < len(text) and _LETTER.match(text[stop])):
                continue
            if stop > out.get(start, 0):
                out[start] = stop
        return out


_finders: OrderedDict[tuple[str, ...], Finder] = OrderedDict()


def finder(terms: list[str]) -> Finder:
    """The finder for some terms; a worker keeps the last few, as rows with one map often follow one another."""
    key = tuple(terms)
    if key in _finders:
        _finders.move_to_end(key)
    else:
        _finders[key] = Finder(terms)
        if len(_finders) > KEPT_AUTOMATA:
            _finders.popitem(last=False)
    return _finders[key]


def swapped_terms(text: str, terms: list[str], others: list[str], strict: bool = False, around: re.Pattern | None = None) -> tuple[str, list[str]]:
    """(text with terms swapped from the left, the longest at each place; the distinct terms found, in order).

    A match of ``around`` at a place goes before all terms and is left as it is.
    """
    swap, found = dict(zip(terms, others, strict=True)), finder(terms).longest(text, strict)
    fixed = dict(m.span() for m in around.finditer(text)) if around else {}
    out, at, seen = [], 0, {}
    for start in sorted(found.keys() | fixed.keys()):
        if start < at:
            continue
        stop = fixed.get(start) or found[start]
        if start not in fixed:
            term = text[start:stop]
            seen[term] = None
            out += [text[at:start], swap[term]]
            at = stop
        else:
            out.append(text[at:stop])
            at = stop
    out.append(text[at:])
    return "".join(out), list(seen)


@cache
def _compiled(pattern: str | None) -> re.Pattern | None:
    return re.compile(pattern, re.ASCII) if pattern else None


def swap_terms(text: Column, terms: Column, others: Column, strict: bool = False, around: str | None = None) -> Column:
    """struct(text, found): a text with terms swapped for others, longest first in one pass, and the terms that were found.

    ``terms`` and ``others`` are arrays of strings; of equal terms the last counts. A null text stays null.
    """

    @F.arrow_udf("struct<text:string,found:array<string>>")
    def run(text: pa.Array, terms: pa.Array, others: pa.Array) -> pa.Array:
        def swapped() -> Iterator[dict]:
            for t, a, b in _rows(text, terms, others):
                done, found = (t, []) if t is None or not a else swapped_terms(t, a, b, strict, _compiled(around))
                yield {"text": done, "found": found}

        return _gathered(swapped(), pa.struct([("text", pa.string()), ("found", pa.list_(pa.string()))]))

    return run.asNondeterministic()(text, terms, others)


def mark_terms(text: Column, terms: Column, known: Column, around: str) -> Column:
    """A text with terms swapped for the placeholders that they have in ``known``, the last entry of a name going first.

    The longest term at each place counts, in one pass; a match of ``around`` is left as it is.
    """

    @F.arrow_udf(StringType())
    def run(text: pa.Array, terms: pa.Array, placeholders: pa.Array, names: pa.Array) -> pa.Array:
        out = []
        for t, wanted, p, n in _rows(text, terms, placeholders, names):
            if t and wanted:
                held = dict(zip(n or [], p or [], strict=True))
                t, _ = swapped_terms(t, wanted, [held.get(x, x) for x in wanted], around=_compiled(around))
            out.append(t)
        return pa.array(out, pa.string())

    return run.asNondeterministic()(text, terms, F.transform(known, lambda e: e["placeholder"]), F.transform(known, lambda e: e["name"]))
