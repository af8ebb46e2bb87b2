"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection.

Documents are sets of word shingles. Equal sets are joined to one representative first. Two sets with
Jaccard similarity of at least t must share one of their first |x| - ceil(t|x|) + 1 elements in any common
order of elements; here rare shingles come first, by a fixed-size table of counts of all shingles, so that
passages many documents share stay out of the tiles. Each representative is dealt to the tile of every
such element. A tile is walked in order of set size, and only sets within the size band of t are
paired; pairs already known to be connected are left out. What is left meets in three steps that only ever
remove pairs which cannot reach t: the places of the shared element bound the overlap from above, then the
bit counts of hashed bitmaps do, then the sorted arrays of shingle hashes are intersected exactly.

A first round pairs documents that agree in one of a few minima of their shingle hashes. Its pairs are
held to the size band, bounded by their bitmaps and intersected exactly like all others; the groups of
near copies it connects need no pairs in the tiles afterwards.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import bucketed, written
from .textkit import mix, shingle_sets, word_batches

SHINGLE = 5
THRESHOLD = 0.8
#: Cells of the table of shingle counts; it orders elements and bounds no result.
COUNT_BITS = 20
_CHUNK = 1 << 12
MINIMA = 4
#: Postings of one element in one tile at about most; elements with more are dealt to pairs of blocks.
TILE = 2048
BITS_PER_ELEMENT = 4
TILE_ROW = "element long, i int, j int, block int, gid long, n long, at int"


def _need(t100: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest overlap with which sets of sizes a and b reach the threshold."""
    return -(-t100 * (a + b) // (100 + t100))


def _prefix(t100: int, n: int) -> int:
    return n - -(-t100 * n // 100) + 1


def shingle_counts(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """How often shingles fall into each of 2^``COUNT_BITS`` cells, capped at 2^32 - 1; the driver gets that table alone."""

    def count(batches):
        cells = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for _, _, words in word_batches(batch.column(0)):
                own = list(shingle_sets(words, k))
                if own:
                    cells += np.bincount((np.concatenate(own) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS).astype(np.uint32)
        part = int(np.random.default_rng().integers(64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells) // _CHUNK, dtype=np.int32)), pa.array(np.full(len(cells) // _CHUNK, part, np.int32)), pa.array([c.tobytes() for c in cells.reshape(-1, _CHUNK)], pa.binary())], names=["chunk", "part", "cells"])

    def add(table):
        total = np.zeros(_CHUNK, np.uint64)
        for value in table["cells"]:
            total += np.frombuffer(value.as_buffer(), np.uint32)
        cells = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pa.table({"chunk": table["chunk"].slice(0, 1), "part": pa.array([0], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    schema = "chunk int, part int, cells binary"
    counted = docs.mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema)
    rows = counted.groupBy("chunk").applyInArrow(add, schema).toArrow()
    out = np.zeros((1 << COUNT_BITS) // _CHUNK * _CHUNK, np.uint32).reshape(-1, _CHUNK)
    for chunk, value in zip(rows["chunk"].to_pylist(), rows["cells"].to_pylist(), strict=True):
        out[chunk] = np.frombuffer(value, np.uint32)
    return out.reshape(-1)


def shingle_sizes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(key, text_key, n, set_key, minima) of (key, text): a digest of the text, the size of its set, a 128-bit digest and a few minima of it."""

    def run(batches):
        for batch in batches:
            n, keys, minima = [], [], []
            for _, _, words in word_batches(batch.column(2)):
                for own in shingle_sets(words, k):
                    n.append(len(own))
                    keys.append(np.array([mix(own).sum(), mix(own ^ np.uint64(0x9E3779B97F4A7C15)).sum()]).tobytes() if len(own) else None)
                    minima.append([int(mix(own * np.uint64(2 * j + 3)).min().view(np.int64)) for j in range(MINIMA)] if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.list_(pa.int64()))], names=["key", "text_key", "n", "set_key", "minima"])

    return docs.select("key", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "key long, text_key long, n long, set_key binary, minima array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, t100: int) -> DataFrame:
    """Those pairs (a, b) of sets that do reach the threshold; ``texts`` (gid, text) is bucketed by gid and does not move."""

    def exact(batches):
        for batch in batches:
            keep = []
            for a in range(0, batch.num_rows, 512):
                left, right = ([s for _, _, w in word_batches(batch.column(i).slice(a, 512)) for s in shingle_sets(w, k)] for i in (2, 3))
                for x, y in zip(left, right, strict=True):
                    least = int(_need(t100, len(x), len(y)))
                    keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= least)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    first = pairs.select("a", "b").join(texts.select(F.col("gid").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("gid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(exact, "a long, b long")


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each hash, in as many bits, a power of two, as the size band of the set asks for."""
    bits = 64
    while bits < BITS_PER_ELEMENT * len(hashes):
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags)


def _differing_bits(bitmaps: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ between the bitmaps of each pair, the wider of two folded to the width of the other.

    Each differing bit stands for an element that only one of two sets has, so sets of sizes a and b with d
    of them share (a + b - d) / 2 elements at most.
    """
    width = np.array([len(b) for b in bitmaps])
    common = np.minimum(width[x], width[y])
    out = np.empty(len(x), np.int64)
    for w in np.unique(common):
        chosen = np.flatnonzero(common == w)
        rows = np.unique(np.concatenate([x[chosen], y[chosen]]))
        folded = np.stack([np.bitwise_or.reduce(np.frombuffer(bitmaps[r], np.uint8).reshape(-1, w), axis=0) for r in rows])
        for c in range(0, len(chosen), 1 << 16):
            part = chosen[c : c + (1 << 16)]
            out[part] = np.bitwise_count(folded[np.searchsorted(rows, x[part])] ^ folded[np.searchsorted(rows, y[part])]).sum(axis=1)
    return out


def _bitmaps(texts: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(gid, n, bitmap) of the sets in ``rows``."""

    def run(batches):
        for batch in batches:
            made = [_bitmap(own).tobytes() for _, _, words in word_batches(batch.column(2)) for own in shingle_sets(words, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["gid", "n", "bitmap"])

    chosen = texts.select("gid", "n", "text").join(rows.select("gid").distinct(), "gid", "left_semi")
    return chosen.mapInArrow(run, "gid long, n long, bitmap binary")


def _bounded(pairs: DataFrame, bitmaps: DataFrame, t100: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            maps, rows = batch.column(4).to_pylist() + batch.column(5).to_pylist(), np.arange(batch.num_rows)
            close = pa.array((na + nb - _differing_bits(maps, rows, rows + batch.num_rows)) // 2 >= _need(t100, na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(close), batch.column(1).filter(close)], names=["a", "b"])

    side = lambda x: bitmaps.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long")


def _stars(groups: DataFrame, t100: int) -> DataFrame:
    """Pairs (a, b) of sets that share a minimum: a two-level star for each minimum, so no set gets more than about 2 sqrt(members) pairs from one."""
    flat = groups.select("gid", "n", F.posexplode("minima").alias("j", "m"))
    sizes = flat.groupBy("j", "m").agg(F.count("*").alias("c")).where("c > 1")
    flat = flat.join(sizes, ["j", "m"]).withColumn("block", F.pmod(F.xxhash64("gid"), F.ceil(F.sqrt("c"))))
    hub = flat.groupBy("j", "m", "block").agg(F.min(F.struct("gid", "n")).alias("hub"))
    top = hub.groupBy("j", "m").agg(F.min("hub").alias("top"))
    low = flat.join(hub, ["j", "m", "block"]).select(F.col("hub.gid").alias("a"), F.col("hub.n").alias("na"), F.col("gid").alias("b"), F.col("n").alias("nb"))
    high = hub.join(top, ["j", "m"]).select(F.col("top.gid").alias("a"), F.col("top.n").alias("na"), F.col("hub.gid").alias("b"), F.col("hub.n").alias("nb"))
    both = low.unionByName(high).where("a <> b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * t100)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _postings(reps: DataFrame, counts, k: int, t100: int) -> DataFrame:
    """(element, i, j, block, gid, n, at, comp): each set at its first elements, rare ones first."""

    def run(batches):
        cells = counts.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            gids = batch.column(0).to_numpy().astype(np.uint64)
            row = 0
            for _, _, words in word_batches(batch.column(3)):
                for own in shingle_sets(words, k):
                    if len(own):
                        often = cells[(own >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                        most = _prefix(t100, len(own))
                        if most < len(own):
                            cut = np.partition(often, most - 1)[most - 1]
                            few = np.flatnonzero(often <= cut)
                        else:
                            few = np.arange(len(own))
                        few = few[np.lexsort((own[few], often[few]))][:most]
                        out[0].append(own[few])
                        out[1].append(np.arange(len(few)))
                        out[2].append(np.full(len(few), row))
                        out[3].append(often[few])
                    row += 1
            if not out[0]:
                continue
            element, at, who, often = map(np.concatenate, out)
            blocks = np.maximum(1, -(-often.astype(np.int64) // TILE))
            blocks = np.where(often > 4 * TILE, blocks, 1)
            own_block = (mix(gids[who]) % blocks.astype(np.uint64)).astype(np.int64)
            times = blocks
            source = np.repeat(np.arange(len(element)), times)
            other = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            i, j = np.minimum(own_block[source], other), np.maximum(own_block[source], other)
            for a in range(0, len(source), 100_000):
                s = source[a : a + 100_000]
                w = pa.array(who[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(element[s].view(np.int64)), pa.array(i[a : a + len(s)].astype(np.int32)), pa.array(j[a : a + len(s)].astype(np.int32)), pa.array(own_block[s].astype(np.int32)), batch.column(0).take(w), batch.column(1).take(w), pa.array(at[s].astype(np.int32)), batch.column(2).take(w)],
                    names=["element", "i", "j", "block", "gid", "n", "at", "comp"],
                )

    return reps.select("gid", "n", "comp", "text").mapInArrow(run, "element long, i int, j int, block int, gid long, n long, at int, comp long")


def _by_tile(postings: DataFrame, each, schema: str) -> DataFrame:
    """What ``each`` makes of whole tiles, given as a table sorted by tile and size and the first rows of its tiles."""
    dealt = postings.repartition("element", "i", "j").sortWithinPartitions("element", "i", "j", "n")

    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table]).combine_chunks()
            e, i, j = (table[c].to_numpy() for c in ("element", "i", "j"))
            new = (e[1:] != e[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            heads = np.concatenate(([0], np.flatnonzero(new) + 1))
            if len(heads) > 1:
                yield from each(table.slice(0, int(heads[-1])), heads)
            left = table.slice(int(heads[-1]))
        if left is not None and left.num_rows:
            yield from each(left, np.array([0, left.num_rows]))

    return dealt.mapInArrow(run, schema)


def _mixed(table: pa.Table, heads: np.ndarray):
    """The rows of tiles that hold sets of different components."""
    comp = table["comp"].to_numpy()
    mixed = np.minimum.reduceat(comp, heads[:-1]) != np.maximum.reduceat(comp, heads[:-1])
    keep = np.repeat(mixed, np.diff(heads))
    if keep.any():
        yield from table.drop_columns(["comp"]).filter(pa.array(keep)).to_batches()


def _pairs_around(t100: int):
    """One pair for each row of a tile: with a row of another component so many places on, around the end, as the tile's hash says."""

    def each(table: pa.Table, heads: np.ndarray):
        gid, n, comp, element = (table[c].to_numpy() for c in ("gid", "n", "comp", "element"))
        length = np.diff(heads)
        many, head = np.repeat(length, length), np.repeat(heads[:-1], length)
        x = np.flatnonzero(many > 1)
        away = 1 + (mix(element[x].astype(np.uint64)) % np.minimum(many[x] - 1, 256).astype(np.uint64)).astype(np.int64)
        y = head[x] + (x - head[x] + away) % many[x]
        good = (comp[x] != comp[y]) & (np.maximum(n[x], n[y]) * t100 <= np.minimum(n[x], n[y]) * 100)
        if good.any():
            a, b = gid[x[good]], gid[y[good]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return each


def _pairs_within(t100: int):
    """Pairs of different components that a tile cannot rule out."""

    def each(table: pa.Table, heads: np.ndarray):
        gid, n, at, comp, block, i, j = (table[c].to_numpy() for c in ("gid", "n", "at", "comp", "block", "i", "j"))
        length = np.diff(heads)
        bitmaps = table["bitmap"].to_pylist()
        mixed = np.minimum.reduceat(comp, heads[:-1]) != np.maximum.reduceat(comp, heads[:-1])
        stop = np.repeat(heads[1:], length)
        x = np.flatnonzero(np.repeat(mixed, length))
        step = 0
        while len(x):  # each row with the row ``step`` behind it, as long as that is in its tile and size band
            step += 1
            x = x[x + step < stop[x]]
            x = x[n[x + step] * t100 <= n[x] * 100]
            y = x + step
            good = (comp[x] != comp[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
            good &= np.minimum(n[x] - at[x], n[y] - at[y]) >= _need(t100, n[x], n[y])
            u, v = x[good], y[good]
            close = (n[u] + n[v] - _differing_bits(bitmaps, u, v)) // 2 >= _need(t100, n[u], n[v])
            if close.any():
                a, b = gid[u[close]], gid[v[close]]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return each


def _with_components(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` (gid, ...) with the component of each set, its own gid where it has no link."""
    return rows.join(joined, rows["gid"] == joined["node"], "left").withColumn("comp", F.coalesce("component", "gid")).drop("node", "component")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``; the component is the smallest key reachable by links.

    Two documents link when the Jaccard similarity of their shingle sets is at least ``threshold``; no link
    is missed. Null and empty texts and texts without a word have no shingles and link with nothing; they
    and rows with a null key that have no neighbour keep their own key. The key is an integer. Rows that
    repeat a key are documents of their own; with equal texts they are in one component anyway. Other
    columns of ``docs`` are left out. Set elements are 64-bit hashes of shingles.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    placed, sized = _placed_sets(docs, k, round(threshold * 100))
    least = placed.groupBy("comp").agg(F.min("key").alias("component_id"))
    by_set = placed.join(least, "comp").select("set_key", "n", "component_id")
    out = sized.join(by_set, ["set_key", "n"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked documents that with the smallest key stays.

    Documents without shingles all stay. A null key counts as larger than any other; of documents that agree
    in key the one with the smaller text digest stays, and of rows that agree in key and text one.
    """
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    placed, sized = _placed_sets(plain, k, round(threshold * 100))
    marked = sized.where("n > 0").join(placed.select("set_key", "n", "comp"), ["set_key", "n"])
    stays = marked.groupBy("comp").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "text_key")).alias("w"))
    stays = stays.select(F.col("w.key").alias("__k"), F.col("w.text_key").alias("__t"))
    # All texts without shingles have this digest of theirs, so they are told by it.
    empty = sized.where("n = 0").select(F.col("key").alias("__k"), F.col("text_key").alias("__t")).distinct()
    repeated = not sized.where("n > 0").groupBy("key", "text_key").count().where("count > 1").isEmpty()
    keyed = docs.withColumn("__text_key", F.xxhash64(F.col(f"`{text}`")))
    match = F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__k")) & (F.col("__text_key") == F.col("__t"))
    out = keyed.join(stays.unionByName(empty), match, "left_semi")
    if repeated:
        blank = ~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        out = out.where(blank).unionByName(out.where(~blank).dropDuplicates([key, "__text_key"]))
    return out.drop("__text_key")


def _placed_sets(docs: DataFrame, k: int, t100: int) -> tuple[DataFrame, DataFrame]:
    """(sets with their smallest key and component, set of each row)."""
    spark = docs.sparkSession
    sized = written(shingle_sizes(docs, k), "sets")
    firsts = sized.where("n > 0").groupBy("set_key", "n").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "text_key")).alias("rep"), F.first("minima").alias("minima"))
    groups = written(firsts.select(F.monotonically_increasing_id().alias("gid"), "set_key", "n", F.col("rep.key").alias("key"), F.col("rep.text_key").alias("text_key"), "minima"), "groups")
    named = groups.select(F.col("key").alias("k"), F.col("text_key").alias("t"), "gid", "n")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    texts = bucketed(keyed.join(named, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("t"))).select("gid", "n", "text"), "gid", "texts")
    stars = written(_stars(groups, t100), "stars")
    first_maps = written(_bitmaps(texts, stars.select(F.explode(F.array("a", "b")).alias("gid")), k), "bitmaps")
    near = written(_verified(_bounded(stars, first_maps, t100), texts, k, t100), "near")
    joined = written(components(near), "joined")
    counts = spark.sparkContext.broadcast(shingle_counts(texts.select("text"), k))
    postings = _postings(_with_components(texts, joined), counts, k, t100)
    mixed = written(_by_tile(postings, _mixed, TILE_ROW), "mixed")
    bitmaps = first_maps.unionByName(written(_bitmaps(texts, mixed.join(first_maps, "gid", "left_anti"), k), "bitmaps"))
    # One partner for each row of a tile comes first: it connects most groups of near copies, and their other pairs then need no look.
    beside = _by_tile(_with_components(mixed, joined), _pairs_around(t100), "a long, b long").distinct()
    near = written(near.unionByName(_verified(_bounded(beside, bitmaps, t100), texts, k, t100)), "near")
    joined = written(components(near), "joined")
    still = written(_by_tile(_with_components(mixed, joined), _mixed, TILE_ROW), "mixed")
    signed = _with_components(still, joined).join(bitmaps.select("gid", "bitmap"), "gid")
    pairs = written(_by_tile(signed, _pairs_within(t100), "a long, b long").distinct(), "pairs")
    found = written(components(near.unionByName(_verified(pairs, texts, k, t100))), "components")
    placed = groups.join(found, groups["gid"] == found["node"], "left").select("set_key", "n", "key", F.coalesce("component", "gid").alias("comp"))
    return written(placed, "placed"), sized
