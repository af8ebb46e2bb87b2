"""Masking a stream of documents with one growing symbol map for each scope, and restoring a stream of replies.

The map of a scope is keyed state: each name is an entry of its own in Spark's state store, so a batch reads and
writes the names of its own texts and nothing else, whatever came before. Names, roles and placeholders of a text
are found before the stateful step and the text is put together behind it, both by the operators of a batch.
A map that is cleared, or idle for too long, begins a new epoch with fresh numbers; entries are kept as a table by
scope and epoch, so replies are restored with the map of their time, however late they come.
"""

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import textswap
from ..functions.grammar import PLACEHOLDER_SCAN, REDACTION_PREFIX
from ..operators import identifiers
from ..operators.anonymize import placeholders_held, prepared
from ..sources.mapstore import there

ENTRY = "struct<placeholder:string,name:string,ord:int>"
ENTRIES = "scope string, epoch int, placeholder string, name string, ord int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Folders that entries are dealt to by scope, so that replies read the folders of their own scopes.
BUCKETS = 64


class _Session(StatefulProcessor):
    """One scope: its names with their placeholders, the largest number of each base, its epoch."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getMapState("names", "name string", "placeholder string, ord int")
        self.last = handle.getMapState("last", "base string", "number long")
        self.epoch = handle.getValueState("epoch", "epoch int, entries int, before long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        epoch, entries, before = self.epoch.get() if self.epoch.exists() else (0, 0, None)
        held: dict[str, tuple[str, int] | None] = {}
        last: dict[str, int] = {}
        changed: set[str] = set()

        def entry(name: str) -> tuple[str, int] | None:
            if name not in held:
                held[name] = tuple(self.names.getValue((name,))) if self.names.containsKey((name,)) else None
            return held[name]

        def number(base: str) -> int:
            if base not in last:
                last[base] = self.last.getValue((base,))[0] if self.last.containsKey((base,)) else 0
            return last[base]

        for row in sorted(rows, key=lambda r: (r["place"] is None, r["place"])):
            idle = None not in (self.idle_ms, before, row["at"]) and row["at"] - before > self.idle_ms
            before = row["at"] if before is None or row["at"] is not None and row["at"] > before else before
            if row["clears"] or idle:
                self.names.clear()
                self.last.clear()
                epoch, entries = epoch + 1, 0
                held.clear(), last.clear(), changed.clear()
            roles = dict.fromkeys(x[1:] for x in row["found"])
            known = [(e[0], n) for n in roles if (e := entry(n))]
            # Numbers go on behind those of the scope: its last one of each base stands in for all before it.
            counted = [f"{b}{number(b)}" for b in _bases(row["found"], row["held"]) if number(b)]
            names, placeholders, fresh = textswap.number_names(row["found"], known, [*row["held"], *counted], None)
            for p in (*placeholders[:fresh], *row["held"]):
                if (told := textswap.base_and_number(p)) and told[1] > number(told[0]):
                    last[told[0]] = told[1]
                    changed.add(told[0])
            for i, n in enumerate(names):
                if i < fresh:
                    held[n] = (placeholders[i], entries)
                    self.names.updateValue((n,), held[n])
                    entries += 1
            yield Row(doc=row["doc"], epoch=epoch, names=names, placeholders=placeholders, ords=[held[n][1] for n in names], fresh=fresh)
        for base in changed:
            self.last.updateValue((base,), (last[base],))
        self.epoch.update((epoch, entries, before))

    def close(self) -> None:
        pass


def _bases(found: list[str], held: list[str]) -> list[str]:
    of = (textswap.base_and_number(p) for p in held)
    return list(dict.fromkeys([*textswap.BASES.values(), *(x[0] for x in of if x)])) if found or held else []


def _key(scope: str) -> Column:
    return F.coalesce(F.to_json(F.struct(F.col(f"`{scope}`").cast("string").alias("s"))), F.lit("{}"))


def bucket_of(scope: Column) -> Column:
    """The folder of a scope's entries; a null scope has one too."""
    return F.pmod(F.xxhash64(scope), F.lit(BUCKETS)).cast("int")


def masked(docs: DataFrame, scope: str, text: str = "text", place: str | None = None, clears: str | None = None, language: str | None = None, policy: str = "redact", idle: timedelta | None = None, at: str | None = None) -> DataFrame:
    """A stream's columns plus ``anonymized``, ``symbols``, ``fresh``, ``epoch``, ``language`` and ``secrets``.

    Texts of a scope are masked one after another, those of one batch in the order of the long column ``place``,
    null last: each as :func:`~maskworks.operators.anonymize.anonymize` would with the map as the one before left it.
    ``symbols`` are the entries of the text's own names, ``fresh`` those of them that are new. Where the boolean
    column ``clears`` holds, the map is emptied before the text; so it is where the timestamp ``at`` is more than
    ``idle`` behind the scope's latest one. A null scope is a scope of its own; a null text stays null. Columns
    with one of the new names are replaced.
    """
    new = ("anonymized", "symbols", "fresh", "epoch", "language", "secrets")
    old = [c for c in docs.columns if c not in new]
    which = F.col("language") if language in (None, "auto") else language
    row = prepared(docs.withColumn("__source", F.col(f"`{text}`")), "__source", language, None, (), policy)
    row = identifiers.cut(row, "__source", which).withColumn("__found", identifiers.found_names(which))
    doc = F.struct(*[F.col(f"`{c}`") for c in old], F.col("__source").alias("__own_source"), F.col("language").alias("__own_language"), F.col("secrets").alias("__own_secrets"))
    row = row.select(
        _key(scope).alias("key"), (F.col(f"`{place}`").cast("long") if place else F.lit(0).cast("long")).alias("place"),
        (F.coalesce(F.col(f"`{clears}`"), F.lit(False)) if clears else F.lit(False)).alias("clears"),
        (F.unix_millis(F.col(f"`{at}`")) if at else F.lit(None).cast("long")).alias("at"), F.col("__found").alias("found"), placeholders_held(F.col("__source")).alias("held"), doc.alias("doc"),
    )
    kind = row.schema["doc"].dataType.simpleString()
    done = row.groupBy("key").transformWithState(
        statefulProcessor=_Session(None if idle is None else int(idle.total_seconds() * 1000)),
        outputStructType=f"doc {kind}, epoch int, names array<string>, placeholders array<string>, ords array<int>, fresh int",
        outputMode="append",
        timeMode="none",
    )
    done = identifiers.cut(done.withColumn("language", F.col("doc.__own_language")).withColumn("__source", F.col("doc.__own_source")), "__source", which)
    entries = F.transform(F.arrays_zip("placeholders", "names", "ords"), lambda e: F.struct(e["placeholders"].alias("placeholder"), e["names"].alias("name"), e["ords"].alias("ord")))
    whole = textswap.swap_words("__segs", "__comment", "names", "placeholders")
    return done.select(
        *[F.col(f"doc.`{c}`").alias(c) for c in old],
        F.when(F.col("__source").isNotNull(), whole).alias("anonymized"),
        entries.alias("symbols"),
        F.slice(entries, F.lit(1), F.col("fresh")).alias("fresh"),
        "epoch",
        F.col("doc.__own_language").alias("language"),
        F.col("doc.__own_secrets").alias("secrets"),
    )


def mask_stream(docs: DataFrame, scope: str, text: str, out_path: str, map_path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Starts :func:`masked` over a stream, writing texts to ``out_path`` and entries (scope, epoch, …) to ``map_path``.

    Both are written under the batch's number, so a batch that runs twice overwrites itself; the entries are
    those of the texts just written and lie in ``BUCKETS`` folders by scope. ``options`` are those of
    :func:`masked`. The session must keep state in RocksDB, which is set here unless another provider is.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/part={number}")
        done = batch.sparkSession.read.schema(batch.schema).parquet(f"{out_path}/part={number}")
        entry = done.select(F.col(f"`{scope}`").cast("string").alias("scope"), "epoch", F.explode("fresh").alias("e")).select("scope", "epoch", "e.*")
        entry.withColumn("bucket", bucket_of(F.col("scope"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{map_path}/part={number}")

    stream = masked(docs, scope, text, **options)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def entries_at(spark: SparkSession, map_path: str) -> DataFrame:
    """The entries that :func:`mask_stream` has written; none before its first batch. A map that cannot be read raises."""
    if not there(spark, map_path):
        return spark.createDataFrame([], f"{ENTRIES}, bucket int")
    return spark.read.schema(f"{ENTRIES}, part long, bucket int").parquet(map_path).drop("part")


def restored(replies: DataFrame, entries: DataFrame, scope: str, text: str = "text", epoch: str | None = None) -> DataFrame:
    """``replies`` plus ``restored``, ``resolved`` and ``unresolved``: placeholders of a reply looked up in the map of its time.

    ``entries`` are (scope, epoch, placeholder, name, bucket); only placeholders that stand in replies are joined to
    them, by scope, epoch and placeholder, and a reply meets the few names it needs. Without ``epoch`` a
    placeholder has its newest meaning; a null epoch has none. Null scopes are a scope. Rows are replies of their
    own, whatever they repeat; a null text stays null. Replaced are whole words only.
    """
    old = [c for c in replies.columns if c not in ("restored", "resolved", "unresolved")]
    held = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(PLACEHOLDER_SCAN), F.lit(0)))
    rows = replies.select(F.struct(*[F.col(f"`{c}`") for c in old]).alias("doc"), F.filter(held, lambda p: ~p.startswith(REDACTION_PREFIX)).alias("held"), F.expr("uuid()").alias("id"))
    asked = rows.select(
        "id", "doc", "held", F.posexplode_outer("held").alias("at", "asked"), F.col(f"doc.`{scope}`").cast("string").alias("own_scope"),
        (F.col(f"doc.`{epoch}`").cast("int") if epoch else F.lit(None).cast("int")).alias("own_epoch"),
    )
    # The reply rides on its first placeholder only.
    asked = asked.withColumn("doc", F.when(F.coalesce("at", F.lit(0)) == 0, F.struct("doc", "held"))).withColumn("own_bucket", bucket_of(F.col("own_scope"))).drop("held")
    same = (F.col("bucket") == F.col("own_bucket")) & F.col("scope").eqNullSafe(F.col("own_scope")) & (F.col("placeholder") == F.col("asked"))
    newest = entries
    if epoch:
        same = same & (F.col("epoch") == F.col("own_epoch"))
    else:
        newest = entries.groupBy("bucket", "scope", "placeholder").agg(F.max_by("name", "epoch").alias("name"))
    met = asked.join(newest, same, "left")
    pair = F.when(F.col("name").isNotNull(), F.struct("at", F.col("asked").alias("placeholder"), "name"))
    done = met.groupBy("id").agg(F.first("doc", ignorenulls=True).alias("doc"), F.array_sort(F.collect_list(pair)).alias("found"))
    resolved = F.transform("found", lambda e: e["placeholder"])
    swapped = textswap.swap_terms(F.col(f"doc.doc.`{text}`"), resolved, F.transform("found", lambda e: e["name"]), strict=True)
    return done.select(
        *[F.col(f"doc.doc.`{c}`").alias(c) for c in old], swapped.getField("text").alias("restored"), resolved.alias("resolved"), F.array_except("doc.held", resolved).alias("unresolved")
    )


def restore_stream(replies: DataFrame, scope: str, text: str, map_path: str, out_path: str, checkpoint: str, epoch: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts :func:`restored` over a stream of replies, each batch with the entries that are there when it runs.

    Results lie under the batch's number, so a batch that runs twice overwrites itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        out = restored(batch, entries_at(batch.sparkSession, map_path), scope, text, epoch)
        out.write.mode("overwrite").parquet(f"{out_path}/part={number}")

    return replies.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
