"""Folders of map files as a Spark data source: read, checked and written by tasks, one row a file.

``spark.dataSource.register(MapFiles)`` and then ``spark.read.format("mapfiles").load(folder)`` gives a row for each
file, a bad one with the reason in ``error`` and no symbols, so one hostile file costs one row.
``df.write.format("mapfiles").mode("append").save(folder)`` writes files, which :func:`sealed` encrypts. Passphrases are
columns: take them from a table, as a literal shows in plans just as an option would.
"""

import base64
import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from . import mapstore

SCHEMA = "path string, kind string, content string, error string"
#: What a file is.
PLAIN, ENCRYPTED, LEGACY = "plain", "encrypted", "legacy"
#: More than an encrypted file of the largest map that is allowed.
MAX_FILE_BYTES = 4 * mapstore.MAX_ENTRIES * mapstore.MAX_VALUE
SYMBOLS = ArrayType(StructType().add("placeholder", StringType()).add("name", StringType()).add("ord", IntegerType()))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def kind_of(content: str) -> tuple[str | None, str | None]:
    """(kind, error) of a file's text. Format and key parameters are checked here, before any costly key."""
    try:
        file = json.loads(content)
    except (ValueError, RecursionError):
        return None, "not JSON"
    if not isinstance(file, dict):
        return None, "a list where a symbol map was expected" if isinstance(file, list) else "no symbol map"
    if not {"v", "alg", "data"} & file.keys():
        try:
            mapstore.parse_symbols(file)
        except mapstore.InvalidMapError as e:
            return None, str(e)
        return PLAIN, None
    if file.get("v") != mapstore.VERSION or file.get("alg") != mapstore.ALGORITHM:
        return None, "not an encrypted map file"
    try:
        mapstore.kdf_iterations(file.get("kdf"))
        if not all(base64.b64decode(file[k], validate=True) for k in ("salt", "iv", "data")):
            return None, "an empty salt, iv or body"
    except mapstore.KdfParamsError as e:
        return None, str(e)
    except (KeyError, TypeError, ValueError):
        return None, "a damaged salt, iv or body"
    return ENCRYPTED if "kdf" in file else LEGACY, None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.per_task = options["path"], int(options.get("filesPerTask", 64))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder.removeprefix("file:"))
        found = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.path.endswith(".json"))
        return [_Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pafs.LocalFileSystem()
        for path in partition.paths:
            # A file that cannot be read fails the task; one with bad content is a row.
            with fs.open_input_stream(path) as f:
                raw = f.read(MAX_FILE_BYTES + 1)
            if len(raw) > MAX_FILE_BYTES:
                yield path, None, None, "larger than any map"
                continue
            try:
                content = raw.decode()
            except UnicodeDecodeError:
                yield path, None, None, "not UTF-8"
                continue
            kind, error = kind_of(content)
            yield path, kind, content if error is None else None, error


class _Written(WriterCommitMessage):
    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs


class _Writer(DataSourceWriter):
    """Tasks write under names that readers do not look at; the commit gives the files their own.

    Nothing is replaced: a name that is there already, or twice among the rows, fails the write and adds nothing.
    What a lost task wrote stays under a name that readers pass over.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"]
        if overwrite:
            raise ValueError("map files are only added: use mode append")

    def _fs(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder.removeprefix("file:"))

    def write(self, rows: Iterator) -> _Written:
        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        pairs = []
        for row in rows:
            name = mapstore.file_name(os.path.basename(row["name"] or ""))
            if not name.strip("."):
                raise ValueError("a map file needs a name")
            held = f"{root}/{name}.{os.urandom(8).hex()}.part"
            with fs.open_output_stream(held) as f:
                f.write(row["content"].encode())
            pairs.append((held, f"{root}/{name}.json"))
        return _Written(pairs)

    def commit(self, messages: list) -> None:
        fs, _ = self._fs()
        pairs = [p for m in messages if m is not None for p in m.pairs]
        finals = [final for _held, final in pairs]
        if len(set(finals)) < len(finals) or any(i.type.name != "NotFound" for i in fs.get_file_info(finals)):
            raise ValueError("two map files of one name")
        for held, final in pairs:
            fs.move(held, final)

    def abort(self, messages: list) -> None:
        fs, _ = self._fs()
        for held, _final in (p for m in messages if m is not None for p in m.pairs):
            if fs.get_file_info(held).type.name == "File":
                fs.delete_file(held)


class MapFiles(DataSource):
    """Format ``mapfiles``: options ``path`` and ``filesPerTask``; reads ``SCHEMA``, writes columns name and content."""

    @classmethod
    def name(cls) -> str:
        return "mapfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def _key_of(passphrase: str | None, content: str | None) -> bytes | None:
    """The key of an encrypted file."""
    if passphrase is None or content is None:
        return None
    file = json.loads(content)
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), base64.b64decode(file["salt"]), mapstore.kdf_iterations(file.get("kdf")), 32)


def _entries_of(plain: str | None) -> tuple | None:
    """The entries of a map's JSON in order, or why it is none."""
    if plain is None:
        return None
    try:
        symbols = mapstore.parse_symbols(json.loads(plain))
    except (mapstore.InvalidMapError, ValueError, RecursionError) as e:
        return None, str(e) if isinstance(e, mapstore.InvalidMapError) else "not JSON"
    return [(p, n, i) for i, (p, n) in enumerate(symbols.items())], None


_derived = F.udf(lambda passphrase, content: _key_of(passphrase, content), BinaryType())
_checked = F.udf(lambda plain: _entries_of(plain), StructType().add("symbols", SYMBOLS).add("error", StringType()))


def opened(files: DataFrame, passphrase: Column) -> DataFrame:
    """``files`` as read, without ``content``, plus ``symbols``; keys are derived and maps checked by tasks.

    A file that its passphrase does not open, or whose map is hostile, has the reason in ``error`` and null symbols.
    Plain files need no passphrase. A row with an error keeps it; a null passphrase opens no encrypted file.
    """
    sealed = F.col("kind").isin(ENCRYPTED, LEGACY)
    part = lambda name: F.unbase64(F.get_json_object("content", f"$.{name}"))
    out = files.withColumn("__key", F.when(sealed, _derived(passphrase, F.when(sealed, F.col("content")))))
    plain = F.try_aes_decrypt(F.concat(part("iv"), part("data")), F.col("__key"), F.lit("GCM"))
    out = out.withColumn("__plain", F.when(sealed, plain.cast("string")).otherwise(F.col("content")))
    out = out.withColumn("__map", _checked(F.col("__plain")))
    why = F.coalesce(F.col("error"), F.when(sealed & F.col("__plain").isNull(), F.lit("import failed; is the passphrase right?")), F.col("__map.error"))
    return out.withColumn("error", why).withColumn("symbols", F.when(why.isNull(), F.col("__map.symbols"))).drop("content", "__key", "__plain", "__map")


def sealed(maps: DataFrame, passphrase: Column, iterations: int = mapstore.CURRENT_ITERATIONS) -> DataFrame:
    """(name, content) of encrypted files for rows (name, symbols); keys are derived by tasks, a weak passphrase fails the job."""

    @F.udf("struct<salt:binary,iv:binary,key:binary>")
    def key(passphrase):
        mapstore.check_passphrase(passphrase)
        salt = os.urandom(16)
        return salt, os.urandom(12), hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, iterations, 32)

    out = maps.withColumn("__key", key.asNondeterministic()(passphrase))
    plain = F.coalesce(F.to_json(F.map_from_entries(F.transform("symbols", lambda e: F.struct(e["placeholder"], e["name"])))), F.lit("{}"))
    # Spark puts the IV in front of the ciphertext; the file has it apart.
    body = F.aes_encrypt(plain.cast("binary"), F.col("__key.key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("__key.iv"))
    file = F.struct(
        F.lit(mapstore.VERSION).alias("v"), F.lit(mapstore.ALGORITHM).alias("alg"), F.struct(F.lit(mapstore.KDF_NAME).alias("name"), F.lit(iterations).alias("iterations")).alias("kdf"),
        _one_line(F.col("__key.salt")).alias("salt"), _one_line(F.col("__key.iv")).alias("iv"), _one_line(F.substring(body, 13, mapstore.MAX_ENTRIES * mapstore.MAX_VALUE)).alias("data"),
    )
    return out.select("name", F.to_json(file).alias("content"))


def _one_line(raw: Column) -> Column:
    return F.regexp_replace(F.base64(raw), r"\s", "")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(MapFiles)
