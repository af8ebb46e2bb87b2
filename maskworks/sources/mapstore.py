"""Symbol maps at rest: an append-only Parquet store, plain JSON, and encrypted files."""

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grammar import PLACEHOLDER

SCHEMA = "id string, name string, symbols array<struct<placeholder:string,name:string,ord:int>>, saved_at timestamp, identifier_count int, deleted boolean"

#: Fixed values of the encrypted file format.
VERSION, ALGORITHM, KDF_NAME = 1, "AES-256-GCM-PBKDF2", "PBKDF2-SHA256"
CURRENT_ITERATIONS, LEGACY_ITERATIONS, MAX_ITERATIONS = 600_000, 100_000, 4_000_000
MAX_ENTRIES, MAX_VALUE, MIN_PASSPHRASE = 50_000, 10_000, 12
#: Passphrases that are long enough and still among the first ones tried.
BLOCKED = frozenset(
    """password1234 passwordpassword qwertyuiop12 qwertyuiopas letmein12345 iloveyou1234 welcome12345 administrator
    changeme1234 123456789012 012345678901 123456789123 112233445566""".split()
)


class WeakPassphraseError(ValueError):
    """A passphrase below the floor."""


class KdfParamsError(ValueError):
    """Key-derivation parameters that are not supported."""


class InvalidMapError(ValueError):
    """Content that is no symbol map."""


#: Folders that maps are dealt to by id.
BUCKETS = 64


def bucket_of(map_id: str) -> int:
    """The folder of a map: its rows and its delete lie there together."""
    return zlib.crc32(map_id.encode()) % BUCKETS


@dataclass(frozen=True)
class MapStore:
    """Saved maps in a folder. A delete is a row of its own, so nothing is ever rewritten in place.

    Each save and each delete writes a folder of its own below the bucket of its id, so writers at the same time do
    not meet, and one map is read from one bucket. A store that cannot be read raises; only an absent one is empty.
    """

    spark: SparkSession
    path: str

    def save(self, name: str, symbols: DataFrame) -> str:
        """Appends a map from one row with a column ``symbols``, and gives its id; a blank name is refused."""
        if not name.strip():
            raise ValueError("a map needs a name")
        map_id = str(uuid.uuid4())
        row = symbols.select(
            F.lit(map_id).alias("id"), F.lit(name.strip()).alias("name"), "symbols",
            F.current_timestamp().alias("saved_at"), F.size("symbols").alias("identifier_count"), F.lit(False).alias("deleted"),
        )
        self._write(row, map_id)
        return map_id

    def delete(self, map_id: str) -> None:
        """Takes a map out of :meth:`load`; an unknown id changes nothing."""
        row = self.spark.range(1).select(
            F.lit(map_id).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<struct<placeholder:string,name:string,ord:int>>").alias("symbols"),
            F.current_timestamp().alias("saved_at"), F.lit(None).cast("int").alias("identifier_count"), F.lit(True).alias("deleted"),
        )
        self._write(row, map_id)

    def _write(self, row: DataFrame, map_id: str) -> None:
        row.write.mode("errorifexists").parquet(f"{self.path}/bucket={bucket_of(map_id)}/write={uuid.uuid4()}")

    def _kept(self, folder: str) -> DataFrame:
        """The maps below a folder that no delete names. Deletes are few and bare, so it is they that travel."""
        if not there(self.spark, folder):
            return self.spark.createDataFrame([], SCHEMA).drop("deleted")
        rows = self.spark.read.schema(SCHEMA).parquet(folder).drop("bucket", "write")
        return rows.where("not deleted").drop("deleted").join(rows.where("deleted").select("id").distinct(), "id", "left_anti")

    def load(self) -> DataFrame:
        """All maps, newest first."""
        return self._kept(self.path).orderBy(F.col("saved_at").desc(), "id")

    def get(self, map_id: str) -> DataFrame:
        """The map of an id, or no row. Only its bucket is listed and read."""
        return self._kept(f"{self.path}/bucket={bucket_of(map_id)}").where(F.col("id") == map_id)

    def recent(self, most: int = 5) -> DataFrame:
        """The newest maps."""
        return self.load().limit(most)


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; what cannot be asked raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def file_name(name: str) -> str:
    """A map's name as a file name: runs of white space become hyphens."""
    return re.sub(r"\s+", "-", name)


def to_json(symbols: dict[str, str]) -> str:
    """A map as plain JSON."""
    return json.dumps(symbols, indent=2, ensure_ascii=False)


def check_passphrase(passphrase: str) -> None:
    """Raises unless a passphrase is good enough for a new file; files that exist are opened with any."""
    if len(passphrase) < MIN_PASSPHRASE:
        raise WeakPassphraseError(f"use at least {MIN_PASSPHRASE} characters: the file can be attacked offline")
    if not passphrase.strip():
        raise WeakPassphraseError("only spaces protect nothing")
    if len(set(passphrase)) == 1:
        raise WeakPassphraseError("one repeated character is guessed at once")
    low = passphrase.lower()
    if {ord(b) - ord(a) for a, b in zip(low, low[1:], strict=False)} in ({1}, {-1}):
        raise WeakPassphraseError("a straight run of characters is guessed at once")
    if low in BLOCKED:
        raise WeakPassphraseError("this is one of the first passphrases tried")


def kdf_iterations(raw: object) -> int:
    """The iterations that a file asks for; files without parameters are old ones."""
    if raw is None:
        return LEGACY_ITERATIONS
    if not isinstance(raw, dict) or raw.get("name") != KDF_NAME:
        raise KdfParamsError("unsupported key derivation")
    n = raw.get("iterations")
    if isinstance(n, float) and n.is_integer():
        n = int(n)
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= MAX_ITERATIONS:
        raise KdfParamsError("refused number of iterations")
    return n


def parse_symbols(raw: object) -> dict[str, str]:
    """A map from parsed JSON, checked entry by entry; the first fault ends it."""
    if isinstance(raw, list):
        raise InvalidMapError("a list where a symbol map was expected")
    if not isinstance(raw, dict):
        raise InvalidMapError("no symbol map")
    if len(raw) > MAX_ENTRIES:
        raise InvalidMapError(f"more than {MAX_ENTRIES} entries")
    out = {}
    for key, value in raw.items():
        if not re.fullmatch(PLACEHOLDER, key):
            shown = re.sub(r"\s+", " ", key).strip()
            raise InvalidMapError(f"not a placeholder: {shown[:40] + '…' if len(shown) > 40 else shown or '(empty)'}")
        if not isinstance(value, str):
            raise InvalidMapError(f"{key} does not map to text")
        if len(value.encode("utf-16-le", "surrogatepass")) // 2 > MAX_VALUE:
            raise InvalidMapError(f"{key} maps to more than {MAX_VALUE} characters")
        out[key] = value
    return out


def _key(passphrase: str, salt: bytes, iterations: int) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, iterations, 32)


def export_map(spark: SparkSession, symbols: dict[str, str], passphrase: str, iterations: int = CURRENT_ITERATIONS) -> str:
    """A map as an encrypted file's text. The cipher is Spark's; the key never enters a plan as text."""
    check_passphrase(passphrase)
    salt, iv = os.urandom(16), os.urandom(12)
    plain = json.dumps(symbols, ensure_ascii=False, separators=(",", ":")).encode()
    rows = spark.createDataFrame([(bytearray(plain), bytearray(_key(passphrase, salt, iterations)), bytearray(iv))], "plain binary, key binary, iv binary")
    sealed = rows.select(F.aes_encrypt("plain", "key", F.lit("GCM"), F.lit("DEFAULT"), "iv")).first()[0]
    text = lambda b: base64.b64encode(bytes(b)).decode()
    # Spark puts the IV in front of the ciphertext; the file has it apart.
    return json.dumps({"v": VERSION, "alg": ALGORITHM, "kdf": {"name": KDF_NAME, "iterations": iterations}, "salt": text(salt), "iv": text(iv), "data": text(sealed[12:])}, indent=2)


def import_map(spark: SparkSession, content: str, passphrase: str) -> dict[str, str]:
    """The map of an encrypted file; format and parameters are checked before the costly key."""
    file = json.loads(content)
    if not isinstance(file, dict) or file.get("v") != VERSION or file.get("alg") != ALGORITHM:
        raise InvalidMapError("not an encrypted map file")
    iterations = kdf_iterations(file.get("kdf"))
    salt, iv, data = (base64.b64decode(file[k]) for k in ("salt", "iv", "data"))
    rows = spark.createDataFrame([(bytearray(iv + data), bytearray(_key(passphrase, salt, iterations)))], "sealed binary, key binary")
    plain = rows.select(F.try_aes_decrypt("sealed", "key", F.lit("GCM"))).first()[0]
    if plain is None:
        raise ValueError("import failed; is the passphrase right?")
    return parse_symbols(json.loads(bytes(plain).decode()))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files that are not blank."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(F.col("text").rlike(r"\S"))
