"""SentencePiece encoding and decoding through a table of distinct marked words.

The normaliser puts a marker before the text and turns every space into a marker; no piece of the
vocabulary has a marker behind another character (checked when the model is loaded). Merges then
never cross the beginning of a marker run, so a text falls into chunks - a run of markers and the
characters up to the next run - that can be segmented apart. Each task keeps a table of the distinct
chunks it has met, hands the library only chunks that are not in it, and joins ids and decoded
text back by position. Nothing is shuffled; the table is emptied when it reaches ``TABLE_ENTRIES``
chunks, which bounds memory and changes no result.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_ENTRIES = 250_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_codecs: dict[str, "ChunkCodec"] = {}


class ChunkCodec:
    """Ids and decoded text of whole texts, from a table of distinct chunks."""

    def __init__(self, model_file: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.entries = entries
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}
        bad = [p for p in map(self.model.id_to_piece, range(self.model.get_piece_size())) if MARK in p.lstrip(MARK)]
        if bad or self.model.encode("  a ") == self.model.encode("a"):
            raise ValueError("this model's pieces cross whitespace markers or its normaliser drops spaces")
        self.lead = self.model.encode("a")
        self.lead_text = self.model.decode(self.lead)

    def _learn(self, chunks: set[str]) -> None:
        new = list(chunks - self.ids.keys())
        if len(self.ids) + len(new) > self.entries:
            self.ids.clear()
            self.surface.clear()
            new = list(chunks)
        # The library puts the first marker itself. A chunk is decoded behind a leading word, as decode() drops the text's first marker.
        coded = self.model.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)
        decoded = self.model.decode([self.lead + ids for ids in coded], num_threads=1) if new else []
        for chunk, ids, text in zip(new, coded, decoded, strict=True):
            if not ids:
                ids = [self.model.piece_to_id(MARK)] if chunk == MARK else ids
                text = self.lead_text + " "
            self.ids[chunk] = ",".join(map(str, ids))
            self.surface[chunk] = text[len(self.lead_text) :]

    def encode_decode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """(comma-joined ids, decoded text) of each text; both empty for null or empty text."""
        split = []
        for text in texts:
            marked = MARK + text.replace(" ", MARK) if text else ""
            if MARK * 2 in marked:
                split.append(_CHUNK.findall(marked))
            else:
                split.append([MARK + c for c in marked[1:].split(MARK)] if marked else [])
        at = 0
        while at < len(split):  # as many texts at a time as the table holds
            to, size = at, 0
            while to < len(split) and (to == at or size + len(split[to]) <= self.entries // 2):
                size += len(split[to])
                to += 1
            self._learn({c for chunks in split[at:to] for c in chunks})
            for chunks in split[at:to]:
                yield ",".join([self.ids[c] for c in chunks]), "".join([self.surface[c] for c in chunks])[1:]
            at = to


def codec(model_file: str) -> ChunkCodec:
    """The worker's codec for a model."""
    if model_file not in _codecs:
        _codecs[model_file] = ChunkCodec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``piece_ids`` (array of int) and ``decoded`` (string).

    Null and empty texts have no ids and decode to the empty text. Rows are handled one by one, so
    repeated rows, ties, null keys and empty tables need no care. A column of ``docs`` that has one of
    the new names is replaced. Whole texts are encoded, whatever their length.
    """
    return (
        _coded(docs, model_file, text, digest=False)
        .withColumn("piece_ids", F.when(F.col("__ids") == "", F.array().cast("array<int>")).otherwise(F.split("__ids", ",").cast("array<int>")))
        .withColumn("decoded", F.col("__decoded"))
        .drop("__ids", "__decoded")
    )


def digests(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """As :func:`encode_decode`, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of ids and text."""
    return _coded(docs, model_file, text, digest=True)


def _coded(docs: DataFrame, model_file: str, text: str, digest: bool) -> DataFrame:
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {"__ids": "string", "__decoded": "string"}
    kept = [c for c in docs.columns if c not in made]
    carried = [c for c in kept if c != text or not digest]
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        own = codec(model_file)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            columns: list[list] = [[] for _ in made]
            for a in range(0, len(texts), 256):
                for ids, decoded in own.encode_decode(texts.slice(a, 256).to_pylist()):
                    if digest:
                        columns[0].append(ids.count(",") + 1 if ids else 0)
                        columns[1].append(hashlib.sha256(ids.encode()).hexdigest())
                        columns[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        columns[0].append(ids)
                        columns[1].append(decoded)
            fresh = [pa.array(c, type=pa.int64() if kind == "long" else pa.string()) for c, kind in zip(columns, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carried))] + fresh, names=carried + list(made))

    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carried] + [f"{c} {kind}" for c, kind in made.items()])
    return source.mapInArrow(run, schema)
