"""The registered queries of this package, one for each operator, and their SQL for DuckDB where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, decontamination, embedding_tiles, language_bloom, license_scan, line_dedup, ngram_join, packing, resampling, sentencepiece_codec, toxicity_chain, warc, whitening
from .store import table

PIECE_MODEL = "piece_bpe_32k.model"
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from three of four hash classes of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))
    model = language_bloom.train(docs.where("not coalesce(held_out, false)").select("text", "lang"))
    return language_bloom.predict(docs.select("doc_id", "held_out", "text"), spark.sparkContext.broadcast(model))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks and runs of lines that an earlier place of the corpus has."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines_before", "lines_removed", F.md5("text").alias("text_md5"))


OP2_SQL = f"""
with d as (select doc_id, text, md5(text) tk, string_split(text, chr(10)) ls from documents),
l as (select doc_id, tk, unnest(ls) line, generate_subscripts(ls, 1) - 1 i from d),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint h, length(line) - length(replace(line, ' ', '')) >= {line_dedup.PASSAGE_WORDS} p from l),
c as (select *, (h + {line_dedup.FACTOR} * coalesce(lag(h) over w, 0)) % {line_dedup.DIVISOR} = 0 or p or coalesce(lead(p) over w, true) cut
      from h window w as (partition by doc_id, tk order by i)),
n as (select *, coalesce(sum(cut::int) over (partition by doc_id, tk order by i rows between unbounded preceding and 1 preceding), 0) chunk from c),
k as (select doc_id, tk, chunk, min(i) start, count(*) lines, bool_or(p) p, string_agg(line, chr(10) order by i) t from n group by all),
r as (select *, row_number() over (partition by t order by doc_id, tk, start) > 1 and (lines > 1 or p) gone from k),
p as (select doc_id, tk, i, line || chr(10) || lead(line) over (partition by doc_id, tk order by i) t from l),
f as (select doc_id, tk, i, first_value(doc_id) over w fd, first_value(tk) over w ft, first_value(i) over w fi from p where t is not null window w as (partition by t order by doc_id, tk, i)),
g as (select *, i - row_number() over (partition by doc_id, tk, fd, ft, fi - i order by i) isle from f where (doc_id, tk, i) is distinct from (fd, ft, fi)),
q as (select doc_id, tk, min(i) start, max(i) + 2 stop from g group by doc_id, tk, fd, ft, fi - i, isle),
m as (select q.*, (select sum(len(regexp_extract_all(line, '{line_dedup.WORD}'))) from l where l.doc_id is not distinct from q.doc_id and l.tk = q.tk and l.i >= q.start and l.i < q.stop) words from q),
x as (select doc_id, tk, unnest(range(start, start + lines)) i from r where gone union select doc_id, tk, unnest(range(start, stop)) from m where words > {line_dedup.PASSAGE_WORDS}),
s as (select l.doc_id, l.tk, count(*) lines_before, count(x.i) lines_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (x.i is null), '') t
  from l left join x on x.doc_id is not distinct from l.doc_id and x.tk = l.tk and x.i = l.i group by l.doc_id, l.tk)
select doc_id, lines_before::bigint lines_before, lines_removed::bigint lines_removed, md5(t) text_md5 from s
union all select doc_id, 0, 0, null from documents where text is null
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item of which it holds a window, with the fewest edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.groupBy("doc_id", "leak.item_id").agg(F.count("*").alias("n_windows"), F.min("leak.edits").alias("edits"), F.min("leak.start").alias("first_byte"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document by the classifier chain, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity_chain.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return toxicity_chain.score(docs, spark.sparkContext.broadcast(chain), texts=False)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document by ordered signature rules."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda x: x["start"])
    base = F.array_distinct(F.transform("base", lambda x: x["label"]))
    more = F.transform("found", lambda x: x["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        "score",
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of embeddings of a label with a cosine of 0.93 or more."""
    return embedding_tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
with recursive e as (select vec_id, label, embedding::double[] v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v from e),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_inner_product(a.v, b.v) >= 0.93),
r(a, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.a),
m as (select a vec_id, min(c) component_id from r group by a),
n as (select a vec_id, count(*) n_links from l group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint n_links, m.component_id, e.vec_id = m.component_id kept
from embeddings e left join n using (vec_id) left join m using (vec_id)
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the base model and under the class model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"))
    scored = class_lm.score_texts(docs.withColumn("trains", F.expr("not coalesce(held_out, false)")), "trains")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = f"""
with p as (select page_id, coalesce(html, '') h from pages),
q as (select *, strlen(h) n, min(page_id) over (partition by h) r from p)
select page_id, n::bigint payload_bytes, sha256(h) payload_digest,
       case when n >= {warc.MIN_REVISIT_BYTES} and page_id is distinct from r then 'revisit' else 'response' end record_type,
       case when n >= {warc.MIN_REVISIT_BYTES} and page_id is distinct from r then r end refers_to
from q
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the public 32k piece model and decoded again, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.digests(docs, public_tokenizers.path(PIECE_MODEL)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 16 principal axes of the distinct vectors, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark, and the rank of those that are drawn."""
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, packed into sequences of 1024, as a digest for each piece."""
    encoder = (public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    out = packing.pack(table(spark, sf_dir, "documents"), encoder)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_license_scans": op5_license_scans,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_warc": op8_warc,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "op8_warc": OP8_SQL}
