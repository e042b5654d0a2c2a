"""Queries over the corpus texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import boilerplate, detect, features, ngrams
from docloom.functions.text import collapse_whitespace, derive_id, file_name, normalize_native, normalize_text
from docloom.operators.ingest import MIN_CHARS_PER_PAGE
from docloom.plans.unicode_sql import nfkc
from docloom.session import table

#: What Python counts as white space, for engines whose \s is ASCII.
BLANK = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
NATIVE_SQL = f"trim(regexp_replace(regexp_replace(text, '({WORD})-{BLANK}*\\n{BLANK}*({WORD})', '\\1\\2', 'g'), '{BLANK}+', ' ', 'g'))"
LINES_SQL = f"""lines as (
  select doc_id, i, trim(regexp_replace(line, '{BLANK}+', ' ', 'g')) as text
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null)
)"""


def boilerplate_sql(source: str, document: str, keep: str, share: str = "0.6") -> str:
    """CTEs that clean ``text`` of ``source`` per ``document``; the result is ``cleaned``."""
    return f"""parts as (
  select {document} as d, {keep}, text, list_filter(list_transform(string_split(text, '. '), lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> '') as ss from {source}
), sized as (
  select d, count(*) as n from parts group by d having count(*) >= 3
), counted as (
  select d, s, count(*) as c from (select d, unnest(list_distinct(list_filter(ss, lambda x: length(x) >= 12))) as s from parts) group by d, s
), layout as (
  select counted.d as d, s from counted join sized on counted.d = sized.d where c >= cast({share} as double) * n
), per_doc as (
  select d, list(s) as lay from layout group by d
), cleaned as (
  select parts.d as {document}, {keep}, case when lay is null then text else trim(array_to_string(list_filter(ss, lambda x: not list_contains(lay, x)), '. ')) end as text
  from parts left join per_doc on parts.d = per_doc.d
)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.select("doc_id", "i", collapse_whitespace("text").alias("text")).where("text <> ''")


def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as documents of lines: cleaned, layout removed, figures and scan flag per document."""
    clean = boilerplate.strip_boilerplate(_lines(spark, sf_dir), "doc_id", "text")
    per = clean.where("text <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"))
    return per.withColumn("needs_ocr", F.col("chars") / F.col("segments") < MIN_CHARS_PER_PAGE)


def strip_boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after layout sentences have gone."""
    clean = boilerplate.strip_boilerplate(_lines(spark, sf_dir), "doc_id", "text")
    return clean.groupBy("doc_id").agg(F.count_if(F.col("text") == "").alias("emptied"), F.sum(F.length("text")).alias("chars"))


def strip_boilerplate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the archive without layout sentences."""
    rows = table(spark, sf_dir, "segments").select("segment_id", "document_id", "text").distinct()
    clean = boilerplate.strip_boilerplate(rows, "document_id", "text")
    return clean.select("segment_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal text with NFKC."""
    text = normalize_text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"))


def normalize_native_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal text without NFKC, wholly in the JVM."""
    text = normalize_native("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"))


def derive_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each text as a version of a file named after its source."""
    d = table(spark, sf_dir, "documents").where("source is not null and text is not null")
    return d.select("doc_id", derive_id("source", "text").alias("document_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


def derive_segment_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment identities derived anew, and whether the stored ones agree."""
    s = table(spark, sf_dir, "segments").select("segment_id", "document_id", "index").distinct()
    own = derive_id("document_id", F.col("index").cast("string"))
    return s.select("segment_id", own.alias("derived"), (own == F.col("segment_id")).alias("agrees"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as the text behind the last slash, held against the stored ones."""
    d = table(spark, sf_dir, "ingested_documents").select("document_id", "source_path", "file_name").distinct()
    return d.select("document_id", "source_path", file_name("source_path").alias("derived"), (file_name("source_path") == F.col("file_name")).alias("agrees"))


#: First bytes and name of a file made of a text, and its format: a text is that of row ``doc_id % 12``.
FILES = [
    (b"%PDF-1.7\n", "a.xlsx", "pdf"),
    (b"<!DOCTYPE html>\n", "a.bin", "html"),
    (b" \n\xef\xbb\xbf <HTML>", "a.dat", "html"),
    (b"From: a@x.example\r\nSubject: b\r\n\r\n", "a", "eml"),
    (b"Delivered-To: x\nDate: z\nTo: y\n\n", "a.txt", "eml"),
    (b"kein Kopf\n", "a.EML", "eml"),
    (b"kopf;zeile\n", "a.csv", "csv"),
    (b"kopf\tzeile\n", "a.TSV", "csv"),
    (b"<p>", "a.htm", "html"),
    (b"\x89PNG\r\n\x1a\n", "a.pdf", "image"),
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "a.eml", "msg"),
    (b"erste Zeile\n", "a.txt", "unknown"),
]


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of every text as a file of one of twelve kinds, by its bytes and its name."""
    kind = F.element_at(F.array(*(F.struct(F.lit(h).alias("head"), F.lit(n).alias("name")) for h, n, _ in FILES)), (F.col("doc_id") % len(FILES) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(kind["head"], F.coalesce("text", F.lit("")).cast("binary")).alias("content"), kind["name"].alias("name"))
    fmt = detect.detect_format("content", "name")
    return d.select("doc_id", fmt.alias("format")).withColumn("media_type", detect.media_type("format"))


def structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = features.structural(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in figures.items()))


def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some forty structural figures and marks of origin of every ingested document."""
    docs = table(spark, sf_dir, "ingested_documents").groupBy("document_id").agg(*(F.min(c).alias(c) for c in ("media_type", "ocr_applied", "file_name", "parent_document_id")))
    segs = table(spark, sf_dir, "segments").select("segment_id", "document_id", "index", "heading", "text").distinct()
    return features.document_structure(docs, segs)


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of four as the chunks of one document: the first coordinate and the length of their weighted mean."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("document"), (F.col("vec_id") % 4).alias("i"), "embedding")
    v = features.weighted_mean(e, "document", "i", "embedding")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("document", F.round(F.element_at("embedding", 1), 6).alias("first"), F.round(F.sqrt(square), 6).alias("norm"))


def char_ngram_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten strongest character n-grams of each document."""
    return ngrams.strongest(table(spark, sf_dir, "documents"), "doc_id", "text", 10)


def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term and document frequency of every word of the corpus."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(features.words(F.col("text"))).alias("word"))
    per = d.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


def pmi_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty words that say most about each class."""
    d = table(spark, sf_dir, "documents").select("doc_id", "class_key", F.explode(F.array_distinct(features.words(F.col("text")))).alias("word"))
    p = features.pmi(d, "doc_id", "word", "class_key").withColumn("pmi", F.round("pmi", 6))
    return features.top_per_group(p, "class_key", [F.desc("pmi"), F.desc("n"), F.col("word")], 20).select("class_key", F.col("rank").cast("bigint").alias("rank"), "word", "n", "pmi")


def heading_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a segment's text is in its heading, by character 5-grams."""
    s = table(spark, sf_dir, "segments").where("heading is not null and text is not null").select("segment_id", "heading", "text").distinct()
    h, t = (F.array_distinct(features.char_ngrams(F.col(c), 5, 5)) for c in ("heading", "text"))
    return s.select("segment_id", F.size(h).cast("bigint").alias("heading_grams"), F.size(t).cast("bigint").alias("text_grams"), F.round(features.jaccard(h, t), 6).alias("similarity"))


def chunk_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the texts with their position weights, and the head that stands for itself."""
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''").select("doc_id", features.chunks(F.col("text")).alias("c"))
    d = d.withColumn("w", features.position_weights(F.size("c")))
    return d.select("doc_id", F.posexplode(F.arrays_zip("c", "w")).alias("i", "z")).select("doc_id", F.col("i").cast("bigint").alias("i"), F.length("z.c").cast("bigint").alias("chars"), F.round("z.w", 6).alias("weight"), F.md5(F.concat(F.lit("passage: "), F.substring("z.c", 1, 1000))).alias("head_digest"))


QUERIES = {
    f.__name__: f
    for f in (document_profile, strip_boilerplate_lines, strip_boilerplate_segments, normalize_documents, normalize_native_documents, derive_document_id, derive_segment_id, file_names, detect_documents, structural_features, document_structure, document_vectors, char_ngram_tfidf, word_frequencies, pmi_keywords, heading_similarity, chunk_weights)
}

_WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_GRAMS_SQL = f"""tokens as (
  select doc_id, ' ' || w || ' ' as p from (select doc_id, unnest({_WORDS_SQL}) as w from documents)
), grams as (
  select doc_id, substr(p, i, n) as gram from (select doc_id, p, n, unnest(generate_series(1, length(p) - n + 1)) as i from tokens, (select unnest([3, 4, 5]) as n) where length(p) >= n)
)"""

def _structure_sql() -> str:
    quoted = {n: p.replace("'", "''") for n, p in features.COUNTED.items()}
    counts = ", ".join(f"sum(len(regexp_extract_all(t, '{p}'))) as {n}" for n, p in quoted.items())
    zero = ", ".join(f"cast(coalesce({n}, 0) as bigint) as {n}" for n in ("segments", "chars", "places", "headings", "short_segments", "longest_segment", *quoted))
    return f"""with seg as (select distinct segment_id, document_id, "index", heading, text from segments), s as (select *, coalesce(text, '') as t from seg),
own as (select document_id, count(*) as segments, sum(length(t)) as chars, max(coalesce("index", 0) + 1) as places, count(heading) as headings, count(*) filter (where length(t) < 40) as short_segments, max(length(t)) as longest_segment, {counts} from s group by 1),
docs as (select document_id, min(media_type) as media_type, min(ocr_applied) as ocr_applied, min(file_name) as file_name, min(parent_document_id) as parent_document_id from ingested_documents where document_id is not null group by 1),
j as (select docs.document_id as document_id, {zero}, media_type as mt, ocr_applied as oa, file_name, parent_document_id from docs left join own on docs.document_id = own.document_id)
select * exclude (mt, oa, file_name, parent_document_id), case when chars > 0 then round(digits / cast(chars as double), 6) end as digit_share, case when chars > 0 then round(dates / cast(chars as double), 6) end as date_density,
case when places > 0 then round(chars / cast(places as double), 6) end as chars_per_place, case when chars > 0 then round(cell_marks / cast(chars as double), 6) end as cell_mark_share, case when segments > 0 then round(short_segments / cast(segments as double), 6) end as short_share,
lower(trim(mt)) as media_type, coalesce(oa, false) as ocr_applied, parent_document_id is not null as attached, len(regexp_extract_all(file_name, '[A-Za-z]+')) as name_tokens from j"""


ORACLE = {
    "document_profile": f"""with {LINES_SQL}, filled as (select * from lines where text <> ''), {boilerplate_sql("filled", "doc_id", "i")}
select doc_id, count(*) as segments, cast(sum(length(text)) as bigint) as chars, sum(length(text)) / count(*) < 40 as needs_ocr from cleaned where text <> '' group by doc_id""",
    "strip_boilerplate_lines": f"""with {LINES_SQL}, filled as (select * from lines where text <> ''), {boilerplate_sql("filled", "doc_id", "i")}
select doc_id, count(*) filter (where text = '') as emptied, cast(sum(length(text)) as bigint) as chars from cleaned group by doc_id""",
    "strip_boilerplate_segments": f"""with rows as (select distinct segment_id, document_id, text from segments), {boilerplate_sql("rows", "document_id", "segment_id")}
select segment_id, length(text) as chars, md5(text) as digest from cleaned""",
    "normalize_native_documents": f"select doc_id, length({NATIVE_SQL}) as chars, md5({NATIVE_SQL}) as digest from documents",
    "derive_document_id": "select doc_id, substr(sha256(source || chr(0) || text || chr(0)), 1, 32) as document_id, sha256(text) as content_sha256, strlen(text) as size_bytes from documents where source is not null and text is not null",
    "derive_segment_id": """select segment_id, derived, derived = segment_id as agrees from (
  select segment_id, substr(sha256(document_id || chr(0) || cast("index" as varchar) || chr(0)), 1, 32) as derived from (select distinct segment_id, document_id, "index" from segments))""",
    "file_names": "select document_id, source_path, regexp_replace(source_path, '^.*/', '') as derived, regexp_replace(source_path, '^.*/', '') = file_name as agrees from (select distinct document_id, source_path, file_name from ingested_documents)",
    "detect_documents": f"""select doc_id, f[doc_id % {len(FILES)} + 1] as format, m[doc_id % {len(FILES)} + 1] as media_type from documents,
(select {[f for _, _, f in FILES]} as f, {[detect.MEDIA_TYPES[f] for _, _, f in FILES]} as m)""",
    "normalize_documents": f"select doc_id, length(t) as chars, md5(t) as digest from (select doc_id, {NATIVE_SQL.replace('text', 'n')} as t from (select doc_id, {nfkc('text')} as n from documents))",
    "structural_features": r"""select doc_id, length(text) as chars, len(l) as lines,
  round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) as digit_share,
  round(length(regexp_replace(text, '[^A-ZÄÖÜ]', '', 'g')) / greatest(length(text), 1), 6) as upper_share,
  len(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}\s*(?:€|EUR)')) as amounts,
  len(regexp_extract_all(text, '[0-9]+(?:,[0-9]+)? ?%')) as percents,
  len(regexp_extract_all(text, '\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) as dates,
  len(regexp_extract_all(text, '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b')) as ibans,
  len(regexp_extract_all(text, '\bDE[0-9]{9}\b')) as vat_ids,
  len(regexp_extract_all(text, '§ ?[0-9]+')) as paragraphs,
  len(list_filter(l, lambda x: length(x) < 20)) as short_lines,
  len(list_filter(l, lambda x: contains(x, '|') or contains(x, chr(9)))) as table_lines
from (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '') as l from documents)""",
    "document_structure": _structure_sql(),
    "document_vectors": """with e as (select vec_id // 4 as document, 1 / (1 + (vec_id % 4) / 4.0) as w, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x from embeddings),
m as (select document, i, sum(w * x) / sum(w) as m from e group by 1, 2) select document, round(max(case when i = 1 then m end), 6) as first, round(sqrt(sum(m * m)), 6) as norm from m group by 1""",
    "char_ngram_tfidf": f"""with {_GRAMS_SQL}, tf as (select doc_id, gram, count(*) as n from grams group by 1, 2), df as (select gram, count(*) as d from tf group by 1), total as (select count(distinct doc_id) as c from tf),
w as (select doc_id, tf.gram as gram, round((1 + ln(n)) * ln(cast(c as double) / d), 6) as weight from tf join df on tf.gram = df.gram, total)
select doc_id, rank, gram, weight from (select doc_id, gram, weight, row_number() over (partition by doc_id order by weight desc, gram) as rank from w) where rank <= 10""",
    "word_frequencies": f"""select word, cast(sum(n) as bigint) as occurrences, count(*) as documents from (select word, doc_id, count(*) as n from (select doc_id, unnest({_WORDS_SQL}) as word from documents) group by 1, 2) group by 1""",
    "pmi_keywords": f"""with t as (select distinct doc_id, class_key, unnest({_WORDS_SQL}) as word from documents where class_key is not null), joint as (select class_key, word, count(*) as n from t group by 1, 2),
per as (select word, sum(n) as nt from joint group by 1 having sum(n) >= 5), labels as (select class_key, count(distinct doc_id) as nl from t group by 1), total as (select sum(nl) as c from labels),
p as (select joint.class_key as class_key, joint.word as word, n, round(ln(n * cast(c as double) / (nt * nl)), 6) as pmi from joint join per on joint.word = per.word join labels on joint.class_key = labels.class_key, total)
select class_key, rank, word, n, pmi from (select class_key, word, n, pmi, row_number() over (partition by class_key order by pmi desc, n desc, word) as rank from p) where rank <= 20""",
    "heading_similarity": f"""with s as (select distinct segment_id, heading, text from segments where heading is not null and text is not null),
hg as (select distinct segment_id, substr(p, i, 5) as g from (select segment_id, p, unnest(generate_series(1, length(p) - 4)) as i from (select segment_id, ' ' || unnest({_WORDS_SQL.replace("text", "heading")}) || ' ' as p from s))),
tg as (select distinct segment_id, substr(p, i, 5) as g from (select segment_id, p, unnest(generate_series(1, length(p) - 4)) as i from (select segment_id, ' ' || unnest({_WORDS_SQL}) || ' ' as p from s))),
h as (select segment_id, count(*) as n from hg group by 1), t as (select segment_id, count(*) as n from tg group by 1), c as (select hg.segment_id as segment_id, count(*) as n from hg join tg on hg.segment_id = tg.segment_id and hg.g = tg.g group by 1)
select s.segment_id as segment_id, coalesce(h.n, 0) as heading_grams, coalesce(t.n, 0) as text_grams, case when coalesce(h.n, 0) + coalesce(t.n, 0) > 0 then round(coalesce(c.n, 0) / cast(coalesce(h.n, 0) + coalesce(t.n, 0) - coalesce(c.n, 0) as double), 6) else 0.0 end as similarity
from s left join h on s.segment_id = h.segment_id left join t on s.segment_id = t.segment_id left join c on s.segment_id = c.segment_id""",
    "chunk_weights": """with c as (select doc_id, text, cast(ceil(length(text) / 1200.0) as bigint) as n from documents where text is not null and text <> ''), e as (select doc_id, text, n, unnest(generate_series(0, n - 1)) as i from c),
w as (select doc_id, i, substr(text, i * 1200 + 1, 1200) as t, 1 / (1 + i / 4) as r, n from e), s as (select doc_id, sum(r) as total from w group by 1)
select w.doc_id as doc_id, i, length(t) as chars, round(r / total, 6) as weight, md5('passage: ' || substr(t, 1, 1000)) as head_digest from w join s on w.doc_id = s.doc_id""",
}
