"""Text features: character n-grams, structural figures, keyword information, position weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMOUNT = r"[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2}\s*(?:€|EUR)"
PERCENT = r"[0-9]+(?:,[0-9]+)? ?%"
DATE = r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b"
VAT_ID = r"\bDE[0-9]{9}\b"
PARAGRAPH = r"§ ?[0-9]+"
WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD), lambda w: w != "")


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words padded by one blank on each side; every occurrence."""

    def of(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)
        none = F.array().cast("array<string>")

        def exactly(n: int) -> Column:
            return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(none)

        grams = [exactly(n) for n in range(low, high + 1)]
        return F.concat(*grams) if len(grams) > 1 else grams[0]

    return F.flatten(F.transform(words(text), of))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def tf_idf(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """``(doc, term, weight)`` with tf = 1 + ln(count) and idf = ln(N / df), N being the documents with terms.

    Counts are partial aggregates; the only rows that meet in the join are one per document and term.
    """
    tf = terms.groupBy(doc, term).agg(F.count(F.lit(1)).alias("__n"))
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("__df"))
    total = tf.select(doc).distinct().agg(F.count(F.lit(1)).alias("__total"))
    # One row: the count of documents.
    n = total.first()[0]
    return tf.join(df, term).select(doc, term, ((1 + F.log("__n")) * F.log(F.lit(float(n)) / F.col("__df"))).alias("weight"))


def structural(text: Column) -> dict[str, Column]:
    """Figures of a text's structure (null text: null)."""
    size = F.greatest(F.length(text), F.lit(1))
    bare = lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda x: x != "")
    return {
        "chars": F.length(text).cast("bigint"),
        "lines": F.size(lines).cast("bigint"),
        "digit_share": F.round(F.length(F.regexp_replace(text, "[^0-9]", "")) / size, 6),
        "upper_share": F.round(F.length(F.regexp_replace(text, "[^A-ZÄÖÜ]", "")) / size, 6),
        "amounts": F.regexp_count(text, F.lit(AMOUNT)).cast("bigint"),
        "percents": F.regexp_count(text, F.lit(PERCENT)).cast("bigint"),
        "dates": F.regexp_count(text, F.lit(DATE)).cast("bigint"),
        "ibans": F.regexp_count(text, F.lit(IBAN)).cast("bigint"),
        "vat_ids": F.regexp_count(text, F.lit(VAT_ID)).cast("bigint"),
        "paragraphs": F.regexp_count(text, F.lit(PARAGRAPH)).cast("bigint"),
        "short_lines": F.size(F.filter(lines, lambda x: F.length(x) < 20)).cast("bigint"),
        "table_lines": F.size(F.filter(lines, lambda x: x.contains("|") | x.contains("\t"))).cast("bigint"),
    }


def pmi(terms: DataFrame, doc: str, term: str, label: str, least: int = 5) -> DataFrame:
    """Pointwise mutual information ``ln(p(term, label) / (p(term) p(label)))`` by documents.

    ``terms`` has rows of doc, label and term (repeats count once); terms in fewer than ``least`` documents
    are left out. Documents without a label play no part.
    """
    rows = terms.where(F.col(label).isNotNull()).select(doc, label, term).distinct()
    joint = rows.groupBy(term, label).agg(F.count(F.lit(1)).alias("n"))
    per_term = joint.groupBy(term).agg(F.sum("n").alias("n_term")).where(F.col("n_term") >= least)
    labels = terms.where(F.col(label).isNotNull()).select(doc, label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    # As many rows as there are classes.
    n = labels.agg(F.sum("n_label")).first()[0] or 0
    return joint.join(per_term, term).join(labels, label).select(label, term, "n", F.log(F.col("n") * F.lit(float(n)) / (F.col("n_term") * F.col("n_label"))).alias("pmi"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def chunks(text: Column, size: int = 1200) -> Column:
    """Consecutive pieces of ``size`` characters; none of an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def position_weights(n: Column) -> Column:
    """Weights ``1 / (1 + i / 4)`` of n chunks, scaled to a sum of one."""
    raw = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 1 / (1 + i / 4))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, F.transform(raw, lambda x: x / total))


def require_version(df: DataFrame, version: str, column: str = "feature_version") -> DataFrame:
    """``df`` if all its rows have the version a model was trained with; else an error that names the others."""
    other = [r[0] for r in df.where(~F.col(column).eqNullSafe(F.lit(version))).select(column).distinct().limit(10).collect()]
    if other:
        raise ValueError(f"features of version {version} are needed, there are also {', '.join(sorted(map(str, other)))}")
    return df


#: Kinds of figures that are counted in the text of every segment, as patterns both Java and RE2 read alike.
COUNTED = {
    "digits": "[0-9]",
    "amounts": AMOUNT,
    "percents": PERCENT,
    "ibans": IBAN,
    "vat_ids": VAT_ID,
    "tax_numbers": r"\b[0-9]{2,3}/[0-9]{3}/[0-9]{4,5}\b",
    "reference_numbers": r"\b[A-Z]{2,}-[0-9]{3,}\b",
    "dates": DATE,
    "mail_addresses": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+",
    "links": "https?://",
    "phone_numbers": r"\+?[0-9]{2,5}[ /-][0-9]{4,}",
    "cell_marks": r"\|",
    "colons": ":",
    "questions": r"\?",
    "brackets": "[(]",
    "signature_lines": "(?i)unterschrift|gez[.]|_____",
    "paragraph_marks": "§",
    "agenda_items": r"\bTOP [0-9]+",
    "payment_terms": "(?i)zahlungsziel",
    "credit_words": "(?i)gutschrift",
    "contract_words": "(?i)vertragspartner",
    "attendance_words": "(?i)anwesend",
    "notice_words": "(?i)kündigungsfrist",
}


def document_structure(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """One row per document with its structural figures and its origin.

    Counts are summed over segments (partial aggregates), so a document of any number of segments is no task of its
    own; shares and densities follow from the sums. A document without text has zero counts and null shares. ``documents`` has one row
    per document (``document_id, media_type, ocr_applied, file_name, parent_document_id``), ``segments`` distinct segments.
    """
    text = F.coalesce("text", F.lit(""))
    counts = [F.sum(F.regexp_count(text, F.lit(p))).alias(n) for n, p in COUNTED.items()]
    size = F.length(text)
    own = segments.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(size).alias("chars"),
        F.max(F.coalesce("index", F.lit(0)) + 1).alias("places"),
        F.count("heading").alias("headings"),
        F.count_if(size < 40).alias("short_segments"),
        F.max(size).alias("longest_segment"),
        *counts,
    )
    names = ["segments", "chars", "places", "headings", "short_segments", "longest_segment", *COUNTED]
    j = documents.join(own, "document_id", "left").na.fill(0, names)
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    shares = {"digit_share": share("digits", "chars"), "date_density": share("dates", "chars"), "chars_per_place": share("chars", "places"), "cell_mark_share": share("cell_marks", "chars"), "short_share": share("short_segments", "segments")}
    origin = {"media_type": F.lower(F.trim("media_type")), "ocr_applied": F.coalesce("ocr_applied", F.lit(False)), "attached": F.col("parent_document_id").isNotNull(), "name_tokens": F.regexp_count("file_name", F.lit("[A-Za-z]+")).cast("bigint")}
    return j.select("document_id", *(F.col(n).cast("bigint").alias(n) for n in names), *(c.alias(n) for n, c in {**shares, **origin}.items()))


def weighted_mean(chunks: DataFrame, document: str, position: str, vector: str) -> DataFrame:
    """``(document, vector)``: the mean of a document's chunk vectors with the weights ``1 / (1 + i / 4)``, ``i`` from 0.

    Sums are partial aggregates per document and coordinate. Null vectors are left out.
    """
    w = 1 / (1 + F.col(position) / 4)
    rows = chunks.where(F.col(vector).isNotNull()).select(F.col(document).alias("d"), w.alias("w"), F.posexplode(vector).alias("at", "x"))
    per = rows.groupBy("d", "at").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    return per.groupBy("d").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias(vector)).withColumnRenamed("d", document)
