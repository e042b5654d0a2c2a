"""Queries over the archive: documents, segments, manifest, splits and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import labels, manifest
from docloom.operators.ingest import needs_ocr
from docloom.operators.running import previous
from docloom.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ingested_documents").distinct()


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document at its earliest batch."""
    return table(spark, sf_dir, "ingested_documents").groupBy("document_id").agg(F.min("ingested_at").alias("at"))


def _segs(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    """Segments without repeated rows; only what is asked for is shuffled, figures of texts instead of texts."""
    return table(spark, sf_dir, "segments").select("segment_id", *columns).distinct()


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "manifest").distinct()
    return m.withColumns({"class_key": F.upper(F.trim("class_key")), "split": F.lower(F.trim("split"))})


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.events(table(spark, sf_dir, "label_events"))


def media_type_summary(spark, sf_dir):
    """Documents and scans per media type."""
    d = table(spark, sf_dir, "ingested_documents").select("document_id", "ingested_at", F.lower("media_type").alias("media_type"), "needs_ocr").distinct().groupBy("media_type")
    return d.agg(F.count(F.lit(1)).alias("documents"), F.count_if("needs_ocr").alias("scans"))


def segment_kind_summary(spark, sf_dir):
    """Segments and mean length per kind."""
    s = _segs(spark, sf_dir, "kind", F.length("text").alias("n"))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("segments"), F.round(F.avg("n"), 4).alias("mean_chars"), F.sum("n").alias("chars"))


def run_counters(spark, sf_dir):
    """What each batch brought: rows, new documents, attachments, scans."""
    d = table(spark, sf_dir, "ingested_documents").join(_first(spark, sf_dir), "document_id")
    fresh = F.col("ingested_at") == F.col("at")
    return d.groupBy(F.unix_micros("ingested_at").alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(fresh, F.col("document_id"))).alias("new"), F.count_if(~fresh).alias("skipped"), F.count_distinct(F.when(fresh & F.col("parent_document_id").isNotNull(), F.col("document_id"))).alias("attachments"), F.count_if("needs_ocr").alias("scans"))


def incremental_new(spark, sf_dir):
    """Documents of the last batch that no batch before had: an anti join on identity."""
    d = table(spark, sf_dir, "ingested_documents").select("document_id", "source_path", "ingested_at")
    last = d.agg(F.max("ingested_at")).first()[0]
    known = d.where(F.col("ingested_at") < F.lit(last)).select("document_id")
    return d.where(F.col("ingested_at") == F.lit(last)).join(known, "document_id", "left_anti").select("document_id", "source_path").distinct()


def empty_documents(spark, sf_dir):
    """Documents without a segment."""
    s = table(spark, sf_dir, "segments").where("text <> ''").select("document_id")
    return _docs(spark, sf_dir).select("document_id", "source_path").distinct().join(s, "document_id", "left_anti")


def orphan_segments(spark, sf_dir):
    """Segments whose document does not exist: the referential check, by kind."""
    d = table(spark, sf_dir, "ingested_documents").select("document_id")
    s = _segs(spark, sf_dir, "document_id", "kind")
    bad = s.join(d, "document_id", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("orphans"))
    return s.select("kind").distinct().join(bad, "kind", "left").select("kind", F.coalesce("orphans", F.lit(0)).alias("orphans"))


def needs_ocr_flag(spark, sf_dir):
    """The scan flag anew: characters per page, a page being a segment index up to the largest."""
    s = _segs(spark, sf_dir, "document_id", "index", F.length("text").alias("n")).groupBy("document_id").agg(F.sum("n").alias("chars"), (F.max("index") + 1).alias("pages"))
    d = _docs(spark, sf_dir).select("document_id", F.when(F.lower("media_type") == "application/pdf", "pdf").otherwise("other").alias("format")).distinct()
    j = d.join(s, "document_id", "left").na.fill(0, ["chars", "pages"])
    return j.select("document_id", "format", "chars", "pages", needs_ocr(F.col("format"), F.col("chars"), F.col("pages")).alias("needs_ocr"))


def path_versions(spark, sf_dir):
    """Paths with several versions, oldest and newest."""
    d = _docs(spark, sf_dir).groupBy("source_path").agg(F.count_distinct("document_id").alias("versions"), F.min_by("document_id", F.struct("ingested_at", "document_id")).alias("oldest"), F.max_by("document_id", F.struct("ingested_at", "document_id")).alias("newest"))
    return d.where("versions > 1")


def attachment_tree(spark, sf_dir):
    """Every document with its root and its depth in the forest of mails; pointers are doubled, so any depth is a few joins."""
    d = _docs(spark, sf_dir).select("document_id", "parent_document_id").distinct()
    return labels.forest(d, "document_id", "parent_document_id")


def split_counts(spark, sf_dir):
    """Records per class and split."""
    return _manifest(spark, sf_dir).groupBy("class_key", "split").agg(F.count(F.lit(1)).alias("records"))


def split_pivot(spark, sf_dir):
    """Records per class with a column for each split; every class should be in each."""
    m = _manifest(spark, sf_dir).where("class_key is not null")
    p = m.groupBy("class_key").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("gold", "train", "calib")))
    return p.withColumn("complete", (F.col("gold") > 0) & (F.col("train") > 0) & (F.col("calib") > 0))


def class_coverage(spark, sf_dir):
    """Per class: records, templates, formats, and whether there are two formats at least."""
    m = _manifest(spark, sf_dir).where("class_key is not null")
    return m.groupBy("class_key").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("template_id").alias("templates"), F.count_distinct("format").alias("formats")).withColumn("covered", F.col("formats") >= 2)


def format_coverage(spark, sf_dir):
    """Per format: classes, and whether there are three at least."""
    return _manifest(spark, sf_dir).groupBy("format").agg(F.count_distinct("class_key").alias("classes")).withColumn("covered", F.col("classes") >= 3)


def template_variants(spark, sf_dir):
    """Per template: records and distinct variants."""
    return _manifest(spark, sf_dir).where("template_id is not null").groupBy("template_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("variant").alias("variants"))


def assign_splits_ranked(spark, sf_dir):
    """Splits of all templates: frozen ones stay, new ones fill the places of their class."""
    return manifest.rank_splits(_manifest(spark, sf_dir).select("class_key", "template_id"), table(spark, sf_dir, "splits"))


def template_drift(spark, sf_dir):
    return manifest.drift(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "splits"))


def best_guesser_bound(spark, sf_dir):
    """What format and number of segments give away about the class, and what the folder does."""
    d = _docs(spark, sf_dir).select("document_id", "source_path").distinct()
    n = _segs(spark, sf_dir, "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("segments"))
    m = _manifest(spark, sf_dir).where("class_key is not null").select("source_path", "class_key", "format")
    j = m.join(d, "source_path").join(n, "document_id").withColumn("folder", F.substring_index("source_path", "/", 1))
    a = manifest.best_guess(j, ["format", "segments"], "class_key").withColumn("feature", F.lit("format and segments"))
    return a.unionByName(manifest.best_guess(j, ["folder"], "class_key").withColumn("feature", F.lit("folder")))


def stem_token_counts(spark, sf_dir):
    """Alphabetic tokens of file names and how many records have them."""
    t = _manifest(spark, sf_dir).select("source_path", F.explode(F.array_distinct(manifest.stem_tokens(F.col("source_path")))).alias("token"))
    return t.groupBy("token").agg(F.count_distinct("source_path").alias("paths"))


def label_join(spark, sf_dir):
    """Ingested documents with their manifest record; attachments stay without a label."""
    d = _docs(spark, sf_dir).select("document_id", "source_path").distinct()
    m = _manifest(spark, sf_dir).select("source_path", "class_key", "template_id", "split")
    return d.join(m, "source_path", "left")


def exact_leakage(spark, sf_dir):
    """Digests of equal segment texts that occur in train and in gold or calib, with their counts."""
    side = _manifest(spark, sf_dir).where("split is not null").select("source_path", (F.col("split") == "train").alias("train")).distinct()
    d = _docs(spark, sf_dir).select("document_id", "source_path").distinct().join(side, "source_path")
    s = _segs(spark, sf_dir, "document_id", F.md5(F.lower("text")).alias("digest"))
    g = s.join(d.select("document_id", "train").distinct(), "document_id").groupBy("digest").agg(F.count_distinct(F.when(F.col("train"), F.col("segment_id"))).alias("train"), F.count_distinct(F.when(~F.col("train"), F.col("segment_id"))).alias("evaluation"))
    return g.where("train > 0 and evaluation > 0")


def latest_label(spark, sf_dir):
    """The current label of each document."""
    return labels.current(_labels(spark, sf_dir)).select("document_id", "event_id", "class_key", "source")


def supersede_chains(spark, sf_dir):
    """Documents relabelled twice or more along a chain of events."""
    return labels.chains(_labels(spark, sf_dir)).where("length >= 2")


def label_snapshot(spark, sf_dir):
    """Hash of the current labels, independent of order."""
    return labels.snapshot_hash(labels.current(_labels(spark, sf_dir)), ["document_id", "class_key", "source"])


def label_weights(spark, sf_dir):
    """Training weight per class from current labels; corrections count double for a time."""
    e = _labels(spark, sf_dir)
    c = labels.current(e)
    corrected = e.select(F.col("event_id"), F.col("supersedes").isNotNull().alias("corrected"))
    c = c.join(corrected, "event_id")
    return c.groupBy("class_key").agg(F.count(F.lit(1)).alias("labels"), F.round(F.sum(labels.weight(F.col("source"))), 4).alias("weight"), F.round(F.sum(labels.weight(F.col("source"), F.col("corrected"))), 4).alias("corrected_weight"))


def gold_provenance(spark, sf_dir):
    """Sources of the current labels of gold documents, and whether they are allowed there."""
    d = label_join(spark, sf_dir).where("split = 'gold'").select("document_id").distinct()
    c = labels.current(_labels(spark, sf_dir)).join(d, "document_id", "left_semi")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("documents")).withColumn("allowed", F.col("source").isin(*labels.GOLD_SOURCES))


def unknown_label_documents(spark, sf_dir):
    """Events about documents that do not exist, by source."""
    d = table(spark, sf_dir, "ingested_documents").select("document_id")
    return _labels(spark, sf_dir).join(d, "document_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("events"))


def contradicting_labels(spark, sf_dir):
    """Documents with labels of several classes, and the classes in order."""
    e = _labels(spark, sf_dir).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("class_key")), ",").alias("classes"), F.count_distinct("class_key").alias("n"))
    return e.where("n > 1")


def cohens_kappa(spark, sf_dir):
    """Agreement of the first two labels of documents labelled twice."""
    return labels.agreement(labels.first_two_labels(_labels(spark, sf_dir)), "first", "second")


def relapse_rate(spark, sf_dir):
    """Share of documents whose label was corrected and is contradicted by the manifest again."""
    c = labels.current(_labels(spark, sf_dir)).select("document_id", F.col("class_key").alias("now"))
    fixed = _labels(spark, sf_dir).where("supersedes is not null").select("document_id").distinct()
    t = label_join(spark, sf_dir).where("class_key is not null").select("document_id", "class_key").distinct()
    j = c.join(fixed, "document_id", "left_semi").join(t, "document_id")
    return j.agg(F.count(F.lit(1)).alias("corrected"), F.count_if(F.col("now") != F.col("class_key")).alias("wrong"), F.round(F.avg((F.col("now") != F.col("class_key")).cast("double")), 6).alias("rate"))


def mail_inheritance(spark, sf_dir):
    """Attachments with subject and sender domain of their mail."""
    return labels.with_parent_mail(_docs(spark, sf_dir), table(spark, sf_dir, "segments")).select("document_id", "subject", "sender_domain")


def page_cuts(spark, sf_dir):
    """Places within documents where the kind or heading of consecutive segments changes."""
    s = _segs(spark, sf_dir, "document_id", "index", "kind", F.coalesce("heading", F.lit("")).alias("heading"))
    s = previous(s, "document_id", "index", ["segment_id"], ["kind", "heading"]).where("previous is not null and (previous.kind <> kind or previous.heading <> heading)")
    return s.select("document_id", "index", "segment_id", F.col("previous.kind").alias("before_kind"), F.col("kind").alias("after_kind"))


def review_drift(spark, sf_dir):
    """Share of reviewed (human) labels per month."""
    e = _labels(spark, sf_dir)
    return e.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("source") == "human").alias("reviewed"), F.round(F.avg((F.col("source") == "human").cast("double")), 6).alias("share"))


def actor_load(spark, sf_dir):
    """Labels, classes and notes per actor; skewed, but every figure is a partial aggregate."""
    e = _labels(spark, sf_dir)
    return e.groupBy(F.coalesce("actor", F.lit("-")).alias("actor")).agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("class_key").alias("classes"), F.count_if(F.length(F.trim("note")) > 0).alias("notes"))


QUERIES = {
    f.__name__: f
    for f in (media_type_summary, segment_kind_summary, run_counters, incremental_new, empty_documents, orphan_segments, needs_ocr_flag, path_versions, attachment_tree, split_counts, split_pivot, class_coverage, format_coverage, template_variants, assign_splits_ranked, template_drift, best_guesser_bound, stem_token_counts, label_join, exact_leakage, latest_label, supersede_chains, label_snapshot, label_weights, gold_provenance, unknown_label_documents, contradicting_labels, cohens_kappa, relapse_rate, mail_inheritance, page_cuts, review_drift, actor_load)
}

_DOCS = "docs as (select distinct * from ingested_documents)"
_SEGS = 'segs as (select distinct * from segments)'
_MAN = "man as (select distinct source_path, upper(trim(class_key)) as class_key, template_id, variant, lower(trim(split)) as split, format from manifest)"
_EV = "ev as (select event_id, min(document_id) as document_id, min(class_key) as class_key, min(source) as source, min(actor) as actor, min(created_at) as created_at, min(note) as note, min(supersedes) as supersedes from label_events group by event_id)"
_CUR = "cur as (select * from (select *, row_number() over (partition by document_id order by created_at desc, event_id desc) as rn from ev) where rn = 1)"
_PATHS = "paths as (select distinct document_id, source_path from ingested_documents)"
_LAB = "lab as (select p.document_id as document_id, p.source_path as source_path, m.class_key as class_key, m.template_id as template_id, m.split as split from paths p left join man m on p.source_path = m.source_path)"

ORACLE = {
    "media_type_summary": f"with {_DOCS} select lower(media_type) as media_type, count(*) as documents, count(*) filter (where needs_ocr) as scans from docs group by 1",
    "segment_kind_summary": f"with {_SEGS} select kind, count(*) as segments, round(avg(length(text)), 4) as mean_chars, cast(sum(length(text)) as bigint) as chars from segs group by 1",
    "run_counters": """with f as (select document_id, min(ingested_at) as first_at from ingested_documents group by 1)
select epoch_us(ingested_at) as batch, count(*) as rows, count(distinct case when ingested_at = first_at then d.document_id end) as new, count(*) filter (where ingested_at <> first_at) as skipped,
count(distinct case when ingested_at = first_at and parent_document_id is not null then d.document_id end) as attachments, count(*) filter (where needs_ocr) as scans
from ingested_documents d join f on d.document_id = f.document_id group by 1""",
    "incremental_new": """with l as (select max(ingested_at) as m from ingested_documents) select distinct document_id, source_path from ingested_documents, l where ingested_at = m
and document_id not in (select document_id from ingested_documents, l where ingested_at < m)""",
    "empty_documents": "select distinct document_id, source_path from ingested_documents where document_id not in (select document_id from segments where text <> '')",
    "orphan_segments": f"with {_SEGS} select kind, count(*) filter (where document_id not in (select document_id from ingested_documents)) as orphans from segs group by 1",
    "needs_ocr_flag": f"""with {_DOCS}, {_SEGS}, s as (select document_id, sum(length(text)) as chars, max("index") + 1 as pages from segs group by 1),
d as (select distinct document_id, case when lower(media_type) = 'application/pdf' then 'pdf' else 'other' end as format from docs),
j as (select d.document_id as document_id, format, cast(coalesce(chars, 0) as bigint) as chars, coalesce(pages, 0) as pages from d left join s on d.document_id = s.document_id)
select document_id, format, chars, pages, case when format <> 'pdf' then false when pages = 0 then true else chars / pages < 40 end as needs_ocr from j""",
    "path_versions": f"""with {_DOCS}, r as (select source_path, document_id, row_number() over (partition by source_path order by ingested_at, document_id) as a, row_number() over (partition by source_path order by ingested_at desc, document_id desc) as z from docs),
v as (select source_path, count(distinct document_id) as versions from docs group by 1 having count(distinct document_id) > 1)
select v.source_path as source_path, versions, x.document_id as oldest, y.document_id as newest from v join r x on x.source_path = v.source_path and x.a = 1 join r y on y.source_path = v.source_path and y.z = 1""",
    "attachment_tree": """with recursive t(document_id, root, depth) as (
  select distinct document_id, document_id, cast(0 as bigint) from ingested_documents where parent_document_id is null
  union all select c.document_id, t.root, t.depth + 1 from (select distinct document_id, parent_document_id from ingested_documents) c join t on c.parent_document_id = t.document_id)
select document_id, root, depth from t""",
    "split_counts": f"with {_MAN} select class_key, split, count(*) as records from man group by 1, 2",
    "split_pivot": f"""with {_MAN}, p as (select class_key, count(*) filter (where split = 'gold') as gold, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'calib') as calib from man where class_key is not null group by 1)
select class_key, gold, train, calib, gold > 0 and train > 0 and calib > 0 as complete from p""",
    "class_coverage": f"with {_MAN} select class_key, count(*) as records, count(distinct template_id) as templates, count(distinct format) as formats, count(distinct format) >= 2 as covered from man where class_key is not null group by 1",
    "format_coverage": f"with {_MAN} select format, count(distinct class_key) as classes, count(distinct class_key) >= 3 as covered from man group by 1",
    "template_variants": f"with {_MAN} select template_id, count(*) as records, count(distinct variant) as variants from man where template_id is not null group by 1",
    "assign_splits_ranked": f"""with {_MAN}, t as (select template_id, min(class_key) as class_key from man where class_key is not null and template_id is not null group by 1),
f as (select template_id, min(split) as frozen from splits group by 1), j as (select t.class_key as class_key, t.template_id as template_id, frozen from t left join f on t.template_id = f.template_id),
c as (select class_key, greatest(5 - count(*) filter (where frozen = 'gold'), 0) as fg, greatest(1 - count(*) filter (where frozen = 'calib'), 0) as fc from j group by 1),
r as (select j.class_key as class_key, j.template_id as template_id, frozen, fg, fc, row_number() over (partition by j.class_key, frozen is null order by md5('7:' || j.class_key || ':' || j.template_id), j.template_id) as n from j join c on j.class_key = c.class_key)
select class_key, template_id, case when frozen is not null then frozen when n <= fg then 'gold' when n <= fg + fc then 'calib' else 'train' end as split, frozen is null as is_new from r""",
    "template_drift": """select template_id, 'new' as state from (select template_id from manifest where template_id is not null except select template_id from splits)
union all select template_id, 'orphaned' as state from (select template_id from splits where template_id is not null except select template_id from manifest)""",
    "best_guesser_bound": f"""with {_MAN}, {_SEGS}, {_PATHS}, n as (select document_id, count(*) as segments from segs group by 1),
j as (select m.class_key as class_key, m.format as format, n.segments as segments, split_part(m.source_path, '/', 1) as folder from man m join paths p on m.source_path = p.source_path join n on n.document_id = p.document_id where m.class_key is not null),
a as (select max(c) as best, sum(c) as n from (select format, segments, class_key, count(*) as c from j group by 1, 2, 3) group by format, segments),
b as (select max(c) as best, sum(c) as n from (select folder, class_key, count(*) as c from j group by 1, 2) group by folder)
select cast(sum(n) as bigint) as rows, cast(sum(best) as bigint) as "right", round(sum(best) / cast(sum(n) as double), 6) as share, 'format and segments' as feature from a
union all select cast(sum(n) as bigint), cast(sum(best) as bigint), round(sum(best) / cast(sum(n) as double), 6), 'folder' from b""",
    "stem_token_counts": f"with {_MAN}, t as (select source_path, unnest(regexp_extract_all(regexp_replace(regexp_replace(source_path, '^.*/', ''), '\\.[^.]*$', ''), '([A-Za-z]+)', 1)) as token from man) select token, count(distinct source_path) as paths from t group by 1",
    "label_join": f"with {_MAN}, {_PATHS}, {_LAB} select document_id, source_path, class_key, template_id, split from lab",
    "exact_leakage": f"""with {_MAN}, {_SEGS}, {_PATHS}, side as (select distinct p.document_id as document_id, m.split = 'train' as train from paths p join man m on p.source_path = m.source_path where m.split is not null),
g as (select md5(lower(text)) as digest, count(distinct case when train then segment_id end) as train, count(distinct case when not train then segment_id end) as evaluation from segs join side on segs.document_id = side.document_id group by 1)
select digest, train, evaluation from g where train > 0 and evaluation > 0""",
    "latest_label": f"with {_EV}, {_CUR} select document_id, event_id, class_key, source from cur",
    "supersede_chains": f"""with recursive {_EV}, t(event_id, document_id, n) as (
  select event_id, document_id, cast(1 as bigint) from ev where supersedes is null or supersedes = event_id or supersedes not in (select event_id from ev)
  union all select e.event_id, e.document_id, t.n + 1 from ev e join t on e.supersedes = t.event_id where e.supersedes <> e.event_id)
select document_id, max(n) as length from t group by 1 having max(n) >= 2""",
    "label_snapshot": f"""with {_EV}, {_CUR}, h as (select sha256(document_id || '|' || class_key || '|' || source) as h from cur), b as (select substr(h, 6, 3) as b, count(*) as n, sha256(string_agg(h, '' order by h)) as d from h group by 1)
select cast(sum(n) as bigint) as rows, sha256(string_agg(d, '' order by b)) as digest from b""",
    "label_weights": f"""with {_EV}, {_CUR}, w as (select class_key, source, supersedes, case source when 'generator' then 1.0 when 'human' then 1.0 when 'llm' then 0.3 when 'rule' then 0.2 when 'bootstrap' then 0.0 end as w from cur)
select class_key, count(*) as labels, round(sum(cast(w as double)), 4) as weight, round(sum(cast(case when supersedes is not null and source = 'human' then 2.0 else w end as double)), 4) as corrected_weight from w group by 1""",
    "gold_provenance": f"with {_EV}, {_CUR}, {_MAN}, {_PATHS}, {_LAB} select source, count(*) as documents, source in ('human', 'generator') as allowed from cur where document_id in (select document_id from lab where split = 'gold') group by 1",
    "unknown_label_documents": f"with {_EV} select source, count(*) as events from ev where document_id not in (select document_id from ingested_documents) group by 1",
    "contradicting_labels": f"with {_EV} select document_id, string_agg(distinct class_key, ',' order by class_key) as classes, count(distinct class_key) as n from ev group by 1 having count(distinct class_key) > 1",
    "cohens_kappa": f"""with {_EV}, r as (select document_id, class_key, row_number() over (partition by document_id order by created_at, event_id) as n from ev),
p as (select x.class_key as a, y.class_key as b from r x join r y on x.document_id = y.document_id and x.n = 1 and y.n = 2), t as (select count(*) as n, count(*) filter (where a = b) as same from p),
ca as (select a, count(*) as na from p group by 1), cb as (select b, count(*) as nb from p group by 1), e as (select coalesce(sum(na * nb), 0) as chance from ca join cb on a = b),
k as (select n, same / cast(n as double) as o, chance / (cast(n as double) * n) as x from t, e)
select n, round(o, 6) as observed, round(x, 6) as expected, round((o - x) / (1 - x), 6) as kappa, (o - x) / (1 - x) < 0.7 as alarm from k""",
    "relapse_rate": f"""with {_EV}, {_CUR}, {_MAN}, {_PATHS}, {_LAB}, t as (select distinct document_id, class_key from lab where class_key is not null),
j as (select cur.class_key as now, t.class_key as truth from cur join t on cur.document_id = t.document_id where cur.document_id in (select document_id from ev where supersedes is not null))
select count(*) as corrected, count(*) filter (where now <> truth) as wrong, round(avg(case when now <> truth then 1.0 else 0.0 end), 6) as rate from j""",
    "mail_inheritance": f"""with {_SEGS}, d as (select distinct document_id, parent_document_id from ingested_documents where parent_document_id is not null),
h as (select document_id, arg_min(heading, "index") as subject, arg_min(text, "index") as head from segs where kind = 'mail_kopf' group by 1)
select d.document_id as document_id, subject, nullif(lower(regexp_extract(head, 'From: [^@]*@([^\\s>]+)', 1)), '') as sender_domain from d left join h on d.parent_document_id = h.document_id""",
    "page_cuts": f"""with {_SEGS}, w as (select document_id, "index", segment_id, kind, coalesce(heading, '') as heading, lag(kind) over (partition by document_id order by "index", segment_id) as k, lag(coalesce(heading, '')) over (partition by document_id order by "index", segment_id) as h from segs)
select document_id, "index", segment_id, k as before_kind, kind as after_kind from w where k is not null and (k <> kind or h <> heading)""",
    "review_drift": f"with {_EV} select strftime(created_at, '%Y-%m') as month, count(*) as events, count(*) filter (where source = 'human') as reviewed, round(avg(case when source = 'human' then 1.0 else 0.0 end), 6) as share from ev group by 1",
    "actor_load": f"with {_EV} select coalesce(actor, '-') as actor, count(*) as labels, count(distinct class_key) as classes, count(*) filter (where length(trim(note)) > 0) as notes from ev group by 1",
}
