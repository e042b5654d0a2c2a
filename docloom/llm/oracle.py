"""SQL with the same results for the queries of this subpackage that SQL can express on whole tables.

The engine has no NFKC; composing and spelling out ligatures is the same on the test texts (no-break
spaces separate words either way).
"""

BLANK = r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"
LETTER = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"


def composed(column: str) -> str:
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        column = f"replace({column}, '{a}', '{b}')"
    return f"nfc_normalize({column})"


def key(column: str, separator: str = "-") -> str:
    bare = f"regexp_replace(lower({composed(column)}), '[^\\p{{L}}\\p{{N}}]+', '{separator}', 'g')"
    return f"nullif(regexp_replace(regexp_replace({bare}, '^{separator}', ''), '{separator}$', ''), '')"


SHINGLES = f"""seg as (select distinct segment_id, document_id, text from segments where segment_id is not null and text is not null),
wd as (select segment_id, list_filter(string_split_regex(lower(regexp_replace({composed("text")}, '({LETTER})-{BLANK}*\\n{BLANK}*({LETTER})', '\\1\\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w from seg),
ix as (select segment_id, w, unnest(generate_series(1, len(w) - 2)) as i from wd where len(w) >= 12),
sh as (select distinct segment_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from ix),
n as (select segment_id, count(*) as n from sh group by 1)"""
MANIFEST = f"man as (select distinct source_path, {key('class_key', '_')} as class, {key('template_id')} as template, lower(trim(split)) as split from manifest)"
OVERLAP = f"""{SHINGLES}, side as (select distinct d.document_id as document_id, lower(trim(m.split)) as side from ingested_documents d join manifest m on d.source_path = m.source_path where lower(trim(m.split)) in ('gold', 'calib', 'train')),
ev as (select distinct segment_id from seg join side on seg.document_id = side.document_id where side in ('gold', 'calib')), tr as (select distinct segment_id from seg join side on seg.document_id = side.document_id where side = 'train'),
es as (select sh.segment_id as segment_id, s from sh join ev on sh.segment_id = ev.segment_id), ts as (select sh.segment_id as segment_id, s from sh join tr on sh.segment_id = tr.segment_id),
c as (select es.segment_id as a, ts.segment_id as b, count(*) as c from es join ts on es.s = ts.s where es.segment_id <> ts.segment_id group by 1, 2)"""
UNIT = "('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0"
SAMPLE = f"""{MANIFEST}, recs as (select distinct source_path, template, split from man),
drawn as (select source_path, template, split, cast({UNIT.format("'p3|' || coalesce('template:' || template, 'path:' || source_path)")} as double) as unit from recs where split is not null and (template is not null or source_path is not null)),
sample as (select * from drawn where unit < 0.2)"""

ORACLE = {
    "p1_found": f"""with {MANIFEST}, bad as (select template from man where template is not null and split is not null group by 1 having count(distinct split) > 1)
select distinct source_path from man where template in (select template from bad) and split is not null and source_path is not null""",
    "p2_found": f"""with recursive {SHINGLES}, c as (select x.segment_id as a, y.segment_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.segment_id < y.segment_id group by 1, 2),
e as (select a, b from c join n na on na.segment_id = a join n nb on nb.segment_id = b where c > 0.5 * (na.n + nb.n - c)),
both_ as (select a, b from e union all select b, a from e),
r(a, b) as (select a, b from both_ union select r.a, both_.b from r join both_ on r.b = both_.a)
select a as segment_id_a, b as segment_id_b from r where a < b""",
    "p2_groups": f"""with recursive {SHINGLES}, c as (select x.segment_id as a, y.segment_id as b, count(*) as c from sh x join sh y on x.s = y.s and x.segment_id < y.segment_id group by 1, 2),
e as (select a, b from c join n na on na.segment_id = a join n nb on nb.segment_id = b where c > 0.5 * (na.n + nb.n - c)),
both_ as (select a, b from e union all select b, a from e),
r(a, b) as (select a, b from both_ union select r.a, both_.b from r join both_ on r.b = both_.a)
select a as segment_id, min(b) as group_id, count(*) as group_size from (select a, b from r union select a, a from r) group by 1""",
    "p5_report": f"""with {OVERLAP}, ps as (select distinct a, b from c join n na on na.segment_id = a join n nb on nb.segment_id = b where c > 0.5 * (na.n + nb.n - c)),
{MANIFEST}, rec as (select distinct source_path, split, template, string_split(source_path, '/')[1] as source from man where split in ('gold', 'calib', 'train')),
own as (select distinct seg.segment_id as segment_id, r.split as split, r.template as template, r.source as source from seg join ingested_documents d on seg.document_id = d.document_id join rec r on r.source_path = d.source_path)
select e.split as split, e.template as template, e.source as source, t.source as train_source, count(distinct a) as segments, count(distinct a || '|' || b) as pairs
from ps join own e on e.segment_id = a join own t on t.segment_id = b where e.split <> 'train' and t.split = 'train' group by 1, 2, 3, 4""",
    "p5_found": f"""with {OVERLAP} select distinct least(a, b) as segment_id_a, greatest(a, b) as segment_id_b from c join n na on na.segment_id = a join n nb on nb.segment_id = b where c > 0.5 * (na.n + nb.n - c)""",
    "p3_sample": f"with {SAMPLE} select source_path, template, split, unit from sample",
    "p3_growth": f"""with {SAMPLE}, f as (select source_path, min(ingested_at) as batch from ingested_documents group by 1), r as (select distinct source_path, template, split from man where split is not null),
b as (select distinct ingested_at as ts from ingested_documents where ingested_at is not null), half as (select ts from (select ts, row_number() over (order by ts) - 1 as i, count(*) over () as n from b) where i = n // 2)
select epoch_us(batch) as batch, r.split as split, count(*) as records, count(s.unit) as drawn, count(case when batch < (select ts from half) then s.unit end) as drawn_early, 0::bigint as lost from r left join sample s on r.source_path is not distinct from s.source_path and r.template is not distinct from s.template and r.split = s.split left join f on r.source_path = f.source_path group by 1, 2""",
}
