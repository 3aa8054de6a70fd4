"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.cluster import table
from quirewright.llm import lookalikes, main_content, mixing, packing, record_copies, repeated_lines, scan_repair, self_repetition, splitting
from quirewright.llm.tokens import limit_of

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "blocks", spread=True)).select("document_id", "block_id", "line_no")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = repeated_lines.without_repeated_lines(table(spark, d, "blocks", spread=True))
    return clean.where("source_kind in ('url', 'html')").select("document_id", "block_id", "clean_text", F.size("removed_lines").alias("lines_removed")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(table(spark, d, "blocks", spread=True), table(spark, d, "golden"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_tables(table(spark, d, "blocks", spread=True), table(spark, d, "golden"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return record_copies.record_copies(table(spark, d, "page_blocks", spread=True))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return record_copies.record_classes(table(spark, d, "page_blocks", spread=True))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.boilerplate(table(spark, d, "blocks", spread=True), table(spark, d, "dom_images"))


def p4_main(spark: SparkSession, d: str) -> DataFrame:
    kept = main_content.main_blocks(table(spark, d, "blocks", spread=True), table(spark, d, "dom_images"))
    return kept.select("document_id", "block_order", "block_id", "type", "text").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.defects(table(spark, d, "page_blocks", spread=True), table(spark, d, "blocks", spread=True))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return scan_repair.repaired(table(spark, d, "page_blocks", spread=True), table(spark, d, "blocks", spread=True))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return self_repetition.repetitive(table(spark, d, "blocks", spread=True), table(spark, d, "vlm_results"))


def p6_share(spark: SparkSession, d: str) -> DataFrame:
    return self_repetition.shares(self_repetition.records(table(spark, d, "blocks", spread=True), table(spark, d, "vlm_results"))).distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = limit_of(table(spark, d, "token_limits"), "pack")
    return packing.pack(table(spark, d, "documents", spread=True), capacity)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, and how many of them the linear program made."""
    capacity, _ = limit_of(table(spark, d, "token_limits"), "pack")
    return packing.fill_report(packing.pack(table(spark, d, "documents", spread=True), capacity), capacity)


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return mixing.copies(table(spark, d, "documents", spread=True), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares_reached(mixing.copies(table(spark, d, "documents", spread=True), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.unsplittable(table(spark, d, "documents", spread=True), *limit_of(table(spark, d, "token_limits"), "split"))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "documents", spread=True), *limit_of(table(spark, d, "token_limits"), "split"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_clean, p2_found, p2_canonical, p3_found, p3_classes, p4_found, p4_main, p5_found, p5_text, p6_found, p6_share, p8_containers, p8_fill, p9_copies, p9_shares, p10_found, p10_pieces)
}


def _look_sql(c: str) -> str:
    """The canonical form of text whose words hold no letter that belongs to another script only, as SQL."""
    wide = "".join(chr(o) for o in range(0xFF01, 0xFF5F))
    ascii_ = "".join(chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F))
    alike = {**{v: k for s in (lookalikes.CYRILLIC, lookalikes.GREEK) for k, v in s.items()}, "‐": "-", "‑": "-"}
    src, dst = wide + "".join(alike), ascii_ + "".join(alike.values())
    quoted = (src.replace("'", "''"), dst.replace("'", "''"))
    out = f"translate(regexp_replace(regexp_replace({c}, '[\\x{{ad}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g'), '\\pZ', ' ', 'g'), '{quoted[0]}', '{quoted[1]}')"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "...")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


_MONTH = "(?:" + "|".join(sorted(repeated_lines.MONTHS, key=len, reverse=True)) + r")"
_DE = r"(?:(?:de|of|del)\s+)?"

_P3 = r"""
with recursive r as (select distinct pb_id, text, regexp_replace(lower(text), '[^\pL\pN]', '', 'g') as k from page_blocks where text is not null and pb_id is not null),
p as (select *, list_filter(string_split_regex(text, '[;|\n]'), lambda x: regexp_matches(x, '[\pL\pN]')) as parts from r where length(k) >= 40),
f as (select pb_id, k, case when len(parts) >= 2 and len(list_filter(parts, lambda x: not regexp_matches(x, '(?s)^\s*\pL[\pL\pN _.-]{0,40}?\s*[:=]'))) = 0 then
  array_to_string(list_sort(list_transform(parts, lambda x: regexp_replace(lower(regexp_extract(x, '(?s)^\s*(\pL[\pL\pN _.-]{0,40}?)\s*[:=]\s*(.*)$', 1)), '[^\pL\pN]', '', 'g') || chr(1) || regexp_replace(lower(regexp_extract(x, '(?s)^\s*(\pL[\pL\pN _.-]{0,40}?)\s*[:=]\s*(.*)$', 2)), '[^\pL\pN]', '', 'g'))), chr(2)) end as fields from p),
l as (select distinct k, fields from f where fields is not null),
e as (select distinct x.k, y.k as other from l x join l y using (fields)),
w as (select k, k as other from e union select w.k, e.other from w join e on w.other = e.k),
t as (select k, min(other) as class from w group by 1),
m as (select pb_id, coalesce(class, f.k) as class from (select distinct pb_id, k from f) f left join t using (k)),
c as (select pb_id, min(pb_id) over (partition by class) as first_pb_id from m)
"""

_BLANK = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"

SQL: dict[str, str] = {
    "p1_found": rf"""
with hosts as (
  select document_id, max(regexp_replace(lower(coalesce(nullif(regexp_extract(trim(provenance_source_ref), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), ''),
    regexp_extract(trim(provenance_source_ref), '^([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?:[:/?#]|$)', 1))), '^www\.', '')) as site
  from blocks where source_kind in ('url', 'html') group by 1),
totals as (select site, count(*) as n from hosts where site <> '' group by 1 having count(*) >= 5),
l as (
  select distinct document_id, block_id, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no
  from blocks where source_kind in ('url', 'html') and type in ('paragraph', 'list', 'quote') and text is not null),
k as (
  select document_id, block_id, line_no, regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(lower(x),
      '(\d)(?:st|nd|rd|th|er|º|ª)?[\s.,]*{_DE}{_MONTH}(?:[\s.,]+(?:de|of|del)\s+(\d)|([^\pL]|$))', '\1 \2\3', 'g'),
      '(^|[^\pL]){_MONTH}[\s.,]*{_DE}(\d)', '\1 \2', 'g'),
      '\d(?:st|nd|rd|th)([^\pL]|$)', ' \1', 'g'), '[^\pL\pM]', '', 'g') as key
  from l where regexp_matches(x, '\pL')),
s as (select k.*, h.site, t.n from k join hosts h using (document_id) join totals t on h.site = t.site),
r as (select site, key from s group by site, key, n having count(distinct document_id) * 4 >= n)
select distinct document_id, block_id, line_no::int as line_no from s semi join r on s.site = r.site and s.key = r.key
""",
    "p2_found": f"""
with v as (select distinct document_id, block_id, enrichment.selected_text as t from blocks where type = 'visual' and enrichment.selected_text is not null),
a as (select document_id, block_id, t, {_look_sql('t')} as look from v),
g as (select sample_id, gold_verbatim as t, {_look_sql('gold_verbatim')} as look from golden where gold_verbatim is not null)
select distinct document_id, block_id, sample_id from a join g on a.look = g.look and a.t <> g.t
""",
    "p3_found": _P3 + "select first_pb_id, pb_id as copy_pb_id from c where pb_id <> first_pb_id",
    "p3_classes": _P3
    + """select first_pb_id as pb_id, count(*) as copies from c group by 1
union all select pb_id, 1 from (select distinct pb_id from page_blocks where pb_id is not null) where pb_id not in (select pb_id from c)""",
    "p6_found": r"""
with t as (select distinct 'raw_text' as place, document_id, block_id, enrichment.raw_text as t from blocks where enrichment.raw_text is not null
  union select distinct 'visible_text', document_id, block_id, array_to_string(list_transform(visible_text, lambda x: coalesce(x, '')), chr(10)) from vlm_results where visible_text is not null),
w as (select *, list_filter(string_split_regex(t, '[\s\pZ]+'), lambda x: x <> '') as w from t),
u as (select row_number() over () as id, place, document_id, block_id, w from w where len(w) > 3),
i as (select id, w, unnest(range(1, len(w) - 1)) as i from u),
g as (select id, i, row_number() over (partition by id, w[i], w[i + 1], w[i + 2] order by i) as nth from i),
c as (select distinct id, i + unnest([0, 1, 2]) as i from g where nth > 1),
s as (select c.id, sum(length(u.w[c.i])) as covered from c join u using (id) group by 1)
select distinct u.place, u.document_id, u.block_id from u join s using (id) where s.covered >= 0.4 * list_sum(list_transform(u.w, lambda x: length(x)))
""",
    "p6_share": rf"""
with t as (select distinct 'raw_text' as place, document_id, block_id, enrichment.raw_text as t from blocks where enrichment.raw_text is not null
  union select distinct 'visible_text', document_id, block_id, array_to_string(list_transform(visible_text, lambda x: coalesce(x, '')), chr(10)) from vlm_results where visible_text is not null),
w as (select *, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') as w from t),
m as (select *, len(w) > 0 and (list_max(list_transform(w, lambda x: length(x))) > 200 or list_sum(list_transform(w, lambda x: length(x))) / len(w) > 25) as chars from w),
u as (select row_number() over () as id, place, document_id, block_id, case when chars then regexp_extract_all(array_to_string(w, ''), '(?s).') else w end as u, case when chars then 12 else 3 end as n from m),
v as (select * replace (case when len(u) <= n then 1 else n end as n) from u),
i as (select id, u, n, unnest(range(1, len(u) - n + 2)) as i from v),
g as (select id, i, n, row_number() over (partition by id, array_to_string(u[i:i + n - 1], chr(31)) order by i) as nth from i),
c as (select distinct id, i + unnest(range(0, n)) as i from g where nth > 1),
s as (select c.id, sum(length(v.u[c.i])) as covered from c join v using (id) group by 1)
select distinct place, document_id, block_id, coalesce(covered::double / list_sum(list_transform(u, lambda x: length(x)))::double, 0.0) as share from v left join s using (id)
""",
}
