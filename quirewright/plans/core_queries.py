"""Queries of the reference's operators over the project's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewright.cluster import materialize, table
from quirewright.functions import code as C
from quirewright.functions import metrics as M
from quirewright.functions import text as T
from quirewright.operators import batch, enrich, evaluate, html, pages, quality, reconstruct, render, review, search

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Pieces of SQL that several oracles share.
_LINES = "list_filter(list_transform(string_split(regexp_replace({0}, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\\s\\pZ]+', ''), '[\\s\\pZ]+$', '')), lambda x: x <> '')"
_STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\pZ]+', ''), '[\\s\\pZ]+$', '')"
_HTTP = r"(?m)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE|CONNECT)\s+\S+\s+HTTP/\d"
_DIFF = r"(?m)^\s*(\+\+\+|---|@@|\+[^+]|-[^-])"
_TRACE = r"""\b(Traceback|Exception|Error:|File "[^"]+", line \d+)"""
_LOG = r"(?m)^\s*\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}|(?m)^\s*(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b"
_SHELL, _INI, _JSON, _YAML = r"(?m)^\s*[$>]\s", r"(?m)^\s*\[[^\]]+\]\s*$", r"(?m)^\s*[{\[]", r"(?m)^\s*[\w.\-]+\s*:\s"


def _u(p: str) -> str:
    """A pattern with the classes that are Unicode in the engine written out for a dialect in which they are ASCII."""
    out, inside, i = [], False, 0
    wide = {"s": r"\s\pZ", "w": r"\pL\pN\pM_", "d": r"\p{Nd}"}
    while i < len(p):
        two = p[i : i + 2]
        if two[0] == "\\" and two[1:] in wide:
            out.append(wide[two[1]] if inside else f"[{wide[two[1]]}]")
            i += 2
        elif two == r"\S":
            out.append(r"[^\s\pZ]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or p[i] == "[") and not (inside and p[i] == "]" and p[i - 1] not in "[^")
            out.append(p[i])
            i += 1
    return "".join(out)


def _m(c: str, p: str) -> str:
    return f"regexp_matches({c}, {_q(_u(p))})"


def _class_sql(c: str, fallback: str) -> str:
    json = f"({_m(c, _JSON)} and {_m(_STRIP.format(c), '[]}]$')})"
    return f"""case when {_STRIP.format(c)} = '' then {fallback} when {_m(c, _HTTP)} then 'http' when {_m(c, _DIFF)} then 'diff' when {_m(c, _TRACE)} then 'stack_trace'
      when {_m(c, _LOG)} then 'log' when {_m(c, _SHELL)} then 'terminal' when {_m(c, _INI)} or {json} or ({_m(c, _YAML)} and not contains({c}, '=')) then 'configuration' else {fallback} end"""


# ---- identity ---------------------------------------------------------------------------------------------------


@query(r"""
with p as (select distinct source, content_sha256 c, config_sha256 g,
  regexp_extract(source, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) scheme, regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) host,
  regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) path, regexp_extract(source, '^[^?#]*([?][^#]*)', 1) q from manifests),
k as (select *, case when lower(scheme) in ('http', 'https') and host <> '' then lower(scheme) || '://' || lower(host) || regexp_replace(path, '/$', '') || case when q = '?' then '' else q end else source end canon from p)
select source, case when regexp_matches(lower(source), '^(https?|file)://') then 'url' when lower(source) like '%.pdf' then 'pdf' when regexp_matches(lower(source), '\.html?$') then 'html' end as source_type,
  canon as canonical, case when c is not null and g is not null then substr(sha256(canon || chr(31) || c || chr(31) || g), 1, 16) end as computed_id from k
""")
def source_identity(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifests").select("source", "content_sha256", "config_sha256").distinct()
    canon = T.canonical_source(F.col("source"))
    both = F.col("content_sha256").isNotNull() & F.col("config_sha256").isNotNull()
    return m.select("source", T.source_type(F.col("source")).alias("source_type"), canon.alias("canonical"), F.when(both, T.document_id(canon, F.col("content_sha256"), F.col("config_sha256"))).alias("computed_id"))


@query(r"""
with p as (select distinct canonical_source s, source_type k, content_sha256 c from manifests),
b as (select *, case when k = 'url' then
    case when regexp_extract(regexp_replace(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) = '' then replace(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '')
    else replace(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') || '-' || regexp_extract(regexp_replace(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) end
  else regexp_replace(regexp_extract(regexp_replace(s, '/+$', ''), '([^/]*)$', 1), '(.)\.[^.]+$', '\1') end base from p),
w as (select *, trim(lower(regexp_replace(regexp_replace(base, '(?i)\.(pdf|html?)$', ''), '[^a-zA-Z0-9]+', '-', 'g')), '-') n from b),
z as (select *, case when length(n) > 40 then rtrim(substr(n, 1, 40), '-') else n end t from w)
select s as canonical_source, (case when t = '' then 'doc' else t end) || '-' || (case when coalesce(c, '') = '' then '00000000' else substr(c, 1, 8) end) as folder from z
""")
def folder_names(spark, d):
    m = table(spark, d, "manifests").select("canonical_source", "source_type", "content_sha256").distinct()
    return m.select("canonical_source", T.folder_name(F.col("canonical_source"), F.col("source_type"), F.col("content_sha256")).alias("folder"))


# ---- text -------------------------------------------------------------------------------------------------------


@query(rf"""
with b as (select doc_id, coalesce(text, '') t, {_LINES.format("coalesce(text, '')")} l from documents),
n as (select *, len(l) n, len(list_filter(l, lambda x: length(x) <= 2)) s from b),
m as (select doc_id, max(c) most from (select doc_id, x, count(*) c from (select doc_id, unnest(l) x from n where n >= 20) group by all) group by all)
select n.doc_id, n::int as lines, s::int as short_lines, n >= 20 and s / n > 0.8 as one_char_per_line,
  n between 1 and 4 and regexp_matches(array_to_string(l, ' '), '(?i)^(#+\s*)?[\w\s:''’-]{{0,80}}\s*(page\s*)?\d{{0,4}}$') as only_furniture,
  contains(lower(t), 'the provided image') or contains(lower(t), 'does not contain any chart') or contains(lower(t), 'it is a graphic design') or contains(lower(t), 'cannot be converted into a table') as chatty,
  coalesce(most / n > 0.6, false) as extremely_duplicated from n left join m using (doc_id)
""")
def page_flags(spark, d):
    return quality.page_flags(table(spark, d, "documents", spread=True), "doc_id").drop("repeated_chars")


@query()
def page_flags_repeated(spark, d):
    return quality.page_flags(table(spark, d, "documents", spread=True), "doc_id").select("doc_id", "repeated_chars")


@query(rf"""
with b as (select doc_id, {_LINES.format("coalesce(text, '')")} l from documents),
f as (select doc_id, list_filter(l, lambda x: not starts_with(x, '```'))[1] f from b)
select doc_id, substr(case when starts_with(f, '# ') then {_STRIP.format("substr(f, 3)")} else f end, 1, 200) as title from f
""")
def titles(spark, d):
    return table(spark, d, "documents", spread=True).select("doc_id", T.title_of(F.coalesce("text", F.lit(""))).alias("title"))


@query(r"""
with t as (select doc_id, coalesce(text, '') || case doc_id % 3 when 0 then ' ![a](b.png) <IMG src="x">' when 1 then ' data:image/png;base64,AAAA' else '' end x from documents)
select doc_id, (len(regexp_extract_all(x, '!\[[^\]]*\]\([^)]*\)')) + len(regexp_extract_all(x, '(?i)<\s*img\b[^>]*>')) + len(regexp_extract_all(x, '(?i)data:image/[^;]+;base64')))::int as image_refs,
  sha256(regexp_replace(regexp_replace(regexp_replace(x, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?i)<\s*img\b[^>]*>', '', 'g'), '(?i)data:image/[^;]+;base64', '[removed-base64-image]', 'g')) as stripped_sha from t
""")
def image_references(spark, d):
    extra = F.when(F.col("doc_id") % 3 == 0, ' ![a](b.png) <IMG src="x">').when(F.col("doc_id") % 3 == 1, " data:image/png;base64,AAAA").otherwise("")
    t = table(spark, d, "documents", spread=True).select("doc_id", F.concat(F.coalesce("text", F.lit("")), extra).alias("x"))
    return t.select("doc_id", T.count_image_references(F.col("x")).alias("image_refs"), F.sha2(T.strip_image_references(F.col("x")), 256).alias("stripped_sha"))


@query()
def unclosed_fences(spark, d):
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\n```python\nx").otherwise(""))
    return table(spark, d, "documents", spread=True).select("doc_id", T.unclosed_fence(t).alias("unclosed"), T.unclosed_fence(t, strict=False).alias("unclosed_anywhere"))


@query(r"""
with v as (select distinct document_id, block_id, text t from blocks where type = 'native_code' and text is not null),
f as (select *, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1)::int) f from v)
select document_id, block_id, f || 'x' || chr(10) || rtrim(t, chr(10)) || chr(10) || f as fenced from f
""")
def code_fences(spark, d):
    b = table(spark, d, "blocks").where("type = 'native_code' and text is not null").select("document_id", "block_id", "text").distinct()
    return b.select("document_id", "block_id", T.code_fence(F.col("text"), F.lit("x")).alias("fenced"))


@query(r"""
with v as (select distinct document_id, block_id, enrichment.raw_text t from blocks where enrichment.raw_text is not null),
l as (select *, string_split(t, chr(10)) l from v),
n as (select *, len(list_filter(l, lambda x: regexp_matches(x, '\S'))) n, len(list_filter(l, lambda x: regexp_matches(x, '^\s*\d+\s'))) k from l)
select document_id, block_id, n >= 2 and n = k as numbered,
  sha256(case when n >= 2 and n = k then array_to_string(list_transform(l, lambda x: case when regexp_matches(x, '\S') then regexp_replace(x, '^\s*\d+\s+', '') else x end), chr(10)) else t end) as text_sha from n
""")
def line_numbers(spark, d):
    v = table(spark, d, "blocks").where("enrichment.raw_text is not null").select("document_id", "block_id", F.col("enrichment.raw_text").alias("t")).distinct()
    bare = C.strip_line_numbers(F.col("t"))
    lines = F.split("t", "\n")
    full = F.filter(lines, lambda x: x.rlike(r"\S"))
    numbered = (F.size(full) >= 2) & F.forall(full, lambda x: x.rlike(r"^\s*\d+\s"))
    return v.select("document_id", "block_id", numbered.alias("numbered"), F.sha2(bare, 256).alias("text_sha"))


@query(rf"""
with v as (select distinct document_id, block_id, visual_type k, enrichment.raw_text t from blocks where enrichment.raw_text is not null),
c as (select *, {_class_sql('t', "'code'")} c from v)
select document_id, block_id, c as class, case when c in ('http', 'diff') then c when c = 'terminal' then 'bash' when c in ('log', 'stack_trace') then 'log'
  when c = 'configuration' then case when {_m('t', _JSON)} and {_m(_STRIP.format('t'), '[]}]$')} then 'json' when {_m('t', _INI)} then 'ini' when {_m('t', _YAML)} then 'yaml' end
  when {_m('t', r'(?m)^\s*def\s+\w+\s*\(')} or contains(split_part(t, chr(10), 1), 'import ') then 'python'
  when {_m('t', r'(?m)^\s*#include\s+[<"]')} or {_m('t', r'\bint\s+main\s*\(')} then 'cpp' when {_m('t', r'(?m)^\s*(const|let|var|function)\s+')} then 'javascript'
  when {_m('t', r'(?m)^\s*(func|package)\s+')} then 'go' when {_m('t', r'(?m)^\s*(use\s+std|fn\s+|impl\s+|mod\s+)')} then 'rust' end as language,
  regexp_matches(t, '[^\s\pZ]{{81,}}') or (length(regexp_replace(t, '[\s\pZ]', '', 'g')) > 60 and not contains(t, ' ')) as space_merged from c
""")
def text_classes(spark, d):
    v = table(spark, d, "blocks", spread=True).where(F.col("enrichment.raw_text").isNotNull())
    v = v.select("document_id", "block_id", F.col("enrichment.raw_text").alias("t")).distinct().withColumn("class", C.classify_text(F.col("t")))
    return v.select("document_id", "block_id", "class", C.detect_language(F.col("t"), F.col("class")).alias("language"), C.looks_space_merged(F.col("t")).alias("space_merged"))


@query("""
with v as (select distinct document_id, block_id, coalesce(visual_type, 'unknown') k, enrichment.raw_text t from blocks where enrichment.raw_text <> ''),
s as (select *, length(regexp_replace(t, '[\\s\\pZ]', '', 'g')) f, length(t) - length(replace(t, ' ', '')) sp, string_split(t, chr(10)) l0 from v),
l as (select *, case when l0[-1] = '' then l0[1:-2] else l0 end l from s)
select document_id, block_id, least(1.0, len(list_intersect(list_distinct(list_filter(regexp_extract_all(t, '[\\pL\\pN\\pM_]+'), lambda w: regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*'))), [""" + ", ".join(_q(k) for k in C.KEYWORDS) + """])) / 5.0)::double as keywords,
  round(1 - len(list_filter(l, lambda x: length(x) > 120 and not contains(x, ' '))) / len(l), 9)::double as line_length,
  round(case when f = 0 then 0 when sp / f between 0.05 and 0.5 then 1 when sp / f < 0.05 then sp / f / 0.05 else greatest(0, 1 - (sp / f - 0.5) / 0.5) end, 9)::double as spaces,
  (case k when 'http' then case when regexp_matches(t, 'HTTP/[0-9]') then 1.0 else 0.3 end when 'diff' then case when contains(t, '@@') and (contains(t, '+') or contains(t, '-')) then 1.0 else 0.3 end
   when 'terminal' then case when regexp_matches(t, '(?m)^[\\s\\pZ]*[$>][\\s\\pZ]') then 1.0 else 0.3 end when 'code' then case when regexp_matches(t, '(?m):[\\s\\pZ]*$|;[\\s\\pZ]*$') then 0.8 else 0.5 end else 0.5 end)::double as type_tokens from l
""")
def structural_scores(spark, d):
    v = table(spark, d, "blocks", spread=True).where((F.col("enrichment.raw_text") != ""))
    v = v.select("document_id", "block_id", F.coalesce("visual_type", F.lit("unknown")).alias("k"), F.col("enrichment.raw_text").alias("t")).distinct()
    t = F.col("t")
    return v.select("document_id", "block_id", C.keyword_density(t).alias("keywords"), F.round(C.line_length(t), 9).alias("line_length"), F.round(C.space_ratio(t), 9).alias("spaces"), C.type_tokens(t, F.col("k")).alias("type_tokens"))


@query()
def structural_score(spark, d):
    v = table(spark, d, "blocks", spread=True).where("enrichment.raw_text is not null").select("document_id", "block_id", "visual_type", F.col("enrichment.raw_text").alias("t")).distinct()
    return v.select("document_id", "block_id", C.bracket_balance(F.col("t")).alias("brackets"), C.structural_score(F.col("t"), F.col("visual_type")).alias("score"))


@query(r"""
with v as (select distinct document_id, block_id, enrichment.raw_text t from blocks where type = 'visual' and visual_type = 'terminal' and enrichment.raw_text <> ''),
l as (select document_id, block_id, unnest(string_split(t, chr(10))) x, unnest(range(1, len(string_split(t, chr(10))) + 1)) i from v),
p as (select *, regexp_matches(x, '^[\s\pZ]*(?:\$|>>|>)[\s\pZ]?') c, lag(regexp_matches(x, '^[\s\pZ]*(?:\$|>>|>)[\s\pZ]?')) over (partition by document_id, block_id order by i) pc from l),
g as (select *, sum(case when c or pc is null or pc then 1 else 0 end) over (partition by document_id, block_id order by i) g from p)
select document_id, block_id, g::int as segment, case when bool_or(c) then 'command' else 'output' end as role, string_agg(case when c then regexp_replace(x, '^[\s\pZ]*(?:\$|>>|>)[\s\pZ]?', '') else x end, chr(10) order by i) as text from g group by all
""")
def terminal_segments(spark, d):
    v = table(spark, d, "blocks").where("type = 'visual' and visual_type = 'terminal' and enrichment.raw_text <> ''").select("document_id", "block_id", F.col("enrichment.raw_text").alias("t")).distinct()
    s = v.select("document_id", "block_id", F.posexplode(C.terminal_panels(F.col("t"))).alias("i", "s"))
    return s.select("document_id", "block_id", (F.col("i") + 1).alias("segment"), "s.role", "s.text")


@query()
def panel_segments(spark, d):
    v = table(spark, d, "blocks").where("type = 'visual' and enrichment.raw_text <> ''").select("document_id", "block_id", "visual_type", F.col("enrichment.raw_text").alias("t")).distinct()
    s = v.select("document_id", "block_id", F.posexplode(C.panels(F.col("t"), F.col("visual_type"))).alias("segment", "s"))
    return s.select("document_id", "block_id", "segment", "s.role", "s.text", "s.command")


@query()
def code_repairs(spark, d):
    v = table(spark, d, "blocks", spread=True).where("type = 'visual' and enrichment.raw_text is not null").select("document_id", "block_id", "visual_type", F.col("enrichment.raw_text").alias("t")).distinct()
    return enrich.repairs(v, "t", "visual_type").select("document_id", "block_id", "selected_text", "steps")


@query("with v as (select distinct document_id, block_id, text t from blocks where type = 'native_code' and text is not null), r as (select *, replace(replace(t, ':', '：'), ',', '，') w from v) select document_id, block_id, translate(w, "
       + _q(C.FULL_WIDTH) + ", " + _q(C.ASCII_FORM) + ") as text from r where " + " or ".join(f"contains(w, {_q(m)})" for m in C.CODE_MARKS)
       + " or length(w) - length(translate(w, '()[]{}=;:', '')) >= 3 or regexp_matches(w, '(?m)^[A-Za-z][A-Za-z0-9-]*\\s*[:：=]\\s*\\S') union all select document_id, block_id, w from r where not ("
       + " or ".join(f"contains(w, {_q(m)})" for m in C.CODE_MARKS) + " or length(w) - length(translate(w, '()[]{}=;:', '')) >= 3 or regexp_matches(w, '(?m)^[A-Za-z][A-Za-z0-9-]*\\s*[:：=]\\s*\\S'))")
def ascii_punctuation(spark, d):
    v = table(spark, d, "blocks").where("type = 'native_code' and text is not null").select("document_id", "block_id", F.translate("text", ":,", "：，").alias("w")).distinct()
    return v.select("document_id", "block_id", C.ascii_punctuation(F.col("w")).alias("text"))


# ---- search -----------------------------------------------------------------------------------------------------

_CORPUS = r"""
with t as (select distinct document_id, block_order, block_id, concat_ws(chr(10), text, enrichment.selected_text, enrichment.raw_text) t from blocks),
b as (select document_id, string_agg(t, chr(10) order by block_order, block_id, t) body from t where t <> '' group by 1),
i as (select document_id, min(source) s, min(canonical_source) c from manifests group by 1),
f as (select b.document_id, concat_ws(chr(10), body, s, c, b.document_id) x from b left join i using (document_id))
"""


@query(_CORPUS + r""", k as (select document_id, unnest(string_split_regex(lower(x), '\s+')) w from f),
p as (select document_id, unnest(regexp_extract_all(w, '[a-z0-9_\-]+')) tok from k)
select document_id, document_id as title, (count(*) filter (tok = 'cache') + 2 * count(*) filter (tok = 'worker'))::double as score from p where tok in ('cache', 'worker') group by 1 order by score desc, document_id limit 100
""")
def search_tf(spark, d):
    corpus = search.search_corpus(table(spark, d, "blocks", spread=True), table(spark, d, "manifests"))
    return search.search(corpus, "worker cache Worker")


@query(_CORPUS + r"""
select document_id, document_id as title, ((length(lower(x)) - length(replace(lower(x), 'under heavy load', ''))) / 16)::double as score from f where contains(lower(x), 'under heavy load') order by score desc, document_id limit 100
""")
def search_phrase(spark, d):
    return search.search(search.search_corpus(table(spark, d, "blocks", spread=True), table(spark, d, "manifests")), '"under heavy load"')


@query(r"""
with k as (select doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\s+')) w from documents where coalesce(lang, '') in ('en', 'de', 'fr', 'es')),
p as (select doc_id, unnest(regexp_extract_all(w, '[a-z0-9_\-]+')) tok from k)
select doc_id, tok as token, count(*) as tf from p group by all
""")
def postings(spark, d):
    docs = table(spark, d, "documents", spread=True).where(F.col("lang").isin("en", "de", "fr", "es")).select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("full_text"))
    return search.postings(docs).where(F.col("token").rlike(r"^[a-z0-9_\-]+$")).withColumnRenamed("document_id", "doc_id")


@query()
def postings_all(spark, d):
    """The whole index, of all documents and tokens; ``postings`` is the part of it that its SQL has."""
    docs = table(spark, d, "documents", spread=True).select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("full_text"))
    return search.postings(docs).withColumnRenamed("document_id", "doc_id")


# ---- pages ------------------------------------------------------------------------------------------------------


@query(r"""
with r as (select distinct document_id, page, pb_id, text, trim(regexp_replace(lower(text), '[\s\pZ]+', ' ', 'g')) n, coalesce(from_ocr_layer, false) o from page_blocks where text is not null)
select distinct o.document_id, o.page, o.pb_id from r o join r n on o.document_id = n.document_id and o.page = n.page and o.o and not n.o and length(o.n) >= 20 and length(n.text) >= 20 and (contains(n.n, o.n) or contains(o.n, n.n))
""")
def ocr_duplicates(spark, d):
    return pages.duplicate_ocr_blocks(table(spark, d, "page_blocks"))


@query(r"""
with r as (select distinct document_id, page, pb_id, bbox b, page_width w, (bbox[1] + bbox[3]) / 2 c from page_blocks where len(bbox) >= 4),
g as (select document_id, page, count(*) n, max(w) w, min(case when c < w / 2 * 0.8 then b[2] end) l0, max(case when c < w / 2 * 0.8 then b[4] end) l1, min(case when c > w / 2 * 1.2 then b[2] end) r0, max(case when c > w / 2 * 1.2 then b[4] end) r1 from r group by all)
select document_id, page, case when n >= 4 and w > 0 and l0 is not null and r0 is not null and least(l1 - l0, r1 - r0) > 0 and least(l1, r1) - greatest(l0, r0) > least(l1 - l0, r1 - r0) * 0.3 then 2 else 1 end as columns from g
""")
def page_columns(spark, d):
    return pages.page_columns(table(spark, d, "page_blocks"))


@query(r"""
with r as (select distinct document_id, page, pb_id, length(regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\pZ]+', ''), '[\s\pZ]+$', '')) n, page_width w, page_height h from page_blocks),
g as (select document_id, page, sum(n)::bigint chars, max(w) w, max(h) h from r group by all)
select document_id, page, chars, case when w * h > 0 then round(chars / (w * h), 12) end as density, case when w * h > 0 then chars < 20 and chars / (w * h) < 0.01 else chars < 20 end as scanned from g
""")
def scanned_pages(spark, d):
    return pages.scanned_pages(table(spark, d, "page_blocks")).select("document_id", "page", "chars", F.round("density", 12).alias("density"), "scanned")


@query(rf"""
with r as (select distinct pb_id, coalesce(text, '') t from page_blocks),
c as (select *, {_m('t', r'(?m)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD) [^ ]+ HTTP/[0-9]')} h, {_m('t', r'(?m)^([+][+][+]|---|@@)')} and {_m('t', r'(?m)^[+-]')} d, {_m('t', _SHELL)} s,
  {_m('t', r'(?m)^\s*(def |class |import |from |    )')} p, {_m('t', r'(?m)^\s*[\w\-.\s]+:\s')} and not contains(t, '=') k, {_STRIP.format('t')} x from r),
l as (select *, case when h then 'http' when d then 'diff' when s then 'bash' when p then 'python' end lang from c)
select pb_id, x <> '' and (lang is not null or k) as is_code, case when x <> '' then lang end as language,
  case when x <> '' and (lang is not null or k) then 'native_code' when not contains(x, chr(10)) and x <> '' and length(x) < 120 and not regexp_matches(x, '[.!?:]$') then 'heading' else 'paragraph' end as type from l
""")
def page_block_types(spark, d):
    r = table(spark, d, "page_blocks").select("pb_id", F.coalesce("text", F.lit("")).alias("t")).distinct()
    c = C.code_like(F.col("t"))
    return r.select("pb_id", c["is_code"].alias("is_code"), c["language"].alias("language"), pages.block_type(F.col("t"), c["is_code"]).alias("type"))


@query(r"""
with r as (select distinct document_id, page, pb_id, text, bbox, coalesce(is_code_like, false) c from page_blocks where regexp_matches(coalesce(text, ''), '\S')),
o as (select *, (page - 1) * 10000 + row_number() over (partition by document_id, page order by case when len(bbox) >= 4 then bbox[2] else 0 end, case when len(bbox) >= 4 then bbox[1] else 0 end, pb_id) - 1 n from r)
select document_id, n::int as block_order, 'b_' || lpad((n + 1)::varchar, 6, '0') as block_id, page, pb_id from o
""")
def page_order(spark, d):
    return pages.page_blocks_to_blocks(table(spark, d, "page_blocks")).select("document_id", "block_order", "block_id", "page", "pb_id")


@query(r"""
with t as (select document_id, page, coalesce(string_agg(text, chr(10) order by pb_id, text), '') t, bool_or(coalesce(is_code_like, false)) c, max(page_width * page_height) a from (select distinct document_id, page, pb_id, text, is_code_like, page_width, page_height from page_blocks) group by all),
i as (select distinct p.pb_id, p.bbox b, t.* from page_blocks p join t on p.document_id = t.document_id and p.page = t.page where len(p.bbox) >= 4),
k as (select *, greatest(0, b[3] - b[1]) * greatest(0, b[4] * 20 - b[2] * 20) / a r, not regexp_matches(t, '(?i)\b(Figure|Fig\.?|Listing|Code|Example|Screenshot)\b\s*\d') and not regexp_matches(t, '\b(def |class |import |from |HTTP/|\$ |->|@@|---|\+\+\+|>>>|\.\.\.)') bare from i)
select pb_id, case when r >= 0.7 and bare and not c then 'ignored_decorative' when r >= 0.4 and bare and not c and length(t) >= 200 then 'described_as_text' when pb_id * 50000 >= 8000000 and bare and r >= 0.5 then 'ignored_decorative'
  when r >= 0.5 and bare and length(t) < 100 then 'ignored_decorative' else 'ocr_candidate' end as state from k
""")
def image_states(spark, d):
    pb = table(spark, d, "page_blocks")
    base = pb.select("document_id", "page", "pb_id", "text", "is_code_like", "page_width", "page_height").distinct()
    t = base.groupBy("document_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("pb_id", "text")))), lambda s: s["text"]), "\n").alias("t"),
        F.bool_or(F.coalesce("is_code_like", F.lit(False))).alias("c"), F.max(F.col("page_width") * F.col("page_height")).alias("a"),
    )
    i = pb.where(F.size("bbox") >= 4).select("document_id", "page", "pb_id", "bbox").distinct().join(t, ["document_id", "page"])
    b = F.col("bbox")
    tall = F.array(b[0], b[1] * 20, b[2], b[3] * 20)
    return i.select("pb_id", pages.image_class(tall, F.col("pb_id") * 50000, F.col("a"), F.col("t"), F.col("c")).alias("state"))


# ---- reconstruction ---------------------------------------------------------------------------------------------

_SIG = r"regexp_replace(trim(regexp_replace(lower({0}), '[\s\pZ]+', ' ', 'g')), '\s+', ' ', 'g')"
for _p, _r in (("’", "''"), ("–", "-"), ("—", "-")):
    _SIG = f"replace({_SIG}, '{_p}', '{_r}')"
for _p, _r in reconstruct.SIGNATURE:
    _SIG = f"regexp_replace({_SIG}, {_q(_u(_p))}, '{_r}', 'g')"
_SIG = rf"trim(regexp_replace({_SIG}, '[\s\pZ.\-_:|]+', ' ', 'g'))"
_SIG = rf"(case when {_SIG} in ('page#', '#') then 'page-number' else {_SIG} end)"


def _sig(c: str) -> str:
    return _SIG.replace("{0}", c)


_EFF = "coalesce(nullif(text, ''), nullif(enrichment.selected_text, ''), nullif(enrichment.raw_text, ''), '')"


@query(f"select distinct document_id, block_id, {_sig('text')} as signature, regexp_matches({_STRIP.format('text')}, '(?i)^(page[\\s\\pZ]*)?\\p{{Nd}}{{1,4}}$') as page_number from blocks where text is not null and type in ('paragraph', 'heading')")
def furniture_signatures(spark, d):
    b = table(spark, d, "blocks").where(F.col("text").isNotNull() & F.col("type").isin("paragraph", "heading"))
    return b.select("document_id", "block_id", reconstruct.furniture_signature(F.col("text")).alias("signature"), reconstruct.is_page_number(F.col("text")).alias("page_number")).distinct()


@query(f"""
with b as (select distinct document_id, block_order, block_id, type, {_EFF} e, evidence[1].page p, evidence[1].bbox[2] y0, evidence[1].bbox[4] y1 from blocks where source_kind = 'pdf'),
n as (select document_id, count(distinct p) total from b group by 1), w as (select document_id, p, max(y1) low from b where p is not null and y1 is not null group by all),
s as (select b.*, {_sig('b.e')} sig, regexp_matches({_STRIP.format('b.e')}, '(?i)^(page[\\s\\pZ]*)?\\p{{Nd}}{{1,4}}$') num,
  case when y0 is null or b.p is null then 'body' when y0 <= 90 then 'top' when coalesce(low, 0) > 500 and y1 >= low - 90 then 'bottom' when y1 > 700 then 'bottom' else 'body' end band from b left join w on b.document_id = w.document_id and b.p = w.p),
h as (select * from s where type in ('paragraph', 'heading') and {_STRIP.format('e')} <> '' and length({_STRIP.format('e')}) <= 160 and p is not null and y0 is not null and (band <> 'body' or num) and sig <> ''),
g as (select document_id, sig, count(*) c, count(distinct p) k, min(y0) lo, max(y0) hi, arg_min(num, (block_order, block_id)) num from h group by all)
select g.document_id, sig as signature, c as evidence_count, k::int as pages from g join n using (document_id) where total >= 3 and case when num or sig = 'page-number' then k >= 2 else k >= greatest(3, floor(total * 0.25)) and c >= 2 and hi - lo <= 36 end
""")
def furniture(spark, d):
    b = table(spark, d, "blocks").where("source_kind = 'pdf'")
    f = reconstruct.furniture(b.dropDuplicates(["document_id", "block_id"]))
    return f.select("document_id", "signature", "evidence_count", F.size("pages").alias("pages"))


@query()
def merged_pages(spark, d):
    return reconstruct.merge_pages(table(spark, d, "blocks").where("source_kind = 'pdf'"))


@query()
def reconstruction(spark, d):
    b = table(spark, d, "blocks").where("source_kind = 'pdf'")
    gone = materialize(reconstruct.removed_furniture(b), "removed")
    return reconstruct.reconstruction_stats(b, reconstruct.reconstruct(b, gone), gone)


# ---- quality ----------------------------------------------------------------------------------------------------

_IMPORTANT = "(type = 'visual' and (coalesce(visual_type, 'unknown') = 'unknown' or visual_type in ('code', 'terminal', 'http', 'diff', 'configuration', 'log', 'stack_trace', 'table')))"
_OPEN = f"({_IMPORTANT} and coalesce(visual_state, '') not in ('resolved_native', 'resolved_ocr', 'resolved_structured', 'ignored_decorative'))"
_B = "(select distinct document_id, block_id, block_order, type, text, visual_type, visual_state, coverage_state, enrichment from blocks)"


def _unique(spark, d):
    return table(spark, d, "blocks").select("document_id", "block_id", "block_order", "type", "text", "page", "visual_type", "visual_state", "coverage_state", "coverage_reason", "enrichment").distinct()


@query(f"""
with q as (select document_id, count(*) n, count(*) filter ((type in ('paragraph', 'heading', 'list', 'quote') and text <> '') or type = 'native_code') nat, count(*) filter ({_IMPORTANT}) imp, count(*) filter ({_OPEN}) un,
  count(*) filter (type = 'visual' and visual_state = 'resolved_ocr') ocr, count(*) filter (type = 'visual' and visual_state = 'resolved_ocr' and enrichment.confidence < 0.6) lo,
  count(*) filter (type = 'visual' and visual_state = 'resolved_ocr' and enrichment.confidence >= 0.6 and enrichment.confidence < 0.85) mid, count(*) filter (type = 'visual' and visual_state = 'resolved_ocr' and enrichment.confidence >= 0.85) hi,
  count(*) filter (enrichment.confidence < 0.7 and enrichment.review_required) low from {_B} group by 1)
select document_id, n as blocks, round(nat / n, 9) as native_text_coverage, un as unresolved_visual_count, ocr as ocr_enriched_block_count, lo as confidence_low, mid as confidence_medium, hi as confidence_high, low as low_confidence_blocks,
  round(case when imp > 0 then (imp - un) / imp else 0 end, 9)::double as important_visual_resolution_rate, round(0.5 * nat / n + 0.4 * case when imp > 0 then (imp - un) / imp else 0 end + 0.1, 9)::double as overall_quality_score from q
""")
def quality_report(spark, d):
    r = quality.quality_report(_unique(spark, d), F.lit(0))
    rounded = ["native_text_coverage", "important_visual_resolution_rate", "overall_quality_score"]
    return r.select("document_id", "blocks", "unresolved_visual_count", "ocr_enriched_block_count", "confidence_low", "confidence_medium", "confidence_high", "low_confidence_blocks", *[F.round(c, 9).alias(c) for c in rounded])


@query("select document_id, type, count(*) as n from (select distinct document_id, block_id, type from blocks) group by all")
def block_counts(spark, d):
    counts = quality.counts_by_type(table(spark, d, "blocks").select("document_id", "block_id", "type").distinct())
    return counts.select("document_id", F.explode("counts").alias("type", "n"))


@query(f"""
with s as (select document_id, coalesce(coverage_state, case when visual_state in ('resolved_native', 'resolved_ocr', 'resolved_structured') then 'transcribed' when visual_state = 'ignored_decorative' then 'decorative_with_reason' when visual_state = 'failed' then 'failed_with_diagnostic' end) st from {_B} where type = 'visual')
select document_id, count(*) as total_visual_blocks, {", ".join(f"count(*) filter (st = '{s}') as {s}" for s in quality.COVERAGE)}, count(*) filter (st is null) as missing, count(*) filter (st is null) = 0 as all_covered from s group by 1
""")
def coverage_summary(spark, d):
    return quality.coverage_summary(_unique(spark, d))


@query("""
with o as (select document_id, block_order, lag(block_order) over (partition by document_id order by block_id) p from (select distinct document_id, block_id, block_order from blocks))
select document_id, count(*) filter (block_order <= p) as violations from o group by 1
""")
def order_violations(spark, d):
    return quality.order_violations(table(spark, d, "blocks").select("document_id", "block_id", "block_order").distinct())


@query(f"""
with s as (select document_id, count(*) filter (type = 'paragraph' and regexp_matches(coalesce(text, ''), '\\S')) nat, count(*) filter (type = 'visual' and visual_state in ('resolved_native', 'resolved_ocr', 'resolved_structured')) done,
  count(*) filter (type = 'visual' and visual_state = 'failed') f, count(*) filter (type = 'visual' and coalesce(visual_state, '') <> 'ignored_decorative') shown, count(*) filter ({_OPEN}) un from {_B} group by 1),
m as (select document_id, sum(case when abs(hash(1)) >= 0 then 0 end) z from s group by 1)
select document_id, nat = 0 and done = 0 and f = 0 and shown >= 2 as suspicious, case when nat = 0 and done = 0 and f = 0 and shown >= 2 then 'rejected' when un > 0 then 'review' else 'accepted' end as status from s
""")
def document_status(spark, d):
    b = _unique(spark, d)
    r = quality.quality_report(b, F.lit(0)).join(quality.suspicious(b), "document_id")
    no = F.lit(0)
    st = quality.status(empty=F.lit(False), images=no, unresolved=F.col("unresolved_visual_count"), errors=no, incomplete=F.lit(False), odd=F.col("suspicious"))
    return r.select("document_id", "suspicious", st.alias("status"))


@query(r"""
with m as (select doc_id::varchar document_id, coalesce(text, '') || case doc_id % 4 when 0 then ' ![x](y)' when 1 then chr(10) || '<!-- quirewright: [UNRESOLVED] -->' else '' end t from documents)
select document_id, len(regexp_extract_all(t, '!\[[^\]]*\]\([^)]*\)'))::int as image_syntax_count, len(regexp_extract_all(t, '<!--\s*quirewright:'))::int as html_comment_marker_count, sha256(t) as markdown_sha256, strlen(t)::int as markdown_byte_count from m
""")
def completeness(spark, d):
    tail = F.when(F.col("doc_id") % 4 == 0, " ![x](y)").when(F.col("doc_id") % 4 == 1, "\n<!-- quirewright: [UNRESOLVED] -->").otherwise("")
    md = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.coalesce("text", F.lit("")), tail).alias("markdown"))
    return quality.completeness(md, _unique(spark, d)).select("document_id", "image_syntax_count", "html_comment_marker_count", "markdown_sha256", "markdown_byte_count")


# ---- rendering --------------------------------------------------------------------------------------------------

_RENDER = r"""
r as (select distinct document_id, block_order, block_id, type, visual_type, visual_state, text, heading_level, list_items, language, enrichment e from blocks),
x as (select *, replace(replace(nfc_normalize(coalesce(nullif(e.selected_text, ''), e.raw_text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)) vt,
  replace(replace(nfc_normalize(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)) t, coalesce(visual_type, 'unknown') vk,
  coalesce(nullif(e.language, ''), case e.visual_type when 'terminal' then 'bash' when 'http' then 'http' when 'diff' then 'diff' when 'log' then 'log' when 'stack_trace' then 'log' else '' end) vl from r),
f as (select *, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(case when type = 'visual' then vt else t end, '`+'), lambda y: length(y))), 0) + 1)::int) fence from x),
y as (select *, fence || vl || chr(10) || rtrim(vt, chr(10)) || chr(10) || fence shown, '> The source contains an unresolved ' || vk || ' visual at this position (' n0, ').' || chr(10) n1 from f),
md as (select document_id, block_order, block_id, case type when 'heading' then repeat('#', greatest(1, least(6, case when coalesce(heading_level, 0) = 0 then 2 else heading_level end))) || ' ' || regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')
  when 'list' then replace(replace(nfc_normalize(array_to_string(list_transform(coalesce(list_items, []), lambda z: '- ' || z), chr(10))), chr(13) || chr(10), chr(10)), chr(13), chr(10))
  when 'quote' then array_to_string(list_transform(string_split(t, chr(10)), lambda z: '> ' || z), chr(10)) when 'horizontal_rule' then '---' when 'native_code' then fence || coalesce(language, '') || chr(10) || rtrim(t, chr(10)) || chr(10) || fence
  when 'visual' then case when coalesce(visual_state, '') = 'ignored_decorative' then '' when visual_state in ('resolved_ocr', 'resolved_structured') and e is not null then case when regexp_matches(vt, '\S') then shown else n0 || 'OCR returned empty output' || n1 end
    when visual_state = 'review_required' and e is not null then case when regexp_matches(vt, '\S') then '> The source contains a ' || vk || ' visual at this position whose transcription is uncertain. A partial transcription follows:' || chr(10) || shown else n0 || 'OCR returned empty output' || n1 end
    when visual_state = 'failed' then n0 || coalesce(nullif(array_to_string(e.transformations, '; '), ''), 'OCR failed') || n1 else n0 || 'visual not enriched' || n1 end else t end md from y)
"""


@query("with " + _RENDER + "select distinct document_id, block_id, md from md")
def block_markdown(spark, d):
    b = table(spark, d, "blocks", spread=True)
    return b.select("document_id", "block_id", render.block_markdown(b.columns).alias("md")).distinct()


@query("with " + _RENDER + r""", u as (select distinct * from md), l as (select *, row_number() over (partition by document_id order by block_order desc, block_id desc, md desc) last from u),
p as (select document_id, string_agg(case when last = 1 then md else md || chr(10) || chr(10) end, chr(10) || chr(10) order by block_order, block_id, md) j from l where md <> '' group by 1)
select document_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(j, '^\s+', ''), '\s+$', '') || chr(10), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?i)<\s*img\b[^>]*>', '', 'g'), '(?i)data:image/[^;]+;base64', '[removed-base64-image]', 'g')) as markdown_sha from p
""")
def document_markdown(spark, d):
    return render.render_documents(table(spark, d, "blocks", spread=True)).select("document_id", F.sha2("markdown", 256).alias("markdown_sha"))


@query("select distinct document_id, block_id, coalesce(source_kind, 'unknown') as source_kind, coalesce(provenance_source_ref, '') as source_ref, len(coalesce(evidence, []))::int as evidence_count, coalesce(enrichment.raw_text, text) as raw_text from blocks")
def provenance(spark, d):
    return render.provenance(table(spark, d, "blocks")).select("document_id", "block_id", "source_kind", "source_ref", "evidence_count", "raw_text").distinct()


# ---- images and HTML --------------------------------------------------------------------------------------------


@query("select distinct image_id, coalesce(nullif(current_src, ''), nullif(data_src, ''), nullif(picture_src, ''), nullif(src, ''), nullif(trim(split_part(trim(split_part(srcset, ',', 1)), ' ', 1)), '')) as url, case "
       + " ".join(f"when contains(lower(array_to_string(coalesce(classes, []), ' ')), '{h}') then 'class hint ''{h}'''" for h in html.DECORATIVE_CLASS) + " " + " ".join(f"when contains(lower(coalesce(alt, '')), '{h}') then 'alt hint ''{h}'''" for h in html.DECORATIVE_ALT)
       + " when width between 1 and 32 and height between 1 and 32 then 'tiny dimensions ' || width || 'x' || height end as decorative from dom_images")
def image_choice(spark, d):
    i = table(spark, d, "dom_images")
    return i.select(
        "image_id", html.best_url(*[F.col(c) for c in ("current_src", "data_src", "picture_src", "src", "srcset")]).alias("url"), html.decorative_reason(F.col("classes"), F.col("alt"), F.col("width"), F.col("height")).alias("decorative")
    ).distinct()


@query()
def html_blocks(spark, d):
    tag = F.when(F.col("type") == "heading", "h2").when(F.col("type") == "native_code", "pre").when(F.col("type") == "quote", "blockquote").otherwise("p")
    body = F.concat(F.lit("<"), tag, F.lit(">"), F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), F.lit("</"), tag, F.lit(">"))
    b = table(spark, d, "blocks").where("source_kind in ('url', 'html') and text is not null").select("document_id", "block_order", "block_id", body.alias("h")).distinct()
    html_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "block_id", "h"))), lambda s: s["h"]), "\n")
    page = b.groupBy(F.col("document_id").alias("source_ref")).agg(F.concat(F.lit("<html><body><article>"), html_text, F.lit("</article></body></html>")).alias("html"))
    return html.html_blocks(page).select("source_ref", "block_order", "block_id", "type", "text", "heading_level", "language")


# ---- enrichment -------------------------------------------------------------------------------------------------


@query()
def visual_context(spark, d):
    return enrich.with_context(table(spark, d, "blocks"))


@query()
def enriched_visuals(spark, d):
    b = table(spark, d, "blocks", spread=True)
    open_ = b.withColumn("visual_state", F.when(F.col("type") == "visual", F.lit(None).cast("string")).otherwise(F.col("visual_state")))
    results = b.where("type = 'visual' and enrichment is not null").select("document_id", "block_id", F.col("enrichment.raw_text").alias("text"), F.col("enrichment.confidence").alias("confidence")).distinct()
    return enrich.enrich(open_, results)


@query()
def candidate_choice(spark, d):
    v = table(spark, d, "blocks", spread=True).where("type = 'visual' and enrichment.raw_text is not null").select("document_id", "block_id", "visual_type", "enrichment").distinct()
    views = F.array(F.struct(F.lit(0).alias("view"), F.col("enrichment.raw_text").alias("text"), F.col("enrichment.confidence").alias("confidence")), F.struct(F.lit(1).alias("view"), F.col("enrichment.selected_text").alias("text"), F.col("enrichment.confidence").alias("confidence")))
    return enrich.best_candidates(v.select("document_id", "block_id", "visual_type", F.inline(views)), ["document_id", "block_id"])


@query("select distinct document_id, block_id, coalesce(visual_type, '') in ('diagram', 'ui_screenshot', 'unknown', 'architecture_diagram', 'flowchart', 'chart', 'multi_panel_instructional_image') and coalesce(visual_state, '') <> 'ignored_decorative' as routed from blocks where type = 'visual'")
def vision_routes(spark, d):
    return table(spark, d, "blocks").where("type = 'visual'").select("document_id", "block_id", enrich.routed_to_vlm(F.coalesce("visual_type", F.lit("")), F.col("visual_state")).alias("routed")).distinct()


@query("select enrichment.backend as backend, count(distinct (document_id, block_id)) as visuals, count(distinct (document_id, block_id)) filter (enrichment.review_required) as in_review from blocks where enrichment.backend is not null group by 1")
def backend_counts(spark, d):
    v = table(spark, d, "blocks").where("enrichment.backend is not null").select("document_id", "block_id", F.col("enrichment.backend").alias("backend"), F.col("enrichment.review_required").alias("r")).distinct()
    return v.groupBy("backend").agg(F.count(F.lit(1)).alias("visuals"), F.count_if("r").alias("in_review"))


# ---- evaluation -------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    g = table(spark, d, "golden").where("gold_verbatim is not null")
    n = F.regexp_extract("sample_id", r"(\d+)$", 1).cast("int")
    actual = F.when(n % 3 == 0, F.col("gold_verbatim")).when(n % 3 == 1, F.translate("gold_verbatim", "e5/", "c")).otherwise(F.regexp_replace("gold_verbatim", r"\n[^\n]*$", ""))
    return g.select("sample_id", "visual_type", "language", "critical_tokens", "line_numbers_present", F.col("gold_verbatim").alias("gold"), actual.alias("actual"), (n % 10 / 10.0).alias("confidence"))


_PAIRS = r"""
p as (select sample_id, visual_type, language, critical_tokens tok, gold_verbatim g, regexp_extract(sample_id, '(\d+)$', 1)::int n, case regexp_extract(sample_id, '(\d+)$', 1)::int % 3 when 0 then gold_verbatim when 1 then translate(gold_verbatim, 'e5/', 'c') else regexp_replace(gold_verbatim, '\n[^\n]*$', '') end a from golden where gold_verbatim is not null),
l as (select *, string_split(g, chr(10)) gl0, string_split(a, chr(10)) al0 from p),
k as (select *, case when gl0[-1] = '' then gl0[1:-2] else gl0 end gl, case when al0[-1] = '' then al0[1:-2] else al0 end al from l),
m as (select sample_id, visual_type, n, gl = al as exact_line_match, len(list_filter(gl, lambda x: not list_contains(al, x))) / greatest(1, len(gl)) mr, len(list_filter(al, lambda x: not list_contains(gl, x))) / greatest(1, len(al)) er,
  case when len(coalesce(tok, [])) = 0 then 1 else len(list_filter(tok, lambda t: contains(lower(a), lower(t)))) / len(tok) end cr, len(coalesce(tok, [])) > 0 hc,
  length(g) - length(replace(replace(g, '/', ''), '\', '')) gs, length(a) - length(replace(replace(a, '/', ''), '\', '')) az from k)
"""


@query("with " + _PAIRS + """select sample_id, visual_type, exact_line_match, round(mr, 9)::double as missing_line_rate, round(er, 9)::double as extra_line_rate, round(cr, 9)::double as critical_token_recall,
  round(case when gs = 0 then case when az = 0 then 1 else 0 end else 1 - abs(gs - az) / greatest(gs, az) end, 9)::double as punct_slash_backslash from m""")
def golden_metrics(spark, d):
    m = evaluate.sample_metrics(_pairs(spark, d))
    return m.select("sample_id", "visual_type", "exact_line_match", *[F.round(c, 9).alias(c) for c in ("missing_line_rate", "extra_line_rate", "critical_token_recall", "punct_slash_backslash")])


@query("with " + _PAIRS + """select coalesce(visual_type, 'all') as visual_type, count(*) as sample_count, round(avg(exact_line_match::int), 9) as exact_line_match_rate, round(avg(mr), 9) as missing_line_rate_mean, round(avg(cr), 9) as critical_token_recall_mean from m group by rollup (visual_type)""")
def golden_aggregate(spark, d):
    a = evaluate.aggregate(evaluate.sample_metrics(_pairs(spark, d)))
    return a.select("visual_type", "sample_count", *[F.round(c, 9).alias(c) for c in ("exact_line_match_rate", "missing_line_rate_mean", "critical_token_recall_mean")])


@query()
def golden_report(spark, d):
    return evaluate.aggregate(evaluate.sample_metrics(_pairs(spark, d)))


@query()
def golden_calibration(spark, d):
    return evaluate.calibrate(evaluate.sample_metrics(_pairs(spark, d)), [(0.6, 0.85), (0.6, 0.99)])


@query("""
with t as (select doc_id, regexp_replace(coalesce(title, ''), '[^\\x00-\\x7f]', '?', 'g') t from documents), p as (select a.doc_id, a.t g, b.t a from t a join t b on b.doc_id = a.doc_id + 1)
select doc_id, round(case when g = '' then case when a = '' then 0 else 1 end else levenshtein(g, a) / length(g) end, 9)::double as cer from p
""")
def character_error_rate(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("title", F.lit("")), r"[^\x00-\x7f]", "?").alias("t"))
    after = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("a"))
    return t.join(after, "doc_id").select("doc_id", F.round(M.cer(F.col("t"), F.col("a")), 9).alias("cer"))


# ---- batches ----------------------------------------------------------------------------------------------------

_LAST = "last as (select * from batch_state where source_key is not null qualify row_number() over (partition by source_key order by captured_at desc nulls last, attempts desc nulls last, status desc nulls last, document_id desc nulls last, content_sha256 desc nulls last, config_sha256 desc nulls last) = 1)"


@query("with " + _LAST + " select source_key, status, document_id, attempts, captured_at from last")
def latest_state(spark, d):
    return batch.latest_state(table(spark, d, "batch_state")).select("source_key", "status", "document_id", "attempts", "captured_at")


@query("with " + _LAST + " select count(*) as total, count(*) filter (status = 'accepted') as accepted, count(*) filter (status = 'review') as review, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'failed') as failed, count(*) filter (status not in ('accepted', 'review', 'rejected', 'failed')) as unfinished from last")
def batch_summary(spark, d):
    return batch.batch_summary(batch.latest_state(table(spark, d, "batch_state")))


@query("with " + _LAST + " select source_key, attempts, coalesce(error, 'unknown') as error from last where status = 'failed'")
def batch_failures(spark, d):
    return batch.failures(batch.latest_state(table(spark, d, "batch_state")))


_CONFIG = "0efb1b1e58546746d0cc2b29ad7c77ce7844203d5dacfa7c46b72e3ff4eb1428"
_HASHED = "nullif(regexp_replace(lower(trim({0})), '^sha256:\\s*', ''), '')"


@query(f"""
with {_LAST}, m as (select canonical_source k, max((captured_at, ingested_at, {_HASHED.format('content_sha256')})) c from manifests where {_HASHED.format('content_sha256')} is not null and {_HASHED.format('config_sha256')} is not null group by 1),
j as (select m.k, c[3] h, status, {_HASHED.format('content_sha256')} dh, {_HASHED.format('config_sha256')} dc, document_dir, captured_at from m left join last on source_key = m.k),
r as (select k, case when status is null then 'new' when status not in ('accepted', 'review', 'rejected') then 'unfinished' when coalesce(dc = '{_CONFIG}', false) and dh is not null then
  case when document_dir is null then 'partial' when coalesce(captured_at > timestamp '2025-06-01', false) or regexp_matches(k, '^https?://') or coalesce(h = dh, false) then 'cached' else 'stale' end else 'configuration changed' end reason from j)
select k as source_key, reason, case when reason = 'cached' then 'skip' else 'process' end as action from r
""")
def resume_plan(spark, d):
    from quirewright.streaming.incremental import newest_captures

    items = newest_captures(table(spark, d, "manifests")).select(F.col("canonical_source").alias("source_key"), F.col("canonical_source").alias("source"), F.col("content").alias("content_sha256"))
    now = F.lit("2025-06-11 00:00:00").cast("timestamp")
    plan = batch.resume_plan(items, table(spark, d, "batch_state"), _CONFIG, now=now, max_age=10 * 86400)
    return plan.select("source_key", "reason", "action")


_PAGES = """p as (select document_id, page page_number, count(*) filter (type = 'visual') v, count(*) filter (type = 'visual' and visual_state is not null and visual_state <> 'failed') r, sum(length(coalesce(text, '')))::bigint c,
  count(*) filter (type = 'visual' and enrichment.backend = 'rapid') f, bool_or(coalesce(visual_state, '') = 'review_required') q, count(*) filter (type = 'visual' and coalesce(visual_state, '') = 'review_required') u, count(*) n from (select distinct document_id, block_id, page, type, visual_state, text, enrichment from blocks where source_kind = 'pdf' and page is not null) group by all),
s as (select *, case when q then 'rendered' else 'verified' end state from p)"""


def _page_rows(spark, d):
    b = _unique(spark, d).join(table(spark, d, "blocks").where("source_kind = 'pdf'").select("document_id").distinct(), "document_id", "left_semi").where("page is not null")
    visual, vs = F.col("type") == "visual", F.coalesce("visual_state", F.lit(""))
    p = b.groupBy("document_id", F.col("page").alias("page_number")).agg(
        F.count_if(visual).alias("visual_count"), F.count_if(visual & F.col("visual_state").isNotNull() & (vs != "failed")).alias("visuals_represented"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("native_text_chars"),
        F.count_if(visual & F.coalesce(F.col("enrichment.backend") == "rapid", F.lit(False))).alias("fallbacks"), F.bool_or(vs == "review_required").alias("suspicious"), F.count_if(visual & (vs == "review_required")).alias("uncertain"), F.count(F.lit(1)).alias("n"),
    )
    return p.withColumn("state", F.when(F.col("suspicious"), "rendered").otherwise("verified"))


@query("with " + _PAGES + ", t as (select document_id, max(page_number) + 1 k from s group by 1), e as (select document_id, unnest(range(1, k + 1)) page_number from t), j as (select e.document_id, e.page_number, state from e left join s on e.document_id = s.document_id and e.page_number = s.page_number) "
       "select document_id, count(*) as pages_total, count(*) filter (state = 'verified') as verified, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'rendered') as processing, count(*) filter (state is null) as pending, max(page_number) filter (state = 'verified')::int as last_completed_page from j group by 1")  # fmt: skip
def page_progress(spark, d):
    s = _page_rows(spark, d)
    every = batch.expand_pages(s.groupBy("document_id").agg((F.max("page_number") + 1).alias("pages_total")))
    return quality.page_progress(s.select("document_id", "page_number", "state"), every)


@query("with " + _PAGES + ", t as (select document_id, greatest(max(page_number), 0) + (document_id[1] in ('a', 'b'))::int as k from p group by 1), g as (select s.document_id, any_value(k)::int as pages_total, count(distinct page_number) filter (page_number >= 1) as told, count(*) filter (state = 'verified') pages_verified, 0 as pages_failed, "
       "count(*) filter (q or n > 300) pages_suspicious, sum(v)::bigint visuals_total, sum(r)::bigint visuals_represented, sum(u)::bigint visuals_uncertain, sum(greatest(0, v - r))::bigint visuals_missing, sum(c)::bigint native_text_chars_total, sum(f)::bigint fallback_count from s join t using (document_id) group by 1), "
       "h as (select *, greatest(0, pages_total - told)::int as page_sequence_gaps, (told + greatest(0, pages_total - told))::int as pages_visited from g) select * exclude (told), pages_visited = pages_total and pages_verified = pages_total and page_sequence_gaps = 0 and visuals_missing = 0 and fallback_count = 0 as hard_pass from h")  # fmt: skip
def full_completeness(spark, d):
    p = _page_rows(spark, d).withColumn("seconds", F.col("n").cast("double")).withColumn("visuals_uncertain", F.col("uncertain"))
    expected = p.groupBy("document_id").agg((F.greatest(F.max("page_number"), F.lit(0)) + F.substring("document_id", 1, 1).isin("a", "b").cast("int")).alias("pages_total"))
    r = batch.full_completeness(p, expected=expected)
    number = ["pages_total", "page_sequence_gaps", "pages_visited"]
    return r.select("document_id", *[F.col(c).cast("int").alias(c) for c in number], "pages_verified", F.col("pages_failed").cast("int").alias("pages_failed"), "pages_suspicious", "visuals_total", "visuals_represented", "visuals_uncertain", "visuals_missing", "native_text_chars_total", "fallback_count", "hard_pass")


@query("with " + _PAGES + ", w as (select document_id, page_number, sum(n) over u e, max(c) over u m, sum(v) over u k from s window u as (partition by document_id order by page_number)) select document_id, page_number, e::double as elapsed_s, round(page_number / e * 60.0, 9)::double as pages_per_minute, k::bigint as calls_total, m as peak_rss_bytes from w")
def running_performance(spark, d):
    p = _page_rows(spark, d).select("document_id", "page_number", F.lit(100).alias("pages_total"), F.col("n").cast("double").alias("seconds"), F.col("visual_count").alias("calls"), F.lit(0.0).alias("latency"), F.col("native_text_chars").alias("rss"))
    return batch.running_performance(p).select("document_id", "page_number", "elapsed_s", F.round("pages_per_minute", 9).alias("pages_per_minute"), "calls_total", "peak_rss_bytes")


@query("with f as (select coalesce(source, '') || '/' || doc_id || case when source_type = 'pdf' then '.PDF' when source_type = 'html' then '.htm' else '.txt' end path, coalesce(text, '') t from documents), h as (select path, case when lower(path) like '%.pdf' then 'pdf' when lower(path) like '%.htm' then 'html' else 'other' end kind, sha256(t) sha256, strlen(t) length from f) select path, kind, sha256, length, count(*) over (partition by sha256) as same from h")
def inventory(spark, d):
    suffix = F.when(F.col("source_type") == "pdf", ".PDF").when(F.col("source_type") == "html", ".htm").otherwise(".txt")
    t = F.coalesce("text", F.lit(""))
    files = table(spark, d, "documents", spread=True).select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.octet_length(t).cast("long").alias("length"), t.cast("binary").alias("content"))
    return batch.inventory(files)


# ---- dashboard and review ---------------------------------------------------------------------------------------

_INDEX = """n as (select document_id, max((captured_at, status, source_type, source, canonical_source)) m from manifests group by 1), c as (select document_id, count(distinct block_id) k from blocks group by 1),
ix as (select n.document_id, m[1] captured_at, m[2] status, m[3] source_type, coalesce(k, 0) block_count from n left join c using (document_id))"""


@query("with " + _INDEX + " select document_id, status, source_type, captured_at, block_count from ix")
def document_index(spark, d):
    return search.document_index(table(spark, d, "manifests"), table(spark, d, "blocks")).select("document_id", "status", "source_type", "captured_at", "block_count")


@query("with " + _INDEX + """, v as (select distinct document_id from blocks where type = 'visual' and coverage_state in ('review_required', 'transcribed')), w as (select distinct document_id from blocks where type = 'visual' and coalesce(enrichment.confidence, 0) between 0.3 and 0.9)
select document_id, status, captured_at from ix where status in ('review', 'accepted') and source_type in ('pdf', 'url') and document_id in (from v) and document_id in (from w) order by captured_at desc nulls last, document_id limit 50 offset 5""")
def dashboard_page(spark, d):
    b = table(spark, d, "blocks")
    index = search.document_index(table(spark, d, "manifests"), b)
    f = search.filtered_index(index, b, ["review", "accepted"], ["pdf", "url"], ["review_required", "transcribed"], (0.3, 0.9))
    return f.orderBy(F.desc_nulls_last("captured_at"), "document_id").offset(5).limit(50).select("document_id", "status", "captured_at")


@query("with " + _INDEX + " select status, count(*) as documents from ix group by 1")
def dashboard_counts(spark, d):
    return search.status_counts(search.document_index(table(spark, d, "manifests"), table(spark, d, "blocks")))


@query("select distinct document_id, block_order, block_id, visual_type, visual_state, coalesce(enrichment.confidence, 0)::double as confidence from blocks where type = 'visual' and coalesce(enrichment.confidence, 0) between 0.0 and 0.95")
def visual_list(spark, d):
    return search.visual_list(table(spark, d, "blocks"), None, (0.0, 0.95)).distinct()


def _edits(spark, d):
    return table(spark, d, "manifests").select(F.col("canonical_source").alias("document_id"), F.lit(review.DOCUMENT).alias("block_id"), F.lit("status").alias("field"), F.col("status").alias("value"), F.col("profile").alias("user"), F.col("ingested_at").alias("timestamp")).distinct()


@query("""
with e as (select distinct canonical_source document_id, status v, profile u, ingested_at ts from manifests), w as (select *, lag(v) over (partition by document_id order by ts, v) o from e)
select document_id, o as old_value, v as new_value, ts as timestamp from w where v is distinct from o
""")
def revisions(spark, d):
    return review.effective_revisions(_edits(spark, d)).select("document_id", "old_value", "new_value", "timestamp")


@query("select canonical_source as document_id, max((ingested_at, status))[2] as status from manifests group by 1")
def review_status(spark, d):
    return review.review_state(review.effective_revisions(_edits(spark, d))).select("document_id", "status")


# ---- whole jobs -------------------------------------------------------------------------------------------------


@query()
def finalized_documents(spark, d):
    from quirewright.config import profile
    from quirewright.operators.pipeline import finalize

    b = table(spark, d, "blocks").withColumn("table_rows", F.lit(None).cast("array<array<string>>"))
    done = finalize(b, profile())
    return done.diagnostics.select("document_id", "status", "blocks", "markdown_image_count", F.round("overall_quality_score", 9).alias("overall_quality_score"))


@query()
def converted_pages(spark, d):
    from quirewright.operators.pipeline import convert_pages

    return convert_pages(table(spark, d, "page_blocks")).select("document_id", "block_order", "block_id", "type", "text", "page")


@query(f"""
select document_id, list_sort(list(distinct block_id) filter ({_OPEN})) as unresolved_blocks, list_sort(list(distinct block_id) filter (enrichment.confidence < 0.7 and enrichment.review_required)) as doubtful_blocks
from {_B} group by 1 having count(*) filter ({_OPEN}) > 0
""")
def unresolved_visuals(spark, d):
    from quirewright.operators.pipeline import diagnostics

    x = diagnostics(_unique(spark, d)).where(F.size("unresolved_blocks") > 0)
    return x.select("document_id", "unresolved_blocks", F.when(F.size("doubtful_blocks") > 0, F.col("doubtful_blocks")).alias("doubtful_blocks"))


@query("""
with e as (select canonical_source document_id, extract('day' from captured_at)::int page_number, case status when 'accepted' then 'verified' when 'rejected' then 'failed' else 'rendered' end state, ingested_at ts from manifests),
o as (select distinct document_id, page_number, state, ts from e)
select document_id, page_number, count(*) as updates from o where document_id is not null and page_number is not null group by all
""")
def streamed_page_states(spark, d):
    """The captures as a stream of page states, run through the stateful operator until what is there is processed."""
    import uuid

    from quirewright.cluster import shared_dir
    from quirewright.streaming.page_states import page_states

    m = table(spark, d, "manifests")
    state = F.when(F.col("status") == "accepted", "verified").when(F.col("status") == "rejected", "failed").otherwise("rendered")
    rows = m.select(F.col("canonical_source").alias("document_id"), F.dayofmonth("captured_at").alias("page_number"), state.alias("state"), F.col("ingested_at").alias("ts"))
    staged = materialize(rows.where("document_id is not null and page_number is not null").distinct(), "events")
    folder = f"{shared_dir(spark)}/quirewright/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    stream = page_states(spark.readStream.schema(staged.schema).parquet(staged.inputFiles()[0].rsplit("/", 1)[0]))
    keep = lambda df, _: df.select("document_id", "page_number", "updates").write.mode("append").parquet(f"{folder}/out")
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("document_id", "page_number").agg(F.max("updates").alias("updates"))
