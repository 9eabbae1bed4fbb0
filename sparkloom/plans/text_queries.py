"""Queries on texts: normalising, statistics, sections, overlaps and page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking, sections
from sparkloom.session import spread
from sparkloom.sources import pages as P

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df  # whole texts: the work is in the rows


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(r"""
with messy as (select doc_id, replace(replace(text, '. ', '.' || chr(9) || '  '), chr(10), '  ' || chr(10) || chr(10) || chr(10) || ' ') as m from documents),
tight as (select doc_id, m, regexp_replace(regexp_replace(m, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from messy)
select doc_id, case when m = '' then '' else regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(l)), chr(10)), '^\s+|\s+$', '', 'g') || chr(10) end as text from tight
""")
def normalize_whitespace(spark, sf_dir):
    messy = F.replace(F.replace("text", F.lit(". "), F.lit(".\t  ")), F.lit("\n"), F.lit("  \n\n\n "))
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(messy).alias("text"))


@query("select doc_id, replace(replace(text, ',', ''''), 'on ', 'on--') as text from documents")
def encoding_fix(spark, sf_dir):
    broken = F.replace(F.replace("text", F.lit(","), F.lit("\u00e2\u0080\u0099")), F.lit("on "), F.lit("on\u00e2\u0080\u0094"))
    return table(spark, sf_dir, "documents").select("doc_id", T.fix_encoding(F.replace(broken, F.lit(" of "), F.lit(" of\u00c2\u00a0"))).alias("text"))


_BULLETS = r"(?m)^([ \t]*)(?:[•*\-+◦○●■□▪▫]|\d+\.)[ \t]+(.*?)[ \t]*$"


@query(rf"""
select doc_id, regexp_replace('  12.   ' || replace(replace(text, chr(10), ' ' || chr(10) || '• '), '. ', '.  ' || chr(10) || chr(9) || '-  '), '{_BULLETS}', '\1* \2', 'g') as text from documents
""")
def bullet_standardize(spark, sf_dir):
    listed = F.concat(F.lit("  12.   "), F.replace(F.replace("text", F.lit("\n"), F.lit(" \n• ")), F.lit(". "), F.lit(".  \n\t-  ")))
    return table(spark, sf_dir, "documents").select("doc_id", T.standardize_bullets(listed).alias("text"))


@query(r"""
with lined as (select doc_id, string_split(replace(text, ', ', chr(10)), chr(10)) as ls from documents),
rows as (select doc_id, unnest(ls) as raw, generate_subscripts(ls, 1) as pos from lined),
pairs as (select doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') as line from rows),
nexts as (select *, lead(line) over (partition by doc_id order by pos) as nxt from pairs)
select doc_id, string_agg(line || case when nxt is null then '' when regexp_matches(line, '[.!?"''>]$') or starts_with(line, '* ') or regexp_matches(nxt, '^\p{Lu}') or line = '' or nxt = '' then chr(10) else ' ' end, '' order by pos) as text
from nexts group by doc_id
""")
def line_reflow(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.reflow(F.replace("text", F.lit(", "), F.lit("\n"))).alias("text"))


@query(r"""
with w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as t from documents where text <> '')
select doc_id, length(text)::int as char_count, len(t)::int as word_count, len(regexp_split_to_array(text, '[.!?]+'))::int as sentence_count,
  round(list_sum(list_transform(t, lambda x: length(x)))::double / len(t), 6) as avg_word_length, floor(len(t) / 3.75)::int as reading_seconds from w
""")
def text_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.text_stats("text").alias("s"))
    return docs.select("doc_id", "s.char_count", "s.word_count", "s.sentence_count", F.round("s.avg_word_length", 6).alias("avg_word_length"), T.reading_time("s.word_count").alias("reading_seconds"))


@query(f"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as ws from documents),
e as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
c as (select doc_id, word, count(*) as cnt, min(pos) as first from e where word not in ({", ".join(map(quoted, T.STOP_WORDS))}) group by 1, 2),
r as (select doc_id, word, cnt, row_number() over (partition by doc_id order by cnt desc, first)::int as rank from c)
select * from r where rank <= 10
""")
def keywords_topk(spark, sf_dir):
    return T.keywords(table(spark, sf_dir, "documents"))


@query(r"""
with t as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as nxt from conversations),
w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as a, list_distinct(regexp_extract_all(lower(nxt), '[\p{L}\p{N}_]+')) as b from t where nxt is not null)
select conv_id, turn, round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) as jaccard from w
""")
def jaccard_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", "lead(text) over (partition by conv_id order by turn) as nxt").where("nxt is not null")
    return turns.select("conv_id", "turn", F.round(T.jaccard("text", "nxt"), 6).alias("jaccard"))


@query(r"""
with p as (select doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) as ps from documents),
e as (select doc_id, unnest(ps) as part, generate_subscripts(ps, 1) as pos from p),
s as (select doc_id, pos, part, coalesce(sum(length(part) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::int as start_at from e)
select doc_id, start_at, (start_at + length(part))::int as end_at from s where regexp_matches(part, '\S')
""")
def section_boundaries(spark, sf_dir):
    docs = T.each(table(spark, sf_dir, "documents"), ["doc_id"], T.boundaries(F.replace("text", F.lit("\n"), F.lit("\n\n"))), "b")
    return docs.select("doc_id", F.col("b.start").alias("start_at"), F.col("b.end").alias("end_at"))


@query(None)
def sentence_split(spark, sf_dir):
    """Sentences of every document (look-behind rules, beyond the second engine's regular expressions)."""
    return T.each(table(spark, sf_dir, "documents"), ["doc_id"], T.sentences("text"), "sentence").select("doc_id", "pos", "sentence")


@query(r"""
select doc_id, substr(sha256('/corpus/' || source || '/' || doc_id || '.txt' || '::' || text), 1, 16) as doc_hash, regexp_extract('/corpus/' || source || '/' || doc_id || '.txt', '[^/]*$') as file_name,
  case when length(text) > 500 then substr(text, 1, 500) || '...' else text end as preview from documents
""")
def document_hashes(spark, sf_dir):
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", T.document_hash(path, "text").alias("doc_hash"), T.basename(path).alias("file_name"), T.preview("text").alias("preview"))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by sha256(text)")
def dedupe_exact(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


# Sections: every fifth line becomes a heading of one of the four kinds, between blank lines at some places.
_HEADED = "concat_ws('\\n', transform(split(text, '\\n'), (l, i) -> case i % 10 when 0 then concat('# Topic ', doc_id, '\\n', l) when 3 then concat('Chapter IV: Growth\\n', l) when 5 then concat('A Plain Heading\\n', l) when 7 then concat('\\n', l, '\\nSUMMARY 2024') else l end))"
_HEADED_SQL = r"array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case (i - 1) % 10 when 0 then '# Topic ' || doc_id || chr(10) || l when 3 then 'Chapter IV: Growth' || chr(10) || l when 5 then 'A Plain Heading' || chr(10) || l when 7 then chr(10) || l || chr(10) || 'SUMMARY 2024' else l end), chr(10))"
_SECTION_ROWS = rf"""
headed as (select doc_id, {_HEADED_SQL} as h from documents),
ln as (select doc_id, unnest(string_split(regexp_replace(h, '\n$', ''), chr(10))) as raw, generate_subscripts(string_split(regexp_replace(h, '\n$', ''), chr(10)), 1) as pos from headed),
st as (select doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') as line from ln),
hd as (select *, case when regexp_matches(line, '^#{{1,6}}\s+') then 'm' when regexp_matches(line, '^(?i)(chapter|section|part|appendix)\s+([ivxlcdm\d.:]+)([:.\s].*)?$') then 'n'
  when regexp_matches(line, '^[A-Z][A-Za-z\s]*$') and length(line) < 150 then 't' when regexp_matches(line, '^[A-Z\s\d]+$') then 'c' else 'p' end as kind,
  regexp_matches(line, '^[A-Z][A-Za-z\s]*$') and length(line) >= 150 as breaks from st),
pv as (select *, lag(kind) over (partition by doc_id order by pos) as pk, lag(line) over (partition by doc_id order by pos) as pl from hd),
isl as (select *, sum(case when kind <> 'p' or breaks or pk is null or pk <> 'p' or pl = '' then 1 else 0 end) over (partition by doc_id order by pos) as island from pv where line <> ''),
sec as (select doc_id, island, min(pos) as p0, min(kind) as kind, string_agg(line, ' ' order by pos) as body from isl group by doc_id, island),
sections as (select doc_id, (row_number() over (partition by doc_id order by p0) - 1)::int as pos,
  case kind when 'm' then regexp_replace(regexp_extract(body, '^#{{1,6}}\s+(.*)', 1), '\s+$', '') when 'n' then regexp_replace(regexp_replace(body, '^(?i)(chapter|section|part|appendix)\s+([ivxlcdm\d.:]+)(?:([:.\s].*))?$', '\1 \2 \3'), '\s+$', '') else body end as content,
  case when kind = 'p' then 'paragraph' else 'heading' end as section_type,
  case kind when 'm' then length(regexp_extract(body, '^(#+)', 1)) when 'n' then case when starts_with(body, 'Chapter') then 1 else 2 end when 't' then 2 when 'c' then 1 else 0 end::int as level from sec)
"""


def headed_sections(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sections.extract(F.expr(_HEADED)).alias("sections"))


@query(f"with {_SECTION_ROWS} select * from sections")
def heuristic_sections(spark, sf_dir):
    return sections.explode(headed_sections(spark, sf_dir))


@query(f"""
with {_SECTION_ROWS},
heads as (select doc_id, pos, content, level, max(pos) over (partition by doc_id order by pos rows between 1 following and unbounded following) as last from sections where section_type = 'heading'),
alive as (select h.doc_id, h.pos, h.content from heads h where not exists (select 1 from heads g where g.doc_id = h.doc_id and g.pos > h.pos and g.level <= h.level))
select doc_id, string_agg(content, ' > ' order by pos) as path from alive group by doc_id
""")
def heading_path(spark, sf_dir):
    # as a generator's rows: a filter on the path would work the sections out once more
    path = T.let(F.array_join(sections.heading_path(F.col("sections")), " > "), lambda p: F.when(p != "", F.array(p)))
    return T.each(headed_sections(spark, sf_dir), ["doc_id"], path, "path").select("doc_id", "path")


@query(r"""
with w as (select doc_id, right(text, 150) as t, text from documents)
select doc_id, case when length(text) <= 150 then text when regexp_matches(t, '(?s)[.!?]\s') then regexp_extract(t, '(?s)^.*[.!?]\s(.*)$', 1) when len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) > 3 then array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')[-3:], ' ') else right(text, 100) end as fixed_overlap,
  regexp_replace(case when regexp_matches(t, '[.!?]\s*$') and regexp_matches(t, '\.\s+[A-Z]') then regexp_extract(t, '(?s)^.*?\.\s(\s*[A-Z].*)$', 1) else t end, '^\s+|\s+$', '', 'g') as semantic_overlap from w
""")
def overlap_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.fixed_overlap("text", 150).alias("fixed_overlap"), chunking.semantic_overlap("text", 150).alias("semantic_overlap"))


@query(None)
def chunk_fixed(spark, sf_dir):
    return chunking.chunk(headed_sections(spark, sf_dir), chunking.Chunking(strategy="fixed_size")).select("doc_id", "sequence", "content", F.array_join("headings.content", " > ").alias("headings"))


@query(None)
def chunk_semantic(spark, sf_dir):
    return chunking.chunk(headed_sections(spark, sf_dir), chunking.Chunking()).select("doc_id", "sequence", "content", F.array_join("headings.content", " > ").alias("headings"))


@query(r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) - 1 as seq from documents),
n as (select *, length(content) < 500 and length(content) + lead(length(content)) over w <= 2750 as ok from l window w as (partition by doc_id order by seq)),
i as (select *, coalesce(ok, false) as elig, sum(case when coalesce(ok, false) then 0 else 1 end) over (partition by doc_id order by seq) as run from n),
o as (select *, case when elig then (row_number() over (partition by doc_id, run, elig order by seq)) % 2 = 1 else false end as merges from i),
f as (select *, lag(merges, 1, false) over w as eaten, lead(content) over w as nxt from o window w as (partition by doc_id order by seq))
select doc_id, (row_number() over (partition by doc_id order by seq) - 1)::int as sequence, case when merges then content || chr(10) || chr(10) || nxt else content end as content from f where not eaten
""")
def chunk_merge_small(spark, sf_dir):
    lines = T.each(table(spark, sf_dir, "documents"), ["doc_id"], F.split("text", "\n"), "content", "sequence")
    return chunking.merge_small(lines, 500, 2500).select("doc_id", "sequence", "content")


@query(r"""
with d as (select doc_id, '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'language: ' || lang || chr(10) || '---' || chr(10) || text as md from documents)
select doc_id, regexp_replace(md, '(?s)^---\s*\n.*?\n---\s*\n', '') as body, regexp_extract(md, 'title: ([^\n]*)', 1) as title, regexp_extract(md, 'language: ([^\n]*)', 1) as language from d
""")
def front_matter(spark, sf_dir):
    from sparkloom.sources import markdown

    md = F.concat(F.lit("---\ntitle: Doc "), "doc_id", F.lit("\nlanguage: "), "lang", F.lit("\n---\n"), "text")
    meta = markdown.front_matter(md)
    return table(spark, sf_dir, "documents").select("doc_id", markdown.strip_front_matter(md).alias("body"), meta["title"].alias("title"), meta["language"].alias("language"))


@query(rf"""
with headed as (select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case (i - 1) % 4 when 0 then '## Part ' || i || chr(10) || l when 2 then l || chr(10) else l end), chr(10)) as h from documents),
ln as (select doc_id, unnest(string_split(regexp_replace(h, '\n$', ''), chr(10))) as raw, generate_subscripts(string_split(regexp_replace(h, '\n$', ''), chr(10)), 1) as pos from headed),
hd as (select *, regexp_replace(raw, '^\s+|\s+$', '', 'g') as line, regexp_matches(raw, '^#{{1,6}}\s+') as head from ln),
pv as (select *, lag(head) over (partition by doc_id order by pos) as ph, lag(line) over (partition by doc_id order by pos) as pl from hd),
isl as (select *, sum(case when head or ph is null or ph or pl = '' then 1 else 0 end) over (partition by doc_id order by pos) as island from pv where line <> ''),
sec as (select doc_id, island, min(pos) as p0, bool_or(head) as head, string_agg(line, chr(10) order by pos) as body from isl group by doc_id, island)
select doc_id, (row_number() over (partition by doc_id order by p0) - 1)::int as pos, case when head then regexp_extract(body, '^#{{1,6}}\s+(.*)', 1) else body end as content, case when head then 'heading' else 'paragraph' end as section_type, case when head then 2 else 0 end::int as level from sec
""")
def markdown_sections(spark, sf_dir):
    md = F.expr("concat_ws('\\n', transform(split(text, '\\n'), (l, i) -> case i % 4 when 0 then concat('## Part ', i + 1, '\\n', l) when 2 then concat(l, '\\n') else l end))")
    docs = table(spark, sf_dir, "documents").select("doc_id", sections.extract(md, markdown_only=True).alias("sections"))
    return sections.explode(docs)


# Pages as tables of blocks: made from the part table, 10 blocks a page, 5 pages a document.
_BLOCKS_SQL = """blocks as (select p_partkey // 50 as doc_id, ((p_partkey // 10) % 5)::int as page, (p_partkey % 10)::int as block, (10 + p_size % 4 * 2)::double as size, (p_partkey % 2 * 300 + 20)::double as x0, (p_partkey % 2 * 300 + 270)::double as x1, (p_retailprice * 7 % 780)::double as y0,
 p_size % 7 = 0 as bold, case when p_partkey % 10 = 0 then 'Annual Report' else p_name || ' ' || p_partkey end as text from part)"""


def blocks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 50 as doc_id", "cast((p_partkey div 10) % 5 as int) as page", "cast(p_partkey % 10 as int) as block", "cast(10 + p_size % 4 * 2 as double) as size", "cast(p_partkey % 2 * 300 + 20 as double) as x0", "cast(p_partkey % 2 * 300 + 270 as double) as x1",
        "cast(p_retailprice * 7 % 780 as double) as y0", "p_size % 7 = 0 as bold", "case when p_partkey % 10 = 0 then 'Annual Report' else concat(p_name, ' ', p_partkey) end as text", "600D as page_width", "800D as page_height",
    )


@query(f"""
with {_BLOCKS_SQL}, c as (select doc_id, page, size, count(*) as n, min(block) as first from blocks group by 1, 2, 3)
select doc_id, page, size as body_size from (select *, row_number() over (partition by doc_id, page order by n desc, first) as r from c) where r = 1
""")
def page_body_font(spark, sf_dir):
    return P.body_font(blocks(spark, sf_dir))


@query(f"""
with {_BLOCKS_SQL}, c as (select doc_id, page, size, count(*) as n, min(block) as first from blocks group by 1, 2, 3),
b as (select doc_id, page, size as body from (select *, row_number() over (partition by doc_id, page order by n desc, first) as r from c) where r = 1),
k as (select x.*, b.body, size > body * 1.2 or bold as head from blocks x join b using (doc_id, page))
select doc_id, page, block, (row_number() over (partition by doc_id, page order by y0, block) - 1)::int as pos, case when head and y0 < 160 and size > body * 1.5 then 'title' when head then 'heading' else 'paragraph' end as section_type,
  case when not head then 0 when y0 < 160 and size > body * 1.5 then 1 when size < body * 1.5 then 2 else 1 end::int as level, case when head then text || ' [Page ' || (page + 1) || ']' else text end as content from k
""")
def page_reading_order(spark, sf_dir):
    return P.reading_order(blocks(spark, sf_dir)).select("doc_id", "page", "block", "pos", "section_type", "level", "content")


@query(f"""
with {_BLOCKS_SQL}, h as (select doc_id, page, least(floor((x0 + x1) / 2 / 60), 9)::int as bin, count(*) as n from blocks group by 1, 2, 3),
g as (select p.doc_id, p.page, b.bin::int as bin, coalesce(h.n, 0) as n from (select distinct doc_id, page from blocks) p cross join (select unnest(range(10)) as bin) b left join h on h.doc_id = p.doc_id and h.page = p.page and h.bin = b.bin),
k as (select doc_id, page, n, bin between 1 and 8 and n > lag(n) over w and n > lead(n) over w as peak from g window w as (partition by doc_id, page order by bin))
select doc_id, page, case when sum(n) < 3 or count(*) filter (peak) = 0 then 1 else count(*) filter (peak) + 1 end::int as n_columns from k group by 1, 2
""")
def page_columns(spark, sf_dir):
    return P.column_count(blocks(spark, sf_dir))


@query(None)
def page_headers_footers(spark, sf_dir):
    """Lines that repeat at the head or foot of pages, matched fuzzily in page order."""
    return P.repeated_lines(blocks(spark, sf_dir))


@query(None)
def page_documents(spark, sf_dir):
    """Blocks to documents through all page passes: heads and feet dropped, columns in order, pages joined; sections beside."""
    return P.documents(blocks(spark, sf_dir))


@query("""
with p as (select page_id, length(html) % 120 as text_len, page_id % 2 as images, (600 * 800)::double as area from pages)
select page_id, images > 0 and (text_len < 50 or text_len / area < 0.0005) as needs_ocr from p
""")
def page_ocr_need(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", "length(html) % 120 as text_len", "page_id % 2 as images", "480000D as area")
    return p.select("page_id", P.needs_ocr("images", "text_len", "area").alias("needs_ocr"))


@query(r"""
with n as (select doc_id, replace(replace(text, ' of ', chr(10) || 'ab' || chr(10) || '| '), 'th', '¢') as raw from documents),
l as (select doc_id, array_to_string(list_filter(string_split(raw, chr(10)), lambda l: length(trim(l)) > 3), chr(10)) as t from n)
select doc_id, regexp_replace(replace(replace(t, '|', 'I'), '¢', 'c'), '(\w)\.(\w)', '\1\2', 'g') as text from l
""")
def ocr_cleanup(spark, sf_dir):
    raw = F.replace(F.replace("text", F.lit(" of "), F.lit("\nab\n| ")), F.lit("th"), F.lit("¢"))
    return table(spark, sf_dir, "documents").select("doc_id", P.clean_ocr(raw).alias("text"))
