"""Markdown documents made from the web pages, tables made from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomeworks import constants as K
from tomeworks.operators import documents as D
from tomeworks.operators import images as I
from tomeworks.plans import base as b
from tomeworks.plans.base import query, quote

# HTML to Markdown: the menu becomes a fenced block with image references, the ad a heading
# with an image, bold lines second-level headings.
_STEPS = (
    ("(?s)<head>.*?</head>", ""),
    ("<nav>", "\n```\n# menu\n"),
    ("</nav>", "\n```\n"),
    ('<li><a href="([^"]*)">([^<]*)</a></li>', "![{2}]({1}.png)\n"),
    ('<div class="ad">', "\n### ad\nBefore the ad.\n\n![ad](/img/ad.jpg)\n\n"),
    ("<h1>([^<]*)</h1>", "\n# {1}\n"),
    ("<b>([^<\n]*)", "\n## {1}\n"),
    ("<footer>", "\n#### footer\n"),
    ("<[^>]*>", "\n"),
)


def md_pages(spark, sf_dir):
    text = F.col("html")
    for pattern, out in _STEPS:
        text = F.regexp_replace(text, pattern, out.replace("{1}", "$1").replace("{2}", "$2"))
    return b.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("file_title"),
        text.alias("md_content"))


_MD = "html"
for _pattern, _out in _STEPS:
    _out = _out.replace("{1}", "\\1").replace("{2}", "\\2")
    _MD = f"regexp_replace({_MD}, {quote(_pattern)}, {quote(_out)}, 'g')"
MD = f"md AS (SELECT page_id AS doc_id, 'page ' || page_id AS file_title, {_MD} AS md_content FROM pages)"
LINES = """lines AS (
  SELECT doc_id, file_title, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line
  FROM (SELECT doc_id, file_title, string_split(md_content, chr(10)) AS ls FROM md))"""
SECTIONS = f"""{MD}, {LINES},
fenced AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS inside FROM lines),
headed AS (SELECT *, NOT inside AND regexp_matches(line, '^\\s*#{{1,6}}\\s+.+$') AS is_head FROM fenced),
numbered AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM headed),
grouped AS (
  SELECT doc_id, file_title, sec, {b.sql_strip("max(CASE WHEN is_head THEN line END)")} AS head,
         coalesce({b.sql_strip("string_agg(CASE WHEN NOT is_head THEN line END, chr(10) ORDER BY i)")}, '') AS body
  FROM numbered GROUP BY doc_id, file_title, sec),
leveled AS (
  SELECT *, length(regexp_extract(head, '^#{{1,6}}')) AS level,
         row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS pos
  FROM grouped WHERE sec > 0 OR body <> ''),
sections AS (
  SELECT doc_id, file_title, pos, coalesce(head, file_title) AS title, body,
         coalesce((SELECT arg_max(u.head, u.sec) FROM leveled u
                   WHERE u.doc_id = s.doc_id AND u.sec < s.sec AND u.sec > 0 AND u.level < s.level),
                  head, file_title) AS parent_title
  FROM leveled s)"""


@query("sections", f"WITH {SECTIONS} SELECT doc_id, file_title, pos, title, parent_title, body FROM sections")
def sections(spark, sf_dir):
    return D.explode_sections(D.split_sections(md_pages(spark, sf_dir)))


def _fold(source: str) -> str:
    """Recursive SQL of the greedy merge over ``source(doc_id, file_title, pos, title, parent_title, body)``."""
    absorb = f"f.parent_title = s.parent_title AND length(f.body) < {K.MIN_SECTION}"
    chars = quote(K.WHITESPACE)
    return f"""fold AS (
  SELECT doc_id, file_title, pos, title, parent_title, body, 0 AS grp FROM {source} WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.file_title, s.pos, CASE WHEN {absorb} THEN f.parent_title ELSE s.title END, s.parent_title,
         CASE WHEN {absorb} THEN rtrim(f.body, {chars}) || chr(10) || chr(10) || ltrim(s.body, {chars}) ELSE s.body END,
         CASE WHEN {absorb} THEN f.grp ELSE f.grp + 1 END
  FROM fold f JOIN {source} s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1),
merged AS (
  SELECT doc_id, file_title, grp AS pos, arg_max(title, pos) AS title, arg_max(parent_title, pos) AS parent_title,
         arg_max(body, pos) AS body FROM fold GROUP BY doc_id, file_title, grp)"""


@query("merged_sections", f"""WITH RECURSIVE {SECTIONS}, {_fold('sections')}
SELECT doc_id, pos, title || chr(10) || chr(10) || body AS content, title, parent_title, file_title FROM merged""")
def merged_sections(spark, sf_dir):
    found = D.merge_short(D.split_sections(md_pages(spark, sf_dir)))
    return D.assemble_chunks(found).drop("chunk_id")


_ITEM = "STRUCT(t VARCHAR, d BOOLEAN)"


def _sql_pieces(text: str, limit: str) -> str:
    """SQL of the size-bounded splitter: the separators one after another over a list of pieces ``t``,
    ``d`` for those that are finished."""
    items = f"[{{'t': {text}, 'd': false}}]"
    for n, sep in enumerate(K.SPLIT_SEPARATORS):
        x, p, a, q, r = (f"{name}{n}" for name in "xpaqr")
        if not sep:
            made = f"list_transform(regexp_extract_all({x}.t, '(?s).{{1,' || {limit} || '}}'), lambda {p}: {{'t': {p}, 'd': true}})"
            items = f"flatten(list_transform({items}, lambda {x}: CASE WHEN {x}.d THEN [{x}] ELSE {made} END))"
            continue
        mark = " || ".join(["chr(10)"] * len(sep)) if sep.strip("\n") == "" else quote(sep)
        parts = f"""list_transform(string_split({x}.t, {mark}), lambda {p}, i{n}: {{'out': []::{_ITEM}[], 'open': CASE WHEN i{n} = 1 THEN {p} ELSE {mark} || {p} END}})"""
        flushed = f"CASE WHEN {a}.open = '' THEN {a}.out ELSE list_append({a}.out, {{'t': {a}.open, 'd': true}}) END"
        step = f"""CASE WHEN length({q}.open) >= {limit} THEN {{'out': list_append({flushed}, {{'t': {q}.open, 'd': false}}), 'open': ''}}
          WHEN length({a}.open) + length({q}.open) > {limit} THEN {{'out': {flushed}, 'open': {q}.open}} ELSE {{'out': {a}.out, 'open': {a}.open || {q}.open}} END"""
        packed = f"list_reduce({parts}, lambda {a}, {q}: {step}, {{'out': []::{_ITEM}[], 'open': ''}})"
        closed = f"list_transform([{packed}], lambda {r}: CASE WHEN {r}.open = '' THEN {r}.out ELSE list_append({r}.out, {{'t': {r}.open, 'd': true}}) END)[1]"
        items = f"flatten(list_transform({items}, lambda {x}: CASE WHEN {x}.d OR NOT contains({x}.t, {mark}) THEN [{x}] ELSE {closed} END))"
    return f"list_filter(list_transform({items}, lambda y: {b.sql_strip('y.t')}), lambda z: z <> '')"


_IMPORTED = f"""imported AS (
  SELECT page_id AS doc_id, 'page ' || page_id AS file_title, {_MD} AS md_content FROM pages
  UNION ALL SELECT doc_id + 1000000000, source, coalesce(text, '') FROM documents),
md AS (SELECT doc_id, file_title, regexp_replace(md_content, '\\r\\n?', chr(10), 'g') AS md_content FROM imported)"""
_CUT = f"""roomy AS (SELECT *, {K.MAX_SECTION - 2} - least(length(title), {K.TITLE_PREFIX}) AS room FROM sections),
cut AS (
  SELECT doc_id, file_title, row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1 AS pos,
         CASE WHEN n > 1 THEN substr(title, 1, {K.TITLE_PREFIX}) || '_' || i ELSE title END AS title, parent_title,
         CASE WHEN n > 1 THEN piece ELSE body END AS body
  FROM (SELECT *, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i, len(pieces) AS n FROM (
    SELECT *, CASE WHEN length(body) > room AND room > 0 THEN {_sql_pieces('body', 'room')} ELSE [body] END AS pieces FROM roomy)))"""


@query("document_chunks", f"""WITH RECURSIVE {SECTIONS.replace(MD, _IMPORTED)}, {_CUT}, {_fold('cut')}
SELECT doc_id, pos, title || chr(10) || chr(10) || body AS content, title, parent_title, file_title FROM merged""")
def document_chunks(spark, sf_dir):
    """The whole import path over pages and documents: sections, splitting, merging. These texts hold no
    table markup, which ``table_sentences`` covers."""
    docs = b.documents(spark, sf_dir).select(
        (F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.col("source").alias("file_title"), F.col("text").alias("md_content"))
    chunks = D.import_chunks(md_pages(spark, sf_dir).unionByName(docs))
    return chunks.drop("chunk_id")


@query("chunk_coverage", """
SELECT doc_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS kept_chars FROM documents
WHERE regexp_matches(text, '\\S')""")
def chunk_coverage(spark, sf_dir):
    """Non-blank characters of each document that its chunks hold: splitting loses none."""
    docs = b.documents(spark, sf_dir).select("doc_id", F.lit("f").alias("file_title"), F.col("text").alias("md_content"))
    body = F.substring("content", F.length("title") + 3, F.length("content"))
    return D.import_chunks(docs).groupBy("doc_id").agg(
        F.sum(F.length(F.regexp_replace(body, r"\s", ""))).alias("kept_chars"))


def spec_sheets(spark, sf_dir):
    """Parts as documents: a key-value table, a spanned HTML table, a Markdown table. The rows are dealt to all cores
    while they are narrow: a small file of them is one task, and makes many times its size of text."""
    p = b.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").repartition(
        4 * spark.sparkContext.defaultParallelism)
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    rows = F.concat(
        F.lit("Intro\n<table><tr><td>brand</td><td>"), "p_brand", F.lit("</td></tr><tr><td></td><td>"), "p_type",
        F.lit("</td></tr><tr><td>size</td><td></td></tr></table>\nthen\n"
              "<TABLE border='1'><tr><th>part</th><th colspan=\"2\">facts</th></tr><tr><td rowspan='2'>"), "p_name",
        F.lit("</td><td>"), size, F.lit("</td><td>-</td></tr><tr><td>"), price,
        F.lit("</td><td>a<br>b &amp; c</td></tr></TABLE>\n| name | size | note |\n|---|:-:|---|\n| "), "p_name",
        F.lit(" | "), size, F.lit(" | / |\n|  | "), price, F.lit(" | 无 |\nend"))
    return p.select(
        F.col("p_partkey").alias("doc_id"), F.lit("sheet").alias("file_title"), F.concat(F.lit("# Sheet\n"), rows).alias("md_content"))


_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR)"


@query("table_sentences", f"""
SELECT p_partkey AS doc_id, replace(
  'Intro|||- 【brand】：' || p_brand || '。|- 【未知属性】：' || p_type || '。|- 【size】：无。|||then|||'
  || '- 【' || p_name || '】(对应part)：facts为' || p_size || '。|'
  || '- 【' || p_name || '】(对应part)：facts为' || {_PRICE} || '，facts为a b & c。|||||'
  || '- 【' || p_name || '】(对应name)：size为' || p_size || '。|'
  || '- 【未知项目】(对应name)：size为' || {_PRICE} || '。||end', '|', chr(10)) AS body FROM part""")
def table_sentences(spark, sf_dir):
    found = D.linearize_tables(D.split_sections(spec_sheets(spark, sf_dir)))
    return D.explode_sections(found).select("doc_id", "body")


_NAMES = "regexp_extract_all(html, '<li><a href=\"/([^\"/]*)\">', 1)"


def page_images(spark, sf_dir):
    """Image files of each page; some of the menu entries have none, and one is never used."""
    p = b.table(spark, sf_dir, "pages")
    named = p.select("page_id", F.explode(F.concat(
        F.transform(F.regexp_extract_all("html", F.lit('<li><a href="/([^"/]*)">'), F.lit(1)), lambda n: F.concat(n, F.lit(".png"))),
        F.array(F.lit("ad.jpg"), F.lit("unused.gif"), F.lit("notes.txt")))).alias("name"))
    return named.where(~F.col("name").rlike("^[n-z]") | F.col("name").isin("unused.gif")).distinct().select(
        F.col("page_id").alias("doc_id"), "name", F.concat(F.lit("pic "), "name").alias("summary"),
        F.concat(F.lit("http://img/"), "name").alias("url"))


IMAGES = f"""images AS (
  SELECT DISTINCT page_id AS doc_id, name FROM (
    SELECT page_id, unnest(list_concat(list_transform({_NAMES}, lambda n: n || '.png'), ['ad.jpg', 'unused.gif', 'notes.txt'])) AS name
    FROM pages) WHERE NOT regexp_matches(name, '^[n-z]') OR name = 'unused.gif')"""


@query("image_rewrite", f"""WITH {MD}
SELECT doc_id, regexp_replace(md_content, '!\\[[^\\n]*?\\]\\((?:[^\\n)]*/)?([^n-z/\\n)][^/\\n)]*)\\)',
                              '![pic \\1](http://img/\\1)', 'g') AS md_content FROM md""")
def image_rewrite(spark, sf_dir):
    return I.rewrite_images(md_pages(spark, sf_dir), page_images(spark, sf_dir)).select("doc_id", "md_content")


def _around(direction: str) -> str:
    before = direction == "pre"
    where = "l.i > r.up AND l.i < r.i" if before else "l.i > r.i AND l.i < r.down"
    order = "DESC" if before else "ASC"
    return f"""{direction}_lines AS (
  SELECT r.doc_id, r.name, l.i, l.line, {b.sql_strip('l.line')} = '' OR regexp_matches({b.sql_strip('l.line')}, '^!\\[.*?\\]\\(.*?\\)$') AS cut
  FROM firsts r JOIN lines l ON l.doc_id = r.doc_id AND {where}),
{direction}_paras AS (
  SELECT doc_id, name, para, string_agg(line, chr(10) ORDER BY i) AS text FROM (
    SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, name ORDER BY i) AS para FROM {direction}_lines)
  WHERE NOT cut GROUP BY doc_id, name, para),
{direction}_text AS (
  SELECT doc_id, name, string_agg(text, chr(10) || chr(10) ORDER BY para) AS text FROM (
    SELECT *, sum(length(text)) OVER w AS total, row_number() OVER w AS n FROM {direction}_paras
    WINDOW w AS (PARTITION BY doc_id, name ORDER BY para {order}))
  WHERE n = 1 OR total <= {K.IMAGE_CONTEXT} GROUP BY doc_id, name)"""


@query("image_contexts", f"""WITH {MD}, {LINES}, {IMAGES},
refs AS (
  SELECT doc_id, i, unnest(regexp_extract_all(line, '!\\[[^\\n]*?\\]\\((?:[^\\n)]*/)?([^/\\n)]*)\\)', 1)) AS name FROM lines),
heads AS (SELECT doc_id, i, line FROM lines WHERE regexp_matches(line, '^#{{1,6}}\\s+')),
firsts AS (
  SELECT doc_id, name, i, coalesce((SELECT max(h.i) FROM heads h WHERE h.doc_id = f.doc_id AND h.i < f.i), 0) AS up,
         coalesce((SELECT min(h.i) FROM heads h WHERE h.doc_id = f.doc_id AND h.i > f.i), 1000000000) AS down
  FROM (SELECT r.doc_id, r.name, min(r.i) AS i FROM refs r JOIN images m ON m.doc_id = r.doc_id AND m.name = r.name
        WHERE regexp_matches(lower(r.name), '[.](jpg|jpeg|png|gif|bmp|webp)$') GROUP BY r.doc_id, r.name) f),
{_around('pre')}, {_around('post')}
SELECT f.doc_id, f.name, f.i - 1 AS line,
       coalesce((SELECT h.line FROM heads h WHERE h.doc_id = f.doc_id AND h.i = f.up), '') AS head,
       coalesce(p.text, '') AS pre_text, coalesce(q.text, '') AS post_text
FROM firsts f LEFT JOIN pre_text p ON p.doc_id = f.doc_id AND p.name = f.name
              LEFT JOIN post_text q ON q.doc_id = f.doc_id AND q.name = f.name""")
def image_contexts(spark, sf_dir):
    return I.image_contexts(md_pages(spark, sf_dir), page_images(spark, sf_dir))
