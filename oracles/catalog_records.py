"""Registered queries for files, markup, page runs, structured records, reports and corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from doclint.functions import dates as dt
from doclint.functions import fixed_values as fv
from doclint.functions import text as tx
from doclint.operators import keywords as kw
from doclint.operators import markup as mk
from doclint.operators import page_runs as pr
from doclint.operators import report as rp
from doclint.operators import resume as rs
from doclint.operators import scoring as sc
from doclint.operators.messages import LABELS, MESSAGES
from doclint.plans import corpus as cp
from doclint.sources import files as fl
from doclint.sources.sinks import table_cut

from . import fixtures as fx
from . import sql as S
from .catalog import analysis, big, jobs, pair, query, res
from .catalog import _matches, _scored

STATS = f"({fx.CUSTOMER_STATS}) s"
TAB, NL = "chr(9)", "chr(10)"


# ---- normalisation of compatibility characters ---------------------------------------------
@query("compose_compat", "SELECT c_custkey AS doc_id, 'fi' || c_name AS text FROM customer")
def _(spark, d):
    wide = F.translate("c_name", "0123456789#", "０１２３４５６７８９＃")
    return fx.spark_view(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"), tx.normalize_text(F.concat(F.lit("ﬁ"), wide)).alias("text")
    )


# ---- files ----------------------------------------------------------------------------------
_KINDS = {
    0: ("txt", "unhex('')", None, "empty_file"), 1: ("pdf", "concat(encode('junk %PDF-1.7 ', 'UTF-8'), encode(text, 'UTF-8'))", "pdf", None),
    2: ("docx", "concat(encode('%PDF-1.7 ', 'UTF-8'), encode(text, 'UTF-8'))", None, "extension_mismatch"),
    3: ("docx", "concat(unhex('504B0304'), encode(text, 'UTF-8'))", "docx", None), 4: ("doc", "concat(unhex('504B0304'), encode(text, 'UTF-8'))", "docx", None),
    5: ("pdf", "encode(text, 'UTF-8')", None, "extension_mismatch"), 6: ("TXT", "encode(text, 'UTF-8')", "txt", None),
    7: ("md", "encode(text, 'UTF-8')", "txt", None), 8: ("xyz", "encode(text, 'UTF-8')", None, "unsupported_type"),
    9: ("doc", "concat(unhex('D0CF11E0A1B11AE1'), encode(text, 'UTF-8'))", None, "legacy_doc"),
    10: ("txt", "encode(repeat(concat(text, 'x'), CAST(ceil(5300000 / (octet_length(text) + 1.0)) AS INT)), 'UTF-8')", None, "too_large"),
}


@query("file_formats", "SELECT doc_id, " + ", ".join(
    f"CASE doc_id % 101 {' '.join(f'WHEN {i} THEN {S.q(v[pos]) if v[pos] else chr(78) + chr(85) + chr(76) + chr(76)}' for i, v in _KINDS.items())} ELSE {default} END AS {name}"
    for pos, name, default in ((2, "format", "'txt'"), (3, "error_code", "NULL"))) + " FROM documents")
def _(spark, d):
    arms = lambda pos, default: f"CASE doc_id % 101 {' '.join(f'WHEN {i} THEN {S.q(v[pos]) if pos == 0 else v[pos]}' for i, v in _KINDS.items())} ELSE {default} END"
    files = fx.spark_view(spark, d, "documents").select(
        "doc_id", F.expr(f"concat('s3://bucket/a.b/', doc_id, '.', {arms(0, chr(39) + 'txt' + chr(39))})").alias("path"),
        F.expr(arms(1, "encode(text, 'UTF-8')")).alias("content"),
    ).withColumn("length", F.octet_length("content").cast("bigint"))
    return fl.classify(fl.admit(files, 5 * 1024 * 1024)).select("doc_id", "format", "error_code")


def _decoded(spark, d):
    """Text files of five encodings, one per document."""
    content = """CASE doc_id % 5 WHEN 0 THEN concat(unhex('FFFE'), encode(text, 'UTF-16LE')) WHEN 1 THEN concat(unhex('FEFF'), encode(text, 'UTF-16BE'))
        WHEN 2 THEN concat(unhex('EFBBBF'), encode(text, 'UTF-8')) WHEN 3 THEN
          CASE WHEN text RLIKE '^[\\\\x00-\\\\x7F\\\\xA0-\\\\xFF]*$' THEN encode(text, 'ISO-8859-1') ELSE encode(text, 'UTF-8') END
        ELSE concat(encode(text, 'UTF-8'), unhex('00')) END"""
    files = fx.spark_view(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.expr(content).alias("content")
    ).withColumn("length", F.octet_length("content").cast("bigint"))
    return fl.text_documents(fl.classify(fl.admit(files)))


@query("text_decode", "SELECT doc_id, text, CASE WHEN doc_id % 5 = 4 THEN 'invalid_text' END AS error_code FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE text END AS text FROM documents) x")
def _(spark, d):
    return _decoded(spark, d).select("doc_id", "text", "error_code")


# ---- markup ---------------------------------------------------------------------------------
_BODY_TEXT = f"""(name || ' & Co <' || k || '> é😀&nope;' || {TAB} || 'tab' || {NL} || repeat('Order line ' || segment || {NL} || 'next-part' || {NL}, n)
  || CASE WHEN k % 3 = 0 THEN 'cell ' || k || {NL} || {TAB} || {NL} || {TAB} ELSE '' END
  || CASE WHEN k % 4 = 0 THEN 'box' || {NL} ELSE '' END || CASE WHEN k % 7 = 0 THEN 'late' || {NL} || {NL} ELSE '' END
  || CASE WHEN k % 11 = 0 THEN 'deep' || {NL} ELSE '' END)"""
_HEAD, _FOOT = f"'h' || k || '@example.com' || {NL}", f"'Page 1' || {NL}"
_PART_TEXTS = f"""SELECT k AS doc_id, 1 AS part_no, {_BODY_TEXT} AS text FROM {STATS} WHERE bal < 9500
  UNION ALL SELECT k, 2, 'second body' || {NL} FROM {STATS} WHERE bal < 500 OR bal > 9000
  UNION ALL SELECT k, 3, {_HEAD} FROM {STATS} WHERE bal > 4000 UNION ALL SELECT k, 4, {_FOOT} FROM {STATS} WHERE segment <> 'BUILDING'"""


def _parts(spark, d):
    return fx.spark_view(spark, d, "synth_parts")


@query("entity_decode", f"SELECT k AS doc_id, name || ' & Co <' || k || '> é😀&nope; &amp;' AS text FROM {STATS}")
def _(spark, d):
    rows = fx.spark_view(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        F.concat(F.col("c_name"), F.lit(" &amp; Co &lt;"), F.col("c_custkey").cast("string"), F.lit("&gt; &#233;&#x1F600;&#0;&#55296;&nope; &amp;amp;")).alias("t"),
    )
    return rows.select("doc_id", mk.decode_entities(F.col("t")).alias("text"))


@query("docx_text", _PART_TEXTS)
def _(spark, d):
    return mk.part_text(_parts(spark, d).filter("xml <> '' AND part_no > 0")).select("doc_id", "part_no", "text")


@query("docx_layout", f"""SELECT k AS doc_id, CAST(k % 3 = 0 AS BIGINT) AS tables, CAST(k % 4 = 0 AS BIGINT) AS text_boxes, k % 5 = 0 AS columns FROM {STATS} WHERE bal < 9500""")
def _(spark, d):
    return mk.part_layout(_parts(spark, d).filter("part_no = 1")).select("doc_id", "tables", "text_boxes", "columns")


@query("docx_documents", f"""SELECT k AS doc_id, CASE WHEN ok THEN body END AS text, CASE WHEN ok THEN trim(margin, {NL}) END AS header_footer_text, images,
    CASE WHEN NOT ok THEN 'invalid_docx' END AS error_code FROM (SELECT k, bal > -800 AND (bal < 9500 OR bal > 9000) AS ok,
      CASE WHEN bal < 9500 THEN {_BODY_TEXT} ELSE 'second body' || {NL} END AS body,
      CASE WHEN bal > 4000 THEN {_HEAD} ELSE '' END || CASE WHEN bal > 4000 AND segment <> 'BUILDING' THEN {NL} ELSE '' END
        || CASE WHEN segment <> 'BUILDING' THEN {_FOOT} ELSE '' END AS margin,
      CAST(CASE WHEN segment = 'MACHINERY' THEN CASE WHEN bal > 5000 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS images FROM {STATS}) x""")
def _(spark, d):
    docs = mk.package_documents(_parts(spark, d))
    return docs.select("doc_id", "text", "header_footer_text", F.col("layout.images").cast("bigint").alias("images"), "error_code")


# ---- page runs ------------------------------------------------------------------------------
_DATE_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({x})), '[\\s/.,–—-]+'), lambda t: t <> '')"
_DATE_LIKE = lambda x: (
    f"(length({x}) <= 40 AND len({_DATE_TOKENS.format(x=x)}) > 0 AND len(list_filter({_DATE_TOKENS.format(x=x)}, lambda t: NOT (regexp_full_match(t, '\\d{{1,4}}') "
    f"OR t IN {S.in_list(fv.ONGOING_WORDS)} OR (length(t) <= 9 AND regexp_matches(t, '^({'|'.join(fv.MONTH_PREFIXES)})'))))) = 0)"
)
_TALL = "(CASE WHEN {0}.height = 0 THEN 10.0 ELSE {0}.height END)"
_RUN_CTES = [
    ("runs", fx.SYNTH_RUNS),
    ("paged", """SELECT doc_id, page_no, list({'str': str, 'x': x, 'y': y, 'width': width, 'height': height, 'run_no': run_no} ORDER BY y DESC, x, run_no) AS rs
        FROM runs GROUP BY doc_id, page_no"""),
    ("numbered", f"""SELECT doc_id, page_no, unnest(rs) AS r, unnest(list_reduce(rs, lambda a, r: CASE
          WHEN a.n >= 0 AND abs(a.y - r.y) <= greatest(2.0, 0.5 * greatest({_TALL.format('r')}, {_TALL.format('a')})) THEN {{'n': a.n, 'y': a.y, 'height': a.height, 'rows': list_append(a.rows, a.n)}}
          ELSE {{'n': a.n + 1, 'y': r.y, 'height': r.height, 'rows': list_append(a.rows, a.n + 1)}} END,
        {{'n': -1, 'y': CAST(0 AS DOUBLE), 'height': CAST(0 AS DOUBLE), 'rows': []::INTEGER[]}}).rows) AS row_no FROM paged"""),
    ("kept", """SELECT *, MIN(x) OVER r AS x0, MAX(x + width) OVER r AS x1 FROM (SELECT doc_id, page_no, row_no, r.str AS str, r.x AS x, r.y AS y, r.width AS width, r.run_no AS run_no FROM numbered) f
        WINDOW r AS (PARTITION BY doc_id, page_no, row_no)"""),
    ("seen", """SELECT *, COALESCE(LAG(str) OVER w = str AND x - LAG(x) OVER w < 2, false) AS again FROM kept
        WINDOW w AS (PARTITION BY doc_id, page_no, row_no ORDER BY x, y DESC, run_no)"""),
    ("gaps", """SELECT *, x - (LAG(x) OVER w + LAG(width) OVER w) AS gap, LAG(width) OVER w / LAG(length(str)) OVER w AS cw
        FROM seen WHERE NOT again WINDOW w AS (PARTITION BY doc_id, page_no, row_no ORDER BY x, y DESC, run_no)"""),
    ("segs", """SELECT *, SUM(CASE WHEN gap > 36 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x, y DESC, run_no) AS seg,
        CASE WHEN gap <= 36 AND gap > cw * 0.2 THEN ' ' ELSE '' END || str AS piece FROM gaps"""),
    ("segtext", """SELECT doc_id, page_no, row_no, seg, trim(string_agg(piece, '' ORDER BY x, y DESC, run_no)) AS t, MIN(x0) AS x0, MAX(x1) AS x1 FROM segs GROUP BY ALL"""),
    ("plines", f"""SELECT doc_id, page_no, row_no, string_agg(t, {TAB} ORDER BY seg) AS line, COUNT(*) >= 2
          AND len(string_split(arg_min(t, seg), ' ')) >= 3 AND len(string_split(arg_max(t, seg), ' ')) >= 3 AND NOT {_DATE_LIKE('arg_max(t, seg)')} AS split_line,
        MIN(x0) > 240 AND NOT abs((MIN(x0) + MAX(x1)) / 2 - 300) < 48 AS right_start FROM segtext GROUP BY doc_id, page_no, row_no"""),
    ("pcols", """SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE split_line) AS split_lines, COUNT(*) FILTER (WHERE right_start) AS right_lines
        FROM plines GROUP BY doc_id"""),
]


def runs_sql(final: str) -> str:
    return S.query(_RUN_CTES, final)


def _runs(spark, d):
    return fx.spark_view(spark, d, "synth_runs")


@query("page_lines", runs_sql("SELECT doc_id, CAST(page_no AS BIGINT) AS page_no, CAST(row_no AS BIGINT) AS row_no, line, split_line, right_start FROM plines"))
def _(spark, d):
    return pr.page_lines(_runs(spark, d)).select("doc_id", *big("page_no", "row_no"), "line", "split_line", "right_start")


@query("multi_column", runs_sql("""SELECT *, n_lines >= 8 AND ((split_lines >= 5 AND split_lines / CAST(n_lines AS DOUBLE) >= 0.25)
    OR (right_lines >= 5 AND right_lines / CAST(n_lines AS DOUBLE) >= 0.25)) AS columns FROM pcols"""))
def _(spark, d):
    return pr.multi_column(pr.page_lines(_runs(spark, d)))


@query("run_documents", runs_sql(f"""SELECT p.doc_id, string_agg(t, {NL} || {NL} ORDER BY page_no) AS text, any_value(m.n) AS page_count, any_value(m.n) > 10 AS truncated
    FROM (SELECT doc_id, page_no, string_agg(line, {NL} ORDER BY row_no) AS t FROM plines GROUP BY doc_id, page_no) p
    JOIN (SELECT doc_id, CAST(MAX(page_no) AS BIGINT) AS n FROM runs GROUP BY doc_id) m ON m.doc_id = p.doc_id GROUP BY p.doc_id""").replace(f"{NL} || {NL} ORDER", "E'\\n\\n' ORDER").replace(f"{NL} ORDER BY row_no", "E'\\n' ORDER BY row_no"))
def _(spark, d):
    docs = pr.run_documents(_runs(spark, d))
    return docs.select("doc_id", "text", F.col("layout.page_count").cast("bigint").alias("page_count"), "truncated")


@query("date_like", S.query([], f"SELECT o_orderkey, v, {_DATE_LIKE('v')} AS date_like FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('Mar ', YEAR(o_orderdate), ' – Present') WHEN 1 THEN o_orderpriority WHEN 2 THEN concat('março de ', YEAR(o_orderdate)) WHEN 3 THEN concat('03/', YEAR(o_orderdate), ' - hoje') ELSE ' - ' END AS v FROM orders) x"))
def _(spark, d):
    orders = fx.spark_view(spark, d, "orders")
    v = F.expr("CASE o_orderkey % 5 WHEN 0 THEN concat('Mar ', year(o_orderdate), ' – Present') WHEN 1 THEN o_orderpriority WHEN 2 THEN concat('março de ', year(o_orderdate)) WHEN 3 THEN concat('03/', year(o_orderdate), ' - hoje') ELSE ' - ' END")
    return orders.select("o_orderkey", v.alias("v")).select("*", dt.is_date_like(F.col("v")).alias("date_like"))


# ---- months ---------------------------------------------------------------------------------
_SPELLED = """CASE o_orderkey % 9 WHEN 0 THEN concat(y, '-', lpad(m, 2, '0')) WHEN 1 THEN concat(y, '-', m, '-15') WHEN 2 THEN concat(m, '/', y)
    WHEN 3 THEN concat(m, ' . ', y) WHEN 4 THEN concat('Março de ', y) WHEN 5 THEN concat('sept. ', y) WHEN 6 THEN y WHEN 7 THEN concat('foo ', y) ELSE concat('13/', y) END"""
_YM = "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS STRING) AS y, CAST(MONTH(o_orderdate) AS STRING) AS m FROM orders"


@query("normalize_month", f"""SELECT o_orderkey, {_SPELLED} AS raw, CASE WHEN o_orderkey % 9 <= 3 THEN y || '-' || lpad(m, 2, '0') WHEN o_orderkey % 9 = 4 THEN y || '-03'
    WHEN o_orderkey % 9 = 5 THEN y || '-09' WHEN o_orderkey % 9 = 6 THEN y ELSE '' END AS month FROM ({_YM}) x""")
def _(spark, d):
    fx.spark_view(spark, d, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(f"SELECT o_orderkey, {_SPELLED} AS raw FROM ({_YM}) x")
    return rows.select("o_orderkey", "raw", dt.normalize_month(F.col("raw")).alias("month"))


_EN_NAME = "list_extract(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], CAST(m AS INTEGER))"


@query("format_range", f"""SELECT o_orderkey, a || ' – ' || CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN pt THEN 'Atual' ELSE 'Present' END ELSE y END AS shown
    FROM (SELECT *, o_orderkey % 2 = 0 AS pt, CASE WHEN o_orderkey % 2 = 0 THEN lpad(m, 2, '0') || '/' || y ELSE {_EN_NAME} || ' ' || y END AS a FROM ({_YM}) x) z""")
def _(spark, d):
    fx.spark_view(spark, d, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(f"SELECT o_orderkey, concat(m, '/', y) AS a, y AS b, o_orderkey % 3 = 0 AS open, CASE WHEN o_orderkey % 2 = 0 THEN 'pt' ELSE 'en' END AS lang FROM ({_YM}) x")
    return rows.select("o_orderkey", dt.format_range(F.col("a"), F.col("b"), F.col("open"), F.col("lang")).alias("shown"))


# ---- structured records ---------------------------------------------------------------------
_REC = f"""SELECT k AS doc_id, CASE WHEN k % 25 = 0 THEN 'invalid_json' WHEN k % 26 = 0 OR k % 27 = 0 THEN 'invalid_schema' WHEN k % 2 = 0 THEN NULL
    WHEN k % 35 = 0 OR k % 31 = 0 OR k % 33 = 0 OR k % 37 = 0 THEN
      CASE WHEN k % 35 = 0 THEN 'community' ELSE 'invalid_schema' END END AS state, k, name, segment, n, y0, y1 FROM {STATS}"""
_RECS = f"SELECT *, state IS NULL AND k % 2 = 0 AS loose, COALESCE(state = 'community', false) AS mixed, state IS NULL AND k % 2 = 1 AS strict FROM ({_REC}) x"
_IMPORT = f"""SELECT doc_id, CASE WHEN NOT mixed THEN state END AS error_code,
    CASE WHEN loose THEN name WHEN strict OR mixed THEN repeat(name, CAST(1 + k % 11 AS INT)) END AS name,
    CASE WHEN loose THEN CASE WHEN k % 8 = 0 THEN '42' ELSE 'Analyst' END WHEN strict OR mixed THEN '' END AS label,
    CASE WHEN loose THEN 'Lisbon, PT' WHEN strict THEN 'Recife' WHEN mixed THEN '' END AS location,
    CASE WHEN loose OR strict OR mixed THEN y0 || '-03' END AS start_month,
    CASE WHEN loose THEN CASE WHEN k % 4 = 0 THEN '' ELSE CAST(y1 AS VARCHAR) END WHEN strict OR mixed THEN '' END AS end_month,
    CASE WHEN loose THEN k % 4 = 0 WHEN strict THEN true WHEN mixed THEN false END AS is_current,
    CASE WHEN loose THEN CASE WHEN k % 6 = 0 THEN 'Ran the shop' ELSE 'Led ' || k || ' people/7/Cut cost' END WHEN strict OR mixed THEN 'Built things/' END AS highlights,
    CASE WHEN loose THEN 'Python/42/SQL' WHEN strict OR mixed THEN 'Go/Rust' END AS keywords FROM ({_RECS}) r"""
_HEADS = {s: f"chr(10) || chr(10) || CASE WHEN pt THEN {S.q(fv.SECTION_LABELS['pt'][s])} ELSE {S.q(fv.SECTION_LABELS['en'][s])} END || chr(10) || " for s in fv.SECTIONS}
_MARCH = "CASE WHEN pt THEN '03/' || y0 ELSE 'Mar ' || y0 END"
_RENDER = f"""SELECT doc_id, true AS has_content, CASE WHEN loose THEN name || chr(10) || CASE WHEN k % 8 = 0 THEN '42' ELSE 'Analyst' END || chr(10)
      || 'p' || k || '@example.com | Lisbon, PT | example.com/' || k || ' | github.com/p' || k
      || {_HEADS['summary']} trim(repeat('Data work. ', CAST(1 + k % 3 AS INT)))
      || {_HEADS['experience']} 'Analyst — ' || segment || chr(10) || {_MARCH} || ' – ' || CASE WHEN k % 4 <> 0 THEN CAST(y1 AS VARCHAR) WHEN pt THEN 'Atual' ELSE 'Present' END
      || chr(10) || CASE WHEN k % 6 = 0 THEN '• Ran the shop' ELSE '• Led ' || k || ' people' || chr(10) || '• 7' || chr(10) || '• Cut cost' END
      || {_HEADS['education']} 'BSc, Statistics' || chr(10) || 'State University | 1991 – ' || CASE WHEN pt THEN '12/1995' ELSE 'Dec 1995' END
      || {_HEADS['skills']} 'Data: Python, 42, SQL' || {_HEADS['certifications']} 'Cert | Org | ' || CASE WHEN pt THEN '03/2020' ELSE 'Mar 2020' END
      || {_HEADS['languages']} 'English — Fluent'
    ELSE repeat(name, CAST(1 + k % 11 AS INT)) || chr(10) || 'p' || k || '@example.com | +55 11 4002-8922' || CASE WHEN strict THEN ' | Recife' ELSE '' END || ' | example.com/a'
      || {_HEADS['experience']} 'Lead — ' || segment || chr(10) || 'Recife | ' || {_MARCH} || CASE WHEN mixed THEN '' WHEN pt THEN ' – Atual' ELSE ' – Present' END || chr(10) || '• Built things'
      || {_HEADS['skills']} 'Go, Rust' || {_HEADS['projects']} 'Tool | tool.example.com/x' || chr(10) || 'A tool' || chr(10) || '• Used by ' || n || ' teams'
      || {_HEADS['languages']} CASE WHEN k % 37 = 0 THEN repeat('English — Good' || chr(10), 10) || 'German' ELSE 'English — Good' || chr(10) || 'German' END END AS text
    FROM (SELECT *, k % 3 = 0 AS pt FROM ({_RECS}) r) z WHERE loose OR strict OR mixed"""


def _imported(spark, d):
    return rs.import_resumes(fx.spark_view(spark, d, "synth_json"))


def _flat(df):
    r = F.col("resume")
    job = F.get(r["work"], F.lit(0))
    return df.select(
        "doc_id", "error_code", r["basics"]["name"].alias("name"), r["basics"]["label"].alias("label"), r["basics"]["location"].alias("location"),
        job["startDate"].alias("start_month"), job["endDate"].alias("end_month"), job["current"].alias("is_current"),
        F.array_join(job["highlights"], "/").alias("highlights"), F.array_join(F.get(r["skills"], F.lit(0))["keywords"], "/").alias("keywords"),
    )


@query("resume_import", _IMPORT)
def _(spark, d):
    return _flat(_imported(spark, d))


_LOOSE_JSON = """to_json({'version': 1, 'meta': {'language': lg, 'template': 'classic'},
    'basics': {'name': name, 'label': CASE WHEN k % 8 = 0 THEN '42' ELSE 'Analyst' END, 'email': 'p' || k || '@example.com', 'phone': '', 'location': 'Lisbon, PT',
      'url': 'https://example.com/' || k, 'summary': trim(repeat('Data work. ', CAST(1 + k % 3 AS INT))),
      'profiles': [{'network': 'GitHub', 'url': 'github.com/p' || k}, {'network': 'Bad', 'url': 'javascript:alert(1)'}]},
    'work': [{'company': segment, 'position': 'Analyst', 'location': '', 'startDate': y0 || '-03', 'endDate': CASE WHEN k % 4 = 0 THEN '' ELSE CAST(y1 AS VARCHAR) END,
      'current': k % 4 = 0, 'highlights': CASE WHEN k % 6 = 0 THEN ['Ran the shop'] ELSE ['Led ' || k || ' people', '7', 'Cut cost'] END}],
    'education': [{'institution': 'State University', 'area': 'Statistics', 'studyType': 'BSc', 'startDate': '1991', 'endDate': '1995-12'}],
    'skills': [{'name': 'Data', 'keywords': ['Python', '42', 'SQL']}, {'name': '', 'keywords': []}], 'projects': [],
    'certificates': [{'name': 'Cert', 'issuer': 'Org', 'date': '2020-03', 'url': ''}], 'languages': [{'language': 'English', 'fluency': 'Fluent'}]})"""
_STRICT_JSON = """to_json({'version': 1, 'meta': {'language': lg, 'template': CASE WHEN mixed THEN 'classic' ELSE 'modern' END},
    'basics': {'name': repeat(name, CAST(1 + k % 11 AS INT)), 'label': '', 'email': 'p' || k || '@example.com', 'phone': '+55 11 4002-8922',
      'location': CASE WHEN mixed THEN '' ELSE 'Recife' END, 'url': 'EXAMPLE.com/a/', 'summary': '', 'profiles': []},
    'work': [{'company': segment, 'position': 'Lead', 'location': 'Recife', 'startDate': y0 || '-03', 'endDate': '', 'current': NOT mixed, 'highlights': ['Built things', '']}],
    'education': [], 'skills': [{'name': '', 'keywords': ['Go', 'Rust']}],
    'projects': [{'name': 'Tool', 'description': 'A tool', 'url': 'http://tool.example.com/x/', 'highlights': ['Used by ' || n || ' teams']}], 'certificates': [],
    'languages': list_concat(list_transform(range(CASE WHEN k % 37 = 0 THEN 10 ELSE 1 END), lambda i: {'language': 'English', 'fluency': 'Good'}), [{'language': 'German', 'fluency': ''}])})"""


@query("resume_export", f"""SELECT doc_id, CAST(CASE WHEN loose THEN {_LOOSE_JSON} WHEN strict OR mixed THEN {_STRICT_JSON} END AS VARCHAR) AS json
    FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 'pt' ELSE 'en' END AS lg FROM ({_RECS}) r) z""")
def _(spark, d):
    return _imported(spark, d).select("doc_id", rs.export_json(F.col("resume")).alias("json"))


@query("resume_set_aside", f"SELECT r.doc_id, CASE WHEN strict THEN 'ok' ELSE 'unreadable' END AS status, CASE WHEN NOT strict THEN length(j.raw) END AS kept FROM ({_RECS}) r JOIN ({fx.SYNTH_JSON}) j ON j.doc_id = r.doc_id")
def _(spark, d):
    kept = rs.set_aside(fx.spark_view(spark, d, "synth_json"))
    return kept.select("doc_id", "status", F.length("backup").cast("bigint").alias("kept"))


@query("resume_render", _RENDER)
def _(spark, d):
    return rs.render_resumes(rs.valid_resumes(_imported(spark, d))).select("doc_id", rs.has_content(F.col("resume")).alias("has_content"), "text")


# ---- messages and reports -------------------------------------------------------------------
def _case(kind: str, locale: str, x: str) -> str:
    return f"(CASE {' '.join(f'WHEN {x} = {S.q(k)} THEN {S.q(v)}' for k, v in LABELS[locale][kind].items())} ELSE {x} END)"


def _message_ctes(locale: str, source: str) -> list[tuple[str, str]]:
    key, val = "split_part(p, '=', 1)", "substr(p, strpos(p, '=') + 1)"
    each = lambda kind: f"array_to_string(list_transform(string_split({val}, ','), lambda x: {_case(kind, locale, 'x')}), ', ')"
    shown = (
        f"CASE WHEN {key} = 'sections' THEN {each('sections')} WHEN {key} = 'items' THEN {each('personal')} WHEN {key} IN ('section', 'suggestion') THEN "
        f"{_case('sections', locale, val)} WHEN {key} IN ('resume', 'job') THEN {_case('languages', locale, val)} ELSE {val} END"
    )
    return [
        ("msg", S.values(list(MESSAGES[locale].items()), "id, template")),
        ("told", f"""SELECT f.*, list_reduce(list_concat([template], CASE WHEN params = '' THEN [] ELSE string_split(params, ';') END),
            lambda acc, p: replace(acc, '{{' || {key} || '}}', {shown})) AS message FROM {source} f JOIN msg ON msg.id = f.id"""),
    ]


for _locale in ("en", "pt"):
    def _messages(spark, d, locale=_locale):
        found = _scored(spark, d).select("doc_id", F.inline_outer("findings"))
        return rp.rendered_findings(found, locale).select("doc_id", *big("ord", "sub"), "message")

    query(f"render_messages_{_locale}", S.query(S.RES + _message_ctes(_locale, "docfind"), "SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(sub AS BIGINT) AS sub, message FROM told"))(_messages)

    def _reports(spark, d, locale=_locale):
        return rp.written_reports(analysis(spark, d, shape=rp.finding_line(locale)).results, locale)

    _r = LABELS[_locale]["report"]
    _cats = " || ".join(
        f"CASE WHEN {c}_score IS NULL THEN '' ELSE '- {LABELS[_locale]['categories'][c]}: ' || {c}_score || '/100 ({_r['weight']} ' || "
        + ("CASE WHEN NOT ready THEN '100' " if c == "parseability" else "CASE ")
        + f"WHEN keywords_score IS NULL THEN '{round(fv.WEIGHTS_WITHOUT_JOB[c] * 100)}' ELSE '{round(fv.WEIGHTS_WITH_JOB[c] * 100)}' END || '%)' || chr(10) END"
        for c in fv.CATEGORIES
    )
    _head, _tail = _r["passed"].split("{count}")
    _final = f"""SELECT t.doc_id, t.job_id, '# {_r['title']}: ' || score || '/100 (' || {_case('bands', _locale, "CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END")} || ')' || chr(10) || chr(10)
        || {_case('languages', _locale, 'lang')} || ' · ' || words || ' {_r['words']} · {_r['note']}' || chr(10) || chr(10) || {_cats}
        || CASE WHEN m.n_issues > 0 THEN chr(10) || '## {_r['issues']}' || chr(10) || chr(10) || m.issues || chr(10) ELSE '' END
        || CASE WHEN m.n_passed > 0 THEN chr(10) || '## {_head}' || m.n_passed || '{_tail}' || chr(10) || chr(10) || m.passes || chr(10) ELSE '' END
        || CASE WHEN keywords_score IS NOT NULL THEN chr(10) || '## {_r['keywords']}' || chr(10) || chr(10) || '- {_r['missing']} (' || n_missing || '): ' || COALESCE(missing, '–')
             || chr(10) || '- {_r['matched']} (' || n_matched || '): ' || COALESCE(matched, '–') || chr(10) ELSE '' END AS markdown
        FROM (SELECT *, keyword_score AS keywords_score FROM totals) t JOIN packed m ON m.doc_id = t.doc_id AND m.job_id IS NOT DISTINCT FROM t.job_id"""
    _packed = [("packed", f"""SELECT doc_id, job_id, COUNT(*) FILTER (WHERE severity <> 'pass') AS n_issues, COUNT(*) FILTER (WHERE severity = 'pass') AS n_passed,
        string_agg('- [' || {_case('severity', _locale, 'severity')} || '] ' || message, E'\\n' ORDER BY {S.SEV}, ord, sub) FILTER (WHERE severity <> 'pass') AS issues,
        string_agg('- [' || {_case('severity', _locale, 'severity')} || '] ' || message, E'\\n' ORDER BY {S.SEV}, ord, sub) FILTER (WHERE severity = 'pass') AS passes
        FROM told GROUP BY doc_id, job_id""")]
    query(f"markdown_report_{_locale}", S.query(S.ALL + _message_ctes(_locale, "allfind") + _packed, _final))(_reports)


# ---- corpus ---------------------------------------------------------------------------------
@query("rank_candidates", pair("""SELECT job_id, doc_id, CAST(score AS BIGINT) AS score, rank FROM (SELECT job_id, doc_id, score,
    ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY score DESC, doc_id) AS rank FROM totals WHERE job_id IS NOT NULL) x WHERE rank <= 10"""))
def _(spark, d):
    return cp.rank_candidates(analysis(spark, d).results).select("job_id", "doc_id", *big("score", "rank"))


_CATEGORY_ROWS = " UNION ALL ".join(
    f"SELECT lang, score, '{c}' AS category, {col} AS points FROM totals" for c, col in [*((c, "keyword_score" if c == "keywords" else f"{c}_score") for c in fv.CATEGORIES), ("total", "score")]
)


@query("scorecard_rollup", pair(f"""SELECT lang, band, category, COUNT(points) AS n, round(AVG(points), 6) AS mean_score, CAST(GROUPING(lang, band, category) AS BIGINT) AS level
    FROM (SELECT lang, category, points, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS band FROM ({_CATEGORY_ROWS}) c) x
    GROUP BY GROUPING SETS ((lang, band, category), (lang, category), (band, category), (category))"""))
def _(spark, d):
    return cp.scorecard(analysis(spark, d).results)


@query("finding_prevalence", pair("""SELECT id, severity, COUNT(DISTINCT doc_id) AS documents,
    round(COUNT(DISTINCT doc_id) / CAST((SELECT COUNT(DISTINCT doc_id) FROM allfind) AS DOUBLE), 6) AS share FROM allfind GROUP BY id, severity"""))
def _(spark, d):
    kind = lambda f: F.struct(f["id"].alias("id"), f["severity"].alias("severity"))
    return cp.prevalence_of_results(analysis(spark, d, shape=kind, parameters=False).results)


@query("skill_gap", pair("""SELECT job_id, kind, term, COUNT(*) AS documents, COUNT(*) FILTER (WHERE NOT matched) AS lacking,
    round(COUNT(*) FILTER (WHERE NOT matched) / CAST(COUNT(*) AS DOUBLE), 6) AS share FROM hits GROUP BY job_id, kind, term"""))
def _(spark, d):
    return cp.skill_gap_of_matches(_matches(spark, d), table_cut(spark)(kw.job_keywords(jobs(spark, d)), "job_keywords"))


# packages, page runs and text files, assembled into one table of documents
_PACKAGES = f"""SELECT k AS doc_id, CASE WHEN bal < 9500 THEN {_BODY_TEXT} ELSE 'second body' || {NL} END AS text,
    CASE WHEN bal > 4000 THEN {_HEAD} ELSE '' END || CASE WHEN bal > 4000 AND segment <> 'BUILDING' THEN {NL} ELSE '' END || CASE WHEN segment <> 'BUILDING' THEN {_FOOT} ELSE '' END AS margin,
    CAST(bal < 9500 AND k % 3 = 0 AS INTEGER) AS l_tables, CAST(bal < 9500 AND k % 4 = 0 AS INTEGER) AS l_boxes,
    CAST(CASE WHEN segment = 'MACHINERY' THEN CASE WHEN bal > 5000 THEN 2 ELSE 1 END ELSE 0 END AS INTEGER) AS l_images, bal < 9500 AND k % 5 = 0 AS l_columns
    FROM {STATS} WHERE bal > -800 AND (bal < 9500 OR bal > 9000)"""
_ASSEMBLED = [
    *_RUN_CTES,
    ("packages", _PACKAGES),
    ("pagetext", "SELECT doc_id, page_no, string_agg(line, E'\\n' ORDER BY row_no) AS t FROM plines GROUP BY doc_id, page_no"),
    ("runtext", "SELECT doc_id, string_agg(t, E'\\n\\n' ORDER BY page_no) AS text FROM pagetext GROUP BY doc_id"),
    ("runpages", "SELECT doc_id, CAST(MAX(page_no) AS INTEGER) AS n FROM runs GROUP BY doc_id"),
    ("assembled", f"""SELECT doc_id, text, margin AS header_footer_text, l_tables, l_boxes, l_images, l_columns, CAST(NULL AS INTEGER) AS l_pages, false AS truncated FROM packages
        UNION ALL SELECT p.doc_id + 10000000, text, '', 0, 0, 0, n_lines >= 8 AND ((split_lines >= 5 AND split_lines / CAST(n_lines AS DOUBLE) >= 0.25)
          OR (right_lines >= 5 AND right_lines / CAST(n_lines AS DOUBLE) >= 0.25)), n, n > 10 FROM runpages p JOIN runtext USING (doc_id) JOIN pcols USING (doc_id)
        UNION ALL SELECT {S.PLAIN.format(id='doc_id + 20000000', text='text')} FROM documents WHERE doc_id % 5 <> 4"""),
    *S.analysis_ctes("SELECT * FROM assembled"),
]


@query("page_documents_score", S.query(_ASSEMBLED, """SELECT b.doc_id, CAST(any_value(base_score) AS BIGINT) AS score, CAST(any_value(parseability_score) AS BIGINT) AS parseability_score,
    CAST(any_value(words) AS BIGINT) AS words, COUNT(*) FILTER (WHERE severity <> 'pass') AS issues FROM based b JOIN docfind f ON f.doc_id = b.doc_id GROUP BY b.doc_id"""))
def _(spark, d):
    """Package, page-run and text-file documents assembled into one table and scored."""
    from doclint.plans.analyze import analyze

    packages = mk.package_documents(_parts(spark, d))
    pages = pr.run_documents(_runs(spark, d)).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    texts = _decoded(spark, d).withColumn("doc_id", F.col("doc_id") + 20_000_000)
    results = analyze(fl.assemble(packages, pages, texts)).results
    return results.select("doc_id", *big("score", "parseability_score", "words"), F.size(sc.issues(F.col("findings"))).cast("bigint").alias("issues"))
