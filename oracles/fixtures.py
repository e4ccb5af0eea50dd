"""Views derived from the given tables, written in SQL that Spark and DuckDB both accept.

The given ``documents`` are prose and trigger few résumé rules, so résumés are derived from
customers and their orders, ads from suppliers, and (document, ad) pairs from shared nations.
Every view grows with its tables.  ``~`` stands for a line feed inside the recipes.
"""

from __future__ import annotations

import re

from doclint.sources.files import spread, tasks

PUA = "\ue001\ue002\ue003"

# one row per customer with order statistics
CUSTOMER_STATS = """
SELECT c.c_custkey AS k, c.c_name AS name, c.c_nationkey AS nationkey, c.c_mktsegment AS segment, c.c_acctbal AS bal,
       CAST(COALESCE(o.n, 0) AS INT) AS n, CAST(COALESCE(o.y0, 1995) AS INT) AS y0, CAST(COALESCE(o.y1, 1995) AS INT) AS y1
FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(o_orderkey) AS n, MIN(YEAR(o_orderdate)) AS y0, MAX(YEAR(o_orderdate)) AS y1
                           FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

_S = "CAST({} AS STRING)"
K = _S.format("k")


def _case(modulus: int, arms: dict[int, str], default: str, key: str = "k") -> str:
    body = " ".join(f"WHEN {i} THEN {v}" for i, v in arms.items())
    return f"CASE {key} % {modulus} {body} ELSE {default} END"


_EN = "k % 3 <> 0"
_BULLET_A = (
    "CASE k % 6 WHEN 1 THEN '• Led migration of 12 systems in the region, cutting cost by 30%~'"
    " WHEN 2 THEN '- Action: built pipelines with Kafka and Spark, for $ 200 of savings~'"
    " WHEN 4 THEN '• Co-founded a guild of 45 people that met in 2019~'"
    " WHEN 5 THEN '* Improved the response time 3x for the users~'"
    " WHEN 0 THEN '• Desenvolvi relatórios para 15 áreas, com redução de 20%~'"
    " ELSE '– Resultado: reduzi custos de R$ 300 na operação~' END"
)
_BULLET_B = (
    "CASE k % 6 WHEN 1 THEN '• Developed reports for the sales team~'"
    " WHEN 2 THEN '• Led the design of the new storage~'"
    " WHEN 4 THEN '• Assisted with documentation in 2021 for the office~'"
    " WHEN 5 THEN '► Managed releases~'"
    " WHEN 0 THEN '• Participei de projetos da empresa em 2018~'"
    " ELSE '• Liderei a equipe de dados do escritório~' END"
)
_RESUME = f"""concat(
 CASE WHEN k % 29 = 0 THEN 'Only eight words are in this short text' ELSE concat(
 name, '~',
 CASE WHEN k % 7 <> 0 THEN concat('<person', {K}, '@example.com>') ELSE 'write to me' END, ' | ',
 CASE WHEN k % 5 <> 0 THEN concat('+55 11 9', lpad({K}, 8, '4')) WHEN k % 2 = 0 THEN '2001-2005 12345-678' ELSE '123.456.789-09' END, ' | ',
 CASE k % 4 WHEN 0 THEN concat('https://www.linkedin.com/in/person', {K}) WHEN 1 THEN 'LinkedIn'
            WHEN 2 THEN concat('linkedin.com/in/person', {K}, '-~doe') ELSE 'Lisbon' END, '~',
 CASE k % 19 WHEN 0 THEN 'CPF: 123.456.789-09~' WHEN 1 THEN 'Date of birth: 01/02/1980~'
             WHEN 2 THEN 'Brasileiro | 27 anos | Solteiro~' WHEN 3 THEN 'RG: 12.345.678 – Idade: 41~' ELSE '' END,
 CASE WHEN k % 6 = 0 THEN '' WHEN k % 11 = 0 THEN (CASE WHEN {_EN} THEN '~~~~About me~' ELSE 'Sobre mim~' END)
      WHEN {_EN} THEN '~~~~Summary~' ELSE 'RESUMO:~' END,
 CASE WHEN {_EN} THEN 'Data professional with a focus on the quality of the work and on the people who use it.'
      ELSE 'Profissional de dados com foco na qualidade do trabalho e nas pessoas que o usam, em São Paulo.' END,
 CASE WHEN k % 5 = 1 THEN ' I like my work, it makes me grow and I do it myself.' ELSE '' END,
 repeat(CASE WHEN {_EN} THEN ' Responsible for reports.' ELSE ' Responsável por relatórios.' END, CAST(k % 4 AS INT)), '~',
 CASE WHEN k % 13 = 0 THEN 'Jobs of the past years~'
      WHEN k % 9 = 0 THEN (CASE WHEN {_EN} THEN 'l EXPERIENCE~' ELSE 'Ô EXPERIÊNCIA~' END)
      WHEN {_EN} THEN 'Work   Experience~' ELSE '2. Experiência Profissional~' END,
 CASE WHEN k % 8 <> 0 THEN concat('Analyst, {{seg}} – ', CAST(y0 AS STRING), CASE WHEN k % 2 = 0 THEN ' – ' ELSE ' to ' END,
      CASE WHEN y1 > 2000 THEN 'present' ELSE CAST(y1 AS STRING) END, '~') ELSE 'Several companies~' END,
 repeat(concat({_BULLET_A}, {_BULLET_B}), CAST(floor(n / 2.0) AS INT)), CASE WHEN n % 2 = 1 THEN {_BULLET_A} ELSE '' END,
 CASE WHEN k % 17 = 0 THEN concat('• ', repeat('word and ', 20), 'more~') ELSE '' END,
 CASE WHEN k % 15 = 0 THEN 'Languages: ~' WHEN k % 2 = 0 THEN (CASE WHEN {_EN} THEN 'Languages: English~' ELSE 'Idiomas: Inglês~' END) ELSE '' END,
 CASE WHEN k % 14 = 3 THEN 'Projects & Certifications~• Built 3 tools with React and Docker Compose in 2020~- Led a study of 2 weeks~' ELSE '' END,
 CASE WHEN k % 10 = 0 THEN (CASE WHEN {_EN} THEN 'Education~' ELSE 'Formação Acadêmica~' END)
      ELSE (CASE WHEN {_EN} THEN 'EDUCATION~State University, 1999~' ELSE 'Formação Acadêmica~Universidade Estadual, 1999~' END) END,
 CASE WHEN k % 33 = 0 THEN 'Toolbox~' WHEN {_EN} THEN 'Skills~' ELSE 'Habilidades:~' END,
 {_case(12, {
     0: "'Python, React Native, SQL Server, Go, Docker'", 1: "'React, SQL, Spark, Kafka; Excel'",
     2: "'Java, Spring Boot, Docker Compose, REST'", 3: "'C/C++, Linux, Git and CI/CD'",
     4: "'Node.js, .NET, C#, Azure'", 5: "'Machine Learning, Pandas, Airflow'",
     6: "'Rust, C, Go'", 7: "'Power BI, Excel, SQL Server and Tableau'",
     8: "'GitHub Actions, GitHub, Kubernetes'", 9: "'Scrum, Jira, Leadership, teamwork'",
     10: "'Spring, Helm charts, SOLID principles'", 11: "'front-end and back end work, TypeScript'"}, "''")}, '~',
 CASE WHEN k % 37 = 0 THEN repeat('Python ', 30) ELSE '' END,
 CASE WHEN k % 23 = 0 THEN '~ {PUA} § github (cid:12) ï' ELSE '' END) END)"""

SYNTH_RESUMES = f"""
SELECT k AS doc_id, nationkey, segment,
       replace(replace({_RESUME}, '{{seg}}', lower(segment)), '~', chr(10)) AS text,
       CASE WHEN k % 21 = 0 THEN concat('contact: hf', {K}, '@example.org')
            WHEN k % 15 = 0 THEN 'call (11) 4002-8922 now' ELSE '' END AS header_footer_text,
       CAST(CASE WHEN k % 31 = 0 THEN 1 WHEN k % 31 = 1 THEN 3 ELSE 0 END AS INT) AS l_tables,
       CAST(CASE WHEN k % 41 = 0 THEN 2 ELSE 0 END AS INT) AS l_boxes,
       CAST(CASE WHEN k % 43 = 0 THEN 3 ELSE 0 END AS INT) AS l_images,
       (k % 47 = 0) AS l_columns,
       CAST(CASE WHEN k % 2 = 0 THEN 1 + k % 4 ELSE NULL END AS INT) AS l_pages,
       (k % 59 = 0) AS truncated
FROM ({CUSTOMER_STATS}) s
"""

_J = _S.format("j")
_JOB = f"""CASE WHEN j % 15 = 0 THEN concat('Python developer wanted in ', lower(nation), ' with Go, SQL and Docker') ELSE concat(
 CASE WHEN j % 4 <> 0 THEN concat('We are a company in ', nation, ' and we look for a person who will work with the data platform of the group.~')
      ELSE concat('Somos uma empresa em ', nation, ' e buscamos uma pessoa que vai cuidar da plataforma de dados do grupo, com organização e atenção.~') END,
 CASE WHEN j % 4 <> 0 THEN 'About the role~Own the data platform and the reporting pipelines for retail clients~'
      ELSE 'Sobre a vaga~Cuidar da plataforma de dados e dos relatórios de clientes do varejo~' END,
 CASE WHEN j % 4 <> 0 THEN 'Requirements:~' ELSE 'Requisitos~' END,
 {_case(12, {
     0: "'- Python, Go, SQL Server, Docker, Kafka~'", 1: "'- React Native, React, TypeScript, Jest~'",
     2: "'- Java, Spring, Spring Boot, REST, Docker Compose~'", 3: "'- C, C++, Linux, Git~'",
     4: "'- Node.js, .NET, C#, Azure, REST APIs~'", 5: "'- Machine Learning, Pandas, Airflow, Spark~'",
     6: "'- Rust, Go, Kubernetes, gRPC~'", 7: "'- Power BI, Excel, SQL, Tableau, data analysis~'",
     8: "'- GitHub Actions, Kubernetes, Terraform, AWS~'", 9: "'- Scrum, Jira, leadership, communication~'",
     10: "'- Spring, Helm, SOLID principles, OOP~'", 11: "'- front-end, back end, TypeScript, Vue.js~'"}, "''", "j")},
 '- Retail analytics and retail analytics dashboards, forecasting, budgeting~',
 '- Excel in teamwork. Go beyond reporting pipelines, data data~',
 CASE WHEN j % 4 <> 0 THEN 'Nice to have~' ELSE 'Diferenciais~' END, 'Scala and Kafka, pricing models~',
 CASE WHEN j % 5 = 0 THEN 'Responsibilities~Write pricing models and reports in Python~' ELSE '' END,
 CASE WHEN j % 4 <> 0 THEN 'Benefits~Health insurance and English lessons, Python club~' ELSE 'Benefícios~Plano de saúde e aulas de inglês, clube de Python~' END,
 CASE WHEN j % 7 = 0 THEN 'Qualifications~SAP, logistics planning and forecasting~' ELSE '' END) END"""

SYNTH_JOBS = f"""
SELECT j AS job_id, nationkey, replace({_JOB}, '~', chr(10)) AS text
FROM (SELECT s.s_suppkey AS j, s.s_nationkey AS nationkey, n.n_name AS nation
      FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey) s
"""

# applicants answer the ads of all suppliers of their orders
SYNTH_PAIRS = """
SELECT DISTINCT o.o_custkey AS doc_id, l.l_suppkey AS job_id
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
"""

# ---- structured records -------------------------------------------------------------------
_Q = '"'
SYNTH_JSON = f"""
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'pt' ELSE 'en' END AS lang, CASE
 WHEN k % 25 = 0 THEN concat('{{"basics": ', name)
 WHEN k % 26 = 0 THEN concat('["', name, '"]')
 WHEN k % 27 = 0 THEN concat('{{"name": "', name, '"}}')
 WHEN k % 2 = 0 THEN concat('{{"basics": {{"name": "', name, '", "label": ', CASE WHEN k % 8 = 0 THEN '42' ELSE '"Analyst"' END,
   ', "email": "p', {K}, '@example.com", "website": "https://example.com/', {K}, '", "summary": "', repeat('Data work. ', CAST(1 + k % 3 AS INT)),
   '", "location": {{"city": "Lisbon", "countryCode": "PT"}}, "profiles": [{{"network": "GitHub", "url": "github.com/p', {K}, '"}}, "x", {{"network": "Bad", "url": "javascript:alert(1)"}}]}}, ',
   '"work": [{{"name": "', segment, '", "position": "Analyst", "startDate": "', CAST(y0 AS STRING), '-03-15"',
   CASE WHEN k % 4 = 0 THEN '' ELSE concat(', "endDate": "', CAST(y1 AS STRING), '"') END,
   CASE WHEN k % 6 = 0 THEN ', "summary": "Ran the shop"' ELSE concat(', "highlights": ["Led ', {K}, ' people", 7, null, "Cut cost"]') END, '}}], ',
   '"education": [{{"institution": "State University", "area": "Statistics", "studyType": "BSc", "startDate": "1991", "endDate": "12/1995"}}], ',
   '"skills": [{{"name": "Data", "keywords": ["Python", 42, null, "SQL"]}}, {{"keywords": []}}], ',
   '"certificates": [{{"name": "Cert", "issuer": "Org", "date": "Mar 2020"}}], ',
   '"languages": [{{"language": "English", "fluency": "Fluent"}}]}}')
 ELSE concat('{{"version": ', CASE WHEN k % 35 = 0 THEN '2' ELSE '1' END, ', "extra": 1, "meta": {{"language": "', CASE WHEN k % 3 = 0 THEN 'pt' ELSE 'en' END,
   '", "template": "', CASE WHEN k % 31 = 0 THEN 'fancy' ELSE 'modern' END, '"}}, "basics": {{"name": " ', repeat(name, CAST(1 + (k % 11) AS INT)), '", "label": "", "email": "p', {K},
   '@example.com", "phone": "+55 11 4002-8922", "location": "Recife", "url": "EXAMPLE.com/a/", "summary": "", "profiles": []}}, "work": [',
   '{{"company": "', segment, '", "position": "Lead", "location": "Recife", "startDate": "março de ', CAST(y0 AS STRING), '", "endDate": "nope", "current": ',
   CASE WHEN k % 33 = 0 THEN '"yes"' ELSE 'true' END, ', "highlights": ["Built things", " "]}}], "education": [], "skills": [{{"name": "", "keywords": ["Go", "Rust"]}}], ',
   '"projects": [{{"name": "Tool", "description": "A tool", "url": "http://tool.example.com/x/", "highlights": ["Used by ', CAST(n AS STRING), ' teams"]}}], "certificates": [], "languages": [',
   repeat('{{"language": "English", "fluency": "Good"}}, ', CASE WHEN k % 37 = 0 THEN 10 ELSE 1 END), '{{"language": "German", "fluency": ""}}]',
   CASE WHEN k % 39 = 0 THEN '' ELSE '' END, '}}') END AS raw
FROM ({CUSTOMER_STATS}) s
"""

# ---- word-processor parts -----------------------------------------------------------------
_P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
_BODY = f"""concat('<?xml version="1.0"?><!-- c --><w:document><w:body><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr>',
 '<w:p><w:r><w:t>', name, ' &amp; Co &lt;', {K}, '&gt; &#233;&#x1F600;&#0;&#55296;&nope;</w:t><w:tab/><w:t xml:space="preserve">tab</w:t></w:r></w:p>',
 repeat(concat('<w:p><w:r><w:t>Order line ', segment, '</w:t><w:br/><w:t>next</w:t><w:noBreakHyphen/><w:t>part</w:t></w:r></w:p>'), n),
 CASE WHEN k % 3 = 0 THEN concat('<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell ', {K}, '</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>') ELSE '' END,
 CASE WHEN k % 4 = 0 THEN '<mc:AlternateContent><mc:Choice><w:r><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:r></mc:Choice><mc:Fallback><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></mc:Fallback></mc:AlternateContent>' ELSE '' END,
 CASE WHEN k % 7 = 0 THEN '</w:r></mc:Fallback><w:p><w:r><w:t>late</w:t><w:cr/></w:r></w:p>' ELSE '' END,
 CASE WHEN k % 11 = 0 THEN '<mc:Fallback/><mc:Fallback><mc:Fallback><w:tbl/><w:r><w:t>no</w:t></w:r></mc:Fallback><w:tbl><w:cols w:num="3"/><w:r><w:t>no</w:t></w:r></w:tbl></mc:Fallback></w:r><w:br/><w:p><w:r><w:r/><w:t>deep</w:t></w:r><w:tab/></w:p>' ELSE '' END,
 CASE WHEN k % 5 = 0 THEN '<w:sectPr><w:cols w:space="1" w:num="2"/></w:sectPr>' ELSE '<w:sectPr><w:cols w:num="1"/></w:sectPr>' END,
 '</w:body></w:document>')"""
# one scan: every customer has seven candidate parts, of which some exist
SYNTH_PARTS = f"""
SELECT k AS doc_id, part_no,
       CASE part_no WHEN 0 THEN '[Content_Types].xml' WHEN 1 THEN 'word/document.xml' WHEN 2 THEN 'word/document2.xml' WHEN 3 THEN 'word/header1.xml'
         WHEN 4 THEN 'word/footer1.xml' WHEN 5 THEN 'word/media/image1.png' ELSE 'word/media/image2.png' END AS part_name,
       CASE part_no WHEN 0 THEN '<Types/>' WHEN 1 THEN {_BODY} WHEN 2 THEN '<w:p><w:r><w:t>second body</w:t></w:r></w:p>'
         WHEN 3 THEN concat('<w:hdr><w:p><w:r><w:t>h', {K}, '@example.com</w:t></w:r></w:p></w:hdr>')
         WHEN 4 THEN '<w:ftr><w:p><w:r><w:t>Page </w:t></w:r><w:r><w:t>1</w:t></w:r></w:p></w:ftr>' ELSE '' END AS xml
FROM (SELECT s.*, unnest(range(0, 7)) AS part_no FROM ({CUSTOMER_STATS}) s) p
WHERE CASE part_no WHEN 0 THEN bal > -800 WHEN 1 THEN bal < 9500 WHEN 2 THEN bal < 500 OR bal > 9000 WHEN 3 THEN bal > 4000
        WHEN 4 THEN segment <> 'BUILDING' WHEN 5 THEN segment = 'MACHINERY' ELSE segment = 'MACHINERY' AND bal > 5000 END
"""

# ---- positioned page runs: one "document" per customer, one row of runs per order; the baseline
# ---- of every sixth document drifts down along its rows

SYNTH_RUNS = """
SELECT r.doc_id, r.page_no, 600.0 AS page_width, CAST(r.line_no * 10 + r.run_no AS INT) AS run_no,
       CASE r.run_no
         WHEN 0 THEN concat('Order of ', r.status)
         WHEN 1 THEN CASE WHEN r.doc_id % 3 = 0 THEN 'priority and price list' ELSE concat(r.prio, ' lot') END
         WHEN 2 THEN CASE WHEN r.doc_id % 3 = 1 THEN concat('Jan ', CAST(r.y AS STRING), ' – Present') ELSE 'shipped to the north' END
         WHEN 3 THEN 'st'
         ELSE concat('Order of ', r.status) END AS str,
       CAST(CASE WHEN r.doc_id % 5 = 4 AND r.line_no % 2 = 0 THEN 280.0 ELSE 0.0 END
            + CASE r.run_no WHEN 0 THEN 20.0 WHEN 1 THEN CASE WHEN r.doc_id % 4 = 0 THEN 84.5 ELSE 88.0 END WHEN 2 THEN 400.0 WHEN 3 THEN 520.5 ELSE 20.5 END AS DOUBLE) AS x,
       CAST(700.0 - 20.0 * r.line_no - CASE WHEN r.doc_id % 6 = 5 THEN 4.0 * r.run_no ELSE 0.0 END + CASE WHEN r.run_no = 3 THEN 3.0 WHEN r.run_no = 1 THEN -1.5 ELSE 0.0 END AS DOUBLE) AS y,
       CAST(CASE r.run_no WHEN 0 THEN 64.0 WHEN 1 THEN 120.0 WHEN 2 THEN 120.0 WHEN 3 THEN 8.0 ELSE 64.0 END AS DOUBLE) AS width,
       CAST(CASE WHEN r.run_no = 3 THEN 6.0 WHEN r.doc_id % 7 = 0 THEN 0.0 ELSE 10.0 END AS DOUBLE) AS height
FROM (SELECT b.*, unnest(range(0, 5)) AS run_no FROM (SELECT o_custkey AS doc_id, 1 + CAST(floor((ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 5.0) AS INT) AS page_no,
             CAST((ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 5 AS INT) AS line_no,
             lower(o_orderstatus) AS status, lower(o_orderpriority) AS prio, YEAR(o_orderdate) AS y
      FROM orders) b
) r
WHERE r.run_no IN (0, 1) OR (r.run_no = 2 AND r.line_no % 3 <> 2) OR (r.run_no = 3 AND r.line_no % 4 = 0) OR (r.run_no = 4 AND r.line_no % 2 = 1)
"""

VIEWS = {
    "synth_resumes": SYNTH_RESUMES,
    "synth_jobs": SYNTH_JOBS,
    "synth_pairs": SYNTH_PAIRS,
    "synth_json": SYNTH_JSON,
    "synth_parts": SYNTH_PARTS,
    "synth_runs": SYNTH_RUNS,
}
TABLES = "nation customer supplier orders documents benchmark labels conversations pages".split()


def spark_view(spark, sf_dir: str, name: str):
    """A derived view (or a given table) as a DataFrame."""
    read = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name in TABLES:
        return spread(read(name))
    sql = VIEWS[name]
    for table in ("customer", "orders", "supplier", "nation", "lineitem"):
        if re.search(rf"\b{table}\b", sql):
            # the key's exchange is what the join with the orders needs anyway, in a number of tasks that stays
            given = read(table).repartition(tasks(spark), "c_custkey") if table == "customer" else read(table)
            given.createOrReplaceTempView(table)
    return spark.sql(re.sub(r"unnest\(range\(0, (\d+)\)\)", r"explode(sequence(0, \1 - 1))", sql))


def resume_documents(spark, sf_dir: str):
    """Derived résumés in the input schema of the analysis."""
    from pyspark.sql import functions as F

    r = spark_view(spark, sf_dir, "synth_resumes")
    return r.select(
        "doc_id", "text", "header_footer_text",
        F.struct(
            F.col("l_tables").alias("tables"), F.col("l_boxes").alias("text_boxes"), F.col("l_images").alias("images"),
            F.col("l_columns").alias("columns"), F.col("l_pages").alias("page_count"),
        ).alias("layout"),
        "truncated", "nationkey", "segment",
    )
