"""DuckDB statements that recompute every query from the rules, independently of the Spark code.

They work on exploded lines and tokens with joins and windows, where the Spark side works inside
the document row; the word lists are the only thing both share.
"""

from __future__ import annotations

from doclint.functions import fixed_values as fv
from doclint.functions.lexicon import DEFAULT as LEX
from doclint.functions.lexicon import tokenize_entry

from . import fixtures as fx


def q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else q(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({names})"


def rx(text: str) -> str:
    out = ""
    for ch in text:
        out += "\\" + ch if ch in ".^$|?*+()[]{}\\/#-" else ch
    return out


NL = "chr(10)"
GLYPHS = "[" + rx(fv.BULLET_GLYPHS) + "]"
YEAR = r"(19[5-9]\d|20[0-4]\d)"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def toks(x: str) -> str:
    """Token list of a text expression."""
    f = fold(x)
    for _ in range(2):  # neighbours share their separator, so replace twice
        f = f"regexp_replace({f}, '(^|[^a-z0-9])\\.net([^a-z0-9]|$)', '\\1dotnet\\2', 'g')"
    f = f"regexp_replace({f}, '[''’]s\\b', '', 'g')"
    f = f"regexp_replace({f}, '[-''’]', ' ', 'g')"
    raw = f"regexp_extract_all({f}, '[a-z0-9][a-z0-9+#./]*[a-z0-9+#]|[a-z0-9]')"
    split = (
        "list_filter(list_transform(string_split(t, '/'), lambda p: rtrim(p, '.')), lambda p: p <> '')"
    )
    return (
        f"flatten(list_transform({raw}, lambda t: CASE WHEN contains(t, '/') AND t NOT IN {in_list(fv.SLASH_COMPOUNDS)} "
        f"THEN {split} ELSE [t] END))"
    )


def stem_chain(source: str, out: str) -> list[tuple[str, str]]:
    """CTEs mapping every distinct token of ``source`` to its stem."""
    return [
        (f"{out}_1", f"""SELECT token, NOT regexp_full_match(token, '[a-z]+') OR length(token) <= 3 AS keep, CASE
            WHEN NOT regexp_full_match(token, '[a-z]+') OR length(token) <= 3 THEN token
            WHEN suffix(token, 'oes') OR suffix(token, 'aes') THEN left(token, -3) || 'ao'
            WHEN suffix(token, 'ais') THEN left(token, -3) || 'al'
            WHEN suffix(token, 'eis') AND length(token) > 5 THEN left(token, -3) || 'el'
            WHEN suffix(token, 'ies') AND length(token) > 4 THEN left(token, -3) || 'y'
            WHEN regexp_matches(token, '(ss|sh|ch|x|z)es$') OR (suffix(token, 'res') AND length(token) > 5) THEN left(token, -2)
            WHEN suffix(token, 's') AND NOT regexp_matches(token, '(ss|us|is)$') THEN left(token, -1)
            ELSE token END AS s FROM (SELECT DISTINCT token FROM {source})"""),
        (f"{out}_2", f"""SELECT token, keep, CASE WHEN keep THEN s WHEN suffix(s, 'ing') AND length(s) >= 7 THEN left(s, -3)
            WHEN suffix(s, 'ed') AND length(s) >= 6 THEN left(s, -2) ELSE s END AS s FROM {out}_1"""),
        (out, f"SELECT token, CASE WHEN NOT keep AND suffix(s, 'e') AND length(s) > 4 THEN left(s, -1) ELSE s END AS stem FROM {out}_2"),
    ]


def norm(x: str) -> str:
    s = f"regexp_replace({x}, '\\r\\n?', {NL}, 'g')"
    s = f"regexp_replace({s}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{2066}}-\\x{{2069}}\\x{{FEFF}}]', '', 'g')"
    s = f"regexp_replace({s}, '[\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    s = f"regexp_replace({s}, '[ \\t]+', ' ', 'g')"
    s = f"regexp_replace({s}, ' ?\\n ?', {NL}, 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    return f"trim({s}, ' ' || {NL})"


def lang_case(en: str, pt: str) -> str:
    return (
        f"CASE WHEN {en} + {pt} < 5 THEN 'unknown' WHEN {pt} > {en} * CAST(1.2 AS DOUBLE) THEN 'pt' "
        f"WHEN {en} > {pt} * CAST(1.2 AS DOUBLE) THEN 'en' ELSE 'unknown' END"
    )


def text_ctes(source: str, key: str = "doc_id") -> list[tuple[str, str]]:
    """norm / lines / tokens / language of a text source with columns (key, text, ...)."""
    en = [w for w in fv.STOPWORDS_EN if w not in fv.LANGUAGE_AMBIGUOUS]
    pt = [w for w in fv.STOPWORDS_PT if w not in fv.LANGUAGE_AMBIGUOUS]
    return [
        ("norm", f"SELECT * EXCLUDE (text), {norm('text')} AS text FROM ({source}) r"),
        ("lines", f"""SELECT {key}, unnest(string_split(text, {NL})) AS line,
            generate_subscripts(string_split(text, {NL}), 1) - 1 AS line_no FROM norm"""),
        ("toklist", f"SELECT {key}, {toks('text')} AS toks FROM norm"),
        ("tokens", f"SELECT {key}, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM toklist"),
        ("words", f"SELECT {key}, len(toks) AS words FROM toklist"),
        ("sample", f"SELECT {key}, token FROM tokens"),
        ("lang_n", f"""SELECT n.{key},
            COALESCE(SUM(CASE WHEN token IN {in_list(en)} THEN 1 ELSE 0 END), 0) AS en,
            COALESCE(SUM(CASE WHEN token IN {in_list(pt)} THEN 1 ELSE 0 END), 0)
              + LEAST(20, ANY_VALUE(len(regexp_extract_all(text, '[ãõçÃÕÇ]')))) AS pt
            FROM norm n LEFT JOIN sample s ON s.{key} = n.{key} GROUP BY n.{key}"""),
        ("lang", f"SELECT {key}, {lang_case('en', 'pt')} AS lang FROM lang_n"),
    ]


# ---- contact ------------------------------------------------------------------------------
def word_clean(w: str) -> str:
    s = f"regexp_replace({w}, '^[<(\\[{{\"''`]+', '')"
    s = f"regexp_replace({s}, '[>)\\]}}\"''`,;:.!?]+$', '')"
    return f"regexp_replace({s}, '(?i)^mailto:', '')"


def contact_ctes(source: str, prefix: str = "", key: str = "doc_id") -> list[tuple[str, str]]:
    p = prefix
    email = r"(?i)[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}(\.[a-z0-9-]{1,63}){0,8}\.[a-z]{2,24}"
    return [
        (f"{p}ws", f"""SELECT {key}, {word_clean('w')} AS w FROM (
            SELECT {key}, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM {source}) x WHERE w <> ''"""),
        (f"{p}wsum", f"""SELECT {key}, bool_or(regexp_full_match(w, '{email}')) AS email,
            bool_or(contains(lower(w), 'linkedin.com/in/') OR contains(lower(w), 'linkedin.com/pub/')) AS li_url,
            bool_or(regexp_replace(lower(w), '[^a-z]', '', 'g') = 'linkedin') AS li_label FROM {p}ws GROUP BY {key}"""),
        (f"{p}cand", f"""SELECT {key}, trim(unnest(regexp_extract_all(l, '\\+?\\(?\\d[\\d\\s().-]{{6,18}}\\d'))) AS c
            FROM (SELECT {key}, unnest(string_split(text, {NL})) AS l FROM {source}) x"""),
        (f"{p}phones", f"""SELECT {key}, c, length(regexp_replace(c, '\\D', '', 'g')) BETWEEN 8 AND 15
              AND NOT regexp_matches(c, '^\\d{{3}}\\.\\d{{3}}\\.\\d{{3}}-\\d{{2}}$|^\\d{{2}}\\.\\d{{3}}\\.\\d{{3}}/?\\d{{4}}-\\d{{2}}$')
              AND NOT regexp_matches(c, '^\\d{{1,2}}[./]\\d{{4}}\\s*[-–]\\s*\\d{{1,2}}[./]\\d{{4}}$')
              AND len(list_filter(regexp_extract_all(c, '\\d+'), lambda g: NOT regexp_full_match(g, '(19|20)\\d{{2}}'))) > 0
              AND (starts_with(c, '+') OR regexp_matches(c, '\\(\\d{{2,4}}\\)') OR length(regexp_replace(c, '\\D', '', 'g')) >= 10) AS ok
            FROM {p}cand"""),
        (f"{p}contact", f"""SELECT n.{key}, COALESCE(w.email, false) AS email,
            EXISTS (SELECT 1 FROM {p}phones ph WHERE ph.{key} = n.{key} AND ph.ok) AS phone,
            CASE WHEN w.li_url THEN 'url' WHEN w.li_label THEN 'label' ELSE 'none' END AS linkedin
            FROM {source} n LEFT JOIN {p}wsum w ON w.{key} = n.{key}"""),
    ]


BROKEN = [
    ("broken_c", f"""SELECT doc_id, line_no, regexp_replace(list_extract(string_split(rtrim(line), ' '), -1), '^[<(\\[{{"''`]+', '') AS tok,
        LEAD(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM lines"""),
    ("broken", """SELECT doc_id, arg_min(tok, line_no) AS url FROM broken_c
        WHERE length(tok) >= 6 AND regexp_matches(ltrim(nxt), '(?i)^[a-z0-9]')
          AND (regexp_matches(tok, '(?i)^(https?://)?(www\\.)?[a-z0-9-]{1,63}(\\.[a-z0-9-]{1,63}){1,8}/\\S{0,200}[-_]$')
               OR regexp_matches(tok, '(?i)linkedin\\.com/(in|pub)/$')) GROUP BY doc_id"""),
]

PII = [
    ("pii_l", f"SELECT doc_id, trim({fold('line')}) AS l FROM lines"),
    ("pii_f", """SELECT doc_id,
        bool_or(regexp_matches(l, '(^|\\D)\\d{3}\\.\\d{3}\\.\\d{3}-\\d{2}(\\D|$)') OR regexp_matches(l, '\\bcpf\\b')) AS f1,
        bool_or(regexp_matches(l, '\\brg\\b[^a-z0-9]{0,6}\\d')) AS f2,
        bool_or(regexp_matches(l, '\\b(data de nascimento|nascimento|nascid[oa] em|date of birth|birth date|birthdate|dob)\\b')) AS f3,
        bool_or(regexp_matches(l, '\\b(idade|age)\\s?:\\s?\\d{2}\\b')
             OR regexp_matches(l, '(^|[|,;·•–—-]\\s?)\\d{2} (anos|years old)\\s?($|[|,;·•–—-])')) AS f4,
        bool_or(regexp_matches(l, '\\b(estado civil|marital status)\\b')
             OR (length(l) <= 80 AND regexp_matches(l, '\\b(solteir[oa]|casad[oa]|divorciad[oa]|viuv[oa])\\b'))) AS f5
        FROM pii_l GROUP BY doc_id"""),
    ("pii", """SELECT doc_id, array_to_string(list_filter([CASE WHEN f1 THEN 'taxId' END, CASE WHEN f2 THEN 'idCard' END,
        CASE WHEN f3 THEN 'birthDate' END, CASE WHEN f4 THEN 'age' END, CASE WHEN f5 THEN 'maritalStatus' END],
        lambda k: k IS NOT NULL), ',') AS kinds FROM pii_f"""),
]

# ---- content ------------------------------------------------------------------------------
_MB = r"([a-z]{3,9}\.?\s(de\s)?|\d{1,2}[/.])?"
DATE_RX = (
    rf"{YEAR}\s?([-–—]|\s(to|a|ate)\s)\s?({_MB}{YEAR}|present|current|now|today|atual|hoje|presente|o momento|momento)"
    rf"|\b(since|desde)\s{_MB}{YEAR}"
)
_ALLOWED = in_list(fv.LONE_GLYPHS_ALLOWED)
CONTENT = [
    ("body", f"""SELECT doc_id, line_no, regexp_matches(trim(line), '^{GLYPHS}') AS bullet,
        regexp_replace(trim(line), '^{GLYPHS}\\s*', '') AS body FROM lines WHERE trim(line) <> ''"""),
    ("btok", f"""SELECT *, {toks('body')} AS t,
        {toks("regexp_replace(body, '^[' || chr(92) || 'p{L}]{2,20}(' || chr(92) || 's[' || chr(92) || 'p{L}]{2,20})?:' || chr(92) || 's+', '')")} AS v FROM body"""),
    ("bline", f"""SELECT doc_id, line_no, bullet, bullet AND len(t) > 35 AS long,
        len(t) >= 4 AND (regexp_matches(body, '(?i)\\d\\s?(%|x\\b|k\\b|\\+)|[$€£]\\s?\\d|r\\$\\s?\\d')
          OR len(list_filter(t, lambda x: regexp_full_match(x, '\\d{{2,}}') AND NOT regexp_full_match(x, '{YEAR}'))) > 0) AS quantified,
        CASE WHEN v[1] = 'co' THEN list_slice(v, 2, len(v)) ELSE v END AS v FROM btok"""),
    ("bverb", f"SELECT *, CASE WHEN len(v) >= 3 AND v[1] IN {in_list(LEX.action_verbs)} THEN v[1] END AS verb FROM bline"),
    ("vtok", "SELECT DISTINCT verb AS token FROM bverb WHERE verb IS NOT NULL"),
    *stem_chain("vtok", "vstem"),
    ("vuse", """SELECT doc_id, stem, COUNT(*) AS n, MIN(line_no) AS first, arg_min(verb, line_no) AS verb
        FROM bverb JOIN vstem ON token = verb GROUP BY doc_id, stem"""),
    ("topverb", "SELECT doc_id, verb, n FROM vuse QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1"),
    ("content", """SELECT n.doc_id, COUNT(b.line_no) AS n_lines, COALESCE(SUM(CASE WHEN bullet THEN 1 ELSE 0 END), 0) AS bullets,
        COALESCE(SUM(CASE WHEN quantified THEN 1 ELSE 0 END), 0) AS quantified, COUNT(verb) AS action_verbs,
        COALESCE(SUM(CASE WHEN long THEN 1 ELSE 0 END), 0) AS long_bullets
        FROM norm n LEFT JOIN bverb b ON b.doc_id = n.doc_id GROUP BY n.doc_id"""),
    ("signals", f"""SELECT n.doc_id, COUNT(*) FILTER (WHERE regexp_full_match(token, '{YEAR}')) AS years,
        COUNT(*) FILTER (WHERE token IN ('i', 'my', 'me', 'myself')) AS first_person
        FROM norm n LEFT JOIN tokens t ON t.doc_id = n.doc_id GROUP BY n.doc_id"""),
    ("stray", f"""SELECT doc_id, COUNT(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM norm) x
        WHERE length(w) = 1 AND NOT regexp_matches(w, '[A-Za-z0-9\\x{{E000}}-\\x{{F8FF}}\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]')
          AND w NOT IN {_ALLOWED} GROUP BY doc_id"""),
    ("garbled", """SELECT n.doc_id, len(regexp_extract_all(text, '[\\x{E000}-\\x{F8FF}\\x{FFFD}]|\\(cid:\\d{1,5}\\)')) + COALESCE(s.n, 0) AS garbled
        FROM norm n LEFT JOIN stray s ON s.doc_id = n.doc_id"""),
    ("weak_d", values([(("  ".join(tokens.split(" "))), phrase, rank) for tokens, phrase, rank in LEX.weak_rows], "needle, phrase, rank")),
    ("padded2", "SELECT doc_id, ' ' || array_to_string(toks, '  ') || ' ' AS p FROM toklist"),
    ("weak_n", """SELECT doc_id, phrase, rank, (length(p) - length(replace(p, ' ' || needle || ' ', ''))) // (length(needle) + 2) AS n
        FROM padded2, weak_d WHERE contains(p, ' ' || needle || ' ')"""),
    ("weak", """SELECT doc_id, SUM(n) AS total, string_agg(phrase || '=' || n, ';' ORDER BY n DESC, rank) AS listed,
        array_to_string(list('“' || phrase || '”' ORDER BY n DESC, rank), ', ') AS quoted FROM weak_n GROUP BY doc_id"""),
    ("dated", f"SELECT doc_id, line_no, regexp_matches({fold('line')}, '{DATE_RX}') AS d FROM lines"),
]

# ---- sections -----------------------------------------------------------------------------
_SYN = [(s, sec, fv.SECTIONS.index(sec)) for sec in fv.SECTIONS for s in fv.SECTION_SYNONYMS[sec]]
SECTIONS = [
    ("syn", values(_SYN, "phrase, section, sec_rank")),
    ("creative", values(list(fv.NONSTANDARD_HEADINGS.items()), "phrase, section")),
    ("cand1", f"""SELECT doc_id, line_no, trim(line) AS t, regexp_matches(trim(line), '^{GLYPHS}') AS bullet, strpos(trim(line), ':') AS colon FROM lines"""),
    ("cand2", """SELECT doc_id, line_no, t, bullet, 1 AS attempt, t AS c, false AS inline FROM cand1
        UNION ALL SELECT doc_id, line_no, t, bullet, 3, left(t, colon - 1), regexp_matches(substr(t, colon), '[\\p{L}\\p{N}]')
        FROM cand1 WHERE colon BETWEEN 2 AND 41"""),
    ("cand3", f"""SELECT * EXCLUDE (c), regexp_replace(regexp_replace(regexp_replace({fold('trim(c)')}, '^[^a-z]+', ''), '[\\s:.\\-–—|]+$', ''), '\\s+', ' ', 'g') AS k
        FROM cand2 WHERE length(trim(c)) BETWEEN 1 AND 48"""),
    ("cand4", "SELECT * FROM cand3 WHERE k <> '' AND len(string_split(k, ' ')) <= 5"),
    ("keys", """SELECT doc_id, line_no, t, bullet, inline, attempt, false AS decorated, k FROM cand4
        UNION ALL SELECT doc_id, line_no, t, bullet, inline, attempt + 1, true, regexp_extract(k, '^\\S (.+)$', 1) FROM cand4
        WHERE regexp_matches(k, '^\\S .+$')"""),
    ("dkeys", "SELECT DISTINCT k, bullet FROM keys"),
    ("parts", """SELECT k, unnest(list_filter(ps, lambda p: p <> '')) AS part, generate_subscripts(list_filter(ps, lambda p: p <> ''), 1) AS pos,
        len(list_filter(ps, lambda p: p <> '')) AS n
        FROM (SELECT DISTINCT k, regexp_split_to_array(k, '\\s*(?:&|/|,|\\+|\\band\\b|\\be\\b)\\s*') AS ps FROM keys) x"""),
    ("multi", "SELECT k, section, MIN(pos) AS pos FROM parts JOIN syn ON phrase = part WHERE n > 1 GROUP BY k, section"),
    ("single", """SELECT k, bullet, arg_min(section, sec_rank) AS section FROM dkeys JOIN syn
        ON k = phrase OR (NOT bullet AND starts_with(k, phrase || ' ') AND len(string_split(trim(substr(k, length(phrase) + 1)), ' ')) <= 2)
        GROUP BY k, bullet"""),
    ("ksec", """SELECT d.k, d.bullet, m.section, m.pos FROM dkeys d JOIN multi m ON m.k = d.k
        UNION ALL SELECT s.k, s.bullet, s.section, 1 FROM single s WHERE s.k NOT IN (SELECT k FROM multi)"""),
    ("hit", """SELECT y.*, s.section, s.pos FROM (SELECT *, MIN(attempt) OVER (PARTITION BY doc_id, line_no) AS best FROM keys x
          WHERE EXISTS (SELECT 1 FROM ksec s WHERE s.k = x.k AND s.bullet = x.bullet)) y
        JOIN ksec s ON s.k = y.k AND s.bullet = y.bullet WHERE y.attempt = y.best"""),
    ("odd", """SELECT c.doc_id, c.line_no, c.t AS heading, v.section AS suggestion FROM cand4 c JOIN creative v ON v.phrase = c.k
        WHERE c.attempt = 1 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = c.doc_id AND h.line_no = c.line_no)"""),
    ("heads", """SELECT DISTINCT doc_id, line_no, inline FROM hit UNION ALL SELECT doc_id, line_no, false FROM odd"""),
    ("nlines", "SELECT doc_id, COUNT(*) AS n FROM lines GROUP BY doc_id"),
    ("ends", """SELECT h.doc_id, h.line_no, h.inline, CASE WHEN h.inline THEN h.line_no ELSE h.line_no + 1 END AS start,
        CASE WHEN h.inline THEN h.line_no + 1 ELSE COALESCE((SELECT MIN(b.line_no) FROM heads b
          WHERE b.doc_id = h.doc_id AND NOT b.inline AND b.line_no > h.line_no), n.n) END AS stop
        FROM heads h JOIN nlines n ON n.doc_id = h.doc_id"""),
    ("spans0", """SELECT h.doc_id, h.section, e.start, e.stop, e.inline FROM hit h JOIN ends e ON e.doc_id = h.doc_id AND e.line_no = h.line_no"""),
    ("spans", """SELECT s.*, s.inline OR EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = s.doc_id AND l.line_no >= s.start AND l.line_no < s.stop
        AND regexp_matches(l.line, '[\\p{L}\\p{N}]')) AS has_text FROM spans0 s"""),
    ("secs", values([(s, i) for i, s in enumerate(fv.SECTIONS)], "section, sec_rank")),
    ("found", "SELECT DISTINCT doc_id, section FROM hit WHERE NOT decorated"),
    ("deco", """SELECT doc_id, section, t AS heading, line_no, pos FROM hit h WHERE decorated
        AND NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = h.doc_id AND f.section = h.section)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, section ORDER BY line_no, pos) = 1"""),
    ("oddf", """SELECT * FROM (SELECT * FROM odd QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, suggestion ORDER BY line_no) = 1) o
        WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.doc_id = o.doc_id AND f.section = o.suggestion)"""),
    ("empties", "SELECT doc_id, section FROM spans GROUP BY doc_id, section HAVING NOT bool_or(has_text)"),
    ("credit", """SELECT n.doc_id, s.section, s.sec_rank, CASE WHEN e.section IS NOT NULL THEN 0.0 WHEN f.section IS NOT NULL THEN 1.0
          WHEN d.section IS NOT NULL THEN 0.5 ELSE 0.0 END AS credit, e.section IS NOT NULL AS is_empty, f.section IS NOT NULL AS is_found
        FROM norm n CROSS JOIN secs s LEFT JOIN empties e ON e.doc_id = n.doc_id AND e.section = s.section
        LEFT JOIN found f ON f.doc_id = n.doc_id AND f.section = s.section
        LEFT JOIN deco d ON d.doc_id = n.doc_id AND d.section = s.section"""),
    ("secscore", """SELECT doc_id, SUM(credit * CASE section WHEN 'experience' THEN 30 WHEN 'education' THEN 20 WHEN 'skills' THEN 25
          WHEN 'summary' THEN 15 ELSE 0 END) + 10 * MAX(CASE WHEN section IN ('projects', 'certifications', 'languages') THEN credit ELSE 0 END) AS pts,
        string_agg(section, ',' ORDER BY sec_rank) FILTER (WHERE is_found) AS found,
        string_agg(section, ',' ORDER BY sec_rank) FILTER (WHERE is_found AND NOT is_empty) AS filled,
        string_agg(section, ',' ORDER BY sec_rank) FILTER (WHERE is_empty) AS empty FROM credit GROUP BY doc_id"""),
    ("workb", f"""SELECT s.doc_id, COUNT(l.line_no) FILTER (WHERE regexp_matches(trim(l.line), '^{GLYPHS}')) AS n FROM spans s
        LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.line_no >= s.start AND l.line_no < s.stop
        WHERE s.section IN ('experience', 'projects') GROUP BY s.doc_id"""),
    ("datedspan", """SELECT s.doc_id, COUNT(l.line_no) FILTER (WHERE l.d) AS n FROM spans s
        LEFT JOIN dated l ON l.doc_id = s.doc_id AND l.line_no >= s.start AND l.line_no < s.stop
        WHERE s.section = 'experience' GROUP BY s.doc_id"""),
    ("datedall", "SELECT doc_id, COUNT(*) FILTER (WHERE d) AS n FROM dated GROUP BY doc_id"),
]

# ---- document scores ----------------------------------------------------------------------
def clamp(x: str) -> str:
    return f"CAST(GREATEST(0, LEAST(100, floor(CAST({x} AS DOUBLE) + 0.5))) AS INTEGER)"


_LABEL_CASE = lambda section, lang: "CASE " + " ".join(
    f"WHEN {lang} = '{code}' AND {section} = '{s}' THEN {q(labels[s])}" for code, labels in fv.SECTION_LABELS.items() for s in fv.SECTIONS
) + f" ELSE {section} END"

SCORES = [
    ("hfsrc", "SELECT doc_id, header_footer_text AS text FROM norm WHERE header_footer_text <> ''"),
    *contact_ctes("hfsrc", "hf_"),
    ("feat", """SELECT n.doc_id, w.words, c.n_lines, c.bullets, c.quantified, c.action_verbs, c.long_bullets, tv.verb AS top_verb, tv.n AS top_n,
        g.garbled, s.years, s.first_person, COALESCE(wk.total, 0) AS weak_total, wk.quoted, ct.email, ct.phone, ct.linkedin,
        COALESCE(h.email, false) AS hf_email, COALESCE(h.phone, false) AS hf_phone, b.url AS broken, p.kinds, la.lang,
        sc.pts AS sec_pts, sc.found, sc.filled, n.l_tables, n.l_boxes, n.l_images, n.l_columns, n.l_pages, n.truncated,
        COALESCE(ds.n, da.n) AS dated, COALESCE(wb.n, c.bullets) AS work_bullets,
        GREATEST(3, CAST(ceil(COALESCE(wb.n, c.bullets) * CAST(0.3 AS DOUBLE)) AS INTEGER)) AS qt,
        GREATEST(5, CAST(ceil(COALESCE(wb.n, c.bullets) * CAST(0.6 AS DOUBLE)) AS INTEGER)) AS vt
        FROM norm n JOIN words w USING (doc_id) JOIN content c USING (doc_id) JOIN garbled g USING (doc_id) JOIN signals s USING (doc_id)
        JOIN contact ct USING (doc_id) JOIN lang la USING (doc_id) JOIN secscore sc USING (doc_id) JOIN datedall da USING (doc_id)
        LEFT JOIN topverb tv USING (doc_id) LEFT JOIN weak wk USING (doc_id) LEFT JOIN hf_contact h USING (doc_id)
        LEFT JOIN broken b USING (doc_id) LEFT JOIN pii p USING (doc_id) LEFT JOIN datedspan ds USING (doc_id) LEFT JOIN workb wb USING (doc_id)"""),
    ("pts", f"""SELECT f.*, words >= 10 AS ready, (hf_email AND NOT email) OR (hf_phone AND NOT phone) AS hidden,
        100 - CASE WHEN words < 150 THEN 15 WHEN words > 1300 THEN 10 ELSE 0 END - CASE WHEN garbled >= 3 THEN LEAST(25, 5 + garbled) ELSE 0 END
          - CASE WHEN l_tables > 1 THEN 15 WHEN l_tables > 0 THEN 10 ELSE 0 END - CASE WHEN l_boxes > 0 THEN 15 ELSE 0 END
          - CASE WHEN l_columns THEN 20 ELSE 0 END - CASE WHEN l_pages > 2 THEN 10 ELSE 0 END
          - CASE WHEN (hf_email AND NOT email) OR (hf_phone AND NOT phone) THEN 10 ELSE 0 END AS parse_pts,
        CASE WHEN email THEN 45 WHEN hf_email THEN 20 ELSE 0 END + CASE WHEN phone THEN 30 WHEN hf_phone THEN 15 ELSE 0 END
          + CASE linkedin WHEN 'url' THEN 25 WHEN 'label' THEN 10 ELSE 0 END - CASE WHEN broken IS NOT NULL THEN 10 ELSE 0 END AS contact_pts,
        LEAST(CAST(quantified AS DOUBLE) / qt, 1) * 35 + LEAST(CAST(action_verbs AS DOUBLE) / vt, 1) * 25 + CASE WHEN bullets >= 3 THEN 15 ELSE 0 END
          + CASE WHEN dated > 0 THEN 25 WHEN years >= 2 THEN 10 ELSE 0 END - CASE WHEN lang = 'en' AND first_person >= 4 THEN 10 ELSE 0 END
          - CASE WHEN weak_total >= 3 THEN 5 ELSE 0 END AS content_pts FROM feat f"""),
    ("scored", f"""SELECT *, CASE WHEN ready THEN {clamp('parse_pts')} ELSE 0 END AS parseability_score,
        CASE WHEN ready THEN {clamp('sec_pts')} END AS sections_score, CASE WHEN ready THEN {clamp('contact_pts')} END AS contact_score,
        CASE WHEN ready THEN {clamp('content_pts')} END AS content_score FROM pts"""),
    ("based", f"""SELECT *, CASE WHEN ready THEN {clamp('parseability_score * CAST(0.35 AS DOUBLE) + sections_score * CAST(0.25 AS DOUBLE) + contact_score * CAST(0.15 AS DOUBLE) + content_score * CAST(0.25 AS DOUBLE)')}
        ELSE 0 END AS base_score FROM scored"""),
]


def _f(order, id_, severity, category, test, params="''", sub="0", source="scored") -> str:
    sev = severity if severity.startswith("CASE") else q(severity)
    ident = id_ if id_.startswith("CASE") else q(id_)
    return (
        f"SELECT doc_id, {order} AS ord, {sub} AS sub, {ident} AS id, {sev} AS severity, '{category}' AS category, {params} AS params "
        f"FROM {source} WHERE {test}"
    )


def kv(**params: str) -> str:
    return " || ';' || ".join(f"'{k}=' || {v}" for k, v in sorted(params.items()))


R = "ready AND "
DOC_FINDINGS = " UNION ALL ".join([
    _f(1, "text.empty", "critical", "parseability", "NOT ready"),
    _f(2, "text.readable", "pass", "parseability", "ready", kv(words="words")),
    _f(3, "text.short", "warning", "parseability", R + "words < 150", kv(words="words")),
    _f(4, "text.long", "warning", "parseability", R + "words > 1300", kv(words="words")),
    _f(5, "text.garbled", "warning", "parseability", R + "garbled >= 3", kv(count="garbled")),
    _f(6, "text.truncated", "info", "parseability", R + "truncated"),
    _f(7, "layout.tables", "warning", "parseability", R + "l_tables > 0", kv(count="l_tables")),
    _f(8, "layout.textBoxes", "warning", "parseability", R + "l_boxes > 0", kv(count="l_boxes")),
    _f(9, "layout.columns", "warning", "parseability", R + "l_columns"),
    _f(10, "layout.images", "info", "parseability", R + "l_images > 0", kv(count="l_images")),
    _f(11, "layout.pages", "warning", "parseability", R + "l_pages > 2", kv(count="l_pages")),
    _f(12, "contact.email", "pass", "contact", R + "email"),
    _f(12, "contact.emailMissing", "critical", "contact", R + "NOT email AND NOT hf_email"),
    _f(13, "contact.phone", "pass", "contact", R + "phone"),
    _f(13, "contact.phoneMissing", "warning", "contact", R + "NOT phone AND NOT hf_phone"),
    _f(14, "layout.headerFooterContact", "warning", "parseability", R + "hidden"),
    _f(15, "contact.linkedin", "pass", "contact", R + "linkedin = 'url'"),
    _f(15, "contact.linkedinHidden", "info", "contact", R + "linkedin = 'label'"),
    _f(15, "contact.linkedinMissing", "info", "contact", R + "linkedin = 'none'"),
    _f(16, "contact.brokenUrl", "warning", "contact", R + "broken IS NOT NULL", kv(url="broken")),
    _f(17, "contact.personalData", "warning", "contact", R + "kinds <> ''", kv(items="kinds")),
    _f(18, "sections.found", "pass", "sections", R + "filled IS NOT NULL", kv(sections="filled")),
    _f(19, "sections.empty", "warning", "sections", R + "is_empty", kv(section="section"),
       "ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY sec_rank) - 1", "(SELECT c.*, s.ready FROM credit c JOIN scored s USING (doc_id) WHERE c.is_empty) z"),
    _f(20, "sections.decorated", "warning", "sections", "ready", kv(heading="heading", section="section"),
       "ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY line_no, pos) - 1", "(SELECT d.*, s.ready FROM deco d JOIN scored s USING (doc_id)) z"),
    _f(21, "sections.missing", "warning", "sections", R + "credit = 0 AND NOT is_empty AND section IN ('experience', 'education', 'skills')",
       kv(section="section"), "CASE section WHEN 'experience' THEN 0 WHEN 'education' THEN 1 ELSE 2 END", "(SELECT c.*, s.ready FROM credit c JOIN scored s USING (doc_id)) z"),
    _f(22, "sections.summaryMissing", "info", "sections", R + "credit = 0 AND NOT is_empty AND section = 'summary'",
       source="(SELECT c.*, s.ready FROM credit c JOIN scored s USING (doc_id)) z"),
    _f(23, "sections.nonstandard", "info", "sections", "ready", kv(heading="heading", suggestion=_LABEL_CASE("suggestion", "lang")),
       "ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY line_no) - 1", "(SELECT o.*, s.ready, s.lang FROM oddf o JOIN scored s USING (doc_id)) z"),
    _f(24, "content.quantified", "pass", "content", R + "quantified >= qt", kv(count="quantified")),
    _f(24, "content.quantifiedLow", "warning", "content", R + "quantified < qt", kv(count="quantified", target="qt")),
    _f(25, "content.actionVerbs", "pass", "content", R + "action_verbs >= vt", kv(count="action_verbs")),
    _f(25, "content.actionVerbsLow", "info", "content", R + "action_verbs < vt", kv(count="action_verbs", target="vt")),
    _f(26, "content.bullets", "pass", "content", R + "bullets >= 3", kv(count="bullets")),
    _f(26, "content.bulletsMissing", "info", "content", R + "bullets < 3"),
    _f(27, "content.dateRangesMissing", "warning", "content", R + "dated = 0 AND years >= 2"),
    _f(27, "content.datesMissing", "warning", "content", R + "dated = 0 AND years < 2"),
    _f(28, "content.pronouns", "info", "content", R + "lang = 'en' AND first_person >= 4", kv(count="first_person")),
    _f(29, "content.weakPhrases", "info", "content", R + "weak_total > 0", kv(count="weak_total", phrases="quoted")),
    _f(30, "content.longBullets", "info", "content", R + "long_bullets > 0", kv(count="long_bullets", max="35")),
    _f(31, "content.repeatedVerb", "info", "content", R + "top_n >= 4", kv(count="top_n", verb="top_verb")),
])
FINDINGS = [("docfind", DOC_FINDINGS)]
SEV = "CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3 ELSE 4 END"


# ---- keywords -----------------------------------------------------------------------------
_ALIASES = sorted((row[0] for row in LEX.alias_rows), key=lambda a: (-len(a.split(" ")), a))
ALIAS_RX = " (" + "|".join("  ".join(rx(t) for t in a.split(" ")) for a in _ALIASES) + ") "
_LABELS = [(s.label, s.before is not None) for s in LEX.skills if s.exact_case]


def skill_ctes(source: str, keys: str, p: str) -> list[tuple[str, str]]:
    """(keys, skill, n) over rows of ``source(keys, text)``; scan scope is the row."""
    start = "(^|\\n)[ \\t" + rx(fv.LABEL_LINE_START) + "]*$"
    blocked = in_list(f"{a} {b}" for a, b in LEX.blocked_next)
    label_values = ", ".join(f"({q(label)}, {str(item).lower()})" for label, item in _LABELS)
    return [
        (f"{p}dim", values([(r[0], r[1]) for r in LEX.alias_rows], "alias, skill")),
        (f"{p}dbl", f"SELECT {keys}, ' ' || array_to_string({toks('text')}, '  ') || ' ' AS d FROM {source}"),
        (f"{p}ahit", f"SELECT {keys}, replace(unnest(regexp_extract_all(d, {q(ALIAS_RX)}, 1)), '  ', ' ') AS alias FROM {p}dbl"),
        (f"{p}piece", f"""SELECT {keys}, text, label, item, string_split(text, label) AS ps FROM {source},
            (SELECT * FROM (VALUES {label_values}) v(label, item)) l WHERE contains(text, label)"""),
        (f"{p}at", f"""SELECT {keys}, text, label, item, CAST(list_sum(list_transform(list_slice(ps, 1, i), lambda x: length(x))) AS BIGINT)
            + (i - 1) * length(label) AS off FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM {p}piece) x"""),
        (f"{p}occ", f"SELECT {keys}, label, item, left(text, off) AS lft, substr(text, off + length(label) + 1) AS rgt FROM {p}at"),
        (f"{p}lhit", f"""SELECT {keys}, label AS skill FROM {p}occ WHERE CASE WHEN item THEN
              regexp_matches(lft, '((^|\\n)|[,/|;:(])[ \\t]*$') AND regexp_matches(rgt, '^[ \\t]*([,/|;)]|\\n|$)')
            ELSE NOT regexp_matches(lft, '[\\w.#+-]$') AND NOT regexp_matches(rgt, '^[\\w#+-]')
              AND CASE WHEN regexp_matches(lft, '{start}') THEN regexp_matches(rgt, '^\\s*[,/|;]')
                  ELSE NOT regexp_matches(lft, '[.!?]\\s{{1,3}}$') END END
            AND COALESCE(label || ' ' || list_extract({toks('left(rgt, 40)')}, 1), '') NOT IN {blocked}"""),
        (f"{p}skills", f"""SELECT {keys}, skill, COUNT(*) AS n FROM (SELECT {keys}, skill FROM {p}ahit JOIN {p}dim USING (alias)
            UNION ALL SELECT {keys}, skill FROM {p}lhit) x GROUP BY {keys}, skill"""),
    ]


def _weight_case() -> str:
    arms = []
    for weight, phrases in fv.JOB_LINE_HEADINGS:
        words = "|".join(".".join(rx(x) for x in p.strip().split(".")) for p in phrases.split(";"))
        arms.append(f"WHEN regexp_matches(k, '\\b({words})\\b') THEN CAST({weight} AS DOUBLE)")
    return "CASE WHEN length(k) > 60 THEN NULL " + " ".join(arms) + " END"


ORDER_KEY = "translate(lower(term), ' ./#+', chr(1) || chr(2) || chr(3) || chr(4) || chr(5))"
_EXCLUDED = sorted(set(fv.STOPWORDS_EN) | set(fv.STOPWORDS_PT) | set(LEX.job_noise) | {t for s in LEX.skills if s.exact_case for t in tokenize_entry(s.label)})


def job_ctes() -> list[tuple[str, str]]:
    src = text_ctes(fx.SYNTH_JOBS, "job_id")
    rename = {n: "j_" + n for n, _ in src}
    out = []
    for name, sql in src:
        for old, new in rename.items():
            sql = sql.replace(f"FROM {old} ", f"FROM {new} ").replace(f"JOIN {old} ", f"JOIN {new} ")
            if sql.endswith(f"FROM {old}"):
                sql = sql[: -len(old)] + new
        out.append((rename[name], sql))
    soft = in_list(s.label for s in LEX.skills if s.soft)
    return out + [
        ("jkey", f"SELECT job_id, line_no, line, trim({fold('line')}) AS k FROM j_lines"),
        ("jown", f"SELECT job_id, line_no, line, {_weight_case()} AS own FROM jkey"),
        ("jw", """SELECT job_id, line_no, line, COALESCE(LAST_VALUE(own IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS weight FROM jown"""),
        ("jl", "SELECT job_id, line_no, weight, line AS text FROM jw WHERE weight > 0"),
        *skill_ctes("jl", "job_id, line_no, weight", "js_"),
        ("jskill", f"""SELECT job_id, skill, SUM(n) AS n, MAX(weight) AS max_weight,
            CASE WHEN skill IN {soft} THEN CAST(1.5 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END
              * CASE WHEN MAX(weight) >= 1.5 THEN CAST(1.2 AS DOUBLE) WHEN MAX(weight) < 1 THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
              + LEAST(SUM(n) - 1, 3) * CAST(0.5 AS DOUBLE) AS weight FROM js_skills GROUP BY job_id, skill"""),
        ("jmask", f"SELECT job_id, line_no, weight, string_split(trim(regexp_replace(d, {q(ALIAS_RX)}, ' ~ ', 'g')), '  ') AS ts FROM js_dbl"),
        ("jtok", "SELECT job_id, line_no, weight, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM jmask"),
        *stem_chain("jtok", "jstem"),
        ("juse", f"""SELECT t.job_id, t.line_no, t.weight, t.pos, t.token, s.stem,
            t.token <> '~' AND length(t.token) >= 3 AND NOT regexp_full_match(t.token, '\\d+([.,]\\d+)?') AND t.token NOT IN {in_list(_EXCLUDED)} AS ok
            FROM jtok t JOIN jstem s ON s.token = t.token"""),
        ("jnext", """SELECT *, LEAD(token) OVER w AS token2, LEAD(stem) OVER w AS stem2, COALESCE(LEAD(ok) OVER w, false) AS ok2
            FROM juse WINDOW w AS (PARTITION BY job_id, line_no ORDER BY pos)"""),
        ("jment", """SELECT job_id, line_no, pos, stem AS key, token AS display, 1 AS n_stems, weight AS w FROM jnext WHERE ok
            UNION ALL SELECT job_id, line_no, pos, stem || ' ' || stem2, token || ' ' || token2, 2, weight * CAST(1.5 AS DOUBLE) FROM jnext WHERE ok AND ok2"""),
        ("jsurf", """SELECT job_id, key, n_stems, display, COUNT(*) AS n, MIN(line_no * 100000 + pos) AS first FROM jment GROUP BY ALL"""),
        ("jdisp", "SELECT job_id, key, display FROM jsurf QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id, key ORDER BY n DESC, first) = 1"),
        ("jterm", """SELECT job_id, key, n_stems, COUNT(*) AS n, MAX(w) AS max_weight, LEAST(SUM(w), 4.0) AS weight FROM jment GROUP BY job_id, key, n_stems
            HAVING COUNT(*) >= 2 OR (MAX(w) >= 1.5 AND n_stems = 1 AND length(key) >= 4)"""),
        ("jt", f"""SELECT * , ROW_NUMBER() OVER (PARTITION BY job_id, n_stems ORDER BY weight DESC, {ORDER_KEY}) AS pos
            FROM (SELECT t.*, d.display AS term FROM jterm t JOIN jdisp d ON d.job_id = t.job_id AND d.key = t.key) z"""),
        ("jbi", "SELECT * FROM jt WHERE n_stems = 2 AND pos <= 6"),
        ("jun", """SELECT * FROM jt t WHERE n_stems = 1 AND NOT EXISTS (SELECT 1 FROM jbi b WHERE b.job_id = t.job_id
            AND list_contains(string_split(b.key, ' '), t.key))"""),
        ("jchosen", """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY n_stems DESC, pos) AS p
            FROM (SELECT * FROM jbi UNION ALL SELECT * FROM jun) x) y WHERE p <= 12"""),
        ("jtops", f"""SELECT * FROM (SELECT *, skill AS term, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY weight DESC, {ORDER_KEY.replace('term', 'skill')}) AS p FROM jskill) x WHERE p <= 20"""),
        ("jkw", """SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY p) AS rank, CAST(round(weight * 1000) AS BIGINT) AS milli FROM (
            SELECT job_id, 'skill' AS kind, term, term AS key, weight, p FROM jtops
            UNION ALL SELECT job_id, 'term' || n_stems, term, key, weight, p + 1000 FROM jchosen) x"""),
    ]


MATCH = [
    *skill_ctes("norm", "doc_id", "ds_"),
    *stem_chain("tokens", "dstem"),
    ("dstems", "SELECT t.doc_id, t.pos, s.stem FROM tokens t JOIN dstem s ON s.token = t.token"),
    ("dnext", """SELECT doc_id, pos, stem, LEAD(stem) OVER (PARTITION BY doc_id ORDER BY pos) AS stem2,
        pos - ROW_NUMBER() OVER (PARTITION BY doc_id, stem ORDER BY pos) AS run FROM dstems"""),
    ("druns", "SELECT doc_id, stem, run, COUNT(*) AS n FROM dnext GROUP BY doc_id, stem, run HAVING COUNT(*) >= 2"),
    ("dterms", """SELECT doc_id, 'term1' AS kind, stem AS key, COUNT(*) AS n FROM dstems GROUP BY doc_id, stem
        UNION ALL SELECT doc_id, 'term2', stem || ' ' || stem2, COUNT(*) FROM dnext WHERE stem2 <> stem GROUP BY doc_id, stem, stem2
        UNION ALL SELECT doc_id, 'term2', stem || ' ' || stem, SUM(n // 2) FROM druns GROUP BY doc_id, stem
        UNION ALL SELECT doc_id, 'skill', skill, n FROM ds_skills"""),
    ("pairs", fx.SYNTH_PAIRS),
    ("hits", """SELECT p.doc_id, p.job_id, k.rank, k.kind, k.term, k.weight, k.milli, COALESCE(d.n, 0) AS n, COALESCE(d.n, 0) > 0 AS matched,
        COALESCE(d.n, 0) >= 10 AND COALESCE(d.n, 0) / CAST(GREATEST(w.words, 1) AS DOUBLE) > CAST(0.03 AS DOUBLE) AS stuffed
        FROM pairs p JOIN words w ON w.doc_id = p.doc_id JOIN jkw k ON k.job_id = p.job_id
        LEFT JOIN dterms d ON d.doc_id = p.doc_id AND d.kind = k.kind AND d.key = k.key WHERE w.words >= 10"""),
    ("match0", """SELECT doc_id, job_id, COUNT(*) AS n_keywords, COUNT(*) FILTER (WHERE matched) AS n_matched, COUNT(*) FILTER (WHERE NOT matched) AS n_missing,
        COUNT(*) FILTER (WHERE stuffed) AS n_stuffed, SUM(milli) AS total, COALESCE(SUM(milli) FILTER (WHERE matched AND NOT stuffed), 0) AS hit,
        string_agg(term, ', ' ORDER BY weight DESC, rank) FILTER (WHERE matched) AS matched,
        string_agg(term, ', ' ORDER BY weight DESC, rank) FILTER (WHERE NOT matched) AS missing,
        array_to_string(list(term ORDER BY weight DESC, rank) FILTER (WHERE NOT matched), ', ') AS missing8
        FROM hits GROUP BY doc_id, job_id"""),
    ("match", """SELECT *, CAST(GREATEST(0, floor(CASE WHEN total = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(hit AS DOUBLE) / total * 100 END
        - LEAST(n_stuffed * 10, 30) + 0.5)) AS INTEGER) AS keyword_score FROM match0"""),
    ("jinfo", """SELECT n.job_id, w.words AS job_words, l.lang AS job_lang FROM j_norm n JOIN j_words w ON w.job_id = n.job_id
        JOIN j_lang l ON l.job_id = n.job_id WHERE n.text <> ''"""),
]
TOTALS = [
    ("rows0", """SELECT s.*, p.job_id FROM scored s LEFT JOIN pairs p ON p.doc_id = s.doc_id"""),
    ("rows1", """SELECT r.*, i.job_words, i.job_lang, m.n_keywords, m.n_matched, m.n_missing, m.keyword_score, m.matched, m.missing, m.missing8
        FROM rows0 r LEFT JOIN jinfo i ON i.job_id = r.job_id LEFT JOIN match m ON m.doc_id = r.doc_id AND m.job_id = r.job_id"""),
    ("totals", f"""SELECT *, CASE WHEN NOT ready THEN 0 WHEN keyword_score IS NULL THEN
        {clamp('parseability_score * CAST(0.35 AS DOUBLE) + sections_score * CAST(0.25 AS DOUBLE) + contact_score * CAST(0.15 AS DOUBLE) + content_score * CAST(0.25 AS DOUBLE)')}
        ELSE {clamp('parseability_score * CAST(0.25 AS DOUBLE) + sections_score * CAST(0.15 AS DOUBLE) + contact_score * CAST(0.1 AS DOUBLE) + content_score * CAST(0.15 AS DOUBLE) + keyword_score * CAST(0.35 AS DOUBLE)')} END AS score FROM rows1"""),
    ("stuffed", """SELECT doc_id, job_id, term, n, ROW_NUMBER() OVER (PARTITION BY doc_id, job_id ORDER BY rank) - 1 AS sub FROM hits WHERE stuffed"""),
    ("allfind", f"""SELECT t.doc_id, t.job_id, f.ord, f.sub, f.id, f.severity, f.category, f.params FROM totals t JOIN docfind f ON f.doc_id = t.doc_id
        UNION ALL SELECT doc_id, job_id, 32, 0, 'keywords.jobShort', 'info', 'keywords', {kv(words='job_words')} FROM totals WHERE ready AND job_words < 40
        UNION ALL SELECT doc_id, job_id, 33, 0, 'language.mismatch', 'warning', 'keywords', {kv(resume='lang', job='job_lang')} FROM totals
          WHERE ready AND job_lang <> 'unknown' AND lang <> 'unknown' AND job_lang <> lang
        UNION ALL SELECT doc_id, job_id, 34, 0, 'keywords.match', CASE WHEN keyword_score >= 70 THEN 'pass' WHEN keyword_score >= 45 THEN 'warning' ELSE 'critical' END,
          'keywords', {kv(matched='n_matched', total='n_keywords', percent='keyword_score')} FROM totals WHERE ready AND keyword_score IS NOT NULL
        UNION ALL SELECT doc_id, job_id, 35, 0, 'keywords.missing', CASE WHEN keyword_score >= 70 THEN 'info' ELSE 'warning' END, 'keywords',
          {kv(terms='missing8')} FROM totals WHERE ready AND n_missing > 0
        UNION ALL SELECT doc_id, job_id, 36, sub, 'keywords.stuffing', 'warning', 'keywords', {kv(term='term', count='n')} FROM stuffed"""),
]


def query(ctes: list[tuple[str, str]], final: str) -> str:
    """Statement with the CTEs that ``final`` reaches."""
    import re

    known = dict(ctes)
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"\b[a-z_][a-z_0-9]*\b", sql)):
            if word in known and word not in needed:
                needed.add(word)
                visit(known[word])

    visit(final)
    listed = ", ".join(f"{name} AS ({sql})" for name, sql in ctes if name in needed)
    return f"WITH {listed} {final}" if listed else final


DOC = text_ctes("SELECT doc_id, text FROM documents")


def analysis_ctes(source: str) -> list[tuple[str, str]]:
    """Everything about documents from ``source``: doc_id, text, header_footer_text, l_tables, l_boxes, l_images, l_columns, l_pages, truncated."""
    return text_ctes(source) + contact_ctes("norm") + BROKEN + PII + CONTENT + SECTIONS + SCORES + FINDINGS


PLAIN = "{id} AS doc_id, {text} AS text, '' AS header_footer_text, 0 AS l_tables, 0 AS l_boxes, 0 AS l_images, false AS l_columns, CAST(NULL AS INTEGER) AS l_pages, false AS truncated"
DOC_ALL = analysis_ctes(f"SELECT {PLAIN.format(id='doc_id', text='text')} FROM documents")
RES = analysis_ctes(fx.SYNTH_RESUMES)
JOB = job_ctes()
ALL = RES + JOB + MATCH + TOTALS
