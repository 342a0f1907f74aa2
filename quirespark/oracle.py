"""The same queries as DuckDB SQL, for those that SQL can express."""

from __future__ import annotations

from quirespark.functions import formats
from quirespark.functions.safety import _PRIVATE, _RESERVED, _UNSAFE
from quirespark.queries import NAMES, PATCHES, REFS, SAMPLES, STAMPS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cells = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {cells}) v({names}))"


def _map(table: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in table.items())}}}"


_TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT id::BIGINT, text FROM {_values(SAMPLES, 'id, text')})"
_LINES = "string_split({}, chr(10))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00A0}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{3000}}]+$', '', 'g')"


def _squash(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace({x}, '[\\r\\n]', ' ', 'g'), '[ \\t\\x{{00A0}}\\x{{3000}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


def _block(x: str) -> str:
    # RE2 has no look-ahead: the space behind a token is taken along and put back.
    return f"regexp_replace(regexp_replace({x}, '(?m)^( {{0,3}})(#{{1,6}} |[-*+] |\\d+[.)] )', '\\1\\\\\\2', 'g'), '(?m)^( {{0,3}})(>|```|~~~|\\|)', '\\1\\\\\\2', 'g')".replace("{{", "{").replace("}}", "}")


def _entities(x: str) -> str:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {_q(name)}, {_q(sign)})"
    return x


def _inner(tag: str) -> str:
    return _squash(_entities(f"regexp_replace(regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1), '<[^>]+>', '', 'g')"))


_TITLE = f"coalesce(nullif({_inner('h1')}, ''), {_inner('title')})"
_TAGS = "regexp_extract_all(html, '<\\s*([A-Za-z_][\\w.:-]*)', 1)"
_ITEM = "'^\\s{0,3}(?:\\d+[.)]|[-*+])\\s+\\S'"
_THREE = "'(?m)(?:^\\s{0,3}(?:\\d+[.)]|[-*+])[ \\t]+\\S.*(?:\\n|$)){3}'"


def _count(text: str, mark: str) -> str:
    return f"(length({text}) - length(replace({text}, {mark}, '')))"


def _fits(mark: str) -> str:
    n = f"list_transform(ls, lambda x: {_count('x', mark)})"
    return f"(list_min({n}) >= 1 AND list_max({n}) - list_min({n}) <= greatest(1.0, list_max({n}) * 0.34))"


def _score(mark: str) -> str:
    n = f"list_transform(ls, lambda x: {_count('x', mark)})"
    return f"CASE WHEN list_min({n}) >= 1 THEN list_sum({n}) / len({n})::DOUBLE - (list_max({n}) - list_min({n})) END"


_MARKS = [(_q(","), 0), ("chr(9)", 1), (_q(";"), 2), (_q("|"), 3), (_q(":"), 4)]
_JUDGED = """(SELECT d.doc_id, source, lang, text, list_filter([
  CASE WHEN quality = 0 THEN {'code': 'legacy-format-lossy', 'severity': 'warning', 'r': 1} END,
  CASE WHEN toxic = 1 THEN {'code': 'encoding-uncertain', 'severity': 'warning', 'r': 1} END,
  CASE WHEN NOT contains(text, chr(10)) THEN {'code': 'no-headings', 'severity': 'info', 'r': 2} END,
  CASE WHEN length(text) < 100 THEN {'code': 'empty-document', 'severity': 'error', 'r': 0} END], lambda w: w IS NOT NULL) AS warnings,
  CASE WHEN length(text) < 100 THEN 'empty' WHEN quality = 0 OR toxic = 1 THEN 'partial' ELSE 'ok' END AS status, d.doc_id % 10 = 0 AS skipped
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_CODES = "array_to_string(list_sort(list_distinct(list_transform(list_filter(warnings, lambda w: w.severity <> 'info'), lambda w: w.code))), '{}')"
_SIGNED = "CASE " + " ".join(f"WHEN starts_with(lower(hex(encode(substr(text, 1, 16)))), '{m}') THEN '{k}'" for m, k in formats.SIGNATURES) + " ELSE 'none' END"


#: What is to be registered, stated here and not taken from the registry: format, converter, priority, needed module.
_READERS = """
    archive zip-listing 10
    code source-code 10
    csv delimited 10
    diff diff-patch 10
    doc_legacy ole-doc 20
    docx python-docx 10 docx
    docx ooxml-stdlib 90
    email eml 10
    epub epub 10
    fb2 fb2 10
    html html 10
    image image-metadata 50
    ini config-ini 10
    json json 10
    jsonl jsonl 10
    markdown markdown-passthrough 10
    mobi mobi-unsupported 10
    msg_legacy ole-msg 20
    notebook jupyter 10
    odf odf 10
    pdf pymupdf 10 fitz
    pdf pdf-plaintext 80 pypdf
    ppt_legacy ole-ppt 20
    pptx python-pptx 10 pptx
    pptx ooxml-stdlib 90
    rtf rtf 20
    subtitle subtitle 10
    svg svg 10
    text plain-text 10
    toml config-toml 10
    unsupported_binary binary-unsupported 10
    unsupported_format unknown-unsupported 10
    unsupported_media media-unsupported 10
    unsupported_parquet parquet-unsupported 10
    xls_legacy ole-xls 20
    xlsx openpyxl 10 openpyxl
    xlsx xlsx-stdlib 90
    xml xml 10
    yaml config-yaml 10 yaml
    yaml config-yaml-raw 90
"""


def _readers() -> list[tuple]:
    rows = [line.split() for line in _READERS.strip().splitlines()]
    return [(r[0], r[1], int(r[2]), r[3] if len(r) > 3 else "") for r in rows]


def _page_markdown() -> str:
    """The sample pages' Markdown by regular expressions: head, navigation and comments go, a
    bold text ends at its line break, and what is between block tags is a paragraph."""
    bare = "regexp_replace(regexp_replace(html, '(?is)<head>.*?</head>|<nav>.*?</nav>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?s)<h1>(.*?)</h1>', '<p># \\1<p>', 'g')"
    bold = f"regexp_replace({bare}, '(?s)<b>(.*?)<br>', '**\\1**<p>', 'g')"
    text = _squash(_entities("x"))
    blocks = f"list_filter(list_transform(string_split_regex({bold}, '</?(?:p|div|footer|article|body|html)\\b[^>]*>'), lambda x: {text}), lambda x: x <> '')"
    return f"array_to_string({blocks}, chr(10) || chr(10)) || chr(10)"


def _clock(x: str) -> str:
    s = f"floor({x})::BIGINT"
    return f"CASE WHEN {x} IS NULL THEN '' ELSE lpad(({s} // 3600)::VARCHAR, greatest(2, length(({s} // 3600)::VARCHAR))::INT, '0') || ':' || lpad(({s} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0') END"


_STAMP = "'(\\d{1,2}):(\\d{2}):(\\d{2})[.,](\\d{1,3})'"
_SECONDS = f"""CASE WHEN regexp_matches(stamp, {_STAMP}) THEN regexp_extract(stamp, {_STAMP}, 1)::INT * 3600 + regexp_extract(stamp, {_STAMP}, 2)::INT * 60
 + regexp_extract(stamp, {_STAMP}, 3)::INT + regexp_extract(stamp, {_STAMP}, 4)::INT / pow(10.0::DOUBLE, length(regexp_extract(stamp, {_STAMP}, 4))) END"""
_URLS = [(u,) for u in ("http://localhost/x", "https://10.0.0.1/", "ftp://x.test/", "https://ok.test/a?b", "http://192.168.1.1", "https://user@172.20.0.1:80/", "nonsense", "https://10.example.com")]
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(\\[[^\\]]*\\]|[^:/?#]*)', 1))"
_BASE = "regexp_replace(replace(name, chr(92), '/'), '^.*/', '')"
_CLEAN = f"regexp_replace(regexp_replace({_BASE}, {_q(_UNSAFE)}, '_', 'g'), '^[\\s.]+|[\\s.]+$', '', 'g')"
_NAMES = _values([(n,) for n in NAMES], "name")
_EXT = "regexp_extract(lower(regexp_replace(replace(name, chr(92), '/'), '^.*/', '')), '^.+(\\.[^.]+)$', 1)"

SQL: dict[str, str] = {
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_tag_topk": f"SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGS}) AS tag FROM pages) GROUP BY tag ORDER BY n DESC, tag LIMIT 15",
    "html_tag_totals": f"SELECT page_id, len({_TAGS}) AS elements, len(list_distinct({_TAGS})) AS distinct_tags, {_TAGS}[1] AS root FROM pages",
    "html_chrome_counts": "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(lower(html), '<{t}[\\s>]')) AS {t}" for t in ("nav", "footer", "header", "aside")) + " FROM pages",
    "html_markdown": f"SELECT page_id, url, {_TITLE} AS title, {_page_markdown()} AS markdown, len(regexp_extract_all(html, '<h[1-6][\\s>]')) AS headings, 0::BIGINT AS links, 'ok' AS status, 'html' AS converter FROM pages",
    "html_conversion_facts": f"SELECT page_id, {_TITLE} AS title, len(regexp_extract_all(html, '<h[1-6][\\s>]')) AS headings, 0::BIGINT AS links, 'ok' AS status, false AS leaks_script FROM pages",
    "link_counts": "SELECT page_id, len(regexp_extract_all(html, 'href=\"https?://')) AS external, len(regexp_extract_all(html, 'href=\"https?://')) > 50 AS link_heavy FROM pages",
    "url_guard": f"""SELECT url, coalesce(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND {_HOST} <> '' AND NOT regexp_matches({_HOST}, {_q(_PRIVATE)}), false) AS allowed
      FROM (SELECT url FROM pages UNION ALL SELECT url FROM {_values(_URLS, 'url')})""",
    "safe_file_names": f"""WITH n AS (SELECT name FROM {_NAMES} UNION ALL SELECT url || '.html' FROM pages), c AS (SELECT name, {_CLEAN} AS clean FROM n),
      e AS (SELECT *, regexp_extract(clean, '^.+(\\.[^.]*)$', 1) AS ext FROM c), s AS (SELECT *, substr(clean, 1, length(clean) - length(ext)) AS stem FROM e)
      SELECT name, CASE WHEN clean = '' THEN 'untitled' ELSE substr(CASE WHEN lower(stem) IN ({', '.join(_q(r) for r in sorted(_RESERVED))}) THEN stem || '_' ELSE stem END, 1, greatest(120 - length(ext), 1)) || ext END AS safe FROM s""",
    "archive_guard": """SELECT *, expanded > 4294967296 OR (packed > 0 AND expanded / packed::DOUBLE > 200) AS bomb FROM
      (SELECT l_orderkey, l_linenumber, trunc(l_quantity)::BIGINT AS packed, trunc(l_extendedprice)::BIGINT AS expanded FROM lineitem)""",
    "detect_format": f"""WITH t AS (SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents
        UNION ALL SELECT 'event', event_id, props FROM events UNION ALL SELECT 'sample', id, text FROM {_values(SAMPLES, 'id, text')}),
      u AS (SELECT *, lower(substr(text, 1, 2048)) AS head, regexp_replace(text, '^\\s+', '') AS cut,
        list_slice(list_filter({_LINES.format('text')}, lambda x: trim(x) <> ''), 1, 12) AS ls FROM t)
      SELECT kind, id, CASE WHEN regexp_matches(head, '<!doctype html|<html|<head|<body') OR len(regexp_extract_all(head, '<(?:h[1-6]|li|ul|table|span|div|a|p)[\\s>]')) >= 3 THEN 'html'
        WHEN substr(cut, 1, 1) IN ('{{', '[') AND (json_valid(cut) OR regexp_matches(cut, '^[{{\\[]\\s*["}}\\]{{]')) THEN 'json'
        WHEN len(ls) >= 2 AND ({' OR '.join(_fits(m) for m, _ in _MARKS[:4])}) THEN 'csv'
        WHEN regexp_matches(text, '(?m)^#{{1,6}}\\s+\\S') THEN 'markdown' ELSE 'text' END AS format FROM u""",
    "name_lookup": f"""WITH n AS (SELECT name, {_EXT} AS ext, lower(regexp_replace(replace(name, chr(92), '/'), '^.*/', '')) AS base FROM {_NAMES}),
      k AS (SELECT *, coalesce({_map(formats.EXTENSIONS)}[ext], {_map(formats.NAMES)}[base]) AS format FROM n)
      SELECT name, ext, format, coalesce({_map(formats.MEDIA_TYPES)}[format], {_q(formats.FALLBACK_MEDIA)}) AS media_type, coalesce({_map(formats.LANGUAGES)}[ext], '') AS language FROM k""",
    "signatures": f"""SELECT doc_id, {_SIGNED} AS signature FROM documents UNION ALL SELECT id::BIGINT, s FROM
      {_values([(-1, 'pdf'), (-2, 'zip'), (-3, 'image'), (-4, 'rtf'), (-5, 'none')], 'id, s')}""",
    "delimiter_profile": f"""WITH t AS (SELECT doc_id, list_filter({_LINES.format('text')}, lambda x: trim(x) <> '') AS al FROM {_TEXTS}),
      s AS (SELECT *, list_slice(al, 1, 20) AS ls FROM t), r AS (SELECT *, [{', '.join(_score(m) for m, _ in _MARKS)}] AS sc FROM s),
      m AS (SELECT *, CASE WHEN list_max(sc) IS NULL THEN ',' ELSE [{', '.join(m for m, _ in _MARKS)}][list_position(sc, list_max(sc))] END AS mark FROM r),
      w AS (SELECT *, list_transform(al, lambda x: {_count('x', 'mark')} + 1) AS ws FROM m)
      SELECT doc_id, mark, coalesce(list_max(ws), 0) AS width, len(list_filter(ws, lambda v: v <> list_max(ws))) AS ragged FROM w""",
    "text_squash": f"SELECT doc_id, md5(s) AS squashed, length(s) AS n, len({_LINES.format('text')}) AS lines FROM (SELECT *, {_squash('text')} AS s FROM {_TEXTS})",
    "escape_inline": f"SELECT doc_id, md5(e) AS digest, length(e) - length(text) AS escapes FROM (SELECT *, regexp_replace(text, '([\\\\`*_{{}}\\[\\]<>|])', '\\\\\\1', 'g') AS e FROM {_TEXTS})",
    "escape_block_lines": f"SELECT doc_id, md5(e) AS digest, length(e) - length(text) AS escapes FROM (SELECT *, {_block('text')} AS e FROM {_TEXTS})",
    "escape_structure": f"""SELECT doc_id, md5(array_to_string(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda b: array_to_string(list_transform({_LINES.format('b')},
      lambda x: regexp_replace(CASE WHEN regexp_matches(b, {_THREE}) AND regexp_matches(x, {_ITEM}) THEN x ELSE {_block('x')} END, '\\s+$', '')), chr(10))), chr(10) || chr(10))) AS digest FROM {_TEXTS}""",
    "paragraphs": f"""SELECT doc_id, len(list_filter(bs, lambda b: trim(b) <> '')) AS blocks, md5(array_to_string(list_filter(list_transform(bs,
      lambda b: regexp_replace(regexp_replace(b, '(?m)[ \\t\\r]+$', '', 'g'), '^\\n+|\\n+$', '', 'g')), lambda b: trim(b) <> ''), chr(10) || chr(10))) AS digest
      FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS bs FROM {_TEXTS})""",
    "fence_length": f"""WITH r AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) AS run FROM {_TEXTS}),
      t AS (SELECT *, repeat('`', CASE WHEN run >= 3 THEN run + 1 ELSE 3 END::BIGINT) AS ticks FROM r)
      SELECT doc_id, run, ticks || 'text' AS opening, md5(ticks || chr(10) || regexp_replace(text, '^\\n+|\\n+$', '', 'g') || chr(10) || ticks) AS digest FROM t""",
    "heading_outline": f"""SELECT doc_id, len(h) AS headings, array_to_string(list_transform(h, lambda x: length(x)::VARCHAR), ',') AS levels, coalesce(list_min(list_transform(h, lambda x: length(x))) = 1, false) AS has_top
      FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^(#{{1,6}})\\s+\\S', 1) AS h FROM {_TEXTS})""",
    "underlined_titles": f"""WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS line, unnest(range(len({_LINES.format('text')}))) AS n FROM {_TEXTS}),
      p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS below FROM l)
      SELECT t.doc_id, count(p.n) AS promoted FROM {_TEXTS} t LEFT JOIN p ON p.doc_id = t.doc_id AND trim(line) <> '' AND length(trim(line)) <= 120 AND regexp_matches(trim(line), '[^=\\-*_ ]')
        AND regexp_matches(below, '^\\s*(={{3,}}|-{{3,}}|\\*{{3,}}|_{{3,}})\\s*$') GROUP BY t.doc_id""",
    "list_runs": f"""WITH l AS (SELECT doc_id, unnest({_LINES.format('text')}) AS line, unnest(range(len({_LINES.format('text')}))) AS n FROM {_TEXTS}),
      i AS (SELECT doc_id, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l WHERE regexp_matches(line, {_ITEM})),
      r AS (SELECT doc_id, island, count(*) AS run FROM i GROUP BY doc_id, island) SELECT doc_id, max(run) AS longest FROM r GROUP BY doc_id""",
    "front_matter_fields": f"""SELECT doc_id, CASE WHEN fm = '' THEN '' ELSE regexp_extract(fm, '(?m)^title: "?(.*?)"?$', 1) END AS title, CASE WHEN fm = '' THEN '' ELSE regexp_extract(fm, '(?m)^author: "?(.*?)"?$', 1) END AS author
      FROM (SELECT doc_id, regexp_extract(text, '^---\\s*\\n(?s:(.*?))\\n---\\s*\\n?', 1) AS fm FROM {_TEXTS})""",
    "quote_and_details": """SELECT n_nationkey, '> ' || n_name || chr(10) || '>' || chr(10) || '> <' || n_name || '>' AS quote,
      '<details>' || chr(10) || '<summary>A &amp; &lt;' || n_name || '&gt;</summary>' || chr(10) || chr(10) || n_name || chr(10) || chr(10) || '<' || n_name || '>' || chr(10) || chr(10) || '</details>' AS details,
      '![(' || n_name || ')](a.png)' AS image, '[' || n_name || '](' || n_name || ')' AS link FROM nation""",
    "nation_lists": """SELECT n_regionkey, string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS bullets, string_agg(i || '. ' || n_name, chr(10) ORDER BY n_name) AS numbers
      FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY n_regionkey""",
    "stamps": f"SELECT stamp, {_SECONDS} AS seconds, {_clock(f'({_SECONDS})')} AS clock FROM {_values([(s,) for s in STAMPS], 'stamp')}",
    "event_clock": f"SELECT event_id, {_clock('value')} AS clock FROM events",
    "patch_stats": f"""SELECT id::BIGINT AS id, len(list_distinct(list_filter(regexp_extract_all(text, '(?m)^(?:\\+\\+\\+|---)\\s+([^\\t\\n]+)', 1), lambda n: n <> '/dev/null'))) AS files,
      len(list_filter({_LINES.format('text')}, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))) AS added,
      len(list_filter({_LINES.format('text')}, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS removed FROM {_values(PATCHES, 'id, text')}""",
    "sheet_columns": f"""SELECT ref, coalesce((SELECT sum((ascii(substr(l, i::INT, 1)) - 64) * pow(26, length(l) - i)) FROM range(1, length(l) + 1) r(i)), 0)::BIGINT - 1 AS at
      FROM (SELECT ref, upper(regexp_extract(ref, '^([A-Za-z]*)', 1)) AS l FROM {_values([(r,) for r in REFS], 'ref')})""",
    "pipe_table_rows": "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || r_name || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey",
    "region_tables": """SELECT n_regionkey, '| Key | Name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey::VARCHAR) AS markdown
      FROM nation GROUP BY n_regionkey""",
    "part_facts": """SELECT p_partkey, '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Name | ' || replace(p_name, '|', '\\|') || ' |' || chr(10)
      || CASE WHEN p_size > 25 THEN '| Brand | ' || p_brand || ' |' || chr(10) ELSE '' END || '| Size | ' || p_size || ' |' AS markdown FROM part""",
    "rendered_values": """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS l_quantity,
      CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END AS large FROM lineitem""",
    "sheet_preview": """SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 200""",
    "order_sheets": "SELECT rows, count(*) AS orders, rows > 4 AS too_large FROM (SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1) GROUP BY rows",
    "size_levels": """WITH p AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)
      SELECT p_size, n, least(dense_rank() OVER (ORDER BY p_size DESC), 6) AS level, p_size = first_value(p_size) OVER (ORDER BY n DESC, p_size) AS body FROM p""",
    "json_fields": "SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
    "json_shape": """SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' END AS root_type, len(json_keys(props)) AS keys,
      array_to_string(json_keys(props), ', ') AS names FROM events""",
    "jsonl_validity": """SELECT event_type, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad
      FROM (SELECT event_type, json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END) AS good FROM events) GROUP BY event_type""",
    "json_paths": "SELECT path, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS path FROM events) GROUP BY path",
    "transcripts": f"""SELECT conv_id, md5('# Conversation ' || conv_id || chr(10) || chr(10) || {_strip("string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn, role, text)")} || chr(10)) AS digest,
      count(*) AS turns FROM conversations GROUP BY conv_id""",
    "document_front_matter": f"""WITH r AS (SELECT d.doc_id, source, lang, quality, substr({_squash("string_split(text, chr(10))[1]")}, 1, 200) AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
      SELECT doc_id, '---' || chr(10) || 'source: ' || source || chr(10) || CASE WHEN title = '' THEN '' ELSE 'title: ' ||
        CASE WHEN regexp_matches(title, '[:#\\[\\]{{}}&*!|>''"%@`]') OR lower(title) IN ('true', 'false', 'null', 'yes', 'no') THEN '"' || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '"' ELSE title END || chr(10) END
        || 'language: ' || lang || chr(10) || CASE WHEN quality = 0 THEN 'fidelity: partial' || chr(10) ELSE '' END || '---' AS front_matter FROM r""",
    "status_rollup": f"""SELECT source, count(*) AS total, count(*) FILTER (WHERE NOT skipped AND status = 'ok') AS converted, count(*) FILTER (WHERE NOT skipped AND status = 'partial') AS partial,
      count(*) FILTER (WHERE NOT skipped AND status = 'empty') AS empty, count(*) FILTER (WHERE NOT skipped AND status = 'failed') AS failed, count(*) FILTER (WHERE skipped) AS skipped FROM {_JUDGED} GROUP BY source""",
    "warning_rollup": f"""SELECT w.severity AS severity, w.code AS code, count(*) AS n, count(DISTINCT doc_id) AS sources FROM (SELECT doc_id, unnest(warnings) AS w FROM {_JUDGED}) GROUP BY ALL""",
    "warning_codes": f"""SELECT doc_id, {_CODES.format(',')} AS codes, array_to_string(list_transform(list_sort(list_transform(warnings, lambda w: {{'r': w.r, 'c': w.code}})), lambda x: x.c), ',') AS ordered FROM {_JUDGED}""",
    "output_collisions": "SELECT '/out/' || source || '/' || (length(text) % 500) || '.md' AS output, count(*) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1",
    "skip_existing": "SELECT doc_id, sha1(text) AS output FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = 'src0' AND sha1(e.text) = sha1(d.text))",
    "asset_dedup": """WITH a AS (SELECT source, doc_id AS pos, 'asset-' || doc_id % 7 AS stem, sha1(text) AS sha1 FROM documents),
      b AS (SELECT *, row_number() OVER w = 1 AS first, first_value(stem) OVER w AS s FROM a WINDOW w AS (PARTITION BY source, sha1 ORDER BY pos)),
      c AS (SELECT *, first_value(sha1) OVER (PARTITION BY source, s ORDER BY first DESC, pos) AS owner FROM b)
      SELECT source, pos, sha1, CASE WHEN owner = sha1 THEN s ELSE s || '-' || substr(sha1, 1, 8) END || '.txt' AS file, first FROM c""",
    "written_assets": """WITH a AS (SELECT doc_id, source, sha1(text) AS h, 'image' || doc_id % 5 AS stem, lpad(doc_id::VARCHAR, 12, '0') AS k FROM documents),
      b AS (SELECT *, row_number() OVER w = 1 AS first, first_value(stem) OVER w AS s FROM a WINDOW w AS (PARTITION BY source, h ORDER BY k)),
      c AS (SELECT *, first_value(h) OVER (PARTITION BY source, s ORDER BY first DESC, k) AS owner FROM b),
      f AS (SELECT *, CASE WHEN owner = h THEN s ELSE s || '-' || substr(h, 1, 8) END || '.png' AS file FROM c)
      SELECT doc_id, source || '/' || file AS file, 'see ![x](assets/' || file || ')' AS markdown, h AS sha1 FROM f""",
    "batch_report": f"SELECT doc_id::VARCHAR AS at, '| ' || doc_id || ' | text | ' || status || ' | plain-text | 1 ms | ' || {_CODES.format(', ')} || ' |' AS line FROM {_JUDGED}",
    "walk_filter": """SELECT page_id, '/in/web/' || page_id || '.html' AS path FROM pages WHERE page_id % 5 <> 0 AND page_id % 2 = 0 AND NOT contains(page_id::VARCHAR, '1')""",
    "formats_without_reader": f"SELECT f AS format FROM {_values([(k,) for k in sorted({*formats.EXTENSIONS.values()})], 'f')} EXCEPT SELECT f FROM {_values(sorted({(r[0],) for r in _readers()}), 'f')}",
    "readers": f"SELECT format, converter, priority::BIGINT AS priority, requires FROM {_values(_readers(), 'format, converter, priority, requires')}",
    "readers_by_format": f"SELECT format, count(*) AS n, string_agg(converter, ', ' ORDER BY converter) AS converters FROM {_values(_readers(), 'format, converter, priority, requires')} GROUP BY format",
    "event_files": "SELECT 'user-' || user_id || '.jsonl' AS name, 'jsonl' AS format, count(*) AS records, 'ok' AS status, 'jsonl' AS converter FROM events GROUP BY user_id",
}
