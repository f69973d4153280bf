"""The chunker as registered queries, with its folds as recursive SQL.

The SQL follows the definition step by step: header lines cut sections (s), small sections join the
one before (m; a header that ends the text is its own body), what is too large falls into paragraphs, sentences or words (a: atoms in runs), runs are filled
greedily (g, recursive), and the pieces of a section are packed with the overlap of the last words (p, recursive).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.text import js_trim
from .operators import chunking
from .queries import ORACLES, _t, query

_WS = "[\\s\\x0B\\x{00A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"CAST(ceil(length({x}) / 4.0) AS INTEGER)"


def chunks_sql(markdown: str) -> str:
    """DuckDB SQL for the chunks of ``markdown``, a query with doc_id and text."""
    header = f"regexp_full_match(line, '#{{2,3}}{_WS}+[^\\n\\r\\x{{2028}}\\x{{2029}}]+')"
    most, least, words = chunking.MAX_TOKENS, chunking.MIN_TOKENS, chunking.OVERLAP_WORDS
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM ({markdown}) WHERE regexp_matches(text, '[^\\s\\x0B\\x{{00A0}}\\x{{FEFF}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')),
l AS (SELECT rid, i, ls[i] AS line FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM d), unnest(range(1, len(ls) + 1)) AS u(i)),
h AS (SELECT *, max(i) OVER (PARTITION BY rid) AS lines, {header} AS head, sum(CASE WHEN {header} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM l),
c AS (SELECT rid, sec, max(sec) OVER (PARTITION BY rid) AS secs, coalesce({_trim("string_agg(line, chr(10) ORDER BY i) FILTER (NOT head)")}, {_trim("any_value(line) FILTER (i = lines)")}) AS content, any_value(line) FILTER (head) AS head FROM h GROUP BY rid, sec),
s AS (SELECT rid, sec, CASE WHEN secs = 0 THEN 'Document' WHEN sec = 0 THEN 'Introduction' ELSE {_trim(f"regexp_replace(head, '^#{{2,3}}{_WS}+', '')")} END AS title, content FROM c WHERE content <> ''),
b AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR {_tokens('content')} >= {least} THEN 1 ELSE 0 END AS begins FROM s WINDOW o AS (PARTITION BY rid ORDER BY sec)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY rid ORDER BY sec ROWS UNBOUNDED PRECEDING) AS grp FROM b),
m AS MATERIALIZED (SELECT rid, grp, any_value(title) FILTER (begins = 1) AS title, string_agg(content, chr(10) || chr(10) ORDER BY sec) AS content FROM n GROUP BY 1, 2),
para AS (SELECT rid, grp, i, {_trim('ps[i]')} AS para FROM (SELECT rid, grp, string_split_regex(content, '\\n\\n+') AS ps FROM m WHERE {_tokens('content')} > {most}), unnest(range(1, len(ps) + 1)) AS u(i)),
q AS (SELECT rid, grp, i, para, CASE WHEN {_tokens('para')} > {most} THEN list_filter(string_split(regexp_replace(para, '([.!?]){_WS}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) END AS ss FROM para WHERE para <> ''),
t AS (SELECT rid, grp, i, 0 AS j, para AS text, 'whole' AS kind FROM q WHERE ss IS NULL
  UNION ALL SELECT rid, grp, i, 0, para, 'words' FROM q WHERE len(ss) < 2
  UNION ALL SELECT rid, grp, i, j, ss[j], CASE WHEN {_tokens('ss[j]')} > {most} THEN 'words' ELSE 'sentence' END FROM q, unnest(range(1, len(ss) + 1)) AS u(j) WHERE len(ss) >= 2),
r AS (SELECT *, sum(CASE WHEN kind = 'sentence' AND before = 'sentence' THEN 0 ELSE 1 END) OVER (PARTITION BY rid, grp ORDER BY i, j ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(kind) OVER (PARTITION BY rid, grp, i ORDER BY j) AS before FROM t)),
a AS (SELECT rid, grp, run, text, {_tokens('text')} AS n, j AS o1, 0 AS o2 FROM r WHERE kind <> 'words'
  UNION ALL SELECT rid, grp, run, ws[k], {_tokens("ws[k] || ' '")}, j, k FROM (SELECT *, string_split_regex(text, '{_WS}+') AS ws FROM r WHERE kind = 'words'), unnest(range(1, len(ws) + 1)) AS u(k)),
x AS MATERIALIZED (SELECT rid, grp, run, text, n, row_number() OVER (PARTITION BY rid, grp, run ORDER BY o1, o2) AS k FROM a),
g(rid, grp, run, k, total, bin) AS (SELECT rid, grp, run, k, n, 1 FROM x WHERE k = 1
  UNION ALL SELECT x.rid, x.grp, x.run, x.k, CASE WHEN total + n > {most} THEN n ELSE total + n END, CASE WHEN total + n > {most} THEN bin + 1 ELSE bin END FROM g JOIN x ON x.rid = g.rid AND x.grp = g.grp AND x.run = g.run AND x.k = g.k + 1),
f AS (SELECT rid, grp, run, bin, string_agg(text, ' ' ORDER BY k) AS piece FROM g JOIN x USING (rid, grp, run, k) GROUP BY 1, 2, 3, 4),
e AS MATERIALIZED (SELECT rid, grp, piece, {_tokens('piece')} AS own, row_number() OVER (PARTITION BY rid, grp ORDER BY run, bin) AS k FROM f WHERE piece <> ''),
p(rid, grp, k, part, body, tokens, done, done_tokens) AS (SELECT rid, grp, k, 1, piece, own, CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER) FROM e WHERE k = 1
  UNION ALL SELECT rid, grp, k, CASE WHEN full_ THEN part + 1 ELSE part END, now, CASE WHEN full_ THEN {_tokens('now')} ELSE tokens + own END, CASE WHEN full_ THEN {_trim('body')} END, CASE WHEN full_ THEN tokens END
  FROM (SELECT e.rid, e.grp, e.k, part, body, tokens, own, tokens + own > {most} AS full_,
      CASE WHEN tokens + own > {most} THEN array_to_string(string_split_regex(body, '{_WS}+')[-{words}:], ' ') || chr(10) || chr(10) || piece ELSE body || chr(10) || chr(10) || piece END AS now
    FROM p JOIN e ON e.rid = p.rid AND e.grp = p.grp AND e.k = p.k + 1)),
z AS (SELECT rid, grp, part - 1 AS part, done AS content, done_tokens AS n FROM p WHERE done IS NOT NULL
  UNION ALL SELECT rid, grp, part, {_trim('body')}, {_tokens('body')} FROM p QUALIFY row_number() OVER (PARTITION BY rid, grp ORDER BY k DESC) = 1
  UNION ALL SELECT rid, grp, 1, content, {_tokens('content')} FROM m WHERE {_tokens('content')} <= {most})
SELECT doc_id, CASE WHEN part > 1 THEN title || ' (continued)' ELSE title END AS section_title, z.content, n AS token_count, CAST(row_number() OVER (PARTITION BY rid ORDER BY grp, part) - 1 AS INTEGER) AS chunk_index
FROM z JOIN m USING (rid, grp) JOIN d USING (rid)"""


ORACLES["chunk_documents"] = chunks_sql("SELECT doc_id, text FROM documents")

#: Lines of a document that are made headers of level 2 and 3, of so many lines each.
_EVERY, _H2, _H3 = 40, 3, 9
_MARKDOWN = f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN NOT regexp_matches(left(x, 40), '\\S') OR starts_with(x, '#') THEN x
WHEN (i - 1) % {_EVERY} = {_H2} THEN '## ' || left(x, 40) WHEN (i - 1) % {_EVERY} = {_H3} THEN '### ' || left(x, 40) ELSE x END), chr(10) || chr(10)) AS text FROM documents"""


@query(chunks_sql(_MARKDOWN))
def chunk_markdown(spark, sf):
    """Chunks of the documents as markdown: lines are paragraphs, and some lines are headers."""

    def line(x, i):
        plain = (js_trim(F.substring(x, 1, 40)) == "") | x.startswith("#")
        head = F.substring(x, 1, 40)
        return F.when(plain, x).when(i % _EVERY == _H2, F.concat(F.lit("## "), head)).when(i % _EVERY == _H3, F.concat(F.lit("### "), head)).otherwise(x)

    made = _t(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("text"))
    return chunking.chunk_documents(made, "doc_id", "text")
