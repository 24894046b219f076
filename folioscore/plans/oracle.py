"""SQL over the given tables with the results the queries must have.

Written for a second engine, from table definitions rather than from the Spark
plans. Regular expressions there know no Unicode classes of Java, so white space
is spelled out.
"""

from __future__ import annotations

import re

from folioscore.functions.normalize import STRIP_GROUPS, WS, WS_IN_LINE
from folioscore.operators.registry import IMAGE_PROMPT, LIMIT_FIELD, PAGE_POLICY, PARSERS
from folioscore.operators.registry import PDF_PROMPT, SENDS_TOP_K
from folioscore.operators.render import HTML_GROUPS, HTML_HEAD, HTML_TAIL
from folioscore.plans.catalog import SYSTEM_TEXT
from folioscore.sources.files import DEFAULT_PARSERS

SPACE = r"[\s\v\x1c-\x1f\x{85}\pZ]"
SPACE_IN_LINE = r"[\t\r\f\v\x1c-\x1f\x{85}\pZ]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else _q(v)

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


def _re2(pattern: str) -> str:
    """The same pattern in the other engine's syntax."""
    head = ""
    for flags in ("(?dUm)", "(?U)", "(?d)", "(?s)"):
        if pattern.startswith(flags):
            pattern = pattern[len(flags) :]
            head = "(?m)" if "m" in flags else "(?s)" if "s" in flags else ""
    pattern = pattern.replace(WS_IN_LINE, SPACE_IN_LINE).replace(WS, SPACE)
    pattern = pattern.replace(r"[-:|\s\x1c-\x1f]", r"[-:|\s\v\x1c-\x1f\x{85}\pZ]")
    pattern = pattern.replace(
        r"[^\p{L}\p{N}_\s\x1c-\x1f]", r"[^\pL\pN_\s\v\x1c-\x1f\x{85}\pZ]"
    )
    return head + pattern.replace(r"\d", r"\p{Nd}")


def _substitute(column: str, rules) -> str:
    for pattern, replacement in rules:
        new = replacement.replace("$1", r"\1").replace("$2", r"\2")
        column = f"regexp_replace({column}, {_q(_re2(pattern))}, {_q(new)}, 'g')"
    return column


def _flat(groups):
    return [rule for _, rules in groups for rule in rules]


def _strip(column: str) -> str:
    return f"trim({_substitute(column, _flat(STRIP_GROUPS))})"


def _dressed(text: str, key: str) -> str:
    parts = [
        _q("# Title "), key, _q("\n\n**bold words** and *slanted* ~~gone~~ `code`\n\n"),
        _q("- first item\n- second_item_here\n\n1. one\n2. two\n\n> quoted line\n\n"),
        _q("[link "), key, _q("](https://example.com/a)\n\n"),
        _q("| Name | Value |\n|------|-------|\n| key | "), key, _q(" |\n\n"),
        text,
        _q("\n\n$$E = mc^2$$ and $x$ and \\(y\\) \\alpha\\frac{a}{b} \\pivot &amp; \\% done\n\n"),
        key, _q("\n\nTable of Contents\n\n---\n"),
    ]
    return " || ".join(f"CAST({p} AS VARCHAR)" if p == key else p for p in parts)


_REG = f"reg(pos, parser, model) AS ({_values((i, p[0], p[1]) for i, p in enumerate(PARSERS))})"
_DOC = "'conv' || conv_id"

VARIANTS = f"""{_REG},
v AS (
  SELECT {_DOC} AS filestem, CAST(turn AS INTEGER) AS ord, parser,
         CASE WHEN model = '' THEN '' ELSE model || '-' END || 't' || turn AS model,
         {_DOC} || '_' || parser || '_' || CASE WHEN model = '' THEN '' ELSE model || '-' END
           || 't' || turn || '.md' AS file, text
  FROM conversations JOIN reg ON pos = turn % 8
)"""
_ORDER = "(a.ord < b.ord OR (a.ord = b.ord AND a.file <= b.file))"
PAIRS = f"""p AS (
  SELECT a.filestem, a.file AS file1, b.file AS file2, a.ord AS ord1, b.ord AS ord2,
         a.text AS t1, b.text AS t2
  FROM v a JOIN v b ON a.filestem = b.filestem AND {_ORDER}
)"""


def _words(text: str) -> str:
    return (
        f"list_distinct(list_filter(string_split_regex(lower({text}), {_q(SPACE + '+')}), "
        "lambda x: x <> ''))"
    )


def _rouge_words(text: str) -> str:
    stops = "[." + SPACE[1:] + "+"
    return f"list_filter(string_split_regex({text}, {_q(stops)}), lambda x: x <> '')"


_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

WORDS = f"""w AS (SELECT *, {_words('text')} AS ws FROM v),
o AS (
  SELECT a.filestem, a.file AS file1, b.file AS file2, a.ord AS ord1, b.ord AS ord2,
         a.ws AS w1, b.ws AS w2,
         len(a.ws) AS n1, len(b.ws) AS n2, len(list_intersect(a.ws, b.ws)) AS n
  FROM w a JOIN w b ON a.filestem = b.filestem AND {_ORDER}
)"""
_OVERLAP = "round(CASE WHEN n1 + n2 - n > 0 THEN n / (n1 + n2 - n) ELSE 0 END::DOUBLE, 6)"

COSINE = f"""tok AS (
  SELECT filestem, file, ord, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) AS t FROM v
),
tf AS (SELECT filestem, file, ord, t, count(*) AS n FROM tok GROUP BY ALL),
q AS (SELECT filestem, file, sum(n * n) AS q FROM tf GROUP BY ALL),
s AS (
  SELECT a.filestem, a.file AS file1, b.file AS file2,
         sum(a.n * b.n) AS dot, sum(a.n * a.n) AS s1, sum(b.n * b.n) AS s2
  FROM tf a JOIN tf b ON a.filestem = b.filestem AND a.t = b.t AND {_ORDER}
  GROUP BY ALL
),
k AS (SELECT (ln(1.5) + 1) * (ln(1.5) + 1) AS k2),
c AS (
  SELECT p.filestem, p.file1, p.file2, p.ord1, p.ord2,
         round(coalesce(dot / (sqrt(k2 * (q1.q - s1) + s1) * sqrt(k2 * (q2.q - s2) + s2)), 0)
               ::DOUBLE, 6) AS cosine
  FROM p CROSS JOIN k
  LEFT JOIN s ON s.filestem = p.filestem AND s.file1 = p.file1 AND s.file2 = p.file2
  LEFT JOIN q q1 ON q1.filestem = p.filestem AND q1.file = p.file1
  LEFT JOIN q q2 ON q2.filestem = p.filestem AND q2.file = p.file2
)"""

ROUGE = f"""rw AS (SELECT filestem, file, ord, {_rouge_words('text')} AS w FROM v),
g AS (SELECT filestem, file, ord, w, list_distinct(w) AS u, {_BIGRAMS} AS b FROM rw),
m AS (
  SELECT a.filestem, a.file AS file1, b.file AS file2, a.ord AS ord1, b.ord AS ord2,
         a.w AS w1, b.w AS w2,
         len(list_intersect(a.u, b.u)) AS ou, len(a.u) AS u1, len(b.u) AS u2,
         len(list_intersect(a.b, b.b)) AS ob, len(a.b) AS b1, len(b.b) AS b2
  FROM g a JOIN g b ON a.filestem = b.filestem AND {_ORDER}
)"""


def _f(both: str, n1: str, n2: str) -> str:
    p, r = f"({both} / {n1})", f"({both} / {n2})"
    return (
        f"round((CASE WHEN {n1} > 0 AND {n2} > 0 THEN 2 * {p} * {r} / ({p} + {r} + 1e-8) "
        "ELSE 0 END)::DOUBLE, 6)"
    )


def _lcs(name: str, units: str) -> str:
    """Length of the longest common subsequence of the two lists of every pair.

    Per text, each distinct unit has a bit for every place it stands at, in blocks
    of 60 places; per pair the masks of the second list's units are folded, in
    order, into a row of bits in which every step of the common subsequence turns
    one bit off.
    """
    full = (1 << 60) - 1
    pair = "lambda k: [rows[k], masks[k]]"
    carried = "(b[1] + (b[1] & b[2]) + acc[1])"
    block = f"(({carried} & {full}) | xor(b[1], b[1] & b[2]))"
    return f"""{name}_u AS (SELECT filestem, file, ord, {units} AS units FROM v),
{name}_at AS (SELECT filestem, file, unnest(units) AS u, generate_subscripts(units, 1) - 1 AS i FROM {name}_u),
{name}_mask AS (SELECT filestem, file, u, i // 60 AS blk, sum(1::BIGINT << (i % 60)::INTEGER)::BIGINT AS mask
  FROM {name}_at GROUP BY ALL),
{name}_all AS (
  SELECT t.filestem, t.file, s.u, list(coalesce(m.mask, 0) ORDER BY g.blk) AS masks
  FROM (SELECT filestem, file, (len(units) + 59) // 60 AS blocks FROM {name}_u) t
  JOIN (SELECT DISTINCT filestem, file, u FROM {name}_at) s USING (filestem, file)
  JOIN LATERAL (SELECT unnest(range(blocks)) AS blk) g ON true
  LEFT JOIN {name}_mask m ON m.filestem = t.filestem AND m.file = t.file AND m.u = s.u AND m.blk = g.blk
  GROUP BY ALL),
{name}_map AS (SELECT filestem, file, map(list(u), list(masks)) AS at FROM {name}_all GROUP BY ALL),
{name} AS (
  SELECT a.filestem, a.file AS file1, b.file AS file2, a.ord AS ord1, b.ord AS ord2,
    len(a.units) AS n1, len(b.units) AS n2,
    CASE WHEN a.units = b.units THEN len(a.units)
         WHEN len(a.units) = 0 OR len(b.units) = 0 THEN 0
         ELSE 60 * ((len(a.units) + 59) // 60) - list_sum(list_transform(list_reduce(
           list_filter(list_transform(b.units, lambda u: m.at[u]), lambda x: x IS NOT NULL),
           lambda rows, masks: list_reduce(
             list_transform(range(1, len(rows) + 1), {pair}),
             lambda acc, b: list_concat([{carried} >> 60], acc[2:], [{block}]),
             [0::BIGINT])[2:],
           list_transform(range((len(a.units) + 59) // 60), lambda k: {full}::BIGINT)
         ), lambda r: bit_count(r)::BIGINT)) END AS lcs
  FROM {name}_u a JOIN {name}_u b ON a.filestem = b.filestem AND {_ORDER}
  LEFT JOIN {name}_map m ON m.filestem = a.filestem AND m.file = a.file)"""


LCS_CHARS = _lcs("lc", "list_filter(string_split(text, ''), lambda x: x <> '')")
LCS_WORDS = _lcs("lw", _rouge_words("text"))
_RATIO = "round(CASE WHEN n1 + n2 > 0 THEN 2.0 * lcs / (n1 + n2) ELSE 1 END::DOUBLE, 6)"
_ALL = f"{VARIANTS}, {PAIRS}, {WORDS}, {COSINE}, {ROUGE}, {LCS_CHARS}, {LCS_WORDS}"
_SIX = f"""six AS (
  SELECT o.filestem, o.file1, o.file2, o.n1 AS words_1, o.n2 AS words_2, o.n AS common,
         {_OVERLAP.replace('n1', 'o.n1').replace('n2', 'o.n2').replace('- n ', '- o.n ').replace('THEN n ', 'THEN o.n ').replace('- n)', '- o.n)')} AS word_overlap,
         {_RATIO.replace('n1', 'lc.n1').replace('n2', 'lc.n2').replace('* lcs', '* lc.lcs')} AS levenshtein, cosine,
         {_f('ou', 'u1', 'u2')} AS rouge_1, {_f('ob', 'b1', 'b2')} AS rouge_2,
         {_f('lw.lcs', 'lw.n1', 'lw.n2')} AS rouge_l
  FROM o JOIN c USING (filestem, file1, file2) JOIN m USING (filestem, file1, file2)
  JOIN lc USING (filestem, file1, file2) JOIN lw USING (filestem, file1, file2)
)"""

_LONG = f"""{_ALL},
l AS (
  SELECT filestem, 0 AS metric_pos, 'word_overlap' AS "Metric", file1 AS "File1",
         file2 AS "File2", {_OVERLAP} AS "Value", ord1, ord2 FROM o
  UNION ALL SELECT filestem, 1, 'levenshtein', file1, file2, {_RATIO}, ord1, ord2 FROM lc
  UNION ALL SELECT filestem, 2, 'cosine', file1, file2, cosine, ord1, ord2 FROM c
  UNION ALL SELECT filestem, 3, 'rouge-1', file1, file2, {_f('ou', 'u1', 'u2')}, ord1, ord2 FROM m
  UNION ALL SELECT filestem, 4, 'rouge-2', file1, file2, {_f('ob', 'b1', 'b2')}, ord1, ord2 FROM m
  UNION ALL SELECT filestem, 5, 'rouge-l', file1, file2, {_f('lcs', 'n1', 'n2')}, ord1, ord2 FROM lw
)"""

_JOBS = f"""names(pos, name) AS ({_values(enumerate([p[0] for p in PARSERS] + ["markitdown", "pandoc"]))}),
jobs AS (
  SELECT doc_id, name AS parser,
         CASE lang WHEN 'en' THEN NULL WHEN 'de' THEN '' WHEN 'fr' THEN 'gpt-4o'
              ELSE 'gemini-1.5-flash' END AS model
  FROM documents JOIN names ON pos = CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 10
),
known(parser, model) AS ({_values((p[0], m) for p in PARSERS for m in (p[2] or ("",)))}),
{_REG},
verdicts AS (
  SELECT jobs.doc_id, jobs.parser, jobs.model,
         coalesce(nullif(jobs.model, ''), reg.model) AS runs,
         CASE WHEN reg.parser IS NULL THEN 'unsupported parser'
              WHEN known.parser IS NULL THEN 'unsupported model' END AS reason
  FROM jobs LEFT JOIN reg ON reg.parser = jobs.parser
  LEFT JOIN known ON known.parser = jobs.parser
       AND known.model = coalesce(nullif(jobs.model, ''), reg.model)
)"""
_SUFFIX = "CASE lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN '.PDF' WHEN 'fr' THEN '.txt' ELSE '.pdf' END"
_PATH = f"'in/' || source || '/doc.' || doc_id || {_SUFFIX}"

_PAGES = f"pg AS (SELECT {_DOC} AS doc_id, CAST(turn + 1 AS INTEGER) AS page_no, text, role FROM conversations)"
_TRIMMED = r"regexp_replace(regexp_replace(text, '^\n+', ''), '\n+\z', '')"
_CONVERTED = f"""{_PAGES},
r AS (
  SELECT doc_id, page_no,
         CASE WHEN contains(text, 'ß') THEN NULL ELSE '## ' || text END AS markdown,
         CASE WHEN contains(text, 'ß') THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN contains(text, 'ß') THEN 'unreadable letter' END AS error,
         CAST(CASE WHEN contains(text, 'ç') THEN 2 ELSE 1 END AS INTEGER) AS attempts
  FROM pg
)"""
_CHUNKS = f"""WITH {_PAGES}
SELECT doc_id, page_no, text AS markdown FROM pg"""

_LIMITS = {p[0]: p[5] for p in PARSERS}


def _limit(field: str) -> str:
    rows = [(p, _LIMITS[p]) for p, f in LIMIT_FIELD.items() if f == field]
    cases = " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in rows)
    return f"CASE parser {cases} END AS r_{field}"


def _in(names) -> str:
    return "(" + ", ".join(_q(n) for n in names) + ")"


_CHAT = f"parser IN {_in(LIMIT_FIELD)}"
_ALWAYS = [p for p, v in PAGE_POLICY.items() if v == "always"]
_ASKED = [p for p, v in PAGE_POLICY.items() if v == "if asked"]

# Letters outside ASCII of the texts, each given a control character, because
# the other engine counts edits over bytes.
_LETTERS = "äöüßÄÖÜéèêçáíóúñÉÈÊÇÁÍÓÚÑ"
_BYTES = "".join(chr(c) for c in (*range(1, 9), *range(14, 32)))[: len(_LETTERS)]


def _bytes(text: str) -> str:
    return f"translate({text}, {_q(_LETTERS)}, {_q(_BYTES)})"


def _exact(sql: str) -> str:
    """The same scores, not rounded to six places."""
    return re.sub(r"::DOUBLE, 6\)", "::DOUBLE, 16)", sql)


def _four(score: str) -> str:
    """A score to four places, halves rounded up."""
    return f"printf('%.4f', floor({score} * 10000 + 0.5) / 10000)"


def _label(file: str) -> str:
    """What stands after the first underscore of a file's name, without its ending."""
    base = f"string_split({file}, '/')[-1]"
    return (
        f"regexp_replace(CASE WHEN contains({base}, '_') THEN {base}[position('_' IN {base}) + 1:] "
        f"ELSE {base} END, '\\.md$', '')"
    )


def _headings(column: str) -> str:
    for n in range(1, 7):
        column = f"regexp_replace({column}, '<h{n}(\\s[^>]*)?>', chr(10) || chr(10) || '{'#' * n} ', 'g')"
        column = f"regexp_replace({column}, '</h{n}>', chr(10) || chr(10), 'g')"
    return column


def _by_parser(sql: str) -> str:
    """The same over files, which know the place of their parser and not their turn."""
    return sql.replace("CAST(turn AS INTEGER) AS ord", "CAST(turn % 8 AS INTEGER) AS ord")


def _metric_sql(prelude: str, value: str, source: str, name: str) -> str:
    return f"WITH {prelude} SELECT filestem, file1, file2, {value} AS {name} FROM {source}"


ORACLE: dict[str, str] = {
    "variant_pairs": f"WITH {VARIANTS}, {PAIRS} SELECT filestem, file1, file2 FROM p",
    "tiled_pairs": f"WITH {VARIANTS}, {PAIRS} SELECT filestem, file1, file2 FROM p",
    "word_overlap": _metric_sql(f"{VARIANTS}, {WORDS}", _OVERLAP, "o", "word_overlap"),
    "word_stats": f"""WITH {VARIANTS}, {WORDS}
SELECT filestem, file1, file2, n1 AS words_1, n2 AS words_2, n AS common,
       n1 - n AS only_1, n2 - n AS only_2 FROM o""",
    "word_differences": f"""WITH {VARIANTS}, {WORDS}
SELECT filestem, file1, file2,
       array_to_string(list_sort(list_filter(w1, lambda x: NOT list_contains(w2, x))), ' ') AS only_in_1,
       array_to_string(list_sort(list_filter(w2, lambda x: NOT list_contains(w1, x))), ' ') AS only_in_2
FROM o""",
    "tfidf_cosine": f"WITH {VARIANTS}, {PAIRS}, {COSINE} SELECT filestem, file1, file2, cosine FROM c",
    "rouge_1": _metric_sql(f"{VARIANTS}, {ROUGE}", _f("ou", "u1", "u2"), "m", "rouge_1"),
    "rouge_2": _metric_sql(f"{VARIANTS}, {ROUGE}", _f("ob", "b1", "b2"), "m", "rouge_2"),
    "rouge_l": _metric_sql(f"{VARIANTS}, {LCS_WORDS}", _f("lcs", "n1", "n2"), "lw", "rouge_l"),
    "levenshtein_ratio": _metric_sql(f"{VARIANTS}, {LCS_CHARS}", _RATIO, "lc", "levenshtein"),
    "evaluate_pairs": f"""WITH {_ALL}, {_SIX}
SELECT filestem, file1, file2, word_overlap, levenshtein, cosine, rouge_1, rouge_2, rouge_l FROM six""",
    "evaluation_report": f"""WITH {_exact(_ALL)}, {_exact(_SIX)},
labelled AS (SELECT *, {_label('file1')} AS one, {_label('file2')} AS two FROM six)
SELECT filestem, file1, file2, 'Evaluation Results: ' || one || ' vs ' || two AS title,
  'Cosine Similarity: ' || {_four('cosine')} || E'\\n' || 'Word Overlap Ratio: ' || {_four('word_overlap')} || E'\\n'
  || 'Levenshtein Ratio: ' || {_four('levenshtein')} || E'\\n' || 'ROUGE-1 Score: ' || {_four('rouge_1')} || E'\\n'
  || 'ROUGE-2 Score: ' || {_four('rouge_2')} || E'\\n' || 'ROUGE-L Score: ' || {_four('rouge_l')} || E'\\n'
  || 'Words in ' || one || ': ' || words_1 || E'\\n' || 'Words in ' || two || ': ' || words_2 || E'\\n'
  || 'Common words: ' || common || E'\\n' || 'Unique to ' || one || ': ' || (words_1 - common) || E'\\n'
  || 'Unique to ' || two || ': ' || (words_2 - common) AS report
FROM labelled""",
    "levenshtein_distance": f"""WITH {VARIANTS}, {PAIRS}
SELECT filestem, file1, file2, levenshtein({_bytes('t1')}, {_bytes('t2')}) AS distance FROM p""",
    "strip_then_overlap": f"""WITH {VARIANTS.replace('AS file, text', 'AS file, ' + _dressed('text', 'turn') + ' AS text')},
both_modes AS (
  SELECT 'with Markdown' AS mode, filestem, ord, file, text FROM v
  UNION ALL SELECT 'stripped', filestem, ord, file, {_strip('text')} FROM v
),
w AS (SELECT *, {_words('text')} AS ws FROM both_modes),
o AS (
  SELECT a.mode, a.filestem, a.file AS file1, b.file AS file2,
         len(a.ws) AS n1, len(b.ws) AS n2, len(list_intersect(a.ws, b.ws)) AS n
  FROM w a JOIN w b ON a.mode = b.mode AND a.filestem = b.filestem AND {_ORDER}
)
SELECT mode, filestem, file1, file2, {_OVERLAP} AS word_overlap FROM o""",
    "metrics_long": f"""WITH {_LONG}
SELECT filestem, metric_pos, "Metric", "File1", "File2", "Value" FROM l""",
    "similarity_matrix": f"""WITH {_LONG},
cells AS (
  SELECT filestem, "Metric", "File1" AS "File", "File2" AS other, ord2 AS ord, "Value" FROM l
  UNION ALL SELECT filestem, "Metric", "File2", "File1", ord1, "Value" FROM l WHERE "File1" <> "File2"
),
placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY filestem, "Metric" ORDER BY ord, other) - 1 AS k FROM cells
)
SELECT filestem, "Metric", "File", string_agg(other, ' ' ORDER BY k) AS columns,
       string_agg(CAST(round("Value" * 1e6) AS BIGINT)::VARCHAR, ' ' ORDER BY k) AS "values"
FROM placed GROUP BY filestem, "Metric", "File" """,
    "rank_against_checked": f"""WITH {_LONG},
checked AS (SELECT filestem, arg_min(file, ord) AS checked FROM v GROUP BY filestem),
scored AS (
  SELECT l.filestem, "Metric", checked,
         CASE WHEN "File1" = checked THEN "File2" ELSE "File1" END AS file, "Value"
  FROM l JOIN checked ON checked.filestem = l.filestem
  WHERE "File1" <> "File2" AND checked IN ("File1", "File2")
)
SELECT *, rank() OVER (PARTITION BY filestem, "Metric" ORDER BY "Value" DESC) AS rank FROM scored""",
    "metrics_csv": f"""WITH {_LONG} SELECT "Metric", "File1", "File2", "Value" FROM l""",
    "saved_markdown": f"""WITH {VARIANTS}
SELECT filestem, parser, model, {_dressed('text', 'ord')} AS markdown FROM v""",
    "variant_files": f"""WITH {_by_parser(VARIANTS)}
SELECT filestem, parser, file, ord, md5(text) AS digest FROM v""",
    "evaluate_files": f"""WITH {_by_parser(_LONG)}
SELECT filestem, "Metric", "File1", "File2", "Value" FROM l""",
    "strip_markdown": f"""WITH d AS (SELECT doc_id, {_dressed('text', 'doc_id')} AS text FROM documents)
SELECT doc_id, {_strip('text')} AS text FROM d""",
    "strip_plain_documents": f"SELECT doc_id, {_strip('text')} AS text FROM documents",
    "truncate_for_rouge": """SELECT doc_id, least(length(text), 10000) AS chars,
       md5(substring(text, 1, 10000)) AS digest FROM documents""",
    "tfidf_terms": """WITH tok AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{2,}')) AS t FROM documents
), tf AS (SELECT doc_id, t, count(*) AS n FROM tok GROUP BY ALL),
per AS (SELECT doc_id, count(*) AS terms, sum(n * n)::BIGINT AS square_sum,
        md5(string_agg(t || ':' || n, ' ' ORDER BY t)) AS digest FROM tf GROUP BY doc_id)
SELECT d.doc_id, coalesce(terms, 0) AS terms, coalesce(square_sum, 0) AS square_sum,
       coalesce(digest, md5('')) AS digest
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id""",
    "overlap_words": f"""WITH w AS (SELECT doc_id, {_words('text')} AS ws FROM documents)
SELECT doc_id, len(ws) AS words, md5(array_to_string(list_sort(ws), ' ')) AS digest FROM w""",
    "rouge_ngrams": f"""WITH rw AS (SELECT doc_id, {_rouge_words('text')} AS w FROM documents),
g AS (SELECT doc_id, w, list_distinct(w) AS u, {_BIGRAMS} AS b FROM rw)
SELECT doc_id, len(w) AS words, len(u) AS unigrams, len(b) AS bigrams,
       md5(array_to_string(w, ' ')) AS digest_words,
       md5(array_to_string(list_sort(b), ' ')) AS digest_bigrams FROM g""",
    "find_variants": f"""WITH {VARIANTS},
asked(ord, parser) AS ({_values(enumerate(DEFAULT_PARSERS))}),
hits AS (
  SELECT v.filestem, v.file, min(asked.ord) AS ord
  FROM v JOIN asked ON starts_with(v.file, v.filestem || '_' || asked.parser)
  GROUP BY ALL
)
SELECT filestem, hits.ord, parser, file FROM hits JOIN asked ON asked.ord = hits.ord""",
    "output_names": f"""WITH {_JOBS}
SELECT doc_id, 'doc.' || doc_id || '_' || parser
       || CASE WHEN coalesce(model, '') = '' THEN '' ELSE '_' || model END || '.md' AS file
FROM jobs""",
    "variant_labels": f"""WITH {VARIANTS}
SELECT file, regexp_replace(
  CASE WHEN contains(base, '_') THEN base[position('_' IN base) + 1:] ELSE base END,
  '\\.md$', '') AS label
FROM (SELECT file, string_split(file, '/')[-1] AS base FROM v)""",
    "axis_labels": f"""WITH {VARIANTS}
SELECT file, array_to_string(
  parts[-least(CASE WHEN contains(file, 'textract') THEN 1 ELSE 2 END, len(parts)):], '_') AS label
FROM (SELECT file, string_split(replace('output/' || file, '.md', ''), '_') AS parts FROM v)""",
    "validate_inputs": f"""SELECT d.doc_id, {_PATH.replace('doc_id', 'd.doc_id')} AS path,
  CASE WHEN l.doc_id IS NULL THEN 'missing'
       WHEN l.toxic <> 0 THEN 'not a file'
       WHEN lang = 'fr' THEN 'wrong suffix' ELSE 'ok' END AS verdict
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "encode_payload": """SELECT page_id,
  'data:application/pdf;base64,' || to_base64(encode(html)) AS payload FROM pages""",
    "registry": f"""WITH {_JOBS},
facts(parser, model, position, is_default, credential, medium, max_tokens, page_policy) AS ({_values(
    (p[0], m, i, m == p[1], p[3], p[4], p[5], PAGE_POLICY[p[0]])
    for p in PARSERS for i, m in enumerate(p[2] or ("",))
)}),
used AS (SELECT parser, runs, count(*) AS jobs FROM verdicts WHERE reason IS NULL GROUP BY ALL)
SELECT facts.*, coalesce(used.jobs, 0) AS jobs
FROM facts LEFT JOIN used ON used.parser = facts.parser AND used.runs = facts.model""",
    "list_registry": f"""WITH {_JOBS},
listed(parser, models, default_model) AS ({_values((p[0], ", ".join(p[2]), p[1]) for p in PARSERS)}),
asked AS (SELECT parser, count(*) AS n FROM jobs GROUP BY parser)
SELECT listed.*, coalesce(n, 0) AS jobs FROM listed LEFT JOIN asked ON asked.parser = listed.parser""",
    "resolve_jobs": f"WITH {_JOBS} SELECT doc_id, parser, runs AS model FROM verdicts WHERE reason IS NULL",
    "rejected_jobs": f"WITH {_JOBS} SELECT doc_id, parser, model, reason FROM verdicts WHERE reason IS NOT NULL",
    "build_requests": f"""WITH {_JOBS}
SELECT d.doc_id, 0 AS page_no, parser, nullif(runs, '') AS r_model,
  CASE WHEN {_CHAT} THEN {_q(SYSTEM_TEXT)} END AS r_system,
  CASE WHEN {_CHAT} THEN CASE parser WHEN 'huggingface' THEN {_q(IMAGE_PROMPT)}
       ELSE {_q(PDF_PROMPT)} END END AS r_prompt,
  CASE WHEN {_CHAT} THEN '0.1' END AS r_temperature,
  CASE WHEN {_CHAT} THEN '0.1' END AS r_top_p,
  CASE WHEN parser IN {_in(SENDS_TOP_K)} THEN '40' END AS r_top_k,
  {", ".join(_limit(f) for f in dict.fromkeys(LIMIT_FIELD.values()))},
  md5(CASE parser WHEN 'openai' THEN 'data:application/pdf;base64,'
      WHEN 'huggingface' THEN 'data:image/png;base64,' ELSE '' END
      || to_base64(encode(text))) AS r_payload
FROM verdicts JOIN documents d ON d.doc_id = verdicts.doc_id WHERE reason IS NULL""",
    "split_pages": f"""WITH {_PAGES}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS INTEGER) AS page_no,
       {_TRIMMED} AS page_text FROM pg""",
    "page_count": f"WITH {_PAGES} SELECT doc_id, count(*) AS pages FROM pg GROUP BY doc_id",
    "plan_units": f"""WITH {_PAGES}, {_REG},
whole AS (
  SELECT doc_id, count(*) AS n, string_agg('###### Page ' || page_no || E'\\n\\n' || text
         || E'\\n\\n', '' ORDER BY page_no) AS text FROM pg GROUP BY doc_id
),
planned AS (
  SELECT doc_id, parser, text,
         parser IN {_in(_ALWAYS)} OR (n > 1 AND parser IN {_in(_ASKED)}) AS split
  FROM whole JOIN reg ON pos = length(text) % 8
)
SELECT doc_id, parser, 0 AS page_no, text AS unit_text FROM planned WHERE NOT split
UNION ALL
SELECT pg.doc_id, parser,
       CAST(row_number() OVER (PARTITION BY pg.doc_id ORDER BY page_no) AS INTEGER),
       {_TRIMMED.replace('text', 'pg.text', 1)}
FROM planned JOIN pg ON pg.doc_id = planned.doc_id WHERE split""",
    "assemble_terminated": f"""WITH {_PAGES}
SELECT doc_id, string_agg(text || E'\\n\\n', '' ORDER BY page_no) AS markdown FROM pg GROUP BY doc_id""",
    "assemble_joined": f"""WITH {_PAGES}
SELECT doc_id, string_agg(text, E'\\n\\n' ORDER BY page_no) AS markdown FROM pg GROUP BY doc_id""",
    "assemble_chunks": _CHUNKS,
    "assemble_good": f"""WITH {_CONVERTED}
SELECT doc_id, string_agg(markdown || E'\\n\\n', '' ORDER BY page_no) AS markdown
FROM r GROUP BY doc_id HAVING bool_and(status <> 'error')""",
    "convert_units": f"WITH {_CONVERTED} SELECT * FROM r",
    "check_responses": f"""WITH {_PAGES}, {_REG},
a AS (
  SELECT doc_id, page_no, parser,
         CASE role WHEN 'system' THEN '' WHEN 'user' THEN NULL ELSE text END AS markdown
  FROM pg JOIN reg ON pos = (page_no - 1) % 8
)
SELECT doc_id, page_no, parser,
  CASE WHEN parser = 'unstructuredio' THEN coalesce(markdown, '') ELSE markdown END AS markdown,
  CASE WHEN parser IN ('openai', 'ollama') AND coalesce(markdown, '') = '' THEN 'error'
       WHEN parser = 'unstructuredio' AND markdown IS NULL THEN 'warning' ELSE 'ok' END AS status,
  CASE WHEN parser IN ('openai', 'ollama') AND coalesce(markdown, '') = ''
       THEN 'Empty response from ' || parser END AS error
FROM a""",
    "extract_answers": f"""WITH {_PAGES}, {_REG},
a AS (
  SELECT doc_id, page_no, parser, (page_no - 1) % 5 = 4 AS broken, role = 'user' AS nothing,
         CASE WHEN role = 'user' THEN '' WHEN role = 'system' THEN ''
              WHEN parser = 'unstructuredio' THEN {_substitute("(" + _q(HTML_HEAD + "<p>") + " || text || " + _q("</p>" + chr(10) + HTML_TAIL) + ")", _flat(HTML_GROUPS))}
              ELSE text END AS said
  FROM pg JOIN reg ON pos = (page_no - 1) % 8
),
j AS (
  SELECT *, CASE WHEN broken THEN 'unreadable'
    WHEN nothing AND parser NOT IN ('huggingface', 'mistral') THEN 'no answer'
    WHEN said = '' THEN 'empty' ELSE 'ok' END AS verdict FROM a
),
k AS (
  SELECT *, CASE WHEN verdict = 'no answer' AND parser = 'unstructuredio' THEN 'warning'
    WHEN verdict IN ('unreadable', 'no answer') OR (verdict = 'empty' AND parser IN ('openai', 'ollama'))
    THEN 'error' ELSE 'ok' END AS status FROM j
)
SELECT doc_id, page_no, parser, CASE WHEN status <> 'error' THEN said END AS markdown, verdict, status,
  CASE WHEN status = 'ok' THEN NULL WHEN verdict = 'unreadable' THEN 'Unreadable response from ' || parser
    WHEN verdict = 'no answer' THEN 'No answer in the response from ' || parser
    ELSE 'Empty response from ' || parser END AS error
FROM k""",
    "document_status": f"""WITH {_CONVERTED}
SELECT doc_id, count(*) AS pages, count(*) FILTER (status = 'error') AS failed,
       min(page_no) FILTER (status = 'error') AS first_failed_page,
       arg_min(error, page_no) FILTER (status = 'error') AS first_error,
       CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'quarantined' ELSE 'ok' END AS status
FROM r GROUP BY doc_id""",
    "elements_to_html": f"""WITH pieces AS (
  SELECT page_id, unnest(string_split(html, '</p>')) AS t,
         generate_subscripts(string_split(html, '</p>'), 1) AS seq FROM pages
)
SELECT CAST(page_id AS VARCHAR) AS doc_id, {_q(HTML_HEAD)}
  || coalesce(string_agg(t || E'</p>\\n', '' ORDER BY seq) FILTER (contains(t, '<p>')), '')
  || {_q(HTML_TAIL)} AS html
FROM pieces GROUP BY page_id""",
    "html_to_markdown": f"SELECT page_id, {_substitute('html', _flat(HTML_GROUPS))} AS markdown FROM pages",
    "html_to_markdown_nested": f"""WITH a AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?s)<!--.*?-->', '', 'g'), '(?is)<head(\\s[^>]*)?>.*?</head\\s*>', '', 'g'),
    '(?is)<script(\\s[^>]*)?>.*?</script\\s*>', '', 'g'), '(?is)<style(\\s[^>]*)?>.*?</style\\s*>', '', 'g') AS t FROM pages
),
b AS (SELECT page_id, regexp_replace(t, '[\\s\\v]+', ' ', 'g') AS t FROM a),
c AS (
  -- in the given pages emphasis holds no tags, so one that is closed is closed at the next tag
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t,
    '<(b|strong)(\\s[^>]*)?>([^<]*[^< ][^<]*)</(b|strong)>', '**\\3**', 'g'),
    '<(i|em)(\\s[^>]*)?>([^<]*[^< ][^<]*)</(i|em)>', '*\\3*', 'g'),
    '<a\\s[^>]*?href="([^"]+)"[^>]*>([^<]*[^< ][^<]*)</a>', '[\\2](\\1)', 'g') AS t FROM b
),
d AS (SELECT page_id, {_headings('t')} AS t FROM c),
e AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '<br\\s*/?>', chr(10), 'g'), '<li(\\s[^>]*)?>', chr(10) || '* ', 'g'),
    '</?(ul|ol|p|div|table|article|section|nav|header|footer|body|html|blockquote)(\\s[^>]*)?>', chr(10) || chr(10), 'g'),
    '</?[a-zA-Z][^>]*>', '', 'g') AS t FROM d
),
f AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(\\S) {{2,}}', '\\1 ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n ([^ ])', chr(10) || '\\1', 'g'),
    '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\n ]+', ''), '[\\n ]+$', '') AS t FROM e
)
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS markdown
FROM f""",
    "linearize_layout": """WITH rows_of AS (
  SELECT l_orderkey, CAST(l_suppkey AS INTEGER) AS page_no,
         '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' AS line,
         l_linenumber AS n, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_partkey AS k
  FROM lineitem
), pages_of AS (
  SELECT l_orderkey, page_no, string_agg(line, E'\\n' ORDER BY n, cents, k, line) AS body
  FROM rows_of GROUP BY ALL
)
SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, page_no,
  CASE WHEN o_orderkey IS NULL THEN body ELSE
  '# Order ' || l_orderkey || E'\\n\\n## Status ' || o_orderstatus || E'\\n\\n' || body
  || E'\\n\\nPriority ' || o_orderpriority END AS page_text
FROM pages_of LEFT JOIN orders ON o_orderkey = l_orderkey""",
    "reading_order": """WITH lines AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc_id, l_linenumber AS n,
    l_linenumber || ' ' || l_partkey || ' ' || l_suppkey || ' ' || CAST(round(l_extendedprice * 100) AS BIGINT) AS text
  FROM lineitem
),
parts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 0 AS part, 0 AS n, 'Order ' || o_orderkey AS text FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 3, 0, 'Note ' || o_orderpriority FROM orders
  UNION ALL SELECT doc_id, 2 - n % 2, n, text FROM lines
)
SELECT doc_id, 1 AS page_no, string_agg(text, chr(10) || chr(10) ORDER BY part, n, text) AS page_text
FROM parts GROUP BY doc_id""",
    "stream_chunks": _CHUNKS,
    "stream_responses": f"""WITH {_PAGES}
SELECT doc_id, page_no, 'complete' AS status, text AS markdown FROM pg""",
    "stream_evaluate": f"""WITH {_ALL}, {_SIX}
SELECT filestem, file1, file2, word_overlap, levenshtein, cosine, rouge_1, rouge_2, rouge_l FROM six""",
}
