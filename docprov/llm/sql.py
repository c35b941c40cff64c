"""SQL that gives the rows of the operators' queries, where SQL can."""

from __future__ import annotations

from docprov.llm import annular, quality, wand
from docprov.llm.quality import Limits

WORD = r"[^\x20\x09-\x0D]+"


def _listed(values: set[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in sorted(values)) + ")"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def quality_sql(limits: Limits = Limits()) -> str:
    seps, nav, joining, closers = _listed(quality.SEPARATORS), _listed(quality.NAVIGATION), _listed(quality.JOINING), _quoted(r"[\"'”’»)\]]")
    phrase, ends = _quoted(quality.BOILERPLATE.pattern), _quoted(quality.SENTENCE.pattern)
    # Words of the sentences that hold a phrase; of a very long one, as many as lie beside its phrases at most.
    sentences = f"string_split(regexp_replace(line, '({ends})', '\\1' || chr(1), 'g'), chr(1))"
    marked = f"list_sum(list_transform(list_filter({sentences}, lambda s: regexp_matches(s, '{phrase}')), lambda s: CASE WHEN len(regexp_extract_all(s, '{WORD}')) <= {limits.long_sentence} THEN len(regexp_extract_all(s, '{WORD}')) ELSE {limits.short_line} * len(regexp_extract_all(s, '{phrase}')) END))"
    bare = f"list_transform(list_filter(w, lambda x: x NOT IN {seps}), lambda x: lower(trim(x, '.,:;!?')))"
    return f"""WITH lines AS (
  SELECT doc_id, pos, line, regexp_extract_all(line, '{WORD}') AS w FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
counted AS (SELECT *, len(w) AS n, length(array_to_string(w, '')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again,
  len(list_filter(w, lambda x: x IN {seps})) AS bars FROM lines WHERE len(w) > 0),
judged AS (SELECT *, again OR regexp_matches(line, '{phrase}') AND (n < {limits.short_line} OR {marked} > {limits.boilerplate}::DOUBLE * n)
  OR (bars >= 2 AND bars > {limits.separators}::DOUBLE * n)
  OR (n <= 8 AND len(list_filter({bare}, lambda x: x IN {nav})) > 0 AND len(list_filter({bare}, lambda x: x IN {nav} OR x IN {joining})) = len({bare}))
  OR (chars >= {limits.bare_marks} AND NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]'))
  OR (len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) >= 2 AND len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) > {limits.symbol_words}::DOUBLE * n)
  OR (len(list_filter(w, lambda x: regexp_matches(x, '!!{closers}*$'))) >= 2 AND len(list_filter(w, lambda x: regexp_matches(x, '!!{closers}*$'))) > {limits.symbol_words}::DOUBLE * n)
  OR (n >= 3 AND upper(line) = line AND length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) >= 10 AND length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) > {limits.upper_letters}::DOUBLE * length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')))
  AS fails FROM counted),
by_line AS (SELECT doc_id, sum(again::INT) AS dup, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost, sum(fails::INT) AS lost_lines FROM judged GROUP BY 1),
words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM words),
threes AS (SELECT *, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM places),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM threes WHERE c IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY 1),
based AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  coalesce(lost, 0)::BIGINT AS lost_chars, coalesce(lost_lines, 0)::BIGINT AS lost_lines FROM words LEFT JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words AS base_failed,
  NOT (n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_percent} * n_words) AND lost_chars <= {limits.lost_text}::DOUBLE * word_chars AS kept FROM based"""


def _either_case(words: list[str]) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words)


def secrets_sql() -> str:
    keys = _either_case(["password", "passwd", "secret", "token", "api"]).replace("[Aa][Pp][Ii]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
    rules = {
        "assign": (rf"""(?:{keys})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "len(g[i]) >= 6"),
        "access": (r"(AKIA[A-Z0-9]+)", "len(g[i]) >= 20"),
        "hex": (r"([0-9a-f]+)", "len(g[i]) >= 24"),
        "private_key": (r"(-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----)", "true"),
        "web_token": (r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", "true"),
        "service_token": (r"\b((?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}))", "true"),
    }
    # A match starts after the gaps up to it and the matches before it.
    found = " UNION ALL ".join(
        f"""SELECT doc_id, '{kind}' AS kind, {no} AS rank, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, length(m[i]) AS size
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', 1) AS g, string_split_regex(text, '{p}') AS gaps FROM t)) WHERE {test}"""
        for no, (kind, (p, test)) in enumerate(rules.items())
    )
    span = "kind || ':' || start || ':' || (start + size)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}),
by_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  string_agg({span}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({span}, ',' ORDER BY start, rank) AS every FROM found GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM t LEFT JOIN by_doc USING (doc_id)"""


def jaccard_sql(percent: int = 80) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    leads = ", ".join(f"lead(a, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS a{k}" for k in range(1, 5))
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS n FROM words),
shingles AS (SELECT DISTINCT doc_id, concat_ws(' ', a, a1, a2, a3, a4) AS g FROM (SELECT *, {leads} FROM places) WHERE a4 IS NOT NULL OR (i = 1 AND n < 5)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= {percent} * (p.n + q.n - m)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(lowest, doc_id)) AS component_id FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS lowest FROM reach GROUP BY 1) USING (doc_id)"""


def ranges_sql(cosine: float = 0.98) -> str:
    d = "list_dot_product"
    return f"""WITH RECURSIVE sound AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE {d}(x.v, y.v) >= {cosine}::DOUBLE * sqrt({d}(x.v, x.v)) * sqrt({d}(y.v, y.v))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(lowest, vec_id)) AS component_id, coalesce(lowest, vec_id) >= vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS lowest FROM reach GROUP BY 1) USING (vec_id)"""


def wand_sql(most: int = 50) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    of = lambda kept, table: f"SELECT {kept}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{wand.TERM}') AS w FROM {table}"
    return f"""WITH docs AS ({of("doc_id, row_number() OVER () AS doc_no", "documents")}), items AS ({of("item_id, row_number() OVER () AS item_no", "benchmark")}),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS documents, sum(len(w))::BIGINT AS words FROM docs),
tfs AS (SELECT doc_no, term, count(*) AS tf FROM (SELECT doc_no, unnest(w) AS term FROM docs) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM tfs GROUP BY 1), totals),
norms AS (SELECT doc_no, doc_id, 50 + (50 * len(w) * documents) // words AS m FROM docs, totals WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_no, item_id, unnest(w) AS term FROM items),
scores AS (SELECT item_no, item_id, doc_no, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN norms USING (doc_no) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {most}"""


def annular_sql(shape: annular.Shape = annular.Shape()) -> str:
    """For vectors of one length and distinct ids, as the given tables hold them."""
    p, e = shape.parts, shape.entries
    distance = "(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))"  # exact: whole numbers
    near = lambda k: f"near{k} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(e, {distance} * {e} + e) AS e, min({distance}) AS d FROM parts JOIN book{k} USING (part) GROUP BY 1, 2)"
    rounds = "".join(
        f"""{near(k)},
mean{k} AS (SELECT part, e, list(v ORDER BY i) AS c FROM (SELECT part, e, i, floor(sum(v) / count(*)) AS v FROM (SELECT part, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, e)),
"""
        for k in range(shape.rounds)
    )
    last = shape.rounds
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {shape.scale})) AS q FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // {p}) + 1 : (part + 1) * (len(q) // {p})] AS x FROM kept, (SELECT unnest(range({p})) AS part)),
book0 AS MATERIALIZED (SELECT part, e, x AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {e}) JOIN parts USING (vec_id)),
{rounds}{near(last)},
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{last} GROUP BY 1),
told AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM book{last})),
labelled AS (SELECT vec_id, label, code, error FROM codes JOIN kept USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM labelled, told"""


SQL = {"op2_quality": quality_sql(), "op5_secrets": secrets_sql(), "op6_embeddings": ranges_sql(), "op9_jaccard": jaccard_sql(), "op12_wand": wand_sql(), "op13_annular": annular_sql()}
