"""DuckDB SQL for the registered queries: the same results by another engine, written from the definitions."""

from __future__ import annotations

from turnstone.functions.rules import LATIN_EXACT, LATIN_TAGS, TermRules
from turnstone.operators import answering, audit, calibration
from turnstone.plans import queries

TOKEN = r"[A-Za-z]+[A-Za-z0-9]*|\p{Nd}+(?:\.\p{Nd}+)?|[가-힣]+"


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def terms(name: str, table: str, id_col: str, text: str = "text") -> str:
    """A CTE of the distinct exact terms (v) of each row (id)."""
    cases = " ".join(f"WHEN t LIKE '%{s}' THEN {len(s)}" for s in LATIN_EXACT.suffixes)
    return f"""
    {name}_t AS (SELECT DISTINCT id, t FROM (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS t FROM {table}) WHERE t NOT IN {_list(LATIN_EXACT.stopwords)}),
    {name}_s AS (SELECT id, t, CASE WHEN regexp_full_match(t, '[a-z]+') THEN CASE {cases} END END AS cut FROM {name}_t),
    {name} AS (SELECT DISTINCT id, v FROM (SELECT id, t AS v FROM {name}_t UNION ALL SELECT id, left(t, CAST(length(t) - cut AS INTEGER)) AS v FROM {name}_s WHERE cut IS NOT NULL AND length(t) - cut >= 2))"""


INDEX = (
    terms("dt", "documents", "doc_id")
    + """,
    post AS (SELECT id AS doc, 'w' || split_part(v, '.', 1) AS key, count(*) AS tf FROM dt GROUP BY ALL UNION ALL SELECT id, 'w' || v, 1 FROM dt WHERE v LIKE '%.%'),
    lens AS (SELECT d.doc_id AS doc, count(dt.v) + count(CASE WHEN dt.v LIKE '%.%' THEN 1 END) AS dl FROM documents d LEFT JOIN dt ON dt.id = d.doc_id GROUP BY 1),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens),
    dfs AS (SELECT key, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY 1)"""
)


def scored(queries: str, name: str = "sc") -> str:
    """A CTE of scores (q, doc, s) of a CTE of query terms (id, v)."""
    return f"""
    {name} AS (
        SELECT x.id AS q, p.doc, sum(
            CASE WHEN ln((st.n - f.df + 0.5) / (f.df + 0.5)) > 0 THEN ln((st.n - f.df + 0.5) / (f.df + 0.5)) ELSE CAST(0.000001 AS DOUBLE) END
            * CAST(5 AS DOUBLE) * p.tf * CAST(2.2 AS DOUBLE) / (CAST(5 AS DOUBLE) * p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l.dl / st.avgdl))) AS s
        FROM {queries} x JOIN post p ON p.key = 'w' || x.v JOIN dfs f ON f.key = p.key JOIN lens l ON l.doc = p.doc, st GROUP BY 1, 2)"""


RANKED = (
    "WITH " + INDEX + "," + terms("qt", "benchmark", "item_id") + "," + scored("qt")
    + ", rk AS (SELECT q, doc, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc) AS r, count(*) OVER (PARTITION BY q) AS c FROM sc), top AS (SELECT * FROM rk WHERE r <= 5)"
)
RELEVANT = "rel AS (SELECT b.item_id AS q, d.doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)), cnt AS (SELECT q, count(*) AS n FROM rel GROUP BY 1)"
METRICS = (
    RANKED + ", " + RELEVANT
    + """, ks AS (SELECT unnest([1, 3, 5]) AS k),
    hit AS (SELECT c.q, ks.k, c.n, count(t.r) AS h, coalesce(sum(1 / log2(t.r + 1)), 0) AS g, min(t.r) AS f
            FROM cnt c CROSS JOIN ks LEFT JOIN (SELECT top.* FROM top JOIN rel ON rel.q = top.q AND rel.doc = top.doc) t ON t.q = c.q AND t.r <= ks.k GROUP BY 1, 2, 3),
    met AS (SELECT q AS qid, k, CAST(h > 0 AS DOUBLE) AS hit, CAST(h AS DOUBLE) / k AS precision, CAST(h AS DOUBLE) / n AS recall, coalesce(CAST(1 AS DOUBLE) / f, 0) AS mrr,
            g / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) r(i) WHERE i <= least(n, k)) AS ndcg, f AS first_rank FROM hit)"""
)

# chunks of conversations: atoms of turns, pieces of turns, windows of pieces
CHUNKS = r"""
WITH RECURSIVE
    turns AS (SELECT conv_id AS c, turn AS t, role AS sp, trim(text, E' \n\t') AS txt, greatest(100, 700 - length(role) - 2) AS b FROM conversations),
    sent AS (SELECT c, t, sp, b, unnest(parts) AS s, unnest(range(len(parts))) AS k FROM (SELECT *, string_split(regexp_replace(txt, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM turns)),
    atom0 AS (SELECT c, t, sp, b, k, unnest(w) AS a, unnest(range(len(w))) AS j FROM (SELECT *, CASE WHEN length(trim(s, E' \n\t')) > b THEN regexp_split_to_array(trim(s, E' \n\t'), '\s+') ELSE [trim(s, E' \n\t')] END AS w FROM sent WHERE trim(s, E' \n\t') <> '')),
    atom AS (SELECT c, t, sp, b, a, row_number() OVER (PARTITION BY c, t ORDER BY k, j) AS i FROM atom0),
    fold AS (
        SELECT c, t, sp, b, i, a AS cur, 0 AS piece FROM atom WHERE i = 1
        UNION ALL
        SELECT f.c, f.t, f.sp, f.b, n.i, CASE WHEN length(f.cur) + 1 + length(n.a) <= f.b THEN f.cur || ' ' || n.a ELSE n.a END, CASE WHEN length(f.cur) + 1 + length(n.a) <= f.b THEN f.piece ELSE f.piece + 1 END
        FROM fold f JOIN atom n ON n.c = f.c AND n.t = f.t AND n.i = f.i + 1),
    piece AS (SELECT c, t, sp, piece, arg_max(cur, i) AS txt FROM fold GROUP BY ALL),
    unit AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, piece) - 1 AS u, length(sp) + length(txt) + 2 AS sz FROM piece),
    acc AS (SELECT *, sum(sz) OVER (PARTITION BY c ORDER BY u) AS pre, count(*) OVER (PARTITION BY c) AS n FROM unit),
    win AS (SELECT a.c, a.u AS first, max(z.u) + 1 AS stop, a.n FROM acc a JOIN acc z ON z.c = a.c AND z.u >= a.u AND (z.u = a.u OR z.pre - a.pre + a.sz + (z.u - a.u) <= 700) GROUP BY a.c, a.u, a.n),
    walk AS (
        SELECT c, first, stop, n, 0 AS x FROM win WHERE first = 0
        UNION ALL
        SELECT w.c, w.first, w.stop, w.n, k.x + 1 FROM walk k JOIN win w ON w.c = k.c AND w.first = greatest(k.first + 1, k.stop - 1) WHERE k.stop < k.n),
    sps AS (SELECT c, x, string_agg(sp, ',' ORDER BY u) AS speakers FROM (SELECT w.c, w.x, a.sp, min(a.u) AS u FROM walk w JOIN acc a ON a.c = w.c AND a.u >= w.first AND a.u < w.stop GROUP BY ALL) GROUP BY 1, 2),
    chunk AS (
        SELECT w.c AS lesson, w.x AS chunk_index, min(a.t) AS turn_start, max(a.t) AS turn_end, string_agg(a.sp || ': ' || a.txt, chr(10) ORDER BY a.u) AS text
        FROM walk w JOIN acc a ON a.c = w.c AND a.u >= w.first AND a.u < w.stop GROUP BY 1, 2)"""
CHUNK_METRICS = (
    CHUNKS + """,
    src AS (SELECT c AS lesson, count(*) AS source_turn_count FROM turns GROUP BY 1),
    un AS (SELECT c AS lesson, count(*) AS unit_count, sum(sz) + greatest(0, count(*) - 1) AS uniq FROM unit GROUP BY 1),
    cov AS (SELECT lesson, count(DISTINCT t) AS covered FROM (SELECT lesson, unnest(range(turn_start, turn_end + 1)) AS t FROM chunk) GROUP BY 1),
    ord AS (SELECT lesson, length(text) AS z, row_number() OVER (PARTITION BY lesson ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lesson) AS n FROM chunk),
    p95 AS (SELECT lesson, CAST(max(z) AS DOUBLE) AS p95_chunk_chars FROM ord WHERE i = CAST(round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) AS BIGINT) GROUP BY 1),
    met AS (
        SELECT lesson, any_value(source_turn_count) AS source_turn_count, any_value(unit_count) AS unit_count, count(*) AS chunk_count, round(avg(length(text)), 1) AS mean_chunk_chars,
               round(CAST(median(length(text)) AS DOUBLE), 1) AS median_chunk_chars, any_value(p95_chunk_chars) AS p95_chunk_chars, CAST(0 AS DOUBLE) AS empty_chunk_rate,
               round(CAST(count(CASE WHEN length(text) > 700 THEN 1 END) AS DOUBLE) / count(*), 4) AS oversize_chunk_rate, round(1 - CAST(count(DISTINCT text) AS DOUBLE) / count(*), 4) AS duplicate_text_rate,
               round(CAST(any_value(covered) AS DOUBLE) / any_value(source_turn_count), 4) AS source_turn_coverage_rate,
               round(CAST(greatest(0, sum(length(text)) - any_value(uniq)) AS DOUBLE) / sum(length(text)), 4) AS estimated_overlap_rate
        FROM chunk JOIN src USING (lesson) JOIN un USING (lesson) JOIN cov USING (lesson) JOIN p95 USING (lesson) GROUP BY lesson)"""
)


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


NUMBERED = r"regexp_matches(text, '(?:^|[^0-9])[0-9]{2,4}\s*\.')"
TOPICS = (
    "list_filter([" + ", ".join(f"CASE WHEN {_any(chr(39).join(['replace(text, ', ' ', ', ', '', ')']), [w.replace(' ', '') for w in words])} THEN '{name}' END" for name, words in LATIN_TAGS.topics)
    + f", CASE WHEN {NUMBERED} OR {_any('text', LATIN_TAGS.exercise_words)} THEN '{LATIN_TAGS.exercise_topic}' END], lambda x: x IS NOT NULL)"
)
TOPICS = f"CASE WHEN len({TOPICS}) = 0 THEN ['{LATIN_TAGS.default_topic}'] ELSE {TOPICS} END"
TYPES = (
    f"list_filter([CASE WHEN {NUMBERED} OR {_any('text', LATIN_TAGS.content_types[0][1])} THEN 'notice' END, CASE WHEN {_any('text', LATIN_TAGS.content_types[1][1])} THEN 'negative' END, "
    f"CASE WHEN doc_id % 2 = 0 THEN 'dialogue' END, CASE WHEN {_any('text', LATIN_TAGS.content_types[2][1])} THEN 'shout' END], lambda x: x IS NOT NULL)"
)
TYPES = f"CASE WHEN len({TYPES}) = 0 THEN ['plain'] ELSE {TYPES} END"
TERMS = "list_filter([" + ", ".join(f"CASE WHEN contains(replace(text, ' ', ''), '{t}') THEN '{t}' END" for t in LATIN_TAGS.terms) + "], lambda x: x IS NOT NULL)"
NUMBERS = r"list_sort(list_distinct(list_transform(regexp_extract_all(replace(text, '.', '.  '), '(?:^|[^0-9])([0-9]{2,4})\s*\.', 1), lambda x: CAST(x AS INTEGER))))"

FEEDBACK = (
    "fb AS (" + " UNION ALL ".join(
        f"SELECT doc_id, {k} AS pos, '{d}' AS dim, CAST({w} AS DOUBLE) AS given, CAST({'2 + 2 * quality' if k % 2 else f'4 - 2 * toxic + (doc_id * {7 + k} + {k}) % 2'} AS DOUBLE) AS teacher, CAST(1 + (doc_id * {k + 3}) % 5 AS DOUBLE) AS evaluator, CAST(20 + 60 * quality - 10 * toxic + doc_id % 10 AS DOUBLE) AS overall FROM labels"
        for k, (d, _, w, _) in enumerate(calibration.RUBRIC)
    ) + ")"
)
OFFSETS = "off AS (SELECT dim, round(least(1, greatest(-1, avg(teacher - evaluator))), 3) AS offset_ FROM fb GROUP BY 1)"
WEIGHTS = """
    co AS (SELECT dim, any_value(given) AS given, count(*) AS n,
           greatest(CAST(0.05 AS DOUBLE), CASE WHEN count(*) < 2 OR min(teacher) = max(teacher) OR min(overall) = max(overall) THEN 0
               ELSE (sum(teacher * overall) - count(*) * avg(teacher) * avg(overall)) / sqrt((sum(teacher * teacher) - count(*) * avg(teacher) * avg(teacher)) * (sum(overall * overall) - count(*) * avg(overall) * avg(overall))) END) AS r
           FROM fb GROUP BY 1),
    bl AS (SELECT dim, given, n, round(given * CAST(0.5 AS DOUBLE) + r / sum(r) OVER () * CAST(0.5 AS DOUBLE), 4) AS b FROM co),
    wt AS (SELECT dim, CASE WHEN n >= 6 THEN round(b / sum(b) OVER (), 4) ELSE given END AS weight, CASE WHEN n >= 6 THEN 'learned' ELSE 'default' END AS method FROM bl)"""
GRADED = (
    "WITH " + FEEDBACK + ", " + OFFSETS + ", " + WEIGHTS
    + """, cal AS (SELECT doc_id, fb.dim, weight, CASE WHEN fb.dim = 'citation_traceability' AND doc_id % 3 = 0 THEN CAST(1 AS DOUBLE) ELSE round(least(5, greatest(1, teacher + offset_)), 2) END AS s FROM fb JOIN off USING (dim) JOIN wt USING (dim)),
    gr AS (SELECT doc_id AS id, round(sum(s / 5 * weight) / sum(weight) * 100, 2) AS overall, min(CASE WHEN dim IN ('class_grounding', 'scope_boundary') THEN s END) AS gate, CAST(any_value(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS invalid FROM cal GROUP BY 1)"""
)


def _case(column: str, values: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {otherwise} END"


GUARD = f"""
    WITH g AS (SELECT doc_id, [{', '.join(repr(s) for s in answering.SCOPES)}][doc_id % 5 + 1] AS scope, trim(text, E' \\n\\t') AS a FROM documents)
    SELECT doc_id, scope,
           {_case('scope', {**{k: f"'{v}'" for k, v in answering.SAFE_TEXTS.items()}, **{k: f"CASE WHEN contains(a, '{answering.CAVEAT}') THEN a ELSE '{v}' || a END" for k, v in answering.PREFIXES.items()}}, 'a')} AS answer,
           CASE WHEN scope IN {_list(answering.SAFE_TEXTS)} THEN '' ELSE CAST(doc_id AS VARCHAR) END AS cited,
           CASE WHEN doc_id % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence, {_case('scope', {k: f"'{v}'" for k, v in answering.BEHAVIOUR_OF.items()}, 'NULL')} AS behaviour
    FROM g"""

ABLATED = (
    "WITH " + INDEX + ", " + RELEVANT + r""",
    asked AS (SELECT item_id AS q, regexp_extract_all(text, '""" + TOKEN + r"""') AS tk FROM benchmark WHERE item_id IN (SELECT q FROM rel)),
    cut AS (SELECT q, i, array_to_string(list_concat(tk[1:i - 1], tk[i + 1:len(tk)]), ' ') AS text FROM (SELECT q, tk, unnest(range(1, len(tk) + 1)) AS i FROM asked)),
    one AS (SELECT q, text, row_number() OVER () AS id FROM (SELECT q, text FROM cut WHERE text <> '' GROUP BY 1, 2))"""
    + "," + terms("abt", "one", "id") + ", trial AS (SELECT DISTINCT one.q, abt.id FROM one JOIN abt ON abt.id = one.id)," + scored("abt")
    + """, rk AS (SELECT q AS id, doc, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc) AS r FROM sc),
    won AS (SELECT DISTINCT t.q, t.id FROM trial t JOIN rk ON rk.id = t.id AND rk.r <= 5 JOIN rel ON rel.q = t.q AND rel.doc = rk.doc),
    stab AS (SELECT t.q AS qid, count(*) AS trials, count(won.id) AS hits, round(CAST(count(won.id) AS DOUBLE) / count(*), 4) AS stability FROM trial t LEFT JOIN won ON won.id = t.id GROUP BY 1)"""
)
MISS = "(SELECT product(CAST(n - r - i AS DOUBLE) / (n - i)) FROM range(0, 5) z(i))"
CHANCE = f"CASE WHEN n - r < 5 THEN 1 ELSE 1 - {MISS} END"
AUDIT = (
    ABLATED + "," + terms("qt", "benchmark", "item_id") + "," + scored("qt", "sq")
    + f""", rq AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc) AS r FROM sq),
    fr AS (SELECT rel.q, min(rq.r) AS first_rank FROM rel JOIN rq ON rq.q = rel.q AND rq.doc = rel.doc AND rq.r <= 5 GROUP BY 1),
    sh AS (SELECT q, count(*) AS shared, count(CASE WHEN v NOT IN ('of', 'the') THEN 1 END) AS distinctive FROM (SELECT DISTINCT rel.q, qt.v FROM rel JOIN qt ON qt.id = rel.q JOIN dt ON dt.id = rel.doc AND dt.v = qt.v) GROUP BY 1),
    base AS (SELECT cnt.q AS qid, cnt.n AS r, (SELECT count(*) FROM documents) AS n FROM cnt),
    aud AS (
        SELECT b.qid, fr.first_rank IS NOT NULL AS hit, fr.first_rank, coalesce(sh.shared, 0) AS shared, coalesce(sh.distinctive, 0) AS distinctive, coalesce(s.trials, 0) AS trials,
               coalesce(s.stability, CAST(fr.first_rank IS NOT NULL AS DOUBLE)) AS stability, CAST(b.r AS DOUBLE) / b.n AS chance_1, {CHANCE} AS chance_k
        FROM base b LEFT JOIN fr ON fr.q = b.qid LEFT JOIN sh ON sh.q = b.qid LEFT JOIN stab s ON s.qid = b.qid),
    cls AS (SELECT *, CASE WHEN first_rank IS NULL THEN '{audit.FAILED}' WHEN first_rank <= 3 AND distinctive >= 1 AND stability >= 0.7 THEN '{audit.ROBUST}'
                           WHEN first_rank <= 5 AND distinctive >= 1 AND stability >= 0.5 THEN '{audit.FAIR}' ELSE '{audit.WEAK}' END AS class FROM aud)"""
)


def _tail(p: str, hits: str) -> str:
    """The Poisson-binomial tail by a recursive walk over trials and successes."""
    return f"""
    ord_{p} AS (SELECT {p} AS p, row_number() OVER (ORDER BY {p}, qid) AS i FROM cls),
    dist_{p} AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS m
        UNION ALL
        SELECT i, k, sum(m) FROM (SELECT o.i, d.k + x.up AS k, d.m * CASE WHEN x.up = 1 THEN o.p ELSE 1 - o.p END AS m FROM dist_{p} d JOIN ord_{p} o ON o.i = d.i + 1 CROSS JOIN (SELECT unnest([0, 1]) AS up) x) GROUP BY 1, 2),
    tail_{p} AS (SELECT sum(m) AS v FROM dist_{p} WHERE i = (SELECT count(*) FROM cls) AND k >= (SELECT {hits} FROM cls))"""


KEYWORDS = (
    "WITH " + terms("dt", "documents", "doc_id") + ", " + RELEVANT
    + r""", kw AS (SELECT DISTINCT item_id AS qid, unnest(string_split_regex(text, '\s+')) AS keyword FROM benchmark), kn AS (SELECT *, row_number() OVER () AS id FROM kw)"""
    + "," + terms("kt", "kn", "id", "keyword")
    + """, good AS (SELECT DISTINCT rel.q, dt.v FROM rel JOIN dt ON dt.id = rel.doc),
    dg AS (SELECT kn.qid, kn.keyword, count(kt.v) > 0 AS tokenized, count(good.v) > 0 AS matched FROM kn LEFT JOIN kt ON kt.id = kn.id LEFT JOIN good ON good.q = kn.qid AND good.v = kt.v GROUP BY kn.id, 1, 2)"""
)


def hangul_terms(name: str, table: str, id_col: str) -> str:
    """A CTE of the distinct terms (v) of each row (id) under the default rules, with letters written as Hangul; and one of all keys."""
    rules = TermRules()
    text = f"translate(lower(text), '{queries.LETTERS}', '{queries.HANGUL}')"
    cases = " ".join(f"WHEN ends_with(t, '{s}') THEN {len(s)}" for s in rules.suffixes)
    return f"""
    {name}_t AS (SELECT DISTINCT id, t FROM (SELECT {id_col} AS id, unnest(regexp_extract_all({text}, '{TOKEN}')) AS t FROM {table}) WHERE t NOT IN {_list(rules.stopwords)}),
    {name}_s AS (SELECT id, t, CASE WHEN regexp_full_match(t, '[가-힣]+') THEN CASE {cases} END END AS cut FROM {name}_t),
    {name} AS (SELECT DISTINCT id, v FROM (SELECT id, t AS v FROM {name}_t UNION ALL SELECT id, left(t, CAST(length(t) - cut AS INTEGER)) AS v FROM {name}_s WHERE cut IS NOT NULL AND length(t) - cut >= 2)),
    {name}_g AS (SELECT DISTINCT id, m || substr(v, CAST(k AS INTEGER), CAST(w AS INTEGER)) AS key FROM (
        SELECT id, v, m, w, unnest(range(1, length(v) - w + 2)) AS k FROM {name} CROSS JOIN (VALUES ('b', 2), ('t', 3)) g(m, w) WHERE regexp_full_match(v, '[가-힣]+') AND length(v) >= w))"""


DEFAULT_RANKED = (
    "WITH " + hangul_terms("dt", "documents", "doc_id") + "," + hangul_terms("qt", "benchmark", "item_id") + """,
    post AS (
        SELECT id AS doc, 'w' || split_part(v, '.', 1) AS key, count(*) AS tf, 5 AS w FROM dt GROUP BY 1, 2
        UNION ALL SELECT id, 'w' || v, 1, 5 FROM dt WHERE contains(v, '.')
        UNION ALL SELECT id, key, 1, 1 FROM dt_g),
    own AS (SELECT DISTINCT id, 'w' || v AS key FROM qt UNION ALL SELECT id, key FROM qt_g),
    lens AS (SELECT d.doc_id AS doc, coalesce(e.n, 0) + coalesce(g.n, 0) AS dl FROM documents d
             LEFT JOIN (SELECT id, count(*) + count(CASE WHEN contains(v, '.') THEN 1 END) AS n FROM dt GROUP BY 1) e ON e.id = d.doc_id LEFT JOIN (SELECT id, count(*) AS n FROM dt_g GROUP BY 1) g ON g.id = d.doc_id),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens),
    dfs AS (SELECT key, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY 1),
    sc AS (SELECT x.id AS q, p.doc, sum(
            CASE WHEN ln((st.n - f.df + 0.5) / (f.df + 0.5)) > 0 THEN ln((st.n - f.df + 0.5) / (f.df + 0.5)) ELSE CAST(0.000001 AS DOUBLE) END
            * p.w * p.tf * CAST(2.2 AS DOUBLE) / (p.w * p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l.dl / st.avgdl))) AS s
        FROM own x JOIN post p USING (key) JOIN dfs f USING (key) JOIN lens l ON l.doc = p.doc, st GROUP BY 1, 2),
    top AS (SELECT * FROM (SELECT q, doc, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc) AS r, count(*) OVER (PARTITION BY q) AS c FROM sc) WHERE r <= 5)"""
)
PROBLEM_DIMS = [f"CAST(doc_id * {k + 3} % 6 AS DOUBLE)" for k in range(6)]

ORACLES = {
    "bm25_default_rules": DEFAULT_RANKED + " SELECT q AS qid, CAST(r AS INTEGER) AS rank, doc AS chunk_id, round(s, 6) AS score, c AS candidate_count FROM top",
    "search_terms_default_rules": "WITH " + hangul_terms("qt", "benchmark", "item_id") + " SELECT id AS qid, 'exact' AS col, 'w' || v AS key FROM qt UNION ALL SELECT id, 'ngram', key FROM qt_g",
    "topic_chunks": f"SELECT doc_id FROM documents WHERE list_contains({TOPICS}, '{LATIN_TAGS.topics[2][0]}')",
    "question_number_chunks": f"WITH n AS (SELECT doc_id, unnest({NUMBERS}) AS x FROM documents) SELECT doc_id FROM n WHERE x = (SELECT min(x) FROM n)",
    "latency": "SELECT round(avg(value), 2) AS mean_ms, round(quantile_disc(value, 0.95), 2) AS p95_ms FROM events",
    "score_problems": f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'no score for {calibration.DIMENSIONS[2]}' WHEN least({', '.join(PROBLEM_DIMS)}) < 1 THEN 'a score is no number from 1 to 5' END AS problem FROM labels",
    "refused_questions": r"""
        WITH q AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE trim(text, E' \t\n\r') END AS t FROM documents),
             r AS (SELECT doc_id, CASE WHEN t = '' THEN 'the question is empty' WHEN length(t) > 1000 THEN 'the question has over 1000 characters' END AS refused FROM q)
        SELECT doc_id AS qid, refused IS NULL AS asked, CAST(0 AS INTEGER) AS sources, refused FROM r""",
    "answer_prompts": RANKED + " SELECT q AS qid, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY r) AS retrieved, true AS quoted, CAST(NULL AS VARCHAR) AS refused FROM top GROUP BY 1",
    "feedback_log_examples": f"""
        WITH {FEEDBACK}, r AS (SELECT doc_id, doc_id % 4 AS part, CASE WHEN doc_id % 5 <> 0 THEN ['direct', 'inferred', 'related_general'][doc_id % 3 + 1] END AS b, sum(teacher / 5 * given) / sum(given) * 100 AS score FROM fb GROUP BY 1),
             f AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY part DESC, doc_id DESC) AS k FROM r),
             o AS (SELECT *, CASE WHEN b IS NOT NULL AND k = 1 THEN 0 ELSE 1 END AS later FROM f)
        SELECT CAST(doc_id AS VARCHAR) AS question_id, b AS expected_behavior, '미분류' AS category, round(score, 2) >= 70 AS teacher_pass
        FROM o ORDER BY later, CASE WHEN later = 0 THEN b END, part DESC, doc_id DESC LIMIT 6""",
    "question_set_problems": r"""
        WITH i AS (SELECT item_id, CASE WHEN item_id % 11 = 0 THEN 'Q01' WHEN item_id % 11 = 1 THEN 'X' || item_id ELSE 'Q' || lpad(CAST(item_id % 100 AS VARCHAR), 2, '0') END AS id FROM benchmark),
        field AS (SELECT id || ': ' || CASE WHEN NOT regexp_full_match(id, 'Q[0-9]{2}') THEN 'id' WHEN item_id % 7 = 1 THEN 'question' WHEN item_id % 7 = 2 THEN 'target_keywords' WHEN item_id % 7 = 3 THEN 'gold_answer' WHEN item_id % 9 = 0 THEN 'category' END || ' is missing or wrong' AS problem FROM i),
        twice AS (SELECT id || ': not unique' AS problem FROM i GROUP BY id HAVING count(*) > 1),
        asked AS (SELECT DISTINCT item_id, id, c FROM (SELECT item_id, id, unnest([CAST(item_id AS VARCHAR), CASE WHEN item_id % 6 = 0 THEN 'none' ELSE CAST(item_id + 1 AS VARCHAR) END]) AS c FROM i)),
        unknown AS (SELECT id || ': no chunk ' || c AS problem FROM asked WHERE c NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents))
        SELECT problem, count(*) AS n FROM (SELECT * FROM field WHERE problem IS NOT NULL UNION ALL SELECT * FROM twice UNION ALL SELECT * FROM unknown) GROUP BY 1""",
    "normalised_answers": r"""
        SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 2 = 0 THEN '미분류' ELSE 'c' END AS category, 'p,p' AS points, CAST(0 AS INTEGER) AS claims,
               turn || 'x,' || (turn + 1) || CASE WHEN turn % 4 = 3 THEN '' ELSE 'y' END AS chunks,
               conv_id || '-' || turn || ': ' || CASE WHEN turn % 5 = 4 THEN 'id, question or answer is missing' WHEN turn % 4 = 3 THEN 'a retrieved chunk lacks its id or text' WHEN turn % 3 = 2 THEN 'unknown behaviour' END AS problem
        FROM conversations""",
    "artifact_problems": r"""
        WITH a AS (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY 1)
        SELECT CAST(c AS VARCHAR) AS artifact, CASE WHEN c % 5 = 3 THEN 'not a chunk artifact' WHEN c % 5 = 1 AND n > 1 THEN 'chunk indexes are not 0, 1, 2 and so on' WHEN c % 5 = 2 AND n > 1 THEN 'a chunk has no text' END AS problem
        FROM a WHERE c % 5 = 3 OR (c % 5 IN (1, 2) AND n > 1)""",
    "glossary_terms": r"""
        WITH w AS (SELECT item_id, unnest(string_split_regex(text, '\s+')) AS term, unnest(range(len(string_split_regex(text, '\s+')))) AS k FROM benchmark)
        SELECT min(item_id * 100000 + k) AS pos, arg_min(term, item_id * 100000 + k) AS term FROM w GROUP BY lower(term)""",
    "markdown_parse_metrics": r"""
        WITH t AS (SELECT conv_id AS lesson, count(*) AS candidate_lines, count(CASE WHEN NOT (turn = 0 AND conv_id % 3 = 0) THEN 1 END) AS parsed_lines FROM conversations GROUP BY 1)
        SELECT lesson, candidate_lines, parsed_lines, round(CAST(parsed_lines AS DOUBLE) / candidate_lines, 4) AS parse_rate, CASE WHEN parsed_lines < candidate_lines THEN 'lines before the first turn: 1' ELSE '' END AS lost FROM t""",
    "failed_filtered_questions": METRICS.replace("FROM sc), top", "FROM sc WHERE doc IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src3', 'src5'))), top") + " SELECT qid FROM met WHERE k = 1 AND hit = 0",
    "bm25_topk": RANKED + " SELECT q AS qid, CAST(r AS INTEGER) AS rank, doc AS chunk_id, round(s, 6) AS score, c AS candidate_count FROM top",
    "bm25_filtered": RANKED.replace("FROM sc), top", "FROM sc WHERE doc IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src3', 'src5'))), top") + " SELECT q AS qid, CAST(r AS INTEGER) AS rank, doc AS chunk_id, round(s, 6) AS score, c AS candidate_count FROM top",
    "bm25_candidates": RANKED + " SELECT q AS qid, count(*) AS candidate_count FROM sc GROUP BY 1",
    "search_terms": "WITH " + terms("qt", "benchmark", "item_id") + """
        SELECT id AS qid, 'exact' AS col, 'w' || v AS key FROM qt
        UNION ALL SELECT DISTINCT id, 'ngram', m || substr(v, CAST(k AS INTEGER), CAST(w AS INTEGER)) FROM (
            SELECT id, v, m, w, unnest(range(1, length(v) - w + 2)) AS k FROM qt CROSS JOIN (VALUES ('b', 2), ('t', 3)) g(m, w) WHERE regexp_full_match(v, '[a-z]+') AND length(v) >= w)""",
    "term_df_stats": "WITH " + INDEX + " SELECT key, CAST(df AS BIGINT) AS df FROM dfs",
    "corpus_stats": "WITH " + INDEX + " SELECT CAST(n AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl FROM st",
    "corpus_fingerprint": """
        WITH r AS (SELECT CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 3) AS BIGINT) AS bucket, sha256(CAST(doc_id AS VARCHAR) || ':' || sha256(text)) AS h FROM documents),
             p AS (SELECT bucket, count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS HUGEINT)) AS b FROM r GROUP BY 1)
        SELECT sha256(coalesce(string_agg(bucket || ':' || n || ':' || a || ':' || b, chr(10) ORDER BY bucket), '')) AS fingerprint, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM p""",
    "chunk_windows": CHUNKS + " SELECT lesson, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(turn_start AS INTEGER) AS turn_start, CAST(turn_end AS INTEGER) AS turn_end, speakers, CAST(length(text) AS INTEGER) AS char_count, text FROM chunk JOIN sps ON sps.c = lesson AND sps.x = chunk_index",
    "chunk_metrics": CHUNK_METRICS + " SELECT * FROM met",
    "chunk_gate": CHUNK_METRICS + """, ok AS (SELECT lesson, source_turn_coverage_rate = 1 AS coverage_ok, empty_chunk_rate = 0 AS empty_ok, oversize_chunk_rate <= CAST(0.05 AS DOUBLE) AS oversize_ok, duplicate_text_rate = 0 AS duplicate_ok FROM met)
        SELECT *, CASE WHEN coverage_ok AND empty_ok AND oversize_ok AND duplicate_ok THEN 'PASS' ELSE 'FAIL' END AS status FROM ok""",
    "topic_tags": f"SELECT doc_id, array_to_string({TOPICS}, ',') AS topics FROM documents",
    "term_tags": f"SELECT doc_id, array_to_string({TERMS}, ',') AS terms FROM documents",
    "question_number_tags": f"SELECT doc_id, array_to_string({NUMBERS}, ',') AS question_numbers FROM documents",
    "content_type_tags": f"SELECT doc_id, array_to_string({TYPES}, ',') AS content_types FROM documents",
    "topic_distribution": f"SELECT value, count(*) AS chunks FROM (SELECT unnest({TOPICS}) AS value FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1",
    "content_type_distribution": f"SELECT value, count(*) AS chunks FROM (SELECT unnest({TYPES}) AS value FROM documents) GROUP BY 1 ORDER BY 2 DESC, 1",
    "distinct_question_numbers": f"SELECT DISTINCT question_number FROM (SELECT unnest({NUMBERS}) AS question_number FROM documents) ORDER BY 1",
    "corpus_overview": f"""
        SELECT (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM (SELECT v, count(*) AS n FROM (SELECT unnest({TOPICS}) AS v FROM documents) GROUP BY 1)) AS topics,
               (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM (SELECT v, count(*) AS n FROM (SELECT unnest({TERMS}) AS v FROM documents) GROUP BY 1)) AS terms""",
    "load_validation": "SELECT source AS lesson_id, count(*) AS stored, count(*) AS expected, CAST(1 AS DOUBLE) AS fidelity, CAST(1 AS DOUBLE) AS completeness, CAST(0 AS BIGINT) AS duplicates, 'PASS' AS status FROM documents GROUP BY 1",
    "ranking_metrics": METRICS + " SELECT qid, CAST(k AS INTEGER) AS k, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, CAST(first_rank AS INTEGER) AS first_rank FROM met",
    "ranking_summary": METRICS + " SELECT CAST(k AS INTEGER) AS k, count(*) AS questions, round(avg(hit), 4) AS hit, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM met GROUP BY 1",
    "metrics_by_category": METRICS + " SELECT 'c' || (qid % 4) AS category, count(*) AS questions, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM met WHERE k = 5 GROUP BY 1",
    "failed_questions": METRICS + " SELECT qid FROM met WHERE k = 1 AND hit = 0",
    "keyword_diagnostics": KEYWORDS + " SELECT * FROM dg",
    "keyword_rates": KEYWORDS + " SELECT count(*) AS keywords, round(CAST(count(CASE WHEN tokenized THEN 1 END) AS DOUBLE) / count(*), 4) AS tokenization_rate, round(CAST(count(CASE WHEN matched THEN 1 END) AS DOUBLE) / count(*), 4) AS match_rate FROM dg",
    "ablation_stability": ABLATED + " SELECT * FROM stab",
    "hit_audit": AUDIT + " SELECT qid, hit, CAST(first_rank AS INTEGER) AS first_rank, CAST(shared AS INTEGER) AS shared, CAST(distinctive AS INTEGER) AS distinctive, trials, stability, round(chance_1, 9) AS chance_1, round(chance_k, 9) AS chance_k, class FROM cls",
    "chance_baseline": f"WITH {RELEVANT}, b AS (SELECT q, n AS r, (SELECT count(*) FROM documents) AS n FROM cnt) SELECT q AS qid, round({CHANCE}, 9) AS chance FROM b",
    "audit_summary": AUDIT.replace("WITH ", "WITH RECURSIVE ", 1) + "," + _tail("chance_1", "count(CASE WHEN first_rank = 1 THEN 1 END)") + "," + _tail("chance_k", "count(CASE WHEN hit THEN 1 END)") + """
        SELECT count(*) AS questions, count(CASE WHEN first_rank = 1 THEN 1 END) AS hits_1, count(CASE WHEN hit THEN 1 END) AS hits_k, round(sum(chance_1), 4) AS expected_1, round(sum(chance_k), 4) AS expected_k, round(avg(stability), 4) AS mean_stability,
               round((SELECT v FROM tail_chance_1), 9) AS tail_1, round((SELECT v FROM tail_chance_k), 9) AS tail_k FROM cls""",
    "calibration_offsets": f"WITH {FEEDBACK}, {OFFSETS} SELECT dim, offset_ AS offset FROM off",
    "calibration_weights": f"WITH {FEEDBACK}, {WEIGHTS} SELECT dim, weight, method FROM wt",
    "weighted_scores": f"WITH {FEEDBACK} SELECT doc_id, round(sum(teacher / 5 * given) / sum(given) * 100, 2) AS overall FROM fb GROUP BY 1",
    "graded_answers": GRADED + " SELECT id, overall, overall >= 70 AND gate >= 3 AS passed, invalid FROM gr",
    "grading_summary": GRADED + " SELECT count(*) AS questions, round(avg(overall), 2) AS mean_overall, round(avg(CASE WHEN overall >= 70 AND gate >= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS pass_rate FROM gr",
    "feedback_examples": """
        WITH once AS (SELECT max(event_id) AS pos, event_type AS b, user_id FROM events GROUP BY event_type, json_extract_string(props, '$.k'), user_id, round(value, 2)),
             f AS (SELECT b, max(pos) AS pos FROM once WHERE b IN ('click', 'purchase', 'signup', 'view') GROUP BY 1)
        SELECT o.pos, o.b AS expected_behavior, o.user_id FROM once o LEFT JOIN f ON f.pos = o.pos ORDER BY f.pos IS NULL, f.b, o.pos DESC LIMIT 6""",
    "citation_guard": GUARD,
    "markdown_turns": r"SELECT conv_id AS lesson, CAST(turn AS INTEGER) AS turn_index, role AS speaker, regexp_replace(trim(text, E' \n\t'), '\n+', ' ', 'g') AS text FROM conversations",
    "text_turns": r"SELECT conv_id AS lesson, CAST(turn AS INTEGER) AS turn_index, role AS speaker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, CAST(turn * 60 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS start_sec, CAST(turn * 60 AS DOUBLE) + CAST(30.25 AS DOUBLE) AS end_sec FROM conversations",
    "json_turns": "SELECT conv_id AS lesson, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role AS speaker, CAST(turn + 1 AS INTEGER) AS source_line, CAST((turn + 1) * 60 + 5 AS DOUBLE) AS start_sec FROM conversations WHERE turn % 4 <> 3",
    "front_matter": "SELECT DISTINCT conv_id AS lesson, 'conversation ' || conv_id AS title, '2024-01-02' AS date, 'one,two' AS key_topics FROM conversations",
}
