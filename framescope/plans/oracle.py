"""DuckDB SQL for each named query: a brute-force statement of the same result.

The oracle may enumerate every pair (it runs on the small correctness
scale); the Spark side may not. Both round scores to 6 decimals before
ranking, thresholding and hashing.
"""

from __future__ import annotations

from ..functions.text import LETTERS, NON_WS, PUNCT, SENTENCE_END, TOKEN, TRIM, WS
from ..functions.wordlists import ANALYSIS_STOPWORDS, CONTENT_POS, CUSTOM_STOPWORDS, ENGLISH_STOPWORDS
from ..operators import boundaries as B
from .catalog import LEMMA_ROWS, TAG_ENDINGS
from .tables import N_PARAMETERS, parameter_names

ORACLE: dict[str, str] = {}

K = 5
T = 0.25
DOC_T = 0.15


def _cos(a: str, b: str) -> str:
    den = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"(round(CASE WHEN {den} > 0 THEN list_dot_product({a}, {b}) / {den} ELSE 0 END, 6) + 0.0)"


SV = f"sv AS (SELECT label AS doc, vec_id AS sentence_index, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id >= {N_PARAMETERS})"
QV = f"qv AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id < {N_PARAMETERS})"
FW = "fw AS (SELECT query_id, printf('p%02d', query_id) AS parameter, 'c' || label::VARCHAR AS category FROM qv)"
SCORES = f"scores AS (SELECT s.doc, q.query_id, s.sentence_index, {_cos('s.v', 'q.v')} AS score FROM sv s CROSS JOIN qv q)"
MATCHES = (
    "matches AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, query_id "
    f"ORDER BY score DESC, sentence_index) AS rank FROM scores) WHERE rank <= {K})"
)
DOCS = "docs AS (SELECT DISTINCT doc FROM sv)"


def _adh(t: str) -> str:
    return (
        "best AS (SELECT doc, query_id, max(score) AS best FROM matches GROUP BY doc, query_id), "
        "adh AS (SELECT d.doc, q.query_id, coalesce((b.best >= " + t + ")::INTEGER, 0) AS adheres "
        "FROM docs d CROSS JOIN qv q LEFT JOIN best b ON b.doc = d.doc AND b.query_id = q.query_id)"
    )


COVERAGE = (
    "SELECT doc, sum(adheres)::BIGINT AS total_params_mentioned, count(*)::BIGINT AS n_params, "
    "round(sum(adheres) / count(*), 6) AS framework_coverage FROM adh GROUP BY doc"
)

ORACLE["flagship_coverage"] = f"WITH {SV}, {QV}, {SCORES}, {MATCHES}, {DOCS}, {_adh(str(T))} {COVERAGE}"

ORACLE["topk_dense"] = f"""WITH {SV}, {QV}, {FW}, {SCORES}, {MATCHES},
sizes AS (SELECT doc, count(*)::BIGINT AS corpus_size FROM sv GROUP BY doc)
SELECT m.doc, z.corpus_size, m.query_id, f.parameter, f.category, m.rank::BIGINT AS sentence_rank,
       m.score AS sentence_score, m.sentence_index
FROM matches m JOIN sizes z ON z.doc = m.doc JOIN fw f ON f.query_id = m.query_id"""

ORACLE["adherence_long"] = f"""WITH {SV}, {QV}, {FW}, {SCORES}, {MATCHES}, {DOCS}, {_adh(str(T))}
SELECT a.doc, a.query_id, f.parameter, f.category, a.adheres::BIGINT AS adheres
FROM adh a JOIN fw f ON f.query_id = a.query_id"""


def _pivot(value: str, names: list[str], fill: str | None = None) -> str:
    cols = []
    for n in names:
        e = f"max(CASE WHEN parameter = '{n}' THEN {value} END)"
        if fill is not None:
            e = f"coalesce({e}, {fill})"
        cols.append(f"{e} AS {n}")
    return ", ".join(cols)


ORACLE["adherence_matrix"] = f"""WITH {SV}, {QV}, {FW}, {SCORES}, {MATCHES}, {DOCS}, {_adh(str(T))},
long AS (SELECT a.doc, f.parameter, a.adheres::BIGINT AS adheres FROM adh a JOIN fw f ON f.query_id = a.query_id)
SELECT doc, {_pivot('adheres', sorted(parameter_names()), '0')} FROM long GROUP BY doc"""

ORACLE["adherence_mean_threshold"] = f"""WITH {SV}, {QV}, {SCORES}, {MATCHES}, {DOCS},
thr AS (SELECT avg(m) AS t FROM (SELECT doc, avg(m) AS m FROM
        (SELECT doc, query_id, avg(score) AS m FROM matches GROUP BY doc, query_id) GROUP BY doc)),
{_adh('(SELECT t FROM thr)')}
SELECT doc, sum(adheres)::BIGINT AS total_params_mentioned, count(*)::BIGINT AS n_params,
       round(sum(adheres) / count(*), 6) AS framework_coverage, round((SELECT t FROM thr), 6) AS threshold
FROM adh GROUP BY doc"""

ORACLE["review_candidates"] = f"""WITH {SV}, {QV}, {SCORES}, {MATCHES}
SELECT doc, query_id, rank::BIGINT AS rank, score, sentence_index FROM matches WHERE score >= {T}"""

DOC_SIM = f"""{SV}, {QV}, {FW},
comp AS (SELECT doc, unnest(range(len(v))) AS pos, unnest(v) AS x FROM sv),
mv AS (SELECT doc, list(x ORDER BY pos) AS v FROM (SELECT doc, pos, avg(x) AS x FROM comp GROUP BY doc, pos) GROUP BY doc),
dsim AS (SELECT m.doc, q.query_id, {_cos('m.v', 'q.v')} AS score FROM mv m CROSS JOIN qv q),
dnamed AS (SELECT d.doc, f.parameter, d.score FROM dsim d JOIN fw f ON f.query_id = d.query_id)"""

ORACLE["similarity_matrix"] = f"WITH {DOC_SIM} SELECT doc, {_pivot('score', parameter_names())} FROM dnamed GROUP BY doc"
ORACLE["similarity_mask"] = (
    f"WITH {DOC_SIM} SELECT doc, {_pivot(f'CASE WHEN score >= {DOC_T} THEN score END', parameter_names())} "
    "FROM dnamed GROUP BY doc"
)
ORACLE["similarity_binary"] = (
    f"WITH {DOC_SIM} SELECT doc, {_pivot(f'(score >= {DOC_T})::BIGINT', parameter_names())} FROM dnamed GROUP BY doc"
)


def _r(e: str) -> str:
    return f"(round({e}, 6) + 0.0)"


def profile_sql(src: str, col: str) -> str:
    """SELECT list of the numpy-style profile of ``col`` over relation ``src``."""
    ps = ", ".join(f"{_r(f'quantile_cont({col}, {p})')} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95))
    return (
        f"SELECT count({col})::BIGINT AS n, {_r(f'avg({col})')} AS mean, {_r(f'median({col})')} AS median, "
        f"{_r(f'stddev_pop({col})')} AS std, {_r(f'min({col})')} AS min, {_r(f'max({col})')} AS max, {ps} FROM {src}"
    )


def describe_sql(src: str, col: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    ps = ", ".join(f"{_r(f'quantile_cont({col}::DOUBLE, {p})')} AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    tail = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {g}count({col})::BIGINT AS count, {_r(f'avg({col}::DOUBLE)')} AS mean, "
        f"{_r(f'stddev_samp({col}::DOUBLE)')} AS std, {_r(f'min({col}::DOUBLE)')} AS min, {ps}, "
        f"{_r(f'max({col}::DOUBLE)')} AS max FROM {src}{tail}"
    )


def histogram_sql(src: str, col: str, bins: int) -> str:
    """Equal-width histogram with empty bins, same arithmetic as the Spark operator."""
    return f"""rng AS (SELECT min({col}::DOUBLE) AS lo, max({col}::DOUBLE) AS hi FROM {src} WHERE {col} IS NOT NULL),
hb AS (SELECT CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor(({col}::DOUBLE - r.lo) * {float(bins)} / (r.hi - r.lo)), {bins - 1}) END::INTEGER AS bin
       FROM {src}, rng r WHERE {col} IS NOT NULL),
hc AS (SELECT bin, count(*) AS c FROM hb GROUP BY bin)
SELECT e.bin::INTEGER AS bin, {_r('r.lo + e.bin * ((r.hi - r.lo) / ' + str(bins) + ')')} AS lo,
       {_r(f'CASE WHEN e.bin = {bins - 1} THEN r.hi ELSE r.lo + (e.bin + 1) * ((r.hi - r.lo) / {bins}) END')} AS hi,
       coalesce(hc.c, 0)::BIGINT AS count
FROM (SELECT range AS bin FROM range({bins})) e CROSS JOIN rng r LEFT JOIN hc ON hc.bin = e.bin"""


def boxplot_sql(src: str, col: str) -> str:
    return f"""q AS (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS med, quantile_cont({col}, 0.75) AS q3 FROM {src}),
f AS (SELECT q1, med, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)
SELECT {_r('f.q1')} AS q1, {_r('f.med')} AS median, {_r('f.q3')} AS q3, {_r('f.iqr')} AS iqr,
       {_r(f'min(CASE WHEN {col} >= f.lf AND {col} <= f.hf THEN {col} END)')} AS whisker_lo,
       {_r(f'max(CASE WHEN {col} >= f.lf AND {col} <= f.hf THEN {col} END)')} AS whisker_hi,
       count(*) FILTER (WHERE {col} IS NOT NULL AND NOT ({col} >= f.lf AND {col} <= f.hf))::BIGINT AS n_outliers
FROM {src}, f GROUP BY f.q1, f.med, f.q3, f.iqr"""


ORACLE["score_profile"] = f"WITH {DOC_SIM} {profile_sql('dsim', 'score')}"
ORACLE["score_histogram"] = f"WITH {DOC_SIM}, {histogram_sql('dsim', 'score', 50)}"
ORACLE["sentence_score_histogram"] = (
    f"WITH {SV}, {QV}, {SCORES}, {MATCHES}, "
    "mm AS (SELECT doc, query_id, round(avg(score), 6) AS m FROM matches GROUP BY doc, query_id), "
    f"{histogram_sql('mm', 'm', 30)}"
)
ORACLE["score_boxplot"] = f"WITH {DOC_SIM}, {boxplot_sql('dsim', 'score')}"


# ---------------------------------------------------------------- text family


def _lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sent_arr(text: str) -> str:
    marked = f"regexp_replace(coalesce({text}, ''), '{SENTENCE_END}', '\\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '{TRIM}', '', 'g')), "
        "lambda s: s <> '')"
    )


def word_count_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{NON_WS}+'))::BIGINT"


def letters_sql(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{LETTERS}')"


SENTS = f"sents AS (SELECT doc_id, unnest(range(len(a)))::BIGINT AS sentence_index, unnest(a) AS sentence FROM (SELECT doc_id, {sent_arr('text')} AS a FROM documents))"

ORACLE["sentences"] = f"WITH {SENTS} SELECT doc_id, sentence_index, sentence FROM sents"
ORACLE["corpus_size"] = f"SELECT doc_id, len({sent_arr('text')})::BIGINT AS corpus_size FROM documents"
ORACLE["word_count_profile"] = (
    f"WITH wc AS (SELECT {word_count_sql('text')} AS word_count FROM documents) {describe_sql('wc', 'word_count')}"
)
ORACLE["word_count_by_lang"] = (
    f"WITH wc AS (SELECT lang, {word_count_sql('text')} AS word_count FROM documents) "
    f"{describe_sql('wc', 'word_count', 'lang')}"
)

_CLEAN = f"lower(regexp_replace(regexp_replace(text, '{PUNCT}', '', 'g'), '{TRIM}', '', 'g'))"
_CLEAN_TOKS = (
    f"list_filter(list_filter(regexp_split_to_array({_CLEAN}, '{WS}+'), lambda w: w <> ''), "
    f"lambda w: NOT list_contains({_lit_list(ENGLISH_STOPWORDS)}, w))"
)
ORACLE["clean_tokens"] = (
    f"SELECT doc_id, array_to_string(t, ' ') AS clean_text_str, len(t)::BIGINT AS n_tokens "
    f"FROM (SELECT doc_id, {_CLEAN_TOKS} AS t FROM documents)"
)

_STOP = _lit_list(ANALYSIS_STOPWORDS)


def words_sql(src: str, by: str | None = None, lemmas: str | None = None) -> str:
    """(by, term, n) word counts over ``src`` (which has ``text`` and optionally ``by``)."""
    g = f"{by}, " if by else ""
    toks = f"SELECT {g}unnest({letters_sql('text')}) AS surface FROM {src}"
    if lemmas:
        body = (
            f"SELECT {g}coalesce(l.lemma, t.surface) AS term, l.pos AS tag FROM ({toks}) t "
            f"LEFT JOIN {lemmas} l ON l.surface = t.surface WHERE length(t.surface) >= 4"
        )
        cond = f"NOT list_contains({_STOP}, term) AND (tag IS NULL OR list_contains({_lit_list(CONTENT_POS)}, tag))"
    else:
        body = f"SELECT {g}surface AS term FROM ({toks}) WHERE length(surface) >= 4"
        cond = f"NOT list_contains({_STOP}, term)"
    return f"SELECT {g}term, count(*)::BIGINT AS n FROM ({body}) WHERE {cond} GROUP BY {g}term"


def top_sql(counts: str, n: int, by: str | None = None, term: str = "term") -> str:
    part = f"PARTITION BY {by} " if by else ""
    g = f"{by}, " if by else ""
    return (
        f"SELECT {g}rank::BIGINT AS rank, {term}, n, round(n / max(n) OVER ({part[:-1] if by else ''}), 6) + 0.0 AS weight FROM "
        f"(SELECT *, row_number() OVER ({part}ORDER BY n DESC, {term}) AS rank FROM ({counts})) WHERE rank <= {n}"
    )


def phrases_sql(by: str | None = None, src: str = "documents") -> str:
    g = f"{by}, " if by else ""
    sents = f"SELECT {g}unnest({sent_arr('text')}) AS sentence FROM {src}"
    toks = f"SELECT {g}{letters_sql('sentence')} AS toks FROM ({sents})"
    idx = f"SELECT {g}toks, unnest(range(1, len(toks))) AS i FROM ({toks})"
    pairs = f"SELECT {g}toks[i] AS a, toks[i + 1] AS b FROM ({idx})"
    keep = lambda x: f"length({x}) >= 3 AND NOT list_contains({_STOP}, {x})"
    return f"SELECT {g}a || ' ' || b AS phrase, count(*)::BIGINT AS n FROM ({pairs}) WHERE {keep('a')} AND {keep('b')} GROUP BY {g}a, b"


def _lemma_values() -> str:
    rows = ", ".join(f"('{s}', '{p}', '{l}')" for s, p, l in LEMMA_ROWS)
    return f"lem(surface, pos, lemma) AS (VALUES {rows})"


_LEMMA_CASE = "CASE w " + " ".join(f"WHEN '{s}' THEN '{l}'" for s, _, l in LEMMA_ROWS) + " ELSE w END"
ORACLE["clean_tokens_lemmatised"] = (
    f"SELECT doc_id, array_to_string(list_transform(t, lambda w: {_LEMMA_CASE}), ' ') AS clean_text_str, len(t)::BIGINT AS n_tokens "
    f"FROM (SELECT doc_id, {_CLEAN_TOKS} AS t FROM documents)"
)
ORACLE["term_frequency"] = words_sql("documents")
ORACLE["top_terms"] = top_sql(words_sql("documents"), 20)
ORACLE["term_frequency_by_group"] = top_sql(words_sql("conversations", "role"), 20, "role")
ORACLE["phrase_frequency"] = top_sql(phrases_sql(), 50, term="phrase")
ORACLE["phrase_frequency_by_lang"] = top_sql(phrases_sql("lang"), 20, "lang", term="phrase")
ORACLE["lemma_frequency"] = f"WITH {_lemma_values()} {words_sql('documents', lemmas='lem')}"
ORACLE["documents_by"] = (
    "SELECT 'lang' AS \"column\", lang AS value, count(doc_id)::BIGINT AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang "
    "UNION ALL SELECT 'source', source, count(doc_id)::BIGINT FROM documents WHERE source IS NOT NULL GROUP BY source"
)


# ---------------------------------------------------------------- term-count search (SIM2)
_ENG = _lit_list(ENGLISH_STOPWORDS)
SPARSE_T = 0.4


def sparse_topk_sql(queries: str, qkeys: list[str], k: int = 5) -> str:
    """CTE chain ending in ``ranked``: brute-force top-k over every (sentence, query) pair.

    ``queries`` is a relation with columns qkeys + qtext.
    """
    qk = ", ".join(qkeys)
    qk_q = ", ".join(f"q.{c}" for c in qkeys)
    qk_on = " AND ".join(f"d.{c} = p.{c}" for c in qkeys)
    qn_on = " AND ".join(f"qn.{c} = p.{c}" for c in qkeys)
    qtf_on = "q.term = t.term"
    return f"""{SENTS},
st AS (SELECT doc_id, sentence_index, unnest({letters_sql('sentence')}) AS term FROM sents),
tf AS (SELECT doc_id, sentence_index, term, count(*) AS tf FROM st WHERE NOT list_contains({_ENG}, term) GROUP BY doc_id, sentence_index, term),
nrm AS (SELECT doc_id, sentence_index, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY doc_id, sentence_index),
qrel AS ({queries}),
qt0 AS (SELECT {qk}, unnest({letters_sql('qtext')}) AS term FROM qrel),
qtf AS (SELECT {qk}, term, count(*) AS qtf FROM qt0 WHERE NOT list_contains({_ENG}, term) GROUP BY {qk}, term),
qn AS (SELECT {qk}, sqrt(sum(qtf * qtf)) AS qnorm FROM qtf GROUP BY {qk}),
dots AS (SELECT t.doc_id, t.sentence_index, {qk_q}, sum(t.tf * q.qtf) AS dot FROM tf t JOIN qtf q ON {qtf_on} GROUP BY t.doc_id, t.sentence_index, {qk_q}),
pairs AS (SELECT s.doc_id, s.sentence_index, {qk_q} FROM sents s CROSS JOIN (SELECT DISTINCT {qk} FROM qrel) q),
pscores AS (SELECT p.*, round(coalesce(d.dot / (n.norm * qn.qnorm), 0), 6) + 0.0 AS score FROM pairs p
  LEFT JOIN dots d ON d.doc_id = p.doc_id AND d.sentence_index = p.sentence_index AND {qk_on}
  LEFT JOIN nrm n ON n.doc_id = p.doc_id AND n.sentence_index = p.sentence_index
  LEFT JOIN qn ON {qn_on}),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {qk} ORDER BY score DESC, sentence_index) AS rank FROM pscores) WHERE rank <= {k})"""


_BENCH = "SELECT item_id AS query_id, text AS qtext FROM benchmark"
ORACLE["topk_sparse"] = (
    f"WITH {sparse_topk_sql(_BENCH, ['query_id'])} SELECT doc_id, query_id, rank::BIGINT AS rank, score, sentence_index FROM ranked"
)
ORACLE["review_candidates_text"] = (
    f"WITH {sparse_topk_sql(_BENCH, ['query_id'])} SELECT r.doc_id, r.query_id, r.rank::BIGINT AS rank, r.score, "
    f"r.sentence_index, s.sentence FROM ranked r JOIN sents s ON s.doc_id = r.doc_id AND s.sentence_index = r.sentence_index "
    f"WHERE r.score >= {SPARSE_T}"
)
ORACLE["evidence_sentences"] = (
    f"WITH {sparse_topk_sql(_BENCH, ['query_id'])} SELECT DISTINCT r.query_id, r.doc_id, s.sentence FROM ranked r "
    f"JOIN sents s ON s.doc_id = r.doc_id AND s.sentence_index = r.sentence_index WHERE r.score >= {SPARSE_T}"
)

KEYWORDS = f"""qterms AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({letters_sql('text')}) AS term FROM benchmark)
                WHERE NOT list_contains({_ENG}, term)),
dterms AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({letters_sql('text')}) AS term FROM documents)
           WHERE term IN (SELECT term FROM qterms)),
dfreq AS (SELECT term, count(*) AS df FROM dterms GROUP BY term),
kwr AS (SELECT q.query_id, q.term, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(f.df, 0), q.term) AS r
        FROM qterms q LEFT JOIN dfreq f ON f.term = q.term),
kw AS (SELECT query_id, list(term ORDER BY r) AS keywords FROM kwr WHERE r <= 3 GROUP BY query_id)"""

ORACLE["query_keywords"] = f"WITH {KEYWORDS} SELECT query_id, array_to_string(keywords, ', ') AS keywords FROM kw"

_BOTH = (
    "SELECT item_id AS query_id, 'definition' AS strategy, text AS qtext FROM benchmark UNION ALL "
    "SELECT b.item_id, 'keywords', b.text || '. Related terms: ' || coalesce(array_to_string(kw.keywords, ', '), '') "
    "FROM benchmark b LEFT JOIN kw ON kw.query_id = b.item_id"
)
_MEANS = (
    f"WITH {KEYWORDS}, {sparse_topk_sql(_BOTH, ['query_id', 'strategy'])}, "
    "means AS (SELECT doc_id, query_id, strategy, count(*) AS n, sum(round(score * 1e6)::BIGINT) AS score_micro, "
    "avg(score) AS mean_score FROM ranked GROUP BY doc_id, query_id, strategy)"
)
ORACLE["compare_strategies"] = f"""{_MEANS},
pdm AS (SELECT doc_id, strategy, (2 * sum(score_micro) + sum(n)) // (2 * sum(n)) AS m FROM means GROUP BY doc_id, strategy),
pd AS (SELECT doc_id, max(m) FILTER (WHERE strategy = 'definition') AS d, max(m) FILTER (WHERE strategy = 'keywords') AS k
       FROM pdm GROUP BY doc_id)
SELECT doc_id, d / 1e6 AS overall_avg_def_only, k / 1e6 AS overall_avg_with_keywords, (k - d) / 1e6 AS difference FROM pd"""
ORACLE["strategy_summary"] = f"""{_MEANS},
pdm AS (SELECT doc_id, strategy, avg(mean_score) AS m FROM means GROUP BY doc_id, strategy),
a AS (SELECT strategy, avg(m) AS doc_mean FROM pdm GROUP BY strategy),
b AS (SELECT strategy, avg(mean_score) AS pooled_mean FROM means GROUP BY strategy)
SELECT a.strategy, round(a.doc_mean, 6) AS doc_mean, round(b.pooled_mean, 6) AS pooled_mean FROM a JOIN b ON a.strategy = b.strategy"""


# ---------------------------------------------------------------- reviewed codes and coverage
_CODE_COLS = ["primary_paramater", "alt_parameter_1", "alt_parameter_2", "alt_parameter_3", "alt_parameter_4"]
_REVIEW = f"""{sparse_topk_sql(_BENCH, ['query_id'])},
cand AS (SELECT r.doc_id, r.query_id, r.score, r.sentence_index, s.sentence, b.text AS definition FROM ranked r
         JOIN sents s ON s.doc_id = r.doc_id AND s.sentence_index = r.sentence_index
         JOIN benchmark b ON b.item_id = r.query_id WHERE r.score >= {SPARSE_T}),
coded AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY score DESC, query_id) AS code_rank FROM cand),
csize AS (SELECT doc_id, len({sent_arr('text')})::BIGINT AS corpus_size FROM documents),
review AS (SELECT c.doc_id AS policy_title, c.sentence_index, c.sentence, z.corpus_size,
  {', '.join(f"max(CASE WHEN c.code_rank = {i + 1} THEN c.definition END) AS {n}" for i, n in enumerate(_CODE_COLS))}
  FROM coded c JOIN csize z ON z.doc_id = c.doc_id GROUP BY c.doc_id, c.sentence_index, c.sentence, z.corpus_size),
bfw AS (SELECT item_id AS pos, printf('i%03d', item_id) AS parameter,
        CASE WHEN item_id % 5 < 3 THEN 'c0' ELSE 'c1' END AS category, 's' || (item_id % 5)::VARCHAR AS subcategory,
        text AS definition FROM benchmark),
melted AS (SELECT u.policy_title, u.sentence, u.variable, f.parameter FROM
           (SELECT policy_title, sentence, variable, parameter_value FROM review
            UNPIVOT (parameter_value FOR variable IN ({', '.join(_CODE_COLS)}))) u
           LEFT JOIN bfw f ON f.definition = u.parameter_value),
counts AS (SELECT policy_title, parameter, count(*)::BIGINT AS count FROM melted
           WHERE policy_title IS NOT NULL AND parameter IS NOT NULL GROUP BY policy_title, parameter),
freq AS (SELECT f.pos, f.parameter, f.category, f.subcategory, f.definition,
         coalesce(a.t, 0)::BIGINT AS total_appearances, coalesce(a.d, 0)::BIGINT AS num_docs FROM bfw f
         LEFT JOIN (SELECT parameter, count(*) AS t, count(DISTINCT policy_title) AS d FROM melted
                    WHERE parameter IS NOT NULL GROUP BY parameter) a ON a.parameter = f.parameter),
meta AS (SELECT doc_id AS title, lang, source FROM documents),
cov AS (SELECT m.title, coalesce(p.p, 0)::BIGINT AS total_params_mentioned, coalesce(p.m, 0)::BIGINT AS total_mentions,
        round(coalesce(p.p, 0) / (SELECT count(*) FROM benchmark)::DOUBLE, 6) + 0.0 AS framework_coverage
        FROM meta m LEFT JOIN (SELECT policy_title, count(*) FILTER (WHERE count > 0) AS p, sum(count) AS m
                               FROM counts GROUP BY policy_title) p ON p.policy_title = m.title)"""

_FREQ = "parameter, category, subcategory, definition, total_appearances, num_docs"
_AVG_M = "CASE WHEN num_docs = 0 THEN NULL ELSE total_appearances::DOUBLE / num_docs END"

ORACLE["melt_codes"] = f"WITH {_REVIEW} SELECT policy_title, sentence, variable, parameter FROM melted"
ORACLE["count_codes"] = f"WITH {_REVIEW} SELECT * FROM counts"


ORACLE["parameter_frequency"] = f"WITH {_REVIEW} SELECT {_FREQ} FROM freq"
ORACLE["rollup_frequency"] = (
    f"WITH {_REVIEW} SELECT subcategory, sum(total_appearances)::BIGINT AS total_appearances, "
    "round(avg(num_docs), 6) + 0.0 AS num_docs FROM freq WHERE subcategory IS NOT NULL GROUP BY subcategory"
)


def _ranked_sql(metric: str, asc: bool) -> str:
    d = "ASC" if asc else "DESC"
    return (
        f"WITH {_REVIEW} SELECT {_FREQ}, round({_AVG_M}, 6) + 0.0 AS avg_mentions_per_doc FROM freq "
        f"ORDER BY {metric} {d}, pos LIMIT 10"
    )


ORACLE["top_adopted"] = _ranked_sql("num_docs", False)
ORACLE["bottom_adopted"] = _ranked_sql("num_docs", True)
ORACLE["top_frequent"] = _ranked_sql("total_appearances", False)
ORACLE["mentions_summary"] = (
    f"WITH {_REVIEW} SELECT round(avg({_AVG_M}), 6) + 0.0 AS average_mentions_per_doc, "
    f"count(*) FILTER (WHERE ({_AVG_M}) IS NULL)::BIGINT AS n_undefined FROM freq"
)
ORACLE["mentions_histogram"] = (
    f"WITH {_REVIEW}, mm AS (SELECT round({_AVG_M}, 6) AS m FROM freq), {histogram_sql('mm', 'm', 15)}"
)


def kde_sql(src: str, col: str, gridsize: int = 200, hist_bins: int = 15) -> str:
    return f"""ks AS (SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi, stddev_samp({col}) AS sd FROM {src}),
kp AS (SELECT n, lo, hi, pow(n, -0.2) * sd AS h, (hi - lo) / {gridsize - 1} AS step FROM ks),
kg AS (SELECT range AS point FROM range({gridsize})),
kd AS (SELECT g.point, sum(exp(-(((p.lo + g.point * p.step) - v.{col}) / p.h) * (((p.lo + g.point * p.step) - v.{col}) / p.h) / 2)) AS s
       FROM kg g CROSS JOIN kp p CROSS JOIN (SELECT {col} FROM {src} WHERE {col} IS NOT NULL) v GROUP BY g.point)
SELECT d.point::INTEGER AS point, round(p.lo + d.point * p.step, 6) + 0.0 AS x,
       round(d.s / (p.n * p.h * sqrt(2 * pi())), 6) + 0.0 AS density,
       round(d.s / (p.n * p.h * sqrt(2 * pi())) * (p.n * ((p.hi - p.lo) / {hist_bins})), 6) + 0.0 AS count_density
FROM kd d CROSS JOIN kp p"""


ORACLE["mentions_kde"] = f"WITH {_REVIEW}, mm AS (SELECT round({_AVG_M}, 6) AS m FROM freq), {kde_sql('mm', 'm')}"
ORACLE["quadrants"] = f"""WITH {_REVIEW},
mid AS (SELECT median(num_docs) AS x, median(total_appearances) AS y FROM freq)
SELECT parameter, num_docs, total_appearances,
  CASE WHEN num_docs >= mid.x AND total_appearances >= mid.y THEN 'high breadth, high depth'
       WHEN num_docs >= mid.x THEN 'high breadth, low depth'
       WHEN total_appearances >= mid.y THEN 'low breadth, high depth'
       ELSE 'low breadth, low depth' END AS quadrant
FROM freq, mid"""
ORACLE["quadrant_bounds"] = (
    f"WITH {_REVIEW} SELECT (min(num_docs) - 0.5)::DOUBLE AS x_min, (max(num_docs) + 0.5)::DOUBLE AS x_max, "
    "(min(total_appearances) - 1)::BIGINT AS y_min, (max(total_appearances) + 2)::BIGINT AS y_max FROM freq"
)
ORACLE["coverage_by_doc"] = f"WITH {_REVIEW} SELECT * FROM cov"
ORACLE["coverage_avg"] = f"""WITH {_REVIEW}
SELECT 'total_params_mentioned' AS metric, round(avg(total_params_mentioned), 6) + 0.0 AS average_value FROM cov
UNION ALL SELECT 'total_mentions', round(avg(total_mentions), 6) + 0.0 FROM cov
UNION ALL SELECT 'framework_coverage', round(avg(framework_coverage), 6) + 0.0 FROM cov"""
ORACLE["coverage_by_dim"] = f"""WITH {_REVIEW},
cl AS (SELECT 'lang' AS dimension, m.lang AS value, c.framework_coverage FROM cov c JOIN meta m ON m.title = c.title
       UNION ALL SELECT 'source', m.source, c.framework_coverage FROM cov c JOIN meta m ON m.title = c.title)
SELECT dimension, value, count(*)::BIGINT AS n_docs, round(avg(framework_coverage), 6) + 0.0 AS mean_coverage
FROM cl WHERE value IS NOT NULL GROUP BY dimension, value"""
ORACLE["coverage_vs_length"] = f"""WITH {_REVIEW}
SELECT c.title, z.corpus_size, c.framework_coverage FROM cov c JOIN csize z ON z.doc_id = c.title"""
ORACLE["distribution_by_dim"] = f"""WITH {_REVIEW},
dd AS (SELECT title, 'lang' AS dimension, lang AS value FROM meta WHERE lang IS NOT NULL
       UNION ALL SELECT title, 'source', source FROM meta WHERE source IS NOT NULL),
sums AS (SELECT d.dimension, d.value, c.parameter, sum(c.count) AS n FROM counts c JOIN dd d ON d.title = c.policy_title
         GROUP BY d.dimension, d.value, c.parameter),
grid AS (SELECT v.dimension, v.value, f.parameter FROM (SELECT DISTINCT dimension, value FROM dd) v CROSS JOIN bfw f),
dgrid AS (SELECT g.dimension, g.value, g.parameter, coalesce(s.n, 0)::BIGINT AS n FROM grid g
         LEFT JOIN sums s ON s.dimension = g.dimension AND s.value = g.value AND s.parameter = g.parameter)
SELECT dimension, value, parameter, n,
  round(CASE WHEN sum(n) OVER (PARTITION BY dimension, value) = 0 THEN NULL
             ELSE n * 100.0 / sum(n) OVER (PARTITION BY dimension, value) END, 6) + 0.0 AS pct
FROM dgrid"""


def doc_matrix_sql(parameters: list[str]) -> str:
    cols = ", ".join(f"coalesce(max(CASE WHEN parameter = '{p}' THEN count END), 0)::BIGINT AS {p}" for p in parameters)
    return f"""WITH {_REVIEW},
wide AS (SELECT policy_title, {cols} FROM counts GROUP BY policy_title),
sizes AS (SELECT DISTINCT policy_title, corpus_size FROM review)
SELECT m.title, m.lang, m.source, z.corpus_size, {', '.join('w.' + p for p in parameters)}
FROM meta m LEFT JOIN sizes z ON z.policy_title = m.title LEFT JOIN wide w ON w.policy_title = m.title"""

ORACLE["adherence_with_metadata"] = f"""WITH {SV}, {QV}, {FW}, {SCORES}, {MATCHES}, {DOCS}, {_adh(str(T))},
long AS (SELECT a.doc, f.parameter, a.adheres::BIGINT AS adheres FROM adh a JOIN fw f ON f.query_id = a.query_id),
wide AS (SELECT doc, {_pivot('adheres', sorted(parameter_names()), '0')} FROM long GROUP BY doc)
SELECT m.doc_id AS title, m.lang, m.source, {', '.join('w.' + p for p in sorted(parameter_names()))}
FROM documents m LEFT JOIN wide w ON w.doc = m.doc_id"""

_WC = f"wc AS (SELECT {word_count_sql('text')}::DOUBLE AS word_count FROM documents)"
ORACLE["word_count_histogram"] = f"WITH {_WC}, {histogram_sql('wc', 'word_count', 30)}"
ORACLE["word_count_boxplot"] = f"WITH {_WC}, {boxplot_sql('wc', 'word_count')}"
ORACLE["word_count_kde"] = f"WITH {_WC}, {kde_sql('wc', 'word_count', 200, 30)}"

ORACLE["label_code_matrix"] = """WITH long AS (SELECT doc_id, parameter FROM labels UNPIVOT (flag FOR parameter IN (quality, toxic)) WHERE flag = 1),
counts AS (SELECT doc_id, parameter, count(*)::BIGINT AS count FROM long GROUP BY doc_id, parameter),
wide AS (SELECT doc_id, coalesce(sum(CASE WHEN parameter = 'quality' THEN count END), 0)::BIGINT AS quality,
                coalesce(sum(CASE WHEN parameter = 'toxic' THEN count END), 0)::BIGINT AS toxic FROM counts GROUP BY doc_id)
SELECT d.doc_id AS title, d.lang, d.source, w.quality, w.toxic FROM documents d LEFT JOIN wide w ON w.doc_id = d.doc_id"""

ORACLE["extraction_table"] = f"""WITH {sparse_topk_sql(_BENCH, ['query_id'])},
csz AS (SELECT doc_id, count(*)::BIGINT AS corpus_size FROM sents GROUP BY doc_id)
SELECT r.doc_id AS policy_title, c.corpus_size, r.query_id, printf('i%03d', r.query_id) AS parameter,
       CASE WHEN r.query_id % 5 < 3 THEN 'c0' ELSE 'c1' END AS category, b.text AS query,
       r.rank::BIGINT AS sentence_rank, r.score AS sentence_score, s.sentence, r.sentence_index
FROM ranked r JOIN sents s ON s.doc_id = r.doc_id AND s.sentence_index = r.sentence_index
JOIN csz c ON c.doc_id = r.doc_id JOIN benchmark b ON b.item_id = r.query_id"""

ORACLE["hierarchy_rollup"] = f"""WITH {_REVIEW}
SELECT CASE grouping(category, subcategory, parameter) WHEN 0 THEN 'parameter' WHEN 1 THEN 'subcategory'
            WHEN 3 THEN 'category' ELSE 'total' END AS level,
       category, subcategory, parameter, sum(total_appearances)::BIGINT AS total_appearances,
       round(avg(num_docs), 6) + 0.0 AS num_docs
FROM freq GROUP BY ROLLUP (category, subcategory, parameter)"""

_CODED = "mt AS (SELECT policy_title, parameter, sentence AS text FROM melted)"
_CODED_K = "mk AS (SELECT policy_title, parameter, sentence AS text FROM melted WHERE parameter IS NOT NULL)"
ORACLE["coded_top_terms"] = f"WITH {_REVIEW}, {_CODED} {top_sql(words_sql('mt'), 20)}"
ORACLE["coded_terms_by_parameter"] = f"WITH {_REVIEW}, {_CODED_K} {top_sql(words_sql('mk', 'parameter'), 20, 'parameter')}"
ORACLE["coded_top_phrases"] = f"WITH {_REVIEW}, {_CODED} {top_sql(phrases_sql(src='mt'), 50, term='phrase')}"
ORACLE["coded_phrases_by_parameter"] = (
    f"WITH {_REVIEW}, {_CODED_K} {top_sql(phrases_sql('parameter', src='mk'), 20, 'parameter', term='phrase')}"
)


# ---------------------------------------------------------------- learned sentence boundaries


def _core_sql(t: str) -> str:
    return f"regexp_replace({t}, '{B.EDGES.replace(chr(39), chr(39) * 2)}', '', 'g')"


def _token_sql(t: str) -> str:
    """Struct of what a token is: type, period, sure end, shape."""
    c = _core_sql(t)
    bare = f"regexp_replace({c}, '\\.$', '')"
    return (
        f"{{'type': CASE WHEN regexp_matches({bare}, '{B.NUMBER}') THEN '{B.NUMBERS}' ELSE lower({bare}) END, "
        f"'period': regexp_matches({c}, '[^.]\\.$'), 'sure': regexp_matches({t}, '{B.SURE_END}'), "
        f"'shape': CASE WHEN regexp_matches({c}, '^\\p{{Lu}}') THEN 'upper' WHEN regexp_matches({c}, '^\\p{{Ll}}') THEN 'lower' ELSE 'none' END}}"
    )


def _words_sql(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}+'), lambda w: w <> '')"


def _xlog(n: str, p: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0 ELSE {n} * ln(greatest({p}, 1e-300)) END)"


def _llr_sql(a: str, b: str, ab: str, n: str) -> str:
    p, p1, p2 = f"({b}) / ({n})", f"({ab}) / ({a})", f"(({b}) - ({ab})) / (({n}) - ({a}))"
    counts = [f"({ab})", f"(({a}) - ({ab}))", f"(({b}) - ({ab}))", f"(({n}) - ({a}) - ({b}) + ({ab}))"]
    same = " + ".join(_xlog(c, q) for c, q in zip(counts, (p, f"1 - {p}", p, f"1 - {p}")))
    apart = " + ".join(_xlog(c, q) for c, q in zip(counts, (p1, f"1 - {p1}", p2, f"1 - {p2}")))
    return f"-2 * (({same}) - ({apart}))"


_BOUNDARY_MODEL = f"""tok AS MATERIALIZED (SELECT {_token_sql('a')} AS a, CASE WHEN b IS NOT NULL THEN {_token_sql('b')} END AS b FROM
 (SELECT unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b FROM (SELECT {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0)),
cnt AS MATERIALIZED (SELECT a.type AS type, count_if(a.period)::BIGINT AS n_with, count_if(NOT a.period)::BIGINT AS n_without, count_if(a.shape = 'lower')::BIGINT AS n_lower FROM tok GROUP BY 1),
tot AS (SELECT sum(n_with + n_without)::DOUBLE AS n, sum(n_with)::DOUBLE AS np FROM cnt),
abb AS MATERIALIZED (SELECT type, n_with AS n, score FROM (SELECT c.*, length(replace(type, '.', '')) AS bare,
  -2 * ({_xlog('n_with', 'np / tot.n')} + {_xlog('n_without', '1 - np / tot.n')} - {_xlog('n_with', '0.99')} - {_xlog('n_without', '1 - 0.99')})
  * exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1) * pow(length(replace(type, '.', ''))::DOUBLE, -n_without) AS score
  FROM cnt c, tot WHERE n_with > 0 AND regexp_matches(type, '\\p{{L}}') AND type <> '{B.NUMBERS}') WHERE score >= {B.ABBREVIATION}),
seen AS (SELECT tok.a AS a, tok.b AS b, x.type IS NOT NULL AS abbr, tok.a.period AND regexp_matches(tok.a.type, '^\\p{{L}}$') AS ini, tok.a.period AND tok.a.type = '{B.NUMBERS}' AS num
  FROM tok LEFT JOIN abb x ON x.type = tok.a.type WHERE tok.b IS NOT NULL),
aft AS MATERIALIZED (SELECT a.type AS type, b.type AS next, count_if(a.sure OR (a.period AND NOT abbr AND NOT ini AND NOT num))::BIGINT AS n_end,
  count_if(a.period AND (abbr OR ini OR num))::BIGINT AS n_weak, count_if(b.shape = 'upper' AND NOT a.period AND NOT a.sure)::BIGINT AS n_upper FROM seen GROUP BY 1, 2),
nxt AS MATERIALIZED (SELECT next, sum(n_end)::BIGINT AS n_end, sum(n_upper)::BIGINT AS n_upper FROM aft GROUP BY next),
ends AS (SELECT sum(n_end)::DOUBLE AS ne FROM nxt),
siz AS (SELECT type, n_with + n_without AS nt, n_lower FROM cnt),
sta AS MATERIALIZED (SELECT type, n, score FROM (SELECT z.type, x.n_end AS n, {_llr_sql('ne', 'nt', 'x.n_end', 'tot.n')} AS score, x.n_end * tot.n > nt * ne AS more
  FROM nxt x JOIN siz z ON z.type = x.next, tot, ends WHERE x.n_end > 0 AND regexp_matches(x.next, '\\p{{L}}')) WHERE score >= {B.STARTER} AND more),
col AS MATERIALIZED (SELECT type, next, n, score FROM (SELECT x.type, x.next, x.n_weak AS n, {_llr_sql('z.nt', 'y.nt', 'x.n_weak', 'tot.n')} AS score, x.n_weak * tot.n > z.nt * y.nt AS more
  FROM aft x JOIN siz z ON z.type = x.type JOIN siz y ON y.type = x.next, tot WHERE x.n_weak > 1 AND regexp_matches(x.next, '\\p{{L}}')) WHERE score >= {B.COLLOCATION} AND more)"""

ORACLE["boundary_model"] = f"""WITH {_BOUNDARY_MODEL}
SELECT 'abbreviation' AS kind, type, NULL::VARCHAR AS next, n, {_r('score')} AS score FROM abb UNION ALL
SELECT 'starter', type, NULL, n, {_r('score')} FROM sta UNION ALL SELECT 'collocation', type, next, n, {_r('score')} FROM col"""

_PIECES_SQL = (
    f"string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{TRIM}', '', 'g'), "
    f"'{SENTENCE_END[:-1].removesuffix(WS)}({WS}+)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
)

ORACLE["sentences_trained"] = f"""WITH {_BOUNDARY_MODEL},
pie AS (SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS i, unnest(list_append(p[2:], NULL)) AS follow FROM (SELECT doc_id, {_PIECES_SQL} AS p FROM documents)),
des AS (SELECT doc_id, piece, i, CASE WHEN len(w) > 0 THEN {_token_sql('w[-1]')} END AS a, CASE WHEN len(v) > 0 THEN {_token_sql('v[1]')} END AS b
  FROM (SELECT *, {_words_sql('piece')} AS w, {_words_sql('follow')} AS v FROM pie)),
bnd AS (SELECT doc_id, piece, i, CASE WHEN d.a.sure OR NOT d.a.period THEN 1 WHEN c.type IS NOT NULL THEN 0
  WHEN x.type IS NOT NULL THEN (d.b.shape = 'upper' AND (s.type IS NOT NULL OR (coalesce(z.n_lower, 0) > 0 AND coalesce(n.n_upper, 0) = 0)))::INT
  WHEN regexp_matches(d.a.type, '^\\p{{L}}$') THEN (NOT (d.b.shape = 'upper' AND coalesce(z.n_lower, 0) = 0))::INT
  WHEN d.a.type = '{B.NUMBERS}' THEN (d.b.shape <> 'lower')::INT ELSE 1 END AS e
  FROM des d LEFT JOIN abb x ON x.type = d.a.type LEFT JOIN col c ON c.type = d.a.type AND c.next = d.b.type LEFT JOIN sta s ON s.type = d.b.type
  LEFT JOIN siz z ON z.type = d.b.type LEFT JOIN nxt n ON n.next = d.b.type),
num AS (SELECT doc_id, piece, i, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence_index FROM bnd)
SELECT * FROM (SELECT doc_id, sentence_index, regexp_replace(string_agg(piece, '' ORDER BY i), '{TRIM}', '', 'g') AS sentence FROM num GROUP BY doc_id, sentence_index) WHERE sentence <> ''"""


# ---------------------------------------------------------------- whole tokens, tags, chunks, lemmas

_TOKEN_SQL = TOKEN.replace("'", "''")
_ALPHA = "'^\\p{L}+$'"
ORACLE["term_frequency_whole"] = f"""WITH {_lemma_values()},
t AS (SELECT lower(unnest(list_filter(regexp_extract_all(text, '{_TOKEN_SQL}'), lambda w: regexp_matches(w, {_ALPHA})))) AS surface FROM documents)
SELECT term, count(*)::BIGINT AS n FROM (SELECT coalesce(l.lemma, t.surface) AS term, l.pos AS tag FROM t LEFT JOIN lem l ON l.surface = t.surface
 WHERE length(t.surface) >= 4 AND NOT list_contains({_lit_list(ENGLISH_STOPWORDS)}, t.surface))
WHERE NOT list_contains({_lit_list(CUSTOM_STOPWORDS)}, term) AND (tag IS NULL OR list_contains({_lit_list(CONTENT_POS)}, tag)) GROUP BY term"""

_TAG_CASE = (
    "CASE WHEN NOT regexp_matches(w, " + _ALPHA + ") THEN CASE WHEN regexp_matches(w, '^[0-9]') THEN 'NUM' ELSE 'PUNCT' END "
    + " ".join(f"WHEN lower(w) = '{x}' THEN '{p}'" for x, p, _ in LEMMA_ROWS)
    + " " + " ".join(f"WHEN ends_with(lower(w), '{e}') THEN '{p}'" for e, p in TAG_ENDINGS)
    + " WHEN length(w) <= 3 THEN 'DET' ELSE 'PROPN' END"
)
_TAGGED = f"""{SENTS},
toks AS (SELECT doc_id, sentence_index, regexp_extract_all(sentence, '{_TOKEN_SQL}') AS tokens FROM sents),
tagged AS MATERIALIZED (SELECT doc_id, sentence_index, position, w, lower(w) AS word, {_TAG_CASE} AS tag FROM
 (SELECT doc_id, sentence_index, unnest(tokens) AS w, unnest(range(len(tokens))) AS position FROM toks))"""

ORACLE["tag_counts"] = f"""WITH {_TAGGED},
marks AS (SELECT doc_id, sentence_index, position, tag FROM tagged UNION ALL SELECT doc_id, sentence_index, max(position) + 1, '</s>' FROM tagged GROUP BY ALL),
three AS (SELECT coalesce(lag(tag, 2) OVER w, '<s>') AS a, coalesce(lag(tag) OVER w, '<s>') AS b, tag AS c FROM marks WINDOW w AS (PARTITION BY doc_id, sentence_index ORDER BY position)),
words AS (SELECT word, tag, count(*)::BIGINT AS n FROM tagged GROUP BY ALL),
rare AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY word) AS total FROM words) WHERE total <= 10),
suf AS (SELECT right(word, i) AS suffix, tag, n FROM (SELECT *, unnest(range(1, least(length(word), 10) + 1)) AS i FROM rare))
SELECT 'trigram' AS kind, a, b, c, count(*)::BIGINT AS n FROM three GROUP BY a, b, c UNION ALL
SELECT 'word', word, tag, NULL, n FROM words UNION ALL SELECT 'suffix', suffix, tag, NULL, sum(n)::BIGINT FROM suf GROUP BY suffix, tag"""

ORACLE["noun_chunk_phrases"] = f"""WITH {_TAGGED}, {_lemma_values()},
cls AS (SELECT *, CASE WHEN tag IN ('NOUN', 'PROPN') THEN 'N' WHEN tag IN ('DET', 'ADJ', 'NUM') THEN 'M' ELSE 'x' END AS s FROM tagged),
cut AS (SELECT *, CASE WHEN s = 'x' OR lag(s) OVER v = 'x' OR (s = 'M' AND lag(s) OVER v = 'N') THEN 1 ELSE 0 END AS o FROM cls WINDOW v AS (PARTITION BY doc_id, sentence_index ORDER BY position)),
run AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, sentence_index ORDER BY position) AS r FROM cut),
chk AS (SELECT *, count_if(s = 'N') OVER (PARTITION BY doc_id, sentence_index, r) AS nouns FROM run),
kep AS (SELECT c.doc_id, c.sentence_index, c.r, c.position, lower(coalesce(l.lemma, c.word)) AS term FROM chk c LEFT JOIN lem l ON l.surface = c.word
 WHERE nouns > 0 AND regexp_matches(c.w, {_ALPHA}) AND length(c.w) >= 3 AND NOT list_contains({_lit_list(ENGLISH_STOPWORDS)}, c.word)),
two AS (SELECT doc_id, sentence_index, r, string_agg(term, ' ' ORDER BY position) AS phrase FROM kep WHERE NOT list_contains({_lit_list(CUSTOM_STOPWORDS)}, term)
 GROUP BY ALL HAVING count(*) = 2)
SELECT lang, phrase, count(*)::BIGINT AS n FROM two JOIN documents USING (doc_id) GROUP BY lang, phrase"""

_LEMMA_RULES = f"""{_lemma_values()},
own AS (SELECT DISTINCT unnest({letters_sql('text')}) AS surface FROM benchmark),
prs AS (SELECT o.surface, coalesce(l.lemma, regexp_replace(o.surface, '(es|s|ly|ns)$', '')) AS lemma FROM own o LEFT JOIN lem l ON l.surface = o.surface),
cmn AS (SELECT surface, lemma, coalesce(list_min(list_filter(range(1, least(length(surface), length(lemma)) + 1), lambda i: substr(surface, i, 1) <> substr(lemma, i, 1))) - 1,
 least(length(surface), length(lemma))) AS k FROM prs),
scr AS (SELECT list_distinct(list_concat(['', '^' || surface], list_transform(range(1, least(length(surface), 10) + 1), lambda i: right(surface, i)))) AS sx,
 (length(surface) - k)::INTEGER AS cut, substr(lemma, k + 1) AS added FROM cmn),
cnt AS (SELECT suffix, cut, added, count(*)::BIGINT AS n FROM (SELECT unnest(sx) AS suffix, cut, added FROM scr) GROUP BY ALL),
rul AS (SELECT suffix, cut, added, n FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, added) AS r FROM cnt) WHERE r = 1)"""
ORACLE["lemma_rules"] = f"WITH {_LEMMA_RULES} SELECT suffix, cut, added, n FROM rul"
ORACLE["learned_lemmas"] = f"""WITH {_LEMMA_RULES},
typ AS (SELECT DISTINCT unnest({letters_sql('text')}) AS word FROM documents),
tri AS (SELECT word, unnest(list_distinct(list_concat(['', '^' || word], list_transform(range(1, least(length(word), 10) + 1), lambda i: right(word, i))))) AS suffix FROM typ),
hit AS (SELECT t.word, arg_max(left(t.word, (length(t.word) - u.cut)::INTEGER) || u.added, length(u.suffix)) AS lemma FROM tri t JOIN rul u USING (suffix) WHERE u.cut <= length(t.word) GROUP BY t.word)
SELECT word, coalesce(lemma, word) AS lemma FROM typ LEFT JOIN hit USING (word)"""


# ---------------------------------------------------------------- bootstrap, time, round trips

_UNIFORM = "('0x' || substr(md5(concat_ws('|', coalesce(lang, ''), (round(x * 1e6)::BIGINT)::VARCHAR, rep::VARCHAR, '0')), {at}, 12))::BIGINT::DOUBLE / 281474976710656.0"
ORACLE["coverage_bootstrap"] = f"""WITH {_REVIEW},
cells AS (SELECT m.lang, c.framework_coverage AS x, count(c.framework_coverage)::DOUBLE AS c FROM cov c JOIN meta m ON m.title = c.title GROUP BY ALL),
reps AS (SELECT *, {_UNIFORM.format(at=1)} AS u, {_UNIFORM.format(at=13)} AS v FROM (SELECT *, unnest(range(0, 201)) AS rep FROM cells)),
drawn AS (SELECT *, CASE WHEN c = 0 THEN 0 WHEN rep = 0 THEN c
  WHEN c <= 30 THEN (SELECT count(*) FROM (SELECT sum(exp(-c + k * ln(c) - lgamma(k + 1.0))) OVER (ORDER BY k) AS p FROM (SELECT unnest(range(0, 121)) AS k)) WHERE p <= u)
  ELSE greatest(floor(c + sqrt(c) * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) + 0.5), 0) END AS w FROM reps),
per AS (SELECT lang, rep, sum(w * x) / nullif(sum(w), 0) AS m, sum(w)::BIGINT AS n FROM drawn GROUP BY ALL)
SELECT lang, max(n) FILTER (rep = 0) AS n, {_r('max(m) FILTER (rep = 0)')} AS mean, {_r('quantile_cont(m, 0.025) FILTER (rep > 0)')} AS lo,
 {_r('quantile_cont(m, 0.975) FILTER (rep > 0)')} AS hi FROM per GROUP BY lang"""

ORACLE["coverage_over_time"] = """WITH c AS (SELECT l_orderkey AS title, round(count_if(l_returnflag = 'R') / count(*), 6) + 0.0 AS framework_coverage FROM lineitem GROUP BY 1)
SELECT title, o_orderdate::DATE AS date, framework_coverage FROM c JOIN orders ON o_orderkey = title WHERE o_orderdate IS NOT NULL AND o_custkey % 10 <> 0"""
ORACLE["csv_round_trip"] = "SELECT doc_id, text, lang, source FROM documents"
ORACLE["json_round_trip"] = """SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, 'i' || item_id AS parameter, 'c' AS category, (item_id % 4)::VARCHAR AS subcategory, text AS definition,
 array_to_string(list_sort(list_distinct(string_split(lower(text), ' ')))[1:3], '; ') AS keywords FROM benchmark"""
ORACLE["text_round_trip"] = f"""SELECT item_id, 'item_and_no_' || item_id || '.txt' AS file_name, regexp_replace(text, '\r\n?', chr(10), 'g') AS raw_text, {word_count_sql('text')} AS word_count FROM benchmark"""
ORACLE["parquet_round_trip"] = f"SELECT doc_id, len({sent_arr('text')})::BIGINT AS corpus_size, lang FROM documents"
ORACLE["unmatched_documents"] = """SELECT 'left_only' AS side, doc_id AS key FROM documents ANTI JOIN labels USING (doc_id) UNION ALL
SELECT DISTINCT 'right_only', doc_id FROM labels ANTI JOIN documents USING (doc_id)"""
_LETTERS_VEC = "list_transform(range(97, 123), lambda c: (length({t}) - length(replace({t}, chr(c::INTEGER), '')))::DOUBLE)"
ORACLE["topk_text"] = f"""WITH {SENTS},
s AS (SELECT doc_id, sentence_index, {_LETTERS_VEC.format(t='sentence')} AS v FROM sents), q AS (SELECT item_id AS query_id, {_LETTERS_VEC.format(t='text')} AS v FROM benchmark),
sc AS (SELECT doc_id, query_id, sentence_index, {_cos('s.v', 'q.v')} AS score FROM s CROSS JOIN q)
SELECT doc_id, query_id, rank::BIGINT AS rank, score, sentence_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, query_id ORDER BY score DESC, sentence_index) AS rank FROM sc) WHERE rank = 1"""
