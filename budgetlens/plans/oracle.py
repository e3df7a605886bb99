"""The queries in DuckDB's SQL, composed of common table expressions."""

from __future__ import annotations

from .. import schema as S
from ..functions import text as X
from .models import ALPHABET, SAYS
from .queries import ANSWERS, CAPPED_DOCS, CAPPED_HOPS, CAPPED_ROWS, FLOOR, KB, SAMPLE, VIEW_RECALL

_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}" for v in r) + ")" for r in rows)
_strategies = lambda rows: f"SELECT * FROM (VALUES {_values([(i + 1, *r) for i, r in enumerate(rows)])}) AS t(level, name, method, k)"
_scaled = lambda x: f"CAST(round(({x}) * 1e9) AS BIGINT)"
_h16 = lambda x: f"CAST('0x' || substr(md5({x}), 1, 4) AS BIGINT)"

_PATTERN = X.TOKEN.replace("'", "''")
_ALL = f"regexp_extract_all(lower({{}}), '{_PATTERN}')"
_TOKENS = f"list_filter({_ALL}, lambda t: length(t) > 1 AND t NOT IN ({_quoted(X.STOPWORDS)}))"
_HEAD = "array_to_string(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')[1:48], ' ')"
_SEEDED = "md5('42:' || CAST({} AS VARCHAR))"
_GRID = tuple((f"{m}@{k}", m, k) for m in ("dense", "hybrid", "rerank") for k in S.KS)
_LETTERS = ", ".join(f"(length({{t}}) - length(replace({{t}}, '{c}', '')))::DOUBLE" for c in ALPHABET)
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY {})"


def _cov(rows: S.Strategies) -> str:
    return f"""
SELECT g.qid, s.level, s.name, s.method, s.k, count(h.doc_id) FILTER (WHERE r.doc_id IS NOT NULL) AS n_hit, g.n_gold, count(h.doc_id) AS n_docs
FROM golds g CROSS JOIN ({_strategies(rows)}) s
LEFT JOIN runs h ON h.qid = g.qid AND h.method = s.method AND h.rank <= s.k
LEFT JOIN gold r ON r.qid = g.qid AND r.doc_id = h.doc_id
GROUP BY ALL"""


def _covered(name: str, rows: S.Strategies) -> dict[str, str]:
    return {f"{name}_n": _cov(rows), name: f"SELECT c.*, n_hit / n_gold AS cov, n_hit = n_gold AS \"full\", q.dataset, q.grp FROM {name}_n c JOIN (SELECT qid, dataset, grp FROM questions) q USING (qid)"}


def _stop(name: str) -> str:
    return f"SELECT c.* FROM {name} c JOIN (SELECT qid, coalesce(min(level) FILTER (WHERE \"full\"), max(level)) AS level FROM {name} GROUP BY qid) USING (qid, level)"


def _pick(name: str) -> str:
    return f"SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY \"full\" DESC, cov DESC, level) = 1"


def _short(c: str, most_rows: int, most_docs: int) -> dict[str, str]:
    """The short form under two caps; c is the ending of the expressions' names."""
    return {
        f"short_spans{c}": f"SELECT *, list_filter(spans, lambda x: x.a >= 0 AND x.b > x.a)[1] AS s, CASE WHEN silent THEN '' ELSE array_to_string(w[1:8], ' ') END AS question FROM short_raw WHERE n <= {most_rows} AND len(w) > 0",
        f"short_answers{c}": rf"""
SELECT n, w, question, coalesce(nullif(CASE WHEN s IS NOT NULL THEN regexp_replace(array_to_string(w[s.a + 1:s.b], ' '), '^\s+|\s+$', '', 'g') END, ''),
  CASE WHEN la >= 0 AND lb > la THEN regexp_replace(array_to_string(w[la + 1:lb], ' '), '^\s+|\s+$', '', 'g') ELSE '' END) AS answer FROM short_spans{c} WHERE question <> ''""",
        f"short_good{c}": f"SELECT *, format('{{:06d}}', n) AS code FROM short_answers{c} WHERE length(answer) >= 2 ORDER BY n LIMIT {most_docs}",
    }


def _hops(c: str, most_rows: int) -> dict[str, str]:
    return {
        f"hop_each{c}": f"""
SELECT n, conv_id, gold, row_number() OVER (ORDER BY n, i) - 1 AS place, 't' || (t[i].turn % 3) AS title, CASE WHEN conv_id % 4 = 0 AND i = len(t) THEN '' ELSE array_to_string(string_split(t[i].text, '. '), ' ') END AS text
FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM hop_raw WHERE n <= {most_rows})""",
        f"hop_gold{c}": f"SELECT format('hotpot_{{:06d}}', n) AS qid, format('hp_{{:06d}}', place) AS doc_id FROM hop_each{c} WHERE list_contains(gold, title)",
        f"hop_questions{c}": f"""
SELECT format('hotpot_{{:06d}}', n) AS qid, t[1].text AS question, t[1].role AS answer, CASE WHEN conv_id % 2 = 0 THEN 'bridge' ELSE 'comparison' END AS type, len(gold) AS n_sent, gold_docs, n_supporting
FROM hop_raw JOIN (SELECT qid, string_agg(doc_id, ',' ORDER BY doc_id) AS gold_docs, count(*) AS n_supporting FROM hop_gold{c} GROUP BY qid) g ON g.qid = format('hotpot_{{:06d}}', n)""",
    }


CTES: dict[str, str] = {
    "asking": """
SELECT 'd' || doc_id AS qid, 'doc' AS dataset, array_to_string(string_split(text, ' ')[4:13], ' ') AS question, lang AS grp FROM documents WHERE doc_id % 50 = 0
UNION ALL SELECT 'b' || item_id, 'bench', array_to_string(string_split(text, ' ')[1:10], ' '), 'bench' FROM benchmark""",
    "qrels": """
SELECT 'd' || a.doc_id AS qid, d.doc_id FROM documents a JOIN documents d USING (text) WHERE a.doc_id % 50 = 0
UNION ALL SELECT 'b' || item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
    "gold": "SELECT DISTINCT qid, doc_id FROM qrels",
    "golds": "SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid",
    "questions": "SELECT a.*, n_gold FROM asking a JOIN golds USING (qid)",
    "tokens": f"SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents",
    "size": "SELECT count(*) AS n, coalesce(sum(len(t)), 0) / count(*) AS avgdl FROM tokens",
    "postings": "SELECT doc_id, len(t) AS dl, u.term, count(*) AS tf FROM tokens, unnest(t) AS u(term) GROUP BY doc_id, dl, u.term",
    "raw_idf": "SELECT term, count(*) AS df, ln(max(n)::DOUBLE - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM postings, size GROUP BY term",
    "idf": f"SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT sum({_scaled('raw')})::DOUBLE / count(*) / 1e9 FROM raw_idf) ELSE raw END AS idf FROM raw_idf",
    "asked": f"SELECT qid, u.term, count(*) AS qtf FROM questions, unnest({_TOKENS.format('question')}) AS u(term) GROUP BY qid, u.term",
    "bm25_scores": f"""
SELECT qid, doc_id, sum({_scaled('qtf * idf * (tf::DOUBLE * (1.5::DOUBLE + 1) / (tf::DOUBLE + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl::DOUBLE / avgdl)))')})::BIGINT AS score
FROM asked JOIN idf USING (term) JOIN postings USING (term), size GROUP BY qid, doc_id HAVING score > 0""",
    "bm25": f"SELECT qid, doc_id, {_RANK.format('score DESC, doc_id')} AS rank, score FROM bm25_scores QUALIFY rank <= 200",
    "doc_cells": f"SELECT doc_id, {_h16('term')} % 256 AS cell, sum(tf)::DOUBLE AS w FROM postings GROUP BY doc_id, cell",
    "norms": "SELECT doc_id, sqrt(sum(w * w)) AS norm FROM doc_cells GROUP BY doc_id",
    "query_cells": f"SELECT qid, {_h16('term')} % 256 AS cell, sum(qtf)::DOUBLE AS w FROM asked GROUP BY qid, cell",
    "dense_scores": f"SELECT qid, doc_id, {_scaled('sum(q.w * d.w) / any_value(norm)')} AS score FROM query_cells q JOIN doc_cells d USING (cell) JOIN norms USING (doc_id) GROUP BY qid, doc_id",
    "dense200": f"SELECT qid, doc_id, {_RANK.format('score DESC, doc_id')} AS rank, score FROM dense_scores QUALIFY rank <= 200",
    "fused": "SELECT qid, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid, doc_id, rank FROM dense200 UNION ALL SELECT qid, doc_id, rank FROM bm25) GROUP BY qid, doc_id",
    "hybrid": f"SELECT qid, doc_id, {_RANK.format('score DESC, doc_id')} AS rank, score FROM fused QUALIFY rank <= 20",
    "pairs": "SELECT qid, string_split(lower(question), ' ') AS w FROM questions",
    "pair_scores": """
SELECT h.qid, h.doc_id, h.rank AS before, CASE WHEN len(w) > 1 THEN len(list_filter(range(1, len(w)), lambda i: contains(lower(text), w[i] || ' ' || w[i + 1])))::DOUBLE / (len(w) - 1) ELSE 0.0::DOUBLE END AS score
FROM hybrid h JOIN pairs USING (qid) JOIN documents USING (doc_id)""",
    "reranked": f"SELECT qid, doc_id, {_RANK.format('score DESC, before')} AS rank, score FROM pair_scores QUALIFY rank <= 20",
    "runs": "SELECT 'dense' AS method, qid, doc_id, rank FROM dense200 WHERE rank <= 20 UNION ALL SELECT 'hybrid', qid, doc_id, rank FROM hybrid UNION ALL SELECT 'rerank', qid, doc_id, rank FROM reranked",
    **_covered("cov7", S.STRATEGIES7),
    **_covered("cov8", S.STRATEGIES8),
    **_covered("covg", _GRID),
    **_covered("cova", S.LADDER_A),
    **_covered("covb", S.LADDER_B),
    **_covered("covl", S.LADDER_3),
    "best": "SELECT g.qid, g.doc_id, min(rank) AS best FROM gold g LEFT JOIN runs r USING (qid, doc_id) GROUP BY ALL",
    "difficulty": "SELECT qid, CASE WHEN bool_and(coalesce(best <= 3, false)) THEN 'easy' WHEN bool_and(coalesce(best <= 10, false)) THEN 'medium' ELSE 'hard' END AS difficulty FROM best GROUP BY qid",
    "ms": f"SELECT * FROM (VALUES {_values(tuple(S.STAGE_MS.items()))}) AS t(method, ms)",
    "users": "SELECT 'c' || conv_id || '-' || turn AS qid, text AS question FROM conversations WHERE role = 'user' UNION ALL SELECT qid, question FROM questions",
    # word boundaries that know all letters: what may stand around a run is doubled, so that two runs can share it
    "counted": r"""
SELECT qid, lower(question) AS low, len(regexp_extract_all(lower(question), '[a-z0-9]+')) AS n_words,
  len(regexp_extract_all(regexp_replace(question, '([^\p{L}\p{Nd}_])', '\1\1', 'g'), '(^|[^\p{L}\p{Nd}_])[A-Z][a-z]+(\s+[A-Z][a-z]+)*($|[^\p{L}\p{Nd}_])')) AS n_entities
FROM users""",
    "ruled": f"""
SELECT qid, n_words, n_entities, CASE WHEN n_words >= 18 THEN 'hard' WHEN {' OR '.join(f"contains(low, '{w}')" for w in X.COMPARISON)} THEN 'medium'
  WHEN n_words >= 10 AND ({' OR '.join(f"contains(low, '{w}')" for w in X.CONJUNCTIONS)}) AND n_entities >= 2 THEN 'medium' ELSE 'easy' END AS label
FROM counted""",
    "rule": "SELECT r.* FROM ruled r JOIN questions USING (qid)",
    "stop_a": _stop("cova"),
    "stop_b": _stop("covb"),
    "stop_3": _stop("covl"),
    "heads": f"SELECT doc_id, {_HEAD.format('text')} AS w FROM documents",
    "listed": "SELECT c.qid, c.level, string_agg(w, ' ' ORDER BY rank) AS docs, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ranked FROM covl c JOIN runs r ON r.qid = c.qid AND r.method = c.method AND r.rank <= c.k JOIN heads USING (doc_id) GROUP BY c.qid, c.level",
    "samples": "SELECT c.qid, question, method AS phase, level, k, coalesce(docs, '') AS docs, \"full\"::INT AS label, coalesce(ranked, '') AS ranked, cov FROM covl c JOIN questions USING (qid) LEFT JOIN listed USING (qid, level)",
    "terms": f"SELECT *, list_distinct({_TOKENS.format('question')}) AS asked_terms, {_TOKENS.format('docs')} AS doc_terms FROM samples",
    "scores": f"""
SELECT qid, phase, level, label, 0.7::DOUBLE * coalesce(len(list_filter(asked_terms, lambda t: list_contains(doc_terms, t)))::DOUBLE / nullif(len(asked_terms), 0), 0)
  + 0.3::DOUBLE * (({_h16("qid || ':' || level")} % 1000)::DOUBLE / 999.0::DOUBLE) AS p FROM terms""",
    "configs": f"SELECT config_ord, config, t_dense::DOUBLE AS t_dense, t_hybrid::DOUBLE AS t_hybrid FROM (VALUES {_values(S.configurations())}) AS t(config_ord, config, t_dense, t_hybrid)",
    "wide": "SELECT qid, max(p) FILTER (WHERE phase = 'dense') AS p_dense, max(p) FILTER (WHERE phase = 'hybrid') AS p_hybrid FROM scores GROUP BY qid",
    "stops": f"""
SELECT s.*, c.method, c.k, c.cov, c."full", ms.ms + {S.CRITIC_MS}::DOUBLE * s.level AS ms, s.level < 3 AND NOT c."full" AS fes
FROM (SELECT qid, config_ord, config, t_dense, t_hybrid, CASE WHEN p_dense >= t_dense THEN 1 WHEN p_hybrid >= t_hybrid THEN 2 ELSE 3 END AS level FROM wide CROSS JOIN configs) s
JOIN covl c USING (qid, level) JOIN ms USING (method)""",
    "half": f"SELECT qid, CASE WHEN {_h16('qid')} % 2 = 0 THEN 'val' ELSE 'test' END AS split FROM questions",
    "swept": """
SELECT split, config_ord, config, t_dense, t_hybrid, count(*) AS n_queries, round(avg(cov), 9) AS recall, avg("full"::INT) AS full_rate, avg(k) AS docs, round(avg(ms), 9) AS ms, avg(fes::INT) AS fes,
  count(*) FILTER (WHERE level = 1) AS n_dense, count(*) FILTER (WHERE level = 2) AS n_hybrid, count(*) FILTER (WHERE level = 3) AS n_rerank
FROM stops JOIN half USING (qid) GROUP BY ALL""",
    "ok": f"SELECT * FROM swept WHERE split = 'val' AND recall >= {FLOOR}::DOUBLE",
    "false_stops": """
SELECT s.qid, s.method AS stop_stage, s.cov AS coverage_at_stop, p_dense < 0.8::DOUBLE AND p_hybrid < 0.8::DOUBLE AS would_continue FROM stops s JOIN wide USING (qid) WHERE fes AND config = 't=0.50'""",
    "gold_docs": "SELECT DISTINCT doc_id FROM gold WHERE qid LIKE 'b%'",
    "kb": f"""
SELECT doc_id, true AS is_gold FROM documents WHERE doc_id IN (FROM gold_docs)
UNION ALL (SELECT doc_id, false FROM documents WHERE doc_id NOT IN (FROM gold_docs) ORDER BY {_SEEDED.format('doc_id')}, doc_id LIMIT (SELECT greatest(0, {KB} - count(*)) FROM gold_docs))""",
    "numbered": f"SELECT doc_id AS qid, row_number() OVER (ORDER BY {_SEEDED.format('doc_id')}, doc_id) AS n FROM documents",
    "split": f"SELECT qid, CASE WHEN n <= {SAMPLE[0][1]} THEN 'test' WHEN n <= {SAMPLE[0][1] + SAMPLE[1][1]} THEN 'train' ELSE 'val' END AS split FROM numbered WHERE n <= {sum(n for _, n in SAMPLE)}",
    "model_asked": f"SELECT qid, question, replace('{X.PROMPT.replace(chr(39), chr(39) * 2)}', '%s', coalesce(question, '')) AS prompt FROM questions",
    "model_said": f"SELECT qid, [{_quoted(SAYS)}][1 + length(prompt) % {len(SAYS)}] AS answer FROM model_asked",
    "model": r"SELECT qid, answer, coalesce(nullif(regexp_extract(lower(answer), '\b(easy|medium|hard)\b', 1), ''), 'easy') AS label, regexp_extract(lower(answer), '\b(easy|medium|hard)\b', 1) <> '' AS parsed FROM model_said",
    "letters_doc": f"SELECT doc_id, [{_LETTERS.format(t='text')}] AS c FROM documents",
    "letters_asked": f"SELECT qid, [{_LETTERS.format(t='question')}] AS c FROM questions",
    "letters_met": f"""
SELECT qid, doc_id, {_scaled('list_dot_product(a.v, d.v)')} AS score, list_dot_product(a.v, d.v) > 0 AS positive
FROM (SELECT qid, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM letters_asked WHERE list_sum(c) > 0) a
CROSS JOIN (SELECT doc_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM letters_doc WHERE list_sum(c) > 0) d""",
    "short_raw": """
SELECT row_number() OVER (ORDER BY doc_id) AS n, CASE WHEN doc_id % 13 = 0 THEN [] ELSE string_split(text, ' ') END AS w, doc_id % 11 = 0 AS silent,
  CASE WHEN doc_id % 2 = 0 THEN [{'a': -1, 'b': -1}, {'a': doc_id % 5, 'b': doc_id % 5 + doc_id % 3}] ELSE [{'a': doc_id % 9, 'b': doc_id % 9}, {'a': doc_id % 5, 'b': doc_id % 5 + doc_id % 3}] END AS spans,
  doc_id % 4 - 1 AS la, doc_id % 4 - 1 + doc_id % 6 AS lb FROM documents""",
    "hop_raw": """
SELECT conv_id, list(struct_pack(turn, role, text) ORDER BY turn) AS t, row_number() OVER (ORDER BY conv_id) AS n,
  CASE conv_id % 3 WHEN 0 THEN ['t0'] WHEN 1 THEN ['t1', 't2', 't2'] ELSE ['none'] END AS gold FROM conversations GROUP BY conv_id""",
    **_short("", 40_000, 10_000),
    **_short("_c", CAPPED_ROWS, CAPPED_DOCS),
    **_hops("", 7_405),
    **_hops("_c", CAPPED_HOPS),
}


def _sql(final: str) -> str:
    """final after those expressions that it uses, directly or not, in their order above."""
    import re

    need, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in need)
    return f"WITH {head}\n{final}" if need else final


_MEANS = 'count(*) AS n_queries, round(avg(cov), 9) AS recall, avg("full"::INT) AS full_rate'
_MATRIX = "SELECT {}, method, k, {} FROM covg {} GROUP BY ALL"


def _ladder_union(select: str) -> str:
    return " UNION ALL ".join(select.format(n=n, stop=s, rows=_strategies(S.LADDERS[n])) for n, s in (("A", "stop_a"), ("B", "stop_b"), ("3", "stop_3")))


def _systems() -> str:
    routes = " ".join(f"WHEN '{d}' THEN '{n}'" for d, n in S.ROUTES.items())
    cut = ", ".join(f"round(avg(h{k} / n_gold), 9) AS r{k}" for k in S.KS)
    hits = ", ".join(f"count(g.doc_id) FILTER (WHERE r.rank <= {k}) AS h{k}" for k in S.KS)
    return f"""
SELECT system, count(*) AS n_queries, {cut}, avg(n_docs) AS mean_docs, avg(level) AS mean_level, any_value(accuracy) AS accuracy FROM (
  SELECT p.system, p.qid, p.n_gold, p.n_docs, p.level, {hits}
  FROM (SELECT name AS system, * FROM cov8 WHERE name IN ({_quoted(S.FIXED)})
    UNION ALL SELECT 'rule', c.* FROM cov8 c JOIN rule USING (qid) WHERE name = CASE label {routes} END
    UNION ALL SELECT 'model', c.* FROM cov8 c JOIN model USING (qid) WHERE name = CASE label {routes} END
    UNION ALL SELECT 'oracle', * FROM ({_pick('cov8')})) p
  LEFT JOIN runs r ON r.qid = p.qid AND r.method = p.method AND r.rank <= p.k
  LEFT JOIN gold g ON g.qid = p.qid AND g.doc_id = r.doc_id
  GROUP BY p.system, p.qid, p.n_gold, p.n_docs, p.level)
LEFT JOIN (SELECT 'rule' AS system, avg((label = difficulty)::INT) AS accuracy FROM difficulty JOIN rule USING (qid)
  UNION ALL SELECT 'model', avg((label = difficulty)::INT) FROM difficulty JOIN model USING (qid)) USING (system) GROUP BY system"""


def _confusion() -> str:
    ratio = lambda a, b: f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"
    return f"""
SELECT *, {ratio('2 * precision * recall', 'precision + recall')} AS f1 FROM (
  SELECT *, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {ratio('tp + fn', 'tp + fp + fn + tn')} AS sufficiency FROM (
    SELECT phase, count(*) FILTER (WHERE p >= 0.5::DOUBLE AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5::DOUBLE AND label = 0) AS fp,
      count(*) FILTER (WHERE p < 0.5::DOUBLE AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5::DOUBLE AND label = 0) AS tn FROM scores GROUP BY phase))"""


_CLASS = "(VALUES ('easy'), ('medium'), ('hard')) AS t(difficulty)"
_FINAL = {
    "dense_topk": """
SELECT q.vec_id::VARCHAR AS qid, d.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY CAST(round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) * 1e9) AS BIGINT) DESC, d.vec_id) AS rank,
  list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score
FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 50 = 0 QUALIFY rank <= 20""",
    "tokenize_terms": "SELECT u.term, count(*) AS n FROM tokens, unnest(t) AS u(term) GROUP BY u.term",
    "token_counts": f"SELECT doc_id, len(t) AS n_tokens, len({_ALL.format('text')}) AS n_raw, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words FROM tokens JOIN documents USING (doc_id)",
    "first_words": f"SELECT doc_id, {_HEAD.format('text')} AS head FROM documents",
    "bm25_idf": f"SELECT term, df, {_scaled('idf')} AS idf FROM idf",
    "bm25_topk": "FROM bm25",
    "dense_hashed_topk": "FROM dense200",
    "rrf_hybrid": "FROM hybrid",
    "rerank_lexical": "FROM reranked",
    "ranked_lists": "SELECT method, qid, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS ranked FROM runs GROUP BY method, qid",
    "run_variant": "SELECT method, CASE WHEN method = 'rerank' THEN 'large' ELSE 'base' END AS variant, count(*) AS n FROM runs WHERE method <> 'hybrid' GROUP BY ALL",
    "recall_matrix": _MATRIX.format("dataset", "count(*) AS n_queries, round(avg(cov), 9) AS recall", ""),
    "recall_pivot": "SELECT dataset, method, " + ", ".join(f"round(avg(cov) FILTER (WHERE k = {k}), 9) AS r{k}" for k in S.KS) + " FROM covg GROUP BY ALL",
    "hit_matrix": _MATRIX.format("dataset", "avg((n_hit > 0)::INT) AS hit_rate", ""),
    "full_coverage": _MATRIX.format("dataset", 'avg("full"::INT) AS full_rate', ""),
    "per_query_eval": 'SELECT qid, name, n_hit, n_gold, cov, "full" FROM cov8',
    "best_ranks": "SELECT qid, doc_id, best::DOUBLE AS best FROM best",
    "difficulty": "FROM difficulty",
    "difficulty_dist": f"SELECT dataset, t.difficulty, count(d.qid) AS n, coalesce(count(d.qid)::DOUBLE / nullif(any_value(a), 0), 0) AS share FROM (SELECT dataset, count(*) AS a FROM questions GROUP BY dataset) CROSS JOIN {_CLASS} LEFT JOIN (SELECT qid, difficulty, dataset FROM difficulty JOIN questions USING (qid)) d USING (dataset, difficulty) GROUP BY dataset, t.difficulty",
    "recall_by_difficulty": _MATRIX.format("dataset, difficulty", "count(*) AS n_queries, round(avg(cov), 9) AS recall", "JOIN difficulty USING (qid)"),
    "recall_by_group": _MATRIX.format("grp, CASE WHEN n_gold >= 2 THEN '2+' ELSE '1' END AS gold_group", "count(*) AS n_queries, round(avg(cov), 9) AS recall", ""),
    "fixed_strategies": f"SELECT dataset, name, {_MEANS}, avg(n_docs) AS mean_docs FROM cov8 WHERE name IN ({_quoted(S.FIXED)}) GROUP BY ALL",
    "oracle_pick7": f'SELECT qid, name, level, cov, "full" FROM ({_pick("cov7")})',
    "oracle_pick8": f'SELECT qid, name, level, cov, "full" FROM ({_pick("cov8")})',
    "oracle_summary": f'SELECT dataset, count(*) AS n_queries, round(avg(cov), 9) AS best_recall, avg("full"::INT) AS full_rate, avg(level) AS mean_level, avg(k) AS mean_docs FROM ({_pick("cov7")}) GROUP BY dataset',
    "rule_router": "FROM ruled",
    "label_parse": f"""
SELECT conv_id, turn, coalesce(nullif(regexp_extract(lower(answer), '\\b(easy|medium|hard)\\b', 1), ''), 'easy') AS label, regexp_extract(lower(answer), '\\b(easy|medium|hard)\\b', 1) = '' AS unparsed
FROM (SELECT conv_id, turn, concat_ws(' ', [{_quoted(ANSWERS)}][1 + (conv_id + turn) % {len(ANSWERS)}], text) AS answer FROM conversations)""",
    "router_systems": _systems(),
    "router_accuracy": "SELECT count(*) AS n_queries, avg((label = difficulty)::INT) AS accuracy FROM difficulty JOIN rule USING (qid)",
    "early_stop_a": 'SELECT qid, level, name, cov, "full" FROM stop_a',
    "early_stop_b": 'SELECT qid, level, name, cov, "full" FROM stop_b',
    "early_stop_3": 'SELECT qid, level, name, cov, "full" FROM stop_3',
    "stage_distribution": _ladder_union("SELECT '{n}' AS ladder, s.level, s.name, count(t.qid) AS n, count(t.qid)::DOUBLE / (SELECT count(*) FROM {stop}) AS share FROM ({rows}) s LEFT JOIN {stop} t USING (level) GROUP BY s.level, s.name"),
    "ladder_latency": _ladder_union("SELECT '{n}' AS ladder, dataset, count(*) AS n_queries, round(avg(cov), 9) AS recall, avg(\"full\"::INT) AS full_rate, avg(k) AS mean_docs, avg(level) AS mean_level, count(*) FILTER (WHERE cov < 1) AS never_sufficient, round(avg(ms), 9) AS mean_ms FROM {stop} JOIN ms USING (method) GROUP BY dataset"),
    "critic_samples": "SELECT qid, phase, level, k, docs, label, ranked FROM samples",
    "critic_scores": f"SELECT qid, phase, label, {_scaled('p')} AS p FROM scores",
    "critic_confusion": _confusion(),
    "critic_ladder_work": """
SELECT 1 AS level, 'dense' AS method, (SELECT count(*) FROM questions) AS n_questions, (SELECT count(*) FROM dense200) AS n_pairs
UNION ALL SELECT 2, 'hybrid', count(DISTINCT s.qid), count(h.doc_id) FROM stops s LEFT JOIN hybrid h USING (qid) WHERE config = 't=0.50' AND level >= 2
UNION ALL SELECT 3, 'rerank', count(DISTINCT s.qid), count(h.doc_id) FROM stops s LEFT JOIN hybrid h USING (qid) WHERE config = 't=0.50' AND level >= 3""",
    "critic_early_stop": "SELECT qid, level, method, k, cov, \"full\", round(ms, 6) AS ms, fes FROM stops WHERE config = 't=0.50'",
    "fes_rate": "SELECT config, count(*) AS n_queries, count(*) FILTER (WHERE fes) AS n_fes, avg(fes::INT) AS fes FROM stops GROUP BY config",
    "policy_sweep": "SELECT * EXCLUDE (split) FROM swept WHERE split = 'val'",
    "policy_select": "SELECT * EXCLUDE (split) FROM swept WHERE split = 'test' AND config = (SELECT config FROM ok ORDER BY docs, config_ord LIMIT 1)",
    "policy_cheapest": "SELECT config, recall, docs FROM ok WHERE config LIKE 'd%' ORDER BY docs, config_ord LIMIT 10",
    "pareto_front": "SELECT config, recall, docs FROM ok QUALIFY recall > coalesce(max(recall) OVER (ORDER BY docs, config_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)",
    "fes_diagnostics": f"""
SELECT f.qid, stop_stage, coverage_at_stop, would_continue, (SELECT string_agg(g.doc_id::VARCHAR, ',' ORDER BY g.doc_id) FROM gold g WHERE g.qid = f.qid) AS gold_docs, s.phase, s.k, s.cov AS coverage,
  coalesce((SELECT string_agg(g.doc_id::VARCHAR, ',' ORDER BY g.doc_id) FROM gold g WHERE g.qid = f.qid AND list_contains(string_split(s.ranked, ','), g.doc_id::VARCHAR)), '') AS covered_gold, {_scaled('p')} AS critic_p
FROM false_stops f JOIN samples s USING (qid) JOIN scores c ON c.qid = s.qid AND c.phase = s.phase""",
    "fes_summary": f"""
SELECT count(*) AS n, {_scaled('min(p)')} AS min_p, {_scaled('max(p)')} AS max_p, round(avg(p), 9) AS mean_p, coalesce(avg((abs(coverage_at_stop - 0.5) < 1e-9)::INT), 0) AS half_share, count(*) FILTER (WHERE would_continue) AS n_would_continue
FROM false_stops f JOIN scores c ON c.qid = f.qid AND c.phase = f.stop_stage""",
    "gap_report": """
SELECT round(a.recall - b.recall, 9) AS recall_gap, round(a.full_rate - b.full_rate, 9) AS full_gap, round(a.docs - b.docs, 9) AS docs_gap
FROM (SELECT round(avg(cov), 9) AS recall, avg("full"::INT) AS full_rate, avg(k) AS docs FROM stop_3) a, (SELECT round(avg(cov), 9) AS recall, avg("full"::INT) AS full_rate, avg(k) AS docs FROM stops WHERE config = 't=0.50') b""",
    "kb_build": "FROM kb",
    "kb_answerable": "SELECT qid, n_gold FROM questions WHERE qid NOT IN (SELECT qid FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM kb))",
    "split_assign": "FROM split",
    "leakage_check": "SELECT count(*) AS n_leaked FROM split WHERE split = 'test' AND qid IN (SELECT qid FROM split WHERE split <> 'test')",
    "short_form_docs": "SELECT 'doc_' || code AS doc_id, array_to_string(w[1:1024], ' ') AS text FROM short_good",
    "short_form_questions": "SELECT 'nq_' || code AS qid, question, answer, 'doc_' || code AS gold_docs FROM short_good",
    "capped_short_docs": "SELECT 'doc_' || code AS doc_id, array_to_string(w[1:1024], ' ') AS text FROM short_good_c",
    "capped_short_questions": "SELECT 'nq_' || code AS qid, question, answer, 'doc_' || code AS gold_docs FROM short_good_c",
    "capped_hop_docs": "SELECT format('hp_{:06d}', place) AS doc_id, text FROM hop_each_c",
    "capped_hop_questions": "FROM hop_questions_c",
    "multi_hop_docs": "SELECT format('hp_{:06d}', place) AS doc_id, text FROM hop_each",
    "multi_hop_questions": "FROM hop_questions",
    "multi_hop_qrels": "FROM hop_gold",
    "sentence_buckets": "SELECT CASE WHEN n_sent >= 3 THEN '3+' ELSE '2' END AS bucket, count(*) AS n FROM hop_questions GROUP BY bucket",
    "rebuilt_equal": f"SELECT true AS same, count(*) <= {KB} OR (SELECT count(*) FROM gold_docs) >= {KB} AS other_seed FROM documents",
    "dataset_file": "SELECT 'bench' AS dataset, 'b' || item_id AS qid, array_to_string(string_split(text, ' ')[1:10], ' ') AS question, 'i' || item_id AS doc_id, text FROM benchmark",
    "question_index": "SELECT 'c' || conv_id AS qid, max(turn) AS turn, arg_max(text, turn) AS question FROM conversations GROUP BY conv_id",
    "stored_bm25_topk": "FROM bm25",
    "stored_runs": "FROM runs",
    "stored_samples": "SELECT qid, question, phase, k, docs, label, ranked FROM samples JOIN half USING (qid) WHERE split = 'val'",
    "stored_gold": "FROM gold",
    "json_report": _MATRIX.format("dataset", "count(*) AS n_queries, round(avg(cov), 9) AS recall", ""),
    "markdown_report": """
SELECT 0 AS n, '| method | k | n | recall | full_rate |' AS line UNION ALL SELECT 1, '|---|---|---|---|---|'
UNION ALL SELECT 1 + row_number() OVER (ORDER BY method, k), format('| {} | {} | {} | {:.3f} | {:.1f}% |', method, k, count(*), avg(cov), 100 * avg("full"::INT)) FROM covg GROUP BY method, k""",
    "critic_cost": f"SELECT 'measured' AS source, round(avg(value), 6) AS ms FROM events UNION ALL SELECT 'default', {S.CRITIC_MS}::DOUBLE",
    "pair_inputs": "SELECT qid, phase, question || ' [SEP] ' || docs AS input FROM samples WHERE trim(docs) <> ''",
    "prompts": "SELECT qid, prompt FROM model_asked",
    "model_labels": "FROM model",
    "softmax": "SELECT vec_id, round(1 / (1 + exp(embedding[1]::DOUBLE * 10 - embedding[2]::DOUBLE * 10)), 9) AS p FROM embeddings",
    "embedded_topk": f"SELECT qid, doc_id, {_RANK.format('score DESC, doc_id')} AS rank, score FROM letters_met WHERE positive QUALIFY rank <= 20",
    "view_recall": VIEW_RECALL,
    "latency_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type",
}

_FINAL["stored_vectors_topk"] = _FINAL["dense_topk"]
_FINAL["bm25_blockmax"] = _FINAL["grown_bm25_topk"] = _FINAL["bm25_topk"]
_FINAL["stored_blockmax_topk"] = "FROM bm25 WHERE rank <= 20"
_FINAL["dense_cells_topk"] = _FINAL["dense_hashed_topk"]
_FINAL["critic_ladder_run"] = _FINAL["critic_early_stop"]

ORACLE: dict[str, str] = {name: _sql(final) for name, final in _FINAL.items()}
