"""SQL that checks the queries of the catalogue, for an engine that knows nothing of this library."""

from __future__ import annotations

from quillmere.functions import text as tx
from quillmere.operators import lexicon as lx
from quillmere.operators import ocr
from quillmere.operators.agent import FOCUS, QUESTION_WORDS
from quillmere.operators.nli import CUES
from quillmere.operators.retrieval import SOURCE_PRIOR, WEIGHTS

CJK, CORE, MARKS = tx.CJK, tx.CJK_CORE, tx.CJK_MARKS
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def token_count(x: str) -> str:
    return (
        f"(length(regexp_replace({x}, '[^{CJK}]', '', 'g')) + length(regexp_replace({x}, '[^{MARKS}]', '', 'g')) + "
        f"coalesce(list_sum(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda w: ceil(length(w) / 4.0))), 0))::BIGINT"
    )


def pairs(x: str) -> str:
    """Neighbouring characters of a text without white space, repeats kept."""
    return f"(CASE WHEN length({x}) < 2 THEN []::VARCHAR[] ELSE list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)) END)"


def bigrams(x: str) -> str:
    return f"list_distinct({pairs(squeeze(x))})"


def tokens(x: str) -> str:
    run = f"list_transform(regexp_extract_all(lower({x}), '[{CORE}]+|[a-z0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') OR length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)"
    return f"list_filter(flatten({run}), lambda t: t NOT IN ({quoted(tx.STOPWORDS)}))"


def parts(x: str, pattern: str, least: int = 1) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{pattern}'), lambda p: {strip('p')}), lambda p: length(p) >= {least})"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both} / (len({a}) + len({b}) - {both}) END"


def coverage(part: str, whole: str) -> str:
    return f"len(list_intersect({part}, {whole})) / greatest(len({part}), 1)"


SENTENCE = r"[^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+"
CHUNK_TEXTS = "SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL"
QUERIES = "SELECT DISTINCT qid AS query_id, question AS text FROM eval_items"
GARBAGE, CONTROL = tx.GARBAGE, tx.CONTROL
GAP = rf"([{CORE}])[ \t\x{{3000}}]+([{CORE}])"


def gaps(x: str) -> str:
    once = f"regexp_replace({x}, '{GAP}', '\\1\\2', 'g')"
    return f"(len(regexp_extract_all({x}, '{GAP}')) + len(regexp_extract_all({once}, '{GAP}')))"


def garbage(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{GARBAGE}'))"


KIND_ORDER = "CASE type " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(lx.KINDS)) + f" ELSE {len(lx.KINDS)} END"
TERMS = f"terms AS (SELECT term, type FROM lexicon WHERE length(term) >= 2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY {KIND_ORDER}, type) = 1), pattern AS (SELECT string_agg(term, '|' ORDER BY length(term) DESC, term) AS p FROM terms)"


def entities(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, (SELECT p FROM pattern)))"


def turns_cte() -> str:
    return "t AS (SELECT * REPLACE (lower(role) AS role) FROM turns WHERE session IS NOT NULL AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, turn ORDER BY received_at DESC NULLS LAST, coalesce(text, ''), coalesce(role, '')) = 1)"


BM25 = f"""
words AS (SELECT chunk_id, {tokens('text')} AS w FROM ({CHUNK_TEXTS})),
lens AS (SELECT chunk_id, len(w) AS n FROM words), average AS (SELECT avg(n) AS a, count(*) AS total FROM lens),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(total - df + 0.5) - ln(df + 0.5) AS raw FROM df, average),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25_RANKED = BM25 + f""",
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('text')}) AS term FROM ({QUERIES})) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / a))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (chunk_id), average GROUP BY ALL HAVING score > 0),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 30)"""


def grams(source: str, key: str, dim: int = 256) -> str:
    """Normalised hash vectors of a relation (key, text) as rows of bucket and weight."""
    return f"""(SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (
  SELECT {key}, ('0x' || substr(md5(g), 1, 8))::BIGINT % {dim} AS bucket, sum(1 + ln(n)) AS w FROM (
    SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest(list_concat(list_filter(regexp_extract_all(s, '(?s).'), lambda c: c <> ''), {pairs('s')})) AS g FROM (SELECT {key}, {squeeze('text')} AS s FROM ({source}))) GROUP BY ALL)
  GROUP BY ALL))"""


DENSE_RANKED = f"""
qv AS {grams(QUERIES, 'query_id')}, cv AS {grams(CHUNK_TEXTS, 'chunk_id')},
dscored AS (SELECT query_id, chunk_id, round(sum(qv.w * cv.w), 6) AS score FROM qv JOIN cv USING (bucket) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dscored QUALIFY rank <= 30)"""
FUSED = f"""{BM25_RANKED}, {DENSE_RANKED},
both_ AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, coalesce(d.score, 0) AS dense, coalesce(b.score / (b.score + 10), 0) AS bm25_norm, d.rank AS dr, b.rank AS br
  FROM dense d FULL JOIN bm25 b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
fused AS (SELECT *, round(coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + br), 0), 10) AS rrf FROM both_),
candidates AS (SELECT query_id, chunk_id, dense, round(bm25_norm, 6) AS bm25_norm, rrf, round(least(1.0, rrf / (2.0 / 61)), 6) AS rrf_norm,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr NULLS LAST, br NULLS LAST, chunk_id) AS position FROM fused)"""

GOLD = "gold AS (SELECT DISTINCT qid AS query_id, unnest(gold_chunk_ids) AS chunk_id FROM eval_items)"


def metrics(ranked: str, ks=(1, 5, 10, 30)) -> str:
    n = ", ".join(f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS n{k}" for k in ks)
    per = ", ".join(f"coalesce(n{k}, 0) / n_gold AS recall_{k}, coalesce(n{k}, 0) / {k}.0 AS precision_{k}, CASE WHEN coalesce(n{k}, 0) > 0 THEN 1 ELSE 0 END AS hit_{k}" for k in ks)
    means = ", ".join(f"round(avg({m}_{k}), 4) AS {m}_{k}" for k in ks for m in ("recall", "precision", "hit"))
    return f"""{GOLD}, ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
flagged AS (SELECT r.query_id, r.rank, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END AS hit FROM {ranked} r LEFT JOIN gold g USING (query_id, chunk_id)),
run AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM flagged),
agg AS (SELECT query_id, {n}, min(CASE WHEN hit = 1 THEN rank END) AS f, max(CASE WHEN rank = 1 THEN hit END) AS one, avg(CASE WHEN hit = 1 THEN so_far / rank END) AS cp, sum(hit) AS hits FROM run GROUP BY 1),
per AS (SELECT query_id, {per}, coalesce(1.0 / f, 0) AS mrr, one::DOUBLE AS top1, coalesce(cp, 0) AS cp, coalesce(hits, 0) / n_gold AS cr FROM ng LEFT JOIN agg USING (query_id))
SELECT count(*) AS n, {means}, round(avg(mrr), 4) AS mrr, round(avg(top1), 4) AS top1, round(avg(cp), 4) AS context_precision, round(avg(cr), 4) AS context_recall FROM per"""


def focus_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{'|'.join(w.split())}') THEN '{f}'" for w, f in FOCUS) + " ELSE '' END"


def heading_state(levels=range(1, 7)) -> str:
    reset = lambda n: f"CASE WHEN level = {n} THEN head WHEN level < {n} THEN '' END"
    return ", ".join(f"last_value({reset(n)} IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS h{n}" for n in levels)


KEYWORDS, AHEAD = ["失眠", "头痛", "咳嗽", "盗汗", "饮食", "泡水", "加重", "调理"], ["泡水", "饮食"]
KEYWORD_ORDER = "CASE keyword " + " ".join(f"WHEN '{w}' THEN {[*AHEAD, *KEYWORDS].index(w) + 1}" for w in KEYWORDS) + " END"
CONF = ocr.CONFUSABLE.split()
ORACLES = {
    "c01_sections": f"""WITH d AS (SELECT doc_id, any_value(title) AS title, any_value(text) AS text FROM source_documents WHERE text IS NOT NULL GROUP BY doc_id),
l AS (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM d),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level, {strip("regexp_replace(line, '^#+', '')")} AS head FROM l),
s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY k) AS section, {heading_state()} FROM m),
g AS (SELECT doc_id, section, any_value(title) AS title, list_filter([any_value(h1), any_value(h2), any_value(h3), any_value(h4), any_value(h5), any_value(h6)], lambda h: h IS NOT NULL AND h <> '') AS path, {squeeze("coalesce(string_agg(line, '' ORDER BY k), '')")} AS content FROM s WHERE level IS NULL GROUP BY doc_id, section)
SELECT doc_id, CASE WHEN len(path) = 0 THEN coalesce(title, '') ELSE array_to_string(path, '>') END AS path, md5(content) AS content_md5 FROM g WHERE content <> ''""",
    "n03_types": f"WITH {TERMS}, c AS (SELECT chunk_id, unnest({entities('text')}) AS term FROM ({CHUNK_TEXTS})) SELECT chunk_id, type, count(*) AS n_terms FROM c JOIN terms USING (term) GROUP BY ALL",
    "e03_hash_vectors": f"WITH v AS (SELECT * FROM {grams(CHUNK_TEXTS, 'chunk_id')}) SELECT chunk_id, count(*) AS n_buckets, round(max(w), 6) AS largest FROM v GROUP BY 1",
    "h22_round_robin": "WITH i AS (SELECT DISTINCT qid, item_type FROM eval_items), r AS (SELECT *, row_number() OVER (PARTITION BY item_type ORDER BY md5('42#' || qid), qid) AS r FROM i) SELECT qid, item_type FROM r ORDER BY r, item_type LIMIT 48",
    "a09_decisions": """WITH g AS (SELECT r AS round, c / 20.0::DOUBLE AS confidence, k / 10.0::DOUBLE AS consistency, n FROM (VALUES (1), (2), (3)) AS a(r), (SELECT unnest(range(0, 21, 2)) AS c), (SELECT unnest(range(0, 11, 2)) AS k), (VALUES (0), (1)) AS b(n))
SELECT round, confidence, consistency, n, CASE WHEN confidence >= 0.45 AND consistency >= 0.5 THEN 'finish' WHEN n > 0 AND round < 3 THEN 'resolve_conflict' WHEN round < 3 AND confidence < 0.45 THEN 'refine_search' WHEN confidence < 0.33 THEN 'refuse' ELSE 'finish' END AS decision FROM g""",
    "b01_supplement": f"""WITH p AS (SELECT * FROM build_corpus WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id) = 1), f AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM build_corpus WHERE label = '中医科' AND id IS NOT NULL) AND score >= 3 AND length(trim(question, ' ')) >= 8 AND length(trim(answer, ' ')) >= 40),
h AS (SELECT *, CASE {' '.join(f"WHEN contains(question || chr(10) || answer, '{w}') THEN '{w}'" for w in KEYWORDS)} END AS keyword FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, md5('42#' || id), id) AS r FROM h WHERE keyword IS NOT NULL),
o AS (SELECT *, CASE WHEN keyword IN ({quoted(AHEAD)}) AND r <= 40 THEN 0 WHEN score > 3 THEN 1 ELSE 2 END AS phase, {KEYWORD_ORDER} AS place FROM r)
SELECT id, keyword, phase::BIGINT AS phase FROM o ORDER BY phase, CASE WHEN phase = 0 THEN place ELSE r END, CASE WHEN phase = 0 THEN r ELSE place END, id LIMIT 300""",

    "t01_token_counts": f"SELECT chunk_id, {token_count('text')} AS n_tokens FROM ({CHUNK_TEXTS})",
    "t02_truncated": f"""WITH c AS ({CHUNK_TEXTS}), k AS (SELECT chunk_id, text, unnest(range(0, length(text) + 1)) AS k FROM c)
SELECT chunk_id, max(k)::BIGINT AS n_chars FROM k WHERE {token_count('substr(text, 1, k)')} <= 64 GROUP BY chunk_id""",
    "t03_sentences": f"SELECT chunk_id, len({parts('text', SENTENCE)})::BIGINT AS n_sentences, coalesce(list_max(list_transform({parts('text', SENTENCE)}, lambda p: length(p))), 0)::BIGINT AS longest FROM ({CHUNK_TEXTS})",
    "t04_paragraphs": f"SELECT chunk_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda p: {strip('p')}), lambda p: p <> ''))::BIGINT AS n_paragraphs FROM ({CHUNK_TEXTS})",
    "t11_normalized": f"""WITH d AS (SELECT DISTINCT doc_id, text FROM source_documents WHERE text IS NOT NULL), b AS (SELECT doc_id, text, translate(regexp_replace(regexp_replace(text, '{CONTROL}', '', 'g'), '{GARBAGE}', '', 'g'), '{tx.WIDE}', '{tx.NARROW}') AS b FROM d),
g AS (SELECT *, regexp_replace(regexp_replace(b, '{GAP}', '\\1\\2', 'g'), '{GAP}', '\\1\\2', 'g') AS g FROM b)
SELECT doc_id, md5(regexp_replace(regexp_replace(g, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5, {gaps('b')}::BIGINT AS n_space, {garbage('text')}::BIGINT AS n_garbage FROM g""",
    "t15_noise_score": f"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(least(1.0, ({garbage('text')} + 0.6::DOUBLE * {gaps('text')}) / length(text)), 4) END AS noise FROM (SELECT DISTINCT doc_id, text FROM source_documents WHERE text IS NOT NULL)",
    "t13_variants": f"""WITH pairs(p) AS (VALUES {', '.join(f"('{p}')" for p in CONF)}), cf AS (SELECT DISTINCT a, b FROM (SELECT substr(p, 1, 1) AS a, substr(p, 2, 1) AS b FROM pairs UNION ALL SELECT substr(p, 2, 1), substr(p, 1, 1) FROM pairs)),
tt AS (SELECT DISTINCT term FROM lexicon WHERE length(term) >= 2), ch AS (SELECT term, unnest(range(1, length(term) + 1)) AS k FROM tt),
v AS (SELECT term, k, substr(term, 1, k - 1) || b || substr(term, k + 1) AS variant FROM ch JOIN cf ON substr(term, k, 1) = a)
SELECT variant, term FROM v WHERE variant NOT IN (SELECT term FROM tt) QUALIFY row_number() OVER (PARTITION BY variant ORDER BY length(term) DESC, term, k) = 1""",
    "t17_terms": f"WITH w AS (SELECT chunk_id, {tokens('text')} AS w FROM ({CHUNK_TEXTS})) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM w) GROUP BY term",
    "t21_neighbour_jaccard": f"WITH c AS (SELECT DISTINCT chunk_id, doc_id, seq, {bigrams('text')} AS b FROM chunks) SELECT x.chunk_id, y.chunk_id AS next_id, round({jaccard('x.b', 'y.b')}, 4) AS jaccard FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.seq = x.seq + 1",
    "t22_gold_coverage": f"WITH {GOLD}, q AS (SELECT query_id, {bigrams('text')} AS b FROM ({QUERIES})), c AS (SELECT chunk_id, {bigrams('text')} AS cb FROM ({CHUNK_TEXTS})) SELECT query_id, chunk_id, round({coverage('b', 'cb')}, 4) AS coverage FROM gold JOIN q USING (query_id) JOIN c USING (chunk_id)",
    "t24_answer_parts": f"""WITH a AS (SELECT DISTINCT id, answer FROM build_corpus WHERE answer IS NOT NULL)
SELECT id, len({parts("regexp_replace(" + strip('answer') + ", '^〈[^〉]*〉\\s*', '')", '[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+', 6)})::BIGINT AS n_sentences, len({parts('answer', '[^。！？；\\n，,]+', 4)})::BIGINT AS n_clauses,
  len({parts("regexp_replace(answer, '〔\\d+〕|\\[[\\w#]+\\]', '', 'g')", '[^。！？；\\n]+', 8)})::BIGINT AS n_claims FROM a""",
    "t27_numbers": "SELECT * FROM (VALUES ('3', 3.0::DOUBLE), ('2.5', 2.5), ('一', 1.0), ('半', 0.5), ('十', 10.0), ('十二', 12.0), ('二十', NULL), ('克', NULL)) AS v(word, value)",
    "t29_negated": f"WITH {TERMS}, c AS (SELECT chunk_id, text, {entities('text')} AS e FROM ({CHUNK_TEXTS})) SELECT chunk_id, len(list_filter(e, lambda t: {' OR '.join(f"contains(text, '{c}' || t)" for c in CUES)}))::BIGINT AS n_negated FROM c",
    "n02_entities": f"WITH {TERMS}, c AS (SELECT chunk_id, unnest(regexp_extract_all(text, (SELECT p FROM pattern))) AS term FROM ({CHUNK_TEXTS})) SELECT chunk_id, term, type, count(*) AS n FROM c JOIN terms USING (term) GROUP BY ALL",
    "n04_importance": f"""WITH {TERMS}, c AS (SELECT chunk_id, unnest(CASE WHEN len(e) = 0 THEN [NULL] ELSE e END) AS term FROM (SELECT chunk_id, {entities('text')} AS e FROM ({CHUNK_TEXTS}))),
w AS (SELECT chunk_id, sum(CASE type {' '.join(f"WHEN '{k}' THEN {w}" for k, w in lx.KINDS.items())} WHEN NULL THEN 0 ELSE CASE WHEN type IS NULL THEN 0 ELSE 0.3 END END) AS raw FROM c LEFT JOIN terms USING (term) GROUP BY chunk_id)
SELECT chunk_id, round(least(1.0, 0.15 + 0.85 * (1 - exp(-raw / 2))), 4)::DOUBLE AS importance FROM w""",
    "n06_vocabulary": "SELECT DISTINCT term, type FROM (SELECT term, type FROM lexicon WHERE term IS NOT NULL UNION ALL SELECT trim(d), 'western_disease' FROM (SELECT unnest(string_split(related_diseases, '|')) AS d FROM build_corpus) WHERE length(trim(d)) BETWEEN 2 AND 12)",
    "e06_dense_topk": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.e, r.e), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, r.e), 6) DESC, r.vec_id) AS rank FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10",
    "e06_label_purity": "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT q.label AS a, r.label AS b, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, r.e), 6) DESC, r.vec_id) AS rank FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10) SELECT a AS label, count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 4) AS purity FROM t GROUP BY a",
    "e08_manifest": "WITH c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) = 1) SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks FROM c",
    "e07_counts": "SELECT split_method, count(*) AS n FROM (SELECT DISTINCT chunk_id, split_method FROM chunks) GROUP BY 1",
    "q10_rollup": f"SELECT source_type, lang, count(*) AS n, sum({token_count('text')})::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY ROLLUP (source_type, lang)",
    "r01_term_statistics": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "r02_bm25_topk": f"WITH {BM25_RANKED} SELECT query_id, chunk_id, score, rank FROM bm25",
    "r03_dense_topk": f"WITH {DENSE_RANKED} SELECT query_id, chunk_id, score, rank FROM dense",
    "r04_fusion": f"WITH {FUSED} SELECT * FROM candidates",
    "r10_reranked": f"""WITH {FUSED}, {TERMS}, pool AS (SELECT * FROM candidates WHERE position <= 30),
q AS (SELECT query_id, text AS qt, {entities('text')} AS qe, {bigrams('text')} AS qb FROM ({QUERIES})),
cc AS (SELECT chunk_id, text, coalesce(ocr_noise, 0) AS noise, source_type FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) = 1),
ce AS (SELECT chunk_id, noise, source_type, {entities('text')} AS e, {bigrams('text')} AS cb FROM cc),
f AS (SELECT query_id, chunk_id, dense, bm25_norm, rrf_norm, noise, source_type, CASE WHEN len(qe) > 0 THEN len(list_intersect(qe, e)) / len(qe) ELSE {coverage('qb', 'cb')} END AS overlap FROM pool JOIN q USING (query_id) JOIN ce USING (chunk_id))
SELECT query_id, chunk_id, round({WEIGHTS['dense']} * greatest(0, least(1, dense)) + {WEIGHTS['bm25']} * greatest(0, least(1, bm25_norm)) + {WEIGHTS['rrf']} * greatest(0, least(1, rrf_norm)) + {WEIGHTS['entity_overlap']} * overlap
  + {WEIGHTS['clean']} * greatest(0, 1 - 4 * noise) + {WEIGHTS['source_prior']} * coalesce(CASE source_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SOURCE_PRIOR.items())} END, 0.8), 4) AS score FROM f""",
    "v01_bm25_metrics": f"WITH {BM25_RANKED}, {metrics('bm25')}",
    "v01_dense_metrics": f"WITH {DENSE_RANKED}, {metrics('dense')}",
    "v09_relevancy": f"""WITH {TERMS}, i AS (SELECT DISTINCT qid, question, reference_answer AS a, {entities('question')} AS e, list_distinct(list_filter({tokens('question')}, lambda t: length(t) >= 2)) AS w FROM eval_items),
j AS (SELECT qid, a, e, {coverage('w', tokens('a'))} AS tc FROM i)
SELECT qid, CASE WHEN {strip('a')} = '' THEN 0.0 ELSE round(least(1.0, 0.6 * tc + 0.4 * CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda t: contains(a, t))) / len(e) ELSE tc END), 4) END AS relevancy FROM j""",
    "v15_least_covered": f"""WITH known AS (SELECT DISTINCT unnest({bigrams('text')}) AS p FROM ({CHUNK_TEXTS})), a AS (SELECT qid, unnest({bigrams('question')}) AS p FROM (SELECT DISTINCT qid, question FROM eval_items))
SELECT qid, round(count(known.p) / count(*), 4) AS overlap FROM a LEFT JOIN known USING (p) GROUP BY qid ORDER BY overlap, qid LIMIT 30""",
    "v16_stratified": """WITH i AS (SELECT DISTINCT qid, item_type FROM eval_items), n AS (SELECT item_type, count(*) AS n FROM i GROUP BY 1), s AS (SELECT sum(n) AS total, sum(CASE WHEN item_type = 'unanswerable' THEN n ELSE 0 END) AS kept FROM n),
quota AS (SELECT item_type, CASE WHEN total <= 120 THEN n WHEN item_type = 'unanswerable' THEN n ELSE greatest(1, round_even((120 - kept) * n / greatest(1, total - kept), 0)) END AS quota FROM n, s),
chosen AS (SELECT qid, item_type FROM i JOIN quota USING (item_type) QUALIFY row_number() OVER (PARTITION BY item_type ORDER BY md5('42#' || qid), qid) <= any_value(quota) OVER (PARTITION BY item_type))
SELECT qid, item_type FROM chosen ORDER BY CASE WHEN item_type = 'unanswerable' THEN 0 ELSE 1 END, md5('43#' || qid), qid LIMIT 120""",
    "v17_type_counts": "SELECT item_type, count(*) AS n FROM (SELECT DISTINCT qid, item_type FROM eval_items) GROUP BY 1",
    "v21_latency": "SELECT event_type, round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95, round(quantile_cont(value, 0.99), 2) AS p99, round(avg(value), 2) AS mean, round(max(value), 2) AS max FROM events GROUP BY 1",
    "c08_naive": f"""WITH d AS (SELECT DISTINCT doc_id, text FROM source_documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS k, unnest(regexp_extract_all(text, '(?s).')) AS c FROM d),
f AS (SELECT *, regexp_matches(c, '^[A-Za-z0-9]$') AS w, regexp_matches(c, '^[{CJK}{MARKS}]$') AS one FROM c), g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, w ORDER BY k) AS run FROM f),
h AS (SELECT *, CASE WHEN one OR (w AND (row_number() OVER (PARTITION BY doc_id, w, run ORDER BY k) - 1) % 4 = 0) THEN 1 ELSE 0 END AS t FROM g), cum AS (SELECT doc_id, k, sum(t) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM h),
m AS (SELECT d.doc_id, d.text, coalesce((SELECT min(k) - 1 FROM cum WHERE cum.doc_id = d.doc_id AND n > 64), length(d.text)) AS n FROM d)
SELECT doc_id || '#c000' AS chunk_id, n::BIGINT AS char_end, md5(substr(text, 1, n)) AS text_md5 FROM m""",
    "a01_focus": f"SELECT qid, f AS focus_terms, CASE WHEN f = '' THEN 'lookup' ELSE string_split(f, ' ')[1] END AS query_type FROM (SELECT DISTINCT qid, {focus_case('question')} AS f FROM eval_items)",
    "a02_initial_query": f"""WITH q AS (SELECT DISTINCT qid, question, {focus_case('question')} AS f, {strip("regexp_replace(regexp_replace(question, '" + '|'.join(QUESTION_WORDS) + "', ' ', 'g'), '" + WS + "+', ' ', 'g')")} AS one FROM eval_items),
c AS (SELECT qid, question, f, regexp_replace(regexp_replace(one, '([{CORE}，。]) ', '\\1', 'g'), ' ([{CORE}，。])', '\\1', 'g') AS core FROM q)
SELECT qid, {strip("concat_ws(' ', CASE WHEN core <> '' THEN core ELSE question END, f)")} AS query FROM c""",
    "m02_decay": f"WITH {turns_cte()} SELECT session, turn, round(coalesce(base_importance, 0) * pow(0.82, max(turn) OVER (PARTITION BY session) - turn), 6) AS importance FROM t",
    "m03_window": f"WITH {turns_cte()} SELECT session, count(*) AS n_turns, sum(a)::BIGINT AS n_active, min(CASE WHEN a = 1 THEN turn END) AS first_active FROM (SELECT session, turn, CASE WHEN row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 6 THEN 1 ELSE 0 END AS a FROM t) GROUP BY session",
    "m08_recent_entities": f"""WITH {turns_cte()}, n AS (SELECT * FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY session ORDER BY turn DESC) <= 2),
e AS (SELECT session, turn, unnest(map_entries(entities)) AS kv FROM n WHERE entities IS NOT NULL), w AS (SELECT session, turn, kv.key AS type, unnest(kv.value) AS term, generate_subscripts(kv.value, 1) AS pos FROM e),
f AS (SELECT session, type, term, min(row(turn, pos)) AS f FROM w GROUP BY ALL)
SELECT session, type, string_agg(term, '|' ORDER BY f, term) AS terms FROM f GROUP BY session, type""",
    "m12_recall": """WITH m AS (SELECT * FROM memories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, hits DESC NULLS LAST, content) = 1),
v AS (SELECT id, status, importance, updated_at, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM m WHERE embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
s AS (SELECT q.id AS query_id, r.id, round(greatest(list_dot_product(q.e, r.e), 0) * (0.75 + 0.25 * coalesce(r.importance, 0)) * (0.85 + 0.15 / (1 + (epoch_us(TIMESTAMP '2025-06-01') - epoch_us(r.updated_at)) / 86400e6 / 7)), 4) AS score
  FROM v q JOIN v r ON true WHERE substr(q.id, 2)::BIGINT % 20 = 0 AND r.status = 'active')
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3""",
    "k01_upsert": "WITH late AS (SELECT DISTINCT chunk_id FROM chunks WHERE indexed_at >= TIMESTAMP '2025-01-15') SELECT count(*) AS n, count(DISTINCT chunk_id) AS n_chunks, sum(CASE WHEN l.chunk_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n_new FROM (SELECT DISTINCT chunk_id FROM chunks) LEFT JOIN late l USING (chunk_id)",
    "s03_question_documents": f"""WITH r AS (SELECT DISTINCT id, {strip('question')} AS q, {strip('answer')} AS a FROM build_corpus WHERE id IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL), t AS (SELECT *, substr(q, 1, 24) || CASE WHEN length(q) > 24 THEN '…' ELSE '' END AS title FROM r)
SELECT 'qa_' || id AS doc_id, title, md5('# 医案问答：' || title || chr(10) || chr(10) || '【患者问】' || q || chr(10) || chr(10) || '【医师答】' || a || chr(10)) AS text_md5 FROM t""",
    "s17_selected_questions": "WITH r AS (SELECT id, question, answer, score FROM build_corpus WHERE label = '内科' AND score >= 4 AND length(trim(answer)) >= 60 AND length(trim(question)) >= 8 QUALIFY row_number() OVER (PARTITION BY id) = 1) SELECT id, score FROM r ORDER BY md5('42#' || id), id LIMIT 100",
    "v12_records": "WITH c AS (SELECT DISTINCT chunk_id, doc_id, source_type, title_path FROM chunks) SELECT CASE WHEN source_type = 'qa' THEN doc_id ELSE concat_ws('|', doc_id, array_to_string(coalesce(title_path, []), '>')) END AS record_key, count(*) AS n_chunks FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) = 1) GROUP BY 1",
}
ORACLES["r15_static_reasons"] = (
    ORACLES["r10_reranked"].replace("\nSELECT query_id, chunk_id, round(", ",\nscored_ AS (SELECT query_id, chunk_id, round(")
    + f"""), j AS (SELECT score, noise, length({squeeze('text')}) AS n FROM scored_ JOIN cc USING (chunk_id))
SELECT CASE WHEN n < 24 THEN 'too_short' WHEN noise > 0.18 THEN 'ocr_noise' WHEN score < 0.3 THEN 'low_relevance' ELSE 'none' END AS reason, count(*) AS n FROM j GROUP BY 1"""
)
ORACLES["a08_signals"] = f"""WITH {BM25_RANKED}, {TERMS}, pool AS (SELECT query_id, chunk_id, round(score / (score + 10), 6) AS score FROM bm25 WHERE rank <= 8),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM pool QUALIFY place <= 5),
ev AS (SELECT query_id, string_agg(text, ' ' ORDER BY place) AS ev, max(score) AS top_score FROM top JOIN ({CHUNK_TEXTS}) USING (chunk_id) GROUP BY 1), n AS (SELECT query_id, count(*) AS n_evidence FROM pool GROUP BY 1),
q AS (SELECT query_id, {entities('text')} AS e, list_distinct(list_filter({tokens('text')}, lambda t: length(t) >= 2)) AS w, {bigrams('text')} AS b FROM ({QUERIES})),
j AS (SELECT query_id, e, coalesce(top_score, 0) AS top_score, coalesce(n_evidence, 0) AS n_evidence, CASE WHEN len(e) > 0 THEN len(list_filter(e, lambda t: contains(ev, t))) / len(e) ELSE 0.0 END AS c, {coverage('w', tokens('ev'))} AS t, {coverage('b', bigrams('ev'))} AS bc FROM q LEFT JOIN ev USING (query_id) LEFT JOIN n USING (query_id))
SELECT query_id, round(c, 4) AS coverage, round(t, 4) AS token_overlap, round(bc, 4) AS bigram_coverage, round(CASE WHEN len(e) > 0 THEN 0.5::DOUBLE * c + 0.25::DOUBLE * t + 0.25::DOUBLE * bc ELSE greatest(t, bc) END, 4) AS relevance, round(top_score, 4) AS top_score, n_evidence FROM j"""

LATEST_CHUNKS = "SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST) = 1"
LATEST_MEMORIES = "SELECT * FROM memories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, hits DESC NULLS LAST, content) = 1"
ORACLES["m13_context"] = f"""WITH h AS ({ORACLES['m12_recall']}), m AS ({LATEST_MEMORIES})
SELECT query_id, '【长期记忆】' || chr(10) || string_agg('- ' || content || '（重要度' || printf('%.2f', coalesce(importance, 0)) || '，命中' || coalesce(hits, 0) || '次）', chr(10) ORDER BY rank) AS block FROM h JOIN m USING (id) GROUP BY query_id"""

# The window holds six turns; no window of these tables exceeds the token budget, so turns leave by age alone.
ORACLES["m04_replay"] = f"""WITH {turns_cte()}, {TERMS},
p AS (SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY turn) AS i, {token_count("coalesce(text, '')")} AS n, role, {parts("coalesce(text, '')", SENTENCE)} AS s, len({entities("coalesce(text, '')")}) > 0 AS has FROM t),
q AS (SELECT session, turn, i, sum(n) OVER (PARTITION BY session ORDER BY turn ROWS 5 PRECEDING)::BIGINT AS active_tokens, rtrim(CASE WHEN role = 'user' THEN '[患]' ELSE '[医]' END || substr(array_to_string(s[1:CASE WHEN has THEN 2 ELSE 1 END], ''), 1, 120)) AS piece FROM p),
h AS (SELECT session, turn, i, active_tokens, string_agg(piece, ' ') OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING) AS told FROM q),
w AS (SELECT session, turn, unnest(string_split(told, ' ')) AS word, unnest(range(1, len(string_split(told, ' ')) + 1)) AS k FROM h WHERE told IS NOT NULL),
c AS (SELECT *, sum({token_count('word')}) OVER (PARTITION BY session, turn ORDER BY k DESC) AS upto FROM w),
z AS (SELECT session, turn, string_agg(word, ' ' ORDER BY k) AS summary FROM c WHERE upto <= 220 GROUP BY ALL)
SELECT session, turn, least(i, 6)::BIGINT AS n_active, active_tokens, greatest(i - 6, 0)::BIGINT AS n_compressed, coalesce(summary, '') AS summary FROM h LEFT JOIN z USING (session, turn)"""

TEMPLATE_ROWS = "('herb', '{}的性味归经是什么？', '性味', 0), ('herb', '{}怎么炮制？', '炮制', 1), ('formula', '{}由哪些药组成？', '组成', 2), ('formula', '{}主治什么？', '主治', 3), ('disease', '{}的病因病机是什么？', '病机', 4), ('pattern', '{}有哪些主要表现？', '表现', 5), ('symptom', '{}怎么调理？', '调理', 6)"
ORACLES["v14_items"] = f"""WITH {TERMS}, t(type, template, field, number) AS (VALUES {TEMPLATE_ROWS}),
c AS (SELECT CASE WHEN source_type = 'qa' THEN doc_id ELSE concat_ws('|', doc_id, array_to_string(coalesce(title_path, []), '>')) END AS record_key, chunk_id, seq, text FROM ({LATEST_CHUNKS})),
e AS (SELECT record_key, seq, chunk_id, regexp_extract(text, (SELECT p FROM pattern)) AS entity FROM c),
f AS (SELECT record_key, entity FROM e WHERE entity <> '' QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY seq, chunk_id) = 1),
h AS (SELECT record_key, field, count(*) AS n FROM c JOIN (SELECT DISTINCT field FROM t) ON contains(text, field) GROUP BY ALL),
o AS (SELECT f.record_key, replace(template, '{{}}', entity) AS question, type AS item_type, field, n FROM f JOIN terms ON term = entity JOIN t USING (type) LEFT JOIN h USING (record_key, field)
  QUALIFY row_number() OVER (PARTITION BY f.record_key ORDER BY n IS NULL, md5('42#' || f.record_key || '#' || number)) = 1)
SELECT record_key, question, item_type, chunk_id FROM o JOIN c USING (record_key) WHERE coalesce(n, 0) <> 1 OR contains(text, field)""".replace("'{}'", "'{}'")


def walked(limit: int) -> str:
    """The evidence filter, one candidate of each query a step: walk has the kept chunks in order, cand all candidates."""
    base = ORACLES["r10_reranked"].replace("\nSELECT query_id, chunk_id, round(", ",\nscored_ AS (SELECT query_id, chunk_id, round(").replace("WITH ", "WITH RECURSIVE ", 1)
    rank = "CASE source_type WHEN 'textbook' THEN 0 WHEN 'classic' THEN 1 WHEN 'case' THEN 2 WHEN 'pdf' THEN 3 WHEN 'qa' THEN 4 WHEN 'pdf_scan' THEN 5 WHEN 'ocr_scan' THEN 6 ELSE 9 END"
    return base + f"""),
cand AS (SELECT s.query_id, s.chunk_id, s.score, noise, {bigrams('text')} AS b, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, noise, {rank}, s.chunk_id) AS place,
  CASE WHEN length({squeeze('text')}) < 24 THEN 'too_short' WHEN noise > 0.18 THEN 'ocr_noise' WHEN s.score < 0.3 THEN 'low_relevance' END AS why FROM scored_ s JOIN cc USING (chunk_id)),
like_ AS (SELECT x.query_id, x.place, list(y.chunk_id) AS alike FROM cand x JOIN cand y ON x.query_id = y.query_id AND y.place < x.place AND x.why IS NULL AND y.why IS NULL
  AND len(list_intersect(x.b, y.b)) > 0.72 * (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) GROUP BY ALL),
step AS (SELECT c.query_id, c.place, c.chunk_id, c.score, c.why, coalesce(l.alike, []) AS alike FROM cand c LEFT JOIN like_ l USING (query_id, place)),
walk AS (SELECT DISTINCT query_id, 0::BIGINT AS n, []::VARCHAR[] AS kept, 0::BIGINT AS seen FROM cand UNION ALL
  SELECT w.query_id, w.n + 1, CASE WHEN len(w.kept) < {limit} AND s.why IS NULL AND len(list_intersect(w.kept, s.alike)) = 0 THEN list_append(w.kept, s.chunk_id) ELSE w.kept END,
    CASE WHEN len(w.kept) < {limit} THEN w.n + 1 ELSE w.seen END FROM walk w JOIN step s ON s.query_id = w.query_id AND s.place = w.n + 1),
last_ AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC) = 1)"""


ORACLES["r07_full"] = walked(5) + """
SELECT query_id, chunk_id, list_position(kept, chunk_id)::BIGINT AS rank, score FROM last_ JOIN step USING (query_id) WHERE list_contains(kept, chunk_id)"""
ORACLES["r15_filtered"] = walked(5) + """
SELECT status, CASE WHEN status = 'dropped' THEN coalesce(why, 'duplicate_of') ELSE '' END AS reason, count(*) AS n
FROM (SELECT *, CASE WHEN list_contains(kept, chunk_id) THEN 'kept' WHEN place <= seen THEN 'dropped' ELSE 'unseen' END AS status FROM last_ JOIN step USING (query_id)) GROUP BY ALL"""
ORACLES["v18_modes"] = (
    walked(30).replace("pool AS (SELECT * FROM candidates WHERE position <= 30)", "pool AS (SELECT * FROM candidates WHERE position <= 30), cand_pos AS (SELECT query_id, chunk_id, position FROM candidates)")
    + """,
hybrid AS (SELECT query_id, chunk_id, position AS rank FROM candidates WHERE position <= 30),
reranked AS (SELECT s.query_id, s.chunk_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, position) AS rank FROM scored_ s JOIN cand_pos USING (query_id, chunk_id)),
whole AS (SELECT query_id, chunk_id, list_position(kept, chunk_id) AS rank FROM last_ JOIN step USING (query_id) WHERE list_contains(kept, chunk_id))
"""
    + " UNION ALL ".join(f"SELECT *, '{mode}' AS mode FROM (WITH {metrics(ranked)})" for mode, ranked in (("dense", "dense"), ("bm25", "bm25"), ("hybrid", "hybrid"), ("hybrid_rerank", "reranked"), ("full", "whole")))
)
ORACLES["e08_manifest"] = f"WITH c AS ({LATEST_CHUNKS}) SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, round(avg(n_tokens), 2) AS avg_tokens, max(n_tokens)::BIGINT AS max_tokens, count(*) FILTER (WHERE n_tokens > 512) AS n_over, count(DISTINCT source_type) AS n_source_types, count(DISTINCT split_method) AS n_split_methods FROM c"
ORACLES["e08_counts"] = f"WITH c AS ({LATEST_CHUNKS}) SELECT 'split_method' AS by, split_method AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'source_type', source_type, count(*) FROM c GROUP BY ALL"
# The whole vector in two numbers: its sum, and its sum weighted by bucket.
ORACLES["e03_hash_vectors"] = f"WITH v AS (SELECT * FROM {grams(CHUNK_TEXTS, 'chunk_id')}) SELECT chunk_id, count(*) AS n_buckets, round(max(w), 6) AS largest, round(sum(w), 4) AS total, round(sum(w * (bucket + 1)), 2) AS by_bucket FROM v GROUP BY 1"
ORACLES["c09_stored_retention"] = f"""WITH {TERMS}, d AS (SELECT doc_id, any_value(text) AS text, any_value(source_type) AS source_type FROM (SELECT DISTINCT doc_id, text, source_type FROM source_documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY text) = 1) GROUP BY doc_id),
s AS (SELECT doc_id, source_type, {squeeze('s')} AS s FROM (SELECT doc_id, source_type, unnest({parts('text', SENTENCE)}) AS s FROM d) WHERE regexp_matches(s, (SELECT p FROM pattern))),
whole AS (SELECT doc_id, string_agg({squeeze('text')}, '' ORDER BY seq, chunk_id) AS t FROM ({LATEST_CHUNKS}) WHERE text IS NOT NULL GROUP BY doc_id)
SELECT source_type, count(*) AS sentences, count(*) FILTER (WHERE contains(coalesce(t, ''), s))::BIGINT AS retained, round(count(*) FILTER (WHERE contains(coalesce(t, ''), s)) / count(*), 4) AS retention FROM s LEFT JOIN whole USING (doc_id) GROUP BY ROLLUP (source_type)"""


OPPOSITE_ROWS = ", ".join(f"({n}, '{x}', '{y}')" for n, (x, y) in enumerate(p.split("/") for p in (
    "寒/热 温/凉 虚/实 补/泻 升/降 浮/沉 表/里 燥/湿 收/散 迟/数 有毒/无毒 小毒/无毒 大毒/无毒 忌用/可用 禁用/可用 慎用/可用 禁忌/适宜 宜/忌 恶寒/恶热 自汗/无汗 汗出/无汗 "
    "口渴/不渴 便秘/泄泻 喜温/喜凉 拒按/喜按 加重/缓解 增加/减少 亢盛/不足 上炎/下陷 外感/内伤 生用/炙用 先煎/后下 久服/中病即止"
).split()))
NUMBER = "CASE WHEN v SIMILAR TO '[0-9].*' THEN v::DOUBLE WHEN length(v) = 2 AND v[1] = '十' AND strpos('一二三四五六七八九十', v[2]) > 0 THEN 10.0 + strpos('一二三四五六七八九十', v[2]) WHEN v = '十半' THEN 10.5 WHEN v = '半' THEN 0.5 WHEN length(v) = 1 THEN strpos('一二三四五六七八九十', v) END"


def judged(pairs_: str) -> str:
    """CTEs up to verdict (a, b, label, strength, reason) of the pairs of statements in a relation (a, b)."""
    whole = lambda x: f"CASE WHEN length({squeeze(x)}) = 1 THEN [{squeeze(x)}] ELSE {bigrams(x)} END"
    return f"""{TERMS}, ab AS (SELECT DISTINCT a, b FROM {pairs_}), texts AS (SELECT DISTINCT text FROM (SELECT a AS text FROM ab UNION ALL SELECT b FROM ab)),
fact AS (SELECT text, {entities('text')} AS e, {whole('text')} AS p, CASE WHEN len({parts('text', '[^。！？；\n，,]+', 4)}) = 0 THEN [text] ELSE {parts('text', '[^。！？；\n，,]+', 4)} END AS c FROM texts),
neg AS (SELECT *, list_filter(e, lambda t: {' OR '.join(f"contains(text, '{c}' || t)" for c in '不无非未勿莫否')}) AS ne FROM fact),
clause AS (SELECT text, c, {entities('c')} AS ce, {whole('c')} AS cp FROM (SELECT text, unnest(c) AS c FROM fact)),
opposite(n, x, y) AS (VALUES {OPPOSITE_ROWS}),
topic AS (SELECT DISTINCT a, b, i.c AS ic, j.c AS jc FROM ab JOIN clause i ON i.text = a JOIN clause j ON j.text = b WHERE list_has_any(i.ce, j.ce) OR ({jaccard('i.cp', 'j.cp')}) >= 0.3),
against AS (SELECT a, b, min(n) AS n FROM topic JOIN opposite ON (contains(ic, x) AND NOT contains(ic, y) AND contains(jc, y) AND NOT contains(jc, x)) OR (contains(ic, y) AND NOT contains(ic, x) AND contains(jc, x) AND NOT contains(jc, y)) GROUP BY a, b),
place AS (SELECT text, unnest(range(1, length(text) + 1)) AS k FROM texts WHERE regexp_matches(text, '(g|克|钱|两|枚|升|合|片)')),
dose AS (SELECT text, k, regexp_extract(substr(text, k), '^(\\d+(?:\\.\\d+)?|[一二三四五六七八九十半]+)\\s*(g|克|钱|两|枚|升|合|片)', ['v', 'u']) AS m, substr(text, greatest(1, k - 12), k - greatest(1, k - 12)) AS w FROM place
  WHERE NOT regexp_matches(substr(text, greatest(1, k - 2), least(2, k - 1)), '[0-9一二三四五六七八九十半]$|[0-9][.]$')),
given AS (SELECT text, k, w, m.v AS v, m.u AS u FROM dose WHERE m.v <> ''),
named AS (SELECT text, k, v, u, term FROM given JOIN terms ON type = 'herb' AND contains(w, term) QUALIFY row_number() OVER (PARTITION BY text, k ORDER BY length(w) - strpos(reverse(w), reverse(term)) - length(term) DESC, length(term) DESC) = 1),
told AS (SELECT text, term, k, ({NUMBER}) * CASE WHEN u = '钱' THEN 3.0 ELSE 1.0 END AS q FROM named WHERE ({NUMBER}) IS NOT NULL),
herb AS (SELECT text, term, min(k) AS first, arg_max(q, k) AS q FROM told GROUP BY ALL),
differ AS (SELECT a, b, i.term, i.q AS qa, j.q AS qb FROM ab JOIN herb i ON i.text = a JOIN herb j ON j.text = b AND j.term = i.term WHERE abs(i.q - j.q) > 0.25 * greatest(i.q, j.q, 1e-6) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY i.first) = 1),
both_ AS (SELECT ab.a, ab.b, f.e AS ea, g.e AS eb, {jaccard('f.p', 'g.p')} AS sim,
  list_sort(list_filter(list_intersect(f.e, g.e), lambda t: list_contains(f.ne, t) <> list_contains(g.ne, t) AND len(list_filter(CASE WHEN list_contains(f.ne, t) THEN g.c ELSE f.c END, lambda c: contains(c, t))) > 0))[1] AS negation
  FROM ab JOIN neg f ON f.text = ab.a JOIN neg g ON g.text = ab.b),
known AS (SELECT both_.*, CASE WHEN negation IS NOT NULL THEN 0.9 WHEN against.n IS NOT NULL THEN 0.85 WHEN differ.term IS NOT NULL THEN 0.8 END AS power,
  CASE WHEN negation IS NOT NULL THEN 'negation:' || negation WHEN against.n IS NOT NULL THEN 'antonym:' || x || '↔' || y WHEN differ.term IS NOT NULL THEN 'dose:' || differ.term || '(' || qa || 'vs' || qb || ')' END AS why
  FROM both_ LEFT JOIN against USING (a, b) LEFT JOIN opposite ON opposite.n = against.n LEFT JOIN differ USING (a, b)),
ruled AS (SELECT *, CASE WHEN sim >= 0.55 AND why IS NULL THEN 1 WHEN NOT list_has_any(ea, eb) AND sim < 0.35 THEN 2 WHEN why IS NOT NULL THEN 3 WHEN sim >= 0.7 * 0.55::DOUBLE AND len(ea) >= 0 AND len(eb) > 0 AND list_has_all(ea, eb) THEN 4 ELSE 5 END AS rule FROM known),
verdict AS (SELECT a, b, CASE rule WHEN 1 THEN 'entailment' WHEN 3 THEN 'contradiction' WHEN 4 THEN 'entailment' ELSE 'neutral' END AS label, round(CASE rule WHEN 1 THEN least(1.0, sim) WHEN 2 THEN 0 WHEN 3 THEN power ELSE sim END, 3)::DOUBLE AS strength,
  CASE rule WHEN 1 THEN 'content_overlap=' || printf('%.2f', sim) WHEN 2 THEN 'no_shared_entity' WHEN 3 THEN why WHEN 4 THEN 'entity_subset' ELSE 'insufficient_overlap' END AS reason FROM ruled)"""


ANSWERS = "SELECT DISTINCT id, answer FROM build_corpus WHERE answer IS NOT NULL"
ORACLES["l01_judged"] = f"""WITH x AS (SELECT id, {parts('answer', '[^。！？；\n，,]+', 4)} AS c FROM ({ANSWERS})), y AS (SELECT id, c, unnest(range(1, len(c))) AS k FROM x WHERE len(c) > 1), pr AS (SELECT id, k - 1 AS clause, c[k] AS a, c[k + 1] AS b FROM y), {judged('pr')}
SELECT id, pr.clause, label, strength, reason FROM pr JOIN verdict USING (a, b)"""
CLAIMS = parts("regexp_replace(answer, '〔\\d+〕|\\[[\\w#]+\\]', '', 'g')", "[^。！？；\\n]+", 8)
ORACLES["l06_consistency"] = f"""WITH x AS (SELECT row_number() OVER () AS r, id, {CLAIMS} AS c FROM ({ANSWERS})), y AS (SELECT r, c, unnest(range(1, len(c))) AS i FROM x WHERE len(c) > 1), z AS (SELECT r, c, i, unnest(range(i + 1, len(c) + 1)) AS j FROM y), pr AS (SELECT r, c[i] AS a, c[j] AS b FROM z), {judged('pr')},
n AS (SELECT r, count(*) AS pairs, count(*) FILTER (WHERE label = 'contradiction') AS bad FROM pr JOIN verdict USING (a, b) GROUP BY r)
SELECT id, coalesce(round(1 - bad / pairs, 4), 1.0)::DOUBLE AS score, coalesce(bad, 0)::BIGINT AS n_conflicts FROM x LEFT JOIN n USING (r)"""

# No line of these tables is longer than a chunk, so units are whole sections or lines.
ORACLES["c07_chunks"] = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, title, text FROM (SELECT doc_id, text, any_value(title) AS title FROM source_documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)),
l AS (SELECT r, doc_id, title, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM d),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level, {strip("regexp_replace(line, '^#+', '')")} AS head, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
s AS (SELECT *, count(level) OVER (PARTITION BY r ORDER BY k) AS section, {heading_state().replace('PARTITION BY doc_id', 'PARTITION BY r')} FROM m),
b AS (SELECT r, doc_id, title, section, k, {strip('line')} AS body, off + length(line) - length(regexp_replace(line, '^{WS}+', '')) AS start, list_filter([h1, h2, h3, h4, h5, h6], lambda h: h IS NOT NULL AND h <> '') AS path FROM s WHERE level IS NULL AND {squeeze('line')} <> ''),
g AS (SELECT r, doc_id, any_value(title) AS title, section, any_value(path) AS path, list({token_count('body')} ORDER BY k) AS sizes, list(start ORDER BY k) AS starts, list(start + length(body) ORDER BY k) AS ends FROM b GROUP BY r, doc_id, section),
u AS (SELECT r, doc_id, section, CASE WHEN len(path) > 1 THEN {token_count("'〈' || array_to_string(path, '·') || '〉'")} ELSE 0 END AS used, CASE WHEN list_sum(sizes) <= 480 THEN [list_sum(sizes)::BIGINT] ELSE sizes END AS sizes, CASE WHEN list_sum(sizes) <= 480 THEN [starts[1]] ELSE starts END AS starts, CASE WHEN list_sum(sizes) <= 480 THEN [ends[len(ends)]] ELSE ends END AS ends FROM g),
v AS (SELECT *, list_transform(range(0, len(sizes) + 1), lambda n: coalesce(list_sum(sizes[1:n]), 0)::BIGINT) AS sums, greatest(256 - used, 24) AS budget, greatest(480 - used, 24) AS hard FROM u),
w AS (SELECT r, section, 0::BIGINT AS n, 0::BIGINT AS first, 0::BIGINT AS new, 0::BIGINT AS upto FROM v UNION ALL
  SELECT r, section, n + 1, CASE WHEN sums[e + 1] - sums[again + 1] <= hard // 2 THEN again ELSE e END, e, e FROM (
    SELECT *, greatest(first, len(list_filter(sums, lambda x: x < sums[e + 1] - 32))) AS again FROM (
      SELECT w.r, w.section, w.n, w.first, v.sums, v.hard, greatest(w.new + 1, len(list_filter(v.sums, lambda x: x <= v.sums[w.first + 1] + v.budget)) - 1) AS e FROM w JOIN v ON v.r = w.r AND v.section = w.section WHERE w.new < len(v.sizes)))),
x AS (SELECT r, section, n, lag(first) OVER (PARTITION BY r, section ORDER BY n) AS a, upto AS z FROM w),
o AS (SELECT doc_id, v.r, starts[a + 1] AS char_start, ends[z] AS char_end, used + sums[z + 1] - sums[a + 1] AS n_tokens, row_number() OVER (PARTITION BY v.r ORDER BY section, n) - 1 AS seq FROM x JOIN v USING (r, section) WHERE n > 0)
SELECT doc_id || '#c' || lpad(seq::VARCHAR, 3, '0') AS chunk_id, seq, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, n_tokens::BIGINT AS n_tokens, 'semantic' AS split_method FROM o"""


# ---------------------------------------------------------------- search rounds and answers
BM25_POOL = f"{BM25_RANKED}, pool AS (SELECT query_id, chunk_id, round(score / (score + 10), 6) AS score FROM bm25 WHERE rank <= 8)"
KEYWORDS_OF = f"list_filter({tokens('text')}, lambda t: length(t) >= 2)[1:6]"
#: A list without its repeats, each at its first place.
ONCE = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
ORACLES["a04_refined"] = f"""WITH {TERMS}, q AS (SELECT query_id, text, {focus_case('text')} AS f, {entities('text')} AS e, {KEYWORDS_OF} AS k FROM ({QUERIES})),
p AS (SELECT query_id, f, list_concat(list_concat(k, list_sort(e)), list_filter(string_split(f, ' '), lambda x: x <> '')) AS l FROM q), o AS (SELECT query_id, f, array_to_string({ONCE('l')}, ' ') AS wanted FROM p),
h AS (SELECT query_id, wanted, CASE string_split(f, ' ')[1] WHEN '主治' THEN '功效 应用 适应症' WHEN '组成' THEN '药味 方剂组成' WHEN '使用注意' THEN '禁忌 慎用 孕妇' WHEN '辨证论治' THEN '证型 治法 代表方' WHEN '性味归经' THEN '四气五味 归经' WHEN '出处' THEN '来源 载于 首见' ELSE '中医 治疗 方药' END AS other FROM o)
SELECT query_id, {strip('wanted')} AS query, {strip("wanted || ' ' || other")} AS again FROM h"""
ORACLES["a05_conflict_query"] = f"""WITH {TERMS}, q AS (SELECT query_id, regexp_extract_all(text, (SELECT p FROM pattern)) AS e, {focus_case('text')} AS f FROM ({QUERIES})),
p AS (SELECT query_id, list_concat(list_concat(e, list_filter(string_split(f, ' '), lambda x: x <> '')), ['禁忌', '注意']) AS l FROM q) SELECT query_id, array_to_string({ONCE('l')}, ' ') AS query FROM p"""
ORACLES["a06_merged_pools"] = f"WITH {BM25_RANKED}, {DENSE_RANKED} SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, round(score / (score + 10), 6) AS score FROM bm25 UNION ALL SELECT query_id, chunk_id, score FROM dense) GROUP BY ALL"
EVIDENCE = parts(f"regexp_replace({strip('text')}, '^〈[^〉]*〉\\s*', '')", "[^。！？；\\n]*[。！？；\\n]|[^。！？；\\n]+", 6)
ORACLES["a11_composed"] = f"""WITH {BM25_POOL}, {TERMS}, cc AS ({LATEST_CHUNKS}), ev AS (SELECT query_id, chunk_id, place, score, text, coalesce(ocr_noise, 0) AS noise FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM pool QUALIFY place <= 5) JOIN cc USING (chunk_id)),
q AS (SELECT query_id, {entities('text')} AS e, list_distinct({tokens('text')}) AS qt FROM ({QUERIES})),
s AS (SELECT query_id, chunk_id, place, score, noise, unnest({EVIDENCE}) AS s, unnest(range(0, len({EVIDENCE}))) AS pos FROM ev),
v AS (SELECT s.*, round((0.55::DOUBLE * CASE WHEN len(e) > 0 THEN len(list_intersect(e, {entities('s')})) / len(e) ELSE 0.0 END + 0.45::DOUBLE * ({coverage('qt', tokens('s'))})) * (0.5::DOUBLE + 0.5::DOUBLE * score) * (1 - least(noise, 0.2)), 8) AS value FROM s JOIN q USING (query_id)),
once AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, substr({squeeze('s')}, 1, 40) ORDER BY value DESC, place, pos) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, place, pos) AS claim FROM once QUALIFY claim <= 8),
block AS (SELECT query_id, chunk_id, place, string_agg(s, '' ORDER BY claim) AS block FROM best GROUP BY ALL),
run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS mark, sum(length(block)) OVER (PARTITION BY query_id ORDER BY place) AS upto FROM block),
told AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY query_id ORDER BY place), 0) <= 600 AS cited FROM run),
body AS (SELECT query_id, coalesce(string_agg('〔' || mark || '〕' || block, chr(10) ORDER BY place) FILTER (WHERE upto <= 600), '') AS body, string_agg(chunk_id, ' ' ORDER BY place) FILTER (WHERE cited) AS citations FROM told GROUP BY 1),
lead_ AS (SELECT query_id, regexp_replace(s, '[。；]+$', '') AS top FROM best WHERE claim = 1)
SELECT query_id, CASE WHEN starts_with(body, substr(top, 1, 10)) THEN body ELSE '根据检索到的证据：' || top || '。' || chr(10) || chr(10) || body END AS answer, citations FROM body JOIN lead_ USING (query_id)"""

POINTING = "它|它们|该药|此药|这味药|该方|此方|本方|上方|这个方|那个方|这个|那个|前述|上述|此证|该证|这种|他的|她的"
RECENT = " || ".join(f"coalesce({who}['{kind}'], [])[1:2]" for who, kind in [("a", "formula"), ("a", "pattern"), ("a", "disease"), ("u", "formula"), ("u", "herb"), ("u", "pattern"), ("u", "disease"), ("a", "symptom"), ("u", "symptom"), ("u", "western_disease")])
ORACLES["v22_memory_effect"] = f"""WITH {turns_cte()}, {TERMS},
w AS (SELECT session, turn, role, text, last_value(CASE WHEN role = 'assistant' THEN entities END IGNORE NULLS) OVER before AS a, last_value(CASE WHEN role = 'user' THEN entities END IGNORE NULLS) OVER before AS u, lead(role) OVER (PARTITION BY session ORDER BY turn) AS nr, lead(entities) OVER (PARTITION BY session ORDER BY turn) AS ne
  FROM t WINDOW before AS (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, {entities('text')} AS e, coalesce(flatten(map_values(ne)), []) AS answered FROM w WHERE role = 'user' AND nr = 'assistant' AND text IS NOT NULL),
r AS (SELECT *, list_filter({RECENT}, lambda x: NOT contains(text, x)) AS l FROM q),
d AS (SELECT *, CASE WHEN (regexp_matches(text, '{POINTING}') OR len(e) = 0) AND (a IS NOT NULL OR u IS NOT NULL) THEN ({ONCE('l')})[1:3] ELSE [] END AS added FROM r)
SELECT CASE WHEN regexp_matches(text, '{POINTING}') THEN 'points_back' WHEN len(e) = 0 THEN 'names_nothing' ELSE 'direct' END AS kind, count(*) AS n, round(avg(CASE WHEN len(added) > 0 THEN 1.0 ELSE 0.0 END), 4) AS completed,
  round(avg(CASE WHEN list_has_any(list_concat(e, added), answered) THEN 1.0 ELSE 0.0 END), 4) AS hit, round(avg(CASE WHEN list_has_any(e, answered) THEN 1.0 ELSE 0.0 END), 4) AS hit_without FROM d GROUP BY 1"""

# Long-term writes: similarities and verdicts of all facts of a key, then one step for each fact in order.
WEIGHT = "CASE type WHEN 'formula' THEN 1.0 WHEN 'herb' THEN 0.9 WHEN 'pattern' THEN 0.85 WHEN 'disease' THEN 0.85 WHEN 'western_disease' THEN 0.6 WHEN 'symptom' THEN 0.7 WHEN 'meridian' THEN 0.45 ELSE 0.3 END"
ORACLES["m10_writes"] = f"""WITH RECURSIVE {turns_cte()}, fs AS (SELECT session AS key, turn, unnest({parts('text', SENTENCE)}) AS c, unnest(range(0, len({parts('text', SENTENCE)}))) AS pos FROM t WHERE role = 'user' AND text IS NOT NULL),
facts AS (SELECT key, turn * 4 + row_number() OVER (PARTITION BY key, turn ORDER BY pos) - 1 AS seq, c FROM fs WHERE regexp_matches(c, (SELECT string_agg(term, '|') FROM lexicon WHERE length(term) >= 2)) QUALIFY row_number() OVER (PARTITION BY key, turn ORDER BY pos) <= 4),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM facts), pr AS (SELECT x.c AS a, y.c AS b FROM numbered x JOIN numbered y ON x.key = y.key AND y.i > x.i), {judged('pr')},
gram AS {grams('SELECT DISTINCT c AS key, c AS text FROM facts', 'key')}, sims AS (SELECT x.key AS a, y.key AS b, sum(x.w * y.w) AS s FROM gram x JOIN gram y ON x.bucket = y.bucket JOIN (SELECT DISTINCT a, b FROM pr UNION SELECT DISTINCT b, a FROM pr) p ON p.a = x.key AND p.b = y.key GROUP BY ALL),
importance AS (SELECT c, round(least(1.0, 0.15 + 0.85 * (1 - exp(-coalesce(sum({WEIGHT}), 0) / 2))), 4)::DOUBLE AS weight FROM (SELECT DISTINCT c, unnest({entities('c')}) AS term FROM facts) JOIN terms USING (term) GROUP BY c),
tab AS (SELECT x.key, y.i AS i, list(coalesce(sims.s, 0) ORDER BY x.i) AS s, list(coalesce(v.label, '') ORDER BY x.i) AS l, list(coalesce(v.reason, '') ORDER BY x.i) AS r FROM numbered x JOIN numbered y ON x.key = y.key LEFT JOIN sims ON sims.a = x.c AND sims.b = y.c LEFT JOIN verdict v ON v.a = x.c AND v.b = y.c GROUP BY x.key, y.i),
line AS (SELECT n.key, n.seq, n.i, n.c, coalesce(weight, 0.15) AS weight, tab.s, tab.l, tab.r, 'mem_' || substr(md5(n.key || chr(31) || n.c || chr(31) || n.seq), 1, 10) AS new_id, length(n.c) AS size, (SELECT list(length(m.c) ORDER BY m.i) FROM numbered m WHERE m.key = n.key) AS sizes FROM numbered n JOIN tab ON tab.key = n.key AND tab.i = n.i LEFT JOIN importance USING (c)),
walk AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS seq, ''::VARCHAR AS action, NULL::VARCHAR AS record_id, NULL::DOUBLE AS importance, NULL::DOUBLE AS similarity, NULL::VARCHAR AS reason, []::STRUCT(id VARCHAR, c BIGINT, v BIGINT, w DOUBLE)[] AS held FROM numbered UNION ALL
  SELECT key, i, seq, action, CASE action WHEN 'rejected_low_importance' THEN NULL WHEN 'merged' THEN near[1].r.id WHEN 'conflict_superseded' THEN new_id ELSE new_id END, weight, CASE action WHEN 'rejected_low_importance' THEN NULL WHEN 'conflict_superseded' THEN round(bad.s, 4) ELSE round(near[1].s, 4) END,
    CASE action WHEN 'conflict_superseded' THEN why[bad.r.c] END,
    CASE action WHEN 'rejected_low_importance' THEN held WHEN 'merged' THEN list_transform(held, lambda h: CASE WHEN h.id = near[1].r.id THEN {{'id': h.id, 'c': CASE WHEN size > sizes[h.c] THEN i ELSE h.c END, 'v': i, 'w': greatest(h.w, weight)}} ELSE h END)
      WHEN 'conflict_superseded' THEN list_append(list_filter(held, lambda h: h.id <> bad.r.id), {{'id': new_id, 'c': i, 'v': i, 'w': weight}}) ELSE list_append(held, {{'id': new_id, 'c': i, 'v': i, 'w': weight}}) END
  FROM (SELECT *, CASE WHEN weight < 0.5 THEN 'rejected_low_importance' WHEN len(near) > 0 AND near[1].s >= 0.88 THEN 'merged' WHEN bad IS NOT NULL THEN 'conflict_superseded' ELSE 'inserted' END AS action
    FROM (SELECT *, list_filter(near, lambda x: x.s >= 0.45 AND labels[x.r.c] = 'contradiction')[1] AS bad
      FROM (SELECT n.key, n.i, n.seq, n.weight, n.new_id, n.size, n.sizes, n.l AS labels, n.r AS why, w.held, list_transform(list_sort(list_transform(w.held, lambda h, k: {{'o': -n.s[h.v], 'k': k, 's': n.s[h.v], 'r': h}})), lambda x: {{'s': x.s, 'r': x.r}})[1:5] AS near FROM walk w JOIN line n ON n.key = w.key AND n.i = w.i + 1))))
SELECT key, seq::BIGINT AS seq, action, record_id, importance, similarity, reason, len(held)::BIGINT AS n_active FROM walk WHERE i > 0"""

RECORDS = f"SELECT CASE WHEN source_type = 'qa' THEN doc_id ELSE concat_ws('|', doc_id, array_to_string(coalesce(title_path, []), '>')) END AS record_key, source_type, chunk_id, doc_id, seq, text, coalesce(title_path, []) AS path, meta['doc_title'] AS title FROM ({LATEST_CHUNKS})"
NAMED = f"r AS ({RECORDS}), f AS (SELECT record_key, path, source_type, doc_id, title FROM r QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY seq, chunk_id) = 1), named AS (SELECT record_key, CASE WHEN source_type = 'qa' THEN coalesce(title, doc_id) WHEN len(path) >= 2 THEN path[-1] ELSE coalesce(path[1], '') END AS term FROM f), entry AS (SELECT r.*, term FROM r JOIN named USING (record_key))"
ORACLES["v14_further_items"] = f"""WITH {TERMS}, {NAMED},
l AS (SELECT chunk_id, regexp_extract_all(text, (SELECT p FROM pattern)) AS l FROM entry), o AS (SELECT chunk_id, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS k FROM l),
g AS (SELECT chunk_id, list(e ORDER BY k) FILTER (WHERE type = 'formula') AS formula, list(e ORDER BY k) FILTER (WHERE type = 'herb') AS herb, list(e ORDER BY k) FILTER (WHERE type = 'pattern') AS pattern_, list(e ORDER BY k) FILTER (WHERE type = 'symptom') AS symptom FROM (SELECT chunk_id, e, min(k) AS k FROM o GROUP BY ALL) JOIN terms ON term = e GROUP BY chunk_id),
c AS (SELECT entry.*, formula, herb, pattern_, symptom FROM entry LEFT JOIN g USING (chunk_id)),
own AS (SELECT record_key, CASE source_type WHEN 'qa' THEN term WHEN 'classic' THEN '“' || term || '”一语出自哪部书？' ELSE term || '的医案用了什么方药？' END AS question, source_type AS item_type, chunk_id FROM c WHERE source_type IN ('qa', 'classic', 'case') QUALIFY row_number() OVER (PARTITION BY record_key, source_type ORDER BY seq, chunk_id) = 1),
dia AS (SELECT record_key, '出现' || symptom[1] || '与' || symptom[2] || '，应辨为什么证？' AS question, 'diagnosis' AS item_type, chunk_id FROM c WHERE len(pattern_) > 0 AND len(symptom) > 1 QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY seq, chunk_id) = 1),
hop AS (SELECT record_key, formula[1] || '中的' || herb[1] || '起什么作用？' AS question, 'multi_hop' AS item_type, chunk_id, herb[1] AS h FROM c WHERE len(formula) > 0 AND len(herb) > 0 QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY seq, chunk_id) = 1)
SELECT * FROM own UNION SELECT * FROM dia UNION SELECT record_key, question, item_type, chunk_id FROM hop UNION SELECT hop.record_key, question, item_type, entry.chunk_id FROM hop JOIN entry ON entry.term = h"""
ORACLES["q09_keywords"] = f"SELECT keyword, count(*) AS n FROM (SELECT DISTINCT id, question, answer FROM build_corpus), (SELECT unnest([{quoted(KEYWORDS)}]) AS keyword) WHERE contains(concat_ws(chr(10), question, answer), keyword) GROUP BY 1"
ORACLES["h23_recomputed"] = f"""WITH {BM25_RANKED}, b AS (SELECT query_id, score < 30 AS refused FROM bm25 WHERE rank = 1), i AS (SELECT DISTINCT qid AS query_id, item_type FROM eval_items), r AS (SELECT item_type = 'unanswerable' AS un, coalesce(refused, true) AS refused FROM i LEFT JOIN b USING (query_id))
SELECT 'bm25' AS mode, count(*) FILTER (WHERE un) AS n_unanswerable, count(*) FILTER (WHERE un AND refused) AS n_refused, count(*) FILTER (WHERE NOT un) AS n_answerable, count(*) FILTER (WHERE NOT un AND refused) AS n_over_refused,
  round(count(*) FILTER (WHERE un AND refused) / nullif(count(*) FILTER (WHERE un), 0), 4) AS refusal_accuracy, round(count(*) FILTER (WHERE NOT un AND refused) / nullif(count(*) FILTER (WHERE NOT un), 0), 4) AS over_refusal FROM r"""
ORACLES["n06_vocabulary"] = f"""WITH {NAMED} SELECT DISTINCT term, type FROM (SELECT term, type FROM lexicon WHERE term IS NOT NULL UNION ALL SELECT trim(term), 'other' FROM entry WHERE source_type = 'textbook' AND length(term) BETWEEN 2 AND 12
  UNION ALL SELECT trim(d), 'western_disease' FROM (SELECT unnest(string_split(related_diseases, '|')) AS d FROM build_corpus) WHERE length(d) BETWEEN 2 AND 12)"""
