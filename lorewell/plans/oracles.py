"""For each core query the DuckDB SQL that gives the same rows, built from a few shared expressions."""

from __future__ import annotations

from lorewell.functions.text import STOPWORDS
from lorewell.functions.urls import TRACKING
from lorewell.operators.graph import BEGINNER, DEEP
from lorewell.operators.notes import KEYWORDS, SYSTEM
from lorewell.operators.retrieval import BANNER, CHECKS, NO_CONTEXT
from lorewell.operators.topics import ALIASES, TOPICS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tok(c: str) -> str:
    return rf"list_filter(string_split_regex(trim(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g')), '\s+'), lambda x: length(x) >= 2 AND NOT list_contains({_list(STOPWORDS)}, x))"


def strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"


def words(c: str) -> str:
    return rf"(CASE WHEN {strip(c)} = '' THEN 0 ELSE len(string_split_regex({strip(c)}, '\s+')) END)::BIGINT"


def even(c: str) -> str:
    return f"round_even(({c})::DOUBLE, 0)"


def shown(t: str = "title", f: str = "coalesce(canonical_id, id)") -> str:
    return f"CASE WHEN lower(trim(coalesce({t}, ''))) IN ('', 'untitled', 'unknown resource') THEN {f} ELSE trim({t}) END"


def provider(c: str) -> str:
    n = f"replace(replace(lower(coalesce({c}, '')), '-', '_'), ' ', '_')"
    return f"CASE {n} WHEN 'ollamacloud' THEN 'ollama_cloud' WHEN 'ollamalocal' THEN 'ollama_local' WHEN 'openai' THEN 'openai_compatible' WHEN 'openaicompatible' THEN 'openai_compatible' ELSE {n} END"


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(u: str, g: int) -> str:
    return f"regexp_extract({u}, '{_URL}', {g})"


def norm_url(u: str) -> str:
    kept = f"list_filter(string_split({part(u, 4)}, '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND NOT list_contains({_list(TRACKING)}, string_split(p, '=')[1]))"
    names = f"list_transform({kept}, lambda p: string_split(p, '=')[1])"
    # names in the order of their first place
    query = f"array_to_string(list_sort(list_transform({kept}, lambda p, i: {{'a': list_position({names}, string_split(p, '=')[1]), 'i': i, 'p': p}})).list_transform(lambda x: x.p), '&')"
    path = f"CASE WHEN {part(u, 3)} = '/' THEN '/' ELSE regexp_replace({part(u, 3)}, '/+$', '') END"
    host = rf"regexp_replace(lower({part(u, 2)}), '^www\.', '')"
    return f"CASE WHEN {part(u, 2)} <> '' THEN lower({part(u, 1)}) || '://' || {host} || {path} || (CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END) END"


def video(u: str) -> str:
    return rf"coalesce(nullif(regexp_extract({u}, '[?&]v=([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract({u}, '/embed/([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract({u}, '^[a-z]+://(?:youtu\.be|tube\.invalid)/([A-Za-z0-9_-]{{11}})', 1), ''))"


def url_time(u: str) -> str:
    one = lambda p: f"try_cast(CASE WHEN regexp_matches(regexp_replace(regexp_extract({u}, '[?&]{p}=([^&#]*)', 1), 's+$', ''), '^[0-9]+$') THEN regexp_replace(regexp_extract({u}, '[?&]{p}=([^&#]*)', 1), 's+$', '') END AS INTEGER)"
    return f"coalesce({one('t')}, {one('start')})"


def domain(u: str) -> str:
    return rf"nullif(regexp_replace(lower({part(u, 2)}), '^www\.', ''), '')"


def keyword(c: str, k: str) -> str:
    if " " in k:
        return f"contains({c}, '{k}')"
    q = "".join("\\" + x if not (x.isalnum() or x == "_") else x for x in k)
    return rf"regexp_matches({c}, '(^|[^\p{{L}}\p{{N}}_]){q}($|[^\p{{L}}\p{{N}}_])')"


def clock(c: str) -> str:
    s = f"floor({c})::INT"
    return f"(CASE WHEN {s} // 3600 > 0 THEN printf('%02d:%02d:%02d', {s} // 3600, {s} % 3600 // 60, {s} % 60) ELSE printf('%02d:%02d', {s} // 60, {s} % 60) END)"


def slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def trimmed(c: str, cap: int) -> str:
    head = f"substring({c}, 1, {cap - 3})"
    back = f"length({head}) - instr(reverse({head}), ' ')"
    return rf"CASE WHEN length({c}) <= {cap} THEN {c} ELSE regexp_replace(CASE WHEN instr({head}, ' ') > 0 AND {back} > 0 THEN substring({head}, 1, {back}) ELSE {head} END, '\s+$', '') || '...' END"


TOPIC_TEXT = f"lower(concat_ws(' ', {shown()}, array_to_string(tags, ' '), coalesce(description, ''), coalesce(notes_from_user, ''), coalesce(author, ''), coalesce(json_extract_string(CASE WHEN json_valid(extra) THEN extra END, '$.subtitle'), ''), coalesce(json_extract_string(CASE WHEN json_valid(extra) THEN extra END, '$.site_name'), '')))"
TOPIC_LIST = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(keyword('t', k) for k in ks)} THEN '{t}' END" for t, ks in TOPICS.items()) + "], lambda x: x IS NOT NULL)"
ASSIGNED = f"assigned AS (SELECT id, {TOPIC_LIST} AS topics FROM (SELECT id, {TOPIC_TEXT} AS t FROM resources))"
LEARNED = "coalesce(user_consumed_at, processed_at, first_seen_at)"
FLAG = lambda k: f"json_extract_string(extra, '$.{k}')"
BUCKETS = f"""list_filter([CASE WHEN status IN ('failed_retryable', 'failed_permanent') THEN 'failed' END, CASE WHEN {FLAG('quality_status')} = 'weak' THEN 'weak' END,
  CASE WHEN {FLAG('requires_human_review')} = 'true' THEN 'human_review' END, CASE WHEN coalesce(generated_note_path, '') = '' THEN 'missing_note' END,
  CASE WHEN status = 'needs_manual_markdown' THEN 'manual' END, CASE WHEN lower(trim(coalesce(title, ''))) IN ('', 'untitled', 'unknown resource') THEN 'untitled' END], lambda x: x IS NOT NULL)"""
DEPTH = f"sign({' '.join(f'- contains(l, {chr(39)}{p}{chr(39)})::INT' for p in BEGINNER)} {' '.join(f'+ contains(l, {chr(39)}{p}{chr(39)})::INT' for p in DEEP)})::INT"

# -- search -----------------------------------------------------------------------------------------------------------
DOCS = "docs AS (SELECT DISTINCT ON (chunk_id) chunk_id, resource_id, source_type, text, title, citation_label AS label FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id)"
FIELDS = f"""raw AS (SELECT chunk_id, 'text' AS f, 1.0::DOUBLE AS w, unnest({tok('text')}) AS term FROM docs UNION ALL SELECT chunk_id, 'title', 2.0::DOUBLE, unnest({tok('title')}) FROM docs
  UNION ALL SELECT chunk_id, 'label', 0.5::DOUBLE, unnest({tok('label')}) FROM docs),
counts AS (SELECT chunk_id, f, w, term, {even('count(*) * w')}::BIGINT AS tf FROM raw GROUP BY chunk_id, f, w, term),
postings AS (SELECT chunk_id, term, sum(tf)::BIGINT AS tf FROM counts GROUP BY chunk_id, term),
lens AS (SELECT chunk_id, sum(s)::BIGINT AS dl FROM (SELECT chunk_id, {even('sum(tf) * w')} AS s FROM counts GROUP BY chunk_id, f, w) GROUP BY chunk_id)"""
ASKED = f"qs AS (SELECT doc_id AS query_id, coalesce(nullif(trim(title), ''), string_split(text, chr(10))[1], '') AS query FROM documents WHERE doc_id % 50 = 0), qt AS (SELECT query_id, unnest(list_distinct({tok('query')})) AS term FROM qs)"
BM25 = """dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
weights AS (SELECT p.chunk_id, p.term, CASE WHEN p.tf > 0 THEN ln((st.n - d.df + 0.5e0) / (d.df + 0.5e0) + 1e0) * p.tf * 2.5e0 / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * l.dl / st.avgdl)) ELSE 0e0 END AS w
  FROM postings p JOIN dfs d USING (term) JOIN lens l USING (chunk_id), st),
bm AS (SELECT query_id, chunk_id, round(sum(w), 6) AS score, array_to_string(list_sort(list(DISTINCT term) FILTER (w > 0)), ' ') AS matched_terms FROM weights JOIN qt USING (term) GROUP BY query_id, chunk_id HAVING round(sum(w), 6) > 0)"""
COSINE = """dfv AS (SELECT term, count(*) AS df FROM postings GROUP BY term), nv AS (SELECT count(*) AS n FROM docs), idfs AS (SELECT term, ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) AS idf FROM dfv, nv),
wv AS (SELECT chunk_id, term, tf * idf AS w FROM postings JOIN idfs USING (term) WHERE tf > 0), nrm AS (SELECT chunk_id, sqrt(sum(w * w)) AS s FROM wv GROUP BY chunk_id),
qv AS (SELECT query_id, term, idf FROM qt JOIN idfs USING (term)), qn AS (SELECT query_id, sqrt(sum(idf * idf)) AS s FROM qv GROUP BY query_id),
cs AS (SELECT query_id, chunk_id, round(sum(wv.w / nrm.s * (qv.idf / qn.s)), 6) AS score FROM wv JOIN nrm USING (chunk_id) JOIN qv USING (term) JOIN qn USING (query_id) WHERE nrm.s > 0 GROUP BY query_id, chunk_id HAVING round(sum(wv.w / nrm.s * (qv.idf / qn.s)), 6) > 0)"""


def ranked(src: str, k: int, name: str, ties: str = "chunk_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS rank FROM {src}) WHERE rank <= {k})"


BASE = f"WITH {DOCS}, {FIELDS}"
SEARCH = f"{BASE}, {ASKED}, {BM25}"
FUSED = f"""{SEARCH}, {COSINE}, {ranked('bm', 30, 'b30')}, {ranked('cs', 30, 'c30')},
bn AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM b30), cn AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM c30),
fu AS (SELECT query_id, chunk_id, round(coalesce(bn.s, 0) * 0.55e0 + coalesce(cn.s, 0) * 0.45e0, 6) AS score FROM bn FULL JOIN cn USING (query_id, chunk_id)),
fd AS (SELECT fu.*, resource_id, source_type FROM fu JOIN docs USING (chunk_id))"""
PACK = f"""{SEARCH}, {ranked('bm', 10, 'b10')},
pack AS (SELECT query_id, rank, '[cite:' || rank || ']' AS citation_label, chunk_id, resource_id, coalesce(docs.text, '') AS text, false AS truncated FROM b10 JOIN docs USING (chunk_id))"""
ANSWERS = rf"""{PACK}, qw AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9_\-]*')) AS ws FROM qs),
se AS (SELECT query_id, rank, chunk_id, resource_id, citation_label, ws, list_filter(list_transform(string_split(regexp_replace({strip('text')}, '([.!?])\s+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {strip('s')}), lambda s: s <> '') AS ss FROM pack JOIN qw USING (query_id)),
hs AS (SELECT *, list_filter(ss, lambda s: len(ws) = 0 OR list_has_any(regexp_extract_all(lower(s), '[a-z0-9][a-z0-9_\-]*'), ws)) AS hit FROM se),
ans AS (SELECT query_id, rank, chunk_id, resource_id, citation_label, array_to_string(list_transform((CASE WHEN len(hit) > 0 THEN hit ELSE ss END)[1:3], lambda s: s || ' ' || citation_label), ' ') AS answer FROM hs)"""
GRADED = rf"""{ANSWERS}, lb AS (SELECT query_id, unnest(regexp_extract_all(answer, '\[cite:\d+\]')) AS label FROM ans WHERE answer <> ''),
bad AS (SELECT query_id, count(*) AS wrong FROM (SELECT DISTINCT query_id, label FROM lb) x WHERE NOT EXISTS (SELECT 1 FROM pack p WHERE p.query_id = x.query_id AND p.citation_label = x.label) GROUP BY 1)"""
NINE = rf"""{ANSWERS}, pk AS (SELECT query_id, list(DISTINCT citation_label) AS pl, list(DISTINCT chunk_id) AS pc, list(DISTINCT resource_id) FILTER (resource_id IS NOT NULL) AS ps FROM pack GROUP BY 1),
bo AS (SELECT query_id, '{BANNER}' || chr(10) || chr(10) || string_agg('From ' || citation_label || ':' || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY rank) AS body, list(DISTINCT citation_label) AS la, list(DISTINCT chunk_id) AS uc, list(DISTINCT resource_id) FILTER (resource_id IS NOT NULL) AS us FROM ans WHERE answer <> '' GROUP BY 1),
al AS (SELECT query_id, coalesce(body, '{BANNER}' || chr(10) || chr(10) || '{NO_CONTEXT.replace(chr(39), chr(39) * 2)}') AS body, coalesce(pl, []) AS pl, coalesce(pc, []) AS pc, coalesce(ps, []) AS ps, coalesce(la, []) AS la, coalesce(uc, []) AS uc, coalesce(us, []) AS us FROM qs LEFT JOIN pk USING (query_id) LEFT JOIN bo USING (query_id)),
ck AS (SELECT *, list_distinct(list_concat(regexp_extract_all(body, '\[cite:[0-9]+\]'), la)) AS said, CASE WHEN len(pc) > 0 THEN len(list_intersect(uc, pc)) / len(pc) ELSE 1e0 END AS cc, CASE WHEN len(ps) > 0 THEN len(list_intersect(us, ps)) / len(ps) ELSE 1e0 END AS sc FROM al),
pa AS (SELECT query_id, cc, sc, [trim(body) <> '', contains(body, '{BANNER}'), true, len(pc) = 0 OR len(said) > 0, len(list_filter(said, lambda x: NOT list_contains(pl, x))) = 0, len(list_filter(us, lambda x: NOT list_contains(ps, x))) = 0,
  len(pc) = 0 OR (trim(body) <> '' AND NOT contains(body, '{NO_CONTEXT.replace(chr(39), chr(39) * 2)}')), cc > 0, sc > 0] AS ok FROM ck)"""
EVAL = f"""{SEARCH}, {ranked('bm', 10, 'b10')}, r AS (SELECT b10.*, resource_id FROM b10 JOIN docs USING (chunk_id)),
ex AS (SELECT doc_id AS query_id, resource_id FROM documents WHERE doc_id % 50 = 0 AND resource_id IS NOT NULL),
grid AS (SELECT query_id, count(DISTINCT resource_id) AS n_expected, unnest([1, 3, 5, 10]) AS k FROM ex GROUP BY query_id),
got AS (SELECT g.query_id, g.k, any_value(n_expected) AS n_expected, count(r.rank) AS returned, count(DISTINCT ex.resource_id) AS matched, min(CASE WHEN ex.resource_id IS NOT NULL THEN r.rank END) AS first_rank
  FROM grid g LEFT JOIN r ON r.query_id = g.query_id AND r.rank <= g.k LEFT JOIN ex ON ex.query_id = r.query_id AND ex.resource_id = r.resource_id GROUP BY g.query_id, g.k),
met AS (SELECT query_id, k, round(matched / n_expected, 6) AS recall, round(CASE WHEN returned > 0 THEN matched / returned ELSE 0 END, 6) AS precision, CASE WHEN matched > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(coalesce(1e0 / first_rank, 0), 6) AS mrr FROM got)"""

CITED = r"cited AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '(?s)```.*?(?:```|$)', '', 'g'), '\[source: ?([^\]]+)\]', 1))) AS chunk_id FROM documents WHERE text IS NOT NULL)"

NOTE_CONCEPTS = rf"""nl AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
nb AS (SELECT doc_id, list_concat(list_filter(list_transform(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*] ')), lambda x: trim(string_split(regexp_replace(x, '^[ \t]*[-*] +', ''), ':')[1])), lambda x: length(x) BETWEEN 2 AND 60),
  list_filter({_list(KEYWORDS)}, lambda k: contains(lower(text), lower(k)))) AS names FROM nl),
nn AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM nb), n1 AS (SELECT doc_id, lower(name) AS low, min(pos) AS pos, arg_min(name, pos) AS name FROM nn GROUP BY 1, 2),
nc AS (SELECT doc_id, name, {slug('name')} AS slug FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM n1) WHERE n <= 20 AND {slug('name')} <> '')"""

# -- graph ------------------------------------------------------------------------------------------------------------
NODE = "'resource:' || replace(id, ':', '_')"
NODES = f"""nodes AS (SELECT 'topic:' || t AS node_id, 'topic' AS type, t AS label FROM (SELECT unnest({_list(TOPICS)}) AS t) UNION ALL SELECT {NODE}, 'resource', {shown()} FROM resources
  UNION ALL SELECT 'tag:' || {slug('l')}, 'tag', l FROM (SELECT DISTINCT lower(trim(t)) AS l FROM (SELECT unnest(tags) AS t FROM resources)) WHERE l <> '')"""
EDGES = f"""rt AS (SELECT {NODE} AS r, 'topic:' || t AS t FROM (SELECT id, unnest(topics) AS t FROM assigned)),
edges AS (SELECT 'resource_has_topic' AS type, r AS source, t AS target FROM rt UNION SELECT 'topic_has_resource', t, r FROM rt
  UNION SELECT 'resource_has_tag', {NODE}, 'tag:' || {slug('lower(trim(t))')} FROM (SELECT id, unnest(tags) AS t FROM resources) WHERE trim(t) <> '')"""
GRAPH = f"WITH {ASSIGNED}, {NODES}, {EDGES}"
CLASSES = f"""WITH {ASSIGNED}, cl AS (SELECT topics, source_type, depth, count(*) AS n FROM (SELECT array_to_string(list_sort(topics), ',') AS topics, source_type, {DEPTH} AS depth
  FROM (SELECT topics, source_type, lower({shown()}) AS l FROM resources JOIN assigned USING (id))) GROUP BY ALL)"""

SECTION_SQL = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^#{1,6}\s+.+$') AS head FROM l),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
s AS (SELECT doc_id, sec, max(CASE WHEN head THEN trim(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^#+', '')) END) AS heading, string_agg(line, chr(10) ORDER BY i) FILTER (NOT head) AS body, count(*) FILTER (NOT head) AS n_body FROM g GROUP BY doc_id, sec),
k AS (SELECT *, sec = max(sec) OVER (PARTITION BY doc_id) AS is_last FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS section_no, heading, length(regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g'))::BIGINT AS n FROM k WHERE n_body > 0 OR is_last"""

def boosted(fd: str, k: int) -> str:
    """The first `k` of fused candidates with what their resources gain from one another."""
    return f"""{ASSIGNED}, {NOTE_CONCEPTS}, own AS (SELECT DISTINCT query_id, resource_id FROM {fd}), wt AS (SELECT query_id, resource_id, t FROM own JOIN (SELECT id AS resource_id, unnest(topics) AS t FROM assigned) USING (resource_id)),
        sh AS (SELECT DISTINCT query_id, resource_id FROM wt JOIN (SELECT query_id, t FROM wt GROUP BY 1, 2 HAVING count(*) > 1) USING (query_id, t)), ty AS (SELECT query_id, resource_id, r.source_type FROM own JOIN resources r ON r.id = own.resource_id),
        wc AS (SELECT query_id, resource_id, slug FROM own JOIN (SELECT DISTINCT resource_id, slug FROM nc JOIN documents USING (doc_id) WHERE resource_id IS NOT NULL) USING (resource_id)),
        sc AS (SELECT DISTINCT query_id, resource_id FROM wc JOIN (SELECT query_id, slug FROM wc GROUP BY 1, 2 HAVING count(*) > 1) USING (query_id, slug)),
        ch AS (SELECT query_id, arg_min(source_type, (-n, source_type)) AS chief, max(n) AS n FROM (SELECT query_id, source_type, count(*) AS n FROM ty GROUP BY 1, 2) GROUP BY 1),
        bo AS (SELECT ty.query_id, ty.resource_id, round(least(0.1e0, CASE WHEN sc.resource_id IS NOT NULL THEN 0.03e0 ELSE 0 END + CASE WHEN sh.resource_id IS NOT NULL THEN 0.04e0 ELSE 0 END + CASE WHEN ch.n > 1 AND ch.chief = ty.source_type THEN 0.02e0 ELSE 0 END), 6) AS boost
          FROM ty LEFT JOIN sh USING (query_id, resource_id) LEFT JOIN sc USING (query_id, resource_id) LEFT JOIN ch USING (query_id)),
        gl AS (SELECT {fd}.query_id, chunk_id, resource_id, coalesce(boost, 0) AS boost, round(score + coalesce(boost, 0), 6) AS score FROM {fd} LEFT JOIN bo USING (query_id, resource_id)), {ranked('gl', k, f'g{k}', 'resource_id, chunk_id')}"""


PAIRS = lambda *ks: " UNION ALL ".join(f"SELECT '{k}' AS kind, {e} AS value FROM {t}" for k, e, t in ks)

SQL: dict[str, str] = {
    "registry_scan": "SELECT id, status, source_type, first_seen_at FROM resources",
    "registry_pending": "SELECT id, status FROM resources WHERE status IN ('new', 'raw_saved', 'normalized', 'failed_retryable')",
    "registry_lookup": "SELECT id, canonical_id, status FROM resources WHERE id = (SELECT min(id) FROM resources)",
    "status_counts": "SELECT status, count(*) AS n FROM resources GROUP BY status",
    "keep_first_by_canonical_id": "SELECT canonical_id, min(record_no) AS record_no FROM (SELECT canonical_id, record_no FROM resources UNION ALL SELECT canonical_id, record_no FROM intake) WHERE canonical_id IS NOT NULL GROUP BY 1",
    "insert_or_skip": "SELECT canonical_id, min(record_no) AS record_no FROM intake i WHERE canonical_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM resources r WHERE r.canonical_id = i.canonical_id) GROUP BY 1",
    "latest_run_by_resource": "SELECT resource_id, arg_max(run_id, ledger_pos) AS run_id, arg_max(operation, ledger_pos) AS operation, max(ledger_pos) AS ledger_pos FROM processing_runs GROUP BY resource_id",
    "normalized_providers": f"SELECT {provider('llm_provider')} AS provider, count(*) AS n FROM resources GROUP BY 1",
    "stale_notes": f"""SELECT id, array_to_string(rs, ';') AS reasons FROM (SELECT id, list_filter([CASE WHEN status = 'failed_retryable' THEN 'failed_retryable' END, CASE WHEN coalesce(generated_note_path, '') = '' THEN 'missing_note_path' END,
        CASE WHEN prompt_version IS DISTINCT FROM 'v5' THEN 'prompt_version:' || coalesce(prompt_version, 'none') END,
        CASE WHEN p = 'mock' THEN 'provider_mismatch:mock→real' WHEN p <> 'cloud_b' THEN 'provider_mismatch:' || CASE WHEN p = '' THEN 'none' ELSE p END || '→cloud_b' WHEN llm_model <> 'wide-2' THEN 'model_mismatch:' || llm_model || '→wide-2' END], lambda x: x IS NOT NULL) AS rs
        FROM (SELECT *, {provider('llm_provider')} AS p FROM resources)) WHERE len(rs) > 0""",
    "quality_gate": "SELECT n, untitled, coverage, coverage > 0.9 AND untitled <= 2 AS passed FROM (SELECT count(*) AS n, sum(u)::BIGINT AS untitled, round(1 - avg(u::DOUBLE), 6) AS coverage FROM (SELECT (lower(trim(coalesce(title, ''))) IN ('', 'untitled', 'unknown resource'))::INT AS u FROM resources))",
    "resource_identity": f"""SELECT id, CASE WHEN source_type = 'youtube' AND {video('original_url')} IS NOT NULL THEN 'youtube:' || {video('original_url')} WHEN source_type IN ('youtube', 'webpage') THEN 'webpage:' || sha256({norm_url('original_url')})
        ELSE CASE WHEN source_type IN ('local_audio', 'local_video') THEN 'media' WHEN source_type = 'local_transcript' THEN 'transcript' ELSE source_type END || ':' || content_hash END AS computed_id, {norm_url('original_url')} AS url, {domain('original_url')} AS domain FROM resources""",
    "url_normalize": f"SELECT record_no, {norm_url('original_url')} AS url FROM intake",
    "url_video_and_time": f"SELECT * FROM (SELECT record_no, {video('original_url')} AS video_id, {url_time('original_url')} AS seconds FROM intake) WHERE video_id IS NOT NULL OR seconds IS NOT NULL",
    "merged_timestamps": f"SELECT v, array_to_string(list_sort(list(DISTINCT s)), ',') AS seconds FROM (SELECT {video('original_url')} AS v, {url_time('original_url')} AS s FROM intake) WHERE v IS NOT NULL AND s IS NOT NULL GROUP BY v",
    "domain_counts": f"SELECT {domain('original_url')} AS domain, count(*) AS n FROM resources GROUP BY 1",
    "extractor_route": f"SELECT CASE WHEN h IS NULL THEN 'file' WHEN regexp_matches(h, 'tube') THEN 'video' WHEN regexp_matches(original_url, '/blog/|/posts/') THEN 'blog' ELSE 'generic' END AS route, count(*) AS n FROM (SELECT original_url, {domain('original_url')} AS h FROM resources) GROUP BY 1",
    "resources_without_chunks": "SELECT id, status FROM resources r WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.resource_id = r.id)",
    "extra_fields": f"SELECT {FLAG('platform')} AS platform, {FLAG('quality_status')} AS quality_status, count(*) AS n, count(*) FILTER ({FLAG('requires_human_review')} = 'true') AS to_review FROM (SELECT CASE WHEN json_valid(extra) THEN extra END AS extra FROM resources) GROUP BY 1, 2",
    "newest_resources": "SELECT id, first_seen_at FROM resources ORDER BY first_seen_at DESC, id LIMIT 10",
    "chunk_projection": rf"""SELECT DISTINCT chunk_id, length(text)::BIGINT AS char_count, {words('text')} AS word_count, {even("length(coalesce(text, '')) / 4.0")}::BIGINT AS token_estimate, sha256(text) AS content_hash, '/resources/' || replace(resource_id, ':', '_') AS resource_route,
        coalesce(nullif(regexp_extract(chunk_id, '-([a-z]\d{{3,}})$', 1), ''), chunk_id) AS short_label FROM chunks""",
    "chunk_manifest": "SELECT resource_id, count(*) AS chunks, arg_min(chunk_id, (chunk_index, chunk_id)) AS first_chunk, arg_max(chunk_id, (chunk_index, chunk_id)) AS last_chunk FROM (SELECT DISTINCT chunk_id, resource_id, chunk_index FROM chunks) GROUP BY resource_id",
    "top_resources_by_chunks": "SELECT resource_id, count(*) AS chunks FROM (SELECT DISTINCT chunk_id, resource_id, chunk_index FROM chunks) GROUP BY resource_id ORDER BY chunks DESC, resource_id LIMIT 20",
    "chunks_by_source_type": "SELECT source_type, count(*) AS n FROM (SELECT DISTINCT chunk_id, source_type FROM chunks) GROUP BY 1",
    "chunk_resource_join": "SELECT status, importance, count(*) AS n FROM (SELECT DISTINCT chunk_id, resource_id FROM chunks) c JOIN resources r ON r.id = c.resource_id GROUP BY 1, 2",
    "duplicate_chunks": "SELECT chunk_id, count(*) AS copies FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "stale_char_counts": "SELECT DISTINCT chunk_id, char_count, length(text)::BIGINT AS actual FROM chunks WHERE char_count IS DISTINCT FROM length(text)",
    "chunk_issues": """SELECT * FROM (SELECT 'error' AS severity, 'empty_text' AS code, count(*) AS n FROM chunks WHERE coalesce(trim(text), '') = '' UNION ALL SELECT 'error', 'missing_label', count(*) FROM chunks WHERE coalesce(trim(citation_label), '') = ''
        UNION ALL SELECT 'error', 'missing_resource', count(*) FROM chunks WHERE coalesce(trim(resource_id), '') = '' UNION ALL SELECT 'warning', 'missing_hash', count(*) FROM chunks WHERE content_hash IS NULL
        UNION ALL SELECT 'warning', 'missing_char_count', count(*) FROM chunks WHERE char_count IS NULL UNION ALL SELECT 'warning', 'end_before_start', count(*) FROM chunks WHERE start_time IS NOT NULL AND end_time < start_time
        UNION ALL SELECT 'error', 'duplicate_chunk', count(*) FROM (SELECT chunk_id FROM chunks GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0""",
    "section_lines": SECTION_SQL,
    "greedy_line_chunks": f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), w AS MATERIALIZED (SELECT doc_id, i, {words('line')} AS n FROM l),
        f AS (SELECT doc_id, i, n, n AS held, 0 AS g FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.i, w.n, CASE WHEN f.held >= 100 THEN w.n ELSE f.held + w.n END, CASE WHEN f.held >= 100 THEN f.g + 1 ELSE f.g END FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1)
        SELECT doc_id, g AS group_no, count(*) AS lines, sum(n)::BIGINT AS words FROM f GROUP BY doc_id, g""",
    "greedy_line_texts": f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), w AS MATERIALIZED (SELECT doc_id, i, line, {words('line')} AS n FROM l),
        f AS (SELECT doc_id, i, line, n, n AS held, 0 AS g FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.i, w.line, w.n, CASE WHEN f.held >= 100 THEN w.n ELSE f.held + w.n END, CASE WHEN f.held >= 100 THEN f.g + 1 ELSE f.g END FROM f JOIN w ON w.doc_id = f.doc_id AND w.i = f.i + 1)
        SELECT doc_id, g AS group_no, sha256(string_agg(line, chr(10) ORDER BY i)) AS digest FROM f GROUP BY doc_id, g""",
    "transcript_vtt": f"SELECT chunk_id, {clock('start_time')} || ' --> ' || {clock('greatest(coalesce(end_time, start_time), start_time)')} AS cue FROM (SELECT DISTINCT chunk_id, start_time, end_time FROM chunks WHERE start_time IS NOT NULL)",
    "tokenize_vocab": f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY term",
    "document_estimates": rf"""SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE greatest(len(regexp_extract_all(s, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')), ceil(length(s) / 4.0), 1)::BIGINT END AS tokens, {words('text')} AS words, {even("length(coalesce(text, '')) / 4.0")}::BIGINT AS quarter FROM (SELECT doc_id, text, {strip('text')} AS s FROM documents)""",
    "content_hash_dedupe": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "trimmed_previews": f"SELECT doc_id, {trimmed('coalesce(text, chr(32)[1:0])', 240)} AS preview, substring(text, 1, 240) AS first FROM documents",
    "slugs": rf"""SELECT id, {slug("coalesce(title, '')")} AS slug, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[:/]+', '-', 'g'), '[^a-z0-9\-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor,
        trim(regexp_replace(replace(coalesce(title, ''), '|', '\|'), '[\r\n]+', ' ', 'g')) AS cell, {shown()} AS shown FROM resources""",
    "redacted_errors": r"SELECT DISTINCT ledger_pos, regexp_replace(regexp_replace(regexp_replace('token: abc123 Bearer xyz ' || error, 'Bearer\s+[A-Za-z0-9._~+/=-]+', '[redacted]', 'g'), '(?i)(api[_-]?key|token|authorization)(\s*[:=]\s*)[A-Za-z0-9._~+/=-]+', '\1\2[redacted]', 'g'), 'sk-[A-Za-z0-9]{8,}', '[redacted]', 'g') AS error FROM processing_runs WHERE error IS NOT NULL",
    "heading_toc": r"""SELECT doc_id, (i - 1)::INT AS line_no, length(regexp_extract(line, '^(#{1,3})[ \t]+(\S.*?)\s*$', 1))::BIGINT AS level, regexp_extract(line, '^(#{1,3})[ \t]+(\S.*?)\s*$', 2) AS title
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '^(#{1,3})[ \t]+(\S.*?)\s*$')""",
    "front_matter": r"""SELECT doc_id, regexp_extract(p[2], 'title: "?([^"\n]*)', 1) AS title, CASE WHEN len(p) > 2 THEN length(array_to_string(p[3:], '---' || chr(10)))::BIGINT END AS n_body FROM (SELECT doc_id, string_split(text, '---' || chr(10)) AS p FROM documents WHERE starts_with(text, '---' || chr(10)))""",
    "question_difficulty": r"SELECT doc_id, CASE WHEN regexp_matches(lower(q), 'compare|why|how would|tradeoff') THEN 'hard' WHEN regexp_matches(lower(q), 'how|which') THEN 'medium' ELSE 'easy' END AS difficulty, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+\?')) AS q FROM documents) GROUP BY 1, 2",
    "bullet_counts": r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*]')))::BIGINT AS bullets FROM documents WHERE text IS NOT NULL",
    "citation_counts": r"SELECT * FROM (SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\[source: ?([^\]]+)\]', 1)))::BIGINT AS citations FROM documents WHERE text IS NOT NULL) WHERE citations > 0",
    "paywalled": f"SELECT resource_id, words FROM (SELECT resource_id, sum({words('text')})::BIGINT AS words, max(regexp_matches(lower(text), 'sign in|member-only|get unlimited access|open in app')::INT) AS marked FROM chunks WHERE source_type = 'medium_markdown' GROUP BY 1) WHERE words < 200 OR marked = 1",
    "topic_assignment": f"WITH {ASSIGNED} SELECT id, array_to_string(topics, ',') AS topics FROM assigned",
    "topic_resources": f"WITH {ASSIGNED} SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM assigned) GROUP BY 1",
    "learn_chapters": f"WITH {ASSIGNED} " + "SELECT topic, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS topic FROM (SELECT topics, lower({shown()}) AS l FROM resources JOIN assigned USING (id)) WHERE list_contains(topics, '{t}') OR {' OR '.join(f'contains(l, {chr(39)}{k}{chr(39)})' for k in ks)}" for t, ks in TOPICS.items()) + ") GROUP BY 1",
    "tag_index": f"WITH {ASSIGNED} SELECT tag, count(*) AS n FROM (SELECT DISTINCT id, unnest(list_concat(list_transform(coalesce(tags, []), lambda x: lower(trim(x))), [lower(trim(source_type)), lower(trim(json_extract_string(CASE WHEN json_valid(extra) THEN extra END, '$.platform'))), lower(trim(importance))], topics)) AS tag FROM resources JOIN assigned USING (id)) WHERE tag <> '' GROUP BY 1",
    "timeline_by_month": f"""WITH {ASSIGNED}, r AS (SELECT date_trunc('month', {LEARNED}) AS period, id, CASE WHEN len(topics) > 0 THEN topics ELSE coalesce(tags, []) END AS c FROM resources JOIN assigned USING (id))
        SELECT e.period::TIMESTAMP AS period, strftime(e.period, '%B %Y') AS label, entries, coalesce(concepts, '') AS concepts FROM (SELECT period, count(*) AS entries FROM r GROUP BY 1) e LEFT JOIN (SELECT period, array_to_string(list_sort(list(DISTINCT x)), ',') AS concepts FROM (SELECT period, unnest(c) AS x FROM r) GROUP BY 1) k USING (period)""",
    "knowledge_gaps": f"""SELECT gap_type, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(list_filter([CASE WHEN status = 'needs_manual_markdown' THEN 'needs_manual_markdown' END, CASE WHEN status = 'failed_retryable' THEN 'failed_retryable' END, CASE WHEN {FLAG('quality_status')} = 'weak' THEN 'weak_note' END,
        CASE WHEN coalesce(title, '') = '' THEN 'missing_title' END, CASE WHEN coalesce(author, '') = '' THEN 'missing_author' END], lambda x: x IS NOT NULL)) AS gap_type FROM (SELECT * REPLACE (CASE WHEN json_valid(extra) THEN extra END AS extra) FROM resources)) GROUP BY 1""",
    "review_buckets": f"SELECT category, count(*) AS n FROM (SELECT unnest({BUCKETS}) AS category FROM (SELECT * REPLACE (CASE WHEN json_valid(extra) THEN extra END AS extra) FROM resources)) GROUP BY 1",
    "review_queue": f"SELECT id, b[1] AS category, list_position(['failed', 'weak', 'human_review', 'missing_note', 'manual', 'untitled'], b[1])::INT AS priority FROM (SELECT id, {BUCKETS} AS b FROM (SELECT * REPLACE (CASE WHEN json_valid(extra) THEN extra END AS extra) FROM resources)) WHERE len(b) > 0 ORDER BY priority, id LIMIT 50",
    "status_report": f"SELECT kind, value, count(*) AS n FROM ({PAIRS(('source_type', 'source_type', 'resources'), ('status', 'status', 'resources'), ('provider', provider('llm_provider'), 'resources'))}) GROUP BY 1, 2",
    "search_items": f"WITH {ASSIGNED} SELECT 'resource' AS type, id, {shown()} AS title, '/resources/' || replace(id, ':', '_') AS route FROM resources UNION ALL SELECT 'topic', t, t, '/topics/' || t FROM (SELECT DISTINCT unnest(topics) AS t FROM assigned)",
    "token_ledger_rollup": "SELECT provider, model, usage_source, count(*) AS entries, sum(t)::BIGINT AS total_tokens, round(sum(c), 6) AS estimated_cost, grouping(provider, model, usage_source)::BIGINT AS level FROM (SELECT coalesce(provider, 'unknown') AS provider, coalesce(model, 'unknown') AS model, coalesce(usage_source, 'unknown') AS usage_source, coalesce(total_tokens, 0) AS t, coalesce(estimated_cost, 0) AS c FROM token_ledger) GROUP BY GROUPING SETS ((), (provider), (model), (usage_source))",
    "run_status_rollup": "SELECT kind, value, count(*) AS n FROM (" + PAIRS(("status", "coalesce(trim(status), 'unknown')", "processing_runs"), ("operation", "coalesce(operation, 'unknown')", "processing_runs")) + ") GROUP BY 1, 2",
    "recent_runs": "SELECT ledger_pos, run_id, operation FROM (SELECT DISTINCT * FROM processing_runs) ORDER BY ledger_pos DESC LIMIT 20",
    "daily_usage": "SELECT recorded_at::DATE AS day, count(*) AS entries, sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens FROM token_ledger GROUP BY 1",
    "running_usage": "SELECT ledger_pos, resource_id, (sum(coalesce(total_tokens, 0)) OVER (PARTITION BY resource_id ORDER BY ledger_pos))::BIGINT AS running_tokens FROM (SELECT DISTINCT ON (ledger_pos) * FROM token_ledger)",
    "runs_without_ledger": "SELECT trim(status) AS status, count(*) AS n FROM processing_runs p WHERE NOT EXISTS (SELECT 1 FROM token_ledger t WHERE t.run_id = p.run_id) GROUP BY 1",
    "usage_from_json": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS input_tokens, NULL::BIGINT AS output_tokens, json_extract_string(props, '$.k')::BIGINT AS total_tokens FROM events",
    "events_by_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "bm25_topk": f"{SEARCH}, {ranked('bm', 10, 'b10')} SELECT query_id, rank::INT AS rank, chunk_id, score, matched_terms FROM b10",
    "bm25_pdf_topk": f"{SEARCH}, bp AS (SELECT bm.* FROM bm JOIN docs USING (chunk_id) WHERE source_type = 'pdf'), {ranked('bp', 5, 'b5')} SELECT query_id, rank::INT AS rank, chunk_id, score FROM b5",
    "index_vocabulary": f"{BASE} SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM postings GROUP BY term",
    "index_lengths": f"{BASE} SELECT chunk_id, dl FROM lens",
    "index_stats": f"{BASE} SELECT (SELECT count(*) FROM docs) AS chunks, (SELECT count(DISTINCT resource_id) FROM docs) AS resources, count(*) AS postings, count(DISTINCT term) AS vocabulary FROM postings",
    "idf_table": f"{BASE} SELECT term, round(ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0), 6) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), (SELECT count(*) AS n FROM docs)",
    "tfidf_cosine_topk": f"{BASE}, {ASKED}, {COSINE}, {ranked('cs', 10, 'c10')} SELECT query_id, rank::INT AS rank, chunk_id, score FROM c10",
    "dense_cosine_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE embedding IS NOT NULL),
        p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / q.n / e.n, 6) AS score FROM e q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
        SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10""",
    "hybrid_topk": f"{FUSED}, {ranked('fd', 10, 'f10', 'resource_id, chunk_id')} SELECT query_id, rank::INT AS rank, chunk_id, score FROM f10",
    "graph_lite_topk": f"{FUSED}, {boosted('fd', 10)} SELECT query_id, rank::INT AS rank, chunk_id, boost, score FROM g10",
    "retrieve_by_mode": f"""{SEARCH}, {COSINE}, kept AS (SELECT chunk_id, resource_id, source_type FROM docs WHERE source_type IN ('webpage', 'markdown')), bk AS (SELECT bm.* FROM bm JOIN kept USING (chunk_id)), ck AS (SELECT cs.* FROM cs JOIN kept USING (chunk_id)),
        {ranked('bk', 15, 'b15')}, {ranked('ck', 15, 'c15')}, bn AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM b15), cn AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM c15),
        fd AS (SELECT query_id, chunk_id, round(coalesce(bn.s, 0) * 0.55e0 + coalesce(cn.s, 0) * 0.45e0, 6) AS score, resource_id, source_type FROM bn FULL JOIN cn USING (query_id, chunk_id) JOIN kept USING (chunk_id)), {ranked('bk', 5, 'b5')}, {ranked('ck', 5, 'c5')}, {ranked('fd', 5, 'f5', 'resource_id, chunk_id')}, {boosted('fd', 5)}
        SELECT 'bm25' AS mode, query_id, rank::INT AS rank, chunk_id, score FROM b5 UNION ALL SELECT 'vector', query_id, rank::INT, chunk_id, score FROM c5 UNION ALL SELECT 'hybrid', query_id, rank::INT, chunk_id, score FROM f5 UNION ALL SELECT 'graph_lite', query_id, rank::INT, chunk_id, score FROM g5""",
    "retrieval_eval_metrics": f"{EVAL} SELECT * FROM met",
    "retrieval_eval_aggregate": f"{EVAL} SELECT k, count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr FROM met GROUP BY k",
    "context_pack_chunks": f"{PACK} SELECT query_id, rank::INT AS rank, citation_label, chunk_id, resource_id, text, truncated FROM pack",
    "context_pack_sources": f"{PACK} SELECT query_id, resource_id, arg_min(citation_label, rank) AS citation_label, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids FROM pack GROUP BY 1, 2",
    "extractive_answers": f"{ANSWERS} SELECT query_id, rank::INT AS rank, chunk_id, answer FROM ans",
    "answer_grades": f"{GRADED} SELECT query_id, round(count(*) FILTER (answer <> '') / count(*), 6) AS chunk_coverage, coalesce(max(wrong), 0) = 0 AS labels_valid, count(*) FILTER (answer <> '') > 0 AS answered FROM ans LEFT JOIN bad USING (query_id) GROUP BY query_id",
    "answer_checks": f"{NINE} SELECT query_id, unnest({_list(CHECKS)}) AS check, unnest(ok) AS passed, unnest(list_concat(list_transform(ok[1:7], lambda x: CASE WHEN x THEN 1e0 ELSE 0e0 END), [round(cc, 6), round(sc, 6)])) AS score FROM pa",
    "retrieval_eval_terms": f"{SEARCH}, {ranked('bm', 10, 'b10')}, tx AS (SELECT query_id, rank, lower(coalesce(text, '')) AS t FROM b10 JOIN docs USING (chunk_id)), fr AS (SELECT qt.query_id, term, min(rank) AS first_rank FROM qt JOIN tx ON tx.query_id = qt.query_id AND contains(t, term) GROUP BY 1, 2) SELECT query_id, k, round(count(*) FILTER (first_rank <= k) / count(*), 6) AS coverage FROM (SELECT query_id, term, unnest([1, 3, 10]) AS k FROM qt) LEFT JOIN fr USING (query_id, term) GROUP BY 1, 2",
    "graph_nodes": f"{GRAPH} SELECT * FROM nodes",
    "graph_edges": f"{GRAPH} SELECT * FROM edges",
    "graph_stats": f"{GRAPH} SELECT type, count(*) AS n, 'node' AS part FROM (SELECT DISTINCT * FROM nodes) GROUP BY 1 UNION ALL SELECT type, count(*), 'edge' FROM edges GROUP BY 1",
    "graph_degree_top50": f"{GRAPH} SELECT node_id, count(*) AS degree FROM (SELECT source AS node_id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1 ORDER BY degree DESC, node_id LIMIT 50",
    "graph_relationship_members": f"{CLASSES} SELECT * FROM cl",
    "graph_relationships": f"""{CLASSES}, c AS (SELECT topics, source_type, depth, unnest(string_split(topics, ',')) AS topic FROM cl WHERE topics <> '')
        SELECT topics_a, type_a, depth_a, topics_b, type_b, depth_b, shared, score, score >= 1.0 AS similar, depth_a * depth_b = -1 AS prerequisite FROM (SELECT a.topics AS topics_a, a.source_type AS type_a, a.depth AS depth_a, b.topics AS topics_b, b.source_type AS type_b, b.depth AS depth_b, count(*) AS shared,
        round(count(*) * 2.0e0 + CASE WHEN a.source_type = b.source_type THEN 0.5e0 ELSE 0 END, 6) AS score FROM c a JOIN c b ON a.topic = b.topic AND (a.topics, a.source_type, a.depth) <= (b.topics, b.source_type, b.depth) GROUP BY 1, 2, 3, 4, 5, 6)""",
    "graph_validate": f"""{GRAPH}, ids AS (SELECT DISTINCT node_id FROM nodes) SELECT * FROM (SELECT 'error' AS severity, 'duplicate_node' AS code, count(*) AS n FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'error', 'missing_endpoint', count(*) FROM (SELECT source AS node_id FROM edges UNION ALL SELECT target FROM edges) x WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.node_id = x.node_id) UNION ALL SELECT 'error', 'self_edge', count(*) FROM edges WHERE source = target
        UNION ALL SELECT 'warning', 'resource_without_topic', count(*) FROM (SELECT DISTINCT node_id FROM nodes WHERE type = 'resource') y WHERE NOT EXISTS (SELECT 1 FROM edges WHERE type = 'resource_has_topic' AND source = y.node_id)) WHERE n > 0""",
    "graph_neighbourhood": f"{GRAPH} SELECT DISTINCT unnest([source, target]) AS node_id FROM edges WHERE source = 'topic:agents' OR target = 'topic:agents'",
    "missing_citations": f"WITH {CITED} SELECT doc_id, chunk_id FROM cited c WHERE NOT EXISTS (SELECT 1 FROM chunks k WHERE k.chunk_id = c.chunk_id)",
    "citation_coverage": f"WITH {CITED} SELECT count(*) AS cited, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM chunks)) AS found FROM cited",
    "linked_citations": rf"""WITH {CITED}, k AS (SELECT DISTINCT chunk_id FROM chunks), li AS (SELECT doc_id, cited.chunk_id AS c, CASE WHEN k.chunk_id IS NULL THEN '[missing source chunk: ' || cited.chunk_id || ']' ELSE '[' || coalesce(nullif(regexp_extract(cited.chunk_id, '-([a-z]\d{{3,}})$', 1), ''), cited.chunk_id) || '](#' ||
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(cited.chunk_id)), '[:/]+', '-', 'g'), '[^a-z0-9\-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') || ')<!-- ' || cited.chunk_id || ' -->' END AS link FROM cited LEFT JOIN k ON k.chunk_id = cited.chunk_id),
        ll AS (SELECT doc_id, list({{'c': c, 'link': link}}) AS links FROM li GROUP BY 1), pp AS (SELECT doc_id, links, unnest(string_split(text, '```')) AS p, generate_subscripts(string_split(text, '```'), 1) AS i FROM documents JOIN ll USING (doc_id))
        SELECT doc_id, string_agg(CASE WHEN i % 2 = 1 THEN list_reduce(list_concat([p], list_transform(links, lambda x: x.c || chr(1) || x.link)), lambda t, x: replace(replace(t, '[source: ' || split_part(x, chr(1), 1) || ']', split_part(x, chr(1), 2)), '[source:' || split_part(x, chr(1), 1) || ']', split_part(x, chr(1), 2))) ELSE p END, '```' ORDER BY i) AS text FROM pp GROUP BY doc_id""",
    "note_sections": rf"""WITH l AS (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL AND title IS NOT NULL),
        h AS (SELECT *, length(regexp_extract({strip('line')}, '^(#*)', 1)) AS level, lower(trim(regexp_replace({strip('line')}, '^#+', ''))) AS name FROM l), a AS (SELECT doc_id, min(i) AS i, arg_min(level, i) AS level FROM h WHERE level > 0 AND name = lower(trim(title)) GROUP BY 1),
        z AS (SELECT a.doc_id, a.i, min(h.i) AS e FROM a LEFT JOIN h ON h.doc_id = a.doc_id AND h.level > 0 AND h.i > a.i AND h.level <= a.level GROUP BY 1, 2)
        SELECT * FROM (SELECT z.doc_id, {strip("string_agg(line, chr(10) ORDER BY l.i)")} AS section FROM z JOIN l ON l.doc_id = z.doc_id AND l.i > z.i AND (z.e IS NULL OR l.i < z.e) GROUP BY 1) WHERE section <> ''""",
    "topics_from_tags": f"SELECT * FROM (SELECT id, array_to_string(list_filter(list_transform(list_distinct_ordered, lambda x: x), lambda x: list_contains({_list(TOPICS)}, x)), ',') AS topics FROM (SELECT id, list_filter(own, lambda x, i: list_position(own, x) = i) AS list_distinct_ordered FROM (SELECT id, list_transform(list_transform(tags, lambda t: {slug('t')}), lambda x: CASE x {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in ALIASES.items())} ELSE x END) AS own FROM resources))) WHERE topics <> ''",
    "index_issues": f"{BASE} SELECT * FROM (SELECT 'error' AS severity, 'posting_without_chunk' AS code, count(*) AS n FROM postings p WHERE NOT EXISTS (SELECT 1 FROM docs WHERE docs.chunk_id = p.chunk_id) UNION ALL SELECT 'error', 'negative_count', count(*) FROM postings WHERE tf < 0) WHERE n > 0",
    "weak_reasons": rf"""SELECT * FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN {words('text')} < 250 THEN 'note is short' END, CASE WHEN len(list_distinct(regexp_extract_all(text, '\[source: ?([^\]]+)\]', 1))) < 3 THEN 'sparse citations' END,
        CASE WHEN regexp_matches(lower(text), 'mock-generated|placeholder content|learned about this topic') THEN 'generic phrases' END], lambda x: x IS NOT NULL), ';') AS reasons FROM documents WHERE trim(text) <> '') WHERE reasons <> ''""",
    "concept_index": f"WITH {NOTE_CONCEPTS} SELECT slug, min(name) AS name, count(DISTINCT doc_id) AS notes FROM nc GROUP BY slug",
    "flashcards": f"""SELECT DISTINCT doc_id, q AS question, {trimmed("coalesce(a, '')", 300)} AS answer, CASE WHEN regexp_matches(lower(q), 'compare|why|how would|tradeoff') THEN 'hard' WHEN regexp_matches(lower(q), 'how|which') THEN 'medium' ELSE 'easy' END AS difficulty
        FROM (SELECT doc_id, unnest(ls) AS q, unnest(list_concat(ls[2:], [NULL])) AS a FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL)) WHERE suffix(q, '?')""",
    "rag_prompts": f"""{PACK}, bl AS (SELECT query_id, string_agg(citation_label || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM pack GROUP BY query_id)
        SELECT query_id, '{SYSTEM}' AS system, 'Question: ' || query || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, '(none)') AS user FROM qs LEFT JOIN bl USING (query_id)""",
}
