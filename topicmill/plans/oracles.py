"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from ..functions.text import ANCHOR, CITED, INLINE, PLAIN_WORD, SMALL_WORDS, WORD

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PAPERS = r"""papers AS (SELECT doc_id, 'hf:' || doc_id AS paper_id, split_part(text, '.', 1) AS title, text AS summary, lang, source,
  regexp_extract_all(lower(text), '\p{L}{5,}') AS keywords, 'month=2025-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') AS month_key FROM documents)"""
POINTS = "points AS (SELECT vec_id AS paper_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
CENTERS = """flat AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM points),
means AS (SELECT label, i, avg(x) AS m FROM flat GROUP BY ALL),
centers AS (SELECT label, list(m ORDER BY i) AS centroid FROM means GROUP BY label),
sims AS (SELECT paper_id, label, list_inner_product(e, centroid) / (sqrt(list_inner_product(centroid, centroid)) + 1e-12) AS sim FROM points JOIN centers USING (label))"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9) DESC, paper_id) - 1 AS rank_in_cluster FROM sims)"
SPACE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip(c: str) -> str:
    return SPACE.format(c)


def count(c: str, pattern: str = WORD) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def vectors(body: str, more: str = "") -> str:
    return f"WITH {POINTS}, {CENTERS}{more and ', ' + more} {body}"


ORACLES["centroids"] = vectors("SELECT label, (i - 1)::BIGINT AS pos, round(m, 6) AS value FROM means")
ORACLES["member_similarity"] = vectors("SELECT paper_id, label, round(sim, 6) AS sim FROM sims")
ORACLES["member_rank"] = vectors("SELECT paper_id, label, rank_in_cluster FROM ranked", RANKED)
ORACLES["cluster_cohesion"] = vectors("SELECT label, round(avg(sim), 6) AS cohesion, count(*) AS size FROM sims GROUP BY label")
ORACLES["cohesion_summary"] = vectors(
    "SELECT round(avg(c), 6) AS avg_cohesion, round(min(c), 6) AS worst_cohesion FROM (SELECT avg(sim) AS c FROM sims GROUP BY label)"
)


def grouped(keys: str) -> str:
    """Closed forms for groups: ``gp`` has a group g, a label and a vector."""
    return f"""gf AS (SELECT g, paper_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i, list_inner_product(e, e) AS n2 FROM gp),
gm AS (SELECT g, label, i, avg(x) AS m, sum(x / (sqrt(n2) + 1e-12)) AS s FROM gf GROUP BY ALL),
gc AS (SELECT g, label, list(m ORDER BY i) AS c, list(s ORDER BY i) AS s FROM gm GROUP BY ALL),
gn AS (SELECT g, label, count(*) AS n FROM gp GROUP BY ALL),
cl AS (SELECT * FROM gc JOIN gn USING (g, label)),
pair AS (SELECT gp.g, gp.paper_id, gp.label, cl.label AS other, cl.n, list_inner_product(gp.e, cl.s) / (sqrt(list_inner_product(gp.e, gp.e)) + 1e-12) AS d FROM gp JOIN cl USING (g)),
ab AS (SELECT g, paper_id, max(CASE WHEN label = other AND n > 1 THEN (n - d) / (n - 1) END) AS a, min(CASE WHEN label <> other THEN 1 - d / n END) AS b FROM pair GROUP BY ALL),
sil AS (SELECT g, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM ab GROUP BY g),
far AS (SELECT gp.g, gp.label, avg(list_distance(gp.e, cl.c)) AS s FROM gp JOIN cl USING (g, label) GROUP BY ALL),
fc AS (SELECT * FROM far JOIN gc USING (g, label)),
db AS (SELECT g, avg(r) AS davies_bouldin FROM (SELECT x.g, x.label, max((x.s + y.s_) / list_distance(x.c, y.c)) AS r FROM (SELECT g, label, far.s, c FROM far JOIN (SELECT g, label, c FROM gc) USING (g, label)) x
  JOIN (SELECT g, label AS l2, far.s AS s_, c FROM far JOIN (SELECT g, label, c FROM gc) USING (g, label)) y ON x.g = y.g AND x.label <> y.l2 GROUP BY ALL) GROUP BY g),
whole AS (SELECT g, list(m ORDER BY i) AS m FROM (SELECT g, i, avg(x) AS m FROM gf GROUP BY ALL) GROUP BY g),
wi AS (SELECT gp.g, sum(list_distance(gp.e, cl.c) ** 2) AS w, count(*) AS n FROM gp JOIN cl USING (g, label) GROUP BY gp.g),
be AS (SELECT g, sum(n * list_distance(c, m) ** 2) AS b, count(*) AS k FROM cl JOIN whole USING (g) GROUP BY g),
ch AS (SELECT g, (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz FROM wi JOIN be USING (g)),
coh AS (SELECT g, avg(c) AS avg_cohesion, min(c) AS worst_cohesion FROM (SELECT gp.g, gp.label, avg(list_inner_product(gp.e, c) / (sqrt(list_inner_product(c, c)) + 1e-12)) AS c FROM gp JOIN cl USING (g, label) GROUP BY ALL) GROUP BY g)"""


ALL = f"WITH {POINTS}, gp AS (SELECT 0 AS g, * FROM points), {grouped('g')} "
ORACLES["silhouette_cosine"] = ALL + "SELECT round(silhouette, 6) AS silhouette FROM sil"
ORACLES["davies_bouldin"] = ALL + "SELECT round(davies_bouldin, 6) AS davies_bouldin FROM db"
ORACLES["calinski_harabasz"] = ALL + "SELECT round(calinski_harabasz, 6) AS calinski_harabasz FROM ch"


def entropy(source: str) -> str:
    return f"""kw AS (SELECT g, label, {strip('lower(k)')} AS k FROM (SELECT g, label, unnest(keywords) AS k FROM {source})),
kc AS (SELECT g, label, k, count(*) AS n FROM kw WHERE k <> '' GROUP BY ALL),
kp AS (SELECT g, label, n / sum(n) OVER (PARTITION BY g, label) AS p FROM kc),
ke AS (SELECT g, label, -sum(p * ln(p + 1e-12)) AS h FROM kp GROUP BY ALL),
en AS (SELECT g, label, coalesce(h, 'nan'::DOUBLE) AS entropy FROM (SELECT DISTINCT g, label FROM {source}) LEFT JOIN ke USING (g, label)),
es AS (SELECT g, coalesce(avg(entropy) FILTER (NOT isnan(entropy)), 'nan'::DOUBLE) AS avg_entropy, coalesce(max(entropy) FILTER (NOT isnan(entropy)), 'nan'::DOUBLE) AS max_entropy FROM en GROUP BY g)"""


LABELLED = f"WITH {PAPERS}, lp AS (SELECT 0 AS g, e.label, p.* FROM embeddings e JOIN papers p ON p.doc_id = e.vec_id), "
ORACLES["keyword_entropy"] = LABELLED + entropy("lp") + " SELECT label, round(entropy, 6) AS entropy FROM en"
ORACLES["entropy_summary"] = LABELLED + entropy("lp") + " SELECT round(avg_entropy, 6) AS avg_entropy, round(max_entropy, 6) AS max_entropy FROM es"
SCORED = f"""WITH {PAPERS}, {POINTS}, gp AS (SELECT k AS g, paper_id, (label % k)::INT AS label, e FROM points, (VALUES (4), (5)) v(k)), {grouped('g')},
gw AS (SELECT g, label, coalesce(keywords, []) AS keywords FROM gp LEFT JOIN papers ON doc_id = gp.paper_id), {entropy('gw')},
scored AS (SELECT g AS k, silhouette, davies_bouldin, calinski_harabasz, avg_cohesion, worst_cohesion, avg_entropy, max_entropy,
  1.5 * silhouette + 2.0 * avg_cohesion + worst_cohesion - 0.7 * davies_bouldin - 0.3 * CASE WHEN isnan(avg_entropy) THEN 0 ELSE avg_entropy END AS score
  FROM sil JOIN db USING (g) JOIN ch USING (g) JOIN coh USING (g) JOIN es USING (g)) """
_NAMES = ["silhouette", "davies_bouldin", "calinski_harabasz", "avg_cohesion", "worst_cohesion", "avg_entropy", "max_entropy", "score"]
ORACLES["composite_score"] = SCORED + "SELECT k, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + " FROM scored"
ORACLES["best_config"] = SCORED + "SELECT 'all' AS period, k, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, k LIMIT 1"
ORACLES["constrained_best"] = SCORED + "SELECT 'all' AS period, k, round(avg_cohesion, 6) AS avg_cohesion FROM scored ORDER BY avg_cohesion DESC, silhouette DESC, davies_bouldin LIMIT 1"
ORACLES["nearest_centroid"] = vectors(
    "SELECT paper_id, n.label, round(n.d, 6) AS distance FROM (SELECT p.paper_id, arg_min(struct_pack(label := c.label, d := list_distance(e, centroid)), (list_distance(e, centroid), c.label)) AS n FROM points p, centers c GROUP BY p.paper_id)"
)

# --- text -------------------------------------------------------------------------------------

_BASE = strip("'TITLE: ' || title || chr(10) || 'SUMMARY: ' || summary")
for _m, _k in (("a", None), ("b", "keywords[1:10]"), ("c", "keywords")):
    _tail = f"CASE WHEN len(keywords) > 0 THEN chr(10) || 'KEYWORDS: ' || array_to_string({_k}, ', ') ELSE '' END" if _k else "''"
    ORACLES[f"embedding_text_{_m}"] = f"WITH {PAPERS} SELECT doc_id, {_BASE} || {_tail} AS text FROM papers"
ORACLES["month_counts"] = f"""WITH {PAPERS}, m AS (SELECT strftime(DATE '2025-01-01' + INTERVAL (i) MONTH, 'month=%Y-%m') AS month_key FROM range(0, 24) t(i))
SELECT month_key, count(doc_id) AS n FROM m LEFT JOIN papers USING (month_key) GROUP BY 1"""
ORACLES["period_bounds"] = """SELECT 'month=' || strftime(ts, '%Y-%m') AS month_key, count(*) AS n, strftime(date_trunc('month', any_value(ts)), '%Y-%m-%d') AS period_start,
strftime(last_day(any_value(ts)::DATE), '%Y-%m-%d') AS period_end FROM events GROUP BY 1"""
ORACLES["paper_projection"] = """SELECT event_id, 'hf:' || event_id AS paper_id, 'https://papers/' || event_id AS url,
CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS published_at, NOT (event_id % 5 = 0 OR event_id % 7 = 0) AS is_date FROM events"""
ORACLES["truncate_summary"] = f"SELECT doc_id, CASE WHEN length(s) > 350 THEN s[1:350] || '…' ELSE s END AS summary FROM (SELECT doc_id, {strip('text')} AS s FROM documents)"
_FIRST, _LAST = "substring(month_key, 7) || '-01'", "strftime(last_day((substring(month_key, 7) || '-01')::DATE), '%Y-%m-%d')"
_SNAP = f"'hf|' || {_FIRST} || '|' || {_LAST}"
ORACLES["derived_ids"] = f"""WITH {PAPERS}, s AS (SELECT doc_id, {_SNAP} AS snapshot_id FROM papers)
SELECT doc_id, snapshot_id, snapshot_id || '|embed|0.1|kmeans|0.1|hf_batch' AS run_id, snapshot_id || '|embed|0.1|kmeans|0.1|hf_batch|c' || (doc_id % 5) AS cluster_id FROM s"""
_TERMS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
ORACLES["word_count"] = f"SELECT doc_id, {count('text')}::BIGINT AS words, {count('text', PLAIN_WORD)}::BIGINT AS plain_words, len({_TERMS.format('text')})::BIGINT AS terms FROM documents"
_SMALL = ", ".join(map(q, SMALL_WORDS))


def titled(t: str) -> str:
    w = _TERMS.format(t)
    return rf"""(len({w}) > 0 AND NOT contains({t}, ':') AND regexp_matches(coalesce({w}[1], ''), '^\p{{Lu}}')
  AND len(list_filter({w}[2:], lambda x: (lower(x) IN ({_SMALL})) = regexp_matches(x, '^\p{{Lu}}'))) = 0)"""


# Capitalised words, as initcap makes them: first letter of each blank-separated word up, the rest down.
_CAP = r"array_to_string(list_transform(string_split({}, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
ORACLES["title_case"] = f"WITH {PAPERS}, t AS (SELECT doc_id, {strip('title')} AS t, {_CAP.format(strip('title'))} AS c FROM papers) SELECT doc_id, {titled('t')} AS plain, {titled('c')} AS capital FROM t"


def strictly(t: str) -> str:
    letter = r"[\p{Lu}\p{Ll}\p{Lt}]"
    return rf"(NOT contains({t}, ':') AND NOT regexp_matches({t}, '(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}') AND NOT regexp_matches({t}, '{letter}[\p{{Lu}}\p{{Lt}}]'))"


ORACLES["title_case_strict"] = f"WITH t AS (SELECT conv_id, turn, {strip('text')} AS t FROM conversations), c AS (SELECT *, {_CAP.format('t')} AS c FROM t) SELECT conv_id, turn, {strictly('t')} AS plain, {strictly('c')} AS capital FROM c"
_ITEM = r"(?s)^\[([A-Za-z0-9._:-]+)\]\s+(.+)$"
ORACLES["citations"] = rf"""WITH t AS (SELECT doc_id, '[' || doc_id || '] ' || text || ' [x.1] [not one]' AS t FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(t, {q(CITED)}, 1), ',') AS cited, regexp_matches(t, {q(INLINE)}) AS has, regexp_extract({strip('t')}, {q(_ITEM)}, 1) AS item,
length({strip(f"regexp_extract({strip('t')}, {q(_ITEM)}, 2)")})::BIGINT AS rest, regexp_matches(t, '(?i)\b(cluster|clustering)\b') AS names_cluster FROM t"""
_SENT = r"string_split_regex(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
ORACLES["sentence_links"] = rf"""WITH t AS (SELECT conv_id, turn, {strip("replace(text, '. ', ' [a] [b]. ')")} AS t FROM conversations),
n AS (SELECT conv_id, turn, len(list_filter({_SENT.format('t')}, lambda s: len(list_distinct(regexp_extract_all(s, {q(CITED)}, 1))) >= 2))::BIGINT AS n_links FROM t)
SELECT conv_id, turn, n_links, CASE WHEN n_links BETWEEN 2 AND 4 THEN 1.0 WHEN n_links IN (1, 5) THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM n"""
ORACLES["keyword_dedup"] = f"""WITH {PAPERS}, k AS (SELECT doc_id, keywords, list_concat(keywords, list_transform(keywords, lambda x: replace(x, 'e', 'E'))) AS b FROM papers),
f AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS f FROM (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(keywords) AS x, generate_subscripts(keywords, 1) AS i FROM k) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, len(list_distinct(list_transform(b, lambda x: lower(x))))::BIGINT AS n_unique, coalesce(f, '') AS first, coalesce(array_to_string(list_transform(b, lambda x: lower(x)), ' '), '') AS normal FROM k LEFT JOIN f USING (doc_id)"""
ORACLES["rank_order"] = """SELECT conv_id, coalesce(bool_and(ok), true) AS rises FROM (SELECT conv_id, length(text) >= coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS ok FROM conversations) GROUP BY 1"""
ORACLES["page_links"] = f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, {q(ANCHOR)}, 1)) AS link, generate_subscripts(regexp_extract_all(html, {q(ANCHOR)}, 1), 1) AS i FROM pages),
f AS (SELECT page_id, link, min(i) AS i FROM a WHERE regexp_matches(link, '/[A-Za-z]+') GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, link FROM f"""

# --- memory and packing -----------------------------------------------------------------------

_OLD = f"WITH {PAPERS}, old AS (SELECT * FROM papers WHERE doc_id % 3 < 2), new AS (SELECT *, 'new ' || title AS t2 FROM papers WHERE doc_id % 3 > 0) "
ORACLES["upsert_papers"] = _OLD + "SELECT coalesce(o.paper_id, n.paper_id) AS paper_id, coalesce(n.t2, o.title) AS title, CASE WHEN o.paper_id IS NULL THEN 'new' ELSE 'old' END AS batch FROM old o FULL JOIN new n ON o.paper_id = n.paper_id"
ORACLES["link_insert_ignore"] = _OLD + "SELECT lang, paper_id, 'old' AS batch FROM old UNION ALL SELECT lang, paper_id, 'new' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.paper_id = n.paper_id AND o.lang = n.lang)"
ORACLES["select_best_run"] = f"""WITH {PAPERS}, m AS (SELECT DISTINCT {_SNAP} AS snapshot_id, substring(month_key, 12)::INT % 2 = 0 AS even FROM papers)
SELECT snapshot_id || '|' || c AS cluster_run_id, snapshot_id, CASE WHEN even THEN c = 'k5' ELSE c = 'k4' END AS selected_best, CASE WHEN even THEN c = 'k5' ELSE c = 'k4' END AS shown FROM m, (VALUES ('k4'), ('k5')) v(c)"""
ORACLES["replace_clusters"] = """WITH r AS (SELECT 'r' || (vec_id % 4) AS cluster_run_id, label FROM embeddings)
SELECT cluster_run_id, label, count(*) AS size, CASE WHEN cluster_run_id = 'r1' THEN 'new' ELSE 'old' END AS batch FROM r WHERE cluster_run_id <> 'r1' OR label < 5 GROUP BY ALL"""
ORACLES["fk_violations"] = "SELECT id AS paper_id, label FROM (SELECT unnest([vec_id, -vec_id - 1]) AS id, label FROM embeddings) e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.id)"
_KNOWN = f"{PAPERS}, {POINTS}, {CENTERS}, {RANKED}"
ORACLES["ingest_memory"] = f"""WITH {_KNOWN}, c AS (SELECT DISTINCT p.month_key, r.label FROM ranked r JOIN papers p ON p.month_key = 'month=2025-' || lpad(CAST(1 + r.paper_id % 12 AS VARCHAR), 2, '0')),
months AS (SELECT DISTINCT month_key FROM c)
SELECT 'source_snapshot' AS name, count(*) AS n FROM months UNION ALL SELECT 'paper', count(*) FROM papers JOIN months USING (month_key) UNION ALL SELECT 'snapshot_paper', count(*) FROM papers JOIN months USING (month_key)
UNION ALL SELECT 'cluster_run', count(*) FROM months UNION ALL SELECT 'cluster', count(*) FROM c UNION ALL SELECT 'cluster_member', count(*) FROM ranked JOIN documents ON doc_id = ranked.paper_id"""
_FLAT = f"""WITH {_KNOWN}, p AS (SELECT *, substring(month_key, 12)::INT AS m FROM papers),
placed AS (SELECT p.month_key, m, paper_id, label, rank_in_cluster, round(sim, 9) AS sim FROM (SELECT paper_id AS id, label, rank_in_cluster, sim FROM ranked) JOIN p ON id = doc_id),
months AS (SELECT DISTINCT month_key, m, {_SNAP} AS snapshot_id, {_LAST} AS last FROM p),
runs AS (SELECT *, snapshot_id || '|embed|0.1|cluster|' || version || '|hf_batch' AS cluster_run_id FROM (SELECT *, unnest(CASE WHEN m % 4 = 0 THEN ['0.1', '0.2'] ELSE ['0.1'] END) AS version FROM months)),
held AS (SELECT r.cluster_run_id, r.cluster_run_id || '|c' || label AS cluster_id, placed.* FROM runs r JOIN placed USING (month_key) WHERE r.m % 2 = 1 OR r.m % 4 = 0 AND version = '0.1' OR label < 5) """
ORACLES["payload_rows"] = _FLAT + """SELECT 'payload' AS kind, month_key AS payload_id, last AS id, NULL::BIGINT AS cluster_index, NULL::BIGINT AS number, NULL::DOUBLE AS value, NULL::BIGINT AS n_keywords FROM months
UNION ALL SELECT 'papers', month_key, paper_id, NULL, NULL, NULL, len(keywords) FROM p
UNION ALL SELECT 'clusters', month_key, NULL, label, count(*), round(avg(sim), 6), NULL FROM placed GROUP BY month_key, label
UNION ALL SELECT 'members', month_key, paper_id, label, rank_in_cluster, round(sim, 6), NULL FROM placed"""
ORACLES["ingested_embed_config"] = """SELECT 'embed|0.1' AS embed_config_id, '{"v": 2}' AS json_payload"""
ORACLES["ingested_cluster_config"] = """SELECT unnest(['cluster|0.1', 'cluster|0.2']) AS cluster_config_id, '{"k": 5}' AS json_payload"""
ORACLES["ingested_source_snapshot"] = _FLAT + """SELECT snapshot_id, 'hf' AS source, split_part(snapshot_id, '|', 2) AS period_start, last AS period_end, CASE WHEN m % 2 = 0 THEN '{"n": 2}' ELSE '{"n": 1}' END AS raw_json FROM months"""
ORACLES["ingested_paper"] = _FLAT + "SELECT paper_id, CASE WHEN m % 2 = 0 THEN title ELSE 'old ' || title END AS title, sha256(summary) AS summary_sha256, len(keywords) AS n_keywords, 'u/' || doc_id AS url, 'hf' AS source, '2025-01-01' AS published_at FROM p"
ORACLES["ingested_snapshot_paper"] = _FLAT + "SELECT snapshot_id, paper_id FROM p JOIN months USING (month_key)"
ORACLES["ingested_cluster_run"] = _FLAT + "SELECT cluster_run_id, snapshot_id, 'embed|0.1' AS embed_config_id, 'cluster|' || version AS cluster_config_id, 'hf_batch' AS role, m % 4 > 0 OR version = '0.2' AS selected_best FROM runs"
ORACLES["ingested_cluster"] = _FLAT + "SELECT cluster_id, cluster_run_id, label AS cluster_index, count(*) AS size, round(avg(sim), 6) AS cohesion FROM held GROUP BY ALL"
ORACLES["ingested_cluster_member"] = _FLAT + "SELECT cluster_id, paper_id, rank_in_cluster, round(sim, 6) AS sim_to_centroid FROM held"
_CARDS = f"""WITH {_KNOWN}, pl AS (SELECT r.*, 'month=2025-' || lpad(CAST(1 + paper_id % 12 AS VARCHAR), 2, '0') AS month_key FROM ranked r),
known AS (SELECT DISTINCT month_key FROM papers), sz AS (SELECT month_key, label, count(*) AS size FROM pl SEMI JOIN known USING (month_key) GROUP BY ALL),
tops AS (SELECT pl.month_key, pl.label, p.paper_id, pl.rank_in_cluster, row_number() OVER (PARTITION BY pl.month_key, pl.label ORDER BY pl.rank_in_cluster, p.paper_id) - 1 AS pos FROM pl JOIN papers p ON p.doc_id = pl.paper_id) """
ORACLES["best_run_cards"] = _CARDS + f"SELECT {_SNAP} AS snapshot_id, s.label::BIGINT AS cluster_index, size, pos, paper_id, rank_in_cluster FROM sz s LEFT JOIN (SELECT * FROM tops WHERE pos < 3) t USING (month_key, label)"
ORACLES["unify_clusters"] = _CARDS + f"SELECT {_SNAP} || '|' || label AS cluster_id, all_pos AS pos, paper_id FROM (SELECT t.*, (SELECT count(*) FROM pl o WHERE o.month_key = t.month_key AND o.label = t.label AND o.rank_in_cluster < t.rank_in_cluster) AS old_pos, t.pos AS all_pos FROM tops t)"
ORACLES["top_n_per_cluster"] = f"""WITH {_KNOWN} SELECT label AS cluster_id, paper_id, title, rank_in_cluster FROM (SELECT r.label, p.paper_id, p.title, r.rank_in_cluster,
row_number() OVER (PARTITION BY r.label ORDER BY r.rank_in_cluster, p.paper_id) AS n FROM ranked r JOIN papers p ON p.doc_id = r.paper_id) WHERE n <= 10"""
ORACLES["cluster_order"] = "SELECT vec_id % 5 AS part, label, count(*) AS size, row_number() OVER (PARTITION BY vec_id % 5 ORDER BY count(*) DESC, label) - 1 AS position FROM embeddings GROUP BY 1, 2"
_PACK = f"""WITH {_KNOWN}, m0 AS (SELECT paper_id % 3 AS part, label AS cluster_index, paper_id AS seq, 'hf:' || paper_id AS pid, CASE WHEN paper_id % 11 > 0 THEN rank_in_cluster END AS r FROM ranked),
m AS (SELECT * FROM m0 UNION ALL SELECT part, cluster_index, -seq - 1, 'unknown:' || seq, r FROM m0 WHERE seq % 13 = 0),
p AS (SELECT doc_id % 3 AS part, paper_id AS pid, title, keywords FROM papers), c AS (SELECT DISTINCT part, cluster_index FROM m),
j AS (SELECT m.part, cluster_index, pid AS paper_id, title, coalesce(r, 0) AS rank_in_cluster, len(keywords)::BIGINT AS n_keywords,
  row_number() OVER (PARTITION BY m.part, cluster_index ORDER BY coalesce(r, 999), seq) - 1 AS pos FROM m JOIN p USING (part, pid)) """
ORACLES["pack_clusters"] = _PACK + "SELECT part, cluster_index, pos, paper_id, title, rank_in_cluster, n_keywords FROM c LEFT JOIN j USING (part, cluster_index)"
ORACLES["pack_warnings"] = _PACK + "SELECT part, cluster_index, 'unknown paper' AS warning, pid AS paper_id FROM m ANTI JOIN p USING (part, pid)"
ORACLES["pack_stats"] = _PACK + "SELECT part, count(DISTINCT cluster_index) AS n_clusters, count(paper_id)::BIGINT AS n_papers FROM c LEFT JOIN j USING (part, cluster_index) GROUP BY part"
ORACLES["payload_json"] = f"""WITH {_KNOWN}, m AS (SELECT month_key, label, p.paper_id, round(sim, 9) AS sim, rank_in_cluster FROM ranked r JOIN papers p ON p.doc_id = r.paper_id)
SELECT month_key, (SELECT count(*) FROM m o WHERE o.month_key = m.month_key) AS n_papers, label::BIGINT AS cluster_index, count(*) AS size, round(avg(sim), 6) AS cohesion, string_agg(paper_id, ',' ORDER BY rank_in_cluster, paper_id) AS members FROM m GROUP BY month_key, label"""
_CUT = f"CASE WHEN length({strip('summary')}) > 350 THEN ({strip('summary')})[1:350] || '…' ELSE {strip('summary')} END"
ORACLES["text_report"] = f"""WITH {_KNOWN}, m AS (SELECT month_key, label, rank_in_cluster, chr(10) || '[' || p.paper_id || '] ' || title || chr(10) || CASE WHEN {strip('summary')} <> '' THEN 'Summary: ' || {_CUT} || chr(10) ELSE '' END AS line
  FROM ranked r JOIN papers p ON p.doc_id = r.paper_id),
b AS (SELECT month_key, label, count(*) AS n, chr(10) || repeat('-', 90) || chr(10) || 'Cluster ' || label || ' | size=' || count(*) || chr(10) || string_agg(line, '' ORDER BY rank_in_cluster) AS block FROM m GROUP BY month_key, label)
SELECT month_key, chr(10) || repeat('=', 90) || chr(10) || 'Best clustering' || chr(10) || string_agg(block, '' ORDER BY n DESC, label) AS report FROM b GROUP BY month_key"""
ORACLES["month_text"] = f"""WITH {PAPERS}, r AS (SELECT month_key, month_key || ' total ' || count(*) || ' papers:' || chr(10) || string_agg('   title: ' || title || chr(10) || '   summary: ' || summary || chr(10) || '   id: ' || paper_id || chr(10) || '   ai_summary: N/A' || chr(10) || chr(10), '' ORDER BY doc_id) AS report FROM papers GROUP BY month_key)
SELECT month_key, sha256(report) AS sha256, length(report)::BIGINT AS n_chars FROM r"""
_MONTH_TEXT = ORACLES["month_text"].replace("SELECT month_key, sha256(report) AS sha256, length(report)::BIGINT AS n_chars FROM r", "SELECT month_key, report FROM r")
_SPLIT = "SELECT month_key, unnest(range(0, len(l) - 1)) AS n, unnest(l[1:len(l) - 1]) AS line FROM (SELECT month_key, string_split(report, chr(10)) AS l FROM ({}))"
ORACLES["report_lines"], ORACLES["month_lines"] = _SPLIT.format(ORACLES["text_report"]), _SPLIT.format(_MONTH_TEXT)
ORACLES["prompt_render"] = f"""WITH {PAPERS}, p AS (SELECT doc_id, 'Sum up ' || title || ' for ' || lang || '.' AS prompt FROM papers)
SELECT doc_id, prompt, sha256(prompt)[1:16] AS digest, greatest(1, length(prompt) // 4)::BIGINT + 512 AS tokens FROM p"""
ORACLES["run_id"] = f"WITH {PAPERS} SELECT doc_id, substring(month_key, 7) || '__p0__enrich__org_' || lang || '__t0_2__' || sha256(title)[1:8] AS run_id FROM papers"
ORACLES["rich_pack"] = rf"""WITH {_KNOWN}, t AS (SELECT label, p.paper_id, rank_in_cluster, {strip('summary')} AS s, row_number() OVER (PARTITION BY label ORDER BY rank_in_cluster) AS n FROM ranked r JOIN papers p ON p.doc_id = r.paper_id)
SELECT label, paper_id, rank_in_cluster, coalesce(array_to_string(list_filter({_SENT.format('s')}, lambda x: regexp_matches(x, '[0-9]')), ' '), '')[1:1200] AS highlights FROM t WHERE n <= 3"""

# --- encoders, checked input, files and cards -------------------------------------------------

ORACLES["encode_terms"] = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9À-ÿ]+')) AS term FROM documents),
h AS (SELECT doc_id, ('0x' || md5(term)[1:8])::BIGINT % 4096 AS bucket, ('0x' || md5(term)[9:16])::BIGINT AS bits, count(*) AS n FROM t GROUP BY doc_id, term),
w AS (SELECT bucket, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1 AS w FROM h GROUP BY bucket),
v AS (SELECT doc_id, pos, sum(n * w * (1 - 2 * ((bits >> pos) & 1))) AS x FROM h JOIN w USING (bucket), range(32) r(pos) GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(x * x)) + 1e-12 AS len FROM v GROUP BY doc_id)
SELECT d.doc_id, r.pos, round(coalesce(x / len, 0), 6) + 0.0 AS value FROM documents d CROSS JOIN range(32) r(pos) LEFT JOIN v ON v.doc_id = d.doc_id AND v.pos = r.pos LEFT JOIN l ON l.doc_id = d.doc_id"""
_READ = "'' AS fault, doc_id::VARCHAR AS id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 8"
_BAD = "SELECT doc_id, {} AS pos, '{}' AS fault, '' AS id, '{}' AS sha256 FROM documents WHERE doc_id % 8 {}"
ORACLES["checked_items"] = " UNION ALL ".join(
    [f"SELECT doc_id, 0::BIGINT AS pos, {_READ} IN (0, 1)", f"SELECT doc_id, 1, {_READ} IN (1, 4)", f"SELECT doc_id, 2, {_READ} = 5"]
    + [_BAD.format(*case) for case in ((-1, "not JSON", "", "IN (2, 6)"), (-1, "no list of papers", '{"other":1}', "= 3"), (0, "no id", '{"id":5}', "= 4"), (0, "not an object", "5", "= 5"), (1, "wrong type: title", '{"id":"x","title":["t"]}', "= 5"))]
)
ORACLES["payload_files"] = _FLAT + """SELECT 'payload' AS kind, month_key AS payload_id, count(*) AS n, 0::BIGINT AS n_faults, 0::BIGINT AS n_papers, NULL::BIGINT AS n_chars, NULL::DOUBLE AS cohesion FROM months GROUP BY ALL
UNION ALL SELECT 'papers', month_key, count(*), 0, count(DISTINCT paper_id), sum(length(summary))::BIGINT, NULL FROM p GROUP BY ALL
UNION ALL SELECT 'clusters', month_key, count(*), 0, 0, NULL, round(sum(c), 6) FROM (SELECT month_key, avg(sim) AS c FROM placed GROUP BY month_key, label) GROUP BY month_key
UNION ALL SELECT 'members', month_key, count(*), 0, count(DISTINCT paper_id), NULL, NULL FROM placed GROUP BY month_key"""
ORACLES["month_files"] = ORACLES["month_lines"]
ORACLES["memory_files"] = ORACLES["ingested_cluster_member"]
ORACLES["card_faults"] = f"""WITH {PAPERS}, c AS (SELECT *, list_distinct(keywords) AS tags, coalesce(text, '') AS body FROM papers JOIN documents USING (doc_id)),
f AS (SELECT doc_id, list_concat([CASE WHEN title IS NULL THEN 'topic_name required' WHEN title = '' THEN 'topic_name minLength' WHEN length(title) > 100 THEN 'topic_name maxLength' END,
CASE WHEN coalesce(title, '') = '' THEN 'one_liner minLength' WHEN length(title) > 220 THEN 'one_liner maxLength' END, CASE WHEN coalesce(len(tags), 0) < 3 THEN 'tags minItems' WHEN len(tags) > 7 THEN 'tags maxItems' END,
CASE WHEN body = '' THEN 'what_this_cluster_is_about minLength' WHEN length(body) > 1200 THEN 'what_this_cluster_is_about maxLength' END, CASE WHEN body = '' THEN 'why_it_matters minLength' WHEN length(body) > 1200 THEN 'why_it_matters maxLength' END,
CASE WHEN doc_id % 5 = 0 THEN 'confidence enum' END, CASE WHEN doc_id % 7 = 0 THEN 'representative_papers required' WHEN doc_id % 11 = 0 THEN 'representative_papers[0].url required' END,
CASE WHEN doc_id % 13 = 0 THEN 'reading_order minItems' WHEN doc_id % 13 > 10 THEN 'reading_order maxItems' END, CASE WHEN doc_id % 3 = 0 THEN 'score additionalProperties' END,
CASE doc_id % 9 WHEN 0 THEN 'cluster_highlights minItems' WHEN 8 THEN 'cluster_highlights maxItems' END], [CASE WHEN length(t) > 40 THEN 'tags maxLength' END for t in tags]) AS all_faults FROM c),
g AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN ['$ json'] ELSE list_sort(list_filter(all_faults, lambda x: x IS NOT NULL)) END AS faults FROM f)
SELECT doc_id, len(faults) AS n, coalesce(array_to_string(faults, ','), '') AS faults FROM g"""

# --- judging ----------------------------------------------------------------------------------

_TAKE = "coalesce(array_to_string(w[1:{}], ' '), '')"
_J = f"""WITH b AS (SELECT doc_id AS d, lang, regexp_extract_all(text, '\\p{{L}}+') AS w FROM documents),
f AS (SELECT d, lang, {_TAKE.format('5 + d % 30')} AS one, {_TAKE.format('70 + d % 80')} || CASE WHEN d % 6 = 0 THEN '' ELSE ' [d' || d || ']' END || CASE WHEN d % 11 = 0 THEN ' cluster' ELSE '' END AS about,
  {_TAKE.format('50 + d % 80')} AS why, {_TAKE.format('10 + d % 12')} AS why_high, {_TAKE.format('3')} AS r1, {_TAKE.format('8 + d % 7')} AS r2, {_TAKE.format('1 + d % 6')} AS seed, {_TAKE.format('15 + d % 8')} AS note,
  NOT (d % 13 = 0 OR d % 17 = 0 OR d % 19 = 0) AS parsed, d % 19 = 0 AS failed,
  list_sort(list_filter(list_distinct(['d' || d, 'd' || (d % 9), 'd0', 'd1']), lambda x: x NOT IN ('d0', 'd1', 'd2', 'd3', 'd4') AND x <> 'd' || d)) AS bad0 FROM b),
c AS (SELECT *, CASE WHEN parsed THEN bad0 ELSE [] END AS bad, parsed AND d % 5 IN (0, 2, 3) AS title_format,
  parsed AND d % 6 <> 0 AND NOT contains(lower(about), 'cluster') AS about_citations, parsed AND d % 7 NOT IN (1, 3) AS keyword_list_format, parsed AS title_word_count,
  parsed AND {count('one')} BETWEEN 1 AND 25 AS one_liner, parsed AND {count('about')} BETWEEN 80 AND 140 AS about_word_count, parsed AND {count('why')} BETWEEN 60 AND 120 AS why_it_matters_word_count,
  parsed AND {count('why_high')} <= 18 AS confidence_rationale, parsed AND len({_TERMS.format('seed')}) BETWEEN 2 AND 5 AS search_query_seed, parsed AND {count('note')} <= 20 AS notes,
  parsed AND {count('r2')} <= 12 AS reading_order_item_reasons, parsed AND d % 7 <> 2 AS keyword_word_counts, parsed AND d % 7 NOT IN (0, 3) AS keyword_list_count, parsed AND d % 5 <> 2 AS name_generic FROM f),
j AS (SELECT *, title_format AND about_citations AND keyword_list_format AND len(bad) = 0 AS hard_valid,
  (title_word_count::INT + one_liner::INT + about_word_count::INT + why_it_matters_word_count::INT + confidence_rationale::INT + search_query_seed::INT + notes::INT + reading_order_item_reasons::INT + keyword_word_counts::INT + keyword_list_count::INT + name_generic::INT) / 11 AS soft_score FROM c),
judged AS (SELECT *, CASE WHEN hard_valid THEN 1 + soft_score ELSE 0 END AS overall FROM j) """
_RULES = ["title_format", "about_citations", "keyword_list_format", "title_word_count", "one_liner", "about_word_count", "why_it_matters_word_count", "confidence_rationale", "search_query_seed", "notes", "reading_order_item_reasons", "keyword_word_counts", "keyword_list_count", "name_generic"]
ORACLES["judge_checks"] = _J + f"SELECT d AS doc_id, parsed, {', '.join(_RULES)} FROM judged"
ORACLES["judge_overall"] = _J + "SELECT d AS doc_id, parsed, hard_valid, round(soft_score, 6) AS soft_score, round(overall, 6) AS overall FROM judged"
ORACLES["invalid_citations"] = _J + "SELECT d AS doc_id, coalesce(array_to_string(bad, ','), '') AS bad, CASE WHEN len(bad) > 0 THEN 'Invalid citations: ' || array_to_string(bad, ', ') ELSE '' END AS reason FROM judged"
_BOARD = "board AS (SELECT lang AS run_id, 'm' || (d % 3) AS model, coalesce(avg(overall) FILTER (parsed), 0) AS overall, count(*) AS n_reports, coalesce(string_agg(d::VARCHAR, ',' ORDER BY d) FILTER (NOT parsed), '') AS missing_report, count(*) FILTER (failed) AS n_missing_response FROM judged GROUP BY ALL)"
ORACLES["model_leaderboard"] = _J + f", {_BOARD} SELECT run_id, model, round(overall, 6) AS overall, n_reports, missing_report, n_missing_response FROM board"
ORACLES["run_summary"] = _J + f", {_BOARD} SELECT run_id, count(*) AS n_models, string_agg(model, ',' ORDER BY overall DESC, model) AS \"order\" FROM board GROUP BY run_id"
ORACLES["evaluation_summary"] = _J + f""", {_BOARD}, more AS (SELECT lang AS run_id, 'm' || (d % 3) AS model, max(d + d % 7 + 1) - min(d) AS seconds, bool_or(parsed) AS parsed_output, coalesce(string_agg(d::VARCHAR, ',' ORDER BY d) FILTER (failed), '') AS missing_response FROM judged GROUP BY ALL),
asked AS (SELECT DISTINCT lang AS run_id, pos, model FROM documents, (VALUES (0, 'm2'), (1, 'org/none'), (2, 'm0'), (3, 'm1')) v(pos, model))
SELECT run_id, 'hf|2025-01-01|2025-01-31' AS snapshot_id, '2025-01' AS month, 'p0' AS packing_variant, 'enrich' AS prompt_variant, sha256('Sum up in ' || run_id)[1:16] AS prompt_hash, 'm2,org/none,m0,m1' AS models, pos::BIGINT AS pos, model,
round(coalesce(overall, 0), 6) AS overall, coalesce(seconds, 0)::DOUBLE AS duration, coalesce(parsed_output, false) AS parsed_output, coalesce(missing_report, '') AS missing_report, coalesce(missing_response, '') AS missing_response,
'responses/' || replace(model, '/', '_') || '.json' AS response_file, CASE WHEN n_reports IS NULL THEN 'no responses' END AS error FROM asked LEFT JOIN board USING (run_id, model) LEFT JOIN more USING (run_id, model)"""
ORACLES["judge_rule_averages"] = _J + """SELECT lang, rule, round(avg(v), 6) AS average FROM (SELECT lang, unnest(['json_valid', 'hard_schema_valid', 'soft_schema_valid']) AS rule, unnest([parsed::INT::DOUBLE, hard_valid::INT::DOUBLE, soft_score]) AS v FROM judged) GROUP BY ALL"""
ORACLES["board_rollup"] = _J + """SELECT lang, 'm' || (d % 3) AS model, round(avg(overall), 6) AS mean_overall, round(avg((NOT parsed)::INT), 6) AS parse_failures, round(avg((NOT hard_valid)::INT), 6) AS hard_failures, count(*) AS n FROM judged GROUP BY ROLLUP (1, 2)"""
ORACLES["rubric_score"] = _J + "SELECT d AS doc_id, round(CASE WHEN parsed AND len(bad) = 0 THEN 0.7 * soft_score + 0.15 * overall ELSE 0 END, 6) AS rubric FROM judged"


def sections(shift: int) -> str:
    return f"""SELECT doc_id, bad_input, json_ok, schema_ok, title_match, citations_ok, cross_links, rep_order, 1.0 AS reading_order_ok,
CASE WHEN bad_input OR NOT json_ok THEN 0 WHEN NOT schema_ok THEN 0.35 ELSE 0.35 + 0.35 * title_match + 0.2 * cross_links + 0.1 * (1 + citations_ok + rep_order + 1) / 4 END AS overall
FROM (SELECT doc_id, f % 23 = 0 AS bad_input, f % 13 <> 0 AS json_ok, f % 13 <> 0 AND f % 11 <> 0 AS schema_ok, (f % 5 <> 0)::INT AS title_match, (f % 7 <> 0)::INT AS citations_ok,
CASE (f % 7 <> 0)::INT + (f % 4 <> 0)::INT WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS cross_links, CASE WHEN f % 3 = 0 THEN 0.7 ELSE 1.0 END AS rep_order FROM (SELECT doc_id, doc_id + {shift} AS f FROM documents))"""


ORACLES["heuristic_score"] = f"SELECT doc_id, json_ok, schema_ok, round(overall, 6) AS overall FROM ({sections(0)})"
_RULE = """SELECT rule, sum(coalesce(v, 0)) / (SELECT count(*) FROM documents) AS average FROM (SELECT unnest(['valid_json_format', 'schema_valid', 'title_match', 'citations_ok', 'cross_links', 'rep_order', 'reading_order_ok']) AS rule,
unnest([CASE WHEN NOT bad_input THEN json_ok::INT::DOUBLE END, CASE WHEN NOT bad_input AND json_ok THEN schema_ok::INT::DOUBLE END, CASE WHEN ok THEN title_match::DOUBLE END, CASE WHEN ok THEN citations_ok::DOUBLE END, CASE WHEN ok THEN cross_links::DOUBLE END, CASE WHEN ok THEN rep_order::DOUBLE END, CASE WHEN ok THEN reading_order_ok::DOUBLE END]) AS v
FROM (SELECT *, schema_ok AND NOT bad_input AS ok FROM ({}))) GROUP BY rule"""
ORACLES["rule_compare"] = f"SELECT rule, round(a.average, 6) AS before, round(b.average, 6) AS after, round(b.average - a.average, 6) AS change FROM ({_RULE.format(sections(0))}) a JOIN ({_RULE.format(sections(1))}) b USING (rule)"
ORACLES["section_rules"] = f"SELECT rule, round(average, 6) AS average FROM ({_RULE.replace('FROM documents)', 'FROM documents WHERE doc_id % 23 <> 0)').format('SELECT * FROM (' + sections(0) + ') WHERE NOT bad_input')})"

# --- topics -----------------------------------------------------------------------------------

ORACLES["novelty"] = vectors("SELECT paper_id, label, round(1 - round(sim, 9), 6) AS novelty, row_number() OVER (PARTITION BY label ORDER BY round(sim, 9), paper_id) - 1 AS novelty_rank FROM sims")
ORACLES["period_sizes"] = "SELECT period, count(*) AS n_clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size FROM (SELECT vec_id % 4 AS period, label, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY 1"


def directions(group: str) -> str:
    return f"""WITH {POINTS}, gf AS (SELECT {group} AS g, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM points), gm AS (SELECT g, label, i, avg(x) AS m FROM gf GROUP BY ALL),
gc AS (SELECT g, label, list(m ORDER BY i) AS c FROM gm GROUP BY ALL), gd AS (SELECT g, label, list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-12)) AS v FROM gc) """


ORACLES["period_drift"] = directions("paper_id % 4") + """SELECT g AS period, label, n.label AS previous_label, round(1 - n.s, 6) AS drift FROM (SELECT a.g, a.label, max(struct_pack(s := list_inner_product(a.v, b.v), label := b.label)) AS n FROM gd a JOIN gd b ON b.g = a.g - 1 GROUP BY ALL)"""
ORACLES["topic_match"] = directions("paper_id % 2") + """SELECT label AS cluster_id, CASE WHEN n.s >= 0.1 THEN 'attach' ELSE 'new' END AS decision, CASE WHEN n.s >= 0.1 THEN n.label::VARCHAR END AS topic_id, round(n.s, 6) AS match_score, CASE WHEN n.s >= 0.1 THEN n.label + 1 ELSE 0 END AS depth
FROM (SELECT a.label, max(struct_pack(s := list_inner_product(a.v, b.v), label := b.label)) AS n FROM gd a JOIN gd b ON a.g = 1 AND b.g = 0 GROUP BY ALL)"""
ORACLES["unique_tags"] = LABELLED + """t AS (SELECT DISTINCT lang, label, unnest(keywords) AS tag FROM lp), s AS (SELECT lang, tag, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, round(avg((n = 1)::INT), 6) AS unique_share, count(*) AS n_tags FROM s GROUP BY lang"""
ORACLES["keyword_hints"] = LABELLED + """t AS (SELECT label, k AS keyword, count(*) AS tf FROM (SELECT label, unnest(keywords) AS k FROM lp) GROUP BY ALL), d AS (SELECT keyword, count(*) AS df FROM t GROUP BY ALL),
s AS (SELECT *, tf * ln((1 + (SELECT count(DISTINCT label) FROM lp)) / (1 + df)) + tf AS tfidf FROM t JOIN d USING (keyword)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tfidf DESC, keyword) AS n FROM s) SELECT label, keyword, tf, df, round(tfidf, 6) AS tfidf FROM r WHERE n <= 5"""
ORACLES["confidence_bucket"] = vectors("SELECT label, CASE WHEN count(*) >= 4 AND round(avg(sim), 9) >= 0.35 THEN 'HIGH' WHEN count(*) >= 2 OR round(avg(sim), 9) >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sims GROUP BY label")
