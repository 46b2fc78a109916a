"""DuckDB SQL for the queries, written on its own and not derived from them."""

from __future__ import annotations

from textmill.functions import keys as K
from textmill.operators import obfuscate as O

ORACLE: dict[str, str] = {}

_LABEL = "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT"
_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_KEYS = rf"""keyed AS (SELECT *, sha256(text) AS exact_key, sha256({_WS.format("text")}) AS whitespace_key,
  sha256({_WS.format("lower(text)")}) AS normalized_key,
  sha256(nullif(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '')) AS alnum_key FROM documents)"""
_STRIP = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"
_FLAGS = rf"""flagged AS (SELECT *, CASE WHEN text IS NULL OR {_WS.format("text")} = '' THEN ['empty_or_whitespace_text'] ELSE list_filter([
  CASE WHEN length({_STRIP}) < 4 OR len(string_split({_WS.format("text")}, ' ')) < 2 THEN 'very_short' END,
  CASE WHEN length({_STRIP}) > 1000 THEN 'very_long' END,
  CASE WHEN regexp_matches({_STRIP}, '^[\d\s]+$') THEN 'digits_only' END,
  CASE WHEN NOT regexp_matches(text, '[\p{{L}}\p{{N}}]') THEN 'no_alphanumeric_chars' END,
  CASE WHEN regexp_matches(text, '(?i)https?://|www\.|\.com|\.id|\.net|\.xyz|\.link') THEN 'has_url' END,
  CASE WHEN regexp_matches(text, '[\x{{1D400}}-\x{{1D7FF}}\x{{2460}}-\x{{24FF}}\x{{2100}}-\x{{214F}}]') THEN 'has_unicode_math' END,
  CASE WHEN regexp_matches(text, '[\r\n\t\x{{A0}}\x{{200B}}]|  ') THEN 'whitespace_anomaly' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{7f}}-\x{{9f}}]') THEN 'control_characters' END
  ], lambda x: x IS NOT NULL) END AS f FROM documents),
stated AS (SELECT *, CASE WHEN list_contains(f, 'empty_or_whitespace_text') THEN 'invalid' WHEN len(f) > 0 THEN 'suspicious' ELSE 'valid' END AS status FROM flagged)"""

ORACLE["exact_dedup_canonical"] = """SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, 'EDG_' || substr(sha256(text), 1, 12) AS exact_duplicate_group,
 count(*) AS source_record_count, array_to_string(list_sort(list(DISTINCT source)), ';') AS source_datasets_combined FROM documents GROUP BY text"""
ORACLE["text_keys"] = f"""WITH {_KEYS} SELECT doc_id, exact_key, whitespace_key, normalized_key, alnum_key, 'EDG_' || substr(exact_key, 1, 12) AS edg,
 'WDG_' || substr(whitespace_key, 1, 12) AS wdg, 'NVG_' || substr(normalized_key, 1, 12) AS nvg FROM keyed"""
ORACLE["quality_flags"] = f"WITH {_FLAGS} SELECT doc_id, array_to_string(f, ';') AS data_quality_flags, status AS data_quality_status FROM stated"
_pct = lambda p, k: f"avg(CASE WHEN regexp_matches(text, '{p}') THEN 1.0 ELSE 0.0 END) * 100 AS pct_{k}"
ORACLE["quality_summary"] = f"""WITH {_FLAGS} SELECT source, count(*) AS n_rows, count_if(status = 'valid')::BIGINT AS n_valid, count_if(status = 'suspicious')::BIGINT AS n_suspicious,
 min(length(text)) AS min_chars, avg(length(text)) AS avg_chars, max(length(text)) AS max_chars, {_pct("[0-9]", "digit")}, {_pct(K.URL, "url")}, {_pct("[^\\x00-\\x7F]", "wide")}, {_pct("[\\r\\n\\t\\x{A0}\\x{200B}]|  ", "gap")} FROM stated GROUP BY source"""
ORACLE["length_profile"] = """SELECT min(length(text)) AS min_len, quantile_cont(length(text), 0.5)::DOUBLE AS median_len, avg(length(text)) AS mean_len, max(length(text)) AS max_len,
 quantile_cont(length(text), 0.995)::DOUBLE AS p995, (ceil(quantile_cont(length(text), 0.995) / 32) * 32)::BIGINT AS max_length FROM documents"""
ORACLE["entity_report"] = """WITH p(term, pat) AS (VALUES ('license', 'licen[sc]e'), ('mail', '@mail'), ('token', 'token'), ('idiot_clown', 'idiot|clown'), ('entertainment', 'enter'), ('heading', 'the'))
SELECT term, count(*) AS documents, round_even(count(*)::DOUBLE / (SELECT count(*) FROM documents) * 100, 2) AS pct_of_total FROM documents, p WHERE regexp_matches(lower(text), pat) GROUP BY term"""


def _named(patterns: dict[str, str], text: str = "text") -> str:
    arms = ", ".join(f"CASE WHEN regexp_matches(lower({text}), '{p}') THEN '{k}' END" for k, p in patterns.items())
    return f"list_filter([{arms}], lambda x: x IS NOT NULL)"


_given = """(text || CASE WHEN doc_id % 2 = 0 THEN ' ' || (['Toke 69 slot', 'gunung WIN maxwin', 'kakek zeus jp', 'weton`88 depo', 'slots gacorr', 'pulau-win', 'ga ruda_ho ki scatter', 'Ambil4D judi wd'])[(doc_id // 2) % 8 + 1] || ' .' ELSE '' END)"""
ORACLE["brand_signals"] = f"SELECT doc_id, array_to_string({_named(K.BRANDS, _given)}, ';') AS known_brand_entity, array_to_string({_named(K.SIGNALS, _given)}, ';') AS gambling_signal_terms FROM documents"
_neg = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for k, p in K.NEGATIVE_SUBTYPES.items())
_pos = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for k, p in K.POSITIVE_SUBTYPES.items())
ORACLE["heuristic_subtype"] = rf"""WITH b AS (SELECT doc_id, text, lower(text) AS low, {_LABEL} AS label, len({_named(K.SIGNALS)}) > 0 AS has_signal FROM documents)
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'ambiguous' WHEN label = 0 THEN (CASE WHEN has_signal AND regexp_matches(low, '{K.NEGATIVE_WARNING}') THEN 'anti_gambling' {_neg} WHEN has_signal THEN 'neutral_gambling_discussion' ELSE 'non_gambling' END)
 ELSE (CASE WHEN regexp_matches(text, '[\x{{1D400}}-\x{{1D7FF}}\x{{2460}}-\x{{24FF}}\x{{FF01}}-\x{{FF5E}}]') THEN 'obfuscated_promotion' {_pos} ELSE 'site_endorsement' END) END AS promotion_type_heuristic FROM b"""
ORACLE["obfuscation_candidate"] = r"""SELECT doc_id, regexp_matches(text, '[\x{1D400}-\x{1D7FF}\x{2460}-\x{24FF}\x{FF01}-\x{FF5E}\x{2100}-\x{214F}]')
 OR regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Za-z0-9]\s+[A-Za-z0-9]\s+[A-Za-z0-9]([^\p{L}\p{N}_]|$)') OR regexp_matches(text, '\[dot\]|\(dot\)|\*+[A-Za-z0-9]+\*+|█|☯|✅|⭐') AS obfuscation_candidate FROM documents"""
ORACLE["author_groups"] = "SELECT 'EV_AUTH_' || substr(md5(lower(trim(user_id::VARCHAR))), 1, 10) AS author_group_id, count(*) AS n_events FROM events GROUP BY 1"
ORACLE["timestamp_standardize"] = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso, strftime(make_timestamp(event_id * 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS from_seconds, NULL::VARCHAR AS from_bad FROM events"""
ORACLE["duplicate_flags"] = """SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate, n > 1 AS is_cross_dataset_duplicate FROM documents JOIN (SELECT text, count(DISTINCT source) AS n FROM documents GROUP BY text) USING (text)"""
ORACLE["duplicate_group_report"] = f"""SELECT 'EDG_' || substr(sha256(text), 1, 12) AS group_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources,
 array_to_string(list_sort(list(DISTINCT ({_LABEL})::VARCHAR)), ';') AS labels, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1"""
_CONF = f"""per AS (SELECT sha256(text) AS k, source, count(*) AS n, list_sort(list(DISTINCT {_LABEL})) AS s FROM documents GROUP BY 1, 2),
conf AS (SELECT k, sum(n)::BIGINT AS source_record_count, array_to_string(list_sort(list(DISTINCT source)), ';') AS datasets_present, max(len(s)) > 1 AS within_dataset_conflict, count(DISTINCT s) > 1 AS cross_dataset_conflict
 FROM per GROUP BY k HAVING len(list_distinct(flatten(list(s)))) > 1)"""
ORACLE["label_conflicts"] = f"WITH {_CONF} SELECT * FROM conf"
ORACLE["conflict_summary"] = f"""WITH {_CONF}, s AS (SELECT count(*) AS total, coalesce(sum(source_record_count), 0)::BIGINT AS "rows", count_if(cross_dataset_conflict)::BIGINT AS c, count_if(within_dataset_conflict)::BIGINT AS w, count_if(cross_dataset_conflict AND within_dataset_conflict)::BIGINT AS b FROM conf)
SELECT total, "rows", c AS "cross", w AS within, b AS both, c - b AS only_cross, w - b AS only_within FROM s"""
ORACLE["adjudicate"] = f"""WITH {_CONF} SELECT doc_id, CASE WHEN cross_dataset_conflict THEN 1 ELSE {_LABEL} END::BIGINT AS canonical_label, CASE WHEN k IS NULL OR cross_dataset_conflict THEN 'accepted' ELSE 'review' END AS label_status FROM documents LEFT JOIN conf ON k = sha256(text)"""
ORACLE["pair_label_conflicts"] = f"""WITH f AS (SELECT text, source, arg_min({_LABEL}, doc_id) AS l FROM documents GROUP BY 1, 2)
SELECT a.source AS dataset_a, b.source AS dataset_b, count(*) AS pair_label_conflicts FROM f a JOIN f b ON a.text = b.text AND a.source < b.source AND a.l <> b.l GROUP BY 1, 2"""


def _overlap() -> str:
    levels = ("exact", "whitespace", "normalized", "alnum")
    ctes, cols, joins = [], [], []
    for v in levels:
        ctes.append(f"""{v}_k AS (SELECT a.source AS a, b.source AS b, count(DISTINCT a.{v}_key) AS u FROM keyed a JOIN keyed b ON a.{v}_key = b.{v}_key AND a.source < b.source GROUP BY 1, 2),
{v}_e AS (SELECT a, b, count(DISTINCT e) AS g FROM (SELECT a.source AS a, b.source AS b, unnest([a.exact_key, b.exact_key]) AS e FROM keyed a JOIN keyed b ON a.{v}_key = b.{v}_key AND a.source < b.source) GROUP BY 1, 2)""")
        cols.append(f"coalesce({v}_e.g, 0) AS shared_{v}_groups, coalesce({v}_k.u, 0) AS unique_{v}_shared")
        joins.append(f"LEFT JOIN {v}_e ON {v}_e.a = p.a AND {v}_e.b = p.b LEFT JOIN {v}_k ON {v}_k.a = p.a AND {v}_k.b = p.b")
    return f"WITH {_KEYS}, {', '.join(ctes)}, p AS (SELECT x.source AS a, y.source AS b FROM (SELECT DISTINCT source FROM documents) x JOIN (SELECT DISTINCT source FROM documents) y ON x.source < y.source) SELECT p.a AS dataset_a, p.b AS dataset_b, {', '.join(cols)} FROM p {' '.join(joins)}"


ORACLE["pairwise_overlap"] = _overlap()
ORACLE["overlap_monotonicity"] = f"SELECT dataset_a, dataset_b FROM ({_overlap()}) WHERE shared_exact_groups > shared_whitespace_groups OR shared_whitespace_groups > shared_normalized_groups OR shared_normalized_groups > shared_alnum_groups"
_appears = ", ".join(f"bool_or(source = 'src{i}') AS appears_in_src{i}" for i in range(20))
ORACLE["source_coverage"] = f"SELECT min(doc_id) AS doc_id, count(DISTINCT source) AS source_count, {_appears} FROM documents GROUP BY text"
ORACLE["reconciliation"] = f"""WITH {_FLAGS}, k AS (SELECT text, count(DISTINCT source) AS n_sources, min(doc_id) AS first, count(DISTINCT {_LABEL}) > 1 AS conflict FROM documents GROUP BY text),
 ls AS (SELECT text, source, list_sort(list(DISTINCT {_LABEL})) AS s FROM documents GROUP BY 1, 2), lk AS (SELECT text, count(DISTINCT s) AS n_sets FROM ls GROUP BY text),
 r AS (SELECT source, status, count(*) OVER (PARTITION BY source, text) AS n_ds, count(*) OVER (PARTITION BY text) AS n_all, n_sources, conflict, conflict AND n_sets = 1 AS review, doc_id = first AND status <> 'invalid' AS rep FROM stated JOIN k USING (text) JOIN lk USING (text)),
 two AS (SELECT source, n_ds AS n, * EXCLUDE (source, n_ds, n_all) FROM r UNION ALL SELECT 'TOTAL', n_all, * EXCLUDE (source, n_ds, n_all) FROM r)
SELECT source, count(*) AS raw_rows, count_if(status = 'invalid')::BIGINT AS invalid_rows, count_if(n > 1)::BIGINT AS exact_duplicate_rows, count_if(n_sources > 1)::BIGINT AS cross_duplicate_rows, count_if(conflict)::BIGINT AS conflict_rows,
 count_if(review AND status <> 'invalid')::BIGINT AS review_rows, count_if(NOT review AND status <> 'invalid')::BIGINT AS accepted_rows, count_if(rep)::BIGINT AS final_rows, (count(*) - count_if(rep))::BIGINT AS excluded_rows FROM two GROUP BY source"""
ORACLE["harmonize_union"] = """SELECT printf('DS1_%06d', doc_id) AS record_id, 'DS1' AS source_dataset, 'documents' AS source_lineage, doc_id AS source_row_id, coalesce(text, '') AS text_raw, NULL::VARCHAR AS canonical_label FROM documents
UNION ALL SELECT printf('DS2_%06d', conv_id * 1000 + turn), 'DS2', 'conversations', (conv_id * 1000 + turn)::BIGINT, coalesce(text, ''), turn::VARCHAR FROM conversations
UNION ALL SELECT printf('DS3_%06d', item_id), 'DS3', 'benchmark', item_id, coalesce(text, ''), NULL FROM benchmark"""
ORACLE["byte_equality"] = "SELECT count_if(doc_id % 50 = 7)::BIGINT AS missing_rows, 0::BIGINT AS mismatches, count_if(doc_id % 50 <> 7)::BIGINT AS equal_rows FROM documents"
_SH = r"""CASE WHEN length(text) < 4 THEN []::VARCHAR[] WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE [coalesce(w[1], '')] END"""
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
_TEXTS = f"texts AS (SELECT min(doc_id) AS doc_id, text, {_WORDS} AS w FROM documents GROUP BY text), sh AS (SELECT doc_id, {_SH} AS shingles FROM texts)"
ORACLE["shingle_counts"] = f"WITH b AS (SELECT doc_id, text, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, {_SH} AS x FROM b) SELECT doc_id, len(x) AS n_shingles, sha256(array_to_string(list_sort(x), '|')) AS digest FROM s"
_PAIRS = f"""{_TEXTS}, e AS (SELECT doc_id, unnest(shingles) AS s FROM sh), n AS (SELECT doc_id, len(shingles) AS n FROM sh),
c AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b, round(k::DOUBLE / (x.n + y.n - k), 4) AS jaccard FROM c JOIN n x ON x.doc_id = id_a JOIN n y ON y.doc_id = id_b WHERE k::DOUBLE / (x.n + y.n - k) >= 0.65)"""
ORACLE["near_dup_pairs_exact"] = f"WITH {_PAIRS} SELECT * FROM pairs"
_hash = "list_transform(shingles, lambda s: ('0x' || substr(md5(s), 1, 8))::BIGINT % 2147483647)"
_mins = ", ".join(f"list_min(list_transform(h, lambda v: (v * {1 + (i * 40503 + 12345) % 65521} + {(i * 69069 + 1) % 1000003}) % 2147483647))" for i in range(64))
_SIG = f"{_TEXTS}, hs AS (SELECT doc_id, {_hash} AS h FROM sh WHERE len(shingles) > 0), sig AS (SELECT doc_id, [{_mins}] AS m FROM hs)"
ORACLE["minhash_signature"] = f"WITH {_SIG} SELECT doc_id, array_to_string(m, ',') AS signature FROM sig"
ORACLE["lsh_candidates"] = f"""WITH {_SIG}, bands AS (SELECT doc_id, b, array_to_string(m[b * 4 + 1 : b * 4 + 4], ',') AS k FROM sig, range(16) t(b)), least_id AS (SELECT b, k, min(doc_id) AS id_a FROM bands GROUP BY 1, 2)
SELECT DISTINCT id_a, doc_id AS id_b FROM bands JOIN least_id USING (b, k) WHERE doc_id > id_a"""
def lsh_pairs_sql(limit: int) -> str:
    """Pairs of buckets, each level of division a table of its own."""
    levels, pairs = [], []
    for i, letters in enumerate((2, 4, 8, 64, None)):
        levels.append(f"n{i} AS (SELECT key, count(*) AS n, min(doc_id) AS least FROM l{i} GROUP BY key)")
        if letters is None:
            pairs.append(f"SELECT least AS id_a, doc_id AS id_b FROM l{i} JOIN n{i} USING (key) WHERE doc_id > least")
            break
        pairs.append(f"SELECT x.doc_id AS id_a, y.doc_id AS id_b FROM l{i} x JOIN l{i} y ON x.key = y.key AND x.doc_id < y.doc_id JOIN n{i} ON n{i}.key = x.key WHERE n < {limit}")
        levels.append(f"l{i + 1} AS (SELECT doc_id, l, al, md5(key || '|' || l || '|' || substr(al, 1, {letters})) AS key FROM l{i} JOIN n{i} USING (key) WHERE n >= {limit})")
    return f"""WITH {_SIG}, bands AS (SELECT doc_id, b, array_to_string(m[b * 4 + 1 : b * 4 + 4], ',') AS k FROM sig, range(16) t(b)),
l0 AS (SELECT doc_id, length(text) // 20 AS l, coalesce(sha256(nullif(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '')), '') AS al, md5(b || ':' || md5(k)) AS key FROM bands JOIN texts USING (doc_id)), {', '.join(levels)},
cand AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(pairs)}))
SELECT id_a, id_b, CASE WHEN j >= 0.65 THEN round(j, 4) END AS jaccard FROM (SELECT id_a, id_b, len(list_intersect(x.shingles, y.shingles))::DOUBLE / (len(x.shingles) + len(y.shingles) - len(list_intersect(x.shingles, y.shingles))) AS j FROM cand JOIN sh x ON x.doc_id = id_a JOIN sh y ON y.doc_id = id_b)"""


ORACLE["lsh_pairs"] = lsh_pairs_sql(200)
_COMP = f"""{_PAIRS}, links AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs), reach(n, r) AS (SELECT doc_id, doc_id FROM texts UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.n),
comp AS (SELECT n AS doc_id, min(r) AS root FROM reach GROUP BY n)"""
_ISO = f"""every AS (SELECT doc_id, text, coalesce(source = 'src0', false) AS held FROM documents UNION ALL SELECT -item_id - 1, text, true FROM benchmark), {_KEYS.replace("FROM documents", "FROM every")}, {_COMP.replace("FROM documents", "FROM every")},
k AS (SELECT keyed.*, root FROM keyed LEFT JOIN texts ON texts.text = keyed.text LEFT JOIN comp ON comp.doc_id = texts.doc_id), h AS (SELECT * FROM k WHERE held),
iso AS (SELECT doc_id, CASE WHEN exact_key IN (SELECT exact_key FROM h) THEN 'exact' WHEN whitespace_key IN (SELECT whitespace_key FROM h) THEN 'whitespace' WHEN normalized_key IN (SELECT normalized_key FROM h) THEN 'normalized'
 WHEN root IN (SELECT root FROM h) THEN 'near_duplicate' END AS overlap_level FROM k WHERE NOT held)"""
ORACLE["isolate_pool"] = f"WITH RECURSIVE {_ISO} SELECT * FROM iso"
ORACLE["isolation_report"] = f"WITH RECURSIVE {_ISO} SELECT coalesce(overlap_level, 'isolated') AS level, count(*) AS n FROM iso GROUP BY 1"
ORACLE["near_dup_components"] = f"WITH RECURSIVE {_COMP} SELECT doc_id, printf('NDG_%06d', root) AS near_duplicate_group FROM comp"
ORACLE["cluster_sizes"] = f"WITH RECURSIVE {_COMP}, z AS (SELECT root, count(*) AS size FROM comp GROUP BY root) SELECT size, count(*) AS clusters FROM z GROUP BY size"
ORACLE["largest_clusters"] = f"WITH RECURSIVE {_COMP} SELECT root, count(*) AS size FROM comp GROUP BY root ORDER BY size DESC, root LIMIT 100"
ORACLE["leakage_groups"] = f"WITH RECURSIVE {_COMP} SELECT d.doc_id, 'LG_' || substr(printf('NDG_%06d', root), 5) AS leakage_group_id FROM documents d JOIN texts t USING (text) JOIN comp ON comp.doc_id = t.doc_id"
ORACLE["stratified_sample"] = f"SELECT doc_id, lang, {_LABEL} AS label FROM documents QUALIFY row_number() OVER (PARTITION BY lang, {_LABEL} ORDER BY sha256('42|' || doc_id), doc_id) <= 20"
ORACLE["proportional_sample"] = """WITH s AS (SELECT lang, round(count(*) * 200.0 / (SELECT count(*) FROM documents)) AS want FROM documents GROUP BY lang)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) AS r FROM documents) JOIN s USING (lang) WHERE r <= want"""
_COND = "cond AS (SELECT f.family, s.severity FROM (VALUES ('O1_CHAR_SUBSTITUTION'), ('O2_CHAR_INSERT_DELETE'), ('O3_WHITESPACE'), ('O4_UNICODE_ORTHOGRAPHIC')) f(family), (VALUES ('MILD'), ('STRONG')) s(severity))"
ORACLE["review_queue_sample"] = f"""WITH {_COND}, r AS (SELECT doc_id, family, severity, {_LABEL} AS label FROM documents, cond QUALIFY row_number() OVER (PARTITION BY family, severity, label ORDER BY sha256('42|' || doc_id), doc_id) <= 20)
SELECT printf('REV_%04d', row_number() OVER (ORDER BY family, severity, label, doc_id)) AS review_id, doc_id, family, severity, label FROM r"""
_SPLIT = f"""{_COMP}, lg AS (SELECT d.doc_id, source, md5('LG_' || substr(printf('NDG_%06d', root), 5)) AS g FROM documents d JOIN texts t USING (text) JOIN comp ON comp.doc_id = t.doc_id),
g AS (SELECT g, count(*) AS n, count_if({_LABEL} = 1) AS p FROM lg GROUP BY 1), o AS (SELECT g, row_number() OVER (ORDER BY p DESC, n DESC, g) - 1 AS r FROM g),
f AS (SELECT g, (CASE WHEN (r // 10) % 2 = 0 THEN r % 10 ELSE 9 - r % 10 END)::BIGINT AS fold FROM o),
folds AS (SELECT doc_id, source, {_LABEL} AS label, lg.g, fold, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM lg JOIN f USING (g))"""
ORACLE["group_split"] = f"WITH RECURSIVE {_SPLIT} SELECT doc_id, fold, split FROM folds"
#: The greedy rule one group at a time: x and y are the folds' negatives and
#: positives; of the ten states that a group can lead to the most even is kept.
_GREEDY = f"""{_SPLIT}, ord AS (SELECT g, n - p AS a, p AS b, row_number() OVER (ORDER BY abs(n - 2 * p) DESC, p DESC, n DESC, g) AS i FROM g), tot AS (SELECT greatest(sum(a), 1)::DOUBLE AS ta, greatest(sum(b), 1)::DOUBLE AS tb FROM ord),
step(i, x, y, f) AS (SELECT 0::BIGINT, list_transform(range(10), lambda k: 0::BIGINT), list_transform(range(10), lambda k: 0::BIGINT), -1::BIGINT
 UNION ALL SELECT m.i, m.x, m.y, m.f FROM (SELECT arg_min({{'i': i, 'x': x2, 'y': y2, 'f': f}}, {{'e': round((list_aggregate(list_transform(x2, lambda v: v / ta), 'stddev_pop') + list_aggregate(list_transform(y2, lambda v: v / tb), 'stddev_pop')) / 2, 9), 's': x[f + 1] + y[f + 1], 'f': f}}) AS m
  FROM (SELECT o.i, q.f, s.x, s.y, ta, tb, list_transform(s.x, lambda v, j: (CASE WHEN j = q.f + 1 THEN v + o.a ELSE v END)::BIGINT) AS x2, list_transform(s.y, lambda v, j: (CASE WHEN j = q.f + 1 THEN v + o.b ELSE v END)::BIGINT) AS y2
   FROM step s JOIN ord o ON o.i = s.i + 1, range(10) q(f), tot)) WHERE m IS NOT NULL)"""
ORACLE["greedy_split"] = f"WITH RECURSIVE {_GREEDY} SELECT doc_id, label, step.f AS fold FROM folds JOIN ord USING (g) JOIN step USING (i)"
ORACLE["split_stats"] = f"WITH RECURSIVE {_SPLIT} SELECT split, count(*) AS records, count_if(label = 1)::BIGINT AS positives, count(DISTINCT g) AS groups, count_if(label = 1)::DOUBLE / count(*) AS positive_rate FROM folds GROUP BY split"
ORACLE["split_by_source"] = f"WITH RECURSIVE {_SPLIT} SELECT split, source, count(*) AS records, count_if(label = 1)::BIGINT AS positives FROM folds GROUP BY 1, 2"
ORACLE["split_leakage_check"] = f"WITH RECURSIVE {_SPLIT} SELECT count(*) AS groups_in_several_splits FROM (SELECT g FROM folds GROUP BY g HAVING count(DISTINCT split) > 1)"
ORACLE["author_overlap"] = """WITH r AS (SELECT DISTINCT CASE event_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS s, trim(user_id::VARCHAR) AS a FROM events WHERE user_id IS NOT NULL),
tr AS (SELECT a FROM r WHERE s = 'train'), va AS (SELECT a FROM r WHERE s = 'val'), te AS (SELECT a FROM r WHERE s = 'test'),
c AS (SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM va) AS n_val, (SELECT count(*) FROM te) AS n_test, (SELECT count(*) FROM tr JOIN va USING (a)) AS train_val, (SELECT count(*) FROM tr JOIN te USING (a)) AS train_test, (SELECT count(*) FROM va JOIN te USING (a)) AS val_test)
SELECT *, train_val::DOUBLE / greatest(n_val, 1) * 100 AS pct_train_val, train_test::DOUBLE / greatest(n_test, 1) * 100 AS pct_train_test, val_test::DOUBLE / greatest(least(n_val, n_test), 1) * 100 AS pct_val_test FROM c"""
_OPENT = rf"""list_filter(list_transform(regexp_extract_all(text, '\S+'), lambda t, i: {{'i': i, 't': t}}), lambda x: NOT (regexp_matches(x.t, '(?i)https?://|www[.]') OR regexp_matches(x.t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}') OR regexp_matches(x.t, '^[@#].')
 OR length(regexp_replace(x.t, '[^\p{{L}}\p{{N}}]', '', 'g')) < 4 OR NOT regexp_matches(regexp_replace(x.t, '[^\p{{L}}\p{{N}}]', '', 'g'), '[^0-9]')))"""
ORACLE["eligible_tokens"] = f"WITH e AS (SELECT doc_id, {_OPENT} AS e FROM documents) SELECT doc_id, len(e) AS n_eligible, sha256(array_to_string(list_transform(e, lambda x: x.i || ':' || x.t), ' ')) AS digest FROM e"
ORACLE["protected_spans"] = r"""WITH s AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(text, '(?i)https?://\S+|www[.]\S+'), regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')), list_filter(regexp_extract_all(text, '\S+'), lambda x: regexp_matches(x, '^[@#].'))) AS s FROM documents)
SELECT doc_id, len(s) AS n_spans, array_to_string(s, ' ') AS spans FROM s"""


def _changed(n: int) -> str:
    """Rows doc_id, severity, text, out, changes of a family: tokens, gaps and
    characters unnested, ranked by window functions and aggregated again."""
    family = O.FAMILIES[n]
    alnum = r"regexp_matches({}, '[\p{{L}}\p{{N}}]')".format
    key = lambda more: f"md5(concat_ws('|', '{O.SEED}', k.doc_id, '{family}', k.severity, {more}))"
    few = "CASE WHEN k.severity = 'MILD' THEN 1 ELSE 2 END"
    ready = f" AND regexp_matches(t.t, '[{O.DIGIT_FROM}]')" if n == 0 else ""
    dig, look = f"contains('{O.DIGIT_FROM}', c)", f"contains('{O.LOOKALIKE_FROM}', c)"
    both = f"{alnum('c')} AND {alnum('prev')}"
    rank = {0: f"CASE WHEN {dig} THEN 0 END", 1: f"CASE WHEN p > 1 AND p < n AND {both} THEN 0 END", 2: f"CASE WHEN p > 1 AND {both} THEN 0 END", 3: f"CASE WHEN {look} THEN 0 WHEN lower(c) IN ('a', 'e', 'i', 'o', 'u') THEN 1 WHEN p > 1 AND p < n AND {alnum('c')} THEN 2 END"}[n]
    coin = f"len(list_filter(string_split(k.t, ''), lambda y: {alnum('y')})) >= 5 AND substr({key('k.i, ' + chr(39) + 'coin' + chr(39))}, 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7')"
    new = {0: f"translate(c, '{O.DIGIT_FROM}', '{O.DIGIT_TO}')", 1: "CASE WHEN coin THEN '' ELSE c || c END", 2: "' ' || c", 3: f"CASE WHEN rk = 0 THEN translate(c, '{O.LOOKALIKE_FROM}', '{O.LOOKALIKE_TO}') ELSE c || c END"}[n]
    many = "CASE WHEN severity = 'MILD' THEN 1 ELSE 2 END" if n == 0 else "1"
    return rf"""WITH r AS (SELECT doc_id, text, unnest(['MILD', 'STRONG']) AS severity FROM documents),
open AS (SELECT doc_id, severity, unnest({_OPENT}) AS t FROM r),
k AS (SELECT k.doc_id, k.severity, t.i AS i, t.t AS t FROM open k WHERE true{ready} QUALIFY row_number() OVER (PARTITION BY k.doc_id, k.severity ORDER BY {key("t.i")}) <= {few}),
ch AS (SELECT k.doc_id, k.severity, k.i, p, substr(k.t, p, 1) AS c, CASE WHEN p > 1 THEN substr(k.t, p - 1, 1) ELSE '' END AS prev, length(k.t) AS n, {key("k.i, p")} AS h, {coin} AS coin FROM k, range(1, length(k.t) + 1) q(p)),
rk AS (SELECT *, {rank} AS rk FROM ch), best AS (SELECT *, CASE WHEN rk IS NOT NULL AND rk = min(rk) OVER (PARTITION BY doc_id, severity, i) THEN row_number() OVER (PARTITION BY doc_id, severity, i ORDER BY rk NULLS LAST, h) END AS o FROM rk),
tok AS (SELECT doc_id, severity, i, string_agg(CASE WHEN o <= {many} THEN {new} ELSE c END, '' ORDER BY p) AS w, count_if(o <= {many}) AS m FROM best GROUP BY ALL HAVING count_if(o <= {many}) > 0),
full_t AS (SELECT doc_id, text, severity, unnest(regexp_extract_all(text, '(\s*)(\S+)', 1)) AS g, unnest(regexp_extract_all(text, '(\s*)(\S+)', 2)) AS t, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS i FROM r),
made AS (SELECT f.doc_id, f.severity, string_agg(f.g || coalesce(tok.w, f.t), '' ORDER BY f.i) AS body, count(tok.w) AS changes, sum(tok.m) AS edits FROM full_t f LEFT JOIN tok ON tok.doc_id = f.doc_id AND tok.severity = f.severity AND tok.i = f.i GROUP BY ALL),
done AS (SELECT r.doc_id, r.severity, r.text, coalesce(body, '') || regexp_extract(r.text, '(\s*)$', 1) AS out, coalesce(changes, 0)::BIGINT AS changes, coalesce(edits, 0)::BIGINT AS edits FROM r LEFT JOIN made ON made.doc_id = r.doc_id AND made.severity = r.severity)"""


for _n in range(4):
    ORACLE[f"obfuscate_o{_n + 1}"] = _changed(_n) + " SELECT doc_id, severity, sha256(out) AS digest, changes AS modified_token_count, out <> text AS changed FROM done"
_BACK = f"translate(out, '{O.LOOKALIKE_TO}', '{O.LOOKALIKE_FROM}')"
ORACLE["homoglyph_normalize"] = _changed(3) + f" SELECT doc_id, severity, sha256({_BACK}) AS digest, {_BACK} = text AS restored FROM done"
_four = " UNION ALL ".join(f"SELECT '{O.FAMILIES[n]}' AS family, * FROM ({_changed(n)} SELECT severity, text, out, edits FROM done)" for n in range(4))
ORACLE["obfuscation_stats"] = f"""SELECT family, severity, count(*) AS n, count_if(out <> text)::BIGINT AS n_changed, count_if(out = text)::BIGINT AS n_no_target, round(count_if(out <> text)::DOUBLE / count(*) * 100, 2) AS success_rate_pct, count_if(out <> text)::DOUBLE / count(*) * 100 >= 90 AS passes_gate FROM ({_four}) GROUP BY 1, 2"""
_figures = ", ".join(f"{f}({x}){kind} AS {name}_{c}" for c, x in (("edits", "edits"), ("ratio", "ratio"), ("delta", "abs(length(out) - length(text))")) for name, f, kind in (("mean", "avg", ""), ("median", "median", "::DOUBLE"), ("max", "max", "")))
ORACLE["edit_diagnostics"] = f"""SELECT family, severity, count(*) AS changed_count, {_figures}, count_if(ratio > CASE severity WHEN 'MILD' THEN 0.20::DOUBLE ELSE 0.35::DOUBLE END)::BIGINT AS excessive_ratio_flags,
 count_if(length(out)::DOUBLE / greatest(length(text), 1) NOT BETWEEN 0.5 AND 2.0)::BIGINT AS length_anomalies FROM (SELECT *, edits::DOUBLE / greatest(length(text), 1) AS ratio FROM ({_four}) WHERE out <> text) GROUP BY 1, 2"""
_num = lambda s: f"(('0x' || substr(md5({s}), 1, 4))::BIGINT % 100)"
_PRED = f"""p0 AS (SELECT doc_id, source, toxic::BIGINT AS y, model, condition FROM documents JOIN labels USING (doc_id), (VALUES ('svm'), ('cnn'), ('bert')) m(model), (SELECT f || '_' || s AS condition FROM (VALUES ('O1'), ('O2'), ('O3'), ('O4')) a(f), (VALUES ('MILD'), ('STRONG')) b(s)) c),
p1 AS (SELECT *, ((y + CASE WHEN {_num("'n' || doc_id || model")} < 6 THEN 1 ELSE 0 END) % 2)::BIGINT AS y_norm FROM p0),
pred AS (SELECT *, ((y_norm + CASE WHEN {_num("'o' || doc_id || model || condition")} < 9 THEN 1 ELSE 0 END) % 2)::BIGINT AS y_obf, {_num("'c' || doc_id || condition")} < 96 AS changed FROM p1)"""


def subword_sql(rows: str, clean: str, by: str, pieces: int = 4000) -> str:
    """Statistics of ``rows`` (by, doc_id, w) against the parts of the words of
    ``clean`` (w): the longest piece at each place is a table, and words are
    walked along it."""
    return f"""rw AS ({rows}), cw AS (SELECT w, count(*) AS n FROM ({clean}) WHERE w <> '' GROUP BY w HAVING count(*) >= 2),
parts AS (SELECT n, substr(w, 1, k::INT) AS p FROM cw, range(1, 9) r(k) WHERE k <= length(w) UNION ALL SELECT n, '##' || substr(w, i::INT, k::INT) FROM cw, range(2, length(w) + 1) s(i), range(1, 7) r(k) WHERE i + k - 1 <= length(w)),
voc AS (SELECT p FROM parts GROUP BY p ORDER BY sum(n) DESC, p LIMIT {pieces}), dw AS (SELECT DISTINCT w FROM rw),
here AS (SELECT w, i, max(k) AS k FROM (SELECT w, i, k, CASE WHEN i > 1 THEN '##' ELSE '' END || substr(w, i::INT, k::INT) AS p FROM dw, range(1, length(w) + 1) s(i), range(1, 9) r(k) WHERE i + k - 1 <= length(w)) JOIN voc USING (p) GROUP BY w, i),
walk(w, pos, t) AS (SELECT w, 1::BIGINT, 0::BIGINT FROM dw UNION ALL SELECT walk.w, pos + k, t + 1 FROM walk JOIN here ON here.w = walk.w AND here.i = pos),
done AS (SELECT dw.w, t, t IS NULL AS unk FROM dw LEFT JOIN (SELECT w, t FROM walk WHERE pos = length(w) + 1) USING (w)),
per AS (SELECT {by}, doc_id, sum(coalesce(t, 1))::BIGINT AS tokens, count_if(unk)::BIGINT AS unknown, sum(greatest(coalesce(t, 1) - 1, 0))::BIGINT AS continuations FROM rw JOIN done USING (w) GROUP BY {by}, doc_id),
fin AS (SELECT {by}, count(*) AS documents, sum(tokens)::BIGINT AS tokens, sum(unknown)::BIGINT AS unknown, sum(continuations)::BIGINT AS continuations, count_if(unknown > 0)::BIGINT AS documents_with_unknown FROM per GROUP BY {by})
SELECT *, tokens::DOUBLE / documents AS tokens_a_document, documents_with_unknown * 100.0::DOUBLE / documents AS pct_with_unknown FROM fin"""


def _cells(p: str, suffix: str = "") -> str:
    return ", ".join(f"count_if(y = {a} AND {p} = {b})::BIGINT AS {k}{suffix}" for k, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))


def _figs(s: str = "") -> str:
    z = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END"
    f1, f0 = z(f"2 * tp{s}", f"2 * tp{s} + fp{s} + fn{s}"), z(f"2 * tn{s}", f"2 * tn{s} + fp{s} + fn{s}")
    return f"{z(f'tp{s}', f'tp{s} + fp{s}')} AS precision{s}, {z(f'tp{s}', f'tp{s} + fn{s}')} AS recall{s}, {f1} AS f1{s}, {z(f'tp{s} + tn{s}', f'tp{s} + tn{s} + fp{s} + fn{s}')} AS accuracy{s}, ({f1} + {f0}) / 2 AS macro_f1{s}"


ORACLE["confusion_metrics"] = f"WITH {_PRED}, c AS (SELECT model, condition, {_cells('y_obf')} FROM pred GROUP BY 1, 2) SELECT *, {_figs()} FROM c"
ORACLE["normal_metrics"] = f"WITH {_PRED}, c AS (SELECT model, {_cells('y_norm')} FROM pred WHERE condition = 'O1_MILD' GROUP BY 1) SELECT *, {_figs()} FROM c"
_PAIRED = f"""{_PRED}, c AS (SELECT model, condition, count(*) AS n_changed_pairs, {_cells('y_norm', '_norm')}, {_cells('y_obf', '_obf')} FROM pred WHERE changed GROUP BY 1, 2), q AS (SELECT *, {_figs('_norm')}, {_figs('_obf')} FROM c),
paired AS (SELECT *, f1_norm - f1_obf AS f1_drop, (f1_norm - f1_obf) / nullif(f1_norm, 0) * 100 AS relative_drop_pct, f1_obf / nullif(f1_norm, 0) * 100 AS retention_pct FROM q)"""
ORACLE["paired_robustness"] = f"WITH {_PAIRED} SELECT * FROM paired"
ORACLE["flip_summary"] = f"""WITH {_PRED}, c AS (SELECT model, condition, count(*) AS n_changed_pairs, count_if(y = 1 AND y_norm = 1)::BIGINT AS n_tp_normal, count_if(y = 1 AND y_norm = 1 AND y_obf = 0)::BIGINT AS evasion, count_if(y = 1 AND y_norm = 0 AND y_obf = 1)::BIGINT AS recovery,
 count_if(y = 0 AND y_norm = 0 AND y_obf = 1)::BIGINT AS new_fp, count_if(y_norm <> y_obf)::BIGINT AS total_flips FROM pred WHERE changed GROUP BY 1, 2) SELECT *, coalesce((evasion * 100)::DOUBLE / nullif(n_tp_normal, 0), 0.0) AS evasion_rate_pct FROM c"""
ORACLE["source_stratified"] = f"WITH {_PRED}, c AS (SELECT model, condition, source, {_cells('y_obf')} FROM pred WHERE changed GROUP BY 1, 2, 3) SELECT *, {_figs()} FROM c"
ORACLE["error_rows"] = f"WITH {_PRED} SELECT model, condition, doc_id, y, y_norm, y_obf FROM pred WHERE changed AND (y_obf <> y OR y_norm <> y_obf)"
ORACLE["robustness_pivot"] = f"WITH {_PAIRED} SELECT model, " + ", ".join(f"avg(f1_drop) FILTER (substr(condition, 1, 2) = 'O{i}') AS drop_o{i}" for i in (1, 2, 3, 4)) + " FROM paired GROUP BY model"
ORACLE["winner_per_condition"] = f"WITH {_PAIRED} SELECT condition, model AS winner, f1_obf AS f1 FROM paired QUALIFY row_number() OVER (PARTITION BY condition ORDER BY f1_obf DESC, model DESC) = 1"
ORACLE["model_ranks"] = f"WITH {_PAIRED}, m AS (SELECT model, avg(f1_drop) AS mean_drop, avg(retention_pct) AS mean_retention FROM paired GROUP BY model) SELECT *, rank() OVER (ORDER BY mean_drop) AS drop_rank FROM m"
ORACLE["class_weights"] = "SELECT toxic::BIGINT AS toxic, count(*) AS n_class, (SELECT count(*) FROM labels)::DOUBLE / (2 * count(*)) AS weight FROM labels GROUP BY 1"
ORACLE["tfidf_terms"] = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, round(ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + count(DISTINCT doc_id))) + 1, 9) AS idf FROM w GROUP BY term"""
ORACLE["best_candidate"] = f"WITH {_PRED}, c AS (SELECT model, condition, {_cells('y_obf')} FROM pred GROUP BY 1, 2), m AS (SELECT *, {_figs()} FROM c) SELECT condition, model AS best_model FROM m QUALIFY row_number() OVER (PARTITION BY condition ORDER BY round(f1, 9) DESC, round(precision, 9) DESC, round(recall, 9) DESC, model DESC) = 1"
ORACLE["running_best"] = """WITH d AS (SELECT ts::DATE AS day, max(value) AS value FROM events GROUP BY 1), b AS (SELECT *, max(value) OVER (ORDER BY day) AS best, row_number() OVER (ORDER BY day) AS step FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, value, best AS best_so_far, value = best AS is_best, step - max(CASE WHEN value = best THEN step END) OVER (ORDER BY day) AS steps_since FROM b"""
ORACLE["char_encode"] = """WITH c AS (SELECT doc_id, list_transform(list_filter(string_split(substr(text, 1, 576), ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN unicode(c) - 30 ELSE 1 END) AS x FROM documents)
SELECT doc_id, greatest(len(x), 1) AS n, sha256(array_to_string(list_resize(x, 576, 0), ' ')) AS digest FROM c"""
ORACLE["oov_stats"] = r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[^ \t\n]+')) AS w FROM documents), k AS (SELECT w FROM (SELECT DISTINCT doc_id, w FROM w WHERE lang = 'en') GROUP BY w HAVING count(*) >= 2),
d AS (SELECT doc_id, lang, count(*) AS tokens, count_if(k.w IS NULL) AS unk FROM w LEFT JOIN k USING (w) GROUP BY 1, 2)
SELECT lang, sum(tokens)::BIGINT AS total_tokens, avg(tokens) AS avg_tokens, sum(unk)::BIGINT AS unk_tokens, avg(CASE WHEN unk > 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_docs_with_unk FROM d GROUP BY lang"""
ORACLE["expectations"] = f"""WITH RECURSIVE {_SPLIT} SELECT 'ids_unique' AS "check", count(*) AS violations FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'text_not_null', count(*) FROM documents WHERE text IS NULL UNION ALL SELECT 'labels_in_domain', count(*) FROM labels WHERE toxic NOT IN (0, 1) OR quality NOT IN (0, 1)
UNION ALL SELECT 'labels_have_documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'representatives_unique', 0
UNION ALL SELECT 'groups_in_one_split', count(*) FROM (SELECT g FROM folds GROUP BY g HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'length_column_right', count(*) FROM documents WHERE length(text) <> n_chars"""
ORACLE["star_join_revenue"] = "SELECT n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
