"""DuckDB SQL of the queries, from shared common table expressions."""

from __future__ import annotations

import re

from ..functions.roles import N_ROLES, ROLES
from ..operators.features import CHAR_EDGES, DIGIT, TOKEN_EDGES


def _names(mask: str, alphabetic: bool = False) -> str:
    order = sorted(range(N_ROLES), key=ROLES.__getitem__) if alphabetic else range(N_ROLES)
    return "concat_ws('+', " + ", ".join(f"CASE WHEN ({mask} >> {r}) & 1 = 1 THEN '{ROLES[r]}' END" for r in order) + ")"


def _name(index: str) -> str:
    return "[" + ", ".join(f"'{r}'" for r in ROLES) + f"][({index}) + 1]"


def _p(system: int, unit: str, role: str) -> str:
    return f"(case_id * 31 + {unit} * 17 + {role} * (7 + case_id % 5) * 13 + {system * 101}) % 1000"


def _pred(system: int, unit: str) -> str:
    return "[" + ", ".join(_p(system, unit, str(r)) for r in range(N_ROLES)) + "]"


def _bucket(value: str, edges: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {e} THEN '<{e}'" for e in edges) + f" ELSE '>={edges[-1]}' END"


def _decode(t: int) -> str:
    bits = " | ".join(f"(CASE WHEN p[{r + 1}] >= {t} THEN {1 << r}::BIGINT ELSE 0 END)" for r in range(N_ROLES))
    return f"CASE WHEN ({bits}) = 0 THEN (1::BIGINT << (list_position(p, list_max(p)) - 1)) ELSE ({bits}) END"


F1 = "CASE WHEN bit_count(gold) + bit_count(pred) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * bit_count(gold & pred) / (bit_count(gold) + bit_count(pred)) END"
_tp, _fp, _fn = ([f"count(*) FILTER ((({g} >> {r}) & 1) = 1)" for r in range(N_ROLES)] for g in ("(gold & pred)", "(pred & ~gold)", "(gold & ~pred)"))
_f1 = lambda tp, fp, fn: f"(CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {tp} / (2 * {tp} + {fp} + {fn}) END)"
MACRO = "(" + " + ".join(_f1(a, b, c) for a, b, c in zip(_tp, _fp, _fn, strict=True)) + ") / 9"
MICRO = _f1("(" + " + ".join(_tp) + ")", "(" + " + ".join(_fp) + ")", "(" + " + ".join(_fn) + ")")
SUMMARY = f"count(*)::BIGINT AS n, round(avg({F1}), 6) AS set_f1, round({MACRO}, 6) AS macro_f1, round({MICRO}, 6) AS micro_f1, round(avg((gold = pred)::INT::DOUBLE), 6) AS exact"
SPLIT = "CASE WHEN case_id % 10 < 7 THEN 'train' WHEN case_id % 10 = 7 THEN 'val' ELSE 'test' END"

CTE: dict[str, str] = {
    "d": "SELECT doc_id AS case_id, text, n_chars FROM documents WHERE n_chars > 0",
    "base": "SELECT case_id, text, n_chars, k, (case_id * 37 + k * 101) % n_chars AS b, (case_id + k * k) % 9 AS r FROM d, (SELECT unnest(range(12)) AS k)",
    "base2": "SELECT *, least(n_chars, b + 20 + (case_id * 13 + k * 29) % 200) AS e FROM base",
    "fam": """SELECT case_id, text, k, b, e, r AS label, CASE WHEN k = 11 THEN 'entity' ELSE 'rhetorical' END AS kind FROM base2
        UNION ALL SELECT case_id, text, k, b, e, (r + 1) % 9, 'rhetorical' FROM base2 WHERE k % 4 = 0
        UNION ALL SELECT case_id, text, k, b + 3, e, r, 'rhetorical' FROM base2 WHERE k % 4 = 1 AND e - b > 30
        UNION ALL SELECT case_id, text, k, b + 10, e - 10, (r + 2) % 9, 'rhetorical' FROM base2 WHERE k % 4 = 2 AND e - b > 40
        UNION ALL SELECT case_id, text, k, b, least(n_chars, b + 3), r, 'rhetorical' FROM base2 WHERE k % 6 = 5""",
    "spans": r"SELECT case_id, b, e, label, kind, (case_id + k) % 4 AS prov, regexp_matches(substring(text, b + 1, e - b), '[\p{L}\p{Nl}\p{No}]') AS letter, NOT regexp_matches(substring(text, b + 1, e - b), '[^\s\x{0b}\x{85}\x{a0}\x{2028}\x{2029}]') AS blank FROM fam",
    "ok": "SELECT * FROM spans WHERE NOT (kind = 'rhetorical' AND (e - b < 5 OR NOT letter))",
    "rk": "SELECT DISTINCT case_id, label, b, e FROM ok WHERE kind = 'rhetorical'",
    "gone": """SELECT case_id, label, b, e, kept_b, kept_e FROM (SELECT i.case_id, i.label, i.b, i.e, o.b AS kept_b, o.e AS kept_e,
        row_number() OVER (PARTITION BY i.case_id, i.label, i.b, i.e ORDER BY o.b, o.e DESC) AS rn FROM rk i JOIN rk o ON i.case_id = o.case_id AND i.label = o.label
        AND o.b <= i.b AND i.e <= o.e AND (o.b <> i.b OR o.e <> i.e) AND (o.e - o.b) - (i.e - i.b) <= 20) WHERE rn = 1""",
    "norm": "SELECT ok.* FROM ok LEFT JOIN gone g ON ok.case_id = g.case_id AND ok.label = g.label AND ok.b = g.b AND ok.e = g.e WHERE ok.kind <> 'rhetorical' OR g.case_id IS NULL",
    "regions": "SELECT case_id, b, e, bit_or(1::BIGINT << label) AS mask, row_number() OVER (PARTITION BY case_id ORDER BY b, e) - 1 AS region_idx FROM norm WHERE kind = 'rhetorical' GROUP BY case_id, b, e",
    "nest": "SELECT a.case_id, a.region_idx AS i, c.region_idx AS j, (a.mask & c.mask) <> 0 AS same_role FROM regions a JOIN regions c ON a.case_id = c.case_id AND a.b <= c.b AND c.e <= a.e AND (a.b <> c.b OR a.e <> c.e)",
    "crossing": "SELECT a.case_id, least(a.region_idx, c.region_idx) AS i, greatest(a.region_idx, c.region_idx) AS j FROM regions a JOIN regions c ON a.case_id = c.case_id AND a.b < c.b AND c.b < a.e AND a.e < c.e",
    "roled": """SELECT r.*, o.case_id IS NOT NULL OR n.case_id IS NOT NULL AS is_nested, CASE WHEN o.case_id IS NOT NULL AND n.case_id IS NOT NULL THEN 'both' WHEN o.case_id IS NOT NULL THEN 'outer' WHEN n.case_id IS NOT NULL THEN 'inner' ELSE 'none' END AS nesting_role
        FROM regions r LEFT JOIN (SELECT DISTINCT case_id, i FROM nest) o ON r.case_id = o.case_id AND r.region_idx = o.i LEFT JOIN (SELECT DISTINCT case_id, j FROM nest) n ON r.case_id = n.case_id AND r.region_idx = n.j""",
    "cut": r"SELECT case_id, string_split(regexp_replace(regexp_replace(text, '(\r?\n[ \t\x{a0}\x{200f}\x{200e}]*\r?\n)', chr(1) || '\1' || chr(1), 'g'), '([.؟?!]+)(\s|\x01|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM d",
    "piece": r"SELECT case_id, i, length(s) AS n, length(s) - length(regexp_replace(s, '^\s+', '')) AS l, length(regexp_replace(s, '\s+$', '')) AS r, regexp_matches(s, '[\p{L}\p{N}]') AS good FROM (SELECT case_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM cut)",
    "placed": "SELECT *, coalesce(sum(n) OVER (PARTITION BY case_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM piece",
    "sentences": "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY i) - 1 AS sent_idx, base + l AS b, base + r AS e FROM placed WHERE r > l AND good",
    "hits": "SELECT s.case_id, s.sent_idx, r.region_idx, r.b, r.e, greatest(s.b, r.b) AS cb, least(s.e, r.e) AS ce, r.mask FROM sentences s JOIN regions r ON s.case_id = r.case_id AND least(s.e, r.e) > greatest(s.b, r.b)",
    "cov": """SELECT case_id, sent_idx, role, sum(greatest(0, ce - greatest(cb, coalesce(prev, cb))))::BIGINT AS cov FROM (SELECT h.*, role, max(ce) OVER (PARTITION BY case_id, sent_idx, role ORDER BY cb, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM hits h, (SELECT unnest(range(9)) AS role) WHERE (mask >> role) & 1 = 1) GROUP BY case_id, sent_idx, role""",
    "decided": "SELECT case_id, sent_idx, bit_or(1::BIGINT << role) AS present, bit_or(1::BIGINT << role) FILTER (cov = mx) AS tied FROM (SELECT *, max(cov) OVER (PARTITION BY case_id, sent_idx) AS mx FROM cov) GROUP BY case_id, sent_idx",
    "amb": "SELECT h.*, tied FROM hits h JOIN decided USING (case_id, sent_idx) WHERE bit_count(tied) > 1",
    "one": "SELECT case_id, sent_idx, bool_or((mask & tied) = tied) AS one FROM amb GROUP BY 1, 2",
    "two": "SELECT DISTINCT a.case_id, a.sent_idx FROM amb a JOIN amb c ON a.case_id = c.case_id AND a.sent_idx = c.sent_idx AND a.region_idx < c.region_idx AND ((a.b <= c.b AND c.e <= a.e) OR (c.b <= a.b AND a.e <= c.e)) AND ((a.mask | c.mask) & a.tied) = a.tied",
    "projected": """SELECT s.*, CASE WHEN tied IS NULL THEN 'UNLABELED' WHEN bit_count(tied) = 1 THEN 'LABELED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN bit_count(tied) = 1 THEN log2(tied)::BIGINT END AS label,
        coalesce(present, 0) AS present, coalesce(tied, 0) AS tied, CASE WHEN one.one THEN 'co_extensive_multi_role' WHEN two.case_id IS NOT NULL THEN 'nested' WHEN one.case_id IS NOT NULL THEN 'other' END AS ambiguity_kind
        FROM sentences s LEFT JOIN decided USING (case_id, sent_idx) LEFT JOIN one USING (case_id, sent_idx) LEFT JOIN two USING (case_id, sent_idx)""",
    "s1": f"SELECT *, mask AS gold, {_pred(0, 'region_idx')} AS p, {_pred(1, 'region_idx')} AS q FROM roled",
    "s1p": f"SELECT *, {_decode(500)} AS pred FROM s1",
    "s1q": f"SELECT *, {_decode(500)} AS pred FROM (SELECT * EXCLUDE (p, q), q AS p FROM s1)",
    "s2": f"SELECT *, 1::BIGINT << label AS gold, {_pred(0, 'sent_idx')} AS p, {_pred(1, 'sent_idx')} AS q FROM projected WHERE status = 'LABELED'",
    "s2p": "SELECT *, 1::BIGINT << (list_position(p, list_max(p)) - 1) AS pred FROM s2",
    "s2q": "SELECT *, 1::BIGINT << (list_position(q, list_max(q)) - 1) AS pred FROM s2",
    "counts": "SELECT case_id, count(*) AS n_regions FROM regions GROUP BY case_id",
    "bounds": "SELECT l[(len(l) // 3 + 1)::BIGINT] AS b1, l[(2 * len(l) // 3 + 1)::BIGINT] AS b2 FROM (SELECT list_sort(list(n_regions)) AS l FROM counts)",
    "shw": r"SELECT case_id, sha256(text) AS sha, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM d",
    "once": "SELECT w.case_id, w.w FROM shw w JOIN (SELECT sha, min(case_id) AS case_id FROM shw GROUP BY sha) m ON w.case_id = m.case_id",
    "sh": "SELECT DISTINCT case_id, array_to_string(w[i:i + 7], ' ') AS sh FROM (SELECT case_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM once)",
    "shn": "SELECT case_id, count(*) AS size FROM sh GROUP BY case_id",
    "pairs": """SELECT a, b, inter, na.size AS na, nb.size AS nb, inter::DOUBLE / (na.size + nb.size - inter) AS jac, inter::DOUBLE / least(na.size, nb.size) AS cont
        FROM (SELECT x.case_id AS a, y.case_id AS b, count(*) AS inter FROM sh x JOIN sh y ON x.sh = y.sh AND x.case_id < y.case_id GROUP BY 1, 2) p JOIN shn na ON p.a = na.case_id JOIN shn nb ON p.b = nb.case_id""",
    "linked": "SELECT * FROM pairs WHERE jac >= 0.2 OR cont >= 0.5",
    "edges": "SELECT a, b FROM linked UNION SELECT b, a FROM linked UNION SELECT case_id, m FROM (SELECT case_id, min(case_id) OVER (PARTITION BY sha) AS m FROM shw) WHERE case_id <> m UNION SELECT m, case_id FROM (SELECT case_id, min(case_id) OVER (PARTITION BY sha) AS m FROM shw) WHERE case_id <> m",
    "weights": "SELECT rep, idx, count(*) AS k FROM (SELECT rep, (('0x' || substr(md5(concat('13:', rep, ':', slot)), 1, 8))::BIGINT) % (SELECT count(*) FROM docidx) AS idx FROM (SELECT unnest(range(100)) AS rep) r, (SELECT unnest(range((SELECT count(*) FROM docidx))) AS slot) s) GROUP BY 1, 2",
    "sent_text": "SELECT s.*, substring(d.text, s.b + 1, s.e - s.b) AS text FROM sentences s JOIN d USING (case_id)",
    "sw": r"SELECT *, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w, count(*) OVER (PARTITION BY case_id) AS n FROM sent_text",
}


def sql(final: str, recursive: str = "") -> str:
    """The query with the expressions that it needs, in order."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+\(*\s*([a-z_0-9]+)\b", text):
            if name in CTE and name not in needed:
                need(CTE[name])
                needed.append(name)

    need(final + " " + recursive)
    body = [f"{n} AS ({CTE[n]})" for n in needed if not re.search(rf"\b{n} AS \(", recursive)] + ([recursive] if recursive else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(body) + "\n" if body else "") + final


def _interval(stats: str, value: str) -> str:
    sums = "SELECT case_id, sum(n) AS n, sum(total) AS total, sum(total_b) AS total_b FROM " + f"({stats}) GROUP BY case_id"
    recursive = f"""d0 AS ({sums}), docidx AS (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS idx FROM d0), weights AS ({CTE["weights"]}),
        reps AS (SELECT rep, sum(k * n) AS n, sum(k * total) AS total, sum(k * total_b) AS total_b FROM d0 JOIN docidx USING (case_id) JOIN weights USING (idx) GROUP BY rep)"""
    final = f"SELECT (SELECT round({value}, 6) FROM (SELECT sum(n) AS n, sum(total) AS total, sum(total_b) AS total_b FROM d0)) AS point, round(quantile_cont({value}, 0.025), 6) AS ci_low, round(quantile_cont({value}, 0.975), 6) AS ci_high, (SELECT count(*) FROM d0) AS n_documents FROM reps"
    return sql(final, recursive)


S2SUM = "SELECT case_id, 1 AS n, (gold = pred)::INT::DOUBLE AS total, 0.0::DOUBLE AS total_b FROM s2p"
PAIR = f"SELECT x.case_id, 1 AS n, x.f AS total, y.f AS total_b FROM (SELECT case_id, region_idx, {F1} AS f FROM s1p) x JOIN (SELECT case_id, region_idx, {F1} AS f FROM s1q) y USING (case_id, region_idx)"

ORACLES: dict[str, str] = {
    "grid_sentences": sql("SELECT case_id, sent_idx, b AS span_begin, e AS span_end FROM sentences"),
    "grid_fingerprint": sql("SELECT sum(('0x' || substr(h, 1, 8))::BIGINT)::BIGINT AS sum_1, sum(('0x' || substr(h, 9, 8))::BIGINT)::BIGINT AS sum_2, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_sentences FROM (SELECT sha256(string_agg(b || ',' || e, ';' ORDER BY sent_idx)) AS h, count(*) AS n FROM sentences GROUP BY case_id)"),
    "grid_size": sql("SELECT case_id, max(sent_idx) + 1 AS grid_n FROM sentences GROUP BY case_id"),
    "doc_sha_dups": "SELECT sha256(text) AS text_sha256, count(*)::BIGINT AS n_docs, min(doc_id) AS min_case_id FROM documents WHERE n_chars > 0 GROUP BY 1 HAVING count(*) > 1",
    "span_kind_filter": sql("SELECT label AS label_idx, count(*)::BIGINT AS n FROM spans WHERE kind = 'rhetorical' GROUP BY label"),
    "norm_r1": sql("SELECT case_id, b AS span_begin, e AS span_end, label, kind, count(*)::BIGINT AS n FROM ok GROUP BY ALL"),
    "norm_r2": sql("SELECT case_id, b AS span_begin, e AS span_end, label, kind, count(*)::BIGINT AS n FROM norm GROUP BY ALL"),
    "norm_log": sql("SELECT case_id, label, b AS span_begin, e AS span_end, kept_b, kept_e FROM gone"),
    "norm_summary": sql("SELECT (SELECT count(*) FROM spans)::BIGINT AS rows_before, (SELECT count(*) FROM norm)::BIGINT AS rows_after, ((SELECT count(*) FROM spans) - (SELECT count(*) FROM ok))::BIGINT AS r1, ((SELECT count(*) FROM ok) - (SELECT count(*) FROM norm))::BIGINT AS r2"),
    "regions": sql(f"SELECT case_id, region_idx, b AS span_begin, e AS span_end, {_names('mask', True)} AS labels, bit_count(mask)::BIGINT AS n_labels FROM regions"),
    "nesting_pairs": sql("SELECT case_id, i, j FROM nest"),
    "crossing_pairs": sql("SELECT case_id, i, j FROM crossing"),
    "same_role_nesting": sql("SELECT case_id, i, j FROM nest WHERE same_role"),
    "nesting_role": sql("SELECT case_id, region_idx, is_nested, nesting_role FROM roled"),
    "role_coverage": sql(f"SELECT case_id, sent_idx, {_name('role')} AS role, cov FROM cov"),
    "projection": sql(f"SELECT case_id, sent_idx, status, {_name('label')} AS label, {_names('present')} AS roles, {_names('tied')} AS max_roles, ambiguity_kind FROM projected"),
    "projection_stats": sql("SELECT section, name, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY section), 2) AS pct FROM (SELECT 'status' AS section, status AS name FROM projected UNION ALL SELECT 'kind', ambiguity_kind FROM projected UNION ALL SELECT 'label', label::VARCHAR FROM projected) WHERE name IS NOT NULL GROUP BY section, name"),
    "s1_rows": sql(f"SELECT case_id || ':' || r.b || '-' || r.e AS id, {SPLIT} AS split, sha256(substring(d.text, r.b + 1, r.e - r.b)) AS text_sha, {_names('mask', True)} AS labels, bit_count(mask) > 1 AS is_multi, nesting_role FROM roled r JOIN d USING (case_id)"),
    "s2_rows": sql(f"SELECT printf('%d:s%04d', case_id, sent_idx) AS id, {SPLIT} AS split, sha256(substring(d.text, p.b + 1, p.e - p.b)) AS text_sha, status, {_name('label')} AS label, ambiguity_kind FROM projected p JOIN d USING (case_id)"),
    "s1_summary": sql(f"SELECT {SPLIT} AS split, count(DISTINCT case_id)::BIGINT AS n_docs, count(*)::BIGINT AS n, count(*) FILTER (bit_count(mask) > 1)::BIGINT AS n_multi, round(100.0::DOUBLE * count(*) FILTER (bit_count(mask) > 1) / count(*), 2) AS pct_multi, count(*) FILTER (is_nested)::BIGINT AS n_nested FROM roled GROUP BY 1"),
    "s2_summary": sql(f"SELECT {SPLIT} AS split, count(DISTINCT case_id)::BIGINT AS n_docs, count(*)::BIGINT AS n, count(*) FILTER (status = 'LABELED')::BIGINT AS labeled, count(*) FILTER (status = 'AMBIGUOUS')::BIGINT AS ambiguous, count(*) FILTER (status = 'UNLABELED')::BIGINT AS unlabeled FROM projected GROUP BY 1"),
    "validate": sql("""SELECT case_id, code, count(*)::BIGINT AS n FROM (SELECT s.case_id, unnest(['bad_offsets', 'blank_slice', 'other_kind']) AS code, unnest([NOT (s.b >= 0 AND s.b < s.e AND s.e <= n_chars), s.b >= 0 AND s.b < s.e AND s.e <= n_chars AND blank, kind <> 'rhetorical']) AS hit FROM spans s JOIN d USING (case_id)) WHERE hit GROUP BY 1, 2
        UNION ALL SELECT case_id, 'duplicate_rows', sum(c - 1)::BIGINT FROM (SELECT case_id, count(*) AS c FROM spans WHERE kind = 'rhetorical' GROUP BY case_id, b, e, label) WHERE c > 1 GROUP BY case_id
        UNION ALL SELECT case_id, 'text_len', 1 FROM d WHERE n_chars <> length(text)"""),
    "provenance": sql("SELECT CASE WHEN unreviewed THEN 'unreviewed' WHEN un THEN 'union' WHEN missing THEN 'missing' ELSE 'reviewed' END AS class, count(*)::BIGINT AS n FROM (SELECT count(DISTINCT label) AS k, bool_or(prov = 0) AS unreviewed, bool_or(prov = 3) AS missing, bool_or(prov = 2) AS un FROM spans WHERE kind = 'rhetorical' GROUP BY case_id, b, e) WHERE k > 1 GROUP BY 1"),
    "audit_sizes": sql("SELECT (SELECT count(*) FROM d)::BIGINT AS n_docs, (SELECT count(*) FROM spans)::BIGINT AS n_rows, (SELECT count(*) FROM regions)::BIGINT AS n_regions, (SELECT count(*) FROM regions WHERE bit_count(mask) > 1)::BIGINT AS n_multi, (SELECT count(DISTINCT case_id) FROM crossing)::BIGINT AS docs_crossing"),
    "audit_roles": sql("SELECT label AS label_idx, count(*)::BIGINT AS n_rows, count(DISTINCT (case_id, b, e))::BIGINT AS n_regions, count(DISTINCT case_id)::BIGINT AS n_docs FROM norm WHERE kind = 'rhetorical' GROUP BY label"),
    "audit_multi": sql("SELECT CASE WHEN bit_count(mask) > 3 THEN '>3' ELSE bit_count(mask)::VARCHAR END AS k, count(*)::BIGINT AS n, count(DISTINCT case_id)::BIGINT AS n_docs FROM regions GROUP BY 1"),
    "audit_combos": sql(f"SELECT {_names('mask', True)} AS labels, n FROM (SELECT mask, count(*)::BIGINT AS n, min(case_id * 1000000 + region_idx) AS first FROM regions WHERE bit_count(mask) > 1 GROUP BY mask) ORDER BY n DESC, first LIMIT 10"),
    "audit_nesting": sql("SELECT count(*)::BIGINT AS relations, count(*) FILTER (same_role)::BIGINT AS same_role, count(DISTINCT case_id)::BIGINT AS n_docs FROM nest"),
    "audit_length": sql("SELECT median(e - b)::DOUBLE AS median, round(quantile_cont(e - b, 0.95), 6) AS p95, max(e - b)::BIGINT AS longest, count(*) FILTER (e - b > 150)::BIGINT AS over FROM regions"),
    "indicators": sql("SELECT case_id, " + ", ".join(f"max((mask >> {r}) & 1)::INT AS {ROLES[r]}" for r in range(N_ROLES)) + ", max((bit_count(mask) > 1)::INT)::INT AS MULTI_ROLE_DOC, (count(*) < any_value(b1))::INT AS VOLUME_LOW, (count(*) >= any_value(b1) AND count(*) < any_value(b2))::INT AS VOLUME_MED, (count(*) >= any_value(b2))::INT AS VOLUME_HIGH FROM regions, bounds GROUP BY case_id"),
    "volume_bounds": sql("SELECT b1, b2 FROM bounds"),
    "volume_bins": sql("SELECT CASE WHEN n_regions < b1 THEN 'LOW' WHEN n_regions < b2 THEN 'MED' ELSE 'HIGH' END AS bin, count(*)::BIGINT AS n FROM counts, bounds GROUP BY 1"),
    "split_volume": sql(f"SELECT split, min(n_regions)::BIGINT AS least, l[(len(l) // 2 + 1)::BIGINT] AS upper_median, max(n_regions)::BIGINT AS most FROM (SELECT *, list_sort(list(n_regions) OVER (PARTITION BY split)) AS l FROM (SELECT *, {SPLIT} AS split FROM counts)) GROUP BY split, l"),
    "split_symdiff": sql("SELECT case_id, side FROM (SELECT case_id, 'left' AS side FROM d WHERE case_id % 7 = 0 AND case_id % 5 <> 0 UNION ALL SELECT case_id, 'right' FROM d WHERE case_id % 5 = 0 AND case_id % 7 <> 0)"),
    "split_straddle": sql(f"SELECT root, count(DISTINCT split)::BIGINT AS n_splits, count(*)::BIGINT AS n FROM (SELECT min(case_id) OVER (PARTITION BY sha) AS root, {SPLIT} AS split FROM shw) GROUP BY root HAVING count(DISTINCT split) > 1"),
    "partition_check": sql("SELECT d.case_id, coalesce(m.n, 0)::BIGINT AS n FROM d LEFT JOIN (SELECT case_id, count(*) AS n FROM (SELECT case_id FROM d WHERE case_id % 11 <> 0 UNION ALL SELECT case_id FROM d WHERE case_id % 13 = 0) GROUP BY 1) m USING (case_id) WHERE coalesce(m.n, 0) <> 1"),
    "shingles": sql("SELECT case_id, size::BIGINT AS n FROM shn"),
    "dup_pairs": sql("SELECT a, b, round(jac, 4) AS jac, round(cont, 4) AS cont FROM linked"),
    "dup_topk_unlinked": sql("SELECT a, b, round(jac, 6) AS jac FROM pairs WHERE jac < 0.2 AND cont < 0.5 ORDER BY pairs.jac DESC, a DESC, b DESC LIMIT 5"),
    "dup_groups": sql("SELECT d.case_id, coalesce(min(w.m), d.case_id) AS root FROM d LEFT JOIN walk w ON d.case_id = w.case_id GROUP BY d.case_id", "walk AS (SELECT a AS case_id, a AS m FROM edges UNION SELECT e.b, w.m FROM walk w JOIN edges e ON w.case_id = e.a WHERE w.m < e.b)"),
    "benchmark_containment": sql(
        "SELECT item_id, case_id, round(count(*)::DOUBLE / any_value(total), 6) AS containment FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS total FROM ish) i JOIN alls USING (sh) GROUP BY item_id, case_id",
        r"iw AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark), ish AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS sh FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM iw)), shw AS (" + CTE["shw"].replace("FROM d", "FROM (SELECT doc_id AS case_id, text FROM documents WHERE n_chars > 0)") + "), alls AS (SELECT DISTINCT case_id, array_to_string(w[i:i + 7], ' ') AS sh FROM (SELECT case_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM shw))",
    ),
    "decode_threshold": sql(f"SELECT case_id, region_idx, {_names('pred')} AS pred FROM s1p"),
    "decode_argmax": sql(f"SELECT case_id, sent_idx, {_name('list_position(p, list_max(p)) - 1')} AS pred FROM s2"),
    "soft_targets": sql("SELECT case_id, region_idx, round(1.0::DOUBLE / bit_count(mask), 6) AS weight, bit_count(mask)::BIGINT AS n FROM regions"),
    "soft_ce": sql("SELECT case_id, region_idx, round(ln(list_sum(list_transform(p, lambda x: exp(x / 1000.0::DOUBLE)))) - list_sum(list_transform(range(9), lambda r: CASE WHEN (mask >> r) & 1 = 1 THEN p[r + 1] / 1000.0::DOUBLE ELSE 0 END)) / bit_count(mask), 6) AS loss FROM s1"),
    "multilabel_summary": sql(f"SELECT system, {SPLIT} AS split, {SUMMARY} FROM (SELECT 0 AS system, case_id, gold, pred FROM s1p UNION ALL SELECT 1, case_id, gold, pred FROM s1q) GROUP BY 1, 2"),
    "per_role_f1": sql("SELECT role::INT AS role, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0 ELSE 2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) END, 6) AS f1 FROM (SELECT role, ((gold & pred) >> role) & 1 AS tp, ((pred & ~gold) >> role) & 1 AS fp, ((gold & ~pred) >> role) & 1 AS fn FROM s1p, (SELECT unnest(range(9)) AS role)) GROUP BY role"),
    "micro_f1": sql(f"SELECT round({MICRO}, 6) AS micro_f1 FROM s1p"),
    "slices": sql(f"SELECT slice, {SUMMARY} FROM (SELECT unnest(['all', CASE WHEN bit_count(gold) > 1 THEN 'multi' ELSE 'single' END, CASE WHEN is_nested THEN 'nested' ELSE 'non_nested' END]) AS slice, gold, pred FROM s1p) GROUP BY slice"),
    "cardinality": sql("SELECT CASE WHEN grouping(multi) = 1 THEN 'all' WHEN multi THEN 'multi' ELSE 'single' END AS part, round(avg(bit_count(gold)), 6) AS gold, round(avg(bit_count(pred)), 6) AS pred FROM (SELECT *, bit_count(gold) > 1 AS multi FROM s1p) GROUP BY GROUPING SETS ((), (multi))"),
    "single_label_eval": sql(f"SELECT {SPLIT} AS split, {SUMMARY} FROM s2p GROUP BY 1"),
    "majority_baseline": sql(f"SELECT {_name('label')} AS label, n FROM (SELECT label, count(*)::BIGINT AS n, min(case_id * 1000000 + sent_idx) AS first FROM s2 WHERE {SPLIT} = 'train' GROUP BY label) ORDER BY n DESC, first LIMIT 1"),
    "threshold_sweep": sql("SELECT t AS threshold, count(*)::BIGINT AS n, round(avg(f), 4) AS set_f1 FROM (" + " UNION ALL ".join(f"SELECT {t} AS t, {F1} AS f FROM (SELECT gold, {_decode(t)} AS pred FROM s1)" for t in range(50, 1000, 50)) + ") GROUP BY t"),
    "best_config": sql("SELECT t AS threshold, round(avg(f), 4) AS set_f1 FROM (" + " UNION ALL ".join(f"SELECT {t} AS t, {F1} AS f FROM (SELECT gold, {_decode(t)} AS pred FROM s1)" for t in range(50, 1000, 50)) + ") GROUP BY t ORDER BY set_f1 DESC, t LIMIT 1"),
    "seed_mean_sd": sql(f"SELECT round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS sd_pop, count(*)::BIGINT AS seeds FROM (SELECT avg({F1}) AS f FROM s1p UNION ALL SELECT avg({F1}) FROM s1q)"),
    "bootstrap_ci": _interval(S2SUM, "total / n"),
    "paired_ci": _interval(PAIR, "(total - total_b) / n"),
    "subset_ci": _interval(f"SELECT case_id, 1 AS n, {F1} AS total, 0.0::DOUBLE AS total_b FROM s1p WHERE bit_count(gold) > 1", "total / n"),
    "crf_runs": sql("SELECT case_id, min(sent_idx) AS first, max(sent_idx) AS last, count(*)::BIGINT AS n FROM (SELECT case_id, sent_idx, sent_idx - row_number() OVER (PARTITION BY case_id ORDER BY sent_idx) AS island FROM s2) GROUP BY case_id, island"),
    "crf_run_stats": sql("SELECT count(*)::BIGINT AS n_runs, round(avg(n), 6) AS mean_length, count(*) FILTER (n = 1)::BIGINT AS singletons FROM (SELECT count(*) AS n FROM (SELECT case_id, sent_idx, sent_idx - row_number() OVER (PARTITION BY case_id ORDER BY sent_idx) AS island FROM s2) GROUP BY case_id, island)"),
    "run_flags": sql("SELECT case_id, sent_idx, row_number() OVER w - 1 AS place, lag(sent_idx) OVER w IS NULL AS is_first, lead(sent_idx) OVER w IS NULL AS is_last FROM (SELECT case_id, sent_idx, sent_idx - row_number() OVER (PARTITION BY case_id ORDER BY sent_idx) AS island FROM s2) WINDOW w AS (PARTITION BY case_id, island ORDER BY sent_idx)"),
    "pos_decile": sql("SELECT case_id, sent_idx, least(9, 10 * sent_idx // greatest(1, count(*) OVER (PARTITION BY case_id)))::BIGINT AS decile FROM sentences"),
    "turn_runs": "SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS n FROM (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations) GROUP BY conv_id, island",
    "token_windows": sql(r"SELECT case_id, i AS window_idx, i * 382 AS first, least(n, i * 382 + 510) AS last FROM (SELECT case_id, n, unnest(range(0, (CASE WHEN n <= 510 THEN 0 ELSE ceil((n - 510) / 382.0)::BIGINT END) + 1)) AS i FROM (SELECT case_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM d))"),
    "head_tail_truncate": sql(r"SELECT case_id, len(w)::BIGINT AS n, md5(array_to_string(CASE WHEN len(w) > 1500 THEN w[1:1200] || w[len(w) - 299:len(w)] ELSE w END, ' ')) AS digest FROM (SELECT case_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM d)"),
    "greedy_batches": sql(
        "SELECT case_id, region_idx, sum(CASE WHEN go.pos IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY nx.pos)::BIGINT - 1 AS batch FROM nx LEFT JOIN go ON go.pos = nx.pos",
        """it AS (SELECT case_id, region_idx, (e - b) // 40 + 1 AS w, row_number() OVER (ORDER BY case_id, region_idx) AS pos FROM regions),
        nx AS MATERIALIZED (SELECT *, pos + CASE WHEN w + lead(w, 1, 0) OVER o > 12 THEN 1 WHEN w + lead(w, 1, 0) OVER o + lead(w, 2, 0) OVER o > 12 THEN 2 WHEN w + lead(w, 1, 0) OVER o + lead(w, 2, 0) OVER o + lead(w, 3, 0) OVER o > 12 THEN 3 ELSE 4 END AS nxt FROM it WINDOW o AS (ORDER BY pos)),
        go AS (SELECT 1::BIGINT AS pos UNION ALL SELECT nx.nxt FROM go JOIN nx ON nx.pos = go.pos)""",
    ),
    "lexical_features": sql(rf"""SELECT case_id, sent_idx, {_bucket('len(w)', TOKEN_EDGES)} AS n_tok, {_bucket('length(text)', CHAR_EDGES)} AS n_char,
        regexp_matches(text, '{DIGIT}') AS has_digit, contains(text, ':') AS has_colon, regexp_matches(text, '[()]') AS has_paren, contains(text, '"') OR contains(text, '«') AS has_quote, least(9, 10 * sent_idx // greatest(1, n))::VARCHAR AS decile,
        w[1] AS first, w[len(w)] AS last, substring(w[1], 1, 3) AS pre3, CASE WHEN len(w) > 1 THEN w[1] || '_' || w[2] END AS first2, starts_with(w[1], 'و') AS waw_start,
        (8 + CASE WHEN len(w) > 1 THEN 5 WHEN len(w) > 0 THEN 4 ELSE 0 END + len(list_distinct(w)))::BIGINT AS n_features FROM sw"""),
    "char_wb_tfidf": "",
    "window_mean_pool": "SELECT label, dim, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY label, dim",
    "llm_parse": "",
    "context_window": sql(r"""SELECT case_id, region_idx, regexp_extract(substring(text, 1, f), '(?s)(\S*)$', 1) || substring(text, f + 1, b - f) AS pre, substring(text, e + 1, l - e) || regexp_extract(substring(text, l + 1), '(?s)^(\S*)', 1) AS post FROM (SELECT r.case_id, region_idx, b, e, text, greatest(0, b - 300) AS f, least(length(text), e + 300) AS l FROM regions r JOIN d USING (case_id))"""),
    "html_escape": "SELECT doc_id AS case_id, md5(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>')) AS digest FROM documents WHERE n_chars > 0",
    "audit_candidates": sql("SELECT stratum, count(*)::BIGINT AS n FROM (SELECT 1 AS stratum FROM roled WHERE bit_count(mask) = 1 AND NOT is_nested UNION ALL SELECT 2 FROM regions WHERE bit_count(mask) > 1 UNION ALL SELECT 3 FROM nest n JOIN regions o ON n.case_id = o.case_id AND n.i = o.region_idx JOIN regions c ON n.case_id = c.case_id AND n.j = c.region_idx WHERE o.mask <> c.mask UNION ALL SELECT 4 FROM projected WHERE status = 'AMBIGUOUS') GROUP BY stratum"),
    "contrast_table": "",
    "grid_robustness": "",
    "incremental_cache": "SELECT sha256(text) AS key, count(*)::BIGINT AS n FROM documents WHERE n_chars > 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND n_chars > 0) GROUP BY 1",
}
_GRAMS = r"""wd AS (SELECT case_id, ' ' || unnest(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '')) || ' ' AS p FROM d),
    g AS (SELECT case_id, substring(p, i, n) AS gram FROM (SELECT case_id, p, n, unnest(range(1, greatest(1, length(p) - n + 1) + 1)) AS i FROM wd, (SELECT unnest([3, 4]) AS n) WHERE n = 3 OR length(p) >= 4)),
    tf AS (SELECT case_id, gram, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
    wt AS (SELECT case_id, gram, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram))"""
ORACLES["char_wb_tfidf"] = sql("SELECT gram, count(*)::BIGINT AS n, round(sum(w / sqrt(s)), 5) AS weight FROM (SELECT *, sum(w * w) OVER (PARTITION BY case_id) AS s FROM wt) GROUP BY gram", _GRAMS.replace("FROM d)", "FROM d )"))
ORACLES["llm_parse"] = sql(
    "SELECT case_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN list_contains(c, '{r}') THEN '{r}' END" for r in ROLES)
    + r"], lambda x: x IS NOT NULL), '+') AS codes, coalesce(c[1], '') AS first FROM (SELECT case_id, regexp_extract_all(CASE WHEN regexp_matches(a, '\[[^\]]*\]') THEN regexp_extract(a, '\[([^\]]*)\]', 1) ELSE a END, '(ARGUMENT_PLAINTIFF|ARGUMENT_DEFENDANT|DECISION_APPEAL|LAW_REFERENCE|PREAMBLE|ANALYSIS|DECISION|FACTS|ISSUE)') AS c FROM (SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 'Roles: [' || "
    + _name("(case_id + 2) % 9")
    + " || ', ' || "
    + _name("case_id % 9")
    + " || '] not ISSUE' ELSE "
    + _name("case_id % 9")
    + " || ' or ' || "
    + _name("(case_id * 5) % 9")
    + " END AS a FROM d))"
)
_CONTRAST = [("s1 set_f1", PAIR), ("s1 set_f1 multi", PAIR.replace("FROM s1p)", "FROM s1p WHERE bit_count(gold) > 1)")), ("s2 accuracy", "SELECT x.case_id, 1 AS n, (x.gold = x.pred)::INT::DOUBLE AS total, (y.gold = y.pred)::INT::DOUBLE AS total_b FROM s2p x JOIN s2q y USING (case_id, sent_idx)")]


def _contrasts() -> str:
    parts = [f"SELECT '{name}' AS contrast, * FROM ({_interval(stats, '(total - total_b) / n')})" for name, stats in _CONTRAST]
    return " UNION ALL ".join(parts)


ORACLES["contrast_table"] = _contrasts()
# The line grid: the same steps as from cut to projected, with a line's end as one more.
_STEPS = ["cut", "piece", "placed", "sentences", "hits", "cov", "decided", "amb", "one", "two", "projected"]
_LINED = []
for _step in _STEPS:
    _body = CTE[_step].replace(r"'\1' || chr(1) || '\2', 'g'), chr(1))", r"'\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1))").replace("string_split(regexp_replace(regexp_replace(", "string_split(replace(regexp_replace(regexp_replace(") if _step == "cut" else CTE[_step]
    for _name_ in _STEPS:
        _body = re.sub(rf"(FROM|JOIN) {_name_}\b", rf"\1 {_name_}_lines", _body)
    if _step in ("decided", "projected"):
        _body = re.sub(r"\b(one|two)\.(one|case_id)\b", r"\1_lines.\2", _body)
    _LINED.append(f"{_step}_lines AS ({_body})")
_GRIDS = "grids AS (SELECT 'v1' AS grid, * FROM projected UNION ALL SELECT 'lines', * FROM projected_lines)"
_BOTH = ",\n".join([*_LINED, _GRIDS])
ORACLES["grid_robustness"] = sql(
    f"""SELECT grid, coalesce(split, 'all') AS split, count(*)::BIGINT AS n, count(DISTINCT case_id)::BIGINT AS n_docs, count(*) FILTER (status = 'UNLABELED')::BIGINT AS unlabeled, count(*) FILTER (status = 'AMBIGUOUS')::BIGINT AS ambiguous, count(*) FILTER (status = 'LABELED')::BIGINT AS eligible, count(*) FILTER (status <> 'UNLABELED')::BIGINT AS covered,
    count(*) FILTER (ambiguity_kind = 'co_extensive_multi_role')::BIGINT AS co_extensive_multi_role, count(*) FILTER (ambiguity_kind = 'nested')::BIGINT AS nested, count(*) FILTER (ambiguity_kind = 'other')::BIGINT AS other, median(e - b)::DOUBLE AS median_length, true AS adds_up
    FROM (SELECT *, {SPLIT} AS split FROM grids WHERE {SPLIT} <> 'test') GROUP BY GROUPING SETS ((grid, split), (grid))""",
    _BOTH,
)
ORACLES["grid_moved"] = sql(
    f"""SELECT *, round(second_rate - first_rate, 2) AS delta FROM (SELECT case_id, {SPLIT} AS split, coalesce(round(100.0::DOUBLE * count(*) FILTER (grid = 'v1' AND status = 'AMBIGUOUS') / nullif(count(*) FILTER (grid = 'v1'), 0), 2), 0) AS first_rate,
    coalesce(round(100.0::DOUBLE * count(*) FILTER (grid = 'lines' AND status = 'AMBIGUOUS') / nullif(count(*) FILTER (grid = 'lines'), 0), 2), 0) AS second_rate, count(*) FILTER (grid = 'v1')::BIGINT AS first_n, count(*) FILTER (grid = 'lines')::BIGINT AS second_n FROM grids WHERE {SPLIT} <> 'test' GROUP BY case_id)
    WHERE abs(round(second_rate - first_rate, 2)) > 5""",
    _BOTH,
)
