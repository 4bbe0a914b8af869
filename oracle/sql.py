"""The registered questions as SQL over the given tables, each written on its own from the definitions.

A query names the common tables it uses; `with_tables` puts their definitions (and what those use) in front.
"""
from __future__ import annotations

import re

# What each fragility signal weighs.
FW = {"not_active": 1.0, "accounts_overdue": 0.35, "confirmation_overdue": 0.2, "younger_than_2y": 0.15, "charges_outstanding": 0.1}


def money(x: str) -> str:
    """Fixed point at 1e-4, as the engine sums money."""
    return f"CAST(floor(({x}) * 1e4 + 0.5) AS BIGINT)"


def share(x: str) -> str:
    return f"CAST(floor(({x}) * 1e12 + 0.5) AS BIGINT)"


def norm_name(x: str) -> str:
    out = f"upper(coalesce({x}, ''))"
    for pat, to in (("&", " AND "), ("[^A-Z0-9 ]", " "), (r"\bLTD\b", "LIMITED"), (r"\bCO\b", "COMPANY"),
                    ("^THE ", ""), (r"\s+", " ")):
        out = f"regexp_replace({out}, '{pat}', '{to}', 'g')"
    return f"trim({out})"


def norm_postcode(x: str) -> str:
    return f"nullif(regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9]', '', 'g'), '')"


def core_of(x: str) -> str:
    forms = "LIMITED|PLC|LLP|LP|INCORPORATED|INC|CORPORATION|CORP|GMBH"
    return rf"trim(regexp_replace(regexp_replace({x}, '\b({forms})\b', '', 'g'), '\bL[IMTED]{{4,7}}$', ''))"


def regno(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN lpad({x}, 8, '0') "
            f"ELSE nullif(upper(trim({x})), '') END")


def letters(k: str) -> str:
    return f"substr(translate(md5(({k})::VARCHAR), '0123456789abcdef', 'ABCDEFGHIJKLMNOP'), 1, 10)"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two short non-empty strings: bit-parallel in 128-bit integers."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = (f"list_sum(list_transform(range(1, length({a}) + 1), lambda i: "
            f"CASE WHEN substr({a}, i, 1) = c THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END))::HUGEINT")
    row = (f"list_reduce(list_transform(string_split({b}, ''), lambda c: {mask}), "
           f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})")
    return f"(length({a}) - bit_count({row}))"


def ratio(a: str, b: str) -> str:
    return f"(200.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})))"


def tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


CURRENCY = ("CASE WHEN l_returnflag = 'N' THEN 'GBP' WHEN l_returnflag = 'A' THEN 'EUR' "
            "WHEN l_linestatus = 'F' THEN 'USD' ELSE 'JPY' END")
AMOUNT = ("l_extendedprice * (1 - l_discount) * (CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE "
          "WHEN l_returnflag = 'A' THEN 0.85::DOUBLE WHEN l_linestatus = 'F' THEN 0.78::DOUBLE END)")
SCOPE = ", ".join(f"'Brand#{i}'" for i in range(1, 21))
AS_OF = "DATE '2001-08-01'"
K = "json_extract_string(props, '$.k')"


def band(v: str, *steps: tuple[float, str], low: str | None) -> str:
    whens = " ".join(f"WHEN {v} >= {at} THEN '{label}'" for at, label in sorted(steps, reverse=True))
    return f"CASE {whens} ELSE {'NULL' if low is None else repr(low)} END"


def severity(level: str) -> str:
    return (f"CASE {level} WHEN 'Red' THEN 1.0::DOUBLE WHEN 'Orange' THEN 0.6::DOUBLE "
            f"WHEN 'Green' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END")


def confidence(method: str, score: str) -> str:
    return (f"CASE WHEN {method} = 'registration_number' AND {score} >= 70 THEN 0.99::DOUBLE "
            f"WHEN {method} = 'postcode_name' AND {score} >= 92 THEN 0.95::DOUBLE "
            f"WHEN {method} = 'exact_name' AND {score} >= 100 THEN 0.85::DOUBLE "
            f"WHEN {method} = 'postcode_name' AND {score} >= 80 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END")


# ---- common tables: name -> (definition, materialise) ----------------------------------------------------------

T: dict[str, str] = {
    # events
    "readings": """SELECT e.user_id, e.value, e.event_type, date_trunc('hour', e.ts) AS hour,
        e.event_type || '-' || strftime(e.ts, '%Y-%m-%d-%H') AS event_id, c.c_nationkey AS iso3
        FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    "ev": f"""SELECT event_id, 'readings' AS source, event_type, event_type || ' at ' || strftime(hour, '%Y-%m-%d %H') AS name,
        {band('max(value)', (200, 'Red'), (100, 'Orange'), low='Green')} AS alert_level,
        {severity(band('max(value)', (200, 'Red'), (100, 'Orange'), low='Green'))} AS severity,
        CAST(hour AS DATE) AS start_date, CAST(hour AS DATE) AS end_date,
        CAST(hour AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 2 FROM events) AS is_current
        FROM readings GROUP BY event_id, event_type, hour""",
    "aff": "SELECT DISTINCT event_id, iso3 FROM readings",
    "features": f"""SELECT e.event_id AS position, 'GDACS-' || e.event_type || '-' || {K} AS event_id, e.event_type, e.ts,
        e.value AS v, c.c_nationkey::VARCHAR AS nation, e.event_id AS reading
        FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    # sanctions
    "sanc_rows": """SELECT c_custkey AS unique_id, c_mktsegment AS regime, c_nationkey AS iso3 FROM customer
        WHERE c_acctbal < 0""",
    "sanc": """SELECT iso3, count(DISTINCT unique_id) AS designations,
        string_agg(DISTINCT regime, '; ' ORDER BY regime) AS regimes FROM sanc_rows GROUP BY iso3""",
    # commodities and trade
    "com": f"""SELECT p_partkey AS cn8_code, p_name AS description, p_brand AS hs2_code, p_type AS hs4_code,
        p_type || ' goods' AS hs4_description FROM part WHERE p_brand IN ({SCOPE})""",
    "monthly": """SELECT l.l_partkey AS commodity_id, nullif(c.c_nationkey, 24) AS country_id,
        year(o.o_orderdate) * 100 + month(o.o_orderdate) AS month_id,
        CASE o.o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 WHEN 'F' THEN 3 END AS flow_type_id,
        l.l_extendedprice * (1 - l.l_discount) AS value
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey""",
    "span": """SELECT CASE WHEN m % 100 < 12 THEN m - 100 + 1 ELSE m - 11 END AS s, m AS e
        FROM (SELECT max(year(o_orderdate) * 100 + month(o_orderdate)) AS m FROM orders)""",
    "imp": f"""SELECT commodity_id AS cn8_code, country_id AS iso3, sum({money('value')})::BIGINT / 1e4 AS value_gbp,
        CAST(min(s) AS INTEGER) AS period_start, CAST(min(e) AS INTEGER) AS period_end
        FROM monthly, span WHERE month_id BETWEEN s AND e AND flow_type_id IN (1, 3) GROUP BY 1, 2""",
    "flow": f"""SELECT b.cn8_code || '-' || b.iso3 || '-' || b.period_end AS flow_id, b.cn8_code, b.iso3, b.period_start,
        b.period_end, b.v / 1e4 AS value_gbp, CASE WHEN t.tot <> 0 THEN b.v::DOUBLE / t.tot::DOUBLE END
        AS share_of_uk_imports
        FROM (SELECT cn8_code, iso3, min(period_start) AS period_start, max(period_end) AS period_end,
              sum({money('value_gbp')})::BIGINT AS v FROM imp WHERE iso3 IS NOT NULL GROUP BY 1, 2) b
        JOIN (SELECT cn8_code, sum({money('value_gbp')})::BIGINT AS tot FROM imp GROUP BY 1) t USING (cn8_code)
        WHERE b.v > 0 AND b.cn8_code IN (SELECT cn8_code FROM com)""",
    # vendors and purchases
    "vendor": f"""SELECT vendor_id, vendor_name, {norm_name('vendor_name')} AS name_norm, postcode, country, country_iso3,
        {regno('number')} AS stated_company_number, is_home, s_acctbal FROM (
        SELECT s_suppkey AS vendor_id, CASE WHEN s_suppkey % 10 = 9 THEN 'Stray ' || {letters('s_suppkey + 1000000')} || ' GmbH'
            WHEN s_suppkey % 4 = 0 THEN 'The ' || substr(l, 1, 4) || substr(l, 6) || ' ' || seg || ' Limited'
            WHEN s_suppkey % 4 = 1 THEN substr(l, 1, 7) || substr(l, 9) || ' ' || seg || ' Ltd'
            WHEN s_suppkey % 4 = 2 THEN l || ' ' || seg || ' ltd' ELSE reverse(l) || ' ' || seg || ' Ltd' END AS vendor_name,
        CASE WHEN s_suppkey % 4 IN (1, 3) THEN lower(zip) WHEN s_suppkey % 4 = 0 THEN n_name END AS postcode,
        n_name AS country, s_nationkey AS country_iso3,
        CASE WHEN s_suppkey % 10 = 9 THEN (s_suppkey * 7 + 4)::VARCHAR WHEN s_suppkey % 4 = 0
            THEN (s_suppkey * 7 + 3)::VARCHAR ELSE '' END AS number,
        coalesce(n_regionkey = 0, false) AS is_home, s_acctbal
        FROM (SELECT s.*, {letters('s_suppkey * 7 + 3')} AS l, coalesce(lower(c_mktsegment), 'none') AS seg, c.zip
              FROM supplier s LEFT JOIN (SELECT c_custkey, c_mktsegment, n_name || ' ' || (c_custkey % 97) AS zip
                  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey) c ON c.c_custkey = s_suppkey * 7 + 3)
        LEFT JOIN nation ON n_nationkey = s_nationkey)""",
    "buy": f"""SELECT l_suppkey AS vendor_id, l_partkey AS cn8_code, {AMOUNT} AS amount_gbp,
        {CURRENCY} AS original_currency FROM lineitem""",
    "po": "SELECT * FROM buy WHERE cn8_code IN (SELECT cn8_code FROM com)",
    "poid": f"""SELECT l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey,
        l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
        AS po_line_id, l_suppkey AS vendor_id, l_partkey AS cn8_code, 'part ' || l_partkey AS item_description,
        {AMOUNT} AS amount_gbp, {CURRENCY} AS original_currency, CAST(l_shipdate AS DATE) AS order_date
        FROM lineitem""",
    "opo": "SELECT * FROM poid WHERE cn8_code IN (SELECT cn8_code FROM com)",
    "spend": f"""SELECT v.vendor_id, coalesce(s.s, 0)::BIGINT AS units FROM vendor v
        LEFT JOIN (SELECT vendor_id, sum({money('amount_gbp')})::BIGINT AS s FROM po GROUP BY 1) s USING (vendor_id)""",
    "crit": """SELECT r.vendor_id, r.units / 1e4 AS spend_12m_gbp, coalesce(o.criticality,
        CASE WHEN r.pr >= 0.8 THEN 'high' WHEN r.pr >= 0.4 THEN 'medium' ELSE 'low' END) AS criticality
        FROM (SELECT vendor_id, units, percent_rank() OVER (ORDER BY units) AS pr FROM spend) r
        LEFT JOIN crit_over o USING (vendor_id)""",
    # companies
    "comp": f"""SELECT lpad(c_custkey::VARCHAR, 8, '0') AS company_number,
        {letters('c_custkey')} || ' ' || lower(c_mktsegment) || ' ltd' AS name,
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'Liquidation' WHEN c_mktsegment <> 'FURNITURE' THEN 'Active' END
        AS status, c_mktsegment AS category, n_name || ' ' || (c_custkey % 97) AS postcode, CAST(first AS DATE) + 1461 AS incorporated_on,
        CAST(last AS DATE) + 60 AS accounts_next_due, CAST(last AS DATE) + 30 AS confstmt_next_due,
        c_mktsegment AS sic_codes, urgent AS mortgages_outstanding
        FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last,
            count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) USING (c_custkey)
        LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "frag": f"""SELECT *, least(1.0::DOUBLE, {FW['not_active']}::DOUBLE * na::INT + {FW['accounts_overdue']}::DOUBLE * ao::INT
        + {FW['confirmation_overdue']}::DOUBLE * co::INT + {FW['younger_than_2y']}::DOUBLE * yo::INT
        + {FW['charges_outstanding']}::DOUBLE * ch::INT) AS fragility_score,
        concat_ws('; ', CASE WHEN na THEN 'status: ' || status END, CASE WHEN ao THEN 'accounts overdue' END,
        CASE WHEN co THEN 'confirmation statement overdue' END, CASE WHEN yo THEN 'incorporated < 2 years ago' END,
        CASE WHEN ch THEN 'outstanding charges' END) AS fragility_reasons
        FROM (SELECT *, coalesce(status <> 'Active', false) AS na, coalesce(accounts_next_due < {AS_OF}, false) AS ao,
              coalesce(confstmt_next_due < {AS_OF}, false) AS co,
              coalesce(incorporated_on > {AS_OF} - INTERVAL 2 YEAR, false) AS yo,
              coalesce(mortgages_outstanding > 0, false) AS ch FROM comp)""",
    "trader_codes": """SELECT DISTINCT o_custkey AS trader_id, l_partkey AS cn8_code
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "creg": f"""SELECT company_number, name_norm, {core_of('name_norm')} AS name_core,
        {norm_postcode('postcode')} AS postcode_norm, status FROM (SELECT company_number, {norm_name('name')} AS name_norm,
        postcode, coalesce(status, '') AS status FROM comp)""",
    "vrec": f"""SELECT vendor_id AS rec_id, name_norm, {core_of('name_norm')} AS name_core,
        {norm_postcode('postcode')} AS postcode_norm, stated_company_number AS stated FROM vendor""",
    "trec": f"""SELECT rec_id, name_norm, {core_of('name_norm')} AS name_core, {norm_postcode('postcode')} AS postcode_norm,
        NULL::VARCHAR AS stated FROM (SELECT company_number::BIGINT AS rec_id, {norm_name(
            "CASE WHEN company_number::BIGINT % 2 = 0 THEN name ELSE substr(name, 1, 7) || substr(name, 9) END")}
        AS name_norm, postcode FROM comp)""",
    "trader_comp": """SELECT rec_id, company_number, confidence < 0.90 AS needs_review FROM t_scored WHERE confidence >= 0.75
        QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY confidence DESC, match_score DESC, full_score DESC,
            is_active DESC, company_number, match_method) = 1""",
    "imports_link": """SELECT DISTINCT r.company_number, t.cn8_code FROM trader_comp r
        JOIN trader_codes t ON t.trader_id = r.rec_id WHERE t.cn8_code IN (SELECT cn8_code FROM com)""",
    "machine": """SELECT rec_id, company_number, match_method, match_score, confidence, confidence < 0.90 AS needs_review
        FROM v_scored WHERE confidence >= 0.75
        QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY confidence DESC, match_score DESC, full_score DESC,
            is_active DESC, company_number, match_method) = 1""",
    # actions
    "req": f"""SELECT lpad(event_id::VARCHAR, 12, '0') AS request_id,
        CASE event_type WHEN 'click' THEN 'raise_alert' WHEN 'view' THEN 'update_alert_status'
             WHEN 'purchase' THEN 'confirm_match' WHEN 'signup' THEN 'reject_match'
             WHEN 'error' THEN 'set_criticality' END AS action,
        user_id AS vendor_id,
        CASE WHEN value < 5 THEN 'none-' ELSE 'click-' END || strftime(ts, '%Y-%m-%d-%H') AS event_id,
        'ALT-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS alert_id,
        {band('value', (25, 'closed'), (10, 'mitigating'), low='acknowledged')} AS status, {K} AS company_number,
        {band('value', (60, 'urgent'), (25, 'high'), (10, 'medium'), low='low')} AS criticality,
        CASE WHEN value >= 8 THEN ' owner ' || {K} ELSE ' ' END AS owner,
        CASE WHEN value < 60 THEN 'note ' || {K} END AS note, 'user ' || user_id AS actor,
        date_trunc('second', ts) AS requested_at FROM events""",
    "alert": f"""SELECT 'ALT-' || user_id || '-' || day AS alert_id, user_id AS vendor_id,
        'click-' || strftime(created_at, '%Y-%m-%d-%H') AS event_id,
        {band('v', (100, 'closed'), (70, 'mitigating'), (40, 'acknowledged'), low='open')} AS status, 'desk' AS owner,
        CASE WHEN v < 20 THEN '' ELSE 'seen' END AS note, created_at, updated_at
        FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max(value) AS v, min(date_trunc('second', ts)) AS created_at,
              max(date_trunc('second', ts)) AS updated_at FROM events WHERE event_type = 'signup' GROUP BY 1, 2)""",
    "confirm_j": """SELECT q.*, CASE WHEN v.vendor_id IS NULL THEN 'Unknown supplier ' || q.vendor_id
        WHEN c.company_number IS NULL THEN q.company_number || ' is not a registered company number' END AS reason
        FROM (SELECT * REPLACE (CASE WHEN regexp_matches(company_number, '^[0-9]+$') AND length(company_number) < 8
                  THEN lpad(company_number, 8, '0') ELSE company_number END AS company_number)
              FROM req WHERE action = 'confirm_match') q
        LEFT JOIN vendor v USING (vendor_id) LEFT JOIN comp c ON c.company_number = q.company_number""",
    "reject_j": """SELECT q.* REPLACE (NULL::VARCHAR AS company_number),
        CASE WHEN v.vendor_id IS NULL THEN 'Unknown supplier ' || q.vendor_id END AS reason
        FROM req q LEFT JOIN vendor v USING (vendor_id) WHERE action = 'reject_match'""",
    "crit_j": """SELECT q.*, CASE WHEN v.vendor_id IS NULL THEN 'Unknown supplier ' || q.vendor_id
        WHEN q.criticality NOT IN ('high', 'medium', 'low') THEN 'Criticality must be one of high, low, medium' END
        AS reason FROM req q LEFT JOIN vendor v USING (vendor_id) WHERE action = 'set_criticality'""",
    "raise_q": """SELECT q.*, v.vendor_id IS NOT NULL AS vk, e.event_id IS NOT NULL AS ek, trim(q.owner) <> '' AS ok,
        a.open_id FROM req q LEFT JOIN vendor v USING (vendor_id)
        LEFT JOIN ev e ON e.event_id = q.event_id
        LEFT JOIN (SELECT vendor_id, event_id, min(alert_id) AS open_id FROM alert WHERE status <> 'closed'
                   GROUP BY 1, 2) a ON a.vendor_id = q.vendor_id AND a.event_id = q.event_id
        WHERE q.action = 'raise_alert'""",
    "raise_j": """SELECT q.*, f.first_id, CASE WHEN NOT vk THEN 'Unknown supplier ' || q.vendor_id
        WHEN NOT ek THEN 'Unknown event ' || q.event_id WHEN NOT ok THEN 'An alert needs an owner'
        WHEN open_id IS NOT NULL OR f.first_id <> request_id THEN
             'An open alert already exists for this supplier and event (' ||
             coalesce(open_id, 'ALT-' || upper(substr(md5(f.first_id), 1, 16))) || ')' END AS reason
        FROM raise_q q LEFT JOIN (SELECT vendor_id, event_id, arg_min(request_id, (requested_at, request_id)) AS first_id
            FROM raise_q WHERE vk AND ek AND ok AND open_id IS NULL GROUP BY 1, 2) f
        ON f.vendor_id = q.vendor_id AND f.event_id = q.event_id""",
    "raise_qc": """SELECT q.* EXCLUDE (open_id), CASE WHEN count(a.alert_id) > 0 THEN 'open' END AS open_id
        FROM raise_q q LEFT JOIN (SELECT a.*, c.requested_at AS end_at, c.request_id AS end_id FROM alert a
            LEFT JOIN closing c USING (alert_id) WHERE a.status <> 'closed') a
        ON a.vendor_id = q.vendor_id AND a.event_id = q.event_id
        AND (a.end_at IS NULL OR (q.requested_at, q.request_id) <= (a.end_at, a.end_id))
        GROUP BY ALL""",
    "raise_jc": """SELECT q.*, f.first_id, vk AND ek AND ok AND open_id IS NULL AND f.first_id = request_id AS accepted
        FROM raise_qc q LEFT JOIN (SELECT vendor_id, event_id, arg_min(request_id, (requested_at, request_id)) AS first_id
            FROM raise_qc WHERE vk AND ek AND ok AND open_id IS NULL GROUP BY 1, 2) f
        ON f.vendor_id = q.vendor_id AND f.event_id = q.event_id""",
    "decisions": """SELECT vendor_id, company_number, 'confirm' AS decision, actor, requested_at, request_id
        FROM confirm_j WHERE reason IS NULL
        UNION ALL SELECT vendor_id, company_number, 'reject', actor, requested_at, request_id
        FROM reject_j WHERE reason IS NULL""",
    "match_over": """SELECT * FROM decisions
        QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY requested_at DESC, request_id DESC) = 1""",
    "crit_over": """SELECT vendor_id, criticality FROM crit_j
        WHERE reason IS NULL
        QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY requested_at DESC, request_id DESC) = 1""",
    # status changes: numbered requests folded one by one
    "upd": """SELECT *, row_number() OVER (PARTITION BY alert_id, known ORDER BY requested_at, request_id) AS k
        FROM (SELECT q.request_id, q.alert_id, q.status AS to_status, q.note, q.actor, q.requested_at,
              a.alert_id IS NOT NULL AND q.requested_at >= a.created_at AS known
              FROM req q LEFT JOIN alert a ON a.alert_id = q.alert_id WHERE q.action = 'update_alert_status')""",
    "closing": """SELECT f.alert_id, f.requested_at, f.request_id FROM fold f
        WHERE f.to_status = 'closed' AND legal(f.s, f.to_status, f.note)""",
    "fold": """SELECT u.request_id, u.alert_id, u.to_status, u.note, u.actor, u.requested_at, u.k, a.status AS s, a.note AS n,
        a.updated_at AS at FROM upd u JOIN alert a USING (alert_id) WHERE u.k = 1 AND u.known
        UNION ALL
        SELECT u.request_id, u.alert_id, u.to_status, u.note, u.actor, u.requested_at, u.k,
        CASE WHEN legal(f.s, f.to_status, f.note) THEN f.to_status ELSE f.s END,
        CASE WHEN legal(f.s, f.to_status, f.note) THEN noted(f.n, f.requested_at, f.actor, f.to_status, f.note)
             ELSE f.n END,
        CASE WHEN legal(f.s, f.to_status, f.note) THEN f.requested_at ELSE f.at END
        FROM fold f JOIN upd u ON u.alert_id = f.alert_id AND u.k = f.k + 1 AND u.known""",
    # ontology
    "resolves": """SELECT vendor_id, coalesce(o.company_number, m.company_number) AS company_number,
        CASE WHEN o.decision IS NOT NULL THEN 'human_' || o.decision ELSE m.match_method END AS match_method,
        m.match_score, CASE WHEN o.decision = 'confirm' THEN 1.0::DOUBLE ELSE m.confidence END AS confidence,
        coalesce(o.decision IS NULL AND m.needs_review, false) AS needs_review
        FROM (SELECT rec_id AS vendor_id, * EXCLUDE (rec_id) FROM machine) m FULL OUTER JOIN match_over o USING (vendor_id)
        WHERE coalesce(o.decision, '') <> 'reject'""",
    "company": """SELECT * FROM frag WHERE company_number IN
        (SELECT company_number FROM imports_link UNION SELECT company_number FROM resolves)""",
    "cty": """SELECT k.iso3, coalesce(n.n_name, k.iso3::VARCHAR) AS name, s.iso3 IS NOT NULL AS uk_sanctions_regime,
        coalesce(s.designations, 0) AS sanctions_designations, coalesce(x.sev, 0.0::DOUBLE) AS active_event_severity,
        greatest(coalesce(x.sev, 0.0::DOUBLE), CASE WHEN s.iso3 IS NOT NULL THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END)
        AS country_risk
        FROM (SELECT iso3 FROM imp WHERE iso3 IS NOT NULL UNION SELECT iso3 FROM aff UNION SELECT iso3 FROM sanc
              UNION SELECT country_iso3 FROM vendor WHERE country_iso3 IS NOT NULL) k
        LEFT JOIN nation n ON n.n_nationkey = k.iso3 AND n.n_nationkey <> 24
        LEFT JOIN sanc s ON s.iso3 = k.iso3
        LEFT JOIN (SELECT a.iso3, max(e.severity) AS sev FROM aff a JOIN ev e USING (event_id) WHERE e.is_current
                   GROUP BY 1) x ON x.iso3 = k.iso3""",
    # exposure
    "wt": f"""SELECT s.vendor_id, s.cn8_code, v.country_iso3, v.is_home, s.n AS po_lines, s.u AS spend_units,
        s.u / 1e4 AS spend, t.tot, coalesce(CASE WHEN t.tot <> 0 THEN s.u::DOUBLE / t.tot::DOUBLE END, 0.0::DOUBLE) AS w
        FROM (SELECT vendor_id, cn8_code, coalesce(sum({money('amount_gbp')}), 0)::BIGINT AS u, count(*) AS n FROM po
              GROUP BY 1, 2) s
        JOIN (SELECT vendor_id, coalesce(sum({money('amount_gbp')}), 0)::BIGINT AS tot FROM po GROUP BY 1) t
        USING (vendor_id) JOIN vendor v USING (vendor_id)""",
    "evrisk": "SELECT a.event_id, a.iso3, e.severity AS risk FROM aff a JOIN ev e USING (event_id)",
    "evcom": f"""SELECT a.event_id, f.cn8_code, min(a.risk) AS sev, sum({share('f.share_of_uk_imports')})::BIGINT AS u,
        arg_min(f.iso3, (-f.share_of_uk_imports, f.iso3)) AS top_country
        FROM flow f JOIN evrisk a USING (iso3) GROUP BY 1, 2""",
    "expo": f"""SELECT event_id, vendor_id, least(1.0::DOUBLE, min(sev) * (sum(part)::BIGINT / 1e12)) AS exposure_score,
        arg_min(cn8_code, (-part, cn8_code)) AS driver_commodity,
        arg_min(top_country, (-part, cn8_code)) AS driver_country, 'inferred' AS path_type
        FROM (SELECT a.event_id, w.vendor_id, w.cn8_code, min(a.risk) AS sev,
              sum({share('w.w * f.share_of_uk_imports')})::BIGINT AS part,
              arg_min(f.iso3, (-f.share_of_uk_imports, f.iso3)) AS top_country
              FROM wt w JOIN flow f USING (cn8_code) JOIN evrisk a USING (iso3) WHERE w.is_home GROUP BY 1, 2, 3)
        GROUP BY 1, 2 HAVING exposure_score > 0
        UNION ALL
        SELECT a.event_id, d.vendor_id, least(1.0::DOUBLE, a.risk), d.cn8_code, a.iso3, 'direct'
        FROM (SELECT vendor_id, country_iso3, arg_min(cn8_code, (-w, cn8_code)) AS cn8_code FROM wt
              WHERE NOT is_home AND tot <> 0 GROUP BY 1, 2) d
        JOIN evrisk a ON a.iso3 = d.country_iso3 WHERE a.risk > 0""",
    "fp": "SELECT event_id, md5(string_agg(iso3::VARCHAR, ',' ORDER BY iso3)) AS footprint FROM aff GROUP BY 1",
    "now": "SELECT event_id FROM ev WHERE is_current",
    "allcom": f"""SELECT f.cn8_code, sum({share('f.share_of_uk_imports * c.country_risk')})::BIGINT AS u,
        arg_min(f.iso3, (-(f.share_of_uk_imports * c.country_risk), f.iso3)) AS top_country
        FROM flow f JOIN cty c USING (iso3) GROUP BY 1""",
    "line": """SELECT w.vendor_id, w.cn8_code, w.w,
        CASE WHEN w.is_home THEN coalesce(i.u / 1e12, 0.0::DOUBLE) ELSE coalesce(c.country_risk, 0.0::DOUBLE) END AS risk,
        CASE WHEN w.is_home THEN i.top_country ELSE w.country_iso3 END AS via_country,
        CASE WHEN w.is_home THEN 'inferred' ELSE 'direct' END AS path_type
        FROM wt w LEFT JOIN allcom i USING (cn8_code) LEFT JOIN cty c ON c.iso3 = w.country_iso3""",
    "prio": """SELECT x.*, s.vendor_name, k.criticality, k.spend_12m_gbp, c.name AS company_name,
        c.status AS company_status, c.fragility_score, c.fragility_reasons, a.alert_id, a.status AS alert_status,
        x.exposure_score * (CASE k.criticality WHEN 'high' THEN 1.0::DOUBLE WHEN 'low' THEN 0.3::DOUBLE
            ELSE 0.6::DOUBLE END) * (1.0::DOUBLE + coalesce(c.fragility_score, 0.0::DOUBLE)) / 2.0::DOUBLE AS priority,
        m.hs4_description, y.name AS driver_country_name
        FROM expo x JOIN vendor s USING (vendor_id) JOIN crit k USING (vendor_id) LEFT JOIN resolves r USING (vendor_id)
        LEFT JOIN company c ON c.company_number = r.company_number
        LEFT JOIN (SELECT * FROM alert QUALIFY row_number() OVER (PARTITION BY vendor_id, event_id
                   ORDER BY created_at DESC, alert_id DESC) = 1) a ON a.vendor_id = x.vendor_id AND a.event_id = x.event_id
        LEFT JOIN com m ON m.cn8_code = x.driver_commodity LEFT JOIN cty y ON y.iso3 = x.driver_country""",
    "focus": """SELECT event_id, vendor_id FROM prio QUALIFY row_number() OVER (PARTITION BY event_id
        ORDER BY priority DESC, vendor_name, vendor_id) = 1""",
    "bline": """SELECT f.event_id, w.*, e.severity FROM focus f JOIN wt w USING (vendor_id) JOIN ev e USING (event_id)""",
    "bcty": """SELECT b.event_id, b.vendor_id, b.cn8_code, f.iso3, f.flow_id, f.share_of_uk_imports AS share
        FROM bline b JOIN flow f USING (cn8_code) JOIN aff a ON a.event_id = b.event_id AND a.iso3 = f.iso3
        WHERE b.is_home
        UNION ALL SELECT b.event_id, b.vendor_id, b.cn8_code, a.iso3, NULL, 1.0::DOUBLE
        FROM bline b JOIN aff a ON a.event_id = b.event_id AND a.iso3 = b.country_iso3 WHERE NOT b.is_home""",
    "bd": f"""SELECT b.event_id, b.vendor_id, b.cn8_code, m.description, b.spend, b.w AS weight, b.po_lines,
        coalesce(r.u / 1e12, 0.0::DOUBLE) * b.severity AS risk, b.w * (coalesce(r.u / 1e12, 0.0::DOUBLE) * b.severity)
        AS contribution, c.iso3, y.name AS country, c.flow_id, c.share
        FROM bline b LEFT JOIN (SELECT event_id, vendor_id, cn8_code, sum({share('share')})::BIGINT AS u FROM bcty
             GROUP BY 1, 2, 3) r USING (event_id, vendor_id, cn8_code)
        LEFT JOIN bcty c USING (event_id, vendor_id, cn8_code) LEFT JOIN com m USING (cn8_code)
        LEFT JOIN cty y ON y.iso3 = c.iso3""",
    # graph
    "node": """SELECT 'Company:' || company_number AS node_id, 'Company' AS object_type, name AS title FROM company
        UNION ALL SELECT 'Commodity:' || cn8_code, 'Commodity', description FROM com
        UNION ALL SELECT 'Country:' || iso3, 'Country', name FROM cty
        UNION ALL SELECT 'ImportFlow:' || flow_id, 'ImportFlow', flow_id FROM flow
        UNION ALL SELECT 'RiskEvent:' || event_id, 'RiskEvent', name FROM ev
        UNION ALL SELECT 'ERPSupplier:' || vendor_id, 'ERPSupplier', vendor_name FROM vendor
        UNION ALL SELECT 'PurchaseOrderLine:' || po_line_id, 'PurchaseOrderLine', po_line_id FROM opo
        UNION ALL SELECT 'Alert:' || alert_id, 'Alert', alert_id FROM alert""",
    "edge": """SELECT 'Company:' || company_number AS src, 'Commodity:' || cn8_code AS dst, 'imports' AS link_type
        FROM imports_link
        UNION ALL SELECT 'ImportFlow:' || flow_id, 'Commodity:' || cn8_code, 'flow_of_commodity' FROM flow
        UNION ALL SELECT 'ImportFlow:' || flow_id, 'Country:' || iso3, 'flow_from_country' FROM flow
        UNION ALL SELECT 'RiskEvent:' || event_id, 'Country:' || iso3, 'affects' FROM aff
        UNION ALL SELECT 'ERPSupplier:' || vendor_id, 'Company:' || company_number, 'resolves_to' FROM resolves
            WHERE company_number IS NOT NULL
        UNION ALL SELECT 'ERPSupplier:' || vendor_id, 'Country:' || country_iso3, 'located_in' FROM vendor
            WHERE country_iso3 IS NOT NULL
        UNION ALL SELECT 'PurchaseOrderLine:' || po_line_id, 'ERPSupplier:' || vendor_id, 'ordered_from' FROM opo
        UNION ALL SELECT 'PurchaseOrderLine:' || po_line_id, 'Commodity:' || cn8_code, 'po_commodity' FROM opo
        UNION ALL SELECT 'Alert:' || alert_id, 'ERPSupplier:' || vendor_id, 'alert_about' FROM alert""",
    # names
    "rec": f"""SELECT rec_id, name_norm, {core_of('name_norm')} AS name_core, {norm_postcode('lang')} AS postcode_norm,
        lpad(doc_id::VARCHAR, 8, '0') AS stated FROM (
        SELECT doc_id, lang, doc_id || '-' || (i - 1) AS rec_id, {norm_name('lines[i]')} AS name_norm
        FROM (SELECT doc_id, lang, lines, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents)))""",
    "reg": f"""SELECT company_number, name_norm, {core_of('name_norm')} AS name_core, {norm_postcode('lang')} AS postcode_norm,
        status FROM (SELECT lpad(page_id::VARCHAR, 8, '0') AS company_number,
        {norm_name("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS name_norm,
        regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        CASE WHEN url LIKE 'https%' THEN 'Active' ELSE 'Dissolved' END AS status FROM pages)""",
    "pairs0": """SELECT postcode_norm, a.name_core AS rec_core, b.name_core AS cand_core
        FROM (SELECT DISTINCT postcode_norm, name_core FROM rec WHERE name_core <> '') a
        JOIN (SELECT DISTINCT postcode_norm, name_core FROM reg WHERE name_core <> '') b USING (postcode_norm)
        WHERE 200 * least(length(a.name_core), length(b.name_core)) >= 72 * (length(a.name_core) + length(b.name_core))
        AND jaro_winkler_similarity(b.name_core, a.name_core) >= 0.80""",
    "pairs": f"""SELECT * FROM (SELECT *, CASE WHEN rec_core = cand_core THEN 100.0::DOUBLE ELSE greatest(
        {ratio('cand_core', 'rec_core')}, {ratio(tokens('cand_core'), tokens('rec_core'))}) END AS score FROM pairs0)
        WHERE score >= 80""",
    "uniq": """SELECT name_norm, count(*) AS n_exact, min(company_number) AS company_number,
        min(name_core) AS name_core, min((status = 'Active')::INT) AS is_active FROM reg WHERE name_norm <> '' GROUP BY 1""",
    "by_number": """SELECT r.rec_id, c.company_number, r.name_core AS rec_core, c.name_core AS cand_core,
        r.name_norm AS rec_full, c.name_norm AS cand_full, (c.status = 'Active')::INT AS is_active
        FROM rec r JOIN reg c ON c.company_number = r.stated""",
    "by_postcode": f"""SELECT r.rec_id, c.company_number, p.score AS match_score,
        {ratio('r.name_norm', 'c.name_norm')} AS full_score, (c.status = 'Active')::INT AS is_active
        FROM rec r JOIN pairs p ON p.postcode_norm = r.postcode_norm AND p.rec_core = r.name_core
        JOIN reg c ON c.postcode_norm = p.postcode_norm AND c.name_core = p.cand_core""",
}

# Recursive and row-function helpers of the status fold.
def _renamed(name: str, *tables: str) -> str:
    """The definition of a common table with the first day's tables in place of the ones named."""
    return re.sub(r"\b(" + "|".join(tables) + r")\b(?! AS)", lambda m: m[1] + "_1", T[name])


# The state after the first day's decisions, with the trade of one chapter.
T["decisions_1"] = "SELECT * FROM decisions WHERE requested_at < (SELECT min(requested_at)::DATE + 1 FROM req)"
T["match_over_1"] = _renamed("match_over", "decisions")
T["crit_over_1"] = T["crit_over"].replace(
    "WHERE reason IS NULL", "WHERE reason IS NULL AND requested_at < (SELECT min(requested_at)::DATE + 1 FROM req)")
T["crit_1"] = _renamed("crit", "crit_over")
T["resolves_1"] = _renamed("resolves", "match_over")
T["imports_link_1"] = T["imports_link"].replace("FROM com)", "FROM com WHERE hs2_code = 'Brand#7')")
T["company_1"] = _renamed("company", "imports_link", "resolves")

LEGAL = ("(({s} = 'open' AND {t} IN ('acknowledged', 'closed')) OR ({s} = 'acknowledged' AND {t} IN ('mitigating', "
         "'closed')) OR ({s} = 'mitigating' AND {t} = 'closed')) AND ({t} <> 'closed' OR trim(coalesce({n}, '')) <> '')")


def _expand(sql: str) -> str:
    sql = re.sub(r"legal\((\w+)\.s, \1\.to_status, \1\.note\)",
                 lambda m: "(" + LEGAL.format(s=f"{m[1]}.s", t=f"{m[1]}.to_status", n=f"{m[1]}.note") + ")", sql)
    return re.sub(
        r"noted\((\w+)\.n, \1\.requested_at, \1\.actor, \1\.to_status, \1\.note\)",
        lambda m: (f"concat_ws(chr(10), nullif({m[1]}.n, ''), '[' || strftime({m[1]}.requested_at, '%d %b %H:%M') || ' ' "
                   f"|| {m[1]}.actor || '] ' || {m[1]}.to_status || ': ' || coalesce({m[1]}.note, 'None'))"), sql)


def with_tables(sql: str) -> str:
    """Puts the definitions of the common tables a query names in front of it."""
    order: list[str] = []

    def need(text: str, me: str | None) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+\(?([a-z_0-9]+)\b", text):
            if name in T and name != me and name not in order:
                need(T[name], name)
                order.append(name)

    need(sql, None)
    if not order:
        return sql
    defs = ",\n".join(f"{n}{'' if n == 'fold' else ''} AS {'' if n == 'fold' else 'MATERIALIZED '}({_expand(T[n])})"
                      for n in order)
    return f"WITH {'RECURSIVE ' if 'fold' in order else ''}{defs}\n{_expand(sql)}"


SPECIAL = "CASE n_nationkey " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(("XS", "XK", "XC", "XL", "DH", "DU", "HA"))) + \
    " ELSE CASE WHEN n_nationkey <> 24 THEN 'N' || n_nationkey END END"
ISO = ("CASE alpha2 WHEN 'XS' THEN 'SRB' WHEN 'XK' THEN 'XKX' WHEN 'XC' THEN 'ESP' WHEN 'XL' THEN 'ESP' "
       "WHEN 'DH' THEN 'ARE' WHEN 'DU' THEN 'ARE' WHEN 'HA' THEN 'ARE' END")
REGIME = ("CASE WHEN c_mktsegment = 'BUILDING' THEN 'The Global Human Rights Sanctions Regulations 2020' "
          "WHEN c_mktsegment = 'HOUSEHOLD' THEN 'The Russia (Sanctions) (EU Exit) Regulations 2019' "
          "WHEN c_mktsegment = 'MACHINERY' THEN upper(n_name) || ' (Sanctions) Regulations' "
          "ELSE 'The ' || n_name || ' (Sanctions) (EU Exit) Regulations' END")
LEVEL4 = band("value", (100, "Red"), (50, "Orange"), (10, "Green"), low="White")
LEVEL4V = LEVEL4.replace("value", "v")
SCORED = f"""SELECT rec_id, match_method, company_number, match_score, full_score,
    CASE WHEN match_method = 'postcode_name' THEN 80.0::DOUBLE ELSE 0.0::DOUBLE END AS score_floor,
    {confidence('match_method', 'match_score')} AS confidence, is_active FROM (
    SELECT rec_id, 'registration_number' AS match_method, company_number, is_active,
        CASE WHEN rec_core = '' OR cand_core = '' THEN 0.0::DOUBLE WHEN rec_core = cand_core THEN 100.0::DOUBLE ELSE
        greatest({ratio('cand_core', 'rec_core')}, {ratio(tokens('cand_core'), tokens('rec_core'))}) END AS match_score,
        CASE WHEN rec_full = '' OR cand_full = '' THEN 0.0::DOUBLE ELSE {ratio('cand_full', 'rec_full')} END AS full_score
    FROM by_number
    UNION ALL SELECT r.rec_id, 'exact_name', u.company_number, u.is_active,
        CASE WHEN r.name_core = '' THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END, 100.0::DOUBLE
    FROM rec r JOIN uniq u USING (name_norm) WHERE u.n_exact = 1
    UNION ALL SELECT rec_id, 'postcode_name', company_number, is_active, match_score, full_score FROM by_postcode)"""
T["scored"] = SCORED
# The same rules for vendors and for importers against the company register.
_MATCHING = ("pairs0", "pairs", "uniq", "by_number", "by_postcode", "scored")
for _p, _records in (("v_", "vrec"), ("t_", "trec")):
    _new = {**{n: _p + n for n in _MATCHING}, "rec": _records, "reg": "creg"}
    for _n in _MATCHING:
        T[_p + _n] = re.sub(r"\b(FROM|JOIN)(\s+)(\w+)\b", lambda m: f"{m[1]}{m[2]}{_new.get(m[3], m[3])}", T[_n])

KEYS = [("Company", "company", "company_number"), ("Commodity", "com", "cn8_code"), ("Country", "cty", "iso3"),
        ("ImportFlow", "flow", "flow_id"), ("RiskEvent", "ev", "event_id"), ("ERPSupplier", "vendor", "vendor_id"),
        ("PurchaseOrderLine", "opo", "po_line_id"), ("Alert", "alert", "alert_id")]
ENDS = [("imports", "imports_link", "company_number", "company", "company_number", "cn8_code", "com", "cn8_code", False),
        ("flow_of_commodity", "flow", "flow_id", "flow", "flow_id", "cn8_code", "com", "cn8_code", True),
        ("flow_from_country", "flow", "flow_id", "flow", "flow_id", "iso3", "cty", "iso3", True),
        ("affects", "aff", "event_id", "ev", "event_id", "iso3", "cty", "iso3", False),
        ("resolves_to", "resolves", "vendor_id", "vendor", "vendor_id", "company_number", "company", "company_number",
         True),
        ("located_in", "vendor", "vendor_id", "vendor", "vendor_id", "country_iso3", "cty", "iso3", True),
        ("ordered_from", "opo", "po_line_id", "opo", "po_line_id", "vendor_id", "vendor", "vendor_id", True),
        ("po_commodity", "opo", "po_line_id", "opo", "po_line_id", "cn8_code", "com", "cn8_code", True),
        ("alert_about", "alert", "alert_id", "alert", "alert_id", "vendor_id", "vendor", "vendor_id", True)]


def _orphans(link: str, key: str, target: str, target_key: str) -> str:
    return (f"SELECT count(*) AS n FROM {link} x WHERE x.{key} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {target} y WHERE y.{target_key} = x.{key})")


def _fan(link: str, key: str, to: str) -> str:
    return (f"SELECT count(*) AS n FROM (SELECT {key} FROM {link} WHERE {to} IS NOT NULL GROUP BY 1 "
            f"HAVING count(DISTINCT {to}) > 1)")


def _checks() -> str:
    parts = []
    for name, table, key in KEYS:
        parts.append(f"SELECT '{name}: declared properties exist' AS \"check\", true AS passed, '' AS detail")
        agg = f"(SELECT count(*) AS n, count(DISTINCT {key}) AS d, count(*) - count({key}) AS z FROM {table})"
        parts.append(f"SELECT '{name}: primary key unique', n = d + z, n || ' rows' FROM {agg}")
        parts.append(f"SELECT '{name}: primary key not null', z = 0, z || ' nulls' FROM {agg}")
    for name, link, fk, ft, fpk, tk, tt, tpk, m21 in ENDS:
        for side, key, target, pk in (("from", fk, ft, fpk), ("to", tk, tt, tpk)):
            parts.append(f"SELECT 'link {name}: {side} endpoints exist', n = 0, n || ' orphans' "
                         f"FROM ({_orphans(link, key, target, pk)})")
        if m21:
            parts.append(f"SELECT 'link {name}: many_to_one respected', n = 0, n || ' violations' "
                         f"FROM ({_fan(link, fk, tk)})")
    return " UNION ALL ".join(parts)


_LOG = """SELECT request_id, 'raise_alert' AS action, '{"alert_id":"ALT-' || upper(substr(md5(request_id), 1, 16)) || '","vendor_id":'
    || vendor_id || ',"event_id":"' || event_id || '","owner":"' || owner || '","note":' ||
    coalesce('"' || note || '"', 'null') || '}' AS params, actor, strftime(requested_at, '%Y-%m-%d %H:%M:%S') AS logged_at
    FROM raise_jc WHERE accepted
    UNION ALL SELECT f.request_id, 'update_alert_status', '{"alert_id":"' || alert_id || '","from":"' || s || '","to":"' || to_status
    || '","note":' || coalesce('"' || note || '"', 'null') || '}', actor, strftime(requested_at, '%Y-%m-%d %H:%M:%S')
    FROM fold f WHERE legal(f.s, f.to_status, f.note)
    UNION ALL SELECT request_id, 'confirm_match', '{"vendor_id":' || vendor_id || ',"company_number":"' || company_number || '"}',
    actor, strftime(requested_at, '%Y-%m-%d %H:%M:%S') FROM confirm_j WHERE reason IS NULL
    UNION ALL SELECT request_id, 'reject_match', '{"vendor_id":' || vendor_id || '}', actor,
    strftime(requested_at, '%Y-%m-%d %H:%M:%S') FROM reject_j WHERE reason IS NULL
    UNION ALL SELECT request_id, 'set_criticality', '{"vendor_id":' || vendor_id || ',"criticality":"' || criticality || '"}', actor,
    strftime(requested_at, '%Y-%m-%d %H:%M:%S') FROM crit_j WHERE reason IS NULL"""
T["log"] = _LOG

_JUDGE = "request_id, vendor_id, reason IS NULL AS accepted, reason"
_MOVE = ("CASE WHEN NOT u.known THEN 'Unknown alert ' || u.alert_id WHEN NOT ({move}) THEN 'Cannot move ' || f.s "
         "|| ' -> ' || u.to_status || '. Allowed: ' || CASE f.s WHEN 'open' THEN 'acknowledged, closed' "
         "WHEN 'acknowledged' THEN 'closed, mitigating' WHEN 'mitigating' THEN 'closed' ELSE 'none (closed)' END "
         "WHEN u.to_status = 'closed' AND trim(coalesce(u.note, '')) = '' "
         "THEN 'Closing an alert requires a note explaining the outcome' END").format(
    move=LEGAL.split(" AND ({t} <>")[0].format(s="f.s", t="u.to_status"))

SUBGRAPH = """SELECT event_id, vendor_id, src, dst, arg_min(link_type, o) AS link_type FROM (
    SELECT event_id, vendor_id, x.o AS o, x.src AS src, x.dst AS dst, x.l AS link_type FROM (
    SELECT event_id, vendor_id, unnest(CASE WHEN flow_id IS NULL THEN [
        {'o': 0, 'src': po, 'dst': c, 'l': 'po_commodity'}, {'o': 1, 'src': po, 'dst': sup, 'l': 'ordered_from'},
        {'o': 2, 'src': e, 'dst': k, 'l': 'affects'}, {'o': 3, 'src': sup, 'dst': k, 'l': 'located_in'}] ELSE [
        {'o': 0, 'src': po, 'dst': c, 'l': 'po_commodity'}, {'o': 1, 'src': po, 'dst': sup, 'l': 'ordered_from'},
        {'o': 2, 'src': e, 'dst': k, 'l': 'affects'}, {'o': 4, 'src': fl, 'dst': k, 'l': 'flow_from_country'},
        {'o': 5, 'src': fl, 'dst': c, 'l': 'flow_of_commodity'}] END) AS x
    FROM (SELECT event_id, vendor_id, flow_id, 'PurchaseOrderLine:' || cn8_code AS po, 'Commodity:' || cn8_code AS c,
          'ERPSupplier:' || vendor_id AS sup, 'RiskEvent:' || event_id AS e, 'Country:' || iso3 AS k,
          'ImportFlow:' || flow_id AS fl
          FROM bd JOIN (SELECT event_id, vendor_id, cn8_code FROM (SELECT DISTINCT event_id, vendor_id, cn8_code,
                contribution FROM bd WHERE contribution > 0) QUALIFY row_number() OVER (PARTITION BY event_id, vendor_id
                ORDER BY contribution DESC, cn8_code) <= 3) USING (event_id, vendor_id, cn8_code)
          WHERE iso3 IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY event_id, vendor_id, cn8_code ORDER BY share DESC, iso3) <= 3))
    UNION ALL
    SELECT f.event_id, f.vendor_id, 6, 'ERPSupplier:' || f.vendor_id, 'Company:' || r.company_number,
        'resolves_to' || coalesce(' (' || format('{:.2f}', r.confidence) || ')', '')
    FROM (SELECT DISTINCT event_id, vendor_id FROM bd) f JOIN resolves r USING (vendor_id)
    WHERE r.company_number IS NOT NULL) GROUP BY 1, 2, 3, 4"""

_DQ = [("traders_in_scope", "SELECT count(DISTINCT trader_id) FROM trader_codes"),
       ("traders_resolved", "SELECT count(*) FROM trader_comp"),
       ("traders_needing_review", "SELECT count(*) FROM trader_comp WHERE needs_review"),
       ("trader_codes_unknown", "SELECT count(DISTINCT t.cn8_code) FROM trader_codes t "
                                "WHERE t.cn8_code NOT IN (SELECT cn8_code FROM com)"),
       ("import_value_without_country", f"SELECT round(coalesce(sum({money('value_gbp')}), 0)::DOUBLE / 1e4) FROM imp "
                                        f"WHERE iso3 IS NULL"),
       ("vendors", "SELECT count(*) FROM vendor"),
       ("vendors_resolved", "SELECT count(company_number) FROM resolves"),
       ("vendors_needing_review", "SELECT count(*) FROM resolves WHERE needs_review"),
       ("vendors_sharing_a_company", "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM resolves "
                                     "WHERE company_number IS NOT NULL GROUP BY company_number HAVING count(*) > 1)"),
       ("po_lines_converted", "SELECT count(*) FROM buy WHERE original_currency <> 'GBP'"),
       ("current_events", "SELECT count(*) FROM ev WHERE is_current"),
       ("po_lines_without_rate", "SELECT count(*) FROM buy WHERE amount_gbp IS NULL")]

# Declared properties: (table, key, text columns, number columns); `name=expression` where the column differs.
_PROPERTIES = {
    "Company": ("company", "company_number", "company_number name status category postcode incorporated_on sic_codes",
                "accounts_overdue=ao confirmation_overdue=co fragility_score"),
    "Commodity": ("com", "cn8_code", "cn8_code description hs2_code hs4_code hs4_description", ""),
    "Country": ("cty", "iso3", "iso3 name",
                "uk_sanctions_regime sanctions_designations active_event_severity country_risk"),
    "ImportFlow": ("flow", "flow_id", "flow_id cn8_code iso3", "period_start period_end value_gbp share_of_uk_imports"),
    "RiskEvent": ("ev", "event_id", "event_id source event_type name alert_level start_date end_date",
                  "severity is_current"),
    "ERPSupplier": ("(SELECT vendor.*, spend_12m_gbp, criticality FROM vendor JOIN crit USING (vendor_id))", "vendor_id",
                    "vendor_id vendor_name postcode country_iso3 stated_company_number criticality", "spend_12m_gbp"),
    "PurchaseOrderLine": ("opo", "po_line_id", "po_line_id vendor_id cn8_code item_description order_date", "amount_gbp"),
    "Alert": ("alert", "alert_id", "alert_id vendor_id event_id status owner note created_at updated_at", ""),
}


def _properties() -> str:
    parts = []
    for kind, (table, key, texts, numbers) in _PROPERTIES.items():
        for spec, number in [*((x, False) for x in texts.split()), *((x, True) for x in numbers.split())]:
            name, _, expr = spec.partition("=")
            expr = expr or name
            text = f"strftime({expr}, '%Y-%m-%d %H:%M:%S')" if name.endswith("ed_at") else f"{expr}::VARCHAR"
            parts.append(f"SELECT '{kind}:' || {key} AS node_id, '{name}' AS property, "
                         + (f"NULL::VARCHAR AS text, {expr}::DOUBLE AS number" if number
                            else f"{text} AS text, NULL::DOUBLE AS number")
                         + f" FROM {table} WHERE {expr} IS NOT NULL")
    return " UNION ALL ".join(parts)


COUNTRIES = """(SELECT a.event_id, string_agg(c.name, ', ' ORDER BY c.name) AS countries, count(c.iso3) AS n_countries
    FROM aff a LEFT JOIN cty c USING (iso3) GROUP BY 1)"""

QUESTIONS: dict[str, str] = {
    # cleaning
    "norm_name": f"SELECT doc_id, {norm_name('text')} AS name_norm FROM documents",
    "norm_postcode": f"SELECT page_id, {norm_postcode('url')} AS postcode_norm FROM pages",
    "name_core": f"SELECT doc_id, {core_of(norm_name('text'))} AS name_core FROM documents",
    "trader_surrogate_key": """SELECT c_custkey, md5(c_name || '|' || CASE WHEN c_mktsegment <> 'FURNITURE'
        THEN c_nationkey::VARCHAR END) AS trader_id FROM customer""",
    "regno_repair": f"""SELECT c_custkey, {regno('raw')} AS company_number FROM (SELECT c_custkey,
        CASE WHEN c_acctbal < 0 THEN ' sc' || c_custkey || ' ' WHEN c_mktsegment = 'BUILDING' THEN ''
        ELSE c_custkey::VARCHAR END AS raw FROM customer)""",
    "fx_convert": "SELECT vendor_id, cn8_code, original_currency, amount_gbp FROM buy",
    "po_line_id": "SELECT po_line_id, vendor_id, cn8_code FROM poid",
    "country_override_map": f"""SELECT c_custkey, alpha2, coalesce({ISO}, CASE WHEN n_regionkey < 4 AND alpha2 IS NOT NULL
        THEN upper(n_name) END) AS iso3
        FROM customer JOIN (SELECT *, {SPECIAL} AS alpha2 FROM nation) ON n_nationkey = c_nationkey""",
    "date_formats": """SELECT o_orderkey, CAST(CAST(try_strptime(nullif(CASE WHEN o_orderstatus = 'P' THEN '31/02/1999'
        WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END, ''), '%d/%m/%Y') AS DATE)
        AS VARCHAR) AS tolerant,
        CAST(CAST(strptime(upper(strftime(o_orderdate, '%d-%b-%y')), '%d-%b-%y') AS DATE) AS VARCHAR) AS strict
        FROM orders""",
    "regime_extract": f"""SELECT c_custkey, subject, CASE WHEN subject = 'Russia' THEN 'RUS' ELSE
        (SELECT min('ISO' || n.n_nationkey) FROM nation n WHERE n.n_regionkey < 4 AND lower(n.n_name) = lower(subject))
        END AS iso3 FROM (SELECT c_custkey, nullif(regexp_extract({REGIME}, '^(?:The )?(.+?) \\(Sanctions\\)', 1), '')
        AS subject FROM customer JOIN nation ON n_nationkey = c_nationkey)""",
    "severity_map": f"SELECT event_id, {LEVEL4} AS alert_level, {severity(LEVEL4)} AS severity FROM events",
    "scope_filter": """SELECT p_partkey, cn8_code FROM (SELECT p_partkey, lpad((p_size * 1000000 + p_partkey)::VARCHAR, 8,
        '0') AS cn8_code FROM part) WHERE left(cn8_code, 2) IN ('29', '07', '41')""",
    "sanctions_by_country": "SELECT * FROM sanc",
    "freshness": """SELECT strftime(strptime(min(period_start)::VARCHAR, '%Y%m'), '%b %Y') AS first_month,
        strftime(strptime(max(period_end)::VARCHAR, '%Y%m'), '%b %Y') AS last_month FROM flow""",
    # sources
    "clean_projection": f"""SELECT company_number, name_norm, {core_of('name_norm')} AS name_core, postcode_norm, category,
        incorporated_on, accounts_next_due, NULL::VARCHAR AS confstmt_next_due, mortgages_outstanding FROM (
        SELECT lpad(c_custkey::VARCHAR, 8, '0') AS company_number,
        {norm_name("'The ' || c_name || ' & co. ltd'")} AS name_norm,
        {norm_postcode("n_name || ' ' || c_nationkey")} AS postcode_norm, c_mktsegment AS category,
        strftime(lo, '%Y-%m-%d') AS incorporated_on, strftime(hi, '%Y-%m-%d') AS accounts_next_due,
        CASE WHEN c_acctbal < 0 THEN -1 ELSE CAST(floor(c_acctbal) AS INTEGER) END AS mortgages_outstanding
        FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey AS c_custkey,
            min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1) USING (c_custkey))""",
    "events_parse_json": f"""SELECT event_id, 'GDACS' AS source, event_type, CASE WHEN v < 20 THEN 'unnamed ' || reading
        ELSE 'reading ' || reading END AS name, {LEVEL4V} AS alert_level, {severity(LEVEL4V)} AS severity,
        strftime(ts, '%Y-%m-%d') AS start_date, strftime(ts, '%Y-%m-%d') AS end_date, v >= 50 AS is_current,
        '/report/' || reading AS url
        FROM features QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY position) = 1""",
    "event_country_links": "SELECT DISTINCT event_id, nation AS iso3 FROM features WHERE v >= 5",
    "vendor_clean": """SELECT rec_id AS vendor_id, name_norm, name_core, postcode_norm, stated AS stated_company_number
        FROM vrec""",
    "po_line_clean": """SELECT po_line_id, vendor_id, cn8_code, item_description, amount_gbp, original_currency,
        order_date::VARCHAR AS order_date FROM poid""",
    "trailing12_rollup": """SELECT cn8_code AS commodity_id, coalesce(iso3, -1) AS country_id, value_gbp, period_start,
        period_end FROM imp""",
    # entity resolution
    "er_block_number": "SELECT rec_id, company_number, rec_core, cand_core FROM by_number",
    "er_block_postcode": f"""SELECT postcode_norm, rec_core, cand_core, round(jw, 6) AS jw, round(CASE
        WHEN rec_core = cand_core THEN 100.0::DOUBLE ELSE greatest({ratio('cand_core', 'rec_core')},
        {ratio(tokens('cand_core'), tokens('rec_core'))}) END, 6) AS match_score
        FROM (SELECT postcode_norm, a.name_core AS rec_core, b.name_core AS cand_core,
              jaro_winkler_similarity(b.name_core, a.name_core) AS jw
              FROM (SELECT DISTINCT postcode_norm, name_core FROM rec WHERE name_core <> '') a
              JOIN (SELECT DISTINCT postcode_norm, name_core FROM reg WHERE name_core <> '') b USING (postcode_norm))
        WHERE jw >= 0.80""",
    "er_block_name": """SELECT r.rec_id, CASE WHEN u.n_exact = 1 THEN u.company_number END AS company_number, u.n_exact
        FROM rec r JOIN uniq u USING (name_norm)""",
    "er_ambiguous": "SELECT r.rec_id, u.n_exact FROM rec r JOIN uniq u USING (name_norm) WHERE u.n_exact > 1",
    "er_candidates": "SELECT rec_id, match_method, company_number, score_floor FROM scored",
    "er_match_score": """SELECT rec_id, match_method, company_number, round(match_score, 6) AS match_score,
        round(full_score, 6) AS full_score, score_floor FROM scored""",
    "er_confidence": "SELECT rec_id, match_method, company_number, confidence, score_floor FROM scored",
    "er_best_match": """SELECT rec_id, company_number, match_method, round(match_score, 6) AS match_score, confidence,
        confidence < 0.90 AS needs_review FROM scored WHERE confidence >= 0.75
        QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY confidence DESC, match_score DESC, full_score DESC,
            is_active DESC, company_number, match_method) = 1""",
    "er_trader_scope": f"""SELECT c_custkey AS rec_id, {norm_name('c_name')} AS name_norm,
        NULL::VARCHAR AS stated_company_number FROM customer WHERE c_custkey IN (SELECT t.trader_id FROM trader_codes t
        JOIN com m USING (cn8_code) WHERE m.hs2_code = 'Brand#7')""",
    "er_precision_recall": """SELECT count(*) AS vendors, count(p) AS predicted_matches,
        round(count(*) FILTER (WHERE p = t) / greatest(count(p), 1), 3) AS "precision",
        round(count(*) FILTER (WHERE p = t) / greatest(count(t), 1), 3) AS recall,
        count(*) FILTER (WHERE p IS NOT NULL AND t IS NULL) AS false_matches_without_truth
        FROM (SELECT m.company_number AS p, CASE WHEN s_suppkey % 10 <> 9 THEN lpad((s_suppkey * 7 + 3)::VARCHAR, 8, '0')
              END AS t FROM supplier LEFT JOIN machine m ON m.rec_id = s_suppkey)""",
    "er_unambiguous_pool": """SELECT r.rec_id, min(c.company_number) AS company_number FROM rec r JOIN reg c
        ON c.name_norm = r.name_norm AND c.postcode_norm = r.postcode_norm WHERE c.status = 'Active'
        GROUP BY r.rec_id HAVING count(*) = 1""",
    "sample_by_hash": """SELECT t.trader_id, string_agg(t.cn8_code::VARCHAR, ',' ORDER BY t.cn8_code) AS codes
        FROM trader_codes t WHERE t.cn8_code IN (SELECT cn8_code FROM com) AND t.trader_id IN (
            SELECT d.trader_id FROM (SELECT DISTINCT trader_id FROM trader_codes x WHERE x.cn8_code IN
                (SELECT cn8_code FROM com)) d ORDER BY md5(d.trader_id::VARCHAR), d.trader_id LIMIT 20)
        GROUP BY 1""",
    # ontology
    "po_known_commodity": "SELECT vendor_id, cn8_code, amount_gbp FROM po",
    "company_imports_link": "SELECT * FROM imports_link",
    "country_union": "SELECT iso3, name FROM cty",
    "country_risk": "SELECT * FROM cty",
    "import_flow_share": "SELECT * FROM flow",
    "supplier_spend": "SELECT vendor_id, units / 1e4 AS spend_12m_gbp FROM spend",
    "supplier_criticality": "SELECT * FROM crit",
    "resolves_to_override": "SELECT * FROM resolves",
    "company_scope": "SELECT company_number, name FROM company",
    "company_fragility": """SELECT company_number, ao AS accounts_overdue, co AS confirmation_overdue, fragility_score,
        fragility_reasons FROM frag""",
    "apply_edits": """SELECT vendor_id, criticality, company_number, match_method, match_score, confidence, needs_review,
        c.name, c.fragility_score FROM crit LEFT JOIN resolves r USING (vendor_id) LEFT JOIN company c
        USING (company_number)""",
    "data_quality_report": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(({q}) AS DOUBLE) AS value" for m, q in _DQ),
    # contract
    "contract_checks": _checks(),
    "contract_pk": " UNION ALL ".join(
        f"SELECT '{n}' AS object_type, count(*) AS n, count(DISTINCT {k}) AS n_distinct, count(*) - count({k}) AS n_null "
        f"FROM {t}" for n, t, k in KEYS),
    "contract_orphans": " UNION ALL ".join(
        [f"SELECT '{e[0]} {side}' AS link, n FROM ({_orphans(e[1], k, t, pk)})" for e in ENDS
         for side, k, t, pk in (("from", e[2], e[3], e[4]), ("to", e[5], e[6], e[7]))]
        + [f"SELECT 'trader codes', n FROM ({_orphans('trader_codes', 'cn8_code', 'com', 'cn8_code')})"]),
    "contract_cardinality": " UNION ALL ".join(
        f"SELECT '{e[0]}' AS link, n FROM ({_fan(e[1], e[2], e[5])})" for e in ENDS),
    # exposure
    "exposure_event_risk": "SELECT event_id, iso3, risk FROM evrisk",
    "spend_weights": "SELECT vendor_id, cn8_code, country_iso3, spend, w FROM wt",
    "inferred_commodity_risk": """SELECT DISTINCT footprint, cn8_code, u / 1e12 AS risk, top_country
        FROM evcom JOIN fp USING (event_id)""",
    "exposure_per_line": """SELECT vendor_id, cn8_code, w, risk, coalesce(via_country, -1) AS via_country, path_type
        FROM line""",
    "supplier_exposure": """SELECT DISTINCT footprint, e.severity, vendor_id, exposure_score, driver_commodity,
        driver_country, path_type FROM expo JOIN fp USING (event_id) JOIN ev e USING (event_id)""",
    "supplier_exposure_all_risk": f"""SELECT vendor_id, least(1.0::DOUBLE, sum(part)::BIGINT / 1e12) AS exposure_score,
        arg_min(cn8_code, (-part, cn8_code)) AS driver_commodity,
        arg_min(via_country, (-part, cn8_code)) FILTER (WHERE via_country IS NOT NULL) AS driver_country,
        max(path_type) AS path_type
        FROM (SELECT *, {share('w * risk')} AS part FROM line) GROUP BY 1""",
    "priority": "SELECT event_id, vendor_id, priority FROM prio",
    "resolves_to_first_day": "SELECT * FROM resolves_1",
    "criticality_first_day": "SELECT * FROM crit_1",
    "company_scope_first_day": "SELECT company_number, name, fragility_score FROM company_1",
    "review_queue_first_day": """SELECT vendor_id, v.vendor_name, v.postcode, v.stated_company_number, r.company_number,
        c.name AS company_name, c.postcode AS company_postcode, r.match_method, r.match_score, r.confidence
        FROM resolves_1 r JOIN vendor v USING (vendor_id) LEFT JOIN company_1 c ON c.company_number = r.company_number
        WHERE r.needs_review""",
    "po_line_from_text": f"""SELECT l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_suppkey::VARCHAR, l_partkey::VARCHAR, l_linenumber::VARCHAR) AS po_line_id,
        l_suppkey::VARCHAR AS vendor_id, lpad(l_partkey::VARCHAR, 8, '0') AS cn8_code,
        'part ' || l_partkey AS item_description,
        {AMOUNT.replace('l_extendedprice * (1 - l_discount)', 'l_quantity::DOUBLE * l_extendedprice::DOUBLE')}
        AS amount_gbp, {CURRENCY} AS original_currency,
        CAST(strptime(strftime(l_shipdate, '%d-%b-%y'), '%d-%b-%y')::DATE AS VARCHAR) AS order_date FROM lineitem""",
    "event_material_counts": """SELECT e.event_id, count(x.vendor_id) AS reached,
        count(*) FILTER (WHERE x.exposure_score >= 0.1::DOUBLE) AS material FROM ev e LEFT JOIN expo x USING (event_id)
        GROUP BY 1""",
    # graph
    "graph_nodes": "SELECT node_id, object_type, coalesce(title, '') AS title FROM node",
    "graph_edges": "SELECT * FROM edge",
    "graph_node_properties": _properties(),
    "graph_edge_properties": " UNION ALL ".join(
        f"SELECT 'ERPSupplier:' || vendor_id AS src, 'Company:' || company_number AS dst, 'resolves_to' AS link_type, "
        f"'{p}' AS property, {p + '::VARCHAR' if p == 'match_method' else 'NULL::VARCHAR'} AS text, "
        f"{'NULL' if p == 'match_method' else p}::DOUBLE AS number FROM resolves "
        f"WHERE company_number IS NOT NULL AND {p} IS NOT NULL" for p in ("match_method", "match_score", "confidence")),
    "graph_step": """SELECT 'RiskEvent:' || a.event_id AS event, 'Country:' || a.iso3 AS country,
        'ERPSupplier:' || v.vendor_id AS supplier FROM aff a JOIN vendor v ON v.country_iso3 = a.iso3""",
    "graph_footprint_impact": """SELECT DISTINCT footprint, e.severity, vendor_id, exposure_score, driver_commodity,
        driver_country, path_type FROM expo JOIN fp USING (event_id) JOIN ev e USING (event_id)""",
    "graph_event_impact": """SELECT x.* FROM expo x JOIN ev e USING (event_id)
        WHERE right(e.name, 13) = (SELECT max(right(name, 13)) FROM ev)""",
    "explain_path": """SELECT x.event_id, x.vendor_id, concat_ws(' > ', e.name || ' (' || e.alert_level || ')',
        'affects ' || c.name, CASE WHEN v.is_home THEN 'which supplies ' ||
        CAST(floor(coalesce(f.share_of_uk_imports, 0) * 100 + 0.5) AS BIGINT) || '% of UK imports of ' ||
        x.driver_commodity || ' (' || left(m.description, 50) || ') > which we buy from ' || v.vendor_name
        ELSE 'where ' || v.vendor_name || ' is located (direct supplier)' END) AS path
        FROM expo x JOIN ev e USING (event_id) JOIN vendor v USING (vendor_id) LEFT JOIN cty c ON c.iso3 = x.driver_country
        LEFT JOIN com m ON m.cn8_code = x.driver_commodity
        LEFT JOIN flow f ON f.cn8_code = x.driver_commodity AND f.iso3 = x.driver_country
        WHERE x.event_id IN (SELECT event_id FROM now)""",
    "exposure_breakdown": """SELECT event_id, vendor_id, cn8_code, description, spend, weight, po_lines, risk, contribution,
        coalesce(iso3, -1) AS iso3, coalesce(country, '') AS country, coalesce(share, 0.0::DOUBLE) AS share FROM bd""",
    "exposure_breakdown_nested": """SELECT event_id, vendor_id, cn8_code, risk, contribution,
        coalesce(string_agg(iso3 || '=' || country, '; ' ORDER BY share DESC, iso3), '') AS countries FROM bd
        GROUP BY 1, 2, 3, 4, 5""",
    "path_subgraph": SUBGRAPH,
    "graph_counts": """SELECT 'node' AS kind, object_type AS type, count(*) AS n FROM node GROUP BY 2
        UNION ALL SELECT 'edge', link_type, count(*) FROM edge GROUP BY 2""",
    "suppliers_reached": """SELECT f.event_id, count(DISTINCT vendor_id) AS reached FROM fp f LEFT JOIN (
        SELECT a.event_id, p.vendor_id FROM (SELECT DISTINCT p.vendor_id, f.iso3 FROM po p JOIN flow f USING (cn8_code)) p
        JOIN aff a USING (iso3)
        UNION ALL SELECT a.event_id, v.vendor_id FROM aff a JOIN vendor v ON v.country_iso3 = a.iso3) USING (event_id)
        GROUP BY 1""",
    # actions
    "action_raise_alert": f"""SELECT {_JUDGE}, event_id,
        CASE WHEN reason IS NULL THEN 'ALT-' || upper(substr(md5(request_id), 1, 16)) END AS alert_id FROM raise_j""",
    "action_alert_transitions": f"""SELECT u.request_id, u.alert_id, f.s AS "from", u.to_status AS "to",
        ({_MOVE}) IS NULL AS accepted, {_MOVE} AS reason
        FROM upd u LEFT JOIN fold f ON f.request_id = u.request_id""",
    "alert_after_updates": """SELECT a.alert_id, coalesce(x.s, a.status) AS status, coalesce(x.n, a.note) AS note,
        strftime(coalesce(x.at, a.updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM alert a LEFT JOIN (
        SELECT f.alert_id, CASE WHEN legal(f.s, f.to_status, f.note) THEN f.to_status ELSE f.s END AS s,
        CASE WHEN legal(f.s, f.to_status, f.note) THEN noted(f.n, f.requested_at, f.actor, f.to_status, f.note)
             ELSE f.n END AS n, CASE WHEN legal(f.s, f.to_status, f.note) THEN f.requested_at ELSE f.at END AS at
        FROM fold f QUALIFY row_number() OVER (PARTITION BY f.alert_id ORDER BY f.k DESC) = 1) x USING (alert_id)""",
    "action_confirm_match": f"SELECT {_JUDGE}, company_number FROM confirm_j",
    "action_reject_match": f"SELECT {_JUDGE} FROM reject_j",
    "action_set_criticality": f"SELECT {_JUDGE}, criticality FROM crit_j",
    "override_latest_wins": """SELECT vendor_id, company_number, decision, actor AS decided_by,
        strftime(requested_at, '%Y-%m-%d %H:%M:%S') AS decided_at FROM decisions
        QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY requested_at DESC, request_id DESC) = 1""",
    "action_log": "SELECT * FROM log",
    # views
    "event_list": f"""SELECT e.event_id, e.event_type, e.name, e.alert_level, e.severity, e.start_date::VARCHAR AS start_date,
        e.end_date::VARCHAR AS end_date, e.is_current, c.countries, coalesce(c.n_countries, 0) AS n_countries,
        coalesce(m.material, 0) AS material FROM ev e LEFT JOIN {COUNTRIES} c USING (event_id)
        LEFT JOIN (SELECT event_id, count(*) AS material FROM expo WHERE exposure_score >= 0.1::DOUBLE GROUP BY 1) m
        USING (event_id)""",
    "event_detail": f"""SELECT e.event_id, e.name, e.alert_level, e.start_date::VARCHAR AS start_date, c.countries
        FROM ev e LEFT JOIN {COUNTRIES} c USING (event_id)""",
    "exposure_table": """SELECT event_id, vendor_id, vendor_name, exposure_score, path_type, criticality,
        coalesce(company_name, '') AS company_name, coalesce(company_status, '') AS company_status,
        coalesce(fragility_score, -1.0::DOUBLE) AS fragility_score, coalesce(fragility_reasons, '') AS fragility_reasons,
        coalesce(alert_id, '') AS alert_id, coalesce(alert_status, '') AS alert_status, priority, hs4_description,
        driver_country_name FROM prio WHERE event_id IN (SELECT event_id FROM now)""",
    "exposure_top_n": """SELECT t.event_id, t.position, t.vendor_id, t.priority, h.hidden FROM (
        SELECT event_id, vendor_id, priority, row_number() OVER (PARTITION BY event_id
            ORDER BY priority DESC, vendor_name, vendor_id) AS position FROM prio WHERE exposure_score >= 0.1::DOUBLE
        QUALIFY position <= 60) t JOIN (SELECT event_id, count(*) FILTER (WHERE exposure_score < 0.1::DOUBLE) AS hidden
        FROM prio GROUP BY 1) h USING (event_id)""",
    "event_kpis": """SELECT event_id, count(*) AS reached, count(*) FILTER (WHERE m) AS material,
        count(*) FILTER (WHERE m AND criticality = 'high') AS high_material,
        coalesce(sum(CAST(floor(spend_12m_gbp * exposure_score * 1e4 + 0.5) AS BIGINT)) FILTER (WHERE m), 0)::DOUBLE / 1e4
        AS weighted_spend,
        count(*) FILTER (WHERE m AND alert_status IN ('open', 'acknowledged', 'mitigating')) AS in_flight
        FROM (SELECT *, exposure_score >= 0.1::DOUBLE AS m FROM prio) GROUP BY 1""",
    "default_focus": """SELECT e.event_id, f.vendor_id FROM (SELECT e.event_id FROM ev e LEFT JOIN (SELECT event_id,
        count(*) FILTER (WHERE exposure_score >= 0.1::DOUBLE) AS m FROM prio GROUP BY 1) x USING (event_id)
        ORDER BY e.is_current DESC, coalesce(x.m, 0) DESC, e.event_id LIMIT 1) e LEFT JOIN focus f USING (event_id)""",
    "supplier_detail": """SELECT v.vendor_id, v.vendor_name, k.criticality, coalesce(r.company_number, '') AS company_number,
        coalesce(r.match_method, '') AS match_method, coalesce(r.confidence, -1.0::DOUBLE) AS confidence,
        coalesce(c.name, '') AS company_name, coalesce(c.sic_codes, '') AS sic_codes,
        coalesce(c.fragility_score, -1.0::DOUBLE) AS fragility_score,
        (SELECT count(*) FROM resolves r2 WHERE r2.company_number = r.company_number AND r2.vendor_id <> v.vendor_id)
        AS duplicate_vendors
        FROM vendor v JOIN crit k USING (vendor_id) LEFT JOIN resolves r USING (vendor_id)
        LEFT JOIN company c ON c.company_number = r.company_number""",
    "supplier_alerts": """SELECT a.vendor_id, a.alert_id, a.status, strftime(a.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
        e.name AS event_name FROM alert a LEFT JOIN ev e USING (event_id)""",
    "alert_queue": """SELECT a.alert_id, a.status, strftime(a.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
        v.vendor_name, k.criticality, e.name AS event_name, e.alert_level FROM alert a JOIN vendor v USING (vendor_id)
        JOIN crit k USING (vendor_id) LEFT JOIN ev e USING (event_id)""",
    "review_queue": """SELECT vendor_id, v.vendor_name, v.postcode, v.stated_company_number, r.company_number,
        c.name AS company_name, c.postcode AS company_postcode, r.match_method, r.match_score, r.confidence
        FROM resolves r JOIN vendor v USING (vendor_id) LEFT JOIN company c ON c.company_number = r.company_number
        WHERE r.needs_review""",
    "health_report": f"""SELECT 'check' AS section, "check" AS name,
        CASE WHEN detail = '' THEN passed::VARCHAR || ': ' ELSE passed::VARCHAR || ': ' || detail END AS value
        FROM ({_checks()})
        UNION ALL SELECT 'metric', metric, value::BIGINT::VARCHAR FROM ({' UNION ALL '.join(
            f"SELECT '{m}' AS metric, CAST(({q}) AS DOUBLE) AS value" for m, q in _DQ)})
        UNION ALL SELECT 'log', request_id, action FROM (SELECT * FROM log
            ORDER BY logged_at DESC, action, params, request_id LIMIT 25)""",
    "health_summary": "SELECT * FROM log ORDER BY logged_at DESC, action, params, request_id LIMIT 25",
}

ORACLES = {name: with_tables(sql) for name, sql in QUESTIONS.items()}
