"""The registered queries as DuckDB SQL over the given tables."""

from __future__ import annotations

import re

# Views, in dependency order.
VIEWS = {
    "agencies": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation",
    "vendors": """
SELECT CAST(c_custkey AS VARCHAR) AS passport_supplier_id, c_name AS name,
       lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS fms_vendor_code,
       CASE c_custkey % 5 WHEN 0 THEN 'MBE' WHEN 1 THEN 'WBE' WHEN 2 THEN 'Non-MWBE' WHEN 3 THEN '' ELSE 'MBE/WBE' END AS certification_type,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'GROUP_' || CAST(c_custkey % 4 AS VARCHAR) END AS ethnicity,
       c_mktsegment AS business_category
FROM customer""",
    "entities": """
SELECT CAST(c_custkey AS VARCHAR) AS entity_id,
       CASE WHEN c_custkey % 2 = 0 THEN lower(replace(c_name, '#', ' ')) ELSE 'Unknown ' || c_name END AS organization_name
FROM customer""",
    "matched": """
SELECT e.*, regexp_replace(upper(e.organization_name), '[^A-Z0-9]', '', 'g') AS normalized_name,
       v.vid AS matched_vendor_id, CASE WHEN v.vid IS NOT NULL THEN 1.0::DOUBLE END AS match_score
FROM entities e LEFT JOIN (
  SELECT regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS nn, max(passport_supplier_id) AS vid FROM vendors GROUP BY 1
) v ON v.nn = regexp_replace(upper(e.organization_name), '[^A-Z0-9]', '', 'g')""",
    "solicitations": """
SELECT substr(k, 1, 5) || '-' || substr(k, 6) AS epin, k AS normalized_epin, p_name AS procurement_name,
       p_type AS main_commodity, p_brand AS procurement_method, CAST(p_partkey % 25 AS VARCHAR) AS agency_id,
       n_name AS agency, 'PROGRAM_' || p_partkey % 5 AS program, 'INDUSTRY_' || p_partkey % 6 AS industry,
       CASE p_partkey % 4 WHEN 0 THEN 'Released' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Planned' ELSE 'Archived' END AS rfx_status,
       strftime(d, '%m/%d/%Y') || CASE WHEN p_partkey % 2 = 0 THEN ' 12:00:00 AM' ELSE '' END AS release_date, d AS release_day
FROM (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'Y' AS k,
             DATE '2019-01-01' + CAST(p_partkey % 2500 AS INTEGER) AS d FROM part)
JOIN nation ON n_nationkey = p_partkey % 25""",
    "contracts": """
SELECT CAST(o_orderkey AS VARCHAR) AS ctr_id, cid AS contract_id, replace(cid, '-', '') AS normalized_contract_id,
       substr(ne, 1, 5) || '-' || substr(ne, 6) AS epin, 'Services ' || o_orderpriority AS contract_title,
       'PROGRAM_' || o_orderkey % 5 AS program, 'TYPE_' || o_orderkey % 4 AS contract_type, o_totalprice AS current_amount,
       ne AS normalized_epin, substr(ne, 1, 10) AS base_epin, c_name AS vendor_name,
       CAST(o_orderkey % 25 AS VARCHAR) AS agency_id, n_name AS agency, o_orderpriority AS procurement_method,
       o_orderstatus AS status, c_mktsegment AS industry, o_totalprice AS award_amount,
       CAST(o_totalprice AS DECIMAL(18,2)) AS award, strftime(d, '%m/%d/%Y') AS start_date,
       strftime(e, '%m/%d/%Y') AS end_date, d AS start_day, e AS end_day, o_orderkey AS okey,
       CAST(year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS start_fy,
       CAST(year(e) + CASE WHEN month(e) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS end_fy
FROM (
  SELECT *, d + CAST(o_orderkey % 2000 AS INTEGER) AS e,
    'CT1-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || CAST(year(d) AS VARCHAR) || '8'
      || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS cid,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL
         WHEN o_orderkey % 11 = 0 THEN lpad(CAST(o_orderkey % 200 AS VARCHAR), 9, '0') || 'Y'
         ELSE lpad(CAST(o_orderkey % 200 AS VARCHAR), 9, '0') || 'Y' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 3, '0') END AS ne
  FROM (SELECT *, CAST(o_orderdate + INTERVAL 24 YEAR AS DATE) AS d FROM orders)
) JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = o_orderkey % 25""",
    "notices": """
SELECT CAST(p_partkey AS VARCHAR) AS RequestID, p_type AS TypeOfNoticeDescription,
  CASE p_partkey % 8 WHEN 0 THEN 'SEE BELOW' WHEN 1 THEN '00000000' WHEN 2 THEN substr(k, 1, 5) || '-' || substr(k, 6)
    WHEN 3 THEN lower(k) WHEN 4 THEN 'line 17 below' WHEN 5 THEN ''
    WHEN 6 THEN CASE WHEN p_partkey % 16 = 14 THEN substr(k, 1, 4) || '_' || substr(k, 6, 3) ELSE '12345' END ELSE substr(k, 2, 8) END AS PIN
FROM (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'Y' AS k FROM part)""",
    "ledger": """
SELECT strftime(d, '%Y-%m-%d') AS issue_date, n.n_name AS agency,
  c_name || CASE WHEN c_custkey % 10 = 0 THEN ' CORP' ELSE '' END AS payee_name,
  CASE WHEN l_linenumber % 5 = 0 THEN 'PO' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0')
    WHEN l_linenumber = 3 AND l_orderkey % 7 = 0 THEN normalized_contract_id || 'A' ELSE normalized_contract_id END AS contract_id,
  p_type AS expense_category, c_mktsegment AS industry, l_linestatus AS spending_category, 'DEPT_' || l_suppkey % 10 AS department,
  l_returnflag AS budget_code, CASE WHEN l_linenumber = 2 THEN s_name ELSE '' END AS sub_vendor,
  CASE WHEN l_linenumber = 2 THEN c_name ELSE '' END AS associated_prime_vendor,
  CASE WHEN l_orderkey % 97 = 0 THEN 'N/A' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS check_amount,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amt,
  CAST(year(d) + CASE WHEN month(d) >= 7 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year
FROM (SELECT *, CAST(l_shipdate + INTERVAL 24 YEAR AS DATE) AS d FROM lineitem)
JOIN contracts ON okey = l_orderkey JOIN customer ON c_name = vendor_name
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation n ON n.n_nationkey = s_nationkey""",
    "digital": """
SELECT name AS vendor_name, CASE WHEN CAST(passport_supplier_id AS BIGINT) % 7 <> 0 THEN passport_supplier_id END AS matched_passport_id,
  CASE CAST(passport_supplier_id AS BIGINT) % 3 WHEN 0 THEN 'Digital' WHEN 1 THEN 'Mixed' ELSE 'Other' END AS classification,
  """ + ", ".join(f"CAST(sum(amt) FILTER (fiscal_year = {y}) AS DOUBLE) AS fy{y}" for y in range(2016, 2026)) + """
FROM vendors JOIN ledger ON payee_name = name GROUP BY name, passport_supplier_id""",
    "tech": "SELECT * FROM digital WHERE classification IN ('Digital', 'Mixed')",
    "records": """
SELECT normalized_contract_id AS prime_contract_id,
  vendor_name || CASE WHEN CAST(substr(vendor_name, 10) AS BIGINT) % 11 = 0 THEN ' INC' ELSE '' END AS prime_vendor, start_day,
  strftime(start_day, '%Y-%m-%d') AS prime_contract_start_date, CAST(award * r AS DECIMAL(18,2)) AS amt,
  CAST(CAST(award * r AS DECIMAL(18,2)) AS VARCHAR) AS prime_contract_original_amount,
  procurement_method AS prime_contract_award_method, status AS prime_contract_expense_category,
  industry AS prime_contract_industry, 'TYPE_' || CAST(okey % 4 AS VARCHAR) AS prime_contract_type,
  agency_id AS prime_vendor_mwbe_category, CAST(start_fy + r - 1 AS INTEGER) AS fiscal_year
FROM contracts JOIN (SELECT unnest([1, 2]) AS r) ON r = 1 OR okey % 2 = 0""",
    "entity_summary": """
SELECT c_name AS vendor_name, 'CITY_' || CAST(c_nationkey AS VARCHAR) AS city,
       CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS revenue FROM customer""",
}


def with_views(sql: str) -> str:
    """Prefix a statement with the views it reads, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\s+\w+\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


MSUM = "CAST(sum(award) AS DOUBLE)"


def _top_award(column: str, n: int, blank: bool = True) -> str:
    keep = f"{column} IS NOT NULL" + ("" if blank else f" AND {column} <> ''")
    return f"SELECT {column}, {MSUM} AS total FROM contracts WHERE {keep} GROUP BY 1 ORDER BY sum(award) DESC, 1 LIMIT {n}"


def _top_count(table: str, column: str, n: int) -> str:
    return f"""SELECT {column}, count(*) AS count FROM {table} WHERE {column} IS NOT NULL AND {column} <> ''
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"""


def _ranked(columns: str, source: str, groups: str, order: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT {columns}, CAST(row_number() OVER (PARTITION BY {groups} ORDER BY {order}) AS INTEGER) AS rank
FROM {source}) WHERE rank <= {n}"""


def _breakdown(table: str, column: str, total: str, n: int | None, skip_blank: bool, rank: bool) -> str:
    keep = f"WHERE {column} IS NOT NULL AND {column} <> ''" if skip_blank else ""
    limit = f"QUALIFY row_number() OVER (ORDER BY count(*) DESC, {column}) <= {n}" if n else ""
    pos = f", CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) AS INTEGER) AS rank" if rank else ""
    return f"""SELECT '{column}' AS dimension, {column} AS label, count(*) AS count{pos},
round(100.0::DOUBLE * count(*) / ({total}), 4) AS percent FROM {table} {keep} GROUP BY {column} {limit}"""


def _tech_awards(select: str, where: str, tail: str) -> str:
    return f"SELECT {select} FROM contracts c JOIN tech d ON c.vendor_name = d.vendor_name WHERE {where} {tail}"


SINCE_2022 = "c.award_amount > 0 AND length(c.start_date) = 10 AND substr(c.start_date, 7, 4) >= '2022'"
ENDS = "length(c.end_date) = 10 AND substr(c.end_date, 7, 4) BETWEEN '2026' AND '2030'"
VENDOR_STATS = """(SELECT vendor_name, count(*) AS n, CAST(sum(award) AS DOUBLE) AS total FROM contracts GROUP BY 1)"""
FY_LIST = ", ".join(f"fy{y}" for y in range(2016, 2026))
FY_NAMES = [f"fy{y}" for y in range(2016, 2026)]
PLAIN_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'),
  '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""
EPIN_KEY = "upper(replace(PIN, '-', ''))"
MAIN_AGENCY = """(SELECT contract_id, agency AS main_agency FROM (
  SELECT contract_id, agency, row_number() OVER (PARTITION BY contract_id ORDER BY count(*) DESC, agency) AS r
  FROM ledger GROUP BY 1, 2) WHERE r = 1)"""

QUERIES = {
    "agency_rollup_top_vendor": """
SELECT a.id, a.name, count(c.ctr_id) AS contract_count, CAST(sum(c.award) AS DOUBLE) AS total_amount,
  (SELECT c2.vendor_name FROM contracts c2 WHERE c2.agency_id = a.id GROUP BY 1 ORDER BY sum(c2.award) DESC, 1 LIMIT 1) AS top_vendor
FROM agencies a LEFT JOIN contracts c ON a.id = c.agency_id GROUP BY a.id, a.name""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}"
        for t in ("agencies", "vendors", "contracts", "solicitations", "notices", "ledger", "entities")
    ),
    "database_overview": f"""
SELECT 'summary' AS section, 'contracts' AS label, CAST(count(*) AS DOUBLE) AS value FROM contracts
UNION ALL SELECT 'summary', 'total_value', {MSUM} FROM contracts
UNION ALL SELECT 'summary', 'avg_value', {MSUM} / CAST(count(award) AS DOUBLE) FROM contracts
UNION ALL SELECT 'summary', 'agencies', CAST(count(DISTINCT agency) AS DOUBLE) FROM contracts
UNION ALL SELECT 'summary', 'vendors', CAST(count(DISTINCT vendor_name) AS DOUBLE) FROM contracts
UNION ALL (SELECT 'contract_status', status, CAST(count(*) AS DOUBLE) FROM contracts GROUP BY status ORDER BY count(*) DESC, status LIMIT 5)
UNION ALL (SELECT 'solicitation_status', rfx_status, CAST(count(*) AS DOUBLE) FROM solicitations GROUP BY rfx_status ORDER BY count(*) DESC, rfx_status LIMIT 5)""",
    "distinct_agencies_union": """
SELECT count(DISTINCT agency) AS agencies FROM (
  SELECT agency FROM contracts WHERE agency <> '' UNION SELECT agency FROM solicitations WHERE agency <> '')""",
    "award_by_start_year": f"""
SELECT CAST(substr(start_date, 7, 4) AS INTEGER) AS year, {MSUM} AS total FROM contracts
WHERE length(start_date) = 10 AND CAST(substr(start_date, 7, 4) AS INTEGER) BETWEEN 2022 AND 2029 GROUP BY 1""",
    "top_vendors_by_award": _top_award("vendor_name", 10),
    "top_agencies_by_award": _top_award("agency", 10),
    "top_industries": _top_award("industry", 6, False),
    "top_methods": _top_count("contracts", "procurement_method", 6),
    "total_award": f"SELECT coalesce({MSUM}, 0.0) AS total FROM contracts",
    "contract_stats_filtered": f"""
SELECT count(*) AS contract_count, {MSUM} AS total_amount, {MSUM} / CAST(count(award) AS DOUBLE) AS avg_amount,
  min(award_amount) AS min_amount, max(award_amount) AS max_amount
FROM contracts WHERE agency ILIKE '%nation_1%' AND contract_id LIKE '%2023%'""",
    "contract_status_breakdown": f"""
SELECT coalesce(nullif(status, ''), 'Unknown') AS status, count(*) AS count, {MSUM} AS total FROM contracts GROUP BY 1""",
    "agency_top10_by_count": f"""
SELECT agency, count(*) AS count, {MSUM} AS total FROM contracts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "agency_summary": f"""
SELECT agency, count(*) AS contract_count, {MSUM} AS total_amount, count(DISTINCT vendor_name) AS unique_vendors
FROM contracts GROUP BY 1""",
    "agency_top_vendors": _ranked("*", f"(SELECT agency, vendor_name, count(*) AS count, {MSUM} AS total FROM contracts WHERE year(start_day) >= 2021 GROUP BY 1, 2)", "agency", "total DESC, vendor_name", 10),
    "agency_recent": _ranked("agency, ctr_id, contract_id, vendor_name, award_amount, start_date, status", "contracts", "agency", "start_day DESC, ctr_id", 10),
    "agency_vendor_table": f"""
SELECT agency_id, vendor_name, count(*) AS contracts, {MSUM} AS amount, any_value(vid) AS vendor_id FROM contracts
LEFT JOIN (SELECT name, max(passport_supplier_id) AS vid FROM vendors GROUP BY 1) ON name = vendor_name
WHERE vendor_name <> '' GROUP BY 1, 2""",
    "agency_timeline": f"""
WITH c AS (SELECT agency_id, strftime(start_day, '%Y-%m') AS month, count(*) AS n, sum(award) AS a FROM contracts WHERE year(start_day) >= 2020 GROUP BY 1, 2),
s AS (SELECT agency_id, strftime(release_day, '%Y-%m') AS month, count(*) AS n FROM solicitations WHERE year(release_day) >= 2020 GROUP BY 1, 2)
SELECT agency_id, month, coalesce(c.n, 0) AS contract_count, CAST(coalesce(c.a, 0) AS DOUBLE) AS contract_amount,
  coalesce(s.n, 0) AS solicitation_count FROM c FULL JOIN s USING (agency_id, month)""",
    "agency_year_stats": f"""
SELECT agency_id, count(*) AS total_count, {MSUM} AS total_amount, count(*) FILTER (year(start_day) = 2025) AS year_count,
  coalesce(CAST(sum(award) FILTER (year(start_day) = 2025) AS DOUBLE), 0.0) AS year_amount FROM contracts GROUP BY 1""",
    "agency_yearly": f"""
SELECT agency_id, CAST(year(start_day) AS INTEGER) AS year, {MSUM} AS amount FROM contracts WHERE year(start_day) >= 2021 GROUP BY 1, 2""",
    "vendor_stats_breakdown": " UNION ALL ".join(
        _breakdown("vendors", c, "SELECT count(*) FROM vendors", 10, True, True)
        for c in ("certification_type", "ethnicity", "business_category")
    ),
    "solicitation_stats_breakdown": " UNION ALL ".join(
        _breakdown("solicitations", c, "SELECT count(*) FROM solicitations", n, False, False)
        for c, n in (("rfx_status", None), ("procurement_method", 10), ("agency", 10))
    ),
    "yearly_trends": f"""
SELECT * FROM (SELECT 'contract_id' AS basis, substr(contract_id, instr(contract_id, '-202') + 1, 4) AS year, count(*) AS count, {MSUM} AS total
  FROM contracts WHERE contract_id LIKE '%202%' GROUP BY 2 ORDER BY 2 DESC LIMIT 10) WHERE regexp_matches(year, '^[0-9]+$')
UNION ALL SELECT * FROM (SELECT 'start_date', CAST(year(start_day) AS VARCHAR) AS y, count(*), {MSUM} FROM contracts GROUP BY 2 ORDER BY 2 DESC LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'release_date', CAST(year(release_day) AS VARCHAR) AS y, count(*), NULL::DOUBLE FROM solicitations GROUP BY 2 ORDER BY 2 DESC LIMIT 10)""",
    "vendor_search": """
SELECT passport_supplier_id, name, coalesce(nullif(certification_type, ''), 'None') AS certification,
  coalesce(nullif(ethnicity, ''), 'N/A') AS ethnicity, coalesce(nullif(business_category, ''), 'N/A') AS category
FROM vendors WHERE name ILIKE '%customer#%7%' ORDER BY name LIMIT 100""",
    "contract_search": """
SELECT contract_id, contract_title, vendor_name, agency, award_amount, status, start_date FROM contracts
WHERE (contract_id ILIKE '%ct1%' OR contract_title ILIKE '%ct1%') AND vendor_name ILIKE '%customer%' AND agency ILIKE '%nation_2%' AND status = 'O'
ORDER BY start_day DESC, ctr_id LIMIT 100""",
    "solicitation_search": """
SELECT epin, procurement_name, agency, rfx_status, release_date, procurement_method FROM solicitations
WHERE (epin ILIKE '%ring%' OR procurement_name ILIKE '%ring%') AND rfx_status = 'Closed' AND agency ILIKE '%nation%'
ORDER BY release_day DESC, epin LIMIT 100""",
    "vendor_page": f"""
WITH f AS (SELECT v.* FROM vendors v SEMI JOIN matched m ON v.passport_supplier_id = m.matched_vendor_id
  WHERE certification_type ILIKE '%WBE%' AND (name ILIKE '%customer%' OR passport_supplier_id ILIKE '%customer%' OR fms_vendor_code ILIKE '%customer%'))
SELECT f.*, s.total AS total_awarded, coalesce(s.n, 0) AS contract_count, EXISTS (SELECT 1 FROM matched m WHERE m.matched_vendor_id = passport_supplier_id) AS in_entities,
  (SELECT count(*) FROM f) AS total_rows, CAST(ceil((SELECT count(*) FROM f) / 50.0) AS BIGINT) AS total_pages
FROM f LEFT JOIN {VENDOR_STATS} s ON s.vendor_name = f.name ORDER BY s.total DESC NULLS LAST, passport_supplier_id LIMIT 50 OFFSET 50""",
    "vendor_membership": """
SELECT passport_supplier_id, EXISTS (SELECT 1 FROM matched m WHERE m.matched_vendor_id = passport_supplier_id) AS in_entities FROM vendors""",
    "key_checks": """
SELECT ctr_id, split_part(contract_id, '-', 1) AS segment, contains(normalized_epin, base_epin) OR contains(base_epin, normalized_epin) AS contained
FROM contracts""",
    "release_days": "SELECT epin, strftime(release_day, '%m/%d/%Y') AS released FROM solicitations",
    "vendors_unmatched": """
SELECT v.* FROM vendors v ANTI JOIN matched m ON v.passport_supplier_id = m.matched_vendor_id""",
    "contracts_page": """
SELECT * FROM (SELECT base_epin, ctr_id, contract_id, normalized_contract_id, normalized_epin, vendor_name, agency_id, agency,
    epin, contract_title, program, contract_type, current_amount, procurement_method, status, industry, award_amount, start_date, end_date, count(*) OVER () AS total_rows,
    CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages, start_day
  FROM contracts WHERE status = 'F' AND base_epin IN (SELECT normalized_epin FROM solicitations)
  ORDER BY start_day DESC, ctr_id LIMIT 50 OFFSET 50)""",
    "solicitations_page": """
SELECT normalized_epin, epin, procurement_name, main_commodity, procurement_method, program, industry, agency_id, agency, rfx_status, release_date,
  '' AS due_date, count(*) OVER () AS total_rows, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages
FROM solicitations WHERE normalized_epin IN (SELECT base_epin FROM contracts WHERE base_epin IS NOT NULL)
ORDER BY release_day DESC, epin LIMIT 50""",
    "contracts_with_solicitation": """
SELECT agency, count(*) AS contracts FROM contracts WHERE base_epin IN (SELECT normalized_epin FROM solicitations) GROUP BY 1""",
    "solicitations_with_contract": """
SELECT epin, normalized_epin, agency FROM solicitations
WHERE normalized_epin IN (SELECT base_epin FROM contracts WHERE base_epin IS NOT NULL)""",
    "digital_summary": _tech_awards("count(*) AS count, CAST(sum(award) AS DOUBLE) AS total", SINCE_2022, ""),
    "digital_trend": _tech_awards("substr(c.start_date, 7, 4) AS year, CAST(sum(award) AS DOUBLE) AS total", SINCE_2022, "GROUP BY 1"),
    "digital_by_agency": _tech_awards("c.agency, CAST(sum(award) AS DOUBLE) AS total", SINCE_2022, "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"),
    "digital_vendor_table": f"""
SELECT v.*, d.classification, s.total AS total_awarded, coalesce(s.n, 0) AS contract_count,
  count(*) OVER () AS total_rows, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS total_pages
FROM vendors v JOIN tech d ON v.passport_supplier_id = d.matched_passport_id
LEFT JOIN {VENDOR_STATS} s ON s.vendor_name = v.name ORDER BY contract_count DESC, passport_supplier_id LIMIT 10""",
    "digital_contract_table": """
SELECT c.vendor_name, ctr_id, contract_id, normalized_contract_id, normalized_epin, base_epin, agency_id, agency,
  epin, contract_title, program, contract_type, current_amount, procurement_method, status, industry, award_amount, start_date, end_date, d.classification, d.matched_passport_id,
  count(*) OVER () AS total_rows, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS total_pages
FROM contracts c JOIN tech d ON c.vendor_name = d.vendor_name ORDER BY award_amount DESC, ctr_id LIMIT 10""",
    "expiring_contracts": """
SELECT contract_id, ctr_id, c.vendor_name, end_date, award_amount, d.classification, d.matched_passport_id,
  count(*) OVER () AS total_rows, CAST(ceil(count(*) OVER () / 10.0) AS BIGINT) AS total_pages
FROM contracts c JOIN tech d ON c.vendor_name = d.vendor_name
WHERE end_day >= DATE '2025-06-30' AND year(end_day) < 2030 AND award_amount > 0
ORDER BY end_day, ctr_id LIMIT 10 OFFSET 10""",
    "expiring_by_year": _tech_awards("substr(c.end_date, 7, 4) AS year, CAST(sum(award) AS DOUBLE) AS total", ENDS, "GROUP BY 1"),
    "expiring_by_agency": _tech_awards("c.agency, CAST(sum(award) AS DOUBLE) AS total", ENDS, "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"),
    "classification_stats": """
SELECT classification, count(*) AS count, CAST(sum(CAST(fy2025 AS DECIMAL(18,2))) AS DOUBLE) AS fy2025_total FROM digital GROUP BY 1""",
    "fy_trend_unpivot": f"""
SELECT replace(fy, 'fy', '') AS year,
  coalesce(CAST(sum(CAST(a AS DECIMAL(18,2))) FILTER (classification = 'Digital') AS DOUBLE), 0.0) AS digital,
  coalesce(CAST(sum(CAST(a AS DECIMAL(18,2))) FILTER (classification <> 'Digital') AS DOUBLE), 0.0) AS mixed
FROM (SELECT vendor_name, classification, unnest({FY_NAMES}) AS fy, unnest([{FY_LIST}]) AS a FROM digital) GROUP BY 1""",
    "vendor_fy_series": f"""
SELECT vendor_name, replace(fy, 'fy', '') AS year, coalesce(a, 0.0) AS amount
FROM (SELECT vendor_name, classification, unnest({FY_NAMES}) AS fy, unnest([{FY_LIST}]) AS a FROM digital)""",
    "class_top10": _ranked("classification, vendor_name, matched_passport_id, fy2025", "tech", "classification", "fy2025 DESC NULLS LAST, vendor_name", 10),
    "entity_vendor_match": "SELECT * FROM matched",
    "matched_entities": "SELECT count(matched_vendor_id) AS matched, count(*) AS entities FROM matched",
    "notice_links_exact": """
SELECT s.epin, s.agency, count(*) AS notices FROM solicitations s JOIN notices n ON n.PIN = s.epin GROUP BY 1, 2""",
    "notice_links_normalised": f"""
SELECT s.epin, s.agency, count(*) AS notices FROM solicitations s JOIN notices n ON {EPIN_KEY} = s.normalized_epin GROUP BY 1, 2""",
    "contract_notice_links": f"""
SELECT normalized_epin AS epin, count(DISTINCT contract_id) AS contracts, count(DISTINCT RequestID) AS notices
FROM contracts JOIN notices ON {EPIN_KEY} = normalized_epin GROUP BY 1""",
    "notice_links_partial": f"""
SELECT n.* FROM notices n WHERE EXISTS (SELECT 1 FROM solicitations s
  WHERE s.normalized_epin LIKE '%' || substr({EPIN_KEY}, 1, 8) || '%')""",
    "notice_links_contract_prefix": f"""
SELECT ctr_id, base_epin AS link_key, n.c AS notices FROM contracts
JOIN (SELECT {EPIN_KEY} AS k, count(*) AS c FROM notices GROUP BY 1) n ON n.k = base_epin""",
    "linkage_sample": f"""
SELECT epin, substr(procurement_name, 1, 50) AS title, RequestID, TypeOfNoticeDescription
FROM notices JOIN solicitations ON {EPIN_KEY} = normalized_epin ORDER BY epin, RequestID LIMIT 5""",
    "notice_key_sample": "SELECT DISTINCT PIN FROM notices WHERE PIN <> '' ORDER BY PIN LIMIT 10",
    "linkage_quality": f"""
SELECT 'solicitations' AS linked_to, 'exact' AS kind, count(DISTINCT epin) AS linked FROM solicitations JOIN notices ON PIN = epin
UNION ALL SELECT 'solicitations', 'normalised', count(DISTINCT epin) FROM solicitations JOIN notices ON {EPIN_KEY} = normalized_epin
UNION ALL SELECT 'contracts', 'exact', count(DISTINCT contract_id) FROM contracts SEMI JOIN notices ON PIN = epin
UNION ALL SELECT 'contracts', 'normalised', count(DISTINCT contract_id) FROM contracts SEMI JOIN notices ON {EPIN_KEY} = normalized_epin
UNION ALL SELECT 'notices', 'partial', count(*) FROM notices WHERE EXISTS (SELECT 1 FROM solicitations s
  WHERE s.normalized_epin LIKE '%' || substr({EPIN_KEY}, 1, 8) || '%')""",
    "notice_key_valid": """
SELECT RequestID, PIN, length(trim(PIN)) >= 8 AND upper(trim(PIN)) NOT IN ('NOPINFOUND', 'SEE BELOW', 'LINE 17 BELOW', 'SEE LINE 17 BELOW', 'LINE 17')
  AND replace(replace(PIN, '0', ''), '.', '') <> '' AND NOT starts_with(lower(trim(PIN)), 'see ') AND NOT starts_with(lower(trim(PIN)), 'line ') AS valid
FROM notices""",
    "load_verification": """
SELECT count(*) AS total, count(*) FILTER (PIN <> '') AS with_key, count(DISTINCT PIN) FILTER (PIN <> '') AS distinct_keys,
  count(*) FILTER (length(trim(PIN)) >= 8 AND upper(trim(PIN)) NOT IN ('NOPINFOUND', 'SEE BELOW', 'LINE 17 BELOW', 'SEE LINE 17 BELOW', 'LINE 17')
    AND replace(replace(PIN, '0', ''), '.', '') <> '' AND NOT starts_with(lower(trim(PIN)), 'see ') AND NOT starts_with(lower(trim(PIN)), 'line ')) AS valid_keys,
  (SELECT count(DISTINCT epin) FROM solicitations JOIN notices ON PIN = epin) AS linked_solicitations FROM notices""",
    "solicitation_contracts": """
WITH k AS (SELECT normalized_epin AS ne, count(*) AS n, sum(award) AS a FROM contracts WHERE normalized_epin IS NOT NULL GROUP BY 1)
SELECT s.epin, s.agency, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS contract_count, coalesce(CAST(sum(k.a) AS DOUBLE), 0.0) AS total_awarded
FROM solicitations s LEFT JOIN k ON starts_with(k.ne, s.normalized_epin) GROUP BY 1, 2""",
    "solicitation_first_contracts": _ranked(
        "s.epin, c.ctr_id, c.contract_id, c.vendor_name, c.award_amount",
        "solicitations s JOIN contracts c ON s.normalized_epin = c.base_epin AND starts_with(c.normalized_epin, s.normalized_epin)",
        "s.epin", "c.okey", 5),
    "contract_solicitation_two_tier": """
SELECT c.ctr_id, c.contract_id, c.normalized_epin, coalesce(e.epin, b.epin) AS solicitation_epin,
  CASE WHEN e.epin IS NOT NULL THEN 'exact' WHEN b.epin IS NOT NULL THEN 'base' ELSE 'none' END AS tier
FROM contracts c LEFT JOIN solicitations e ON e.normalized_epin = c.normalized_epin
LEFT JOIN solicitations b ON length(c.normalized_epin) > 10 AND b.normalized_epin = c.base_epin""",
    "contract_ledger_reconcile": f"""
WITH own AS (SELECT *, upper(replace(replace(contract_id, '-', ''), ' ', '')) AS nid FROM contracts),
paid AS (SELECT DISTINCT payee_name AS vendor_name, contract_id AS raw, upper(replace(replace(contract_id, '-', ''), ' ', '')) AS nid
  FROM ledger SEMI JOIN vendors ON name = payee_name WHERE contract_id <> ''),
hit AS (SELECT DISTINCT p.vendor_name, p.nid, CASE WHEN e.nid IS NOT NULL THEN e.nid ELSE
    (SELECT min(o.nid) FROM own o WHERE o.vendor_name = p.vendor_name AND (contains(o.nid, p.nid) OR contains(p.nid, o.nid))) END AS target
  FROM paid p LEFT JOIN (SELECT DISTINCT vendor_name, nid FROM own) e ON e.vendor_name = p.vendor_name AND e.nid = p.nid)
SELECT ctr_id, contract_id, o.vendor_name, agency, agency_id, award_amount, strftime(start_day, '%Y-%m-%d') AS start_date,
  strftime(end_day, '%Y-%m-%d') AS end_date, status,
  CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.vendor_name = o.vendor_name AND h.target = o.nid) THEN 'MOCS & Checkbook' ELSE 'MOCS' END AS source
FROM own o SEMI JOIN vendors ON name = o.vendor_name
UNION ALL
SELECT p.raw, p.raw, p.vendor_name, m.main_agency, NULL, t.total, t.f, t.l, 'Checkbook Only', 'Checkbook'
FROM paid p JOIN hit h ON h.vendor_name = p.vendor_name AND h.nid = p.nid AND h.target IS NULL
JOIN (SELECT contract_id, CAST(sum(amt) AS DOUBLE) AS total, min(issue_date) AS f, max(issue_date) AS l FROM ledger GROUP BY 1) t ON t.contract_id = p.raw
JOIN {MAIN_AGENCY} m ON m.contract_id = p.raw""",
    "ledger_contract_profiles": f"""
SELECT t.contract_id, f AS first_date, l AS last_date, total, main_agency, main_payee_name FROM
(SELECT contract_id, CAST(sum(amt) AS DOUBLE) AS total, min(issue_date) AS f, max(issue_date) AS l FROM ledger GROUP BY 1) t
JOIN {MAIN_AGENCY} a ON a.contract_id = t.contract_id
JOIN {MAIN_AGENCY.replace('main_agency', 'main_payee_name').replace('agency', 'payee_name')} p ON p.contract_id = t.contract_id""",
    "vendor_payee_match": """
WITH p AS (SELECT payee_name, count(*) AS n, sum(amt) AS a, max(issue_date) AS l FROM ledger GROUP BY 1),
x AS (SELECT name, 'exact' AS tier, payee_name FROM vendors JOIN p ON payee_name = name),
y AS (SELECT name, 'contains' AS tier, payee_name FROM vendors v JOIN p ON contains(payee_name, name)
      WHERE name NOT IN (SELECT name FROM x)),
z AS (SELECT name, tier, count(*) AS payees, sum(n) AS n, CAST(sum(a) AS DOUBLE) AS total, max(l) AS l
      FROM (SELECT * FROM x UNION ALL SELECT * FROM y) JOIN p USING (payee_name) GROUP BY 1, 2)
SELECT passport_supplier_id, v.name AS vendor_name, coalesce(tier, 'none') AS tier, coalesce(payees, 0) AS payees,
  CAST(coalesce(n, 0) AS BIGINT) AS tx_count, total, l AS last_date FROM vendors v LEFT JOIN z ON z.name = v.name""",
    "vendor_latest_transactions": """
WITH p AS (SELECT DISTINCT payee_name FROM ledger),
x AS (SELECT name, payee_name FROM vendors JOIN p ON payee_name = name),
y AS (SELECT * FROM x UNION ALL SELECT name, payee_name FROM vendors JOIN p ON contains(payee_name, name) WHERE name NOT IN (SELECT name FROM x))
SELECT name AS vendor_name, payee_name, issue_date, agency, contract_id, expense_category, check_amount, fiscal_year,
  industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY issue_date DESC, payee_name, agency, contract_id, expense_category, check_amount,
    industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor, fiscal_year) AS INTEGER) AS rank
  FROM y JOIN ledger USING (payee_name)) WHERE rank <= 500""",
    "contract_fy_spending": """
WITH r AS (SELECT ctr_id, l.fiscal_year, sum(amt) AS a, count(*) AS n FROM contracts c JOIN ledger l ON l.contract_id = c.normalized_contract_id
  AND l.fiscal_year BETWEEN start_fy - 1 AND least(end_fy + 2, 2026) GROUP BY 1, 2)
SELECT ctr_id, CAST(fiscal_year AS VARCHAR) AS fiscal_year, CAST(a AS DOUBLE) AS total, n AS tx_count FROM r
UNION ALL SELECT ctr_id, 'ALL', CAST(sum(a) AS DOUBLE), CAST(sum(n) AS BIGINT) FROM r GROUP BY 1""",
    "contract_latest_transactions": """
SELECT * FROM (SELECT ctr_id, l.contract_id, l.fiscal_year, issue_date, l.agency, payee_name, expense_category, check_amount,
  l.industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor,
  CAST(row_number() OVER (PARTITION BY ctr_id ORDER BY issue_date DESC, l.contract_id, l.fiscal_year, l.agency, payee_name, expense_category, check_amount,
    l.industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor) AS INTEGER) AS rank
  FROM contracts c JOIN ledger l ON l.contract_id = c.normalized_contract_id
  AND l.fiscal_year BETWEEN start_fy - 1 AND least(end_fy + 2, 2026)) WHERE rank <= 500""",
    "checkbook_details_link": """
SELECT ctr_id, prime_contract_id, fiscal_year, prime_vendor, prime_contract_start_date, prime_contract_original_amount,
  prime_contract_award_method, prime_contract_expense_category, prime_contract_industry, prime_contract_type, prime_vendor_mwbe_category
FROM contracts c JOIN records r ON r.prime_contract_id IN (c.normalized_contract_id, c.contract_id)
  AND r.fiscal_year BETWEEN start_fy - 1 AND least(end_fy + 2, 2026)
QUALIFY row_number() OVER (PARTITION BY ctr_id ORDER BY fiscal_year, prime_contract_id) = 1""",
    "ledger_search": """
WITH f AS (SELECT issue_date, agency AS agency_name, payee_name AS vendor_name, contract_id, expense_category,
    CAST(amt AS DOUBLE) AS check_amount, fiscal_year, industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor FROM ledger
  WHERE payee_name ILIKE '%econ%' OR agency ILIKE '%econ%' OR contract_id ILIKE '%econ%' OR expense_category ILIKE '%econ%')
SELECT *, (SELECT count(*) FROM f) > 200 AS has_next FROM f
ORDER BY issue_date DESC, agency_name, vendor_name, contract_id, expense_category, check_amount NULLS FIRST, fiscal_year,
  industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor LIMIT 100 OFFSET 100""",
    "ledger_recent_search": """
WITH f AS (SELECT issue_date, agency, payee_name, contract_id, expense_category, CAST(amt AS DOUBLE) AS check_amount FROM ledger
  WHERE fiscal_year IN (2022, 2023, 2024) AND (payee_name ILIKE '%corp%' OR agency ILIKE '%corp%' OR contract_id ILIKE '%corp%')
  ORDER BY issue_date DESC, agency, payee_name, contract_id, expense_category, check_amount NULLS FIRST LIMIT 200)
SELECT *, (SELECT coalesce(CAST(sum(CAST(check_amount AS DECIMAL(18,2))) AS DOUBLE), 0.0) FROM f) AS total_shown FROM f""",
    "vendor_ledger_by_year": """
SELECT payee_name, fiscal_year, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total, min(issue_date) AS first_tx, max(issue_date) AS last_tx
FROM ledger GROUP BY 1, 2""",
    "vendor_ledger_summary": """
SELECT count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total, min(issue_date) AS first_tx, max(issue_date) AS last_tx
FROM ledger WHERE payee_name ILIKE '%corp%'""",
    "vendor_ledger_years": """
SELECT fiscal_year, CAST(sum(amt) AS DOUBLE) AS total FROM ledger
WHERE payee_name ILIKE '%corp%' AND fiscal_year BETWEEN 2020 AND 2024 GROUP BY 1 HAVING sum(amt) <> 0""",
    "ledger_by_year_agency": """
WITH g AS (SELECT fiscal_year, agency, count(*) AS n, sum(amt) AS a FROM ledger GROUP BY 1, 2)
SELECT * FROM (SELECT fiscal_year, CAST(row_number() OVER (PARTITION BY fiscal_year ORDER BY a DESC NULLS LAST, agency) AS INTEGER) AS rank, agency,
  CAST(a AS DOUBLE) AS total, CAST(sum(n) OVER (PARTITION BY fiscal_year) AS BIGINT) AS tx_count,
  CAST(sum(a) OVER (PARTITION BY fiscal_year) AS DOUBLE) AS year_total FROM g) WHERE rank <= 10""",
    "chart_spending_by_agency": """
SELECT substr(agency, 1, 30) AS label, round(t / 1e9, 2) AS value FROM (
  SELECT agency, CAST(sum(amt) AS DOUBLE) AS t FROM ledger WHERE fiscal_year = 2024 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
    "chart_spending_by_year": """
SELECT 'FY' || fiscal_year AS label, round(CAST(sum(amt) AS DOUBLE) / 1e9, 2) AS value FROM ledger
WHERE fiscal_year BETWEEN 2020 AND 2024 GROUP BY fiscal_year""",
    "ledger_monthly_last12": """
SELECT substr(issue_date, 1, 7) AS month, CAST(sum(amt) AS DOUBLE) AS total FROM ledger GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
    "unique_contract_year_totals": """
WITH pc AS (SELECT prime_vendor, prime_contract_id, min(start_day) AS s, max(amt) AS a FROM records GROUP BY 1, 2),
x AS (SELECT DISTINCT name, prime_vendor, 'exact' AS tier FROM vendors JOIN pc ON prime_vendor = name),
y AS (SELECT DISTINCT name, prime_vendor, 'wildcard' AS tier FROM vendors JOIN (SELECT DISTINCT prime_vendor FROM pc)
  ON prime_vendor LIKE CASE WHEN contains(name, ' CORP') THEN replace(name, ' CORP', '%') ELSE name || '%' END
  WHERE length(name) > 5 AND name NOT IN (SELECT prime_vendor FROM pc)),
u AS (SELECT name, tier, prime_contract_id, min(s) AS s, max(a) AS a FROM (SELECT * FROM x UNION ALL SELECT * FROM y) JOIN pc USING (prime_vendor) GROUP BY 1, 2, 3)
SELECT name AS vendor_name, tier, CAST(year(s) AS INTEGER) AS year, CAST(sum(a) AS DOUBLE) AS total FROM u GROUP BY 1, 2, 3""",
    "vendor_award_years": f"""
SELECT vendor_name, CAST(year(start_day) AS INTEGER) AS year, {MSUM} AS total FROM contracts GROUP BY 1, 2 HAVING sum(award) <> 0""",
    "contract_characteristics": """
WITH k AS (SELECT *, max(amt) OVER (PARTITION BY prime_vendor, prime_contract_id) AS a FROM records
  WHERE prime_vendor IN (SELECT vendor_name FROM tech)
  QUALIFY row_number() OVER (PARTITION BY prime_vendor, prime_contract_id ORDER BY fiscal_year DESC) = 1)
""" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS label, count(*) AS count, CAST(sum(a) AS DOUBLE) AS amount FROM k GROUP BY {d}"
        for d in ("prime_contract_award_method", "prime_contract_expense_category", "prime_contract_industry",
                  "prime_contract_type", "prime_vendor_mwbe_category")),
    "vendor_profile": f"""
WITH names AS (SELECT name, passport_supplier_id AS id FROM vendors),
sup AS (SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS vendor_name, count(*) AS n FROM supplier GROUP BY 1),
rel AS (SELECT 'Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS vendor_name, count(*) AS n FROM part GROUP BY 1),
ent AS (SELECT matched_vendor_id, min(normalized_name) AS nn FROM matched WHERE matched_vendor_id IS NOT NULL GROUP BY 1),
ppl AS (SELECT upper(replace(vendor_name, '#', '')) AS org, n FROM sup),
tid AS (SELECT matched_passport_id AS id, min(classification) AS c FROM digital WHERE matched_passport_id IS NOT NULL GROUP BY 1),
tnm AS (SELECT vendor_name, min(classification) AS c FROM digital GROUP BY 1)
SELECT v.id AS passport_supplier_id, v.name, coalesce(s.n, 0) AS contract_count, coalesce(s.total, 0.0) AS total_awarded,
  (SELECT count(*) FROM customer o WHERE o.c_name = v.name) AS other_names, coalesce(s.n, 0) AS evaluations, coalesce(sup.n, 0) AS principals, coalesce(rel.n, 0) AS related_entities,
  coalesce(ppl.n, 0) AS people, es.city, es.revenue,
  CASE WHEN CAST(v.id AS BIGINT) % 5 <> 0 THEN lpad(v.id, CAST(greatest(8, length(v.id)) AS INTEGER), '0') END AS company_number,
  coalesce(tid.c, tnm.c) AS tech_class
FROM names v LEFT JOIN {VENDOR_STATS} s ON s.vendor_name = v.name LEFT JOIN sup ON sup.vendor_name = v.name
LEFT JOIN rel ON rel.vendor_name = v.name LEFT JOIN ent ON ent.matched_vendor_id = v.id
LEFT JOIN ppl ON ppl.org = coalesce(ent.nn, regexp_replace(upper(v.name), '[^A-Z0-9]', '', 'g'))
LEFT JOIN entity_summary es ON es.vendor_name = v.name LEFT JOIN tid ON tid.id = v.id LEFT JOIN tnm ON tnm.vendor_name = v.name""",
    "vendor_profile_children": """
SELECT passport_supplier_id, name AS vendor_name, 'other_names' AS section, '{"type":"DBA","other_name":"' || upper(name) || '"}' AS record FROM vendors
UNION ALL SELECT passport_supplier_id, name, 'evaluations', '{"agency":"' || agency || '","contract_id":"' || contract_id || '","eval_date":"' || end_date || '","rating":"' || procurement_method || '"}' FROM contracts JOIN vendors ON name = vendor_name
UNION ALL SELECT passport_supplier_id, name, 'principals', '{"principal_name":"' || s_name || '","title":"Owner"}' FROM supplier JOIN vendors ON name = 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
UNION ALL SELECT passport_supplier_id, name, 'related_entities', '{"related_entity_name":"' || p_name || '","relationship":"' || p_brand || '"}' FROM part JOIN vendors ON name = 'Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')""",
    "contract_vendor_recent": """
WITH r AS (SELECT vendor_name, contract_id, award, row_number() OVER (PARTITION BY vendor_name ORDER BY start_day DESC, ctr_id) AS k FROM contracts)
SELECT passport_supplier_id, name, count(r.k) AS contract_count, coalesce(CAST(sum(award) AS DOUBLE), 0.0) AS total_awarded,
  string_agg(contract_id, ', ' ORDER BY k) FILTER (k <= 5) AS recent
FROM vendors LEFT JOIN r ON vendor_name = name GROUP BY 1, 2""",
    "contract_vendor_link": """
SELECT ctr_id, contract_id, c.vendor_name, v.passport_supplier_id AS vendor_id FROM contracts c LEFT JOIN vendors v ON v.name = c.vendor_name""",
    "ledger_latest_per_payee": """
SELECT * FROM (SELECT payee_name, issue_date, agency, contract_id, expense_category, check_amount, fiscal_year,
  industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor,
  CAST(row_number() OVER (PARTITION BY payee_name ORDER BY issue_date DESC, agency, contract_id, expense_category, check_amount,
    industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor, fiscal_year) AS INTEGER) AS rank
  FROM ledger) WHERE rank <= 500""",
    "first_wins_dedupe": """
SELECT normalized_epin, ctr_id, contract_id, agency FROM contracts WHERE normalized_epin IS NULL
UNION ALL SELECT normalized_epin, ctr_id, contract_id, agency FROM contracts WHERE normalized_epin IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY normalized_epin ORDER BY okey) = 1""",
    "agency_dimension": """
SELECT id, name FROM (SELECT agency_id AS id, agency AS name, 0 AS feed, epin AS o FROM solicitations
  UNION ALL SELECT agency_id, agency, 1, ctr_id FROM contracts) WHERE id <> '' AND name <> ''
QUALIFY row_number() OVER (PARTITION BY id ORDER BY feed, o) = 1""",
    "money_key_cleaning": r"""
WITH t AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents),
u AS (SELECT token, count(*) AS occurrences FROM t WHERE token <> '' GROUP BY 1)
SELECT token, occurrences, regexp_replace(upper(replace(token, 'ß', 'SS')), '[^A-Z0-9]', '', 'g') AS normalized_key,
  coalesce(TRY_CAST(regexp_replace(token, '[^0-9.]', '', 'g') AS DOUBLE), 0.0) AS money,
  upper(replace(replace(replace(token, 'ß', 'SS'), '-', ''), ' ', '')) AS compact_key, replace(token, '-', '') AS hyphenless
FROM u""",
    "post_excerpts": f"""
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, length({PLAIN_TEXT}) AS text_length,
  substr({PLAIN_TEXT}, 1, 200) || '...' AS excerpt FROM pages""",
    "posts_newest": r"""
SELECT slug, title, date FROM (SELECT CAST(page_id AS VARCHAR) AS slug, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), E' \t\r\n') AS title,
  strftime(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER), '%Y-%m-%d') AS date, page_id FROM pages)
ORDER BY date DESC, slug LIMIT 3""",
    "numeric_aware_sort_key": """
SELECT check_amount AS cell, TRY_CAST(CASE WHEN regexp_matches(lower(check_amount), '^[0-9]') THEN regexp_replace(lower(check_amount), '[^0-9.-]+', '', 'g') END AS DOUBLE) AS number_key,
  lower(check_amount) AS text_key, count(*) AS cells FROM ledger GROUP BY 1, 2, 3""",
    "display_labels": """
SELECT ctr_id, '$' || format('{:,.2f}', award_amount) AS amount_text, substr(contract_id, 1, 12) AS title,
  strftime(start_day, '%m/%d/%Y') AS start_text, coalesce(nullif(status, ''), 'N/A') AS status_text, 'FY' || start_fy AS fy_label,
  'Procurement Method' AS method_label, 'MOCS' AS source, format('{:,}', okey) AS count_text
FROM contracts""",
    "vendor_profile_tool": """
WITH r AS (SELECT contract_id, award, row_number() OVER (ORDER BY start_day DESC, ctr_id) AS k FROM contracts WHERE vendor_name = 'Customer#000000007')
SELECT passport_supplier_id, name, coalesce(nullif(certification_type, ''), 'None') AS certification, coalesce(nullif(ethnicity, ''), 'N/A') AS ethnicity,
  coalesce(nullif(business_category, ''), 'N/A') AS category, (SELECT count(*) FROM r) AS contract_count,
  coalesce((SELECT CAST(sum(award) AS DOUBLE) FROM r), 0.0) AS total_awarded, (SELECT string_agg(contract_id, ', ' ORDER BY k) FROM r WHERE k <= 5) AS recent
FROM vendors WHERE passport_supplier_id = '7'""",
    "contract_details": """
SELECT c.ctr_id, c.contract_id, c.normalized_contract_id, c.epin, c.normalized_epin, c.base_epin, contract_title, program, contract_type, current_amount,
  vendor_name, agency_id, agency, procurement_method, status, industry, award_amount, start_date, end_date, s.epin AS solicitation_epin,
  CASE WHEN s.epin IS NULL THEN 'none' WHEN s.normalized_epin = c.normalized_epin THEN 'exact' ELSE 'base' END AS tier
FROM contracts c LEFT JOIN (SELECT epin, normalized_epin FROM solicitations) s
  ON s.normalized_epin = c.normalized_epin OR length(c.normalized_epin) > 10 AND s.normalized_epin = c.base_epin
WHERE c.ctr_id = '15' OR c.contract_id = '15'""",
    "solicitation_details": """
SELECT s.epin, s.procurement_name, (SELECT count(*) FROM contracts WHERE starts_with(normalized_epin, '000000012Y')) AS contract_count,
  (SELECT coalesce(CAST(sum(award) AS DOUBLE), 0.0) FROM contracts WHERE starts_with(normalized_epin, '000000012Y')) AS total_awarded
FROM solicitations s WHERE s.epin = '00000-0012Y'""",
    "agency_contracts_top_vendors": f"""
SELECT vendor_name, count(*) AS count, {MSUM} AS total FROM contracts WHERE agency ILIKE '%nation_3%' GROUP BY 1 ORDER BY sum(award) DESC, 1 LIMIT 5""",
    "agency_contracts_recent": """
SELECT ctr_id, agency, vendor_name, start_date FROM contracts WHERE agency ILIKE '%nation_3%' ORDER BY start_day DESC, ctr_id LIMIT 10""",
    "vendor_detail_transactions": """
SELECT 'Customer#000000010' AS vendor_name, payee_name, issue_date, check_amount, CAST(row_number() OVER (ORDER BY issue_date DESC, payee_name, agency, contract_id,
  expense_category, check_amount, industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor, fiscal_year) AS INTEGER) AS rank
FROM ledger WHERE contains(payee_name, 'Customer#000000010') QUALIFY rank <= 500""",
    "contract_detail_spending": """
WITH r AS (SELECT ctr_id, l.fiscal_year, sum(amt) AS a, count(*) AS n FROM contracts c JOIN ledger l ON l.contract_id = c.normalized_contract_id
  AND l.fiscal_year BETWEEN start_fy - 1 AND least(end_fy + 2, 2026) WHERE ctr_id = '15' GROUP BY 1, 2)
SELECT ctr_id, CAST(fiscal_year AS VARCHAR) AS fiscal_year, CAST(a AS DOUBLE) AS total, n AS tx_count FROM r
UNION ALL SELECT ctr_id, 'ALL', CAST(sum(a) AS DOUBLE), CAST(sum(n) AS BIGINT) FROM r GROUP BY 1""",
    "contract_or_ledger": """
SELECT ctr_id, contract_id, agency, vendor_name, award_amount, start_date, end_date, status FROM contracts WHERE ctr_id = '15'""",
    "chart_contracts_by_agency": """
SELECT substr(agency, 1, 25) AS label, count(*) AS value FROM contracts GROUP BY agency ORDER BY 2 DESC, agency LIMIT 10""",
    "chart_contracts_by_status": """
SELECT coalesce(nullif(status, ''), 'Unknown') AS label, count(*) AS value FROM contracts GROUP BY 1""",
    "chart_series_industries": """
SELECT string_agg(industry, '|' ORDER BY t DESC, industry) AS labels, CAST(count(*) AS INTEGER) AS n
FROM (SELECT industry, sum(award) AS t FROM contracts WHERE industry <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)""",
    "contract_title_search": """
SELECT ctr_id, contract_title, count(*) OVER () AS total_rows, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages FROM contracts
WHERE contract_id ILIKE '%services 1%' OR normalized_contract_id ILIKE '%services 1%' OR contract_title ILIKE '%services 1%'
ORDER BY start_day DESC, ctr_id LIMIT 50""",
    "solicitation_industry_page": """
SELECT epin, industry, count(*) OVER () AS total_rows, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages FROM solicitations
WHERE industry = 'INDUSTRY_2' ORDER BY release_day DESC, epin LIMIT 50""",
    "contracts_page_after": """
SELECT ctr_id, award_amount, agency FROM contracts WHERE award_amount < 200000.0 OR award_amount = 200000.0 AND ctr_id > ''
ORDER BY award_amount DESC, ctr_id LIMIT 50""",
    "notice_links_segment": f"""
SELECT ctr_id, base_epin AS link_key, n.c AS notices FROM contracts
JOIN (SELECT {EPIN_KEY} AS k, count(*) AS c FROM notices GROUP BY 1) n ON n.k = base_epin""",
    "contract_notice_links_exact": """
SELECT epin, count(DISTINCT contract_id) AS contracts, count(DISTINCT RequestID) AS notices FROM contracts JOIN notices ON PIN = epin GROUP BY 1""",
    "post_by_slug": r"""
SELECT CAST(page_id AS VARCHAR) AS slug, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), E' \t\r\n') AS title,
  strftime(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER), '%Y-%m-%d') AS date FROM pages WHERE page_id = 7""",
    "csv_entities_roundtrip": """
SELECT organization_name, regexp_replace(upper(organization_name), '[^A-Z0-9]', '', 'g') AS normalized_name FROM entities""",
    "csv_people_roundtrip": """
SELECT CAST(s_suppkey AS VARCHAR) AS mocs_peopleid, s_name AS last_name, 'CUSTOMER' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS normalized_org_name FROM supplier""",
    "csv_notices_roundtrip": "SELECT RequestID, TypeOfNoticeDescription, PIN FROM notices",
    "csv_contract_duplicates": """
SELECT status, CAST(count(*) * CASE WHEN status = 'F' THEN 2 ELSE 1 END AS BIGINT) AS rows, count(*) AS contracts FROM contracts GROUP BY status""",
    "csv_evaluations_roundtrip": """
SELECT vendor_name, procurement_method AS rating, count(*) AS evaluations, max(contract_id) AS last_id FROM contracts GROUP BY 1, 2""",
    "ledger_year_files": """
SELECT fiscal_year, agency, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total FROM ledger WHERE fiscal_year IN (2022, 2023) GROUP BY 1, 2""",
    "contract_record_years": """
SELECT fiscal_year, count(*) AS records, count(DISTINCT prime_vendor) AS vendors FROM records GROUP BY 1""",
    "landing_json": """
SELECT CAST(fiscal_year AS VARCHAR) AS fiscal_year, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total FROM ledger GROUP BY 1""",
    "export_roundtrip": """
SELECT coalesce(nullif(status, ''), 'Unknown') AS status, count(*) AS count FROM contracts GROUP BY 1""",
    "parquet_sources": """
SELECT fiscal_year, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total,
  count(*) FILTER (fiscal_year = 2025) AS with_department FROM ledger GROUP BY 1""",
    "csv_vendors_roundtrip": "SELECT * FROM vendors",
    "csv_contracts_roundtrip": """
SELECT ctr_id, contract_id, normalized_contract_id, normalized_epin, base_epin, vendor_name, award_amount, start_date FROM contracts""",
    "csv_solicitations_roundtrip": """
SELECT epin, normalized_epin, procurement_name, agency, rfx_status, release_date FROM solicitations""",
    "csv_valid_notices": """
SELECT RequestID, PIN FROM notices WHERE length(trim(PIN)) >= 8
  AND upper(trim(PIN)) NOT IN ('NOPINFOUND', 'SEE BELOW', 'LINE 17 BELOW', 'SEE LINE 17 BELOW', 'LINE 17')
  AND replace(replace(PIN, '0', ''), '.', '') <> '' AND NOT starts_with(lower(trim(PIN)), 'see ') AND NOT starts_with(lower(trim(PIN)), 'line ')""",
    "csv_line_counts": """
SELECT 'vendors' AS dataset, count(*) AS record_count FROM vendors UNION ALL SELECT 'contracts', count(*) FROM contracts""",
    "freshness_rollup": """
SELECT 'ledger' AS dataset, CAST(sum(n) AS BIGINT) AS total_records, CAST(sum(CASE WHEN fiscal_year = 2026 THEN n // 2 ELSE n END) AS BIGINT) AS downloaded,
  max(l) AS last_updated, CASE WHEN bool_or(fiscal_year = 2026 AND n // 2 < n) THEN 'In Progress' ELSE 'Up to Date' END AS status,
  '2026-01-02 02:00:00' AS next_update
FROM (SELECT fiscal_year, count(*) AS n, max(issue_date) AS l FROM ledger GROUP BY 1)""",
    "ledger_stream_ingest": """
SELECT fiscal_year, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total, count(DISTINCT contract_id) AS contract_ids,
  count(DISTINCT payee_name) AS payees FROM ledger GROUP BY 1""",
    "ledger_stream_monthly": """
SELECT substr(issue_date, 1, 7) AS month, CAST(sum(amt) AS DOUBLE) AS total, count(*) AS tx_count FROM ledger GROUP BY 1""",
    "ledger_deep_page": """
WITH f AS (SELECT issue_date, agency AS agency_name, payee_name AS vendor_name, contract_id, expense_category,
    CAST(amt AS DOUBLE) AS check_amount, fiscal_year, industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor FROM ledger)
SELECT *, (SELECT count(*) FROM f) > 40100 AS has_next FROM f
ORDER BY issue_date DESC, agency_name, vendor_name, contract_id, expense_category, check_amount NULLS FIRST, fiscal_year,
  industry, spending_category, department, budget_code, sub_vendor, associated_prime_vendor LIMIT 100 OFFSET 40000""",
    "amount_labels": """
SELECT 'Program ' || split_part(program, '_', 2) AS program_label,
  format('{:.1f}%', 100.0::DOUBLE * CAST(sum(award) AS DOUBLE) / (SELECT CAST(sum(award) AS DOUBLE) FROM contracts)) AS share_text,
  format('${:.1f}M', CAST(sum(award) AS DOUBLE) / 1e6) AS millions_text, strftime(max(start_day), '%m/%d/%Y') AS last_text FROM contracts GROUP BY program""",
    "key_containment": """
SELECT ctr_id, contains(normalized_epin, agency_id) OR contains(agency_id, normalized_epin) AS contained FROM contracts WHERE normalized_epin IS NOT NULL""",
    "entity_last_vendor": """
SELECT entity_id, CASE WHEN matched_vendor_id IS NULL THEN NULL
  WHEN CAST(matched_vendor_id AS BIGINT) % 5 = 0 THEN matched_vendor_id || '-2' ELSE matched_vendor_id END AS matched_vendor_id FROM matched""",
    "registry_numbers": """
SELECT CAST(c_custkey AS VARCHAR) AS passport_vendor_id, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS registered_name,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS company_number, CAST(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 + 1970 END AS INTEGER) AS filed_year,
  CAST(NULL AS INTEGER) AS missing FROM customer""",
    "vendor_category_page": f"""
WITH f AS (SELECT * FROM vendors WHERE business_category = 'BUILDING')
SELECT f.*, s.total AS total_awarded, coalesce(s.n, 0) AS contract_count, EXISTS (SELECT 1 FROM matched m WHERE m.matched_vendor_id = passport_supplier_id) AS in_entities,
  (SELECT count(*) FROM f) AS total_rows, CAST(ceil((SELECT count(*) FROM f) / 50.0) AS BIGINT) AS total_pages
FROM (SELECT * FROM f ORDER BY name, passport_supplier_id LIMIT 50 OFFSET 50) f LEFT JOIN {VENDOR_STATS} s ON s.vendor_name = f.name""",
    "expiring_today": """
SELECT contract_id, ctr_id, end_date, d.classification, count(*) OVER () AS total_rows
FROM contracts c JOIN tech d ON c.vendor_name = d.vendor_name
WHERE end_day >= current_date AND year(end_day) < 2030 AND award_amount > 0 ORDER BY end_day, ctr_id LIMIT 10""",
    "dataset_listing": """
SELECT 'Vendors' AS name, format('{:,}', count(*)) AS record_count, '2026-01-02 02:00:00' AS next_update, false AS not_found FROM vendors
UNION ALL SELECT 'Contracts', format('{:,}', count(*)), '2026-01-02 02:00:00', false FROM contracts
UNION ALL SELECT 'Nothing', '-', '2026-01-02 02:00:00', true""",
    "ledger_stream_broken_batch": """
SELECT fiscal_year, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total, count(DISTINCT payee_name) AS payees FROM ledger GROUP BY 1""",
    "ledger_stream_folded_months": """
SELECT substr(issue_date, 1, 7) AS month, CAST(sum(amt) AS DOUBLE) AS total, count(*) AS tx_count FROM ledger GROUP BY 1""",
    "paged_delta_ingest": """
SELECT fiscal_year, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total FROM ledger GROUP BY 1""",
    "landing_xml": """
SELECT CAST(fiscal_year AS VARCHAR) AS fiscal_year, count(*) AS tx_count, CAST(sum(amt) AS DOUBLE) AS total FROM ledger GROUP BY 1""",
    "ledger_source_choice": """
SELECT fiscal_year, count(*) AS tx_count, CASE WHEN fiscal_year % 2 = 0 THEN 'local' ELSE 'remote' END AS source FROM ledger GROUP BY 1""",
    "post_files": r"""
SELECT CAST(page_id AS VARCHAR) AS slug, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), E' \t\r\n') AS title,
  strftime(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER), '%Y-%m-%d') AS date, '' AS author FROM pages""",
}

# One vendor's merged contracts are its rows of the merged contracts of all.
QUERIES["vendor_detail_contracts"] = (
    f"SELECT * FROM ({with_views(QUERIES['contract_ledger_reconcile'])}) WHERE vendor_name = 'Customer#000000007'")

# The same questions over vendors and payments that the views name otherwise.
QUERIES["award_years_of_corps"] = (
    "WITH corps AS (SELECT name || ' CORP' AS name FROM vendors WHERE CAST(passport_supplier_id AS BIGINT) % 7 = 0),"
    + QUERIES["unique_contract_year_totals"].strip().removeprefix("WITH").replace("FROM vendors", "FROM corps"))
QUERIES["reconcile_cut_ids"] = (
    "WITH cut AS (SELECT * REPLACE (CASE WHEN ends_with(contract_id, '3') THEN left(contract_id, -1) ELSE contract_id END AS contract_id) FROM ledger),"
    + QUERIES["contract_ledger_reconcile"].strip().removeprefix("WITH").replace("FROM ledger", "FROM cut"))


def oracle_sql() -> dict[str, str]:
    return {key: with_views(sql) for key, sql in QUERIES.items()}
