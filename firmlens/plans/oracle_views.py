"""The derived tables of ``views`` once more, as DuckDB SQL for checking."""

_HOST = r"replace(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '')"


def pick(names: str, index: str) -> str:
    items = ", ".join(f"'{n}'" for n in names.split())
    return f"([{items}])[{index}]"


VIEW_SQL: dict[str, tuple[str, str]] = {
    "req": ("", """SELECT event_id, epoch_us(ts) AS us, user_id AS client, event_type AS endpoint, value AS ms,
        event_type = 'error' AS is_error, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS agent FROM events"""),
    "metric": ("", "SELECT event_id, event_type AS name, value, epoch_us(ts) AS us FROM events"),
    "page": ("", r"""SELECT page_id, url, html,
        regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme,
        """ + _HOST.format("url") + r""" AS host,
        regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS lang,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
        trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'),
          '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')) AS text
        FROM pages"""),
    "company": ("", """SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS industry, n_name AS country,
        r_name AS region, round(abs(c_acctbal) * 100000, 2) AS valuation,
        round(coalesce(spent, 0.0), 2) AS revenue,
        CAST(coalesce(n_orders, 0) * (c_custkey % 40 + 1) * 7 AS BIGINT) AS employees,
        CAST(1990 + c_custkey % 34 AS INT) AS founded_year,
        CASE WHEN c_custkey % 3 <> 0 THEN 'https://www.customer' || c_custkey || '.com' END AS website,
        CASE WHEN c_custkey % 4 <> 0 THEN 'sales' || c_custkey || '@customer' || c_custkey || '.com' END AS email,
        CASE WHEN c_custkey % 5 <> 0 THEN '+1-555-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-'
          || lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0') END AS phone,
        CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 900 + 10) || ' Main Street' END AS address,
        CASE WHEN c_custkey % 8 <> 0 THEN 'City' || (c_custkey % 50) END AS city,
        CASE WHEN c_custkey % 9 <> 0 THEN 'S' || chr(CAST(65 + c_custkey % 26 AS INT)) END AS state,
        CASE WHEN c_custkey % 7 <> 0 THEN c_name || ' provides ' || lower(c_mktsegment)
          || repeat(' goods and services', c_custkey % 12) END AS description,
        CASE c_custkey % 4 WHEN 0 THEN '' || CAST(coalesce(n_orders, 0) * (c_custkey % 40 + 1) * 7 AS BIGINT)
          WHEN 1 THEN CAST(coalesce(n_orders, 0) * (c_custkey % 40 + 1) * 7 AS BIGINT) || '-' ||
            CAST(coalesce(n_orders, 0) * (c_custkey % 40 + 1) * 14 AS BIGINT)
          WHEN 2 THEN CAST(coalesce(n_orders, 0) * (c_custkey % 40 + 1) * 7 AS BIGINT) || '+' END AS employee_text,
        CASE c_custkey % 5 WHEN 0 THEN '$' || (c_custkey % 90 + 1) || '.5 billion'
          WHEN 1 THEN '$' || (c_custkey % 900 + 1) || 'M' WHEN 2 THEN (c_custkey % 700 + 1) || ',500K'
          WHEN 3 THEN (c_custkey % 50 + 1) || '.25B' END AS money_text,
        CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_public,
        CAST(c_custkey % 4 AS INT) AS n_social, CAST(c_custkey % 3 AS INT) AS n_people,
        CASE WHEN c_custkey % 3 = 1 THEN 'Ann Lee ' || c_custkey END AS ceo_name,
        CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN 'Chief Executive Officer, CEO'
          WHEN c_custkey % 6 = 2 THEN 'Founder' WHEN c_custkey % 6 = 4 THEN 'CEO' ELSE 'Head of Sales' END AS lead_title,
        (c_custkey % 11) / 10.0::DOUBLE AS confidence, (c_custkey % 7) / 6.0::DOUBLE AS quality,
        (c_custkey % 13) / 12.0::DOUBLE AS completeness
        FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent
            FROM orders GROUP BY 1) o ON o_custkey = c_custkey
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "batch_item": ("", """SELECT o_custkey % 50 AS batch_id, o_orderkey AS pos,
        (CASE WHEN o_orderkey % 3 = 0 THEN 'CUSTOMER ' ELSE ' Customer ' END) || o_custkey ||
        (CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE '' END) AS company, o_custkey AS company_id,
        o_orderstatus AS status_code, o_orderstatus = 'F' AS success,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '5' THEN 'low'
          ELSE 'normal' END AS priority,
        o_totalprice / 1000 AS seconds, epoch_us(o_orderdate) AS created_us,
        (o_orderkey % 90 + 10) / 100.0::DOUBLE AS confidence,
        CASE WHEN o_orderkey % 6 <> 0 THEN 'industry' || (o_custkey % 5) END AS industry,
        """ + pick("startup small medium large enterprise", "o_custkey % 5 + 1") + """ AS company_size,
        o_orderkey % 3 <> 0 AS has_contact, CAST(o_orderkey % 4 AS INT) AS n_social,
        CAST(o_orderkey % 5 AS INT) AS n_people FROM orders"""),
    "serp": ("page", """SELECT lang AS query, CAST((rank_all - 1) // 10 + 1 AS INT) AS page,
        CAST((rank_all - 1) % 10 + 1 AS INT) AS rank, page_id, url, host, title
        FROM (SELECT *,
          row_number() OVER (PARTITION BY lang ORDER BY page_id) AS rank_all FROM page)"""),
    "source_record": ("", """SELECT l_partkey AS company,
        concat_ws('/', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, lpad(l_suppkey::VARCHAR, 8, '0'),
          lpad(CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR, 12, '0'),
          lpad(CAST(l_quantity AS BIGINT)::VARCHAR, 3, '0'), epoch_us(l_shipdate)::VARCHAR) AS source,
        round(l_discount * 8 + 0.1, 2) AS confidence, round(l_tax * 10, 2) AS quality,
        round(l_quantity / 50, 2) AS completeness,
        CASE WHEN l_orderkey % 3 <> 0 THEN 'about ' || l_orderkey END AS description,
        CASE WHEN l_orderkey % 4 <> 0 THEN CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE 'industry' || (l_suppkey % 7) END END AS industry,
        CASE WHEN l_orderkey % 5 <> 0 THEN 'sector' || (l_suppkey % 5) END AS sector,
        CASE WHEN l_suppkey % 3 <> 0 THEN CAST(1900 + l_orderkey % 120 AS INT) END AS founded_year,
        CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_quantity * 10 AS INT) END AS employee_count,
        CASE WHEN l_suppkey % 2 <> 0 THEN 'HQ ' || (l_suppkey % 20) END AS headquarters,
        'Office ' || (l_orderkey % 15) AS location,
        CASE WHEN l_orderkey % 2 <> 0 THEN 'mail' || l_orderkey || '@x.com' END AS email,
        CASE WHEN l_suppkey % 5 <> 0 THEN '555-' || l_orderkey END AS phone,
        CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey || ' Oak Road' END AS address,
        CASE WHEN l_linenumber % 3 <> 0 THEN 'City' || (l_suppkey % 30) END AS city,
        'State' || (l_suppkey % 9) AS state, CASE WHEN l_linenumber % 2 <> 0 THEN 'Country' || (l_suppkey % 4) END AS country,
        CASE WHEN l_suppkey % 2 <> 0 THEN lpad((l_orderkey % 100000)::VARCHAR, 5, '0') END AS postal_code, CASE WHEN l_linenumber % 2 <> 0 THEN 'https://c' || l_partkey || '.com' END AS website,
        CASE WHEN l_suppkey % 3 <> 0 THEN 'S' || (l_suppkey % 50) END AS stock_symbol, CASE WHEN l_orderkey % 4 <> 0 THEN CAST(l_quantity AS BIGINT) || ' million' END AS funding,
        CASE WHEN l_orderkey % 5 <> 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_quantity AS BIGINT) || ' billion' END END AS valuation,
        """ + pick("linkedin twitter facebook instagram youtube github tiktok", "l_linenumber") + """ AS platform,
        'https://social/' || l_orderkey AS profile_url, l_returnflag = 'R' AS verified,
        (CASE WHEN l_orderkey % 2 = 0 THEN ' Person ' ELSE 'PERSON ' END) || (l_suppkey % 40) AS person,
        CASE WHEN l_linenumber % 2 = 0 THEN 'CEO' ELSE 'CTO' END AS person_title FROM lineitem"""),
    "data_record": ("", """SELECT o_orderkey AS record_id, o_custkey AS subject_id,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'personal_identifiable' WHEN '2' THEN 'business_data'
          WHEN '3' THEN 'technical_logs' WHEN '5' THEN 'analytics_data' ELSE 'security_logs' END AS category,
        CASE o_orderstatus WHEN 'F' THEN 'consent' WHEN 'O' THEN 'legitimate_interests'
          ELSE 'legal_obligation' END AS basis,
        CASE WHEN o_orderkey % 6 = 0 THEN 'security_logging' ELSE 'service' END AS purpose,
        epoch_us(o_orderdate) AS created_us, o_orderkey % 4 = 0 AS is_sensitive FROM orders"""),
    "subject": ("", """SELECT c_custkey AS subject_id, c_acctbal > 0 AS consent_given,
        c_custkey % 7 = 0 AS consent_withdrawn,
        '10.0.' || (c_custkey % 250) || '.' || (c_custkey % 200) AS ip,
        'agent/' || (c_custkey % 9) AS user_agent FROM customer"""),
    "access": ("", """SELECT l_orderkey AS record_id, l_linenumber AS line, l_suppkey AS operator,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS salt,
        CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'update' ELSE 'delete' END AS action,
        epoch_us(l_shipdate) AS at_us FROM lineitem"""),
    "company_request": ("", """SELECT o_orderkey AS request_id,
        CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN 'X'
          WHEN o_orderkey % 41 = 0 THEN 'Bad<Name>' || o_custkey
          ELSE 'Customer ' || o_custkey || (CASE o_orderkey % 5 WHEN 0 THEN ' Inc' WHEN 1 THEN ' LLC'
            WHEN 2 THEN ' Company' ELSE '' END) END AS company_name,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'not..valid'
          ELSE 'customer' || o_custkey || '.com' END AS domain,
        """ + pick("basic standard comprehensive contact_focused financial_focused", "o_orderkey % 5 + 1") + """
          AS extraction_mode,
        CASE WHEN o_orderkey % 23 = 0 THEN 'usa' ELSE 'US' END AS country,
        CASE WHEN o_orderkey % 19 = 0 THEN 'EN' ELSE 'en' END AS language,
        o_orderkey % 2 = 0 AS include_social_media, o_orderkey % 3 = 0 AS include_financial_data,
        o_orderkey % 7 = 0 AS include_contact_info, o_orderkey % 11 = 0 AS include_key_personnel,
        CAST(o_orderkey % 27 AS INT) AS max_pages_to_crawl, CAST(o_orderkey % 140 + 1 AS INT) AS timeout_seconds
        FROM orders"""),
    "search_request": ("", """SELECT o_orderkey AS request_id,
        CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'café & ' || o_orderpriority || '/' || o_custkey END AS query,
        CASE WHEN o_orderkey % 23 = 0 THEN 'usa' WHEN o_orderkey % 17 = 0 THEN 'id' ELSE 'ID' END AS country,
        CASE WHEN o_orderkey % 19 = 0 THEN 'EN' ELSE 'en' END AS language,
        CAST(o_orderkey % 103 AS INT) AS page, CAST(o_orderkey % 104 AS INT) AS results_per_page,
        CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 12 AS INT) END AS max_pages,
        CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 9 AS INT) END AS start_page,
        """ + pick("none instagram linkedin", "o_orderkey // 7 % 3 + 1") + """ AS social_platform,
        """ + pick("all reels posts accounts tv locations", "o_orderkey // 5 % 6 + 1") + """ AS instagram_content_type,
        """ + pick("all profiles companies posts jobs articles", "o_orderkey // 3 % 6 + 1") + """
          AS linkedin_content_type FROM orders"""),
    "firm_text": ("", r"""SELECT *, concat_ws(E'.\n', size_text, year_text, stock_text, money_text, people_text,
          address_text, mail_text, phone_text) AS text FROM (
        SELECT k AS firm_id, c_name AS known_name,
        CASE k % 6 WHEN 0 THEN 'We have ' || (j % 400 + 5) || '-' || (j % 400 + 90) || ' employees'
          WHEN 1 THEN 'A team of ' || (j % 70 + 3) WHEN 2 THEN 'Our staff of ' || (j % 2000 + 1)
          WHEN 3 THEN 'We employ 50-' || (j % 90 + 60) || ' people'
          WHEN 4 THEN (j % 900) || ' employees and ' || (j % 30 + 1) || '+ people' ELSE 'A growing group' END AS size_text,
        CASE k % 5 WHEN 0 THEN 'Founded in ' || (k % 60 + 1960) WHEN 1 THEN 'Established ' || (k % 900 + 1500)
          WHEN 2 THEN 'Est. ' || (k % 60 + 1950) WHEN 3 THEN (k % 60 + 1970) || ' - present'
          ELSE 'Founded long ago' END AS year_text,
        CASE k % 7 WHEN 0 THEN 'NASDAQ: C' || chr(CAST(65 + k % 26 AS INT)) || 'X' WHEN 1 THEN 'ticker: lower'
          WHEN 2 THEN 'Listed firm (' || chr(CAST(65 + k % 26 AS INT)) || 'Q)' WHEN 3 THEN 'We are privately held'
          WHEN 4 THEN 'A publicly traded group' ELSE 'No market data' END AS stock_text,
        CASE k % 4 WHEN 0 THEN 'We raised $' || (k % 90 + 1) || '.5M million last year'
          WHEN 1 THEN 'Funding: $' || (k % 70 + 1) || 'K. Raised 3M before'
          WHEN 2 THEN 'Valuation: $' || (k % 9 + 1) || 'B' ELSE 'No figures' END AS money_text,
        CASE k % 3 WHEN 0 THEN 'Ann Lee, CEO' WHEN 1 THEN 'Bob Ray, founder; Cy Moe, CTO' ELSE 'The board' END AS people_text,
        CASE k % 4 WHEN 0 THEN (k % 900 + 1) || ' Main Street, Springfield, CA ' || (k % 80000 + 10000)
          WHEN 1 THEN 'P.O. Box ' || (k + 10000) WHEN 2 THEN (k % 900 + 1) || ' Oak Avenue'
          ELSE 'Headquarters in Geneva' END AS address_text,
        CASE k % 3 WHEN 0 THEN 'sales@customer' || k || '.com, info@customer.com, SALES@customer' || k || '.com'
          WHEN 1 THEN 'x' || k || '@gmail.com no-reply@customer.com j.doe@firm' || (k % 40) || '.co.uk'
          ELSE 'no mail' END AS mail_text,
        CASE k % 4 WHEN 0 THEN '+1-555-123-' || lpad((k % 10000)::VARCHAR, 4, '0')
          WHEN 1 THEN '(555) 987-' || lpad((k % 10000)::VARCHAR, 4, '0') WHEN 2 THEN '+44 20 1234 5678'
          ELSE 'call us' END AS phone_text,
        CASE k % 4 WHEN 0 THEN 'About ' || format('{:,}', k * 1234) || ' results'
          WHEN 1 THEN 'Showing 1-10 of ' || (k * 17) WHEN 2 THEN 'Page 2 of about ' || k ELSE 'none' END AS total_text
        FROM (SELECT c_custkey AS k, c_custkey // 6 AS j, c_name FROM customer))"""),
}
