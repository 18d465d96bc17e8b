"""The same queries as SQL for DuckDB over the given tables."""

from __future__ import annotations

# Fixed values, written out here and not taken from the code under test.
INSTALL_TAGS = (
    "install",
    "installation",
    "change out",
    "change-out",
    "changeout",
)
LOST_STATES = (
    "declined",
    "pro declined",
    "rejected",
    "lost",
    "expired",
    "canceled",
    "cancelled",
    "deleted",
    "void",
)
MAINTENANCE_TAGS = (
    "maintenance",
)
NEW_CONSTRUCTION_TAGS = (
    "new construction",
    "new-construction",
    "new build",
    "new-build",
    "newconstruction",
)
SERVICE_TAGS = (
    "service",
    "demand service",
    "demand",
)
WON_STATES = (
    "approved",
    "pro approved",
    "accepted",
    "won",
    "sold",
    "selected",
    "created job from estimate",
    "complete rated",
    "complete unrated",
    "scheduled",
    "in progress",
)
AUDIT_INSTALL_KEYWORDS = (
    "install",
    "changeout",
    "change-out",
    "replacement",
    "new system",
)
CALLBACK_TAGS = (
    "callback",
    "call back",
    "call-back",
    "recall",
    "warranty",
    "warrantee",
)
CLUB_KEYWORDS = (
    "wizard club",
    "wizard",
    "club",
    "membership",
    "member",
    "maintenance plan",
    "service plan",
    "agreement",
)

YEAR_START = "TIMESTAMP '2001-01-01 06:00:00'"
UTC_YEAR_START = "TIMESTAMP '2001-01-01 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:30:00'"


def pct(n: str, d: str, digits: int | None = None) -> str:
    value = f"({n})::DOUBLE / ({d})::DOUBLE * 100.0::DOUBLE"
    if digits is not None:
        value = f"round_even({value}, {digits})"
    return f"CASE WHEN ({d}) > 0 THEN {value} ELSE 0.0::DOUBLE END"


def ratio(n: str, d: str, digits: int | None = None) -> str:
    value = f"({n})::DOUBLE / ({d})::DOUBLE"
    if digits is not None:
        value = f"round_even({value}, {digits})"
    return f"CASE WHEN ({d}) > 0 THEN {value} ELSE 0.0::DOUBLE END"


def money(cents: str) -> str:
    return f"(coalesce({cents}, 0)::DOUBLE / 100.0::DOUBLE)"


def currency(value: str) -> str:
    return f"('$' || format('{{:,}}', round_even({value}, 0)::BIGINT))"


def fixed(value: str, digits: int, suffix: str = "") -> str:
    return f"(printf('%.{digits}f', round_even({value}, {digits})) || '{suffix}')"


def any_word(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def tag_has(column: str, word: str) -> str:
    if " " in word:
        return f"contains({column}, '{word}')"
    return f"regexp_matches({column}, '(^|[\\s,]){word}($|[\\s,])')"


def any_tag(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(tag_has(column, w) for w in words) + ")"


def words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def norm_tags(column: str) -> str:
    """Tags split at commas, trimmed, lower-cased, without blanks, as a list."""
    return (
        f"list_filter(list_transform(string_split(coalesce({column}, ''), ','), "
        "lambda x: lower(trim(x))), lambda x: x <> '')"
    )


def category(column: str) -> str:
    install = any_tag(column, INSTALL_TAGS)
    maintenance = any_tag(column, MAINTENANCE_TAGS)
    service = any_tag(column, SERVICE_TAGS)
    branches = [f"WHEN {any_tag(column, NEW_CONSTRUCTION_TAGS)} THEN 'New Construction'"]
    for segment in ("Residential", "Commercial"):
        here = f"contains({column}, '{segment.lower()}')"
        branches.append(f"WHEN {here} AND {install} THEN '{segment} Install'")
        branches.append(f"WHEN {here} AND {maintenance} THEN '{segment} Maintenance'")
        branches.append(f"WHEN {here} AND {service} AND NOT {install} THEN '{segment} Service'")
    return "CASE " + " ".join(branches) + " ELSE 'Other / Unclassified' END"


def central(ts: str) -> str:
    return f"timezone('America/Chicago', timezone('UTC', {ts}))"


def display(ts: str) -> str:
    return f"coalesce(strftime({central(ts)}, '%b %d, %Y %I:%M %p'), '')"


def display_zone(ts: str) -> str:
    offset = f"date_diff('hour', {ts}, {central(ts)})"
    return f"({display(ts)} || CASE WHEN {offset} = -5 THEN ' CDT' ELSE ' CST' END)"


LINE_ID = (
    "concat_ws('-', l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), "
    "round(l_extendedprice * 100)::BIGINT"
)

ENTITIES: dict[str, str] = {
    "customers": """SELECT c_custkey::VARCHAR AS customer_id, split_part(c_name, '#', 1) AS first_name,
        split_part(c_name, '#', 2) AS last_name FROM customer""",
    "people": """SELECT s_suppkey::VARCHAR AS employee_id, split_part(s_name, '#', 1) AS first_name,
        split_part(s_name, '#', 2) AS last_name,
        CASE WHEN s_suppkey % 10 <> 0 THEN 'Senior Tech' END AS role, s_suppkey FROM supplier""",
    "employees": """SELECT employee_id, trim(first_name) || ' ' || trim(last_name) AS employee_name, role
        FROM people""",
    "jobs": f"""SELECT 'job_' || o_orderkey AS job_id, o_custkey::VARCHAR AS customer_id,
        CASE o_orderstatus WHEN 'F' THEN 'complete rated' WHEN 'P' THEN 'Complete Unrated'
             ELSE 'in progress' END AS work_status,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS completed_at,
        o_orderdate AS updated_at,
        floor(o_totalprice / 5)::BIGINT AS total_amount,
        CASE WHEN o_orderkey % 7 = 0 THEN 'Wizard Club visit' ELSE 'Repair call' END AS description,
        CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN
          CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Residential' ELSE 'Commercial' END
          || ', ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'Demand Service, DFO'
            WHEN '2-HIGH' THEN 'Install' WHEN '3-MEDIUM' THEN 'Maintenance'
            WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Service, Call Back' ELSE 'Service' END
            ELSE 'New Construction' END END AS tags
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "jobs_norm": f"SELECT *, array_to_string({norm_tags('tags')}, ',') AS tags_norm FROM jobs",
    "job_employees": """SELECT DISTINCT 'job_' || l_orderkey AS job_id, l_suppkey::VARCHAR AS employee_id
        FROM lineitem""",
    "job_appointments": """SELECT 'job_' || l_orderkey AS job_id, l_linenumber::VARCHAR AS appointment_id,
        l_suppkey::VARCHAR AS dispatched_employee_id, l_shipdate AS start_time,
        l_shipdate + to_minutes((l_quantity * 6)::INTEGER) AS end_time FROM lineitem""",
    "invoices": """SELECT 'inv_' || o_orderkey AS invoice_id, 'job_' || o_orderkey AS job_id,
        CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'pending_payment' WHEN 2 THEN 'paid'
             ELSE 'voided' END AS status,
        floor(o_totalprice / 5)::BIGINT AS amount, o_orderdate AS invoice_date FROM orders""",
    "invoice_items": f"""SELECT 'inv_' || l_orderkey AS invoice_id, 'job_' || l_orderkey AS job_id,
        {LINE_ID}) AS item_id,
        CASE WHEN p_type = 'PROMO' AND p_size < 5 THEN 'Wizard Club Membership' ELSE p_name END AS name,
        floor(l_extendedprice / 5)::BIGINT AS amount
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "estimates": """SELECT 'est_' || o_orderkey AS estimate_id, o_custkey::VARCHAR AS customer_id,
        CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE c_mktsegment || ' ' END AS lead_source,
        o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey""",
    "estimate_options": f"""SELECT {LINE_ID}, l_orderkey) AS option_id, 'est_' || l_orderkey AS estimate_id,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_partkey % 2 = 0
               THEN upper(list_extract({[*WON_STATES]}, l_partkey % 11 + 1))
             WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN list_extract({[*LOST_STATES]}, l_partkey % 9 + 1) || ' ' END AS approval_status,
        CASE WHEN l_linestatus = 'O' THEN 'submitted' WHEN l_returnflag = 'A' AND l_partkey % 2 = 1
               THEN list_extract({[*WON_STATES]}, l_partkey % 11 + 1)
             WHEN l_returnflag = 'R' AND l_partkey % 2 = 1 THEN list_extract({[*LOST_STATES]}, l_partkey % 9 + 1) ELSE '' END AS status,
        floor(l_extendedprice / 5)::BIGINT AS total_amount FROM lineitem""",
    "estimate_employees": """SELECT DISTINCT 'est_' || l_orderkey AS estimate_id,
        l_suppkey::VARCHAR AS employee_id FROM lineitem""",
    "load_log": """SELECT CASE event_id % 3 WHEN 0 THEN 'last_refresh' WHEN 1 THEN 'last_window_start'
        ELSE 'last_window_end' END AS key, date_trunc('second', ts) AS loaded, ts AS recorded_at FROM events""",
    # populations
    "completed": f"""SELECT * FROM jobs_norm WHERE lower(work_status) IN ('complete unrated', 'complete rated')
        AND completed_at >= {YEAR_START}""",
    "visit_counts": """SELECT job_id, count(DISTINCT appointment_id) AS n FROM job_appointments GROUP BY job_id""",
    "visits": """SELECT c.*, coalesce(v.n, 0) AS num_appointments
        FROM completed c LEFT JOIN visit_counts v ON c.job_id = v.job_id""",
    "billed": f"""SELECT i.*, coalesce(j.tags_norm, '') AS tags_norm FROM invoices i
        LEFT JOIN jobs_norm j ON i.job_id = j.job_id
        WHERE lower(i.status) IN ('open', 'pending_payment') AND i.invoice_date >= {YEAR_START}""",
    "billed_cat": f"SELECT *, {category('tags_norm')} AS category FROM billed",
    "outcome_of": f"""SELECT estimate_id, max(CASE
          WHEN lower(trim(coalesce(approval_status, ''))) IN {words(WON_STATES)}
            OR lower(trim(coalesce(status, ''))) IN {words(WON_STATES)} THEN 3
          WHEN lower(trim(coalesce(approval_status, ''))) IN {words(LOST_STATES)}
            OR lower(trim(coalesce(status, ''))) IN {words(LOST_STATES)} THEN 2
          ELSE 1 END) AS weight FROM estimate_options GROUP BY estimate_id""",
    "outcomes": f"""SELECT e.*, CASE coalesce(o.weight, 1) WHEN 3 THEN 'won' WHEN 2 THEN 'lost' ELSE 'pending' END
        AS outcome FROM estimates e LEFT JOIN outcome_of o ON e.estimate_id = o.estimate_id
        WHERE e.created_at >= {YEAR_START}""",
    "club_item_jobs": f"""SELECT DISTINCT coalesce(i.job_id, t.job_id) AS job_id FROM invoice_items t
        JOIN invoices i ON t.invoice_id = i.invoice_id
        WHERE i.invoice_date >= {YEAR_START} AND {any_word('t.name', CLUB_KEYWORDS)}""",
    "service_calls": f"""SELECT c.job_id, c.completed_at,
        {any_word('c.tags_norm', CLUB_KEYWORDS)} AS from_tags,
        {any_word('c.description', CLUB_KEYWORDS)} AS from_description,
        k.job_id IS NOT NULL AS from_items
        FROM completed c LEFT JOIN club_item_jobs k ON c.job_id = k.job_id
        WHERE NOT contains(c.tags_norm, 'install')""",
    # employee metrics
    "m_completed": f"""SELECT e.employee_id, count(DISTINCT c.job_id) AS completed_jobs_ytd,
        count(DISTINCT CASE WHEN {any_tag('c.tags_norm', CALLBACK_TAGS)} THEN c.job_id END) AS callback_jobs_ytd
        FROM completed c JOIN job_employees e ON c.job_id = e.job_id GROUP BY e.employee_id""",
    "m_ticket": f"""SELECT e.employee_id, {ratio(money('sum(b.amount)'), 'count(DISTINCT b.job_id)')} AS avg_ticket_overall,
        count(DISTINCT b.job_id) AS overall_invoice_count
        FROM billed b JOIN job_employees e ON b.job_id = e.job_id GROUP BY e.employee_id""",
    "m_daily": f"""SELECT e.employee_id,
        {ratio(money('sum(b.amount)'), 'count(DISTINCT b.invoice_date::DATE)')} AS daily_revenue_service
        FROM billed_cat b JOIN job_employees e ON b.job_id = e.job_id
        WHERE NOT contains(lower(b.category), 'install') GROUP BY e.employee_id""",
    "m_hours": """SELECT dispatched_employee_id AS employee_id,
        sum(date_diff('microsecond', start_time, end_time))::BIGINT / 3600000000 AS appt_hours_ytd
        FROM job_appointments GROUP BY dispatched_employee_id""",
}


def sql(body: str) -> str:
    """The query with every entity in front; DuckDB evaluates only those it needs."""
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in ENTITIES.items())
    return f"WITH {ctes}\n{body}"


def _outcome_counts() -> str:
    return (
        "count(*) AS estimates, count(*) FILTER (outcome = 'won') AS won, "
        "count(*) FILTER (outcome = 'lost') AS lost, count(*) FILTER (outcome = 'pending') AS pending"
    )


def _leads_by(label: str, name: str) -> str:
    return sql(
        f"SELECT *, {pct('won', 'won + lost', 1)} AS win_rate FROM "
        f"(SELECT {label} AS {name}, {_outcome_counts()} FROM outcomes GROUP BY 1)"
    )


def shares(source: str, value: str, tie: str) -> str:
    """Adds ``share``, whole percentages adding up to 100, to a query with column ``raw``."""
    return f"""SELECT *, (base + CASE WHEN missing > 0 THEN 1 WHEN missing < 0 THEN -1 ELSE 0 END
          * (abs(missing) // n + CASE WHEN place <= abs(missing) % n THEN 1 ELSE 0 END))::BIGINT AS share
        FROM (SELECT *, 100 - sum(base) OVER () AS missing, count(*) OVER () AS n,
                row_number() OVER (ORDER BY raw - base DESC, {value} DESC, {tie}) AS place
              FROM (SELECT *, trunc(raw)::BIGINT AS base FROM ({source})))"""


_TICKET_PARTS = {"": "TRUE", "service_": "NOT install", "install_": "install"}


def _average_ticket() -> str:
    columns = ["450.0::DOUBLE AS avg_ticket_target"]
    for part, chosen in _TICKET_PARTS.items():
        name = f"{part}avg_ticket" if part else "average_ticket"
        count = f"count(*) FILTER ({chosen})"
        value = ratio(money(f"sum(amount) FILTER ({chosen})"), count)
        columns += [
            f"{value} AS {name}",
            f"{currency(value)} AS {name}_display",
            f"CASE WHEN {value} >= 450 THEN 'success' ELSE 'danger' END AS {name}_status",
            f"{count} AS {part}invoice_count",
        ]
    inner = "SELECT amount, contains(lower(category), 'install') AS install FROM billed_cat"
    return f"SELECT {', '.join(columns)} FROM ({inner})"


_QUALITY = f"""SELECT *, CASE WHEN dfo_pct < 5 THEN 'success' WHEN dfo_pct < 10 THEN 'warning'
      ELSE 'danger' END AS dfo_status_color FROM (
    SELECT *, {pct('first_time_completed', 'completed_jobs', 2)} AS first_time_completion_pct,
      {pct('repeat_visit_completed', 'completed_jobs', 2)} AS repeat_visit_pct,
      {pct('dfo_count', 'completed_jobs', 2)} AS dfo_pct, 85 AS first_time_completion_target
    FROM (SELECT count(*) AS completed_jobs, count(*) FILTER (num_appointments = 1) AS first_time_completed,
            count(*) FILTER (num_appointments >= 2) AS repeat_visit_completed,
            count(*) FILTER ({tag_has('tags_norm', 'dfo')}) AS dfo_count FROM visits))"""

_REVENUE_TOTAL = f"""SELECT total_revenue_ytd, {currency('total_revenue_ytd')} AS total_revenue_ytd_display
    FROM (SELECT {money('sum(amount)')} AS total_revenue_ytd FROM billed)"""

_ESTIMATES = f"SELECT count(*) AS estimates_ytd_count FROM estimates WHERE created_at >= {YEAR_START}"

_LEAD_SUMMARY = f"""SELECT estimates AS estimates_created_ytd, won AS estimates_won_ytd, lost AS estimates_lost_ytd,
      pending AS estimates_pending_ytd, {pct('won', 'won + lost', 1)} AS win_rate_ytd, calls AS calls_ytd,
      {ratio('estimates', 'calls', 3)} AS estimate_to_call_ratio
    FROM (SELECT {_outcome_counts()}, (SELECT count(*) FROM completed) AS calls FROM outcomes)"""


def _club_sources(total: str) -> str:
    names = {"tags": "from_tags", "description": "from_description", "invoice_items": "from_items"}
    counts = ", ".join(f"count(*) FILTER ({flag}) AS club_calls_from_{n}" for n, flag in names.items())
    shares_ = ", ".join(
        f"{pct(f'count(*) FILTER ({flag})', total, 2)} AS pct_from_{n}" for n, flag in names.items()
    )
    return f"{counts}, {shares_}, '{', '.join(CLUB_KEYWORDS)}' AS club_keywords"


_CLUB = f"""SELECT * EXCLUDE (raw), round_even(raw, 2) AS club_conversion_pct,
      {fixed('raw', 2, '%')} AS club_conversion_pct_display,
      CASE WHEN raw >= 50 THEN 'success' ELSE 'danger' END AS club_conversion_status,
      50.0::DOUBLE AS club_conversion_target,
      eligible_service_calls_ytd - club_calls_ytd AS nonclub_service_calls_ytd
    FROM (SELECT count(*) AS eligible_service_calls_ytd,
        count(*) FILTER (from_tags OR from_description OR from_items) AS club_calls_ytd,
        {pct('count(*) FILTER (from_tags OR from_description OR from_items)', 'count(*)')} AS raw,
        {_club_sources('count(*)')} FROM service_calls)"""

_FRESHNESS = f"""SELECT TIMESTAMP '2001-08-02 00:00:00' >= loaded + INTERVAL 1 HOUR AS can_refresh,
      {display_zone('(loaded + INTERVAL 1 HOUR)')} AS next_refresh, {display_zone('loaded')} AS last_refresh_display
    FROM (SELECT arg_max(loaded, recorded_at) AS loaded FROM load_log WHERE key = 'last_refresh')"""

_CARDS = f"""SELECT employee_id, employee_name AS name, coalesce(role, 'Technician') AS role,
      NULL::VARCHAR AS avatar_url, NULL::VARCHAR AS color_hex, completed_jobs_ytd,
      avg_ticket_overall, {currency('avg_ticket_overall')} AS avg_ticket_overall_display,
      CASE WHEN avg_ticket_overall >= 450 THEN 'success' ELSE 'danger' END AS avg_ticket_overall_status,
      overall_invoice_count, daily_revenue, {currency('daily_revenue')} AS daily_revenue_display,
      CASE WHEN daily_revenue >= 1350 THEN 'success' ELSE 'danger' END AS daily_revenue_status,
      callback_jobs_ytd, callback_pct_ytd, {fixed('callback_pct_ytd', 1, '%')} AS callback_pct_display,
      CASE WHEN callback_pct_ytd <= 5 THEN 'success' WHEN callback_pct_ytd <= 10 THEN 'warning'
           ELSE 'danger' END AS callback_status, 5.0::DOUBLE AS callback_target,
      appt_hours_ytd, {fixed('appt_hours_ytd', 1, ' hrs')} AS appt_hours_ytd_display,
      0.0::DOUBLE AS gross_profit_per_hour_ytd, 'Pending' AS gross_profit_per_hour_ytd_display,
      0.0::DOUBLE AS gp_per_hour_target, TRUE AS gp_per_hour_pending, 'secondary' AS gp_per_hour_status
    FROM (SELECT e.*, coalesce(c.completed_jobs_ytd, 0) AS completed_jobs_ytd,
        coalesce(t.avg_ticket_overall, 0.0) AS avg_ticket_overall,
        coalesce(t.overall_invoice_count, 0) AS overall_invoice_count,
        coalesce(d.daily_revenue_service, 0.0) AS daily_revenue,
        coalesce(c.callback_jobs_ytd, 0) AS callback_jobs_ytd,
        {pct('coalesce(c.callback_jobs_ytd, 0)', 'coalesce(c.completed_jobs_ytd, 0)')} AS callback_pct_ytd,
        coalesce(h.appt_hours_ytd, 0.0) AS appt_hours_ytd
      FROM employees e LEFT JOIN m_completed c ON e.employee_id = c.employee_id
        LEFT JOIN m_ticket t ON e.employee_id = t.employee_id
        LEFT JOIN m_daily d ON e.employee_id = d.employee_id
        LEFT JOIN m_hours h ON e.employee_id = h.employee_id)"""

KPIS: dict[str, str] = {
    "quality_summary": sql(_QUALITY),
    "repeat_jobs_top25": sql(
        f"""SELECT v.job_id, trim(coalesce(trim(c.first_name), 'Unknown') || ' ' || coalesce(trim(c.last_name), ''))
              AS customer_name, v.work_status, v.num_appointments,
              {display('v.completed_at')} AS completed_at_central, v.description
            FROM (SELECT * FROM visits WHERE num_appointments >= 2
                  ORDER BY completed_at DESC, job_id LIMIT 25) v
            LEFT JOIN customers c ON v.customer_id = c.customer_id"""
    ),
    "dfo_monthly": sql(
        f"""SELECT month, dfo_count, total_count, {pct('dfo_count', 'total_count', 1)} AS dfo_pct
            FROM (SELECT strftime(completed_at, '%Y-%m') AS month, count(*) AS total_count,
                    count(*) FILTER ({tag_has('tags_norm', 'dfo')}) AS dfo_count FROM completed GROUP BY 1)
            WHERE (SELECT count(*) FROM completed WHERE {tag_has('tags_norm', 'dfo')}) > 0"""
    ),
    "revenue_total": sql(_REVENUE_TOTAL),
    "revenue_breakdown": sql(
        f"""SELECT category, revenue, {currency('revenue')} AS revenue_display, share::DOUBLE AS pct_of_total,
              share || '%' AS pct_of_total_display,
              greatest(0.0, least(100.0, {pct('revenue', 'max(revenue) OVER ()')}))::DOUBLE AS pct_of_max
            FROM ({shares(f'''SELECT *, {pct('revenue', 'total')} AS raw FROM (
                SELECT *, sum(revenue) OVER () AS total FROM (
                  SELECT category, {money('sum(amount)')} AS revenue FROM billed_cat GROUP BY category))''',
                'revenue', 'category')})"""
    ),
    "avg_ticket_split": sql(_average_ticket()),
    "employee_completed": sql("SELECT employee_id, completed_jobs_ytd FROM m_completed"),
    "employee_avg_ticket": sql("SELECT * FROM m_ticket"),
    "employee_callbacks": sql("SELECT employee_id, callback_jobs_ytd FROM m_completed WHERE callback_jobs_ytd > 0"),
    "employee_daily_revenue": sql("SELECT * FROM m_daily"),
    "employee_hours": sql("SELECT * FROM m_hours"),
    "employee_cards": sql(_CARDS),
    "estimates_ytd": sql(_ESTIMATES),
    "option_status_breakdown": sql(
        f"""SELECT bucket, option_count, total_amount, {currency('total_amount')} AS total_amount_display FROM (
            SELECT coalesce(nullif(lower(trim(coalesce(approval_status, ''))), ''),
                nullif(lower(trim(coalesce(status, ''))), ''), 'unknown') AS bucket,
              count(*) AS option_count, {money('sum(total_amount)')} AS total_amount
            FROM estimate_options GROUP BY 1)"""
    ),
    "lead_summary": sql(_LEAD_SUMMARY),
    "lead_by_month": _leads_by("strftime(created_at, '%Y-%m')", "month"),
    "lead_by_source": _leads_by("coalesce(nullif(trim(lead_source), ''), 'Unknown')", "lead_source"),
    "lead_by_employee": sql(
        f"""SELECT *, {pct('won', 'won + lost', 1)} AS win_rate FROM (
            SELECT coalesce(e.employee_name, 'Unassigned') AS employee_name,
              count(DISTINCT b.estimate_id) AS estimates,
              count(*) FILTER (o.outcome = 'won') AS won, count(*) FILTER (o.outcome = 'lost') AS lost,
              count(*) FILTER (o.outcome = 'pending') AS pending
            FROM estimate_employees b JOIN outcomes o ON b.estimate_id = o.estimate_id
              LEFT JOIN employees e ON b.employee_id = e.employee_id GROUP BY 1)"""
    ),
    "club_summary": sql(_CLUB),
    "club_monthly": sql(
        f"""SELECT month, service_calls, club_calls, round_even(raw, 2) AS club_conversion_pct,
              {fixed('raw', 2, '%')} AS club_conversion_pct_display
            FROM (SELECT *, {pct('club_calls', 'service_calls')} AS raw FROM (
              SELECT strftime(completed_at, '%Y-%m') AS month, count(*) AS service_calls,
                count(*) FILTER (from_tags OR from_description OR from_items) AS club_calls
              FROM service_calls GROUP BY 1))"""
    ),
    "club_audit": sql(
        f"""SELECT count(*) AS service_calls_ytd, {_club_sources('count(*)')} FROM (
            SELECT {any_word('j.tags_norm', CLUB_KEYWORDS)} AS from_tags,
              {any_word('j.description', CLUB_KEYWORDS)} AS from_description, k.job_id IS NOT NULL AS from_items
            FROM jobs_norm j LEFT JOIN (
              SELECT DISTINCT i.job_id FROM invoice_items t JOIN invoices i ON t.invoice_id = i.invoice_id
              WHERE i.invoice_date >= {UTC_YEAR_START} AND {any_word('t.name', CLUB_KEYWORDS)}) k
              ON j.job_id = k.job_id
            WHERE lower(trim(j.work_status)) IN ('complete unrated', 'complete rated')
              AND j.completed_at >= {UTC_YEAR_START} AND NOT {any_word('j.tags_norm', AUDIT_INSTALL_KEYWORDS)})"""
    ),
    "job_baseline_audit": sql(
        f"""SELECT count(*) AS jobs_total,
              count(*) FILTER (lower(trim(work_status)) IN ('complete unrated', 'complete rated')
                AND completed_at >= {UTC_YEAR_START}) AS completed_jobs_ytd_total,
              count(*) FILTER (tags IS NULL) AS null_tags_all_time,
              count(*) FILTER (trim(coalesce(tags, '')) = '') AS empty_tags_all_time,
              '2001-01-01 00:00:00+00:00' AS ytd_start_utc FROM jobs"""
    ),
    "freshness": sql(_FRESHNESS.replace("TIMESTAMP '2001-08-02 00:00:00'", EVENTS_AS_OF)),
    "load_facts": sql(
        """SELECT key, strftime(arg_max(loaded, recorded_at), '%Y-%m-%dT%H:%M:%SZ') AS value
           FROM load_log GROUP BY key"""
    ),
}


# One-row KPIs of the dashboard by the name they have there. Only the text of whole
# numbers and plain text is the same in both engines, so the long form keeps those.
def _long(kpi: str, body: str, columns: tuple[str, ...]) -> str:
    parts = [f"SELECT '{kpi}' AS kpi, '{c}' AS measure, {c}::VARCHAR AS value FROM ({body})" for c in columns]
    return " UNION ALL ".join(parts)


_SUMMARY_COLUMNS = {
    "quality_summary": (
        _QUALITY,
        ("completed_jobs", "first_time_completed", "repeat_visit_completed", "dfo_count",
         "first_time_completion_pct", "repeat_visit_pct", "dfo_pct", "first_time_completion_target",
         "dfo_status_color"),
    ),
    "revenue_total": (_REVENUE_TOTAL, ("total_revenue_ytd", "total_revenue_ytd_display")),
    "average_ticket": (
        _average_ticket(),
        ("avg_ticket_target", *[
            f"{prefix}{suffix}"
            for part in _TICKET_PARTS
            for prefix, suffix in (
                [(f"{part}avg_ticket" if part else "average_ticket", s) for s in ("", "_display", "_status")]
                + [(part, "invoice_count")]
            )
        ]),
    ),
    "estimates_count": (_ESTIMATES, ("estimates_ytd_count",)),
    "lead_summary": (
        _LEAD_SUMMARY,
        ("estimates_created_ytd", "estimates_won_ytd", "estimates_lost_ytd", "estimates_pending_ytd",
         "win_rate_ytd", "calls_ytd", "estimate_to_call_ratio"),
    ),
    "club_summary": (
        _CLUB,
        ("eligible_service_calls_ytd", "club_calls_ytd", "nonclub_service_calls_ytd", "club_conversion_pct",
         "club_conversion_pct_display", "club_conversion_status", "club_conversion_target", "club_keywords",
         *[f"{p}_from_{s}" for p in ("club_calls", "pct") for s in ("tags", "description", "invoice_items")]),
    ),
    "freshness": (_FRESHNESS, ("can_refresh", "next_refresh", "last_refresh_display")),
}

KPIS["dashboard_values"] = sql(
    " UNION ALL ".join(_long(kpi, body, columns) for kpi, (body, columns) in _SUMMARY_COLUMNS.items())
)

# The same KPIs from bucketed copies of the tables.
KPIS["revenue_breakdown_bucketed"] = KPIS["revenue_breakdown"]
KPIS["employee_cards_bucketed"] = KPIS["employee_cards"]

KPIS["employee_hours_given"] = """SELECT l_suppkey::VARCHAR AS employee_id,
      sum(CASE WHEN l_orderkey % 3 = 0 AND l_partkey % 100 > 10 THEN l_partkey % 100 - 10
               WHEN l_orderkey % 9 <> 0 THEN floor(l_quantity * 6) ELSE 0 END)::BIGINT / 60.0 AS appt_hours_ytd
    FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1"""
