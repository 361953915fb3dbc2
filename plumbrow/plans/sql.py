"""SQL for the inputs, to be put before the SQL of a query: the same derivations as in ``inputs``."""

from __future__ import annotations

from collections.abc import Sequence

from plumbrow.plans.inputs import DOMAINS, KINDS, QUIET, SCHEMAS


def urn(domain: str, table: str) -> str:
    return f"('urn:li:dataset:(urn:li:dataPlatform:sqlite,' || {domain} || '.' || {table} || ',PROD)')"


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def kind_domain(i: str) -> str:
    return f"list_extract({_list(DOMAINS)}, CAST({i} % {len(DOMAINS)} AS INTEGER) + 1)"


def kind_schema(i: str) -> str:
    cases = " ".join(f"WHEN {n} THEN {_list(SCHEMAS[k])}" for n, k in enumerate(KINDS))
    return f"CASE CAST({i} % {len(KINDS)} AS INTEGER) {cases} END"


_START = "strftime(o_orderdate, '%Y-%m-%d')"
_END = "strftime(CAST(o_orderdate AS DATE) + CAST(o_custkey % 14 + 1 AS INTEGER), '%Y-%m-%d')"
_NAME = "'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')"
_AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
_AGE = "(o_custkey % 90 + 1)"


def _patients(name: str, age: str, amount: str, first: str, last: str) -> str:
    return f"""SELECT o_orderkey AS visit_id, {name} AS name, {age} AS age,
  CASE WHEN o_orderstatus = 'F' THEN ' Female' ELSE 'MALE ' END AS gender,
  CASE WHEN substr(h, 9, 2) < '80' THEN ' AB+ ' ELSE 'o-' END AS blood_type,
  ' ' || upper(o_orderpriority) || ' ' AS medical_condition,
  {first} AS date_of_admission,
  'Doctor ' || substr(h, 11, 2) AS doctor,
  'Hospital ' || substr(h, 13, 1) AS hospital,
  o_orderpriority AS insurance_provider,
  {amount} AS billing_amount,
  CAST(o_custkey AS VARCHAR) AS room_number,
  CASE o_orderstatus WHEN 'F' THEN 'Emergency ' WHEN 'O' THEN ' Elective' ELSE 'URGENT' END AS admission_type,
  {last} AS discharge_date,
  'Medication ' || substr(h, 14, 1) AS medication,
  CASE WHEN substr(h, 15, 2) < '80' THEN ' Normal ' ELSE 'ABNORMAL' END AS test_results
FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)"""


CLEAN_PATIENTS = "clean_patients AS (" + _patients(
    _NAME, f"CAST({_AGE} AS VARCHAR)", _AMOUNT, _START, _END
) + ")"

PATIENTS = "patients AS (" + _patients(
    f"CASE substr(h, 1, 2) WHEN '00' THEN NULL WHEN '01' THEN '' WHEN '02' THEN 'NULL' ELSE {_NAME} END",
    f"CASE WHEN substr(h, 5, 2) < '02' THEN CAST(-{_AGE} AS VARCHAR) "
    f"WHEN substr(h, 5, 2) < '04' THEN CAST({_AGE} + 200 AS VARCHAR) ELSE CAST({_AGE} AS VARCHAR) END",
    f"CASE WHEN substr(h, 3, 2) < '05' THEN '-' || {_AMOUNT} ELSE {_AMOUNT} END",
    f"CASE WHEN substr(h, 7, 2) < '02' THEN {_END} ELSE {_START} END",
    f"CASE WHEN substr(h, 7, 2) < '02' THEN {_START} ELSE {_END} END",
) + ")"

STAGING_PATIENTS = PATIENTS + """,
staging AS (SELECT *, lower(trim(gender)) AS gender_clean, lower(trim(blood_type)) AS blood_type_clean,
  lower(trim(medical_condition)) AS condition_clean, lower(trim(admission_type)) AS admission_type_clean,
  lower(trim(test_results)) AS test_results_clean, 'staged' AS pipeline_status FROM patients)"""

MARTS = STAGING_PATIENTS + """,
billing AS (SELECT name, hospital, insurance_provider, admission_type_clean AS admission_type,
  TRY_CAST(billing_amount AS DOUBLE) AS billing_amount, date_of_admission, discharge_date,
  round(CAST(date_diff('day', CAST(date_of_admission AS DATE), CAST(discharge_date AS DATE)) AS DOUBLE), 1)
    AS length_of_stay_days,
  medication, pipeline_status FROM staging),
demographics AS (SELECT name, CAST(trunc(TRY_CAST(age AS DOUBLE)) AS INTEGER) AS age, gender_clean AS gender,
  blood_type_clean AS blood_type, condition_clean AS medical_condition, hospital,
  test_results_clean AS test_results, pipeline_status FROM staging)"""

TRIPS = """raw_trips AS (SELECT l_suppkey AS "VendorID",
  CASE WHEN l_discount > 0 OR l_tax > 0 THEN l_shipdate + to_hours(l_linenumber) END AS tpep_pickup_datetime,
  l_shipdate + to_hours(l_linenumber) + to_minutes(CAST(l_quantity AS BIGINT)) AS tpep_dropoff_datetime,
  l_linenumber AS passenger_count, l_quantity - 1 AS trip_distance, l_returnflag AS payment_type,
  CASE WHEN l_returnflag = 'R' THEN -floor(l_extendedprice) ELSE floor(l_extendedprice) END AS fare_amount,
  l_quantity AS tip_amount,
  CASE WHEN l_returnflag = 'R' THEN -floor(l_extendedprice) ELSE floor(l_extendedprice) END + l_quantity
    AS total_amount FROM lineitem),
trips AS (SELECT *, CAST(tpep_pickup_datetime AS DATE) AS trip_date,
  round(date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0::DOUBLE, 1) AS trip_duration_min,
  'staged' AS pipeline_status FROM raw_trips
  WHERE tpep_pickup_datetime IS NOT NULL AND trip_distance > 0 AND fare_amount > 0)"""

DAILY = """SELECT trip_date, count(*) AS trip_count, round(sum(fare_amount), 2) AS total_fare,
  round(sum(total_amount), 2) AS total_revenue, round(avg(fare_amount), 2) AS avg_fare,
  round(avg(trip_distance), 2) AS avg_distance, round(avg(passenger_count), 1) AS avg_passengers,
  round(avg(trip_duration_min), 1) AS avg_duration_min FROM {rel} GROUP BY trip_date"""

STALE = TRIPS + f""",
stale_trips AS (SELECT * FROM trips WHERE trip_date <= (SELECT max(trip_date) FROM trips) - 3),
daily AS ({DAILY.format(rel='trips')}),
cut_daily AS (SELECT * FROM daily WHERE trip_date <= (SELECT max(trip_date) FROM trips) - 3),
stale_daily AS (SELECT trip_date, CASE WHEN hit THEN 0 ELSE trip_count END AS trip_count,
  """ + ",\n  ".join(
    f"CASE WHEN hit THEN 0.0 ELSE {c} END AS {c}"
    for c in ("total_fare", "total_revenue", "avg_fare", "avg_distance", "avg_passengers", "avg_duration_min")
) + """
  FROM (SELECT *, trip_date = (SELECT max(trip_date) FROM trips) - 10 AS hit FROM cut_daily))"""

STREAM_URN = urn(kind_domain("{0}"), "'user_' || CAST({0} AS VARCHAR)")

_PEER = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"

STREAMS = f"""users AS (SELECT user_id, {STREAM_URN.format('user_id')} AS urn, {kind_domain('user_id')} AS domain,
  'user_' || CAST(user_id AS VARCHAR) AS "table", {kind_schema('user_id')} AS columns
  FROM (SELECT DISTINCT user_id FROM events)),
links AS (SELECT DISTINCT least(user_id, {_PEER}) AS src, greatest(user_id, {_PEER}) AS dst FROM events WHERE {_PEER} IS NOT NULL),
g_edges AS (SELECT src, dst FROM links WHERE src <> dst),
g_nodes AS (SELECT user_id AS id FROM users UNION SELECT {QUIET} + n_nationkey FROM nation UNION SELECT src FROM links UNION SELECT dst FROM links)"""

_PII = "|".join(
    ("name", "ssn", "passport", "email", "medical_condition", "phone", "card", "patient", "address")
)


def pii(columns: str, words: str = _PII) -> str:
    return f"list_filter({columns}, lambda c: regexp_matches(lower(c), '{words}'))"


_AS_OF_MS = 1706659200000  # 2024-01-31 00:00:00 UTC

FRESHNESS = f"""fresh AS (SELECT user_id, CAST(max(epoch_us(ts) // 1000) AS BIGINT) AS last_ts_ms,
  ({_AS_OF_MS} - max(epoch_us(ts) // 1000)) / 3600000.0::DOUBLE AS hours_stale FROM events GROUP BY user_id)"""

# The number of shortest paths of length d is the number of walks of that length where d is the
# distance. STEPS are more than the diameter of this graph, which the tests check.
STEPS = 6
CENTRALITY = STREAMS + """,
w1 AS (SELECT src AS s, dst AS t, 1.0::DOUBLE AS c, 1 AS d FROM g_edges),
""" + "\n".join(
    f"w{k} AS (SELECT w.s, e.dst AS t, sum(w.c) AS c, {k} AS d FROM w{k - 1} w JOIN g_edges e ON w.t = e.src GROUP BY 1, 2),"
    for k in range(2, STEPS + 1)
) + """
sp AS (SELECT s, t, min(d) AS d, arg_min(c, d) AS sg FROM ("""+ " UNION ALL ".join(
    f"SELECT * FROM w{k}" for k in range(1, STEPS + 1)
) + """) WHERE s <> t GROUP BY s, t),
between AS (SELECT a.t AS v, sum(a.sg * b.sg / x.sg) AS total FROM sp a JOIN sp b ON a.t = b.s
  JOIN sp x ON x.s = a.s AND x.t = b.t AND x.d = a.d + b.d WHERE a.s <> b.t GROUP BY a.t),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM g_nodes),
central AS (SELECT id, coalesce(total, 0.0) AS betweenness,
  coalesce(total, 0.0) * (1.0::DOUBLE / ((n - 1) * (n - 2))) AS centrality
  FROM g_nodes CROSS JOIN size LEFT JOIN between ON v = id),
roles AS (SELECT id, NOT inn AS is_root, NOT outt AS is_sink, NOT inn AND NOT outt AS is_isolated,
  centrality = 0 AND inn AS is_orphan FROM (SELECT id, centrality,
    id IN (SELECT dst FROM g_edges) AS inn, id IN (SELECT src FROM g_edges) AS outt FROM central))"""

SCORES = CENTRALITY + f""",
{FRESHNESS},
inputs AS (SELECT u.urn, u."table", u.columns, {pii('u.columns')} AS pii_columns,
  len({pii('u.columns')}) > 0 AS has_pii, f.hours_stale, f.hours_stale > 24 AS is_stale, c.centrality, r.is_orphan
  FROM users u JOIN fresh f USING (user_id) JOIN central c ON c.id = u.user_id JOIN roles r ON r.id = u.user_id),
scores AS (SELECT *, round(least(CASE WHEN has_pii THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
  + least(hours_stale / 24.0::DOUBLE, 0.4::DOUBLE) + centrality * 0.2::DOUBLE, 1.0::DOUBLE), 2) AS risk_score FROM inputs)"""

STREAM_ROWS = f"""rows0 AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM events),
stream_rows AS (SELECT {STREAM_URN.format('user_id')} AS urn,
  CASE WHEN substr(h, 3, 2) >= '03' THEN event_type END AS event_type,
  CASE WHEN substr(h, 1, 2) < '05' THEN -value ELSE value END AS value,
  {_PEER} + CASE WHEN substr(h, 5, 2) < '03' THEN 200 ELSE 0 END AS age,
  ts AS start_ts,
  ts + to_microseconds(CAST(round(CASE WHEN substr(h, 1, 2) < '05' THEN -value ELSE value END * 1000000) AS BIGINT))
    AS end_ts FROM rows0)"""

CATALOGUE = f"""named AS (SELECT 'customer_' || CAST(o_custkey AS VARCHAR) AS domain,
  CASE o_orderstatus WHEN 'O' THEN 'raw' WHEN 'P' THEN 'staging' ELSE 'mart' END
    || '_orders_' || CAST(year(o_orderdate) AS VARCHAR) AS "table",
  'order_' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS instance,
  {kind_schema("CAST(substr(o_orderpriority, 1, 1) AS INTEGER)")} AS columns FROM orders
  UNION ALL SELECT 'customer_' || CAST(c_custkey AS VARCHAR), 'sqlite_sequence', 'system', ['name', 'seq'] FROM customer),
registry AS (SELECT {urn('domain', '"table"')} AS urn, domain, "table", 'AVAILABLE' AS status, count(*) AS copies,
  max(instance) AS instance, arg_max(columns, instance) AS columns
  FROM named WHERE "table" NOT LIKE 'sqlite_%' GROUP BY domain, "table")"""


def entity(name: str, key: str) -> str:
    return urn(f"'{name}'", f"'{name}_' || CAST({key} AS VARCHAR)")


ENTITY_EDGES = f"""k_edges AS (
  SELECT {entity('region', 'n_regionkey')} AS src, {entity('nation', 'n_nationkey')} AS dst FROM nation
  UNION SELECT {entity('nation', 's_nationkey')}, {entity('supplier', 's_suppkey')} FROM supplier
  UNION SELECT {entity('nation', 'c_nationkey')}, {entity('customer', 'c_custkey')} FROM customer
  UNION SELECT {entity('customer', 'o_custkey')}, {entity('orders', 'o_orderkey')} FROM orders
  UNION SELECT {entity('part', 'l_partkey')}, {entity('orders', 'l_orderkey')} FROM lineitem
  UNION SELECT {entity('supplier', 'l_suppkey')}, {entity('orders', 'l_orderkey')} FROM lineitem)"""


def finding(
    rel: str, dataset: str, column: str, issue: str, bad: str, column_2: str | None = None,
    value: str | None = None, by: str | None = None, bounds: tuple | None = None, texts: Sequence[str] = (),
) -> str:
    """One check as SQL, in the shape of the profile table."""
    name = by or f"'{dataset}'"
    second = f"'{column_2}'" if column_2 else "CAST(NULL AS VARCHAR)"
    least = f"min({value}) FILTER (WHERE {bad})" if value else "CAST(NULL AS DOUBLE)"
    low, high = bounds or ("NULL", "NULL")
    shares = ", ".join(
        f"CAST(count(TRY_CAST({t} AS TIMESTAMP)) AS DOUBLE) / nullif(count(*) FILTER (WHERE trim({t}) <> ''), 0)"
        for t in texts
    )
    parsed = f"round(least({shares}), 4)" if texts else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT {name} AS dataset, '{column}' AS \"column\", {second} AS column_2, '{issue}' AS issue, "
        f"count(*) FILTER (WHERE {bad}) AS bad_rows, count(*) AS total_rows, "
        f"round(CAST(count(*) FILTER (WHERE {bad}) AS DOUBLE) / count(*) * 100.0, 2) AS pct, "
        f"CAST({least} AS DOUBLE) AS min_value, CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high, "
        f"{parsed} AS parsed_share FROM {rel}{f' GROUP BY {by}' if by else ''}"
    )


def findings(parts: Sequence[str]) -> str:
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE bad_rows > 0"


def null_findings(rel: str, dataset: str, texts: Sequence[str], others: Sequence[str] = (), by=None,
                  blanks: str = "('', 'NULL')") -> list[str]:
    return [
        finding(rel, dataset, c, "null_or_blank", f"{c} IS NULL OR {c} IN {blanks}", by=by) for c in texts
    ] + [finding(rel, dataset, c, "null_or_blank", f"{c} IS NULL", by=by) for c in others]


def negative_findings(rel: str, dataset: str, columns: Sequence[str], by=None) -> list[str]:
    return [
        finding(rel, dataset, c, "negative", f"TRY_CAST({c} AS DOUBLE) < 0",
                value=f"TRY_CAST({c} AS DOUBLE)", by=by)
        for c in columns
    ]


def range_findings(rel: str, dataset: str, columns: Sequence[str], by=None, bounds: tuple = (0, 120)) -> list[str]:
    lo, hi = bounds
    return [
        finding(rel, dataset, c, "invalid_age_range",
                f"TRY_CAST({c} AS DOUBLE) < {lo} OR TRY_CAST({c} AS DOUBLE) > {hi}", by=by, bounds=bounds)
        for c in columns
    ]


def order_finding(rel: str, dataset: str, a: str, b: str, by=None, texts: Sequence[str] = ()) -> str:
    return finding(rel, dataset, a, "date_inversion", f"{a} > {b}", column_2=b, by=by, texts=texts)
