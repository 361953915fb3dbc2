"""Every registered query: a Spark job over the given tables and, where one exists, the SQL to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrow.operators import catalog, freshness, graph, lineage, pipeline, plant, profile, remediate, risk
from plumbrow.plans import inputs as src, sql as q
from plumbrow.sources import files
from plumbrow.sources.shared import cut, new_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31T00:00:00Z"
MEASURES = (
    "trip_count", "total_fare", "total_revenue", "avg_fare", "avg_distance", "avg_passengers",
    "avg_duration_min",
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def _joined(c: str) -> Column:
    """A list as one text, to be compared by value."""
    return F.array_join(c, ",").alias(c)


# --- sources, catalogue, sinks -------------------------------------------------------------------

_ORDER_TEXTS = """SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderstatus AS order_status,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total_price,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders"""


def _orders_for_csv(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order Key"),
        F.col("o_orderstatus").alias(" Order Status "),
        F.col("o_totalprice").cast("decimal(18,2)").alias("Total Price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
    )


@query(_ORDER_TEXTS)
def raw_csv_scan(spark, sf):
    path = new_path(spark, "orders-csv")
    _orders_for_csv(spark, sf).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_raw_csv(spark, path)


def _keyed_csv(spark: SparkSession, sf: str, name: str, *cols: str) -> str:
    path = new_path(spark, f"{name}-csv")
    df = src.table(spark, sf, name).select(F.lit(name).alias("source"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)])
    df.write.option("header", True).csv(path)
    return path


@query(
    """SELECT 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS c0, CAST(o_custkey AS VARCHAR) AS c1 FROM orders
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer
    UNION ALL SELECT 'lineitem', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM lineitem
    UNION ALL SELECT 'left out: ' || CAST(count(DISTINCT 1) AS VARCHAR) || ' file of 2 columns', NULL, NULL FROM region"""
)
def csv_capped_scan(spark, sf):
    """Under the blueprint's name, without its cap: all rows of three sources; ``region`` has another number of columns and is listed as left out."""
    paths = [
        _keyed_csv(spark, sf, "orders", "o_orderkey", "o_custkey"),
        _keyed_csv(spark, sf, "customer", "c_custkey", "c_nationkey"),
        _keyed_csv(spark, sf, "region", "r_regionkey"),
        _keyed_csv(spark, sf, "lineitem", "l_orderkey", "l_linenumber"),
    ]
    found = files.read_csv_files(spark, paths)
    left = found.left_out.groupBy("columns").agg(F.count(F.lit(1)).alias("n")).select(
        F.format_string("left out: %s file of %s columns", "n", "columns").alias("source"),
        F.lit(None).cast("string").alias("c0"),
        F.lit(None).cast("string").alias("c1"),
    )
    return found.rows.unionByName(left)


@query(
    f"""WITH {q.CATALOGUE} SELECT urn, domain, "table", status, copies, instance,
    array_to_string(columns, ',') AS columns FROM registry"""
)
def dataset_registry(spark, sf):
    return src.catalogue(spark, sf).select(
        "urn", "domain", "table", "status", "copies", "instance", _joined("columns")
    )


@query(f"WITH {q.CATALOGUE} SELECT urn, copies FROM registry WHERE copies > 1")
def registry_duplicates(spark, sf):
    return catalog.duplicate_datasets(src.catalogue(spark, sf)).select("urn", "copies")


@query(
    f"""SELECT {q.urn("'nation_1'", "('customer_' || CAST(c_custkey AS VARCHAR))")} AS urn,
    'customer_' || CAST(c_custkey AS VARCHAR) AS "table" FROM customer WHERE c_nationkey = 1"""
)
def dataset_lookup(spark, sf):
    """All datasets of one instance; ``nation_1`` must not find ``nation_10``."""
    return catalog.find_datasets(src.nation_registry(spark, sf), "sqlite", "nation_1")


@query(
    "SELECT * FROM lineitem ORDER BY ALL LIMIT 5"
)
def dataset_sample(spark, sf):
    lines = src.table(spark, sf, "lineitem")
    return catalog.sample_rows(lines, 5, order_by=lines.columns)


@query(f"WITH {q.STAGING_PATIENTS} SELECT * FROM staging")
def materialize_roundtrip(spark, sf):
    """Written, registered as a view, and read through it."""
    staged = pipeline.stage_clean(src.patients(spark, sf))
    files.materialize(staged, new_path(spark, "staging"), view="staging_patients")
    return spark.table("staging_patients")


@query(
    f"""WITH {q.STREAMS}, own AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS tags
      FROM events WHERE value > 200 GROUP BY user_id),
    d AS (SELECT u.*, {q.pii('u.columns')} AS found, CASE WHEN own.tags IS NOT NULL THEN own.tags
      WHEN domain = 'healthcare' THEN ['pii', 'hipaa_regulated', 'quality_monitored']
      WHEN domain = 'fiction-retail' THEN ['pci_dss', 'financial_critical']
      ELSE ['public_data', 'analytics'] END AS tags FROM users u LEFT JOIN own USING (user_id))
    SELECT urn, domain, "table", array_to_string(tags, ',') AS tags,
      array_to_string(columns, ',') AS columns, array_to_string(found, ',') AS detected_pii_fields,
      len(found) > 0 AS has_high_pii_risk FROM d"""
)
def dataset_inspect(spark, sf):
    """Tags come from the types of a dataset's large events; one without any gets its domain's."""
    events = src.table(spark, sf, "events").filter("value > 200")
    tags = events.groupBy(src.stream_urn(F.col("user_id")).alias("urn")).agg(
        F.sort_array(F.collect_set("event_type")).alias("tags")
    )
    seen = catalog.inspect_datasets(src.stream_registry(spark, sf), tags)
    return seen.select(
        "urn", "domain", "table", _joined("tags"), _joined("columns"),
        _joined("detected_pii_fields"), "has_high_pii_risk",
    )


_AUDIT = """SELECT l_returnflag, l_linestatus, count(*) AS line_count, max(l_shipdate) AS last_shipdate,
  sum(CASE WHEN l_discount > l_tax THEN 1 ELSE 0 END) AS discount_over_tax,
  sum(CASE WHEN o_orderdate > l_shipdate THEN 1 ELSE 0 END) AS shipped_before_order
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag, l_linestatus"""


@query(
    _AUDIT.replace("sum(CASE", "CAST(sum(CASE").replace("THEN 1 ELSE 0 END)", "THEN 1 ELSE 0 END) AS BIGINT)")
)
def audit_sql(spark, sf):
    tables = {t: src.table(spark, sf, t) for t in ("lineitem", "orders")}
    return catalog.audit_sql(spark, tables, _AUDIT)


_ASSIGNED = f"""reg AS (SELECT {q.urn("('customer_' || CAST(o_custkey AS VARCHAR))", "('order_' || CAST(o_orderkey AS VARCHAR))")} AS urn,
  o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""


@query(
    f"""WITH {_ASSIGNED} SELECT urn,
      array_to_string(list_sort(list(DISTINCT 'flag_' || lower(l_returnflag))), ',') AS tags,
      array_to_string(list_sort(list(DISTINCT 'status_' || lower(l_linestatus))), ',') AS terms,
      arg_max('team_' || CAST(l_suppkey AS VARCHAR), lpad(CAST(l_linenumber AS VARCHAR), 5, '0') || 'team_' || CAST(l_suppkey AS VARCHAR)) AS owner
    FROM reg JOIN lineitem ON l_orderkey = o_orderkey GROUP BY urn"""
)
def dataset_metadata(spark, sf):
    out = catalog.attach_metadata(src.order_registry(spark, sf), src.assignments(spark, sf))
    return out.select("urn", _joined("tags"), _joined("terms"), "owner")


@query(
    """SELECT k.kind, CASE k.kind WHEN 'tag' THEN 'flag_' || lower(l_returnflag) WHEN 'term' THEN 'status_' || lower(l_linestatus)
      ELSE 'team_' || CAST(l_suppkey AS VARCHAR) END AS value, 'order_' || CAST(l_orderkey AS VARCHAR) AS "table",
      l_linenumber AS position
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    CROSS JOIN (VALUES ('tag'), ('term'), ('owner')) AS k(kind) WHERE o_orderstatus = 'P'"""
)
def metadata_unknown(spark, sf):
    found = catalog.unknown_assignments(src.order_registry(spark, sf), src.assignments(spark, sf))
    return found.select("kind", "value", "table", "position")


# --- profiles ------------------------------------------------------------------------------------

_TEXTS = tuple(src.SCHEMAS["patients"])
_NULLS = q.null_findings("patients", "raw_patients", _TEXTS, ["visit_id"])
_NEGATIVES = q.negative_findings("patients", "raw_patients", ("visit_id", *_TEXTS))
_RANGES = q.range_findings("patients", "raw_patients", ["age"])
_DATES = ("date_of_admission", "discharge_date")
_INVERSION = q.order_finding("patients", "raw_patients", *_DATES, texts=_DATES)


def _profiled(parts: list[str]) -> str:
    return f"WITH {q.PATIENTS} {q.findings(parts)}"


@query(_profiled(_NULLS))
def profile_nulls(spark, sf):
    return profile.null_profile(src.patients(spark, sf), "raw_patients")


@query(_profiled(_NEGATIVES))
def profile_negatives(spark, sf):
    return profile.negative_profile(src.patients(spark, sf), "raw_patients")


@query(_profiled(_RANGES))
def profile_ranges(spark, sf):
    return profile.range_profile(src.patients(spark, sf), name="raw_patients")


_DATED = "dated AS (SELECT *, CAST(o_orderdate AS DATE) AS order_date FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(
    f"""WITH {q.PATIENTS}, {_DATED} """
    + q.findings(
        [_INVERSION]
        + [
            q.order_finding("dated", "order_lines", a, b)
            for a, b in (("o_orderdate", "l_shipdate"),)
        ]
        + [
            q.finding("dated", "order_lines", a, "date_inversion", f"CAST({a} AS DATE) > CAST({b} AS DATE)", column_2=b)
            for a, b in (("o_orderdate", "order_date"), ("l_shipdate", "order_date"))
        ]
    )
)
def profile_date_inversions(spark, sf):
    """Text dates, and typed times against days. ``l_extendedprice`` has ``end`` in its name but no time."""
    orders, lines = src.table(spark, sf, "orders"), src.table(spark, sf, "lineitem")
    dated = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    dated = dated.withColumn("order_date", F.col("o_orderdate").cast("date"))
    return profile.date_order_profile(src.patients(spark, sf), name="raw_patients").unionByName(
        profile.date_order_profile(dated, name="order_lines")
    )


@query(
    "WITH " + q.MARTS + " " + q.findings(
        q.null_findings(
            "billing", "mart_billing",
            ["name", "hospital", "insurance_provider", "admission_type", "date_of_admission",
             "discharge_date", "medication", "pipeline_status"],
            ["billing_amount", "length_of_stay_days"], blanks="('')",
        )
        + q.negative_findings("billing", "mart_billing", ["billing_amount", "length_of_stay_days"])
    )
)
def profile_declared_types(spark, sf):
    staged = pipeline.stage_clean(src.patients(spark, sf))
    return profile.declared_profile(pipeline.mart_billing(staged), "mart_billing")


@query(_profiled([*_NULLS, *_NEGATIVES, *_RANGES, _INVERSION]))
def profile_table(spark, sf):
    """The flagship: a whole table profiled in one pass."""
    return profile.profile(src.patients(spark, sf), "raw_patients")


_STREAM_FINDINGS = [
    *q.null_findings("stream_rows", "", ["event_type"], ["value", "age", "start_ts", "end_ts"], by="urn"),
    *q.negative_findings("stream_rows", "", ["value", "age"], by="urn"),
    *q.range_findings("stream_rows", "", ["age"], by="urn"),
    q.order_finding("stream_rows", "", "start_ts", "end_ts", by="urn"),
]


@query(f"WITH {q.STREAM_ROWS} {q.findings(_STREAM_FINDINGS)}")
def profile_datasets(spark, sf):
    """Many datasets held in one table, profiled in one pass."""
    return profile.profile(src.stream_rows(spark, sf), by="urn")


# ``gender`` has ``end`` in it, which is all that ``compat`` looks for.
_TEXT_DATES = ("gender", "date_of_admission", "admission_type", "discharge_date")


@query(
    _profiled(
        [
            *_NULLS, *_NEGATIVES, *_RANGES,
            *[
                q.finding("patients", "raw_patients", a, "date_inversion", f"{a} > {b} AND {a} <> '' AND {b} <> ''", column_2=b)
                for i, a in enumerate(_TEXT_DATES) for b in _TEXT_DATES[i + 1 :]
            ],
            *q.null_findings("pages", "pages", ["url", "html"], ["page_id"]),
            *q.range_findings("pages", "pages", ["page_id"]),
        ]
    )
)
def profile_loose(spark, sf):
    """``compat``: dates compare as text, admission types included, and ``page_id`` counts as an age."""
    loose = profile.profile(src.patients(spark, sf), "raw_patients", mode="compat")
    return loose.unionByName(profile.profile(src.table(spark, sf, "pages"), "pages", mode="compat"))


# Text columns and numeric columns of the given tables, the rest can only be NULL.
_GIVEN = {
    "region": (["r_name"], ["r_regionkey"], []),
    "nation": (["n_name"], ["n_nationkey", "n_regionkey"], []),
    "customer": (["c_name", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"], []),
    "supplier": (["s_name"], ["s_suppkey", "s_nationkey", "s_acctbal"], []),
    "part": (["p_name", "p_brand", "p_type"], ["p_partkey", "p_size", "p_retailprice"], []),
    "orders": (["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderdate"]),
    "lineitem": (
        ["l_returnflag", "l_linestatus"],
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_shipdate"],
    ),
    "events": (["event_type", "props"], ["event_id", "user_id", "value"], ["ts"]),
    "documents": (["text", "lang", "source"], ["doc_id", "n_chars"], []),
    "embeddings": ([], ["vec_id", "label"], ["embedding"]),
    "pages": (["url", "html"], ["page_id"], []),
    "benchmark": (["text"], ["item_id"], []),
    "labels": ([], ["doc_id", "quality", "toxic"], []),
    "conversations": (["role", "text"], ["conv_id", "turn"], []),
}


@query(
    q.findings(
        [
            part
            for t, (texts, numbers, others) in _GIVEN.items()
            for part in (
                *q.null_findings(t, t, texts, numbers + others),
                *q.negative_findings(t, t, texts + numbers),
            )
        ]
    )
)
def profile_all_tables(spark, sf):
    """All given tables, texts and arrays included, each in one pass."""
    out = None
    for t in src.TABLES:
        found = profile.profile(src.table(spark, sf, t), t)
        out = found if out is None else out.unionByName(found)
    return out


@query(
    f"""WITH {q.PATIENTS}, found AS ({q.findings([*_NULLS, *_NEGATIVES, *_RANGES, _INVERSION])})
    SELECT dataset, "column", issue AS type, bad_rows AS occurrences FROM found"""
)
def anomaly_summary(spark, sf):
    """One row per defect, counted again: must agree with the profile."""
    return profile.summarize_anomalies(profile.defects(src.patients(spark, sf), "raw_patients"))


# --- personal data -------------------------------------------------------------------------------


@query(
    f"""WITH {q.CATALOGUE} SELECT urn, array_to_string({q.pii('columns')}, ',') AS pii_columns,
    len({q.pii('columns')}) > 0 AS has_pii FROM registry"""
)
def pii_columns(spark, sf):
    found = catalog.detect_pii_columns(src.catalogue(spark, sf))
    return found.select("urn", _joined("pii_columns"), "has_pii")


_WORDS_B = "(^|[^a-z0-9])(name|ssn|passport|email|patient|driver|credit_card|license)([^a-z0-9]|$)"


@query(
    f"""WITH {q.CATALOGUE} SELECT urn, array_to_string({q.pii('columns', _WORDS_B)}, ',') AS pii_columns,
    len({q.pii('columns', _WORDS_B)}) > 0 AS has_pii FROM registry"""
)
def pii_columns_whole_words(spark, sf):
    found = catalog.detect_pii_columns(
        src.catalogue(spark, sf), keywords=catalog.PII_KEYWORDS_B, match="token"
    )
    return found.select("urn", _joined("pii_columns"), "has_pii")


# --- freshness -----------------------------------------------------------------------------------


@query(
    """SELECT 'events' AS dataset, 'ts' AS time_col, CAST(max(epoch_us(ts) // 1000) AS BIGINT) AS last_ts_ms FROM events
    UNION ALL SELECT 'orders', 'o_orderdate', CAST(max(epoch_us(o_orderdate) // 1000) AS BIGINT) FROM orders
    UNION ALL SELECT 'lineitem', 'l_shipdate', CAST(max(epoch_us(l_shipdate) // 1000) AS BIGINT) FROM lineitem
    UNION ALL SELECT 'part', NULL, NULL"""
)
def freshness_last_ts(spark, sf):
    t = {n: src.table(spark, sf, n) for n in ("events", "orders", "lineitem", "part")}
    out = freshness.last_event_ts(t["events"], "ts", "events")
    for n in ("orders", "lineitem", "part"):
        out = out.unionByName(freshness.last_event_ts(t[n], name=n))
    return out


@query()
def file_freshness(spark, sf):
    """Times of files are not in the tables, so there is no SQL."""
    out = None
    for n in src.TABLES:
        one = freshness.file_mtime_ms(src.table(spark, sf, n), n)
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS dataset, '{'column' if t in ('orders', 'lineitem') else 'file'}' AS source, true AS has_time"
        for t in src.TABLES
    )
)
def freshness_chain(spark, sf):
    """Where each table's time comes from: a column of times, else the files. The times of files are in the tests."""
    out = None
    for n in src.TABLES:
        df = src.table(spark, sf, n)
        one = freshness.freshness(df, AS_OF, name=n, files=df).select(
            "dataset", "source", F.col("last_ts_ms").isNotNull().alias("has_time")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {q.FRESHNESS} SELECT {q.STREAM_URN.format('user_id')} AS dataset, 'ts' AS time_col, last_ts_ms,
    'column' AS source, hours_stale, hours_stale > 24 AS is_stale FROM fresh"""
)
def freshness_sla(spark, sf):
    return _stream_freshness(spark, sf)


def _stream_freshness(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.table(spark, sf, "events").select(src.stream_urn(F.col("user_id")).alias("urn"), "ts")
    return freshness.freshness(rows, AS_OF, time_col="ts", by="urn")


def _trip_stages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw trips, staging three days behind, and the daily mart with one empty day."""
    raw = src.trips(spark, sf)
    staging = pipeline.stage_trips(raw)
    stale = plant.cut_after(staging, "trip_date")
    daily = plant.cut_after(pipeline.daily_summary(staging, ordered=False), "trip_date", reference=staging)
    empty = plant.days_before_last(staging, "trip_date", plant.STALE_DAYS + plant.EMPTY_DAY_BEFORE_CUT)
    mart = plant.zero_day(daily, "trip_date", MEASURES, empty)
    return raw, stale, mart


@query(
    f"""WITH {q.STALE}, stages AS (
      SELECT 0 AS position, 'raw_trips' AS stage, CAST(max(tpep_pickup_datetime) AS DATE) AS last_day FROM raw_trips
      UNION ALL SELECT 1, 'staging_trips', max(trip_date) FROM stale_trips
      UNION ALL SELECT 2, 'mart_daily_summary', max(trip_date) FROM stale_daily)
    SELECT position, stage, last_day, CAST(date_diff('day', last_day,
      (SELECT last_day FROM stages WHERE position = 0)) AS INTEGER) AS lag_days FROM stages"""
)
def stage_lag(spark, sf):
    raw, staging, mart = _trip_stages(spark, sf)
    return freshness.stage_lag(
        [
            ("raw_trips", raw, "tpep_pickup_datetime"),
            ("staging_trips", staging, "trip_date"),
            ("mart_daily_summary", mart, "trip_date"),
        ]
    )


@query(
    """SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)),
      max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)
    WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)"""
)
def missing_days(spark, sf):
    return freshness.missing_days(src.table(spark, sf, "orders"), "o_orderdate")


@query(
    f"""WITH {q.TRIPS} SELECT DISTINCT CAST(tpep_pickup_datetime AS DATE) AS day FROM raw_trips
    WHERE tpep_pickup_datetime IS NOT NULL AND CAST(tpep_pickup_datetime AS DATE) NOT IN (
      SELECT trip_date FROM trips WHERE trip_date <= (SELECT max(trip_date) FROM trips) - 3)"""
)
def missing_upstream_days(spark, sf):
    """Days the raw table has and the stale staging table has not."""
    raw, staging, _ = _trip_stages(spark, sf)
    upstream = raw.select(F.col("tpep_pickup_datetime").cast("date").alias("day")).filter("day is not null")
    return freshness.missing_days(staging, "trip_date", calendar=upstream)


@query(f"WITH {q.STALE} SELECT * FROM stale_daily WHERE trip_count = 0")
def empty_load_days(spark, sf):
    mart = _trip_stages(spark, sf)[2]
    return freshness.empty_loads(mart, "trip_count")


# --- lineage and graph ---------------------------------------------------------------------------


@query(f"WITH {q.ENTITY_EDGES} SELECT src, dst FROM k_edges")
def lineage_fk_edges(spark, sf):
    return lineage.fk_edges(src.entities(spark, sf), src.entity_fks(spark, sf))


@query(f"WITH {q.ENTITY_EDGES} SELECT dst AS src, src AS dst FROM k_edges")
def lineage_child_to_parent(spark, sf):
    return lineage.fk_edges(src.entities(spark, sf), src.entity_fks(spark, sf), lineage.CHILD_TO_PARENT)


@query(f"WITH {q.ENTITY_EDGES} SELECT src, dst FROM k_edges")
def lineage_discovered(spark, sf):
    """Foreign keys are there, so the naming convention is not asked."""
    return lineage.discover_edges(src.entities(spark, sf), src.entity_fks(spark, sf))


_LAYERS = q.CATALOGUE + """,
layered AS (SELECT domain, urn, CASE split_part("table", '_', 1) WHEN 'raw' THEN 0 WHEN 'staging' THEN 1 ELSE 2 END AS layer
  FROM registry)"""


@query(
    f"""WITH {_LAYERS} SELECT a.urn AS src, b.urn AS dst FROM layered a JOIN layered b
    ON a.domain = b.domain AND b.layer = a.layer + 1"""
)
def lineage_layer_edges(spark, sf):
    """A domain is one customer with at most one table per layer and year, so pairs stay few."""
    return lineage.layer_edges(src.catalogue(spark, sf))


@query(
    f"""WITH {_LAYERS} SELECT a.urn AS src, b.urn AS dst FROM layered a JOIN layered b
    ON a.domain = b.domain AND b.layer = a.layer + 1"""
)
def lineage_discovered_layers(spark, sf):
    """No foreign keys: the naming convention gives the edges."""
    none = src.entity_fks(spark, sf).filter(F.col("target_table").isNull())
    return lineage.discover_edges(src.catalogue(spark, sf), none)


@query(
    f"""WITH {_LAYERS}
    SELECT urn AS src, 'junction|' || domain || '|' || CAST(layer + 1 AS VARCHAR) AS dst FROM layered WHERE layer < 2
    UNION ALL SELECT 'junction|' || domain || '|' || CAST(layer AS VARCHAR), urn FROM layered WHERE layer > 0"""
)
def lineage_layer_links(spark, sf):
    return lineage.layer_links(src.catalogue(spark, sf))


@query(
    f"""SELECT DISTINCT {q.entity('part', 'l_partkey')} AS src, {q.entity('orders', 'l_orderkey')} AS dst FROM lineitem
    UNION SELECT {q.entity('supplier', 'l_suppkey')}, {q.entity('orders', 'l_orderkey')}
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0"""
)
def lineage_declared_edges(spark, sf):
    return lineage.declared_edges(src.declared_mapping(spark, sf), src.registered_entities(spark, sf))


@query(
    """SELECT DISTINCT 'supplier_' || CAST(l_suppkey AS VARCHAR) AS "table", 'upstream' AS role
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0"""
)
def lineage_unknown_names(spark, sf):
    return lineage.unknown_names(src.declared_mapping(spark, sf), src.registered_entities(spark, sf))


def _centrality(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # Written once: the events behind both are read for the graph and again for what is joined to it.
    registry, edges = cut(src.stream_registry(spark, sf), "registry"), cut(src.stream_edges(spark, sf), "lineage")
    return registry, edges, graph.betweenness(src.stream_nodes(spark, sf), edges)


@query(
    f"""WITH {q.CENTRALITY} SELECT {q.STREAM_URN.format('id')} AS id, round(betweenness, 6) AS betweenness,
    round(centrality, 9) AS centrality FROM central"""
)
def graph_betweenness(spark, sf):
    found = _centrality(spark, sf)[2]
    return found.withColumns({"betweenness": F.round("betweenness", 6), "centrality": F.round("centrality", 9)})


def _entity_edges(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.fk_edges(src.entities(spark, sf), src.entity_fks(spark, sf))


def _starts(spark: SparkSession, sf: str, domain: str) -> DataFrame:
    return src.entities(spark, sf).filter(F.col("domain") == domain).select(F.col("urn").alias("id"))


@query(
    f"""WITH {q.ENTITY_EDGES} SELECT {q.entity('nation', 'n_nationkey')} AS start, dst AS node, 1 AS distance
    FROM nation JOIN k_edges ON src = {q.entity('nation', 'n_nationkey')}"""
)
def downstream_direct(spark, sf):
    starts = _starts(spark, sf, "nation")
    edges = lineage.fk_edges(src.entities(spark, sf), src.entity_fks(spark, sf), upstream=starts)
    return lineage.downstream(edges, starts, hops=1)


@query(
    f"""WITH {q.ENTITY_EDGES}, d0 AS (SELECT {q.entity('region', 'r_regionkey')} AS start FROM region),
    d1 AS (SELECT start, dst AS node FROM d0 JOIN k_edges ON src = start),
    d2 AS (SELECT DISTINCT start, dst AS node FROM d1 JOIN k_edges ON src = node),
    d3 AS (SELECT DISTINCT start, dst AS node FROM d2 JOIN k_edges ON src = node)
    SELECT start, node, min(distance) AS distance FROM (SELECT *, 1 AS distance FROM d1
      UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY start, node"""
)
def downstream_transitive(spark, sf):
    return lineage.downstream(_entity_edges(spark, sf), _starts(spark, sf, "region"), hops=None)


_LAYER_PAIRS = _LAYERS + """,
pairs AS (SELECT a.urn AS src, b.urn AS dst FROM layered a JOIN layered b ON a.domain = b.domain AND b.layer = a.layer + 1)"""


@query(
    f"""WITH {_LAYER_PAIRS} SELECT src AS start, dst AS node, 1 AS distance FROM pairs
    UNION SELECT a.src, b.dst, 2 FROM pairs a JOIN pairs b ON a.dst = b.src"""
)
def downstream_layers(spark, sf):
    """What lies below every table by the naming convention, through junctions: no foreign keys, and no pairs of tables as edges."""
    registry = src.catalogue(spark, sf)
    none = src.entity_fks(spark, sf).filter(F.col("target_table").isNull())
    return lineage.discover_downstream(registry, none, registry.select(F.col("urn").alias("id")), hops=None)


@query(
    f"""WITH {_LAYER_PAIRS} SELECT urn AS id, urn NOT IN (SELECT dst FROM pairs) AS is_root, urn NOT IN (SELECT src FROM pairs) AS is_sink,
    urn NOT IN (SELECT dst FROM pairs) AND urn NOT IN (SELECT src FROM pairs) AS is_isolated FROM layered"""
)
def lineage_layer_roles(spark, sf):
    return lineage.layer_roles(src.catalogue(spark, sf))


@query(
    f"""WITH {q.CENTRALITY} SELECT {q.STREAM_URN.format('id')} AS id, is_root, is_sink, is_isolated, is_orphan
    FROM roles"""
)
def lineage_node_roles(spark, sf):
    _, edges, central = _centrality(spark, sf)
    return lineage.node_roles(src.stream_nodes(spark, sf), edges, central)


# --- risk ----------------------------------------------------------------------------------------


def _risk_inputs(spark: SparkSession, sf: str, formula: str) -> DataFrame:
    registry, edges, central = _centrality(spark, sf)
    registry = catalog.detect_pii_columns(registry)
    roles = None
    if formula == risk.WEIGHTED:
        roles = lineage.node_roles(registry.select(F.col("urn").alias("id")), edges, central)
    return risk.score_all(registry, _stream_freshness(spark, sf), central, roles, formula)


@query(
    f"""WITH {q.SCORES} SELECT urn, array_to_string(pii_columns, ',') AS pii_columns, has_pii,
    hours_stale, round(centrality, 9) AS centrality, risk_score, risk_score >= 0.65 AS is_high_risk FROM scores"""
)
def risk_score(spark, sf):
    return _risk_inputs(spark, sf, risk.STANDARD).select(
        "urn", _joined("pii_columns"), "has_pii", "hours_stale",
        F.round("centrality", 9).alias("centrality"), "risk_score", "is_high_risk",
    )


@query(
    f"""WITH {q.SCORES}, weighted AS (SELECT *, round(least(centrality * 0.4::DOUBLE
      + CASE WHEN has_pii THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN is_orphan THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN hours_stale > 24 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE), 3) AS score FROM inputs)
    SELECT urn, array_to_string(pii_columns, ',') AS pii_columns, has_pii, is_orphan,
      round(hours_stale, 1) AS hours_stale, hours_stale > 24 AS has_freshness_issue,
      score AS risk_score, score >= 0.65 AS is_high_risk FROM weighted"""
)
def risk_score_weighted(spark, sf):
    return _risk_inputs(spark, sf, risk.WEIGHTED).select(
        "urn", _joined("pii_columns"), "has_pii", "is_orphan", "hours_stale", "has_freshness_issue",
        "risk_score", "is_high_risk",
    )


@query(
    f"""WITH {q.SCORES} SELECT count(*) AS total_evaluated, count(*) FILTER (WHERE risk_score >= 0.65) AS high_risk_count,
    count(*) FILTER (WHERE is_stale) AS freshness_count, count(*) FILTER (WHERE has_pii) AS pii_count FROM scores"""
)
def risk_summary(spark, sf):
    return risk.risk_summary(_risk_inputs(spark, sf, risk.STANDARD))


@query(
    f"""WITH {q.SCORES} SELECT 'freshness' AS kind, urn, hours_stale,
      CAST(NULL AS VARCHAR) AS pii_fields, risk_score FROM scores WHERE is_stale
    UNION ALL SELECT 'pii', urn, NULL, array_to_string(pii_columns, ','), NULL FROM scores WHERE has_pii"""
)
def risk_vulnerabilities(spark, sf):
    scores = cut(_risk_inputs(spark, sf, risk.STANDARD), "scores")
    stale = risk.freshness_vulnerabilities(scores).select(
        F.lit("freshness").alias("kind"), "urn", "hours_stale",
        F.lit(None).cast("string").alias("pii_fields"), "risk_score",
    )
    personal = risk.pii_vulnerabilities(scores).select(
        F.lit("pii").alias("kind"), "urn", F.lit(None).cast("double").alias("hours_stale"), _joined("pii_fields"),
        F.lit(None).cast("double").alias("risk_score"),
    )
    return stale.unionByName(personal)


@query(
    f"""WITH {q.SCORES}, {q.STREAM_ROWS}, found AS ({q.findings(_STREAM_FINDINGS)}),
    listed AS (SELECT dataset, string_agg("column" || ':' || issue || ':' || bad_rows, ',' ORDER BY "column", issue) AS findings
      FROM found GROUP BY dataset),
    below AS (SELECT src, count(*) AS n FROM g_edges GROUP BY src)
    SELECT s.urn, s."table" AS table_name, round(s.centrality, 4) AS centrality, s.risk_score, s.risk_score >= 0.65 AS is_high_risk,
      array_to_string(s.pii_columns, ',') AS pii_columns, coalesce(b.n, 0) AS downstream_count,
      coalesce(l.findings, '') AS findings
    FROM scores s JOIN users u ON u.urn = s.urn LEFT JOIN below b ON b.src = u.user_id LEFT JOIN listed l ON l.dataset = s.urn"""
)
def governance_context(spark, sf):
    context = _context(spark, sf)
    texts = F.transform(
        "statistical_profile",
        lambda f: F.concat_ws(":", f["column"], f["issue"], f["bad_rows"].cast("string")),
    )
    return context.datasets.select(
        "urn", "table_name", "centrality", "risk_score", "is_high_risk", _joined("pii_columns"),
        "downstream_count", F.array_join(F.array_sort(texts), ",").alias("findings"),
    )


@query(f"WITH {q.STREAMS} SELECT {q.STREAM_URN.format('src')} AS src, {q.STREAM_URN.format('dst')} AS dst FROM g_edges")
def governance_edges(spark, sf):
    """The context as it is written for other tools, read back: its edges."""
    path = new_path(spark, "context")
    risk.write_context(_context(spark, sf), path)
    return spark.read.schema("src string, dst string").json(f"{path}/lineage_edges")


def _context(spark: SparkSession, sf: str) -> risk.GovernanceContext:
    registry, edges, central = _centrality(spark, sf)
    return risk.governance_context(
        catalog.detect_pii_columns(registry), edges, _stream_freshness(spark, sf), central,
        profile.profile(src.stream_rows(spark, sf), by="urn"),
    )


# --- remediation ---------------------------------------------------------------------------------

_CLIPPED = "CASE WHEN TRY_CAST(billing_amount AS DOUBLE) < 0 THEN '0' ELSE billing_amount END"
_AGED = "CASE WHEN TRY_CAST(age AS DOUBLE) < 0 OR TRY_CAST(age AS DOUBLE) > 120 THEN NULL ELSE age END"
_FIRST = "CASE WHEN date_of_admission > discharge_date THEN discharge_date ELSE date_of_admission END"
_LAST = "CASE WHEN date_of_admission > discharge_date THEN date_of_admission ELSE discharge_date END"


@query(f"WITH {q.PATIENTS} SELECT * REPLACE ({_CLIPPED} AS billing_amount) FROM patients")
def fix_negatives(spark, sf):
    return remediate.clip_negative(src.patients(spark, sf), ["billing_amount"])


@query(f"WITH {q.PATIENTS} SELECT * REPLACE ({_AGED} AS age) FROM patients")
def fix_ranges(spark, sf):
    return remediate.null_out_of_range(src.patients(spark, sf), {"age": profile.AGE_RANGE})


_PARTLY = """partly AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title,
  CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS amount,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS day FROM orders)"""


@query(
    f"""WITH {_PARTLY} SELECT o_orderkey, coalesce(title, 'UNKNOWN') AS title, coalesce(amount, 0.0) AS amount, day
    FROM partly"""
)
def fix_nulls(spark, sf):
    """A text, a number and a date that are missing in some rows; a date has no neutral value."""
    s = F.col("o_orderstatus")
    df = src.table(spark, sf, "orders").select(
        "o_orderkey", F.when(s != "P", F.col("o_orderpriority")).alias("title"),
        F.when(s != "F", F.col("o_totalprice")).alias("amount"),
        F.when(s != "O", F.col("o_orderdate").cast("date")).alias("day"),
    )
    return remediate.fill_nulls(df, ["title", "amount", "day"])


@query(
    """SELECT * REPLACE (CASE WHEN o_orderdate > l_shipdate THEN l_shipdate ELSE o_orderdate END AS o_orderdate,
    CASE WHEN o_orderdate > l_shipdate THEN o_orderdate ELSE l_shipdate END AS l_shipdate)
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
)
def fix_date_order(spark, sf):
    orders, lines = src.table(spark, sf, "orders"), src.table(spark, sf, "lineitem")
    df = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return remediate.swap_dates(df, "o_orderdate", "l_shipdate")


_CLEANED = f"""SELECT visit_id, coalesce(name, 'UNKNOWN') AS name, {_AGED} AS age, gender, blood_type, medical_condition,
  {_FIRST} AS date_of_admission, doctor, hospital, insurance_provider, {_CLIPPED} AS billing_amount, room_number,
  admission_type, {_LAST} AS discharge_date, medication, test_results FROM patients"""


@query(f"WITH {q.PATIENTS} {_CLEANED}")
def cleaned_table(spark, sf):
    df = src.patients(spark, sf)
    return remediate.remediate(df, profile.profile(df, "raw_patients"))


@query(
    f"""WITH {q.PATIENTS} SELECT * FROM patients
    WHERE TRY_CAST(billing_amount AS DOUBLE) >= 0 OR TRY_CAST(billing_amount AS DOUBLE) IS NULL"""
)
def drop_invalid_rows(spark, sf):
    return remediate.drop_invalid(src.patients(spark, sf), "billing_amount")


def _filled(column: str, filler: str, bad: str = "false") -> str:
    """A dataset's missing values are filled if it has no rows that are ``bad``."""
    return f"CASE WHEN bool_or({bad}) OVER (PARTITION BY urn) THEN {column} ELSE coalesce({column}, {filler}) END"


@query(
    f"""WITH {q.STREAM_ROWS}, partly AS (SELECT * REPLACE (CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value)
      FROM stream_rows)
    SELECT urn, coalesce(event_type, 'UNKNOWN') AS event_type,
      CASE WHEN value < 0 THEN 0.0 ELSE {_filled('value', '0.0', 'coalesce(value, 0) < 0')} END AS value,
      CASE WHEN age < 0 OR age > 120 THEN NULL ELSE age END AS age,
      least(start_ts, end_ts) AS start_ts, greatest(start_ts, end_ts) AS end_ts FROM partly"""
)
def cleaned_datasets(spark, sf):
    """Many datasets held in one table, each repaired by its own findings: amounts that are missing become 0 only where
    a dataset has no negative ones."""
    rows = src.stream_rows(spark, sf)
    rows = rows.withColumn("value", F.when(~F.col("event_type").eqNullSafe("click"), F.col("value")))
    return remediate.remediate_datasets(rows, profile.profile(rows, by="urn"), "urn")


_CHARGED = """charged AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS charge
  FROM orders)"""


@query(
    f"""WITH {_CHARGED} """
    + q.findings(
        q.negative_findings("charged", "charges", ["charge"])
        + q.range_findings("charged", "charges", ["charge", "o_custkey"], bounds=(-100000, 200000))
    )
)
def profile_custom_ranges(spark, sf):
    """Bounds of the caller's own, on columns that are not named like an age."""
    return profile.profile(_charged(spark, sf), "charges", ranges=_CHARGE_RANGES)


_CHARGE_RANGES = {"charge": (-100000, 200000), "o_custkey": (-100000, 200000)}
_REPAIRED = """SELECT o_orderkey, o_custkey,
  CASE WHEN charge < -100000 OR charge > 200000 THEN NULL ELSE charge END AS charge FROM charged"""


def _charged(spark: SparkSession, sf: str) -> DataFrame:
    charge = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return src.table(spark, sf, "orders").select("o_orderkey", "o_custkey", charge.alias("charge"))


@query(f"WITH {_CHARGED} {_REPAIRED}")
def cleaned_custom_ranges(spark, sf):
    """The bounds come from the findings: a negative charge within them stays."""
    df = _charged(spark, sf)
    return remediate.remediate(df, profile.profile(df, "charges", ranges=_CHARGE_RANGES))


@query(f"WITH {_CHARGED} {_REPAIRED}")
def fix_script(spark, sf):
    """The query of the script, run as SQL over the table it names."""
    df = _charged(spark, sf)
    script = remediate.fix_script(df, profile.profile(df, "charges", ranges=_CHARGE_RANGES), "charges")
    select = script.partition(" AS\n")[2]
    return catalog.audit_sql(spark, {"charges": df}, select)


_BY_HOSPITAL = [
    *q.null_findings("patients", "", [c for c in _TEXTS if c != "hospital"], ["visit_id"], by="hospital"),
    *q.negative_findings("patients", "", [c for c in ("visit_id", *_TEXTS) if c != "hospital"], by="hospital"),
    *q.range_findings("patients", "", ["age"], by="hospital"),
    q.order_finding("patients", "", *_DATES, by="hospital", texts=_DATES),
]


@query(
    f"""WITH {q.PATIENTS}, found AS ({q.findings(_BY_HOSPITAL)}) SELECT DISTINCT dataset, CASE
      WHEN issue = 'date_inversion' THEN 'Corrected inverted date logic between ''' || "column" || ''' and ''' || column_2 || ''''
      WHEN issue = 'null_or_blank' AND "column" LIKE '%name%' THEN 'Replaced NULLs with ''UNKNOWN'' in text column ''' || "column" || ''''
      WHEN issue = 'null_or_blank' THEN 'Replaced NULLs with 0 in column ''' || "column" || ''''
      WHEN "column" = 'age' THEN 'Fixed invalid age range in column ''' || "column" || ''''
      ELSE 'Fixed negative values in numeric column ''' || "column" || '''' END AS line
    FROM found f WHERE issue <> 'null_or_blank' OR NOT EXISTS (SELECT 1 FROM found n WHERE n.dataset = f.dataset
      AND n."column" = f."column" AND n.issue IN ('negative', 'invalid_age_range'))"""
)
def fix_report(spark, sf):
    df = src.patients(spark, sf)
    return remediate.fix_report(profile.profile(df, by="hospital"), df.schema)


_PATIENT_EDGES = [
    ("raw_patients", "staging_patients"), ("staging_patients", "mart_billing"),
    ("staging_patients", "mart_demographics"),
]
_WATCH = [
    ("mart_billing", "billing_amount", profile.NEGATIVE),
    ("mart_billing", "date_of_admission", profile.DATE_INVERSION),
    ("mart_demographics", "age", profile.INVALID_AGE),
    ("mart_demographics", "name", profile.NULL_OR_BLANK),
]


@query(
    f"""WITH {q.PATIENTS}, found AS ({q.findings([*_NULLS, *_NEGATIVES, *_RANGES, _INVERSION])}),
    watch(dataset, col, issue) AS (VALUES ('mart_billing', 'billing_amount', 'negative'),
      ('mart_billing', 'date_of_admission', 'date_inversion'), ('mart_demographics', 'age', 'invalid_age_range'),
      ('mart_demographics', 'name', 'null_or_blank')),
    tables(dataset) AS (VALUES ('staging_patients'), ('mart_billing'), ('mart_demographics')),
    hits AS (SELECT t.dataset, count(f.issue) AS defects FROM tables t LEFT JOIN watch w ON w.dataset = t.dataset
      LEFT JOIN found f ON f."column" = w.col AND f.issue = w.issue AND f.pct > 1.5 GROUP BY t.dataset)
    SELECT dataset, CASE WHEN defects > 0 THEN 'PAUSED' ELSE 'OPERATIONAL' END AS status, defects FROM hits"""
)
def circuit_breaker(spark, sf):
    """Pause only the marts that a frequent defect of the raw table reaches."""
    found = profile.profile(src.patients(spark, sf), "raw_patients")
    edges = spark.createDataFrame(_PATIENT_EDGES, "src string, dst string")
    watch = spark.createDataFrame(_WATCH, "dataset string, column string, issue string")
    return remediate.circuit_breaker(found, edges, watch.select("dataset", "column"), watch, threshold_pct=1.5)


@query(
    f"""WITH {q.PATIENTS}, found AS ({q.findings([*_NULLS, *_NEGATIVES, *_RANGES, _INVERSION])}),
    carried(dataset, col) AS (VALUES ('staging_patients', 'billing_amount'), ('staging_patients', 'age'),
      ('staging_patients', 'date_of_admission'), ('mart_billing', 'billing_amount'), ('mart_billing', 'date_of_admission'),
      ('mart_demographics', 'age')),
    tables(dataset) AS (VALUES ('staging_patients'), ('mart_billing'), ('mart_demographics')),
    hits AS (SELECT t.dataset, count(DISTINCT f."column" || f.issue) AS defects FROM tables t
      LEFT JOIN carried c ON c.dataset = t.dataset LEFT JOIN found f ON c.col IN (f."column", f.column_2) GROUP BY t.dataset)
    SELECT dataset, CASE WHEN defects > 0 THEN 'PAUSED' ELSE 'OPERATIONAL' END AS status, defects FROM hits"""
)
def circuit_breaker_renamed(spark, sf):
    """Defects reach the tables that carry the column, under another name too, renamed once or twice; a pair of dates counts
    once. The staging table drops the names, so the demographics, which have a column of that name, do not get their defects."""
    found = profile.profile(src.patients(spark, sf), "raw_patients")
    edges = spark.createDataFrame(_PATIENT_EDGES, "src string, dst string")
    columns = [
        *(("raw_patients", c) for c in src.SCHEMAS["patients"]), ("staging_patients", "amount"), ("staging_patients", "age"),
        ("staging_patients", "date_of_admission"), ("mart_billing", "charge"), ("mart_billing", "first_day"),
        ("mart_demographics", "name"), ("mart_demographics", "years"),
    ]
    renames = [
        ("staging_patients", "amount", "billing_amount"), ("mart_billing", "charge", "amount"),
        ("mart_billing", "first_day", "date_of_admission"), ("mart_demographics", "years", "age"),
    ]
    return remediate.circuit_breaker(
        found,
        edges,
        spark.createDataFrame(columns, "dataset string, column string"),
        renames=spark.createDataFrame(renames, "dataset string, column string, source_column string"),
    )


def _visit_lineage(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``edges, columns, renames`` of a pipeline for each hospital: raw, staging, billing and bills behind it. The billing
    tables rename the amount; hospitals of an even digit pass it on to their bills, renamed again, the others drop it."""
    hospital = src.patients(spark, sf).select("hospital").distinct().select(F.regexp_replace("hospital", " ", "_").alias("h"))
    of = lambda stage: F.concat_ws(".", "h", F.lit(stage))
    even = F.conv(F.substring("h", -1, 1), 16, 10).cast("int") % 2 == 0
    pair = lambda a, b: F.struct(of(a).alias("src"), of(b).alias("dst"))
    edges = hospital.select(F.inline(F.array(pair("raw", "staging"), pair("staging", "billing"), pair("billing", "bills"))))
    column = lambda stage, name: F.struct(of(stage).alias("dataset"), F.lit(name).alias("column"))
    held = [column("raw", c) for c in src.SCHEMAS["patients"]]
    held += [column("staging", c) for c in ("name", "age", "billing_amount")] + [column("bills", c) for c in ("total", "name", "billing_amount")]
    held += [F.when(even, column("billing", "amount")), column("billing", "age")]
    columns = hospital.select(F.explode(F.array(*held)).alias("x")).filter("x IS NOT NULL").select("x.*")
    rename = lambda stage, name, old: F.struct(of(stage).alias("dataset"), F.lit(name).alias("column"), F.lit(old).alias("source_column"))
    renames = hospital.select(F.inline(F.array(rename("billing", "amount", "billing_amount"), rename("bills", "total", "amount"))))
    return edges, columns, renames


@query(
    f"""WITH {q.PATIENTS}, found AS ({q.findings(_BY_HOSPITAL)}),
    hospitals AS (SELECT DISTINCT hospital, replace(hospital, ' ', '_') AS h, ('0x' || right(hospital, 1))::INT % 2 = 0 AS even FROM patients),
    reached AS (SELECT h.h, f."column" AS col, issue, column_2, unnest(CASE
        WHEN f."column" = 'billing_amount' AND even THEN ['staging', 'billing', 'bills'] WHEN f."column" = 'age' THEN ['staging', 'billing']
        WHEN f."column" IN ('name', 'billing_amount') THEN ['staging'] ELSE [] END) AS stage
      FROM found f JOIN hospitals h ON h.hospital = f.dataset),
    tables AS (SELECT h, unnest(['staging', 'billing', 'bills']) AS stage FROM hospitals)
    SELECT t.h || '.' || t.stage AS dataset, count(DISTINCT col || issue) AS defects,
      CASE WHEN count(DISTINCT col || issue) > 0 THEN 'PAUSED' ELSE 'OPERATIONAL' END AS status
    FROM tables t LEFT JOIN reached r ON r.h = t.h AND r.stage = t.stage GROUP BY t.h, t.stage"""
)
def circuit_breaker_by_column(spark, sf):
    """A pipeline for each hospital, its defects followed from column to column."""
    edges, columns, renames = _visit_lineage(spark, sf)
    found = profile.profile(src.patients(spark, sf), by="hospital")
    found = found.withColumn("dataset", F.concat(F.regexp_replace("dataset", " ", "_"), F.lit(".raw")))
    return remediate.circuit_breaker(found, edges, columns, renames=renames)


# --- pipelines -----------------------------------------------------------------------------------


@query(f"WITH {q.STAGING_PATIENTS} SELECT * FROM staging")
def staging_standardize(spark, sf):
    return pipeline.stage_clean(src.patients(spark, sf))


@query(f"WITH {q.MARTS} SELECT * FROM billing")
def mart_billing(spark, sf):
    return pipeline.mart_billing(pipeline.stage_clean(src.patients(spark, sf)))


@query(f"WITH {q.MARTS} SELECT * FROM demographics")
def mart_demographics(spark, sf):
    return pipeline.mart_demographics(pipeline.stage_clean(src.patients(spark, sf)))


@query(f"WITH {q.TRIPS} SELECT * FROM trips")
def trips_staging(spark, sf):
    return pipeline.stage_trips(src.trips(spark, sf))


@query(f"WITH {q.TRIPS} {q.DAILY.format(rel='trips')} ORDER BY trip_date")
def daily_summary(spark, sf):
    return pipeline.daily_summary(pipeline.stage_trips(src.trips(spark, sf)))


@query(
    f"""WITH {q.MARTS}
    SELECT 'raw_patients' AS stage, 'negative_billing' AS defect, count(*) FILTER (WHERE TRY_CAST(billing_amount AS DOUBLE) < 0) AS bad_rows FROM patients
    UNION ALL SELECT 'raw_patients', 'null_name', count(*) FILTER (WHERE name IS NULL) FROM patients
    UNION ALL SELECT 'raw_patients', 'invalid_age', count(*) FILTER (WHERE TRY_CAST(age AS DOUBLE) < 0 OR TRY_CAST(age AS DOUBLE) > 120) FROM patients
    UNION ALL SELECT 'raw_patients', 'date_swap', count(*) FILTER (WHERE date_of_admission > discharge_date) FROM patients
    UNION ALL SELECT 'mart_billing', 'negative_billing', count(*) FILTER (WHERE billing_amount < 0) FROM billing
    UNION ALL SELECT 'mart_billing', 'date_swap', count(*) FILTER (WHERE length_of_stay_days < 0) FROM billing
    UNION ALL SELECT 'mart_demographics', 'invalid_age', count(*) FILTER (WHERE age < 0 OR age > 120) FROM demographics
    UNION ALL SELECT 'mart_demographics', 'null_name', count(*) FILTER (WHERE name IS NULL) FROM demographics"""
)
def defect_propagation(spark, sf):
    raw = src.patients(spark, sf)
    staged = pipeline.stage_clean(raw)
    age = F.col("age").try_cast("double")
    return pipeline.propagation(
        [
            ("raw_patients", raw, {
                "negative_billing": F.col("billing_amount").try_cast("double") < 0,
                "null_name": F.col("name").isNull(),
                "invalid_age": (age < 0) | (age > 120),
                "date_swap": F.col("date_of_admission") > F.col("discharge_date"),
            }),
            ("mart_billing", pipeline.mart_billing(staged), {
                "negative_billing": F.col("billing_amount") < 0,
                "date_swap": F.col("length_of_stay_days") < 0,
            }),
            ("mart_demographics", pipeline.mart_demographics(staged), {
                "invalid_age": (F.col("age") < 0) | (F.col("age") > 120),
                "null_name": F.col("name").isNull(),
            }),
        ]
    )


@query(
    f"""WITH {q.STALE}
    SELECT 'raw_trips' AS stage, count(*) AS row_count, CAST(max(tpep_pickup_datetime) AS DATE) AS last_day, CAST(NULL AS BIGINT) AS empty_days FROM raw_trips
    UNION ALL SELECT 'staging_trips', count(*), max(trip_date), NULL FROM stale_trips
    UNION ALL SELECT 'mart_daily_summary', count(*), max(trip_date), count(*) FILTER (WHERE trip_count = 0) FROM stale_daily"""
)
def stage_audit(spark, sf):
    raw, staging, mart = _trip_stages(spark, sf)
    return pipeline.stage_audit(
        [
            ("raw_trips", raw, "tpep_pickup_datetime", None),
            ("staging_trips", staging, "trip_date", None),
            ("mart_daily_summary", mart, "trip_date", "trip_count"),
        ]
    )


# --- planting ------------------------------------------------------------------------------------


def _picked(rel: str, seed: str, n: str, where: str = "TRUE") -> str:
    return (
        f"(SELECT visit_id FROM {rel} WHERE {where} QUALIFY row_number() OVER "
        f"(ORDER BY md5(CAST(visit_id AS VARCHAR) || '-{seed}')) <= {n})"
    )


_N = "(SELECT CAST(floor(count(*) * {0}) AS BIGINT) FROM clean_patients)"


@query(
    f"""WITH {q.CLEAN_PATIENTS},
    p1 AS (SELECT * REPLACE (CASE WHEN visit_id IN {_picked('clean_patients', 'billing', _N.format('0.02'))}
      THEN '-' || billing_amount ELSE billing_amount END AS billing_amount) FROM clean_patients),
    p2 AS (SELECT * REPLACE (CASE WHEN visit_id IN {_picked('p1', 'name', _N.format('0.01'), 'name IS NOT NULL')}
      THEN NULL ELSE name END AS name) FROM p1),
    p3 AS (SELECT * REPLACE (CASE WHEN visit_id IN {_picked('p2', 'age-low', '(' + _N.format('0.015') + ' // 2)')}
      THEN '-' || age ELSE age END AS age) FROM p2),
    p4 AS (SELECT * REPLACE (CASE WHEN visit_id IN {_picked('p3', 'age-high',
      '(' + _N.format('0.015') + ' - ' + _N.format('0.015') + ' // 2)', 'CAST(age AS INTEGER) > 0')}
      THEN CAST(CAST(age AS INTEGER) + 200 AS VARCHAR) ELSE age END AS age) FROM p3),
    hit AS {_picked('p4', 'dates', _N.format('0.005'), 'date_of_admission < discharge_date')}
    SELECT * REPLACE (CASE WHEN visit_id IN (FROM hit) THEN discharge_date ELSE date_of_admission END AS date_of_admission,
      CASE WHEN visit_id IN (FROM hit) THEN date_of_admission ELSE discharge_date END AS discharge_date) FROM p4"""
)
def plant_defects(spark, sf):
    """All four defects on exactly the documented shares of the rows."""
    clean = src.patients(spark, sf, dirty=False)
    return plant.plant(clean, "visit_id", plant.patient_rules(clean.count()))


@query(f"WITH {q.STALE} SELECT * FROM stale_trips")
def plant_staleness(spark, sf):
    return _trip_stages(spark, sf)[1]


@query(f"WITH {q.STALE} SELECT * FROM stale_daily")
def plant_empty_load(spark, sf):
    return _trip_stages(spark, sf)[2]
