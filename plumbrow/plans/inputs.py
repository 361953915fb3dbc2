"""Audit inputs derived from the given tables, row by row, so that they grow with them.

patients   one hospital visit per order, all text; planted defects depend on a hash of the key
trips      one taxi trip per line item
streams    one dataset per event user, with lineage edges to other users
catalogue  one dataset per order, one domain per customer
entities   one dataset per region, nation, supplier, customer, part and order, with foreign keys
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrow.operators.catalog import build_registry, dataset_urn

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Columns of the visits below and of four of the given tables, which the catalogue rows take as their schemas.
SCHEMAS = {
    "patients": (
        "name", "age", "gender", "blood_type", "medical_condition", "date_of_admission", "doctor",
        "hospital", "insurance_provider", "billing_amount", "room_number", "admission_type",
        "discharge_date", "medication", "test_results",
    ),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}
KINDS = tuple(SCHEMAS)
DOMAINS = ("healthcare", "healthcare", "fiction-retail", "fiction-retail", "nyc-taxi")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _hash(key: str) -> Column:
    return F.md5(_text(key))


def _byte(h: Column, at: int) -> Column:
    """Two hexadecimal digits: 256 even classes."""
    return F.substring(h, at, 2)


def patients(spark: SparkSession, sf: str, dirty: bool = True) -> DataFrame:
    h = F.col("h")
    orders = table(spark, sf, "orders").withColumn("h", _hash("o_orderkey"))
    name = F.concat(F.lit("Customer#"), F.lpad(_text("o_custkey"), 9, "0"))
    age = F.col("o_custkey") % 90 + 1
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    day = F.col("o_orderdate").cast("date")
    start = F.date_format(day, "yyyy-MM-dd")
    end = F.date_format(F.date_add(day, (F.col("o_custkey") % 14 + 1).cast("int")), "yyyy-MM-dd")
    age_text, first, last = age.cast("string"), start, end
    if dirty:
        name = (
            F.when(_byte(h, 1) == "00", F.lit(None))
            .when(_byte(h, 1) == "01", F.lit(""))
            .when(_byte(h, 1) == "02", F.lit("NULL"))
            .otherwise(name)
        )
        amount = F.when(_byte(h, 3) < "05", F.concat(F.lit("-"), amount)).otherwise(amount)
        age_text = (
            F.when(_byte(h, 5) < "02", (-age).cast("string"))
            .when(_byte(h, 5) < "04", (age + 200).cast("string"))
            .otherwise(age_text)
        )
        swapped = _byte(h, 7) < "02"
        first = F.when(swapped, end).otherwise(start)
        last = F.when(swapped, start).otherwise(end)
    status = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("visit_id"),
        name.alias("name"),
        age_text.alias("age"),
        F.when(status == "F", F.lit(" Female")).otherwise(F.lit("MALE ")).alias("gender"),
        F.when(_byte(h, 9) < "80", F.lit(" AB+ ")).otherwise(F.lit("o-")).alias("blood_type"),
        F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit(" ")).alias("medical_condition"),
        first.alias("date_of_admission"),
        F.concat(F.lit("Doctor "), _byte(h, 11)).alias("doctor"),
        F.concat(F.lit("Hospital "), F.substring(h, 13, 1)).alias("hospital"),
        F.col("o_orderpriority").alias("insurance_provider"),
        amount.alias("billing_amount"),
        _text("o_custkey").alias("room_number"),
        F.when(status == "F", F.lit("Emergency "))
        .when(status == "O", F.lit(" Elective"))
        .otherwise(F.lit("URGENT"))
        .alias("admission_type"),
        last.alias("discharge_date"),
        F.concat(F.lit("Medication "), F.substring(h, 14, 1)).alias("medication"),
        F.when(_byte(h, 15) < "80", F.lit(" Normal ")).otherwise(F.lit("ABNORMAL")).alias("test_results"),
    )


def trips(spark: SparkSession, sf: str) -> DataFrame:
    """Whole amounts, so that sums do not depend on their order. Some pickups are missing, some
    fares negative, some distances 0."""
    line = table(spark, sf, "lineitem")
    start = F.col("l_shipdate") + F.make_dt_interval(hours=F.col("l_linenumber"))
    end = F.col("l_shipdate") + F.make_dt_interval(
        hours=F.col("l_linenumber"), mins=F.col("l_quantity").cast("int")
    )
    price = F.floor("l_extendedprice").cast("double")
    fare = F.when(F.col("l_returnflag") == "R", -price).otherwise(price)
    return line.select(
        F.col("l_suppkey").alias("VendorID"),
        F.when((F.col("l_discount") > 0) | (F.col("l_tax") > 0), start).alias("tpep_pickup_datetime"),
        end.alias("tpep_dropoff_datetime"),
        F.col("l_linenumber").alias("passenger_count"),
        (F.col("l_quantity") - 1).alias("trip_distance"),
        F.col("l_returnflag").alias("payment_type"),
        fare.alias("fare_amount"),
        F.col("l_quantity").alias("tip_amount"),
        (fare + F.col("l_quantity")).alias("total_amount"),
    )


def _kind(i: Column, values: tuple) -> Column:
    """``values[i % 5]`` as a column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int") + 1)


def _schema_of(i: Column) -> Column:
    lists = [F.array(*[F.lit(c) for c in SCHEMAS[k]]) for k in KINDS]
    return F.element_at(F.array(*lists), (i % len(KINDS)).cast("int") + 1)


def stream_urn(user: Column) -> Column:
    return dataset_urn(_kind(user, DOMAINS), F.concat(F.lit("user_"), user.cast("string")))


def _peer() -> Column:
    return F.get_json_object("props", "$.k").try_cast("bigint")


def stream_registry(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    users = table(spark, sf, "events").select("user_id").distinct()
    return build_registry(
        users.select(
            _kind(user, DOMAINS).alias("domain"),
            F.concat(F.lit("user_"), user.cast("string")).alias("table"),
            F.lit("events").alias("instance"),
            _schema_of(user).alias("columns"),
        )
    )


# Datasets that are registered but have no events are numbered from here on.
QUIET = 1_000_000_000


def stream_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """``id`` of the users' datasets, and of one quiet dataset for each nation."""
    users = table(spark, sf, "events").select("user_id").distinct()
    quiet = table(spark, sf, "nation").select((F.col("n_nationkey").cast("bigint") + QUIET).alias("user_id"))
    return users.union(quiet).select(stream_urn(F.col("user_id")).alias("id"))


def stream_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every event links its user's dataset with the one that it names: the lower number feeds the higher one, so there
    are roots, sinks and orphans."""
    peer = _peer()
    ends = F.least("user_id", peer).alias("src"), F.greatest("user_id", peer).alias("dst")
    pairs = table(spark, sf, "events").filter(peer.isNotNull()).select(*ends).distinct()
    return pairs.select(stream_urn(F.col("src")).alias("src"), stream_urn(F.col("dst")).alias("dst"))


def stream_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The events as rows of their datasets, with planted defects."""
    h = F.col("h")
    value = F.when(_byte(h, 1) < "05", -F.col("value")).otherwise(F.col("value"))
    events = table(spark, sf, "events").withColumn("h", _hash("event_id"))
    seconds = value.cast("decimal(18,6)")
    return events.select(
        stream_urn(F.col("user_id")).alias("urn"),
        F.when(_byte(h, 3) >= "03", F.col("event_type")).alias("event_type"),
        value.alias("value"),
        (_peer() + F.when(_byte(h, 5) < "03", F.lit(200)).otherwise(F.lit(0))).alias("age"),
        F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("end_ts"),
    )


def _layer() -> Column:
    s = F.col("o_orderstatus")
    return F.when(s == "O", F.lit("raw")).when(s == "P", F.lit("staging")).otherwise(F.lit("mart"))


def catalogue_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One table per order, named by layer and year, so that names repeat among the instances of a
    domain, and one system table per customer."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("customer_"), _text("o_custkey")).alias("domain"),
        F.concat(_layer(), F.lit("_orders_"), F.year("o_orderdate").cast("string")).alias("table"),
        F.concat(F.lit("order_"), F.lpad(_text("o_orderkey"), 15, "0")).alias("instance"),
        _schema_of(F.substring("o_orderpriority", 1, 1).cast("int")).alias("columns"),
    )
    system = table(spark, sf, "customer").select(
        F.concat(F.lit("customer_"), _text("c_custkey")).alias("domain"),
        F.lit("sqlite_sequence").alias("table"),
        F.lit("system").alias("instance"),
        F.array(F.lit("name"), F.lit("seq")).alias("columns"),
    )
    return orders.unionByName(system)


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return build_registry(catalogue_tables(spark, sf))


# The six tables whose rows are datasets, and their keys.
ENTITY_KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "supplier": "s_suppkey",
    "customer": "c_custkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
}


def _entity_rows(df: DataFrame, name: str) -> DataFrame:
    """``urn, domain, table`` of the rows of one table. Keys are unique, so there are no duplicates."""
    label = F.concat(F.lit(f"{name}_"), _text(ENTITY_KEYS[name]))
    return df.select(
        dataset_urn(F.lit(name), label).alias("urn"), F.lit(name).alias("domain"), label.alias("table")
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.union, [_entity_rows(table(spark, sf, n), n) for n in ENTITY_KEYS])


def entity_fks(spark: SparkSession, sf: str) -> DataFrame:
    """``urn, target_table``: every foreign-key value as a reference from row to row."""

    def refs(source: str, child: str, key: str, parent: str, target: str) -> DataFrame:
        return table(spark, sf, source).select(
            dataset_urn(F.lit(child), F.concat(F.lit(f"{child}_"), _text(key))),
            F.concat(F.lit(f"{parent}_"), _text(target)),
        )

    out = refs("nation", "nation", "n_nationkey", "region", "n_regionkey")
    for args in (
        ("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"),
        ("customer", "customer", "c_custkey", "nation", "c_nationkey"),
        ("orders", "orders", "o_orderkey", "customer", "o_custkey"),
    ):
        out = out.union(refs(*args))
    order = dataset_urn(F.lit("orders"), F.concat(F.lit("orders_"), _text("l_orderkey")))
    targets = F.array(
        F.concat(F.lit("part_"), _text("l_partkey")), F.concat(F.lit("supplier_"), _text("l_suppkey"))
    )
    return out.union(table(spark, sf, "lineitem").select(order, F.explode(targets))).toDF("urn", "target_table")


def declared_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """``downstream, upstreams``: each line item declares what its order is built from."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("orders_"), _text("l_orderkey")).alias("downstream"),
        F.array(
            F.concat(F.lit("part_"), _text("l_partkey")),
            F.concat(F.lit("supplier_"), _text("l_suppkey")),
        ).alias("upstreams"),
    )


def registered_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, parts, and the suppliers that are not in debt; the others were never registered."""
    solvent = table(spark, sf, "supplier").filter("s_acctbal >= 0")
    known = _entity_rows(table(spark, sf, "orders"), "orders").union(_entity_rows(table(spark, sf, "part"), "part"))
    return known.union(_entity_rows(solvent, "supplier"))


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    """``kind, value, table, position``: each line item tags its order and names a team."""

    def one(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    given = F.explode(
        F.array(
            one("tag", F.concat(F.lit("flag_"), F.lower("l_returnflag"))),
            one("term", F.concat(F.lit("status_"), F.lower("l_linestatus"))),
            one("owner", F.concat(F.lit("team_"), _text("l_suppkey"))),
        )
    )
    return table(spark, sf, "lineitem").select(
        given.alias("g"),
        F.concat(F.lit("order_"), _text("l_orderkey")).alias("table"),
        F.col("l_linenumber").alias("position"),
    ).select("g.kind", "g.value", "table", "position")


def order_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Finished and open orders; one in progress is not registered yet."""
    name = F.concat(F.lit("order_"), _text("o_orderkey"))
    domain = F.concat(F.lit("customer_"), _text("o_custkey"))
    orders = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return orders.select(dataset_urn(domain, name).alias("urn"), name.alias("table"))


def nation_registry(spark: SparkSession, sf: str) -> DataFrame:
    return build_registry(
        table(spark, sf, "customer").select(
            F.concat(F.lit("nation_"), _text("c_nationkey")).alias("domain"),
            F.concat(F.lit("customer_"), _text("c_custkey")).alias("table"),
            F.lit("main").alias("instance"),
        )
    )
