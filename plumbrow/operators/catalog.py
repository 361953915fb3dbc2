"""Dataset catalogue: registry, search, inspection, samples, audit SQL, metadata.

A registry has one row per dataset: ``urn, domain, instance, table, status, columns, path``. Column
names sit in an array on that row, as they do in a table's schema, so name tests are plain
expressions: no explode, no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbrow.functions import names
from plumbrow.sources.files import register_views

# Shape of a dataset name, its state, names of system tables, keywords of personal
# data (A for schemas, B for risk notes), tags by domain for datasets without a recipe.
URN_HEAD = "urn:li:dataset:(urn:li:dataPlatform:"
AVAILABLE = "AVAILABLE"
SYSTEM_TABLES = "sqlite_%"
PII_KEYWORDS_A = (
    "name", "ssn", "passport", "email", "medical_condition", "phone", "card", "patient", "address",
)
PII_KEYWORDS_B = (
    "name", "ssn", "passport", "email", "patient", "driver", "credit_card", "license",
)
DEFAULT_TAGS = {
    "healthcare": ("pii", "hipaa_regulated", "quality_monitored"),
    "fiction-retail": ("pci_dss", "financial_critical"),
}
OTHER_TAGS = ("public_data", "analytics")


def dataset_urn(domain: Column, table: Column, platform: str = "sqlite", env: str = "PROD") -> Column:
    return F.concat(F.lit(f"{URN_HEAD}{platform},"), domain, F.lit("."), table, F.lit(f",{env})"))


def columns_of(df: DataFrame, name: str) -> DataFrame:
    """The schema of ``df`` as rows ``table, ordinal, column, type``; runs no job on ``df``."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table string, ordinal int, column string, type string")


def build_registry(tables: DataFrame, platform: str = "sqlite", env: str = "PROD") -> DataFrame:
    """One row per dataset name from ``tables(domain, table[, instance, columns, path])``.

    System tables are left out. If several rows hold the same name, that of the last instance stands, of equal or no
    instances that with the greatest values of the other columns; ``copies`` tells how many there were.
    """
    extra = [c for c in tables.columns if c not in ("domain", "table")]
    last = F.struct(*([F.col(c) for c in extra] or [F.lit(None).cast("string").alias("instance")]))
    order = F.struct(*sorted(extra, key=lambda c: c != "instance")) if extra else F.lit(0)
    named = tables.filter(~F.lower("table").like(SYSTEM_TABLES)).select(
        "domain", "table", last.alias("last"), order.alias("rank")
    )
    urn = dataset_urn(F.col("domain"), F.col("table"), platform, env)
    return (
        named.groupBy("domain", "table")
        .agg(F.max_by("last", "rank").alias("last"), F.count(F.lit(1)).alias("copies"))
        .select(urn.alias("urn"), "domain", "table", F.lit(AVAILABLE).alias("status"), "copies", "last.*")
    )


def duplicate_datasets(registry: DataFrame) -> DataFrame:
    """Names that more than one instance claimed."""
    return registry.filter("copies > 1")


def simple_name(urn: Column) -> Column:
    """The table name inside a dataset name: the last dotted part of its middle field."""
    return F.element_at(F.split(F.split(urn, ",")[1], r"\."), -1)


def find_datasets(registry: DataFrame, platform: str, instance: str) -> DataFrame:
    """Datasets of exactly this platform and instance. ``taxi`` does not find ``taxi_pipeline``."""
    head = f"{URN_HEAD}{platform},{instance}."
    return registry.filter(F.startswith("urn", F.lit(head))).select(
        "urn", simple_name(F.col("urn")).alias("table")
    )


def pii_columns_of(
    columns: Column, keywords: Sequence[str] = PII_KEYWORDS_A, match: str = names.SUBSTRING
) -> Column:
    return F.filter(columns, lambda c: names.column_has(c, keywords, match))


def detect_pii_columns(
    registry: DataFrame, keywords: Sequence[str] = PII_KEYWORDS_A, match: str = names.SUBSTRING
) -> DataFrame:
    """Adds ``pii_columns`` and ``has_pii`` from the column names; values are never looked at."""
    found = registry.withColumn("pii_columns", pii_columns_of(F.col("columns"), keywords, match))
    return found.withColumn("has_pii", F.size("pii_columns") > 0)


def inspect_datasets(
    registry: DataFrame,
    tags: DataFrame | None = None,
    default_tags: Mapping[str, Sequence[str]] = DEFAULT_TAGS,
    other_tags: Sequence[str] = OTHER_TAGS,
) -> DataFrame:
    """Per dataset its columns in order, tags, columns with personal data and the high-risk flag.

    ``tags(urn, tags)`` come first; a dataset without any gets the tags of its domain.
    """

    def listed(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    default = listed(other_tags)
    for domain, values in default_tags.items():
        default = F.when(F.col("domain") == domain, listed(values)).otherwise(default)
    if tags is not None:
        own = tags.select("urn", F.col("tags").alias("own_tags")).filter(F.size("own_tags") > 0)
        registry = registry.join(own, "urn", "left")
        default = F.coalesce(F.col("own_tags"), default)
    return detect_pii_columns(registry).select(
        "urn", "domain", "table", default.alias("tags"), "columns",
        F.col("pii_columns").alias("detected_pii_fields"),
        F.col("has_pii").alias("has_high_pii_risk"),
    )


def sample_rows(df: DataFrame, limit: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first rows of a table; without ``order_by`` any ``limit`` rows."""
    return df.orderBy(*order_by).limit(limit) if order_by else df.limit(limit)


_DESCRIBES = ("DescribeRelation", "DescribeColumn", "DescribeQueryCommand")
# What a query may be made of, by the names of Spark's plan nodes; anything else is refused.
_QUERY_NODES = frozenset(
    "Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation"
    " Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedOrdinal UnresolvedRelation"
    " UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Unpivot View"
    " Window WithWindowDefinition".split()
)
# Groups of built-in functions that read nothing but their arguments, and others one by one.
_FUNCTION_GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs"
    " hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs"
    " window_funcs xml_funcs".split()
)
_FUNCTIONS = frozenset(("typeof", "monotonically_increasing_id"))
_TABLE_FUNCTIONS = frozenset(
    "explode explode_outer inline inline_outer json_tuple posexplode posexplode_outer range stack".split()
)


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan) -> Iterator:
    """A plan's nodes with those of its named queries and of the queries inside its expressions."""
    yield plan
    for seq in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _items(seq):
            if hasattr(child, "innerChildren") and hasattr(child, "subqueries"):
                yield from _nodes(child)


def _expressions(expression) -> Iterator:
    yield expression
    for child in _items(expression.children()):
        yield from _expressions(child)


def _check_function(spark: SparkSession, parts: Sequence[str]) -> None:
    name = parts[-1].lower()
    info = None
    if len(parts) == 1:
        known = spark._jsparkSession.sessionState().catalog()
        try:
            info = known.lookupFunctionInfo(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        except Exception:  # Spark has no such function
            info = None
    if info is None or info.getSource() != "built-in" or not (info.getGroup() in _FUNCTION_GROUPS or name in _FUNCTIONS):
        raise ValueError(f"function {'.'.join(parts)} is not allowed")


def check_read_only(spark: SparkSession, query: str, tables: Iterable[str]) -> None:
    """Raise ValueError unless Spark's own parser sees a query, or a DESCRIBE, that is made of allowed nodes and functions and
    reads nothing but ``tables`` and queries that it names itself; nothing is run."""
    from pyspark.errors import ParseException

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:  # the parser's errors come through as they are or wrapped
        raise ValueError(f"not a query: {e}") from (e if isinstance(e, ParseException) else None)
    describes = plan.getClass().getSimpleName() in _DESCRIBES
    if plan.getClass().getSimpleName() == "DescribeQueryCommand":
        plan, describes = plan.plan(), False
    nodes = list(_nodes(plan))
    given = {n.lower() for n in tables}
    own = {x._1().lower() for n in nodes if n.getClass().getSimpleName() == "UnresolvedWith" for x in _items(n.cteRelations())}
    hidden = [n for n in own - given if spark.catalog.tableExists(n)]
    if hidden:  # outside its scope the name would be another table's
        raise ValueError(f"queries inside this one need names that no table has: {hidden}")
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if describes and (node is plan or kind == "UnresolvedTableOrView"):
            if kind == "UnresolvedTableOrView" and (node.multipartIdentifier().size() > 1 or node.multipartIdentifier().apply(0).lower() not in given):
                raise ValueError("only the given tables can be described")
            continue
        if kind not in _QUERY_NODES:
            raise ValueError(f"only SELECT, WITH or DESCRIBE queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            name = [x.lower() for x in _items(node.multipartIdentifier())]
            if len(name) > 1 or name[0] not in given | own:
                raise ValueError(f"{'.'.join(name)} is none of the given tables")
        if kind == "UnresolvedTableValuedFunction":
            name = [x.lower() for x in _items(node.name())]
            if len(name) > 1 or name[0] not in _TABLE_FUNCTIONS:
                raise ValueError(f"function {'.'.join(name)} is not allowed")
        for e in (x for top in _items(node.expressions()) for x in _expressions(top)):
            named = e.getClass().getSimpleName()
            if named == "UnresolvedFunction":
                _check_function(spark, list(_items(e.nameParts())))
            elif named == "UnresolvedGenerator":
                _check_function(spark, [e.name().funcName()])
            elif "Identifier" in named or "Reflect" in named or "Parameter" in named:
                raise ValueError(f"{named} is not allowed")


def audit_sql(spark: SparkSession, tables: Mapping[str, DataFrame], query: str) -> DataFrame:
    """Read-only SQL over the given tables.

    Spark runs commands as soon as it sees them, so the text is parsed first, and refused unless all its parts are allowed: no
    commands, scripts or statements built from text, no other tables, files or user functions, no calls into the JVM. The
    tables have their names for this query only: views of the caller with the same names are there again afterwards.
    """
    text = query.strip().rstrip(";")
    check_read_only(spark, text, tables)
    views = spark._jsparkSession.sessionState().catalog()
    before = {n: spark.table(n) if views.getTempView(n).isDefined() else None for n in tables}
    try:
        register_views(tables)
        return spark.sql(text)
    finally:
        for name, view in before.items():
            if view is None:
                spark.catalog.dropTempView(name)
            else:
                view.createOrReplaceTempView(name)


def attach_metadata(registry: DataFrame, assignments: DataFrame) -> DataFrame:
    """Tags, terms and owner per dataset from ``assignments(kind, value, table, position)``.

    ``kind`` is ``tag``, ``term`` or ``owner``; of several owners the one with the highest position
    stands. The lists hold distinct values, so they are no longer than the tag and term vocabulary.
    """

    def values(kind: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("value"))))

    owner = F.max(F.when(F.col("kind") == "owner", F.struct("position", "value")))
    # Grouped before the join: both need the rows of a table together, so one shuffle serves both.
    listed = assignments.groupBy("table").agg(
        values("tag").alias("tags"), values("term").alias("terms"), owner["value"].alias("owner")
    )
    return registry.select("urn", "table").join(listed, "table").select("urn", "tags", "terms", "owner")


def unknown_assignments(registry: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments to tables that are not registered."""
    return assignments.join(registry.select("table"), "table", "left_anti")
