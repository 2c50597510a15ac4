"""Every operator as a named query over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.labels import month_label
from orderlens.functions.leaves import json_leaves as leaves_of_json
from orderlens.functions.leaves import leaves
from orderlens.functions.money import money
from orderlens.functions.text import word_count
from orderlens.operators import cleaning, correlation, enrich, factcheck, outliers, quality, rates, segments, sketches
from orderlens.operators.quantiles import grouped_quantiles
from orderlens.plans import briefs, charts, findings, reports
from orderlens.session import new_path, stage, staged_generation
from orderlens.sources import benchmark_tables as bench
from orderlens.schemas import ORDERS
from orderlens.sources.tables import read_csv, read_findings, read_table, write_briefs, write_bucketed, write_findings, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Spend per customer at benchmark prices; chosen so that every tier is populated.
BENCHMARK_TIERS = (900_000, 1_100_000)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _lines(spark, folder):
    return bench.retail_lines(spark, folder)


def _orders(spark, folder):
    return bench.retail_orders(spark, folder)


def _headers(spark, folder):
    return bench.order_headers(spark, folder)


def _labelled(spark, folder):
    return cleaning.normalise_labels(_orders(spark, folder), "payment_method")


def _products(spark, folder):
    return bench.retail_products(spark, folder)


def _customers(spark, folder):
    return bench.retail_customers(spark, folder)


def _hot_products(spark, folder):
    return bench.hot(spark, folder, "lineitem", "l_partkey")


def _hot_customers(spark, folder):
    return bench.hot_customers(spark, folder)


def _valued(spark, folder):
    return enrich.order_value(_orders(spark, folder), _products(spark, folder), _hot_products(spark, folder), "left")


def _event_values(spark, folder):
    """Events as dated amounts with a returned flag."""
    event = F.col("event_id")
    return bench.table(spark, folder, "events").select(
        "event_id",
        F.to_date("ts").alias("order_date"),
        "value",
        F.col("value").cast("decimal(18,2)").alias("amount"),
        F.when(event % 3 == 0, 1).otherwise(0).alias("returned"),
    )


# Reports on raw orders


@query
def report1_headline(spark, folder):
    return reports.headline(_orders(spark, folder), _products(spark, folder), _hot_products(spark, folder))


@query
def report2_category(spark, folder):
    return reports.returns_by_category(_lines(spark, folder), _products(spark, folder))


@query
def report3_payment(spark, folder):
    return reports.value_by_payment(_orders(spark, folder), _products(spark, folder))


@query
def report4_repeat_returners(spark, folder):
    return reports.top_returning_customers(_orders(spark, folder), _customers(spark, folder))


@query
def report5_city(spark, folder):
    return reports.city_performance(
        _orders(spark, folder), _products(spark, folder), _customers(spark, folder), _hot_products(spark, folder)
    )


@query
def report6_channel(spark, folder):
    return reports.channel_roi(
        _orders(spark, folder), _products(spark, folder), _customers(spark, folder), _hot_products(spark, folder)
    )


@query
def report7_product_loss(spark, folder):
    return reports.product_loss(_lines(spark, folder), _products(spark, folder))


@query
def report8_discount_bucket(spark, folder):
    return reports.returns_by_discount(_lines(spark, folder), _products(spark, folder), low=3, medium=6)


@query
def report9_monthly(spark, folder):
    return reports.monthly_trend(_orders(spark, folder), _products(spark, folder))


# Values and enrichment


@query
def order_value(spark, folder):
    valued = enrich.order_value(_lines(spark, folder), _products(spark, folder), _hot_products(spark, folder))
    return valued.select("order_id", "product_id", "quantity", F.col("order_value").cast("double").alias("order_value"))


@query
def enrich_orders(spark, folder):
    enriched = enrich.enrich_orders(
        _orders(spark, folder),
        _products(spark, folder),
        _customers(spark, folder),
        _hot_products(spark, folder),
        _hot_customers(spark, folder),
    )
    return enriched.select(
        "order_id",
        "customer_id",
        "product_id",
        "category",
        "city",
        "acquisition_source",
        "month",
        F.col("order_value").cast("double").alias("order_value"),
    )


# Cleaning


@query
def coerce_numeric(spark, folder):
    raw = bench.raw_events(spark, folder)
    return cleaning.coerce_numeric(raw, cleaning.ORDER_NUMBERS).select("order_id", *cleaning.ORDER_NUMBERS)


@query
def value_counts_raw(spark, folder):
    return quality.value_counts(bench.order_headers(spark, folder), "payment_method", "payment_method", "orders")


@query
def value_counts_clean(spark, folder):
    headers = cleaning.normalise_labels(bench.order_headers(spark, folder), "payment_method")
    return quality.value_counts(headers, "payment_method", "payment_method", "orders")


@query
def profile_orders(spark, folder):
    raw = bench.raw_events(spark, folder)
    numbers = cleaning.coerce_numeric(raw, {"quantity": "double", "discount_pct": "double", "rating": "double"})
    return quality.profile_orders(numbers, large=4)


def _copy_key():
    return ["customer_id", "product_id", "order_date"]


def _event_rows(spark, folder):
    return bench.table(spark, folder, "events").select(
        F.col("event_id").alias("order_id"),
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("product_id"),
        F.to_date("ts").alias("order_date"),
        "value",
        "props",
    )


@query
def dedup_keep_first(spark, folder):
    return cleaning.keep_first(_event_rows(spark, folder), _copy_key())


@query
def dedup_removed_rows(spark, folder):
    return cleaning.removed_copies(_event_rows(spark, folder), _copy_key())


def _numbers(spark, folder):
    return cleaning.coerce_numeric(bench.raw_events(spark, folder), cleaning.ORDER_NUMBERS)


@query
def fill_missing(spark, folder):
    filled = cleaning.fill_missing(_numbers(spark, folder), rating_policy="keep_null")
    return filled.select("order_id", "discount_pct", "rating")


@query
def fill_rating_median(spark, folder):
    return cleaning.fill_median(_numbers(spark, folder), "rating").select("order_id", "rating")


@query
def clean_orders(spark, folder):
    return cleaning.clean_orders(bench.raw_events(spark, folder)).withColumn("amount", F.col("amount").cast("double"))


@query
def clean_orders_fill_first(spark, folder):
    cleaned = cleaning.clean_orders_fill_first(bench.raw_events(spark, folder))
    return cleaned.withColumn("amount", F.col("amount").cast("double"))


@query
def revenue_reconciliation(spark, folder):
    return cleaning.reconcile(cleaning.typed_orders(bench.raw_events(spark, folder)), "amount")


# Outliers and trend


@query
def iqr_bounds(spark, folder):
    return outliers.iqr_summary(bench.table(spark, folder, "events"), "value")


@query
def iqr_flag(spark, folder):
    return outliers.flag_outliers(bench.table(spark, folder, "events"), "value").select("event_id", "value", "is_outlier")


@query
def iqr_outliers(spark, folder):
    return outliers.outlier_rows(bench.table(spark, folder, "events"), "value").select("event_id", "user_id", "value")


@query
def iqr_bounds_by_type(spark, folder):
    """Quartiles and fences of the values of each event type."""
    fences = outliers.group_fences(bench.table(spark, folder, "events"), ["event_type"], "value")
    digits = [F.round(c, 6).alias(c) for c in ("q1", "q3", "lower_fence", "upper_fence")]
    return fences.select("event_type", "n_values", *digits)


@query
def iqr_flag_by_type(spark, folder):
    """Events outside the fences of their own type."""
    events = bench.table(spark, folder, "events")
    return outliers.flag_by_group(events, ["event_type"], "value").where("is_outlier").select("event_id", "event_type", "value")


@query
def median_per_user(spark, folder):
    """The exact median of each user's values: many groups, each with a few rows."""
    found = grouped_quantiles(bench.table(spark, folder, "events"), ["user_id"], "value", [0.5])
    return found.select("user_id", "n_values", F.round(F.col("quantiles")[0], 6).alias("median_value"))


def _event_trend(spark, folder):
    flagged = outliers.flag_outliers(_event_values(spark, folder), "value")
    return rates.trend(flagged, "amount")


@query
def monthly_trend_clean(spark, folder):
    return _event_trend(spark, folder)


@query
def peak_month(spark, folder):
    return rates.peaks(_event_trend(spark, folder))


# Customers


@query
def customer_rollup(spark, folder):
    rollup = segments.customer_rollup(_valued(spark, folder))
    return rollup.withColumn("spend", money(F.col("amount"))).drop("amount")


@query
def customer_segments(spark, folder):
    return segments.customer_segments(
        _valued(spark, folder), _customers(spark, folder), BENCHMARK_TIERS
    ).drop("amount")


@query
def segment_summary(spark, folder):
    return segments.segment_summary(segments.customer_rollup(_valued(spark, folder)), BENCHMARK_TIERS)


@query
def repeat_returners(spark, folder):
    return segments.repeat_returners(segments.customer_rollup(_valued(spark, folder)), _customers(spark, folder))


# Rates


@query
def risk_segment(spark, folder):
    return rates.risk_segments(_labelled(spark, folder), _customers(spark, folder), "1-URGENT")


@query
def risk_ranking(spark, folder):
    return rates.risk_segments(_labelled(spark, folder), _customers(spark, folder))


@query
def rating_contrast(spark, folder):
    return rates.rating_contrast(cleaning.fill_median(_lines(spark, folder), "rating"))


@query
def rate_by_all_dims(spark, folder):
    return rates.rates_by_dimension(
        _labelled(spark, folder), _products(spark, folder), _customers(spark, folder), _lines(spark, folder)
    )


@query
def worst_product(spark, folder):
    return rates.worst_product(_lines(spark, folder), _products(spark, folder))


@query
def returned_share(spark, folder):
    return rates.returned_share(_lines(spark, folder))


def _correlations(spark, folder):
    filled = cleaning.fill_missing(_lines(spark, folder))
    return correlation.correlation_matrix(enrich.order_value(filled, _products(spark, folder), _hot_products(spark, folder), "left"))


@query
def correlation_matrix(spark, folder):
    return _correlations(spark, folder)


@query
def correlation_merged(spark, folder):
    """The same matrix merged from co-moments per category: what cells of any grain give without their rows."""
    filled = cleaning.fill_missing(_lines(spark, folder))
    valued = enrich.order_value(filled, _products(spark, folder), _hot_products(spark, folder), "left")
    return correlation.merged_matrix(valued.groupBy("category").agg(*correlation.moments(correlation.MEASURES)))


@query
def correlation_verdicts(spark, folder):
    return correlation.correlation_checks(_correlations(spark, folder))


# Sketches in cells


@query
def distinct_customers_by_grain(spark, folder):
    """Customers per month and overall from the sketches of one fold, held against exact counts."""
    dated = _headers(spark, folder).withColumn("month", month_label(F.col("order_date")))
    cells = stage(sketches.distinct_cells(dated, ["month", "payment_method"], "customer_id"), "customer-cells")
    whole = F.lit("all")
    estimates = sketches.distinct_of(cells, "month").select(F.lit("month").alias("grain"), F.col("month").alias("label"), "n", "estimate")
    estimates = estimates.unionByName(sketches.distinct_of(cells).select(whole.alias("grain"), whole.alias("label"), "n", "estimate"))
    customers = F.count_distinct("customer_id").alias("customers")
    exact = dated.groupBy(F.lit("month").alias("grain"), F.col("month").alias("label")).agg(customers)
    exact = exact.unionByName(dated.agg(customers).select(whole.alias("grain"), whole.alias("label"), "customers"))
    return estimates.join(exact, ["grain", "label"]).select(
        "grain", "label", F.col("n").alias("orders"), "customers", sketches.within(F.col("estimate"), F.col("customers")).alias("within_bound")
    )


@query
def value_quantiles_by_grain(spark, folder):
    """Quantiles of values per month and overall from sketches kept per month and type, held against their ranks."""
    dated = bench.table(spark, folder, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    cells = stage(sketches.quantile_cells(dated, ["month", "event_type"], "value"), "value-cells")
    shares, whole = (0.1, 0.5, 0.9), F.lit("all")
    estimates = sketches.quantiles_of_cells(cells, shares, "month").withColumnRenamed("month", "label")
    estimates = estimates.unionByName(sketches.quantiles_of_cells(cells, shares).withColumn("label", whole))
    labelled = dated.select("value", F.explode(F.array("month", whole)).alias("label")).where("NOT isnan(value)")
    ranks = labelled.join(estimates, "label").groupBy("label", "p", "n_values")
    value, estimate = F.col("value"), F.col("estimate")
    ranks = ranks.agg(F.count_if(value < estimate).alias("below"), F.count_if(value <= estimate).alias("upto"))
    near = sketches.rank_within(F.col("p"), F.col("below"), F.col("upto"), F.col("n_values"))
    return ranks.select("label", "p", "n_values", near.alias("within_bound"))


# Data quality


@query
def dq_pk_unique(spark, folder):
    orders, lines = bench.table(spark, folder, "orders"), bench.table(spark, folder, "lineitem")
    return quality.repeated_keys(orders, ["o_orderkey"], "orders").unionByName(
        quality.repeated_keys(lines, ["l_orderkey", "l_linenumber"], "lineitem")
    )


@query
def dq_not_null(spark, folder):
    columns = ["order_id", "product_id", "quantity", "discount_pct", "rating", "returned"]
    return quality.count_violations(_lines(spark, folder), quality.not_null(columns))


@query
def dq_domain(spark, folder):
    domains = {"city_tier": [1, 2], "acquisition_source": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]}
    return quality.count_violations(_customers(spark, folder), quality.in_domain(domains)).unionByName(
        quality.count_violations(_lines(spark, folder), quality.in_domain({"returned": [0, 1]}))
    )


@query
def dq_range(spark, folder):
    ranges = {"quantity": (0, 45, False), "discount_pct": (0, 100, True), "rating": (2, 5, True)}
    return quality.count_violations(_lines(spark, folder), quality.in_range(ranges)).unionByName(
        quality.count_violations(
            bench.table(spark, folder, "customer"), quality.in_range({"c_acctbal": (0, None, False)})
        )
    )


@query
def dq_fk_orphans(spark, folder):
    orders, lines = bench.table(spark, folder, "orders"), bench.table(spark, folder, "lineitem")
    solvent = bench.table(spark, folder, "customer").filter("c_acctbal > 0")
    parts = bench.table(spark, folder, "part")
    return (
        quality.orphans(orders, solvent, "o_custkey", "c_custkey", "orders.o_custkey")
        .unionByName(quality.orphans(lines, orders, "l_orderkey", "o_orderkey", "lineitem.l_orderkey"))
        .unionByName(quality.orphans(lines, parts, "l_partkey", "p_partkey", "lineitem.l_partkey"))
    )


@query
def dq_row_counts(spark, folder):
    names = ("customer", "part", "orders", "lineitem")
    return quality.row_counts({name: bench.table(spark, folder, name) for name in names})


@query
def dq_null_counts(spark, folder):
    return quality.null_counts(_lines(spark, folder), ["discount_pct", "rating"])


@query
def dq_dim_key_unique(spark, folder):
    checks = (("part", "p_partkey"), ("customer", "c_custkey"), ("orders", "o_custkey"))
    parts = [quality.repeated_keys(bench.table(spark, folder, t), [k], f"{t}.{k}") for t, k in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dq_join_rowcount(spark, folder):
    orders, lines = bench.table(spark, folder, "orders"), bench.table(spark, folder, "lineitem")
    parts, customers = bench.table(spark, folder, "part"), bench.table(spark, folder, "customer")
    return (
        quality.join_row_count(lines, parts, "l_partkey", "p_partkey", "lineitem to part")
        .unionByName(quality.join_row_count(orders, customers, "o_custkey", "c_custkey", "orders to customer"))
        .unionByName(quality.join_row_count(orders, lines, "o_orderkey", "l_orderkey", "orders to lineitem"))
    )


@query
def dq_quarantine(spark, folder):
    checks = [
        *quality.not_null(["discount_pct"]),
        *quality.in_domain({"returned": [0]}),
        *quality.in_range({"quantity": (0, 45, False), "rating": (2, 5, True)}),
    ]
    large = bench.table(spark, folder, "part").filter("p_size > 5")
    routed = quality.route(
        _lines(spark, folder), checks, [("product_id", large, "p_partkey", _hot_products(spark, folder))]
    )
    return quality.rejected(routed).select(
        "order_id", "product_id", "quantity", "rating", F.concat_ws("; ", "reject_reasons").alias("reasons")
    )


def _keyed(spark, folder):
    """Lines routed by a primary key (the order: only its first line may stay) and two foreign keys."""
    large = bench.table(spark, folder, "part").filter("p_size > 5")
    open_orders = bench.table(spark, folder, "orders").filter("o_orderstatus <> 'F'")
    references = [
        ("product_id", large, "p_partkey", _hot_products(spark, folder)),
        ("order_key", open_orders, "o_orderkey", bench.hot(spark, folder, "lineitem", "l_orderkey")),
    ]
    return quality.route(_lines(spark, folder), quality.not_null(["discount_pct"]), references, ("order_key", "order_id"))


@query
def dq_accepted(spark, folder):
    return quality.accepted(_keyed(spark, folder)).select("order_id", "product_id", "quantity", "discount_pct")


@query
def dq_rejected_keys(spark, folder):
    return quality.rejected(_keyed(spark, folder)).select("order_id", F.concat_ws("; ", "reject_reasons").alias("reasons"))


@query
def csv_roundtrip(spark, folder):
    """Order rows through a CSV file without header, with blanks and cells that are no numbers."""
    lines = _lines(spark, folder)
    quantity = F.when(F.col("order_key") % 50 == 7, "many").otherwise(F.col("quantity").cast("string"))
    rows = lines.select(
        "order_id", F.concat(F.lit("C"), "order_key"), F.concat(F.lit("P"), "product_id"), F.lit("2026-01-31"),
        quantity, "discount_pct", F.lit("Card"), "rating", "returned",
    )
    path = new_path(spark, "csv")
    rows.toDF(*ORDERS.names).write.csv(path)
    routed = quality.route(read_csv(spark, path, ORDERS), [quality.readable(), *quality.not_null(["discount_pct"])])
    return routed.select(
        "order_id", "customer_id", "product_id", F.date_format("order_date", "yyyy-MM-dd").alias("day"), "quantity",
        "discount_pct", "rating", "returned", F.concat_ws("; ", "reject_reasons").alias("reasons"),
    )


@query
def ingest_roundtrip(spark, folder):
    headers = bench.order_headers(spark, folder)
    dated = headers.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
    path = new_path(spark, "ingest")
    write_table(dated, path, partition_by=["order_month"])
    return read_table(spark, path, dated.schema).select(*dated.columns)


@query
def report9_recent_months(spark, folder):
    """The monthly report over the three latest months of a table written by month.

    The months are known only when the query runs; files of other months aren't opened.
    """
    fact = _orders(spark, folder).withColumn("order_month", month_label(F.col("order_date")))
    path = new_path(spark, "fact-by-month")
    write_table(fact, path, partition_by=["order_month"])
    months = _headers(spark, folder).select(month_label(F.col("order_date")).alias("order_month"))
    latest = months.where("order_month IS NOT NULL").distinct().orderBy(F.desc("order_month")).limit(3)
    recent = read_table(spark, path, fact.schema).where(F.col("order_month") >= latest.agg(F.min("order_month")).scalar())
    return reports.monthly_trend(recent, _products(spark, folder))


@query
def report9_colocated(spark, folder):
    """The monthly report over lines and headers kept in buckets of the order: their join shuffles nothing."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = write_bucketed(_lines(spark, folder), new_path(spark, "lines-by-order"), "order_key", buckets)
    headers = write_bucketed(_headers(spark, folder), new_path(spark, "headers-by-order"), "order_key", buckets)
    return reports.monthly_trend(lines.join(headers, "order_key"), _products(spark, folder))


@query
def reconciliation_incremental(spark, folder):
    """Raw against clean revenue from two batches: the state of the first is kept, its rows aren't read again.

    The later batch holds copies of old keys with smaller and larger ids.
    """
    rows = cleaning.typed_orders(bench.raw_events(spark, folder))
    state = stage(cleaning.copy_state(rows.where("order_id % 3 <> 0"), "amount"), "copy-state")
    return cleaning.reconcile_state(cleaning.merge_state(state, cleaning.copy_state(rows.where("order_id % 3 = 0"), "amount")))


@query
def json_leaves(spark, folder):
    """Leaves of documents whose shape differs from row to row, read without a schema."""
    even = F.col("event_id") % 2 == 0
    user, flag, none = F.col("user_id"), F.col("user_id") % 7 == 0, F.lit(None)  # NULL fields aren't written
    items = [F.struct(user.alias("user"), none.cast("boolean").alias("flag")), F.struct(none.cast("long").alias("user"), flag.alias("flag"))]
    inner = F.struct(F.col("event_type").alias("type"), F.array(*items).alias("list"))
    mixed = F.to_json(F.struct(F.col("event_id").alias("id"), F.array(F.lit(1.5), F.lit(2.5)).alias("pair"), inner.alias("in")))
    other = F.concat(F.lit('{"id": "x'), "event_id", F.lit('", "pair": null, "in": [true, '), "user_id", F.lit(', "s", [], {}]}'))
    texts = bench.table(spark, folder, "events").select("event_id", F.when(even, mixed).otherwise(other).alias("doc"))
    return leaves_of_json(texts, "doc", "event_id")


# Charts


@query
def chart_rate_by_payment(spark, folder):
    return charts.rate_by_payment(_labelled(spark, folder))


@query
def chart_monthly_revenue(spark, folder):
    return charts.monthly_revenue(_orders(spark, folder), _products(spark, folder))


# Findings, briefs and the check of numbers in texts

# Figures of the findings that a text is expected to state.
HEADLINE_PATHS = {
    "data.clean_orders": "Clean orders",
    "revenue.clean_total_inr": "Total revenue (clean)",
    "revenue.avg_order_value_inr": "Average order value",
    "revenue.duplicate_delta_inr": "Duplicate delta",
    "returns.overall_rate_pct": "Overall return rate %",
    "highest_risk_segment.return_rate_pct": "Highest-risk segment %",
    "highest_risk_segment.city_tier": "Highest-risk tier",
    "outliers.peak_month_without_outliers.revenue_inr": "Peak month revenue",
}


_ANALYSES: dict[tuple, findings.Analysis] = {}


def _analysis(spark, folder):
    """The analysis of a folder, staged once and shared by the queries until the staged tables go."""
    wanted = (spark.sparkContext.applicationId, folder, staged_generation())
    if wanted not in _ANALYSES:
        _ANALYSES.clear()
        _ANALYSES[wanted] = findings.analyse(
            bench.retail_raw(spark, folder),
            _products(spark, folder),
            _customers(spark, folder),
            hot_products=_hot_products(spark, folder),
            hot_customers=_hot_customers(spark, folder),
        )
    return _ANALYSES[wanted]


def _document(analysis):
    return findings.findings_document(analysis, ["lineitem", "orders", "part", "customer"], BENCHMARK_TIERS)


def _figures(analysis):
    return findings.figures(analysis, _document(analysis))


def _headline(figures):
    label = F.element_at(F.create_map(*[F.lit(x) for pair in HEADLINE_PATHS.items() for x in pair]), F.col("path"))
    return figures.filter(F.col("path").isin(*HEADLINE_PATHS)).select(label.alias("label"), "value")


def _city_figures(analysis):
    return briefs.brief_figures(analysis.cells, analysis.orders, "city")


def _company_figures(analysis):
    named = [df.withColumn("company", F.lit("The company")) for df in (analysis.cells, analysis.orders)]
    return briefs.brief_figures(*named, "company")


def _texts(spark, folder, analysis):
    """All documents and the brief of the company."""
    documents = bench.table(spark, folder, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("text_id"), "text")
    return documents.unionByName(briefs.render_briefs(_company_figures(analysis), "company"))


@query
def findings_document(spark, folder):
    return leaves(_document(_analysis(spark, folder)))


@query
def findings_tables(spark, folder):
    return findings.findings_tables(_analysis(spark, folder))


@query
def findings_metrics(spark, folder):
    return _figures(_analysis(spark, folder))


@query
def findings_roundtrip(spark, folder):
    path = new_path(spark, "findings")
    write_findings(_document(_analysis(spark, folder)), path)
    return leaves(read_findings(spark, path))


@query
def reconcile_short_key(spark, folder):
    """Raw against clean revenue where copies agree in customer, product and day only."""
    key = ("customer_id", "product_id", "order_date")
    analysis = findings.analyse(bench.retail_raw(spark, folder), _products(spark, folder), _customers(spark, folder), key,
                                _hot_products(spark, folder), _hot_customers(spark, folder))
    return findings.findings_document(analysis).select("data.raw_orders", "data.clean_orders", "revenue.raw_total_inr", "revenue.clean_total_inr")


@query
def narrative_render(spark, folder):
    return briefs.render_briefs(_city_figures(_analysis(spark, folder)), "city")


@query
def fact_check_headline(spark, folder):
    analysis = _analysis(spark, folder)
    figures = _figures(analysis)
    return factcheck.headline_check(_texts(spark, folder, analysis), _headline(figures))


@query
def fact_check_score(spark, folder):
    analysis = _analysis(spark, folder)
    figures = _figures(analysis)
    return factcheck.headline_score(_texts(spark, folder, analysis), _headline(figures))


@query
def fact_check_unsupported(spark, folder):
    analysis = _analysis(spark, folder)
    figures = _figures(analysis)
    return factcheck.unsupported_numbers(_texts(spark, folder, analysis), figures)


def _checked_briefs(spark, folder):
    figures = _city_figures(_analysis(spark, folder))
    return factcheck.own_figures_check(
        briefs.render_briefs(figures, "city"), briefs.stated_figures(figures, "city")
    )


@query
def fact_check_briefs(spark, folder):
    """Each city's brief against that city's own figures."""
    return _checked_briefs(spark, folder)


@query
def brief_scores(spark, folder):
    return factcheck.own_figures_score(_checked_briefs(spark, folder))


@query
def brief_store(spark, folder):
    """Briefs stored with their scores and how they were made, and read back."""
    figures = _city_figures(_analysis(spark, folder))
    texts = briefs.render_briefs(figures, "city")
    scores = factcheck.own_figures_score(factcheck.own_figures_check(texts, briefs.stated_figures(figures, "city")))
    path = new_path(spark, "briefs")
    write_briefs(texts, scores, path)
    stored = read_table(spark, path)
    return stored.filter("generated_at IS NOT NULL").select("text_id", "text", "generated_by", "matched", "total")


@query
def text_word_count(spark, folder):
    return bench.table(spark, folder, "documents").select("doc_id", word_count(F.col("text")).alias("words"))
