"""Commerce reports: sales, payments, dashboard, catalogue, waitlists, delivery, point of sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions.common import count_if, first_rows, js_round, minus_days, ratio, sum_if
from marketlens.functions.text import currency_code, title_label
from marketlens.operators.web import percentage

DAY_RANGES = {"7d": 7, "30d": 30, "90d": 90}
# Status families.
CANCELLED = ["canceled", "cancelled"]
FULFILLED = ["completed", "delivered", "shipped"]
CAPTURED = ["completed", "succeeded", "partiallyRefunded", "refunded"]


def is_cancelled(status: Column) -> Column:
    return F.lower(status).isin(CANCELLED)


def _count() -> Column:
    return F.count(F.lit(1))


def currency_totals(orders: DataFrame) -> DataFrame:
    """Gross, cancelled, net, order count and mean per currency."""
    amount = F.col("total_amount")
    rows = orders.groupBy(currency_code(F.col("currency")).alias("currency")).agg(
        _count().alias("orders"),
        F.sum(amount).alias("gross"),
        sum_if(is_cancelled(F.col("status")), amount).alias("cancelled"),
    )
    return rows.select(
        "*",
        (F.col("gross") - F.col("cancelled")).alias("net"),
        js_round(F.col("gross") / F.col("orders"), 2).alias("average"),
    )


def payment_refund(status: Column, amount: Column, refund: Column) -> Column:
    code = F.lower(status)
    return (
        F.when(code == "refunded", F.when(refund > 0, refund).otherwise(amount))
        .when(code.isin("partiallyrefunded", "partially_refunded"), refund)
        .otherwise(F.lit(0.0))
    )


def payment_methods(payments: DataFrame) -> DataFrame:
    """Amount, refunds, net, transactions and share per (method, currency)."""
    refund = payment_refund(F.col("status"), F.col("amount"), F.col("refund_amount"))
    total = payments.agg(_count().alias("n")).scalar()
    method = F.coalesce(F.nullif("method", F.lit("")), F.lit("unknown"))
    rows = payments.groupBy(method.alias("method_key"), currency_code(F.col("currency")).alias("currency")).agg(
        F.sum("amount").alias("amount"), F.sum(refund).alias("refunds"), _count().alias("transactions")
    )
    return rows.select(
        title_label(F.col("method_key")).alias("method"),
        "currency",
        "amount",
        "refunds",
        "transactions",
        (F.col("amount") - F.col("refunds")).alias("net"),
        percentage(F.col("transactions"), total).alias("percentage"),
    )


def daily_orders(orders: DataFrame, limit: int | None = None) -> DataFrame:
    """Value and count per (day, currency); with ``limit`` the newest rows."""
    rows = orders.groupBy(
        F.date_format("created_at", "yyyy-MM-dd").alias("date"), currency_code(F.col("currency")).alias("currency")
    ).agg(F.sum("total_amount").alias("value"), _count().alias("orders"))
    return first_rows(rows, limit, F.desc("date"), "currency")


def product_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Quantity and revenue per (product, currency) over the given orders."""
    keyed = orders.select("order_id", currency_code(F.col("currency")).alias("currency"))
    return (
        items.join(keyed, "order_id")
        .groupBy("product_id", "currency")
        .agg(F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("revenue"))
    )


def top_products(orders: DataFrame, items: DataFrame, products: DataFrame, limit: int | None = None) -> DataFrame:
    """Totals of each product and currency with the product's name; with ``limit`` those of the largest revenue."""
    top = first_rows(product_totals(orders, items), limit, F.desc("revenue"), "product_id", "currency")
    named = products.select("product_id", "name", "category_id")
    rows = top.join(named, "product_id", "left")
    fallback = F.concat(F.lit("Product "), F.col("product_id").cast("string"))
    return rows.withColumn("name", F.coalesce("name", fallback))


def top_categories(top: DataFrame, categories: DataFrame) -> DataFrame:
    """Category roll-up of the given products."""
    rows = top.groupBy("category_id", "currency").agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue")
    )
    return rows.join(categories.select("category_id", "name"), "category_id", "left").withColumn(
        "name", F.coalesce("name", F.lit("Uncategorized"))
    )


def period_start(as_of: Column, span: str, first: Column | None = None) -> Column:
    """Start of the current period of a dashboard range; ``first`` is the earliest order for 'all'."""
    day = F.date_trunc("day", as_of)
    if span == "today":
        return day
    if span in DAY_RANGES:
        return minus_days(day, DAY_RANGES[span] - 1)
    if span == "year":
        return F.add_months(F.date_trunc("month", as_of).cast("date"), F.lit(-11)).cast("timestamp")
    if first is None:
        raise ValueError("range 'all' needs the earliest order time")
    return first


def previous_start(as_of: Column, span: str) -> Column | None:
    start = period_start(as_of, span, as_of)
    if span == "today":
        return minus_days(start, 1)
    if span in DAY_RANGES:
        return minus_days(start, DAY_RANGES[span])
    if span == "year":
        return F.add_months(start.cast("date"), F.lit(-12)).cast("timestamp")
    return None


BUCKET_FORMATS = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def bucket_unit(span: str, unit: str | None = None) -> str:
    """The unit of a range's time buckets: the given one, else that of the range (months for 'all')."""
    return unit or ("hour" if span == "today" else "day" if span in DAY_RANGES else "month")


def change_pct(current: Column, previous: Column) -> Column:
    """Percentage change, NULL without a previous value."""
    return F.when(previous > 0, (current - previous) / previous * 100.0)


def dashboard_stats(orders: DataFrame, as_of: Column, span: str = "30d") -> DataFrame:
    """Current against previous period, per currency and (currency = 'ALL') over all orders."""
    before = previous_start(as_of, span)
    start = period_start(as_of, span, F.lit("0001-01-01").cast("timestamp"))
    ts = F.col("created_at")
    now = (ts >= start) & (ts <= as_of)
    old = (ts >= before) & (ts < start) if before is not None else F.lit(False)
    kept = ~is_cancelled(F.col("status"))
    done = F.lower("status").isin(FULFILLED)
    rows = orders.filter(now | old).withColumn("now", now)
    cells = rows.groupBy(currency_code(F.col("currency")).alias("currency"), "now").agg(
        _count().alias("orders"),
        count_if(kept).alias("eligible"),
        count_if(kept & done).alias("fulfilled"),
        sum_if(kept, F.col("total_amount")).alias("revenue"),
    )
    both = cells.unionByName(cells.withColumn("currency", F.lit("ALL")))
    measures = ("orders", "eligible", "fulfilled", "revenue")
    sums = both.groupBy("currency").agg(
        *[F.coalesce(F.sum(F.when(F.col("now"), F.col(m))), F.lit(0)).alias(m) for m in measures],
        *[F.coalesce(F.sum(F.when(~F.col("now"), F.col(m))), F.lit(0)).alias(f"previous_{m}") for m in measures],
    )
    rate = ratio(F.col("fulfilled") * 100.0, F.col("eligible"))
    previous_rate = ratio(F.col("previous_fulfilled") * 100.0, F.col("previous_eligible"))
    return sums.select(
        "currency",
        "orders",
        "eligible",
        "revenue",
        ratio(F.col("revenue"), F.col("eligible")).alias("average_order_value"),
        rate.alias("fulfillment_rate"),
        change_pct(F.col("revenue"), F.col("previous_revenue")).alias("revenue_change_pct"),
        change_pct(F.col("orders"), F.col("previous_orders")).alias("orders_change_pct"),
        change_pct(rate, previous_rate).alias("fulfillment_change_pct"),
    )


def calendar(spark, start: Column, end: Column, key, hourly: bool = False) -> DataFrame:
    """Every bucket key between two instants, from one generated row (its size is the number of days)."""
    unit = "hour" if hourly else "day"
    step = F.expr("interval 1 hour") if hourly else F.expr("interval 1 day")
    days = F.sequence(F.date_trunc(unit, start), F.date_trunc(unit, end), step)
    return spark.range(1).select(F.explode(days).alias("at")).select(key(F.col("at")).alias("bucket")).distinct()


def dashboard_series(orders: DataFrame, as_of: Column, span: str = "30d", unit: str | None = None) -> DataFrame:
    """Orders and revenue per dense time bucket and currency; an empty bucket has zero orders.

    ``unit`` (hour, day, month or year) overrides the range's own.
    """
    unit = bucket_unit(span, unit)
    first = orders.agg(F.min("created_at").alias("t")).scalar()
    start = period_start(as_of, span, first)
    ts = F.col("created_at")

    def key(c: Column) -> Column:
        return F.date_format(c, BUCKET_FORMATS[unit])

    current = orders.filter((ts >= start) & (ts <= as_of))
    cells = current.groupBy(key(ts).alias("bucket"), currency_code(F.col("currency")).alias("currency")).agg(
        _count().alias("orders"), sum_if(~is_cancelled(F.col("status")), F.col("total_amount")).alias("revenue")
    )
    grid = calendar(orders.sparkSession, start, as_of, key, hourly=unit == "hour")
    # The calendar is bounded by the range; the currencies are free text and stay rows.
    buckets = grid.agg(F.collect_list("bucket").alias("buckets")).scalar()
    dense = cells.select("currency").distinct().select(F.explode(buckets).alias("bucket"), "currency")
    return dense.join(cells, ["bucket", "currency"], "left").na.fill(0, ["orders", "revenue"])


def dashboard_top_products(orders: DataFrame, items: DataFrame, products: DataFrame, as_of: Column, span: str = "30d", limit: int = 5) -> DataFrame:
    ts = F.col("created_at")
    start = period_start(as_of, span, F.lit("0001-01-01").cast("timestamp"))
    current = orders.filter((ts >= start) & (ts <= as_of) & ~is_cancelled(F.col("status")))
    rows = product_totals(current, items).join(products.select("product_id", "name"), "product_id")
    return rows.orderBy(F.desc("quantity"), "name", "product_id", "currency").limit(limit)


def recent_orders(orders: DataFrame, customers: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    top = orders.filter(F.col("created_at") <= as_of).orderBy(F.desc("created_at"), F.desc("order_id")).limit(limit)
    rows = top.join(customers.select("customer_id", F.col("name").alias("customer")), "customer_id", "left")
    text = F.col("order_id").cast("string")
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return rows.select(
        F.concat(F.lit("ORD-"), padded).alias("id"),
        F.coalesce("customer", F.lit("Guest")).alias("customer"),
        F.col("total_amount").alias("total"),
        currency_code(F.col("currency")).alias("currency"),
        "status",
        "created_at",
    )


def reference_integrity(orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """Broken references: orders without customer, items without order or product."""

    def missing(rows: DataFrame, key: str, parent: DataFrame, problem: str) -> DataFrame:
        bad = rows.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")
        return bad.groupBy(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("reference")).agg(
            _count().alias("rows")
        )

    return (
        missing(orders, "customer_id", customers, "order without customer")
        .unionByName(missing(items, "order_id", orders, "item without order"))
        .unionByName(missing(items, "product_id", products, "item without product"))
    )


def order_summary(orders: DataFrame) -> DataFrame:
    """Counts per status family and the amount per currency."""
    status = F.upper("status")
    # Status families of the order list.
    families = {
        "pending": ["PENDING", "NEW"],
        "in_progress": ["PREPARING", "PROCESSING", "READY", "SHIPPED"],
        "completed": ["DELIVERED", "COMPLETED", "PAID"],
        "cancelled": ["CANCELED", "CANCELLED", "REFUNDED"],
    }
    return orders.groupBy(currency_code(F.col("currency")).alias("currency")).agg(
        _count().alias("total"),
        *[count_if(status.isin(names)).alias(f) for f, names in families.items()],
        F.sum("total_amount").alias("amount"),
    )


def payment_summary(payments: DataFrame) -> DataFrame:
    """Captured and refunded amounts and the success rate over settled payments, per currency."""
    good = F.col("status").isin(CAPTURED)
    settled = good | (F.col("status") == "failed")
    rows = payments.groupBy("currency").agg(
        _count().alias("total"),
        count_if(good).alias("successful"),
        count_if(settled).alias("settled"),
        sum_if(good, F.col("amount")).alias("captured"),
        sum_if(F.col("refund_amount") > 0, F.col("refund_amount")).alias("refunded"),
    )
    return rows.withColumn("success_rate", percentage(F.col("successful"), F.col("settled"))).drop("settled")


def gift_card_summary(cards: DataFrame) -> DataFrame:
    """Statuses, availability and balances per currency."""
    return cards.groupBy("currency").agg(
        _count().alias("cards"),
        count_if((F.col("status") == "ACTIVE") & F.col("is_active") & (F.col("current_balance") > 0)).alias("available"),
        count_if(F.col("is_active")).alias("enabled"),
        *[count_if(F.col("status") == s).alias(s.lower()) for s in ("ACTIVE", "USED", "EXPIRED", "DEACTIVATED")],
        F.sum("initial_balance").alias("initial_balance"),
        F.sum("current_balance").alias("current_balance"),
        F.sum(F.greatest(F.lit(0.0), F.col("initial_balance") - F.col("current_balance"))).alias("redeemed_balance"),
    )


def coupon_summary(coupons: DataFrame) -> DataFrame:
    return coupons.agg(
        _count().alias("total"),
        count_if(F.col("is_active")).alias("enabled"),
        count_if(F.col("status") == "Scheduled").alias("scheduled"),
        count_if(F.col("status") == "Expired").alias("expired"),
        F.coalesce(F.sum("usage_count"), F.lit(0)).alias("redemptions"),
    )


def review_summary(reviews: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts and mean rating, overall or per product."""
    return reviews.groupBy(*(keys or [])).agg(
        _count().alias("total"),
        count_if(F.col("approved")).alias("approved"),
        count_if(~F.col("approved")).alias("pending"),
        count_if(F.col("featured")).alias("featured"),
        count_if(F.col("verified")).alias("verified"),
        F.coalesce(js_round(F.avg("rating"), 1), F.lit(0.0)).alias("average_rating"),
    )


def customer_summary(customers: DataFrame) -> DataFrame:
    return customers.agg(
        _count().alias("total"),
        count_if(F.col("status") == "Active").alias("active"),
        count_if(F.col("status") == "Inactive").alias("inactive"),
        F.coalesce(F.sum("total_spent"), F.lit(0.0)).alias("total_spent"),
        F.coalesce(F.avg("total_spent"), F.lit(0.0)).alias("average_spent"),
    )


def product_summary(products: DataFrame) -> DataFrame:
    return products.agg(
        _count().alias("total"),
        count_if(F.col("is_available")).alias("available"),
        count_if(~F.col("is_available")).alias("unavailable"),
        count_if(F.col("inventory_count") == 0).alias("out_of_stock"),
        F.coalesce(F.sum("inventory_count"), F.lit(0)).alias("total_inventory"),
    )


def product_relations(products: DataFrame, **relations: DataFrame) -> DataFrame:
    """Row counts of each relation (variants, units, reviews) per product."""
    rows = products.select("product_id")
    for name, relation in relations.items():
        counts = relation.groupBy("product_id").agg(_count().alias(name))
        rows = rows.join(counts, "product_id", "left")
    return rows.na.fill(0, list(relations))


def waitlist_summary(entries: DataFrame) -> DataFrame:
    """Product waitlist: statuses and conversion in whole percent."""
    rows = entries.agg(
        _count().alias("total"), *[count_if(F.col("status") == s).alias(s) for s in ("waiting", "notified", "purchased")]
    )
    return rows.withColumn("conversion_rate", js_round(ratio(F.col("purchased") * 100.0, F.col("total"))))


def table_waitlist_summary(entries: DataFrame) -> DataFrame:
    """Restaurant waitlist: statuses, mean quoted wait of those waiting, seating rate."""
    waiting = F.col("status") == "waiting"
    rows = entries.agg(
        _count().alias("total"),
        count_if(waiting).alias("waiting"),
        *[count_if(F.col("status") == s).alias(s) for s in ("seated", "cancelled", "no_show")],
        F.coalesce(js_round(F.avg(F.when(waiting, F.col("quoted_wait")))), F.lit(0.0)).alias("average_quoted_wait"),
    )
    return rows.withColumn("seating_rate", percentage(F.col("seated"), F.col("total")))


def quantity_distribution(entries: DataFrame) -> DataFrame:
    """Waitlist entries per quantity, with the smallest and largest quantity and the total."""
    counts = entries.groupBy("quantity").agg(_count().alias("count"))
    bounds = counts.agg(F.min("quantity").alias("lo"), F.max("quantity").alias("hi"), F.sum("count").alias("n"))
    return counts.select(
        "*",
        bounds.select("lo").scalar().alias("min_quantity"),
        bounds.select("hi").scalar().alias("max_quantity"),
        bounds.select("n").scalar().alias("total_orders"),
    )


def waitlist_series(entries: DataFrame) -> DataFrame:
    """Entries per day with the mean per listed day."""
    days = entries.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(_count().alias("count"))
    mean = days.agg(F.avg("count").alias("m")).scalar()
    return days.withColumn("average_per_day", mean)


def manufacturer_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        _count().alias("total"),
        count_if(F.col("featured")).alias("featured"),
        F.count_distinct(F.nullif("country", F.lit(""))).alias("countries"),
        F.coalesce(F.sum("product_count"), F.lit(0)).alias("linked_products"),
    )


def category_summary(rows: DataFrame) -> DataFrame:
    root = F.col("parent_id").isNull()
    return rows.agg(
        _count().alias("total"), count_if(F.col("is_active")).alias("active"), count_if(root).alias("roots"),
        count_if(~root).alias("children"),
    )


def variant_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        _count().alias("total"),
        count_if(F.col("status") == "active").alias("active"),
        count_if(F.col("status") == "draft").alias("draft"),
        F.count_distinct("product_id").alias("linked_products"),
    )


def unit_summary(rows: DataFrame) -> DataFrame:
    """Units with the number of types that have more than one default."""
    per_pair = rows.groupBy("type", "product_id").agg(
        _count().alias("n"), count_if(F.col("is_default")).alias("defaults")
    )
    per_type = per_pair.groupBy("type").agg(F.sum("defaults").alias("defaults"))
    totals = per_pair.agg(
        F.sum("n").alias("total"),
        F.sum("defaults").alias("defaults"),
        F.count_distinct("product_id").alias("linked_products"),
    )
    types = per_type.agg(_count().alias("t"), count_if(F.col("defaults") > 1).alias("c"))
    return totals.select(
        "*", types.select("t").scalar().alias("types"), types.select("c").scalar().alias("default_conflicts")
    )


def tax_rate_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        _count().alias("total"),
        count_if(F.col("status") == "active").alias("active"),
        F.count_distinct("country").alias("countries"),
        F.coalesce(F.avg("rate"), F.lit(0.0)).alias("average_rate"),
        F.greatest(F.lit(0), count_if(F.col("is_default")) - 1).alias("default_conflicts"),
    )


def print_device_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        _count().alias("total"),
        *[count_if(F.col("status") == s).alias(s) for s in ("online", "offline", "warning")],
        F.count_distinct(F.nullif("location", F.lit(""))).alias("locations"),
        F.coalesce(F.sum("print_count"), F.lit(0)).alias("total_prints"),
    )


def print_log_summary(rows: DataFrame) -> DataFrame:
    good = F.col("status") == "success"
    sums = rows.agg(
        _count().alias("total"),
        count_if(good).alias("successful"),
        count_if(F.col("status") == "failed").alias("failed"),
        count_if(F.col("status") == "warning").alias("warnings"),
        F.coalesce(F.sum("pages"), F.lit(0)).alias("total_pages"),
        sum_if(good, F.col("duration_seconds")).alias("took"),
    )
    return sums.select(
        "total",
        "successful",
        "failed",
        "warnings",
        percentage(F.col("successful"), F.col("total")).alias("success_rate"),
        "total_pages",
        js_round(ratio(F.col("total_pages"), F.col("total")), 1).alias("average_pages"),
        js_round(ratio(F.col("took"), F.col("successful")), 1).alias("average_successful_duration"),
    )


def delivery_overview(routes: DataFrame, zones: DataFrame, drivers: DataFrame, as_of: Column) -> DataFrame:
    """Routes of the last 24 hours, stops, mean minutes, drivers by status, active zones and countries."""
    live = (F.col("last_active") >= minus_days(as_of, 1)) & (F.col("last_active") <= as_of)
    sums = routes.agg(
        count_if(live).alias("active_routes"),
        F.coalesce(F.sum(F.when(live, F.col("stops"))), F.lit(0)).alias("stops"),
        F.coalesce(js_round(F.avg(F.when(live, F.col("delivery_minutes")))), F.lit(0.0)).alias("average_minutes"),
    )
    people = drivers.agg(*[count_if(F.col("status") == s).alias(s) for s in ("active", "on_delivery", "on_break")])
    areas = zones.filter(F.col("status") == "active").agg(
        _count().alias("n"), F.coalesce(F.sum(F.size("countries")), F.lit(0)).alias("c")
    )
    return sums.select(
        "*",
        *[people.select(s).scalar().alias(f"drivers_{s}") for s in ("active", "on_delivery", "on_break")],
        areas.select("n").scalar().alias("active_zones"),
        areas.select("c").scalar().alias("country_assignments"),
    )


def active_routes(routes: DataFrame, as_of: Column, limit: int = 5) -> DataFrame:
    live = (F.col("last_active") >= minus_days(as_of, 1)) & (F.col("last_active") <= as_of)
    return routes.filter(live).orderBy(F.desc("last_active"), "route_id").limit(limit)


def preferred_tax_rate(rates: DataFrame) -> Column:
    """Rate of the active default, else of the first active rate, else 0."""
    rank = F.struct(F.when(F.col("is_default"), 0).otherwise(1).alias("d"), F.col("tax_rate_id").alias("id"))
    best = rates.filter(F.col("status") == "active").agg(F.coalesce(F.min_by("rate", rank), F.lit(0.0)).alias("r"))
    return best.scalar()


def sale_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Basket lines merged per product with line total and, where a line cannot be sold, the problem."""
    merged = lines.groupBy("sale_id", "product_id").agg(F.sum("quantity").alias("quantity"))
    rows = merged.join(products.select("product_id", "name", "price", "is_available", "inventory_count"), "product_id", "left")
    problem = (
        F.when(F.col("price").isNull(), "product no longer available")
        .when(F.col("quantity") > 999, "quantity over 999")
        .when(~F.col("is_available"), "not available for sale")
        .when(F.col("quantity") > F.col("inventory_count"), "not enough stock")
    )
    return rows.select(
        "sale_id",
        "product_id",
        "quantity",
        F.col("price").alias("unit_price"),
        js_round(F.col("price") * F.col("quantity"), 2).alias("line_total"),
        problem.alias("problem"),
    )


def price_sales(priced: DataFrame, tax_rate: Column) -> DataFrame:
    """Subtotal, tax and total of every sale whose lines can all be sold; the others count their problems."""
    sums = priced.groupBy("sale_id").agg(
        _count().alias("lines"),
        js_round(F.sum("line_total"), 2).alias("subtotal"),
        F.count("problem").alias("problems"),
    )
    ok = F.col("problems") == 0
    tax = F.when(ok, js_round(F.col("subtotal") * tax_rate / 100.0, 2))
    return sums.select(
        "sale_id",
        "lines",
        "problems",
        F.when(ok, F.col("subtotal")).alias("subtotal"),
        tax.alias("tax_amount"),
        F.when(ok, js_round(F.col("subtotal") + tax, 2)).alias("total_amount"),
    )


def monthly_trends(payments: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """Transactions and revenue per month over the last twelve months."""
    start = F.add_months(F.date_trunc("month", as_of).cast("date"), F.lit(1 - months)).cast("timestamp")
    rows = payments.filter((F.col("created_at") >= start) & (F.col("created_at") <= as_of))
    return rows.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        _count().alias("transactions"), F.sum("amount").alias("revenue")
    )


def _comparison(current: Column, previous: Column) -> list[Column]:
    diff = current - previous
    pct = F.when(previous != 0, diff / previous * 100.0).otherwise(F.lit(0.0))
    return [diff.alias("difference"), pct.alias("percentage"), (diff >= 0).alias("is_increase")]


def payment_stats(payments: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row per measure: value of the last ``days`` days against the days before."""
    start, before = minus_days(as_of, days), minus_days(as_of, 2 * days)
    now = (F.col("created_at") > start) & (F.col("created_at") <= as_of)
    rows = payments.filter((F.col("created_at") > before) & (F.col("created_at") <= as_of)).groupBy(
        now.alias("now")
    ).agg(_count().alias("transactions"), F.sum("amount").alias("revenue"))
    sums = rows.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("now") == flag, F.col(m).cast("double"))), F.lit(0.0)).alias(f"{p}_{m}")
            for m in ("transactions", "revenue")
            for p, flag in (("now", True), ("old", False))
        ]
    )
    average = lambda p: ratio(F.col(f"{p}_revenue"), F.col(f"{p}_transactions"))
    measures = [
        ("transactions", F.col("now_transactions"), F.col("old_transactions")),
        ("revenue", F.col("now_revenue"), F.col("old_revenue")),
        ("average", average("now"), average("old")),
    ]
    items = F.array(
        *[F.struct(F.lit(n).alias("measure"), c.alias("current"), p.alias("previous")) for n, c, p in measures]
    )
    long = sums.select(F.explode(items).alias("m")).select("m.*")
    return long.select("*", *_comparison(F.col("current"), F.col("previous")))


def gift_card_stats(cards: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Active cards issued in the last ``days`` days against the days before, with all value and balance."""
    start, before = minus_days(as_of, days), minus_days(as_of, 2 * days)
    ts = F.col("created_at")
    live = F.col("is_active")
    sums = cards.agg(
        count_if(live & (ts > start) & (ts <= as_of)).cast("double").alias("current"),
        count_if(live & (ts > before) & (ts <= start)).cast("double").alias("previous"),
        F.coalesce(F.sum("initial_balance"), F.lit(0.0)).alias("total_value"),
        F.coalesce(F.sum("current_balance"), F.lit(0.0)).alias("current_balance"),
    )
    return sums.select("*", *_comparison(F.col("current"), F.col("previous")))
