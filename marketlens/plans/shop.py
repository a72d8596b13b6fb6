"""Queries over orders, payments, products, catalogue and point of sale."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.fixtures import Tables
from marketlens.operators import commerce as C
from marketlens.registry import query

SHOP_AS_OF = "SELECT max(o_orderdate) AS t FROM orders"
NOW = f"({SHOP_AS_OF})"
CODE = "CASE WHEN trim(currency) = '' THEN 'USD' ELSE upper(trim(currency)) END"
YEAR_ORDERS = f"o AS (SELECT order_id, status, total_amount, {CODE} AS currency, customer_id, created_at FROM fx_shop_orders WHERE created_at >= {NOW} - INTERVAL 365 DAY AND created_at <= {NOW})"


def now(t: Tables):
    return t.scalar(SHOP_AS_OF)


def _year(t: Tables, name: str = "fx_shop_orders"):
    at = now(t)
    start = F.timestamp_micros(F.unix_micros(at) - 365 * 86_400_000_000)
    return t(name).filter((F.col("created_at") >= start) & (F.col("created_at") <= at))


@query(
    "sales_currency_totals",
    f"""WITH {YEAR_ORDERS} SELECT currency, count(*) AS orders, sum(total_amount) AS gross, coalesce(sum(total_amount) FILTER (WHERE status = 'cancelled'), 0) AS cancelled,
       sum(total_amount) - coalesce(sum(total_amount) FILTER (WHERE status = 'cancelled'), 0) AS net, floor(sum(total_amount) / count(*) * 100 + 0.5) / 100 AS average FROM o GROUP BY 1""",
    dbl="gross cancelled net average",
)
def _(t: Tables):
    return C.currency_totals(_year(t))


@query(
    "payment_methods",
    f"""WITH p AS (SELECT *, CASE status WHEN 'refunded' THEN CASE WHEN refund_amount > 0 THEN refund_amount ELSE amount END WHEN 'partiallyRefunded' THEN refund_amount ELSE 0 END AS back
        FROM fx_payments WHERE created_at >= {NOW} - INTERVAL 365 DAY)
    SELECT CASE method WHEN 'creditCard' THEN 'Credit Card' WHEN 'bank_transfer' THEN 'Bank Transfer' WHEN 'cash' THEN 'Cash' ELSE 'Unknown' END AS method, currency, sum(amount) AS amount, sum(back) AS refunds,
       count(*) AS transactions, sum(amount) - sum(back) AS net, floor(count(*) / (SELECT count(*) FROM p) * 1000 + 0.5) / 10 AS percentage FROM p GROUP BY 1, 2""",
    dbl="amount refunds net percentage",
)
def _(t: Tables):
    return C.payment_methods(_year(t, "fx_payments"))


@query(
    "daily_orders",
    f"""WITH {YEAR_ORDERS} SELECT strftime(created_at, '%Y-%m-%d') AS date, currency, sum(total_amount) AS value, count(*) AS orders FROM o GROUP BY 1, 2 ORDER BY date DESC, currency LIMIT 30""",
    dbl="value",
)
def _(t: Tables):
    return C.daily_orders(_year(t), limit=30)


TOP_SQL = f"""
{YEAR_ORDERS}, tot AS (SELECT i.product_id, o.currency, sum(i.quantity) AS quantity, sum(i.quantity * i.price) AS revenue FROM fx_items i JOIN o ON o.order_id = i.order_id GROUP BY 1, 2),
top AS (SELECT t.*, coalesce(p.name, concat('Product ', CAST(t.product_id AS VARCHAR))) AS name, p.category_id FROM (SELECT * FROM tot ORDER BY revenue DESC, product_id, currency LIMIT 10) t LEFT JOIN fx_products p ON p.product_id = t.product_id)
"""


ALL_SQL = TOP_SQL.replace(" ORDER BY revenue DESC, product_id, currency LIMIT 10", "")


def _top(t: Tables, limit: int | None = None):
    return C.top_products(_year(t), t("fx_items"), t("fx_products"), limit)


@query("top_products", f"WITH {TOP_SQL} SELECT * FROM top", dbl="revenue", big="quantity")
def _(t: Tables):
    return _top(t, limit=10)


@query(
    "top_product_categories",
    f"""WITH {ALL_SQL} SELECT t.category_id, t.currency, coalesce(c.name, 'Uncategorized') AS name, sum(quantity) AS quantity, sum(revenue) AS revenue
    FROM top t LEFT JOIN fx_categories c ON c.category_id = t.category_id GROUP BY 1, 2, 3""",
    dbl="revenue",
    big="quantity",
)
def _(t: Tables):
    return C.top_categories(_top(t), t("fx_categories"))


@query(
    "commerce_dashboard",
    f"""WITH w AS (SELECT date_trunc('day', {NOW}) - INTERVAL 89 DAY AS s),
    o AS (SELECT *, {CODE} AS code, created_at >= w.s AS cur, status <> 'cancelled' AS kept FROM fx_shop_orders, w WHERE created_at >= w.s - INTERVAL 90 DAY AND created_at <= {NOW}),
    u AS (SELECT code AS currency, cur, kept, status, total_amount FROM o UNION ALL SELECT 'ALL', cur, kept, status, total_amount FROM o),
    g AS (SELECT currency, count(*) FILTER (WHERE cur) AS orders, count(*) FILTER (WHERE cur AND kept) AS eligible, count(*) FILTER (WHERE cur AND status = 'completed') AS done,
            coalesce(sum(total_amount) FILTER (WHERE cur AND kept), 0) AS revenue, count(*) FILTER (WHERE NOT cur) AS p_orders, count(*) FILTER (WHERE NOT cur AND kept) AS p_eligible,
            count(*) FILTER (WHERE NOT cur AND status = 'completed') AS p_done, coalesce(sum(total_amount) FILTER (WHERE NOT cur AND kept), 0) AS p_revenue FROM u GROUP BY 1),
    r AS (SELECT *, CASE WHEN eligible > 0 THEN done * 100 / eligible ELSE 0 END AS rate, CASE WHEN p_eligible > 0 THEN p_done * 100 / p_eligible ELSE 0 END AS p_rate FROM g)
    SELECT currency, orders, eligible, revenue, CASE WHEN eligible > 0 THEN revenue / eligible ELSE 0 END AS average_order_value, rate AS fulfillment_rate,
       CASE WHEN p_revenue > 0 THEN (revenue - p_revenue) / p_revenue * 100 END AS revenue_change_pct, CASE WHEN p_orders > 0 THEN (orders - p_orders) / p_orders * 100 END AS orders_change_pct,
       CASE WHEN p_rate > 0 THEN (rate - p_rate) / p_rate * 100 END AS fulfillment_change_pct FROM r""",
    dbl="revenue average_order_value fulfillment_rate revenue_change_pct orders_change_pct fulfillment_change_pct",
)
def _(t: Tables):
    return C.dashboard_stats(t("fx_shop_orders"), now(t), "90d")


@query(
    "commerce_series",
    f"""WITH w AS (SELECT date_trunc('day', {NOW}) - INTERVAL 29 DAY AS s),
    o AS (SELECT strftime(created_at, '%Y-%m-%d') AS bucket, {CODE} AS currency, status, total_amount FROM fx_shop_orders, w WHERE created_at >= w.s AND created_at <= {NOW}),
    grid AS (SELECT strftime(d, '%Y-%m-%d') AS bucket, c.currency FROM (SELECT unnest(generate_series(w.s, date_trunc('day', {NOW}), INTERVAL 1 DAY)) AS d FROM w) d, (SELECT DISTINCT currency FROM o) c)
    SELECT g.bucket, g.currency, count(o.status) AS orders, coalesce(sum(o.total_amount) FILTER (WHERE o.status <> 'cancelled'), 0) AS revenue
    FROM grid g LEFT JOIN o ON o.bucket = g.bucket AND o.currency = g.currency GROUP BY 1, 2""",
    dbl="revenue",
)
def _(t: Tables):
    return C.dashboard_series(t("fx_shop_orders"), now(t), "30d")


@query(
    "commerce_series_all",
    f"""WITH o AS (SELECT strftime(created_at, '%Y') AS bucket, {CODE} AS currency, status, total_amount FROM fx_shop_orders)
    SELECT bucket, currency, count(*) AS orders, coalesce(sum(total_amount) FILTER (WHERE status <> 'cancelled'), 0) AS revenue FROM o GROUP BY 1, 2""",
    dbl="revenue",
)
def _(t: Tables):
    return C.dashboard_series(t("fx_shop_orders"), now(t), "all", unit="year")


@query(
    "commerce_top_products",
    f"""WITH o AS (SELECT order_id, {CODE} AS currency FROM fx_shop_orders WHERE created_at >= date_trunc('day', {NOW}) - INTERVAL 29 DAY AND created_at <= {NOW} AND status <> 'cancelled')
    SELECT i.product_id, o.currency, sum(i.quantity) AS quantity, sum(i.quantity * i.price) AS revenue, p.name FROM fx_items i JOIN o ON o.order_id = i.order_id JOIN fx_products p ON p.product_id = i.product_id
    GROUP BY 1, 2, 5 ORDER BY quantity DESC, name, i.product_id, currency LIMIT 5""",
    dbl="revenue",
    big="quantity",
)
def _(t: Tables):
    return C.dashboard_top_products(t("fx_shop_orders"), t("fx_items"), t("fx_products"), now(t))


@query(
    "recent_orders",
    f"""SELECT concat('ORD-', CASE WHEN length(CAST(o.order_id AS VARCHAR)) < 4 THEN lpad(CAST(o.order_id AS VARCHAR), 4, '0') ELSE CAST(o.order_id AS VARCHAR) END) AS id, coalesce(c.name, 'Guest') AS customer,
       o.total_amount AS total, {CODE} AS currency, o.status, o.created_at FROM (SELECT * FROM fx_shop_orders ORDER BY created_at DESC, order_id DESC LIMIT 5) o LEFT JOIN fx_customers c ON c.customer_id = o.customer_id""",
    dbl="total",
)
def _(t: Tables):
    return C.recent_orders(t("fx_shop_orders"), t("fx_customers"), now(t))


@query(
    "reference_integrity",
    """SELECT 'order without customer' AS problem, CAST(customer_id AS VARCHAR) AS reference, count(*) AS rows FROM fx_shop_orders WHERE customer_id NOT IN (SELECT customer_id FROM fx_customers) GROUP BY 1, 2
    UNION ALL SELECT 'item without order', CAST(order_id AS VARCHAR), count(*) FROM fx_items WHERE order_id NOT IN (SELECT order_id FROM fx_shop_orders) GROUP BY 1, 2
    UNION ALL SELECT 'item without product', CAST(product_id AS VARCHAR), count(*) FROM fx_items WHERE product_id NOT IN (SELECT product_id FROM fx_products) GROUP BY 1, 2""",
)
def _(t: Tables):
    return C.reference_integrity(t("fx_shop_orders"), t("fx_items"), t("fx_products"), t("fx_customers"))


@query(
    "order_summary",
    f"""SELECT {CODE} AS currency, count(*) AS total, count(*) FILTER (WHERE upper(status) IN ('PENDING', 'NEW')) AS pending, count(*) FILTER (WHERE upper(status) IN ('PROCESSING')) AS in_progress,
       count(*) FILTER (WHERE upper(status) = 'COMPLETED') AS completed, count(*) FILTER (WHERE upper(status) = 'CANCELLED') AS cancelled, sum(total_amount) AS amount FROM fx_shop_orders GROUP BY 1""",
    dbl="amount",
)
def _(t: Tables):
    return C.order_summary(t("fx_shop_orders"))


@query(
    "payment_summary",
    """WITH p AS (SELECT *, status IN ('completed', 'succeeded', 'partiallyRefunded', 'refunded') AS good FROM fx_payments)
    SELECT currency, count(*) AS total, count(*) FILTER (WHERE good) AS successful, sum(amount) FILTER (WHERE good) AS captured, sum(refund_amount) FILTER (WHERE refund_amount > 0) AS refunded,
       floor(count(*) FILTER (WHERE good) / count(*) FILTER (WHERE good OR status = 'failed') * 1000 + 0.5) / 10 AS success_rate FROM p GROUP BY 1""",
    dbl="captured refunded success_rate",
)
def _(t: Tables):
    return C.payment_summary(t("fx_payments"))


@query(
    "gift_card_summary",
    """SELECT currency, count(*) AS cards, count(*) FILTER (WHERE status = 'ACTIVE' AND is_active AND current_balance > 0) AS available, count(*) FILTER (WHERE is_active) AS enabled,
       count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status = 'USED') AS used, count(*) FILTER (WHERE status = 'EXPIRED') AS expired, count(*) FILTER (WHERE status = 'DEACTIVATED') AS deactivated,
       sum(initial_balance) AS initial_balance, sum(current_balance) AS current_balance, sum(greatest(0, initial_balance - current_balance)) AS redeemed_balance FROM fx_gift_cards GROUP BY 1""",
    dbl="initial_balance current_balance redeemed_balance",
)
def _(t: Tables):
    return C.gift_card_summary(t("fx_gift_cards"))


@query(
    "coupon_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS enabled, count(*) FILTER (WHERE status = 'Scheduled') AS scheduled, count(*) FILTER (WHERE status = 'Expired') AS expired,
       sum(usage_count) AS redemptions FROM fx_coupons""",
    big="redemptions",
)
def _(t: Tables):
    return C.coupon_summary(t("fx_coupons"))


REVIEW = """count(*) AS total, count(*) FILTER (WHERE approved) AS approved, count(*) FILTER (WHERE NOT approved) AS pending, count(*) FILTER (WHERE featured) AS featured,
       count(*) FILTER (WHERE verified) AS verified, floor(avg(rating) * 10 + 0.5) / 10 AS average_rating FROM fx_reviews"""


@query("review_summary", f"SELECT {REVIEW}", dbl="average_rating")
def _(t: Tables):
    return C.review_summary(t("fx_reviews"))


@query("product_reviews", f"SELECT product_id, {REVIEW} GROUP BY 1", dbl="average_rating")
def _(t: Tables):
    return C.review_summary(t("fx_reviews"), ["product_id"])


@query(
    "customer_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'Active') AS active, count(*) FILTER (WHERE status = 'Inactive') AS inactive, sum(total_spent) AS total_spent, avg(total_spent) AS average_spent FROM fx_customers""",
    dbl="total_spent average_spent",
)
def _(t: Tables):
    return C.customer_summary(t("fx_customers"))


@query(
    "product_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE is_available) AS available, count(*) FILTER (WHERE NOT is_available) AS unavailable, count(*) FILTER (WHERE inventory_count = 0) AS out_of_stock,
       sum(inventory_count) AS total_inventory FROM fx_products""",
    big="total_inventory",
)
def _(t: Tables):
    return C.product_summary(t("fx_products"))


@query(
    "product_relations",
    """SELECT p.product_id, coalesce(r.n, 0) AS reviews, coalesce(v.n, 0) AS variants FROM fx_products p LEFT JOIN (SELECT product_id, count(*) AS n FROM fx_reviews GROUP BY 1) r ON r.product_id = p.product_id
    LEFT JOIN (SELECT product_id, count(*) AS n FROM fx_catalogue GROUP BY 1) v ON v.product_id = p.product_id""",
)
def _(t: Tables):
    return C.product_relations(t("fx_products"), reviews=t("fx_reviews"), variants=t("fx_catalogue"))


@query(
    "waitlist_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'waiting') AS waiting, count(*) FILTER (WHERE status = 'notified') AS notified, count(*) FILTER (WHERE status = 'purchased') AS purchased,
       floor(count(*) FILTER (WHERE status = 'purchased') / count(*) * 100 + 0.5) AS conversion_rate FROM fx_waitlist""",
    dbl="conversion_rate",
)
def _(t: Tables):
    return C.waitlist_summary(t("fx_waitlist"))


@query(
    "table_waitlist_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE table_status = 'waiting') AS waiting, count(*) FILTER (WHERE table_status = 'seated') AS seated, count(*) FILTER (WHERE table_status = 'cancelled') AS cancelled,
       count(*) FILTER (WHERE table_status = 'no_show') AS no_show, floor(avg(quoted_wait) FILTER (WHERE table_status = 'waiting') + 0.5) AS average_quoted_wait,
       floor(count(*) FILTER (WHERE table_status = 'seated') / count(*) * 1000 + 0.5) / 10 AS seating_rate FROM fx_waitlist""",
    dbl="average_quoted_wait seating_rate",
)
def _(t: Tables):
    return C.table_waitlist_summary(t("fx_waitlist").drop("status").withColumnRenamed("table_status", "status"))


@query(
    "waitlist_quantities",
    """SELECT quantity, count(*) AS count, (SELECT min(quantity) FROM fx_waitlist) AS min_quantity, (SELECT max(quantity) FROM fx_waitlist) AS max_quantity, (SELECT count(*) FROM fx_waitlist) AS total_orders FROM fx_waitlist GROUP BY 1""",
)
def _(t: Tables):
    return C.quantity_distribution(t("fx_waitlist"))


@query(
    "waitlist_series",
    """WITH d AS (SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS count FROM fx_waitlist GROUP BY 1) SELECT date, count, (SELECT avg(count) FROM d) AS average_per_day FROM d""",
    dbl="average_per_day",
)
def _(t: Tables):
    return C.waitlist_series(t("fx_waitlist"))


@query(
    "manufacturer_summary",
    "SELECT count(*) AS total, count(*) FILTER (WHERE flag) AS featured, count(DISTINCT nullif(brand, '')) AS countries, sum(amount) AS linked_products FROM fx_catalogue",
    big="linked_products",
)
def _(t: Tables):
    return C.manufacturer_summary(
        t("fx_catalogue").select(F.col("flag").alias("featured"), F.col("brand").alias("country"), F.col("amount").alias("product_count"))
    )


@query(
    "category_summary",
    "SELECT count(*) AS total, count(*) FILTER (WHERE flag) AS active, count(*) FILTER (WHERE parent_id IS NULL) AS roots, count(parent_id) AS children FROM fx_catalogue",
)
def _(t: Tables):
    return C.category_summary(t("fx_catalogue").withColumnRenamed("flag", "is_active"))


@query(
    "variant_summary",
    "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'draft') AS draft, count(DISTINCT product_id) AS linked_products FROM fx_catalogue",
)
def _(t: Tables):
    return C.variant_summary(t("fx_catalogue"))


@query(
    "unit_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE flag) AS defaults, count(DISTINCT product_id) AS linked_products, count(DISTINCT type) AS types,
       (SELECT count(*) FROM (SELECT type FROM fx_catalogue WHERE flag GROUP BY 1 HAVING count(*) > 1) x) AS default_conflicts FROM fx_catalogue""",
)
def _(t: Tables):
    return C.unit_summary(t("fx_catalogue").withColumnRenamed("flag", "is_default"))


@query(
    "tax_rate_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(DISTINCT brand) AS countries, avg(rate) AS average_rate, greatest(0, count(*) FILTER (WHERE flag) - 1) AS default_conflicts FROM fx_catalogue""",
    dbl="average_rate",
)
def _(t: Tables):
    rows = t("fx_catalogue").withColumnRenamed("flag", "is_default").withColumnRenamed("brand", "country")
    return C.tax_rate_summary(rows)


@query(
    "print_device_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE device_status = 'online') AS online, count(*) FILTER (WHERE device_status = 'offline') AS offline, count(*) FILTER (WHERE device_status = 'warning') AS warning,
       count(DISTINCT nullif(brand, '')) AS locations, sum(amount) AS total_prints FROM fx_catalogue""",
    big="total_prints",
)
def _(t: Tables):
    rows = t("fx_catalogue").select(
        F.col("device_status").alias("status"), F.col("brand").alias("location"), F.col("amount").alias("print_count")
    )
    return C.print_device_summary(rows)


@query(
    "print_log_summary",
    """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS successful, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'warning') AS warnings,
       floor(count(*) FILTER (WHERE status = 'success') / count(*) * 1000 + 0.5) / 10 AS success_rate, sum(pages) AS total_pages, floor(avg(pages) * 10 + 0.5) / 10 AS average_pages,
       floor(avg(duration_seconds) FILTER (WHERE status = 'success') * 10 + 0.5) / 10 AS average_successful_duration FROM fx_print_logs""",
    dbl="success_rate average_pages average_successful_duration",
    big="total_pages",
)
def _(t: Tables):
    return C.print_log_summary(t("fx_print_logs"))


@query(
    "delivery_overview",
    f"""WITH live AS (SELECT * FROM fx_routes WHERE last_active >= {NOW} - INTERVAL 1 DAY)
    SELECT count(*) AS active_routes, coalesce(sum(stops), 0) AS stops, floor(avg(delivery_minutes) + 0.5) AS average_minutes, (SELECT count(*) FROM fx_drivers WHERE status = 'active') AS drivers_active,
       (SELECT count(*) FROM fx_drivers WHERE status = 'on_delivery') AS drivers_on_delivery, (SELECT count(*) FROM fx_drivers WHERE status = 'on_break') AS drivers_on_break,
       (SELECT count(*) FROM fx_zones WHERE status = 'active') AS active_zones, (SELECT sum(country_count) FROM fx_zones WHERE status = 'active') AS country_assignments FROM live""",
    dbl="average_minutes",
    big="stops country_assignments",
)
def _(t: Tables):
    zones = t("fx_zones").withColumn("countries", F.array_repeat(F.lit("x"), F.col("country_count").cast("int")))
    return C.delivery_overview(t("fx_routes"), zones, t("fx_drivers"), now(t))


@query("active_routes", f"SELECT * FROM fx_routes WHERE last_active >= {NOW} - INTERVAL 1 DAY ORDER BY last_active DESC, route_id LIMIT 5", dbl="delivery_minutes")
def _(t: Tables):
    return C.active_routes(t("fx_routes"), now(t))


LINES_SQL = """
m AS (SELECT order_id AS sale_id, product_id, sum(quantity) AS quantity FROM fx_items GROUP BY 1, 2),
l AS (SELECT m.sale_id, m.product_id, CAST(m.quantity AS BIGINT) AS quantity, p.price AS unit_price, floor(p.price * m.quantity * 100 + 0.5) / 100 AS line_total,
        CASE WHEN p.price IS NULL THEN 'product no longer available' WHEN m.quantity > 999 THEN 'quantity over 999' WHEN NOT p.is_available THEN 'not available for sale'
             WHEN m.quantity > p.inventory_count THEN 'not enough stock' END AS problem FROM m LEFT JOIN fx_products p ON p.product_id = m.product_id)
"""


@query("sale_lines", f"WITH {LINES_SQL} SELECT * FROM l", dbl="unit_price line_total")
def _(t: Tables):
    return C.sale_lines(t("fx_items").withColumnRenamed("order_id", "sale_id"), t("fx_products"))


@query(
    "sale_pricing",
    f"""WITH {LINES_SQL}, rate AS (SELECT rate FROM fx_tax_rates WHERE status = 'active' ORDER BY CASE WHEN is_default THEN 0 ELSE 1 END, tax_rate_id LIMIT 1),
    s AS (SELECT sale_id, count(*) AS lines, count(problem) AS problems, floor(sum(line_total) * 100 + 0.5) / 100 AS sub FROM l GROUP BY 1),
    x AS (SELECT s.*, floor(sub * rate.rate / 100 * 100 + 0.5) / 100 AS tax FROM s, rate)
    SELECT sale_id, lines, problems, CASE WHEN problems = 0 THEN sub END AS subtotal, CASE WHEN problems = 0 THEN tax END AS tax_amount, CASE WHEN problems = 0 THEN floor((sub + tax) * 100 + 0.5) / 100 END AS total_amount FROM x""",
    dbl="subtotal tax_amount total_amount",
)
def _(t: Tables):
    lines = C.sale_lines(t("fx_items").withColumnRenamed("order_id", "sale_id"), t("fx_products"))
    return C.price_sales(lines, C.preferred_tax_rate(t("fx_tax_rates")))


@query(
    "payment_trends",
    f"""SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS transactions, sum(amount) AS revenue FROM fx_payments
    WHERE created_at >= date_trunc('month', {NOW}) - INTERVAL 11 MONTH AND created_at <= {NOW} GROUP BY 1""",
    dbl="revenue",
)
def _(t: Tables):
    return C.monthly_trends(t("fx_payments"), now(t))


@query(
    "payment_stats",
    f"""WITH p AS (SELECT amount, created_at > {NOW} - INTERVAL 30 DAY AS cur FROM fx_payments WHERE created_at > {NOW} - INTERVAL 60 DAY AND created_at <= {NOW}),
    s AS (SELECT count(*) FILTER (WHERE cur) AS n1, count(*) FILTER (WHERE NOT cur) AS n0, sum(amount) FILTER (WHERE cur) AS r1, sum(amount) FILTER (WHERE NOT cur) AS r0 FROM p),
    m AS (SELECT 'transactions' AS measure, CAST(n1 AS DOUBLE) AS current, CAST(n0 AS DOUBLE) AS previous FROM s UNION ALL SELECT 'revenue', r1, r0 FROM s UNION ALL SELECT 'average', r1 / n1, r0 / n0 FROM s)
    SELECT *, current - previous AS difference, (current - previous) / previous * 100 AS percentage, current >= previous AS is_increase FROM m""",
    dbl="current previous difference percentage",
)
def _(t: Tables):
    return C.payment_stats(t("fx_payments"), now(t))


@query(
    "gift_card_stats",
    f"""WITH s AS (SELECT CAST(count(*) FILTER (WHERE is_active AND created_at > {NOW} - INTERVAL 30 DAY) AS DOUBLE) AS current, CAST(count(*) FILTER (WHERE is_active AND created_at > {NOW} - INTERVAL 60 DAY AND created_at <= {NOW} - INTERVAL 30 DAY) AS DOUBLE) AS previous,
        sum(initial_balance) AS total_value, sum(current_balance) AS current_balance FROM fx_card_sales)
    SELECT *, current - previous AS difference, CASE WHEN previous <> 0 THEN (current - previous) / previous * 100 ELSE 0 END AS percentage, current >= previous AS is_increase FROM s""",
    dbl="current previous total_value current_balance difference percentage",
)
def _(t: Tables):
    return C.gift_card_stats(t("fx_card_sales"), now(t))
