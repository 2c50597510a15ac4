"""ANSI SQL with the same result as each registered query, for a check in another engine."""

from __future__ import annotations

LINES = """
lines as (
  select l_orderkey as order_key,
         l_orderkey || '-' || l_linenumber as order_id,
         l_partkey as product_id,
         cast(l_quantity as integer) as quantity,
         nullif(cast(round(l_discount * 100) as integer), 0) as discount_pct,
         case when l_linenumber <= 5 then l_linenumber end as rating,
         case when l_returnflag = 'R' then 1 else 0 end as returned
  from lineitem)"""

HEADERS = """
headers as (
  select o_orderkey as order_key, o_custkey as customer_id, cast(o_orderdate as date) as order_date,
         case when o_orderkey % 3 = 0 then lower(o_orderpriority)
              when o_orderkey % 3 = 1 then '  ' || o_orderpriority || ' '
              else o_orderpriority end as payment_method
  from orders)"""

CUSTOMERS = """
customers as (
  select c_custkey as customer_id, c_name as name, n_name as city,
         case when n_regionkey <= 1 then 1 else 2 end as city_tier, c_mktsegment as acquisition_source
  from customer join nation on n_nationkey = c_nationkey)"""

PRODUCTS = """
products as (
  select p_partkey as product_id, p_name as product_name, p_type as category,
         cast(p_retailprice as decimal(12,2)) as price
  from part)"""

VALUE = (
    "cast(quantity as decimal(12,2)) * price"
    " * (cast(1 as decimal(4,2)) - cast(coalesce(discount_pct, 0) as decimal(5,2)) * cast(0.01 as decimal(3,2)))"
)

FACT = f"""with {LINES}, {HEADERS}, {CUSTOMERS}, {PRODUCTS},
valued as (
  select lines.*, product_name, category, price, {VALUE} as order_value
  from lines join products using (product_id)),
fact as (
  select valued.*, headers.customer_id, order_date, upper(trim(payment_method)) as payment_method,
         strftime(order_date, '%Y-%m') as month
  from valued join headers using (order_key))
"""

RATE = "round(cast(100 as double) * sum(returned) / count(*), 2)"
ORDERS = "cast(count(*) as bigint)"
RETURNED = "cast(sum(returned) as bigint)"
REVENUE = "cast(round(sum(order_value), 2) as double)"
AOV = "round(cast(sum(order_value) as double) / count(*), 2)"

# White space of any kind, as the cleaning removes it.
SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"


EVENTS = """with raw as (
  select event_id as order_id, user_id as customer_id, event_type as product_id,
         strftime(ts, '%Y-%m-%d') as order_date,
         ' ' || (user_id % 5 + 1) as quantity,
         case when event_id % 10 = 0 then '' else cast(user_id % 4 * 10 as varchar) end as discount_pct,
         case event_id % 4 when 0 then upper(method) when 1 then chr(9) || method || chr(10)
                           when 2 then lower(method) else method end as payment_method,
         case when event_id % 11 = 0 then 'n/a' when event_id % 13 = 0 then '12x'
              else cast(cast(regexp_extract(props, '[0-9]+', 0) as integer) % 5 + 1 as varchar) end as rating,
         case when event_id % 3 = 0 then '1' else '0' end as returned,
         cast(value as decimal(18,2)) as amount
  from (select *, case user_id % 3 when 0 then 'Card' when 1 then 'cod' else 'UPI' end as method from events)),
""" + f"""numbers as (
  select order_id, customer_id, product_id, cast(order_date as date) as order_date,
         try_cast({_strip('quantity')} as double) as quantity,
         try_cast({_strip('discount_pct')} as double) as discount_pct,
         payment_method,
         try_cast({_strip('rating')} as double) as rating,
         try_cast(returned as integer) as returned, amount
  from raw),
typed as (select * replace (upper({_strip('payment_method')}) as payment_method) from numbers)
"""

COPY_KEY = "customer_id, product_id, order_date, quantity, discount_pct, payment_method"


def _first(source: str, key: str = COPY_KEY, condition: str = "= 1") -> str:
    return (
        f"select * exclude (rn) from (select *, row_number() over (partition by {key} order by order_id) as rn"
        f" from {source}) where rn {condition}"
    )


EVENT_ROWS = """with rows_ as (
  select event_id as order_id, user_id as customer_id, event_type as product_id,
         cast(ts as date) as order_date, value, props from events)
"""

FENCES = """with q as (
  select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
fences as (select q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q),
flagged as (select events.*, (value < lo or value > hi) as is_outlier from events, fences)
"""

TREND = FENCES + """, trend as (
  select strftime(ts, '%Y-%m') as month,
         cast(sum(cast(value as decimal(18,2))) as double) as revenue_all_orders,
         cast(sum(case when not is_outlier then cast(value as decimal(18,2)) end) as double)
           as revenue_without_outliers,
         round(cast(100 as double) * sum(case when event_id % 3 = 0 then 1 else 0 end) / count(*), 2)
           as return_rate_pct
  from flagged group by 1)
"""

ROLLUP = FACT + f""", rollup as (
  select customer_id, {ORDERS} as orders, sum(order_value) as amount, {RETURNED} as returns,
         avg(rating) as avg_rating, {RATE} as return_rate
  from fact group by 1),
tiered as (
  select *, case when amount <= 900000 then 'Low value' when amount <= 1100000 then 'Mid value'
                 else 'High value' end as segment, cast(round(amount, 2) as double) as spend
  from rollup)
"""

RISK = f"""select payment_method, city_tier, {ORDERS} as orders, {RATE} as return_rate_pct
  from fact join customers using (customer_id)"""

MEASURES = ("quantity", "discount_pct", "rating", "returned", "order_value")

CORRELATION = (
    FACT
    + f""", filled as (
  select cast(quantity as double) as quantity, cast(coalesce(discount_pct, 0) as double) as discount_pct,
         coalesce(cast(rating as double), (select median(rating) from lines)) as rating,
         cast(returned as double) as returned, cast(order_value as double) as order_value
  from valued),
matrix as ({" union all ".join(
    f"select '{a}' as var_x, '{b}' as var_y, round(corr({a}, {b}), 3) + 0.0 as r from filled"
    for a in MEASURES for b in MEASURES)})
"""
)


def _problems(cases: list[tuple[str, str, str]]) -> str:
    return " union all ".join(
        f"select '{name}' as check_name, cast(count(*) filter (where {bad}) as bigint) as problems from {source}"
        for name, bad, source in cases
    )


def _repeated(table: str, key: str, name: str) -> str:
    return (
        f"select '{name}' as check_name, cast(count(*) as bigint) as problems,"
        f" cast(coalesce(sum(n - 1), 0) as bigint) as surplus_rows"
        f" from (select count(*) as n from {table} group by {key} having count(*) > 1)"
    )


def _orphans(fact: str, dim: str, fact_key: str, dim_key: str) -> str:
    return (
        f"select '{fact}.{fact_key}' as check_name, cast(count(*) as bigint) as problems,"
        f" cast(count(distinct {fact_key}) as bigint) as orphan_keys from {fact}"
        f" where {fact_key} is not null and not exists (select 1 from {dim} where {dim_key} = {fact_key})"
    )


def _join_rows(fact: str, dim: str, fact_key: str, dim_key: str) -> str:
    return (
        f"select '{fact} to {dim}' as check_name, before as rows_before, after as rows_after,"
        f" before = after as preserved from (select (select cast(count(*) as bigint) from {fact}) as before,"
        f" (select cast(count(*) as bigint) from {fact} left join {dim} on {dim_key} = {fact_key}) as after)"
    )


CLEAN = f"""with {LINES}, {HEADERS}, {CUSTOMERS}, {PRODUCTS},
raw as (
  select order_id || '-' || arrival as order_id, customer_id, product_id, order_date, quantity, discount_pct,
         upper(trim(case when arrival = 1 then lower(payment_method) else payment_method end)) as payment_method,
         rating, returned
  from lines join headers using (order_key), (values (0), (1)) as arrivals(arrival)
  where arrival = 0 or (rating is null and quantity % 2 = 0)),
ranked as (
  select *, count(*) over (partition by {COPY_KEY}) as n_copies,
         row_number() over (partition by {COPY_KEY} order by order_id, rating nulls first, returned) as rn
  from raw),
kept as (select * exclude (rn) from ranked where rn = 1),
q as (select quantile_cont(quantity, 0.25) as q1, quantile_cont(quantity, 0.75) as q3 from kept),
fences as (select q1, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q),
f as (
  select kept.* replace (coalesce(discount_pct, 0) as discount_pct,
                         coalesce(rating, (select median(rating) from kept)) as rating),
         product_name, category, city, city_tier, acquisition_source, {VALUE} as order_value,
         strftime(order_date, '%Y-%m') as month, (quantity < lo or quantity > hi) as is_outlier
  from kept left join products using (product_id) left join customers using (customer_id), fences)
"""

_SUM = "cast(round(sum({}), 2) as double)"
_PEAK_ALL = "select round(sum(order_value), 2) as v from f group by month order by v desc, month limit 1"
_PEAK_KEPT = _PEAK_ALL.replace("from f", "from f where not is_outlier")


def _leaf(path: str, value: str, tail: str = "from f") -> str:
    return f"select '{path}' as path, cast({value} as double) as value {tail}"


def _leaves_by(column: str) -> str:
    prefix = f"'returns.by_{column}.' || {column}"
    return (
        f"select {prefix} || '.orders' as path, cast(count(*) as double) as value from f group by {column}"
        f" union all select {prefix} || '.return_rate_pct', {RATE} from f group by {column}"
    )


METRICS = (
    CLEAN
    + """, worst as (
  select payment_method, city_tier, count(*) as n, """
    + RATE
    + """ as rate from f group by 1, 2 order by rate desc, payment_method, city_tier limit 1),
people as (
  select case when s <= 900000 then 'low' when s <= 1100000 then 'mid' else 'high' end as tier, count(*) as n
  from (select customer_id, sum(order_value) as s from f group by 1) group by 1),
leaves as ("""
    + " union all ".join(
        [
            _leaf("data.raw_orders", "sum(n_copies)"),
            _leaf("data.clean_orders", "count(*)"),
            _leaf("data.duplicates_removed", "sum(n_copies - 1)"),
            _leaf("data.customers", "count(distinct customer_id)"),
            _leaf("data.products", "count(distinct product_id)"),
            _leaf("revenue.raw_total_inr", _SUM.format("order_value * cast(n_copies as decimal(9,0))")),
            _leaf("revenue.clean_total_inr", _SUM.format("order_value")),
            _leaf("revenue.duplicate_delta_inr", _SUM.format("order_value * cast(n_copies - 1 as decimal(9,0))")),
            _leaf("revenue.avg_order_value_inr", AOV),
            _leaf("returns.overall_rate_pct", RATE),
            _leaf("returns.returned_orders", "sum(returned)"),
            *[_leaves_by(c) for c in ("payment_method", "category", "city", "acquisition_source")],
            _leaf(
                "returns.worst_product_by_revenue_lost.revenue_lost_inr",
                "v",
                "from (select round(sum(order_value), 2) as v from f where returned = 1 group by product_id"
                " order by v desc limit 1)",
            ),
            _leaf("highest_risk_segment.city_tier", "city_tier", "from worst"),
            _leaf("highest_risk_segment.orders", "n", "from worst"),
            _leaf("highest_risk_segment.return_rate_pct", "rate", "from worst"),
            _leaf("outliers.q1", "q1", "from fences"),
            _leaf("outliers.q3", "q3", "from fences"),
            _leaf("outliers.upper_fence", "hi", "from fences"),
            _leaf("outliers.flagged_rows", "count(*) filter (where is_outlier)"),
            _leaf("outliers.peak_month_all_orders.revenue_inr", "v", f"from ({_PEAK_ALL})"),
            _leaf("outliers.peak_month_without_outliers.revenue_inr", "v", f"from ({_PEAK_KEPT})"),
            _leaf("correlations.discount_vs_returned", "round(corr(discount_pct, returned), 3) + 0.0"),
            _leaf("correlations.rating_vs_returned", "round(corr(rating, returned), 3) + 0.0"),
            _leaf("correlations.quantity_vs_returned", "round(corr(quantity, returned), 3) + 0.0"),
            f"select 'monthly.' || month, {REVENUE} from f where not is_outlier group by month",
            *[
                _leaf(f"segment_summary.{t}_value_customers", f"coalesce(sum(n) filter (where tier = '{t}'), 0)", "from people")
                for t in ("low", "mid", "high")
            ],
        ]
    )
    + ")"
)


def _text(path: str, value: str, tail: str = "") -> str:
    return f"select '{path}' as path, cast({value} as varchar) as text, cast(null as double) as value {tail}"


_LOST = (
    "from (select product_id, product_name, round(sum(order_value), 2) as v from f where returned = 1"
    " group by 1, 2 order by v desc, product_id limit 1)"
)
_MONTH = "from (select month, round(sum(order_value), 2) as v from f {} group by month order by v desc, month limit 1)"
_TABLES = ("returns.by_payment_method", "returns.by_category", "returns.by_city", "returns.by_acquisition_source", "monthly", "outliers.order_ids")
DOCUMENT = METRICS + " union all ".join(
    [
        "select path, cast(null as varchar) as text, value from leaves"
        " where path not like 'returns.by\\_%' escape '\\' and path not like 'monthly.%'",
        *[_text(f"data.source_files.{k}", f"'{t}'") for k, t in enumerate(("lineitem", "orders", "part", "customer"))],
        _text("data.period.from", "strftime(min(order_date), '%Y-%m-%d')", "from f"),
        _text("data.period.to", "strftime(max(order_date), '%Y-%m-%d')", "from f"),
        _text("returns.worst_product_by_revenue_lost.product_id", "product_id", _LOST),
        _text("returns.worst_product_by_revenue_lost.product_name", "product_name", _LOST),
        _text("highest_risk_segment.payment_method", "payment_method", "from worst"),
        _text("outliers.method", "'IQR (1.5x)'"),
        _text("outliers.handling", "'flagged only, never dropped'"),
        _text("outliers.peak_month_all_orders.month", "month", _MONTH.format("")),
        _text("outliers.peak_month_without_outliers.month", "month", _MONTH.format("where not is_outlier")),
        _text(
            "correlations.note",
            "case when greatest(abs(corr(discount_pct, returned)), abs(corr(rating, returned)), abs(corr(quantity, returned))) < 0.1495"
            " then 'all correlations are weak (|r| < 0.15) - no single numeric variable explains returns'"
            " else 'at least one correlation is not weak (|r| >= 0.15)' end",
            "from f",
        ),
        *[_text(f"tables.{k}", f"'{t}'") for k, t in enumerate(_TABLES)],
    ]
)


def _side_table(column: str) -> str:
    head = f"select 'returns.by_{column}' as section, {column} as label"
    tail = f"from f where {column} is not null group by {column}"
    return f"{head}, 'orders' as metric, cast(count(*) as double) as value {tail} union all {head}, 'return_rate_pct', {RATE} {tail}"


SIDE_TABLES = CLEAN + " union all ".join(
    [
        *[_side_table(c) for c in ("payment_method", "category", "city", "acquisition_source")],
        f"select 'monthly', month, null, {REVENUE} from f where not is_outlier group by month",
        "select 'outliers.order_ids', order_id, null, null from f where is_outlier",
    ]
)


def _figures(subject: str, name: str) -> str:
    """CTE ``name`` with the brief figures per value of the expression ``subject``."""
    base = f"(select f.*, {subject} as subject from f)"
    return f"""{name} as (
  select * from (
    select subject, count(*) as orders, strftime(min(order_date), '%Y-%m-%d') as first_day,
      strftime(max(order_date), '%Y-%m-%d') as last_day, {REVENUE} as revenue, {AOV} as avg_order_value,
      {RATE} as return_rate_pct, {_SUM.format("order_value * cast(n_copies as decimal(9,0))")} as raw_revenue,
      {_SUM.format("order_value * cast(n_copies - 1 as decimal(9,0))")} as duplicate_delta
    from {base} group by 1)
  join (
    select subject, first(payment_method order by rate desc, payment_method) as worst_payment,
      max(rate) as worst_rate_pct, first(payment_method order by rate, payment_method) as best_payment,
      min(rate) as best_rate_pct
    from (select subject, payment_method, {RATE} as rate from {base} group by 1, 2) group by 1) using (subject)
  join (
    select subject, first(payment_method order by rate desc, payment_method, city_tier) as risk_payment,
      first(city_tier order by rate desc, payment_method, city_tier) as risk_tier, max(rate) as risk_rate_pct
    from (select subject, payment_method, city_tier, {RATE} as rate from {base} group by 1, 2, 3)
    group by 1) using (subject)
  join (
    select subject, first(month order by v desc, month) as peak_month, max(v) as peak_revenue
    from (select subject, month, {REVENUE} as v from {base} where not is_outlier group by 1, 2)
    group by 1) using (subject)
  join (
    select subject, first(product_id order by v desc, product_id) as lost_product_id,
      first(product_name order by v desc, product_id) as lost_product, max(v) as lost_revenue
    from (select subject, product_id, product_name, {REVENUE} as v from {base} where returned = 1 group by 1, 2, 3)
    group by 1) using (subject))"""


def _inr(column: str) -> str:
    return f"'INR ' || format('{{:,.2f}}', {column})"


BRIEF = f"""
  'SITUATION' || chr(10) || subject || ': ' || orders || ' clean orders from ' || first_day || ' to ' || last_day
  || ' brought in ' || {_inr("revenue")} || ', on average ' || {_inr("avg_order_value")} || ' per order. '
  || return_rate_pct || '% of them were returned.' || chr(10) || chr(10) || 'COMPLICATION' || chr(10)
  || 'Returns differ by payment method: ' || worst_payment || ' stands at ' || worst_rate_pct || '% and '
  || best_payment || ' at ' || best_rate_pct || '%. The riskiest combination is ' || risk_payment || ' in tier '
  || risk_tier || ' cities with ' || risk_rate_pct || '%. Copies had raised raw revenue to '
  || {_inr("raw_revenue")} || ', which is ' || {_inr("duplicate_delta")}
  || ' too much. Without outliers the best month was ' || peak_month || ' with ' || {_inr("peak_revenue")} || '.'
  || chr(10) || chr(10) || 'RESOLUTION' || chr(10) || '1. Confirm ' || worst_payment
  || ' orders before they ship, first in tier ' || risk_tier || ' cities.' || chr(10)
  || '2. Reward customers who pay by ' || best_payment || '.' || chr(10) || '3. Review ' || lost_product || ' ('
  || lost_product_id || '), whose returned orders were worth ' || {_inr("lost_revenue")} || '.' || chr(10)
  || '4. Plan with figures that are free of copies and flagged for outliers.'"""

BRIEFS = f"{_figures('city', 'cities')}, briefs as (select subject as text_id, {BRIEF} as text from cities)"

DATE, MONTH, NUMBER = (
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}",
    r"\p{Nd}{4}-\p{Nd}{2}",
    r"\p{Nd}[\p{Nd},]*\.?\p{Nd}*",
)
TOKENS = (
    "list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text,"
    f" '{DATE}', ' DATE ', 'g'), '{MONTH}', ' MONTH ', 'g'), '{NUMBER}'), lambda x: replace(x, ',', '')))"
)
FORMS = "[replace(format('{:,.2f}', value), ',', ''), replace(format('{:,.0f}', value), ',', ''), cast(value as varchar)]"

HEADLINE = {
    "data.clean_orders": "Clean orders",
    "revenue.clean_total_inr": "Total revenue (clean)",
    "revenue.avg_order_value_inr": "Average order value",
    "revenue.duplicate_delta_inr": "Duplicate delta",
    "returns.overall_rate_pct": "Overall return rate %",
    "highest_risk_segment.return_rate_pct": "Highest-risk segment %",
    "highest_risk_segment.city_tier": "Highest-risk tier",
    "outliers.peak_month_without_outliers.revenue_inr": "Peak month revenue",
}

FACT_CHECK = (
    METRICS
    + f""", {_figures("'The company'", "companies")},
texts as (
  select 'doc-' || doc_id as text_id, text from documents
  union all select subject, {BRIEF} from companies),
tokens as (select text_id, {TOKENS} as tokens from texts),
headline as (
  select label, {FORMS} as forms from leaves
  join (values {", ".join(f"('{p}', '{label}')" for p, label in HEADLINE.items())}) as h(path, label) using (path)),
checked as (select text_id, label, list_has_any(tokens, forms) as ok, len(tokens) as numbers from tokens, headline)
"""
)

OWN_FIGURES = " union all ".join(
    f"select subject as text_id, '{label}' as label, cast({column} as double) as value from cities"
    for label, column in (
        ("Total revenue (clean)", "revenue"),
        ("Average order value", "avg_order_value"),
        ("Overall return rate %", "return_rate_pct"),
        ("Worst payment rate %", "worst_rate_pct"),
        ("Highest-risk segment %", "risk_rate_pct"),
        ("Duplicate delta", "duplicate_delta"),
        ("Peak month revenue", "peak_revenue"),
    )
)


CHECKED_BRIEFS = (
    CLEAN
    + f""", {BRIEFS}, own as ({OWN_FIGURES}),
own_checked as (
  select text_id, label, list_has_any({TOKENS}, {FORMS}) as ok from briefs join own using (text_id))
"""
)


KEYED = f"with {LINES}, keyed as " + """(select order_id, product_id, quantity, discount_pct, concat_ws('; ',
        case when discount_pct is null then 'discount_pct not null' end,
        case when order_id > min(order_id) over (partition by order_key) then 'order_key repeated' end,
        case when not exists (select 1 from part where p_size > 5 and p_partkey = product_id)
             then 'product_id unknown' end,
        case when not exists (select 1 from orders where o_orderstatus <> 'F' and o_orderkey = order_key)
             then 'order_key unknown' end) as reasons from lines)
"""

RECONCILED = f""", kept as ({_first("typed")}),
    a as (select count(*) as n, sum(amount) as s from typed), b as (select count(*) as n, sum(amount) as s from kept),
    c as (select count(*) as n, sum(amount) as s from ({_first("typed", COPY_KEY, "> 1")}))
    select cast(a.n as bigint) as raw_rows, cast(b.n as bigint) as clean_rows, cast(c.n as bigint) as removed_rows,
      cast(a.s as double) as raw_total, cast(b.s as double) as clean_total, cast(c.s as double) as delta
    from a, b, c"""

ORACLE: dict[str, str] = {
    "report1_headline": FACT
    + f"""select {ORDERS} as total_orders, cast(count(distinct customer_id) as bigint) as customers,
       {REVENUE} as total_revenue, {AOV} as avg_order_value, {RETURNED} as returned_orders,
       {RATE} as return_rate_pct from fact""",
    "report2_category": FACT
    + f"""select category, {ORDERS} as total_orders, {RETURNED} as returned_orders,
       {RATE} as return_rate_pct, {REVENUE} as revenue from valued group by 1""",
    "report3_payment": FACT
    + f"""select payment_method, {ORDERS} as total_orders, {AOV} as avg_order_value, {REVENUE} as revenue,
       {RATE} as return_rate_pct from fact group by 1""",
    "report4_repeat_returners": FACT
    + f"""select customer_id, name, city, acquisition_source, {ORDERS} as total_orders,
       {RETURNED} as returned_orders, {RATE} as return_rate_pct
       from fact join customers using (customer_id) group by 1, 2, 3, 4 having count(*) >= 3
       order by return_rate_pct desc, total_orders desc, customer_id limit 10""",
    "report5_city": FACT
    + f"""select city, cast(count(distinct customer_id) as bigint) as customers, {ORDERS} as total_orders,
       {REVENUE} as revenue, {RATE} as return_rate_pct
       from fact join customers using (customer_id) group by 1""",
    "report6_channel": FACT
    + f"""select acquisition_source, {ORDERS} as total_orders,
       cast(count(distinct customer_id) as bigint) as customers, {REVENUE} as revenue,
       round(cast(sum(order_value) as double) / count(distinct customer_id), 2) as revenue_per_customer,
       {RATE} as return_rate_pct from fact join customers using (customer_id) group by 1""",
    "report7_product_loss": FACT
    + f"""select product_id, product_name, category, cast(price as double) as price, {ORDERS} as total_orders,
       {RETURNED} as returned_orders, {RATE} as return_rate_pct,
       cast(round(sum(case when returned = 1 then order_value else 0 end), 2) as double)
         as revenue_lost_to_returns
       from valued group by product_id, product_name, category, valued.price""",
    "report8_discount_bucket": FACT
    + f"""select case when coalesce(discount_pct, 0) = 0 then '1. No discount (0%)'
       when discount_pct <= 3 then '2. Low (1-10%)' when discount_pct <= 6 then '3. Medium (11-20%)'
       else '4. High (21-30%)' end as discount_bucket, {ORDERS} as total_orders,
       {RETURNED} as returned_orders, {RATE} as return_rate_pct, {AOV} as avg_order_value
       from valued group by 1""",
    "report9_monthly": FACT
    + f"""select month as order_month, {ORDERS} as total_orders, cast(sum(quantity) as bigint) as units_sold,
       {REVENUE} as revenue, {RATE} as return_rate_pct from fact group by 1""",
    "report9_colocated": FACT
    + f"""select month as order_month, {ORDERS} as total_orders, cast(sum(quantity) as bigint) as units_sold,
       {REVENUE} as revenue, {RATE} as return_rate_pct from fact group by 1""",
    "report9_recent_months": FACT
    + f"""select month as order_month, {ORDERS} as total_orders, cast(sum(quantity) as bigint) as units_sold,
       {REVENUE} as revenue, {RATE} as return_rate_pct from fact
       where month in (select distinct strftime(o_orderdate, '%Y-%m') as m from orders order by m desc limit 3) group by 1""",
    "json_leaves": """with even as (select * from events where event_id % 2 = 0), odd as (select * from events where event_id % 2 <> 0)
      select event_id, 'id' as path, cast(null as varchar) as text, cast(event_id as double) as value from even
      union all select event_id, 'pair.0', null, 1.5 from even
      union all select event_id, 'pair.1', null, 2.5 from even
      union all select event_id, 'in.type', event_type, null from even where event_type is not null
      union all select event_id, 'in.list.0.user', null, cast(user_id as double) from even
      union all select event_id, 'in.list.1.flag', case when user_id % 7 = 0 then 'true' else 'false' end, null from even
      union all select event_id, 'id', 'x' || event_id, null from odd
      union all select event_id, 'in.0', 'true', null from odd
      union all select event_id, 'in.1', null, cast(user_id as double) from odd
      union all select event_id, 'in.2', 's', null from odd""",
    "order_value": FACT
    + "select order_id, product_id, quantity, cast(order_value as double) as order_value from valued",
    "enrich_orders": FACT
    + """select order_id, customer_id, product_id, category, city, acquisition_source, month,
       cast(order_value as double) as order_value from fact left join customers using (customer_id)""",
    "coerce_numeric": EVENTS + "select order_id, quantity, discount_pct, rating, returned from numbers",
    "value_counts_raw": f"with {HEADERS} select payment_method, {ORDERS} as orders from headers group by 1",
    "value_counts_clean": f"with {HEADERS} select upper(trim(payment_method)) as payment_method,"
    f" {ORDERS} as orders from headers group by 1",
    "profile_orders": EVENTS
    + f""", facts as (
      select 'rows' as metric, null as item, count(*) as value from numbers
      union all select 'missing discount_pct', null, count(*) - count(discount_pct) from numbers
      union all select 'missing rating', null, count(*) - count(rating) from numbers
      union all select 'quantity above 4', null, count(*) filter (where quantity > 4) from numbers
      union all select 'duplicate rows', null, coalesce(sum(n - 1), 0)
        from (select count(*) as n from numbers group by {COPY_KEY})
      union all select 'payment_method spellings', null, count(distinct payment_method) from numbers
      union all select 'payment_method spelling', payment_method, count(*) from numbers group by 2)
    select metric, item, cast(value as bigint) as value from facts""",
    "iqr_bounds_by_type": """select event_type, count(value) as n_values, round(quantile_cont(value, 0.25), 6) as q1,
      round(quantile_cont(value, 0.75), 6) as q3,
      round(quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) as lower_fence,
      round(quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 6) as upper_fence
      from events group by event_type""",
    "iqr_flag_by_type": """with f as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
      from events group by event_type)
      select event_id, e.event_type, value from events e join f on e.event_type is not distinct from f.event_type
      where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""",
    "median_per_user": """select user_id, count(value) as n_values, round(quantile_cont(value, 0.5), 6) as median_value
      from events group by user_id""",
    "dedup_keep_first": EVENT_ROWS + _first("rows_", "customer_id, product_id, order_date"),
    "dedup_removed_rows": EVENT_ROWS + _first("rows_", "customer_id, product_id, order_date", "> 1"),
    "fill_missing": EVENTS + "select order_id, coalesce(discount_pct, 0) as discount_pct, rating from numbers",
    "fill_rating_median": EVENTS
    + "select order_id, coalesce(rating, (select median(rating) from numbers)) as rating from numbers",
    "clean_orders": EVENTS
    + f""", kept as ({_first("typed")})
    select * replace (coalesce(discount_pct, 0) as discount_pct, cast(amount as double) as amount,
      coalesce(rating, (select median(rating) from kept)) as rating) from kept""",
    "clean_orders_fill_first": EVENTS
    + f""", filled as (select * replace (coalesce(discount_pct, 0) as discount_pct) from typed),
    kept as ({_first("filled")})
    select * replace (cast(amount as double) as amount) from kept""",
    "revenue_reconciliation": EVENTS
    + RECONCILED,
    "reconciliation_incremental": EVENTS
    + RECONCILED,
    "iqr_bounds": FENCES
    + """select round(q1, 6) as q1, round(q3, 6) as q3, round(iqr, 6) as iqr, round(lo, 6) as lower_fence,
       round(hi, 6) as upper_fence, (select cast(count(value) as bigint) from events) as n_values,
       (select cast(count(*) filter (where is_outlier) as bigint) from flagged) as flagged_rows from fences""",
    "iqr_flag": FENCES + "select event_id, value, is_outlier from flagged",
    "iqr_outliers": FENCES + "select event_id, user_id, value from flagged where is_outlier",
    "monthly_trend_clean": TREND + "select * from trend",
    "peak_month": TREND
    + """(select 'all orders' as series, month, revenue_all_orders as revenue from trend
       order by revenue desc, month limit 1)
    union all (select 'outliers excluded', month, revenue_without_outliers as revenue from trend
       order by revenue desc, month limit 1)""",
    "customer_rollup": ROLLUP
    + "select customer_id, orders, returns, avg_rating, return_rate, spend from tiered",
    "customer_segments": ROLLUP
    + """select customer_id, orders, returns, avg_rating, return_rate, segment, city, city_tier,
       acquisition_source, spend from tiered left join customers using (customer_id)""",
    "segment_summary": ROLLUP
    + f"""select segment, {ORDERS} as customers, round(cast(sum(orders) as double) / count(*), 2) as avg_orders,
       round(cast(sum(amount) as double) / count(*), 2) as avg_spend,
       round(cast(sum(cast(return_rate as decimal(9,2))) as double) / count(*), 2) as avg_return_rate
       from tiered group by 1""",
    "repeat_returners": ROLLUP
    + """select customer_id, orders, returns, return_rate, spend, city
       from tiered left join customers using (customer_id) where orders >= 3
       order by return_rate desc, orders desc, customer_id limit 5""",
    "risk_segment": FACT + RISK + " where payment_method = '1-URGENT' group by 1, 2",
    "risk_ranking": FACT + RISK + " group by 1, 2",
    "rating_contrast": f"with {LINES}, filled as (select returned, coalesce(rating, (select median(rating) from lines)) as rating from lines) "
    + f"""select case when rating <= 2 then 'rating 1-2' else 'rating 4-5' end as band, {ORDERS} as orders,
       round(cast(100 as double) * sum(returned) / count(*), 1) as return_rate_pct
       from filled where rating <= 2 or rating >= 4 group by 1""",
    "rate_by_all_dims": FACT
    + f""", wide as (select fact.*, city, acquisition_source from fact left join customers using (customer_id)),
    cells as (select payment_method, category, city, acquisition_source, {ORDERS} as orders,
      {RETURNED} as returned_orders, {RATE} as return_rate_pct,
      grouping(payment_method, category, city, acquisition_source) as g
      from wide group by grouping sets ((payment_method), (category), (city), (acquisition_source), ()))
    select case g when 7 then 'payment_method' when 11 then 'category' when 13 then 'city'
                  when 14 then 'acquisition_source' else 'all' end as dimension,
      case when g = 15 then 'all' else coalesce(payment_method, category, city, acquisition_source) end as label,
      orders, returned_orders, return_rate_pct from cells""",
    "worst_product": FACT
    + f"""select product_id, product_name, {REVENUE} as revenue_lost from valued where returned = 1
       group by 1, 2 order by revenue_lost desc, product_id limit 1""",
    "returned_share": f"with {LINES} "
    + f"""select returned, {ORDERS} as orders,
       round(cast(100 as double) * count(*) / (select count(*) from lines), 1) as pct from lines group by 1""",
    "correlation_matrix": CORRELATION + "select * from matrix",
    "correlation_merged": CORRELATION + "select * from matrix",
    "distinct_customers_by_grain": """select 'month' as grain, strftime(o_orderdate, '%Y-%m') as label, count(*) as orders,
      count(distinct o_custkey) as customers, true as within_bound from orders group by 2
      union all select 'all', 'all', count(*), count(distinct o_custkey), true from orders""",
    "value_quantiles_by_grain": """with dated as (select strftime(ts, '%Y-%m') as label, value from events),
      grains as (select * from dated union all select 'all', value from dated)
      select label, cast(p as double) as p, count(value) as n_values, true as within_bound
      from grains, (values (0.1), (0.5), (0.9)) as shares(p) group by label, p""",
    "correlation_verdicts": CORRELATION
    + """select var_x as variable, r, case when abs(r) < 0.15 then 'weak' else 'notable' end as verdict
       from matrix where var_y = 'returned' and var_x <> 'returned'""",
    "dq_pk_unique": _repeated("orders", "o_orderkey", "orders")
    + " union all "
    + _repeated("lineitem", "l_orderkey, l_linenumber", "lineitem"),
    "dq_not_null": f"with {LINES} "
    + _problems(
        [
            (f"{c} not null", f"{c} is null", "lines")
            for c in ("order_id", "product_id", "quantity", "discount_pct", "rating", "returned")
        ]
    ),
    "dq_domain": f"with {LINES}, {CUSTOMERS} "
    + _problems(
        [
            ("city_tier in domain", "city_tier not in (1, 2)", "customers"),
            (
                "acquisition_source in domain",
                "acquisition_source not in ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY')",
                "customers",
            ),
            ("returned in domain", "returned not in (0, 1)", "lines"),
        ]
    ),
    "dq_range": f"with {LINES} "
    + _problems(
        [
            ("quantity in range", "quantity <= 0 or quantity > 45", "lines"),
            ("discount_pct in range", "discount_pct < 0 or discount_pct > 100", "lines"),
            ("rating in range", "rating < 2 or rating > 5", "lines"),
            ("c_acctbal in range", "c_acctbal <= 0", "customer"),
        ]
    ),
    "dq_fk_orphans": "with solvent as (select * from customer where c_acctbal > 0) "
    + " union all ".join(
        [
            _orphans("orders", "solvent", "o_custkey", "c_custkey"),
            _orphans("lineitem", "orders", "l_orderkey", "o_orderkey"),
            _orphans("lineitem", "part", "l_partkey", "p_partkey"),
        ]
    ),
    "dq_row_counts": " union all ".join(
        f"select '{t}' as table_name, cast(count(*) as bigint) as rows_loaded from {t}"
        for t in ("customer", "part", "orders", "lineitem")
    ),
    "dq_null_counts": f"with {LINES} "
    + _problems([(f"{c} NULLs", f"{c} is null", "lines") for c in ("discount_pct", "rating")]),
    "dq_dim_key_unique": " union all ".join(
        [
            _repeated("part", "p_partkey", "part.p_partkey"),
            _repeated("customer", "c_custkey", "customer.c_custkey"),
            _repeated("orders", "o_custkey", "orders.o_custkey"),
        ]
    ),
    "dq_join_rowcount": " union all ".join(
        [
            _join_rows("lineitem", "part", "l_partkey", "p_partkey"),
            _join_rows("orders", "customer", "o_custkey", "c_custkey"),
            _join_rows("orders", "lineitem", "o_orderkey", "l_orderkey"),
        ]
    ),
    "dq_quarantine": f"with {LINES}, checked as "
    + """(select order_id, product_id, quantity, rating, concat_ws('; ',
        case when discount_pct is null then 'discount_pct not null' end,
        case when returned <> 0 then 'returned in domain' end,
        case when quantity <= 0 or quantity > 45 then 'quantity in range' end,
        case when rating < 2 or rating > 5 then 'rating in range' end,
        case when not exists (select 1 from part where p_size > 5 and p_partkey = product_id)
             then 'product_id unknown' end) as reasons from lines)
    select * from checked where reasons <> ''""",
    "dq_accepted": KEYED + "select order_id, product_id, quantity, discount_pct from keyed where reasons = ''",
    "dq_rejected_keys": KEYED + "select order_id, reasons from keyed where reasons <> ''",
    "csv_roundtrip": f"with {LINES} "
    + """select order_id, 'C' || order_key as customer_id, 'P' || product_id as product_id, '2026-01-31' as day,
       case when order_key % 50 <> 7 then quantity end as quantity, discount_pct, rating, returned,
       concat_ws('; ', case when order_key % 50 = 7 then 'unreadable cell' end,
                 case when discount_pct is null then 'discount_pct not null' end) as reasons from lines""",
    "ingest_roundtrip": f"with {HEADERS} select order_key, customer_id, order_date, payment_method,"
    " strftime(order_date, '%Y-%m') as order_month from headers",
    "chart_rate_by_payment": FACT
    + f""", rates as (select payment_method, {RATE} as return_rate_pct from fact group by 1)
    select payment_method, return_rate_pct, (select {RATE} from fact) as overall_rate_pct,
      return_rate_pct = (select max(return_rate_pct) from rates) as is_highest from rates""",
    "chart_monthly_revenue": FACT + f"select month, {REVENUE} as revenue from fact group by 1",
    "findings_document": DOCUMENT,
    "findings_tables": SIDE_TABLES,
    "findings_metrics": METRICS + "select * from leaves",
    "findings_roundtrip": DOCUMENT,
    "reconcile_short_key": CLEAN.replace("partition by " + COPY_KEY, "partition by customer_id, product_id, order_date").replace(
        "order by order_id, rating", "order by order_id, quantity, discount_pct nulls first, payment_method, rating"
    )
    + f"""select cast((select count(*) from raw) as bigint) as raw_orders, {ORDERS} as clean_orders,
       (select {REVENUE} from (select {VALUE} as order_value from raw left join products using (product_id))) as raw_total_inr,
       {REVENUE} as clean_total_inr from f""",
    "narrative_render": CLEAN + f", {BRIEFS} select text_id, text from briefs",
    "fact_check_headline": FACT_CHECK + "select text_id, label, ok from checked",
    "fact_check_score": FACT_CHECK
    + """select text_id, cast(count(*) filter (where ok) as bigint) as matched, cast(count(*) as bigint) as total,
       cast(max(numbers) as bigint) as numbers from checked group by 1""",
    "fact_check_unsupported": FACT_CHECK
    + f""", allowed as (select unnest({FORMS}) as token from leaves)
    select text_id, token from (select text_id, unnest(tokens) as token from tokens)
    where length(token) > 2
      and not (regexp_full_match(token, '[0-9]{{4}}') and coalesce(try_cast(token as integer), 0) between 2000 and 2099)
      and token not in (select token from allowed)""",
    "fact_check_briefs": CHECKED_BRIEFS + "select * from own_checked",
    "brief_scores": CHECKED_BRIEFS
    + f"""select text_id, cast(count(*) filter (where ok) as bigint) as matched, {ORDERS} as total
       from own_checked group by 1""",
    "brief_store": CHECKED_BRIEFS
    + f"""select text_id, any_value(text) as text, 'template' as generated_by,
       cast(count(*) filter (where ok) as bigint) as matched, {ORDERS} as total
       from own_checked join briefs using (text_id) group by 1""",
    "text_word_count": "select doc_id, cast(len(list_filter(string_split_regex(text, "
    f"'{SPACES}+'), lambda w: w <> '')) as bigint) as words from documents",
}
