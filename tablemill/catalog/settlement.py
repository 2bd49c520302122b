"""Warehouse settlement jobs (Q).  The star schema is derived from the order tables."""

from pyspark.sql import functions as F

from tablemill.functions.numbers import money
from tablemill.plans.settlement import high_water_mark, settlement
from tablemill.registry import job

# one definition per column and engine: name -> (Spark SQL, DuckDB SQL); None means the same text
TYPE = "CASE l_returnflag WHEN 'A' THEN 'SALE' WHEN 'R' THEN 'PURCHASE' ELSE 'OTHER' END"
INV = {
    "contract_type": TYPE, "contract_number": "l_orderkey", "contract_line_number": "l_linenumber", "release_number": "CAST(l_orderkey % 4 AS INT)",
    "source_system_id": "l_suppkey", "type": "CASE WHEN l_partkey % 11 = 0 THEN 'Planned' WHEN l_linestatus = 'F' THEN 'Actualized' ELSE 'Reversed' END",
    "last_update_date": "{day_l}", "update_dt": "{day_l}",
    "json_object_id": "CAST(l_orderkey AS {text}) || '-' || CAST(l_linenumber AS {text}) || '-' || CAST(l_suppkey AS {text}) || CASE WHEN l_partkey % 13 = 0 THEN '-BOD' ELSE '' END",
    "actual_quantity": "CAST(l_quantity AS DECIMAL(18,2))", "actual_quantity_32e": "CAST(l_quantity * 0.5 AS DECIMAL(18,3))",
    "volume_uom_contract": "CASE WHEN l_suppkey % 2 = 0 THEN 'MT' ELSE 'BBL' END", "accounting_dt_id": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE {key_l} END",
    "invoiced_status": "l_linestatus", "actual_shipment_dt_id": "{key_l}", "received_dt_id": "{key_l} + 1", "contract_line_id1": "l_orderkey",
    "location_id1": "l_suppkey % 10", "product_id1": "l_partkey", "mele_id1": "l_suppkey", "legal_entity_id1": "l_suppkey % 7"}
MTM = {
    "mtm_guid": "l_orderkey * 10 + l_linenumber", "contract_line_id": "l_orderkey * 10 + l_linenumber", "contract_number": "l_orderkey",
    "contract_line_number": "l_linenumber", "contract_type": TYPE, "exp_settlement_amt_contract": "CAST(o_totalprice AS DECIMAL(18,2))",
    "curr_quantity_32e": "CAST(CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE l_linenumber * 7 END AS DECIMAL(18,2))",
    "curr_quantity_contract": "CAST(CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE l_linenumber * 3 END AS DECIMAL(18,2))",
    "curr_contract_price_usd_32e": "o_totalprice / 100", "curr_contract_price_contract": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 50 END",
    "position_start_dt_id": "{key_o}", "mtm_type": "CASE o_orderstatus WHEN 'P' THEN 'Unrealized' ELSE 'Realized' END",
    "bkr_txn_type": "CASE o_orderpriority WHEN '5-LOW' THEN 'FREIGHT' ELSE 'COMMODITY' END", "currency_uom_contract": "CASE WHEN o_custkey % 10 = 0 THEN 'EUR' ELSE 'USD' END",
    "update_dt": "{day_o}", "inventory_org_id": "o_custkey % 25", "product_id": "o_custkey % 50", "mele_id": "o_custkey % 100", "legal_entity_id": "o_custkey % 7"}


def _columns(spec, text, day, key):
    marks = {"text": text, "day_l": day.format("l_shipdate"), "key_l": key.format("l_shipdate"), "day_o": day.format("o_orderdate"), "key_o": key.format("o_orderdate")}
    return [f"{e.format(**marks)} AS {n}" for n, e in spec.items()]


def _spark(spec):
    return _columns(spec, "STRING", "CAST({} AS DATE)", "CAST(year({0}) * 10000 + month({0}) * 100 + day({0}) AS INT)")


def _duck(spec):
    return ", ".join(_columns(spec, "VARCHAR", "strftime({}, '%Y-%m-%d')", "CAST(strftime({}, '%Y%m%d') AS INT)"))


def sources(t):
    line, order = t.lineitem, t.orders
    inv = line.selectExpr(*_spark(INV))
    lines = line.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return {
        "inv": inv,
        "mtm": lines.join(order, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_spark(MTM)),
        "bridge": inv.select("release_number", F.col("json_object_id").alias("calc_key"), F.col("source_system_id").alias("mtl_txn_id"),
                             (F.col("contract_number") * 10 + F.col("contract_line_number")).alias("mtm_guid")).distinct(),
        "contracts": order.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("surrogate_key2"), F.when(F.col("c_mktsegment") == "BUILDING", "Draft").otherwise("Final").alias("price_status")),
        "product": t.part.select(F.col("p_partkey").alias("surrogate_key2"), F.col("p_type").alias("product_type"), F.col("p_name").alias("prod_name"),
                                 F.col("p_brand").alias("ebs_item")),
        "entity": t.supplier.filter("s_suppkey % 2 = 0").select(
            F.col("s_suppkey").alias("surrogate_key2"), F.col("s_suppkey").cast("string").alias("mele_code"), F.col("s_name").alias("mele_name")),
        "organisation": t.nation.filter("n_nationkey < 20").select(
            F.col("n_nationkey").cast("bigint").alias("surrogate_key2"), F.col("n_nationkey").cast("string").alias("org_code"), F.col("n_name").alias("org_name")),
    }


# ---- the rules for the oracle, stated for the given tables --------------------------------
# What a contract line shows: how it is drawn from the rows of the line, and the column it is drawn from.
# "greatest" ignores what is unknown, "else 0" shows 0 if all is, "unknown 0" counts each unknown as 0.
SHOWN = {
    "greatest": {
        "price_status": "i.price_status", "legal_entity_id": "m.legal_entity_id", "mele_id": "m.mele_id", "product_id": "m.product_id", "contract_uom": "i.uom",
        "inventory_org_id": "m.inventory_org_id", "invoiced_status": "i.status", "last_update_date": "i.updated", "contract_currency": "m.currency_uom_contract",
        "ebs_item": "p_brand", "product_name": "p_name", "product_type": "p_type"},
    "else 0": {
        "total_contract_price_contract_uom": "m.curr_contract_price_contract", "total_contract_price_usd_32e": "m.curr_contract_price_usd_32e",
        "actualization_dt_id": "CASE i.line.kind WHEN 'PURCHASE' THEN i.received WHEN 'SALE' THEN i.shipped END"},
    "unknown 0": {"accounting_dt_id": "i.accounted"},
    "sum": {"total_quantity_contract_uom": "i.whole", "total_quantity_32e": "i.half"},
}
NAMED = {"mele_code": "CAST(s_suppkey AS VARCHAR)", "mele_name": "s_name", "inv_org_code": "CAST(n_nationkey AS VARCHAR)", "inv_org_name": "n_name"}
DRAWN = {"greatest": "max({})", "else 0": "coalesce(max({}), 0)", "unknown 0": "max(coalesce({}, 0))", "sum": "CAST(sum({}) AS DOUBLE)"}
#: What the newest row of a contract line decides for all of it.
DECIDES = {"received": "received_dt_id", "shipped": "actual_shipment_dt_id", "status": "invoiced_status", "accounted": "accounting_dt_id", "uom": "volume_uom_contract"}

# A contract line is one value.  Its newest row is the one of the greatest text of source, day and kind; it
# speaks for the rows of its source if it is a purchase or a sale that took place.  Rows whose order is of
# a customer of the building segment have no final price.  An order line is one marked position.
STAR = f"""moved AS (SELECT *, {{'kind': contract_type, 'number': contract_number, 'place': contract_line_number, 'release': release_number}} AS line
      FROM (SELECT {_duck(INV)} FROM lineitem)),
  decided AS (SELECT line, source_system_id AS source, count(*) AS times, {", ".join(f"max({c}) AS {n}" for n, c in DECIDES.items())}
    FROM (FROM moved WHERE json_object_id[-3:] <> 'BOD' QUALIFY dense_rank() OVER (PARTITION BY line ORDER BY source_system_id || last_update_date || type DESC) = 1)
    WHERE line.kind <> 'OTHER' AND type <> 'Planned' GROUP BY line, source),
  marked AS (SELECT {_duck(MTM)} FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_returnflag) * FROM lineitem) JOIN orders ON l_orderkey = o_orderkey),
  settled AS (SELECT d.*, moved.product_id1 AS part, 'Final' AS price_status, max(moved.last_update_date) AS updated, max(moved.update_dt) AS update_dt,
      sum(moved.actual_quantity) * any_value(d.times) AS whole, sum(moved.actual_quantity_32e) * any_value(d.times) AS half
    FROM moved JOIN decided d ON moved.line = d.line AND moved.source_system_id = d.source
    WHERE moved.contract_number NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
    GROUP BY ALL)"""


def _allocated(quantity, base, original):
    # the exact quotient, rounded half up at the sixth (original: quotient at the tenth) decimal in whole numbers
    a = "CAST(sum(m.exp_settlement_amt_contract) * 100 AS HUGEINT)"
    q = f"CAST(sum(i.{quantity}) * 1000 AS HUGEINT)"
    b = f"CAST(CASE WHEN coalesce(sum(m.{base}), 0) = 0 THEN 1 ELSE sum(m.{base}) END * 1000 AS HUGEINT)"
    if original:
        # quantity / base has at least 13 decimals before it is cut to ten
        quotient = f"(({q} * 20000000000 + {b}) // (2 * {b}))"
        # the product keeps six decimals
        return f"(({a} * {quotient} + 500000) // 1000000)"
    return f"(({a} * {q} * 20000 + {b}) // (2 * {b}))"


def settlement_sql(condition, original=False):
    """The loaded rows; ``condition`` is on a settled row ``i`` and a marked position ``m``."""
    columns = [f"{DRAWN[how].format(c)} AS {n}" for how, drawn in SHOWN.items() for n, c in drawn.items()]
    columns += [] if original else [f"max({c}) AS {n}" for n, c in NAMED.items()]
    columns += [f"CAST({_allocated(*parts, original)} AS DOUBLE) / 1000000 AS {n}" for n, parts in (
        ("total_settlement_amt_contract_uom", ("whole", "curr_quantity_contract")), ("total_settlement_amt_32e", ("half", "curr_quantity_32e")))]
    keys = {"contract_type": "kind", "contract_number": "number", "contract_line_number": "place", "release_number": "release"}
    text = "concat_ws('|#|', line.kind, line.number, line.place, line.release)"
    # supplier and nation name a position's entity and organisation where they do
    named = "" if original else """LEFT JOIN (FROM supplier WHERE s_suppkey % 2 = 0) ON m.mele_id = s_suppkey
        LEFT JOIN (FROM nation WHERE n_nationkey < 20) ON m.inventory_org_id = n_nationkey"""
    status = ", 'HIST LOAD' AS blackline_status" if original else ""
    return f"""WITH {STAR}, loaded AS (
        SELECT i.line, m.contract_line_id, max(greatest(i.updated, m.update_dt)) AS change_date, {", ".join(columns)}
        FROM marked m JOIN settled i ON m.mtm_guid = 10 * i.line.number + i.line.place AND m.contract_type = i.line.kind JOIN part ON i.part = p_partkey {named}
        WHERE (m.mtm_type, m.bkr_txn_type, m.currency_uom_contract) = ('Realized', 'COMMODITY', 'USD') AND ({condition})
        GROUP BY i.line, m.contract_line_id)
      SELECT * EXCLUDE line, {", ".join(f"line.{c} AS {n}" for n, c in keys.items())}, {text} AS alternate_key, {text} || '|#|' || strftime(change_date::DATE, '%Y%m%d') AS natural_key,
        CAST(strftime(change_date::DATE, '%Y%m%d') AS INTEGER) AS change_dt_id, NULL::DOUBLE AS invoice_unit_price, NULL::VARCHAR AS accounted_flg {status} FROM loaded"""


def _shown(df):
    """Decimals as double and dates as text for the comparison."""
    decimals = ("total_settlement_amt_32e", "total_settlement_amt_contract_uom", "total_quantity_32e", "total_quantity_contract_uom")
    return df.withColumns({**{c: F.col(c).cast("double") for c in decimals}, **{c: F.col(c).cast("string") for c in ("last_update_date", "change_date")}})


YEAR, SINCE = 1998, "2000-06-01"


@job("q01_yearly_settlement", settlement_sql(f"m.position_start_dt_id // 10000 = {YEAR}"))
def yearly_settlement(t):
    return _shown(settlement(sources(t), year=YEAR, load_stamps=False))


@job("q02_changed_settlement", settlement_sql(f"greatest(i.update_dt, m.update_dt) >= '{SINCE}'"))
def changed_settlement(t):
    return _shown(settlement(sources(t), changed_since=SINCE, load_stamps=False))


@job("q02_high_water_mark", f"SELECT max(change_date) AS loaded_until FROM ({settlement_sql(f'm.position_start_dt_id // 10000 = {YEAR}')})")
def loaded_until(t):
    return high_water_mark(settlement(sources(t), year=YEAR, load_stamps=False))


@job("q03_original_settlement", settlement_sql(f"m.position_start_dt_id // 10000 = {YEAR}", original=True))
def original_settlement(t):
    return _shown(settlement(sources(t), year=YEAR, original=True, load_stamps=False))


@job("q04_allocated_amount", """
    SELECT l_orderkey, CAST((CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS HUGEINT) * CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) * 1000 AS HUGEINT) * 20000
        + CAST(b * 1000 AS HUGEINT)) // (2 * CAST(b * 1000 AS HUGEINT)) AS DOUBLE) / 1000000 AS amount
    FROM (SELECT *, CASE WHEN sum(l_linenumber) OVER (PARTITION BY l_orderkey) % 7 = 0 THEN 1 ELSE sum(l_linenumber) OVER (PARTITION BY l_orderkey) END AS b FROM lineitem) GROUP BY l_orderkey, b""")
def allocated_amount(t):
    from tablemill.plans.settlement import allocated

    lines = F.sum("l_linenumber")
    base = F.when(lines % 7 == 0, 0).otherwise(lines)
    return t.lineitem.groupBy("l_orderkey").agg(
        allocated(F.sum(money("l_extendedprice")), F.sum(money("l_quantity")), base).cast("double").alias("amount"))
