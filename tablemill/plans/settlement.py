"""Contract settlement: actual quantities against marked positions, as one load per year or change date.

``sources`` is a mapping with the frames ``inv`` (inventory transactions), ``mtm`` (marked
positions), ``bridge`` (transaction to position), ``contracts``, ``product``, ``entity`` and
``organisation``.  Change dates are of type DATE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.joining import latest_versions
from tablemill.session import stage

CONTRACT = ["contract_type", "contract_number", "contract_line_number", "release_number"]
# The same columns where rows are sorted by them: sorts look at the first column first, and few rows share a number.
BY_NUMBER = ["contract_number", "contract_line_number", "release_number", "contract_type"]
IDS = ["contract_line_id1", "location_id1", "product_id1", "mele_id1", "legal_entity_id1"]
SEP = "|#|"
# The contract types that are settled.
SETTLED = ["SALE", "PURCHASE"]


def latest_transactions(inv: DataFrame) -> DataFrame:
    """Latest transaction per contract line by the text of source, update date and type; ties stay."""
    version = F.concat(F.col("source_system_id").cast("string"), F.col("last_update_date").cast("string"), F.col("type"))
    keep = F.col("contract_type").isin(*SETTLED) & F.col("type").isin("Actualized", "Reversed")
    return latest_versions(inv.filter(~F.col("json_object_id").like("%BOD")), BY_NUMBER, version, keep)


def settled_quantities(sources: dict[str, DataFrame]) -> DataFrame:
    """Quantities per contract line, source and position.

    Transactions and latest versions are each summed up on the join keys first, so a contract
    with very many rows meets its latest version as a few rows; a tie in the latest version
    still counts every transaction once per tied row.
    """
    inv = sources["inv"].groupBy(*CONTRACT, "source_system_id", *IDS, "json_object_id").agg(
        F.sum("actual_quantity_32e").alias("q32"), F.sum("actual_quantity").alias("q"),
        F.max("last_update_date").alias("last_update_date"), F.max("update_dt").alias("update_dt"))
    taken = ["volume_uom_contract", "accounting_dt_id", "invoiced_status", "actual_shipment_dt_id", "received_dt_id"]
    latest = latest_transactions(sources["inv"]).groupBy(*CONTRACT, "source_system_id").agg(
        F.count(F.lit(1)).alias("ties"), *[F.max(c).alias(c) for c in taken])
    final = sources["contracts"].filter(F.col("price_status") == "Final").select(F.col("surrogate_key2").alias("contract_line_id1"))
    bridge = sources["bridge"].select("release_number", F.col("calc_key").alias("json_object_id"), F.col("mtl_txn_id").alias("source_system_id"), "mtm_guid")
    joined = (
        inv.join(latest, [*BY_NUMBER, "source_system_id"])
        .join(bridge, ["json_object_id", "source_system_id", "release_number"])
        .join(final, "contract_line_id1")
    )
    # the latest values belong to contract line and source: as keys they keep this a hash aggregation
    return joined.groupBy(*CONTRACT, "source_system_id", "mtm_guid", *IDS, *taken).agg(
        F.sum(F.col("q32") * F.col("ties")).alias("actual_quantity_32e"), F.sum(F.col("q") * F.col("ties")).alias("actual_quantity"),
        F.max("last_update_date").alias("last_update_date"), F.max("update_dt").alias("update_dt")).withColumn("price_status", F.lit("Final"))


def allocated(amount: Column, quantity: Column, base: Column, divide_first: bool = False) -> Column:
    """``amount * quantity / base`` as DECIMAL(28,10); a null or zero base counts as 1.

    Decimal products wider than 38 digits lose fraction digits, so the parts are narrowed to 18
    digits before: the product keeps its four or five decimals and the quotient six.
    """
    amount, quantity = F.coalesce(amount, F.lit(0)).cast("decimal(18,2)"), F.coalesce(quantity, F.lit(0)).cast("decimal(18,3)")
    base = F.when(base.isNull() | (base == 0), 1).otherwise(base).cast("decimal(18,3)")
    value = amount * (quantity / base).cast("decimal(28,10)") if divide_first else amount * quantity / base
    return value.cast("decimal(28,10)")


def settlement(sources: dict[str, DataFrame], year: int | None = None, changed_since: str | None = None,
               original: bool = False, load_stamps: bool = True) -> DataFrame:
    """One row per contract line and position line.

    ``year`` loads the positions that start in it (a key range, so the scan can skip files);
    ``changed_since`` loads what changed on or after the date.  ``original`` is the older form
    without entity and organisation, with a fixed load status and division before multiplication.

    Other contract types never settle and are left out at once.  The positions and the transactions of the
    wanted contract lines are stored, because the choice of lines and several sums read them.
    """
    settles = F.col("contract_type").isin(*SETTLED)
    inv, mtm = sources["inv"].filter(settles), sources["mtm"].filter(settles).filter(
        (F.col("mtm_type") == "Realized") & (F.col("bkr_txn_type") == "COMMODITY") & (F.col("currency_uom_contract") == "USD"))
    if year is not None:
        mtm = mtm.filter(F.col("position_start_dt_id").between(year * 10000 + 101, year * 10000 + 1231))
    mtm = stage(mtm.withColumnsRenamed({"update_dt": "mtm_update_dt"}).drop("mtm_type", "bkr_txn_type", "position_start_dt_id"), "settlement-positions")
    line = ["contract_number", "contract_line_number", "contract_type"]
    wanted = mtm.select(*line)
    if changed_since is not None:
        # a contract line is loaded if one of its transactions or positions has changed
        since = F.lit(changed_since).cast("date")
        wanted = inv.filter(F.col("update_dt") >= since).select(*line).unionByName(mtm.filter(F.col("mtm_update_dt") >= since).select(*line))
    # versions are kept per contract line and release, so whole groups stay or go
    inv = settled_quantities({**sources, "inv": stage(inv.join(wanted.distinct(), line, "left_semi"), "settlement-lines")})
    product = sources["product"].select(F.col("surrogate_key2").alias("product_id1"), "product_type", "prod_name", "ebs_item")
    keys = ["mtm_guid", "contract_number", "contract_line_number", "contract_type"]
    joined = inv.join(mtm, keys).join(product, "product_id1")
    if changed_since is not None:
        joined = joined.filter(F.greatest("update_dt", "mtm_update_dt") >= F.lit(changed_since).cast("date"))
    if not original:
        entity = sources["entity"].select(F.col("surrogate_key2").alias("mele_id"), "mele_code", "mele_name")
        organisation = sources["organisation"].select(F.col("surrogate_key2").alias("inventory_org_id"), "org_code", "org_name")
        joined = joined.join(entity, "mele_id", "left").join(organisation, "inventory_org_id", "left")

    ct = F.col("contract_type")
    shipped, received = F.max("actual_shipment_dt_id"), F.max("received_dt_id")
    change = F.greatest(F.max("last_update_date"), F.max("mtm_update_dt"))
    aggs = [
        F.max("product_type").alias("product_type"), F.max("prod_name").alias("product_name"), F.max("ebs_item").alias("ebs_item"),
        F.nvl(F.when(ct == "SALE", shipped).when(ct == "PURCHASE", received).otherwise(0), F.lit(0)).alias("actualization_dt_id"),
        F.nvl(F.sum("actual_quantity_32e"), F.lit(0)).cast("decimal(18,10)").alias("total_quantity_32e"),
        F.nvl(F.max("curr_contract_price_usd_32e"), F.lit(0)).alias("total_contract_price_usd_32e"),
        allocated(F.sum("exp_settlement_amt_contract"), F.sum("actual_quantity_32e"), F.sum("curr_quantity_32e"), original).alias("total_settlement_amt_32e"),
        F.nvl(F.sum("actual_quantity"), F.lit(0)).cast("decimal(18,10)").alias("total_quantity_contract_uom"),
        F.nvl(F.max("curr_contract_price_contract"), F.lit(0)).alias("total_contract_price_contract_uom"),
        allocated(F.sum("exp_settlement_amt_contract"), F.sum("actual_quantity"), F.sum("curr_quantity_contract"), original).alias("total_settlement_amt_contract_uom"),
        F.max("currency_uom_contract").alias("contract_currency"), F.max("volume_uom_contract").alias("contract_uom"),
        F.max(F.nvl("accounting_dt_id", F.lit(0))).alias("accounting_dt_id"), F.max("last_update_date").alias("last_update_date"),
        F.max("invoiced_status").alias("invoiced_status"), F.max("inventory_org_id").alias("inventory_org_id"), F.max("product_id").alias("product_id"),
        F.max("mele_id").alias("mele_id"), F.max("legal_entity_id").alias("legal_entity_id"), change.alias("change_date"),
        F.nvl(F.date_format(change, "yyyyMMdd").cast("int"), F.lit(0)).alias("change_dt_id"),
        F.max("price_status").alias("price_status"),
    ]
    if not original:
        aggs += [F.max("mele_code").alias("mele_code"), F.max("mele_name").alias("mele_name"),
                 F.max("org_code").alias("inv_org_code"), F.max("org_name").alias("inv_org_name")]
    out = joined.groupBy(*CONTRACT, "contract_line_id").agg(*aggs)
    # null in any part makes the whole key null, hence no concat_ws
    alternate = F.concat(ct, F.lit(SEP), F.col("contract_number"), F.lit(SEP), F.col("contract_line_number"), F.lit(SEP), F.col("release_number"))
    out = out.withColumns({
        "alternate_key": alternate, "natural_key": F.concat(alternate, F.lit(SEP), F.col("change_dt_id")),
        "invoice_unit_price": F.lit(None).cast("double"), "accounted_flg": F.lit(None).cast("string")})
    if original:
        out = out.withColumn("blackline_status", F.lit("HIST LOAD"))
    if load_stamps:
        out = out.withColumns({"update_dt": F.current_timestamp(), "insert_dt": F.current_timestamp()})
    return out


def high_water_mark(target: DataFrame) -> DataFrame:
    """One row: the latest change date already loaded (null before the first load); the next load starts there."""
    return target.agg(F.max("change_date").cast("string").alias("loaded_until"))
