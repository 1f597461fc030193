"""Ingest payloads: JSON lines {"datum": "...", "sales": {code: value}}.

Parsing keeps every record: valid ones go on, bad ones get a `reason` and go
to quarantine, so one bad record never stops a batch or a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = T.StructType([
    T.StructField("datum", T.StringType(), True),
    T.StructField("sales", T.MapType(T.StringType(), T.DoubleType()), True),
])

# --- fixed values: quarantine reasons, checked in this order -------------------
REASONS = ["malformed_json", "missing_datum", "bad_datum", "missing_sales"]
# -----------------------------------------------------------------------------


def parse_payloads(text: DataFrame, text_col: str = "value") -> DataFrame:
    """raw text -> (raw, datum DATE, sales MAP, reason)."""
    raw = F.col(text_col)
    p = F.from_json(raw, PAYLOAD, {"mode": "PERMISSIVE"})
    x = text.select(raw.alias("raw"), p.alias("p"))
    datum = F.try_to_date(F.col("p.datum"), "yyyy-MM-dd")
    sales = F.col("p.sales")
    reason = (
        F.when(F.get_json_object(F.col("raw"), "$").isNull(), "malformed_json")
        .when(F.col("p.datum").isNull(), "missing_datum")
        .when(datum.isNull(), "bad_datum")
        .when(sales.isNull(), "missing_sales")
    )
    return x.select("raw", datum.alias("datum"), sales.alias("sales"), reason.alias("reason"))


def unknown_codes(parsed: DataFrame, products: DataFrame) -> DataFrame:
    """(datum, code, value): the entries of usable records whose code is not in the product dimension
    (column `code`).  Such codes are no fault of the record; the explosion into facts ignores them."""
    return parsed.where(F.col("reason").isNull()).select("datum", F.explode("sales").alias("code", "value")) \
        .join(products.select("code"), "code", "left_anti").select("datum", "code", "value")


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine)."""
    return parsed.where(F.col("reason").isNull()), parsed.where(F.col("reason").isNotNull())


def explode_payloads(valid: DataFrame, products: list[str]) -> DataFrame:
    """One row per payload and product; a product missing from the payload
    counts as 0.  `products` is the (small) product code list."""
    arr = F.array(*[F.lit(p) for p in products])
    rows = F.transform(arr, lambda k: F.struct(
        k.alias("series"), F.coalesce(F.try_element_at(F.col("sales"), k), F.lit(0.0)).alias("value")))
    return valid.select("datum", F.explode(rows).alias("r")).select("r.series", "datum", "r.value")


def payload_total(valid: DataFrame, products: list[str]) -> DataFrame:
    """(datum, total): each payload's own total over the known products; missing ones are 0."""
    parts = F.transform(F.array(*[F.lit(p) for p in products]),
                        lambda k: F.coalesce(F.try_element_at(F.col("sales"), k), F.lit(0.0)))
    return valid.select("datum", F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v).alias("total"))


def explode_with_total(valid: DataFrame, products: list[str], total: str) -> DataFrame:
    """(series, datum, value): a payload's products and, as the series `total`, their sum, in one pass (for streams)."""
    values = F.transform(F.array(*[F.lit(p) for p in products]), lambda k: F.struct(
        k.alias("series"), F.coalesce(F.try_element_at(F.col("sales"), k), F.lit(0.0)).alias("value")))
    both = valid.select("datum", values.alias("r"))
    row = F.struct(F.lit(total).alias("series"), F.aggregate(F.col("r.value"), F.lit(0.0), lambda a, v: a + v).alias("value"))
    return both.select("datum", F.explode(F.concat("r", F.array(row))).alias("r")).select("r.series", "datum", "r.value")


def payloads_from_daily(daily: DataFrame) -> DataFrame:
    """Build one JSON payload per day from (series, datum, value) rows."""
    g = daily.groupBy("datum").agg(F.map_from_entries(F.collect_list(F.struct("series", "value"))).alias("sales"))
    return g.select(F.to_json(F.struct(F.date_format("datum", "yyyy-MM-dd").alias("datum"), "sales")).alias("value"))


def records_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
