"""Totals of a receipt: keyword-first routing of amounts, then one aggregation per receipt.

A line's numbers have one bucket and priority, so each line gives its largest value of a bucket, and its item sum,
and the totals are one aggregation on receipt_id that combines before its exchange. Numbers in text
are found once for each use. Defined results: a null text has no numbers; a null class is OTHER; a null y_min is 0;
receipts without numbers get zeros; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from struklake.functions import keywords as k
from struklake.functions import text as t
from struklake.functions.amounts import band_numbers, integer_digits, item_numbers, total_numbers
from struklake.sources.receipts import complete

# Plausible amounts, rates and ratios.
ITEM_RANGE = (100.0, 10_000_000.0)
TOTAL_LIMIT = 100_000_000.0
BAND_RANGE = (1_000.0, 10_000_000.0)
BAND_TOP = 0.7
RATE_LIMIT = 50.0
TAX_SHARE, TAX_LIMIT = 0.3, 100_000.0
SUBTOTAL_RATIO = (0.5, 2.5)
ITEMS_RATIO = (0.3, 3.0)
BAND_RATIO = (0.5, 3.0)
LONG_DIGITS = 7

TOTALS = ("grand_total", "subtotal", "discount", "tax", "service_charge", "cash", "change")


def final_class(text: Column, label: Column) -> Column:
    """Lines with a totals keyword become TOTAL_PAYMENT, unless they name staff; others without a
    class become OTHER."""
    total = (k.has_term(text, k.TOTAL_TERMS) | k.has_word(text, k.TOTAL_WORDS)) & ~k.has_word(text, k.STAFF_WORDS)
    return F.when(total, "TOTAL_PAYMENT").otherwise(F.coalesce(label, F.lit("OTHER")))


def relabel(lines: DataFrame) -> DataFrame:
    return lines.withColumn("predicted_class", final_class(F.col("text"), F.col("predicted_class")))


def line_bucket(text: Column, label: Column) -> Column:
    """(bucket, priority, rate) of a line's numbers; rate: small numbers are percentages. Every term holds a letter, so lines
    without one, as prices are, go by their label, and others are held against each list once."""
    flags = F.struct(*[k.has_term(text, terms).alias(name) for name, terms in (
        ("sub", k.SUBTOTAL_TERMS), ("grand", k.GRAND_TERMS), ("tax", k.TAX_TERMS),
        ("disc", k.DISCOUNT_TERMS), ("service", k.SERVICE_TERMS), ("cash", k.CASH_TERMS),
        ("change", k.CHANGE_TERMS), ("phrase", k.GRAND_PHRASES))])
    percent = F.contains(text, F.lit("%")) | F.contains(F.lower(text), F.lit("persen"))

    def to(bucket: str, priority: Column | int = 0, rate: Column | bool = False) -> Column:
        wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            F.lit(bucket).alias("bucket"), wrap(priority).alias("priority"), wrap(rate).alias("rate"))

    def by_terms(flag: Column) -> Column:
        return (
            F.when(flag["sub"] & ~flag["phrase"], to("subtotal"))
            .when(flag["tax"] & ~(flag["sub"] | flag["grand"] | flag["disc"]), to("tax", 0, percent))
            .when(flag["disc"] & ~(flag["sub"] | flag["grand"] | flag["tax"]), to("discount"))
            .when(flag["service"] & ~(flag["sub"] | flag["grand"] | flag["tax"] | flag["disc"]), to("service_charge"))
            .when(flag["grand"], to("grand", F.when(flag["phrase"], 10).otherwise(5)))
            .when(flag["change"], to("change"))
            .when(flag["cash"], to("cash"))
        )

    by_label = (
        F.when(label == "SUBTOTAL", to("subtotal"))
        .when(label == "TAX", to("tax", 0, percent))
        .when(label == "DISCOUNT", to("discount"))
        .when(label == "SERVICE_CHARGE", to("service_charge"))
        .when(label == "GRAND_TOTAL", to("grand", 3))
        .when(label == "CASH_PAYMENT", to("cash"))
    )
    return F.coalesce(F.when(k.has_letter(text), t.once(flags, by_terms)), by_label)


def line_amounts() -> Column:
    """What a relabelled line adds to its receipt."""
    return amounts_of(F.col("text"), F.col("predicted_class"), F.col("y_min"))


def amounts_of(text: Column, label: Column, y_min: Column) -> Column:
    """(to: (bucket, priority, values), prices, band) of a line with its final class."""
    text = F.coalesce(text, F.lit(""))
    skipped = label.isin(*k.NO_TOTAL_CLASSES) | (k.has_letter(text) & k.has_term(text, k.NO_TOTAL_TERMS))
    in_band = (F.coalesce(y_min, F.lit(0.0)) >= BAND_TOP) & ~k.has_term(text, k.BAND_TERMS)
    within = lambda values, low, high: F.filter(values, lambda v: v.between(low, high))
    values = F.when(~skipped, t.once(line_bucket(text, label), lambda to: F.when(to.isNotNull(), F.struct(
        to["bucket"].alias("bucket"), to["priority"].alias("priority"),
        F.filter(total_numbers(text), lambda v: (v > 0) & (v <= TOTAL_LIMIT) & ~(to["rate"] & (v < RATE_LIMIT))).alias("values")))))
    prices = F.when(label == "ITEM_PRICE/QTY", within(item_numbers(text), *ITEM_RANGE))
    return F.struct(
        values.alias("to"), prices.alias("prices"),
        F.when(in_band, F.array_max(within(band_numbers(text), *BAND_RANGE))).alias("band"),
    )


def total_aggregates() -> list[Column]:
    """The largest of each bucket, item sum and count, grand candidates in the order of priority and
    value, of lines with their `line_amounts` as `a`."""
    bucket, values = F.col("a.to.bucket"), F.col("a.to.values")
    largest = lambda b: F.max(F.when(bucket == b, F.array_max(values)))
    candidates = F.flatten(F.collect_list(F.when(bucket == "grand", F.transform(values, lambda v: F.struct(
        F.col("a.to.priority").alias("priority"), v.alias("value"))))))
    item_sum = F.aggregate(F.coalesce("a.prices", F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + v)
    return [
        *[F.coalesce(largest(b), F.lit(0.0)).alias(b) for b in ("subtotal", "discount", "service_charge", "cash", "change")],
        largest("tax").alias("tax_found"), F.sum(item_sum).alias("items_sum"),
        F.sum(F.size(F.coalesce("a.prices", F.array().cast("array<double>")))).alias("items_n"), F.max("a.band").alias("band_max"),
        F.transform(F.sort_array(candidates, asc=False), lambda c: c["value"]).alias("grand"),
    ]


def nested_totals(receipts: DataFrame, fallbacks: bool = True) -> DataFrame:
    """`receipt_totals` of receipts that hold their lines in an array, as a projection of each row: it keeps no state, so it
    runs on a stream as it stands."""
    def amounts(line: Column) -> Column:
        return t.once(F.struct(line.alias("l"), final_class(line["text"], line["predicted_class"]).alias("c")), lambda x: amounts_of(
            x["l"]["text"], x["c"], x["l"]["y_min"]))

    to = F.filter(F.transform("a", lambda x: x["to"]), lambda x: x.isNotNull())
    of = lambda b: F.flatten(F.transform(F.filter(to, lambda x: x["bucket"] == b), lambda x: x["values"]))
    prices = F.flatten(F.filter(F.transform("a", lambda x: x["prices"]), lambda p: p.isNotNull()))
    grand = F.flatten(F.transform(F.filter(to, lambda x: x["bucket"] == "grand"), lambda x: F.transform(
        x["values"], lambda v: F.struct(x["priority"].alias("priority"), v.alias("value")))))
    sums = receipts.withColumn("a", F.transform(F.coalesce("lines", F.array().cast(receipts.schema["lines"].dataType)), amounts)).select(
        "receipt_id",
        *[F.coalesce(F.array_max(of(b)), F.lit(0.0)).alias(b) for b in ("subtotal", "discount", "service_charge", "cash", "change")],
        F.array_max(of("tax")).alias("tax_found"), F.aggregate(prices, F.lit(0.0), lambda s, v: s + v).alias("items_sum"),
        F.size(prices).alias("items_n"), F.array_max(F.transform("a", lambda x: x["band"])).alias("band_max"),
        F.transform(F.sort_array(grand, asc=False), lambda c: c["value"]).alias("grand"))
    return with_totals(sums, fallbacks).select("receipt_id", *TOTALS)


def checked_tax(sums: DataFrame) -> DataFrame:
    """The largest tax if it is a plausible share of the subtotal."""
    within = F.when(F.col("subtotal") > 0, F.col("tax_found") <= F.col("subtotal") * TAX_SHARE).otherwise(
        F.col("tax_found") < TAX_LIMIT)
    return sums.withColumn("tax", F.coalesce(F.when(within, F.col("tax_found")), F.lit(0.0)))


def pick_grand() -> Column:
    """The first candidate if it is plausible, else the first other one that fits the subtotal."""
    best, rest = F.get("grand", F.lit(0)), F.slice("grand", 2, F.greatest(F.size("grand"), F.lit(1)))
    sub, items = F.col("subtotal"), F.col("items_sum")
    bad_sub = (sub > 0) & ~best.between(sub * SUBTOTAL_RATIO[0], sub * SUBTOTAL_RATIO[1])
    bad_items = (F.col("items_n") > 0) & ~best.between(items * ITEMS_RATIO[0], items * ITEMS_RATIO[1])
    digits = integer_digits(best)
    bad_length = (digits >= LONG_DIGITS) & F.exists(rest, lambda v: integer_digits(v) < digits)
    fits = F.filter(rest, lambda v: (sub <= 0) | v.between(sub * SUBTOTAL_RATIO[0], sub * SUBTOTAL_RATIO[1]))
    return F.coalesce(F.when(~(bad_sub | bad_items | bad_length), best).otherwise(F.get(fits, F.lit(0))), F.lit(0.0))


def with_fallbacks(gathered: DataFrame) -> DataFrame:
    """While the grand total is 0: subtotal and additions, item sum and additions, cash less
    change, the largest number of the bottom band."""
    grand, items = F.col("grand_total"), F.col("items_sum")
    extra = F.col("tax") + F.col("service_charge") - F.col("discount")
    by_sub, by_items = F.col("subtotal") + extra, items + extra
    use_items = (grand == 0) & (F.col("subtotal") == 0) & (F.col("items_n") > 0)
    ratio = F.col("band_max") / F.greatest(items, F.lit(1.0))
    plausible = (F.col("items_n") == 0) | ratio.between(*BAND_RATIO)
    return (
        gathered
        .withColumn("grand_total", F.when((grand == 0) & (F.col("subtotal") > 0) & (by_sub > 0), by_sub).otherwise(grand))
        .withColumns({
            "grand_total": F.when(use_items & (by_items > 0), by_items).otherwise(grand),
            "subtotal": F.when(use_items, items).otherwise(F.col("subtotal")),
        })
        .withColumn("grand_total", F.when((grand == 0) & (F.col("cash") > 0), F.col("cash") - F.col("change")).otherwise(grand))
        .withColumn("grand_total", F.when(
            (grand == 0) & F.col("band_max").isNotNull() & plausible, F.col("band_max")).otherwise(grand))
    )


def receipt_totals(lines: DataFrame, fallbacks: bool = True) -> DataFrame:
    """One row per receipt with the seven totals."""
    sums = relabel(complete(lines)).select("receipt_id", line_amounts().alias("a")).groupBy("receipt_id").agg(*total_aggregates())
    return with_totals(sums, fallbacks).select("receipt_id", *TOTALS)


def with_totals(sums: DataFrame, fallbacks: bool = True) -> DataFrame:
    """The seven totals from the columns of `total_aggregates`."""
    gathered = checked_tax(sums).withColumn("grand_total", pick_grand())
    return with_fallbacks(gathered) if fallbacks else gathered
