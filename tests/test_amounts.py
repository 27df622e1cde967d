"""Amounts and roles of lines, each found once."""

from __future__ import annotations

from pyspark.sql import functions as F

from struklake.functions import amounts
from struklake.functions import keywords as k
from struklake.operators import items, totals


def test_matches_need_no_currency_step(spark):
    """Numbers in text read as parse_money reads them, without its search for currencies."""
    texts = ["", "Rp 1.000 R2", "1,234.50 $3,5", "12.345.678 x 2", "1O.OOO 5 , 00", "٣.٠٠٠ 7", "1.2.3,4,567"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for numbers, source, pattern in ((amounts.item_numbers, F.replace("text", F.lit(" "), F.lit("")), amounts.ITEM_NUMBER),
                                     (amounts.total_numbers, amounts.closed_gaps(F.col("text")), amounts.TOTAL_NUMBER)):
        slow = F.transform(amounts.all_matches(source, pattern), amounts.parse_money)
        assert all(r[0] == r[1] for r in df.select(numbers(F.col("text")), slow).collect())
    plan = df.select(amounts.item_numbers(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_every_term_holds_a_letter():
    """What lets lines without letters pass the lists by; k, s and i have forms outside A to Z, so others must be there."""
    lists = (k.SUBTOTAL_TERMS, k.GRAND_TERMS, k.TAX_TERMS, k.DISCOUNT_TERMS, k.SERVICE_TERMS, k.CASH_TERMS, k.CHANGE_TERMS, k.GRAND_PHRASES,
             k.NO_TOTAL_TERMS)
    assert all(set(term) & set("abcdefghjlmnopqrtuvwxyz") for terms in lists for term in terms)


def test_lists_are_searched_once(spark):
    """Each list of terms stands once in the plan of a line's bucket, and a role's text is stripped once."""
    df = spark.createDataFrame([("PPN 10% 5", "TAX", 0.5, 0.8, 0.5, 0.1)], "text string, predicted_class string, y_min double, x_min double, y_max double, height double")
    plan = df.select(totals.line_bucket(F.col("text"), F.col("predicted_class")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(k.alternation(k.TAX_TERMS)) == 1
    plan = df.select(items.item_role().alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
