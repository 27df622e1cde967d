"""Table-driven cases of the column functions, one for each rule that is easy to get wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from struklake.functions import amounts, dates, features, text


def values(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    "money": (amounts.parse_money, {
        "10.000": 10000.0, "10,00": 10.0, "1.699.400": 1699400.0, "1.000,00": 1000.0, "1,000,00": 0.0,
        "1.5": 1.5, "1.2.3": 0.0, "": 0.0, "Rp 5.000": 5000.0, "RM12,50": 12.5, "abc": 0.0, "1,234": 1234.0,
        "10.00": 10.0, "12.3456.789": 123456789.0, "-": 0.0}),
    "item_numbers": (amounts.item_numbers, {"2 15000": [215000.0], "2 x 5.000": [2.0, 5000.0], "": [], "abc": []}),
    "total_numbers": (amounts.total_numbers, {
        "1,234.56": [1234.0, 56.0], "1234.567": [1234.56, 7.0], "10.000,00": [10000.0, 0.0],
        "T0TAL 5 .000": [0.0, 5000.0], "TOTAL 5. 000": [0.0, 5000.0]}),
    "title": (text.title, {"o'brien 7eleven": "O'Brien 7Eleven", "ÉCOLE d'été": "École D'Été", "": ""}),
    "address": (text.clean_address, {"jln x": "Jl. n x", "jl. a n0 5": "Jl. a No. 5", "te1p 1": "Telp. 1"}),
    "fix_words": (text.fix_words, {
        "PAJA< x": "PAJA< x", "PAJA<x": "PAJAKx", "t0tal": "TOTAL", "xt0tal": "xt0tal", "T0TAL tuna1": "TOTAL TUNAI"}),
    "fix_numbers": (text.fix_numbers, {"100Bo x": "10080 x", "1O.OOO": "10.000", "Soto": "Soto", "Rp lO": "Rp 10"}),
    "fix_currency": (text.fix_currency, {"Rp1O.OOO": "Rp 10.000", "$ 1O": "$10", "rp1O": "rp1O"}),
    "post_process": (text.post_process, {"  T0TAL   1O.OOO ": "TOTAL 10.000", "": ""}),
    "store": (text.clean_store, {"T0KO 7eleven": "TOKO 7eleven", "t0k0 x": "toko x", "  a  b ": "a b"}),
    "item": (text.clean_item, {"*éclair*": "éclair", "--x": "x", "a-b": "a-b"}),
    "number": (text.clean_number, {"1O,.5o": "10.50", "Rp 5OO": "500"}),
    "general": (text.clean_general, {"caféx": "cafx", "am0unt": "amount", "AM0UNT": "AMOUNT", "Am0unt": "Amount"}),
    "clean_date": (text.clean_date, {"Date. 12.30.45": "12:30:45", "time 1,02,03": "1:02:03"}),
    "date": (dates.find_date, {
        "31/02/2024": "31/02/2024", "08/19/2024": "", "x 2024-1-5 y": "2024-1-5", "5 Mei 2023": "5 Mei 2023",
        "Jan 5, 2023 10:32 PM": "Jan 5, 2023 10:32 PM", "1 / 2 / 24": "", "1/ 2/ 24": "1/2/24", "12-Aug-2024": "12-Aug-2024",
        "": "", "10:30": ""}),
    "fragment": (text.is_fragment, {"": True, ", .": True, "000": True, "12.50": False, "a": False, "1234": True}),
    "date_flag": (features.has_date, {"1/2/24": True, "5 jan 24": True, "5 mei 2024": False}),
    "currency_flag": (features.has_currency, {"RM 5": True, "rp5": True, "€ 1": True, "5": False}),
    "quantity_flag": (features.has_quantity, {"2 x 500": True, "@ 5": True, "x": False}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    function, cases = CASES[name]
    assert dict(zip(cases, values(spark, function, list(cases)), strict=True)) == cases


def test_nulls_stay_defined(spark):
    df = spark.createDataFrame([(None,)], "x string")
    row = df.select(
        features.text_features(F.col("x")).alias("f"), features.char_codes(F.col("x")).alias("c"),
        text.post_process(F.col("x")).alias("p"), dates.find_date(F.col("x")).alias("d"),
    ).first()
    assert row["f"] == [0.0] * 10 and row["c"] == [0] * 100 and row["p"] is None and row["d"] == ""


def test_char_codes(spark):
    codes = values(spark, features.char_codes, ["aé€", "x" * 150])
    assert codes[0][:4] == [97, 127, 127, 0] and len(codes[1]) == 100
