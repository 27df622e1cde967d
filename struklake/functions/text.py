"""Repair and cleaning of OCR text, as column expressions over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole words that OCR gets wrong, and their repair.
WORD_FIXES = {
    "T0TAL": "TOTAL", "TOTA1": "TOTAL", "T0TA1": "TOTAL",
    "TUNA1": "TUNAI", "KEMBA1I": "KEMBALI", "KEMBAL1": "KEMBALI",
    "SUBT0TAL": "SUBTOTAL", "SUBTO1AL": "SUBTOTAL",
    "PAJA<": "PAJAK", "DISK0N": "DISKON", "DISC0UNT": "DISCOUNT",
    "CA5H": "CASH", "CHANG3": "CHANGE", "DAT3": "DATE",
    "INV0ICE": "INVOICE", "INVO1CE": "INVOICE",
    "RECE1PT": "RECEIPT", "RECE!PT": "RECEIPT",
    "Q1Y": "QTY", "QUANT1TY": "QUANTITY",
    "PR1CE": "PRICE", "PUCE": "PRICE",
    "AM0UNT": "AMOUNT", "AMO1NT": "AMOUNT",
    "DESCR1PTION": "DESCRIPTION", "DESCRIPT10N": "DESCRIPTION",
    "CASH1ER": "CASHIER", "TE1P": "TELP", "TE1": "TEL",
    "EMA1L": "EMAIL", "NPW?": "NPWP",
}

# Characters read as digits inside numbers.
DIGIT_FIXES = ("OoIlSZB", "0011528")

# Runs in which they are; and amounts after a currency.
DIGIT_RUNS = (r"\d+[OoIlSZB\d.,]+", r"[OoIlSZB\d.,]+\d+", r"Rp\s*[OoIlSZB\d.,]+")
RUPIAH_AMOUNT, DOLLAR_AMOUNT = r"Rp\s*([OoIlSZB\d.,]+)", r"\$\s*([OoIlSZB\d.,]+)"

# The dictionary of the cleaners.
CORRECTIONS = {
    "k0ta": "kota", "c0": "co", "t0k0": "toko", "c1rcle": "circle",
    "c1ty": "city", "ma11": "mall", "p1aza": "plaza",
    "tota1": "total", "t0tal": "total", "tange1": "tanggal",
    "a1amat": "alamat", "te1p": "telp", "n0": "no", "n0.": "no.",
    "ca5h": "cash", "ca5hier": "cashier", "cust0mer": "customer",
    "rece1pt": "receipt", "inv0ice": "invoice", "b1ll": "bill",
    "qfy": "qty", "q7y": "qty", "puce": "price", "pr1ce": "price",
    "amoynt": "amount", "am0unt": "amount", "addres": "address",
    "subt0tal": "subtotal", "disc0unt": "discount", "diskon": "discount",
    "kemba1i": "kembali", "tuna1": "tunai", "paja": "pajak",
    "kemba1ian": "kembalian", "jumlah": "jumlah", "jum1ah": "jumlah",
    "bayar": "bayar", "bay4r": "bayar", "terima": "terima", "kasih": "kasih",
}

# Digits read as letters in store names, and letters as digits in numbers.
STORE_LETTERS = ("015834", "OISBEA")
NUMBER_DIGITS = ("OoIlSsBZz", "001155822")


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces and stripped."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def n_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def n_digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}"))


def n_uppers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}"))


def n_spaces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\s"))


def in_matches(text: Column, pattern: str, change, group: int = 0) -> Column:
    """`text` with every match of `pattern` replaced by change(match, or its group)."""
    def replaced(s: Column) -> Column:
        gaps = F.split(s, pattern, -1)
        found = F.regexp_extract_all(s, F.lit(pattern), F.lit(group))
        return F.when(F.rlike(s, F.lit(pattern)), F.concat(
            F.array_join(F.zip_with(
                F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, match: F.concat(gap, change(match))
            ), ""), F.element_at(gaps, -1),
        )).otherwise(s)

    return once(text, replaced)


def once(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it: without this,
    nested expressions grow with the power of their depth."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _boundary_safe(word: str) -> str:
    return r"\b" + re.escape(word) + r"\b"


def fix_words(text: Column) -> Column:
    """Whole-word repairs, whatever the case; the repair is always upper case.

    Every wrong word but one holds a digit or sign beside a letter, which a cheap test finds."""
    def repaired(s: Column) -> Column:
        for wrong, right in WORD_FIXES.items():
            s = F.regexp_replace(s, "(?iU)" + _boundary_safe(wrong), right)
        return s

    suspect = F.rlike(text, F.lit(r"[A-Za-z][0-9<!?]|[0-9][A-Za-z]|(?i:puce)"))
    return F.when(suspect, repaired(text)).otherwise(text)


def fix_numbers(text: Column) -> Column:
    """Letters inside digit runs become the digits they look like.

    A run that changes has such a letter beside a digit or separator, or after Rp."""
    def repaired(s: Column) -> Column:
        for pattern in DIGIT_RUNS:
            s = in_matches(s, "(?U)" + pattern, lambda m: F.translate(m, *DIGIT_FIXES))
        return s

    suspect = r"(?U)[OoIlSZB][\d.,]|[\d.,][OoIlSZB]|Rp\s*[OoIlSZB]"
    return once(text, lambda t: F.when(F.rlike(t, F.lit(suspect)), repaired(t)).otherwise(t))


def fix_currency(text: Column) -> Column:
    """`Rp` and `$` amounts: one space after Rp, none after $, digits repaired."""
    def repaired(s: Column) -> Column:
        s = in_matches(s, "(?U)" + RUPIAH_AMOUNT, lambda m: F.concat(F.lit("Rp "), fix_numbers(m)), 1)
        return in_matches(s, "(?U)" + DOLLAR_AMOUNT, lambda m: F.concat(F.lit("$"), fix_numbers(m)), 1)

    return once(text, lambda t: F.when(F.rlike(t, F.lit(r"Rp|\$")), repaired(t)).otherwise(t))


def post_process(text: Column) -> Column:
    """All repairs of recognised text, in order. Dates need none: a date is digits already."""
    return squeeze(fix_currency(fix_numbers(fix_words(text))))


def restore_case(word: Column, fix: Column) -> Column:
    """The correction in the word's case: all upper, first letter upper, or as it is."""
    is_upper = (F.upper(word) == word) & F.rlike(word, F.lit(r"\p{L}"))
    return (
        F.when(is_upper, F.upper(fix))
        .when(F.rlike(F.substring(word, 1, 1), F.lit(r"\p{Lu}")), F.concat(F.upper(F.substring(fix, 1, 1)), F.substr(fix, F.lit(2))))
        .otherwise(fix)
    )


def correct_words(text: Column) -> Column:
    """Dictionary corrections of whole words, with the word's case restored."""
    table = F.create_map(*[F.lit(x) for pair in CORRECTIONS.items() for x in pair])

    def corrected(word: Column) -> Column:
        return F.coalesce(restore_case(word, F.try_element_at(table, F.lower(word))), word)

    return F.array_join(F.transform(F.split(squeeze(text), " "), corrected), " ")


def clean_store(text: Column) -> Column:
    """Digits inside mostly alphabetic words become letters."""
    def repaired(word: Column) -> Column:
        digits = n_digits(word)
        return F.when((digits > 0) & (n_letters(word) > digits), F.translate(word, *STORE_LETTERS)).otherwise(word)

    words = F.transform(F.split(squeeze(text), " "), repaired)
    return squeeze(correct_words(F.array_join(words, " ")))


def clean_address(text: Column) -> Column:
    """Abbreviations for number, street and telephone in their usual form."""
    text = strip(text)
    # The three abbreviations as OCR shows them, and their usual form.
    for pattern, usual in ((r"\bn0\.?\s*", "No. "), (r"\bj[l1]\.?\s*", "Jl. "), (r"\bte[l1]p\.?\s*", "Telp. ")):
        text = F.regexp_replace(text, "(?iU)" + pattern, usual)
    return squeeze(correct_words(text))


def clean_item(text: Column) -> Column:
    """Signs at both ends go."""
    return squeeze(correct_words(F.regexp_replace(strip(text), r"(?U)^[^\w\s]+|[^\w\s]+$", "")))


def clean_number(text: Column) -> Column:
    """Look-alike letters become digits; only digits and separators stay."""
    digits = F.translate(strip(text), *NUMBER_DIGITS)
    joined = F.regexp_replace(digits, r"(?U)(\d+),\.(\d+)", "$1.$2")
    return squeeze(correct_words(F.regexp_replace(joined, r"(?U)[^\d.,/\-]", "")))


def clean_general(text: Column) -> Column:
    """ASCII only."""
    return squeeze(correct_words(F.regexp_replace(strip(text), r"[^\x00-\x7F]+", "")))


def clean_date(text: Column) -> Column:
    """Times with dots or commas get colons; a leading Date or Time goes."""
    for pattern in (r"(\d{1,2})\.(\d{2})\.(\d{2})", r"(\d{1,2}),(\d{2}),(\d{2})"):
        text = F.regexp_replace(text, "(?U)" + pattern, "$1:$2:$3")
    for word in ("Date", "Time"):
        text = F.regexp_replace(text, rf"(?iU)^{word}\.?\s*", "")
    return strip(text)


def title(text: Column) -> Column:
    """Upper case after anything that is no letter, lower case after letters."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def is_fragment(text: Column) -> Column:
    """Empty, only punctuation, or at most four digits and separators: glued to its neighbour."""
    t = strip(text)
    return (
        (t == "") | F.rlike(t, F.lit(r"^[.,;:\- ]+$"))
        | ((F.char_length(t) <= 4) & F.rlike(t, F.lit(r"^[\p{Nd}.,]+$")))
    )
