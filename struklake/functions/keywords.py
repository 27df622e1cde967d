"""Word lists of the extraction rules (fixed values) and matching helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that mark a line as part of the totals, whole words that do, and whole
# words that prevent it.
TOTAL_TERMS = ("total", "subtota", "amount", "rounding", "tunai", "kembali", "bayar")
TOTAL_WORDS = ("cash", "change")
STAFF_WORDS = ("cashier", "kasir", "server", "waiter", "operator")

# Classes and terms whose lines hold no totals.
NO_TOTAL_CLASSES = ("STORE", "ADDRESS_CONTACT", "DATE", "ITEM_DESC")
NO_TOTAL_TERMS = ("npwp", "tel", "fax", "phone", "call", "roc", "gst no", "trxid", "member")

# Terms of each part of the totals.
SUBTOTAL_TERMS = (
    "subtotal", "sub total", "sub-total", "jumlah", "sub ttl", "sub.total", "amount", "amt", "jml",
)
GRAND_TERMS = (
    "grand total", "total bayar", "total amount", "total pembayaran", "total akhir", "total belanja",
    "total tagihan", "nett total", "net total", "total hrg", "total harga", "ttl bayar", "ttl amount",
    "ttl pembayaran", "jumlah bayar", "jml bayar", "amount due", "balance due", "total due", "total",
    "ttl", "tota1",
)
TAX_TERMS = (
    "tax", "pajak", "ppn", "gst", "vat", "pb1", "sst", "add gst", "add tax", "gst/tax", "tax/gst",
    "cukai", "sales tax", "service tax", "govt tax",
)
DISCOUNT_TERMS = (
    "discount", "diskon", "potongan", "disc", "voucher", "promo", "member disc", "item disc",
    "cashback", "rebate", "kupon", "disct", "discnt", "dscnt", "pot.", "less", "saving", "hemat",
)
SERVICE_TERMS = (
    "service charge", "service", "charge", "biaya layanan", "biaya", "svc charge", "svc chg",
    "srv charge",
)
CASH_TERMS = (
    "cash", "tunai", "paid", "jumlah bayar", "bayar", "payment", "tender", "received", "terima",
)
CHANGE_TERMS = ("change", "kembali", "kembalian", "balance", "return")
GRAND_PHRASES = ("grand", "bayar", "akhir", "nett", "net", "due")

# Terms of lines in the bottom band whose numbers are no amounts.
BAND_TERMS = ("npwp", "tel", "phone", "member", "card", "cashier", "kasir")

# Terms of lines that are no items.
NO_ITEM_TERMS = (
    "item:", "qty:", "quantity:", "price:", "amount:", "total:", "subtotal:",
    "cashier", "kasir", "waiter", "waitress", "server", "staff", "operator",
    "customer", "pelanggan", "member", "membership", "card no",
    "table", "meja", "pax", "guest", "room",
    "receipt", "struk", "bill", "invoice", "transaction", "transaksi",
    "order", "pesanan", "ref", "reference",
    "tender", "payment", "pembayaran", "cash", "tunai", "card", "credit",
    "debit", "change", "kembali", "kembalian",
    "discount", "diskon", "potongan", "promo", "voucher", "coupon",
    "service charge", "tax", "pajak", "gst", "vat", "ppn",
    "total", "subtotal", "grand total", "amount", "jumlah",
    "point", "points", "reward", "saving", "hemat", "earned",
    "thank", "terima", "kasih", "welcome", "selamat", "datang",
    "please", "silakan", "come again", "visit",
    "reg", "register", "void", "cancel", "refund", "return",
    "open", "close", "shift", "balance", "saldo",
    "jl.", "jalan", "tel:", "telp", "phone", "fax", "email", "www.", ".com",
    "date", "tanggal", "tgl", "time", "jam",
    "sdn bhd", "pt.", "cv.",
    "http", "instagram", "facebook", "whatsapp",
)
NO_NAME_TERMS = ("tota", "subtota", "service", "printed")

# Tokens that are a currency or a unit and no item name.
CURRENCY_TOKENS = ("RM", "RP", "IDR", "SR", "$", "USD")
UNIT_TOKENS = ("PCS", "BTL", "BKS", "KG", "GR", "ML", "LTR", "DUS", "BOX", "SET", "PACK", "UNIT")


def alternation(terms: Iterable[str]) -> str:
    """One pattern for any of the terms; a term that contains another one adds nothing."""
    terms = list(terms)
    needed = [t for t in dict.fromkeys(terms) if not any(o != t and o in t for o in terms)]
    return "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-").replace("\\/", "/") for t in needed)


def has_term(text: Column, terms: Iterable[str]) -> Column:
    """Any of the terms as a substring, whatever the case."""
    return F.rlike(F.lower(text), F.lit(alternation(terms)))


def has_letter(text: Column) -> Column:
    """Any Latin letter, without which no term is found."""
    return F.rlike(text, F.lit("[A-Za-z]"))


def has_word(text: Column, words: Iterable[str]) -> Column:
    """Any of the words as a whole word, whatever the case."""
    return F.rlike(text, F.lit(rf"(?iU)\b({'|'.join(words)})\b"))
