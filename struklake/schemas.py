"""Schemas of the canonical tables."""

from __future__ import annotations

#: Raw OCR hits, one row per token; coordinates in pixels.
TOKENS = "receipt_id long, token_id int, text string, bbox array<array<double>>, confidence double"

#: Scans and their image sizes.
MANIFEST = "receipt_id long, content_type string, img_w int, img_h int"

#: Text lines in reading order; coordinates from 0 to 1.
LINES = (
    "receipt_id long, line_index int, text string, confidence double, x_min double, x_max double, "
    "y_min double, y_max double, x_center double, y_center double, width double, height double, "
    "predicted_class string, class_confidence double"
)

#: Line labels by model index (fixed values, in the order of the model's outputs).
LINE_CLASSES = (
    "STORE", "ADDRESS_CONTACT", "DATE", "ITEM_DESC", "ITEM_PRICE/QTY", "SUBTOTAL",
    "TAX", "DISCOUNT", "SERVICE_CHARGE", "GRAND_TOTAL", "CASH_PAYMENT", "OTHER",
)

#: Expense categories by index (fixed values).
CATEGORIES = ("makanan", "belanja", "hiburan", "transportasi", "tagihan", "kesehatan", "lainnya")
