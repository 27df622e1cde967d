"""Receipts derived from the star schema: one per order that has line items.

The rules are in FIXTURES.md. Coordinates are multiples of 1/128, so sums and thresholds are exact
in every engine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from struklake.sources.scratch import new_path

#: Lines in a file of the fixture: about a megabyte.
FILE_LINES = 100_000

_built: dict[tuple[str, str], str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(value: Column) -> Column:
    """Whole amounts with dots between thousands."""
    return F.translate(F.format_number(value, 0), ",", ".")


def _line(index, text, label, yi, xi, present=None) -> Column:
    row = F.struct(
        F.lit(index).cast("int").alias("line_index"), text.alias("text"), label.alias("predicted_class"),
        F.lit(yi).cast("double").alias("yi"), F.lit(xi).cast("double").alias("xi"),
    )
    return row if present is None else F.when(present, row)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_id, line_index, text, predicted_class, x_min, x_max, y_min, y_max, height. Built once per
    application and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    try:
        return spark.read.parquet(_built[key])
    except (KeyError, AnalysisException):  # not built yet, or the folder was cleared
        path = new_path(spark)
        # files of so many lines that scans are dealt evenly, as the rules over lines cost far more than reading them
        build_lines(spark, sf_dir).write.option("maxRecordsPerFile", FILE_LINES).option("compression", "zstd").parquet(path)
        _built[key] = path
        return spark.read.parquet(path)


def build_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item_order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"
    )
    items = (
        read(spark, sf_dir, "lineitem")
        .withColumn("rn", F.row_number().over(item_order))
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("rid"), "rn", "p_name", F.floor("l_extendedprice").alias("price"))
    )
    rid = F.col("rid")
    step = F.when(rid % 7 == 0, 1).otherwise(4)
    item_y = F.lit(24) + step * F.col("rn")
    item_lines = items.select(rid, F.explode(F.array(
        _line(F.col("rn") * 2 + 2, F.col("p_name"), F.lit("ITEM_DESC"), item_y, 8),
        _line(F.col("rn") * 2 + 3, money(F.col("price")),
              F.when(rid % 36 == 0, "OTHER").otherwise("ITEM_PRICE/QTY"), item_y, 96),
    )).alias("line"))
    sub, day = F.col("sub"), F.col("o_orderdate")
    date = (
        F.when(rid % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(rid % 4 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(rid % 4 == 2, F.date_format(day, "d MMM yyyy"))
        .otherwise(F.concat(F.date_format(day, "dd-MMM-yyyy"), F.lit(" 10:32 PM")))
    )
    tax = F.when(rid % 8 == 0, F.floor(sub * 0.4)).otherwise(F.floor(sub * 0.1))
    label = F.lit
    headers = (
        read(spark, sf_dir, "orders")
        .join(items.groupBy("rid").agg(F.sum("price").alias("sub")), F.col("o_orderkey") == rid)
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    frame = headers.select(rid, F.explode(F.filter(F.array(
        _line(1, F.concat(F.lit("TOKO "), "n_name"), label("STORE"), 4, 32),
        _line(2, F.concat(F.lit("jl. "), "r_name", F.lit(" n0 "), F.col("n_nationkey").cast("string")),
              label("ADDRESS_CONTACT"), 8, 16),
        _line(3, date, F.when(rid % 5 == 0, "OTHER").otherwise("DATE"), 12, 16),
        _line(40, F.concat(F.when(rid % 3 == 0, "SUBT0TAL ").otherwise("SUBTOTAL "), money(sub)),
              label("SUBTOTAL"), 100, 8, rid % 12 != 0),
        _line(41, F.concat(F.when(rid % 8 == 0, "PPN 40% ").otherwise("PPN 10% "), money(tax)),
              label("TAX"), 104, 8, rid % 9 != 0),
        _line(42, F.concat(F.when(rid % 11 == 0, "GRAND TOTAL 3 ").otherwise("GRAND TOTAL "), money(sub)),
              label("GRAND_TOTAL"), 108, 8, rid % 6 != 0),
        _line(43, F.concat(F.lit("TUNAI "), money(sub * 2)), label("CASH_PAYMENT"), 112, 8, rid % 72 != 0),
        _line(44, F.concat(F.lit("KEMBALI "), money(sub)), label("OTHER"), 116, 8, rid % 72 != 0),
        _line(45, F.concat(F.lit("NILAI "), money(sub)), label("OTHER"), 120, 8, rid % 72 == 0),
    ), lambda x: x.isNotNull())).alias("line"))
    x, y = F.col("line.xi") / 128, F.col("line.yi") / 128
    return frame.unionByName(item_lines).select(
        rid.cast("long").alias("receipt_id"), "line.line_index", "line.text", "line.predicted_class",
        x.alias("x_min"), (x + F.char_length("line.text") / 128).alias("x_max"),
        y.alias("y_min"), (y + 2 / 128).alias("y_max"), F.lit(2 / 128).alias("height"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lines as OCR hits on an image of 1024 x 1024 pixels."""
    words = lines(spark, sf_dir).select(
        "receipt_id", "line_index", F.posexplode(F.split("text", " ")).alias("pos", "text"),
        (F.col("x_min") * 1024).alias("x"), (F.col("y_min") * 1024).alias("y"),
    )
    x0 = F.col("x") + 64 * F.col("pos")
    y0 = F.col("y") + 2 * (F.col("pos") % 2)
    x1, y1 = x0 + 60, y0 + 16
    return words.select(
        "receipt_id", (F.col("line_index") * 100 + F.col("pos")).cast("int").alias("token_id"), "text",
        F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)).alias("bbox"),
        F.lit(0.9).alias("confidence"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a scan; every 50th is no image."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.cast("long").alias("receipt_id"),
        F.when(key % 50 == 0, "application/pdf").otherwise("image/jpeg").alias("content_type"),
        F.lit(1024).alias("img_w"), F.lit(1024).alias("img_h"),
    )


#: Texts that the receipts above do not hold: currencies, decimal and English amounts, units, dates and
#: times as printers write them. SQL over the columns of `_PHRASE_PARTS`, the same in both engines.
PHRASES = (
    "'Rp' || m", "'RP ' || m", "'Rp  ' || replace(m, '0', 'O')", "'harga Rp.' || replace(p, '5', 'S') || ' pas'",
    "'Rp ' || m || ' Rp' || p", "'$ ' || e || '.' || c", "'TOTAL $' || p || ',' || c || ' $ 1O'", "'$O' || c", "'Rp'",
    "e", "m || ',' || c", "p || '.' || c", "'RM ' || e || '.' || c", "p || ',5'", "'1.' || p", "'.' || c", "m || ',' || e", "p || '.' || c || '56'",
    "'Date. ' || dmy || ' 10.32.15'", "'time 1.05.' || c", "'DATE' || iso || ' 10,32,15'", "'Tanggal ' || dmy || ' 9:05 PM'",
    "word", "'on ' || word || ' 23:59:01'", "idn", "'printed ' || iso || ' 10:32'", "'32/13/1994 ' || m", "'99-01-02'", "short",
    "'12 pcs @'", "'KG'", "'rm'", "p || ' box'", "c || ' x ' || m", "'@ ' || p || '.' || c", "'kopi susu ' || c", "'a'", "'N0. ' || c", "'[teh] manis!'", "'---'",
)


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_id and text: one of PHRASES for every order, with its price, key and day."""
    months = "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split()
    day, price = F.col("o_orderdate"), F.floor("o_totalprice").cast("long")
    parts = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("long").alias("receipt_id"), price.cast("string").alias("p"), money(price).alias("m"),
        F.format_number(price, 0).alias("e"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0").alias("c"),
        F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "dd/MM/yyyy").alias("dmy"),
        F.date_format(day, "MMMM d, yyyy").alias("word"), F.date_format(day, "d.MMM.yyyy").alias("short"),
        F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, months)), F.month(day)),
                 F.lit(" "), F.year(day).cast("string")).alias("idn"),
    )
    chosen = F.expr(f"element_at(array({', '.join(PHRASES)}), cast(receipt_id % {len(PHRASES)} as int) + 1)")
    return parts.select("receipt_id", chosen.alias("text"))


PHRASES_SQL = f"""
parts AS (
    SELECT o_orderkey::BIGINT AS receipt_id, floor(o_totalprice)::BIGINT::VARCHAR AS p,
           replace(format('{{:,}}', floor(o_totalprice)::BIGINT), ',', '.') AS m, format('{{:,}}', floor(o_totalprice)::BIGINT) AS e,
           lpad((o_orderkey % 100)::VARCHAR, 2, '0') AS c, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS dmy,
           strftime(o_orderdate, '%B %-d, %Y') AS word, strftime(o_orderdate, '%-d.%b.%Y') AS short,
           day(o_orderdate) || ' ' || ['Januari', 'Februari', 'Maret', 'April', 'Mei', 'Juni', 'Juli', 'Agustus', 'September', 'Oktober',
           'November', 'Desember'][month(o_orderdate)] || ' ' || year(o_orderdate) AS idn
    FROM orders),
phrases AS (SELECT receipt_id, [{', '.join(PHRASES)}][receipt_id % {len(PHRASES)} + 1] AS text FROM parts)"""

#: The same lines in DuckDB, as a WITH list that ends in `lines`.
LINES_SQL = """
items AS (
    SELECT l_orderkey AS rid, p_name, floor(l_extendedprice)::BIGINT AS price,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                              l_extendedprice, l_quantity, l_shipdate) AS rn
    FROM lineitem JOIN part ON l_partkey = p_partkey),
heads AS (
    SELECT o_orderkey AS rid, o_orderdate, n_name, n_nationkey, r_name, sub
    FROM orders JOIN (SELECT rid, sum(price)::BIGINT AS sub FROM items GROUP BY rid) ON rid = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
raw AS (
    SELECT rid, 1 AS line_index, 'TOKO ' || n_name AS text, 'STORE' AS predicted_class, 4 AS yi, 32 AS xi FROM heads
    UNION ALL SELECT rid, 2, 'jl. ' || r_name || ' n0 ' || n_nationkey, 'ADDRESS_CONTACT', 8, 16 FROM heads
    UNION ALL SELECT rid, 3, CASE rid % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y')
              ELSE strftime(o_orderdate, '%d-%b-%Y') || ' 10:32 PM' END,
              CASE WHEN rid % 5 = 0 THEN 'OTHER' ELSE 'DATE' END, 12, 16 FROM heads
    UNION ALL SELECT rid, 2 * rn + 2, p_name, 'ITEM_DESC', 24 + CASE WHEN rid % 7 = 0 THEN 1 ELSE 4 END * rn, 8 FROM items
    UNION ALL SELECT rid, 2 * rn + 3, replace(format('{:,}', price), ',', '.'),
              CASE WHEN rid % 36 = 0 THEN 'OTHER' ELSE 'ITEM_PRICE/QTY' END,
              24 + CASE WHEN rid % 7 = 0 THEN 1 ELSE 4 END * rn, 96 FROM items
    UNION ALL SELECT rid, 40, CASE WHEN rid % 3 = 0 THEN 'SUBT0TAL ' ELSE 'SUBTOTAL ' END || replace(format('{:,}', sub), ',', '.'),
              'SUBTOTAL', 100, 8 FROM heads WHERE rid % 12 <> 0
    UNION ALL SELECT rid, 41, CASE WHEN rid % 8 = 0 THEN 'PPN 40% ' || replace(format('{:,}', floor(sub * 0.4)::BIGINT), ',', '.')
              ELSE 'PPN 10% ' || replace(format('{:,}', floor(sub * 0.1)::BIGINT), ',', '.') END, 'TAX', 104, 8 FROM heads WHERE rid % 9 <> 0
    UNION ALL SELECT rid, 42, CASE WHEN rid % 11 = 0 THEN 'GRAND TOTAL 3 ' ELSE 'GRAND TOTAL ' END || replace(format('{:,}', sub), ',', '.'),
              'GRAND_TOTAL', 108, 8 FROM heads WHERE rid % 6 <> 0
    UNION ALL SELECT rid, 43, 'TUNAI ' || replace(format('{:,}', 2 * sub), ',', '.'), 'CASH_PAYMENT', 112, 8 FROM heads WHERE rid % 72 <> 0
    UNION ALL SELECT rid, 44, 'KEMBALI ' || replace(format('{:,}', sub), ',', '.'), 'OTHER', 116, 8 FROM heads WHERE rid % 72 <> 0
    UNION ALL SELECT rid, 45, 'NILAI ' || replace(format('{:,}', sub), ',', '.'), 'OTHER', 120, 8 FROM heads WHERE rid % 72 = 0),
lines AS (
    SELECT rid::BIGINT AS receipt_id, line_index::INTEGER AS line_index, text, predicted_class,
           xi / 128.0::DOUBLE AS x_min, xi / 128.0::DOUBLE + length(text) / 128.0::DOUBLE AS x_max,
           yi / 128.0::DOUBLE AS y_min, yi / 128.0::DOUBLE + 2 / 128.0::DOUBLE AS y_max, 2 / 128.0::DOUBLE AS height
    FROM raw)"""

TOKENS_SQL = LINES_SQL + """,
words AS (
    SELECT receipt_id, line_index, x_min * 1024 AS x, y_min * 1024 AS y, string_split(text, ' ') AS ws FROM lines),
tokens AS (
    SELECT receipt_id, (line_index * 100 + pos)::INTEGER AS token_id, ws[pos + 1] AS text,
           x + 64 * pos AS x0, x + 64 * pos + 60 AS x1, y + 2 * (pos % 2) AS y0, y + 2 * (pos % 2) + 16 AS y1,
           0.9::DOUBLE AS confidence
    FROM (SELECT *, unnest(range(len(ws))) AS pos FROM words))"""
