"""Dataset cards: text to nested records by line grammars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions

# The line grammars of a card.
HEADER = r"^#\s*Dataset:\s*(\S+)\s*/\s*(\S+)\s*$"
PRODUCT = r"^Product:\s*(\S+)\s*[—-]+\s*([^.]+)\.?\s*(.*)$"
ROWS = r"^Rows:\s*(\d+);\s*months covered:\s*(\S+)\s+to\s+(\S+)"
SITE = r"([A-Z]{4})\s*\(([^,]+),\s*([^,]+),\s*domain\s+(D\d{2})\s*([^;]*);\s*([^)]*)\)"
COLUMN = r"^-\s*([^|]+)\|([^|]*)\|([^|]*)\|([^|]*)\|(.*)$"


def lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def _last(found: Column, pattern: str, group: int) -> Column:
    """A group of the last line that fits the grammar; empty if none does."""
    return F.coalesce(F.trim(F.regexp_extract(F.try_element_at(found, F.lit(-1)), pattern, group)), F.lit(""))


def sites(line: Column) -> Column:
    """All sites of one line as structs."""
    parts = [F.regexp_extract_all(line, F.lit(SITE), F.lit(i)) for i in range(1, 7)]
    names = ["code", "name", "state", "domain", "domain_name", "habitat"]
    places = F.sequence(F.lit(1), F.size(parts[0]))
    struct = lambda i: F.struct(*[F.trim(F.try_element_at(p, i)).alias(n) for p, n in zip(parts, names)])
    return F.when(F.size(parts[0]) > 0, F.transform(places, struct))


def parse(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the record of the card in ``text`` in column ``parsed``; null where there is no header.

    A line belongs to the first grammar it fits; unknown lines are ignored, the last line of a kind counts. Null and
    empty texts have no header.
    """
    rest = lines(F.col(text))
    fit = lambda pattern: F.filter(rest, lambda x: x.rlike(pattern))
    grammars = {"header": HEADER, "product": PRODUCT, "source": r"^Source:", "sites": r"^Sites:", "rows": ROWS, "column": COLUMN}
    found = {name: fit(pattern) for name, pattern in grammars.items()}
    unit = lambda x: F.trim(F.regexp_extract(x, COLUMN, 4))
    columns = F.transform(
        found["column"],
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, COLUMN, 1)).alias("name"),
            F.trim(F.regexp_extract(x, COLUMN, 2)).alias("description"),
            F.trim(F.regexp_extract(x, COLUMN, 3)).alias("dtype"),
            F.when(unit(x) == "-", "").otherwise(unit(x)).alias("unit"),
            F.trim(F.regexp_extract(x, COLUMN, 5)).alias("profile"),
        ),
    )
    record = F.struct(
        _last(found["header"], HEADER, 1).alias("product_code"),
        _last(found["header"], HEADER, 2).alias("table_name"),
        _last(found["product"], PRODUCT, 2).alias("title"),
        _last(found["product"], PRODUCT, 3).alias("description"),
        F.trim(F.regexp_replace(_last(found["source"], r"^(.*)$", 1), r"^Source:", "")).alias("source"),
        F.coalesce(sites(F.try_element_at(found["sites"], F.lit(-1))), F.array().cast("array<struct<code:string,name:string,state:string,domain:string,domain_name:string,habitat:string>>")).alias("sites"),
        F.coalesce(F.nullif(_last(found["rows"], ROWS, 1), F.lit("")).try_cast("long"), F.lit(0)).alias("n_rows"),
        _last(found["rows"], ROWS, 2).alias("months_from"),
        _last(found["rows"], ROWS, 3).alias("months_to"),
        columns.alias("columns"),
        F.sha2(F.col(text), 256).alias("sha256"),
    )
    return df.withColumn("parsed", F.when(F.size(found["header"]) > 0, record))


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """(file, parsed) of all card files under ``path``; a file without header is an error that names the file only."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    parsed = parse(files, "value")
    bad = F.raise_error(F.concat(F.lit("not a dataset card: "), F.col("file")))
    return parsed.select("file", F.when(F.col("parsed").isNotNull(), F.col("parsed")).otherwise(bad).alias("parsed"))


def cards_by_product(spark: SparkSession, path: str) -> DataFrame:
    """(product, cards): the card names of each product, both from the files' names."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1)
    rows = spark.read.text(path, wholetext=True).select(name.alias("card")).where("card <> ''").distinct()
    return rows.groupBy(text_functions.product_of(F.col("card")).alias("product")).agg(F.sort_array(F.collect_list("card")).alias("cards"))
