"""Lines of the well measurements' CSV dump, as typed rows.

A record is a line, so that files are split anywhere between lines. Fields follow
RFC 4180: a quoted one may hold commas, and a doubled quote stands for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the dump, in order.
COLUMNS = (
    "_id", "site_code", "msmt_date", "wlm_rpe", "wlm_gse", "gwe", "gse_gwe", "wlm_qa_desc", "wlm_qa_detail", "wlm_mthd_desc", "wlm_acc_desc",
    "wlm_org_name", "coop_org_name", "monitoring_program", "basin_code", "county_name", "well_use", "source", "msmt_cmt",
)
#: Fields that a line must have; the comment behind them may be missing.
LEAST_FIELDS = 18
NUMBERS = ("wlm_rpe", "wlm_gse", "gwe", "gse_gwe")
#: A comma with an even number of quotes behind it is outside of quotes: for lines that hold MARK, at a cost that grows with the line's square.
_COMMA, MARK = ',(?=(?:[^"]*"[^"]*")*[^"]*$)', "\x01"


def _fields(line: Column) -> Column:
    """The raw fields of a line. It is cut at its quotes, commas outside of them become marks, and it is cut at these."""
    outside = F.transform(F.reverse(F.split(line, '"', -1)), lambda part, quotes_behind: F.when(quotes_behind % 2 == 0, F.replace(part, F.lit(","), F.lit(MARK))).otherwise(part))
    marked = F.split(F.array_join(F.reverse(outside), '"'), MARK, -1)
    return F.when(~line.contains('"'), F.split(line, ",", -1)).when(~line.contains(MARK), marked).otherwise(F.split(line, _COMMA, -1))


def _field(raw: Column) -> Column:
    """A field without its quotes and outer blanks; null if nothing is left."""
    inner = F.regexp_extract(raw, r'^[ \t]*"(.*)"[ \t]*$', 1)
    plain = F.when(~raw.contains('"'), raw).when(raw.rlike(r'^[ \t]*".*"[ \t]*$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.replace(raw, F.lit('"'), F.lit("")))
    return F.nullif(F.trim(plain), F.lit(""))


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The rows of CSV lines, numbers as decimals and the day as a date.

    Lines with too few fields, the header, and those without a site or a date give no
    row. What is no number, or no date, is null. A null or empty line gives no row.
    """
    ended = F.when(F.col(line).contains("\r"), F.regexp_replace(line, r"\r$", "")).otherwise(F.col(line))
    fields = lines.select(ended.alias("_l")).select(F.explode(F.array(_fields(F.col("_l")))).alias("_f"))  # what is exploded is made once a line, not again for each field and filter
    cut = fields.where(F.size("_f") >= LEAST_FIELDS)
    rows = cut.select(*[_field(F.get("_f", F.lit(i))).alias(c) for i, c in enumerate(COLUMNS)])
    rows = rows.where(F.col("site_code").isNotNull() & F.col("msmt_date").isNotNull() & (F.col("site_code") != "site_code"))
    typed = {c: F.col(c).try_cast("decimal(12,3)") for c in NUMBERS} | {"msmt_date": F.substring("msmt_date", 1, 10).try_cast("date")}
    return rows.withColumns(typed)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))
