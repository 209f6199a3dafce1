"""Flow CSV folders: discovery, header probing, tolerant reading, provenance."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import vocab
from flowsieve.session import durable
from flowsieve.sources.first_lines import list_files, read_first_lines

REPLACEMENT = "�"


def list_flow_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the flow CSVs below ``folder``, metadata files left out.

    Empty files are listed, too; this reads no content.
    """
    files = list_files(spark, folder, "*.csv")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.upper(name).contains("UNSW") | F.upper(name).contains("NB15")
    return files.where(wanted & ~name.isin(*vocab.SKIPPED_FILES)).distinct()


def probe_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(first_line, paths): the files of each distinct first line, whatever its length.

    Each file is read up to its first line break and closed.
    """
    first = read_first_lines(spark, paths)
    return first.groupBy("first_line").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def header_names(first_line: str) -> tuple[bool, list[str]]:
    """(has a header, column names) from the first line of a file, read as CSV."""
    fields = next(csv.reader([first_line]), [])
    cells = [c.strip().removeprefix("\u00ef\u00bb\u00bf").lstrip("\ufeff").strip('"').strip() for c in fields]
    if any("attack_cat" in c.lower() for c in cells):
        return True, [c.lower().replace(" ", "_") for c in cells]
    if len(cells) == len(vocab.RAW_FLOW_COLUMNS):
        return False, list(vocab.RAW_FLOW_COLUMNS)
    if len(cells) == len(vocab.RAW_FLOW_COLUMNS) - 2:
        return False, [c for c in vocab.RAW_FLOW_COLUMNS if c not in ("stime", "ltime")]
    return False, [f"col_{i}" for i in range(len(cells))]


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, -1) + 1
        out.append(n if not seen[n] else f"{n}__{seen[n]}")
    return out


def read_text_csv(
    spark: SparkSession, paths: list[str], names: list[str], header: bool, encoding: str = "UTF-8"
) -> DataFrame:
    """All columns as text with provenance; lines with too many fields are skipped.

    Short lines keep nulls at the end. One extra field catches overlong lines. ``paths``
    are names of files, not patterns.
    """
    paths = [re.sub(r"[\\{}\[\]*?]", r"\\\g<0>", p) for p in paths]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*_unique(names), "_overflow"]])
    rows = (
        spark.read.schema(schema)
        .option("header", str(header).lower())
        .option("encoding", encoding)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", "true")
        .csv(paths)
        .withColumns(
            {
                "source_file": F.col("_metadata.file_name"),
                "_path": F.col("_metadata.file_path"),
                "_block": F.col("_metadata.file_block_start"),
                "_order": F.monotonically_increasing_id(),
            }
        )
    )
    return rows.where(F.col("_overflow").isNull()).drop("_overflow")


def number_rows(rows: DataFrame) -> DataFrame:
    """Add ``source_row``: the 0-based row number within its file.

    Rows of one file block are read in order by one task, so a row's number is its
    offset in the block plus the rows of earlier blocks: two small aggregates, no
    sort. Only the skipped lines are not counted. The scan is stored first, since two
    scans of the same files may be cut into blocks differently.
    """
    rows = durable(rows, "csv-rows")
    # a block's first order value and size; skipped lines leave gaps, closed by rank
    blocks = rows.groupBy("_path", "_block").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_order").alias("_first"),
        F.max("_order").alias("_last"),
    )
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select(
        F.col("_path").alias("_p"), F.col("_block").alias("_b"), "_first",
        (F.col("_last") - F.col("_first") + 1 == F.col("_n")).alias("_dense"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    joined = rows.join(placed, (F.col("_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    dense = joined.where("_dense").withColumn("source_row", F.col("_before") + F.col("_order") - F.col("_first"))
    inside = Window.partitionBy("_path", "_block").orderBy("_order")
    gaps = joined.where("not _dense").withColumn(
        "source_row", F.col("_before") + F.row_number().over(inside) - 1
    )
    return dense.unionByName(gaps).drop("_p", "_b", "_first", "_dense", "_before", "_path", "_block", "_order")


def load_flow_csvs(
    spark: SparkSession, folder: str, files: DataFrame | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Every flow CSV of a folder as one text table; one scan per distinct header.

    ``files`` (path) names the files where their names do not follow the usual pattern.
    ``columns`` are those to go on with, all unless given: rows are stored to be numbered,
    and of a very wide file the other columns are not. Every line is read either way.
    """
    # the reader takes a list of paths, so file names, and nothing else of the files, reach the driver
    listed = list_flow_files(spark, folder) if files is None else files
    paths = [row["path"] for row in listed.select("path").collect()]
    if not paths:
        raise FileNotFoundError(f"no flow CSV in {folder}")
    groups: dict[tuple[bool, tuple[str, ...]], list[str]] = {}
    for row in probe_headers(spark, paths).collect():
        has_header, names = header_names(row["first_line"])
        groups.setdefault((has_header, tuple(names)), []).extend(row["paths"])
    parts = []
    for (has_header, names), paths in sorted(groups.items()):
        rows = read_text_csv(spark, paths, list(names), has_header, "UTF-8" if has_header else "ISO-8859-1")
        if columns is not None:
            rows = rows.select(*[F.col(f"`{c}`") for c in columns if c in rows.columns], "source_file", "_path", "_block", "_order")
        parts.append(number_rows(rows))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_with_fallback(spark: SparkSession, path: str, names: list[str], header: bool = True) -> DataFrame:
    """UTF-8, or Latin-1 when any value does not decode."""
    rows = read_text_csv(spark, [path], names, header)
    broken = F.lit(False)
    for n in _unique(names):
        broken = broken | F.coalesce(F.col(f"`{n}`").contains(REPLACEMENT), F.lit(False))
    if not rows.where(broken).limit(1).isEmpty():
        rows = read_text_csv(spark, [path], names, header, "ISO-8859-1")
    return number_rows(rows)


def cap_rows(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit)


def cap_rows_per_file(
    df: DataFrame, limit: int, file_col: str = "source_file", row_col: str = "source_row", dense: bool = False
) -> DataFrame:
    """The first rows of every file.

    Rows numbered by ``number_rows`` are ``dense`` from 0, which makes this a filter.
    Otherwise rows are ranked; the rank limit also applies before the shuffle.
    """
    if dense:
        return df.where(F.col(row_col) < limit)
    order = Window.partitionBy(file_col).orderBy(row_col)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")
