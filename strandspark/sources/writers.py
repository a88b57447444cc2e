"""Writers: tab-separated tables as text, sorted where the format asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.operators.counttable import round_columns


def _write(df: DataFrame, path: str, compressed: bool, header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=header, compression="gzip" if compressed else "none", quote="")


def write_count_table(table: DataFrame, path: str, compressed: bool = False) -> None:
    """Sequences in order, one column per round."""
    _write(table.select("seq", *(F.col(c).cast("bigint") for c in round_columns(table))).orderBy("seq"), path, compressed)


#: Formats of the numbers in files of scores.
FORMATS = {"affinity": "%.8f", "modes": "%.5e", "counts": "%.10e"}


def formatted(df: DataFrame, form: str, columns: list[str] | None = None) -> DataFrame:
    """Number columns (and arrays of numbers, joined by commas) as text in this format."""
    kinds = dict(df.dtypes)
    one = lambda c: F.format_string(form, c)
    names = columns or [c for c, t in kinds.items() if t in ("double", "float") or t == "array<double>"]
    texts = {c: F.array_join(F.transform(c, one), ",") if kinds[c].startswith("array") else one(F.col(c)) for c in names}
    return df.withColumns(texts)


def write_scores(df: DataFrame, path: str, kind: str = "modes", order_by: str | None = None, compressed: bool = False) -> None:
    """Scores as text; '-' prints them instead. order_by: a column that orders the file, then dropped."""
    out = formatted(df, FORMATS[kind])
    if order_by:
        out = out.orderBy(order_by).drop(order_by)
    if path == "-":
        print_rows(out)
    else:
        _write(out, path, compressed)


def write_kmers(df: DataFrame, path: str, compressed: bool = False) -> None:
    _write(df.orderBy("kmer"), path, compressed)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def print_rows(df: DataFrame) -> None:
    """Rows to standard output, a partition at a time."""
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
