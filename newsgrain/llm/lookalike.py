"""Visually identical text with different characters.

Method: DuckDB runs inside the Arrow partitions. One embedded SQL expression takes out invisible characters, maps
full-width forms, ligatures, spaces, hyphens and look-alike letters, composes accents with nfc_normalize and writes
comma for cedilla. Case, missing diacritics, other punctuation and the number of visible characters are kept.

Defined cases: a null value stays null and an empty one empty; values that are blank once brought to the one form are
in no pair; equal strings are not a pair; repeated rows under one id are one row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrowio import int64
from .blocks import opened, pairs_within
from .fold import LOOKALIKES

#: Accented letters of other alphabets that are drawn like accented Latin ones.
ACCENTED = {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ѐ": "è", "Ѐ": "È", "ӑ": "ă", "Ӑ": "Ă", "ό": "ó", "Ό": "Ó", "ά": "á", "Ά": "Á", "έ": "é", "ӓ": "ä", "Ӓ": "Ä", "ӧ": "ö", "Ӧ": "Ö"}
#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj"}
#: Kinds of space, of hyphen, and letters with a cedilla that is written as a comma.
SPACES = "               　\t"
HYPHENS = "‐‑‒–—―−⁃﹘﹣－֊"
CEDILLA = {"ş": "ș", "Ş": "Ș", "ţ": "ț", "Ţ": "Ț"}
#: Fixed value: characters without a shape of their own (format characters, variation selectors, joiners, fillers).
INVISIBLE = r"[\p{Cf}\x{034f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180d}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def look_sql(column: str) -> str:
    """DuckDB SQL for the one form of a text column."""
    wide = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    one = wide | {c: " " for c in SPACES} | {c: "-" for c in HYPHENS} | LOOKALIKES | ACCENTED
    one = {a: b for a, b in one.items() if len(a) == len(b) == 1}
    expr = f"regexp_replace({column}, {_quoted(INVISIBLE)}, '', 'g')"
    expr = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    expr = f"translate({expr}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for a, b in LIGATURES.items():
        expr = f"replace({expr}, {_quoted(a)}, {_quoted(b)})"
    return f"translate(nfc_normalize({expr}), {_quoted(''.join(CEDILLA))}, {_quoted(''.join(CEDILLA.values()))})"


def _connection():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '400MB'")
    return con


def one_form(df: DataFrame, columns: list[str], suffix: str = "_look") -> DataFrame:
    """`df` with, for each text column, a column in which texts that look the same are the same."""
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        exprs = ", ".join([*(f'"{n}"' for n in names), *(f'{look_sql(f"{chr(34)}{c}{chr(34)}")} AS "{c}{suffix}"' for c in columns)])
        for batch in batches:
            con.register("b", pa.Table.from_batches([batch]))
            yield from con.sql(f"SELECT {exprs} FROM b").to_arrow_table().to_batches()

    schema = df.select("*", *[F.lit(None).cast("string").alias(f"{c}{suffix}") for c in columns]).schema
    return df.mapInArrow(work, schema)


def _keys(id_: str, columns: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        parts = [
            f"SELECT \"{id_}\" AS id, {k} AS field, hash(l) AS h1, hash('#' || l) AS h2, hash(v) AS value FROM (SELECT \"{id_}\", \"{c}\" AS v, {look_sql(f'{chr(34)}{c}{chr(34)}')} AS l FROM b) WHERE l IS NOT NULL AND regexp_matches(l, '[^\\s]')"
            for k, c in enumerate(columns)
        ]
        sql = " UNION ALL ".join(parts)
        for batch in batches:
            con.register("b", pa.Table.from_batches([batch]))
            t = con.sql(sql).to_arrow_table()
            yield pa.RecordBatch.from_arrays(
                [int64(t.column("id").to_numpy()), pa.array(t.column("field").to_numpy().astype(np.int32)), *(int64(t.column(c).to_numpy().astype(np.uint64, copy=False)) for c in ("h1", "h2", "value"))],
                names=["id", "field", "h1", "h2", "value"],
            )

    return work


CLASS = ["field", "h1", "h2"]


def _classes(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(field, h1, h2, value, id) of the rows whose look has several strings; one row an id and string."""
    plain = df.select(F.col(id_col).cast("long").alias("__id"), *[F.col(c).cast("string").alias(c) for c in columns]).where("__id is not null")
    keys = plain.mapInArrow(_keys("__id", columns), "id long, field int, h1 long, h2 long, value long")
    keys = materialize(keys, "look-keys")
    mixed = keys.groupBy(*CLASS).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(*CLASS)
    return materialize(keys.join(mixed, CLASS, "left_semi").distinct(), "look-groups")


def _field_name(columns: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("field") + 1).alias("field_name")


def look_pairs(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(field_name, a, b): pairs of rows whose values in a column look the same but are different strings.

    Rows of one string are collapsed first: pairs are made of the different strings of a look, and opened to rows at
    the end, where strings that many rows carry are divided into blocks.
    """
    rows = _classes(df, id_col, columns)
    pairs = opened(pairs_within(rows, CLASS, "value"), rows, CLASS, "value", "id").where("ra <> rb")
    return pairs.select(_field_name(columns), F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def look_classes(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(field_name, id, class_id, members, links): rows of a look with several strings; links: rows of its other strings."""
    rows = _classes(df, id_col, columns)
    one = rows.groupBy(*CLASS).agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    same = rows.groupBy(*CLASS, "value").agg(F.count("*").alias("same"))
    out = rows.join(same, [*CLASS, "value"]).join(one, CLASS)
    return out.select(_field_name(columns), "id", "class_id", "members", (F.col("members") - F.col("same")).alias("links"))
