"""Grouping records into similarity clusters: articles that tell of the same occurrence.

Method: grid density clustering with SQL. A document's features are the places, bodies and people it names; quantised, they
span a grid whose cells are (place, body or person) and a document stands in the cells of all that it names. Cells are
counted, dense cells that share a coordinate and at least half of their documents are joined, minimum labels are
propagated over the joined cells to convergence, and a document takes the label of the cell it names most. Groups are
reported with their size and, from their densest cell, the members of greatest membership strength.

Two occurrences in one place have no cell in common unless they share a name there, and a cell that both happen to
occupy can be joined to one of them only, because more than half of it must be shared.

Names are read from the text without its site lines, in one spelling (case, marks, look-alikes and invisible characters
aside). Persons are told by given names learnt from all documents, counted where they stand. Nothing grows with the
corpus but the tables and the set of given names, which every task holds; labels spread in rounds of joins, each written to the
shared folder.

Defined cases: null and blank texts, texts that name no place or neither body nor person, and members of small groups are in no group;
copies are members like others; a null membership strength comes last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .arrowio import column, int64
from .blocks import pairs_within
from .given_names import COMMON, corpus_given_names
from .given_names import form as _form

MIN_CELL = 3
MIN_GROUP = 5
#: Cells a task sends at a time.
SENT_CELLS = 200_000
PLACE, BODY, PERSON = range(3)
#: Words (without marks) that a place's name follows, in the languages of the corpus.
BEFORE_PLACE = frozenset("in din la spre langa localitatii comunei orasului zona municipiului satului from at near у в из под".split())
#: Capitalised words (without marks) that begin a sentence rather than a name.
BEGINNINGS = BEFORE_PLACE | frozenset("intre dupa potrivit pe cu de pentru the on by after late earlier".split())


@lru_cache(1)
def _patterns():
    import regex

    name = r"\p{Lu}[\p{L}\p{M}’']*(?:-[\p{L}\p{M}]+)*"
    return regex.compile(rf"(?<![\p{{L}}\p{{M}}\d]){name}(?: {name})*"), regex.compile("[­͏​-‏‪-‮⁠-⁯﻿]"), regex.compile("[   -   　\t]")


def plain(text: str) -> str:
    """The text without invisible characters and with one kind of space."""
    _, gone, space = _patterns()
    return space.sub(" ", gone.sub("", text))


class Names:
    """What capitalised runs name, remembered by spelling; given: the folded given names of the corpus."""

    def __init__(self, given: frozenset[str]):
        self._given = given
        self._named = lru_cache(300_000)(self._read)

    def _is_given(self, word: str) -> bool:
        return all(x in self._given for x in word.split("-"))

    def _read(self, before: str | None, run: str) -> tuple[int, str] | None:
        """What a run names, given the word before it: (PLACE, BODY or PERSON, its one spelling)."""
        parts = [_form(w)[0] for w in run.split(" ")]
        prior = _form(before)[0] if before else None
        while parts and parts[0] in BEGINNINGS:
            prior = parts.pop(0)
        for k in range(len(parts) - 1):
            given = [self._is_given(w) for w in parts[k : k + 2]]
            if given[0] != given[1]:
                return PERSON, " ".join(sorted(parts[k : k + 2]))
        if not parts or len(parts[-1]) < 4:
            return None
        if len(parts) == 1:
            return (PLACE, parts[0]) if prior in BEFORE_PLACE else None
        return BODY, " ".join((parts[0], parts[-1]))

    def entities(self, text: str) -> list[Counter[str]]:
        """The places, bodies and persons of a text with their numbers of mentions."""
        found: list[Counter[str]] = [Counter(), Counter(), Counter()]
        text = plain(text)
        for m in _patterns()[0].finditer(text):
            end = m.start() - 1
            before = None
            if end > 0 and text[end] in " \n":
                first = text.rfind(" ", 0, end)
                before = text[max(first, text.rfind("\n", first + 1, end)) + 1 : end] or None
            named = self._named(before, m.group())
            if named:
                found[named[0]][named[1]] += 1
        return found


def _cells(lines, has_source: bool, given):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from .site_lines import bare_texts

        code = lru_cache(300_000)(lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")))
        names = Names(given.value)
        row, place, body, weight = [], [], [], []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [int64(np.array(row, np.int64)), int64(np.array(place, np.uint64)), int64(np.array(body, np.uint64)), int64(np.array(weight, np.int64))], names=["id", "place", "body", "weight"]
            )
            for x in (row, place, body, weight):
                x.clear()
            return out

        for batch in batches:
            ids = column(batch, "id").to_numpy(zero_copy_only=False)
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            if lines is not None and has_source:
                texts = bare_texts(texts, column(batch, "source").to_pylist(), lines.value)
            for k, t in enumerate(texts):
                places, bodies, persons = names.entities(t)
                where = [(code(p), n) for p, n in places.items()]
                for b, nb in [*bodies.items(), *persons.items()]:
                    c = code(b)
                    for p, np_ in where:
                        row.append(ids[k])
                        place.append(p)
                        body.append(c)
                        weight.append(np_ * nb)
                    if len(row) >= SENT_CELLS:
                        yield sent()
        yield sent()

    return work


def spread_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node of every connected component; edges (a, b) in both directions.

    A round takes the least label among the neighbours and then that label's own label, so paths shrink geometrically.
    """
    spark = nodes.sparkSession
    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        labels.createOrReplaceTempView("grid_labels")
        edges.createOrReplaceTempView("grid_edges")
        near = spark.sql("""
            SELECT l.node, least(l.label, coalesce(min(n.label), l.label)) AS label, l.label AS old
            FROM grid_labels l LEFT JOIN grid_edges e ON e.a = l.node LEFT JOIN grid_labels n ON n.node = e.b
            GROUP BY l.node, l.label""")
        near = materialize(near, "labels-near")
        near.createOrReplaceTempView("grid_near")
        # the labels' own labels: far fewer rows than nodes, so that they are broadcast where the join would be uneven
        after = materialize(spark.sql("""
            WITH held AS (SELECT DISTINCT label FROM grid_near), own AS (SELECT node, label FROM grid_near WHERE node IN (SELECT label FROM held))
            SELECT x.node, least(x.label, y.label) AS label, x.old FROM grid_near x JOIN own y ON y.node = x.label"""), "labels")
        drop_materialized(near)
        done = after.where("label <> old").isEmpty()
        drop_materialized(labels)
        labels = after.select("node", "label")
        if done:
            return labels


def occurrence_groups(df: DataFrame, id_col: str, text_col: str, source_col: str | None = None, lines=None, min_group: int = MIN_GROUP) -> DataFrame:
    """(grp, id, cell, cell_n): the groups of at least `min_group` records, each member with its own cell and that cell's count."""
    spark = df.sparkSession
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), (F.col(source_col).cast("string") if source_col else F.lit(None).cast("string")).alias("source")]
    texts = df.select(*cols).where("id is not null and text is not null")
    given = spark.sparkContext.broadcast(corpus_given_names(texts, "text", plain, COMMON))
    found = texts.mapInArrow(_cells(lines, source_col is not None, given), "id long, place long, body long, weight long")
    found = materialize(found.withColumn("cell", F.xxhash64("place", "body")), "grid-occupied")
    found.createOrReplaceTempView("grid_occupied")
    counts = spark.sql(f"SELECT cell, place, body, count(DISTINCT id) AS n FROM grid_occupied GROUP BY cell, place, body HAVING count(DISTINCT id) >= {MIN_CELL}")
    dense = materialize(counts, "grid-dense")
    dense.createOrReplaceTempView("grid_dense")
    held = materialize(spark.sql("SELECT o.id, o.cell, o.place, o.body, max(o.weight) AS weight, d.n FROM grid_occupied o JOIN grid_dense d ON o.cell = d.cell GROUP BY o.id, o.cell, o.place, o.body, d.n"), "grid-held")
    held.createOrReplaceTempView("grid_held")
    joined = spark.sql("""
        SELECT x.cell AS a, y.cell AS b, count(*) AS both, max(x.n) AS na, max(y.n) AS nb
        FROM grid_held x JOIN grid_held y ON x.id = y.id AND x.cell < y.cell AND (x.place = y.place OR x.body = y.body)
        GROUP BY x.cell, y.cell HAVING count(*) * 2 > greatest(max(x.n), max(y.n))""")
    edges = joined.select("a", "b")
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "grid-edges")
    labels = spread_labels(dense.select(F.col("cell").alias("node")), edges)
    labels.createOrReplaceTempView("grid_final")
    own = spark.sql("""
        SELECT id, best.cell AS cell, best.n AS cell_n FROM (
            SELECT id, max(struct(weight, n, cell)) AS best FROM grid_held GROUP BY id)""")
    placed = materialize(own.join(labels, own["cell"] == labels["node"]).select(F.col("label").alias("grp"), "id", "cell", "cell_n"), "grid-members")
    large = placed.groupBy("grp").agg(F.count("*").alias("size")).where(F.col("size") >= min_group)
    return placed.join(large, "grp")


def group_pairs(members: DataFrame) -> DataFrame:
    """(a, b): all pairs of members of one group."""
    return pairs_within(members, ["grp"], "id").select("a", "b")


def group_report(members: DataFrame, strengths: DataFrame, top: int = 3) -> DataFrame:
    """(grp, size, typical): per group its size and the members of greatest strength in its densest cell.

    strengths: (id, strength).
    """
    m = members.join(strengths, "id", "left")
    m.createOrReplaceTempView("grid_members")
    return members.sparkSession.sql(f"""
        WITH r AS (
            SELECT grp, id, size, row_number() OVER (PARTITION BY grp ORDER BY cell_n DESC, cell, strength DESC NULLS LAST, id) AS r FROM grid_members)
        SELECT grp, max(size) AS size, transform(array_sort(collect_list(struct(r, id))), x -> x.id) AS typical FROM r WHERE r <= {top} GROUP BY grp""")
