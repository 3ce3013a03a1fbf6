"""Titles and messages of the constraints, and the markdown report of their violations."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cubeloom.sources.store import Path, join_files, saved

log = logging.getLogger("cubeloom")

# The titles by which the constraints are known, and what a report says of violations.
TITLES = {
    1: "Unique DataSet",
    2: "Unique DSD",
    3: "DSD Includes Measure",
    4: "Dimensions Have Range",
    5: "Concept Dimensions Have Code Lists",
    6: "Only Attributes May Be Optional",
    7: "Slice Keys Must Be Declared",
    8: "Slice Keys Consistent With DSD",
    9: "Unique Slice Structure",
    10: "Slice Dimensions Complete",
    11: "All Dimensions Required",
    12: "No Duplicate Observations",
    13: "Required Attributes",
    14: "All Measures Present",
    15: "Measure Dimension Consistent",
    16: "Single Measure On Measure Dimension Observation",
    17: "All Measures Present In Measures Dimension Cube",
    18: "Consistent Dataset Links",
    19: "Codes From Code List",
    20: "Codes From Hierarchy",
    21: "Codes From Hierarchy (Inverse)",
}
MESSAGES = {
    1: " is associated to the following datasets: ",
    2: " is associated to the following DSDs: ",
    3: "The following DSDs do not include at least one declared measure: ",
    4: "The following dimensions do not have a declared rdfs:range: ",
    5: "The following concept dimensions do not have a code list: ",
    6: "The following component properties are not declared as attributes: ",
    7: "The following slice keys are not associated with DSDs: ",
    8: "The following component properties on slice keys are not associated with DSDs: ",
    9: " is associated with the following slice structures: ",
    10: " does not have values for the following dimensions: ",
    11: " does not have values for the following dimensions: ",
    12: " has the same values as: ",
    13: " does not have values for the following required attributes: ",
    14: " does not have values for the following declared measures: ",
    15: " corresponds to a wrong measure or does not have a value on: ",
    16: " has the following multiple measures: ",
    17: " shares the same dimension values with the following number of observations: ",
    18: " should be associated to the following dataset: ",
    19: " is not included in the following code lists: ",
    20: " is not connected to the following code lists along a direct path: ",
    21: " is not connected to the following code lists along an inverse path: ",
}
SET_MESSAGES = MESSAGES | {12: "The following observations has duplicated values: ", 17: " differs from the following number of observations: "}
INDENT = "    "


def title(ic: int) -> str:
    return f"Integrity Constraint {ic}: {TITLES[ic]}"


def _plain(term) -> str:
    return term[1:-1] if isinstance(term, str) and term.startswith("<") else str(term)


def section(ic: int, violations: DataFrame, semantics: str = "standard", limit: int | None = None) -> list[str]:
    return list(section_lines(ic, violations, semantics, limit))


def section_lines(ic: int, violations: DataFrame, semantics: str = "standard", limit: int | None = None) -> Iterator[str]:
    """Lines of one constraint's section, as rows come. Rows are fetched in parts; ``limit`` bounds how many are listed."""
    head = title(ic)
    yield from (head, "-" * len(head), "")
    messages = SET_MESSAGES if semantics == "setwise" else MESSAGES
    names = [c for c in violations.columns if c != "ds"]
    rows = violations.select(*names).orderBy(*names[:1])
    shown, last = 0, None
    for row in (rows if limit is None else rows.limit(limit + 1)).toLocalIterator():
        if limit is not None and shown >= limit:
            yield f"{INDENT}..."
            break
        shown += 1
        if len(names) == 1:
            if shown == 1:
                yield messages[ic]
            yield INDENT + _plain(row[0])
            continue
        if row[0] != last:
            yield _plain(row[0]) + messages[ic]
            last = row[0]
        value = row[-1] if semantics == "standard" or ic != 17 else row["differing"]
        yield from (INDENT + _plain(x) for x in (value if isinstance(value, list) else [value]))
    if not shown:
        yield "Pass."
    yield ""


def common(ic: int, found: DataFrame) -> DataFrame:
    """(ic, subject, values) of a constraint's violations: the values that a report lists below a subject, null if it lists subjects only."""
    names = [c for c in found.columns if c != "ds"]
    kinds = dict(found.dtypes)
    values = F.lit(None).cast("array<string>")
    if len(names) > 1:
        last = F.col(names[-1])
        values = last if kinds[names[-1]].startswith("array") else F.array(F.coalesce(last.cast("string"), F.lit("None")))
    return found.select(F.lit(ic).alias("ic"), F.col(names[0]).alias("subject"), values.alias("values"))


def violations(found: dict[int, DataFrame]) -> tuple[DataFrame, dict[int, int]]:
    """The violations of several constraints as one stored table (ic, subject, values), and how many each has.

    One job evaluates them all, so what they share is read once; they are counted as they are written.
    """
    counts = {ic: Observation(f"ic{ic}-{uuid.uuid4().hex}") for ic in found}
    parts = [common(ic, df).observe(counts[ic], F.count("*").alias("n")) for ic, df in found.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    table = saved(every, "violations")
    return table, {ic: o.get.get("n", 0) for ic, o in counts.items()}


def write_report(found: dict[int, DataFrame], path: str, head: Iterable[str], semantics: str = "standard") -> dict[int, int]:
    """A report of all violations, whatever their number: its lines are made by all tasks, and their bytes joined to one file. Gives the numbers by constraint."""
    table, counts = violations(found)
    spark = table.sparkSession
    messages = SET_MESSAGES if semantics == "setwise" else MESSAGES
    pieces: list[str] = ["".join(line + "\n" for line in head)]
    for ic in found:
        pieces.append("\n".join([title(ic), "-" * len(title(ic)), "", ""]))
        if not counts[ic]:
            pieces.append("Pass.\n\n")
            continue
        message, single = messages[ic], len([c for c in found[ic].columns if c != "ds"]) == 1

        def lines(batches: Iterator[pa.RecordBatch], message: str = message) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                out = []
                for subject, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if values is None:
                        out.append(INDENT + _plain(subject))
                        continue
                    if subject != last:
                        out.append(_plain(subject) + message)
                        last = subject
                    out += [INDENT + _plain(x) for x in values]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

        # all rows of a subject are in one part, parts are in order
        rows = table.where(F.col("ic") == ic).select("subject", "values").repartitionByRange("subject").sortWithinPartitions("subject", "values")
        folder = f"{path}-{ic}-{uuid.uuid4().hex}"
        rows.mapInArrow(lines, "value string").write.text(folder)
        pieces += [message + "\n"] * single + [Path(folder), "\n"]
    join_files(spark, pieces, path)
    return counts


def header(source: str, semantics: str, now: datetime) -> list[str]:
    return ["Data Cube Validation Report", "===========================", "", f"Validator: {semantics}", f"Date: {now:%Y-%m-%d %H:%M:%S}", f"File: {source}", ""]


def write(out: TextIO, lines: Iterable[str]) -> None:
    for line in lines:
        out.write(line + "\n")
    out.flush()


def report_name(now: datetime) -> str:
    return f"validation_result_{now:%Y%m%d%H%M%S}.md"
