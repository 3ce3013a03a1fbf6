"""The validator: load or take a graph, normalize it, evaluate constraints, report and export."""

from __future__ import annotations

import logging
from datetime import datetime
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from cubeloom import report
from cubeloom.functions.terms import triples
from cubeloom.plans.constraints import SETWISE, STANDARD
from cubeloom.plans.context import CubeContext
from cubeloom.plans.normalize import normalize
from cubeloom.sources.rdf import read_graph, write_graph
from cubeloom.sources.store import stored

log = logging.getLogger("cubeloom")
SEMANTICS = ("standard", "setwise")


class CubeValidator:
    """Constraints over one graph (columns s, p, o; canonical N-Triples terms).

    ``semantics``: ``standard`` (the meaning of the constraint queries) or ``setwise`` (set algebra over terms).
    """

    def __init__(self, graph: DataFrame, *, semantics: str = "standard", source: str = "memory"):
        if semantics not in SEMANTICS:
            raise ValueError(f"Validator type {semantics} is not supported; use one of {SEMANTICS}")
        self.semantics, self.source = semantics, source
        self._set(graph if "o_val" in graph.columns else triples(graph))

    def _set(self, graph: DataFrame) -> None:
        self.graph = graph
        self.context = CubeContext(graph, by_value=self.semantics == "standard")

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, format: str | None = None, *, semantics: str = "standard") -> CubeValidator:
        return cls(read_graph(spark, path, format), semantics=semantics, source=path)

    def normalize(self) -> CubeValidator:
        """Add what the abbreviated form implies, in place. Graph and additions are stored, sorted by predicate, for the constraints to scan."""
        self._set(normalize(stored(self.graph), keep=stored))
        return self

    def validate(self, ic: int | str) -> DataFrame:
        """Violations of one constraint, given as 12, "12" or "IC12"."""
        number = int(str(ic).upper().removeprefix("IC").lstrip("-"))
        rules = STANDARD if self.semantics == "standard" else SETWISE
        if number not in rules:
            raise ValueError(f"there is no constraint {ic}")
        return rules[number](self.context)

    def validate_all(self, out: TextIO | None = None, *, limit: int | None = None) -> dict[int, DataFrame]:
        """Violations of all constraints in order, written to ``out`` as markdown if it is given."""
        found = {}
        if out:
            report.write(out, report.header(self.source, self.semantics, datetime.now()))
        for ic in STANDARD:
            log.info("Validating %s", report.title(ic))
            found[ic] = self.validate(ic)
            if out:
                report.write(out, report.section_lines(ic, found[ic], self.semantics, limit))
        return found

    def report(self, path: str) -> dict[int, int]:
        """Write the markdown report of all constraints to a file; gives the number of violations of each.

        All constraints are evaluated by one job, and no violation passes through the driver.
        """
        for ic in STANDARD:
            log.info("Validating %s", report.title(ic))
        found = {ic: self.validate(ic) for ic in STANDARD}
        return report.write_report(found, path, report.header(self.source, self.semantics, datetime.now()), self.semantics)

    def export(self, path: str, format: str | None = None, *, single: bool = False) -> None:
        """Write the graph, as a folder of parts or as one file."""
        write_graph(self.graph, path, format, single=single)


def create_validator(spark: SparkSession, source: DataFrame | str, format: str | None = None, *, semantics: str = "standard") -> CubeValidator:
    """A validator for a graph or a file; ValueError for other semantics."""
    if isinstance(source, str):
        return CubeValidator.from_file(spark, source, format, semantics=semantics.lower())
    return CubeValidator(source, semantics=semantics.lower())
