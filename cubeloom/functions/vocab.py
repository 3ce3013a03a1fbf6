"""Vocabulary terms, as N-Triples IRIs."""

from __future__ import annotations

# The namespaces of the vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
QB = "http://purl.org/linked-data/cube#"


def qb(name: str) -> str:
    return f"<{QB}{name}>"


def skos(name: str) -> str:
    return f"<{SKOS}{name}>"


TYPE = f"<{RDF}type>"
RANGE = f"<{RDFS}range>"
INVERSE_OF = f"<{OWL}inverseOf>"
TRUE = f'"true"^^<{XSD}boolean>'
FALSE = f'"false"^^<{XSD}boolean>'

#: Sub-properties of qb:componentProperty and the class each one implies for its object.
COMPONENT_KINDS = {
    qb("dimension"): qb("DimensionProperty"),
    qb("measure"): qb("MeasureProperty"),
    qb("attribute"): qb("AttributeProperty"),
}
