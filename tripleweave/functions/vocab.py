"""Vocabulary constants: ``RDF.type``, ``XSD.integer`` and so on, as IRIs."""

from __future__ import annotations

from tripleweave.functions.terms import IRI


class Namespace:
    """The terms of one vocabulary as attributes. ``ns`` is the namespace; ``type_`` and the like also
    answer to names that Python reserves."""

    def __init__(self, ns: str, names: str):
        self.ns = ns
        self.names = tuple(names.split())
        for name in self.names:
            setattr(self, name, IRI(ns + name))

    def __getattr__(self, name: str) -> IRI:
        if name.endswith("_") and name[:-1] in self.__dict__.get("names", ()):
            return self.__dict__[name[:-1]]
        raise AttributeError(name)

    def __len__(self) -> int:
        return len(self.names)


# The names of the W3C vocabularies.
RDF = Namespace("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "type Property Statement subject predicate object List nil first rest value langString")
RDFS = Namespace(
    "http://www.w3.org/2000/01/rdf-schema#",
    "Resource Class subClassOf subPropertyOf domain range label comment member Container ContainerMembershipProperty isDefinedBy seeAlso Literal Datatype",
)
OWL = Namespace(
    "http://www.w3.org/2002/07/owl#",
    "Thing Nothing Class ObjectProperty DatatypeProperty AnnotationProperty Ontology imports versionInfo equivalentClass equivalentProperty sameAs "
    "differentFrom inverseOf TransitiveProperty SymmetricProperty FunctionalProperty InverseFunctionalProperty",
)
XSD = Namespace(
    "http://www.w3.org/2001/XMLSchema#",
    "string boolean decimal integer double float date time dateTime dateTimeStamp gYear gMonth gDay gYearMonth gMonthDay duration yearMonthDuration "
    "dayTimeDuration byte short int long unsignedByte unsignedShort unsignedInt unsignedLong positiveInteger nonNegativeInteger negativeInteger "
    "nonPositiveInteger hexBinary base64Binary anyURI language normalizedString token NMTOKEN Name NCName",
)
SHACL = Namespace(
    "http://www.w3.org/ns/shacl#",
    "Shape NodeShape PropertyShape targetClass targetNode targetObjectsOf targetSubjectsOf path property minCount maxCount class datatype nodeKind minLength "
    "maxLength pattern flags minInclusive maxInclusive minExclusive maxExclusive ValidationReport ValidationResult conforms result focusNode resultPath "
    "resultSeverity resultMessage sourceConstraintComponent sourceShape value Violation Warning Info",
)
