"""IRIs of the RDF, RDFS, OWL, XSD and Dublin Core vocabularies (fixed values)."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DC = "http://purl.org/dc/elements/1.1/"
DCTERMS = "http://purl.org/dc/terms/"

TYPE = RDF + "type"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
LABEL, COMMENT = RDFS + "label", RDFS + "comment"
SUBCLASS, SUBPROP, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"
CLASS, RESTRICTION, ONTOLOGY, NAMED = OWL + "Class", OWL + "Restriction", OWL + "Ontology", OWL + "NamedIndividual"
OBJECT_PROPERTY, DATATYPE_PROPERTY = OWL + "ObjectProperty", OWL + "DatatypeProperty"
THING, NOTHING = OWL + "Thing", OWL + "Nothing"

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "dc": DC, "dcterms": DCTERMS}
