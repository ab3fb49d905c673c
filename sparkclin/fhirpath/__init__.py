"""FHIRPath: a parser, a compiler to Columns, and an interpreter for what Columns cannot express."""

from sparkclin.fhirpath.parser import FhirPathError, parse

__all__ = ["FhirPathError", "parse"]
