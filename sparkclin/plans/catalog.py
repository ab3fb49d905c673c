"""The catalogue of search parameters, compartments and element rules (metadata, driver side)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SearchParam:
    """``kind``: string, token, date, number, quantity, reference, uri or composite. ``components``: (code, expression, kind) of a composite."""

    code: str
    resource: str
    kind: str
    expression: str
    targets: tuple[str, ...] = ()
    components: tuple[tuple[str, str, str], ...] = ()


#: Modifiers that each kind allows; every kind also has "missing".
MODIFIERS = {
    "string": {"exact", "contains", "text"},
    "token": {"not", "text", "in", "not-in", "below", "above", "of-type", "code-text", "text-advanced"},
    "date": set(),
    "number": set(),
    "quantity": set(),
    "reference": {"identifier", "above", "below", "contains", "code-text", "text", "text-advanced"},
    "uri": {"below", "above", "contains"},
    "composite": set(),
    "special": set(),
}

PREFIXES = ("eq", "ne", "gt", "lt", "ge", "le", "sa", "eb", "ap")

DEFAULT_PARAMS = (
    SearchParam("name", "Patient", "string", "Patient.name.select(family | given | text)"),
    SearchParam("family", "Patient", "string", "Patient.name.family"),
    SearchParam("identifier", "Patient", "token", "Patient.identifier"),
    SearchParam("active", "Patient", "token", "Patient.active"),
    SearchParam("segment", "Patient", "token", "Patient.segment"),
    SearchParam("balance", "Patient", "number", "Patient.balance"),
    SearchParam("address-country", "Patient", "string", "Patient.address.country"),
    SearchParam("location", "Patient", "reference", "Patient.location", ("Location",)),
    SearchParam("name", "Location", "string", "Location.name"),
    SearchParam("partof", "Location", "reference", "Location.partOf", ("Location",)),
    SearchParam("name", "Organization", "string", "Organization.name"),
    SearchParam("balance", "Organization", "number", "Organization.balance"),
    SearchParam("location", "Organization", "reference", "Organization.location", ("Location",)),
    SearchParam("code", "Medication", "token", "Medication.code"),
    SearchParam("name", "Medication", "string", "Medication.name"),
    SearchParam("size", "Medication", "number", "Medication.size"),
    SearchParam("price", "Medication", "number", "Medication.price"),
    SearchParam("status", "Encounter", "token", "Encounter.status"),
    SearchParam("date", "Encounter", "date", "Encounter.period"),
    SearchParam("subject", "Encounter", "reference", "Encounter.subject", ("Patient",)),
    SearchParam("priority", "Encounter", "token", "Encounter.priority"),
    SearchParam("total", "Encounter", "number", "Encounter.total"),
    SearchParam("status", "Observation", "token", "Observation.status"),
    SearchParam("code", "Observation", "token", "Observation.code"),
    SearchParam("date", "Observation", "date", "Observation.effective"),
    SearchParam("value-quantity", "Observation", "quantity", "Observation.value.ofType(Quantity)"),
    SearchParam("encounter", "Observation", "reference", "Observation.encounter", ("Encounter",)),
    SearchParam("focus", "Observation", "reference", "Observation.focus", ("Medication",)),
    SearchParam("performer", "Observation", "reference", "Observation.performer", ("Organization",)),
    SearchParam("component-code-value", "Observation", "composite", "Observation.component", (), (("code", "code", "token"), ("value", "value.ofType(Quantity)", "quantity"))),
    SearchParam("url", "Composition", "uri", "Composition.url"),
    SearchParam("language", "DocumentReference", "token", "DocumentReference.language"),
    SearchParam("source", "DocumentReference", "string", "DocumentReference.source"),
    SearchParam("label", "Specimen", "number", "Specimen.label"),
    SearchParam("action", "AuditEvent", "token", "AuditEvent.action"),
)

#: Compartment type and resource type to the parameters that make a resource a member; "{def}" is the resource itself.
COMPARTMENTS = {
    "Patient": {"Patient": ("{def}",), "Encounter": ("subject",)},
    "Encounter": {"Encounter": ("{def}",), "Observation": ("encounter",)},
    "Location": {"Location": ("{def}",), "Patient": ("location",), "Organization": ("location",)},
}

#: Elements kept by _summary=true, and those that are always kept.
SUMMARY = {"Patient": ("identifier", "active", "name", "address"), "Encounter": ("status", "subject", "period"), "Observation": ("status", "code", "effectiveDateTime", "valueQuantity")}
MANDATORY = ("resourceType", "id", "status", "meta")


class SearchError(ValueError):
    """A request that the engine rejects."""


@dataclass
class Catalog:
    params: dict[tuple[str, str], SearchParam] = field(default_factory=dict)

    @classmethod
    def default(cls) -> Catalog:
        return cls({(p.resource, p.code): p for p in DEFAULT_PARAMS})

    def add(self, param: SearchParam) -> None:
        self.params[param.resource, param.code] = param

    def find(self, resource: str, code: str) -> SearchParam | None:
        """The parameter of a type, else of what all resources share."""
        for of in (resource, "DomainResource", "Resource"):
            if (of, code) in self.params:
                return self.params[of, code]
        return None

    def of_type(self, resource: str, kind: str | None = None) -> list[SearchParam]:
        return [p for (r, _), p in sorted(self.params.items()) if r in (resource, "DomainResource", "Resource") and kind in (None, p.kind)]

    def version(self) -> str:
        """A hash of the parameters; an index built with another one is stale."""
        import hashlib

        return hashlib.sha256(repr(sorted(map(repr, self.params.values()))).encode()).hexdigest()
