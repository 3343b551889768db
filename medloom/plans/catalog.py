"""Search parameters of each resource type, and the adapters that make the resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators.search import Param
from ..sources import tables


PARAMS: dict[str, list[Param]] = {
    "Patient": [
        Param("_id", "token", lambda p: N.strings(p["id"])),
        Param("name", "string", lambda p: N.human_names(p["name"])),
        Param("phone", "string", lambda p: N.contact_points(p["telecom"])),
        Param("identifier", "token", lambda p: N.tokens(p["identifier"])),
        Param("gender", "token", lambda p: N.strings(p["gender"])),
        Param("active", "token", lambda p: N.strings(p["active"])),
        Param("birthdate", "date", lambda p: N.strings(p["birthDate"])),
        Param("general-practitioner", "reference", lambda p: N.references(p["generalPractitioner"]), ("Location",)),
        Param("balance", "number", lambda p: N.numbers(p["balance"])),
    ],
    "Encounter": [
        Param("_id", "token", lambda p: N.strings(p["id"])),
        Param("status", "token", lambda p: N.strings(p["status"])),
        Param("subject", "reference", lambda p: N.references(p["subject"]), ("Patient",)),
        Param("date", "date", lambda p: N.dates(p["period"])),
        Param("priority", "token", lambda p: N.concept_tokens(p["priority"])),
        Param("total", "number", lambda p: N.numbers(p["totalPrice"])),
        Param("status-priority", "composite", lambda p: F.array(F.concat_ws("$", p["status"].col, p.at("priority.coding.code.first()").col)), components=2),
    ],
    "Organization": [
        Param("_id", "token", lambda p: N.strings(p["id"])),
        Param("name", "string", lambda p: N.strings(p["name"])),
        Param("location", "reference", lambda p: N.references(p["location"]), ("Location",)),
    ],
    "Location": [
        Param("_id", "token", lambda p: N.strings(p["id"])),
        Param("name", "string", lambda p: N.strings(p["name"])),
        Param("partof", "reference", lambda p: N.references(p["partOf"]), ("Location",)),
    ],
    "Observation": [
        Param("status", "token", lambda p: N.strings(p["status"])),
        Param("code", "token", lambda p: N.concept_tokens(p["code"])),
        Param("encounter", "reference", lambda p: N.references(p["encounter"]), ("Encounter",)),
        Param("value-quantity", "number", lambda p: N.numbers(p["value"].ofType("Quantity")["value"])),
        Param("date", "date", lambda p: N.dates(p["effective"])),
    ],
}

ADAPTERS = {"Patient": tables.patients, "Encounter": tables.encounters, "Organization": tables.organizations, "Location": tables.locations, "Observation": tables.observations}


def resources(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return ADAPTERS[kind](spark, sf_dir)
