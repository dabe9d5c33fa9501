"""Advisory text templates (P1-P12, P16, X9, X12) as one projection over feed items.

Template wording is fixed text that must equal the reference's output, kept together below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.functions.text import cpe_clean, py_list_repr, py_str

# ---- fixed values (template wording of the reference) -----------------------------------
IMPACT_SENTENCE = ("this is impact list for this document: attack via {attackVector}, attack complexity is "
                   "{attackComplexity}, is need privileges? {privilegesRequired}, is need user interaction? "
                   "{userInteraction}, scope is {scope}, confidentiality impact is {confidentialityImpact}, "
                   "integrity impact is {integrityImpact}, availability impact is {availabilityImpact}, "
                   "base score is {baseScore}, base severity is {baseSeverity}")
DOCUMENT = "id: {id} list cpe: {cpes} description: {description} {impact}"
CPE_DETAIL_DENSE = "{clean}, version {start} - {end}"
CPE_DETAIL_TRAINING = "{clean} version {start} - {end}"
RECORD = "nama: {nama}, tech: {tech}, versi: {versi}, deskripsi: {deskripsi}"
# -----------------------------------------------------------------------------------------


def fill(template: str, values: dict[str, Column]) -> Column:
    """Render a ``{name}`` template with Column values (concat; no Python per row)."""
    parts, rest = [], template
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if pre:
            parts.append(F.lit(pre))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def cve_id() -> Column:
    """``cve.CVE_data_meta.ID`` (null when absent)."""
    return F.col("cve.CVE_data_meta.ID")


def first_description() -> Column:
    """P5: value of the first description entry, any language."""
    return F.try_element_at(F.col("cve.description.description_data"), F.lit(1))["value"]


def cvss3_field(name: str) -> Column:
    """Optional path chain; null anywhere gives null."""
    return F.col(f"impact.baseMetricV3.cvssV3.{name}")


def cpe_matches() -> Column:
    """Every node's cpe_match entries in order, as one array (nodes x matches)."""
    nodes = F.coalesce(F.col("configurations.nodes"), F.array().cast("array<struct<operator:string,"
                       "cpe_match:array<struct<vulnerable:boolean,cpe23Uri:string,"
                       "versionStartIncluding:string,versionEndIncluding:string>>>>"))
    return F.flatten(F.transform(nodes, lambda n: F.coalesce(n["cpe_match"], F.array().cast(
        "array<struct<vulnerable:boolean,cpe23Uri:string,versionStartIncluding:string,"
        "versionEndIncluding:string>>"))))


def cpe_details(template: str = CPE_DETAIL_DENSE) -> Column:
    """P7+P8: cleaned CPE plus version bounds (``none`` when absent) for every match."""
    return F.transform(cpe_matches(), lambda c: fill(template, {
        "clean": cpe_clean(c["cpe23Uri"]),
        "start": F.coalesce(c["versionStartIncluding"], F.lit("none")),
        "end": F.coalesce(c["versionEndIncluding"], F.lit("none"))}))


def impact_sentence() -> Column:
    """The ten CVSS v3 fields in a sentence; missing values print ``None``."""
    names = ["attackVector", "attackComplexity", "privilegesRequired", "userInteraction", "scope",
             "confidentialityImpact", "integrityImpact", "availabilityImpact", "baseScore", "baseSeverity"]
    return fill(IMPACT_SENTENCE, {n: py_str(cvss3_field(n)) for n in names})


def dense_document() -> Column:
    """P10: collection document; the impact sentence is lower-cased before use."""
    return fill(DOCUMENT, {"id": py_str(cve_id()), "cpes": py_list_repr(cpe_details(CPE_DETAIL_DENSE)),
                           "description": py_str(first_description()), "impact": F.lower(impact_sentence())})


def training_document() -> Column:
    """Training-pair document: CPE format without comma, impact not lower-cased."""
    return fill(DOCUMENT, {"id": py_str(cve_id()), "cpes": py_list_repr(cpe_details(CPE_DETAIL_TRAINING)),
                           "description": py_str(first_description()), "impact": impact_sentence()})


def dense_documents(items: DataFrame) -> DataFrame:
    """Items with an id -> (pos, cve_id, document). The id is required (P1): rows without one
    are dropped instead of failing the job."""
    return items.where(cve_id().isNotNull()).select("pos", cve_id().alias("cve_id"),
                                                    dense_document().alias("document"))


def record_text(nama="nama", tech="tech", versi="versi", deskripsi="deskripsi") -> Column:
    """Flat product record sentence."""
    return fill(RECORD, {"nama": py_str(F.col(nama)), "tech": py_str(F.col(tech)),
                         "versi": py_str(F.col(versi)), "deskripsi": py_str(F.col(deskripsi))})
