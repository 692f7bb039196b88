"""Manifests of learning packages, one XML text a document and version of the standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

# Names, places and tokens that the two versions of the standard prescribe.
XSI = "http://www.w3.org/2001/XMLSchema-instance"
SPACES = {
    "1.2": {"": "http://www.imsproject.org/xsd/imscp_rootv1p1p2", "adlcp": "http://www.adlnet.org/xsd/adlcp_rootv1p2"},
    "2004": {
        "": "http://www.imsglobal.org/xsd/imscp_v1p1", "adlcp": "http://www.adlnet.org/xsd/adlcp_v1p3", "adlseq": "http://www.adlnet.org/xsd/adlseq_v1p3", "adlnav": "http://www.adlnet.org/xsd/adlnav_v1p3", "imsss": "http://www.imsglobal.org/xsd/imsss",
    },
}
SCHEMAS = {
    "1.2": {"": "imscp_rootv1p1p2.xsd", "adlcp": "adlcp_rootv1p2.xsd"},
    "2004": {"": "imscp_v1p1.xsd", "adlcp": "adlcp_v1p3.xsd", "adlseq": "adlseq_v1p3.xsd", "adlnav": "adlnav_v1p3.xsd", "imsss": "imsss_v1p0.xsd"},
}
TOKENS = {"1.2": "1.2", "2004": "2004 4th Edition"}
SCO = {"1.2": "adlcp:scormtype", "2004": "adlcp:scormType"}
SHARED = ("styles.css", "scorm_api.js")
TEST, ASSET = "assessment.html", "metadata.json"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{FFFE}\x{FFFF}]"


def xml_text(x: Column) -> Column:
    """For elements and attributes: without what XML can't hold, null as empty."""
    return T.escaped(F.regexp_replace(F.coalesce(x, F.lit("")), CONTROL, ""))


def opening(version: str) -> str:
    """The manifest's start, to the place of the organization's title."""
    names = "".join(f' xmlns{":" * bool(k)}{k}="{v}"' for k, v in SPACES[version].items())
    places = " ".join(f"{SPACES[version][k]} {v}" for k, v in SCHEMAS[version].items())
    return (
        f'<manifest{names} xmlns:xsi="{XSI}" identifier="MANIFEST-01" version="1.0" xsi:schemaLocation="{places}"><metadata><schema>ADL SCORM</schema><schemaversion>{TOKENS[version]}</schemaversion></metadata>'
        '<organizations default="ORG-01"><organization identifier="ORG-01"><title>'
    )


def resource(version: str, number: str, page: str) -> str:
    """The declaration of a page with all files that it loads."""
    return f'<resource identifier="RES-{number}" type="webcontent" {SCO[version]}="sco" href="{page}">' + "".join(f'<file href="{f}"/>' for f in (page, *SHARED)) + "</resource>"


def closing(version: str) -> str:
    """The assessment's own resource and that of the record which comes with the package."""
    return resource(version, "ASSESSMENT", TEST) + f'<resource identifier="RES-METADATA" type="webcontent" {SCO[version]}="asset"><file href="{ASSET}"/></resource></resources></manifest>'


def manifest_xml(title: Column, pages: Column, passing_score: Column, version: str) -> Column:
    """pages: titles of the content pages in order. The pass mark is a mastery score in 1.2, a normalised measure of the assessment's objective in 2004."""
    numbered = lambda f: F.array_join(F.transform(pages, lambda t, i: f(t, (i + 1).cast("string"))), "")
    lit = F.lit
    items = numbered(lambda t, i: F.concat(lit('<item identifier="ITEM-'), i, lit('" identifierref="RES-'), i, lit('" isvisible="true"><title>'), xml_text(t), lit("</title></item>")))
    before, after = resource(version, "\0", "content_\0.html").split("\0", 1)[0], resource(version, "\0", "content_\0.html").split("\0")[1:]
    files = numbered(lambda _, i: F.concat(lit(before), *[x for part in after for x in (i, lit(part))]))
    test = lit('<item identifier="ITEM-ASSESSMENT" identifierref="RES-ASSESSMENT" isvisible="true"><title>Assessment</title>')
    if version == "1.2":
        mark, flow = F.concat(lit("<adlcp:masteryscore>"), passing_score.cast("string"), lit("</adlcp:masteryscore></item>")), lit("")
    else:
        measure = F.format_string("%.4f", passing_score / 100.0)
        mark = F.concat(lit('<imsss:sequencing><imsss:objectives><imsss:primaryObjective objectiveID="OBJ-ASSESSMENT" satisfiedByMeasure="true"><imsss:minNormalizedMeasure>'), measure, lit("</imsss:minNormalizedMeasure></imsss:primaryObjective></imsss:objectives></imsss:sequencing></item>"))
        flow = lit('<imsss:sequencing><imsss:controlMode choice="true" flow="true"/></imsss:sequencing>')
    return F.concat(lit(opening(version)), xml_text(title), lit("</title>"), items, test, mark, flow, lit("</organization></organizations><resources>"), files, lit(closing(version)))


def package_manifests(modules: DataFrame, sections: DataFrame, versions: tuple[str, ...] = ("1.2", "2004")) -> DataFrame:
    """(doc_id, version, manifest) of modules (doc_id, title, passing_score) and their sections (doc_id, order, title). A module without sections has the assessment alone; a section without a title is named by its number."""
    named = F.struct("order", F.coalesce("title", F.lit("")).alias("title"), F.col("title").isNull().alias("none"))
    pages = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(named)).alias("_pages"))
    df = modules.select("doc_id", "title", "passing_score").join(pages, "doc_id", "left")
    titles = F.transform(F.coalesce("_pages", F.array().cast(pages.schema["_pages"].dataType)), lambda p, i: F.when(p["none"], F.concat(F.lit("Section "), (i + 1).cast("string"))).otherwise(p["title"]))
    made = F.array(*[F.struct(F.lit(v).alias("version"), manifest_xml(F.col("title"), titles, F.col("passing_score"), v).alias("manifest")) for v in versions])
    return df.select("doc_id", F.inline(made))
