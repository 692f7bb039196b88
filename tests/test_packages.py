"""Manifests read back as XML: items, resources, files, pass marks, namespaces of both versions."""

import xml.etree.ElementTree as ET

from vellum.sources import packages as P


def read(text):
    return ET.fromstring(text)


def test_manifests(spark):
    modules = spark.createDataFrame([(1, 'Öl & <b> "x" \x07', 80), (2, None, 70)], "doc_id long, title string, passing_score int")
    sections = spark.createDataFrame([(1, 5, "Last"), (1, 1, "First & foremost"), (1, 3, None)], "doc_id long, `order` int, title string")
    got = {(r.doc_id, r.version): read(r.manifest) for r in P.package_manifests(modules, sections).collect()}
    assert set(got) == {(d, v) for d in (1, 2) for v in ("1.2", "2004")}
    for (doc, version), m in got.items():
        ns = {k or "cp": v for k, v in P.SPACES[version].items()}
        find = lambda path, m=m, ns=ns: m.findall(path, ns)
        assert m.tag == f"{{{ns['cp']}}}manifest" and [x.text for x in find("cp:metadata/cp:schemaversion")] == [P.TOKENS[version]]
        n = 3 if doc == 1 else 0
        assert [x.text or "" for x in find("cp:organizations/cp:organization/cp:title")] == ['Öl & <b> "x" ' if doc == 1 else ""]
        items = find("cp:organizations/cp:organization/cp:item")
        assert [i.get("identifier") for i in items] == [f"ITEM-{i}" for i in range(1, n + 1)] + ["ITEM-ASSESSMENT"]
        assert [i.findtext("cp:title", namespaces=ns) for i in items] == ["First & foremost", "Section 2", "Last"][:n] + ["Assessment"]
        resources = {r.get("identifier"): r for r in find("cp:resources/cp:resource")}
        assert [i.get("identifierref") for i in items] == [k for k in resources if k != "RES-METADATA"]
        kind = f"{{{ns['adlcp']}}}" + ("scormtype" if version == "1.2" else "scormType")
        for name, r in resources.items():
            files = [f.get("href") for f in r.findall("cp:file", ns)]
            assert (r.get(kind), r.get("href"), files) == (("asset", None, ["metadata.json"]) if name == "RES-METADATA" else ("sco", files[0], [files[0], *P.SHARED]))
        if version == "1.2":
            assert [x.text for x in find(".//adlcp:masteryscore")] == ["80" if doc == 1 else "70"]
        else:
            assert [x.text for x in find(".//imsss:minNormalizedMeasure")] == ["0.8000" if doc == 1 else "0.7000"]
            assert [x.attrib for x in find("cp:organizations/cp:organization/imsss:sequencing/imsss:controlMode")] == [{"choice": "true", "flow": "true"}]
