import json

import pytest

from mnestra.operators import archive as A
from mnestra.sources import files


def fact(text, **more):
    return {"text": text, "fact_type": "world", "mentioned_at": "2026-01-02T03:04:05Z", **more}


MANIFEST = {"schema_version": 1, "source_bank_id": "b", "document_count": 1, "fact_count": 2, "observation_count": 1}
DOCUMENT = {"id": "d", "original_text": "t", "facts": [fact("one", causal_relations=[{"relation_type": "caused_by", "target_fact_index": 5}]), fact("two", entities=["e", None])]}
OBSERVATION = {"text": "o", "mentioned_at": "2026-01-02", "sources": [{"document_id": "d", "fact_index": 1}, {"document_id": "d", "fact_index": 9}]}


def table(spark, **changed):
    content = {"manifest.json": MANIFEST, "documents/1.json": DOCUMENT, "observations.json": [OBSERVATION], "notes.txt": "not read", **changed}
    rows = [(f"/a/x/{name}", body if isinstance(body, str) else json.dumps(body)) for name, body in content.items() if body is not None]
    return spark.createDataFrame(rows + [("/a/no-archive/documents/1.json", json.dumps(DOCUMENT))], "path string, content string")


def test_archives_are_read_whole(spark):
    found = A.parse_archive(table(spark))
    assert [tuple(r) for r in found.manifests.select("archive", "source_bank_id", "fact_count").collect()] == [("/a/x", "b", 2)]
    assert sorted((r["fact_index"], r["text"], r["entities"]) for r in found.facts.collect()) == [(0, "one", None), (1, "two", ["e", None])]
    assert [(r["position"], r["proof_count"], len(r["sources"])) for r in found.observations.collect()] == [(0, 1, 2)]
    assert A.parse_archive(table(spark, **{"observations.json": None})).observations.count() == 0


@pytest.mark.parametrize("name,body,problem", [("documents/2.json", "{", "unreadable"), ("observations.json", "{}", "unreadable"), ("manifest.json", {**MANIFEST, "x": 1}, "unknown fields"), ("documents/1.json", {"id": "d", "facts": [fact("f", colour="red")]}, "unknown fields"), ("observations.json", [{"text": "o", "y": 1}], "unknown fields")])
def test_files_that_are_not_as_they_should_be_are_refused(spark, name, body, problem):
    df = table(spark, **{name: body})
    assert [tuple(r) for r in A.file_problems(df.filter("path like '/a/x/%'")).collect()] == [(f"/a/x/{name}", problem)]
    with pytest.raises(ValueError, match=problem):
        A.parse_archive(df)


def test_rules(spark):
    found = A.parse_archive(table(spark, **{"manifest.json": {**MANIFEST, "fact_count": 3, "archive_type": "bank", "webhook_count": 2}}))
    got = {(r["rule"], r["document_id"], r["place"]) for r in A.importable(found).collect()}
    assert got == {("archive_type", None, None), ("webhook_count", None, None), ("cause_out_of_range", "d", 0), ("source_unresolved", "/a/x/observations.json", 0)}
    hashes = spark.createDataFrame([("d", "0", 1)], "document_id string, content_hash string, facts long")
    assert {r["rule"] for r in A.integrity(found, hashes).collect()} == {"fact_count", "content_hash", "facts_of_document"}


def test_files_are_written_and_read_again(spark, tmp_path):
    for name, body in (("manifest.json", MANIFEST), ("documents/1.json", DOCUMENT), ("observations-0.json", [OBSERVATION])):
        path = tmp_path / "x" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(body, indent=1))
    found = files.read_archives(spark, str(tmp_path))
    assert found.facts.count() == 2 and found.observations.count() == 1 and found.manifests.first()["source_bank_id"] == "b"


def test_empty(spark):
    found = A.parse_archive(spark.createDataFrame([], "path string, content string"))
    assert found.facts.count() == 0 and A.integrity(found).count() == 0 and A.importable(found).count() == 0
