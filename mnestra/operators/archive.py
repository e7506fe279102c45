"""Transfer archives as tables: reading their files, rules of integrity and of import, and counts of both sides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnestra.functions.timex import iso_ms
from mnestra.operators.entities import normalise_name
from mnestra.operators.verify import temporal_differences
from mnestra.session import materialise

#: The fields of the files of an archive.
MANIFEST = (
    "schema_version bigint, source_bank_id string, exported_at string, document_count bigint, fact_count bigint, observation_count bigint, archive_type string, "
    "mental_model_count bigint, directive_count bigint, webhook_count bigint, knowledge_page_count bigint, includes_history boolean, bank_rows_json_encoding string"
)
FACT = (
    "text:string,fact_type:string,context:string,event_date:string,occurred_start:string,occurred_end:string,mentioned_at:string,"
    "metadata:map<string,string>,tags:array<string>,observation_scopes:string,chunk_index:bigint,entities:array<string>,"
    "causal_relations:array<struct<relation_type:string,target_fact_index:bigint>>,created_at:string,consolidated_at:string,consolidation_failed_at:string"
)
DOCUMENT = f"id string, original_text string, retain_params string, tags array<string>, created_at string, chunks array<struct<chunk_index:bigint,chunk_text:string>>, facts array<struct<{FACT}>>"
OBSERVATION = (
    "text:string,tags:array<string>,event_date:string,occurred_start:string,occurred_end:string,mentioned_at:string,observation_scopes:string,proof_count:bigint,"
    "sources:array<struct<document_id:string,fact_index:bigint>>"
)
_LAYOUT = r"^(.*)/(?:(manifest)\.json|(observations)(?:-\d+)?\.json|(documents)/[^/]+\.json)$"


@dataclass
class Archive:
    """The archives below a folder, ``archive`` being the folder of each."""

    manifests: DataFrame  # archive, the fields of the manifest
    documents: DataFrame  # archive, document_id, original_text, retain_params, tags, created_at, chunks, n_facts
    facts: DataFrame  # archive, document_id, fact_index, the fields of the fact
    observations: DataFrame  # archive, file, position, the fields of the observation


def _names(fields: str) -> list[str]:
    depth, names, start = 0, [], 0
    for i, c in enumerate(fields + ","):
        depth += (c in "<") - (c in ">")
        if c == "," and depth == 0:
            names.append(fields[start:i].strip().replace(":", " ").split()[0])
            start = i + 1
    return names


def file_problems(files: DataFrame) -> DataFrame:
    """(path, problem) of the files of archives that are not read: ``unreadable`` JSON, or ``unknown fields``."""
    kind = F.regexp_extract("path", _LAYOUT, 0)
    known = files.filter(kind != "").select("path", "content", *[F.regexp_extract("path", _LAYOUT, n).alias(name) for n, name in ((2, "manifest"), (3, "observations"), (4, "documents"))])
    keys = lambda m: F.map_keys(m)
    extra = lambda m, fields: F.size(F.array_except(keys(m), F.array(*map(F.lit, _names(fields))))) > 0
    listed = lambda text: F.from_json(text, "array<map<string,string>>")
    whole = F.from_json("content", "map<string,string>")
    objects = listed(F.col("content"))
    facts = listed(F.get_json_object("content", "$.facts"))
    is_list = F.col("observations") != ""
    broken = F.when(is_list, F.try_parse_json("content").isNull() | objects.isNull()).otherwise(F.try_parse_json("content").isNull() | whole.isNull())
    unknown = (
        F.when(F.col("manifest") != "", extra(whole, MANIFEST))
        .when(is_list, F.exists(objects, lambda m: extra(m, OBSERVATION)))
        .otherwise(extra(whole, DOCUMENT) | F.coalesce(F.exists(facts, lambda m: extra(m, FACT)), F.lit(False)))
    )
    found = known.select("path", F.when(broken, "unreadable").when(unknown, "unknown fields").alias("problem"))
    return found.filter("problem is not null")


def parse_archive(files: DataFrame, strict: bool = True) -> Archive:
    """The archives in ``files(path, content)``, as ``spark.read.text(folder, wholetext=True, recursiveFileLookup=True)`` gives them with their path.

    A folder with a manifest.json is an archive; beside it lie documents/*.json and observations.json, which
    may be missing or come in parts (observations-1.json).  A fact's position in its document is its index.
    Other files are passed over.  ``strict`` raises if a file cannot be read or has a field that is not known.
    """
    if strict:
        wrong = file_problems(files).limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"{r['path']}: {r['problem']}" for r in wrong))
    part = files.select("path", "content", F.regexp_extract("path", _LAYOUT, 1).alias("archive"), *[F.regexp_extract("path", _LAYOUT, n).alias(name) for n, name in ((2, "manifest"), (3, "observations"), (4, "documents"))])
    manifests = part.filter("manifest <> ''").select("archive", F.from_json("content", MANIFEST).alias("m")).select("archive", "m.*")
    part = part.join(manifests.select("archive"), "archive", "left_semi")
    documents = part.filter("documents <> ''").select("archive", F.from_json("content", DOCUMENT).alias("d")).select("archive", F.col("d.id").alias("document_id"), "d.*").drop("id")
    facts = documents.select("archive", "document_id", F.posexplode("facts").alias("fact_index", "f")).select("archive", "document_id", F.col("fact_index").cast("long").alias("fact_index"), "f.*")
    documents = documents.withColumn("n_facts", F.greatest(F.size("facts"), F.lit(0))).drop("facts")
    objects = F.from_json("content", f"array<struct<{OBSERVATION}>>")
    observations = part.filter("observations <> ''").select("archive", F.col("path").alias("file"), F.posexplode(objects).alias("position", "o")).select("archive", "file", "position", "o.*")
    observations = observations.withColumn("proof_count", F.coalesce("proof_count", F.lit(1)))
    # read once: every rule and every count goes over them again
    return Archive(*[materialise(df, name) for df, name in ((manifests, "manifests"), (documents, "archive-documents"), (facts, "archive-facts"), (observations, "archive-observations"))])


def archive_files(facts: DataFrame, texts: DataFrame, observations: DataFrame, claims: DataFrame, per_file: int = 500) -> DataFrame:
    """``files(path, content)`` of the archives of a store's tables.

    ``facts(archive_id, document_id, fact_index, <fields>)`` with one row a fact, ``texts(document_id, original_text)``,
    ``observations(archive_id, id, <fields>)``, ``claims(archive_id, source_bank_id, <counts of the manifest>)``.
    A document is one row, and observations come in parts of about ``per_file``, so that no row holds a bank.
    """
    each = F.to_json(F.struct(*[c for c in facts.columns if c not in ("archive_id", "document_id", "fact_index")]))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_index", each.alias("f")))), lambda x: x["f"]), ",")
    listed = facts.groupBy("archive_id", "document_id").agg(joined.alias("facts"))
    head = F.to_json(F.struct(F.col("document_id").alias("id"), "original_text"))
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"facts":['), "facts", F.lit("]}"))
    documents = listed.join(texts, "document_id", "left").select(F.concat("archive_id", F.lit("/documents/"), "document_id", F.lit(".json")).alias("path"), body.alias("content"))
    parts = observations.withColumn("_part", F.floor(F.col("id") / per_file))
    fields = F.struct(*[c for c in observations.columns if c not in ("archive_id", "id")])
    many = parts.groupBy("archive_id", "_part").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", fields.alias("o")))), lambda x: x["o"]).alias("o"))
    many = many.select(F.concat("archive_id", F.lit("/observations-"), F.col("_part").cast("string"), F.lit(".json")).alias("path"), F.to_json("o").alias("content"))
    manifest = F.to_json(F.struct(*[c for c in claims.columns if c != "archive_id"]))
    return documents.unionByName(many).unionByName(claims.select(F.concat("archive_id", F.lit("/manifest.json")).alias("path"), manifest.alias("content")))


def _rule(name: str, rows: DataFrame, archive: str = "archive", document: Column | None = None, place: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(F.lit(name).alias("rule"), F.col(archive).alias("archive"), (none.cast("string") if document is None else document).alias("document_id"), (none.cast("long") if place is None else place.cast("long")).alias("place"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def integrity(found: Archive, hashes: DataFrame | None = None, schema_version: int = 1) -> DataFrame:
    """(rule, archive, document_id, place): what in an archive is not what its manifest or the system it came from says.

    ``hashes(document_id, content_hash, facts)`` are that system's documents, with a SHA-256 of the text and the number of facts.
    """
    m, doc, obs = found.manifests, F.col("document_id"), F.col("position")
    counted = m.select("archive")
    for frame, name in ((found.documents, "documents"), (found.facts, "facts"), (found.observations, "observations")):
        counted = counted.join(frame.groupBy("archive").agg(F.count(F.lit(1)).alias(name)), "archive", "left")
    both = m.join(counted.fillna(0), "archive")
    differs = lambda claim, real: both.filter(~F.coalesce(claim, F.lit(0)).eqNullSafe(F.col(real)))
    parts = [
        _rule("schema_version", m.filter(F.coalesce("schema_version", F.lit(1)) != schema_version)),
        _rule("document_count", differs("document_count", "documents")),
        _rule("fact_count", differs("fact_count", "facts")),
        _rule("observation_count", differs("observation_count", "observations")),
        _rule("no_original_text", found.documents.filter("original_text is null"), document=doc),
        _rule("observation_without_sources", found.observations.filter(F.coalesce(F.size("sources"), F.lit(0)) <= 0), document=F.col("file"), place=obs),
        _rule("observation_scopes", found.observations.filter("observation_scopes is not null"), document=F.col("file"), place=obs),
    ]
    if hashes is not None:
        met = found.documents.join(hashes.withColumnRenamed("document_id", "known_id"), doc == F.col("known_id"), "left")
        parts += [
            _rule("unknown_document", met.filter("known_id is null"), document=doc),
            _rule("content_hash", met.filter(F.col("original_text").isNotNull() & (F.sha2("original_text", 256) != F.col("content_hash"))), document=doc),
            _rule("facts_of_document", met.filter("n_facts <> facts"), document=doc),
        ]
    return _all(parts)


def importable(found: Archive) -> DataFrame:
    """(rule, archive, document_id, place): what forbids the import of an archive, found before anything is written."""
    m, doc, place = found.manifests, F.col("document_id"), F.col("fact_index")
    facts, obs = found.facts, F.col("position")
    parts = [_rule("archive_type", m.filter(F.coalesce("archive_type", F.lit("documents")) != "documents"))]
    parts += [_rule(c, m.filter(F.coalesce(c, F.lit(0)) != 0)) for c in ("mental_model_count", "directive_count", "webhook_count", "knowledge_page_count")]
    parts.append(_rule("includes_history", m.filter("includes_history")))
    parts.append(_rule("fact_scopes", facts.filter("observation_scopes is not null"), document=doc, place=place))
    named = facts.select("archive", "document_id", "fact_index", F.explode("causal_relations.target_fact_index").alias("target")).join(found.documents.select("archive", "document_id", "n_facts"), ["archive", "document_id"])
    parts.append(_rule("cause_out_of_range", named.filter("target < 0 or target >= n_facts").select("archive", "document_id", "fact_index").distinct(), document=doc, place=place))
    parts.append(_rule("unknown_type", facts.filter(~F.coalesce(F.col("fact_type").isin("world", "experience", "observation"), F.lit(False))), document=doc, place=place))
    wrong = lambda *names: F.array_contains(F.array(*[F.col(c).isNotNull() & iso_ms(F.col(c)).isNull() for c in names]), True)
    times = ("occurred_start", "occurred_end", "mentioned_at")
    parts.append(_rule("bad_time", facts.filter(wrong(*times)), document=doc, place=place))
    parts.append(_rule("no_date", facts.filter(F.coalesce(iso_ms(F.col("occurred_start")), iso_ms(F.col("mentioned_at"))).isNull()), document=doc, place=place))
    parts.append(_rule("no_date_of_observation", found.observations.filter(F.coalesce(iso_ms(F.col("occurred_start")), iso_ms(F.col("mentioned_at")), iso_ms(F.col("event_date"))).isNull()), document=F.col("file"), place=obs))
    asked = found.observations.select("archive", "file", "position", F.explode("sources").alias("s")).select("archive", "file", "position", "s.*")
    lost = asked.join(facts.select("archive", "document_id", "fact_index"), ["archive", "document_id", "fact_index"], "left_anti").select("archive", "file", "position").distinct()
    parts.append(_rule("source_unresolved", lost, document=F.col("file"), place=obs))
    return _all(parts)


CHECKS = (
    "banks", "documents", "nodes", "nodes.world", "nodes.experience", "nodes.observation", "caused_by", "node_sources", "node_tags", "entities", "node_entities",
    "documents_with_their_facts", "import_marker", "watermark", "embedding_coverage", "orphan_facts", "semantic_from_observations", "temporal_consistency",
)


def count_checks(
    facts: DataFrame, reports: DataFrame, banks: DataFrame, nodes: DataFrame, links: DataFrame, vectors: DataFrame, node_tags: DataFrame, node_entities: DataFrame, sources: DataFrame, model: str
) -> DataFrame:
    """(archive_id, check, expected, actual, state): the eighteen counts by which an import is judged, for every archive with a report.

    Expected are the archive's distinct facts, the import's report or a rule of our own; actual is what the store
    holds.  ``facts`` are rows of an archive, repeated or not; ``nodes`` name their ``archive_id``.
    """
    asked = reports.groupBy("archive_id").agg(F.min("bank_id").alias("bank_id"), F.max("watermark").alias("watermark"), F.max("node_sources").alias("node_sources"))
    asked = materialise(asked, "asked-archives")
    unique = materialise(facts.dropDuplicates(["archive_id", "document_id", "fact_index"]).select("archive_id", "document_id", "fact_index", "fact_type", "tags", "entities", "causal_relations"), "unique-facts")
    held = materialise(nodes.filter("archive_id is not null").select("id", "archive_id", "bank_id", "document_id", "fact_index", "fact_type", "event_date"), "held-nodes")
    of = lambda rows, check, side, value: rows.select("archive_id", F.lit(check).alias("check"), F.lit(side).alias("side"), value.cast("long").alias("n"))
    counted = lambda rows, check, side, value=F.count(F.lit(1)): of(rows.groupBy("archive_id").agg(value.alias("v")), check, side, F.col("v"))
    place = held.select(F.col("id").alias("node_id"), "archive_id")
    parts = [
        of(asked, "banks", "expected", F.lit(1)),
        of(asked.join(banks.select("bank_id"), "bank_id", "left_semi"), "banks", "actual", F.lit(1)),
        counted(unique, "documents", "expected", F.countDistinct("document_id")),
        counted(held, "documents", "actual", F.countDistinct("document_id")),
        counted(unique, "nodes", "expected"),
        counted(held, "nodes", "actual"),
    ]
    for kind in ("world", "experience", "observation"):
        parts += [counted(df, f"nodes.{kind}", side, F.count_if(F.col("fact_type") == kind)) for df, side in ((unique, "expected"), (held, "actual"))]
    named = unique.select("archive_id", "document_id", "fact_index", F.explode("causal_relations.target_fact_index").alias("target")).distinct().filter("target <> fact_index")
    real = named.join(unique.select("archive_id", "document_id", F.col("fact_index").alias("target")), ["archive_id", "document_id", "target"])
    ends = place.withColumnRenamed("node_id", "from_node_id")
    unique_links = links.select("from_node_id", "to_node_id", "link_type").distinct()
    caused = unique_links.filter("link_type = 'caused_by'").join(ends, "from_node_id").join(place.select(F.col("node_id").alias("to_node_id")), "to_node_id", "left_semi")
    parts += [counted(real, "caused_by", "expected"), counted(caused, "caused_by", "actual")]
    backed = sources.distinct().join(nodes.select(F.col("id").alias("observation_id"), "bank_id"), "observation_id").join(asked.select("archive_id", "bank_id"), "bank_id")
    parts += [of(asked, "node_sources", "expected", F.col("node_sources")), counted(backed, "node_sources", "actual")]
    tags = unique.select("archive_id", F.size(F.filter(F.array_distinct("tags"), lambda x: x.isNotNull())).alias("k")).filter("k > 0")
    parts += [counted(tags, "node_tags", "expected", F.sum("k")), counted(node_tags.distinct().join(place, "node_id"), "node_tags", "actual")]
    names = unique.select("archive_id", "document_id", "fact_index", F.explode("entities").alias("e")).select("archive_id", "document_id", "fact_index", normalise_name(F.col("e")).alias("name")).filter("name <> ''").distinct()
    members = node_entities.select("node_id", "entity_id").distinct().join(place, "node_id")
    parts += [counted(names, "entities", "expected", F.countDistinct("name")), counted(members, "entities", "actual", F.countDistinct("entity_id"))]
    parts += [counted(names, "node_entities", "expected"), counted(members, "node_entities", "actual")]
    wanted = unique.groupBy("archive_id", "document_id").agg(F.count(F.lit(1)).alias("e"))
    stored = held.filter("document_id is not null").groupBy("archive_id", "document_id").agg(F.count(F.lit(1)).alias("a"))
    right = wanted.join(stored, ["archive_id", "document_id"], "left")
    parts += [counted(right, "documents_with_their_facts", "expected"), counted(right, "documents_with_their_facts", "actual", F.count_if(F.col("e") == F.col("a")))]
    marked = asked.join(banks.filter(F.get_json_object("disposition", "$.import.state") == "done").select("bank_id"), "bank_id", "left_semi")
    parts += [of(asked, "import_marker", "expected", F.lit(1)), of(marked, "import_marker", "actual", F.lit(1))]
    last = held.groupBy("archive_id").agg(F.max("id").alias("last"))
    passed = asked.join(last, "archive_id", "left").filter(F.col("watermark") >= F.coalesce("last", F.lit(0)))
    parts += [of(asked, "watermark", "expected", F.lit(1)), of(passed, "watermark", "actual", F.lit(1))]
    own = vectors.filter(F.col("embedding").isNotNull() & (F.col("embedding_model") == model)).select("node_id").distinct()
    parts.append(counted(place.join(own, "node_id", "left_anti"), "embedding_coverage", "actual"))
    parts.append(counted(held.filter("document_id is null and fact_type <> 'observation'"), "orphan_facts", "actual"))
    seen = held.filter("fact_type = 'observation'").select(F.col("id").alias("from_node_id"), "archive_id")
    parts.append(counted(unique_links.filter("link_type = 'semantic'").join(seen, "from_node_id"), "semantic_from_observations", "actual"))
    parts.append(counted(temporal_differences(held, links).join(ends, "from_node_id"), "temporal_consistency", "actual"))
    sums = _all(parts).groupBy("archive_id", "check").agg(*[F.sum(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("expected", "actual")])
    every = asked.select("archive_id", F.explode(F.array(*map(F.lit, CHECKS))).alias("check")).join(sums, ["archive_id", "check"], "left").fillna(0, ["expected", "actual"])
    fine = F.when(F.col("expected") == F.col("actual"), "pass").otherwise("fail")
    return every.withColumn("state", fine)


def legacy_join(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(row_id, id): facts of an archive and the nodes whose metadata names them as what they were made of."""
    path = lambda key: F.get_json_object("metadata", f"$.legacy.{key}")
    made = nodes.select("id", path("document_id").alias("document_id"), path("fact_index").cast("long").alias("fact_index")).filter("document_id is not null")
    return facts.select("row_id", "document_id", "fact_index").join(made, ["document_id", "fact_index"]).select("row_id", "id")


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left_value, right_value) of the fields in which rows of the same key differ, nulls being equal."""
    pairs = left.select(key, *[F.col(c).cast("string").alias(f"l_{c}") for c in fields]).join(right.select(key, *[F.col(c).cast("string").alias(f"r_{c}") for c in fields]), key)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value")) for c in fields]))
    rows = pairs.select(key, each.alias("x")).select(key, "x.*")
    return rows.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
