"""Extraction of entities and relations into the closed schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import ENTITY_LABELS, RELATION_TYPES, VALID_TRIPLES
from loomgraph.functions.folds import computed_once
from loomgraph.functions.text import col, normalize_label, safe_json, strip

#: Fixed value: capitalised terms of one or two words.
CAPITALS = r"\b([A-Z][A-Za-z0-9]+(?:\s[A-Z][A-Za-z0-9]+)?)\b"
EXTRACTION = "struct<entities:array<struct<name:string,label:string,aliases:array<string>,summary:string>>,relations:array<struct<subject:string,relation:string,object:string>>>"


def allowed_triples() -> list[tuple[str, str, str]]:
    """The closed schema with its wildcard written out, so that a look-up is an equality."""
    out = set()
    for s, r, o in VALID_TRIPLES:
        for a in [*ENTITY_LABELS, "Document", "Entity"] if s == "Entity" else [s]:
            for b in [*ENTITY_LABELS, "Entity"] if o == "Entity" else [o]:
                out.add((a, r, b))
    return sorted(out)


def is_valid_triple(subject_label: Column | str, relation: Column | str, object_label: Column | str) -> Column:
    key = F.concat_ws("|", col(subject_label), col(relation), col(object_label))
    return key.isin(["|".join(t) for t in allowed_triples()]) & col(relation).isin(RELATION_TYPES)


def capitalised_names(text: Column | str, most: int = 6) -> Column:
    """The first distinct capitalised terms of one or two words, without articles."""
    found = F.regexp_extract_all(col(text), F.lit(CAPITALS), F.lit(1))
    kept = F.filter(found, lambda c: ~F.lower(c).isin("the", "this", "a", "an"))
    return F.slice(F.array_distinct(kept), 1, most)


def heuristic_extraction(text: Column | str) -> Column:
    """The offline provider: capitalised terms are Concepts, each relates to the next."""
    return computed_once(capitalised_names(text), _chained)


def _chained(names: Column) -> Column:
    """An EXTRACTION of names as Concepts, each of which relates to the next."""
    entities = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("Concept").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit("").alias("summary")))
    later = F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), later, lambda a, b: F.struct(a.alias("subject"), F.lit("RELATES_TO").alias("relation"), b.alias("object")))
    return F.struct(entities.alias("entities"), pairs.alias("relations"))


def _items(data: Column, field: str) -> Column:
    """The elements of a list field as variants; empty for anything else."""
    return F.coalesce(F.try_variant_get(data, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))


def _text(item: Column, field: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(item, f"$.{field}", "string"), F.lit("")))


def validated(raw: Column | str) -> Column:
    """A model's answer as an EXTRACTION: malformed elements are left out, labels normalised, relations kept only
    between declared entities and within the closed schema; anything unreadable is empty."""
    data = safe_json(raw)
    objects = lambda field: F.filter(_items(data, field), lambda x: F.schema_of_variant(x).startswith("OBJECT"))

    def entity(x: Column) -> Column:
        aliases = F.coalesce(F.try_variant_get(x, "$.aliases", "array<string>"), F.array().cast("array<string>"))
        label = F.coalesce(F.try_variant_get(x, "$.label", "string"), F.lit("Concept"))
        clean = F.filter(F.transform(aliases, lambda a: strip(a)), lambda a: a != "")
        return F.struct(_text(x, "name").alias("name"), normalize_label(label).alias("label"), clean.alias("aliases"), _text(x, "summary").alias("summary"))

    def relation(x: Column) -> Column:
        return F.struct(_text(x, "subject").alias("subject"), F.upper(_text(x, "relation")).alias("relation"), _text(x, "object").alias("object"))

    entities = F.filter(F.transform(objects("entities"), entity), lambda e: e["name"] != "")
    relations = F.transform(objects("relations"), relation)

    def label_of(name: Column) -> Column:  # the last declaration counts
        return F.try_element_at(F.filter(entities, lambda e: e["name"] == name), F.lit(-1))["label"]

    def kept(r: Column) -> Column:
        fits = is_valid_triple(label_of(r["subject"]), r["relation"], label_of(r["object"]))
        declared = F.exists(entities, lambda e: e["name"] == r["subject"]) & F.exists(entities, lambda e: e["name"] == r["object"])
        return (r["subject"] != "") & (r["object"] != "") & (r["subject"] != r["object"]) & declared & F.coalesce(fits, F.lit(False))

    return F.struct(entities.alias("entities"), F.filter(relations, kept).alias("relations"))


def extraction_prompt(text: Column | str) -> Column:
    labels, relations = ", ".join(ENTITY_LABELS), ", ".join(RELATION_TYPES)
    triples = "\n".join(f"({s})-[{r}]->({o})" for s, r, o in VALID_TRIPLES)
    intro = f"Name the entities of the text and how they relate, as one JSON object with the lists entities and relations.\nLabels: {labels}\nRelations: {relations}\nPossible:\n{triples}\n\nText:\n"
    return F.concat(F.lit(intro), col(text))


def with_answers(rows: DataFrame, prompt: str, complete: Callable[[str], str], out: str = "answer", calls: int = 4, error: str = "error", done=None) -> DataFrame:
    """Adds a model's answer and `error` (data, not an exception) to every row; the order of rows stays.

    complete runs on the executors; up to `calls` of a task overlap.
    """
    from pyspark.sql.types import StringType

    from loomgraph.providers import with_calls

    return with_calls(rows, prompt, complete, out, StringType(), calls, error, done)


def graph_rows(chunks: DataFrame, extraction: str = "extraction", order: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entity rows (in order), mention calls and relations of chunks (id, order, an EXTRACTION)."""
    entities = chunks.select("id", F.col(order).alias("_o"), F.posexplode(f"{extraction}.entities").alias("_p", "e"))
    rows = entities.select("e.name", "e.label", "e.aliases", "e.summary", F.struct("_o", "_p").alias("ord"))
    calls = entities.select(F.col("id").alias("chunk_id"), F.col("e.name").alias("entity"))
    relations = chunks.select(F.explode(f"{extraction}.relations").alias("r")).select("r.*").distinct()
    return rows, calls, relations
