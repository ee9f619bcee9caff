"""The whole way: detect, resolve, group, name, mask, and restore; one document scope or one for the corpus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.pseudonyms import Pools, pseudonyms
from turnwise.operators.entities import entity_clusters, restored
from turnwise.operators.pii import detected, disjoint_spans, entity_type, refined_type, spliced, usable, with_best_label
from turnwise.sources.tables import written

# Words that are no persons, and, besides these, no entities.
PERSONS = (
    "elle elles il ils on je tu nous vous toi moi lui leur leurs quelqu'un personne personnes chacun aucun quand pourquoi comment merci bonjour soir matin midi relance relances relancer moral morale "
    "cooptation rupture serfa serfas cerfa cerfas"
).split()
GENERIC = PERSONS + (
    "sms whatsapp mail mails email emails tennis lundi mardi mercredi jeudi vendredi samedi dimanche client clients organisation organisations entreprise "
    "entreprises avocat avocats cabinet ligne telephone téléphone compte entrepreneur entrepreneuriat contact contacts"
).split()
# Surfaces that are left alone.
WHITELIST = (
    "cabinet télétravail donc voilà ok oui non c'est c'était sms whatsapp mail internet email objectif dossier dossiers facture factures poste envie step univers conseil tresor trésor ouh euh bah"
).split()


def domain_labels(entries: Iterable[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """The catalog's own form and type of each value, by its small letters; of several the last stands."""
    return {p.lower(): (p, label) for p, label in entries if p}


def resolved(spans: DataFrame, entries: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Disjoint spans with surface and label: types normalised, unusable surfaces dropped, one label a surface.

    A surface of the catalog has the catalog's type, unless its neighbours show a common noun.
    """
    domain = domain_labels(entries)
    low = F.lower("surface")
    typed = spans.withColumn("entity_type", entity_type(F.col("entity_type"))).withColumn("surface_lower", low)
    if domain:
        known = spans.sparkSession.createDataFrame([(k, label) for k, (_, label) in domain.items()], "surface_lower string, _label string")
        typed = typed.join(known, "surface_lower", "left")  # an equi-join instead of a long list in the plan
    else:
        typed = typed.withColumn("_label", F.lit(None).cast("string"))
    own = F.col("_label").isNotNull()
    good = usable(typed, PERSONS, GENERIC, WHITELIST, own)
    refined = good.withColumn("entity_type", F.when(own & ~F.col("common"), entity_type(F.col("_label"))).otherwise(refined_type(F.col("surface"), F.col("entity_type"))))
    picked = disjoint_spans(with_best_label(refined).select("doc_id", "start", "end", F.col("label").alias("entity_type"), "score", "source", "ord", "surface"))
    return picked.withColumnRenamed("entity_type", "label")


def anonymized(docs: DataFrame, catalog: Iterable[tuple[str, str]] = (), given: DataFrame | None = None, pools: Pools = Pools()) -> tuple[DataFrame, DataFrame]:
    """Masked texts (doc_id, text, masked, n_spans) and the mapping (doc_id, tag, label, canonical, pseudonym, surface)."""
    entries = list(catalog)
    domain = {k: p for k, (p, _) in domain_labels(entries).items()}
    spans = written(resolved(detected(docs, entries, given), entries), "spans")
    clusters = written(entity_clusters(spans, domain), "entities")
    keys = clusters.select(F.col("doc_id").alias("scope"), "label", F.col("canonical").alias("key"), "first_pos").groupBy("scope", "label", "key").agg(F.min("first_pos").alias("first_pos"))
    names = pseudonyms(keys, pools).withColumnsRenamed({"scope": "doc_id", "key": "canonical"})
    mapping = clusters.join(names, ["doc_id", "label", "canonical"]).select("doc_id", "tag", "label", "canonical", "pseudonym", "surface")
    values = spans.join(mapping.select("doc_id", "label", "surface", "pseudonym"), ["doc_id", "label", "surface"])
    # The surface without quotes may be shorter than the span; the span is replaced whole.
    masked = spliced(docs, values.select("doc_id", "start", "end", F.col("pseudonym").alias("value"))).withColumnRenamed("text", "masked")
    counts = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"))
    out = docs.select("doc_id", "text").join(masked, "doc_id").join(counts, "doc_id", "left")
    return out.withColumn("n_spans", F.coalesce("n_spans", F.lit(0))), mapping


def unmasked(masked: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, text with pseudonyms and tags put back to their canonical forms."""
    keys = mapping.select("doc_id", F.col("pseudonym").alias("key"), F.col("canonical").alias("value")).unionByName(mapping.select("doc_id", F.col("tag").alias("key"), F.col("canonical").alias("value")))
    return restored(masked.select("doc_id", F.col("masked").alias("text")), keys.distinct())
