"""Framed hashes and logic identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names


def framed(*fields: Column) -> Column:
    """Fields end to end, each after its length in bytes; a NULL has a mark of its own."""
    return F.concat(*(F.when(f.isNull(), "N;").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f, F.lit(";"))) for f in fields))


def framed_hash(*fields: Column) -> Column:
    return F.sha2(framed(*fields), 256)


def map_hash(m: Column) -> Column:
    """Hash of a map's size and its entries in key order."""
    entries = F.array_sort(F.map_entries(m))
    body = F.array_join(F.transform(entries, lambda e: framed(e["key"], e["value"])), "")
    return framed_hash(F.size(m).cast("string"), body)


def logic_identity(sql_hash: Column, values_hash: Column, namespace_hash: Column, execution_id: Column) -> Column:
    """What names the logic of a build: its SQL and values, else its namespace identity, else the execution."""
    return F.coalesce(
        F.concat(F.lit("sql:"), sql_hash, F.lit(":"), F.coalesce(values_hash, F.lit(""))),
        F.concat(F.lit("ns:"), namespace_hash),
        F.concat(F.lit("execution:"), execution_id.cast("string")),
    )


def logic_hash(version: Column, dialect: Column, catalog: Column, schema: Column, sql: Column, extras: Column, deps: Column) -> Column:
    """Strict identity: all settings, exact SQL text, extras and dependencies.

    A dependency (name, query, catalog, schema) counts with where its definition resolves
    names, as the same text reads other relations in another schema.
    """
    return framed_hash(version, dialect, catalog, schema, F.lit("rendered"), sql, map_hash(extras), *listed_dependencies(deps))


def listed_dependencies(deps: Column) -> tuple[Column, Column]:
    """How many dependencies there are, and all of them in order, framed."""
    each = F.array_sort(F.transform(deps, lambda d: F.struct(d["name"].alias("name"), d["query"].alias("query"), d["catalog"].alias("catalog"), d["schema"].alias("schema"))))
    return F.size(deps).cast("string"), F.array_join(F.transform(each, lambda d: framed(d["name"], d["query"], d["catalog"], d["schema"])), "")


def template_hash(version: Column, dialect: Column, catalog: Column, schema: Column, body: Column, extras: Column, deps: Column, config_signature: Column, macros: Column) -> Column:
    """Identity by the unrendered body instead of the SQL.

    On databricks the declared configuration's signature and the macros' stand for the
    extras, and body and signature count in lower case; an absent macros hash differs from
    an empty one.
    """
    databricks = names.warehouse_family(dialect) == "databricks"
    declared = framed(F.lit("declared-config-signature"), F.lower(F.coalesce(config_signature, F.lit(""))), F.when(macros.isNull(), "macros-absent").otherwise("macros-present"), F.coalesce(macros, F.lit("")))
    settings = F.when(databricks, declared).otherwise(framed(map_hash(extras)))
    return framed_hash(version, F.lower(dialect), catalog, schema, F.lit("template"), F.when(databricks, F.lower(body)).otherwise(body), settings, *listed_dependencies(deps))


def schema_abstracted(
    version: Column, dialect: Column, sql: Column, default_schema: Column, extras: Column, deps: Column, keys: Column, tokens: Column, known: Column
) -> Column:
    """Identity of a submission with the schemas of its dependencies' names replaced by tokens.

    Each dependency's name, part by part, stays with its definition, so definitions that
    change places change the identity; the default schema counts by its token. ``sql`` and the
    query of ``deps`` (parts, query) come as :func:`names.text_pieces`, which are the same in
    all readings; ``known`` is :func:`names.schema_map` of the reading. Lexical: a known name
    within a literal is replaced too, in all environments alike.
    """
    token = lambda schema: F.coalesce(F.get(tokens, (F.array_position(keys, schema) - 1).cast("int")), F.lit(""))

    def bound(d):
        parts = d["parts"]
        shown = F.transform(parts, lambda p, i: F.when((F.size(parts) == 3) & (i == 1), token(p)).otherwise(p))
        return F.concat(framed(F.size(parts).cast("string")), F.array_join(F.transform(shown, lambda p: framed(p)), ""), framed(names.mapped_text(d["query"], known)))

    listed = F.array_join(F.array_sort(F.transform(deps, bound)), "")
    return framed_hash(version, F.lower(dialect), token(names.schema_key(default_schema)), names.mapped_text(sql, known), map_hash(extras), F.size(deps).cast("string"), listed)


def seed_hash(dialect: Column, catalog: Column, extras: Column) -> Column:
    """Identity of a seed; its values are compared apart."""
    return framed_hash(dialect, catalog, map_hash(extras))


def identity_matches(rendered: Column, rendered_other: Column, template: Column, template_other: Column) -> Column:
    """Equal rendered identities, or equal templates where there is one."""
    return F.coalesce(rendered == rendered_other, F.lit(False)) | F.coalesce(template == template_other, F.lit(False))


def scd_id(key: Column, updated: Column) -> Column:
    """md5 of key and time, the time without trailing zeros of its fraction."""
    return F.md5(F.concat_ws("|", key, F.regexp_replace(F.date_format(updated, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")))
