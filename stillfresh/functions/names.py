"""Relation names, scopes and NULL-safe tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = r'"(?:[^"]|"")*"|[^.]+'
PLAIN_THREE = r"^[A-Za-z_][A-Za-z0-9_$]*\.[A-Za-z_][A-Za-z0-9_$]*\.[A-Za-z_][A-Za-z0-9_$]*$"


def warehouse_family(warehouse: Column) -> Column:
    """First comma part, trimmed and lower-cased; spark counts as databricks."""
    first = F.lower(F.trim(F.substring_index(warehouse, ",", 1)))
    return F.when(first == "spark", "databricks").otherwise(first)


def physical_key(target: Column) -> Column:
    """The lower-cased name for three plain parts (backquotes dropped), else the name as it stands."""
    bare = F.replace(target, F.lit("`"), F.lit(""))
    return F.when(bare.rlike(PLAIN_THREE), F.lower(bare)).otherwise(target)


def with_scope_keys(df: DataFrame, warehouse: str = "warehouse", target: str = "target") -> DataFrame:
    """Adds ``family`` and ``target_key`` to every row."""
    return df.withColumns({"family": warehouse_family(F.col(warehouse)), "target_key": physical_key(F.col(target))})


def empty_as_null(c: Column) -> Column:
    return F.when(c != "", c)


def in_scope(df: DataFrame, org: str, family: str, namespace: str | None) -> DataFrame:
    """Confirmed rows of one org, warehouse family and namespace; '' and NULL are one namespace."""
    return df.filter(
        (F.col("org_id") == org) & F.col("confirmed_ms").isNotNull() & (F.col("family") == family)
        & empty_as_null(F.col("namespace")).eqNullSafe(empty_as_null(F.lit(namespace).cast("string")))
    )


def eq_ns(a: Column, b: Column) -> Column:
    """Equal, or both NULL."""
    return a.eqNullSafe(b)


def not_modified_since(current: Column, recorded: Column) -> Column:
    """Both known, and the current epoch not after the recorded one."""
    return F.coalesce(current <= recorded, F.lit(False))


def complete_deps(deps: Column) -> Column:
    """Names and queries of all dependencies are non-blank, names differ."""
    filled = F.forall(deps, lambda d: (F.coalesce(F.trim(d["name"]), F.lit("")) != "") & (F.coalesce(F.trim(d["query"]), F.lit("")) != ""))
    names = F.transform(deps, lambda d: d["name"])
    return filled & (F.size(F.array_distinct(names)) == F.size(names))


def name_parts(name: Column) -> Column:
    """Parts of a dotted name; a quoted part may hold dots."""
    return F.regexp_extract_all(name, F.lit(f"({PART})"), 1)


def canon_ident(ident: Column) -> Column:
    """Unquoted identifiers in upper case, quoted ones exactly."""
    quoted = ident.rlike('^".*"$')
    return F.when(quoted, F.replace(F.substring(ident, F.lit(2), F.length(ident) - 2), F.lit('""'), F.lit('"'))).otherwise(F.upper(ident))


def schema_of(name: Column) -> Column:
    """The middle part of a three-part name, else NULL."""
    parts = name_parts(name)
    return F.when(F.size(parts) == 3, F.element_at(parts, 2))


def schema_tokens(schemas: Column) -> Column:
    """The distinct schemas in order: a schema's place less one is its token."""
    return F.array_sort(F.array_distinct(F.array_compact(schemas)))


def abstract_name(name: Column, tokens: Column) -> Column:
    """A three-part name with its schema replaced by its token among the request's schemas."""
    parts = name_parts(name)
    token = F.array_position(tokens, F.element_at(parts, 2)) - 1
    return F.when(F.size(parts) == 3, F.concat_ws(".", F.element_at(parts, 1), F.concat(F.lit("ns__"), token.cast("string")), F.element_at(parts, 3))).otherwise(name)


def same_object_other_schema(a: Column, b: Column) -> Column:
    """Both in three parts, equal but for the schema."""
    x, y = name_parts(a), name_parts(b)
    return F.coalesce((F.size(x) == 3) & (F.size(y) == 3) & (x[0] == y[0]) & (x[2] == y[2]) & (x[1] != y[1]), F.lit(False))


def mentions(text: Column, ident: Column) -> Column:
    """Whether a text has the identifier as a whole word, in any case."""
    escaped = F.regexp_replace(F.lower(ident), r"([^a-z0-9_])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z0-9_$])"), escaped, F.lit("(?![a-z0-9_$])")))


def schema_key(schema: Column) -> Column:
    """A schema as warehouses compare it; an empty one is NULL."""
    return canon_ident(empty_as_null(schema))


#: Pieces that a text falls into: chains of dotted names, and what stands between them.
PIECE = r'(?s)\.*(?:"(?:[^"]|"")*"|[A-Za-z0-9_$]+)(?:\.(?:"(?:[^"]|"")*"|[A-Za-z0-9_$]+))*|[^A-Za-z0-9_$".]+|.'
JOIN = "\x02"


def canonical_parts(name: Column) -> Column:
    return F.transform(name_parts(name), canon_ident)


def text_pieces(text: Column) -> Column:
    """The text as an array of (text, key, rest): one fixed pattern, whatever names are looked for.

    A chain of three names or more has a ``key``, its first three as warehouses compare them, and
    ``rest``, what follows them; other pieces have neither.
    """

    def chain(piece, parts):
        key = F.array_join(F.transform(F.slice(parts, 1, 3), canon_ident), JOIN)
        rest = F.array_join(F.transform(F.slice(parts, 4, 1_000), lambda p: F.concat(F.lit("."), p)), "")
        return F.struct(piece.alias("text"), F.when(F.size(parts) >= 3, key).alias("key"), F.when(F.size(parts) >= 3, rest).alias("rest"))

    def one(piece):
        named = F.when(piece.contains(".") & ~piece.startswith("."), name_parts(piece)).otherwise(F.array().cast("array<string>"))
        return F.get(F.transform(F.array(named), lambda parts: chain(piece, parts)), F.lit(0))

    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), one)


def schema_map(parts: Column, keys: Column, tokens: Column) -> Column:
    """A map from the keys of three-part names to the names with their schema's token.

    ``parts``: arrays of canonical parts; ``keys``: schemas by :func:`schema_key`; ``tokens``: their
    tokens, place by place. Other names are left out.
    """

    def one(p):
        token = F.get(tokens, (F.array_position(keys, F.get(p, 1)) - 1).cast("int"))
        return F.struct(F.array_join(p, JOIN).alias("key"), F.concat_ws(".", F.get(p, 0), F.concat(F.lit("\x01"), token), F.get(p, 2)).alias("to"))

    return F.map_from_entries(F.transform(F.array_distinct(F.filter(parts, lambda p: F.size(p) == 3)), one))


def mapped_text(pieces: Column, known: Column) -> Column:
    """The text of :func:`text_pieces` with its known names as in the map ``known``; names that aren't qualified stay."""
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.concat(F.try_element_at(known, x["key"]), x["rest"]), x["text"])), "")
