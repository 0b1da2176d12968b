"""Names, identifiers and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: separators after which a motif name carries remarks.
NAME_BREAK = r"[\s(,;/]+"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def strip_version(c: Column) -> Column:
    """Identifier without anything after its first dot."""
    return F.split_part(_text(c), F.lit("."), F.lit(1))


def canonical_token(c: Column) -> Column:
    """Upper-case identifier without version."""
    return F.upper(strip_version(c))


def parse_interval(c: Column) -> Column:
    """STRUCT(chrom, start, end) of ``chrom:start-end``; NULL when the separators are missing.

    Non-numeric coordinates fail the job, as they point to a broken file.
    """
    coords = F.substring_index(c, ":", 1)
    rest = F.substr(c, F.length(coords) + 2)
    start = F.substring_index(rest, "-", 1)
    end = F.substr(rest, F.length(start) + 2)
    whole = F.contains(c, F.lit(":")) & F.contains(c, F.lit("-"))
    return F.when(
        whole, F.struct(coords.alias("chrom"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
    )


def format_interval(c: Column) -> Column:
    text = F.concat(c["chrom"], F.lit(":"), c["start"].cast("string"), F.lit("-"), c["end"].cast("string"))
    return F.coalesce(text, F.lit(""))


def interval_center(c: Column) -> Column:
    return F.floor((c["start"] + c["end"]) / F.lit(2)).cast("bigint")


def anchor_distance(anchor: Column, interval: Column) -> Column:
    """Absolute distance of an interval's middle to the anchor start; NaN when either is missing."""
    return F.coalesce(F.abs(interval_center(interval) - anchor["start"]).cast("double"), F.lit(float("nan")))


def attribute_map(c: Column) -> Column:
    """MAP of ``key "value"; key "value"`` attributes, the last of equal keys winning."""
    chunks = F.filter(F.transform(F.split(c, ";"), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit(" ")))
    entry = lambda p: F.struct(
        F.substring_index(p, " ", 1).alias("key"),
        F.regexp_replace(F.trim(F.substr(p, F.length(F.substring_index(p, " ", 1)) + 2)), r'^"+|"+$', "").alias("value"),
    )
    empty = F.create_map().cast("map<string,string>")
    put = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"]))
    return F.aggregate(F.transform(chunks, entry), empty, put)


def motif_tokens(c: Column) -> Column:
    """Canonical symbols in a motif name: dimer parts split by ``::``, remarks dropped, distinct in order."""
    parts = F.split(_text(c), "::")
    first = F.transform(parts, lambda p: canonical_token(F.get(F.split(F.trim(p), NAME_BREAK), F.lit(0))))
    return F.array_distinct(F.filter(first, lambda t: t != ""))


def module_of_path(path: Column) -> Column:
    """Module name (file stem) of an expression file."""
    return F.regexp_extract(path, r"(module_[^/]*_expression)\.csv", 1)


def module_id(name: Column) -> Column:
    return F.regexp_extract(name, r"^module_(.*)_expression$", 1)


def support_label(strong: Column, promoter: Column, distal: Column) -> Column:
    """Reasons joined by ``|``; ``supported`` when none applies."""
    # Reason names.
    reasons = F.array_compact(F.array(
        F.when(strong, F.lit("strong_rna")),
        F.when(promoter, F.lit("ambiguous_with_promoter")),
        F.when(distal, F.lit("ambiguous_with_distal")),
    ))
    return F.when(F.size(reasons) == 0, F.lit("supported")).otherwise(F.array_join(reasons, "|"))
