"""Text expressions: fuzzy matching, links, prompt records, human-readable numbers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.vectors import nearest_units, once

NOT_ALNUM = r"[^\p{L}\p{Nd}]+"


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the lower-cased words, each padded `  word `."""
    words = F.filter(F.split(F.lower(text), NOT_ALNUM), lambda w: w != "")
    pieces = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.length(w)),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i + 1, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(pieces))


def term_trigrams(term: str) -> list[str]:
    """The same pieces for a search term known to the driver."""
    spaced = "".join(
        c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " "
        for c in term.lower()
    )
    padded = [f"  {word} " for word in spaced.split()]
    return sorted({p[i : i + 3] for p in padded for i in range(len(p) - 2)})


def shares_piece(text: Column, term: str) -> Column:
    """Whether a text has any piece of the term, by one regular expression over its words."""
    edge = r"(?:^|$|[^\p{L}\p{Nd}])"
    options = []
    for piece in term_trigrams(term):
        letters = piece.strip()
        options.append(
            (edge if piece.startswith(" ") else "") + letters + (edge if piece.endswith(" ") else "")
        )
    return F.lower(text).rlike("|".join(options)) if options else F.lit(False)


def trigram_similarity(text: Column, other: Column | str) -> Column:
    """Shared pieces over all pieces of both texts; 0 when neither has any."""
    mine = trigrams(text)
    if isinstance(other, str):
        pieces = term_trigrams(other)
        theirs = F.array(*[F.lit(p) for p in pieces]).cast("array<string>")
    else:
        theirs = trigrams(other)
    shared = F.size(F.array_intersect(mine, theirs))
    total = F.size(mine) + F.size(theirs) - shared
    return F.when(text.isNull(), F.lit(None)).otherwise(
        F.when(total == 0, F.lit(0.0)).otherwise(shared / total)
    ).cast("double")


def escape_like(text: Column) -> Column:
    """Put a backslash before each LIKE wildcard."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def contains_ignore_case(text: Column, term: str) -> Column:
    """ILIKE '%term%' with the term taken literally."""
    return F.contains(F.lower(text), F.lower(F.lit(term)))


def percent_encode(text: Column) -> Column:
    """Percent-encoding of a URI component (letters, digits and - _ . ! ~ * ' ( ) stay)."""
    out = F.url_encode(text)
    for coded, plain in [
        ("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ]:
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def magnet_link(hex_id: Column, name: Column) -> Column:
    label = F.when(
        name.isNotNull() & (name != ""), F.concat(F.lit("&dn="), percent_encode(name))
    ).otherwise(F.lit(""))
    return F.concat(F.lit("magnet:?xt=urn:btih:"), hex_id, label)


def input_text(
    name: Column,
    file_count: Column,
    total_size: Column,
    dirs: Column,
    max_name: int = 300,
    max_dirs: int = 10,
    max_dir: int = 100,
) -> Column:
    """The text a row is embedded as (its wording is a fixed value)."""
    head = F.transform(F.slice(dirs, 1, max_dirs), lambda d: F.substring(d, 1, max_dir))
    return F.concat(
        F.lit("Name: "), F.coalesce(F.substring(name, 1, max_name), F.lit("")),
        F.lit("\nFiles: "), F.coalesce(file_count, F.lit(0)).cast("string"),
        F.lit("  Size: "), F.coalesce(total_size, F.lit(0)).cast("string"),
        F.lit("\nTop dirs: "), F.coalesce(F.array_join(head, ", "), F.lit("")),
    )


def xml_escape(text: Column, max_chars: int) -> Column:
    """Cut first, then escape, so an entity is never split."""
    out = F.substring(text, 1, max_chars)
    for char, entity in [
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"),
    ]:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def xml_record(
    hex_id: Column,
    name: Column,
    file_count: Column,
    total_size: Column,
    files: Column,
    max_name: int = 500,
    max_files: int = 20,
    max_file: int = 200,
) -> Column:
    """The XML block that describes a row to a text model (tags and layout are fixed values)."""
    entries = F.transform(
        F.slice(F.coalesce(files, F.array().cast("array<string>")), 1, max_files),
        lambda f: F.concat(F.lit("  <file>"), xml_escape(f, max_file), F.lit("</file>")),
    )

    def line(tag: str, value: Column) -> list[Column]:
        return [F.lit(f"  <{tag}>"), value, F.lit(f"</{tag}>\n")]

    return F.concat(
        F.lit("<torrent>\n"),
        *line("infohash", xml_escape(F.coalesce(hex_id, F.lit("")), 64)),
        *line("name", xml_escape(F.coalesce(name, F.lit("")), max_name)),
        *line("file_count", F.coalesce(file_count, F.lit(0)).cast("string")),
        *line("total_size_bytes", F.coalesce(total_size, F.lit(0)).cast("string")),
        F.lit("  <files>\n"), F.array_join(entries, "\n"), F.lit("\n  </files>\n"),
        F.lit("</torrent>"),
    )


def _one_decimal(value: Column) -> Column:
    """Non-negative number with one decimal; exact halves go up."""
    tenths = once(value, lambda v: nearest_units(v, 1, half_up=True))
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")
    )


def human_size(n: Column) -> Column:
    """Base-1024 size with one decimal, in the largest unit up to TB."""
    out = F.when(n.isNull(), F.lit("—")).when(
        n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    )
    units = ["KB", "MB", "GB", "TB"]
    for power, unit in enumerate(units, 1):
        text = F.concat(_one_decimal(n / F.lit(float(1024 ** power))), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == units[-1] else out.when(n < 1024 ** (power + 1), text)
    return out


def human_number(n: Column) -> Column:
    """Number with one decimal in k or M, else rounded to a whole one."""
    value = n.cast("double")
    return (
        F.when(n.isNull(), F.lit("—"))
        .when(value >= 1e6, F.concat(_one_decimal(value / 1e6), F.lit("M")))
        .when(value >= 1e3, F.concat(_one_decimal(value / 1e3), F.lit("k")))
        .otherwise(F.floor(value + 0.5).cast("string"))
    )
