"""Column functions over names, URLs, texts and sizes. All of them stay JVM-side."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
DEFAULT_MIME_TYPE = "application/octet-stream"
FILE_TYPE_LABELS = {"application/pdf": "PDF", "text/plain": "TXT"}
SIZE_UNITS = ("B", "kB", "MB", "GB", "TB", "PB", "EB")
# Everything that ends a line, apart from the pair CR LF.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# --------------------------------------------------------------------------


def file_extension(name: Column) -> Column:
    """Last suffix with its dot; a leading-dot name such as ``.profile`` has none."""
    return F.regexp_extract(name, r"(?s)^(?:.*/)?\.*[^./][^/]*(\.[^./]*)$", 1)


def mime_type(name: Column) -> Column:
    """MIME type by file name, NULL if unknown; compression suffixes are looked through."""
    registry = mimetypes.MimeTypes(filenames=())
    known = registry.types_map[True]
    types = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    encodings = sorted(registry.encodings_map)
    shorthand = F.create_map(
        *[F.lit(x) for pair in sorted(registry.suffix_map.items()) for x in pair]
    )

    def lookup(extension: Column) -> Column:
        return F.coalesce(
            F.element_at(types, extension), F.element_at(types, F.lower(extension))
        )

    extension = file_extension(name)
    expanded = F.element_at(shorthand, F.lower(extension))
    full = F.when(
        expanded.isNotNull(),
        F.concat(F.left(name, F.length(name) - F.length(extension)), expanded),
    ).otherwise(name)
    suffix = file_extension(full)
    inner = file_extension(F.left(full, F.length(full) - F.length(suffix)))
    return F.when(suffix.isin(*encodings), lookup(inner)).otherwise(lookup(suffix))


def upload_mime_type(name: Column) -> Column:
    """MIME type for an upload: unknown names become octet-stream."""
    return F.coalesce(mime_type(name), F.lit(DEFAULT_MIME_TYPE))


def file_type_label(mime: Column) -> Column:
    """Short display label of a MIME type, NULL if it has none."""
    pairs = [F.lit(x) for pair in FILE_TYPE_LABELS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), mime)


def human_size(size: Column) -> Column:
    """Byte count in SI units with at most two decimals: ``265.32 kB``."""
    label = F.concat(size.cast("string"), F.lit(" " + SIZE_UNITS[0]))
    for power in range(1, len(SIZE_UNITS)):
        # from 999.995 of the smaller unit on, two decimals round to the next one
        floor = 1000 if power == 1 else 999_995 * 1000 ** (power - 2)
        hundredths = F.floor(size / F.lit(float(1000**power)) * 100 + 0.5)
        value = (hundredths / 100).cast("string")
        text = F.concat(
            F.regexp_replace(value, r"\.0$", ""), F.lit(" " + SIZE_UNITS[power])
        )
        label = F.when(size >= F.lit(floor), text).otherwise(label)
    return label


def line_count(text: Column) -> Column:
    """Number of lines; a final line break does not open another line."""
    ends_open = (F.length(text) > 0) & ~F.right(text, F.lit(1)).isin(*LINE_BREAKS)
    breaks = F.regexp_count(text, F.lit(f"\r\n|[{LINE_BREAKS}]"))
    return breaks + F.when(ends_open, 1).otherwise(0)


def object_url(bucket: Column, *parts: Column) -> Column:
    """``s3://bucket/part/part``."""
    return F.concat(F.lit("s3://"), F.concat_ws("/", bucket, *parts))


def url_bucket(url: Column) -> Column:
    """Bucket of an object URL; NULL if it is none."""
    return F.when(url.startswith("s3://"), F.split_part(url, F.lit("/"), F.lit(3)))


def url_key(url: Column) -> Column:
    """Object key of an object URL; NULL if it is none."""
    return F.when(
        url.startswith("s3://"), F.regexp_extract(url, r"(?s)^s3://[^/]*/(.*)$", 1)
    )


def percent_encode(text: Column) -> Column:
    """Percent encoding with no safe characters: a space is ``%20``, ``~`` stays."""
    encoded = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def percent_decode(text: Column) -> Column:
    """Inverse of :func:`percent_encode`; a literal ``+`` stays a plus."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def is_blank(text: Column) -> Column:
    """Absent in the sense of optional inputs: NULL or the empty string."""
    return F.coalesce(text, F.lit("")) == ""


def stable_id(*parts: Column) -> Column:
    """Deterministic id. A random one would change when a task is retried.

    Every part is written with its length, so that different part lists
    never share an id.
    """
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(
        F.concat_ws("|", *[F.concat_ws(":", F.length(t).cast("string"), t) for t in texts]),
        256,
    )
