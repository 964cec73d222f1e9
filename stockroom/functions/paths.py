"""Column expressions over paths, sizes, attributes and ids. Paths use `/`; comparisons are by bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LIMITS, NO_CONTENT_MASK, NO_EXTENSION, OFFLINE_MASK, REPARSE

LONGEST = 9223372036854775807
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def name(path: Column) -> Column:
    """Last component; the whole path if there is none."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), path)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, in ASCII lower case. Names that only start with a dot, or end with one, have none."""
    found = F.translate(F.regexp_extract(name(path), r"(?s)^.+\.([^.]*)$", 1), _UPPER, _LOWER)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(NO_EXTENSION))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def content_status(attributes: Column) -> Column:
    """offline before reparse before local."""
    return F.when(attributes.bitwiseAND(OFFLINE_MASK) != 0, "offline").when(attributes.bitwiseAND(REPARSE) != 0, "reparse").otherwise("local")


def avoids_content(attributes: Column) -> Column:
    """Whether reading the content could fetch or follow something."""
    return attributes.bitwiseAND(NO_CONTENT_MASK) != 0


def is_under(path: Column, root: str) -> Column:
    """By components: /a/bc is not under /a/b."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def ancestors(path: Column, root: str) -> Column:
    """Every directory above `path`, from `root` down to its parent."""
    parts = F.split(path, "/")
    depth = len([p for p in root.split("/") if p]) + 1
    above = F.transform(F.sequence(F.lit(depth), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > depth, above).otherwise(F.array().cast("array<string>"))


def edge_bytes(size: Column) -> Column:
    """Bytes that an edge sample reads: head and tail, or all of a small file."""
    return F.least(size, F.lit(2 * LIMITS.edge_bytes).cast("long"))


def edge_digest(content: Column, size: Column) -> Column:
    """Digest of head and tail together; of all bytes if they are no more."""
    n = LIMITS.edge_bytes
    return F.sha2(F.when(size > 2 * n, F.concat(F.substring(content, 1, n), F.substring(content, -n, n))).otherwise(content), 256)


def add_capped(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(LONGEST))


def multiply_capped(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.lit(LONGEST))


def subtract_floored(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def add_checked(a: Column, b: Column) -> Column:
    """The sum; an error where it overflows or falls below 0."""
    s = F.try_add(a, b)
    return F.when(s.isNull() | (s < 0), F.raise_error(F.lit("size out of range"))).otherwise(s)


def hex_id(x: Column) -> Column:
    """A 64-bit id as 16 hex digits."""
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def from_hex_id(x: Column) -> Column:
    """The signed long whose bits the 16 digits are."""
    high, low = F.conv(F.substring(x, 1, 8), 16, 10).cast("long"), F.conv(F.substring(x, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def identity(device: Column, inode: Column) -> Column:
    return F.concat_ws(":", device.cast("string"), inode.cast("string"))


def drive_letter(x: Column) -> Column:
    """`c:` and the like as `C`; null for anything else."""
    return F.nullif(F.regexp_extract(F.upper(F.trim(x)), r"^([A-Z]):*$", 1), F.lit(""))


def valid_job_id(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9-]{8,100}\z")


def valid_uuid(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lit(False))


def relevant_reason(reason: Column) -> Column:
    """Whether a journal record says more than that a handle was closed."""
    return reason.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) != 0
