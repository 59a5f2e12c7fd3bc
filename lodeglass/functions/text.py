"""Column expressions for text. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two substrings that fail the code screen.
FORBIDDEN_CODE = ["os.system", "subprocess"]

# Fixed value: replies starting with this text are failures.
ERROR_PREFIX = "Error:"

# The whitespace characters Python's str.strip removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same inside a regular expression; Java's Unicode \s lacks the four separators 1c-1f.
SPACE = r"[\s\x1c-\x1f]"

ELLIPSIS = "..."


def strip(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_filled(text: Column) -> Column:
    """True for non-null, non-empty text; false otherwise, never null."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def snippet(text: Column, size: int) -> Column:
    """The first ``size`` characters, with dots only where something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(ELLIPSIS))).otherwise(text)


def escape_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def code_allowed(code: Column) -> Column:
    """A screening flag, not a security boundary. Null stays null."""
    allowed = F.lit(True)
    for word in FORBIDDEN_CODE:
        allowed = allowed & ~F.contains(code, F.lit(word))
    return F.when(code.isNotNull(), allowed)


def usable_response(reply: Column) -> Column:
    """True for a reply that is present and is not an error message."""
    return is_filled(reply) & ~F.coalesce(F.startswith(reply, F.lit(ERROR_PREFIX)), F.lit(False))


def extension_of(name: Column) -> Column:
    """Lower-cased suffix with its dot; empty when the name has none or only leading dots."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1))


def missing_labels(required: dict[str, Column]) -> Column:
    """Labels of the absent or empty fields, joined with a comma and a space."""
    return F.concat_ws(", ", *[F.when(~is_filled(c), F.lit(label)) for label, c in required.items()])


_PLACEHOLDER = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """One concat of the template's literal pieces and the named columns.

    Inserted text is never looked at again, so braces in data are harmless. ``{{`` and ``}}``
    in the template stand for single braces. A placeholder without a column is an error.
    """
    pieces: list[Column] = []
    literal = ""
    end = 0
    for found in _PLACEHOLDER.finditer(template):
        literal += template[end : found.start()]
        end = found.end()
        name = found.group(1)
        if name is None:
            literal += found.group(0)[0]
            continue
        if name not in values:
            raise KeyError(name)
        pieces += [F.lit(literal), F.coalesce(values[name].cast("string"), F.lit("None"))]
        literal = ""
    return F.concat(*pieces, F.lit(literal + template[end:]))
