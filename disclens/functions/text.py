"""Text as a document has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, and the four separators of information.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column | str) -> Column:
    """The text without white space of any kind at its ends: tabs, line breaks and wide blanks as well."""
    return F.trim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS))
