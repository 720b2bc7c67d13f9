"""Text functions on columns: accents, blanks, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters with marks and their base letters, position by position
MARKED = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝŸ"
BASE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"


def strip_accents(c: Column) -> Column:
    """Letters with marks replaced by their base letters; separate combining marks dropped. Ligatures stay."""
    return F.regexp_replace(F.translate(c, MARKED, BASE), r"[̀-ͯ]", "")


def squeeze(c: Column) -> Column:
    """Runs of blanks (no-break and thin ones too) become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s  -​  　]+", " "))


def fold(c: Column) -> Column:
    """Lower case, accents stripped, blanks squeezed: the key under which typed names are compared."""
    return F.lower(strip_accents(squeeze(c)))
