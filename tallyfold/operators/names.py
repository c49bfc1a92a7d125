"""Names to ids, blind to case and accents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LATIN = [chr(k) for k in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(k))) > 1 and chr(k).islower()]
#: Accented small letters, and what they are without accents.
_ACCENTS = ("".join(_LATIN), "".join(unicodedata.normalize("NFD", c)[0] for c in _LATIN))


def resolve_names(wanted: DataFrame, people: DataFrame) -> DataFrame:
    """(first, last) -> id: people (id, first, last, played_last) of the same last name whose first name starts with the same three letters; an exact first name wins over such a one, then the latest career.

    The join is on the last name and the first three letters, so a common last name does not pair everyone that has it.
    Letters are compared without case and accents. Unmatched names keep a null id, and so do empty first names.
    """
    w = wanted.select(F.col("first").alias("w_first"), F.col("last").alias("w_last")).distinct()
    keyed = w.withColumns({"_last": _folded("w_last"), "_start": F.substring(_folded("w_first"), 1, 3)}).where("_start != ''")
    starts = F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring(_folded("first"), F.lit(1), n)))
    known = people.withColumns({"_last": _folded("last"), "_start": F.explode(starts)})
    pairs = keyed.join(known, ["_last", "_start"])
    exact = (_folded("w_first") == _folded("first")).cast("int")
    best = pairs.groupBy("w_first", "w_last").agg(F.max_by("id", F.struct(exact, "played_last", "id")).alias("id"))
    out = w.join(best, ["w_first", "w_last"], "left")
    return out.withColumnsRenamed({"w_first": "first", "w_last": "last"})


def _folded(name: str) -> Column:
    """Lower case without accents: letters decomposed by a table of the Latin ones, as Spark SQL has no normal forms."""
    return F.translate(F.lower(F.trim(name)), *_ACCENTS)
