"""Bytes of pages as text, whatever their character set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names looked for in a page's head, the sets tried in any case, and names that mean another set.
IN_HEAD = ("euc-kr", "ks_c_5601-1987", "cp949", "utf-8")
ALWAYS = ("utf-8", "cp949", "euc-kr")
MEANS = {"ks_c_5601-1987": "cp949", "euc-kr": "cp949"}
#: bytes of the head
HEAD = 2048


def candidates(body: Column, declared: Column) -> Column:
    """The sets to try, in order: the declared one, those that the head names, those tried in any case; each once."""
    head = F.lower(F.decode(F.substring(body, 1, HEAD), "ISO-8859-1"))
    said = F.array(F.lower(declared), *(F.when(F.contains(head, F.lit(n)), F.lit(n)) for n in IN_HEAD), *(F.lit(n) for n in ALWAYS))
    return F.array_distinct(F.filter(said, lambda n: n.isNotNull() & (n != "")))


@F.udf(StringType(), useArrow=False)
def decode_udf(body: bytes | None, names: list[str]) -> str | None:
    """Spark's ``decode`` knows neither of the Korean sets. Bodies may be large, so rows come in small batches (a hundred), not in Arrow batches of ten thousand."""
    if body is None:
        return None
    for name in names:
        try:
            return bytes(body).decode(MEANS.get(name, name))
        except (UnicodeDecodeError, LookupError):
            continue
    return bytes(body).decode("utf-8", "replace")


def page_text(body: Column, declared: Column | None = None) -> Column:
    """``body`` (binary) by the first set that decodes all of it; if none does, as UTF-8 with marks for what is broken. Bytes that are valid
    UTF-8, declared or named as no other set, never leave the JVM. Null: null; empty: empty."""
    declared = F.lit(None).cast("string") if declared is None else declared
    tries = candidates(body, declared)
    return F.when((tries[0] == "utf-8") & F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(decode_udf(body, tries))
