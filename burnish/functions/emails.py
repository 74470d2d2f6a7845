"""E-mail checks and repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.functions.text import lower_strip

# The accepted form, the stand-in for a missing address and the
# ending put after a domain without a dot.
EMAIL = r"(?U)^[\w\.-]+@[\w\.-]+\.\w+$"
UNKNOWN = "unknown@example.com"
ENDING = ".com"


def valid_email(c: Column | str) -> Column:
    """Is the lower-cased, stripped value an address? Null counts as not."""
    return F.coalesce(lower_strip(c).rlike(EMAIL), F.lit(False))


def email_domain(c: Column | str) -> Column:
    """Text after the last ``@`` of a valid address, else null."""
    return F.when(valid_email(c), F.substring_index(lower_strip(c), "@", -1))


def fix_email(c: Column | str, unknown: str | None = UNKNOWN) -> Column:
    """Lower, strip, finish a domain that has no dot; blank becomes ``unknown``."""
    e = lower_strip(c)
    undotted = e.contains("@") & ~F.substring_index(e, "@", -1).contains(".")
    fixed = F.when(undotted, F.concat(e, F.lit(ENDING))).otherwise(e)
    return fixed if unknown is None else F.coalesce(F.nullif(fixed, F.lit("")), F.lit(unknown))


def restore_domain(c: Column | str, domain: Column) -> Column:
    """Put back a known domain: ``ann@example`` and ``anncompany.com`` -> ``ann@company.com``."""
    e = lower_strip(c)
    undotted = e.contains("@") & ~F.substring_index(e, "@", -1).contains(".")
    glued = ~e.contains("@") & e.endswith(domain) & (F.length(e) > F.length(domain))
    return (
        F.when(undotted, F.concat(F.substring_index(e, "@", 1), F.lit("@"), domain))
        .when(glued, F.concat(F.left(e, F.length(e) - F.length(domain)), F.lit("@"), domain))
        .otherwise(e)
    )
