"""Tiers of evidence and their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers from weakest to strongest, and other names for them.
TIERS = ("lab", "authored", "real-capture", "earned")
ALIASES = {"tier-a": "lab", "tier-b": "authored", "tier-c": "real-capture", "tier-d": "earned", "realcapture": "real-capture"}


def evidence_tier(name: Column) -> Column:
    """The tier that a name stands for, in any case, with blanks or underscores for hyphens; null for another name."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "[_ ]", "-")
    known = F.create_map(*[F.lit(x) for pair in (*((t, t) for t in TIERS), *ALIASES.items()) for x in pair])
    return F.try_element_at(known, plain)


def tier_rank(tier: Column) -> Column:
    """0 to 3; 0 for a null or unknown tier, which claims nothing."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.lower(tier)).cast("int"), F.lit(0)) - 1, F.lit(0))
