

from . import addresses, defaults, detection, frames, logs, lookalikes, lookups, mappings, places, redaction, reports, rulesets, tables  # noqa: F401
