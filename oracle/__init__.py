"""DuckDB SQL that gives the expected rows of every registered query."""

from oracle.business import BUSINESS
from oracle.tables import AUDITS, CLEANING, CONSTRUCTION, FILES


def statements() -> dict[str, str]:
    return {**BUSINESS, **AUDITS, **CLEANING, **CONSTRUCTION, **FILES}
