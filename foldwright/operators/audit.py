"""Results paired with the rows that break their contract (BP-3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


class ContractError(ValueError):
    """Raised in strict mode when an audit finds violating rows."""


@dataclass(frozen=True)
class Audited:
    """An operator's result and its violations; `checked()` raises when there are any."""

    result: DataFrame
    violations: DataFrame

    def checked(self, message: str = "contract violated") -> DataFrame:
        sample = self.violations.limit(5).collect()
        if sample:
            raise ContractError(f"{message}: {[row.asDict() for row in sample]}")
        return self.result
