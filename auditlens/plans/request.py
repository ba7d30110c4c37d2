"""What a run is asked to do."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from auditlens.functions.features import FeatureRule
from auditlens.operators.joins import (
    JoinStep, default_amount_column, preset_joins, resolve_dataset,
)
from auditlens.operators.user_rules import UserRule
from auditlens import fixed


@dataclass(frozen=True)
class RunRequest:
    tables: Sequence[str]
    joins: Sequence[JoinStep] = ()
    run_name: str = "Ad hoc anomaly workbench run"
    amount_field: str | None = None
    user_rules: Sequence[UserRule] = ()
    feature_rules: Sequence[FeatureRule] = ()
    contamination: float | str = "auto"
    from_date: date | str | None = None
    to_date: date | str | None = None
    clock_columns: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self):
        if not 1 <= len(self.tables) <= 3:
            raise ValueError("Select 1 to 3 tables.")
        if self.contamination != "auto" and not 0 < float(self.contamination) < 1:
            raise ValueError("contamination must be 'auto' or between 0 and 1.")

    def with_dataset_defaults(self) -> tuple[RunRequest, list[str]]:
        """Tables, joins and amount of the trained dataset; other joins are ignored with a
        warning."""
        dataset = resolve_dataset(self.tables)
        joins = preset_joins(dataset)
        ignored = bool(self.joins) and list(self.joins) != joins
        tables = list(fixed.DATASETS[dataset])
        request = replace(
            self, tables=tables, joins=joins,
            amount_field=self.amount_field or default_amount_column(tables))
        return request, ["Given joins are ignored; the dataset's own are used."] * ignored
