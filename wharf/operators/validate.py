"""Rule-driven row validation (V-01..V-05).

The reference builds an array of messages per row and then UPDATEs the stage
through a self-join on (FileLoadAuditId, LineNum). Here the messages are a
row-local expression, so validation is a single projection: no join, no
shuffle, and it streams.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wharf.functions import casts

# Soft-delete columns and the rejection prefix of the reference.
INACTIVE_IND = "InactiveInd"
INACTIVE_DATE = "InactiveDate"
INACTIVE_REASON = "InactiveReason"
REJECT_PREFIX = "Validation failure: "
_ERRORS = "__wharf_errors"

PARSERS = {
    "numeric": casts.safe_numeric,
    "int": casts.safe_int,
    "percent": casts.percent_numeric,
    "datetime": casts.safe_datetime,
    "wall": casts.wall_datetime,
}


@dataclass(frozen=True)
class Required:
    """V-02 '<label> missing value' when NULL ('' passes)."""
    column: str
    label: str | None = None

    def branch(self) -> tuple[Column, str]:
        return F.col(self.column).isNull(), f"{self.label or self.column} missing value"


@dataclass(frozen=True)
class Parses:
    """V-03 '<label> parse error' when not NULL and the safe parser gives NULL."""
    column: str
    kind: str = "numeric"
    label: str | None = None

    def branch(self) -> tuple[Column, str]:
        c = F.col(self.column)
        return c.isNotNull() & PARSERS[self.kind](c).isNull(), \
            f"{self.label or self.column} parse error"


@dataclass(frozen=True)
class AtMost:
    """V-04 parsed value above ``limit`` -> ``message`` (after the parse rule)."""
    column: str
    limit: float
    message: str
    kind: str = "int"

    def branch(self) -> tuple[Column, str]:
        return PARSERS[self.kind](F.col(self.column)) > F.lit(self.limit), self.message


Rule = Required | Parses | AtMost


def message_columns(rules: Sequence[Rule]) -> list[Column]:
    """One nullable message per column; rules on one column chain, first hit wins."""
    order: list[str] = []
    chains: dict[str, list[tuple[Column, str]]] = {}
    for r in rules:
        if r.column not in chains:
            order.append(r.column)
            chains[r.column] = []
        chains[r.column].append(r.branch())
    out = []
    for col in order:
        expr = None
        for cond, msg in chains[col]:
            expr = F.when(cond, F.lit(msg)) if expr is None else expr.when(cond, F.lit(msg))
        out.append(expr)
    return out


def validate(stage: DataFrame, rules: Sequence[Rule], now: Column | None = None) -> DataFrame:
    """V-01: flag rejects with InactiveInd / InactiveDate / InactiveReason.

    A row with at least one message becomes inactive with reason
    'Validation failure: m1, m2'. Rows without a message keep their flags.
    """
    now = F.current_timestamp() if now is None else now
    # Messages are computed once into a column; the three flags read that
    # column, so the (wide) rule expression is not copied into each of them.
    # The filter changes nothing (array_join skips NULLs); a lambda keeps this projection out of
    # whole-stage code, whose one method for all rules is too long for the JVM to compile.
    messages = F.filter(F.array(*message_columns(rules)), lambda m: m.isNotNull())
    df = stage.withColumn(_ERRORS, F.array_join(messages, ", "))
    errors = F.col(_ERRORS)
    bad = F.length(errors) > 0
    cols = {}
    if INACTIVE_IND in stage.columns:
        cols[INACTIVE_IND] = F.when(bad, F.lit(True)).otherwise(F.col(INACTIVE_IND))
    else:
        cols[INACTIVE_IND] = bad
    cols[INACTIVE_DATE] = (F.when(bad, now).otherwise(F.col(INACTIVE_DATE))
                           if INACTIVE_DATE in stage.columns else F.when(bad, now))
    reason = F.col(INACTIVE_REASON) if INACTIVE_REASON in stage.columns else F.lit(None).cast("string")
    cols[INACTIVE_REASON] = F.when(bad, F.concat(F.lit(REJECT_PREFIX), errors)).otherwise(reason)
    return df.withColumns(cols).drop(_ERRORS)


def summarize(stage: DataFrame, date_col: str | None, by: Sequence[str] = (),
              parser=casts.wall_datetime) -> DataFrame:
    """V-05 the procedure's OUT parameters as a one-row-per-group DataFrame.

    min/max of the parsed date over active rows and the count of *all*
    inactive rows. A plain grouped aggregate: partial aggregation runs
    map-side, so even one huge system costs one partial row per task.
    """
    inactive = F.coalesce(F.col(INACTIVE_IND), F.lit(False))
    aggs = []
    if date_col is not None:
        d = F.when(~inactive, parser(F.col(date_col)))
        aggs += [F.min(d).alias("min_date"), F.max(d).alias("max_date")]
    aggs.append(F.count_if(inactive).alias("rejected"))
    return stage.groupBy(*by).agg(*aggs)


class ObservedSummary:
    """V-05 while the stage is written: the same figures from the write's own pass.

    ``watch`` adds the aggregates of the given groups to the plan; after any one action
    on it ``rows`` gives the summary without another scan. A value outside the groups
    is counted too and makes ``rows`` fail, so no group goes missing unseen.
    """

    def __init__(self, date_col: str | None, by: Sequence[str], groups: Sequence[tuple],
                 parser=casts.wall_datetime):
        self.date_col, self.by, self.groups, self.parser = date_col, tuple(by), list(groups), parser
        self.seen = Observation()

    def watch(self, stage: DataFrame) -> DataFrame:
        inactive = F.coalesce(F.col(INACTIVE_IND), F.lit(False))
        aggs, known = [], F.lit(False)
        for i, group in enumerate(self.groups):
            own = F.lit(True)
            for c, v in zip(self.by, group):
                own = own & F.col(c).eqNullSafe(F.lit(v))
            known = known | own
            aggs += [F.count_if(own).alias(f"n_{i}"), F.count_if(own & inactive).alias(f"rejected_{i}")]
            if self.date_col is not None:
                d = F.when(own & ~inactive, self.parser(F.col(self.date_col)))
                aggs += [F.min(d).alias(f"min_{i}"), F.max(d).alias(f"max_{i}")]
        self.schema = stage.select(*self.by).schema
        return stage.observe(self.seen, *aggs, F.count_if(~known).alias("others"))

    def rows(self, spark) -> DataFrame:
        got = self.seen.get
        if got["others"]:
            raise ValueError(f"{got['others']} rows belong to no known group of {self.by}")
        dated = self.date_col is not None
        data = [(*group, *((got[f"min_{i}"], got[f"max_{i}"]) if dated else ()), got[f"rejected_{i}"])
                for i, group in enumerate(self.groups) if got[f"n_{i}"]]
        own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema)
        dates = "min_date timestamp_ntz, max_date timestamp_ntz, " if dated else ""
        return spark.createDataFrame(data, f"{own}, {dates}rejected bigint")
