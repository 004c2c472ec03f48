"""Share-based allocation and mapping joins (L-01, L-02, J-05, J-06, A-04).

``allocate``: facts LEFT JOIN shares on keys, every measure multiplied by
IFNULL(share, 1), unmatched rows labelled 'Other', then summed per group.

Scale: when a measure times a share is exact at NUMERIC scale (scales add up
to <= 9), facts are first summed per (join key, group columns) -- partial
aggregation runs map-side, so a hot key collapses before any shuffle -- and
the shares are applied to those sums. Otherwise the product is taken per row
and rounded to 9 places, exactly as NUMERIC arithmetic does, before summing.
The join strategy is left to Catalyst/AQE (runtime size check for broadcast;
skew-join splitting for a hot key); nothing is broadcast on assumption.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "decimal(38,9)"
SHARE_T = "decimal(13,9)"
_E9 = 1_000_000_000


def _scale(df: DataFrame, c: Column | str) -> int | None:
    dt = df.select(c).schema.fields[0].dataType
    return dt.scale if isinstance(dt, T.DecimalType) else None


def share_product(measure: Column, share: Column, types: tuple[T.DataType, T.DataType] | None = None) -> Column:
    """measure * IFNULL(share, 1) at NUMERIC precision, rounded per row like NUMERIC.

    Where the declared ``types`` of both fit one exact product, that is taken. A
    product of two wide decimals would lose places in Spark, so the measure is then
    taken in two limbs, whole billions and the rest: the first product is a whole
    number and exact, and only the second is rounded. Good for products below 10^28
    (a wider sum of decimals would lose its last place); larger ones raise.
    """
    if types is not None and all(isinstance(t, T.DecimalType) for t in types):
        m, s = types
        if m.precision + s.precision + 1 <= 38 and s.precision > s.scale:
            return (measure * F.coalesce(share, F.lit(1).cast(s))).cast(NUMERIC)
    m, s = measure.cast(NUMERIC), F.coalesce(share, F.lit(1)).cast(SHARE_T)
    rest = m % F.lit(_E9).cast("decimal(10,0)")
    whole = ((m - rest).cast("decimal(29,0)") * s).cast("decimal(37,9)")
    return (whole + (rest.cast("decimal(18,9)") * s).cast("decimal(23,9)")).cast(NUMERIC)


def allocate(facts: DataFrame, shares: DataFrame, on: Sequence[tuple[str, str]],
             measures: Mapping[str, Column], group_by: Sequence[Column | str],
             share_col: str, labels: Mapping[str, str] | None = None,
             other: str = "Other", float_measures: Mapping[str, Column] | None = None,
             preaggregate: bool | None = None) -> DataFrame:
    """L-01/L-02 allocate ``measures`` by ``share_col`` and sum per ``group_by``.

    ``on``: [(fact_col, share_col)] equi-join keys (J-05). ``labels``:
    {output: share-table column} replaced by ``other`` when no share row
    matched (decided on the share key being NULL, as the reference does).
    ``group_by`` may refer to fact columns and to the ``labels`` outputs.
    ``float_measures`` are summed as FLOAT64 products.
    """
    labels = dict(labels or {})
    float_measures = dict(float_measures or {})
    fact_keys = [f for f, _ in on]
    plain_groups = [g for g in group_by if isinstance(g, str) and g not in labels]

    if preaggregate is None:
        scales = [_scale(facts, m) for m in measures.values()]
        s_share = _scale(shares, share_col)
        preaggregate = (not float_measures and s_share is not None
                        and all(s is not None and s + s_share <= 9 for s in scales))

    pre_cols = list(dict.fromkeys([*fact_keys, *plain_groups]))
    if preaggregate:
        # sum(m) * s is exact here: the product needs at most 9 decimals.
        facts = facts.groupBy(*pre_cols).agg(*[F.sum(m).alias(f"__m_{n}") for n, m in measures.items()])
    else:
        facts = facts.select(*pre_cols, *[m.alias(f"__m_{n}") for n, m in measures.items()],
                             *[m.alias(f"__f_{n}") for n, m in float_measures.items()])

    share_type = shares.schema[share_col].dataType

    def product(n: str, share: Column) -> Column:
        return share_product(F.col(f"__m_{n}"), share, (facts.schema[f"__m_{n}"].dataType, share_type))

    right = shares.select(*[F.col(s).alias(f"__k_{i}") for i, (_, s) in enumerate(on)],
                          F.col(share_col).alias("__share"),
                          *[F.col(src).alias(f"__l_{out}") for out, src in labels.items()])
    cond = None
    for i, (f, _) in enumerate(on):
        c = F.col(f) == F.col(f"__k_{i}")
        cond = c if cond is None else cond & c
    joined = facts.join(right, cond, "left")
    matched = F.col("__k_0").isNotNull()
    label_exprs = {out: F.when(~matched, F.lit(other)).otherwise(F.col(f"__l_{out}"))
                   for out in labels}
    aggs = [F.sum(product(n, F.col("__share"))).cast(NUMERIC).alias(n) for n in measures]
    aggs += [F.sum(F.col(f"__f_{n}").cast("double") * F.coalesce(F.col("__share").cast("double"), F.lit(1.0)))
             .alias(n) for n in float_measures]
    keys = [label_exprs[g].alias(g) if g in label_exprs else g for g in group_by]
    return joined.groupBy(*keys).agg(*aggs)


def map_join(df: DataFrame, mapping: DataFrame, on: Sequence[tuple[str, str]],
             where: Column | None = None, dedupe_right: bool = False) -> DataFrame:
    """J-06 LEFT JOIN a mapping table with an extra right-side predicate.

    No right column is kept: as in the reference, the join's only effect is to
    repeat a fact row once per matching mapping row (so later SUMs inflate).
    ``dedupe_right=True`` keeps one row per key instead.
    """
    right = mapping if where is None else mapping.where(where)
    right = right.select(*[F.col(r).alias(f"__mk_{i}") for i, (_, r) in enumerate(on)])
    if dedupe_right:
        right = right.distinct()
    cond = None
    for i, (l, _) in enumerate(on):
        c = F.col(l) == F.col(f"__mk_{i}")
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left").drop(*[f"__mk_{i}" for i in range(len(on))])
