"""The feature table: row arithmetic, behaviour, ranks, and the plan that puts them in order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortex.functions.exprs import safe_ratio, safe_sum
from cohortex.functions.periods import month_index
from cohortex.operators.panel import calendar_periods, ghost_rows
from cohortex.operators.ranks import deflated, percent_ranks, rank_counts, signed_ranks, with_percent_ranks
from cohortex.operators.series import Catalog, SeriesSpec, add_series, check_no_future
from cohortex.staging import release, released, stage


@dataclass(frozen=True)
class RowSpec:
    """Row features by name.

    sums, differences, counts of positives take nulls as 0; least and greatest
    skip nulls, greatest_or_zero takes them as 0.  ratios: numerator and
    denominator, the latter a column, a tuple of columns to add up, or a column
    and a factor.  flags: an SQL condition (null is false), or one with the
    columns it needs.  Column names are compared in any case.  absent: sums and
    counts that lack a source are left out (``omit``) or made of the others
    (``partial``); everything else that lacks one is left out.
    """

    sums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    differences: dict[str, tuple[str, str]] = field(default_factory=dict)
    least: dict[str, tuple[str, ...]] = field(default_factory=dict)
    greatest: dict[str, tuple[str, ...]] = field(default_factory=dict)
    greatest_or_zero: dict[str, tuple[str, ...]] = field(default_factory=dict)
    positives: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ratios: dict[str, tuple] = field(default_factory=dict)
    flags: dict[str, str | tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    absent: str = "omit"


def add_row_features(df: DataFrame, spec: RowSpec, catalog: Catalog) -> DataFrame:
    """Two projections: sums, differences, extremes and counts; then ratios and flags, which may use them."""
    have = {c.lower() for c in df.columns}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    first: dict[str, Column] = {}

    def usable(cols: tuple[str, ...]) -> tuple[str, ...]:
        there = tuple(c for c in cols if c.lower() in have)
        return there if len(there) == len(cols) or spec.absent == "partial" else ()

    def whole(cols: tuple[str, ...]) -> bool:
        return have.issuperset(c.lower() for c in cols)

    for name, cols in spec.sums.items():
        if there := usable(cols):
            first[catalog.add("sumas", name, " + ".join(there), ",".join(there))] = safe_sum(*there)
    for name, (a, b) in spec.differences.items():
        if whole((a, b)):
            first[catalog.add("sumas", name, f"{a} - {b}", f"{a},{b}")] = zero(a) - zero(b)
    for how, kind, fn in (("least", spec.least, F.least), ("greatest", spec.greatest, F.greatest)):
        for name, cols in kind.items():
            if whole(cols):
                first[catalog.add("extremos", name, f"{how}({', '.join(cols)})", ",".join(cols))] = fn(*cols)
    for name, cols in spec.greatest_or_zero.items():
        if whole(cols):
            first[catalog.add("extremos", name, f"greatest({', '.join(cols)}), nulls 0", ",".join(cols))] = F.greatest(*[zero(c) for c in cols])
    for name, cols in spec.positives.items():
        if there := usable(cols):
            first[catalog.add("conteos", name, f"positives of {', '.join(there)}", ",".join(there))] = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in there), F.lit(0))
    base = df.withColumns(first) if first else df
    have |= {c.lower() for c in first}
    second: dict[str, Column] = {}
    for name, (a, b, *factor) in spec.ratios.items():
        below = b if isinstance(b, tuple) else (b,)
        if whole((a, *below)):
            bottom = sum((F.col(c) for c in below[1:]), F.col(below[0])) * (factor[0] if factor else 1)
            second[catalog.add("ratios", name, f"{a} / ({' + '.join(below)}){f' * {factor[0]}' if factor else ''}", ",".join(dict.fromkeys((a, *below))))] = safe_ratio(a, bottom)
    for name, flag in spec.flags.items():
        condition, needs = (flag, ()) if isinstance(flag, str) else flag
        if whole(needs):
            second[catalog.add("banderas", name, condition, ",".join(needs))] = F.coalesce(F.expr(condition), F.lit(False)).cast("int")
    return base.withColumns(second) if second else base


@dataclass(frozen=True)
class Behaviour:
    """Sources of the behaviour events: payroll counts, products held, card status by feature, recencies (condition and columns it needs), balances by feature, and (feature, column) of the activity whose falls are counted."""

    payroll: tuple[str, ...] = ()
    products: str | None = None
    status: dict[str, str] = field(default_factory=dict)
    recency: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    balances: dict[str, str] = field(default_factory=dict)
    activity: tuple[str, str] | None = None


def fitted_behaviour(spec: Behaviour, columns: list[str]) -> Behaviour:
    """``spec`` without what needs a column that is not among ``columns``."""
    have = {c.lower() for c in columns}
    keep = lambda d: {k: c for k, c in d.items() if c.lower() in have}
    return Behaviour(
        payroll=tuple(c for c in spec.payroll if c.lower() in have), products=spec.products if spec.products and spec.products.lower() in have else None, status=keep(spec.status),
        recency={k: (c, needs) for k, (c, needs) in spec.recency.items() if have.issuperset(n.lower() for n in needs)}, balances=keep(spec.balances), activity=spec.activity if spec.activity and spec.activity[1].lower() in have else None,
    )


def add_behaviour(panel: DataFrame, entity: str, period: str, spec: Behaviour, catalog: Catalog) -> DataFrame:
    """Events over the current and the two periods before, on the dense panel.

    lost payroll, products lost against the best of the two before, status
    worse than before, periods since a condition last held (3 if the window is
    full and it never did, null if the window is not full), balances against the
    window's best, and the length (0..2) of the run of falling activity.
    """
    order = Window.partitionBy(entity).orderBy(period)
    before, three = order.rowsBetween(-2, -1), order.rowsBetween(-2, 0)
    idx = month_index(period)
    full = F.count(F.lit(1)).over(three) == 3
    out: dict[str, Column] = {}

    def put(name: str, expression: str, origin: str, value: Column) -> None:
        out[catalog.add("comportamiento", name, expression, origin)] = value

    if spec.payroll:
        paid = (safe_sum(*spec.payroll) > 0).cast("int")
        put("f_perdio_payroll", "payroll in the two before, none now", ",".join(spec.payroll), F.when((F.max(paid).over(before) == 1) & (paid == 0), 1).otherwise(0))
    if spec.products:
        put("n_productos_perdidos", "best of the two before minus now, at least 0", spec.products, F.greatest(F.max(spec.products).over(before) - F.col(spec.products), F.lit(0)))
    for name, c in spec.status.items():
        now = F.coalesce(F.col(c), F.lit(0))
        put(name, f"{c} above its best of the two before", c, F.when(now > F.max(now).over(before), 1).otherwise(0))
    for name, (cond, needs) in spec.recency.items():
        last = F.max(F.when(F.expr(cond), idx)).over(three)
        put(name, f"periods since {cond}", ",".join(needs), F.when(last.isNotNull(), idx - last).when(full, F.lit(3)))
    for name, c in spec.balances.items():
        put(name, f"{c} / best of the window", c, safe_ratio(c, F.greatest(F.max(c).over(three), F.lit(0.0))))
    if spec.activity:
        name, c = spec.activity
        l1, l2 = F.lag(c, 1).over(order), F.lag(c, 2).over(order)
        fell = F.coalesce(F.col(c) < l1, F.lit(False))
        put(name, f"run of falling {c}", c, fell.cast("int") + (fell & F.coalesce(l1 < l2, F.lit(False))).cast("int"))
    return panel.withColumns(out) if out else panel


def rfm_score(df: DataFrame, period: str, key: list[str], recency: str, frequency: str, money: str) -> DataFrame:
    """``key, period, rfm_score``: sum of three quintiles (1..5) within the period; null recency is 3, other nulls 0; low recency is good."""
    d = df.select(*key, period, (-F.coalesce(F.col(recency), F.lit(3))).cast("double").alias("r"), F.coalesce(F.col(frequency), F.lit(0)).cast("double").alias("f"), F.coalesce(F.col(money), F.lit(0)).cast("double").alias("m"))
    p = percent_ranks(d, period, ["r", "f", "m"], key)
    q = lambda c: F.least(F.lit(5), 1 + F.floor(F.col(c) * 5 + 1e-9))
    return p.select(*key, period, (q("pr_r") + q("pr_f") + q("pr_m")).cast("int").alias("rfm_score"))


def rescale(df: DataFrame, period: str, amounts: list[str], key: list[str], method: str) -> DataFrame:
    """Amounts replaced by what moves with no price level: ``signed_rank`` or ``deflate``."""
    if method == "deflate":
        out = deflated(df, period, amounts)
        return out.withColumns({a: F.col(f"df_{a}") for a in amounts}).drop(*[f"df_{a}" for a in amounts])
    if method == "signed_rank":
        r = signed_ranks(df, period, amounts, key)
        r = r.select(*[F.col(k).alias(f"__{k}") for k in (*key, period)], *[F.col(f"sr_{a}") for a in amounts])
        cond = F.lit(True)
        for k in (*key, period):
            cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return df.join(r, cond).withColumns({a: F.col(f"sr_{a}") for a in amounts}).drop(*[f"sr_{a}" for a in amounts], *[f"__{k}" for k in (*key, period)])
    raise ValueError(f"unknown method {method!r}")


@dataclass(frozen=True)
class FeaturePlan:
    """What to build: row features, series of ``series_fields``, behaviour, percent ranks of ``rank_fields`` (and deciles of ``decile_fields`` among them), rescaled amounts, and RFM from (recency, frequency, money) columns."""

    rows: RowSpec
    series_fields: tuple[str, ...]
    series: SeriesSpec = SeriesSpec()
    rank_fields: tuple[str, ...] = ()
    decile_fields: tuple[str, ...] | None = None
    rescaled: tuple[str, ...] = ()
    method: str = "signed_rank"
    calendar: str = "full"
    behaviour: Behaviour | None = None
    rfm: tuple[str, str, str] | None = None


def _over_time(base: DataFrame, panel: DataFrame, entity: str, period: str, plan: FeaturePlan, cat: Catalog) -> DataFrame:
    """Series and behaviour of the fields that ``base`` has, on ``panel``."""
    have = {c.lower() for c in base.columns}
    out = add_series(panel, entity, period, [c for c in plan.series_fields if c.lower() in have], plan.series, cat)
    return add_behaviour(out, entity, period, fitted_behaviour(plan.behaviour, base.columns), cat) if plan.behaviour else out


def _rank_names(base: DataFrame, plan: FeaturePlan, cat: Catalog) -> tuple[list[str], list[str]]:
    """The rank fields that ``base`` has and the rank columns to publish."""
    fields = [f for f in plan.rank_fields if f in base.columns]
    deciles = fields if plan.decile_fields is None else [f for f in plan.decile_fields if f in fields]
    names = [cat.add("rankings", f"pr_{f}", f"percent_rank of {f} in the period", f) for f in fields]
    return fields, names + [cat.add("rankings", f"dec_{f}", f"decile of {f} in the period", f) for f in deciles]


def plan_catalog(fact: DataFrame, entity: str, period: str, plan: FeaturePlan) -> Catalog:
    """The catalog of the table that ``build_features`` would make of a table with the columns of ``fact``; runs no job."""
    cat = Catalog()
    base = add_row_features(fact, plan.rows, cat)
    _over_time(base, base.withColumn("present", F.lit(1)), entity, period, plan, cat)
    _rank_names(base, plan, cat)
    if plan.rfm:
        cat.add("comportamiento", "rfm_score", "quintiles of recency, frequency and money", ",".join(plan.rfm))
    return cat


def build_features(fact: DataFrame, entity: str, period: str, plan: FeaturePlan) -> tuple[DataFrame, Catalog]:
    """dense panel, row features, rescaling, series and behaviour, real rows, ranks, RFM: the feature table and its catalog.

    Row features are made on the panel, so that a ghost row's sums are 0 while
    its plain fields are null; amounts, sums of them too, are rescaled over
    real rows before anything looks back at them.  Series see ghost rows, ranks
    do not.  The table is refused if any series looks ahead.  Fields that the
    table lacks are left out.

    The disk holds narrow rows only: the fact and the counts behind its ranks
    are staged, and brought together by entity in one shuffle of the result's
    plan.  All features are made after it.
    """
    cat = Catalog()
    fact = stage(fact, "fact")
    entities, periods = F.col(entity).isNotNull(), calendar_periods(fact, period, plan.calendar)
    real = fact.where(entities & F.col(period).isin(periods))
    ghosts = ghost_rows(real, entity, period, periods)
    if plan.rescaled:
        rows = stage(rescale(add_row_features(real, plan.rows, cat), period, list(plan.rescaled), [entity], plan.method), "rescaled")
        none = {f: F.lit(None).cast(dict(rows.dtypes)[f]) for f in plan.rescaled}
        unseen = add_row_features(_with_nulls(ghosts, real), plan.rows, Catalog()).withColumns(none)
        panel, base = _union(rows, unseen), rows
        derived = lambda df, _: df
    else:
        panel, base = _union(real, _with_nulls(ghosts, real)), add_row_features(real, plan.rows, Catalog())
        derived = lambda df, cat: add_row_features(df, plan.rows, cat)
    fields = [f for f in plan.rank_fields if f in base.columns]
    added = None  # what the ranking adds to the rows: staged, and as small as it can be
    if fields:
        added, sizes = rank_counts(base, period, fields, [entity])
    if plan.rfm:
        with released(fact.sparkSession) as kept:
            now = _over_time(base, derived(panel.repartition(entity), Catalog()), entity, period, plan, Catalog())
            score = stage(rfm_score(stage(now.where("present = 1").select(entity, period, *plan.rfm), "unscored"), period, [entity], *plan.rfm), "scored")
            merged = stage(added.join(score, [entity, period]), "added") if fields else score
            kept.append(merged)
        if fields:
            release(added)
        added = merged
    # Joined by the entity alone (the periods only have to be equal), rows are where the windows want them: wide rows are never shuffled.
    before = [c for c in panel.columns if c not in (entity, period, "present")]
    if added is not None:
        r = added.select(F.col(entity).alias("__e"), F.col(period).alias("__p"), *[c for c in added.columns if c not in (entity, period)]).hint("merge")
        panel = panel.join(r, (F.col(entity) == F.col("__e")) & (F.col(period) <= F.col("__p")) & (F.col(period) >= F.col("__p")), "left").drop("__e", "__p")
    else:
        panel = panel.repartition(entity)
    panel = derived(panel, cat)
    series = _over_time(base, panel, entity, period, plan, cat)
    check_no_future(series)
    fields, names = _rank_names(base, plan, cat)
    out = series.where("present = 1").drop("present")
    if fields:
        out = with_percent_ranks(out, sizes, period, fields)
    if plan.rfm:
        cat.add("comportamiento", "rfm_score", "quintiles of recency, frequency and money", ",".join(plan.rfm))
        names = [*names, "rfm_score"]
    made = {f"{k}_{f}" for f in fields for k in ("pr", "dec")} | ({"rfm_score"} if plan.rfm else set())
    return out.select(entity, period, *before, *[c for c in out.columns if c not in {entity, period, *before, *made}], *names), cat


def _with_nulls(ghosts: DataFrame, rows: DataFrame) -> DataFrame:
    return ghosts.select(*[F.col(c) if c in ghosts.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])


def _union(rows: DataFrame, ghosts: DataFrame) -> DataFrame:
    return rows.withColumn("present", F.lit(1)).unionByName(ghosts.withColumn("present", F.lit(0)))


def resolve_fields(df: DataFrame, spec: str | list[str], curated: list[str], excluded: frozenset[str] = frozenset()) -> list[str]:
    """``curado`` (listed names that exist), ``todos`` (all numeric columns) or an explicit list, whose unknown names are an error."""
    numeric = {n for n, t in df.dtypes if t in ("bigint", "int", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    if spec == "curado":
        return [c for c in curated if c in df.columns and c not in excluded]
    if spec == "todos":
        return [c for c in df.columns if c in numeric and c not in excluded]
    unknown = [c for c in spec if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return list(spec)


def select_blocks(columns: list[str], catalog: list[tuple[str, str]], only: list[str] | None = None, without: list[str] | None = None, without_features: list[str] | None = None) -> list[str]:
    """Columns of the chosen blocks in their order; pseudo-blocks ``originales`` and ``derivadas``; unknown names are errors."""
    block = {f: b for b, f in catalog}
    known = set(block.values()) | {"originales", "derivadas"}
    for name in (*(only or ()), *(without or ())):
        if name not in known:
            raise ValueError(f"unknown block {name!r}")
    for name in without_features or ():
        if name not in columns:
            raise ValueError(f"unknown feature {name!r}")

    def of(c: str) -> set[str]:
        b = block.get(c, "originales")
        return {b, "originales" if b == "originales" else "derivadas"}

    return [c for c in columns if (not only or of(c) & set(only)) and not of(c) & set(without or ()) and c not in (without_features or ())]
