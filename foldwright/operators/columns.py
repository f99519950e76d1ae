"""Column selection, masking and per-decision scaling."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.functions.draws import hash_key
from foldwright.functions.scalars import opaque_identifier
from foldwright.operators.audit import ContractError
from foldwright.operators.ordering import join_null_safe, with_row_number

_NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def missing_profile(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Missing share of every numeric column in one scan (PRJ1): (column, missing_share)."""
    names = sorted(f.name for f in df.schema.fields if f.dataType.typeName() in _NUMERIC and f.name not in exclude)
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if c in floating else F.col(c).isNull()
    shares = df.agg(*[F.avg(missing(c).cast("double")).alias(c) for c in names])
    return shares.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_share")) for c in names]))
    )


def low_missing_columns(df: DataFrame, exclude: Sequence[str] = (), threshold: float = 0.02) -> list[str]:
    """Sorted names below the threshold; only one row per column leaves the cluster."""
    profile = missing_profile(df, exclude).filter(F.col("missing_share") < threshold)
    return sorted(r["column"] for r in profile.collect())


def seeded_column_groups(columns: Sequence[str], width: int, seed: int | str) -> list[list[str]]:
    """Disjoint equal groups of a seeded order of the names; a remainder is left out (PRJ1)."""
    order = sorted(columns, key=lambda c: (hashlib.md5(f"{seed}:{c}".encode()).hexdigest(), c))
    return [order[i : i + width] for i in range(0, len(order) - width + 1, width)]


def column_aliases(columns: Sequence[str], salt: str) -> dict[str, str]:
    """Meaning-neutral column names: position and a salted digest (PRJ4)."""
    if len(set(columns)) != len(columns):
        raise ContractError("column names must be unique")
    digest = lambda c: hashlib.sha256(f"{salt}:column:{c}".encode()).hexdigest()[:8]
    return {c: f"feature_{i:04d}_{digest(c)}" for i, c in enumerate(columns)}


def keyed_column_aliases(columns: Sequence[str], key: bytes, scope: str) -> dict[str, str]:
    """Aliases that differ between runs, so two runs cannot line up their columns (PRJ4)."""
    ordered = sorted(columns)
    width = max(3, len(str(len(ordered) - 1)))
    digest = lambda c: hmac.new(key, f"{scope}:{c}".encode(), hashlib.sha256).hexdigest()[:7]
    return {c: f"x_{i:0{width}d}_{digest(c)}" for i, c in enumerate(ordered)}


def anonymise_columns(df: DataFrame, salt: str) -> DataFrame:
    """Rename every column, data unchanged."""
    return df.toDF(*column_aliases(df.columns, salt).values())


def opaque_row_ids(df: DataFrame, real_id: str, offset: int = 0, order: Sequence[Column | str] | None = None):
    """A view with row numbers in place of real ids, and the id map (PRJ6)."""
    numbered = with_row_number(df, order or [real_id], "_no").withColumn("row_id", F.col("_no") - 1 + offset)
    return numbered.drop("_no", real_id), numbered.select("row_id", real_id)


def mask_identity_tokens(df: DataFrame, columns: Sequence[str], identities: Sequence[str], salt: str) -> DataFrame:
    """Replace every occurrence of known identity strings in text or text-array columns (PRJ8).

    Longer identities go first so that one contained in another cannot break it up.
    """
    def masked(text: Column) -> Column:
        for identity in sorted(set(identities), key=lambda s: (-len(s), s)):
            text = F.replace(text, F.lit(identity), opaque_identifier(F.lit(identity), salt))
        return text

    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.withColumns(
        {c: F.transform(c, masked) if kinds[c] == "array" else masked(F.col(c)) for c in columns}
    )


def redact_keys(column: str, private: Sequence[str]) -> Column:
    """A map column without its private keys (PRJ9)."""
    return F.map_filter(column, lambda k, _: ~k.isin(*private))


def agent_view(
    df: DataFrame, column_map: Mapping[str, str], row_id: str, target: str | None, seed: int | str
) -> DataFrame:
    """Aliased visible columns in a seeded shuffle, NaN as null; the target only when named (PRJ10)."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    value = lambda c: F.nanvl(F.col(c), F.lit(None)) if c in floating else F.col(c)
    columns = [value(c).alias(a) for c, a in column_map.items()]
    columns += [F.col(row_id).alias("row_id")] + ([F.col(target).alias("target")] if target else [])
    return df.select(*columns).orderBy(hash_key(seed, "row_id"), "row_id")


def _with_extent(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Per-group extremes joined back: partial aggregation first, no window over a hot group."""
    return join_null_safe(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), list(keys))


def relative_coordinate(df: DataFrame, keys: Sequence[str], x: str, name: str = "relative") -> DataFrame:
    """(x - min) / max(max - min, 1) inside a segment (PRJ11)."""
    wide = _with_extent(df, keys, _lo=F.min(x), _hi=F.max(x))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    return wide.withColumn(name, (F.col(x) - F.col("_lo")) / span).drop("_lo", "_hi")


def min_max_scale(df: DataFrame, keys: Sequence[str], x: str, name: str = "scaled") -> DataFrame:
    """Min-max per decision; a constant vector gives 0.5 (PRJ12)."""
    wide = _with_extent(df, keys, _lo=F.min(x), _hi=F.max(x))
    value = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise(
        F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    )
    return wide.withColumn(name, value).drop("_lo", "_hi")


def relative_gain(df: DataFrame, keys: Sequence[str], x: str, name: str = "relative_gain") -> DataFrame:
    """x over the largest magnitude of its decision; all zeros stay 0 (PRJ13)."""
    wide = _with_extent(df, keys, _top=F.max(F.abs(F.col(x))))
    return wide.withColumn(name, F.coalesce(F.try_divide(F.col(x), F.col("_top")), F.lit(0.0))).drop("_top")


def validation_use_reasons(rules: Mapping[str, Sequence[str]], use: Column) -> Column:
    """Why an artifact row is not eligible for a use, in rule order without repeats (PRJ18).

    `rules` maps a rule key to the uses it applies to. Columns read: artifact_contract_valid,
    leakage_check_passed, geometry, past_only, fold_train_only.
    """
    contract, leakage = F.col("artifact_contract_valid"), F.col("leakage_check_passed")
    past, fit = F.col("past_only"), F.col("fold_train_only")
    broken = {
        "strict_forward": ((F.col("geometry") != "strict_forward") | ~past | ~fit, "strict_forward_oof_required"),
        "diagnostic_only": (F.lit(True), "geometry_is_diagnostic_only"),
        "future_information": (~past, "future_information_detected"),
        "fold_train_only": (~fit, "feature_fit_crosses_fold_boundary"),
        "artifact_contract": (~contract, "artifact_contract_invalid"),
        "leakage": (~leakage, "leakage_check_failed"),
    }
    checks = [F.when(~contract, "artifact_contract_invalid"), F.when(~leakage, "leakage_check_failed")]
    for rule, uses in rules.items():
        condition, reason = broken[rule]
        checks.append(F.when(use.isin(*uses) & condition, reason))
    return F.array_distinct(F.array_compact(F.array(*checks)))


def promotion_basis(df: DataFrame, issue: str) -> DataFrame:
    """On what evidence a validation issue may become a rule (PRJ18); null when it may not."""
    strong = (
        (F.col("horizons") >= 3) & (F.col("seeds") >= 3) & F.col("same_direction") & F.col("artifact_gate")
        & F.col("verifier")
    )
    grouped = df.groupBy(issue).agg(
        F.count_distinct("agent").alias("agents"), F.bool_or(strong).alias("_strong"), F.bool_or("safety").alias("_safety")
    )
    basis = (
        F.when(F.col("agents") >= 2, "independent_replication")
        .when(F.col("_strong"), "strong_single_agent_replication")
        .when(F.col("_safety"), "safety")
    )
    return grouped.select(issue, "agents", basis.alias("basis"))


def failed_checks(checks: Mapping[str, Column]) -> Column:
    """Names of the checks that do not hold, in the given order."""
    return F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()]))


def candidate_eligibility(df: DataFrame) -> DataFrame:
    """Standalone and ensemble eligibility with the names of failed checks (PRJ19)."""
    common = {
        "artifact_contract": F.col("artifact_contract_passed"),
        "leakage_check": F.col("leakage_check_passed"),
        "oof_honesty": F.col("oof_honesty_passed"),
        "seed_stability": F.col("seed_std") <= F.col("stability_threshold"),
    }
    required = F.greatest(F.lit(2), F.floor((F.col("evaluated_horizons") + 1) / 2))
    standalone = {**common, "standalone_quality": F.col("mean_auc") >= F.col("quality_floor")}
    ensemble = {
        **common,
        "positive_leave_one_out_gain": F.col("loo_gain") > 0,
        "multi_horizon_gain_stability": F.col("positive_horizons") >= required,
        "weight_not_fold_concentrated": F.col("max_fold_weight") <= F.lit(0.8),
    }
    made = df.withColumns(
        {"standalone_failures": failed_checks(standalone), "ensemble_failures": failed_checks(ensemble)}
    )
    return made.withColumns(
        {
            "standalone": F.size("standalone_failures") == 0,
            "ensemble": F.size("ensemble_failures") == 0,
        }
    )
