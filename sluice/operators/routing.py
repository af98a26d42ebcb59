"""Route resolution: which provider and destination an outbox row goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.config import KNOWN_TARGETS, RelayConfig
from sluice.functions.once import column, first_match, text, texts

ROUTE = ["resolved_target", "resolved_destination"]


def resolved_target(cfg: RelayConfig) -> tuple[str, str]:
    """Target expression and the predicate that accepts it."""
    targets = [b.target for b in cfg.backends]
    nothing = "CAST(NULL AS STRING)", "false"
    if not targets:
        return nothing
    if len(targets) == 1:
        only = text(targets[0])
        if not cfg.target_col:
            return only, "true"
        expression = f"coalesce(nullif({column(cfg.target_col)}, ''), {only})"
        return expression, f"{expression} = {only}"
    if not cfg.target_col:
        return nothing
    expression = f"nullif({column(cfg.target_col)}, '')"
    return expression, f"{expression} IN ({texts(targets)})"


def resolved_destination(cfg: RelayConfig, target: str) -> str:
    """Own destination of the row, else the default of its target."""
    branches = [(f"{target} = {text(b.target)}", text(b.default_destination)) for b in cfg.backends]
    default = first_match(*branches, otherwise="''")
    if not cfg.destination_col:
        return default
    return f"coalesce(nullif({column(cfg.destination_col)}, ''), {default})"


def ownership(cfg: RelayConfig, target: str, destination: str) -> str:
    """Allowlist predicate over resolved destinations; backends without a list own all."""
    limits = [f"({target} <> {text(b.target)} OR {destination} IN ({texts(b.owned_destinations)}))"
              for b in cfg.backends if b.owned_destinations]
    return " AND ".join(limits) or "true"


def resolve_routes(df: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Check the table's columns, then add its route columns."""
    cfg.check_columns(df)
    return with_routes(df, cfg)


def with_routes(df: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Add resolved_target, resolved_destination and the routable verdict."""
    target, accepted = resolved_target(cfg)
    destination = resolved_destination(cfg, target)
    verdict = f"({accepted}) AND {destination} <> '' AND {ownership(cfg, target, destination)}"
    return df.selectExpr("*", f"{target} AS resolved_target", f"{destination} AS resolved_destination",
                         f"coalesce({verdict}, false) AS routable")


def routable_events(df: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Rows this relay may collect, with their route columns.

    With two or more backends the raw target list is implied by the route
    predicate; stating it lets the Parquet reader skip row groups.
    """
    if len(cfg.backends) > 1 and cfg.target_col:
        df = df.filter(f"{column(cfg.target_col)} IN ({texts(b.target for b in cfg.backends)})")
    return resolve_routes(df, cfg).filter("routable").drop("routable")


def owned_events(df: DataFrame, cfg: RelayConfig, owned: DataFrame | None = None) -> DataFrame:
    """Routable rows on the allowlist.

    A list too long for the configuration comes as ``owned`` with columns
    resolved_target and resolved_destination; a target absent from it owns
    every destination. Spark chooses the join from the list's size.
    """
    if owned is None:
        return routable_events(df, cfg)
    listed = owned.select("resolved_target").distinct().withColumn("_listed", F.lit(True))
    pairs = owned.select(*ROUTE).distinct().withColumn("_owned", F.lit(True))
    rows = routable_events(df, cfg).join(listed, "resolved_target", "left").join(pairs, ROUTE, "left")
    return rows.filter("_listed IS NULL OR _owned").drop("_listed", "_owned")


def unroutable_label(cfg: RelayConfig) -> str:
    """Why a row is never collected, over the output of ``resolve_routes``."""
    enabled = [b.target for b in cfg.backends]
    disabled = [t for t in KNOWN_TARGETS if t not in enabled]
    own = f"nullif({column(cfg.target_col)}, '')" if cfg.target_col else "CAST(NULL AS STRING)"
    ambiguous = f"{own} IS NULL" if len(enabled) != 1 else "false"
    return first_match(
        ("routable", "CAST(NULL AS STRING)"),
        (f"{own} IN ({texts(disabled)})" if disabled else "false", "'R7 disabled backend'"),
        (ambiguous, "'R11 ambiguous target'"),
        (f"{own} NOT IN ({texts(KNOWN_TARGETS)})", "'R10 unknown target'"),
        ("coalesce(resolved_destination, '') = ''", "'R12 no destination'"),
        otherwise="'not owned'")


def unroutable_audit(df: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Rows per reason among those the relay never collects."""
    rows = resolve_routes(df, cfg).selectExpr(f"{unroutable_label(cfg)} AS reason")
    return rows.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


def route_counts(df: DataFrame, cfg: RelayConfig) -> DataFrame:
    """Routable rows per route."""
    return routable_events(df, cfg).groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("events"))
