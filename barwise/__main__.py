"""Command lines: python -m barwise calibrate | oos | forecast | funding | robustness | combine."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from barwise.functions.scalars import minutes_to_schedule
from barwise.operators import chunks, features, forecasting, splits, summaries
from barwise.operators.settle import settled
from barwise.plans import experiments
from barwise.sources import bars, runs

#: The published horizons, frames and window in five-minute bars.
HORIZONS, FRAMES, WINDOW = (12, 48, 144, 288), {"d": 288, "w": 2016, "m": 8640}, 288


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="barwise", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, text in (("calibrate", "Calibration tables"), ("oos", "Static tests with clips, specifications and bootstraps"), ("forecast", "Family comparison, ranking and selection"), ("funding", "Nested models with rate events"), ("robustness", "Liquidity, pooled tests, sensitivity, effect sizes and margins")):
        job = jobs.add_parser(name, help=text)
        job.add_argument("--data-dir", default="data", help="folder of the bar files")
        job.add_argument("--out-dir", default=f"results/{name}")
        job.add_argument("--assets", nargs="*", help="ASSET:file pairs in place of the defaults")
        job.add_argument("--all-assets", action="store_true", help="all default assets, not only the main ones")
        if name == "oos":
            job.add_argument("--bootstrap-replications", type=int, default=1000)
            job.add_argument("--bootstrap-block-length", type=int, default=24)
        if name == "calibrate":
            job.add_argument("--acf-max-lag", type=int, default=300)
        if name == "forecast":
            job.add_argument("--top-quantile", type=float, default=0.9)
            job.add_argument("--funding-window-minutes", type=int, default=60, help="minutes around the scheduled settlements")
            job.add_argument("--selection-loss", choices=["MSE", "QLIKE"], default="QLIKE")
            job.add_argument("--run-validation-selection", action="store_true")
        if name in ("funding", "robustness"):
            job.add_argument("--funding-dir", default="data/funding_rate")
            job.add_argument("--funding-files", nargs="*", help="ASSET:file pairs in place of the defaults")
            job.add_argument("--funding-history-events", type=int, default=90)
            job.add_argument("--funding-window-minutes", type=int, default=60)
        if name == "robustness":
            job.add_argument("--margin-targets", nargs="*", type=float, default=[0.05, 0.10])
            for part in ("hyperparameter", "margin", "pooled", "funding-effect", "liquidity"):
                job.add_argument(f"--skip-{part}", action="store_true")
    job = jobs.add_parser("combine", help="Tables of several runs as one")
    job.add_argument("--input-dirs", nargs="+", required=True)
    job.add_argument("--out-dir", required=True)
    return parser.parse_args(argv)


def _signal(rows: DataFrame) -> DataFrame:
    made = lambda df, by: features.with_activation(features.with_returns(df, by), WINDOW, by=by)
    return chunks.in_chunks(rows, made, back=WINDOW + 4)


def _frame(rows: DataFrame) -> DataFrame:
    def made(df, by):
        signal = features.with_activation(features.with_returns(df, by), WINDOW, by=by)
        return features.with_semivariance(features.with_har(features.with_realized_variance(signal, HORIZONS, by), FRAMES, by), FRAMES, by)

    return settled(chunks.in_chunks(rows, made, back=max(FRAMES.values()) + WINDOW, ahead=max(HORIZONS)))


def _pools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(pool, asset) for pool, assets in summaries.POOLS.items() for asset in assets], "pool string, asset string")


def _har_losses(frame: DataFrame, families: tuple[str, ...]) -> DataFrame:
    long = settled(experiments.clipped(forecasting.by_horizon(frame, HORIZONS, tuple(FRAMES)), frame, ranges=splits.BAR_SPLITS))
    same = {h: next((k for k, n in FRAMES.items() if n == h), None) for h in HORIZONS}
    return settled(forecasting.details(long, tuple(FRAMES), same, [forecasting.Nested(f, f) for f in families], splits=splits.BAR_SPLITS))


def _rates(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    files = bars.parse_assets(args.funding_files or [], runs.RATE_FILES)
    return runs.read_rate_files(spark, args.funding_dir, files)


def _robustness(spark: SparkSession, args: argparse.Namespace, rows: DataFrame) -> dict[str, DataFrame]:
    """The parts that are not skipped; every part reads the same bars."""
    out: dict[str, DataFrame] = {}
    frame = None if args.skip_pooled and args.skip_margin else _frame(rows)
    if not args.skip_liquidity:
        out["ex_ante_liquidity_2024"] = summaries.liquidity(rows, 2024)
    if not args.skip_pooled:
        losses = _har_losses(frame, ("HAR",))
        out["har_per_origin_loss_details"] = losses
        out["pooled_loss_tests"] = summaries.pooled_table(losses, _pools(spark))
    if not args.skip_hyperparameter:
        out["hyperparameter_sensitivity_har"] = experiments.signal_sensitivity(features.with_returns(rows), HORIZONS, FRAMES, ranges=splits.BAR_SPLITS)
    if not args.skip_funding_effect and (events := _rates(spark, args)) is not None:
        both = rows.join(events.select("asset").distinct(), "asset", "left_semi")
        out["funding_window_effect_size"] = experiments.rate_window_effect(_signal(both), events, args.funding_window_minutes, args.funding_history_events, ("asset",), ranges=splits.BAR_SPLITS)
    if not args.skip_margin:
        out["margin_capital_efficiency_diagnostics"] = experiments.margin_efficiency(frame, HORIZONS, FRAMES, tuple(args.margin_targets), splits.BAR_SPLITS)
    return out


def tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The job's result tables by name; a job without any bars gives none."""
    if args.job == "combine":
        names = ("comparison", "effect_size", "margins", "sensitivity")
        found = {name: runs.combined(spark, args.input_dirs, name) for name in names}
        if (liquidity := runs.combined(spark, args.input_dirs, "liquidity")) is not None:
            found["liquidity"] = runs.combined_liquidity([liquidity])
        if (losses := runs.combined(spark, args.input_dirs, "losses")) is not None:
            found["losses"], found["pooled_tests"] = runs.combined_losses([losses], _pools(spark))
        return {name: table for name, table in found.items() if table is not None}
    # calibration and robustness take all default assets, the other jobs the main ones
    rows = runs.read_assets(spark, args.data_dir, runs.chosen_assets(args.assets, args.all_assets or args.job in ("calibrate", "robustness")))
    if rows is None:
        return {}
    rows = settled(rows)
    if args.job == "calibrate":
        return experiments.calibration(rows, splits.BAR_SPLITS, WINDOW, 1 / 288, acf_max_lag=args.acf_max_lag)
    if args.job == "robustness":
        return _robustness(spark, args, rows)
    frame = _frame(rows)
    if args.job == "oos":
        return {"static_tests": experiments.specification_sweep(frame, HORIZONS, FRAMES, block_length=args.bootstrap_block_length, replicates=args.bootstrap_replications, ranges=splits.BAR_SPLITS)}
    if args.job == "forecast":
        losses = _har_losses(frame, tuple(forecasting.FAMILIES))
        flagged = losses.withColumn("in_window", minutes_to_schedule("ts") <= args.funding_window_minutes)
        out = {"losses": losses, "comparison": forecasting.comparison(losses), "scheduled_window": summaries.flag_means(flagged, ["asset", "horizon", "family"], "in_window"), "ranking": summaries.high_ranking(losses, args.top_quantile)}
        if args.run_validation_selection:
            out["selection"] = experiments.selected_family(frame, HORIZONS, FRAMES, splits.BAR_SPLITS, args.selection_loss.lower())
        return out
    events = _rates(spark, args)
    if events is None:
        return {}
    both = rows.join(events.select("asset").distinct(), "asset", "left_semi")
    options = {"tolerance_minutes": args.funding_window_minutes, "history": args.funding_history_events, "by": ("asset",), "ties": ("funding_time",), "ranges": splits.BAR_SPLITS}
    return {"funding_models": experiments.rate_models(_signal(both), events, HORIZONS, FRAMES, **options)}


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = SparkSession.builder.appName(f"barwise {args.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, table in tables(spark, args).items():
        kind = "json" if any(t.startswith("array") for _, t in table.dtypes) else "csv"
        bars.write_table(table, f"{args.out_dir}/{name}", kind)
        print(name)
        spark.read.option("header", True).format(kind).load(f"{args.out_dir}/{name}").show(20)


if __name__ == "__main__":
    main()
