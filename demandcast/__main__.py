"""Command line: `python -m demandcast train|forecast|score ...`."""

import argparse

from demandcast.plans.jobs import run_forecast, run_scoring, run_training
from demandcast.schema import HOLDOUT_DAYS
from demandcast.session import build_session
from demandcast.sources.artifacts import write_forecasts
from demandcast.sources.tables import read_csv, read_inventory, read_sales


def arguments():
    parser = argparse.ArgumentParser(prog="demandcast")
    commands = parser.add_subparsers(dest="command", required=True)
    train = commands.add_parser("train", help="features, models and reports from raw CSV tables")
    forecast = commands.add_parser("forecast", help="next demand of every city and product")
    score = commands.add_parser("score", help="predictions for a CSV table of features")
    for command in (train, forecast):
        command.add_argument("sales")
        command.add_argument("inventory")
        command.add_argument("--date-format", default="yyyy-MM-dd")
    score.add_argument("rows")
    for command in (train, forecast, score):
        command.add_argument("models", help="folder of models and reports")
    for command in (forecast, score):
        command.add_argument("output")
    forecast.add_argument("--pair", nargs=2, metavar=("CITY", "PRODUCT"), help="forecast just this pair")
    train.add_argument("--holdout-days", type=int, default=HOLDOUT_DAYS)
    train.add_argument("--trials", type=int, default=10, help="parameter sets to try per model; 0: none")
    train.add_argument("--reference-mode", action="store_true")
    return parser.parse_args()


def main():
    args = arguments()
    spark = build_session()
    if args.command == "score":
        scored = run_scoring(spark, read_csv(spark, args.rows), args.models)
        print(write_forecasts(scored, args.output))
        return
    sales = read_sales(spark, args.sales, args.date_format)
    inventory = read_inventory(spark, args.inventory)
    if args.command == "train":
        _, training = run_training(
            sales,
            inventory,
            args.models,
            args.holdout_days,
            trials=args.trials,
            reference_mode=args.reference_mode,
        )
        training.metrics().show(truncate=False)
    else:
        forecasts = run_forecast(spark, sales, inventory, args.models, args.pair and tuple(args.pair))
        print(write_forecasts(forecasts, args.output, "forecast"))


if __name__ == "__main__":
    main()
