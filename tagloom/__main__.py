"""Submit a daily job: ``spark-submit ... -m tagloom <job> --dt 2024-01-31 --database tags ...``."""

from __future__ import annotations

import argparse

from tagloom import plans
from tagloom.functions.packing import SIGNED, UNSIGNED
from tagloom.operators.export import BATCH_ROWS, ISOLATION
from tagloom.operators.features import DWELL_SETS, TOP_CATEGORIES, VISIT_ITEM_TYPE, VISIT_PAGE
from tagloom.operators.model import BEHAVIOUR_PARAMS, feature_weights, tree_text
from tagloom.session import spark_session
from tagloom.sources.catalog import Metadata
from tagloom.sources.tables import preview


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--dt", required=True, help="day, yyyy-MM-dd")
    shared.add_argument("--database", required=True, help="database of the tag tables")
    shared.add_argument("--metadata", help="database of tag_info, task_info and task_tag_rule")
    shared.add_argument("--metadata-url", help="JDBC address of these tables, instead of a database of the catalogue")
    shared.add_argument("--metadata-property", action="append", default=[], metavar="KEY=VALUE")
    shared.add_argument("--hive", action="store_true", help="a catalogue that outlives the process (Hive support)")
    shared.add_argument("--prefix", default=plans.WIDE_TABLE_PREFIX, help="name of the wide tables before the day")
    shared.add_argument("--base", help="folder of the tables; the database's own unless given")

    parser = argparse.ArgumentParser(prog="tagloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    tag = jobs.add_parser("tag", parents=[shared], help="compute the tag of one task")
    tag.add_argument("--task", type=int, required=True)
    tag.add_argument("--warehouse", help="database the task's query runs in")
    tag.add_argument("--tab-text", action="store_true", help="store the tag as tab-delimited text")
    tag.add_argument("--lenient", action="store_true", help="values of the wrong type become NULL")
    several = jobs.add_parser("tags", parents=[shared], help="compute the tags of several tasks from one query")
    several.add_argument("--tasks", type=int, nargs="+", required=True)
    several.add_argument("--sql", required=True, help="yields uid and a column for each tag code; $dt stands for the day")
    several.add_argument("--warehouse", help="database the query runs in")
    several.add_argument("--tab-text", action="store_true", help="store the tags as tab-delimited text")
    several.add_argument("--lenient", action="store_true", help="values of the wrong type become NULL")
    merge = jobs.add_parser("merge", parents=[shared], help="merge the day's tags into the wide table")
    merge.add_argument("--one-value", nargs="*", default=[], help="tags a user has at most once")
    export = jobs.add_parser("export", parents=[shared], help="export the wide table over JDBC")
    export.add_argument("--url", required=True)
    export.add_argument("--driver")
    export.add_argument("--partitions", type=int, default=4)
    export.add_argument("--batchsize", type=int, default=BATCH_ROWS)
    export.add_argument("--isolation", default=ISOLATION)
    export.add_argument("--property", action="append", default=[], metavar="KEY=VALUE", help="user, password and so on")
    export.add_argument("--create-options", help="text after the target's CREATE TABLE")
    bitmaps = jobs.add_parser("bitmaps", parents=[shared], help="build the members of each tag value")
    bitmaps.add_argument("--unsigned", action="store_true", help="uids are numbers from 0 to 2^64 - 1")
    bitmaps.add_argument("--runs", action="store_true", help="write containers, with runs of consecutive users")
    label = argparse.ArgumentParser(add_help=False)
    label.add_argument("--model", required=True, help="folder of the model")
    label.add_argument("--logs", required=True, help="table of page views")
    label.add_argument("--items", required=True, help="table of item snapshots")
    label.add_argument("--users", required=True, help="table of users")
    label.add_argument("--dt-from", help="first log day; the last is --dt")
    label.add_argument("--page-id", default=VISIT_PAGE)
    label.add_argument("--item-type", default=VISIT_ITEM_TYPE)
    label.add_argument("--item-dt", help="day of the item snapshot")
    label.add_argument("--top", type=int, default=TOP_CATEGORIES, help="ranked categories that are features")
    label.add_argument("--dwell-set", action="append", default=[], metavar="NAME=1,2,3", help="replaces the sets")
    train = jobs.add_parser("train", parents=[shared, label], help="train the label model")
    train.add_argument("--new-categories", choices=("keep", "error"), default="keep")
    train.add_argument("--seed", type=int, default=0)
    sample = jobs.add_parser("train-sample", parents=[shared], help="train the sample model")
    sample.add_argument("--model", required=True, help="folder of the model")
    sample.add_argument("--samples", required=True, help="table of samples with their label")
    sample.add_argument("--seed", type=int, default=0)
    sample.add_argument("--preview", type=int, default=100, help="held-out rows that are shown with their prediction")
    predict = jobs.add_parser("predict", parents=[shared, label], help="write the label tag")
    predict.add_argument("--table", required=True, help="name of the label tag")
    predict.add_argument("--treat-empty-as-missing", action="store_true")
    return parser.parse_args(argv)


def pairs(given: list[str]) -> dict[str, str]:
    """``KEY=VALUE`` arguments."""
    return dict(each.split("=", 1) for each in given)


def feature_options(args: argparse.Namespace) -> dict[str, object]:
    """What training and prediction must have in common."""
    sets = {name: tuple(map(int, members.split(","))) for name, members in pairs(args.dwell_set).items()}
    return {
        "k": args.top,
        "sets": sets or DWELL_SETS,
        "item_dt": args.item_dt,
        "page_id": args.page_id,
        "item_type": args.item_type,
    }


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = spark_session(f"tagloom-{args.job}", hive=args.hive)

    def meta() -> Metadata:
        if args.metadata_url:
            return Metadata.from_jdbc(spark, args.metadata_url, pairs(args.metadata_property))
        return Metadata.from_tables(spark, args.metadata or args.database)

    if args.job == "tag":
        plans.run_tag_task(
            spark,
            meta(),
            args.task,
            args.dt,
            args.database,
            args.warehouse,
            args.base,
            strict=not args.lenient,
            tab_text=args.tab_text,
        )
    elif args.job == "tags":
        plans.run_shared_tasks(
            spark,
            meta(),
            args.tasks,
            args.dt,
            args.database,
            args.sql,
            args.warehouse,
            args.base,
            strict=not args.lenient,
            tab_text=args.tab_text,
        )
    elif args.job == "merge":
        plans.run_merge(spark, meta(), args.dt, args.database, args.base, args.prefix, args.one_value)
    elif args.job == "export":
        plans.run_export(
            spark,
            args.dt,
            args.database,
            args.url,
            args.prefix,
            pairs(args.property),
            driver=args.driver,
            batchsize=args.batchsize,
            isolation=args.isolation,
            partitions=args.partitions,
            create_options=args.create_options,
        )
    elif args.job == "bitmaps":
        ids = UNSIGNED if args.unsigned else SIGNED
        plans.run_bitmaps(spark, meta(), args.dt, args.database, args.base, args.prefix, ids=ids, with_runs=args.runs)
    elif args.job == "train-sample":
        samples = spark.table(args.samples)
        fitted, report, scored = plans.run_sample_training(samples, args.model, seed=args.seed)
        print(tree_text(fitted))
        feature_weights(spark, fitted).show(100, truncate=False)
        report.show(100, truncate=False)
        preview(scored, args.preview).show(args.preview, truncate=False)
    else:
        inputs = (spark.table(args.logs), spark.table(args.items), spark.table(args.users))
        if args.job == "train":
            params = BEHAVIOUR_PARAMS.with_(new_categories=args.new_categories)
            fitted, report = plans.run_training(
                *inputs, args.model, args.dt_from or args.dt, args.dt, params, args.seed, **feature_options(args)
            )
            print(tree_text(fitted))
            feature_weights(spark, fitted).show(100, truncate=False)
            report.show(100, truncate=False)
        else:
            table = f"{args.database}.{args.table}"
            location = f"{args.base.rstrip('/')}/{args.database}/{args.table}" if args.base else None
            plans.run_prediction(
                spark,
                *inputs,
                args.model,
                args.dt,
                table,
                args.dt_from,
                location,
                args.treat_empty_as_missing,
                **feature_options(args),
            )


if __name__ == "__main__":
    main()
