"""``python -m newsloom --input DIR --output DIR``: from stored clicks to recommendations, stage by stage.

Stages that are stored for the same inputs and parameters are read. Parameters come in as ``--set section.name=value``; ``--graph name=path`` puts
a stored similarity table in the place of a built one; ``--until`` ends the run after recall or features."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession, functions as F

from . import config, sources
from .operators import lambdarank as lr, ranking, recall
from .plans.queries import Tables

log = logging.getLogger("newsloom")


def main(given: list[str] | None = None) -> Tables:
    at = argparse.ArgumentParser(prog="newsloom", description=__doc__)
    at.add_argument("--input", required=True, help="folder of the input tables")
    at.add_argument("--output", required=True, help="folder for metrics and recommendations")
    at.add_argument("--online", action="store_true", help="all clicks are history, nothing is held out")
    at.add_argument("--set", action="append", default=[], metavar="SECTION.NAME=VALUE")
    at.add_argument("--graph", action="append", default=[], metavar="NAME=PATH")
    at.add_argument("--until", choices=("recall", "features", "submission"), default="submission")
    args = at.parse_args(given)
    if args.online and args.until == "submission":
        at.error("an online run has no labels to train a ranker on: give --until recall or features")
    spark = SparkSession.builder.appName("newsloom").getOrCreate()
    t = Tables(spark, args.input, config.Settings().set(*args.set), args.online, dict(g.split("=", 1) for g in args.graph))
    fifth = t.two_tower_c_s
    fused = t.fused_of(fifth)
    if not args.online:
        sources.write_csv(recall.evaluate(fused.df, t.query).orderBy("k"), f"{args.output}/recall_metrics")
    if args.until != "recall":
        t.features_of(fused, kept=True)
    if args.until == "submission":
        ranker, oof, rows = t.ranker_of(fifth)
        sources.write_csv(lr.ndcg(oof.withColumnRenamed("pred", "score")).orderBy("k"), f"{args.output}/rank_metrics")
        sources.write_csv(ranker.importance(spark), f"{args.output}/importance")
        users = t.query.where(F.col("click_article_id") == -1)
        sources.write_csv(ranking.submission(ranker.predict(rows), users, t.click), f"{args.output}/submission")
    log.info("made: %s", ", ".join(t.run.built) or "nothing")
    return t


if __name__ == "__main__":
    logging.basicConfig(format="%(asctime)s %(name)s %(message)s")
    log.setLevel(logging.INFO)
    main()
