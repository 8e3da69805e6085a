"""Command line: ``python -m confora init|preflight|run|batch|steps`` for projects, ``quality|clash|region|contacts`` for a folder of structure files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import runner, workflow
from .sources import pdb, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="confora")
    sub = p.add_subparsers(dest="command", required=True)
    stage = argparse.ArgumentParser(add_help=False)
    stage.add_argument("--stage", default="all", choices=sorted(workflow.STAGES))
    stage.add_argument("--from-step")
    stage.add_argument("--to-step")
    sub.add_parser("steps", parents=[stage], help="the steps of a stage")
    r = sub.add_parser("run", parents=[stage], help="run a project's steps; finished ones are kept")
    r.add_argument("--config", required=True)
    r.add_argument("--force", action="store_true")
    for k in workflow.STEPS:
        s = sub.add_parser(f"step{k}", help=f"run step {k} alone")
        s.add_argument("--config", required=True)
    sub.add_parser("preflight", help="what is missing before a run").add_argument("--config", required=True)
    b = sub.add_parser("batch", help="run the projects of a manifest")
    b.add_argument("--manifest", required=True)
    b.add_argument("--stage", default="all", choices=sorted(workflow.STAGES))
    i = sub.add_parser("init", help="a new configuration")
    i.add_argument("path")
    i.add_argument("--name", default="target")
    i.add_argument("--root", default="results")
    for name in ("quality", "clash", "region", "contacts"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("output")
        s.add_argument("--pattern", default="*.pdb")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "steps":
        print(" ".join(workflow.select_steps(a.stage, a.from_step, a.to_step)))
        return 0
    spark = SparkSession.builder.appName("confora").getOrCreate()
    if a.command == "run":
        print("\n".join(f"{s} {x}" for s, x in runner.run(spark, a.config, a.stage, a.from_step, a.to_step, a.force)))
        return 0
    if a.command.startswith("step"):
        runner.run(spark, a.config, "all", a.command, a.command, force=True)
        return 0
    if a.command == "init":
        print(runner.init(spark, a.path, a.name, a.root))
        return 0
    if a.command in ("preflight", "batch"):
        found = runner.preflight(spark, a.config) if a.command == "preflight" else runner.batch(spark, a.manifest, a.stage)
        rows = found.collect()
        print("\n".join("\t".join(map(str, r)) for r in rows))
        return int(any(r["severity"] == "error" if a.command == "preflight" else r["status"] == "failed" for r in rows))
    atoms = pdb.atoms(pdb.lines(spark, a.path, a.pattern), pdb.LENIENT)
    settings = workflow.Settings()
    if a.command == "contacts":
        workflow.residue_contacts(atoms, settings).write.mode("overwrite").parquet(a.output)
        return 0
    made = {"quality": workflow.quality, "region": workflow.region_verdicts, "clash": lambda x, s: workflow.clash_verdicts(x, s)[1]}[a.command](atoms, settings)
    sinks.stage_tables(made, a.output)
    print(sinks.report(spark.read.parquet(f"{a.output}/table").selectExpr("* except (passed)", "passed = 'true' as passed"), a.output, a.command))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
