"""How far plans have come: what completes each step, which steps are ready, and what blocks a plan.

Tables: steps (plan, step, position, operation, target, file_path, depends_on), and evidence: manual (plan, step), files
(plan, path) and symbols (plan, target) that changed, verified (plan, ref) tests and observations that passed, additions
(plan, path, state) of planned files, errors (plan, code) of the plan's evaluation, tests (plan, failed, revision), and plans
(plan, revision). All plans go through at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

NEXT, STATUSES = 8, ("completed", "in_progress", "ready", "pending", "blocked")
#: Plans of more steps go through in rounds. What is gathered of a plan besides its steps, and the code of a cycle.
LARGE, EVIDENCE, CYCLE = 32, ("manual", "files", "symbols", "verified", "additions"), "change_plan_cycle"


def waves(steps: DataFrame, most: int = 10_000) -> DataFrame:
    """(plan, step, wave): 1 for steps that wait for none, else one more than the last that a step waits for; null in and
    behind a cycle, and for steps that wait for one that the plan lacks.

    Each round takes the steps whose last open dependency was placed in the round before; it ends when none is left, so it
    takes as many rounds as the longest chain.
    """
    waits = written(steps.select("plan", "step", F.explode("depends_on").alias("on")).distinct())
    front = written(steps.where("depends_on is null or size(depends_on) = 0").select("plan", "step", F.lit(1).alias("wave")))
    placed, wave = front, 1
    while not front.isEmpty() and wave < most:
        wave += 1
        open_ = written(waits.join(front.select("plan", F.col("step").alias("on")), ["plan", "on"], "left_anti"))
        freed = waits.join(front.select("plan", F.col("step").alias("on")), ["plan", "on"], "left_semi").select("plan", "step").distinct()
        front = written(freed.join(open_.select("plan", "step").distinct(), ["plan", "step"], "left_anti").withColumn("wave", F.lit(wave)))
        placed, waits = placed.unionByName(front), open_
    return steps.select("plan", "step").join(placed, ["plan", "step"], "left")


def completed_by(steps: DataFrame, manual: DataFrame, files: DataFrame, symbols: DataFrame, verified: DataFrame, additions: DataFrame) -> DataFrame:
    """The steps with the evidence that completes each (null if none does), the state of the file that it adds, and whether it
    was marked by hand though only reviews and observations may be."""
    flag = lambda df, name, *keys: df.select("plan", *(F.col(a).alias(b) for a, b in keys)).distinct().withColumn(name, F.lit(True))
    kind, ref = _kind_and_ref(F.col("target"))
    rows = steps.withColumns({"__kind": kind, "__ref": ref})
    rows = rows.join(flag(manual, "__manual", ("step", "step")), ["plan", "step"], "left")
    rows = rows.join(flag(files, "__file", ("path", "file_path")), ["plan", "file_path"], "left").join(flag(symbols, "__symbol", ("target", "target")), ["plan", "target"], "left")
    rows = rows.join(flag(verified, "__verified", ("ref", "__ref")), ["plan", "__ref"], "left")
    state = additions.groupBy("plan", F.col("path").alias("file_path")).agg(F.min("state").alias("__state"))  # complete before partial
    rows = rows.join(state, ["plan", "file_path"], "left")
    evidence, by_hand = _evidence(F.col("operation"), F.col("__kind"), F.col("file_path"), F.col("__manual"), F.col("__file"), F.col("__symbol"), F.col("__verified"), F.col("__state"))
    told = rows.select(*steps.columns, evidence.alias("evidence"), F.col("__state").alias("state"), (F.coalesce("__manual", F.lit(False)) & ~by_hand).alias("refused"))
    return told


def _codes(plans: DataFrame, errors: DataFrame, tests: DataFrame) -> DataFrame:
    """(plan, code): errors of the evaluation, failed tests, and tests of another revision."""
    ran = tests.join(plans.select("plan", F.col("revision").alias("__now")), "plan")
    told = F.array_compact(F.array(F.when(F.col("failed") > 0, "test_failure"), F.when(~F.col("revision").eqNullSafe(F.col("__now")), "stale_test_evidence")))
    return errors.select("plan", "code").unionByName(ran.select("plan", F.explode(told).alias("code")))


def _by_rounds(steps: DataFrame, manual: DataFrame, files: DataFrame, symbols: DataFrame, verified: DataFrame, additions: DataFrame, held: DataFrame) -> DataFrame:
    """(plan, step, position, status, evidence, wave, refused) of plans of any size, in rounds of joins; held (plan): the blocked plans but for those with a cycle."""
    placed = written(waves(steps))
    held = held.select("plan").unionByName(placed.where("wave is null").select("plan")).distinct().withColumn("__held", F.lit(True))
    told = completed_by(steps, manual, files, symbols, verified, additions).join(placed, ["plan", "step"])
    told = written(told.join(held, "plan", "left"))
    done = told.where("evidence is not null").select("plan", F.col("step").alias("__on"))
    waits = told.select("plan", "step", F.explode("depends_on").alias("__on"))
    open_ = waits.join(done, ["plan", "__on"], "left_anti").select("plan", "step").distinct().withColumn("__open", F.lit(True))
    status = _status(F.col("evidence"), F.col("operation"), F.col("state"), F.col("__held"), F.col("__open"))
    return told.join(open_, ["plan", "step"], "left").select("plan", "step", "position", status.alias("status"), "evidence", "wave", "refused")


def _status(evidence: Column, operation: Column, state: Column, held: Column, waits: Column) -> Column:
    return F.when(evidence.isNotNull(), "completed").when((operation == "add") & (state == "partial"), "in_progress").when(held, "blocked").when(waits, "pending").otherwise("ready")


def _evidence(operation: Column, kind: Column, path: Column, manual: Column, file: Column, symbol: Column, verified: Column, state: Column) -> tuple[Column, Column]:
    """What completes a step, and whether it may be marked by hand."""
    by_hand = (operation == "review_consumer") | (kind == "observe")
    adds, writes = operation == "add", operation.isin("add", "modify")
    lacking = adds & ~F.coalesce(state == "complete", F.lit(False))
    passed = F.when(verified & (kind == "test"), "passed_test_evidence").when(verified & (kind == "observe"), "passed_observability_evidence")
    evidence = (
        F.when(manual & by_hand, "explicit_review")
        .when(writes & lacking, None)
        .when(writes & (kind == "symbol") & symbol, "git_symbol")
        .when(writes & (F.coalesce(path, F.lit("")) != "") & file, F.when(adds, "working_tree_semantic_node").otherwise("git_file"))
        .otherwise(passed)
    )
    return evidence, by_hand


def _kind_and_ref(target: Column) -> tuple[Column, Column]:
    return F.regexp_extract(target, "^(symbol|test|observe):", 1), F.regexp_replace(target, "^(test|observe):", "")


def _within(rows: DataFrame) -> DataFrame:
    """Plans that lie in one row each, with the waves of their steps (__waves) and the steps with their evidence (__told)."""
    ids = F.transform("steps", lambda x: x["step"])
    waits = F.transform("steps", lambda x: F.transform(F.coalesce(x["depends_on"], F.filter(ids, lambda _: F.lit(False))), lambda d: F.array_position(ids, d)))

    def freed(found: Column, on: Column) -> Column:
        wave = lambda j: F.get(found, j - 1)
        return F.when(F.coalesce(F.forall(on, lambda j: (j > 0) & wave(j).isNotNull()), F.lit(False)), 1 + F.coalesce(F.array_max(F.transform(on, wave)), F.lit(0)))

    # In the order of steps most find their wave at once; rounds are for those that wait for later ones.
    once = F.aggregate("__waits", F.array().cast("array<int>"), lambda found, on: F.concat(found, F.array(freed(found, on))))
    round_ = lambda found, _: F.transform("__waits", lambda on, i: F.coalesce(F.get(found, i), freed(found, on)))
    waves = F.when(F.exists("__once", lambda w: w.isNull()), F.aggregate("__waits", F.col("__once"), round_)).otherwise(F.col("__once"))

    has = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))

    def read(x: Column, i: Column) -> Column:
        kind, ref = _kind_and_ref(x["target"])
        state = F.array_min(F.transform(F.filter("additions", lambda a: a["path"] == x["file_path"]), lambda a: a["state"]))
        return F.struct(x.alias("s"), kind.alias("kind"), has("verified", ref).alias("verified"), state.alias("state"), has("manual", x["step"]).alias("manual"), F.get("__waves", i).alias("wave"))

    def told(y: Column) -> Column:
        x = y["s"]
        evidence, by_hand = _evidence(x["operation"], y["kind"], x["file_path"], y["manual"], has("files", x["file_path"]), has("symbols", x["target"]), y["verified"], y["state"])
        kept = [x[c].alias(c) for c in ("step", "position", "operation", "depends_on")]
        return F.struct(*kept, evidence.alias("evidence"), y["state"].alias("state"), (y["manual"] & ~by_hand).alias("refused"), y["wave"].alias("wave"))

    rows = rows.withColumn("steps", F.array_sort("steps"))
    for name, value in (("__waits", waits), ("__once", once), ("__waves", waves), ("__told", F.transform(F.transform("steps", read), told))):
        rows = rows.withColumn(name, F.when(F.col("__small"), value))
    return rows


def gathered(steps: DataFrame, manual: DataFrame, files: DataFrame, symbols: DataFrame, verified: DataFrame, additions: DataFrame) -> DataFrame:
    """One row a plan with all that its steps need: steps, manual, files, symbols, verified and additions as arrays."""
    listed = lambda df, name, value: df.groupBy("plan").agg(F.collect_set(value).alias(name))
    found = steps.groupBy("plan").agg(F.collect_list(F.struct("step", "position", "operation", "target", "file_path", "depends_on")).alias("steps"))
    for df, name, value in ((manual, "manual", "step"), (files, "files", "path"), (symbols, "symbols", "target"), (verified, "verified", "ref"), (additions, "additions", F.struct("path", "state"))):
        found = found.join(listed(df, name, value), "plan", "left")
    return found.select("plan", "steps", *(F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in EVIDENCE))


def progress(plans: DataFrame, steps: DataFrame, manual: DataFrame, files: DataFrame, symbols: DataFrame, verified: DataFrame, additions: DataFrame, errors: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (plan, step, status, evidence, wave, refused) and plans (plan, status, one count a status, next_steps, blockers).

    A step is completed by its evidence, in_progress if the file it adds is there in part, blocked if its plan is, ready if all
    that it waits for is completed, else pending. next_steps are the first ready ones, by wave and position.
    """
    return progress_of(plans, gathered(steps, manual, files, symbols, verified, additions), errors, tests)


def progress_of(plans: DataFrame, held_by: DataFrame, errors: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for plans that are gathered already. Each goes through in its own row; those of more than LARGE steps in rounds."""
    codes = _codes(plans, errors, tests).select("plan", "code", F.lit(False).alias("known"))
    codes = codes.unionByName(plans.select("plan", F.lit(None).cast("string").alias("code"), F.lit(True).alias("known"))).groupBy("plan").agg(F.collect_set("code").alias("codes"), F.max("known").alias("known"))
    every = held_by.join(codes, "plan", "full_outer")  # the only join: rows of plans move once
    small = F.coalesce(F.size("steps") <= LARGE, F.lit(False))
    done = F.transform(F.filter("__told", lambda x: x["evidence"].isNotNull()), lambda x: x["step"])
    every = _within(every.withColumn("__small", small))
    every = every.withColumn("__done", done).withColumn("blockers", F.array_sort(F.array_distinct(F.concat(F.coalesce("codes", F.array().cast("array<string>")), F.when(F.exists("__waves", lambda w: w.isNull()), F.array(F.lit(CYCLE))).otherwise(F.array().cast("array<string>"))))))
    waits = lambda x: F.coalesce(F.exists(x["depends_on"], lambda d: ~F.coalesce(F.array_contains("__done", d), F.lit(False))), F.lit(False))
    out = lambda x: F.struct(x["step"].alias("step"), x["position"].alias("position"), _status(x["evidence"], x["operation"], x["state"], F.size("blockers") > 0, waits(x)).alias("status"), x["evidence"].alias("evidence"), x["wave"].alias("wave"), x["refused"].alias("refused"))
    every = written(every.select("plan", F.coalesce("known", F.lit(False)).alias("known"), "blockers", F.transform("__told", out).alias("told"), *(F.when(~F.col("__small"), F.col(c)).alias(c) for c in ("steps", *EVIDENCE))))
    columns = ("step", "position", "status", "evidence", "wave", "refused")
    rows = every.select("plan", F.explode("told").alias("x")).select("plan", *(f"x.{c}" for c in columns))
    large = every.where("steps is not null")
    blocked = every.select("plan", "blockers")
    if not large.isEmpty():
        each = lambda name, *fields: large.select("plan", F.explode(name).alias("x")).select("plan", *fields)
        found = written(_by_rounds(each("steps", "x.*"), each("manual", F.col("x").alias("step")), each("files", F.col("x").alias("path")), each("symbols", F.col("x").alias("target")), each("verified", F.col("x").alias("ref")), each("additions", "x.*"), large.where(F.size("blockers") > 0)))
        rows = rows.unionByName(found)
        cycles = found.where("wave is null").select("plan", F.array(F.lit(CYCLE)).alias("__more")).distinct()
        blocked = blocked.join(cycles, "plan", "left").select("plan", F.array_sort(F.array_union("blockers", F.coalesce("__more", F.array().cast("array<string>")))).alias("blockers"))
        summed = rows.groupBy("plan").agg(F.collect_list(F.struct(*columns)).alias("told"))
        every = every.select("plan", "known").join(summed, "plan", "left").join(blocked, "plan", "left")
    told = F.coalesce("told", F.array().cast(every.schema["told"].dataType))
    ready = F.array_sort(F.transform(F.filter("told", lambda x: x["status"] == "ready"), lambda x: F.struct(x["wave"].alias("wave"), x["position"].alias("position"), x["step"].alias("step"))))
    has = lambda status: F.size(F.filter("told", lambda x: x["status"] == status)).cast("long").alias(status)
    whole = every.where("known").select("plan", told.alias("told"), "blockers")
    state = F.when(F.size("blockers") > 0, "blocked").when(F.forall("told", lambda x: x["status"] == "completed"), "complete").otherwise("active")
    return rows.select("plan", "step", "status", "evidence", "wave", "refused"), whole.select("plan", state.alias("status"), *map(has, STATUSES), F.slice(F.transform(ready, lambda x: x["step"]), 1, NEXT).alias("next_steps"), "blockers")
