"""Labels: an append-only log whose last row for an id counts; import, overrides, agreement, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions.text import letter_choices, unknown_letters

#: Verdicts by task; a task without any asks for relevant candidates alone.
VERDICTS = {"test_pairs": ("correct", "wrong", "ambiguous"), "so_questions": (), "train_audit": ("correct", "wrong"), "negatives_audit": ("true_negative", "false_negative")}
#: Characters of a reason that are kept; what a label consists of.
REASON, FIELDS = 300, ("verdict", "also_relevant", "relevant", "reason", "labeler")


def latest(log: DataFrame, id_: list[str], order: list[str]) -> DataFrame:
    """The last row of each id: a maximum, so partial results suffice however long an id's history is."""
    last = F.max_by(F.struct(*[F.col(c) for c in log.columns]), F.struct(*[F.col(c) for c in order]))
    return log.groupBy(*id_).agg(last.alias("_row")).select("_row.*")


def overridden(labels: DataFrame, spot: DataFrame) -> DataFrame:
    """labels: id, verdict, labeler; spot: id, verdict. A human's spot check wins for ids that are labelled already."""
    human = spot.select("id", F.col("verdict").alias("_human"))
    joined = labels.join(human, "id", "left")
    return joined.withColumns({"verdict": F.coalesce("_human", "verdict"), "labeler": F.when(F.col("_human").isNotNull(), "human").otherwise(F.col("labeler"))}).drop("_human")


def outcome(verdict: Column, relevant: Column) -> Column:
    """The key that a label counts under."""
    return F.coalesce(verdict, F.when(F.size(relevant) > 0, "mapped").otherwise("no_match"))


def summary(queue: DataFrame, labels: DataFrame, verdict: str) -> DataFrame:
    """total, labelled, done and counts (map) of a queue; labels of unknown ids don't count."""
    joined = queue.select("id").join(labels.select("id", F.col(verdict).alias("_v")), "id", "left")
    each = joined.groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
    out = each.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("n"))), F.lit(0)).alias("labelled"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", "n"))))).alias("counts"))
    return out.select(F.coalesce("total", F.lit(0)).alias("total"), "labelled", ((F.col("total") > 0) & (F.col("labelled") >= F.col("total"))).alias("done"), "counts")


def agreement(human: DataFrame, other: DataFrame, labeler: str = "model") -> DataFrame:
    """n, the share of equal verdicts to three places (null without any), and confusion: how often each human and other
    verdict met, as a map by h/c. human: id, verdict; other: id, verdict, labeler, of which only `labeler` counts."""
    both = human.select("id", F.col("verdict").alias("h")).join(other.where(F.col("labeler") == labeler).select("id", F.col("verdict").alias("c")), "id")
    each = both.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.concat_ws("/", "h", "c").alias("key"), F.col("n").alias("value"))
    n, equal = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("h") == F.col("c"), F.col("n"))), F.lit(0))
    return each.agg(n.alias("n"), F.when(n > 0, F.bround(equal / n, 3)).alias("agreement"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("confusion"))


def disagreements(human: DataFrame, other: DataFrame) -> DataFrame:
    """id, human, other for each id on which a human and any other labeler differ, a row each."""
    both = human.select("id", F.col("verdict").alias("human")).join(other.select("id", F.col("verdict").alias("other")), "id")
    return both.where(~F.col("human").eqNullSafe(F.col("other")))


def imported(answers: DataFrame, queue: DataFrame, labels: DataFrame, overwrite: bool = False, labeler: str = "model") -> DataFrame:
    """One row for the last answer of each id: id, task, status, error and the label, FIELDS.

    answers: id, pos, verdict, reason, also_relevant, relevant (arrays of letters); queue: id, task, candidates (array);
    labels: id and FIELDS, the latest of each id. status is unknown (id not in any queue), invalid (error says why),
    kept_human (labelled by anyone but `labeler`, unless overwrite), unchanged (all FIELDS are the same) or saved; the
    rows saved are what an import appends, so importing again changes nothing.

    test_pairs need a verdict and a list also_relevant, which counts for correct pairs only; so_questions a list
    relevant; train_audit and negatives_audit a verdict of their own. A letter beyond the candidates is an error.
    """
    last = latest(answers, ["id"], ["pos"]).select("id", F.lower(F.trim("verdict")).alias("verdict"), F.substring(F.coalesce("reason", F.lit("")), 1, REASON).alias("reason"), "also_relevant", "relevant")
    joined = last.join(queue.select("id", "task", "candidates"), "id", "left")
    task, verdict = F.col("task"), F.col("verdict")
    allowed = F.try_element_at(F.create_map(*[x for t, vs in VERDICTS.items() for x in (F.lit(t), F.array(*map(F.lit, vs)).cast("array<string>"))]), task)
    asked = F.when(task == "test_pairs", F.col("also_relevant")).when(task == "so_questions", F.col("relevant"))
    listed = task.isin("test_pairs", "so_questions")
    unknown = unknown_letters(asked, F.col("candidates"))
    error = (
        F.when(task.isNull(), F.lit("unknown id"))
        .when((F.size(allowed) > 0) & ~F.coalesce(F.array_contains(allowed, verdict), F.lit(False)), F.concat(F.lit("no such verdict: "), F.coalesce(verdict, F.lit(""))))
        .when(listed & asked.isNull(), F.lit("no list of letters"))
        .when(listed & (F.size(unknown) > 0), F.concat(F.lit("unknown letter: "), F.array_join(unknown, ", ")))
    )
    chosen, none = letter_choices(asked, F.col("candidates")), F.lit(None).cast("array<string>")
    made = joined.select(
        "id", "task", error.alias("error"), F.when(F.size(allowed) > 0, verdict).alias("verdict"),
        F.when(task == "test_pairs", F.when(verdict == "correct", chosen).otherwise(F.array().cast("array<string>"))).otherwise(none).alias("also_relevant"),
        F.when(task == "so_questions", chosen).otherwise(none).alias("relevant"), "reason", F.lit(labeler).alias("labeler"),
    )
    old = labels.select("id", F.struct(*FIELDS).alias("_old"))
    joined = made.join(old, "id", "left")
    same = F.lit(True)
    for c in FIELDS:
        same = same & F.col(c).eqNullSafe(F.col("_old")[c])
    there = F.col("_old").isNotNull()
    by_human = there & ~F.col("_old.labeler").eqNullSafe(F.lit(labeler)) & F.lit(not overwrite)
    status = F.when(task.isNull(), "unknown").when(F.col("error").isNotNull(), "invalid").when(by_human, "kept_human").when(there & same, "unchanged").otherwise("saved")
    return joined.select("id", "task", status.alias("status"), "error", *FIELDS)


def next_unlabelled(queue: DataFrame, labels: DataFrame, after: int) -> DataFrame:
    """first: the first pos without a label, or the length; next: the first after `after`, from the start if none."""
    free = queue.join(labels.select("id"), "id", "left_anti")
    n = queue.agg(F.count(F.lit(1)).alias("n"))
    found = free.agg(F.min("pos").alias("first"), F.min(F.when(F.col("pos") > after, F.col("pos"))).alias("later"))
    return found.join(n, how="cross").select(F.coalesce("first", "n").alias("first"), F.coalesce("later", "first").alias("next"))
