"""Column functions for mastery, spacing and level."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Thresholds, weights and reason texts that results must match.
MIN_ATTEMPTS = 2
WEAK_BELOW = 60.0
STRONG_FROM = 80.0
STATUS_WEIGHT = {"WEAK": 400.0, "DEVELOPING": 300.0, "NOT_ENOUGH_DATA": 250.0, "STRONG": 100.0}
PRACTICE_ORDER = {"WEAK": 0, "DEVELOPING": 1, "NOT_ENOUGH_DATA": 2}


def mastery_class(attempts: Column, score: Column) -> Column:
    return (F.when(attempts < MIN_ATTEMPTS, "NOT_ENOUGH_DATA").when(score < WEAK_BELOW, "WEAK")
            .when(score < STRONG_FROM, "DEVELOPING").otherwise("STRONG"))


def interval_days(status: Column, score: Column, attempts: Column) -> Column:
    weak = F.when(score < 40, 1).otherwise(2)
    developing = F.when(score < 70, 2).otherwise(3)
    strong = F.when((score >= 95) & (attempts >= 4), 14).when(score >= 90, 10).otherwise(7)
    return (F.when(status == "NOT_ENOUGH_DATA", 0).when(status == "WEAK", weak)
            .when(status == "DEVELOPING", developing).when(status == "STRONG", strong).otherwise(1))


def due_status(as_of: Column, next_review: Column, never: Column) -> Column:
    return (F.when(never, "NEW").when(next_review <= as_of, "DUE")
            .when(F.to_date(next_review) == F.to_date(as_of), "DUE_TODAY").otherwise("UPCOMING"))


def priority(status: Column, score: Column, attempts: Column, next_review: Column, as_of: Column) -> Column:
    weight = F.lit(0.0)
    for name, value in STATUS_WEIGHT.items():
        weight = F.when(status == name, F.lit(value)).otherwise(weight)
    overdue = F.greatest(F.lit(0), F.datediff(F.to_date(as_of), F.to_date(next_review)))
    total = (weight + F.greatest(F.lit(0.0), F.lit(100.0) - score)
             + F.greatest(F.lit(0), F.lit(2) - attempts) * 40.0
             + F.when(next_review <= as_of, 100.0).otherwise(0.0)
             + F.least(overdue, F.lit(30)) * 10.0)
    return F.bround(total, 2)


def level(xp: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.sqrt(xp / 100.0)) + 1).cast("int")


def practice_rank(status: Column) -> Column:
    out = F.lit(999)
    for name, value in PRACTICE_ORDER.items():
        out = F.when(status == name, F.lit(value)).otherwise(out)
    return out


def practice_reason(status: Column, score: Column, attempts: Column) -> Column:
    return (F.when(status == "WEAK", F.lit("Mastery is below 60%, so this topic should be reviewed first."))
            .when(status == "DEVELOPING", F.concat(
                F.lit("Mastery is "), F.format_string("%.2f", score),
                F.lit("%. The learner has basic understanding but still needs more practice to reach STRONG.")))
            .when(status == "NOT_ENOUGH_DATA", F.concat(
                F.lit("Only "), attempts.cast("string"),
                F.lit(" attempt(s) are available. More practice is needed to measure mastery reliably.")))
            .otherwise(F.lit("No adaptive practice is currently required.")))


def spacing_reason(status: Column, score: Column, attempts: Column, days: Column) -> Column:
    shown = F.format_string("%.2f", score)
    d = days.cast("string")
    return (F.when(status == "NOT_ENOUGH_DATA", F.concat(
                F.lit("Only "), attempts.cast("string"),
                F.lit(" attempt(s) are available. Another practice session is scheduled to obtain enough"
                      " mastery evidence.")))
            .when(status == "WEAK", F.concat(F.lit("Mastery is "), shown, F.lit("%. Review again after "), d,
                                             F.lit(" day(s) because this topic is WEAK.")))
            .when(status == "DEVELOPING", F.concat(F.lit("Mastery is "), shown, F.lit("%. Review after "), d,
                                                   F.lit(" day(s) to reinforce the topic.")))
            .when(status == "STRONG", F.concat(
                F.lit("Mastery is "), shown,
                F.lit("%. The topic is STRONG, so its review interval is expanded to "), d, F.lit(" day(s).")))
            .otherwise(F.concat(F.lit("Review after "), d, F.lit(" day(s)."))))
