"""Quality by weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

Everything that touches a row is a column expression.  The votes of all documents are counted by pattern (at most
three to the power of the number of rules, whatever the table holds); expectation-maximisation runs on those counts
and yields each rule's accuracy.  The posterior is then a sum of log odds per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.storage import materialize

#: Fixed values of the base rules.
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50

#: Start of the estimation, and limits that keep a rule from being read the wrong way round.
ACCURACY, LEAST, MOST, ROUNDS = 0.8, 0.55, 0.99, 50


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more.

    Windows are compared by a 64-bit hash of their three words.  Sorting (hash, position) puts equal windows next to
    each other; their positions in order then give the number of words they cover.
    """
    spots = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(spots, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def count(ordered: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, j: near(x, j - 1) | near(x, j + 1))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def repeats(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # Most texts repeat no window, and need no sorting.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(ordered, count))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, repeats))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that rules look at; a null text counts as an empty one.  Columns of these names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.aggregate("_words", F.lit(0), lambda n, w: n + F.length(w)),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated(F.col("_words")),
        "n_lines": F.size("_lines"),
        "n_capitals": F.regexp_count(body, F.lit("[A-Z]")),
        "n_shouts": F.regexp_count(body, F.lit("!")),
    }
    df = df.withColumns({"_words": F.array_remove(F.split(body, SPACE + "+"), ""), "_lines": lines})
    # A generator of one row: conditions on the counts are not moved below it, where each would count again.
    once = F.inline(F.array(F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])))
    return df.select(*[c for c in df.columns if c not in (*counts, "_words", "_lines")], once)


@dataclass(frozen=True)
class Rule:
    """Votes +1 where ``good`` holds, -1 where ``bad`` does, and abstains elsewhere."""

    name: str
    good: str
    bad: str


#: Rules that look for one fault abstain without it, so that many absent faults do not outvote a present one.
RULES = (
    Rule("symbols", "false", "10 * n_symbols > n_words"),
    Rule("capitals", "false", "4 * n_capitals > word_chars"),
    Rule("shouts", "false", "10 * n_shouts > n_words"),
    Rule("repeats", "false", "3 * n_repeat_words > n_words"),
    Rule("word_length", "false", "word_chars < 3 * n_words or word_chars > 8 * n_words"),
    Rule("lines", "n_lines >= 4 and n_dup_lines = 0 and 100 * n_symbols <= n_words", "3 * n_dup_lines > n_lines"),
    Rule(
        "prose",
        "100 * n_symbols <= n_words and 100 * n_shouts <= n_words and 10 * n_capitals <= word_chars"
        " and 10 * n_repeat_words <= n_words",
        "n_words < 20",
    ),
)


def vote(rule: Rule) -> Column:
    return F.expr(f"case when {rule.bad} then -1 when {rule.good} then 1 else 0 end")


def posterior(votes: tuple[int, ...], accuracy: tuple[float, ...]) -> float:
    """Probability of a good document: votes add the log odds of their rule's accuracy, abstaining adds nothing."""
    return 1 / (1 + math.exp(-sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy))))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> tuple[float, ...]:
    """Accuracy of each rule by EM over vote patterns with their numbers of documents.

    Good and bad are equally likely beforehand, so a rule that no other rule ever meets keeps its start value; one
    document's worth of it defines rules that never vote.
    """
    accuracy = (ACCURACY,) * rules
    for _ in range(ROUNDS):
        belief = [(votes, n, posterior(votes, accuracy)) for votes, n in patterns]
        right = [sum(n * (p if v[r] > 0 else 1 - p) for v, n, p in belief if v[r]) for r in range(rules)]
        voted = [sum(n for v, n, _ in belief if v[r]) for r in range(rules)]
        accuracy = tuple(min(MOST, max(LEAST, (a + ACCURACY) / (n + 1))) for a, n in zip(right, voted))
    return accuracy


def learn(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[float, ...]:
    """Accuracies of the rules, from all rows of a table with the counts of ``features``."""
    votes = [vote(r).alias(f"_{i}") for i, r in enumerate(rules)]
    counted = df.select(*votes).groupBy(*[f"_{i}" for i in range(len(rules))]).count()
    return estimate(sorted((tuple(r[:-1]), r[-1]) for r in counted.collect()), len(rules))


def verdict(counted: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``quality`` (posterior probability) and ``kept`` to a table with counts.

    The table is read twice, to learn and to judge; store it first where counting again costs more than storing.
    """
    accuracy = learn(counted, rules)
    odds = F.lit(0.0)
    for rule, a in zip(rules, accuracy):
        odds = odds + vote(rule) * F.lit(math.log(a / (1 - a)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counted.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-odds))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add the counts, ``base_failed``, ``quality`` and ``kept``.

    Rows, nulls and repeats stay as they are; a null or empty text has no words and fails.  An empty table learns
    nothing and comes back empty.  Input columns with the names of results are replaced.
    """
    return verdict(materialize(features(df, text), "counted"), rules, threshold)
