"""Quality rules under weak supervision.

Eleven rules look at a text; each votes good (1), bad (-1) or abstains (0).  No labels are used: expectation
maximisation estimates how often each rule is right when it votes on good and on bad texts, and how
frequent good texts are.  The posterior probability of being good replaces an all-must-pass filter.

DataFrame functions only.  A text's counts come out of one pass over its words, without a shuffle.
Votes are grouped into patterns, of which there are far fewer than 3**11, and each round of the estimation is
one aggregate over the pattern table.

Repeated words: a word counts if it lies in a window of three words found twice or more in the text, the
first time included.  Windows are sorted by a 64-bit hash and their position, so equal windows become neighbours and
long texts cost little more a word than short ones; neighbours with one hash are compared word by word.

Defined cases: null, empty and blank texts have no words, fail the base rules and are not kept; repeated
rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import query, table, written

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent function words of the corpus languages.
COMMON = (
    "the of and to in is that for with was on are der die das und den von mit ist ein eine zu "
    "de la le les et des un une que est pour dans el los las en por con una del"
).split()


@dataclass(frozen=True)
class Params:
    rounds: int = 30
    tolerance: float = 1e-4
    keep: float = 0.5
    right_on_good: float = 0.02  # least shares assumed, and the greatest
    right_on_bad: float = 0.02
    most_right: float = 0.995
    least_words: int = 50
    most_repeated: int = 50  # percent of words


def counts(docs: DataFrame) -> DataFrame:
    """The columns of docs plus the counts the rules look at."""
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumn("_words", F.array_remove(F.split("_text", BLANK), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    # Windows of three by hash and position; equal ones become neighbours, and neighbours are compared by their words.
    df = df.withColumn(
        "_windows",
        F.expr(
            "CASE WHEN n_words >= 3 THEN sort_array(transform(sequence(0, cast(n_words AS int) - 3), "
            "i -> struct(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)) AS h, i AS i))) END"
        ),
    )
    same = (
        "coalesce(x.h = get(_windows, {0}).h AND get(_words, x.i) = get(_words, get(_windows, {0}).i) "
        "AND get(_words, x.i + 1) = get(_words, get(_windows, {0}).i + 1) AND get(_words, x.i + 2) = get(_words, get(_windows, {0}).i + 2), false)"
    )
    df = df.withColumn(
        "_repeated",
        F.expr(f"sort_array(transform(filter(_windows, (x, i) -> {same.format('i - 1')} OR {same.format('i + 1')}), x -> x.i))"),
    )
    df = df.withColumn("_lines", F.expr(r"filter(split(_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    joined = F.concat_ws("", "_words")
    df = df.withColumn("_joined", joined)
    return df.select(
        *docs.columns,
        "n_words",
        F.length("_joined").cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "coalesce(aggregate(transform(_repeated, (p, i) -> least(3L, coalesce(cast(get(_repeated, i + 1) - p AS bigint), 3L))), "
            "0L, (a, x) -> a + x), 0L)"
        ).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.expr(r"filter(_lines, x -> x rlike '[.!?:\"\')][\\x20\\x09-\\x0D]*$')")).cast("long").alias("n_closed_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.size(F.array_intersect("_words", F.array(*map(F.lit, COMMON)))).cast("long").alias("n_common"),
        (F.length("_joined") - F.length(F.regexp_replace("_joined", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        F.regexp_count("_text", F.lit("!!")).cast("long").alias("n_shouts"),
    )


def votes() -> dict[str, Column]:
    """Each rule's vote on a row of counts.  Rules that look for one kind of damage abstain without it."""

    def rule(good: Column | None, bad: Column | None) -> Column:
        vote = F.when(F.col("n_words") == 0, 0)
        vote = vote if bad is None else vote.when(bad, -1)
        vote = vote if good is None else vote.when(good, 1)
        return vote.otherwise(0).cast("int")

    n, lines = F.col("n_words"), F.greatest("n_lines", F.lit(1))
    words = F.greatest("n_words", F.lit(1))
    repeated, symbols = F.col("n_repeat_words") / words, F.col("n_symbols") / words
    capitals = F.col("n_capitals") / F.greatest("word_chars", F.lit(1))
    closed, again = F.col("n_closed_lines") / lines, F.col("n_dup_lines") / lines
    length, distinct = F.col("word_chars") / words, F.col("n_distinct_words") / words
    return {
        "repeated_words": rule(None, repeated > 0.3),
        "symbols": rule(None, symbols > 0.2),
        "repeated_lines": rule(None, (again > 0.3) & (lines >= 4)),
        "capitals": rule(None, capitals > 0.4),
        "shouts": rule(None, F.col("n_shouts") / words > 0.2),
        "variety": rule(None, distinct < 0.1 - 0.00001 * F.least(n, F.lit(9000))),
        "word_length": rule(None, (length < 2) | (length > 18)),
        "closed_lines": rule(closed >= 0.5, closed < 0.1),
        "common_words": rule(F.col("n_common") >= 2, (F.col("n_common") == 0) & (n >= 50)),
        "plain": rule((symbols < 0.02) & (capitals < 0.2) & (repeated < 0.1), None),
        "length": rule(None, n < 20),
    }


def estimate(patterns: DataFrame, rules: list[str], params: Params) -> tuple[float, dict[str, tuple[float, float]]]:
    """(share of good texts, {rule: (right on good texts, right on bad texts)}) from rows of votes with
    their number n.  Only one row of sums reaches the driver in a round."""
    prior, right = 0.5, {}
    for turn in range(params.rounds):
        if turn:
            good = posterior(prior, right)
        else:  # begin with the all-must-pass verdict, which the rounds then correct
            good = F.when(F.least(*rules) < 0, 0.1).otherwise(0.95)
        p, q = F.col("n") * F.col("_good"), F.col("n") * (1 - F.col("_good"))
        wanted = [F.sum("n").alias("n"), F.sum(p).alias("good")]
        for r in rules:
            for name, weight, vote in (("gr", p, 1), ("gw", p, -1), ("br", q, -1), ("bw", q, 1)):
                wanted.append(F.sum(F.when(F.col(r) == vote, weight).otherwise(0.0)).alias(f"{r}_{name}"))
        row = patterns.withColumn("_good", good).agg(*wanted).first()
        if not row["n"]:
            break

        def share(hit: float, miss: float, least: float) -> float:
            return min(max((hit + 1) / (hit + miss + 2), least), params.most_right)

        after = {
            r: (share(row[f"{r}_gr"], row[f"{r}_gw"], params.right_on_good), share(row[f"{r}_br"], row[f"{r}_bw"], params.right_on_bad))
            for r in rules
        }
        new_prior = min(max(row["good"] / row["n"], 0.01), 0.99)
        moved = max(abs(new_prior - prior), *(abs(a - b) for r in rules for a, b in zip(after[r], right.get(r, (0.0, 0.0)))))
        prior, right = new_prior, after
        if moved < params.tolerance:
            break
    return prior, right


def posterior(prior: float, right: dict[str, tuple[float, float]]) -> Column:
    """Probability of good given the columns of votes."""
    odds = F.lit(log(prior / (1 - prior)))
    for rule, (on_good, on_bad) in right.items():
        vote = F.col(rule)
        odds = odds + F.when(vote == 1, log(on_good / (1 - on_bad))).when(vote == -1, log((1 - on_good) / on_bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, the counts, the votes, base_failed, quality (the posterior) and kept."""
    rows = counts(docs.select("doc_id", "text")).drop("text")
    for name, vote in votes().items():
        rows = rows.withColumn(name, vote)
    rows = written(rows, "counts")
    rules = list(votes())
    patterns = written(rows.groupBy(*rules).agg(F.count("*").alias("n")), "patterns")
    prior, right = estimate(patterns, rules, params)
    failed = (F.col("n_words") < params.least_words) | (100 * F.col("n_repeat_words") > params.most_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("quality", posterior(prior, right))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= params.keep))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(docs).select(*base, "base_failed", "kept", F.round("quality", 9).alias("quality"))
