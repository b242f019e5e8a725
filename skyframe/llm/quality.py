"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a condition that rejects a row. Its cost is measured by running it over a bounded sample, its rejections are counted there, and the rules
are put in the order of rejections per cost, each time among the rows that the rules before it leave. A row is asked rule after rule until one rejects
it, so the order decides what is spent but never which rows are kept: they are those that no rule rejects.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.session import settle

SAMPLE_ROWS = 2000
RUNS = 3
LEAST_SECONDS = 1e-3
WINDOW = 5
FEWEST_WORDS = 10
SPACE = r"[ \t-\r]"
# fixed values: function words of English, German, Spanish and French
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "with", "on", "as", "was", "are", "this", "it",
              "der", "die", "das", "und", "den", "von", "zu", "mit", "ein", "eine", "nicht", "im",
              "de", "la", "que", "el", "en", "y", "los", "por", "con", "una", "para", "las",
              "le", "les", "des", "et", "un", "une", "est", "dans", "qui", "pas"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once for a row, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, newline, vertical tab, form feed and carriage return."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of `window` words that occur twice or more among these words, the first occurrence included.

    Windows are compared by hash first: if all hashes differ, nothing repeats. Else the windows themselves are sorted, and each one that equals a
    neighbour adds the words that the one before it has not covered.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)

    def parts(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(window)]

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["w"] == x["w"]) | (F.get(ordered, k + 1)["w"] == x["w"]))
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, none, lambda s, i: F.struct((i + window).alias("end"), (s["n"] + i + window - F.greatest(i, s["end"])).alias("n")))["n"]

    def exactly() -> Column:
        # no word holds a space, so that joined windows are equal only if their words are
        return _let(F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *parts(i)).alias("w"), i.alias("i")))), covered)

    hashes = F.transform(starts, lambda i: F.xxhash64(*parts(i)))
    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exactly()))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(some).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row of docs; a null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = _let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                                    repeated_words(w).alias("n_repeat_words")))
    lines = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
                 lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words.alias("w"), lines.alias("l"), symbols.alias("n_symbols"))
    return rows.select("doc_id", "text", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def base_rules() -> dict[str, Column]:
    """Fewer than 10 words; more than a fifth of the words in repeated windows."""
    return {"few_words": F.col("n_words") < FEWEST_WORDS, "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words")}


def standard_rules() -> dict[str, Column]:
    """Rules over the columns of `measured`."""
    n, text = F.col("n_words"), F.col("text")
    bare = F.size(F.filter(words_of(text), lambda w: ~w.rlike(r"\p{L}")))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    marks = F.length(F.regexp_replace(text, "[^!?]+", ""))
    known = F.size(F.array_intersect(F.transform(words_of(text), F.lower), F.lit(STOP_WORDS)))
    return {
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "symbols": 5 * F.col("n_symbols") > n,
        "same_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "no_letters": 10 * bare > 3 * n,
        "capitals": 2 * capitals > letters,
        "marks": 2 * marks > n,
        "no_function_words": (n >= 50) & (known < 2),
    }


@dataclass(frozen=True)
class Step:
    """A rule in its place: seconds over the sample, and the share of the rows left to it that it rejects there."""

    name: str
    seconds: float
    rejected: float


def draw(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About `sample_rows` rows, never more than twice as many, from all over the table; a smaller table whole."""
    total = rows.count()
    return (rows if total <= sample_rows else rows.sample(sample_rows / total, seed)).limit(2 * sample_rows)


def cascade_order(sample: DataFrame, rules: Mapping[str, Column]) -> list[Step]:
    """The rules by rejections per cost, estimated on a sample of bounded size (see `draw`) that has a column text.

    A rule's cost is the least of a few timed runs over the sample less that of reading it. Rules that reject nothing in the sample come last, the
    cheaper first; ties fall to the name.
    """
    sample, names = settle(sample), sorted(rules)

    def seconds(*columns: Column) -> float:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            sample.agg(F.sum(F.length("text")), *columns).collect()
            taken.append(time.perf_counter() - start)
        return min(taken)

    outcomes = sample.groupBy(*[F.coalesce(rules[n], F.lit(False)).alias(n) for n in names]).count().collect()  # no more rows than the sample has
    reading = seconds()
    costs = {n: max(LEAST_SECONDS, seconds(F.count_if(rules[n])) - reading) for n in names}
    return order_by_rate(costs, [({n for n in names if r[n]}, r["count"]) for r in outcomes])


def order_by_rate(costs: Mapping[str, float], outcomes: Sequence[tuple[set[str], int]]) -> list[Step]:
    """Greedy order from each rule's cost and from (rules that reject, number of rows)."""
    left, open_rules, steps = list(outcomes), sorted(costs), []
    while open_rules:
        rows = sum(n for _, n in left)
        hits = {r: sum(n for x, n in left if r in x) for r in open_rules}
        best = min(open_rules, key=lambda r: (-hits[r] / costs[r], costs[r], r))
        steps.append(Step(best, costs[best], hits[best] / rows if rows else 0.0))
        left = [(x, n) for x, n in left if best not in x]
        open_rules.remove(best)
    return steps


def rejected_by(rules: Mapping[str, Column], order: Sequence[str]) -> Column:
    """The first rule in this order that rejects the row, null if none does; later rules are not evaluated. A null condition does not reject."""
    if sorted(order) != sorted(rules):
        raise ValueError("the order must name every rule once")
    out = None
    for name in order:
        out = F.when(rules[name], F.lit(name)) if out is None else out.when(rules[name], F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept.

    base_failed: a base rule rejects the text. kept: neither a base rule nor one of the standard rules does; the latter are asked as a cascade. Null
    texts count as empty and fail, null ids stay, repeated rows are judged each, no other column is read, an empty table gives an empty result.
    """
    base, rules = base_rules(), standard_rules()
    failed = base["few_words"] | base["repeats"]
    sample = measured(draw(docs.select(id_col, text_col), sample_rows), id_col, text_col).filter(~failed)
    order = [s.name for s in cascade_order(sample, rules)]
    told = measured(docs, id_col, text_col).withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(rejected_by(rules, order).isNull())
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
