"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every statistic is a built-in expression over the text, so the whole operator is one
scan and one projection: no shuffle, no Python worker, memory bounded by the longest
text.  A null text counts as empty, and an empty text fails the base rule.  Repeated
rows are judged alike and independently; other columns of the input are ignored, or
kept untouched by ``apply_rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his at this are from or have an they which you "
    "le la les de des du et un une que qui en est dans pour par sur pas au plus ne ce il se avec "
    "der die das und ist von zu den mit sich des auf für nicht ein eine im dem als auch es an "
    "el los las del y que por con una su para al lo como más o pero sus se no"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``low <= metric <= high`` (None: open)."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table.  Metrics are defined in ``metrics``.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_word_ratio", None, 0.1),
    Rule("bang_word_ratio", None, 0.25),
    Rule("upper_char_ratio", None, 0.5),
    Rule("letter_char_ratio", 0.6, None),
    Rule("distinct_stop_words", 2.0, None),
    Rule("stutter_word_ratio", None, 0.3),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def _repeat_words(words: Column) -> Column:
    """How many words lie in a window of eight words that the text holds more than once.

    Windows are compared by a 64-bit hash.  Only texts that repeat a window pay for
    the sort; the covered words are then the union of the intervals that start at the
    sorted positions of the repeated windows, so the cost is n log n for any text.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(sorted_pairs: Column) -> Column:
            def repeated(x: Column, i: Column) -> Column:
                before, after = F.get(sorted_pairs, i - 1)["h"], F.get(sorted_pairs, i + 1)["h"]
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(sorted_pairs, repeated), lambda x: x["i"]))

        def length(starts: Column) -> Column:
            steps = F.transform(
                starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        return let(let(pairs, positions), length)

    def of_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW)))
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, of_windows))


def statistics(text: Column) -> dict[str, Column]:
    """Counts that the rules are made of; all are bigint."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")
    in_words = let(words_of(text), lambda w: F.struct(
        long(F.size(w)).alias("n_words"),
        _repeat_words(w).alias("n_repeat_words"),
        long(F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))).alias("n_stutter_words"),
        long(F.size(F.array_intersect(w, F.array(*map(F.lit, sorted(set(STOP_WORDS))))))).alias("n_stop_words"),
    ))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    in_lines = let(lines, lambda x: F.struct(
        long(F.size(x)).alias("n_lines"),
        long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        long(F.size(F.filter(x, lambda line: line.rlike(f"^[{SPACES}]*[-*•]")))).alias("n_bullet_lines"),
        long(F.size(F.filter(x, lambda line: line.rlike(f"(\\.\\.\\.|…)[{SPACES}]*$")))).alias("n_ellipsis_lines"),
    ))
    return {
        "in_words": in_words,
        "in_lines": in_lines,
        "word_chars": long(F.length(F.translate(text, SPACE_CHARS, ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_bangs": long(F.length(text) - F.length(F.translate(text, "!?", ""))),
        "n_upper": long(F.regexp_count(text, F.lit(r"\p{Lu}"))),
        "n_letters": long(F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))),
    }


def metrics(count: dict[str, Column]) -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(count[a].cast("double"), count[b].cast("double")), F.lit(0.0))
    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_word_ratio": ratio("n_symbols", "n_words"),
        "bang_word_ratio": ratio("n_bangs", "n_words"),
        "upper_char_ratio": ratio("n_upper", "n_letters"),
        "letter_char_ratio": ratio("n_letters", "word_chars"),
        "distinct_stop_words": count["n_stop_words"].cast("double"),
        "stutter_word_ratio": ratio("n_stutter_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
    }


COUNTS = (
    "n_words", "n_repeat_words", "n_stutter_words", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines",
    "word_chars", "n_symbols", "n_bangs", "n_upper", "n_letters",
)


def measure(text: Column) -> Column:
    """All counts as one struct."""
    found = statistics(text)
    parts = {name: column for name, column in found.items() if name not in ("in_words", "in_lines")}
    in_words = ("n_words", "n_repeat_words", "n_stutter_words", "n_stop_words")
    whole = F.struct(found["in_words"].alias("w"), found["in_lines"].alias("l"), *(c.alias(n) for n, c in parts.items()))
    pick = lambda s, n: s["w"][n] if n in in_words else s[n] if n in parts else s["l"][n]
    return let(whole, lambda s: F.struct(*(pick(s, n).alias(n) for n in COUNTS)))


def base_failed(count: dict[str, Column]) -> Column:
    return (count["n_words"] < 20) | (100 * count["n_repeat_words"] > 30 * count["n_words"])


def passes(count: dict[str, Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """The compiled threshold table."""
    value, verdict = metrics(count), ~base_failed(count)
    for rule in rules:
        if rule.low is not None:
            verdict &= value[rule.metric] >= rule.low
        if rule.high is not None:
            verdict &= value[rule.metric] <= rule.high
    return verdict


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id, every count, ``base_failed`` and ``kept``."""
    measured = df.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    count = {n: F.col(n) for n in COUNTS}
    return measured.select("*", base_failed(count).alias("base_failed"), passes(count, rules).alias("kept"))


def apply_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes, with the columns they came with."""
    verdict = let(measure(F.col(text_col)), lambda m: passes({n: m[n] for n in COUNTS}, rules))
    return df.where(verdict)
