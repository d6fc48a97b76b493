"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import GAP, text_of

#: Words of a window whose repetition counts: a power of two.
WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
#: Symbols counted as noise.
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = ("the of and to in is that for with on was le la les de des et un une est que qui dans pour der die das und ist nicht ein eine mit "
              "den von zu el los las y en es por con una del para").split()  # fmt: skip


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high] (None: open)."""

    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self, value: Column) -> Column:
        parts = [value >= self.low] if self.low is not None else []
        parts += [value <= self.high] if self.high is not None else []
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out


#: The production thresholds. Ratios are 0 where their denominator is.
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2, 14),
    Rule("symbol_ratio", None, 0.1),
    Rule("dup_line_ratio", None, 0.3),
    Rule("repeat_ratio", None, 0.3),
    Rule("stutter_ratio", None, 0.3),
    Rule("stop_ratio", 0.02, None),
)


def _let(value: Column, body) -> Column:
    """Bind a value that a lambda uses more than once, so that it is computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more.

    Windows are compared by 64-bit hash first; a text without equal hashes has none. Else (hash, position)
    pairs are sorted, neighbours of equal hash are compared word by word, and the union of the windows is measured.
    """

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of windows twice as long as `width`, at each start."""
        if width == WINDOW:
            return F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1))
        return _let(hashes, lambda h: doubled(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width))), 2 * width))

    hashes = doubled(F.transform(words, lambda w: F.xxhash64(w)), 1)

    def covered(words: Column, pairs: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (F.slice(words, a["p"], WINDOW) == F.slice(words, b["p"], WINDOW))
        near = F.filter(
            F.transform(pairs, lambda x, i: F.struct(
                x["p"].alias("p"),
                (((i > 0) & same(F.get(pairs, i - 1), x)) | F.coalesce(same(F.get(pairs, i + 1), x), F.lit(False))).alias("twice"),
            )),
            lambda x: x["twice"],
        )
        places = F.array_sort(F.transform(near, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def measure(words: Column, hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, _let(pairs, lambda p: covered(words, p))).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, _let(hashes, lambda h: measure(words, h))).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """All measures of one text as a struct; its words and lines are split once."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return F.struct(
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).alias("again"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("stutter"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS + [x.capitalize() for x in STOP_WORDS]))).cast("long").alias("stop"),
        )).alias("words"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The input rows plus __n_words, __word_chars, __n_symbols, __n_lines, __n_dup_lines, __n_repeat_words,
    __n_stop_words, the ratios the rules use (under their plain names inside __ratios) and __passes.

    One narrow projection: no shuffle, no user function. Null text counts as empty: every count is 0, every ratio
    is 0, and the word minimum rejects it. Very long texts are measured whole. Repeated rows and null ids are judged as any row,
    an empty table gives an empty result. Other columns pass through; those named like the added ones are replaced.
    """
    m = lambda name: F.col(f"__m.{name}")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    found = {
        "n_words": m("words.n"), "mean_word_chars": ratio(m("words.chars"), m("words.n")), "symbol_ratio": ratio(m("n_symbols"), m("words.n")),
        "dup_line_ratio": ratio(m("lines.dup"), m("lines.n")), "repeat_ratio": ratio(m("words.again"), m("words.n")), "stop_ratio": ratio(m("words.stop"), m("words.n")),
        "stutter_ratio": ratio(m("words.stutter"), m("words.n")),
    }
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.holds(found[rule.measure])
    counts = {"__n_words": "words.n", "__word_chars": "words.chars", "__n_symbols": "n_symbols", "__n_lines": "lines.n", "__n_dup_lines": "lines.dup", "__n_repeat_words": "words.again", "__n_stop_words": "words.stop"}
    out = docs.withColumn("__m", measures(text_of(text_col)))
    return out.withColumns({k: m(v) for k, v in counts.items()} | {"__ratios": F.struct(*(v.alias(k) for k, v in found.items())), "__passes": verdict}).drop("__m")
