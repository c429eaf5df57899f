"""Line-first cleaning in SQL expressions: rules by line, then a rule on what is left."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.common import SPACES

# Fixed values of the base figures.
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: Line rules. A line fails if one of these holds for it (characters in words: `chars`).
BARS = "|»›•"
BAR_SHARE = 20  # one bar in so many characters: navigation
SYMBOL_SHARE = 10
SHOUT_SHARE = 20  # one exclamation mark in so many characters
PHRASES = (
    "all rights reserved",
    "enable javascript",
    "accept cookies",
    "use of cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "lorem ipsum",
    "click here",
    "sign up for our newsletter",
)
#: Some sentence must end in the line: a mark, closing quotes or brackets, then a space or the end.
SENTENCE_END = r"[.!?:;\x{2026}\x{3002}][\x22\x27)\]\x{BB}\x{201D}\x{2019}]*([\x20\x09-\x0D]|\z)"
#: Kept lines must hold this share of the text's word characters.
LEAST_KEPT = 50  # per cent


def bind(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.transform(F.array(value), body)[0]


def holds_any(text: Column, parts) -> Column:
    """Whether one of `parts` occurs; plain searches cost far less than counting."""
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def number_of(text: Column, characters: str) -> Column:
    counted = F.length(text) - F.length(F.translate(text, characters, ""))
    return F.when(holds_any(text, characters), counted).otherwise(0)


def word_array(text: Column) -> Column:
    for space in SPACES[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def word_characters(text: Column) -> Column:
    return F.length(F.array_join(word_array(text), ""))


def repeated_words(words: Column) -> Column:
    """How many of `words` lie in a window of three that occurs twice or more.

    Windows are sorted by a 64-bit hash with their place, so equal ones are
    neighbours; places of repeated ones are then swept in order. The work is that
    of a sort, whatever the repetitions.
    """

    def windows(w):
        place = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(place, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))

    def repeated(s):
        same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("covered"))

    def sweep(total, i):
        more = F.least(F.lit(3), i + 2 - total["last"])
        return F.struct((i + 2).alias("last"), (total["covered"] + more).alias("covered"))

    return bind(bind(words, windows), lambda s: F.aggregate(repeated(s), start, sweep, lambda t: t["covered"]))


def line_fails(line: Column, suspect: Column) -> Column:
    """Whether a line is navigation, boilerplate, symbols or shouting, or ends no sentence.

    Lines without a word never fail. `suspect` says whether the text holds
    anything that the rules but the last look for; without it they can't fail.
    """
    low = F.lower(line)

    def rules(chars):
        return (
            (number_of(line, BARS) * BAR_SHARE > chars)
            | (number_of(line, SYMBOLS) * SYMBOL_SHARE > chars)
            | (number_of(line, "!") * SHOUT_SHARE > chars)
            | holds_any(low, PHRASES)
        )

    marked = F.when(suspect, bind(word_characters(line), rules)).otherwise(False)
    return has_word(line) & (~line.rlike(SENTENCE_END) | marked)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def suspicious(text: Column) -> Column:
    return holds_any(text, BARS + SYMBOLS + "!") | holds_any(F.lower(text), PHRASES)


def quality(docs: DataFrame) -> DataFrame:
    """Every column of `docs` and `quality`, a struct of figures and verdicts of the whole text.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_bad_lines, kept_chars, cleaned (the text of the lines that pass)
    and kept. A null text counts as one without words: base_failed, not kept,
    cleaned null. Rows are judged on their own, so repeated rows get equal
    verdicts and an empty table stays empty. Only a column named `quality` clashes;
    it is replaced.
    """
    return docs.withColumn("quality", verdict_of(docs["text"]))


def verdict_of(whole: Column) -> Column:
    """The struct of quality() for a text."""
    text = F.coalesce(whole, F.lit(""))

    def figures(words):
        chars = F.length(F.array_join(words, ""))
        return F.struct(F.size(words).alias("n"), repeated_words(words).alias("repeat"), chars.alias("chars"))

    def survey(judged):
        good = F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"])
        bad = F.transform(F.filter(judged, lambda x: x["fails"]), lambda x: x["line"])
        with_word = F.filter(F.transform(judged, lambda x: x["line"]), has_word)
        return F.struct(
            F.size(bad).alias("n_bad"),
            word_characters(F.array_join(bad, " ")).alias("lost"),
            F.array_join(good, "\n").alias("cleaned"),
            bind(with_word, lambda w: F.size(w) - F.size(F.array_distinct(w))).alias("n_dup"),
        )

    def judged_lines(suspect):
        judge = lambda line: F.struct(line.alias("line"), line_fails(line, suspect).alias("fails"))
        return F.transform(F.split(text, "\n"), judge)

    def verdict(x):
        w, lines = x["words"], x["lines"]
        n, repeat, chars = (w[name].cast("long") for name in ("n", "repeat", "chars"))
        left = chars - lines["lost"].cast("long")
        failed = (n < FEWEST_WORDS) | (100 * repeat > MOST_REPEATED * n)
        return F.struct(
            n.alias("n_words"),
            chars.alias("word_chars"),
            x["symbols"].cast("long").alias("n_symbols"),
            lines["n_dup"].cast("long").alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            failed.alias("base_failed"),
            lines["n_bad"].cast("long").alias("n_bad_lines"),
            left.alias("kept_chars"),
            F.when(whole.isNotNull(), lines["cleaned"]).alias("cleaned"),
            (~failed & (100 * left >= LEAST_KEPT * chars)).alias("kept"),
        )

    found = F.struct(
        bind(word_array(text), figures).alias("words"),
        bind(bind(suspicious(text), judged_lines), survey).alias("lines"),
        number_of(text, SYMBOLS).alias("symbols"),
    )
    return bind(found, verdict)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows that pass, without their failed lines; n_chars follows the text.

    Null texts and texts without words go; repeated rows stay or go together; an empty table stays
    empty. Columns keep their names and values, whatever they are called.
    """
    passing = bind(verdict_of(docs["text"]), lambda v: F.when(v["kept"], v["cleaned"]))
    # A filter is pushed below a plain expression and evaluates it again. A row number, never
    # below 0, holds it above, so each text is judged once.
    passing = F.when(F.monotonically_increasing_id() >= 0, passing)
    out = docs.withColumn("text", passing).where("text IS NOT NULL")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
