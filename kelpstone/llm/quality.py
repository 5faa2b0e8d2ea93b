"""Quality rules, line first (operator 10): DataFrame functions only, no shuffle.

Every line of a text is judged by punctuation, symbol, navigation and
boilerplate rules; failing lines are removed; a document that loses too much
of its text is rejected. Beside that verdict stand base counts (words,
symbols, repeated lines, repeated 8-word windows), which reject on their own.

Defined results
---------------
null text: no words, so ``base_failed``; empty text: the same.
Null or repeated ``doc_id`` and repeated rows: each row is judged by itself.
Empty tables give empty results with the same columns.
Extra columns pass through; if one bears the name of a result column, the
result column replaces it.
Words of a line are runs of anything but white space, so that tabs and carriage
returns around a line change nothing.
Very long texts: all work is linear in the text, but for one sort of window
hashes in texts that do repeat a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, NOT_SPACE, SPACE, let

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict."""

    #: A line passes the punctuation rule if it ends so (closing quotes and brackets may follow).
    ending: str = r"[.!?:;,…。！？][\"'”’»)\]]*$"
    #: So does a line that is cut off but has a sentence's end inside.
    sentence: str = r"[.!?…][\"'”’»)\]]* "
    #: Lines of fewer words than this need no ending (headings).
    heading_words: int = 12
    #: Separators of menus and breadcrumbs, so many of them in a line of at most words_per_separator words each.
    separators: str = r"[|»•·›>]"
    min_separators: int = 3
    words_per_separator: int = 4
    #: Symbols for each word of a line.
    max_symbol_ratio: float = 0.5
    #: Phrases of page furniture in English, German, Spanish and French, tested on lines of at most boilerplate_words words.
    boilerplate: str = (
        r"(?i)\b(?:cookies?|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|log ?in|sign ?(?:up|in)"
        r"|subscribe|newsletter|click here|read more|share (?:this|on)|follow us|skip to content|lorem ipsum"
        r"|alle rechte vorbehalten|impressum|nutzungsbedingungen|jetzt (?:anmelden|registrieren|abonnieren)|hier klicken|folgen sie uns|zum inhalt springen"
        r"|todos los derechos reservados|aviso legal|iniciar sesi[oóÓ]n|leer m[aáÁ]s|suscr[iíÍ]bete|comparte en|s[iíÍ]guenos|saltar al contenido"
        r"|tous droits r[eéÉ]serv[eéÉ]s|mentions l[eéÉ]gales|cliquez ici|lire la suite|abonnez-vous|partager sur|suivez-nous|aller au contenu)\b"
        r"|\bha(?:ga|z) clic aqu"
    )
    boilerplate_words: int = 20
    #: Share of the characters in words that the cleaned text must keep.
    min_kept: float = 0.5
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def words_of(text: Column) -> Column:
    """The words of a text, in order; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _windows(words: Column, size: int) -> Column:
    """A hash for each window of ``size`` words: those of w words are joined to ones of twice as many, or of as many as are still wanted."""

    def longer(codes: Column, width: int) -> Column:
        if width == size:
            return codes
        step = min(width, size - width)
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - step), F.slice(codes, step + 1, F.size(codes)), lambda a, b: F.xxhash64(a, b))
        return longer(pairs, width + step) if width + step == size else let(pairs, lambda x: longer(x, width + step))

    one_each = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(let(one_each, lambda x: longer(x, 1)))


def _covered(windows: Column, size: int) -> Column:
    """Words that lie in windows found twice or more; ``windows`` has such."""

    def sum_up(positions: Column) -> Column:
        steps = F.zip_with(F.slice(positions, 2, F.size(positions)), F.slice(positions, 1, F.size(positions) - 1), lambda b, a: F.least(b - a, F.lit(size)))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x) + size

    def positions(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twice = F.filter(pairs, lambda p, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | ((k < last) & (F.get(pairs, k + 1)["h"] == p["h"])))
        return F.array_sort(F.transform(twice, lambda p: p["i"]))

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(pairs, positions), sum_up)


def passes(line: Column, rules: LineRules) -> Column:
    """Whether a line with words passes the four rules."""
    end = F.substring(F.rtrim(line, F.lit(BLANKS)), -16, 16)

    def judged(n_words: Column) -> Column:
        separators = F.regexp_count(line, F.lit(rules.separators))
        menu = (n_words >= 2) & let(separators, lambda n: (n >= rules.min_separators) & (n_words <= rules.words_per_separator * n))
        symbols = F.regexp_count(line, F.lit(SYMBOLS)) > rules.max_symbol_ratio * n_words
        furniture = (n_words <= rules.boilerplate_words) & line.rlike(rules.boilerplate)
        return (end.rlike(rules.ending) | (n_words < rules.heading_words) | line.rlike(rules.sentence)) & ~furniture & ~symbols & ~menu

    return let(F.regexp_count(line, F.lit(NOT_SPACE + "+")), judged)


def assess(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with counts, verdict and ``clean_text`` (the lines that passed, or null for a null text)."""
    taken = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "clean_text", "base_failed", "kept"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in taken]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    one = docs.select(*rest, whole.alias("__whole"), words_of(F.col(text)).alias("__words"), lines.alias("__lines"))
    two = one.select(
        *rest,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__whole", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("__words"), rules.window).alias("__windows"),
        F.filter("__lines", lambda x: passes(x, rules)).alias("__good"),
    )
    three = two.select(
        *[F.col(f"`{c}`") for c in two.columns if c not in ("__good", "__windows")],
        F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), 0).otherwise(_covered(F.col("__windows"), rules.window)).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(F.array_join("__good", ""), SPACE + "+", "")).cast("long").alias("kept_chars"),
        F.when(F.col(text).isNotNull(), F.array_join("__good", "\n")).alias("clean_text"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    kept = ~failed & (F.col("kept_chars") >= rules.min_kept * F.col("word_chars"))
    return three.withColumns({"base_failed": failed, "kept": kept})


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, with the lines that passed as their text; columns as in ``docs``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    # The row number keeps the filter above the projection: below it, all that the verdict rests on would be computed a second time.
    kept = assess(packed, rules).withColumn("__row_number", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("__row_number") >= 0))
    own = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[own.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])
