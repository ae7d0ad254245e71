"""Text keys as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Left out of canonical keys: punctuation, separators, controls and format characters, white space, and letters or marks that show nothing.
NOT_TEXT = r"[\p{P}\p{Z}\p{C}\s\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"
#: The same for texts in ASCII: what stays are letters, digits and the symbols that are no punctuation.
ASCII_NOT_TEXT = r"[^a-z0-9$+<=>^`|~]+"
#: Characters that show nothing, without white space.
INVISIBLE = r"[\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]+"


def _is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def canonical(col: Column | str) -> Column:
    """The text without white space, letter case, punctuation and invisible characters; null stays null.

    Texts in plain ASCII, most of them, take a pattern without Unicode properties, which is several times as fast.
    """
    col = F.col(col) if isinstance(col, str) else col
    low = F.lower(col)
    return F.when(_is_ascii(col), F.regexp_replace(low, ASCII_NOT_TEXT, "")).otherwise(F.regexp_replace(low, NOT_TEXT, ""))


def canonical_key(col: Column | str) -> Column:
    """32 hex digits of the canonical text; null where nothing is left of it."""
    return let(canonical(col), lambda t: F.when(F.length(t) > 0, F.md5(t)))


#: The same in Python, for operators that read texts in Arrow batches anyway; it is several times as fast there as the pattern is in the JVM.
_ASCII_TEXT = {i: (chr(i).lower() if chr(i).isalnum() or chr(i) in "$+<=>^`|~" else None) for i in range(128)}


def canonical_text(text: str) -> str:
    if text.isascii():
        return text.translate(_ASCII_TEXT)
    return _not_text().sub("", text.lower())


@functools.cache
def _not_text():
    import regex

    return regex.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), NOT_TEXT))


def words_text(col: Column | str) -> Column:
    """Lower-case words separated by single spaces: invisible characters and apostrophes vanish, other punctuation separates."""
    col = F.col(col) if isinstance(col, str) else col
    low = F.lower(col)
    plain = F.regexp_replace(F.regexp_replace(low, "['`]+", ""), "[^a-z0-9]+", " ")
    joined = F.regexp_replace(low, INVISIBLE[:-2] + r"'’‘`´]+", "")
    return F.trim(F.when(_is_ascii(col), plain).otherwise(F.regexp_replace(joined, r"[^\p{L}\p{N}\p{M}]+", " ")))


def code_name(col: Column | str) -> Column:
    """A name as plain code: lower case, other characters than letters and digits as one underscore, none at the ends; blank becomes null."""
    col = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(F.length(text) > 0, text)


# ---- words, sentences and question kinds ----

# The word lists and orders below must equal those of the features they define.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "of", "in", "on", "at",
    "to", "for", "with", "by", "from", "that", "this", "it", "its",
    "and", "or", "but", "not", "no", "what", "which", "who", "whom",
    "when", "where", "why", "how",
)
WH_WORDS = ("what", "who", "where", "when", "why", "how", "which", "whose", "whom")
QUESTION_KINDS = ("why", "how many", "how much", "how", "which", "what", "who", "when", "where")
QTYPE_SCORES = {"when": 0.1, "where": 0.15, "who": 0.2, "what": 0.25, "which": 0.35, "how many": 0.4, "how much": 0.4, "how": 0.75, "why": 0.9}
AUXILIARIES = "is|are|was|were|do|does|did|can|could|will|would"
LEVELS = ("preA1", "A1", "A2", "B1", "B2", "C1", "C2", "C2+")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is named in it."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(col: Column | str) -> Column:
    """Runs of ASCII letters and apostrophes of the lower-case text; null gives null."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit("([a-z']+)"), 1)


def content_words(toks: Column) -> Column:
    """Tokens longer than one character that are no stop words; repeats stay."""
    return F.filter(toks, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def word_list(col: Column | str) -> Column:
    """What Unicode white space separates, without empty parts."""
    return F.filter(F.split(_c(col), r"(?U)\s+"), lambda w: w != "")


def word_count(col: Column | str) -> Column:
    return F.size(word_list(col)).cast("bigint")


def sentences(col: Column | str) -> Column:
    """The trimmed text, cut at white space after a full stop, question or exclamation mark."""
    return F.split(F.trim(_c(col)), r"(?<=[.!?])\s+")


def sentence_count(col: Column | str) -> Column:
    return F.greatest(F.lit(1), F.size(sentences(col))).cast("bigint")


def sentence_count_by_marks(col: Column | str) -> Column:
    """Parts between runs of end marks that are not blank, at least 1."""
    parts = F.filter(F.split(_c(col), "[.!?]+"), lambda s: F.trim(s) != "")
    return F.greatest(F.lit(1), F.size(parts)).cast("bigint")


def end_mark_runs(col: Column | str) -> Column:
    return F.regexp_count(_c(col), F.lit("[.!?]+")).cast("bigint")


def question_kind(col: Column | str) -> Column:
    """why, how many, how much, how, which, what, who, when or where by the question's beginning; yes/no after an auxiliary; else other."""
    q = F.lower(F.trim(_c(col)))
    out = F.when(q.rlike(rf"^({AUXILIARIES})\b"), "yes/no").otherwise("other")
    for kind in reversed(QUESTION_KINDS):
        out = F.when(q.startswith(kind), kind).otherwise(out)
    return F.when(q.isNotNull(), out)


def wh_ordinal(col: Column | str) -> Column:
    """Place of the first word among WH_WORDS, from 0; 9 if it is none of them."""
    first = F.get(word_list(F.lower(_c(col))), 0)
    at = F.array_position(F.array(*[F.lit(w) for w in WH_WORDS]), first)
    return F.when(_c(col).isNotNull(), F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(9)).cast("bigint")


def qtype_score(col: Column | str) -> Column:
    """How much reasoning the question's beginning asks for; the longest beginning counts, 0.5 if none fits."""
    q = F.lower(F.trim(_c(col)))
    out = F.lit(0.5)
    for phrase in sorted(QTYPE_SCORES, key=len):
        out = F.when(q.startswith(phrase), QTYPE_SCORES[phrase]).otherwise(out)
    return F.when(q.isNotNull(), out)


def plain_tokens(col: Column | str) -> Column:
    """Lower-case words after all marks but letters, digits and underscores are taken out."""
    return word_list(F.regexp_replace(F.lower(_c(col)), r"(?U)[^\w\s]", ""))


def first_year(col: Column | str) -> Column:
    """The first number from 1000 to 2099 standing alone; null if there is none."""
    return F.regexp_extract(_c(col), r"\b(1[0-9]{3}|20[0-9]{2})\b", 1).try_cast("int")


def collapse(col: Column | str) -> Column:
    """White space as single blanks, none at the ends."""
    return F.array_join(word_list(col), " ")


def truncate_words(col: Column | str, n: int) -> Column:
    """The first n words, only if the text has more."""
    return let(word_list(col), lambda w: F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(_c(col)))


def parsed_label(col: Column | str, default: int = 1) -> Column:
    """0, 1 or 2 by the first EASY, MEDIUM or HARD in the text; the default if there is none."""
    word = F.regexp_extract(F.upper(_c(col)), r"\b(EASY|MEDIUM|HARD)\b", 1)
    return F.coalesce(F.when(word == "EASY", 0).when(word == "MEDIUM", 1).when(word == "HARD", 2), F.lit(default)).cast("bigint")


def without_fence(col: Column | str) -> Column:
    """The text inside a Markdown code fence, or all of it."""
    text = F.trim(_c(col))
    return F.when(text.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))).otherwise(text)


def lix(col: Column | str) -> Column:
    """Words per sentence plus the percentage of words longer than six letters, from 20..65 to 0..1; 0 for a text without words."""
    sents = F.size(F.filter(F.split(_c(col), r"\."), lambda s: F.trim(s) != ""))

    def value(x: Column) -> Column:
        n = F.size(x["w"])
        long_words = F.size(F.filter(x["w"], lambda w: F.length(F.rtrim(w, F.lit(".,!?;:"))) > 6))
        raw = n / x["s"] + long_words * 100 / n
        return F.when((n == 0) | (x["s"] == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - 20.0) / 45.0)))

    return F.when(_c(col).isNotNull(), let(F.struct(word_list(col).alias("w"), sents.alias("s")), value))


def level_of(score: Column) -> Column:
    """The level of a score from 0 to 1; the borders lie half-way between the eighths' marks k / 7."""

    def level(x: Column) -> Column:
        out = F.lit(LEVELS[0])
        for k, name in enumerate(LEVELS[1:]):
            out = F.when(x >= (k + 0.5) / 7, name).otherwise(out)
        return F.when(x.isNotNull(), out)

    return let(score, level)


def level_ordinal(col: Column | str) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), _c(col)) - 1).cast("bigint")


def difficulty_of(score: Column) -> Column:
    """EASY below a third, MEDIUM below two thirds, else HARD."""
    return let(score, lambda x: F.when(x < 1 / 3, "EASY").when(x < 2 / 3, "MEDIUM").when(x.isNotNull(), "HARD"))


def label_ordinal(col: Column | str) -> Column:
    """0, 1, 2 for easy, medium, hard in any case; null for anything else."""
    c = F.lower(F.trim(_c(col)))
    return F.when(c == "easy", 0).when(c == "medium", 1).when(c == "hard", 2).cast("bigint")


def contains_text(passage: Column | str, answer: Column | str) -> Column:
    """Whether the answer stands in the passage, without regard to case; an empty answer always does."""
    return F.contains(F.lower(_c(passage)), F.lower(_c(answer)))


def level_score(level: Column | str) -> Column:
    """The level's place on the scale, from 0 to 1; a word that is no level counts as the lowest."""
    return F.greatest(F.coalesce(level_ordinal(level), F.lit(0)), F.lit(0)) / float(len(LEVELS) - 1)


def student_level(right: Column | str) -> Column:
    """The level of a question by how many of three readers of different strength answer it: all EASY, two MEDIUM, fewer HARD."""
    right = _c(right)
    return F.when(right >= 3, "EASY").when(right == 2, "MEDIUM").when(right.isNotNull(), "HARD")


def in_either(a: Column, b: Column) -> Column:
    """Whether one text, without case, holds the other."""
    a, b = F.lower(a), F.lower(b)
    return F.contains(a, b) | F.contains(b, a)


def detected_language(col: Column | str, known: dict[str, tuple[str, ...]] | None = None, default: str = "en") -> Column:
    """The language whose commonest words are the most among the text's words; the default for texts without any, ties and null."""
    known = known or COMMON_WORDS
    words = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"(\p{L}+)"), 1)
    met = lambda w, common: F.size(F.filter(w, lambda x: x.isin(*common)))
    out = let(words, lambda w: let(F.array(*[met(w, common) for common in known.values()]), lambda n: _most(n, list(known), default)))
    return F.coalesce(out, F.lit(default))


def _most(n: Column, names: list[str], default: str) -> Column:
    top = F.array_max(n)
    once = F.size(F.filter(n, lambda x: x == top)) == 1
    return F.when((top > 0) & once, F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(n, top).cast("int"))).otherwise(default)


#: Common words by which English and Finnish are told apart.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "was", "that", "it", "for", "is", "with", "as", "his", "he", "by", "at", "from", "on", "this", "are"),
    "fi": ("ja", "on", "oli", "ei", "että", "se", "hän", "mutta", "kun", "joka", "myös", "kuin", "ovat", "sen", "olivat", "niin", "jos", "mitä", "tai", "sekä"),
}


def number_row(label: str, values: list[Column], form: str = "%8.1f", width: int = 16) -> Column:
    """A line of a table: the label padded to a width, then the numbers in their form; null and NaN as a dash of the same width."""
    size = int(re.sub(r"\D*(\d+).*", r"\1", form) or 8)
    shown = [F.when(v.isNull() | F.isnan(v.cast("double")), F.lpad(F.lit("-"), size, " ")).otherwise(F.format_string(form, v.cast("double"))) for v in values]
    return F.concat(F.rpad(F.lit(label), width, " "), *[x for v in shown for x in (F.lit(" "), v)])
