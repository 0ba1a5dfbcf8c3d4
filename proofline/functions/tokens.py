"""Tokens that a claim requires its evidence to contain, as Spark column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions.text import Normalization, col, normalize

# Words that count as numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
# Grammar words that no evidence need contain.
STOP_WORDS = (
    "about above across after again against along also among another any are around because been before being below between "
    "beyond both but can cannot could did does doing down during each either else even ever every few for from further had has "
    "have having her here hers him his how however into its itself just less many may might more most much must neither nor not "
    "off once one only onto other others our ours out over own per same several shall she should since some still such than that "
    "the their theirs them then there these they this those though through thus too toward towards under until upon very was "
    "were what when where whereas whether which while who whom whose why will with within without would yet"
).split()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def numeric_literals(x: Column | str) -> Column:
    """Runs of digits, points and commas that start with a digit, with a percent sign behind; final points and commas off."""
    return F.transform(F.regexp_extract_all(col(x), F.lit("[0-9][0-9.,]*%?"), F.lit(0)), lambda t: F.rtrim(t, F.lit(".,")))


def number_words(x: Column | str) -> Column:
    """The number words that occur, in any case, without a letter or digit of ASCII beside them."""
    text = F.lower(col(x))
    return F.filter(_words(NUMBER_WORDS), lambda w: F.rlike(text, F.concat(F.lit("(?<![0-9A-Za-z])"), w, F.lit("(?![0-9A-Za-z])"))))


def quoted_phrases(x: Column | str, options: Normalization = Normalization()) -> Column:
    """Normalised phrases between straight double quotes, then between single ones; an apostrophe in a word is none."""

    def between(q: str) -> Column:
        pattern = rf"(?s)(?<![\p{{IsAlphabetic}}\p{{N}}]){q}(.*?){q}(?![\p{{IsAlphabetic}}\p{{N}}])"
        return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(1))

    phrases = F.transform(F.concat(between('"'), between("'")), lambda p: normalize(p, options))
    return F.filter(phrases, lambda p: p != "")


def required_tokens(x: Column | str, options: Normalization = Normalization()) -> Column:
    """Sorted distinct numbers, number words and quoted phrases of a claim as written."""
    return F.array_sort(F.array_distinct(F.concat(numeric_literals(x), number_words(x), quoted_phrases(x, options))))


def advisory_terms(x: Column | str) -> Column:
    """Runs of two or more capitalised words that do not open a sentence, in order, with repeats.

    A fold over the words of each sentence keeps the open run apart; a run ends at any other word.
    """
    capital = lambda w: F.rlike(w, F.lit(r"(?s)^\p{IsUppercase}.*\p{IsLowercase}"))
    empty = F.array().cast("array<string>")

    def closed(done: Column, run: Column) -> Column:
        return F.when(F.size(run) >= 2, F.concat(done, F.array(F.array_join(run, " ")))).otherwise(done)

    def sentence(s: Column) -> Column:
        words = F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")
        later = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.aggregate(
            later,
            F.struct(empty.alias("done"), empty.alias("run")),
            lambda a, w: F.when(capital(w), F.struct(a["done"].alias("done"), F.concat(a["run"], F.array(w)).alias("run"))).otherwise(
                F.struct(closed(a["done"], a["run"]).alias("done"), empty.alias("run"))
            ),
            lambda a: closed(a["done"], a["run"]),
        )

    return F.flatten(F.transform(F.split(col(x), "[.!?]"), sentence))


def content_words(x: Column | str, least: int = 4, allowed: Sequence[str] = (), exempt: Column | None = None) -> Column:
    """Sorted distinct ASCII words of at least ``least`` letters, without grammar words and allowed ones."""
    words = F.regexp_extract_all(F.translate(normalize(x), _UPPER, _LOWER), F.lit("[a-z]+"), F.lit(0))
    kept = F.array_except(F.filter(words, lambda w: F.length(w) >= least), _words([*STOP_WORDS, *(w.lower() for w in allowed)]))
    if exempt is not None:
        kept = F.array_except(kept, F.transform(F.coalesce(exempt, F.array().cast("array<string>")), lambda w: F.translate(w, _UPPER, _LOWER)))
    return F.array_sort(F.array_distinct(kept))


def is_covered(text: Column | str, token: Column) -> Column:
    """``token`` occurs at one of its non-overlapping places without an ASCII letter or digit beside it."""
    edge = lambda c: F.rlike(c, F.lit("^[0-9A-Za-z]\\z"))
    quoted = F.concat(F.lit("\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    parts = F.split(col(text), quoted, -1)
    last = F.size(parts) - 1

    def free(i: Column) -> Column:
        a, b = F.get(parts, i), F.get(parts, i + 1)
        before = F.when(a != "", F.right(a, F.lit(1))).when(i == 0, F.lit("")).otherwise(F.right(token, F.lit(1)))
        after = F.when(b != "", F.left(b, F.lit(1))).when(i + 1 == last, F.lit("")).otherwise(F.left(token, F.lit(1)))
        return ~edge(before) & ~edge(after)

    places = F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))
    return F.when((token == "") | (last < 1), F.lit(False)).otherwise(F.exists(places, free))


def is_covered_any_case(text: Column | str, token: Column) -> Column:
    """The same for any case of ASCII letters and at every place, overlapping ones too."""
    quoted = F.concat(F.lit("(?i)(?<![0-9A-Za-z])\\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![0-9A-Za-z])"))
    return F.when(token == "", F.lit(False)).otherwise(F.rlike(col(text), quoted))


def is_number_word(token: Column) -> Column:
    return token.isin(*NUMBER_WORDS)


def covers(text: Column | str, token: Column) -> Column:
    """Number words in any case, all other tokens as written."""
    return F.when(is_number_word(token), is_covered_any_case(text, token)).otherwise(is_covered(text, token))
