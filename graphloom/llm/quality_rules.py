"""Quality rules: base counts, and the divergence of a document's histograms from its language's reference.

Everything here is a DataFrame expression. One pass over the texts makes every count and both histograms, and writes them;
references and verdicts read those numbers, never a text. Two histograms describe a document: its characters by class, and its words by
the language's most common function words. A reference is, for each bin, the median share over all documents of the
language that are long enough and pass the base rules; the Jensen-Shannon distance to it decides. Short documents have
noisy histograms, so each comparison has a least length, below which it isn't made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import SPACES, WORD, materialised, nested

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 5, 10, 20

#: Very common function words of four languages.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "with", "as", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con"],
}
#: Characters by class; what is in none of them is "other".
CLASSES = ["upper", "letter", "number", "space", "symbol", "other"]
#: Least characters and words for the comparisons, and the distances beyond which a document is rejected.
LEAST_CHARS_CLASS, LEAST_WORDS_COMMON = 120, 80
MOST_CLASS, MOST_COMMON = 0.18, 0.25
#: Decimals of the shares that medians are taken of: few enough values that exact medians need bounded memory, however many rows there are.
DECIMALS = 4
#: Share that a bin gets at least, so that a bin that is new to a language counts without deciding alone.
FLOOR = 1e-4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use names it, lambdas included."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared as 64-bit hashes: sorted with their places, equal neighbours give the places, and the places'
    spans are joined. Texts without a repeated window stop after the distinct count.
    """
    hashes = F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))))

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (F.get(s, k - 1)["h"] == F.get(s, k)["h"]) | (F.get(s, k + 1)["h"] == F.get(s, k)["h"])), lambda k: F.get(s, k)["i"])))

    def spans(p: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(p, start, lambda s, x: F.struct(x.alias("last"), (s["total"] + F.least(F.lit(WINDOW), x - s["last"])).alias("total")))["total"]

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), spans)))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def _only(column: str, but: str) -> Column:
    return F.length(F.regexp_replace(F.col(column), but, ""))


def counted(documents: DataFrame, text: str = "text", lang: str = "lang", keep: Sequence[str] | None = None) -> DataFrame:
    """doc (a struct of the row's own columns, or of those to keep) and of (a struct of its counts and histograms) for each row, written once.

    of has group (a known language, or "" for all others), chars, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, class (characters by class) and common (the language's common words in order; null without a known one).
    """
    df = documents.select(nested(documents, keep), F.col(text).alias("raw"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.col(lang).alias("lang"))
    # Most of a text is small letters and spaces: one pass takes them out, and the other classes are counted in the rest.
    df = df.withColumn("words", words_of(F.col("raw"))).withColumn("chars", F.length("body")).withColumn("rest", F.regexp_replace("body", "[\\p{Ll}\\x20\\x09-\\x0D]+", ""))
    df = df.withColumns({"solid": F.length(F.array_join("words", "")), "rest_n": F.length("rest"), "upper": _only("rest", "[^\\p{Lu}]+"), "letter": _only("rest", "[^\\p{L}]+"), "number": _only("rest", "[^\\p{N}]+"), "symbol": F.length("rest") - F.length(F.translate(F.col("rest"), SYMBOLS, ""))})
    c = F.col
    classes = F.array(c("upper"), c("solid") - c("rest_n") + c("letter") - c("upper"), c("number"), c("chars") - c("solid"), c("symbol"), c("rest_n") - c("letter") - c("number") - c("symbol"))
    listed = F.lit(None).cast("array<string>")
    for name, common in COMMON.items():
        listed = F.when(c("lang") == name, F.array(*map(F.lit, common))).otherwise(listed)
    size = F.size("words")
    found = F.transform(listed, lambda x: size - F.size(F.array_remove(c("words"), x)))
    lines = F.filter(F.split("body", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of = F.struct(
        F.when(c("lang").isin(*COMMON), c("lang")).otherwise(F.lit("")).alias("group"), c("chars").cast("long").alias("chars"),
        size.cast("long").alias("n_words"), c("solid").cast("long").alias("word_chars"), c("symbol").cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(c("words")).cast("long").alias("n_repeat_words"),
        classes.alias("class"), found.alias("common"),
    )
    return materialised(df.select("doc", of.alias("of")), "rules-counts")


#: Shares of the bins of each histogram, over the columns of counted().
def _shares() -> dict[str, Column]:
    words = F.col("of.n_words")
    rest = words - F.aggregate("of.common", F.lit(0).cast("long"), lambda a, x: a + x)
    return {"class": F.transform("of.class", lambda x: x / F.col("of.chars")), "common": F.concat(F.transform("of.common", lambda x: x / words), F.array(rest / words))}


#: Bins of each histogram.
BINS = {"class": len(CLASSES), "common": 1 + len(next(iter(COMMON.values())))}


def _long_enough(kind: str) -> Column:
    return F.col("of.chars") >= LEAST_CHARS_CLASS if kind == "class" else (F.col("of.n_words") >= LEAST_WORDS_COMMON) & F.col("of.common").isNotNull()


def references(counts: DataFrame) -> dict[str, dict[str, list[float]]]:
    """For each known language, and "" for all others together, the reference of each kind of histogram: medians over all of its documents.

    Medians are exact for shares of DECIMALS decimals, so they don't depend on how rows are dealt. One row of a fixed number
    of medians for each of at most five groups reaches the driver.
    """
    shares = _shares()
    medians = (F.percentile(F.when(_long_enough(kind), F.round(F.get(shares[kind], F.lit(k)), DECIMALS)), F.lit(0.5)).alias(f"{kind}{k}") for kind, n in BINS.items() for k in range(n))
    rows = counts.filter(F.col("of.n_words") >= LEAST_WORDS).groupBy(F.col("of.group").alias("g")).agg(*medians).collect()
    found: dict[str, dict[str, list[float]]] = {}
    for row in rows:
        for kind, n in BINS.items():
            middle = [row[f"{kind}{k}"] for k in range(n)]
            if None not in middle:
                floored = [max(m, FLOOR) for m in middle]
                found.setdefault(row["g"], {})[kind] = [m / sum(floored) for m in floored]
    return found


def divergence(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, between two arrays of shares: 0 for equal histograms, 1 for disjoint ones."""

    def term(p: Column, q: Column) -> Column:
        mean = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mean)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / mean)).otherwise(0.0)

    total = F.aggregate(F.zip_with(shares, reference, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def js_distance(shares: list[Column], reference: list[float]) -> Column:
    return divergence(F.array(*shares), F.array(*map(F.lit, reference)))


def with_quality(documents: DataFrame, text: str = "text", lang: str = "lang", keep: Sequence[str] | None = None) -> DataFrame:
    """doc (a struct of the row's own columns, whatever their names, or of those to keep), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_class, js_common, kept.

    Null and empty texts have no words: they fail the base rules. A comparison whose least length isn't met, or for which
    the corpus has no reference, gives null and rejects nobody; a null or unknown language is compared by character
    classes alone, with all such documents. Rows are judged one by one, so repeated rows get equal verdicts; texts of any
    length are counted whole; an empty table gives an empty one.
    """
    counts = counted(documents, text, lang, keep)
    known, shares = references(counts), _shares()

    def distance(kind: str) -> Column:
        # One expression, with the row's reference chosen inside it, so that plans stay small.
        wanted = F.lit(None).cast("array<double>")
        for name, kinds in known.items():
            if kind in kinds:
                wanted = F.when(F.col("of.group") == name, F.array(*map(F.lit, kinds[kind]))).otherwise(wanted)
        return F.when(_long_enough(kind), divergence(shares[kind], wanted))

    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("of.n_words") < LEAST_WORDS) | (F.col("of.n_repeat_words") * 100 > F.col("of.n_words") * REPEAT_PERCENT)
    df = counts.select("doc", *(f"of.{x}" for x in numbers), failed.alias("base_failed"), distance("class").alias("js_class"), distance("common").alias("js_common"))
    return df.withColumn("kept", ~F.col("base_failed") & (F.coalesce("js_class", F.lit(0.0)) <= MOST_CLASS) & (F.coalesce("js_common", F.lit(0.0)) <= MOST_COMMON))
